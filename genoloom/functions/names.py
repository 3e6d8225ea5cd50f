"""Chromosome names: normal form and natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words before a chromosome's number or name, and one that only a digit follows.
PREFIXES, SHORT = ("chromosome", "chrom", "chr"), "ch"
# Names of sex chromosomes and organelles.
SPECIAL = {c: c for c in "XYWZ"} | {c: "MT" for c in ("M", "MT", "MITO", "MITOCHONDRIA", "MITOCHONDRION", "MITOCHONDRIAL")} | {c: "Pt" for c in ("C", "PT", "CP", "CHLOROPLAST", "PLASTID")}


def normalize_chr(x: Column, chr_map: dict[str, str] | None = None) -> Column:
    """Trimmed, mapped, without assembly and chr prefixes and leading zeros; X/Y/W/Z upper; MT and Pt."""
    x = F.trim(x.cast("string"))
    if chr_map:
        table = F.create_map(*[F.lit(v) for kv in chr_map.items() for v in kv])
        x = F.coalesce(F.try_element_at(table, x), x)
    # a prefix goes only where a name is left, so each step refers to the one before once; a word is matched whole or not at all
    words = "|".join([*PREFIXES, SHORT + "(?=[0-9])"])
    cut = F.regexp_replace(x, rf"(?i)^SL[0-9.]+(?={SHORT})(?!(?:{'|'.join(PREFIXES)})[_ .-]?$)", "")
    cut = F.regexp_replace(cut, rf"(?i)^(?>{words})[_ .-]?+(?=.)", "")
    cut = F.regexp_replace(cut, r"^0+(?=[0-9])", "")
    known = F.create_map(*[F.lit(v) for kv in SPECIAL.items() for v in kv])
    return F.coalesce(F.try_element_at(known, F.upper(cut)), cut)


def chr_key(x: Column) -> Column:
    """Sort key: numbers, then X/Y/W/Z, then other names, then MT and Pt."""
    n = F.when(x.rlike("^[0-9]+$"), x.try_cast("double"))  # 1D or 1e3 is a name
    sex = F.array_position(F.array(*[F.lit(c) for c in "XYWZ"]), x)
    organelle = F.array_position(F.array(F.lit("MT"), F.lit("Pt")), x)
    group = F.when(n.isNotNull(), 0).when(sex > 0, 1).when(organelle > 0, 3).otherwise(2)
    return F.struct(group.alias("grp"), F.coalesce(n, (sex + organelle).cast("double"), F.lit(0.0)).alias("num"), x.alias("name"))


def attr_gff3(a: Column, key: str) -> Column:
    """Value of ``key`` in a GFF3 attribute string, percent-decoded; empty as null."""
    got = F.trim(F.regexp_extract(a, rf"(?:^|;)\s*{key}=([^;]*)", 1))
    # most lines lack most keys: no pattern is tried on them
    return F.when(F.contains(a, F.lit(f"{key}=")), F.nullif(F.try_url_decode(F.replace(got, F.lit("+"), F.lit("%2B"))), F.lit("")))


def attr_gtf(a: Column, key: str) -> Column:
    """Value of ``key`` in a GTF attribute string, quoted or bare; empty as null."""
    got = F.regexp_extract(a, rf'(?:^|;)\s*{key}\s+"([^"]*)"', 1)
    got = F.when(got == "", F.trim(F.regexp_extract(a, rf'(?:^|;)\s*{key}\s+([^";]+)', 1))).otherwise(got)
    return F.when(got != "", got)


def sub_class(kind: Column) -> Column:
    """Class of a sub-feature type: CDS, UTR5, UTR3, UTR or exon."""
    k = F.lower(kind)
    return (
        F.when(k.isin("cds"), "CDS")
        .when(k.isin("five_prime_utr", "5utr", "5'utr", "utr5", "five_prime_untranslated_region"), "UTR5")
        .when(k.isin("three_prime_utr", "3utr", "3'utr", "utr3", "three_prime_untranslated_region"), "UTR3")
        .when(k.isin("utr", "untranslated_region"), "UTR")
        .otherwise("exon")
    )
