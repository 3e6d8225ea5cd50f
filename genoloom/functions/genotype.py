"""Genotype calls and alleles as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heterozygous nucleotide codes (fixed values).
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}


def extract_gt(call: Column, fmt: Column) -> Column:
    """The GT sub-field of a sample's call; '.' where it is missing. A format without GT is an error."""
    at = F.array_position(F.split(fmt, ":"), "GT").cast("int")
    lost = F.raise_error(F.concat(F.lit("a VCF record has no GT in its FORMAT: "), F.coalesce(fmt, F.lit("none")))).cast("string")
    return F.when(at > 0, F.coalesce(F.try_element_at(F.split(call, ":"), at), F.lit("."))).otherwise(lost)


def gt_to_dosage(gt: Column) -> Column:
    """2 * (alleles other than the reference) / ploidy; null where any allele is missing."""
    alleles = F.split(gt, r"[/|]")
    other = F.size(F.filter(alleles, lambda a: a != "0"))
    return F.when(~F.exists(alleles, lambda a: (a == ".") | (a == "")), other * 2.0 / F.size(alleles))


def haplotype(gt: Column, k: int) -> Column:
    """Whether allele ``k`` (1 or 2) of a phased diploid genotype is not the reference."""
    parts = F.split(gt, r"\|")
    return F.when(gt.rlike(r"^[0-9]+\|[0-9]+$"), (F.element_at(parts, k) != "0").cast("int"))


def _het(call: Column) -> Column:
    return F.coalesce(*[F.when(call == k, F.lit(v)) for k, v in IUPAC.items()])


def hmp_dosage(call: Column, alleles: Column) -> Column:
    """Copies of the second of ``alleles`` ('A/G') in a one- or two-letter HapMap call."""
    call, ref, alt = F.upper(call), F.upper(F.split_part(alleles, F.lit("/"), F.lit(1))), F.upper(F.split_part(alleles, F.lit("/"), F.lit(2)))
    pair = F.concat(F.least(ref, alt), F.greatest(ref, alt))
    indel = ref.isin("+", "-") & alt.isin("+", "-")
    one = F.when(call == ref, 0.0).when(call == alt, 2.0).when(_het(call) == pair, 1.0).when((call == "0") & indel, 1.0)
    a, b = F.substring(call, 1, 1), F.substring(call, 2, 1)
    known = (ref != "") & (alt != "")
    a_ok = lambda x: (x == ref) | (x == alt)
    two = F.when(a_ok(a) & a_ok(b), (a == alt).cast("double") + (b == alt).cast("double"))
    return F.when(known, F.when(F.length(call) == 1, one).when(F.length(call) == 2, two))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row: what a lambda names from outside, or a body names twice, may be computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _every(alleles: Column) -> Column:
    return F.filter(F.split(F.upper(alleles), "/"), lambda a: a != "")


def _gt(call: Column, every: Column) -> Column:
    place = lambda x: F.nullif(F.array_position(every, x), F.lit(0)) - 1
    pair = F.coalesce(_het(call), F.when(F.length(call) == 1, F.concat(call, call)).when(F.length(call) == 2, call))
    pair = F.when((call == "0") & F.array_contains(every, "+") & F.array_contains(every, "-"), "+-").otherwise(pair)
    places = _let(pair, lambda p: F.array(place(F.substring(p, 1, 1)), place(F.substring(p, 2, 1))))
    text = lambda x: F.concat(F.array_min(x).cast("string"), F.lit("/"), F.array_max(x).cast("string"))
    return _let(places, lambda x: F.when(F.get(x, F.lit(0)).isNotNull() & F.get(x, F.lit(1)).isNotNull(), text(x)).otherwise("./."))


def hmp_to_gt(call: Column, alleles: Column) -> Column:
    """'a/b' of places among all ``alleles`` ('A/C/T'), the smaller first; './.' where a base is missing or none of them."""
    return F.coalesce(_let(_every(alleles), lambda every: _gt(F.upper(call), every)), F.lit("./."))


def hmp_to_gts(calls: Column, alleles: Column) -> Column:
    """:func:`hmp_to_gt` of each of a row's calls (an array of upper case without nulls): told once for each different call, of which a row has few."""

    def told(row: Column) -> Column:
        few = F.array_distinct(row["calls"])
        return _let(_let(few, lambda k: F.map_from_arrays(k, F.transform(k, lambda c: _gt(c, row["every"])))), lambda known: F.transform(row["calls"], lambda c: F.coalesce(F.try_element_at(known, c), F.lit("./."))))

    return _let(F.struct(calls.alias("calls"), _every(alleles).alias("every")), told)


def allele_label(ref: Column, alt: Column) -> Column:
    """'A/T'; longer alleles lose a common first base, and an empty one reads '-'."""
    every = F.concat(F.array(ref), F.split(alt, ","))
    cut = F.exists(every, lambda a: F.length(a) > 1) & F.forall(every, lambda a: F.substring(a, 1, 1) == F.substring(ref, 1, 1))
    trimmed = F.transform(every, lambda a: F.when(F.length(a) > 1, F.substring(a, 2, 1 << 20)).otherwise("-"))
    missing = ref.isNull() | alt.isNull() | (ref == ".") | (alt == ".")
    return F.when(~missing, F.array_join(F.when(cut, trimmed).otherwise(every), "/"))


def is_snp(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & alt.rlike(r"^[ACGTacgt](,[ACGTacgt])*$")


def site_type(ref: Column, alt: Column) -> Column:
    """SNP, indel or other of a VCF site."""
    alts = F.split(F.upper(alt), ",")
    snp = F.upper(ref).rlike("^[ACGT]$") & F.forall(alts, lambda a: a.rlike(r"^[ACGT*]$")) & F.exists(alts, lambda a: a != "*")
    # only the symbols themselves and plain alleles of another length; breakends and other symbols are neither
    indel = F.exists(alts, lambda a: a.isin("<INS>", "<DEL>", "<INDEL>", "*") | (a.rlike("^[ACGTN]+$") & (F.length(a) != F.length(ref))))
    return F.when(snp, "SNP").when(indel, "indel").otherwise("other")


def hmp_site_type(alleles: Column) -> Column:
    """SNP, indel or other of HapMap alleles ('A/G')."""
    every = F.split(F.upper(alleles), "/")
    snp = (F.size(every) >= 2) & F.forall(every, lambda a: a.rlike("^[ACGT]$"))
    lengths = F.array_distinct(F.transform(every, lambda a: F.length(a)))
    indel = F.exists(every, lambda a: a.isin("+", "-", "0")) | (F.forall(every, lambda a: a.rlike("^[ACGT]+$")) & (F.size(lengths) > 1))
    return F.when(snp, "SNP").when(indel, "indel").otherwise("other")


def r2_bin(r2: Column) -> Column:
    """Colour class of r2: right-closed steps of 0.2."""
    return F.when(r2.isNull(), "no LD data").when(r2 <= 0.2, "0-0.2").when(r2 <= 0.4, "0.2-0.4").when(r2 <= 0.6, "0.4-0.6").when(r2 <= 0.8, "0.6-0.8").otherwise("0.8-1")
