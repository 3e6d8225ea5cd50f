"""Genotypes from VCF and HapMap text: a DataFrame of variants and one of calls.

variants: v, id, chr, pos, ref, alt, multiallelic, is_snp. calls: v, chr, pos, smp, sample, dos, h1, h2.
``v`` numbers lines in file order, with gaps. Missing calls are null, never 0. Filters on chromosome
and position apply before calls are exploded. A block-compressed VCF is split, and with its index (.tbi) beside it a region
opens only the blocks that may hold it; for repeated region reads of other files write the variants as Parquet by chr, sorted by pos.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.functions.genotype import extract_gt, gt_to_dosage, haplotype, hmp_dosage, hmp_site_type, is_snp, site_type
from genoloom.functions.names import chr_key, normalize_chr
from genoloom.sources.blockgzip import compression, index_of, region_lines
from genoloom.sources.text import fields, head, lines, separator

#: The columns of a VCF before its samples (a fixed format).
VCF_FIXED = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
#: Columns of a HapMap file from rs# to before its samples.
HAPMAP_FIXED = 11


@dataclass
class Genotypes:
    variants: DataFrame
    calls: DataFrame
    samples: list[str]
    source: str

    def summary(self) -> str:
        """Counts and, of each of the first ten chromosomes, the range (one pass over the variants)."""
        spans = self.variants.groupBy("chr").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy(chr_key(F.col("chr"))).collect()
        where = ", ".join(f"chr {r.chr}:{r.a:,}-{r.b:,}" for r in spans[:10]) + (f" and {len(spans) - 10} more" if len(spans) > 10 else "")
        return f"{sum(r.n for r in spans):,} variants x {len(self.samples):,} samples ({self.source})" + (f" on {where}" if spans else "")


def _data(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.col("line").alias("v"), "value")


def region_of(rows: DataFrame, chrom: str | None, start: int | None, end: int | None, chr_map: dict[str, str] | None) -> DataFrame:
    if chrom is not None:
        rows = rows.where(F.col("chr") == normalize_chr(F.lit(chrom), chr_map))
    if start is not None:
        rows = rows.where(F.col("pos") >= start)
    return rows if end is None else rows.where(F.col("pos") <= end)


def _chosen(names: list[str], wanted: list[str] | None, skip: list[str]) -> list[tuple[int, str]]:
    found = [(i, n) for i, n in enumerate(names) if n not in skip]
    if wanted is not None:
        lost = [n for n in wanted if n not in {n for _, n in found}]
        if lost and len(lost) < len(wanted):
            warnings.warn(f"{len(lost)} samples are not in the file: {', '.join(lost[:8])}", stacklevel=3)
        found = [(i, n) for i, n in found if n in set(wanted)]
    if not found:
        raise ValueError("none of the samples is in the file")
    return found


def _calls(rows: DataFrame, chosen: list[tuple[int, str]], first: int, values: dict[str, Column]) -> DataFrame:
    names = F.array(*[F.lit(n) for _, n in chosen])
    texts = F.transform(F.array(*[F.lit(first + i) for i, _ in chosen]), lambda i: F.trim(F.get("f", i)))
    long = rows.select("v", "chr", "pos", "aux", F.posexplode(texts).alias("smp", "call"))
    return long.select("v", "chr", "pos", "smp", F.get(names, F.col("smp")).alias("sample"), *[c.alias(n) for n, c in values.items()])


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a VCF."""
    found = lines(spark, path).where(F.col("value").startswith("#CHROM")).select("value").head(1)
    if not found:
        raise ValueError(f"{path} has no #CHROM line")
    return found[0].value.split("\t")


def _region_data(spark: SparkSession, path: str, chrom: str | None, start: int | None, end: int | None, chr_map: dict[str, str] | None) -> DataFrame:
    """Data lines of a VCF: of a region, where the file has an index, only those of the blocks that it lists."""
    if chrom is None or compression(path) != "blocks":
        return _data(spark, path)
    index = index_of(path)
    if index is None:
        return _data(spark, path)
    known = spark.createDataFrame([(n,) for n in index.names], "name string").withColumn("chr", normalize_chr(F.col("name"), chr_map))
    names = [r.name for r in known.where(F.col("chr") == normalize_chr(F.lit(chrom), chr_map)).collect()]
    if not names:
        raise ValueError(f"{chrom} is not in the index of {path}; it has {', '.join(index.names[:20])}")
    found = region_lines(spark, path, index, names, start, end)
    return found.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.col("line").alias("v"), "value")


def read_vcf(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, samples: list[str] | None = None, chr_map: dict[str, str] | None = None) -> Genotypes:
    names = vcf_header(spark, path)[len(VCF_FIXED) :]
    chosen = _chosen(names, samples, VCF_FIXED)
    at = lambda i: F.get("f", F.lit(i))
    rows = _region_data(spark, path, chrom, start, end, chr_map).select("v", F.split("value", "\t").alias("f"))
    rows = rows.select("v", "f", normalize_chr(at(0), chr_map).alias("chr"), at(1).try_cast("long").alias("pos"), at(8).alias("aux"))
    rows = region_of(rows.where("pos IS NOT NULL"), chrom, start, end, chr_map)
    ident = F.when(at(2).isin(".", ""), F.concat_ws(":", "chr", "pos")).otherwise(at(2))
    variants = rows.select("v", ident.alias("id"), "chr", "pos", at(3).alias("ref"), at(4).alias("alt"), at(4).contains(",").alias("multiallelic"), is_snp(at(3), at(4)).alias("is_snp"))
    gt = extract_gt(F.col("call"), F.col("aux"))
    calls = _calls(rows, chosen, len(VCF_FIXED), {"dos": gt_to_dosage(gt), "h1": haplotype(gt, 1), "h2": haplotype(gt, 2)})
    return Genotypes(variants, calls, [n for _, n in chosen], "vcf")


def hapmap_layout(header: str) -> tuple[str, int, int, list[str]]:
    """(separator, column of rs#, first sample's column, sample names)."""
    sep = separator(header)
    names = [n.strip().strip('"') for n in (header.split() if sep == " " else header.split(sep))]
    rs = next((i for i, n in enumerate(names) if re.fullmatch("rs#?", n.lower())), None)
    if rs is None or len(names) <= rs + HAPMAP_FIXED:
        raise ValueError("not a HapMap header")
    lower = [n.lower() for n in names]
    first = lower.index("qccode") + 1 if "qccode" in lower[rs + 1 :] else rs + HAPMAP_FIXED
    return sep, rs, first, names[first:]


def hapmap_rows(spark: SparkSession, path: str, chr_map: dict[str, str] | None = None) -> tuple[DataFrame, int, list[str]]:
    """(v, f, id, chr, pos, aux: alleles), column of the first sample, sample names."""
    header = head(spark, path)[0]
    sep, rs, first, names = hapmap_layout(header)
    at = lambda i: F.trim(F.get("f", F.lit(rs + i)))
    value = F.col("value") if sep == "\t" else F.replace("value", F.lit('"'), F.lit(""))
    rows = _data(spark, path).where(F.col("value") != header).select("v", fields(value, sep).alias("f"))
    rows = rows.select("v", "f", at(0).alias("id"), normalize_chr(at(2), chr_map).alias("chr"), at(3).try_cast("long").alias("pos"), F.upper(at(1)).alias("aux"))
    return rows.where("pos IS NOT NULL"), first, names


def read_hapmap(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, samples: list[str] | None = None, chr_map: dict[str, str] | None = None) -> Genotypes:
    rows, first, names = hapmap_rows(spark, path, chr_map)
    chosen = _chosen(names, samples, [])
    rows = region_of(rows, chrom, start, end, chr_map)
    alleles = F.split("aux", "/")
    ident = F.when(F.col("id").isin(".", "", "NA"), F.concat_ws(":", "chr", "pos")).otherwise(F.col("id"))
    variants = rows.select("v", ident.alias("id"), "chr", "pos", F.get(alleles, F.lit(0)).alias("ref"), F.get(alleles, F.lit(1)).alias("alt"),
                           (F.size(alleles) > 2).alias("multiallelic"), F.forall(alleles, lambda a: a.isin("A", "C", "G", "T")).alias("is_snp"))
    none = F.lit(None).cast("int")
    calls = _calls(rows, chosen, first, {"dos": hmp_dosage(F.upper("call"), F.col("aux")), "h1": none, "h2": none})
    return Genotypes(variants, calls, [n for _, n in chosen], "hapmap")


def variant_sites(spark: SparkSession, path: str, chr_map: dict[str, str] | None = None) -> DataFrame:
    """chr, pos, type (SNP, indel, other) of the sites of a VCF or HapMap file; of its columns only the fixed ones are told apart, no sample's."""
    first = head(spark, path)[0]
    if first.startswith("##") or first.startswith("#CHROM"):
        at = lambda i: F.get("f", F.lit(i))
        rows = _data(spark, path).select(F.split("value", "\t", 6).alias("f"))
        rows = rows.select(normalize_chr(at(0), chr_map).alias("chr"), at(1).try_cast("long").alias("pos"), site_type(at(3), at(4)).alias("type"))
    else:
        rows = hapmap_rows(spark, path, chr_map)[0].select("chr", "pos", hmp_site_type(F.col("aux")).alias("type"))
    return rows.where("pos IS NOT NULL AND chr IS NOT NULL")


def as_genotypes(spark: SparkSession, dosage: Sequence[Sequence[float | None]], chrom: str | Sequence[str], pos: Sequence[int], ids: Sequence[str] | None = None,
                 ref: str | None = None, alt: str | None = None, samples: Sequence[str] | None = None) -> Genotypes:
    """Genotypes of a small matrix in memory, a row a variant: dosages 0 to 2, None or nan where missing; ids are chr:pos and samples sample1, ... by default."""
    if len(pos) != len(dosage):
        raise ValueError("pos must have one value for each row of dosage")
    clean = [[None if x is None or x != x else float(x) for x in row] for row in dosage]
    names = list(samples) if samples is not None else [f"sample{k + 1}" for k in range(len(clean[0]) if clean else 0)]
    if any(len(row) != len(names) for row in clean):
        raise ValueError("a row of dosage must have one value for each sample")
    chroms = [chrom] * len(pos) if isinstance(chrom, str) else list(chrom)
    table = [(v, None if ids is None else ids[v], chroms[v], int(pos[v]), clean[v]) for v in range(len(pos))]
    rows = spark.createDataFrame(table, "v long, id string, chr string, pos long, d array<double>").withColumn("chr", normalize_chr(F.col("chr")))
    variants = rows.select("v", F.coalesce("id", F.concat_ws(":", "chr", "pos")).alias("id"), "chr", "pos", F.lit(ref).cast("string").alias("ref"), F.lit(alt).cast("string").alias("alt"), F.lit(False).alias("multiallelic"), F.lit(True).alias("is_snp"))
    long = rows.select("v", "chr", "pos", F.posexplode("d").alias("smp", "dos"))
    none = F.lit(None).cast("int")
    calls = long.select("v", "chr", "pos", "smp", F.get(F.array(*map(F.lit, names)), F.col("smp")).alias("sample"), "dos", none.alias("h1"), none.alias("h2"))
    return Genotypes(variants, calls, names, "matrix")


def unsorted(rows: DataFrame) -> DataFrame:
    """chr of the chromosomes some of whose positions are less than that of the row of theirs before, by ``v``; no rows if all are in order."""
    before = F.lag("pos").over(Window.partitionBy("chr").orderBy("v"))
    return rows.withColumn("_before", before).where("pos < _before").select("chr").distinct()


def read_genotypes(spark: SparkSession, path: str | Genotypes, **how) -> Genotypes:
    """By extension, else by the first line."""
    if isinstance(path, Genotypes):
        return path
    name = path.lower()
    if re.search(r"\.vcf(\.(gz|bgz|bz2|xz))?$", name):
        return read_vcf(spark, path, **how)
    if re.search(r"\.hmp(\.(txt|csv))?(\.(gz|bz2|xz))?$", name):
        return read_hapmap(spark, path, **how)
    first = head(spark, path)[0]
    if first.startswith("##fileformat=VCF") or first.startswith("#CHROM"):
        return read_vcf(spark, path, **how)
    if {"rs#", "rs"} & set(re.split(r"[\t,;]", first.lower().replace('"', ""))[:2]):
        return read_hapmap(spark, path, **how)
    raise ValueError(f"{path} is neither VCF nor HapMap")
