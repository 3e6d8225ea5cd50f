"""Genotypes as Parquet by chromosome, sorted by position: a region read opens one folder and few row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.names import normalize_chr
from genoloom.operators.gwas import thin_every
from genoloom.sources.genotypes import Genotypes


def write_genotypes(g: Genotypes, path: str, rows_a_file: int = 5_000_000) -> None:
    """variants, calls and samples of ``g`` below ``path``. Ranges of (chr, pos) are files, so one large chromosome is many."""
    for name, rows in (("variants", g.variants), ("calls", g.calls)):
        ordered = rows.where("chr IS NOT NULL").repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos", "v")
        ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("chr").parquet(f"{path}/{name}")
    spark = g.calls.sparkSession
    spark.createDataFrame(list(enumerate(g.samples)), "smp int, sample string").coalesce(1).write.mode("overwrite").parquet(f"{path}/samples")


def read_stored(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, samples: list[str] | None = None, every: int = 1) -> Genotypes:
    """What :func:`write_genotypes` wrote, of a region, of some samples, of every ``every``-th variant of a chromosome by position.

    Filters on chr, pos and samples reach the scan. Without any of ``samples`` in the store: an error.
    """
    names = {r["sample"]: r.smp for r in spark.read.parquet(f"{path}/samples").collect()}
    keep = [n for n in names if samples is None or n in set(samples)]
    if not keep:
        raise ValueError("none of the samples is in the store")
    parts = []
    for name in ("variants", "calls"):
        rows = spark.read.option("basePath", f"{path}/{name}").schema(_schema(spark, f"{path}/{name}")).parquet(f"{path}/{name}")
        if chrom is not None:
            rows = rows.where(F.col("chr") == spark.range(1).select(normalize_chr(F.lit(chrom))).first()[0])
        if start is not None:
            rows = rows.where(F.col("pos") >= start)
        parts.append(rows if end is None else rows.where(F.col("pos") <= end))
    variants, calls = parts
    if samples is not None:
        calls = calls.where(F.col("smp").isin([names[n] for n in keep]))
    if every > 1:
        variants = thinned(variants, every)
        calls = calls.join(variants.select("v"), "v", "left_semi")
    return Genotypes(variants, calls, keep, "store")


def thinned(variants: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th variant of each chromosome by position."""
    return thin_every(variants, ["pos", "v"], every, "chr")


def _schema(spark: SparkSession, path: str) -> str:
    """The stored columns with chr as text: names of folders such as 1 would be read as numbers."""
    found = spark.read.parquet(path).schema
    return ", ".join(f"`{f.name}` {'string' if f.name == 'chr' else f.dataType.simpleString()}" for f in found)
