"""Variant density along chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def density(sites: DataFrame, sizes: DataFrame, width: int = 1_000_000) -> DataFrame:
    """chr, bin_start, bin_end, snp, indel, other, total of every bin, empty ones too."""
    n = F.greatest(F.ceil(F.col("length") / width), F.lit(1)).cast("long")
    bins = sizes.select("chr", "length", n.alias("nb")).withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("nb"))))
    at = sites.join(sizes.select("chr", n.alias("nb")), "chr").withColumn("bin", F.least("nb", F.floor((F.col("pos") - 1) / width) + 1))
    counts = at.groupBy("chr", "bin").agg(*[F.count_if(F.col("type") == t).alias(a) for t, a in (("SNP", "snp"), ("indel", "indel"), ("other", "other"))], F.count("*").alias("total"))
    full = bins.join(counts, ["chr", "bin"], "left")
    return full.select("chr", ((F.col("bin") - 1) * width + 1).alias("bin_start"), F.least(F.col("bin") * width, "length").alias("bin_end"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("snp", "indel", "other", "total")])


def cap(dens: DataFrame, share: float = 0.99) -> DataFrame:
    """The quantile of non-empty bins' totals that colours stop at, 1 at least."""
    return dens.where("total > 0").agg(F.greatest(F.percentile("total", F.lit(share)), F.lit(1.0)).alias("cap"))


def ramp(value, most, colour: str):
    """White to ``colour`` ('RRGGBB') by value / most, as '#RRGGBB'."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / most))
    parts = [F.lpad(F.hex(F.round(255 + (int(colour[k : k + 2], 16) - 255) * f).cast("long")), 2, "0") for k in (0, 2, 4)]
    return F.concat(F.lit("#"), *parts)
