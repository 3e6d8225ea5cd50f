"""Interval joins: points in intervals by bins, nearest intervals as of a window, unions of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, width: int = 100_000, key: str = "chr", pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs with start <= pos <= end: intervals are repeated for each bin they touch, and bins join by equality.

    Scales with bins instead of comparing all pairs of a chromosome; Catalyst broadcasts the interval side where it is small.
    """
    spread = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = points.withColumn("_bin", F.floor(F.col(pos) / width))
    return placed.join(spread, [key, "_bin"]).where(F.col(pos).between(F.col(start), F.col(end))).drop("_bin")


def overlapping(intervals: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Intervals that touch chrom:start-end; literals reach the scan."""
    return intervals.where((F.col("chr") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))


def overlap_join(regions: DataFrame, intervals: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(region columns with r_ names, interval columns) of each overlapping pair once: at the first bin both touch."""
    a = regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("r_start") / width), F.floor(F.col("r_end") / width)))).withColumnRenamed("r_chr", "chr")
    b = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    hit = a.join(b, ["chr", "_bin"]).where((F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")))
    return hit.where(F.col("_bin") == F.floor(F.greatest("start", "r_start") / width)).drop("_bin")


def nearest(points: DataFrame, intervals: DataFrame, name: str = "gene_id", bucket: int = 5_000_000, carry: str | None = None, bins: DataFrame | None = None) -> DataFrame:
    """Per point outside all intervals: the nearest end before or start after it, the left one on ties.

    ``carry`` names a column of the intervals to bring along (as near_ and its name); ``bins``, a cheaper
    frame with the chr and pos of all points, if ``points`` is costly to plan twice.

    Points and edges are one ordered stream per (chr, bucket); a bucket's last end before it and
    first start after it come from bucket aggregates, so no chromosome passes through one task.
    """
    none = F.lit(None).cast("string")
    bin_of = F.floor(F.col("_at") / bucket).alias("_b")
    more = F.col(carry).cast("string") if carry else none
    edges = intervals.select("chr", F.explode(F.array(F.struct(F.col("end").cast("long").alias("_at"), F.lit(1).alias("_kind")), F.struct(F.col("start").cast("long").alias("_at"), F.lit(2).alias("_kind")))).alias("e"), F.col(name).alias("_id"), more.alias("_more"))
    edges = edges.select("chr", "e._at", "e._kind", "_id", "_more").withColumn("_b", bin_of)
    p = points.select("*", F.col("pos").cast("long").alias("_at"), F.lit(0).alias("_kind"), none.alias("_id"), none.alias("_more")).withColumn("_b", bin_of)
    cols = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "chr" else F.col("chr") for f in points.schema]
    every = p.unionByName(edges.select(*cols, "_at", "_kind", "_id", "_more", "_b"))
    at = F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"), F.col("_more").alias("more"))
    left, right = F.when(F.col("_kind") == 1, at), F.when(F.col("_kind") == 2, at)
    # what follows is taken in falling order: a frame that grows is kept up, one that shrinks is summed anew for every row
    low, high = Window.partitionBy("chr").orderBy("_b"), Window.partitionBy("chr").orderBy(F.desc("_b"))
    places = (points if bins is None else bins).select("chr", F.floor(F.col("pos") / bucket).alias("_b")).distinct()  # few: the extremes below sort their rows
    edge = edges.unionByName(places, allowMissingColumns=True).groupBy("chr", "_b").agg(F.max(left).alias("m"), F.min(right).alias("n"))
    edge = edge.select("chr", "_b", F.max("m").over(low.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("n").over(high.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    here, back = (Window.partitionBy("chr", "_b").orderBy(at) for at in (F.col("_at"), -F.col("_at")))
    seen = every.withColumns({
        "_m": F.max(left).over(here.rangeBetween(Window.unboundedPreceding, -1)),
        "_n": F.min(right).over(back.rangeBetween(Window.unboundedPreceding, -1)),
    }).where("_kind = 0").join(edge, ["chr", "_b"])
    m, n = F.coalesce("_m", "_before"), F.coalesce("_n", "_after")
    seen = seen.withColumns({"_m": m, "_n": n}).withColumns({"_dl": F.col("pos") - F.col("_m.at"), "_dr": F.col("_n.at") - F.col("pos")})
    take_left = F.col("_dl").isNotNull() & (F.col("_dr").isNull() | (F.col("_dl") <= F.col("_dr")))
    return seen.select(*points.columns, F.when(take_left, F.col("_m.id")).otherwise(F.col("_n.id")).alias("near_gene"), F.least("_dl", "_dr").alias("near_distance"), *([F.when(take_left, F.col("_m.more")).otherwise(F.col("_n.more")).alias(f"near_{carry}")] if carry else []))


def merge(intervals: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Unions of overlapping or adjacent intervals of each key.

    All windows share one sort: a union's first row meets its last as the next row that begins or ends one, so nothing is grouped.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    before, upto = (F.max(end).over(w.rowsBetween(Window.unboundedPreceding, k)) for k in (-1, 0))
    rows = intervals.select(key, start, end).withColumns({"_before": before, "_upto": upto, "_next": F.lead(F.struct(start)).over(w)})
    rows = rows.withColumns({"_first": F.coalesce(F.col(start) > F.col("_before") + 1, F.lit(True)), "_last": F.coalesce(F.col(f"_next.{start}") > F.col("_upto") + 1, F.lit(True))}).where("_first OR _last")
    # of a union of one row that row is both
    reach = F.when(F.col("_last"), F.col("_upto")).otherwise(F.lead("_upto").over(w))
    rows = rows.withColumn("_reach", reach).where("_first")
    return rows.select(key, start, F.col("_reach").alias(end))
