"""Sharding of documents by longest-processing-time scheduling (law: ``bytes``).

Groups of equal texts stay together. Groups sorted by size go, largest first, to the least-loaded
shard, kept in a heap. So that the driver's part has a proven bound, only groups larger than
1/``grain`` of all bytes (there are fewer than ``grain``) are items of their own; the others are
packed by hash into ``grain`` buckets first, and each bucket is one item.

Null text: size 1, CRC null, its rows form one group. Empty text: size 1. Repeated rows are rows of
their own in the same shard. Null ids are kept. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.llm.common import documents, materialize


def lpt(sizes: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """Item -> shard for (item, size) pairs: largest first to the least-loaded shard; ties by item, then shard."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard(docs: DataFrame, n_shards: int = 16, grain: int = 16384, part_rows: int = 1 << 18, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` plus size, text_crc32, law, shard, slot and grown_shard.

    Slots are gapless within a shard: counts of (shard, part) give each part its first slot, and only
    the rows of one part are sorted together, so no shard has to pass through one task.
    """
    spark = docs.sparkSession
    base = materialize(
        docs.select(
            *[F.col(c).alias(f"k_{c}") for c in keep],
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.xxhash64("text").alias("g"),
            # rows without id are dealt by a number that is stored with them, so they don't meet in one part
            F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).alias("t"),
        ),
        "shard",
    )
    groups = base.groupBy("g").agg(F.sum("size").alias("b"))
    groups = materialize(groups, "groups")
    total = groups.agg(F.sum("b")).first()[0] or 0
    parts = max(256, -(-base.count() // (part_rows * n_shards)))
    large = F.col("b") * grain > total
    bucket = F.pmod("g", F.lit(grain)).cast("int")
    big = [(r.g, r.b) for r in groups.where(large).collect()]  # fewer than grain rows
    small = [(r.k, r.b) for r in groups.where(~large).groupBy(bucket.alias("k")).agg(F.sum("b").alias("b")).collect()]  # at most grain rows
    placed = lpt([((0, g), b) for g, b in big] + [((1, k), b) for k, b in small], n_shards)
    by_group = spark.createDataFrame([(g, placed[0, g]) for g, _ in big], "g long, s1 int")
    by_bucket = spark.createDataFrame([(k, placed[1, k]) for k, _ in small], "k int, s2 int")
    put = base.withColumn("k", bucket).join(F.broadcast(by_group), "g", "left").join(F.broadcast(by_bucket), "k", "left")
    put = put.withColumn("shard", F.coalesce("s1", "s2")).withColumn("part", F.pmod(F.xxhash64("t", "g"), F.lit(parts)).cast("int"))
    counts = put.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # at most n_shards * parts rows
    put = put.join(F.broadcast(first), ["shard", "part"])
    order = Window.partitionBy("shard", "part").orderBy("t", "g", *[f"k_{c}" for c in keep if c == "doc_id"])
    return put.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
