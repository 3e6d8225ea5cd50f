"""Mixing sources to target weights, in DataFrame and SQL expressions only.

Every source's words are one stream, packed into blocks of ``block`` words. A source's target is
spent in slots: whole epochs over its blocks and a last, partial epoch, whose final slot is cut so
that the words taken equal the rounded target. How many of a source's slots each output shard gets is one multinomial draw
(every slot chooses by a hash, choices are counted by source and shard); the shards' counts, laid end to end, are the slots. Slot j of a source
maps through the permutation of its epoch (swap-or-not rounds over xxhash64) to a block index, and
blocks join their documents by (source, index). A document's words are summed over the slots of all shards.

Null text has size 0. Null source is a source of its own, last in order. Documents of size 0 take 0, and so does a source without words, whose target is 0.
Null or repeated ids and repeated rows count as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.llm.common import broadcast_if_small, documents, materialize, plain, row_hash

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(src, source_size) with weight and target: shares of the total by weights 1, 2, 3, repeating, none above ``most`` times its size.

    Capping and resharing by weight ends at one level per unit of weight, the largest of
    (total - caps before) / (weights from here on) along sources ordered by cap per weight.
    The windows run over one row a source.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy("src")) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return leveled.select("src", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _permuted(x: str, epoch: str, n: str, rounds: int, seed: int, inverse: bool = False) -> str:
    """SQL of the swap-or-not permutation of 0..n-1 for (src, epoch)."""
    span = f"sequence({rounds - 1}, 0, -1)" if inverse else f"sequence(0, {rounds - 1})"
    other = f"pmod(pmod(xxhash64({seed}L, src, {epoch}, r), {n}) - x, {n})"
    return f"aggregate({span}, cast({x} as bigint), (x, r) -> if((xxhash64({seed + 1}L, src, {epoch}, r, greatest(x, {other})) & 1) = 1, {other}, x))"


def _spread(counts: DataFrame) -> DataFrame:
    """``counts`` (first, m, ...) with one row for each j of first..first + m - 1, without m and first.

    A few rows here become the whole mix: they are dealt by explicit counts in runs of 4,096, so that adaptive coalescing doesn't put them in one task.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = counts.withColumn("far", F.explode(F.expr("sequence(0L, (m - 1) div 16777216)")))
    runs = far.withColumn("run", F.explode(F.expr("sequence(far * 4096, least((m - 1) div 4096, far * 4096 + 4095))"))).drop("far").repartition(parts, "src", "run", "first")
    return runs.withColumn("j", F.explode(F.expr("sequence(first + run * 4096, first + least(m, (run + 1) * 4096) - 1)"))).drop("run", "m", "first")


def mix(docs: DataFrame, block: int = 256, n_out: int = 16, most: int = 3, part_rows: int = 1 << 18, rounds: int = 24, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, slots, pieces).

    rows: one per document with doc_id, rh (hash of the row), src, size, source_size, target, taken.
    slots: one per drawn block: shard, src, idx, take (its words from the block's start).
    pieces: which words lo..hi-1 of block (src, idx) are a document's; joined with slots on
    (src, idx) they spell out the mix shard by shard.
    """
    rows = materialize(
        docs.select(
            "doc_id",
            F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("src"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_hash(docs).alias("rh"),
            # rows without id are dealt by a number that is stored with them, so they don't meet in one part
            F.xxhash64("doc_id", "source", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).alias("h"),
        ),
        "mix",
    )
    buckets = max(256, rows.count() // part_rows)  # a source's rows are ordered by parts of part_rows at most, on average
    rows = rows.withColumn("h", F.pmod("h", F.lit(buckets)))
    part = rows.groupBy("src", "h").agg(F.sum("size").alias("n"))
    before = lambda *x: Window.partitionBy("src").orderBy(*x).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("src", "h", F.coalesce(F.sum("n").over(before("h")), F.lit(0)).alias("off"))
    goal = targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), most)
    goal = materialize(goal, "goal")
    own = Window.partitionBy("src", "h").orderBy("doc_id", "size", "rh")
    placed = rows.withColumns({
        "rn": F.row_number().over(own),
        "local": F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }).join(part, ["src", "h"]).withColumn("start", F.col("off") + F.col("local")).join(goal, "src")

    plan = goal.where("source_size > 0").withColumn("source_size", F.expr("nullif(source_size, 0)")).withColumns({
        "n": F.expr(f"cast(ceil(source_size / {block}D) as bigint)"),
        "words": F.expr(f"least(cast(round(target) as bigint), {most} * source_size)"),
    }).withColumns({
        "epochs": F.expr("words div source_size"),
        "rest": F.expr("words % source_size"),
        "last": F.expr(f"source_size - (n - 1) * {block}"),
    })
    # p: where the short last block stands in the last epoch's order
    plan = plan.withColumn("p", F.expr(_permuted("n - 1", "epochs", "n", rounds, seed, inverse=True)))
    plan = plan.withColumn("tail", F.expr(f"""case when rest <= p * {block} then cast(ceil(rest / {block}D) as bigint) when rest <= p * {block} + last then p + 1
        else p + 1 + cast(ceil((rest - p * {block} - last) / {block}D) as bigint) end"""))
    plan = materialize(plan.withColumn("m", F.expr("epochs * n + tail")).where("m > 0"), "plan")  # one row a source
    choices = _spread(plan.select("src", F.lit(0).cast("long").alias("first"), "m"))
    choices = choices.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 2), "src", "j"), F.lit(n_out)).cast("int"))
    counts = materialize(choices.groupBy("src", "shard").agg(F.count("*").alias("m")), "draw")  # n_out rows a source
    before_shard = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    laid = counts.withColumn("first", F.coalesce(F.sum("m").over(before_shard), F.lit(0)))
    slots = _spread(laid).join(plan.drop("m"), "src")
    slots = slots.withColumns({"epoch": F.expr("j div n"), "k": F.expr("j % n")})
    slots = slots.withColumn("idx", F.expr(_permuted("k", "epoch", "n", rounds, seed)))
    slots = slots.withColumn("len", F.expr(f"if(idx = n - 1, last, {block}L)"))
    slots = slots.withColumn("take", F.expr(f"if(epoch < epochs, len, least(len, rest - (k * {block} - if(k > p, {block} - last, 0))))"))
    slots = slots.select("shard", "src", "idx", "take", (F.col("take") >= F.col("len")).alias("whole"))

    pieces = placed.withColumn("idx", F.explode_outer(F.expr(f"if(size > 0, sequence(start div {block}, (start + size - 1) div {block}), cast(null as array<bigint>))")))
    pieces = pieces.withColumns({"lo": F.expr(f"greatest(start - idx * {block}, 0L)"), "hi": F.expr(f"least(start + size - idx * {block}, {block}L)")})
    drawn = slots.groupBy("src", "idx").agg(F.count_if("whole").alias("whole"), F.max(F.when(~F.col("whole"), F.col("take"))).alias("cut"))
    taken = pieces.join(drawn, ["src", "idx"], "left").withColumn("w", F.expr("coalesce(whole, 0) * (hi - lo) + greatest(least(coalesce(cut, 0), hi) - lo, 0L)"))
    out = taken.groupBy("src", "h", "rn", "doc_id", "rh", "size", "source_size", "target").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("taken"))
    return out, slots, pieces


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix has them: each row as many times as the mix takes its words, a fraction rounded up or down by a hash of the row.

    Every row has its own count; rows equal in all columns share theirs evenly. Other columns, whatever their names, are carried.
    """
    rows = mix(docs, **how)[0]
    dice = (F.xxhash64("doc_id", "rh", "src", "h", "rn", F.lit(3)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + dice)).otherwise(0)
    drawn = rows.groupBy(F.col("doc_id").alias("_i"), F.col("rh").alias("_h")).agg(F.sum(copies).alias("_c"), F.count("*").alias("_n")).where("_c > 0")
    drawn = broadcast_if_small(materialize(drawn, "drawn"), 32 << 20)
    own = plain(docs, "doc_id")
    joined = own.withColumn("_r", row_hash(own)).join(drawn, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_r") == F.col("_h")))
    equal = joined.where("_n > 1").withColumn("_e", F.row_number().over(Window.partitionBy("_i", "_h").orderBy(F.lit(0))))
    equal = equal.withColumn("_c", F.expr("_c div _n + if(_e <= _c % _n, 1, 0)")).where("_c > 0").drop("_e")
    each = joined.where("_n = 1").unionByName(equal)
    return each.withColumn("_k", F.explode(F.expr("sequence(1L, cast(_c as bigint))"))).select(*own.columns).toDF(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken")
