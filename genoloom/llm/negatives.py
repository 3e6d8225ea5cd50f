"""Hard-negative mining by blocked dense products.

Anchors are dealt into blocks of at most ``block_bytes`` bytes. Each block is broadcast; every task runs over its part of all rows in
batches, takes the float64 product of anchors and rows, and keeps what may still be among an anchor's first rows. Those short lists merge
by ranking in Spark. The first pass finds an anchor's positives (same label), the second its negatives, within a window of scores for each positive.
Work grows as anchors times rows, which the task asks for (a stated query set against all rows); memory does not, and no list
grows with the rows: a task sends ``n_positives`` + 1 or ``n_negatives`` rows an anchor or pair, whatever it has read.

Rows with a null id, label, vector or component, or with a component that is not finite, take no part. Vectors of other lengths count as
padded with zeros. Scores are exact while they and their partial sums stay below 2^53; beyond that they are the nearest doubles, and they end at the
limits of long. Rows that share an id count as rows of their own: an anchor passes over itself once (one row of its id and of its own score, which
its copies can't be told from in the result), and anchors that share an id give rows each. Ties go by smaller id. Columns beside
``vec_id``, ``embedding`` and ``label`` are not read. An empty table, one without anchors, or a single label gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, materialize, trim

ROWS = 2048  # rows of one product
ANCHORS = 512  # anchors of one product
LIMIT = float((1 << 63) - 1024)  # largest double within long


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows that take part."""
    finite = F.forall("embedding", lambda x: F.abs(x) < F.lit(float("inf")))
    return rows.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of the vectors as rows of doubles, shorter ones padded with zeros."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    wide = int(sizes.max(initial=0))
    if len(sizes) * wide == len(flat):
        full = flat.reshape(len(sizes), wide)
    else:
        full = np.zeros((len(sizes), wide))
        full[np.arange(wide) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * full), -1e150, 1e150)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = min(a.shape[1], b.shape[1])
    return np.clip(a[:, :d] @ b[:, :d].T, -LIMIT, LIMIT)


def _merged(held: np.ndarray, ids: np.ndarray, scores: np.ndarray, new: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` of (score, id) lists along the last axis: higher scores first, then smaller ids."""
    ids, scores = np.concatenate((held, ids), -1), np.concatenate((scores, new), -1)
    order = np.lexsort((ids, -scores), axis=-1)[..., :most]
    return np.take_along_axis(ids, order, -1), np.take_along_axis(scores, order, -1)


class _Top:
    """The first ``most`` rows of each of n lists by score, then id; -inf where there are fewer."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.ids, self.scores = most, np.zeros((n, most), np.int64), np.full((n, most), -np.inf)

    def add(self, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.ids[lists], self.scores[lists] = _merged(self.ids[lists], ids, self.scores[lists], scores, self.most)

    def batch(self, first: int = 0) -> pa.RecordBatch:
        n, k = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(n + first, pa.int64()), pa.array(self.ids[n, k]), pa.array(self.scores[n, k].astype(np.int64))], ["k", "id", "score"])


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of at most ROWS rows, sorted by id, so that a stable sort by score leaves ties in order."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            part = whole.slice(at, ROWS)
            ids = part.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column("label").to_numpy()[order], matrix(part.column("embedding"), scale)[order]


def _first(block, most: int, scale: float):
    """Per anchor its first ``most`` rows of the same label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, vectors, _ = block.value
        top = _Top(len(labels), most)
        for ids, other, rows in _blocks(batches, scale):
            for label in np.unique(other):  # a label's anchors meet its rows only
                mine, own = np.flatnonzero(labels == label), np.flatnonzero(other == label)
                for at in range(0, len(mine), ANCHORS):
                    some = mine[at : at + ANCHORS]
                    scores = product(vectors[some], rows[own])
                    order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                    top.add(some, ids[own][order], np.take_along_axis(scores, order, 1))
        yield top.batch()
        trim()

    return run


def _windowed(block, pairs, most: int, low: int, high: int, scale: float):
    """Per pair (anchor, positive score) its first ``most`` rows of other labels with low * p <= 100 * score <= high * p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, vectors, _ = block.value
        anchor, goal = pairs.value  # by anchor; goal: the positives' scores
        # integer bounds, by exact division: ceil(low * p / 100) and floor(high * p / 100)
        least = np.array([-(-low * int(p) // 100) for p in goal], np.float64)
        highest = np.array([high * int(p) // 100 for p in goal], np.float64)
        top = _Top(len(anchor), most)
        start = np.searchsorted(anchor, np.arange(len(labels) + 1))
        for ids, other, rows in _blocks(batches, scale):
            for at in range(0, len(labels), ANCHORS):
                some = np.arange(at, min(len(labels), at + ANCHORS))
                some = some[start[some + 1] > start[some]]
                if not len(some):
                    continue
                scores = product(vectors[some], rows)
                scores[labels[some][:, None] == other] = -np.inf
                order = np.argsort(-scores, axis=1, kind="stable")
                scores = np.take_along_axis(scores, order, 1)
                for i, a in enumerate(some):
                    own = np.arange(start[a], start[a + 1])
                    begin = np.searchsorted(-scores[i], -highest[own], side="left")
                    take = begin[:, None] + np.arange(most)
                    inside = take < scores.shape[1]
                    take = np.where(inside, take, 0)
                    got = np.where(inside & (scores[i][take] >= least[own][:, None]), scores[i][take], -np.inf)
                    some_new = got[:, 0] > np.minimum(top.scores[own, -1], LIMIT) - 1
                    if some_new.any():
                        top.add(own[some_new], ids[order[i][take]][some_new], got[some_new])
        yield top.batch()
        trim()

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each list k by score, then id, with their rank from 1."""
    order = Window.partitionBy("k").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block_bytes: int = 16 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` for ``anchors``, both as :func:`usable` gives them.

    Each block of anchors is read twice against all rows: for positives, then for negatives. A block's anchors and its pairs come to the driver,
    ``block_bytes`` at most (64 pairs' bytes an anchor counted), before the next block's do.
    """
    spark = rows.sparkSession
    rows = bounded_batches(rows)
    held = materialize(anchors.withColumn("u", F.monotonically_increasing_id()), "anchors")
    n, wide = held.agg(F.count("*"), F.max(F.size("embedding"))).first()
    each = 8 * (wide or 0) + 64 * n_positives
    blocks = max(1, -(-2 * n * each // block_bytes))
    done = None
    for k in range(blocks):
        # by a hash of numbers stored with the rows, so that no id's copies fill one block; a count far from its mean is dealt again below
        own = held.where(F.pmod(F.xxhash64("u"), F.lit(blocks)) == k).toArrow().combine_chunks()
        for at in range(0, max(1, own.num_rows), max(1, block_bytes // each)):
            some = own.slice(at, max(1, block_bytes // each)).combine_chunks()
            if not some.num_rows:
                continue
            vectors = matrix(some.column("embedding").combine_chunks(), scale)
            ids, labels = some.column("vec_id").to_numpy(), some.column("label").to_numpy()
            self_score = np.clip(np.einsum("ij,ij->i", vectors, vectors), -LIMIT, LIMIT).astype(np.int64)
            block = spark.sparkContext.broadcast((ids, labels, vectors, self_score))
            near = _ranked(rows.mapInArrow(_first(block, n_positives + 1, scale), "k long, id long, score long"), n_positives + 1)
            near = near.select("k", "id", "score", "rank").toArrow()
            pairs = _positives(ids, self_score, near, n_positives)
            sent = spark.sparkContext.broadcast((pairs["k"], pairs["score"]))
            found = _ranked(rows.mapInArrow(_windowed(block, sent, n_negatives, low, high, scale), "k long, id long, score long"), n_negatives)
            named = pa.table({"k": pa.array(np.arange(len(pairs["k"]))), "anchor_id": ids[pairs["k"]], "positive_id": pairs["id"], "positive_score": pairs["score"]})
            out = found.join(F.broadcast(spark.createDataFrame(named)), "k")
            out = out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out = materialize(out, "negatives")
            done = out if done is None else done.unionByName(out)
            block.unpersist()
            sent.unpersist()
    return done if done is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _positives(ids: np.ndarray, self_score: np.ndarray, near: pa.Table, most: int) -> dict[str, np.ndarray]:
    """The pairs of ``near`` (k, id, score, rank) by anchor and rank, without one row of the anchor's own id and score, ``most`` an anchor."""
    k, other, score, rank = (near.column(c).to_numpy() for c in ("k", "id", "score", "rank"))
    order = np.lexsort((rank, k))
    k, other, score = k[order].astype(np.int64), other[order], score[order]
    mine = (other == ids[k]) & (score == self_score[k]) if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(mine)
    drop = at[np.unique(k[at], return_index=True)[1]]
    keep = np.setdiff1d(np.arange(len(k)), drop)
    k, other, score = k[keep], other[keep], score[keep]
    place = np.arange(len(k)) - np.searchsorted(k, k)
    return {"k": k[place < most], "id": other[place < most], "score": score[place < most]}


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


#: The query's rows in DuckDB's SQL.
ORACLE_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
