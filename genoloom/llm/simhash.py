"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values (seed 42) have
it. Fingerprints link at 4 or fewer differing bits; a document's component is the smallest doc_id
reachable.

Candidate keys. The 64 bits are four segments of 16. With 4 errors in all, by the pigeonhole
  (a) two segments are exact,                                 key: both segments; or
  (b) one is exact and, of any two others, one has at most 1, key: the exact one, a codeword index; or
  (c) all four have exactly one error,                        key: codeword indices of segments 0 and 1,
                                                              and a half of segment 2, one of which is exact.
A codeword index is the nearest codeword of the perfect (23, 12) Golay code to the zero-padded
segment. A segment's keys are its own index and those indices of its 1-bit neighbours that are
smaller, so two segments one bit apart always share one. Nothing is sampled or capped, and every
candidate is verified on all 64 bits.

Distinct fingerprints meet by key. Inside one key's run, components grow by comparing the frontier
with what is not yet reached, so a dense group of n near copies costs far less than its pairs and
yields n - 1 links. Runs of over ``most_run`` fingerprints go, by blocks of pairs, to tasks of their own.

Null or wordless texts have fingerprint zero and link like any other. Null ids: a component made of
null ids alone has a null id. Repeated rows share a component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, broadcast_if_small, bytes_of, components, documents, materialize, plain, row_hash

#: Generator of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GOLAY = 0b110001110101


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned fingerprint of UTF-8 bytes."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    if n <= width:
        values = [h(joined, 42)]
    else:
        values = [h(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 16):
        some = np.array(values[i : i + (1 << 16)], np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, width) for t in bytes_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, th: hash of the whole text, fp: fingerprint as a signed long), stored in the shared folder."""
    source = bounded_batches(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(source.mapInArrow(_fingerprints(width), f"doc_id {kind}, th long, fp long"), "fp")


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, indices): each 16-bit segment's codeword indices, as runs of one array."""
    word = np.arange(1 << 23, dtype=np.uint32)
    low = word.copy()
    for bit in range(22, 10, -1):
        low = np.where(low >> bit & 1, low ^ np.uint32(GOLAY << (bit - 11)), low)
    syndrome = low  # of every 23-bit word
    leader = np.zeros(1 << 11, np.uint32)
    bits = [1 << i for i in range(23)]
    errors = [0, *bits]
    errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    leader[syndrome[np.array(errors)]] = errors
    v = np.arange(1 << 16, dtype=np.uint32)
    index = lambda x: ((x ^ leader[syndrome[x]]) >> 11).astype(np.int64)
    own = index(v)
    near = np.stack([own, *(np.where((i := index(v ^ np.uint32(1 << b))) < own, i, own) for b in range(16))], axis=1)
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    count = new.sum(axis=1)
    return np.concatenate(([0], np.cumsum(count)[:-1])), count, near[new]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) of every candidate key of uint64 fingerprints."""
    first, count, indices = tables()
    seg = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    at = np.arange(len(fps))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    tag = 0

    def spread(who: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[s]
        rep = np.repeat(np.arange(len(s)), n)
        inner = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        return rep, indices[first[s][rep] + inner]

    for i in range(4):
        for j in range(i):
            out.append((at, tag << 32 | seg[i] << 16 | seg[j]))
            tag += 1
    fuzzy = [spread(at, s) for s in seg]
    for i in range(4):
        for j in [x for x in range(4) if x != i][:2]:
            rep, idx = fuzzy[j]
            out.append((rep, tag << 32 | seg[i][rep] << 12 | idx))
            tag += 1
    rep, idx = fuzzy[0]
    rep2, idx2 = spread(rep, seg[1][rep])
    both = idx[rep2] << 12 | idx2
    who = rep[rep2]
    for half in (0, 8):
        out.append((who, tag << 32 | both << 8 | seg[2][who] >> half & 0xFF))
        tag += 1
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 4096):
            some = fps[i : i + 4096]
            who, keys = keys_of(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[who])], ["key", "fp"])


def grow(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of fingerprints at ``most`` or fewer differing bits."""
    rest, links = np.arange(len(fps)), []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            hit = np.bitwise_count(fps[rest] ^ fps[x]) <= most
            if hit.any():
                got = rest[hit].tolist()
                links += [(x, y) for y in got]
                frontier += got
                rest = rest[~hit]
    return links


def _link_runs(most: int, most_run: int):
    """Over rows sorted by key: the verified links of each run; of a longer run than ``most_run`` only its key, marked hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u, v, hot=False) -> pa.RecordBatch:
            u, v = (np.asarray(x).astype(np.uint64, copy=False).view(np.int64) if not hot else np.asarray(x, np.int64) for x in (u, v))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), hot))], ["u", "v", "hot"])

        def close(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= most
            yield out(fps[two][near], fps[two + 1][near])
            u, v = [], []
            for a, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                some = fps[a : a + n]
                for x, y in grow(some, most):
                    u.append(some[x])
                    v.append(some[y])
            yield out(np.array(u, np.uint64), np.array(v, np.uint64))

        key, held, n, hot = None, [], 0, False
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if key is not None:
                same = int(np.searchsorted(keys, key, side="right"))
                if not hot:
                    held.append(fps[:same])
                    n += same
                    if n > most_run:
                        hot, held = True, []
                        yield out([key], [0], True)
                keys, fps = keys[same:], fps[same:]
                if not len(keys):
                    continue
                if not hot:
                    run_fps = np.concatenate(held)
                    yield from close(np.full(len(run_fps), key), run_fps)
            start = int(np.searchsorted(keys, keys[-1], side="left"))
            if start:
                yield from close(keys[:start], fps[:start])
            key, held, n, hot = int(keys[-1]), [fps[start:]], len(fps) - start, False
            if n > most_run:
                hot, held = True, []
                yield out([key], [0], True)
        if key is not None and not hot:
            run_fps = np.concatenate(held)
            yield from close(np.full(len(run_fps), key), run_fps)

    return run


def links(fps: DataFrame, most: int = 4, most_run: int = 1 << 18) -> DataFrame:
    """(u, v) links between distinct fingerprints (column fp) that connect all fingerprints within ``most`` = 4 bits."""
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: a fingerprint becomes some forty keys
    keys = fps.select("fp").distinct().repartition(tasks, "fp").mapInArrow(_emit_keys, "key long, fp long")
    schema = "u long, v long, hot boolean"
    found = materialize(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_runs(most, most_run), schema), "links")
    hot = found.where("hot").select(F.col("u").alias("key")).distinct()
    again = hot.count()
    if again:  # a hot key's fingerprints meet block by block, every pair of blocks in a run of its own
        rows = fps.select("fp").distinct().mapInArrow(_emit_keys, "key long, fp long").join(hot, "key")
        rows = materialize(rows, "hot")
        sizes = rows.groupBy("key").agg(F.ceil(F.count("*") * 4 / F.lit(most_run)).cast("long").alias("n"))
        rows = rows.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("fp"), "n")).withColumn("o", F.explode(F.expr("sequence(0L, n - 1)")))
        rows = rows.select(F.xxhash64("key", F.greatest("b", "o"), F.least("b", "o")).alias("key"), "fp")
        blocks = rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_runs(most, 1 << 62), schema)
        found = found.unionByName(materialize(blocks, "links"))
    return found.where("not hot").select("u", "v")


def label_rows(prints: DataFrame, found: DataFrame) -> DataFrame:
    """``prints`` (doc_id, th, fp) with component_id, keep_th of the components that links ``found`` between values of fp make."""
    label = components(found)
    least = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("own"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("named"))
    joined = least.join(label, least.fp == label.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("named", "own").alias("best"))
    joined = materialize(joined, "roots")
    best = joined.groupBy("root").agg(F.min(F.when(F.col("best.doc_id").isNotNull(), F.col("best"))).alias("named"), F.min("best").alias("any"))
    of = joined.join(best, "root").select("fp", F.coalesce("named", "any").alias("best"))
    return prints.join(of, "fp").select("doc_id", "th", "fp", F.col("best.doc_id").alias("component_id"), F.col("best.th").alias("keep_th"))


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4, most_run: int = 1 << 18) -> DataFrame:
    """(doc_id, th, fp, component_id, keep_th): the row (component_id, keep_th) is the one that stands for its component."""
    prints = fingerprints(docs, width)
    return label_rows(prints, links(prints, most, most_run))


def keep_one(docs: DataFrame, dup: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of ``dup``: that of its smallest doc_id; of several rows with that id and text, the one whose columns have the least hash.

    Only these last rows are brought together; any other columns, whatever their names, are carried.
    """
    own = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("keep_th"))
    keep = dup.where(own).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.count("*").alias("_n"))
    keep = broadcast_if_small(materialize(keep, "keep"), 32 << 20)
    rows = plain(docs, "doc_id", "text")
    kept = rows.withColumn("_h", F.xxhash64("text")).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")))
    many = kept.where("_n > 1").withColumn("_r", row_hash(rows))
    least = many.groupBy("_id", "_th").agg(F.min("_r").alias("_r"))
    least = least.select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), F.col("_r").alias("_r2"))
    many = many.join(least, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")) & (F.col("_r") == F.col("_r2"))).dropDuplicates(["_id", "_th"])
    return kept.where("_n = 1").select(*rows.columns).unionByName(many.select(*rows.columns)).toDF(*docs.columns)


def deduplicate(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (of equal rows one)."""
    return keep_one(docs, near_duplicates(docs, width, most))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
