"""Removal of byte strings of ``length`` that start more than once, by depth-limited radix passes.

Every start of a 400-byte string is a suffix to be ordered through 400 bytes only. The passes take
digits from the most significant on, and only suffixes in groups of two or more go on:

1. First digit: the 200-byte string with the least hash among the 201 inside (of equal ones the
   last). Equal 400-byte strings hold the same one at the same place, and neighbouring starts share
   it, so about one row in 100 bytes stands for a run of starts.
2. Second digit: the hash of everything the run's starts cover. Runs equal in both are repeated
   whole, with no further pass. Runs of one text that are equal in both, as in a text of one repeated
   byte or of a short period, are one row with their number and the bytes that they cover.
3. Runs whose group holds different texts: their covering bytes meet by first digit, and the last
   digit, the hash of all 400 bytes and the place of the first digit in them, orders their starts.
   Equal groups are exactly the repeated windows. Groups of over ``most_group`` different runs are
   not brought together; their starts go out one by one and are counted by digit instead.

Texts are keyed by 64-bit hash and size, and one of the copies of a text gives its runs' bytes; equality is that of
64-bit hashes throughout. ``length`` is 16 or more.

Null text is as empty text. Texts under 400 bytes lose nothing. Copies of a text of 400 bytes or
more lose everything. Null ids and repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, broadcast_if_small, byte_runs, bytes_of, documents, materialize

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Rolling:
    """Polynomial hashes of any part of ``data`` of eight bytes or more.

    The terms are mixed values of eight neighbouring bytes, not of single ones: with those, strings such as
    those of Thue and Morse collide whatever the base.
    """

    def __init__(self, data: np.ndarray):
        n = max(len(data) - 7, 0)
        up, self.down = _pow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            eight = np.ndarray((n,), np.uint64, np.ascontiguousarray(data).tobytes(), strides=(1,))
            np.cumsum(_mix(eight + U(0x632BE59BD9B4E019)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end - 7] - self.sums[start]) * self.down[start]

    def every(self, n: int) -> np.ndarray:
        return (self.sums[n - 7 :] - self.sums[: -(n - 7)]) * self.down[: len(self.sums) - (n - 7)]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    left = np.minimum.accumulate(full.reshape(-1, w), axis=1).ravel()
    right = np.minimum.accumulate(full.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, digit 1, digit 2, place, lo, hi) of each run of starts in texts joined in ``data``; places within their text."""
    size = np.diff(offsets)
    n = np.maximum(size - length + 1, 0)
    if not n.sum():
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    roll = Rolling(data)
    h = _mix(roll.every(gram))
    low = U(0xFFFFFF)
    least = _sliding_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), length - gram + 1)
    start = np.arange(n.sum()) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)
    at = (low - (least[start] & low)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), n)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi, at, row = start[first], start[last], at[first], row[first]
    whole = _mix(roll.of(lo, hi + length) + (at - lo).astype(np.uint64) * U(0xA24BAED4963EE407) + (hi - lo).astype(np.uint64) * U(0x9FB21C651E98DF25))
    base = offsets[row]
    return row, h[at], whole, at - base, lo - base, hi - base


def _counted(row: np.ndarray, d1: np.ndarray, d2: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> list[np.ndarray]:
    """The runs of texts with a count: the first of those of a text that are equal in both digits stands for all, and what these cover follows with count 0."""
    order = np.lexsort((lo, d2, d1, row))
    row, d1, d2, at, lo, hi = (x[order] for x in (row, d1, d2, at, lo, hi))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    apart = new.copy()  # starts of stretches that one group covers without a gap
    apart[1:] |= lo[1:] > hi[:-1] + length
    a = np.flatnonzero(apart)
    b = np.append(a[1:], len(row)) - 1
    more = (np.repeat(count, count)[a] > 1) & ~(new[a] & (a == b))  # a first run that stands alone is covered by its own row
    a, b = a[more], b[more]
    ends = (hi[first], hi[b])
    return [*(np.append(x[first], x[a]) for x in (row, d1, d2, at, lo)), np.append(*ends), np.append(count, np.zeros(len(a), np.int64))]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th = batch.column("th").to_numpy(zero_copy_only=False)
            for i, _, data, offsets in byte_runs(batch.column("text"), 1 << 20):
                nb = np.diff(offsets)
                for a in range(0, max(len(data) - length + 1, 1), _PIECE) if len(offsets) == 2 else (0,):
                    part, ends = (data[a : a + _PIECE + length - 1], None) if len(offsets) == 2 else (data, offsets)
                    row, d1, d2, at, lo, hi, c = _counted(*anchors(part, np.array([0, len(part)]) if ends is None else ends, length, gram), length)
                    cols = [th[i + row], nb[row], d1.view(np.int64), d2.view(np.int64), at + a, lo + a, hi + a, c]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["th", "nb", "d1", "d2", "at", "lo", "hi", "c"])

    return run


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: what Python objects of a batch take is bounded by that."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _contexts(length: int):
    """Rows (th, nb, text, runs) -> (d1, th, nb, lo, place, hot, bytes that a run's starts cover)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d1", "th", "nb", "lo", "place", "hot", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        rows, held = [], 0
        for batch in _slices(batches):
            for th, nb, text, runs in zip(batch.column("th").to_pylist(), batch.column("nb").to_pylist(), bytes_of(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                for r in runs:
                    rows.append((r["d1"], th, nb, r["lo"], r["at"] - r["lo"], r["hot"], text[r["lo"] : r["hi"] + length]))
                    held += r["hi"] + length - r["lo"]
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _digits(d1: np.ndarray, place: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start in it, last digit) of every start that the pieces hold."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    roll = Rolling(np.frombuffer(b"".join(pieces), np.uint8))
    n = size - length + 1
    who = np.repeat(np.arange(len(pieces)), n)
    inner = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(size) - size)[who] + inner
    key = roll.of(start, start + length) + _mix(d1.view(np.uint64))[who] + (place[who] - inner + (1 << 20)).astype(np.uint64) * U(0xA24BAED4963EE407)
    return who, inner, _mix(key)


def _repeated(length: int):
    """Rows of runs sorted by first digit -> (th, nb, first, end) of bytes under repeated starts."""

    def close(rows: list[tuple]) -> pa.RecordBatch:
        d1, th, nb, lo, place, pieces = zip(*rows, strict=True)
        who, inner, key = _digits(np.array(d1), np.array(place), list(pieces), length)
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[back] > 1)
        who, inner = who[twice], inner[twice]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (inner[1:] != inner[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(who))[: len(a)] - 1
        lo = np.array(lo)[who[a]]
        cols = [np.array(th)[who[a]], np.array(nb)[who[a]], lo + inner[a], lo + inner[b] + length]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["th", "nb", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, group, size = [], [], 0  # whole groups; the one that is still open
        for batch in _slices(batches, 2048):
            for row in zip(*(batch.column(c).to_pylist() for c in ("d1", "th", "nb", "lo", "place", "bytes")), strict=True):
                if group and group[0][0] != row[0]:
                    if len(group) > 1:
                        done += group
                        size += sum(len(x[-1]) for x in group)
                    group = []
                    if size > 1 << 19:
                        yield close(done)
                        done, size = [], 0
                group.append(row)
        if len(group) > 1:
            done += group
        if done:
            yield close(done)

    return run


def _starts(length: int):
    """Each start of the runs as a row of its own, with its last digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, th, nb, lo, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "th", "nb", "lo", "place"))
            pieces = batch.column("bytes").to_pylist()
            for i in range(0, len(pieces), 2048):
                who, inner, key = _digits(d1[i : i + 2048], place[i : i + 2048], pieces[i : i + 2048], length)
                who = who + i
                cols = [d1[who], key.view(np.int64), th[who], nb[who], lo[who] + inner]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["d1", "key", "th", "nb", "first"])

    return run


def repeated_spans(texts: DataFrame, length: int = 400, most_group: int = 4096, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(th, nb, spans: bytes first..end-1, may overlap) of the texts (th, nb, text) with repeated starts."""
    gram = length // 2
    found = materialize(texts.select("th", "text").mapInArrow(_anchor_rows(length, gram), "th long, nb long, d1 long, d2 long, at long, lo long, hi long, c long"), "runs")
    runs = found.where("c > 0")
    groups = runs.groupBy("d1").agg(F.sum("c").alias("n"), F.min("d2").alias("a"), F.max("d2").alias("b")).where("n > 1").select("d1", (F.col("a") != F.col("b")).alias("mixed"))
    groups = materialize(groups, "groups")  # apart from the join, so that a hot digit's rows can be split among its tasks
    alive = materialize(runs.join(groups, "d1"), "alive")
    equal = alive.groupBy("d1", "d2").agg(F.sum("c").alias("n"), F.min(F.struct("th", "nb", "lo")).alias("rep"))
    equal = materialize(equal, "equal")  # apart from the join too
    different = materialize(equal.groupBy("d1").agg((F.count("*") > most_group).alias("hot")), "different")  # and this
    marked = materialize(alive.join(equal, ["d1", "d2"]), "marked")
    whole = marked.where("n > 1").unionByName(found.where("c = 0"), allowMissingColumns=True).select("th", "nb", F.col("lo").alias("first"), (F.col("hi") + length).alias("end"))
    part = marked.where(F.col("mixed") & ((F.col("n") == 1) | (F.struct("th", "nb", "lo") == F.col("rep")))).join(different, "d1")
    part = materialize(part.groupBy("th", "nb").agg(F.collect_set(F.struct("d1", "at", "lo", "hi", "hot")).alias("runs")), "part")
    held = texts.join(broadcast_if_small(part, broadcast_bytes), ["th", "nb"]).select("th", "nb", "text", "runs")
    held = held.groupBy("th", "nb").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))  # of copies one, but one a task before the exchange
    schema = "d1 long, th long, nb long, lo long, place long, hot boolean, bytes binary"
    held = materialize(held.mapInArrow(_contexts(length), schema), "contexts")
    together = held.where("not hot").drop("hot").repartition("d1").sortWithinPartitions("d1")
    spans = whole.unionByName(together.mapInArrow(_repeated(length), "th long, nb long, first long, end long"))
    starts = held.where("hot").dropDuplicates(["d1", "th", "nb", "lo"]).mapInArrow(_starts(length), "d1 long, key long, th long, nb long, first long")
    twice = starts.groupBy("d1", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    spans = spans.unionByName(starts.join(twice, ["d1", "key"]).select("th", "nb", "first", (F.col("first") + length).alias("end")))
    return materialize(spans.groupBy("th", "nb").agg(F.collect_set(F.struct("first", "end")).alias("spans")), "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        out = []
        for text, spans in zip(bytes_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            text = text or b""
            runs: list[list[int]] = []
            for a, b in sorted((s["first"], s["end"]) for s in spans or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            edge = [0, *(x for r in runs for x in r), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
            out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        keep = [batch.column("doc_id")]
        yield pa.RecordBatch.from_arrays(keep + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _cut gives, without the kept bytes."""
    for batch in _cut(batches):
        yield batch.drop_columns(["kept"])


def remove_repeats(docs: DataFrame, length: int = 400, most_group: int = 4096, broadcast_bytes: int = 32 << 20, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept: the remaining bytes]) of every row."""
    texts = bounded_batches(docs).select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("nb"), "text")
    spans = repeated_spans(texts.select("th", "nb", "text"), length, most_group, broadcast_bytes)
    joined = texts.join(broadcast_if_small(spans, broadcast_bytes), ["th", "nb"], "left").select("doc_id", "text", "spans")
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(_cut, out + ", kept binary") if with_bytes else joined.mapInArrow(_digest, out)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_bytes=False)
