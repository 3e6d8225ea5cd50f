"""Language-model scores by context-tree weighting over bytes.

The model codes each byte as eight binary decisions. A decision's contexts are the last 0 to
``depth`` bytes; each node (context, bits of the byte so far) estimates by Krichevsky-Trofimov, and
nodes of all depths are weighed as context-tree weighting has it, P = (own estimate + product of the
children) / 2 from the deepest up, which fixes how a prediction mixes the depths. Contexts that
training never met add nothing: the deepest node that it met takes what weight is left. A text is
coded after ``depth`` zero bytes and closed by one.

A gram is the ``depth`` bytes of context, the last one in the highest place, over the byte that
follows. Texts and model meet by joins, and no gram reaches the driver:

1. Texts are cut into blocks. A block's distinct grams and words leave with their training counts as
   packs, one for each of ``buckets`` values of a hash (of a gram: of its context's later bytes). A
   block names each once, so no bucket is hot. Its texts are stored compressed.
2. Counts are added up by bucket. The grams, in order, give the nodes of the two deepest levels, as
   far as one context of ``depth - 1`` bytes at a time (65,536 grams at most); the levels above are
   sums by context, one groupBy each, and the weights come down again by equi-joins.
3. Every gram gets the log10 probability of its byte, in order again, beside the nodes of its stem.
4. A block's packs meet these scores and the words' counts by bucket and go back to the block, where
   its texts are scored.

Memory is bounded by a block (``BLOCK_BYTES`` of text, ``BLOCK_GRAMS`` distinct grams, ``BLOCK_WORDS``
distinct words, but for a longer text alone), a bucket (about ``BUCKET_BYTES`` of text) and a context;
the number of buckets follows the input.

Null text is as empty text: one token, the end. Null ids are never learned from and are not held
out. Equal texts have equal scores. Without training documents N and V are 0 and each bit has 1/2. An
empty table gives no rows. Other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, bytes_of, discard, documents, materialize, pack, squeeze, unpack, unsqueeze

U = np.uint64
END = b""  # the end token: no word is empty
BLOCK_BYTES, BLOCK_GRAMS, BLOCK_WORDS, CHUNK = 1 << 24, 1 << 20, 1 << 18, 1 << 20
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1 << 25, 256, 1 << 16
RUN = 1 << 17  # grams of the ordered stream that are worked on at once, but for a context's own


def _stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every coded byte, first of them of each text)."""
    gap = b"\0" * max(depth, 1)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8).astype(np.uint64)
    gram = np.zeros(len(data), np.uint64)
    gram[depth:] = data[depth:]
    for k in range(1, depth + 1):
        gram[depth:] |= data[depth - k : len(data) - k] << U(8 * (depth + 1 - k))
    size = np.array([len(t) for t in texts], np.int64)
    start = len(gap) + np.cumsum(size + len(gap)) - (size + len(gap))
    first = np.cumsum(size + 1) - (size + 1)
    coded = np.ones(int((size + 1).sum()), np.int64)
    coded[0] = start[0]
    coded[first[1:]] = start[1:] - (start[:-1] + size[:-1])
    return gram[np.cumsum(coded)], first


def _chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 8
    if a < len(texts):
        yield a, len(texts)


def _pack_words(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.compress(b"\n".join(words), 1)


def _unpack_words(data: bytes) -> list[bytes]:
    """The words; no word holds white space, and only the end token is empty."""
    import zstandard

    return zstandard.decompress(data).split(b"\n")


def _dealt(of: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in order of what falls into it) by values to be hashed."""
    h = of * U(0x9E3779B97F4A7C15)
    at = ((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(40)) % U(buckets)
    order = np.argsort(at.astype(np.uint16), kind="stable")
    ends = np.cumsum(np.bincount(at.astype(np.int64), minlength=buckets))
    for b, (i, j) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)):
        if j > i:
            yield b, order[i:j]


def _dealt_grams(grams: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Grams that differ in two bytes at most, the earliest and the one that follows, go together: at most 65,536."""
    return _dealt(grams >> U(16), buckets)


def _dealt_words(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    import xxhash

    return _dealt(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), buckets)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added up."""
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts), len(k)).astype(np.uint64)


READ = "block long, bucket int, grams binary, counts binary, words binary, word_counts binary, texts binary"


def _rows(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the columns of ``schema``, null where none are given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(size, kinds[k]) for c, k in names], [c for c, _ in names])


def _read(depth: int, buckets: int):
    """Rows (doc_id, text, learn) -> packs of a block's grams and words with training counts, a block's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        block, held, size, merged = TaskContext.get().partitionId() << 24, 0, 0, 0  # merged: distinct grams, of those merged last

        def close() -> Iterator[pa.RecordBatch]:
            k, c = _merged(keys, counts)
            grams = {b: (pack(k[at]), squeeze(c[at])) for b, at in _dealt_grams(k, buckets)}
            names = sorted(words)
            n = np.fromiter((words[w] for w in names), np.uint64, len(names))
            named = {b: (_pack_words([names[i] for i in at.tolist()]), squeeze(n[at])) for b, at in _dealt_words(names, buckets)}
            at = sorted(grams.keys() | named.keys())
            for i in range(0, len(at), 256):
                some = at[i : i + 256]
                g, w = ([x.get(b, (None, None)) for b in some] for x in (grams, named))
                yield _rows(READ, block=[block] * len(some), bucket=some, grams=[x for x, _ in g], counts=[x for _, x in g], words=[x for x, _ in w], word_counts=[x for _, x in w])

        for batch in batches:
            texts = [(t or b"").lower() for t in bytes_of(batch.column("text"))]
            learn = batch.column("learn").to_pylist()
            for a, b in _chunks(texts, CHUNK):
                for own in (True, False):
                    some = [t for t, known in zip(texts[a:b], learn[a:b], strict=True) if known == own]
                    if not some:
                        continue
                    k, c = np.unique(_stream(some, depth)[0], return_counts=True)
                    keys.append(k)
                    counts.append(c if own else np.zeros(len(k), np.int64))
                    held += len(k)
                    for t in some:
                        words.update(t.split() if own else dict.fromkeys(t.split(), 0))
                    words[END] += len(some) if own else 0
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                yield _rows(READ, block=[block], texts=[sink.getvalue().to_pybytes()])
                size += sum(map(len, texts[a:b]))
                if held - merged > BLOCK_GRAMS // 2:
                    k, c = _merged(keys, counts)
                    keys, counts, held, merged = [k], [c], len(k), len(k)
                if size > BLOCK_BYTES or merged > BLOCK_GRAMS or len(words) > BLOCK_WORDS:
                    yield from close()
                    words, keys, counts, held, size, merged, block = Counter(), [], [], 0, 0, 0, block + 1
        if keys:
            yield from close()

    return run


COUNTED = "key long, n long, bucket int, words binary, word_counts binary, tokens long, distinct long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted by bucket -> (key, n): each gram with its count in training; a bucket's words with theirs, and sums of them."""

    def out(bucket: int) -> Iterator[pa.RecordBatch]:
        if keys:
            k, n = _merged(keys, counts)
            for i in range(0, len(k), RUN):
                yield _rows(COUNTED, key=k[i : i + RUN].view(np.int64), n=n[i : i + RUN].view(np.int64))
        known = sorted(w for w, n in words.items() if n)
        if known:
            n = np.fromiter((words[w] for w in known), np.uint64, len(known))
            yield _rows(COUNTED, bucket=[bucket], words=[_pack_words(known)], word_counts=[squeeze(n)], tokens=[int(n.sum())], distinct=[len(n)])

    last, keys, counts, held, merged = None, [], [], 0, 0
    words: Counter = Counter()
    for batch in batches:
        for bucket, grams, n, named, times in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in ("grams", "counts", "words", "word_counts")), strict=True):
            if bucket != last and last is not None:
                yield from out(last)
                keys, counts, held, merged, words = [], [], 0, 0, Counter()
            last = bucket
            if named.is_valid:
                words.update(dict(zip(_unpack_words(named.as_py()), unsqueeze(times.as_py()).tolist(), strict=True)))
            if not grams.is_valid:
                continue
            keys.append(unpack(grams.as_py()))
            counts.append(unsqueeze(n.as_py()))
            held += len(keys[-1])
            if held - merged > 1 << 20:
                k, c = _merged(keys, counts)
                keys, counts, held, merged = [k], [c], len(k), len(k)
    if last is not None:
        yield from out(last)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of gamma for x > 0, by Stirling's series beyond a shift of 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _at(grams: np.ndarray, level: int, depth: int) -> np.ndarray:
    """(8, grams): the nodes of the eight decisions at a level, context << 8 | 1 and the bits so far."""
    y = grams & U(255)
    context = (grams >> U(8 * (depth + 1 - level))) << U(8) if level else np.zeros(len(grams), np.uint64)
    return np.stack([context | U(1 << k) | (y >> U(8 - k)) for k in range(8)])


def _bits(grams: np.ndarray) -> np.ndarray:
    return np.stack([(grams >> U(7 - k)) & U(1) for k in range(8)]).astype(float)


def _up(at: np.ndarray) -> np.ndarray:
    """The same decision's node one level up."""
    return (at >> U(16)) << U(8) | at & U(255)


class Level:
    """Nodes of one level from distinct grams with counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, level: int, depth: int):
        self.at, back = np.unique(_at(grams, level, depth), return_inverse=True)
        back, many = back.ravel(), np.tile(n.astype(float), 8)
        self.ones = np.bincount(back, many * _bits(grams).ravel(), len(self.at)).astype(float)  # of nothing, bincount makes whole numbers
        self.zeros = np.bincount(back, many, len(self.at)) - self.ones

    def own(self) -> np.ndarray:
        """log of the KT block probability."""
        return _lgamma(self.zeros + 0.5) + _lgamma(self.ones + 0.5) - _lgamma(self.zeros + self.ones + 1) - np.log(np.pi)

    def one(self) -> np.ndarray:
        """KT probability of a one."""
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        if not len(self.at):
            return np.zeros(at.shape, np.int64), np.zeros(at.shape, bool)
        place = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        return place, self.at[place] == at


def deep(grams: np.ndarray, n: np.ndarray, stem: int, depth: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """Levels below the stem of whole contexts of ``stem`` + 1 bytes; weights of their own estimates; log weighted probability at the first of them."""
    met = n > 0
    levels = [Level(grams[met], n[met], d, depth) for d in range(stem + 1, depth + 1)]
    weights: list[np.ndarray] = []
    log_w = np.zeros(0)
    for i in range(len(levels) - 1, -1, -1):
        own = levels[i].own()
        if i == len(levels) - 1:
            weights.insert(0, np.ones(len(own)))
            log_w = own
            continue
        below = np.bincount(np.searchsorted(levels[i].at, _up(levels[i + 1].at)), log_w, len(own)).astype(float)
        weights.insert(0, 1 / (1 + np.exp(np.clip(below - own, -700, 700))))
        log_w = np.logaddexp(own, below) - np.log(2)
    return levels, weights, log_w


def _ordered(batches: Iterator[pa.RecordBatch], names: list[str], stem: int, depth: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by key, in runs that hold whole contexts of ``stem`` + 1 bytes."""
    shift = U(8 * max(depth - stem, 0))
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        rows += batch.num_rows
        if rows < RUN:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        top = whole[0].view(np.uint64) >> shift
        cut = int(np.searchsorted(top, top[-1], side="left"))
        if cut:
            yield [c[:cut] for c in whole]
        held, rows = [[c[cut:] for c in whole]], len(top) - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _rising(stem: int, depth: int):
    """(key, n) sorted by key -> (at, zeros, ones, below): what each run knows of the nodes of its stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _ordered(batches, ["key", "n"], stem, depth):
            grams = key.view(np.uint64)
            top = Level(grams, n, stem, depth)  # with the nodes that training never met
            levels, _, log_w = deep(grams, n, stem, depth)
            below = np.bincount(np.searchsorted(top.at, _up(levels[0].at)), log_w, len(top.at)).astype(float) if levels else np.zeros(len(top.at))
            yield pa.RecordBatch.from_arrays([pa.array(top.at.view(np.int64)), pa.array(top.zeros), pa.array(top.ones), pa.array(below)], ["at", "zeros", "ones", "below"])

    return run


def _falling(stem: int, depth: int, buckets: int):
    """Nodes of stems and grams sorted by key -> packs (bucket, grams, scores) of log10 probabilities."""
    names = ["key", "kind", "node", "before", "mass", "p", "met"]

    def scored(top: list[np.ndarray], grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, before, mass, p, met = top
        levels, weights, _ = deep(grams, n, stem, depth)
        deeper = []  # of each level's nodes: the probability of a one if this is the deepest node met
        for i, level in enumerate(levels):
            if i == 0:
                up = np.searchsorted(at, _up(level.at))
                rest, left = before[up], mass[up]
            else:
                up = np.searchsorted(levels[i - 1].at, _up(level.at))
                rest, left = (rest + left * weights[i - 1] * levels[i - 1].one())[up], (left * (1 - weights[i - 1]))[up]
            deeper.append(rest + left * level.one())
        out = p[np.searchsorted(at, _at(grams, stem, depth))]
        for i, level in enumerate(levels):
            place, there = level.find(_at(grams, stem + 1 + i, depth))
            out = np.where(there, deeper[i][place] if len(deeper[i]) else out, out)
        return np.log10(np.where(_bits(grams) > 0, out, 1 - out)).sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.zeros(0, np.uint64), *[np.zeros(0)] * 3, np.zeros(0, bool)]
        for rows in _ordered(batches, [*names, "n"], stem, depth):
            gram = rows[1] == 1
            node = [c[~gram] for c in (rows[2].view(np.uint64), *rows[3:7])]
            if len(node[0]):
                order = np.argsort(node[0])
                top = [np.concatenate((a, b[order])) for a, b in zip(top, node, strict=True)]
            grams = rows[0][gram].view(np.uint64)
            if len(grams):
                score = scored(top, grams, rows[7][gram]).astype(np.float32)
                packs = [(b, pack(grams[at]), squeeze(score[at])) for b, at in _dealt_grams(grams, buckets)]
                for i in range(0, len(packs), 1024):
                    b, g, s = zip(*packs[i : i + 1024], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(g, pa.binary()), pa.array(s, pa.binary())], ["bucket", "grams", "scores"])
            if len(top[0]):
                last = top[0] >> U(8) == top[0][-1] >> U(8)  # its later contexts may follow
                top = [c[last] for c in top]

    return run


def _lgamma_of(x: Column) -> Column:
    """As :func:`_lgamma`."""
    product = x
    for k in range(1, 8):
        product = product * (x + F.lit(float(k)))
    z = x + F.lit(8.0)
    series = F.lit(1 / 12) / z - F.lit(1 / 360) / (z * z * z) + F.lit(1 / 1260) / (z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def model(grams: DataFrame, depth: int, buckets: int, tasks: int) -> DataFrame:
    """Packs (bucket, grams, scores) of log10 probabilities of all ``grams`` (key, n: count in training, which may be 0)."""
    stem = max(depth - 2, 0)
    stem_of = F.shiftrightunsigned("key", 8 * (depth + 1 - stem)) if stem else F.lit(0)
    inner = grams.repartition(tasks, stem_of).sortWithinPartitions("key").mapInArrow(_rising(stem, depth), "at long, zeros double, ones double, below double")
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    levels = [materialize(inner.groupBy("at").agg(*sums), "level")]
    half, n = F.lit(0.5), F.col("zeros") + F.col("ones")
    own = _lgamma_of(F.col("zeros") + half) + _lgamma_of(F.col("ones") + half) - _lgamma_of(n + F.lit(1.0)) - F.lit(math.log(math.pi))
    up = F.shiftleft(F.shiftright("at", 16), 8).bitwiseOR(F.col("at").bitwiseAND(255))
    for d in range(stem, 0, -1):
        both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - F.lit(math.log(2))
        rows = levels[0].withColumn("own", own).select(up.alias("at"), "zeros", "ones", both.alias("below"))
        levels.insert(0, materialize(rows.groupBy("at").agg(*sums), "level"))
    down = None
    for d, level in enumerate(levels):
        weight = F.lit(1.0) if d == depth else 1 / (1 + F.exp(F.col("below") - F.col("own")))
        rows = level.select("at", (n > 0).alias("met"), ((F.col("ones") + half) / (n + F.lit(1.0))).alias("kt"), own.alias("own"), "below")
        rows = rows.select("at", "met", "kt", weight.alias("weight"))
        if down is None:
            rows = rows.withColumns({"rest": F.lit(0.0), "left": F.lit(1.0), "over": F.lit(0.5)})
        else:
            rows = rows.withColumn("up", up).join(down.select(F.col("at").alias("up"), F.col("before").alias("rest"), F.col("mass").alias("left"), F.col("p").alias("over")), "up")
        down = rows.select(
            "at", "met",
            (F.col("rest") + F.col("left") * F.col("weight") * F.col("kt")).alias("before"),
            (F.col("left") * (1 - F.col("weight"))).alias("mass"),
            F.when(F.col("met"), F.col("rest") + F.col("left") * F.col("kt")).otherwise(F.col("over")).alias("p"),
        )
    nodes = down.select(F.shiftleft(F.shiftright("at", 8), 8 * (depth + 1 - stem)).alias("key"), F.lit(0).alias("kind"), F.col("at").alias("node"), "before", "mass", "p", "met", F.lit(0).cast("long").alias("n"))
    zero = F.lit(0.0)
    rows = grams.select("key", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("node"), zero.alias("before"), zero.alias("mass"), zero.alias("p"), F.lit(False).alias("met"), "n")
    rows = nodes.unionByName(rows).repartition(tasks, stem_of).sortWithinPartitions("key", "kind")
    return materialize(rows.mapInArrow(_falling(stem, depth, buckets), "bucket int, grams binary, scores binary"), "model")


ANSWERS = "block long, grams binary, scores binary, words binary, word_counts binary"


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted by bucket, the model's (no block) first -> the blocks' packs with scores and counts."""
    last, keys, scores = None, [], []
    counts: dict[bytes, int] = {}
    key = value = None
    for batch in batches:
        columns = (batch.column(c) for c in ("grams", "scores", "words", "word_counts"))
        for bucket, block, grams, score, named, times in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), *columns, strict=True):
            if bucket != last:
                last, keys, scores, counts, key = bucket, [], [], {}, None
            if block is None:
                if grams.is_valid:
                    keys.append(unpack(grams.as_py()))
                    scores.append(unsqueeze(score.as_py(), np.float32))
                else:
                    counts = dict(zip(_unpack_words(named.as_py()), unsqueeze(times.as_py()).tolist(), strict=True))
                continue
            if key is None and keys:
                key, value = np.concatenate(keys), np.concatenate(scores)
                order = np.argsort(key)
                key, value, keys, scores = key[order], value[order], [], []
            out: dict[str, list] = {"block": [block]}
            if grams.is_valid:
                out |= {"grams": [grams.as_py()], "scores": [squeeze(value[np.searchsorted(key, unpack(grams.as_py()))])]}
            if named.is_valid:
                own = _unpack_words(named.as_py())
                out |= {"words": [named.as_py()], "word_counts": [squeeze(np.fromiter((counts.get(w, 0) for w in own), np.uint64, len(own)))]}
            yield _rows(ANSWERS, **out)


class _Held:
    """Scores of a block's grams and counts of its words."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray], words: list[tuple[bytes, bytes]]):
        import pandas as pd

        self.index, self.value = pd.Index(np.concatenate(keys).view(np.int64)), np.concatenate(values)
        names: list[bytes] = []
        for w, _ in words:
            names += _unpack_words(w)
        self.place = dict(zip(names, range(len(names)), strict=True))
        n = np.concatenate([unsqueeze(c) for _, c in words])
        self.known, self.log = n > 0, np.log10(n.astype(float) + 1)

    def of(self, texts: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known ones, sum of log10(count + 1), log10 probability."""
        grams, first = _stream(texts, depth)
        score = np.add.reduceat(self.value[self.index.get_indexer(grams.view(np.int64))].astype(float), first)
        words = [[*t.split(), END] for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((self.place[x] for w in words for x in w), np.int64, int(n.sum()))
        start = np.cumsum(n) - n
        return n, np.add.reduceat(self.known[at].astype(np.int64), start), np.add.reduceat(self.log[at], start), score


def _score(depth: int):
    """Rows sorted by block, its packs before its texts -> a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, values, words, model = None, [], [], [], None
        for batch in batches:
            columns = (batch.column(c) for c in ("grams", "scores", "words", "word_counts", "texts"))
            for block, grams, scores, named, times, held in zip(batch.column("block").to_pylist(), *columns, strict=True):
                if block != last:
                    last, keys, values, words, model = block, [], [], [], None
                if not held.is_valid:
                    if grams.is_valid:
                        keys.append(unpack(grams.as_py()))
                        values.append(unsqueeze(scores.as_py(), np.float32))
                    if named.is_valid:
                        words.append((named.as_py(), times.as_py()))
                    continue
                if model is None:
                    model, keys, values, words = _Held(keys, values, words), [], [], []
                for rows in pa.ipc.open_stream(held.as_py()):
                    found = model.of([(t or b"").lower() for t in bytes_of(rows.column("text"))], depth)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, found)], ["doc_id", "n_tokens", "n_known", "part", "score"])

    return run


def score(docs: DataFrame, learn, depth: int = 5) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from rows where ``learn`` holds."""
    size = bounded_batches(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), MOST_BUCKETS)
    tasks = buckets // 8  # named, for adaptive coalescing would size these stages by packed bytes
    read = materialize(docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(_read(depth, buckets), READ), "read")
    packs = read.where("bucket is not null")
    counted = packs.select("bucket", "grams", "counts", "words", "word_counts").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    counted = materialize(counted.mapInArrow(_counted, COUNTED), "counted")
    total, distinct = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    scores = model(counted.where("key is not null").select("key", "n"), depth, buckets, tasks)
    no = lambda *names: [F.lit(None).cast("long" if c == "block" else "binary").alias(c) for c in names]
    order = ["bucket", "block", "grams", "scores", "words", "word_counts"]
    asked = scores.select("*", *no("block", "words", "word_counts")).select(order)
    asked = asked.unionByName(counted.where("bucket is not null").select("bucket", "words", "word_counts", *no("block", "grams", "scores")))
    asked = asked.unionByName(packs.select("bucket", "block", "grams", "words", *no("scores", "word_counts")))
    asked = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    answers = asked.mapInArrow(_answered, ANSWERS).select("*", *no("texts"))
    held = read.where("texts is not null").select("block", "texts", *no("grams", "scores", "words", "word_counts"))
    blocks = answers.unionByName(held).repartition(tasks, "block").sortWithinPartitions("block", F.col("texts").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(blocks.mapInArrow(_score(depth), f"doc_id {kind}, n_tokens long, n_known long, part double, score double"), "scored")
    for done in (read, counted, scores):
        discard(done)
    base = F.col("part") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    found = score(documents(spark, sf_dir), fold != 2)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
