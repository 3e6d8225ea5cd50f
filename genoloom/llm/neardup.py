"""Near copies by the Jaccard similarity of word shingles, for pipelines.

Two texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, told on the
exact sets (XXH64 values). A SimHash of 64 bits can't find these pairs: at 0.8 it differs in about ten bits
and often in more, and keys for that many errors are shared by everything. Candidates come from prefixes
instead: put every set in one order of shingles, and two sets of similarity t or more share a shingle among
the first n - ceil(t n) + 1 of each. So no pair is lost, whatever the order. The order puts shingles last
that a bounded sample of texts has often, which keeps the runs of texts that share a key short.

Most keys are of one set alone and link nothing. So 40 bits of each go first, packed, from blocks of texts to
buckets of a hash, and come back where two blocks have them or one has them twice; only these keys are paired.

Sets of equal shingles are one set before keys meet, so copies never fill a key's run. A run of up
to ``most_all`` sets gives all its pairs. In a longer one all sets meet its first. After these links, components
of a run that seem similar by size, place and bitmap are joined by a spanning forest, one pair for each component
but the first, and the pairs are verified. Where all hold, nothing is left to ask. Where not, forests are made anew
between the components then known, ROUNDS times or until few pairs hold, and at last every pair that still may link is verified.

Each set has a bitmap of the parity of its shingles by residues, two or more for each shingle and SKETCH at least.
Two bitmaps differ in no more bits than the sets do in shingles, so candidates that differ in too many are dropped
before texts are read (first by bitmaps folded to FOLD and SKETCH bits, then whole); none that links is. Of a pair's texts, the one with the smaller set id goes to its
task once for all its pairs, and all travel compressed.

Null or wordless texts have the empty set and link to each other. Null ids, repeated rows: as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from genoloom.llm.common import bounded_batches, broadcast_if_small, bytes_of, components, discard, materialize, pack, release, trim, unpack
from genoloom.llm.simhash import keep_one, label_rows

#: Similarity of 4 / 5, as whole numbers so that the border is exact.
TOP, OF = 4, 5
SAMPLE_TEXTS, SAMPLE_SHARE, MOST_COMMON, ROUNDS = 4_000, 8, 1 << 18, 3
SKETCH, FOLD, BROADCAST_BYTES = 1024, 256, 32 << 20
BLOCK_KEYS, BUCKET_KEYS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 22, 256, 1 << 16


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values (uint64) of the shingles of UTF-8 bytes; a shorter text is one shingle."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([h(joined, 42)], np.uint64)
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def set_id(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(grams.tobytes(), 42) if len(grams) else 0


def sketch(grams: np.ndarray) -> bytes:
    """Bit i: whether the shingles whose value is i modulo the number of bits, a power of two, are odd in number."""
    size = max(SKETCH, 1 << (2 * len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap for fewer residues."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size // 8)).tobytes()


def differ(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b)) * 8
    return int(np.bitwise_count(np.frombuffer(folded(a, size), np.uint64) ^ np.frombuffer(folded(b, size), np.uint64)).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted distinct arrays have a Jaccard similarity of TOP / OF or more."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * TOP:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * OF >= (len(both) - shared) * TOP


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in bytes_of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, width).view(np.int64))], ["g"])

    return run


def common_shingles(docs: DataFrame, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted, rank) of those that a sample (SAMPLE_TEXTS texts, or one in SAMPLE_SHARE) has in three texts or more, rank 1 the rarest. Only the order of keys rests on it."""
    n = docs.count()
    most = max(SAMPLE_TEXTS, n // SAMPLE_SHARE)
    h = F.xxhash64("text")
    some = docs.select("text").where(F.pmod(h, F.lit(max(1, -(-n // most)))) == 0).withColumn("h", h).dropDuplicates(["h"]).select("text").limit(2 * most)
    often = some.mapInArrow(_sampled(width), "g long").groupBy("g").count().where("count > 2").orderBy(F.desc("count"), "g").limit(MOST_COMMON)
    found = often.toPandas()
    g = found["g"].to_numpy(np.int64).view(np.uint64)[::-1]
    order = np.argsort(g, kind="stable")
    return g[order], (np.arange(len(g)) + 1)[order]


def prefix(grams: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles, first to last, that a set of similarity TOP / OF or more must share one of."""
    n = len(grams)
    if not n:
        return grams
    place = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        place = np.where(common[at] == grams, rank[at], 0)
    return grams[np.lexsort((grams, place))[: n - -(-TOP * n // OF) + 1]]


READ = "fp long, n long, full binary, bits binary, few binary, block long, first binary, bucket int, seen binary"


def _read(width: int, shared, buckets: int, kind: pa.DataType):
    """Rows (doc_id, th, text) -> the same with fp; for each set of a block its size, bitmaps and prefix; packs of what 40 bits of its keys are."""
    names = ["doc_id", "th", *(x.split()[0] for x in READ.split(", "))]
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def out(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        block, sets, held, size = TaskContext.get().partitionId() << 24, set(), [], 0

        def close() -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate(held)) >> np.uint64(24)
            keys = np.unique(keys)
            at = (keys * np.uint64(buckets)) >> np.uint64(40)
            edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
            packs = [pack(keys[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield out(block=[block] * len(packs), bucket=at[edge[:-1]].astype(np.int32), seen=packs)

        for batch in batches:
            rows: list[tuple] = []
            ids = []
            for t in bytes_of(batch.column("text")):
                grams = shingles(t, width)
                fp = int(np.array(set_id(grams), np.uint64).view(np.int64))
                ids.append(fp)
                if len(grams) and fp not in sets:
                    sets.add(fp)
                    keys = prefix(grams, common, rank)
                    held.append(keys)
                    size += len(keys)
                    full = sketch(grams)
                    rows.append((fp, len(grams), full, folded(full, SKETCH), folded(full, FOLD), block, keys.tobytes()))
            yield out(doc_id=batch.column("doc_id"), th=batch.column("th"), fp=ids)
            if rows:
                yield out(**dict(zip(("fp", "n", "full", "bits", "few", "block", "first"), zip(*rows, strict=True), strict=True)))
            if size > BLOCK_KEYS:
                yield from close()
                block, sets, held, size = block + 1, set(), [], 0
        if held:
            yield from close()
        sets, held = set(), []
        trim()

    return run


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted by bucket -> each block's packs of those of its values that another block has too."""

    def close(blocks: list[int], packs: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(packs)
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        found = [x[np.isin(x, twice, assume_unique=True)] for x in packs]
        rows = [(b, pack(x)) for b, x in zip(blocks, found, strict=True) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["block", "seen"])

    last, blocks, packs = None, [], []
    for batch in batches:
        for bucket, block, seen in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("seen"), strict=True):
            if bucket != last and blocks:
                yield close(blocks, packs)
                blocks, packs = [], []
            last = bucket
            blocks.append(block)
            packs.append(unpack(seen.as_py()))
    if blocks:
        yield close(blocks, packs)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, packs of its repeated values before its sets -> (key, fp, n, at) of keys that may be of two sets."""

    def close(twice: list[np.ndarray], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        fp, n, first = zip(*rows, strict=True)
        counts = np.array([len(x) // 8 for x in first], np.int64)
        keys = np.frombuffer(b"".join(first), np.uint64)
        at = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
        short = keys >> np.uint64(24)
        own = np.sort(short)
        every = np.unique(np.concatenate([*twice, own[1:][own[1:] == own[:-1]]]))
        hit = np.isin(short, every)
        columns = [keys.view(np.int64), np.repeat(np.array(fp), counts), np.repeat(np.array(n), counts).astype(np.int32), at.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in columns], ["key", "fp", "n", "at"])

    last, twice, rows = None, [], []
    for batch in batches:
        for block, seen, fp, n, first in zip(batch.column("block").to_pylist(), batch.column("seen"), batch.column("fp").to_pylist(), batch.column("n").to_pylist(), batch.column("first"), strict=True):
            if block != last and rows:
                yield from close(twice, rows)
            if block != last:
                last, twice, rows = block, [], []
            if seen.is_valid:
                twice.append(unpack(seen.as_py()))
            else:
                rows.append((fp, n, first.as_py()))
    if rows:
        yield from close(twice, rows)
    twice, rows = [], []
    trim()


KEYED = "key long, fp long, n int, at int"


def _may(n1, at1, n2, at2) -> np.ndarray:
    """Whether sets of these sizes that share a shingle at these places of their orders can reach TOP / OF (an upper bound of the shared ones)."""
    most = np.minimum(at1, at2) + 1 + np.minimum(n1 - at1 - 1, n2 - at2 - 1)
    return most * OF >= (n1 + n2 - most) * TOP


def _pair_runs(most_all: int, labelled: bool, spanning: bool = False):
    """Over rows sorted by key: candidates (u, v). Of runs over ``most_all`` those with the first set, and the run's rows again (v null); or,
    with labels, all pairs of different labels, or a spanning forest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "fp", "n", "at"] + ["root", "bits"] * labelled

        def out(u, v, key=None, n=None, at=None) -> pa.RecordBatch:
            k = len(u)
            nothing = lambda kind: pa.nulls(k, kind)
            long, short = pa.int64(), pa.int32()
            columns = [pa.array(u, long), nothing(long) if v is None else pa.array(v, long)]
            columns += [nothing(long), nothing(short), nothing(short)] if key is None else [pa.array(key, long), pa.array(n, short), pa.array(at, short)]
            return pa.RecordBatch.from_arrays(columns, ["u", "v", "key", "n", "at"])

        def pairs(fp, n, at, more) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            order = np.argsort(n, kind="stable")
            fp, n, at, more = fp[order], n[order], at[order], [x[order] for x in more]
            ends = np.searchsorted(n * TOP, n * OF, side="right")  # beyond it sets are too large
            bits = np.array([np.frombuffer(x, np.uint64) for x in more[1]]) if labelled else None
            for x in range(len(fp) - 1):
                y = slice(x + 1, int(ends[x]))
                ok = _may(n[x], at[x], n[y], at[y])
                if labelled:
                    ok &= more[0][y] != more[0][x]
                    ok &= np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64) * (OF + TOP) <= (n[y] + n[x]) * (OF - TOP)
                hit = fp[y][ok]
                yield np.minimum(hit, fp[x]), np.maximum(hit, fp[x])

        def forest(fp, n, at, more) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """A pair for each label but the first of those that seem linked: the one whose bitmaps differ least, as Prim's trees grow."""
            names, label = np.unique(more[0], return_inverse=True)
            bits = np.array([np.frombuffer(x, np.uint64) for x in more[1]])
            members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
            rest = np.arange(len(fp))
            best, source = np.full(len(fp), np.inf), np.zeros(len(fp), np.int64)
            u, v = [], []
            while len(rest):
                k = int(best[rest].argmin())
                y = int(rest[k])
                if best[y] < np.inf:
                    u.append(min(fp[source[y]], fp[y]))
                    v.append(max(fp[source[y]], fp[y]))
                rest = rest[label[rest] != label[y]]
                for x in members[label[y]].tolist():
                    if not len(rest):
                        break
                    both = n[rest] + n[x]
                    apart = np.bitwise_count(bits[rest] ^ bits[x]).sum(axis=1, dtype=np.int64)
                    ok = (np.minimum(n[rest], n[x]) * OF >= np.maximum(n[rest], n[x]) * TOP) & _may(n[x], at[x], n[rest], at[rest]) & (apart * (OF + TOP) <= both * (OF - TOP))
                    value = np.where(ok, apart / both, np.inf)
                    nearer = value < best[rest]
                    best[rest[nearer]], source[rest[nearer]] = value[nearer], x
            yield np.array(u, np.int64), np.array(v, np.int64)

        def close(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            new = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))  # blocks may have the same set
            rows = [c[new] for c in rows]
            key, fp, n, at = rows[:4]
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            u, v, held = [], [], 0
            if len(two):
                ok = _may(n[two], at[two], n[two + 1], at[two + 1])
                if labelled:
                    ok &= rows[4][two] != rows[4][two + 1]
                two = two[ok]
                u.append(np.minimum(fp[two], fp[two + 1]))
                v.append(np.maximum(fp[two], fp[two + 1]))
            for a, k in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                b = a + k
                if not labelled and k > most_all:
                    ok = _may(n[a], at[a], n[a + 1 : b], at[a + 1 : b])
                    hit = fp[a + 1 : b][ok]
                    u.append(np.minimum(hit, fp[a]))
                    v.append(np.maximum(hit, fp[a]))
                    yield out(fp[a:b], None, key[a:b], n[a:b], at[a:b])
                    continue
                if labelled and (rows[4][a:b] == rows[4][a]).all():
                    continue
                for x, y in (forest if spanning else pairs)(fp[a:b], n[a:b], at[a:b], [c[a:b] for c in rows[4:]]):
                    u.append(x)
                    v.append(y)
                    held += len(x)
                    if held > 1 << 18:
                        yield out(np.concatenate(u), np.concatenate(v))
                        u, v, held = [], [], 0
            if u and sum(map(len, u)):
                both = np.unique(np.stack((np.concatenate(u), np.concatenate(v)), axis=1), axis=0)
                yield out(both[:, 0], both[:, 1])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            rows = [c if c.dtype == object else c.astype(np.int64) for c in rows]
            if not len(rows[0]):
                continue
            if held and rows[0][-1] == held[0][0][0]:
                held.append(rows)
                continue
            rows = [np.concatenate(c) for c in zip(*held, rows, strict=True)]
            start = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            held = [[c[start:] for c in rows]]
            if start:
                yield from close([c[:start] for c in rows])
        if held:
            yield from close([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


PAIRS = "u long, v long, key long, n int, at int"


def _may_by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("a", "b"))
        differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        ok = pa.array(differ * (OF + TOP) <= batch.column("s").to_numpy() * (OF - TOP))
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], ["u", "v"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for batch in batches:
        texts = [zstandard.compress(t or b"", 3) for t in bytes_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(texts, pa.binary())], ["fp", "text"])


def _may_in_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, n, full) sorted by u, its own (no v) first -> the pairs whose whole bitmaps let them be similar."""
    own, size = b"", 0
    for batch in batches:
        found = []
        for u, v, n, full in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "n", "full")), strict=True):
            if v is None:
                own, size = full, n
            elif differ(own, full) * (OF + TOP) <= (size + n) * (OF - TOP):
                found.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])


def _starred(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The columns of ``of`` (fp, ...) for the v of each pair, and once for each u (v null) before them, sorted by u."""
    own = pairs.select(F.col("u").alias("fp")).distinct().join(of, "fp").withColumnRenamed("fp", "u").withColumn("v", F.lit(None).cast("long"))
    both = pairs.join(of.withColumnRenamed("fp", "v"), "v").unionByName(own)
    tasks = int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: what these rows hold grows when opened
    return both.repartition(tasks, "u").sortWithinPartitions("u", F.col("v").asc_nulls_first())


def _verify(width: int):
    """Rows (u, v, text) sorted by u, its own text (no v) first -> the pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grams = None
        for batch in batches:
            found = []
            for u, v, text in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("text"), strict=True):
                own = shingles(zstandard.decompress(text.as_py()), width)
                if v is None:
                    grams = own
                elif similar(grams, own):
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])
        trim()

    return run


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Those of ``pairs`` (u, v: set ids, u < v) that are similar by their whole sets; each set is made again from one text that has it."""
    for bits in ("few", "bits"):
        a, b = (sets.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col(bits).alias(y)) for x, y in (("u", "a"), ("v", "b")))
        both = pairs.join(a, "u").join(b, "v").select("u", "v", (F.col("nu") + F.col("nv")).alias("s"), "a", "b")
        pairs = materialize(both.mapInArrow(_may_by_bits, "u long, v long"), "may")
    pairs = materialize(_starred(pairs, sets.select("fp", "n", "full")).mapInArrow(_may_in_full, "u long, v long"), "may")
    ids = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    one = materialize(sets.join(ids, "fp").select("fp", F.col("own.doc_id").alias("_id"), F.col("own.th").alias("_th")), "own")
    one = broadcast_if_small(one, BROADCAST_BYTES)
    text = docs.select(F.col("doc_id").alias("_d"), "text", F.xxhash64("text").alias("_h"))
    text = text.join(one, text["_d"].eqNullSafe(one["_id"]) & (text["_h"] == one["_th"])).select("fp", "text").mapInArrow(_squeezed, "fp long, text binary")
    text = materialize(text.dropDuplicates(["fp"]), "texts")
    found = materialize(_starred(pairs, text).mapInArrow(_verify(width), "u long, v long"), "links")
    discard(text)
    release(found.sparkSession)
    return found


def links(read: DataFrame, docs: DataFrame, width: int = 5, most_all: int = 16, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """(u, v) links between set ids that connect all sets of similarity TOP / OF or more; ``read``: rows of :func:`_read`."""
    named = read.where("th is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("own"))
    sets = read.where("first is not null").groupBy("fp").agg(F.first("n").alias("n"), F.first("few").alias("few"), F.first("bits").alias("bits"), F.first("full").alias("full"))
    sets = materialize(sets.join(named, "fp"), "sets")
    tasks = buckets // 8  # named, for adaptive coalescing would size these stages by packed bytes
    packs = read.where("bucket is not null").select("bucket", "block", "seen").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    no = lambda **names: [F.lit(None).cast(k).alias(c) for c, k in names.items()]
    seen = packs.mapInArrow(_again, "block long, seen binary").select("*", *no(fp="long", n="long", first="binary"))
    held = read.where("first is not null").select("block", *no(seen="binary"), "fp", "n", "first")
    blocks = seen.unionByName(held).repartition(tasks, "block").sortWithinPartitions("block", F.col("seen").isNull())
    keyed = blocks.mapInArrow(_emit, KEYED).repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(keyed.mapInArrow(_pair_runs(most_all, False), PAIRS), "pairs")
    near = verified(found.where("v IS NOT NULL").select("u", "v").distinct(), sets, docs, width)
    again = found.where("v IS NULL").select("key", F.col("u").alias("fp"), "n", "at")
    if again.isEmpty():
        return near
    again = again.join(sets.select("fp", "bits"), "fp")
    forests = ROUNDS
    while True:
        label = components(near)
        release(label.sparkSession)
        rows = again.join(label, again.fp == label.node, "left").select("key", "fp", "n", "at", F.coalesce("root", "fp").alias("root"), "bits")
        rows = rows.repartition("key").sortWithinPartitions("key", "fp")
        more = materialize(rows.mapInArrow(_pair_runs(most_all, True, forests > 0), PAIRS).select("u", "v").distinct(), "pairs")
        if more.isEmpty():
            break
        held = verified(more, sets, docs, width)
        near = near.unionByName(held)
        asked, linked = more.count(), held.count()
        if not forests or asked == linked:
            break
        forests = forests - 1 if linked * 8 > asked else 0
    return near


def near_copies(docs: DataFrame, width: int = 5, most_all: int = 16) -> DataFrame:
    """(doc_id, th, fp: set id, component_id, keep_th) as of ``simhash.near_duplicates``."""
    spark, field = bounded_batches(docs).sparkSession, docs.schema["doc_id"].dataType
    shared = spark.sparkContext.broadcast(common_shingles(docs, width))
    release(spark)
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
    buckets = min(max(LEAST_BUCKETS, words // BUCKET_KEYS), MOST_BUCKETS)
    source = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    read = source.mapInArrow(_read(width, shared, buckets, to_arrow_type(field)), f"doc_id {field.simpleString()}, th long, {READ}")
    read = materialize(read, "shingles")
    found = links(read, docs, width, most_all, buckets)
    out = materialize(label_rows(read.where("th is not null").select("doc_id", "th", "fp"), found), "near")
    discard(read)
    return out


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (of equal rows one)."""
    return keep_one(docs, near_copies(docs, width))
