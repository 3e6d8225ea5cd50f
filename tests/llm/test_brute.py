"""Operators against plain loops over small tables, with null, empty, long, repeated and tied rows."""

import heapq
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import langid, media, quality, sharding
from genoloom.llm.decontam import ORACLE_SQL, contamination, op9_decontamination, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 5))) for _ in range(40)]
    out = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(1, 60, 40)]
    return [*out, out[3], out[3], None, None, "", " \n", "X", "ÀB 12", " ".join(rng.choice(vocabulary, 20_000)), out[5].upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)


def test_shards_are_longest_first(docs, texts):
    """Every group is an item of the heap at this grain, so loads are those of the plain schedule."""
    got = sharding.shard(docs, 5, 1 << 30).collect()
    groups = Counter()
    for t in texts:
        groups[t] += len((t or "").encode()) + 1
    heap = [(0, k) for k in range(5)]
    for size in sorted(groups.values(), reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, k))
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert sorted(loads.values()) == sorted(load for load, _ in heap)
    crc = Counter(None if t is None else zlib.crc32(t.encode()) for t in texts)
    assert Counter(r.text_crc32 for r in got) == crc and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert all(len({r.shard for r in got if r.text_crc32 == c}) == 1 for c in crc)
    again = sharding.shard(docs.withColumnsRenamed({"lang": "shard", "source": "g", "n_chars": "size"}), 5, 1 << 30).collect()
    assert sorted((r.text_crc32 or -1, r.shard) for r in again) == sorted((r.text_crc32 or -1, r.shard) for r in got)


def phrases(lane, train):
    """Greedy longest matches: one phrase is open at the start; a byte that can't go on closes it, one that ``train`` lacks is a phrase of its own."""
    n, now = 1, b""
    for k in range(len(lane)):
        c = lane[k : k + 1]
        if now + c in train:
            now += c
            continue
        n += bool(now)
        if c in train:
            now = c
        else:
            n, now = n + 1, b""
    return n


def test_language_costs_are_a_naive_parse(spark, docs, texts):
    rng = np.random.default_rng(3)
    train = {lang: langid.normal(" ".join("".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(150))) for lang, letters in (("xx", "abcé"), ("yy", "cdeü"), ("zz", "aeb"))}
    model = langid.Model(train)
    clean = [langid.normal(t) for t in texts] + [b"q", b"abqab", train["xx"], b"ab" * 3000, b"a" * 2500, b"q" * 2048, train["yy"] * 7]
    cost, closed = model.costs(clean)
    for i, t in enumerate(clean):
        for k, lang in enumerate(model.langs):
            n = phrases(t, train[lang]) if t else 0
            assert abs(cost[i, k] - n * np.log2(len(train[lang]) + 1) / max(len(t), 1)) < 1e-9
            assert abs(closed[i, k] - (n - (t != b"")) / max(len(t), 1)) < 1e-12
    got = langid.predict(docs, model).collect()
    assert len(got) == len(texts)
    best = {t: model.langs[int(cost[i].argmin())] for i, t in enumerate(texts)}
    assert all(r.lang_pred == (best[r.text] if r.text and any(c.isalpha() for c in r.text) else "und") for r in got)


def test_quality_scores_are_table_sums(spark, docs, texts):
    labels = spark.createDataFrame([(i, (i // 2) % 2, 0) for i in range(45)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, round(r.score, 12)) for r in quality.score(docs, labels, "quality", F.col("doc_id") % 5 != 0, rounds=8, pair_rounds=3).collect()}
    x = np.array([quality.features((t or "").encode()) for t in texts])
    known = [i for i in range(45) if i % 9 and i % 5]
    order = {r.doc_id: r.h for r in spark.range(60).select(F.col("id").alias("doc_id"), F.xxhash64("id", F.lit(7)).alias("h")).collect()}
    known.sort(key=lambda i: order[i])
    gam = quality.Gam(rounds=8, pair_rounds=3).fit(x[known], np.array([(i // 2) % 2 for i in known], float))
    for i, v in enumerate(x):
        f = gam.base + sum(t[sum(a <= b for a in e)] for e, t, b in zip(gam.edges, gam.tables, v, strict=True))
        f += sum(t[sum(e <= v[a] for e in gam.coarse[a]), sum(e <= v[b] for e in gam.coarse[b])] for a, b, t in gam.pairs)
        assert (i if i % 9 else None, round(1 / (1 + np.exp(-f)), 12)) in got
    assert quality.score(docs.where("false"), labels, "quality", F.lit(True)).count() == 0


def brute_hits(text, items, window):
    w = words((text or "").encode())
    hit, found = set(), set()
    for name, item in items:
        v = words((item or "").encode())
        m = min(len(v), window)
        for a in range(len(v) - m + 1 if v else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == v[a : a + m]:
                    hit |= set(range(k, k + m))
                    found.add(str(name))
    return len(w), len(hit), found


@pytest.mark.parametrize("part_words", [1 << 17, 6])
def test_decontamination_is_brute_force(spark, docs, texts, part_words):
    rng = np.random.default_rng(8)
    some = [(t or "").split() for t in texts[:40]]
    items = [(k, " ".join(some[k][a : a + int(n)])) for k, (a, n) in enumerate(zip(rng.integers(0, 20, 30), rng.integers(0, 14, 30), strict=True))]
    items += [(40, items[3][1]), (41, None), (42, "  .. "), (43, "x"), (44, "éa"), (45, (texts[5] or "").upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = docs.where(F.length(F.coalesce("text", F.lit(""))) < 1000)
    for r in contamination(small, bench, 5, part_words).collect():
        n, hit, found = brute_hits(r.text, items, 5)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert sum(s.end - s.first for s in r.spans) == hit


def test_decontamination_query_is_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    rows = lambda df: sorted(df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(op9_decontamination(spark, SF).toPandas()) == rows(con.sql(ORACLE_SQL).df())


def test_frames_are_decoded_alike():
    rng = np.random.default_rng(6)
    samples = np.concatenate([rng.integers(0, 256, (3, 12, 16)), np.full((1, 12, 16), 255), np.indices((12, 16)).sum(0)[None]]).astype(np.uint8)
    frames = media.encode_frames(samples)
    fast = media.decode_frames(frames)
    assert (fast == samples).all()
    diff = np.stack([media._decode_bits(f) for f in frames])
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    assert ((np.cumsum(diff, axis=2) & 0xFF) == samples).all()


def test_clips_are_rows(spark):
    dark, light = np.full((20, 12, 16), 10, np.uint8), np.full((15, 12, 16), 200, np.uint8)
    two = media.write_avi(media.encode_frames(np.concatenate([dark, light])))
    one = media.write_avi(media.encode_frames(dark))
    rows = [(1, two, "a"), (2, one, "b"), (3, None, "c"), (4, b"", "d"), (5, b"RIFFxx", "e"), (6, two, "f"), (None, one[:40], None)]
    frame = spark.createDataFrame(rows, "doc_id long, avi binary, clip string")
    got = media.clip_rows(frame)
    assert got.columns == ["doc_id", "clip", *media.CLIP]
    out = sorted(([*map(str, r)] for r in got.collect()), key=lambda r: (r[1], r[2]))
    step = 1 / media.RATE
    want = [("1", "a", "0", 0, 20), ("1", "a", "1", 20, 35), ("2", "b", "0", 0, 20), ("6", "f", "0", 0, 20), ("6", "f", "1", 20, 35)]
    assert [(r[0], r[1], r[2], int(r[5]), int(r[6])) for r in out if r[2] != "None"] == want
    assert all(abs(float(r[3]) - int(r[5]) * step) < 1e-9 and abs(float(r[4]) - int(r[6]) * step) < 1e-9 for r in out if r[2] != "None")
    bad = {r[1]: r[7] for r in out if r[2] == "None"}
    assert set(bad) == {"c", "d", "e", "None"} and all(v != "None" for v in bad.values())
    assert media.clip_rows(frame.where("false")).count() == 0
