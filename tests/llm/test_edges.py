"""Queries over tables with columns that clash with their results, long texts and runs of one byte."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import simhash, suffix_dedup
from genoloom.llm.decontam import contamination
from genoloom.llm.queries import QUERIES
from tests.llm.test_brute import brute_hits
from tests.llm.test_ops import brute_print, brute_repeats

TEXTS = ["one two three four five six seven eight nine ten eleven", None, "", "   ", "one two three four five six seven eight nine ten eleven", "a b", "Ünï cödé"]
CLASH = ["score", "held_out", "predicted", "feature", "n_bytes", "payload_bytes", "size", "law", "shard", "component_id", "fingerprint", "n_hit", "item_id", "h", "key", "_k", "words"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same rows without and with further columns."""
    out = []
    for name, extra in (("plain", []), ("clash", CLASH)):
        d = str(tmp_path_factory.mktemp(name))
        more = [F.lit("x").alias(c) for c in extra]
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
        docs.select("*", *more).write.parquet(f"{d}/documents.parquet")
        labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
        labels.select("*", *more).write.parquet(f"{d}/labels.parquet")
        bench = spark.createDataFrame([(1, TEXTS[0]), (2, None), (3, "a b")], "item_id long, text string")
        bench.select("*", *[m for m, c in zip(more, extra, strict=True) if c != "item_id"]).write.parquet(f"{d}/benchmark.parquet")
        out.append(d)
    return out


@pytest.mark.parametrize("name", ["op1_sharding", "op2_suffix_dedup", "op3_quality", "op4_simhash", "op7_media", "op9_decontamination"])
def test_further_columns_change_nothing(spark, folders, name):
    plain, clash = ({tuple(str(v) for v in r) for r in QUERIES[name](spark, d).collect()} for d in folders)
    assert plain == clash and len(plain) == len(TEXTS)


def test_runs_of_one_byte(spark):
    texts = [b"a" * 3000, b"a" * 450 + b"b" + b"a" * 399, b"c" * 400, b"", b"a" * 399, b"d" * 401]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, with_bytes=False).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))
    assert got[0][1] == 3000 and got[2][1] == 0 and got[5][3] == hashlib.sha256(b"").hexdigest()


def test_short_periods_are_few_rows(spark):
    """Texts of short periods, joined and apart, equal a brute force; their runs are few rows however long they are."""
    line = bytes(range(97, 120)) + b" "
    texts = [b"ab" * 700 + b"x" + b"ab" * 250, b"ba" * 205, line * 40, b"-" * 500 + line * 20 + b"-" * 450, b"xyz" * 134, b"e" * 400 + b"f" * 400 + b"e" * 400, b"ab" * 200, b"g" * 401 + b"h" * 300 + b"g" * 10]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, with_bytes=False).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))
    for text in (b"a" * 3_000_000, b"abc" * 1_000_000):
        part = np.frombuffer(text, np.uint8)
        assert len(suffix_dedup._counted(*suffix_dedup.anchors(part[: 1 << 20], np.array([0, 1 << 20]), 400, 200), 400)[0]) < 10


def test_passages_count_from_400_bytes(spark):
    """A shared passage of 57 words goes at 400 bytes and stays at 399; n_bytes is the input's size either way."""
    rng = np.random.default_rng(12)
    short, full = (b" ".join(bytes(rng.integers(97, 123, 6, dtype=np.uint8)) for _ in range(57)) + b"." * k for k in (1, 2))
    assert (len(short), len(full)) == (399, 400) and min(len(short.split()), len(full.split())) > 50
    texts = [b"A" + short + b"B", b"C" + short + b"D", b"E" + full + b"F", b"G" + full + b"H"]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, with_bytes=False).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))
    assert [got[i][:3] for i in range(4)] == [(401, 0, 0)] * 2 + [(402, 400, 1)] * 2


def test_long_texts(spark):
    rng = np.random.default_rng(11)
    some = [f"w{zlib.crc32(bytes([k])) % 997}" for k in range(200)]
    long = " ".join(rng.choice(some, 120_000))
    words = long.split()
    items = [(1, " ".join(words[100_000:100_012])), (2, " ".join(words[119_990:]))]
    docs = spark.createDataFrame([(0, long), (1, long), (2, " ".join(words[:5]))], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_hits(" ".join(words[99_000:]), items, 10)
    assert (got[0].n_words, got[0].n_hit, got[0].n_items) == (120_000, want[1], len(want[2])) == (120_000, got[1].n_hit, got[1].n_items) and got[2].n_hit == 0 and want[1] >= 22
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[0].fp == prints[1].fp and prints[0].fp % (1 << 64) == brute_print(long) and prints[1].component_id == 0
