"""op12: whole ids against the tokenizer, places, padding, and the packer against its own law."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from genoloom.llm.packing import Words, op12_packing, pack, shortest_pack_first  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Don't STOP!", "á b", "x ́y", "≠ z", "ÀÉ. Straße, ΣΑΣ Σ.", "İstanbul,", "1,2.3", "it's 'sup?", "K.́", "\x1c\x1d a", "é. 中文， ok.", "<|endoftext|> q", "e.́ x!?", "ẞ.", "K. Å ǅ ÿ ß× a÷", "", " \n\t "]


def test_words_equal_whole_texts():
    words, whole = Words(PATH), Tokenizer.from_file(PATH)
    for text in [*ODD, " ".join(ODD), "\n".join(ODD * 50)]:
        assert words(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packs_hold_the_histogram():
    rng = np.random.default_rng(1)
    for size, lengths in ((8, rng.integers(1, 8, 300)), (64, rng.integers(1, 64, 1000)), (2048, rng.integers(1, 2048, 3000)), (16, np.ones(1000, int)), (16, np.full(7, 15))):
        histogram = Counter(lengths.tolist())
        held, packs = Counter(), 0
        for n, room, runs in shortest_pack_first(histogram, size):
            assert n > 0 and sum(a * b for a, b in runs) + room == size and room >= 0
            assert [a for a, _ in runs] == sorted((a for a, _ in runs), reverse=True)
            packs += n
            for length, times in runs:
                held[length] += n * times
        assert held == histogram
        # the plain law, one length at a time: into the pack with the most room, else a new one
        rooms: list[int] = []
        for length in sorted(lengths.tolist(), reverse=True):
            k = max(range(len(rooms)), key=rooms.__getitem__, default=-1)
            if k >= 0 and rooms[k] >= length:
                rooms[k] -= length
            else:
                rooms.append(size - length)
        assert sorted(rooms) == sorted(r for n, r, _ in shortest_pack_first(histogram, size) for _ in range(n))


def checked(rows, texts, size=2048, slack=16):
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, ids.tobytes()] += 1
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    short = 0
    for parts in sequences.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at and length > 0
            at += length
        assert at <= size
        short += at & (at - 1) != 0 and size - at > slack
    assert short == 0
    return docs, want


def test_pieces_of_odd_texts(spark):
    long = " ".join(f"word{i} and,so on." for i in range(4000))
    texts = [(i, t) for i, t in enumerate([*ODD, None, long, "a b " * 5000, "a b " * 5000])] + [(3, "twice"), (3, "twice")] + [(None, "no id")] + [(100 + i, "some words " * (i % 90)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as start", "3 as rank", "4 as task").repartition(5)
    rows = pack(df, PATH).collect()
    docs, want = checked(rows, texts)
    single = {d for d, n in Counter(d for d, _ in texts).items() if n == 1}
    for (d, n), parts in docs.items():
        if d in single:
            parts.sort(key=lambda r: r.start)
            ids = b"".join(r.ids for r in parts)
            assert (d, ids) in want and len(ids) == 4 * n and [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
    assert sum(len(r.ids) for r in rows) == sum(len(k[1]) * n for k, n in want.items())
    assert not pack(df.limit(0), PATH).collect()


@pytest.mark.parametrize("slack", [0, 5, 100])
def test_small_sequences_and_slack(spark, slack):
    texts = [(i, "w " * (i * 7 % 41)) for i in range(200)]
    rows = pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), PATH, size=32, slack=slack).collect()
    docs, _ = checked(rows, texts, 32, slack)
    assert len(docs) == 200 and sum(r.length for r in rows) == sum(i * 7 % 41 + 1 for i in range(200))


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "One two", "en"), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [*Tokenizer.from_file(PATH).encode("One two", add_special_tokens=False).ids, 1]
    rows = {r.doc_id: r for r in op12_packing(spark, str(tmp_path)).collect()}
    assert rows[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and rows[1].doc_tokens == len(ids) == rows[1].length
    assert rows[2].ids_crc32 == zlib.crc32(b"\1\0\0\0") and rows[2].doc_tokens == 1
