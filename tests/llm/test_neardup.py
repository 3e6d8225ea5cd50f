import numpy as np
import pytest

import corpus_pipeline
from genoloom.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(400)]
    out = []
    for k in range(12):
        base = rng.choice(words, 120).tolist()
        out.append(" ".join(base))
        for changed in (1, 2, 3, 5):  # each changed word changes five shingles
            some = list(base)
            for i in rng.choice(np.arange(6, 114), changed, replace=False):
                some[i] = "zz" + str(k)
            out.append(" ".join(some))
        out.append(" ".join(rng.choice(words, 60).tolist() + ["one line that every text of this kind ends with"] * 3))
    return [*out, out[0], None, "", " \n", "two words", "Two  words", out[0].upper()]


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            group[i] = min(group[j] for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b))
    return group


@pytest.mark.parametrize("most_all", [16, 2])
def test_near_copies_are_brute_force(spark, texts, most_all):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    want = brute(texts)
    assert {r.doc_id: r.component_id for r in neardup.near_copies(docs, most_all=most_all).collect()} == dict(enumerate(want))


def test_pipeline_stage_keeps_one_of_near_copies(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts)))
    assert neardup.deduplicate(docs.where("false")).count() == 0


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 20, n).astype(np.uint64))
        drop = int(rng.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(1 << 20, 1 << 21, int(rng.integers(0, len(a) // 4 + 1))).astype(np.uint64))))
        common = np.unique(rng.choice(a, len(a) // 2 + 1))
        rank = rng.permutation(len(common)) + 1
        assert neardup.similar(a, b) == (5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
        if neardup.similar(a, b):
            assert len(np.intersect1d(neardup.prefix(a, common, rank), neardup.prefix(b, common, rank)))
