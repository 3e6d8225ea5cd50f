import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genoloom.llm import mixing, sharding
from genoloom.llm.neardup import shingles, similar

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["_h", "_k", "_t", "_r", "_n", "_id", "_c", "score", "lang_pred", "foreign", "spans", "n_hit", "c0", "src", "rh", "th", "fp", "size", "shard", "idx", "doc"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    words = {"en": "the cat sat on a mat and then it ran off with some old bread for an hour".split(), "de": "der hund lief schnell und die katze sass auf dem dach bis zum abend nach haus".split()}
    out = []
    for i in range(30):
        lang = "en" if i % 2 else "de"
        out.append((i, " ".join(rng.choice(words[lang], 60)), lang, f"s{i % 4}" if i % 6 else None, i))
    base = out[3][1].split()
    out.append((40, " ".join([*base[:-1], "zebra"]), "en", "s1", 40))  # a near copy of 3
    out += [(41, None, None, None, None), (42, "", "en", "s0", 0), (43, "12 34 !", "de", "s1", 7), (44, "\u0436\u0449\u044f \u0444\u044b\u0432\u0430 " * 9, None, "s2", 1)]
    out += [out[5], (5, out[5][1], "de", "s9", 1), (None, out[6][1], "de", "s1", 1), (None, "only a null id has the old bread that the cat ran off with", "en", "s1", 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("*", *[F.concat(F.lit(c), F.col("n_chars").cast("string")).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, rows):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, " ".join(rows[7][1].split()[10:25])), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def whole(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_language_stage(spark, docs, sf_dir, rows):
    out = STAGES["language_id"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    gone = whole(docs) - whole(out)
    assert not whole(out) - whole(docs) and sorted(str(r[0]) for r in gone.elements()) == ["41", "42", "43", "44", "None"]


def test_near_dedup_stage(spark, docs, sf_dir):
    out = STAGES["near_dedup"](spark, docs, sf_dir)
    assert out.columns == docs.columns and whole(out) == whole(STAGES["near_dedup"](spark, docs.repartition(7), sf_dir))
    have, kept = whole(docs), whole(out)
    assert not kept - have and max(kept.values()) == 1
    sets = [shingles((r[1] or "").encode()) for r in kept]
    assert not any(similar(a, b) for i, a in enumerate(sets) for b in sets[:i])  # also the texts without words: one is left
    for r in have:
        assert any(similar(shingles((r[1] or "").encode()), s) for s in sets)
    assert {r[0] for r in kept} >= {3, 5, 6} and 40 not in {r[0] for r in kept}


def test_decontamination_stage(spark, docs, sf_dir):
    out = STAGES["benchmark_decontamination"](spark, docs, sf_dir)
    assert out.columns == docs.columns and not whole(out) - whole(docs)
    assert {r[0] for r in whole(docs) - whole(out)} == {7}


def test_mixing_stage(spark, docs, sf_dir):
    out = STAGES["mixing"](spark, docs, sf_dir)
    assert out.columns == docs.columns and whole(out) == whole(STAGES["mixing"](spark, docs, sf_dir))
    have, got = whole(docs), whole(out)
    assert got.keys() <= have.keys()
    rows = mixing.mix(docs)[0].collect()
    size = {(r[0], r[1], r[3]): len((r[1] or "").split()) for r in have}
    for source in {r.src for r in rows}:
        own = [r for r in rows if r.src == source]
        name = None if source[0] == "1" else source[1:]
        words = sum(n * size[r[0], r[1], r[3]] for r, n in got.items() if r[3] == name)
        assert abs(words - own[0].target) <= 60 * max(1, len(own)) and sum(r.taken for r in own) == int(own[0].target + 0.5)
    for r, n in have.items():  # rows that differ in any column have their own count, of up to three times each
        assert got[r] <= 3 * n


def test_sharding_stage(spark, docs, sf_dir):
    out = STAGES["sharding"](spark, docs, sf_dir).collect()
    assert len(out) == docs.count()
    for k in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_no_rows(spark, docs, sf_dir, name):
    assert STAGES[name](spark, docs.where("false"), sf_dir).count() == 0


def test_run_is_the_stages_one_by_one(spark, sf_dir, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame([tuple(r) for r in stage(spark, frame, sf_dir).collect()], SCHEMA)
    last = sharding.shard(frame)
    pick = lambda f: sorted((str(r.doc_id), r.size, r.shard) for r in f.collect())
    assert pick(corpus_pipeline.run(spark, sf_dir)) == pick(last) != []


def test_draw_by_brute_force(spark, docs):
    """Slots: whole epochs over all blocks and a cut last one; shards near their share; taken words as the slots' pieces have them."""
    rows, slots, pieces = mixing.mix(docs, block=4, n_out=4)
    rows, slots, pieces = rows.collect(), slots.collect(), pieces.collect()
    cut = collections.defaultdict(list)
    for s in slots:
        cut[s.src, s.idx].append(s.take)
    taken = collections.Counter()
    for p in pieces:
        if p.idx is not None:
            taken[p.src, p.h, p.rn] += sum(max(0, min(t, p.hi) - p.lo) for t in cut[p.src, p.idx])
    assert all(taken[r.src, r.h, r.rn] == r.taken for r in rows)
    by = collections.Counter(s.shard for s in slots)
    assert set(by) == {0, 1, 2, 3} and all(abs(n - len(slots) / 4) < 5 * (len(slots) * 3 / 16) ** 0.5 for n in by.values())


def test_near_dedup_keeps_one_of_a_simhash_component(spark, sf_dir):
    """Texts whose fingerprints differ in 4 bits or fewer and whose shingle sets are too far apart for the exact step."""
    from genoloom.llm.neardup import shingles, similar
    from genoloom.llm.simhash import fingerprint

    base = ["w%d" % (i % 7) for i in range(400)]
    other = [*base[:-12], *("z%d" % i for i in range(12))]
    a, b = (" ".join(x) for x in (base, other))
    assert bin(fingerprint(a.encode()) ^ fingerprint(b.encode())).count("1") <= 4 and not similar(shingles(a.encode()), shingles(b.encode()))
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in STAGES["near_dedup"](spark, docs, sf_dir).collect()] == [1]
