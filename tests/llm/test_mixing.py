"""op10 against plain loops: targets, permutation, draw, slots and the words taken of each document."""

import math
import random
import re
from collections import Counter

import xxhash

from genoloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def chained(*values):
    """Spark's xxhash64: each value hashed with the hash before it as seed."""
    h = 42
    for v, width in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(width, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def permuted(x, epoch, n, src, rounds=24, seed=17):
    for r in range(rounds):
        other = (chained((seed, 8), (src, 0), (epoch, 8), (r, 4)) % n - x) % n
        if chained((seed + 1, 8), (src, 0), (epoch, 8), (r, 4), (max(x, other), 8)) & 1:
            x = other
    return x


def plain_targets(sizes, most=3):
    """src -> target: shares by weight, those above their cap cut to it and the rest shared again."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    done, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in sizes if s not in done]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return done | {s: left * weight[s] / total for s in open_}
        for s in over:
            done[s] = float(most * sizes[s])
        left -= sum(done[s] for s in over)


def plain_slots(src, size, target, block, n_out, most=3, seed=17):
    """[(shard, idx, take)] of one source: slots go to shards as often as their hashes choose them, in the shards' order."""
    n = -(-size // block)
    length = lambda i: size - (n - 1) * block if i == n - 1 else block
    words, out, j = min(round(target), most * size), [], 0
    while words > 0:
        i = permuted(j % n, j // n, n, src)
        out.append((i, min(words, length(i))))
        words -= length(i)
        j += 1
    counts = Counter(chained((seed + 2, 4), (src, 0), (k, 8)) % n_out for k in range(len(out)))
    shards = [s for s in sorted(counts) for _ in range(counts[s])]
    return [(s, *x) for s, x in zip(shards, out, strict=True)]


def sample():
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 3, 40, 200]), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(150)]
    return [*rows, (900, None, "b"), (901, None, "nothing"), (902, " \t", "blank"), (903, "x", "tiny"), (904, "", None)]


def test_equals_plain_loop(spark):
    rows = sample()
    block, n_out = 16, 5
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out, slots, _ = mixing.mix(df, block=block, n_out=n_out)
    size = {d: len(re.findall(mixing.WORD, t or "")) for d, t, _ in rows}
    name = {d: "1" if s is None else "0" + s for d, _, s in rows}
    sizes = Counter()
    for d in size:
        sizes[name[d]] += size[d]
    targets = plain_targets(sizes)
    want = {s: plain_slots(s, sizes[s], targets[s], block, n_out) for s in sizes if sizes[s]}
    assert Counter((r.shard, r.src, r.idx, r["take"]) for r in slots.collect()) == Counter((k, s, i, t) for s, v in want.items() for k, i, t in v)
    begin, at = {}, Counter()
    for d in sorted(size, key=lambda d: (chained((d, 8), (name[d][1:] if name[d] != "1" else None, 0)) % 256, d)):
        begin[d] = at[name[d]]
        at[name[d]] += size[d]
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(size)
    for d, r in got.items():
        taken = sum(max(0, min(begin[d] + size[d], i * block + t) - max(begin[d], i * block)) for _, i, t in want.get(name[d], []))
        assert (r.size, r.source_size, r.taken) == (size[d], sizes[name[d]], taken) and math.isclose(r.target, targets[name[d]])
        assert r.taken <= 3 * r.size
    for s in sizes:
        assert sum(r.taken for d, r in got.items() if name[d] == s) == min(round(targets[s]), 3 * sizes[s])


def test_sources_without_words(spark):
    rows = [(1, "x y", "a"), (2, None, "b"), (3, " \n", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(df)[0].collect()) == [(1, 2, 2.0, 2), (2, 0, 0.0, 0), (3, 0, 0.0, 0)]
    assert [r.doc_id for r in mixing.mixed_documents(df).collect()] == [1]
    assert sorted(r.taken for r in mixing.mix(df.where("doc_id > 1"))[0].collect()) == [0, 0]


def test_the_draw_is_in_the_plan(spark):
    out, _, _ = mixing.mix(spark.createDataFrame(sample(), SCHEMA))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "draw-" in out._jdf.queryExecution().executedPlan().toString() or "shard" in plan
