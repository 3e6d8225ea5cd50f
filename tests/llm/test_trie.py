"""op13 against a plain trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from genoloom.llm.trie import encoded, op13_prefix_trie, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt_plain(rows, family=5, most=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % most for c in own}
    return {c: own.get(c - c % family, [])[: h[c]] + t[h[c] :] for c, t in own.items()}


def plain(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves = sum(out[q][5] for q in children[p]) or 1
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, own + sum(out[q][6] for q in children[p]), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[0], r[1]))


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def sample(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"é{rng.choice('ab')}" * rng.randint(1, 2)))
    return rows


@pytest.mark.parametrize("local", [1, 30, 1 << 14])
def test_equals_plain_trie(spark, local):
    rows = sample(150)
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(12)]  # copies
    rows += [(c, t, "user", f"long {t}") for c in range(300, 340, 5) for t in range(60)] + [(c, 60, "user", f"own {c}") for c in range(300, 340, 5)]  # long common beginnings
    rows += [(400 + 5 * k, t, "user", "x") for k in range(9) for t in range(k + 1)]  # beginnings of each other
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(prefix_trie(rebuilt(encoded(df)), local=local)) == plain(rebuilt_plain(rows))


@pytest.mark.parametrize("local", [1, 1 << 14])
def test_sequences_as_they_are(spark, local):
    rows = sample(60, 9)
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    assert got(prefix_trie(encoded(spark.createDataFrame(rows, SCHEMA)), local=local)) == plain(convs)


def test_nulls_ties_repeats_and_empty(spark, tmp_path):
    rows = [(1, None, None, None), (1, 0, "", None), (1, 0, "", ""), (2, 0, None, ""), (2, 1, "u", "a"), (None, 0, "u", "a"), (3, 5, "u", "x"), (3, 5, "u", "x"), (-4, 0, "u", "y"), (7, 0, "u", "u" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as d", "3 as size", "4 as m")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    want = rebuilt_plain([r for r in rows if r[0] != -4])
    found = [r for r in got(op13_prefix_trie(spark, str(tmp_path)))]
    assert found[0][3] == 5 and found[0][0] == -4
    assert got(prefix_trie(rebuilt(encoded(df.where("conv_id is null or conv_id <> -4"))))) == plain(want)
    assert got(prefix_trie(rebuilt(encoded(df.limit(0))))) == []
    turnless = spark.createDataFrame([(1, [], []), (2, [], []), (3, [5], [2])], "conv_id long, ids array<long>, sizes array<long>")
    assert got(prefix_trie(turnless, local=1))[0][:7] == (1, 0, None, 3, 1, 1, 0)
