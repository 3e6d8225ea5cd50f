"""Average linkage by rounds of Spark jobs against one pair a step."""

import numpy as np
import pytest

from genoloom.operators import tree


def literal(names, d):
    """{members: height} of every join: means over all pairs of members, the nearest two clusters a step, of equal ones the first by least members."""
    groups, out = [[k] for k in range(len(names))], {}
    while len(groups) > 1:
        near = [(round(float(np.mean([d[x, y] for x in a for y in b])), 12), a[0], b[0], a, b) for a in groups for b in groups if a[0] < b[0]]
        x, _, _, a, b = min(near)
        groups = [g for g in groups if g not in (a, b)] + [sorted(a + b)]
        out[frozenset(a + b)] = x / 2
    return out


def joins(t):
    """{members: height} of a tree's inner nodes."""
    kids, n = t.children(), len(t.tips)
    below, high = {k: frozenset([k]) for k in range(n)}, dict.fromkeys(range(n), 0.0)
    for x in sorted(kids):
        below[x] = frozenset().union(*(below[c] for c, _ in kids[x]))
        c, w = kids[x][0]
        high[x] = high[c] + w
    return {below[x]: high[x] for x in kids}


def table(spark, names, d, keep=lambda i, j: True):
    n = len(names)
    return spark.createDataFrame([(names[i], names[j], float(d[i, j])) for i in range(n) for j in range(i + 1, n) if keep(i, j)], "s1 string, s2 string, dist double")


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("kind", ["plain", "ties", "equal"])
def test_rounds_are_single_steps(spark, kind):
    rng = np.random.default_rng(5)
    n = 13
    d = {"plain": rng.random((n, n)), "ties": rng.integers(1, 5, (n, n)) / 4, "equal": np.full((n, n), 0.1)}[kind]
    d = np.triu(d, 1) + np.triu(d, 1).T
    names = [f"s{k}" for k in range(n)]
    want = literal(names, d)
    same(joins(tree.upgma(names, d)), want)
    frame = table(spark, names, d)
    for most in (1, 4, 1000):
        same(joins(tree.average_linkage(frame, most)), want)


def test_absent_pairs_are_the_greatest_distance(spark):
    rng = np.random.default_rng(6)
    n = 10
    d = np.triu(rng.integers(1, 9, (n, n)) / 8, 1)
    names = [f"s{k}" for k in range(n)]
    keep = lambda i, j: (i + j) % 3 > 0 or (i, j) == (0, 9)
    frame = table(spark, names, d, keep)
    far = max(d[i, j] for i in range(n) for j in range(i + 1, n) if keep(i, j))
    full = np.array([[0 if i == j else d[min(i, j), max(i, j)] if keep(min(i, j), max(i, j)) else far for j in range(n)] for i in range(n)])
    for most in (1, 5, 1000):
        same(joins(tree.average_linkage(frame, most)), literal(names, full))
    t = tree.average_linkage(frame, 1)
    assert tree.cut(t, 3) == tree.clusters(names, full, 3)


def test_few_samples(spark):
    one = spark.createDataFrame([("a", "b", 0.5)], "s1 string, s2 string, dist double")
    assert tree.average_linkage(one, 1).edges == [(2, 0, 0.25), (2, 1, 0.25)] == tree.average_linkage(one).edges
    with pytest.raises(ValueError):
        tree.average_linkage(one.where("false"))
