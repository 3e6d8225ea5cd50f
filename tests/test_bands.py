"""Pairs by diagonals over windows, and blocks chosen by windows, against loops over whole chromosomes."""

import random

import numpy as np
import pytest

from genoloom.operators import bands, blocks, genotypes


def loop(rows):
    """Longest first, of equal ones the later; none with an end in one taken before."""
    out = []
    for r in sorted(rows, key=lambda r: (r[3] - r[1], r[1], r[2], r[3], r[4]), reverse=True):
        if not any((t[1], t[2]) <= e <= (t[3], t[4]) for t in out for e in ((r[1], r[2]), (r[3], r[4]))):
            out.append(r)
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_chains_over_many_windows_are_chosen_as_in_one(spark, seed):
    rng = random.Random(seed)
    pos = sorted(rng.choices(range(5000), k=400)) if seed else list(range(0, 4000, 10))
    rows = []
    for a in range(len(pos)):
        for b in range(a + 1, len(pos)):
            if pos[b] - pos[a] > 100:
                break
            if rng.random() < 0.3 if seed else b - a == 5:  # without a seed each waits for the next, along the whole chromosome
                rows.append(("c", pos[a], a, pos[b], b, b - a + 1))
    df = spark.createDataFrame(rows, blocks.CANDIDATE)
    assert sorted(tuple(r) for r in blocks.choose(df, 100).collect()) == loop(rows)


def test_a_chain_is_never_one_group(spark):
    """Candidates that chain a chromosome together reach a task by windows."""
    rows = [(v, "1", 1000 * v, s, 2 * (s % 2)) for v in range(1000) for s in range(40)]
    df = spark.createDataFrame(rows, "v long, chr string, pos long, smp int, dos int")
    per = bands.windows(genotypes.placed(df), 20_000).groupBy("chr", "b").count().agg({"count": "max"}).first()[0]
    assert per <= 20 * (bands.WIDTHS + 1) + 1
    assert blocks.candidates(genotypes.placed(df), 20_000, False).count() == sum(min(20, 999 - a) for a in range(1000))


@pytest.mark.parametrize("batch", [1, 50, 1 << 14])
def test_pairs_do_not_rest_on_batches(spark, batch, monkeypatch):
    rng = np.random.default_rng(5)
    pos = np.sort(rng.integers(-500, 6000, 150))
    rows = [(i, "1" if i % 3 else "2", int(p), s, None if rng.random() < 0.1 else float(rng.integers(0, 3)) / (1 if i % 2 else 7)) for i, p in enumerate(pos) for s in range(70)]
    df = spark.createDataFrame(rows, "v long, chr string, pos long, smp int, dos double")
    monkeypatch.setattr(bands, "MOST_LEVELS", 8 if batch > 1 else 2)
    monkeypatch.setattr(bands, "BATCH", batch)
    x = np.full((150, 70), np.nan)
    for v, _, _, s, d in rows:
        x[v, s] = np.nan if d is None else d
    got = {(r.i, r.j): (r.n, r.r2) for r in genotypes.r2(df, 97).collect()}
    want = {(i, j) for i in range(150) for j in range(150) if bool(i % 3) == bool(j % 3) and (pos[i], i) < (pos[j], j) and pos[j] - pos[i] <= 97}
    assert set(got) == want
    for (i, j), (n, value) in got.items():
        both = ~np.isnan(x[i]) & ~np.isnan(x[j])
        assert n == both.sum() and abs(value - np.corrcoef(x[i][both], x[j][both])[0, 1] ** 2) < 1e-9


def test_known_rows_are_told_once():
    seen = []

    def of(rows):
        seen.append(len(rows[0]))
        return [rows[0] * 2.0 + rows[1]]

    known, rng = bands.Known(of), np.random.default_rng(1)
    for _ in range(5):
        a, b = rng.integers(0, 6, 500), rng.integers(-3, 3, 500)
        assert (known([a, b])[0] == a * 2.0 + b).all()
    assert sum(seen) <= 36
