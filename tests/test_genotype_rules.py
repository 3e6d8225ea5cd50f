import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from genoloom.functions.genotype import hmp_to_gt, hmp_to_gts
from genoloom.operators import blocks, genotypes

CALLS = "v long, chr string, pos long, smp int, dos double"


@pytest.fixture(scope="module")
def x():
    """Calls of 9 variants on two chromosomes and 150 samples (three words); null where missing."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (9, 150)).astype(float)
    x[4] = x[3]
    x[rng.random(x.shape) < 0.1] = np.nan
    return x


def table(spark, x):
    return spark.createDataFrame([(i, str(i // 6), 100 * (i % 6 + 1), j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(x)], CALLS)


def near(x, reach=300):
    return [(i, j) for i, j in itertools.permutations(range(len(x)), 2) if i // 6 == j // 6 and 0 < (j - i) * 100 <= reach]


def test_pairs_stay_in_their_chromosome(spark, x):
    got = {(r.i, r.j): r for r in genotypes.r2(table(spark, x), 300).collect()}
    assert sorted(got) == sorted(near(x))
    for (i, j), r in got.items():
        ok = ~np.isnan(x[i]) & ~np.isnan(x[j])
        assert r.n == ok.sum() and abs(r.r2 - np.corrcoef(x[i][ok], x[j][ok])[0, 1] ** 2) < 1e-9


def test_r2_of_other_ploidies(spark, x):
    y = x / 3
    for r in genotypes.r2(table(spark, y), 300).collect():
        ok = ~np.isnan(y[r.i]) & ~np.isnan(y[r.j])
        assert abs(r.r2 - np.corrcoef(y[r.i][ok], y[r.j][ok])[0, 1] ** 2) < 1e-9


def test_haplotypes_need_diploid_calls(spark, x):
    with pytest.raises(PySparkException, match="diploid"):
        genotypes.hap_counts(table(spark, x / 3), 300).collect()


def em(k, dh, steps=1000):
    total = sum(k) + 2 * dh
    p = [(v + dh / 2) / total for v in k]
    for _ in range(steps if dh else 0):
        a, b = p[0] * p[3], p[1] * p[2]
        th = a / (a + b) if a + b > 0 else 0.5
        new = [(k[0] + dh * th) / total, (k[1] + dh * (1 - th)) / total, (k[2] + dh * (1 - th)) / total, (k[3] + dh * th) / total]
        p, d = new, max(abs(new[0] - p[0]), abs(new[1] - p[1]))
        if d < 1e-10:
            break
    return p


@pytest.mark.parametrize("steps", [1000, 60, 3])
def test_em_is_a_plain_loop(spark, steps):
    rng = np.random.default_rng(2)
    rows = [(*map(int, rng.integers(0, 20, 4)), int(rng.integers(0, 30))) for _ in range(40)] + [(0, 0, 0, 0, 7), (0, 0, 0, 0, 0), (5, 0, 0, 5, 0), (1, 1, 1, 1, 400)]
    got = {tuple(r[:5]): r[5:] for r in genotypes.em(spark.createDataFrame(rows, "k11 long, k10 long, k01 long, k00 long, dh long"), steps).collect()}
    assert (0, 0, 0, 0, 0) not in got and len(got) == len(set(rows)) - 1
    for key, p in got.items():
        assert np.allclose(p, em(key[:4], key[4], steps), atol=1e-13)


def phased(spark, x, seed=3):
    rng = np.random.default_rng(seed)
    h1 = np.where(x == 1, rng.integers(0, 2, x.shape), x / 2)
    clean = lambda v: None if np.isnan(v) else int(v)
    rows = [(i, str(i // 6), 100 * (i % 6 + 1), j, None if np.isnan(v) else float(v), clean(h1[i, j]), clean(v - h1[i, j])) for (i, j), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, f"{CALLS}, h1 int, h2 int"), np.concatenate([h1, x - h1], axis=1)


def test_phased_counts_are_exact(spark, x):
    calls, h = phased(spark, x)
    assert genotypes.all_phased(calls)
    got = {(r.i, r.j): (r.k11, r.k10, r.k01, r.k00, r.dh) for r in genotypes.haplotypes(calls, 300).collect()}
    assert got == {(i, j): (*[int(((h[i] == a) & (h[j] == b)).sum()) for a in (1, 0) for b in (1, 0)], 0) for i, j in near(x)}


def test_one_call_without_phase_makes_all_unphased(spark, x):
    calls, _ = phased(spark, x)
    open_one = calls.selectExpr("v", "chr", "pos", "smp", "dos", "if(v = 0 AND smp = 0, null, h1) AS h1", "h2").withColumn("dos", calls.dos)
    open_one = open_one.selectExpr("v", "chr", "pos", "smp", "if(v = 0 AND smp = 0, 1D, dos) AS dos", "h1", "h2")
    assert not genotypes.all_phased(open_one) and not genotypes.all_phased(calls.where("false"))
    assert genotypes.haplotypes(open_one, 300).agg({"dh": "sum"}).first()[0] > 0


@pytest.mark.parametrize("method", ["ibs", "euclidean"])
def test_distances_over_blocks(spark, x, method):
    got = {(r.s1, r.s2): r.dist for r in genotypes.distances(table(spark, x[:, :12]), method, block=4).collect()}
    assert len(got) == 12 * 11 // 2
    for (a, b), d in got.items():
        diff = x[:, a] - x[:, b]
        diff = diff[~np.isnan(diff)]
        assert abs(d - (np.abs(diff).mean() / 2 if method == "ibs" else np.sqrt((diff**2).mean()))) < 1e-12


def test_quality_steps_in_order(spark):
    many, snp = {2, 3}, {0, 1, 2, 3, 5}
    pos = [10, 10, 20, 20, 30, 40, 50]
    rows = [(i, f"s{6 - i}", "1", pos[i], j, None if i == 5 and j % 2 else float((i + j) % 3 if i != 6 else 0), i in many, i in snp or i == 6) for i in range(7) for j in range(12)]
    calls = spark.createDataFrame(rows, "v long, id string, chr string, pos long, smp int, dos double, multiallelic boolean, is_snp boolean")
    checked = genotypes.qc(calls, snps_only=True)
    assert {r.v: r.step for r in checked.collect()} == {0: "kept", 1: "duplicate", 2: "multiallelic", 3: "duplicate", 4: "not_snp", 5: "missing", 6: "maf"}
    assert [(r.step, r.removed, r.remaining) for r in genotypes.qc_log(checked, genotypes.STEPS).collect()] == [("duplicate", 2, 5), ("multiallelic", 1, 4), ("not_snp", 1, 3), ("missing", 1, 2), ("maf", 1, 1)]
    assert {r.v: r.step for r in genotypes.qc(calls, biallelic_only=False).collect()}[2] == "kept"


def test_box_sums_are_counts():
    rng = np.random.default_rng(4)
    n = 30
    i, j = np.array([(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.7]).T
    flag = rng.random(len(i)) < 0.4
    got = blocks.in_boxes(n, i, j, flag, 12)
    for a in range(n):
        for b in range(a, min(n, a + 13)):
            assert got[a, b - a] == (flag & (i >= a) & (j <= b)).sum()


def test_calls_of_a_row_are_told_as_one_by_one(spark):
    calls = ["AA", "A", "AG", "GA", "R", "GG", "N", "", "AT", "0", "+-", "+", "CG", "AAA", "AA", "R"]
    for alleles, wanted in (("A/G", "0/0 0/0 0/1 0/1 0/1 1/1 ./. ./. ./. ./. ./. ./. ./. ./. 0/0 0/1"), ("+/-", "./. ./. ./. ./. ./. ./. ./. ./. ./. 0/1 0/1 0/0 ./. ./. ./. ./."), ("G/A/T", "1/1 1/1 0/1 0/1 0/1 0/0 ./. ./. 1/2 ./. ./. ./. ./. ./. 1/1 0/1"), (None, " ".join(["./."] * 16))):
        rows = spark.createDataFrame([(calls, alleles)], "c array<string>, a string")
        one = F.transform("c", lambda c: hmp_to_gt(c, F.col("a")))
        got = rows.select(hmp_to_gts(F.col("c"), F.col("a")).alias("all"), one.alias("one")).first()
        assert got.all == got.one == wanted.split(" ")
