"""Blocks against a literal loop over whole chromosomes; pairs at one position."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from genoloom.operators import blocks, genotypes


def literal(variants, bounds, low=0.70, high=0.98, recomb=0.90, share=0.95):
    """variants: (pos, v) of a chromosome in order; bounds: (i, j) -> (lo, hi)."""
    index = {v: k for k, (_, v) in enumerate(variants)}
    pos = [p for p, _ in variants]
    known = {(index[i], index[j]): b for (i, j), b in bounds.items() if i in index}
    found = sorted((p for p, (lo, hi) in known.items() if lo >= low and hi >= high), reverse=True)
    found.sort(key=lambda p: -(pos[p[1]] - pos[p[0]]))
    used, out = set(), []
    for i, j in found:
        n = j - i + 1
        if i in used or j in used or (n == 2 and pos[j] - pos[i] > 20_000) or (n == 3 and pos[j] - pos[i] > 30_000):
            continue
        cut = {2: 0.8, 3: 0.5, 4: 0.5}.get(n, low)
        inside = [known[p] for p in itertools.combinations(range(i, j + 1), 2) if p in known]
        strong, weak = sum(lo > cut and hi >= high for lo, hi in inside), sum(hi < recomb for _, hi in inside)
        if strong + weak >= (6 if n > 3 else 3 if n > 2 else 1) and strong / (strong + weak) > share:
            used |= set(range(i, j + 1))
            out.append((pos[i], pos[j], n, "|".join(str(v) for _, v in variants[i : j + 1])))
    return sorted(out)


def calls(spark, phased, seed):
    """Three chromosomes of founders' haplotypes with breaks; some variants have no variation or share a position."""
    rng = random.Random(seed)
    rows, v = [], 0
    for chrom, n in (("1", 90), ("2", 60), ("10", 2)):
        pos, founders = 1000, []
        for k in range(n):
            if k % rng.choice([6, 9, 14]) == 0 or not founders:
                founders = [[rng.randint(0, 1) for _ in range(400)] for _ in range(4)]
                who = [(rng.randrange(4), rng.randrange(4)) for _ in range(40)]
            pos += rng.choice([0, 300, 900, 4000, 9000])
            for s, (a, b) in enumerate(who):
                h1, h2 = (0, 0) if k % 17 == 5 else (founders[a][k], founders[b][k])
                h1 ^= rng.random() < 0.01
                if rng.random() < 0.03:
                    rows.append((v, chrom, pos, s, None, None, None))
                else:
                    rows.append((v, chrom, pos, s, h1 + h2, int(h1), int(h2)))
            v += rng.choice([1, 3])
    df = spark.createDataFrame(rows, "v long, chr string, pos long, smp int, dos int, h1 int, h2 int")
    return df if phased else df.drop("h1", "h2")


@pytest.mark.parametrize(("phased", "max_kb"), [(True, 200), (False, 200), (False, 12)])
def test_blocks_equal_a_literal_loop(spark, phased, max_kb):
    df = calls(spark, phased, 7 + max_kb).repartition(4)
    ci = genotypes.dprime_ci(genotypes.from_freqs(genotypes.em(genotypes.haplotypes(df, max_kb * 1000)))).where("lo IS NOT NULL").collect()
    bounds = {(r.i, r.j): (r.lo, r.hi) for r in ci}
    want = []
    for chrom in ("1", "2", "10"):
        variants = sorted((r.pos, r.v) for r in df.where(F.col("chr") == chrom).select("pos", "v").distinct().collect())
        want += [(chrom, *b) for b in literal(variants, bounds)]
    found = blocks.find_blocks(df, max_kb)
    got = sorted((r.chr, r.start, r.end, r.nsnps, r.snps) for r in found.collect())
    assert got == sorted(want) and len(want) > 5


def test_segments_are_the_runs(spark):
    rng = random.Random(3)
    for trial in range(4):
        pos = sorted(rng.choices(range(1, 4000), k=120))
        variants = [(p, v) for v, p in enumerate(pos)]
        far = {}
        for k in rng.sample(range(110), 25):
            near = [x for x in variants[k + 1 :] if x[0] - pos[k] <= 100]
            if near:
                far[k] = rng.choice(near)
        want, end, name = {}, (-1, -1), None
        for at in variants:
            if at > end and at[1] in far:
                name = at
            end = max(end, far.get(at[1], (-1, -1)))
            if at <= end:
                want[at[1]] = name
        rows = [("c", v, p, None if v not in far else {"pos": far[v][0], "v": far[v][1]}) for p, v in variants]
        df = spark.createDataFrame(rows, "chr string, v long, pos long, far struct<pos:long,v:long>")
        assert {r.v: tuple(r.seg) for r in blocks.segments(df, 100).collect()} == want, trial


def test_pairs_at_one_position(spark):
    rows = [(v, "1", p, s, (s * (v + 2)) % 3) for v, p in ((5, 10), (2, 10), (9, 40), (1, 41)) for s in range(12)]
    df = spark.createDataFrame(rows, "v long, chr string, pos long, smp int, dos int")
    assert {(r.i, r.j) for r in genotypes.r2(df, 30).collect()} == {(2, 5), (2, 9), (5, 9), (9, 1)}
    assert {(r.i, r.j) for r in genotypes.r2(df, 31).collect()} == {(2, 5), (2, 9), (5, 9), (2, 1), (5, 1), (9, 1)}
