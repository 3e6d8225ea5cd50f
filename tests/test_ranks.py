"""Distributed ranks, running extremes and what is built on them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.functions.names import chr_key, normalize_chr
from genoloom.operators import annotate, gwas, panels, ranks
from genoloom.operators.region import Region
from genoloom.sources import gff


@pytest.fixture(autouse=True)
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def values(n=500, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(1, 60)) for i in range(n)]


def test_ranks_over_partitions(spark):
    rows = values()
    df = spark.createDataFrame(rows, "id long, g string, pos long").repartition(7)
    out = ranks.ranked(df, ["g"], ["pos", "id"], keep=True)
    assert out.select("_p").distinct().count() > 2
    want = {}
    for g in ("a", "b", "c", None):
        own = sorted((p, i) for i, x, p in rows if x == g)
        want |= {i: (k, len(own)) for k, (_, i) in enumerate(own, 1)}
    assert {r.id: (r._r, r._n) for r in out.collect()} == want
    assert ranks.ranked(df.limit(0), ["g"], ["pos", "id"]).count() == 0
    whole = ranks.ranked(df.drop("g"), [], ["pos", "id"], keep=True)
    order = sorted((p, i) for i, _, p in rows)
    x = np.array([(p * 7919 + i * 31) % 1000 for p, i in order])
    got = ranks.running(ranks.running(whole, (F.col("pos") * 7919 + F.col("id") * 31) % 1000, "up"), (F.col("pos") * 7919 + F.col("id") * 31) % 1000, "down", backward=True).orderBy("_r").collect()
    assert [r.up for r in got] == np.maximum.accumulate(x).tolist()
    assert [r.down for r in got] == np.minimum.accumulate(x[::-1])[::-1].tolist()


@pytest.mark.parametrize("most", [1, 2, 7, 50, 1000])
def test_thinning(spark, most):
    df = spark.createDataFrame(values(), "id long, g string, pos long").where("g IS NOT NULL").repartition(5)
    want = set()
    for g in "abc":
        own = sorted((p, i) for i, x, p in values() if x == g)
        n = len(own)
        ticks = range(1, n + 1) if n <= most else [round(1 + t * (n - 1) / (most - 1)) for t in range(most)] if most > 1 else [1]
        want |= {own[t - 1][1] for t in ticks}
    assert {r.id for r in gwas.thin_even(df, ["pos", "id"], most, "g").collect()} == want
    every = {i for g in "abc" for i in [i for _, i in sorted((p, i) for i, x, p in values() if x == g)][::most]}
    assert {r.id for r in gwas.thin_every(df, ["pos", "id"], most, "g").collect()} == every
    plan = gwas.thin_even(df, ["pos", "id"], most, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_labels_equal_the_literal_passes(spark):
    def spread(x, d, lo, hi):
        n = len(x)
        d = min(d, (hi - lo) / (n - 1))

        def push(v):
            v = list(v)
            for i in range(1, n):
                v[i] = max(v[i], v[i - 1] + d)
            return v

        left = push(x)
        if left[-1] > hi:
            left[-1] = hi
            for i in range(n - 2, -1, -1):
                left[i] = min(left[i], left[i + 1] - d)
        right = [-v for v in push([-v for v in reversed(x)])][::-1]
        if right[0] < lo:
            right[0] = lo
            for i in range(1, n):
                right[i] = max(right[i], right[i - 1] + d)
        return [(a + b) / 2 for a, b in zip(left, right, strict=True)]

    rng = random.Random(2)
    for n, width in ((30, 1000), (60, 1000), (5, 4000), (1, 1000)):
        pos = sorted(rng.choices([1, 2, 3, 500, 501, 980, 999, *range(100, 300, 7)], k=n))
        df = spark.createDataFrame([(f"v{k:03}", "1", p, "A", "C") for k, p in enumerate(pos)], "id string, chr string, pos long, ref string, alt string").repartition(4)
        got = [r.label_x for r in panels.variant_labels(df, Region("1", 1, width, "")).orderBy("pos", "id").collect()]
        want = spread([float(p) for p in pos], 0.02 * (width - 1), 1.0, float(width)) if n > 1 else [float(min(pos[0], width))]
        assert got == pytest.approx(want)


def test_gene_order_breaks_ties(spark, tmp_path):
    lines = [f"chr1\tx\tgene\t{a}\t{b}\t.\t+\t.\tID={g}" for g, a, b in (("G10", 200, 300), ("G9", 100, 300), ("G2", 100, 300), ("G1", 50000, 60000))]
    (tmp_path / "a.gff3").write_text("\n".join(lines) + "\n")
    genes = gff.read_gff(spark, str(tmp_path / "a.gff3")).genes
    assert [r.gene_id for r in genes.orderBy("gene_ord").collect()] == ["G9", "G2", "G10", "G1"]
    v = spark.createDataFrame([(1, "1", 250)], "vid long, chr string, pos long")
    row = annotate.annotate(v, genes).first()
    assert (row.gene, row.other_genes) == ("G9", "G2(genic);G10(genic)")
    plain = spark.createDataFrame([("G10", "1", 100, 300, "+"), ("G9", "1", 100, 310, "+")], "gene_id string, chr string, start long, end long, strand string")
    assert annotate.annotate(v, plain).first().gene == "G10"


def test_names_of_any_case_and_wheat(spark):
    names = {"SL4.0Ch01": "1", "sl4.0ch01": "1", "SL2.50CH03": "3", "SL4.0ch": "ch", "SL4.0chr": "SL4.0chr", "chr_X": "X", "Chromosome": "Chromosome", "chr": "chr", "chrom-07": "7", "ch10": "10", "chloro": "chloro", "chr01D": "1D", "CHLOROPLAST": "Pt", "000": "0"}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    got = {r.n: r.c for r in df.select("n", normalize_chr(F.col("n")).alias("c")).collect()}
    assert got == names | {"SL4.0ch": got["SL4.0ch"]}
    order = ["2", "10", "X", "1A", "1B", "1D", "1F", "1e3", "NaN", "MT", "Pt"]
    df = spark.createDataFrame([(c,) for c in reversed(order)], "c string")
    assert [r.c for r in df.orderBy(chr_key(F.col("c"))).collect()] == order
