"""Panels over each other, marks, outlines, warnings of regions and inputs of annotation, on a few lines each."""

import pytest
from pyspark.sql import functions as F

from genoloom.operators import panels
from genoloom.operators.gwas import thin_grid
from genoloom.operators.region import Region, define_region
from genoloom.plans.variants import annotate_variants, variants_of
from genoloom.sources.genotypes import as_genotypes, read_vcf
from genoloom.sources.gff import read_gff


def test_stacked(spark):
    rows = panels.stacked(spark, ["manhattan", "connector", "regional", "genes", "ld"], [42, 8, 48, 30, 72]).orderBy("panel").collect()
    assert [r.kind for r in rows if r.x_axis] == ["manhattan", "connector", "genes"]
    assert [round(r.top - r.bottom, 6) for r in rows] == [0.21, 0.04, 0.24, 0.15, 0.36] and rows[0].top == 1.0 and abs(rows[-1].bottom) < 1e-12
    assert [r.x_axis for r in panels.stacked(spark, ["ld", "ld"]).orderBy("panel").collect()] == [False, True]
    assert [r.x_axis for r in panels.stacked(spark, ["genes", "ld"], axis=2).orderBy("panel").collect()] == [False, True]
    for bad in ([], ["ld"]):
        with pytest.raises(ValueError):
            panels.stacked(spark, bad, [1.0, 2.0] if bad else None)


def test_outlines_against_a_loop(spark):
    pos = [100, 200, 200, 350, 500, 900]
    v = spark.createDataFrame([(f"v{k}", "1", p) for k, p in enumerate(pos)], "id string, chr string, pos long")
    given = [("1", 150, 400), ("1", 900, 950), ("1", 50, 5000), ("2", 1, 900), ("1", 210, 340)]
    got = {(r.start, r.end): [] for r in panels.ld_outlines(spark.createDataFrame(given, "chr string, start long, end long"), v, Region("1", 1, 1001, "")).collect()}
    for r in panels.ld_outlines(spark.createDataFrame(given, "chr string, start long, end long"), v, Region("1", 1, 1001, "")).collect():
        got[r.start, r.end].append((r.x, r.y, r.xend, r.yend))
    want = {}
    for c, a, b in given:
        inside = [k + 1 for k, p in enumerate(pos) if a <= p <= b]
        if c == "1" and len(inside) > 1:
            x = lambda k: 1e-6 + (k - 0.5) * 1e-3 / 6
            tip, low = (x(inside[0]) + x(inside[-1])) / 2, -float(inside[-1] - inside[0] + 1)
            want[a, b] = [(x(inside[0]), -1.0, tip, low), (tip, low, x(inside[-1]), -1.0)]
    assert set(got) == set(want) == {(150, 400), (50, 5000)}
    for k in want:
        assert [pytest.approx(q) for q in want[k]] == sorted(got[k])


def test_centromeres(spark):
    sizes = spark.createDataFrame([("2", 50_000_000), ("1", 100_000_000)], "chr string, length long")
    marks = spark.createDataFrame([("chr01", "30000000"), ("Chr2", "x"), ("9", "5")], "name string, at string")
    up = {(r.side, r.corner): (r.x, r.y) for r in panels.centromeres(marks, sizes).collect()}
    assert up["left", 3] == pytest.approx((0.69, 30.0)) and up["right", 1] == pytest.approx((1.43, 28.8)) and len(up) == 6
    flat = {(r.side, r.corner): (r.x, r.y) for r in panels.centromeres(marks, sizes, horizontal=True).collect()}
    assert flat["top", 3] == pytest.approx((30.0, 2.31)) and flat["bottom", 2] == pytest.approx((30.8, 1.57))
    assert panels.centromeres(marks.limit(0), sizes).count() == 0


def test_tss(spark):
    rows = spark.createDataFrame([("a", 10, 90, "+", 1), ("b", 10, 90, "-", 2), ("c", 10, 90, ".", 1)], "gene_id string, start long, end long, strand string, row int")
    got = {r.gene_id: (r.tss, r.y0, r.y1, r.xend) for r in panels.tss_arrows(rows, 1000.0).collect()}
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx((10, -0.7, -0.42, 55.0)) and got["b"] == pytest.approx((90, -1.7, -1.42, 45.0))


def test_region_warnings_and_core(spark):
    with pytest.warns(UserWarning, match="outside the region"):
        r = define_region("1", 500, start=1000, end=2000, min_width=5000, chrom_length=3000)
    assert (r.start, r.end, r.core) == (1, 3000, (1000, 2000)) and str(r) == "chr 1:1,000-2,000 (1.0 kb; user-defined); with margin 1-3,000"
    with pytest.warns(UserWarning, match="beyond"):
        define_region("1", 5000, flank=100, chrom_length=4950)
    genes = spark.createDataFrame([("1", 1900, 2600), ("2", 1, 9000)], "chr string, start long, end long")
    assert define_region("1", 1500, start=1000, end=2000, genes=genes).end == 2600
    with pytest.raises(ValueError):
        define_region("1", 5, start=9, end=3)


GFF = "\n".join(f"Chr01\t.\t{t}\t{a}\t{b}\t.\t+\t.\t{x}" for t, a, b, x in (("gene", 1000, 2000, "ID=g;Name=One;Note=first"), ("mRNA", 1000, 2000, "ID=t;Parent=g"), ("exon", 1000, 1200, "Parent=t"), ("exon", 1800, 2000, "Parent=t"), ("CDS", 1100, 1200, "Parent=t")))


def test_annotation_takes_any_form(spark, tmp_path):
    (tmp_path / "g.gff3").write_text("##gff-version 3\n" + GFF + "\n")
    models = read_gff(spark, str(tmp_path / "g.gff3"))
    assert models.summary().split("\n") == ["1 genes, 1 transcripts (GFF3)", "gene_id\tchr\tstart\tend\tstrand\tname", "g\t1\t1000\t2000\t+\tOne"]
    table = spark.createDataFrame([("a", "chr1", "1150", 7), ("b", "1", "1500", 8), ("a", "1", "1150", 9), ("c", None, "1", 10), ("d", "1", None, 11)], "snp string, chr string, pos string, score int").withColumn("location", F.lit("mine"))
    got = {r.score: r for r in annotate_variants(spark, table, models).collect()}
    assert (got[7].location, got[7].feature, got[7].gene_name, got[7].description) == ("exon", "CDS", "One", "first") and got[8].location == "intron" and got[9].gene_id == "g"
    assert got[10].location == got[11].location == "intergenic" and got[10].gene_id is None and len(got) == 5
    by_pos = {r.snp: r.location for r in annotate_variants(spark, [1150, 900], str(tmp_path / "g.gff3"), "chr1").collect()}
    assert by_pos == {"chr1:1150": "exon", "chr1:900": "upstream"}
    g = as_genotypes(spark, [[0, 1], [2, None]], "1", [1500, 5000], ["x", "y"], samples=["s", "t"])
    assert {r.snp: r.location for r in annotate_variants(spark, g, models).collect()} == {"x": "intron", "y": "intergenic"}
    assert g.summary() == "2 variants x 2 samples (matrix) on chr 1:1,500-5,000"
    pairs = spark.createDataFrame([("x", 1150, "y", 1500, 0.5), ("x", 1150, "x", 1150, 1.0), ("y", 1500, "x", 1150, 0.5)], "id_a string, pos_a long, id_b string, pos_b long, value double")
    assert {(r.snp, r.feature) for r in annotate_variants(spark, pairs, models, "1").collect()} == {("x", "CDS"), ("y", None)}
    assert variants_of(spark, table.drop("snp", "chr"), "1").select("snp").distinct().count() == 5
    assert annotate_variants(spark, table.limit(0), models).count() == 0
    for bad in (table.drop("pos"), [5]):
        with pytest.raises(ValueError):
            variants_of(spark, bad)


def test_vcf_without_gt_is_an_error(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    (tmp_path / "n.vcf").write_text(head + "1\t5\ta\tA\tG\t.\t.\t.\tDP\t7\n")
    with pytest.raises(Exception, match="no GT"):
        read_vcf(spark, str(tmp_path / "n.vcf")).calls.collect()
    assert read_vcf(spark, str(tmp_path / "n.vcf"), start=6).calls.count() == 0


def test_thin_grid_against_a_loop(spark):
    rows = [(f"s{k}", float(k * 7 % 1000), (k * k % 997) / 300, k % 2) for k in range(2000)] + [("twin", 0.0, 0.0, 0)]
    kept, seen = set(), set()
    most_x, most_y = max(r[1] for r in rows), max(r[2] for r in rows)
    for s, x, y, g in sorted(rows, key=lambda r: (r[1], r[0])):
        cell = (g, int(x / most_x * 20), int(y / most_y * 10))
        if y >= 2 or cell not in seen:
            kept.add(s)
        if y < 2:
            seen.add(cell)
    got = {r.snp for r in thin_grid(spark.createDataFrame(rows, "snp string, x double, logp double, grp int"), x_bins=20, y_bins=10).collect()}
    assert got == kept and 100 < len(got) < 2000


def test_thin_grid_query_in_the_cells_that_two_cuts(spark, tmp_path):
    """The cell of -log10 P 1.995 to 2.007: its first point is above 2 on chromosome 1, under 2 on chromosome 2."""
    import duckdb

    from genoloom.plans.catalog import ORACLES, QUERIES

    price = {10: 4995.0, 12: 5010.0, 14: 5009.0, 110: 5010.0, 112: 4995.0, 114: 5009.0, 400: 250_000.0, 200_000: 500_000 * 10**-3.5}
    spark.createDataFrame([(k, int(100 < k < 1000), p) for k, p in price.items()], "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["thin_grid"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(db.execute(ORACLES["thin_grid"]).fetchall())
    assert {r[0] for r in got} == {"S10", "S110", "S112", "S400", "S200000"}


def test_own_columns_of_rows_without_a_place(spark, tmp_path):
    (tmp_path / "o.gff3").write_text("1\tx\tgene\t100\t200\t.\t+\t.\tID=g1\n")
    table = spark.createDataFrame([("a", "1", 150, 1, "p"), ("b", None, 150, 2, "q"), ("c", "1", None, 3, None), ("d", "2", 5, 4, "s")], "snp string, chr string, pos long, gene int, `x.y` string")
    got = annotate_variants(spark, table, str(tmp_path / "o.gff3"))
    assert got.columns[-2:] == ["gene", "x.y"]
    assert {(r.snp, r.gene_id, r.location, r.distance_bp, r.gene, r["x.y"]) for r in got.collect()} == {
        ("a", "g1", "genic", 0, 1, "p"), ("b", None, "intergenic", None, 2, "q"), ("c", None, "intergenic", None, 3, None), ("d", None, "intergenic", None, 4, "s"),
    }
