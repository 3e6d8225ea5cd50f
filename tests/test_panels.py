import math
import xml.dom.minidom
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.functions.regions import regions
from genoloom.operators import panels, report, tree
from genoloom.operators.region import Region
from genoloom.sources import sinks
from genoloom.sources.workbook import sheet_names, write_workbook


def test_gene_rows_against_a_loop(spark):
    rng = np.random.default_rng(5)
    genes = [(c, int(a), int(a + w), f"g{c}{k}" + "x" * int(n)) for c in "12" for k, (a, w, n) in enumerate(zip(rng.integers(1, 40_000, 120), rng.integers(10, 900, 120), rng.integers(0, 9, 120), strict=True))]
    span = 20_000.0
    got = {r.name: r.row for r in panels.gene_rows(spark.createDataFrame(genes, "chr string, start long, end long, name string"), span).collect()}
    for c in "12":
        ends: list[float] = []
        for _, a, b, name in sorted(g for g in genes if g[0] == c):
            half, mid = len(name) * span * 0.0075 / 2, (a + b) / 2
            left, right = min(a, mid - half), max(b, mid + half)
            at = next((k for k, e in enumerate(ends) if e < left - span * 0.012), len(ends))
            ends[at : at + 1] = [right]
            assert got[name] == at + 1, name
    assert len(got) == 240


def test_thinned(spark):
    v = spark.createDataFrame([(f"v{k}", k * 10) for k in range(1, 98)], "id string, pos long")
    for most in (2, 3, 10, 96, 97, 200):
        want = {round(1 + t * 96 / (most - 1)) for t in range(most)} if most < 97 else set(range(1, 98))
        assert {r.pos // 10 for r in panels.thinned(v, most).collect()} == want
        assert [r.k for r in panels.thinned(v, most, "v5").orderBy("pos").collect()] == list(range(1, len(want | {5}) + 1))
    assert panels.thinned(v.limit(0), 5).count() == 0


def test_regional_without_ld(spark):
    g = spark.createDataFrame([("a", "1", 5, 0.1, 1.0), ("b", "1", 9, 0.01, 2.0), ("c", "2", 5, 0.001, 3.0)], "snp string, chr string, pos long, p double, logp double")
    got = {r.snp: r for r in panels.regional(g, Region("1", 1, 10, ""), "nowhere").collect()}
    assert set(got) == {"a", "b"} and got["b"].is_lead and not got["a"].is_lead and got["a"].bin == "no LD data" and got["a"].y_max == pytest.approx(2.36)


def test_gene_parts(spark):
    features = spark.createDataFrame([("t", "g", "exon", 10, 20, "-"), ("t", "g", "exon", 40, 60, "-"), ("t", "g", "CDS", 15, 20, "-"), ("t", "g", "CDS", 40, 50, "-"), ("u", "h", "exon", 100, 120, "+")], "transcript_id string, gene_id string, class string, start long, end long, strand string")
    parts = {(r.transcript_id, r.part, r.start): r.exon_number for r in panels.gene_structure(features).collect()}
    assert parts["t", "exon", 40] == 1 and parts["t", "exon", 10] == 2 and ("t", "intron", 21) in parts and len(parts) == 6
    genes = spark.createDataFrame([("g", 10, 60, "-"), ("h", 100, 120, "+")], "gene_id string, start long, end long, strand string")
    at = spark.createDataFrame([(k, "g", p) for k, p in enumerate((5, 12, 16, 30, 55, 70))] + [(9, "h", 110)], "vid long, gene_id string, pos long")
    want = ["downstream", "3'UTR", "CDS", "intron", "5'UTR", "upstream", "exon (non-coding transcript)"]
    assert [r.place for r in panels.variant_location(at, genes, features).orderBy("vid").collect()] == want
    rows = genes.withColumnsRenamed({}).withColumns({"transcript_id": F.when(F.col("gene_id") == "g", "t").otherwise("u"), "row": F.lit(1)})
    boxes = {(r.transcript_id, r.part): r.half_height for r in panels.gene_boxes(rows, features).collect()}
    assert boxes == {("t", "exon"): 0.13, ("t", "CDS"): 0.22, ("u", "exon"): 0.22}
    assert {(r.x0, r.x1) for r in panels.strand_arrows(rows, 1000.0).collect()} == {(10, -5.0), (120, 135.0)}
    v = spark.createDataFrame([("a", "1", 50, "A", "AT"), ("b", "1", 50, "C", "G")], "id string, chr string, pos long, ref string, alt string")
    assert [(r.alleles, r.label_x) for r in panels.variant_labels(v, Region("1", 1, 101, "")).orderBy("id").collect()] == [("-/T", 49.0), ("C/G", 51.0)]


def test_tree_panel(spark):
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 3], [6, 6, 3, 0]], dtype=float)
    t = tree.midpoint_root(tree.neighbor_joining(list("abcd"), d))
    groups = panels.cluster_groups(list("abcd"), d, 2)
    assert groups["a"] == groups["b"] != groups["c"] == groups["d"]
    for layout in ("circular", "rectangular", "unrooted"):
        rows = {r.node: r for r in panels.tree_panel(spark, t, layout, groups).collect()}
        assert rows[t.root].grp is None and rows[t.root].n_tips == 4
        if layout == "unrooted":
            assert all(math.dist((rows[p].x, rows[p].y), (rows[c].x, rows[c].y)) == pytest.approx(w) for p, c, w in t.edges)
        if layout == "circular":
            assert all(math.hypot(r.x, r.y) == pytest.approx(r.depth) for r in rows.values())
    inner = [p for p, c, _ in t.edges if c in (0, 1)]
    assert rows[inner[0]].grp == groups["a"]
    assert panels.page_size(100, 5, "rectangular")[0] == 180 and panels.page_size(10**7, 5) == (5004, 5024)
    with pytest.raises(ValueError):
        panels.tree_panel(spark, t, "square")


def test_regions(spark):
    one = spark.createDataFrame([("chr01:1,000-2,000",)], "r string")
    assert [tuple(r) for r in regions(one).collect()] == [("1", 1000, 2000, "chr01:1,000-2,000")]
    named = spark.createDataFrame([("chr2", 5, 9, None), ("3", 1, 2, "q")], "Chrom string, FROM long, to long, QTL string")
    assert [r.region_id for r in regions(named).orderBy("r_chr").collect()] == ["2:5-9", "q"]
    for bad in (spark.createDataFrame([("x",)], "r string"), spark.createDataFrame([("1", 9, 5)], "chr string, start long, end long"), spark.createDataFrame([("1", 9)], "chr string, start long")):
        with pytest.raises(ValueError):
            regions(bad)


PAIRS = [("a", 1, "b", 5, 0.5), ("a", 1, "c", 9, None), ("b", 5, "c", 9, 0.1)]


def test_ld_tables(spark, tmp_path):
    pairs = spark.createDataFrame(PAIRS, "snp_a string, pos_a long, snp_b string, pos_b long, r2 double")
    v = spark.createDataFrame([("a", "1", 1), ("b", "1", 5), ("c", "1", 9)], "id string, chr string, pos long")
    genes = spark.createDataFrame([("g", "1", 4, 6, "+")], "gene_id string, chr string, start long, end long, strand string")
    sinks.write_ld(pairs, v, str(tmp_path / "p.csv"), "pairs", least=0.2, genes=genes)
    got = (tmp_path / "p.csv").read_text().splitlines()
    assert got[0] == "snp_a,pos_a,snp_b,pos_b,dist_bp,r2,gene_a,location_a,gene_b,location_b" and len(got) == 3 and got[1].endswith("4,0.5,g,upstream,g,genic")
    sinks.write_ld(pairs, v, str(tmp_path / "m.tsv"))
    assert (tmp_path / "m.tsv").read_text().splitlines()[1:] == ["a\t1\t1\t1.0\t0.5\t", "b\t1\t5\t0.5\t1.0\t0.1", "c\t1\t9\t\t0.1\t1.0"]
    sinks.write_ld(pairs, v, str(tmp_path / "parts"), parts=True)
    parts = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert parts == (tmp_path / "m.tsv").read_text()
    sinks.write_ld(pairs, v, str(tmp_path / "g.csv"), genes=genes)
    assert (tmp_path / "g.csv").read_text().splitlines()[:2] == ["id,chr,pos,gene,location,feature,distance_bp,gene_strand,a,b,c", "a,1,1,g,upstream,,3,+,1.0,0.5,"]
    wide = report.ld_matrix_table(pairs, v)
    assert wide.columns == ["id", "chr", "pos", "a", "b", "c"] and wide.where("id = 'b'").first()[3:] == (0.5, 1.0, 0.1)
    with pytest.raises(ValueError):
        report.ld_matrix_table(pairs, v, most=2)
    text = report.readme({"Lead": "a", "Species": None}, {"p.csv": ["snp_a", "r2", "v1"]})
    assert any("one column for each of 1" in x for x in text) and not any("Species" in x for x in text)


def test_reference_variant(spark):
    g = spark.createDataFrame([("s1", 1, 0.5), ("s2", 5, 0.01), ("s3", 7, 1e-9)], "snp string, pos long, p double")
    v = spark.createDataFrame([("x", 1), ("y", 5), ("z", 8)], "id string, pos long")
    assert report.reference_variant(g, v, 7, "s1") == "x" and report.reference_variant(g, v, 7, "s3") == "y"
    assert report.reference_variant(g.limit(0), v, 7) == "z" and report.reference_variant(g, v.limit(0), 7) is None


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([("a<b&\x01", 1, 0.5, True), (None, None, float("nan"), None)], "s string, n long, x double, b boolean")
    path = str(tmp_path / "w.xlsx")
    write_workbook(spark, path, {"one": df, "t/wo": [["k", 1]]})
    with zipfile.ZipFile(path) as z:
        parts = {n: xml.dom.minidom.parseString(z.read(n)) for n in z.namelist()}
    cells = parts["xl/worksheets/sheet1.xml"].getElementsByTagName("c")
    assert len(cells) == 12 and cells[4].getElementsByTagName("t")[0].firstChild.data == "a<b&" and cells[5].getElementsByTagName("v")[0].firstChild.data == "1"
    assert [s.getAttribute("name") for s in parts["xl/workbook.xml"].getElementsByTagName("sheet")] == ["one", "t_wo"]
    assert sheet_names(["x" * 40, "X" * 40]) == ["x" * 31, "X" * 29 + "_2"]
