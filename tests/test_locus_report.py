import csv

import pytest

from genoloom.cli import config, main
from genoloom.functions.genomes import species
from genoloom.operators.checks import chr_list, check_inputs
from genoloom.plans.locus import PANELS, LocusConfig, choice, locus, write
from genoloom.plans.trees import sample_tree
from genoloom.sources import genotypes
from genoloom.sources.simulate import simulate


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    return simulate(spark, str(tmp_path_factory.mktemp("example")), samples=24, variants=60)


def test_example_files_agree(spark, files):
    v, h = genotypes.read_vcf(spark, files["vcf"]), genotypes.read_hapmap(spark, files["hapmap"])
    both = v.calls.alias("a").join(h.calls.alias("b"), ["pos", "sample"]).where("a.dos <=> b.dos")
    assert both.count() == v.calls.count() == 24 * 60 and v.calls.where("dos IS NULL").count() > 0


def test_checks(spark, files, tmp_path):
    got = check_inputs(spark, files["gwas"], files["gff"], files["vcf"], files["hapmap"]).collect()
    assert not [r for r in got if r.status == "PROBLEM"]
    assert {r.file for r in got} == {"Species", "GWAS", "GFF", "VCF", "HapMap"}
    (tmp_path / "g.csv").write_text("SNP,CHR,BP,P\na,1,99000000,0.001\nb,77,5,0.002\nc,Un,5,0.001\n")
    bad = check_inputs(spark, str(tmp_path / "g.csv"), files["gff"], str(tmp_path / "no.vcf"), species=species("rice")).collect()
    text = " ".join(r.message for r in bad if r.status == "PROBLEM")
    assert "past the end" in text and "77" in text and any(r.file == "VCF" and r.status == "PROBLEM" for r in bad)
    assert any("no chromosomes of" in r.message for r in bad) and any("very small" in r.message for r in bad)
    assert [r.status for r in check_inputs(spark).collect()] == ["NOTE", "PROBLEM"]
    assert chr_list(list("abcdefghij")) == "a, b, c, d, ..., i, j"


def test_report(spark, files, tmp_path):
    base = str(tmp_path / "r")
    got = main(["--gwas", files["gwas"], "--gff=" + files["gff"], "--vcf", files["vcf"], "--blocks", files["blocks"], "--out", base + ".pdf", "--tables", "genes,snps,ld,ld_pairs", "--max-ld-snps", "20", "--min-maf", "0.01"], spark)
    rows = list(csv.DictReader(open(got["snps"])))
    lead = [r for r in rows if r["IS_LEAD"] == "yes"]
    assert len(lead) == 1 and lead[0]["SNP"] == "S30" and float(lead[0]["R2_WITH_LEAD"]) == 1.0 and lead[0]["SIGNIFICANT"] == "yes"
    assert {r["IN_LD_BLOCK"] for r in rows} <= {"yes", "no"} and all(r["GENE"] and r["LOCATION"] for r in rows)
    square = list(csv.reader(open(got["ld"])))
    assert len(square) - 1 == len(square[0]) - square[0].index("GENE_STRAND") - 1
    pairs = list(csv.DictReader(open(got["ld_pairs"])))
    n = len(square) - 1
    assert len(pairs) == n * (n - 1) // 2
    assert set(got) == {"snps", "genes", "ld", "ld_pairs", "gene_lines", "readme", *(f"panel_{p}" for p in PANELS), "frame_layout", "frame_ld_outline"}
    assert "S30" in open(got["readme"]).read()
    diamonds = open(got["panel_ld"]).read().splitlines()
    assert len(diamonds) - 1 in (190, 210)


@pytest.mark.parametrize("how", [{"region": "ld_blocks"}, {"region": "window", "flank": 9000, "table_format": "xlsx", "threshold": None}, {"start": 1000, "end": 40000, "chr": "1", "pos": 30000, "panels": [], "ld_stat": "dprime", "tables": ["snps", "ld_pairs"]}])
def test_region_modes(spark, files, tmp_path, how):
    out = locus(spark, LocusConfig(files["gwas"], files["gff"], files["vcf"], **{"panels": ["regional"], "tables": ["snps"]} | how))
    assert out.region.start <= out.region.end and out.tables["snps"].count() > 0
    assert ("significant" in out.tables["snps"].columns) == ("threshold" not in how)
    assert write(out, str(tmp_path / "x"))["readme"].endswith("x_README.txt")


def test_report_of_associations_alone(spark, files):
    out = locus(spark, LocusConfig(files["gwas"], target="S5"))
    assert out.lead == "S5" and set(out.panels) == {"manhattan", "regional"} and out.tables["snps"].where("is_lead = 'yes'").count() == 1
    for bad in ({"region": "x"}, {"panels": [], "tables": []}, {"target": "none such"}):
        with pytest.raises(ValueError):
            locus(spark, LocusConfig(files["gwas"], **bad))


def test_options():
    c, base = config(["--gwas", "g", "--species", "hg19", "--threshold", "5e-8", "--extend-to-genes", "--panels", "man,ld", "--chr-map", "A=1,B=2", "--out=o"])
    assert c.species.name == "human_grch37" and c.threshold == 5e-8 and c.extend_to_genes and c.panels == ["manhattan", "ld"] and c.chr_map == {"A": "1", "B": "2"} and base == "o"
    assert choice("none", PANELS) == [] and choice(["ld", "genes"], PANELS) == ["genes", "ld"]
    with pytest.raises(ValueError):
        choice("x", PANELS)
    with pytest.raises(SystemExit):
        config(["--gwas", "g", "--nonsense", "1"])


def test_tree_of_a_file(spark, files, tmp_path):
    for method in ("nj", "upgma"):
        assert sorted(sample_tree(spark, files["hapmap"], method, max_snps=30).tips) == [f"L{k:03d}" for k in range(1, 25)]
    got = main(["tree", "--genotypes", files["vcf"], "--out", str(tmp_path / "t")], spark)
    assert open(got["newick"]).read().strip().endswith(";")
