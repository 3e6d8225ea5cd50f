from pathlib import Path

import pytest

from genoloom.operators import gwas as association
from genoloom.plans.locus import LocusConfig, locus
from genoloom.sources import genotypes, gff, gwas, sinks, store
from genoloom.sources.simulate import simulate

HMP = "rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\ta\tb\tc\td\n"
SITES = [  # rs, alleles, chrom, pos, calls
    ("m1", "A/G", "chr2", 2, "AA R GG N"),
    ("m2", "C/T", "chr1", 3, "C Y TT CC"),
    ("m3", "A/C/T", "chr1", 1, "AA CT W TT"),
    ("m4", "+/-", "chr1", 4, "++ +- -- N"),
    ("", "A/T", "chr3", 1, "A A T W"),
]
FASTA = ">chr1 x\nTGTCA\n>chr2\nCGGG\n"


@pytest.fixture
def hapmap(tmp_path):
    path = tmp_path / "x.hmp.txt"
    path.write_text(HMP + "".join("\t".join([a, b, c, str(d), *[""] * 7, *e.split()]) + "\n" for a, b, c, d, e in SITES))
    (tmp_path / "r.fa").write_text(FASTA)
    return str(path), str(tmp_path / "r.fa"), str(tmp_path / "out")


def body(path):
    text = [line.split("\t") for f in sorted(Path(path).glob("part-*")) for line in f.read_text().splitlines()]
    return {f[2] + f[0]: (f[0], f[3], f[4], f[6], " ".join(f[9:])) for f in text}, [f[0] for f in text]


def test_conversion_checks_the_reference(spark, hapmap):
    source, fasta, out = hapmap
    got = sinks.hapmap_to_vcf(spark, source, out, ref_fasta=fasta)
    rows, order = body(out)
    assert got == {"read": 5, "indels": 1, "mismatches": 0, "written": 4}
    # chr1:1 is T, so of A/C/T the order is T, A, C; chr1:3 is T; chr2:2 is G; chr3 is not in the reference
    assert rows == {
        "m3chr1": ("chr1", "T", "A,C", "PASS", "1/1 0/2 0/1 0/0"),
        "m2chr1": ("chr1", "T", "C", "PASS", "1/1 0/1 0/0 1/1"),
        "m1chr2": ("chr2", "G", "A", "PASS", "1/1 0/1 0/0 ./."),
        ".3": ("3", "A", "T", "PASS", "0/0 0/0 1/1 0/1"),
    }
    assert order == ["chr1", "chr1", "chr2", "3"]


def test_conversion_flags_bases_that_no_allele_has(spark, hapmap, tmp_path):
    source, fasta, out = hapmap
    (tmp_path / "r.fa").write_text(">chr1 x\nGGCCA\n>chr2\nCGGG\n")
    got = sinks.hapmap_to_vcf(spark, source, out, ref_fasta=fasta, indels="symbolic")
    rows, _ = body(out)
    assert got == {"read": 5, "indels": 1, "mismatches": 1, "written": 5}
    assert rows["m3chr1"] == ("chr1", "A", "C,T", "RefMismatch", "0/0 1/2 0/2 2/2")
    assert rows["m2chr1"] == ("chr1", "C", "T", "PASS", "0/0 0/1 1/1 0/0")
    assert rows["m4chr1"] == ("chr1", "C", "<DEL>", "PASS", "0/0 0/1 1/1 ./.")


def test_conversion_without_a_reference(spark, hapmap):
    source, _, out = hapmap
    assert sinks.hapmap_to_vcf(spark, source, out, chrom="chr1", start=2, chr_prefix="Chr", indels="symbolic") == {"read": 2, "indels": 1, "mismatches": 0, "written": 2}
    assert body(out)[0] == {"m2Chr1": ("Chr1", "C", "T", "PASS", "0/0 0/1 1/1 0/0"), "m4Chr1": ("Chr1", "N", "<DEL>", "PASS", "0/0 0/1 1/1 ./.")}
    back = genotypes.read_vcf(spark, out)
    assert {(r.pos, r["sample"], r.dos) for r in back.calls.where("pos = 3").collect()} == {(3, "a", 0.0), (3, "b", 1.0), (3, "c", 2.0), (3, "d", 0.0)}
    with pytest.raises(ValueError):
        sinks.hapmap_to_vcf(spark, source, out, indels="keep")


def test_order_of_rows(spark, hapmap):
    rows = genotypes.hapmap_rows(spark, hapmap[0])[0]
    assert [r.chr for r in genotypes.unsorted(rows).collect()] == ["1"]
    assert genotypes.unsorted(rows.where("pos <> 3")).count() == 0


def test_matrix_in_memory(spark):
    g = genotypes.as_genotypes(spark, [[0, 1, None], [2, float("nan"), 0.5]], "Chr03", [20, 10])
    assert [(r.id, r.chr, r.pos) for r in g.variants.orderBy("pos").collect()] == [("3:10", "3", 10), ("3:20", "3", 20)]
    assert g.samples == ["sample1", "sample2", "sample3"]
    assert [(r.pos, r["sample"], r.dos) for r in g.calls.orderBy("pos", "smp").collect()] == [(10, "sample1", 2.0), (10, "sample2", None), (10, "sample3", 0.5), (20, "sample1", 0.0), (20, "sample2", 1.0), (20, "sample3", None)]
    assert genotypes.as_genotypes(spark, [], "1", []).calls.count() == 0
    with pytest.raises(ValueError):
        genotypes.as_genotypes(spark, [[0, 1]], "1", [1, 2])
    with pytest.raises(ValueError):
        genotypes.as_genotypes(spark, [[0, 1], [0]], "1", [1, 2])


def test_store_reads_a_region(spark, tmp_path):
    g = genotypes.as_genotypes(spark, [[i % 3, None, 2 - i % 3] for i in range(20)], ["1", "2"] * 10, [100 - 5 * i for i in range(20)], samples=["a", "b", "c"])
    path = str(tmp_path / "s")
    store.write_genotypes(g, path)
    whole = store.read_stored(spark, path)
    cells = lambda df: {(r.v, r.smp): (r.chr, r.pos, r["sample"], r.dos) for r in df.collect()}
    assert cells(whole.calls) == cells(g.calls) and whole.calls.count() == 60
    part = store.read_stored(spark, path, "chr1", 20, 60, ["c", "x"])
    want = sorted((r.v, r.dos) for r in g.calls.where("chr = '1' AND pos BETWEEN 20 AND 60 AND sample = 'c'").collect())
    assert part.samples == ["c"] and sorted((r.v, r.dos) for r in part.calls.collect()) == want and len(want) > 2
    plan = part.calls._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chr" in plan and "GreaterThanOrEqual(pos,20)" in plan
    every = store.read_stored(spark, path, "2", every=3)
    assert [r.pos for r in every.variants.orderBy("pos").collect()] == [5, 35, 65, 95] and {r.pos for r in every.calls.collect()} == {5, 35, 65, 95}
    with pytest.raises(ValueError):
        store.read_stored(spark, path, samples=["x"])


def test_gene_by_name(spark, tmp_path):
    rows = [("g1", "mRNA", "Alpha", "t1"), ("g2", "mRNA", "beta", "t2"), ("G1", "mRNA", "beta", "t3")]
    text = "".join(f"chr1\tx\tgene\t{k}00\t{k}50\t.\t+\t.\tID={g};Name={n}\nchr1\tx\tmRNA\t{k}00\t{k}50\t.\t+\t.\tID={t};Parent={g}\n" for k, (g, _, n, t) in enumerate(rows, 1))
    (tmp_path / "a.gff3").write_text(text)
    m = gff.read_gff(spark, str(tmp_path / "a.gff3"))
    find = lambda name: (lambda g, t: (g.gene_id, t))(*gff.locate_gene(m, name))
    assert find("g1") == ("g1", None) and find("G1") == ("G1", None) and find("t3") == ("G1", "t3") and find("ALPHA") == ("g1", None)
    with pytest.warns(UserWarning, match="several"):
        assert find("beta") == ("g2", None)
    with pytest.raises(ValueError, match="Alpha"):
        find("lph")


def test_association_rows_in_memory(spark):
    raw = spark.createDataFrame([("a", "chr1", 5, 0.5), (None, "1", 9, 0.2), ("c", "1", 0, 0.1)], "snp string, chr string, pos long, p double")
    rows = gwas.read_gwas(spark, raw)
    assert sorted((r.snp, r.chr, r.pos) for r in rows.collect()) == [("1:9", "1", 9), ("a", "1", 5)]
    assert gwas.read_gwas(spark, rows) is rows
    for bad in (raw.drop("p"), raw.where("false")):
        with pytest.raises(ValueError):
            gwas.read_gwas(spark, bad)
    assert association.top(rows).first().snp == "1:9"


def test_unknown_samples_are_told(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tG\t.\t.\t.\tGT\t0/1\t1/1\n")
    with pytest.warns(UserWarning, match="s9"):
        assert genotypes.read_vcf(spark, str(tmp_path / "a.vcf"), samples=["s2", "s9"]).samples == ["s2"]


@pytest.mark.parametrize("square", [False, True])
def test_report_takes_ld_from_a_file(spark, tmp_path, square):
    files = simulate(spark, str(tmp_path / "ex"), samples=12, variants=40)
    rows = [r for r in gwas.read_gwas(spark, files["gwas"]).where("snp BETWEEN 'S28' AND 'S33'").orderBy("pos").collect()]
    n = len(rows)
    value = lambda i, j: 1.0 if i == j else round(1 / (2 + abs(i - j)), 4)
    if square:
        (tmp_path / "l.ld").write_text("".join("\t".join(str(value(i, j)) for j in range(n)) + "\n" for i in range(n)))
        (tmp_path / "l.bim").write_text("".join(f"{r.chr}\tx{i}\t0\t{r.pos}\tA\tG\n" for i, r in enumerate(rows)))
    else:
        pairs = [(r, q, value(i, j)) for i, r in enumerate(rows) for j, q in enumerate(rows) if i < j]
        (tmp_path / "l.ld").write_text("CHR_A BP_A SNP_A CHR_B BP_B SNP_B R2\n" + "".join(f"{r.chr} {r.pos} x{r.snp} {q.chr} {q.pos} x{q.snp} {v}\n" for r, q, v in pairs))
    how = dict(ld_file=str(tmp_path / "l.ld"), ld_bim=str(tmp_path / "l.bim") if square else None, panels=["ld", "regional"], tables=["snps", "ld_pairs"])
    out = locus(spark, LocusConfig(files["gwas"], files["gff"], **how, chr=rows[2].chr, pos=rows[2].pos, region="window", flank=60_000))
    got = {(r.snp_a, r.snp_b): r.r2 for r in out.tables["ld_pairs"].collect()}
    at = {r.snp: i for i, r in enumerate(rows)}
    assert len(got) == n * (n - 1) // 2 and all(abs(v - value(at[a], at[b])) < 1e-9 for (a, b), v in got.items())
    assert out.panels["ld"].count() >= n * (n - 1) // 2 and out.reference in at
    table = {r.snp: r.r2_with_lead for r in out.tables["snps"].collect()}
    assert abs(table[rows[0].snp] - value(0, at[out.reference])) < 1e-3
    with pytest.raises(ValueError, match="ld_bim"):
        (tmp_path / "m.ld").write_text("1 0\n0 1\n")
        locus(spark, LocusConfig(files["gwas"], files["gff"], ld_file=str(tmp_path / "m.ld"), chr="1", pos=rows[2].pos, region="window"))
