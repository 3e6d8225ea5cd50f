import random

import pytest

from genoloom.functions import genomes
from genoloom.sources import genome
from genoloom.sources.blockgzip import lines_with_places


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_species(spark):
    assert genomes.species_key(" HG19 ") == "human_grch37" and genomes.species_key("oryza sativa") == "rice" and genomes.species_key("yeti") is None
    assert dict(genomes.species("tair10").lengths)["1"] == 30427671
    assert genomes.species("yeti", {"1": 5}).lengths == (("1", 5),)
    with pytest.raises(ValueError):
        genomes.species("yeti")
    rows = {r.species: r for r in genomes.list_species(spark).collect()}
    assert (rows["rice"].chromosomes, rows["rice"].size_mb) == (12, 373.2) and len(rows) == 7


def test_sizes_of(spark, tmp_path):
    got = lambda x, **k: {r.chr: r.length for r in genome.sizes_of(spark, x, **k).collect()}
    assert got("mouse")["X"] == 169476592
    assert got({"Chr01": 5, "chr2": 0, "chrM": 7}) == {"1": 5, "MT": 7}
    assert got(spark.createDataFrame([("chr1", "9", "x"), ("1", "4", "y")], "a string, b string, c string").coalesce(1)) == {"1": 9}
    assert got(None, gwas=spark.createDataFrame([("1", 5), ("1", 8)], "chr string, pos long")) == {"1": 8}
    assert got(put(tmp_path, "a.gff", "##gff-version 3\nchr1\tx\tchromosome\t1\t70\t.\t.\t.\tID=c\nchr1\tx\tgene\t1\t90\t.\t.\t.\tID=g\nchr1\tx\tregion\t1\t75\t.\t.\t.\tID=r\n")) == {"1": 75}
    with pytest.raises(ValueError):
        got(None)
    with pytest.raises(ValueError):
        got({"1": 0})


def test_square_ld(spark, tmp_path):
    m = put(tmp_path, "m.ld", "1\t0.5\tnan\n0.5\t1\t0.2\nnan\t0.2\t1\n")
    bim = put(tmp_path, "m.bim", "1 a 0 10 A T\n1 b 0 20 A T\n1 c 0 30 A T\n")
    got = {(r.id_a, r.pos_a, r.id_b): r.value for r in genome.read_ld_square(spark, m, bim=bim).collect()}
    assert len(got) == 9 and got["a", 10, "b"] == 0.5 and got["a", 10, "c"] is None and got["c", 30, "c"] == 1
    assert {r.id_a for r in genome.read_ld_square(spark, m).collect()} == {"v1", "v2", "v3"}
    with pytest.raises(ValueError):
        genome.read_ld_square(spark, m, ids=["a"])
    with pytest.raises(ValueError):
        genome.read_ld_square(spark, put(tmp_path, "n.ld", "1 2\n"))


def test_groups_and_index(spark, tmp_path):
    g = put(tmp_path, "g.tsv", "sample\tgroup\ns1\tx\ns2\ty\n")
    assert [tuple(r) for r in genome.read_groups(spark, g).orderBy("sample").collect()] == [("s1", "x"), ("s2", "y")]
    assert genome.read_groups(spark, {"s": "z"}).first().grp == "z"
    fa = put(tmp_path, "f.fa", ">c1 x\nACGT\nAC\n>c2\nGG\n")
    assert {tuple(r) for r in genome.fasta_index(spark, fa).collect()} == {("c1", 6, 6, 4, 5), ("c2", 2, 18, 2, 3)}
    assert genome.fasta_index(spark, put(tmp_path, "f.fa.fai", "c1\t6\t6\t4\t5\n")).first().length == 6


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_fasta_by_offset(spark, tmp_path, eol, monkeypatch):
    rng = random.Random(6)
    contigs = {f"c{k}": "".join(rng.choice("acgtN") for _ in range(rng.choice([0, 1, 59, 60, 61, 5000]))) for k in range(40)}
    text = "".join(f">{c} about{eol}" + "".join(s[a : a + 60] + eol for a in range(0, len(s), 60)) for c, s in contigs.items()).removesuffix(eol)
    path = str(tmp_path / "x.fa")
    (tmp_path / "x.fa").write_bytes(text.encode())
    monkeypatch.setattr(genome, "lines_with_places", lambda spark, p: lines_with_places(spark, p, 700))  # many splits
    sites = [(c, p) for c, s in contigs.items() for p in (-1, 0, 1, 2, 59, 60, 61, 3000, len(s), len(s) + 1)] + [("zz", 1), (None, 1), ("c1", None)]
    want = {(c, p): contigs[c][p - 1].upper() if p and c in contigs and 1 <= p <= len(contigs[c]) else None for c, p in sites}
    df = spark.createDataFrame(sites, "contig string, pos long").distinct()
    for _ in range(2):  # told from the file, then from its saved index
        assert {(r.contig, r.pos): r.base for r in genome.fasta_bases(spark, path, df).collect()} == want
        index = {r.contig: r for r in genome.fasta_index(spark, path).collect()}
        for c, s in contigs.items():
            assert index[c].length == len(s)
            if s:
                assert text.encode()[index[c].offset :][: min(60, len(s))].decode() == s[:60] and index[c].line_bases == min(60, len(s)) and (index[c].line_bytes == min(60, len(s)) + len(eol) or c == "c39")
        saved = genome.save_fasta_index(spark, path)
    assert [x.split("\t")[0] for x in open(saved).read().splitlines()] == list(contigs)


def test_pieces_read_little():
    import numpy as np

    at = np.array(sorted([5, 6, 7, 4000, 10_000_000, 10_000_010, *range(20_000_000, 23_000_000, 1000)]))
    runs = genome.pieces(at)
    assert [k for a, b in runs for k in range(a, b)] == list(range(len(at)))
    assert sum(int(at[b - 1] - at[a]) + 1 for a, b in runs) < 3_010_000 and max(int(at[b - 1] - at[a]) for a, b in runs) <= 1 << 20
