import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from genoloom.sources import genome, genotypes, gff, gwas, sinks
from genoloom.sources.text import lines, numbered
from genoloom.streaming import ingest


def put(tmp_path, name, text):
    p = tmp_path / name
    data = text.encode()
    p.write_bytes(gzip.compress(data) if name.endswith(".gz") else lzma.compress(data) if name.endswith(".xz") else data)
    return str(p)


GWAS = "rs{s}Chromosome{s}Position{s}Height.MLM\nS1{s}chr01{s}100{s}0.01\nS2{s}1{s}200{s}NA\n.{s}2{s}50{s}1e-9\n"


@pytest.mark.parametrize(("name", "sep"), [("a.csv", ","), ("a.tsv", "\t"), ("a.txt.gz", " "), ("a.tsv.xz", "\t"), ("a.txt", ";")])
def test_gwas(spark, tmp_path, name, sep):
    got = gwas.read_gwas(spark, put(tmp_path, name, GWAS.format(s=sep))).orderBy("chr").collect()
    assert [(r.snp, r.chr, r.pos, r.p) for r in got] == [("S1", "1", 100, 0.01), ("2:50", "2", 50, 1e-9)]


def test_gwas_odd_files(spark, tmp_path):
    quoted = put(tmp_path, "q.csv", '"SNP,CHR,BP,P"\n"a,1,5,0.5"\n')
    assert [r.snp for r in gwas.read_gwas(spark, quoted).collect()] == ["a"]
    unnamed = put(tmp_path, "u.tsv", "w\tx\ty\tz\na\t1\t5\t0.5\n")
    assert [r.snp for r in gwas.read_gwas(spark, unnamed).collect()] == ["a"]
    terms = put(tmp_path, "t.txt", "  CHR SNP  BP TEST P\n 1 a 5 ADD 0.5\n 1 a 5 COV 0.1\n")
    assert [r.p for r in gwas.read_gwas(spark, terms).collect()] == [0.5]
    for text in ("SNP\tCHR\tx\ty\na\t1\t5\t0.5\n", "SNP\tCHR\tBP\tP\na\t1\t5\t7\n", ""):
        with pytest.raises(ValueError):
            gwas.read_gwas(spark, put(tmp_path, "bad.tsv", text))


VCF = "##fileformat=VCFv4.2\n##contig=<ID=chr1,length=900>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t10\t.\tA\tT\t.\t.\t.\tGT:DP\t0|1:3\t./.:0\nchr1\t20\tv\tA\tAT,C\t.\t.\t.\tDP:GT\t4:1/1\t5:0/2\nchr2\t5\tw\tG\tC\t.\t.\t.\tGT\t0/0\t1/1\n"


def test_vcf(spark, tmp_path):
    g = genotypes.read_genotypes(spark, put(tmp_path, "a.vcf.gz", VCF), chrom="1", start=1, end=30)
    assert [(r.id, r.chr, r.pos, r.multiallelic, r.is_snp) for r in g.variants.orderBy("pos").collect()] == [("1:10", "1", 10, False, True), ("v", "1", 20, True, False)]
    assert [(r.pos, r.sample, r.dos, r.h1, r.h2) for r in g.calls.orderBy("pos", "smp").collect()] == [(10, "s1", 1.0, 0, 1), (10, "s2", None, None, None), (20, "s1", 2.0, None, None), (20, "s2", 1.0, None, None)]
    with pytest.warns(UserWarning, match="x"):
        one = genotypes.read_vcf(spark, put(tmp_path, "a.vcf", VCF), samples=["s2", "x"])
    assert one.samples == ["s2"] and one.calls.count() == 3
    with pytest.raises(ValueError):
        genotypes.read_vcf(spark, put(tmp_path, "a.vcf", VCF), samples=["x"])
    assert [tuple(r) for r in genome.chrom_sizes(spark, put(tmp_path, "a.vcf", VCF)).collect()] == [("1", 900)]


HMP = "rs#,alleles,chrom,pos,strand,assembly#,center,protLSID,assayLSID,panelLSID,QCcode,a,b,c\nm2,A/G,1,20,+,,,,,,,AA,R,N\nm1,C/T,1,10,+,,,,,,,T,CT,C\n"


def test_hapmap_and_vcf_of_it(spark, tmp_path):
    path = put(tmp_path, "x.hmp.csv", HMP)
    g = genotypes.read_genotypes(spark, path)
    want = [(10, "a", 2.0), (10, "b", 1.0), (10, "c", 0.0), (20, "a", 0.0), (20, "b", 1.0), (20, "c", None)]
    assert [(r.pos, r["sample"], r.dos) for r in g.calls.orderBy("pos", "smp").collect()] == want
    out = str(tmp_path / "out")
    sinks.hapmap_to_vcf(spark, path, out)
    back = genotypes.read_vcf(spark, out)
    assert [(r.pos, r["sample"], r.dos) for r in back.calls.orderBy("pos", "smp").collect()] == want


GFF = """##gff-version 3
##sequence-region chr1 1 5000
chr1\tx\tgene\t100\t900\t.\t+\t.\tID=g1;Name=A%20b;Note=n
chr1\tx\tmRNA\t100\t900\t.\t+\t.\tID=t1;Parent=g1
chr1\tx\tmRNA\t100\t900\t.\t+\t.\tID=t2;Parent=g1
chr1\tx\texon\t100\t300\t.\t+\t.\tParent=t1,t2
chr1\tx\tCDS\t150\t300\t.\t+\t0\tParent=t2
chr1\tx\tgene\t2000\t2500\t.\t-\t.\tID=g2
chr1\tx\tgene\t3000\t3500\t.\t-\t.\tID=g3
chr1\tx\tCDS\t3000\t3100\t.\t-\t0\tParent=g3
chr1\tx\tCDS\t3101\t3200\t.\t-\t0\tParent=g3
chr2\tx\texon\t7\t9\t.\t-\t.\tParent=lost
not a record
##FASTA
>chr1\t
ACGT
"""


def test_gff(spark, tmp_path):
    m = gff.read_gff(spark, put(tmp_path, "a.gff3", GFF))
    genes = {r.gene_id: r for r in m.genes.collect()}
    assert {k: (r.name, r.canonical, r.start, r.end) for k, r in genes.items()} == {
        "g1": ("A b", "t2", 100, 900), "g2": ("g2", "g2.gene", 2000, 2500), "g3": ("g3", "g3.model", 3000, 3500), "lost": ("lost", "lost", 7, 9)}
    assert {(r.transcript_id, r.exon_len, r.cds_len) for r in m.transcripts.collect()} == {("t1", 201, 0), ("t2", 201, 151), ("g2.gene", 501, 0), ("g3.model", 201, 201), ("lost", 3, 0)}
    assert [(r.start, r.end) for r in m.features.where("transcript_id = 'g3.model' AND class = 'exon'").collect()] == [(3000, 3200)]
    part = gff.read_gff(spark, put(tmp_path, "a.gff3", GFF), chrom="chr1", start=2400, end=3000)
    assert {r.gene_id for r in part.genes.collect()} == {"g2", "g3"}
    sinks.write_region_genes(part, str(tmp_path / "o.gff"))
    text = (tmp_path / "o.gff").read_text().splitlines()
    assert text == ["##gff-version 3", *[x for x in GFF.splitlines() if "ID=g2" in x or "ID=g3" in x]]
    assert [tuple(r) for r in genome.chrom_sizes(spark, put(tmp_path, "a.gff3", GFF)).collect()] == [("1", 5000)]


def test_gtf(spark, tmp_path):
    text = 'chr1\tx\ttranscript\t1\t90\t.\t+\t.\tgene_id "G"; transcript_id "T"; gene_name "N";\nchr1\tx\texon\t1\t90\t.\t+\t.\tgene_id "G"; transcript_id "T";\n'
    m = gff.read_gff(spark, put(tmp_path, "a.gtf", text))
    assert m.format == "gtf" and [(r.gene_id, r.name, r.canonical) for r in m.genes.collect()] == [("G", "N", "T")]


def test_fasta_over_splits(spark, tmp_path):
    text = "".join(f">c{k} x\n" + "".join("ACGTACGTAC\n" for _ in range(k * 40)) + "GG\n" for k in (1, 2, 3))
    path = put(tmp_path, "a.fa", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        assert numbered(lines(spark, path)).select("row").distinct().count() == text.count("\n")
        assert {tuple(r) for r in genome.fasta_lengths(spark, path).collect()} == {("c1", 402), ("c2", 802), ("c3", 1202)}
        sites = spark.createDataFrame([("c2", 1), ("c2", 13), ("c2", 801), ("c2", 803), ("c9", 1)], "contig string, pos long")
        assert {(r.contig, r.pos): r.base for r in genome.fasta_bases(spark, path, sites).collect()} == {("c2", 1): "A", ("c2", 13): "G", ("c2", 801): "G", ("c2", 803): None, ("c9", 1): None}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blocks_and_ld(spark, tmp_path):
    rows = genome.read_blocks(spark, put(tmp_path, "b.blocks.det", " CHR  BP1  BP2  KB  NSNPS SNPS\n  2  5  9  0.005  2 a|b\n  chr1  1  4  0.004 2 c|d\n"))
    sinks.write_blocks(rows, str(tmp_path / "b.tsv"))
    assert (tmp_path / "b.tsv").read_text() == "CHR\tBP1\tBP2\tKB\tNSNPS\tSNPS\n1\t1\t4\t0.004\t2\tc|d\n2\t5\t9\t0.005\t2\ta|b\n"
    with pytest.raises(ValueError):
        genome.read_blocks(spark, put(tmp_path, "b.blocks", "* a b\n"))
    ld = genome.read_ld(spark, put(tmp_path, "l.ld", "CHR_A BP_A SNP_A CHR_B BP_B SNP_B R\n1 1 a 1 2 b -0.5\n"))
    assert {(r.id_a, r.id_b): r.value for r in ld.collect()} == {("a", "b"): 0.25, ("b", "a"): 0.25, ("a", "a"): 1.0, ("b", "b"): 1.0}


def test_streams(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "1.tsv").write_text("a\tchr1\t5\t0.5\nb\t1\t0\t0.5\nc\t1\t9\tx\n")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.stream_gwas(spark, str(drop), ["snp", "chr", "pos", "p"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.snp, r.pos, str(r.chr)) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 5, "1")]
    events = spark.range(4).select(F.timestamp_seconds(F.col("id") * 43200).alias("t"), F.lit("k").alias("kind"))
    assert sorted(r.n for r in ingest.windowed_counts(events, "t", "kind").collect()) == [2, 2]


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    """Splits within files and files within tasks: as by a window over each split, which a file that Spark splits does without."""
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(40 * k + 5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        rows = lines(spark, str(tmp_path))
        got = {r.value: r.row for r in numbered(rows, plain=True).collect()}
        assert got == {f"{k}-{i}": i + 1 for k in range(3) for i in range(40 * k + 5)}
        assert got == {r.value: r.row for r in numbered(rows).collect()}
        gene = "1\tx\tgene\t5\t9\t.\t+\t.\tID=g;Note=a%20b;Name=\n"
        path = put(tmp_path, "m.gff3", "##gff-version 3\n" + gene * 30 + "##FASTA\n" + gene)
        got, _ = gff.records(spark, path)
        assert "row_number" not in got._jdf.queryExecution().executedPlan().toString()
        assert [(r.row, r.id, r.note, r.name) for r in got.orderBy("row").collect()] == [(k + 2, "g", "a b", None) for k in range(30)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
