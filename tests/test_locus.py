import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from genoloom.functions.genotype import hmp_site_type, hmp_to_gt, site_type
from genoloom.functions.names import chr_key, normalize_chr
from genoloom.operators import annotate, genotypes, tree
from genoloom.plans.catalog import ORACLES, QUERIES
from genoloom.sources.genotypes import variant_sites

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or x != x else round(float(x), 4) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted(str([clean(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", ["gwas_qc", "gwas_qc_log", "genome_layout", "variant_density", "annotate_location", "geno_qc", "ld_r2_pairs", "ld_em_dprime", "merge_intervals", "allele_label", "snp_table"])
def test_query_matches_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names(spark):
    x = {"chrom7": "7", "CHROMOSOME_03": "3", " chrY": "Y", "chrmt": "MT", "12": "12", "scaffold_44": "scaffold_44"}
    got = spark.createDataFrame(list(enumerate(x)), "i int, v string").select("v", normalize_chr(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in got} == x
    labels = [str(i) for i in range(23, 0, -2)] + ["Y", "X"]
    some = spark.createDataFrame([(v,) for v in labels], "v string").orderBy(chr_key(F.col("v"))).collect()
    assert [r.v for r in some] == [*sorted(labels[:-2], key=int), "X", "Y"]


def naive_place(pos, genes, features, up=3000, down=1000):
    """Location, feature and distance of a position, gene after gene."""
    rank = ["exon", "intron", "genic", "upstream", "downstream"]
    found = []
    for g, _, lo, hi, strand in genes:
        if lo <= pos <= hi:
            own = [(c, a, b) for x, c, a, b in features if x == g]
            here = {c for c, a, b in own if a <= pos <= b}
            coding = [x for c, a, b in own if c == "CDS" for x in (a, b)]
            if not own:
                found.append(("genic", None, 0, g))
            elif not here:
                found.append(("intron", None, 0, g))
            elif "CDS" in here:
                found.append(("exon", "CDS", 0, g))
            elif here & {"UTR5", "UTR3"}:
                found.append(("exon", "5'UTR" if "UTR5" in here else "3'UTR", 0, g))
            elif coding and not min(coding) <= pos <= max(coding):
                found.append(("exon", "5'UTR" if (pos < min(coding)) == (strand == "+") else "3'UTR", 0, g))
            else:
                found.append(("exon", "non-coding exon", 0, g))
            continue
        far = lo - pos if pos < lo else pos - hi
        if (pos < lo) == (strand == "+"):
            if far <= up:
                found.append(("upstream", None, far, g))
        elif far <= down:
            found.append(("downstream", None, far, g))
    if found:
        return min(found, key=lambda x: (rank.index(x[0]), x[2], x[3]))
    far, _, g = min([(pos - hi, 0, g) for g, _, _, hi, _ in genes if hi < pos] + [(lo - pos, 1, g) for g, _, lo, _, _ in genes if lo > pos])
    return "intergenic", None, far, g


def test_annotation_is_a_naive_loop(spark):
    rng = np.random.default_rng(12)
    genes, features, at = [], [], 4000
    for i in range(14):
        size = int(rng.integers(900, 6000))
        genes.append((f"g{i:02}", "7", at, at + size, "+-"[i % 2]))
        if i % 4 != 3:
            cuts = np.sort(rng.choice(np.arange(at + 10, at + size - 10), 4, replace=False)).tolist()
            exons = [(at, cuts[0]), (cuts[1], cuts[2]), (cuts[3], at + size)]
            features += [(f"g{i:02}", "exon", a, b) for a, b in exons]
            if i % 4 != 2:
                features += [(f"g{i:02}", "CDS", cuts[0] - 5, cuts[0]), (f"g{i:02}", "CDS", *exons[1]), (f"g{i:02}", "CDS", cuts[3], cuts[3] + 5)]
            if i % 4 == 1:
                features += [(f"g{i:02}", "UTR3" if i % 2 else "UTR5", at, cuts[0] - 6)]
        at += size + int(rng.choice([-300, 700, 2500, 9000]))
    places = sorted({int(x) for x in rng.integers(1, at + 9000, 700)})
    v = spark.createDataFrame([(i, "7", x) for i, x in enumerate(places)] + [(-1, "no genes", 5)], "vid int, chr string, pos long")
    g = spark.createDataFrame(genes, "gene_id string, chr string, start long, end long, strand string")
    f = spark.createDataFrame(features, "gene_id string, class string, f_start long, f_end long")
    got = {r.pos: (r.location, r.feature, r.distance_bp, r.gene) for r in annotate.annotate(v, g, f).where("vid >= 0").collect()}
    assert got == {x: naive_place(x, genes, features) for x in places}
    alone = annotate.annotate(v, g, f).where("vid = -1").first()
    assert (alone.gene, alone.location, alone.distance_bp) == (None, "intergenic", None)


def test_hapmap_calls_of_any_allele(spark):
    want = {("AT", "A/C/T"): "0/2", ("T", "A/C/T"): "2/2", ("W", "A/C/T"): "0/2", ("CT", "A/C/T"): "1/2", ("AA", "A"): "0/0", ("N", "A/C"): "./.", ("AN", "A/C"): "./.", ("G", "A/C"): "./.", ("0", "+/-"): "0/1", ("-", "+/-"): "1/1", ("ga", "A/G"): "0/1"}
    rows = spark.createDataFrame([(*k, v) for k, v in want.items()] + [(None, "A/C", "./.")], "c string, a string, want string")
    for r in rows.withColumn("got", hmp_to_gt(F.col("c"), F.col("a"))).collect():
        assert r.got == r.want, r


def test_site_types(spark):
    want = {("A", "G"): "SNP", ("A", "G,*"): "SNP", ("A", "AT"): "indel", ("AT", "A"): "indel", ("A", "<DEL>"): "indel", ("A", "<INS:ME>"): "other", ("A", "[1:5[A"): "other", ("AT", "GC"): "other", ("A", "*"): "indel"}
    rows = spark.createDataFrame([(*k, v) for k, v in want.items()], "r string, a string, want string")
    for r in rows.withColumn("got", site_type(F.col("r"), F.col("a"))).collect():
        assert r.got == r.want, r


def test_hapmap_site_types(spark):
    want = {"A/G": "SNP", "a/c/t": "SNP", "+/-": "indel", "A/0": "indel", "A/AT": "indel", "AC/GT": "other", "A": "other", "A/N": "other"}
    rows = spark.createDataFrame(list(want.items()), "a string, want string")
    for r in rows.withColumn("got", hmp_site_type(F.col("a"))).collect():
        assert r.got == r.want, r


def test_r2_is_squared_correlation(spark):
    x = np.array([[(i * i + 3 * j * i + j) % 3 for j in range(40)] for i in range(6)])
    calls = spark.createDataFrame([(i, "1", 100 * (i + 1), j, int(x[i, j])) for i in range(6) for j in range(40)], "v int, chr string, pos long, smp int, dos int")
    for r in genotypes.r2(calls, 10_000).collect():
        if x[r.i].std() and x[r.j].std():
            assert abs(r.r2 - np.corrcoef(x[r.i], x[r.j])[0, 1] ** 2) < 1e-8


def test_trees_recover_additive_distances():
    names = list("abcd")
    d = np.array([[0, 3, 7, 8], [3, 0, 6, 7], [7, 6, 0, 5], [8, 7, 5, 0]], float)
    t = tree.midpoint_root(tree.neighbor_joining(names, d))
    for i in range(4):
        far = tree._reach(t, i)[0]
        assert [round(far[j], 9) for j in range(4)] == d[i].tolist()
    assert tree.newick(t).count(":") == len(t.edges)
    assert tree.clusters(names, d, 2) == {"a": 1, "b": 1, "c": 2, "d": 2}


def test_deep_trees():
    """A ladder of 3,000 tips is written, laid out and cut without recursion."""
    n = 3_000
    t = tree.Tree([f"t{i}" for i in range(n)], [(n + i, c, 1.0) for i in range(n - 1) for c in ((i, n + i + 1) if i < n - 2 else (i, i + 1))], n)
    text = tree.newick(t)
    assert text.count("(") == text.count(")") == n - 1 and all(f"t{i}:" in text for i in (0, n - 2, n - 1))
    places = {x: (depth, y, size) for x, depth, y, size in tree.coordinates(t)}
    assert len(places) == 2 * n - 1 and places[n] == (0.0, places[n][1], n) and sorted(places[i][1] for i in range(n)) == list(range(1, n + 1))


def test_variant_sites(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\nchr1\t5\t.\tA\tG\t.\t.\t.\tGT\t0/1\nchr1\t9\t.\tA\tAT\t.\t.\t.\tGT\t0/1\nchr2\tx\t.\tA\tG\t.\t.\t.\tGT\t0/1\n")
    got = [tuple(r) for r in variant_sites(spark, str(tmp_path / "a.vcf")).orderBy("pos").collect()]
    assert got == [("1", 5, "SNP"), ("1", 9, "indel")]


def test_comparison_of_ld_tables(spark):
    x = {(1, 2): 0.5, (1, 3): 0.25, (2, 3): 0.75, (3, 4): None, (1, 9): 0.1}
    y = {(1, 2): 0.4, (1, 3): 0.3, (2, 3): 0.7, (3, 4): 0.2, (2, 8): 0.2}
    a, b = (spark.createDataFrame([(*k, v) for k, v in t.items()], "i int, j int, v double") for t in (x, y))
    r = genotypes.compare(a, b, "v", "v").first()
    both = [(x[k], y[k]) for k in x if y.get(k) is not None and x[k] is not None]
    assert (r.n_variants, r.n_pairs) == (4, 3) and abs(r.correlation - np.corrcoef(*zip(*both))[0, 1]) < 1e-12


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
