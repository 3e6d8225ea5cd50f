"""Names within two edits; stores of best rows over drops."""

import random
from pathlib import Path

import pytest

from genoloom.operators import gwas, similar
from genoloom.streaming import ingest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_same_names_as_a_full_scan(spark):
    rng = random.Random(8)
    names = {"".join(rng.choice("abS12") for _ in range(rng.randint(0, 7))) for _ in range(400)} | {"S12", "ab", "é1", ""}
    index = similar.saved_index(spark.createDataFrame([(n,) for n in [*names, None]], "snp string"))
    for q in ["S12", "", "abab12", "é", "zzzzzz", "S1b2a", "aabbS12"]:
        want = sorted((distance(q, n), n) for n in names if distance(q, n) <= 2)[:5]
        assert similar.similar(index, q) == [n for _, n in want], q


def test_target_names_similar_ids(spark):
    g = spark.createDataFrame([("rs1001", "1", 5, 0.1), ("rs1002", "1", 6, 0.2), ("other", "1", 7, 0.3)], "snp string, chr string, pos long, p double")
    with pytest.raises(ValueError, match="similar: rs1001, rs1002$"):
        gwas.resolve_target(g, "rs100")
    with pytest.raises(ValueError, match="no SNP 'unlike'$"):
        gwas.resolve_target(g, "unlike")


DROPS = [
    "s1\tchr1\t100\t0.5\ns2\tchr1\t200\t0\n.\tchr2\t7\t0.01\ndup\tchr1\t900\t0.2\nbad\tchr1\tx\t0.1\n",
    "s1b\tChr01\t100\t0.4\ns2b\t1\t200\t0.003\nlate\tchr2\t7\t0.3\ndup\tchr3\t60000000\t0.9\n",
    "s1c\t1\t100\t0.45\ns2c\t1\t200\t0\ndup\tchr3\t1\t0.05\n",
]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_drops_in_any_order_are_one_table(spark, tmp_path, order):
    drop, store = tmp_path / "drop", str(tmp_path / "store")
    drop.mkdir()
    for k, n in enumerate(order):
        Path(drop, f"{k}.tsv").write_text(DROPS[n])
        rows = ingest.stream_gwas(spark, str(drop), ["snp", "chr", "pos", "p"])
        ingest.ingest_best(rows, store, str(tmp_path / "ck")).awaitTermination()  # a restart a drop
    raw = spark.createDataFrame([line.split("\t") for d in DROPS for line in d.splitlines()], "snp string, chr string, pos string, p string")
    want = sorted(map(tuple, gwas.qc(raw).collect()))
    assert sorted(map(tuple, ingest.read_best(spark, store).collect())) == want
    assert len({r[0] for r in want}) == len(want) == 6
    # a batch that is run again leaves the store as it was
    again = gwas.parse(spark.createDataFrame([x.split("\t") for x in DROPS[order[-1]].splitlines()], "snp string, chr string, pos string, p string")).where("pos IS NOT NULL").withColumn("pos", gwas.F.col("pos").cast("long"))
    ingest.merge_batch(again, store, 2)
    assert sorted(map(tuple, ingest.read_best(spark, store).collect())) == want
    rewritten = {p.name for p in Path(store, "bins", "2").glob("bin=*")}
    assert rewritten == {f"bin={b}" for b in (("1_0", "3_0") if order[-1] == 2 else ("1_0", "2_0"))}


def test_vcf_drops(spark, tmp_path):
    Path(tmp_path, "a.vcf").write_text("##x\n#CHROM\tPOS\nchr1\t5\t.\tA\tG\t.\t.\t.\tGT:DP\t0/1:3\t1|1:2\n")
    rows = ingest.stream_vcf(spark, str(tmp_path), ["x", "y"])
    q = rows.writeStream.format("memory").queryName("vcf_drops").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, r.chr, r["sample"], r.dos) for r in spark.table("vcf_drops").collect()) == [("1:5", "1", "x", 1.0), ("1:5", "1", "y", 2.0)]
