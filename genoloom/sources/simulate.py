"""Example files: a locus with an effect, made by a rule from hashes, so that every run and engine gives the same bytes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.sources.sinks import single

#: Haplotypes that samples are mosaics of, and bases between changes of haplotype.
FOUNDERS, STRETCH = 8, 60_000
STEP = 1_500


def _draw(n: int, *parts: Column | str | int) -> Column:
    """0 to n - 1 by a hash of the parts."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), F.lit(n))


def calls(spark: SparkSession, samples: int = 120, variants: int = 400, seed: int = 1) -> DataFrame:
    """v, pos, smp, a, b: alleles of the two haplotypes; 2% are missing (null)."""
    v = spark.range(1, variants + 1).select(F.col("id").alias("v"), (F.col("id") * STEP + _draw(STEP, seed, F.col("id"))).alias("pos"))
    long = v.withColumn("smp", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    gone = _draw(50, seed, F.lit("gone"), "v", "smp") == 0

    def allele(side: int) -> Column:
        founder = _draw(FOUNDERS, seed, F.lit("founder"), F.col("smp"), F.floor(F.col("pos") / STRETCH), side)
        return F.when(~gone, (_draw(10, seed, F.lit("allele"), F.col("v"), founder) < 4).cast("int"))

    return long.select("v", "pos", "smp", allele(1).alias("a"), allele(2).alias("b"))


def _text(df: DataFrame) -> Iterable[str]:
    return (r[0] for r in df.toLocalIterator())


def simulate(spark: SparkSession, folder: str, samples: int = 120, variants: int = 400, seed: int = 1) -> dict[str, str]:
    """gwas.csv, genes.gff3, geno.vcf, geno.hmp.txt, phenotype.csv, blocks.txt and groups.tsv in ``folder``; their paths by name.

    The variant in the middle has an effect, so those in LD with it have small P by the size of their share of it.
    """
    g = calls(spark, samples, variants, seed)
    lead = variants // 2
    own = g.where(F.col("v") == lead).select("smp", (F.col("a") + F.col("b")).alias("x"))
    d = g.select("v", "pos", "smp", (F.col("a") + F.col("b")).alias("y")).join(own, "smp").where("x IS NOT NULL AND y IS NOT NULL")
    sums = d.groupBy("v", "pos").agg(F.expr("count(*)").alias("n"), *[F.sum(e).cast("double").alias(a) for a, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))])
    r2 = F.coalesce(F.try_divide(F.pow(F.expr("n * sxy - sx * sy"), 2), F.expr("(n * sxx - sx * sx) * (n * syy - sy * sy)")), F.lit(0.0))
    noise = _draw(1000, seed, F.lit("noise"), F.col("v")) / 1000.0
    gwas = sums.orderBy("v").select(F.concat_ws(",", F.concat(F.lit("S"), "v"), F.lit("chr01"), "pos", F.pow(F.lit(10.0), -(r2 * 9 + noise)).cast("string")))
    sample_names = [f"L{k:03d}" for k in range(1, samples + 1)]
    gt = lambda side: F.coalesce(F.col(side).cast("string"), F.lit("."))
    wide = g.groupBy("v", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("smp", F.concat_ws("|", gt("a"), gt("b")).alias("t"), F.concat(*[F.when(F.col(s) == 1, "G").when(F.col(s) == 0, "A").otherwise("N") for s in "ab"]).alias("h")))), lambda x: x).alias("c")).orderBy("v")
    vcf = wide.select(F.concat_ws("\t", F.lit("1"), "pos", F.concat(F.lit("S"), "v"), F.lit("A\tG\t.\t.\t.\tGT"), F.array_join("c.t", "\t")))
    hmp = wide.select(F.concat_ws("\t", F.concat(F.lit("S"), "v"), F.lit("A/G\t1"), "pos", F.lit("+\tNA\tNA\tNA\tNA\tNA\tNA"), F.array_join("c.h", "\t")))
    last = (variants + 1) * STEP
    genes = spark.range(1, last // 20_000 + 1).select(F.col("id").alias("k"), (F.col("id") * 20_000 - 15_000 + _draw(3000, seed, F.lit("gene"), F.col("id"))).alias("s"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("d"))

    def gff(kind: str, lo: int, hi: int, note: Column) -> Column:
        return F.concat_ws("\t", F.lit("chr01"), F.lit("example"), F.lit(kind), F.col("s") + lo, F.col("s") + hi, F.lit("."), "d", F.lit("."), note)

    gid = F.concat(F.lit("G"), F.col("k"))
    parts = [gff("gene", 0, 4000, F.concat(F.lit("ID="), gid, F.lit(";Name=gene"), "k", F.lit(";Note=example%20gene"))), gff("mRNA", 0, 4000, F.concat(F.lit("ID="), gid, F.lit(".1;Parent="), gid))]
    parts += [gff(kind, lo, hi, F.concat(F.lit("Parent="), gid, F.lit(".1"))) for kind, lo, hi in (("exon", 0, 1000), ("CDS", 300, 1000), ("exon", 2000, 4000), ("CDS", 2000, 3500))]
    lines = genes.orderBy("k").select(F.explode(F.array(*parts)))
    y = own.orderBy("smp").select(F.concat_ws(",", F.format_string("L%03d", "smp"), (F.coalesce("x", F.lit(1)) * 2 + _draw(100, seed, F.lit("y"), F.col("smp")) / 100.0).cast("string")))
    pos = {r.v: r.pos for r in g.select("v", "pos").where(F.col("v").isin(lead - 20, lead + 20)).distinct().collect()}
    at = lambda name: f"{folder}/{name}"
    return {
        "gwas": single(spark, at("gwas.csv"), ["SNP,Chromosome,Position,P.value", *_text(gwas)]),
        "gff": single(spark, at("genes.gff3"), ["##gff-version 3", f"##sequence-region chr01 1 {last}", *_text(lines)]),
        "vcf": single(spark, at("geno.vcf"), ["##fileformat=VCFv4.2", f"##contig=<ID=1,length={last}>", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *sample_names]), *_text(vcf)]),
        "hapmap": single(spark, at("geno.hmp.txt"), ["\t".join(["rs#", "alleles", "chrom", "pos", "strand", "assembly#", "center", "protLSID", "assayLSID", "panelLSID", "QCcode", *sample_names]), *_text(hmp)]),
        "phenotype": single(spark, at("phenotype.csv"), ["sample,value", *_text(y)]),
        "blocks": single(spark, at("blocks.txt"), ["CHR START END", *[f"1 {a} {b}" for a, b in [(pos.get(lead - 20, 1), pos.get(lead + 20, last))]]]),
        "groups": single(spark, at("groups.tsv"), ["sample\tgroup", *[f"{s}\tP{k % 3 + 1}" for k, s in enumerate(sample_names)]]),
    }
