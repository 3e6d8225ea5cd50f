"""Locus tables derived from the star-schema test tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GWAS_RAW = """SELECT concat('S', o_orderkey) AS snp, cast(o_custkey % 12 + 1 AS string) AS chr, cast(cast(floor(o_orderkey / 2) AS bigint) * 1000 + 1 AS string) AS pos,
    CASE WHEN o_orderkey % 97 = 0 THEN '0' WHEN o_orderkey % 89 = 0 THEN 'NA' WHEN o_orderkey % 83 = 0 THEN '1.5' ELSE cast(o_totalprice / 500000 AS string) END AS p FROM {orders}"""
GWAS_IDS = """SELECT CASE WHEN o_orderkey % 50 = 0 THEN '.' ELSE concat('S', o_orderkey % 1000) END AS snp, cast(o_custkey % 12 + 1 AS string) AS chr, cast(cast(floor(o_orderkey / 2) AS bigint) * 1000 + 1 AS string) AS pos,
    cast(o_totalprice / 500000 AS string) AS p FROM {orders}"""
VARIANTS = """SELECT o_orderkey AS vid, concat('S', o_orderkey) AS snp, cast(o_custkey % 12 + 1 AS string) AS chr, cast(floor(o_orderkey / 2) AS bigint) * 160 + 1 AS pos,
    o_totalprice / 500000 AS p FROM {orders}"""
GENES = """SELECT concat('G', p_partkey) AS gene_id, cast(p_partkey % 12 + 1 AS string) AS chr, p_partkey * 600 + 1 AS start, p_partkey * 600 + 1 + p_size * 40 AS `end`,
    CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_name AS note FROM {part}"""
#: Of genes with p_partkey % 7 <> 0 (the others have no model): exons are the outer thirds, coding but for a tenth at either end.
FEATURES = """SELECT concat('G', p_partkey) AS gene_id, 'exon' AS class, p_partkey * 600 + 1 AS f_start, p_partkey * 600 + 1 + cast(floor(p_size * 40 / 3) AS bigint) AS f_end FROM {part} WHERE p_partkey % 7 <> 0
    UNION ALL SELECT concat('G', p_partkey), 'exon', p_partkey * 600 + 1 + p_size * 40 - cast(floor(p_size * 40 / 3) AS bigint), p_partkey * 600 + 1 + p_size * 40 FROM {part} WHERE p_partkey % 7 <> 0
    UNION ALL SELECT concat('G', p_partkey), 'CDS', p_partkey * 600 + 1 + p_size * 4, p_partkey * 600 + 1 + cast(floor(p_size * 40 / 3) AS bigint) FROM {part} WHERE p_partkey % 7 <> 0
    UNION ALL SELECT concat('G', p_partkey), 'CDS', p_partkey * 600 + 1 + p_size * 40 - cast(floor(p_size * 40 / 3) AS bigint), p_partkey * 600 + 1 + p_size * 36 FROM {part} WHERE p_partkey % 7 <> 0"""
REGIONS = """SELECT s_suppkey AS region_id, cast(s_suppkey % 12 + 1 AS string) AS r_chr, s_suppkey * 9000 + 1 AS r_start, s_suppkey * 9000 + 20000 AS r_end FROM {supplier}"""
GENO_OBS = """SELECT concat('V', l_partkey) AS id, cast(l_partkey % 4 + 1 AS string) AS chr, l_partkey * 500 + 1 AS pos, l_suppkey % 16 AS smp, min(l_linenumber) % 3 AS dos
    FROM {lineitem} GROUP BY l_partkey, l_suppkey % 16"""
#: Calls of the parts a supplier of each of 32 groups has sold; dosages by a rule, alike within runs of 12 parts.
GENO_BLK = """SELECT v, '1' AS chr, v * 700 + 1 AS pos, s AS smp, CASE WHEN (s * 31 + v * 11) % 23 = 0 THEN NULL WHEN (s * 13 + v * 17) % 97 = 0 THEN 1
    WHEN (s * s * (b + 1) + s * 7 + b * b * 5) % 11 < 5 THEN 2 ELSE 0 END AS dos
    FROM (SELECT DISTINCT l_partkey AS v, l_suppkey % 32 AS s, cast(floor(l_partkey / 12) AS bigint) AS b FROM {lineitem}) x"""
#: The same calls with a phase; which haplotype of a heterozygote is the other allele alternates.
GENO_PHASED = """SELECT v, chr, pos, smp, dos, CASE dos WHEN 2 THEN 1 WHEN 0 THEN 0 WHEN 1 THEN (smp + v) % 2 END AS h1,
    CASE dos WHEN 2 THEN 1 WHEN 0 THEN 0 WHEN 1 THEN (smp + v + 1) % 2 END AS h2 FROM ({geno_blk}) g"""
ALLELES = """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'AT' WHEN 2 THEN 'G' WHEN 3 THEN 'CTT' WHEN 4 THEN 'T' ELSE '.' END AS ref,
    CASE p_size % 7 WHEN 0 THEN 'T' WHEN 1 THEN 'A' WHEN 2 THEN 'C,G' WHEN 3 THEN 'AC' WHEN 4 THEN '<DEL>' WHEN 5 THEN '*' ELSE 'CT,C' END AS alt FROM {part}"""
CALLS_TEXT = """SELECT v, smp, CASE dos WHEN 0 THEN '0/0:12' WHEN 1 THEN '0|1:9' WHEN 2 THEN '1/1:7' ELSE './.:0' END AS call,
    CASE dos WHEN 0 THEN CASE WHEN smp % 2 = 0 THEN 'AA' ELSE 'A' END WHEN 1 THEN CASE WHEN smp % 2 = 0 THEN 'AG' ELSE 'R' END WHEN 2 THEN CASE WHEN smp % 2 = 0 THEN 'GG' ELSE 'G' END ELSE 'N' END AS hmp FROM ({geno_blk}) g"""
ATTRS = """SELECT p_partkey AS k, concat('ID=G', p_partkey, ';Name=', p_name, '%3B', ';Note=', p_type) AS gff3, concat('gene_id "G', p_partkey, '"; gene_name "', p_name, '"; level ', p_size, ';') AS gtf FROM {part}"""
LABELS = """SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN concat('Chr0', c_custkey % 9 + 1) WHEN 1 THEN concat('chromosome_', c_custkey % 20 + 1) WHEN 2 THEN concat('SL4.0ch0', c_custkey % 9 + 1)
    WHEN 3 THEN 'CHR_X' WHEN 4 THEN 'chrM' WHEN 5 THEN 'ChrC' WHEN 6 THEN concat(' ch', c_custkey % 12 + 1, ' ') WHEN 7 THEN 'scaffold_7' ELSE 'y' END AS label FROM {customer}"""

LABELS_MIXED = """SELECT c_custkey AS k, CASE c_custkey % 10 WHEN 0 THEN concat('SL4.0Ch0', c_custkey % 7 + 1) WHEN 1 THEN concat('sl2.50CH', c_custkey % 7 + 1) WHEN 2 THEN concat(c_custkey % 7 + 1, 'A') WHEN 3 THEN concat('chr', c_custkey % 7 + 1, 'B')
    WHEN 4 THEN concat('Chr0', c_custkey % 7 + 1, 'D') WHEN 5 THEN concat('1e', c_custkey % 7 + 1) WHEN 6 THEN concat('CHROM-', c_custkey % 7 + 1) WHEN 7 THEN concat(c_custkey % 7 + 1, 'F') WHEN 8 THEN 'SL4.0chr' ELSE 'NaN' END AS label FROM {customer}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The DataFrame of a surrogate's SQL over the tables of ``sf_dir``."""
    text = text.replace("{geno_blk}", GENO_BLK)
    names = [n for n in ("orders", "part", "supplier", "lineitem", "customer", "events", "embeddings") if "{" + n + "}" in text]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def duck(text: str) -> str:
    """The same SQL for DuckDB."""
    text = text.replace("{geno_blk}", GENO_BLK).replace("`", '"')
    for n in ("orders", "part", "supplier", "lineitem", "customer", "events", "embeddings"):
        text = text.replace("{" + n + "}", n)
    return text
