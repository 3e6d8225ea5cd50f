"""Queries over files: text made from the tables is written by Spark, read back by the readers, and compared with SQL over the tables.

Files are folders of parts in the shared folder of the session, one for each call, and stay there as checkpoints do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.operators import genotypes as ld
from genoloom.plans import surrogates as s
from genoloom.plans.catalog import CAND, PAIRS, PARSED, SIZES, TYPES, _blk, _gwas, query
from genoloom.plans.surrogates import duck, view
from genoloom.plans.variants import annotate_variants
from genoloom.sources import genome, genotypes, gff, gwas, sinks
from genoloom.sources.text import shared_folder

SAMPLES = 32


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}/{name}"


def _delimited(rows: DataFrame, name: str, sep: str = "\t", header: bool = True, null: str = "") -> str:
    """Part files with their column names first, as they are: nothing is quoted."""
    path = _path(rows.sparkSession, name)
    rows.write.option("comment", "\u0001").csv(path, sep=sep, header=header, quote="", nullValue=null, emptyValue="")  # a first "#" is no comment
    return path


def _text(rows: DataFrame, name: str) -> str:
    path = _path(rows.sparkSession, name)
    rows.write.text(path)
    return path


# ---- association results ----
@query(f"""WITH raw AS (SELECT * FROM ({duck(s.GWAS_RAW)}) x WHERE cast(substr(snp, 2) AS bigint) % 5 <> 0), parsed AS {PARSED.split("parsed AS", 1)[1]}
SELECT snp, chr, pos, round(p, 9) AS p, round(-log10(p), 6) AS logp FROM gwas""")
def file_gwas_model(spark, d):
    """P is named for its model, and only rows of the additive test count."""
    test = F.when(F.expr("cast(substr(snp, 2) AS bigint) % 5 = 0"), "DOM").otherwise("add")
    rows = view(spark, d, s.GWAS_RAW).select(F.col("snp").alias("rs_id"), F.concat(F.lit("Chr0"), "chr").alias("#CHROM"), F.col("pos").alias("Base_pair_location"), test.alias("TEST"), F.col("p").alias("yield.MLM"))
    return gwas.read_gwas(spark, _delimited(rows, "g.csv", ",")).select("snp", "chr", "pos", F.round("p", 9).alias("p"), F.round("logp", 6).alias("logp"))


@query(f"WITH {PARSED} SELECT snp, chr, pos, round(p, 9) AS p FROM gwas")
def file_gwas_quoted(spark, d):
    """Rows quoted as a whole, under names that say nothing: the first four columns count."""
    rows = view(spark, d, s.GWAS_RAW).select(F.concat(F.lit('"'), F.concat_ws(",", "snp", "chr", "pos", "p"), F.lit('"')).alias('"one,two,three,four"'))
    return gwas.read_gwas(spark, _delimited(rows, "q.txt")).select("snp", "chr", "pos", F.round("p", 9).alias("p"))


# ---- genotypes ----
LINE = "concat('V', v) AS id, cast(v % 3 + 1 AS string) AS chr, v * 700 + 1 AS pos"
CALLS = f"""WITH g AS ({duck(s.GENO_BLK)}), w AS (SELECT DISTINCT v FROM g), c AS (SELECT {LINE}, v, concat('L', t) AS sample, t FROM w, generate_series(0, {SAMPLES - 1}) x(t)),
calls AS (SELECT CASE WHEN c.v % 10 = 0 THEN concat(c.chr, ':', c.pos) ELSE c.id END AS id, c.chr, c.pos, sample, cast(dos AS double) AS dos FROM c LEFT JOIN g ON g.v = c.v AND g.smp = c.t)"""


def _lines(spark, d, call: str, none: str) -> DataFrame:
    """id, chr, pos, v and a column of calls a sample."""
    rows = view(spark, d, s.CALLS_TEXT).groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("smp", call))).alias("m"))
    rows = rows.withColumns({"id": F.concat(F.lit("V"), "v"), "chr": (F.col("v") % 3 + 1).cast("string"), "pos": F.col("v") * 700 + 1})
    return rows.select("v", "id", "chr", "pos", *[F.coalesce(F.try_element_at("m", F.lit(k).cast("long")), F.lit(none)).alias(f"L{k}") for k in range(SAMPLES)])


def _vcf(spark, d) -> str:
    rows = _lines(spark, d, "call", "./.")
    ident = F.when(F.col("v") % 10 == 0, ".").otherwise(F.col("id"))
    fixed = [F.concat(F.lit("chr0"), "chr").alias("#CHROM"), F.col("pos").alias("POS"), ident.alias("ID"), F.lit("A").alias("REF"), F.lit("G").alias("ALT"), F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), F.lit(".").alias("INFO"), F.lit("GT:DP").alias("FORMAT")]
    return _delimited(rows.select(*fixed, *[f"L{k}" for k in range(SAMPLES)]), "c.vcf")


def _hapmap(spark, d) -> str:
    rows = _lines(spark, d, "hmp", "NN")
    ident = F.when(F.col("v") % 10 == 0, "NA").otherwise(F.col("id"))
    fixed = [ident.alias("rs#"), F.lit("A/G").alias("alleles"), F.col("chr").alias("chrom"), "pos", *[F.lit("NA").alias(n) for n in ("strand", "assembly#", "center", "protLSID", "assayLSID", "panelLSID", "QCcode")]]
    return _delimited(rows.select(*fixed, *[f"L{k}" for k in range(SAMPLES)]), "c.hmp.txt")


def _joined(g: genotypes.Genotypes) -> DataFrame:
    return g.calls.join(g.variants.select("v", "id"), "v").select("id", "chr", "pos", "sample", "dos")


@query(f"{CALLS} SELECT * FROM calls")
def file_vcf_calls(spark, d):
    return _joined(genotypes.read_genotypes(spark, _vcf(spark, d)))


@query(f"{CALLS} SELECT * FROM calls WHERE chr = '2' AND pos BETWEEN 50000 AND 900000 AND sample IN ('L3', 'L17')")
def file_vcf_region(spark, d):
    return _joined(genotypes.read_genotypes(spark, _vcf(spark, d), chrom="chr2", start=50_000, end=900_000, samples=["L3", "L17"]))


@query(f"{CALLS} SELECT * FROM calls")
def file_hapmap_calls(spark, d):
    return _joined(genotypes.read_genotypes(spark, _hapmap(spark, d)))


@query(f"{CALLS} SELECT * FROM calls WHERE chr = '2' AND pos BETWEEN 50000 AND 900000")
def file_hapmap_to_vcf(spark, d):
    """HapMap written as a block-compressed VCF, of which the index finds a region."""
    out = _path(spark, "h.vcf.gz")
    sinks.hapmap_to_vcf(spark, _hapmap(spark, d), out, compression="bgzip")
    return _joined(genotypes.read_genotypes(spark, out, chrom="2", start=50_000, end=900_000))


@query(f"SELECT cast(k % 12 + 1 AS string) AS chr, k AS pos, type FROM ({TYPES}) x")
def file_variant_sites(spark, d):
    rows = view(spark, d, s.ALLELES).select(F.concat(F.lit("Chr0"), F.col("k") % 12 + 1).alias("#CHROM"), F.col("k").alias("POS"), F.lit(".").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), *[F.lit(".").alias(n) for n in ("QUAL", "FILTER", "INFO")], F.lit("GT").alias("FORMAT"), F.lit("0/1").alias("one"))
    return genotypes.variant_sites(spark, _delimited(rows, "s.vcf")).select("chr", "pos", "type")


# ---- gene models ----
#: g: genes with a model (p_partkey % 7 <> 0); f: their parts.
MODELS = f"g AS ({duck(s.GENES)}), f AS ({duck(s.FEATURES)}), n AS (SELECT cast(substr(gene_id, 2) AS bigint) AS k, * FROM g)"
SUMS = "u AS (SELECT gene_id, cast(sum(f_end - f_start + 1) FILTER (WHERE class = 'exon') AS bigint) AS exon_len, cast(sum(f_end - f_start + 1) FILTER (WHERE class = 'CDS') AS bigint) AS cds_len FROM f GROUP BY gene_id)"


def _key() -> Column:
    return F.expr("cast(substr(gene_id, 2) AS bigint)")


def _record(kind, start: str, end: str, attributes) -> Column:
    return F.concat_ws("\t", F.concat(F.lit("Chr0"), "chr"), F.lit("own"), kind, F.col(start), F.col(end), F.lit("."), "strand", F.lit("."), attributes).alias("value")


def _gff3(spark, d, gaps: bool = True) -> str:
    """Gaps: genes without a line of theirs (every third that has transcripts), genes of a line alone (every seventh), transcripts of coding parts alone (every fifth)."""
    genes, parts = view(spark, d, s.GENES), view(spark, d, s.FEATURES)
    lone, own = _key() % 7 == 0, F.concat(F.lit("ID="), "gene_id", F.lit(";Name="), "note")
    some = genes.where(~lone)
    parts = parts.join(some.select("gene_id", "chr", "strand"), "gene_id").where((F.col("class") == "CDS") | (_key() % 5 != 0) | F.lit(not gaps))
    text = genes.where(lone | (_key() % 3 != 0) | F.lit(not gaps)).select(_record(F.lit("gene"), "start", "end", own))
    text = text.unionByName(some.select(_record(F.lit("mRNA"), "start", "end", F.concat(F.lit("ID="), "gene_id", F.lit(".t1;Parent="), "gene_id"))))
    text = text.unionByName(parts.select(_record(F.col("class"), "f_start", "f_end", F.concat(F.lit("Parent="), "gene_id", F.lit(".t1")))))
    return _text(text, "m.gff3")


@query(f"""WITH {MODELS} SELECT gene_id, chr, start, "end" AS gend, strand, CASE WHEN k % 7 = 0 OR k % 3 <> 0 THEN note ELSE gene_id END AS name, 'gene' AS type, concat(gene_id, CASE WHEN k % 7 = 0 THEN '.gene' ELSE '.t1' END) AS canonical,
row_number() OVER (ORDER BY start, "end") AS gene_ord FROM n""")
def file_gff_genes(spark, d):
    return gff.read_gff(spark, _gff3(spark, d)).genes.select("gene_id", "chr", "start", F.col("end").alias("gend"), "strand", "name", "type", "canonical", F.col("gene_ord").cast("long").alias("gene_ord"))


@query(f"""WITH {MODELS}, {SUMS} SELECT concat(n.gene_id, CASE WHEN k % 7 = 0 THEN '.gene' ELSE '.t1' END) AS transcript_id, n.gene_id, CASE WHEN k % 7 = 0 THEN 'gene_only' ELSE 'mRNA' END AS type,
CASE WHEN k % 7 = 0 THEN "end" - start + 1 WHEN k % 5 = 0 THEN cds_len ELSE exon_len END AS exon_len, coalesce(cds_len, 0) AS cds_len, true AS canonical FROM n LEFT JOIN u ON n.gene_id = u.gene_id""")
def file_gff_transcripts(spark, d):
    return gff.read_gff(spark, _gff3(spark, d)).transcripts.select("transcript_id", "gene_id", "type", "exon_len", "cds_len", "canonical")


@query(f"""WITH {MODELS} SELECT gene_id, class, f_start, f_end FROM (SELECT gene_id, class, f_start, f_end FROM f WHERE class = 'CDS' OR cast(substr(gene_id, 2) AS bigint) % 5 <> 0
UNION ALL SELECT gene_id, 'exon', f_start, f_end FROM f WHERE class = 'CDS' AND cast(substr(gene_id, 2) AS bigint) % 5 = 0 UNION ALL SELECT gene_id, 'exon', start, "end" FROM n WHERE k % 7 = 0) x""")
def file_gff_features(spark, d):
    return gff.read_gff(spark, _gff3(spark, d)).features.select("gene_id", "class", F.col("start").alias("f_start"), F.col("end").alias("f_end"))


@query(f"""WITH {MODELS}, {SUMS} SELECT n.gene_id, chr, start, "end" AS gend, strand, CASE WHEN k % 4 = 0 THEN n.gene_id ELSE note END AS name, concat(n.gene_id, '.t1') AS canonical, exon_len, cds_len FROM n JOIN u ON n.gene_id = u.gene_id""")
def file_gtf_models(spark, d):
    """No gene has a line, and every fourth transcript none: parts alone make them."""
    some = view(spark, d, s.GENES).where(_key() % 7 != 0)
    parts = view(spark, d, s.FEATURES).join(some.select("gene_id", "chr", "strand", "note"), "gene_id")
    own = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "gene_id", F.lit('.t1"; gene_name "'), "note", F.lit('";'))
    text = some.where(_key() % 4 != 0).select(_record(F.lit("transcript"), "start", "end", own)).unionByName(parts.select(_record(F.col("class"), "f_start", "f_end", own)))
    m = gff.read_gff(spark, _text(text, "m.gtf"))
    tx = m.transcripts.select("gene_id", "exon_len", "cds_len")
    return m.genes.select("gene_id", "chr", "start", F.col("end").alias("gend"), "strand", "name", "canonical").join(tx, "gene_id")


@query(f"""WITH {CAND} SELECT v.snp, v.chr, v.pos, ann.gene AS gene_id, g.note AS gene_name, g.strand, location, feature, cast(distance_bp AS bigint) AS distance_bp, p AS extra
FROM v LEFT JOIN ann ON v.vid = ann.vid LEFT JOIN genes g ON g.gene_id = ann.gene""")
def file_annotate(spark, d):
    """A table of variants with a column of its own, by a file of gene models."""
    rows = view(spark, d, s.VARIANTS).select("snp", F.concat(F.lit("Chr0"), "chr").alias("chr"), "pos", F.col("p").alias("extra"))
    return annotate_variants(spark, rows, _gff3(spark, d, gaps=False)).select("snp", "chr", "pos", "gene_id", "gene_name", "strand", "location", "feature", "distance_bp", "extra")


# ---- lengths, blocks, pairs, groups ----
@query(f"WITH {PARSED}, {SIZES} SELECT chr, length FROM sizes")
def file_chrom_sizes(spark, d):
    sizes = _gwas(spark, d).groupBy("chr").agg(F.max("pos").alias("length"))
    nothing = spark.createDataFrame([("X", 0)], sizes.schema)
    rows = sizes.unionByName(nothing).select(F.concat(F.lit("chromosome_"), "chr").alias("chr"), "length")
    return genome.sizes_of(spark, _delimited(rows, "sizes.txt", header=False))


LENGTH = "s_suppkey * 37 % 500 + 60"
CONTIGS = f"SELECT concat('Chr', s_suppkey) AS contig, s_suppkey AS k, substring(repeat('ACGT', 140), 1, cast({LENGTH} AS int)) AS seq FROM {{supplier}}"
SITES = "SELECT concat('Chr', s_suppkey) AS contig, s_suppkey * 13 % 700 AS pos FROM {supplier} UNION ALL SELECT concat('Chr', s_suppkey), s_suppkey * 7 % 500 + 1 FROM {supplier}"


def _fasta(spark, d) -> str:
    """A contig a supplier, in lines of 60."""
    body = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.expr("cast((length(seq) - 1) div 60 AS int)")), lambda i: F.substr("seq", i * 60 + 1, F.lit(60))))
    return _text(view(spark, d, CONTIGS).select(F.concat(F.lit(">"), "contig", F.lit(" of a supplier\n"), body).alias("value")), "c.fa")


@query(f"SELECT cast(k AS string) AS chr, cast(length(seq) AS bigint) AS length FROM ({duck(CONTIGS)}) x")
def file_fasta_lengths(spark, d):
    return genome.chrom_sizes(spark, _fasta(spark, d))


@query(f"WITH c AS ({duck(CONTIGS)}), w AS ({duck(SITES)}) SELECT w.contig, pos, CASE WHEN pos BETWEEN 1 AND length(seq) THEN substring(seq, cast(pos AS int), 1) END AS base FROM w JOIN c ON w.contig = c.contig")
def file_fasta_bases(spark, d):
    return genome.fasta_bases(spark, _fasta(spark, d), view(spark, d, SITES))


@query(f"SELECT r_chr AS chr, r_start AS start, r_end AS gend, cast(region_id % 50 AS int) AS nsnps, concat('a', region_id, '|b') AS snps FROM ({duck(s.REGIONS)}) x")
def file_blocks(spark, d):
    rows = view(spark, d, s.REGIONS).select(F.col("r_chr").alias("CHR"), F.col("r_start").alias("BP1"), F.col("r_end").alias("BP2"), F.lit(20.0).alias("KB"), (F.col("region_id") % 50).alias("NSNPS"), F.concat(F.lit("a"), "region_id", F.lit("|b")).alias("SNPS"))
    return genome.read_blocks(spark, _delimited(rows, "b.det")).select("chr", "start", F.col("end").alias("gend"), "nsnps", "snps")


@query(f"""WITH {PAIRS}, p AS (SELECT concat('V', i) AS id_a, pos_i AS pos_a, concat('V', j) AS id_b, pos_j AS pos_b, round(r2, 6) AS value FROM ld), b AS (SELECT * FROM p UNION ALL SELECT id_b, pos_b, id_a, pos_a, value FROM p)
SELECT * FROM b UNION ALL SELECT DISTINCT id_a, pos_a, id_a, pos_a, cast(1.0 AS double) FROM b""")
def file_ld_pairs(spark, d):
    rows = ld.r2(_blk(spark, d), 20_000).select(F.lit("1").alias("CHR_A"), F.col("pos_i").alias("BP_A"), F.concat(F.lit("V"), "i").alias("SNP_A"), F.lit("1").alias("CHR_B"), F.col("pos_j").alias("BP_B"), F.concat(F.lit("V"), "j").alias("SNP_B"), F.round("r2", 6).alias("R2"))
    return genome.read_ld(spark, _delimited(rows, "p.ld", null="nan"))


GROUPS = "SELECT concat('C', c_custkey) AS sample, concat('seg', c_custkey % 7) AS grp FROM {customer}"


@query(duck(GROUPS))
def file_groups(spark, d):
    return genome.read_groups(spark, _delimited(view(spark, d, GROUPS).select(F.col("sample").alias("Sample"), F.col("grp").alias("Population")), "groups.txt"))
