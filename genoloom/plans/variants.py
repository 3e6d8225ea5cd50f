"""Annotation of variants in whatever form they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.names import normalize_chr
from genoloom.operators.annotate import annotate
from genoloom.sources.genotypes import Genotypes
from genoloom.sources.gff import Genes, read_gff
from genoloom.sources.text import stored

#: Columns of the result; others of a table are kept behind them.
COLUMNS = ["snp", "chr", "pos", "gene_id", "gene_name", "strand", "location", "feature", "distance_bp", "description", "other_genes"]


def variants_of(spark: SparkSession, x: Genotypes | DataFrame | Sequence[int], chrom: str | None = None, chr_map: dict[str, str] | None = None) -> DataFrame:
    """vid, snp, chr, pos (and a table's further columns) of genotypes, a table with pos, a table of LD pairs (id_a, pos_a), or positions on ``chrom``.

    A table without snp names its rows v1, v2, ... (with gaps, where it has several partitions); one without chr lies on ``chrom``. Rows are stored once, so vid stays.
    """
    given = F.lit(chrom).cast("string")
    if isinstance(x, Genotypes):
        rows = x.variants.select(F.col("id").alias("snp"), "chr", "pos")
    elif not isinstance(x, DataFrame):
        if chrom is None:
            raise ValueError("positions need the chromosome they lie on")
        rows = spark.createDataFrame([(int(p),) for p in x], "pos long").select(F.concat(given, F.lit(":"), "pos").alias("snp"), given.alias("chr"), "pos")
    elif {"id_a", "pos_a"} <= set(x.columns):
        rows = x.select(F.col("id_a").alias("snp"), given.alias("chr"), F.col("pos_a").alias("pos")).distinct()
    elif "pos" in x.columns:
        keep = [c for c in x.columns if c not in (*COLUMNS, "vid")]
        own = [(F.col(c) if c in x.columns else other).alias(c) for c, other in (("snp", F.lit(None)), ("chr", given))]
        rows = x.select(*[c.cast("string") for c in own], F.col("pos").try_cast("long").alias("pos"), *[F.col(f"`{c}`") for c in keep])
        rows = rows.toDF("snp", "chr", *rows.columns[2:])
    else:
        raise ValueError("a table of variants needs a column pos")
    rows = rows.withColumn("vid", F.monotonically_increasing_id())
    named = rows.withColumns({"chr": normalize_chr(F.col("chr"), chr_map), "snp": F.coalesce("snp", F.concat(F.lit("v"), F.col("vid") + 1))})
    return stored(named.select("vid", "snp", "chr", "pos", *[F.col(f"`{c}`") for c in rows.columns if c not in ("vid", "snp", "chr", "pos")]))


def modelled(genes: Genes) -> DataFrame:
    """Features (gene_id, class, f_start, f_end) of genes whose file tells a transcript or parts."""
    some = genes.features.join(genes.transcripts.where("type <> 'gene_only'").select("transcript_id"), "transcript_id", "left_semi")
    return some.select("gene_id", "class", F.col("start").alias("f_start"), F.col("end").alias("f_end"))


def annotate_variants(spark: SparkSession, x: Genotypes | DataFrame | Sequence[int], genes: Genes | str, chrom: str | None = None, upstream: int = 3000, downstream: int = 1000, chr_map: dict[str, str] | None = None) -> DataFrame:
    """COLUMNS of each row of ``x`` (see :func:`variants_of`) by gene models or their file.

    A row without position or chromosome, or on a chromosome without genes, is intergenic with no gene.
    """
    rows = variants_of(spark, x, chrom, chr_map)
    models = read_gff(spark, genes, chr_map=chr_map) if isinstance(genes, str) else genes
    more = [c for c in rows.columns if c not in ("vid", "snp", "chr", "pos")]
    # a table's own columns go along as one; a row without a place passes by, as no gene is near it
    placed = F.col("chr").isNotNull() & F.col("pos").isNotNull()
    rows = rows.select("vid", "snp", "chr", "pos", (F.struct(*[F.col(f"`{c}`") for c in more]) if more else F.lit(0)).alias("own_columns"))
    found = annotate(rows.where(placed), models.genes, modelled(models), upstream, downstream)
    names = models.genes.select(F.col("gene_id").alias("gene"), F.col("name").alias("gene_name"), F.col("note").alias("description"))
    found = found.join(names, "gene", "left").withColumnsRenamed({"gene": "gene_id", "gene_strand": "strand"}).select(*COLUMNS, "own_columns")
    out = found.unionByName(rows.where(~placed).withColumn("location", F.lit("intergenic")).drop("vid"), allowMissingColumns=True)
    return out.select(*COLUMNS, *[F.col("own_columns")[c].alias(c) for c in more])
