"""Variant annotation by gene models: location, feature, distance, other genes, nearest gene."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.intervals import nearest, range_join

RANK = "CASE location WHEN 'exon' THEN 1 WHEN 'intron' THEN 2 WHEN 'genic' THEN 3 WHEN 'upstream' THEN 4 ELSE 5 END"


def candidates(variants: DataFrame, genes: DataFrame, features: DataFrame | None, upstream: int = 3000, downstream: int = 1000, width: int = 100_000) -> DataFrame:
    """Every (variant, gene) within the windows, with location, feature and distance_bp.

    variants: vid, chr, pos. genes: gene_id, chr, start, end, strand, and gene_ord where gene models have one. features: gene_id, f_start, f_end, class.
    ord: the gene's place among all, for ties.
    """
    reach = max(upstream, downstream, 0)
    place = F.struct(F.col("gene_ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")) if "gene_ord" in genes.columns else F.struct(F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"))
    wide = genes.select(place.alias("ord"), "gene_id", "chr", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "strand", F.greatest(F.col("start") - reach, F.lit(0)).alias("start"), (F.col("end") + reach).alias("end"))
    hit = range_join(variants.select("vid", "chr", "pos"), wide, width).drop("start", "end")
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))
    inside = F.col("pos").between(F.col("g_start"), F.col("g_end"))
    before = F.when(minus, F.col("pos") - F.col("g_end")).otherwise(F.col("g_start") - F.col("pos"))
    after = F.when(minus, F.col("g_start") - F.col("pos")).otherwise(F.col("pos") - F.col("g_end"))
    hit = hit.withColumns({
        "place": F.when(inside, "inside").when((before > 0) & (before <= upstream), "upstream").when((after > 0) & (after <= downstream), "downstream"),
        "distance_bp": F.when(inside, F.lit(0)).otherwise(F.greatest(F.col("g_start") - F.col("pos"), F.col("pos") - F.col("g_end"))).cast("long"),
    }).where("place IS NOT NULL")
    if features is None:
        return hit.select("vid", "gene_id", F.when(F.col("place") == "inside", "genic").otherwise(F.col("place")).alias("location"), F.lit(None).cast("string").alias("feature"), "distance_bp", "strand", "ord")
    # a gene's features are one row, so each hit meets them once; a gene without features is gene_only
    models = features.groupBy("gene_id").agg(
        F.min(F.when(F.col("class") == "CDS", F.col("f_start"))).alias("c_lo"), F.max(F.when(F.col("class") == "CDS", F.col("f_end"))).alias("c_hi"),
        F.collect_list(F.struct("class", "f_start", "f_end")).alias("parts"), F.lit(True).alias("has"),
    )
    full = hit.join(models, "gene_id", "left")
    here = F.filter("parts", lambda f: F.col("pos").between(f["f_start"], f["f_end"]) & (F.col("place") == "inside"))
    full = full.withColumn("classes", F.transform(here, lambda f: f["class"])).drop("parts")
    full = full.withColumns({c: F.array_contains("classes", c).cast("int") for c in ("CDS", "UTR5", "UTR3", "UTR")} | {"in_exon": (F.size("classes") > 0).cast("int")})
    location = F.when(F.col("place") != "inside", F.col("place")).when(F.col("has").isNull(), "genic").when(F.col("in_exon") == 1, "exon").otherwise("intron")
    side = F.when(F.col("pos") < F.col("c_lo"), F.when(minus, "3'UTR").otherwise("5'UTR")).when(F.col("pos") > F.col("c_hi"), F.when(minus, "5'UTR").otherwise("3'UTR"))
    feature = F.when(
        location == "exon",
        F.when(F.col("CDS") == 1, "CDS").when(F.col("UTR5") == 1, "5'UTR").when(F.col("UTR3") == 1, "3'UTR").when(side.isNotNull(), side).when(F.col("UTR") == 1, "UTR").otherwise("non-coding exon"),
    )
    return full.select("vid", "gene_id", location.alias("location"), feature.alias("feature"), "distance_bp", "strand", "ord")


def annotate(variants: DataFrame, genes: DataFrame, features: DataFrame | None = None, upstream: int = 3000, downstream: int = 1000, width: int = 100_000) -> DataFrame:
    """``variants`` (vid, chr, pos, ...) with gene, location, feature, distance_bp, gene_strand, other_genes.

    One shuffle by variant ranks its genes, one by stretch of the chromosome finds the nearest edges.
    """
    hit = candidates(variants, genes, features, upstream, downstream, width)
    best = hit.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct(F.expr(RANK).alias("rk"), "distance_bp", "ord", "gene_id", "location", "feature", "strand"))).alias("g"))
    best = best.select(
        "vid", F.col("g")[0].alias("b"),
        F.array_join(F.transform(F.slice("g", 2, 1 << 30), lambda x: F.concat(x["gene_id"], F.lit("("), x["location"], F.lit(")"))), ";").alias("others"),
    )
    # the nearest edge is told for every variant in the same pass, so that nothing above is planned twice
    rows = nearest(variants.join(best, "vid", "left"), genes.select("gene_id", "chr", "start", "end", "strand"), carry="strand", bins=variants)
    lone = F.col("b").isNull()
    return rows.select(
        *variants.columns,
        F.when(lone, F.col("near_gene")).otherwise(F.col("b.gene_id")).alias("gene"),
        F.when(lone, "intergenic").otherwise(F.col("b.location")).alias("location"),
        F.col("b.feature").alias("feature"),
        F.when(lone, F.col("near_distance")).otherwise(F.col("b.distance_bp")).cast("long").alias("distance_bp"),
        F.when(lone, F.col("near_strand")).otherwise(F.col("b.strand")).alias("gene_strand"),
        F.when(F.col("others") != "", F.col("others")).alias("other_genes"),
    )


def introns(exons: DataFrame, tx: str = "tx") -> DataFrame:
    """Gaps between a transcript's neighbouring exons, with exon numbers in the direction of transcription."""
    w = Window.partitionBy(tx).orderBy("start", "end")
    rows = exons.withColumns({"next": F.lead("start").over(w), "exon_number": F.row_number().over(Window.partitionBy(tx).orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))))})
    has = F.col("next") > F.col("end") + 1
    return rows.select(tx, "start", "end", "exon_number", F.when(has, F.col("end") + 1).alias("intron_start"), F.when(has, F.col("next") - 1).alias("intron_end"))


def canonical(parts: DataFrame) -> DataFrame:
    """The transcript of each gene with most coding, then most exonic bases, then least id."""
    size = F.col("end") - F.col("start") + 1
    sums = parts.groupBy("gene_id", "tx").agg(F.sum(F.when(F.col("class") == "CDS", size).otherwise(0)).alias("cds"), F.sum(F.when(F.col("class") == "exon", size).otherwise(0)).alias("exon"))
    best = sums.groupBy("gene_id").agg(F.min(F.struct((-F.col("cds")).alias("c"), (-F.col("exon")).alias("e"), "tx")).alias("b"))
    return best.select("gene_id", F.col("b.tx").alias("tx"), (-F.col("b.c")).alias("cds"), (-F.col("b.e")).alias("exon"))
