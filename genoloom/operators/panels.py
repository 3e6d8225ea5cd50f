"""Geometry of locus panels as DataFrames; drawing is left to whoever reads them.

A panel of one region has as many rows as the region has variants or genes. Windows over a whole
chromosome order genes, bins or chromosomes, never calls.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.functions.genotype import allele_label, r2_bin
from genoloom.functions.names import chr_key, normalize_chr
from genoloom.operators.annotate import introns
from genoloom.operators.density import ramp
from genoloom.operators.gwas import manhattan, thin_grid
from genoloom.operators.ranks import at_ticks, ranked, running
from genoloom.operators.region import Region
from genoloom.operators.tree import Tree, clusters, coordinates

# Default colours of the two halves of a chromosome.
SNP_COLOUR, INDEL_COLOUR = "D7191C", "F2B705"
#: Labels take this share of the panel's width a character, and rows keep this share free between them (fixed values).
CHAR_SHARE, PAD_SHARE = 0.0075, 0.012


# ---- whole genome ----
def manhattan_panel(gwas: DataFrame, layout: DataFrame, thin_from: int = 20_000, low: float = 2.0) -> DataFrame:
    """snp, x, logp, grp of the points to draw: from ``thin_from`` points under ``low`` on, those are one a grid cell."""
    points = manhattan(gwas, layout)
    n = points.agg(F.count_if(F.col("logp") < low)).first()[0]
    return thin_grid(points, low=low) if n >= thin_from else points


def manhattan_frame(gwas: DataFrame, layout: DataFrame, lines: list[float] | None = None, suggestive: bool = False) -> DataFrame:
    """One row: x_max, y_max (over points and threshold ``lines`` in -log10 P), n_off: rows on chromosomes the layout lacks, n_beyond: past their end."""
    at = layout.select("chr", "length", "end_cum")
    rows = gwas.join(at, "chr", "left")
    top = F.greatest(F.max(F.when(F.col("length").isNotNull(), F.col("logp"))), *[F.lit(float(x)) for x in lines or [0.0]])
    out = rows.agg((top * (1.14 if suggestive else 1.06)).alias("y_max"), F.count_if(F.col("length").isNull()).alias("n_off"), F.count_if(F.col("pos") > F.col("length")).alias("n_beyond"))
    return out.select(layout.agg(F.max("end_cum")).scalar().alias("x_max"), "y_max", "n_off", "n_beyond")


def _span(layout: DataFrame, region: Region) -> tuple[Column, Column, Column]:
    """(left edge, right edge, total): a region on the genome's axis, 0.6% of it at least."""
    total = layout.agg(F.max("end_cum")).scalar()
    width = F.greatest(F.lit(float(region.end - region.start)), total * 0.006)
    mid = F.col("offset") + (region.start + region.end) / 2
    return mid - width / 2, mid + width / 2, total


def highlight(layout: DataFrame, region: Region) -> DataFrame:
    """xmin, xmax of the region's rectangle over the genome."""
    left, right, _ = _span(layout, region)
    return layout.where(F.col("chr") == region.chr).select(left.alias("xmin"), right.alias("xmax"))


def zoom_connector(layout: DataFrame, region: Region) -> DataFrame:
    """Two segments from the region's place on the genome (x, y = 1) to the panel's edges (xend, y = 0), all as shares of the width."""
    left, right, total = _span(layout, region)
    row = layout.where(F.col("chr") == region.chr).select((left / total).alias("l"), (right / total).alias("r"))
    return row.select(F.inline(F.array(F.struct(F.col("l").alias("x"), F.lit(0.0).alias("xend")), F.struct(F.col("r").alias("x"), F.lit(1.0).alias("xend")))))


def karyotype(dens: DataFrame, sizes: DataFrame, share: float = 0.99, snp: str = SNP_COLOUR, indel: str = INDEL_COLOUR, width: float = 0.62, horizontal: bool = False) -> DataFrame:
    """Rectangles (xmin, xmax, ymin, ymax in Mb, colour) of the two halves of each bin; colours stop at the quantile ``share`` of non-empty bins."""
    k = sizes.select("chr", F.row_number().over(Window.orderBy(chr_key(F.col("chr")))).alias("at"))  # one row a chromosome
    if horizontal:
        k = k.withColumn("at", F.count("*").over(Window.partitionBy()) - F.col("at") + 1)
    most = {c: dens.agg(F.greatest(F.coalesce(F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(share)), F.lit(1.0)), F.lit(1.0))).scalar() for c in ("snp", "indel")}
    lo, hi = (F.col("bin_start") - 1) / 1e6, F.col("bin_end") / 1e6
    first, second = ((F.col("at"), F.col("at") + width / 2), (F.col("at") - width / 2, F.col("at"))) if horizontal else ((F.col("at") - width / 2, F.col("at")), (F.col("at"), F.col("at") + width / 2))

    def half(kind: str, side: tuple[Column, Column], colour: str) -> Column:
        across, along = ("y", "x") if horizontal else ("x", "y")
        return F.struct(F.lit(kind).alias("half"), side[0].cast("double").alias(across + "min"), side[1].cast("double").alias(across + "max"), lo.alias(along + "min"), hi.alias(along + "max"), ramp(F.col(kind), most[kind], colour).alias("colour"))

    rows = dens.join(k, "chr")
    both = [half("snp", first, snp), half("indel", second, indel)]
    return rows.select("chr", "bin_start", F.explode(F.array(*both)).alias("h")).select("chr", "bin_start", "h.half", "h.xmin", "h.xmax", "h.ymin", "h.ymax", "h.colour")


def centromeres(marks: DataFrame, sizes: DataFrame, width: float = 0.62, horizontal: bool = False, chr_map: dict[str, str] | None = None) -> DataFrame:
    """chr, pos, side, corner (1 to 3), x, y: two triangles beside the chromosome, their tips at its edges, for each of ``marks`` (name and position first).

    Marks of chromosomes that ``sizes`` lacks, and those without a position, have none.
    """
    name, pos = marks.columns[:2]
    order = Window.orderBy(chr_key(F.col("chr")))  # one row a chromosome
    at = sizes.select("chr", F.row_number().over(order).alias("_k"), F.count("*").over(Window.partitionBy()).alias("_n"), F.max("length").over(Window.partitionBy()).alias("_most"))
    rows = marks.select(normalize_chr(F.col(f"`{name}`"), chr_map).alias("chr"), F.col(f"`{pos}`").try_cast("double").alias("pos")).where("pos IS NOT NULL").join(at, "chr")
    mid = (F.col("_n") - F.col("_k") + 1 if horizontal else F.col("_k")).cast("double")
    # fixed values: how far triangles stand out, and their half height as a share of the longest chromosome
    out, half = 0.12, F.col("_most") / 1e6 * (0.008 if horizontal else 0.012)
    along = F.col("pos") / 1e6

    def corners(side: str, way: int) -> list[Column]:
        edge = mid + way * width / 2
        places = [(edge + way * out, along - half), (edge + way * out, along + half), (edge, along)]
        return [F.struct(F.lit(side).alias("side"), F.lit(k).alias("corner"), (b if horizontal else a).alias("x"), (a if horizontal else b).alias("y")) for k, (a, b) in enumerate(places, 1)]

    low, high = ("bottom", "top") if horizontal else ("left", "right")
    return rows.select("chr", F.col("pos").cast("long").alias("pos"), F.inline(F.array(*corners(low, -1), *corners(high, 1))))


# ---- one region ----
def regional(gwas: DataFrame, region: Region, lead: str | None = None, r2: DataFrame | None = None, line: float | None = None) -> DataFrame:
    """snp, pos, logp, r2, bin, is_lead, draw (order: no LD data first, then rising r2) and y_max of a region's points.

    ``r2``: snp, r2. Without ``lead``, or if it is not in the region, the least p leads; ties go to the first position.
    """
    rows = region.select(gwas).select("snp", "pos", "p", "logp")
    known = rows.withColumn("r2", F.lit(None).cast("double")) if r2 is None else rows.join(r2.select("snp", "r2"), "snp", "left")
    best = rows.agg(F.min_by("snp", F.struct(F.lit(0) if lead is None else (F.col("snp") != lead).cast("int"), "p", "pos"))).scalar()
    top = rows.agg(F.greatest(F.max("logp"), F.lit(line))).scalar()
    order = Window.orderBy(F.col("r2").isNotNull(), "r2", "pos", "snp")  # the rows of one region
    return known.select("snp", "pos", "logp", "r2", r2_bin(F.col("r2")).alias("bin"), (F.col("snp") == best).alias("is_lead"), F.row_number().over(order).cast("long").alias("draw"), (top * 1.18).alias("y_max"))


def gene_rows(models: DataFrame, span: float, label: str | None = "name", label_size: float = 2.3, view: tuple[int, int] | None = None) -> DataFrame:
    """``models`` (chr, start, end, ...) with row: the first free row from 1 on, in order of start and end, for gene and label.

    Genes that nothing overlaps from before start afresh at row 1, so each run of overlapping genes is
    packed by itself, and a task holds one run at a time rather than a chromosome.
    """
    width = F.length(F.col(label)) * (span * CHAR_SHARE * label_size / 2.3) if label else F.lit(0.0)
    lo, hi = (F.greatest("start", F.lit(view[0])), F.least("end", F.lit(view[1]))) if view else (F.col("start"), F.col("end"))
    mid = (lo + hi) / 2
    ties = [c for c in ("transcript_id", "gene_id", "name") if c in models.columns]
    by = ["start", "end", *ties]
    order, back = Window.partitionBy("chr").orderBy(*by), Window.partitionBy("chr").orderBy(*[F.desc(c) for c in by])
    rows = models.withColumns({"_l": F.least(F.col("start").cast("double"), mid - F.coalesce(width, F.lit(0.0)) / 2), "_r": F.greatest(F.col("end").cast("double"), mid + F.coalesce(width, F.lit(0.0)) / 2)})
    pad = span * PAD_SHARE
    ahead = F.min("_l").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a growing frame
    behind = F.max("_r").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_k": F.row_number().over(order), "_new": F.coalesce(behind < ahead - pad, F.lit(True)).cast("int")})
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    names = models.columns

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        ends, got = np.empty(0), []
        for left, right in zip(pdf["_l"], pdf["_r"], strict=True):
            free = np.flatnonzero(ends < left - pad)
            if len(free):
                at = int(free[0])
            else:
                at, ends = len(ends), np.append(ends, 0.0)
            ends[at] = right
            got.append(at + 1)
        return pdf[names].assign(row=np.array(got, dtype="int64"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in models.schema.fields)
    return rows.groupBy("chr", "_run").applyInPandas(pack, f"{kinds}, row long")


def gene_boxes(rows: DataFrame, features: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Boxes of exons and coding parts at the packed row: y, half-height (thin exons where the transcript codes), part."""
    coding = features.where("class = 'CDS'").select(key).distinct().withColumn("codes", F.lit(True))
    parts = features.where("class IN ('exon', 'CDS')").select(key, "class", "start", "end").join(rows.select(key, "row"), key).join(coding, key, "left")
    height = F.when((F.col("class") == "CDS") | F.col("codes").isNull(), 0.22).otherwise(0.13)
    return parts.select(key, F.col("class").alias("part"), "start", "end", (-F.col("row")).alias("y"), height.alias("half_height"))


def strand_arrows(rows: DataFrame, span: float) -> DataFrame:
    """x0, x1, y of the arrow at the end that transcription runs to."""
    plus, size = F.col("strand") == "+", span * 0.015
    at = F.when(plus, F.col("end")).otherwise(F.col("start"))
    return rows.where("strand IN ('+', '-')").select(*[c for c in ("transcript_id", "gene_id") if c in rows.columns], at.alias("x0"), F.when(plus, at + size).otherwise(at - size).alias("x1"), (-F.col("row")).alias("y"))


def thinned(variants: DataFrame, most: int, lead: str | None = None) -> DataFrame:
    """id, pos, k (from 1, by position): ``most`` variants of a region at even ranks (half to even), and the lead."""
    rows = ranked(variants.select("id", "pos"), [], ["pos", "id"])
    kept = rows.where(at_ticks(F.col("_r"), F.col("_n"), max(most, 2)) | (F.col("id") == lead if lead is not None else F.lit(False)))
    return kept.select("id", "pos", F.row_number().over(Window.orderBy("pos", "id")).alias("k"))  # ``most`` rows and the lead


def ld_diamonds(pairs: DataFrame, variants: DataFrame, region: Region, most: int = 300, lead: str | None = None) -> DataFrame:
    """id_a, id_b, cx, cy, half (of a diamond's width in Mb) and value for the pairs of a region's (thinned) variants.

    ``pairs``: id_a, id_b, value, either way round. A broadcast holds ``most`` + 1 rows.
    """
    at = thinned(region.select(variants), most, lead)
    n = at.agg(F.count("*").cast("double")).scalar()
    a, b = (at.select(F.col("id").alias(f"id_{s}"), F.col("k").alias(f"k_{s}")) for s in "ab")
    some = pairs.join(F.broadcast(a), "id_a").join(F.broadcast(b), "id_b").where("k_a <> k_b").withColumn("n", n)
    first = F.col("k_a") < F.col("k_b")
    some = some.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("id_a"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("id_b"), F.least("k_a", "k_b").alias("i"), F.greatest("k_a", "k_b").alias("j"), "n", "value")
    some = some.groupBy("id_a", "id_b", "i", "j", "n").agg(F.max("value").alias("value"))
    x0, s = region.start / 1e6, (region.end - region.start) / 1e6 / F.col("n")
    return some.select("id_a", "id_b", (x0 + ((F.col("i") + F.col("j")) / 2 - 0.5) * s).alias("cx"), (F.col("i") - F.col("j")).cast("double").alias("cy"), (s / 2).alias("half"), "value")


def ld_outlines(blocks: DataFrame, variants: DataFrame, region: Region, most: int = 300, lead: str | None = None) -> DataFrame:
    """start, end of each block and the two lines (x, y, xend, yend) under its diamonds, from its first (thinned) variant down to the tip and up to its last.

    Blocks with fewer than two variants have none. The places of variants are one array of ``most`` + 1 entries.
    """
    at = thinned(region.select(variants), most, lead)
    places = at.agg(F.sort_array(F.collect_list(F.struct("pos", "k")))).scalar()
    rows = blocks.where(F.col("chr") == region.chr) if "chr" in blocks.columns else blocks
    rows = rows.where((F.col("end") >= region.start) & (F.col("start") <= region.end)).select("start", "end", places.alias("_p"))
    inside = F.filter("_p", lambda p: p["pos"].between(F.col("start"), F.col("end")))
    rows = rows.withColumn("_in", inside).where(F.size("_in") > 1).select("start", "end", F.size("_p").alias("_n"), F.element_at("_in", 1)["k"].alias("_a"), F.element_at("_in", -1)["k"].alias("_b"))
    x = lambda k: region.start / 1e6 + (k - 0.5) * ((region.end - region.start) / 1e6) / F.col("_n")
    tip, low = (x(F.col("_a")) + x(F.col("_b"))) / 2, -(F.col("_b") - F.col("_a") + 1).cast("double")
    line = lambda a, ya, b, yb: F.struct(a.alias("x"), ya.alias("y"), b.alias("xend"), yb.alias("yend"))
    return rows.select("start", "end", F.inline(F.array(line(x(F.col("_a")), F.lit(-1.0), tip, low), line(tip, low, x(F.col("_b")), F.lit(-1.0)))))


def ld_connectors(variants: DataFrame, region: Region, most: int = 300, lead: str | None = None) -> DataFrame:
    """id, gx, xk: from a variant's true place (Mb) to its even one over the diamonds."""
    at = thinned(region.select(variants), most, lead)
    n = at.agg(F.count("*").cast("double")).scalar()
    return at.select("id", (F.col("pos") / 1e6).alias("gx"), (region.start / 1e6 + (F.col("k") - 0.5) * ((region.end - region.start) / 1e6) / n).alias("xk"))


def track(intervals: DataFrame, region: Region) -> DataFrame:
    """Intervals that touch the region, with group ('x' if they have none), label and its place in Mb."""
    rows = intervals.where(normalize_chr(F.col("chr")) == region.chr) if "chr" in intervals.columns else intervals
    rows = rows.where((F.col("end") >= region.start) & (F.col("start") <= region.end))
    grp = F.col("group") if "group" in rows.columns else F.lit("x")
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("string")
    return rows.select("start", "end", grp.alias("grp"), label.alias("label"), ((F.greatest("start", F.lit(region.start)) + F.least("end", F.lit(region.end))) / 2e6).alias("label_x"))


def stacked(spark: SparkSession, kinds: list[str], heights: list[float] | None = None, axis: int | None = None) -> DataFrame:
    """panel (from 1, top to bottom), kind, top, bottom (shares of the whole height) and x_axis of panels over each other.

    Of panels on a region's axis (regional, genes, track, ld, other) one keeps it: number ``axis``, else the lowest that shows no LD, else the lowest. Others keep their own.
    """
    if not kinds:
        raise ValueError("no panels to combine")
    tall = [1.0] * len(kinds) if heights is None else [float(h) for h in heights]
    if len(tall) != len(kinds) or min(tall) <= 0:
        raise ValueError("each panel has one height above 0")
    shared = [k for k, v in enumerate(kinds, 1) if v in ("regional", "genes", "track", "ld", "other")]
    if axis is None and shared:
        axis = max([k for k in shared if kinds[k - 1] != "ld"] or shared)
    edges = [sum(tall[:k]) / sum(tall) for k in range(len(tall) + 1)]
    rows = [(k, v, 1 - edges[k - 1], 1 - edges[k], k == axis or k not in shared) for k, v in enumerate(kinds, 1)]
    return spark.createDataFrame(rows, "panel int, kind string, top double, bottom double, x_axis boolean")


# ---- one gene ----
def tss_arrows(rows: DataFrame, width: float) -> DataFrame:
    """tss, y0, y1, xend of where transcription starts: a stem over the transcript at ``row`` from y0 up to y1, and from there an arrow to xend. Rows of no strand have none."""
    minus = F.col("strand") == "-"
    tss = F.when(minus, F.col("end")).otherwise(F.col("start"))
    # fixed values: height of the stem's ends over the row, length of the arrow as a share of the width
    low, high, share = 0.3, 0.58, 0.045
    return rows.where("strand IN ('+', '-')").select(*[c for c in ("transcript_id", "gene_id") if c in rows.columns], tss.alias("tss"), (low - F.col("row")).alias("y0"), (high - F.col("row")).alias("y1"), (tss + F.when(minus, -share * width).otherwise(share * width)).alias("xend"))


def variant_location(variants: DataFrame, genes: DataFrame, features: DataFrame) -> DataFrame:
    """``variants`` (vid, pos, gene_id) with place in their gene's (one) transcript: upstream, downstream, intron, CDS, 5'UTR, 3'UTR, or another part of an exon.

    Places join by gene, and features by gene with a test of the position: one row a gene and variant at the end.
    """
    parts = features.where("class IN ('exon', 'CDS')").select("gene_id", F.col("class").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    span = parts.groupBy("gene_id").agg(F.min(F.when(F.col("_c") == "CDS", F.col("_s"))).alias("lo"), F.max(F.when(F.col("_c") == "CDS", F.col("_e"))).alias("hi"))
    own = variants.select("vid", "gene_id", "pos")
    hits = own.join(parts, "gene_id").where("pos BETWEEN _s AND _e").groupBy("vid", "gene_id").agg(F.bool_or(F.col("_c") == "exon").alias("ex"), F.bool_or(F.col("_c") == "CDS").alias("cds"))
    rows = variants.join(genes.select("gene_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "strand"), "gene_id").join(span, "gene_id", "left").join(hits, ["vid", "gene_id"], "left")
    minus, left, right = F.coalesce(F.col("strand") == "-", F.lit(False)), F.col("pos") < F.col("g_start"), F.col("pos") > F.col("g_end")
    ex = F.coalesce("ex", F.lit(False))
    place = (
        F.when(F.when(minus, left).otherwise(right), "downstream").when(F.when(minus, right).otherwise(left), "upstream").when(ex & F.col("lo").isNull(), "exon (non-coding transcript)")
        .when(F.col("cds"), "CDS").when(ex & (F.col("pos") < F.col("lo")), F.when(minus, "3'UTR").otherwise("5'UTR")).when(ex & (F.col("pos") > F.col("hi")), F.when(minus, "5'UTR").otherwise("3'UTR"))
        .when(ex, "exon (non-coding part)").otherwise("intron")
    )
    return rows.select(*variants.columns, place.alias("place"))


def gene_structure(features: DataFrame, tx: str = "transcript_id") -> DataFrame:
    """part (exon, CDS, intron), start, end, exon_number (in the direction of transcription) of each transcript; introns between neighbouring exons."""
    exons = introns(features.where("class = 'exon'").select(tx, "start", "end", "strand"), tx)
    ex = exons.select(tx, F.lit("exon").alias("part"), "start", "end", F.col("exon_number").cast("long").alias("exon_number"))
    none = F.lit(None).cast("long").alias("exon_number")
    gaps = exons.where("intron_start IS NOT NULL").select(tx, F.lit("intron").alias("part"), F.col("intron_start").alias("start"), F.col("intron_end").alias("end"), none)
    return ex.unionByName(gaps).unionByName(features.where("class = 'CDS'").select(tx, F.lit("CDS").alias("part"), "start", "end", none))


def variant_labels(variants: DataFrame, region: Region, size: float = 0.02) -> DataFrame:
    """``variants`` (id, pos, ref, alt) of a region with alleles and label_x: places at least ``size`` of the width apart, near their positions.

    Labels are spread by ranks and running extremes, in as many tasks as the region's variants take.
    """
    rows = region.select(variants).select("id", "pos", allele_label(F.col("ref"), F.col("alt")).alias("alleles"))
    lo, hi = float(region.start), float(region.end)
    at = ranked(rows, [], ["pos", "id"], keep=True)
    # pushed right from the left end, v_k = max(x_k, v_(k-1) + gap), is a running maximum of x_k - k gap; pushed left likewise a running minimum from behind
    gap = F.least(F.lit(size * (hi - lo)), F.lit(hi - lo) / F.greatest(F.col("_n") - 1, F.lit(1)))
    steps, rest = (F.col("_r") - 1) * gap, (F.col("_n") - F.col("_r")) * gap
    at = running(running(at, F.col("pos") - steps, "_right"), F.col("pos") - steps, "_left", backward=True)
    right, left = F.least(F.col("_right") + steps, F.lit(hi) - rest), F.greatest(F.col("_left") + steps, F.lit(lo) + steps)
    alone = F.least(F.greatest(F.col("pos").cast("double"), F.lit(lo)), F.lit(hi))
    return at.select("id", "pos", "alleles", F.when(F.col("_n") < 2, alone).otherwise((right + left) / 2).alias("label_x"))


# ---- trees ----
def clade_groups(tree: Tree, groups: dict[str, str | None]) -> dict[int, str | None]:
    """The group of each node: a tip's own; of an inner node the one all its children share, else none."""
    kids = tree.children()
    got: dict[int, str | None] = {k: groups.get(t) for k, t in enumerate(tree.tips)}
    order, todo = [], [tree.root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c, _ in kids.get(x, ())]
    for x in reversed(order):
        if x in kids:
            of = {got[c] for c, _ in kids[x]}
            got[x] = of.pop() if len(of) == 1 else None
    return got


def cluster_groups(names: list[str], d: np.ndarray, k: int) -> dict[str, str]:
    """'Cluster i' of each sample: average linkage cut into k."""
    return {s: f"Cluster {c}" for s, c in clusters(names, d, k).items()}


def tree_panel(spark: SparkSession, tree: Tree, layout: str = "circular", groups: dict[str, str | None] | None = None) -> DataFrame:
    """node, tip, depth, rank, x, y, angle (degrees, circular), n_tips, grp of each node of a tree.

    rectangular: x is depth, y the rank. circular: the rank becomes the angle, the depth the radius.
    unrooted: each clade takes a wedge in proportion to its tips, and branches keep their lengths.
    """
    if layout not in ("circular", "rectangular", "unrooted"):
        raise ValueError("layout is circular, rectangular or unrooted")
    grp = clade_groups(tree, groups) if groups else {}
    nodes = coordinates(tree)
    n = len(tree.tips)
    at: dict[int, tuple[float, float, float | None]] = {}
    if layout == "unrooted":
        kids, size = tree.children(), {x: c for x, _, _, c in nodes}
        at[tree.root] = (0.0, 0.0, None)
        todo = [(tree.root, 0.0, 2 * math.pi)]
        while todo:
            x, a, b = todo.pop()
            for c, w in sorted(kids.get(x, ()), key=lambda e: (size[e[0]], e[0])):
                wide = (b - a) * size[c] / size[x]
                turn = a + wide / 2
                at[c] = (at[x][0] + w * math.cos(turn), at[x][1] + w * math.sin(turn), math.degrees(turn))
                todo.append((c, a, a + wide))
                a += wide
    else:
        for x, depth, y, _ in nodes:
            turn = 2 * math.pi * (y - 0.5) / n
            at[x] = (depth, y, None) if layout == "rectangular" else (depth * math.cos(turn), depth * math.sin(turn), math.degrees(turn))
    rows = [(x, tree.tips[x] if x < n else None, float(depth), y, *(None if v is None else float(v) for v in at[x]), count, grp.get(x)) for x, depth, y, count in nodes]
    return spark.createDataFrame(rows, "node int, tip string, depth double, rank double, x double, y double, angle double, n_tips int, grp string")


def page_size(n_tips: int, label_chars: int, layout: str = "circular", font: float = 6.0) -> tuple[float, float]:
    """Width and height in mm that tips of ``font`` pt need, up to the largest page."""
    # fixed values: mm a point, character width a font size, line height, margins, width of a page and the largest one
    pt, char, line, gap, pad, extra, wide, most = 0.3528, 0.62, 1.3, 1.2, 3.0, 24.0, 180.0, 5000.0
    if layout == "rectangular":
        return wide, min(most, max(90.0, n_tips * line * font * pt + extra))
    half = max(40.0, line * font * pt * n_tips / (2 * math.pi)) + gap + char * max(label_chars, 1) * font * pt + pad
    half = min(half, most / 2)
    return 2 * half + 4, 2 * half + extra
