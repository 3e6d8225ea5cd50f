"""Locus regions: explicit, block, LD interval or window; report tables."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """A closed interval whose bounds become literals, so that filters reach the scan; core: without margin and genes."""

    chr: str
    start: int
    end: int
    source: str
    target: int | None = None
    core: tuple[int, int] | None = None

    def __str__(self) -> str:
        a, b = self.core or (self.start, self.end)
        plot = "" if (a, b) == (self.start, self.end) else f"; with margin {self.start:,}-{self.end:,}"
        return f"chr {self.chr}:{a:,}-{b:,} ({(b - a) / 1000:.1f} kb; {self.source}){plot}"

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError("a region ends at or after its start")

    def select(self, rows: DataFrame) -> DataFrame:
        return rows.where((F.col("chr") == self.chr) & F.col("pos").between(self.start, self.end))


def define_region(chrom: str, pos: int, *, start: int | None = None, end: int | None = None, blocks: DataFrame | None = None, lead_r2: DataFrame | None = None, ld_r2: float = 0.6, flank: int = 50_000, min_width: int = 0, margin: float = 0.02, genes: DataFrame | None = None, chrom_length: int | None = None) -> Region:
    """First of: explicit bounds; the block that holds the target; the span of variants in LD (v, pos, r2); the window.

    Widened to ``min_width`` and to whole ``genes``, those told by LD by ``margin``, and cut at the chromosome's ends. A warning tells
    of a target outside the region or beyond ``chrom_length``.
    """
    a = b = None
    source = "window"
    if start is not None and end is not None:
        if end < start:
            raise ValueError("a region ends at or after its start")
        a, b, source = start, end, "user-defined"
    elif blocks is not None:
        hit = blocks.where((F.col("chr") == chrom) & (F.col("start") <= pos) & (F.col("end") >= pos)).orderBy("start").limit(1).collect()
        if hit:
            a, b, source = hit[0].start, hit[0].end, "LD block containing the target"
    if a is None and lead_r2 is not None:
        span = lead_r2.where(F.col("r2") >= ld_r2).agg(F.min("pos"), F.max("pos"), F.count("*")).first()
        if span[2] > 1:
            a, b, source = span[0], span[1], "LD interval"
        elif span[2] == 1:
            near = lead_r2.agg(F.max(F.when(F.col("pos") < span[0], F.col("pos"))), F.min(F.when(F.col("pos") > span[0], F.col("pos")))).first()
            a, b, source = near[0] or span[0] - 1000, near[1] or span[0] + 1000, "no variant in LD: neighbours"
    if a is None:
        a, b = pos - flank, pos + flank
    if not a <= pos <= b:
        warnings.warn(f"the target {pos:,} lies outside the region {a:,}-{b:,}", stacklevel=2)
    core = (max(1, a), b)
    if b - a < min_width:
        more = (min_width - (b - a)) / 2
        a, b = a - more, b + more
    if genes is not None:
        edge = genes.where((F.col("chr") == chrom) & (F.col("start") <= b) & (F.col("end") >= a)).agg(F.min("start"), F.max("end")).first()
        a, b = min(a, edge[0] or a), max(b, edge[1] or b)
    if "LD" in source:
        more = max(margin * (b - a), 200)
        a, b = a - more, b + more
    a, b = max(1, math.floor(a)), math.ceil(b)
    if chrom_length:
        if pos > chrom_length:
            warnings.warn(f"the target {pos:,} is beyond the {chrom_length:,} bp of chromosome {chrom}: do all files use one assembly?", stacklevel=2)
        b = min(b, chrom_length)
    return Region(chrom, a, b, source, pos, core)


def gene_table(genes: DataFrame, lead: int) -> DataFrame:
    """Genes with their length and distance to the lead position."""
    return genes.select("gene_id", "chr", "start", "end", "strand", (F.col("end") - F.col("start") + 1).alias("length_bp"), F.greatest(F.col("start") - lead, lead - F.col("end"), F.lit(0)).alias("distance_to_lead_bp"))


def snp_table(annotated: DataFrame, threshold, lead: str) -> DataFrame:
    """The report of a locus: p, significance, lead flag and annotation."""
    return annotated.select(
        "snp", "chr", "pos", "p", F.round(-F.log10("p"), 3).alias("minus_log10_p"), (F.col("p") <= threshold).alias("significant"), (F.col("snp") == lead).alias("is_lead"),
        "gene", "location", "feature", "distance_bp", "gene_strand", "other_genes",
    )
