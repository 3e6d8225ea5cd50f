"""The whole report of one locus: region, genes, LD, panels and tables from files."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.genomes import Species
from genoloom.operators import annotate, blocks, genotypes, gwas, panels, region, report
from genoloom.plans.variants import modelled
from genoloom.sources import genome, sinks, workbook
from genoloom.sources.genotypes import read_genotypes
from genoloom.sources.gff import Genes, read_gff
from genoloom.sources.gwas import read_gwas
from genoloom.sources.text import head, saved

PANELS = ("manhattan", "regional", "genes", "ld")
TABLES = ("genes", "snps", "ld", "ld_pairs")
REGIONS = ("auto", "blocks", "ld_blocks", "window")


def choice(given: str | list[str] | None, known: tuple[str, ...]) -> list[str]:
    """``given`` in the order of ``known``: a list or text with commas, unique beginnings count, 'none' is empty."""
    words = [w.strip().lower() for w in (given.split(",") if isinstance(given, str) else given or []) if w.strip()]
    if words == ["none"]:
        return []
    out = set()
    for w in words:
        hits = [w] if w in known else [k for k in known if k.startswith(w)]
        if len(hits) != 1:
            raise ValueError(f"{w!r} is none of {', '.join(known)}")
        out.add(hits[0])
    return [k for k in known if k in out]


@dataclass(frozen=True)
class LocusConfig:
    gwas: str
    gff: str | None = None
    vcf: str | None = None
    blocks: str | None = None
    ld_file: str | None = None
    ld_bim: str | None = None
    species: Species | None = None
    chrom_sizes: str | None = None
    target: str = "top"
    chr: str | None = None
    pos: int | None = None
    region: str = "auto"
    start: int | None = None
    end: int | None = None
    flank: int = 50_000
    ld_r2: float = 0.6
    min_width: int = 0
    margin: float = 0.02
    extend_to_genes: bool = False
    threshold: str | float | None = "bonferroni"
    suggestive: str | float | None = None
    min_maf: float = 0.05
    max_missing: float = 0.2
    ld_method: str = "genotype"
    ld_stat: str = "r2"
    max_ld_snps: int = 300
    max_table_snps: int = 5000
    block_search: int = 250_000
    max_block_kb: int = 200
    max_block_snps: int = 1500
    upstream_bp: int = 3000
    downstream_bp: int = 1000
    transcripts: str = "canonical"
    gene_features: str = "gene"
    panels: list[str] = field(default_factory=lambda: list(PANELS))
    tables: list[str] = field(default_factory=lambda: list(TABLES[:3]))
    table_format: str = "csv"
    chr_map: dict[str, str] | None = None


@dataclass
class Locus:
    """Lazy DataFrames of a report, and what was settled on the way."""

    config: LocusConfig
    region: region.Region
    core: tuple[int, int]
    lead: str | None
    lead_p: float | None
    reference: str | None
    threshold: float | None
    genes: Genes | None
    panels: dict[str, DataFrame]
    tables: dict[str, DataFrame]
    samples: int = 0
    frames: dict[str, DataFrame] = field(default_factory=dict)  # layout: where panels lie over each other; ld_outline: blocks under the diamonds
    chromosome_genes: Genes | None = None  # variants near the border have their nearest gene outside

    def facts(self) -> dict[str, object]:
        r, c = self.region, self.config
        return {
            "Species": f"{c.species.organism}, genome {c.species.genome}" if c.species else None,
            "Region": f"chromosome {r.chr}: {self.core[0]:,} - {self.core[1]:,} bp ({r.source}); with margins {r.start:,} - {r.end:,} bp",
            "Lead variant": f"{self.lead} (P = {self.lead_p:.3g})" if self.lead else "none",
            "LD reference": self.reference if self.reference and self.reference != self.lead else None,
            "Threshold": None if self.threshold is None else f"P = {self.threshold:.3g}",
            "Gene windows": f"{c.upstream_bp:,} bp before the start, {c.downstream_bp:,} bp after the end",
        }


def _calls(spark: SparkSession, c: LocusConfig, chrom: str, lo: int, hi: int) -> tuple[DataFrame, DataFrame, int] | None:
    """(variants, calls, samples) of an interval after genotype quality control, checkpointed as one small table: v, id, chr, pos, smp, dos, h1, h2."""
    if c.vcf is None:
        return None
    g = read_genotypes(spark, c.vcf, chrom=chrom, start=max(1, lo), end=hi, chr_map=c.chr_map)
    long = g.calls.select("v", "smp", "dos", "h1", "h2").join(g.variants.select("v", "id", "chr", "pos", "multiallelic"), "v")
    kept = genotypes.qc(long.withColumn("id", F.concat_ws("|", "id", "v")), c.min_maf, c.max_missing).where("step = 'kept'")
    long = saved(long.drop("multiallelic").join(kept.select("v"), "v", "left_semi"))
    variants = long.select("v", "id", "chr", "pos").distinct()
    return variants, long, len(g.samples)


def _pairs(calls: DataFrame, ids: DataFrame, c: LocusConfig, reach: int) -> DataFrame:
    """snp_a, pos_a, snp_b, pos_b and the chosen statistic of all pairs of ``ids`` (v, id), which a region bounds."""
    some = calls.join(ids.select("v"), "v", "left_semi")
    if c.ld_stat == "r2" and c.ld_method == "genotype":
        values = genotypes.r2(some, reach)
    else:
        values = genotypes.from_freqs(genotypes.em(genotypes.haplotypes(some, reach)))
    name = ids.select("v", "id")
    values = values.join(name.withColumnsRenamed({"v": "i", "id": "snp_a"}), "i").join(name.withColumnsRenamed({"v": "j", "id": "snp_b"}), "j")
    return values.select("snp_a", F.col("pos_i").alias("pos_a"), "snp_b", F.col("pos_j").alias("pos_b"), F.col(c.ld_stat).alias(c.ld_stat))


def _given(spark: SparkSession, c: LocusConfig, here: region.Region, inside: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(variants: id, chr, pos; snp_a, pos_a, snp_b, pos_b, r2) of the caller's LD file in the region; None if fewer than two variants lie there.

    A table of pairs, or a square of numbers with ``ld_bim``. A variant at the position of an association row takes its name.
    """
    if "SNP_A" in head(spark, c.ld_file)[0]:
        ld = genome.read_ld(spark, c.ld_file)
    elif c.ld_bim:
        ld = genome.read_ld_square(spark, c.ld_file, bim=c.ld_bim, chr_map=c.chr_map)
    else:
        raise ValueError("ld_file needs positions: give a table of pairs, or ld_bim")
    ld = saved(ld.where(F.col("pos_a").between(here.start, here.end) & F.col("pos_b").between(here.start, here.end)))
    named = inside.groupBy("pos").agg(F.min("snp").alias("snp"))
    names = ld.select(F.col("id_a").alias("old"), F.col("pos_a").alias("pos")).distinct().join(named, "pos", "left")
    names = saved(names.groupBy("old").agg(F.min("pos").alias("pos"), F.min_by("snp", "pos").alias("snp")).select("old", "pos", F.coalesce("snp", "old").alias("id")))
    if names.limit(2).count() < 2:
        warnings.warn(f"fewer than two variants of {c.ld_file} lie in the region; it is not used", stacklevel=3)
        return None
    side = lambda k: names.select(F.col("old").alias(f"id_{k}"), F.col("id").alias(f"snp_{k}"))
    flat = ld.join(side("a"), "id_a").join(side("b"), "id_b").select("snp_a", "pos_a", "snp_b", "pos_b", F.col("value").alias("r2"))
    return names.select("id", F.lit(here.chr).alias("chr"), "pos"), flat


def _ld_outputs(out: Locus, c: LocusConfig, variants: DataFrame, ref: str, pairs_of: Callable[[DataFrame], DataFrame], want_panels: list[str], want_tables: list[str], found: DataFrame | None = None) -> None:
    """The LD panel (with outlines of the blocks ``found``) and tables of thinned ``variants``; ``pairs_of`` gives the pairs of chosen ids."""
    here, genes = out.region, out.chromosome_genes
    for name, most in (("panel", c.max_ld_snps), ("table", c.max_table_snps)):
        wanted = "ld" in want_panels if name == "panel" else {"ld", "ld_pairs"} & set(want_tables)
        if not wanted:
            continue
        ids = variants.join(panels.thinned(variants, most, ref).select("id"), "id", "left_semi")
        pairs = pairs_of(ids)
        if name == "panel":
            flat = pairs.select(F.col("snp_a").alias("id_a"), F.col("snp_b").alias("id_b"), F.col(c.ld_stat).alias("value"))
            out.panels["ld"] = panels.ld_diamonds(flat, variants, here, c.max_ld_snps, ref)
            if found is not None:
                out.frames["ld_outline"] = panels.ld_outlines(found, variants, here, c.max_ld_snps, ref)
        else:
            parts = _features(genes)
            g = genes.genes if genes else None
            if "ld" in want_tables:
                out.tables["ld"] = report.ld_matrix_table(pairs, ids.select("id", "chr", "pos"), c.ld_stat, genes=g, features=parts, upstream=c.upstream_bp, downstream=c.downstream_bp, most=most + 1).orderBy("pos", "id")
            if "ld_pairs" in want_tables:
                out.tables["ld_pairs"] = report.ld_pairs_table(pairs, c.ld_stat, variants=ids.select("id", "chr", "pos"), genes=g, features=parts, upstream=c.upstream_bp, downstream=c.downstream_bp).orderBy("pos_a", "pos_b")


def locus(spark: SparkSession, c: LocusConfig) -> Locus:
    """Settle the region of ``c`` with small actions (top row, block bounds, lead), the rest stays lazy."""
    want_panels, want_tables = choice(c.panels, PANELS), choice(c.tables, TABLES)
    if not want_panels and not want_tables:
        raise ValueError("no panels and no tables: nothing to do")
    if c.region not in REGIONS:
        raise ValueError(f"region is one of {', '.join(REGIONS)}")
    rows = read_gwas(spark, c.gwas, chr_map=c.chr_map)
    chrom, pos, snp = gwas.resolve_target(rows, c.target, c.chr, c.pos)
    sizes = genome.sizes_of(spark, c.species or c.chrom_sizes, rows, c.chr_map)
    length = sizes.where(F.col("chr") == chrom).select("length").first() if c.species or c.chrom_sizes else None
    genes = read_gff(spark, c.gff, chrom, chr_map=c.chr_map) if c.gff else None

    found = lead_r2 = None
    if c.start is None or c.end is None:
        if c.blocks and c.region in ("auto", "blocks"):
            found = genome.read_blocks(spark, c.blocks, c.chr_map)
        elif c.vcf and c.region in ("auto", "ld_blocks"):
            around = _calls(spark, c, chrom, pos - c.block_search, pos + c.block_search)
            near = around[0].orderBy(F.abs(F.col("pos") - pos), "pos").first()
            if near:
                few = panels.thinned(around[0], c.max_block_snps, near.id).select("id")
                found = blocks.find_blocks(around[1].join(around[0].join(few, "id", "left_semi").select("v"), "v", "left_semi"), c.max_block_kb)
                lead_r2 = genotypes.r2_with_lead(around[1], near.v)
    how = dict(start=c.start, end=c.end, blocks=found, lead_r2=lead_r2, ld_r2=c.ld_r2, flank=c.flank, chrom_length=length[0] if length else None)
    own = genes.genes if genes and c.extend_to_genes else None
    here = region.define_region(chrom, pos, **how, min_width=c.min_width, margin=c.margin, genes=own)
    inside = here.select(rows)
    best = (inside.where(F.col("snp") == snp).first() if snp else None) or gwas.top(inside).first()
    limit = gwas.threshold(rows, c.threshold)
    out = Locus(c, here, here.core or (here.start, here.end), best.snp if best else None, best.p if best else None, None, limit, genes.overlapping(here.chr, here.start, here.end) if genes else None, {}, {}, chromosome_genes=genes)

    need_ld = "ld" in want_panels or "regional" in want_panels or {"ld", "ld_pairs", "snps"} & set(want_tables)
    got = _calls(spark, c, here.chr, here.start, here.end) if need_ld and best else None
    r2 = None
    if got and (ref := report.reference_variant(inside, got[0], best.pos, best.snp)):
        variants, calls, out.samples = got
        out.reference = ref
        v = variants.where(F.col("id") == ref).first().v
        at = genotypes.r2_with_lead(calls, v).join(variants.select("v", "id"), "v").select("id", "pos", "r2")
        by_pos = inside.select("snp", "pos").join(at.groupBy("pos").agg(F.min_by("r2", "id").alias("r2")), "pos")
        r2 = by_pos.select("snp", "r2")
        _ld_outputs(out, c, variants, ref, lambda ids: _pairs(calls, ids, c, max(here.end - here.start, 1)), want_panels, want_tables, found)
    if c.ld_file and need_ld and best and (given := _given(spark, c, here, inside)):
        # pairs of the caller's file take the place of computed ones, but for the r2 with the lead where genotypes told it
        variants, flat = given
        c = replace(c, ld_stat="r2")
        out.reference = ref = report.reference_variant(inside, variants, best.pos, best.snp)
        if r2 is None:
            r2 = flat.where(F.col("snp_a") == ref).select(F.col("snp_b").alias("snp"), "r2").join(inside.select("snp"), "snp", "left_semi")

        def chosen(ids: DataFrame) -> DataFrame:
            a, b = (ids.select(F.col("id").alias(k)) for k in ("snp_a", "snp_b"))
            return flat.where("pos_a < pos_b OR (pos_a = pos_b AND snp_a < snp_b)").join(a, "snp_a", "left_semi").join(b, "snp_b", "left_semi")

        _ld_outputs(out, c, variants, ref, chosen, want_panels, want_tables, found)

    if "manhattan" in want_panels:
        out.panels["manhattan"] = panels.manhattan_panel(rows, gwas.genome_layout(sizes))
    if "regional" in want_panels:
        out.panels["regional"] = panels.regional(rows, here, out.lead, r2, None if limit is None or limit <= 0 else -math.log10(limit))
    if "genes" in want_panels and out.genes:
        tx = out.genes.transcripts.where("canonical") if c.transcripts == "canonical" else out.genes.transcripts
        named = tx.join(out.genes.genes.select("gene_id", "name"), "gene_id").select("transcript_id", "gene_id", "chr", "start", "end", "strand", "name")
        out.panels["genes"] = panels.gene_rows(named, float(here.end - here.start), "name", view=(here.start, here.end))
    if shown := [k for k in ("manhattan", "regional", "genes", "ld") if k in out.panels]:
        # fixed values: heights in mm; genes take more for each packed row
        tall = {"manhattan": 42.0, "connector": 7.0, "regional": 48.0, "ld": 72.0}
        if "genes" in shown:
            tall["genes"] = min(60.0, 9.0 + 6.5 * (out.panels["genes"].agg(F.max("row")).first()[0] or 1))
        kinds = [k for s in shown for k in ((s, "connector") if s == "manhattan" and len(shown) > 1 else (s,))]
        out.frames["layout"] = panels.stacked(spark, kinds, [tall[k] for k in kinds])
    if "snps" in want_tables:
        out.tables["snps"] = _snps(out, inside, r2)
    if "genes" in want_tables and out.genes and best:
        g = out.genes.genes
        extra = g.select("gene_id", "name", F.col("note").alias("description"))
        out.tables["genes"] = region.gene_table(g, best.pos).join(extra, "gene_id").orderBy("start", "end", "gene_id")
    return out




def _features(genes: Genes | None) -> DataFrame | None:
    return None if genes is None else modelled(genes)


def _snps(out: Locus, inside: DataFrame, r2: DataFrame | None) -> DataFrame:
    c, genes = out.config, out.chromosome_genes
    rows = inside.select("snp", "chr", "pos", "p")
    if genes:
        known = rows.withColumn("vid", F.col("snp"))
        named = annotate.annotate(known, genes.genes, _features(genes), c.upstream_bp, c.downstream_bp)
        named = named.join(genes.genes.select(F.col("gene_id").alias("gene"), F.col("note").alias("gene_description")), "gene", "left")
        rows = named.select("snp", "chr", "pos", "p", "gene", "location", "feature", "distance_bp", "gene_strand", "gene_description", "other_genes")
    if r2 is not None:
        rows = rows.join(r2, "snp", "left")
    cols = ["snp", "chr", "pos", "p", F.round(-F.log10("p"), 3).alias("minus_log10_p")]
    if out.threshold is not None:
        cols.append(F.when(F.col("p") <= out.threshold, "yes").otherwise("no").alias("significant"))
    cols.append(F.when(F.col("snp") == out.lead, "yes").otherwise("no").alias("is_lead"))
    if r2 is not None:
        cols.append(F.round("r2", 4).alias("r2_with_lead"))
    if "LD" in out.region.source:
        cols.append(F.when(F.col("pos").between(*out.core), "yes").otherwise("no").alias("in_ld_block"))
    if genes:
        cols += ["gene", "location", "feature", "distance_bp", "gene_strand", "gene_description", "other_genes"]
    return rows.select(cols).orderBy("pos", "snp")


def write(out: Locus, base: str) -> dict[str, str]:
    """Tables (as text, or one workbook), the genes' own lines, panel tables and a README beside ``base``; the paths by name.

    Headers of report tables are in capitals.
    """
    spark = next(iter([*out.tables.values(), *out.panels.values()])).sparkSession
    files: dict[str, str] = {}
    # a matrix is headed by variants' own names, which stay as they are
    upper = {k: df.toDF(*[n.upper() if n in report.COLUMNS else n for n in df.columns]) for k, df in out.tables.items()}
    columns = {k: df.columns for k, df in out.tables.items()}
    if out.config.table_format == "xlsx" and upper:
        guide = [[line] for line in report.readme(out.facts(), columns)]
        files["xlsx"] = workbook.write_workbook(spark, f"{base}.xlsx", {"README": guide} | upper)
    else:
        for k, df in upper.items():
            files[k] = sinks.write_table(df, f"{base}_{k}.csv")
    if out.genes and "genes" in out.tables:
        files["gene_lines"] = sinks.write_region_genes(out.genes, f"{base}_genes.{'gtf' if out.genes.format == 'gtf' else 'gff3'}", out.config.gene_features)
    for k, df in out.panels.items():
        files[f"panel_{k}"] = sinks.write_table(df, f"{base}_panel_{k}.tsv")
    for k, df in out.frames.items():
        files[f"frame_{k}"] = sinks.write_table(df, f"{base}_frame_{k}.tsv")
    files["readme"] = sinks.write_lines(spark, f"{base}_README.txt", report.readme(out.facts(), {files.get(k, k).rsplit("/", 1)[-1]: v for k, v in columns.items()}))
    return files
