"""Checks of input files before a report: one row a finding, file, status (OK, NOTE, PROBLEM) and message."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.genomes import Species
from genoloom.functions.names import chr_key
from genoloom.operators import gwas as association
from genoloom.sources import genotypes as geno
from genoloom.sources.gff import read_gff
from genoloom.sources.gwas import read_gwas

T = TypeVar("T")


def names(df: DataFrame) -> list[str]:
    """Chromosomes of ``df`` in natural order; one row each reaches the driver."""
    return [r.chr for r in df.groupBy("chr").agg(F.first(chr_key(F.col("chr"))).alias("o")).orderBy("o").collect()]


def chr_list(found: list[str]) -> str:
    """At most eight names: the first four, the last two between dots."""
    return ", ".join(found if len(found) <= 8 else [*found[:4], "...", *found[-2:]])


class Findings:
    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str]] = []

    def add(self, file: str, status: str, message: str) -> None:
        self.rows.append((file, status, message))

    def attempt(self, file: str, work: Callable[[], T]) -> T | None:
        """The result of ``work``; what it raises becomes a PROBLEM, since reporting it is what a check is for."""
        try:
            return work()
        except (ValueError, OSError, PySparkException) as e:
            self.add(file, "PROBLEM", str(e).splitlines()[0])
            return None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "file string, status string, message string")


def _beyond(out: Findings, file: str, rows: DataFrame, kind: Species | None) -> None:
    """Positions past the end of their chromosome, and chromosomes that the genome has not: one aggregate by chromosome."""
    if kind is None:
        return
    known = dict(kind.lengths)
    sizes = kind.sizes(rows.sparkSession)
    found = rows.join(sizes, "chr", "left").groupBy("chr").agg(F.count_if(F.col("pos") > F.col("length")).alias("n")).collect()
    past = sorted(r.chr for r in found if r.n)
    if past:
        out.add(file, "PROBLEM", f"{sum(r.n for r in found):,} position(s) lie past the end of chromosome {', '.join(past[:5])} of {kind.genome}: another version of the genome?")
    off = sorted(r.chr for r in found if r.chr not in known)
    numbered = [c for c in off if c.isdigit() and c != "0"]
    others = [c for c in off if c not in numbered]
    if numbered:
        out.add(file, "PROBLEM", f"chromosome(s) {', '.join(sorted(numbered, key=int)[:8])} are not in {kind.genome}: is the species right?")
    if others:
        out.add(file, "NOTE", f"name(s) that are no chromosomes of {kind.genome}: {', '.join(others[:8])}; left out of genome-wide panels")


def _genotypes(spark: SparkSession, out: Findings, label: str, path: str, rows: DataFrame | None, window: int, chroms: dict[str, list[str]], chr_map: dict[str, str] | None) -> None:
    read = geno.read_vcf if label == "VCF" else geno.read_hapmap
    g = out.attempt(label, lambda: read(spark, path, chr_map=chr_map))
    if g is None:
        return
    out.add(label, "OK", f"{len(g.samples):,} individuals")
    chroms[label] = names(g.variants)
    if rows is None:
        return
    top = association.top(rows).first()
    lo, hi = max(1, top.pos - window), top.pos + window
    near = out.attempt(label, lambda: read(spark, path, chrom=top.chr, start=lo, end=hi, chr_map=chr_map))
    if near is None:
        return
    n = near.variants.count()
    if not n:
        out.add(label, "PROBLEM", f"no variants within {window:,} bp of the top variant (chromosome {top.chr}, {top.pos:,} bp): other chromosome names or another genome version?")
        return
    own = near.variants.select("pos").distinct().withColumn("hit", F.lit(1))
    share = rows.where((F.col("chr") == top.chr) & F.col("pos").between(lo, hi)).join(own, "pos", "left").agg(F.avg(F.coalesce("hit", F.lit(0))), F.max(F.when(F.col("pos") == top.pos, F.col("hit")))).first()
    out.add(label, "OK" if share[0] >= 0.5 else "NOTE" if share[0] > 0 else "PROBLEM", f"{n:,} variants within {window:,} bp of the top variant; {100 * share[0]:.0f}% of the associations there have a genotype")
    missing = near.calls.agg(F.avg(F.col("dos").isNull().cast("int"))).first()[0] or 0.0
    out.add(label, "NOTE" if missing > 0.5 else "OK", f"{100 * missing:.1f}% of calls missing there")
    if share[1] is None:
        out.add(label, "NOTE", "the top variant has no genotype: LD will be told against the nearest one")


def check_inputs(spark: SparkSession, gwas: str | None = None, gff: str | None = None, vcf: str | None = None, hapmap: str | None = None, species: Species | None = None, window: int = 50_000, chr_map: dict[str, str] | None = None) -> DataFrame:
    """What is right, odd or wrong with the files of a report. Each check is an aggregate; counts and one row a chromosome reach the driver."""
    out, chroms = Findings(), {}
    if species is None:
        out.add("Species", "NOTE", "no species given, so positions can't be checked against chromosome lengths")
    else:
        out.add("Species", "OK", f"{species.organism}, genome {species.genome} ({len(species.lengths)} chromosomes: {chr_list([c for c, _ in species.lengths])})")
    rows = None
    if gwas is None:
        out.add("GWAS", "PROBLEM", "no file of associations")
    else:
        rows = out.attempt("GWAS", lambda: read_gwas(spark, gwas, chr_map=chr_map))
    if rows is not None:
        chroms["GWAS"] = names(rows)
        n, middle = rows.agg(F.count("*"), F.median("p")).first()
        out.add("GWAS", "OK", f"{n:,} variants on {len(chroms['GWAS'])} chromosome(s) ({chr_list(chroms['GWAS'])})")
        top = association.top(rows).first()
        out.add("GWAS", "OK", f"top variant: {top.snp} (chromosome {top.chr}, {top.pos:,} bp, P = {top.p:.3g})")
        if middle < 0.01:
            out.add("GWAS", "NOTE", f"most P are very small (median {middle:.2g}): does the column hold -log10 P or something else?")
        _beyond(out, "GWAS", rows, species)
    genes = out.attempt("GFF", lambda: read_gff(spark, gff, chr_map=chr_map)) if gff is not None else None
    if genes is not None:
        chroms["GFF"] = names(genes.genes)
        n, noted = genes.genes.agg(F.count("*"), F.count_if(F.coalesce("note", F.lit("")) != "")).first()
        tx, only = genes.transcripts.agg(F.count("*"), F.count_if(F.col("type") == "gene_only")).first()
        out.add("GFF", "OK" if n else "PROBLEM", f"{n:,} genes ({tx:,} transcripts) on {len(chroms['GFF'])} chromosome(s) ({chr_list(chroms['GFF'])}); {genes.format.upper()}")
        kinds = {r["class"]: r["count"] for r in genes.features.groupBy("class").count().collect()}
        if tx and only == tx:
            out.add("GFF", "NOTE", "gene lines only: variants inside genes are genic rather than in exons or introns")
        else:
            out.add("GFF", "OK", f"{kinds.get('exon', 0):,} exons, {kinds.get('CDS', 0):,} coding parts, {sum(kinds.get(k, 0) for k in ('UTR5', 'UTR3', 'UTR')):,} UTRs")
            if not kinds.get("CDS"):
                out.add("GFF", "NOTE", "no coding parts: exons can't be split into CDS and UTR")
        if n and not noted:
            out.add("GFF", "NOTE", "no gene has a description")
        _beyond(out, "GFF", genes.genes.select("chr", F.col("end").alias("pos")), species)
    for label, path in (("VCF", vcf), ("HapMap", hapmap)):
        if path is not None:
            _genotypes(spark, out, label, path, rows, window, chroms, chr_map)
    for label, found in chroms.items():
        if "GWAS" in chroms and label != "GWAS" and not set(found) & set(chroms["GWAS"]):
            out.add(label, "PROBLEM", f"its chromosomes ({chr_list(found)}) are not those of the associations ({chr_list(chroms['GWAS'])}); rename them or give a mapping")
    return out.frame(spark)
