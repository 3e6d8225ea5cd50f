"""Gene models from GFF3 or GTF: genes, transcripts and features joined by ID and Parent, all as DataFrames."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.functions.names import attr_gff3, attr_gtf, normalize_chr, sub_class
from genoloom.operators.intervals import merge
from genoloom.operators.ranks import ranked
from genoloom.sources.text import lines, numbered, own_reader, stored

# Feature types by role.
GENE_TYPES = ["gene", "pseudogene", "ncRNA_gene", "transposable_element_gene", "protein_coding_gene", "rRNA_gene", "tRNA_gene", "snRNA_gene", "snoRNA_gene", "miRNA_gene"]
SUB_TYPES = ["exon", "CDS", "five_prime_UTR", "three_prime_UTR", "UTR", "5UTR", "3UTR", "five_prime_utr", "three_prime_utr", "UTR5", "UTR3", "noncoding_exon", "pseudogenic_exon"]
SKIP_TYPES = ["start_codon", "stop_codon", "intron", "chromosome", "region", "contig", "scaffold", "supercontig", "biological_region", "Selenocysteine",
              "repeat_region", "match", "match_part", "polypeptide", "protein"]
TX_TYPES = ["mRNA", "transcript"]
GTF_LIKE = re.compile(r'\s*[A-Za-z_]+ "')


@dataclass
class Genes:
    """genes: gene_id, chr, start, end, strand, name, note, type, row, canonical.
    transcripts: transcript_id, gene_id, chr, start, end, strand, type, exon_len, cds_len, canonical, row.
    features: transcript_id, gene_id, class, chr, start, end, strand, row. raw: row, gene_id, level, line."""

    genes: DataFrame
    transcripts: DataFrame
    features: DataFrame
    raw: DataFrame
    format: str

    def summary(self, most: int = 6) -> str:
        """Counts and the first genes in the order of the file."""
        columns = ["gene_id", "chr", "start", "end", "strand", "name"]
        few = self.genes.orderBy(F.asc_nulls_last("row"), "gene_id").select(columns).head(most)
        text = [f"{self.genes.count():,} genes, {self.transcripts.count():,} transcripts ({self.format.upper()})", *(["\t".join(columns)] if few else [])]
        return "\n".join(text + ["\t".join("" if v is None else str(v) for v in r) for r in few])

    def overlapping(self, chrom: str, start: int, end: int) -> Genes:
        """Whole models of the genes that overlap the interval."""
        genes = self.genes.where((F.col("chr") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))
        ids = genes.select("gene_id")
        keep = lambda df: df.join(ids, "gene_id", "left_semi")
        return Genes(genes, keep(self.transcripts), keep(self.features), keep(self.raw), self.format)


def records(spark: SparkSession, path: str, chrom: str | None = None, chr_map: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """(row, line, chr, type, start, end, strand, id, parent, name, note, hint) and the format. Lines from ##FASTA on are left out."""
    every = lines(spark, path)
    rows = numbered(every, plain=own_reader(path) is None)
    ends = F.col("value").startswith("##FASTA")
    cut = rows.where(ends).agg(F.min("row")).first()[0] if every.where(ends).head(1) else None
    rows = rows if cut is None else rows.where(F.col("row") < cut)
    told = F.col("value").contains("\t") & ~F.col("value").startswith("#")
    rows = rows.where(told)
    sample = [r.a for r in (every.where(told) if cut is None else rows).limit(500).select(F.get(F.split("value", "\t"), F.lit(8)).alias("a")).collect() if r.a]
    gtf = sum(bool(GTF_LIKE.match(a)) for a in sample) * 2 > len(sample)
    at = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    rows = rows.select("row", F.col("value").alias("line"), normalize_chr(at(0), chr_map).alias("chr"), at(2).alias("type"), at(3).try_cast("long").alias("start"), at(4).try_cast("long").alias("end"), at(6).alias("strand"), at(8).alias("a"))
    rows = rows.where("start IS NOT NULL AND end IS NOT NULL")
    if chrom is not None:
        rows = rows.where(F.col("chr") == normalize_chr(F.lit(chrom), chr_map))
    a, kind = F.col("a"), F.col("type")
    if gtf:
        gene, tx = attr_gtf(a, "gene_id"), attr_gtf(a, "transcript_id")
        more = {"id": F.when(kind == "gene", gene).when(kind.isin(TX_TYPES), tx), "parent": F.when(kind.isin(TX_TYPES), gene).when(kind.isin(SUB_TYPES), tx),
                "name": attr_gtf(a, "gene_name"), "note": attr_gtf(a, "gene_biotype"), "hint": gene}
    else:
        of = lambda *keys: F.coalesce(*[attr_gff3(a, k) for k in keys])
        more = {"id": of("ID"), "parent": of("Parent"), "name": of("Name", "gene_name"), "note": of("Note", "description", "product"), "hint": F.lit(None).cast("string")}
    return rows.withColumns(more).drop("a"), "gtf" if gtf else "gff3"


def _first(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("row"))).where("_k = 1").drop("_k")


def _flag(ids: DataFrame, column: str, name: str, flag: str) -> DataFrame:
    return ids.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn(flag, F.lit(True))


def _span(rows: DataFrame, key: str, **first: str) -> DataFrame:
    """One row a ``key``: the range, and the values of the first row in the file."""
    head = [F.min_by(c, "row").alias(n) for n, c in ({"chr": "chr", "strand": "strand"} | first).items()]
    return rows.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"), *head)


def models(rows: DataFrame, gene_types: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, transcripts, features) of :func:`records`.

    Absent levels are filled in: a transcript for features without one, a gene for transcripts
    without one, a body of one exon for bare genes, and exons of merged coding parts and UTRs.
    Every step is an equi-join on an id; tables that several steps read are stored, or the plan would double at each.
    """
    none = lambda kind: F.lit(None).cast(kind)
    is_gene, is_sub = F.col("type").isin(gene_types or GENE_TYPES), F.col("type").isin(SUB_TYPES)
    rows = stored(rows.drop("line"))
    g = _first(rows.where(is_gene).withColumn("gene_id", F.coalesce("id", F.concat(F.lit("gene_line"), "row"))), "gene_id")
    subs = rows.where(is_sub).withColumn("parent", F.explode_outer(F.split("parent", ",")))

    tx = rows.where(~is_gene & ~is_sub & ~F.col("type").isin(SKIP_TYPES)).withColumn("fp", F.split_part("parent", F.lit(","), F.lit(1)))
    tx = tx.join(_flag(g, "gene_id", "fp", "of_gene"), "fp", "left").join(_flag(subs, "parent", "id", "is_parent"), "id", "left")
    tx = tx.where(F.col("of_gene") | F.col("is_parent") | (F.col("parent").isNull() & F.col("type").isin(TX_TYPES)))
    tx = _first(tx.withColumn("transcript_id", F.coalesce("id", F.concat(F.lit("transcript_line"), "row"))), "transcript_id")
    tx = tx.select("transcript_id", F.coalesce("fp", "hint", "transcript_id").alias("gene_id"), "chr", "start", "end", "strand", "type", "name", "row")
    g, tx = stored(g), stored(tx)

    s = subs.withColumn("class", sub_class(F.col("type")))
    s = s.join(tx.select(F.col("transcript_id").alias("parent"), F.col("gene_id").alias("tx_gene")), "parent", "left").join(_flag(g, "gene_id", "parent", "on_gene"), "parent", "left")
    lone = F.coalesce("parent", F.concat(F.lit("feature_line"), "row"))
    s = s.withColumns({
        "transcript_id": F.when(F.col("tx_gene").isNotNull(), F.col("parent")).when(F.col("on_gene"), F.concat("parent", F.lit(".model"))).otherwise(lone),
        "gene_id": F.coalesce("tx_gene", F.when(F.col("on_gene"), F.col("parent")), "hint", lone),
    }).select("transcript_id", "gene_id", "class", "chr", "start", "end", "strand", "row")
    s = stored(s)

    absent = _span(s.join(tx.select("transcript_id"), "transcript_id", "left_anti"), "transcript_id", gene_id="gene_id")
    tx = stored(tx.unionByName(absent.withColumns({"type": F.lit("transcript"), "name": none("string"), "row": none("long")})))
    # a filled-in transcript has no row: those of the file come first
    orphan = tx.join(g.select("gene_id"), "gene_id", "left_anti").withColumn("row", F.coalesce("row", F.lit((1 << 63) - 1)))
    made = _span(orphan, "gene_id", name="name").withColumns({"note": none("string"), "type": F.lit("gene"), "row": none("long")})
    g = g.select("gene_id", "chr", "start", "end", "strand", "name", "note", "type", "row").unionByName(made)
    g = stored(g)

    bare = g.join(tx.select("gene_id"), "gene_id", "left_anti").withColumn("transcript_id", F.concat("gene_id", F.lit(".gene")))
    tx = tx.unionByName(bare.select("transcript_id", "gene_id", "chr", "start", "end", "strand", F.lit("gene_only").alias("type"), "name", none("long").alias("row")))
    s = s.unionByName(bare.select("transcript_id", "gene_id", F.lit("exon").alias("class"), "chr", "start", "end", "strand", none("long").alias("row")))
    s = stored(s)
    parts = s.join(s.where("class = 'exon'").select("transcript_id"), "transcript_id", "left_anti")
    whose = _span(parts, "transcript_id", gene_id="gene_id").select("transcript_id", "gene_id", "chr", "strand")
    exons = merge(parts.select("transcript_id", "start", "end"), "transcript_id").select("transcript_id", "start", "end").join(whose, "transcript_id")
    s = stored(s.unionByName(exons.withColumns({"class": F.lit("exon"), "row": none("long")})))

    size = F.col("end") - F.col("start") + 1
    of = lambda c: F.sum(F.when(F.col("class") == c, size).otherwise(0))
    sums = s.groupBy("transcript_id").agg(of("exon").alias("exon_len"), of("CDS").alias("cds_len"))
    tx = tx.join(sums, "transcript_id", "left").na.fill(0, ["exon_len", "cds_len"])
    rank: Column = F.row_number().over(Window.partitionBy("gene_id").orderBy(F.desc("cds_len"), F.desc("exon_len"), F.asc_nulls_last("row"), "transcript_id"))
    tx = stored(tx.withColumn("canonical", rank == 1))
    best = tx.where("canonical").select("gene_id", F.col("transcript_id").alias("canonical"))
    # gene_ord: a gene's place by start, end and line, by which equal places in annotation are told apart
    g = ranked(g.withColumn("name", F.coalesce("name", "gene_id")).join(best, "gene_id", "left"), [], ["start", "end", F.asc_nulls_last("row"), "gene_id"], "gene_ord").drop("_n")
    return g, tx.drop("name"), s


def locate_gene(genes: Genes, name: str) -> tuple[Row, str | None]:
    """(gene, transcript id or None): by id or name, else by transcript id, else by id or name in any case.

    Of several the first of the file, with a warning; of none an error with up to 8 similar names.
    """
    g, like = genes.genes, name.upper()
    rank = F.when((F.col("gene_id") == name) | (F.col("name") == name), 0).when((F.upper("gene_id") == like) | (F.upper("name") == like), 2)
    own = g.select("*", rank.alias("_rank"), F.lit(None).cast("string").alias("_tx")).where("_rank IS NOT NULL")
    by_tx = genes.transcripts.where(F.col("transcript_id") == name).select("gene_id", F.col("transcript_id").alias("_tx"))
    own = own.unionByName(g.join(by_tx, "gene_id").withColumn("_rank", F.lit(1)).select(own.columns))
    found = own.orderBy("_rank", F.asc_nulls_last("row"), "chr", "start", "end", "gene_id").limit(2).collect()
    if not found:
        near = g.select(F.explode(F.array("gene_id", "name")).alias("n")).where(F.contains(F.upper("n"), F.lit(like))).distinct().orderBy("n").limit(8).collect()
        raise ValueError(f"gene {name!r} was not found" + (f"; similar: {', '.join(r.n for r in near)}" if near else ""))
    first = found[0]
    if len(found) == 2 and found[1]._rank == first._rank != 1:
        warnings.warn(f"several genes match {name!r}; {first.gene_id} is taken", stacklevel=2)
    return Row(**{c: first[c] for c in g.columns}), first._tx


def read_gff(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, chr_map: dict[str, str] | None = None, gene_types: list[str] | None = None) -> Genes:
    rows, kind = records(spark, path, chrom, chr_map)
    genes, tx, parts = models(rows, gene_types)
    used = [df.where("row IS NOT NULL").select("row", "gene_id", F.lit(level).alias("level")) for df, level in ((genes, "gene"), (tx, "transcript"), (parts, "feature"))]
    raw = used[0].unionByName(used[1]).unionByName(used[2]).distinct().join(rows.select("row", "line"), "row")
    out = Genes(genes, tx, parts, raw, kind)
    if chrom is None or (start is None and end is None):
        return out
    return out.overlapping(genes.sparkSession.range(1).select(normalize_chr(F.lit(chrom), chr_map)).first()[0], start or 0, (1 << 62) if end is None else end)
