"""Writers. Spark writes rows in parallel as a folder of part files; :func:`single` joins a small result to one file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.genotype import hmp_to_gts
from genoloom.functions.names import chr_key, normalize_chr
from genoloom.operators.report import ld_matrix_rows, ld_pairs_table
from genoloom.operators.tree import Tree, newick
from genoloom.sources.blockgzip import compression as packed_as
from genoloom.sources.blockgzip import write_blocks_text
from genoloom.sources.genome import fasta, fasta_bases, fasta_index
from genoloom.sources.genotypes import VCF_FIXED, hapmap_rows, region_of
from genoloom.sources.gff import Genes
from genoloom.sources.text import stored


def single(spark: SparkSession, path: str, text: Iterable[str]) -> str:
    """Write lines, which the driver holds one at a time, to one file of any Hadoop file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        batch: list[str] = []
        for line in text:
            batch.append(line + "\n")
            if len(batch) == 10_000:
                out.write("".join(batch).encode())
                batch = []
        out.write("".join(batch).encode())
    finally:
        out.close()
    return path


def _cell(value: object, sep: str) -> str:
    text = "" if value is None else ("TRUE" if value else "FALSE") if isinstance(value, bool) else str(value)
    return '"' + text.replace('"', '""') + '"' if sep in text or '"' in text or "\n" in text else text


def write_table(df: DataFrame, path: str) -> str:
    """One delimited file of a report table: commas for .csv, else tabs; null is empty. Rows stream from one partition at a time."""
    sep = "," if path.endswith(".csv") else "\t"
    return single(df.sparkSession, path, _table(df, sep))


def _table(df: DataFrame, sep: str) -> Iterable[str]:
    yield sep.join(_cell(c, sep) for c in df.columns)
    for r in df.toLocalIterator():
        yield sep.join(_cell(v, sep) for v in r)


def write_large(df: DataFrame, path: str) -> None:
    """Delimited part files with headers, written in parallel."""
    df.write.csv(path, sep="," if path.endswith(".csv") else "\t", header=True, nullValue="", emptyValue="")


def write_blocks(blocks: DataFrame, path: str) -> str:
    """CHR BP1 BP2 KB NSNPS SNPS of blocks, in natural order."""
    rows = blocks.orderBy(chr_key(F.col("chr")), "start")
    kb = F.round((F.col("end") - F.col("start") + 1) / 1000, 3)
    return write_table(rows.select(F.col("chr").alias("CHR"), F.col("start").alias("BP1"), F.col("end").alias("BP2"), kb.alias("KB"), F.col("nsnps").alias("NSNPS"), F.col("snps").alias("SNPS")), path)


def write_ld(pairs: DataFrame, variants: DataFrame, path: str, form: str = "matrix", value: str = "r2", digits: int = 4, least: float = 0.0, genes: DataFrame | None = None, features: DataFrame | None = None, parts: bool = False) -> str:
    """LD as a square table or as pairs of ``least`` or more, in order of position, with genes where given. pairs: snp_a, pos_a, snp_b, pos_b, value.

    A matrix streams a row at a time into one file; with ``parts`` its rows, the header first, are written in parallel as ordered part files.
    """
    if form == "matrix":
        sep = "," if path.endswith(".csv") else "\t"
        rows = ld_matrix_rows(pairs, variants, value, digits, genes, features, sep=sep)
        own = [c for c in rows.columns if c not in ("rank", "cells")]
        clean = lambda c: F.when(F.contains(c, F.lit(sep)) | F.contains(c, F.lit('"')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
        text = [clean(F.col(c).cast("string")) for c in own]
        names = rows.agg(F.sort_array(F.collect_list(F.struct("rank", clean(F.col("id")).alias("i")))).alias("x")).select(F.lit(0).cast("long").alias("rank"), F.concat_ws(sep, *map(F.lit, own), F.col("x.i")).alias("value"))
        every = names.unionByName(rows.select("rank", F.concat_ws(sep, *text, "cells").alias("value"))).orderBy("rank").select("value")
        if parts:
            every.write.text(path)
            return path
        return single(pairs.sparkSession, path, (r.value for r in every.toLocalIterator()))
    if form != "pairs":
        raise ValueError("form is matrix or pairs")
    return write_table(ld_pairs_table(pairs, value, digits, least, variants, genes, features).orderBy("pos_a", "pos_b"), path)


def write_lines(spark: SparkSession, path: str, text: Iterable[str]) -> str:
    """Text such as a README."""
    return single(spark, path, text)


def write_newick(spark: SparkSession, tree: Tree, path: str, digits: int = 6) -> str:
    return single(spark, path, [newick(tree, digits)])


def write_region_genes(genes: Genes, path: str, features: str = "gene", header: bool = True) -> str:
    """The file's own lines of ``genes``: of genes only (transcripts where a gene has no line), or of all levels."""
    raw = genes.raw
    if features == "gene":
        own = raw.where("level = 'gene'")
        raw = own.unionByName(raw.where("level = 'transcript'").join(own.select("gene_id"), "gene_id", "left_anti"))
    rows = raw.select("row", "line").dropDuplicates(["row"]).orderBy("row")

    def text() -> Iterable[str]:
        if header:
            yield "#gtf" if genes.format == "gtf" else "##gff-version 3"
        for r in rows.toLocalIterator():
            yield r.line

    return single(raw.sparkSession, path, text())


def hapmap_to_vcf(spark: SparkSession, source: str, path: str, chr_map: dict[str, str] | None = None, compression: str | None = None, ref_fasta: str | None = None, indels: str = "drop",
                  chrom: str | None = None, start: int | None = None, end: int | None = None, chr_prefix: str | None = None) -> dict[str, int]:
    """A VCF of a HapMap file as ordered part files, the header in a file that sorts before them; joined by name they are one VCF.

    With ``ref_fasta``, a base of the reference that is among a SNP's alleles becomes REF; where none is, FILTER is RefMismatch, else PASS.
    Sites with +, - or 0 among the alleles are dropped, or with indels="symbolic" written with the reference's base (else N) and <INS>, <DEL>, <INDEL>.
    Rows are range-partitioned by natural chromosome order and position, so sorting is distributed. With compression="bgzip" the parts are
    block-compressed, the header among them, with one index for all (``blockgzip.joined`` makes them one file). Returns counts: read, written, indels, mismatches.
    """
    if indels not in ("drop", "symbolic"):
        raise ValueError("indels is drop or symbolic")
    rows, first, samples = hapmap_rows(spark, source, chr_map)
    rows = region_of(rows, chrom, start, end, chr_map)
    every = F.split("aux", "/")
    # what the conversion keeps: rows with alleles, of which those with a sign may be dropped
    rows = rows.where(F.coalesce(F.col("aux"), F.lit("")) != "").withColumn("sign", F.exists(every, lambda a: a.isin("+", "-", "0")))
    if ref_fasta:
        named = fasta(spark, ref_fasta) if packed_as(ref_fasta) else fasta_index(spark, ref_fasta)
        contigs = named.select("contig").distinct().select("contig", normalize_chr(F.col("contig"), chr_map).alias("chr"))
        contigs = contigs.groupBy("chr").agg(F.min("contig").alias("contig"))
        bases = fasta_bases(spark, ref_fasta, rows.select("v", "chr", "pos").join(contigs, "chr").select("contig", "pos", "v")).select("v", "contig", "base")
        rows = rows.join(bases, "v", "left")
    else:
        rows = rows.withColumns({"base": F.lit(None).cast("string"), "contig": F.lit(None).cast("string")})
    plain = ~F.col("sign") & ~F.exists(every, lambda a: F.length(a) > 1)
    known = plain & F.col("base").isNotNull()
    use = F.coalesce(known & F.array_contains(every, F.col("base")), F.lit(False))
    rows = rows.withColumns({"use": use, "mismatch": F.coalesce(known, F.lit(False)) & ~use})
    order = F.when(F.col("use"), F.concat(F.array("base"), F.filter(every, lambda a: a != F.col("base")))).otherwise(every)
    rows = rows.withColumn("order", order).withColumn("joined", F.array_join("order", "/"))
    texts = F.transform(F.sequence(F.lit(first), F.lit(first + len(samples) - 1)), lambda i: F.coalesce(F.upper(F.trim(F.get("f", i))), F.lit("")))
    calls = hmp_to_gts(texts, F.col("joined"))
    ident = F.when(F.col("id").isNull() | F.col("id").isin("", "NA"), ".").otherwise(F.col("id"))
    symbol = F.transform(F.slice("order", 2, 1 << 20), lambda a: F.when(~F.col("sign"), a).when(a == "+", "<INS>").when(a == "-", "<DEL>").otherwise("<INDEL>"))
    other = F.when(F.size("order") > 1, F.array_join(symbol, ",")).otherwise(".")
    ref = F.when(F.col("sign"), F.coalesce("base", F.lit("N"))).otherwise(F.get("order", F.lit(0)))
    label = F.concat(F.lit(chr_prefix), "chr") if chr_prefix is not None else F.coalesce("contig", "chr")
    line = F.concat_ws("\t", "label", "pos", ident, ref, other, F.lit("."), F.when(F.col("mismatch"), "RefMismatch").otherwise("PASS"), F.lit("."), F.lit("GT"), F.array_join(calls, "\t"))
    rows = rows.withColumns({"_o": chr_key(F.col("chr")), "label": label})
    # one pass over the source: what the counts, the names and the sort's sampling need is stored once
    rows = stored(rows.select("_o", "pos", "v", "label", "sign", "mismatch", F.when(F.lit(indels == "symbolic") | ~F.col("sign"), line).alias("value"), F.length(ref).alias("width")))
    kept = rows.where("value IS NOT NULL")
    count = rows.agg(F.count("*").alias("read"), F.count_if("sign").alias("indels"), F.count_if("mismatch").alias("mismatches")).first().asDict()
    names = [r.label for r in kept.groupBy("label").agg(F.first("_o").alias("o")).orderBy("o", "label").collect()]
    head = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">', *(['##FILTER=<ID=RefMismatch,Description="Reference base is none of the alleles">'] if ref_fasta else []),
            *[f"##contig=<ID={c}>" for c in names], '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join([*VCF_FIXED, *samples])]
    ordered = kept.orderBy("_o", "label", "pos", "v")
    if compression == "bgzip":
        write_blocks_text(ordered.select("value", F.col("label").alias("name"), (F.col("pos") - 1).alias("first"), (F.col("pos") + F.col("width") - 2).alias("last")), path, "\n".join(head) + "\n")
    else:
        ordered.select("value").write.text(path, compression=compression or "none")
        single(spark, f"{path}/header.vcf", head)
    return count | {"written": count["read"] - (count["indels"] if indels == "drop" else 0)}
