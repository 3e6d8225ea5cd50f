"""Chromosome lengths, FASTA, LD blocks and LD tables from text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.functions.genomes import Species, species, species_key
from genoloom.functions.names import normalize_chr
from genoloom.operators import gwas as association
from genoloom.sources.blockgzip import Bytes, compression, lines_with_places, listed, opened
from genoloom.sources.text import fields, find_column, head, lines, numbered, separator, table


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, row, seq: the sequence lines. A line takes the last header of its split, or of the splits before: one row a split is carried over."""
    rows = numbered(lines(spark, path)).where(F.trim("value") != "")
    head_of = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S+)", 1))
    own = Window.partitionBy("path", "block").orderBy("row")
    rows = rows.withColumns({"own": F.last(head_of, True).over(own)})
    over = rows.groupBy("path", "block").agg(F.max_by(head_of, F.when(head_of.isNotNull(), F.col("row"))).alias("tail"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = over.select("path", "block", F.last("tail", True).over(before).alias("carried"))
    rows = rows.join(over, ["path", "block"]).where(~F.col("value").startswith(">"))
    return rows.select(F.coalesce("own", "carried").alias("contig"), "row", F.upper(F.trim("value")).alias("seq"))


def fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """contig, length."""
    return fasta(spark, path).groupBy("contig").agg(F.sum(F.length("seq")).cast("long").alias("length"))


def _bases_by_line(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """Bases of a compressed file, which is read whole. Lines of a contig but for its last are equally long, so a site joins one line by number."""
    rows = fasta(spark, path)
    shape = rows.groupBy("contig").agg(F.min("row").alias("first"), F.max(F.length("seq")).alias("width"))
    rows = rows.join(shape, "contig").select("contig", (F.col("row") - F.col("first")).alias("_n"), "seq")
    at = sites.join(shape.select("contig", "width"), "contig", "left").withColumn("_n", F.expr("(pos - 1) div width"))
    found = at.join(rows, ["contig", "_n"], "left")
    base = F.expr("CASE WHEN pos >= 1 THEN nullif(substring(seq, cast((pos - 1) % width + 1 AS int), 1), '') END")
    return found.select(*[sites[c] if c != "contig" else F.col("contig") for c in sites.columns], base.alias("base"))


#: Sites this near to each other are read in one piece, which ends at MOST bytes.
NEAR, MOST = 4096, 1 << 20


def pieces(at: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) runs of sorted offsets to be read at once."""
    cut = np.flatnonzero(np.diff(at) > NEAR) + 1
    out = []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        while a < b:
            e = min(b, int(np.searchsorted(at, at[a] + MOST)))
            out.append((a, e))
            a = e
    return out


def _bases_at(files: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Bytes(files)
        for batch in batches:
            at = batch.column("_byte").to_numpy()
            found: list[str] = []
            for a, b in pieces(at):
                raw = source.read(int(at[a]), int(at[b - 1] - at[a]) + 1).decode("latin-1").upper()
                found += [raw[k] for k in (at[a:b] - at[a]).tolist()]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_byte"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(found, pa.string())], [*[batch.schema.names[i] for i in keep], "base"])

    return run


def fasta_bases(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """``sites`` (contig, pos, ...) with base; null outside.

    By the index, sites are byte offsets: sorted over tasks, each run of near ones is read by one seek, so what is read grows with the sites.
    A compressed file is read whole.
    """
    if compression(path) or not listed(path):
        return _bases_by_line(spark, path, sites)
    index = fasta_index(spark, path).select("contig", F.col("length").alias("_len"), F.col("offset").alias("_off"), F.col("line_bases").alias("_lb"), F.col("line_bytes").alias("_by"))
    at = sites.join(index, "contig", "left")
    byte = F.expr("CASE WHEN pos BETWEEN 1 AND _len THEN _off + (pos - 1) div _lb * _by + (pos - 1) % _lb END")
    at = at.select(*[sites[c] if c != "contig" else F.col("contig") for c in sites.columns], byte.cast("long").alias("_byte"))
    inside = at.where("_byte IS NOT NULL").repartitionByRange("_byte").sortWithinPartitions("_byte")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sites.schema)
    found = inside.mapInArrow(_bases_at(listed(path)), f"{kind}, base string")
    return found.unionByName(at.where("_byte IS NULL").drop("_byte").withColumn("base", F.lit(None).cast("string")))


def sizes_of(spark: SparkSession, x: str | dict[str, int] | DataFrame | Species | None = None, gwas: DataFrame | None = None, chr_map: dict[str, str] | None = None) -> DataFrame:
    """chr, length of a species or its name, a mapping, a table (name and length first), a file, or of the positions of ``gwas``."""
    if x is None:
        if gwas is None:
            raise ValueError("chromosome lengths need a species, a table, a file or association results")
        return association.chrom_sizes(gwas)
    if isinstance(x, str):
        return species(x).sizes(spark) if species_key(x) else chrom_sizes(spark, x, chr_map)
    if isinstance(x, Species):
        return x.sizes(spark)
    rows = spark.createDataFrame([(str(k), int(v)) for k, v in x.items()], "name string, length long") if isinstance(x, dict) else x
    name, length = rows.columns[:2]
    rows = rows.select(normalize_chr(F.col(f"`{name}`"), chr_map).alias("chr"), F.col(f"`{length}`").try_cast("long").alias("length"), F.monotonically_increasing_id().alias("at"))
    out = rows.where("chr IS NOT NULL AND length > 0").groupBy("chr").agg(F.min_by("length", "at").alias("length"))
    if out.isEmpty():
        raise ValueError("no chromosome has a length above 0")
    return out


def chrom_sizes(spark: SparkSession, path: str, chr_map: dict[str, str] | None = None) -> DataFrame:
    """chr, length of a FASTA (or its index), GFF, VCF or two-column file; the first of repeated names, lengths above 0.

    A GFF without sequence-region lines gives the longest chromosome, region or scaffold record that starts at 1.
    """
    first = head(spark, path)[0]
    rows = lines(spark, path)
    if first.startswith(">"):
        found = fasta_lengths(spark, path).select("contig", "length", F.lit(0).alias("at"))
    elif first.startswith("##fileformat=VCF"):
        v = rows.where(F.col("value").startswith("##contig="))
        found = v.select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("contig"), F.regexp_extract("value", r"length=([0-9]+)", 1).try_cast("long").alias("length"), F.struct("block", "line").alias("at"))
    elif first.startswith("##gff-version"):
        p = F.split("value", r"\s+")
        found = rows.where(F.col("value").startswith("##sequence-region")).select(F.get(p, F.lit(1)).alias("contig"), F.get(p, F.lit(3)).try_cast("long").alias("length"), F.struct("block", "line").alias("at"))
        if found.isEmpty():
            p = F.split("value", "\t")
            whole = rows.where(~F.col("value").startswith("#") & F.get(p, F.lit(2)).isin("chromosome", "region", "contig", "scaffold", "supercontig") & (F.get(p, F.lit(3)) == "1"))
            length = F.get(p, F.lit(4)).try_cast("long")
            found = whole.select(F.get(p, F.lit(0)).alias("contig"), length.alias("length"), F.struct((-length).alias("block"), "line").alias("at"))
    else:
        p = F.split(F.trim("value"), r"[\s,]+")
        found = rows.select(F.get(p, F.lit(0)).alias("contig"), F.get(p, F.lit(1)).try_cast("long").alias("length"), F.struct("block", "line").alias("at"))
    named = found.where("length > 0").withColumn("chr", normalize_chr(F.col("contig"), chr_map))
    return named.groupBy("chr").agg(F.min_by("length", "at").alias("length"))


def read_blocks(spark: SparkSession, path: str, chr_map: dict[str, str] | None = None) -> DataFrame:
    """chr, start, end and, where the file has them, nsnps and snps."""
    if head(spark, path)[0].strip().startswith("*"):
        raise ValueError(f"{path} has marker names only; the file with block coordinates is needed")
    rows = table(spark, path)
    # fixed values: names of the columns
    wanted = {"chr": ["CHR", "chrom", "chromosome", "chr_id"], "start": ["BP1", "START", "block_start", "bp_start", "from"], "end": ["BP2", "END", "block_end", "bp_end", "to"],
              "nsnps": ["NSNPS", "nsnp", "n_snps"], "snps": ["SNPS", "snp_list", "markers"]}
    found = {k: find_column(rows.columns, v) for k, v in wanted.items()}
    if None in (found["chr"], found["start"], found["end"]):
        raise ValueError(f"{path} needs columns for chr, start and end; columns: {', '.join(rows.columns)}")
    kinds = {"start": "long", "end": "long", "nsnps": "int"}
    out = [normalize_chr(F.col(f"`{n}`"), chr_map).alias(k) if k == "chr" else (F.col(f"`{n}`").try_cast(kinds[k]) if k in kinds else F.col(f"`{n}`")).alias(k) for k, n in found.items() if n]
    return rows.select(out).where("chr IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")


def read_ld(spark: SparkSession, path: str, stat: str = "R2") -> DataFrame:
    """id_a, pos_a, id_b, pos_b, value of a table of pairs, both directions and each variant with itself (1); R is squared."""
    rows = table(spark, path)
    col = find_column(rows.columns, ["DP"] if stat == "DP" else ["R2", "R"])
    if col is None:
        raise ValueError(f"{path} has no column for {stat}")
    value = F.col(f"`{col}`").try_cast("double")
    value = F.when(~F.isnan(value), value * value if col.upper() == "R" else value)
    pairs = rows.select(F.col("SNP_A").alias("id_a"), F.col("BP_A").try_cast("long").alias("pos_a"), F.col("SNP_B").alias("id_b"), F.col("BP_B").try_cast("long").alias("pos_b"), value.alias("value"))
    swapped = pairs.select(F.col("id_b").alias("id_a"), F.col("pos_b").alias("pos_a"), F.col("id_a").alias("id_b"), F.col("pos_a").alias("pos_b"), "value")
    both = pairs.unionByName(swapped).where("id_a <> id_b")
    own = both.select("id_a", "pos_a").distinct().select("id_a", "pos_a", F.col("id_a").alias("id_b"), F.col("pos_a").alias("pos_b"), F.lit(1.0).alias("value"))
    return both.unionByName(own)


def read_ld_square(spark: SparkSession, path: str, ids: list[str] | None = None, bim: str | None = None, chr_map: dict[str, str] | None = None) -> DataFrame:
    """id_a, pos_a, id_b, pos_b, value of a square matrix of numbers without names; nan is null.

    Names and positions come from ``bim`` (second and fourth field of its lines), or names from ``ids``; else v1, v2, ...
    Rows are numbered within splits, so a matrix is read in parallel.
    """
    sep = separator(head(spark, path)[0].strip())
    cells = numbered(lines(spark, path).where(F.trim("value") != "")).select("row", F.posexplode(fields(F.trim("value"), sep)).alias("at", "text"))
    value = F.trim("text").try_cast("double")
    cells = cells.select("row", (F.col("at") + 1).alias("col"), F.when(~F.isnan(value), value).alias("value"))
    n, least, most = cells.groupBy("row").agg(F.count("*").alias("n")).agg(F.count("*"), F.min("n"), F.max("n")).first()
    if not n == least == most:
        raise ValueError(f"{path} is not a square matrix")
    if bim is not None:
        f = F.split(F.trim("value"), r"\s+")
        names = numbered(lines(spark, bim).where(F.trim("value") != "")).select("row", F.get(f, F.lit(1)).alias("id"), F.get(f, F.lit(3)).try_cast("long").alias("pos"))
    elif ids is not None:
        names = spark.createDataFrame([(k, v, None) for k, v in enumerate(ids, 1)], "row long, id string, pos long")
    else:
        names = spark.range(1, n + 1).select(F.col("id").alias("row"), F.concat(F.lit("v"), "id").alias("id"), F.lit(None).cast("long").alias("pos"))
    if names.count() != n:
        raise ValueError(f"{path} has {n} rows, but there are {names.count()} names")
    a = names.select("row", F.col("id").alias("id_a"), F.col("pos").alias("pos_a"))
    b = names.select(F.col("row").alias("col"), F.col("id").alias("id_b"), F.col("pos").alias("pos_b"))
    return cells.join(a, "row").join(b, "col").select("id_a", "pos_a", "id_b", "pos_b", "value")


def read_groups(spark: SparkSession, x: str | dict[str, str] | DataFrame) -> DataFrame:
    """sample, grp of a two-column file with a header, a mapping, or a table whose first two columns these are."""
    if isinstance(x, dict):
        return spark.createDataFrame([(str(k), None if v is None else str(v)) for k, v in x.items()], "sample string, grp string")
    rows = table(spark, x) if isinstance(x, str) else x
    if len(rows.columns) < 2:
        raise ValueError("groups need a column of samples and one of groups")
    a, b = rows.columns[:2]
    return rows.select(F.col(f"`{a}`").cast("string").alias("sample"), F.col(f"`{b}`").cast("string").alias("grp"))


FAI = ("contig", "length", "offset", "line_bases", "line_bytes")


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, offset, line_bases, line_bytes of a plain FASTA, told from the file beside it (.fai) if there is one, or of that file itself."""
    fai = path if path.endswith(".fai") else f"{path}.fai"
    if path == fai or listed(fai):
        f = F.split("value", "\t")
        kinds = ("string", "long", "long", "int", "int")
        return lines(spark, fai).select(*[F.get(f, F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(zip(FAI, kinds, strict=True))]).where("length IS NOT NULL")
    if compression(path):
        raise ValueError("offsets need a plain FASTA, or its .fai file")
    rows = lines_with_places(spark, path)
    header = F.col("value").startswith(">")
    name = F.when(header, F.struct("line", F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("contig"), (F.col("line") + F.octet_length("value") + 1).alias("offset")))
    own = Window.partitionBy("path", "block").orderBy("line")
    over = rows.groupBy("block").agg(F.max(name).alias("tail"))  # one row a split
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = over.select("block", F.last("tail", True).over(before).alias("carried"))
    rows = rows.withColumn("own", F.last(name, True).over(own)).join(over, "block").withColumn("of", F.coalesce("own", "carried")).where("of IS NOT NULL")
    first = F.when(~header, F.struct("line", F.length(F.rtrim(F.regexp_replace("value", "\r$", ""))).alias("bases"), (F.octet_length("value") + 1).alias("bytes")))
    size = F.when(~header, F.length(F.rtrim(F.regexp_replace("value", "\r$", ""))))
    return rows.groupBy("of").agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("length"), F.min(first).alias("f")).select(
        F.col("of.contig").alias("contig"), "length", F.col("of.offset").alias("offset"), F.col("f.bases").cast("int").alias("line_bases"), F.col("f.bytes").cast("int").alias("line_bytes")
    )


def save_fasta_index(spark: SparkSession, path: str) -> str:
    """Write the .fai file of a plain FASTA: tab-separated, in the order of the file, one row a contig at a time."""
    rows = fasta_index(spark, path).orderBy("offset").toLocalIterator()
    system, inner = opened(f"{path}.fai")
    with system.open_output_stream(inner, compression=None) as out:
        for r in rows:
            out.write(("\t".join("" if v is None else str(v) for v in r) + "\n").encode())
    return f"{path}.fai"
