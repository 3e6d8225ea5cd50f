"""Text files as DataFrames of lines, read by Spark from any file system; headers are peeked at on the driver."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.sources.blockgzip import compression, listed, packed_lines

POINTER = "version https://git-lfs"


def own_reader(path: str) -> str | None:
    """How ``path`` is compressed, if Spark's text source would not split it or not know it by its name."""
    kind = compression(path)
    if kind in (None, "blocks"):
        return kind
    name = next((p for p, _ in listed(path)), path)
    return None if name.endswith({"gzip": ".gz", "bz2": ".bz2"}.get(kind, "/")) else kind


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and path, block, line, which together order the lines of a file.

    Plain files and block-compressed ones (told by their bytes) are split. Other gzip and bzip2 go through Spark's text source;
    xz, and what a name without its ending hides, are unpacked piece by piece, one file a task.
    """
    kind = own_reader(path)
    if kind:
        return packed_lines(spark, path, kind)
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and Spark runs on this machine alone."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="genoloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return re.sub("^file:/(?!/)", "file:///", found)


def saved(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in :func:`shared_folder` and read back: each later step reads its own columns only. The order of rows is not kept. Types without a Parquet form are checkpointed."""
    if re.search("void|interval|variant", df.schema.simpleString()):
        return saved(df)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def head(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    """The first ``n`` lines; an error for an empty file or a pointer of large-file storage."""
    got = [r.value for r in lines(spark, path).select("value").head(n)]
    if not got:
        raise ValueError(f"{path} is empty")
    if got[0].startswith(POINTER):
        raise ValueError(f"{path} is a pointer to a file in large-file storage")
    return got


def numbered(rows: DataFrame, plain: bool = False) -> DataFrame:
    """``rows`` (of :func:`lines`) with row: 1 for the first line of a file.

    Lines are ranked within their split; the splits before it are counted by an aggregate of one row a split.
    plain: ``line`` counts the lines of a split without gaps, as of Spark's text source, so that no line is shuffled.
    """
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if plain:
        return rows.join(F.broadcast(offset), ["path", "block"]).withColumn("row", F.col("line") - F.col("first") + 1 + F.col("offset")).drop("first")
    offset = offset.drop("first")
    own = Window.partitionBy("path", "block").orderBy("line")
    return rows.withColumn("row", F.row_number().over(own)).join(offset, ["path", "block"]).withColumn("row", F.col("row") + F.col("offset"))


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def find_column(names: list[str], wanted: list[str]) -> str | None:
    """The first of ``wanted`` that a name equals but for case and punctuation."""
    known: dict[str, str] = {}
    for name in names:
        known.setdefault(plain_name(name), name)
    return next((known[plain_name(w)] for w in wanted if plain_name(w) in known), None)


def separator(header: str) -> str:
    """Tab, comma, semicolon or white space."""
    return next((c for c in "\t,;" if c in header), " ")


def fields(value: Column, sep: str) -> Column:
    return F.split(F.trim(value), r"\s+") if sep == " " else F.split(value, sep)


def table(spark: SparkSession, path: str, sep: str = "auto") -> DataFrame:
    """A delimited file with a header, all columns text. Rows quoted as a whole are unquoted first; headers repeated in other files go."""
    first = head(spark, path)[0]
    whole = re.fullmatch(r'"((?:[^"]|"")*)"', first.strip())
    inner = whole.group(1).replace('""', '"') if whole else first
    sep = separator(inner) if sep == "auto" else sep
    whole = whole and sep in inner
    if not whole and sep != " " and not own_reader(path):
        return spark.read.csv(path, sep=sep, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    value = F.col("value")
    if whole:
        value = F.replace(F.regexp_replace(F.trim(value), r'^"|"$', ""), F.lit('""'), F.lit('"'))
    names = [n.strip().strip('"') for n in (inner.split() if sep == " " else inner.split(sep))]
    rows = lines(spark, path).where((F.col("value") != first) & (F.trim("value") != "")).select(fields(value, sep).alias("f"))
    return rows.select([F.regexp_replace(F.trim(F.get("f", F.lit(i))), r'^"|"$', "").alias(n) for i, n in enumerate(names)])
