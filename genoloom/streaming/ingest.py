"""Streaming ingest of association and genotype drops, and event counts by window.

A store of best rows holds, for each position, the row of least P that any drop has brought (and the least of those with P = 0, which
quality control raises by the whole table). It is cut into bins of a chromosome; a batch rewrites only the bins that it touches, as a new
version, and then names the versions that hold in a manifest of its own. A batch that is run again writes the same versions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from genoloom.functions.genotype import extract_gt, gt_to_dosage
from genoloom.functions.names import normalize_chr
from genoloom.operators import gwas
from genoloom.sources.text import fields, saved


def stream_gwas(spark: SparkSession, folder: str, names: list[str], sep: str = "\t") -> DataFrame:
    """snp, chr, pos, p, parsed, of files dropped into ``folder`` (fields in the order of ``names``); rows that fail a check are left out."""
    rows = spark.readStream.text(folder).select(fields(F.col("value"), sep).alias("f"))
    raw = rows.select([F.get("f", F.lit(names.index(c))).alias(c) for c in ("snp", "chr", "pos", "p")])
    return gwas.parse(raw).where(f"NOT ({gwas.MISSING})").where(f"NOT ({gwas.BAD_POS})").where(f"NOT ({gwas.BAD_P})").withColumn("pos", F.col("pos").cast("long"))


def ingest(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet by chromosome; the file sink's log makes each row count once after restarts."""
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("chr").outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


BIN = 50_000_000
ROW = "snp string, chr string, pos long, p double, zero boolean, bin string"


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    """Bin -> version, as the latest batch (before batch ``before``) left them."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    done = [int(n) for n in (f.getPath().getName() for f in files.listStatus(folder)) if n.isdigit()]
    done = [n for n in done if before is None or n < before]
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifests/{max(done)}").collect())) if done else {}


def _held(spark: SparkSession, path: str, versions: dict[str, int]) -> DataFrame:
    files = [f"{path}/bins/{v}/bin={b}" for b, v in versions.items()]
    rows = spark.read.schema(ROW.rsplit(",", 1)[0]).parquet(*files) if files else spark.createDataFrame([], ROW.rsplit(",", 1)[0])
    return rows


def _best(rows: DataFrame) -> DataFrame:
    """The row of least P, then id, of each position, apart for P = 0."""
    kept = rows.groupBy("chr", "pos", "zero").agg(F.min(F.struct("p", "snp")).alias("b"))
    return kept.select("b.snp", "chr", "pos", "b.p", "zero")


def merge_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Merge one batch (snp, chr, pos, p) into the store below ``path``."""
    spark = rows.sparkSession
    name = F.when(F.col("snp").isNull() | F.col("snp").isin("", "."), F.concat_ws(":", "chr", "pos")).otherwise(F.col("snp"))
    place = F.concat("chr", F.lit("_"), (F.col("pos") / BIN).cast("long"))
    new = saved(_best(rows.select(name.alias("snp"), "chr", "pos", "p", (F.col("p") == 0).alias("zero"))).withColumn("bin", F.url_encode(place)))
    touched = [r.bin for r in new.select("bin").distinct().collect()]  # bins of one batch: as many as 50 Mb stretches at most
    versions = _manifest(spark, path, batch)
    old = _held(spark, path, {b: v for b, v in versions.items() if b in set(touched)}).withColumn("bin", F.url_encode(place))
    merged = _best(old.unionByName(new).drop("bin")).withColumn("bin", F.url_encode(place))
    if touched:
        merged.repartition("bin").write.mode("overwrite").partitionBy("bin").parquet(f"{path}/bins/{batch}")
    text = json.dumps(versions | dict.fromkeys(touched, batch))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifests/{batch}")


def ingest_best(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the best rows of a stream (of :func:`stream_gwas`) in a store below ``path``."""
    out = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: merge_batch(df, path, batch))
    return (out.trigger(availableNow=True) if available_now else out).start()


def read_best(spark: SparkSession, path: str) -> DataFrame:
    """snp, chr, pos, p, logp of a store, as ``gwas.qc`` gives them of all its drops in one table: P = 0 raised, one row a position, ids unique."""
    return gwas.qc(_held(spark, path, _manifest(spark, path)).select("snp", "chr", F.col("pos").cast("double").alias("pos"), "p"))


def stream_vcf(spark: SparkSession, folder: str, samples: list[str], chr_map: dict[str, str] | None = None) -> DataFrame:
    """id, chr, pos, ref, alt, sample, dos of VCF files dropped into ``folder``, whose samples are ``samples`` in this order."""
    lines = spark.readStream.text(folder).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    at = lambda i: F.get("f", F.lit(i))
    rows = lines.select(F.split("value", "\t").alias("f")).select("f", normalize_chr(at(0), chr_map).alias("chr"), at(1).try_cast("long").alias("pos")).where("pos IS NOT NULL")
    ident = F.when(at(2).isin(".", ""), F.concat_ws(":", "chr", "pos")).otherwise(at(2))
    long = rows.select(ident.alias("id"), "chr", "pos", at(3).alias("ref"), at(4).alias("alt"), at(8).alias("format"), F.posexplode(F.slice("f", 10, len(samples))).alias("smp", "call"))
    return long.select("id", "chr", "pos", "ref", "alt", F.get(F.array(*map(F.lit, samples)), F.col("smp")).alias("sample"), gt_to_dosage(extract_gt(F.col("call"), F.col("format"))).alias("dos"))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window start, kind, n: with a watermark on a stream, the same plan without one on a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
