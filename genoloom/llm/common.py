"""Helpers shared by the training-data operators: shared-storage tables, Arrow access, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_EDGES = 1 << 19
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="genoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit; the folder's owner then removes it
            return


atexit.register(_clean)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/genoloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``df``; from now on its session sends Python workers batches of about ``size`` bytes at most, not 10,000 rows of any length. Results don't depend on it."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    before = int(spark.conf.get(name).rstrip("b") or 0)
    if not 0 < before <= size:
        spark.conf.set(name, size)
    return df


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table_bytes(df: DataFrame) -> int:
    """Stored bytes of a table made by :func:`materialize`."""
    spark, total = df.sparkSession, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` (made by :func:`materialize`) with a broadcast hint if its files hold at most ``limit`` bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def plain(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with all columns but ``keep`` named c0, c1, ..., so that no column that is added clashes; toDF(*docs.columns) names them back."""
    return docs.toDF(*[c if c in keep else f"c{i}" for i, c in enumerate(docs.columns)])


def row_hash(docs: DataFrame) -> Column:
    """Hash of whole rows (a map counts by its entries)."""
    return F.xxhash64(*[F.to_json(c) if f.dataType.typeName() == "map" else F.col(c) for c, f in zip(docs.columns, docs.schema, strict=True)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """A text column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most`` bytes, but for a longer one alone: what Python objects of a batch take is bounded by that."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        ends, a = np.cumsum(sizes + 8), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def trim() -> None:
    """Give a worker's free memory back to the system; idle workers hold it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Give back what finished steps left at the driver: plans of unreachable DataFrames, their broadcasts and shuffles, free memory of both processes.

    Many small jobs in a row otherwise fill the driver, and executors keep what only a collection at the driver clears.
    """
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def byte_runs(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes joined, offsets) for runs of rows of about ``most`` bytes; nulls count as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def squeeze(x: np.ndarray) -> bytes:
    """Compressed values, their bytes by significance."""
    import zstandard

    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unsqueeze(data: bytes, kind: type = np.uint64) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack(values: np.ndarray) -> bytes:
    """Sorted values (uint64) as compressed differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=np.uint64)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a partition -> one (node, least node it reaches by these edges) for each node but the least ones."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            break
        np.minimum.at(label, a, b)
        np.minimum.at(label, b, a)
        while (label[label] != label).any():
            label = label[label]
    keep = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], ["u", "v"])
    trim()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of ``edges`` (u, v: long), root the smallest node that it reaches.

    A round first turns each partition's edges, some PART_EDGES, into a forest of stars; then large-star and small-star steps join the partitions.
    These are groupBy(min) with map-side combine and equi-joins, so no component meets in one task. Ends when a round changes nothing, or at once
    where one partition holds all edges.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        # one partition for each PART_EDGES edges, so that a small graph leaves few shuffle files in each of its exchanges
        parts = 1 + edges.count() // PART_EDGES
        edges, done = edges.coalesce(parts).mapInArrow(_forest, "u long, v long"), edges
        if parts > 1:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
            low = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m")).coalesce(parts)
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct().coalesce(parts)
            low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
            joined = large.join(low, "u")
            small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).coalesce(parts)
            edges = small.distinct().coalesce(parts)
        edges = materialize(edges, "edges")
        discard(done)
        if parts == 1:
            break
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last is not None and tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
