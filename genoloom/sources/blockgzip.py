"""Block-compressed text (gzip members of at most 64 kB, each with its own length in its header) as a Spark data source and sink.

Reading splits a file at block headers, so one .vcf.gz feeds many tasks; with a binning index (.tbi) a region opens only the blocks of its bins.
A folder of such parts reads as one file in the order of names. Streams of other compression that Spark's text source does not know by the file's name are unpacked piece by piece, one file a task.
Writing cuts the blocks in tasks; part sizes then place every part's offsets, and the merged bins become the index.

Tasks open files through Arrow's file systems (local paths, hdfs, s3, gs).
"""

from __future__ import annotations

import bz2
import functools
import json
import lzma
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC = b"\x1f\x8b\x08\x04"
#: The empty block that ends a file (a fixed value of the format).
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_TEXT, READ, SPLIT = 65_280, 4 << 20, 32 << 20
LINES = "value string, path string, block long, line long"
#: Levels of the binning scheme: first bin and width in bits of each (fixed values of the format).
LEVELS = [(4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29)]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of a folder's parts by name; none if Arrow can't reach it."""
    try:
        system, inner = opened(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        if info.type != fs.FileType.Directory:
            return []
        found = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and x.base_name[0] not in "._" and not x.base_name.endswith(".tbi")]
        return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.base_name)]
    except (OSError, pa.ArrowException, ValueError, NotImplementedError):
        return []


def compression(path: str) -> str | None:
    """blocks, gzip, bz2 or xz by the first bytes of a file, or of a folder's first one; None for others and where Arrow can't reach it."""
    files = listed(path)
    if not files:
        return None
    system, inner = opened(files[0][0])
    with system.open_input_file(inner) as f:
        first = f.read(18)
    if first[:4] == MAGIC and first[12:14] == b"BC":
        return "blocks"
    return next((k for k, magic in (("gzip", b"\x1f\x8b"), ("bz2", b"BZh"), ("xz", b"\xfd7zXZ\x00")) if first.startswith(magic)), None)


class Bytes:
    """Files read as one run of bytes."""

    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files
        self.starts = np.cumsum([0, *[n for _, n in files]]).tolist()
        self.total = self.starts[-1]
        self.held: tuple[int, object] | None = None

    def read(self, at: int, n: int) -> bytes:
        out = []
        while n > 0 and at < self.total:
            k = int(np.searchsorted(self.starts, at, side="right")) - 1
            m = min(n, self.starts[k + 1] - at)
            if self.held is None or self.held[0] != k:
                system, inner = opened(self.files[k][0])
                self.held = k, system.open_input_file(inner)
            out.append(self.held[1].read_at(m, at - self.starts[k]))
            at, n = at + m, n - m
        return b"".join(out)


def block_size(head: bytes) -> int:
    """Bytes of the block whose first bytes are given; 0 if it is none."""
    if len(head) < 18 or head[:4] != MAGIC:
        return 0
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        n = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"BC" and n == 2 and len(extra) >= 6:
            return struct.unpack_from("<H", extra, 4)[0] + 1
        extra = extra[4 + n :]
    return 0


def next_block(source: Bytes, at: int) -> int:
    """Offset of the first block at ``at`` or later: a header whose length leads to another header or to the end."""
    while at < source.total:
        window = source.read(at, 1 << 17)
        k = window.find(MAGIC)
        while k >= 0:
            size = block_size(source.read(at + k, 64))
            if size and (at + k + size == source.total or block_size(source.read(at + k + size, 64))):
                return at + k
            k = window.find(MAGIC, k + 1)
        at += max(1, len(window) - 3)
    return source.total


def blocks(source: Bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the blocks from ``at`` on."""
    held, start = b"", at
    while at < source.total:
        if len(held) - (at - start) < 1 << 16:
            held, start = source.read(at, READ), at
        k = at - start
        size = block_size(held[k : k + 64])
        if not size:
            raise ValueError(f"no block at byte {at}")
        extra = struct.unpack_from("<H", held, k + 10)[0]
        yield at, zlib.decompress(memoryview(held)[k + 12 + extra : k + size - 8], -15)
        at += size


@dataclass
class Span:
    """Lines from ``begin`` (virtual offset: block offset << 16 | place in its text) to ``stop``.

    cut: ``begin`` is any byte; lines start behind the first line end after the next block header there. open: up to the line at the
    first byte of the first block at or behind ``stop`` >> 16, which the span after it passes over.
    """

    begin: int
    stop: int
    cut: bool = False
    open: bool = False

    def parts(self, size: int) -> list[Span]:
        """The span in pieces of about ``size`` bytes of the file."""
        first, last = self.begin >> 16, self.stop >> 16
        n = max(1, (last - first) // size)
        at = [first + (last - first) * k // n for k in range(1, n)]
        begins, stops = [self.begin, *[a << 16 for a in at]], [*[a << 16 for a in at], self.stop]
        return [Span(b, s, self.cut if k == 0 else True, self.open if k == n - 1 else True) for k, (b, s) in enumerate(zip(begins, stops, strict=True))]


def span_lines(source: Bytes, span: Span) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(lines, their virtual offsets) by block."""
    at = next_block(source, span.begin >> 16) if span.cut else span.begin >> 16
    limit = None if span.open else span.stop  # offsets below it; for open spans found at the first block behind
    skip, carry, carried, inside = span.cut, b"", None, 0 if span.cut else span.begin & 0xFFFF
    for offset, text in blocks(source, at):
        if not text:  # an empty block starts no line, for this span or the next
            continue
        if span.open and limit is None and offset >= span.stop >> 16:
            limit = (offset << 16) + 1
        if not carry:
            carried = offset << 16 | inside
        if limit is not None and carried >= limit:
            return
        end = np.flatnonzero(np.frombuffer(text, np.uint8)[inside:] == 10) + inside
        if len(end):
            starts = np.concatenate(([inside], end[:-1] + 1))
            found = [text[a:b] for a, b in zip(starts.tolist(), end.tolist(), strict=True)]
            found[0] = carry + found[0]
            places = starts.astype(np.int64) + (offset << 16)
            places[0] = carried
            if skip:
                found, places, skip = found[1:], places[1:], False
            if limit is not None:
                n = int(np.searchsorted(places, limit))
                if n:
                    yield found[:n], places[:n]
                if n < len(found):
                    return
            elif found:
                yield found, places
            carry = text[end[-1] + 1 :]
            carried = offset << 16 | int(end[-1] + 1)
        else:
            carry += text[inside:]
        inside = 0
    if carry and not skip and (limit is None or carried < limit):
        yield [carry], np.array([carried])


def placed_lines(source: Bytes, begin: int, stop: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(lines that start in begin..stop-1 of plain bytes, their offsets), some megabytes at a time."""
    at, carry, carried = begin, b"", begin
    skip = begin > 0 and source.read(begin - 1, 1) != b"\n"
    while at < source.total and carried < stop:
        data = source.read(at, READ)
        at += len(data)
        *found, rest = (carry + data).split(b"\n")
        if found:
            places = carried + np.concatenate(([0], np.cumsum([len(x) + 1 for x in found])))
            carried = int(places[-1])
            places = places[:-1]
            if skip:
                found, places, skip = found[1:], places[1:], False
            n = int(np.searchsorted(places, stop))
            if n:
                yield found[:n], places[:n]
        carry = rest
    if carry and not skip and carried < stop:
        yield [carry], np.array([carried])


def streamed(source: Bytes, kind: str) -> Iterator[list[bytes]]:
    """Lines of a stream of gzip members, bzip2 or xz, one piece at a time."""
    new = {"gzip": lambda: zlib.decompressobj(31), "blocks": lambda: zlib.decompressobj(31), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]
    unpack, at, carry = new(), 0, b""
    while at < source.total:
        data = source.read(at, 1 << 20)
        at += len(data)
        while data:
            text = unpack.decompress(data)
            data = b""
            if unpack.eof:
                data, unpack = unpack.unused_data.lstrip(b"\0") if kind == "xz" else unpack.unused_data, new()
            *found, carry = (carry + text).split(b"\n")
            if found:
                yield found
    if carry:
        yield [carry]


class _Task(InputPartition):
    def __init__(self, files: list, kind: str, spans: list[Span]) -> None:
        super().__init__(len(spans))
        self.files, self.kind, self.spans = files, kind, spans


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = [(p, n) for p, n in json.loads(options["files"])]
        self.kind = options["kind"]
        self.tasks = [[Span(*s) for s in task] for task in json.loads(options.get("tasks", "[]"))]

    def partitions(self) -> list[InputPartition]:
        if self.kind in ("blocks", "places"):
            return [_Task(self.files, self.kind, spans) for spans in self.tasks]
        return [_Task([f], self.kind, []) for f in self.files]

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        source = Bytes(partition.files)
        name = partition.files[0][0] if partition.kind != "blocks" or len(partition.files) == 1 else partition.files[0][0].rsplit("/", 1)[0]

        def batch(found: list[bytes], places: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
            values = pa.array([x[:-1] if x[-1:] == b"\r" else x for x in found], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([values, pa.array([name] * len(found)), pa.array(block, pa.int64()), pa.array(places, pa.int64())], ["value", "path", "block", "line"])

        if partition.kind == "blocks":
            for span in partition.spans:
                for found, places in span_lines(source, span):
                    yield batch(found, places, places >> 16)
            return
        if partition.kind == "places":
            for span in partition.spans:
                for found, places in placed_lines(source, span.begin, span.stop):
                    values = pa.array(found, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([values, pa.array([name] * len(found)), pa.array(np.full(len(found), span.begin)), pa.array(places)], ["value", "path", "block", "line"])
            return
        n = 0
        for found in streamed(source, partition.kind):
            yield batch(found, np.arange(n, n + len(found)), np.zeros(len(found), np.int64))
            n += len(found)


@dataclass
class Index:
    """A binning index: names; per name bins -> chunks (begin, end), and the least offset of each window of 16,384 positions."""

    names: list[str] = field(default_factory=list)
    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    windows: list[list[int]] = field(default_factory=list)


def read_index(path: str) -> Index | None:
    """A .tbi file; None if there is none."""
    system, inner = opened(path)
    if system.get_file_info(inner).type != fs.FileType.File:
        return None
    with system.open_input_file(inner) as f:
        raw, data = f.read(), b""
    while raw:
        unpack = zlib.decompressobj(31)
        data, raw = data + unpack.decompress(raw), unpack.unused_data
    if data[:4] != b"TBI\1":
        raise ValueError(f"{path} is no .tbi index")
    n, *_, width = struct.unpack_from("<8i", data, 4)
    out, at = Index([x.decode() for x in data[36 : 36 + width].split(b"\0")[:n]]), 36 + width
    for _ in range(n):
        (count,) = struct.unpack_from("<i", data, at)
        at, found = at + 4, {}
        for _ in range(count):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            flat = struct.unpack_from(f"<{2 * chunks}Q", data, at)
            found[number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 16 * chunks
        (count,) = struct.unpack_from("<i", data, at)
        out.bins.append(found)
        out.windows.append(list(struct.unpack_from(f"<{count}Q", data, at + 4)))
        at += 4 + 8 * count
    return out


def index_bytes(index: Index) -> bytes:
    """The .tbi file of VCF lines: name in column 1, position in column 2."""
    names = b"".join(n.encode() + b"\0" for n in index.names)
    out = [b"TBI\1", struct.pack("<8i", len(index.names), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
    for bins, windows in zip(index.bins, index.windows, strict=True):
        out.append(struct.pack("<i", len(bins)))
        for number, chunks in sorted(bins.items()):
            out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *[v for c in chunks for v in c]))
        out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
    text = b"".join(out)
    return b"".join(block(text[a : a + BLOCK_TEXT]) for a in range(0, len(text), BLOCK_TEXT)) + END


def bin_of(first: int, last: int) -> int:
    """The smallest bin that holds positions first..last, counted from 0."""
    return next(start + (first >> bits) for start, bits in LEVELS if first >> bits == last >> bits or bits == 29)


def chunks_of(index: Index, names: list[str], start: int, end: int) -> list[tuple[int, int]]:
    """The index's chunks that may hold positions start..end (from 1) of ``names``, merged where they touch or share a block."""
    found = []
    first, last = max(0, start - 1), min(end, 1 << 29) - 1
    for k in (i for i, n in enumerate(index.names) if n in names):
        windows = index.windows[k]
        least = windows[min(first >> 14, len(windows) - 1)] if windows else 0
        for low, bits in LEVELS:
            wanted = (low + (first >> bits), low + (last >> bits))
            found += [c for number, chunks in index.bins[k].items() if wanted[0] <= number <= wanted[1] and low <= number < low + (1 << (29 - bits)) for c in chunks if c[1] > least]
    out: list[tuple[int, int]] = []
    for begin, stop in sorted(found):
        if out and begin >> 16 <= out[-1][1] >> 16:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((begin, stop))
    return out


class _Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "genoloom_blocks"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _load(spark: SparkSession, files: list, kind: str, tasks: list[list[Span]]) -> DataFrame:
    spark.dataSource.register(_Source)
    spans = json.dumps([[[s.begin, s.stop, s.cut, s.open] for s in task] for task in tasks])
    return spark.read.format("genoloom_blocks").option("files", json.dumps(files)).option("kind", kind).option("tasks", spans).load()


def packed_lines(spark: SparkSession, path: str, kind: str, split: int = SPLIT) -> DataFrame:
    """Lines as of ``text.lines`` of a file (or folder of parts) that :func:`compression` says is of ``kind``; of blocks, in tasks of about ``split`` bytes."""
    files = listed(path)
    whole = Span(0, sum(n for _, n in files) << 16, open=False)
    return _load(spark, files, kind, [[s] for s in whole.parts(split)])


def lines_with_places(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """value (a carriage return stays), path, block (its split's first byte) and line (its first byte) of one plain file."""
    files = listed(path)
    total = files[0][1]
    cuts = list(range(0, max(total, 1), split))
    return _load(spark, files, "places", [[Span(a, min(a + split, total))] for a in cuts])


def index_of(path: str) -> Index | None:
    """The index beside a file, or of a folder of parts."""
    system, inner = opened(path)
    folder = system.get_file_info(inner).type == fs.FileType.Directory
    return read_index(f"{path.rstrip('/')}/index.tbi" if folder else f"{path}.tbi")


def region_lines(spark: SparkSession, path: str, index: Index, names: list[str], start: int | None = None, end: int | None = None, split: int = SPLIT) -> DataFrame:
    """Lines of the blocks that the index lists for a region; a superset of the region's own lines, without those of the header."""
    tasks: list[list[Span]] = []
    size = split
    for begin, stop in chunks_of(index, names, start or 1, end or 1 << 29):
        for span in Span(begin, stop).parts(split):
            held = (span.stop >> 16) - (span.begin >> 16)
            if tasks and size + held <= split:
                tasks[-1].append(span)
                size += held
            else:
                tasks.append([span])
                size = held
    return _load(spark, listed(path), "blocks", tasks) if tasks else spark.createDataFrame([], LINES)


def block(text: bytes, level: int = 6) -> bytes:
    """One block of at most 65,280 bytes of text."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = squeeze.compress(text) + squeeze.flush()
    if len(data) > 65_510:  # text that does not shrink is stored
        squeeze = zlib.compressobj(0, zlib.DEFLATED, -15)
        data = squeeze.compress(text) + squeeze.flush()
    return MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(text), len(text))


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str
    size: int
    lines: int
    names: list[str]
    bins: list[dict[int, list[list[int]]]]
    windows: list[dict[int, int]]


class _Cutter:
    """Cuts lines into blocks, at line ends where they fit, and notes each record's bin."""

    def __init__(self, out) -> None:
        self.out, self.text, self.held, self.at, self.lines = out, [], 0, 0, 0
        self.pending: list[tuple[str, int, int, int, int]] = []  # records that begin in the text held: name, first, last, from, to
        self.names: list[str] = []
        self.bins: list[dict[int, list[list[int]]]] = []
        self.windows: list[dict[int, int]] = []

    def add(self, line: bytes, name: str, first: int, last: int) -> None:
        if self.held and self.held + len(line) > BLOCK_TEXT:
            self.flush()
        self.pending.append((name, first, last, self.held, self.held + len(line)))
        self.text.append(line)
        self.held += len(line)
        self.lines += 1
        if self.held >= BLOCK_TEXT:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        text = b"".join(self.text)
        starts = []
        for a in range(0, len(text), BLOCK_TEXT):
            data = block(text[a : a + BLOCK_TEXT])
            self.out.write(data)
            starts.append(self.at)
            self.at += len(data)
        place = lambda x: self.at << 16 if x == len(text) else starts[x // BLOCK_TEXT] << 16 | x % BLOCK_TEXT
        for name, first, last, a, b in self.pending:
            if not self.names or self.names[-1] != name:
                self.names.append(name)
                self.bins.append({})
                self.windows.append({})
            begin, stop = place(a), place(b)
            chunks = self.bins[-1].setdefault(bin_of(first, last), [])
            if chunks and chunks[-1][1] >> 16 >= begin >> 16:
                chunks[-1][1] = stop
            else:
                chunks.append([begin, stop])
            for w in range(first >> 14, (last >> 14) + 1):
                self.windows[-1].setdefault(w, begin)
        self.text, self.held, self.pending = [], 0, []


class _Writer(DataSourceArrowWriter):
    """Rows (value, name, first, last: positions from 0) of sorted partitions -> parts of blocks, an index, header and end."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.header = options["path"].rstrip("/"), options["header"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        number = TaskContext.get().partitionId()
        system, inner = opened(f"{self.path}/_parts/{number:05d}-{uuid.uuid4().hex}")
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner, compression=None) as out:
            cut = _Cutter(out)
            for batch in iterator:
                for value, name, first, last in zip(*(batch.column(c).to_pylist() for c in ("value", "name", "first", "last")), strict=True):
                    cut.add(value.encode() + b"\n", name, first, max(first, last))
            cut.flush()
        return _Part(number, inner, cut.at, cut.lines, cut.names, cut.bins, cut.windows)

    def commit(self, messages: list[_Part | None]) -> None:
        """Place the parts one behind the other: moved to their names, their offsets raised by what stands before them."""
        system, folder = opened(self.path)
        text = self.header.encode()
        head = b"".join(block(text[a : a + BLOCK_TEXT]) for a in range(0, len(text), BLOCK_TEXT))
        parts = sorted((m for m in messages if m is not None and m.size), key=lambda m: m.number)
        index, base = Index(), len(head)
        with system.open_output_stream(f"{folder}/part-00000.gz", compression=None) as out:
            out.write(head)
        for k, part in enumerate(parts, 1):
            system.move(part.name, f"{folder}/part-{k:05d}.gz")
            for name, bins, windows in zip(part.names, part.bins, part.windows, strict=True):
                if not index.names or index.names[-1] != name:
                    if name in index.names:
                        raise ValueError(f"rows of {name} do not follow each other")
                    index.names.append(name)
                    index.bins.append({})
                    index.windows.append([])
                add = base << 16
                for number, chunks in bins.items():
                    own = index.bins[-1].setdefault(number, [])
                    own += [(b + add, e + add) for b, e in chunks]
                own = index.windows[-1]
                for w, begin in sorted(windows.items()):
                    while len(own) <= w:
                        own.append(own[-1] if own else 0)
                        if len(own) - 1 == w:
                            own[w] = begin + add
            base += part.size
        with system.open_output_stream(f"{folder}/part-{len(parts) + 1:05d}.gz", compression=None) as out:
            out.write(END)
        with system.open_output_stream(f"{folder}/index.tbi", compression=None) as out:
            out.write(index_bytes(index))
        self._clear(system, folder)

    def abort(self, messages: list[_Part | None]) -> None:
        self._clear(*opened(self.path))

    @staticmethod
    def _clear(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/_parts").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_parts")


def write_blocks_text(rows: DataFrame, path: str, header: str) -> None:
    """Write ``rows`` (value, name, first, last), sorted by name and first over their partitions, as a new folder of block-compressed parts with an index."""
    system, inner = opened(path)
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    system.create_dir(inner, recursive=True)
    rows.sparkSession.dataSource.register(_Source)
    kept = rows.selectExpr("value", "name", "cast(first as bigint) first", "cast(last as bigint) last")
    kept.write.format("genoloom_blocks").option("path", path).option("header", header).mode("append").save()


def joined(spark: SparkSession, folder: str, path: str) -> str:
    """One file (and its .tbi) of a folder that :func:`write_blocks_text` wrote; bytes are copied through Hadoop's file system, a buffer at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    copy = functools.partial(jvm.org.apache.hadoop.io.IOUtils.copyBytes)
    for sources, target in (([p for p, _ in listed(folder)], path), ([f"{folder.rstrip('/')}/index.tbi"], f"{path}.tbi")):
        out = at(target).getFileSystem(conf).create(at(target), False)
        try:
            for source in sources:
                stream = at(source).getFileSystem(conf).open(at(source))
                try:
                    copy(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()
    return path
