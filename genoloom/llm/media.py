"""AVI motion-JPEG columns: payloads as intra frames, RIFF index parsing, frame decoding, shot detection.

A payload is padded with spaces to a positive multiple of 192 bytes and cut into 16 x 12 frames of
8-bit samples, each stored as one lossless JPEG (T.81 process 14, first predictor) in an AVI file
with an ``idx1`` index. The Huffman table gives category s a code of 9 - s bits, so code and extra
bits of any difference take 9 bits and whole batches of frames pack and unpack as arrays; frames
with other tables are decoded bit by bit.

Shots: 16-bin luma histograms of neighbouring frames; a cut is a difference above the mean plus
three deviations of the differences in the 16 frames before it (and above a floor).

Null text is as empty text: one frame of spaces. Equal texts have equal values. Repeated rows and
null ids are rows of their own. An empty table gives no rows. Sizes in a RIFF file have 32 bits:
a text whose file would pass 4 GiB ends the job with an error, it is not cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, bytes_of, documents, slices

WIDTH, HEIGHT, UNIT, RATE = 16, 12, 192, 25
_DIFF = np.arange(-255, 256)
_SSSS = np.array([int(abs(d)).bit_length() for d in _DIFF])


def _codes() -> np.ndarray:
    """9-bit string of each difference -255..255: 8 - s ones and a zero, or 9 ones less the last for s = 0; then s extra bits."""
    out = np.zeros(511, np.uint16)
    for i, d in enumerate(_DIFF.tolist()):
        s = int(_SSSS[i])
        prefix = ((1 << (8 - s)) - 1) << 1  # 9 - s bits
        out[i] = prefix << s | ((d if d > 0 else d + (1 << s) - 1) if s else 0)
    return out


_CODE = _codes()
_BACK = np.zeros(512, np.int16)
_BACK[_CODE] = _DIFF
#: Segments before a frame's data: SOI, DHT (categories 8 to 0 at 1 to 9 bits), SOF3, SOS (predictor 1).
HEAD = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB16B", 2 + 17 + 9, 0, *([1] * 9 + [0] * 7)) + bytes(range(8, -1, -1))
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)


def pad(raw: bytes) -> bytes:
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of (n, HEIGHT, WIDTH) uint8 frames."""
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    code = _CODE[diff.reshape(len(x), -1, 8) + 255].astype(np.uint32)
    packed = np.empty((len(x), code.shape[1], 9), np.uint8)
    for k in range(9):  # byte k holds bits 8k..8k+7 of eight 9-bit strings
        a = 8 * k // 9
        two = code[:, :, a] << 9 | (code[:, :, a + 1] if a < 7 else 0)
        packed[:, :, k] = two >> (18 - 8 - (8 * k - 9 * a)) & 0xFF
    flat = packed.reshape(len(x), -1).tobytes()
    size = code.shape[1] * 9
    return [HEAD + flat[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(flat), size)]


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file with one MJPG stream and an idx1 index."""
    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)

    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def read_index(avi: bytes) -> tuple[float, list[tuple[int, int]]]:
    """(seconds a frame, (offset, size) of each frame's data) from the RIFF lists and the idx1 index."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, seconds = 12, min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0]), None, b"", 0.0
    while at + 8 <= end:
        name, (size,) = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and avi[at + 8 : at + 12] == b"hdrl":
            seconds = struct.unpack_from("<I", avi, at + 20)[0] / 1e6
        elif name == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    rows = np.frombuffer(index, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    rows = rows[np.char.endswith(rows["id"], b"dc")] if len(rows) else rows
    base = movi if len(rows) and avi[movi + int(rows["at"][0]) : movi + int(rows["at"][0]) + 4] == rows["id"][0] else 0
    return seconds, [(base + int(a) + 8, int(s)) for a, s in zip(rows["at"], rows["size"], strict=True)]


def _tables(jpeg: bytes) -> tuple[int, int, dict[tuple[int, int], int], int]:
    """(rows, columns, {(length, code): category}, start of data) of a lossless JPEG."""
    at, size, codes = 2, (0, 0), {}
    while True:
        mark, (n,) = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)
        part = jpeg[at + 4 : at + 2 + n]
        if mark == 0xC4:
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(part[length]):
                    codes[length, code] = part[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif mark == 0xC3:
            size = struct.unpack_from(">HH", part, 1)
        elif mark == 0xDA:
            if part[3] != 1:
                raise ValueError("only predictor 1")
            return *size, codes, at + 2 + n
        at += 2 + n


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(n, rows, columns) samples of lossless JPEG frames of one size."""
    if not frames:
        return np.zeros((0, HEIGHT, WIDTH), np.uint8)
    if all(f.startswith(HEAD) for f in frames):
        flat = np.frombuffer(b"".join([f[len(HEAD) : -2].replace(b"\xff\x00", b"\xff") for f in frames]), np.uint8)
        groups = flat.reshape(len(frames), -1, 9).astype(np.uint32)
        code = np.empty((*groups.shape[:2], 8), np.uint16)
        for k in range(8):  # string k starts at bit 9k: bit k of byte k
            code[:, :, k] = (groups[:, :, k] << 8 | groups[:, :, k + 1]) >> (7 - k) & 0x1FF
        diff = _BACK[code].reshape(len(frames), HEIGHT, WIDTH).astype(np.int64)
    else:
        diff = np.stack([_decode_bits(f) for f in frames])
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return (np.cumsum(diff, axis=2) & 0xFF).astype(np.uint8)


def _decode_bits(jpeg: bytes) -> np.ndarray:
    rows, columns, codes, at = _tables(jpeg)
    bits = np.unpackbits(np.frombuffer(jpeg[at : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
    out, p = [], 0
    for _ in range(rows * columns):
        code = length = 0
        while (length, code) not in codes or not length:
            code, length, p = code << 1 | bits[p], length + 1, p + 1
        s, v = codes[length, code], 0
        for _ in range(s):
            v, p = v << 1 | bits[p], p + 1
        out.append(v if not s or v >> (s - 1) else v - (1 << s) + 1)
    return np.array(out, np.int64).reshape(rows, columns)


def shots(frames: np.ndarray, back: int = 16, floor: float = 0.5) -> list[int]:
    """First frames of the shots after the first."""
    if len(frames) < 2:
        return []
    bins = (frames.reshape(len(frames), -1) >> 4).astype(np.int64) + 16 * np.arange(len(frames))[:, None]
    hist = np.bincount(bins.ravel(), minlength=16 * len(frames)).reshape(-1, 16)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * frames[0].size)
    sums, squares = (np.concatenate(([0.0], np.cumsum(v))) for v in (d, d * d))
    i = np.arange(len(d))
    a = np.maximum(i - back, 0)
    n = np.maximum(i - a, 1)
    mean = (sums[i] - sums[a]) / n
    dev = np.sqrt(np.maximum((squares[i] - squares[a]) / n - mean**2, 0))
    return (np.flatnonzero(d > np.maximum(mean + 3 * dev, floor)) + 1).tolist()


def clips(avi: bytes) -> list[tuple[float, float, int, int]]:
    """(start second, end second, first frame, end frame) of each shot of an AVI file."""
    seconds, index = read_index(avi)
    frames = decode_frames([avi[a : a + n] for a, n in index])
    edge = [0, *shots(frames), len(frames)]
    return [(a * seconds, b * seconds, a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)] if len(frames) else []


def _clip_rows(column: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20, column):
            row, found, errors = [], [], []
            for i, avi in enumerate(batch.column(column).to_pylist()):
                try:
                    some, error = [(k, *c) for k, c in enumerate(clips(avi or b""))], None
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    some, error = [], f"{type(e).__name__}: {e}"
                some = some or [(None,) * 5]
                row += [i] * len(some)
                found += some
                errors += [error] * len(some)
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds]
            own = batch.select(keep).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *cols, pa.array(errors, pa.string())], [*keep, *CLIP])

    return run


CLIP = ["clip", "start_s", "end_s", "first_frame", "end_frame", "error"]


def clip_rows(media: DataFrame, column: str = "avi") -> DataFrame:
    """One row a clip of the AVI file in ``column``: the other columns, clip from 0, start and end in seconds, frames first..end-1, error.

    Null, empty or unreadable files, and those without frames, give one row without a clip; error tells why a file can't be read.
    Other columns may have any names but ``clip`` and so on are added after them. A task holds the frames of one file at a time.
    """
    rows = bounded_batches(media).select(*[F.col(f"`{c}`") for c in media.columns if c != column], F.col(f"`{column}`"))
    kept = [f"c{i}" for i in range(len(rows.columns) - 1)]
    plain_rows = rows.toDF(*kept, "media")
    own = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain_rows.schema if f.name != "media")
    out = plain_rows.mapInArrow(_clip_rows("media", kept), f"{own}clip int, start_s double, end_s double, first_frame long, end_frame long, error string")
    return out.toDF(*rows.columns[:-1], *CLIP)


def store(raw: bytes) -> bytes:
    """The AVI file that holds ``raw`` padded."""
    return write_avi(encode_frames(np.frombuffer(pad(raw), np.uint8).reshape(-1, HEIGHT, WIDTH)))


def describe(raw: bytes) -> tuple[int, int, str, int, int, str, str]:
    avi = store(raw)
    seconds, index = read_index(avi)
    frames = decode_frames([avi[a : a + n] for a, n in index])
    payload = frames.tobytes()
    cuts = shots(frames)
    feature = f"frames={len(frames)};luma={frames.mean():.4f};shots={len(cuts) + 1};clips=" + ",".join(f"{c * seconds:.2f}" for c in [0, *cuts])
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(avi), hashlib.sha256(avi).hexdigest(), feature


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = [describe(t or b"") for t in bytes_of(batch.column("text"))]
        cols = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])


def media_columns(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(_describe, out)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
