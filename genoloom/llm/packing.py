"""Packing of tokenized documents into sequences by shortest-pack-first over the histogram of lengths.

A document's ids are cut into whole sequences of ``size`` ids and a rest. Only the histogram of the rests' lengths (at most size - 1
numbers) comes to the driver. Lengths are placed longest first, each into the pack with the most room, as counts of packing patterns; patterns are then
joined back to documents by the rank of a rest among those of its length. Patterns left with more than ``slack`` ids of room, their sum no power of
two, are opened: their packs' ids run on in one stream that is cut into whole sequences, whose last, incomplete one is cut into powers of two.
So padding is ``slack`` ids a closed pack at most.

Ranks need no sort: every task numbers its own rests by length while it tokenizes, and counts by (length, task) add up to first ranks.
Ids are stored once, two bytes each where the vocabulary allows, and a text is tokenized once: by the tokenizer itself for every distinct
word that a worker meets, whose ids it keeps (``KEPT`` words at most). Words end at ASCII white space, which no token of the tokenizer crosses.

Null text counts as empty: it has the end id alone. Null or repeated doc_ids and repeated rows count as rows of their own. White space alone: the end id alone.
A long text is tokenized word by word, so beside its bytes and ids only its longest word takes memory. Which of two equal lengths goes into which pack
follows the order of the stored rows. Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, bytes_of, documents, materialize, slices, trim

KEPT = 1_000_000
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile("[a-zß-öø-ÿ]+")  # words of one letter run that lower-casing and composition leave alone


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Known(dict):
    """Word -> bytes of its ids, found when first asked for."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        head = "".join(self.tokenizer.to_str()[:4000].split())
        self.lower = '"type":"Lowercase"' in head
        self.direct = self.lower and '"type":"ByteLevel","add_prefix_space":false' in head
        self.letters = [x for _, x in sorted(byte_letters().items())]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        if self.lower:  # ASCII capitals made small and one mark taken off behind a small letter, as the tokenizer does both
            small = word.lower()
            if len(small) > 1 and small[-1] in b".,;:!?" and small[-2] in LETTERS:
                found = self[small[:-1]] + self[small[-1:]]
            elif small != word:
                found = self[small]
            else:
                found = self._encoded(word)
        else:
            found = self._encoded(word)
        self[word] = found
        return found

    def _encoded(self, word: bytes) -> bytes:
        text = word.decode()
        if self.direct and PLAIN.fullmatch(low := text.lower()):  # one run of letters: straight to the merges
            letters = self.letters
            spelled = low if low.isascii() else "".join([letters[b] for b in low.encode()])
            return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Words:
    """Ids of texts, word by word."""

    def __init__(self, path: str) -> None:
        self.known = Known(path)
        self.tokenizer, self.kind = self.known.tokenizer, np.uint16 if self.known.code == "H" else np.uint32

    def __call__(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.split())), self.kind)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Words:
    return Words(path)


def _tokenized(path: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = tokenizer(path), TaskContext.get().partitionId()
        last = np.array([end], ids_of.kind).tobytes()
        rank = np.zeros(size + 1, np.int64)  # rests of each length so far; whole sequences under ``size``
        for batch in slices(batches, 1 << 20):
            ids = [ids_of(t or b"").tobytes() + last for t in bytes_of(batch.column("text"))]
            n = np.array([len(x) for x in ids], np.int64) // ids_of.kind().itemsize
            rest, whole = n % size, n // size
            ranks, first = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for i, (r, w) in enumerate(zip(rest.tolist(), whole.tolist(), strict=True)):
                ranks[i], first[i] = rank[r], rank[size]
                rank[r] += 1
                rank[size] += w
            cols = [batch.column("doc_id"), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(np.full(len(n), task, np.int64)), pa.array(ranks), pa.array(first), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "rest", "task", "rank", "first", "ids"])
        trim()

    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Patterns (packs, room, [(length, times), ...]) that hold every length of ``histogram`` (length -> count) as often as it says.

    Longest lengths first; each goes into the pack with the most room, or a new one where none has enough. Packs of one pattern move together, so steps
    follow the number of lengths and patterns, not of documents.
    """
    heap: list[tuple[int, int, int, tuple]] = []  # (-room, number, packs, chain of runs)
    serial = 0

    def push(room: int, packs: int, runs: tuple) -> None:
        nonlocal serial
        heapq.heappush(heap, (-room, serial, packs, runs))
        serial += 1

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            if heap and -heap[0][0] >= length:
                room, _, packs, runs = heapq.heappop(heap)
                m = min(n, packs)
                if m < packs:
                    push(-room, packs - m, runs)
                head, *chain = runs
                grown = ((length, head[1] + 1), *chain) if head[0] == length else ((length, 1), *runs)
                push(-room - length, m, grown)
                n -= m
            else:  # a new pack takes this length until it is full: it has the most room until then
                k = size // length
                if n >= k:
                    push(size - k * length, n // k, ((length, k),))
                if n % k:
                    push(size - n % k * length, 1, ((length, n % k),))
                n = 0
    return [(packs, -room, list(reversed(runs))) for room, _, packs, runs in sorted(heap)]


def _layout(histogram: dict[int, int], whole: int, size: int, slack: int) -> dict:
    """Where the rests go, as arrays over slots sorted by (length, first rank): pattern's base, packs, ids a pack, opened or not, offset and times."""
    taken = dict.fromkeys(histogram, 0)
    slots, sequence, stream = [], whole, 0
    for packs, room, runs in shortest_pack_first(histogram, size):
        used = size - room
        opened = room > slack and used & (used - 1) != 0
        base, offset = (stream if opened else sequence), 0
        for length, times in runs:
            slots.append((length, taken[length], base, used, int(opened), offset, times))
            taken[length] += packs * times
            offset += length * times
        if opened:
            stream += packs * used
        else:
            sequence += packs
    table = np.array(sorted(slots), np.int64).reshape(-1, 7)
    return {"slots": table, "keys": table[:, 0] << 44 | table[:, 1], "first": sequence, "stream": stream, "size": size}


def _stream(at: int, length: int, layout: dict) -> list[tuple[int, int, int]]:
    """(length, sequence, offset) of what the stream's ids at..at+length-1 are cut into."""
    size, out = layout["size"], []
    whole = layout["stream"] // size
    while length:
        k, offset = divmod(at, size)
        if k < whole:
            sequence, room = layout["first"] + k, size - offset
        else:  # the last ids: one sequence a power of two, largest first
            tail, sequence = layout["stream"] - whole * size, layout["first"] + whole
            while offset >= (power := 1 << (tail.bit_length() - 1)):
                offset, tail, sequence = offset - power, tail - power, sequence + 1
            room = power - offset
        m = min(room, length)
        out.append((m, sequence, offset))
        at, length = at + m, length - m
    return out


def _placed(sent, kind_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = sent.value
        size, slots, keys = layout["size"], layout["slots"], layout["keys"]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in slices(batches, 1 << 20, "ids"):
            n, rest, rank, first = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "rest", "rank", "first"))
            which = np.maximum(np.searchsorted(keys, rest << 44 | rank, side="right") - 1, 0)
            rows, pieces = [], []
            for i, ids in enumerate(batch.column("ids")):
                raw, whole = ids.as_buffer(), int(n[i] // size)
                cuts = [(size, int(first[i]) + k, 0) for k in range(whole)]
                if rest[i]:
                    length, least, base, used, opened, offset, times = slots[which[i]].tolist()
                    pack, k = divmod(int(rank[i]) - least, times)
                    offset += k * length
                    cuts += _stream(base + pack * used + offset, length, layout) if opened else [(length, base + pack, offset)]
                at = 0
                for length, sequence, offset in cuts:
                    part = memoryview(raw)[at * kind_bytes : (at + length) * kind_bytes]
                    pieces.append(np.frombuffer(part, np.uint16 if kind_bytes == 2 else np.uint32).astype("<u4").tobytes())
                    rows.append((i, at, length, int(n[i]), sequence, offset))
                    at += length
                if len(pieces) >= 1024:
                    yield _batch(batch, rows, pieces, names)
                    rows, pieces = [], []
            if rows:
                yield _batch(batch, rows, pieces, names)
        trim()

    return run


def _batch(batch: pa.RecordBatch, rows: list, pieces: list, names: list[str]) -> pa.RecordBatch:
    i, start, length, n, sequence, offset = np.array(rows, np.int64).T
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(i)), pa.array(start), pa.array(length), pa.array(pieces, pa.binary()), pa.array(n), pa.array(sequence), pa.array(offset)], names)


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 1, slack: int = 16) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces of ``docs`` (doc_id, text), each with its ids as little-endian unsigned 32-bit numbers.

    ``path``: tokenizer file, which every executor has. ``end``: id behind every document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = bounded_batches(docs.select("doc_id", "text")).mapInArrow(_tokenized(path, end, size), f"doc_id {kind}, n long, rest int, task long, rank long, first long, ids binary")
    stored = materialize(made, "tokens")
    counts = stored.where("rest > 0").groupBy("task", F.col("rest").alias("length")).agg(F.count("*").alias("c"))
    counts = counts.unionByName(stored.groupBy("task").agg(F.sum(F.expr(f"n div {size}")).alias("c")).select("task", F.lit(size).alias("length"), "c"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    counts = materialize(counts.withColumn("off", F.coalesce(F.sum("c").over(before), F.lit(0))), "counts")
    total = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most ``size`` rows
    whole = total.pop(size, 0)
    layout = docs.sparkSession.sparkContext.broadcast(_layout(total, whole, size, slack))
    offs = counts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "off"))).alias("offs"))  # at most ``size`` entries a task
    found = stored.join(offs, "task").select(
        "doc_id", "n", "rest", (F.col("rank") + F.coalesce(F.element_at("offs", F.col("rest")), F.lit(0))).alias("rank"), (F.col("first") + F.element_at("offs", F.lit(size))).alias("first"), "ids"
    )
    kind_bytes = tokenizer(path).kind().itemsize
    return bounded_batches(found).mapInArrow(_placed(layout, kind_bytes), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
