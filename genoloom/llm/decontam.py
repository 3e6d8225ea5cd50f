"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered. A window is 10
consecutive words of an item; an item of fewer words is one window. The automaton, built from the
items' word ids, streams a document's words and tracks the longest match that ends at each: a match
of 10 or more is made of windows only, and a short item is a window where its state is on the
suffix path. A word inside any occurrence is hit.

Items are dealt by hash into parts of about ``part_words`` words, so that any number of items fits:
each part's automaton is built and broadcast on its own (its size is bounded by ``part_words`` and
one item), and a document is held against the parts one after the other; hits are united.

Null or empty texts have no words, no hits. Items without words have no window. Items of equal text
both count; rows of one item_id are one item, and a null item_id reads "null". Repeated rows are rows of their own. An empty benchmark
hits nothing; an empty table gives no rows. Nothing is chosen among equals, so ties don't arise: every occurrence of every window counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, bytes_of, documents, materialize, plain, slices, trim

#: ASCII letters lowered, digits and bytes from 0x80 on as they are, all else a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton of (item id, words): longest matches and the windows in them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[int]] = [set()]  # items by state, at first where a prefix of theirs ends
        self.names = [name for name, w in items if w]
        texts = [[self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w] for _, w in items if w]
        for item, text in enumerate(texts):
            last = 0
            for x in text:
                last = self._extend(last, x)
                while len(ends) < len(self.len):
                    ends.append(set())
                ends[last].add(item)
        while len(ends) < len(self.len):
            ends.append(set())
        short: dict[tuple[int, int], set[int]] = {}  # (state, length) of short items: a state may hold several lengths
        self.items: dict[int, frozenset[int]] = {}
        for item, text in enumerate(texts):
            if len(text) < window:
                state = 0
                for x in text:
                    state = self.next[state][x]
                short.setdefault((state, len(text)), set()).add(item)
        at_state: dict[int, list[int]] = {}
        for state, n in short:
            at_state.setdefault(state, []).append(n)
        order = sorted(range(1, len(self.len)), key=lambda s: -self.len[s])
        for s in order:
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        # of each state: the state of its suffix of ``window`` words, if it has one; the short items on its suffix path
        self.at_window = [-1] * len(self.len)
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        for s in reversed(order):
            up = self.link[s]
            if self.len[s] >= window:
                self.at_window[s] = s if self.len[up] < window else self.at_window[up]
            self.shorts[s] = self.shorts[up] + tuple((s, n) for n in at_state.get(s, ()))
        for s in set(self.at_window) - {-1}:
            self.items[s] = frozenset(i for i in ends[s] if len(texts[i]) >= window)
        self.whole = {k: frozenset(x) for k, x in short.items()}
        self.least = min([window, *map(len, texts)]) if texts else 0

    def _new(self, length: int, link: int, trans: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(trans)
        return len(self.len) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        """The state of p's strings followed by x, cut off from q where q holds longer ones."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x, self.next[last][x])
        new, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, x, self.next[p][x])
        return new

    def scan(self, text: list[bytes], hit: np.ndarray) -> set[str]:
        """Marks the words of ``text`` in windows' occurrences; returns the items whose windows occur."""
        if not self.names or len(text) < self.least:
            return set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in text), np.int64, len(text))
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        found: set[int] = set()
        window, nxt, link, length = self.window, self.next, self.link, self.len
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            s = n = 0
            for i, x in enumerate(ids[a:b].tolist(), a + 1):
                while s and x not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if x in nxt[s]:
                    s = nxt[s][x]
                    n += 1
                else:
                    n = 0
                if n >= window:
                    hit[i - n : i] = True
                    found |= self.items[self.at_window[s]]
                if self.shorts[s]:
                    for state, k in self.shorts[s]:
                        if k <= n:
                            hit[i - k : i] = True
                            found |= self.whole[state, k]
        return {self.names[i] for i in found}


def automata(benchmark: DataFrame, window: int = 10, part_words: int = 1 << 17) -> list:
    """Broadcast automata of the parts of ``benchmark`` (item_id, text)."""
    sc = benchmark.sparkSession.sparkContext
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // (part_words * 4)  # words and their gaps take over 4 bytes on average, or parts are the smaller
    out = []
    items = benchmark.select("item_id", "text").withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    if n > 1:  # each part is read from its own files
        items = materialize(items.repartition("part").sortWithinPartitions("part"), "items")
    for part in range(n):
        rows = items.where(F.col("part") == part).select(F.col("item_id").cast("string"), "text").collect()
        out.append(sc.broadcast(Automaton([("null" if r[0] is None else r[0], words((r[1] or "").encode())) for r in rows], window)))
    return out


def _hits(parts: list):
    """Per row: its columns, counts, items and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            out = []
            texts = [words(t) for t in bytes_of(batch.column("text"))]
            hits = [np.zeros(len(t), bool) for t in texts]
            items: list[set[str]] = [set() for _ in texts]
            for part in parts:
                automaton = part.value
                for i, t in enumerate(texts):
                    items[i] |= automaton.scan(t, hits[i])
                if len(parts) > 2:  # the worker keeps one part at a time; the next texts load it again
                    automaton = None
                    part.__dict__.pop("_value", None)
            for t, h, names in zip(texts, hits, items, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], h.view(np.int8), [0]))))
                out.append((len(t), int(h.sum()), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            keep = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(keep + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], batch.schema.names + ["n_words", "n_hit", "n_items", "items_sha256", "spans"])
        trim()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_words: int = 1 << 17) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and spans (word numbers first..end-1 of maximal hit runs)."""
    add = "n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<first:long,end:long>>"
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return bounded_batches(docs).mapInArrow(_hits(automata(benchmark, window, part_words)), f"{own}, {add}")


def _without_spans(text: str | None, spans) -> str | None:
    """``text`` without its hit words (each up to the next kept word)."""
    if text is None or not len(spans):
        return text
    raw = text.encode()
    flat = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts = np.append(edge[::2], len(raw))
    out, at = [], 0
    for s in spans:
        out.append(raw[at : starts[s["first"]]])
        at = int(starts[s["end"]])
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_hit: int = 0, most_share: float = 0.0) -> DataFrame:
    """``docs`` without documents of over ``most_hit`` hit words or over ``most_share`` of their words hit; what is hit in kept ones is cut out."""
    rows = plain(docs, "text")
    marked = contamination(rows, benchmark, window)
    kept = marked.where((F.col("n_hit") <= most_hit) & (F.col("n_hit") <= F.col("n_words") * F.lit(most_share)))
    if most_hit and most_share:
        cut = F.udf(_without_spans, "string")
        kept = kept.withColumn("text", F.when(F.col("n_hit") > 0, cut("text", "spans")).otherwise(F.col("text")))
    return kept.select(*rows.columns).toDF(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


#: The query's rows in DuckDB's SQL: windows of items and of documents as joined words, equal ones found by a join.
ORACLE_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda k: array_to_string(w[k:k + least(len(w), 10) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
pos AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: {'k': k, 's': array_to_string(w[k:k + m - 1], ' ')}), recursive := true) FROM d, (SELECT DISTINCT m FROM win) x WHERE len(w) >= m),
found AS (SELECT doc_id, item_id, m, k FROM pos JOIN win USING (m, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT doc_id, m, k FROM found) x) y GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM found) x GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)"""
