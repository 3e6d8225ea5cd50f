"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text parses a document greedily into phrases, the
longest strings that occur in that text; the language that needs the fewest phrases, each weighed by
the bits that name a place in its text, wins. The automata are flattened into tables of next state
and phrases closed, so one gather advances every lane of a batch by one byte. Lanes are 1,024-byte
pieces of normalised texts, parsed side by side from the root; then each lane is followed again from
the state in which the one before it ended, up to the byte where both parses meet, mostly a few phrases on.
So the counts are those of one parse of the whole text.

The automata are fitted on a bounded sample of labelled rows, whole texts by order of a hash of the id:
at most ``rows`` of a language, longer ones than ``train_bytes`` last, until those taken hold ``train_bytes``. Predictions cover every row.

A text is ``foreign`` if even the language that wins closes a phrase at more than every second byte:
no learned language shares so much as its byte pairs. The prediction stands, but a pipeline may reject it.

Null texts and texts without a letter are ``und`` with score 0. Null ids are never learned from and
count as not held out. Without labelled rows every text is ``und``. Ties go to the language first in
order. Repeated rows agree. Score: cost of the second-best over both costs (0.5 to 1; 1 with one language).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, documents, plain, release, slices, trim

WORDLIKE = re.compile(r"[^\W\d_]")
LANE = 1024
#: All ASCII but letters reads as a space.
NORMAL = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is of one of Unicode's letter categories; signs such as a raised 2 or a Roman numeral are numbers."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(NORMAL).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


def _carried(table: memoryview, width: int, lane: bytes, come: int) -> tuple[int, int]:
    """Phrases closed in ``lane`` by a parse that comes in state ``come``, less those from the root, and its last state (-1: as from the root)."""
    a, b, more = 0, come, 0
    for c in lane:
        if a == b:
            return more, -1
        u, v = table[a * width + c], table[b * width + c]
        a, b, more = u >> 2, v >> 2, more + (v & 3) - (u & 3)
    return more, b


class Model:
    """Flat parse tables of each language over a common byte alphabet (symbol 0: never seen)."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(k for k, v in texts.items() if v)
        seen = sorted(set(b"".join(texts.values())))
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.bits, self.tables = [], []
        for lang in self.langs:
            nxt = suffix_automaton(texts[lang])
            root = np.full(self.width, 1, np.int32)  # an unseen symbol is a phrase: to the root, one phrase
            for c, s in nxt[0].items():
                root[self.symbol[c]] = s << 2
            # elsewhere a symbol that doesn't go on closes a phrase and starts anew at the root
            table = np.tile(root + 1, (len(nxt), 1))
            table[0] = root
            for s, moves in enumerate(nxt[1:], 1):
                for c, to in moves.items():
                    table[s, self.symbol[c]] = to << 2
            self.tables.append(table.ravel())
            self.bits.append(float(np.log2(len(texts[lang]) + 1)))

    def costs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language): bits a byte, and phrases closed before the text's end a byte."""
        size = np.array([len(t) for t in texts], np.int64)
        lanes = np.maximum(-(-size // LANE), 0)
        owner = np.repeat(np.arange(len(texts)), lanes)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = (np.cumsum(size) - size)[owner] + part * LANE
        length = np.minimum(size[owner] - part * LANE, LANE)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        data = np.concatenate([self.symbol[np.frombuffer(b"".join(texts), np.uint8)], np.zeros(1, np.uint8)])
        out, closed = np.zeros((2, len(texts), len(self.langs)))
        if not len(owner):
            return out, closed
        phrases = [np.zeros(len(owner), np.int64) for _ in self.langs]
        state = [np.zeros(len(owner), np.int64) for _ in self.langs]
        alive = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for t in range(int(length[0])):
            n = int(alive[t])
            column = data[start[:n] + t].astype(np.int64)
            for k, table in enumerate(self.tables):
                v = table[state[k][:n] * self.width + column]
                state[k][:n] = v >> 2
                phrases[k][:n] += v & 3
        place = np.empty(len(order), np.int64)  # of each lane, in the order of the texts
        place[order] = np.arange(len(order))
        raw, later = data.tobytes(), np.flatnonzero(part).tolist()
        for k, bits in enumerate(self.bits):
            table, end, more = memoryview(self.tables[k]), state[k][place].tolist(), np.zeros(len(order), np.int64)
            for lane in later:
                if end[lane - 1]:
                    at = int(start[place[lane]])
                    more[lane], last = _carried(table, self.width, raw[at : at + int(length[place[lane]])], end[lane - 1])
                    if last >= 0:
                        end[lane] = last
            n = np.bincount(owner, phrases[k] + more[order], len(texts))
            out[:, k] = (n + (size > 0)) * bits / np.maximum(size, 1)
            closed[:, k] = n / np.maximum(size, 1)
        return out, closed


def fit(docs: DataFrame, labelled, rows: int = 96, train_bytes: int = 1 << 16) -> Model:
    """``labelled``: the condition of rows that may be learned from."""
    known = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one count a language, as the model has one text a language: a filter of literals, so only sampled rows are shuffled
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, 2.0 * rows / n)])
    dice = (F.xxhash64("doc_id", F.lit(5)).bitwiseAND((1 << 53) - 1) / float(1 << 53)).alias("dice")
    some = known.where(dice < F.element_at(share, F.col("lang"))).select("lang", "text", dice, F.octet_length("text").cast("long").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.col("size") > train_bytes, "dice", F.xxhash64("text"), "text")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumns({"k": F.row_number().over(order), "before": before}).where((F.col("k") <= rows) & (F.col("before") < train_bytes))
    texts: dict[str, list[bytes]] = {}
    for r in some.orderBy("lang", "k").collect():
        texts.setdefault(r.lang, []).append(normal(r.text))
    model = Model({k: b" ".join(v) for k, v in texts.items()})
    release(docs.sparkSession)
    return model


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches, 1 << 22):
            texts = batch.column("text").to_pylist()
            lang, score, foreign = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            some = [i for i, t in enumerate(texts) if t and m.langs and has_letter(t)]
            if some:
                cost, closed = m.costs([normal(texts[i]) for i in some])
                best = cost.argmin(axis=1)
                two = np.sort(cost, axis=1)[:, :2]
                sure = two[:, 1] / np.maximum(two.sum(axis=1), 1e-12) if len(m.langs) > 1 else np.ones(len(some))
                for j, (i, b, s) in enumerate(zip(some, best, sure, strict=True)):
                    lang[i] = m.langs[b]
                    score[i] = s
                    foreign[i] = closed[j, b] > 0.5
            keep = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score), pa.array(foreign)], [*batch.schema.names, "lang_pred", "score", "foreign"])
        trim()

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (no column of which may be named so) with lang_pred, score and foreign."""
    rows = plain(bounded_batches(docs), "text")
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"{own}, lang_pred string, score double, foreign boolean")
    return out.toDF(*docs.columns, "lang_pred", "score", "foreign")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose language can't be told (und) or that are foreign to all learned ones; columns of any names."""
    rows = plain(docs, "text")
    return predict(rows, model).where("lang_pred <> 'und' and not foreign").select(*rows.columns).toDF(*docs.columns)


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, fold(3) != 1)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
