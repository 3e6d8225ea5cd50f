"""Quality scoring by a generalised additive model with pairwise interactions.

Cyclic boosting: in every round each feature in turn gets a shallow tree on its bins (two cuts,
three leaves), fitted to the logistic gradient and added to the feature's lookup table. Then the
pairs of features whose 8 x 8 grids explain most of what is left get tables of their own by boosted
trees of one cut an axis. A score is the sum of one table value per feature and pair, through the
logistic function.

Fitted on a bounded sample of labelled rows (``rows``, by hash of the id over all of them) outside
the held-out fold; scored for every row. Inputs are measures of the whole text alone.

Null and empty texts get the features of an empty text and a score like any other. Null ids are
never learned from and count as not held out. With no labels at all every score is 0.5. Several
labels of one id are learned as rows of their own. Repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import bounded_batches, bytes_of, documents, materialize

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "space", "non_ascii", "periods", "commas", "marks", "symbols",
    "distinct", "top_word", "short_words", "long_words", "lines", "repeated_lines", "line_length", "capital_words", "ended_lines", "mixed_words", "repeated_pairs", "longest_word",
)
_CLASS = np.zeros(256, np.uint8)
for _name, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 10, 11, 12, 13), range(128, 256), b".", b",", b"!?;:'\"()-"), 1):
    _CLASS[list(_members)] = _name


def features(text: bytes | None) -> list[float]:
    """The measures of FEATURES of a UTF-8 text."""
    raw = text or b""
    n = max(len(raw), 1)
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / n
    words = raw.split()
    w = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(sizes.mean()), float(c[1] + c[2]), float(c[1]), float(c[3]), float(c[4]), float(c[5]), float(c[6]), float(c[7]), float(c[8]), float(c[0]),
        len(counts) / w, max(counts.values(), default=0) / w, float((sizes <= 3).mean()), float((sizes >= 10).mean()), m / w, 1 - len(set(lines)) / m, float(np.log1p(len(raw) / m)),
        sum(65 <= x[0] <= 90 for x in words) / w, sum(x.rstrip()[-1:] in b".!?" for x in lines) / m, sum(not x.strip(b".,!?;:").isalpha() and x < b"\x80" for x in words) / w, 1 - (pairs + 1) / w if len(words) > 1 else 0.0, float(np.log1p(sizes.max())),
    ]


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values a bin of the best tree of two cuts on binned gradient and curvature sums."""
    def cut(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        x, y = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gain = x**2 / (y + 1) + (g[a:b].sum() - x) ** 2 / (h[a:b].sum() - y + 1) - g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    edge = [0, len(g)]
    for _ in range(2):
        gain, at = max(cut(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True))
        if gain <= 0:
            break
        edge = sorted({*edge, at})
    out = np.empty(len(g))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree with one cut on each axis of a grid."""
    G, H = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    n, m = g.shape
    best, where = -1.0, (0, 0)
    total = lambda x, a, b, c, d: x[b, d] - x[a, d] - x[b, c] + x[a, c]
    base = G[-1, -1] ** 2 / (H[-1, -1] + 1)
    for i in range(1, n):
        for j in range(1, m):
            gain = sum(total(G, *q) ** 2 / (total(H, *q) + 1) for q in ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m))) - base
            if gain > best:
                best, where = gain, (i, j)
    i, j = where
    out = np.empty((n, m))
    for a, b, c, d in ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)):
        if b > a and d > c:
            out[a:b, c:d] = _leaf(total(G, a, b, c, d), total(H, a, b, c, d))
    return best, out


class Gam:
    """Lookup tables of features and of pairs of features."""

    def __init__(self, bins: int = 32, rounds: int = 60, rate: float = 0.1, pairs: int = 6, pair_rounds: int = 20, grid: int = 8):
        self.bins, self.rounds, self.rate, self.n_pairs, self.pair_rounds, self.grid = bins, rounds, rate, pairs, pair_rounds, grid
        self.edges: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        if not len(x):
            return self
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        q = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n))
        self.edges = [q(v, self.bins) for v in x.T]
        self.coarse = [q(v, self.grid) for v in x.T]
        at = [np.searchsorted(e, v, side="right") for e, v in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.base)
        slope = lambda: (y - (p := 1 / (1 + np.exp(-f))), p * (1 - p))
        for _ in range(self.rounds):
            for k, i in enumerate(at):
                g, h = slope()
                n = len(self.tables[k])
                step = self.rate * _tree(np.bincount(i, g, n), np.bincount(i, h, n))
                self.tables[k] += step
                f += step[i]
        small = [np.searchsorted(e, v, side="right") for e, v in zip(self.coarse, x.T, strict=True)]
        size = [len(e) + 1 for e in self.coarse]

        def grids(a: int, b: int) -> tuple[float, np.ndarray]:
            cell = small[a] * size[b] + small[b]
            return _grid_tree(*(np.bincount(cell, v, size[a] * size[b]).reshape(size[a], size[b]) for v in slope()))

        ranked = sorted(((grids(a, b)[0], a, b) for a in range(len(size)) for b in range(a) if size[a] > 1 and size[b] > 1), reverse=True)
        self.pairs = [(a, b, np.zeros((size[a], size[b]))) for _, a, b in ranked[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for a, b, table in self.pairs:
                step = self.rate * grids(a, b)[1]
                table += step
                f += step[small[a], small[b]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for e, t, v in zip(self.edges, self.tables, x.T, strict=False):
            f += t[np.searchsorted(e, v, side="right")]
        for a, b, t in self.pairs:
            f += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-f))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in bytes_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gam = model.value
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(gam.score(x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int = 20_000, **how) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; learned from ``labels`` (doc_id, ``label``) where ``learn`` holds of doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = materialize(bounded_batches(docs).select("doc_id", "text").mapInArrow(_measure, f"doc_id {kind}, x array<double>"), "features")
    known = measured.where(learn).join(labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull()), "doc_id")
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "y", "x").limit(rows).collect()
    x = np.array([r.x for r in sample], float).reshape(-1, len(FEATURES))
    gam = Gam(**how).fit(x, np.array([r.y for r in sample], float))
    return measured.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(gam)), f"doc_id {kind}, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", fold != 0)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
