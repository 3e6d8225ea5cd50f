"""Confidence-interval haplotype blocks.

Whether a pair of variants may be a block rests on the pairs between them alone, so windows of a chromosome tell it apart from each other
(``bands``): along the diagonals of a window, sums over the pairs of a to a + d follow from those of the two diagonals before. The greedy choice
among these candidates, longest first, goes by windows too, in rounds: a candidate is settled where all that it may meet is in its window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators import genotypes as g
from genoloom.operators.bands import Known, taken, windows
from genoloom.operators.intervals import range_join
from genoloom.sources.text import saved

SMALL_SPAN = {2: 20_000, 3: 30_000}
SMALL_LOW = {2: 0.80, 3: 0.50, 4: 0.50}
NEEDED = {2: 1, 3: 3}


def in_boxes(n: int, i: np.ndarray, j: np.ndarray, flag: np.ndarray, width: int) -> np.ndarray:
    """[a, d]: flagged pairs within variants a to a + d, for d up to ``width``: a band of the box sums, one diagonal after the other."""
    out = np.zeros((n + 1, width + 1), np.int32)
    near = flag & (j - i <= width)
    np.add.at(out, (i[near], (j - i)[near]), 1)
    for d in range(1, width + 1):
        out[: n - d, d] += out[: n - d, d - 1] + out[1 : n - d + 1, d - 1]
        if d > 1:
            out[: n - d, d] -= out[1 : n - d + 1, d - 2]
    return out


def segments(reach: DataFrame, width: int) -> DataFrame:
    """chr, v, pos, seg of the variants that candidates cover: runs of a chromosome between places that none spans, named by their first variant.

    reach: chr, v, pos of all variants and far, the (pos, v) of the last candidate that starts there, at most ``width`` positions away, else null.
    Candidates are laid into the bins of ``width`` that they touch, so a run's start shows within one bin; only the bins' last starts
    are carried along a chromosome.
    """
    here, last = F.floor(F.col("pos") / width), F.floor(F.col("far.pos") / width)
    rows = reach.withColumn("_at", F.struct("pos", "v")).withColumn("_b", F.explode(F.sequence(here, F.coalesce(last, here))))
    rows = rows.withColumn("_home", F.col("_b") == here)
    before = Window.partitionBy("chr", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_open", F.coalesce(F.max("far").over(before) >= F.col("_at"), F.lit(False)))
    rows = rows.where("_home AND (_open OR far IS NOT NULL)").withColumn("_first", F.when(~F.col("_open"), F.col("_at")))
    bins = rows.groupBy("chr", "_b").agg(F.max("_first").alias("_last"))
    bins = bins.withColumn("_before", F.max("_last").over(Window.partitionBy("chr").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    upto = Window.partitionBy("chr", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_own", F.max("_first").over(upto)).join(bins, ["chr", "_b"])
    return rows.select("chr", "v", "pos", F.coalesce("_own", "_before").alias("seg"))


def _told(steps: int) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """COUNTS -> bounds lo, hi of D'."""

    def run(k: list[np.ndarray]) -> list[np.ndarray]:
        p11, p10, p01, _ = g.em_of(k, steps, 1e-10)
        pa_, pb = p11 + p10, p11 + p01
        return g.bounds_of([*k, pa_, pb, p11 - pa_ * pb])

    return run


CANDIDATE = "chr string, pos_a long, a long, pos_b long, b long, n long"


def candidates(packs: DataFrame, max_bp: int, phased: bool, steps: int = 1000, low: float = 0.70, high: float = 0.98, recomb: float = 0.90, share: float = 0.95) -> DataFrame:
    """CANDIDATE: variants a, b with strong bounds that the pairs from a to b let be the ends of a block of n variants.

    A task holds a window's variants and a few sums of each, whatever the number of pairs.
    """
    terms = g.PHASED if phased else g.DIPLOID

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(_told(steps))
        for w in taken(batches):
            n = len(w.pos)
            cuts = {m: SMALL_LOW.get(m, low) for m in (2, 3, 4, 0)}  # 0: five variants or more
            zero = np.zeros(n + 1, np.int64)
            before, last = {m: zero for m in (*cuts, "rec")}, {m: zero[:n] for m in (*cuts, "rec")}
            for d, at in w.diagonals(max_bp, own=False):
                got = w.tally(at, d, terms)
                some = got.pop("n") > 0
                lo, hi = (np.full(len(at), np.nan) for _ in "lh")
                lo[some], hi[some] = known([x[some].astype(np.int64) for x in got.values()])
                flags = {m: (lo > cut) & (hi >= high) for m, cut in cuts.items()} | {"rec": hi < recomb}  # a bound that is no number holds nowhere
                for m, flag in flags.items():
                    if m in SMALL_LOW and d >= m:
                        continue
                    now = last[m][:-1] + last[m][1:] - before[m][1 : n - d + 1]
                    now[at[flag]] += 1
                    before[m], last[m] = last[m], now
                m = d + 1 if d < 4 else 0
                s, r = last[m][at], last["rec"][at]
                ok = (lo >= low) & (hi >= high) & w.own[at] & (s + r >= NEEDED.get(d + 1, 6))
                ok[ok] = s[ok] / (s + r)[ok] > share
                if d + 1 in SMALL_SPAN:
                    ok &= w.pos[at + d] - w.pos[at] <= SMALL_SPAN[d + 1]
                at = at[ok]
                if len(at):
                    ends = [w.take(c, x).cast(pa.int64()) for x in (at, at + d) for c in ("pos", "v")]
                    yield pa.RecordBatch.from_arrays([w.take("chr", at).cast(pa.string()), *ends, pa.array(np.full(len(at), d + 1))], ["chr", "pos_a", "a", "pos_b", "b", "n"])

    return windows(packs, max_bp).mapInArrow(run, CANDIDATE)


OPEN, TAKEN, GONE = 0, 1, 2


def settle(pos_a: np.ndarray, a: np.ndarray, pos_b: np.ndarray, b: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """TAKEN, GONE or OPEN of a window's candidates, as longest first (of equal ones the later) would take those without an end in one taken before.

    inner: whether no candidate beyond the window can meet it. What an open one may take is left open.
    """
    ends = np.concatenate((np.stack((pos_a, a), 1), np.stack((pos_b, b), 1)))
    at = np.unique(ends, axis=0, return_inverse=True)[1].ravel()
    first, last = at[: len(a)], at[len(a) :]
    used, may = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    state = np.full(len(a), OPEN, np.int8)
    for k in np.lexsort((-last, -first, pos_a - pos_b)).tolist():
        i, j = first[k], last[k]
        if used[i] or used[j]:
            state[k] = GONE
        elif not inner[k] or may[i] or may[j]:
            may[i : j + 1] = True
        else:
            used[i : j + 1] = True
            state[k] = TAKEN
    return state


def choose(found: DataFrame, max_bp: int, widths: int = 8) -> DataFrame:
    """Those of ``found`` (CANDIDATE) that a loop over a whole chromosome would take, longest first and of equal ones the later.

    Windows of ``widths`` times ``max_bp`` settle what they hold; in the next round they lie half their width further. The longest open candidate
    is settled in one round of two, so rounds end; a chain of candidates that each wait for the next takes a round for each window it crosses.
    """
    width, chosen, shift = max(max_bp, 1) * widths, [], 0
    names = ["chr", "pos_a", "a", "pos_b", "b", "n"]
    left = saved(found)

    def settled(step: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            place = (pdf.pos_a.to_numpy() + step) % width
            inner = (place >= max_bp) & (place < width - max_bp)
            return pdf[names].assign(state=settle(*(pdf[c].to_numpy() for c in names[1:5]), inner))

        return run

    while not left.isEmpty():
        rows = left.groupBy("chr", F.floor((F.col("pos_a") + shift) / width).alias("_w")).applyInPandas(settled(shift), CANDIDATE + ", state byte")
        rows = saved(rows.where(f"state <> {GONE}"))
        chosen.append(rows.where(f"state = {TAKEN}").select(names))
        left, shift = rows.where(f"state = {OPEN}").select(names), width // 2 - shift
    out = left
    for rows in chosen:
        out = out.unionByName(rows)
    return out


def find_blocks(calls: DataFrame, max_kb: int = 200, steps: int = 1000) -> DataFrame:
    """chr, start, end, kb, nsnps, snps of haplotype blocks; ``calls``: v, chr, pos, smp, dos, and h1, h2 where phased.

    Neither pairs nor their bounds are stored; candidates are, and of the chosen the variants between their ends.
    """
    max_bp = max_kb * 1000
    phase = g.told_by_phase(calls)
    packs = saved((g.phased if phase else g.diploid)(calls))
    chosen = choose(candidates(packs, max_bp, phase, steps), max_bp)
    spans = chosen.select("chr", F.col("pos_a").alias("start"), F.col("pos_b").alias("end"), "a", "b", "n")
    inside = range_join(packs.select(F.col("chr").cast("string").alias("chr"), F.col("pos").cast("long").alias("pos"), "v"), spans, max(max_bp, 1))
    inside = inside.where((F.struct("pos", "v") >= F.struct(F.col("start").alias("pos"), F.col("a").alias("v"))) & (F.struct("pos", "v") <= F.struct(F.col("end").alias("pos"), F.col("b").alias("v"))))
    rows = inside.groupBy("chr", "start", "end", "a", "b", F.col("n").alias("nsnps")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
    return rows.select("chr", "start", "end", ((F.col("end") - F.col("start") + 1) / 1000).alias("kb"), "nsnps", F.array_join(F.transform("m", lambda x: x["v"].cast("string")), "|").alias("snps"))
