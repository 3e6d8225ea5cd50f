"""Genotype quality control, linkage disequilibrium, distances on long call tables (id, chr, pos, smp, dos)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.operators.bands import Known, Windows, pair_rows

#: Quality-control steps in their order.
STEPS = ("duplicate", "multiallelic", "not_snp", "missing", "maf")


def variant_stats(calls: DataFrame, n_samples: Column) -> DataFrame:
    """n, missing, af, maf per variant, with what else ``calls`` tells of it (v, multiallelic, is_snp); absent and null calls are missing."""
    more = [F.first(c).alias(c) for c in ("v", "multiallelic", "is_snp") if c in calls.columns]
    rows = calls.groupBy("id", "chr", "pos").agg(F.count("dos").alias("n"), F.sum("dos").cast("double").alias("s"), *more)
    af = F.coalesce(F.col("s"), F.lit(0.0)) / (2 * F.greatest(F.col("n"), F.lit(1)))
    return rows.withColumns({"missing": 1 - F.col("n") / n_samples, "af": af}).withColumn("maf", F.least("af", 1 - F.col("af"))).drop("s")


def qc(calls: DataFrame, min_maf: float = 0.05, max_missing: float = 0.2, biallelic_only: bool = True, snps_only: bool = False) -> DataFrame:
    """variant_stats with the first of STEPS that fails, or 'kept'. Of a position the first variant stays: by v where ``calls`` has it, else by id.

    The steps multiallelic and not_snp need columns multiallelic and is_snp.
    """
    n = calls.agg(F.countDistinct("smp").cast("double")).scalar()
    rows = variant_stats(calls, n)
    order = ["v", "id"] if "v" in rows.columns else ["id"]
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("chr", "pos").orderBy(*order)))
    step = F.when(F.col("k") > 1, "duplicate")
    if biallelic_only and "multiallelic" in rows.columns:
        step = step.when(F.col("multiallelic"), "multiallelic")
    if snps_only and "is_snp" in rows.columns:
        step = step.when(~F.col("is_snp"), "not_snp")
    step = step.when(F.col("missing") > max_missing, "missing").when((F.col("n") == 0) | (F.col("maf") < min_maf) | (F.col("maf") <= 0), "maf").otherwise("kept")
    return rows.withColumn("step", step).drop("k")


def qc_log(checked: DataFrame, steps: tuple[str, ...] = ("duplicate", "missing", "maf")) -> DataFrame:
    """Removed and remaining variants of each of ``steps``, in order."""
    counts = checked.agg(F.count("*").alias("all"), *[F.count_if(F.col("step") == s).alias(s) for s in steps])
    rows = ", ".join(f"{k}, '{s}', {s}, `all` - {' - '.join(steps[:k])}" for k, s in enumerate(steps, 1))
    return counts.select(F.expr(f"stack({len(steps)}, {rows}) AS (step_no, step, removed, remaining)"))


def packed(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """One row of each of ``keys`` with g: of each value, the places ``at`` (0, 1, ...) that hold it, as a bitmap in 64-bit words. Null values have no bit.

    Bits are joined before the shuffle, so rows of one key in one task leave as one word a value and 64 places.
    """
    words = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x"), F.expr(f"cast({at} div 64 AS int)").alias("w"))
    words = words.agg(F.expr(f"bit_or(shiftleft(1L, cast({at} % 64 AS int)))").alias("bits")).repartition(*keys)
    levels = words.groupBy(*keys, "x").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("last"))
    dense = F.expr("transform(sequence(0, last), k -> coalesce(try_element_at(m, k), 0L))")
    return levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", dense.alias("words")))).alias("g"))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over as many partitions as are set: small inputs of a join with much work a row are not to be coalesced into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: c: places that hold x in g and y in h, for each x and y.
CELLS = """flatten(transform(g, a -> transform(h, b -> named_struct('x', a.x, 'y', b.x,
    'c', aggregate(zip_with(a.words, b.words, (p, q) -> bit_count(p & q)), 0L, (s, t) -> s + coalesce(t, 0))))))"""


def _tally(pairs: DataFrame, keep: list[str], terms: dict[str, str]) -> DataFrame:
    """``keep``, n and the sum over shared places of each of ``terms`` (of t.x and t.y); rows that share none are left out. The fold runs once a row."""
    zero = ", ".join(f"'{k}', 0D" for k in terms)
    step = ", ".join(f"'{k}', s.{k} + ({v}) * t.c" for k, v in terms.items())
    fold = f"aggregate({CELLS}, named_struct('n', 0L, {zero}), (s, t) -> named_struct('n', s.n + t.c, {step}))"
    return pairs.select(*keep, F.inline(F.expr(f"filter(array({fold}), f -> f.n > 0)")))


def placed(calls: DataFrame, at: str = "smp", value: str = "dos") -> DataFrame:
    """chr, v, pos, g of all variants of ``calls`` (see :func:`packed`); a variant without calls has a level that is no number. Without a column chr all are of one chromosome."""
    rows = calls if "chr" in calls.columns else calls.withColumn("chr", F.lit(""))
    return packed(rows.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))), ["chr", "v", "pos"], at, value)


PAIR = ["i", "pos_i", "j", "pos_j"]
SUMS = ("count(*) AS n", "sum(x) AS sx", "sum(y) AS sy", "sum(x * x) AS sxx", "sum(y * y) AS syy", "sum(x * y) AS sxy")
R2 = """CASE WHEN n >= 3 AND n * sxx - sx * sx > 1e-9 * greatest(n, 1) AND n * syy - sy * sy > 1e-9 * greatest(n, 1)
    THEN least(cast((n * sxy - sx * sy) * (n * sxy - sx * sy) AS double) / (cast(n * sxx - sx * sx AS double) * cast(n * syy - sy * sy AS double)), 1.0) END"""


def r2_of(w: Windows, at: np.ndarray, d: int | np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """R2 over arrays."""
    n, sx, sy, sxx, syy, sxy = w.sums(at, d).values()
    a, b, ab = n * sxx - sx * sx, n * syy - sy * sy, n * sxy - sx * sy
    some = (n >= 3) & (a > 1e-9 * n) & (b > 1e-9 * n)
    value = np.minimum(ab * ab / np.where(some, a * b, 1.0), 1.0)
    return {"n_shared": n, "n": n.astype(np.int64), "r2": pa.array(value, mask=~some)}


def r2(calls: DataFrame, max_bp: int) -> DataFrame:
    """i, pos_i, j, pos_j, n, r2 of pairwise complete genotypes, of any ploidy, of variants of a chromosome within ``max_bp``, i before j by position, then v."""
    return pair_rows(placed(calls), max_bp, r2_of, "n long, r2 double")


def r2_with_lead(calls: DataFrame, lead: int) -> DataFrame:
    """v, pos, r2 of every variant with ``lead`` (1 with itself); the lead's calls, a row a sample, join by sample."""
    one = calls.where((F.col("v") == lead) & F.col("dos").isNotNull()).select("smp", F.col("dos").alias("x"))
    sums = calls.where("dos IS NOT NULL").withColumnRenamed("dos", "y").join(one, "smp").groupBy("v", "pos").agg(*map(F.expr, SUMS))
    return sums.select("v", "pos", F.when(F.col("v") == lead, 1.0).otherwise(F.expr(R2)).alias("r2"))


DIPLOID = {
    "k11": lambda x, y: 2 if x == 2 and y == 2 else 1 if x + y == 3 else 0,
    "k10": lambda x, y: 2 if x == 2 and y == 0 else 1 if (x, y) in ((2, 1), (1, 0)) else 0,
    "k01": lambda x, y: 2 if x == 0 and y == 2 else 1 if (x, y) in ((0, 1), (1, 2)) else 0,
    "k00": lambda x, y: 2 if x == 0 and y == 0 else 1 if x + y == 1 else 0,
    "dh": lambda x, y: int(x == 1 and y == 1),
}
PHASED = {f"k{a}{b}": lambda x, y, a=a, b=b: int(x == a and y == b) for a in (1, 0) for b in (1, 0)} | {"dh": lambda x, y: 0}
NOT_DIPLOID = "haplotypes need diploid genotypes of dosage 0, 1 or 2; take genotype r2 for other ploidies"


def _counts(packs: DataFrame, max_bp: int, terms: dict[str, Callable[[float, float], float]]) -> DataFrame:
    def found(w: Windows, at: np.ndarray, d: int) -> dict[str, np.ndarray | pa.Array]:
        got = w.tally(at, d, terms)
        return {"n_shared": got.pop("n")} | {k: v.astype(np.int64) for k, v in got.items()}

    return pair_rows(packs, max_bp, found, ", ".join(f"{k} long" for k in terms))


def diploid(calls: DataFrame) -> DataFrame:
    """:func:`placed` calls of whole dosages. The job fails with NOT_DIPLOID at a fractional one."""
    whole = F.when(F.abs(F.col("dos") - F.round("dos")) > 1e-8, F.raise_error(F.lit(NOT_DIPLOID)).cast("double")).otherwise(F.round("dos").cast("double"))
    return placed(calls.withColumn("dos", whole))


def phased(calls: DataFrame) -> DataFrame:
    """:func:`placed` haplotypes (h1, h2: 0 or 1). Each of a sample's two is a place of its own."""
    one = F.explode(F.array(*[F.struct((F.col("smp") * 2 + k).alias("at"), F.col(f"h{k + 1}").alias("h")) for k in (0, 1)]))
    keep = [c for c in ("chr", "v", "pos") if c in calls.columns]
    return placed(calls.select(*keep, one.alias("hap")).select(*keep, "hap.*"), "at", "h")


def hap_counts(calls: DataFrame, max_bp: int) -> DataFrame:
    """Haplotype counts of each pair that genotypes tell, and double heterozygotes dh. The job fails with NOT_DIPLOID at a fractional dosage."""
    return _counts(diploid(calls), max_bp, DIPLOID)


def hap_counts_phased(calls: DataFrame, max_bp: int) -> DataFrame:
    """Exact haplotype counts of each pair from phased calls (h1, h2: 0 or 1); dh is 0."""
    return _counts(phased(calls), max_bp, PHASED)


def all_phased(calls: DataFrame) -> bool:
    """Whether there are called genotypes and each is phased and diploid."""
    known = calls.where("dos IS NOT NULL").agg(F.count("*").alias("n"), F.count_if(F.col("h1").isNull() | F.col("h2").isNull()).alias("open")).first()
    return known.n > 0 and known.open == 0


def told_by_phase(calls: DataFrame) -> bool:
    """Whether ``calls`` has h1 and h2 and all are phased (one small action)."""
    return {"h1", "h2"} <= set(calls.columns) and all_phased(calls)


def haplotypes(calls: DataFrame, max_bp: int) -> DataFrame:
    """Counts from phase where all calls are phased, else from genotypes."""
    return (hap_counts_phased if told_by_phase(calls) else hap_counts)(calls, max_bp)


COUNTS, FREQS = ("k11", "k10", "k01", "k00", "dh"), ("p11", "p10", "p01", "p00")


def em_of(k: list[np.ndarray], steps: int, tol: float) -> list[np.ndarray]:
    """Frequencies p11, p10, p01, p00 of rows of counts (k11, k10, k01, k00, dh): each row goes on until its change is below ``tol``."""
    k = [x.astype(float) for x in k]
    total = k[0] + k[1] + k[2] + k[3] + 2 * k[4]
    p = [(x + k[4] / 2) / total for x in k[:4]]
    at = np.flatnonzero(k[4] != 0)
    n11, n10, n01, n00, dh, t = (x[at] for x in (*k, total))
    for _ in range(steps):
        if not len(at):
            break
        p11, p10, p01, p00 = (x[at] for x in p)
        a, b = p11 * p00, p10 * p01
        th = np.where(a + b > 0, a / np.where(a + b > 0, a + b, 1.0), 0.5)
        new = [(n11 + dh * th) / t, (n10 + dh * (1 - th)) / t, (n01 + dh * (1 - th)) / t, (n00 + dh * th) / t]
        go = ~(np.maximum(np.abs(new[0] - p11), np.abs(new[1] - p10)) < tol)
        for x, y in zip(p, new, strict=True):
            x[at] = y
        at, n11, n10, n01, n00, dh, t = (x[go] for x in (at, n11, n10, n01, n00, dh, t))
    return p


def _known_columns(rows: DataFrame, of: Callable[[list[np.ndarray]], list[np.ndarray]], keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """``rows`` with the columns ``names`` that ``of`` tells of their numbers ``keys``, null where it tells none; equal rows of a task are told once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(of)
        for batch in batches:
            got = known([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, from_pandas=True) for x in got]], [*batch.schema.names, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]]))


def em(counts: DataFrame, steps: int = 1000, tol: float = 1e-10) -> DataFrame:
    """p11, p10, p01, p00 by expectation maximisation from (k + dh/2). Pairs are many and their counts few, so each task tells equal counts once."""
    some = counts.where("k11 + k10 + k01 + k00 + 2 * dh > 0")
    return _known_columns(some, lambda k: em_of(k, steps, tol), COUNTS, FREQS)


def from_freqs(freqs: DataFrame) -> DataFrame:
    """d, r2 and |D'| of haplotype frequencies; null where undefined."""
    rows = freqs.withColumns({"pa": F.expr("p11 + p10"), "pb": F.expr("p11 + p01")}).withColumn("d", F.expr("p11 - pa * pb"))
    rows = rows.withColumns({"den": F.expr("pa * (1 - pa) * pb * (1 - pb)"), "dmax": F.expr("if(d >= 0, least(pa * (1 - pb), (1 - pa) * pb), least(pa * pb, (1 - pa) * (1 - pb)))")})
    return rows.withColumns({"r2": F.expr("if(den > 1e-12, least(d * d / den, 1D), null)"), "dprime": F.expr("if(dmax > 1e-12, least(abs(d) / dmax, 1D), null)")}).drop("den", "dmax")


def _bounds(k: list[np.ndarray], dh: np.ndarray, pa: np.ndarray, pb: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of D' per pair from its likelihood on 0, 0.01, ..., 1: 5% of the mass lies beyond either bound; NaN where undefined."""
    flip = d < 0
    n11, n10, n01, n00 = (np.where(flip, k[j], k[i]) for i, j in ((0, 1), (1, 0), (2, 3), (3, 2)))
    b = np.where(flip, 1 - pb, pb)
    most = np.minimum(pa * (1 - b), (1 - pa) * b)
    lo, hi = np.full(len(d), np.nan), np.full(len(d), np.nan)
    use = np.flatnonzero((pa > 0) & (pa < 1) & (b > 0) & (b < 1) & (most > 0))
    if not len(use):
        return lo, hi
    n11, n10, n01, n00, dh, a, b, most = (x[use, None] for x in (n11, n10, n01, n00, dh, pa, b, most))
    dg = np.arange(101)[None, :] / 100.0 * most
    q11, q10, q01, q00 = (np.maximum(x, 1e-10) for x in (a * b + dg, a * (1 - b) - dg, (1 - a) * b - dg, (1 - a) * (1 - b) + dg))
    like = n11 * np.log(q11) + n10 * np.log(q10) + n01 * np.log(q01) + n00 * np.log(q00) + dh * np.log(q11 * q00 + q10 * q01)
    like = np.exp(like - like.max(axis=1, keepdims=True))
    limit = 0.05 * like.sum(axis=1, keepdims=True)
    up = (np.cumsum(like, axis=1) > limit).argmax(axis=1) + 1
    down = 101 - (np.cumsum(like[:, ::-1], axis=1) > limit).argmax(axis=1)
    lo[use], hi[use] = np.maximum(up - 2, 0) / 100, np.minimum(down, 100) / 100
    return lo, hi


def bounds_of(rows: list[np.ndarray]) -> list[np.ndarray]:
    """lo, hi of rows of k11, k10, k01, k00, dh, pa, pb, d, some thousands at a time."""
    rows = [x.astype(float) for x in rows]
    parts = [_bounds([x[i : i + 4096] for x in rows[:4]], *(x[i : i + 4096] for x in rows[4:])) for i in range(0, max(len(rows[0]), 1), 4096)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def dprime_ci(freqs: DataFrame) -> DataFrame:
    """``freqs`` with lo, hi: 90% bounds of D'. The 101-point grids of a batch are one array computation (Arrow)."""
    return _known_columns(freqs, bounds_of, (*COUNTS, "pa", "pb", "d"), ("lo", "hi"))


def compare(a: DataFrame, b: DataFrame, value_a: str, value_b: str) -> DataFrame:
    """n_variants that both know, n_pairs, largest and mean difference, rmse and correlation (of over two pairs) of two LD tables on (i, j)."""
    known = [t.select(F.explode(F.array("i", "j")).alias("v")).distinct() for t in (a, b)]
    shared = known[0].join(known[1], "v").agg(F.count("*").alias("n_variants"))
    both = a.select("i", "j", F.col(value_a).alias("x")).join(b.select("i", "j", F.col(value_b).alias("y")), ["i", "j"]).where("x IS NOT NULL AND y IS NOT NULL")
    d = F.abs(F.col("x") - F.col("y"))
    sums = both.agg(F.count("*").alias("n_pairs"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), F.when(F.count("*") > 2, F.corr("x", "y")).alias("correlation"))
    return shared.join(sums)  # one row each


def matrix_long(r2s: DataFrame, calls: DataFrame) -> DataFrame:
    """id_a, id_b, value: the symmetric matrix of all variants of ``calls`` in long form, the diagonal 1; pairs that ``r2s`` leaves out have no row."""
    upper = r2s.select(F.col("i").alias("id_a"), F.col("j").alias("id_b"), F.col("r2").alias("value"))
    same = calls.select(F.col("v").alias("id_a"), F.col("v").alias("id_b"), F.lit(1.0).alias("value")).distinct()
    return upper.unionByName(upper.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "value")).unionByName(same)


def distances(calls: DataFrame, method: str = "ibs", block: int = 1024) -> DataFrame:
    """s1, s2, dist of sample pairs: sum |d| / 2N (ibs) or sqrt(sum d^2 / N); pairs that share no call have no row.

    Samples are packed over blocks of ``block`` variants (v div block); a pair has one row a block, not one a variant.
    """
    rows = calls.select(F.expr(f"v div {block}").alias("_b"), F.expr(f"v % {block}").alias("_at"), "smp", "dos")
    p = packed(rows, ["_b", "smp"], "_at", "dos")
    both = _dealt(p.withColumnRenamed("smp", "s1"), "_b").join(_dealt(p.select("_b", F.col("smp").alias("s2"), F.col("g").alias("h")), "_b"), "_b").where("s1 < s2")
    sums = _tally(both, ["s1", "s2"], {"d": "abs(t.x - t.y)" if method == "ibs" else "(t.x - t.y) * (t.x - t.y)"}).groupBy("s1", "s2").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return sums.select("s1", "s2", (F.col("d") / (2.0 * F.col("n")) if method == "ibs" else F.sqrt(F.col("d") / F.col("n"))).alias("dist"))
