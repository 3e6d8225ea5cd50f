"""Association results: row quality control, thresholds, lead variants, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.names import chr_key, normalize_chr
from genoloom.operators.ranks import at_ticks, ranked
from genoloom.operators.similar import name_index, similar

#: The smallest positive normal double, for p = 0 where no p is above 0 (a fixed value).
TINY = 2.2250738585072014e-308


def parse(raw: DataFrame, chr_map: dict[str, str] | None = None) -> DataFrame:
    """snp, chr, pos, p of text columns; what can't be read is null."""
    return _named(_fields(raw, chr_map))


def _fields(raw: DataFrame, chr_map: dict[str, str] | None) -> DataFrame:
    """As :func:`parse`, but chr still as it was written, for filters that are pushed below the normal form."""
    p, label = F.col("p").try_cast("double"), F.trim("chr")
    if chr_map:
        label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in chr_map.items() for v in kv]), label), label)
    return raw.select(F.trim("snp").alias("snp"), label.alias("chr"), F.col("pos").try_cast("double").alias("pos"), F.when(~F.isnan(p), p).alias("p"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chr", normalize_chr(F.col("chr")))


MISSING = "chr IS NULL OR chr = '' OR pos IS NULL OR p IS NULL"
BAD_POS = "pos < 1 OR pos <> round(pos)"
BAD_P = "p < 0 OR p > 1"


def passing(raw: DataFrame, chr_map: dict[str, str] | None = None) -> DataFrame:
    """snp, chr, pos, p of the rows that :func:`qc` does not drop for what they hold."""
    return _fields(raw, chr_map).where(f"NOT ({MISSING})").where(f"NOT ({BAD_POS})").where(f"NOT ({BAD_P})").withColumn("pos", F.col("pos").cast("long"))


def qc(raw: DataFrame, chr_map: dict[str, str] | None = None) -> DataFrame:
    """snp, chr, pos, p, logp: bad rows dropped, zero p raised, the best p of a position kept, ids filled and unique.

    One shuffle by position, one by id; the least non-zero p is a scalar subquery.
    """
    return settled(passing(raw, chr_map))


def settled(rows: DataFrame) -> DataFrame:
    """:func:`qc` of rows that are :func:`passing`."""
    least = rows.where("p > 0").agg(F.min("p")).scalar()
    rows = _named(rows).withColumn("p", F.when(F.col("p") == 0, F.coalesce(least, F.lit(TINY))).otherwise(F.col("p")))
    rows = rows.withColumn("snp", F.when(F.col("snp").isNull() | F.col("snp").isin("", "."), F.concat_ws(":", "chr", "pos")).otherwise(F.col("snp")))
    best = Window.partitionBy("chr", "pos").orderBy("p", "snp")
    rows = rows.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    again = Window.partitionBy("snp").orderBy(chr_key(F.col("chr")), "pos")
    rows = rows.withColumn("snp", F.when(F.row_number().over(again) > 1, F.concat("snp", F.lit("_"), "chr", F.lit(":"), "pos")).otherwise(F.col("snp")))
    return rows.select("snp", "chr", "pos", "p", (-F.log10("p")).alias("logp"))


def qc_log(raw: DataFrame, chr_map: dict[str, str] | None = None) -> DataFrame:
    """One row: how many rows came in, what each step removed, how many stay."""
    rows = _fields(raw, chr_map)
    step = F.when(F.expr(MISSING), "missing").when(F.expr(BAD_POS), "position").when(F.expr(BAD_P), "p").otherwise("ok")
    rows = rows.withColumn("step", step)
    kept = _named(rows.where("step = 'ok'")).groupBy("chr", "pos").agg(F.count("*").alias("n")).agg(F.sum("n").alias("ok"), F.count("*").alias("kept"))
    seen = rows.agg(F.count("*").alias("n_input"), *[F.count_if(F.col("step") == s).alias(a) for s, a in (("missing", "missing"), ("position", "bad_position"), ("p", "bad_p"))], F.count_if((F.col("step") == "ok") & (F.col("p") == 0)).alias("zero_p"))
    return seen.select("*", (kept.select("ok").scalar() - kept.select("kept").scalar()).alias("duplicates"), kept.select("kept").scalar().alias("kept"))


def threshold(gwas: DataFrame, value: str | float | None = "bonferroni", alpha: float = 0.05) -> float | None:
    """P threshold: alpha / n, a P below 1, a -log10 P of 1 or more, or none."""
    if value is None or value is False or str(value).lower() in ("none", "na", "false", ""):
        return None
    if str(value).lower() == "bonferroni":
        n = gwas.count()
        return alpha / n if n else None
    number = float(value)
    if number <= 0:
        raise ValueError("a threshold is above 0")
    return number if number < 1 else 10.0**-number


def significant(gwas: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows at or below alpha / n."""
    limit = gwas.agg((F.lit(alpha) / F.count("*")).alias("t")).scalar()
    return gwas.withColumn("threshold", limit).where("p <= threshold")


def top(gwas: DataFrame, n: int = 1, chrom: str | None = None) -> DataFrame:
    """The n rows of least p; ties by natural order."""
    rows = gwas if chrom is None else gwas.where(F.col("chr") == chrom)
    return rows.orderBy("p", chr_key(F.col("chr")), "pos").limit(n)


def top_per_chr(gwas: DataFrame) -> DataFrame:
    """The least p of each chromosome: one aggregate with map-side combine, no sort."""
    best = gwas.groupBy("chr").agg(F.min(F.struct("p", "pos", "snp", "logp")).alias("b"))
    return best.select("b.snp", "chr", "b.pos", "b.p", "b.logp")


def resolve_target(gwas: DataFrame, target: str = "top", chrom: str | None = None, pos: int | None = None, index: DataFrame | None = None) -> tuple[str, int, str | None]:
    """(chr, pos, snp) of 'top', an id, 'chr:pos', or chrom and pos. An unknown id's error names those within two edits; ``index``: a stored one of the ids."""
    if chrom is not None and pos is not None:
        hit = gwas.where((F.col("chr") == chrom) & (F.col("pos") == pos)).limit(1).collect()
        return chrom, pos, hit[0].snp if hit else None
    if target == "top":
        hit = top(gwas, 1, chrom).collect()
    else:
        hit = gwas.where(F.col("snp") == target).limit(1).collect()
        if not hit and ":" in target:
            c, _, p = target.rpartition(":")
            return resolve_target(gwas, "", c, int(p))
    if not hit:
        near = similar(name_index(gwas.select("snp")) if index is None else index, target)
        raise ValueError(f"no SNP {target!r}" + (f"; similar: {', '.join(near)}" if near else ""))
    return hit[0].chr, hit[0].pos, hit[0].snp


def chrom_sizes(gwas: DataFrame) -> DataFrame:
    """Greatest position of each chromosome."""
    return gwas.groupBy("chr").agg(F.max("pos").alias("length"))


def genome_layout(sizes: DataFrame, gap: float = 0.004) -> DataFrame:
    """Offsets of chromosomes on one axis; one row a chromosome, so the ordered window is small."""
    order = Window.orderBy(chr_key(F.col("chr")))
    g = sizes.agg(F.sum("length") * F.lit(gap)).scalar()
    rows = sizes.withColumn("g", g).withColumn("index", F.row_number().over(order))
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.col("length") + F.col("g")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return rows.select("chr", "length", "offset", (F.col("offset") + F.col("length") / 2).alias("center"), (F.col("offset") + F.col("length")).alias("end_cum"), "index")


def manhattan(gwas: DataFrame, layout: DataFrame) -> DataFrame:
    """snp, x, logp and the alternating colour group of each row."""
    at = layout.select("chr", "offset", "index")
    return gwas.join(at, "chr").select("snp", (F.col("pos") + F.col("offset")).alias("x"), "logp", (F.col("index") % 2).alias("grp"))


def thin_even(rows: DataFrame, order: list, most: int, group: str) -> DataFrame:
    """At most ``most`` rows of each group, evenly by rank, first and last included (half to even)."""
    return ranked(rows, [group], order).where(at_ticks(F.col("_r"), F.col("_n"), most)).drop("_r", "_n")


def thin_every(rows: DataFrame, order: list, every: int, group: str) -> DataFrame:
    """Every k-th row of each group."""
    return ranked(rows, [group], order).where((F.col("_r") - 1) % every == 0).drop("_r", "_n")


def thin_grid(points: DataFrame, group: str = "grp", x_bins: int = 1500, y_bins: int = 300, low: float = 2.0, whole: bool = False) -> DataFrame:
    """Points of logp under ``low`` thinned to one per grid cell; others all kept. A cell's first point is a minimum, told before the shuffle too.

    whole: in cells that ``low`` cuts a point from ``low`` on counts as well, and none under it is kept where such a point comes first.
    """
    span = points.agg(F.struct(F.max("x").alias("x"), F.max("logp").alias("y")).alias("m")).scalar()
    cell = points.withColumn("_m", span)
    cell = cell.withColumns({"_i": F.floor(F.col("x") / F.col("_m.x") * x_bins), "_j": F.floor(F.col("logp") / F.col("_m.y") * y_bins)}).drop("_m")
    under = F.coalesce(F.col("logp") < low, F.lit(False))
    rest = [c for c in points.columns if c not in ("x", "snp", group)]
    first = (cell if whole else cell.where(under)).groupBy(group, "_i", "_j").agg(F.min(F.struct("x", "snp", *rest)).alias("_p")).select(group, "_p.*")
    return cell.where(~under).select(points.columns).unionByName(first.where(under).select(points.columns))
