"""Association results from delimited text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators import gwas
from genoloom.sources.text import find_column, saved, table

# Column names by which each field is known, in order of preference.
NAMES = {
    "snp": ["SNP", "rs", "rsid", "rs_id", "marker", "markername", "marker_id", "snp_id", "variant_id", "variant", "id", "taxa"],
    "chr": ["CHR", "chrom", "chromosome", "chr_id", "chr_name", "#chrom", "seqnames", "seqid"],
    "pos": ["BP", "pos", "position", "ps", "base_pair_location", "bp_position", "physical_position", "coordinate"],
    "p": ["P", "p_value", "pvalue", "pval", "p.value", "p_wald", "p_lrt", "p_score", "p_bolt_lmm", "p_bolt_lmm_inf", "p_val"],
}
MODEL = re.compile(r"\.(GLM|MLM|FarmCPU|BLINK)$", re.IGNORECASE)


def columns(names: list[str], **given: str | int | None) -> dict[str, str | None]:
    """Which of ``names`` hold snp, chr, pos and p; ``given`` names or numbers (from 1) come first.

    A p column may be named for its model (trait.MLM). Without any known name the first four columns
    count; with only some of them known it is an error.
    """
    out: dict[str, str | None] = {}
    for key, wanted in NAMES.items():
        own = given.get(key)
        if isinstance(own, int):
            own = names[own - 1]
        elif own is not None and own not in names:
            raise ValueError(f"no column {own}; columns: {', '.join(names)}")
        out[key] = own or find_column(names, wanted)
    out["p"] = out["p"] or next((n for n in names if MODEL.search(n)), None)
    lacking = [k for k in ("chr", "pos", "p") if out[k] is None]
    if lacking:
        if len(lacking) < 3 or out["snp"] or len(names) < 4:
            raise ValueError(f"no column for {', '.join(lacking)}; columns: {', '.join(names)}")
        out = dict(zip(NAMES, names, strict=False))
    return out


def raw(spark: SparkSession, path: str, sep: str = "auto", **given: str | int | None) -> DataFrame:
    """snp, chr, pos, p as text. Where a TEST column holds ADD at all, only its ADD rows."""
    rows = table(spark, path, sep)
    found = columns(rows.columns, **given)
    test = find_column(rows.columns, ["TEST"])
    if test:
        add = F.upper(F.trim(F.col(f"`{test}`"))) == "ADD"
        if not rows.where(add).isEmpty():
            rows = rows.where(add)
    return rows.select([(F.col(f"`{found[k]}`") if found[k] else F.lit(None).cast("string")).alias(k) for k in NAMES])


def read_gwas(spark: SparkSession, path: str | DataFrame, sep: str = "auto", chr_map: dict[str, str] | None = None, **given: str | int | None) -> DataFrame:
    """snp, chr, pos, p, logp after quality control; an error if no row passes. A DataFrame with all five columns is taken as checked, one with snp, chr, pos and p is checked."""
    if isinstance(path, DataFrame):
        if {*NAMES, "logp"} <= set(path.columns):
            return path
        if lost := {"chr", "pos", "p"} - set(path.columns):
            raise ValueError(f"association results need columns {', '.join(sorted(lost))}")
        rows = gwas.qc(path.select([(F.col(c) if c in path.columns else F.lit(None)).cast("string").alias(c) for c in NAMES]), chr_map)
        if rows.isEmpty():
            raise ValueError("no row passes quality control")
        return rows
    # the text is split once; whether a row is left shows before any shuffle
    rows = saved(gwas.passing(raw(spark, path, sep, **given), chr_map))
    if rows.isEmpty():
        raise ValueError(f"no row of {path} passes quality control")
    return gwas.settled(rows)
