"""Regions written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.functions.names import normalize_chr
from genoloom.sources.text import find_column


def parse_region(text: Column, chr_map: dict[str, str] | None = None) -> Column:
    """chr, start, end of 'chr:start-end'; commas and blanks don't count, numbers may be 1.2e7. Null where not understood or start > end."""
    plain = F.regexp_replace(text, "[, ]", "")
    part = lambda k: F.regexp_extract(plain, r"^([^:]+):([0-9.eE+]+)-([0-9.eE+]+)$", k)
    start, end = part(2).try_cast("double"), part(3).try_cast("double")
    return F.when(start <= end, F.struct(normalize_chr(part(1), chr_map).alias("chr"), start.cast("long").alias("start"), end.cast("long").alias("end")))


def regions(rows: DataFrame, chr_map: dict[str, str] | None = None) -> DataFrame:
    """r_chr, r_start, r_end, region_id of a table with columns for chr, start, end and maybe name, or of one column of text.

    A region without a name is named chr:start-end. An error names what can't be understood.
    """
    if len(rows.columns) == 1:
        one = rows.columns[0]
        out = rows.select(F.col(one).alias("region_id"), parse_region(F.col(one), chr_map).alias("r"))
        bad = [r[0] for r in out.where("r IS NULL").select("region_id").limit(5).collect()]
        if bad:
            raise ValueError(f"regions look like 9:12400000-12700000; not understood: {', '.join(map(str, bad))}")
        return out.select(F.col("r.chr").alias("r_chr"), F.col("r.start").alias("r_start"), F.col("r.end").alias("r_end"), "region_id")
    # fixed values: names of the columns
    wanted = {"chr": ["chr", "chrom", "chromosome"], "start": ["start", "from", "bp1", "begin"], "end": ["end", "to", "bp2", "stop"], "name": ["name", "region", "label", "id", "qtl"]}
    found = {k: find_column(rows.columns, v) for k, v in wanted.items()}
    if None in (found["chr"], found["start"], found["end"]):
        raise ValueError("regions need columns chr, start and end")
    at = {k: F.col(f"`{v}`") for k, v in found.items() if v}
    chrom, start, end = normalize_chr(at["chr"], chr_map), at["start"].try_cast("long"), at["end"].try_cast("long")
    name = F.format_string("%s:%d-%d", chrom, start, end)
    out = rows.select(chrom.alias("r_chr"), start.alias("r_start"), end.alias("r_end"), (F.coalesce(at["name"].cast("string"), name) if "name" in at else name).alias("region_id"))
    if not out.where("r_start IS NULL OR r_end IS NULL OR r_end < r_start").isEmpty():
        raise ValueError("a region needs start <= end")
    return out
