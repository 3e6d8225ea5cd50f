"""Names near to a given one by edits, through the neighbourhood of deletions.

Two names within k edits share a string that each becomes by deleting at most k letters. So names are indexed by the hashes of these strings, and a
lookup joins the few hashes of the name asked for by equality; true distances are told of what meets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.sources.text import saved

K = 2


def deletions(name: Column, k: int = K) -> Column:
    """The strings that ``name`` becomes by deleting up to ``k`` letters, each once."""
    every = F.array(name)
    for _ in range(k):
        cut = F.flatten(F.transform(every, lambda s: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.length(s) > 0), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        every = F.array_distinct(F.concat(every, cut))
    return every


def name_index(names: DataFrame, k: int = K) -> DataFrame:
    """h, name: a row for each string of a name's neighbourhood. Written sorted by h, a lookup opens few row groups."""
    name = names.select(F.col(names.columns[0]).cast("string").alias("name")).where("name IS NOT NULL").distinct()
    return name.select(F.explode(F.transform(deletions(F.col("name"), k), lambda s: F.xxhash64(s))).alias("h"), "name").distinct()


def similar(index: DataFrame, name: str, most: int = 5, k: int = K) -> list[str]:
    """The ``most`` nearest names within ``k`` edits of ``name``, ties by name."""
    asked = index.sparkSession.createDataFrame([(name,)], "q string")
    hashes = [r.h for r in asked.select(F.explode(F.transform(deletions(F.col("q"), k), lambda s: F.xxhash64(s))).alias("h")).distinct().collect()]
    far = F.levenshtein("name", F.lit(name))
    found = index.where(F.col("h").isin(hashes)).select("name").distinct().withColumn("far", far).where(F.col("far") <= k)
    return [r.name for r in found.orderBy("far", "name").limit(most).collect()]


def saved_index(names: DataFrame, k: int = K) -> DataFrame:
    """:func:`name_index`, stored sorted by h for many lookups."""
    return saved(name_index(names, k).repartitionByRange("h").sortWithinPartitions("h"))
