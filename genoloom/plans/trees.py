"""From a genotype file to a tree of its samples."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from genoloom.operators import genotypes
from genoloom.operators.tree import Tree, average_linkage, distance_matrix, midpoint_root, neighbor_joining
from genoloom.sources.genotypes import read_genotypes
from genoloom.sources.store import thinned
from genoloom.sources.text import saved


def sample_tree(spark: SparkSession, path: str, method: str = "nj", distance: str = "ibs", max_snps: int = 20_000, min_maf: float = 0.05, max_missing: float = 0.2, chr_map: dict[str, str] | None = None) -> Tree:
    """Genotypes thinned to about ``max_snps``, quality control, samples without calls left out, distances, tree.

    Neighbour joining holds samples^2 distances at the driver; 3 samples at least.
    """
    if method not in ("nj", "upgma"):
        raise ValueError("method is nj or upgma")
    g = read_genotypes(spark, path, chr_map=chr_map)
    variants = g.variants
    every = max(1, variants.count() // max_snps)
    some = thinned(variants, every) if every > 1 else variants
    calls = saved(g.calls.join(some.select("v", "id", "multiallelic"), "v").select("v", "id", "chr", "pos", "smp", "sample", "dos", "multiallelic"))
    kept = genotypes.qc(calls.withColumn("id", F.concat_ws("|", "id", "v")), min_maf, max_missing).where("step = 'kept'")
    calls = calls.join(kept.select("v"), "v", "left_semi")
    dist = genotypes.distances(calls.where("dos IS NOT NULL").select("v", F.col("sample").alias("smp"), "dos"), distance)
    if method == "upgma":
        found = average_linkage(dist)
        if len(found.tips) < 3:
            raise ValueError("a tree needs 3 samples with calls")
        return found
    names, d = distance_matrix(dist)
    if len(names) < 3:
        raise ValueError("a tree needs 3 samples with calls")
    return midpoint_root(neighbor_joining(names, d))
