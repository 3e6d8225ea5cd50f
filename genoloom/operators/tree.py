"""Trees from sample distances: neighbour joining, average linkage, rooting, coordinates, Newick.

Average linkage joins mutually nearest clusters in rounds of Spark jobs; the driver holds merges, one a sample, and
finishes alone once few clusters are left. Neighbour joining has one least pair a step, and takes all distances to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.sources.text import saved


@dataclass
class Tree:
    """(parent, child, length) edges; nodes 0..n-1 are the tips in order of ``tips``."""

    tips: list[str]
    edges: list[tuple[int, int, float]] = field(default_factory=list)
    root: int = -1

    def children(self) -> dict[int, list[tuple[int, float]]]:
        out: dict[int, list[tuple[int, float]]] = {}
        for p, c, w in self.edges:
            out.setdefault(p, []).append((c, w))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, c, float(w), self.tips[c] if c < len(self.tips) else None) for p, c, w in self.edges], "parent int, child int, len double, tip string")


def distance_matrix(dist: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and symmetric matrix of (s1, s2, dist); absent pairs get the greatest distance."""
    rows = [(str(r.s1), str(r.s2), r.dist) for r in dist.collect()]
    names = sorted({x for r in rows for x in r[:2]}, key=lambda s: (len(s), s))
    at = {s: k for k, s in enumerate(names)}
    d = np.full((len(names), len(names)), max((r[2] for r in rows), default=0.0))
    np.fill_diagonal(d, 0)
    for a, b, x in rows:
        d[at[a], at[b]] = d[at[b], at[a]] = x
    return names, d


def neighbor_joining(names: list[str], d: np.ndarray) -> Tree:
    """Unrooted tree, held by its last inner node; the first least pair of the Q matrix by columns joins, negative lengths become 0."""
    n = len(names)
    if n < 3:
        raise ValueError("a tree needs 3 samples")
    d, nodes, edges, new = d.astype(float).copy(), list(range(n)), [], n
    while len(nodes) > 3:
        m = len(nodes)
        s = d.sum(axis=1)
        q = (m - 2) * d - s[:, None] - s[None, :]
        np.fill_diagonal(q, np.inf)
        j, i = divmod(int(q.T.argmin()), m)
        i, j = min(i, j), max(i, j)
        a = d[i, j] / 2 + (s[i] - s[j]) / (2 * (m - 2))
        edges += [(new, nodes[i], max(a, 0.0)), (new, nodes[j], max(d[i, j] - a, 0.0))]
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(m) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], row[keep, None]], [row[None, keep], np.zeros((1, 1))]])
        nodes, new = [nodes[k] for k in keep] + [new], new + 1
    for k, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
        edges.append((new, nodes[k], max((d[k, a] + d[k, b] - d[a, b]) / 2, 0.0)))
    return Tree(names, edges, new)


def _merges(d: np.ndarray, size: list[int]) -> list[tuple[int, int, float]]:
    """(i, j, distance) of average linkage, i < j; the cluster is i from then on. Of equal pairs the first by (i, j)."""
    d, size, out = d.astype(float).copy(), list(size), []
    np.fill_diagonal(d, np.inf)
    for _ in range(len(d) - 1):
        i, j = divmod(int(d.argmin()), len(d))
        out.append((i, j, float(d[i, j])))
        row = np.round((d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j]), 12)
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return out


def _joined(names: list[str], merges: list[tuple[int, int, float]]) -> Tree:
    """Tree of merges (i, j, distance), each after those of its parts; nodes are numbered by height, which is half the distance and never below a part's."""
    height, node, found = [0.0] * len(names), list(range(len(names))), []
    for k, (i, j, x) in enumerate(merges):
        h = max(x / 2, height[i], height[j])
        found.append((h, k, i, j))
        height[i] = h
    height, edges = [0.0] * len(names), []
    for new, (h, _, i, j) in enumerate(sorted(found), len(names)):
        edges += [(new, node[i], h - height[i]), (new, node[j], h - height[j])]
        node[i], height[i] = new, h
    return Tree(names, edges, len(names) + len(merges) - 1)


def upgma(names: list[str], d: np.ndarray) -> Tree:
    """Average linkage of a matrix; heights are half the merging distance."""
    if len(names) < 2:
        raise ValueError("a tree needs 2 samples")
    return _joined(names, _merges(np.round(d, 12), [1] * len(names)))


def average_linkage(dist: DataFrame, most_local: int = 1000) -> Tree:
    """The tree of :func:`upgma` from (s1, s2, dist), one row a pair; absent pairs get the greatest distance.

    A round joins every two clusters that are each other's nearest (of equal pairs the first by least members). Averages of a
    join are never below both parts' own, so these are the joins that one pair a step would make, in another order. A round is
    a minimum by cluster and a sum by pair of clusters; there are few unless joins form one long chain. Distances
    count to 12 decimals and are summed as decimals, so reruns agree. Pairs at the greatest distance are left out, as absent
    ones are, and close the tree. With ``most_local`` clusters or fewer, their pairs go to the driver, which finishes.
    """
    spark = dist.sparkSession
    rows = saved(dist.where("s1 <> s2").select(F.col("s1").cast("string").alias("s1"), F.col("s2").cast("string").alias("s2"), F.col("dist").cast("decimal(24,12)").alias("s")))
    names = sorted((r[0] for r in rows.select("s1").union(rows.select("s2")).distinct().collect()), key=lambda x: (len(x), x))
    if len(names) < 2:
        raise ValueError("a tree needs 2 samples")
    far = rows.agg(F.max("s")).first()[0]
    ids = spark.createDataFrame(list(enumerate(names)), "k long, name string")
    of = [ids.select(F.col("k").alias(k), F.col("name").alias(s)) for k, s in (("a", "s1"), ("b", "s2"))]
    one = F.lit(1).cast("long")
    pairs = rows.where(F.col("s") < F.lit(far)).join(of[0], "s1").join(of[1], "s2").groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.max("s").cast("decimal(38,12)").alias("s"))
    pairs = pairs.select("i", "j", one.alias("ni"), one.alias("nj"), "s", one.alias("n"))
    whole = F.col("ni") * F.col("nj")
    mean = F.round((F.col("s").cast("double") + (whole - F.col("n")) * float(far)) / whole, 12)
    size, merges = dict.fromkeys(range(len(names)), 1), []
    while len(size) > most_local:
        pairs = saved(pairs)
        pair = [mean.alias("d"), "i", "j"]
        ends = pairs.select(F.explode(F.array(F.struct(F.col("i").alias("k"), *pair), F.struct(F.col("j").alias("k"), *pair))).alias("e")).select("e.k", F.struct("e.d", "e.i", "e.j").alias("p"))
        mutual = ends.groupBy("k").agg(F.min("p").alias("p")).groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.*")
        now = sorted((r.d, r.i, r.j) for r in mutual.collect())
        if not now:
            break
        moved = []
        for d, i, j in now:
            merges.append((i, j, d))
            size[i] += size.pop(j)
            moved += [(i, i, size[i]), (j, i, size[i])]
        to = spark.createDataFrame(moved, "k long, to long, total long")
        a, b = (to.select(F.col("k").alias(k), F.col("to").alias(f"{k}_to"), F.col("total").alias(f"{k}_n")) for k in ("i", "j"))
        on = pairs.join(a, "i", "left").join(b, "j", "left").select(F.coalesce("i_to", "i").alias("i"), F.coalesce("j_to", "j").alias("j"), F.coalesce("i_n", "ni").alias("ni"), F.coalesce("j_n", "nj").alias("nj"), "s", "n").where("i <> j")
        up = F.col("i") < F.col("j")
        on = on.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(up, F.col("ni")).otherwise(F.col("nj")).alias("ni"), F.when(up, F.col("nj")).otherwise(F.col("ni")).alias("nj"), "s", "n")
        pairs = on.groupBy("i", "j", "ni", "nj").agg(F.sum("s").cast("decimal(38,12)").alias("s"), F.sum("n").alias("n"))
    left = sorted(size)
    if len(left) > most_local:  # no pair is nearer than the greatest distance
        return _joined(names, merges + [(left[0], k, float(far)) for k in left[1:]])
    at = {k: p for p, k in enumerate(left)}
    d = np.full((len(left), len(left)), float(far))
    for r in pairs.select("i", "j", mean.alias("d")).collect():
        d[at[r.i], at[r.j]] = d[at[r.j], at[r.i]] = r.d
    return _joined(names, merges + [(left[i], left[j], x) for i, j, x in _merges(d, [size[k] for k in left])])


def _reach(tree: Tree, start: int) -> tuple[dict[int, float], dict[int, int]]:
    near: dict[int, list[tuple[int, float]]] = {}
    for p, c, w in tree.edges:
        near.setdefault(p, []).append((c, w))
        near.setdefault(c, []).append((p, w))
    far, back, todo = {start: 0.0}, {start: -1}, [start]
    while todo:
        x = todo.pop()
        for y, w in near.get(x, ()):
            if y not in far:
                far[y], back[y] = far[x] + w, x
                todo.append(y)
    return far, back


def midpoint_root(tree: Tree) -> Tree:
    """Rooted in the middle of the longest path between tips."""
    n = len(tree.tips)
    far, _ = _reach(tree, 0)
    a = max(range(n), key=lambda t: (far[t], -t))
    far, back = _reach(tree, a)
    b = max(range(n), key=lambda t: (far[t], -t))
    half, x = far[b] / 2, b
    while back[x] != -1 and far[back[x]] > half:
        x = back[x]
    up, new = back[x], max(max(p, c) for p, c, _ in tree.edges) + 1
    if up == -1:
        return tree
    edges = [(p, c, w) for p, c, w in tree.edges if {p, c} != {up, x}] + [(new, x, far[x] - half), (new, up, half - far[up])]
    split = Tree(tree.tips, edges, new)
    far, back = _reach(split, new)
    size = {frozenset((p, c)): w for p, c, w in edges}
    return Tree(tree.tips, [(p, c, size[frozenset((p, c))]) for c, p in back.items() if p != -1], new)


def _down(root: int, kids: dict[int, list]) -> list[int]:
    """Nodes from ``root`` on, each before its children and these in order; no recursion, however deep the tree."""
    out, left = [], [root]
    while left:
        x = left.pop()
        out.append(x)
        left += [c for c, _ in reversed(kids.get(x, []))]
    return out


def clusters(names: list[str], d: np.ndarray, k: int) -> dict[str, int]:
    """Cluster number (from 1, by first member) of each sample: average linkage cut into k."""
    return cut(upgma(names, d), k)


def cut(tree: Tree, k: int) -> dict[str, int]:
    """Cluster number (from 1, by first member) of each tip: a tree of average linkage cut into k."""
    names, kids, groups = tree.tips, tree.children(), [tree.root]
    while len(groups) < min(k, len(names)):
        x = max(groups)  # later merges are higher
        if x < len(names):
            break
        groups.remove(x)
        groups += [c for c, _ in kids[x]]

    def tips(x: int) -> list[int]:
        return [y for y in _down(x, kids) if y < len(names)]

    return {names[t]: g for g, members in enumerate(sorted(sorted(tips(x)) for x in groups), 1) for t in members}


def newick(tree: Tree, digits: int = 6) -> str:
    """Post-order string; names with special characters are quoted."""
    kids = tree.children()

    def name(s: str) -> str:
        return "'" + s.replace("'", "''") + "'" if any(c in s for c in " ()[]:;,'\"") else s

    text: dict[int, str] = {}
    for x in reversed(_down(tree.root, kids)):  # children before their parents
        if x < len(tree.tips):
            text[x] = name(tree.tips[x])
        else:
            text[x] = "(" + ",".join(f"{text.pop(c)}:{float(f'{w:.{digits}g}'):g}" for c, w in kids[x]) + ")"
    return text[tree.root] + ";"


def coordinates(tree: Tree) -> list[tuple[int, float, float, int]]:
    """(node, depth, y, tips below): ladderised, tips at whole ranks, inner nodes in the middle of their children."""
    kids = tree.children()

    size: dict[int, int] = {}
    for x in reversed(_down(tree.root, kids)):
        size[x] = sum(size[c] for c, _ in kids[x]) if x in kids else 1
    kids = {x: sorted(some, key=lambda e: (size[e[0]], e[0])) for x, some in kids.items()}
    order, depth, y = _down(tree.root, kids), {tree.root: 0.0}, {}
    for x in order:
        for c, w in kids.get(x, ()):
            depth[c] = depth[x] + w
    y = {x: float(rank) for rank, x in enumerate((x for x in order if x not in kids), 1)}
    for x in reversed(order):
        if x in kids:
            y[x] = (min(y[c] for c, _ in kids[x]) + max(y[c] for c, _ in kids[x])) / 2
    out = [(x, depth[x], y[x], size[x]) for x in order]
    return sorted(out)
