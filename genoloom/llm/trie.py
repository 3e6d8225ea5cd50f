"""Prefix trie of conversations by most-significant-digit radix partitioning over dictionary-encoded turns.

Turns (role, text) get ids from a dictionary keyed by their SHA-256, so a conversation is an array of ids. Equal conversations are one row
with a count. All rows start in one bucket; a bucket of more than ``local`` turns emits its trie nodes down to where its rows part
(the common prefix of its least and greatest row) and is dealt anew by the next id, in as many rounds as it takes. A bucket within ``local``, or of one row,
is finished in its task by multikey quicksort, whose recursion emits a node a step. Leaves and saved tokens of the large buckets' nodes are then
summed over their children, round by round upwards.

No bucket over ``local`` turns but a single conversation meets in one task; a conversation's ids and lengths are one row (16 bytes a turn). The ids of members that end
at a node are joined in chunks where a range sort by (conversation, id) left them, and only the finished chunks, in order, pass through the one hash that
the digest asks for.

Null role or text counts as empty. Null turn comes first; rows of one turn number go by their digests, and repeated rows are turns of their own. Rows without
conv_id belong to no conversation. A conversation without turns is a member of the root. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import materialize, trim

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
CHUNK = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): each conversation's turns in order as dictionary ids, and the UTF-8 bytes of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("d"), F.octet_length(text).cast("long").alias("size"))
    rows = materialize(rows, "turns")
    dictionary = materialize(rows.select("d").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    rows = rows.join(dictionary, "d")
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "id", "size"))).alias("t"))
    return own.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(convs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """``convs`` (of :func:`encoded`) with their first h turns taken from conversation c - c % family, h = crc32(decimal c) % most."""
    h = F.expr(f"cast(crc32(cast(conv_id as string)) % {most} as int)")
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("donor"), F.slice("ids", 1, most).alias("hi"), F.slice("sizes", 1, most).alias("hs"))
    both = convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % family).join(heads, "donor", "left").withColumn("h", h)

    def spliced(head: str, own: str) -> Column:
        return F.expr(f"concat(coalesce(slice({head}, 1, h), cast(array() as array<bigint>)), slice({own}, h + 1, greatest(size({own}) - h, 0)))")

    return both.select("conv_id", spliced("hi", "ids").alias("ids"), spliced("hs", "sizes").alias("sizes"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key in rows sorted by (key, conv_id): key, first id, how many, their decimals comma-joined."""
    key, ids, room = None, [], CHUNK // 8
    out: list[tuple] = []

    def close() -> None:
        out.append((key, ids[0], len(ids), ",".join(map(str, ids))))

    def batch() -> pa.RecordBatch:
        k, first, n, text = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string())], ["sk", "first", "n", "part"])

    for rows in batches:
        for k, c in zip(rows.column("sk").to_pylist(), rows.column("conv_id").to_pylist(), strict=True):
            if k != key or len(ids) >= room:
                if ids:
                    close()
                key, ids = k, []
                if len(out) >= 4096 or sum(len(x[3]) for x in out[-1:]) > CHUNK // 4:
                    yield batch()
                    out = []
            ids.append(c)
    if ids:
        close()
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a key of chunks sorted by (key, first): least id, count, SHA-256 of the chunks joined."""
    key, least, n, state = None, 0, 0, None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        k, m, c, sha = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(m, pa.int64()), pa.array(c, pa.int64()), pa.array(sha, pa.string())], ["sk", "m", "n", "sha"])

    for rows in batches:
        for k, first, c, part in zip(*(rows.column(x).to_pylist() for x in ("sk", "first", "n", "part")), strict=True):
            if k != key:
                if state:
                    out.append((key, least, n, state.hexdigest()))
                    if len(out) >= 4096:
                        yield batch()
                        out = []
                key, least, n, state = k, first, 0, hashlib.sha256()
            else:
                state.update(b",")
            state.update(part.encode())
            n += c
    if state:
        out.append((key, least, n, state.hexdigest()))
    if out:
        yield batch()


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(m, n, sha, ids, sizes): each different sequence of ``convs`` once, with its least conv_id, its count, and the digest of all its conv_ids."""
    convs = materialize(convs.withColumn("sk", F.unhex(F.sha2(F.array_join("ids", ","), 256))), "sequences")
    runs = convs.select("sk", "conv_id").repartitionByRange("sk", "conv_id").sortWithinPartitions("sk", "conv_id").mapInArrow(_chunks, "sk binary, first long, n long, part string")
    classes = runs.repartition("sk").sortWithinPartitions("sk", "first").mapInArrow(_hashed, "sk binary, m long, n long, sha string")
    # by conv_id, which is unique on either side, so that no class's copies meet
    return classes.drop("sk").join(convs.select(F.col("conv_id").alias("m"), "ids", "sizes"), "m")


class _Nodes:
    """Nodes of one bucket at a time; children come after their parents."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.sha: list[str] = []
        self.tops: list[tuple] = []
        self.rows = 0

    def finish(self, rows: list[tuple], depth: int, above: int | None, parent: bytes | None) -> None:
        """All nodes from ``depth`` on of ``rows`` (m, n, sha, ids, sizes), which share their first ``depth`` ids."""
        nodes: list[list] = []  # conv, depth, parent conv, n, children, leaves, saved, parent's index
        shas: list[str] = []
        chains: list[tuple[int, tuple, int, int | None]] = []
        stack: list[tuple[list, int, int, int | None]] = [(rows, depth, -1, above)]
        while stack:
            group, d, up, top = stack.pop()
            if len(group) == 1:  # a path without branches
                chains.append((up, group[0], d, top))
                continue
            least = min(r[0] for r in group)
            n, size = sum(r[1] for r in group), group[0][4][d - 1] if d else 0
            at = len(nodes)
            nodes.append([least, d, top, n, 0, 0, (n - 1) * size, up])
            ends = [r for r in group if len(r[3]) == d]  # one at most: sequences differ
            shas.append(ends[0][2] if ends else NO_ENDS)
            work = [[r for r in group if len(r[3]) > d] if ends else group]
            while work:  # multikey quicksort: three ways by the id at d
                part = work.pop()
                pivot = part[len(part) // 2][3][d]
                less, same, more = [], [], []
                for r in part:
                    x = r[3][d]
                    (same if x == pivot else less if x < pivot else more).append(r)
                nodes[at][4] += 1
                stack.append((same, d + 1, at, least))
                work += [p for p in (less, more) if p]
        leaves = saved = 0
        for up, (m, n, sha, ids, sizes), d, top in chains:
            length = len(ids) + 1 - d
            own = (n - 1) * np.array([0, *sizes][d:], np.int64)
            total = np.cumsum(own[::-1])[::-1]
            table = np.empty((length, 7), np.int64)
            table[:, 0], table[:, 1], table[:, 3], table[:, 4], table[:, 5], table[:, 6] = m, np.arange(d, d + length), n, 1, 1, total
            table[:, 2], table[-1, 4] = m, 0
            table[0, 2] = -1 if top is None else top
            self.parts.append([table, np.array([top is None] + [False] * (length - 1))])
            self.sha += [NO_ENDS] * (length - 1) + [sha]
            self.rows += length
            if up < 0:
                leaves, saved = 1, int(total[0])
            else:
                nodes[up][5] += 1
                nodes[up][6] += int(total[0])
        for node in reversed(nodes):
            if node[7] >= 0:
                nodes[node[7]][5] += node[5]
                nodes[node[7]][6] += node[6]
        if nodes:
            leaves, saved = nodes[0][5], nodes[0][6]
            self.parts.append([np.array([[-1 if x is None else x for x in node[:7]] for node in nodes], np.int64), np.array([node[2] is None for node in nodes])])
            self.sha += shas
            self.rows += len(nodes)
        self.tops.append((parent, leaves, saved))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The nodes, and one row for each bucket's top: its parent bucket, leaves and saved tokens."""
        if not self.tops:
            return
        table = np.concatenate([p[0] for p in self.parts])
        none = np.concatenate([p[1] for p in self.parts])
        cols = [pa.array(table[:, i], mask=none if i == 2 else None) for i in range(7)]
        for at in range(0, len(table), 8192):
            part = [c.slice(at, 8192) for c in cols]
            yield pa.RecordBatch.from_arrays([*part, pa.array(self.sha[at : at + 8192]), pa.nulls(len(part[0]), pa.binary()), pa.array([False] * len(part[0]))], TOPPED)
        parent, leaves, saved = zip(*self.tops, strict=True)
        k = len(parent)
        none = [pa.nulls(k, pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*none, pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), pa.nulls(k, pa.string()), pa.array(parent, pa.binary()), pa.array([True] * k)], TOPPED)


TOPPED = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent", "top"]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: each bucket's nodes, and its top."""
    names = ("b", "parent", "d", "above", "m", "n", "sha", "ids", "sizes")
    key, rows, out = None, [], _Nodes()
    depth = above = parent = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for b, p, d, a, *row in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if b != key:
                    if rows:
                        out.finish(rows, depth, above, parent)
                    if out.rows >= 16384:
                        yield from out.batches()
                        out = _Nodes()
                    key, rows, depth, above, parent = b, [], d, a, p
                rows.append(tuple(row))
    if rows:
        out.finish(rows, depth, above, parent)
    yield from out.batches()
    trim()


def _chain(spine: DataFrame) -> DataFrame:
    """The nodes of large buckets: depth d to l, all with the same members; the last one branches."""
    each = spine.withColumn("x", F.explode(F.expr("sequence(d, l)")))
    return each.select(
        F.col("least").alias("conv_id"), F.col("x").cast("long").alias("depth"), F.expr("if(x = d, above, least)").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.expr("if(x = l, children, 1L)").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.expr("saved + aggregate(if(x <= l, sequence(x, l), array()), 0L, (s, y) -> s + (n - 1) * if(y = 0, 0, element_at(sizes, y)))").alias("saved_tokens"),
        F.expr(f"if(x = l, coalesce(sha, '{NO_ENDS}'), '{NO_ENDS}')").alias("ends_sha256"),
    )


def prefix_trie(convs: DataFrame, local: int = 1 << 14, most_rounds: int = 10_000) -> DataFrame:
    """The nodes of the prefix trie of ``convs`` (conv_id, ids, sizes), columns as in ``NODE``."""
    rows = distinct_sequences(convs).select(F.unhex(F.lit("00")).alias("b"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("d"), F.lit(None).cast("long").alias("above"), "m", "n", "sha", "ids", "sizes")
    rows, spines, small = materialize(rows, "bucket"), [], []
    for _ in range(most_rounds):
        stats = rows.groupBy("b").agg(F.count("*").alias("k"), F.sum(F.size("ids") - F.col("d")).alias("left"), F.min("m").alias("least"), F.sum("n").alias("total"), F.min("ids").alias("lo"), F.max("ids").alias("hi"))
        part = F.expr("coalesce(array_position(zip_with(lo, hi, (a, b) -> not (a <=> b)), true), 0)")  # 1-based place where they part; the least is a prefix of the others or differs
        stats = stats.withColumn("l", F.when(F.col("k") > 1, part - 1)).select("b", "k", "left", "least", "total", F.col("l").cast("int").alias("l"))
        large = materialize(stats.where((F.col("k") > 1) & (F.col("left") > local)), "large")
        if large.isEmpty():
            small.append(rows)
            break
        held = rows.join(large, "b", "left")  # AQE splits a bucket's rows; a few rows are on the right
        small.append(rows.join(large.select("b"), "b", "left_anti"))
        held = materialize(held.where("l is not null"), "held")
        # the row of the least conversation lends its sizes; the row that ends where the others part, its digest
        spine = held.where("m = least").select("b", "parent", "d", "l", "above", "least", F.col("total").alias("n"), F.slice("sizes", F.lit(1), F.col("l")).alias("sizes"))
        ends = held.where("size(ids) = l").select("b", "sha")
        spines.append(materialize(spine.join(ends, "b", "left"), "spine"))
        deeper = held.where("size(ids) > l")
        child = F.unhex(F.md5(F.concat(F.hex("b"), F.lit("/"), F.element_at("ids", F.col("l") + 1).cast("string")).cast("binary")))
        rows = materialize(deeper.select(child.alias("b"), F.col("b").alias("parent"), (F.col("l") + 1).alias("d"), F.col("least").alias("above"), "m", "n", "sha", "ids", "sizes"), "bucket")
    else:
        raise RuntimeError("buckets did not become small")
    todo = small[0]
    for part in small[1:]:
        todo = todo.unionByName(part)
    made = todo.repartition("b").sortWithinPartitions("b").mapInArrow(_finished, f"{NODE}, parent binary, top boolean")
    if not spines:
        return made.where("not top").drop("parent", "top")
    made = materialize(made, "nodes")
    tops = made.where("top and parent is not null").select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    nodes = made.where("not top").drop("parent", "top")
    for spine in reversed(spines):
        summed = tops.groupBy(F.col("parent").alias("b")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        full = materialize(spine.join(summed, "b"), "spine")
        chain = _chain(full)
        nodes = nodes.unionByName(chain)
        up = chain.join(full.select(F.col("least").alias("conv_id"), F.col("d").cast("long").alias("depth"), "parent"), ["conv_id", "depth"])
        tops = tops.unionByName(up.where("parent is not null").select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    return nodes


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(encoded(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: The query's rows in DuckDB's SQL; its crc32 is the bitwise one, folded over a list of bytes (0 to 255) and shifts (-1).
ORACLE_SQL = """WITH own AS (SELECT conv_id, list({'d': md5(coalesce(role, '') || chr(31) || coalesce(text, '')), 's': strlen(coalesce(text, ''))} ORDER BY turn NULLS FIRST, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(d.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own d ON d.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, unnest(range(0, len(t) + 1)) AS depth, t FROM r),
m AS (SELECT conv_id, depth, len(t) AS len, CASE WHEN depth > 0 THEN t[depth].s ELSE 0 END AS s, array_to_string(list_transform(t[1:depth], lambda x: x.d), '') AS k, array_to_string(list_transform(t[1:depth - 1], lambda x: x.d), '') AS up FROM p),
n AS (SELECT k, depth, any_value(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(s) AS s, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth) AS ends FROM m GROUP BY k, depth),
c AS (SELECT up AS k, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c USING (k)),
a AS (SELECT k, depth, unnest(range(0, depth + 1)) AS d, n_children, (n_convs - 1) * s AS saved FROM w),
b AS (SELECT substr(k, 1, d * 32) AS k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY ALL)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN b USING (k) LEFT JOIN n q ON q.k = w.up"""
