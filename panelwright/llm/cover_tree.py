"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Equal vectors become one node with a multiplicity. A cover tree over a bounded sample (nested
levels, radii halved from level to level) is the top of the tree of all vectors: every vector goes
down it, to the nearest centre at each level, and ends in a leaf, a unit of bounded size; covering
radii are the true maxima over all members, at every level. A vector meets the units that it
reaches when it goes down again, past every node whose ball is within its reach, so units are
pruned level by level; two units meet in one task with those members that reach the other. A task
builds a cover tree over each side and walks both at once: node pairs farther apart than their
radii and the threshold allow are pruned, pairs that lie wholly within the threshold are linked
without looking at their points, leaves are compared: in single precision with a margin, what
comes near the threshold again in double. Tasks return link counts and a spanning forest, never
all pairs; after the first aggregation only ids and results are joined, no vectors.

The join is exact for any data. How much is pruned depends on the data's intrinsic dimension: where
distances concentrate a level has more centres than a node may have children (``FANOUT``); the rest
then goes to the nearest centre under its true radius, so radii no longer halve, most units meet and
the work tends to all pairs, in bounded blocks. A leaf that is still too large (more vectors than a
unit in one small ball) is dealt into parts that all meet.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are a component of their own; vectors of different lengths do not link; repeated rows
are counted each; a null vec_id is largest when components are named; an empty table gives no rows;
other columns are ignored, whatever their names. Vectors are known by two 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import connected_components, materialize, merge_labels, shuffle_partitions, table
from panelwright.llm.memo import spread

MIN_COSINE = 0.95
#: Vectors of a unit, at most about; sample vectors for each unit, and in all, at least and at most.
UNIT, PER_UNIT, LEAST_SAMPLE, MOST_SAMPLE = 16_384, 24, 2048, 65_536
LEAF, FANOUT, SLACK, LINKS_AT_ONCE = 256, 64, 1e-9, 1_000_000
#: What single precision may be off by in a product of unit vectors of a thousand components, and more.
MARGIN = 1e-4
MOST_TASKS = 200_000


class CoverTree:
    """Nodes over a reordering of the points; node k covers points[start[k]:stop[k]] within radius[k] of centre[k]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.order, self.leaf, self.fanout = np.arange(len(points)), leaf, fanout
        self.points = points
        nodes: list[tuple[int, int, int, float, int, int]] = []
        if len(points):
            self._build(points, nodes)
        cols = list(zip(*nodes)) if nodes else [()] * 6
        self.start, self.stop, self.centre = (np.array(c, np.int64) for c in cols[:3])
        self.radius = np.array(cols[3], float)
        self.child, self.children = (np.array(c, np.int64) for c in cols[4:])
        self.points = points[self.order]
        self.single = self.points.astype(np.float32)
        self.centres = points[self.centre] if nodes else points[:0]

    def nodes_below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of all nodes, one node's after the other, and how many each has."""
        n = self.children[nodes]
        return np.repeat(self.child[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), n

    def _build(self, x: np.ndarray, nodes: list) -> None:
        def distance(c: int, idx: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, ((x[idx] - x[c]) ** 2).sum(axis=1)))

        nodes.append((0, len(x), 0, float(distance(0, self.order).max()), 0, 0))
        queue, level = [0], {0: 2.0}
        while queue:
            at = queue.pop()
            start, stop, c, radius, _, _ = nodes[at]
            if stop - start <= self.leaf or radius == 0:
                continue
            half = min(level.pop(at), 2.0)
            while half > radius:
                half /= 2
            rest, parts, centres = self.order[start:stop], [], []
            nxt = c  # levels are nested: a node is its own first child
            most = min(self.fanout, -(-2 * len(rest) // self.leaf))
            while len(rest) and len(parts) < most:
                d = distance(nxt, rest)
                near = d <= half
                parts.append(rest[near])
                centres.append(nxt)
                rest = rest[~near]
                nxt = int(rest[0]) if len(rest) else -1
            if len(rest):  # a net of too many points: the others go to the nearest, under their true radius
                mine = (x[rest] @ x[centres].T).argmax(axis=1)
                parts = [np.concatenate([p, rest[mine == k]]) for k, p in enumerate(parts)]
            if len(parts) == 1:
                level[at] = half / 2
                queue.append(at)
                continue
            first, pos = len(nodes), start
            for cc, p in zip(centres, parts):
                self.order[pos : pos + len(p)] = p
                nodes.append((pos, pos + len(p), cc, float(distance(cc, p).max()), 0, 0))
                level[len(nodes) - 1] = half / 2
                queue.append(len(nodes) - 1)
                pos += len(p)
            nodes[at] = (start, stop, c, radius, first, len(parts))


def dual_links(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, least: float = MIN_COSINE, same: bool = False):
    """Linked weight of every point of both trees (in tree order) and the classes that links make of them.

    ``wa``, ``wb``: weights in tree order. ``same``: b is a, and pairs of one point count no more than once.
    """
    t, near = float(np.sqrt(2 - 2 * least)), np.float32(least - MARGIN)
    na, nb = len(a.points), 0 if same else len(b.points)
    ca, cb = np.zeros(na, np.int64), np.zeros(len(b.points), np.int64)
    if same:
        cb = ca
    labels, off = np.arange(na + nb), 0 if same else na
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def link(u: np.ndarray, v: np.ndarray) -> None:
        """Unions are merged many at a time; what waits is bounded."""
        nonlocal labels, waiting
        held.append((u, v))
        waiting += len(u)
        if waiting > LINKS_AT_ONCE:
            flush()

    def flush() -> None:
        nonlocal labels, waiting
        if held:
            labels = merge_labels(labels, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
        waiting = 0

    waiting = 0
    if not na or not len(b.points):
        return ca, cb, labels
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(a.centres @ b.centres.T, -1, 1)))
    sum_a, sum_b = np.append(0, np.cumsum(wa)), np.append(0, np.cumsum(wb))
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(p):
        d, r = apart[p, q], a.radius[p] + b.radius[q]
        open_ = d <= r + t + SLACK
        p, q, d, r = p[open_], q[open_], d[open_], r[open_]
        whole = d + r <= t - SLACK
        for i, j in zip(p[whole], q[whole]):
            sa, ea, sb, eb = a.start[i], a.stop[i], b.start[j], b.stop[j]
            if same and i == j:
                ca[sa:ea] += sum_a[ea] - sum_a[sa] - wa[sa:ea]
                link(np.arange(sa, ea), np.full(ea - sa, sa))
            else:
                ca[sa:ea] += sum_b[eb] - sum_b[sb]
                cb[sb:eb] += sum_a[ea] - sum_a[sa]
                link(np.concatenate([np.arange(sa, ea), np.arange(sb, eb) + off]), np.concatenate([np.full(ea - sa, sb + off), np.full(eb - sb, sa)]))
        p, q = p[~whole], q[~whole]
        leaf = (a.children[p] == 0) & (b.children[q] == 0)
        for i, j in zip(p[leaf], q[leaf]):
            sa, ea, sb, eb = a.start[i], a.stop[i], b.start[j], b.stop[j]
            u, v = np.divmod(np.flatnonzero((a.single[sa:ea] @ b.single[sb:eb].T).ravel() >= near), eb - sb)
            if same and i == j:
                u, v = u[u < v], v[u < v]
            if len(u):
                hit = np.einsum("ij,ij->i", a.points[u + sa], b.points[v + sb]) >= least
                u, v = u[hit] + sa, v[hit] + sb
                np.add.at(ca, u, wb[v])
                np.add.at(cb, v, wa[u])
                link(u, v + off)
        p, q = p[~leaf], q[~leaf]
        if not len(p):
            break
        twin = same & (p == q)
        down_a = ~twin & (a.children[p] > 0) & ((b.children[q] == 0) | (a.radius[p] >= b.radius[q]))
        down_b = ~twin & ~down_a
        twins = [np.triu_indices(a.children[i]) for i in p[twin]]
        first, more_a = a.nodes_below(p[down_a])
        second, more_b = b.nodes_below(q[down_b])
        next_p = [a.child[i] + u for i, (u, _) in zip(p[twin], twins)] + [first, np.repeat(p[down_b], more_b)]
        next_q = [a.child[i] + v for i, (_, v) in zip(p[twin], twins)] + [np.repeat(q[down_a], more_a), second]
        p, q = np.concatenate(next_p), np.concatenate(next_q)
        if same:
            p, q = np.minimum(p, q), np.maximum(p, q)
    flush()
    return ca, cb, labels


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reached(tree: CoverTree, radius: np.ndarray, x: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf whose ball a vector reaches, going down level by level."""
    rows, leaves = [], []
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        node, at = waiting.pop()
        d = np.sqrt(np.maximum(0.0, 2 - 2 * x[at] @ tree.centres[node]))
        at = at[d <= radius[node] + t + SLACK]
        if not len(at):
            continue
        if tree.children[node]:
            waiting += [(k, at) for k in range(tree.child[node], tree.child[node] + tree.children[node])]
        else:
            rows.append(at)
            leaves.append(np.full(len(at), node))
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64),) * 2


def placed(tree: CoverTree, x: np.ndarray) -> tuple[np.ndarray, list[dict[int, float]]]:
    """The leaf of every vector, and per leaf the farthest member from each centre on the way."""
    leaf, far = np.zeros(len(x), np.int64), []
    waiting = [(0, np.arange(len(x)), ())]
    while waiting:
        node, at, way = waiting.pop()
        way = (*way, node)
        if tree.children[node]:
            first, n = tree.child[node], tree.children[node]
            mine = (x[at] @ tree.centres[first : first + n].T).argmax(axis=1)
            waiting += [(first + k, at[mine == k], way) for k in range(n) if (mine == k).any()]
        elif len(at):
            leaf[at] = node
            far += [(node, k, float(np.sqrt(max(0.0, 2 - 2 * (x[at] @ tree.centres[k]).min())))) for k in way]
    return leaf, far


def joined(nodes: DataFrame, dim: int, n: int, least: float, unit: int) -> DataFrame:
    """(a, b, n): b null gives the linked weight n of node a, else an edge of a spanning forest."""
    spark = nodes.sparkSession
    want = min(n, MOST_SAMPLE, max(LEAST_SAMPLE, PER_UNIT * n // unit))
    sample = nodes.select("embedding").orderBy(F.xxhash64("node")).limit(want).toArrow()  # bounded
    top = CoverTree(unit_rows(sample.column("embedding"), dim), max(1, len(sample) * unit // n) if n > unit else len(sample))
    top.points = top.single = np.zeros((0, dim))  # only the centres go to the tasks
    t, kind = float(np.sqrt(2 - 2 * least)), nodes.schema["embedding"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            leaf, _ = placed(top, unit_rows(b.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], [*b.schema.names, "leaf"])

    def measure(batches):
        size, far = {}, {}
        for b in batches:
            leaf, more = placed(top, unit_rows(b.column("embedding"), dim))
            for k, m in zip(*np.unique(leaf, return_counts=True)):
                size[int(k)] = size.get(int(k), 0) + int(m)
            for _, k, d in more:
                far[int(k)] = max(far.get(int(k), 0.0), d)
        rows = [(k, size.get(k, 0), far.get(k, -9.0)) for k in {*size, *far}]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["at", "n", "far"])

    stats = nodes.select("embedding").mapInArrow(measure, "at int, n long, far double").groupBy("at").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()  # nodes of the bounded top tree
    radius, members = np.full(len(top.start), -9.0), np.zeros(len(top.start), np.int64)
    for r in stats:
        radius[r["at"]], members[r["at"]] = r["far"], r["n"]
    parts = -(-members // (2 * unit))  # as a rule one: a leaf of more than two units is dealt into parts
    first = np.cumsum(parts) - parts

    def pairs(batches):
        for b in batches:
            x, leaf, node = unit_rows(b.column("embedding"), dim), b.column("leaf").to_numpy(), b.column("node").to_numpy()
            own = first[leaf] + (node * 0x9E3779B1 >> 7) % parts[leaf]
            row, to = reached(top, radius, x, t)
            order = np.argsort(row, kind="stable")
            row, to = row[order], to[order]
            reps = parts[to]
            other = spread(first[to], reps)
            count = np.bincount(np.repeat(row, reps), minlength=len(x))
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), pa.array(other.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("weight"), b.column("embedding"), pa.array(own.astype(np.int64)), lists], ["node", "weight", "embedding", "own", "others"])

    dealt = nodes.mapInArrow(assign, f"node long, weight long, embedding {kind}, leaf int").mapInArrow(pairs, f"node long, weight long, embedding {kind}, own long, others array<long>")
    dealt = dealt.withColumn("other", F.explode("others")).drop("others")
    dealt = dealt.select(F.least("own", "other").alias("u"), F.greatest("own", "other").alias("w"), "own", "node", "weight", "embedding")

    def join(key, tbl):
        u, w = (k.as_py() for k in key)
        own, node, weight = (tbl.column(c).to_numpy() for c in ("own", "node", "weight"))
        x = unit_rows(tbl.column("embedding"), dim)
        side = [np.flatnonzero(own == u)] if u == w else [np.flatnonzero(own == u), np.flatnonzero(own == w)]
        trees = [CoverTree(x[s]) for s in side]
        at = [s[tr.order] for s, tr in zip(side, trees)]
        ca, cb, labels = dual_links(trees[0], trees[-1], weight[at[0]], weight[at[-1]], least, u == w)
        ids = np.concatenate([node[s] for s in at])
        count = ca if u == w else np.concatenate([ca, cb])
        has, child = np.flatnonzero(count), np.flatnonzero(labels != np.arange(len(labels)))
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"a": np.concatenate([ids[has], ids[child]]), "b": pa.chunked_array([none(len(has)), pa.array(ids[labels[child]], pa.int64())]), "n": pa.chunked_array([pa.array(count[has]), none(len(child))])})

    # As many tasks as all pairs of units fill at 32 a task, were none pruned, within what a scheduler takes; keys beyond share a task one after the other.
    tasks = min(shuffle_partitions(spark, int(parts.sum()) * (int(parts.sum()) + 1) // 2, 32), MOST_TASKS)
    return dealt.repartition(tasks, "u", "w").groupBy("u", "w").applyInArrow(join, "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = MIN_COSINE, unit: int = UNIT) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # as it is stored; compared in double
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    key = F.when(good, F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(7), "embedding").alias("y")))
    rows = rows.withColumn("key", key)
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.any_value("embedding").alias("embedding"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    dims = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}  # lengths of vectors
    found = [joined(nodes.where(F.size("embedding") == dim).select("node", "weight", "embedding"), dim, n, least, unit) for dim, n in dims.items()]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = materialize(reduce(DataFrame.union, found), "vector-links")
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = connected_components(links.where("b is not null"))
    # Only vectors with a link have an entry; all others are alone with their copies.
    linked = nodes.select("key", "node", "first", "weight").join(comp, "node")
    linked = materialize(linked.join(counts, "node", "left"), "vector-linked")
    least_id = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(least_id, "component").select("key", F.coalesce("n", F.lit(0)).alias("more"), "component_id")
    own = nodes.select("key", "first", "weight").join(named, "key", "left")
    own = own.select("key", (F.coalesce("more", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(F.col("component_id").isNull() & F.col("more").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.select("vec_id", "key").join(own, "key", "left")
    none = F.col("key").isNull()
    out = out.select("vec_id", F.when(none, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"), F.when(none, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE list_cosine_similarity(p.v, q.v) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT x.vec_id, (SELECT count(*) FROM pairs WHERE a = x.vec_id) AS n_links, component_id, x.vec_id = component_id AS kept
FROM embeddings x JOIN comp ON comp.a = x.vec_id
"""

QUERIES = {"op1_cover_tree": op1_cover_tree}
ORACLES = {"op1_cover_tree": ORACLE}
