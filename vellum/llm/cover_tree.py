"""Embedding near-dedup: exact cosine threshold pairs by dual traversal of cover trees.

On unit vectors cosine >= t is Euclidean distance <= sqrt(2 - 2t). A cover tree holds nested levels whose radii halve:
each node's points lie within its radius of its centre, and its children's centres cover them at half that radius. Two
trees are walked together. A pair of nodes further apart than the threshold plus both covering radii is dropped; a pair
that even at its widest is within the threshold links all its points at once, as counts; only what remains is split
further, and points are compared by their cosine in double precision at the leaves.

Equal vectors are collapsed first, under a key of their own. Vectors are compared within a label. Labels of more than
`CELL` distinct vectors are cut into cells around pivots, a hash sample of the label's vectors: a vector belongs to its
nearest pivot's cell, and is also shown to every cell whose boundary with its own lies within the threshold, so a cell
sees all partners of its own vectors. The queries and the references of a dense cell are dealt into parts of about CELL,
and each pair of parts is a task. A task returns, per query, the weight of its links and one edge to its local
component, and that edge alone for each linked reference, never the pairs; weights are then added and components joined
over all tasks.

Defined cases: null, empty or zero vectors, and those with null or non-finite components, link with nothing; so do
those whose label is null; vectors of different length are never compared; an empty table gives no rows; rows that
repeat a vec_id are vectors of their own, each with a row; a row without vec_id counts as a partner, its component is
the smallest vec_id it reaches or else null, and it is kept only in the latter case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import components, drop, join_with_hot_keys, stash

THRESHOLD = 0.93
CELL, MOST_PIVOTS, LEAF, SPLIT = 10_000, 1024, 24, 1024
#: Pairs of points compared at a time.
PAIRS = 100_000
EPS = 1e-9
#: More than matrix products lose in a distance; and centres picked at a time.
SLACK, BLOCK = 1e-6, 256


@dataclass
class Node:
    centre: np.ndarray
    points: np.ndarray  # indices
    radius: float  # covering radius: the furthest of its points
    level: float  # what its parent's level allows
    children: list[Node] | None = None
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


class CoverTree:
    """Nested levels of halving radii over the rows of x, built from the root as far as a traversal asks."""

    def __init__(self, x: np.ndarray, points: np.ndarray | None = None):
        self.x = x
        points = np.arange(len(x)) if points is None else points
        centre = x[points[0]]
        self.root = Node(centre, points, float(_distances(centre[None], x[points]).max()) + SLACK, 2.0)

    def split(self, node: Node) -> list[Node]:
        """The node's children: centres picked greedily, each covering what lies within half the level's radius.

        Centres are picked a block at a time, so that distances are matrix products; their rounding is in SLACK, which
        every radius includes."""
        if node.children is None:
            level = node.level
            while level >= 2 * node.radius and level > SLACK:
                level /= 2
            level /= 2
            left, made = node.points, []
            while len(left):
                block = self.x[left[:BLOCK]]
                near, picked = _distances(block, block) <= level, []
                covered = np.zeros(len(block), dtype=bool)
                for i in range(len(block)):
                    if not covered[i]:
                        picked.append(i)
                        covered |= near[i]
                        covered[i] = True
                far = _distances(block[picked], self.x[left])
                close = far <= level
                close[np.arange(len(picked)), picked] = True
                owner, owned = close.argmax(0), close.any(0)
                mine, of = left[owned], owner[owned]
                reach = far[of, np.flatnonzero(owned)]
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(len(picked) + 1))
                for i, c in enumerate(picked):
                    own = order[cuts[i] : cuts[i + 1]]
                    made.append(Node(block[c], mine[own], float(reach[own].max()) + SLACK, level))
                left = left[~owned]
            node.children = made
            node.centres = np.stack([c.centre for c in made])
            node.radii = np.array([c.radius for c in made])
        return node.children

    @staticmethod
    def is_leaf(node: Node) -> bool:
        return len(node.points) <= LEAF or node.radius <= 2 * SLACK


class Links:
    """What a traversal finds: weighted link counts of the queries, and components over all points."""

    def __init__(self, n: int, weight: np.ndarray):
        self.count, self.weight, self.parent = np.zeros(n, dtype=np.int64), weight, list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def pairs(self, q: np.ndarray, r: np.ndarray) -> None:
        np.add.at(self.count, q, self.weight[r])
        root = np.array(self.parent)
        while (root != root[root]).any():
            root = root[root]
        apart = np.unique(np.stack([root[q], root[r]]), axis=1)
        for i, j in apart[:, apart[0] != apart[1]].T.tolist():
            self.union(i, j)

    def all_of(self, q: np.ndarray, r: np.ndarray) -> None:
        self.count[q] += int(self.weight[r].sum())
        for i in r[1:].tolist():
            self.union(int(r[0]), i)
        for i in q.tolist():
            self.union(int(r[0]), i)


def dual(queries: CoverTree, refs: CoverTree, links: Links, threshold: float) -> None:
    """Add all links between query and reference points; a point links with itself here too."""
    x, reach = refs.x, float(np.sqrt(2 - 2 * threshold))
    todo = [(queries.root, refs.root)]
    while todo:
        q, r = todo.pop()
        far = float(np.sqrt(((q.centre - r.centre) ** 2).sum()))
        if far - q.radius - r.radius > reach + EPS:
            continue
        if far + q.radius + r.radius < reach - EPS:
            links.all_of(q.points, r.points)
            continue
        q_leaf, r_leaf = queries.is_leaf(q), refs.is_leaf(r)
        if q_leaf and r_leaf:
            hit = x[q.points] @ x[r.points].T >= threshold
            links.count[q.points] += hit @ links.weight[r.points]
            for i in np.flatnonzero(hit.any(1)).tolist():
                for j in r.points[hit[i]].tolist():
                    links.union(int(q.points[i]), j)
            continue
        qs = [q] if q_leaf else queries.split(q)
        rs = [r] if r_leaf else refs.split(r)
        qc, qr = (q.centre[None], np.array([q.radius])) if q_leaf else (q.centres, q.radii)
        rc, rr = (r.centre[None], np.array([r.radius])) if r_leaf else (r.centres, r.radii)
        q_leaves, r_leaves = np.array([queries.is_leaf(c) for c in qs]), np.array([refs.is_leaf(c) for c in rs])
        for a in range(0, len(qs), SPLIT):
            part = qc[a : a + SPLIT]
            near = _distances(part, rc) <= reach + qr[a : a + SPLIT, None] + rr[None] + SLACK
            # pairs of leaves, by far the most where data has few clusters, are decided together
            leaves = near & q_leaves[a : a + SPLIT, None] & r_leaves[None]
            i, j = np.nonzero(leaves)
            _leaf_pairs(qs, rs, a + i, j, x, links, threshold)
            near &= ~leaves
            todo += [(qs[a + i], rs[j]) for i, j in zip(*(z.tolist() for z in np.nonzero(near)), strict=True)]


def _leaf_pairs(qs: list[Node], rs: list[Node], i: np.ndarray, j: np.ndarray, x: np.ndarray, links: Links, threshold: float) -> None:
    """Compare the points of leaf qs[i] with those of leaf rs[j], for all given pairs."""
    if not len(i):
        return
    (q_points, q_n, q_at), (r_points, r_n, r_at) = (
        (np.concatenate([c.points for c in cs]), n, np.cumsum(n) - n) for cs, n in ((qs, np.array([len(c.points) for c in qs])), (rs, np.array([len(c.points) for c in rs])))
    )
    total = np.cumsum(q_n[i] * r_n[j])
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS)))
        qi, rj = i[a:b], j[a:b]
        n = q_n[qi] * r_n[rj]
        pair = np.repeat(np.arange(len(qi)), n)
        off = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        p, q = q_points[q_at[qi][pair] + off // r_n[rj][pair]], r_points[r_at[rj][pair] + off % r_n[rj][pair]]
        hit = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
        links.pairs(p[hit], q[hit])
        a = b


def joined(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(k, weight, other): of each query the weight of its links, itself included, and a vector of its local component.

    A reference that a query links has a row too, for its edge only: its own task need not see the rest of this
    component, so without that edge the link could be in no component."""
    x, k = np.stack(pdf["unit"].to_numpy()).astype(np.float64), pdf["k"].to_numpy()
    asks, known = pdf["query"].to_numpy(), pdf["ref"].to_numpy()
    links = Links(len(x), pdf["copies"].to_numpy())
    if asks.any() and known.any():
        refs = CoverTree(x, np.flatnonzero(known))
        dual(refs if (asks == known).all() else CoverTree(x, np.flatnonzero(asks)), refs, links, threshold)
    root = np.array([links.find(i) for i in range(len(x))], dtype=np.int64)
    told = np.flatnonzero(asks | (root != np.arange(len(x))))
    return pd.DataFrame({"k": k[told], "weight": np.where(asks, links.count, 0)[told], "other": k[root[told]]})


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with a key, null where they can't link, and (k, label, rep, copies, unit): the distinct ones."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, v: a + v * v))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    own = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"), F.xxhash64("embedding").cast("string"), F.xxhash64("embedding", F.lit(7)).cast("string"))
    rows = vectors.select("vec_id", "label", "embedding", norm.alias("norm"), fine.alias("fine"))
    rows = rows.withColumn("k", F.when(F.coalesce(F.col("fine"), F.lit(False)) & (F.col("norm") > 0), own))
    unit = F.transform(F.col("embedding"), lambda v: v.cast("double") / F.col("norm"))
    real = rows.filter("k is not null").withColumn("unit", unit)
    reps = real.groupBy("k", F.col("label").cast("string").alias("label")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    return rows.select("vec_id", "k"), stash(reps, "vectors")


def cells_of(reps: DataFrame, threshold: float) -> DataFrame:
    """reps with cell, task, query and ref: where each vector is compared, and as what."""
    groups = reps.groupBy("label", F.size("unit").alias("dim")).agg(F.count("*").alias("n"), F.min("k").alias("least"))
    big = stash(groups.filter(F.col("n") > CELL), "large_labels")
    n_big = big.count()
    with_dim = reps.withColumn("dim", F.size("unit"))
    flat = with_dim.withColumns({"cell": F.lit(0), "task": F.lit(0), "query": F.lit(True), "ref": F.lit(True)})
    if not n_big:
        return flat
    side = F.broadcast(big) if n_big <= 10_000 else big
    small = flat.join(side, ["label", "dim"], "left_anti")
    rows = with_dim.join(side, ["label", "dim"])
    wanted = F.least(F.ceil(F.col("n") / CELL), F.lit(MOST_PIVOTS))
    chosen = (F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / wanted)) == 0) | (F.col("k") == F.col("least"))
    salts = F.ceil(F.col("n") / CELL).cast("int")
    pivots = rows.filter(chosen).select("label", "dim", "k", "unit", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    pivots = stash(pivots, "pivots")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("k", F.lit(3)), salts).cast("int")).select("label", "dim", "salt", "k", "rep", "copies", "unit")
    reach = float(np.sqrt(2 - 2 * threshold)) + EPS

    def assign(_: tuple, some: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame(columns=["label", "dim", "k", "rep", "copies", "unit", "cell", "home"])
        p = np.stack(around.sort_values("k")["unit"].to_numpy())
        x = np.stack(some["unit"].to_numpy())
        square = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0)
        nearest = square.argmin(1)
        gap = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * p @ p.T, EPS))
        shown = (square - square[np.arange(len(x)), nearest][:, None]) / (2 * gap[nearest]) <= reach + 1e-6
        shown[np.arange(len(x)), nearest] = True
        i, c = np.nonzero(shown)
        out = some.iloc[i][["label", "dim", "k", "rep", "copies", "unit"]].copy()
        out["cell"], out["home"] = c.astype("int32"), c == nearest[i]
        return out

    schema = "label string, dim int, k string, rep long, copies long, unit array<double>, cell int, home boolean"
    placed = rows.groupBy("label", "dim", "salt").cogroup(pivots.groupBy("label", "dim", "salt")).applyInPandas(assign, schema)
    placed = stash(placed, "cells")
    # a task takes one part of a cell's own vectors and one part of all that the cell sees
    sizes = placed.groupBy("label", "dim", "cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count("*").alias("seen"))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / CELL).cast("int"), F.lit(1))
    placed = placed.join(sizes.select("label", "dim", "cell", parts("homes").alias("asking"), parts("seen").alias("known")), ["label", "dim", "cell"])
    own = lambda n, seed: F.pmod(F.xxhash64("k", F.lit(seed)), F.col(n)).cast("int")
    placed = placed.withColumns({"own_query": own("asking", 5), "own_ref": own("known", 11)})
    as_query = F.transform(F.sequence(F.lit(0), F.col("known") - 1), lambda j: F.col("own_query") * F.col("known") + j)
    as_ref = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda i: i * F.col("known") + F.col("own_ref"))
    placed = placed.withColumn("task", F.explode(F.when(F.col("home"), F.array_union(as_query, as_ref)).otherwise(as_ref)))
    placed = placed.withColumn("query", F.col("home") & (F.floor(F.col("task") / F.col("known")) == F.col("own_query")))
    placed = placed.withColumn("ref", F.col("task") % F.col("known") == F.col("own_ref"))
    return small.select(*flat.columns).unionByName(placed.select(*flat.columns))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    rows, reps = distinct_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    placed = cells_of(reps, threshold).select("label", "dim", "cell", "task", "query", "ref", "k", "copies", "unit")
    found = placed.groupBy("label", "dim", "cell", "task").applyInPandas(lambda pdf: joined(pdf, threshold), "k string, weight long, other string")
    found = stash(found, "links")
    comps = components(found.select(F.col("k").alias("a"), F.col("other").alias("b")).filter("a <> b"))
    # a vector links with itself in one task, so that the sum of the weights is its links and one
    weights = found.groupBy("k").agg((F.sum("weight") - 1).alias("links"))
    info = reps.select("k", "rep", "copies").join(weights, "k").join(comps.withColumnRenamed("node", "k"), "k", "left")
    info = stash(info.select("k", "rep", "copies", "links", F.coalesce("component", "k").alias("c")), "vectors_linked")
    least = info.groupBy("c").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    info = join_with_hot_keys(info, least, "c", "n", info.count()).select("k", "copies", "links", "least")
    out = join_with_hot_keys(rows, info, "k", "copies", rows.count())
    drop(found, reps)
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
