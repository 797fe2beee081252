"""Merkle manifest of a dataset: a tree of digests for each language, one over their roots, and proofs of every row.

The node store is a set of Parquet tables partitioned by level. Leaves are sorted by range and get coordinates (tree,
place). Levels are made in passes of SPAN levels: aligned runs of 2**SPAN nodes of the level below stream through a task,
which hashes them level by level and emits every node; the next pass reads the uppermost level so made. A table of n
leaves takes log2(n) / SPAN passes, and no task holds more than a run.

Proofs go down the same passes: each run of nodes meets the nodes above it inside the run and the path of the run's
root, all by coordinate, so a proof is the siblings found in the run and then that path. The proof of a leaf folds its
digest with them to a root. Nothing but the largest tree's size reaches the driver.

A digest is lowercase hex SHA-256 of inputs behind each other, digests as hex text. A run's last node may stand alone: then
it is hashed alone, unless it is the only one of its level. Defined cases: a null field is `-`, others their UTF-8 length, a colon
and the value; leaves ascend by doc_id (null first), repeated ids by leaf; a null language is a tree of its own and the
first; a table of one row has that leaf as root, and a proof of nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import BROADCAST_ROWS, in_order, stash

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels made in one pass; a task holds 2**SPAN nodes at a time.
SPAN = 10
#: Level of the rows that name a tree's root.
ROOT = -1


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """A row's digest."""
    coded = [F.coalesce(F.concat(F.octet_length(s := c.cast("string")).cast("string"), F.lit(":"), s), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*coded), 256)


def levels(nodes: list[str], least: int) -> list[list[str]]:
    """The nodes and the levels above them: `least` of these, or, at 0, up to the root."""
    out = [nodes]
    while len(out) <= least if least else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


NODE = "tree string, level int, idx long, hash string, n long"


def _climb(base: int, span: int):
    """Of a run of nodes at level `base`, all those above them; n: how many nodes that level of the tree has."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, n, start = table["tree"][0].as_py(), table["n"][0].as_py(), table["idx"][0].as_py()
        made = levels(table["hash"].to_pylist(), span if n > 1 << span else 0)
        rows = [(base + k, (start >> k) + i, h, -(-n >> k)) for k, level in enumerate(made) if k for i, h in enumerate(level)]
        if n <= 1 << span:
            rows.append((ROOT, 0, made[-1][0], 1))
        level, idx, hashes, counts = zip(*rows, strict=True)
        return pa.table([pa.array([tree] * len(rows), pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(hashes), pa.array(counts, pa.int64())], ["tree", "level", "idx", "hash", "n"])

    return run


@dataclass
class Forest:
    """passes[i]: the nodes above level i * span, by level; leaves(tree, idx, hash, n)."""

    leaves: DataFrame
    passes: list[DataFrame]
    span: int

    @property
    def roots(self) -> DataFrame:
        """(tree, hash)"""
        tops = [p.filter(F.col("level") == ROOT).select("tree", "hash") for p in self.passes]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out

    def at(self, i: int) -> DataFrame:
        """The nodes that pass i started from."""
        if i == 0:
            return self.leaves
        return self.passes[i - 1].filter((F.col("level") == i * self.span) & (F.col("n") > 1))


def grow(leaves: DataFrame, most: int, span: int = SPAN) -> Forest:
    """The forest over leaves(tree, idx, hash, n); most: leaves of the largest tree."""
    forest, i = Forest(leaves, [], span), 0
    while not i or most > 1:
        nodes = forest.at(i).select("tree", "idx", "hash", "n", F.shiftright("idx", span).alias("run"))
        made = nodes.groupBy("tree", "run").applyInArrow(_climb(i * span, span), NODE)
        forest.passes.append(stash(made, f"nodes-{i * span}", by="level"))
        most, i = -(-most >> span), i + 1
    return forest


#: What meets in a run: its nodes (given: the digest to fold), nodes above them and the path of its root.
MEET = "tree string, run long, level int, idx long, hash string, n long, row string, given string, path array<string>, subroot string, root string"
PATH = "tree string, idx long, path array<string>, subroot string, root string"
PROOF = "row string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def fold(given: str, path: list[str]) -> str:
    """The root that a digest leads to; path: for each level L or R and the sibling on that side, or nothing."""
    for s in path:
        given = digest(s[1:], given) if s[:1] == "L" else digest(given, s[1:])
    return given


def _descend(base: int, span: int, to_proofs: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("level", "ascending"), ("idx", "ascending")]).to_pylist()
        above = rows.pop(0)  # the path, at a level below all others
        by_level: dict[int, list[str]] = {}
        for r in rows:
            by_level.setdefault(r["level"] - base, []).append(r["hash"])
        own, out, n = [r for r in rows if r["level"] == base], [], rows[0]["n"] if rows else 0
        high = span if n > 1 << span else (n - 1).bit_length()
        for i, r in enumerate(own):
            path = []
            for k in range(high):
                side = i >> k ^ 1
                level = by_level[k]
                path.append(("L" if side < i >> k else "R") + level[side] if side < len(level) else "")
            path += above["path"]
            if to_proofs:
                out.append((r["row"], r["hash"], above["subroot"], above["root"], digest(*(s[1:] for s in path)), fold(r["given"], path)))
            else:
                out.append((r["tree"], r["idx"], path, above["subroot"], above["root"]))
        if to_proofs:
            names, kinds = ["row", "leaf", "subroot", "root", "proof_sha256", "folded_root"], [pa.string()] * 6
        else:
            names, kinds = ["tree", "idx", "path", "subroot", "root"], [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _like(df: DataFrame, schema: str, **given: Column) -> DataFrame:
    """df with exactly the schema's columns: given ones, its own, else nulls."""
    names = [part.split(" ") for part in schema.split(", ")]
    return df.select(*[given.get(n, F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in names])


def down(forest: Forest, tops: DataFrame, leaves: DataFrame, to_proofs: bool) -> DataFrame:
    """Paths of all leaves from tops(tree, path, subroot, root): as PATH, or folded as PROOF.

    leaves: forest.leaves with columns row and given where proofs are asked for. Trees end in different passes: their
    runs take the path from tops, all others from the pass above."""
    above = None
    for i in reversed(range(len(forest.passes))):
        span = forest.span
        base, last = i * span, i == 0
        nodes = leaves if last else forest.at(i)
        nodes = _like(nodes, MEET, run=F.shiftright("idx", span), level=F.lit(base))
        inner = forest.passes[i].filter((F.col("level") > base) & (F.col("level") < base + span) & (F.col("n") > 1))
        inner = _like(inner, MEET, run=F.expr(f"shiftright(idx, {base + span} - level)"))
        ends_here = forest.passes[i].filter(F.col("level") == ROOT).select(F.col("tree").alias("__t"))
        paths = tops.join(ends_here, F.col("tree").eqNullSafe(F.col("__t"))).drop("__t").withColumn("idx", F.lit(0).cast("long"))
        if above is not None:
            paths = paths.unionByName(above)
        paths = _like(paths, MEET, run=F.col("idx"), level=F.lit(-2), idx=F.lit(0))
        met = nodes.unionByName(inner).unionByName(paths).groupBy("tree", "run")
        if last and to_proofs:
            return met.applyInArrow(_descend(base, span, True), PROOF)
        above = stash(met.applyInArrow(_descend(base, span, False), PATH), "paths")
    return above


def rows(docs: DataFrame, key: str = "doc_id", tree: str = "lang", changed: dict[str, Column] | None = None, where: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(row, tree, hash, given): every row's leaf, and the leaf of what is claimed: with `changed` fields `where` that holds."""
    plain = leaf([F.col(c) for c in fields])
    other = F.lit(None).cast("string") if where is None else F.when(where, leaf([(changed or {}).get(c, F.col(c)) for c in fields]))
    made = docs.select(F.col(key).alias("row"), F.col(tree).alias("tree"), plain.alias("hash"), other.alias("other"))
    return stash(made, "leaves").withColumn("given", F.coalesce("other", "hash")).drop("other")


@dataclass
class Manifest:
    """by_tree: the forest of all trees; over: the one tree of their roots; trees(tree, idx, hash): these roots in order."""

    by_tree: Forest
    over: Forest
    trees: DataFrame

    @property
    def root(self) -> DataFrame:
        """(hash): one row, or none where there are no rows."""
        return self.over.roots.select("hash")

    def paths(self) -> DataFrame:
        """(tree, path, subroot, root): the way from each tree's root to the manifest's."""
        top = self.over.roots.select(F.lit(None).cast("string").alias("tree"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
        way = down(self.over, top, self.over.leaves, False).select("idx", "path", "root")
        return self.trees.join(way, "idx").select("tree", "path", F.col("hash").alias("subroot"), "root")

    def proofs(self) -> DataFrame:
        """(row, leaf, subroot, root, proof_sha256, folded_root): row as text; the root that `given` and the proof lead to."""
        return down(self.by_tree, stash(self.paths(), "tops"), self.by_tree.leaves, True)

    def siblings(self) -> DataFrame:
        """(tree, idx, path, subroot, root): every leaf's proof itself, a string a level: the side and the sibling."""
        return down(self.by_tree, stash(self.paths(), "tops"), self.by_tree.leaves, False)


def build(leaves: DataFrame, span: int = SPAN) -> Manifest:
    """The manifest over rows()."""
    first = [F.col("tree").asc_nulls_first()]
    placed, sizes = in_order(leaves, [*first, F.col("row").asc_nulls_first(), F.col("hash")], "tree", "idx")
    sizes = stash(sizes.select(F.col("tree").alias("__t"), "n"), "sizes")
    side = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    placed = placed.join(side, F.col("tree").eqNullSafe(F.col("__t"))).drop("__t")
    forest = grow(stash(placed, "placed"), sizes.agg(F.max("n")).first()[0] or 0, span)
    trees, _ = in_order(forest.roots, first, None, "idx")
    trees = stash(trees, "roots")
    n = trees.count()
    over = grow(trees.select(F.lit(None).cast("string").alias("tree"), "idx", "hash", F.lit(n).cast("long").alias("n")), n, span)
    return Manifest(forest, over, trees)


def verify(docs: DataFrame, where: Column, changed: dict[str, Column], span: int = SPAN) -> DataFrame:
    """Every row of docs with its proof, and whether what is claimed of it leads to the manifest's root."""
    proofs = build(rows(docs, changed=changed, where=where), span).proofs()
    out = proofs.withColumn("verified", F.col("folded_root") == F.col("root")).withColumn("doc_id", F.col("row").cast("long"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def chosen(doc_id: Column) -> Column:
    """Rows that are tampered with: 7 divides the CRC-32 of the id as text; never rows without id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
