import numpy as np
import pandas as pd
import pytest

from vellum.llm import cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, t=0.93):
    out = {}
    good = [(i, np.array(e, dtype=np.float64), l) for i, e, l in rows if e and l is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(len(good)):
            x, y = good[a], good[b]
            if a != b and x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= t:
                links[a].add(b)
    for i, *_ in rows:
        out[i] = (0, i)
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            for n in links[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out[good[a][0]] = (len(links[a]), min(good[s][0] for s in seen))
    return out


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 16))
    rows = []
    for i in range(n):
        v = centres[i % 8] + rng.normal(size=16) * (0.15 if i % 3 else 0.5)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    return rows


@pytest.mark.parametrize("cell", [10_000, 40])
def test_exact(spark, monkeypatch, cell):
    monkeypatch.setattr(cover_tree, "CELL", cell)
    rows = clustered(300)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(20)]  # one hot vector
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [None] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, rows[0][1], None), (2005, [1.0], 0), (2006, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS k", "2 AS n_links")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df).collect()}
    assert got == brute(rows)


def chains(n, length=9, dim=12, seed=3):
    """Arcs of vectors 15 degrees apart in random planes, with ids in random order: each links only with its neighbours."""
    rng = np.random.default_rng(seed)
    ids, rows = rng.permutation(n * length).tolist(), []
    for _ in range(n):
        plane = np.linalg.qr(rng.normal(size=(dim, 2)))[0]
        for k in range(length):
            v = plane @ [np.cos(np.radians(15 * k)), np.sin(np.radians(15 * k))]
            rows.append((ids.pop(), [float(np.float32(x)) for x in v], 1))
    return rows


def test_link_to_a_vector_of_another_task():
    a, b, c = ([float(np.cos(np.radians(k))), float(np.sin(np.radians(k)))] for k in (0, 15, 30))
    task = lambda *rows: pd.DataFrame(rows, columns=["k", "unit", "query"]).assign(copies=1, ref=True)
    found = pd.concat([cover_tree.joined(task(("2", a, True), ("5", b, True), ("3", c, False)), 0.93), cover_tree.joined(task(("3", c, True), ("5", b, False)), 0.93)])
    edges = {tuple(sorted(e)) for e in zip(found["k"], found["other"], strict=True) if e[0] != e[1]}
    assert edges >= {("2", "5"), ("3", "5")} or edges >= {("2", "5"), ("2", "3")}
    weights = found.groupby("k")["weight"].sum().to_dict()
    assert weights == {"2": 2, "5": 3, "3": 2}


@pytest.mark.parametrize("cell", [10_000, 15])
def test_repeated_and_null_ids(spark, monkeypatch, cell):
    """One row out for each row in: ids that repeat with other vectors, null ids, and ids that tie."""
    monkeypatch.setattr(cover_tree, "CELL", cell)
    rng, made = np.random.default_rng(4), []
    for i, (_, e, label) in enumerate(chains(8)):
        made.append((None if i % 5 == 0 else int(rng.integers(0, 12)), e, label))
    made += [(5, [1.0, 0.0], 3), (5, [0.0, 1.0], 3), (None, [1.0, 0.0], 4), (None, [1.0, 0.01], 4), (None, [0.0, 1.0], 4), (None, None, 4)]
    unit = [None if e is None else np.array(e) / np.linalg.norm(e) for _, e, _ in made]
    n = len(made)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and made[i][2] == made[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(n)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min((made[j][0] for j in seen if made[j][0] is not None), default=None)
        want.append((made[i][0], len(near[i]), comp, made[i][0] == comp))
    got = cover_tree.near_duplicates(spark.createDataFrame(made, SCHEMA)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize(("cell", "pivots"), [(12, 256), (20, 2)])
def test_chains_over_cells_and_parts(spark, monkeypatch, cell, pivots):
    monkeypatch.setattr(cover_tree, "CELL", cell)
    monkeypatch.setattr(cover_tree, "MOST_PIVOTS", pivots)
    rows = chains(30)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}


def test_empty(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_cover(spark):
    x = np.array([r[1] for r in clustered(200)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, todo = cover_tree.CoverTree(x), []
    todo = [tree.root]
    while todo:
        node = todo.pop()
        assert np.sqrt(((x[node.points] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        if not tree.is_leaf(node):
            parts = tree.split(node)
            assert sorted(np.concatenate([p.points for p in parts])) == sorted(node.points)
            assert all(p.level <= node.level / 2 and p.radius <= p.level + 1e-5 for p in parts)
            todo += parts
