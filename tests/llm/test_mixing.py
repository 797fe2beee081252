import hashlib
from collections import defaultdict

import numpy as np

from vellum.llm import mixing


def water(sizes, weights, most=3):
    target, full, total = dict.fromkeys(sizes, 0.0), set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_draws(spark, docs_of):
    rows = [(i, "w " * (1 + i % 13), ["b", "a", "c", None, "hot"][0 if i % 50 == 0 else 4 if i % 3 else i % 4]) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", None), (None, "x y", "a"), (7, "one two", "a"), (2000, "long " * 40, "hot")]
    got = mixing.mix(docs_of(rows)).collect()
    again = mixing.mix(docs_of(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[(r["doc_id"], r["size"])]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    names = sorted(s for s in sizes if s is not None) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= max(13, 0.02 * want[s])


def test_against_a_plain_draw(spark, docs_of):
    """Inclusion probabilities, ranks and the filling, source by source, in plain Python; few and many documents, heavy tails, ties."""
    rng = np.random.default_rng(5)
    sizes = [np.exp(rng.uniform(0, np.log(2000), size=n)).astype(int) for n in (1, 2, 5, 40, 150, 150, 300)] + [np.full(80, 7), np.array([90_000, 3, 3, 2])]
    rows = [(1000 * s + i, "w " * int(n), f"s{s}") for s, row in enumerate(sizes) for i, n in enumerate(row)]
    rows += [rows[200], rows[200]]
    got = mixing.mix(docs_of(rows)).collect()
    for s in range(len(sizes)):
        mine = sorted([(r["doc_id"], r["size"], r["copies"]) for r in got if r["doc_id"] // 1000 == s])
        target, total = next((r["target"], r["source_size"]) for r in got if r["doc_id"] // 1000 == s)
        sure = int(target // total)
        room, c = target - sure * total, 0.0
        for t in sorted({n for _, n, _ in mine}, reverse=True):
            c = (room - sum(n for _, n, _ in mine if n > t)) / sum(n * n for _, n, _ in mine if n <= t)
            if 0 <= c and c * t <= 1:
                break
        order = []
        for i, n, _ in mine:
            u, p = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48, min(1.0, c * n)
            if p > 0:
                order.append((0.0 if p >= 1 else (u / (1 - u)) / (p / (1 - p)), i, n))
        taken, left = [], sorted(order)
        while any(n <= room - sum(x[2] for x in taken) for _, _, n in left):
            now, before, rest = room - sum(x[2] for x in taken), 0, []
            for x in left:
                if x[2] <= now:
                    before += x[2]
                    if before <= now:
                        taken.append(x)
                        continue
                rest.append(x)
            left = rest
        last = min([(n, r, i) for r, i, n in left if n / 2 < room - sum(x[2] for x in taken)], default=None)
        if last:
            left.remove((last[1], last[2], last[0]))
            taken.append((last[1], last[2], last[0]))
        want = sorted([(i, n, sure + 1) for _, i, n in taken] + [(i, n, sure) for _, i, n in left] + [(i, n, sure) for i, n, _ in mine if c * n <= 0])
        assert mine == want
        off = abs(sum(n * k for _, n, k in mine) - target)
        assert off <= max([n for _, n, _ in mine]) / 2 and (len(mine) < 100 or off <= 0.01 * target)


def test_longer_documents_are_likelier(spark, docs_of):
    """Within a source the share taken grows in proportion to size."""
    rows = [(i, "w " * (10 if i % 2 else 30), "a" if i < 6000 else "b") for i in range(12_000)]
    got = [r for r in mixing.mix(docs_of(rows), weights=(1, 3)).collect() if r["doc_id"] < 6000]
    share = {n: np.mean([r["copies"] for r in got if r["size"] == n]) for n in (10, 30)}
    assert abs(share[30] / share[10] - 3) < 0.3


def test_empty(spark, docs_of):
    assert mixing.mix(docs_of([(1, "x")]).limit(0)).count() == 0
    assert mixing.mix(docs_of([(1, None), (2, "")])).filter("taken = 0 and target = 0").count() == 2
