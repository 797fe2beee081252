"""The language model: counts against plain Python, probabilities that sum to one, gradients, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import gated_lm as g

SMALL = g.Settings(listed=16, per_class=4, width=4, window=3, streams=5, rounds=2)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [" "]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def base(docs):
    count = Counter(w for i, t in docs if not is_held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    log = lambda w: math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
    return sorted(((i, is_held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(map(log, tokens(t))), 6)) for i, t in docs), key=str)


FIELDS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def got_base(df):
    return sorted(((*(r[f] for f in FIELDS), round(r["base_score"], 6)) for r in df.collect()), key=str)


TEXTS = [None, "", " \t\n", "One two", "two. Éa; \x1cx " * 9, "the cat sat on the mat. " * 50, "rare" * 200, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 20, " ".join(f"w{i}" for i in range(3000))]


@pytest.mark.parametrize("blocks", [1, 4])
def test_base_scores_as_counted_by_hand(spark, docs_of, blocks):
    docs = [*enumerate(TEXTS * 3), (None, "no id two"), (5, TEXTS[5]), (5, "another text of a repeated id"), *((i, f"held words{i % 7} two") for i in range(100, 140))]
    assert any(is_held(i) for i, _ in docs)
    out = g.score(docs_of(docs).repartition(blocks), SMALL)
    assert got_base(out) == base(docs)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out.collect())


def test_without_training_documents(spark, docs_of):
    held = [(i, "some words here") for i in range(300) if is_held(i)]
    out = g.score(docs_of(held), SMALL)
    assert got_base(out) == base(held)
    assert {r["base_score"] for r in out.collect()} == {0.0}
    assert g.score(docs_of([]), SMALL).count() == 0


def network(seed=0):
    net = g.Network(SMALL)
    net.start_from([5, 4, 3], np.arange(g.FORMS))
    net.flat += np.random.default_rng(seed).standard_normal(len(net.flat)).astype(np.float32) * 0.3
    return net


def test_probabilities_sum_to_one():
    net = network()
    states = np.random.default_rng(1).standard_normal((3, SMALL.width)).astype(np.float32)
    every = np.arange(SMALL.listed + g.FORMS)
    for s in states:
        assert abs(np.exp(net.log_p(np.repeat(s[None], len(every), 0), every)).sum() - 1) < 1e-5


def test_gradients():
    net = network()
    net.flat = net.flat.astype(np.float64)
    net = g.Network(SMALL, net.flat)
    draw = np.random.default_rng(2)
    y = draw.integers(0, SMALL.listed + g.FORMS, (4, 3))
    x = np.concatenate([np.zeros((1, 3), int), y[:-1]])
    weight = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0.0]])
    grad = g.Network(SMALL, np.zeros_like(net.flat))
    start = draw.standard_normal((SMALL.width, 3))
    net.window(x, y, weight, start, grad)
    loss = lambda: -net.window(x, y, weight, start, g.Network(SMALL, np.zeros_like(net.flat)))[1] / weight.sum()
    found = grad.flat.copy()
    for i in draw.choice(len(net.flat), 300, replace=False):
        was = net.flat[i]
        net.flat[i] = was + 1e-4
        up = loss()
        net.flat[i] = was - 1e-4
        down = loss()
        net.flat[i] = was
        assert abs((up - down) / 2e-4 - found[i]) < 1e-5


def test_state_goes_on_from_window_to_window():
    """Whole documents, scored together and in windows, as one token after the other."""
    net, draw = network(3), np.random.default_rng(4)
    docs = [draw.integers(1, SMALL.listed + g.FORMS, n) for n in (0, 1, 2, 31, 32, 33, 70, 5, 64)]
    docs = [np.append(d, 0) for d in docs]

    def plain(doc):
        h, last, total = np.zeros((SMALL.width, 1), np.float32), 0, 0.0
        for code in doc:
            h = net.step(net.inputs(np.array([[last]]))[0], h)[0]
            total += net.log_p(h.T, np.array([code]))[0]
            last = code
        return total / math.log(10)

    want = [plain(d) for d in docs]
    for at_once, window in ((512, 32), (4, 7), (1, 1)):
        assert np.allclose(g.log10_p(net, docs, at_once, window), want, rtol=1e-5, atol=1e-5)


def test_better_than_counts_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in g.score(docs, g.Settings(window=16, streams=32)).collect() if r["held_out"]]
    mean = lambda c: sum(r[c] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert mean("score") > mean("base_score") + 0.1
