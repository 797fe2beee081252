"""Importance resampling against counting every n-gram by itself."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from vellum.llm import importance, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return ws, [" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def bucket(f, m=importance.BUCKETS):
    return zlib.crc32(f.encode()) % m


def brute(docs, target, percent=5):
    s, t = (Counter(bucket(f) for x in texts for f in grams(x)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t, m = sum(s.values()), sum(t.values()), importance.BUCKETS
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + m) / ((s[b] + 1) * (all_t + m))))
    rows = []
    for i, x in docs:
        ws, fs = grams(x)
        w = sum(gain(bucket(f)) for f in fs)
        n = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((n + 0.5) / 4294967296))), None, len(ws)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


TEXTS = [
    None, "", " .,\n", "One", "two Words", "ÀB cd\x00ef-gh_ij`k{l\x7fm", "Straße 日本 ÉCOLE école", "a b a b a b " * 40, "the cat sat on the mat " * 30,
    "word" * 3000 + " end", " ".join(f"w{i}" for i in range(30_000)), *[" ".join(f"t{(i * j) % 17}" for j in range(25)) for i in range(60)],
]


def test_as_counted_by_hand(spark, docs_of):
    docs = [*enumerate(TEXTS), (None, TEXTS[8]), (8, TEXTS[8]), (8, TEXTS[8])]
    target = ["the cat sat", "t1 t2 t3 t4 t1 t2", None]
    got = importance.resample(docs_of(docs), spark.createDataFrame([(x, 1) for x in target], "text string, bucket int"), 20)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, 20)


def test_empty_tables(spark, docs_of):
    none, some = docs_of([]), docs_of([(1, "a b c " * 10), (2, "d e f")])
    assert importance.resample(none, none).count() == 0
    got = importance.resample(some, none.select("text"), 100).collect()
    assert sorted(tuple(r) for r in got) == brute([(1, "a b c " * 10), (2, "d e f")], [], 100)


def test_portions_of_places_change_nothing(monkeypatch):
    def features():
        found, sums = Counter(), Counter()
        base = 0
        for lo, n, runs, counts in importance.suffix_runs(pa.array(TEXTS[:10])):
            for k in (1, 2, 3):
                heads, b = runs.of(k, 997)
                size = np.diff(np.append(heads, n))
                for x, c in zip(b.tolist(), size.tolist(), strict=True):
                    found[x] += c
                at = np.empty(n, np.int64)
                at[runs.order] = np.repeat(b, size)
                sums.update((base + i, x) for i, x in enumerate(at.tolist()))
            base += n
        del found[997]
        return found, sums

    want = Counter(bucket(f, 997) for x in TEXTS[:10] for f in grams(x)[1])
    whole = features()
    assert whole[0] == want
    for places in (1, 2, 3, 7):
        monkeypatch.setattr(importance, "PLACES", places)
        assert features() == whole


def test_words_of_slices_and_nulls():
    texts = pa.array(["zz", *TEXTS, "qq"]).slice(1, len(TEXTS))
    got, counts = words.split(texts, words.ALPHANUMERIC)
    assert counts.tolist() == [len(grams(x)[0]) for x in TEXTS]
    assert [w.decode() for w in got.to_pylist()] == [w for x in TEXTS for w in grams(x)[0]]
    spaced, counts = words.split(pa.array([" A\tb\x0bC", None, "\x1cÄ \x85d"]), words.SPACED)
    assert spaced.to_pylist() == [x.encode() for x in ("a", "b", "c", "\x1cÄ", "\x85d")] and counts.tolist() == [3, 0, 2]


def test_joined_checksums():
    a, b = [b"", b"x", b"ab c", b"\xff" * 70], [b"", b"yz", b"q" * 1000, b"\0"]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = importance.joined_crc(crc(a), crc(b), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
