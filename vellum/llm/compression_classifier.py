"""Quality classifier by compression: how much better a text packs with a dictionary of good than of bad texts.

Two zstandard dictionaries are trained, one from pieces of texts labelled good and one from pieces labelled bad. A text
is cut into pieces of `piece` bytes, every piece is compressed with both dictionaries, and the difference of the two
total sizes over their sum is its only feature. A logistic curve, fitted on labelled texts that the dictionaries did not
see and weighted to the label counts of the whole table, turns it into a probability.

The fit uses a bounded sample: `per_class` labelled documents a class, chosen by a hash of doc_id, and `pieces` pieces a
class; the fit reads the documents once. Scoring covers every byte of every text. Defined cases: a null or empty text has
difference 0; without two classes of labels every score is the share of label 1 (0.5 without any label); repeated rows
score alike; null labels, null ids and documents that bear both labels are not learnt from; of rows that repeat a doc_id
the smallest text is; a score of exactly 0.5 counts as good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stash


@dataclass
class Settings:
    piece: int = 1024
    dictionary: int = 112 * 1024
    level: int = 3
    per_class: int = 4000
    pieces: int = 16000


@dataclass
class Model:
    settings: Settings
    good: bytes = b""
    bad: bytes = b""
    raw: bool = False
    slope: float = 0.0
    bias: float = 0.0
    _packers: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_packers": []}

    def _pair(self) -> list:
        if not self._packers:
            kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_AUTO
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data, dict_type=kind)
                d.precompute_compress(level=self.settings.level)
                self._packers.append(
                    zstandard.ZstdCompressor(level=self.settings.level, dict_data=d, write_content_size=False, write_dict_id=False)
                )
        return self._packers

    def difference(self, text: str | None) -> float:
        """Normalised difference of the compressed sizes; positive where the good dictionary packs better."""
        data = (text or "").encode()
        if not data or not self.good or not self.bad:
            return 0.0
        good, bad = self._pair()
        a = b = 0
        for at in range(0, len(data), self.settings.piece):
            part = data[at : at + self.settings.piece]
            a += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - a) / (a + b)

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * self.difference(text) + self.bias))))


def _dictionary(pieces: list[bytes], size: int) -> tuple[bytes, bool]:
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes(), False
    except zstandard.ZstdError:  # too little to train from: the pieces themselves
        return b"".join(pieces)[-size:], True


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Newton steps for a weighted one-feature logistic curve with a small ridge."""
    scale = x.std() or 1.0
    z, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (y - p)) - np.array([1e-3, 0]) * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """docs(doc_id, text) and labels(doc_id, quality 0/1), the latter already cut to what may be learnt from."""
    s = settings or Settings()
    known = labels.select("doc_id", F.col("quality").cast("int").alias("q")).filter("doc_id is not null and q in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("q").alias("q"), F.max("q").alias("other")).filter("q = other").select("doc_id", "q")
    n = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = 0.5 if not n else float(1 in n)
        return Model(s, bias=60.0 * (2 * share - 1))
    order = F.xxhash64("doc_id", F.lit(20))
    some = [known.filter(F.col("q") == q).orderBy(order, "doc_id").limit(s.per_class) for q in (0, 1)]
    picked = some[0].unionByName(some[1]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(2)))
    # at most 2 * per_class rows: safe to broadcast; one text for each, so that as many differences come back at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(picked), "doc_id")
    texts = stash(texts.groupBy("doc_id", "q", "fold").agg(F.min("t").alias("t")), "labelled")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qs, parts = [], []
            for q, t in zip(b["q"].to_pylist(), b["t"].to_pylist(), strict=True):
                data = t.encode()
                for at in range(0, len(data), s.piece):
                    qs.append(q)
                    parts.append(data[at : at + s.piece])
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), pa.array(parts, pa.binary())], ["q", "part"])

    parts = texts.filter("fold = 0").mapInArrow(cut, "q int, part binary")
    model = Model(s)
    got = []
    for q in (1, 0):
        rows = parts.filter(F.col("q") == q).orderBy(F.xxhash64("part"), "part").limit(s.pieces).collect()
        got.append([bytes(r["part"]) for r in rows])
    if not all(got):
        return Model(s, bias=math.log(n[1] / n[0]))
    (model.good, raw_a), (model.bad, raw_b) = (_dictionary(p, s.dictionary) for p in got)
    if raw_a != raw_b:
        model.good, model.bad, raw_a = b"".join(got[0])[-s.dictionary :], b"".join(got[1])[-s.dictionary :], True
    model.raw = raw_a

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["q"], pa.array([model.difference(t) for t in b["t"].to_pylist()], pa.float64())], ["q", "x"])

    seen = texts.filter("fold = 1").mapInArrow(differ, "q int, x double").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([float(r["q"]) for r in seen])
    if not 0 < y.sum() < len(y):
        return Model(s, bias=math.log(n[1] / n[0]))
    weight = np.where(y == 1, n[1] / y.sum(), n[0] / (len(y) - y.sum()))
    model.slope, model.bias = _logistic(x, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([model.score(t) for t in b["text"].to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the model does not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) >= 0.5 for t in b["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    """True for the documents that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
