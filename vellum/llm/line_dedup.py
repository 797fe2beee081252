"""Reversible line dedup: exact reference-count tables behind sharded cuckoo filters.

A line's key is the line without surrounding ASCII blanks, ASCII letters lower-cased. The index holds

* refs(key, doc_id, lines): the exact table, one row per key and document with the number of lines there; a key's
  reference count is its number of rows, so deleting a document is deleting its rows;
* filters(shard, blob): cuckoo filters over the keys that at least `min_docs` documents hold. A key enters a filter when
  its count reaches that number and is deleted from it when the count falls below, which a Bloom filter could not do.

To dedup, every (key, document) row is first tried against its shard's filter and only the few that pass go to the
exact table, which decides. Filters are broadcast while together they are below `broadcast_bytes`; beyond, rows are
routed to their shard, split by a salt so that one hot line doesn't fill one task.

A repeated key loses all its lines except in the largest doc_id that holds it. Defined cases: a null or empty text is
one empty line; keys shorter than `min_chars` code points are never counted; rows that repeat a doc_id are one document;
rows without a doc_id are not counted and stay as they are; inserting a known doc_id changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import join_with_hot_keys, stash

BLANKS = b" \t\n\v\f\r"
SLOTS = 4


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit digest of the line's key; None where the key is too short to count."""
    raw = line.encode().strip(BLANKS)
    if len(raw) < min_chars or len(raw) < 4 * min_chars and len(raw.decode()) < min_chars:
        return None
    return hashlib.blake2b(raw.lower(), digest_size=16).digest()


class Cuckoo:
    """Cuckoo filter with 16-bit fingerprints, four slots a bucket, over 16-byte keys that are already hashes."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of(cls, keys: list[bytes], room: int = 0) -> Cuckoo:
        n = max(len(keys), room)
        while True:
            made = cls.sized(n)
            if all(made.add(k) for k in keys):
                return made
            n = 2 * n + 1

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, dtype="<u2").reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & (len(self.table) - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (len(self.table) - 1)

    def add(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            row = self.table[at]
            for i in range(SLOTS):
                if not row[i]:
                    row[i] = mark
                    return True
        at = b
        for turn in range(500):  # move residents to their other bucket
            i = (turn + mark) % SLOTS
            mark, self.table[at, i] = int(self.table[at, i]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def remove(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            hit = np.flatnonzero(self.table[at] == mark)
            if len(hit):
                self.table[at, hit[0]] = 0
                return True
        return False

    def holds(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, dtype=bool)
        raw = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 16)
        mark = np.ascontiguousarray(raw[:, 8:10]).view("<u2")[:, 0].astype(np.uint64)
        mark[mark == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        a = np.ascontiguousarray(raw[:, :8]).view("<u8")[:, 0] & mask
        b = (a ^ (mark * np.uint64(0x5BD1E995))) & mask
        want = mark.astype(np.uint16)[:, None]
        return (self.table[a] == want).any(1) | (self.table[b] == want).any(1)


def line_refs(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id, lines): each long enough key once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, counts = [], [], []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                own: dict[bytes, int] = {}
                for line in (text or "").split("\n"):
                    if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None:
                        own[k] = own.get(k, 0) + 1
                keys += own
                ids += [doc] * len(own)
                counts += own.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["key", "doc_id", "lines"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    # rows that repeat a doc_id are one document
    return rows.mapInArrow(run, "key binary, doc_id long, lines long").groupBy("key", "doc_id").agg(F.sum("lines").alias("lines"))


@dataclass
class LineIndex:
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 5
    min_chars: int = 40
    broadcast_bytes: int = 32 << 20
    shard_keys: int = 50_000

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40, **more) -> LineIndex:
        index = cls(stash(line_refs(docs, min_chars), "refs"), docs, 1, min_docs, min_chars, **more)
        return index._refilter()

    def _shard(self, key: str = "key"):
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def totals(self) -> DataFrame:
        """(key, n_docs, last_doc) of every key."""
        return self.refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def repeated(self) -> DataFrame:
        return self.totals().filter(F.col("n_docs") >= self.min_docs)

    def _refilter(self) -> LineIndex:
        """All filters anew from the exact table, with as many shards as its size asks for."""
        rep = stash(self.repeated(), "repeated")
        self.shards = max(1, -(-rep.count() // self.shard_keys))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "blob": [Cuckoo.of([bytes(k) for k in pdf["key"]]).dump()]})

        made = rep.select(self._shard().alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, blob binary")
        self.filters = stash(made, "filters")
        return self

    def _changed(self, refs: DataFrame, keys: DataFrame) -> LineIndex:
        """The index with other refs, where only these keys' counts may have moved: the filters get what crossed."""
        new = LineIndex(stash(refs, "refs"), self.filters, self.shards, self.min_docs, self.min_chars, self.broadcast_bytes, self.shard_keys)
        keys = keys.select("key").distinct()
        was = self.totals().join(keys, "key", "left_semi").select("key", F.col("n_docs").alias("was"))
        now = new.totals().join(keys, "key", "left_semi").select("key", F.col("n_docs").alias("now"))
        both = keys.join(was, "key", "left").join(now, "key", "left").fillna(0, ["was", "now"])
        up, down = (F.col("now") >= self.min_docs) & (F.col("was") < self.min_docs), (F.col("now") < self.min_docs) & (F.col("was") >= self.min_docs)
        moves = both.filter(up | down).select(self._shard().alias("shard"), "key", up.alias("up"))

        def apply(key: tuple, blobs: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            f, whole = (Cuckoo.load(bytes(blobs["blob"].iloc[0])) if len(blobs) else Cuckoo.sized(len(changes) + 16)), True
            for k, add in zip(changes["key"], changes["up"], strict=True):
                whole &= f.add(bytes(k)) if add else f.remove(bytes(k))
            return pd.DataFrame({"shard": [key[0]], "blob": [f.dump()], "whole": [whole]})

        cogrouped = self.filters.groupBy("shard").cogroup(moves.groupBy("shard"))
        made = stash(cogrouped.applyInPandas(apply, "shard int, blob binary, whole boolean"), "filters")
        if made.filter("not whole").limit(1).count():  # a filter ran full
            return new._refilter()
        new.filters = made.select("shard", "blob")
        return new

    def insert(self, docs: DataFrame) -> LineIndex:
        rows = line_refs(docs, self.min_chars).join(self.refs.select("doc_id").distinct(), "doc_id", "left_anti")
        rows = stash(rows.select(*self.refs.columns), "rows")
        return self._changed(self.refs.unionByName(rows), rows)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        gone = doc_ids.select("doc_id").distinct()
        return self._changed(self.refs.join(gone, "doc_id", "left_anti").select(*self.refs.columns), self.refs.join(gone, "doc_id", "left_semi"))

    def passing(self) -> DataFrame:
        """The refs whose key its shard's filter may hold."""
        rows = self.refs.select("key", "doc_id")
        size = self.filters.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("b")).first()["b"]
        shards = self.shards
        if size <= self.broadcast_bytes:
            blobs = {r["shard"]: bytes(r["blob"]) for r in self.filters.collect()}  # below broadcast_bytes in all

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                loaded = {s: Cuckoo.load(b) for s, b in blobs.items()}
                for b in batches:
                    keys, at = b["key"].to_pylist(), np.asarray(b["shard"])
                    hit = np.zeros(len(keys), dtype=bool)
                    for s in np.unique(at):
                        if s in loaded:
                            own = np.flatnonzero(at == s)
                            hit[own] = loaded[s].holds([keys[i] for i in own])
                    yield pa.RecordBatch.from_arrays([b["key"], b["doc_id"]], ["key", "doc_id"]).filter(pa.array(hit))

            return rows.withColumn("shard", self._shard()).mapInArrow(run, "key binary, doc_id long")

        salts = max(1, self.refs.rdd.getNumPartitions())

        def routed(_: tuple, some: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
            if not len(blobs) or not len(some):
                return some[["key", "doc_id"]].iloc[:0]
            return some[["key", "doc_id"]][Cuckoo.load(bytes(blobs["blob"].iloc[0])).holds([bytes(k) for k in some["key"]])]

        left = rows.withColumns({"shard": self._shard(), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
        right = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(routed, "key binary, doc_id long")

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses."""
        rep = self.repeated().select(F.hex("key").alias("k"), "n_docs", "last_doc")
        total = self.refs.count()
        rows = self.passing().select(F.hex("key").alias("k"), "doc_id")
        sure = join_with_hot_keys(rows, rep, "k", "n_docs", total).filter("last_doc is not null and doc_id <> last_doc")
        return sure.groupBy("doc_id").agg(F.collect_list(F.unhex("k")).alias("keys"))

    def _with_drops(self, docs: DataFrame) -> DataFrame:
        return docs.join(self.drops().withColumnRenamed("doc_id", "__doc").withColumnRenamed("keys", "__keys"), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text) for every row of docs."""
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, lost, kept = [], [], []
                for text, keys in zip(b["text"].to_pylist(), b["__keys"].to_pylist(), strict=True):
                    a, d, t = kept_lines(text, keys, min_chars)
                    n.append(a)
                    lost.append(d)
                    kept.append(t)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept_text"],
                )

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return self._with_drops(rows).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")

    def rewrite(self, docs: DataFrame) -> DataFrame:
        """docs, all columns, with the lines gone from text; n_chars follows where it exists."""
        min_chars, names = self.min_chars, docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = []
                for text, keys in zip(b["text"].to_pylist(), b["__keys"].to_pylist(), strict=True):
                    texts.append(kept_lines(text, keys, min_chars)[2] if keys else text)
                new = {"text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays([new.get(c, b[c]) for c in names], names)

        out = self._with_drops(docs).mapInArrow(run, docs.schema)
        if "n_chars" in names:
            out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*names)
        return out


def kept_lines(text: str | None, keys: list | None, min_chars: int) -> tuple[int, int, str]:
    """Number of lines, number dropped, the other lines joined."""
    lines = (text or "").split("\n")
    if not keys:
        return len(lines), 0, text or ""
    gone = {bytes(k) for k in keys}
    kept = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    return LineIndex.build(docs, **settings).rewrite(docs)
