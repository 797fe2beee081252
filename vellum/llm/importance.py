"""Importance resampling towards a target distribution, over hashed n-grams found in word-id suffix arrays.

Documents whose word runs look like those of target texts get a higher chance. Every run of one to three consecutive
words is a feature, hashed to one of `buckets`. A bucket's gain is the log ratio of its smoothed share in the target and
in the corpus; a document's weight is the sum of its features' gains, and the documents with the highest weight plus
Gumbel noise, drawn from a hash of their id, are a sample without replacement in proportion to exp(weight / 1000).

Tasks read portions of whole texts. Words become ids; the suffixes of the id sequence, ordered by their first three
words, have common prefixes with their neighbours, and a run of neighbours that share k words is one distinct k-gram: it is
hashed once and its bucket id is scattered back to the run's places in the texts. A hash of a longer run is combined from
those of its words, as CRC-32 is linear. Counting and scoring both find the runs anew, which is cheaper than storing ids.

Only the buckets' gains reach the driver (their number is a parameter). Defined cases: a null or empty text has no
features, weight 0 and is never drawn; a null doc_id draws its noise from the empty id; ties of score go to the smaller
doc_id (null last), rows that repeat a doc_id in any order; without target texts every gain follows from T = 0; an empty
table gives no rows; a text of any length is cut into portions of places, with the words that a run needs beyond the cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import words
from vellum.llm.common import in_order, stash

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
#: Bytes of text that a task holds as arrays, and places in one suffix array: word ids take 21 bits each.
PORTION, PLACES = 1 << 23, 1 << 20
BITS = 21


def _shift_tables(levels: int = 40) -> np.ndarray:
    """tables[j][b][v]: what 2**j zero bytes make of a CRC-32 whose byte b is v, all others 0."""
    column = np.array([(s >> 8) ^ (zlib.crc32(bytes([s & 255])) ^ zlib.crc32(b"\0")) for s in (1 << i for i in range(32))], np.uint32)
    tables, bit = np.zeros((levels, 4, 256), np.uint32), np.arange(256)
    for level in tables:
        for b in range(4):
            for i in range(8):
                level[b] ^= np.where(bit >> i & 1, column[8 * b + i], 0).astype(np.uint32)
        column = _through(level, column)
    return tables


def _through(level: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return level[0][crc & 255] ^ level[1][crc >> 8 & 255] ^ level[2][crc >> 16 & 255] ^ level[3][crc >> 24]


SHIFTS = _shift_tables()


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings behind each other, from theirs and the second's length in bytes."""
    left, j = left.copy(), 0
    while (rest := length >> j).any():
        odd = np.flatnonzero(rest & 1)
        left[odd] = _through(SHIFTS[j], left[odd])
        j += 1
    return left ^ right


class Runs:
    """The suffix array of one portion of places, and the distinct word runs in it.

    ids: word ids from 1, two more places than `n` where the texts go on; last: whether a place is its text's last."""

    def __init__(self, ids: np.ndarray, last: np.ndarray, n: int, crc: np.ndarray, length: np.ndarray):
        following = np.where(last, 0, np.append(ids[1:], 0))
        third = np.where(last, 0, np.append(following[1:], 0))
        key = ((ids << 2 * BITS) | (following << BITS) | third)[:n]
        self.order = np.argsort(key, kind="stable")
        self.key, self.crc, self.length = key[self.order], crc, length
        apart = self.key[1:] ^ self.key[:-1]
        #: words that a suffix shares with the one before it, three at most
        self.lcp = np.concatenate([[-1], (apart >> 2 * BITS == 0).astype(np.int8) + (apart >> BITS == 0) + (apart == 0)])[:n]

    def of(self, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(where the runs of suffixes with k words in common begin, each run's bucket; `buckets` where texts end before)."""
        heads = np.flatnonzero(self.lcp < k)
        key, mask = self.key[heads], (1 << BITS) - 1
        first, second, third = key >> 2 * BITS, key >> BITS & mask, key & mask
        crc = self.crc[first]
        blank, one = np.uint32(zlib.crc32(b" ")), np.ones(len(heads), np.int64)
        for word in (second, third)[: k - 1]:
            crc = joined_crc(joined_crc(crc, blank, one), self.crc[word], self.length[word])
        there = (first, second, third)[k - 1] > 0
        return heads, np.where(there, crc % np.uint32(buckets), buckets).astype(np.int64)


def suffix_runs(texts: pa.Array) -> Iterator[tuple[int, int, Runs, np.ndarray]]:
    """(first place, places, runs, words a text) for each portion of the texts' places."""
    every, counts = words.split(texts, words.ALPHANUMERIC)
    last = np.zeros(len(every) + LONGEST, bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    for lo in range(0, max(len(every), 1), PLACES):
        n = min(PLACES, len(every) - lo)
        part = every.slice(lo, min(n + LONGEST - 1, len(every) - lo)).dictionary_encode()
        known = part.dictionary.to_pylist()
        crc = np.fromiter((zlib.crc32(w) for w in [b"", *known]), np.uint32, len(known) + 1)
        length = np.fromiter((len(w) for w in [b"", *known]), np.int64, len(known) + 1)
        ids = part.indices.to_numpy().astype(np.int64) + 1
        yield lo, n, Runs(ids, last[lo : lo + len(ids)], n, crc, length), counts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often features fall into each bucket, over texts(text)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)
        for portion in words.portions(batches, "text", PORTION):
            for _, n, runs, _ in suffix_runs(portion["text"].combine_chunks()):
                for k in range(1, LONGEST + 1):
                    heads, bucket = runs.of(k, buckets)
                    total += np.bincount(bucket, np.diff(np.append(heads, n)), buckets + 1).astype(np.int64)
        seen = np.flatnonzero(total[:buckets])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    per_task = texts.select("text").mapInArrow(count, "bucket long, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from bucket_counts() of the corpus and of the target texts."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    each = stash(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda name, more: F.col(name).cast("double") + F.lit(float(more))
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return each.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_words, n_features, weight); gain: of each bucket by its number."""
    gain = np.append(gain, 0)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in words.portions(batches, "text", PORTION):
            sums = np.zeros(1, np.int64)
            for _, n, runs, counts in suffix_runs(portion["text"].combine_chunks()):
                at_place = np.zeros(n, np.int64)
                for k in range(1, LONGEST + 1):
                    heads, bucket = runs.of(k, len(gain) - 1)
                    ids = np.empty(n, np.int64)
                    ids[runs.order] = np.repeat(bucket, np.diff(np.append(heads, n)))
                    at_place += gain[ids]
                sums = np.concatenate([sums, sums[-1] + np.cumsum(at_place)])
            features = sum(np.maximum(counts - k, 0) for k in range(LONGEST))
            weight = np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])
            yield pa.RecordBatch.from_arrays(
                [portion["doc_id"].combine_chunks(), *(pa.array(x.astype(np.int64)) for x in (counts, features, weight))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of docs(doc_id, text); rank is null where a document isn't drawn.

    target(text) shows what is wanted; of the documents with LEAST_WORDS words, `percent` in a hundred are drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    by_number = np.zeros(buckets, np.int64)
    for row in gain.collect():  # one row a bucket
        by_number[row["bucket"]] = row["gain"]
    scored = weights(docs, by_number).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stash(scored.withColumn("__row", F.monotonically_increasing_id()), "weights")
    fit = F.col("n_words") >= LEAST_WORDS
    drawn = scored.filter(fit).count() * percent // 100
    placed, _ = in_order(scored, [fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row")])
    rank = F.when(fit & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")
