"""N-gram Jaccard join by PartEnum signatures: exact groups of documents whose word shingles overlap enough.

A document's set holds the 64-bit hashes of its distinct runs of `n` words (ASCII letters lower-cased, split at ASCII
blanks; a shorter text is one run). Sets of similar size share a band: band i spans sizes [l, 4l/3] for a threshold of
3/4, and a set works in its own band and in the next, so any two similar sets meet in one. In a band whose largest size
is r, similar sets differ in at most k = 2r/7 features. The feature domain is hashed into n1 partitions of n2 parts each,
and every subset of n2 - k2 parts of a partition is a signature: with n1 > k / (k2 + 1), similar sets agree on one. In
bands with k of at most TINY every feature is a part of its own and the subsets are those with up to k features left out.

Signatures of nothing would gather unrelated sets, so a set leaves them out wherever that is safe. A partition with e
empty parts has no agreeing signature with content only if min(k2 + 1, n2 - e) of its parts differ. If these costs add
up to more than the features in which this set can differ from any partner of the band, every partner agrees with it on
a signature with content. A band has `spare` more partitions than needed, so that few sets fail this test; those that do
emit all signatures.

Exact copies are joined by a hash of their words, and only the first in a task works further. Signatures travel as
sorted, packed arrays, one row per task and range of signatures. Within a bucket the smallest id is compared with each
other; where the links found so far leave a bucket with several components, all pairs across components are tested
against a bound from bit maps of the sets, by pairs of blocks, and what passes is compared in full. So no link that
could join two components is missed, yet thousands of near copies cost one comparison each. Links and members never
reach the driver. What a range's task holds is its share of the signatures plus the distinct texts, first of their task,
that share its most common one.

Defined cases: null, empty or blank texts have size 0 and link with nothing (their component is their own id); rows that
repeat a doc_id are one node, linked with whatever any of them is; a null doc_id stays alone, its component is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import components, drop, join_with_hot_keys, stash

U = np.uint64
TINY = 2
#: Signatures of one packed array at a receiver, and those that a task gathers before it sends.
RANGE_SIGNATURES, HELD_SIGNATURES = 400_000, 1_000_000
#: Members of one block, and of the small groups that a task takes together.
BLOCK, TOGETHER = 1000, 2000
#: Words' digests that a task remembers, bytes of text hashed at a time, and sets whose signatures are made together.
SEEN, CHUNK, SETS = 200_000, 1 << 18, 64
GOLDEN = U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    n: int = 5
    above: int = 75  # links need 100 * intersection >= above * union
    n2: int = 3
    k2: int = 1
    spare: float = 0.04


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit counter generator; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _factors(place: np.ndarray) -> np.ndarray:
    """An odd factor for each place in a word."""
    return mix(place.astype(U) * GOLDEN + U(0x5851F42D4C957F2D)) | U(1)


BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
with np.errstate(over="ignore"):
    #: A number per byte, equal for both cases of an ASCII letter, none for blanks.
    BYTE = np.where(BLANK, U(0), mix((np.arange(1, 257) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0)).astype(U) * GOLDEN))
    FACTOR = _factors(np.arange(4096))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the offset at which each text's words begin, plus the end.

    A word's hash is the sum, over its bytes, of a number for the byte times a factor for its place."""
    large = lambda x: pa.scalar(x, pa.large_string())
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), large(""), large("\n"))
    offsets = np.frombuffer(ended.buffers()[1], dtype=np.int64)[ended.offset : ended.offset + len(ended) + 1]
    raw = np.frombuffer(ended.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(ended) else np.zeros(0, np.uint8)
    blank = BLANK[raw]
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(before & ~blank)
    hashes = np.zeros(len(starts), dtype=U)
    with np.errstate(over="ignore"):
        for c in range(0, len(raw), CHUNK):
            end = min(c + CHUNK, len(raw))
            i, j = max(0, int(np.searchsorted(starts, c, "right")) - 1), int(np.searchsorted(starts, end))
            if i == j:
                continue
            cuts = np.maximum(starts[i:j] - c, 0)
            place = np.arange(c + cuts[0], end) - np.repeat(starts[i:j], np.diff(np.append(cuts, end - c)))
            factor = FACTOR[place] if place.max() < len(FACTOR) else _factors(place)
            hashes[i:j] += np.add.reduceat(BYTE[raw[c + cuts[0] : end]] * factor, cuts - cuts[0])
        return mix(hashes), np.searchsorted(starts, offsets - offsets[0])


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """Per text: the digest of its words (None without words) and its sorted distinct shingle hashes."""
    words, first = word_hashes(texts)
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(words) - n + 1), dtype=U)
        for i, factor in enumerate(_factors(np.arange(n) + (1 << 40))):
            run += words[i : i + len(run)] * factor
        run = mix(run)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            yield None, np.zeros(0, dtype=U)
            continue
        digest = hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest()
        if b - a < n:
            yield digest, np.frombuffer(digest[:8], dtype=U)
        else:
            x = np.sort(run[a : b - n + 1])
            fresh = x[1:] != x[:-1]
            yield digest, x if fresh.all() else np.concatenate([x[:1], x[1:][fresh]])


class Bands:
    """Size bands and the shape of their partitions."""

    def __init__(self, s: Settings):
        self.s, self.low, self.high = s, [1], []
        self.shapes: dict[int, tuple[int, int]] = {}

    def of(self, size: int) -> int:
        while len(self.high) < len(self.low) or self.high[-1] < size:
            if len(self.high) < len(self.low):
                self.high.append(self.low[-1] * 100 // self.s.above)
            else:
                self.low.append(self.high[-1] + 1)
        return int(np.searchsorted(self.high, size))

    def most(self, band: int) -> int:
        while len(self.high) <= band:
            self.of(self.high[-1] + 1 if self.high else 1)
        return self.high[band]

    def shape(self, band: int) -> tuple[int, int]:
        """(k, n1) of a band."""
        if band not in self.shapes:
            k = self.differing(2 * self.most(band))
            need = k // (self.s.k2 + 1) + 1
            self.shapes[band] = k, int(np.ceil((need + 1) / (1 - self.s.spare))) if k else 1
        return self.shapes[band]

    def differing(self, sizes: int) -> int:
        """The most features in which two linked sets differ, by the sum of their sizes."""
        return sizes * (100 - self.s.above) // (100 + self.s.above)

    def reach(self, size: int, band: int) -> int:
        """The most features in which a set of this size differs from a partner in the band."""
        return self.differing(size + min(size * 100 // self.s.above, self.most(band)))


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) for all sets of a batch."""
    s = bands.s
    out_sig, out_set = [], []
    subsets = [list(c) for c in combinations(range(s.n2), s.n2 - s.k2)]
    work: list[list] = [[], [], [], []]  # set index, band, n1, reach
    with np.errstate(over="ignore"):
        for i, x in enumerate(sets):
            if not len(x):
                continue
            own = bands.of(len(x))
            for band in (own, own + 1):
                k, n1 = bands.shape(band)
                if k <= TINY:
                    h = mix(x)
                    total = h.sum(dtype=U)
                    left_out = [total]
                    for d in range(1, min(k, len(x) - 1) + 1):
                        left_out += [total - h[list(c)].sum(dtype=U) for c in combinations(range(len(x)), d)]
                    sig = mix(np.array(left_out, dtype=U) + U(band + 1) * GOLDEN)
                    out_sig.append(sig)
                    out_set.append(np.full(len(sig), i))
                else:
                    for col, v in zip(work, (i, band, n1, bands.reach(len(x), band)), strict=True):
                        col.append(v)
        if work[0]:
            which, band, n1, reach = (np.array(c, dtype=np.int64) for c in work)
            size = np.array([len(sets[i]) for i in which])
            every = mix(np.concatenate([sets[i] for i in which]) ^ U(0x5851F42D4C957F2D))
            slots = n1 * s.n2
            base = np.concatenate([[0], np.cumsum(slots)])
            # the upper half of the hash, scaled to the slots of its set
            slot = (((every >> U(32)) * np.repeat(slots.astype(U), size)) >> U(32)).astype(np.int64) + np.repeat(base[:-1], size)
            value = mix(every)
            # exact 64-bit sums from two halves, each far below 2^53
            low = np.bincount(slot, weights=(value & U(0xFFFFFFFF)).astype(np.float64), minlength=base[-1]).astype(U)
            high = np.bincount(slot, weights=(value >> U(32)).astype(np.float64), minlength=base[-1]).astype(U)
            sums = ((high << U(32)) + low).reshape(-1, s.n2)
            empty = sums == 0
            part_row = np.repeat(np.arange(len(which)), n1)
            number = np.arange(len(part_row)) - np.repeat(base[:-1] // s.n2, n1)
            cost = np.minimum(s.k2 + 1, s.n2 - empty.sum(1))
            all_of_it = (np.add.reduceat(cost, base[:-1] // s.n2) <= reach)[part_row]
            place = mix((band[part_row].astype(U) << U(40)) + number.astype(U) * U(16))
            owner = which[part_row]
            for j, c in enumerate(subsets):
                keep = all_of_it | ~empty[:, c].all(1)
                folded = np.zeros(len(sums), dtype=U)
                for p in c:
                    folded = mix(folded * U(3) + sums[:, p] + U(p + 1))
                out_sig.append((folded ^ mix(place + U(j)))[keep])
                out_set.append(owner[keep])
    if not out_sig:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def pack_planes(values: np.ndarray) -> bytes:
    """64-bit numbers by byte plane, compressed: equal high bytes cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_planes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(U)[:, 0]


def describe(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, words, n_shingles, bits): the digest of each row's words, its set's size and bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets = [list(c) for c in zip(*shingle_sets(b["text"], s.n), strict=True)] or [[], []]
            columns = [b["doc_id"], pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(bit_maps(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "n_shingles", "bits"])

    return docs.mapInArrow(run, "doc_id long, words binary, n_shingles long, bits binary")


def packed_signatures(docs: DataFrame, ranges: int, s: Settings) -> DataFrame:
    """(part, sigs, ids): the signatures of each range that a task found, sorted, as steps, with their documents.

    48 bits of a signature travel; two that agree there by chance cost a comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, held_sig, held_id, held = Bands(s), set(), [], [], 0

        def flush() -> pa.RecordBatch:
            sig, ids = np.concatenate(held_sig), np.concatenate(held_id)
            order = np.argsort(sig)
            sig, ids = sig[order], ids[order]
            part = ((sig >> U(32)) * U(ranges)) >> U(32)
            cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=U))
            sig >>= U(16)
            rows = [(p, pack_planes(np.diff(sig[a:b], prepend=U(0))), pack_planes(ids[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "sigs", "ids"])

        for b in batches:
            ids, sets = [], []
            for doc, (key, x) in zip(b["doc_id"].to_pylist(), shingle_sets(b["text"], s.n), strict=True):
                if key is not None and doc is not None and key not in seen:
                    if len(seen) >= SEEN:  # a copy that comes again only costs a comparison
                        seen.clear()
                    seen.add(key)
                    ids.append(doc)
                    sets.append(x)
            for at in range(0, len(sets), SETS):
                sig, which = signatures(sets[at : at + SETS], bands)
                held_sig.append(sig)
                held_id.append(np.array(ids[at : at + SETS], dtype=np.int64)[which])
                held += len(sig)
                if held >= HELD_SIGNATURES:
                    yield flush()
                    held_sig, held_id, held = [], [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "part int, sigs binary, ids binary")


def buckets(packed: DataFrame) -> DataFrame:
    """(rep, id, bucket): the documents that share a signature with a smaller one, the smallest of its bucket.

    Buckets with the same members have the same number, which is null where there is only one such document."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.concatenate([np.cumsum(unpack_planes(b), dtype=U) for b in pdf["sigs"]])
        ids = np.concatenate([unpack_planes(b) for b in pdf["ids"]]).view(np.int64)
        order = np.argsort(sig)
        sig = sig[order]
        same = np.concatenate([[False], sig[1:] == sig[:-1]])
        same[:-1] |= same[1:]
        sig, ids = sig[same], ids[order[same]]
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])[: len(sig)]
        sig, ids = sig[fresh], ids[fresh]
        edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, np.int64)
        found: dict[int, np.ndarray] = {}
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                group = ids[a:b]
                found[xxhash.xxh3_64_intdigest(group.tobytes())] = group
        sizes = np.array([len(g) - 1 for g in found.values()], dtype=np.int64)
        rep = np.repeat(np.array([g[0] for g in found.values()], dtype=np.int64), sizes)
        member = np.concatenate([g[1:] for g in found.values()]) if found else np.zeros(0, np.int64)
        bucket = pd.array(np.repeat(np.array(list(found), dtype=U).view(np.int64), sizes), dtype="Int64")
        bucket[np.repeat(sizes == 1, sizes)] = pd.NA
        return pd.DataFrame({"rep": rep, "id": member, "bucket": bucket}).drop_duplicates()

    return packed.groupBy("part").applyInPandas(gather, "rep long, id long, bucket long")


def full_sets(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(id, shingles): the packed sets of the documents in ids(id)."""
    few = ids.count() <= 1_000_000
    wanted = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x.tobytes() for _, x in shingle_sets(b["text"], s.n)], pa.binary())], ["id", "shingles"])

    return wanted.select("doc_id", "text").mapInArrow(run, "id long, shingles binary")


def bit_maps(sets: list[np.ndarray]) -> list[bytes]:
    """Parities of the features per cell, at least two cells a feature, a power of two, for each set.

    Two maps differ only in cells with an odd number of differing features: what sets share never hides a difference."""
    if not sets:
        return []
    n = np.array([len(x) for x in sets])
    size = np.array([max(64, 1 << max(0, 2 * k - 1).bit_length()) for k in n.tolist()])
    base = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        cell = mix(np.concatenate(sets) ^ U(0x2545F4914F6CDD1D)) & np.repeat((size - 1).astype(U), n)
    odd = np.bincount(cell.astype(np.int64) + np.repeat(base[:-1], n), minlength=base[-1]) & 1
    packed, at = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes(), (base // 8).tolist()
    return [packed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def folded(bits, size: int) -> np.ndarray:
    """The map of half, a quarter ... as many cells."""
    raw = np.frombuffer(bits, dtype=np.uint8)
    while len(raw) > size:
        raw = raw[: len(raw) // 2] ^ raw[len(raw) // 2 :]
    return raw


def may_link(a: int, b: int, differing: np.ndarray | int, above: int):
    """Whether sets of these sizes that differ in at least so many features can link."""
    most = np.minimum((a + b - differing) // 2, np.minimum(a, b))
    return 100 * most >= above * (a + b - most)


def plausible(pairs: DataFrame, info: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of different texts that sizes and bit maps don't rule out: sets differ in at least as many features as maps in bits."""
    side = lambda c: info.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("bits").alias(f"m{c}"), F.col("words").alias(f"w{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("wa") != F.col("wb"))
    lesser, larger = F.least("na", "nb"), F.greatest("na", "nb")
    both = both.filter(100 * lesser >= s.above * larger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for na, nb, x, y in zip(r["na"].to_pylist(), r["nb"].to_pylist(), r["ma"], r["mb"], strict=True):
                width = min(len(x.as_buffer()), len(y.as_buffer()))
                u, v = folded(x.as_buffer(), width).view(U), folded(y.as_buffer(), width).view(U)
                keep.append(bool(may_link(na, nb, int(np.bitwise_count(u ^ v).sum()), s.above)))
            yield pa.RecordBatch.from_arrays([r["a"], r["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    sets = stash(full_sets(docs, stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"), s), "sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for x, y in zip(r["sa"], r["sb"], strict=True):
                u, v = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                both_sets = np.concatenate([u, v])
                both_sets.sort(kind="stable")
                same = int(np.count_nonzero(both_sets[1:] == both_sets[:-1]))
                keep.append(100 * same >= s.above * (len(u) + len(v) - same))
            yield pa.RecordBatch.from_arrays([r["a"], r["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stash(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct(), "verified")
    drop(sets)
    return out


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components, ca and cb."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    both = both.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    return both.filter("ca <> cb")


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: whole components are the nodes that these tie together."""
    ends = apart(links, comps)
    larger = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("node", "c").withColumnRenamed("component", "larger")
    nodes = comps.unionByName(ends.select(F.explode(F.array("ca", "cb")).alias("node")).withColumn("component", F.col("node"))).groupBy("node").agg(F.min("component").alias("c"))
    sizes = nodes.groupBy("c").agg(F.count("*").alias("n")).join(larger, "c")
    out = join_with_hot_keys(nodes, sizes, "c", "n", nodes.count())
    return stash(out.select("node", F.coalesce("larger", "c").alias("component")), "components")


def across(rows: DataFrame, stars: DataFrame, comps: DataFrame, info: DataFrame, s: Settings) -> DataFrame:
    """Pairs within a bucket, but in different components, that the bit maps don't rule out.

    Buckets are gathered by their smallest member, so a document's bit map is sent once for all buckets that share it,
    not once a bucket. Pairs with the smallest member itself were compared before. Documents around one smallest member
    are dealt into blocks, and each pair of blocks is compared by itself."""
    around = stars.select(F.col("a").alias("rep"), F.col("b").alias("id"))
    around = around.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("rep", "id", F.coalesce("component", "id").alias("c"))
    mixed = around.groupBy("rep").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).filter("c0 <> c1")
    mixed = stash(mixed.select("rep", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"), "m"), "mixed")
    total = mixed.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()["m"]
    together = int(max(8, -(-total // TOGETHER)))
    held = rows.filter("bucket is not null")
    held = join_with_hot_keys(held, mixed, "rep", "m", held.count()).filter("parts is not null")
    held = held.groupBy("rep", "id", "parts").agg(F.collect_set("bucket").alias("buckets"))
    held = held.join(comps.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    held = held.join(info.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bits"), "id")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    place = F.xxhash64("rep", "p", "q")
    held = held.withColumn("g", F.when(F.col("parts") > 1, place).otherwise(F.pmod(place, F.lit(together))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [crossing(group, int(p), int(q), s.above) for (_, p, q), group in pdf.groupby(["rep", "p", "q"], sort=False)]
        got = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": got.min(0), "b": got.max(0)}).drop_duplicates()

    return held.select("g", "rep", "p", "q", "own", "id", "c", "n", "bits", "buckets").groupBy("g").applyInPandas(compare, "a long, b long").distinct()


def crossing(group: pd.DataFrame, p: int, q: int, above: int) -> np.ndarray:
    """Plausible pairs across components, one of block p and one of block q, of documents that share a bucket."""
    none = np.zeros((2, 0), dtype=np.int64)
    ids, comp, sizes = group["id"].to_numpy(), group["c"].to_numpy(), group["n"].to_numpy().astype(np.int64)
    here, there = (np.flatnonzero(group["own"].to_numpy() == x) for x in (p, q))
    if not len(here) or not len(there) or (comp == comp[0]).all():
        return none
    lengths = group["buckets"].map(len).to_numpy()
    bucket, row = np.concatenate(group["buckets"].to_list()), np.repeat(np.arange(len(ids)), lengths)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1, append=bucket[order[-1]] + 1))
    place = np.full((2, len(ids)), -1)
    place[0, here], place[1, there] = np.arange(len(here)), np.arange(len(there))
    together = np.zeros((len(here), len(there)), dtype=bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        members = row[order[a:b]]
        if (comp[members] != comp[members[0]]).any():
            x, y = place[0, members], place[1, members]
            together[np.ix_(x[x >= 0], y[y >= 0])] = True
    i, j = np.nonzero(together)
    i, j = here[i], there[j]
    keep = (comp[i] != comp[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= above * np.maximum(sizes[i], sizes[j]))
    if p == q:
        keep &= i < j
    i, j = i[keep], j[keep]
    if not len(i):
        return none
    bits = group["bits"].to_numpy()
    widths = np.array([len(b) for b in bits])
    # a pair is compared at the width of its smaller map
    level, out = np.minimum(widths[i], widths[j]), [none]
    for w in np.unique(level).tolist():
        x, y = i[level == w], j[level == w]
        used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        maps = np.stack([folded(bits[k], w) for k in used.tolist()]).view(U)
        step = max(1, (1 << 22) // w)
        for a in range(0, len(x), step):
            u, v = x[a : a + step], y[a : a + step]
            differing = np.bitwise_count(maps[at[: len(x)][a : a + step]] ^ maps[at[len(x) :][a : a + step]]).sum(1).astype(np.int64)
            ok = may_link(sizes[u], sizes[v], differing, above)
            out.append(np.stack([ids[u[ok]], ids[v[ok]]]))
    return np.concatenate(out, axis=1)


def described_groups(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """What describe() tells of every row, stashed, and the components of those that link."""
    info = stash(describe(docs, s), "sizes")
    total = info.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    real = info.filter("doc_id is not null and words is not null")
    first = real.groupBy("words").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = join_with_hot_keys(real.select("doc_id", F.hex("words").alias("w")), first.select(F.hex("words").alias("w"), "first", "n"), "w", "n", info.count())
    copies = copies.filter("first is not null and first <> doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    ranges = int(max(8, -(-total // RANGE_SIGNATURES)))
    rows = stash(buckets(packed_signatures(docs, ranges, s)), "buckets")
    every_star = stash(rows.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "all_stars")
    stars = stash(plausible(every_star, real, s), "stars")
    # one comparison for each document first; then only for pairs that are still apart
    nearest = stash(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "nearest")
    comps = components(verified(nearest, docs, s).unionByName(copies))
    for pairs in (lambda c: apart(stars.join(nearest, ["a", "b"], "left_anti"), c).select("a", "b"), lambda c: across(rows, every_star, c, real, s)):
        more = stash(pairs(comps), "pairs")
        if more.limit(1).count():
            comps = joined(comps, verified(more, docs, s))
    for table in (rows, every_star, stars, nearest):
        drop(table)
    return info, comps


def groups(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    info, comps = described_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), settings or Settings())
    out = info.join(comps, info["doc_id"] == comps["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of docs, all columns, without those whose group has a smaller doc_id.

    Of rows that repeat both doc_id and text one stays; rows that repeat only the doc_id are kept or dropped together."""
    info, comps = described_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), settings or Settings())
    gone = comps.filter("node <> component").select(F.col("node").alias("__gone"))
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    again = stash(info.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")), "repeated_ids")
    if not again.limit(1).count():
        return kept
    alone = kept.join(again, kept["doc_id"] == again["__again"], "left_anti")
    several = kept.join(again, kept["doc_id"] == again["__again"], "left_semi")
    text = F.coalesce("text", F.lit(""))
    one = several.groupBy("doc_id", F.sha2(text, 256).alias("__text")).agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return alone.unionByName(one.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
