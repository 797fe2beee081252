"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document's tokens are cut, longest first, into pieces whose lengths are powers of two of at most `longest` tokens (the
binary digits of its length; the top piece repeats for documents beyond it). Every piece is a sequence of its own; those
of equal length form a bucket, so that a batch drawn from one bucket needs no padding. Sequence ids hold the bucket in
their top bits, then the task and a running number, and so are unique without a global sort; a task that is run again
gives the same ids because it reads the same rows.

Each white-space separated word is tokenised once and kept in a bounded cache; the vocabulary's splitting rule never
lets a token span white space, so joining the words' ids gives the ids of the whole text. Defined cases: a null text is
empty and yields the single end token; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 2048
END_ID = 1
CACHED_WORDS = 300_000
#: Words whose ids are gathered together; a longer text is taken alone.
WORDS_AT_ONCE = 500_000
#: ASCII punctuation that may follow a word and never joins it: no apostrophe, which starts contractions.
TAIL = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
)


def pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens, in order."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    bit = longest >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


class Generations:
    """A bounded cache: what is used moves to the younger half, and the older half goes when the younger is full."""

    def __init__(self):
        self.young, self.old, self.long = {}, {}, []  # long: words not worth keeping

    def missing(self, used: set[str]) -> list[str]:
        """The keys that are not known; all others are in the younger half afterwards."""
        young, old, new = self.young, self.old, []
        for w in used.difference(young):
            if (ids := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = ids
        return new

    def age(self) -> None:
        if len(self.young) > CACHED_WORDS:
            for w in self.long:
                self.young.pop(w, None)
            self.young, self.old, self.long = {}, self.young, []


class WordTokens:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary splits a text into runs of letters, digits and other characters before it merges anything, so a word
    of letters followed by punctuation has the ids of its letters, then those of its punctuation. Runs of letters that
    are new are tokenised together, as one text: each ends with the one token that closes a run."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.runs = Tokenizer.from_file(path), Generations(), Generations()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _learn_runs(self, runs: set[str]) -> dict[str, bytes]:
        new = self.runs.missing(runs)
        known = self.runs.young
        for at in range(0, len(new), 5_000):
            some = new[at : at + 5_000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                data, at_byte = ids.tobytes(), 0
                for w, end in zip(some, (4 * ends).tolist(), strict=True):
                    known[w] = data[at_byte:end]
                    at_byte = end
            else:
                self._one_by_one(some, known)
        return known

    def _one_by_one(self, words: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                into[w] = np.asarray(e.ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        words, tails = self.words.young, self.runs.young
        cut, runs, rest = [], [], []
        for w in new:
            run = w.rstrip(TAIL)
            if run.isalpha():
                cut.append(w)
                low = run.lower() if run.isascii() else run
                runs.append(run if low == run else low)  # one string for both caches
            else:
                rest.append(w)
        self._one_by_one(rest, words)
        known = self._learn_runs(set(runs))
        for w, run in zip(cut, runs, strict=True):
            n = len(run)
            if len(w) == n:
                words[w] = known[run]
                continue
            tail = w[n:]
            if tail not in tails:
                self._one_by_one([tail], tails)
            words[w] = known[run] + tails[tail]
        self.words.long += [w for w in new if len(w) > 64]
        self.runs.long += [w for w in runs if len(w) > 64]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of every text; only blanks that every definition of white space agrees on separate words."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        used = coded.dictionary.to_pylist()
        self._learn(self.words.missing(set(used)))
        known = list(map(self.words.young.__getitem__, used))
        ids, size = np.frombuffer(b"".join(known), dtype="<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        word, first = coded.indices.to_numpy(), lists.offsets.to_numpy()
        edges = (first - first[0]).astype(np.int64)
        a, n = 0, len(edges) - 1
        while a < n:  # some texts at once, the ids of all their words gathered together
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + WORDS_AT_ONCE, "right")) - 1)
            w = word[edges[a] : edges[b]]
            ends = np.concatenate([[0], np.cumsum(size[w])])
            at = np.repeat(begin[w] - ends[:-1], size[w])
            at += np.arange(len(at))
            data, cuts = ids[at].tobytes(), (4 * ends[edges[a : b + 1] - edges[a]]).tolist()
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield data[start:end]
            a = b
        self.words.age()
        self.runs.age()


_ENCODERS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One encoder for all tasks of a Python worker, so that later tasks start with a warm cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordTokens(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text); with_ids adds the piece's token ids."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, count, encoder = (context.partitionId() if context else 0), 0, word_tokens(tokenizer_path)
        gc.disable()  # nothing here is cyclic, and the collector would walk the caches time and again
        try:
            yield from packed(batches, task, count, encoder)
        finally:
            gc.freeze()  # what is cached by now stays out of later collections in this worker
            gc.enable()

    def packed(batches: Iterator[pa.RecordBatch], task: int, count: int, encoder: WordTokens) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8 + with_ids)]
            for doc, ids_of in zip(b["doc_id"].to_pylist(), encoder.encode_all(b["text"]), strict=True):
                data = ids_of + end
                n = len(data) // 4
                for start, length in pieces(n, longest):
                    ids, bucket = data[4 * start : 4 * (start + length)], length.bit_length() - 1
                    row = (doc, start, length, zlib.crc32(ids), n, (bucket << 58) | (task << 36) | count, 0, bucket)
                    for col, v in zip(out, row, strict=False):
                        col.append(v)
                    if with_ids:
                        out[8].append(np.frombuffer(ids, "<u4").astype(np.int64))
                    count += 1
            arrays = [pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                arrays.append(pa.array(out[8], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
