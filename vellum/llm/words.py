"""Words of whole texts as Arrow arrays, without a Python object a word.

A rule says which bytes of UTF-8 text belong to words; A-Z count as a-z. The texts of a batch are read as one byte array:
its words lie behind each other in one buffer, with their places and the number of words of each text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Rule:
    """outside: the bytes that separate words, after A-Z are lowered."""

    outside: bytes

    @property
    def inside(self) -> np.ndarray:
        is_word = np.ones(256, bool)
        is_word[list(self.outside)] = False
        is_word[65:91] = is_word[97:123]
        return is_word

    @property
    def dropped(self) -> bytes:
        return bytes(np.flatnonzero(~self.inside).astype(np.uint8))


#: [^\x20\x09-\x0D]+
SPACED = Rule(bytes([0x20, *range(0x09, 0x0E)]))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALPHANUMERIC = Rule(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def split(texts: pa.Array, rule: Rule) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, as bytes; how many each text has). A null text has none."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    held = flat.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.empty(0, np.uint8)
    at = at - at[0]
    is_word = rule.inside[data]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    cut = at[:-1][np.diff(at) > 0]  # a word never goes on in the next text
    begins[cut] = is_word[cut]
    last = at[1:][np.diff(at) > 0] - 1
    ends[last] = is_word[last]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    places = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(ends - begins + 1, out=places[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(data.tobytes().translate(LOWER, rule.dropped))])
    return words, np.diff(np.searchsorted(begins, at))


def portions(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """The batches joined until their texts hold `most` bytes; a longer text is a portion by itself."""
    held, size = [], 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), np.int64)
        lo = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                held.append(batch.slice(lo, i - lo))
                yield pa.Table.from_batches(held)
                held, size, lo = [], 0, i
            size += int(n)
        held.append(batch.slice(lo))
    if held and sum(len(b) for b in held):
        yield pa.Table.from_batches(held)
