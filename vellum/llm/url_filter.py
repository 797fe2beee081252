"""URL filters by a Bloom filter cascade, in DataFrame operations only.

A list of keys, each a host followed by a path prefix (`example.org/es/`), fits a URL when the URL's host is the key's
host or a subdomain of it and the URL's path starts with the key's path. Every URL therefore asks for a small set of
candidate keys: each of its host's suffixes with each of the listed path lengths. The distinct candidates of the whole
corpus are the key universe.

Level 1 encodes the listed keys. The universe's false positives there are encoded by level 2, the listed keys that pass
level 2 by level 3, and so on until a level has no false positives. A key of the universe is then listed exactly when the
first level that it fails is an even one (or it passes all of an odd number): membership is exact and costs no join.

A list of any length is dealt by hash into parts of about MAX_KEYS, a cascade each, so that no more keys than that, and
their filters, are held at once; the parts are judged one after the other. Level 1 gets as many bits as make the expected false
positives no more than the keys, and is enlarged until the counted ones are at most FALSE_PER_KEY times the keys, before
any of them come to the driver: filters and what builds them stay in proportion to the list, whatever the corpus's size.

Defined cases: a null URL or one without :// has an empty host and path, which fit no key; a URL may fit several keys
of one list, and the longest wins, then the longer host; repeated URLs are judged alike; an empty list holds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import drop, stash

#: Keys of one cascade, about: what the driver holds of a list at a time.
MAX_KEYS = 250_000
FALSE_PER_KEY = 4
HASHES = 3
#: Share of other keys that pass a level after the first.
LATER_SHARE = 1 / 16
SEEDS = (101, 202)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the production filter: (verdict, key).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: The production list of blocked hosts, a stand-in for a bought one: of the corpus's hosts those whose MD5 begins below
#: LISTED_BELOW, one in sixteen.
LISTED_BELOW = "1"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_hosts(pages: DataFrame, url: str = "url", below: str = LISTED_BELOW) -> DataFrame:
    """The stand-in list, as a table(key)."""
    hosts = pages.select(host_of(url).alias("key")).filter("key <> ''").distinct()
    return hosts.filter(F.substring(F.md5("key"), 1, len(below)) < below)


def split_key(key: str) -> tuple[str, str]:
    host, slash, path = key.partition("/")
    return host, slash + path


@dataclass(frozen=True)
class Shape:
    """How many labels the hosts of a list's keys have at most, and the lengths of their paths."""

    labels: int
    lengths: tuple[int, ...]

    @classmethod
    def of(cls, keys: Sequence[str]) -> Shape:
        return cls(max((split_key(k)[0].count(".") + 1 for k in keys), default=1), tuple(sorted({len(split_key(k)[1]) for k in keys}, reverse=True)))

    @classmethod
    def of_table(cls, keys: DataFrame) -> Shape:
        host = F.substring_index("key", "/", 1)
        labels = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1
        lengths = F.collect_set(F.char_length("key") - F.char_length(host))  # as many as there are lengths of paths
        r = keys.agg(F.max(labels).alias("labels"), lengths.alias("lengths")).first()
        return cls(r["labels"] or 1, tuple(sorted(r["lengths"], reverse=True)))


def candidates(host: str, path: str, shape: Shape) -> Column:
    """Array of the keys that could list this URL: its host's suffixes by the listed path lengths, longest first."""
    # an empty host has no candidates
    tails = [F.substring_index(F.col(host), ".", -n) for n in range(shape.labels, 0, -1)]
    out = []
    for n in shape.lengths:
        fits = F.char_length(F.col(path)) >= n
        out += [F.when(fits & (F.col(host) != ""), F.concat(t, F.substring(F.col(path), 1, n))) for t in tails]
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull())) if out else F.array().cast("array<string>")


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(s)) for s in SEEDS]


@dataclass
class Level:
    bits: int
    words: list[int]

    @classmethod
    def of(cls, hashes: Sequence[tuple[int, int]], share: float, number: int = 0) -> Level:
        """A filter for these key hashes that about this share of other keys passes.

        Levels of different numbers differ in size, so that two keys don't meet in all spots of each."""
        bits = (max(64, math.ceil(-HASHES * max(1, len(hashes)) / math.log(1 - share ** (1 / HASHES)))) | 1) + 2 * number
        level = cls(bits, [0] * (bits // 32 + 1))
        for h in hashes:
            for at in level._spots(h):
                level.words[at // 32] |= 1 << (at % 32)
        return level

    def _spots(self, h: tuple[int, int]) -> list[int]:
        a, b = h[0] % self.bits, h[1] % self.bits
        return [(a + i * b) % self.bits for i in range(HASHES)]

    def has(self, h: tuple[int, int]) -> bool:
        return all(self.words[at // 32] >> (at % 32) & 1 for at in self._spots(h))

    def test(self, hashes: list[Column]) -> Column:
        table = F.lit(b"".join(w.to_bytes(4, "little") for w in self.words))  # one binary literal
        a, b = (F.pmod(h, F.lit(self.bits).cast("long")) for h in hashes)
        found = None
        for i in range(HASHES):
            at = F.pmod(a + b * i, F.lit(self.bits).cast("long"))
            byte = F.ascii(F.decode(F.substring(table, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
            bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) != 0
            found = bit if found is None else found & bit
        return found


@dataclass
class Cascade:
    levels: list[Level]

    @classmethod
    def build(cls, listed: Sequence[str], universe: DataFrame, size: int) -> Cascade:
        """universe(key) holds every key that will be asked for, repeats allowed; size is at least its number of keys."""
        listed = sorted(set(listed))
        if not listed:
            return cls([])
        spark = universe.sparkSession
        rows = spark.createDataFrame([(k,) for k in listed], "key string").select("key", *[h.alias(f"h{i}") for i, h in enumerate(_hashes(F.col("key")))])
        keys = {(r["h0"], r["h1"]) for r in rows.collect()}
        share = min(0.5, len(keys) / max(1, size))
        while True:
            first = Level.of(sorted(keys), share)
            passing = universe.filter(first.test(_hashes(F.col("key")))).select("key").distinct()
            bound = (FALSE_PER_KEY + 1) * len(listed) + 1000  # listed keys of the universe pass too
            got = passing.select("key", *[h.alias(f"h{i}") for i, h in enumerate(_hashes(F.col("key")))]).limit(bound + 1).collect()
            if len(got) <= bound:  # all of them, then
                break
            share /= 4
        own = set(listed)
        inside, outside = keys, {(r["h0"], r["h1"]) for r in got if r["key"] not in own}
        if inside & outside:
            raise ValueError("two keys share both 64-bit hashes")
        levels = [first]
        while outside:
            levels.append(Level.of(sorted(outside), LATER_SHARE, len(levels)))
            inside, outside = outside, {h for h in inside if levels[-1].has(h)}
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """Exact membership of a key of the universe."""
        if not self.levels:
            return F.lit(False)
        hashes = _hashes(key)
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].test(hashes), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def _longest(found: Column) -> Column:
    """The longest key of an array, then the one with the longer host."""
    ranked = F.transform(found, lambda k: F.struct(F.char_length(k).alias("n"), F.char_length(F.substring_index(k, "/", 1)).alias("h"), k.alias("k")))
    return F.array_max(ranked)["k"]


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(303)), F.lit(parts))


def _held(asks: Column, cascade: Cascade, parts: int, part: int) -> Column:
    """The keys of an array that this part of a list holds."""
    return F.filter(asks, lambda k: (_part(k, parts) == part) & cascade.holds(k))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, listed: Sequence[str] | DataFrame | None = None, most_keys: int = MAX_KEYS) -> DataFrame:
    """pages' own columns with host, path, rule, listed_as and verdict.

    A fitting rule decides, the longest first; where none fits, a URL on the list is blocked and any other allowed. The
    list, keys or a table(key), is that of listed_hosts() unless given."""
    spark = pages.sparkSession
    listed = listed_hosts(pages, url) if listed is None else listed
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(k,) for k in listed], "key string")
    listed = stash(listed.select("key").distinct(), "listed")
    shapes = [Shape.of([k for _, k in rules]), Shape.of_table(listed)]
    rows = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    asks = [candidates("host", "path", shape) for shape in shapes]
    total = pages.count()
    sizes = [total * shape.labels * max(1, len(shape.lengths)) for shape in shapes]
    universe = [rows.select(F.explode(a).alias("key")) for a in asks]
    allow = Cascade.build([k for v, k in rules if v == "allow"], universe[0], sizes[0])
    block = Cascade.build([k for v, k in rules if v == "block"], universe[0], sizes[0])
    fits = F.filter(F.col("__asks"), lambda k: allow.holds(k) | block.holds(k))
    rows = rows.withColumn("__asks", asks[0]).withColumn("rule", _longest(fits)).drop("__asks").withColumn("listed_as", F.lit(None).cast("string"))
    parts = max(1, -(-listed.count() // most_keys))
    judged = None
    for part in range(parts):
        mine = _part(F.col("key"), parts) == part
        keys = [r["key"] for r in listed.filter(mine).collect()]
        more = Cascade.build(keys, universe[1].filter(mine), sizes[1])
        found = _held(asks[1], more, parts, part)
        rows = rows.withColumn("listed_as", _longest(F.array_compact(F.array_append(found, F.col("listed_as")))))
        if parts > 1:  # a plan holds one part's filters
            rows = stash(rows, "judged")
            if judged is not None:
                drop(judged)
            judged = rows
    drop(listed)
    by_rule = F.when(block.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.when(F.col("rule").isNotNull(), by_rule).when(F.col("listed_as").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", verdict)
