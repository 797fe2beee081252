"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean trigram query is derived: a conjunction of alternatives, each a set of trigrams that a
match must hold (letters folded to lower case). A posting list is kept for every trigram of the queries; a rule's
candidates are the documents in the intersections and unions of the postings that its query asks for. Only candidates
are verified with the regex. A rule whose regex has no mandatory trigram, such as a run of hex digits, scans every text.

A verified match becomes a span: the text is cut at its matches, and running sums of the pieces' lengths, taken in a
window per document and rule, give code point offsets in linear time. Per rule, matches are leftmost and don't overlap;
those that fail the rule's length are dropped after matching, as they have consumed their text.

Defined cases: a null text is empty; rows that repeat a doc_id are scanned one by one; a row without doc_id too.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import join_with_hot_keys


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    fold: bool = False  # letters in either case

    @property
    def regex(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


#: The three base kinds, then those that are added.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: Strings that a sub-pattern may spell are listed while there are no more than this many.
MOST_STRINGS = 64

Query = list[list[frozenset[str]]]  # all of (any of (all of these trigrams))


def trigram_query(pattern: str) -> Query:
    """Conditions that every match of the pattern meets; empty where it has no mandatory trigram."""
    query: Query = []

    def close(strings: set[str] | None) -> None:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings or ()]
        if sets and all(sets):
            query.append([s for s in sets if not any(o < s for o in sets)])

    def walk(items) -> set[str] | None:
        """All strings that the items may spell, or None where they are too many; runs that end are added to the query."""
        run: set[str] | None = {""}
        open_ended = False
        for op, arg in items:
            got = spell(op, arg)
            joined = {a + b for a, b in product(run, got)} if got is not None and len(run) * len(got) <= MOST_STRINGS else None
            if joined is None:
                close(run)
                run, open_ended = (got if got is not None else {""}), True
            else:
                run = joined
        if not open_ended:
            return run
        close(run)
        return None

    def spell(op, arg) -> set[str] | None:
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN:
            chars: set[str] = set()
            for kind, v in arg:
                if kind is C.LITERAL:
                    chars.add(chr(v).lower())
                elif kind is C.RANGE:
                    chars.update(chr(c).lower() for c in range(v[0], v[1] + 1))
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is C.SUBPATTERN:
            return walk(arg[-1])
        if op is C.BRANCH:
            every: set[str] = set()
            for branch in arg[1]:
                # an alternative without a list of strings makes the whole choice open
                got = only_strings(branch)
                if got is None:
                    return None
                every |= got
            return every if len(every) <= MOST_STRINGS else None
        if op is C.MAX_REPEAT:
            least, most, inner = arg
            if most == 1:
                got = only_strings(inner)
                return None if got is None else got | ({""} if least == 0 else set())
            if least == most and least <= 8:
                got, out = only_strings(inner), {""}
                for _ in range(least):
                    if got is None or len(out) * len(got) > MOST_STRINGS:
                        return None
                    out = {a + b for a, b in product(out, got)}
                return out
        return None

    def only_strings(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            got = spell(op, arg) if op is not C.SUBPATTERN else only_strings(arg[-1])
            if got is None or len(out) * len(got) > MOST_STRINGS:
                return None
            out = {a + b for a, b in product(out, got)}
        return out

    close(walk(parser.parse(pattern)))
    return query


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for option in clause for t in option})


def postings(docs: DataFrame, trigrams: Sequence[str], key: str, text: str) -> DataFrame:
    """The inverted index over these trigrams: one row (trigram, key) per trigram and document."""
    low = F.lower(F.col(text))
    held = [F.when(F.col("__low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)]
    rows = docs.select(key, low.alias("__low"))
    return rows.select(key, F.explode(F.array_compact(F.array(*held))).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule], trigrams: Sequence[str], key: str) -> DataFrame:
    """(key, rules): bit j is set where the postings of rule j's query intersect in the document."""
    words = -(-len(trigrams) // 60)  # one long holds 60 trigrams
    bits = lambda w: F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, F.expr("shiftleft(1L, trigram % 60)")).otherwise(F.lit(0).cast("long")))
    found = index.groupBy(key).agg(*[bits(w).alias(f"w{w}") for w in range(words)])
    at = {t: i for i, t in enumerate(trigrams)}

    def holds(option: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(words):
            mask = sum(1 << (at[t] % 60) for t in option if at[t] // 60 == w)
            if mask:
                out = out & (F.col(f"w{w}").bitwiseAND(mask) == mask)
        return out

    mask = F.lit(0)
    for j, r in enumerate(rules):
        query = trigram_query(r.pattern)
        if query:
            ok = F.lit(True)
            for clause in query:
                any_ = F.lit(False)
                for option in clause:
                    any_ = any_ | holds(option)
                ok = ok & any_
            mask = mask + F.when(ok, F.lit(1 << j)).otherwise(F.lit(0))
    return found.select(key, mask.alias("rules")).filter("rules > 0")


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + ADDED) -> DataFrame:
    """(doc_id, spans): for every row of docs(doc_id, text) its spans by start, then rule, as structs of start, rule, kind, end."""
    # the two marks that cut the text can't be in it; one code point stands for another that no rule matches
    text = F.translate(F.coalesce("text", F.lit("")), "\x01\x02", "\x03\x03")
    rows = docs.select("doc_id", text.alias("t")).withColumn("row", F.monotonically_increasing_id())
    # the index knows a text by a hash, so that it need not see the rows in the same order; a collision adds candidates only
    rows = rows.withColumn("text_key", F.xxhash64("doc_id", "t"))
    trigrams = vocabulary(rules)
    found = candidates(postings(rows, trigrams, "text_key", "t"), rules, trigrams, "text_key") if trigrams else None
    if found is not None:
        rows = join_with_hot_keys(rows, found.withColumn("one", F.lit(1)), "text_key", "one", 1 << 40)
    asked = F.coalesce(F.col("rules"), F.lit(0)) if found is not None else F.lit(0)

    def pieces(j: int, r: Rule) -> Column:
        cut = F.split(F.regexp_replace("t", r.regex, "\x01$0\x02"), "[\x01\x02]", -1)
        fits = lambda x: F.char_length(F.regexp_extract(x, r.regex, r.group) if r.group else x) >= r.least
        out = F.transform(
            cut, lambda x, i: F.struct(F.lit(j).alias("rule"), i.alias("i"), F.char_length(x).alias("n"), F.when(i % 2 == 1, fits(x)).otherwise(F.lit(False)).alias("hit"))
        )
        exact = F.col("t").rlike(_gate(r))
        may = exact & (asked.bitwiseAND(1 << j) != 0) if trigram_query(r.pattern) else exact
        return F.when(may, out).otherwise(F.array().cast("array<struct<rule:int,i:int,n:int,hit:boolean>>"))

    every = F.flatten(F.array(*[pieces(j, r) for j, r in enumerate(rules)]))
    parts = rows.select("row", "doc_id", F.explode_outer(every).alias("p")).select("row", "doc_id", "p.*")
    before = W.partitionBy("row", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    span = F.struct("start", "rule", kind.alias("kind"), (F.col("start") + F.col("n")).alias("end"))
    return parts.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("hit"), span))).alias("spans")).drop("row")


def _gate(r: Rule) -> str:
    """A plainer test that every text with a kept match passes, so that most texts are not cut at all."""
    if r.group == 0 and r.least > 1 and (m := re.fullmatch(r"(.*\])\+", r.pattern)):
        fixed = re.sub(r"\[.*\]$", "", m[1])
        return f"{m[1]}{{{r.least - len(fixed)},}}"
    return r.regex


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of docs."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    count = lambda j: F.size(F.filter("spans", lambda s: s["rule"] == j)).cast("long")
    return found.select(
        "doc_id",
        *[count(j).alias(f"n_{r.kind}") for j, r in enumerate(BASE)],
        F.sha2(F.encode(spans_text(base), "UTF-8"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
