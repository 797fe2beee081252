"""Keyword scan and evidence extraction: one pass over the pages for all questions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.matching import scan, strip

HITS = pa.list_(pa.struct([("ask", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("context", pa.string())]))


@dataclass(frozen=True)
class Question:
    id: str
    text: str = ""
    keywords: Sequence[str] = ()
    hints: Sequence[str] = ()


# Letters that match another one in any case, beside their lower-case form.
SAME = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u00b5": "\u03bc", "\u03c2": "\u03c3"}


def fold(text: str) -> str:
    """The text in lower case, every character still one."""
    low = text.translate(FOLDED).lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text.translate(FOLDED))


FOLDED = str.maketrans(SAME)


def keyword_automaton(keywords: Sequence[str]) -> ahocorasick.Automaton:
    """Finds all keywords in one pass over a folded text; its values are (length, numbers of the keywords)."""
    numbers: dict[str, list[int]] = {}
    for n, k in enumerate(keywords):
        numbers.setdefault(fold(k), []).append(n)
    automaton = ahocorasick.Automaton()
    for word, at in numbers.items():
        automaton.add_word(word, (len(word), at))
    automaton.make_automaton()
    return automaton


def first_hits(automaton: ahocorasick.Automaton, text: str, most: int, around: int) -> Iterator[tuple[int, int, int, str]]:
    """(keyword's number, start, end, context) of the first hits of each keyword; hits of one keyword don't overlap."""
    seen: dict[int, tuple[int, int]] = {}
    for last, (length, numbers) in automaton.iter(fold(text)):
        s, e = last + 1 - length, last + 1
        n, until = seen.get(numbers[0], (0, 0))
        if n < most and s >= until:
            seen[numbers[0]] = (n + 1, e)
            a, b = max(0, s - around), min(len(text), e + around)
            context = "…" * (a > 0) + text[a:b].replace("\n", " ").strip() + "…" * (b < len(text))
            for number in numbers:
                yield number, s, e, context


def find_literal(pages: DataFrame, keys: Sequence[str], sought: str) -> DataFrame:
    """(keys, s, e) of every place where the text stands in pages(keys..., text), in any case; an empty one stands nowhere."""
    if not sought:
        return pages.select(*keys, F.lit(0).alias("s"), F.lit(0).alias("e")).limit(0)

    def places(text: str) -> Iterator[tuple[int, int]]:
        low, what = fold(text), fold(sought)
        at = low.find(what)
        while at >= 0:
            yield at, at + len(what)
            at = low.find(what, at + len(what))

    return pages.select(*keys, F.explode(scan(F.col("text"), places, {"s": "int", "e": "int"})).alias("m")).select(*keys, "m.*")


def keyword_scan(pages: DataFrame, questions: Sequence[Question], per_keyword: int = 3, enough: int = 10, around: int = 120) -> DataFrame:
    """(question_id, question_text, matched_keywords, match_count, matches) of pages(file_seq, source_file, page_num, text).

    Keywords match anywhere in a word, in any case. Each gives its first hits by file, page and place; once enough hits
    are gathered no further keyword is tried, so the count may pass the number listed. A page is read once for all
    keywords; what leaves it are a keyword's first hits with their surroundings. Blank pages and empty keywords give
    none; a keyword that several questions share counts for each."""
    asks = [(q.id, q.text, i, k) for q in questions for i, k in enumerate(q.keywords) if k]
    if not asks:
        none = "question_id string, question_text string, matched_keywords array<string>, match_count long, matches array<struct<kw:int,n:int,keyword:string,source_file:string,page_num:int,context:string>>"
        return pages.sparkSession.createDataFrame([], none)
    words = [k for *_, k in asks]

    def search(values: pa.Array) -> pa.Array:
        automaton = keyword_automaton(words)
        return pa.array([list(first_hits(automaton, v.as_py(), per_keyword, around)) if v.is_valid else [] for v in values], HITS)

    hits = F.arrow_udf(search, "array<struct<ask:int,s:int,e:int,context:string>>")(F.col("text"))
    rows = pages.select("file_seq", "source_file", "page_num", F.explode(hits).alias("h")).select("file_seq", "source_file", "page_num", "h.*")
    first = W.partitionBy("ask").orderBy("file_seq", "page_num", "s")
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_keyword)
    known = pages.sparkSession.createDataFrame([(n, *a) for n, a in enumerate(asks)], "ask int, question_id string, question_text string, kw int, keyword string")
    rows = rows.join(F.broadcast(known), "ask")  # the questions asked, held by the driver already
    rows = rows.select("question_id", "question_text", "kw", "keyword", "n", "source_file", "page_num", "context")
    # at most per_keyword rows a keyword from here on
    per = rows.groupBy("question_id", "kw").agg(F.count("*").alias("hits"))
    before = F.coalesce(F.sum("hits").over(W.partitionBy("question_id").orderBy("kw").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before).filter(F.col("before") < enough)
    kept = rows.join(per.select("question_id", "kw"), ["question_id", "kw"])
    match = F.struct("kw", "n", "keyword", "source_file", "page_num", "context")
    out = kept.groupBy("question_id", "question_text").agg(
        F.array_sort(F.collect_set("keyword")).alias("matched_keywords"), F.count("*").alias("match_count"), F.slice(F.array_sort(F.collect_list(match)), 1, enough).alias("matches")
    )
    return out


def evidence(pages: DataFrame, questions: Sequence[Question], top: int = 5, blank: str = r"\n\s*\n") -> DataFrame:
    """(question_id, place, confidence, source_file, page_num, text): the best paragraphs for each question.

    A paragraph scores the share of keywords in it plus 0.3 for each section hint, at most 1; ties keep document order."""
    paragraphs = pages.select("file_seq", "source_file", "page_num", F.posexplode(F.split(F.coalesce("text", F.lit("")), "(?U)" + blank)).alias("para", "p"))
    paragraphs = paragraphs.withColumn("p", strip(F.col("p"))).filter(F.char_length("p") >= 10).withColumn("low", F.lower("p"))
    scores = []
    for q in questions:
        score = F.lit(0.0)
        if q.keywords:
            score = sum((F.contains(F.col("low"), F.lit(k.lower())).cast("int") for k in q.keywords), F.lit(0)) / F.lit(float(len(q.keywords)))
        for h in q.hints:
            score = score + F.when(F.contains(F.col("low"), F.lit(h.lower())), F.lit(0.3)).otherwise(F.lit(0.0))
        scores.append(F.when(score > 0, F.struct(F.lit(q.id).alias("question_id"), F.least(F.lit(1.0), score).alias("confidence"))))
    rows = paragraphs.withColumn("q", F.explode(F.array_compact(F.array(*scores)))).select("*", "q.*")
    best = W.partitionBy("question_id").orderBy(F.col("confidence").desc(), "file_seq", "page_num", "para")
    rows = rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    short = F.when(F.char_length("p") > 500, F.concat(F.substring("p", 1, 500), F.lit("..."))).otherwise(F.col("p"))
    return rows.select("question_id", "place", "confidence", "source_file", "page_num", short.alias("text"))
