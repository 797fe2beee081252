"""Queries of search and places: keywords of a whole catalogue, matches to spans, rectangles; and of the templates asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators import places, search, templates
from vellum.plans.casework import query

#: A question's keywords are pairs of neighbouring words at these places of its text.
PAIRS = (0, 3, 6, 9, 12)
_pair = "ws[1 + i] || ' ' || ws[2 + i]"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> list[search.Question]:
    """The benchmark's texts as questions: a catalogue, of which a process holds all keywords."""
    rows = _read(spark, sf_dir, "benchmark").orderBy("item_id").collect()
    words = [(str(r["item_id"]), r["text"] or "", (r["text"] or "").split(" ")) for r in rows]
    return [search.Question(i, text, tuple(" ".join(ws[p : p + 2]) for p in PAIRS if len(ws) >= p + 2)) for i, text, ws in words]


def scan_check(questions: str) -> str:
    """Check SQL of a keyword scan: questions gives (item, i, kw), a keyword's number in its question and the keyword."""
    return f"""WITH k AS ({questions}),
p AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
c AS (SELECT item, i, kw, doc_id, text, string_split(low, lower(kw)) AS parts FROM k JOIN p ON contains(low, lower(kw))),
h AS (SELECT * EXCLUDE (parts), CAST(list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * length(kw) AS BIGINT) AS s, row_number() OVER (PARTITION BY item, i ORDER BY doc_id, j) AS n
  FROM (SELECT *, unnest(range(1, least(len(parts), 4))) AS j FROM c) y),
f AS (SELECT *, s + length(kw) AS e FROM h WHERE n <= 3),
b AS (SELECT item, i, coalesce(sum(count(*)) OVER (PARTITION BY item ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM f GROUP BY 1, 2),
m AS (SELECT f.*, 'doc' || doc_id AS source_file, CASE WHEN s > 120 THEN '…' ELSE '' END || trim(replace(substr(text, greatest(s - 120, 0) + 1, least(e + 120, length(text)) - greatest(s - 120, 0)), chr(10), ' '), ' ' || chr(9) || chr(13))
  || CASE WHEN e + 120 < length(text) THEN '…' ELSE '' END AS context, row_number() OVER (PARTITION BY item ORDER BY i, n) AS place
  FROM f JOIN b USING (item, i) WHERE had < 10)
SELECT item AS question_id, string_agg(DISTINCT kw, ',' ORDER BY kw) AS keywords, CAST(count(*) AS BIGINT) AS match_count, @ AS matches FROM m GROUP BY item"""


@query("txt01_catalogue_scan", scan_check(f"""SELECT CAST(item_id AS VARCHAR) AS item, i, {_pair} AS kw FROM (SELECT item_id, ws, unnest([{", ".join(map(str, PAIRS))}]) AS i FROM (
  SELECT item_id, string_split(coalesce(text, ''), ' ') AS ws FROM benchmark) q) x WHERE len(ws) >= i + 2""").replace("@ AS", "string_agg(kw || '@' || source_file || ':' || context, '|' ORDER BY i, n) FILTER (place <= 10) AS", 1))
def txt01_catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions' keywords over all documents, each read once."""
    docs = _read(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").alias("file_seq"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_file"), F.lit(0).alias("page_num"), "text")
    found = search.keyword_scan(pages, asked(spark, sf_dir))
    shown = F.transform("matches", lambda m: F.concat(m["keyword"], F.lit("@"), m["source_file"], F.lit(":"), m["context"]))
    return found.select("question_id", F.array_join("matched_keywords", ",").alias("keywords"), "match_count", F.array_join(shown, "|").alias("matches"))


# ---- places ----------------------------------------------------------------------------------------------------------

LINES = """l0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) x),
l AS (SELECT doc_id, line_no, length(line) AS n, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM l0)"""
WIDTH, HEIGHT = 5.0, 14.0


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as spans: every character has a width, every line a height."""
    docs = _read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.char_length)).alias("line_no", "n"))
    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("s", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    box = [F.lit(0.0).alias("x0"), (F.col("line_no") * HEIGHT).alias("y0"), (F.col("n") * WIDTH).alias("x1"), ((F.col("line_no") + 1) * HEIGHT).alias("y1")]
    return lines.select("doc_id", "s", (F.col("s") + F.col("n")).alias("e"), *box, F.lit(0).alias("block_no"), "line_no")


SOUGHT = "tion"


@query("txt03_find_rectangles", f"""WITH {LINES}, c AS (SELECT doc_id, line_no, string_split(lower(line), '{SOUGHT}') AS parts FROM l),
h AS (SELECT doc_id, line_no, CAST(list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * {len(SOUGHT)} AS BIGINT) AS at FROM (SELECT *, unnest(range(1, len(parts))) AS j FROM c) x)
SELECT h.doc_id, CAST(h.line_no AS BIGINT) AS line_no, l.s + h.at AS s, h.at * {WIDTH} AS x0, h.line_no * {HEIGHT} AS y0, (h.at + {len(SOUGHT)}) * {WIDTH} AS x1, (h.line_no + 1) * {HEIGHT} AS y1
FROM h JOIN l USING (doc_id, line_no)""")
def txt03_find_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for every place where a literal stands, in any case, in any document."""
    hits = search.find_literal(_read(spark, sf_dir, "documents"), ["doc_id"], SOUGHT)
    found = places.rectangles(hits, laid_out(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("s").cast("long").alias("s"), "x0", "y0", "x1", "y1")


@query("jn01_match_boxes", f"""WITH {LINES}, h AS (SELECT doc_id, s, s + n + 4 AS e FROM l WHERE line_no % 5 = 0)
SELECT h.doc_id, h.s, h.e, CASE WHEN count(l.s) > 0 THEN 0.0 ELSE 0.0 END AS x0, coalesce(min(l.line_no * {HEIGHT}), 0.0) AS y0, coalesce(max(l.n * {WIDTH}), 0.0) AS x1, coalesce(max((l.line_no + 1) * {HEIGHT}), 0.0) AS y1
FROM h LEFT JOIN l ON l.doc_id = h.doc_id AND l.s < h.e AND l.s + l.n > h.s GROUP BY 1, 2, 3""")
def jn01_match_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of matches that begin with every fifth line and end a few characters into the next ones."""
    spans = laid_out(spark, sf_dir)
    hits = spans.filter("line_no % 5 = 0").select("doc_id", "s", (F.col("e") + 4).alias("e"))
    return places.boxes(hits, spans, ["doc_id"])


# ---- templates -------------------------------------------------------------------------------------------------------

GROUP = 8  # questions of a template


def benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions, some a template; their order runs backwards, every fifth has none."""
    rows = _read(spark, sf_dir, "benchmark").withColumn("t", F.floor(F.col("item_id") / GROUP))
    none = F.array().cast("array<string>")
    order = F.when(F.col("item_id") % 5 != 0, (GROUP - F.col("item_id") % GROUP).cast("int"))
    q = F.struct(F.col("item_id").cast("string").alias("id"), "text", F.lit("free_text").alias("question_type"), none.alias("keywords"), none.alias("section_hints"), order.alias("order"))
    made = rows.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("item_id", q.alias("q")))).alias("qs"))  # GROUP questions at most
    name = F.col("t").cast("string")
    return made.select(F.concat(F.lit("t"), name).alias("id"), name.alias("name"), F.lit("c").alias("category"), F.lit("").alias("description"), F.lit(True).alias("is_builtin"), F.transform("qs", lambda x: x["q"]).alias("questions"))


@query("src24_template_catalogue", f"""WITH q AS (SELECT item_id // {GROUP} AS t, item_id, CASE WHEN item_id % 5 <> 0 THEN {GROUP} - item_id % {GROUP} ELSE 0 END AS o FROM benchmark),
a AS (SELECT 't' || t AS id, t, CAST(count(*) AS BIGINT) AS n_questions, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY o, item_id) AS questions FROM q GROUP BY t)
SELECT id, CAST(t AS VARCHAR) AS name, TRUE AS is_builtin, n_questions, questions FROM a
UNION ALL SELECT 'x' || id, CASE WHEN t % 2 = 0 THEN 'changed' ELSE CAST(t AS VARCHAR) END, FALSE, n_questions, questions FROM a WHERE t % 3 <> 0""")
def src24_template_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in templates, and copies of them that are saved, renamed, deleted; a copy under a built-in id is hidden."""
    builtin = benchmark_templates(spark, sf_dir)
    copies = builtin.withColumn("id", F.concat(F.lit("x"), "id"))
    custom = templates.save(templates.save(copies.limit(0), copies), builtin)
    custom = templates.update(custom, copies.filter("cast(name as int) % 2 = 0").select("id", F.lit("changed").alias("name")))
    custom = templates.delete(custom, copies.filter("cast(name as int) % 3 = 0").select("id"))
    every = templates.catalogue(builtin, custom)
    return every.select("id", "name", "is_builtin", "n_questions", F.array_join(F.transform("questions", lambda q: q["id"]), ",").alias("questions"))


@query("wf15_custom_templates", "SELECT p_partkey AS id, CASE WHEN p_partkey = 7 THEN 'renamed' ELSE p_name END AS name FROM part WHERE p_partkey <> 9")
def wf15_custom_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a custom template; one is renamed, one deleted."""
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    one = lambda i: parts.filter(F.col("id") == i).select("id")
    kept = templates.delete(templates.update(parts, one("7").withColumn("name", F.lit("renamed"))), one("9"))
    return kept.select(F.col("id").cast("long").alias("id"), "name")
