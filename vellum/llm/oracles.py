"""DuckDB SQL for the queries that SQL can express."""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
  CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
v AS (SELECT *, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before FROM w
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, cap / w < (total - cap_before) / (all_w - w_before) AS is_full FROM v),
y AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS cap_full, coalesce(sum(w) FILTER (is_full) OVER (), 0) AS w_full FROM x),
q AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, (total - cap_full) * w / nullif(all_w - w_full, 0)) END AS target FROM y),
r AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS sure FROM q),
r2 AS (SELECT *, target - sure * source_size AS room0 FROM r),
e AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
g AS (SELECT e.source, e.size, (room0 - coalesce(sum(CAST(size * n AS DOUBLE)) OVER (PARTITION BY e.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(CAST(size AS DOUBLE) * size * n) OVER (PARTITION BY e.source ORDER BY size ROWS UNBOUNDED PRECEDING) AS c FROM e JOIN r2 ON e.source IS NOT DISTINCT FROM r2.source),
h AS (SELECT source, max_by(c, size) AS c FROM g WHERE c >= 0 AND c * size <= 1 GROUP BY 1),
i AS (SELECT d.doc_id, d.size, d.u, r2.source, source_size, target, sure, room0, least(1.0::DOUBLE, h.c * d.size) AS p
  FROM d JOIN r2 ON d.source IS NOT DISTINCT FROM r2.source LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source),
a0 AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank, false AS t0 FROM i)"""

#: Passes of the check; further ones would take nothing from the supplied tables.
OP6_PASSES = 8
for _n in range(1, OP6_PASSES + 1):
    _ask = f"CASE WHEN NOT t{_n - 1} AND rank IS NOT NULL AND size <= room THEN size ELSE 0 END"
    OP6 += f""",
b{_n} AS (SELECT *, room0 - sum(CASE WHEN t{_n - 1} THEN size ELSE 0 END) OVER (PARTITION BY source) AS room FROM a{_n - 1}),
a{_n} AS (SELECT * EXCLUDE (room, t{_n - 1}), t{_n - 1} OR ({_ask} > 0 AND sum({_ask}) OVER (PARTITION BY source ORDER BY rank NULLS FIRST, doc_id NULLS FIRST, size
  ROWS UNBOUNDED PRECEDING) <= room) AS t{_n} FROM b{_n})"""
OP6 += f""",
y1 AS (SELECT *, room0 - sum(CASE WHEN t{OP6_PASSES} THEN size ELSE 0 END) OVER (PARTITION BY source) AS room FROM a{OP6_PASSES}),
y2 AS (SELECT *, NOT t{OP6_PASSES} AND rank IS NOT NULL AND size / 2.0::DOUBLE < room AS nearer FROM y1),
y3 AS (SELECT *, nearer AND row_number() OVER (PARTITION BY source ORDER BY nearer DESC, size, rank, doc_id NULLS FIRST) = 1 AS last FROM y2)
SELECT doc_id, size, source_size, target, CAST((sure + CASE WHEN t{OP6_PASSES} OR last THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM y3
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {AZ}) AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY 1),
m AS (SELECT k.*, coalesce(c.n >= 5 AND k.doc_id <> c.last_doc, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def op7(rules, share: str) -> str:
    cut = lambda k: (k.partition("/")[0], "/" + k.partition("/")[2] if "/" in k else "")
    values = ", ".join(f"('{v}', '{k}', '{h}', '{p}', 1)" for v, k, h, p in ((v, k, *cut(k)) for v, k in rules))
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {AZ}) AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, row_number() OVER () AS n FROM pages),
listed AS (SELECT host FROM (SELECT DISTINCT host FROM u WHERE host <> '') WHERE substr(md5(host), 1, {len(share)}) < '{share}'),
rules(verdict, key, h, p, tier) AS (VALUES {values} UNION ALL SELECT 'block', host, host, '', 2 FROM listed),
m AS (SELECT u.*, r.verdict, r.key, r.tier, row_number() OVER (PARTITION BY u.n ORDER BY r.tier, length(r.key) DESC, length(r.h) DESC) AS i
  FROM u LEFT JOIN rules r ON u.host <> '' AND (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, CASE WHEN tier = 1 THEN key END AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE i = 1
"""


def op4(rules, n_base: int) -> str:
    """Cut every text at each rule's matches; running sums of the pieces' lengths are the offsets."""
    parts = []
    for j, r in enumerate(rules):
        pattern = r.regex.replace("'", "''")
        group = f"length(regexp_extract(m, '{pattern}', {r.group})) >= {r.least}"
        parts.append(f"""
SELECT r, {j} AS rule, '{r.kind}' AS kind, CAST(b AS BIGINT) AS s, CAST(b + length(m) AS BIGINT) AS e FROM (
  SELECT r, pos, m, sum(length(seg) - CASE WHEN pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM (SELECT r, pos, seg, CASE WHEN pos > 0 THEN split_part(seg, chr(2), 1) END AS m FROM (
    SELECT r, unnest(segs) AS seg, unnest(range(len(segs))) AS pos FROM (
      SELECT r, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS segs FROM d)))) WHERE pos > 0 AND {group}""")
    union = "\nUNION ALL".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
m AS ({union}),
x AS (SELECT d.r, d.doc_id, m.* EXCLUDE (r), kind || ':' || s || ':' || e AS span FROM d LEFT JOIN m ON d.r = m.r)
SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, rule) FILTER (rule < {n_base}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rule), '') AS spans
FROM x GROUP BY r, doc_id
"""


def crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes by its definition: eight shifts a byte."""
    hex_digits = f"hex(encode({text}))"
    octets = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr({hex_digits}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    shifted = "xor(x >> 1, (x & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: {shifted})), 4294967295::BIGINT)"


def op11(buckets: int, percent: int, least_words: int, seed: int) -> str:
    """The table of a byte's eight shifts comes from the same definition; each distinct n-gram is hashed once."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "xor(x >> 1, (x & 1) * 3988292384)"
    tab = f"list_transform(range(256), lambda v: list_reduce(list_prepend(CAST(v AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: {step}))"
    grams = " UNION ALL ".join(
        f"SELECT r, array_to_string(ws[i:i + {k - 1}], ' ') AS f FROM (SELECT r, ws, unnest(range(1, len(ws) + 2 - {k})) AS i FROM @)" for k in (1, 2, 3)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
g AS (SELECT {words} AS ws, 0 AS r FROM benchmark),
fd AS ({grams.replace('@', 'd')}),
fg AS ({grams.replace('@', 'g')}),
tab AS MATERIALIZED (SELECT {tab} AS t),
u AS (SELECT f, hex(encode(f)) AS h, strlen(f) AS n FROM (SELECT f FROM fd UNION SELECT f FROM fg)),
o AS (SELECT f, list_transform(range(n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM u),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % {buckets} AS bucket FROM o, tab),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN c USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM fg JOIN c USING (f) GROUP BY 1),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + {buckets}) / ((s + 1.0::DOUBLE) * (all_t + {buckets})))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), a),
w AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM fd JOIN c USING (f) JOIN gain USING (bucket) GROUP BY 1),
x AS (SELECT d.r, doc_id, len(ws) >= {least_words} AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS i, count(*) FILTER (fit) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND i <= {percent} * n // 100 THEN i END AS rank, len_ws AS n_words
FROM z JOIN (SELECT r, len(ws) AS len_ws FROM d) USING (r)
"""


def op12() -> str:
    """Every level of a tree from the one below; siblings by coordinate; digests folded along them."""
    coded = lambda n: ", ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n, "text"))

    def grown(name: str, tree: str, at: str) -> str:
        return f"""{name} AS (SELECT 0 AS level, {tree} AS tree, CAST(i AS BIGINT) AS i, leaf AS d, CAST(n AS BIGINT) AS n FROM {at}
  UNION ALL SELECT level + 1, tree, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY level, tree, i // 2)"""

    def sides(name: str, of: str, tree: str) -> str:
        return f"""(SELECT l.r, n.level, s.d, CASE WHEN s.d IS NULL THEN '' WHEN n.i % 2 = 1 THEN 'L' ELSE 'R' END AS side FROM {of} l
  JOIN {name} n ON n.tree IS NOT DISTINCT FROM {tree} AND n.n > 1 AND n.i = l.i >> n.level
  LEFT JOIN {name} s ON s.tree IS NOT DISTINCT FROM n.tree AND s.level = n.level AND s.i = xor(n.i, 1))"""

    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, sha256(concat({coded("n_chars")})) AS leaf,
  CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256(concat({coded("n_chars + 1")})) END AS bad FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
{grown("t", "lang", "l")},
q AS (SELECT row_number() OVER (ORDER BY tree NULLS FIRST) AS r, tree AS lang, d AS leaf, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{grown("u", "0", "q")},
ls AS {sides("t", "l", "l.lang")},
us AS {sides("u", "q", "0")},
steps AS (SELECT * FROM ls UNION ALL SELECT l.r, 1000 + us.level, us.d, us.side FROM l JOIN q ON q.lang IS NOT DISTINCT FROM l.lang JOIN us ON us.r = q.r),
p AS (SELECT r, string_agg(d, '' ORDER BY level) AS joined, list(side || coalesce(d, '') ORDER BY level) AS path FROM steps GROUP BY 1),
o AS (SELECT l.doc_id, l.leaf, q.leaf AS subroot, (SELECT d FROM u WHERE n = 1) AS root, sha256(coalesce(joined, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(bad, l.leaf), coalesce(path, []::VARCHAR[])), lambda d, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || d) ELSE sha256(d || s[2:]) END) AS folded_root
  FROM l JOIN q ON q.lang IS NOT DISTINCT FROM l.lang LEFT JOIN p ON p.r = l.r)
SELECT *, folded_root = root AS verified FROM o
"""


OP10 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS f FROM d),
t AS (SELECT md5(array_to_string(list_sort(f), '|')) AS k, min(r) AS r, any_value(f) AS f FROM s WHERE len(f) > 0 GROUP BY 1),
e AS (SELECT r, len(f) AS n, unnest(f) AS x FROM t),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
m AS (SELECT s.r, t.r AS same, s.doc_id FROM s JOIN t ON md5(array_to_string(list_sort(s.f), '|')) = t.k AND len(s.f) > 0),
w AS (SELECT r AS a, r AS b FROM t UNION SELECT w.a, g.b FROM w JOIN g ON g.a = w.b),
c AS (SELECT w.a, min(m.doc_id) AS component_id FROM w JOIN m ON m.same = w.b GROUP BY 1)
SELECT s.doc_id, CAST(len(s.f) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN m ON m.r = s.r LEFT JOIN c ON c.a = m.same
"""

OP3 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT r, vec_id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_inner_product(x, x) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93::DOUBLE),
n AS (SELECT a, CAST(count(*) AS BIGINT) AS n_links FROM l GROUP BY 1),
w AS (SELECT r AS a, r AS b FROM v UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b),
c AS (SELECT w.a, min(v.vec_id) AS component_id FROM w JOIN v ON v.r = w.b GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r
"""
