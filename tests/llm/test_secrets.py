import re

from vellum.llm import secret_scan as ss


def brute(text, rules=ss.BASE + ss.ADDED):
    out = []
    for j, r in enumerate(rules):
        for m in re.finditer(r.regex, text):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), j, r.kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


TEXTS = [
    None, "", "token=token : abcdefg", "PASSWORD: 'hunter22' api_key=\"abc123def\" apikey = xyz", "é😀 secret=abcdef, secret=abc", "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
    "deadbeef" * 3 + " " + "f" * 23 + "\n" + "0" * 24, "a\x01token=abcdef\x02b", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " xoxb-1234567890-ab",
    "eyJabcdefgh.eyJabcdefgh.sig token", "x" * 50000 + " secret: " + "q" * 50, "token=abcdef " * 300, "AKIAAKIA" + "C" * 14,
]


def test_against_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "token=abcdef"), (3, "again token=abcdef"), (3, "again token=abcdef")]
    got = sorted((str(r["doc_id"]), r["spans"]) for r in ss.report(docs_of(rows)).collect())
    assert got == sorted((str(i), brute(t or "")) for i, t in rows)
    assert ss.report(docs_of([(1, "x")]).limit(0)).count() == 0


def test_queries_are_necessary():
    """Whatever a rule matches holds the trigrams that its query asks for."""
    for r in ss.BASE + ss.ADDED:
        q = ss.trigram_query(r.pattern)
        for t in TEXTS:
            for m in re.finditer(r.regex, t or ""):
                low = m.group().lower()
                assert all(any(all(g in low for g in option) for option in clause) for clause in q), (r.kind, m.group())
    assert ss.trigram_query("[0-9a-f]+") == [] and ss.trigram_query("abc|x?") == []
    assert ss.trigram_query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
