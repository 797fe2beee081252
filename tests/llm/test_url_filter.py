import hashlib

from pyspark.sql import functions as F

from vellum.llm import url_filter as uf


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def fits(key, host, path):
    h, p = uf.split_key(key)
    return host != "" and (host == h or host.endswith("." + h)) and path.startswith(p)


LISTED = ("tionsh.example.net", "blog.tionble.example.com/en/9")
URLS = [
    None, "", "nonsense", "http://EXAMPLE.org/es/x", "http://a.example.org/en/17?q", "http://example.org", "http://example.org/", "https://x.com/fr/1#a", "https://x.com/de/1",
    "http://notexample.org/es/", "http://org/", "http://tionsh.example.net?x=1", "http://a.tionsh.example.net/", "http://blog.tionble.example.com/en/99", "http://é.org/a\nb", "http://" + "a." * 500 + "org/x",
]


def test_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS extra")
    got = {r["page_id"]: r for r in uf.judge(df, listed=LISTED).collect()}
    for i, u in rows:
        host, path = host_path(u)
        rules = sorted(((len(k), k, v) for v, k in uf.RULES if fits(k, host, path)), reverse=True)
        listed = any(fits(k, host, path) for k in LISTED)
        want = (host, path, rules[0][1] if rules else None, rules[0][2] if rules else "block" if listed else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want
    assert uf.judge(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = [f"k{i}" for i in range(0, 20000, 40)]
    cascade = uf.Cascade.build(listed, universe, 20000)
    assert len(cascade.levels) > 1
    assert {r["key"] for r in universe.filter(cascade.holds(F.col("key"))).collect()} == set(listed)
    assert universe.filter(uf.Cascade.build([], universe, 1).holds(F.col("key"))).count() == 0


def test_a_list_in_parts(spark):
    """A corpus of 120,000 hosts, of which the list takes about half, in four parts; verdicts by anti join."""
    n = 120_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://H"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".net/de/x").otherwise(".net?q")).alias("url"))
    listed = uf.listed_hosts(pages, below="8")
    most = listed.count()
    assert 0.45 * n < most < 0.55 * n
    got = uf.judge(pages, listed=listed, most_keys=most // 4 + 1)
    blocked = got.filter("verdict = 'block'").select(F.col("host").alias("key"), "listed_as")
    assert blocked.count() == most and blocked.join(listed, "key", "left_anti").count() == 0 and blocked.filter("key <> listed_as").count() == 0
    assert got.count() == n


def test_parts_keep_the_longest_key(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    keys = [*LISTED, "net", "example.net", "com/fr", "org/es", "a.example.org/en", "x.com"]
    whole = {r["page_id"]: tuple(r) for r in uf.judge(df, listed=keys).collect()}
    assert {r["page_id"]: tuple(r) for r in uf.judge(df, listed=keys, most_keys=2).collect()} == whole
    for i, u in rows:
        host, path = host_path(u)
        want = max(((len(k), len(uf.split_key(k)[0]), k) for k in keys if fits(k, host, path)), default=(0, 0, None))[2]
        assert whole[i][-2] == want
    assert {r["verdict"] for r in uf.judge(df, listed=[]).filter("rule IS NULL").collect()} == {"allow"}


def test_stand_in_list(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/a") for i in range(400)] + [(400, None), (401, "x")], "page_id long, url string")
    hosts = {f"h{i}.org" for i in range(400)}
    assert {r["key"] for r in uf.listed_hosts(df).collect()} == {h for h in hosts if hashlib.md5(h.encode()).hexdigest() < "1"}
    assert uf.listed_hosts(df.limit(0)).count() == 0
