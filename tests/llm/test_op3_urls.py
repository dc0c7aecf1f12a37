from textloom.llm.op3_urls import RULES, judged_urls

SCHEMA = "page_id bigint, url string, html string, host string, rule string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], SCHEMA)
    return [tuple(r) for r in judged_urls(df, **more).orderBy("page_id").collect()]


def link(target):
    return f"<head><LINK href='{target}' rel=\"canonical\"></head>"


PAGES = [
    ("http://Blog.EXAMPLE.com/en/1?x#y", None),
    ("https://www.example.com/en/2", ""),
    ("https://a.net/fr/3", "<p>no link</p>"),
    ("https://xnet/fr/", ""),
    ("https://other.com", ""),
    ("http://q.org/alias", link("https://a.net/fr/3")),
    ("http://q.org/second?utm=1", link("/alias#top")),
    ("http://q.org/allowed-too", link("http://q.org/alias2")),
    ("http://z.com/page", link("http://q.org/alias2")),
    ("http://y.net/es/9", '<meta http-equiv="refresh" content="0; url=http://q.org/alias2">'),
    (None, link("http://a.net/es/1")),
    ("no scheme", None),
    ("http://q.org/Alias", ""),
]
EXPECTED = [
    (0, "blog.example.com", "/en/1", "example.com/en/", "block"),
    (1, "www.example.com", "/en/2", "www.example.com/en/", "allow"),
    (2, "a.net", "/fr/3", "net/fr/", "block"),
    (3, "xnet", "/fr/", None, "allow"),
    (4, "other.com", "", None, "allow"),
    (5, "q.org", "/alias", None, "block"),
    (6, "q.org", "/second", None, "block"),
    (7, "q.org", "/allowed-too", None, "allow"),
    (8, "z.com", "/page", "com/", "allow"),
    (9, "y.net", "/es/9", "net/es/", "block"),
    (10, "", "", None, "allow"),
    (11, "", "", None, "allow"),
    (12, "q.org", "/Alias", None, "allow"),
]


def test_rules_aliases_and_precedence(spark):
    assert run(spark, PAGES) == EXPECTED


def test_rules_as_a_table_give_the_same(spark):
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    assert run(spark, PAGES, rules=rules) == EXPECTED


def test_redirects(spark):
    redirects = spark.createDataFrame([("http://s.org/a", "http://s.org/b"), ("http://s.org/b", "http://b.net/es/x"), (None, "http://c.org/")], "source string, target string")
    got = run(spark, [("http://s.org/a", ""), ("http://c.org/", "")], redirects=redirects)
    assert [r[-1] for r in got] == ["block", "allow"]


def test_queries_are_pages_of_their_own(spark):
    rows = [("http://q.org/view?id=1", link("http://b.net/es/x?y&amp;z=1")), ("http://q.org/view?id=2", link("http://w.org/fine")), ("http://q.org/view", ""), ("http://q.org/view?id=1#part", "")]
    assert [r[-1] for r in run(spark, rows)] == ["block", "allow", "allow", "block"]


def test_every_link_counts_but_hidden_ones(spark):
    hidden = "<!-- " + link("http://b.net/es/1") + " --><script>x='" + link("http://b.net/es/1").replace("'", "") + "'</script>"
    rows = [("http://q.org/a", hidden), ("http://q.org/b", hidden + link("http://w.org/fine") + link("http://b.net/es/2")), ("http://q.org", link("https://b.net/fr/")), ("http://q.org/", "")]
    assert [r[-1] for r in run(spark, rows)] == ["allow", "block", "block", "block"]


def test_rules_for_one_place(spark):
    rules = [("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("block", "b.org", "/x"), ("allow", "b.org", "/x")]
    for given in (rules, rules[::-1], spark.createDataFrame(rules, "verdict string, host string, path string")):
        assert [r[-1] for r in run(spark, [("http://a.org/x1", ""), ("http://s.b.org/x2", "")], rules=given)] == ["allow", "allow"]


def test_a_very_long_page(spark):
    rows = [("http://q.org/long", "<p>text</p>" * 300_000 + link("http://b.net/es/1"))]
    assert [r[-1] for r in run(spark, rows)] == ["block"]


def test_against_sql_over_linked_pages(spark, tmp_path):
    import random

    duckdb = __import__("pytest").importorskip("duckdb")
    from textloom.llm.op3_urls import ORACLE, op3_url_filters

    rng = random.Random(12)
    hosts = ["a.net", "b.net", "www.example.com", "blog.example.com", "c.org", "d.org", "E.org"]
    url = lambda: f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/fr/', '/en/', '/p/'])}{rng.randrange(60)}{rng.choice(['', '?a=1', '#x', '?b=2#y'])}" if rng.random() < 0.95 else rng.choice(["", "none", "http://a.net", "http://c.org"])
    rows = []
    for i in range(300):
        html = "<p>text</p>"
        if rng.random() < 0.25:
            html = f'<link rel="canonical" href="{url()}">' + html
        if rng.random() < 0.1:
            html += f'<meta http-equiv="refresh" content="0; url={url()}">'
        rows.append((i, url() if rng.random() < 0.97 else None, html if rng.random() < 0.97 else None))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = sorted(connection.execute(ORACLE).fetchall())
    got = sorted(tuple(r) for r in op3_url_filters(spark, str(tmp_path)).collect())
    assert got == expected
    # links decide something here
    assert sum(r[3] is None and r[4] == "block" for r in got) > 5


def test_empty(spark):
    assert judged_urls(spark.createDataFrame([], SCHEMA)).count() == 0
