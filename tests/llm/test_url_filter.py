import random

import duckdb
import pytest
from pyspark.sql import functions as F

from hourlens.llm import url_filter as urls
from hourlens.llm.queries import RULES, URL_SQL

SCHEMA = "page_id long, url string, html string, host int, verdict string"


def canonical(href):
    return f'<html><LINK data-x=1 rel="canonical" href="{href}"><body>x</body></html>'


def refresh(to):
    return f"<meta http-equiv='Refresh' content='0; URL={to}'>"


def pages(spark, rows):
    return spark.createDataFrame([(i, url, html, 1, "x") for i, (url, html) in enumerate(rows)], SCHEMA)


def verdicts(spark, rows, **more):
    found = urls.judge(pages(spark, rows), RULES, **more).collect()
    return [r.verdict for r in sorted(found, key=lambda r: r.page_id)]


def test_places(spark):
    rows = ["https://WWW.Ex.com/A/b?q#f", "http://h", "h://a?x", "h://a#x/", None, "no scheme/x", "", "://x/y", "h://É.com/é://z"]
    frame = spark.createDataFrame([(u,) for u in rows], "url string")
    found = frame.select(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).collect()
    assert list(map(tuple, found)) == [("www.ex.com", "/A/b"), ("h", ""), ("a", ""), ("a", ""), ("", ""), ("", ""), ("", ""),
                                       ("x", "/y"), ("É.com", "/é://z")]


def test_longest_rule(spark):
    rows = ["http://example.com/en/1", "http://www.example.com/en/1", "http://m.www.example.com/en/", "http://a.example.com/en/",
            "http://a.example.com/de/", "http://example.com", "http://anet/es/", "http://x.net/es/1", "http://x.net/es", None]
    found = urls.judge(pages(spark, [(u, None) for u in rows]), RULES).orderBy("page_id").collect()
    assert [r.rule for r in found] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "example.com/en/", "com/",
                                       None, None, "net/es/", None, None]
    assert [r.verdict for r in found] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow"]


def test_references_are_resolved(spark):
    base = "http://h.org/a/b.html?q=1"
    want = {"https://x.y/z": "https://x.y/z", "//x.y/z": "http://x.y/z", "/z": "http://h.org/z", "z": "http://h.org/a/z",
            "?p=2": "http://h.org/a/b.html?p=2"}
    frame = spark.createDataFrame([(r, base) for r in want], "r string, u string")
    assert {r[0]: r[1] for r in frame.select("r", urls.resolved(F.col("r"), F.col("u"))).collect()} == want
    bare = spark.createDataFrame([("z", "http://h.org")], "r string, u string")
    assert bare.select(urls.resolved(F.col("r"), F.col("u"))).first()[0] == "http://h.org/z"


def test_decisions_reach_aliases(spark):
    rows = [("http://a.org/1", canonical("http://x.net/es/1")),              # alias of a blocked URL that is no page
            ("http://b.org/1", refresh("http://a.org/1#part")),              # over one more step and a fragment
            ("http://c.org/1", canonical("/2")), ("http://c.org/2", None),   # nobody decides
            ("http://d.org/1", canonical("http://x.net/fr/1")),              # blocked and allowed aliases: allowed
            ("http://e.com/1", canonical("http://d.org/1")),
            ("http://x.net/fr/2", canonical("http://e.com/1")),              # its own rule blocks it all the same
            ("http://f.org/1", None), ("http://f.org/1#top", refresh("http://example.com/en/?a=1&amp;b=2"))]
    assert verdicts(spark, rows) == ["block", "block", "allow", "allow", "allow", "allow", "block", "block", "block"]
    assert verdicts(spark, rows, default="block")[2:4] == ["block", "block"]


def test_redirect_table(spark):
    redirects = spark.createDataFrame([("http://g.org/old", "http://x.net/es/"), (None, "http://g.org/2"), ("http://g.org/2", None)],
                                      "from_url string, to_url string")
    assert verdicts(spark, [("http://g.org/old", ""), ("http://g.org/2", "")], redirects=redirects) == ["block", "allow"]


def made(seed, n=150):
    """Random pages of few hosts, half of which point at another one."""
    rng = random.Random(seed)
    hosts = ["a.org", "b.org", "x.net", "www.example.com", "m.example.com", "c.org"]
    url = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'de'])}/{rng.randint(0, 40)}{rng.choice(['', '', '#t', '?p=1'])}"
    links = [None, lambda: canonical(url()), lambda: refresh(url()), lambda: canonical(f"/en/{rng.randint(0, 40)}"),
             lambda: canonical("../x") + refresh("//b.org/en/1")]
    return [(url(), link and link()) for link in rng.choices(links, [5, 2, 1, 1, 0.2], k=n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_equal_brute_force_and_sql(spark, seed):
    rows = [*made(seed), (None, canonical("http://x.net/es/")), ("nothing", canonical("/x")), ("", "")]
    frame = pages(spark, rows)
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, RULES).collect()}
    pages_table = frame.toPandas()
    pages_table["url"] = [u for u, _ in rows]
    pages_table["html"] = [h for _, h in rows]
    sql = duckdb.connect()
    sql.register("pages", sql.from_df(pages_table))
    assert found == set(sql.execute(URL_SQL).fetchall())
    assert {v for *_, rule, v in found if rule is None} == {"allow", "block"}


def test_equal_lengths_prefer_the_longer_host(spark):
    rules = urls.rule_table(spark, [("block", "b.com/xyz"), ("allow", "aaaa.b.com"), ("block", "b.com")])
    found = urls.fitting(spark.createDataFrame([("aaaa.b.com", "/xyz")], "host string, path string"), rules).first()
    assert found.rule == "aaaa.b.com"


def test_odd_tables(spark):
    row = ("http://x.net/es/1", canonical("http://a.org/" + "y" * 50_000))
    assert verdicts(spark, [row, row, (None, None)]) == ["block", "block", "allow"]
    assert urls.judge(pages(spark, []), RULES).collect() == []
