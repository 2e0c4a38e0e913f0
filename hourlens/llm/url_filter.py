"""Allow and block rules on URLs, carried along redirects and canonical links to the aliases of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlens.llm.components import components
from hourlens.llm.shared import written

#: (verdict, host and path): an allow rule and a block rule may not be the same text.
Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def resource(url: Column) -> Column:
    """A URL without its fragment: what a server is asked for."""
    return F.regexp_extract(url, "(?s)^([^#]*)", 1)


_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\s\"'>]+)"
_TO = r"(?is)\burl\s*=\s*[\"']?\s*([^\s\"'>]+)"


def targets(html: Column) -> Column:
    """References of a page's canonical links and immediate or delayed refreshes, as they are written."""
    links = F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1))
    turns = F.transform(F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, _TO, 1))
    found = F.transform(F.concat(links, turns), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: t != "")


def resolved(reference: Column, url: Column) -> Column:
    """A reference as a whole URL: whole already, from ``//``, from ``/``, or from the folder of ``url``."""
    root = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, "(?s)^.*?://[^/?#]*(/[^?#]*/|/)", 1)
    return F.when(reference.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), reference).when(
        reference.startswith("//"), F.concat(F.regexp_extract(url, "(?s)^(.*?:)//", 1), reference)).when(
        reference.startswith("/"), F.concat(root, reference)).when(
        reference.startswith("?"), F.concat(root, F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), reference)).otherwise(
        F.concat(root, F.when(folder == "", "/").otherwise(folder), reference))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """rule_host, rule_path, verdict, rule of a list of rules such as ``("block", "example.com/en/")``."""
    rows = [(*text.partition("/")[::2], verdict, text) for verdict, text in rules]
    return spark.createDataFrame([(host, path if text == host else f"/{path}", verdict, text)
                                  for host, path, verdict, text in rows],
                                 "rule_host string, rule_path string, verdict string, rule string")


def fitting(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict: the longest of ``rules`` that fits each distinct place (host, path); others are left out.

    A rule's host is compared by equality with every domain a host lies in, so
    no place meets rules of other hosts. Of rules of one length the one with
    the longer host wins, then an allow rule, then the smaller text.
    """
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.withColumn("rule_host", F.explode(domains)).join(rules, "rule_host").where(
        F.col("path").startswith(F.col("rule_path")))
    first = F.struct(-F.length("rule"), -F.length("rule_host"), F.col("verdict") != "allow", "rule", "verdict")
    return met.groupBy("host", "path").agg(F.min(first).alias("first")).select(
        "host", "path", "first.rule", "first.verdict")


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None,
          default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row of ``pages`` (page_id, url, html).

    The longest rule that fits a URL decides on it (:func:`fitting`). A URL
    that no rule fits is judged with its aliases, the URLs that canonical
    links and refreshes of pages, and rows of ``redirects`` (from_url, to_url),
    connect with it in either direction, whether they are pages or not: allowed
    if a rule allows one of them, else blocked if a rule blocks one of them,
    else ``default``. URLs that differ in their fragment only are one resource.

    Components come from large-star and small-star steps on distributed edges;
    only URLs that stand in an edge take part. References are resolved against
    their page's URL; those of pages whose URL holds no ``://`` are left out
    unless they are whole. Null URLs and those without ``://`` have an empty
    host and path, no rule and the default; null html has no links; repeated
    rows give repeated results; other columns are ignored; an empty table gives
    no rows. ``rules`` as a table (rule_host, rule_path, verdict, rule) may be
    of any size: it is joined, and broadcast only if Spark knows it to be small.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    url = F.col("url")
    seen = written(pages.select("page_id", "url", "html").select(
        "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), resource(url).alias("node"),
        F.transform(targets(F.col("html")), lambda t: resource(resolved(t, url))).alias("to")), "urls")
    ways = seen.select(F.col("node").alias("x"), F.explode("to").alias("y"))
    if redirects is not None:
        ways = ways.union(redirects.select(resource(F.col("from_url")), resource(F.col("to_url"))))
    whole = [F.col(c).contains("://") for c in "xy"]
    ways = written(ways.where(whole[0] & whole[1] & (F.col("x") != F.col("y"))).distinct(), "ways")
    nodes = written(ways.select(F.col("x").alias("node")).union(ways.select("y")).distinct().select(
        F.monotonically_increasing_id().alias("id"), "node", host_of(F.col("node")).alias("host"),
        path_of(F.col("node")).alias("path")), "nodes")
    places = seen.select("host", "path").union(nodes.select("host", "path")).where("host <> ''").distinct()
    decided = written(fitting(places, rules), "decided")

    at = nodes.select("id", "node")
    edges = ways.join(at.toDF("a", "x"), "x").join(at.toDF("b", "y"), "y").select("a", "b")
    alias = written(components(edges), "aliases")
    known = alias.join(nodes, alias["node"] == nodes["id"]).select(
        "component", nodes["node"].alias("node"), "host", "path").join(decided, ["host", "path"], "left")
    groups = known.groupBy("component").agg(F.min("verdict").alias("carried"))  # "allow" is before "block"
    carried = known.where("verdict IS NULL").join(groups.where("carried IS NOT NULL"), "component").select("node", "carried")
    return seen.join(decided, ["host", "path"], "left").join(carried, "node", "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("verdict", "carried", F.lit(default)).alias("verdict"))
