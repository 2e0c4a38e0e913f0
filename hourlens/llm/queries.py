"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlens.llm.chat import repair
from hourlens.llm.decontaminate import matches
from hourlens.llm.divergence import divergence
from hourlens.llm.fill_middle import rearrange, restored
from hourlens.llm.language import identify
from hourlens.llm.lines import repeated_lines
from hourlens.llm.minhash import near_duplicates
from hourlens.llm.mixing import mix, quality_of, size_of
from hourlens.llm.neighbours import nearest
from hourlens.llm.shared import written
from hourlens.llm.token_counts import token_counts
from hourlens.llm.token_files import token_files
from hourlens.llm.toxicity import classify
from hourlens.llm.url_filter import judge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query, sql: str | None = None) -> Query:
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return fn


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


@query
def op2_token_counts(spark: SparkSession, base: str) -> DataFrame:
    return token_counts(table(spark, base, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_token_files(spark: SparkSession, base: str) -> DataFrame:
    return token_files(table(spark, base, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_mixing(spark: SparkSession, base: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, base, "documents").select(
        "doc_id", "source", size_of(text).alias("size"), quality_of(text).alias("quality"))
    return mix(written(rows, "sizes")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op8_language(spark: SparkSession, base: str) -> DataFrame:
    return identify(table(spark, base, "documents"))


@query
def op1_toxicity(spark: SparkSession, base: str) -> DataFrame:
    return classify(table(spark, base, "documents"), table(spark, base, "labels"))


NEAR_SQL = """
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def op10_near_duplicates(spark: SparkSession, base: str) -> DataFrame:
    found = near_duplicates(table(spark, base, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


query(op10_near_duplicates, NEAR_SQL)


@query
def op3_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return nearest(table(spark, base, "embeddings"))


@query
def op7_decontamination(spark: SparkSession, base: str) -> DataFrame:
    found = matches(table(spark, base, "documents"), table(spark, base, "benchmark"))
    return found.select("doc_id", "item_id", "found", "share", "changed")


@query
def op6_lines(spark: SparkSession, base: str) -> DataFrame:
    found = repeated_lines(table(spark, base, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped")


@query
def op5_chat(spark: SparkSession, base: str) -> DataFrame:
    return repair(table(spark, base, "conversations"))


#: Rules of the URL query; a host with a path, of which the longest that fits decides.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))

URL_SQL = r"""
WITH RECURSIVE
rules(rule, verdict, rule_host, rule_path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'),
  ('net/fr/', 'block', 'net', '/fr/')),
tags AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                   lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?\s*([^\s"''>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                   lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^\s"''>]+)', 1)))) AS r
  FROM pages WHERE contains(url, '://')),
refs AS (SELECT url, replace(r, '&amp;', '&') AS r, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root,
                regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*/|/)', 1) AS folder FROM tags WHERE r <> ''),
ways AS (
  SELECT DISTINCT regexp_extract(url, '(?s)^([^#]*)', 1) AS x, regexp_extract(CASE
    WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN r
    WHEN starts_with(r, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || r
    WHEN starts_with(r, '/') THEN root || r
    WHEN starts_with(r, '?') THEN root || regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || r
    ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || r END, '(?s)^([^#]*)', 1) AS y FROM refs),
links AS (SELECT x, y FROM ways WHERE x <> y UNION SELECT y, x FROM ways WHERE x <> y),
reach(node, other) AS (SELECT x, x FROM links UNION SELECT reach.node, links.y FROM reach JOIN links ON links.x = reach.other),
urls AS (SELECT url FROM pages UNION SELECT x FROM links),
places AS (SELECT url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM urls),
judged AS (SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
           FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY url),
carried AS (SELECT node, min(verdict) AS verdict FROM reach JOIN judged ON judged.url = reach.other GROUP BY node)
SELECT page_id, p.host, p.path, j.rule, coalesce(j.verdict, c.verdict, 'allow') AS verdict
FROM pages LEFT JOIN places p ON p.url IS NOT DISTINCT FROM pages.url LEFT JOIN judged j ON j.url = pages.url
LEFT JOIN carried c ON c.node = regexp_extract(pages.url, '(?s)^([^#]*)', 1)"""


def op11_url_filter(spark: SparkSession, base: str) -> DataFrame:
    return judge(table(spark, base, "pages"), RULES).drop("url")


query(op11_url_filter, URL_SQL)


DIVERGENCE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
            lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM rows),
vocabulary AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM rows),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0::HUGEINT) AS n, t.n AS total, sum(coalesce(c.n, 0::HUGEINT)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS size
          FROM groups g JOIN vocabulary t USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (SELECT d.lang, source, term, d.n, 1 + 1000000000::HUGEINT * (d.n + 2) // (size + 2 * v) AS p,
                  1 + 1000000000::HUGEINT * (total + 2) // (l.n + 2 * v) AS q FROM dense d JOIN langs l ON l.lang = d.lang),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
          FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


def op12_divergence(spark: SparkSession, base: str) -> DataFrame:
    return divergence(table(spark, base, "documents"))


query(op12_divergence, DIVERGENCE_SQL)


MIDDLE_SQL = r"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, ('0x' || h[1:8])::BIGINT AS h1,
                 ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM rows),
cuts AS (SELECT *, len(t)::BIGINT AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b FROM drawn),
parts AS (SELECT *, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:n], '') AS suf,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""


def op13_fill_middle(spark: SparkSession, base: str) -> DataFrame:
    found = rearrange(table(spark, base, "documents"))
    output, form = F.col("output"), F.col("form")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"),
                        F.sha2(restored(output, form), 256).alias("restored_sha256"))


query(op13_fill_middle, MIDDLE_SQL)
