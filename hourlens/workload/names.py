"""Dictionary and alias queries; extraction of the whole question log."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlens.operators import names as N
from hourlens.plans.extraction import distinct_texts, fill_text, find_mentions, mentions_long, of_texts
from hourlens.sources.tpch import SKELETONS, aliases, dictionary, question_parts, questions, table
from hourlens.workload import cores, register
from hourlens.workload.texts import PARTS_SQL, QUESTIONS_SQL, with_questions

DICTIONARY_SQL = """
dictionary AS (
  SELECT DISTINCT 'employee' AS entity_type, s_name AS entity FROM supplier
  UNION SELECT 'project', p_name FROM part
  UNION SELECT 'department', n_name FROM nation
  UNION SELECT 'work_type', l_returnflag || l_linestatus FROM lineitem)"""

ALIASES_SQL = """
aliases AS (
  SELECT 'employee' AS entity_type, s_name AS canonical, s_suppkey AS canonical_seq, 'S-' || s_suppkey AS alias, 0 AS alias_seq FROM supplier
  UNION ALL SELECT 'employee', s_name, s_suppkey, 'Staff ' || s_suppkey, 1 FROM supplier
  UNION ALL SELECT 'department', n_name, n_nationkey, r_name, 0 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'department', n_name, n_nationkey, 'Dept ' || n_nationkey, 1 FROM nation
  UNION ALL SELECT 'project', p_name, min(p_partkey), 'Project ' || min(p_partkey), 0 FROM part GROUP BY p_name),
spelled AS (
  SELECT DISTINCT entity_type, canonical, canonical_seq, canonical AS variation, -1 AS alias_seq FROM aliases
  UNION ALL SELECT entity_type, canonical, canonical_seq, alias, alias_seq FROM aliases),
owners AS (
  SELECT entity_type, key, canonical FROM (
    SELECT entity_type, lower(variation) AS key, canonical, row_number() OVER (
      PARTITION BY entity_type, lower(variation) ORDER BY canonical_seq DESC, alias_seq DESC) AS rn FROM spelled)
  WHERE rn = 1)"""


def with_aliases(select: str) -> str:
    return f"WITH {ALIASES_SQL.strip()}\n{select}"


@register("dictionary_match", f"""
WITH {QUESTIONS_SQL}, {DICTIONARY_SQL.strip()}
SELECT DISTINCT q.question_id, d.entity_type, d.entity
FROM questions q JOIN dictionary d
  ON regexp_matches(lower(q.text), '(^|[^a-z0-9_])' || lower(d.entity) || '($|[^a-z0-9_])')""")
def dictionary_match(spark, base):
    known, log = dictionary(spark, base), questions(spark, base)
    texts = distinct_texts(log, cores(spark))
    hits = N.dictionary_hits(texts, N.known_names(known), "text_id").select(
        "text_id", "entity_type", F.col("canonical").alias("entity")).distinct()
    return of_texts(log, texts.join(hits, "text_id")).select("question_id", "entity_type", "entity").distinct()


def _values(spark, base):
    """One written name per order: a name, an alias in capitals, a shared alias, a stranger."""
    turn = F.pmod("question_id", F.lit(4))
    return question_parts(spark, base).select(
        "question_id", F.when(turn == 2, "department").otherwise("employee").alias("entity_type"),
        F.when(turn == 0, F.col("e")).when(turn == 1, F.concat(F.upper("a"), F.lit(" ")))
        .when(turn == 2, F.lit("Asia")).otherwise(F.lit("Nobody")).alias("value"))


VALUES_SQL = """values_in AS (
  SELECT question_id, CASE question_id % 4 WHEN 2 THEN 'department' ELSE 'employee' END AS entity_type,
         CASE question_id % 4 WHEN 0 THEN e WHEN 1 THEN upper(a) || ' ' WHEN 2 THEN 'Asia' ELSE 'Nobody' END AS value
  FROM parts)"""


@register("alias_normalize", f"""
WITH {PARTS_SQL}, {VALUES_SQL}, {ALIASES_SQL.strip()}
SELECT v.question_id, v.entity_type, v.value, coalesce(o.canonical, v.value) AS normalized
FROM values_in v LEFT JOIN owners o ON o.entity_type = v.entity_type AND o.key = lower(trim(v.value))""")
def alias_normalize(spark, base):
    return N.normalize_names(_values(spark, base), aliases(spark, base))


@register("alias_variations", with_aliases("""
SELECT entity_type, canonical, string_agg(variation, '|' ORDER BY alias_seq) AS variations
FROM spelled GROUP BY entity_type, canonical"""))
def alias_variations(spark, base):
    return N.alias_variations(aliases(spark, base)).select(
        "entity_type", "canonical", F.array_join("variations", "|").alias("variations"))


@register("alias_fuzzy_best", f"""
WITH {PARTS_SQL}, {ALIASES_SQL.strip()},
texts AS (SELECT question_id, substring(e, 1, 18 - CAST(question_id % 3 AS INTEGER)) || CASE question_id % 3 WHEN 0 THEN ' jr' ELSE '' END AS value FROM parts),
distinct_texts AS (SELECT DISTINCT lower(value) AS t FROM texts),
scored AS (
  SELECT t, s.canonical, s.canonical_seq, s.alias_seq,
         least(length(t), length(s.variation)) / greatest(length(t), length(s.variation)) AS score
  FROM distinct_texts JOIN spelled s ON s.entity_type = 'employee'
   AND (contains(t, lower(s.variation)) OR contains(lower(s.variation), t))),
best AS (
  SELECT t, canonical, score FROM (
    SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, canonical_seq, alias_seq) AS rn
    FROM scored WHERE score >= 0.8) WHERE rn = 1)
SELECT x.question_id, x.value, coalesce(o.canonical, b.canonical) AS canonical,
       round(CASE WHEN o.canonical IS NOT NULL THEN 1.0 ELSE b.score END, 6) AS score
FROM texts x LEFT JOIN owners o ON o.entity_type = 'employee' AND o.key = lower(x.value)
LEFT JOIN best b ON b.t = lower(x.value)""")
def alias_fuzzy_best(spark, base):
    turn = F.pmod("question_id", F.lit(3))
    text = F.concat(F.substring(F.col("e"), F.lit(1), (18 - turn).cast("int")), F.when(turn == 0, " jr").otherwise(""))
    texts = question_parts(spark, base).select(
        "question_id", F.lit("employee").alias("entity_type"), text.alias("value"))
    return N.fuzzy_canonical(texts, aliases(spark, base)).select(
        "question_id", "value", "canonical", F.round("score", 6).alias("score"))


@register("alias_stats", with_aliases("""
SELECT count(DISTINCT entity_type) AS entity_types, count(DISTINCT entity_type || '/' || canonical) AS canonicals,
       count(alias) AS aliases FROM aliases"""))
def alias_stats(spark, base):
    return N.alias_stats(aliases(spark, base))


@register("alias_collisions", with_aliases("""
SELECT entity_type, lower(alias) AS alias, count(DISTINCT canonical) AS owners FROM aliases
GROUP BY entity_type, lower(alias) HAVING count(DISTINCT canonical) > 1"""))
def alias_collisions(spark, base):
    return N.alias_collisions(aliases(spark, base))


@register("canonicals_by_type", with_aliases(
    "SELECT entity_type, canonical, CAST(min(canonical_seq) AS INTEGER) AS canonical_seq FROM aliases GROUP BY entity_type, canonical"))
def canonicals_by_type(spark, base):
    return N.canonicals_by_type(aliases(spark, base))


@register("alias_search", with_aliases("""
SELECT entity_type, canonical, count(*) FILTER (lower(variation) = 'asia') AS exact_hits, count(*) AS hits
FROM spelled WHERE contains(lower(variation), 'asia') GROUP BY entity_type, canonical"""))
def alias_search(spark, base):
    return N.alias_search(aliases(spark, base), "Asia")


def _customer_aliases(spark, base):
    """New employee aliases from customers: some repeat a known one, some name a new person."""
    key = F.expr("c_custkey div 15")
    known = F.pmod("c_custkey", F.lit(3)) < 2
    name = F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))
    return table(spark, base, "customer").select(
        F.lit("employee").alias("entity_type"),
        F.when(known, name).otherwise(F.col("c_name")).alias("canonical"),
        F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.concat(F.lit("S-"), key.cast("string")))
        .otherwise(F.concat(F.lit("C-"), F.col("c_custkey").cast("string"))).alias("alias"))


CUSTOMER_ALIASES_SQL = """fresh AS (
  SELECT DISTINCT 'employee' AS entity_type,
    CASE WHEN c_custkey % 3 < 2 THEN 'Supplier#' || lpad(CAST(c_custkey // 15 AS VARCHAR), 9, '0') ELSE c_name END AS canonical,
    CASE WHEN c_custkey % 3 = 0 THEN 'S-' || c_custkey // 15 ELSE 'C-' || c_custkey END AS alias
  FROM customer)"""


@register("alias_upsert", f"""
WITH {ALIASES_SQL.strip()}, {CUSTOMER_ALIASES_SQL},
added AS (SELECT f.* FROM fresh f ANTI JOIN aliases a USING (entity_type, canonical, alias)),
placed AS (
  SELECT d.entity_type, d.canonical, d.alias, o.seq, o.last_alias,
         dense_rank() OVER (PARTITION BY d.entity_type ORDER BY o.seq IS NOT NULL, d.canonical) AS n,
         row_number() OVER (PARTITION BY d.entity_type, d.canonical ORDER BY d.alias) AS k,
         (SELECT max(canonical_seq) FROM aliases WHERE entity_type = 'employee') AS last_seq
  FROM added d LEFT JOIN (
    SELECT entity_type, canonical, min(canonical_seq) AS seq, max(alias_seq) AS last_alias
    FROM aliases GROUP BY entity_type, canonical) o USING (entity_type, canonical))
SELECT entity_type, canonical, CAST(canonical_seq AS INTEGER) AS canonical_seq, alias, CAST(alias_seq AS INTEGER) AS alias_seq, false AS added FROM aliases
UNION ALL
SELECT entity_type, canonical, CAST(coalesce(seq, last_seq + n) AS INTEGER), alias, CAST(coalesce(last_alias, -1) + k AS INTEGER), true FROM placed""")
def alias_upsert(spark, base):
    return N.alias_upsert(aliases(spark, base), _customer_aliases(spark, base))


@register("alias_remove", f"""
WITH {ALIASES_SQL.strip()}, {CUSTOMER_ALIASES_SQL}
SELECT entity_type, canonical, CAST(canonical_seq AS INTEGER) AS canonical_seq, alias, CAST(alias_seq AS INTEGER) AS alias_seq
FROM aliases ANTI JOIN fresh USING (entity_type, canonical, alias)""")
def alias_remove(spark, base):
    return N.alias_remove(aliases(spark, base), _customer_aliases(spark, base))


# --- extraction of the question log ----------------------------------------------------

LAST_QUARTER = "'Q' || quarter(day - INTERVAL 3 MONTH) || ' ' || year(day - INTERVAL 3 MONTH)"
_SWAP = "length(i2) > length(i)"
# shape -> (type, ordinal, value, normalized)
_EXPECTED = {
    0: [("employee", "0", "e", "e"), ("project", "0", "p", "p"), ("time_period", "0", "q", "q")],
    1: [("employee", "0", "e", "e"), ("time_period", "0", "m", "m")],
    2: [("project", "0", "p", "p"), ("time_period", "0", "y", "y")],
    3: [("employee", "0", "e", "e"), ("time_period", "0", "q", "q")],
    4: [("project", "0", "p", "p"), ("time_period", "0", "w", "q")],
    5: [("employee", "0", "e", "e"), ("employee", "1", "e2", "e2"), ("time_period", "0", "q", "q")],
    6: [("project_id", f"CASE WHEN {_SWAP} THEN 1 ELSE 0 END", "i", "i"),
        ("project_id", f"CASE WHEN {_SWAP} THEN 0 ELSE 1 END", "i2", "i2"), ("time_period", "0", "m", "m")],
    7: [("time_period", "0", "'last quarter'", LAST_QUARTER)],
    8: [("time_period", "0", "'this year'", "y")],
    9: [("employee", "0", "a", "e"), ("time_period", "0", "q", "q")],
    10: [("department", "0", "d", "d"), ("time_period", "0", "q", "q")],
    11: [("percentage", "0", "'12.5%'", "'12.5%'"), ("date", "0", "t", "t"), ("project_id", "0", "i", "i"),
         ("email", "0", "'user' || k || '@example.com'", "'user' || k || '@example.com'"),
         ("number", "0", "'40'", "'40'")],
    12: [("time_period", "0", "q", "q")],
}
MENTIONS_SQL = "mentions AS (" + " UNION ALL ".join(
    f"SELECT question_id, '{t}' AS entity_type, {o} AS ordinal, {v} AS value, {n} AS normalized FROM parts WHERE shape = {s}"
    for s, rows in _EXPECTED.items() for t, o, v, n in rows) + ")"
_SKELETONS = dict(enumerate(SKELETONS[:12])) | {12: "How many hours did they work in {time_period_0}?"}
del _SKELETONS[6]  # there the order of the ids decides
SKELETONS_SQL = "skeletons AS (SELECT question_id, session_id, ts, shape, CASE shape " + " ".join(
    f"WHEN {n} THEN '{s}'" for n, s in _SKELETONS.items()) + (
    f" WHEN 6 THEN CASE WHEN {_SWAP} THEN 'Compare the hours spent on {{project_id_1}} and {{project_id_0}} in {{time_period_0}}'"
    " ELSE 'Compare the hours spent on {project_id_0} and {project_id_1} in {time_period_0}' END"
    " END AS skeleton FROM parts)")


def extracted(spark, base):
    return find_mentions(
        questions(spark, base), dictionary(spark, base), aliases(spark, base), chinese=False, partitions=cores(spark))


@register("job_extract", f"WITH {PARTS_SQL}, {MENTIONS_SQL} SELECT * FROM mentions")
def job_extract(spark, base):
    """The log is English, so the Chinese patterns are left out of the plan."""
    return mentions_long(extracted(spark, base))


@register("templatize", f"WITH {PARTS_SQL}, {SKELETONS_SQL} SELECT question_id, skeleton FROM skeletons")
def templatize(spark, base):
    return extracted(spark, base).select("question_id", "skeleton")


@register("fill_text", with_questions("SELECT question_id, text FROM questions"))
def fill_text_query(spark, base):
    """Filling every skeleton with its own mentions gives the question back."""
    return extracted(spark, base).select(
        "question_id", fill_text(F.col("skeleton"), F.col("entities")).alias("text"))


@register("entity_counts_by_type", f"""
WITH {PARTS_SQL}, {MENTIONS_SQL}
SELECT question_id, entity_type, count(*) AS n FROM mentions GROUP BY question_id, entity_type""")
def entity_counts_by_type(spark, base):
    return mentions_long(extracted(spark, base)).groupBy("question_id", "entity_type").agg(F.count("*").alias("n"))
