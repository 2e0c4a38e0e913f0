"""Views of TPC-H-like tables as the engine's own tables.

Everything here is a lazy projection or a dimension join, so filters and
column selections of a caller still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlens.sources.star import Star
from hourlens.sources.templates import GENERAL, SPECIAL, complete_templates, library


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def _text(column: str):
    return F.col(column).cast("string")


def star(spark: SparkSession, base: str) -> Star:
    """Suppliers are employees, nations departments, parts projects, line items hours."""
    nation = table(spark, base, "nation").select("n_nationkey", F.col("n_name").alias("department"))
    employee = (
        table(spark, base, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("uuid"), F.col("s_name").alias("name"),
            F.concat(F.lit("S-"), _text("s_suppkey")).alias("alias"), "department",
        )
    )
    project = table(spark, base, "part").select(
        F.col("p_partkey").alias("uuid"),
        F.concat(F.lit("P-"), _text("p_partkey")).alias("project_reference_id"),
        F.col("p_name").alias("name"),
    )
    start = F.col("l_shipdate").cast("date")
    work_hour = table(spark, base, "lineitem").select(
        F.col("l_suppkey").alias("employee_id"), F.col("l_partkey").alias("project_id"),
        F.concat("l_returnflag", "l_linestatus").alias("work_type"),
        F.col("l_quantity").alias("hours"),
        start.alias("start_date"), F.date_add(start, F.col("l_linenumber")).alias("end_date"),
    )
    return Star(employee, project, work_hour)


# The question shapes of the derived question log.
QUESTION_SHAPES = (
    "How many hours did {e} work on the {p} project in {q}?",
    "What projects did {e} work on in {m}?",
    "Who worked on the {p} project in {y}?",
    "How many hours did {e} work in {q}?",
    "How many hours were spent on the {p} project in {w}?",
    "Compare the hours worked by {e} and {e2} in {q}",
    "Compare the hours spent on {i} and {i2} in {m}",
    "Which projects had the most hours in last quarter?",
    "Which employees worked the most hours in this year?",
    "List all hours for {a} by project in {q}",
    "How many hours did employees in {d} work in {q}?",
    "Send 12.5% of the {t} report on {i} to user{k}@example.com for 40 people",
    "How many hours did they work in {q}?",
)


def question_parts(spark: SparkSession, base: str) -> DataFrame:
    """Orders with the words a question about them uses (one row per order)."""
    s = star(spark, base)
    people = s.employee.select("uuid", "name", "department")
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, base, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("session_id"),
        F.col("o_orderdate").alias("ts"), day.alias("day"),
        F.expr("o_custkey div 15").alias("ek"), F.expr("(o_orderkey * 2) div 15").alias("pk"),
    )
    second = people.select(F.col("uuid").alias("ek2"), F.col("name").alias("e2"))
    return (
        orders.join(people, F.col("ek") == F.col("uuid"))
        .withColumn("ek2", F.col("ek").bitwiseXOR(F.lit(1).cast("long")))
        .join(second, "ek2")
        .join(s.project.select(F.col("uuid").alias("pk"), F.col("name").alias("p")), "pk")
        .select(
            "question_id", "session_id", "ts", "day",
            F.pmod("question_id", F.lit(len(QUESTION_SHAPES))).cast("int").alias("shape"),
            F.col("name").alias("e"), F.concat(F.lit("Staff "), _text("ek")).alias("a"), "e2", "p", F.col("department").alias("d"),
            F.concat(F.lit("Q"), F.quarter("day").cast("string"), F.lit(" "), F.year("day").cast("string")).alias("q"),
            F.date_format("day", "MMMM yyyy").alias("m"), F.year("day").cast("string").alias("y"),
            F.concat(
                F.element_at(F.array(*(F.lit(w) for w in ("first", "second", "third", "fourth"))), F.quarter("day")),
                F.lit(" quarter of "), F.year("day").cast("string"),
            ).alias("w"),
            F.concat(F.lit("P-"), _text("pk")).alias("i"),
            F.concat(F.lit("P-"), F.col("pk").bitwiseXOR(F.lit(1).cast("long")).cast("string")).alias("i2"),
            F.date_format("day", "yyyy-MM-dd").alias("t"), F.col("session_id").cast("string").alias("k"),
        )
    )


def questions(spark: SparkSession, base: str) -> DataFrame:
    """Question log derived from orders: question_id, session_id, ts, text."""
    parts = question_parts(spark, base)
    text = F
    for number, shape in enumerate(QUESTION_SHAPES):
        pieces = []
        for index, piece in enumerate(shape.replace("}", "{").split("{")):
            pieces.append(F.col(piece) if index % 2 else F.lit(piece))
        text = text.when(F.col("shape") == number, F.concat(*pieces))
    return parts.select("question_id", "session_id", "ts", text.alias("text"))


def dictionary(spark: SparkSession, base: str) -> DataFrame:
    """Known names by type: people, projects, departments, work types."""
    def names(kind: str, source: DataFrame, column) -> DataFrame:
        return source.select(F.lit(kind).alias("entity_type"), column.alias("entity")).distinct()

    return (
        names("employee", table(spark, base, "supplier"), F.col("s_name"))
        .unionByName(names("project", table(spark, base, "part"), F.col("p_name")))
        .unionByName(names("department", table(spark, base, "nation"), F.col("n_name")))
        .unionByName(names("work_type", table(spark, base, "lineitem"), F.concat("l_returnflag", "l_linestatus")))
    )


def aliases(spark: SparkSession, base: str) -> DataFrame:
    """Aliases by type. Departments share their region's name, so those aliases collide."""
    def rows(kind: str, source: DataFrame, canonical: str, seq: str, *spellings) -> DataFrame:
        listed = F.array(*spellings)
        return source.select(
            F.lit(kind).alias("entity_type"), F.col(canonical).alias("canonical"),
            F.col(seq).cast("int").alias("canonical_seq"), F.posexplode(listed).alias("alias_seq", "alias"),
        ).select("entity_type", "canonical", "canonical_seq", "alias", "alias_seq")

    region = table(spark, base, "region")
    nation = table(spark, base, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    project = table(spark, base, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seq"))
    return (
        rows("employee", table(spark, base, "supplier"), "s_name", "s_suppkey",
             F.concat(F.lit("S-"), _text("s_suppkey")), F.concat(F.lit("Staff "), _text("s_suppkey")))
        .unionByName(rows("department", nation, "n_name", "n_nationkey",
                          F.col("r_name"), F.concat(F.lit("Dept "), _text("n_nationkey"))))
        .unionByName(rows("project", project, "p_name", "seq", F.concat(F.lit("Project "), _text("seq"))))
    )


_LIBRARY = [question for question, _ in (*GENERAL, *SPECIAL)]
#: The skeletons of the derived question log, one per shape: library questions and three that are none.
SKELETONS = (
    *_LIBRARY[:10], _LIBRARY[11],
    "Send {percentage_0} of the {date_0} report on {project_id_0} to {email_0} for {number_0} people",
    "What is the weather like today?",
)
# How a question is opened, by order status.
OPENINGS = {"F": "", "O": "please: ", "P": "tell me about this - "}


def skeleton_log(spark: SparkSession, base: str) -> DataFrame:
    """Skeletons as they come out of the extraction of a question log (one row per order)."""
    texts = F.array(*(F.lit(s) for s in SKELETONS))
    opening = F.create_map(*(F.lit(x) for pair in OPENINGS.items() for x in pair))
    body = F.element_at(texts, (F.pmod("o_orderkey", F.lit(len(SKELETONS))) + 1).cast("int"))
    return table(spark, base, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("session_id"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.coalesce(F.try_element_at(opening, F.col("o_orderstatus")), F.lit("")), body).alias("skeleton"),
    )


def feedback(spark: SparkSession, base: str) -> DataFrame:
    """Events as an outcome log of templates."""
    failed = F.col("event_type") == "error"
    return table(spark, base, "events").select(
        F.col("user_id").alias("template_id"), "event_id", "ts", (~failed).alias("success"),
        (F.col("value") * 25).alias("execution_ms"),
        F.when(failed, F.concat(F.lit("failed: "), "props")).alias("error"),
    )


def requests(spark: SparkSession, base: str) -> DataFrame:
    """Events as a request log with response times."""
    return table(spark, base, "events").select(
        F.col("event_id").alias("request_id"), "ts",
        F.col("event_type").isin("view", "click", "purchase").alias("hit"), F.col("value").alias("ms"),
    )


def used_templates(spark: SparkSession, base: str) -> DataFrame:
    """The built-in templates with use counts, success rates and last use taken from events."""
    ours, size = library(spark), len(GENERAL) + len(SPECIAL)
    stats = feedback(spark, base).groupBy(
        (F.pmod("template_id", F.lit(size)) + 1).alias("template_id")
    ).agg(F.count("*").alias("uses"), F.avg(F.col("success").cast("double")).alias("rate"), F.max("ts").alias("used"))
    return ours.drop("usage_count", "success_rate", "last_used").join(stats, "template_id", "left").select(
        "template_id", "template_query", "sql_template", "slots", "source", "intent", "tables_used",
        F.coalesce("uses", F.lit(0)).alias("usage_count"), F.coalesce("rate", F.lit(1.0)).alias("success_rate"),
        F.col("used").alias("last_used"), "created_at", "needs_review",
    )


def sentences(spark: SparkSession, base: str) -> DataFrame:
    """Distinct sentences of all documents: skeleton (numbers are a placeholder), uses, shared (by documents), first (doc_id and place)."""
    pieces = table(spark, base, "documents").select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("at", "piece"))
    return pieces.select(
        "doc_id", (F.col("doc_id") * 1_000_000 + F.col("at")).alias("place"),
        F.regexp_replace(F.trim("piece"), "[0-9]+", "{number_0}").alias("skeleton"),
    ).where("skeleton <> ''").groupBy("skeleton").agg(
        F.count("*").alias("uses"), (F.min("doc_id") < F.max("doc_id")).alias("shared"), F.min("place").alias("first"))


def learned_templates(said: DataFrame) -> DataFrame:
    """Sentences of more than one document as a template table; uses are their occurrences."""
    return complete_templates(said.where("shared").select(
        F.col("first").alias("template_id"), F.col("skeleton").alias("template_query"), F.lit("").alias("sql_template"),
        F.col("uses").alias("usage_count"), F.lit("learned").alias("source")))
