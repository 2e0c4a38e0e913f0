"""SQL text of templates: slots, filling, checking, migration. The text is for audit;
answers are computed from typed parameters, never by running filled text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"\{[^}]+\}"

# Statements a template may not hold, and words it must hold.
DANGEROUS = ("DROP", "DELETE", "TRUNCATE", "UPDATE", "INSERT", "ALTER", "CREATE")
REQUIRED = ("SELECT", "FROM")

# Quoted period texts that were not turned into dates.
UNRESOLVED_PERIOD = r"'(?:\{time_period_\d+\}|Q[1-4]\s+\d{4}|\d{4})[_-](?:start|end)'"


def slots(text: Column) -> Column:
    """array<struct<placeholder, type, ordinal>> of the distinct ``{type_n}`` placeholders in a text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{[a-z_]+_\d+\}"), F.lit(0)))
    return F.transform(found, lambda p: F.struct(
        p.alias("placeholder"),
        F.regexp_extract(p, r"\{([a-z_]+)_\d+\}", 1).alias("type"),
        F.regexp_extract(p, r"_(\d+)\}", 1).try_cast("int").alias("ordinal"),
    ))


def tables_used(sql: Column) -> Column:
    """Distinct names after FROM and JOIN."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:FROM|JOIN)\s+([^\s,]+)"), F.lit(1)))


def _quoted(value: Column) -> Column:
    return F.replace(value, F.lit("'"), F.lit("''"))


def fill_sql(sql: Column, entries: Column) -> Column:
    """Template SQL with values in place of slots.

    ``entries`` is array<struct<placeholder, value, start_date, end_date>>.
    ``{p}-start``, ``{p}_end`` and so on become dates; quotes in values are doubled.
    """
    def step(acc: Column, e: Column) -> Column:
        for mark in ("-", "_"):
            for side in ("start", "end"):
                slot = F.concat(e["placeholder"], F.lit(mark + side))
                day = F.coalesce(F.date_format(e[f"{side}_date"], "yyyy-MM-dd"), slot)
                acc = F.replace(acc, slot, day)
        return F.replace(acc, e["placeholder"], _quoted(e["value"]))

    return F.aggregate(entries, sql, step)


def literal_pattern(value: Column) -> Column:
    """Regex that matches ``value`` literally, on word bounds unless it is Chinese."""
    quoted = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|#-])", r"\\$1")
    chinese = F.rlike(value, F.lit("[一-龥]"))
    left = F.when(F.rlike(value, F.lit(r"^\w")), F.lit(r"\b")).otherwise(F.lit(""))
    right = F.when(F.rlike(value, F.lit(r"\w$")), F.lit(r"\b")).otherwise(F.lit(""))
    return F.when(chinese, quoted).otherwise(F.concat(left, quoted, right))


def sql_to_template(sql: Column, entries: Column) -> Column:
    """Values in generated SQL become placeholders, longest value first.

    ``entries`` is array<struct<placeholder, value>>.
    """
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(
        (-F.length(e["value"])).alias("width"), e["placeholder"].alias("placeholder"), e["value"].alias("value"))))
    return F.aggregate(
        ordered, sql,
        lambda acc, e: F.when(
            F.length(e["value"]) > 0,
            F.regexp_replace(acc, literal_pattern(e["value"]), F.concat(F.lit("\\"), e["placeholder"])),
        ).otherwise(acc),
    )


def lint_sql(sql: Column, mapped: Column) -> Column:
    """Issues of a template: array of texts, empty when it is valid.

    ``mapped`` is the array of placeholders its entity map holds.
    """
    upper = F.upper(sql)
    in_sql = F.array_distinct(F.regexp_extract_all(sql, F.lit(PLACEHOLDER), F.lit(0)))
    depth = F.aggregate(
        F.regexp_extract_all(sql, F.lit("[()]"), F.lit(0)),
        F.struct(F.lit(0).alias("open"), F.lit(False).alias("broken")),
        lambda acc, c: F.struct(
            (acc["open"] + F.when(c == "(", 1).otherwise(-1)).alias("open"),
            (acc["broken"] | ((acc["open"] == 0) & (c == ")"))).alias("broken"),
        ),
        lambda acc: acc["broken"] | (acc["open"] != 0),
    )
    odd = (F.regexp_count(sql, F.lit("'")) % 2 != 0) | (F.regexp_count(sql, F.lit('"')) % 2 != 0)
    checks = [
        F.when(F.rlike(upper, F.lit(rf"\b{w}\b")), F.lit(f"dangerous: {w}")) for w in DANGEROUS
    ] + [
        F.when(~F.rlike(upper, F.lit(rf"\b{w}\b")), F.lit(f"missing: {w}")) for w in REQUIRED
    ]
    unknown = F.transform(F.array_except(in_sql, mapped), lambda p: F.concat(F.lit("unknown slot: "), p))
    unused = F.transform(F.array_except(mapped, in_sql), lambda p: F.concat(F.lit("unused slot: "), p))
    syntax = [F.when(depth, F.lit("unbalanced parentheses")), F.when(odd, F.lit("unbalanced quotes"))]
    return F.concat(
        F.array_compact(F.array(*checks)), unknown, unused, F.array_compact(F.array(*syntax))
    )


def unresolved_period(sql: Column) -> Column:
    """Filled SQL that still holds a period text where a date belongs."""
    return F.rlike(sql, F.lit(UNRESOLVED_PERIOD))


def migrate_period_sql(sql: Column) -> Column:
    """``period = '{time_period_n}'`` rewritten as an overlap of the row's dates."""
    return F.regexp_replace(
        sql, r"\bperiod\s?=\s?'(\{time_period_\d+\})'",
        "NOT (start_date > '$1-end' OR end_date < '$1-start')",
    )


def period_style(sql: Column) -> Column:
    """How a template states its period: ``simple``, ``start_end`` or ``other``."""
    return (
        F.when(F.rlike(sql, F.lit(r" period = |period='")), "simple")
        .when(F.rlike(sql, F.lit(r"\{time_period_")) & F.rlike(sql, F.lit("-start|-end")), "start_end")
        .otherwise("other")
    )
