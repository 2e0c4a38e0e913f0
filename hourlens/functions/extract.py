"""Mentions in free text as Column expressions: spans, values, ordinals, skeletons.

One pass of a single alternation reads a text left to right. At a given
position the longer grammar stands first, so a year inside a date or a number
inside a percentage is never a mention of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourlens.functions.periods import MONTHS

# Mention grammar per type (whole matches, no look-around).
_MONTH = "|".join(MONTHS)
_MON = "|".join(m[:3] for m in MONTHS)
DATE = (
    r"\b\d{4}-\d{1,2}-\d{1,2}\b"
    r"|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
    rf"|\b(?i:{_MONTH})\s+\d{{1,2}},?\s*\d{{4}}\b"
    rf"|\b(?i:{_MON})[a-z]*\s+\d{{1,2}},?\s*\d{{4}}\b"
    rf"|\b(?i:{_MON})[a-z]*\s+\d{{1,2}},?\s+\d{{2}}\b"
    rf"|\b\d{{1,2}}\s+(?i:{_MONTH})\s+\d{{4}}\b"
)
QUARTER = (
    r"\b(?i:Q)[1-4]\s+\d{4}\b|\b\d{4}\s+(?i:Q)[1-4]\b|\b(?i:quarter)\s+[1-4]\s+(?i:of\s+)?\d{4}\b|\b(?i:Q)[1-4]\b"
)
QUARTER_WORDS = r"\b(?i:first|second|third|fourth)\s+(?i:quarter)(?:(?:\s+(?i:of))?\s+\d{4})?\b"
RELATIVE = r"\b(?i:this|last|next|previous)\s+(?i:month|year|week|quarter|day)\b"
WEEK = r"\b(?i:week)\s+\d{1,2}(?:\s+(?i:of))?\s+\d{4}\b"
MONTH_YEAR = rf"\b(?i:{_MONTH})\s+\d{{4}}\b"
FISCAL_YEAR = r"\b(?i:fiscal year|year|FY)\s+\d{4}\b"
YEAR = r"\b\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PROJECT_ID = r"\b(?:P|PROJ|PROJECT)-\d+\b|\b[A-Z]+-\d{4,}\b"
PERCENTAGE = r"\b\d+(?:\.\d+)?%"
NUMBER = r"\b\d+(?:\.\d+)?\b"

# (type, sub-form, pattern): order is precedence at one position.
GRAMMAR = (
    ("email", "email", EMAIL),
    ("date", "date", DATE),
    ("time_period", "quarter", QUARTER),
    ("time_period", "quarter_words", QUARTER_WORDS),
    ("time_period", "relative", RELATIVE),
    ("time_period", "week", WEEK),
    ("time_period", "month_year", MONTH_YEAR),
    ("time_period", "year", FISCAL_YEAR),
    ("project_id", "project_id", PROJECT_ID),
    ("percentage", "percentage", PERCENTAGE),
    ("time_period", "year", YEAR),
    ("number", "number", NUMBER),
)
# How any match begins: where this fails, no entry is tried.
_BEGINS = (
    r"(?=\d|[A-Z]+-\d|(?i:a(?:pr|ug)|dec|f(?:eb|irst|iscal|ourth|y)|j(?:an|u[ln])|last|ma[ry]|n(?:ext|ov)|oct|previous"
    r"|q(?:[1-4]|uarter)|se(?:cond|p)|th(?:ird|is)|week|year)|[A-Za-z0-9._%+-]+@)"
)
# One group per grammar entry; every entry starts at a word boundary.
LEXER = r"\b" + _BEGINS + "(?:" + "|".join(
    "(" + pattern.replace(r"|\b", "|").removeprefix(r"\b") + ")" for _, _, pattern in GRAMMAR
) + ")"

# The order in which types take their placeholders.
TYPE_ORDER = (
    "project", "employee", "department", "work_type", "time_period",
    "date", "project_id", "email", "percentage", "number",
)

# Chinese and mixed-language patterns.
CJK = "一-龥"
CHINESE_GRAMMAR = (
    ("time_period", rf"\d{{4}}年第?[一二三四]季度|\d{{4}}年\d{{1,2}}月|\d{{4}}年Q[1-4]|Q[1-4]\s*\d{{4}}年?"
                    rf"|(?i:{_MONTH})\s*\d{{4}}年|第[一二三四]季度|[今上下本]个?[月季年]|[一二三四五六七八九十]+月份?"),
    ("department", rf"[{CJK}]+(?:管理)?(?:部|中心|科|室|组|办)|[{CJK}]+(?:设计|工程|营销|财务|行政)[{CJK}]*"),
    ("employee", rf"[{CJK}]{{2,4}}(?:经理|总监|主任|助理|工程师|设计师|顾问|专员|分析师)|[{CJK}]{{2,4}}\s+(?i:Manager|Engineer|Director|Supervisor)"
                 rf"|(?i:Manager|Engineer|Director|Supervisor)\s+[{CJK}]{{2,4}}"),
    ("work_type", rf"[{CJK}]+(?:工作|任务|事项|配合|对接|审核|检查|管理|设计|施工)|(?:现场|材料|施工|设计|预算|客户)[{CJK}]*"),
    ("project", rf"[{CJK}]+(?:项目|工程|建设|改造|升级)|[{CJK}]+(?:大厦|大楼|园区|广场|中心)"),
)


def matches(text: Column, pattern: str) -> Column:
    """Every whole match, in text order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


SPAN = "struct<start:int,end:int,group:int,value:string>"
_OPEN, _NEXT, _CLOSE = "\x01", "\x03", "\x02"


def spans(text: Column, pattern: str, groups: int = 1) -> Column:
    """array<struct<start, end, group, value>> of the whole matches (0-based, end exclusive).

    ``pattern`` consists of ``groups`` capturing groups of which one matches;
    ``group`` is its number. One regex pass marks the matches, a plain split
    takes the marked text apart, and the piece lengths give exact positions.
    """
    plain = F.translate(text, _OPEN + _NEXT + _CLOSE, "   ")
    marks = _OPEN + _NEXT.join(f"${g + 1}" for g in range(groups)) + _CLOSE
    pieces = F.split(F.regexp_replace(plain, pattern, marks), f"(?={_OPEN})|{_CLOSE}", -1)
    nothing = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, piece: Column) -> Column:
        hit = F.startswith(piece, F.lit(_OPEN))
        value, group = F.substring(piece, F.lit(2), F.length(piece)), F.lit(1)
        if groups > 1:  # as many signs before the value as groups before its own
            group = F.length(value) - F.length(F.ltrim(value, F.lit(_NEXT))) + 1
            value = F.btrim(value, F.lit(_NEXT))
        lo = acc["at"]
        hi = lo + F.when(hit, F.length(piece) - groups).otherwise(F.length(piece))
        item = F.struct(lo.alias("start"), hi.alias("end"), group.cast("int").alias("group"), value.alias("value"))
        out = F.when(hit, F.concat(acc["out"], F.array(item))).otherwise(acc["out"])
        return F.struct(hi.alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    return F.coalesce(F.aggregate(pieces, start, step, lambda acc: acc["out"]), nothing)


def lex(text: Column) -> Column:
    """Spans of the whole grammar; ``group`` counts from 1 in GRAMMAR."""
    return spans(text, LEXER, len(GRAMMAR))


def type_of(group: Column) -> Column:
    return F.element_at(F.array(*(F.lit(kind) for kind, _, _ in GRAMMAR)), group)


def mentions_of_form(text: Column, *forms: str) -> Column:
    """Distinct matches of the given sub-forms, in order of first appearance."""
    wanted = [i + 1 for i, (_, form, _) in enumerate(GRAMMAR) if form in forms]
    found = F.filter(lex(text), lambda s: s["group"].isin(*wanted))
    return F.array_distinct(F.transform(found, lambda s: s["value"]))


def type_rank(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in TYPE_ORDER)), kind).cast("int")


MENTION = "struct<start:int,neg_end:int,rank:int,type:string,value:string,canonical:string>"


def mention(start: Column, end: Column, kind: Column, value: Column, canonical: Column | None = None) -> Column:
    """A mention in sort order: by start, longest first, then type order."""
    canonical = F.lit(None).cast("string") if canonical is None else canonical
    return F.struct(
        start.alias("start"), (-end).alias("neg_end"), type_rank(kind).alias("rank"),
        kind.alias("type"), value.alias("value"), canonical.alias("canonical"),
    )


def pattern_mentions(text: Column) -> Column:
    """array<mention> of every lexer match in the text."""
    return F.transform(lex(text), lambda s: mention(s["start"], s["end"], type_of(s["group"]), s["value"]))


def chinese_mentions(text: Column) -> Column:
    """array<mention> of the Chinese and mixed patterns (matches of at least 2 characters)."""
    def of(kind: str, pattern: str) -> Column:
        long_enough = F.filter(spans(text, f"({pattern})"), lambda s: F.length(F.trim(s["value"])) >= 2)
        return F.transform(long_enough, lambda s: mention(s["start"], s["end"], F.lit(kind), s["value"]))

    found = [of(kind, pattern) for kind, pattern in CHINESE_GRAMMAR]
    none = F.array().cast(f"array<{MENTION}>")
    return F.when(has_chinese(text), F.concat(*found)).otherwise(none)


def has_chinese(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{CJK}]"))


def language_class(text: Column) -> Column:
    """``zh`` pure Chinese, ``mixed`` Chinese with Latin letters, else ``en``."""
    latin = F.rlike(text, F.lit("[A-Za-z]"))
    return F.when(has_chinese(text) & latin, "mixed").when(has_chinese(text), "zh").otherwise("en")


def valid_mention(value: Column, kind: Column) -> Column:
    """Not blank; a date has a full shape; a name has at least two characters."""
    trimmed = F.trim(value)
    full_date = (
        r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\w{3,9}\s+\d{1,2},?\s*\d{2,4}"
        r"|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}\s+\w{3,9}\s+\d{4}"
    )
    return (
        F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, False)
        .when(kind == "date", (F.length(trimmed) >= 6) & F.rlike(trimmed, F.lit(full_date)))
        .when(kind.isin("employee", "project", "department", "time_period"), F.length(trimmed) >= 2)
        .otherwise(True)
    )


def keep_longest(found: Column) -> Column:
    """Drop blank mentions and every mention that lies inside, or starts inside, one kept before it."""
    ordered = F.sort_array(F.filter(found, lambda m: valid_mention(m["value"], m["type"])))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MENTION}>").alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        free = m["start"] >= acc["at"]
        return F.struct(
            F.when(free, -m["neg_end"]).otherwise(acc["at"]).alias("at"),
            F.when(free, F.concat(acc["kept"], F.array(m))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def entity_keys(kept: Column) -> Column:
    """One key per kept mention: its type and its name, or its value where no name is known."""
    return F.transform(kept, lambda m: F.concat_ws(":", m["type"], F.lower(F.coalesce(m["canonical"], m["value"]))))


def number_mentions(kept: Column, keys: Column) -> Column:
    """One entry per distinct key, numbered within its type.

    Longer values come first, ties in text order. Names with the same
    canonical form are one entity.
    """
    entries = F.zip_with(kept, keys, lambda m, k: F.struct(m.alias("m"), k.alias("k")))
    firsts = F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    ordered = F.sort_array(F.transform(firsts, lambda e: F.struct(
        e["m"]["type"].alias("type"), (-F.length(e["m"]["value"])).alias("width"),
        e["m"]["start"].alias("start"), e["m"]["value"].alias("value"),
        e["m"]["canonical"].alias("canonical"), e["k"].alias("key"),
    )))

    def entry(e: Column, i: Column, types: Column) -> Column:
        first = F.array_position(types, e["type"]) - 1
        return F.struct(
            e["type"].alias("entity_type"), (i - first).cast("int").alias("ordinal"),
            e["value"].alias("value"), e["canonical"].alias("canonical"), e["key"].alias("key"),
        )

    # A one-element array binds the sorted list once for the lambda below.
    return F.flatten(F.transform(F.array(ordered), lambda sorted_: F.transform(
        sorted_, lambda e, i: entry(e, i, sorted_["type"]))))


def placeholder(kind: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("{"), kind, F.lit("_"), ordinal.cast("string"), F.lit("}"))


def skeleton(text: Column, kept: Column, keys: Column, numbered: Column) -> Column:
    """The text with every kept mention replaced by its ``{type_n}`` placeholder."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    numbers = numbered["key"]

    def step(acc: Column, e: Column) -> Column:
        m = e["m"]
        own = F.element_at(numbered, F.array_position(numbers, e["k"]).cast("int"))
        gap = F.substring(text, acc["at"] + 1, m["start"] - acc["at"])
        slot = placeholder(m["type"], own["ordinal"])
        return F.struct((-m["neg_end"]).alias("at"), F.concat(acc["out"], gap, slot).alias("out"))

    entries = F.zip_with(kept, keys, lambda m, k: F.struct(m.alias("m"), k.alias("k")))
    return F.aggregate(
        entries, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
