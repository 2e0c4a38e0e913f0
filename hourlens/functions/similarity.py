"""Similarity of a question skeleton and a template, and the scores built on it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the placeholder similarity leaves out.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")

# Intent words; the first intent with a hit wins.
INTENTS = (
    ("aggregation", ("how many", "total", "sum", "count", "average", "mean")),
    ("listing", ("list", "show", "display", "what are", "which")),
    ("comparison", ("compare", "versus", "vs", "difference", "between")),
    ("ranking", ("top", "best", "worst", "highest", "lowest", "most", "least")),
    ("trend", ("trend", "over time", "change", "growth", "decline")),
    ("detail", ("details about", "information about", "tell me about")),
)

# Acceptance thresholds by method.
THRESHOLDS = {"embedding": 0.75, "tfidf": 0.65, "keyword": 0.55}
KEYWORD_RELAXATION = 0.7


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def content_words(text: Column, is_template: bool) -> Column:
    """Words without stop words; a template's placeholder is one marker word, left out if it stands alone."""
    low = F.lower(text)
    if is_template:
        low = F.regexp_replace(low, r"\{[^}]+\}", "[ENTITY]")
    found = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    return F.array_except(found, F.array(*(F.lit(w) for w in (*STOP_WORDS, "[ENTITY]"))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements; 0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def text_similarity(a: Column | str, b: Column | str, least: Column | None = None) -> Column:
    """struct<lcs, jaro>: LCS ratio and Jaro-Winkler of two lower-cased texts.

    Where ``least`` is given, both are null if their sum cannot reach it, by
    the characters that the texts have in common. Spark has neither, so an Arrow UDF computes both for candidate pairs. Its
    helpers are nested, so it travels to the executors as a whole.
    """

    def lcs_length(a: str, b: str) -> int:
        """Longest common subsequence; one big-integer row of bits per character of ``b``."""
        masks: dict[str, int] = {}
        for i, ch in enumerate(a):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for ch in b:
            hit = row & masks.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    def jaro_winkler(a: str, b: str) -> float:
        """Jaro similarity, raised for a common prefix of up to four characters above 0.7."""
        if a == b:
            return 1.0 if a else 0.0
        if not a or not b:
            return 0.0
        reach = max(max(len(a), len(b)) // 2 - 1, 0)
        used = [False] * len(b)
        from_a = []
        for i, ch in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if not used[j] and b[j] == ch:
                    used[j] = True
                    from_a.append(ch)
                    break
        if not from_a:
            return 0.0
        from_b = [ch for ch, taken in zip(b, used) if taken]
        swapped = sum(x != y for x, y in zip(from_a, from_b)) // 2
        m = len(from_a)
        score = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        return score + prefix * 0.1 * (1 - score) if score > 0.7 else score

    def most(a: str, b: str, common: int) -> float:
        """What Jaro-Winkler is at most when the texts have so many characters in common."""
        if not common:
            return 0.0
        score = (common / len(a) + common / len(b) + 1) / 3
        prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
        return score + prefix * 0.1 * (1 - score)

    def scored(x: str, y: str, least: float | None) -> tuple[float | None, float | None]:
        longest = max(len(x), len(y))
        jaro = None
        if least is not None and x and y:
            common = (Counter(x) & Counter(y)).total()
            jaro = most(x, y, common)
            if common / longest + jaro < least - 1e-9:
                return None, None
        lcs = lcs_length(x, y) / longest if x and y else 0.0
        if jaro is not None and lcs + jaro < least - 1e-9:
            return None, None
        return lcs, jaro_winkler(x, y)

    def scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scored(x, y, None) for x, y in zip(a.str.lower(), b.str.lower())], columns=["lcs", "jaro"])

    def reaching(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.DataFrame:
        rows = [scored(*r) for r in zip(a.str.lower(), b.str.lower(), least)]
        return pd.DataFrame(rows, columns=["lcs", "jaro"], dtype="float64")

    if least is None:
        return F.pandas_udf(scores, "lcs double, jaro double")(a, b)
    return F.pandas_udf(reaching, "lcs double, jaro double")(a, b, least)


def keyword_score(word: Column, jaro: Column, lcs: Column, content: Column) -> Column:
    return 0.4 * word + 0.2 * jaro + 0.2 * lcs + 0.2 * content


def intent(text: Column) -> Column:
    """First intent one of whose words occurs anywhere in the text, else ``general``."""
    low = F.lower(text)
    out = F
    for name, hints in INTENTS:
        out = out.when(F.rlike(low, F.lit("|".join(hints))), F.lit(name))
    return out.otherwise("general")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors, in double precision."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def template_quality(
    success_rate: Column, usage_count: Column, last_used: Column, slot_types: Column, as_of: Column
) -> Column:
    """0.4 success + 0.2 usage + 0.2 recency + 0.2 number of entity types, each in [0, 1]."""
    days = F.datediff(as_of, F.to_date(last_used))
    return (
        0.4 * success_rate
        + 0.2 * F.least(F.log1p(usage_count) / 10, F.lit(1.0))
        + 0.2 * F.coalesce(F.exp(-days / 30), F.lit(0.0))
        + 0.2 * F.least(slot_types / 5, F.lit(1.0))
    )


def combined_score(similarity: Column, same_intent: Column, quality: Column) -> Column:
    boost = F.when(same_intent, F.lit(1.15)).otherwise(F.lit(1.0))
    return similarity * boost * (0.8 + 0.2 * quality)


def context_boost(tables_shared: Column, shared_types: Column) -> Column:
    return F.when(tables_shared, F.lit(0.1)).otherwise(F.lit(0.0)) + 0.05 * shared_types


def shared_types(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def all_types_used(slots: Column, types: Sequence[str]) -> Column:
    """The slots cover every given type."""
    wanted = F.array(*(F.lit(t) for t in types))
    return F.size(F.array_except(wanted, F.transform(slots, lambda s: s["type"]))) == 0
