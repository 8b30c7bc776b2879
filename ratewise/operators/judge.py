"""Keyword judge and case reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, col, contains_any, words

AVOID_HIT = "contains_avoid_term"
MUST_MISS = "missing_must_include"


def violations(text, must_include, avoid) -> Column:
    """Broken constraints; an empty constraint list cannot be broken."""
    must, not_wanted = col(must_include), col(avoid)
    broken = F.array(
        F.when((F.size(not_wanted) > 0) & contains_any(text, not_wanted), F.lit(AVOID_HIT)),
        F.when((F.size(must) > 0) & ~contains_any(text, must), F.lit(MUST_MISS)),
    )
    return F.array_compact(broken)


def relevance(query, text, must_include, avoid, first: int | None = None) -> Column:
    """1, +2 for a must-include hit, +1 for one of the query's words (its ``first`` ones if given), -2 if violated; 0..5."""
    asked = words(query) if first is None else F.slice(words(query), 1, first)
    must = col(must_include)
    hit_query = bind(
        F.lower(F.coalesce(col(text), F.lit(""))),
        lambda hay: F.exists(asked, lambda w: F.contains(hay, w)),
    )
    raw = (
        F.lit(1.0)
        + F.when((F.size(must) > 0) & contains_any(text, must), F.lit(2.0)).otherwise(F.lit(0.0))
        + F.when(hit_query, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    lowered = F.when(F.size(violations(text, must_include, avoid)) > 0, F.greatest(F.lit(0.0), raw - 2.0)).otherwise(raw)
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), lowered))


def sanitize_violations(found, must_include, avoid) -> Column:
    """Remove labels (from any judge) whose constraint list is empty."""
    labels = col(found)
    labels = F.when(F.size(col(must_include)) == 0, F.array_remove(labels, MUST_MISS)).otherwise(labels)
    return F.when(F.size(col(avoid)) == 0, F.array_remove(labels, AVOID_HIT)).otherwise(labels)


def judge(pairs: DataFrame) -> DataFrame:
    """Adds ``relevance, violations, reason`` to ``query, text, must_include, avoid`` rows."""
    found = sanitize_violations(violations("text", "must_include", "avoid"), "must_include", "avoid")
    return pairs.withColumns(
        {
            "relevance": relevance("query", "text", "must_include", "avoid"),
            "violations": found,
            "reason": F.lit("keywords_fallback"),
        }
    )
