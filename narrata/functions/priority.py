"""Keyword scoring as Column expressions.

A keyword hit is a substring test on the lower-cased text; each distinct
keyword counts once; overlapping keywords all count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.fixed_values import (ISSUE_RULE_CONFIDENCE, ISSUE_RULE_DEFAULT,
                                  ISSUE_RULES, PRIORITY_KEYWORDS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_hits(c, keywords) -> Column:
    low = F.lower(_c(c))
    total = F.lit(0)
    for kw in dict.fromkeys(keywords):
        total = total + low.contains(kw).cast("int")
    return total


def score_priority(c, lexicon=None) -> Column:
    lex = lexicon or PRIORITY_KEYWORDS
    high = keyword_hits(c, lex["high"])
    med = keyword_hits(c, lex["medium"])
    return (F.when(high >= 2, "Critical").when(high >= 1, "High")
            .when(med >= 2, "Medium").otherwise("Low"))


def issue_rule_group(c, rules=None, default: str = ISSUE_RULE_DEFAULT) -> Column:
    low = F.lower(_c(c))
    expr = None
    for group, kws in (rules or ISSUE_RULES):
        cond = None
        for kw in kws:
            hit = low.contains(kw)
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, group) if expr is None else expr.when(cond, group)
    return expr.otherwise(default)


def issue_rule_confidence() -> Column:
    return F.lit(ISSUE_RULE_CONFIDENCE)
