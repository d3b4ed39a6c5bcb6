"""Keyword scoring rules (substring hits, distinct keywords, thresholds)."""

from narrata.functions.priority import issue_rule_group, keyword_hits, score_priority
from narrata.fixed_values import PRIORITY_KEYWORDS

# FIXED VALUES: keyword edge cases (F-keywords) and the expected outcome
CASES = [
    ("this is an issue", "High"),                   # 'sue' inside 'issue'
    ("they threaten wage garnishment", "Critical"),  # threaten + garnish + wage garnishment
    ("my identity stolen", "Critical"),              # identity stolen + stolen
    ("a billing dispute", "Medium"),                 # billing dispute + dispute
    ("fraud fraud fraud", "High"),                   # one distinct keyword
    ("FRAUD and a LAWSUIT", "Critical"),             # case-insensitive
    ("late fee", "Low"),                             # one medium keyword only
    ("nothing here", "Low"),
]


def test_priority_cases(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "t string")
    got = [r[0] for r in df.select(score_priority("t")).collect()]
    assert got == [p for _, p in CASES]


def test_hits_count_distinct_keywords(spark):
    df = spark.createDataFrame([("fraud fraud scam",)], "t string")
    assert df.select(keyword_hits("t", PRIORITY_KEYWORDS["high"])).first()[0] == 2


def test_issue_rules_first_match(spark):
    df = spark.createDataFrame([("stolen card and a late fee",), ("my mortgage",), ("hello",)],
                               "t string")
    got = [r[0] for r in df.select(issue_rule_group("t")).collect()]
    assert got == ["Fraud/Security", "Loan Servicing", "Customer Service"]
