"""DuckDB text of the operators, for the SQL oracle check.

Each helper returns the SQL twin of a Column function or a CTE. Regexes are
written so that RE2 (DuckDB) and Java ``(?U)`` (Spark) agree on the test
tables: tokens as ``[\\p{L}\\p{N}_]+`` rather than ``\\b\\w+\\b``.
"""

from __future__ import annotations

from narrata.fixed_values import (DATE_CUTOFF, ISSUE_GROUP_MAP, ISSUE_RULE_DEFAULT,
                                  ISSUE_RULES, MIN_WORD_COUNT, OTHER_GROUP,
                                  PRIORITY_KEYWORDS, PRODUCT_LABEL_MAP, REDACTED)
from narrata.keys import draw_sql
from narrata.sources.fixtures import complaints_sql


def q(v: str) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def values_cte(name: str, cols: list[str], rows) -> str:
    body = ",\n  ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")"
                        for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES\n  {body})"


def clean_sql(x: str) -> str:
    t = f"lower({x})"
    t = f"regexp_replace({t}, '\\bx{{2,}}\\b', {q(REDACTED)}, 'g')"
    t = f"regexp_replace({t}, 'https?://\\S+|www\\.\\S+', '', 'g')"
    t = f"regexp_replace({t}, '\\S+@\\S+\\.\\S+', '', 'g')"
    t = f"regexp_replace({t}, '\\b\\d{{3}}[-.]?\\d{{3}}[-.]?\\d{{4}}\\b', '', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '\\S+')"


def wc_sql(x: str) -> str:
    return f"CAST(len({words_sql(x)}) AS INTEGER)"


def has_text_sql(x: str) -> str:
    return f"({x} IS NOT NULL AND regexp_matches({x}, '\\S'))"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def excerpt_sql(x: str, n: int = 60) -> str:
    w = words_sql(x)
    return (f"(array_to_string({w}[1:{n}], ' ') || "
            f"CASE WHEN len({w}) > {n} THEN '…' ELSE '' END)")


def date_sql(x: str) -> str:
    return (f"CAST(coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%Y-%m-%dT%H:%M:%S'), "
            f"try_strptime({x}, '%m/%d/%Y')) AS DATE)")


def hits_sql(x: str, kws) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), {q(k)}) AS INTEGER)"
                            for k in dict.fromkeys(kws)) + ")"


def priority_sql(x: str) -> str:
    h = hits_sql(x, PRIORITY_KEYWORDS["high"])
    m = hits_sql(x, PRIORITY_KEYWORDS["medium"])
    return (f"CASE WHEN {h} >= 2 THEN 'Critical' WHEN {h} >= 1 THEN 'High' "
            f"WHEN {m} >= 2 THEN 'Medium' ELSE 'Low' END")


def issue_rule_sql(x: str) -> str:
    parts = []
    for group, kws in ISSUE_RULES:
        cond = " OR ".join(f"contains(lower({x}), {q(k)})" for k in kws)
        parts.append(f"WHEN {cond} THEN {q(group)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(ISSUE_RULE_DEFAULT)} END"


def product_map_cte() -> str:
    return values_cte("pm", ["raw", "label"], PRODUCT_LABEL_MAP.items())


def issue_map_cte() -> str:
    return values_cte("im", ["raw", "grp"], ISSUE_GROUP_MAP.items())


def complaints_cte() -> str:
    return f"complaints AS ({complaints_sql()})"


def filtered_ctes(date_cutoff: str = DATE_CUTOFF, min_words: int = MIN_WORD_COUNT) -> str:
    """CTEs complaints, pm, im, filt (filters + product), dedup, prep."""
    return f""" {complaints_cte()},
{product_map_cte()},
{issue_map_cte()},
filt AS (
  SELECT c.complaint_id, {date_sql('c.date_received')} AS date_received, pm.label AS product,
         c.issue, c.sub_issue, c.narrative, c.company_response, c.timely
  FROM complaints c JOIN pm ON c.product = pm.raw
  WHERE {date_sql('c.date_received')} >= DATE '{date_cutoff}'
    AND {has_text_sql('c.narrative')}
    AND {wc_sql('c.narrative')} >= {min_words}),
dedup AS (
  SELECT * FROM filt
  QUALIFY row_number() OVER (PARTITION BY narrative ORDER BY complaint_id) = 1),
prep AS (
  SELECT d.*, {clean_sql('d.narrative')} AS narrative_clean,
         {wc_sql(clean_sql('d.narrative'))} AS word_count,
         coalesce(im.grp, {q(OTHER_GROUP)}) AS issue_group,
         {priority_sql('d.narrative')} AS priority
  FROM dedup d LEFT JOIN im ON d.issue = im.raw)"""


def balanced_ctes(max_per_class: int, min_per_class: int, seed: int,
                  src: str = "prep", label: str = "product") -> str:
    """CTEs bk (ranked), bal (balanced rows with draw)."""
    k = draw_sql("complaint_id", str(seed))
    pick = draw_sql(f"sd.{label}", "g.j", str(seed))
    return f"""bk AS (
  SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY {k}, complaint_id) AS _r,
         count(*) OVER (PARTITION BY {label}) AS _n
  FROM {src} s),
sd AS (SELECT DISTINCT {label}, _n FROM bk WHERE _n < {min_per_class}),
dr AS (SELECT sd.{label} AS _lab, CAST(g.j AS INTEGER) AS draw, ({pick} % sd._n) + 1 AS _pick
       FROM sd, (SELECT unnest(generate_series(1, {min_per_class})) AS j) g),
bal AS (
  SELECT * EXCLUDE (_r, _n), CAST(0 AS INTEGER) AS draw FROM bk WHERE _n >= {min_per_class} AND _r <= {max_per_class}
  UNION ALL
  SELECT bk.* EXCLUDE (_r, _n), dr.draw FROM bk JOIN dr ON bk.{label} = dr._lab AND bk._r = dr._pick)"""


def encoded_ctes(src: str = "bal") -> str:
    return f"""enc AS (
  SELECT b.*,
    CAST(dense_rank() OVER (ORDER BY product) - 1 AS INTEGER) AS product_encoded,
    CAST(dense_rank() OVER (ORDER BY issue_group) - 1 AS INTEGER) AS issue_group_encoded
  FROM {src} b)"""


def split_ctes(seed: int, src: str = "enc", stratify: str = "product_encoded") -> str:
    k = draw_sql("complaint_id", "draw", str(seed), "'split'")
    return f"""sr AS (
  SELECT e.*, row_number() OVER (PARTITION BY {stratify} ORDER BY {k}, complaint_id, draw) AS _r,
         count(*) OVER (PARTITION BY {stratify}) AS _n
  FROM {src} e),
spl AS (
  SELECT * EXCLUDE (_r, _n),
    CASE WHEN _r <= (_n * 7 + 5) // 10 THEN 'train'
         WHEN _r <= (_n * 85 + 50) // 100 THEN 'val' ELSE 'test' END AS split
  FROM sr)"""


def round_half_up_sql(x: str, d: int) -> str:
    """Spark's ``round`` (HALF_UP on the shortest decimal text of a double)."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 12)), {d}) AS DOUBLE)"


def per_class_ctes(src: str, model: bool = False, prefix: str = "") -> str:
    """CTEs {prefix}cnt, cls, pc: per-class tp/support/predicted/P/R/F1."""
    m = "model, " if model else ""
    k = "model, cls" if model else "cls"
    p = prefix
    return f"""{p}cnt AS (SELECT {m}y_true AS t, y_pred AS p, count(*) AS n FROM {src} GROUP BY ALL),
{p}cls AS (SELECT DISTINCT {m}t AS cls FROM {p}cnt UNION SELECT DISTINCT {m}p AS cls FROM {p}cnt),
{p}tp AS (SELECT {m}t AS cls, n AS tp FROM {p}cnt WHERE t = p),
{p}sup AS (SELECT {m}t AS cls, CAST(sum(n) AS BIGINT) AS support FROM {p}cnt GROUP BY ALL),
{p}prd AS (SELECT {m}p AS cls, CAST(sum(n) AS BIGINT) AS predicted FROM {p}cnt GROUP BY ALL),
{p}pc0 AS (SELECT c.*, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
                  coalesce(predicted, 0) AS predicted
           FROM {p}cls c LEFT JOIN {p}tp USING ({k}) LEFT JOIN {p}sup USING ({k})
                         LEFT JOIN {p}prd USING ({k})),
{p}pc AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
                 CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
                 CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f1
          FROM {p}pc0)"""


def summary_select(pc: str = "pc", model: bool = False, digits: int = 6) -> str:
    m = "model, " if model else ""
    g = "GROUP BY model" if model else ""

    def r(x):
        return f"round({x}, {digits})"
    return f"""SELECT {m}{r('CAST(sum(tp) AS DOUBLE) / sum(support)')} AS accuracy,
  {r('avg(precision)')} AS precision_macro, {r('avg(recall)')} AS recall_macro,
  {r('avg(f1)')} AS f1_macro, {r('sum(f1 * support) / sum(support)')} AS f1_weighted,
  CAST(sum(support) AS BIGINT) AS n
FROM {pc} {g}"""


def textrank_sql(src: str, steps: int = 20, damping: float = 0.85, n_sentences: int = 2) -> str:
    """Brute-force TextRank over sentence pairs (oracle only), unrolled.

    ``src`` is a CTE with (id, text). Produces CTE ``summ`` (id, summary)."""
    keep = f"CAST('{repr(1 - damping)}' AS DOUBLE)"
    d = f"CAST('{repr(damping)}' AS DOUBLE)"
    parts = [f"""tr_raw AS (SELECT id, unnest(generate_series(0, len(r) - 1)) AS pos, unnest(r) AS raw
           FROM (SELECT id, regexp_extract_all(text, '[^.!?\\n]+[.!?]*') AS r FROM {src})),
tr_s AS (SELECT id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS sentence FROM tr_raw),
tr_t AS (SELECT id, pos, sentence, list_distinct({tokens_sql('sentence')}) AS toks FROM tr_s),
tr_n AS (SELECT *, len(toks) AS n, ln(len(toks)) AS a FROM tr_t WHERE len(toks) > 0),
tr_p AS (SELECT x.id, x.pos AS i, y.pos AS j, len(list_intersect(x.toks, y.toks)) / (x.a + y.a) AS w
         FROM tr_n x JOIN tr_n y ON x.id = y.id AND x.pos <> y.pos
         WHERE x.a + y.a > 0 AND len(list_intersect(x.toks, y.toks)) > 0),
tr_d AS (SELECT id, i, sum(w) AS deg FROM tr_p GROUP BY ALL),
tr_x0 AS (SELECT id, pos, 1.0::DOUBLE AS x FROM tr_n)"""]
    for k in range(1, steps + 1):
        parts.append(f"""tr_x{k} AS (
  SELECT n.id, n.pos, {keep} + {d} * coalesce(z.z, 0.0) AS x FROM tr_n n LEFT JOIN (
    SELECT p.id, p.i, sum(p.w * xp.x / dd.deg) AS z FROM tr_p p
    JOIN tr_x{k - 1} xp ON xp.id = p.id AND xp.pos = p.j
    JOIN tr_d dd ON dd.id = p.id AND dd.i = p.j WHERE dd.deg > 0 GROUP BY p.id, p.i) z
  ON z.id = n.id AND z.i = n.pos)""")
    parts.append(f"""tr_top AS (
  SELECT s.id, s.pos, s.sentence FROM tr_n s JOIN tr_x{steps} x USING (id, pos)
  QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY round(x.x, 9) DESC, s.pos) <= {n_sentences}),
tr_j AS (SELECT id, string_agg(sentence, ' ' ORDER BY pos) AS s FROM tr_top GROUP BY id),
summ AS (SELECT src.id, coalesce(tr_j.s, substr(coalesce(src.text, ''), 1, 300) || '…') AS summary
         FROM {src} src LEFT JOIN tr_j USING (id))""")
    return ",\n".join(parts)
