"""Alignment, repeats, names and clashing columns of the page wrappers."""

import random

from narrata.llm import wrapper_html as wh


def _table(a, b):
    """The same subsequence by the full table."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_common_equals_the_full_table_at_every_size():
    r = random.Random(3)
    for size, runs in ((0, 2), (1, 20), (30, 400), (700, 2)):  # 700 x 700 is beyond the old limit
        for _ in range(runs):
            k = r.choice([2, 5, 40])
            a, b = ([str(r.randrange(k)) for _ in range(r.randint(size // 2, size))] for _ in range(2))
            assert wh.common(a, b) == _table(a, b)


def _labels(items):
    return [(x[0], x[2]) for x in items]


def test_repeats_of_any_length():
    for k in (1, 3, 7, 20):
        once = [[f"div.c{chr(97 + j)}", 1, False, False, []] for j in range(k)]
        many = [list(x) for _ in range(5) for x in once]
        assert _labels(wh.squares(many)) == [(x[0], True) for x in once], k
    mixed = [[t, 1, False, False, []] for t in "abcabd"]
    assert _labels(wh.squares(mixed)) == [(t, False) for t in "abcabd"]  # no run stands twice side by side


def test_names_with_another_meaning():
    for word in ("share", "share-buttons", "ad-slot", "ad", "ad-xl", "comment-list", "cookie-price", "related-posts"):
        assert wh.furniture(f"div.{word}", True), word
    for word in ("share-price", "ad-hoc", "search-theory", "broadcast", "social-policy"):
        assert not wh.furniture(f"div.{word}", True), word


def test_article_text_under_such_names_stays_and_columns_may_clash(spark):
    rows = []
    for k in range(6):
        page = (f'<html><body><nav>Menu {k}</nav><article><h1>Title {k}</h1><p>First {k}.</p>'
                f'<div class="share-price"><p>Price {k}.</p></div><div class="ad-hoc"><p>Case {k}.</p></div>'
                f'<div class="share-buttons">Send {k}</div><div class="ad">Buy {k}</div></article></body></html>')
        rows.append((k, "http://a.example/x", page, f"h{k}", k, "old"))
    rows.append((9, None, None, None, None, None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, at long, text string")
    df = df.selectExpr("*", "page_id AS _row", "'k' AS _keep", "array(1) AS _paths", "_host AS host")
    out = wh.extract(df)
    got = {r["page_id"]: r for r in out.collect()}
    assert set(out.columns) == set(df.columns) - {"html"}
    for k in range(6):
        assert got[k]["text"] == f"Title {k}\nFirst {k}.\nPrice {k}.\nCase {k}."
        assert (got[k]["_host"], got[k]["at"], got[k]["_row"], got[k]["host"], got[k]["_paths"]) == (f"h{k}", k, k, f"h{k}", [1])
    assert got[9]["text"] == ""
