"""Ops 11 to 13: brute force, SQL twins, awkward input (nulls, empty and long
texts, ties, repeated rows, empty tables, clashing columns)."""

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from narrata.llm import link_trust, merkle, queries, runs
from tests.conftest import SF001

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, runs string, `_bytes` int, others string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- runs ---------------------------------------------------------------------

def brute_runs(w, least=12):
    """Every maximal repetition by comparing words q apart, smallest q first."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, 2 * q):
                best.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def repetitive(r):
    w = [f"w{r.randrange(r.choice([1, 2, 3, 40]))}" for _ in range(r.randrange(90))]
    if w and r.random() < .6:
        a, p = r.randrange(len(w)), r.randrange(1, 12)
        w = [x if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_brute_force(least):
    r = random.Random(least)
    for _ in range(700):
        w = repetitive(r)
        b = [x.encode() for x in w]
        hashes = runs.np.fromiter(map(hash, b), runs.np.int64, len(b)).view(runs.np.uint64)
        seen = runs.covered(hashes, runs.np.zeros(len(b), dtype=int), max(1, least // 2))
        assert [tuple(x) for x in runs.text_runs(b, seen, least).tolist()] == brute_runs(w, least)


def test_extensions_over_many_blocks():
    r = random.Random(3)
    s = [1 + r.randrange(2) for _ in range(2500)]
    e = runs.Extensions([*s, 0])
    i = runs.np.array([r.randrange(2500) for _ in range(4000)])
    j = runs.np.array([r.randrange(2501) for _ in range(4000)])
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i.tolist(), j.tolist(), e.lce(i, j).tolist(), strict=True):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert got == n


def awkward():
    r = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a b " * 50, "a b " * 50, "é\x00z " * 20, "x" * 30_000, "lo rem ip sum " * 4000]
    texts += [" ".join(repetitive(r)) for _ in range(60)]
    ids = [None, *range(1, len(texts))]
    ids[5] = ids[4]
    return [(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "l", "r", 1, "o")
            for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


def test_find_runs(spark):
    docs = spark.createDataFrame(awkward(), DOCS).repartition(4)
    got = runs.find(docs).collect()
    assert len(got) == len(awkward())
    assert {"_bytes", "others", "text"} <= set(got[0].asDict())
    for row in got:
        w = (row.text or "").encode().split()
        want = brute_runs(w)
        assert [(x.start, x.length, x.period) for x in row.runs] == want and row.n_words == len(w)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert row.collapsed == b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert row["_bytes"] == 1
    assert runs.find(docs.limit(0)).count() == 0


def test_op12_digests(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF001).collect()}
    table = duckdb.sql(f"select doc_id, text from '{SF001}/documents.parquet'").fetchall()
    assert len(got) == len(table)
    seen = 0
    for i, text in table:
        w = (text or "").encode().split()
        if len(w) > 3000:
            continue
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        want = brute_runs(w)
        gone = {k for s, m, q in want for k in range(s + q, s + m)}
        row = got[i]
        assert row.n_runs == len(want)
        assert row.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in want))
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
        if want:
            seen += 1
            s, m, q = min(want, key=lambda x: (-x[1], x[0], x[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert row.start is row.length is row.period is row.exponent_milli is None
    assert seen > 5


# ---- Merkle manifest -----------------------------------------------------------

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(level):
    """Root and proofs (lists of siblings by level) of a list of digests."""
    paths, of = [[] for _ in level], [[k] for k in range(len(level))]
    while len(level) > 1:
        up, owners = [], []
        for lo in range(0, len(level), 3):
            run = level[lo:lo + 3]
            for k in range(len(run)):
                for leaf in of[lo + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            owners.append([x for k in range(len(run)) for x in of[lo + k]])
        level, of = up, owners
    return level[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        leaf = sha(field(r["doc_id"]) + field(r["source"]) + field(r["lang"]) + field(r["n_chars"]) + field(r["text"]))
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s])]) for s in names]
    root, above = climb([t[0] for t in trees])
    return root, {(s, leaf, k): (trees[g][0], trees[g][1][k] + above[g])
                  for g, s in enumerate(names) for k, (_, _, leaf) in enumerate(sorted(groups[s]))}


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_manifest_matches_brute_force(spark, depth):
    rows = [{"doc_id": i, "text": t, "lang": lang, "source": s, "n_chars": n} for i, t, lang, s, n, *_ in awkward()]
    rows += [{"doc_id": 500 + k, "text": f"t{k}\n", "lang": None, "source": "hot", "n_chars": k} for k in range(83)]
    rows += [{"doc_id": 9, "text": "", "lang": "en", "source": "alone", "n_chars": None}]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("others", F.lit("o")).withColumn("g", F.lit(7)) \
        .withColumn("leaf", F.lit("old")).repartition(5)
    root, want = expected(rows)
    got = merkle.manifest(docs, depth=depth).withColumn("folded", merkle.fold(F.col("leaf"))).collect()
    assert len(got) == len(rows)
    for r in got:
        subroot, path = want[r.source, r.leaf, r.position]
        assert (r.root, r.folded, r.subroot) == (root, root, subroot)
        assert [(s.before, s.after) for s in r.proof] == path
        assert (r.others, r.g) == ("o", 7)


def test_manifest_of_nothing_and_of_one(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None,) * 5], schema)).collect()
    assert [(r.leaf, r.subroot, r.root, r.proof) for r in one] == [(sha("-----"),) * 3 + ([],)]


# ---- link trust ----------------------------------------------------------------

def page(i, url, *links, extra=""):
    return (i, url, extra + "".join(f'<p><a class="x" href="{x}">l</a></p>' for x in links), "h", "v")


def test_links_carry_trust_and_distrust(spark):
    rules = (("good.org", "/", "allow"), ("bad.org", "/", "block"))
    rows = [page(1, "https://GOOD.org/a", "http://ok.net/x", "//ok.net/y", "/own"),
            page(2, "https://bad.org/", "http://innocent.net/"),
            page(3, "https://feeder.net/p?q", "https://bad.org/buy", "http://BAD.org/2"),
            page(4, "https://ok.net/", "https://good.org/"),
            page(5, "https://innocent.net/", extra='<!-- <a href="http://bad.org/"> --><script>"<a href=http://bad.org/>"</script>'),
            page(6, "https://based.net/", "deep/link", extra='<base href="https://bad.org/dir/">'),
            page(7, None), page(8, "no scheme"), (9, "https://empty.net", None, "h", "v"), page(9, "https://x.good.org/z#f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, others string").repartition(3)
    got = {(r.page_id, r.url): r for r in link_trust.judge(pages, rules).collect()}
    assert len(got) == len(rows)
    verdict = {k[0]: r.verdict for k, r in got.items() if k[1] != "https://empty.net"}
    assert verdict == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow"}
    assert got[(9, "https://x.good.org/z#f")].rule == "good.org/" and got[(9, "https://x.good.org/z#f")].path == "/z"
    assert got[(7, None)].host == "" and got[(9, "https://empty.net")].path == ""
    assert got[(4, "https://ok.net/")].trust > 0 and got[(5, "https://innocent.net/")].distrust == 0
    assert got[(1, "https://GOOD.org/a")].others == "v"
    assert link_trust.judge(pages.limit(0), rules).count() == 0


def test_salted_ranks_equal_broadcast_ranks(spark, monkeypatch):
    links = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "a", 3)], "src string, dst string, n long")
    seeds = spark.createDataFrame([(0, "a", 1.0), (1, "c", 1.0)], "kind int, host string, seed double")
    ranks = lambda: {(r.kind, r.host): round(r["rank"], 12) for r in link_trust.propagate(links, seeds, rounds=6).collect()}
    want = ranks()
    monkeypatch.setattr(link_trust, "BROADCAST_ROWS", 1)
    assert ranks() == want


@pytest.mark.parametrize("name", ["op11_link_trust", "op13_merkle_manifest"])
def test_sql_twins(spark, name):
    got = queries.QUERIES[name](spark, SF001).toPandas()
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    want = db.sql(queries.ORACLE[name]).df()
    cols = sorted(got.columns)
    sort = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)
