"""Op 11. URL filtering by rules and link-graph propagation over hosts.

A url is judged by the longest rule that fits it. Where no rule fits, its host
is judged by two personalised PageRanks over host edges: trust starts at hosts
with allowed urls and follows links; distrust starts at hosts with blocked urls
and goes against them, to the hosts that link there. A host is blocked where
its distrust exceeds its trust and ``share`` times what an average host has.

Host edges: the hyperlinks of the pages (``a`` and ``area`` outside comments,
scripts and styles; relative ones resolve to the page's or its ``base``'s host,
links of a host to itself say nothing and go), weighted by linking pages; and
one link each way between a host and its parent domain of two labels or more.
A host's weights are shares of what leaves it. Seeds weigh by the share of a
host's urls that rules allow or block. Mass that reaches a host without links
is not dealt again, which scales all ranks alike; the ranks of the hosts that
have urls are scaled to sum 1.

Built-in functions only. Pages are reduced to (host, host, count) before any
exchange but one; ranks are joined by broadcast if the checked number of hosts
allows it, else on (host, salt), so that a hub's links meet many tasks. Every
``EVERY`` rounds the ranks are written as a table of the shared folder.

Defined results: a null url or one without ``://`` has an empty host and path,
takes no part in the graph and is allowed unless a rule fits; null html has no
links; character references inside links are not decoded; repeated rows count as
often as they occur; without allowed (or blocked) urls the trust (or distrust)
is 0 everywhere. Result columns of the caller (``host``, ``path``, ``rule``,
``verdict``, ``trust``, ``distrust``) are replaced, all others are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import BROADCAST_ROWS, is_small, join_keyed, materialise, pack, unpack

#: (host, path, verdict): fixed by the contract
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
ROUNDS = 32
EVERY = 8
SHARE = 1.0
SALTS = 16
_OWN = ("host", "path", "rule", "verdict", "trust", "distrust")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script[ \t\r\n\f]*>|\z)|<style\b.*?(?:</style[ \t\r\n\f]*>|\z)"
_VALUE = r"[ \t\r\n\f]*=[ \t\r\n\f]*(\"[^\"]*\"|'[^']*'|[^ \t\r\n\f\"'>]+)"
LINK = r"(?is)<(?:a|area)(?:[ \t\r\n\f][^>]*?)?[ \t\r\n\f]href" + _VALUE
BASE = r"(?is)<base(?:[ \t\r\n\f][^>]*?)?[ \t\r\n\f]href" + _VALUE
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: a link that names its host: with a scheme, or from two slashes on
ABSOLUTE = r"(?s)^[\"' \t\r\n\f]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\"' \t\r\n\f]*)"


def _fold(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    return _fold(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Of equally
    long ones the one with the longer host."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_hosts(html: Column, own: Column) -> Column:
    """The distinct hosts, other than ``own``, that a page links to."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    base = _fold(F.regexp_extract(F.regexp_extract(seen, BASE, 1), ABSOLUTE, 1))
    relative = F.when(base != "", base).otherwise(own)
    hosts = F.transform(F.regexp_extract_all(seen, F.lit(LINK), F.lit(1)),
                        lambda x: F.when(x.rlike(ABSOLUTE), _fold(F.regexp_extract(x, ABSOLUTE, 1))).otherwise(relative))
    return F.array_distinct(F.filter(hosts, lambda h: (h != own) & (h != "")))


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: hyperlinks between hosts by linking pages, and a link each way
    between a host and its parent domain. ``pages``: host, html."""
    own = pages.filter("host != ''")
    links = own.select(F.col("host").alias("src"), F.explode(link_hosts(F.col("html"), F.col("host"))).alias("dst")) \
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    links = materialise(links, "host-links")
    hosts = own.select("host").union(links.select("dst")).distinct()
    named = hosts.filter(~F.col("host").rlike(r"^[0-9.:]+$")).select(F.split("host", r"\.").alias("labels"))
    # every suffix of two labels or more, with the next longer one below it
    pairs = named.filter(F.size("labels") > 2).select("labels", F.explode(F.sequence(F.lit(2), F.size("labels") - 1)).alias("k"))
    suffix = lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")
    chain = pairs.select(suffix(F.col("k") + 1).alias("child"), suffix(F.col("k")).alias("parent")).distinct()
    both = chain.select(F.col("child").alias("src"), F.col("parent").alias("dst")) \
        .union(chain.select("parent", "child")).withColumn("n", F.lit(1).cast("long"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
              salts: int = SALTS) -> DataFrame:
    """kind (0 trust, 1 distrust), host, rank. ``links``: src, dst, n; ``seeds``:
    kind, host, seed (sum 1 by kind)."""
    ways = links.select(F.lit(0).alias("kind"), "src", "dst", "n") \
        .union(links.select(F.lit(1), F.col("dst"), F.col("src"), "n"))
    leaving = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = materialise(ways.join(leaving, ["kind", "src"])  # AQE splits a hub's links
                        .select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("w")), "host-edges")
    small = is_small(edges.select("kind", "host").distinct(), BROADCAST_ROWS) and is_small(seeds, BROADCAST_ROWS)
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int"))
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    for i in range(1, rounds + 1):
        if small:  # ranks are kept for hosts of the edges and seeds only
            moved = edges.join(F.broadcast(ranks), ["kind", "host"])
        else:
            spread = ranks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            moved = salted.join(spread, ["kind", "host", "salt"])
        ranks = moved.select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("w")).alias("rank")) \
            .union(seeds.select("kind", "host", (1 - F.lit(damping)) * F.col("seed"))) \
            .groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % EVERY == 0 or i == rounds:
            ranks = materialise(ranks, "host-ranks")
    return ranks


def judge(pages: DataFrame, rules=RULES, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``pages`` without html, with host, path, rule (null: none fits), trust and
    distrust (nine places) of the host, and verdict. ``pages``: url, html."""
    kept = pages.select(*[c for c in pages.columns if c not in _OWN])
    ruled = kept.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url"))) \
        .withColumn("_hit", longest_rule(F.col("host"), F.col("path"), rules))
    counted = ruled.filter("host != ''").groupBy("host").agg(
        F.avg((F.col("_hit.verdict") == "allow").cast("double")).alias("_a"),
        F.avg((F.col("_hit.verdict") == "block").cast("double")).alias("_b"),
        F.count(F.lit(1)).alias("_n"), F.count("_hit").alias("_ruled"))
    # an average over ruled urls only becomes a share of all urls of the host
    shares = materialise(counted.select(
        "host", F.coalesce(F.col("_a") * F.col("_ruled") / F.col("_n"), F.lit(0.0)).alias("a"),
        F.coalesce(F.col("_b") * F.col("_ruled") / F.col("_n"), F.lit(0.0)).alias("b")), "host-shares")
    sums = shares.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))  # one row
    both = shares.crossJoin(F.broadcast(sums))
    seeds = materialise(reduce(DataFrame.union, [
        both.filter(f"{c} > 0").select(F.lit(k).alias("kind"), "host", (F.col(c) / F.col(f"all_{c}")).alias("seed"))
        for k, c in enumerate("ab")]), "host-seeds")
    links = materialise(host_links(ruled.select("host", "html")), "host-graph")
    n_hosts = shares.count()
    ranks = propagate(links, seeds, rounds=rounds).join(shares.select("host"), "host")
    totals = ranks.groupBy("kind").agg(F.sum("rank").alias("total"))  # two rows
    ranks = ranks.join(F.broadcast(totals), "kind").withColumn("rank", F.col("rank") / F.col("total"))
    of = lambda k: F.round(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)), 9)
    hosts = materialise(ranks.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust")), "host-scores")
    rest = [c for c in kept.columns if c != "html"]
    packed = pack(ruled.select(*rest, "host", "path", "_hit"), "host", "path", "_hit")
    scored = join_keyed(packed, hosts, ["host"]) \
        .withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    blocked = (F.col("distrust") > F.col("trust")) & (F.round(F.col("distrust") * n_hosts, 6) > share)
    done = scored.withColumn("rule", F.col("_hit.rule")).withColumn("verdict", F.coalesce(
        F.col("_hit.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))))
    return unpack(done, [*rest, "host", "path", "rule", "verdict", "trust", "distrust"])


# ---- the same in SQL ---------------------------------------------------------

def oracle(rules=RULES, share: float = SHARE, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """DuckDB SQL of the query."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))

    def case(give) -> str:
        return "case " + " ".join(
            f"when (host = {q(h)} or ends_with(host, {q('.' + h)})) and starts_with(path, {q(p)}) then {q(give(h, p, v))}"
            for h, p, v in ordered) + " end"

    def az(expr: str) -> str:
        return f"translate({expr}, {q(_UPPER)}, {q(_LOWER)})"

    return f"""with recursive seen as materialized (
  select page_id, {az(f"regexp_extract(coalesce(url, ''), {q(HOST)}, 1)")} as host,
    regexp_extract(coalesce(url, ''), {q(PATH)}, 1) as path, regexp_replace(coalesce(html, ''), {q(HIDDEN)}, '', 'g') as html from pages),
ruled as materialized (select *, {case(lambda h, p, v: h + p)} as rule, {case(lambda h, p, v: v)} as fixed from seen),
shares as materialized (select host, avg(case when fixed = 'allow' then 1.0::double else 0 end) as a,
  avg(case when fixed = 'block' then 1.0::double else 0 end) as b from ruled where host <> '' group by host),
seeds as materialized (select 0 as kind, host, a / sum(a) over () as seed from shares where a > 0
  union all select 1, host, b / sum(b) over () from shares where b > 0),
pages_links as (select host, {az(f"regexp_extract(regexp_extract(html, {q(BASE)}, 1), {q(ABSOLUTE)}, 1)")} as base,
  regexp_extract_all(html, {q(LINK)}, 1) as links from ruled where host <> ''),
targets as (select host as src, list_distinct(list_transform(links, lambda x: case when regexp_matches(x, {q(ABSOLUTE)})
  then {az(f"regexp_extract(x, {q(ABSOLUTE)}, 1)")} when base <> '' then base else host end)) as hosts from pages_links),
hyper as materialized (select src, dst, count(*) as n from (select src, unnest(hosts) as dst from targets)
  where dst <> src and dst <> '' group by all),
named as (select host, string_split(host, '.') as labels from (select host from shares union select dst from hyper)
  where not regexp_matches(host, '^[0-9.:]+$')),
chain as materialized (select distinct array_to_string(labels[len(labels) - k:], '.') as child,
  array_to_string(labels[len(labels) - k + 1:], '.') as parent
  from (select labels, unnest(range(2, len(labels))) as k from named where len(labels) > 2)),
links as materialized (select src, dst, sum(n) as n from (select src, dst, n from hyper
  union all select child, parent, 1 from chain union all select parent, child, 1 from chain) group by all),
ways as (select 0 as kind, src, dst, n from links union all select 1, dst, src, n from links),
edges as materialized (select kind, src, dst, n / sum(n) over (partition by kind, src) as w from ways),
nodes as (select count(*) as n from shares),
walk as (select 0 as round, kind, host, seed as rank from seeds
  union all
  select round + 1, kind, host, sum(rank) from (
    select w.round, w.kind, e.dst as host, {damping}::double * w.rank * e.w as rank
    from walk w join edges e on w.kind = e.kind and w.host = e.src where w.round < {rounds}
    union all
    select r.round, s.kind, s.host, (1 - {damping}::double) * s.seed
    from (select distinct round, kind from walk where round < {rounds}) r join seeds s on s.kind = r.kind) group by round, kind, host),
ranks as (select kind, host, rank / sum(rank) over (partition by kind) as rank
  from walk where round = {rounds} and host in (select host from shares)),
scores as materialized (select host, round(coalesce(max(case when kind = 0 then rank end), 0), 9) as trust,
  round(coalesce(max(case when kind = 1 then rank end), 0), 9) as distrust from ranks group by host)
select p.page_id, p.host, p.path, p.rule, coalesce(s.trust, 0) as trust, coalesce(s.distrust, 0) as distrust,
  coalesce(p.fixed, case when coalesce(s.distrust, 0) > coalesce(s.trust, 0)
    and round(coalesce(s.distrust, 0) * n.n, 6) > {share} then 'block' else 'allow' end) as verdict
from ruled p left join scores s on p.host = s.host cross join nodes n"""
