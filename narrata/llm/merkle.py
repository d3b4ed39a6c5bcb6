"""Op 13. Merkle manifest of a dataset by time-forward processing.

Every row is a leaf digest; per group (source) the ordered leaves form a tree
of runs of ``FAN`` nodes, and the groups' roots form one more tree above them.

Nodes are labelled by the moment their last leaf has passed: (last leaf, level).
Children precede their parent in that order. A forward sweep reads nodes by
label and sends each digest to its parent through a priority queue ordered by
label, so a parent's digests arrive together when its time comes. The reversed
sweep runs from the roots down: a node sends its proof suffix to its children,
which put their siblings before it.

The queue is external: a sweep works on one block of ``FAN ** DEPTH`` adjacent
nodes, with a small heap in memory, and messages beyond the block (its top
digest upwards, its top's proof suffix downwards) travel through Spark's sorted
shuffle by block label. A hot group is therefore many blocks; every round
shrinks a group by ``FAN ** DEPTH``, so few rounds suffice at any size. Leaves
are numbered by a range partitioning over (group, order, digest) and prefix
sums of its counts. Only digests move: no text is shuffled.

Defined results: a null field is the one character ``-``, an empty one ``0:``.
Null groups form the first group. Null keys come first; rows with one key are
ordered by digest, equal rows take adjacent places in any order and have equal
digests. Columns named like the results (``leaf``, ``subroot``, ``root``,
``proof``, ``position``) are replaced, other columns are kept. An empty table
has no leaves and gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import BATCH_ROWS, join_keyed, map_arrow, materialise, pack, unpack

FAN = 3
#: levels that one block spans: 3 ** 8 = 6561 nodes
DEPTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before: string, after: string>>"
_OWN = ("leaf", "subroot", "root", "proof", "position")


def leaf_digest(*fields: str | Column) -> Column:
    """Digest of length-prefixed fields, so that no two rows share an input."""
    parts = []
    for f in fields:
        value = (F.col(f) if isinstance(f, str) else f).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def proof_digest(proof: str = "proof") -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    steps = F.transform(F.col(proof), lambda s: F.concat(s["before"], s["after"]))
    return F.sha2(F.array_join(steps, ""), 256)


def fold(leaf: Column, proof: str = "proof") -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.col(proof), leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


# ---- one block, in a task ---------------------------------------------------

def _shape(n: int) -> list[int]:
    """Node counts by level of a block of ``n`` nodes, up to its one top."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def sweep_up(digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digests of all nodes (level, index) above ``digests``, ``levels`` up."""
    n = len(digests)
    nodes: dict[tuple[int, int], str] = {}
    queue: list[tuple[int, int, int, int, str]] = []  # (last leaf, level) of the receiver, its index, slot, digest

    def send(level: int, index: int, digest: str) -> None:
        nodes[level, index] = digest
        if level < levels:
            up = index // FAN
            last = min((up + 1) * FAN ** (level + 1), n) - 1
            heapq.heappush(queue, (last, level + 1, up, index % FAN, digest))

    for i, d in enumerate(digests):
        send(0, i, d)
        while queue and queue[0][0] == i:  # nodes whose time has come, children complete
            _, level, index, _, first = heapq.heappop(queue)
            parts = [first]
            while queue and queue[0][1:3] == (level, index) and queue[0][0] == i:
                parts.append(heapq.heappop(queue)[4])
            send(level, index, sha256("".join(parts).encode()).hexdigest())
    return nodes


def sweep_down(nodes: dict[tuple[int, int], str], n: int, levels: int,
               suffix: tuple[list[str], list[str]]) -> list[tuple[list[str], list[str]]]:
    """Proofs (befores, afters by level, own level first) of the ``n`` leaves of
    a block whose top has the proof ``suffix``, in reversed label order."""
    proofs: list = [None] * n
    queue: list = [(-(n - 1), -levels, 0, suffix)]
    while queue:
        _, level, index, (before, after) = heapq.heappop(queue)
        level = -level
        if not level:
            proofs[index] = (before, after)
            continue
        children = [i for i in range(index * FAN, index * FAN + FAN) if (level - 1, i) in nodes]
        digests = [nodes[level - 1, i] for i in children]
        for slot, i in enumerate(children):
            last = min((i + 1) * FAN ** (level - 1), n) - 1
            heapq.heappush(queue, (-last, 1 - level, i, (["".join(digests[:slot]), *before],
                                                         ["".join(digests[slot + 1:]), *after])))
    return proofs


def _runs(batches: Iterable[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of sorted batches, gathered while their key stays the same: one
    block of at most FAN ** DEPTH nodes and the message for it."""
    run: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
        lo = 0
        while lo < len(keys):
            hi = lo
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            if run and keys[lo] != at:
                yield pa.Table.from_batches(run).combine_chunks()
                run = []
            at = keys[lo]
            run.append(b.slice(lo, hi - lo))
            lo = hi
    if run:
        yield pa.Table.from_batches(run).combine_chunks()


def _levels(total: int, depth: int) -> int:
    """Levels that a block of a group with ``total`` nodes spans: up to the
    group's top, or ``depth`` if there are more nodes than one block holds."""
    return len(_shape(total)) - 1 if total <= FAN ** depth else depth


def _up(batches: Iterable[pa.RecordBatch], depth: int) -> Iterator[dict]:
    out: dict[str, list] = {"g": [], "pos": [], "digest": [], "n": []}
    for run in _runs(batches, ("g", "block")):
        total, digests = run["n"][0].as_py(), run["digest"].to_pylist()
        levels = _levels(total, depth)
        out["g"].append(run["g"][0].as_py())
        out["pos"].append(run["block"][0].as_py())
        out["digest"].append(sweep_up(digests, levels)[levels, 0])
        out["n"].append(-(-total // FAN ** depth))
        if len(out["g"]) >= 4096:
            yield out
            out = {k: [] for k in out}
    yield out


def _down(batches: Iterable[pa.RecordBatch], depth: int) -> Iterator[dict]:
    for run in _runs(batches, ("g", "block")):
        top, nodes_in = run["suffix"][0].as_py(), run.slice(1)  # the message for the block sorts first
        digests = nodes_in["digest"].to_pylist()
        levels = _levels(nodes_in["n"][0].as_py(), depth)
        suffix = ([s["before"] for s in top], [s["after"] for s in top])
        proofs = sweep_down(sweep_up(digests, levels), len(digests), levels, suffix)
        for lo in range(0, len(proofs), BATCH_ROWS):
            part = proofs[lo:lo + BATCH_ROWS]
            ends = [0]
            for before, _ in part:
                ends.append(ends[-1] + len(before))
            steps = pa.StructArray.from_arrays(
                [pa.array([s for b, _ in part for s in b], pa.string()),
                 pa.array([s for _, a in part for s in a], pa.string())], ["before", "after"])
            here = nodes_in.slice(lo, len(part)).combine_chunks()
            yield {**{c: _one(here[c]) for c in ("g", "pos", "digest", "row")},
                   "suffix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)}


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


# ---- rounds, in Spark --------------------------------------------------------

def _numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``n`` (count) within its group, by
    ``order``. A range partitioning deals even one hot group over many tasks."""
    dealt = materialise(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group + order])
                        .withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    of_group = Window.partitionBy(*group)
    offsets = materialise(counts.select(
        *group, "_part", F.sum("_c").over(of_group).alias("n"),
        (F.sum("_c").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before")),
        name + "-counts")
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    placed = join_keyed(dealt.withColumn("_inside", inside), offsets, [*group, "_part"], how="inner")
    return placed.withColumn("pos", (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_before", "_inside", "_part")


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    size = F.lit(FAN ** depth).cast("long")
    return nodes.withColumn("block", (F.col("pos") - F.pmod(F.col("pos"), size)) / size) \
        .withColumn("block", F.col("block").cast("long"))


def _swept(rows: DataFrame, *order: str) -> DataFrame:
    """Blocks dealt by hash, nodes of each in label order."""
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", *order)


def forest(leaves: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """The rounds of the forward sweep. ``leaves``: g long, pos, digest, n. The
    last table holds one node per group: its root."""
    rounds = [leaves]
    rest = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        nodes = _blocks(rounds[-1], depth).select("g", "block", "pos", "digest", "n")
        tops = map_arrow(_swept(nodes, "pos"),
                         "g long, pos long, digest string, n long", partial(_up, depth=depth))
        rounds.append(materialise(tops, "merkle-tops"))
        if rest <= FAN ** depth:
            return rounds
        rest = -(-rest // FAN ** depth)


def proofs(rounds: list[DataFrame], suffixes: DataFrame, row: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """g, pos, digest, suffix (whole proof) and ``row`` (a column of theirs that
    is carried along) of every leaf of the first round. ``suffixes``: g, pos
    (0), suffix of each group's root."""
    got = suffixes
    for k in range(len(rounds) - 2, -1, -1):
        carried = (F.lit(None).cast("int") if k or row is None else row).alias("row")
        rows = _blocks(rounds[k], depth).select("g", "block", "pos", "digest", "n",
                                                F.lit(None).cast(PROOF).alias("suffix"), carried)
        kind = rows.schema["row"].dataType.simpleString()
        message = got.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"),
                             F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("n"), "suffix",
                             F.lit(None).cast(kind).alias("row"))
        got = map_arrow(_swept(rows.union(message), "pos"),
                        f"g long, pos long, digest string, row {kind}, suffix {PROOF}", partial(_down, depth=depth))
    return got


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id",
             depth: int = DEPTH) -> DataFrame:
    """``docs`` without its ``fields`` other than ``group`` and ``key``, with
    ``leaf``, ``position`` in its group, ``subroot``, ``root`` and ``proof``: per
    level from the leaf up, the sibling digests before and after the node."""
    gone = {*fields, *_OWN} - {group, key}
    kept = docs.select(*[c for c in docs.columns if c not in gone], leaf_digest(*fields).alias("leaf"))
    packed = pack(kept, group, key, "leaf").withColumnsRenamed({group: "_group", key: "_key"})
    placed = materialise(_numbered(packed, ["_group"], ["_key", "leaf"], "merkle-leaves"), "merkle-placed")

    # groups get numbers in their order; one row each
    firsts = placed.filter("pos = 0").select("_group").withColumn("_all", F.lit(0))
    groups = materialise(_numbered(firsts, ["_all"], ["_group"], "merkle-groups")
                         .select("_group", F.col("pos").alias("g")), "merkle-group-ids")
    placed = join_keyed(placed, groups, ["_group"], how="inner")
    placed = placed.withColumn("digest", F.col("leaf"))
    rounds = forest(placed, depth)
    subroots = rounds[-1]
    n_groups = groups.count()
    upper = forest(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), "digest",
                                   F.lit(n_groups).cast("long").alias("n")), depth)
    root = upper[-1].select(F.col("digest").alias("root"))  # one row
    none = upper[-1].select("g", "pos", F.array().cast(PROOF).alias("suffix"))
    of_groups = materialise(proofs(upper, none, depth=depth).withColumnRenamed("digest", "subroot"), "merkle-group-proofs")
    tops = of_groups.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "suffix")
    rounds[0] = join_keyed(placed, of_groups.select(F.col("pos").alias("g"), "subroot"), ["g"], how="inner")
    found = proofs(rounds, tops, F.struct("_group", "_key", "subroot", "others"), depth)
    done = found.select(F.col("row._group").alias(group), F.col("row._key").alias(key), F.col("row.others").alias("others"),
                        F.col("digest").alias("leaf"), F.col("pos").alias("position"), F.col("row.subroot").alias("subroot"),
                        F.col("suffix").alias("proof")).crossJoin(F.broadcast(root))  # one row
    return unpack(done, [*[c for c in kept.columns if c != "leaf"], "leaf", "position", "subroot", "root", "proof"])


# ---- the same manifest in SQL --------------------------------------------------

def oracle(levels: int = 20) -> str:
    """DuckDB SQL of the query: ``levels`` rounds of grouping by three, enough
    for 3 ** 20 leaves of a source and as many sources."""
    def field(expr: str) -> str:
        return f"coalesce(octet_length(encode({expr}))::varchar || ':' || {expr}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([field("doc_id::varchar"), field("source"), field("lang"),
                                        field("n_chars::varchar"), field(text)]) + ")"

    ctes = [f"""docs as materialized (
  select doc_id, source, {leaf("text")} as leaf,
    case when {_crc32_sql("doc_id::varchar")} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as handed
  from documents)""",
            """a0 as materialized (select source, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
  leaf as d, count(*) over (partition by source) as n, doc_id, leaf, handed from docs)""",
            "t0 as materialized (select source, pos, d, n from a0)"]

    def climb(t: str, k: int, group: str) -> None:
        """One level up, and what each node meets there as its siblings."""
        ctes.append(f"""{t}{k + 1} as materialized (select {group}, pos // 3 as pos,
  case when any_value(n) > 1 then sha256(string_agg(d, '' order by pos)) else any_value(d) end as d,
  (any_value(n) + 2) // 3 as n from {t}{k} group by {group}, pos // 3)""")
        ctes.append(f"""{t}s{k} as materialized (select x.{group}, x.pos,
  coalesce(string_agg(y.d, '' order by y.pos) filter (y.pos < x.pos), '') as b,
  coalesce(string_agg(y.d, '' order by y.pos) filter (y.pos > x.pos), '') as a, any_value(x.n) > 1 as real
  from {t}{k} x join {t}{k} y on x.{group} is not distinct from y.{group} and x.pos // 3 = y.pos // 3
  group by x.{group}, x.pos)""")

    for k in range(levels):
        climb("t", k, "source")
    ctes.append(f"""u0 as materialized (select 0 as g, row_number() over (order by source nulls first) - 1 as pos, d,
  count(*) over () as n, source from t{levels})""")
    for k in range(levels):
        climb("u", k, "g")
    # climb with the proof and the folded digest, level by level
    ctes.append("p0 as (select doc_id, source, leaf, handed as f, '' as proof, pos from a0)")
    for k in range(levels):
        ctes.append(f"""p{k + 1} as materialized (select p.doc_id, p.source, p.leaf,
  case when s.real then sha256(s.b || p.f || s.a) else p.f end as f, p.proof || s.b || s.a as proof, p.pos // 3 as pos
  from p{k} p join ts{k} s on p.source is not distinct from s.source and p.pos = s.pos)""")
    ctes.append(f"""q0 as materialized (select p.doc_id, p.leaf, u.d as subroot, p.f, p.proof, u.pos
  from p{levels} p join u0 u on p.source is not distinct from u.source)""")
    for k in range(levels):
        ctes.append(f"""q{k + 1} as materialized (select q.doc_id, q.leaf, q.subroot,
  case when s.real then sha256(s.b || q.f || s.a) else q.f end as f, q.proof || s.b || s.a as proof, q.pos // 3 as pos
  from q{k} q join us{k} s on q.pos = s.pos)""")
    return "with " + ",\n".join(ctes) + f"""
select doc_id, leaf, subroot, r.d as root, sha256(proof) as proof_sha256, f as folded_root, f = r.d as verified
from q{levels} cross join u{levels} r"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in plain SQL (reflected polynomial, bit by bit)."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    byte = "xor(acc, x)"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: {step})[1]"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda acc, x: {byte}), 4294967295)"
