"""Op 3. Personal data: base patterns and bootstrapped contextual extraction.

Base spans come from four fixed expressions with validity tests. The method
adds identifiers the expressions miss (a phone number without its plus sign, an
address written with "(at)", a card number with a typing error): loosely shaped
candidates are read as such only in contexts that introduce base spans.

Bootstrapping is a pattern-instance graph scored by Spark. Base spans are seed
instances. The words around a span are its lexical patterns (left word, two
left words, left and right word). In each of ``ROUNDS`` rounds

    confidence(pattern, kind) = sum of its instances' scores for the kind
                                / (all its distinct instances + DAMPING)
    score(candidate, kind)    = 1 - product of (1 - confidence) over its
                                patterns that are supported by SUPPORT seeds

and candidates of score ``ACCEPT`` in an occurrence with a pattern of that
confidence become spans. Counting distinct instances keeps thousands of copies
of one document from making a pattern.

One pass over the texts finds spans and candidates; everything after works on
the small occurrence table, by partially aggregated groups and joins (a common
pattern is a hot join key, which adaptive skew joins split). Nothing is
broadcast or collected by this module.

Defined results: a null or empty text has no spans; spans count code points;
texts are read whole, in time linear in their length; repeated rows each get
their spans; other columns stay, columns named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import map_arrow, materialise

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 8
ACCEPT = 0.85
DAMPING = 1.0

# fixed base expressions, in forms that never rescan a run; the e-mail's local
# part is the run before each "@"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
# loose shapes of candidates, by kind
_LOOSE = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?(?:@|[(\[]at[)\]])\s?[\w-]{1,64}(?:\s?(?:\.|[(\[]dot[)\]])\s?[\w-]{1,64})*", re.IGNORECASE)),
    ("ip", re.compile(r"(?<![0-9a-fA-F.:])(?:[0-9]{1,3}(?:[.,:][0-9]{1,3}){3,7}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7})(?![0-9a-fA-F])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9])")),
)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, in order."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loosely shaped spans that touch no base span; the first kind whose
    shape fits a place has it."""
    taken = [(s, e) for s, _, e in base]
    out = []
    for name, shape in _LOOSE:
        k, n = KINDS.index(name), 0
        taken.sort()
        fresh = []
        for m in shape.finditer(text):
            while n < len(taken) and taken[n][1] <= m.start():
                n += 1
            if n < len(taken) and taken[n][0] < m.end():
                continue
            fresh.append((m.start(), k, m.end()))
        out += fresh
        taken += [(s, e) for s, _, e in fresh]
    return sorted(out)


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: words around it, lower case, digits as 0."""
    left = [_DIGIT.sub("0", w.lower()) for w in text[max(0, start - 96):start].split()[-2:]]
    right = [_DIGIT.sub("0", w.lower()) for w in text[end:end + 48].split()[:1]]
    one = left[-1] if left else "^"
    two = " ".join(left) if len(left) == 2 else "^ " + one
    return [f"l {one}", f"ll {two}", f"lr {one} _ {right[0] if right else '$'}"]


_FOUND = ("row_id long, base array<struct<kind:int,start:int,stop:int>>, "
          "places array<struct<kind:int,seed:boolean,start:int,stop:int,instance:string,patterns:array<string>>>")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with row_id, ``base`` spans and ``places`` (base spans and
    candidates with their patterns)."""
    keep = [f for f in docs.schema.fields if f.name not in ("row_id", "base", "places")]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), _FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            base, places = [], []
            for t in b.column("text").to_pylist():
                spans, around = [], []
                if t and _ANY.search(t):
                    spans = base_spans(t)
                    for seed, group in ((True, spans), (False, candidates(t, spans))):
                        around += [{"kind": k, "seed": seed, "start": s, "stop": e,
                                    "instance": " ".join(t[s:e].lower().split()), "patterns": patterns(t, s, e)}
                                   for s, k, e in group]
                base.append([{"kind": k, "start": s, "stop": e} for s, k, e in spans])
                places.append(around)
            yield {**{f.name: b.column(f.name) for f in keep},
                   "row_id": pa.array(range(row, row + len(base)), type=pa.int64()), "base": base, "places": places}
            row += len(base)

    return map_arrow(docs.select(*[f.name for f in keep]), ddl, run)


def bootstrap(places: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, instance, confidence, score) of accepted candidates.
    ``places``: pattern, kind, instance, seed, one row per distinct edge."""
    edges = materialise(places.distinct(), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count_distinct("kind", "instance").alias("n"))
    seeds = edges.filter("seed").groupBy("pattern", "kind").agg(F.count("*").alias("support"))
    strong = materialise(seeds.filter(F.col("support") >= SUPPORT).join(size, "pattern"), "pii-patterns")
    loose = edges.filter("not seed").select("pattern", "kind", "instance")
    scores = None
    for _ in range(rounds):
        if scores is None:
            mass = strong.select("pattern", "kind", F.lit(0.0).alias("more"))
        else:
            mass = loose.join(scores, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
        rated = strong.join(mass, ["pattern", "kind"], "left").select(
            "pattern", "kind", F.least(F.lit(1.0), (F.col("support") + F.coalesce("more", F.lit(0.0)))
                                       / (F.col("n") + F.lit(DAMPING))).alias("confidence"))
        reached = loose.join(rated.filter("confidence > 0.5"), ["pattern", "kind"])
        scores = materialise(reached.groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score")), "pii-scores")
    return reached.join(scores, ["kind", "instance"]) \
        .filter((F.col("confidence") >= ACCEPT) & (F.col("score") >= ACCEPT)) \
        .select("pattern", "kind", "instance", "confidence", "score")


def extract(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (kind, start, stop).
    Without ``with_text`` the text is dropped once it has been read."""
    own = ("base", "added", "row_id", "places")
    found = find(docs.select(*[c for c in docs.columns if c not in own]))
    found = materialise(found if with_text else found.drop("text"), "pii-found")
    place = found.select("row_id", F.explode("places").alias("p")).select("row_id", "p.*") \
        .withColumn("pattern", F.explode("patterns")).drop("patterns")
    good = bootstrap(place.select("pattern", "kind", "instance", "seed"))
    added = place.filter("not seed").join(good.select("pattern", "kind", "instance").distinct(),
                                          ["pattern", "kind", "instance"], "left_semi") \
        .groupBy("row_id").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
    return found.drop("places").join(added, "row_id", "left") \
        .withColumn("added", F.coalesce("added", F.array().cast(found.schema["base"].dataType))).drop("row_id")


def is_kind(k: int):
    return lambda s: s["kind"] == k


def spans_text(spans) -> F.Column:
    """kind:start:end, by start then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["kind"].alias("k"), s["stop"].alias("e"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def mask(found: DataFrame) -> DataFrame:
    """``found`` (of :func:`extract`) with its spans in ``text`` replaced by
    ``<KIND>``; overlapping spans are replaced together under the first kind."""
    keep = [f for f in found.schema.fields if f.name not in ("base", "added")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def hide(text: str | None, spans: list[dict]) -> str | None:
        if text is None or not spans:
            return text
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
            if s["start"] >= at:
                out += [text[at:s["start"]], f"<{KINDS[s['kind']].upper()}>"]
            at = max(at, s["stop"])
        return "".join([*out, text[at:]])

    def run(batches):
        for b in batches:
            texts = [hide(t, [*x, *y]) for t, x, y in zip(
                b.column("text").to_pylist(), b.column("base").to_pylist(), b.column("added").to_pylist(), strict=True)]
            yield {**{f.name: b.column(f.name) for f in keep}, "text": texts}

    return map_arrow(found, ddl, run)
