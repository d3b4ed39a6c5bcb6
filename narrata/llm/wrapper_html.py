"""Op 4. Main text of web pages through wrappers inferred per host.

A wrapper is a union-free regular expression over the token stream of a host's
pages: tags, text slots, optional groups ``(..)?`` and repeated groups
``(..)+``. Inference folds pages in one by one. A page's stream is cut into
groups at its block tags; adjacent equal groups are squares and become one
repeated group. Wrapper and page are aligned by a longest common subsequence
of their tokens; matched groups are aligned inside, unmatched ones become
optional, text that differs becomes a slot, equal text stays a constant.

Every page takes part: a task folds its pages into one partial wrapper a host
(pages of a known shape only add to the slots' figures), partial wrappers of a
host meet in ``SALTS`` tasks first and in one then, so a host of a third of all
pages sends one small row a task. The wrapper tells where the host's main
region is: the article or main elements or content containers that hold varying
text, or else the region of its varying text. A page is read by aligning its own
stream with those places. Text that stands at the same place on at least
``CONSTANT`` and more than half of the host's distinct pages is template text
and is left out, unless a page has no other text. Menus, adverts, footers and the
like are furniture by tag or name, since their text may vary too; inside the main
region a heading or section is so only by a class or role that the wrapper has on
as many pages (hosts of fewer pages: by the name alone), never by its id.

Blocks: one a block tag, inline tags do not break; character references are
decoded, white space becomes one space, blocks are joined by a line feed.

Defined results: a null or empty html has empty text; a null url is a host of
its own; text outside any tag is a page's region if it has no other; repeated
rows are extracted alike; other columns stay whatever their names, ``text`` is replaced
and ``html`` left out.
"""

from __future__ import annotations

import html
import json
import math
from hashlib import blake2b
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import arrow_spec, join_keyed, map_arrow, materialise

SALTS = 32
CONSTANT = 3  # pages on which the same must stand before it counts as the host's
HOSTS = 400  # partial wrappers a task holds before it emits them

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)(?:((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)|([^<>]*))>|<!--|<[!?][^>]*>""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_RAW = {t: re.compile(rf"</{t}[^<>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "noscript", "template", "iframe", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var".split())
#: an opening tag of the key ends the open tags of its value
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select body article section div main aside nav header footer".split())
_FURNITURE = frozenset("nav header footer aside form head button select dialog menu fieldset title".split())
_WORDS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments "
                   "consent cookie cookies copyright disclaimer discussion footer form gdpr header login masthead menu nav "
                   "navbar navigation newsletter notice notices pagination popup promo related replies reply respond "
                   "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget complementary "
                   "contentinfo search alert modal overlay".split())
#: words with another meaning too: furniture alone or among furniture words and parts of a page
_AMBIGUOUS = frozenset("ad ads alert form menu notice notices related search share sharing skip social".split())
_PARTS = frozenset("area article articles aside bar bars block body bottom box btn button buttons card cards center col column "
                   "container content footer frame group header holder home icon icons image img inner input item items label "
                   "leaderboard left link links list main mobile module more news outer page pages pane panel placeholder "
                   "post posts rail region results right row section side site slot space stories story text this title "
                   "tool tools to top unit video wrap wrapper zone".split())
_MAIN = frozenset("article content entry main post story text body".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z]+")


# ------------------------------------------------------------ token streams

class Group:
    """A block tag and what it holds: text strings and groups, in order."""
    __slots__ = ("label", "items")

    def __init__(self, label: str):
        self.label = label
        self.items: list = []


def _label(tag: str, attrs: str) -> str:
    """Tag with the words of class, id (after ``#``; none of headings) and role;
    ``!`` if hidden."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag
    words, hidden = [], False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "hidden":
            hidden = True
        elif name != "id" or tag not in _HEADINGS:
            words += ["#" * (name == "id") + w for w in re.sub("[0-9]+", "", value).split() if w]
    return tag + "".join("." + w for w in dict.fromkeys(words)) + "!" * hidden


def parse(page: str) -> Group:
    """The page's stream, grouped at block tags; scripts, styles and comments
    are not part of it, inline tags leave their text."""
    root = Group("")
    open_: list[tuple[str, Group]] = [("", root)]
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            items = open_[-1][1].items
            if items and isinstance(items[-1], str):
                items[-1] += s
            else:
                items.append(s)

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(html.unescape(page[at:]))
            break
        text(html.unescape(page[at:m.start()]))
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW and not closing:
            end = _RAW[tag].search(page, at)
            at = n if end is None else end.end()
            continue
        if tag in _INLINE or tag in _RAW:
            continue
        if tag in _VOID:
            if tag == "hr":
                open_[-1][1].items.append(Group("hr"))
            elif tag in ("br", "wbr"):
                text(" " if tag == "br" else "")
            continue
        if closing:
            if any(t == tag for t, _ in open_[1:]):
                while open_.pop()[0] != tag:
                    pass
            continue
        if open_[-1][0] == "p":
            open_.pop()
        if (ends := _ENDS.get(tag)) is not None:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in ends:
                    del open_[k:]
                    break
                if open_[k][0] in _SCOPE:
                    break
        group = Group(_label(tag, m[3] if m[3] is not None else m[4] or ""))
        open_[-1][1].items.append(group)
        if len(open_) < 400:  # deeper groups hang side by side
            open_.append((tag, group))
    return root


# ---------------------------------------------------------------- wrappers
# slot: ["#", pages, characters, checksum of constant text or None]
# group: [label, pages, repeated, optional, items]

def wrapper_of(group: Group) -> list:
    items = []
    for x in group.items:
        if isinstance(x, str):
            t = " ".join(x.split())
            if t:
                items.append(["#", 1, len(t), zlib.crc32(t.encode())])
        else:
            items.append(wrapper_of(x))
    return [group.label, 1, False, False, squares(items)]


def squares(items: list) -> list:
    """Adjacent equal runs of groups, of any length, as repeated groups."""
    out: list = []
    places: dict[str, list[int]] = {}

    def add(x: list) -> None:
        places.setdefault(x[0], []).append(len(out))
        out.append(x)

    def repeat() -> int:
        """Length of the shortest run that stands twice at the end, or 0."""
        n = len(out)
        for p in reversed(places[out[-1][0]][:-1]):
            k = n - 1 - p
            if 2 * k > n:
                break
            if all(out[n - 2 * k + j][0] == out[n - k + j][0] for j in range(k)):
                return k
        return 0

    for x in items:
        add(x)
        while out[-1][0] != "#" and (k := repeat()):
            tail = out[-k:]
            del out[-k:]
            for b in reversed(tail):
                places[b[0]].pop()
            for j, b in enumerate(tail):
                out[j - k] = _merge(out[j - k], b, same_page=True)
                if out[j - k][0] != "#":
                    out[j - k][2] = True
    return out


def _merge(a: list, b: list, same_page: bool = False) -> list:
    if a[0] == "#":
        return ["#", max(a[1], b[1]) if same_page else a[1] + b[1], a[2] + b[2], a[3] if a[3] == b[3] else None]
    return [a[0], max(a[1], b[1]) if same_page else a[1] + b[1], a[2] or b[2], a[3] or b[3],
            align(a[4], b[4], same_page)]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, the first tokens of ``a`` skipped on ties.

    Row i holds, for the tails a[i:] and b[j:], the lengths of their longest common
    subsequences as bits: a zero where one more token of b adds one. A row follows from
    the next by a few operations on whole integers. Every ``step``-th row is kept and
    those between are made again, so a group of 100,000 tokens takes some megabytes."""
    n, m = len(a), len(b)
    full = (1 << m) - 1
    match: dict[str, int] = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << (m - 1 - j)

    def before(row: int, i: int) -> int:
        hit = row & match.get(a[i], 0)
        return (row + hit | row - hit) & full

    step = max(1, math.isqrt(n))
    row, kept = full, {n: full}
    for i in range(n - 1, -1, -1):
        row = before(row, i)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def at(i: int) -> int:
        if i not in rows:
            top = min(n, (i // step + 1) * step)
            r = kept[top]
            rows.clear()
            rows[top] = r
            for k in range(top - 1, i // step * step - 1, -1):
                r = rows[k] = before(r, k)
        return rows[i]

    def length(i: int, j: int) -> int:
        low = (1 << (m - j)) - 1
        return m - j - (at(i) & low).bit_count()

    pairs: list[tuple[int, int]] = []
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif not at(i) >> (m - 1 - j) & 1 or length(i + 1, j) >= length(i, j + 1):
            i += 1
        else:
            j += 1
    return pairs


def align(a: list, b: list, same_page: bool = False) -> list:
    """Both streams under one expression: common tokens merged, others optional."""
    n, m = len(a), len(b)
    la, lb = [x[0] for x in a], [x[0] for x in b]
    pairs: list[tuple[int, int]] = []
    if la == lb:
        pairs = [(i, i) for i in range(n)]
    else:
        pairs = common(la, lb)
    out, i, j = [], 0, 0
    for p, q in [*pairs, (n, m)]:
        for x in [*a[i:p], *b[j:q]]:
            out.append(x if x[0] == "#" else [x[0], x[1], x[2], True, x[4]])
        if p < n:
            out.append(_merge(a[p], b[q], same_page))
        i, j = p + 1, q + 1
    return squares(out) if len(out) > max(n, m) else out


def expression(w: list) -> str:
    """The wrapper as a readable union-free regular expression."""
    if w[0] == "#":
        return "#" if w[3] is None else "text"
    return f"<{w[0]}>{''.join(map(expression, w[4]))}</>" + "+" * w[2] + "?" * w[3]


# ------------------------------------------------------------- main region

def furniture(label: str, inside: bool) -> bool:
    """Menus, headers, sidebars, adverts, forms, comments ... by tag or name.
    A header element inside the main region is its heading."""
    tag, *words = label.rstrip("!").split(".")
    if label.endswith("!") or tag in _FURNITURE and not (inside and tag == "header"):
        return True
    if tag in ("html", "body", "main") or inside and tag in ("p", "h1"):
        return False
    if inside and _headed(label):
        words = [w for w in words if not w.startswith("#")]
    return any(map(_named, words))


def _named(word: str) -> bool:
    """Whether a class, id or role names furniture: ``share``, ``share-buttons`` and
    ``comment-list`` do, ``share-price`` and ``ad-hoc`` don't. Of one or two letters, an
    unknown part says nothing (``ad-xl``)."""
    parts = [p for p in _SPLIT.split(word) if p]
    found = [p for p in parts if p in _WORDS]
    if any(p not in _AMBIGUOUS for p in found):
        return True
    return bool(found) and all(p in _WORDS or p in _PARTS or len(p) < 3 for p in parts)


def _headed(label: str) -> bool:
    """A heading or a section, whose names are often made from its title."""
    tag, *words = label.rstrip("!").split(".")
    return tag in _HEADINGS or tag == "section" or "section" in words


def unsupported(w: list) -> list[str]:
    """Label paths of headings and sections with a furniture name that too few
    of the host's pages have; none if the host itself has too few."""
    most: dict[str, int] = {}

    def walk(x: list, path: str) -> None:
        for y in x[4]:
            if y[0] != "#":
                here = f"{path}>{y[0]}"
                if _headed(y[0]) and not y[0].endswith("!") and furniture(y[0], True):
                    most[here] = max(most.get(here, 0), y[1])
                walk(y, here)

    if w[1] >= CONSTANT:
        walk(w, "")
    return [p for p, n in most.items() if n < CONSTANT or 2 * n <= w[1]]


def plan(w: list) -> list[str]:
    """Label paths of the host's main region, by the whole wrapper."""
    found: dict[str, list[tuple[str, float, float]]] = {"article": [], "main": [], "named": [], "all": []}

    def chars(x: list, least: int = 0) -> float:
        """Without slots whose text is the same on ``least`` pages or more."""
        if x[0] == "#":
            return 0 if least and x[3] is not None and x[1] >= least else x[2]
        return 0 if furniture(x[0], True) else sum(chars(y, least) for y in x[4])

    def walk(x: list, path: str) -> None:
        for y in x[4]:
            if y[0] == "#" or furniture(y[0], False):
                continue
            here = f"{path}>{y[0]}"
            tag, *words = y[0].split(".")
            place = (here, chars(y), chars(y, CONSTANT))
            if tag == "article":
                found["article"].append(place)
                continue
            if tag == "main" or "main" in words or "#main" in words:
                found["main"].append(place)
            elif any(p in _MAIN for v in words for p in _SPLIT.split(v)):
                found["named"].append(place)
            found["all"].append((here, chars(y, 1), 0))
            walk(y, here)

    def named(by: int) -> list[str]:
        for kind in ("article", "main", "named"):
            chosen = list(dict.fromkeys(p[0] for p in found[kind] if p[by] > 0))
            if chosen:
                return [p for p in chosen if not any(p.startswith(q + ">") for q in chosen)]
        return []

    walk(w, "")
    if chosen := named(2):
        return chosen
    # no named place with varying text: the deepest region that holds most of it
    total = max((c for _, c, _ in found["all"]), default=0)
    deep = [p for p, c, _ in found["all"] if c >= 0.7 * total > 0]
    return [max(deep, key=lambda p: p.count(">"))] if deep else named(1)


def block_key(path: str, text: str) -> int:
    """64-bit key of a block at its place."""
    return int.from_bytes(blake2b(f"{path}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1


def block_keys(root: Group) -> list[int]:
    """Keys of the page's distinct blocks, in order."""
    keys: dict[int, None] = {}

    def walk(g: Group, path: str) -> None:
        for x in g.items:
            if isinstance(x, Group):
                walk(x, f"{path}>{x.label}")
            elif t := " ".join(x.split()):
                keys[block_key(path, t)] = None

    walk(root, "")
    return list(keys)


def main_text(root: Group, paths: list[str], constant: frozenset[int] = frozenset(),
              keep: frozenset[str] = frozenset()) -> str:
    """Blocks of the groups that align with the region's places, of the whole
    page without furniture if none does; without ``constant`` blocks (keys)
    unless there are no others. Groups at the ``keep`` paths are no furniture."""
    wanted = set(paths)
    regions: list[tuple[Group, str]] = []

    def seek(g: Group, path: str) -> None:
        for x in g.items:
            if isinstance(x, Group) and not furniture(x.label, False):
                here = f"{path}>{x.label}"
                if here in wanted:
                    regions.append((x, here))
                else:
                    seek(x, here)

    seek(root, "")
    if not regions and (own := plan(wrapper_of(root))) and set(own) != wanted:
        wanted = set(own)
        seek(root, "")
    blocks: list[str] = []
    varying: list[str] = []

    def read(g: Group, path: str) -> None:
        for x in g.items:
            if isinstance(x, str):
                t = " ".join(x.split())
                if t:
                    blocks.append(t)
                    if not constant or block_key(path, t) not in constant:
                        varying.append(t)
            elif not furniture(x.label, True) or f"{path}>{x.label}" in keep:
                read(x, f"{path}>{x.label}")

    for g, path in regions or [(root, "")]:
        read(g, path)
    return "\n".join(varying or blocks)


# ------------------------------------------------------------------- Spark

def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper json) over all pages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, dict[str, list]] = {}

        def emit() -> dict:
            rows = [(h, json.dumps(_fold(list(shapes.values())))) for h, shapes in held.items()]
            held.clear()
            return {"host": [h for h, _ in rows], "wrapper": [w for _, w in rows]}

        for b in batches:
            for h, t in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                w = wrapper_of(parse(t or ""))
                shapes = held.setdefault(h, {})
                key = _shape(w)
                known = shapes.get(key)
                shapes[key] = w if known is None else _merge(known, w)
                if len(shapes) > 64:
                    merged = _fold(list(shapes.values()))
                    shapes.clear()
                    shapes[_shape(merged)] = merged
            if len(held) > HOSTS:
                yield emit()
        if held:
            yield emit()

    spec = "host string, wrapper string"
    schema = arrow_spec(spec)
    parts = map_arrow(pages.select(host_of().alias("host"), "html"), spec, partial)

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.column("wrapper").to_pylist())
        return pa.table({"host": [table.column("host")[0].as_py()],
                         "wrapper": [json.dumps(_fold([json.loads(r) for r in rows]))]}, schema=schema)

    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return salted.groupBy("host", "salt").applyInArrow(combine, spec).groupBy("host").applyInArrow(combine, spec)


def _shape(w: list) -> str:
    return "#" if w[0] == "#" else f"{w[0]}{'+' * w[2]}({','.join(map(_shape, w[4]))})"


def _fold(wrappers: list[list]) -> list:
    out = wrappers[0]
    for w in wrappers[1:]:
        out = _merge(out, w)
    return out


def templates(pages: DataFrame) -> DataFrame:
    """(host, keys): the blocks that at least ``CONSTANT`` and more than half of
    the host's distinct pages have; exact, from counts over all pages."""

    def keyed(batches):
        for b in batches:
            keys = [block_keys(parse(t or "")) for t in b.column("html").to_pylist()]
            # key 0 counts the pages
            yield {"host": b.column("host"), "page": [block_key("", json.dumps(k)) for k in keys],
                   "keys": [[0, *k] for k in keys]}

    own = map_arrow(pages.select(host_of().alias("host"), "html"), "host string, page long, keys array<long>", keyed)
    distinct = own.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    counts = materialise(distinct.select("host", F.explode("keys").alias("key")).groupBy("host", "key")
                         .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONSTANT), "blocks")
    total = counts.filter("key = 0").select("host", F.col("n").alias("total"))
    return join_keyed(counts.filter("key <> 0"), total, ["host"]).filter("2 * n > total") \
        .groupBy("host").agg(F.collect_list("key").alias("_constant"))  # at most two pages' worth of blocks a host


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, any more) with ``text``."""
    keep = [f for f in pages.schema.fields if f.name not in ("text", "html")]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string"])

    def regions(batches):
        for b in batches:
            wrappers = [json.loads(w) for w in b.column("wrapper").to_pylist()]
            yield {"host": b.column("host"), "_paths": [plan(w) for w in wrappers], "_keep": [unsupported(w) for w in wrappers]}

    plans = map_arrow(infer(pages), "host string, _paths array<string>, _keep array<string>", regions)
    plans = materialise(plans.join(templates(pages), "host", "left"), "wrappers")  # one row a host
    plain = [F.col(f"`{f.name}`") for f in pages.schema.fields if f.dataType.typeName() in ("long", "integer", "string")]
    own = pages.select(host_of().alias("host"), F.xxhash64(*plain).alias("at"), "html",
                       F.struct(*[F.col(f"`{f.name}`") for f in keep]).alias("_row"))
    placed = join_keyed(own, plans, ["host"])  # the caller's columns are inside one, so no names clash

    def read(batches):
        for b in batches:
            yield {**{f.name: c for f, c in zip(keep, b.column("_row").flatten(), strict=True)},
                   "text": [main_text(parse(t or ""), p or [], frozenset(c or ()), frozenset(k or ())) for t, p, c, k in
                            zip(*(b.column(x).to_pylist() for x in ("html", "_paths", "_constant", "_keep")), strict=True)]}

    return map_arrow(placed, ddl, read)
