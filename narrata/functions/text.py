"""Scalar text functions as built-in Column expressions (no Python UDFs).

Java regex needs ``(?U)`` so that ``\\b``, ``\\w``, ``\\s``, ``\\d`` follow
Unicode classes the way Python's ``re`` does on ``str``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.fixed_values import EXCERPT_WORDS, REDACTED, SUMMARY_FALLBACK_CHARS

WORD_RE = r"(?U)\S+"
TOKEN_RE = r"[\p{L}\p{N}_]+"
ELLIPSIS = "…"

# the cleaning steps, applied in this order after lower-casing
CLEAN_STEPS = [
    (r"(?U)\bx{2,}\b", REDACTED),
    (r"(?U)https?://\S+|www\.\S+", ""),
    # a match always reaches back to its run's start, so it is only tried there,
    # up to the run's first "@" that is not its first character: linear time
    (r"(?U)(?<!\S)\S[^\s@]*+@\S+\.\S+", ""),
    (r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", ""),
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """lower -> redaction runs -> URLs -> e-mails -> phones -> squeeze spaces."""
    t = F.lower(_c(c))
    for pattern, repl in CLEAN_STEPS:
        t = F.regexp_replace(t, pattern, repl)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def words(c) -> Column:
    """Whitespace split (``str.split()``): array of non-space runs."""
    return F.regexp_extract_all(_c(c), F.lit(WORD_RE), 0)


def word_count(c) -> Column:
    return F.regexp_count(_c(c), F.lit(WORD_RE)).cast("int")


def has_min_words(c, n: int) -> Column:
    """``word_count(c) >= n`` without scanning the whole text: an anchored
    match that stops at the start of the n-th word."""
    if n <= 0:
        return F.lit(True)
    return F.coalesce(_c(c).rlike(rf"(?U)^\s*(?:\S+\s+){{{n - 1}}}\S"), F.lit(False))


def has_text(c) -> Column:
    """Non-null and holding at least one non-space character."""
    col = _c(c)
    return col.isNotNull() & col.rlike(r"(?U)\S")


def tokenize(c) -> Column:
    """Lower-cased word tokens (``\\b\\w+\\b``) as an array."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_RE), 0)


def excerpt(c, n: int = EXCERPT_WORDS) -> Column:
    """First ``n`` words joined by spaces, with an ellipsis when longer."""
    w = words(c)
    return F.concat(F.array_join(F.slice(w, 1, n), " "),
                    F.when(F.size(w) > n, F.lit(ELLIPSIS)).otherwise(F.lit("")))


def prefix_fallback(c, n: int = SUMMARY_FALLBACK_CHARS) -> Column:
    """``text[:n] + '…'`` (the summary fallback)."""
    return F.concat(F.substring(_c(c), 1, n), F.lit(ELLIPSIS))


def year_month(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM")


def parse_date(c) -> Column:
    """Coercing date parse: unparsable strings become null (never throw)."""
    col = _c(c)
    return F.coalesce(
        F.try_to_timestamp(col, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(col, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(col, F.lit("MM/dd/yyyy")),
    ).cast("date")


HANGUL = (0xAC00, 0xD7A4)  # syllables: leading, vowel and trailing parts, 21 * 28 a lead
_LEADS = "".join(map(chr, range(0x1100, 0x1113)))
_VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
_TRAILS = "".join(map(chr, range(0x11A8, 0x11C3)))


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str, dict[str, str]]:
    """Accent stripping for every code point, derived from NFKD without its
    combining marks: a 1:1 table (source, target; marks, which vanish, are the
    sources beyond the targets) and the multi-character forms (ligatures,
    fractions ...). Hangul syllables follow a rule instead of a table."""
    src, dst, gone, longer = [], [], [], {}
    for cp in (*range(0xA0, HANGUL[0]), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        ch = chr(cp)
        if unicodedata.combining(ch):
            gone.append(ch)
            continue
        form = unicodedata.normalize("NFKD", ch)
        if form == ch:
            continue
        base = "".join(x for x in form if not unicodedata.combining(x))
        if len(base) == 1 and cp < 0x10000:
            src.append(ch)
            dst.append(base)
        elif base != ch:
            longer[ch] = base
    return "".join(src + gone), "".join(dst), longer


def _char_class(chars) -> str:
    """Regex class of exactly these characters, as ranges."""
    cps = sorted(map(ord, chars))
    runs = []
    for cp in cps:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in runs) + "]"


def _hangul_parts(ch: Column) -> Column:
    """The two or three parts of one Hangul syllable, by arithmetic."""
    at = F.ascii(ch) - HANGUL[0]
    trail = at % 28
    return F.concat(F.substring(F.lit(_LEADS), F.floor(at / 588).cast("int") + 1, F.lit(1)),
                    F.substring(F.lit(_VOWELS), F.floor((at % 588) / 28).cast("int") + 1, F.lit(1)),
                    F.when(trail > 0, F.substring(F.lit(_TRAILS), trail, F.lit(1))).otherwise(F.lit("")))


def strip_accents(c) -> Column:
    """NFKD without combining marks. The distinct characters that change are
    looked up once a text and replaced where they stand; a text without any
    costs one search, plain ASCII text the cheapest one."""
    src, dst, longer = accent_table()
    t = _c(c)
    # one literal that the optimizer folds into a map
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in longer.items())), F.lit("\x02"), F.lit("\x01"))
    beyond = r"[^\x{0}-\x{9f}]"
    # looked at first, so that the many ranges of the class are not tried on ASCII
    changing = f"(?={beyond})" + _char_class([*src, *longer, *map(chr, range(*HANGUL))])

    def form(ch: Column) -> Column:
        return (F.when(ch.between(chr(HANGUL[0]), chr(HANGUL[1] - 1)), _hangul_parts(ch))
                .otherwise(F.coalesce(F.try_element_at(table, F.when(ch.rlike(_char_class(longer)), ch)),
                                      F.translate(ch, src, dst))))

    found = F.array_distinct(F.regexp_extract_all(t, F.lit(changing), F.lit(0)))
    spelt = F.aggregate(found, t, lambda acc, ch: F.replace(acc, ch, form(ch)))
    return F.when(t.rlike(beyond), spelt).otherwise(t)


def plain_accents(t: str) -> str:
    """:func:`strip_accents` of a Python string, for tasks."""
    return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def round6(c) -> Column:
    return F.round(_c(c), 6)
