"""Scalar functions over texts, addresses, names and times, as Catalyst expressions.

Patterns are written for Java with explicit classes, so that they do not
depend on what a Java version means by \\s or \\b.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

LF = "\n"
# fixed values: characters folded before matching, and what they become
FOLD_FROM = "\u2018\u2019\u201a\u201b\u2032\u201c\u201d\u201e\u2033\u2013\u2014\u2212\u00a0"
FOLD_TO = "'''''\"\"\"\"--- "
# fixed values: characters without width
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
NBSP = "\u00a0"
# fixed values: what ends a line besides the line feed in a normalised text
LINE_ENDS = "\x1c\x1d\x1e\x85\u2028\u2029"


def slug(name: Column) -> Column:
    """A name fit for files: runs of other characters than letters, digits and - become _, trimmed at both ends."""
    return F.btrim(F.regexp_replace(name, r"[^a-zA-Z0-9\-]+", "_"), F.lit("_"))


def host(url: Column) -> Column:
    """The host in lower case, without port or user; '' if there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def plain_host(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def is_safe_url(url: Column) -> Column:
    """http or https, with a host."""
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    return scheme.isin("http", "https") & (host(url) != "")


# fixed values: what folds to several letters, as far as ``fold`` knows it: the sharp s and the Latin ligatures
SEVERAL = "ßﬀﬁﬂﬃﬄﬅﬆ"


@cache
def one_to_one() -> dict[str, str]:
    """What case folding makes of characters that are lower case already, where that is one character."""
    return {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c == c.lower() != c.casefold() and len(c.casefold()) == 1}


def fold(text: Column) -> Column:
    """For matching alone: typographic quotes and dashes made plain, case folded.

    Of the letters that fold to several, those of ``SEVERAL`` do; composed
    Greek, Armenian and a few Latin letters beyond them stay as they are.
    """
    ones = one_to_one()
    t = F.translate(F.lower(text), FOLD_FROM + "".join(ones), FOLD_TO + "".join(ones.values()))
    for c in SEVERAL:
        t = F.replace(t, F.lit(c), F.lit(c.casefold()))
    return t


@cache
def folded_into() -> frozenset[str]:
    """The characters that ``fold`` makes of others, apart from small letters of capitals."""
    return frozenset(FOLD_TO + "".join(one_to_one().values()) + "".join(c.casefold() for c in SEVERAL))


def anchor(text: str) -> str:
    """The longest run of ASCII letters, in lower case, that ``fold`` makes of nothing but themselves and their capitals: a text that holds ``text`` when both are folded holds this in lower case."""
    return max(("".join(c if c.isascii() and c not in folded_into() else LF for c in map(str.lower, text))).split(LF), key=len)


def squeeze(text: Column, noise: Column | None = None) -> Column:
    """The native part of normalising: line ends, blanks, zero-width characters, noise lines, runs of blank lines.

    Equal to ``functions.udfs.normalise`` for texts in NFC without HTML
    entities whose white space is ASCII or U+00A0. ``noise``: the text with
    such lines already removed, if any are to be.
    """
    t = clean(text) if noise is None else noise
    t = where_held(t, ("  ", "\t", "\f", "\x0b"), lambda x: F.regexp_replace(x, r"[ \t\f\x0B]+", " "))
    t = where_held(t, (" " + LF, LF + " "), lambda x: F.regexp_replace(x, r" ?\n ?", LF))
    t = where_held(t, (LF * 3,), lambda x: F.regexp_replace(x, r"\n{3,}", LF * 2))
    return F.btrim(t, F.lit(" " + LF))


def given(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def where_held(text: Column, parts: Sequence[str], f: Callable[[Column], Column]) -> Column:
    """``f`` of texts that hold any of ``parts``, found by plain search; the others stay as they are. ``f`` must change no other text."""
    return given(text, lambda x: F.when(reduce(or_, (F.contains(x, F.lit(p)) for p in parts)), f(x)).otherwise(x))


def clean(text: Column) -> Column:
    """The first part of ``squeeze``, before noise is removed; null is empty."""

    def plain(t: Column) -> Column:
        t = F.replace(F.replace(t, F.lit("\r\n"), F.lit(LF)), F.lit("\r"), F.lit(LF))
        return F.translate(F.replace(t, F.lit(NBSP), F.lit(" ")), ZERO_WIDTH, "")

    return where_held(F.coalesce(text, F.lit("")), ("\r", NBSP, *ZERO_WIDTH), plain)


def without_noise(text: Column, host_: Column, everywhere: Sequence[str], by_host: Mapping[str, Sequence[str]]) -> Column:
    """``text`` without what the patterns match, those for all hosts first. One CASE over the hosts that have patterns."""

    def strip(t: Column, patterns: Sequence[str]) -> Column:
        for p in patterns:
            t = F.regexp_replace(t, f"(?m){p}", "")
        return t

    out = strip(text, everywhere)
    for name, patterns in by_host.items():
        out = F.when(host_ == name, strip(strip(text, everywhere), patterns)).otherwise(out)
    return out


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(url: Column) -> Column:
    """The end of the path as a slug of at most 48 characters, and 8 digits of the address's hash."""
    s = F.btrim(F.regexp_replace(path(url), r"[^a-zA-Z0-9]+", "-"), F.lit("-"))
    s = F.lower(F.btrim(F.right(s, F.lit(48)), F.lit("-")))
    return F.concat(F.when(s == "", "root").otherwise(s), F.lit("-"), F.left(F.sha2(url, 256), F.lit(8)))


def document_label(url: Column, given: Column) -> Column:
    """A readable name: the given one, else words of the last path segment, else the host, else the address."""
    tail = F.element_at(F.split(F.rtrim(path(url), F.lit("/")), "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(tail, r"(?i)\.(html?|php|aspx?)$", ""), r"^[0-9]+[-_]", "")
    words = F.filter(F.split(stem, "[-_]+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))
    named = F.array_join(F.transform(words, lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(capital(w))), " ")
    own = F.btrim(F.coalesce(given, F.lit("")))
    bare = F.when(tail == "", F.coalesce(F.nullif(host(url), F.lit("")), url)).otherwise(host(url))
    return F.when(own != "", own).when((tail != "") & (F.size(words) > 0), named).otherwise(bare)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def parse_stamp(text: Column) -> Column:
    """The time of a stamp; null if it is none."""
    return F.when(text.rlike(r"^[0-9]{8}_[0-9]{6}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd_HHmmss")))


def instant(text: Column) -> Column:
    """The instant of an ISO text; null for nonsense, '' and 'Unknown'."""
    return text.try_cast("timestamp")


def days_between(then: Column, now: Column) -> Column:
    """Whole days from then to now, down to the next whole number."""
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000)).cast("long")


def days_since(then: Column, now: Column) -> Column:
    """As ``days_between``, and never below 0; null for null."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0), days_between(then, now)))


def is_stale(then: Column, now: Column, after: int = 30) -> Column:
    return then.isNull() | (days_between(then, now) > after)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def relative_age(then: Column, now: Column) -> Column:
    d = days_between(then, now)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(then.isNull(), "Unknown").when(d == 0, "today").when(d == 1, "yesterday").when(d < 30, say(d, "days")).when(d < 365, say(half_up(d / 30), "months")).otherwise(say(half_up(d / 365), "years"))


def sydney(then: Column, pattern: str) -> Column:
    """A local date where readers are, daylight saving included; 'Unknown' for null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(then, "Australia/Sydney"), pattern), F.lit("Unknown"))


def lettermark(host_: Column, name: Column) -> tuple[Column, Column]:
    """(letter, number of the colour) that stand for a source."""
    seed = F.coalesce(F.nullif(host_, F.lit("")), F.nullif(name, F.lit("")), F.lit("?"))
    h = F.aggregate(F.split(seed, ""), F.lit(0).cast("long"), lambda acc, c: (acc * 31 + F.ascii(c)) % 100000)
    return F.upper(F.left(seed, F.lit(1))), (h % 8).cast("int")


def url_component(text: Column) -> Column:
    """Percent-encoding as browsers have it: a space is %20 and ! ' ( ) * ~ stay."""
    t = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return t


def recode(value: Column, names: Mapping[str, str], default: Column | None = None) -> Column:
    out = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[value]
    return out if default is None else F.coalesce(out, default)


def in_locale(text: Column, collation: str = "UNICODE") -> Column:
    """For sorting: the text in the order that readers of a locale expect, letters before their accents and case, small before capital."""
    return F.collate(text, collation)
