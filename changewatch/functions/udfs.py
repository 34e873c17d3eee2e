"""What Catalyst has no function for: exact normalising, unified diffs, text of HTML. Arrow batches, never row by row.

Put these behind filters: Spark evaluates a Python function in a CASE branch for every row.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections import Counter
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch.functions.faults import guarded, said
from changewatch.functions.text import NBSP, ZERO_WIDTH

_BLANKS = re.compile(r"[^\S\n]+")
_NO_WIDTH = {ord(c): None for c in ZERO_WIDTH}
#: Entities may be escaped so many times.
UNESCAPE_PASSES = 5


def normalise_text(text: str | None, noise: list[str] | None = None, *, strict: bool = False) -> str:
    """A text with cosmetic differences removed; null is empty.

    In order: line ends, HTML entities (up to 5 times), NFC, characters without
    width, U+00A0, noise patterns, blanks within and around lines, runs of
    blank lines, ends. ``strict`` repeats all that until nothing changes.
    """
    t = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    for _ in range(UNESCAPE_PASSES):
        before, t = t, html.unescape(t)
        if t == before:
            break
    t = unicodedata.normalize("NFC", t).translate(_NO_WIDTH).replace(NBSP, " ")
    for p in noise or ():
        t = re.sub(p, "", t, flags=re.MULTILINE)
    t = "\n".join(_BLANKS.sub(" ", line).strip() for line in t.split("\n"))
    t = re.sub(r"\n{3,}", "\n\n", t).strip()
    if strict:
        while (again := normalise_text(t, noise)) != t:
            t = again
    return t


@F.pandas_udf(T.StringType())
def normalise(text: pd.Series, noise: pd.Series) -> pd.Series:
    """``normalise_text`` over (text, array of patterns or null)."""
    return pd.Series([normalise_text(t, None if n is None else list(n)) for t, n in zip(text, noise, strict=True)], dtype=object)


DIFF = T.StructType([T.StructField("text", T.StringType()), T.StructField("added", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("truncated", T.BooleanType()), T.StructField("lines_added", T.LongType()), T.StructField("lines_removed", T.LongType())])
#: A diff, or what failed.
DIFF_OR_ERROR = T.StructType([*DIFF.fields, T.StructField("error", T.StringType())])
CUT_NOTE = "\n… diff truncated …"


normalise_or_error = guarded(normalise_text, T.StringType())
"""``normalise_text`` over (text, array of patterns or null), as (value, error)."""


def diff_texts(old: str | None, new: str | None, label: str, context: int, limit: int) -> tuple:
    """The fields of ``DIFF``. added and removed leave out lines that look like file headers; lines_added and lines_removed count all."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    plus = minus = 0
    lines: list[str] = []
    for line in difflib.unified_diff(a, b, f"{label} (stored)", f"{label} (current)", n=context, lineterm=""):
        lines.append(line)
        plus += line[:1] == "+"
        minus += line[:1] == "-"
    shown_plus = sum(x[:1] == "+" and x[:3] != "+++" for x in lines)
    shown_minus = sum(x[:1] == "-" and x[:3] != "---" for x in lines)
    text = "\n".join(lines)
    cut = len(text) > limit
    heads = bool(lines)
    return (text[:limit] + CUT_NOTE if cut else text), shown_plus, shown_minus, cut, plus - heads, minus - heads


def unified_diff(context: int = 3, limit: int = 40000):
    """A pandas function over (old, new, label) that returns ``DIFF_OR_ERROR``; what fails on a row is its error, and all else null."""

    def one(old: str | None, new: str | None, label: str | None) -> tuple:
        try:
            return *diff_texts(old, new, label or "", context, limit), None
        except Exception as e:  # noqa: BLE001  the row's value, whatever it is
            return (None,) * len(DIFF) + (said(e),)

    @F.pandas_udf(DIFF_OR_ERROR)
    def diff(old: pd.Series, new: pd.Series, label: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(one, old, new, label)), columns=DIFF_OR_ERROR.names).astype(dict.fromkeys(("added", "removed", "lines_added", "lines_removed"), "Int64"))

    return diff


# one step of a selector: what joins it to the step before, a tag, and conditions
_STEP = re.compile(r"(\s*>\s*|\s+|^)([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[^\]]*\])*)")
_CONDITION = re.compile(r"""([#.])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*["']?(.*?)["']?\s*)?\]""")
_HOLDS = {
    "=": lambda has, want: has == want,
    "~=": lambda has, want: want in has.split(),
    "|=": lambda has, want: has == want or has.startswith(f"{want}-"),
    "^=": lambda has, want: want != "" and has.startswith(want),
    "$=": lambda has, want: want != "" and has.endswith(want),
    "*=": lambda has, want: want != "" and want in has,
}


@cache
def parse_selector(selector: str) -> list[list[tuple[bool, str, list[tuple[str, str, str]]]]]:
    """Alternatives of steps (child of the step before, tag or '', conditions (attribute, test or '', value)).

    Known are tags, *, #id, .class, [attribute] and its comparisons, descendants,
    children (>) and lists; anything else is a ValueError.
    """
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        steps, at, one = [], 0, one.strip()
        while at < len(one):
            m = _STEP.match(one, at)
            if not m or m.end() == m.end(1):
                raise ValueError(f"not a known selector: {selector!r}")
            conditions = [({"#": "id", ".": "class"}.get(sign) or name.lower(), {"#": "=", ".": "~="}.get(sign, test), word or value) for sign, word, name, test, value in _CONDITION.findall(m[3])]
            steps.append((">" in m[1], "" if m[2] in (None, "*") else m[2].lower(), conditions))
            at = m.end()
        if not steps:
            raise ValueError(f"not a known selector: {selector!r}")
        out.append(steps)
    return out


def _fits(step: tuple, tag: str, attributes: dict[str, str]) -> bool:
    _, wanted, conditions = step
    return wanted in ("", tag) and all(name in attributes and (not test or _HOLDS[test](attributes[name], value)) for name, test, value in conditions)


class Selection:
    """Which elements the alternatives of a selector select, told element by element from the root down.

    For every open element it keeps, as bits, the steps that the element itself
    completes and those that it or an element above completes, so a new element
    costs as much as there are steps, however deep it lies.
    """

    def __init__(self, alternatives: list[list[tuple]]):
        self.alternatives = alternatives
        self.open = [[(0, 0)] * len(alternatives)]

    def enter(self, tag: str, attributes: dict[str, str]) -> bool:
        """Whether the element is selected."""
        states, picked = [], False
        for steps, (parent, above) in zip(self.alternatives, self.open[-1], strict=True):
            own = 0
            for i, step in enumerate(steps):
                if (i == 0 or (parent if step[0] else above) >> (i - 1) & 1) and _fits(step, tag, attributes):
                    own |= 1 << i
            states.append((own, above | own))
            picked |= bool(own >> (len(steps) - 1) & 1)
        self.open.append(states)
        return picked

    def close(self, depth: int) -> None:
        """All elements but the first ``depth`` end."""
        del self.open[depth + 1 :]


class _Reader(HTMLParser):
    """Text of a page: blocks as lines, without scripts and, unless ``whole``, navigation and the like; with a selector, only what is inside its elements."""

    # fixed values: elements without readable text, those that are not the document, that end a line, and that have no end
    UNREAD = frozenset("script style noscript template svg iframe head".split())
    SKIP = UNREAD | frozenset("nav header footer aside form button".split())
    LINES = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol table tr br hr blockquote pre dd dt figure figcaption".split())
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, selector: str | None = None, *, whole: bool = False):
        super().__init__(convert_charrefs=True)
        self.wanted = Selection(parse_selector(selector)) if selector else None
        self.whole, self.parts = whole, []
        # of the open elements: their tags, how many are open of each, and how many of them are selected, how many skipped
        self.path, self.tags, self.inside, self.skipped = [], Counter(), [0], [0]

    def _on(self) -> bool:
        return not self.skipped[-1] and (self.wanted is None or self.inside[-1] > 0)

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        self.path.append(tag)
        self.tags[tag] += 1
        picked = self.wanted is not None and self.wanted.enter(tag, attributes)
        skip = tag in (self.UNREAD if self.whole else self.SKIP) or not self.whole and "ad" in attributes.get("class", "").split()
        self.inside.append(self.inside[-1] + picked)
        if self._on() and tag in self.LINES:
            self.parts.append("\n")
        if self._on() and tag in ("td", "th"):
            self.parts.append(" | ")
        self.skipped.append(self.skipped[-1] + (skip and tag not in self.VOID))
        if tag in self.VOID:
            self._close(len(self.path) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def _close(self, depth: int) -> None:
        self.tags.subtract(self.path[depth:])
        if self.wanted is not None:
            self.wanted.close(depth)
        del self.path[depth:], self.inside[depth + 1 :], self.skipped[depth + 1 :]

    def handle_endtag(self, tag):
        # an end without a begin costs nothing; else what is passed over ends too
        if self.tags[tag] > 0:
            depth = next(i for i in range(len(self.path) - 1, -1, -1) if self.path[i] == tag)
            on = self.inside[depth + 1] > 0 or self.wanted is None
            self._close(depth)
            if on and not self.skipped[-1] and tag in self.LINES:
                self.parts.append("\n")

    def handle_data(self, data):
        if self._on():
            self.parts.append(data)


def html_text(page: str | None, selector: str | None = None) -> tuple[str, str]:
    """(readable text, how it was had): "selector" within a CSS selector's elements, "page" of all of the page.

    Elements that hold nothing but what is left out elsewhere, such as a
    navigation, give their plain text. Where the selector finds no text, the
    page is read.
    """
    for wanted, whole in [(selector, False), (selector, True), (None, False)] if selector else [(None, False)]:
        reader = _Reader(wanted, whole=whole)
        reader.feed(page or "")
        reader.close()
        lines = (" ".join(x.split()) for x in "".join(reader.parts).split("\n"))
        text = "\n".join(x for x in lines if x)
        if text:
            return text, "selector" if wanted else "page"
    return "", "page"


EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("extractor", T.StringType())])


@F.pandas_udf(EXTRACTED)
def extract_text(page: pd.Series, selector: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html_text(p, s) for p, s in zip(page, selector, strict=True)], columns=EXTRACTED.names)
