"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, schemes, plus
signs, digits and words that announce an identifier. At an anchor a
deterministic local parser expands to the left and right, validates, and gives
a span or nothing. Texts without an anchor are left at once.

Spans are (kind, start, end) in code points, the end exclusive. Base kinds are
email, ip, card and phone, each equal to a leftmost non-overlapping search for
its pattern of which failing matches are dropped. The anchors add url (a
scheme with user information, or an address with a query that names a person),
account (a cue, then what it announces: an IBAN of its country's length and
check digits, an SSN of 3-2-4 digits, else one token of six characters or more
with digits, or groups of digits) and secret (a cue such as token, key or
password, a sign of assignment, then a value that is no word; or a key by the
prefix that its issuer gives it).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changewatch.llm.common import beside, by_bytes

BATCH_BYTES = 2_000_000
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

# fixed values: the base patterns' parts
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
# fixed values: what the method adds
_SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "mailto")
_USERINFO = re.compile(r"://[^\s/?#@]+@[^\s/?#@]+")
_ADDRESS = re.compile(r"://[^\s#<>\"]+")
#: A parameter of a query that names a person, and the first character of its value.
_NAMED = re.compile(r"[?&;](?:(?:e-?|user_?)?mail|(?:first|last|full|given|family|user|sur|customer)?[_-]?name|user|login|phone|mobile|tel|ssn|passport|iban|account|(?:user|customer|tax|account)[_-]?(?:id|no|number))=[^&;]", re.IGNORECASE | re.ASCII)
_CUES = ("iban", "ssn", "passport", "account no", "account number", "acct", "customer id", "tax id")
_SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "auth key", "auth_key", "bearer")
_PREFIXES = ("akia", "asia", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_")
_ASSIGNED = re.compile(r"[\"']?[ \t]{0,3}(?:=>|[:=]{1,2}|(?i:is)(?=[ \t]))[ \t]{0,3}[\"'`]?")
#: After this cue alone a value may follow without a sign.
_BARE = re.compile(r"[ \t]{1,3}")
_VALUE = re.compile(r"[A-Za-z0-9+/_=.~-]{12,}", re.ASCII)
_PASSWORD = re.compile(r"[^\s\"'`<>]{6,128}")
_KEY = re.compile(r"[A-Za-z0-9_-]{12,}", re.ASCII)
_DIGIT = re.compile(r"[0-9]")
_AFTER_CUE = re.compile(r"\.?[ \t]{0,3}(?:(?i:no\.?|number|id|is)(?![A-Za-z0-9]))?[ \t]{0,3}[:=#]?[ \t]{0,3}")
_END = r"(?![A-Za-z0-9])"
_SSN = re.compile(rf"[0-9]{{3}}([ -]?)[0-9]{{2}}\1[0-9]{{4}}{_END}")
#: A token, whose groups after a hyphen hold a digit, or groups of digits.
_TOKEN = re.compile(rf"(?:[0-9]{{2,5}}(?: [0-9]{{2,5}}){{1,7}}|[A-Za-z]{{0,4}}[0-9][A-Za-z0-9]{{0,40}}(?:-(?=[A-Za-z]*[0-9])[A-Za-z0-9]+){{0,16}}){_END}", re.ASCII)
_LETTERS = re.compile(r"[A-Za-z0-9]")
#: An IBAN's characters by its country.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = re.compile(r"\w")

Span = tuple[str, int, int]


@functools.cache
def _automaton():
    found = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("scheme", ("://",)), ("plus", "+"), ("digit", "0123456789"), ("cue", _CUES), ("secret", _SECRET_CUES), ("prefix", _PREFIXES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """A to Z in lower case, at the same places."""
    # of other characters, these alone change the length or become ASCII
    return text.translate(_LOWER) if "\u0130" in text or "\u212a" in text else text.lower()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (m := _DOMAIN.match(text, at + 1)):
        return None
    return start, m.end()


def _url(text: str, at: int, past: dict[str, int]) -> tuple[int, int] | None:
    start = at
    while start and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    if text[start:at].lower() not in _SCHEMES:
        return None
    end = m.end() if (m := _USERINFO.match(text, at)) else 0
    # an address within one whose query names nobody has the end of that query
    if at >= past["query"] and (m := _ADDRESS.match(text, at)):
        past["query"] = stop = m.end()
        query = text.find("?", at, stop)
        if query >= 0 and _NAMED.search(text, query, stop):
            while text[stop - 1] in ".,;:!?)]}'":
                stop -= 1
            end = max(end, stop)
    return (start, end) if end else None


def _iban(text: str, at: int) -> int | None:
    """The end of the IBAN at this place: its country's length, in groups of four or without gaps, and 97 divides it with a rest of 1."""
    size = _IBAN_LENGTHS.get(text[at : at + 2].upper(), 0)
    found, end = "", at
    gap = text[at + 4 : at + 5] if text[at + 4 : at + 5] in (" ", "-") else ""
    while size and len(found) < size:
        if gap and found and len(found) % 4 == 0:
            if text[end : end + 1] != gap:
                return None
            end += 1
        if not _LETTERS.match(text, end):
            return None
        found, end = found + text[end].upper(), end + 1
    if not size or _LETTERS.match(text, end) or not found[2:4].isdigit():
        return None
    return end if int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1 else None


def _account(text: str, cue: str, after: int) -> tuple[int, int] | None:
    """The identifier that a cue announces, by the cue's own form; others have 6 to 38 letters and digits."""
    at = _AFTER_CUE.match(text, after).end()
    if cue == "iban":
        return (at, end) if (end := _iban(text, at)) else None
    if cue == "ssn":
        return (at, m.end()) if (m := _SSN.match(text, at)) else None
    m = _TOKEN.match(text, at)
    return (at, m.end()) if m and 6 <= sum(c not in " -" for c in m.group()) <= 38 else None


def _secret(text: str, cue: str, after: int, past: dict[str, int]) -> tuple[int, int] | None:
    """The value that a cue announces: one token of 12 characters or more with a digit; after a password's cue 6 or more with a digit or a sign.

    What a token without a digit ends with has none either, so ``past`` keeps
    where it ends, and no cue within it reads it again.
    """
    m = _ASSIGNED.match(text, after) or (_BARE.match(text, after) if cue == "bearer" else None)
    if not m:
        return None
    secret = cue in ("password", "passwd", "pwd")
    if not secret and m.end() < past["value"]:
        return None
    found = (_PASSWORD if secret else _VALUE).match(text, m.end())
    if not found:
        return None
    if not secret and not _DIGIT.search(text, m.end(), found.end()):
        past["value"] = found.end()
        return None
    value = found.group().rstrip(".,;" if secret else ".,;:!?)]}")
    if len(value) < (6 if secret else 12) or not any(c.isdigit() or (secret and c in "!@#$%^&*") for c in value):
        return None
    return m.end(), m.end() + len(value)


def spans(text: str) -> list[Span]:
    """All spans of a whole text, by start, then by kind as in ``KINDS``."""
    out: list[Span] = []
    past = dict.fromkeys(("email", "ip", "card", "phone", "url", "account", "secret", "run", "query", "value", "key"), 0)
    for last, (kind, size) in _automaton().iter(_lowered(text)):
        at = last - size + 1
        if kind == "digit":
            # a match of ip or card starts at the first digit that no match before has taken; a number's other digits end where the first does
            if at >= past["card"]:
                m = _CARD.match(text, at)
                if m:
                    past["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, m.end()))
            if at >= past["ip"] and at >= past["run"]:
                past["run"] = _RUN.match(text, at).end()
                if text[past["run"] : past["run"] + 1] == "." and (m := _IP.match(text, at)):
                    past["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                        out.append(("ip", at, m.end()))
        elif kind == "at":
            if got := _email(text, at, past["email"]):
                past["email"] = got[1]
                out.append(("email", *got))
        elif kind == "plus":
            if at >= past["phone"] and (m := _PHONE.match(text, at)):
                past["phone"] = m.end()
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "scheme":
            if at >= past["url"] and (got := _url(text, at, past)):
                past["url"] = got[1]
                out.append(("url", *got))
        elif kind == "secret":
            # an underscore may stand before it, as in the names of settings
            if at >= past["secret"] and not (at and _LETTERS.match(text, at - 1)) and (got := _secret(text, text[at : last + 1].lower(), last + 1, past)):
                past["secret"] = got[1]
                out.append(("secret", *got))
        elif kind == "prefix":
            if at >= past["secret"] and at >= past["key"] and not (at and _WORD.match(text, at - 1)) and (m := _KEY.match(text, at)):
                if not _DIGIT.search(text, at, m.end()):
                    past["key"] = m.end()  # nor has what it ends with
                elif len(m.group()) >= 20:
                    past["secret"] = m.end()
                    out.append(("secret", at, m.end()))
        elif at >= past["account"] and not (at and _WORD.match(text, at - 1)):
            if got := _account(text, text[at : last + 1].lower(), last + 1):
                past["account"] = got[1]
                out.append(("account", *got))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; where spans overlap, the first to start names the whole."""
    out, past = [], 0
    i = 0
    while i < len(found):
        kind, start, end = found[i]
        i += 1
        while i < len(found) and found[i][1] < end:
            end = max(end, found[i][2])
            i += 1
        out += (text[past:start], f"<{kind.upper()}>")
        past = end
    return "".join([*out, text[past:]])


def find(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_email, n_ip, n_card, n_phone, base_sha256 and spans, a row for each row.

    A null or empty text has no spans: counts 0, the digest of '', spans ''.
    Whole texts of any length are searched; repeated rows each get their
    spans; an empty table gives an empty result; other columns are not read.
    """
    rows = beside(docs, keep, text)
    schema = T.StructType(docs.select(*keep).schema.fields + [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, len(keep), BATCH_BYTES):
            found = [spans(t) for t in texts]
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(joined([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts, pa.array(digests, pa.string()), pa.array([joined(f) for f in found], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def mask(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with each text's spans masked: same columns, types and rows. Null texts stay null."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in by_bytes(batches, at, BATCH_BYTES):
            new = [None if t is None else masked(t, f) if (f := spans(t)) else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
