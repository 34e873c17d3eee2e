"""Gates between a capture and a report: is it the document at all, is it new, did it change."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.config import PIPELINE_VERSION, Config
from changewatch.functions import text as X

NOT_MODIFIED, FETCH_FAILED, SUSPECT, NEW, REBASELINED, UNCHANGED, CHANGED = "not_modified", "fetch_failed", "suspect_scrape", "new", "rebaselined", "unchanged", "changed"
HEALTHY = (NOT_MODIFIED, NEW, REBASELINED, UNCHANGED, CHANGED)
FAILED = (FETCH_FAILED, SUSPECT)
RUN_FAILURES = (*FAILED, "schema_failed")


def signature(text: Column, signatures: list[str]) -> Column:
    """The first signature, in their order, that the folded text holds; else null. Only a text that may hold one is folded."""
    return F.when(_may_hold(text, signatures), _first(X.fold(text), signatures))


def _first(folded: Column, signatures: list[str]) -> Column:
    return X.given(folded, lambda t: F.coalesce(*(F.when(F.contains(t, X.fold(F.lit(s))), F.lit(s)) for s in signatures)))


def _may_hold(text: Column, signatures: list[str]) -> Column:
    """Whether the text in lower case holds the anchor of any signature: true of all that hold a signature, and of few others."""
    anchors = sorted({X.anchor(s) for s in signatures})
    if "" in anchors:
        return text.isNotNull()
    return X.given(F.lower(text), lambda t: reduce(or_, (F.contains(t, F.lit(a)) for a in anchors), F.lit(False)))


def has_signature(text: Column, signatures: list[str]) -> Column:
    """Whether the folded text holds any signature: one search for all of them, where one may be held."""
    return _may_hold(text, signatures) & X.fold(text).rlike("|".join(re.escape(fold_plain(s)) for s in signatures))


def fold_plain(text: str) -> str:
    """Folded in full, of which ``functions.text.fold`` knows nearly all."""
    return text.translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO)).casefold()


def holds_signature(text: str, signatures: list[str]) -> bool:
    """As ``has_signature``, for one text."""
    folded = fold_plain(text)
    return any(fold_plain(s) in folded for s in signatures)


def refusal(blank: Column, signed: Column, length: Column, prior_length: Column, cfg: Config) -> Column:
    """Why a normalised capture is not the document: empty, block_page, too_short, shrank, grew; null if nothing speaks against it.

    Of the text itself only three facts are asked: whether it is blank, the
    signature that it holds, and its length.
    """
    v = cfg.validation
    known = F.coalesce(prior_length, F.lit(0)) != 0
    return (
        F.when(blank, "empty")
        .when(signed.isNotNull(), "block_page")
        .when(length < v.min_length, "too_short")
        .when(known & (length < prior_length * v.shrink_ratio), "shrank")
        .when(known & (length > prior_length * v.growth_ratio), "grew")
    )


def refusal_detail(signed: Column, length: Column, prior_length: Column, reason: Column, cfg: Config) -> Column:
    """What is said about a refusal."""
    n = length.cast("string")
    share = F.concat(n, F.lit(" of "), prior_length.cast("string"), F.lit(" characters"))
    return F.when(reason == "empty", "no text").when(reason == "block_page", F.concat(F.lit("holds: "), signed)).when(reason == "too_short", F.concat(n, F.lit(" characters, fewer than "), F.lit(str(cfg.validation.min_length)))).when(reason.isin("shrank", "grew"), share)


def outcome(prior_hash: Column, prior_version: Column, has_text: Column, new_hash: Column, status: Column, reason: Column) -> Column:
    """The outcome of a capture by its hash: what is ``changed`` here has other text than was stored, if not other lines."""
    return (
        F.when(status == "not_modified", NOT_MODIFIED)
        .when(status == "failed", FETCH_FAILED)
        .when(reason.isNotNull(), SUSPECT)
        .when(F.coalesce(prior_hash, F.lit("")) == "", NEW)
        .when((F.coalesce(prior_version, F.lit(0)) != PIPELINE_VERSION) | ~has_text, REBASELINED)
        .when(prior_hash == new_hash, UNCHANGED)
        .otherwise(CHANGED)
    )


KEYS = ["set_name", "url"]


def reading(captures: DataFrame, normalised: Column | None = None) -> DataFrame:
    """Captures with text_now, the normalised text of those that brought one."""
    return captures.withColumn("text_now", F.when(F.col("status") == "ok", X.squeeze(F.col("text")) if normalised is None else normalised))


def gate(captures: DataFrame, prior: DataFrame, cfg: Config = Config(), normalised: Column | None = None, fault: Column | None = None) -> DataFrame:
    """Captures, without their texts, with their prior state and the outcome that their hash gives them.

    What is asked of a text is worked out where it is read, so that only a few
    numbers and a hash of each document meet its prior state. ``prior`` says by
    ``has_text`` whether a text is stored, or has the text itself as ``stored``.
    ``fault``: what failed in reading a text, kept as a column of that name.
    """
    t = reading(captures if fault is None else captures.withColumn("fault", F.when(F.col("status") == "ok", fault)), normalised)
    now = F.col("text_now")
    t = t.withColumns({
        "_blank": F.btrim(F.coalesce(now, F.lit("")), F.lit(" \t\n\r")) == "",
        "_signed": F.when(has_signature(now, cfg.validation.failure_signatures), signature(now, cfg.validation.failure_signatures)),
        "_hash": X.content_hash(now), "length_now": F.length(now).cast("long"),
    }).drop("text", "text_now")
    has_text = F.coalesce(F.col("has_text"), F.lit(False)) if "has_text" in prior.columns else F.coalesce("stored", F.lit("")) != ""
    known = prior.select(*KEYS, has_text.alias("_has_text"), *(F.col(c).alias(f"prior_{c}") for c in prior.columns if c not in (*KEYS, "stored", "has_text")))
    t = t.join(known, KEYS, "left")
    ok = F.col("status") == "ok"
    t = t.withColumn("reason", F.when(ok, refusal(F.col("_blank"), F.col("_signed"), F.col("length_now"), F.col("prior_length"), cfg)))
    t = t.withColumn("detail", refusal_detail(F.col("_signed"), F.col("length_now"), F.col("prior_length"), F.col("reason"), cfg))
    t = t.withColumn("hash_now", F.when(ok & F.col("reason").isNull(), F.col("_hash")))
    by_hash = outcome(F.col("prior_hash"), F.col("prior_pipeline_version"), F.coalesce("_has_text", F.lit(False)), F.col("hash_now"), F.col("status"), F.col("reason"))
    return t.withColumn("outcome", by_hash).drop("_blank", "_signed", "_hash", "_has_text")


#: Bits that say which keys are asked for.
MARKS = 1 << 24


def marked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` without nearly all rows that are not of ``keys``, dropped where they are read; an exact join is to follow.

    The keys' hashes set bits, 64 to a row, so that what is sent to all tasks
    is bounded however many keys there are: 2 ** 18 rows. More keys only let
    more rows pass.
    """
    place = F.pmod(F.xxhash64(*KEYS), F.lit(MARKS))
    word, bit = F.floor(place / 64), (place % 64).cast("int")
    bits = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return texts.join(F.broadcast(bits), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")


def texts_of(keys: DataFrame, captures: DataFrame, prior: DataFrame, normalised: Column | None = None) -> DataFrame:
    """(set_name, url, text_now, prior_stored) of the documents in ``keys`` alone: of other texts hardly any is moved. ``prior`` has set_name, url and stored."""
    new = reading(marked(captures, keys).join(keys.select(*KEYS), KEYS, "left_semi"), normalised).select(*KEYS, "text_now")
    # what holds texts alone was made for these keys
    old = marked(prior, keys) if set(prior.columns) > {*KEYS, "stored"} else prior
    return new.join(old.select(*KEYS, F.col("stored").alias("prior_stored")), KEYS, "left")


def same_lines(old: Column, new: Column) -> Column:
    """Whether two texts have the same lines, so that their diff is empty, whatever ends the lines."""
    plain = lambda t: X.where_held(t, tuple(X.LINE_ENDS), lambda x: F.translate(x, X.LINE_ENDS, X.LF * len(X.LINE_ENDS)))
    lines = lambda t: X.given(plain(t), lambda x: F.when(F.endswith(x, F.lit(X.LF)), F.left(x, F.length(x) - 1)).otherwise(x))
    return lines(old) == lines(new)


def classify(captures: DataFrame, prior: DataFrame, cfg: Config = Config(), normalised: Column | None = None, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist, stored: Callable[[DataFrame], DataFrame] | None = None, fault: Column | None = None) -> DataFrame:
    """Captures, without their texts, with their prior state and outcome.

    ``captures``: set_name, url, status, text and more; ``prior``: set_name,
    url, hash, length, pipeline_version, stored (its text), consecutive_failures
    and more, at most one row a document. Adds reason, detail, hash_now,
    length_now, outcome; prior columns but the text get the prefix prior_.

    Hashes decide for all but a few documents. Where they differ the texts are
    fetched, and a document with the same lines is unchanged after all. The
    narrow result of the hashes is read twice, so ``hold`` keeps it. ``stored``
    gives the texts (set_name, url, stored) of the documents that it is asked
    for, where ``prior`` has ``has_text`` in their place.
    """
    held = hold(gate(captures, prior, cfg, normalised, fault))
    doubted = held.filter(F.col("outcome") == CHANGED)
    moved = texts_of(doubted, captures, prior if stored is None else stored(doubted.select(*KEYS)), normalised)
    cosmetic = moved.filter(same_lines(F.col("prior_stored"), F.col("text_now"))).select(*KEYS, F.lit(True).alias("_same"))
    return held.join(cosmetic, KEYS, "left").withColumn("outcome", F.when(F.col("_same"), UNCHANGED).otherwise(F.col("outcome"))).drop("_same")


def changed(classified: DataFrame, captures: DataFrame, prior: DataFrame, normalised: Column | None = None, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """The changed rows of ``classify`` with text_now and prior_stored. They are read for every fetch, so ``hold`` keeps them; ``moved`` has no need of ``classify``."""
    rows = hold(classified.filter(F.col("outcome") == CHANGED))
    return rows.join(texts_of(rows, captures, prior, normalised), KEYS)


def moved(captures: DataFrame, prior: DataFrame, cfg: Config = Config(), normalised: Column | None = None, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist, stored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What ``changed`` makes of ``classify``, in one fetch of texts: those whose hash moved are fetched, and the same lines tell which of them stay. ``hold`` and ``stored`` are as there."""
    rows = hold(gate(captures, prior, cfg, normalised)).filter(F.col("outcome") == CHANGED)
    both = rows.join(texts_of(rows, captures, prior if stored is None else stored(rows.select(*KEYS)), normalised), KEYS)
    # null, where no text is stored: changed, as ``classify`` has it
    return both.filter(~F.coalesce(same_lines(F.col("prior_stored"), F.col("text_now")), F.lit(False)))


def worth_rendering(http_status: Column) -> Column:
    """Whether a failed plain fetch may go better in a browser: not after a client error that says the page is not there."""
    return http_status.isNull() | ~http_status.between(400, 499) | http_status.isin(401, 403, 405, 406, 429)
