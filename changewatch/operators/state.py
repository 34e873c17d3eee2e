"""State of documents and sets from one run to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changewatch.config import PIPELINE_VERSION, Config
from changewatch.functions import text as X
from changewatch.operators import gates as G
from changewatch.operators import ordered

PRIORITIES = ("critical", "high", "medium", "low")
VERDICTS = ("material_change", "no_material_change", "uncertain")
BADGED = ("material_change", "uncertain")
RANK = {"ok": 0, "degraded": 1, "failing": 2}


def next_documents(t: DataFrame, now: str) -> DataFrame:
    """The document records after a run, from classified captures: which fields move depends on the outcome alone."""
    o = F.col("outcome")
    rewritten = o.isin(*REWRITTEN)
    good = o.isin(*G.HEALTHY)
    moved = lambda new, old: F.when(rewritten, F.col(new)).otherwise(F.col(old))
    # sources that do not say these leave them null
    has = lambda c: F.col(c) if c in t.columns else F.lit(None).cast("string")
    return t.select(
        "set_name", "url", X.document_id(F.col("url")).alias("doc_id"), "label", o.alias("status"),
        moved("hash_now", "prior_hash").alias("hash"),
        moved("length_now", "prior_length").alias("length"),
        F.when(rewritten, F.lit(PIPELINE_VERSION)).otherwise(F.col("prior_pipeline_version")).alias("pipeline_version"),
        F.when(rewritten, F.col("etag")).when(o == G.NOT_MODIFIED, F.coalesce("etag", "prior_etag")).otherwise(F.col("prior_etag")).alias("etag"),
        *(F.when(rewritten, has(c)).when(o == G.NOT_MODIFIED, F.coalesce(has(c), has(f"prior_{c}"))).otherwise(has(f"prior_{c}")).alias(c) for c in ("last_modified", "extractor")),
        *(has(c).cast(kind).alias(c) for c, kind in (("http_status", "int"), ("fetch_ms", "long"))),
        F.when(good, F.lit(0)).otherwise(F.coalesce("prior_consecutive_failures", F.lit(0)) + 1).cast("long").alias("consecutive_failures"),
        F.when(good, F.lit(now)).otherwise(F.col("prior_last_success")).alias("last_success"),
        F.when(good, "").when(o == G.FETCH_FAILED, F.col("error")).otherwise(F.concat("reason", F.lit(": "), "detail")).alias("last_error"),
        F.when(o.isin(G.NEW, G.CHANGED), F.lit(now)).otherwise(F.col("prior_last_changed")).alias("last_changed"),
        F.when(o == G.SUSPECT, F.col("length_now")).alias("suspect_length"),
        F.when(o == G.REBASELINED, F.when(F.coalesce("prior_pipeline_version", F.lit(0)) != PIPELINE_VERSION, "extraction pipeline changed").otherwise("stored snapshot missing")).alias("rebaseline_reason"),
        F.lit(now).alias("last_checked"),
    )


REWRITTEN = (G.NEW, G.REBASELINED, G.CHANGED, G.UNCHANGED)


def baselines(t: DataFrame, captures: DataFrame, stored: DataFrame, normalised: Column | None = None) -> DataFrame:
    """(set_name, url, text) of every document after the run, from classified captures and the texts stored before.

    A text is committed together with its hash, also where a sibling failed;
    what the run did not rewrite keeps the text that it had.
    """
    rewritten = t.filter(F.col("outcome").isin(*REWRITTEN)).select(*G.KEYS)
    new = G.reading(captures.join(rewritten, G.KEYS, "left_semi"), normalised).select(*G.KEYS, F.col("text_now").alias("text"))
    return new.unionByName(stored.select(*G.KEYS, "text").join(rewritten, G.KEYS, "left_anti"))


def carry_forward(previous: DataFrame, current: DataFrame, key: str = "set_name") -> DataFrame:
    """Current rows, and previous ones of keys that the run did not touch."""
    return previous.join(current.select(key), key, "left_anti").withColumn("carried", F.lit(True)).unionByName(current.withColumn("carried", F.lit(False)))


def rollup_hash(documents: DataFrame, by: str = "set_name") -> DataFrame:
    """(by, hash) over its documents' hashes in order of their addresses; a missing one is empty. A set of any size: its hashes stream in order."""
    return ordered.digest(documents, [by], ["url"], "hash")


def section(url: str, text: str) -> Column:
    """A document's section of an aggregate: its marker and its text."""
    return F.concat(F.lit("--- Content from "), F.col(url), F.lit(" ---\n\n"), F.coalesce(F.col(text), F.lit("")))


def aggregate_snapshot(texts: DataFrame, by: str, order: str, url: str, text: str) -> DataFrame:
    """(by, aggregate): every document's text under its marker, in order, as one text, which must fit in a row."""
    return ordered.joined(texts.withColumn("_section", section(url, text)), [by], [order], "_section", sep="\n\n", name="aggregate")


def aggregate_parts(texts: DataFrame, by: str, order: str, url: str, text: str, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(by, part, text): the aggregate of a set of any size, a numbered part for each document; the parts join to the whole."""
    t = texts.select(F.col(by), F.col(order).alias("_order"), section(url, text).alias("text"))
    return ordered.parts(t, [by], ["_order"], "text", sep="\n\n", hold=hold).select(by, "part", "text")


def split_aggregate(aggregates: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, url, text) from aggregates; of a repeated address the last section."""
    # a marker cannot hold U+0001, so it may stand for the marker's ends
    marked = F.regexp_replace(F.col(text), r"(?m)^--- Content from (\S+) ---$", "\u0001$1\u0001")
    parts = F.split(marked, "\u0001")
    n = F.size(parts)
    sections = F.transform(F.sequence(F.lit(1), n - 1, F.lit(2)), lambda i: F.struct(i.alias("no"), F.get(parts, i).alias("url"), F.btrim(F.get(parts, i + 1), F.lit(" \t\n\r")).alias("text")))
    t = aggregates.select(*keys, F.inline(F.when(n >= 3, sections).otherwise(F.array().cast("array<struct<no:int,url:string,text:string>>"))))
    return t.groupBy(*keys, "url").agg(F.max_by("text", "no").alias("text"))


def set_rollup(t: DataFrame, by: str = "set_name") -> DataFrame:
    """What the outcomes of a set's documents come to."""
    o = F.col("outcome")
    return t.groupBy(by).agg(
        F.bool_and(o.isin(*G.HEALTHY)).alias("all_ok"),
        F.bool_or(o.isin(*G.FAILED)).alias("any_failed"),
        F.count_if(o.isin(*G.HEALTHY)).alias("readable"),
        F.count_if(o == G.CHANGED).alias("changed"),
        F.count_if(o == G.NEW).alias("new"),
        F.count_if(o == G.REBASELINED).alias("rebaselined"),
        F.count(F.lit(1)).alias("documents"),
    )


def decide(rollup: DataFrame, previous: DataFrame, by: str = "set_name") -> DataFrame:
    """Which way a set goes: unreadable, first_scan, rebaselined, unchanged or analyse."""
    t = rollup.join(previous.select(by, F.col("hash").alias("previous_hash")), by, "left")
    way = (
        F.when(F.col("readable") == 0, "unreadable")
        .when(F.col("changed") > 0, "analyse")
        .when((F.col("new") > 0) & (F.coalesce("previous_hash", F.lit("")) == ""), "first_scan")
        .when(F.col("new") + F.col("rebaselined") > 0, "rebaselined")
        .otherwise("unchanged")
    )
    return t.withColumn("decision", way)


def counters(rollup: DataFrame, previous: DataFrame, now: str, by: str = "set_name") -> DataFrame:
    """(by, consecutive_failures, last_success) of sets after a run."""
    t = rollup.join(previous.select(by, F.col("consecutive_failures").alias("_f"), F.col("last_success").alias("_s")), by, "left")
    return t.select(by, F.when(F.col("any_failed"), F.coalesce("_f", F.lit(0)) + 1).otherwise(F.lit(0)).cast("long").alias("consecutive_failures"), F.when(F.col("all_ok"), F.lit(now)).otherwise(F.col("_s")).alias("last_success"))


def badge(t: DataFrame, now: str) -> DataFrame:
    """A set's badge after its analysis: only a material or uncertain verdict moves it; any verdict is a review."""
    on = F.col("verdict").isin(*BADGED)
    pick = lambda new, old: F.when(on, new).otherwise(F.col(old))
    return t.withColumns({
        "last_amended": pick(F.lit(now), "last_amended"),
        "last_priority": pick(F.col("priority"), "last_priority"),
        "last_verdict": pick(F.col("verdict"), "last_verdict"),
        "review_verdict": F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")),
    })


#: What a set whose analysis failed gets back.
RESTORED = ("hash", "length", "etag", "last_modified")


#: The names of artefacts in the archive.
ARCHIVED = {"analysis": "analysis.json", "snapshot": "snapshot.txt", "diff": "diff.txt"}


def archive(artefacts: DataFrame) -> DataFrame:
    """(file_name, part, text) of artefacts under the names of the archive.

    ``artefacts``: file_id, kind, part, at (an ISO time, which the name has) and
    text; what is null is not archived.
    """
    stamp = X.stamp(X.instant(F.col("at")))
    return artefacts.filter("text is not null").select(F.concat_ws("_", "file_id", stamp, X.recode(F.col("kind"), ARCHIVED)).alias("file_name"), "part", "text")


def revert(documents: DataFrame, prior: DataFrame, failed_sets: DataFrame) -> DataFrame:
    """Document records of sets whose analysis failed: changed ones get their prior hash, length and validators back, and wait as analysis_pending.

    With the validators restored too, the next conditional request cannot hide
    the change that is to be tried again.
    """
    old = prior.select("set_name", "url", *(F.col(c).alias(f"_{c}") for c in RESTORED if c in prior.columns))
    t = documents.join(failed_sets.select("set_name", F.lit(True).alias("_failed")), "set_name", "left").join(old, ["set_name", "url"], "left")
    back = F.coalesce("_failed", F.lit(False)) & (F.col("status") == G.CHANGED) & F.col("_hash").isNotNull()
    out = t.withColumns({c: F.when(back, F.col(f"_{c}")).otherwise(F.col(c)) for c in RESTORED if c in prior.columns and c in documents.columns} | {"status": F.when(back, "analysis_pending").otherwise(F.col("status"))})
    return out.drop("_failed", *(f"_{c}" for c in RESTORED))


def valid_sets(sets: DataFrame) -> DataFrame:
    """Usable set definitions: named, of a category, with addresses that all have a url; of a name the first usable one.

    ``sets``: pos, setName, category, urls (array of structs with url).
    """
    named = (F.coalesce("setName", F.lit("")) != "") & (F.coalesce("category", F.lit("")) != "")
    listed = (F.coalesce(F.size("urls"), F.lit(-1)) > 0) & F.coalesce(F.forall("urls", lambda u: F.coalesce(u["url"], F.lit("")) != ""), F.lit(False))
    return sets.filter(named & listed).withColumn("_n", F.row_number().over(W.partitionBy("setName").orderBy("pos"))).filter("_n = 1").drop("_n")


def set_state(health_threshold: int, failures: Column) -> Column:
    return F.when(failures >= health_threshold, "failing").when(failures > 0, "degraded").otherwise("ok")


def first_usable(attempts: DataFrame, cfg: Config = Config(), by: str = "url") -> DataFrame:
    """The fetch result of each address: a 304 or the first usable attempt, else a failure with the last error.

    ``attempts``: url, attempt, route_no, status, text, error. Usable: ok, not
    blank, no block page.
    """
    usable = (F.col("status") == "not_modified") | ((F.col("status") == "ok") & (F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r")) != "") & ~G.has_signature(F.col("text"), cfg.validation.failure_signatures))
    place = F.struct("attempt", "route_no")
    t = attempts.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    return t.groupBy(by).agg(
        F.min_by(F.when(F.col("_usable"), F.col("status")), F.when(F.col("_usable"), place)).alias("_status"),
        F.min(F.when(F.col("_usable"), place)).alias("_at"),
        F.max_by("error", place).alias("_error"),
        F.count(F.lit(1)).alias("tried"),
    ).select(by, F.coalesce("_status", F.lit("failed")).alias("status"), F.col("_at.attempt").alias("attempt"), F.col("_at.route_no").alias("route_no"), F.when(F.col("_status").isNull(), F.col("_error")).alias("error"), "tried")
