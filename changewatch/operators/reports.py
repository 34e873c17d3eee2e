"""Health, alerts, the run log, the history of analyses, and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changewatch.config import Config
from changewatch.functions import text as X
from changewatch.operators import gates as G
from changewatch.operators.state import RANK, set_state

ARCHIVE = r"^(.+)_([0-9]{8}_[0-9]{6})_(analysis\.json|snapshot\.txt|diff\.txt)$"


def document_health(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    return documents.withColumn("health", set_state(cfg.health.consecutive_failure_threshold, F.coalesce("consecutive_failures", F.lit(0))))


def set_health(sets: DataFrame, documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Health of every set: the worst of its documents'; failing if it has none. With counts, and days since it was last read whole."""
    d = document_health(documents, cfg)
    rank = X.recode(F.col("health"), {k: str(v) for k, v in RANK.items()}).cast("int")
    per = d.groupBy("set_name").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("documents_total"), F.count_if(F.col("health") != "ok").alias("documents_failing"))
    t = sets.join(per, "set_name", "left")
    names = F.array(*map(F.lit, RANK))
    return t.withColumn("status", F.when(F.col("worst").isNull(), "failing").otherwise(F.element_at(names, F.col("worst") + 1))).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents_total", "documents_failing")}).drop("worst")


def failing_documents(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The documents of a report that are not read normally, with since when and why."""
    return document_health(documents, cfg).filter("health <> 'ok'").select("set_name", "url", "label", F.col("health").alias("status"), "consecutive_failures", "last_success", F.coalesce("last_error", F.lit("")).alias("last_error"))


def alerts(sets: DataFrame, documents: DataFrame, error_rate: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(kind, set_name, url, failures, detail): failing documents, repeated bad replies, too many failures in the run."""
    h = cfg.health
    failing = document_health(documents, cfg).filter("health = 'failing'").select(F.lit("source_failing").alias("kind"), "set_name", "url", F.col("consecutive_failures").cast("long").alias("failures"), F.coalesce("last_error", F.lit("")).alias("detail"))
    replies = sets.filter(F.coalesce("schema_failures", F.lit(0)) >= h.schema_failure_threshold).select(F.lit("schema_failures").alias("kind"), "set_name", F.lit("").alias("url"), F.col("schema_failures").cast("long").alias("failures"), F.lit("replies of the model were invalid in consecutive runs").alias("detail"))
    rate = error_rate.filter(F.col("error_rate") > h.error_rate_threshold).select(F.lit("run_error_rate").alias("kind"), F.lit("").alias("set_name"), F.lit("").alias("url"), F.lit(0).cast("long").alias("failures"), F.concat(X.half_up(F.col("error_rate") * 100).cast("string"), F.lit("% of documents failed in this run")).alias("detail"))
    return failing.unionByName(replies).unionByName(rate)


def alert_rows(found: DataFrame) -> DataFrame:
    """Alerts as rows of a Markdown table; a bar in a detail is escaped."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    detail = F.coalesce(F.nullif(F.replace(F.coalesce("detail", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit("—"))
    return found.withColumn("row", F.concat(F.lit("| "), dash("set_name"), F.lit(" | "), dash("url"), F.lit(" | "), F.col("kind"), F.lit(" — "), detail, F.lit(" | "), F.coalesce("failures", F.lit(0)).cast("string"), F.lit(" |")))


def outcome_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("outcome", F.lit("unknown")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def token_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.count_if("llm_called").alias("llm_calls"))


def error_rate(log: DataFrame) -> DataFrame:
    """One row: the share of records that failed; 0 of none."""
    return log.agg(F.coalesce(F.count_if(F.col("outcome").isin(*G.RUN_FAILURES)) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("error_rate"))


def recent(log: DataFrame, now: str, days: int) -> DataFrame:
    """Records within retention; those without a readable time are kept."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return log.filter(F.coalesce(X.instant(F.col("timestamp")) >= since, F.lit(True)))


def failure_streaks(log: DataFrame, by: str, order: list[str], failed: str) -> DataFrame:
    """Each record's consecutive failures so far: islands between successes, counted within."""
    w = W.partitionBy(by).orderBy(*order)
    t = log.withColumn("_island", F.count_if(~F.col(failed)).over(w))
    return t.withColumn("streak", F.count_if(failed).over(W.partitionBy(by, "_island").orderBy(*order))).drop("_island")


def last_success(log: DataFrame, by: str, order: list[str], ok: str, ts: str) -> DataFrame:
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("last_success", F.last(F.when(F.col(ok), F.col(ts)), ignorenulls=True).over(w))


def transitions(log: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Records whose value differs from the one before of the same key; the first has none before."""
    w = W.partitionBy(by).orderBy(*order)
    return log.withColumn("previous", F.lag(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("previous")) & F.col("previous").isNotNull())


def archive_index(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(file_id, stamp, ts, has_snapshot, has_diff) for every archived analysis, from file names; names without a valid time are left out."""
    t = files.select("*", F.regexp_extract("file_name", ARCHIVE, 1).alias("file_id"), F.regexp_extract("file_name", ARCHIVE, 2).alias("stamp"), F.regexp_extract("file_name", ARCHIVE, 3).alias("kind"))
    t = t.withColumn("ts", X.parse_stamp(F.col("stamp"))).filter("ts is not null")
    if known is not None:
        t = t.join(known, "file_id", "left_semi")
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    return t.groupBy("file_id", "stamp", "ts").agg(has("analysis.json").alias("_a"), has("snapshot.txt").alias("has_snapshot"), has("diff.txt").alias("has_diff")).filter("_a").drop("_a")


def history_records(archive: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A record for each archived analysis, from (file_name, text): file_id, stamp, ts, the paths of its files, and what it says.

    priority, verdict, summary and changed_documents are those of the
    analysis; null where its text is no JSON object. Of the other files only
    the names are read. ``known``: file ids to keep.
    """
    t = archive.select("text", "file_name", *(F.regexp_extract("file_name", ARCHIVE, i + 1).alias(n) for i, n in enumerate(("file_id", "stamp", "kind"))))
    t = t.withColumn("ts", X.parse_stamp(F.col("stamp"))).filter("ts is not null")
    if known is not None:
        t = t.join(known, "file_id", "left_semi")
    path = lambda kind: F.max(F.when(F.col("kind") == kind, F.concat(F.lit("logs/"), "file_name")))
    body = F.when(F.col("kind") == "analysis.json", F.from_json("text", "priority string, verdict string, summary string, changed_documents array<string>"))
    t = t.withColumn("body", body).drop("text")
    said = F.max_by("body", F.when(F.col("kind") == "analysis.json", "file_name"))
    records = t.groupBy("file_id", "stamp", "ts").agg(path("analysis.json").alias("analysis_path"), path("snapshot.txt").alias("snapshot_path"), path("diff.txt").alias("diff_path"), said.alias("b")).filter("analysis_path is not null")
    return records.select("file_id", "stamp", "ts", "analysis_path", "snapshot_path", "diff_path", *(F.col(f"b.{c}").alias(c) for c in ("priority", "verdict", "summary", "changed_documents")))


def history(index: DataFrame) -> DataFrame:
    """(file_id, n, stamps newest first)."""
    return index.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("stamp"), asc=False), ",").alias("stamps"))


def expired(files: DataFrame, now: str, days: int) -> DataFrame:
    """Archive files past retention."""
    ts = X.parse_stamp(F.regexp_extract("file_name", ARCHIVE, 2))
    return files.filter(ts < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
