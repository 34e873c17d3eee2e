"""Sequential state of a key over its log, as segments that merge.

What a stretch of records comes to - how many there are, how many failed, the
failures after the last success, and that success - is a segment. Two segments
that follow each other merge into one, so a key's log is folded by periods
(days) in any number of tasks, and only a row for each period is put in order.
A record's streak is its own period's part and, until the first success there,
what the periods before came to. No task reads all of a busy key's records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _within(log: DataFrame, key: str, period: str, order: Sequence[str], ok: str, ts: str) -> DataFrame:
    """``log`` with _seen (successes so far in the period), _own (failures since the last of them, or since its begin) and _own_ok (its ``ts``)."""
    w = W.partitionBy(key, period).orderBy(*order)
    good = F.coalesce(F.col(ok), F.lit(False))
    t = log.withColumn("_seen", F.count_if(good).over(w))
    island = W.partitionBy(key, period, "_seen").orderBy(*order)
    return t.withColumn("_own", F.count_if(~good).over(island)).withColumn("_own_ok", F.last(F.when(good, F.col(ts)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))


def _ends(t: DataFrame, key: str, period: str, order: Sequence[str], ok: str) -> DataFrame:
    at = F.struct(*order)
    return t.groupBy(key, period).agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failures"), F.max_by("_own", at).alias("trailing"), F.max_by("_own_ok", at).alias("last_ok"))


def segments(log: DataFrame, key: str, period: str, order: Sequence[str], ok: str, ts: str) -> DataFrame:
    """(key, period, records, failures, trailing, last_ok): a segment for each key and period.

    ``ok``: whether a record succeeded (null: it did not). trailing: failures
    after the last success, all if there is none; last_ok: ``ts`` of the last
    success that has one. ``order`` must tell a key's records apart.
    """
    return _ends(_within(log, key, period, order, ok, ts), key, period, order, ok)


def merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The segment of two that follow each other; a and b have its fields as columns. Associative, so periods may be merged in any grouping."""
    return {
        "records": a["records"] + b["records"], "failures": a["failures"] + b["failures"],
        "trailing": b["trailing"] + F.when(b["failures"] == b["records"], a["trailing"]).otherwise(0),
        "last_ok": F.coalesce(b["last_ok"], a["last_ok"]),
    }


def before(parts: DataFrame, key: str, period: str) -> DataFrame:
    """``parts`` (a segment for each key and period) with carried and carried_ok: trailing failures and last success of all earlier periods, 0 and null in the first.

    A window by key over periods, not over records: periods in which all
    failed add up behind the last one that had a success.
    """
    w = W.partitionBy(key).orderBy(period)
    t = parts.withColumn("_island", F.count_if(F.col("failures") < F.col("records")).over(w))
    t = t.withColumn("_upto", F.sum("trailing").over(W.partitionBy(key, "_island").orderBy(period)))
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    return t.withColumn("carried", F.coalesce(F.lag("_upto").over(w), F.lit(0)).cast("long")).withColumn("carried_ok", F.last("last_ok", ignorenulls=True).over(earlier)).drop("_island", "_upto")


def streaks(log: DataFrame, key: str, period: str, order: Sequence[str], ok: str, ts: str) -> DataFrame:
    """``log`` with streak (consecutive failures so far) and last_success (``ts`` of the last success so far), as windows over the whole log give them.

    ``period``: a column that does not fall in the order, as a day. Records are
    put in order within a key's period alone.
    """
    t = _within(log, key, period, order, ok, ts)
    # what a period comes to, from the same partitioning
    ends = _ends(t, key, period, order, ok)
    carried = before(ends, key, period).select(F.col(key).alias("_key"), F.col(period).alias("_period"), "carried", "carried_ok")
    both = t.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col(period).eqNullSafe(F.col("_period")), "left")
    streak = F.col("_own") + F.when(F.col("_seen") == 0, F.col("carried")).otherwise(0)
    return both.withColumns({"streak": streak, "last_success": F.coalesce("_own_ok", "carried_ok")}).drop("_seen", "_own", "_own_ok", "_key", "_period", "carried", "carried_ok")


def resumed(parts: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """(key, consecutive_failures, last_success) after new segments (one a key) follow the state that was kept: key, consecutive_failures, last_success."""
    t = parts.join(prior.select(F.col(key).alias("_key"), F.col("consecutive_failures").alias("_f"), F.col("last_success").alias("_s")), F.col(key).eqNullSafe(F.col("_key")), "full")
    old = {"records": F.lit(0), "failures": F.lit(0), "trailing": F.coalesce("_f", F.lit(0)), "last_ok": F.col("_s")}
    new = {c: F.col(c) if c == "last_ok" else F.coalesce(c, F.lit(0)) for c in old}
    both = merged(old, new)
    return t.select(F.coalesce(key, "_key").alias(key), both["trailing"].cast("long").alias("consecutive_failures"), both["last_ok"].alias("last_success"))
