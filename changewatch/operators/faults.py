"""Errors as data: what fails on a row is a value of that row, and it costs its own set the run, no other.

Functions on batches (``functions.faults``) return (value, error) and never raise, so that one
poisoned text does not fail a task, its retries and the whole job. Sets with an
error go to a quarantine and keep their state; all others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SET_FAILED = "set_failed"


def quarantine(*found: DataFrame) -> DataFrame:
    """(set_name, url, step, error): all errors of the steps of a run; each frame has set_name, url, step and error, null where all is well."""
    rows = [f.filter("error IS NOT NULL").select("set_name", "url", "step", "error") for f in found]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def sound(rows: DataFrame, quarantined: DataFrame, by: str = "set_name") -> DataFrame:
    """The rows of sets without an error. Only the names of failed sets are moved; null names are a set."""
    bad = quarantined.select(F.col(by).alias("_bad")).distinct()
    return rows.join(bad, F.col(by).eqNullSafe(F.col("_bad")), "left_anti")


def failed_sets(quarantined: DataFrame) -> DataFrame:
    """(set_name, faults, url, step, error): of each failed set how many errors it had, and the first by address and step."""
    first = F.min(F.struct(F.coalesce("url", F.lit("")).alias("url"), "step", "error"))
    return quarantined.groupBy("set_name").agg(F.count(F.lit(1)).alias("faults"), first.alias("f")).select("set_name", "faults", "f.url", "f.step", "f.error")


def alerts(quarantined: DataFrame) -> DataFrame:
    """An alert for each failed set, as ``reports.alerts`` has them."""
    detail = F.concat(F.lit("not checked in this run: "), "step", F.lit(": "), "error", F.when(F.col("faults") > 1, F.concat(F.lit(" (and "), F.col("faults") - 1, F.lit(" more)"))).otherwise(""))
    return failed_sets(quarantined).select(F.lit(SET_FAILED).alias("kind"), "set_name", "url", F.col("faults").alias("failures"), detail.alias("detail"))
