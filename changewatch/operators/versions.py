"""State as a log of versions: each run adds the rows that it changed; what holds at a version is worked out when it is read.

A log has the columns of its table, ``version`` (the run's number) and
``deleted``. A run writes a key at most once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _upto(log: DataFrame, at: int | None) -> DataFrame:
    return log if at is None else log.filter(F.col("version") <= at)


def latest(log: DataFrame, keys: Sequence[str], at: int | None = None) -> DataFrame:
    """The table as it is at version ``at`` (None: now): of each key its last row, unless that deletes it.

    One aggregate with map-side combining: of a key's many versions one row a
    task is moved. Null keys are keys.
    """
    rest = [c for c in log.columns if c not in keys]
    rows = _upto(log, at).groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
    return rows.select(*keys, "_row.*").filter("NOT deleted").drop("version", "deleted")


def latest_groups(log: DataFrame, keys: Sequence[str], at: int | None = None) -> DataFrame:
    """As ``latest`` where a run replaces all rows of a key together, as the numbered parts of a text: all rows of the key's last version.

    Only keys and versions are aggregated; texts of versions that lost are not moved.
    """
    rows = _upto(log, at)
    last = rows.groupBy(*keys).agg(F.max("version").alias("_last")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_last")
    same = F.col("version") == F.col("_last")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same, "left_semi").filter("NOT deleted").drop("version", "deleted")


def changes(current: DataFrame, before: DataFrame, keys: Sequence[str], *, gone: bool = False) -> DataFrame:
    """The rows that a run adds to a log: those of ``current`` that are new or differ in any column from ``before``, with ``deleted`` false.

    ``gone``: keys that ``current`` lacks are deleted; else they stay as they are.
    """
    rest = [c for c in current.columns if c not in keys]
    old = before.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*rest).alias("_old"))
    new = current.select(*keys, F.struct(*rest).alias("_new"))
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = c if same is None else same & c
    both = new.join(old, same, "full" if gone else "left").filter(~F.col("_new").eqNullSafe(F.col("_old")))
    lost = F.col("_new").isNull()
    return both.select(*(F.when(lost, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys), F.coalesce("_new", "_old").alias("_row"), lost.alias("deleted")).select(*keys, "_row.*", "deleted")


def expired(log: DataFrame, keys: Sequence[str], oldest: int) -> DataFrame:
    """The rows of a log that no reader of version ``oldest`` or a later one needs: those replaced by then, and deletions that nothing earlier needs."""
    after = F.lead("version").over(W.partitionBy(*keys).orderBy("version"))
    t = log.withColumn("_after", after)
    return t.filter((F.coalesce(F.col("_after") <= oldest, F.lit(False))) | (F.col("deleted") & (F.col("version") <= oldest))).drop("_after")
