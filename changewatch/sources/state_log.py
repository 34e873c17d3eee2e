"""A run's tables as files: a folder for each run with the rows that it changed, a base now and then with all of them.

Runs are numbered by their publication (``files.publish``), and a row's version
is its run's number, so readers of a number see the runs up to it and none that
died. A reader starts at the last base. ``compact`` writes a base; ``expire``
deletes folders that readers of the last few versions no longer open.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch.operators import versions
from changewatch.sources import files

#: What the ids of bases begin with.
BASE = "base-"


def opened(spark: SparkSession, root: str, at: int | None) -> list[tuple[int, str]]:
    """(number, run) that a reader of version ``at`` opens: from the last base on."""
    runs = sorted(p for p in files.published(spark, root) if at is None or p[0] <= at)
    first = max((i for i, (_, run_id) in enumerate(runs) if run_id.startswith(BASE)), default=0)
    return runs[first:]


def read(spark: SparkSession, root: str, table: str, schema: T.StructType, at: int | None = None) -> DataFrame:
    """The log of a table, with version and deleted; empty before the first run. No file is opened for it until it is used."""
    whole = T.StructType([*schema.fields, T.StructField("deleted", T.BooleanType())])
    numbers = {run_id: n for n, run_id in opened(spark, root, at) if files.exists(spark, f"{files.home_of(root, run_id)}/{table}")}
    if not numbers:
        return spark.createDataFrame([], T.StructType([*whole.fields, T.StructField("version", T.LongType())]))
    rows = spark.read.schema(whole).parquet(*(f"{files.home_of(root, r)}/{table}" for r in numbers))
    run_of = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([^/]+)/[^/]+/[^/]+$", 1)
    number = F.create_map(*(F.lit(x) for r, n in numbers.items() for x in (r, n)))
    return rows.select(*schema.names, "deleted", number[run_of].cast("long").alias("version"))


def append(spark: SparkSession, rows: DataFrame, root: str, run_id: str, table: str) -> DataFrame:
    """Write the rows of a table that a run changed; returns them, without ``deleted`` if they had none."""
    whole = rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False))
    return files.keep(spark, whole, root, run_id, table).select(*rows.columns)


def compact(spark: SparkSession, root: str, tables: dict[str, tuple[T.StructType, Sequence[str]]], run_id: str, within: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> str:
    """Publish a base: each table as it is now, so that readers open no earlier run. Returns its folder.

    ``tables``: schema and keys by name; keys that stand for several rows, as
    parts of a text, are resolved as ``versions.latest_groups`` does.
    ``within``: what is within retention, for tables that have one.
    """
    number = files.number(spark, root)
    for name, (schema, keys) in tables.items():
        now = versions.latest_groups(read(spark, root, name, schema, number), keys)
        append(spark, (within or {}).get(name, lambda t: t)(now), root, BASE + run_id, name)
    return files.publish(spark, root, BASE + run_id, base=number)


def expire(spark: SparkSession, root: str, keep: int = 2, dead_after_hours: float = 48) -> list[str]:
    """Delete the folders of runs that readers of the last ``keep`` versions do not open, and those of runs that died long ago; returns their ids."""
    runs = sorted(files.published(spark, root))
    if not runs:
        return []
    oldest = runs[max(len(runs) - keep, 0)][0]
    first = min(n for n, _ in opened(spark, root, oldest))
    old = [run_id for n, run_id in runs if n < first]
    named = {run_id for _, run_id in runs}
    since = (time.time() - dead_after_hours * 3600) * 1000
    dead = [run_id for run_id, changed in files.folders(spark, f"{root}/runs") if run_id not in named and changed < since]
    return [run_id for run_id in (*old, *dead) if files.remove(spark, files.home_of(root, run_id))]
