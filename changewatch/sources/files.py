"""Readers and writers of a monitoring run's files.

Readers take explicit schemas: records of documents and of sets have
different keys, and nothing is inferred. A missing path gives an empty frame.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch import schemas
from changewatch.operators import reports, state


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any file of a pattern, is there; in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON. Missing and unreadable files give no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True).filter(F.try_parse_json("value").isNotNull())
    return whole.select(F.from_json("value", schema).alias("j")).select("j.*")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; none if there are none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a run log; blank and broken lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.RUN_LOG)
    return spark.read.schema(schemas.RUN_LOG).option("mode", "DROPMALFORMED").json(path)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """Usable set definitions of a JSON array file, with their place in it."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("pos", T.IntegerType()), *schemas.POLICY_SET.fields]))
    whole = spark.read.text(path, wholetext=True)
    raw = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw"))
    t = raw.select("pos", F.from_json("raw", schemas.POLICY_SET).alias("s")).select("pos", "s.*")
    return state.valid_sets(t)


def archive_names(spark: SparkSession, path: str) -> DataFrame:
    """(file_name) of every file below a folder, without reading any."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file_name string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


def write_run_log(records: DataFrame, path: str) -> None:
    """Append a run's records, a folder for each day, so that retention is dropping folders."""
    records.withColumn("day", F.to_date(F.col("timestamp").try_cast("timestamp"))).write.mode("append").partitionBy("day").parquet(path)


def prune_run_log(spark: SparkSession, path: str, now: str, days: int) -> int:
    """Drop the folders of days past retention; returns how many. Records without a time stay."""
    import datetime

    oldest = datetime.datetime.fromisoformat(now.replace("Z", "+00:00")).date() - datetime.timedelta(days=days)
    p, fs = _path(spark, f"{path}/day=*")
    dropped = 0
    for f in fs.globStatus(p) or []:
        day = f.getPath().getName().removeprefix("day=")
        if day[:4].isdigit() and datetime.date.fromisoformat(day) < oldest:
            dropped += bool(fs.delete(f.getPath(), True))
    return dropped


def retain_run_log(spark: SparkSession, path: str, now: str, days: int) -> DataFrame:
    """The records of a run log that are within retention."""
    return reports.recent(spark.read.parquet(path), now, days)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def home_of(root: str, run_id: str) -> str:
    return f"{root}/runs/{run_id}"


def keep(spark: SparkSession, frame: DataFrame, root: str, run_id: str, name: str) -> DataFrame:
    """Write one of a run's tables and read it back: whatever reads it later sees what was written, also if executors are lost."""
    path = f"{home_of(root, run_id)}/{name}"
    frame.write.mode("errorifexists").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def publish(spark: SparkSession, root: str, run_id: str, base: int | None = None) -> str:
    """Make a run's folder the current one; returns it.

    Every publication is a new empty file, whose name has the next number and
    the run; the greatest number counts. Nothing is deleted or replaced, so at
    every moment readers see the run before or this one. A number is claimed
    first, by a file that only one run can create. A run may die at any step:
    a claim without a publication is passed over by the next run, which takes a
    greater number. ``base``: the number that the run's state was read at.
    Raises OSError if another run was published since then, or claimed a number
    before this one was published, since this run would undo that one.
    """
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"not a name of a folder: {run_id!r}")
    meanwhile = f"another run of {root} was published meanwhile"
    found = number(spark, root)
    if base is not None and found != base:
        raise OSError(meanwhile)
    mine = max([found, *_claimed(spark, root)]) + 1
    claim, fs = _path(spark, f"{root}/claims/{mine:012d}")
    # creating it fails if it is there, so the number alone decides who was first
    if not fs.createNewFile(claim) or max(_claimed(spark, root)) > mine or number(spark, root) != found:
        raise OSError(meanwhile)
    pointer, _ = _path(spark, f"{root}/published/{mine:012d}-{run_id}")
    fs.create(pointer, False).close()
    return home_of(root, run_id)


def _claimed(spark: SparkSession, root: str) -> list[int]:
    p, fs = _path(spark, f"{root}/claims/*")
    return [int(f.getPath().getName()) for f in fs.globStatus(p) or []]


def published(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, run) of every publication: one name for each run, without its contents."""
    p, fs = _path(spark, f"{root}/published/*")
    found = fs.globStatus(p) or []
    return [(int(n), run_id) for n, _, run_id in (f.getPath().getName().partition("-") for f in found)]


def number(spark: SparkSession, root: str) -> int:
    """The number of the current run; 0 before the first."""
    return max((n for n, _ in published(spark, root)), default=0)


def folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, milliseconds of its last change) of the folders in a folder."""
    p, fs = _path(spark, f"{path}/*")
    return [(f.getPath().getName(), f.getModificationTime()) for f in fs.globStatus(p) or [] if f.isDirectory()]


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder and all below it; False if it was not there."""
    p, fs = _path(spark, path)
    return bool(fs.delete(p, True))


def commit(spark: SparkSession, frames: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Write a run's tables under one new folder, then publish it: readers see the run before or this one, never a mixture."""
    for name, frame in frames.items():
        keep(spark, frame, root, run_id, name)
    return publish(spark, root, run_id)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the run that was published last; None before the first."""
    found = published(spark, root)
    return home_of(root, max(found)[1]) if found else None


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def alert_markdown(alerts: DataFrame, overall: str, generated_at: str) -> DataFrame:
    """(line) of an alert in order, for ``write_lines``: a heading, then a row for each alert by set, address and kind. No rows without alerts."""
    rows = reports.alert_rows(alerts).select(F.lit(1).alias("_part"), F.lit(0).alias("_n"), "set_name", "url", "kind", F.col("row").alias("line"))
    head = ["Some sources need attention.", "", f"Generated: {generated_at}", f"Overall status: **{overall}**", "", "| Source | Document | Problem | Consecutive failures |", "| --- | --- | --- | --- |"]
    lines = F.posexplode(F.array(*map(F.lit, head))).alias("_n", "line")
    heading = rows.limit(1).select(F.lit(0).alias("_part"), lines).select("_part", "_n", F.lit("").alias("set_name"), F.lit("").alias("url"), F.lit("").alias("kind"), "line")
    return heading.unionByName(rows).orderBy("_part", "_n", "set_name", "url", "kind").select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered lines as text: part files, in the order of their names."""
    lines.write.mode("overwrite").text(path)


def paths(file_id: str, doc_id: str | None = None, stamp: str | None = None) -> dict[str, str]:
    """Where a set's artefacts go."""
    out = {"analysis": f"analysis/{file_id}.json", "snapshot": f"snapshots/{file_id}.txt", "diff": f"diffs/{file_id}.diff"}
    if doc_id:
        out["document"] = f"snapshots/{file_id}/{doc_id}.txt"
    if stamp:
        out |= {f"archived_{k}": f"logs/{file_id}_{stamp}_{v}" for k, v in (("analysis", "analysis.json"), ("snapshot", "snapshot.txt"), ("diff", "diff.txt"))}
    return out
