"""The index of an archive, kept up to date by reading new files alone.

A stream over the archive's folder takes what is new since the last call and
stops (``availableNow``); its checkpoint knows which files it has seen. Each
batch writes its records to a folder of its own number, so that a batch that is
run again after a crash replaces what it wrote. Analyses are read; of snapshots and diffs only the
names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changewatch.functions import text as X
from changewatch.operators import reports
from changewatch.sources import files

#: A file of the archive, and what an analysis says.
FILE = "file_id string, stamp string, ts timestamp, kind string, path string, priority string, verdict string, summary string, changed_documents array<string>"
_SAID = "priority string, verdict string, summary string, changed_documents array<string>"


def _records(found: DataFrame) -> DataFrame:
    t = found.select("text", "file_name", *(F.regexp_extract("file_name", reports.ARCHIVE, i + 1).alias(n) for i, n in enumerate(("file_id", "stamp", "kind"))))
    t = t.withColumn("ts", X.parse_stamp(F.col("stamp"))).filter("ts IS NOT NULL").withColumn("b", F.from_json("text", _SAID))
    return t.select("file_id", "stamp", "ts", "kind", F.concat(F.lit("logs/"), "file_name").alias("path"), *(F.col(f"b.{c}").alias(c) for c in ("priority", "verdict", "summary", "changed_documents")))


def update(spark: SparkSession, folder: str, root: str) -> int:
    """Take the new files of ``folder`` into the index below ``root``; returns how many files were read."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name")
    analyses = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*_analysis.json").load(folder).select(name, F.col("value").alias("text"))
    # contents are not among the columns, so these files are listed and not opened
    others = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit(None).cast("string").alias("text"))
    seen = 0
    for which, stream in (("analyses", analyses), ("others", others)):

        def write(batch: DataFrame, number: int, which: str = which) -> None:
            _records(batch).write.mode("overwrite").parquet(f"{root}/{which}/batch={number:09d}")

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoints/{which}").trigger(availableNow=True).start()
        query.awaitTermination()
        seen += sum(p["numInputRows"] for p in query.recentProgress)
    return seen


def read(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """A record for each archived analysis, as ``reports.history_records`` makes them from the whole archive."""
    there = [f"{root}/{which}" for which in ("analyses", "others") if files.exists(spark, f"{root}/{which}/batch=*")]
    schema = spark.createDataFrame([], FILE).schema
    t = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*there) if there else spark.createDataFrame([], schema)
    if known is not None:
        t = t.join(known, "file_id", "left_semi")
    path = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path")))
    said = F.max_by(F.struct("priority", "verdict", "summary", "changed_documents"), F.when(F.col("kind") == "analysis.json", F.col("path")))
    records = t.groupBy("file_id", "stamp", "ts").agg(path("analysis.json").alias("analysis_path"), path("snapshot.txt").alias("snapshot_path"), path("diff.txt").alias("diff_path"), said.alias("b")).filter("analysis_path IS NOT NULL")
    return records.select("file_id", "stamp", "ts", "analysis_path", "snapshot_path", "diff_path", *(F.col(f"b.{c}").alias(c) for c in ("priority", "verdict", "summary", "changed_documents")))
