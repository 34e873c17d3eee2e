"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if no shared folder is named and all runs on one machine (tests).
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where the master is local. Raises ValueError on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores: dealt out anew only where it has fewer partitions, as a table of one small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Table:
    """A DataFrame written as Parquet in the shared folder, so that its lineage ends there.

    Unlike a local checkpoint it survives the loss of any executor. ``drop()``
    deletes the files; call it only once nothing lazy reads them any more.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/changewatch-{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def beside(docs: DataFrame, keep: Sequence[str], column: str) -> DataFrame:
    """The columns ``keep``, then ``column``, under names of their own (k0, k1, ..., value), so that no two clash."""
    return docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), F.col(f"`{column}`").alias("value"))


def by_bytes(batches: Iterable[pa.RecordBatch], column: int | str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches so that each slice holds about ``limit`` bytes of the texts of ``column``; nulls read as ''.

    ``column`` is a name, or a place where names may clash. A single longer
    text makes a slice of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield _texts(batch.slice(start, i - start), column)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield _texts(batch.slice(start), column)


def _texts(batch: pa.RecordBatch, column: int | str) -> tuple[pa.RecordBatch, list[str]]:
    return batch, [t or "" for t in batch.column(column).to_pylist()]
