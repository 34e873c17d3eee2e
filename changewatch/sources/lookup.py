"""Point lookups: tables laid out by key, so that one key's rows are found without reading the others.

Rows are dealt into a fixed number of folders by a hash of the key and sorted by
it within their files. A lookup names its folder, which prunes all others before
any file is opened, and the key itself is pushed down to the sorted row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder's column, beside the table's own.
BUCKET = "_bucket"


def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Lay out ``rows`` for lookups by ``key`` (of strings). ``buckets`` should keep a folder to a few files; a null key has a folder like any other."""
    t = rows.withColumn(BUCKET, _bucket(F.col(key), buckets))
    t.repartition(BUCKET).sortWithinPartitions(BUCKET, key).write.partitionBy(BUCKET).mode("errorifexists").parquet(path)


def find(spark: SparkSession, path: str, key: str, wanted: Sequence[str], buckets: int = 64) -> DataFrame:
    """The rows of a few keys: only their folders are listed as input, and within them the keys are pushed down."""
    numbers = sorted({r["b"] for r in spark.createDataFrame([(w,) for w in wanted], "k string").select(_bucket(F.col("k"), buckets).alias("b")).collect()})
    return spark.read.parquet(path).filter(F.col(BUCKET).isin(*numbers) & F.col(key).isin(*wanted)).drop(BUCKET)
