"""State files of one JSON object: sets by name, and within each set its documents by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch import schemas
from changewatch.functions import keyed
from changewatch.sources import files

_KINDS = {T.StringType(): "string", T.IntegerType(): "int", T.LongType(): "bigint", T.BooleanType(): "boolean"}


def _fields(schema: T.StructType, but: tuple[str, ...]) -> list:
    return [keyed.field("value", f"$.{f.name}", _KINDS[f.dataType]).alias(f.name) for f in schema.fields if f.name not in but]


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sets, documents) of a state file: an object of sets by name, or an array of sets with setName.

    Missing, empty and broken files have none. Fields that a record lacks, or has
    in another type, are null. Of a name or address that comes twice in an
    array, the last counts.
    """
    empty = spark.createDataFrame([], "value string")
    whole = spark.read.text(path, wholetext=True) if files.exists(spark, path) else empty
    each = keyed.entries(whole, "value", "_key", "value", "_pos").withColumn("set_name", F.coalesce("_key", keyed.field("value", "$.setName", "string"))).filter("set_name <> ''")
    last = each.groupBy("set_name").agg(F.max_by(F.struct("value"), "_pos").alias("r")).select("set_name", F.col("r.value").alias("value"))
    sets = last.select("set_name", *_fields(schemas.SET_STATE, ("set_name",)))
    inner = last.select("set_name", F.try_variant_get("value", "$.documents", "variant").alias("documents"))
    documents = keyed.entries(inner, "documents", "_key", "value", "_pos").withColumn("url", F.coalesce("_key", keyed.field("value", "$.url", "string"))).filter("url <> ''")
    latest = documents.groupBy("set_name", "url").agg(F.max_by(F.struct("value"), "_pos").alias("r")).select("set_name", "url", F.col("r.value").alias("value"))
    return sets, latest.select("set_name", "url", *_fields(schemas.DOCUMENT, ("set_name", "url")))
