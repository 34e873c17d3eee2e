"""Noise of sources as a table: which patterns are removed from whose texts is data, not a plan.

A table (host, no, pattern) is gathered to a row for each host, texts meet it by
an equi-join on their host, and a fold over the array removes one pattern after
the other where the text is. Ten hosts or ten thousand give the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A gathered table up to this many bytes is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def gathered(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, patterns), (everywhere) of one row): each host's patterns in their order; those of a null host are for all.

    Null and empty patterns are left out. A host's patterns must fit in a row.
    """
    some = patterns.filter("pattern <> ''")
    inner = lambda t: F.transform(F.array_sort(F.collect_list(F.struct("no", "pattern"))), lambda x: x["pattern"])
    by_host = some.filter("host IS NOT NULL").groupBy("host").agg(inner(some).alias("_own"))
    return by_host, some.filter("host IS NULL").agg(inner(some).alias("_all"))


def removed(texts: DataFrame, patterns: DataFrame, host: str, text: str) -> DataFrame:
    """``texts`` with ``text`` without what the patterns match, line by line (multi-line mode), those for all hosts first. Null texts stay null; a null host has the patterns for all."""
    by_host, everywhere = gathered(patterns)
    size = by_host.agg(F.sum(F.octet_length("host") + F.aggregate("_own", F.lit(64), lambda n, p: n + F.octet_length(p) + 16)).alias("b")).first()["b"] or 0
    own = by_host.withColumnRenamed("host", "_host")
    t = texts.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, F.col(host) == F.col("_host"), "left").crossJoin(F.broadcast(everywhere))
    return t.withColumn(text, without(F.col(text), F.concat("_all", F.coalesce("_own", F.array().cast("array<string>"))))).drop("_host", "_own", "_all")


def without(text: Column, patterns: Column) -> Column:
    """A text without what any of an array of patterns matches, one after the other."""
    return F.aggregate(patterns, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit("(?m)"), p), F.lit("")))
