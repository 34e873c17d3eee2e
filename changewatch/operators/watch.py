"""Many watched terms at once: terms meet texts by a join on trigrams, not as a plan with a branch for each.

Every term is filed under the one of its five-letter pieces that the fewest
other terms have, or under itself if it is shorter. A text comes to its
different pieces; an equi-join finds the terms filed under any of them, and only
those are searched in it. The plan is the same for five terms and for fifty
thousand. Terms and texts are folded alike before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewatch.functions import text as X

#: Letters of a piece; terms that are shorter are filed whole, under pieces of their own length.
PIECE = 5
#: An index up to this many bytes is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def _pieces(folded: str, lengths: Sequence[int] = (PIECE,)) -> Column:
    """The different pieces of a text. A search that looks ahead finds those that overlap, too, in one pass for each length."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(folded, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in lengths)))


def index(terms: DataFrame, term: str = "term") -> DataFrame:
    """(piece, folded, term): each different term under its rarest piece. Null and empty terms are left out."""
    t = terms.select(F.col(term).alias("term")).filter("term <> ''").distinct().withColumn("folded", X.fold(F.col("term")))
    short = F.length("folded") < PIECE
    each = t.filter(~short).select("term", "folded", F.explode(_pieces("folded")).alias("piece"))
    common = each.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    filed = each.join(common, "piece").groupBy("term", "folded").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return filed.unionByName(t.filter(short).select("term", "folded", F.col("folded").alias("piece"))).select("piece", "folded", "term")


def index_of(spark: SparkSession, terms: Sequence[str]) -> DataFrame:
    """``index`` of a list."""
    return index(spark.createDataFrame([(t,) for t in terms], "term string"))


def hits(texts: DataFrame, terms: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, term): the terms of an ``index`` that a text holds, folded. ``keys`` must tell texts apart; null texts hold none.

    Only keys and pieces are exploded, never texts. An index that measures as
    small is sent to all tasks, so pieces meet it where they are; a larger one
    is joined by shuffle. A text is moved if a term is filed under one of its
    pieces, and then searched for that term alone.
    """
    size = terms.agg(F.sum(F.octet_length("piece") + F.octet_length("folded") + F.octet_length("term") + 64).alias("b")).first()["b"] or 0
    lengths = sorted({PIECE} | {r["n"] for r in terms.select(F.length("piece").alias("n")).distinct().collect()})  # of one to five
    t = texts.filter(F.col(text).isNotNull()).select(*keys, X.fold(F.col(text)).alias("_folded"))
    pieces = t.select(*keys, F.explode(_pieces("_folded", lengths)).alias("piece"))
    near = pieces.join(F.broadcast(terms) if size <= BROADCAST_BYTES else terms, "piece").select(*keys, "folded", "term")
    return near.join(t, list(keys)).filter(F.contains("_folded", "folded")).select(*keys, "term")


def tags(texts: DataFrame, terms: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, tags): for every text its watchlist tags in order of their terms, as ``diffs.watch_tags`` gives them; an empty array where there are none."""
    found = hits(texts, terms, keys, text).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set("term")), lambda t: F.concat(F.lit("watchlist:"), t)).alias("tags"))
    return texts.select(*keys).join(found, list(keys), "left").select(*keys, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
