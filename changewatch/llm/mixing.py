"""Mixing sources to target weights by Pareto order sampling (Rosen 1997).

A source's share of all words is its weight's, but no more than ``most``
copies of what it has; what that leaves over goes to the others by weight.
Each document of a source then expects e copies. Its whole copies are
certain. For the fraction p left, documents are ranked by random odds
divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the first are
taken until the source has its words; one more document closes the gap.

All this comes to a few numbers for each source: the shares, and the rank at
which it ends. They are found from counts by (source, 4096 classes of rank)
and the rows of one class, so no task sees all rows of a source. Whether and
how often a document is taken is then an expression over its own row and its
source's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changewatch.llm.common import Table

CLASSES = 4096
#: Half of the words at which a document's preference is one half, in words.
HALF = 256


def n_words(text: str | Column) -> Column:
    """Runs of characters other than the space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size, tilt, target): the water-filling over a table of one row a source.

    Sources are ordered by code point, null last, and weigh ``weights`` in
    turn. Filling goes by most copies a unit of weight: a source is full if
    its share of what fuller ones leave would exceed its limit. Sums are of
    whole numbers, so the result does not depend on their order.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * preference()).alias("tilt"))
    # one row for each source from here on, in one task: a dimension, not the documents
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights)).cast("int") + 1).cast("long")
    cap = F.col("source_size") * most
    by_ratio = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    t = per_source.withColumn("weight", weight).withColumn("cap", cap)
    t = t.withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("rest", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = F.col("cap").cast("decimal(38,0)") * F.col("rest").cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * F.col("left").cast("decimal(38,0)")
    t = t.withColumn("full", full)
    of = lambda what: F.sum(what).over(everyone)
    open_words = of("source_size") - F.coalesce(of(F.when(F.col("full"), F.col("cap"))), F.lit(0))
    open_weight = F.coalesce(of(F.when(~F.col("full"), F.col("weight"))), F.lit(0))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("weight") * open_words).cast("double") / open_weight.cast("double"))
    return t.withColumn("target", target).select("source", "source_size", "tilt", "target")


def preference() -> Column:
    """0 to 999, higher for longer documents, a whole number so that its sums are exact."""
    return F.floor(1000 * F.col("size") / (F.col("size") + HALF)).cast("long")


def uniform(salt: str) -> Column:
    """A number between 0 and 1 that depends on the id alone."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(salt)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def expected(most: int) -> Column:
    """Copies that a document expects: its source's ratio f, tilted towards longer documents by at most half the way to 0 or ``most``."""
    f = F.col("target") / F.col("source_size")
    tilt = (preference() - F.col("tilt") / F.col("source_size")) / F.lit(1000.0)
    e = f + F.lit(0.5) * F.least(f, F.lit(float(most)) - f) * tilt
    return F.when(F.col("source_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), e))).otherwise(F.lit(0.0))


def _key() -> Column:
    """A document's id as a string of its own for each id, and for null."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))


def _drawn(docs: DataFrame, of_source: DataFrame, most: int, salt: str) -> DataFrame:
    """``docs`` (source, doc_id, size) with its source's numbers, sure (whole copies), p and z, the Pareto rank from 0 to 1."""
    of_source = of_source.withColumnRenamed("source", "_source")
    t = docs.join(of_source, docs["source"].eqNullSafe(of_source["_source"]), "left").drop("_source")
    t = t.withColumn("_e", expected(most)).withColumn("sure", F.floor("_e").cast("long")).withColumn("p", F.col("_e") - F.col("sure"))
    t = t.withColumn("_u", uniform(salt))
    q = (F.col("_u") / (1 - F.col("_u"))) * ((1 - F.col("p")) / F.col("p"))
    return t.withColumn("z", F.when((F.col("p") > 0) & (F.col("size") > 0), q / (1 + q))).drop("_e", "_u")


def plan(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, salt: str = ":mix") -> DataFrame:
    """One row a source: source, source_size, tilt, target, and where its sample ends (cut_z, cut_id, cut_size, and the closing document's close_id, close_size).

    ``sizes`` has doc_id (of any type that casts to string), source and size,
    and is read several times. A null doc_id has the rank of the id 'null'.
    Rows of equal rank, id and size are taken together.
    """
    base_table = Table(shares(sizes, weights, most), "shares")
    base = base_table.df
    drawn_table = Table(_drawn(sizes.select("doc_id", "source", "size"), base, most, salt).select("doc_id", "source", "size", "sure", "z", "target"), "drawn")
    drawn = drawn_table.df
    level = F.least(F.lit(CLASSES - 1), F.floor(F.col("z") * CLASSES)).cast("int")
    by_level = drawn.groupBy("source", level.alias("level")).agg(F.sum("size").alias("words"), F.sum(F.col("sure") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    # at most CLASSES + 1 rows for each source
    whole = W.partitionBy("source")
    room = F.col("target") - F.sum("certain").over(whole)
    run = F.sum(F.when(F.col("level").isNotNull(), F.col("words")).otherwise(0)).over(whole.orderBy(F.col("level").asc_nulls_first()))
    t = by_level.withColumn("room", room).withColumn("upto", run)
    t = t.filter("level is not null").withColumn("before", F.col("upto") - F.col("words"))
    # the first class that the room does not hold whole
    edge = t.filter(F.col("upto") > F.col("room")).groupBy("source").agg(F.min(F.struct("level", "before", "room")).alias("e")).select(F.col("source").alias("_source"), F.col("e.level").alias("level"), F.col("e.before").alias("before"), F.col("e.room").alias("room"))
    edge_table = Table(edge, "edge")
    edge = edge_table.df
    inner = drawn.filter("z is not null").withColumn("_level", level).join(edge, drawn["source"].eqNullSafe(edge["_source"])).drop("_source")
    # rows of one rank class of each source; those of equal rank, id and size count together
    at_edge = inner.filter("_level = level").groupBy("source", "z", "doc_id", "size").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("room").alias("room"))
    upto = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("z", _key(), "size"))
    fits = at_edge.withColumn("upto", upto).filter(F.col("upto") <= F.col("room"))
    last = fits.groupBy("source").agg(F.max(F.struct("z", _key().alias("doc_id"), "size", "upto")).alias("c")).withColumnRenamed("source", "_s")
    cut_table = Table(edge.join(last, edge["_source"].eqNullSafe(last["_s"]), "left").select("_source", F.coalesce("c.z", F.col("level") / F.lit(float(CLASSES)) - F.lit(1e-12)).alias("cut_z"), F.coalesce("c.doc_id", F.lit("")).alias("cut_id"), F.coalesce("c.size", F.lit(-1)).alias("cut_size"), (F.col("room") - F.coalesce("c.upto", F.col("before"))).alias("gap")), "cut")
    cut = cut_table.df
    rest = drawn.filter("z is not null").join(cut, drawn["source"].eqNullSafe(cut["_source"])).filter(~_inside())
    miss = F.abs(F.col("size") - F.col("gap"))
    close = rest.filter(miss < F.col("gap")).groupBy("_source").agg(F.min(F.struct(miss.alias("miss"), "z", _key().alias("doc_id"), "size")).alias("c")).select(F.col("_source").alias("_s"), F.col("c.doc_id").alias("close_id"), F.col("c.size").alias("close_size"))
    out = base.join(cut.drop("gap"), base["source"].eqNullSafe(cut["_source"]), "left")
    planned = Table(out.join(close, out["source"].eqNullSafe(close["_s"]), "left").drop("_source", "_s"), "plan").df
    for t in (base_table, drawn_table, edge_table, cut_table):
        t.drop()
    return planned


def _inside() -> Column:
    """Whether a row's rank is at or before its source's cut; a source without a cut takes all."""
    i = _key()
    return (F.col("z") < F.col("cut_z")) | ((F.col("z") == F.col("cut_z")) & ((i < F.col("cut_id")) | ((i == F.col("cut_id")) & (F.col("size") <= F.col("cut_size")))))


def copies(docs: DataFrame, planned: DataFrame, most: int = 3, salt: str = ":mix") -> DataFrame:
    """``docs`` (doc_id, source, size and more) with source_size, target and copies (long, 0 to ``most``)."""
    t = _drawn(docs, planned, most, salt)
    closing = (_key() == F.col("close_id")) & (F.col("size") == F.col("close_size"))
    picked = F.col("z").isNotNull() & (F.col("cut_z").isNull() | _inside() | F.coalesce(closing, F.lit(False)))
    return t.withColumn("copies", F.col("sure") + F.coalesce(picked, F.lit(False)).cast("long")).drop("sure", "p", "z", "tilt", "cut_z", "cut_id", "cut_size", "close_id", "close_size")


def sizes_of(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, salt: str = ":mix", **names: str) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target (its source's), copies and taken (copies times size).

    Sizes are words of whole texts, 0 for null and empty ones, which are never
    taken for their words. A null source is one source, the last. Reruns
    agree: chance depends on ids alone. A source without words has the target
    0. Repeated rows share their fate, so a source of many exact repeats may
    miss its target by as many. An empty table gives an empty result; other
    columns are not read.
    """
    sizes = Table(sizes_of(docs, **names), "sizes").df
    out = copies(sizes, plan(sizes, weights, most, salt), most, salt)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def resample(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, salt: str = ":mix") -> DataFrame:
    """``docs`` (with doc_id, source, text) with each row repeated as often as the mix takes it: same columns."""
    sizes = Table(sizes_of(docs), "sizes").df
    planned = plan(sizes, weights, most, salt)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    keyed = kept.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), n_words(F.col("_row.text")).alias("size"))
    out = copies(keyed, planned, most, salt).filter("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
