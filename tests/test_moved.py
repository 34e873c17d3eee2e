"""Changed documents: their texts are fetched once, and hardly any other is; large row groups are dealt out; long texts are held once."""

from pyspark.sql import functions as F

from changewatch.operators import gates, ordered
from changewatch.plans import scenario as C

from conftest import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_fetch_has_what_classify_and_changed_have(spark):
    captures, prior = C.captures(spark, SF), C.prior(spark, SF)
    want = gates.changed(gates.classify(captures, prior, C.CFG), captures, prior)
    got = C.changed(spark, SF)
    assert set(got.columns) == set(want.columns)
    assert rows(got.select(*want.columns)) == rows(want) != []
    assert rows(gates.moved(captures, prior, C.CFG).select(*want.columns)) == rows(want)


def test_texts_are_fetched_once(spark):
    spark.catalog.clearCache()
    held = C.changed(spark, SF)._jdf.queryExecution().withCachedData().collectLeaves()
    kinds = [held.apply(i).getClass().getSimpleName() for i in range(held.length())]
    assert kinds.count("LogicalRelation") == 2 and "InMemoryRelation" in kinds


def test_texts_that_are_not_asked_for_are_dropped_where_they_are_read(spark):
    texts = spark.range(20_000).select(F.lit("s").alias("set_name"), F.concat(F.lit("u"), "id").alias("url"), F.col("id"))
    keys = texts.filter("id % 100 = 3").select(*gates.KEYS)
    got = {r["id"] for r in gates.marked(texts, keys).collect()}
    assert {r["id"] for r in texts.filter("id % 100 = 3").collect()} <= got and len(got) < 220
    assert gates.marked(texts, keys.limit(0)).count() == 0


def test_same_lines_by_any_line_end(spark):
    cases = [("", "", True), ("a", "a\n", True), ("a\n\n", "a\n", False), ("a\x85b", "a\nb ", True), ("a \x1cb", "a\n\x1eb", True), ("a", "b", False), ("\n", "", True), ("a\r", "a", False)]
    t = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = t.select("i", gates.same_lines(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [w for *_, w in cases]


def test_a_file_of_one_row_group_is_dealt_out(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        t = C.table(spark, SF, "documents")
        assert t.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in C.spread(t).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == t.count() and max(sizes) * 2 < sum(sizes)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_row_that_is_spread_already_is_not_moved(spark):
    t = spark.range(0, 1000, 1, 8)
    assert C.spread(t) is t


def test_long_texts_of_many_letters_join_whole(spark):
    t = spark.range(3000).select(F.lit("s").alias("g"), F.lpad(F.col("id").cast("string"), 5, "0").alias("o"), F.concat(F.lit("ж€😀 "), F.col("id"), F.repeat(F.lit("x"), 500)).alias("v"))
    t = t.unionByName(spark.createDataFrame([("s", "00000a", None), (None, "1", "alone"), ("e", "1", "")], "g string, o string, v string"))
    text = "--".join(["ж€😀 0" + "x" * 500, ""] + ["ж€😀 %d" % i + "x" * 500 for i in range(1, 3000)])
    got = {r["g"]: r["c"] for r in ordered.joined(t, ["g"], ["o"], "v", sep="--", name="c").collect()}
    assert got == {"s": text, None: "alone", "e": ""}
    cut = {r["g"]: r["c"] for r in ordered.joined(t, ["g"], ["o"], "v", sep="--", name="c", limit=11, note="!").collect()}
    assert cut == {"s": text.encode()[:11].decode("utf-8", "ignore") + "!", None: "alone", "e": ""}
