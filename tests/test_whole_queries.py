"""Queries that must do the whole job: over whole texts, all sets and all sources."""

from pyspark.sql import functions as F

from changewatch.plans import registry
from changewatch.plans.queries import _places
from conftest import SF
from test_queries import duck  # noqa: F401


def test_tags_after_the_four_hundredth_character(spark, tmp_path):
    t = spark.createDataFrame([(6, "x " * 300 + "$7 within 9 days; arbitration" + " x" * 300), (14, None)], "doc_id long, text string")
    t.write.parquet(f"{tmp_path}/documents.parquet")
    tags = lambda name: {r["doc_id"]: r["tags"] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert {"money", "duration"} <= set(tags("fingerprint_tags")[6].split(",")) and tags("fingerprint_tags")[14] == ""
    assert tags("watchlist_hits") == {6: "watchlist:arbitration", 14: ""}


def test_every_set_has_a_place(spark):
    got = registry.queries()["sidebar_sort_health"](spark, SF).toPandas()
    assert len(got) == registry.queries()["sets_with_health"](spark, SF).count() > 50


def test_places_run_on_from_range_to_range(spark):
    t = spark.range(5000).selectExpr("id", "id % 3 AS a", "CASE WHEN id % 2 = 0 THEN 0 ELSE id * 7 % 11 END AS b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = _places(t, F.col("a").asc(), F.col("b").desc(), F.col("id").asc())
        parts = got.select(F.spark_partition_id()).distinct().count()
        found = {r["place"]: r["id"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(t.collect(), key=lambda r: (r["a"], -r["b"], r["id"]))
    assert parts > 1 and found == {i: r["id"] for i, r in enumerate(want, 1)}


def test_documents_of_every_source_have_a_status(spark, duck):  # noqa: F811
    got = registry.queries()["document_status_list"](spark, SF).toPandas()
    assert len(got) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
