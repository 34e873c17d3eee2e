"""Keyed state files, the incremental archive index, the keyed sink of streams, point lookups and locale order."""

import json

from pyspark.sql import functions as F

from changewatch import schemas
from changewatch.functions import keyed
from changewatch.functions import text as X
from changewatch.operators import reports
from changewatch.operators import versions as V
from changewatch.sources import archive_index, captures, files, keyed_state, lookup, state_log
from changewatch.streaming import sink
from pyspark.sql import types as T


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_object_and_array_forms_give_the_same_rows(spark, tmp_path):
    docs = {"https://e.org/a": {"hash": "h", "length": 7, "status": "new"}, "https://e.org/b": {"hash": 5, "extra": [1]}}
    by_name = {"s": {"category": "c", "hash": "x", "schema_failures": 2, "documents": docs}, "t": {"last_checked": None, "documents": {}}, "u": "no object"}
    as_list = [{"setName": n, **(v if isinstance(v, dict) else {})} for n, v in by_name.items()]
    as_list[0]["documents"] = [{"url": u, **d} for u, d in docs.items()]
    for name, content in (("o", by_name), ("a", as_list), ("b", [5, {"setName": ""}, {"category": "x"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    (tmp_path / "broken.json").write_text("{")
    sets, documents = keyed_state.read(spark, f"{tmp_path}/o.json")
    assert sets.columns == schemas.SET_STATE.names and [r[0] for r in rows(sets)] == ["s", "t", "u"]
    found = {r["url"]: r for r in documents.collect()}
    assert (found["https://e.org/a"]["hash"], found["https://e.org/a"]["length"], found["https://e.org/b"]["hash"], found["https://e.org/b"]["length"]) == ("h", 7, "5", None)
    for a, b in zip((sets, documents), keyed_state.read(spark, f"{tmp_path}/a.json"), strict=True):
        assert rows(a) == rows(b)
    for name in ("b", "broken", "none"):
        assert [df.count() for df in keyed_state.read(spark, f"{tmp_path}/{name}.json")] == [0, 0]


def test_entries_of_nested_objects(spark):
    t = spark.createDataFrame([(1, '{"a": {"d": {"x": 1, "y": "z"}}, "b": {"d": {}}, "c": 3}'), (2, None), (3, "[4, null]"), (4, "nonsense"), (5, "{}")], "id int, j string")
    got = keyed.nested(t, "j", ["outer", "inner"], "$.d").select("id", "outer", "inner", F.to_json("value"))
    assert rows(got) == [(1, "a", "x", "1"), (1, "a", "y", '"z"')]
    assert [tuple(r) for r in keyed.entries(t, "j", pos="n").filter("id = 3").select("key", F.to_json("value"), "n").collect()] == [(None, "4", 0), (None, "null", 1)]


def test_the_index_reads_new_files_alone(spark, tmp_path):
    folder, root = tmp_path / "logs", f"{tmp_path}/index"
    folder.mkdir()

    def put(name, text):
        (folder / name).write_text(text)

    def full():
        found = files.read_text(spark, str(folder)).select("text", F.element_at(F.split("path", "/"), -1).alias("file_name"))
        return reports.history_records(found)

    put("s_20260101_000000_analysis.json", '{"verdict": "uncertain", "priority": "low", "changed_documents": ["a"]}')
    put("s_20260101_000000_snapshot.txt", "text")
    put("s_20269999_000000_analysis.json", "{}")
    put("other.txt", "x")
    assert archive_index.read(spark, root).count() == 0
    assert archive_index.update(spark, str(folder), root) == 4 and rows(archive_index.read(spark, root)) == rows(full())
    assert archive_index.update(spark, str(folder), root) == 0
    # a sibling that comes later joins its analysis
    put("s_20260101_000000_diff.txt", "d")
    put("t_20260102_000000_analysis.json", "broken")
    assert archive_index.update(spark, str(folder), root) == 2 and rows(archive_index.read(spark, root)) == rows(full()) and full().count() == 2
    known = spark.createDataFrame([("t",)], "file_id string")
    assert [r["file_id"] for r in archive_index.read(spark, root, known).collect()] == ["t"]


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    root, schema = str(tmp_path), T.StructType([T.StructField("url", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("at", T.LongType())])
    write = sink.upsert(root, "outcomes", schema, ["url"], "at")
    now = lambda: rows(V.latest(state_log.read(spark, root, "outcomes", schema), ["url"]))
    batch = lambda *r: spark.createDataFrame(r, schema)
    write(batch(("a", "new", 1), ("a", "changed", 2), ("b", "new", 1)), 0)
    assert now() == [("a", "changed", 2), ("b", "new", 1)]
    write(batch(("a", "lost", 9)), 0)  # the same number again
    assert now() == [("a", "changed", 2), ("b", "new", 1)]
    state_log.append(spark, batch(("b", "half", 5)), root, f"batch-{1:012d}", "outcomes")  # dies before it is published
    assert now() == [("a", "changed", 2), ("b", "new", 1)]
    write(batch(("b", "failed", 5)), 1)
    assert now() == [("a", "changed", 2), ("b", "failed", 5)]
    source = f"{tmp_path}/in"
    batch(("c", "new", 7)).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(sink.upsert(f"{root}/s", "outcomes", schema, ["url"], "at")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert rows(V.latest(state_log.read(spark, f"{root}/s", "outcomes", schema), ["url"])) == [("c", "new", 7)]


def test_a_lookup_reads_one_folder(spark, tmp_path):
    t = spark.range(2000).select(F.concat(F.lit("set_"), F.col("id") % 500).alias("file_id"), "id").unionByName(spark.createDataFrame([(None, 1)], "file_id string, id long"))
    lookup.write(t, f"{tmp_path}/t", "file_id")
    found = lookup.find(spark, f"{tmp_path}/t", "file_id", ["set_7"])
    assert rows(found) == rows(t.filter("file_id = 'set_7'")) and found.columns == t.columns
    assert len(found.inputFiles()) > 1 and len({p for p in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan.replace("((", "(") or "_bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(file_id,set_7)" in plan.split("PushedFilters")[1]
    assert rows(lookup.find(spark, f"{tmp_path}/t", "file_id", ["set_7", "none", "set_8"])) == rows(t.filter("file_id in ('set_7', 'set_8')"))


def test_names_are_in_the_order_of_a_locale(spark):
    want = ["_under", "1st", "adobe", "Adobe", "Ädobe", "Apple", "émile", "Emma", "zebra", "Zebra", "Ångström"]
    names = [n for n in want if n != "Ångström"]
    t = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    assert [r["name"] for r in t.orderBy(X.in_locale(F.col("name"))).collect()] == names


def test_a_proxy_takes_all_four_settings():
    whole = {"PROXY_HOST": "h", "PROXY_PORT": "8080", "PROXY_USER": "u@x", "PROXY_PASS": "p:/"}
    assert captures.proxy_address(whole) == "http://u%40x:p%3A%2F@h:8080"
    for k in whole:
        assert captures.proxy_address(whole | {k: ""}) is None and captures.proxy_address({n: v for n, v in whole.items() if n != k}) is None


def test_documents_that_fall_silent_are_reported_once(spark, tmp_path):
    from changewatch.streaming import silence

    spark.conf.set(*silence.STORE)
    schema = "set_name string, url string, captured_at timestamp, status string"
    for i, found in enumerate(([("s", "a", "2026-08-01", "ok"), ("s", "b", "2026-08-01", "ok")], [("s", "a", "2026-08-03", "failed"), ("s", "a", "2026-08-04", "failed")], [("s", "c", "2026-08-07", "ok")], [("s", "b", "2026-08-08", "ok")], [("s", "c", "2026-08-20", "ok")])):
        spark.createDataFrame(found, "set_name string, url string, captured_at string, status string").withColumn("captured_at", F.to_timestamp("captured_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n={i}")
    stream = spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("n")
    query = silence.silent(stream).writeStream.format("memory").queryName("quiet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
        got = sorted((r["url"], str(r["last_captured"])[:10], r["failures"], str(r["silent_since"])[:10]) for r in spark.table("quiet").collect())
    finally:
        query.stop()
        spark.conf.unset(silence.STORE[0])
    # a was captured again before it was due, b after it was; each is told once for each silence
    assert got == [("a", "2026-08-04", 2, "2026-08-07"), ("b", "2026-08-01", 0, "2026-08-04"), ("b", "2026-08-08", 0, "2026-08-11"), ("c", "2026-08-07", 0, "2026-08-10")]
