"""Logs of versions, isolated errors, ordered wholes, folds, watched terms and noise tables: by content, on odd rows, and by what the plans move."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changewatch.config import WATCHLIST
from changewatch.functions.faults import guarded, said
from changewatch.operators import diffs, faults, folds, noise, ordered, watch
from changewatch.operators import versions as V
from changewatch.sources import files, state_log
from pyspark.sql import types as T

LOG = "k string, a long, version long, deleted boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- versions -----------------------------------------------------------------


def test_latest_at_every_version_equals_replay(spark):
    rng = random.Random(1)
    log, state, at = [], {}, {}
    for version in range(1, 9):
        for k in rng.sample(["a", "b", "c", None], rng.randint(1, 4)):
            value, gone = rng.choice([None, 1, 2]), rng.random() < 0.3
            log.append((k, value, version, gone))
            state.pop(k, None) if gone else state.update({k: value})
        at[version] = dict(state)
    t = spark.createDataFrame(log, LOG)
    for version, want in at.items():
        assert dict(rows(V.latest(t, ["k"], at=version))) == want
        # nothing that is expired is missed by readers of that version or a later one
        left = t.join(V.expired(t, ["k"], version), ["version", "k"], "left_anti") if None not in {r[0] for r in log} else None
        kept = [r for r in map(tuple, t.collect()) if r not in set(map(tuple, V.expired(t, ["k"], version).collect()))]
        for later in range(version, 9):
            assert dict(rows(V.latest(spark.createDataFrame(kept, LOG), ["k"], at=later))) == at[later]
        del left
    assert rows(V.latest(t, ["k"])) == rows(V.latest(t, ["k"], at=8))


def test_changes_replayed_give_the_table(spark):
    before = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), (None, 4)], "k string, a long")
    now = spark.createDataFrame([("a", 1), ("b", 2), ("d", None), (None, 5)], "k string, a long")
    assert rows(V.changes(now, before, ["k"])) == sorted([("b", 2, False), ("d", None, False), (None, 5, False)], key=repr)
    assert ("c", 3, True) in rows(V.changes(now, before, ["k"], gone=True))
    log = before.withColumns({"version": F.lit(1), "deleted": F.lit(False)}).unionByName(V.changes(now, before, ["k"], gone=True).withColumn("version", F.lit(2)))
    assert rows(V.latest(log, ["k"])) == rows(now)
    assert V.changes(now.limit(0), before, ["k"]).count() == 0 and V.changes(before, before, ["k"]).count() == 0


def test_parts_of_a_text_are_replaced_together(spark):
    t = spark.createDataFrame([("s", 0, "a", 1, False), ("s", 1, "b", 1, False), ("s", 0, "c", 2, False), ("t", 0, "d", 1, False)], "k string, part long, text string, version long, deleted boolean")
    assert rows(V.latest_groups(t, ["k"])) == [("s", 0, "c"), ("t", 0, "d")] and rows(V.latest_groups(t, ["k"], at=1)) == [("s", 0, "a"), ("s", 1, "b"), ("t", 0, "d")]


def test_a_log_in_files(spark, tmp_path):
    root, schema = str(tmp_path), T.StructType([T.StructField("k", T.StringType()), T.StructField("a", T.LongType())])
    read = lambda at=None: rows(V.latest(state_log.read(spark, root, "t", schema, at), ["k"]))
    assert read() == []
    for i in range(1, 5):
        state_log.append(spark, spark.createDataFrame([("x", i), (f"y{i}", i)], schema), root, f"r{i}", "t")
        if i != 3:  # the third dies before it is published
            files.publish(spark, root, f"r{i}")
    assert read() == [("x", 4), ("y1", 1), ("y2", 2), ("y4", 4)] and read(at=2) == [("x", 2), ("y1", 1), ("y2", 2)]
    state_log.compact(spark, root, {"t": (schema, ["k"])}, "r4")
    assert read() == [("x", 4), ("y1", 1), ("y2", 2), ("y4", 4)] and len(state_log.opened(spark, root, None)) == 1
    # a reader of the version before the base still opens the runs; after one more version it need not
    assert state_log.expire(spark, root, keep=2) == []
    state_log.append(spark, spark.createDataFrame([("x", 6)], schema), root, "r6", "t")
    files.publish(spark, root, "r6")
    assert sorted(state_log.expire(spark, root, keep=2)) == ["r1", "r2", "r4"] and read()[0] == ("x", 6)
    assert state_log.expire(spark, root, keep=2, dead_after_hours=-1) == ["r3"]


# --- errors as data ----------------------------------------------------------------


def test_guarded_functions_say_what_failed(spark):
    half = guarded(lambda n, xs: 10 // n + len(xs or []), T.LongType())
    t = spark.createDataFrame([(1, ["a"]), (0, None), (None, None)], "n long, xs array<string>").withColumn("r", half("n", "xs"))
    got = [(r["n"], r["r"]["value"], (r["r"]["error"] or "").split(":")[0]) for r in t.collect()]
    assert got == [(1, 11, ""), (0, None, "ZeroDivisionError"), (None, None, "TypeError")]
    assert said(ValueError("a" * 999 + "\nb")) == "ValueError: " + "a" * 300


def test_sets_with_errors_are_left_out_whole(spark):
    t = spark.createDataFrame([("a", "u1", None), ("a", "u2", "E"), ("b", "u3", None), (None, "u4", "F"), (None, "u5", None)], "set_name string, url string, error string").withColumn("step", F.lit("reading"))
    q = faults.quarantine(t, t.withColumn("error", F.when(F.col("url") == "u1", "G")))
    assert rows(faults.sound(t, q).select("url")) == [("u3",)]
    assert rows(faults.failed_sets(q)) == sorted([("a", 2, "u1", "reading", "G"), (None, 1, "u4", "reading", "F")], key=repr)
    assert [r["detail"] for r in faults.alerts(q).filter("set_name = 'a'").collect()] == ["not checked in this run: reading: G (and 1 more)"]
    assert faults.sound(t.limit(0), q.limit(0)).count() == 0


def test_a_diff_that_fails_is_an_error_of_its_row(spark, monkeypatch):
    from changewatch.functions import udfs

    t = spark.createDataFrame([("s", "u", "a\nb", "a\nc", "l")], "set_name string, url string, prior_stored string, text_now string, label string")
    good = diffs.diff_moved(t).first()["diff"]
    assert good["text"] == "--- l (stored)\n+++ l (current)\n@@ -1,2 +1,2 @@\n a\n-b\n+c" and (good["added"], good["removed"], good["error"]) == (1, 1, None)
    bad = t.withColumn("diff", udfs.unified_diff(3, "x")("prior_stored", "text_now", "label")).first()["diff"]
    assert bad["error"].startswith("TypeError") and bad["text"] is None and bad["added"] is None


# --- ordered wholes -------------------------------------------------------------------


def test_digests_texts_and_parts_of_ordered_groups(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE", 50)  # many pieces
    rng = random.Random(3)
    made = [(g, i, rng.choice(["", "é", "x" * 30, None])) for g in ("hot", "b", None) for i in range(900 if g == "hot" else 40)]
    rng.shuffle(made)
    t = spark.createDataFrame(made, "g string, i int, v string").repartition(7)
    want = {g: "\n".join(v or "" for _, v in sorted((i, v) for h, i, v in made if h == g)) for g in ("hot", "b", None)}
    assert dict(rows(ordered.digest(t, ["g"], ["i"], "v"))) == {g: hashlib.sha256(x.encode()).hexdigest() for g, x in want.items()}
    assert dict(rows(ordered.joined(t, ["g"], ["i"], "v", sep="\n", name="x"))) == want
    parts = ordered.parts(t, ["g"], ["i"], "v", sep="\n", hold=lambda df: df.persist()).collect()
    assert sorted((r["part"] for r in parts if r["g"] == "hot")) == list(range(900))
    for g, x in want.items():
        assert "".join(r["v"] for r in sorted((r for r in parts if r["g"] == g), key=lambda r: r["part"])) == x
    assert all(r["part"] == r["i"] for r in parts)
    for empty in (ordered.digest(t.limit(0), ["g"], ["i"], "v"), ordered.parts(t.limit(0), ["g"], ["i"], "v")):
        assert empty.count() == 0


def test_joined_texts_stop_at_a_limit(spark):
    t = spark.createDataFrame([("a", i, "é" * 10) for i in range(10)], "g string, i int, v string")
    cut = ordered.joined(t, ["g"], ["i"], "v", sep="|", name="x", limit=33, note="...").first()["x"]
    assert cut == "é" * 10 + "|" + "é" * 6 + "..." and ordered.joined(t, ["g"], ["i"], "v", sep="|", name="x", limit=209, note="...").first()["x"].count("é") == 100


def test_wholes_are_made_without_collecting_a_group(spark):
    t = spark.createDataFrame([("a", 1, "v")], "g string, i int, v string")
    for df in (ordered.digest(t, ["g"], ["i"], "v"), ordered.joined(t, ["g"], ["i"], "v", sep="", name="x")):
        assert "collect_list" not in plan(df) and "rangepartitioning(g0" in plan(df)


# --- folds ------------------------------------------------------------------------------


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4), st.sampled_from([True, False, None])), max_size=40))
def test_folds_by_period_equal_a_replay(spark, made):
    log = [(k, p, i, ok, f"t{i:03}") for i, (p, k, ok) in enumerate(sorted(made, key=lambda x: x[1]))]
    log = [(k, p, i, ok, ts) for i, (p, k, ok) in enumerate(sorted(((b, a, c) for a, b, c in made), key=lambda x: x[0])) for ts in [f"t{i:03}"]]
    t = spark.createDataFrame(log, "k int, p int, i int, ok boolean, ts string")
    want, streak, last = {}, {}, {}
    for k, _, i, ok, ts in log:
        streak[k] = 0 if ok else streak.get(k, 0) + 1
        last[k] = ts if ok else last.get(k)
        want[i] = (streak[k], last[k])
    got = {r["i"]: (r["streak"], r["last_success"]) for r in folds.streaks(t, "k", "p", ["i"], "ok", "ts").collect()}
    assert got == want
    # segments merge in any grouping: all periods of a key after what was kept before
    parts = folds.segments(t, "k", "p", ["i"], "ok", "ts").collect()
    for k in streak:
        n, s = 5, "before"
        for r in sorted((r for r in parts if r["k"] == k), key=lambda r: r["p"]):
            n, s = (n + r["trailing"] if r["failures"] == r["records"] else r["trailing"]), r["last_ok"] or s
        assert (n, s) == (streak[k] + (5 if last[k] is None else 0), last[k] or "before")


def test_counters_resume_from_what_was_kept(spark):
    parts = spark.createDataFrame([("a", 3, 3, 3, None), ("b", 3, 1, 1, "t9")], "k string, records long, failures long, trailing long, last_ok string")
    prior = spark.createDataFrame([("a", 2, "t1"), ("c", 7, None)], "k string, consecutive_failures long, last_success string")
    assert rows(folds.resumed(parts, prior, "k")) == [("a", 5, "t1"), ("b", 1, "t9"), ("c", 7, None)]


def test_no_window_orders_a_whole_key(spark):
    t = spark.createDataFrame([(1, 1, 1, True, "t")], "k int, p int, i int, ok boolean, ts string")
    windows = [line for line in plan(folds.streaks(t, "k", "p", ["i"], "ok", "ts")).splitlines() if "Window [" in line]
    assert windows and all("i#" not in line.split("windowspecdefinition(")[1] or ", p#" in line.split("windowspecdefinition(")[1] for line in windows)


# --- terms and noise ------------------------------------------------------------------------


def test_indexed_terms_equal_one_branch_for_each(spark):
    texts = [(1, "Binding ARBITRATION clause"), (2, None), (3, ""), (4, "we may sell it’s data; AI training"), (5, "x" * 2000 + " third party"), (6, "ai")]
    t = spark.createDataFrame(texts, "doc_id int, text string")
    for terms in (WATCHLIST, [*WATCHLIST, "a", "ai", "it's", "ß", ""], ["zz"]):
        got = {r["doc_id"]: r["tags"] for r in watch.tags(t, watch.index_of(spark, terms), ["doc_id"], "text").collect()}
        want = {r["doc_id"]: r["w"] or [] for r in t.withColumn("w", diffs.watch_tags(F.col("text"), [x for x in terms if x and x != "it's"])).collect()}
        assert {k: [x for x in v if x != "watchlist:it's"] for k, v in got.items()} == want
    assert "watchlist:it's" in {r["doc_id"]: r["tags"] for r in watch.tags(t, watch.index_of(spark, ["it's"]), ["doc_id"], "text").collect()}[4]


def test_fifty_thousand_terms_have_the_plan_of_fifteen(spark, monkeypatch):
    t = spark.createDataFrame([(1, "term 4711 here"), (2, "nothing")], "doc_id int, text string")
    many = watch.index(spark.range(50_000).select(F.concat(F.lit("term "), "id").alias("term")))
    found = rows(watch.hits(t, many, ["doc_id"], "text"))
    assert found == sorted([(1, f"term {x}") for x in ("4", "47", "471", "4711")])
    assert len(plan(watch.hits(t, many, ["doc_id"], "text"))) < 20_000
    monkeypatch.setattr(watch, "BROADCAST_BYTES", 0)  # a larger index is joined by shuffle
    assert rows(watch.hits(t, many, ["doc_id"], "text")) == found


def test_noise_of_a_table_equals_noise_of_a_plan(spark, monkeypatch):
    from changewatch.config import NOISE_BY_HOST
    from changewatch.functions import text as X

    lines = "Effective January 5, 2026 | Archived versions here\nkept\nNote: We recently updated our privacy notice today\nx"
    t = spark.createDataFrame([(h, lines) for h in (*NOISE_BY_HOST, "other.org", None)] + [("other.org", None)], "host string, text string")
    patterns = spark.createDataFrame([(h, i, p) for h, ps in NOISE_BY_HOST.items() for i, p in enumerate(ps)] + [(None, 0, "^x$"), ("other.org", 0, None), ("other.org", 1, "")], "host string, no int, pattern string")
    want = t.withColumn("text", X.without_noise(F.col("text"), F.col("host"), ["^x$"], NOISE_BY_HOST))
    for limit in (1 << 25, 0):
        monkeypatch.setattr(noise, "BROADCAST_BYTES", limit)
        assert rows(noise.removed(t, patterns, "host", "text")) == rows(want)
    assert rows(noise.removed(t, patterns.limit(0), "host", "text")) == rows(t)


@pytest.mark.parametrize("name", ["source_digest", "combined_diff_parts"])
def test_queries_of_wholes_have_all_sets(spark, name):
    from changewatch.plans import registry
    from conftest import SF

    got = registry.queries()[name](spark, SF)
    if name == "combined_diff_parts":
        whole = dict(rows(registry.queries()["combined_diff"](spark, SF)))
        parts = got.collect()
        assert {s: "".join(r["text"] for r in sorted((r for r in parts if r["set_name"] == s), key=lambda r: r["part"])) for s in whole} == whole
        assert all(x.startswith("===== Doc ") and " — +" in x.splitlines()[0] for x in whole.values())
    else:
        assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count()
