"""Whole runs, one after the other, over three documents of a set."""

import dataclasses
import json

import pytest

from changewatch import schemas
from changewatch.config import Config
from changewatch.operators import gates, versions
from changewatch.plans.run import run
from changewatch.sources import files, state_log

TEXT = {n: f"Terms of {n}. " + "We may not resell your data. " * 40 for n in ("aup", "terms", "privacy")}
SCHEMA = "set_name string, url string, label string, status string, text string, etag string, error string"
BLOCK = "This site can’t be reached. " + "It might be temporarily down or it may have moved permanently. " * 3


@pytest.fixture
def steps(spark, tmp_path):
    sets = spark.createDataFrame([("s", "c")], "set_name string, category string")
    count = iter(range(99))

    def step(changes=None, status="ok", **more):
        texts = TEXT | (changes or {})
        rows = [("s", f"https://e.org/{n}", n, status, t if status == "ok" else None, "e", "HTTP 503" if status == "failed" else None) for n, t in texts.items()]
        i = next(count)
        return run(spark, sets, spark.createDataFrame(rows, SCHEMA), str(tmp_path), f"2026-08-{10 + i}T00:00:00Z", run_id=f"r{i}", **more)

    return step


def whole(parts):
    """The text that numbered parts join to."""
    return "".join(r["text"] for r in parts.orderBy("part").collect())


def outcomes(r):
    return {x["label"]: x["status"] for x in r.documents.collect()}


def test_first_scan_then_unchanged_then_edit(spark, steps):
    a = steps()
    assert set(outcomes(a).values()) == {"new"} and a.sets.first()["last_verdict"] == "no_material_change"
    same = steps()
    assert set(outcomes(same).values()) == {"unchanged"} and same.baselines.count() == 3
    # an unchanged run writes no text
    assert [spark.read.parquet(f"{same.path}/{table}").count() for table in ("baselines", "artefacts", "archive")] == [0, 0, 0]
    assert spark.read.parquet(f"{a.path}/baselines").count() == 3
    dry = steps({"aup": TEXT["aup"] + "\nDisputes go to arbitration."}, dry_run=True)
    assert dry.path is None and outcomes(dry)["aup"] in ("changed", "analysis_pending")
    asked = []
    edit = steps({"aup": TEXT["aup"] + "\nDisputes go to arbitration."})
    row, review = edit.sets.first(), edit.reviews.first()
    assert outcomes(edit) == {"aup": "changed", "terms": "unchanged", "privacy": "unchanged"}
    assert [r["url"] for r in spark.read.parquet(f"{edit.path}/baselines").collect()] == ["https://e.org/aup"]
    assert review["labels"] == ["aup"] and review["tags"] == ["watchlist:arbitration"] and review["attempts"] == 1
    assert (row["last_priority"], row["last_amended"]) == ("high", "2026-08-13T00:00:00Z") and not asked
    again = steps({"aup": TEXT["aup"] + "\nDisputes go to arbitration."})
    assert set(outcomes(again).values()) == {"unchanged"} and again.reviews.count() == 0


def test_block_page_keeps_the_baseline_and_raises_one_alert_after_three(spark, steps):
    a = steps()
    before = {x["label"]: x["hash"] for x in a.documents.collect()}
    for i in range(3):
        bad = steps({"terms": BLOCK})
        assert outcomes(bad)["terms"] == "suspect_scrape" and bad.sets.first()["consecutive_failures"] == i + 1
        assert {x["label"]: x["hash"] for x in bad.documents.collect()} == before
    assert [x["kind"] for x in bad.alerts.collect() if x["kind"] != "run_error_rate"] == ["source_failing"]
    assert bad.health.first()["status"] == "failing"
    good = steps()
    assert set(outcomes(good).values()) == {"unchanged"} and good.alerts.count() == 0


def test_declined_and_invalid_reviews(spark, steps):
    a = steps()
    edit = {"aup": TEXT["aup"] + "\nminor words"}
    bad = steps(edit, analyser=lambda p: "no")
    assert outcomes(bad)["aup"] == "analysis_pending" and bad.sets.first()["schema_failures"] == 1
    declined = steps(edit)
    row = declined.sets.first()
    assert row["review_verdict"] == "no_material_change" and row["last_amended"] == a.sets.first()["last_amended"] and row["schema_failures"] == 0
    assert steps(edit).reviews.count() == 0


def test_not_modified_and_failing(spark, steps):
    steps()
    assert set(outcomes(steps(status="not_modified")).values()) == {"not_modified"}
    down = steps(status="failed")
    assert set(outcomes(down).values()) == {"fetch_failed"} and down.sets.first()["last_success"] == "2026-08-11T00:00:00Z"


def test_the_model_is_asked_once_and_its_version_is_archived(spark, steps, tmp_path):
    asked = tmp_path / "asked"

    def analyser(prompt):
        with asked.open("a") as f:
            f.write("x")
        n = len(asked.read_text())
        return '{"verdict": "material_change", "summary": "no. %d", "analysis": "a", "priority": "high"}' % n, 900, 250

    steps()
    first = steps({"aup": TEXT["aup"] + "\nFirst."}, analyser=analyser)
    # of the first scan the analysis and the texts go to the archive at the first change
    assert {r["file_name"] for r in first.archive.collect()} == {"s_20260810_000000_analysis.json", "s_20260810_000000_snapshot.txt"}
    assert whole(first.artefacts.filter("kind = 'diff'")).count("+First.") == 1 and "First capture" in first.history.first()["summary"]
    spent = first.log.filter("llm_called").first()
    assert (spent["prompt_tokens"], spent["output_tokens"], spent["llm_attempts"]) == (900, 250, 1)
    second = steps({"aup": TEXT["aup"] + "\nSecond."}, analyser=analyser)
    assert asked.read_text() == "xx" and second.sets.first()["review_summary"] == "no. 2"
    names = {r["file_name"] for r in second.archive.collect()}
    assert names == {f"s_20260811_000000_{k}" for k in ("analysis.json", "snapshot.txt", "diff.txt")} | {f"s_20260810_000000_{k}" for k in ("analysis.json", "snapshot.txt")}
    record = second.history.orderBy("stamp").collect()[-1]
    assert (record["summary"], record["priority"], record["changed_documents"]) == ("no. 1", "high", ["aup"])
    assert record["diff_path"] == "logs/s_20260811_000000_diff.txt" and record["ts"].day == 11
    left = steps({"aup": "x"}, only=[])
    assert left.documents.count() == 0 and left.sets.first()["review_summary"] == "no. 2" and left.history.count() == 2


def test_texts_from_before_are_baselines_to_be_recorded_anew(spark, steps):
    legacy = spark.createDataFrame([("s", f"--- Content from https://e.org/aup ---\n\n{TEXT['aup']}old words\n\n--- Content from https://e.org/gone ---\n\nx")], "set_name string, aggregate string")
    assert outcomes(steps(legacy=legacy)) == {"aup": "rebaselined", "terms": "new", "privacy": "new"}


def test_a_declined_review_is_archived_and_leaves_the_analysis(steps):
    steps()
    arbitration = {"aup": TEXT["aup"] + "\nDisputes go to arbitration."}
    steps(arbitration)
    declined = steps(arbitration | {"terms": TEXT["terms"] + "\nminor words"})
    current = json.loads(whole(declined.artefacts.filter("kind = 'analysis'")))
    assert current["verdict"] == "material_change" and current["date_time"] == "2026-08-11T00:00:00Z"
    assert "minor words" in whole(declined.artefacts.filter("kind = 'snapshot'")) and "+minor words" in whole(declined.artefacts.filter("kind = 'diff'"))
    kept = {r["stamp"]: (r["verdict"], r["changed_documents"]) for r in declined.history.collect()}
    assert kept == {"20260810_000000": ("no_material_change", []), "20260812_000000": ("no_material_change", ["terms"])}
    third = steps(arbitration | {"terms": TEXT["terms"] + "\nminor words", "privacy": TEXT["privacy"] + "\nMore arbitration."})
    kept = {r["stamp"]: r["verdict"] for r in third.history.collect()}
    # the analysis that was left in place is archived under the time of the check before the change
    assert kept == {"20260810_000000": "no_material_change", "20260812_000000": "material_change"}
    assert json.loads(whole(third.archive.filter("file_name like '%20260812%analysis%'")))["date_time"] == "2026-08-11T00:00:00Z"


def test_no_text_is_moved_for_documents_that_did_not_change(spark, tmp_path):
    """The join of captures with their state carries hashes and flags, no text."""
    prior = spark.createDataFrame([], "set_name string, url string, hash string, length long, pipeline_version int, has_text boolean")
    captures = spark.createDataFrame([("s", "u", "l", "ok", "t" * 600, "e", None)], SCHEMA)
    plan = gates.gate(captures, prior)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line or "Sort" in line or "Join" in line]
    assert not any("text#" in line or "stored#" in line for line in moved)
    assert "text" not in gates.gate(captures, prior).columns


def test_a_poisoned_row_costs_its_own_set_alone(spark, tmp_path):
    cfg = Config(normalisation=dataclasses.replace(Config().normalisation, per_source_noise={"bad.org": ["("]}))
    sets = spark.createDataFrame([(s, "c") for s in ("good", "bad", "mixed")], "set_name string, category string")
    url = {"good": ["https://a.org/1", "https://a.org/2"], "bad": ["https://bad.org/1", "https://bad.org/2"], "mixed": ["https://a.org/3", "https://bad.org/3"]}

    def step(day, config, text):
        rows = [(s, u, u[-1], "ok", TEXT["aup"] + text, "e", None) for s, us in url.items() for u in us]
        return run(spark, sets, spark.createDataFrame(rows, SCHEMA), str(tmp_path), f"2026-08-{day}T00:00:00Z", run_id=f"r{day}", cfg=config)

    step(10, Config(), "")
    hit = step(11, cfg, "\nDisputes go to arbitration.")
    assert {r["set_name"] for r in hit.documents.collect()} == {"good"} and {r["status"] for r in hit.documents.collect()} == {"changed"}
    assert sorted((r["set_name"], r["url"], r["step"]) for r in hit.quarantine.collect()) == [("bad", "https://bad.org/1", "reading"), ("bad", "https://bad.org/2", "reading"), ("mixed", "https://bad.org/3", "reading")]
    found = {(r["kind"], r["set_name"]): r["detail"] for r in hit.alerts.collect()}
    assert {s for k, s in found if k == "set_failed"} == {"bad", "mixed"} and "missing )" in found["set_failed", "mixed"] and "1 more" in found["set_failed", "bad"]
    assert {(r["set_name"], r["outcome"]) for r in hit.log.filter("url = ''").collect()} == {("good", "analysed"), ("bad", "set_failed"), ("mixed", "set_failed")}
    state = {r["set_name"]: r["last_checked"][:10] for r in hit.sets.collect()}
    assert state == {"good": "2026-08-11", "bad": "2026-08-10", "mixed": "2026-08-10"}
    well = step(12, Config(), "\nDisputes go to arbitration.")
    assert {r["set_name"]: r["status"] for r in well.documents.collect()} == {"good": "unchanged", "bad": "changed", "mixed": "changed"} and well.quarantine.count() == 0


def test_bases_and_expiry_keep_what_readers_need(spark, steps, tmp_path):
    root = str(tmp_path)
    edits = [{"aup": TEXT["aup"] + f"\nEdit {i} on arbitration."} for i in range(3)]
    steps(base_every=2)
    for e in edits:
        steps(e, base_every=2)
    published = sorted(files.published(spark, root))
    there = {name for name, _ in files.folders(spark, f"{root}/runs")}
    # r0 to r2 are in the base, and no reader of the last two versions opens them
    assert [r for _, r in published] == ["r0", "r1", "r2", "base-r2", "r3"] and there == {"base-r2", "r3"}
    assert spark.read.parquet(f"{root}/log").select("run_id").distinct().count() == 4
    # the last two versions can be read
    for n, _ in published[-2:]:
        texts = versions.latest(state_log.read(spark, root, "baselines", schemas.STORED_TEXT, n), ["set_name", "url"])
        assert texts.count() == 3
    last = steps(edits[-1])
    assert set(outcomes(last).values()) == {"unchanged"} and last.baselines.filter("text like '%Edit 2%'").count() == 1
    assert last.history.count() == 3 and whole(last.artefacts.filter("kind = 'diff'")).count("+Edit 2") == 1
