"""Gates, state and reports on small cases with known answers."""

import html
import unicodedata
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changewatch import config, schemas
from changewatch.config import Config, ConfigError, from_mapping
from changewatch.functions import text as X
from changewatch.functions import udfs
from changewatch.operators import analysis, diffs, gates, reports, state
from changewatch.sources import captures as source
from changewatch.sources import files

LONG = "We may not resell your data. " * 30
NOW = "2026-08-13T00:00:00Z"
PRIOR = "set_name string, url string, hash string, length long, pipeline_version int, stored string, consecutive_failures long, last_success string, last_changed string, etag string"
CAPTURES = "set_name string, url string, label string, status string, text string, etag string, error string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def run(spark, text, *, status="ok", prior=LONG, version=2, failures=0, error=None):
    stored = udfs.normalise_text(prior) if prior is not None else None
    p = [] if prior is None else [("s", "https://e.org/a", one(spark, X.content_hash(F.lit(stored))), len(stored), version, stored, failures, "before", "before", "e1")]
    c = spark.createDataFrame([("s", "https://e.org/a", "A", status, text, "e2", error)], CAPTURES)
    t = gates.classify(c, spark.createDataFrame(p, PRIOR))
    run.changed = gates.changed(t, c, spark.createDataFrame(p, PRIOR))
    return t, t.first(), state.next_documents(t, NOW).first()


@pytest.mark.parametrize(
    ("text", "prior", "outcome", "reason"),
    [
        ("Hmm. This site can’t be reached. " + LONG, LONG, "suspect_scrape", "block_page"),
        ("  \n", LONG, "suspect_scrape", "empty"),
        ("short", None, "suspect_scrape", "too_short"),
        (LONG[:510], LONG, "suspect_scrape", "shrank"),
        (LONG * 3, LONG, "suspect_scrape", "grew"),
        (LONG, None, "new", None),
        (LONG, LONG, "unchanged", None),
        (LONG.replace(" ", "  ") + "\r\n\r\n", LONG, "unchanged", None),
        (LONG + "\nmore", LONG, "changed", None),
        (LONG.strip() + "\u2028more", LONG + "\nmore", "unchanged", None),
        (LONG.strip() + "\u2028more\x85x", LONG + "\nmore", "changed", None),
    ],
)
def test_outcomes(spark, text, prior, outcome, reason):
    _, row, doc = run(spark, text, prior=prior)
    assert (row["outcome"], row["reason"]) == (outcome, reason)
    assert doc["consecutive_failures"] == (outcome == "suspect_scrape")
    if outcome == "suspect_scrape" and prior:
        assert doc["hash"] == row["prior_hash"] and doc["etag"] == "e1"


def test_boundaries_pass(spark):
    prior = "x" * 1000
    for n in (600, 2500):
        assert run(spark, "y" * n, prior=prior)[1]["outcome"] == "changed"
    assert run(spark, "y" * 599, prior=prior)[1]["reason"] == "shrank"
    assert run(spark, "y" * 2501, prior=prior)[1]["reason"] == "grew"


def test_other_version_is_rebaselined(spark):
    _, row, doc = run(spark, LONG + "x", version=1)
    assert row["outcome"] == "rebaselined" and doc["rebaseline_reason"] == "extraction pipeline changed" and doc["last_changed"] == "before"


def test_failures_count_up_and_reset(spark):
    assert run(spark, None, status="failed", failures=2, error="HTTP 503")[2]["consecutive_failures"] == 3
    assert run(spark, None, status="not_modified", failures=2)[2]["consecutive_failures"] == 0


def test_diff_and_tags(spark):
    run(spark, LONG + "\nA 30% fee applies. Disputes go to arbitration.")
    row = diffs.diff_moved(run.changed).first()
    assert row["diff"]["added"] == 1 and row["diff"]["removed"] == 0
    assert row["tags"] == ["percentage", "watchlist:arbitration"]


def test_context_is_not_tagged():
    text = udfs.diff_texts("indemnify for $5\nold", "indemnify for $5\nnew", "d", 3, 1000)[0]
    assert "indemnify" in text


def test_lines_that_look_like_headers_are_counted_exactly():
    got = dict(zip(udfs.DIFF.names, udfs.diff_texts("a\n-- b", "a\n++ c", "d", 3, 1000), strict=True))
    assert (got["added"], got["removed"], got["lines_added"], got["lines_removed"]) == (0, 0, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=8), st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=8))
def test_a_diff_leads_from_old_to_new(old, new):
    text = udfs.diff_texts("\n".join(old), "\n".join(new), "d", 99, 10**6)[0]
    lines = text.split("\n")[3:] if text else None
    a, b = ("\n".join(x).splitlines() for x in (old, new))
    if lines is None:
        assert a == b
    else:
        assert [x[1:] for x in lines if x[:1] in " -"] == a and [x[1:] for x in lines if x[:1] in " +"] == b


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab &;<\n\t  \r", max_size=40))
def test_normalising_twice_changes_nothing(text):
    plain = html.unescape(text)
    once = udfs.normalise_text(plain)
    assert udfs.normalise_text(once) == once


def test_strict_normalising_reaches_a_fixed_point():
    odd = "&am​p;x"
    assert udfs.normalise_text(udfs.normalise_text(odd)) != udfs.normalise_text(odd)
    assert udfs.normalise_text(udfs.normalise_text(odd, strict=True), strict=True) == udfs.normalise_text(odd, strict=True)


def test_native_and_exact_normalising_agree(spark):
    texts = [("a \t b\r\n\r\n\r\n\r\nc  d​ ",), ("",), (None,), ("\n x \n",)]
    t = spark.createDataFrame(texts, "t string").select(X.squeeze(F.col("t")).alias("a"), udfs.normalise("t", F.lit(None).cast("array<string>")).alias("b"))
    assert all(r["a"] == r["b"] for r in t.collect())


def test_folding_is_case_folding(spark):
    quotes = str.maketrans(X.FOLD_FROM, X.FOLD_TO)
    chars = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    chars = [c for c in chars if len(c.casefold()) == 1 or c.lower() in X.SEVERAL or c.casefold() == c.lower()]
    texts = ["".join(chars[i : i + 16]) for i in range(0, len(chars), 16)] + ["STRASSE Straße", "ΟΔΥΣΣΕΥΣ ὈΔΥΣΣΕΎΣ", "veriﬁcation ﬀ", "", "İI"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold(F.col("t")).alias("f"), gates.has_signature(F.col("t"), ["VERIFICATION"]).alias("signed")).collect()
    assert [(r["t"], r["f"]) for r in got if r["f"] != r["t"].translate(quotes).casefold()] == []
    assert [r["t"] for r in got if r["signed"]] == ["veriﬁcation ﬀ"]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav id=top><ul><li>Home<li>Terms</ul></nav>
<main class="doc wide"><h1>Title</h1><p>One &amp; two<br>three<div class="ad">buy</div><section data-kind="terms-of-use"><p>Inner <b>bold</b></p>
<table><tr><td>a<td>b</tr></table></section></main><footer>end</footer><article><section><p>Other</section></article></body></html>"""


@pytest.mark.parametrize(
    ("selector", "text", "how"),
    [
        (None, "Title\nOne & two\nthree\nInner bold\n| a | b\nOther", "page"),
        ("main", "Title\nOne & two\nthree\nInner bold\n| a | b", "selector"),
        (".doc section", "Inner bold\n| a | b", "selector"),
        ("body > main.wide > h1, article p", "Title\nOther", "selector"),
        ("[data-kind]", "Inner bold\n| a | b", "selector"),
        ("section[data-kind^='terms'], b", "Inner bold\n| a | b", "selector"),
        ("[data-kind|=terms] b", "bold", "selector"),
        ("nav#top", "Home\nTerms", "selector"),
        ("body > h1", "Title\nOne & two\nthree\nInner bold\n| a | b\nOther", "page"),
        (".doc.narrow", "Title\nOne & two\nthree\nInner bold\n| a | b\nOther", "page"),
    ],
)
def test_text_of_pages(spark, selector, text, how):
    assert udfs.html_text(PAGE, selector) == (text, how)
    got = spark.createDataFrame([(PAGE, selector), (None, selector), ("", selector)], "page string, selector string").select(udfs.extract_text("page", "selector").alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got] == [(text, how), ("", "page"), ("", "page")]


def plainly_selected(steps, path):
    """Whether the last element of a path is selected, by trying every way."""
    if not path or not udfs._fits(steps[-1], *path[-1]):
        return False
    above = path[:-1]
    return len(steps) == 1 or any(plainly_selected(steps[:-1], above[:n]) for n in ([len(above)] if steps[-1][0] else range(len(above), 0, -1)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["", "x", "y"])), max_size=9), st.lists(st.tuples(st.sampled_from([" ", " > "]), st.sampled_from(["a", "b", "*", ".x", "a.y"])), min_size=1, max_size=4))
def test_selection_equals_trying_every_way(path, steps):
    wanted = udfs.parse_selector("".join(s if i == 0 else sep + s for i, (sep, s) in enumerate(steps)))
    selection, sofar = udfs.Selection(wanted), []
    for tag, c in path:
        sofar.append((tag, {"class": c}))
        assert selection.enter(*sofar[-1]) == any(plainly_selected(w, sofar) for w in wanted)


@pytest.mark.parametrize(("page", "selector"), [("<div>" * 60 + "<p>x" * 50, "span div div div p"), ("<b>" * 100_000 + "</i>" * 100_000, None), ("<div>" * 100_000 + "x", "div > p div div > p"), ("<b><i>" * 50_000 + "</b></u>" * 50_000, "u i b i u")])
def test_pages_take_time_in_proportion(page, selector):
    import time

    began = time.perf_counter()
    udfs.html_text(page, selector)
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize("selector", ["p:first-child", "a ~ b", "", "p,"])
def test_unknown_selectors_are_refused(selector):
    with pytest.raises(ValueError, match="selector"):
        udfs.parse_selector(selector)


@pytest.mark.parametrize(("url", "label"), [("https://e.org/legal/aup", "Aup"), ("https://e.org/hub/legal/terms-of-service", "Terms Of Service"), ("https://e.org/AUP.html", "AUP"), ("https://e.org/", "e.org")])
def test_labels(spark, url, label):
    assert one(spark, X.document_label(F.lit(url), F.lit(None).cast("string"))) == label
    assert one(spark, X.document_label(F.lit(url), F.lit(" Given "))) == "Given"


@pytest.mark.parametrize(("url", "ok"), [("https://e.org", True), ("http://e.org/x", True), ("file:///etc", False), ("javascript:x", False), ("junk", False), ("", False)])
def test_safe_addresses(spark, url, ok):
    assert one(spark, X.is_safe_url(F.lit(url))) is ok and source.is_safe(url) is ok


def test_staleness(spark):
    at = lambda s: X.is_stale(X.instant(F.lit(s)), F.lit(NOW).cast("timestamp"))
    assert [one(spark, at(s)) for s in ("2026-08-01T00:00:00Z", "2026-07-21T00:00:00Z", "2026-05-21T00:00:00Z", "nonsense", "Unknown")] == [False, False, True, True, True]


def test_replies_are_checked_alike_in_both_places(spark):
    good = '{"verdict": "uncertain", "summary": "s", "analysis": "a", "priority": "low"}'
    raw = [good, "```json\n" + good + "\n```", good.replace("uncertain", "x"), good.replace('"s"', "1"), good.replace('"a"', '" "'), "[]", "x", "", good.replace("low", "unknown"), '{"verdict": "uncertain"}']
    t = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = {r["raw"]: r["error"] or "" for r in analysis.check_reply(t, "raw").collect()}
    assert got == {r: analysis.broken(r) for r in raw}


def test_analyser_is_asked_again_once(spark):
    t = spark.createDataFrame([("s", "p")], "set_name string, prompt string")
    bad = analysis.analyse(t, lambda p: "no").first()
    assert (bad["reply"], bad["attempts"], bad["error"]) == (None, 2, "not JSON")
    good = analysis.analyse(t).first()
    assert good["attempts"] == 1 and not good["error"]
    counted = analysis.analyse(t, lambda p: analysis.Reply("no", 900, 250)).first()
    assert (counted["prompt_tokens"], counted["output_tokens"]) == (1800, 500)
    assert analysis.usage(None) == ("", 0, 0) and analysis.usage(("x", None, 3)) == ("x", 0, 3)


def test_failed_analysis_restores_hash_and_validators(spark):
    t, row, _ = run(spark, LONG + "\nmore")
    docs = state.next_documents(t, NOW)
    prior = spark.createDataFrame([("s", "https://e.org/a", row["prior_hash"], row["prior_length"], "e1")], "set_name string, url string, hash string, length long, etag string")
    back = state.revert(docs, prior, spark.createDataFrame([("s",)], "set_name string")).first()
    assert (back["status"], back["hash"], back["etag"]) == ("analysis_pending", row["prior_hash"], "e1")


def test_three_bad_runs_raise_one_alert(spark):
    docs = spark.createDataFrame([("s", "u", 3, "block_page: x"), ("s", "v", 0, "")], "set_name string, url string, consecutive_failures long, last_error string")
    sets = spark.createDataFrame([("s", 0), ("t", 2)], "set_name string, schema_failures long")
    rate = spark.createDataFrame([(0.2,)], "error_rate double")
    assert sorted(r["kind"] for r in reports.alerts(sets, docs, rate).collect()) == ["schema_failures", "source_failing"]
    health = {r["set_name"]: r["status"] for r in reports.set_health(sets, docs).collect()}
    assert health == {"s": "failing", "t": "failing"}
    lines = [r["line"] for r in files.alert_markdown(reports.alerts(sets, docs, rate), "failing", NOW).collect()]
    assert lines[0].startswith("Some sources") and len(lines) == 9 and lines[7].startswith("| s | u | source_failing") and lines[8].startswith("| t |")
    many = spark.range(3000).select(F.lit("source_failing").alias("kind"), F.lit("s").alias("set_name"), F.format_string("u%05d", "id").alias("url"), F.lit(3).alias("failures"), F.lit("").alias("detail"))
    assert files.alert_markdown(many, "failing", NOW).count() == 3007 and files.alert_markdown(many.limit(0), "ok", NOW).count() == 0


def test_error_rate_of_nothing_is_zero(spark):
    assert reports.error_rate(spark.createDataFrame([], "outcome string")).first()["error_rate"] == 0.0


def test_aggregate_round_trip(spark):
    t = spark.createDataFrame([(1, 0, "https://a.org", "Alpha"), (1, 1, "https://b.org", "Beta")], "k int, n int, url string, text string")
    back = state.split_aggregate(state.aggregate_snapshot(t, "k", "n", "url", "text"), ["k"], "aggregate")
    assert {(r["url"], r["text"]) for r in back.collect()} == {("https://a.org", "Alpha"), ("https://b.org", "Beta")}


def test_parsed_diff_has_files_and_hunks(spark):
    text = "===== A — +1 / -0 =====\n--- x\n+++ y\n@@ 1 @@\n a\n+b\n===== B — +0 / -1 =====\n@@ 2 @@\n-c\n\\ no newline\n@@ 3 @@\n d"
    got = diffs.parse(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").orderBy("file_no", "hunk_no", "line_no").collect()
    assert [(r["file_no"], r["hunk_no"], r["line_no"], r["type"], r["text"]) for r in got] == [(0, 0, 0, "context", "a"), (0, 0, 1, "add", "b"), (1, 0, 0, "remove", "c"), (1, 0, 1, "meta", "\\ no newline"), (1, 1, 0, "context", "d")]


def test_settings():
    assert from_mapping({"validation": {"shrink_ratio": 0.5}, "health": {"error_rate_threshold": 1}}).validation.shrink_ratio == 0.5
    for raw, says in (({"validation": {"shrink_ratio": 1.5}}, "validation.shrink_ratio"), ({"validaton": {}}, "validaton"), ({"fetch": {"max_retries": True}}, "fetch.max_retries"), ({"diff": []}, "diff"), ({"normalisation": {"per_source_noise": {"a": "x"}}}, "per_source_noise.a")):
        with pytest.raises(ConfigError, match=says):
            from_mapping(raw)
    assert from_mapping(None) == Config()


def test_settings_file(tmp_path):
    (tmp_path / "a.yaml").write_text("model: m\nretention:\n  log_days: 5\n")
    assert config.load(tmp_path / "a.yaml").retention.log_days == 5
    (tmp_path / "b.yaml").write_text("a: [")
    for name in ("b.yaml", "none.yaml"):
        with pytest.raises(ConfigError):
            config.load(tmp_path / name)


def test_sets_file(spark, tmp_path):
    (tmp_path / "sets.json").write_text('[{"setName": "a", "category": "c", "urls": [{"url": "u"}]}, 5, {"setName": "a", "category": "d", "urls": [{"url": "v"}]}, {"setName": "b", "category": "c", "urls": [{}]}, {"setName": "e", "urls": [{"url": "u"}]}]')
    got = files.read_sets(spark, str(tmp_path / "sets.json")).collect()
    assert [(r["setName"], r["category"]) for r in got] == [("a", "c")]
    assert files.read_sets(spark, str(tmp_path / "none.json")).count() == 0


def test_run_log_files(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"run_id": "1", "outcome": "new", "timestamp": "2026-08-12T00:00:00Z"}\n\nnot json\n{"run_id": "1", "outcome": "analysed", "prompt_tokens": 9}\n')
    log = files.read_run_log(spark, str(tmp_path / "runs.jsonl"))
    assert log.filter("run_id is not null").count() == 2
    files.write_run_log(log.filter("run_id is not null"), str(tmp_path / "log"))
    assert files.retain_run_log(spark, str(tmp_path / "log"), NOW, 90).count() == 2
    assert files.retain_run_log(spark, str(tmp_path / "log"), "2027-08-13T00:00:00Z", 90).count() == 1


def test_commit_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert files.current(spark, root) is None
    files.commit(spark, {"a": spark.range(1)}, root, "r1")
    files.commit(spark, {"a": spark.range(2)}, root, "r2")
    assert spark.read.parquet(f"{files.current(spark, root)}/a").count() == 2


def test_a_run_that_dies_leaves_the_one_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    files.commit(spark, {"a": spark.range(1)}, root, "r1")
    home = files.current(spark, root)
    with pytest.raises(Exception, match="boom"):
        files.commit(spark, {"a": spark.range(2), "b": spark.range(1).select(F.raise_error(F.lit("boom")).alias("x"))}, root, "r2")
    assert files.current(spark, root) == home
    # dies after its tables, between the claim of a number and the publication: the next run takes another number
    files.keep(spark, spark.range(3), root, "r3", "a")
    (tmp_path / "claims" / f"{2:012d}").touch()
    assert files.current(spark, root) == home and spark.read.parquet(f"{home}/a").count() == 1
    files.commit(spark, {"a": spark.range(4)}, root, "r4")
    assert spark.read.parquet(f"{files.current(spark, root)}/a").count() == 4 and sorted(files.published(spark, root)) == [(1, "r1"), (3, "r4")]


def test_a_run_does_not_undo_one_that_was_published_meanwhile(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    files.publish(spark, root, "r1")
    with pytest.raises(OSError, match="published meanwhile"):
        files.publish(spark, root, "r2", base=0)
    # another run claims a later number before this one is published
    claimed = files._claimed
    monkeypatch.setattr(files, "_claimed", lambda *a: [*claimed(*a), *([9] if (tmp_path / "claims" / f"{2:012d}").exists() else [])])
    with pytest.raises(OSError, match="published meanwhile"):
        files.publish(spark, root, "r2", base=1)
    assert sorted(files.published(spark, root)) == [(1, "r1")]
    with pytest.raises(ValueError, match="folder"):
        files.publish(spark, root, "a/b")


def test_old_days_of_the_log_are_dropped(spark, tmp_path):
    log = spark.createDataFrame([("a", "2026-08-01T00:00:00Z"), ("b", "2026-01-01T00:00:00Z"), ("c", None)], "run_id string, timestamp string")
    files.write_run_log(log, str(tmp_path / "log"))
    assert files.prune_run_log(spark, str(tmp_path / "log"), NOW, 90) == 1
    assert {r["run_id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {"a", "c"}


def test_json_and_text_readers(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"verdict": "uncertain",\n "priority": "low"}')
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(spark, str(tmp_path / "ok.json"), schemas.ANALYSIS).first()["priority"] == "low"
    assert files.read_json(spark, str(tmp_path / "bad.json"), schemas.ANALYSIS).count() == 0
    assert files.read_text(spark, str(tmp_path / "ok.json")).first()["text"].startswith("{")
    assert files.read_text(spark, str(tmp_path / "none")).count() == 0


def answer(request):
    """A stand-in for the network."""
    url = request["url"]
    if "304" in url:
        return {"status": 304, "body": "", "headers": {}}
    if "503" in url:
        return {"status": 503, "body": "", "headers": {}}
    if "down" in url:
        raise OSError("no route")
    if "block" in url:
        return {"status": 200, "body": "Just a moment...", "headers": {"etag": "block"}}
    if "404" in url:
        return {"status": 404, "body": "", "headers": {}}
    if "agent" in url:
        return {"status": 200, "body": f"{request['headers']['User-Agent']} {request['timeout']}", "headers": {}}
    return {"status": 200, "body": "text", "headers": {"etag": "new"}}


def browser(request):
    return {"status": 200, "body": "rendered", "headers": {}}


def test_fetching_escalates_as_far_as_it_has_to(spark):
    quick = source.Config(fetch=source.from_mapping({"retry_delay_seconds": 0, "user_agent": "me", "timeout_seconds": 7}, type(source.Config().fetch)))
    rows = [(f"https://e.org/{x}", "old", "p" if "proxy" in x else None, x == "200r") for x in ("200", "304", "block", "block-proxy", "404", "down", "agent", "200r")] + [(None, None, None, None)]
    watched = spark.createDataFrame(rows, "url string, etag string, proxy string, render boolean")
    kinds = lambda df, url: [(r["route_no"], r["status"], r["rendered"]) for r in df if r["url"] and r["url"].endswith(url)]
    plain = source.fetch(watched, quick, client="test_monitoring:answer").collect()
    assert kinds(plain, "/block") == [(0, "ok", False)] * 2 and kinds(plain, "-proxy") == [(0, "ok", False), (1, "ok", False)] * 2
    assert kinds(plain, "/200") == [(0, "ok", False)] and [r["error"] for r in plain if r["url"] is None] == ["unsafe address, refused"]
    assert [r["text"] for r in plain if r["url"] == "https://e.org/agent"] == ["me 7"]
    both = source.fetch(watched, quick, client="test_monitoring:answer", render="test_monitoring:browser").collect()
    assert kinds(both, "/block") == [(0, "ok", False), (0, "ok", True)] and kinds(both, "/404") == [(0, "failed", False)] * 2
    assert kinds(both, "/down") == [(0, "failed", False), (0, "ok", True)] and kinds(both, "/200r") == [(0, "ok", False), (0, "ok", True)]
    assert {(r["etag"], r["text"]) for r in both if r["url"] == "https://e.org/block" and r["rendered"]} == {("block", "rendered")}


def test_capture_source(spark):
    import json

    spark.dataSource.register(source.CaptureSource)
    watched = "\n".join(json.dumps({"url": u, "etag": "old"}) for u in ("https://e.org/200", "https://e.org/304", "https://e.org/503", "https://e.org/down", "file:///x"))
    got = spark.read.format("captures").option("watched", watched).option("client", "test_monitoring:answer").option("partitions", 2).option("config", '{"fetch": {"retry_delay_seconds": 0}}').load()
    best = {r["url"]: (r["status"], r["tried"]) for r in state.first_usable(got).collect()}
    assert best == {"https://e.org/200": ("ok", 1), "https://e.org/304": ("not_modified", 1), "https://e.org/503": ("failed", 2), "https://e.org/down": ("failed", 2), "file:///x": ("failed", 1)}


def test_stream_of_captures(spark, tmp_path):
    from changewatch.streaming import monitor

    day = datetime(2026, 8, 1)
    rows = [("s", "u", day + timedelta(days=i), s, t) for i, (s, t) in enumerate([("ok", LONG), ("ok", LONG + " "), ("failed", None), ("ok", "x"), ("ok", LONG + "\nmore")])]
    spark.createDataFrame(rows, "set_name string, url string, captured_at timestamp, status string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("set_name string, url string, captured_at timestamp, status string, text string").parquet(str(tmp_path / "in"))
    q = monitor.outcomes(stream, delay="10 days").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from found order by captured_at").collect()
    assert [r["outcome"] for r in got] == ["new", "unchanged", "fetch_failed", "suspect_scrape", "changed"]
    assert [r["failures"] for r in got] == [0, 0, 1, 2, 0]


def test_entry_works_where_a_library_of_the_corpus_operators_is_missing(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; assert 'document_outcomes' in e.queries() and not any(k.startswith('op') for k in e.queries()) and 'op3_mixing' not in e.oracle_sql()"
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": f"{tmp_path}:{root}", "PATH": "/usr/bin:/bin"})


def test_entry_works_without_the_corpus_operators(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "changewatch"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    import shutil

    shutil.copytree(root / "changewatch", tmp_path / "changewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'document_outcomes' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
