"""Queries over logs of versions, isolated errors, ordered wholes, folds, watched terms and noise tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changewatch.functions import keyed, udfs
from changewatch.functions import text as X
from changewatch.operators import diffs as D
from changewatch.operators import faults as E
from changewatch.operators import folds, noise, ordered, watch
from changewatch.operators import state as S
from changewatch.operators import versions as V
from changewatch.plans import scenario as C
from changewatch.plans.queries import _places, iso, now, query

# --- a log of versions ---------------------------------------------------------

_VERSIONS = f"{C.LOG}, v AS (SELECT event_id AS version, doc, outcome, timestamp, event_id % 11 = 0 AS deleted FROM log)"
#: A version in the middle of the smallest table of events.
_MIDDLE = 1500


def _log(spark, d) -> DataFrame:
    """The events as a log of document records: each is a version of its document, one in eleven deletes it."""
    return C.events_log(spark, d).select("doc", "outcome", "timestamp", F.col("event_id").alias("version"), (F.col("event_id") % 11 == 0).alias("deleted"))


@query(f"WITH {_VERSIONS} SELECT doc, outcome, timestamp FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc ORDER BY version DESC) = 1) WHERE NOT deleted")
def latest_state(spark, d) -> DataFrame:
    """Of every document its last record."""
    return V.latest(_log(spark, d), ["doc"])


@query(f"WITH {_VERSIONS} SELECT doc, outcome, timestamp FROM (SELECT * FROM v WHERE version <= {_MIDDLE} QUALIFY row_number() OVER (PARTITION BY doc ORDER BY version DESC) = 1) WHERE NOT deleted")
def state_at_version(spark, d) -> DataFrame:
    """The state as a reader of an earlier version sees it."""
    return V.latest(_log(spark, d), ["doc"], at=_MIDDLE)


@query(f"WITH {_VERSIONS}, n AS (SELECT *, lead(version) OVER (PARTITION BY doc ORDER BY version) AS after FROM v) SELECT version FROM n WHERE after <= {_MIDDLE} OR (deleted AND version <= {_MIDDLE})")
def state_expired(spark, d) -> DataFrame:
    """The records that no reader of that version or a later one needs."""
    return V.expired(_log(spark, d), ["doc"], _MIDDLE).select("version")


@query(f"""WITH d AS (SELECT coalesce(source, 'none') AS set_name, {C._URL} AS url, doc_id % 10 AS m, coalesce(text, '') AS t FROM documents),
n AS (SELECT set_name, url, sha256(CASE WHEN m = 0 THEN t || {C.sql_text(C.CLAUSE)} ELSE t END) AS hash, length(CASE WHEN m = 0 THEN t || {C.sql_text(C.CLAUSE)} ELSE t END) AS length, sha256(t) AS old, m FROM d)
SELECT set_name, url, hash, length, false AS deleted FROM n WHERE m <> 8 AND (m = 7 OR hash <> old) UNION ALL SELECT set_name, url, old, length, true FROM n WHERE m = 8""")
def state_changes(spark, d) -> DataFrame:
    """The document records that a run adds to the log: those that are new, those whose hash or length moved, and those that are gone. Hashes are made where texts are read, so no text is moved."""
    m, text = F.col("doc_id") % 10, F.coalesce("text", F.lit(""))
    t = C.spread(C.table(spark, d, "documents"))
    record = lambda x: (F.coalesce("source", F.lit("none")).alias("set_name"), C._url().alias("url"), X.content_hash(x).alias("hash"), F.length(x).cast("long").alias("length"))
    current = t.filter(m != 8).select(*record(F.when(m == 0, F.concat(text, F.lit(C.CLAUSE))).otherwise(text)))
    return V.changes(current, t.filter(m != 7).select(*record(text)), ["set_name", "url"], gone=True)


# --- errors as data --------------------------------------------------------------

_SETS_OF = "coalesce(source, 'none') || '/' || doc_id % 40"
_POISONED = "doc_id % 97 = 5"


def _read(spark, d) -> DataFrame:
    """Documents in small sets, read with their set's noise pattern, which a few rows have broken."""
    t = C.spread(C.table(spark, d, "documents")).select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id") % 40).alias("set_name"), F.col("doc_id").cast("string").alias("url"), "text")
    pattern = F.array(F.when(F.expr(_POISONED), F.lit("(")).otherwise(F.lit("^Advertisement$")))
    return t.withColumn("read", udfs.normalise_or_error("text", pattern)).select("doc_id", "set_name", "url", F.lit("reading").alias("step"), F.col("read.error").alias("error"), F.length("read.value").cast("long").alias("length"))


@query(f"WITH t AS (SELECT doc_id, {_SETS_OF} AS set_name FROM documents) SELECT set_name, count(*) AS faults, min(doc_id::VARCHAR) AS url FROM t WHERE {_POISONED} GROUP BY set_name")
def quarantined_sets(spark, d) -> DataFrame:
    """The sets that a run leaves as they were, with their errors counted and the first address."""
    return E.failed_sets(E.quarantine(_read(spark, d))).select("set_name", "faults", "url")


@query(f"WITH t AS (SELECT doc_id, {_SETS_OF} AS set_name FROM documents) SELECT doc_id, set_name FROM t WHERE set_name NOT IN (SELECT set_name FROM t WHERE {_POISONED})")
def isolated_rows(spark, d) -> DataFrame:
    """The documents of all other sets, which go on."""
    # written by a run; here both sides read it once more
    t = _read(spark, d)
    return E.sound(t, E.quarantine(t)).select("doc_id", "set_name")


# --- ordered wholes beyond a row ---------------------------------------------------

_SECTION = "'--- Content from https://e.org/' || turn || ' ---' || chr(10) || chr(10) || coalesce(text, '')"


@query(f"SELECT conv_id, row_number() OVER w - 1 AS part, CASE WHEN row_number() OVER w > 1 THEN chr(10) || chr(10) ELSE '' END || {_SECTION} AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def aggregate_parts(spark, d) -> DataFrame:
    """An aggregate in numbered parts, one for each document."""
    t = C.table(spark, d, "conversations").withColumn("url", F.concat(F.lit("https://e.org/"), F.col("turn")))
    return S.aggregate_parts(t, "conv_id", "turn", "url", "text")


@query()
def combined_diff_parts(spark, d) -> DataFrame:
    """The combined diff of every set in numbered parts, one for each changed document."""
    return D.combine_parts(D.diff_moved(C.changed(spark, d), C.CFG))


@query("SELECT coalesce(source, 'none') AS set_name, sha256(string_agg(doc_id || ':' || coalesce(text, ''), chr(10) ORDER BY doc_id)) AS hash FROM documents GROUP BY 1")
def source_digest(spark, d) -> DataFrame:
    """A digest over all texts of every source in order, whatever its size."""
    t = C.spread(C.table(spark, d, "documents")).select(F.coalesce("source", F.lit("none")).alias("set_name"), "doc_id", F.concat(F.col("doc_id"), F.lit(":"), F.coalesce("text", F.lit(""))).alias("value"))
    return ordered.digest(t, ["set_name"], ["doc_id"], "value")


@query(f"WITH {C.SETS}, l AS (SELECT coalesce(category, 'Uncategorized') AS category, id, '- ' || set_name || ' — ' || strftime(last_checked, '%Y-%m-%d %H:%M:%S') AS line FROM sets WHERE last_checked <= TIMESTAMP '2026-08-13') SELECT category, row_number() OVER (PARTITION BY category ORDER BY id) - 1 AS part, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY id) > 1 THEN chr(10) ELSE '' END || line AS line FROM l")
def briefing_parts(spark, d) -> DataFrame:
    """The lines of a briefing by category, numbered, so that a category of any size is written in ranges."""
    line = F.concat(F.lit("- "), "set_name", F.lit(" — "), iso("last_checked"))
    t = C.monitored_sets(spark, d).filter(F.col("last_checked") <= now()).select(F.coalesce("category", F.lit("Uncategorized")).alias("category"), "id", line.alias("line"))
    return ordered.parts(t, ["category"], ["id"], "line", sep="\n").select("category", "part", "line")


# --- folds that merge ----------------------------------------------------------------

_ISLANDS = f"{C.LOG}, i AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY doc ORDER BY ts, event_id) AS island, max(CASE WHEN NOT failed THEN timestamp END) OVER (PARTITION BY doc ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_success FROM log)"


@query(f"WITH {_ISLANDS} SELECT event_id, count(*) FILTER (WHERE failed) OVER (PARTITION BY doc, island ORDER BY ts, event_id) AS streak, last_success FROM i")
def streaks_folded(spark, d) -> DataFrame:
    """Streak and last success of every record, by days that merge: equal to windows over each document's whole log."""
    return folds.streaks(C.events_log(spark, d), "doc", "day", ["timestamp", "event_id"], "ok", "timestamp").select("event_id", "streak", "last_success")


@query(f"WITH {C.LOG}, i AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY doc, day ORDER BY ts DESC, event_id DESC) AS after FROM log) SELECT doc, day::VARCHAR AS day, count(*) AS records, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE failed AND after = 0) AS trailing, max(CASE WHEN NOT failed THEN timestamp END) AS last_ok FROM i GROUP BY doc, day")
def day_segments(spark, d) -> DataFrame:
    """What every document's days come to."""
    return folds.segments(C.events_log(spark, d), "doc", "day", ["timestamp", "event_id"], "ok", "timestamp").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {C.LOG}, i AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY doc ORDER BY ts DESC, event_id DESC) AS after FROM log), e AS (SELECT doc, count(*) FILTER (WHERE failed AND after = 0) + CASE WHEN bool_and(failed) THEN doc % 3 ELSE 0 END AS consecutive_failures, coalesce(max(CASE WHEN NOT failed THEN timestamp END), '{C.BEFORE}') AS last_success FROM i GROUP BY doc) SELECT * FROM e")
def counters_resumed(spark, d) -> DataFrame:
    """Counters after a whole log follows the state that was kept, without reading earlier logs."""
    log = C.events_log(spark, d)
    kept = log.select("doc", (F.col("doc") % 3).alias("consecutive_failures"), F.lit(C.BEFORE).alias("last_success")).distinct()
    days = folds.segments(log, "doc", "day", ["timestamp", "event_id"], "ok", "timestamp")
    last = folds.before(days, "doc", "day").groupBy("doc").agg(F.max_by(F.struct("records", "failures", "trailing", "last_ok", "carried", "carried_ok"), "day").alias("l"), F.sum("records").alias("records"), F.sum("failures").alias("failures"))
    whole = folds.merged({"records": F.lit(0), "failures": F.lit(0), "trailing": F.col("l.carried"), "last_ok": F.col("l.carried_ok")}, {c: F.col(f"l.{c}") for c in ("records", "failures", "trailing", "last_ok")})
    return folds.resumed(last.select("doc", "records", "failures", whole["trailing"].alias("trailing"), whole["last_ok"].alias("last_ok")), kept, "doc")


# --- many terms, many patterns ---------------------------------------------------------

_TERM = "left(text, 24)"


@query(f"WITH w AS (SELECT DISTINCT {_TERM} AS term FROM benchmark WHERE text <> ''), t AS (SELECT doc_id, {C.sql_fold('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, term FROM t JOIN (SELECT term, {C.sql_fold('term')} AS f FROM w) ON contains(t, f)")
def watched_passages(spark, d) -> DataFrame:
    """The documents that hold the opening of any benchmark passage: as many terms as there are passages, in one join."""
    terms = watch.index(C.table(spark, d, "benchmark").select(F.expr(_TERM).alias("term")))
    return watch.hits(C.spread(C.table(spark, d, "documents")), terms, ["doc_id"], "text")


_HOST_OF = "'h' || doc_id % 10000 || '.org'"
_RAW = "'Notice ' || doc_id % 10000 || ' of today' || chr(10) || coalesce(text, '') || chr(10) || 'Notice ' || (doc_id + 1) % 10000 || ' of today' || chr(10) || 'Printed 12 times'"


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_RAW}, '(?m)^Printed [0-9]+ times$', '', 'g'), '(?m)^Notice ' || doc_id % 10000 || ' .*$', '', 'g') AS text FROM documents")
def noise_by_table(spark, d) -> DataFrame:
    """Texts without the noise of their host, of ten thousand hosts with patterns of their own: one join, one plan."""
    docs = C.spread(C.table(spark, d, "documents"))
    hosts = C.table(spark, d, "documents").select((F.col("doc_id") % 10000).alias("k")).distinct().select(F.concat(F.lit("h"), "k", F.lit(".org")).alias("host"), F.lit(1).alias("no"), F.concat(F.lit("^Notice "), "k", F.lit(" .*$")).alias("pattern"))
    everywhere = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("host"), F.lit(0).alias("no"), F.lit("^Printed [0-9]+ times$").alias("pattern"))
    t = docs.select("doc_id", F.concat(F.lit("h"), F.col("doc_id") % 10000, F.lit(".org")).alias("host"), F.concat(F.lit("Notice "), F.col("doc_id") % 10000, F.lit(" of today\n"), F.coalesce("text", F.lit("")), F.lit("\nNotice "), (F.col("doc_id") + 1) % 10000, F.lit(" of today\nPrinted 12 times")).alias("raw"))
    return noise.removed(t, hosts.unionByName(everywhere), "host", "raw").select("doc_id", F.col("raw").alias("text"))


# --- keyed JSON, locale order ------------------------------------------------------------


@query("""WITH t AS (SELECT user_id AS doc, event_id, '{"e' || event_id || '": ' || coalesce(props, 'null') || ', "type": {"name": "' || event_type || '", "k": ' || event_id % 5 || '}}' AS j FROM events)
SELECT event_id, o.key AS outer_key, i.key AS inner_key, i.value::VARCHAR AS value FROM t, json_each(t.j) o, json_each(o.value) i WHERE o.type = 'OBJECT'""")
def keyed_state(spark, d) -> DataFrame:
    """The records of objects that are keyed by name, whose fields differ."""
    e = C.table(spark, d, "events")
    j = F.concat(F.lit('{"e'), "event_id", F.lit('": '), F.coalesce("props", F.lit("null")), F.lit(', "type": {"name": "'), "event_type", F.lit('", "k": '), F.col("event_id") % 5, F.lit("}}"))
    return keyed.nested(e.select("event_id", j.alias("j")), "j", ["outer_key", "inner_key"]).select("event_id", "outer_key", "inner_key", F.to_json("value").alias("value"))


@query(f"WITH {C.SETS} SELECT id, row_number() OVER (ORDER BY set_name, id) AS place FROM sets")
def sidebar_sort_locale(spark, d) -> DataFrame:
    """Every set's place by name in the order of a locale, in which these plain names stand as by their code points."""
    return _places(C.monitored_sets(spark, d).select("id", "set_name"), X.in_locale(F.col("set_name")).asc(), F.col("id").asc()).select("id", "place")
