"""A monitored corpus made from the test tables, in Spark and as DuckDB common table expressions.

Every document is monitored in the set of its source. Its stored baseline is
its text; its capture differs by the last digits of its id, so that each
outcome occurs: an added clause, doubled spaces, a third of the text, a
browser's error page, not modified, a failed request, a baseline of an older
version, no baseline, the text three times, no text, other line ends, or the
same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changewatch.config import FAILURE_SIGNATURES, Config
from changewatch.functions import text as X
from changewatch.operators import gates

NOW = "2026-08-13T00:00:00Z"
BEFORE = "2026-08-01T00:00:00Z"
CLAUSE = "\nDisputes are resolved by binding arbitration. Fees are $5 or 30% within 14 days under section 4.2 and must be paid by 2026-01-05."
BLOCKED = "Hmm. This site can’t be reached. The page might be temporarily down."
CFG = Config()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores: dealt out anew only where fewer would do the work.

    A table of one small file has fewer partitions. A large file has enough,
    but rows lie in row groups that are read whole, so a few large ones leave
    most tasks without rows: the rows of each are counted, which reads no
    column.
    """
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if n < cores:
        return df.repartition(cores)
    rows = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return df if (rows["most"] or 0) * cores <= 2 * (rows["all"] or 0) else df.repartition(n)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their set and address, where they are read: what is asked of a text is worked out there, so that no text is moved that nobody fetches."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", F.coalesce("source", F.lit("none")).alias("set_name"), _url().alias("url"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m, h = _documents(spark, sf_dir), F.col("doc_id") % 10, F.col("doc_id") % 100
    text = F.coalesce("text", F.lit(""))
    raw = (
        F.when(h == 8, F.repeat(text, 3)).when(h == 18, "").when(h == 19, F.replace(text, F.lit("\n"), F.lit("\u2028")))
        .when(m == 0, F.concat(text, F.lit(CLAUSE))).when(m == 1, F.replace(text, F.lit(" "), F.lit("  ")))
        .when(m == 2, F.left(text, F.greatest(F.lit(1), F.floor(F.length(text) / 3).cast("int")))).when(m == 3, BLOCKED).otherwise(text)
    )
    status = F.when(m == 4, "not_modified").when(m == 5, "failed").otherwise("ok")
    return d.select(
        "doc_id", "set_name", "lang", "url", F.concat(F.lit("Doc "), F.col("doc_id")).alias("label"), status.alias("status"),
        F.when(status == "ok", raw).alias("text"), F.concat(F.lit("e"), F.col("doc_id"), F.lit("b")).alias("etag"), F.when(status == "failed", "HTTP 503").alias("error"),
    )


def _url():
    return F.concat(F.lit("https://docs.example.org/"), F.coalesce("source", F.lit("none")), F.lit("/doc-"), F.col("doc_id"), F.lit(".html"))


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, stored = F.col("doc_id") % 10, X.squeeze(F.col("text"))
    return _known(spark, sf_dir).select(
        "set_name", "url", stored.alias("stored"), X.content_hash(stored).alias("hash"), F.length(stored).cast("long").alias("length"),
        F.when(m == 6, 1).otherwise(2).alias("pipeline_version"), (F.col("doc_id") % 4).alias("consecutive_failures"), F.lit(BEFORE).alias("last_success"), F.lit(BEFORE).alias("last_changed"), F.concat(F.lit("e"), F.col("doc_id")).alias("etag"),
    )


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).filter(F.col("doc_id") % 10 != 7)


def stored(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """(set_name, url, stored) of ``prior``, of hardly more documents than those in ``keys``: no other text is normalised."""
    return gates.marked(_known(spark, sf_dir).select("set_name", "url", "text"), keys).select("set_name", "url", X.squeeze(F.col("text")).alias("stored"))


def previous_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last run's sets: the even-numbered sources that there are, and two that are monitored no more."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("set_name")).distinct().filter("right(set_name, 1) in ('0', '2', '4', '6', '8')")
    gone = spark.range(2).select(F.concat(F.lit("gone"), F.col("id")).alias("set_name"))
    return d.unionByName(gone).select("set_name", F.sha2("set_name", 256).alias("hash"), (F.length("set_name") % 3).cast("long").alias("consecutive_failures"), F.lit(BEFORE).alias("last_success"), (F.length("set_name") % 4).cast("long").alias("schema_failures"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.classify(captures(spark, sf_dir), prior(spark, sf_dir), CFG, stored=lambda keys: stored(spark, sf_dir, keys))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed documents with both texts."""
    return gates.moved(captures(spark, sf_dir), prior(spark, sf_dir), CFG, stored=lambda keys: stored(spark, sf_dir, keys))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: a record for each event, its outcome by the event's type."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("doc"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.to_date("ts").alias("day"),
        X.recode(F.col("event_type"), {"error": "fetch_failed", "click": "unchanged", "view": "not_modified", "purchase": "changed"}).alias("outcome"),
        (F.col("event_id") % 7 * 100).alias("prompt_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5 * 10).alias("output_tokens"), (F.col("event_type") == "purchase").alias("llm_called"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") != "error").alias("ok"),
    )


def monitored_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets as the read side has them, one a customer: amended and checked at times around NOW, with dirty priorities."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    hours = lambda n: F.lit("2026-08-13 00:00:00").cast("timestamp") - F.make_dt_interval(F.lit(0), n.cast("int"))
    return c.select(
        k.alias("id"), F.col("c_name").alias("set_name"), F.when(k % 11 == 0, None).otherwise(F.col("c_mktsegment")).alias("category"), X.slug(F.col("c_name")).alias("file_id"),
        F.when(k % 9 != 0, hours(k * 5 % 1200)).alias("last_amended"), hours(k % 48).alias("last_checked"),
        F.element_at(F.array(*map(F.lit, ("critical", "High", "medium", "low", "Low", "Unknown"))), (k % 6 + 1).cast("int")).alias("last_priority"),
        F.when(k % 5 != 0, F.element_at(F.array(*map(F.lit, ("ok", "ok", "degraded", "failing"))), (k % 4 + 1).cast("int"))).alias("health"),
        F.when(k % 7 == 0, "degraded").alias("own_status"), (k % 13 != 0).alias("has_urls"), (k % 4).alias("failures"),
    )


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of archived files, three kinds for orders, some with an impossible time."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.date_format("o_orderdate", "yyyyMMdd")
    stamp = F.concat(F.when(k % 50 == 0, "20241345").otherwise(at), F.lit("_"), F.lpad((k % 240000).cast("string"), 6, "0"))
    kinds = F.array_compact(F.array(F.when(k % 6 != 5, F.lit("analysis.json")), F.when(k % 2 == 0, F.lit("snapshot.txt")), F.when(k % 3 == 0, F.lit("diff.txt"))))
    return o.select(F.concat(F.lit("set_"), F.col("o_custkey"), F.lit("_x_"), stamp, F.lit("_")).alias("p"), F.explode(kinds).alias("kind")).select(F.concat("p", "kind").alias("file_name"))


# --- the same for DuckDB ---------------------------------------------------

_Q = lambda s: "'" + s.replace("'", "''") + "'"


def sql_text(s: str) -> str:
    """A string literal whose line feeds are chr(10)."""
    return " || chr(10) || ".join(_Q(p) for p in s.split("\n"))


def sql_squeeze(x: str) -> str:
    t = f"replace(replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ')"
    t = f"regexp_replace({t}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    return sql_squeeze_rest(t)


def sql_squeeze_rest(t: str) -> str:
    t = f"regexp_replace({t}, '[ \\t\\f\\x0B]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' ?\\n ?', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({t}, ' ' || chr(10))"


def sql_fold(x: str) -> str:
    # of the characters that case folding changes and lower does not, the test tables have these alone
    return f"replace(translate(lower(translate({x}, {_Q(X.FOLD_FROM)}, {_Q(X.FOLD_TO)})), 'ςſµ', 'σsμ'), 'ß', 'ss')"


def sql_signature(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({sql_fold(x)}, {_Q(s.lower())}) THEN {_Q(s)}" for s in FAILURE_SIGNATURES) + " END"


def sql_lines(x: str) -> str:
    """The lines of a normalised text, whatever ends them."""
    return f"string_split(regexp_replace(translate({x}, chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233), repeat(chr(10), 6)), '\\n\\z', ''), chr(10))"


_URL = "'https://docs.example.org/' || coalesce(source, 'none') || '/doc-' || doc_id || '.html'"
CAPTURES = f"""cap AS (
  SELECT doc_id, coalesce(source, 'none') AS set_name, lang, {_URL} AS url, 'Doc ' || doc_id AS label,
    CASE doc_id % 10 WHEN 4 THEN 'not_modified' WHEN 5 THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 10 IN (4, 5) THEN NULL WHEN doc_id % 100 = 8 THEN repeat(coalesce(text, ''), 3) WHEN doc_id % 100 = 18 THEN '' WHEN doc_id % 100 = 19 THEN replace(coalesce(text, ''), chr(10), chr(8232))
      WHEN doc_id % 10 = 0 THEN coalesce(text, '') || {sql_text(CLAUSE)} WHEN doc_id % 10 = 1 THEN replace(coalesce(text, ''), ' ', '  ')
      WHEN doc_id % 10 = 2 THEN left(coalesce(text, ''), greatest(1, length(coalesce(text, '')) // 3)) WHEN doc_id % 10 = 3 THEN {_Q(BLOCKED)} ELSE coalesce(text, '') END AS text,
    'e' || doc_id || 'b' AS etag, CASE WHEN doc_id % 10 = 5 THEN 'HTTP 503' END AS error
  FROM documents)"""
PRIOR = f"""prior AS (
  SELECT *, sha256(stored) AS hash, length(stored) AS length FROM (
    SELECT coalesce(source, 'none') AS set_name, {_URL} AS url, {sql_squeeze("text")} AS stored, CASE WHEN doc_id % 10 = 6 THEN 1 ELSE 2 END AS pipeline_version,
      doc_id % 4 AS consecutive_failures, '{BEFORE}' AS last_success, '{BEFORE}' AS last_changed, 'e' || doc_id AS etag
    FROM documents WHERE doc_id % 10 <> 7))"""
CLASSIFIED = f"""{CAPTURES}, {PRIOR}, joined AS (
  SELECT c.*, p.hash AS prior_hash, p.length AS prior_length, p.pipeline_version AS prior_version, p.stored, p.consecutive_failures AS prior_failures,
    p.last_success AS prior_success, p.last_changed AS prior_changed, p.etag AS prior_etag, CASE WHEN c.status = 'ok' THEN {sql_squeeze("c.text")} END AS text_now
  FROM cap c LEFT JOIN prior p ON c.set_name = p.set_name AND c.url = p.url),
judged AS (
  SELECT *, CASE WHEN status <> 'ok' THEN NULL WHEN text_now = '' THEN 'empty' WHEN ({sql_signature("text_now")}) IS NOT NULL THEN 'block_page' WHEN length(text_now) < 500 THEN 'too_short'
    WHEN coalesce(prior_length, 0) <> 0 AND length(text_now) < prior_length * 0.6 THEN 'shrank' WHEN coalesce(prior_length, 0) <> 0 AND length(text_now) > prior_length * 2.5 THEN 'grew' END AS reason
  FROM joined),
cls AS (
  SELECT *, CASE WHEN status = 'ok' AND reason IS NULL THEN sha256(text_now) END AS hash_now, CASE WHEN status = 'ok' THEN length(text_now) END AS length_now,
    CASE WHEN status = 'not_modified' THEN 'not_modified' WHEN status = 'failed' THEN 'fetch_failed' WHEN reason IS NOT NULL THEN 'suspect_scrape' WHEN coalesce(prior_hash, '') = '' THEN 'new'
      WHEN prior_version <> 2 OR coalesce(stored, '') = '' THEN 'rebaselined' WHEN prior_hash = sha256(text_now) OR {sql_lines("stored")} = {sql_lines("text_now")} THEN 'unchanged' ELSE 'changed' END AS outcome
  FROM judged)"""
PREVIOUS = f"""prev AS (
  SELECT set_name, sha256(set_name) AS hash, length(set_name) % 3 AS consecutive_failures, '{BEFORE}' AS last_success, length(set_name) % 4 AS schema_failures
  FROM (SELECT DISTINCT coalesce(source, 'none') AS set_name FROM documents WHERE right(coalesce(source, 'none'), 1) IN ('0', '2', '4', '6', '8') UNION ALL SELECT 'gone' || i FROM range(2) t(i)))"""
LOG = """log AS (
  SELECT event_id, user_id AS doc, ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, ts::DATE AS day,
    CASE event_type WHEN 'error' THEN 'fetch_failed' WHEN 'click' THEN 'unchanged' WHEN 'view' THEN 'not_modified' WHEN 'purchase' THEN 'changed' END AS outcome,
    event_id % 7 * 100 AS prompt_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 5 * 10 END AS output_tokens, event_type = 'purchase' AS llm_called, event_type = 'error' AS failed
  FROM events)"""
SETS = """sets AS (
  SELECT c_custkey AS id, c_name AS set_name, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS category, trim(regexp_replace(c_name, '[^a-zA-Z0-9\\-]+', '_', 'g'), '_') AS file_id,
    CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '2026-08-13' - to_hours(CAST(c_custkey * 5 % 1200 AS INT)) END AS last_amended, TIMESTAMP '2026-08-13' - to_hours(CAST(c_custkey % 48 AS INT)) AS last_checked,
    ['critical', 'High', 'medium', 'low', 'Low', 'Unknown'][c_custkey % 6 + 1] AS last_priority,
    CASE WHEN c_custkey % 5 <> 0 THEN ['ok', 'ok', 'degraded', 'failing'][c_custkey % 4 + 1] END AS health,
    CASE WHEN c_custkey % 7 = 0 THEN 'degraded' END AS own_status, c_custkey % 13 <> 0 AS has_urls, c_custkey % 4 AS failures
  FROM customer)"""
FILES = """files AS (
  SELECT p || unnest(list_filter([CASE WHEN k % 6 <> 5 THEN 'analysis.json' END, CASE WHEN k % 2 = 0 THEN 'snapshot.txt' END, CASE WHEN k % 3 = 0 THEN 'diff.txt' END], lambda x: x IS NOT NULL)) AS file_name
  FROM (SELECT o_orderkey AS k, 'set_' || o_custkey || '_x_' || CASE WHEN o_orderkey % 50 = 0 THEN '20241345' ELSE strftime(o_orderdate, '%Y%m%d') END || '_' || lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') || '_' AS p FROM orders)),
parsed AS (
  SELECT *, try_strptime(stamp, '%Y%m%d_%H%M%S') AS ts FROM (
    SELECT file_name, regexp_extract(file_name, '^(.+)_([0-9]{8}_[0-9]{6})_(.*)$', 1) AS file_id, regexp_extract(file_name, '^(.+)_([0-9]{8}_[0-9]{6})_(.*)$', 2) AS stamp, regexp_extract(file_name, '^(.+)_([0-9]{8}_[0-9]{6})_(.*)$', 3) AS kind FROM files)),
idx AS (SELECT file_id, stamp, ts, bool_or(kind = 'snapshot.txt') AS has_snapshot, bool_or(kind = 'diff.txt') AS has_diff FROM parsed WHERE ts IS NOT NULL GROUP BY ALL HAVING bool_or(kind = 'analysis.json'))"""
