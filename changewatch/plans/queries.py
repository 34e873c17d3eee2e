"""The registered queries over the test tables, each with the SQL that DuckDB answers alike (none where SQL cannot say it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changewatch.config import NOISE_BY_HOST, WATCHLIST
from changewatch.functions import text as X
from changewatch.functions import udfs
from changewatch.operators import analysis as A
from changewatch.operators import diffs as D
from changewatch.operators import gates as G
from changewatch.operators import ordered
from changewatch.operators import reports as R
from changewatch.operators import state as S
from changewatch.plans import scenario as C

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW_TS = "2026-08-13 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW_TS).cast("timestamp")


def iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- texts, names, addresses -------------------------------------------------


@query("SELECT c_custkey, trim(regexp_replace(c_name || ' (' || c_mktsegment || ') ', '[^a-zA-Z0-9\\-]+', '_', 'g'), '_') AS file_id FROM customer")
def file_id_slug(spark, d) -> DataFrame:
    return C.table(spark, d, "customer").select("c_custkey", X.slug(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") "))).alias("file_id"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages")
def url_host(spark, d) -> DataFrame:
    return C.table(spark, d, "pages").select("page_id", X.host(F.col("url")).alias("host"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages")
def ui_host(spark, d) -> DataFrame:
    return C.table(spark, d, "pages").select("page_id", X.plain_host(F.col("url")).alias("host"))


_CURLY = "chr(8220) || coalesce(text, '') || chr(8221) || chr(160) || chr(8211) || 'It' || chr(8217) || 'S'"


@query(f"SELECT doc_id, {C.sql_fold(_CURLY)} AS folded FROM documents")
def fold_match(spark, d) -> DataFrame:
    t = F.concat(F.lit("“"), F.coalesce("text", F.lit("")), F.lit("” –It’S"))
    return C.spread(C.table(spark, d, "documents")).select("doc_id", X.fold(t).alias("folded"))


_MESSY = "replace(coalesce(text, ''), '. ', '.' || chr(13) || chr(10) || chr(9) || chr(160) || '  ') || chr(10) || chr(10) || chr(10) || chr(8203) || chr(10) || '  end  '"


@query(f"SELECT doc_id, {C.sql_squeeze(_MESSY)} AS text FROM documents")
def normalise_text(spark, d) -> DataFrame:
    t = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\r\n\t   ")), F.lit("\n\n\n​\n  end  "))
    return C.spread(C.table(spark, d, "documents")).select("doc_id", X.squeeze(t).alias("text"))


@query()
def normalise_exact(spark, d) -> DataFrame:
    t = F.concat(F.lit("&amp;lt;b&gt; é x​\r\n"), F.coalesce("text", F.lit("")))
    return C.spread(C.table(spark, d, "documents")).select("doc_id", udfs.normalise(t, F.lit(None).cast("array<string>")).alias("text"))


_NOISY = "'Effective January 5, 2026 | Archived versions here' || chr(10) || coalesce(text, '') || chr(10) || 'Note: We recently updated our privacy notice today' || chr(10) || 'x'"
_HOSTS = "CASE doc_id % 3 WHEN 0 THEN 'policies.google.com' WHEN 1 THEN 'www.perplexity.ai' ELSE 'example.org' END"


@query(
    f"WITH t AS (SELECT doc_id, {_HOSTS} AS host, {_NOISY} AS raw FROM documents) SELECT doc_id, host, "
    + C.sql_squeeze_rest("CASE host WHEN 'policies.google.com' THEN regexp_replace(raw, '(?im)^effective\\s+\\w+\\s+\\d{1,2},\\s+\\d{4}\\s*\\|\\s*archived versions.*\\n?', '', 'g') WHEN 'www.perplexity.ai' THEN regexp_replace(raw, '(?im)^.*we recently updated our (?:consumer )?privacy notice.*\\n?', '', 'g') ELSE raw END")
    + " AS text FROM t"
)
def noise_strip_by_host(spark, d) -> DataFrame:
    host = F.element_at(F.array(*map(F.lit, ("policies.google.com", "www.perplexity.ai", "example.org"))), (F.col("doc_id") % 3 + 1).cast("int"))
    raw = F.concat(F.lit("Effective January 5, 2026 | Archived versions here\n"), F.coalesce("text", F.lit("")), F.lit("\nNote: We recently updated our privacy notice today\nx"))
    t = C.spread(C.table(spark, d, "documents")).select("doc_id", host.alias("host"), raw.alias("raw"))
    return t.select("doc_id", "host", X.squeeze(F.col("raw"), X.without_noise(F.col("raw"), F.col("host"), [], NOISE_BY_HOST)).alias("text"))


@query(f"SELECT doc_id, sha256({C.sql_squeeze('text')}) AS hash FROM documents")
def content_hash(spark, d) -> DataFrame:
    return C.spread(C.table(spark, d, "documents")).select("doc_id", X.content_hash(X.squeeze(F.col("text"))).alias("hash"))


@query("WITH t AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^a-zA-Z0-9]+', '-', 'g'), '-') AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'root' ELSE lower(trim(right(s, 48), '-')) END || '-' || left(sha256(url), 8) AS document_id FROM t")
def document_id(spark, d) -> DataFrame:
    return C.table(spark, d, "pages").select("page_id", X.document_id(F.col("url")).alias("document_id"))


@query("""WITH t AS (SELECT doc_id, 'https://' || source || '.example.org/legal/' || doc_id || '_' || CASE doc_id % 4 WHEN 0 THEN 'terms-of_service.html' WHEN 1 THEN 'AUP.php' WHEN 2 THEN 'privacyNotice.aspx' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '?x=1' ELSE '' END AS url, CASE WHEN doc_id % 5 = 0 THEN '  Given name ' END AS given, doc_id % 4 AS m FROM documents)
SELECT doc_id, CASE WHEN given IS NOT NULL THEN trim(given) WHEN m = 0 THEN 'Terms Of Service' WHEN m = 1 THEN 'AUP' WHEN m = 2 THEN 'Privacynotice' ELSE split_part(split_part(url, '//', 2), '/', 1) END AS label FROM t""")
def document_label(spark, d) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ("terms-of_service.html", "AUP.php", "privacyNotice.aspx", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/legal/"), F.col("doc_id"), F.lit("_"), tail, F.when(F.col("doc_id") % 2 == 0, "?x=1").otherwise(""))
    return C.table(spark, d, "documents").select("doc_id", X.document_label(url, F.when(F.col("doc_id") % 5 == 0, "  Given name ")).alias("label"))


@query("SELECT page_id FROM pages WHERE page_id % 5 NOT IN (1, 2, 3) AND regexp_matches(url, '^https?://[^/?#]+')")
def safe_url_filter(spark, d) -> DataFrame:
    m = F.col("page_id") % 5
    url = F.when(m == 1, F.concat(F.lit("ftp"), F.substr("url", F.lit(5)))).when(m == 2, "javascript:alert(1)").when(m == 3, "").otherwise(F.col("url"))
    return C.table(spark, d, "pages").filter(X.is_safe_url(url)).select("page_id")


@query()
def extract_text(spark, d) -> DataFrame:
    return C.spread(C.table(spark, d, "pages")).select("page_id", udfs.extract_text("html", F.lit("body > article, [role=main]")).alias("t")).select("page_id", "t.*")


@query("SELECT page_id, upper(left(h, 1)) AS letter, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(h, ''), lambda c: ascii(c)::BIGINT)), lambda acc, c: (acc * 31 + c) % 100000) % 8 AS colour FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h FROM pages)")
def lettermark(spark, d) -> DataFrame:
    letter, colour = X.lettermark(X.host(F.col("url")), F.lit(None).cast("string"))
    return C.table(spark, d, "pages").select("page_id", letter.alias("letter"), colour.cast("long").alias("colour"))


@query("SELECT doc_id, CAST(round(length(coalesce(text, '')) / 1024.0 + 1e-9) AS BIGINT) AS kilobytes FROM documents")
def snapshot_size(spark, d) -> DataFrame:
    return C.table(spark, d, "documents").select("doc_id", X.half_up(F.length(F.coalesce("text", F.lit(""))) / 1024).alias("kilobytes"))


@query("SELECT c_custkey, 'https://example.org/new?title=' || url_encode('Feedback (up): ' || c_name || ' & co') || '&labels=feedback' AS url FROM customer")
def feedback_url(spark, d) -> DataFrame:
    title = X.url_component(F.concat(F.lit("Feedback (up): "), "c_name", F.lit(" & co")))
    # DuckDB escapes ( ) too
    return C.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("https://example.org/new?title="), F.replace(F.replace(title, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")), F.lit("&labels=feedback")).alias("url"))


@query("SELECT source, first(url ORDER BY doc_id) AS url FROM (SELECT *, 'https://docs.example.org/' || doc_id AS url FROM documents) GROUP BY source")
def primary_url(spark, d) -> DataFrame:
    t = C.table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.lit("https://docs.example.org/"), F.col("doc_id")).alias("url")))).alias("urls"))
    return t.select("source", F.coalesce(F.try_element_at("urls", F.lit(1))["url"], F.lit("")).alias("url"))


@query(f"WITH {C.SETS} SELECT id, coalesce(map {{'critical': 'red', 'high': 'orange', 'medium': 'amber', 'low': 'green'}}[lower(last_priority)], 'grey') AS colour, coalesce(map {{'ok': 'Reading normally', 'degraded': 'Last read failed', 'failing': 'Not being read'}}[health], 'Unknown') AS health_label FROM sets")
def labels_and_colours(spark, d) -> DataFrame:
    t = C.monitored_sets(spark, d)
    colour = X.recode(F.lower("last_priority"), {"critical": "red", "high": "orange", "medium": "amber", "low": "green"}, F.lit("grey"))
    return t.select("id", colour.alias("colour"), X.recode(F.col("health"), {"ok": "Reading normally", "degraded": "Last read failed", "failing": "Not being read"}, F.lit("Unknown")).alias("health_label"))


# --- times -------------------------------------------------------------------


@query(f"WITH {C.FILES} SELECT file_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM parsed")
def stamp_parse(spark, d) -> DataFrame:
    t = C.archive_files(spark, d).withColumn("ts", X.parse_stamp(F.regexp_extract("file_name", R.ARCHIVE, 2)))
    return t.select("file_name", iso("ts").alias("at"), X.stamp(F.col("ts")).alias("stamp"))


@query(f"WITH {C.SETS} SELECT id, greatest(0, floor(epoch(TIMESTAMP '{NOW_TS}' - last_amended) / 86400))::BIGINT AS days FROM (SELECT id, CASE WHEN id % 4 = 0 THEN last_amended + to_hours(2000) ELSE last_amended END AS last_amended FROM sets WHERE last_amended IS NOT NULL) UNION ALL SELECT id, NULL FROM sets WHERE last_amended IS NULL")
def days_since(spark, d) -> DataFrame:
    at = F.when(F.col("id") % 4 == 0, F.col("last_amended") + F.expr("INTERVAL 2000 HOURS")).otherwise(F.col("last_amended"))
    return C.monitored_sets(spark, d).select("id", X.days_since(at, now()).alias("days"))


@query(f"WITH {C.SETS} SELECT id, coalesce(floor(epoch(TIMESTAMP '{NOW_TS}' - last_amended) / 86400) > 30, true) AS stale FROM sets")
def staleness(spark, d) -> DataFrame:
    return C.monitored_sets(spark, d).select("id", X.is_stale(F.col("last_amended"), now()).alias("stale"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE date_diff('day', o_orderdate, TIMESTAMP '1998-06-01') % 900 END AS d FROM orders),
u AS (SELECT o_orderkey, CASE WHEN d < 0 THEN d + 900 ELSE d END AS d FROM t)
SELECT o_orderkey, CASE WHEN d IS NULL THEN 'Unknown' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 30 THEN d || ' days ago' WHEN d < 365 THEN CAST(floor(d / 30.0 + 0.5) AS BIGINT) || ' months ago' ELSE CAST(floor(d / 365.0 + 0.5) AS BIGINT) || ' years ago' END AS age FROM u""")
def relative_age(spark, d) -> DataFrame:
    days = F.pmod(F.datediff(F.lit("1998-06-01"), F.to_date("o_orderdate")), F.lit(900))
    then = F.when(F.col("o_orderkey") % 10 != 0, F.lit("1998-06-01").cast("timestamp") - F.make_dt_interval(days))
    return C.table(spark, d, "orders").select("o_orderkey", X.relative_age(then, F.lit("1998-06-01").cast("timestamp")).alias("age"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'Unknown' ELSE strftime(o_orderdate + to_hours(12), '%-d %b %Y') END AS day FROM orders")
def format_day(spark, d) -> DataFrame:
    at = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 2 HOURS"))
    return C.table(spark, d, "orders").select("o_orderkey", X.sydney(at, "d MMM yyyy").alias("day"))


# --- captures and gates --------------------------------------------------------


@query(f"WITH {C.CLASSIFIED} SELECT doc_id, outcome, reason FROM cls")
def document_outcomes(spark, d) -> DataFrame:
    return C.classified(spark, d).select("doc_id", "outcome", "reason")


@query(f"WITH {C.CLASSIFIED} SELECT doc_id, reason, reason IS NULL AS ok FROM cls WHERE status = 'ok'")
def validate_capture(spark, d) -> DataFrame:
    return C.classified(spark, d).filter("status = 'ok'").select("doc_id", "reason", F.col("reason").isNull().alias("ok"))


@query(f"WITH {C.CAPTURES} SELECT doc_id, {C.sql_signature('text')} AS signature FROM cap WHERE status = 'ok' AND ({C.sql_signature('text')}) IS NOT NULL")
def block_page_signature(spark, d) -> DataFrame:
    t = C.captures(spark, d).filter("status = 'ok'").select("doc_id", G.signature(F.col("text"), C.CFG.validation.failure_signatures).alias("signature"))
    return t.filter("signature is not null")


@query(f"WITH {C.CAPTURES}, {C.PRIOR} SELECT doc_id, p.url IS NOT NULL AS known, coalesce(p.length, 0) AS prior_length, coalesce(p.stored, '') <> '' AS has_text FROM cap c LEFT JOIN prior p USING (set_name, url)")
def capture_prior_join(spark, d) -> DataFrame:
    p = C.prior(spark, d).select("set_name", "url", "length", "stored")
    t = C.captures(spark, d).select("doc_id", "set_name", "url").join(p, ["set_name", "url"], "left")
    return t.select("doc_id", F.col("length").isNotNull().alias("known"), F.coalesce("length", F.lit(0)).alias("prior_length"), (F.coalesce("stored", F.lit("")) != "").alias("has_text"))


_ATTEMPTS = """att AS (SELECT page_id, url, a AS attempt, r AS route_no, CASE WHEN (page_id + a * 2 + r) % 5 = 0 THEN 'not_modified' WHEN (page_id + a + r) % 3 = 0 THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN page_id % 4 = 0 THEN 'Just a moment...' WHEN page_id % 4 = 1 THEN ' ' ELSE 'body' END AS text, 'HTTP ' || (500 + a * 2 + r) AS error FROM (SELECT page_id, 'u' || page_id AS url FROM pages), range(1, 3) x(a), range(0, 2) y(r))"""


@query(f"WITH {_ATTEMPTS}, g AS (SELECT *, status = 'not_modified' OR (status = 'ok' AND trim(text) <> '' AND text <> 'Just a moment...') AS usable FROM att), p AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY usable DESC, CASE WHEN usable THEN attempt * 2 + route_no ELSE -(attempt * 2 + route_no) END) AS n FROM g) SELECT url, CASE WHEN usable THEN status ELSE 'failed' END AS status, CASE WHEN usable THEN attempt END AS attempt, CASE WHEN usable THEN route_no END AS route_no, CASE WHEN NOT usable THEN error END AS error, 4 AS tried FROM p WHERE n = 1")
def fetch_pick_first_usable(spark, d) -> DataFrame:
    p = C.table(spark, d, "pages").select("page_id", F.concat(F.lit("u"), F.col("page_id")).alias("url"))
    t = p.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("route_no", F.explode(F.array(F.lit(0), F.lit(1))))
    a, r, k = F.col("attempt"), F.col("route_no"), F.col("page_id")
    t = t.withColumns({
        "status": F.when((k + a * 2 + r) % 5 == 0, "not_modified").when((k + a + r) % 3 == 0, "ok").otherwise("failed"),
        "text": F.when(k % 4 == 0, "Just a moment...").when(k % 4 == 1, " ").otherwise("body"),
        "error": F.concat(F.lit("HTTP "), (500 + a * 2 + r).cast("string")),
    })
    return S.first_usable(t, C.CFG)


@query("SELECT page_id, CASE WHEN page_id % 60 = 0 THEN true ELSE (380 + page_id % 60 * 3) NOT BETWEEN 400 AND 499 OR (380 + page_id % 60 * 3) IN (401, 403, 405, 406, 429) END AS worth FROM pages")
def worth_rendering(spark, d) -> DataFrame:
    k = F.col("page_id") % 60
    return C.table(spark, d, "pages").select("page_id", G.worth_rendering(F.when(k != 0, 380 + k * 3)).alias("worth"))


@query(f"WITH {C.CLASSIFIED} SELECT doc_id, list_sort({C.sql_lines('text_now')}) <> list_sort({C.sql_lines('stored')}) OR {C.sql_lines('text_now')} <> {C.sql_lines('stored')} AS moved FROM cls WHERE hash_now IS NOT NULL AND coalesce(stored, '') <> '' AND prior_version = 2 AND prior_hash <> hash_now")
def cosmetic_gate(spark, d) -> DataFrame:
    """Of the documents whose hash moved, which have a diff that is not empty."""
    captures, prior = C.captures(spark, d), C.prior(spark, d)
    by_hash = G.gate(captures, prior, C.CFG)
    diffed = D.diff_moved(G.changed(by_hash, captures, prior), C.CFG)
    return diffed.select("doc_id", ((F.col("diff.lines_added") > 0) | (F.col("diff.lines_removed") > 0)).alias("moved"))


# --- diffs ---------------------------------------------------------------------


@query()
def unified_diff(spark, d) -> DataFrame:
    t = D.diff_moved(C.changed(spark, d), C.CFG)
    return t.select("doc_id", F.col("diff.text").alias("text"), F.col("diff.added").alias("added"), F.col("diff.removed").alias("removed"), F.col("diff.truncated").alias("truncated"), F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {C.CLASSIFIED}, l AS (SELECT doc_id, unnest(string_split(text_now, chr(10))) AS line, 1 AS s FROM cls WHERE outcome = 'changed' UNION ALL SELECT doc_id, unnest(string_split(stored, chr(10))), -1 FROM cls WHERE outcome = 'changed')
SELECT doc_id, line, CASE WHEN sum(s) > 0 THEN 'added' ELSE 'removed' END AS change, abs(sum(s))::BIGINT AS n FROM l GROUP BY doc_id, line HAVING sum(s) <> 0""")
def line_multiset_diff(spark, d) -> DataFrame:
    return D.line_differences(C.changed(spark, d), ["doc_id"], "prior_stored", "text_now")


# a diff made of a document's lines, by their number: headers, hunks, additions, removals
_DIFF = """dl AS (SELECT doc_id, i, CASE WHEN i = 1 THEN '--- a' WHEN i = 2 THEN '+++ b' WHEN i % 9 = 3 THEN '@@ -' || i || ' @@' WHEN i % 4 = 0 THEN '+' || x WHEN i % 4 = 1 THEN '-' || x ELSE ' ' || x END AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS x, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS i FROM documents WHERE text NOT LIKE '%' || chr(10) || chr(10) || '%'))"""


def _made_diffs(spark, d) -> DataFrame:
    def line(x, i):
        i = i + 1
        return F.when(i == 1, "--- a").when(i == 2, "+++ b").when(i % 9 == 3, F.concat(F.lit("@@ -"), i, F.lit(" @@"))).when(i % 4 == 0, F.concat(F.lit("+"), x)).when(i % 4 == 1, F.concat(F.lit("-"), x)).otherwise(F.concat(F.lit(" "), x))

    words = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("~")), " ")
    return C.spread(C.table(spark, d, "documents")).select("doc_id", F.array_join(F.transform(words, line), "\n").alias("diff"))


_MADE = _DIFF.replace("coalesce(text, '')", "replace(coalesce(text, ''), chr(10), '~')").replace(" WHERE text NOT LIKE '%' || chr(10) || chr(10) || '%'", "")


@query(f"WITH {_MADE} SELECT doc_id, coalesce(string_agg(substr(line, 2), chr(10) ORDER BY i) FILTER (WHERE regexp_matches(line, '^[+-]') AND NOT regexp_matches(line, '^(\\+\\+\\+|---)')), '') AS changed FROM dl GROUP BY doc_id")
def changed_lines(spark, d) -> DataFrame:
    return _made_diffs(spark, d).select("doc_id", F.array_join(D.changed_lines(F.col("diff")), "\n").alias("changed"))


@query(f"WITH {_MADE} SELECT doc_id, count(*) FILTER (WHERE line LIKE '+%' AND line NOT LIKE '+++%') AS added, count(*) FILTER (WHERE line LIKE '-%' AND line NOT LIKE '---%') AS removed FROM dl GROUP BY doc_id")
def diff_line_counts(spark, d) -> DataFrame:
    added, removed = D.line_counts(F.col("diff"))
    return _made_diffs(spark, d).select("doc_id", added.alias("added"), removed.alias("removed"))


@query(f"""WITH {_MADE}, h AS (SELECT *, count(*) FILTER (WHERE line LIKE '@@%') OVER (PARTITION BY doc_id ORDER BY i) - 1 AS hunk_no FROM dl WHERE i > 2)
SELECT doc_id, 0 AS file_no, hunk_no::INT AS hunk_no, (row_number() OVER (PARTITION BY doc_id, hunk_no ORDER BY i) - 1)::INT AS line_no, CASE left(line, 1) WHEN '+' THEN 'add' WHEN '-' THEN 'remove' WHEN '\\' THEN 'meta' ELSE 'context' END AS type,
  substr(line, 2) AS text FROM h WHERE line NOT LIKE '@@%' AND hunk_no >= 0 AND line NOT LIKE '--- %' AND line NOT LIKE '+++ %'""")
def parse_diff(spark, d) -> DataFrame:
    return D.parse(_made_diffs(spark, d), ["doc_id"], "diff").select("doc_id", "file_no", "hunk_no", "line_no", "type", "text")


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || chr(10) || '… diff truncated …' ELSE text END AS text FROM documents")
def diff_truncate(spark, d) -> DataFrame:
    return C.table(spark, d, "documents").select("doc_id", D.truncate(F.col("text"), 1000).alias("text"))


def _tagged_text():
    m = F.col("doc_id") % 8
    extra = F.element_at(F.array(*map(F.lit, _EXTRAS)), (m + 1).cast("int"))
    return F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), extra)


_EXTRAS = ("It costs $5 or 1,200.50 AUD.", "On 5 March or 2026-01-05 or 1/2/26.", "A fee of 2.5 % applies", "within 30 days and 2 Years", "see Section 4.2, clause 9", "you must not resell; mayä", "nothing here", "ARBITRATION and Australia, warranty")
_TAGGED = "coalesce(text, '') || chr(10) || [" + ", ".join(f"'{e}'" for e in _EXTRAS) + "][doc_id % 8 + 1]"
_MONTH_NAMES = "(january|february|march|april|may|june|july|august|september|october|november|december)"
# what the tags look for, said once more for DuckDB, with word boundaries of ASCII; letters beyond it are made x first
_SAID = {
    "money": "[$€£]\\s?\\d|\\b\\d[\\d,]*(\\.\\d+)?\\s?(AUD|USD|EUR|GBP)\\b",
    "date": f"(?i)\\b\\d\\d?\\s+{_MONTH_NAMES}\\b|\\b{_MONTH_NAMES}\\s+\\d\\d?\\b|\\b\\d{{4}}-\\d\\d-\\d\\d\\b|\\b\\d\\d?/\\d\\d?/\\d{{2,4}}\\b",
    "percentage": "\\b\\d+(\\.\\d+)?\\s?%",
    "duration": "(?i)\\b\\d+\\s+(business days?|day|days|month|months|year|years)\\b",
    "section_reference": "(?i)\\b(appendix|article|clause|paragraph|schedule|section)\\s+\\d+\\b",
    "obligation": "(?i)\\b(must|shall|may|will not|will be required to)\\b",
}
_PATTERN_SQL = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{name}' END" for name, p in _SAID.items())


@query(f"SELECT doc_id, array_to_string(list_filter([{_PATTERN_SQL}], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT doc_id, regexp_replace({_TAGGED}, '[À-ÖØ-öø-ɏ]', 'x', 'g') AS t FROM documents)")
def fingerprint_tags(spark, d) -> DataFrame:
    return C.spread(C.table(spark, d, "documents")).select("doc_id", _tagged_text().alias("t")).select("doc_id", F.array_join(D.pattern_tags(F.col("t")), ",").alias("tags"))


_WATCH_SQL = ", ".join(f"CASE WHEN contains(lower(t), '{w.lower()}') THEN 'watchlist:{w}' END" for w in sorted(set(WATCHLIST)))


@query(f"SELECT doc_id, array_to_string(list_filter([{_WATCH_SQL}], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT doc_id, {_TAGGED} AS t FROM documents)")
def watchlist_hits(spark, d) -> DataFrame:
    return C.spread(C.table(spark, d, "documents")).select("doc_id", _tagged_text().alias("t")).select("doc_id", F.array_join(D.watch_tags(F.col("t"), WATCHLIST), ",").alias("tags"))


@query()
def combined_diff(spark, d) -> DataFrame:
    return D.combine(D.diff_moved(C.changed(spark, d), C.CFG))


# --- sets and state ------------------------------------------------------------


@query(f"""WITH {C.CLASSIFIED} SELECT set_name, url, outcome AS status, CASE WHEN outcome IN ('new', 'rebaselined', 'changed', 'unchanged') THEN hash_now ELSE prior_hash END AS hash, CASE WHEN outcome IN ('new', 'rebaselined', 'changed', 'unchanged') THEN length_now ELSE prior_length END AS length,
  CASE WHEN outcome IN ('new', 'rebaselined', 'changed', 'unchanged') THEN etag WHEN outcome = 'not_modified' THEN coalesce(etag, prior_etag) ELSE prior_etag END AS etag, CASE WHEN outcome IN ('fetch_failed', 'suspect_scrape') THEN coalesce(prior_failures, 0) + 1 ELSE 0 END AS consecutive_failures,
  CASE WHEN outcome IN ('fetch_failed', 'suspect_scrape') THEN prior_success ELSE '{C.NOW}' END AS last_success, CASE WHEN outcome IN ('new', 'changed') THEN '{C.NOW}' ELSE prior_changed END AS last_changed, CASE WHEN outcome = 'suspect_scrape' THEN length_now END AS suspect_length FROM cls""")
def doc_state_next(spark, d) -> DataFrame:
    return S.next_documents(C.classified(spark, d), C.NOW).select("set_name", "url", "status", "hash", "length", "etag", "consecutive_failures", "last_success", "last_changed", "suspect_length")


@query(f"""WITH {C.CLASSIFIED}, n AS (SELECT set_name, url, CASE WHEN outcome IN ('new', 'rebaselined', 'changed', 'unchanged') THEN hash_now ELSE prior_hash END AS hash FROM cls) SELECT set_name, sha256(string_agg(coalesce(hash, ''), chr(10) ORDER BY url)) AS hash FROM n GROUP BY set_name""")
def set_rollup_hash(spark, d) -> DataFrame:
    return S.rollup_hash(S.next_documents(C.classified(spark, d), C.NOW))


@query("SELECT conv_id, string_agg('--- Content from https://e.org/' || turn || ' ---' || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS aggregate FROM conversations GROUP BY conv_id")
def aggregate_snapshot(spark, d) -> DataFrame:
    t = C.table(spark, d, "conversations").withColumn("url", F.concat(F.lit("https://e.org/"), F.col("turn")))
    return S.aggregate_snapshot(t, "conv_id", "turn", "url", "text")


@query("SELECT conv_id, 'https://e.org/' || turn AS url, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations")
def split_aggregate(spark, d) -> DataFrame:
    return S.split_aggregate(aggregate_snapshot(spark, d), ["conv_id"], "aggregate")


@query(f"""SELECT conv_id, 'https://e.org/' || turn AS url, sha256({C.sql_squeeze('text')}) AS hash, length({C.sql_squeeze('text')}) AS length, 1 AS pipeline_version, 'legacy' AS extractor FROM conversations WHERE turn % 3 <> 1 AND {C.sql_squeeze('text')} <> ''""")
def legacy_seed(spark, d) -> DataFrame:
    configured = C.table(spark, d, "conversations").filter("turn % 3 <> 1").select("conv_id", F.concat(F.lit("https://e.org/"), F.col("turn")).alias("url"))
    t = split_aggregate(spark, d).join(configured, ["conv_id", "url"]).withColumn("t", X.squeeze(F.col("text"))).filter("t <> ''")
    return t.select("conv_id", "url", X.content_hash(F.col("t")).alias("hash"), F.length("t").cast("long").alias("length"), F.lit(1).alias("pipeline_version"), F.lit("legacy").alias("extractor"))


_ROLLUP = "roll AS (SELECT set_name, bool_and(outcome NOT IN ('fetch_failed', 'suspect_scrape')) AS all_ok, bool_or(outcome IN ('fetch_failed', 'suspect_scrape')) AS any_failed, count(*) FILTER (WHERE outcome NOT IN ('fetch_failed', 'suspect_scrape')) AS readable, count(*) FILTER (WHERE outcome = 'changed') AS changed, count(*) FILTER (WHERE outcome = 'new') AS new, count(*) FILTER (WHERE outcome = 'rebaselined') AS rebaselined, count(*) AS documents FROM cls GROUP BY set_name)"


@query(f"WITH {C.CLASSIFIED}, {_ROLLUP} SELECT * FROM roll")
def set_rollup(spark, d) -> DataFrame:
    return S.set_rollup(C.classified(spark, d))


@query(f"WITH {C.CLASSIFIED}, {_ROLLUP}, {C.PREVIOUS} SELECT r.set_name, CASE WHEN readable = 0 THEN 'unreadable' WHEN changed > 0 THEN 'analyse' WHEN new > 0 AND p.hash IS NULL THEN 'first_scan' WHEN new + rebaselined > 0 THEN 'rebaselined' ELSE 'unchanged' END AS decision FROM roll r LEFT JOIN prev p USING (set_name)")
def set_decisions(spark, d) -> DataFrame:
    return S.decide(S.set_rollup(C.classified(spark, d)), C.previous_sets(spark, d)).select("set_name", "decision")


@query(f"WITH {C.CLASSIFIED}, {_ROLLUP}, {C.PREVIOUS} SELECT r.set_name, CASE WHEN any_failed THEN coalesce(p.consecutive_failures, 0) + 1 ELSE 0 END AS consecutive_failures, CASE WHEN all_ok THEN '{C.NOW}' ELSE p.last_success END AS last_success FROM roll r LEFT JOIN prev p USING (set_name)")
def set_counters(spark, d) -> DataFrame:
    return S.counters(S.set_rollup(C.classified(spark, d)), C.previous_sets(spark, d), C.NOW)


@query(f"""WITH {C.CLASSIFIED}, l AS (SELECT set_name, doc_id, unnest(string_split(text_now, chr(10))) AS line, 1 AS s FROM cls WHERE outcome = 'changed' UNION ALL SELECT set_name, doc_id, unnest(string_split(stored, chr(10))), -1 FROM cls WHERE outcome = 'changed'),
n AS (SELECT set_name, doc_id, line, sum(s) AS s FROM l GROUP BY ALL HAVING sum(s) <> 0)
SELECT set_name, coalesce(sum(s) FILTER (WHERE s > 0), 0)::BIGINT AS lines_added, coalesce(-sum(s) FILTER (WHERE s < 0), 0)::BIGINT AS lines_removed, count(DISTINCT doc_id) AS documents FROM n GROUP BY set_name""")
def set_change_totals(spark, d) -> DataFrame:
    n = D.line_differences(C.changed(spark, d), ["set_name", "doc_id"], "prior_stored", "text_now")
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("change") == kind, F.col("n"))), F.lit(0))
    return n.groupBy("set_name").agg(part("added").alias("lines_added"), part("removed").alias("lines_removed"), F.count_distinct("doc_id").alias("documents"))


@query(f"WITH {C.PREVIOUS} SELECT set_name, false AS carried FROM (SELECT DISTINCT coalesce(source, 'none') AS set_name FROM documents) UNION ALL SELECT set_name, true FROM prev WHERE set_name NOT IN (SELECT coalesce(source, 'none') FROM documents)")
def carry_forward(spark, d) -> DataFrame:
    current = C.captures(spark, d).select("set_name").distinct()
    return S.carry_forward(C.previous_sets(spark, d).select("set_name"), current)


_RESULTS = "CASE id % 3 WHEN 0 THEN 'material_change' WHEN 1 THEN 'no_material_change' ELSE 'uncertain' END"


@query(f"WITH {C.SETS}, r AS (SELECT id, last_priority, strftime(last_amended, '%Y-%m-%d %H:%M:%S') AS last_amended, {_RESULTS} AS verdict FROM sets) SELECT id, CASE WHEN verdict <> 'no_material_change' THEN '{C.NOW}' ELSE last_amended END AS last_amended, CASE WHEN verdict <> 'no_material_change' THEN 'high' ELSE last_priority END AS last_priority, CASE WHEN verdict <> 'no_material_change' THEN verdict END AS last_verdict, verdict AS review_verdict FROM r")
def badge_rule(spark, d) -> DataFrame:
    verdict = F.element_at(F.array(*map(F.lit, ("material_change", "no_material_change", "uncertain"))), (F.col("id") % 3 + 1).cast("int"))
    t = C.monitored_sets(spark, d).select("id", "last_priority", iso("last_amended").alias("last_amended"), F.lit(None).cast("string").alias("last_verdict"), verdict.alias("verdict"), F.lit("high").alias("priority"))
    return S.badge(t, C.NOW).select("id", "last_amended", "last_priority", "last_verdict", "review_verdict")


@query(f"""WITH {C.CLASSIFIED}, {C.PREVIOUS}, bad AS (SELECT set_name FROM prev WHERE schema_failures >= 1) SELECT url, CASE WHEN outcome = 'changed' AND b.set_name IS NOT NULL THEN 'analysis_pending' ELSE outcome END AS status,
  CASE WHEN outcome = 'changed' AND b.set_name IS NOT NULL THEN prior_hash WHEN outcome IN ('new', 'rebaselined', 'changed', 'unchanged') THEN hash_now ELSE prior_hash END AS hash,
  CASE WHEN outcome = 'changed' AND b.set_name IS NOT NULL THEN prior_etag WHEN outcome IN ('new', 'rebaselined', 'changed', 'unchanged') THEN etag WHEN outcome = 'not_modified' THEN coalesce(etag, prior_etag) ELSE prior_etag END AS etag FROM cls LEFT JOIN bad b USING (set_name)""")
def revert_on_schema_failure(spark, d) -> DataFrame:
    t = S.next_documents(C.classified(spark, d), C.NOW)
    failed = C.previous_sets(spark, d).filter("schema_failures >= 1")
    return S.revert(t, C.prior(spark, d), failed).select("url", "status", "hash", "etag")


_DEFS = """defs AS (SELECT doc_id AS pos, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 'set ' || (doc_id // 3) END AS setName, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS category, doc_id % 7 AS m FROM documents)"""


@query(f"WITH {_DEFS}, ok AS (SELECT * FROM defs WHERE coalesce(setName, '') <> '' AND coalesce(category, '') <> '' AND m NOT IN (2, 3)) SELECT setName, min(pos) AS pos FROM ok GROUP BY setName")
def valid_sets(spark, d) -> DataFrame:
    k = F.col("doc_id")
    entry = lambda u: F.struct(u.cast("string").alias("url"))
    urls = F.when(k % 7 == 2, F.array().cast("array<struct<url:string>>")).when(k % 7 == 3, F.array(entry(F.lit("https://a.org")), entry(F.lit(None)))).otherwise(F.array(entry(F.lit("https://a.org"))))
    t = C.table(spark, d, "documents").select(k.alias("pos"), F.when(k % 17 != 0, F.concat(F.lit("set "), F.floor(k / 3).cast("string"))).alias("setName"), F.when(k % 5 == 0, "").otherwise(F.col("lang")).alias("category"), urls.alias("urls"))
    return S.valid_sets(t).select("setName", "pos")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src7')")
def only_filter(spark, d) -> DataFrame:
    return C.table(spark, d, "documents").filter(F.col("source").isin("src1", "src7")).select("doc_id", "source")


# --- run log and health ---------------------------------------------------------


@query(f"WITH {C.LOG} SELECT coalesce(outcome, 'unknown') AS outcome, count(*) AS n FROM log GROUP BY 1")
def outcome_counts(spark, d) -> DataFrame:
    return R.outcome_counts(C.events_log(spark, d))


@query(f"WITH {C.LOG} SELECT sum(prompt_tokens)::BIGINT AS prompt_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, count(*) FILTER (WHERE llm_called) AS llm_calls FROM log")
def token_totals(spark, d) -> DataFrame:
    return R.token_totals(C.events_log(spark, d))


@query(f"WITH {C.LOG} SELECT round(count(*) FILTER (WHERE outcome = 'fetch_failed') / count(*), 4) AS error_rate FROM log")
def run_error_rate(spark, d) -> DataFrame:
    return R.error_rate(C.events_log(spark, d)).select(F.round("error_rate", 4).alias("error_rate"))


@query(f"WITH {C.LOG} SELECT event_id FROM log WHERE ts >= TIMESTAMP '2024-01-20' OR event_id % 20 = 0")
def runlog_recent(spark, d) -> DataFrame:
    t = C.events_log(spark, d).withColumn("timestamp", F.when(F.col("event_id") % 20 != 0, F.col("timestamp")).otherwise("nonsense"))
    return R.recent(t, "2024-01-30 00:00:00", 10).select("event_id")


@query(f"WITH {C.LOG}, i AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY doc ORDER BY ts, event_id) AS island FROM log) SELECT event_id, count(*) FILTER (WHERE failed) OVER (PARTITION BY doc, island ORDER BY ts, event_id) AS streak FROM i")
def failure_streak(spark, d) -> DataFrame:
    return R.failure_streaks(C.events_log(spark, d), "doc", ["timestamp", "event_id"], "failed").select("event_id", "streak")


@query(f"WITH {C.LOG} SELECT event_id, max(CASE WHEN NOT failed THEN timestamp END) OVER (PARTITION BY doc ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_success FROM log")
def last_success_carry(spark, d) -> DataFrame:
    return R.last_success(C.events_log(spark, d), "doc", ["timestamp", "event_id"], "ok", "timestamp").select("event_id", "last_success")


@query(f"WITH {C.LOG}, w AS (SELECT event_id, outcome, lag(outcome) OVER (PARTITION BY doc ORDER BY ts, event_id) AS previous FROM log) SELECT * FROM w WHERE outcome IS DISTINCT FROM previous AND previous IS NOT NULL")
def hash_transitions(spark, d) -> DataFrame:
    return R.transitions(C.events_log(spark, d), "doc", ["timestamp", "event_id"], "outcome").select("event_id", "outcome", "previous")


@query(f"WITH {C.LOG} SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(outcome, 'unknown') AS outcome, count(*) AS n FROM log GROUP BY 1, 2")
def daily_outcomes(spark, d) -> DataFrame:
    return C.events_log(spark, d).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("outcome", F.lit("unknown")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_STATE = f"{C.CLASSIFIED}, st AS (SELECT set_name, url, CASE WHEN outcome IN ('fetch_failed', 'suspect_scrape') THEN coalesce(prior_failures, 0) + 1 ELSE 0 END AS f FROM cls), dh AS (SELECT *, CASE WHEN f >= 3 THEN 'failing' WHEN f > 0 THEN 'degraded' ELSE 'ok' END AS health FROM st)"


@query(f"WITH {_STATE} SELECT url, health FROM dh")
def document_health(spark, d) -> DataFrame:
    return R.document_health(S.next_documents(C.classified(spark, d), C.NOW), C.CFG).select("url", "health")


_SET_NAMES = f"{C.PREVIOUS}, names AS (SELECT DISTINCT coalesce(source, 'none') AS set_name FROM documents UNION SELECT set_name FROM prev)"
_SET_HEALTH = f"{_STATE}, {_SET_NAMES}, sh AS (SELECT n.set_name, CASE max(CASE health WHEN 'failing' THEN 2 WHEN 'degraded' THEN 1 WHEN 'ok' THEN 0 END) WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' ELSE 'failing' END AS status, count(d.url) AS documents_total, count(*) FILTER (WHERE health <> 'ok') AS documents_failing FROM names n LEFT JOIN dh d USING (set_name) GROUP BY n.set_name)"


def _set_health(spark, d) -> DataFrame:
    docs = S.next_documents(C.classified(spark, d), C.NOW)
    names = C.captures(spark, d).select("set_name").union(C.previous_sets(spark, d).select("set_name")).distinct()
    return R.set_health(names, docs, C.CFG)


@query(f"WITH {_SET_HEALTH} SELECT set_name, status FROM sh")
def set_health(spark, d) -> DataFrame:
    return _set_health(spark, d).select("set_name", "status")


@query(f"WITH {_SET_HEALTH} SELECT s.*, p.last_success, CASE WHEN p.last_success IS NOT NULL THEN 12 END AS days_since_success FROM sh s LEFT JOIN prev p USING (set_name)")
def health_report(spark, d) -> DataFrame:
    t = _set_health(spark, d).join(C.previous_sets(spark, d).select("set_name", "last_success"), "set_name", "left")
    return t.select("set_name", "status", "documents_total", "documents_failing", "last_success", X.days_since(X.instant(F.col("last_success")), F.lit(C.NOW).cast("timestamp")).alias("days_since_success"))


@query(f"""WITH {_STATE}, e AS (SELECT url, CASE WHEN outcome = 'fetch_failed' THEN error WHEN reason = 'empty' THEN 'empty: no text' WHEN reason = 'block_page' THEN 'block_page: holds: ' || ({C.sql_signature("text_now")})
  WHEN reason = 'too_short' THEN 'too_short: ' || length(text_now) || ' characters, fewer than 500' ELSE reason || ': ' || length(text_now) || ' of ' || prior_length || ' characters' END AS last_error, prior_success AS last_success FROM cls)
SELECT set_name, url, health AS status, f AS consecutive_failures, last_success, last_error FROM dh JOIN e USING (url) WHERE health <> 'ok'""")
def failing_documents(spark, d) -> DataFrame:
    return R.failing_documents(S.next_documents(C.classified(spark, d), C.NOW), C.CFG).drop("label")


@query(f"WITH {_SET_HEALTH} SELECT CASE max(CASE status WHEN 'failing' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'failing' WHEN 1 THEN 'degraded' ELSE 'ok' END AS overall FROM sh")
def overall_health(spark, d) -> DataFrame:
    rank = X.recode(F.col("status"), {k: str(v) for k, v in S.RANK.items()}, F.lit("0")).cast("int")
    names = F.array(*map(F.lit, S.RANK))
    return _set_health(spark, d).agg(F.element_at(names, F.coalesce(F.max(rank), F.lit(0)) + 1).alias("overall"))


_ALERTS = f"""{_STATE}, {C.PREVIOUS}, al AS (
SELECT 'source_failing' AS kind, set_name, url, f AS failures FROM dh WHERE health = 'failing'
UNION ALL SELECT 'schema_failures', set_name, '', schema_failures FROM prev WHERE schema_failures >= 2
UNION ALL SELECT 'run_error_rate', '', '', 0 FROM (SELECT count(*) FILTER (WHERE outcome IN ('fetch_failed', 'suspect_scrape')) / count(*) AS r FROM cls) WHERE r > 0.3)"""


def _alerts(spark, d) -> DataFrame:
    t = C.classified(spark, d)
    return R.alerts(C.previous_sets(spark, d), S.next_documents(t, C.NOW), R.error_rate(t), C.CFG)


@query(f"WITH {_ALERTS} SELECT * FROM al")
def health_alerts(spark, d) -> DataFrame:
    return _alerts(spark, d).select("kind", "set_name", "url", "failures")


@query("SELECT c_custkey, '| ' || c_name || ' | — | source_failing — a \\| b ' || c_mktsegment || ' | ' || c_custkey % 4 || ' |' AS \"row\" FROM customer")
def alert_markdown(spark, d) -> DataFrame:
    t = C.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("set_name"), F.lit("").alias("url"), F.lit("source_failing").alias("kind"), (F.col("c_custkey") % 4).alias("failures"), F.concat(F.lit("a | b "), "c_mktsegment").alias("detail"))
    return R.alert_rows(t).select("c_custkey", "row")


@query(f"WITH {C.CLASSIFIED} SELECT outcome, count(*) AS n FROM cls GROUP BY outcome")
def dry_run_report(spark, d) -> DataFrame:
    return R.outcome_counts(C.classified(spark, d)).orderBy("outcome")


# --- history and retention --------------------------------------------------------


@query(f"WITH {C.FILES} SELECT file_id, stamp, has_snapshot, has_diff FROM idx")
def history_index(spark, d) -> DataFrame:
    return R.archive_index(C.archive_files(spark, d)).select("file_id", "stamp", "has_snapshot", "has_diff")


@query(f"WITH {C.FILES} SELECT file_id, count(*) AS n, string_agg(stamp, ',' ORDER BY stamp DESC) AS stamps FROM idx WHERE file_id IN (SELECT 'set_' || c_custkey || '_x' FROM customer WHERE c_custkey % 3 = 0) GROUP BY file_id")
def history_known_only(spark, d) -> DataFrame:
    known = C.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("set_"), F.col("c_custkey"), F.lit("_x")).alias("file_id"))
    return R.history(R.archive_index(C.archive_files(spark, d), known))


@query(f"WITH {C.FILES} SELECT file_id, stamp, n, greatest(0, total - 12) AS remaining FROM (SELECT file_id, stamp, row_number() OVER (PARTITION BY file_id ORDER BY stamp DESC) AS n, count(*) OVER (PARTITION BY file_id) AS total FROM idx) WHERE n <= 12")
def history_top12(spark, d) -> DataFrame:
    w = W.partitionBy("file_id")
    t = R.archive_index(C.archive_files(spark, d)).withColumn("n", F.row_number().over(w.orderBy(F.desc("stamp"))).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))
    return t.filter("n <= 12").select("file_id", "stamp", "n", F.greatest(F.lit(0), F.col("total") - 12).alias("remaining"))


@query(f"WITH {C.FILES} SELECT file_name FROM parsed WHERE ts < TIMESTAMP '2000-01-01' - INTERVAL 365 DAYS")
def prune_archives(spark, d) -> DataFrame:
    return R.expired(C.archive_files(spark, d), "2000-01-01 00:00:00", 365).select("file_name")


_BODIES = """bodies AS (SELECT *, CASE WHEN kind <> 'analysis.json' THEN 'text' WHEN substr(stamp, 15, 1) IN ('0', '1') THEN 'not json' WHEN substr(stamp, 15, 1) = '2' THEN '[1]'
  ELSE '{"priority": "Low", "verdict": "uncertain", "summary": "of ' || stamp || '", "changed_documents": ["a", "' || file_id || '"]}' END AS text FROM parsed WHERE ts IS NOT NULL)"""


@query(f"""WITH {C.FILES}, {_BODIES} SELECT file_id, stamp, max('logs/' || file_name) FILTER (WHERE kind = 'analysis.json') AS analysis_path, max('logs/' || file_name) FILTER (WHERE kind = 'snapshot.txt') AS snapshot_path, max('logs/' || file_name) FILTER (WHERE kind = 'diff.txt') AS diff_path,
  max(CASE WHEN text LIKE '{{%' THEN json_extract_string(text, '$.priority') END) AS priority, max(CASE WHEN text LIKE '{{%' THEN json_extract_string(text, '$.verdict') END) AS verdict, max(CASE WHEN text LIKE '{{%' THEN json_extract_string(text, '$.summary') END) AS summary,
  coalesce(max(CASE WHEN text LIKE '{{%' THEN array_to_string(json_extract_string(text, '$.changed_documents[*]'), ',') END), '') AS changed_documents
FROM bodies GROUP BY file_id, stamp HAVING bool_or(kind = 'analysis.json')""")
def history_records(spark, d) -> DataFrame:
    part = lambda i: F.regexp_extract("file_name", R.ARCHIVE, i)
    last = F.right(part(2), F.lit(1))
    said = F.concat(F.lit('{"priority": "Low", "verdict": "uncertain", "summary": "of '), part(2), F.lit('", "changed_documents": ["a", "'), part(1), F.lit('"]}'))
    text = F.when(part(3) != "analysis.json", "text").when(last.isin("0", "1"), "not json").when(last == "2", "[1]").otherwise(said)
    return R.history_records(C.archive_files(spark, d).withColumn("text", text)).drop("ts").withColumn("changed_documents", F.coalesce(F.array_join("changed_documents", ","), F.lit("")))


@query(f"""WITH {C.SETS}, a AS (SELECT file_id, strftime(last_amended, '%Y%m%d_%H%M%S') AS stamp, unnest(['analysis.json', 'snapshot.txt', 'diff.txt']) AS kind, unnest(['{{}}', CASE WHEN id % 2 = 0 THEN set_name END, 'd' || id]) AS text FROM sets WHERE id % 3 = 0 AND last_amended IS NOT NULL)
SELECT file_id || '_' || stamp || '_' || kind AS file_name, text FROM a WHERE text IS NOT NULL""")
def archive_previous(spark, d) -> DataFrame:
    """The artefacts that a run replaces, under their names in the archive."""
    t = C.monitored_sets(spark, d).filter("last_amended is not null")
    texts = (("analysis", F.lit("{}")), ("snapshot", F.when(F.col("id") % 2 == 0, F.col("set_name"))), ("diff", F.concat(F.lit("d"), "id")))
    each = F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in texts)))
    artefacts = t.filter("id % 3 = 0").select("file_id", F.lit(0).alias("part"), iso("last_amended").alias("at"), each)
    return S.archive(artefacts).select("file_name", "text")


# --- replies of the model -----------------------------------------------------------

_CASES = (
    '{"verdict": "material_change", "summary": " s ", "analysis": "a", "priority": " HIGH "}',
    '{"verdict": "no_material_change", "summary": "s", "analysis": "a", "priority": "critical"}',
    '```json\n{"verdict": "Uncertain", "summary": "s", "analysis": "a", "priority": "low"}\n```',
    '{"verdict": "probably_fine", "summary": "s", "analysis": "a", "priority": "low"}',
    '{"verdict": "uncertain", "summary": "s", "analysis": "a", "priority": "unknown"}',
    '{"verdict": "uncertain", "summary": "s", "priority": "low"}',
    '{"verdict": "uncertain", "summary": 1, "analysis": "a", "priority": "low"}',
    '{"verdict": "uncertain", "summary": "s", "analysis": "  ", "priority": "low"}',
    "[1, 2]",
    "not json {",
    "   ",
)
_WANT = (
    (None, "material_change", "s", "high"),
    (None, "no_material_change", "s", "low"),
    (None, "uncertain", "s", "low"),
    ("bad verdict", None, None, None),
    ("bad priority", None, None, None),
    ("missing analysis", None, None, None),
    ("bad summary", None, None, None),
    ("bad analysis", None, None, None),
    ("not an object", None, None, None),
    ("not JSON", None, None, None),
    ("empty", None, None, None),
)


def _sql_values() -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({i}, {', '.join(map(cell, row))})" for i, row in enumerate(_WANT))


@query(f"SELECT event_id, w.error, w.verdict, w.summary, w.priority FROM events JOIN (VALUES {_sql_values()}) w(i, error, verdict, summary, priority) ON event_id % {len(_CASES)} = i")
def llm_response_validate(spark, d) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _CASES)), (F.col("event_id") % len(_CASES) + 1).cast("int"))
    t = C.table(spark, d, "events").select("event_id", raw.alias("raw"))
    return A.check_reply(t, "raw").select("event_id", "error", "verdict", "summary", "priority")


@query("""SELECT doc_id, 'A monitored set of documents named "' || source || '" has changed. Lines of the diff that begin with - were removed, those with + were added.' || chr(10) || 'Changed documents: ' || lang || ', B. All others are unchanged.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Patterns found in changed lines: money. These are hints, not findings.' || chr(10) ELSE '' END || 'Answer with one JSON object with the keys verdict, summary, analysis, priority; verdict is one of material_change, no_material_change, uncertain, priority one of critical, high, medium, low.' || chr(10) || chr(10) || coalesce(text, '') AS prompt FROM documents""")
def prompt_build(spark, d) -> DataFrame:
    tags = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("money"))).otherwise(F.array().cast("array<string>"))
    return C.table(spark, d, "documents").select("doc_id", A.prompt(F.col("source"), F.coalesce("text", F.lit("")), F.array("lang", F.lit("B")), tags).alias("prompt"))


@query()
def analyse_sets(spark, d) -> DataFrame:
    # read for labels and tags, and for sections: diffs are made once
    moved = D.diff_moved(C.changed(spark, d), C.CFG).select("set_name", "url", "label", "diff", "tags").persist()
    per = moved.groupBy("set_name").agg(F.array_sort(F.collect_list("label")).alias("labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    t = per.join(D.combine(moved, hold=lambda t: t), "set_name").select("set_name", A.prompt(F.col("set_name"), F.col("combined"), F.col("labels"), F.col("tags")).alias("prompt"))
    return A.analyse(t)


# --- views ------------------------------------------------------------------------


@query(f"WITH {C.SETS} SELECT id FROM sets WHERE file_id <> '' AND has_urls")
def ui_valid_sets(spark, d) -> DataFrame:
    urls = F.when(F.col("has_urls"), F.array(F.lit("u"))).otherwise(F.array().cast("array<string>"))
    return C.monitored_sets(spark, d).filter((F.col("file_id") != "") & (F.size(urls) > 0)).select("id")


def _with_health(spark, d) -> DataFrame:
    t = C.monitored_sets(spark, d)
    health = t.select("set_name", F.col("health").alias("_h")).filter("_h is not null")
    return t.drop("health").join(health, "set_name", "left").withColumn("health", F.coalesce("_h", "own_status", F.lit("ok"))).drop("_h")


_VIEW = f"{C.SETS}, v AS (SELECT * EXCLUDE (health), coalesce(health, own_status, 'ok') AS health FROM sets)"


@query(f"WITH {_VIEW} SELECT id, health FROM v")
def sets_with_health(spark, d) -> DataFrame:
    return _with_health(spark, d).select("id", "health")


@query(f"WITH {_VIEW} SELECT id FROM v WHERE contains(lower(set_name), '#00000000') AND lower(last_priority) = 'low'")
def sidebar_filter(spark, d) -> DataFrame:
    return C.monitored_sets(spark, d).filter(F.contains(F.lower("set_name"), F.lit("#00000000")) & (F.lower("last_priority") == "low")).select("id")


def _places(t: DataFrame, *order: F.Column) -> DataFrame:
    """``t`` with each row's place from 1 in an order without ties. Rows are sorted within ranges; one task sums up the ranges' counts, not rows."""
    # kept, since sampled bounds could differ if the ranges were worked out twice
    ranges = t.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranges.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranges.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + within + 1).drop("_part", "_before", "_at")


_SORT = "CASE health WHEN 'failing' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END, coalesce(last_amended, TIMESTAMP '1970-01-01') DESC, id"


@query(f"WITH {_VIEW} SELECT id, row_number() OVER (ORDER BY {_SORT}) AS place FROM v")
def sidebar_sort_health(spark, d) -> DataFrame:
    rank = F.when(F.col("health") == "failing", 0).when(F.col("health") == "degraded", 1).otherwise(2)
    return _places(_with_health(spark, d), rank, F.coalesce("last_amended", F.lit("1970-01-01").cast("timestamp")).desc(), F.col("id").asc()).select("id", "place")


@query(f"WITH {_VIEW} SELECT id, row_number() OVER (ORDER BY lower(set_name), set_name, id) AS place FROM v")
def sidebar_sort_name(spark, d) -> DataFrame:
    return _places(_with_health(spark, d), F.lower("set_name").asc(), F.col("set_name").asc(), F.col("id").asc()).select("id", "place")


@query(f"WITH {_VIEW} SELECT id, row_number() OVER (ORDER BY coalesce(last_amended, TIMESTAMP '1970-01-01') DESC, id) AS place FROM v")
def sidebar_sort_amended(spark, d) -> DataFrame:
    return _places(_with_health(spark, d), F.coalesce("last_amended", F.lit("1970-01-01").cast("timestamp")).desc(), F.col("id").asc()).select("id", "place")


@query(f"WITH {_VIEW} SELECT id, row_number() OVER (ORDER BY last_checked DESC, id) AS place FROM v")
def sidebar_sort_checked(spark, d) -> DataFrame:
    return _places(_with_health(spark, d), F.col("last_checked").desc(), F.col("id").asc()).select("id", "place")


_CUT = f"TIMESTAMP '{NOW_TS}' - INTERVAL 7 DAYS"


@query(f"WITH {_VIEW} SELECT id, strftime(last_amended, '%Y-%m-%d %H:%M:%S') AS last_amended FROM v WHERE last_amended > {_CUT}")
def recent_changes(spark, d) -> DataFrame:
    return _recent(spark, d).orderBy(F.desc("last_amended"), "id").select("id", iso("last_amended").alias("last_amended"))


def _recent(spark, d) -> DataFrame:
    return _with_health(spark, d).filter(F.col("last_amended") > now() - F.expr("INTERVAL 7 DAYS"))


@query(f"WITH {_VIEW} SELECT id, lower(last_priority) IN ('critical', 'high') AS attention FROM v WHERE last_amended > {_CUT}")
def needs_attention(spark, d) -> DataFrame:
    return _recent(spark, d).select("id", F.lower("last_priority").isin("critical", "high").alias("attention"))


@query(f"WITH {_VIEW} SELECT id, health FROM v WHERE health <> 'ok'")
def failing_sources(spark, d) -> DataFrame:
    return _with_health(spark, d).filter("health <> 'ok'").orderBy((F.col("health") == "failing").desc(), "id").select("id", "health")


@query(f"WITH {_VIEW} SELECT coalesce(category, 'Uncategorized') AS category, count(*) AS n, min(id) AS first_id FROM v GROUP BY 1")
def by_category(spark, d) -> DataFrame:
    return C.monitored_sets(spark, d).groupBy(F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {_VIEW} SELECT coalesce(category, 'Uncategorized') AS category, id, row_number() OVER (PARTITION BY coalesce(category, 'Uncategorized') ORDER BY lower(set_name), set_name, id) AS place FROM v")
def category_members(spark, d) -> DataFrame:
    """Every set with its place in its category: a category of any size is ordered in ranges, not in one task."""
    category = F.coalesce("category", F.lit("Uncategorized"))
    t = _places(_with_health(spark, d).withColumn("category", category), F.col("category").asc(), F.lower("set_name").asc(), F.col("set_name").asc(), F.col("id").asc())
    first = t.groupBy("category").agg((F.min("place") - 1).alias("_before"))
    return t.join(first, "category").select("category", "id", (F.col("place") - F.col("_before")).alias("place"))


@query(f"WITH {_VIEW} SELECT strftime(max(last_checked), '%Y-%m-%d %H:%M:%S') AS last_scan, count(*) FILTER (WHERE coalesce(last_amended, TIMESTAMP '1970-01-01') <= {_CUT} AND health = 'ok') AS stable FROM v")
def briefing_summary(spark, d) -> DataFrame:
    quiet = F.coalesce("last_amended", F.lit("1970-01-01").cast("timestamp")) <= now() - F.expr("INTERVAL 7 DAYS")
    return _with_health(spark, d).agg(iso(F.max("last_checked")).alias("last_scan"), F.count_if(quiet & (F.col("health") == "ok")).alias("stable"))


@query(f"WITH {_VIEW}, l AS (SELECT 1 AS part, id, '- ' || set_name || ' — ' || health AS line FROM v WHERE health <> 'ok' UNION ALL SELECT 2, id, '### ' || set_name || ' — ' || upper(last_priority) FROM v WHERE last_amended > {_CUT}) SELECT part, count(*) AS n, string_agg(line, chr(10) ORDER BY id) AS lines FROM l GROUP BY part")
def briefing_markdown(spark, d) -> DataFrame:
    failing = _with_health(spark, d).filter("health <> 'ok'").select(F.lit(1).alias("part"), "id", F.concat(F.lit("- "), "set_name", F.lit(" — "), "health").alias("line"))
    changes = _recent(spark, d).select(F.lit(2).alias("part"), "id", F.concat(F.lit("### "), "set_name", F.lit(" — "), F.upper("last_priority")).alias("line"))
    lines = failing.unionByName(changes)
    return ordered.joined(lines, ["part"], ["id"], "line", sep="\n", name="lines").join(lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part")


@query(f"WITH {C.CLASSIFIED} SELECT url, outcome AS status, outcome = 'changed' AS changed FROM cls")
def document_status_list(spark, d) -> DataFrame:
    docs = S.next_documents(C.classified(spark, d), C.NOW)
    # no filter: pushed below, it would work out outcomes again and again
    changed = docs.groupBy("set_name", "label").agg(F.bool_or(F.col("status") == "changed").alias("changed"))
    configured = C.captures(spark, d).select("set_name", "url")
    t = configured.join(docs.select("set_name", "url", "status", "label"), ["set_name", "url"], "left").join(changed, ["set_name", "label"], "left")
    return t.select("url", "status", F.coalesce("changed", F.lit(False)).alias("changed"))
