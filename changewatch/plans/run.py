"""A whole monitoring run: captures in, next state, reviews, archive, history, run log, health and alerts out.

State is a log of versions below ``root`` (``sources.state_log``): a run adds the
rows that it changed, in a folder of its own, and publishes it last, so a run
that dies leaves the state before it. A text is written when it has changed and
at no other time. What several tables are made from - the outcomes, the diffs,
and above all the replies of the model - is written once and read back. A set in
which anything fails keeps its state; the errors are in ``quarantine``. A dry
run returns the same frames, asks no model and publishes nothing: its folder is
one that no reader opens, and is deleted like those of runs that died.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch import schemas
from changewatch.config import Config
from changewatch.functions import text as X
from changewatch.functions import udfs
from changewatch.operators import analysis as A
from changewatch.operators import diffs as D
from changewatch.operators import faults as E
from changewatch.operators import gates as G
from changewatch.operators import reports as R
from changewatch.operators import state as S
from changewatch.operators import versions as V
from changewatch.sources import files, state_log

DOCUMENT = ("set_name", "url", "doc_id", "label", "status", "hash", "length", "pipeline_version", "etag", "last_modified", "extractor", "http_status", "fetch_ms", "consecutive_failures", "last_success", "last_error", "last_changed", "suspect_length", "rebaseline_reason", "last_checked")
DOCUMENTS = T.StructType([schemas.DOCUMENT[c] for c in DOCUMENT])
#: The tables of the state, and what their keys are.
TABLES = {"documents": (DOCUMENTS, G.KEYS), "baselines": (schemas.STORED_TEXT, G.KEYS), "sets": (schemas.SET_STATE, ["set_name"]), "artefacts": (schemas.ARTEFACT, ["set_name", "kind"]), "archive": (schemas.ARCHIVED, ["file_name"]), "history": (schemas.HISTORY, ["file_id", "stamp"])}
#: Bytes of a combined diff that a prompt has room for.
PROMPT_BYTES = 4_000_000


@dataclass(frozen=True)
class Run:
    """Frames of a run; ``path`` is where they were committed, None after a dry run.

    documents, reviews, log, health, alerts and quarantine are the run's own;
    baselines, sets, artefacts, archive and history are the whole state after it.
    """

    documents: DataFrame
    baselines: DataFrame
    sets: DataFrame
    reviews: DataFrame
    log: DataFrame
    health: DataFrame
    alerts: DataFrame
    quarantine: DataFrame
    artefacts: DataFrame
    archive: DataFrame
    history: DataFrame
    path: str | None


def _noise(cfg: Config) -> Column:
    """The patterns of an address's host, those for all hosts first."""
    everywhere, by_host = cfg.normalisation.noise_patterns, cfg.normalisation.per_source_noise
    noise = F.lit(None).cast("array<string>") if not everywhere else F.array(*map(F.lit, everywhere))
    for host, patterns in by_host.items():
        noise = F.when(X.host(F.col("url")) == host, F.array(*map(F.lit, [*everywhere, *patterns]))).otherwise(noise)
    return noise


def usable(sets: DataFrame) -> DataFrame:
    """(set_name, category) of named sets, of a name the first; definitions with addresses are checked as ``state.valid_sets`` does."""
    if "setName" in sets.columns:
        return S.valid_sets(sets).select(F.col("setName").alias("set_name"), "category")
    return sets.select("set_name", "category").filter("coalesce(set_name, '') <> ''").groupBy("set_name").agg(F.first("category").alias("category"))


def run(spark: SparkSession, sets: DataFrame, captures: DataFrame, root: str, now: str, *, run_id: str, cfg: Config = Config(), analyser: A.Analyser = A.stub, dry_run: bool = False, only: Sequence[str] | None = None, legacy: DataFrame | None = None, base_every: int = 30) -> Run:
    """One run.

    ``sets``: set_name, category, or definitions with setName and urls.
    ``captures``: set_name, url, label, status, text, etag, error, and if the
    source says so last_modified, extractor, http_status, fetch_ms. ``now``: an
    ISO time, the run's only clock. ``only``: the sets to look at, all others
    keep their state. ``legacy``: (set_name, aggregate), texts of sets from
    before the state had a record for each document; they seed what is not known.
    ``base_every``: after so many runs the state is written whole, and what
    readers of the last two versions do not need is deleted.
    """
    number = files.number(spark, root)
    log_of = lambda name: state_log.read(spark, root, name, TABLES[name][0], number)

    folder = f"dry-{uuid.uuid4().hex}" if dry_run else run_id
    keep = lambda name, frame: files.keep(spark, frame, root, folder, name)
    add = lambda name, rows: state_log.append(spark, rows.select(*TABLES[name][0].names), root, folder, name)

    sets = usable(sets)
    if only is not None:
        sets = sets.filter(F.col("set_name").isin(*only))
    captures = captures.join(sets.select("set_name"), "set_name", "left_semi")
    noise = _noise(cfg)
    # of texts only whether there is one is read here
    documents, before = V.latest(log_of("documents"), G.KEYS), V.latest(log_of("sets"), ["set_name"])
    baselines = log_of("baselines")
    has_text = V.latest(baselines.select(*G.KEYS, "length", "deleted", "version"), G.KEYS).select(*G.KEYS, (F.col("length") > 0).alias("has_text"))
    seed = None
    if legacy is not None:
        seed = S.split_aggregate(legacy, ["set_name"], "aggregate").join(captures.select(*G.KEYS), G.KEYS, "left_semi").join(documents.select(*G.KEYS), G.KEYS, "left_anti")
        # as captures are read: a pattern of the source's noise is removed here too
        read = udfs.normalise_or_error("text", noise)
        seed = keep("legacy", seed.select(*G.KEYS, read["value"].alias("stored")).filter("stored <> ''"))
        records = seed.select(*G.KEYS, X.content_hash(F.col("stored")).alias("hash"), F.length("stored").cast("long").alias("length"), F.lit(1).alias("pipeline_version"), F.lit("legacy").alias("extractor"))
        documents, has_text = documents.unionByName(records, allowMissingColumns=True), has_text.unionByName(seed.select(*G.KEYS, F.lit(True).alias("has_text")))
    prior = documents.join(has_text, G.KEYS, "left").select(*G.KEYS, "hash", "length", "pipeline_version", "has_text", "consecutive_failures", "last_success", "last_changed", "etag", "last_modified", "extractor")

    def stored(keys: DataFrame) -> DataFrame:
        """(set_name, url, stored): the texts of the documents that are asked for."""
        texts = V.latest(baselines.join(keys.select(*G.KEYS), G.KEYS, "left_semi"), G.KEYS).select(*G.KEYS, F.col("text").alias("stored"))
        return texts if seed is None else texts.unionByName(seed.join(keys.select(*G.KEYS), G.KEYS, "left_semi"))

    read = udfs.normalise_or_error("text", noise)
    gated = G.classify(captures, prior, cfg, read["value"], hold=lambda df: keep("gate", df), stored=stored, fault=read["error"])
    t = keep("outcomes", gated)
    rows = t.filter(F.col("outcome") == G.CHANGED)
    moved = keep("diffs", D.diff_moved(rows.join(G.texts_of(rows, captures, stored(rows), read["value"]), G.KEYS), cfg).drop("text_now", "prior_stored"))
    quarantine = keep("quarantine", E.quarantine(t.select(*G.KEYS, F.lit("reading").alias("step"), F.col("fault").alias("error")), moved.select(*G.KEYS, F.lit("diff").alias("step"), F.col("diff.error").alias("error"))))
    t, moved = E.sound(t, quarantine), E.sound(moved, quarantine)

    per = moved.groupBy("set_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("url", "label"))), lambda x: x["label"]).alias("labels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
        F.sum("diff.lines_added").alias("added"), F.sum("diff.lines_removed").alias("removed"),
    )
    asked = per.join(D.combine(moved, limit=PROMPT_BYTES, hold=_kept), "set_name", "left").withColumn("combined", F.coalesce("combined", F.lit("")))
    asked = asked.withColumn("prompt", A.prompt(F.col("set_name"), F.col("combined"), F.col("labels"), F.col("tags"))).drop("combined")
    if dry_run:
        nothing = F.lit(0).cast("long")
        answered = asked.withColumns({"reply": F.lit(None).cast("string"), "attempts": nothing, "failure": F.lit(""), "prompt_tokens": nothing, "output_tokens": nothing})
    else:
        # asked once: all that depends on a reply reads what is written here
        replies = keep("replies", A.analyse(asked, analyser).withColumnRenamed("error", "failure"))
        answered = asked.join(replies, "set_name")
    reviews = keep("reviews", A.check_reply(answered, "reply").withColumn("error", F.coalesce(F.nullif("failure", F.lit("")), "error")).drop("prompt", "reply", "failure"))

    failed = reviews.filter("verdict is null").select("set_name")
    docs = add("documents", S.revert(S.next_documents(t, now), prior, failed).select(*DOCUMENT))
    # a text is written with the hash that it moved; those of documents that wait for another try stay as they were, like their hashes
    pending = docs.filter("status = 'analysis_pending'").select(*G.KEYS)
    written = t.filter(F.col("outcome").isin(*S.REWRITTEN) & (~F.col("hash_now").eqNullSafe(F.col("prior_hash")) | (F.col("outcome") == G.REBASELINED))).select(*G.KEYS).join(pending, G.KEYS, "left_anti")
    fresh = G.reading(captures.join(written, G.KEYS, "left_semi"), read["value"]).select(*G.KEYS, F.col("text_now").alias("text"), F.length("text_now").cast("long").alias("length"))
    if seed is not None:  # a seed that was not replaced is a text like any other
        kept_seed = seed.join(written, G.KEYS, "left_anti").select(*G.KEYS, F.col("stored").alias("text"), F.length("stored").cast("long").alias("length"))
        fresh = fresh.unionByName(E.sound(kept_seed, quarantine))
    fresh = add("baselines", fresh)

    rollup = S.set_rollup(t)
    now_sets = (
        S.decide(rollup, before).select("set_name", "decision")
        .join(S.counters(rollup, before, now), "set_name")
        .join(S.rollup_hash(docs).withColumnRenamed("hash", "hash_now"), "set_name")
        .join(before.select("set_name", "last_amended", "last_priority", "last_verdict", "schema_failures", F.col("hash").alias("hash_before"), F.col("last_checked").alias("checked_before")), "set_name", "left")
        .join(reviews.select("set_name", "verdict", "priority", F.col("summary").alias("review_summary"), "error"), "set_name", "left")
        .join(sets, "set_name", "left")
    )
    first = F.col("decision") == "first_scan"
    badged = S.badge(now_sets, now)
    decided = keep("decisions", badged.select(
        "set_name", "category", X.slug(F.col("set_name")).alias("file_id"), F.when(F.col("error").isNotNull(), F.coalesce("hash_before", "hash_now")).otherwise(F.col("hash_now")).alias("hash"), F.lit(now).alias("last_checked"),
        F.when(first, F.lit(now)).otherwise(F.col("last_amended")).alias("last_amended"), F.when(first, "low").otherwise(F.col("last_priority")).alias("last_priority"),
        F.when(first, "no_material_change").otherwise(F.col("last_verdict")).alias("last_verdict"), F.coalesce("review_verdict", F.when(F.col("decision") == "rebaselined", "rebaselined")).alias("review_verdict"), "review_summary",
        F.when(F.col("error").isNotNull(), F.coalesce("schema_failures", F.lit(0)) + 1).when(F.col("verdict").isNotNull(), F.lit(0)).otherwise(F.coalesce("schema_failures", F.lit(0))).cast("long").alias("schema_failures"),
        "consecutive_failures", "last_success", "decision", "verdict", "checked_before",
    ))
    out_sets = add("sets", decided)
    kept = before.join(out_sets.select("set_name"), "set_name", "left_anti").unionByName(out_sets)

    spent = [F.col("attempts").alias("llm_attempts"), "prompt_tokens", "output_tokens"]
    none = [F.lit(0).cast("long").alias(c) for c in ("llm_attempts", "prompt_tokens", "output_tokens")]
    stamps = [F.lit(run_id).alias("run_id"), F.lit(now).alias("timestamp")]
    log = t.select(
        *stamps, "set_name", "url", "label", "outcome", F.col("length_now").alias("length"), F.lit(False).alias("llm_called"), *none, F.lit(None).cast("string").alias("verdict"), F.concat_ws(": ", "error", "reason", "detail").alias("error")
    ).unionByName(reviews.select(
        *stamps, "set_name", F.lit("").alias("url"), F.lit("(set)").alias("label"), F.when(F.col("verdict").isNull(), "schema_failed").otherwise("analysed").alias("outcome"), F.lit(None).cast("long").alias("length"), F.lit(not dry_run).alias("llm_called"), *spent, "verdict", F.coalesce("error", F.lit("")).alias("error")
    )).unionByName(E.failed_sets(quarantine).select(
        *stamps, "set_name", F.lit("").alias("url"), F.lit("(set)").alias("label"), F.lit(E.SET_FAILED).alias("outcome"), F.lit(None).cast("long").alias("length"), F.lit(False).alias("llm_called"), *none, F.lit(None).cast("string").alias("verdict"), F.concat_ws(": ", "step", "error").alias("error")
    ))
    health = R.set_health(E.sound(sets.select("set_name"), quarantine), docs, cfg)
    alerts = R.alerts(kept, docs, R.error_rate(log.filter(F.col("outcome") != E.SET_FAILED)), cfg).unionByName(E.alerts(quarantine))

    made, archived = _artefacts(decided, reviews, moved, baselines, fresh, V.latest_groups(log_of("artefacts"), ["set_name", "kind"]), now, keep)
    # jobs that do not wait for each other run side by side
    with ThreadPoolExecutor(5) as pool:
        jobs = {name: pool.submit(keep, name, frame) for name, frame in (("log", log), ("health", health), ("alerts", alerts))}
        jobs |= {name: pool.submit(add, name, frame) for name, frame in (("artefacts", made), ("archive", archived))}
        done = {name: job.result() for name, job in jobs.items()}
    made, archived, own = done.pop("artefacts"), done.pop("archive"), done
    records = add("history", R.history_records(archived.filter("part = 0")))
    path = None
    if not dry_run:
        path = files.publish(spark, root, run_id, base=number)
        if len(state_log.opened(spark, root, None)) > base_every:
            within = lambda t: t.join(R.expired(t.select("file_name").distinct(), now, cfg.retention.log_days), "file_name", "left_anti")
            state_log.compact(spark, root, TABLES, run_id, {"archive": within})
        # the log outlives the folders of its runs
        files.write_run_log(own["log"], f"{root}/log")
        files.prune_run_log(spark, f"{root}/log", now, cfg.retention.run_log_days)
        state_log.expire(spark, root)
        number = files.number(spark, root)

    def state(name: str, rows: DataFrame, groups: bool = False) -> DataFrame:
        """A table after the run."""
        now_ = (V.latest_groups if groups else V.latest)(log_of(name), TABLES[name][1])
        return _after(now_, rows, TABLES[name][1]) if dry_run else now_

    archive = state("archive", archived, True)
    archive = archive.join(R.expired(archive.select("file_name").distinct(), now, cfg.retention.log_days), "file_name", "left_anti")
    # of the records those whose analysis is still there, of sets that are known
    history = state("history", records)
    history = history.join(archive.select(F.concat(F.lit("logs/"), "file_name").alias("analysis_path")).distinct(), "analysis_path", "left_semi").join(kept.select("file_id"), "file_id", "left_semi").select(*schemas.HISTORY.names)
    return Run(documents=docs, baselines=state("baselines", fresh).select(*schemas.BASELINE.names), sets=state("sets", out_sets), reviews=reviews, quarantine=quarantine, artefacts=state("artefacts", made, True), archive=archive, history=history, path=path, **own)


def _kept(rows: DataFrame) -> DataFrame:
    """Rows of a table that is written already need no keeping."""
    return rows


def _after(before: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table with the rows that a run changed, before they are written."""
    return before.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows.select(*before.columns))


def _artefacts(decided: DataFrame, reviews: DataFrame, moved: DataFrame, baselines: DataFrame, fresh: DataFrame, current: DataFrame, now: str, keep) -> tuple[DataFrame, DataFrame]:
    """(artefacts, archive): what takes the place of a set's analysis, snapshot and diff, and what goes to the archive.

    A first scan has an analysis that says so. A review that finds a change
    takes the place of the analysis before it, which is archived with its
    snapshot and diff under the time of the check before. One that declines is
    archived itself, with the new texts, and leaves the analysis in place.
    Texts of a set that were written make a new snapshot in each case.
    """
    found = F.col("verdict").isNotNull()
    badged, declined = F.col("verdict").isin(*S.BADGED), F.col("verdict") == "no_material_change"
    first = F.col("decision") == "first_scan"
    act = decided.select("set_name", "file_id", "checked_before", "decision", "verdict")
    said = reviews.filter("verdict is not null").select(
        "set_name",
        F.to_json(F.struct("verdict", "summary", F.col("reply_analysis").alias("analysis"), "priority", F.lit(now).alias("date_time"), F.col("labels").alias("changed_documents"), F.struct("added", "removed").alias("diff_stats"), F.col("tags").alias("fingerprint"))).alias("text"),
    )
    begun = F.to_json(F.struct(F.lit("no_material_change").alias("verdict"), F.lit("First capture of this set.").alias("summary"), F.concat(F.lit("The set "), "set_name", F.lit(" is monitored from now on; later runs compare with these texts.")).alias("analysis"), F.lit("low").alias("priority"), F.lit(now).alias("date_time"), F.array().cast("array<string>").alias("changed_documents")))
    whole = lambda t, kind: t.select("set_name", "file_id", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(now).alias("at"), "text")
    reviewed = whole(act.filter(found).join(said, "set_name"), "analysis")
    new_text = act.filter(found | first | (F.col("decision") == "rebaselined"))
    sections = S.aggregate_parts(_texts(baselines, fresh, new_text), "set_name", "url", "url", "text", hold=lambda df: keep("sections", df))
    snapshots = sections.join(new_text.select("set_name", "file_id"), "set_name").select("set_name", "file_id", F.lit("snapshot").alias("kind"), "part", F.lit(now).alias("at"), "text")
    # diffs are written already; what is numbered is written once
    changes = D.combine_parts(moved.join(act.filter(found), "set_name", "left_semi"), hold=lambda df: keep("changes", df) if "_range" in df.columns else df)
    diffs = changes.join(act.select("set_name", "file_id"), "set_name").select("set_name", "file_id", F.lit("diff").alias("kind"), "part", F.lit(now).alias("at"), "text")
    texts = snapshots.unionByName(diffs)
    made = whole(act.filter(first).withColumn("text", begun), "analysis").unionByName(reviewed.join(act.filter(badged), "set_name", "left_semi")).unionByName(texts)
    replaced = current.join(act.filter(badged).select("set_name", F.coalesce("checked_before", F.lit(now)).alias("_stamp")), "set_name").withColumn("at", F.col("_stamp")).drop("_stamp")
    declines = reviewed.unionByName(texts).join(act.filter(declined), "set_name", "left_semi")
    return made, S.archive(replaced.unionByName(declines.select(*replaced.columns)))


def _texts(baselines: DataFrame, fresh: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_name, url, text) of the sets, after the run."""
    names = sets.select("set_name")
    new = fresh.join(names, "set_name", "left_semi").select(*G.KEYS, "text")
    old = V.latest(baselines.join(names, "set_name", "left_semi"), G.KEYS).select(*G.KEYS, "text")
    return old.join(new.select(*G.KEYS), G.KEYS, "left_anti").unionByName(new)
