"""Line diffs and what their changed lines say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changewatch.config import Config
from changewatch.functions import udfs
from changewatch.operators import gates as G
from changewatch.operators import ordered

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
# a word boundary that means the same in every Java version and in RE2
_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
# fixed values: tags and their patterns, in the order in which tags are given
TAGS = {
    "money": rf"(?:[$€£][ \t\n]?[0-9][0-9,]*(?:\.[0-9]+)?|{_L}[0-9][0-9,]*(?:\.[0-9]+)?[ \t\n]?(?:AUD|USD|EUR|GBP){_R})",
    "date": rf"(?i){_L}(?:[0-9]{{1,2}}[ \t\n]+(?:{_MONTHS})|(?:{_MONTHS})[ \t\n]+[0-9]{{1,2}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}){_R}",
    "percentage": rf"{_L}[0-9]+(?:\.[0-9]+)?[ \t\n]?%",
    "duration": rf"(?i){_L}[0-9]+[ \t\n]+(?:days?|months?|years?|business days?){_R}",
    "section_reference": rf"(?i){_L}(?:section|clause|article|schedule|appendix|paragraph)[ \t\n]+[0-9]+(?:\.[0-9]+)*{_R}",
    "obligation": rf"(?i){_L}(?:must not|shall not|will not|may not|must|shall|may|will be required to){_R}",
}


def changed_lines(diff: Column) -> Column:
    """The lines that a diff adds or removes, without their marks."""
    lines = F.filter(F.split(diff, "\n"), lambda x: x.rlike("^[+-]") & ~x.rlike(r"^(\+\+\+|---|@@)"))
    return F.transform(lines, lambda x: F.substr(x, F.lit(2)))


def line_counts(diff: Column) -> tuple[Column, Column]:
    """(added, removed) lines of a diff's hunks, file headers left out."""
    count = lambda mark, head: F.size(F.filter(F.split(diff, "\n"), lambda x: x.startswith(mark) & ~x.startswith(head))).cast("long")
    return count("+", "+++"), count("-", "---")


def pattern_tags(changed: Column) -> Column:
    return F.array_compact(F.array(*(F.when(changed.rlike(p), F.lit(name)) for name, p in TAGS.items())))


def watch_tags(changed: Column, watchlist: list[str]) -> Column:
    low = F.lower(changed)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(term.lower())), F.lit(f"watchlist:{term}")) for term in sorted(set(watchlist)))))


def fingerprint(changed: Column, watchlist: list[str]) -> Column:
    """Tags of the changed lines, joined by line feeds: patterns in their order, then watched terms in theirs."""
    return F.when(F.btrim(changed, F.lit(" \n\t")) == "", F.array().cast("array<string>")).otherwise(F.concat(pattern_tags(changed), watch_tags(changed, watchlist)))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(udfs.CUT_NOTE))).otherwise(text)


def diff_moved(moved: DataFrame, cfg: Config = Config(), *, old: str = "prior_stored", new: str = "text_now", label: str = "label") -> DataFrame:
    """Rows whose text has moved, with a struct ``diff`` and array ``tags``. Filter before this: it runs Python for every row it gets.

    Rows are dealt out anew, since a diff takes far longer than what came before and texts differ in length.
    """
    make = udfs.unified_diff(cfg.diff.context_lines, cfg.diff.max_diff_chars)
    t = moved.repartition(F.col("set_name"), F.col("url")).withColumn("diff", make(F.col(old), F.col(new), F.col(label)))
    # a column of its own, so that it is worked out once for all patterns
    t = t.withColumn("_changed", F.array_join(changed_lines(F.col("diff.text")), "\n"))
    return t.withColumn("tags", fingerprint(F.col("_changed"), cfg.fingerprint.watchlist)).drop("_changed")


def line_differences(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys, line, change, n): lines that one side has more often than the other, as multisets; moves do not show.

    Both sides of a pair lie in one row and are counted together where that
    row is: pairs that have a set_name and a url are dealt out by these, and
    lines are not moved.
    """
    lines = lambda c, sign: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), F.lit(sign).alias("s")))
    within = [c for c in G.KEYS if c in pairs.columns and c not in keys]
    if set(G.KEYS) <= {*within, *keys}:
        pairs = pairs.select(*within, *keys, old, new).repartition(*G.KEYS)
    both = pairs.select(*within, *keys, F.explode(F.concat(lines(new, 1), lines(old, -1))).alias("_l"))
    net = both.groupBy(*within, *keys, "_l.line").agg(F.sum("_l.s").alias("net")).filter("net <> 0")
    return net.select(*keys, "line", F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"), F.abs("net").alias("n"))


def _shown(diffs: DataFrame, by: str) -> DataFrame:
    """(by, url, section) of diffs that have changes: a heading and the diff."""
    section = F.concat(F.lit("===== "), F.col("label"), F.lit(" — +"), F.col("diff.added"), F.lit(" / -"), F.col("diff.removed"), F.lit(" =====\n"), F.col("diff.text"))
    return diffs.filter((F.col("diff.added") > 0) | (F.col("diff.removed") > 0)).select(by, "url", section.alias("section"))


Hold = Callable[[DataFrame], DataFrame]


def combine(diffs: DataFrame, by: str = "set_name", limit: int | None = None, hold: Hold = DataFrame.persist) -> DataFrame:
    """(by, combined): a section for each document with changes, in order of its address, as one text, which must fit in a row.

    ``limit``: so many bytes at most, as a model's prompt has room for; a note
    says where it was cut. Finding the ranges of an order reads the diffs once
    more, so ``hold`` keeps their sections.
    """
    return ordered.joined(hold(_shown(diffs, by)), [by], ["url"], "section", sep="\n\n", name="combined", limit=limit, note=udfs.CUT_NOTE)


def combine_parts(diffs: DataFrame, by: str = "set_name", hold: Hold = DataFrame.persist) -> DataFrame:
    """(by, part, text): the combined diff of a set of any size, a numbered part for each document with changes; the parts join to the whole."""
    return ordered.parts(hold(_shown(diffs, by)), [by], ["url"], "section", sep="\n\n", hold=hold).select(by, "part", F.col("section").alias("text"))


def parse(diffs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, file_no, label, hunk_no, header, line_no, type, text): the lines of a combined diff's hunks.

    A line of five equals signs begins a file, one of two at-signs a hunk;
    headers of versions are left out, as is what comes before a file's first
    hunk. Windows run over one diff's lines; ``keys`` must tell diffs apart.
    """
    t = diffs.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_x"))
    x = F.col("_x")
    upto = W.partitionBy(*keys).orderBy("_i")
    t = t.withColumn("_file", F.count_if(x.startswith("=====")).over(upto)).withColumn("_first", F.max(F.when((F.col("_i") == 0) & x.startswith("====="), 1).otherwise(0)).over(upto))
    in_file = W.partitionBy(*keys, "_file").orderBy("_i")
    t = t.withColumn("_hunk", F.count_if(x.startswith("@@")).over(in_file)).withColumn("label", F.coalesce(F.first(F.when(x.startswith("====="), F.btrim(F.replace(x, F.lit("="), F.lit("")))), ignorenulls=True).over(in_file), F.lit("")))
    t = t.withColumn("header", F.last(F.when(x.startswith("@@"), x), ignorenulls=True).over(in_file))
    shown = t.filter((F.col("_hunk") > 0) & ~x.startswith("=====") & ~x.startswith("@@") & ~x.startswith("--- ") & ~x.startswith("+++ "))
    kind = F.when(x.startswith("+"), "add").when(x.startswith("-"), "remove").when(x.startswith("\\"), "meta").otherwise("context")
    body = F.when(kind.isin("add", "remove"), F.substr(x, F.lit(2))).when(kind == "context", F.regexp_replace(x, "^ ", "")).otherwise(x)
    line = F.row_number().over(W.partitionBy(*keys, "_file", "_hunk").orderBy("_i")) - 1
    return shown.select(*keys, (F.col("_file") - F.col("_first")).cast("int").alias("file_no"), "label", (F.col("_hunk") - 1).cast("int").alias("hunk_no"), "header", line.cast("int").alias("line_no"), kind.alias("type"), body.alias("text"))
