"""URL filters by a path-template tree, with DataFrame operations alone.

Rules (host and path prefixes) judge the addresses that they fit. The others
are judged by their host's path templates:

1. Segments with digits or long hexadecimal runs become wildcards of their
   shape. Then, level by level from the root to the deepest segment, a node's
   children turn into one wildcard, ``*``, if there are many of them for the
   distinct shapes below each. Those that hold a wildcard of digits turn into
   it where they stand for many distinct addresses, unless their blocked
   shares differ by more than chance.
2. Templates of a host that differ in their last fixed segment are branches.
   Labelled ones whose share of blocked addresses does not differ from that of
   all by more than chance are merged.
3. A template's purity is its blocked share among the addresses that rules
   judge, smoothed by what it inherits: the share of the same template on
   other hosts of its domain, behind that on all hosts, behind that of the
   corpus; and the share of its parent node, behind its host's. So a template
   without any label has a verdict by evidence. It is rejected if its purity
   reaches ``reject_at``.

Counting is by distinct address, then by (host, shape of path), before
anything else is shuffled, so a hot host comes to as many rows as it has shapes.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.llm.common import Table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Params:
    """A node's children are a wildcard if they are ``many`` or more, and at least ``varied`` of them for each distinct shape that a child has below it on average."""

    many: int = 20
    varied: float = 0.3
    #: Standard errors within which branches are alike.
    alike: float = 2.0
    #: Addresses that a share counts for in the one it is inherited by.
    smoothing: float = 5.0
    #: Addresses that a parent node's share counts for in a template's.
    of_parent: float = 1.0
    reject_at: float = 0.6


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, with A to Z in lower case; '' without :// and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; '' without :// and for null."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest of the rules (verdict, host/path) that fits, else nulls. Of equally long ones the longer host, then block."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"), r[0] == BLOCK)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """The path's segments (array) with runs of digits, and of 8 or more hexadecimal digits, as wildcards; empty segments are left out."""
    seg = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(seg, lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F]{8,}", "{h}"), r"[0-9]+", "{n}"))


def templates(shapes: DataFrame, params: Params, tables: list[Table]) -> DataFrame:
    """``shapes`` (host, shape, paths, labelled, blocked) with the template of each: the tree's nodes, from the root down.

    ``paths`` is the number of distinct addresses of a shape; how often each
    occurs plays no part. A node with fewer than ``many`` addresses has no
    wildcard below it, so its shapes get the rest of their segments at once,
    and one long path costs no levels. What it writes is added to ``tables``.
    """
    rest = F.array_join(F.slice("shape", F.col("_d") + 1, F.size("shape")), "/")
    t, done, d = shapes.withColumn("template", F.lit("")), [], 0
    while True:
        seg = F.get(F.col("shape"), F.lit(d))
        children = t.filter(F.size("shape") > d).groupBy("host", "template", seg.alias("seg")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("paths", "labelled", "blocked"))).withColumn("free", F.contains("seg", F.lit("{")))
        of_free = lambda c: F.sum(F.when(F.col("free"), F.col(c)).otherwise(0))
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum("paths").alias("below"), of_free("paths").alias("fp"), of_free("labelled").alias("fl"), of_free("blocked").alias("fb")).filter(F.col("below") >= params.many)
        # k children have total / k shapes each
        wild = (F.col("k") >= params.many) & (F.col("k") * F.col("k") >= params.varied * F.col("total"))
        share = F.try_divide("fb", "fl")
        alike = F.when(F.col("labelled") > 0, F.abs(F.try_divide("blocked", "labelled") - share) <= params.alike * F.sqrt(share * (1 - share) / F.col("labelled"))).otherwise(F.col("fl") == 0)
        loose = F.col("free") & (F.col("fp") >= params.many) & alike
        named = children.join(nodes, ["host", "template"]).select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("seg").alias("_s"), F.when(wild | loose, "*").otherwise(F.col("seg")).alias("step"))
        t = t.join(named, (t["host"] == named["_h"]) & (t["template"] == named["_t"]) & (seg == named["_s"]), "left")
        goes_on = F.col("step").isNotNull()
        left = F.when(F.size("shape") > d, F.concat("template", F.lit("/"), rest)).otherwise(F.col("template"))
        t = t.withColumn("_d", F.lit(d)).withColumn("goes_on", goes_on).withColumn("template", F.when(goes_on, F.concat("template", F.lit("/"), "step")).otherwise(left))
        level = Table(t.drop("_h", "_t", "_s", "step", "_d"), "tree")
        tables.append(level)
        t = level.df
        done.append(t.filter("not goes_on").drop("goes_on"))
        t, d = t.filter("goes_on").drop("goes_on"), d + 1
        if t.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)


def rejected(tree: DataFrame, params: Params, tables: list[Table]) -> DataFrame:
    """(host, template, template_verdict, purity) for every template of the tree, each of one row at least. What it writes is added to ``tables``."""
    s = params.smoothing
    t = tree.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("labelled", "blocked")))
    # the same template elsewhere: wildcards of any shape alike; the domain is the host's last two names
    t = t.withColumn("common", F.regexp_replace("template", r"[^/]*\{[^/]*", "*")).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("parent", F.regexp_replace("template", r"/[^/]*$", ""))
    tables.append(Table(t, "templates"))
    t = tables[-1].df

    def with_share(t: DataFrame, keys: list[str], behind, name: str) -> DataFrame:
        """Adds ``name``, the blocked share of all that has the same ``keys``, with ``s`` addresses of the share behind it."""
        per = t.groupBy(*keys).agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"))
        return t.join(per, keys).withColumn(name, (F.col("_b") + s * behind) / (F.col("_l") + s)).drop("_l", "_b")

    whole = t.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.0)).alias("corpus"))  # one row
    t = t.crossJoin(F.broadcast(whole))
    t = with_share(t, ["common"], F.col("corpus"), "everywhere")
    t = with_share(t, ["domain", "common"], F.col("everywhere"), "nearby")
    t = with_share(t, ["host"], F.col("corpus"), "of_host")
    t = with_share(t, ["host", "parent"], F.col("of_host"), "of_parent")
    prior = (s * F.col("nearby") + params.of_parent * F.col("of_parent")) / (s + params.of_parent)
    # branches: labelled templates alike but for the last segment that is no wildcard
    t = t.withColumn("prior", prior).withColumn("branch", F.regexp_replace("template", r"/[^/{}*]+((?:/[^/]*[{}*][^/]*)*)$", "/*$1"))
    family = t.filter("labelled > 0").groupBy("host", "branch").agg(F.sum("labelled").alias("fl"), F.sum("blocked").alias("fb"), F.count(F.lit(1)).alias("fn"))
    t = t.join(family, ["host", "branch"], "left")
    share = (F.col("fb") + s * F.col("corpus")) / (F.col("fl") + s)
    error = F.sqrt(share * (1 - share) / F.greatest(F.lit(1), F.col("labelled")))
    alike = (F.col("labelled") > 0) & (F.abs(F.try_divide("blocked", "labelled") - share) <= params.alike * error)
    t = t.withColumn("merged", F.when((F.col("fn") > 1) & alike, F.col("branch")).otherwise(F.col("template")))
    tables.append(Table(t.select("host", "template", "merged", "labelled", "blocked", "prior"), "branches"))
    t = tables[-1].df
    weight = F.greatest(F.col("labelled"), F.lit(1))
    pooled = t.groupBy("host", "merged").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), (F.sum(weight * F.col("prior")) / F.sum(weight)).alias("p"))
    weight_of_prior = s + params.of_parent
    # rounded, so that the order of sums cannot tip a verdict
    pooled = pooled.select("host", "merged", F.round((F.col("b") + weight_of_prior * F.col("p")) / (F.col("l") + weight_of_prior), 9).alias("purity"))
    return t.select("host", "template", "merged").join(pooled, ["host", "merged"]).select("host", "template", "purity", F.when(F.col("purity") >= params.reject_at, BLOCK).otherwise(ALLOW).alias("template_verdict"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], params: Params = Params(), *, url: str = "url", key: str = "page_id", learn_from: Column | None = None) -> DataFrame:
    """A row for each row of ``pages``: key, host, path, rule, verdict, template, purity, template_verdict.

    The verdict is the rule's, else that of the path's template. Where
    ``learn_from`` (of host and path) is not true, rules judge but are no
    evidence for templates. Addresses that are null or have no :// have an
    empty host and path, no rule, and share one template. Repeated rows each
    count and are each judged. Without any evidence the purity is 0 and all is
    allowed. An empty table gives an empty result. Other columns are not read.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    t = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    t = t.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("shape", shape_of(F.col("path")))
    known = F.col("_verdict") if learn_from is None else F.when(learn_from, F.col("_verdict"))
    # by distinct address first: repeats of one, and a hot host's, are counted where they are read
    addresses = t.groupBy("host", "path", "shape").agg(F.count(known).alias("labelled"), F.count(F.when(known == BLOCK, 1)).alias("blocked"))
    shapes = addresses.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("paths"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    tables: list[Table] = []
    tree = templates(shapes, params, tables)
    # what is left of it all is a row for each shape of a host
    verdicts = Table(tree.select("host", "shape", "template").join(rejected(tree, params, tables), ["host", "template"]), "verdicts").df
    for table in tables:
        table.drop()
    out = t.join(verdicts, ["host", "shape"])
    return out.select(F.col("page_id").alias(key), "host", "path", "rule", F.coalesce("_verdict", "template_verdict").alias("verdict"), "template", "purity", "template_verdict")
