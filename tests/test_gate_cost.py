"""What the gate does for every text: folded once and only where a signature may be held, normalised by plain searches, not moved."""

import re

from pyspark.sql import functions as F

from changewatch.config import FAILURE_SIGNATURES
from changewatch.functions import text as X
from changewatch.operators import diffs, gates
from changewatch.plans import scenario as C

from conftest import SF


def test_a_text_is_folded_once_for_all_signatures(spark):
    assert str(gates.signature(F.col("t"), FAILURE_SIGNATURES)).count("lower(t)") <= 2


def test_signatures_in_odd_letters_are_found(spark):
    texts = ["x", None, "", "THIſ SITE CAN’T BE REACHED", "Veriﬁed; juﬆ a moment...", "ACCESS DENIED", "429 too many requeﬆs", "Verifying you are human", "acce denied", "checKing if the site connection is secure"]
    want = [None, None, None, "This site can't be reached", "Just a moment...", "Access denied", "429 Too Many Requests", "Verifying you are human", None, "Checking if the site connection is secure"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = t.select("i", gates.signature(F.col("t"), FAILURE_SIGNATURES).alias("s"), gates.has_signature(F.col("t"), FAILURE_SIGNATURES).alias("h")).orderBy("i").collect()
    assert [r["s"] for r in got] == want
    assert [bool(r["h"]) for r in got] == [w is not None for w in want]


def test_squeeze_equals_plain_patterns(spark):
    texts = ["", "a b", "a  b", " a", "a\tb", "\f", "a \n b", "a\n \n \nb", "a\r\n\r\n\r\nb\r", "  a​ ﻿ b", "a\n\n\nb", "a\n\nb", "x\x0by \t z\n"]

    def plain(t):
        t = re.sub("[​‌‍⁠﻿]", "", t.replace("\r\n", "\n").replace("\r", "\n").replace(" ", " "))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t\f\x0b]+", " ", t))).strip(" \n")

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.squeeze(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == {t: plain(t) for t in texts}


def _exchanges_with_text(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("RepartitionByExpression")


def test_texts_of_captures_and_state_are_not_dealt_out(spark):
    assert _exchanges_with_text(C.captures(spark, SF)) == _exchanges_with_text(C.prior(spark, SF)) == 0


def test_lines_of_pairs_are_not_moved(spark):
    pairs = spark.createDataFrame([("s", "u", 1, "a\nb\nb", "b\nc")], "set_name string, url string, doc_id long, old string, new string")
    out = diffs.line_differences(pairs, ["doc_id"], "old", "new")
    assert _exchanges_with_text(out) == 1
    assert sorted(map(tuple, out.collect())) == [(1, "a", "removed", 1), (1, "b", "removed", 1), (1, "c", "added", 1)]


def test_a_review_makes_its_diffs_once(spark):
    from changewatch.plans import registry

    spark.catalog.clearCache()
    leaves = registry.queries()["analyse_sets"](spark, SF)._jdf.queryExecution().withCachedData().collectLeaves()
    # nothing but kept diffs is read, by labels and tags and by sections alike
    assert {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.length())} == {"InMemoryRelation"}
