"""Periodic runs, byte context trees and part codes against brute force, by ablation, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changewatch.llm import context_tree, oracles, part_codes, periodic_runs
from changewatch.llm import queries as Q
from conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, block long, place long, runs string, k0 long, value string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, "r", 3, "v") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b " * 3000), (4, "a b " * 3000), (None, "null id " * 20), (None, None), (7, "é中🙂  x " * 9), (8, "A" * 50000), (9, "only one")]


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.execute(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall())


# --- 11: runs ---------------------------------------------------------------------


def plain_runs(words, least):
    """All runs, from the stretches in which words agree with those q further on; of the same stretch the smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        begin = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and begin is None:
                begin = i
            elif not same and begin is not None:
                if i - begin >= q:
                    found.setdefault((begin, i - begin + q), q)
                begin = None
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_up(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 3)):
        base = [rng.randrange(rng.choice([2, 4, 50])) for _ in range(rng.randint(1, 40))]
        at = rng.randint(0, len(words))
        words[at:at] = (base * 8)[: rng.randint(len(base), 8 * len(base))]
    return words


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([2, 5, 12]), st.booleans())
def test_runs_equal_plain_search(seed, least, sliced):
    rng = random.Random(seed)
    texts = [made_up(rng) for _ in range(rng.randint(1, 5))]
    slice_ = periodic_runs.SLICE
    periodic_runs.SLICE = 50 if sliced else slice_  # many slices of anchors
    try:
        got = periodic_runs.runs_of([np.array(w, dtype=np.int64) for w in texts], least)
    finally:
        periodic_runs.SLICE = slice_
    for k, words in enumerate(texts):
        assert [tuple(r[1:].tolist()) for r in got if r[0] == k] == plain_runs(words, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=200), st.integers(0, 10**9))
def test_extensions_equal_word_by_word(words, seed):
    s = np.array([*words, 9], dtype=np.int64)
    extend, rng = periodic_runs.Extensions(s), random.Random(seed)
    pairs = [(i, j) for i, j in ((rng.randrange(len(s)), rng.randrange(len(s))) for _ in range(60)) if i != j]
    plain = [next(k for k in range(len(s) + 1) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]) for i, j in pairs]
    if pairs:
        assert extend(*np.array(pairs).T).tolist() == plain


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_the_query_equals_plain_search_over_whole_documents(spark, documents):
    got = {r["doc_id"]: r for r in Q.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == documents.keys()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    several = 0
    for doc_id, text in documents.items():
        words = planted(doc_id, WORDS.findall(text or ""))
        known = {}
        runs = plain_runs([known.setdefault(w, len(known)) for w in words], 12) if len(words) < 1500 else None
        r = got[doc_id]
        if runs is None:
            assert (r["n_runs"] == 0) == (r["start"] is None)
            continue
        several += len(runs) > 1
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(top or (None,) * 3))
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r["collapsed_sha256"] == digest(plain_collapsed(words, runs))
    assert several > 3


def test_runs_of_odd_tables(spark):
    got = periodic_runs.find(frame(spark, ODD), keep=("doc_id", "runs")).collect()
    assert got[0].asDict().keys() >= {"doc_id", "runs", "n_words", "collapsed"} and len(got) == len(ODD)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[1][2:] == (0, [], "") and by[3][2:] == (0, [], "")
    assert [tuple(x) for x in by[4][3]] == [(0, 6000, 2)] and by[4]["collapsed"] == "a b" and sum(r[0] == 4 for r in got) == 2
    assert [tuple(x) for x in by[7][3]] == [(0, 18, 2)] and by[8]["collapsed"] == "A" * 50000
    assert periodic_runs.find(frame(spark, []).limit(0)).count() == 0
    dotted = frame(spark, [(1, "x")]).withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "c.d")
    assert periodic_runs.find(dotted, text="c.d", keep=("a.b",)).first()["a.b"] == 1


def test_long_periodic_texts_take_bounded_time():
    n = 200_000
    for words in (np.zeros(n, dtype=np.int64), np.arange(n) % 70_000, np.arange(n) % 7):
        assert len(periodic_runs.runs_of([words], 12)) == 1


# --- 12: context trees --------------------------------------------------------------


class PlainTree:
    """The weighted probability by its definition, over all nodes, in plain recursion."""

    def __init__(self, depth):
        self.depth, self.counts = depth, Counter()

    def contexts(self, context):
        return [context[len(context) - d :] for d in range(self.depth + 1)]

    def add(self, context, prefix, bit, n=1):
        for c in self.contexts(context):
            self.counts[c, prefix, bit] += n

    def weighted(self, prefix, context=b""):
        a, b = self.counts[context, prefix, 0], self.counts[context, prefix, 1]
        if a + b == 0:
            return 0.0
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        if len(context) == self.depth:
            return own
        longer = {c for c, p, _ in self.counts if p == prefix and len(c) == len(context) + 1 and c.endswith(context)}
        return math.log(0.5) + np.logaddexp(own, sum(self.weighted(prefix, c) for c in longer))

    def bits(self, byte):
        return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]

    def learn(self, text):
        for i, byte in enumerate(data := text + b"\xff"):
            for prefix, bit in self.bits(byte):
                self.add((b"\xff" * self.depth + data)[i : i + self.depth], prefix, bit)

    def log10(self, text):
        """By the chain rule: what one more decision does to the probability of all, then taken back."""
        total = 0.0
        for i, byte in enumerate(data := text + b"\xff"):
            context = (b"\xff" * self.depth + data)[i : i + self.depth]
            for prefix, bit in self.bits(byte):
                before = self.weighted(prefix)
                self.add(context, prefix, bit)
                total += self.weighted(prefix) - before
                self.add(context, prefix, bit, -1)
                self.counts += Counter()
        return total / math.log(10)


@pytest.mark.parametrize("depth", [2, 3])
def test_scores_equal_the_definition(spark, depth):
    rows = [(1, "abracadabra ABR"), (2, "abc abd"), (3, None), (4, "zebra"), (5, "é"), (2, "abc abd")]
    tree = PlainTree(depth)
    for i, t in rows:
        if i in (1, 2, 3):
            tree.learn((t or "").lower().encode())
    for block in (10**6, 1):  # one block, and one for each slice of a task
        got = context_tree.score(frame(spark, rows), learn_from=F.col("doc_id") <= 3, depth=depth, block_bytes=block).collect()
        assert len(got) == len(rows)
        for r in got:
            text = (dict(rows)[r["doc_id"]] or "").lower().encode()
            assert r["score"] == pytest.approx(tree.log10(text), abs=1e-9) and r["n_bytes"] == len(text)
            assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / (len(text) + 1))


def test_probabilities_of_all_bytes_add_up_to_one():
    rng = np.random.default_rng(3)
    learnt = context_tree.grams([bytes(rng.integers(97, 102, 400, dtype=np.uint8)) for _ in range(3)], 4)[0]
    keys, counts = np.unique(learnt, return_counts=True)
    for context in (int(keys[5]) >> 8, 0x6162637A7A >> 8, 0):
        every = (context << 8) | np.arange(256)
        k = np.unique(np.concatenate([keys, every]))
        c = np.zeros(len(k), dtype=np.int64)
        c[np.searchsorted(k, keys)] = counts
        p, nodes = context_tree.subtrees(k, c, 4)
        up, at = np.unique(nodes["node"] >> 16 << 8 | nodes["node"] & 255, return_inverse=True)
        total = lambda x: np.bincount(at, weights=nodes[x])  # noqa: B023, E731
        top = context_tree.Top(up, total("zeros").astype(np.int64), total("ones").astype(np.int64), total("weighted"))
        assert (10 ** top.log10(k, p, 4))[np.searchsorted(k, every)].sum() == pytest.approx(1, abs=1e-9)


def test_base_scores_equal_plain_counts(spark, documents):
    got = {r["doc_id"]: r for r in Q.op12_context_tree(spark, SF).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {i: [*WORDS.findall(lower(t)), ""] for i, t in documents.items()}
    count = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    assert got.keys() == documents.keys()
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))


def test_mixing_all_depths_beats_each_text_scored_without_learning(spark, documents):
    """Held-out code length: learning helps, and depth helps; shuffled letters cost more than the text."""
    rng = random.Random(1)
    rows = [(i, t) for i, t in documents.items() if t and len(t) > 400]
    shuffled = [(-i - 1, "".join(rng.sample(t, len(t)))) for i, t in rows[:40]]
    learn = (F.col("doc_id") % 5 != 0) & (F.col("doc_id") >= 0)
    mean = lambda s: {k: v for k, v in s.groupBy(F.when(F.col("doc_id") < 0, "shuffled").otherwise((F.col("doc_id") % 5).cast("string"))).agg(F.avg("bits_per_byte")).collect()}
    deep, flat = (mean(context_tree.score(frame(spark, rows + shuffled), learn_from=learn, depth=d)) for d in (5, 2))
    assert deep["0"] < flat["0"] < 5 < deep["shuffled"] and deep["0"] < deep["shuffled"] - 1.5


def test_trees_of_odd_tables(spark):
    got = context_tree.score(frame(spark, ODD), keep=("doc_id", "block", "value")).collect()
    assert len(got) == len(ODD) and all(r["block"] == 1 and r["value"] == "v" and r["score"] <= 0 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    nothing = context_tree.score(frame(spark, ODD[:3]), learn_from=F.lit(None).cast("boolean")).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in nothing} == {(0, 0)} and [r["score"] for r in nothing if r["doc_id"] < 3] == pytest.approx([-8 * math.log10(2)] * 2)
    assert context_tree.score(frame(spark, []).limit(0)).count() == 0


# --- 13: part codes --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 20), st.sampled_from([1, 3, 200]))
def test_bounds_decide_as_exact_distances(seed, k, spread):
    """Over rounds of moving entries, also with ties and entries that coincide."""
    rng = np.random.default_rng(seed)
    parts = rng.integers(-spread, spread + 1, (300, 3))
    book, known, before, b = parts[:k].copy(), None, None, min(4, k - 1)
    k = len(book)
    for _ in range(6):
        known, need = part_codes.assign(parts, book, before, known, b)
        exact = part_codes.distances(parts, book)
        assert (known.entry == exact.argmin(axis=1)).all() and len(need) == len(parts)
        root = np.sqrt(np.take_along_axis(exact, known.near.astype(np.int64), axis=1))
        assert (known.lower <= root + 1e-9).all() and (known.upper >= np.sqrt(exact.min(axis=1)) - 1e-9).all()
        others = np.ones(exact.shape, dtype=bool)
        np.put_along_axis(others, np.concatenate([known.entry[:, None], known.near], axis=1).astype(np.int64), False, axis=1)
        assert (np.where(others, np.sqrt(exact), np.inf).min(axis=1) >= known.outer - 1e-9).all()
        before, b = book, max(min(b, 1), b - int(rng.integers(0, 2)))
        book = book + rng.integers(-max(spread // 4, 1), max(spread // 4, 1) + 1, book.shape)


def test_bounds_spare_most_comparisons():
    """Well-separated parts are settled by the bounds alone, without distances."""
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (16, 8))
    parts = centers[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    known, _ = part_codes.assign(parts, centers, None, None, 4)
    _, need = part_codes.assign(parts, centers + rng.integers(-5, 6, centers.shape), centers, known, 4)
    assert (need == 0).mean() > 0.95


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "s") for i, v, y in rows], "vec_id long, embedding array<float>, label int, k0 string")


def against_sql(spark, tmp_path, rows):
    t = vectors(spark, rows)
    t.write.mode("overwrite").parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/e/*.parquet')")
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"select {', '.join(columns)} from ({oracles.part_codes()})").fetchall()
    got = [tuple(r) for r in part_codes.encode(spark.read.parquet(f"{tmp_path}/e")).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_codes_equal_sql_on_odd_vectors(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 1 / 3, 2.0]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(120)]
    rows += [(i, rows[3][1], 1) for i in range(200, 260)]  # copies
    rows += [(300, None, 1), (301, [float("nan")] * 16, 1), (302, [None] * 16, 2), (303, [float("inf")] + [0.0] * 15, 2), (None, [1.0] * 16, None), (5, [0.5] * 16, 2)]
    assert len(against_sql(spark, tmp_path, rows)) == len(rows) - 4
    assert len(against_sql(spark, tmp_path, rows[:5])) == 5  # fewer vectors than entries
    assert len(against_sql(spark, tmp_path, [(i, [1.0] * 8, 1) for i in range(40)])) == 40  # all alike


def test_codes_of_empty_and_refused_tables(spark):
    assert part_codes.encode(vectors(spark, [])).count() == 0
    assert part_codes.encode(vectors(spark, [(1, None, 1)])).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    for bad in ([[1.0] * 8, [1.0] * 16], [[1.0] * 7], [[1e20] * 8]):
        with pytest.raises(ValueError, match="vectors|components"):
            part_codes.encode(vectors(spark, [(i, v, 1) for i, v in enumerate(bad)]))
