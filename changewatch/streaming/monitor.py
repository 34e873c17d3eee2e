"""Captures as a stream: each document's state is kept by key, outcomes come out as captures come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from changewatch.config import Config
from changewatch.functions.udfs import normalise_text
from changewatch.operators.gates import holds_signature

OUT = "set_name string, url string, captured_at timestamp, outcome string, failures long"
STATE = "hash string, length long, failures long"


def refusal_of(text: str, prior_length: int | None, cfg: Config) -> str | None:
    """As ``operators.gates.refusal``, for one text."""
    v = cfg.validation
    if not text.strip():
        return "empty"
    if holds_signature(text, v.failure_signatures):
        return "block_page"
    if len(text) < v.min_length:
        return "too_short"
    if prior_length:
        if len(text) < prior_length * v.shrink_ratio:
            return "shrank"
        if len(text) > prior_length * v.growth_ratio:
            return "grew"
    return None


def outcomes(captures: DataFrame, cfg: Config = Config(), delay: str = "1 day") -> DataFrame:
    """(set_name, url, captured_at, outcome, failures) of a stream of captures (set_name, url, captured_at, status, text).

    A capture that comes twice within ``delay`` counts once. State is one hash
    and two numbers for each document; texts are not kept.
    """
    import hashlib

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, length, failures = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("captured_at")
        out = []
        for at, status, text in zip(rows["captured_at"], rows["status"], rows["text"], strict=True):
            if status == "not_modified":
                outcome, failures = "not_modified", 0
            elif status != "ok":
                outcome, failures = "fetch_failed", failures + 1
            elif refusal_of(now := normalise_text(text), length, cfg):
                outcome, failures = "suspect_scrape", failures + 1
            else:
                new = hashlib.sha256(now.encode()).hexdigest()
                outcome = "new" if digest is None else "unchanged" if new == digest else "changed"
                digest, length, failures = new, len(now), 0
            out.append((*key, at, outcome, failures))
        state.update((digest, length, failures))
        yield pd.DataFrame(out, columns=["set_name", "url", "captured_at", "outcome", "failures"])

    once = captures.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["set_name", "url", "captured_at"])
    return once.groupBy("set_name", "url").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def daily_outcomes(found: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, outcome, n) over a stream with captured_at and outcome."""
    return found.withWatermark("captured_at", delay).groupBy(F.window("captured_at", "1 day"), "outcome").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "outcome", "n")
