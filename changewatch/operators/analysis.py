"""The review of a change by a model: its prompt, and the contract that a reply must keep."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.operators.state import PRIORITIES, VERDICTS

KEYS = ("verdict", "summary", "analysis", "priority")


def prompt(set_name: Column, diff: Column, documents: Column, tags: Column) -> Column:
    """What the model is asked; notes on documents and tags only where there are any."""
    note = lambda items, before, after: F.when(F.size(items) > 0, F.concat(F.lit(before), F.array_join(items, ", "), F.lit(after))).otherwise("")
    return F.concat(
        F.lit('A monitored set of documents named "'), set_name, F.lit('" has changed. Lines of the diff that begin with - were removed, those with + were added.\n'),
        note(documents, "Changed documents: ", ". All others are unchanged.\n"),
        note(tags, "Patterns found in changed lines: ", ". These are hints, not findings.\n"),
        F.lit(f"Answer with one JSON object with the keys {', '.join(KEYS)}; verdict is one of {', '.join(VERDICTS)}, priority one of {', '.join(PRIORITIES)}.\n\n"),
        diff,
    )


def check_reply(t: DataFrame, raw: str) -> DataFrame:
    """``t`` with error, verdict, summary, reply_analysis and priority of its raw reply; error names the first rule that it breaks.

    A reply that declines has low priority, whatever it says. What several
    rules ask for - the parsed reply, its fields - are columns of steps of
    their own, so that each is worked out once a row.
    """
    blanks = F.lit(" \t\r\n")
    body = F.btrim(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"(?m)^```(?:json)?[ \t]*$|```$", ""), blanks)
    shape = F.schema_of_variant(F.col("_v"))
    steps = [
        {"_body": body},
        {"_v": F.try_parse_json("_body")},
        {"_object": F.coalesce(shape.startswith("OBJECT"), F.lit(False)), **{f"_f_{k}": F.try_variant_get("_v", f"$.{k}", "variant") for k in KEYS}},
        {f"_s_{k}": F.when(F.schema_of_variant(F.col(f"_f_{k}")) == "STRING", F.btrim(F.try_variant_get(F.col(f"_f_{k}"), "$", "string"), blanks)) for k in KEYS},
        {f"_s_{k}": F.lower(f"_s_{k}") for k in ("verdict", "priority")},
    ]
    out = t
    for step in steps:
        out = out.withColumns(step)
    text = lambda k: F.col(f"_s_{k}")
    error = F.when(F.btrim(F.coalesce(F.col(raw), F.lit("")), blanks) == "", "empty").when(F.col("_v").isNull(), "not JSON").when(~F.col("_object"), "not an object")
    for k in KEYS:
        error = error.when(F.col(f"_f_{k}").isNull(), f"missing {k}")
    for k, allowed in (("verdict", VERDICTS), ("priority", PRIORITIES)):
        error = error.when(~F.coalesce(text(k).isin(*allowed), F.lit(False)), f"bad {k}")
    for k in ("summary", "analysis"):
        error = error.when(F.coalesce(text(k), F.lit("")) == "", f"bad {k}")
    out = out.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.withColumns({
        "verdict": F.when(ok, text("verdict")),
        "summary": F.when(ok, text("summary")),
        "reply_analysis": F.when(ok, text("analysis")),
        "priority": F.when(ok, F.when(text("verdict") == "no_material_change", "low").otherwise(text("priority"))),
    }).drop("_body", "_v", "_object", *(f"_{x}_{k}" for k in KEYS for x in "fs"))


class Reply(NamedTuple):
    """A model's reply and the tokens that it took; clients that count none give the text alone."""

    text: str
    prompt_tokens: int = 0
    output_tokens: int = 0


Analyser = Callable[[str], "str | Reply | None"]


def usage(answer: str | Reply | None) -> Reply:
    """A reply with counts: what is missing is '' or 0."""
    text, *counts = answer if isinstance(answer, tuple) else (answer,)
    return Reply(text or "", *(int(n or 0) for n in counts))


def stub(prompt_text: str) -> Reply:
    """A reply that depends on the prompt alone, for tests and dry runs; a token is four characters."""
    high = "arbitration" in prompt_text
    text = '{"verdict": "%s", "summary": "A change was found.", "analysis": "See the diff.", "priority": "%s"}' % ("material_change" if high else "no_material_change", "high" if high else "low")
    return Reply(text, len(prompt_text) // 4, len(text) // 4)


def analyse(sets: DataFrame, analyser: Analyser = stub, attempts: int = 2) -> DataFrame:
    """``sets`` (set_name, prompt) with reply, attempts, error, prompt_tokens and output_tokens: the analyser is asked once for each set, and again with its error after a reply that breaks the contract.

    Runs after aggregation, so once for each changed set. An exception counts
    as an attempt; tokens are summed over attempts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, asked in zip(pdf["set_name"], pdf["prompt"], strict=True):
                reply, error, n, spent = None, "", 0, [0, 0]
                for n in range(1, attempts + 1):
                    try:
                        reply, *counts = usage(analyser(asked if not error else f"{asked}\n\nThe reply before was rejected: {error}"))
                        spent = [a + b for a, b in zip(spent, counts, strict=True)]
                        error = broken(reply)
                    except Exception as e:  # noqa: BLE001  whatever a client raises is a failed attempt
                        reply, error = None, f"{type(e).__name__}: {e}"
                    if not error:
                        break
                out.append((name, reply if not error else None, n, error, *spent))
            yield pd.DataFrame(out, columns=["set_name", "reply", "attempts", "error", "prompt_tokens", "output_tokens"])

    return sets.select("set_name", "prompt").mapInPandas(run, "set_name string, reply string, attempts long, error string, prompt_tokens long, output_tokens long")


def broken(reply: str | None) -> str:
    """The first rule that a reply breaks, in Python; '' if none. Equal to ``check_reply``."""
    import json
    import re

    if not reply or not reply.strip():
        return "empty"
    try:
        got = json.loads(re.sub(r"(?m)^```(?:json)?[ \t]*$|```$", "", reply).strip())
    except ValueError:
        return "not JSON"
    if not isinstance(got, dict):
        return "not an object"
    for k in KEYS:
        if k not in got:
            return f"missing {k}"
    for k, allowed in (("verdict", VERDICTS), ("priority", PRIORITIES)):
        if not isinstance(got[k], str) or got[k].strip().lower() not in allowed:
            return f"bad {k}"
    for k in ("summary", "analysis"):
        if not isinstance(got[k], str) or not got[k].strip():
            return f"bad {k}"
    return ""
