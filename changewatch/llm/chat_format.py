r"""Chat formatting with prefix-target expansion.

A conversation is rendered turn by turn as ``<|im_start|>role\ntext<|im_end|>\n``
with control strings inside texts and roles escaped, reversibly: a backslash
is doubled, and ``<|`` becomes ``<\|``. Every assistant turn makes an example
of its own: all turns before it as context, and only its reply trainable. If
turns follow the last reply, one more example without a target holds them.

Examples of a conversation are prefixes of one rendered text, so they are kept
as ranges of it with their last turn (``examples``), n rows for n replies, or
expanded to strings, each a whole prefix and its target (``example_texts``).
``read_back`` reads the strings, whose size grows with the square of a
conversation's replies.

Rows of a conversation are brought together and sorted, then streamed. A task
holds one turn at a time while it formats, and one example at a time while it
expands or reads.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn, in order within its task: conv_id, turn_no, rendered, start, example_no, ends, loss_start, loss_end.

    start is the place of ``rendered`` in the conversation's text, in code
    points. example_no is the first example that holds the turn, and ends says
    whether that example ends with it. loss_start and loss_end (places in the
    text) are set for assistant turns alone. Turns are ordered by ``turn``,
    nulls first, ties by role and text; repeated rows are turns of their own;
    null roles and texts are empty; rows of a null conversation are one
    conversation. An empty table gives an empty result. Other columns are not read.
    """
    cols = [F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    ordered = rows.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = ordered.select("conv_id").schema.add("turn_no", "long").add("rendered", "string").add("start", "long").add("example_no", "long").add("ends", "boolean").add("loss_start", "long").add("loss_end", "long")
    kinds = (None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last = pa.int64(), None  # the turn before, until it is known whether the conversation goes on
        n = place = replies = 0

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(x, k or kind) for k, x in zip(kinds, zip(*out, strict=True), strict=True)], names=schema.names)

        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for c, r, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                goes_on = last is not None and last[0] == c
                if last is not None:
                    last[5] = last[5] or not goes_on
                    out.append(last)
                if not goes_on:
                    n = place = replies = 0
                head, body = f"{START}{escape_role(r)}\n", escape(t)
                rendered, ours = head + body + END, r == TRAINED
                loss = (place + len(head), place + len(head) + len(body)) if ours else (None, None)
                last = [c, n, rendered, place, replies, ours, *loss]
                n, place, replies = n + 1, place + len(rendered), replies + ours
            if out:
                yield batch_of(out)
        if last is not None:
            last[5] = True
            yield batch_of([last])

    return ordered.mapInArrow(run, schema)


def examples(formatted: DataFrame) -> DataFrame:
    """The expansion of ``format_turns``: a row for each assistant turn, and one without a target where turns follow the last reply.

    (conv_id, example_no, length, loss_start, loss_end, last_start, last_turn),
    in order. The example is the first ``length`` code points of the
    conversation's text; last_turn is its end from last_start on, which holds
    all that is trained.
    """
    return formatted.filter("ends").select("conv_id", "example_no", (F.col("start") + F.length("rendered")).alias("length"), "loss_start", "loss_end", F.col("start").alias("last_start"), F.col("rendered").alias("last_turn"))


def example_texts(formatted: DataFrame) -> DataFrame:
    """(conv_id, example_no, text, loss_start, loss_end) as strings. Holds one conversation's text in a task; its output grows with the square of a conversation's replies."""
    schema = formatted.select("conv_id", "example_no", F.col("rendered").alias("text"), "loss_start", "loss_end").schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix: list[str] = []
        for batch in batches:
            for c, n, k, ends, rendered, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn_no", "example_no", "ends", "rendered", "loss_start", "loss_end")), strict=True):
                if n == 0:
                    prefix = []
                prefix.append(rendered)
                if ends:
                    prefix = ["".join(prefix)]
                    yield pa.RecordBatch.from_arrays([pa.array([c], batch.schema.field("conv_id").type), pa.array([k], pa.int64()), pa.array(prefix, pa.string()), pa.array([a], pa.int64()), pa.array([b], pa.int64())], names=schema.names)

    return formatted.mapInArrow(run, schema)


def _digests(rows: DataFrame, columns: tuple[str, ...], first: str, start, add, close, fields: str) -> DataFrame:
    """(conv_id, fields): rows in order, from one whose ``first`` is 0 to the next, added up to a digest that is then closed."""
    schema = rows.select("conv_id").schema
    for f in fields.split():
        name, _, kind = f.partition(":")
        schema = schema.add(name, kind)
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind = None, None, pa.int64()

        def batch_of(out):
            types = [kind, *(kinds[f.partition(":")[2]] for f in fields.split())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for c, n, *values in zip(*(batch.column(x).to_pylist() for x in ("conv_id", first, *columns)), strict=True):
                if n == 0:
                    if state is not None:
                        out.append((conv, *close(state)))
                    conv, state = c, start()
                add(state, *values)
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([(conv, *close(state))])

    return rows.mapInArrow(run, schema)


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256) from rendered turns: the digest is of role, line feed, text, line feed for each."""

    def start():
        return [0, hashlib.sha256()]

    def add(state, rendered):
        role, body = _TURN.fullmatch(rendered).groups()
        state[0] += 1
        state[1].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))

    return _digests(formatted, ("rendered",), "turn_no", start, add, lambda s: (s[0], s[1].hexdigest()), "n_turns:long turns_sha256:string")


def read_examples(expanded: DataFrame) -> DataFrame:
    """(conv_id, loss_chars, loss_sha256, formatted_chars) from ``example_texts``: of the unescaped text under their loss masks, and of the lengths of all."""

    def start():
        return [0, hashlib.sha256(), 0]

    def add(state, text, a, b):
        state[2] += len(text)
        if a is not None:
            trained = unescape(text[a:b])
            state[0] += len(trained)
            state[1].update(trained.encode("utf-8", "surrogatepass"))

    return _digests(expanded, ("text", "loss_start", "loss_end"), "example_no", start, add, lambda s: (s[0], s[1].hexdigest(), s[2]), "loss_chars:long loss_sha256:string formatted_chars:long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, turns_sha256 from what was rendered; loss_chars, loss_sha256, formatted_chars from the texts of its examples, each a whole prefix and its target."""
    turns, expanded = read_turns(formatted), read_examples(example_texts(formatted)).withColumnRenamed("conv_id", "_conv")
    return turns.join(expanded, turns["conv_id"].eqNullSafe(expanded["_conv"])).drop("_conv")
