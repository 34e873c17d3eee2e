"""Digests, texts and numbers over ordered groups, none of which is ever held in one row or one task's memory to be sorted.

All rows are dealt out in ranges of (group, order) and sorted there by Spark,
so a group of any size is spread over tasks. A range then streams through a
small function that keeps one batch: it packs neighbouring values of a group
into pieces of about a megabyte, or numbers them. A value that its definition
makes sequential (a digest over a group's rows in order) is finished from the
pieces in their order, one in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a piece.
PIECE = 1 << 20
#: Bytes that a text in a row has at most.
MOST = (1 << 31) - 1


def _sorted(t: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(g0, ..., o0, ..., value) in ranges of groups and their order; ties in order by the value."""
    g, o = [f"g{i}" for i in range(len(by))], [f"o{i}" for i in range(len(order))]
    rows = t.select(*(F.col(c).alias(n) for c, n in zip(by, g, strict=True)), *(F.col(c).alias(n) for c, n in zip(order, o, strict=True)), F.col(value).alias("value"))
    return rows.repartitionByRange(*g, *o).sortWithinPartitions(*g, *o, "value")


def _stretches(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(group, rows) of neighbouring rows of a group, of which the first ``width`` columns say the group; a long one comes in several."""
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:width]), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], batch.slice(start, i - start)
                start = i


def _pieces(rows: DataFrame, n: int, sep: bytes) -> DataFrame:
    """(g0, ..., _range, _no, piece): a group's values of a range joined by ``sep``, in pieces; null values are empty."""
    groups = [f for f in rows.schema.fields if f.name[0] == "g"]
    schema = T.StructType([*groups, T.StructField("_range", T.IntegerType()), T.StructField("_no", T.LongType()), T.StructField("piece", T.BinaryType())])
    at = len(rows.columns) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, no = TaskContext.get().partitionId(), 0
        group, types, held, size = None, None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(group, types, strict=True)), pa.array([here], pa.int32()), pa.array([no], pa.int64()), pa.array([sep.join(held)], pa.binary())], names=schema.names)

        for key, part in _stretches(batches, n):
            types = [c.type for c in part.columns[:n]]
            # bytes as they lie in the batch
            for value in part.column(at).cast(pa.binary()).to_pylist():
                if held and (key != group or size >= PIECE):
                    yield flush()
                    no, held, size = no + 1, [], 0
                group = key
                held.append(value or b"")
                size += len(held[-1]) + len(sep)
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def _finished(t: DataFrame, by: Sequence[str], order: Sequence[str], value: str, sep: str, name: str, kind: Callable[[], tuple[Callable[[bytes | pa.Buffer], None], Callable[[], pa.Array]]]) -> DataFrame:
    """(by, name): what ``kind``'s (add, result) make of a group's pieces in order, separators between them included."""
    n, glue = len(by), sep.encode()
    pieces = _pieces(_sorted(t, by, order, value), n, glue)
    groups = pieces.schema.fields[:n]
    schema = T.StructType([*groups, T.StructField(name, T.StringType())])
    g = [f.name for f in groups]
    placed = pieces.repartition(*g).sortWithinPartitions(*g, "_range", "_no")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, types, add, result = None, None, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(group, types, strict=True)), result()], names=schema.names)

        for key, part in _stretches(batches, n):
            types = [c.type for c in part.columns[:n]]
            # pieces where they lie in the batch, none of them copied
            for piece in (x.as_buffer() for x in part.column(n + 2)):
                if result is not None and key == group:
                    add(glue)
                else:
                    if result is not None:
                        yield made()
                    group, (add, result) = key, kind()
                add(piece)
        if result is not None:
            yield made()

    return placed.mapInArrow(run, schema).toDF(*by, name)


def _hashing() -> tuple[Callable[[bytes | pa.Buffer], None], Callable[[], pa.Array]]:
    h = hashlib.sha256()
    return h.update, lambda: pa.array([h.hexdigest()], pa.string())


def digest(t: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, sep: str = "\n", name: str = "hash") -> DataFrame:
    """(by, name): SHA-256, in hex, of a group's values in order with ``sep`` between them. Null values are empty; null groups are a group."""
    return _finished(t, by, order, value, sep, name, _hashing)


def joined(t: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, sep: str, name: str, limit: int | None = None, note: str = "") -> DataFrame:
    """(by, name): a group's texts in order with ``sep`` between them, as one text.

    It must fit in a row; ``parts`` has no such bound. ``limit``: so many bytes at
    most, for readers that take no more; ``note`` follows where it cut.
    """

    def joining() -> tuple[Callable[[bytes | pa.Buffer], None], Callable[[], pa.Array]]:
        # written as it comes and handed on as it is: a long text is held once
        held, room = pa.BufferOutputStream(), [limit]

        def add(piece: bytes | pa.Buffer) -> None:
            if room[0] is not None:
                if room[0] < 0:
                    return
                if len(piece) > room[0]:
                    held.write(bytes(piece)[: room[0]].decode("utf-8", "ignore").encode() + note.encode())
                    room[0] = -1
                    return
                room[0] -= len(piece)
            held.write(piece)

        def result() -> pa.Array:
            size = held.tell()
            if size > MOST:
                raise ValueError(f"a text of {size} bytes does not fit in a row; parts has no such bound")
            return pa.StringArray.from_buffers(1, pa.array([0, size], pa.int32()).buffers()[1], held.getvalue())

        return add, result

    return _finished(t, by, order, value, sep, name, joining)


def parts(t: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, sep: str = "", name: str = "part", hold: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(by, order, name, value): a group's values numbered from 0 in order, all but the first with ``sep`` before them, so that they join to the group's whole text.

    No bound on a group: ranges number their own rows, and the one group of
    each range that goes on from earlier ranges adds their count, at most a row
    for each range. The numbered rows are read twice, so ``hold`` keeps them.
    """
    rows = _sorted(t, by, order, value)
    n, fields = len(by), rows.schema.fields
    schema = T.StructType([*fields, T.StructField("_range", T.IntegerType()), T.StructField("_no", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group, no = TaskContext.get().partitionId(), None, 0
        for key, part in _stretches(batches, n):
            group, no = key, no if key == group else 0
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([here] * m, pa.int32()), pa.array(range(no, no + m), pa.int64())], names=schema.names)
            no += m

    held = hold(rows.mapInArrow(run, schema))
    g = [f.name for f in fields[:n]]
    counts = held.groupBy("_range", *g).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*g).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).filter("_before > 0")
    before = before.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_{c}") for c in g), "_before")
    same = F.col("_range") == F.col("_r")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.col("_no") + F.coalesce("_before", F.lit(0))
    names = {f.name: c for f, c in zip(fields, (*by, *order, value), strict=True)}
    return held.join(F.broadcast(before), same, "left").select(*(F.col(f).alias(c) for f, c in names.items() if f != "value"), place.alias(name), F.when(place > 0, F.concat(F.lit(sep), F.coalesce("value", F.lit("")))).otherwise(F.coalesce("value", F.lit(""))).alias(value))
