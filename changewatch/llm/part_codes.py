"""Codes for vectors: each of eight parts of a vector becomes the number of its nearest codebook entry.

The codebooks are improved by Lloyd's rounds in whole numbers. A round need not
compare every part with every entry: for each part the table holds its entry
with an upper bound on their distance, the b next closest entries in order
with a lower bound each, and one outer lower bound for all the others. When
entries move, the bounds give way by as much, and a part whose upper bound
stays below all lower ones keeps its entry unseen. Else the entries before the
first lower bound above the upper one, or all if there is none, are compared
by their whole-number distances, which alone decide; ties go to the lower
index. After each round b follows what the parts needed, apart for every
part position.

The bounds are written as Parquet beside the vectors, a table for each round, and the
table before is deleted. A round leaves sums and counts by entry, added up within tasks
and then by Spark; the driver sees the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch.llm.common import Table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Distances are added up in 64 bits: components must be less than this after scaling.
LARGEST = 1 << 26
#: What rounding may add to or take from a bound, as a share of it.
_EPS = 1e-6


@dataclass
class Bounds:
    """What is known of the n parts at one position: the entry, an upper bound, b closest others in order, their lower bounds, the outer bound."""

    entry: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (parts x entries) of whole-number vectors."""
    return np.stack([((parts - e) ** 2).sum(axis=1) for e in book], axis=1)


def _ranked(exact: np.ndarray, b: int) -> Bounds:
    """Bounds from the exact distances to all entries."""
    order = np.argsort(exact, axis=1, kind="stable")  # ties to the lower index
    root = np.sqrt(np.take_along_axis(exact, order, axis=1).astype(np.float64))
    low = (root * (1 - _EPS)).astype(np.float32)
    outer = low[:, b + 1] if exact.shape[1] > b + 1 else np.full(len(exact), np.inf, dtype=np.float32)
    return Bounds(order[:, 0].astype(np.uint8), (root[:, 0] * (1 + _EPS)).astype(np.float32), order[:, 1 : b + 1].astype(np.uint8), low[:, 1 : b + 1], outer)


def assign(parts: np.ndarray, book: np.ndarray, before: np.ndarray | None, known: Bounds | None, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds and entries after the entries moved from ``before`` to ``book``, and by each part the number of lower bounds it needed.

    ``b`` is how many closest entries to go on with, at most as many as before
    for parts that keep theirs. Without ``known`` all is compared.
    """
    n, k = len(parts), len(book)
    b = min(b, k - 1)
    if known is None or before is None:
        return _ranked(distances(parts, book), b), np.full(n, b, dtype=np.int64)
    drift = np.sqrt(((book - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + _EPS)
    have = known.near.shape[1]
    upper = (known.upper + drift[known.entry]) * (1 + _EPS)
    outer = np.where(np.isinf(known.outer), np.inf, known.outer - drift.max(initial=0))
    lower = known.lower - drift[known.near]
    # ordered: all entries from a place on are at least as far as its bound
    all_ = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    all_ = np.where(np.isinf(all_), all_, all_ * np.where(all_ > 0, 1 - _EPS, 1 + _EPS))
    first = lambda u, bounds: np.where((clear := u[:, None] < bounds).any(axis=1), clear.argmax(axis=1), have + 1)
    need = first(upper, all_)
    entry, near = known.entry.copy(), known.near.copy()
    unsure = np.flatnonzero(need > 0)
    if len(unsure):
        # the exact distance to its own entry settles many
        own = ((parts[unsure] - book[entry[unsure]]) ** 2).sum(axis=1)
        upper[unsure] = np.sqrt(own.astype(np.float64)) * (1 + _EPS)
        need[unsure] = first(upper[unsure], all_[unsure])
    lower = all_[:, :-1].copy()
    outer = all_[:, -1].copy()
    for z in range(1, have + 1):
        at = np.flatnonzero(need == z)
        if not len(at):
            continue
        # among its own entry and the first z of its list, by whole numbers
        some = np.concatenate([entry[at][:, None], near[at][:, :z]], axis=1).astype(np.int64)
        exact = ((parts[at][:, None, :] - book[some]) ** 2).sum(axis=2)
        order = np.lexsort((some, exact), axis=1)
        some, root = np.take_along_axis(some, order, axis=1), np.sqrt(np.take_along_axis(exact, order, axis=1).astype(np.float64))
        entry[at], upper[at] = some[:, 0], root[:, 0] * (1 + _EPS)
        near[np.ix_(at, range(z))] = some[:, 1:]
        lower[np.ix_(at, range(z))] = root[:, 1:] * (1 - _EPS)
    made = Bounds(entry, upper, near, lower, outer)
    lost = np.flatnonzero(need == have + 1)
    whole = _ranked(distances(parts[lost], book), have)
    for name in ("entry", "upper", "near", "lower", "outer"):
        getattr(made, name)[lost] = getattr(whole, name)
    if b < have:  # the outer bound takes in what is left out
        made.outer = np.minimum(made.outer, made.lower[:, b]) if b else np.minimum(made.outer, made.lower[:, 0])
        made.near, made.lower = made.near[:, :b], made.lower[:, :b]
    down = lambda x: np.nextafter(x.astype(np.float32), np.float32(-np.inf))
    made.upper, made.lower, made.outer = np.nextafter(made.upper.astype(np.float32), np.float32(np.inf)), down(made.lower), np.where(np.isinf(made.outer), np.float32(np.inf), down(made.outer)).astype(np.float32)
    return made, need


# --- a round over a table --------------------------------------------------------------


def _pack(vectors: np.ndarray, bounds: list[Bounds]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole-number vectors, and of what is known of their parts: fixed widths, a row each."""
    state = [x for u in bounds for x in (u.entry[:, None], u.near, _raw(u.upper[:, None]), _raw(u.lower), _raw(u.outer[:, None]))]
    return _raw(vectors), np.concatenate(state, axis=1)


def _raw(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)


def _unpack(raw: np.ndarray, widths: list[int]) -> list[Bounds]:
    out, at = [], 0

    def take(n: int, kind: type | None = None) -> np.ndarray:
        nonlocal at
        got = raw[:, at : at + n]
        at += n
        return got.copy() if kind is None else np.ascontiguousarray(got).view(kind)

    for b in widths:
        entry, near = take(1)[:, 0], take(b)
        upper, lower, outer = take(4, np.float32)[:, 0], take(4 * b, np.float32) if b else np.zeros((len(raw), 0), dtype=np.float32), take(4, np.float32)[:, 0]
        out.append(Bounds(entry, upper, near, lower, outer))
    return out


def _column(x: np.ndarray) -> pa.Array:
    n, width = x.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


class _Round:
    """One round's work on a batch: assign, and add up what the new entries are made from."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None, widths: list[int] | None, wanted: list[int], kind: str):
        self.books, self.before, self.widths, self.wanted, self.kind = books, before, widths, wanted, kind

    def __call__(self, vectors: np.ndarray, state: np.ndarray | None) -> tuple[list[Bounds], np.ndarray, np.ndarray, np.ndarray]:
        """Bounds, squared error by row, sums (part, entry, place and one more for the count), the most bounds that a part of each position needed."""
        parts = vectors.reshape(len(vectors), PARTS, -1).astype(np.int64)
        known = _unpack(state, self.widths) if state is not None else [None] * PARTS
        bounds, error = [], np.zeros(len(parts), dtype=np.int64)
        sums = np.zeros((PARTS, self.books.shape[1], parts.shape[2] + 1), dtype=np.int64)
        needed = np.zeros(PARTS, dtype=np.int64)
        for j in range(PARTS):
            x = parts[:, j]
            u, need = assign(x, self.books[j], None if self.before is None else self.before[j], known[j], self.wanted[j])
            bounds.append(u)
            error += ((x - self.books[j][u.entry]) ** 2).sum(axis=1)
            np.add.at(sums[j, :, :-1], u.entry, x)
            sums[j, :, -1] = np.bincount(u.entry, minlength=self.books.shape[1])
            needed[j] = need[need <= (self.wanted if self.widths is None else self.widths)[j]].max(initial=0)
        return bounds, error, sums, needed


# --- Spark -----------------------------------------------------------------------------


def whole_vectors(docs: DataFrame, vector: str, keep: tuple[str, ...]) -> DataFrame:
    """(k0, k1, ..., vector): the rows whose vector has no null, NaN or infinite component and is not null, each component as floor(4096 * x)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = docs.filter(x.isNotNull() & fine)
    return rows.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), F.transform(x, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-1e18)), F.lit(1e18)))).alias("vector"))


def encode(docs: DataFrame, *, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """key, label, code, error, label_error and codebooks_sha256, a row for each vector without null or non-finite components.

    The codebooks start as the parts of the ``entries`` (2 to 256) smallest keys' vectors,
    ties by the vector, null keys last; fewer vectors make fewer entries, which are all used
    by ties to the lower index. code: two hex digits for each part. error: the
    squared distance of the vector to what its code stands for, in whole numbers.
    label_error: error summed over the rows of its label, nulls together.
    codebooks_sha256: of all final components, by part, entry and place.

    Repeated rows each count. Other columns are not read. An empty table, or
    one without usable vectors, gives no rows. Raises ValueError where vectors
    differ in length, or have a length that eight doesn't divide, or components of 16,384 or more.
    """
    start = Table(whole_vectors(docs, vector, (key, label)), "vectors")
    spark = docs.sparkSession
    facts = start.df.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda a, c: F.greatest(a, F.abs(c)))).alias("size")).first()
    names = {"k0": key, "k1": label}
    fields = {f.name: f.dataType for f in start.df.schema}
    if facts["least"] is None:
        start.drop()
        return spark.createDataFrame([], T.StructType([T.StructField(key, fields["k0"]), T.StructField(label, fields["k1"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    width = facts["most"]
    if facts["least"] != width or width % PARTS or not width:
        raise ValueError(f"vectors must all have one length that {PARTS} divides; found {facts['least']} to {width}")
    if facts["size"] >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // SCALE}")
    first = start.df.orderBy(F.col("k0").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.array([r["vector"] for r in first], dtype=np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)
    kind = next(k for k in ("<i2", "<i4") if facts["size"] < np.iinfo(np.dtype(k)).max)
    n = books.shape[1]
    schema = T.StructType([T.StructField("k0", fields["k0"]), T.StructField("k1", fields["k1"]), T.StructField("vector", T.BinaryType()), T.StructField("state", T.BinaryType()), T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("needed", T.ArrayType(T.LongType()))])
    final = T.StructType([T.StructField("k0", fields["k0"]), T.StructField("k1", fields["k1"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def step(work: _Round, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, needed = np.zeros((PARTS, n, width // PARTS + 1), dtype=np.int64), np.zeros(PARTS, dtype=np.int64)
            types = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                types = [c.type for c in batch.columns[:2]]
                raw = batch.column(2)
                if work.widths is None:
                    vectors, state = raw.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width), None
                else:
                    vectors, state = _matrix(raw).view(work.kind).reshape(batch.num_rows, width), _matrix(batch.column(3))
                bounds, error, s, used = work(vectors, state)
                if last:
                    code = np.stack([u.entry for u in bounds], axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([bytes(c).hex() for c in code]), pa.array(error)], names=final.names)
                    continue
                sums += s
                needed = np.maximum(needed, used)
                packed = _pack(vectors.astype(work.kind), bounds)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(_column, packed), pa.nulls(batch.num_rows, pa.list_(pa.int64())), pa.nulls(batch.num_rows, pa.list_(pa.int64()))], names=schema.names)
            if types and not last:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([needed.tolist()], pa.list_(pa.int64()))], names=schema.names)

        return run

    table, before, widths, wanted = start, None, None, [max(1, min(n // 4, n - 1)) if n > 1 else 0] * PARTS
    for turn in range(rounds + 1):
        last = turn == rounds
        work = _Round(books, before, widths, wanted, kind)
        rows = table.df if turn == 0 else table.df.filter("vector is not null").select("k0", "k1", "vector", "state")
        made = Table(rows.mapInArrow(step(work, last), final if last else schema), "codes" if last else "bounds")
        table.drop()
        table = made
        if last:
            break
        spoken = table.df.filter("sums is not null")
        added = spoken.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # entries x components
        sums = np.zeros(PARTS * n * (width // PARTS + 1), dtype=np.int64)
        for r in added:
            sums[r["at"]] = r["x"]
        sums = sums.reshape(PARTS, n, -1)
        count = sums[:, :, -1:]
        needed = {r["at"]: r["x"] for r in spoken.select(F.posexplode("needed").alias("at", "x")).groupBy("at").agg(F.max("x").alias("x")).collect()}
        before, books = books, np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
        # as many as were needed, an eighth of the entries at least; what a table has it can't have more of
        widths = wanted
        wanted = [min(w, max(needed.get(j, w), n // 8, 1)) if n > 1 else 0 for j, w in enumerate(widths)] if turn else widths
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = table.df
    by_label = codes.groupBy(F.col("k1").alias("l")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, codes["k1"].eqNullSafe(by_label["l"]), "left").select(*(F.col(k).alias(v) for k, v in names.items()), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
