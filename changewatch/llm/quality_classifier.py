"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: words, word
pairs (all immediate repetitions of a word share one), and character n-grams
of 3 to 5 that hold no white space but at their ends. The three kinds count
alike, whatever their numbers. A softmax over the mean gives the class. Both
layers are trained by stochastic gradient descent in numpy, on a bounded
sample of labelled documents.

As the mean and the output layer are linear, a trained model comes to one
number for each hash bucket, which is what scoring looks up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changewatch.llm.common import beside, by_bytes

KINDS = 3
#: Bytes of text whose features are held at a time.
BATCH_BYTES = 400_000


@dataclass(frozen=True)
class Params:
    """What training takes; ``per_class`` bounds the sample of labelled documents."""

    buckets: int = 1 << 16
    dimension: int = 8
    orders: tuple[int, ...] = (3, 4, 5)
    per_class: int = 1500
    epochs: int = 5
    rate: float = 0.5
    #: Zero vectors that join every mean, so that a few words decide little.
    pad: int = 10
    #: How much faster the vectors learn than the output: each has but a small part in a mean.
    inner: float = 20.0
    seed: int = 7


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(15))


def features(texts: list[str], params: Params) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, bucket of each occurrence, number of the text it is in) for each kind, of whole texts; kinds may come more than once."""
    arr = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (arr == 32) | ((arr >= 9) & (arr <= 13))
    arr = np.where(blank, np.uint32(32), arr)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    mask = np.uint32(params.buckets - 1)

    first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(first):
        # a word's hash is a sum over its characters, each mixed with its place
        inside = np.flatnonzero(~blank)
        lengths = np.diff(np.append(np.searchsorted(inside, first), len(inside)))
        place = np.arange(len(inside), dtype=np.uint32) - np.repeat(np.searchsorted(inside, first).astype(np.uint32), lengths)
        word = np.add.reduceat(_mixed(arr[inside] + place * np.uint32(0x9E3779B1)), np.searchsorted(inside, first), dtype=np.uint32)
        word = _mixed(word)
        yield 0, word & mask, doc[first]
        same = doc[first[1:]] == doc[first[:-1]]
        pair = np.where(word[1:] == word[:-1], np.uint32(1), _mixed(word[1:] * np.uint32(31) + word[:-1] + np.uint32(0x51ED270B)))
        yield 1, (pair & mask)[same], doc[first[1:]][same]
    h, top = arr.copy(), 1
    for n in params.orders:
        while top < n:
            h = h[: len(arr) - top] * np.uint32(0x01000193) + arr[top:]
            top += 1
        if len(h) < 1:
            break
        held = np.ones(len(h), dtype=bool)
        for i in range(1, n - 1):
            held &= ~blank[i : i + len(h)]
        yield 2, (_mixed(h + np.uint32(n)) & mask)[held], doc[: len(h)][held]


def vectors(texts: list[str], params: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights that sum to 1, less what padding takes) of each text; without features, both empty."""
    for text in texts:
        kinds: dict[int, list[np.ndarray]] = {}
        for kind, buckets, _ in features([text], params):
            if len(buckets):
                kinds.setdefault(kind, []).append(buckets)
        total = np.zeros(params.buckets, dtype=np.float32)
        for parts in kinds.values():
            b = np.concatenate(parts)
            total += np.bincount(b, minlength=params.buckets).astype(np.float32) / ((len(b) + params.pad) * len(kinds))
        ids = np.flatnonzero(total)
        yield ids.astype(np.uint32), total[ids]


@dataclass
class Model:
    """``value``: each bucket's part in the log odds of class 1; ``bias``: the rest."""

    value: np.ndarray
    bias: float
    params: Params

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1 for each whole text; without features, that of the bias alone."""
        sums, counts = np.zeros((KINDS, len(texts))), np.zeros((KINDS, len(texts)))
        for kind, buckets, doc in features(texts, self.params):
            if len(buckets):
                # texts come in order, so their occurrences are runs
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                sums[kind][doc[starts]] += np.add.reduceat(self.value[buckets], starts, dtype=np.float64)
                counts[kind][doc[starts]] += np.diff(np.append(starts, len(doc)))
        used = counts > 0
        means = np.where(used, sums / (counts + self.params.pad), 0).sum(axis=0) / np.maximum(used.sum(axis=0), 1)
        return 1 / (1 + np.exp(-np.clip(means + self.bias, -50, 50)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], params: Params) -> Model:
    """Train on (buckets, weights, label) by gradient descent, an example a step, the rate falling to 0."""
    rng = np.random.default_rng(params.seed)
    vec = rng.uniform(-1, 1, (params.buckets, params.dimension)).astype(np.float32) / params.dimension
    out, bias = np.zeros((params.dimension, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    if len({y for _, _, y in examples}) == 2:
        step, steps = 0, params.epochs * len(examples)
        for _ in range(params.epochs):
            for i in rng.permutation(len(examples)):
                ids, w, y = examples[i]
                rate = params.rate * (1 - step / steps)
                step += 1
                rows = vec[ids]
                mean = w @ rows
                z = mean @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = out @ p
                out -= rate * np.outer(mean, p)
                bias -= 0.1 * rate * p
                vec[ids] = rows - (rate * params.inner) * np.outer(w, back)
    elif examples:  # one class only
        bias[examples[0][2]] = 4
    return Model((vec @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), params)


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), *, label: str = "quality", text: str = "text", key: str = "doc_id") -> Model:
    """Fit on documents joined with 0/1 ``labels``: of each class at most ``params.per_class``, those whose key hashes lowest.

    Only the sampled documents' features reach the driver, at most 2 *
    ``per_class`` of at most 0.5 MB. Labels that are null or neither 0 nor 1
    are not used, nor are those of keys that no document has; null texts are
    empty. If a key comes more than once, each different text of it counts,
    within the same bound. With no labels every score is one half.
    """
    hashed = F.xxhash64(F.col("_key"), F.lit(params.seed))
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_key").isNotNull())

    def lowest(df: DataFrame, *ties: str) -> DataFrame:
        parts = [df.filter(F.col("_y") == y).orderBy(hashed, "_key", *ties).limit(params.per_class) for y in (0, 1)]
        return parts[0].union(parts[1])

    # bounded: 2 * per_class rows of two numbers
    chosen = lowest(known)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key")
    # rows that repeat are one, and others of the same key are within the bound too
    rows = lowest(rows.groupBy("_key", "_y", F.xxhash64("_text").alias("_th")).agg(F.first("_text").alias("_text")), "_th")

    def featurize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "_text", BATCH_BYTES):
            made = [(i.tobytes(), w.tobytes()) for i, w in vectors(texts, params)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_y"), pa.array([i for i, _ in made], pa.binary()), pa.array([w for _, w in made], pa.binary())], names=["_key", "_y", "ids", "weights"])

    schema = rows.select("_key", "_y").schema.add("ids", "binary").add("weights", "binary")
    got = rows.select("_key", "_y", "_text").mapInArrow(featurize, schema).toArrow().to_pydict()
    order = sorted(range(len(got["_key"])), key=lambda i: (got["_key"][i], got["ids"][i]))
    return fit([(np.frombuffer(got["ids"][i], np.uint32), np.frombuffer(got["weights"][i], np.float32), got["_y"][i]) for i in order], params)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` with score (0 to 1, higher: class 1 likelier) and predicted (1 if score >= threshold).

    Whole texts are scored, of any length; null is empty, and an empty text has
    the model's bias for its score. Every row, repeated ones too, gets its
    own; an empty table gives an empty result; other columns are not read
    unless kept. A kept column may have any name but score and predicted;
    ``likely`` keeps whole rows whatever their names.
    """
    rows = beside(docs, keep, text)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, len(keep), BATCH_BYTES):
            s = model.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def likely(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``: same columns and types, whatever their names."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, at, BATCH_BYTES):
            yield batch.filter(pa.array(model.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
