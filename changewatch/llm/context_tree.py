"""Log probabilities of texts by context-tree weighting over bytes, and by counts of words beside it.

Each byte is eight binary decisions, one for every bit, and each decision has
a context tree of its own: a node for every string of up to ``depth``
preceding bytes, with the counts of both outcomes in the texts that are learnt
from. A node's Krichevsky-Trofimov estimate is weighted half and half against
the product of what its children come to, from the deepest contexts up to the
root, so all depths are mixed by how well they foretold the training texts.
Scoring freezes the tree: along a context's path from the deepest node up,
each node mixes its own estimate with the one below by those weights. A text
starts after a byte that no text has, and ends with it, so probabilities of
texts of all lengths add up to one.

The tree grows with the corpus and is never in one place. Texts are read once
and put into blocks of a bounded number of bytes; a block comes to its
different strings of depth + 1 bytes (*grams*) and its different words, with
counts. Grams are summed over all blocks and dealt out by the last two bytes of
their context, which makes whole subtrees; what these come to at depth two is
summed to the two levels above, at most 65,535 rows. Then each block
gets the probabilities of its own grams and the counts of its own words, and
its texts are scored with these alone. No join meets a text, and none of a
word's or gram's occurrences: only one row for each block that has it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch.llm.common import Table, by_bytes

#: Bytes of text in a block, and in what is handled at once within it.
BLOCK_BYTES, SLICE_BYTES = 32_000_000, 1_000_000
#: A byte that UTF-8 never has: before and after every text.
EDGE = 255
#: Subtrees are dealt out by so many bytes of context.
HEAD = 2
_LN10 = math.log(10)


# --- grams ---------------------------------------------------------------------------


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of every text and of its end, and how many each text has.

    A gram's high byte is the byte just before, then those further back, and
    its low byte is the byte itself, so contexts with the same end are
    neighbours in order.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    edge = bytes([EDGE]) * depth
    raw = edge + edge.join(texts) + bytes([EDGE]) + bytes(8)
    # eight bytes from each place on, the first lowest: the context's last byte is its highest, then comes the byte itself
    seen = np.ndarray(len(raw) - 8 - depth, dtype="<u8", buffer=raw, strides=(1,)).copy()
    key = seen & ((1 << (8 * depth)) - 1)
    key <<= 8
    seen >>= 8 * depth
    seen &= 255
    key |= seen
    key = key.view(np.int64)
    gaps = np.zeros(len(key) + 1, dtype=np.int8)  # the further bytes between two texts are no one's
    ends = np.cumsum(sizes + depth - 1)[:-1] - (depth - 1)
    np.add.at(gaps, ends, 1)
    np.add.at(gaps, ends + depth - 1, -1)
    return key[np.cumsum(gaps[:-1]) == 0] if depth > 1 else key, sizes


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


# --- the tree ------------------------------------------------------------------------

_SMALL = 1 << 12
_HALVES, _WHOLES = (np.array([math.lgamma(n + a) for n in range(_SMALL)]) for a in (0.5, 1.0))


def _lgamma(n: np.ndarray, add: float) -> np.ndarray:
    """log of gamma(n + add) for whole n, where add is 0.5 or 1."""
    x = np.maximum(n, _SMALL) + add
    long = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, (_HALVES if add == 0.5 else _WHOLES)[np.minimum(n, _SMALL - 1)], long)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return _lgamma(zeros, 0.5) + _lgamma(ones, 0.5) - math.log(math.pi) - _lgamma(zeros + ones, 1.0)


def _weighted(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) + math.log(0.5)


def _share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """How much of a node's prediction is its own estimate's."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def _mixed(own: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    share = _share(own, below)
    return share * (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1) + (1 - share) * deeper


_BITS = np.arange(8)


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int, upto: int = HEAD) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """What whole subtrees come to, from their grams in any order.

    Gives for each gram the probabilities of its eight bits as the nodes of
    depth ``upto`` mix them (grams x 8), and for each such node its code
    (context, then the bits before within the byte after a leading 1), zeros,
    ones and the log of its weighted probability.
    """
    byte = keys & 255
    bit = (byte[:, None] >> (7 - _BITS)) & 1
    code = (keys >> 8 << 8)[:, None] | (1 << _BITS) | (byte[:, None] >> (8 - _BITS))
    nodes, at = np.unique(code.ravel(), return_inverse=True)
    side = lambda which: np.bincount(at, weights=np.where(bit == which, counts[:, None], 0).ravel(), minlength=len(nodes)).astype(np.int64)
    zeros, ones = side(0), side(1)
    weighted = estimate(zeros, ones)
    at = at.reshape(code.shape)
    p = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
    for _ in range(depth, upto, -1):
        nodes, up = np.unique(nodes >> 16 << 8 | nodes & 255, return_inverse=True)
        total = lambda x: np.bincount(up, weights=x, minlength=len(nodes))  # noqa: B023, E731
        zeros, ones, below = total(zeros).astype(np.int64), total(ones).astype(np.int64), total(weighted)
        own = estimate(zeros, ones)
        at = up[at]
        p = _mixed(own[at], below[at], zeros[at], ones[at], bit, p)
        weighted = _weighted(own, below)
    return p, {"node": nodes, "zeros": zeros, "ones": ones, "weighted": weighted}


class Top:
    """The levels above the subtrees: depth 1 and the root."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """``node``: codes at depth 1; ``below``: the sums of what their children come to."""
        order = np.argsort(node)
        self.node, zeros, ones, below = (np.asarray(x)[order] for x in (node, zeros, ones, below))
        self.levels = [(estimate(zeros, ones), below, zeros, ones)]
        weighted = _weighted(self.levels[0][0], below)
        prefix = self.node & 255
        zeros, ones, below = (np.bincount(prefix, weights=x, minlength=256) for x in (zeros, ones, weighted))
        self.levels.append((estimate(zeros.astype(np.int64), ones.astype(np.int64)), below, zeros, ones))

    def log10(self, keys: np.ndarray, p: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the probability of each gram's byte, from its bits' probabilities at depth 2."""
        byte = keys & 255
        bit = (byte[:, None] >> (7 - _BITS)) & 1
        prefix = (1 << _BITS) | (byte[:, None] >> (8 - _BITS))
        at = np.searchsorted(self.node, (keys >> (8 * depth) << 8)[:, None] | prefix)
        for level, where in zip(self.levels, (at, prefix), strict=True):
            p = _mixed(*(x[where] for x in level), bit, p)
        return np.log10(p).sum(axis=1)


# --- Spark ---------------------------------------------------------------------------

_MODEL = T.StructType([T.StructField("gram", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("node", T.LongType()), T.StructField("zeros", T.LongType()), T.StructField("ones", T.LongType()), T.StructField("weighted", T.DoubleType())])


def _lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # of bytes: A to Z alone


def _blocks(rows: DataFrame, kept: list[T.StructField], depth: int, block_bytes: int) -> DataFrame:
    """Texts with their block and place in it, and of each block its grams and its words, with counts in texts to learn from.

    ``rows``: the kept columns, whether to learn from a row, and its text.
    Texts travel packed, some megabytes with their kept columns in a row. A
    block's id holds its partition, so a task that runs again makes the same.
    """
    types = {"block": pa.int64(), "place": pa.int64(), "packed": pa.binary(), "gram": pa.int64(), "word": pa.binary(), "n": pa.int64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, place = TaskContext.get().partitionId() << 32, 0, 0
        known = Numbers()
        tally, keys, counts = np.zeros(0, dtype=np.int64), [], []

        def batch_of(rows: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, t) for c, t in types.items()], names=list(types))

        def close() -> Iterator[pa.RecordBatch]:
            k, c = _summed(keys, counts)
            for i in range(0, len(k), 1 << 16):
                g = k[i : i + (1 << 16)]
                yield batch_of(len(g), block=pa.array(np.full(len(g), block)), gram=pa.array(g), n=pa.array(c[i : i + len(g)]))
            words = list(known)
            for i in range(0, len(words), 1 << 16):
                w = words[i : i + (1 << 16)]
                yield batch_of(len(w), block=pa.array(np.full(len(w), block)), place=pa.array(np.arange(i, i + len(w))), word=pa.array(w, pa.binary()), n=pa.array(tally[i : i + len(w)]))

        for batch, texts in by_bytes(batches, len(kept) + 1, SLICE_BYTES):
            learn = np.array([bool(x) for x in batch.column(len(kept)).to_pylist()])
            raw = [_lower(t) for t in texts]
            yield batch_of(1, block=pa.array([block]), place=pa.array([place]), packed=pa.array([_packed([*batch.columns[: len(kept)], pa.array(raw, pa.binary())])], pa.binary()))
            place += 1
            ids, sizes = _words(raw, known)
            tally = np.pad(tally, (0, len(known) - len(tally))) + np.bincount(ids[np.repeat(learn, sizes)], minlength=len(known))
            for part in _parts(raw):
                g, each = grams(raw[part], depth)
                learnt = np.repeat(learn[part], each)
                for k, c in (np.unique(g[learnt], return_counts=True), (k := np.unique(g[~learnt]), np.zeros(len(k)))):
                    keys.append(k)
                    counts.append(c)
            if len(keys) >= 16:
                k, c = _summed(keys, counts)
                keys, counts = [k], [c]
            size += sum(map(len, raw))
            if size >= block_bytes:
                yield from close()
                block, size, place, known, tally, keys, counts = block + 1, 0, 0, Numbers(), np.zeros(0, dtype=np.int64), [], []
        if place:
            yield from close()

    return rows.mapInArrow(run, "block long, place long, packed binary, gram long, word binary, n long")


def _packed(columns: list[pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


class Numbers(dict):
    """Words by the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _words(raw: list[bytes], known: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of the texts in turn, each text's followed by that of its end, the word ''; and how many each text has."""
    words = [t.split() for t in raw]
    for ws in words:
        ws.append(b"")
    sizes = np.array([len(ws) for ws in words], dtype=np.int64)
    return np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum())), sizes


class Found:
    """Places of keys in a sorted array of different ones: nearly all by a hash table, those that share a slot by bisection."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, 62 - max(len(keys), 1).bit_length()
        self.slots = np.zeros(1 << (64 - self.shift), dtype=np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return at


def _parts(raw: list[bytes]) -> Iterator[slice]:
    """The texts, cut into ranges of about SLICE_BYTES; one longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(raw):
        if total and total + len(t) > SLICE_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += len(t) + 1
    if start < len(raw):
        yield slice(start, len(raw))


def _model(totals: DataFrame, depth: int) -> DataFrame:
    """Of each gram its bits' probabilities at depth 2, and the nodes of depth 2, from grams that are dealt out by them and sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def made(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            p, nodes = subtrees(rows[0], rows[1], depth)
            bits = pa.array(list(map(bytes, p.astype("<f8").view("V64").ravel().tolist())), pa.binary())
            n, m = len(rows[0]), len(nodes["node"])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), bits, *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=_MODEL.names)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), *(pa.array(nodes[c]) for c in ("node", "zeros", "ones", "weighted"))], names=_MODEL.names)

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)]))
            size += batch.num_rows
            if size >= 1 << 17:
                rows = np.concatenate(held, axis=1)
                head = rows[0] >> (8 * (depth + 1 - HEAD))
                cut = int(np.searchsorted(head, head[-1]))  # the last subtree may go on
                if cut:
                    yield from made(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield from made(np.concatenate(held, axis=1))

    head = F.shiftright("gram", 8 * (depth + 1 - HEAD))
    return totals.repartition(head).sortWithinPartitions("gram").mapInArrow(run, _MODEL)


def _probabilities(model: DataFrame, depth: int) -> DataFrame:
    """(gram, value): log10 of the probability of the gram's byte after its context."""
    up = F.shiftright("node", 16) * 256 + F.col("node") % 256
    found = model.filter("node is not null").groupBy(up.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")).toArrow()  # at most 256 x 255 rows
    top = Top(*(found.column(c).to_numpy() for c in ("node", "zeros", "ones", "below")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).to_numpy()
                p = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f8").reshape(-1, 8)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(top.log10(keys, p, depth))], names=["gram", "value"])

    return model.filter("gram is not null").select("gram", "bits").mapInArrow(run, "gram long, value double")


def score(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), learn_from: Column | None = None, depth: int = 4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep``, then n_tokens, n_known, train_tokens, base_score, n_bytes, score and bits_per_byte, a row for each row of ``docs``.

    A-Z are lower-cased. score: log10 of the text's probability by trees of
    ``depth`` (2 to 6) bytes, its end included; bits_per_byte: the code length
    that comes to, for each byte and the end. base_score: the sum over its
    tokens (words between blanks, U+0009 to U+000D and U+0020, then one end) of
    log10((c + 0.1) / (N + 0.1 * (V + 1))), with c a token's count, N all tokens
    (train_tokens) and V the different ones in the rows that ``learn_from``
    holds for (null: not; None: all rows). n_known: tokens with c > 0.

    A null text is empty: an end alone. Repeated rows each count and are each
    scored. Where nothing may be learnt every decision is even. Other columns are
    not read; an empty table gives no rows. A block, or one longer text, is
    handled in the memory of a task; nothing else grows there with the corpus.
    """
    if not HEAD <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    kept = [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(docs.select(*(f"`{k}`" for k in keep)).schema)]
    learn = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    rows = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), learn.alias("learn"), F.col(f"`{text}`").alias("value"))
    blocks = Table(_blocks(rows, kept, depth, block_bytes), "blocks")

    asked = blocks.df.filter("gram is not null").select("block", "gram", "n")
    model = Table(_model(asked.groupBy("gram").agg(F.sum("n").alias("n")), depth), "tree")
    answers = asked.select("block", "gram").join(_probabilities(model.df, depth), "gram").select("block", F.col("gram").alias("key"), F.col("value").cast("double").alias("value"), F.lit(True).alias("is_gram"), F.lit(False).alias("first"))
    same = W.partitionBy("word")
    words = blocks.df.filter("word is not null").select("block", F.col("place").alias("key"), "word", "n")
    counted = words.select("block", "key", F.sum("n").over(same).cast("double").alias("value"), F.lit(False).alias("is_gram"), (F.row_number().over(same.orderBy("block")) == 1).alias("first"))
    replies = Table(answers.unionByName(counted), "replies")
    known = replies.df.filter("first and value > 0").agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("long").alias("tokens"), F.count(F.lit(1)).alias("kinds")).first()

    out = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*kept, *out])

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        is_gram = found.column("is_gram").to_numpy()
        key, value = (found.column(c).to_numpy() for c in ("key", "value"))
        order = np.argsort(key[is_gram])
        where, logs = Found(key[is_gram][order]), value[is_gram][order].astype(np.float64)
        count = np.zeros(int((~is_gram).sum()))
        count[key[~is_gram]] = value[~is_gram]
        known, whole = Numbers(), []
        for packed in texts.sort_by("place").column("packed"):
            batch = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            raw = batch.column(len(kept)).to_pylist()
            ids, sizes = _words(raw, known)
            c, starts = count[ids], np.cumsum(sizes) - sizes
            values = [sizes, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10(c + 0.1), starts)]
            parts = []
            for part in _parts(raw):
                g, each = grams(raw[part], depth)
                parts.append((each - 1, np.add.reduceat(logs[where(g)], np.cumsum(each) - each)))
            values += map(np.concatenate, zip(*parts, strict=True))
            whole.append(pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(pa.array, values)], names=schema.names))
        return pa.Table.from_batches(whole)

    texts = blocks.df.filter("packed is not null").select("block", "place", "packed")
    made = Table(texts.groupBy("block").cogroup(replies.df.drop("first").groupBy("block")).applyInArrow(scored, schema), "scores")
    for table in (blocks, model, replies):
        table.drop()
    whole = math.log10(known["tokens"] + 0.1 * (known["kinds"] + 1))
    return made.df.select(
        *(F.col(f.name).alias(k) for f, k in zip(kept, keep, strict=True)), "n_tokens", "n_known", F.lit(known["tokens"]).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "n_bytes", "score",
        (F.col("score") * F.lit(-_LN10 / math.log(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
