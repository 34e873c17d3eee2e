"""MinHash near-dedup by improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles.

1. Document frequencies of word shingles, over all documents, in a hashed
   table of fixed size (``buckets`` counts).
2. Each document's shingles get weights, and consistent weighted samples of
   them its signature. Documents of equal weighted shingles are one *node*.
3. Signatures are banded. In every bucket the nodes are compared with its most
   central one by the weighted Jaccard similarity of whole texts, and matches
   are contracted to connected components by alternating stars.
4. In buckets that still hold several components, the nodes outside the
   largest are compared with all of the bucket's nodes, in blocks, and what
   they link is contracted again. So no similar pair of a bucket is lost.

The weight of a shingle is its count times 1 + ``damping`` * idf / largest idf.
With the plain idf, a big family of near copies would weigh down the very
shingles its members share, and none would match another; damped, a member's
similarity falls by little, whatever the family's size.

Nothing but the table of counts (a fixed size) reaches the driver. Groups are
linked as stars, so a group of n costs about n links, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch.llm.common import Table, by_bytes

BATCH_BYTES = 2_000_000
_BLOCK = 4096
_LEVELS = 8
_TABLE = 4096


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    #: Counts in the table of document frequencies.
    buckets: int = 1 << 18
    damping: float = 0.2
    seed: int = 11

    @property
    def size(self) -> int:
        return self.bands * self.rows


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_P, _P_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _bytes_table() -> np.ndarray:
    return _mixed(np.arange(1, 257, dtype=np.uint64) * _P)


def shingles(text: str, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes in order, counts) of a text's word shingles; a text of 1 to words - 1 words has one; without words none.

    Words are runs of characters other than the space and U+0009 to U+000D.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_bytes_table()[raw] * power, out=sums[1:])
    word = _mixed((sums[ends] - sums[starts]) * inverse[starts])
    if len(word) < words:
        word = np.concatenate([word, np.full(words - len(word), len(word), np.uint64)])
    n = len(word) - words + 1
    h = word[:n].copy()
    for i in range(1, words):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += word[i : n + i]
    return np.unique(_mixed(h), return_counts=True)


@dataclass
class Weights:
    """Weights of shingles from the table of document frequencies; ``level``: 0 (in all documents) to 7 (rare) by bucket."""

    level: np.ndarray
    params: Params

    @classmethod
    def of(cls, counts: np.ndarray, documents: int, params: Params) -> Weights:
        idf = np.log((documents + 1) / (np.minimum(counts, documents) + 1))
        top = max(float(idf.max()), 1e-9)
        return cls(np.rint((_LEVELS - 1) * idf / top).astype(np.uint8), params)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        return self.level[hashes & np.uint64(self.params.buckets - 1)]

    def unit(self, levels: np.ndarray) -> np.ndarray:
        return 1 + self.params.damping * levels / (_LEVELS - 1)

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.unit(self.levels(hashes))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (hashes in order, weights); of two without shingles 1."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    both = a[1].sum() + b[1].sum() - low
    return float(low / both) if both else 1.0


class Sampler:
    """Consistent weighted samples.

    The random numbers of a shingle and a sample - r and c of a gamma
    distribution of shape 2, b uniform - are looked up by bits of a hash of
    both. A count up to ``_KEPT`` has one of few weights, so that r (t - b + 1)
    is looked up too; larger ones are worked out.
    """

    _KEPT = 32
    _CHUNK = 256

    def __init__(self, weights: Weights):
        p = self.params = weights.params
        self.weights = weights
        rng = np.random.default_rng(p.seed)
        self.r = rng.gamma(2.0, 1.0, _TABLE)
        self.beta = rng.uniform(0.0, 1.0, _TABLE)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
        self.a = rng.integers(1, 1 << 32, p.size, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, p.size, dtype=np.uint64).astype(np.uint32)
        unit = weights.unit(np.arange(_LEVELS))
        log_w = np.log(np.arange(1, self._KEPT + 1)[:, None] * unit[None, :]).reshape(-1, 1)
        self.part = self._part(log_w, np.arange(_TABLE)).astype(np.float32).ravel()

    def _part(self, log_w: np.ndarray, i: np.ndarray) -> np.ndarray:
        t = np.floor(log_w / self.r[i] + self.beta[i])
        return self.r[i] * (t - self.beta[i] + 1)

    def _hash(self, h: np.ndarray) -> np.ndarray:
        x = (h >> np.uint64(32)).astype(np.uint32)[:, None] * self.a
        x += h.astype(np.uint32)[:, None] ^ self.b
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        return x

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The key of each band (int64)."""
        p = self.params
        levels = self.weights.levels(hashes)
        best = np.full(p.size, np.inf, dtype=np.float32)
        winner = np.zeros(p.size, dtype=np.int64)
        columns = np.arange(p.size)
        offsets = ((np.minimum(counts, self._KEPT) - 1) * _LEVELS + levels).astype(np.uint32) * np.uint32(_TABLE)
        for s in range(0, len(hashes), self._CHUNK):
            x = self._hash(hashes[s : s + self._CHUNK])
            i = x >> np.uint32(20)
            value = self.log_c.take(x & np.uint32(_TABLE - 1))
            value -= self.part.take(i + offsets[s : s + self._CHUNK, None])
            if (big := np.flatnonzero(counts[s : s + self._CHUNK] > self._KEPT)).size:
                log_w = np.log(self.weights(hashes[s + big], counts[s + big]))[:, None]
                value[big] = self.log_c[x[big] & np.uint32(_TABLE - 1)] - self._part(log_w, i[big])
            k = value.argmin(axis=0)
            v = value[k, columns]
            better = v < best
            best[better] = v[better]
            winner[better] = k[better] + s
        h = hashes[winner]
        i = ((h >> np.uint64(32)).astype(np.uint32) * self.a + (h.astype(np.uint32) ^ self.b)).astype(np.uint32)
        i ^= i >> np.uint32(16)
        i *= np.uint32(0x7FEB352D)
        i ^= i >> np.uint32(15)
        i >>= np.uint32(20)
        t = np.floor(np.log(self.weights(h, counts[winner])) / self.r[i] + self.beta[i]).astype(np.int64).astype(np.uint64)
        sample = _mixed(h + t * _P).reshape(p.bands, p.rows)
        key = np.arange(1, p.bands + 1, dtype=np.uint64)
        for j in range(p.rows):
            key = _mixed(key * np.uint64(0xD6E8FEB86659FD93) + sample[:, j])
        return key.view(np.int64)


def document_frequencies(docs: DataFrame, params: Params) -> tuple[np.ndarray, int]:
    """(counts by bucket, documents) over all texts: a task adds up its own documents, and tasks' blocks are summed as they stream by, first those of 32 tasks, then the sums."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(params.buckets, np.int64), 0
        for batch, texts in by_bytes(batches, "text", BATCH_BYTES):
            n += len(texts)
            mine = [shingles(t, params.words)[0] for t in texts]
            total += np.bincount((np.concatenate(mine) & np.uint64(params.buckets - 1)).astype(np.int64), minlength=params.buckets)
        if n:
            yield out(total, n)

    def out(total: np.ndarray, n: int) -> pa.RecordBatch:
        blocks = range(0, params.buckets, _BLOCK)
        return pa.RecordBatch.from_arrays([pa.array([b // _BLOCK for b in blocks], pa.int32()), pa.array([total[b : b + _BLOCK].tobytes() for b in blocks], pa.binary()), pa.array([n] * len(blocks), pa.int64())], names=["block", "counts", "n"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        ns: dict[int, int] = {}
        for batch in batches:
            for b, c, n in zip(*(batch.column(x).to_pylist() for x in ("block", "counts", "n")), strict=True):
                part = np.frombuffer(c, np.int64)
                sums[b] = sums[b] + part if b in sums else part
                ns[b] = ns.get(b, 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()), pa.array(list(ns.values()), pa.int64())], names=["block", "counts", "n"])

    schema = "block int, counts binary, n long"
    parts = docs.select("text").mapInArrow(count, schema).withColumn("group", F.floor(F.spark_partition_id() / 32))
    sums = parts.repartition("block", "group").select("block", "counts", "n").mapInArrow(add, schema)
    got = sums.repartition("block").mapInArrow(add, schema).collect()  # buckets / 4096 rows of 32 KB
    total, n = np.zeros(params.buckets, np.int64), 0
    for r in got:
        total[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.int64)
        n = r["n"]
    return total, n


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, text_hash, node, keys): node is a digest of the weighted shingles, keys has the band keys (none without shingles)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = T.StructType([*rows.select("doc_id", "text_hash").schema.fields, T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        sampler = Sampler(weights)
        for batch, texts in by_bytes(batches, "text", BATCH_BYTES):
            nodes, keys = [], []
            for t in texts:
                h, c = shingles(t, weights.params.words)
                nodes.append(hashlib.blake2b(h.tobytes() + c.astype("<i8").tobytes(), digest_size=16).digest())
                keys.append(sampler(h, c) if len(h) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def verify(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """(a, b, matches) for pairs (a, b) of nodes, by the weighted Jaccard similarity of their whole texts (node, text)."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    words, least = weights.params.words, weights.params.similarity

    def vector(text: str):
        h, c = shingles(text, words)
        return h, weights(h, c)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch, left in by_bytes(batches, "text_a", BATCH_BYTES):
            right, out = [t or "" for t in batch.column("text_b").to_pylist()], []
            for a, b in zip(left, right, strict=True):
                if b != last:  # a leader's rows often follow each other
                    last, kept = b, vector(b)
                out.append(weighted_jaccard(vector(a), kept) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "matches"])

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, matches boolean")


def components(edges: DataFrame) -> Table:
    """(node, root) for every node of (a, b) edges: alternating large and small stars until nothing changes."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    def star(sym: DataFrame, small: bool) -> Table:
        # sym: (a, b); the least neighbour of a, or a itself. Written first: a join whose sides are shuffled and no more is one that Spark splits where a node has very many neighbours
        found = Table(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        least = found.df
        if small:
            down = sym.filter("b <= a")
            moved = down.join(least, "a")
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        else:
            out = sym.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = Table(out.filter("a <> b").distinct(), "edges")
        found.drop()
        return out

    def both(df: DataFrame) -> DataFrame:
        return df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    now = Table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = state(now.df)
    while seen[0]:
        large = star(both(now.df), False)
        now.drop()
        now = star(large.df.select("a", "b"), True)
        large.drop()
        if (new := state(now.df)) == seen:
            break
        seen = new
    out = Table(now.df.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
    now.drop()
    return out


#: A block of a bucket's nodes holds about so many at most, and so many characters.
BLOCK_NODES, BLOCK_CHARS = 1024, 16_000_000
_COLUMNS = 2048


def similar(left: list[str], right: list[str], weights: Weights) -> np.ndarray:
    """Which texts of ``left`` reach the similarity with which of ``right``, as a matrix of booleans.

    The n-th occurrence of a shingle is a column of its own, so that the common
    weight of two texts is a product of rows; columns are taken in bounded runs.
    """
    n, least = len(left), weights.params.similarity
    vectors = [shingles(t, weights.params.words) for t in (*left, *right)]
    row = np.repeat(np.arange(len(vectors)), [int(c.sum()) for _, c in vectors])
    counts = np.concatenate([c for _, c in vectors])
    hashes = np.concatenate([h for h, _ in vectors])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    unit = weights.unit(weights.levels(hashes)).repeat(counts)
    total = np.bincount(row, unit, len(vectors))
    _, column = np.unique(hashes.repeat(counts) + _mixed(nth.astype(np.uint64)), return_inverse=True)
    # only columns that both sides have count
    has = np.zeros((2, int(column.max(initial=-1)) + 1), dtype=bool)
    has[(row >= n).astype(np.int8), column] = True
    both = has.all(axis=0)
    keep = both[column]
    row, unit, column = row[keep], unit[keep], (np.cumsum(both) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, unit, column = row[order], unit[order], column[order]
    common = np.zeros((n, len(right)))
    for start in range(0, int(both.sum()), _COLUMNS):
        part = slice(*np.searchsorted(column, (start, start + _COLUMNS)))
        dense = np.zeros((len(vectors), _COLUMNS))
        dense[row[part], column[part] - start] = np.sqrt(unit[part])
        common += dense[:n] @ dense[n:].T
    value = common / np.maximum(total[:n, None] + total[None, n:] - common, 1e-300)
    out = value >= least
    for i, j in np.argwhere(np.abs(value - least) < 1e-9):  # by the one definition, whatever the order of sums
        (a, ca), (b, cb) = vectors[i], vectors[n + j]
        out[i, j] = weighted_jaccard((a, weights(a, ca)), (b, weights(b, cb))) >= least
    return out


def links(nodes: tuple[list, list], roots: tuple[list, list], texts: tuple[list[str], list[str]], weights: Weights) -> list[tuple[bytes, bytes]]:
    """Pairs (a, b) that link whatever roots are linked by similar texts of the two sides: one for each union."""
    label = {r: i for i, r in enumerate(dict.fromkeys((*roots[0], *roots[1])))}
    mine, theirs = (np.array([label[r] for r in side]) for side in roots)
    found = similar(*texts, weights)
    out = []
    for i in np.flatnonzero(found.any(axis=1)):
        for j in np.flatnonzero(found[i]):
            if (new := mine[i]) != (old := theirs[j]):
                out.append((nodes[0][i], nodes[1][j]))
                mine[mine == old] = new
                theirs[theirs == old] = new
    return out


def remaining(shared: DataFrame, roots: DataFrame, fetch, weights: Weights) -> Table:
    """(a, b) links between nodes of a bucket that are not of one component yet, from (key, node, n) rows and (node, root).

    In each bucket every node outside its largest component is compared with
    all nodes of the bucket. Both are cut into blocks, and two blocks meet in
    one group of bounded size; pairs never become rows.
    """
    rooted = shared.filter("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    crowd = Table(parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("crowd"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "crowd")
    open_ = Table(rooted.join(crowd.df, "key").select("key", "node", "root", (F.col("root") != F.col("crowd")).alias("outside")), "open")
    texts = Table(fetch(open_.df.select("node").distinct()).withColumn("chars", F.length("text")), "texts")

    def blocks(which) -> F.Column:
        return F.greatest(F.ceil(F.count_if(which) / BLOCK_NODES), F.ceil(F.sum(F.when(which, F.col("chars")).otherwise(0)) / BLOCK_CHARS), F.lit(1))

    sizes = Table(open_.df.join(texts.df.select("node", "chars"), "node").groupBy("key").agg(blocks(F.col("outside")).alias("outs"), blocks(~F.col("outside")).alias("ins")), "blocks")
    chance = F.xxhash64("node", F.lit(5))
    place = F.when(F.col("outside"), F.pmod(chance, "outs")).otherwise(F.col("outs") + F.pmod(chance, "ins")).alias("place")
    placed = open_.df.join(sizes.df, "key").select("key", "node", "root", "outside", "outs", "ins", place)
    # a block outside the crowd meets all blocks and itself; a block of the crowd meets those outside it
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("outs") + F.col("ins") - 1), lambda q: F.col("outside") | (q < F.col("outs")))
    cells = placed.select("key", "node", "root", "place", F.explode(met).alias("q")).select("key", F.least("place", "q").alias("i"), F.greatest("place", "q").alias("j"), "place", "node", "root")
    dealt = cells.join(texts.df.select("node", "text"), "node").select("key", "i", "j", "place", "node", "root", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            sides = [[r for r in rows if r[0] == p] for p in now[1:]]
            if all(sides):
                pairs = links(*(tuple([r[x] for r in side] for side in sides) for x in (1, 2, 3)), weights)
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], names=["a", "b"])

        now, rows = None, []
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("key", "i", "j", "place", "node", "root", "text")]
            for key, i, j, *row in zip(*columns, strict=True):
                if now != (key, i, j):
                    if rows:
                        yield from flush()
                    now, rows = (key, i, j), []
                rows.append(row)
        if rows:
            yield from flush()

    out = Table(dealt.mapInArrow(run, "a binary, b binary"), "links")
    for t in (crowd, open_, texts, sizes):
        t.drop()
    return out


def matches(members: DataFrame, fetch, weights: Weights) -> DataFrame:
    """(a, b) links of nodes found similar, from (key, node) rows of the bands; ``fetch`` gives (node, text) for nodes.

    Whatever two nodes share a bucket and are similar, the links connect them.
    Every node of a bucket meets its most central node first, whose buckets
    hold most: in a family of copies that is the text they were made from,
    which is nearer to each than they are to each other. What that leaves
    apart is compared in blocks.
    """
    # what is counted by bucket is written before it is joined, so that Spark may split the rows of a bucket that holds very many
    sizes = Table(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    shared = Table(members.join(sizes.df, "key"), "shared")
    sizes.drop()
    central = shared.df.groupBy("node").agg(F.sum("n").alias("central"))
    leaders = Table(shared.df.join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("central", "node")).alias("b")), "leaders")
    led = shared.df.select("key", F.col("node").alias("a")).join(leaders.df, "key").filter("a <> b")
    pairs = Table(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    texts = Table(fetch(pairs.df.select(F.col("a").alias("node")).unionByName(pairs.df.select(F.col("b").alias("node"))).distinct()), "texts")
    good = Table(verify(pairs.df, texts.df, weights).filter("matches").select("a", "b"), "good")
    leaders.drop()
    pairs.drop()
    texts.drop()
    roots = components(good.df)
    good.drop()
    more = remaining(shared.df, roots.df, fetch, weights)
    shared.drop()
    return roots.df.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.df)


def classes(docs: DataFrame, params: Params = Params(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, class_key, class_id (the least doc_id of its class) and class_size (its rows).

    Documents whose weighted Jaccard similarity reaches ``params.similarity``
    are of one class, and so are those linked by a chain of such. Documents
    without words (null, empty, blank) are copies of each other. Repeated rows
    and repeated ids are rows of their own; a class of null ids alone has the
    class id null. An empty table gives an empty result. Other columns are not
    read. Texts of any length are compared whole.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = Weights.of(*document_frequencies(rows, params), params)
    signed = Table(signatures(rows, weights), "signed").df
    node = Table(signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")), "nodes").df
    members = node.select(F.explode("keys").alias("key"), "node")

    def fetch(wanted: DataFrame) -> DataFrame:
        ids = node.join(wanted, "node", "left_semi").select("node", F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash"))
        hashed = rows.withColumn("text_hash", F.xxhash64("text"))
        return hashed.join(ids, hashed["doc_id"].eqNullSafe(ids["_id"]) & (hashed["text_hash"] == ids["_hash"])).select("node", "text").dropDuplicates(["node"])

    edges = Table(matches(members, fetch, weights), "matches")
    roots = components(edges.df)
    edges.drop()
    rooted = node.select("node", "least", "n").join(roots.df, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = Table(rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size")), "classes").df
    verdict = rooted.select("node", "root").join(of_root, "root").select("node", F.col("root").alias("class_key"), "class_id", "class_size")
    return signed.select("doc_id", "text_hash", "node").join(verdict, "node").select(F.col("doc_id").alias(doc_id), "text_hash", "class_key", "class_id", "class_size")


def deduplicate(docs: DataFrame, params: Params = Params(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class left: that of the least id, then the least hash of its text. Same columns and types."""
    found = classes(docs, params, text=text, doc_id=doc_id)
    first = found.groupBy("class_key").agg(F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("id"), "text_hash")).alias("one"))
    kept = Table(first.select(F.col("one.id").alias("_id"), F.col("one.text_hash").alias("_hash")), "kept").df
    # rows whole in one column: theirs may have any names
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_hash"))
    left = packed.join(kept, packed["id"].eqNullSafe(kept["_id"]) & (packed["text_hash"] == kept["_hash"]), "left_semi")
    return left.dropDuplicates(["id", "text_hash"]).select("row.*")
