"""Periodic runs of words, and texts with each run's repeats taken out.

A run is a maximal stretch of words of smallest period q (words q apart are
the same) that is at least twice as long as q. Runs are enumerated over a
harmonic grid: for each period q the anchors 0, q, 2q, ... are compared with
the words q further on, and the longest common extensions to the right and to
the left of an anchor say whether a run passes there. That is n log n anchors
for n words, nearly all of which differ at once.

An anchor is first compared word by word over as many words as a difference
cover needs to bring any two places to sampled ones. What still agrees is
answered by the sampled suffixes: only these are sorted, and the common
prefix of two is the least of the common prefixes between neighbours in their
order, read from a sparse table. Extensions to the left are found by bisection
over extensions to the right. Texts are handled in batches of a bounded number
of bytes, anchors in slices of a bounded number, and only texts in which an
anchor agrees for that long have their suffixes sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changewatch.llm.common import beside, by_bytes

#: Bytes of text, and anchors, that are handled at once.
BATCH_BYTES, SLICE = 1_000_000, 1 << 20
#: A perfect difference cover: of each distance modulo PERIOD there is a pair.
PERIOD, COVER = 13, (0, 1, 3, 9)
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])

_IN = np.isin(np.arange(PERIOD), COVER)
#: How far two places must move together until both are sampled, by their remainders.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN[(a + d) % PERIOD] and _IN[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


class Extensions:
    """Longest common extensions to the right between any two places of ``s``, whose last id occurs nowhere else."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        self.s = s = np.concatenate([s, s.max() + 1 + np.arange(2 * PERIOD)])
        places = np.flatnonzero(_IN[np.arange(n) % PERIOD])
        m = len(places)
        at = np.full(n + PERIOD, m, dtype=np.int64)  # the number of a sampled place; m beyond the end
        at[places] = np.arange(m)
        # names of the next PERIOD words, then of twice as many, until all differ
        rank, base = s[places], int(s.max()) + 1
        for k in range(1, PERIOD):
            rank = rank * base + s[places + k]
            if k == PERIOD - 1 or (int(rank.max()) + 1) * base >= 1 << 62:
                rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        levels, width = [rank], PERIOD
        while rank.max(initial=0) + 1 < m:
            after = np.append(rank, -1)[at[np.minimum(places + width, n)]] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1].astype(np.int64)
            levels.append(rank)
            width *= 2
        self.at, self.rank = at, rank
        order = np.empty(m, dtype=np.int64)
        order[rank] = np.arange(m)
        a, b = places[order[:-1]], places[order[1:]]
        least = np.zeros(max(m - 1, 0), dtype=np.int64)
        for names in reversed(levels[:-1]):
            width //= 2
            same = np.append(names, -1)[at[np.minimum(a + least, n)]] == np.append(names, -2)[at[np.minimum(b + least, n)]]
            least[same] += width
        going = np.ones(len(least), dtype=bool)
        for _ in range(PERIOD):
            going &= s[a + least] == s[b + least]
            least += going
        table = [least.astype(np.int32)]
        while 2 << len(table) - 1 <= len(least):
            half, last = 1 << len(table) - 1, table[-1]
            table.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[len(last) - half :]]))
        self.table = np.stack(table) if len(least) else np.zeros((1, 1), dtype=np.int32)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different places how many words agree from there on."""
        need = _SHIFT[i % PERIOD, j % PERIOD]
        out = np.zeros(len(i), dtype=np.int64)
        going = np.ones(len(i), dtype=bool)
        for t in range(int(need.max(initial=0))):
            going &= (t >= need) | (self.s[i + t] == self.s[j + t])
            out += going & (t < need)
        i, j = i[going], j[going]
        x, y = self.rank[self.at[i + need[going]]], self.rank[self.at[j + need[going]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out[going] += np.minimum(self.table[level, low], self.table[level, high - (1 << level)])
        return out


def _grid(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of the anchors, in slices: for every period up to half a text its multiples that have a word a period further on."""
    text = np.repeat(np.arange(len(lengths)), lengths // 2)
    period = np.arange(len(text)) - np.repeat(np.cumsum(lengths // 2) - lengths // 2, lengths // 2) + 1
    count = (lengths[text] - 1) // period
    upto = np.cumsum(count)
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE, side="right")))
        c = count[begin:end]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        q, t = np.repeat(period[begin:end], c), np.repeat(text[begin:end], c)
        yield t, q, starts[t] + k * q
        begin = end


def runs_of(words: list[np.ndarray], least: int) -> np.ndarray:
    """(text, start, length, period) of all runs of at least ``least`` words, by text, start and period; ``words`` has each text's words as numbers."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    top = max((int(w.max()) for w in words if len(w)), default=0) + 1
    s = np.empty(int(lengths.sum()) + len(words) + 1, dtype=np.int64)
    s[0] = top
    for k, (w, o) in enumerate(zip(words, starts.tolist(), strict=True)):
        s[o : o + len(w)] = w
        s[o + len(w)] = top + 1 + k  # no other place has this number, so no extension leaves a text
    found, extend = [np.empty((0, 4), dtype=np.int64)], None
    one = int((lengths // 2).sum()) == 0 or int(((lengths - 1).clip(0) * (np.log(lengths.clip(1)) + 1)).sum()) <= SLICE
    for t, q, p in _grid(starts, lengths):
        hit = s[p] == s[p + q]
        t, q, p = t[hit], q[hit], p[hit]
        right, left = np.ones(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
        going = np.ones(len(p), dtype=bool)
        for d in range(1, PERIOD):
            going[going] = s[p[going] + d] == s[p[going] + q[going] + d]
            right += going
        more = going
        going = np.ones(len(p), dtype=bool)
        for d in range(1, PERIOD):
            going[going] = s[p[going] - d] == s[p[going] + q[going] - d]
            left += going
        # an anchor with a whole period to its left is not a run's first; one that is done on both sides is long enough or not
        first = left < q
        far = first & (more | going)
        keep = first & ~far & (q + right + left >= np.maximum(least, 2 * q))
        found.append(np.stack([t[keep], p[keep] - left[keep], (q + right + left)[keep], q[keep]], axis=1))
        if far.any():
            t, q, p, right, left, more, back = (x[far] for x in (t, q, p, right, left, more, going))
            if extend is None:
                extend = _Texts(s, starts, lengths, np.unique(t) if one else np.arange(len(words)))
            # one that has a whole period to its left is not its run's first: most in texts of one long run
            at = np.flatnonzero(back & (p - q >= starts[t]))
            inner = np.zeros(len(p), dtype=bool)
            inner[at] = extend(t[at], p[at] - q[at], q[at]) >= q[at]
            t, q, p, right, left, more, back = (x[~inner] for x in (t, q, p, right, left, more, back))
            right[more] = extend(t[more], p[more], q[more])
            # to the left: as far as the extension to the right from there still reaches the anchor
            at = np.flatnonzero(back)
            low, high = left[at], np.minimum(q[at], p[at] - starts[t[at]])
            while (open_ := low < high).any():
                mid = (low + high + 1) // 2
                reach = np.zeros(len(at), dtype=bool)
                reach[open_] = extend(t[at][open_], (p[at] - mid)[open_], q[at][open_]) >= mid[open_]
                low, high = np.where(open_ & reach, mid, low), np.where(open_ & ~reach, mid - 1, high)
            left[at] = low
            keep = (left < q) & (q + right + left >= np.maximum(least, 2 * q))
            found.append(np.stack([t[keep], p[keep] - left[keep], (q + right + left)[keep], q[keep]], axis=1))
    runs = np.concatenate(found)
    runs[:, 1] -= starts[runs[:, 0]]
    # the same stretch at a multiple of its period is the same run
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.append(True, (np.diff(runs[:, :3], axis=0) != 0).any(axis=1))[: len(runs)]]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


class _Texts:
    """Extensions within some of a batch's texts."""

    def __init__(self, s: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray):
        self.moved = np.zeros(len(starts), dtype=np.int64)
        new = np.cumsum(lengths[chosen] + 1) - (lengths[chosen] + 1)
        self.moved[chosen] = new - starts[chosen]
        joined = np.concatenate([s[o : o + n + 1] for o, n in zip(starts[chosen].tolist(), lengths[chosen].tolist(), strict=True)])
        self.of = Extensions(np.unique(joined, return_inverse=True)[1].astype(np.int64))

    def __call__(self, t: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        i = p + self.moved[t]
        return self.of(i, i + q)


def find(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 12) -> DataFrame:
    """The columns ``keep``, then n_words, runs and collapsed, a row for each row of ``docs``.

    Words are what lies between blanks (U+0009 to U+000D and U+0020). runs: an
    array of (start, length, period) in words, by start and period, of all runs
    of at least ``least`` words. collapsed: the words, joined by one space,
    without those that any run holds after its first period. A null, empty or
    blank text has no words, no runs and collapses to ''. Rows that repeat are
    handled apart; other columns are not read. An empty table gives no rows.
    """
    rows = beside(docs, keep, text)
    kept = [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(docs.select(*(f"`{k}`" for k in keep)).schema)]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    arrow = pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, len(keep), BATCH_BYTES):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # of bytes: at 9 to 13 and 32 alone
            known: dict[bytes, int] = {}
            ids = [np.array([known.setdefault(w, len(known)) for w in ws], dtype=np.int64) for ws in words]
            found = runs_of(ids, least)
            ends = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
            collapsed = [b" ".join(ws) for ws in words]
            for k in np.unique(found[:, 0]).tolist():
                cover = np.zeros(len(words[k]) + 1, dtype=np.int64)
                _, start, length, period = found[ends[k] : ends[k + 1]].T
                np.add.at(cover, start + period, 1)
                np.add.at(cover, start + length, -1)
                collapsed[k] = b" ".join([words[k][i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in (1, 2, 3)], fields=list(arrow)))
            columns = [*batch.columns[: len(keep)], pa.array([len(w) for w in words], pa.int64()), runs, pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*keep, "n_words", "runs", "collapsed")
