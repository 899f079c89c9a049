"""Runs of periodic words, found with longest-common-extension queries over a difference cover.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word extends and that is
at least ``max(least, times * q)`` words long.

* Harmonic grid. A run of period q has at least ``(times - 1) * q`` places i with equal words at i and i + q, so one of them is a multiple of
  that number. Only these places are looked at: n / q per period, n log n together.
* Extensions (:class:`Extensions`). How far do the words from i and from j on agree? Positions whose remainder mod 31 is in a difference cover
  (six of 31) are samples, and only the suffixes that begin there are sorted: by their blocks of 31 words, then by doubling. For every (i, j) a
  shift of less than 31 makes both samples, so a few words are compared and then a sparse table over the sorted samples answers. The same over
  the reversed words gives the extension to the left.
* Both extensions together are the run. Multiples of a period give the same stretch; the smallest period stays.

The documents of a task are laid end to end with a word of its own after each, some ``GROUP_WORDS`` words at a time, so short texts take no
call each; a longer text is one group. Pairs on the grid that do not agree on a few words to either side need no query.

Defined results: a null, empty or blank text has no words and no runs; repeated rows and null ids each get their own result; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A difference cover: every remainder mod PERIOD is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words that are searched at once, if no single text has more, and pairs on the grid that are looked at at once.
GROUP_WORDS, PAIRS = 1 << 18, 1 << 20


def shifts() -> np.ndarray:
    """shift[a, b]: the least d such that a + d and b + d are both in the cover, mod PERIOD."""
    member = np.isin(np.arange(PERIOD), COVER)
    table = np.full((PERIOD, PERIOD), -1, np.int64)
    a, b = np.meshgrid(np.arange(PERIOD), np.arange(PERIOD), indexing="ij")
    for d in range(PERIOD - 1, -1, -1):
        table[member[(a + d) % PERIOD] & member[(b + d) % PERIOD]] = d
    return table


def _numbered(rows: np.ndarray) -> np.ndarray:
    """Numbers of the rows of a matrix in their order: equal rows, equal numbers."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.concatenate([[False], (ordered[1:] != ordered[:-1]).any(axis=1)])
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(new)
    return out


class Extensions:
    """Longest common extensions to the right in an array of word numbers from 0; beyond its end stands nothing that equals anything."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.words = np.concatenate([words, np.arange(-1, -2 * PERIOD - 1, -1)]).astype(np.int64)  # ends that differ
        self.shift = shifts()
        at = np.flatnonzero(np.isin(np.arange(n + PERIOD) % PERIOD, COVER))
        at = self.samples = at[at < n] if n else at[:0]
        m = len(at)
        self.number = np.full(n + 2 * PERIOD, -1, np.int64)
        self.number[at] = np.arange(m)
        follower = np.where(at + PERIOD < n, self.number[np.minimum(at + PERIOD, n + PERIOD)], -1)  # also a sample
        # the order of the blocks by two halves at a time, then of ever more blocks
        rank = _numbered(np.stack([self.words[at + k] for k in range(PERIOD)], axis=1)) if m else np.zeros(0, np.int64)
        levels, jump = [rank], follower
        while m and rank.max() < m - 1:
            after = np.where(jump >= 0, rank[jump], -1)
            rank = _numbered(np.stack([rank, after], axis=1))
            levels.append(rank)
            jump = np.where(jump >= 0, jump[jump], -1)
        self.place, order = rank, np.argsort(rank, kind="stable")
        self.table = [self._neighbours(order, levels, follower)]
        while 1 << len(self.table) <= len(self.table[0]):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray], follower: np.ndarray) -> np.ndarray:
        """Words that samples next to each other in the order have in common."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        jumps = [follower]
        for _ in levels[1:]:
            last = jumps[-1]
            jumps.append(np.where(last >= 0, last[last], -1))
        for rank, jump, width in zip(levels[::-1], jumps[:len(levels)][::-1], [PERIOD << k for k in range(len(levels))][::-1]):
            same = (a >= 0) & (b >= 0)
            same[same] = rank[a[same]] == rank[b[same]]
            common[same] += width
            a[same], b[same] = jump[a[same]], jump[b[same]]
        left = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = self.samples[a[left]], self.samples[b[left]]
        return self._compared(x, y, np.full(len(left), PERIOD), common, left)

    def _compared(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, common: np.ndarray, into: np.ndarray) -> np.ndarray:
        """``common`` with the equal words from x and y on added at the places ``into``, ``most`` at most."""
        going = np.arange(len(x))
        for k in range(int(most.max(initial=0))):
            going = going[most[going] > k]
            going = going[self.words[x[going] + k] == self.words[y[going] + k]]
            if not len(going):
                break
            common[into[going]] += 1
        return common

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, i and j different and from 0 to n."""
        d = self.shift[i % PERIOD, j % PERIOD]
        common = self._compared(i, j, d, np.zeros(len(i), np.int64), np.arange(len(i)))
        inside = (common == d) & (i + d < self.n) & (j + d < self.n)
        at = np.flatnonzero(inside)
        a, b = self.place[self.number[i[at] + d[at]]], self.place[self.number[j[at] + d[at]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(at), np.int64)
        for k in np.unique(level):
            some = level == k
            found[some] = np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << k)])
        common[at] += found
        return common


def grid(words: np.ndarray, longest: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid whose words agree there, some at a time; ``longest``: words of the longest text."""
    n, period = len(words), 1
    while period * times <= longest:
        many = np.arange(period, min(longest // times, period + PAIRS) + 1)
        counts = np.maximum(0, -(-(n - many) // ((times - 1) * many)))
        many = many[:max(1, int(np.searchsorted(np.cumsum(counts), PAIRS, side="right")))]
        counts = counts[:len(many)]
        p = np.repeat(many, counts)
        k = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
        i = k * (times - 1) * p
        same = words[i] == words[i + p]
        yield i[same], p[same]
        period = int(many[-1]) + 1


def _agreeing(words: np.ndarray, i: np.ndarray, p: np.ndarray, few: int) -> np.ndarray:
    """The pairs that agree on ``few`` words from here on, or on as many that end here."""
    alive = []
    padded = np.concatenate([np.arange(-1, -few - 1, -1), words, np.arange(-few - 1, -2 * few - 1, -1)])
    for step in (1, -1):
        going = np.arange(len(i))
        for k in range(1, few):
            going = going[padded[i[going] + few + step * k] == padded[i[going] + p[going] + few + step * k]]
        alive.append(going)
    return np.union1d(*alive)


def find_runs(words: np.ndarray, longest: int, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of the runs, by start, then period. A word that occurs once may stand between texts."""
    need = min(max(least - p, (times - 1) * p) for p in range(1, least + 1))  # every run has so many equal pairs or more
    few = max(1, min(8, need // 2))
    i, p = [], []
    for some, periods in grid(words, longest, least, times):
        keep = _agreeing(words, some, periods, few)
        i.append(some[keep])
        p.append(periods[keep])
    i, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, p))
    if not len(i):
        return np.zeros((0, 3), np.int64)
    n = len(words)
    right, left = Extensions(words), Extensions(words[::-1])
    ahead = right(i, i + p)
    back = left(n - i, n - i - p)  # words before i and i + p
    equal = ahead + back
    keep = equal + p >= np.maximum(least, times * p)
    found = np.stack([i - back, equal + p, p], axis=1)[keep]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)]) if len(found) else np.zeros(0, bool)
    found = found[first]  # of equal stretches the smallest period
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _search(texts: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """The runs of every text, found in all of them laid end to end."""
    flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    numbers = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(sizes)
    laid = np.insert(numbers, ends, len(flat.dictionary) + np.arange(len(texts)))  # a word of its own after every text
    starts = ends - sizes + np.arange(len(texts))
    runs = find_runs(laid, int(sizes.max(initial=0)), least, times)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[cuts[k]:cuts[k + 1]] for k in range(len(texts))]


def _without(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that are in no run after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 24, times: int = 3) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: the runs by start and period, and the words that are in no run after its first period."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def result(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = _search(texts, least, times)
        runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in found], pa.list_(run_type))
        collapsed = pa.array([_without(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([keys, pa.array(map(len, texts), pa.int64()), runs, collapsed], names=["key", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            while row < len(batch):
                first, texts, size = row, [], 0
                while row < len(batch) and size < GROUP_WORDS:
                    texts.append((batch.column(1)[row].as_py() or "").encode().split())  # bytes: splits at 0x20 and 0x09-0x0D
                    size += len(texts[-1])
                    row += 1
                yield result(batch.column(0).slice(first, row - first), texts)

    schema = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, of equal ones that with the smallest start, then period; null where there is none."""
    def better(best: Column, run: Column) -> Column:
        gain = run["length"] * best["period"] - best["length"] * run["period"]
        earlier = F.struct(run["start"], run["period"]) < F.struct(best["start"], best["period"])
        return F.when((gain > 0) | ((gain == 0) & earlier), run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)
