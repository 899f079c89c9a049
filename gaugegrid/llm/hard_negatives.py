"""Hard negatives by inner product, searched in R-trees that sort-tile-recursive packing builds.

An anchor's positives are the rows of its label with the highest scores (integer inner products). Of every positive, the hard negatives are the
highest-scoring rows of other labels whose score lies in a window of shares of the positive's.

* Packing in tiles. The rows of a label are cut into slabs by quantiles of the coordinate that varies most, every slab by quantiles of the next
  one; a tile that is still too full (equal vectors) is dealt by a hash. Inside its task a tile is packed the same way into leaves, and these into nodes.
* Boxes. The smallest and largest value of every coordinate in a node give an interval per coordinate for its product with the anchor's, and so
  bounds on all scores below it.
* Best first. A queue holds nodes by their upper bound; a node goes if no window of the anchor reaches into its bounds, or if it lies strictly below
  what the window's last row has so far (equal: if its ids are all larger).
* Tiles are visited the same way: first the tile with the best bound per block of boxes, then those that may still hold a better row.

Anchors and boxes meet in blocks of bounded size, and so do the anchors and rows of a visited tile; no task holds all of either.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; of rows that share an id, the one with the
smallest (label, vector) does; missing components of shorter vectors are zeros; equal scores go by id; a label of one row has no positives; an empty
table gives an empty result; other columns are not read. A score beyond 64 bits is an error.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugegrid.llm.common import saved

#: Rows of a tile (twice as many at most), a leaf and an upper node; anchors and boxes of a block.
TILE, LEAF, FAN, BLOCK = 2048, 32, 8, 1024
#: Quantiles that cut slabs and tiles.
QUANTILES = 128
#: Windows without an end.
FAR = 1 << 62


def items(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, q) of the rows that take part, one per id; q: whole numbers, the components times ``scale`` rounded down."""
    x = F.col(vector)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    some = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull()).where(good)
    first = some.select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).alias("label"), whole.alias("q")).alias("r"))
    return first.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.q")


def widest(rows: DataFrame, most: int = 2) -> list[int]:
    """The coordinates that vary most."""
    spread = rows.select(F.posexplode("q").alias("at", "x")).groupBy("at").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return [r["at"] for r in spread.orderBy(F.desc("v"), "at").limit(most).collect()]


def _cut(rows: DataFrame, by: list[str], at: int, pieces: Column, into: str) -> DataFrame:
    """``into``: the piece of a group by quantiles of a coordinate; ``pieces``: their number, from the group's size n."""
    x = F.coalesce(F.get("q", F.lit(at)), F.lit(0))
    steps = [k / QUANTILES for k in range(1, QUANTILES)]
    bounds = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(x, steps, 1000).alias("bounds"))
    bounds = bounds.select(*by, F.least(F.lit(QUANTILES), F.ceil(pieces)).alias("pieces"), "bounds")
    place = F.size(F.filter("bounds", lambda b: b < x))
    cut = F.when(F.col("pieces") > 1, F.floor(place * F.col("pieces") / QUANTILES)).otherwise(0).cast("int")
    return rows.join(bounds, by).withColumn(into, cut).drop("pieces", "bounds")


def tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(tile, label, id, q) of every item."""
    first, second = [*widest(rows), 0, 0][:2]
    cut = _cut(rows, ["label"], first, F.sqrt(F.col("n") / tile), "slab")
    cut = saved(_cut(cut, ["label", "slab"], second, F.col("n") / tile, "part"))
    full = cut.groupBy("label", "slab", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * tile)).alias("chunks"))
    dealt = cut.join(full, ["label", "slab", "part"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    return saved(dealt.select(F.concat_ws(".", "label", "slab", "part", "chunk").alias("tile"), "label", "id", "q"))


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, short ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(width, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two matrices of whole numbers, exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = width * max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) * max(abs(int(b.max(initial=0))), abs(int(b.min(initial=0))))
    if bound < 1 << 53:  # doubles hold every sum
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # an error if one does not fit


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of the rows of ``a`` with anything in the boxes."""
    width = min(a.shape[1], low.shape[1])  # components that one side lacks are zeros
    plus, minus = np.maximum(a[:, :width], 0), np.minimum(a[:, :width], 0)
    return products(plus, low) + products(minus, high), products(plus, high) + products(minus, low)


def str_order(v: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in the order of their leaves: slabs of the coordinate that varies most, inside slabs of the next one, and so on."""
    leaves = -(-len(v) // leaf)
    spread = v.astype(np.float64).var(axis=0)
    cut_by = np.argsort(-spread, kind="stable")[:max(1, int(np.log2(max(leaves, 1))))].tolist()  # two slabs or more of each

    def packed(rows: np.ndarray, left: list[int]) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or not left:
            return [rows]
        slab = leaf * -(-leaves // int(np.ceil(leaves ** (1 / len(left)))))
        rows = rows[np.argsort(v[rows, left[0]], kind="stable")]
        return [part for k in range(0, len(rows), slab) for part in packed(rows[k:k + slab], left[1:])]

    return np.concatenate([np.zeros(0, np.int64), *packed(np.arange(len(v)), cut_by)])


class Tree:
    """A packed R-tree: rows in the order of leaves, and per level the boxes and smallest ids of its nodes, leaves first."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = np.lexsort((ids,))
        order = order[str_order(v[order], leaf)]
        self.ids, self.v, self.leaf, self.fan, self.levels = ids[order], v[order], leaf, fan, []
        low = high = self.v
        least, width = self.ids, leaf
        while True:
            cuts = np.arange(0, len(least), width)
            low, high = np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0)
            least = np.minimum.reduceat(least, cuts)
            self.levels.append((low, high, least))
            if len(least) == 1:
                break
            width = fan

    def scores(self, anchors: np.ndarray, wants: list[list[tuple]], lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Scores of the rows, leaf by leaf, for the anchors that have a window reaching into the leaf's bounds; others stay 0."""
        out = np.zeros((len(anchors), len(self.ids)), np.int64)
        ends = np.array([[low if least is None else max(low, least), high] for windows in wants for low, high, least in windows], np.int64).reshape(-1, 2)
        starts = np.cumsum([0, *map(len, wants)])[:-1]
        some = np.flatnonzero(np.array(list(map(len, wants))) > 0)
        for leaf in range(lower.shape[1]):
            owner = np.repeat(np.arange(len(wants)), list(map(len, wants)))
            reach = (upper[owner, leaf] >= ends[:, 0]) & (lower[owner, leaf] <= ends[:, 1])
            asked = some[np.logical_or.reduceat(reach, starts[some])] if len(some) else some
            if len(asked):
                rows = slice(leaf * self.leaf, (leaf + 1) * self.leaf)
                out[asked, rows] = products(anchors[asked], self.v[rows])
        return out

    def search(self, anchors: np.ndarray, own: list[int], wants: list[list[tuple]], k: int) -> Iterator[tuple[int, int, int, int]]:
        """(anchor number, want number, id, score) of the first k rows of every want (low, high, least): least score and largest, and the score
        below which nothing is wanted, or None."""
        limits = [tuple(x.tolist() for x in bounds(anchors, low, high)) for low, high, _ in self.levels]
        least_ids = [least.tolist() for _, _, least in self.levels]
        scores = self.scores(anchors, wants, *map(np.array, limits[0]))
        top = len(self.levels) - 1
        for a, (me, windows) in enumerate(zip(own, wants)):
            best: list[list[tuple[int, int]]] = [[] for _ in windows]  # heaps of (score, -id), the last row on top
            queue = [(-limits[top][1][a][0], least_ids[top][0], top, 0)]
            while queue:
                upper, least, level, node = heapq.heappop(queue)
                lower = limits[level][0][a][node]
                open_ = [w for w, window in enumerate(windows) if self._may_hold(window, best[w], k, lower, -upper, least)]
                if not open_:
                    continue
                if level:
                    uppers, ids = limits[level - 1][1][a], least_ids[level - 1]
                    for child in range(node * self.fan, min((node + 1) * self.fan, len(ids))):
                        heapq.heappush(queue, (-uppers[child], ids[child], level - 1, child))
                    continue
                rows = slice(node * self.leaf, (node + 1) * self.leaf)
                order = np.lexsort((-self.ids[rows], scores[a, rows]))
                found, ids = scores[a, rows][order].tolist(), self.ids[rows][order].tolist()
                for w in open_:
                    low, high, enough = windows[w]
                    floor, heap = low if enough is None else max(low, enough), best[w]
                    for at in range(bisect_right(found, high) - 1, -1, -1):  # from the best row in the window down
                        row = (found[at], -ids[at])
                        if row[0] < floor or len(heap) == k and row <= heap[0]:
                            break
                        if ids[at] == me:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, row)
                        else:
                            heapq.heapreplace(heap, row)
            for w, found in enumerate(best):
                for score, minus in found:
                    yield a, w, -minus, score

    @staticmethod
    def _may_hold(window: tuple, best: list[tuple[int, int]], k: int, lower: int, upper: int, least: int) -> bool:
        low, high, enough = window
        if upper < low or lower > high:
            return False
        reach = min(upper, high)
        if enough is not None and reach < enough:
            return False
        return len(best) < k or (reach, -least) > best[0]


def boxes(tiled: DataFrame) -> DataFrame:
    """(tile, label, low, high) of every tile."""
    kind = tiled.schema["label"].dataType.simpleString()

    def run(part: pa.Table) -> pa.Table:
        v = _matrix(part.column("q"))
        ends = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (v.min(axis=0), v.max(axis=0))]
        return pa.table([part.column("tile").slice(0, 1), part.column("label").slice(0, 1), *ends], names=["tile", "label", "low", "high"])

    return tiled.groupBy("tile").applyInArrow(run, f"tile string, label {kind}, low array<long>, high array<long>")


_WANTS = "array<struct<pid:long,low:long,high:long,least:long>>"


def _windows(wants: list[dict], known: bool) -> list[tuple]:
    return [(w["low"], w["high"], w["least"] if known else None) for w in wants]


def visits(anchors: DataFrame, boxed: DataFrame, same: bool, first: bool) -> DataFrame:
    """(tile, ablock, id, q, wants): the tile of every block of boxes that an anchor sees first, or the others that may hold what it lacks.

    ``same``: tiles of the anchor's label, else all others.
    """
    blocks_a, blocks_b = (n // BLOCK + 1 for n in (anchors.count(), boxed.count()))
    a = anchors.withColumn("ablock", F.pmod(F.xxhash64("id"), F.lit(blocks_a)))
    a = a.withColumn("bblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_b - 1).cast("long"))))
    b = boxed.withColumn("bblock", F.pmod(F.xxhash64("tile"), F.lit(blocks_b)))
    b = b.withColumn("ablock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_a - 1).cast("long"))))

    def needed(windows: list[list[tuple]], lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        out = np.zeros(lower.shape, bool)
        for k, some in enumerate(windows):
            for low, high, least in some:
                floor = low if least is None else max(low, least)
                if floor <= high:
                    out[k] |= (upper[k] >= floor) & (lower[k] <= high)
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["ablock", "id", "q", "wants"])
        if not left.num_rows or not right.num_rows:
            return out.slice(0, 0).add_column(0, "tile", pa.array([], pa.string()))
        order = np.argsort(right.column("tile").to_numpy(), kind="stable")
        right = right.take(pa.array(order))
        lower, upper = bounds(_matrix(left.column("q")), _matrix(right.column("low")), _matrix(right.column("high")))
        of_label = np.equal.outer(np.array(left.column("label").to_pylist(), object), np.array(right.column("label").to_pylist(), object))
        fitting = of_label.astype(bool) == same
        wants = left.column("wants").to_pylist()
        ever = needed([_windows(w, False) for w in wants], lower, upper) & fitting
        seen = np.zeros(ever.shape, bool)
        best = np.where(ever, upper, np.iinfo(np.int64).min).argmax(axis=1)
        seen[np.arange(len(best)), best] = True
        seen &= ever
        now = seen if first else needed([_windows(w, True) for w in wants], lower, upper) & fitting & ~seen
        i, j = np.nonzero(now)
        return out.take(pa.array(i)).add_column(0, "tile", right.column("tile").take(pa.array(j)))

    schema = f"tile string, ablock long, id long, q array<long>, wants {_WANTS}"
    return a.groupBy("ablock", "bblock").cogroup(b.groupBy("ablock", "bblock")).applyInArrow(run, schema)


def searched(visited: DataFrame, tiled: DataFrame, k: int) -> DataFrame:
    """(id, pid, found, score): the first k rows of every visited tile, for every want."""
    needed = visited.select(F.col("tile").alias("at"), F.col("ablock").alias("block")).distinct()
    rows = tiled.join(needed, F.col("tile") == F.col("at")).select(F.col("at").alias("tile"), F.col("block").alias("ablock"), "id", "q")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            tree = Tree(right.column("id").to_numpy(), _matrix(right.column("q")))
            own, wants = left.column("id").to_pylist(), left.column("wants").to_pylist()
            hits = tree.search(_matrix(left.column("q")), own, [_windows(w, True) for w in wants], k)
            found = [(own[a], wants[a][w]["pid"], row, score) for a, w, row, score in hits]
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "pid", "found", "score"])

    keys = ["tile", "ablock"]
    return visited.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, "id long, pid long, found long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "pid").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_rows(anchors: DataFrame, wants: DataFrame, tiled: DataFrame, boxed: DataFrame, same: bool, k: int) -> DataFrame:
    """(id, pid, found, score, rank) of the first k rows of every want; ``anchors``: (id, label, q), ``wants``: (id, pid, low, high)."""
    def with_wants(wants: DataFrame) -> DataFrame:
        lists = wants.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pid", "low", "high", "least"))).alias("wants"))
        return saved(anchors.join(lists, "id"))

    early = saved(visits(with_wants(wants.withColumn("least", F.lit(None).cast("long"))), boxed, same, True))
    found = saved(_ranked(searched(early, tiled, k), k))
    least = found.where(F.col("rank") == k).select("id", "pid", F.col("score").alias("least"))
    late = saved(visits(with_wants(wants.join(least, ["id", "pid"], "left")), boxed, same, False))
    return saved(_ranked(found.drop("rank").unionByName(searched(late, tiled, k)), k))


def hard_negatives(
    rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256, tile: int = TILE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors``: condition on ``id`` and ``label``; a negative's score is ``low`` to ``high`` hundredths of the positive's.
    """
    whole = saved(items(rows, key, vector, label, scale))
    tiled = tiles(whole, tile)
    boxed = saved(boxes(tiled))
    asked = saved(whole.where(anchors))
    nearest = first_rows(
        asked, asked.select("id", F.col("id").alias("pid"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high")), tiled, boxed, True, positives
    ).select("id", F.col("found").alias("pid"), F.col("score").alias("positive_score"))
    share = F.col("positive_score").cast("decimal(38,0)")
    windows = nearest.select(
        "id", "pid", F.ceil(share * low / 100).cast("long").alias("low"), F.floor(share * high / 100).cast("long").alias("high")
    ).where("low <= high")
    hard = first_rows(asked, windows, tiled, boxed, False, negatives)
    return hard.join(nearest, ["id", "pid"]).select(
        F.col("id").alias("anchor_id"), F.col("pid").alias("positive_id"), "rank", F.col("found").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
