"""Resharding with the fewest moved bytes, by a minimum-cost flow from old shards to new capacities.

Old shard sizes and new capacities (in bytes) are the two sides of a small graph; a byte that stays in its shard costs nothing, one that
moves costs one unit. The flow (:func:`min_cost_flow`) says how many bytes go from each old to each new shard. Inside an old shard the
documents are put in a fixed order and their sizes added up; the flow cuts that order into intervals, the interval that stays first, and a
document goes where its middle lies. So only what has to move is moved, and only files with moved documents are written anew
(:func:`rewrite`).

The running totals are built in two steps, over blocks of about ``BLOCK_ROWS`` documents and inside each block, so a shard with a
third of all rows is many tasks. Only the shard sizes reach the driver. A first pass over sizes and hashes alone gives what every block of an
old shard begins with (:func:`plan_moves`); with that, whole documents are shuffled once, to their blocks, and written from there (:func:`place`).

Defined results: the size of a document is the UTF-8 bytes of its text (none for null) plus one; ties in the order are broken by id, then
by text; repeated rows are placed one by one; null ids have their own place in the order; an empty table gives an empty result; other
columns are carried in a struct and have no meaning here, so their names may be any.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugegrid.llm.common import delete_folder, discard, saved

#: Documents in a block, on average.
BLOCK_ROWS = 4096


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts from each source to each sink that ship all supplies within the capacities at the least cost.

    Successive shortest paths over residual amounts, with potentials that keep the reduced costs from falling below zero.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold all bytes")
    flow = [[0] * m for _ in range(n)]
    left, room, potential = list(supply), list(capacity), [0] * (n + m)
    while any(left):
        dist, via = [float("inf")] * (n + m), [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            dist[i] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                steps = ((n + j, cost[u][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                new = d + c + potential[u] - potential[v]
                if new < dist[v]:
                    dist[v], via[v] = new, u
                    heapq.heappush(heap, (new, v))
        far = max(d for d in dist if d < float("inf"))
        for v in range(n + m):
            potential[v] += dist[v] if dist[v] < float("inf") else far
        end = min((v for v in range(n, n + m) if room[v - n]), key=lambda v: (potential[v], v))
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for a, b in zip(path, path[1:]):
            if a >= n:  # an amount that is taken back
                amount = min(amount, flow[b][a - n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def transfers(sizes: dict[str, int], home: dict[str, int | None], capacity: list[int]) -> list[tuple[str, int, int, int]]:
    """(old shard, new shard, first byte, end) of the intervals into which the flow cuts the old shards, what stays first."""
    names = sorted(sizes)
    cost = [[0 if home.get(name) == j else 1 for j in range(len(capacity))] for name in names]
    flow = min_cost_flow([sizes[name] for name in names], capacity, cost)
    out = []
    for name, row in zip(names, flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (home.get(name) != j, j)):
            if row[j]:
                out.append((name, j, at, at + row[j]))
                at += row[j]
    return out


def sized(docs: DataFrame, old: Column, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """(key, size, text_crc32, old, order, digest) of every document; ``old`` names its old shard. ``carry`` adds the whole row as ``doc``."""
    doc = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")] if carry else []
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.coalesce(old.cast("string"), F.lit("")).alias("old"), F.xxhash64(F.col(key), whole).alias("order"), F.xxhash64(whole).alias("digest"),
        *doc,
    )


@dataclass(frozen=True)
class Moves:
    """What places a document: ``cuts`` (old, shard, first, end) in bytes, per block of an old shard the bytes ``before`` it, and its first slot in a shard.

    ``counts`` holds (old, shard, n) on the driver: pairs of shards.
    """

    blocks: int
    cuts: DataFrame
    before: DataFrame
    slots: DataFrame
    counts: list[tuple[str, int, int]]

    def changed(self, home: dict[str, int | None]) -> list[int]:
        """The shards that a document left or came to."""
        moved = [(home.get(old), shard) for old, shard, _ in self.counts if home.get(old) != shard]
        return sorted({s for pair in moved for s in pair} - {None})

    def filled(self) -> set[int]:
        return {shard for _, shard, _ in self.counts}


_ORDER = ("order", "key", "digest")


def _in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.shiftright("order", 8), F.lit(blocks)))


def _in_shards(rows: DataFrame, cuts: DataFrame, before: DataFrame) -> DataFrame:
    """``rows`` with the new shard: that of the interval in which the middle of the document lies."""
    inside = Window.partitionBy("old", "block").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["old", "block"])
    middle = F.col("begin") + F.col("before") + F.floor(F.col("size") / 2)
    cut = summed.withColumn("middle", middle).join(F.broadcast(cuts), "old")  # a row per pair of old and new shard
    return cut.where((F.col("middle") >= F.col("first")) & (F.col("middle") < F.col("end"))).drop("begin", "before", "middle", "first", "end")


def _earlier(group: list[str], order: list[str], amount: str) -> Column:
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(window), F.lit(0))


def plan_moves(
    docs: DataFrame, old: Column, home: dict[str, int | None], shards: int = 8, text: str = "text", key: str = "doc_id", capacity: list[int] | None = None,
) -> Moves:
    """The moves that bring the documents into ``shards`` shards; ``home``: the new shard that is the same place as an old one.

    Old shards without a home lie elsewhere: all their bytes move. ``capacity`` defaults to equal bytes.
    """
    slim = saved(sized(docs, old, text, key).select("old", "size", *_ORDER))
    totals = slim.groupBy("old").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # a row per old shard
    sizes = {r["old"]: r["bytes"] for r in totals}
    blocks = max(1, sum(r["n"] for r in totals) // BLOCK_ROWS + 1)
    cuts = transfers(sizes, home, capacity or equal_capacities(sum(sizes.values()), shards))
    plan = docs.sparkSession.createDataFrame(cuts, "old string, shard int, first long, end long")
    slim = _in_blocks(slim, blocks)
    held = slim.groupBy("old", "block").agg(F.sum("size").alias("held"))
    before = saved(held.select("old", "block", _earlier(["old"], ["block"], "held").alias("before")))
    counted = saved(_in_shards(slim, plan, before).groupBy("old", "block", "shard").agg(F.count(F.lit(1)).alias("n")))
    slots = saved(counted.select("old", "block", "shard", _earlier(["shard"], ["old", "block"], "n").alias("first_slot")))
    counts = [tuple(r) for r in counted.groupBy("old", "shard").agg(F.sum("n")).collect()]
    discard(slim, counted)
    return Moves(blocks, plan, before, slots, counts)


def place(docs: DataFrame, old: Column, moves: Moves, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """(key, size, text_crc32, old, shard, slot) of every document; ``carry`` adds the whole row as the struct ``doc``, for :func:`rewrite_shards`.

    One shuffle of the rows, to the blocks of their old shards.
    """
    rows = _in_shards(_in_blocks(sized(docs, old, text, key, carry), moves.blocks), moves.cuts, moves.before)
    inside = Window.partitionBy("old", "block", "shard").orderBy(*_ORDER)
    numbered = rows.withColumn("nth", F.row_number().over(inside)).join(moves.slots, ["old", "block", "shard"])
    slot = (F.col("first_slot") + F.col("nth") - 1).alias("slot")
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "old", "shard", slot, *(["doc"] if carry else []))


def assign(
    docs: DataFrame, old: Column, home: dict[str, int | None], shards: int = 8, text: str = "text", key: str = "doc_id",
    capacity: list[int] | None = None, carry: bool = False,
) -> DataFrame:
    """:func:`place` with the moves of :func:`plan_moves`."""
    return place(docs, old, plan_moves(docs, old, home, shards, text, key, capacity), text, key, carry)


def changed_shards(placed: DataFrame, home: dict[str, int | None]) -> list[int]:
    """The shards that a document left or came to."""
    pairs = placed.select("old", "shard").distinct().collect()  # pairs of shards, not rows
    return Moves(0, None, None, None, [(r["old"], r["shard"], 0) for r in pairs]).changed(home)


def rewrite_shards(placed: DataFrame, changed: list[int], path: str, filled: set[int] | None = None) -> None:
    """Write the ``changed`` shards to ``path`` (a folder ``shard=k`` each), every file in the order of the slots; other folders stay as they are.

    ``placed`` is a result of :func:`place` with ``carry``: its rows are written from where they are, the document in the struct ``doc``. A changed
    shard that all documents left (not in ``filled``) becomes empty.
    """
    rows = placed.where(F.col("shard").isin(changed))
    if filled is None:
        filled = {r[0] for r in rows.select("shard").distinct().collect()}
    sorted_rows = rows.sortWithinPartitions("shard", "slot")
    sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for k in set(changed) - filled:
        delete_folder(placed.sparkSession, f"{path}/shard={k}")


def rewrite(placed: DataFrame, docs: DataFrame, old: Column, home: dict[str, int | None], path: str, key: str = "doc_id", text: str = "text") -> list[str]:
    """Write the shards that changed to ``path`` and return their names; the others stay as they are, also if they lie in ``path``.

    A shard changed if a document left it or came to it. ``placed`` is the result of :func:`assign`. Without its column ``doc`` the rows of the
    documents are found by their id, size, checksum and old shard, equal ones by their number among these. Columns of the documents named
    ``shard`` or ``slot`` are written as ``doc_shard`` and ``doc_slot``.
    """
    changed = changed_shards(placed, home)
    if not changed:
        return []
    if "doc" not in placed.columns or placed.schema["doc"].dataType != docs.schema:
        same = [F.col(c) for c in ("key", "size", "text_crc32", "old")]
        rows = sized(docs, old, text, key, True).withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("digest")))
        places = placed.withColumnRenamed(key, "key").withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("shard", "slot")))
        on = None
        for c in ("key", "size", "text_crc32", "old", "nth"):
            on = rows[c].eqNullSafe(places[c]) if on is None else on & rows[c].eqNullSafe(places[c])
        placed = saved(places.join(rows, on).select(places["shard"], places["slot"], rows["doc"]))
    names = {c: f"doc_{c}" if c.lower() in ("shard", "slot") else c for c in docs.columns}
    flat = placed.select("shard", "slot", *[F.col("doc").getField(c).alias(n) for c, n in names.items()])
    rewrite_shards(flat, changed, path)
    return [f"shard={k}" for k in changed]
