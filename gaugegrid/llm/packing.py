"""Best-fit packing of documents into sequences of several permitted lengths.

A document of n words is n units; one that is longer than the longest permitted length is cut into pieces of that length and a rest.
Pieces are dealt to groups of about ``GROUP_PIECES`` by a hash, and every group is packed on its own: longest piece first, into the open
sequence that it leaves with the least room (best fit). Where none has room, a new one is opened with the permitted length of the least
cost for the piece: the cost of the length, less what the room left over is worth at the rate of the cheapest length, weighed by the share
of later pieces that still fit it. In the end every sequence shrinks to the shortest permitted length that holds its contents.
The lengths are so chosen together with the packing; all words are placed and none is cut off.

Defined results: a null, empty or blank text has no units and gets one row without a sequence; pieces of equal length go by (id, start);
repeated rows are packed one by one; null ids come last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugegrid.llm.common import saved, words_of

#: Permitted lengths, and the cost of a sequence of each: its units and a fixed part.
LENGTHS, FIXED_COST = (256, 512, 1024, 2048), 32
#: Pieces in a group, on average.
GROUP_PIECES = 8192


def pieces(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_units, start, length) of every piece; documents without units have one piece of length 0."""
    longest = max(lengths)
    sized = docs.select(F.col(key).alias("key"), F.size(words_of(F.col(text))).cast("long").alias("n_units"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_units") - 1, F.lit(0)), F.lit(longest).cast("long"))
    return (
        sized.select("key", "n_units", F.explode(starts).alias("start"))
        .withColumn("length", F.least(F.lit(longest), F.col("n_units") - F.col("start")).cast("int"))
    )


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, fixed: int = FIXED_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset in it) of every piece and the length of every sequence; the sizes fall and are at most the longest length."""
    lengths = tuple(sorted(lengths))
    rate = min((n + fixed) / n for n in lengths)
    n_fitting = len(sizes) - np.searchsorted(-sizes, -np.arange(lengths[-1] + 1), side="left")  # pieces of at most so many units
    share = n_fitting / max(len(sizes), 1)
    rooms: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # sequences by the room they have
    present: list[int] = []  # rooms that some sequence has, ascending
    filled: list[int] = []
    opened: list[int] = []
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = bisect_left(present, size)
        if at < len(present):
            room = present[at]
            b = rooms[room].pop()
            if not rooms[room]:
                present.pop(at)
        else:
            b = len(filled)
            fits = lengths[bisect_left(lengths, size):]
            opened.append(min(fits, key=lambda n: (n + fixed - rate * (n - size) * share[n - size], n)))
            filled.append(0)
            room = opened[b]
        where[i], offset[i] = b, filled[b]
        filled[b] += size
        room -= size
        if room:
            if not rooms[room]:
                present.insert(bisect_left(present, room), room)
            rooms[room].append(b)
    shrunk = np.array([lengths[bisect_left(lengths, n)] for n in filled], dtype=np.int64)
    return where, offset, shrunk


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_units, start, length, sequence_group, sequence, capacity, filled, offset) of every piece.

    A sequence is named by its group and its number in the group; words ``start`` to ``start + length`` of the document stand in it from
    ``offset`` on. Pieces of length 0 have no sequence.
    """
    rows = saved(pieces(docs, lengths, text, key))
    groups = rows.where("length > 0").count() // GROUP_PIECES + 1
    dealt = rows.where("length > 0").withColumn("sequence_group", F.pmod(F.xxhash64("key", "start"), F.lit(groups)))

    def run(part: pa.Table) -> pa.Table:
        order = pc.sort_indices(part, sort_keys=[("length", "descending"), ("key", "ascending"), ("start", "ascending")])  # nulls last
        part = part.take(order).combine_chunks()
        sizes = part["length"].to_numpy()
        where, offset, shrunk = best_fit(sizes, lengths)
        filled = np.bincount(where, weights=sizes, minlength=len(shrunk)).astype(np.int64)
        for name, column in (("sequence", where), ("capacity", shrunk[where]), ("filled", filled[where]), ("offset", offset)):
            part = part.append_column(name, pa.array(column, pa.int64()))
        return part

    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, n_units long, start long, length int, sequence_group long, sequence long, capacity long, filled long, offset long"
    )
    packed = dealt.groupBy("sequence_group").applyInArrow(run, schema)
    return packed.unionByName(rows.where("length = 0"), allowMissingColumns=True).withColumnRenamed("key", key)
