"""Byte-level BPE encoding by folds of ranked merges, and decoding.

A text is split by the tokenizer's pattern; every piece is encoded on its own. Distinct pieces are counted over all documents; the most
frequent ones (``DICTIONARY`` at most, with at most ``LONGEST`` bytes) are encoded once, by Spark's higher-order functions: the bytes of a
piece are an array, and a fold merges the leftmost pair of least rank until no pair has a rank. The ranks are a literal map, split by a
hash of the key into small maps so that a lookup does not scan. The encoded pieces are a table of bounded size that every task gets; what
it lacks is merged where it stands, by the same rule (:func:`merge`), so all pieces are encoded whatever their number and length, and
texts are never shuffled. Decoding joins the bytes of the ids from a literal array.

Bytes are written as strings of one character per byte (ISO 8859-1), because strings compare and hash fast.

Defined results: a null text counts as empty and has no ids; a piece that is itself in the vocabulary is one id; repeated rows and null ids
each get their own result; an empty table gives an empty result; other columns are not read. Letters and numbers are those that
the Java runtime's Unicode version knows.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugegrid.llm.common import saved

#: Encoded pieces that every task gets, at most, and the bytes of the longest.
DICTIONARY, LONGEST = 1 << 19, 48
#: Pieces whose ids are put together at once.
_PIECES = 200_000
#: Small maps that hold the ranks.
BUCKETS = 1 << 15


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line per token, base64 and rank."""
    with open(path, "rb") as lines:  # on the driver: the ranks travel inside the plan
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def java_pattern(pattern: str) -> str:
    """The pattern with the white space of Unicode, as Java writes it."""
    return pattern.replace("\\S", "\\P{IsWhite_Space}").replace("\\s", "\\p{IsWhite_Space}")


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def _bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode(), 42) % (1 << 64)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal array of maps; the optimizer reads the text once, while it plans."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        name = token.decode("latin-1")
        maps[_bucket(name) & (BUCKETS - 1)][name] = rank  # the low bits are those of the signed hash
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_merges(piece: Column, maps: Column) -> Column:
    """Ids of a piece (a string column): ranked merges over the array of its bytes."""
    def rank(token: Column) -> Column:
        return F.try_element_at(F.get(maps, F.xxhash64(token).bitwiseAND(BUCKETS - 1).cast("int")), token)

    def merge_once(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1), lambda left, i: rank(F.concat(left, F.get(parts, i + 1)))
        )

        def at_least(found: Column) -> Column:
            least = F.array_min(found)
            at = F.array_position(found, least).cast("int")
            joined = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
            rest = F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))
            return F.when(least.isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), at - 1), joined, rest))

        return _let(pairs, at_least)

    raw = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")

    def encoded(text: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))
        merged = _let(chars, lambda c: F.aggregate(F.slice(c, 2, F.size(c)), c, merge_once))
        return F.when(rank(text).isNotNull(), F.array(rank(text))).otherwise(F.transform(merged, rank))

    return _let(raw, encoded)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: pairs in a heap by rank and place, so that long pieces take n log n steps."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            found = ranks.get(piece[i:after[j]])
            if found is not None:
                heapq.heappush(heap, (found, i, after[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i:after[i]]] for i in range(n) if alive[i]]


def dictionary(words: DataFrame, maps: Column, most: int = DICTIONARY, longest: int = LONGEST) -> DataFrame:
    """(piece, ids) of the most frequent distinct pieces of a table (piece), ``most`` at most."""
    counted = saved(
        words.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.octet_length("piece") <= longest)
        .withColumn("size", F.floor(F.log2("n") * 8).cast("int"))
    )
    sizes = counted.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()  # 512 rows at most
    total, least = 0, 1 << 20
    for size, n in sizes:
        total += n
        if total > most:
            break
        least = size
    return counted.where(F.col("size") >= least).select("piece", fold_merges(F.col("piece"), maps).alias("ids"))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id", most: int = DICTIONARY) -> DataFrame:
    """(key, ids) of every row."""
    spark = docs.sparkSession
    split = docs.select(F.col(key).alias("key"), pieces(F.col(text), pattern).alias("pieces"))
    known = dictionary(split.select(F.explode("pieces").alias("piece")), rank_map(ranks), most).toArrow()  # at most ``most`` rows
    table = spark.sparkContext.broadcast((known.column("piece").combine_chunks(), known.column("ids").combine_chunks(), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists, ranks = table.value
        flat, ends = pc.list_flatten(lists).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        ends = ends - ends[0]
        kept: dict[str, list[int]] = {}
        for batch in batches:
            column = batch.column(1)
            words = pc.list_flatten(column).cast(pa.string()).dictionary_encode()
            at = pc.index_in(words.dictionary, value_set=names)
            lost = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
            if len(kept) > 50_000:
                kept.clear()
            own = []
            for word in words.dictionary.take(pa.array(lost)).to_pylist():
                ids = kept.get(word)
                if ids is None:
                    ids = kept[word] = merge(word.encode(), ranks)
                own.append(ids)
            at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(flat):
                at, starts, sizes = at, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            else:
                starts, sizes = ends[at].astype(np.int64), (ends[at + 1] - ends[at]).astype(np.int64)
            sizes[lost] = [len(ids) for ids in own]
            starts[lost] = len(flat) + np.cumsum(sizes[lost]) - sizes[lost]
            every = np.concatenate([flat, np.fromiter((i for ids in own for i in ids), np.int64)]).astype(np.int32)
            codes = words.indices.to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
            row = 0
            while row < len(column):  # some rows at a time: the ids of a batch are several times its pieces
                end = max(row + 1, int(np.searchsorted(upto, upto[row] + _PIECES, side="right")) - 1)
                some = codes[upto[row]:upto[end]]
                width = sizes[some]
                ends_of = np.concatenate([[0], np.cumsum(width)])
                ids = every[np.arange(ends_of[-1]) + np.repeat(starts[some] - ends_of[:-1], width)]
                offsets = pa.array(ends_of[upto[row:end + 1] - upto[row]].astype(np.int32))
                lists_of = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), lists_of], names=["key", "ids"])
                row = end

    return split.mapInArrow(run, f"key {split.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that the ids stand for, end to end."""
    table = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token.hex()
    names = F.split(F.lit(",".join(table)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(names, i)), ""))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row."""
    ids = encoded(docs, ranks, pattern, text, key)
    return ids.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )
