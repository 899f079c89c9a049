"""Exact dedup of new rows against a history through a minimal perfect hash of its digests.

The distinct digests of the history are dealt to buckets of about ``BUCKET_KEYS`` by their first bytes. A bucket's minimal
perfect hash is hash-and-displace: the keys fall into small bins, and each bin has a pilot number with which all its keys go
to free slots; n keys take exactly the slots 0 to n - 1. A slot holds the full digest and the locator of the winner (id and
length of the original text). A key that is not in the history also lands in some slot, so a lookup counts only where the
digest stored there has the same bytes.

New rows are reduced to one row per digest before they are dealt, so a text with millions of copies is one lookup. Hits
challenge the winner in their slot; the others keep the winner of their own group.

Defined results: a null text counts as empty; empty texts are equal to each other and to texts of white space alone; of equal
lengths the smaller id stays, null after all numbers; rows repeated with one id count in the size of the group and carry the
same verdict; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugegrid.llm.common import bare, saved

#: Keys in a bucket, on average: a bucket is built and searched in one task.
BUCKET_KEYS = 2048
#: Keys in a bin, on average: larger bins need fewer pilots and more trials.
BIN_KEYS = 4
#: Stands for a null id inside the operator: after all others.
NO_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, points, digest) of every row: code points of the original text, SHA-256 of the text without white space."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(key), F.lit(NO_ID)).alias("key"), F.length(whole).cast("long").alias("points"),
        F.unhex(F.sha2(bare(whole), 256)).alias("digest"),
    )


def winners(rows: DataFrame) -> DataFrame:
    """(digest, points, key, n): per digest the longest text, then the smallest id."""
    best = F.max(F.struct("points", (-F.col("key")).alias("less")))
    return (
        rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        .select("digest", F.col("best.points").alias("points"), (-F.col("best.less")).alias("key"), "n")
    )


def _halves(digest: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(b"".join(digest), dtype=np.uint64).reshape(len(digest), -1)
    return words[:, 1], words[:, 2]


def _slots(second: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    mixed = (second ^ (pilot.astype(np.uint64) * _MIX)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def build(digest: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(pilot of every bin, slot of every key) of a minimal perfect hash over distinct digests."""
    n = len(digest)
    n_bins = n // BIN_KEYS + 1
    first, second = _halves(digest)
    bins = (first % np.uint64(n_bins)).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    starts = np.searchsorted(bins[order], np.arange(n_bins + 1))
    pilots, slots, free = np.zeros(n_bins, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    step = 64
    for b in np.argsort(-np.diff(starts), kind="stable"):
        keys = order[starts[b]:starts[b + 1]]
        if not len(keys):
            break
        at, width = 0, step
        while True:
            trial = np.arange(at, at + width)
            places = _slots(second[keys][None, :], trial[:, None], n)
            fits = free[places].all(axis=1)
            if len(keys) > 1:
                ordered = np.sort(places, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                hit = int(np.argmax(fits))
                pilots[b], slots[keys] = at + hit, places[hit]
                free[places[hit]] = False
                break
            at, width = at + width, min(4 * width, 1 << 16)
    return pilots, slots


def find(digest: pd.Series, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot of every digest; meaningful only where the slot holds the same digest."""
    first, second = _halves(digest)
    return _slots(second, pilots[(first % np.uint64(len(pilots))).astype(np.int64)], n)


def _hash_table(part: pd.DataFrame) -> pd.DataFrame:
    pilots, slots = build(part["digest"])
    table = part.iloc[np.argsort(slots)]
    return pd.DataFrame({
        "bucket": [part["bucket"].iloc[0]], "pilots": [pilots.tolist()], "digests": [b"".join(table["digest"])],
        "keys": [table["key"].tolist()], "points": [table["points"].tolist()], "n": [table["n"].tolist()],
    })


_TABLE = "bucket long, pilots array<long>, digests binary, keys array<long>, points array<long>, n array<long>"


def _lookup(slots: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """One row per distinct digest of the bucket: slots with their challengers, then the digests that no slot holds."""
    out = []
    batch = batch.assign(known=False)
    if len(slots):
        row = slots.iloc[0]
        width = len(row["digests"]) // len(row["points"])
        held = [row["digests"][i:i + width] for i in range(0, len(row["digests"]), width)]
        mine = pd.DataFrame({"digest": held, "points": row["points"], "key": row["keys"], "n": row["n"]})
        if len(batch):
            at = find(batch["digest"], np.asarray(row["pilots"]), len(held))
            batch["known"] = [held[i] == d for i, d in zip(at, batch["digest"])]
            hits = batch[batch["known"]]
            at = at[batch["known"].to_numpy()]
            longer = hits["points"].to_numpy() - mine["points"].to_numpy()[at]
            wins = (longer > 0) | ((longer == 0) & (hits["key"].to_numpy() < mine["key"].to_numpy()[at]))
            n = mine["n"].to_numpy().copy()
            n[at] += hits["n"].to_numpy()
            mine["n"] = n
            mine.loc[at[wins], ["points", "key"]] = hits.loc[wins, ["points", "key"]].to_numpy()
        out.append(mine.assign(known=True))
    out.append(batch[~batch["known"]])
    return pd.concat(out)[["digest", "key", "n", "known"]]


def hash_tables(history: DataFrame, n_buckets: int) -> DataFrame:
    """One row per bucket: pilots of the bins, and the slots in order (digests end to end, winners, group sizes)."""
    return history.withColumn("bucket", _bucket(n_buckets)).groupBy("bucket").applyInPandas(_hash_table, _TABLE)


def _bucket(n_buckets: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(n_buckets)).alias("bucket")


def verdicts(history: DataFrame, batch: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, known) of every distinct digest of two tables of :func:`winners`; ``known``: in the history."""
    n_buckets = max(history.count(), batch.count()) // BUCKET_KEYS + 1
    tables = hash_tables(history, n_buckets)
    dealt = batch.withColumn("bucket", _bucket(n_buckets))
    return (
        tables.groupBy("bucket").cogroup(dealt.groupBy("bucket"))
        .applyInPandas(_lookup, "digest binary, key long, n long, known boolean")
        .withColumnsRenamed({"key": "keep_id", "n": "group_size"})
    )


def exact_dedup(history: DataFrame, batch: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of both tables, the history being what was there before."""
    old, new = digests(history, text, key), digests(batch, text, key)
    rows = saved(old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False))))
    found = verdicts(saved(winners(rows.where("old"))), saved(winners(rows.where("not old"))))
    real = [F.nullif(F.col(c), F.lit(NO_ID)) for c in ("key", "keep_id")]
    return rows.join(found, "digest").select(
        real[0].alias(key), real[1].alias("keep_id"), "group_size", (F.col("key") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "known",
    )


def halves(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table as a history and a batch of new rows: the checksum of the id says which rows were there before."""
    older = F.coalesce(F.crc32(F.col(key).cast("string")) % 2 == 0, F.lit(True))
    return docs.where(older), docs.where(~older)


def distinct_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without repeats, all columns as they are; of rows with one id and equal texts one stays."""
    kept = exact_dedup(*halves(docs, key), text, key).where("kept")
    kept = kept.select(F.coalesce(key, F.lit(NO_ID)).alias("__id"), F.unhex("text_sha256").alias("__sha"))
    sha = F.unhex(F.sha2(bare(F.coalesce(F.col(text), F.lit(""))), 256))
    marked = docs.withColumns({"__id": F.coalesce(F.col(key), F.lit(NO_ID)), "__sha": sha})
    one = marked.join(kept, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"])  # stays in the partitions of the join
    return one.select(*docs.columns)
