"""Removal of lines that many documents share, over levelled sorted runs of line hashes, in DataFrame functions alone.

Documents come in batches. A batch's distinct (line hash, document) pairs are reduced to (h1, h2, n), n being the number of
documents with the line. A merge anti join with the runs leaves out hashes that a run already knows to be frequent; the others
are the batch's own run, a table sorted by hash and split by its range, at level 0. When a level holds ``FAN`` runs they are merged
into one run of the next level, so a hash is written again only as often as there are levels. The lines to drop are the hashes whose
counts over all runs reach the threshold. Hashes have 128 bits, so lines of a very large corpus do not meet by chance.

Only hashes are shuffled for the counts: a line in a third of all documents is one counted row per task. Texts move once, to
meet their own list of dropped hashes.

Defined results: a null or empty text is one empty line; a key of fewer code points than ``least_chars`` is never dropped; a
document whose lines are all dropped keeps the empty text; rows that repeat an id count as one document and each gets its own result;
null ids count as one document; an empty table gives an empty result. Other columns are not read by :func:`without_lines`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugegrid.llm.common import SPACE, ascii_lower, saved

#: Runs of one level that are merged into a run of the next.
FAN = 2
#: Batches a table is read as.
BATCHES = 4
#: Seed of the second half of a hash.
SECOND = 7919


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hash(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SECOND), key).alias("h2"))


def line_hashes(docs: DataFrame, text: str, key: str, least_chars: int, batches: int) -> DataFrame:
    """(batch, key, h1, h2): distinct line hashes of every document."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line_key))
    long_enough = F.filter(keys, lambda k: F.length(k) >= least_chars)
    return (
        docs.select(F.pmod(F.xxhash64(F.col(key)), F.lit(batches)).alias("batch"), F.col(key).alias("key"), F.explode(long_enough).alias("k"))
        .select("batch", "key", line_hash(F.col("k")).alias("h")).select("batch", "key", "h.h1", "h.h2")
    )


def sorted_run(counted: DataFrame) -> DataFrame:
    """A run: written once, split by ranges of the hash and sorted inside them."""
    return saved(counted.repartitionByRange("h1").sortWithinPartitions("h1", "h2"))


def merged(runs: list[DataFrame]) -> DataFrame:
    """The counts of several runs added up."""
    return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


class Levels:
    """Runs by level; ``add`` takes a batch, ``total`` gives all counts of hashes below the threshold and some above it."""

    def __init__(self, least_documents: int, fan: int = FAN):
        self.least, self.fan, self.levels = least_documents, fan, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Take a batch of distinct (key, h1, h2): what no run knows to be frequent becomes a run; full levels are merged."""
        new = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            new = new.join(run.where(F.col("n") >= self.least).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._put(sorted_run(new), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            self._put(sorted_run(merged(full)), level + 1)

    def total(self) -> DataFrame:
        return merged(self.runs())


def frequent_lines(pairs: DataFrame, batches: int, least_documents: int) -> DataFrame:
    """(h1, h2) of the lines in at least so many documents, batch by batch through the levels."""
    levels = Levels(least_documents)
    for b in range(batches):
        levels.add(pairs.where(F.col("batch") == b))
    return saved(levels.total().where(F.col("n") >= least_documents).select("h1", "h2"))


def without_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least_documents: int = 10, least_chars: int = 1, batches: int = BATCHES,
) -> DataFrame:
    """(key, text, n_lines, n_dropped): every document without the lines that at least ``least_documents`` documents have."""
    pairs = saved(line_hashes(docs, text, key, least_chars, batches).distinct())
    dropped = (
        pairs.join(frequent_lines(pairs, batches, least_documents), ["h1", "h2"], "left_semi")
        .groupBy("key").agg(F.collect_list(F.struct("h1", "h2")).alias("dropped"))
    )
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = texts.join(dropped.withColumnRenamed("key", "other"), F.col("key").eqNullSafe(F.col("other")), "left")
    both = both.select("key", F.split("text", "\n").alias("lines"), "dropped")

    def stays(line: Column) -> Column:
        k = F.transform(F.array(line_key(line)), lambda x: (F.length(x) < least_chars) | ~F.array_contains(F.col("dropped"), line_hash(x)))
        return F.get(k, F.lit(0))

    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter(F.col("lines"), stays))
    return both.select("key", "lines", kept.alias("kept")).select(
        F.col("key").alias(key), F.array_join("kept", "\n").alias(text), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )
