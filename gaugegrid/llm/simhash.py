"""SimHash near-dedup by the general pigeonhole principle.

A fingerprint has 64 bits: bit i is the majority of bit i over the hashes of the document's word shingles. Two fingerprints are linked
if at most ``distance`` bits differ. The bits are grouped into parts, and part p gets a threshold t_p of its own (-1: the part is not used)
with sum(t_p + 1) = distance + 1; linked fingerprints then differ in at most t_p bits of some part p. So one side is indexed under its
value of each part, the other probes all values within t_p bits, and what meets is verified on all 64 bits.

* Bits that vary together go into one part (:func:`group_bits`, from the bit counts of all fingerprints), so that the parts differ in
  how well they separate and the thresholds can follow.
* The number of candidates of every part is estimated from all fingerprints: pairs with equal values are counted exactly, and wider
  thresholds are scaled by the odds of so many differing bits. Dynamic programming picks thresholds of least total cost, for every number
  of parts; the cheapest number is taken.

Without a ``similarity``, rows with equal fingerprints are one node. Before the search every fingerprint is linked to the most frequent one of its bucket if they are
close enough, and the search leaves out pairs that are connected already: a large group of near copies is mostly a star and not
the square of its size. A pair that meets in several parts or by several flips of the same bits is kept once (:func:`meeting_part`,
:func:`one_way`). Components come from :mod:`components`.

With a ``similarity``, a node is a shingle set, its fingerprint counts every shingle once, and every link, also one between equal
fingerprints, needs that Jaccard similarity s of both sets. Wide distances, which similar texts need, bring many pairs that are not similar; three conditions that
every similar pair meets keep them out of the search and of the rows that its joins make:

* shingles of no other node are counted (:func:`own_shingles`, among every ``OWN_ONE_OF``-th, so the count is a lower bound); a set with more than (1 - s) of them has no partner and is not searched;
* two sets have at least s / (1 + s) of their sizes in common, so neither may lack more than that by its own shingles;
* the sets differ in at most (1 - s) / (1 + s) of their sizes, and so do their parity maps (``MAP_BITS`` bits, each the parity of the shingles that hash to it).

What is left is compared on all hashes. No similar pair within the distance is lost.

Defined results: a text without words (null, empty, blank) has fingerprint 0, linked like any other; a text of fewer words than a
shingle is one shingle; an exact half of set bits gives 0; repeated rows are one node; a null id counts after all others; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugegrid.llm.common import discard, keep_rows, saved
from gaugegrid.llm.components import components

BITS = 64
#: Numbers of parts that are compared.
PARTS = (2, 3, 4, 5)
#: Cost of a row that is dealt to a bucket, in units of one verified candidate.
ROW_COST = 8.0
#: Differing bits of 95 % of the texts that are similar to four fifths; such links are checked against the shingles.
WIDE_DISTANCE = 14
#: Turns in which every fingerprint is compared with one head of its buckets, before the search for what is left.
STAR_ROUNDS = 3
#: Bits of a parity map, and its columns.
MAP_BITS = 1024
MAP = [f"m{k}" for k in range(MAP_BITS // 64)]
#: Own shingles are counted among every second one, which halves what that count shuffles: a lower bound, and a text of its own has 0.5 of its size.
OWN_ONE_OF = 2
#: Hashes turned into bits at once.
_BLOCK = 1 << 14


def _hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, block by block; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at 0x20 and 0x09-0x0D
    if len(words) < shingle:
        words = [b" ".join(words)] if words else []
        shingle = 1
    for start in range(0, len(words) - shingle + 1, _BLOCK):
        part = words[start:start + _BLOCK + shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        yield np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=">u8")


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """The fingerprint of one text as an unsigned number."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _hashes(text, shingle, seed):
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def shingle_set(text: str | None, shingle: int, seed: int) -> tuple[int, int, np.ndarray]:
    """The fingerprint of one text with every shingle counted once, a digest of its shingle set, and the sorted distinct hashes."""
    found = list(_hashes(text, shingle, seed))
    hashes = np.unique(np.concatenate(found).astype(np.uint64)) if found else np.array([], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[start:start + _BLOCK].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"), xxhash.xxh64_intdigest(hashes.tobytes(), seed), hashes


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, dtype=np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp, node) of every row; ``fp`` is the fingerprint as a signed long, and the node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = _signed([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), signed, signed], names=["key", "fp", "node"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "key long, fp long, node long")


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """A bit per hash bucket, set if an odd number of the hashes fall into it, as whole numbers of 64 bits."""
    bucket = (hashes >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=MAP_BITS) & 1).astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, seed: int = 42) -> DataFrame:
    """(key, fp, node, size, parity map) of every row; the node is the digest of the shingle set, which :func:`shingles_of` makes again."""
    names = ["key", "fp", "node", "size", *MAP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = [_summary(t.as_py(), shingle, seed) for t in part.column(1)]
                maps = np.stack([m for _, _, _, m in found])
                fps, nodes = _signed([f for f, _, _, _ in found]), _signed([d for _, d, _, _ in found])
                sizes = pa.array([n for _, _, n, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fps, nodes, sizes, *map(pa.array, maps.T)], names=names)

    kind = f"key long, fp long, node long, size long, {', '.join(f'{m} long' for m in MAP)}"
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, kind)


def _summary(text: str | None, shingle: int, seed: int) -> tuple[int, int, int, np.ndarray]:
    fp, node, hashes = shingle_set(text, shingle, seed)
    return fp, node, len(hashes), parity_map(hashes)


def shingles_of(docs: DataFrame, text: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """(node, shingles) of every row. The sets are as large as the texts, so they are made again where they are needed and never written whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                found = [shingle_set(t.as_py(), shingle, seed) for t in batch.column(0).slice(start, 256)]
                sets = pa.array([h.view(np.int64) for _, _, h in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([_signed([d for _, d, _ in found]), sets], names=["node", "shingles"])

    return docs.select(F.col(text)).mapInArrow(run, "node long, shingles array<long>")


def own_shingles(sets: DataFrame, one_of: int = 1) -> DataFrame:
    """(node, own): how many shingles of a node are in no other one; nodes without any are left out. ``sets``: (node, shingles), repeated rows allowed.

    ``one_of`` counts only the shingles whose hash it divides: never more than all, so what needs few own shingles still has few."""
    every = sets.select("node", F.explode("shingles").alias("shingle")).where(F.pmod("shingle", F.lit(one_of)) == 0)
    spread = every.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return spread.where("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _bits(fp: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones per fingerprint, the highest bit first."""
    return np.unpackbits(fp.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8)).reshape(-1, BITS)


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits that are set together) over all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        cells = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in rows:  # 4,097 rows at every size of the input
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal size, each grown from a seed by the bit most correlated with what it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        first = max(free, key=lambda b: (correlation[b, sorted(free)].sum(), -b))
        part = [first]
        free.discard(first)
        while len(part) < size:
            best = max(free, key=lambda b: (correlation[b, part].mean(), -b))
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def within(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two independent rows differ in at most 0, 1, ... ``most`` of the bits with shares p of ones."""
    exact = np.zeros(most + 1)
    exact[0] = 1
    for q in 2 * p * (1 - p):
        exact[1:] = exact[1:] * (1 - q) + exact[:-1] * q
        exact[0] *= 1 - q
    return np.cumsum(exact)


def thresholds(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_p >= -1 with sum(t_p + 1) = distance + 1 and the least sum of ``costs[p][t_p]`` (0 for -1)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, distance - used + 1):
                new = (total + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t + 1 not in after or new < after[used + t + 1]:
                    after[used + t + 1] = new
        best = after
    return best[distance + 1]


def _values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part as one number per row."""
    return bits[:, part].astype(np.int64) @ (np.int64(1) << np.arange(len(part), dtype=np.int64))


def part_values(distinct: DataFrame, parts: list[list[int]]) -> DataFrame:
    """(part, value, fp, node) of every node and part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            bits = _bits(fp)
            for k, part in enumerate(parts):
                arrays = [pa.array(np.full(len(fp), k, np.int32)), pa.array(_values(bits, part)), batch.column(0), batch.column(1)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "value", "fp", "node"])

    return distinct.select("fp", "node").mapInArrow(run, "part int, value long, fp long, node long")


def plan_parts(distinct: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of the least estimated cost."""
    n, both = bit_counts(distinct)
    options = {m: group_bits(n, both, m) for m in PARTS}
    every = [part for m in PARTS for part in options[m]]
    same = part_values(distinct, every).groupBy("part", "value").agg(F.count(F.lit(1)).alias("c"))
    pairs = dict(same.groupBy("part").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).collect())  # one row per part
    share, at, found = np.diag(both) / max(n, 1), 0, []
    for m in PARTS:
        costs = []
        for part in options[m]:
            chance = within(share[part], distance)
            ball = np.cumsum([comb(len(part), t) for t in range(distance + 1)])
            candidates = float(pairs.get(at) or 0) * chance / max(chance[0], 1e-300) + n * (n - 1) / 2 * chance
            costs.append([ROW_COST * n * (1 + float(b)) + c for b, c in zip(ball, candidates)])
            at += 1
        found.append((*thresholds(costs, distance), m))
    _, chosen, m = min(found)
    used = [(part, t) for part, t in zip(options[m], chosen) if t >= 0]
    return [part for part, _ in used], [t for _, t in used]


def probes(rows: DataFrame, parts: list[list[int]], limits: list[int], extra: tuple[str, ...] = ()) -> DataFrame:
    """(part, value, fp, node, root, extra, flip) under every value that differs in at most the part's limit of bits, those in ``flip``."""
    names = ["part", "value", "fp", "node", "root", *extra]
    masks = []
    for part, t in zip(parts, limits):
        flips = [sum(1 << b for b in chosen) for k in range(t + 1) for chosen in combinations(range(len(part)), k)]
        masks.append(np.array(flips, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, value, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names)))
            for part in np.unique(k):
                at = np.flatnonzero(k == part)
                step = max(1, (1 << 17) // len(masks[part]))
                for s in range(0, len(at), step):
                    some = at[s:s + step]
                    width = len(masks[part])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(some) * width, part, np.int32)), pa.array((value[some][:, None] ^ masks[part][None, :]).ravel()),
                        *(pa.array(np.repeat(x[some], width)) for x in rest), pa.array(np.tile(masks[part], len(some))),
                    ], names=[*names, "flip"])

    kind = "part int, value long, fp long, node long, root long, " + "".join(f"{c} long, " for c in extra) + "flip long"
    return rows.select(names).mapInArrow(run, kind)


def _close(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def may_be_similar(similarity: float) -> Fits:
    """Condition on the columns size, own and the maps of two nodes that holds for all pairs of at least that Jaccard similarity."""
    def fits(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        total = a("size") + b("size")
        common = total * (similarity / (1 + similarity)) - 1e-6
        differing = sum((F.bit_count(a(m).bitwiseXOR(b(m))) for m in MAP), F.lit(0))
        return (F.least(a("size") - a("own"), b("size") - b("own")) >= common) & (differing <= total - 2 * common)

    return fits


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose whole shingle sets have a Jaccard similarity of at least ``similarity``; ``sets``: (node, shingles)."""
    pairs = saved(pairs)
    if pairs.isEmpty():
        return pairs
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    picked = saved(sets.select("node", "shingles").join(needed, "node", "left_semi").dropDuplicates(["node"]))
    a, b = (picked.select(F.col("node").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "uv")
    common, total = F.size(F.array_intersect("shingles_u", "shingles_v")), F.size("shingles_u") + F.size("shingles_v")
    both = pairs.join(a, "u").join(b, "v").select("u", "v", common.alias("common"), total.alias("total"))
    found = saved(both.where(F.col("common") >= similarity * (F.col("total") - F.col("common")) - 1e-9).select("u", "v"))
    discard(pairs, picked)
    return found


def meeting_part(a: Column, b: Column, parts: list[list[int]], limits: list[int]) -> Column:
    """The first part in which two fingerprints differ in at most its limit of bits: the one of all their parts under which a pair is kept."""
    masks = [int(np.array(sum(1 << (BITS - 1 - bit) for bit in part), np.uint64).view(np.int64)) for part in parts]
    differing = (F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask))) for mask in masks)
    return F.coalesce(*(F.when(d <= t, F.lit(k)) for k, (d, t) in enumerate(zip(differing, limits))))


def one_way(flip: Column, other: Column) -> Column:
    """Of all pairs of flips that differ in the same bits, the one with the upper half of these bits on the first side and the lower half on the other."""
    lowest = flip.bitwiseAND(F.negative(flip))
    return ((other == 0) | (lowest > other)) & (F.bit_count(flip) - F.bit_count(other)).between(0, 1)


def links(
    distinct: DataFrame, distance: int, extra: tuple[str, ...] = (), fits: Fits | None = None,
    verified: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> DataFrame:
    """(u, v) of links between nodes that connect all that are linked, directly or over others.

    ``distinct``: (node, fp, n, extra). ``fits`` is a further condition on the extra columns of two nodes, ``verified`` picks the links among pairs.
    """
    def close(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        near = _close(a("fp"), b("fp"), distance) & (a("root") != b("root"))
        return near & fits(a, b) if fits else near

    parts, limits = plan_parts(distinct, distance)
    index = saved(part_values(distinct, parts).join(distinct.select("node", "n", *extra), "node"))
    stars, rooted = None, index.withColumn("root", F.col("node"))
    for turn in range(STAR_ROUNDS):  # the first heads are the most frequent nodes, the later ones any
        first = F.struct("n", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
        heads = rooted.groupBy("part", "value").agg(F.max_by(F.struct("fp", "node", "root", *extra), first).alias("head"))
        near = rooted.join(heads, ["part", "value"]).where(close(F.col, lambda c: F.col(f"head.{c}")))
        new = verified(near.select(F.col("node").alias("u"), F.col("head.node").alias("v")).distinct())
        before = stars, rooted if turn else None
        stars = saved(new if stars is None else stars.unionByName(new))
        roots = components(stars).withColumnRenamed("u", "node")
        rooted = saved(index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        discard(*before)
    rooted = rooted.drop("n")
    crowded = rooted.groupBy("part", "value").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    names = [F.col(c).alias(f"other_{c}") for c in ("fp", "root", *extra)] + [F.col("node").alias("v")]
    here = meeting_part(F.col("fp"), F.col("other_fp"), parts, limits) == F.col("part")
    unlinked = (F.col("node") < F.col("v")) & here & close(F.col, lambda c: F.col(f"other_{c}"))
    exact = [k for k, t in enumerate(limits) if t == 0]
    same = (  # equal values: only buckets that hold more than one component so far
        rooted.where(F.col("part").isin(exact)).join(crowded.where("low < high").select("part", "value"), ["part", "value"], "left_semi")
        .join(rooted.select("part", "value", *names), ["part", "value"]).where(unlinked)
    )
    # each side takes half of the bits: fewer rows than all of them on one
    ways = rooted.where(~F.col("part").isin(exact))
    wide = (
        probes(ways, parts, [t - t // 2 for t in limits], extra)
        .join(probes(ways, parts, [t // 2 for t in limits], extra).select("part", "value", *names, F.col("flip").alias("other_flip")), ["part", "value"])
        .where(one_way(F.col("flip"), F.col("other_flip"))).where(unlinked)
    )
    found = saved(same.select("node", "v").unionByName(wide.select("node", "v")).withColumnRenamed("node", "u"))
    discard(index, rooted)
    return stars.unionByName(verified(found))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = 4, shingle: int = 4, seed: int = 42,
    similarity: float | None = None,
) -> DataFrame:
    """(key, fingerprint, component_id) of every row: 16 hex digits, and the smallest id that links reach."""
    rows = saved((fingerprints if similarity is None else shingle_sets)(docs, text, key, shingle, seed))
    distinct = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    if similarity is None:
        distinct = saved(distinct)
        found = links(distinct, distance)
    else:
        inside = [F.min(m).alias(m) for m in MAP]
        sets = shingles_of(docs, text, shingle, seed)
        sized = rows.groupBy("node").agg(
            F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.min("size").alias("size"), *inside
        )
        owned = sized.join(own_shingles(sets, OWN_ONE_OF), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        distinct = saved(owned)
        worth = distinct.where(F.col("size") - F.col("own") >= F.col("size") * similarity - 1e-6)
        extra = ("size", "own", *MAP)
        near = saved(worth.select("node", "fp", "n", *extra))
        searched = near.select("node")
        sets = saved(sets.join(searched, "node", "left_semi").dropDuplicates(["node"]))  # only sets that a pair can hold
        found = links(near, distance, extra, may_be_similar(similarity), lambda pairs: alike(pairs, sets, similarity))
    roots = components(found).withColumnRenamed("u", "node")
    rooted = saved(distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(rooted.join(least, "root").select("node", "component_id"))
    return rows.select("key", "fp", "node").join(named, "node").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(
    docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = WIDE_DISTANCE, shingle: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """The documents with one of each group of near copies, the one with the smallest id; rows that share an id stay or go together."""
    found = near_duplicates(docs, text, key, distance, shingle, similarity=similarity)
    return keep_rows(docs, found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(key).distinct(), key)
