import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gaugegrid.llm import simhash as S
from gaugegrid.llm.components import components
from tests.llm.conftest import EDGE, documents


def plain_fingerprint(text, shingle=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[k:k + shingle]) for k in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(ids, prints, distance):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(ids[i])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(ids))]


def check(rows, got, distance=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip([i for i, _ in rows], (f"{p:016x}" for p in prints), classes([i for i, _ in rows], prints, distance))))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want


def test_edges_against_brute_force(edge, none):
    check(EDGE, S.near_duplicates(edge).collect())
    assert S.near_duplicates(none).count() == 0


def test_near_copies_against_brute_force(spark):
    draw = random.Random(5)
    rows, k = [], 0
    for _ in range(12):
        words = [f"t{draw.randrange(400)}" for _ in range(draw.choice((3, 60, 400)))]
        for _ in range(draw.choice((1, 2, 25))):
            copy = list(words)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = f"n{draw.randrange(99)}"
            rows.append((k, " ".join(copy)))
            k += 1
    for distance in (4, 7):
        check(rows, S.near_duplicates(documents(spark, rows), distance=distance).collect(), distance)


def test_long_texts_are_hashed_in_blocks():
    text = " ".join(f"q{k}" for k in range(S._BLOCK + 50))
    assert S.fingerprint(text, 4, 42) == plain_fingerprint(text)


def test_thresholds_keep_the_pigeonhole():
    draw = np.random.default_rng(3)
    for parts in S.PARTS:
        costs = [sorted(draw.random(5) * 100) for _ in range(parts)]
        total, chosen = S.thresholds(costs, 4)
        assert sum(t + 1 for t in chosen) == 5 and abs(total - sum(c[t] for c, t in zip(costs, chosen) if t >= 0)) < 1e-9
        for _ in range(200):  # any four differing bits leave some part within its threshold
            spread = np.bincount(draw.integers(0, parts, 4), minlength=parts)
            assert any(d <= t for d, t in zip(spread, chosen))


def test_bits_are_grouped_once_each():
    bits = np.random.default_rng(1).integers(0, 2, (500, 64))
    bits[:, 7] = bits[:, 50]
    for m in S.PARTS:
        parts = S.group_bits(500, bits.T @ bits, m)
        assert sorted(b for p in parts for b in p) == list(range(64)) and max(map(len, parts)) - min(map(len, parts)) <= 1
        assert any({7, 50} <= set(p) for p in parts)


def test_components_against_union_find(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(-5, -9)]
    got = {r.u: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_document_of_a_group_stays(edge):
    left = S.one_per_group(edge)
    assert left.columns == edge.columns and 8 not in {r.doc_id for r in left.collect()} and 7 in {r.doc_id for r in left.collect()}


def test_similarity_is_checked_on_the_shingles(spark):
    base = [f"m{k}" for k in range(300)]
    near, far = list(base), list(base)
    near[100:103] = "x y z".split()  # 7 of 296 shingles change
    far[::30] = ["q"] * 10  # 50 shingles change: similarity 0.71
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    found = S.near_duplicates(documents(spark, rows), distance=64, shingle=5, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}


def test_no_similar_pair_is_lost_at_full_distance(spark):
    """Families of copies with few, some and many changes, and a passage in many texts, against all pairs of sets."""
    draw, rows = random.Random(21), []
    passage = [f"p{k}" for k in range(40)]
    for family in range(8):
        base = [f"f{family}w{draw.randrange(10**6)}" for _ in range(draw.choice((30, 80, 200)))] + passage * (family % 2)
        for _ in range(14):
            copy = list(base)
            for _ in range(draw.randrange(12)):
                copy[draw.randrange(len(copy))] = f"n{draw.randrange(6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "one", "one", " \n", "a b c d e"])]
    sets = [set(S.shingle_set(t, 5, 42)[2].tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    found = S.near_duplicates(documents(spark, rows), distance=64, shingle=5, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(root)) and len(set(root)) > 12


def test_a_repeated_sentence_does_not_link_texts(spark):
    draw = random.Random(11)
    common = [f"s{k}" for k in range(10)] * 60
    rows = [(k, " ".join([f"a{draw.randrange(10**9)}" for _ in range(400)] + common)) for k in range(30)]
    found = S.near_duplicates(documents(spark, rows), distance=8, shingle=5, similarity=0.8).collect()
    assert all(r.component_id == r.doc_id for r in found)


def test_equal_fingerprints_are_checked(spark):
    sets = {k: np.array(sorted(xxhash.xxh64_intdigest(str(i)) for i in v), np.uint64) for k, v in {1: range(100), 2: range(100, 200), 3: range(2, 100)}.items()}
    rows = [(k, 77, 1, len(v), 2 if k == 1 else 100 if k == 2 else 0, *S.parity_map(v).tolist(), v.view(np.int64).tolist()) for k, v in sets.items()]
    kind = f"node long, fp long, n long, size long, own long, {', '.join(m + ' long' for m in S.MAP)}, shingles array<long>"
    nodes = spark.createDataFrame(rows, kind)
    found = S.links(nodes, 4, ("size", "own", *S.MAP), S.may_be_similar(0.8), lambda pairs: S.alike(pairs, nodes, 0.8)).collect()
    assert {frozenset((r.u, r.v)) for r in found} == {frozenset((1, 3))}
    own = {r.node: r.own for r in S.own_shingles(nodes.unionByName(nodes)).collect()}
    assert own == {1: 2, 2: 100}


def test_conditions_hold_for_every_similar_pair(spark):
    draw, rows = np.random.default_rng(6), []
    for k in range(150):
        n, changed = int(draw.integers(1, 2500)), draw.random() * 0.3
        a = draw.integers(0, 2**63, n).astype(np.uint64)
        b = np.where(draw.random(n) < changed, draw.integers(0, 2**63, n).astype(np.uint64), a)[:max(1, int(n * (1 - draw.random() * 0.2)))]
        both = len(np.intersect1d(a, b))
        rows.append((both >= 0.8 * (len(a) + len(b) - both), *(x for s in (a, b) for x in (len(s), len(s) - both, *S.parity_map(s).tolist()))))
    names = ["size", "own", *S.MAP]
    df = spark.createDataFrame(rows, ["similar", *(f"a_{c}" for c in names), *(f"b_{c}" for c in names)])
    got = df.select("similar", S.may_be_similar(0.8)(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")).alias("fits")).collect()
    assert all(r.fits for r in got if r.similar) and sum(r.similar for r in got) > 15 and sum(not r.fits for r in got) > 15


def test_recall_at_four_fifths(spark):
    draw, rows = random.Random(8), []
    for k in range(60):  # one changed run of 84 words: 712 of 888 shingles are common, similarity 0.802
        words = [f"d{k}x{draw.randrange(10**9)}" for _ in range(804)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:400] + [f"e{k}x{i}" for i in range(84)] + words[484:]))]
    found = {r.doc_id: r.component_id for r in S.near_duplicates(documents(spark, rows), distance=S.WIDE_DISTANCE, shingle=5, similarity=0.8).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(60)) >= 54


def test_sets_are_not_kept_and_own_shingles_are_a_lower_bound(spark):
    """What is written for all rows has no shingles; counting among every second one never gives more than all, and about half of them."""
    rows = [(k, " ".join(f"z{k}x{i}" if i > 40 * (k % 2) else f"c{i}" for i in range(300))) for k in range(6)] + [(9, None)]
    docs = documents(spark, rows)
    assert "shingles" not in S.shingle_sets(docs).columns
    sets = {r.key: (r.node, r.size) for r in S.shingle_sets(docs).collect()}
    made = {r.node: r.shingles for r in S.shingles_of(docs).collect()}
    assert all(len(made[node]) == size for node, size in sets.values())
    every, some = ({r.node: r.own for r in S.own_shingles(S.shingles_of(docs), k).collect()} for k in (1, 2))
    assert every and all(some.get(n, 0) <= own and abs(some.get(n, 0) - own / 2) < 60 for n, own in every.items())


def test_a_pair_is_met_once(spark):
    """Of all parts and flips under which two fingerprints meet, one is kept, and no pair within the distance is without one."""
    draw, parts, limits = random.Random(9), [list(range(k, 64, 4)) for k in range(4)], [1, 0, 4, 3]
    flipped = [sum(1 << b for b in draw.sample(range(64), draw.randrange(16))) for _ in range(400)]
    prints = [(a, a ^ x) for x, a in ((x, draw.getrandbits(64)) for x in flipped)]
    signed = [tuple(p - (p >> 63 << 64) for p in pair) for pair in prints]
    got = spark.createDataFrame(signed, "a long, b long").select(
        "a", "b", S.meeting_part(F.col("a"), F.col("b"), parts, limits).alias("k")).collect()
    differing = {tuple(s): [sum((x ^ y) >> 63 - b & 1 for b in part) for part in parts] for s, (x, y) in zip(signed, prints)}
    want = {s: next((k for k, (n, t) in enumerate(zip(d, limits)) if n <= t), None) for s, d in differing.items()}
    assert {(r.a, r.b): r.k for r in got} == want and len(set(want.values())) > 3
    assert all(want[s] is not None for s, d in differing.items() if sum(d) <= 11)
    for t in range(6):
        sides = [[m for m in range(1 << 7) if m.bit_count() <= most] for most in (t - t // 2, t // 2)]
        both = spark.createDataFrame([(a, b) for a in sides[0] for b in sides[1]], "a long, b long")
        kept = [r.a ^ r.b for r in both.where(S.one_way(F.col("a"), F.col("b"))).collect()]
        assert sorted(kept) == [m for m in range(1 << 7) if m.bit_count() <= t]


def test_the_search_makes_a_pair_one_row(spark):
    """Pairs that are within the distance but not similar reach the last check once each, however many parts and flips they meet in."""
    draw, checked = random.Random(4), []
    base = draw.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in draw.sample(range(64), 3)) for _ in range(60)})
    nodes = spark.createDataFrame([(k, p - (p >> 63 << 64), 1) for k, p in enumerate(prints)], "node long, fp long, n long")

    def none(pairs):
        checked.append([(r.u, r.v) for r in pairs.collect()])
        return pairs.where("false")

    assert S.links(nodes, 14, (), None, none).count() == 0
    assert sorted(checked[-1]) == [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))]
