import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugegrid.llm import hard_negatives as H
from gaugegrid.llm.queries import QUERIES


def plain(rows, is_anchor, positives=5, negatives=10):
    """Every anchor against every row; rows: (id, label, whole numbers), one per id."""
    out = []
    for a, la, qa in rows:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(qa, q)), i, label) for i, label, q in rows if i != a))
        for ps, p, _ in [r for r in scored if r[2] == la][:positives]:
            fit = [(-s, i) for s, i, label in scored if label != la and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out += [(a, p, k + 1, i, -ps, s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def whole(rows):
    return [(i, label, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, label, v in rows]


SCHEMA = "vec_id long, embedding array<float>, label int, id string, q string, tile string, low int, wants string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "i", "q", "t", 1, "w") for i, label, v in rows], SCHEMA)


def vectors(draw, n, width=6, labels=3):
    return [(k, draw.randrange(labels), [draw.gauss(0.3, 1) for _ in range(width)]) for k in range(n)]


@pytest.mark.parametrize("tile", [16, 2048])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(H, "LEAF", 4)
    monkeypatch.setattr(H, "BLOCK", 12)
    draw = random.Random(tile)
    rows = vectors(draw, 160)
    rows += [(k, k % 3, [0.5, 0.25, 0.5, 0.0, 1.0, 0.25]) for k in range(160, 220)]  # many equal vectors
    got = H.hard_negatives(table(spark, rows), F.col("id") % 10 == 0, tile=tile)
    assert sorted(map(tuple, got.collect())) == plain(whole(rows), lambda i: i % 10 == 0)


def test_tree_prunes_and_finds_all(monkeypatch):
    draw = np.random.default_rng(1)
    v = draw.integers(-200, 200, (3000, 5))
    ids, a = draw.permutation(3000), draw.integers(-200, 200, (20, 5))
    tree, opened = H.Tree(ids, v, leaf=16, fan=4), []
    plain_sort = np.lexsort
    monkeypatch.setattr(H.np, "lexsort", lambda keys: (opened.append(len(keys[0])), plain_sort(keys))[1])  # once per opened leaf
    for low, high, share in ((-H.FAR, H.FAR, 0.15), (1000, 20_000, 1)):
        opened.clear()
        found = list(tree.search(a, [-1] * len(a), [[(low, high, None)]] * len(a), 7))
        assert sum(opened) < share * len(a) * len(v)
        for k in range(len(a)):
            fit = sorted((-s, i) for s, i in zip((v @ a[k]).tolist(), ids.tolist()) if low <= s <= high)[:7]
            assert sorted((-s, i) for n, _, i, s in found if n == k) == fit


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.25]), (3, 2, [0.5]), (4, 3, []), (5, 2, [0.25, 0.5]), (-10, 2, [0.5, 0.5])]
    bad = [(6, None, [1.0, 1.0]), (7, 2, None), (8, 2, [nan, 0.5]), (9, 2, [0.5, None]), (10, 2, [inf, 0.5]), (None, 2, [0.5, 0.5])]
    got = H.hard_negatives(table(spark, good + bad + good), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain(whole(good), lambda i: i % 10 == 0) != []


def test_rows_that_share_an_id(spark):
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (2, 2, [0.75]), (2, 3, [0.25])]
    got = [tuple(r) for r in H.hard_negatives(table(spark, rows), F.col("id") == 0).collect()]
    assert got == [(0, 1, 1, 2, 256 * 256, 128 * 256)]


def test_large_numbers_are_exact():
    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 20, 1], [1 << 20, 2]])
    assert H.products(a, b).tolist() == [[(1 << 60) + 3, (1 << 60) + 6]]
    with pytest.raises(OverflowError):
        H.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_empty(spark):
    assert H.hard_negatives(table(spark, []), F.col("id") % 10 == 0).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op13_str_tree"](spark, folder)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(whole(rows), lambda i: i % 100 == 0)
