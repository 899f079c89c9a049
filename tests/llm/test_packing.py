import re

import numpy as np

from gaugegrid.llm import packing as P
from tests.llm.conftest import EDGE, documents


def test_best_fit_places_everything():
    draw = np.random.default_rng(4)
    for sizes in (np.sort(draw.integers(1, 2049, 3000))[::-1], np.full(50, 2048), np.full(9, 1), np.sort(draw.integers(1, 300, 500))[::-1], np.array([], int)):
        where, offset, lengths = P.best_fit(sizes)
        assert set(lengths.tolist()) <= set(P.LENGTHS)
        for b in range(len(lengths)):
            mine = np.flatnonzero(where == b)
            order = mine[np.argsort(offset[mine])]
            assert (offset[order] == np.cumsum(sizes[order]) - sizes[order]).all()
            used = sizes[mine].sum()
            assert used <= lengths[b] and not any(used <= n < lengths[b] for n in P.LENGTHS)
        if len(sizes) > 400:
            assert sizes.sum() / lengths.sum() > 0.97


def plain_best_fit(sizes, lengths, fixed):
    """The rule in plain loops: look at every open sequence for every piece."""
    rate = min((n + fixed) / n for n in lengths)
    bins = []
    for clock, size in enumerate(sizes):
        fitting = [b for b in bins if b["room"] >= size]
        if fitting:
            b = min(fitting, key=lambda b: (b["room"], -b["touched"]))  # of equal rooms the one changed last
        else:
            def cost(n):
                return n + fixed - rate * (n - size) * sum(s <= n - size for s in sizes) / len(sizes)

            n = min((n for n in lengths if n >= size), key=lambda n: (cost(n), n))
            b = {"room": n, "contents": []}
            bins.append(b)
        b["room"] -= size
        b["touched"] = clock
        b["contents"].append(size)
    return [(b["contents"], min(n for n in lengths if n >= sum(b["contents"]))) for b in bins]


def test_best_fit_against_plain_loops():
    draw = np.random.default_rng(7)
    for lengths, fixed in (((64, 128, 256), 8), ((256, 512, 1024, 2048), 32), ((100,), 0), ((10, 11, 300), 500)):
        for top in (3, max(lengths) // 3, max(lengths)):
            sizes = np.sort(draw.integers(1, top + 1, 400))[::-1]
            where, offset, shrunk = P.best_fit(sizes, lengths, fixed)
            got = [(sizes[where == b].tolist(), int(shrunk[b])) for b in range(len(shrunk))]
            assert got == plain_best_fit(sizes.tolist(), lengths, fixed)


def test_large_ids_beside_a_null_id_stay_as_they_are(spark):
    ids = [2**53 + 1, None, 2**53 + 3, 2**62 + 1, 5]
    got = P.pack(documents(spark, [(i, "one two three") for i in ids])).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.offset)] == [5, 2**53 + 1, 2**53 + 3, 2**62 + 1, None]


def test_documents_against_their_words(spark):
    rows = EDGE + [(50 + k, "w " * (k * 97 % 700)) for k in range(60)]
    got = P.pack(documents(spark, rows), lengths=(64, 128, 256)).collect()
    want = sorted(str((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for i, t in rows)
    whole = [r for r in got if r.start == 0]
    assert sorted(str((r.doc_id, r.n_units)) for r in whole) == want
    for i in {r.doc_id for r in got if r.doc_id not in (None, 4)}:
        parts = sorted((r.start, r.length, r.n_units) for r in got if r.doc_id == i)
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) == parts[0][2]
    bins = {}
    for r in got:
        if r.length:
            bins.setdefault((r.sequence_group, r.sequence), []).append(r)
    for rows_of in bins.values():
        rows_of.sort(key=lambda r: r.offset)
        assert sum(r.length for r in rows_of) == rows_of[0].filled <= rows_of[0].capacity and rows_of[0].capacity in (64, 128, 256)
        assert all(a.offset + a.length == b.offset for a, b in zip(rows_of, rows_of[1:]))
    assert all(r.sequence is None for r in got if not r.length)


def test_empty(none):
    assert P.pack(none).count() == 0
