import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd

from gaugegrid.llm import perfect_hash as P
from tests.llm.conftest import EDGE


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i))
    return {sha: (min(g)[2], len(g)) for sha, g in groups.items()}


def test_hash_is_minimal_and_perfect():
    for n in (1, 2, 3, 50, 3000):
        digests = pd.Series([hashlib.sha256(str(k).encode()).digest() for k in range(n)])
        pilots, slots = P.build(digests)
        assert sorted(slots) == list(range(n)) and (P.find(digests, pilots, n) == slots).all()
        strange = pd.Series([hashlib.sha256(f"x{k}".encode()).digest() for k in range(20)])
        found = P.find(strange, pilots, n)
        assert ((0 <= found) & (found < n)).all()  # some slot, whose digest is then compared


def test_against_brute_force(edge):
    for history, batch in (P.halves(edge), (edge, edge.limit(0)), (edge.limit(0), edge)):
        want, got = brute(EDGE), P.exact_dedup(history, batch).collect()
        assert len(got) == len(EDGE)
        for r in got:
            keep, size = want[r.text_sha256]
            assert (r.keep_id, r.group_size, r.kept) == (keep, size, r.doc_id == keep)


def test_the_new_row_may_win(spark):
    old = spark.createDataFrame([(5, "ab c"), (9, "x")], "doc_id long, text string")
    new = spark.createDataFrame([(7, "a b c"), (2, "x")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.known) for r in P.exact_dedup(old, new).collect()} == {5: (7, True), 7: (7, True), 9: (2, True), 2: (2, True)}


def test_many_keys_over_several_buckets(spark):
    rows = [(k, f"text {k % 7000}" + " " * (k % 3)) for k in range(15_000)]
    got = P.exact_dedup(*P.halves(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = brute(rows)
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got) and len(got) == len(rows)


def test_documents_keep_their_columns(edge, none):
    left = P.distinct_documents(edge)
    assert left.columns == edge.columns
    rows = left.collect()
    assert len(rows) == len(brute(EDGE)) and sum(r.doc_id == 4 for r in rows) == 0 and sum(r.doc_id == 5 for r in rows) == 1
    assert {r["row"] for r in rows} == {"r"} and P.distinct_documents(none).count() == 0 and P.exact_dedup(none, none).count() == 0


def test_slots_are_numbers_of_every_kind():
    assert P.find(pd.Series([b"\xff" * 32]), np.array([5]), 3)[0] in (0, 1, 2)
