from collections import defaultdict

from gaugegrid.llm import line_runs as L
from tests.llm.conftest import EDGE, documents


def brute(rows, least):
    found = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            found[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(found[key(x)]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


def test_against_brute_force(spark):
    rows = EDGE + [(100 + k, "\n".join(["Footer ", f"own {k}", "", " footer\t", "É x" if k % 2 else "é x", "rare" if k < 9 else "z"])) for k in range(20)]
    docs = documents(spark, rows)
    for least, batches in ((10, 4), (9, 1), (2, 5)):
        got = L.without_lines(docs, least_documents=least, batches=batches).collect()
        assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got) == brute(rows, least)


def test_levels_merge_and_add_up(spark):
    pairs = spark.createDataFrame([(b, k, k % 6, 0) for b in range(5) for k in range(30)], "batch int, key long, h1 long, h2 long")
    levels = L.Levels(1000, fan=2)
    for b in range(5):
        levels.add(pairs.where(f"batch = {b}"))
    assert [len(level) for level in levels.levels] == [1, 0, 1]
    assert {r.h1: r.n for r in levels.total().collect()} == dict.fromkeys(range(6), 25)


def test_hashes_known_to_be_frequent_are_not_counted_again(spark):
    pairs = spark.createDataFrame([(b, 10 * b + k, 1 if k < 5 else 2 + k, 0) for b in range(3) for k in range(7)], "batch int, key long, h1 long, h2 long")
    levels = L.Levels(5, fan=9)
    for b in range(3):
        levels.add(pairs.where(f"batch = {b}"))
    assert [{r.h1: r.n for r in run.collect()} for run in levels.runs()] == [{1: 5, 7: 1, 8: 1}, {7: 1, 8: 1}, {7: 1, 8: 1}]


def test_empty(none):
    assert L.without_lines(none).count() == 0
