import zlib
from itertools import product

from pyspark.sql import functions as F

from gaugegrid.llm import resharding as R
from tests.llm.conftest import EDGE, documents


def least_cost(supply, capacity, cost):
    """By trying every way to ship small integer amounts."""
    best = None

    def go(k, room, total):
        nonlocal best
        if k == len(supply):
            best = total if best is None else min(best, total)
            return
        for split in product(*(range(min(supply[k], r) + 1) for r in room)):
            if sum(split) == supply[k]:
                go(k + 1, [r - x for r, x in zip(room, split)], total + sum(c * x for c, x in zip(cost[k], split)))

    go(0, capacity, 0)
    return best


def test_flow_is_the_cheapest():
    for supply, capacity, cost in (
        ([3, 2], [2, 3], [[0, 1], [1, 0]]), ([4, 1, 2], [3, 4], [[2, 5], [1, 1], [3, 0]]), ([2, 2, 2], [1, 4, 3], [[0, 4, 2], [3, 1, 5], [1, 1, 1]]),
        ([0, 5], [5, 0], [[1, 1], [1, 1]]), ([3, 3], [3, 2, 1], [[1, 9, 9], [0, 5, 1]]),
    ):
        flow = R.min_cost_flow(supply, capacity, cost)
        assert [sum(row) for row in flow] == supply and all(sum(col) <= c for col, c in zip(zip(*flow), capacity)) and min(map(min, flow)) >= 0
        assert sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr)) == least_cost(supply, capacity, cost)


def placed(docs, n_old=5, shards=3):
    return R.assign(docs, F.pmod(F.xxhash64("source", "doc_id"), F.lit(n_old)), {str(k): k if k < shards else None for k in range(n_old)}, shards)


def test_every_document_has_a_slot(spark):
    rows = EDGE[:-6] + [(100 + k, f"text {k} " + "y" * (k * 37 % 90)) for k in range(900)]
    got = placed(documents(spark, rows)).collect()
    want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    size = {s: sum(r.size for r in got if r.shard == s) for s in range(3)}
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    total, largest = sum(size.values()), max(r.size for r in got)
    assert max(size.values()) - min(size.values()) <= 4 * largest
    moved = sum(r.size for r in got if int(r.old) >= 3 or int(r.old) != r.shard)
    old = {k: sum(r.size for r in got if int(r.old) == k) for k in range(5)}
    least = sum(v if k >= 3 else max(0, v - (total + 2) // 3) for k, v in old.items())
    assert moved <= least + 8 * largest


def test_again_gives_the_same(edge):
    rows = [sorted(map(str, placed(edge).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and len(rows[0]) == len(EDGE)


def test_only_changed_shards_are_written(spark, tmp_path):
    docs = documents(spark, [(k, "z" * (10 + k % 5)) for k in range(600)])
    old, home = F.pmod(F.col("doc_id"), F.lit(4)), {str(k): k for k in range(4)}
    plan = R.assign(docs, old, home, 4, capacity=[10_000, 10_000, 10_000, 10_000])
    assert R.rewrite(plan, docs, old, home, str(tmp_path / "a")) == []
    plan = R.assign(docs, old, home, 4, capacity=[500, 10_000, 10_000, 10_000])
    names = R.rewrite(plan, docs, old, home, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert "shard=0" in names and len(names) < 4 and set(docs.columns) < set(back.columns)
    assert back.count() == plan.where(F.col("shard").isin([int(n[6:]) for n in names])).count()


def test_empty(none):
    assert placed(none).count() == 0


def test_rewritten_shards_hold_every_row(spark, tmp_path):
    rows = [(None, f"n{k}") for k in range(40)] + [(5, "same")] * 60 + [(6, f"v{k % 3}") for k in range(60)]
    docs = documents(spark, rows).withColumn("shard", F.lit("s")).withColumn("slot", F.lit("t"))
    old, home = F.pmod(F.xxhash64("text"), F.lit(4)), {str(k): k for k in range(4)}
    path = str(tmp_path / "c")
    spark.createDataFrame([(9, "stays")], "shard int, text string").write.partitionBy("shard").parquet(path)
    for carry in (False, True):
        plan = R.assign(docs, old, home, 4, carry=carry).persist()
        names = R.rewrite(plan, docs, old, home, path)
        changed = [int(n[6:]) for n in names]
        back = spark.read.parquet(path).where("shard <> 9")
        want = plan.where(F.col("shard").isin(changed))
        assert changed and sorted(map(str, back.select("shard", "slot", "doc_id").collect())) == sorted(map(str, want.select("shard", "slot", "doc_id").collect()))
        assert {(r.doc_shard, r.doc_slot) for r in back.collect()} == {("s", "t")} and spark.read.parquet(path).where("shard = 9").count() == 1


def test_the_query_rewrites(spark, monkeypatch):
    from gaugegrid.llm.queries import QUERIES
    calls, write = [], R.rewrite_shards
    monkeypatch.setattr(R, "rewrite_shards", lambda *a: (calls.append(a[1]), write(*a)))
    n = QUERIES["op3_min_cost_flow"](spark, "/root/testdata/sf0.001").count()
    assert calls and calls[0] and n == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()




def test_whole_rows_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    documents(spark, [(k, "z" * (10 + k % 5)) for k in range(600)]).write.parquet(path)
    docs, old = spark.read.parquet(path), F.pmod(F.col("doc_id"), F.lit(4))
    moves = R.plan_moves(docs, old, {str(k): k for k in range(4)}, 4)
    plan = R.place(docs, old, moves, carry=True)._jdf.queryExecution().executedPlan().toString()
    at = [k for k, line in enumerate(plan.split("\n")) if "struct(doc_id" in line or "named_struct(doc_id" in line]
    above = plan.split("\n")[:min(at)]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    chain, now = [], depth(plan.split("\n")[min(at)])
    for line in reversed(above):  # the operators between the documents and the result
        if depth(line) < now:
            chain.append(line)
            now = depth(line)
    assert sum("Exchange hashpartitioning" in line for line in chain) == 1
