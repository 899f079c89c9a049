import re

from gaugegrid.llm import quality as Q
from tests.llm.conftest import EDGE, documents

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {k + d for k, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_against_brute_force(spark):
    more = [(20, "a b c d a b c e f a b"), (21, "x x x x x"), (22, "p q r s p q r"), (23, "#a $b %c\n#a $b %c\n#a $b %c"), (24, "a\x0bb\x0cc\rd")]
    rows = EDGE + more
    got = Q.measured(documents(spark, rows)).collect()
    want = sorted(str((i, *brute(t), brute(t)[0] < 50 or 100 * brute(t)[4] > 50 * brute(t)[0])) for i, t in rows)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_order_changes_the_work_and_not_the_verdict(edge):
    names = Q.cascade_order(edge)
    assert sorted(names) == sorted(Q.rules(Q.measures(Q.F.lit(""), Q.F.array(), Q.F.array()), Q.F.lit("")))
    verdicts = [sorted(str((r["row"].doc_id, r["row"].text, r.failed_rule is None)) for r in Q.judged(edge, order=o).collect()) for o in (names, names[::-1])]
    assert verdicts[0] == verdicts[1]


def test_the_sample_comes_from_all_partitions(spark, none):
    docs = spark.range(4000, numPartitions=8).select(Q.F.col("id").alias("doc_id"), Q.F.concat(Q.F.lit("t"), Q.F.col("id")).alias("text"))
    rows = [int(r.text[1:]) for r in Q.sampled(docs, sample_rows=400).collect()]
    assert 250 < len(rows) < 550 and {i // 500 for i in rows} == set(range(8)) and len(set(rows)) == len(rows)
    assert Q.sampled(none).count() == 0 and len(Q.cascade_order(none)) == 7


def test_good_documents(spark, none):
    good = " ".join(f"word{k}" for k in range(80))
    docs = documents(spark, [(1, good), (2, " ".join(f"SHOUTING{'ABCDEFGH'[k % 8]}{'PQRSTUVWXYZ'[k % 11]}" for k in range(80))), (3, "x " * 100), (None, good), (4, None), (5, " ".join(f"w{k}#" for k in range(80)))])
    left = Q.good_documents(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"]
    assert Q.good_documents(none).count() == 0 and Q.measured(none).count() == 0


def test_main_path_is_native(edge):
    plan = Q.measured(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_a_filter_does_not_repeat_the_work(spark):
    """A long text takes about as long below a filter on the verdict as without one."""
    import time

    docs = documents(spark, [(1, " ".join(f"w{k}x{k % 31}" for k in range(60_000)))])
    began = time.perf_counter()
    assert Q.good_documents(docs).count() == 1 and Q.measured(docs).where("kept").count() == 1
    assert time.perf_counter() - began < 60
