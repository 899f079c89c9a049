import hashlib
import random
import zlib

import numpy as np

from gaugegrid.llm import periodic_runs as R
from gaugegrid.llm.queries import QUERIES
from tests.llm.conftest import EDGE, LONG, documents


def plain_runs(words, least=24, times=3):
    """All periods, place by place; of equal stretches the smallest period."""
    out = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            if words[i] == words[i + p]:
                j = i
                while j + p < len(words) and words[j] == words[j + p]:
                    j += 1
                if j - i + p >= max(least, times * p):
                    out.setdefault((i, j - i + p), p)
                i = j
            i += 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    drop = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def drawn(draw, most):
    words = []
    while len(words) < most:
        words += [bytes([97 + draw.randrange(draw.choice([1, 2, 5]))]) for _ in range(draw.randrange(1, 14))] * draw.randrange(1, 9)
    return words


def test_cover_has_every_difference():
    assert (R.shifts() >= 0).all()


def test_runs_against_brute_force():
    draw = random.Random(5)
    for _ in range(250):
        texts = [drawn(draw, draw.randrange(0, 300)) for _ in range(draw.randrange(1, 6))]
        least, times = draw.choice([(24, 3), (24, 3), (6, 2), (1, 2), (10, 4)])
        assert [list(map(tuple, r.tolist())) for r in R._search(texts, least, times)] == [plain_runs(w, least, times) for w in texts]


def test_extensions_against_comparing():
    draw = random.Random(6)
    for _ in range(30):
        words = np.array([w[0] for w in drawn(draw, draw.randrange(1, 500))])
        n, ask = len(words), R.Extensions(words)
        i, j = np.array([draw.sample(range(n + 1), 2) for _ in range(200)]).T
        want = [next((k for k in range(n + 1) if max(a, b) + k >= n or words[a + k] != words[b + k])) for a, b in zip(i, j)]
        assert ask(i, j).tolist() == want


def test_documents(spark):
    rows = EDGE + [(20, "x y z\n" * 5000), (20, "x y z\n" * 5000), (21, LONG + " " + "p q " * 50), (22, "same " * 23), (23, "same " * 24), (None, "n n n " * 9)]
    got = R.periodic_runs(documents(spark, rows)).collect()
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        near = plain_runs(words) if len(words) < 20_000 else [(len(words) - 100, 100, 2)] if "p q" in t else []
        want.append(str((i, len(words), near, plain_collapsed([w.decode() for w in words], near))))
    assert sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got) == sorted(want)


def test_query_against_brute_force(spark):
    folder, sha = "/root/testdata/sf0.001", lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got, planted = QUERIES["op12_difference_cover"](spark, folder).collect(), 0
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        words = [w.decode() for w in docs[r.doc_id].encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            planted += 1
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else None  # short texts: the quotients are far enough apart
        milli = 1000 * best[1] // best[2] if best else None
        text = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        assert tuple(r) == (r.doc_id, len(runs), *(best or (None,) * 3), milli, sha(text), sha(plain_collapsed(words, runs)))
    assert planted > 5


def test_strongest_is_exact(spark):
    big = 3 * 10**8
    rows = [([(5, 2 * big + 1, big), (0, 2 * big - 1, big - 1)],), ([(9, 30, 10), (2, 90, 30), (2, 33, 11)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>")
    got = [r.best and tuple(r.best) for r in df.select(R.strongest(df.runs).alias("best")).collect()]
    assert got == [max([(5, 2 * big + 1, big), (0, 2 * big - 1, big - 1)], key=lambda r: r[1] * (big * (big - 1)) // r[2]), (2, 33, 11), None]


def test_empty(none):
    assert R.periodic_runs(none).count() == 0
