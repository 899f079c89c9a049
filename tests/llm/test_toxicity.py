from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from gaugegrid.llm import toxicity as X
from tests.llm.conftest import EDGE, documents

DIRECTORY = "/root/testdata/sf0.01"


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(0)
    counts, moves = np.array([3, 0, 1, 5]), draw.normal(size=(2, 2))
    odds = draw.normal(size=counts.sum()) * 2
    p, pairs = X.marginals(odds, counts, moves)
    want, both, at = np.zeros(len(odds)), np.zeros((2, 2)), 0
    for n in counts:
        total, ones, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(odds[at + k] for k in range(n) if y[k]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
            for a, b in zip(y, y[1:]):
                steps[a, b] += w
        want[at:at + n] = ones / total
        both += steps / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_tokens_and_spans():
    codes, words, counts = X.tokens(pa.array(["Foo, bar  foo", None, "", " lead \n trail "]))
    assert [words[c] for c in codes] == ["foo", "bar", "foo", "lead", "trail"] and counts.tolist() == [3, 0, 0, 2]
    text = "ok Äffe! du  idiot."
    assert [text[s["start"]:s["end"]] for s in X._spans(text, np.array([0.1, 0.9, 0.2, 0.8]))] == ["Äffe!", "idiot."]


@pytest.fixture(scope="module")
def scored(spark):
    return X.scored(spark.read.parquet(f"{DIRECTORY}/documents.parquet"), spark.read.parquet(f"{DIRECTORY}/labels.parquet")).toPandas()


def test_held_out_documents_are_ranked(spark, scored):
    both = scored.merge(spark.read.parquet(f"{DIRECTORY}/labels.parquet").toPandas(), on="doc_id")
    assert len(scored) == 1000 and scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()
    held = both[both.held_out]
    toxic, clean = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() + (toxic[:, None] == clean[None, :]).mean() / 2 > 0.8 and (clean < 0.5).mean() > 0.95


def labelled_words(spark):
    rows = [(k, " ".join(f"{letter}{k}{letter}" for letter in "pqrstuv") + (" scoundrel knave" if k % 4 == 0 else "")) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    return documents(spark, rows), labels


def test_spans_point_at_the_words(spark):
    docs, labels = labelled_words(spark)
    for r, (_, text) in zip(X.scored(docs, labels).orderBy("doc_id").collect(), [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]):
        assert r.predicted == int("knave" in text)
        assert {w for s in r.spans for w in text[s.start:s.end].split()} == ({"scoundrel", "knave"} if r.predicted else set())


def test_edges_and_columns(spark, edge, none):
    docs, labels = labelled_words(spark)
    field = X.fit(docs, labels)
    found = X.scores(edge, field).collect()
    assert len(found) == len(EDGE) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not (r["row"].text or "").strip()}) == 1
    kept = X.clean_documents(edge.unionByName(docs), labels)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) + 150
    assert X.scored(none, labels).count() == 0 and X.clean_documents(none, labels).count() == 0
    nobody = labels.where("toxic = 0")
    assert {r.score for r in X.scored(edge, nobody).collect()} == {0.0}
