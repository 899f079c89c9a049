import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gaugegrid.llm import piece_bpe as P
from gaugegrid.llm.queries import QUERIES
from tests.llm.conftest import EDGE, documents

def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encoder_agrees_with_the_library(model, library):
    encoder, draw = P.Encoder(model, P.splits(model.rank)), random.Random(3)
    parts = ["a", "e", "t", "h", "the", "ing", " ", "  ", "▁", "é", "日", "本", "😀", "\n", "1", "23", "<s>", "<0x41>", "\t", "=", "==", ".", ",", "s.", " " * 15]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 40)))
        assert ids_of(encoder, text) == library.encode(text)
    for text in ["", "a\0b", "a" * 3000, "ab" * 5000, *(" " * k for k in range(50))]:
        assert ids_of(encoder, text) == library.encode(text)


def test_pairs_against_merging_them(model):
    """Two tokens stay apart if and only if merging their characters together gives both."""
    split, draw = P.splits(model.rank), random.Random(4)
    merges, names = P.Merges(split, model.rank), [*split]
    spaces = [n for n in names if not n.strip(P.MARK)]
    pairs = [(a, b) for a in spaces for b in spaces] + [(draw.choice(names), draw.choice(names)) for _ in range(3000)]
    short = [n for n in names if len(n) <= 2 and n.isascii()]
    for a, b in pairs + [(draw.choice(short), draw.choice(short)) for _ in range(3000)]:
        assert merges.apart(a, b) == (P.merged(a + b, model.rank)[0] == [a, b]), (a, b)


def test_vocabularies_with_ties_and_unreachable_pieces():
    """A small vocabulary: every text of few letters against plain merging."""
    rank = {"a": 9.0, "b": 9.0, "ab": 1.0, "ba": 1.0, "aba": 2.0, "abab": 2.0, "bb": 3.0}
    small = P.Model(["?"] * 256 + [*rank], rank, {p: 256 + k for k, p in enumerate(rank)}, [*range(256)], False)
    encoder = P.Encoder(small, P.splits(rank))
    for n in range(1, 10):
        for k in range(1 << n):
            text = "".join("ab"[k >> i & 1] for i in range(n))
            assert [small.pieces[i] for i in ids_of(encoder, text)] == P.merged(text, rank)[0], text


def test_later_parts_are_an_error():
    with pytest.raises(ValueError):
        P.splits({"ab": 3.0, "abc": 1.0})


def test_documents_round_trip(spark, model, library):
    rows = EDGE + [(30, "a b c  d"), (31, "x" * 3000 + " " * 50 + "="), (33, "é ١٢٣ ⅷ ½\r\n"), (34, "\x1c\x1d a\x85b ▁")]
    got = P.decoded(P.encoded(documents(spark, rows), model), model).collect()
    ids = {t: library.encode(t or "") for _, t in rows}
    assert sorted(str((r.doc_id, r.ids, r.decoded)) for r in got) == sorted(str((i, ids[t], library.decode(ids[t]))) for i, t in rows)


def test_decoding_of_any_ids(spark, model, library):
    draw = random.Random(5)
    rows = [([draw.randrange(3, 300) for _ in range(draw.randrange(0, 30))],) for _ in range(200)] + [([],), ([0xE4 + 3, 0xB8 + 3, 261, 1, 2],)]
    for r in P.decoded(spark.createDataFrame(rows, "ids array<int>"), model).collect():
        assert r.decoded == library.decode(r.ids)
    assert P.decoded(spark.createDataFrame([(None,)], "ids array<int>"), model).first().decoded is None


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = QUERIES["op11_prefix_table"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id])
        assert tuple(r) == (r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_empty(none, model):
    assert P.round_trip(none, model).count() == 0 and P.encoded(none, model).select(F.col("ids")).count() == 0


def test_small_bounds_change_nothing(spark, model, library, monkeypatch):
    """Caches that overflow all the time and portions of a few ids: the same ids and texts, in the same order."""
    for name, bound in (("CHUNKS", 3), ("HEADS", 2), ("TESTED", 5), ("BATCH_BYTES", 64), ("BATCH_IDS", 7)):
        monkeypatch.setattr(P, name, bound)
    rows = EDGE + [(40 + k, "some words again " * (k % 5) + "w" * k) for k in range(40)]
    got = P.decoded(P.encoded(documents(spark, rows), model), model).collect()
    ids = {t: library.encode(t or "") for _, t in rows}
    assert sorted(str((r.doc_id, r.ids, r.decoded)) for r in got) == sorted(str((i, ids[t], library.decode(ids[t]))) for i, t in rows)
    lists = spark.createDataFrame([([3 + k % 250] * (k % 4),) if k % 6 else (None,) for k in range(50)], "ids array<int>")
    for r in P.decoded(lists, model).collect():
        assert r.decoded == (None if r.ids is None else library.decode(r.ids))
