import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gaugegrid.llm import byte_bpe as B
from tests.llm.conftest import EDGE, documents


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fold_and_heap_agree_with_the_library(spark, ranks, library):
    words = ["a", " the", "réeuxment", "日本語", "\n\n", "====", " Donaudampfschiff", "\u0000\u00ff", "zzzzzzzzzz", "😀"]
    folded = spark.createDataFrame([(w,) for w in words], "piece string").select("piece", B.fold_merges(F.col("piece"), B.rank_map(ranks)).alias("ids"))
    for r in folded.collect():
        assert r.ids == B.merge(r.piece.encode(), ranks) and b"".join(library.decode_single_token_bytes(t) for t in r.ids).decode() == r.piece
    draw = random.Random(1)
    for _ in range(300):
        word = "".join(draw.choice("abcdeéßlnt") for _ in range(draw.randrange(1, 40)))  # letters alone: one piece
        assert B.merge(word.encode(), ranks) == library.encode_ordinary(word)


def test_documents_round_trip(spark, ranks, library):
    odd = [(30, "a\u00a0b\u2003c  d"), (31, "a" * 3000 + " " * 50 + "="), (32, "I'LL we've don't x's"), (33, "é ١٢٣ ⅷ ½"), (34, "\x1c\x1d a\x85b")]
    rows = EDGE + odd
    docs = documents(spark, rows)
    for most in (0, 5, B.DICTIONARY):
        found = B.encoded(docs, ranks, public_tokenizers.PATTERN, most=most)
        got = found.withColumn("back", B.decoded(F.col("ids"), ranks)).collect()
        assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(str((i, library.encode_ordinary(t or ""))) for i, t in rows)
        assert sorted(str((r.doc_id, bytes(r.back).decode())) for r in got) == sorted(str((i, t or "")) for i, t in rows)


def test_empty(none, ranks):
    assert B.round_trip(none, ranks, public_tokenizers.PATTERN).count() == 0
