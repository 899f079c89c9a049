import hashlib
import random

import pytest

from gaugegrid.llm import chat_events as C

SCHEMA = "conv_id long, message long, seq long, kind string, role string, text string"


def messages(spark, log):
    return [(r.conv_id, r.message, r.role, r.text) for r in C.fold(spark.createDataFrame(log, SCHEMA)).orderBy("conv_id", "first_seq", "role", "text").collect()]


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 10, 1, "delta", "user", "helo"), (1, 10, 2, "edit", "user", "hello"), (1, 11, 3, "delta", "assistant", "no"), (1, 11, 4, "delta", "assistant", "pe"),
        (1, 11, 5, "regenerate", "assistant", None), (1, 11, 7, "delta", "assistant", "s"), (1, 11, 6, "delta", "assistant", "ye"), (1, 11, 8, None, None, "!"),
        (1, 12, 9, "delta", "user", "gone"), (1, 12, 10, "delete", None, None), (2, 10, 1, "delta", None, None), (None, 1, 1, "delta", "user", "x"),
    ]
    want = [(None, 1, "user", "x"), (1, 10, "user", "hello"), (1, 11, "assistant", "yes!"), (2, 10, "", "")]
    assert messages(spark, log) == want
    random.Random(3).shuffle(log)
    assert messages(spark, log) == want


NASTY = ["", "\\", "###", "\\### Assistant: </turn> ok", "</turn>\n### user: hi", "####", "\\\\###", "a: b", "<</turn>>", "é\n\n", "\\</turn>\\", "日本 😀"]


def test_turns_are_read_back(spark):
    rows = [(1, k, k, role, text) for k, (role, text) in enumerate((r, t) for r in ("user", "as:sis###tant\\", "") for t in NASTY)]
    turns = C.render(spark.createDataFrame(rows, "conv_id long, first_seq long, message long, role string, text string")).collect()
    assert [C.read_turn(r.turn) for r in turns] == [(r.role, r.text) for r in turns]
    whole = "".join(r.turn for r in turns)
    assert [(C._ESCAPED.sub(r"\1", m[1]), C._ESCAPED.sub(r"\1", m[2])) for m in C._TURN.finditer(whole)] == [(r.role, r.text) for r in turns]
    with pytest.raises(ValueError):
        C.read_turn("### user: no end")


def test_digests_of_whole_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", NASTY[(c + t) % len(NASTY)] * (1 + t % 3) or None) for c in range(6) for t in range(c)] + [(None, 0, None, "q"), (9, 0, "user", "x" * 5000), (9, 0, "user", "x" * 5000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = C.read_back(C.render(C.fold(C.log_of(table)))).collect()
    for r in got:
        mine = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({c for c, *_ in rows}) and C.read_back(C.render(C.fold(C.log_of(table.limit(0))))).count() == 0
