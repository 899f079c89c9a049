"""SentencePiece encoding (merge-type vocabularies) by a table of last tokens, and decoding.

In a merge-type vocabulary two neighbouring tokens merge if their concatenation is a piece, pieces of better score first, then from the left.
Every prefix of a text then has one encoding, and the encoding of a longer text begins with the encoding of what stands before its last
token. So a table with the last token of every prefix holds all encodings:

* an Aho-Corasick automaton over the pieces names the tokens of several characters that end at a character;
* such a token is the last one of the prefix if it is compatible with the last token of what stands before it: encoded together, the two stay
  apart (:class:`Merges`: the merges at the inner edges of both, in the order of their scores, against the merges across the border);
* exactly one token passes, the character itself if no longer one does; the ids are read backwards from the end of the table.

The table takes a step per character, however long the text. Where no piece can cross a border (before white space that follows other
characters, around characters that are in no longer piece), a text is cut first, and a task remembers the ids of short chunks.

Characters without a piece become the ids of their bytes. Decoding joins pieces and bytes; bytes that are no UTF-8 become U+FFFD one by one.

Defined results: a null text counts as empty and has no ids; repeated rows and null ids each get their own result; an empty table gives an
empty result; other columns are not read. A vocabulary that this cannot encode right (no merge type, no bytes, pieces that the library takes apart
again or matches first, a normalizer that changes characters) is an error.
"""

from __future__ import annotations

import codecs
import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The mark that stands for a space.
MARK = "▁"
#: Chunks of at most so many characters are remembered, so many of them and so many tested pairs in a task.
SHORT, CHUNKS, TESTED = 64, 200_000, 300_000
#: Characters of a chunk whose part of the table is remembered for other chunks that begin the same, and how many such parts in a task.
HEAD, HEADS = 6, 100_000
#: Bytes of ids that leave a task at once, and ids that are decoded at once beside those of the last row.
BATCH_BYTES, BATCH_IDS = 1 << 21, 1 << 19


@dataclass(frozen=True)
class Model:
    """``pieces``: the string of every id; ``rank``: of every piece that merges can make, lower is earlier; ``byte_ids``: of the 256 bytes."""

    pieces: list[str]
    rank: dict[str, float]
    token: dict[str, int]
    byte_ids: list[int]
    prefixed: bool


def read_model(path: str) -> Model:
    """The model of a file of the sentencepiece library, read where the query is planned."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm, kinds = model.normalizer_spec, [p.type for p in model.pieces]
    bpe = model.trainer_spec.model_type == proto.TrainerSpec.BPE
    if not bpe or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or {4, 5} & set(kinds):
        raise ValueError("a merge-type vocabulary with bytes and without user-defined or unused pieces is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("a normalizer that only marks spaces is needed")
    normal = [k for k, kind in enumerate(kinds) if kind == 1]
    names = [p.piece for p in model.pieces]
    by_byte = {int(names[k][3:5], 16): k for k, kind in enumerate(kinds) if kind == 6}
    return Model(
        names, {names[k]: -model.pieces[k].score for k in normal}, {names[k]: k for k in normal}, [by_byte[b] for b in range(256)],
        norm.add_dummy_prefix,
    )


def merged(text: str, rank: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The symbols that all merges leave of a short text, and the two sides of the last merge."""
    parts, last = list(text), None
    while True:
        found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not found:
            return parts, last
        _, i = min(found)
        last = (parts[i], parts[i + 1])
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def splits(rank: dict[str, float]) -> dict[str, tuple[str, str] | None]:
    """The last merge of every piece that merges make, None for single characters; pieces that merges never leave whole are left out."""
    out: dict[str, tuple[str, str] | None] = {c: None for piece in rank for c in piece}
    for piece in rank:
        if len(piece) > 1:
            parts, last = merged(piece, rank)
            if len(parts) == 1:
                if any(len(side) > 1 and rank[side] > rank[piece] for side in last):
                    raise ValueError(f"{piece!r} merges before its parts")
                out[piece] = last
    return out


class Merges:
    """Tests of pairs: do two tokens side by side stay apart?"""

    def __init__(self, split: dict[str, tuple[str, str] | None], rank: dict[str, float]):
        self.split, self.rank, self.edges = split, rank, ({}, {})

    def edge(self, token: str, side: int) -> list[tuple[float, str]]:
        """(rank, symbol) of what stands at the left (0) or right (1) end of a token while it is merged, and an end mark."""
        known = self.edges[side].get(token)
        if known is None:
            known, at = [(float("inf"), "")], token
            while at is not None:
                parts = self.split[at]
                known.append((self.rank[at] if parts else float("-inf"), at))
                at = parts and parts[side]
            known.reverse()
            self.edges[side][token] = known
        return known

    def apart(self, first: str, second: str) -> bool:
        left, right, i, j = self.edge(first, 1), self.edge(second, 0), 0, 0
        while True:
            across = self.rank.get(left[i][1] + right[j][1])
            before, after = left[i + 1][0], right[j + 1][0]
            if across is not None and across < before and across <= after:  # of equal ranks, the left one merges first
                return False
            if before <= after:
                if before == float("inf"):
                    return True
                i += 1
            else:
                j += 1


def _none_of(chars: set[str]) -> str:
    return "[^" + "".join(map(re.escape, sorted(chars))) + "]"


def chunk_patterns(rank: dict[str, float]) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of chunks that no piece reaches over. Coarse ones are cheap to find: ASCII characters that are in no longer piece, and marks with what
    follows them. Fine ones cut these once more before punctuation, if no piece has such a character before punctuation."""
    if any(MARK in piece.lstrip(MARK) for piece in rank):
        return re.compile(".+", re.S), re.compile(".+", re.S)
    used = {c for piece in rank if len(piece) > 1 for c in piece}
    alone = {c for c in map(chr, range(128)) if c not in used}
    coarse = f"{MARK}*{_none_of(alone | {MARK})}+|{MARK}+|."
    marks = set(string.punctuation) - alone
    joined = {piece[i - 1] for piece in rank for i in range(1, len(piece)) if piece[i] in marks} | marks | alone | {MARK}
    some = "[" + "".join(map(re.escape, sorted(marks))) + "]"
    fine = f"{MARK}*{_none_of(marks | alone | {MARK})}*{_none_of(joined)}(?={some})|" if marks else ""
    return re.compile(coarse, re.S), re.compile(fine + coarse, re.S)


class Encoder:
    """What a task needs to encode texts: automaton, pairs tested so far, chunks met so far."""

    def __init__(self, model: Model, split: dict[str, tuple[str, str] | None]):
        self.model, self.names = model, list(split)
        self.ids = [model.token.get(name, -1) for name in self.names]
        self.merges, self.chunks, self.heads = Merges(split, model.rank), {}, {}
        self.width = max(map(len, self.names)).bit_length()
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.single, self.after, self.tested = {}, {}, 0
        for k, name in enumerate(self.names):  # a token is its number and its length
            token = k << self.width | len(name)
            self.after[token] = {}  # tokens that were tested after it
            if len(name) == 1:
                self.single[name] = token
            else:
                self.find.add_word(name, token)
        if not len(self.find):
            self.find.add_word("\0\0", -1)  # an automaton without words cannot be asked
        self.find.make_automaton()
        self.coarse, self.fine = chunk_patterns(model.rank)

    def last_tokens(self, text: str) -> list[int]:
        """For every character the last token of the text up to it, itself if no longer one passes; -1 for a character that is in no piece."""
        single, after, done, full = self.single, self.after, -1, (1 << self.width) - 1
        last = [single.get(c, -1) for c in text]
        tested = [after.get(token) for token in last]
        tested.append(None)  # the end of the list is before the text
        head = self.heads.get(text[:HEAD])
        if head:
            last[:HEAD], tested[:HEAD] = head
            done = HEAD - 1
        for end, token in self.find.iter(text):  # longest first at every end
            if end <= done or token < 0:
                continue
            known = tested[end - (token & full)]
            if known is not None:
                passed = known.get(token)
                if passed is None:
                    before = last[end - (token & full)]
                    passed = known[token] = self.merges.apart(self.names[before >> self.width], self.names[token >> self.width])
                    self.tested += 1
                if not passed:
                    continue
            last[end], tested[end] = token, after[token]
            done = end
        if not head and len(text) > HEAD:
            if len(self.heads) >= HEADS:
                self.heads.clear()
            self.heads[text[:HEAD]] = last[:HEAD], tested[:HEAD]
        return last

    def chunk(self, text: str) -> list[int]:
        last, out, at, full = self.last_tokens(text), [], len(text) - 1, (1 << self.width) - 1
        while at >= 0:
            token = last[at]
            k = self.ids[token >> self.width] if token >= 0 else -1
            if k >= 0:
                out.append(k)
                at -= token & full
            else:
                out.extend(self.model.byte_ids[b] for b in reversed(text[at].encode()))
                at -= 1
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        if not text:
            return b""
        chunks = self.chunks
        if len(chunks) > CHUNKS:
            chunks.clear()
        if self.tested > TESTED:
            self.tested = 0
            for known in self.after.values():
                known.clear()
        parts = self.coarse.findall((MARK if self.model.prefixed else "") + text.replace(" ", MARK))
        out = list(map(chunks.get, parts))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = self.remembered(parts[k], self.fine.findall(parts[k]))
        return b"".join(out)

    def remembered(self, part: str, finer: list[str]) -> bytes:
        ids = self.chunks.get(part)
        if ids is None:
            if len(finer) > 1:
                ids = b"".join([self.remembered(x, [x]) for x in finer])
            else:
                ids = array("i", self.chunk(part)).tobytes()
            if len(part) <= SHORT:
                self.chunks[part] = ids
        return ids


def encoded(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model, splits(model.rank)))  # the vocabulary: the same at every size of the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for batch in batches:
            row = 0
            while row < len(batch):  # some rows at a time, so that ids of long texts do not pile up
                first, size, found = row, 0, []
                while row < len(batch) and size < BATCH_BYTES:
                    found.append(encoder.encode(batch.column(1)[row].as_py() or ""))
                    size += len(found[-1])
                    row += 1
                ends = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.array(np.frombuffer(b"".join(found), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, row - first), lists], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def portions(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose lists in column ``at`` begin within the same :data:`BATCH_IDS` entries, so that memory follows these and
    the longest row, not the number of rows of a batch."""
    sizes = np.nan_to_num(batch.column(at).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    turns = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // BATCH_IDS)) + 1
    edges = [0, *turns.tolist(), len(batch)]
    for first, end in zip(edges, edges[1:]):
        yield batch.slice(first, end - first)


def decoded(rows: DataFrame, model: Model, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text that the ids stand for; null ids give null."""
    number = {k: b for b, k in enumerate(model.byte_ids)}
    controls = {k for k in range(len(model.pieces)) if k not in number and model.pieces[k] not in model.token}
    table = [b"" if k in controls else bytes([number[k]]) if k in number else p.replace(MARK, " ").encode() for k, p in enumerate(model.pieces)]
    # every id a second time, without the mark that encoding puts before a text
    first = [t[1:] if model.prefixed and k not in number and p[:1] == MARK else t for k, (t, p) in enumerate(zip(table, model.pieces))]
    sent = rows.sparkSession.sparkContext.broadcast((table + first, np.isin(np.arange(len(table)), list(controls))))
    at, schema = rows.columns.index(ids), StructType([*rows.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("byte_by_byte", lambda e: ("�", e.start + 1))
        table, silent = sent.value
        pieces = pa.array(table, pa.large_binary())
        for batch in (part for whole in batches for part in portions(whole, at)):
            lists = batch.column(at)
            numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            heard = np.flatnonzero(~silent[numbers])  # ids that stand for something; the first of each row loses its mark
            opening = np.searchsorted(heard, ends[:-1])
            some = np.flatnonzero(opening < len(heard))
            some = some[heard[opening[some]] < ends[1:][some]]
            numbers[heard[opening[some]]] += len(silent)
            spelled = pieces.take(pa.array(numbers))
            cuts = np.frombuffer(spelled.buffers()[1], np.int64, len(numbers) + 1, spelled.offset * 8)[ends]
            data = spelled.buffers()[2]
            whole = memoryview(data) if data else memoryview(b"")
            texts = [bytes(whole[a:b]).decode("utf-8", "byte_by_byte") for a, b in zip(cuts.tolist(), cuts.tolist()[1:])]
            made = pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row."""
    back = decoded(encoded(docs, model, text, key), model)
    return back.select(
        key, F.size("ids").cast("long").alias("n_tokens"), digest_of(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def digest_of(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
