"""Toxic spans and toxicity scores by a linear-chain conditional random field.

A token is a run of other characters than white space, lower-cased and without punctuation at its ends. The field has two states
(1: toxic) and few inputs per token: the strength of its word, of its strongest beginning (three to seven characters), and of both
neighbours. The strength of a term is the log odds of a labelled document being toxic if it has the term; it is counted by Spark over
the documents of the fit. Labelled tokens come from labelled documents: a token of a toxic document is toxic if one of its terms is
telling, all other tokens are not. Telling terms and their strengths are counted on one part of the labelled documents and the field is
fitted on another, so terms that only happen to be rare get little weight.

The fit takes at most ``FIT_ROWS`` labelled documents, chosen by a hash of the id, and holds the labels given to it. Forward-backward
marginals of every token give a document's expected number of toxic tokens and its most likely one; a logistic regression on both gives the
score. Tokens with a marginal of at least one half are the offending spans.

Defined results: a null, empty or blank text has no tokens and gets the score of a document with no toxic token; without labelled
documents of both kinds all scores are 0; several labels of one id count as toxic if one is; null ids match no label; repeated rows get
equal scores; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugegrid.llm.common import saved, words_of

#: Labelled documents of a fit, at most; those whose tokens fit the field, at most; terms of the model, at most.
FIT_ROWS, FIELD_ROWS, TERMS = 20_000, 1_500, 20_000
#: Toxic documents with a term, at least, and its log odds, at least, for the term to be telling.
LEAST_DOCUMENTS, TELLING = 5, 2.0
#: Lengths of word beginnings that count as terms.
PREFIXES = (3, 4, 5, 6, 7)
#: Tokens that are scored at once.
_CELLS = 400_000
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¿¡–—"


def tokens(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of every token, word of every code, number of tokens of every text)."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    full = pc.list_flatten(parts).dictionary_encode()
    raw = pc.utf8_trim(pc.utf8_lower(full.dictionary), _ENDS)
    codes = full.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = raw.to_pylist()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(full.dictionary, "").to_numpy(zero_copy_only=False)
    if blank.any():  # white space at the ends of a text gives empty pieces
        keep = ~blank[codes]
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        counts, codes = np.bincount(owner, minlength=len(counts)), codes[keep]
    return codes, words, counts


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)] if len(word) > 1 else []


@dataclass
class Field:
    """Strengths of terms, weights of the token inputs, log weights of transitions, and weights of the document score."""

    strength: dict[str, float]
    weights: np.ndarray
    moves: np.ndarray
    score: np.ndarray

    def inputs(self, codes: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
        """A row per token: 1, strength of the word, of its strongest beginning, of the neighbours in the same text."""
        own = np.array([self.strength.get(w, 0.0) for w in words])
        start = np.array([max((self.strength.get(t, 0.0) for t in terms_of(w)[1:]), default=0.0) for w in words])
        out = np.zeros((len(codes), 5))
        if not len(codes):
            return out
        out[:, 0] = 1
        out[:, 1], out[:, 2] = own[codes], start[codes]
        both = np.maximum(out[:, 1], out[:, 2])
        first = np.zeros(len(codes), bool)
        begins = np.cumsum(counts) - counts
        first[begins[counts > 0]] = True
        out[1:, 3] = both[:-1] * ~first[1:]
        out[:-1, 4] = both[1:] * ~first[1:]
        return out


def marginals(odds: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many texts at once: (chance of state 1 per token, expected numbers of the four transitions).

    ``odds``: log weight of state 1 against 0 per token; ``moves``: log weights of transitions, (from, to). The messages are odds of
    state 1 against 0, so that long texts neither under- nor overflow. Texts of like length go through the chain side by side.
    """
    a = np.exp(moves)
    p, pairs = np.zeros(len(odds)), np.zeros((2, 2))
    begins = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    at = 0
    emit = np.exp(np.clip(odds, -30, 30))
    while at < len(order):
        longest = int(counts[order[at]])
        some = order[at:at + max(1, _CELLS // longest)]
        at += len(some)
        n = counts[some]
        place = begins[some][None, :] + np.arange(longest)[:, None]
        there = np.arange(longest)[:, None] < n[None, :]
        e = np.where(there, emit[np.minimum(place, len(odds) - 1)], 1.0)
        forward, back = np.empty_like(e), np.ones_like(e)
        forward[0] = e[0]
        for t in range(1, longest):
            r = forward[t - 1]
            forward[t] = e[t] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
        for t in range(longest - 2, -1, -1):
            g = e[t + 1] * back[t + 1]
            back[t] = np.where(there[t + 1], (a[1, 0] + a[1, 1] * g) / (a[0, 0] + a[0, 1] * g), 1.0)
        both = forward * back
        p[place[there]] = (both / (1 + both))[there]
        if longest > 1:
            g, r, ok = e[1:] * back[1:], forward[:-1], there[1:]
            cells = [[a[0, 0] * np.ones_like(g), a[0, 1] * g], [a[1, 0] * r, a[1, 1] * r * g]]
            total = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
            pairs += np.array([[(c / total)[ok].sum() for c in row] for row in cells])
    return p, pairs


def summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row per text: 1, log of the expected number of toxic tokens, log odds of the most likely one."""
    out = np.ones((len(counts), 3))
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, weights=p, minlength=len(counts))
    most = np.zeros(len(counts))
    np.maximum.at(most, owner, p)
    most = np.clip(most, 1e-4, 1 - 1e-4)
    out[:, 1], out[:, 2] = np.log(total + 1e-2), np.log(most / (1 - most))
    return out


def _fit_field(field: Field, x: np.ndarray, y: np.ndarray, counts: np.ndarray, steps: int = 60) -> None:
    """Maximum likelihood of labelled tokens by gradient steps with a step size per weight (RPROP)."""
    within = np.ones(len(y), bool)
    begins = (np.cumsum(counts) - counts)[counts > 0]
    within[begins] = False
    later = np.flatnonzero(within)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1], y[later]), 1)
    theta = np.concatenate([field.weights, field.moves.ravel()])
    size, before = np.full(len(theta), 0.1), np.zeros(len(theta))
    observed = x.T @ y
    for _ in range(steps):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs = marginals(x @ weights, counts, moves)
        slope = np.concatenate([observed - x.T @ p, (seen - pairs).ravel()]) - 0.1 * theta
        same = slope * before
        size = np.clip(np.where(same > 0, size * 1.3, np.where(same < 0, size * 0.5, size)), 1e-4, 1.0)
        theta = np.clip(theta + size * np.sign(slope), -12, 12)
        theta[-4] = 0.0  # only differences of the four transitions matter
        before = slope
    field.weights, field.moves = theta[:-4], theta[-4:].reshape(2, 2)


def _fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's steps."""
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0, 0.5, 0.5])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -3, 3)
    return w


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic) once for every document that has the term."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        codes, words, counts = tokens(batch.column(0))
        table = [terms_of(w) for w in words]
        ends = np.cumsum(counts)
        for i, (end, n) in enumerate(zip(ends, counts)):
            found = sorted({t for c in np.unique(codes[end - n:end]) for t in table[c]})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([int(toxic[i])] * len(found), pa.int32())], names=["term", "toxic"])


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", most: int = FIT_ROWS) -> DataFrame:
    """(text, toxic, part) of at most ``most`` labelled documents, one of each group of near copies; ``part``: 0 to 4 by a hash."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(draw < most / max(n, 1)).select(F.col("doc_id").alias("labelled_id"), "toxic")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), F.col("key") == F.col("labelled_id"))  # bounded by ``most``
    windows = F.transform(F.col("words"), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    sketch = F.coalesce(F.array_min(windows), F.lit(0)).alias("h")  # near copies mostly share it and count once
    one = rows.withColumn("words", words_of(F.col("text"))).groupBy(sketch).agg(F.max("toxic").alias("toxic"), F.min_by("text", "key").alias("text"))
    return one.select("text", "toxic", F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(5)).alias("part"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Field | None:
    """A field from the documents whose ids have labels; None without documents of both kinds."""
    rows = saved(labelled(docs, labels, text, key))
    sizes = dict(rows.groupBy("toxic").agg(F.count(F.lit(1))).collect())
    if not sizes.get(0) or not sizes.get(1):
        return None
    terms = rows.where("part > 0")
    n1, n0 = terms.select(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    odds = F.log((F.col("a") + 0.5) / (F.col("b") + 0.5)) - F.log(F.lit((n1 + 1.0) / (n0 + 1.0)))
    counted = (
        terms.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_term_rows, "term string, toxic int")
        .groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .where(F.col("a") >= min(LEAST_DOCUMENTS, max(2, n1 // 20)))
        .withColumn("odds", odds).where(F.col("odds") >= TELLING)
        .orderBy(F.desc(F.col("odds") * F.sqrt("a")), "term").limit(TERMS)
    )
    strength = {t: float(v) for t, v in counted.select("term", "odds").collect()}  # at most TERMS rows
    field = Field(strength, np.array([-3.0, 1.0, 1.0, 0.0, 0.0]), np.zeros((2, 2)), np.array([-2.0, 1.0, 0.0]))
    own = rows.where("part = 0").orderBy(F.xxhash64("text")).select("text", F.col("toxic").cast("int")).limit(FIELD_ROWS).toArrow()
    if own.num_rows == 0 or len(set(own.column(1).to_pylist())) < 2:  # too few to set some apart
        own = rows.orderBy(F.xxhash64("text")).select("text", F.col("toxic").cast("int")).limit(FIELD_ROWS).toArrow()
    toxic = own.column(1).to_numpy()
    codes, words, counts = tokens(own.column(0).combine_chunks())
    x = field.inputs(codes, words, counts)
    y = ((np.maximum(x[:, 1], x[:, 2]) > 0) & (np.repeat(toxic, counts) == 1)).astype(np.int64)
    _fit_field(field, x, y, counts)
    p, _ = marginals(x @ field.weights, counts, field.moves)
    field.score = _fit_score(summary(p, counts), toxic)
    del own
    pa.default_memory_pool().release_unused()  # the driver runs on for other stages
    return field


def _spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
    """Offsets (code points, end excluded) of neighbouring tokens with marginals of at least one half."""
    out: list[dict[str, int]] = []
    last = -2
    at = 0
    words = [w for w in pc.utf8_split_whitespace(pa.array([text]))[0].as_py() if w]
    for k, (word, chance) in enumerate(zip(words, p)):
        start = text.index(word, at)
        at = start + len(word)
        if chance >= 0.5:
            if last == k - 1:
                out[-1]["end"] = at
            else:
                out.append({"start": start, "end": at})
            last = k
    return out


def scores(docs: DataFrame, field: Field | None, text: str = "text", spans: bool = False) -> DataFrame:
    """(row, score, spans): every document as a struct of its columns, its toxicity from 0 to 1, and the offending offsets."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    parts = field and (field.strength, field.weights, field.moves, field.score)
    model = docs.sparkSession.sparkContext.broadcast(parts)  # at most TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model.value) if model.value else None
        for batch in batches:
            texts = batch.column(1)
            found, where = np.zeros(len(texts)), [[] for _ in range(len(texts))]
            step = 500
            for s in range(0, len(texts) if field else 0, step):
                some = texts.slice(s, step)
                codes, words, counts = tokens(some)
                p, _ = marginals(field.inputs(codes, words, counts) @ field.weights, counts, field.moves)
                found[s:s + step] = 1 / (1 + np.exp(-np.clip(summary(p, counts) @ field.score, -30, 30)))
                if spans:
                    ends = np.cumsum(counts)
                    for i in np.flatnonzero(np.bincount(np.repeat(np.arange(len(counts)), counts), weights=p >= 0.5, minlength=len(counts))):
                        where[s + i] = _spans(some[int(i)].as_py(), p[ends[i] - counts[i]:ends[i]])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(found), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ], names=["row", "score", "spans"])

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    return rows.mapInArrow(run, schema)


def held_out(key: str) -> Column:
    """Whether an id belongs to the fold from which no label is learnt."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted, spans) of every document, by a field that saw no label of the held-out fold."""
    field = fit(docs, labels.where(~held_out("doc_id")), text, key)
    found = scores(docs.select(key, text), field, text, spans=True)
    return found.select(
        F.col(f"row.{key}").alias(key), "score", "spans", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    ).select(key, held_out(key).alias("held_out"), "score", "predicted", "spans")


def clean_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with a score under one half, all columns as they are."""
    field = fit(docs, labels.where(~held_out("doc_id")), text, key)
    return scores(docs, field, text).where("score < 0.5").select("row.*")
