"""The queries of the training-data operators and, where SQL can express them, the same queries as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugegrid.llm import (
    byte_bpe, chat_events, hard_negatives, licences, line_runs, packing, perfect_hash, periodic_runs, piece_bpe, quality, resharding, simhash, toxicity,
)
from gaugegrid.llm.common import saved, shared_folder, table, words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve shards by source become eight; the first eight keep their places. Changed shards are rewritten and their rows read back."""
    docs, old = table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("source"), F.lit(12))
    home = {str(k): k if k < 8 else None for k in range(12)}
    moves = resharding.plan_moves(docs, old, home, shards=8)
    changed, path = moves.changed(home), f"{shared_folder(spark)}/gaugegrid-shards-{uuid.uuid4().hex}"
    placed = resharding.place(docs, old, moves)
    if changed:
        whole = resharding.place(docs, old, moves, carry=True)
        resharding.rewrite_shards(whole, changed, path, moves.filled())
        written = spark.read.schema(whole.schema).parquet(path).select(placed.columns)
        stayed = [k for k in range(8) if k not in changed]
        placed = placed.where(F.col("shard").isin(stayed)).unionByName(written) if stayed else written
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
    )


@query
def op4_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_events.read_back(chat_events.render(chat_events.fold(chat_events.log_of(rows))))


SQL["op4_event_chat"] = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), t AS (
  SELECT *, '### ' || regexp_replace(role, '(\\\\|###|</turn>|:)', '\\\\\\1', 'g') || ': '
    || regexp_replace(text, '(\\\\|###|</turn>)', '\\\\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op5_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfect_hash.exact_dedup(*perfect_hash.halves(table(spark, sf_dir, "documents"))).drop("known")


SQL["op5_perfect_hash_dedup"] = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query
def op6_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


SQL["op7_rule_cascade"] = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    len(string_split(coalesce(text, ''), chr(10))) AS n_lines
  FROM documents
), pos AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM pos
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (SELECT unnest(range(0, 3)) AS k) WHERE win.n > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, t, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, n_lines,
    length(t) - length(regexp_replace(t, '\\p{Lu}+', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 20 * n_symbols > 7 * n_words OR (n_dup_lines > 3 AND 100 * n_dup_lines > 50 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * n_upper > 70 * word_chars) AS kept
FROM b
"""


@query
def op8_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


SQL["op8_licence_sentences"] = licences.scan_sql()


@query
def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.without_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL["op9_line_runs"] = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op11_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip(table(spark, sf_dir, "documents"), piece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model")))


@query
def op12_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text in ten repeats a beginning of its words from word a on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = words_of(F.col("text"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))), " ")

    planted = F.when((h % 10 == 0) & (F.size(words) > 0), F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(F.col("text"))
    found = periodic_runs.periodic_runs(docs.withColumn("text", planted))
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


@query
def op13_str_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in seven has its label moved on, as a wrong label."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)
