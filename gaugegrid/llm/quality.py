"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a column that is true where a document fails. Each rule's cost (seconds over a sample that is read once and kept) and
its selectivity (share of the sample it rejects) are measured; the rules then run in the order of rejections per second, as one
nested CASE, so that a document meets only the rules up to the first it fails. The order decides the work and never the
verdict: a document is kept if it fails no rule. Rules share measures (:func:`measures`), and a measure is computed only where a
rule that is reached asks for it.

Defined results: a null, empty or blank text has no words and fails the rule of the fewest words; counts of an empty text are 0;
ids are not read, so null, equal or repeated ids make no difference; all other columns pass through, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugegrid.llm.common import SPACE, words_of

#: Rows of the sample on which cost and selectivity are measured, on average, and the seed of its draw.
SAMPLE_ROWS = 200
SEED = 42
SYMBOLS = "[#*$%&|<>]"


def _repeat_starts(words: Column) -> Column:
    """Ordered positions of the three-word windows that occur twice or more in the text."""
    def starts(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(ordered: Column) -> Column:
            def equal(a: Column, k: Column) -> Column:
                before, after = F.get(ordered, k - 1), F.get(ordered, k + 1)
                return F.coalesce(before["h"] == a["h"], F.lit(False)) | F.coalesce(after["h"] == a["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(ordered, equal), lambda p: p["i"]))

        repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
        found = F.flatten(F.transform(F.array(pairs), twice))
        return F.when(repeated, found).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.array(_windows(words)), starts))


def _windows(words: Column) -> Column:
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(hashes, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def _covered(starts: Column) -> Column:
    """Words inside windows of three that begin at the ordered positions."""
    def step(at: Column, k: Column) -> Column:
        return F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - at, F.lit(3)))

    return F.aggregate(F.transform(starts, step), F.lit(0).cast("long"), lambda a, x: a + x)


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The measures of the contract, by name; ``words`` and ``lines`` are columns that already hold the parts of ``text``."""
    spoken = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != "")
    covered = F.flatten(F.transform(F.array(_repeat_starts(words)), lambda s: F.array(_covered(s))))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long"),
        "n_repeat_words": F.get(covered, F.lit(0)).cast("long"),
    }


def rules(m: Mapping[str, Column], text: Column) -> dict[str, Column]:
    """The rules of :func:`measures`, true where a document fails."""
    letters = F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))
    return {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "many_symbols": 20 * m["n_symbols"] > 7 * m["n_words"],
        "repeated_lines": (m["n_dup_lines"] > 3) & (100 * m["n_dup_lines"] > 50 * F.size(F.split(text, "\n"))),
        "short_words": m["word_chars"] < 2 * m["n_words"],
        "long_words": m["word_chars"] > 25 * m["n_words"],
        "capitals": 100 * letters > 70 * m["word_chars"],
    }


def sampled(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` texts drawn from all partitions alike, in one partition."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    rows = docs.select(F.col(text).alias("text")).sample(share, SEED).collect()
    return docs.sparkSession.createDataFrame(rows, "text string").coalesce(1)


def cascade_order(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, repeats: int = 2) -> list[str]:
    """Names of the rules, most rejections per second of work first; the work of a rule is its shortest run less that of a rule that is no work."""
    sample = _parts(sampled(docs, text, sample_rows), "text").persist()

    def timed(fails: Column) -> tuple[int, float]:
        seconds = []
        for _ in range(repeats):
            began = time.perf_counter()
            rejected = sample.select(F.count_if(fails)).first()[0]
            seconds.append(time.perf_counter() - began)
        return rejected, min(seconds)

    try:
        n = max(sample.count(), 1)
        _, idle = timed(F.col("text").isNull())
        worth = {}
        for name, fails in _rules_of_parts().items():
            rejected, seconds = timed(fails)
            worth[name] = (rejected / n) / max(seconds - idle, 1e-6)
    finally:
        sample.unpersist()
    return sorted(worth, key=lambda name: -worth[name])


def _parts(docs: DataFrame, text: str) -> DataFrame:
    """``row`` with all columns as they are, and beside it the text and its parts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"), whole.alias("text"), words_of(F.col(text)).alias("words"), F.split(whole, "\n").alias("lines")
    )


def _rules_of_parts() -> dict[str, Column]:
    text = F.col("text")
    return rules(measures(text, F.col("words"), F.col("lines")), text)


def first_failed(order: list[str], fails: Mapping[str, Column]) -> Column:
    """Name of the first rule a document fails, null where it fails none; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(fails[name], F.lit(name)).otherwise(verdict)
    return verdict


def _of_parts(then) -> Column:
    """``then(text, words, lines)`` of a row. The parts are bound once: a filter on the result is pushed below the projection that makes
    them, and would otherwise cut the text anew for every word."""
    bound = F.array(F.struct(F.col("text").alias("t"), F.col("words").alias("w"), F.col("lines").alias("l")))
    return F.get(F.transform(bound, lambda p: then(p["t"], p["w"], p["l"])), F.lit(0))


def judged(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """(row, failed_rule): every document as a struct of its columns, and the first rule it fails, null where it is kept."""
    order = order or cascade_order(docs, text)
    verdict = _of_parts(lambda t, w, n: first_failed(order, rules(measures(t, w, n), t)))
    return _parts(docs, text).select("row", verdict.alias("failed_rule"))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """(key, the measures, base_failed, kept): the measures of every document, and the verdict of the cascade over them."""
    order = order or cascade_order(docs, text)
    found = _of_parts(lambda t, w, n: F.struct(*[c.alias(name) for name, c in measures(t, w, n).items()]))
    parts = _parts(docs.select(key, text), text).select("row", "text", found.alias("m"))
    fails = rules({name: F.col(f"m.{name}") for name in NAMES}, F.col("text"))
    return parts.select(
        F.col(f"row.{key}").alias(key), *[f"m.{name}" for name in NAMES], (fails["few_words"] | fails["repeated_words"]).alias("base_failed"),
        first_failed(order, fails).isNull().alias("kept"),
    )


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that fail no rule, with their columns."""
    return judged(docs, text).where("failed_rule IS NULL").select("row.*")
