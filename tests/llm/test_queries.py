"""Queries with SQL against DuckDB, and the pipeline against its stages."""

from pathlib import Path

import pytest

import corpus_pipeline
from gaugegrid.llm.common import shared_folder
from gaugegrid.llm.queries import QUERIES, SQL
from tests.compare import connect, differences
from tests.llm.conftest import EDGE, documents

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, DIRECTORY), connect(DIRECTORY), SQL[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_simhash_pigeonhole", "op3_min_cost_flow", "op6_crf_toxicity", "op10_byte_bpe"])
def test_a_row_for_every_document(spark, name):
    rows = QUERIES[name](spark, DIRECTORY).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == spark.read.parquet(f"{DIRECTORY}/documents.parquet").count()


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIRECTORY)
        out.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert left.columns == docs.columns and 0 < left.count() <= docs.count() and left.exceptAll(docs).count() == 0
            docs = left
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    packed = corpus_pipeline.run(spark, DIRECTORY).collect()
    assert len({p.name for p in folder.iterdir()} - before) == 1  # the result
    assert sorted(map(str, packed)) == sorted(map(str, left.collect()))
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (EDGE, []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DIRECTORY)
        assert docs.columns == documents(spark, []).columns
        corpus_pipeline.STAGES[-1][1](spark, docs, DIRECTORY).collect()
