"""The pipeline against brute force, stage by stage, and the queries of the subpackage against their SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from tests.llm.helpers import frame
from tidemark.llm import near_dedup
from tidemark.llm.exact_dedup import LOWER, UPPER
from tidemark.llm.mixing import mix
from tidemark.llm.quality_rules import judged
from tidemark.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@needs_tables
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r._row.doc_id: r._row.text for r in judged(docs, keep=["doc_id", "text"]).where("_kept").collect()}
    last = {}
    for i, t in sorted(good.items()):
        last[t.translate(str.maketrans(UPPER, LOWER))] = i
    exact = sorted(last.values())
    sets, near = {}, []
    for i in exact:
        keys, weights, _ = near_dedup.shingles(good[i])
        if all(near_dedup.similarity((keys, weights), sets[j]) < near_dedup.SIMILAR for j in near):
            near.append(i)
        sets[i] = (keys, weights)
    kept = docs.where(docs["doc_id"].isin(near))
    taken = {r._row.doc_id: (r._taken, len(r._copies)) for r in mix(kept, keep=["doc_id"]).collect()}
    found = corpus_pipeline.run(spark, SF).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {i: (sum(len(r.text.split()) for r in rows), len(rows)) for i, rows in by_id.items()} == {i: x for i, x in taken.items() if x[1]}
    assert all(len(r.token_ids) == r.n_tokens for r in found)


def test_stages_keep_columns_and_empty_tables(spark):
    df = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(rows) == 200 and sorted(r.doc_id for r in rows) == list(range(200))
    if name in ORACLES:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
        columns = sorted(df.columns)
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(repr([r[c] for c in columns]) for r in rows) == sorted(repr(list(r)) for r in expected)
