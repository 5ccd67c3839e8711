"""Registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from llm_helpers import awkward, documents
from surgelane.llm.oracles import SQL

SMOKE = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(SQL) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    got = E.queries()[name](spark, SMOKE)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMOKE).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns)
    assert seen["language_id"].count() >= 0.99 * before.count()
    near = seen["simhash_near_dedup"]
    assert near.count() == near.select("doc_id").distinct().count() == near.select("text").distinct().count()
    assert seen["line_dedup"].count() > near.count()
    packed = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in packed) <= 2048 and sum(r[1] for r in packed) >= 0.95 * 2048 * (len(packed) - 1)
    assert docs.where("piece = 0").count() == seen["mixing"].count()


def test_stages_on_awkward_and_empty_documents(spark, tmp_path):
    for k, rows in enumerate((awkward(), [])):
        docs = documents(spark, rows, extra=True)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SMOKE).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert (docs.count() > 0) == bool(rows)
