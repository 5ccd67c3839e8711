"""Driver contract: entry(), queries(), oracle_sql() agree with DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from surgelane.sources.files import require_not_empty

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Queries without SQL (iterative training): rows-only.
ROWS_ONLY = {"train_boost", "train_warm_start", "importance_topk", "model_artifacts"}


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return v

    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["borough", "hour", "trips", "avg_surge", "max_demand_60", "max_surge",
                          "sum_zscore", "surged_trips"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_rows_only():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    from surgelane.plans.queries import QUERIES

    assert set(QUERIES) - set(sql) == ROWS_ONLY


def test_only_a_local_master_falls_back_to_a_folder_of_its_own(monkeypatch):
    import types

    import surgelane.session as session

    def missing(spark):
        raise RuntimeError("spark.checkpoint.dir is not set")

    made = []
    context = types.SimpleNamespace(master="spark://host:7077", setCheckpointDir=made.append)
    spark = types.SimpleNamespace(conf={}, sparkContext=context)
    spark.conf = types.SimpleNamespace(set=lambda *a: None)
    monkeypatch.setattr(session, "checkpoint_root", missing)
    monkeypatch.setattr(session, "ship_package", lambda spark: None)
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        context.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            E._prepare(spark)
    context.master = "local[4]"
    E._prepare(spark)
    assert len(made) == 1


def _with_oracle():
    from surgelane.plans.oracles import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", _with_oracle())
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SMALL)
    res = duck.execute(E.oracle_sql()[name])
    s_cols, s_rows = _canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    d_cols, d_rows = _canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows


def test_require_not_empty(spark):
    with pytest.raises(ValueError):
        require_not_empty(spark.createDataFrame([], "a int"), "empty")
    assert require_not_empty(spark.range(1), "one").count() == 1
