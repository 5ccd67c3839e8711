"""Feature prep, split, asymmetric loss, metrics, boosting, artifacts (phase C)."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from surgelane.config import BOOST, MODEL_FEATURES, TARGET
from surgelane.functions.loss import gradient, hessian
from surgelane.operators.boost import (
    BoostedTrees,
    Node,
    expectile,
    leaf_value,
    regularise,
    train_boosted,
    train_warm_start,
)
from surgelane.operators.evaluate import asymmetric_wmse, evaluate_predictions, top_k
from surgelane.operators.prep import column_medians, prepare_features, train_val_split
from surgelane.plans.features import feature_transform
from surgelane.plans.flagship import clean_trips
from surgelane.plans.model import evaluate_model, load_importance, save_artifacts
from surgelane.session import materialise, scratch_path
from surgelane.sources.testdata import trips_from_events, weather_from_events

FAST = replace(BOOST, n_rounds=6, learning_rate=0.3, max_depth=4, checkpoint_every=3, early_stopping_rounds=50)


@pytest.fixture(scope="module")
def feature_df(spark):
    """The features of the smallest test table, written once."""
    trips = clean_trips(trips_from_events(spark, SMOKE))
    return materialise(feature_transform(trips, weather_from_events(spark, SMOKE)), "test_features")


@pytest.fixture(scope="module")
def split(spark, feature_df):
    prepared, names = prepare_features(feature_df, keep=["trip_id"])
    return train_val_split(prepared, key="trip_id"), names


def persisted(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_grad_hess_cases(spark):
    df = spark.createDataFrame([(2.0, 1.5), (2.0, 2.5), (2.0, 2.0)], "y double, p double")
    got = [(r.g, r.h) for r in df.select(gradient(F.col("y"), F.col("p")).alias("g"),
                                         hessian(F.col("y"), F.col("p")).alias("h")).collect()]
    assert got == [(-2.0, 4.0), (1.0, 2.0), (0.0, 2.0)]


def test_weighted_mse(spark):
    df = spark.createDataFrame(list(zip([1.5, 2.0, 1.0, 3.0], [1.2, 2.5, 0.8, 2.8])), "y double, p double")
    assert math.isclose(asymmetric_wmse(df, "y", "p").first()[0], 0.1475, rel_tol=1e-12)
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y double, p double")
    assert asymmetric_wmse(perfect, "y", "p").first()[0] == 0.0


def test_medians_and_non_finite(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.5, 1), (2.0, 2.0, float("inf"), 2), (3.0, float("nan"), 2.0, 3), (10.0, None, None, 4), (None, None, 1.0, 5)],
        "hour double, day_of_week double, surge_multiplier double, row_id int",
    )
    out, names = prepare_features(df, features=["hour", "day_of_week", "month"], keep=["row_id"])
    assert names == ["hour", "day_of_week"]
    rows = {r.row_id: r for r in out.collect()}
    assert rows[5].hour == 2.5                      # median of {1, 2, 3, 10}
    assert rows[3].day_of_week == 1.5 and rows[4].day_of_week == 1.5   # NaN ignored in the median
    assert rows[2].surge_multiplier == 1.75 and rows[4].surge_multiplier == 1.75  # target median incl. inf


def test_missing_target(spark):
    with pytest.raises(ValueError, match="no target"):
        prepare_features(spark.createDataFrame([(1.0,)], "hour double"))


def test_inf_features_become_zero(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (2.0, 1.0)], "hour double, surge_multiplier double")
    out, _ = prepare_features(df, features=["hour"])
    assert sorted(r.hour for r in out.collect()) == [0.0, 2.0]


def test_medians_are_exact_over_many_partitions(spark):
    rng = np.random.default_rng(1)
    cols = {"a": rng.integers(0, 9, 2001).astype(float), "b": rng.normal(size=2001), "c": np.full(2001, 3.0)}
    cols["b"][::7] = np.nan
    rows = [tuple(None if k == "c" and i % 2 else float(v[i]) for k, v in cols.items()) for i in range(2001)]
    got = column_medians(spark.createDataFrame(rows, "a double, b double, c double").repartition(9), ["a", "b", "c"])
    assert got["a"] == np.median(cols["a"]) and got["c"] == 3.0
    assert got["b"] == np.median(cols["b"][~np.isnan(cols["b"])])
    assert column_medians(spark.createDataFrame([(None,)], "a double"), ["a"]) == {"a": None}


def test_split(feature_df):
    a = train_val_split(feature_df, key="trip_id")
    b = train_val_split(feature_df.repartition(7), key="trip_id")
    n, n_val = a.count(), a.filter("is_validation").count()
    assert abs(n_val - 0.2 * n) <= 0.05 * n
    sa = {r.trip_id for r in a.filter("is_validation").collect()}
    sb = {r.trip_id for r in b.filter("is_validation").collect()}
    assert sa == sb


def test_split_fraction_below_a_percent(spark):
    n = train_val_split(spark.range(50_000), key="id", fraction=0.004).filter("is_validation").count()
    assert 140 <= n <= 260


def test_leaf_value():
    assert leaf_value(-10.0, 4.0, 0.1, 1.0) == pytest.approx(9.9 / 5.0)
    assert leaf_value(0.05, 4.0, 0.1, 1.0) == 0.0


def test_expectile_minimises_the_loss(spark):
    rng = np.random.default_rng(2)
    y = np.round(rng.exponential(size=500), 2)
    got = expectile(spark.createDataFrame([(float(v),) for v in y], "y double"), "y", 2.0)
    balance = 2.0 * np.sum((y - got)[y > got]) - np.sum((got - y)[y <= got])
    assert abs(balance) < 1e-8
    assert expectile(spark.createDataFrame([], "y double"), "y", 2.0) == 0.0


def two_level_tree():
    return [Node("a", 0.5, 1, 4), Node("b", 1.0, 2, 3), Node(), Node(), Node()]


def test_gamma_prunes_and_gains_follow_the_sums():
    params = replace(BOOST, learning_rate=1.0, reg_alpha=0.0, reg_lambda=0.0, gamma=0.0)
    sums = {0: (-4.0, 4.0), 1: (-4.2, 4.0), 2: (8.0, 4.0)}
    full = regularise(two_level_tree(), sums, params)
    assert [n.feature for n in full] == ["a", "b", None, None, None]
    low = 0.5 * (16 / 4 + 4.2**2 / 4 - 8.2**2 / 8)
    assert full[1].gain == pytest.approx(low)
    assert full[0].gain == pytest.approx(0.5 * (8.2**2 / 8 + 64 / 4 - 0.2**2 / 12))
    pruned = regularise(two_level_tree(), sums, replace(params, gamma=0.1))
    assert [n.feature for n in pruned] == ["a", None, None] and pruned[1].value == pytest.approx(8.2 / 8)
    assert pruned[2].value == pytest.approx(-2.0)
    assert [n.feature for n in regularise(two_level_tree(), sums, replace(params, gamma=100.0))] == [None]


def test_boosting_learns(spark, split):
    df, names = split
    before = persisted(spark)
    model = train_boosted(df, names, TARGET, "is_validation", FAST)
    assert persisted(spark) == before
    val, train = [h["validation"] for h in model.history], [h["train"] for h in model.history]
    assert [h["round"] for h in model.history] == list(range(FAST.n_rounds))
    assert train[-1] < train[0] and val[-1] < val[0]
    v = df.filter("is_validation")
    # The trees score what the training measured.
    kept = asymmetric_wmse(model.predict(v), TARGET, "prediction").first()[0]
    assert kept == pytest.approx(model.history[model.best_iteration]["validation"], rel=1e-9)
    const = train_boosted(df, names, TARGET, "is_validation", FAST, n_rounds=0)
    assert const.n_trees == 0 and kept < asymmetric_wmse(const.predict(v), TARGET, "prediction").first()[0]
    # Persist, reload, score identically.
    path = scratch_path(spark, "model_test")
    model.save(spark, path)
    again = BoostedTrees.load(spark, path)
    p1 = {r.trip_id: r.prediction for r in model.predict(v).collect()}
    p2 = {r.trip_id: r.prediction for r in again.predict(v).collect()}
    assert p1 == p2 and again.trees == model.trees
    result = evaluate_model(model, v)
    m = result.metrics.first()
    assert m.n_trees == model.n_trees and m.n_features == 32 and m.rmse > 0
    top = result.top_features(20).collect()
    assert [r["rank"] for r in top] == list(range(1, len(top) + 1))
    assert [r.feature for r in m.feature_importance_top20] == [r.feature for r in top]
    gains = {}
    for tree in model.trees:
        for n in tree:
            if n.feature:
                gains.setdefault(n.feature, []).append(n.gain)
    assert {r.feature: r.importance_gain for r in result.importance.collect()} == pytest.approx({f: np.mean(g) for f, g in gains.items()})
    out = save_artifacts(spark, result, scratch_path(spark, "artifacts"))
    top = load_importance(spark, out, 10).collect()
    assert 0 < len(top) <= 10 and top[0]["rank"] == 1
    assert [r.importance_gain for r in top] == sorted((r.importance_gain for r in top), reverse=True)


def test_without_validation_rows_all_trees_stay(spark, split):
    df, names = split
    model = train_boosted(df.withColumn("is_validation", F.lit(False)), names, TARGET, "is_validation", FAST, n_rounds=2)
    assert model.n_trees == len(model.history) == 2 and model.history[-1]["validation"] is None


def test_continuing_with_another_rate_keeps_the_old_trees(spark, split):
    df, names = split
    first = train_boosted(df, names, TARGET, "is_validation", FAST, n_rounds=2, early_stopping=False)
    more = train_boosted(df, names, TARGET, "is_validation", replace(FAST, learning_rate=0.05), n_rounds=2,
                         init_model=first, early_stopping=False)
    assert more.n_trees == 4 and more.trees[:2] == first.trees and len(more.history) == 4
    scored = more.predict(df.filter("is_validation"))
    assert asymmetric_wmse(scored, TARGET, "prediction").first()[0] == pytest.approx(more.history[-1]["validation"], rel=1e-9)


def test_stopping_early_drops_the_rounds_after_the_best(spark, split):
    df, names = split
    noisy = df.withColumn(TARGET, F.when(F.col("is_validation"), F.lit(1.0)).otherwise(F.col(TARGET)))
    model = train_boosted(noisy, names, TARGET, "is_validation", replace(FAST, n_rounds=12, early_stopping_rounds=3))
    losses = [h["validation"] for h in model.history]
    assert model.n_trees == model.best_iteration + 1 == losses.index(min(losses)) + 1
    assert len(losses) <= model.n_trees + 3


def test_column_sample_and_child_weight(spark, split):
    df, names = split
    model = train_boosted(df, names, TARGET, "is_validation", replace(FAST, colsample=0.1), n_rounds=2, early_stopping=False)
    assert all(len({n.feature for n in tree if n.feature}) <= 3 for tree in model.trees)
    heavy = train_boosted(df, names, TARGET, "is_validation", replace(FAST, min_child_weight=1e9), n_rounds=1, early_stopping=False)
    assert len(heavy.trees[0]) <= 3


def test_warm_start_adds_trees_per_batch(spark, split):
    df, names = split
    params = replace(FAST, rounds_per_batch=2)
    before = persisted(spark)
    model = train_warm_start(df, names, TARGET, "is_validation", params, n_batches=3, key="trip_id")
    assert model.n_trees == len(model.history) == 6 and persisted(spark) == before
    scored = model.predict(df.filter("is_validation"))
    assert asymmetric_wmse(scored, TARGET, "prediction").first()[0] == pytest.approx(model.history[-1]["validation"], rel=1e-9)


def test_metrics_match_numpy(spark):
    y = np.array([1.0, 1.3, 2.0, 1.1, 3.0, 1.25])
    p = np.array([1.1, 1.1, 2.5, 1.0, 2.0, 1.3])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y double, p double")
    m = evaluate_predictions(df, "y", "p").first()
    r = y - p
    assert m.rmse == pytest.approx(np.sqrt(np.mean(r ** 2)))
    assert m.mae == pytest.approx(np.mean(np.abs(r)))
    assert m.r2_score == pytest.approx(1 - np.sum(r ** 2) / np.sum((y - y.mean()) ** 2))
    assert m.mape_percent == pytest.approx(np.mean(np.abs(r / y)) * 100)
    assert m.directional_accuracy_percent == pytest.approx(np.mean((y >= 1.2) == (p >= 1.2)) * 100)
    ts = y >= 1.2
    assert m.under_estimation_rate_percent == pytest.approx(np.mean(p[ts] < y[ts]) * 100)


def test_top_k_tiebreak(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0)], "feature string, importance_gain double")
    assert [r.feature for r in top_k(df, 2, "importance_gain", "feature").collect()] == ["a", "b"]


def test_all_model_features_declared():
    assert len(MODEL_FEATURES) == 32 and TARGET == "surge_multiplier"


def test_state_tables_keep_one_copy(spark):
    import os

    from surgelane.session import StateTables

    with StateTables(spark, "state_test") as tables:
        a = tables.write(spark.range(10))
        first = tables.paths[0]
        b = tables.write(a.selectExpr("id * 2 as id"))
        assert not os.path.exists(first.replace("file:", "")) and len(tables.paths) == 1
        assert sorted(r.id for r in b.collect()) == [2 * i for i in range(10)]
        last = tables.paths[0]
    assert not os.path.exists(last.replace("file:", ""))


def test_exclude_leaky_features(feature_df):
    prepared, names = prepare_features(feature_df, exclude=("demand_60min", "supply_baseline"))
    assert "demand_60min" not in names and "supply_baseline" not in names and len(names) == 30
    assert "demand_60min" not in prepared.columns and TARGET in prepared.columns


# --- growth against a plain implementation, repeats and resumed runs ---------------

def plain_boosting(x, y, params, rounds, base):
    """Trees as nested (feature, threshold, left, right, gain) or leaf values, by trying every split."""
    pen, lam, alpha = params.underestimation_penalty, params.reg_lambda, params.reg_alpha
    p, trees = np.full(len(y), base), []

    def score(g, h):
        return max(abs(g) - alpha, 0.0) ** 2 / (h + lam)

    for _ in range(rounds):
        r = y - p
        g, h = np.where(r > 0, -2 * pen * r, -2 * r), np.where(r > 0, 2 * pen, 2.0)

        def grow(rows, depth):
            G, H = g[rows].sum(), h[rows].sum()
            leaf = params.learning_rate * leaf_value(G, H, alpha, lam)
            best = (1e-6, None, None)
            for f in range(x.shape[1]) if depth < params.max_depth else ():
                values = np.unique(x[:, f])
                for t in (values[:-1] + values[1:]) / 2:
                    left = rows[x[rows, f] <= t]
                    right = rows[x[rows, f] > t]
                    if min(h[left].sum(), h[right].sum()) < max(params.min_child_weight, 1e-9):
                        continue
                    gain = 0.5 * (score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(G, H))
                    if gain > best[0] + 1e-9:
                        best = (gain, f, t)
            if best[1] is None:
                return leaf
            sides = [grow(rows[m], depth + 1) for m in (x[rows, best[1]] <= best[2], x[rows, best[1]] > best[2])]
            if not any(isinstance(s, tuple) for s in sides) and best[0] < params.gamma:
                return leaf
            return (best[1], best[2], *sides, best[0])

        def value(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        p = p + np.array([value(tree, row) for row in x])
    return trees


def nested(tree, at=0):
    n = tree[at]
    if n.feature is None:
        return pytest.approx(n.value, abs=1e-9)
    return (int(n.feature[1:]), n.threshold, nested(tree, n.left), nested(tree, n.right), pytest.approx(n.gain, rel=1e-6))


@pytest.fixture(scope="module")
def small_table(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 2, 700), rng.integers(0, 6, 700) / 2, rng.integers(-3, 9, 700)], axis=1).astype(float)
    y = np.round(1 + x[:, 0] * (x[:, 1] > 1) + 0.3 * np.abs(x[:, 2]) + rng.normal(scale=0.2, size=700), 3)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(700)]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, y double").repartition(5), x, y


@pytest.mark.parametrize("gamma,least", [(0.0, 0.0), (1.5, 40.0)])
def test_trees_equal_trying_every_split(small_table, gamma, least):
    df, x, y = small_table
    params = replace(BOOST, learning_rate=0.3, max_depth=3, subsample=1.0, colsample=1.0, gamma=gamma, min_child_weight=least, checkpoint_every=2)
    model = train_boosted(df, ["x0", "x1", "x2"], "y", None, params, n_rounds=3)
    assert model.n_trees == 3
    for tree, want in zip(model.trees, plain_boosting(x, y, params, 3, model.base_score)):
        assert want == nested(tree)


def test_repeated_and_resumed_runs_grow_the_same_trees(spark, small_table):
    df, x, _ = small_table
    params = replace(BOOST, learning_rate=0.3, max_depth=4, checkpoint_every=2, gamma=0.01)
    train = lambda rows, rounds, folder=None: train_boosted(rows, ["x0", "x1", "x2"], "y", "v", params, n_rounds=rounds, folder=folder)
    rows = df.withColumn("v", F.col("id") % 4 == 0)
    whole = train(rows, 7)
    assert train(rows.repartition(3), 7).trees == whole.trees
    folder = scratch_path(spark, "resumable")
    assert train(rows, 3, folder).trees == whole.trees[:3]
    # A checkpoint whose manifest was never written doesn't count.
    spark.range(1).write.parquet(f"{folder}/trees-000005/state")
    resumed = train(rows.where("false"), 7, folder)
    assert resumed.trees == whole.trees and resumed.history == whole.history and resumed.base_score == whole.base_score
    # A finished run has nothing more to do.
    assert train(rows.where("false"), 7, folder).trees == whole.trees
    with pytest.raises(ValueError, match="other settings"):
        train_boosted(rows, ["x0", "x1", "x2"], "y", "v", replace(params, max_depth=2), folder=folder)


def test_warm_start_goes_on_with_the_next_batch(spark, small_table):
    df, _, _ = small_table
    params = replace(FAST, rounds_per_batch=2, gamma=0.0)
    rows = df.withColumn("v", F.col("id") % 5 == 0)
    whole = train_warm_start(rows, ["x0", "x1", "x2"], "y", "v", params, 3, key="id")
    folder = scratch_path(spark, "warm_resumable")

    class Lost(Exception):
        pass

    from surgelane.operators import boost

    real, seen = boost.boost_state, []

    def dies(*a, **kw):
        seen.append(1)
        if len(seen) == 3:
            raise Lost
        return real(*a, **kw)

    boost.boost_state = dies
    try:
        with pytest.raises(Lost):
            train_warm_start(rows, ["x0", "x1", "x2"], "y", "v", params, 3, key="id", folder=folder)
    finally:
        boost.boost_state = real
    again = train_warm_start(rows.where("false"), ["x0", "x1", "x2"], "y", "v", params, 3, key="id", folder=folder)
    assert again.trees == whole.trees and again.history == whole.history


def test_late_rounds_search_no_level_below_gamma(spark, small_table):
    """Once no node's loss reaches gamma a tree is a leaf, and pruning would have left the same."""
    df, _, _ = small_table
    params = replace(BOOST, learning_rate=0.5, max_depth=6, gamma=1e9)
    assert [len(t) for t in train_boosted(df, ["x0", "x1", "x2"], "y", None, params, n_rounds=2).trees] == [1, 1]


def test_importances_from_nodes(spark, small_table):
    df, _, _ = small_table
    model = train_boosted(df, ["x0", "x1", "x2"], "y", None, replace(FAST, gamma=0.0), n_rounds=3)
    got = {r.feature: r for r in model.importances(spark).collect()}
    nodes = [n for tree in model.trees for n in tree]
    for f, r in got.items():
        own = [n for n in nodes if n.feature == f]
        assert r.weight == len(own) and r.gain == pytest.approx(np.mean([n.gain for n in own])) and r.cover == pytest.approx(np.mean([n.cover for n in own]))
        assert r.total_gain == pytest.approx(sum(n.gain for n in own)) and r.total_cover == pytest.approx(sum(n.cover for n in own))
    for tree in model.trees:
        for n in tree:
            assert n.feature is None or n.cover == pytest.approx(tree[n.left].cover + tree[n.right].cover)


def test_missing_and_infinite_values_go_right(spark):
    rows = [(float(i % 4), 1.0 + (i % 4 > 1)) for i in range(80)] + [(None, 3.0)] * 9 + [(float("nan"), 3.0)] * 9 + [(float("inf"), 3.0)] * 9
    df = spark.createDataFrame(rows, "x0 double, y double")
    model = train_boosted(df, ["x0"], "y", None, replace(FAST, subsample=1.0, colsample=1.0, gamma=0.0), n_rounds=3)
    scored = model.predict(df.where("x0 is null or isnan(x0) or x0 = double('inf')")).select("prediction").distinct().collect()
    assert len(scored) == 1 and model.history[-1]["train"] < model.history[0]["train"]


def test_split_without_a_key_plans(spark, split):
    """All features and no row key: the split is written before it is filtered."""
    from surgelane.plans.model import train_surge_model

    df, names = split
    result = train_surge_model(df.select(*names, TARGET), params=replace(FAST, n_rounds=1))
    assert result.metrics.first().n_features == 32


@pytest.mark.parametrize("rows", [0, 40, 200])
def test_large_nodes_split_by_cells_like_small_ones(small_table, monkeypatch, rows):
    """Whatever number of rows one task may finish, the trees are the same."""
    from surgelane.operators import boost

    df, _, _ = small_table
    params = replace(BOOST, learning_rate=0.3, max_depth=4, gamma=0.01)
    train = lambda: train_boosted(df.withColumn("v", F.col("id") % 4 == 0), ["x0", "x1", "x2"], "y", "v", params, n_rounds=2)
    want = train()
    monkeypatch.setattr(boost, "NODE_ROWS", rows)
    monkeypatch.setattr(boost, "REDUCER_BYTES", 1 << 10)
    got = train()
    assert got.trees == want.trees and got.history == want.history and len(want.trees[0]) > 7


@pytest.fixture(scope="module")
def long_table(spark):
    rows = spark.range(0, 100_000, 1, 5).withColumns({"x0": F.col("id") % 7 * 1.0, "x1": F.col("id") % 31 * 1.0, "v": F.col("id") % 4 == 0})
    return materialise(rows.withColumn("y", 1.0 + F.col("x0") * (F.col("x1") > 9.0).cast("double") + F.col("id") % 5 / 10.0), "long_table")


def passes(monkeypatch):
    """The passes of the runs that follow: (trees that each adds itself, most bytes of a batch that a Python worker gets of its blocks)."""
    from surgelane.operators import boost

    seen, real = [], boost.run_pass

    def counted(blocks, task, rule):
        import pyarrow as pa

        sizes = blocks.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"]) for b in batches), "size long")
        seen.append((len(task.fresh), max(r.size for r in sizes.collect())))
        return real(blocks, task, rule)

    monkeypatch.setattr(boost, "run_pass", counted)
    return seen


def test_a_round_over_some_hundred_thousand_rows_is_one_pass(long_table, monkeypatch):
    """Each pass is a job, whose fixed cost is more than such a node's work."""
    seen = passes(monkeypatch)
    params = replace(BOOST, learning_rate=0.3, max_depth=4, subsample=1.0, colsample=1.0, gamma=0.0)
    model = train_boosted(long_table, ["x0", "x1"], "y", "v", params, n_rounds=3)
    assert model.n_trees == 3 and len(model.trees[0]) > 7
    assert len(seen) == 4  # the last one measures the losses


def test_a_row_meets_a_tree_once_where_a_round_has_many_passes(small_table, monkeypatch):
    from surgelane.operators import boost

    df, _, _ = small_table
    params = replace(BOOST, learning_rate=0.3, max_depth=4, gamma=0.01, checkpoint_every=4)
    train = lambda: train_boosted(df.withColumn("v", F.col("id") % 4 == 0), ["x0", "x1", "x2"], "y", "v", params, n_rounds=6)
    want = train()
    monkeypatch.setattr(boost, "NODE_ROWS", 40)
    seen = passes(monkeypatch)
    got = train()
    assert got.trees == want.trees and got.history == want.history
    assert len(seen) > 13 and not any(trees for trees, _ in seen[:-1])


def test_blocks_reach_a_worker_some_at_a_time(long_table, monkeypatch):
    """A worker holds a few blocks, however many a partition has."""
    from surgelane.operators import boost

    spark = long_table.sparkSession
    features = [c for i in range(40) for c in (f"a{i}", f"b{i}")]
    wide = long_table.select("id", "y", "v", *[F.col(c).alias(f"{k}{i}") for i in range(40) for k, c in (("a", "x0"), ("b", "x1"))])
    monkeypatch.setattr(boost, "few_partitions", lambda rows: rows.coalesce(1))
    seen = passes(monkeypatch)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    params = replace(FAST, rounds_per_batch=1, max_depth=1)
    model = train_warm_start(wide, features, "y", "v", params, 1, key="id")
    assert model.n_trees == 1 and max(size for _, size in seen) < 6 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_small_nodes_are_gathered_by_one_pass(small_table, monkeypatch):
    """Nodes that fall small at several levels wait until the large ones are split: rows move once a round."""
    from surgelane.operators import boost

    df, _, _ = small_table
    params = replace(BOOST, learning_rate=0.3, max_depth=6, subsample=1.0, gamma=0.0, min_child_weight=0.0)
    steps = [F.col("id") >= 700 - 60 * i for i in range(1, 6)]
    rows = df.select("id", *[s.cast("double").alias(f"x{i}") for i, s in enumerate(steps)], sum(s.cast("double") for s in steps).alias("y"))
    train = lambda: train_boosted(rows, [f"x{i}" for i in range(5)], "y", None, params, n_rounds=2)
    want, gathers, real = train(), [], boost.run_pass

    def counted(blocks, task, rule):
        gathers.append(bool(getattr(task, "depths", None) or getattr(task, "small", 0)))
        return real(blocks, task, rule)

    monkeypatch.setattr(boost, "NODE_ROWS", 350)
    monkeypatch.setattr(boost, "run_pass", counted)
    got = train()
    assert got.trees == want.trees and max(len(t) for t in want.trees) >= 9
    assert sum(gathers) == 2 and len(gathers) > 5


def test_a_round_over_a_million_rows_is_one_pass(spark, monkeypatch):
    rows = spark.range(0, 800_000, 1, 8).withColumns({"x0": F.col("id") % 7 * 1.0, "x1": F.col("id") % 31 * 1.0})
    rows = materialise(rows.withColumn("y", 1.0 + F.col("x0") * (F.col("x1") > 9.0).cast("double") + F.col("id") % 5 / 10.0), "million")
    seen = passes(monkeypatch)
    params = replace(BOOST, learning_rate=0.3, max_depth=3, subsample=1.0, colsample=1.0, gamma=0.0)
    model = train_boosted(rows, ["x0", "x1"], "y", None, params, n_rounds=2)
    assert model.n_trees == 2 and len(model.trees[0]) > 5
    assert len(seen) == 3  # the last one measures the losses


def test_a_split_gains_no_more_than_the_bound():
    from surgelane.operators.histogram import Rule, may_gain, split_gains

    rng = np.random.default_rng(3)
    for alpha, lam, penalty in ((0.0, 0.0, 1.0), (0.1, 1.0, 2.0), (3.0, 0.5, 5.0)):
        for shift in (0.0, 2.0, -2.0):
            r, bins = rng.normal(shift, 0.3, 400), rng.integers(0, 16, 400)
            pos = r > 0
            w = np.where(pos, penalty, 1.0)
            g, h = -2.0 * w * r, 2.0 * w
            cells = [np.bincount(bins, v, 16)[None] for v in (g, np.ones(400), pos)]
            best = split_gains(*cells, 1.0, penalty, alpha, lam, 0.0)[0].max()
            loss = float((w * r * r).sum())
            rule = lambda gamma: Rule(alpha, lam, 0.0, gamma, 1e-6)
            assert may_gain(loss, g.sum(), h.sum(), rule(best))
            # Rows of one residual can be told apart by no split, whatever their loss.
            assert not may_gain(400 * 4.0, -2 * 400 * 2.0, 2 * 400, Rule(0.0, 0.0, 0.0, 0.1, 1e-6))


def test_features_counted_together_have_their_own_sums():
    from surgelane.operators.histogram import Bundles

    rng = np.random.default_rng(4)
    widths = [2, 256, 7, 1, 24, 256, 100, 3, 60]
    columns = [rng.integers(0, w, 3000).astype(np.uint8) for w in widths]
    pos, node, weight = rng.random(3000) < 0.3, rng.integers(0, 3, 3000), rng.integers(-99, 99, 3000)
    bundles = Bundles(widths)
    assert len(bundles.groups) < len(widths)
    sums = [np.bincount(node * size + code, weight, 3 * size).reshape(3, -1) for size, code in zip(bundles.sizes(), bundles.codes(columns, pos))]
    got = bundles.spread(sums, 256)
    for i, column in enumerate(columns):
        want = np.zeros((3, 256, 2), np.int64)
        np.add.at(want, (node, column, pos.astype(int)), weight)
        assert (got[:, i] == want).all()


def test_rows_descend_a_bin_tree():
    from surgelane.operators.histogram import BinTree

    tree = BinTree(*(np.array(a) for a in ([1, -1, 0, -1, 1, -1, -1], [9, -1, 3, -1, 200, -1, -1], [1, -1, 3, -1, 5, -1, -1], [2, -1, 4, -1, 6, -1, -1], [0.0] * 7)))
    bins = np.random.default_rng(2).integers(0, 256, (2, 500)).astype(np.uint8)
    want = np.array([1 if b <= 9 else 3 if a <= 3 else 5 if b <= 200 else 6 for a, b in bins.T])
    assert (tree.leaf(bins) == want).all() and (tree.leaf(bins, np.arange(7, 90)) == want[7:90]).all()
    assert (BinTree(*(np.array([v]) for v in (-1, -1, -1, -1, 0.0))).leaf(bins) == 0).all()
