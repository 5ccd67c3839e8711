"""Embedding near-dedup, exact search and components against brute force."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import least_reachable
from surgelane.llm import crosspolytope, kdtree
from surgelane.llm.graph import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, dim=64, groups=40):
    centres = rng.normal(size=(groups, dim))
    out = []
    for i in range(n):
        g = rng.integers(0, groups * 3)
        v = centres[g] + rng.normal(size=dim) * rng.choice([0.1, 0.25, 0.35]) if g < groups else rng.normal(size=dim)
        out.append((i * 2, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    return out


BAD = [
    (9001, None, 1), (9002, [], 1), (9003, [0.0] * 4, 1), (9004, [1.0, None, 0.0, 0.0], 1), (9005, [1.0, math.nan, 0.0, 0.0], 1),
    (9006, [1.0, math.inf, 0.0, 0.0], 1), (9007, [1.0, 0.0, 0.0, 0.0], None), (9008, [1.0, 0.0, 0.0, 0.0], 1),
    (9009, [2.0, 0.0, 0.0, 0.0], 1), (9010, [2.0, 0.0, 0.0, 0.0], 1), (9011, [1.0, 0.0, 0.0], 1), (9012, [-1.0, 0.0, 0.0, 0.0], 1),
    (9013, [1e-30, 0.0, 0.0, 0.0], 1), (9014, [5.0], 2), (9015, [3.0], 2), (9016, [-3.0], 2),
]


def fit(row):
    v = row[1]
    return row[2] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.93):
    good = [r for r in rows if fit(r)]
    links = []
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                x, y = np.array(good[a][1]), np.array(good[b][1])
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    links.append((good[a][0], good[b][0]))
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    least = least_reachable([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], least[r[0]], least[r[0]] == r[0]) for r in rows}


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("space", "copies", "id", "t", "bucket", "node")})
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in crosspolytope.near_duplicates(df).collect()}


def test_links_match_all_pairs(spark):
    rows = vectors(np.random.default_rng(1), 700) + BAD
    assert result(spark, rows) == brute(rows)


def test_a_large_bucket_is_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "CHUNK", 32)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.normal(size=16) * 0.05], 1) for i in range(200)]
    rows += [(500 + i, rows[0][1], 1) for i in range(30)]
    assert result(spark, rows) == brute(rows)


def test_packed_vectors_keep_their_precision():
    rng = np.random.default_rng(9)
    for row in (rng.normal(size=7).astype(np.float32).astype(float), rng.normal(size=7), np.array([1e300, 0.0])):
        data = crosspolytope.pack_vector(row)
        assert np.array_equal(crosspolytope.unpack_vector(pa.scalar(data, pa.binary()), len(row)), row)
    assert len(crosspolytope.pack_vector(np.array([0.5, 1.0]))) == 8


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = crosspolytope.hadamard(x)
    assert np.allclose(y @ y.T, x @ x.T) and np.allclose(crosspolytope.hadamard(y), x)


@pytest.mark.parametrize(("dim", "least"), [(64, 0.995), (128, 0.99), (384, 0.98), (1024, 0.95)])
def test_recall_at_the_threshold(dim, least):
    """Pairs at cosine 0.93 exactly meet in a bucket nearly always."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(2000, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z
    at_x, at_y = crosspolytope.meets(crosspolytope.bucket_numbers(x), crosspolytope.bucket_numbers(y))
    assert (at_x | at_y).any(axis=1).mean() >= least


def test_empty_embeddings(spark):
    assert crosspolytope.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def slow_top(rows, k):
    good = [(i, np.floor(np.array(v, dtype=float) * 64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [100, 10_000])
def test_top_k_matches_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(kdtree, "LEAF", 16)
    rng = np.random.default_rng(3)
    rows = vectors(rng, 600, dim=8)
    rows += [(3000 + i, rows[0][1], 1) for i in range(60)]  # ties
    rows += BAD + [(None, [1.0] * 8, 1), (20_000, [7.0], 1), (20_020, [0.5] * 5, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash"))
    got = kdtree.top_k(kdtree.scaled(df), 20, shard_rows).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == slow_top(rows, 20)


def test_tree_prunes_but_misses_nothing():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(5000, 3)) * 64)
    tree = kdtree.Tree(np.arange(5000), x)
    q = np.floor(rng.normal(size=3) * 64)
    ids, scores = tree.search(17, q, tree.bounds(q[None])[0], 20, kdtree.NONE)
    want = sorted((-s, i) for i, s in enumerate((x @ q).tolist()) if i != 17)[:20]
    assert list(zip((-scores).tolist(), ids.tolist())) == want
    assert len(tree.spans) > 20


def test_cells_deal_every_row_and_split_ties():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(4000, 5)) * 8)
    x[:2500] = x[0]  # a hot vector: more than half of the rows tie on every side
    cells = kdtree.Cells(x, 100)
    cell = cells.of(x)
    assert set(cell) == set(range(cells.n)) and np.bincount(cell[2500:]).max() <= 100
    assert len(set(cell[:2500])) == 1
    assert len(set(kdtree.Cells(x[:50] * 0, 1).of(x))) == 1


@pytest.mark.parametrize("boxes", [3, 1024])
def test_top_k_over_many_shards_and_hot_copies(spark, monkeypatch, boxes):
    """Clusters, copies of one vector beyond a shard, small box groups, split visits."""
    monkeypatch.setattr(kdtree, "BOXES", boxes)
    monkeypatch.setattr(kdtree, "VISITS", 2)
    monkeypatch.setattr(kdtree, "SAMPLE", 300)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 5
    rows = [(i, [float(np.float32(v)) for v in centres[i % 12] + rng.normal(size=6) * 0.1], 1) for i in range(600)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)]
    got = kdtree.top_k(kdtree.scaled(spark.createDataFrame(rows, SCHEMA)), 20, 40).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == slow_top(rows, 20)


def test_boxes_prune_visits_before_vectors_move(spark):
    """Queries of separate clusters visit no shard that their k-th score rules out."""
    parts = [(p, p * 10 + i, [64 * (p == 0) + i, 64 * (p == 1) + i, 64 * (p == 2) + i]) for p in range(3) for i in range(5)]
    rows = spark.createDataFrame([(3, p, v, x, 0.0) for p, v, x in parts], "dim int, part long, vec_id long, x array<long>, more double")
    shards = kdtree.packed(rows)
    boxes = shards.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("part", "low", "high"))).alias("boxes"))
    for kth, want in ((4096.0, 0), (kdtree.NONE, 2)):
        blocks = kdtree.packed(rows.where("part = 0").withColumn("more", F.lit(kth)))
        met = [kdtree.visits(blocks, boxes, first).collect() for first in (True, False)]
        assert sum(len({r.part for r in m}) for m in met) == want
        assert all(r.part != 0 for m in met for r in m)


def test_top_k_of_nothing(spark):
    assert kdtree.top_k(kdtree.scaled(spark.createDataFrame([], SCHEMA))).count() == 0
    assert kdtree.top_k(kdtree.scaled(spark.createDataFrame([(20, [1.0], 1)], SCHEMA))).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 200)] + [(7, 7), (3, 9), (9, 3), (3, 9), (600, 150)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == least_reachable(sorted(nodes), [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
