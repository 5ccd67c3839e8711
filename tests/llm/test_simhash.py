"""SimHash index against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from llm_helpers import awkward, documents, least_reachable
from surgelane.llm.simhash import arrange, close_pairs, fingerprint, gray_pattern, gray_rank, layouts, near_duplicates


def slow_fingerprint(text, k):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A b\tc d\x0be", "É b é c d e f", "same same same same same same"])
def test_fingerprint_matches_definition(text):
    assert fingerprint(text, 4)[0] == slow_fingerprint(text, 4)


def test_gray_rank_is_the_inverse_of_the_code():
    x = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (gray_rank(gray_pattern(x)) == x).all()
    order = np.sort(x)
    assert (np.bitwise_count(gray_pattern(np.arange(63, dtype=np.uint64)) ^ gray_pattern(np.arange(1, 64, dtype=np.uint64))) == 1).all()
    assert (gray_rank(gray_pattern(order)) == order).all()


@pytest.mark.parametrize("max_bits", [4, 8])
def test_two_blocks_agree_within_the_limit(max_bits):
    rng = random.Random(max_bits)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), max_bits):
            b ^= 1 << bit
        x = np.array([a, b], dtype=np.uint64)
        tops = [arrange(x, layout) >> np.uint64(64 - top) for top, layout in layouts(max_bits)]
        assert any(t[0] == t[1] for t in tops)


def test_close_pairs_prunes_nothing_it_needs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 1, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)], dtype=np.uint64)
    x = np.unique(np.concatenate([centre ^ flips, rng.integers(0, 2**64, 300, dtype=np.uint64)]))
    x = x[np.argsort(gray_rank(x))]
    i, j = close_pairs(x, None, 4)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)))}
    i, j = close_pairs(x[:200], x[200:], 4)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(near[:200, 200:]))))


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split()
        for at in rng.sample(range(len(words)), changes):
            words[at] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_components_match_all_pairs(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, 200))) for _ in range(300)]
    big = " ".join(f"w{rng.randrange(4000)}" for _ in range(400))
    texts += variants(rng, big, 250, 3) + [texts[0]] * 20 + [None, "", "   "]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    got = near_duplicates(documents(spark, list(zip(ids, texts))), shingle=4).collect()
    fps = {i: slow_fingerprint(t, 4) for i, t in zip(ids, texts)}
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    x = np.array([fps[i] for i in ids], dtype=np.uint64)
    pairs = zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4))
    assert {r.doc_id: r.component_id for r in got} == least_reachable(ids, [(ids[a], ids[b]) for a, b in pairs])


def test_top_nodes_split_over_partitions_and_runs(spark, monkeypatch):
    """All fingerprints in a few top nodes, spread over partitions."""
    from pyspark.sql import functions as F

    from surgelane.llm import simhash

    rng = np.random.default_rng(11)
    low = rng.choice(1 << 18, 9000, replace=False).astype(np.int64)
    distinct = spark.createDataFrame([(i, int(v)) for i, v in enumerate(low)], "id long, fp long").withColumn("fp2", F.lit(0).cast("long"))
    entries = simhash.index_entries(distinct, 4, False).repartitionByRange(7, "t", "g").sortWithinPartitions("t", "g")
    found = simhash.partition_links(entries, 4, 4).cache()
    met = simhash.run_links(found.where("a is null").drop("a", "b"), 4, 4)
    edges = [tuple(r) for r in found.where("a is not null").select("a", "b").union(met).distinct().collect()]
    x = low.astype(np.uint64)
    assert all(bin(int(x[a]) ^ int(x[b])).count("1") <= 72 for a, b in edges[:10])
    reach = least_reachable(list(range(9000)), edges)
    pairs = []
    for a in range(9000):
        pairs += [(a, int(b)) for b in np.flatnonzero(np.bitwise_count(x[a + 1 :] ^ x[a]) <= 1) + a + 1]
    assert all(reach[a] == reach[b] for a, b in pairs)


def test_awkward_documents(spark):
    got = near_duplicates(documents(spark, awkward(), extra=True)).collect()
    assert len(got) == len(awkward())
    part = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert part[1] == part[2] == part[3] == 1 and part[4] == 4 and part[5] == part[6] == 5
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert near_duplicates(documents(spark, [])).count() == 0


def test_second_fingerprint_finds_similar_and_leaves_others(spark):
    rng = random.Random(9)
    rows, groups = [], {}
    for g in range(40):
        base = " ".join(f"w{rng.randrange(9000)}" for _ in range(300))
        for k, t in enumerate([base, *variants(rng, base, 2, 4)]):
            rows.append((g * 10 + k, t))
            groups[g * 10 + k] = g * 10
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows), max_bits=8, max_total=24).collect()}
    assert {i: c // 10 for i, c in got.items() if c // 10 != i // 10} == {}
    assert sum(got[i] == c for i, c in groups.items()) >= 0.95 * len(groups)
