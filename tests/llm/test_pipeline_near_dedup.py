"""Near-dedup stage of the pipeline: which rows stay."""

from __future__ import annotations

import random

import corpus_pipeline
from llm_helpers import documents, least_reachable
from surgelane.llm.simhash import fingerprint


def words(rng, n=80):
    return " ".join(f"w{rng.randrange(9000)}" for _ in range(n))


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()), key=str)


def test_rows_without_an_id_all_stay(spark):
    rng = random.Random(1)
    rows = [(None, words(rng)) for _ in range(6)]
    rows += [(None, rows[0][1]), (3, rows[0][1]), (None, None)]
    assert kept(spark, rows) == sorted(rows, key=str)


def test_an_id_with_several_texts_keeps_each(spark):
    rng = random.Random(2)
    a, b, c = (words(rng) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b), (5, c), (4, c), (4, c)]
    assert kept(spark, rows) == sorted([(1, a), (1, b), (4, c)], key=str)


def test_groups_by_fingerprint_distance(spark):
    """One row of each group of fingerprints that are 4 bits apart or fewer, chains included, by all pairs."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        base = words(rng, 250).split()
        for _ in range(8):
            w = list(base)
            for at in rng.sample(range(250), rng.randrange(0, 3)):
                w[at] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[5][1]), (len(rows) + 1, "one"), (len(rows) + 2, "one")]
    fps = {i: fingerprint(t, 4)[0] for i, t in rows}
    ids = sorted(fps)
    pairs = [(a, b) for a in ids for b in ids if b < a and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = least_reachable(ids, pairs)
    assert len(set(want.values())) < len(ids) - 30 and any((fps[i] ^ fps[want[i]]).bit_count() > 4 for i in ids)
    assert sorted(i for i, _ in kept(spark, rows)) == sorted(set(want.values()))


def test_a_hot_group_and_long_texts(spark):
    rng = random.Random(4)
    long = words(rng, 400_000)
    copies = words(rng)
    rows = [(i, copies) for i in range(500)] + [(1000, long), (1001, long + " tail")] + [(2000 + i, words(rng)) for i in range(20)]
    assert sorted(i for i, _ in kept(spark, rows)) == [0, 1000, *range(2000, 2020)]
