"""Winnowed fingerprints against a direct definition; edited texts against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from llm_helpers import awkward, documents
from surgelane.llm import winnowing
from surgelane.llm.winnowing import _gram_hashes, digest, edited_fingerprints, fingerprints, likeness, winnow


def direct(text, gram, window):
    """Positions by the definition: the rightmost least gram hash of every window."""
    points = np.array([ord(c) for c in text], np.uint32)
    if not len(points):
        return []
    gram = min(gram, len(points))
    h = [int(_gram_hashes(points[i : i + gram], gram)[0]) for i in range(len(points) - gram + 1)]
    window = min(window, len(h))
    return sorted({max(range(i, i + window), key=lambda j: (-h[j], j)) for i in range(len(h) - window + 1)})


@pytest.mark.parametrize("gram,window", [(1, 1), (3, 4), (5, 7), (16, 16)])
def test_positions_by_definition(gram, window):
    rng = random.Random(gram)
    for n in (0, 1, 2, gram, gram + window - 2, gram + window - 1, 200):
        for letters in ("ab", "abcdefgé𝒳 "):
            text = "".join(rng.choice(letters) for _ in range(max(0, n)))
            assert winnow(text, gram, window)[0].tolist() == direct(text, gram, window)


def test_steps_of_long_texts(monkeypatch):
    text = " ".join(f"w{i * i % 991}" for i in range(900))
    whole = winnow(text)
    monkeypatch.setattr(winnowing, "STEP", 64)
    stepped = winnow(text)
    assert [a.tolist() for a in whole] == [a.tolist() for a in stepped]


def test_shared_passages_share_a_hash_at_their_place():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    length = winnowing.GRAM + winnowing.WINDOW - 1
    for _ in range(50):
        passage = "".join(rng.choice("klmnopq ") for _ in range(length))
        a, b = f"{word()}{passage}{word()} {word()}", f"{word()} {word()} {word()}{passage}"
        (pa, ha), (pb, hb) = winnow(a), winnow(b)
        at_a, at_b = a.index(passage), b.index(passage)
        inside = lambda p, h, at: {(int(x) - at, int(y)) for x, y in zip(p, h) if at <= x <= at + length - winnowing.GRAM}
        assert inside(pa, ha, at_a) & inside(pb, hb, at_b)


def brute(rows):
    """Rows (doc_id, text) in the operator's order, each with the results."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        own, changed, after = winnow(text), winnow(new), winnow(following)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), digest(*own), digest(*changed), likeness(own[1], changed[1]), likeness(own[1], after[1])))
    return out


def order(spark, docs):
    """Descending id, none last; rows of one id by the hash of their text."""
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))]


@pytest.mark.parametrize("parts", ["1", "3", "50"])
def test_edited_fingerprints(spark, parts):
    docs = documents(spark, awkward() + [(100 + i, f"number {i} " * (i % 9), "en", "s") for i in range(60)], extra=True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in edited_fingerprints(docs.repartition(4)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(brute(order(spark, docs)), key=str)


def test_empty_and_single(spark):
    assert edited_fingerprints(documents(spark, [])).collect() == []
    row = edited_fingerprints(documents(spark, [(1, "abcdef")])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0


def test_positions_are_kept(spark):
    docs = documents(spark, awkward(), extra=True)
    for r in fingerprints(docs).collect():
        assert len(r["positions"]) == len(r["hashes"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    long = [r for r in fingerprints(docs).collect() if r["doc_id"] == 5][0]
    assert long["positions"] == winnow(texts[5])[0].tolist()


def test_equal_texts_and_half_likeness(spark):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400))
    same = text()
    rows = edited_fingerprints(documents(spark, [(1, same), (2, text()), (3, same), (4, text())])).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[3]["fingerprint"] != by_id[2]["fingerprint"]
    assert all(0.4 < r["near_edited"] < 0.6 and r["near_next"] < 0.05 for r in rows)
