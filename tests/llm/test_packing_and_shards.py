"""Packing and sharding: exact round trips, brute force and balance."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from llm_helpers import awkward, documents
from surgelane.llm.packing import WordIds, fullest, pack, pack_documents, places, plan_bins
from surgelane.llm.queries import tokenizer_path
from surgelane.llm.sharding import place, shard_by_bytes, sized
from surgelane.session import materialise


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("text", [r[1] for r in awkward() if r[1]] + [
    "It's Joe's 'quoted' we'll they'VE x's.", "a--b, c.d!e#f$g%h&i*j 3rd 12,5", "Ünï Straße ǅ İI ſ", "é é́ ño",
    "façade ÿ þorn Æsir øre ƀƁ ǆǅǄ Ȝȝ ɏɎ ĿŀŸ ßẞ ŉ ǰ", "αβγ aα βa 漢字kanji ١٢", "x y z\u0085w", "tab\tnew\nline\x0bv\x0cf\rr", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "~`@^_|\\/ [a]{b}(c)",
])
def test_ids_equal_the_tokenizer(tokenizer, text):
    ids = np.frombuffer(WordIds(tokenizer).of(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr("surgelane.llm.packing.REMEMBERED", 7)
    words = WordIds(tokenizer)
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join(f"w{rng.randrange(40)}." for _ in range(30))
        assert np.frombuffer(words.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fullest_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, 30), rng.randrange(1, 7))}
        lengths = sorted(counts, reverse=True)
        got = fullest(lengths, counts, 40)
        assert got[0] == lengths[0] and sum(got) <= 40 and all(got.count(n) <= counts[n] for n in got)
        sums = {lengths[0]}
        for n in lengths:
            for _ in range(counts[n] - (n == lengths[0])):
                sums |= {s + n for s in sums if s + n <= 40}
        assert sum(got) == max(sums)


def test_plan_uses_every_piece_once():
    rng = random.Random(8)
    histogram = {n: rng.randrange(0, 60) for n in range(1, 201)}
    plan = plan_bins(histogram, 200)
    used = {}
    for chosen, times in plan:
        assert sum(chosen) <= 200 and times > 0
        for n in chosen:
            used[n] = used.get(n, 0) + times
    assert used == {n: c for n, c in histogram.items() if c}
    assert len(plan) <= 200 * 5.3  # 200 * ln(200)
    bins = sum(t for _, t in plan)
    total = sum(n * c for n, c in histogram.items())
    assert bins <= 1.02 * total / 200 + 1
    assert plan_bins({}) == [] and places([]) == []


def check_packing(rows, capacity):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_documents_round_trip(spark, tokenizer):
    rng = random.Random(6)
    texts = awkward() + [(100 + i, " ".join(f"word{rng.randrange(500)}," for _ in range(rng.randrange(0, 900)))) for i in range(200)]
    got = pack_documents(documents(spark, texts, extra=True), tokenizer_path()).collect()
    want = []
    for doc, text, *_ in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want.append((doc, k, a, len(part), zlib.crc32(part.tobytes())))
    key = repr
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    n = check_packing(got, 2048)
    assert n <= -(-sum(w[3] for w in want) // 2048) + 2


def test_one_common_length(spark):
    cut = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 7 = 0, 300, 700) as long) as length")
    assert check_packing(pack(cut).collect(), 2048) <= 5000 * 0.86 / 2 + 10
    assert pack(cut.limit(0)).count() == 0


def shards_of(spark, rows, n=16, extra=False):
    return shard_by_bytes(materialise(sized(documents(spark, rows, extra)), "test-sizes"), n).collect()


def check_shards(got, n):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    total = sum(r.size for r in got)
    return {s: sum(r.size for r in rows) / (total / n) for s, rows in by.items()}


def test_shards_are_balanced_and_keep_equal_texts_together(spark):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randrange(0, 400) + str(rng.randrange(10**9))) for i in range(6000)]
    rows += [(10_000 + i, "a copied text " * 3) for i in range(400)] + [(20_000 + i, None if i % 2 else "") for i in range(50)]
    got = shards_of(spark, rows)
    share = check_shards(got, 16)
    assert len(got) == len(rows) and set(share) == set(range(16))
    assert all(0.98 < v < 1.02 for v in share.values())
    where = {}
    text = dict(rows)
    for r in got:
        where.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    again = shards_of(spark, rows[::-1])
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_a_text_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same text") for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(1500)]
    share = check_shards(shards_of(spark, rows), 16)
    assert len(share) == 16 and all(0.97 < v < 1.03 for v in share.values())


def test_awkward_documents(spark):
    got = shards_of(spark, awkward(), extra=True)
    assert len(got) == len(awkward())
    check_shards(got, 16)
    text = {r[0]: r[1] for r in awkward()}
    for r in got:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert shards_of(spark, []) == []


def test_place_covers_every_byte():
    rng = random.Random(1)
    for _ in range(50):
        groups = [(k, rng.randrange(1, 2000)) for k in range(rng.randrange(0, 12))]
        total = sum(b for _, b in groups) + rng.randrange(0, 5000)
        spans = {}
        for run, a, b, shard in place(groups, total, 4):
            assert a == spans.get(run, 0) and b > a and 0 <= shard < 4
            spans[run] = b
        assert all(spans[k] == b for k, b in groups)
        assert spans.get(-1, 0) >= total - sum(b for _, b in groups)
