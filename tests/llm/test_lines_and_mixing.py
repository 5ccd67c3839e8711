"""Line dedup and mixing against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from llm_helpers import LONG, awkward, documents
from surgelane.llm.linededup import apply_bitmaps, line_bitmaps
from surgelane.llm.mixing import mix, source_targets, take_words, word_count


def slow_line_dedup(rows):
    def key(line):
        stripped = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders.get(key(x), ())) < 5 or doc == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run_lines(spark, rows, extra=False):
    docs = documents(spark, rows, extra)
    got = apply_bitmaps(docs, line_bitmaps(docs))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()), key=repr)


def test_line_dedup_matches_plain_python(spark):
    rng = random.Random(2)
    common = [f"common passage number {k} that several documents hold, é{k}" for k in range(30)]
    rows = []
    for i in range(300):
        lines = [rng.choice(common) if rng.random() < 0.2 else f"own line {i} {k} " + "x" * rng.randrange(60) for k in range(rng.randrange(1, 150))]
        rows.append((i * 3, "\n".join(x.upper() if rng.random() < 0.1 else x for x in lines)))
    assert run_lines(spark, rows) == slow_line_dedup(rows)


def test_line_dedup_awkward_documents(spark):
    rows = [r[:2] for r in awkward()]
    assert run_lines(spark, awkward(), extra=True) == slow_line_dedup(rows)
    got = {r[0]: r[2] for r in run_lines(spark, awkward())}
    assert got[7] == 1 and got[8] == 2 and got[9] == got[10] == 1 and got[11] == 0
    assert run_lines(spark, []) == []


def test_repeated_rows_are_one_document(spark):
    rows = [(1, f"{LONG}\nown")] * 4 + [(2, LONG), (3, LONG), (4, LONG)]
    assert run_lines(spark, rows) == slow_line_dedup(rows)
    assert sum(r[2] for r in run_lines(spark, rows)) == 0
    rows.append((5, f"{LONG}\n{LONG}"))
    assert run_lines(spark, rows) == slow_line_dedup(rows)


def test_line_dedup_plan_is_native(spark):
    from conftest import plan_text

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = plan_text(apply_bitmaps(docs, line_bitmaps(docs)))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", text)


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 50, None: 70}, {"z": 5}, {"a": 0, "b": 0}, {"é": 10, "z": 500, "Z": 3, "": 8, "𝒳": 40},
])
def test_targets_match_the_iteration(spark, sizes):
    totals = spark.createDataFrame([(f"={s}" if s is not None else "~", n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(totals).collect()}
    for s, want in slow_targets(sizes).items():
        assert got["~" if s is None else f"={s}"] == pytest.approx(want)


def run_mix(spark, rows, extra=False):
    docs = documents(spark, rows, extra)
    return mix(docs.withColumn("size", word_count(F.col("text"))))


def test_mix_takes_every_budget_exactly(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(2000)]
    got = run_mix(spark, rows).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = slow_targets(sizes)
    for s, size in sizes.items():
        of = [r for r in got if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(want[s]) for r in of)
        assert sum(r.taken for r in of) == int(want[s])
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = run_mix(spark, rows[::-1]).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_awkward_documents(spark):
    got = run_mix(spark, awkward(), extra=True).collect()
    assert len(got) == len(awkward())
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got)
    assert run_mix(spark, []).count() == 0


def test_take_words_keeps_white_space(spark):
    df = spark.createDataFrame([("  a\t b\n c d ", 2), ("x", 5), ("a b", 0)], "t string, n int")
    assert [r[0] for r in df.select(take_words(F.col("t"), F.col("n"))).collect()] == ["  a\t b", "x", ""]
