"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from llm_helpers import awkward, documents
from surgelane.llm.variants import near_pairs, spelling_variants, word_counts
from surgelane.session import materialise


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def vocabulary(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [w, form, w, n, len(near), words[form] if form else None]
    for w in out:
        while out[out[w][2]][1]:
            out[w][2] = out[out[w][2]][1]
    return sorted(map(tuple, out.values()))


def found(docs, **kw):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling_variants(docs, **kw).collect())


def misspelt(seed, n):
    """Texts over a few stems with chains of edits, each some ten times rarer than the one before."""
    rng, texts = random.Random(seed), []
    stems = ["".join(rng.choice("abcdeéÿ×xyz") for _ in range(rng.randint(7, 12))) for _ in range(12)]
    pool = []
    for stem in stems:
        word, times = stem, 300
        while times:
            pool += [word] * times
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + ("" if kind == 0 else rng.choice("abcdeé")) + word[at + (kind != 1) :]
            times //= rng.choice((2, 10, 12))
        for _ in range(20):
            at = rng.randrange(len(stem))
            pool += [stem[:at] + rng.choice("abcxyz") + stem[at + 1 :]] * rng.randint(1, 3)
    rng.shuffle(pool)
    for k in range(n):
        texts.append((k, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in pool[k::n])))
    return texts


@pytest.mark.parametrize("symbols", [2, 4, 16])
def test_all_pairs_of_misspelt_texts(spark, symbols):
    rows = misspelt(3, 40)
    want = brute(vocabulary(rows))
    assert any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 10
    assert found(documents(spark, rows), symbols=symbols) == want


def test_every_kind_of_edit_is_found(spark):
    """Each insertion, deletion and replacement of one long word, in runs of equal letters as well."""
    words = set()
    for stem in ("aaaaaaaabbb", "abcdefghijk", "ÿÿzzzzzz"):
        words |= {stem} | {stem[:i] + stem[i + 1 :] for i in range(len(stem))}
        words |= {stem[:i] + c + stem[i:] for i in range(len(stem) + 1) for c in "abzÿ"} | {stem[:i] + c + stem[i + 1 :] for i in range(len(stem)) for c in "abzÿ"}
    words = sorted(w for w in words if len(w) >= 7)
    table = materialise(spark.createDataFrame([(i, w, 2) for i, w in enumerate(words)], "id long, word string, n long"), "words")
    for symbols in (1, 3, 8):
        got = sorted((r["word"], r["other"]) for r in near_pairs(table, symbols).collect())
        assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_awkward_rows(spark):
    rows = awkward() + [(50, "x" * 60_000 + " " + "Überstraßen überstraßen"), (51, "x" * 60_000), (None, "wordless wordless wordlesss")]
    docs = documents(spark, [r if len(r) == 4 else (*r, "en", "s") for r in rows], extra=True)
    assert found(docs) == brute(vocabulary([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert found(documents(spark, [])) == [] and found(documents(spark, [(1, None), (2, "")])) == []


def test_counts(spark):
    rows = misspelt(5, 10) + misspelt(6, 3)
    got = {r["word"]: r["n"] for r in word_counts(documents(spark, rows)).collect()}
    assert got == vocabulary(rows)
