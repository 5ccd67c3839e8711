"""Merkle manifest against a plain fold, and the layout's arithmetic."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from llm_helpers import awkward, documents
from surgelane.llm import merkle
from surgelane.llm.merkle import address, build_block, manifest, tree_size

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row) -> str:
    return sha("".join(field(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """Levels of a tree, leaves first."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 16])))
        i //= 16
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in groups[name]])
    top = tree([trees[n][-1][0] for n in names])
    root, out = top[-1][0] if names else sha(""), []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            way = path(trees[name], i) + path(top, k)
            struck = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            folded = leaf({**r, "text": lower(r["text"])} if struck else r)
            for left, right in way:
                folded = sha(left + folded + right)
            out.append((r["doc_id"], leaf(r), trees[name][-1][0], root, sha("".join(a + b for a, b in way)), folded, folded == root))
    return sorted(out, key=str)


def found(docs, **kw):
    return sorted((tuple(r[c] for c in COLUMNS) for r in manifest(docs, **kw).proofs().collect()), key=str)


def test_awkward_rows(spark):
    docs = documents(spark, awkward(), extra=True)
    rows = [r.asDict() for r in docs.collect()]
    assert found(docs) == brute(rows)
    shuffled = docs.repartition(5)
    assert found(shuffled) == brute(rows)


def test_empty_table_and_single_rows(spark):
    assert found(documents(spark, [])) == []
    one = documents(spark, [(3, "Only one", "en", "s")])
    assert found(one) == brute([one.first().asDict()])


@pytest.mark.parametrize("levels", [1, 2])
def test_tiers_of_small_blocks(spark, levels):
    """Blocks of 16 or 256 leaves: the same hashes, over several tiers and a hot source; many sources, a null one."""
    rows = [(i, f"Text {i % 7} A", "en", "hot" if i % 3 else f"s{i % 300}") for i in range(1500)] + [(9000 + i, "x", "en", None) for i in range(17)]
    docs = documents(spark, rows)
    want = brute([r.asDict() for r in docs.collect()])
    assert found(docs) == want
    assert found(docs, levels=levels) == want


@pytest.mark.parametrize("height", [1, 2, 3, 4])
def test_addresses_are_a_permutation_and_keep_runs_near(height):
    places = [address(height, d, np.arange(16**d)) for d in range(height)]
    assert sorted(np.concatenate(places).tolist()) == list(range(tree_size(height)))
    if height == 4:
        # A parent and its 16 children lie together, so do the root and its own.
        assert places[0][0] == 0 and places[1].tolist() == list(range(1, 17))
        assert (places[3].reshape(-1, 16) - places[2][:, None] == np.arange(1, 17)).all()


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4095, 4096])
def test_block_root(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    levels = merkle.levels_of(n)
    assert build_block(leaves, levels)[:32].hex() == tree([x.hex() for x in leaves])[-1][0]
    block = merkle.Block(build_block(leaves, levels), n, levels)
    for i in {0, n // 2, n - 1}:
        want = path(tree([x.hex() for x in leaves]), i)
        assert [(a.decode(), b.decode()) for a, b in block.siblings(i)] == want
        packed = merkle.pack_path(list(block.siblings(i)))
        assert [(a.decode(), b.decode()) for a, b in merkle.unpack_path(packed)] == want
