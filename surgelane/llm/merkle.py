"""Merkle manifest of a dataset, its trees stored in van Emde Boas layout.

Every group (a source) is a 16-ary hash tree over its leaves in order; the
groups' roots are the leaves of one more such tree. A tree is kept as aligned
subtrees ("blocks") of up to 16 ** 3 leaves, one row each; the roots of a tier's
blocks are the leaves of the next tier, until one block is left. Inside a block
the nodes lie in van Emde Boas order: the levels are split at half height, the
upper half comes first, then every lower subtree, each laid out by the same
rule. ``address`` turns (level, number) into a place; construction and sibling
retrieval both go through it, so a run of siblings lies next to its parent.

Leaves get their ranks from a range partitioning and prefix sums of its parts,
so a group that holds a third of all rows is spread over parts and blocks like
any other. A task holds one block, and the siblings of a path above a block
travel with the block, not with its rows.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgelane.session import materialise

FANOUT = 16
#: Levels of hashing in a block; it has FANOUT ** LEVELS leaves at most.
LEVELS = 3
DIGEST = 32
_BLOCKS = "grp string, block long, size long, nodes binary, root binary"
_PATHS = "grp string, block long, path binary, subroot binary"


# --- layout ----------------------------------------------------------------------

def tree_size(height: int) -> int:
    """Nodes of a full tree of ``height`` levels of nodes."""
    return (FANOUT**height - 1) // (FANOUT - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of level ``depth`` (0: root) in a tree of ``height`` levels of nodes."""
    if height == 1:
        return np.zeros_like(index)
    top = (height + 1) // 2
    if depth < top:
        return address(top, depth, index)
    below = FANOUT ** (depth - top)
    return tree_size(top) + index // below * tree_size(height - top) + address(height - top, depth - top, index % below)


def levels_of(size: int, most: int = LEVELS) -> int:
    """Levels of hashing of the block that holds ``size`` nodes, or of each of many; at ``most`` so many."""
    levels = 0
    while levels < most and FANOUT**levels < size:
        levels += 1
    return levels


def counts(leaves: int, levels: int) -> list[int]:
    """Nodes of each level, the root's first."""
    out = [leaves]
    for _ in range(levels):
        out.append(-(-out[-1] // FANOUT))
    return out[::-1]


def build_block(leaves: list[bytes], levels: int) -> bytes:
    """All nodes of a block in van Emde Boas order, up to the last place in use."""
    height, count = levels + 1, counts(len(leaves), levels)
    places = [address(height, d, np.arange(n)) for d, n in enumerate(count)]
    nodes = np.zeros((max(int(p.max()) for p in places) + 1, DIGEST), np.uint8)
    nodes[places[levels]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, DIGEST)
    step = FANOUT * DIGEST * 2
    for d in range(levels, 0, -1):
        level = hexlify(nodes[places[d]].tobytes())
        parents = b"".join(hashlib.sha256(level[at : at + step]).digest() for at in range(0, len(level), step))
        nodes[places[d - 1]] = np.frombuffer(parents, np.uint8).reshape(-1, DIGEST)
    return nodes.tobytes()


class Block:
    """A stored block, opened to read siblings."""

    def __init__(self, nodes: bytes, leaves: int, levels: int):
        self.levels, self.leaves = levels, leaves
        table = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
        # Hex text of each level below the root, deepest first.
        self.texts = [
            hexlify(table[address(levels + 1, d, np.arange(n))].tobytes())
            for d, n in reversed(list(enumerate(counts(leaves, levels)))) if d > 0
        ]

    def siblings(self, index: int) -> Iterator[tuple[bytes, bytes]]:
        """Hex digests to the left and to the right of leaf ``index`` and of its ancestors, the root's level excepted."""
        for text in self.texts:
            run, place = divmod(index, FANOUT)
            start, own = run * FANOUT * DIGEST * 2, index * DIGEST * 2
            yield text[start:own], text[own + DIGEST * 2 : start + FANOUT * DIGEST * 2]
            index = run


def pack_path(path: list[tuple[bytes, bytes]]) -> bytes:
    """Sibling digests of a path's levels, each level led by how many lie left and right."""
    out = []
    for left, right in path:
        out += [bytes([len(left) // (2 * DIGEST), len(right) // (2 * DIGEST)]), bytes.fromhex((left + right).decode())]
    return b"".join(out)


def unpack_path(packed: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(packed):
        left, right = packed[at], packed[at + 1]
        middle, end = at + 2 + left * DIGEST, at + 2 + (left + right) * DIGEST
        out.append((hexlify(packed[at + 2 : middle]), hexlify(packed[middle:end])))
        at = end
    return out


# --- construction ----------------------------------------------------------------

def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of the fields: ``-`` for null, else byte count, ``:`` and the value as text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0) and ``size`` of the rows of each ``grp`` in ``order`` (ascending, nulls first), written.

    ``rows`` must be a written table: it is read for the ranges and for the rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialise(rows.repartitionByRange(n, "grp", *order).withColumn("_part", F.spark_partition_id()), "merkle-ordered")
    totals = parts.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")
    totals = totals.withColumns(
        {"_before": F.sum("_n").over(group.orderBy("_part")) - F.col("_n"), "size": F.sum("_n").over(group)}
    ).drop("_n")
    inside = F.row_number().over(Window.partitionBy("grp", "_part").orderBy(*order)) - 1
    out = parts.withColumn("_at", inside).join(totals, ["grp", "_part"])
    return materialise(out.withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_before", "_at"), "merkle-ranked")


class _Out:
    """Rows gathered to record batches of a bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= 10_000 or self.bytes >= 1 << 23:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _block_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    out = _Out(pa.schema([("grp", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("nodes", pa.binary()), ("root", pa.binary())]))
    key, leaves = None, []

    def close():
        nodes = build_block(leaves, levels_of(key[2], most))
        yield from out.add((*key, nodes, nodes[:DIGEST]), len(nodes))

    for batch in batches:
        for *here, digest in zip(*[batch[c].to_pylist() for c in ("grp", "block", "size", "digest")]):
            if here != key:
                if leaves:
                    yield from close()
                key, leaves = here, []
            leaves.append(digest)
    if leaves:
        yield from close()
    yield out.batch()


def block_of(rank: Column, most: int) -> Column:
    return F.shiftright(rank, 4 * most)


def build(nodes: DataFrame, most: int = LEVELS) -> list[DataFrame]:
    """Tiers of written blocks over nodes (``grp``, ``rank``, ``size``, ``digest``), the leaves' first."""
    tiers, full = [], FANOUT**most
    while True:
        placed = nodes.select("grp", block_of(F.col("rank"), most).alias("block"), "rank", "size", "digest")
        placed = placed.repartition("grp", "block").sortWithinPartitions("grp", "block", "rank").drop("rank")
        tiers.append(materialise(placed.mapInArrow(partial(_block_rows, most=most), _BLOCKS), "merkle-blocks"))
        more = tiers[-1].where(F.col("size") > full)
        if more.isEmpty():
            return tiers
        nodes = more.select("grp", F.col("block").alias("rank"), (block_of(F.col("size") - 1, most) + 1).alias("size"), F.col("root").alias("digest"))


def roots(tiers: list[DataFrame], most: int = LEVELS) -> DataFrame:
    """(grp, digest): root of each group's tree."""
    done = [t.where(F.col("size") <= FANOUT**most).select("grp", F.col("root").alias("digest")) for t in tiers]
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


# --- siblings --------------------------------------------------------------------

def _open(nodes: bytes, block: int, size: int, most: int) -> Block:
    full = FANOUT**most
    return Block(nodes, min(full, size - block * full), levels_of(size, most))


def _child_paths(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    out = _Out(pa.schema([("grp", pa.string()), ("block", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())]))
    for batch in batches:
        for grp, number, size, nodes, path, subroot in zip(*[batch[c].to_pylist() for c in ("grp", "block", "size", "nodes", "path", "subroot")]):
            block = _open(nodes, number, size, most)
            for i in range(block.leaves):
                own = pack_path(list(block.siblings(i))) + path
                yield from out.add((grp, number * FANOUT**most + i, own, subroot), len(own))
    yield out.batch()


def child_paths(blocks: DataFrame, above: DataFrame, most: int = LEVELS) -> DataFrame:
    """Paths of the leaves of a tier's blocks (``block`` is then the leaf's rank) from the paths ``above`` the blocks."""
    return blocks.drop("root").join(above, ["grp", "block"]).mapInArrow(partial(_child_paths, most=most), _PATHS)


def descend(tiers: list[DataFrame], above: DataFrame, most: int = LEVELS) -> DataFrame:
    """Paths above the blocks of the leaves, written, from those above each group's root (``grp``, ``path``, ``subroot``)."""
    found = None
    for blocks in reversed(tiers):
        tops = blocks.where(F.col("size") <= FANOUT**most).select("grp", "block").join(above, "grp").select("grp", "block", "path", "subroot")
        found = materialise(tops if found is None else tops.union(found), "merkle-paths")
        if blocks is not tiers[0]:
            found = child_paths(blocks, found, most)
    return found


def _proofs(root: bytes, most: int):
    root_text = hexlify(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        out = _Out(pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names), ("verified", pa.bool_())]))
        block = above = subroot = None
        columns = ("block", "size", "nodes", "path", "subroot", "rank", "doc_id", "digest", "tampered")
        for batch in batches:
            for number, size, nodes, path, sub, rank, doc_id, digest, tampered in zip(*[batch[c].to_pylist() for c in columns]):
                if nodes is not None:
                    block, above, subroot = _open(nodes, number, size, most), unpack_path(path), sub.hex()
                    continue
                proof, folded = hashlib.sha256(), hexlify(digest if tampered is None else tampered)
                for way in (block.siblings(rank - number * FANOUT**most), above):
                    for left, right in way:
                        proof.update(left + right)
                        folded = hexlify(hashlib.sha256(left + folded + right).digest())
                row = (doc_id, digest.hex(), subroot, root_text.decode(), proof.hexdigest(), folded.decode(), folded == root_text)
                yield from out.add(row)
        yield out.batch()

    return run


@dataclass
class Manifest:
    """Trees of a dataset: ranked leaves, blocks of the groups' trees, ranked group roots, blocks of the tree over them."""

    leaves: DataFrame
    tiers: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    root: bytes
    levels: int

    def proofs(self) -> DataFrame:
        """For each leaf its proof's hash and the root folded from its tampered (else own) digest and stored siblings."""
        whole = self.top[-1].sparkSession.createDataFrame([("", b"", b"")], "grp string, path binary, subroot binary")
        blocks = descend(self.top, whole, self.levels)
        ways = child_paths(self.top[0], blocks, self.levels).select(F.col("block").alias("rank"), "path")
        above = self.groups.join(ways, "rank").select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"))
        heads = self.tiers[0].drop("root").join(descend(self.tiers, above, self.levels), ["grp", "block"])
        nothing = lambda kind: F.lit(None).cast(kind)
        heads = heads.select("grp", "block", "size", "nodes", "path", "subroot", F.lit(-1).cast("long").alias("rank"),
                             nothing("long").alias("doc_id"), nothing("binary").alias("digest"), nothing("binary").alias("tampered"))
        rows = self.leaves.select("grp", block_of(F.col("rank"), self.levels).alias("block"), "size", nothing("binary").alias("nodes"),
                                  nothing("binary").alias("path"), nothing("binary").alias("subroot"), "rank", "doc_id", "digest", "tampered")
        # A block's nodes and the path above it come before its rows.
        together = heads.union(rows).repartition("grp", "block").sortWithinPartitions("grp", "block", "rank")
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return together.mapInArrow(_proofs(self.root, self.levels), schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper: int = 5, levels: int = LEVELS) -> Manifest:
    """Merkle trees of documents by ``source``, leaves by ascending ``doc_id``.

    Rows whose crc32 of the decimal id is a multiple of ``tamper`` also get the
    digest of a tampered row, its text's A-Z in lower case. Null fields count as
    ``-``; the null source comes first; rows without an id come first in their
    source and are never tampered with; rows that repeat an id are ordered by
    their digest, so their order doesn't matter to any hash. An empty table has
    no rows and the hash of nothing as its root. Other columns are left out.
    """
    columns = {f: F.col(f) for f in fields}
    small = {**columns, "text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper == 0
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf_digest(*columns.values())).alias("digest"),
        F.when(struck, F.unhex(leaf_digest(*small.values()))).alias("tampered"),
        # Splits rows that repeat as a whole over parts; their digests are equal.
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = ranked(materialise(leaves, "merkle-leaves"), ["doc_id", "digest", "tie"]).drop("tie")
    tiers = build(leaves.select("grp", "rank", "size", "digest"), levels)
    groups = roots(tiers, levels).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    groups = ranked(materialise(groups, "merkle-roots"), ["name"])
    top = build(groups.select("grp", "rank", "size", "digest"), levels)
    root = roots(top, levels).first()
    return Manifest(leaves, tiers, groups, top, bytes(root["digest"]) if root else hashlib.sha256().digest(), levels)
