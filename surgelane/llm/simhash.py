"""SimHash near duplicates through a Gray-order hierarchical index.

Fingerprints (64 bits, from hashes of word shingles) link at ``max_bits``
differing bits or fewer. Cut into ``max_bits + 2`` blocks, two linked ones agree
in at least two, so each pair of blocks gives a table in which the pair leads
the bit order. All tables are sorted by Gray rank at once: a rank's leading
bits are the top node of the hierarchy (an exact match of both blocks), below
it runs of neighbours in Gray order form nodes that store the bits all members
share. Two nodes whose shared bits already differ too often are pruned with all
their members; the rest is compared bit by bit, so the result is exact.

A second fingerprint of the same shingles may be indexed beside the first. A
link then also needs the 128 bits together to differ in few places, which
allows looser limits without linking documents by chance.

Equal fingerprints are one index entry. The range partitioning splits a top
node of any size; its runs meet pairwise only where the nodes' shared bits
allow it. Links leave a task as spanning stars, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelane.llm.graph import components
from surgelane.session import materialise

SHINGLE = 5
SEED = 42
#: Members of a run, of a node inside a run, and of a top node compared without an index.
RUN, NODE, SMALL = 4096, 32, 48


def _majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(len(hashes), 8), axis=1).sum(axis=0, dtype=np.int64)


def _second(hashes: np.ndarray) -> np.ndarray:
    """Hashes that are independent of the given ones (a 64-bit finalizer of them)."""
    h = hashes ^ (hashes >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, in blocks; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    k = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest, m, step = xxhash.xxh64_intdigest, len(words) - k + 1, 1 << 16  # bounded memory for very long texts
    for at in range(0, m, step):
        n = min(step, m - at)
        spans = zip(starts[at : at + n].tolist(), ends[at + k - 1 : at + k - 1 + n].tolist())
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(text: str | None, shingle: int, both: bool = False) -> tuple[int, int]:
    """SimHashes of a text: majority bits of XXH64 over its word shingles, and of second hashes (else 0).

    A text of fewer words is one shingle; a text without words has 0 and 0.
    """
    count, m = np.zeros((2, 64), np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        m += len(hashes)
        count[0] += _majority(hashes)
        if both:
            count[1] += _majority(_second(hashes))
    first, second = np.packbits(count * 2 > m, axis=1)
    return int.from_bytes(first.tobytes(), "big"), int.from_bytes(second.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, both: bool = False, keep: str | None = None) -> DataFrame:
    """(doc_id, fp, fp2): the signed 64-bit fingerprints of every whole text; with a long column ``keep``, that too."""
    names = ["doc_id", *([keep] if keep else []), "fp", "fp2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, both) for t in batch["text"]], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:-2]), pa.array(fps[:, 0]), pa.array(fps[:, 1])], names)

    return docs.select(F.col("doc_id").cast("long"), *names[1:-2], "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


@cache
def layouts(max_bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each table, the bits of its leading pair and its blocks as (shift, width) in bit order."""
    n = max_bits + 2
    widths = [64 // n + (b < 64 % n) for b in range(n)]
    shifts = [sum(widths[:b]) for b in range(n)]
    out = []
    for pair in combinations(range(n), 2):
        order = [*pair, *(b for b in range(n) if b not in pair)]
        out.append((widths[pair[0]] + widths[pair[1]], [(shifts[b], widths[b]) for b in order]))
    return out


def arrange(fp: np.ndarray, layout: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints' bits in a table's order, leading blocks on top."""
    out = np.zeros_like(fp)
    for shift, width in layout:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the reflected Gray code's order."""
    out = bits.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def gray_pattern(rank: np.ndarray) -> np.ndarray:
    """The bit pattern at a rank."""
    return rank ^ (rank >> np.uint64(1))


def shared(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, pattern) of nodes of ``size`` neighbours: the bits all members share, and their values."""
    at = np.arange(0, len(x), size)
    low, high = np.bitwise_and.reduceat(x, at), np.bitwise_or.reduceat(x, at)
    return ~(low ^ high), low


def close_pairs(x: np.ndarray, y: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of x (against itself, or y) within ``limit`` bits, pruning pairs of nodes."""
    same = y is None
    y = x if same else y
    (mx, px), (my, py) = shared(x, NODE), shared(y, NODE)
    apart = np.bitwise_count((px[:, None] ^ py[None, :]) & mx[:, None] & my[None, :])
    a, b = np.nonzero(apart <= limit)
    if same:
        a, b = a[a <= b], b[a <= b]
    left, right = [], []
    span = np.arange(NODE)
    for at in range(0, len(a), 1024):  # a million comparisons at once
        i = (a[at : at + 1024, None] * NODE + span)[:, :, None]
        j = (b[at : at + 1024, None] * NODE + span)[:, None, :]
        near = np.bitwise_count(x[np.minimum(i, len(x) - 1)] ^ y[np.minimum(j, len(y) - 1)]) <= limit
        near &= (i < len(x)) & (j < len(y))
        if same:
            near &= i < j
        k, m, n = np.nonzero(near)
        left.append(a[at + k] * NODE + m)
        right.append(b[at + k] * NODE + n)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the pairs among n items: (member, centre)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def spanning(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member id, least id) of links given as pairs of id arrays."""
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    member, centre = stars(len(ids), at[: len(a)], at[len(a) :])
    return ids[member], ids[centre]


def index_entries(distinct: DataFrame, max_bits: int, both: bool) -> DataFrame:
    """(t, g, id, other): each distinct (``id``, ``fp``, ``fp2``) in all tables, g its Gray rank as a signed long.

    ``other`` is the fingerprint that the table does not index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = layouts(max_bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = [part[c].to_numpy().view(np.uint64) for c in ("fp", "fp2")]
                for which in range(1 + both):
                    for k, (_, layout) in enumerate(tables):
                        g = gray_rank(arrange(fps[which], layout)) ^ np.uint64(1 << 63)  # signed order is then rank order
                        t = np.full(part.num_rows, which * len(tables) + k, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(g.view(np.int64)), part["id"], part["fp" if which else "fp2"]], ["t", "g", "id", "other"])

    return distinct.select("id", "fp", "fp2").mapInArrow(run, "t int, g long, id long, other long")


def _pieces(batches: Iterator[pa.RecordBatch], max_bits: int, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(table, leading bits, ranks, ids, others) of a sorted partition.

    Pieces are whole top nodes, or ``limit`` entries where a node is larger.
    """
    tables = layouts(max_bits)
    now, rest = -1, np.empty((3, 0), np.uint64)
    for batch in batches:
        ts = batch["t"].to_numpy()
        rows = np.stack([batch[c].to_numpy().view(np.uint64) for c in ("g", "id", "other")])
        rows[0] ^= np.uint64(1 << 63)
        cuts = [0, *(np.flatnonzero(np.diff(ts)) + 1).tolist(), len(ts)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if ts[a] != now:
                if rest.shape[1]:
                    yield now, tables[now % len(tables)][0], *rest
                now, rest = int(ts[a]), np.empty((3, 0), np.uint64)
            rest = np.concatenate([rest, rows[:, a:b]], axis=1)
            top = tables[now % len(tables)][0]
            while rest.shape[1] > limit:
                node = rest[0] >> np.uint64(64 - top)
                cut = int(np.searchsorted(node, node[limit])) or limit
                yield now, top, *rest[:, :cut]
                rest = rest[:, cut:]
    if rest.shape[1]:
        yield now, tables[now % len(tables)][0], *rest


_FOUND = "a long, b long, t int, node long, run long, mask long, pattern long, bits binary, ids binary, others binary"
_FOUND_SCHEMA = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32()), ("node", pa.int64()), ("run", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64())]
    + [(c, pa.binary()) for c in ("bits", "ids", "others")]
)


def partition_links(entries: DataFrame, max_bits: int, max_total: int) -> DataFrame:
    """Links (a, b) inside each sorted partition, and the runs that must meet others (a null).

    A run is kept for the first and last top node of a piece, which may go on
    elsewhere, and for top nodes of several runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        links: list[tuple[np.ndarray, np.ndarray]] = []  # of all tables so far, as spanning stars
        for t, top, rank, ids, others in _pieces(batches, max_bits, 16 * RUN):
            bits = gray_pattern(rank)
            node = rank >> np.uint64(64 - top)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(rank)]]))
            small = np.repeat(sizes <= SMALL, sizes)
            left, right, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            for d in range(1, min(SMALL, len(rank))):
                one = (node[d:] == node[:-d]) & small[d:]
                if not one.any():
                    break
                one &= np.bitwise_count(bits[d:] ^ bits[:-d]) <= max_bits
                i = np.flatnonzero(one)
                left.append(i + d)
                right.append(i)
            left, right = [np.concatenate(left)], [np.concatenate(right)]
            large = np.flatnonzero(sizes > SMALL).tolist()
            for k in sorted({0, len(starts) - 1, *large}):
                s, n = int(starts[k]), int(sizes[k])
                edge = k in (0, len(starts) - 1)
                for at in range(s, s + n, RUN):
                    end = min(at + RUN, s + n)
                    x = bits[at:end]
                    if n > SMALL:
                        i, j = close_pairs(x, None, max_bits)
                        good = _total(x[i], x[j], others[at + i], others[at + j]) <= max_total
                        member, centre = stars(len(x), i[good], j[good])
                        left.append(member + at)
                        right.append(centre + at)
                    if edge or n > RUN:
                        low, high = np.bitwise_and.reduce(x), np.bitwise_or.reduce(x)
                        rows.append((t, int(node[s]), (part << 32) + seq, int((~(low ^ high)).view(np.int64)), int(low.view(np.int64)), x.tobytes(), ids[at:end].tobytes(), others[at:end].tobytes()))
                        seq += 1
            good = _total(bits[left[0]], bits[right[0]], others[left[0]], others[right[0]]) <= max_total
            left[0], right[0] = left[0][good], right[0][good]
            links = [spanning([*links, tuple(ids[np.concatenate(side)].view(np.int64) for side in (left, right))])]
            if rows:
                columns = dict(zip(_FOUND_SCHEMA.names[2:], map(list, zip(*rows))))
                yield pa.RecordBatch.from_pydict({"a": [None] * len(rows), "b": [None] * len(rows)} | columns, _FOUND_SCHEMA)
        for a, b in links:
            yield pa.RecordBatch.from_pydict({"a": a, "b": b} | {c: pa.nulls(len(a), _FOUND_SCHEMA.field(c).type) for c in _FOUND_SCHEMA.names[2:]}, _FOUND_SCHEMA)

    return entries.mapInArrow(run, _FOUND)


def _total(x: np.ndarray, y: np.ndarray, other_x: np.ndarray, other_y: np.ndarray) -> np.ndarray:
    """Differing bits of both fingerprints together."""
    return np.bitwise_count(x ^ y).astype(np.int32) + np.bitwise_count(other_x ^ other_y)


def run_links(runs: DataFrame, max_bits: int, max_total: int) -> DataFrame:
    """Links (a, b) between runs of one top node whose shared bits do not already differ too often."""
    r, s = runs.alias("r"), runs.alias("s")
    met = r.join(s, (F.col("r.t") == F.col("s.t")) & (F.col("r.node") == F.col("s.node")) & (F.col("r.run") < F.col("s.run")))
    apart = F.bit_count(F.col("r.pattern").bitwiseXOR(F.col("s.pattern")).bitwiseAND(F.col("r.mask")).bitwiseAND(F.col("s.mask")))
    sides = [F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "rs" for c in ("bits", "ids", "others")]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in zip(*batch.columns):
                x, idx, ox, y, idy, oy = (np.frombuffer(v.as_py(), np.uint64) for v in row)
                i, j = close_pairs(x, y, max_bits)
                good = _total(x[i], y[j], ox[i], oy[j]) <= max_total
                links.append((idx.view(np.int64)[i[good]], idy.view(np.int64)[j[good]]))
                if len(links) == 64:
                    links = [spanning(links)]
            a, b = spanning(links)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.where(apart <= max_bits).select(*sides).mapInArrow(verify, "a long, b long")


def index_links(distinct: DataFrame, max_bits: int, max_total: int | None = None) -> DataFrame:
    """Links (a, b) that join all fingerprints (``id``, ``fp``, ``fp2``) within the limits."""
    both = max_total is not None
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = index_entries(distinct, max_bits, both).repartitionByRange(n, "t", "g").sortWithinPartitions("t", "g")
    found = materialise(partition_links(entries, max_bits, max_total if both else max_bits), "index-runs")
    met = run_links(found.where("a is null").drop("a", "b"), max_bits, max_total if both else max_bits)
    return found.where("a is not null").select("a", "b").union(met)


def fingerprint_classes(distinct: DataFrame, max_bits: int = 4, max_total: int | None = None) -> DataFrame:
    """(fp, fp2, component) of distinct fingerprints (``id``, ``fp``, ``fp2``): the least id reachable by links."""
    distinct = materialise(distinct, "distinct-fingerprints")
    linked = materialise(components(index_links(distinct, max_bits, max_total)), "components")
    return distinct.join(linked, F.col("id") == F.col("node"), "left").select("fp", "fp2", F.coalesce("label", "id").alias("component"))


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = 4) -> DataFrame:
    """(doc_id, text_key) of the one document that stays of each group: the least id, then the least text key.

    A document is an id with a text (``text_key`` is the text's xxhash64): rows that
    repeat both are one, and an id that comes with several texts is a document
    for each, linked by its own fingerprint. Rows without an id are left out.
    """
    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    fps = materialise(fingerprints(keyed, shingle, keep="text_key"), "fingerprints")
    # The fingerprint itself is the node, so that an id of two texts doesn't join their groups.
    groups = fingerprint_classes(fps.select("fp", "fp2").distinct().withColumn("id", F.col("fp")), max_bits)
    groups = groups.select(F.col("fp").alias("_fp"), F.col("component").alias("_group"))
    grouped = fps.join(groups, F.col("fp") == F.col("_fp"))
    return grouped.groupBy("_group").agg(F.min(F.struct("doc_id", "text_key")).alias("_kept")).select("_kept.*")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = 4, max_total: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (``doc_id``, ``text``).

    Links: ``max_bits`` differing bits or fewer; with ``max_total``, in one of two
    fingerprints, and ``max_total`` or fewer in both together. ``component_id``
    is the least id reachable by links, the row's own included.

    Null and empty texts have fingerprint 0 and link like any other; rows with a
    null id are listed, link with nothing and have a null component; repeated
    rows are listed each; an empty table gives an empty table.
    """
    both = max_total is not None
    fps = materialise(fingerprints(docs, shingle, both), "fingerprints")
    distinct = fps.where("doc_id is not null").groupBy("fp", "fp2").agg(F.min("doc_id").alias("id"))
    classes = fingerprint_classes(distinct, max_bits, max_total).withColumnsRenamed({"fp": "_fp", "fp2": "_fp2", "component": "_component"})
    joined = fps.join(classes, (F.col("fp") == F.col("_fp")) & (F.col("fp2") == F.col("_fp2")), "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))
