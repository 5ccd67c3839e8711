"""Embedding near duplicates by cross-polytope hashing and verified candidates.

A vector is turned by pseudo-random rotations (three rounds of random signs and
a fast Hadamard transform); the largest coordinate and its sign is its hash. Two
hashes name a bucket of one of ``TABLES`` tables. A vector is a member of its
own bucket and visits the ``PROBES`` - 1 next best ones; pairs that meet are
compared by cosine in double precision, so no false link comes out.

Bucket numbers move first, without vectors. Buckets that hold one row, or none
that is at home there, drop out; only the rows of the others fetch their vectors
(in the precision they came in) and meet.

Counting happens in the tasks: a pair that meets in several buckets is counted
in the first only, which both rows can tell from the bucket numbers they carry,
and leaves a task as degrees and spanning stars, never as a row per pair. Equal
vectors are one row with a count. A bucket of many rows is dealt over cells of
two chunks of its rows, so no task holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelane.llm.graph import components
from surgelane.session import materialise

THRESHOLD = 0.93
# At cosine 0.93 in 64 dimensions a pair meets in one table with probability 0.76,
# in one of six with 0.9998.
TABLES, PROBES, HASHES = 6, 5, 2
# Coordinates of a rotated vector that probes are chosen from.
NEAREST = 4
# Rows of a chunk; a bucket of more rows is split.
CHUNK = 1024
SMALL = 48


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@cache
def signs(dim: int, table: int) -> np.ndarray:
    """The random signs of a table's rotations: hashes x rounds x dimension."""
    return np.random.default_rng([dim, table]).choice([-1.0, 1.0], (HASHES, 3, dim))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (no row is zero), by their largest component first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_numbers(x: np.ndarray) -> np.ndarray:
    """Rows x tables x probes of bucket numbers; probe 0 is the row's own bucket."""
    dim = _padded(x.shape[1])
    padded = np.zeros((len(x), dim))
    padded[:, : x.shape[1]] = x
    near = min(NEAREST, dim)
    picks = np.array(list(product(range(near), repeat=HASHES)))
    out = np.empty((len(x), TABLES, min(PROBES, len(picks))), np.int32)
    for t in range(TABLES):
        codes, costs = [], []
        for rounds in signs(dim, t):
            u = padded
            for s in rounds:
                u = hadamard(u * s)
            top = np.argsort(-np.abs(u), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(u, top, axis=1)
            codes.append(2 * top + (value < 0))
            costs.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        cost = sum(costs[k][:, picks[:, k]] for k in range(HASHES))
        best = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
        number = np.zeros((len(x), len(picks)), np.int64)
        for k in range(HASHES):
            number = number * (2 * dim) + codes[k][:, picks[:, k]]
        out[:, t] = np.take_along_axis(number, best, axis=1)
    return out


def _padded(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def _number_type(dim: int) -> type:
    """The narrowest type that holds every bucket number of a dimension."""
    return np.int16 if (2 * _padded(dim)) ** HASHES <= 1 << 15 else np.int32


def pack_vector(row: np.ndarray) -> bytes:
    """Components as floats if that loses nothing, else as doubles."""
    with np.errstate(over="ignore"):
        short = row.astype(np.float32)
    return short.tobytes() if np.array_equal(short.astype(np.float64), row) else row.tobytes()


def unpack_vector(data: pa.Scalar, dim: int) -> np.ndarray:
    data = data.as_buffer()
    return np.frombuffer(data, np.float32 if data.size == 4 * dim else np.float64).astype(np.float64)


_CODES = "space long, id long, code long, copies long, dim int, buckets array<int>, numbers binary, vector binary"


def vector_codes(vectors: DataFrame) -> DataFrame:
    """A row for every vector (space, id, code, copies, embedding): its buckets by table and probe, and both packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes = np.array(part["embedding"].value_lengths())
                for dim in np.unique(sizes).tolist():
                    pick = part.take(pa.array(np.flatnonzero(sizes == dim)))
                    raw = pick["embedding"].flatten().to_numpy().reshape(-1, dim)
                    numbers = bucket_numbers(unit(raw)).reshape(len(raw), -1)
                    columns = {c: pick[c] for c in ("space", "id", "code", "copies")}
                    columns["dim"] = pa.array(np.full(len(raw), dim, np.int32))
                    columns["buckets"] = pa.array(list(numbers), pa.list_(pa.int32()))
                    columns["numbers"] = pa.array([n.tobytes() for n in numbers.astype(_number_type(dim))], pa.binary())
                    columns["vector"] = pa.array([pack_vector(v) for v in raw], pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)

    return vectors.select("space", "id", "code", "copies", "embedding").mapInArrow(run, _CODES)


def meets(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in i's own bucket, in j's own bucket) of pairs, by table; i, j: pairs x tables x probes."""
    return (j == i[:, :, :1]).any(axis=2), (i == j[:, :, :1]).any(axis=2)


def counted_here(ids_i, ids_j, numbers_i, numbers_j, t: int, bucket: int) -> np.ndarray:
    """Of pairs that meet in this bucket, those that meet nowhere before it."""
    at_i, at_j = meets(numbers_i, numbers_j)
    first = (at_i | at_j).argmax(axis=1)
    one = np.arange(len(first))
    own_i, own_j = numbers_i[:, t, 0], numbers_j[:, t, 0]
    # Where each visits the other's bucket, the bucket of the smaller id counts.
    use_i = at_i[one, first] & (~at_j[one, first] | (ids_i < ids_j))
    return (first == t) & (np.where(use_i, own_i, own_j) == bucket)


def cell_links(cells: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n) from rows sorted by cell: degrees (b null) and spanning stars (n null)."""

    def links(space: tuple, chunk, own, ids, copies, numbers, x):
        _, _, t, bucket, left, right = space
        n = len(ids)
        rows_a = np.flatnonzero(chunk == left)
        rows_b = np.flatnonzero(chunk == right)
        found = []
        for at in range(0, len(rows_a), 256):
            a = rows_a[at : at + 256]
            near = x[a] @ x[rows_b].T >= threshold
            near &= own[a][:, None] | own[rows_b][None, :]
            if left == right:
                near &= a[:, None] < rows_b[None, :]
            i, j = np.nonzero(near)
            i, j = a[i], rows_b[j]
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            good = counted_here(ids[i], ids[j], numbers[i], numbers[j], t, bucket)
            found.append((i[good], j[good]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        if not len(i):
            return None
        degree = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        has = np.flatnonzero(degree)
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
        return ids[has], degree[has].astype(np.int64), ids[member], ids[label[member]]

    def emit(found):
        deg_id, deg, a, b = found
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([deg_id, a])), pa.array([None] * len(deg_id) + b.tolist(), pa.int64()), pa.array(deg.tolist() + [None] * len(a), pa.int64())],
            ["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = ["space", "dim", "t", "bucket", "left", "right"]

        def process(tab: pa.Table):
            tab = tab.combine_chunks()
            keys = np.stack([tab[c].to_numpy().astype(np.int64) for c in names], axis=1)
            own, ids, copies, chunk = (tab[c].to_numpy() for c in ("own", "id", "copies", "chunk"))
            starts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]])
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s < 2 or not own[s:e].any():
                    continue
                part = tab.slice(s, e - s)
                dim = int(keys[s][1])
                x = unit(np.stack([unpack_vector(v, dim) for v in part["vector"]]))
                numbers = np.stack([np.frombuffer(v.as_buffer(), _number_type(dim)) for v in part["numbers"]]).reshape(e - s, TABLES, -1)
                found = links(tuple(keys[s].tolist()), chunk[s:e], own[s:e].astype(bool), ids[s:e], copies[s:e], numbers, x)
                if found:
                    yield emit(found)

        for batch in batches:
            tab = pa.Table.from_batches([batch])
            held = tab if held is None else pa.concat_tables([held, tab])
            last = [held[c][held.num_rows - 1].as_py() for c in names] if held.num_rows else None
            if last is None:
                continue
            # The last cell may go on in the next batch.
            same = np.ones(held.num_rows, bool)
            for c, v in zip(names, last):
                same &= held[c].to_numpy() == v
            cut = int(np.argmax(same))
            if cut:
                yield from process(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from process(held)

    return cells.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vec_id``, ``embedding``, ``label``.

    Vectors link at cosine ``threshold`` or more, under equal labels and in equal
    dimensions. Null, empty or zero vectors, such with a null, NaN or infinite
    component, and rows without a label or id link with nothing and are their own
    component. Repeated vectors link with each other. An empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    fit = fit.where(~bad & F.exists("embedding", lambda x: x != 0))
    classes = fit.groupBy(F.col("label").alias("space"), "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # The hash tells apart the vectors of an id that comes with several.
    classes = materialise(classes.withColumn("code", F.xxhash64("embedding")), "distinct-vectors")
    coded = materialise(vector_codes(classes), "vector-codes")
    keys = ["space", "dim", "t", "bucket"]
    probes = F.floor(F.size("buckets") / TABLES).cast("int")
    rows = coded.select("space", "dim", "id", "code", probes.alias("probes"), F.posexplode("buckets").alias("at", "bucket"))
    rows = rows.select(*keys[:2], F.floor(F.col("at") / F.col("probes")).cast("int").alias("t"), "bucket", (F.col("at") % F.col("probes") == 0).alias("own"), "id", "code")
    met = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max("own").alias("home")).where("home and rows > 1")
    met = met.select(*keys, F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    useful = rows.join(met, keys)
    dealt = useful.join(coded.select("space", "id", "code", "copies", "numbers", "vector"), ["space", "id", "code"])
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"left": F.least("chunk", "other"), "right": F.greatest("chunk", "other")})
    cells = dealt.drop("chunks", "other", "code").repartition(*keys, "left", "right").sortWithinPartitions(*keys, "left", "right")
    found = materialise(cell_links(cells, threshold), "vector-links")
    degrees = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    linked = components(found.where("b is not null").select("a", "b"))
    of_class = (
        classes.join(degrees, F.col("id") == F.col("a"), "left")
        .join(linked, F.col("id") == F.col("node"), "left")
        .select(
            F.col("space").alias("_space"), F.col("embedding").alias("_embedding"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("label", "id").alias("component_id"),
        )
    )
    of_class = materialise(of_class, "vector-classes")
    joined = vectors.join(of_class, (F.col("label") == F.col("_space")) & (F.col("embedding") == F.col("_embedding")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
