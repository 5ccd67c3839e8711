"""Exact top-k by inner product with a KD-tree per shard.

A KD-tree over a bounded sample deals the vectors: its leaves are cells, and a
cell of many rows (copies that no split parts) is dealt over shards by a hash of
the id. A task builds its shard's tree: median splits along the widest side, a
tight bounding box on every node. A query walks it best first by the largest
inner product that a box allows and stops when no box can reach the k-th score
found so far.

The k-th score travels in three hops: a query searches its own shard, which lies
around it; then the shards whose boxes promise it most; then, with the k-th
score found by then, the shards whose boxes still reach it. Boxes are met in
groups before any vector moves, so shards that cannot answer get no copy of the
query. Queries travel in blocks, sorted behind the packed shard that they visit,
and a task holds one shard and one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgelane.session import materialise

LEAF = 256
# Vectors of a shard at most, on average, and queries whose box bounds are held at once.
SHARD_ROWS = 4096
BLOCK = 512
# Rows that the cells are fitted on, at most and on average, and the fewest of a cell.
SAMPLE, CELL_SAMPLE = 16_384, 16
# Boxes of a group, and blocks that one copy of a shard answers.
BOXES, VISITS = 1024, 64
#: Lowest score; stands for "no bound yet".
NONE = float("-inf")


class Tree:
    """KD-tree over integer vectors held as doubles (products and sums stay exact below 2 ** 53)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, self.spans, self.kids = np.arange(len(x)), [], []
        self._split(x, order, 0, len(x))
        self.ids, self.x = ids[order], x[order]
        self.low = np.array([self.x[a:b].min(axis=0) for a, b in self.spans])
        self.high = np.array([self.x[a:b].max(axis=0) for a, b in self.spans])
        self.first_id = np.array([self.ids[a:b].min() for a, b in self.spans])

    def _split(self, x: np.ndarray, order: np.ndarray, a: int, b: int) -> int:
        node = len(self.spans)
        self.spans.append((a, b))
        self.kids.append(None)
        if b - a > LEAF:
            part = x[order[a:b]]
            side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, side], mid, kind="introselect")]
            self.kids[node] = (self._split(x, order, a, a + mid), self._split(x, order, a + mid, b))
        return node

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Queries x nodes: the largest inner product that a node's box allows."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, query_id: int, q: np.ndarray, bounds: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Up to k (ids, scores) of at least ``kth``, best first, ties by smaller id, the query's own id left out."""
        ids, scores = np.empty(0, np.int64), np.empty(0)
        heap = [(-bounds[0], int(self.first_id[0]), 0)]
        last_id = np.iinfo(np.int64).max  # id of the k-th, once there are k
        while heap:
            bound, first, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if -bound == kth and first > last_id:
                continue
            if self.kids[node] is not None:
                for kid in self.kids[node]:
                    if bounds[kid] >= kth:
                        heapq.heappush(heap, (-bounds[kid], int(self.first_id[kid]), kid))
                continue
            a, b = self.spans[node]
            new = self.x[a:b] @ q
            good = (new >= kth) & (self.ids[a:b] != query_id)
            if not good.any():
                continue
            ids, scores = np.concatenate([ids, self.ids[a:b][good]]), np.concatenate([scores, new[good]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                worst = np.lexsort((ids, -scores))[-1]
                kth, last_id = max(kth, scores[worst]), ids[worst]
        best = np.lexsort((ids, -scores))
        return ids[best], scores[best]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    q, v, s = (np.concatenate([r[c] for r in rows]) if rows else np.empty(0, np.int64) for c in range(3))
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.int64))], ["query_id", "vec_id", "score"])


def _answers(tree: Tree, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), BLOCK):
        bounds = tree.bounds(q[at : at + BLOCK])
        rows = []
        for n, query_id in enumerate(ids[at : at + BLOCK].tolist()):
            found, scores = tree.search(query_id, q[at + n], bounds[n], k, float(kth[at + n]))
            rows.append((np.full(len(found), query_id), found, scores))
        yield _found(rows)


class Cells:
    """Leaves of KD splits: rows up to ``cut`` along ``side`` go left."""

    def __init__(self, sample: np.ndarray, leaf_rows: float):
        self.side, self.cut, self.kids, self.cell, self.n = [], [], [], [], 0
        self._split(sample, max(leaf_rows, CELL_SAMPLE))

    def _split(self, x: np.ndarray, leaf_rows: float) -> int:
        node = len(self.side)
        for held, value in ((self.side, -1), (self.cut, 0.0), (self.kids, None), (self.cell, -1)):
            held.append(value)
        spread = x.max(axis=0) - x.min(axis=0) if x.size else np.zeros(1)
        if len(x) <= leaf_rows or not spread.any():
            self.cell[node], self.n = self.n, self.n + 1
            return node
        side = int(np.argmax(spread))
        line = x[:, side]
        cut = np.partition(line, (len(x) - 1) // 2)[(len(x) - 1) // 2]
        if cut == line.max():  # more than half of the rows tie at the top
            cut = line[line < cut].max()
        self.side[node], self.cut[node] = side, float(cut)
        self.kids[node] = (self._split(x[line <= cut], leaf_rows), self._split(x[line > cut], leaf_rows))
        return node

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.kids[node] is None:
                out[rows] = self.cell[node]
            elif len(rows):
                left = x[rows, self.side[node]] <= self.cut[node]
                todo += [(self.kids[node][0], rows[left]), (self.kids[node][1], rows[~left])]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_cells(vectors: DataFrame, n_vectors: int, shard_rows: int) -> dict[int, Cells]:
    """Cells by dimension, fitted on about ``SAMPLE`` rows that a hash of the id picks; a dimension outside the sample is one cell."""
    share = min(1.0, SAMPLE / max(1, n_vectors))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(1 << 30)) < int(share * (1 << 30)))
    by_dim: dict[int, list] = {}
    for row in picked.limit(2 * SAMPLE).select("x").collect():
        by_dim.setdefault(len(row[0]), []).append(row[0])
    return {dim: Cells(np.array(rows, np.float64), shard_rows * share) for dim, rows in by_dim.items()}


def dealt(vectors: DataFrame, cells: dict[int, Cells], shard_rows: int) -> DataFrame:
    """``vectors`` with ``dim`` and ``part`` (long): its shard, a cell or a piece of one."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch["x"].value_lengths())
            cell = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                if dim in cells and dim:
                    rows = np.flatnonzero(dims == dim)
                    cell[rows] = cells[dim].of(_matrix(batch["x"].take(pa.array(rows))))
            columns = [batch["vec_id"], batch["x"], batch["asked"], pa.array(dims.astype(np.int32)), pa.array(cell)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "asked", "dim", "cell"])

    rows = vectors.select("vec_id", "x", "asked").mapInArrow(place, "vec_id long, x array<long>, asked boolean, dim int, cell long")
    rows = materialise(rows, "kd-cells")
    pieces = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).alias("pieces"))
    part = F.shiftleft("cell", 32) + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))
    return rows.join(pieces, ["dim", "cell"]).select("dim", part.alias("part"), "vec_id", "x", "asked")


_PACKED = "dim int, part long, ids binary, x binary, more binary, low binary, high binary"


def packed(rows: DataFrame) -> DataFrame:
    """One packed row for each (``dim``, ``part``) of rows of ``vec_id``, ``x``, ``more`` (double), with its bounding box."""

    def pack(tab: pa.Table) -> pa.Table:
        x = tab["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        box = x.reshape(tab.num_rows, -1).astype(np.float64)
        columns = {"ids": tab["vec_id"].to_numpy(), "x": x, "more": tab["more"].to_numpy(), "low": box.min(axis=0), "high": box.max(axis=0)}
        row = {c: [tab[c][0].as_py()] for c in ("dim", "part")} | {c: [np.ascontiguousarray(v).tobytes()] for c, v in columns.items()}
        return pa.Table.from_pydict(row, pa.schema([("dim", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in columns)]))

    return rows.select("dim", "part", "vec_id", "x", "more").groupBy("dim", "part").applyInArrow(pack, _PACKED)


def _unpack(ids, x, more) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_buffer(), np.int64)
    return ids, np.frombuffer(x.as_buffer(), np.int64).reshape(len(ids), -1).astype(np.float64), np.frombuffer(more.as_buffer(), np.float64)


def visits(blocks: DataFrame, boxes: DataFrame, first: bool) -> DataFrame:
    """(dim, part, ids, x, more): the queries of a block that a shard's box can still answer.

    ``first`` takes the most promising foreign shard of each box group, else all
    others. Products of whole numbers are exact, so both passes choose alike.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                dim, home = batch["dim"][n].as_py(), batch["home"][n].as_py()
                ids, x, kth = _unpack(batch["ids"][n], batch["x"][n], batch["more"][n])
                group = batch["boxes"][n].as_py()
                parts = np.array([b["part"] for b in group])
                low, high = (np.array([np.frombuffer(b[c], np.float64) for b in group]) for c in ("low", "high"))
                for at in range(0, len(ids), BLOCK):
                    rows = slice(at, at + BLOCK)
                    reach = np.maximum(x[rows], 0) @ high.T + np.minimum(x[rows], 0) @ low.T
                    reach[:, parts == home] = -np.inf
                    best = reach.argmax(axis=1)
                    is_best = np.arange(len(parts)) == best[:, None]
                    go = (reach >= kth[rows][:, None]) & (is_best if first else ~is_best) & (parts != home)
                    for p in np.flatnonzero(go.any(axis=0)).tolist():
                        pick = np.flatnonzero(go[:, p]) + at
                        yield pa.RecordBatch.from_pydict({
                            "dim": pa.array([dim], pa.int32()), "part": pa.array([parts[p]], pa.int64()),
                            "ids": [ids[pick].tobytes()], "x": [x[pick].astype(np.int64).tobytes()], "more": [kth[pick].tobytes()],
                        })

    met = blocks.select("dim", F.col("part").alias("home"), "ids", "x", "more").join(boxes, "dim")
    return met.mapInArrow(meet, "dim int, part long, ids binary, x binary, more binary")


def answers(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the visits ``asked``: each shard is followed by the blocks that visit it."""
    spread = asked.withColumn("block", F.xxhash64("ids"))
    copies = asked.groupBy("dim", "part").agg(F.ceil(F.count(F.lit(1)) / VISITS).alias("copies"))
    # A shard that very many blocks visit is answered by several copies of it.
    held = shards.join(copies, ["dim", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    held = held.select("dim", "part", "copy", F.lit(False).alias("asks"), "ids", "x", "more")
    spread = spread.join(copies, ["dim", "part"]).select("dim", "part", F.pmod("block", "copies").alias("copy"), F.lit(True).alias("asks"), "ids", "x", "more")
    rows = held.union(spread).repartition("dim", "part", "copy").sortWithinPartitions("dim", "part", "copy", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for asks, *row in zip(*(batch[c] for c in ("asks", "ids", "x", "more"))):
                ids, x, kth = _unpack(*row)
                if not asks.as_py():
                    tree = Tree(ids, x)
                else:
                    yield from _answers(tree, ids, x, kth, k)

    return rows.mapInArrow(search, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank``, up to ``k``; Spark keeps k rows a query before it shuffles them, too."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, is_query: str | Column = "vec_id % 20 = 0") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other rows.

    ``vectors`` has unique ``vec_id`` and ``x``, arrays of longs; rows whose
    ``is_query`` holds are queries. Vectors of different dimensions don't meet.
    Ties go to the smaller id; fewer candidates give fewer rows; no query or no
    candidate gives none. Cells are fitted on a bounded sample (``SAMPLE``); they
    decide where a vector lies, never whether it is found.
    """
    asked = F.expr(is_query) if isinstance(is_query, str) else is_query
    vectors = vectors.where(F.size("x") > 0).withColumn("asked", asked)
    n_vectors = vectors.count()
    placed = materialise(dealt(vectors, fit_cells(vectors, n_vectors, shard_rows), shard_rows), "kd-dealt")
    shards = materialise(packed(placed.withColumn("more", F.col("asked").cast("double"))), "kd-shards")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(batch["ids"], batch["x"], batch["more"]):
                ids, x, is_asked = _unpack(*row)
                own = is_asked > 0
                if own.any():
                    yield from _answers(Tree(ids, x), ids[own], x[own], np.full(int(own.sum()), NONE), k)

    found = materialise(shards.repartition("dim", "part").mapInArrow(at_home, "query_id long, vec_id long, score long"), "kd-home")
    n_shards = shards.count()
    box = F.sort_array(F.collect_list(F.struct("part", "low", "high"))).alias("boxes")
    # About BOXES boxes of neighbouring cells a group.
    group = F.pmod(F.xxhash64("part"), F.lit(-(-n_shards // BOXES) or 1))
    boxes = materialise(shards.groupBy("dim", group.alias("_group")).agg(box).drop("_group"), "kd-boxes")
    for first in (True, False):
        # The k-th score so far, where a query has k others, holds everywhere.
        kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        bounded = placed.where("asked").join(kth, F.col("vec_id") == F.col("query_id"), "left")
        blocks = packed(bounded.withColumn("more", F.coalesce(F.col("kth").cast("double"), F.lit(NONE))))
        asks = materialise(visits(blocks, boxes, first), "kd-visits")
        every = found.select("query_id", "vec_id", "score").union(answers(shards, asks, k))
        found = materialise(best(every, k), "kd-found")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scaled(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, x): components times ``scale``, rounded down, of rows whose components are all finite numbers.

    Null ids, null vectors, and vectors with a null, NaN or infinite component
    take no part (nor do empty ones in ``top_k``); a repeated id keeps one of its
    rows, the least vector.
    """
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform(e, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(x).alias("x"))
