"""Binned training matrix and the histogram pass of tree growth.

Features are binned once, by quantile cuts over all rows, and packed into blocks:
one row of binary columns for some thousands of training rows, a byte a feature.
Every pass of the boosting loop reads this narrow matrix. A counting pass goes
through the blocks, sums gradients per (node, feature, bin) inside each task, and
returns the sums of the non-empty cells; where the tasks' cells are many, reducers
of a feature add them up first. A gathering pass sends the rows of each node that
has no more than ``NODE_ROWS`` to one reducer, which grows the rest of its subtree
by the same rule, so small nodes cost no further passes; larger ones, whatever
their number, are never gathered.

Gradients and losses are summed as whole numbers (fixed point, scaled by what the
largest residual and the number of rows allow), so sums do not depend on the
order in which tasks finish: a repeated or resumed run grows the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Training rows of a block.
BLOCK_ROWS = 1 << 14
#: Sampled rows of a node up to which one task finishes its subtree.
NODE_ROWS = 1 << 22
#: Sampled rows of such a node from which the tasks that send its rows count its cells.
COUNTED_ROWS = 1 << 17
#: Rows up to which the cells of all features are counted together.
FEW_ROWS = 1 << 11
#: Bytes that a reducer, or the driver, is given, about.
REDUCER_BYTES = 1 << 26
#: Cells of features that are counted jointly.
BUNDLE_CELLS = 1 << 12
#: Blocks of a task, about, at most.
TASK_BLOCKS = 64
#: Nodes whose cells of a feature go to a reducer together.
NODE_GROUP = 32
BLOCKS = "n int, bins binary, y binary, p binary, val binary, rk binary"
_CELLS = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("part", "feature", "slots", "first")),
                       *(T.StructField(c, T.BinaryType()) for c in ("cells", "g", "n", "pos")), T.StructField("top", T.DoubleType())])
_GROWN = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("kind", "slot", "feature", "bin")), T.StructField("top", T.DoubleType()),
                       *(T.StructField(c, T.LongType()) for c in ("at", "left", "right", "g", "n", "pos"))])
LOSS, GROWN = 2, 3
# What a row of cells holds beside the cells of a feature.
_LOSSES, _NODE_LOSSES, _ROWS = -2, -1, -3


# --- binning ---------------------------------------------------------------------

def quantile_cuts(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Split thresholds of each feature: midpoints between its quantiles, at most ``max_bins - 1``.

    One aggregation over all rows; a feature with fewer values has a threshold between each two.
    """
    if max_bins > 256:
        raise ValueError("bins are bytes: max_bins is 256 at most")
    probabilities = [i / (max_bins - 1) for i in range(1, max_bins - 1)]
    if not features:
        return []
    finite = [F.when(~F.isnan(f), F.col(f)) for f in features]
    listed = F.expr(f"array({', '.join(map(repr, probabilities))})") if probabilities else None
    quantiles = [F.percentile_approx(c, listed, F.lit(10_000)) if probabilities else F.array(F.min(c)) for c in finite]
    row = df.agg(*[F.array_union(F.array(F.min(c), F.max(c)), q) for c, q in zip(finite, quantiles)]).first()
    cuts = []
    for values in row:
        v = np.array(sorted({x for x in values or [] if x is not None}))
        middle = (v[:-1] + v[1:]) / 2.0
        cuts.append(np.where(middle < v[1:], middle, v[:-1]))
    return cuts


def to_blocks(rows: DataFrame, features: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of rows with ``_y``, ``_p``, ``_val``, ``_rk`` and the features as doubles."""
    names = list(features)

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda c: np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in parts])
        # Left if value <= threshold: the bin is the number of thresholds below the value.
        bins = [np.searchsorted(cut, column(c)).astype(np.uint8).tobytes() for c, cut in zip(names, cuts)]
        values = [sum(b.num_rows for b in parts), b"".join(bins), *(column(c).astype(t).tobytes() for c, t in (("_y", "<f8"), ("_p", "<f8"), ("_val", "u1"), ("_rk", "<i8")))]
        return pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int32()), *(pa.array([v], pa.binary()) for v in values[1:])], ["n", "bins", "y", "p", "val", "rk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK_ROWS - size)
                batch = batch.slice(some.num_rows)
                held.append(some)
                size += some.num_rows
                if size == BLOCK_ROWS:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return rows.select(*[F.col(c).cast("double").alias(c) for c in names], F.col("_y").cast("double"), F.col("_p").cast("double"), "_val", "_rk").mapInArrow(run, BLOCKS)


@dataclass
class BinTree:
    """A tree on bins: feature (-1: leaf), last bin that goes left, children, value."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __post_init__(self) -> None:
        self._steps: tuple | None = None

    def _table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Feature of each node, the node after each (node, bin), both times 256, and the levels; a leaf leads to itself."""
        if self._steps is None:
            own, inner = np.arange(len(self.feature)), np.asarray(self.feature) >= 0
            right = np.arange(256)[None, :] > np.asarray(self.split)[:, None]
            after = np.where(right, np.asarray(self.right)[:, None], np.asarray(self.left)[:, None])
            after = np.where(inner[:, None], after, own[:, None]).astype(np.int64) << 8
            levels, at = 0, {0}
            while at := {int(k) for n in at if inner[n] for k in (self.left[n], self.right[n])}:
                levels += 1
            self._steps = np.maximum(self.feature, 0).astype(np.int64), after.ravel(), levels
        return self._steps

    def leaf(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Node that each column of ``bins``, or each of the columns ``rows``, ends in."""
        feature, after, levels = self._table()
        n = bins.shape[1]
        rows = np.arange(n) if rows is None else rows
        if not levels:
            return np.zeros(len(rows), np.int64)
        flat, start = bins.reshape(-1), feature * n
        at = after.take(flat.take(start[0] + rows))
        for _ in range(levels - 1):
            node = at >> 8
            place = start.take(node)
            place += rows
            at += flat.take(place)
            at = after.take(at)
        return at >> 8

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_steps": None}


class Bundles:
    """Features of few bins counted jointly: the cells of one are sums over those of the others."""

    def __init__(self, widths: Sequence[int]):
        self.widths = list(widths)
        self.groups: list[list[int]] = []
        size = 0
        for i in sorted(range(len(self.widths)), key=lambda i: self.widths[i]):
            if not self.groups or size * self.widths[i] > BUNDLE_CELLS:
                self.groups.append([])
                size = 2
            self.groups[-1].append(i)
            size *= self.widths[i]

    def sizes(self) -> list[int]:
        return [2 * math.prod(self.widths[i] for i in group) for group in self.groups]

    def codes(self, columns: Sequence[np.ndarray], pos: np.ndarray) -> Iterator[np.ndarray]:
        """A cell of each bundle per row; under-estimated rows have every other one."""
        for group in self.groups:
            code, step = pos.astype(np.uint16), 2
            for i in group:
                code += columns[i] * np.uint16(step)
                step *= self.widths[i]
            yield code

    def spread(self, sums: Sequence[np.ndarray], bins: int) -> np.ndarray:
        """Sums of the bundles' cells (nodes x cells) as nodes x features x bins x 2."""
        out = np.zeros((len(sums[0]) if sums else 0, len(self.widths), bins, 2), np.int64)
        for group, cells in zip(self.groups, sums):
            wide = cells.reshape(len(cells), *(self.widths[i] for i in reversed(group)), 2)
            for k, i in enumerate(group):
                own = len(group) - k
                out[:, i, : self.widths[i]] = wide.sum(axis=tuple(a for a in range(1, len(group) + 1) if a != own))
        return out


def _block(row: dict, trees: Sequence[BinTree]):
    """A block's bins, labels, predictions with ``trees`` added, validation flags and row keys."""
    n = row["n"]
    read = lambda c, t: np.frombuffer(row[c], t)
    bins, p = read("bins", np.uint8).reshape(-1, n), read("p", "<f8").copy()
    for tree in trees:
        p += tree.value[tree.leaf(bins)]
    return bins, read("y", "<f8"), p, read("val", "u1").astype(bool), read("rk", "<u8")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {f.name: batch[k][i].as_buffer() if f.type == pa.binary() else batch[k][i].as_py() for k, f in enumerate(batch.schema)}


def advance(blocks: DataFrame, trees: Sequence[BinTree], only_validation: bool = False) -> DataFrame:
    """Blocks with the values of ``trees`` added to their predictions."""
    trees = list(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, p, val, _ = _block(row, trees)
            if only_validation and not val.all():
                continue
            out = {**row, "p": p.tobytes()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["n"]], pa.int32()), *(pa.array([bytes(out[c])], pa.binary()) for c in ("bins", "y", "p", "val", "rk"))], ["n", "bins", "y", "p", "val", "rk"]
            )

    return blocks.mapInArrow(run, BLOCKS)


# --- the pass --------------------------------------------------------------------

@dataclass
class Scale:
    """Fixed point of gradients and losses that no sum over ``n`` rows with residuals up to ``top`` leaves."""

    gradient: float
    loss: float

    @classmethod
    def of(cls, n: int, top: float, penalty: float) -> "Scale":
        top, w, room = max(top, 1e-300), max(penalty, 1.0), 61 - math.ceil(math.log2(n + 1))
        # A block's gradients are summed in doubles, exact up to 2 ** 53.
        bits = min(room, 52 - math.ceil(math.log2(BLOCK_ROWS)))
        power = lambda b, most: 2.0 ** max(-900, min(900, b - math.ceil(math.log2(most))))
        return cls(power(bits, 2.0 * w * top), power(min(room, 51), max(w * top * top, 1e-250)))


def picked_rows(rk: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """Rows of the round's subsample, by a hash of the row key."""
    if rate >= 1.0:
        return np.ones(len(rk), bool)
    with np.errstate(over="ignore"):
        h = rk ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h % np.uint64(1_000_000) < np.uint64(round(rate * 1_000_000))


@dataclass
class Pass:
    """What one pass over the blocks does; it travels to the tasks."""

    fresh: list[BinTree]  # trees that the written predictions lack
    tree: BinTree | None  # the tree grown so far
    slots: np.ndarray  # node -> place among the nodes to count or to finish, -1: none
    m: int  # nodes whose cells are counted, the first ones
    depths: list[int]  # of a gathering pass: levels left of each node that is finished from its rows, and
    owners: list[int]  # its reducer
    chosen: list[int]  # features of the round, and
    widths: list[int]  # their bins
    rate: float
    seed: int
    penalty: float
    scale: Scale
    losses: bool
    bins: int
    reducers: int  # 0: a counting pass whose tasks' cells go to the driver

    def part(self, i: int, group: int) -> int:
        return (i * -(-self.m // NODE_GROUP) + group) % max(1, self.reducers)

    def map(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, small, bundles = self.m, len(self.depths), Bundles(self.widths)
        # Gradients and rows per node and cell of each bundle.
        sums = [np.zeros((2, m * size), np.int64) for size in bundles.sizes()] if m else []
        node_loss, total, top, seen = np.zeros(m, np.int64), np.zeros(4, np.int64), 0.0, False
        for row in _rows(batches):
            seen = True
            bins, y, p, val, rk = _block(row, self.fresh)
            r = y - p
            if self.losses:
                loss = self._loss(r, np.where(r > 0, self.penalty, 1.0))
                total += (loss[~val].sum(), (~val).sum(), loss[val].sum(), val.sum())
                top = max(top, float(np.abs(r).max(initial=0.0)))
            if not m and not small:
                continue
            at = np.flatnonzero(~val & picked_rows(rk, self.rate, self.seed))
            slot = self.slots.take(self.tree.leaf(bins, at))
            if self.slots.min() < 0:
                held = np.flatnonzero(slot >= 0)
                at, slot = at.take(held), slot.take(held)
            if small:
                # Few kinds of slots: sorted by their bytes.
                order = slot.astype(np.int16).argsort(kind="stable")
                at, slot = at.take(order), slot.take(order)
            r = r.take(at)
            pos = r > 0
            w = np.where(pos, self.penalty, 1.0)
            g = np.rint(-2.0 * w * r * self.scale.gradient)
            if small:
                ends = np.searchsorted(slot, np.arange(small + 1)).tolist()
                columns, g = bins[self.chosen].take(at, axis=1), g.astype(np.int64)
                sent = [
                    (self.owners[k], _ROWS, 0, k, columns[:, a:b].tobytes(), g[a:b].tobytes(), b"", pos[a:b].tobytes(), 0.0)
                    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a
                ]
                if sent:
                    yield _cells(sent)
                slot, pos, g, columns = slot[: ends[m]], pos[: ends[m]], g[: ends[m]].astype(float), columns[:, : ends[m]]
            elif m:
                columns, loss = [bins[f].take(at) for f in self.chosen], self._loss(r, w)
                if m == 1:
                    node_loss += loss.sum()
                else:
                    np.add.at(node_loss, slot, loss)
            if not m:
                continue
            for held, code in zip(sums, bundles.codes(columns, pos)):
                code = code.astype(np.intp) if m == 1 else slot * (held.shape[1] // m) + code
                held[0] += np.bincount(code, g, held.shape[1]).astype(np.int64)
                held[1] += np.bincount(code, minlength=held.shape[1])
        if not seen:
            return
        out = []
        if self.losses:
            out.append((0, _LOSSES, 0, 0, b"", total.tobytes(), b"", b"", top))
        if m:
            if not small:
                out.append((0, _NODE_LOSSES, m, 0, b"", node_loss.tobytes(), b"", b"", 0.0))
            g_sum, n_sum = (bundles.spread([held[k].reshape(m, -1) for held in sums], self.bins) for k in range(2))
            g_sum, pos_sum, n_sum = g_sum.sum(3), n_sum[..., 1], n_sum.sum(3)
            # A gathered node's cells go where its rows go.
            step = 1 if small else NODE_GROUP
            for i in range(len(self.chosen)):
                for group, first in enumerate(range(0, m, step)):
                    span = slice(first, min(first + step, m))
                    cells = np.flatnonzero(n_sum[span, i])
                    values = [a[span, i].ravel()[cells].tobytes() for a in (g_sum, n_sum, pos_sum)]
                    part = self.owners[first] if small else self.part(i, group)
                    out.append((part, i, span.stop - first, first, cells.astype(np.int32).tobytes(), *values, 0.0))
        if out:
            yield _cells(out)

    def _loss(self, r: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.rint(w * r * r * self.scale.loss).astype(np.int64)


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] * 4 + [pa.binary()] * 4 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _CELLS.names)


def split_gains(g: np.ndarray, n: np.ndarray, pos: np.ndarray, scale: float, penalty: float, alpha: float, lam: float, least: float):
    """Gains of all splits of histograms (nodes x bins), -inf where a side has less hessian than ``least``; and the running sums."""
    gl, nl, pl = g.cumsum(1), n.cumsum(1), pos.cumsum(1)
    hess = lambda n, pos: 2.0 * (n - pos) + 2.0 * penalty * pos
    score = lambda g, h: np.square(np.maximum(np.abs(g / scale) - alpha, 0.0)) / np.where(h + lam > 0, h + lam, 1.0)
    gt, nt, pt = gl[:, -1:], nl[:, -1:], pl[:, -1:]
    hl, hr = hess(nl, pl), hess(nt - nl, pt - pl)
    gain = 0.5 * (score(gl, hl) + score(gt - gl, hr) - score(gt, hess(nt, pt)))
    return np.where((nl > 0) & (nl < nt) & (hl >= least) & (hr >= least), gain, -np.inf), gl, nl, pl


@dataclass
class Rule:
    """When a node is split: gain above ``least_gain``, sides of ``least`` hessian, loss of ``gamma`` or more."""

    alpha: float
    lam: float
    least: float
    gamma: float
    least_gain: float


def may_gain(loss: float, g: float, h: float, rule: Rule) -> bool:
    """Whether a node of these loss, gradient and hessian sums may hold a split that gains ``gamma``, at any depth below.

    Both sides' scores are at most twice their losses, so a split gains no more than the loss beyond half of
    the node's own score; and what remains of that bound for the sides is less by the gain.
    """
    s = max(abs(g) - rule.alpha, 0.0)
    return loss - 0.5 * s * s / max(h + rule.lam, 1e-300) + 1e-9 * loss >= rule.gamma


def finish_node(bins: np.ndarray, g: np.ndarray, pos: np.ndarray, depth: int, task: Pass, rule: Rule, cells: np.ndarray | None = None) -> list[tuple]:
    """Subtree of a node from its rows (chosen features x rows): (feature, bin, left, right, g, n, pos) per node, the root first.

    ``cells`` are the node's sums, if they are known.
    """
    hess = lambda n, p: 2.0 * (n - p) + 2.0 * task.penalty * p
    width = len(bins) * task.bins
    offset = (np.arange(len(bins)) * task.bins)[:, None]
    # Loss of each row: its squared gradient over four times its weight.
    loss = np.square(g / task.scale.gradient) / np.where(pos, 4.0 * task.penalty, 4.0)
    bundles = Bundles(task.widths)
    codes = list(bundles.codes(bins, pos)) if len(g) > FEW_ROWS else []
    out: list[list] = []
    # Gradients of so many rows have an exact sum in doubles.
    exact = max(BLOCK_ROWS, min(4 * BLOCK_ROWS, 1 << 52 - int(np.abs(g).max(initial=1)).bit_length()))

    def sums(rows: np.ndarray) -> np.ndarray:
        """Gradients, rows and under-estimated rows per cell."""
        if len(rows) > FEW_ROWS:
            held = [np.zeros((2, size), np.int64) for size in bundles.sizes()]
            for start in range(0, len(rows), exact):
                some = rows[start : start + exact]
                weight = g.take(some).astype(float)
                for of, to in zip(codes, held):
                    cell = of.take(some).astype(np.intp)
                    to[0] += np.bincount(cell, weight, to.shape[1]).astype(np.int64)
                    to[1] += np.bincount(cell, minlength=to.shape[1])
            by_g, by_n = (bundles.spread([h[k][None] for h in held], task.bins)[0] for k in range(2))
            return np.stack([by_g.sum(2), by_n.sum(2), by_n[..., 1]]).reshape(3, -1)
        cell = (bins.take(rows, axis=1) + (offset + width * pos[rows])).ravel()
        by_g = np.bincount(cell, np.tile(g[rows], len(bins)), 2 * width).astype(np.int64)
        by_n = np.bincount(cell, minlength=2 * width)
        return np.stack([by_g[:width] + by_g[width:], by_n[:width] + by_n[width:], by_n[width:]])

    def searched(of: tuple, depth: int) -> bool:
        return depth > 0 and of[1] >= 2 and hess(*of[1:]) >= 2.0 * rule.least

    def gains(of: tuple, rows: np.ndarray) -> bool:
        return may_gain(float(loss.take(rows).sum()), of[0] / task.scale.gradient, hess(*of[1:]), rule)

    def visit(rows: np.ndarray | None, depth: int, of: tuple, cells: np.ndarray | None) -> int:
        """Grow from ``rows``, whose gradients, number and under-estimated number are ``of``; without sums, a leaf."""
        at = len(out)
        out.append([-1, 0, -1, -1, *of])
        if cells is None:
            return at
        gain, gl, nl, pl = split_gains(*cells.reshape(3, len(bins), -1), task.scale.gradient, task.penalty, rule.alpha, rule.lam, rule.least)
        f, b = divmod(int(gain.argmax()), task.bins)
        if not gain[f, b] > rule.least_gain:
            return at
        low = (int(gl[f, b]), int(nl[f, b]), int(pl[f, b]))
        parts = [low, tuple(whole - part for whole, part in zip(of, low))]
        below: list[np.ndarray | None] = [None, None]
        sides: list[np.ndarray | None] = [None, None]
        wanted = [searched(part, depth - 1) for part in parts]
        if any(wanted):
            left = bins[f].take(rows) <= b
            sides = [rows[left], rows[~left]]
            wanted = [want and gains(part, side) for want, part, side in zip(wanted, parts, sides)]
        if any(wanted):
            # The smaller side is summed up; the larger has what is left.
            small = int(parts[1][1] < parts[0][1])
            part = sums(sides[small])
            below = [(part if k == small else cells - part) if wanted[k] else None for k in range(2)]
        out[at][:2] = f, b
        out[at][2] = visit(sides[0], depth - 1, parts[0], below[0])
        out[at][3] = visit(sides[1], depth - 1, parts[1], below[1])
        return at

    every, whole = np.arange(len(g)), (int(g.sum()), len(g), int(pos.sum()))
    known = searched(whole, depth) and gains(whole, every)
    visit(every, depth, whole, None if not known else sums(every) if cells is None else cells)
    return [tuple(n) for n in out]


class Sums:
    """Cells, node losses and losses of tasks, added up."""

    def __init__(self, bins: int):
        self.bins, self.held = bins, {}
        self.total, self.top, self.losses, self.node_loss = np.zeros(4, np.int64), 0.0, False, np.zeros(0, np.int64)

    def add(self, r: dict) -> None:
        values = [np.frombuffer(r[c], np.int64) for c in ("g", "n", "pos")]
        if r["feature"] == _LOSSES:
            self.total, self.top, self.losses = self.total + values[0], max(self.top, r["top"]), True
        elif r["feature"] == _NODE_LOSSES:
            self.node_loss = self.node_loss + values[0] if len(self.node_loss) else values[0]
        else:
            key = (r["feature"], r["first"], r["slots"])
            if key not in self.held:
                self.held[key] = np.zeros((3, r["slots"] * self.bins), np.int64)
            cells = np.frombuffer(r["cells"], np.int32)
            for a, v in zip(self.held[key], values):
                a[cells] += v

    def rows(self) -> list[tuple]:
        """Rows of ``_CELLS`` again."""
        out = []
        if self.losses:
            out.append((0, _LOSSES, 0, 0, b"", self.total.tobytes(), b"", b"", self.top))
        if len(self.node_loss):
            out.append((0, _NODE_LOSSES, len(self.node_loss), 0, b"", self.node_loss.tobytes(), b"", b"", 0.0))
        for (i, first, slots), a in sorted(self.held.items()):
            cells = np.flatnonzero(a[1])
            out.append((0, i, slots, first, cells.astype(np.int32).tobytes(), *(v[cells].tobytes() for v in a), 0.0))
        return out

    def nodes(self, m: int, features: int) -> np.ndarray:
        """Sums per (node, kind, feature, bin)."""
        out = np.zeros((m, 3, features, self.bins), np.int64)
        for (i, first, slots), a in self.held.items():
            out[first : first + slots, :, i] = a.reshape(3, slots, self.bins).swapaxes(0, 1)
        return out


def _add(task: Pass):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(task.bins)
        for r in _rows(batches):
            sums.add(r)
        if out := sums.rows():
            yield _cells(out)

    return run


def _finish(task: Pass, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, whole = Sums(task.bins), {}
        for r in _rows(batches):
            if r["feature"] == _ROWS:
                whole.setdefault(r["first"], []).append((r["cells"], r["g"], r["pos"]))
            else:
                sums.add(r)
        out = []
        if sums.losses:
            total = [int(v) for v in sums.total]
            out.append((LOSS, 0, 0, 0, sums.top, 0, total[0], total[2], 0, total[1], total[3]))
        for slot in list(whole):
            parts = whole.pop(slot)
            bins = np.concatenate([np.frombuffer(p[0], np.uint8).reshape(len(task.chosen), -1) for p in parts], axis=1)
            g, pos = (np.concatenate([np.frombuffer(p[k], t) for p in parts]) for k, t in ((1, np.int64), (2, np.bool_)))
            del parts
            cells = np.stack([sums.held.pop((i, slot, 1)) for i in range(len(task.chosen))], axis=1).reshape(3, -1) if slot < task.m else None
            grown = finish_node(bins, g, pos, task.depths[slot], task, rule, cells)
            out += [(GROWN, slot, f, b, 0.0, k, left, right, gs, n, ps) for k, (f, b, left, right, gs, n, ps) in enumerate(grown)]
        if out:
            types = [pa.int32()] * 4 + [pa.float64()] + [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _GROWN.names)

    return run


@dataclass
class Found:
    """What a pass found: losses of both sides and the largest residual, sums and loss of each node counted, subtrees."""

    losses: dict | None
    cells: np.ndarray | None = None
    node_loss: np.ndarray | None = None
    grown: dict[int, list[dict]] | None = None


def run_pass(blocks: DataFrame, task: Pass, rule: Rule) -> Found:
    mapped = blocks.mapInArrow(task.map, _CELLS)
    if task.depths:
        found = mapped.repartitionById(task.reducers, "part").mapInArrow(_finish(task, rule), _GROWN).toArrow().to_pylist()
        grown: dict[int, list[dict]] = {}
        for r in sorted((r for r in found if r["kind"] == GROWN), key=lambda r: (r["slot"], r["at"])):
            grown.setdefault(r["slot"], []).append(r)
        loss = next((r for r in found if r["kind"] == LOSS), None)
        return Found(loss and _both(loss["top"], [loss["left"], loss["n"], loss["right"], loss["pos"]]), grown=grown)
    if task.reducers:
        mapped = mapped.repartitionById(task.reducers, "part").mapInArrow(_add(task), _CELLS)
    sums = Sums(task.bins)
    for r in _rows(mapped.toArrow().to_batches()):
        sums.add(r)
    losses = _both(sums.top, [int(v) for v in sums.total]) if sums.losses else None
    return Found(losses, sums.nodes(task.m, len(task.chosen)), sums.node_loss if len(sums.node_loss) else np.zeros(task.m, np.int64))


def _both(top: float, total: list[int]) -> dict:
    return {"top": top, "train": (total[0], total[1]), "validation": (total[2], total[3])}


def measure(blocks: DataFrame) -> tuple[int, int, float]:
    """Rows of the blocks, those for training, and the largest residual of their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, train, top = 0, 0, 0.0
        for row in _rows(batches):
            _, y, p, val, _ = _block(row, [])
            n, train, top = n + row["n"], train + int((~val).sum()), max(top, float(np.abs(y - p).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([train], pa.int64()), pa.array([top], pa.float64())], ["n", "train", "top"])

    row = blocks.mapInArrow(run, "n long, train long, top double").agg(F.sum("n"), F.sum("train"), F.max("top")).first()
    return row[0] or 0, row[1] or 0, row[2] or 0.0


def few_partitions(rows: DataFrame) -> DataFrame:
    """Rows in no more partitions than full blocks would need four of each: tiny tasks cost more than they do."""
    return rows.coalesce(max(1, -(-rows.count() // (4 * BLOCK_ROWS))))


def even_partitions(blocks: DataFrame, n: int, cores: int) -> tuple[DataFrame, int]:
    """Blocks of ``n`` rows dealt evenly to as many partitions as there are cores, or a multiple that holds ``TASK_BLOCKS`` each; and their number."""
    full = max(1, -(-n // BLOCK_ROWS))
    parts = min(full, cores) * -(-full // (cores * TASK_BLOCKS))
    return blocks.repartition(parts), parts
