"""Distributed gradient boosting with the asymmetric loss (M4, M5, M7, M8).

Each round grows one depth-wise tree on gradients and hessians of the loss:

1. features are binned once, by quantile cuts, into a narrow matrix of blocks
   (``operators.histogram``) that all rounds read, with labels and predictions;
2. a level of large nodes is one job: every task sums gradients per (node, feature,
   bin) of the side of each split that has fewer rows; the other side has what is
   left of the parent. Nodes of fewer rows wait, and one job more sends the rows of
   each to one reducer, which finishes its subtree. A node whose loss beyond half
   of its own score is below ``gamma`` cannot hold a split that gains as much and
   is not searched;
3. splits that gain less than ``gamma`` are pruned bottom-up, and leaves get
   v = -sign(G) max(|G| - alpha, 0) / (H + lambda), times the learning rate.

The first job of a round also measures the losses of the predictions so far.
Only sums reach the driver, of cells of large nodes and of losses, and the nodes of
finished subtrees. Where the tasks' cells are many, reducers add them up first.
Sums are whole numbers, so the same input grows the same trees again.

Predictions are written every few rounds (trees since then are added on the
fly); this cuts the lineage. With a run folder, the written state, the nodes
and a manifest stay there, and a run that lost its driver goes on from them.
"""

from __future__ import annotations

import json
import logging
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelane.config import BOOST, TARGET, BoostParams
from surgelane.operators.histogram import (
    COUNTED_ROWS, NODE_ROWS, REDUCER_BYTES, BinTree, Pass, Rule, Scale, advance, even_partitions, few_partitions, may_gain, measure, quantile_cuts, run_pass, split_gains, to_blocks,
)
from surgelane.session import StateTables, delete_path, list_folders, materialise, settings

log = logging.getLogger(__name__)

_Y, _P, _VAL, _RK = "_y", "_p", "_val", "_rk"
NODE_SCHEMA = "tree int, node int, feature string, threshold double, left int, right int, value double, gain double, cover double"


def shrunk(g: float, alpha: float) -> float:
    return max(abs(g) - alpha, 0.0)


def leaf_value(g: float, h: float, alpha: float, lam: float) -> float:
    s = shrunk(g, alpha)
    return -math.copysign(s, g) / (h + lam) if s > 0 else 0.0


def structure_score(g: float, h: float, alpha: float, lam: float) -> float:
    s = shrunk(g, alpha)
    return s * s / (h + lam)


@dataclass
class Node:
    """A split (feature, threshold: left if value <= threshold) or a leaf (value, learning rate applied).

    ``cover`` is the hessian sum of the training rows that reach the node.
    """

    feature: str | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    value: float = 0.0
    gain: float = 0.0
    cover: float = 0.0


@dataclass
class BoostedTrees:
    features: list[str]
    base_score: float
    trees: list[list[Node]] = field(default_factory=list)
    best_iteration: int = -1
    history: list[dict] = field(default_factory=list)

    @property
    def n_trees(self) -> int:
        return len(self.trees)

    # --- scoring -----------------------------------------------------------
    def predict(self, df: DataFrame, output: str = "prediction", start: int = 0, base: str | None = None) -> DataFrame:
        """Add ``output``: base score plus the leaf values of the trees from ``start`` on.

        With ``base``, that column takes the base score's place. One pass over
        ``df`` applies all trees to Arrow batches.
        """
        trees = [_arrays(tree, self.features) for tree in self.trees[start:]]
        names = [f"_x{i}" for i in range(len(self.features))]
        first = F.col(base) if base else F.lit(float(self.base_score))
        keep = [c for c in df.columns if c != output]
        wide = df.select(*keep, first.cast("double").alias(output), *[F.col(f).cast("double").alias(n) for f, n in zip(self.features, names)])
        schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(output, T.DoubleType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch[n].to_numpy(zero_copy_only=False) for n in names], axis=1) if names else np.empty((batch.num_rows, 0))
                total = batch[output].to_numpy(zero_copy_only=False).copy()
                for tree in trees:
                    total += _descend(tree, x)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(total)], [*keep, output])

        return wide.mapInArrow(score, schema)

    # --- importance --------------------------------------------------------
    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance_gain): average gain of the feature's splits."""
        return self.importances(spark).select("feature", F.col("gain").alias("importance_gain"))

    def importances(self, spark: SparkSession) -> DataFrame:
        """Per feature of any split: how many (``weight``), their average and total ``gain`` and ``cover``."""
        return node_importances(self.nodes(spark))

    # --- persistence -------------------------------------------------------
    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(t, k, n.feature, n.threshold, n.left, n.right, n.value, n.gain, n.cover) for t, tree in enumerate(self.trees) for k, n in enumerate(tree)]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> str:
        """One table of nodes and one line of JSON."""
        meta = {"features": self.features, "base_score": self.base_score, "best_iteration": self.best_iteration, "history": self.history}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(trees=read_trees(spark, f"{path}/nodes"), **meta)


def read_trees(spark: SparkSession, path: str) -> list[list[Node]]:
    trees: dict[int, list[Node]] = {}
    for r in sorted(spark.read.schema(NODE_SCHEMA).parquet(path).collect(), key=lambda r: (r["tree"], r["node"])):
        trees.setdefault(r["tree"], []).append(Node(r["feature"], r["threshold"], r["left"], r["right"], r["value"], r["gain"], r["cover"]))
    return [trees[t] for t in sorted(trees)]


def node_importances(nodes: DataFrame) -> DataFrame:
    """Weight, average and total gain and cover per feature of a table of nodes."""
    return nodes.where("feature is not null").groupBy("feature").agg(
        F.count(F.lit(1)).alias("weight"), F.avg("gain").alias("gain"), F.avg("cover").alias("cover"),
        F.sum("gain").alias("total_gain"), F.sum("cover").alias("total_cover"),
    )


def _arrays(tree: Sequence[Node], features: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Feature numbers (-1: leaf), thresholds, children and values of a tree's nodes."""
    at = {f: i for i, f in enumerate(features)}
    own = np.arange(len(tree))
    feature = np.array([-1 if n.feature is None else at[n.feature] for n in tree])
    threshold = np.array([0.0 if n.threshold is None else n.threshold for n in tree])
    left = np.array([k if n.left is None else n.left for k, n in zip(own, tree)])
    right = np.array([k if n.right is None else n.right for k, n in zip(own, tree)])
    return feature, threshold, left, right, np.array([n.value for n in tree])


def _descend(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = tree
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (feature[node] >= 0).any():
        f = feature[node]
        node = np.where((f < 0) | (x[rows, f] <= threshold[node]), left[node], right[node])
    return value[node]


def regularise(nodes: list[Node], sums: dict[int, tuple[float, float]], params: BoostParams) -> list[Node]:
    """Leaf values, split gains and pruning from the (G, H) of each leaf, numbered left to right.

    Bottom-up, a split between two leaves that gains less than ``gamma`` becomes
    a leaf. Values have the learning rate applied. Nodes are renumbered.
    """
    alpha, lam = params.reg_alpha, params.reg_lambda
    leaf = iter(range(len(nodes)))

    def cut(g: float, h: float) -> tuple[float, float, list[Node]]:
        return g, h, [Node(value=params.learning_rate * leaf_value(g, h, alpha, lam), cover=h)]

    def grow(at: int) -> tuple[float, float, list[Node]]:
        n = nodes[at]
        if n.feature is None:
            return cut(*sums.get(next(leaf), (0.0, 0.0)))
        gl, hl, left = grow(n.left)
        gr, hr, right = grow(n.right)
        g, h = gl + gr, hl + hr
        gain = 0.5 * (structure_score(gl, hl, alpha, lam) + structure_score(gr, hr, alpha, lam) - structure_score(g, h, alpha, lam))
        if len(left) == len(right) == 1 and gain < params.gamma:
            return cut(g, h)
        shift = lambda part, by: [Node(x.feature, x.threshold, x.left and x.left + by, x.right and x.right + by, x.value, x.gain, x.cover) for x in part]
        return g, h, [Node(n.feature, n.threshold, 1, 1 + len(left), 0.0, gain, h), *shift(left, 1), *shift(right, 1 + len(left))]

    return grow(0)[2]


def expectile(df: DataFrame, label: str, penalty: float) -> float:
    """Constant minimising the asymmetric loss, exactly.

    One aggregation counts the values; on that table the weighted mean of the
    values above and below the last mean is taken until no value changes sides,
    which ends since the loss is convex and quadratic between values.
    """
    counts = materialise(df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "label_counts")
    v, n = F.col("v"), F.col("n")
    row = counts.agg(F.sum(v * n).alias("s"), F.sum(n).alias("n")).first()
    if not row["n"]:
        return 0.0
    mean, seen = row["s"] / row["n"], set()
    while True:
        high = v > F.lit(mean)
        got = counts.agg(
            F.sum(F.when(high, v * n).otherwise(0.0)).alias("sh"), F.sum(F.when(high, n).otherwise(0)).alias("nh"),
            F.sum(F.when(high, 0.0).otherwise(v * n)).alias("sl"), F.sum(F.when(high, 0).otherwise(n)).alias("nl"),
        ).first()
        mean = (penalty * got["sh"] + got["sl"]) / (penalty * got["nh"] + got["nl"])
        # A side seen before: a value equal to the mean may change sides by rounding.
        if got["nh"] in seen:
            return float(mean)
        seen.add(got["nh"])


def _prepared(df: DataFrame, features: Sequence[str], label: str, valid_col: str | None, keep: Sequence[str] = ()) -> DataFrame:
    rk = F.xxhash64(*[F.col(c) for c in list(features) + [label]])
    val = F.col(valid_col).cast("boolean") if valid_col else F.lit(False)
    return df.select(
        *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(_Y), val.alias(_VAL), rk.alias(_RK), *keep
    )


def bin_tree(tree: Sequence[Node], features: Sequence[str], cuts: Sequence[np.ndarray]) -> BinTree:
    """A tree whose thresholds are among ``cuts``, on bins."""
    feature, threshold, left, right, value = _arrays(tree, features)
    split = np.array([0 if f < 0 else np.searchsorted(cuts[f], t) for f, t in zip(feature, threshold)])
    return BinTree(feature, split, left, right, value)


#: Trees that the two passes of a round add to predictions; keeping the blocks anew costs more than fewer.
FRESH_TREES = 4
#: A split must gain more than this.
LEAST_GAIN = 1e-6
#: A block holds a thousand times a row's bytes: batches of so many bytes go to a Python worker, not whole partitions.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}


def _grow(
    blocks: DataFrame, tasks: int, fresh: list[BinTree], features: list[str], cuts: list[np.ndarray], params: BoostParams, rnd: int, scale: Scale, n_train: int, reducers: int
) -> tuple[list[Node], dict | None, int]:
    """Grow the round's tree on the predictions of ``blocks`` (``tasks`` partitions) and ``fresh``: (its pruned nodes, losses and largest residual before it, its passes)."""
    penalty, at = params.underestimation_penalty, {f: i for i, f in enumerate(features)}
    chosen = sorted(random.Random(params.seed + rnd).sample(range(len(features)), max(1, round(params.colsample * len(features)))))
    widths = [len(cuts[f]) + 1 for f in chosen]
    rule = Rule(params.reg_alpha, params.reg_lambda, params.min_child_weight, params.gamma, LEAST_GAIN)
    hess = lambda n, pos: 2.0 * (n - pos) + 2.0 * penalty * pos
    nodes, splits, depths, before, passes = [Node()], [-1], [0], None, 0
    # Gradient sum (whole), rows and rows under-estimated of each node.
    sums = [(0, n_train, 0)]

    def split(node: int, feature: int, last: int) -> None:
        f = chosen[feature]
        nodes[node].feature, nodes[node].threshold, splits[node] = features[f], float(cuts[f][last]), last

    def add(parts: tuple, depth: int) -> int:
        nodes.append(Node())
        sums.append(parts)
        splits.append(-1)
        depths.append(depth)
        return len(nodes) - 1

    def look(places: list[int], gather: bool):
        """A pass that counts the cells of ``places``, or finishes them from their rows."""
        nonlocal before, passes
        # The largest come first: the cells of those are counted in any case.
        places.sort(key=lambda k: -sums[k][1])
        slots = np.full(len(nodes), -1)
        slots[places] = np.arange(len(places))
        tree = BinTree(
            np.array([-1 if n.feature is None else at[n.feature] for n in nodes]), np.array(splits),
            np.array([-1 if n.left is None else n.left for n in nodes]), np.array([-1 if n.right is None else n.right for n in nodes]), np.zeros(len(nodes)),
        )
        first, passes = not passes, passes + 1
        own: list[int] = []
        if gather:
            # Nodes share the cores by their rows; beyond, a reducer is given so many bytes, whatever their number.
            size = sum(sums[k][1] for k in places) * (len(chosen) + 9)
            parts = max(1, min(reducers, len(places)), -(-size // REDUCER_BYTES))
            load = [0] * parts
            for k in places:
                own.append(load.index(min(load)))
                load[own[-1]] += sums[k][1]
        else:
            # The driver adds up the cells of few tasks; of many, reducers do.
            size = min(sum(sums[k][1] for k in places) * len(chosen), tasks * len(places) * sum(widths)) * 24
            parts = 0 if size <= REDUCER_BYTES else max(1, min(reducers, len(places)), -(-size // REDUCER_BYTES))
        left = [params.max_depth - depths[k] for k in places] if gather else []
        counted = sum(sums[k][1] >= COUNTED_ROWS for k in places) if gather else len(places)
        task = Pass(fresh, tree, slots, counted, left, own, chosen, widths, params.subsample, params.seed + rnd, penalty, scale, first, params.max_bins, parts)
        found = run_pass(blocks, task, rule)
        before = found.losses if first else before
        return found

    # A level's large nodes with their cells and losses; small ones wait until the large are split.
    small, level = ([0], {}) if n_train <= NODE_ROWS else ([], {0: None})
    while level:
        # Of two sides the one of fewer rows is counted; the other has what is left.
        asked = [k for k, pair in level.items() if pair is None]
        found = look(asked, False)
        cells, loss = dict(zip(asked, found.cells)), dict(zip(asked, found.node_loss.tolist()))
        for k, pair in level.items():
            if pair is not None:
                parent, parent_loss, other = pair
                cells[k], loss[k] = parent - cells[other], parent_loss - loss[other]
        following: dict[int, tuple | None] = {}
        for node in sorted(level):
            of = cells[node]
            sums[node] = tuple(int(v) for v in of[:, 0].sum(1))
            g, n, pos = sums[node]
            if not may_gain(loss[node] / scale.loss, g / scale.gradient, hess(n, pos), rule):
                if node in small:
                    small.remove(node)
                continue
            if node in small or depths[node] >= params.max_depth:
                continue
            gain, gl, nl, pl = split_gains(*of, scale.gradient, penalty, rule.alpha, rule.lam, rule.least)
            f, last = divmod(int(gain.argmax()), params.max_bins)
            if not gain[f, last] > LEAST_GAIN:
                continue
            split(node, f, last)
            low = (int(gl[f, last]), int(nl[f, last]), int(pl[f, last]))
            sides = (low, (g - low[0], n - low[1], pos - low[2]))
            nodes[node].left, nodes[node].right = places = [add(side, depths[node] + 1) for side in sides]
            if depths[node] + 1 >= params.max_depth:
                continue
            wanted = [p for p, (_, n, pos) in zip(places, sides) if hess(n, pos) >= 2.0 * params.min_child_weight and n > 1]
            small += [p for p in wanted if sums[p][1] <= NODE_ROWS]
            if any(sums[p][1] > NODE_ROWS for p in wanted):
                fewer, more = sorted(places, key=lambda p: sums[p][1])
                following[fewer] = None
                if more in wanted:
                    following[more] = (of, loss[node], fewer)
        level = following
    if small:
        for k, rows in look(small, True).grown.items():
            node = small[k]
            place = [node if i == 0 else add((0, 0, 0), 0) for i in range(len(rows))]
            for r, p in zip(rows, place):
                sums[p] = (r["g"], r["n"], r["pos"])
                if r["feature"] >= 0:
                    split(p, r["feature"], r["bin"])
                    nodes[p].left, nodes[p].right = place[r["left"]], place[r["right"]]
    leaves: list[tuple[float, float]] = []

    def visit(node: int) -> None:
        if nodes[node].feature is None:
            g, n, pos = sums[node]
            leaves.append((g / scale.gradient, hess(n, pos)))
        else:
            visit(nodes[node].left)
            visit(nodes[node].right)

    visit(0)
    return regularise(nodes, dict(enumerate(leaves)), params), before, passes


def _losses(found: dict | None, scale: Scale) -> dict:
    """Mean losses of both sides from a pass's sums."""
    sides = {side: found[side] if found else (0, 0) for side in ("train", "validation")}
    return {side: total / scale.loss / count if count else None for side, (total, count) in sides.items()}


@dataclass
class RunFolder:
    """Checkpoints of a training run in a shared folder: written state, nodes and manifest of the last one."""

    spark: SparkSession
    path: str
    settings: dict

    def save(self, state: DataFrame | None, model: BoostedTrees, progress: dict) -> DataFrame | None:
        """Write a checkpoint, then delete the ones before; a checkpoint counts once its manifest is there.

        Without ``state`` the model has no tree that the last one lacks, and only the manifest is new.
        """
        name = f"{self.path}/trees-{model.n_trees:06d}"
        if state is not None:
            state.write.mode("overwrite").parquet(f"{name}/state")
            model.nodes(self.spark).coalesce(1).write.mode("overwrite").parquet(f"{name}/nodes")
        manifest = {"settings": self.settings, "progress": progress, "features": model.features, "base_score": model.base_score, "history": model.history}
        line = self.spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1)
        line.write.mode("overwrite").text(f"{name}/manifest-{len(model.history):06d}")
        for old in list_folders(self.spark, self.path):
            if old < name.rsplit("/", 1)[1]:
                delete_path(self.spark, f"{self.path}/{old}")
        return None if state is None else self.spark.read.schema(state.schema).parquet(f"{name}/state")

    def latest(self) -> tuple[DataFrame, BoostedTrees, dict] | None:
        """State, model and progress of the last whole checkpoint, if any."""
        for name in sorted(list_folders(self.spark, self.path), reverse=True):
            at = f"{self.path}/{name}"
            written = [f for f in list_folders(self.spark, at) if f.startswith("manifest")]
            # A manifest whose write was cut short has no line.
            lines = (line[0] for f in sorted(written, reverse=True) for line in self.spark.read.schema("value string").text(f"{at}/{f}").collect())
            line = next(lines, None)
            if line is None:
                continue
            manifest = json.loads(line)
            if manifest["settings"] != self.settings:
                raise ValueError(f"{self.path} holds a run of other settings")
            model = BoostedTrees(manifest["features"], manifest["base_score"], read_trees(self.spark, f"{at}/nodes"), -1, manifest["history"])
            return self.spark.read.parquet(f"{at}/state"), model, manifest["progress"]
        return None


def _settings(params: BoostParams, label: str, features: list[str], **more) -> dict:
    """What a run folder must have been written with; the number of rounds may change."""
    kept = {k: v for k, v in asdict(params).items() if k not in ("n_rounds", "checkpoint_every")}
    return json.loads(json.dumps({**kept, "label": label, "features": features, **more}))


def boost_state(
    blocks: DataFrame,
    model: BoostedTrees,
    cuts: list[np.ndarray],
    params: BoostParams,
    n_rounds: int,
    early_stopping: bool,
    write,
    progress: dict | None = None,
) -> tuple[BoostedTrees, DataFrame]:
    """Add trees to ``model`` up to ``n_rounds`` more on written blocks that hold its predictions.

    ``write(blocks, model, progress)`` writes a state and returns it read back;
    without blocks only the progress is new. Returns the model and the last written state.
    """
    penalty = params.underestimation_penalty
    end = model.n_trees + n_rounds
    spark = blocks.sparkSession
    reducers = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    n, n_train, top = measure(blocks)
    blocks, tasks = even_partitions(blocks, n, spark.sparkContext.defaultParallelism)
    # Trees of the resumed run whose losses no pass has measured yet.
    pending = bool(progress) and model.n_trees > len(model.history)
    progress = dict(progress or {"top": top, "best": None, "best_round": None, "stopped": False})
    # Trees that the predictions of ``blocks`` lack, and how many the last written state lacks.
    fresh: list[BinTree] = []
    unwritten = passes = 0
    # What Spark keeps: the last blocks, and those before until the last are there.
    kept = [blocks.persist()]

    def close(rnd: int, losses: dict) -> bool:
        """Record the losses after round ``rnd``; whether to stop there."""
        model.history.append({"round": rnd, **losses})
        log.info("round %d train=%s validation=%s", rnd, losses["train"], losses["validation"])
        if losses["validation"] is None:
            return False
        if progress["best"] is None or losses["validation"] < progress["best"] - 1e-12:
            progress["best"], progress["best_round"] = losses["validation"], rnd
        return early_stopping and rnd - progress["best_round"] >= params.early_stopping_rounds

    def turn(new: DataFrame) -> None:
        nonlocal blocks, fresh
        kept.append(new.persist())
        blocks, fresh = kept[-1], []

    def release() -> None:
        while len(kept) > 1:
            kept.pop(0).unpersist()

    def settle() -> None:
        """Write the state with the trees since the last one."""
        nonlocal unwritten
        if not unwritten:
            write(None, model, progress)
            return
        turn(even_partitions(write(advance(blocks, fresh), model, progress), n, spark.sparkContext.defaultParallelism)[0])
        release()
        unwritten = 0

    try:
        # Passes fix their number of reducers; planning them again at run time only costs.
        with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
            while model.n_trees < end and not progress["stopped"]:
                rnd = model.n_trees
                scale = Scale.of(n, progress["top"], penalty)
                if fresh and n_train > NODE_ROWS and (passes > 2 or len(fresh) >= FRESH_TREES):
                    # A row meets a tree once, and the round's many passes read what is kept. One or two passes add some trees themselves.
                    turn(advance(blocks, fresh))
                pruned, before, passes = _grow(blocks, tasks, fresh, model.features, cuts, params, rnd, scale, n_train, reducers)
                release()
                # This round's first pass also tells how the round before ended.
                if pending and close(rnd - 1, _losses(before, scale)):
                    progress["stopped"], pending = True, False
                    break
                model.trees.append(pruned)
                fresh.append(bin_tree(pruned, model.features, cuts))
                unwritten += 1
                progress["top"] = (before["top"] if before else 0.0) + max(abs(x.value) for x in pruned)
                pending = True
                if unwritten >= max(1, params.checkpoint_every):
                    settle()
            if pending:
                scale = Scale.of(n, progress["top"], penalty)
                task = Pass(fresh, None, np.empty(0, int), 0, [], [], [], [], 1.0, 0, penalty, scale, True, params.max_bins, 0)
                found = run_pass(blocks, task, Rule(0.0, 0.0, 0.0, 0.0, 0.0))
                progress["stopped"] = close(model.n_trees - 1, _losses(found.losses, scale))
            if unwritten or pending:
                settle()
    finally:
        for frame in kept:
            frame.unpersist()
    if early_stopping and progress["best_round"] is not None:
        model.trees = model.trees[: progress["best_round"] + 1]
    model.best_iteration = model.n_trees - 1
    return model, blocks


def train_boosted(
    df: DataFrame,
    features: Sequence[str],
    label: str = TARGET,
    valid_col: str | None = "is_validation",
    params: BoostParams = BOOST,
    n_rounds: int | None = None,
    init_model: BoostedTrees | None = None,
    base_score: float | None = None,
    early_stopping: bool = True,
    folder: str | None = None,
) -> BoostedTrees:
    """Boost ``n_rounds`` trees (default ``params.n_rounds``) on the rows with
    ``valid_col`` false, tracking the asymmetric weighted MSE on both sides and
    stopping after ``early_stopping_rounds`` rounds without validation gain;
    without validation rows all trees stay. With ``init_model`` boosting
    continues from its predictions, whatever learning rate it was trained with.

    With ``folder`` (shared storage, one run's own) the run checkpoints there and
    resumes from the last checkpoint: ``n_rounds`` then counts the run's trees in
    all, and ``df`` is not read again. Other settings must be the same.
    """
    features = list(features)
    n_rounds = params.n_rounds if n_rounds is None else n_rounds
    spark = df.sparkSession
    run = RunFolder(spark, folder.rstrip("/"), _settings(params, label, features, early_stopping=early_stopping)) if folder else None
    found = run.latest() if run else None
    with settings(spark, SMALL_BATCHES), StateTables(spark, "boost_state") as tables:
        if found:
            blocks, model, progress = found
            cuts = [np.array(c) for c in progress["cuts"]]
            n_rounds = max(0, n_rounds - (model.n_trees - progress["start"]))
        else:
            rows = tables.write(_prepared(df, features, label, valid_col))
            cuts, progress = quantile_cuts(rows.where(~F.col(_VAL)), features, params.max_bins), None
            if init_model is not None:
                model = BoostedTrees(features, init_model.base_score, list(init_model.trees), -1, list(init_model.history))
                rows = init_model.predict(few_partitions(rows), _P)
            else:
                base = expectile(rows.where(~F.col(_VAL)), _Y, params.underestimation_penalty) if base_score is None else float(base_score)
                model = BoostedTrees(features, base)
                rows = few_partitions(rows).withColumn(_P, F.lit(model.base_score))
            blocks = tables.write(to_blocks(rows, features, cuts))
        start = progress["start"] if found else model.n_trees

        def write(state: DataFrame, model: BoostedTrees, progress: dict) -> DataFrame:
            if run is None:
                return None if state is None else tables.write(state)
            return run.save(state, model, {**progress, "start": start, "cuts": [c.tolist() for c in cuts]})

        return boost_state(blocks, model, cuts, params, n_rounds, early_stopping, write, progress)[0]


def warm_start_batches(df: DataFrame, features: Sequence[str], label: str, n_batches: int, key: str | None = None) -> DataFrame:
    """``df`` with ``_batch``: a hash of the row key (or else of all values) modulo the number of batches."""
    if key:
        digest = F.md5(F.concat(F.lit("batch:"), F.col(key).cast("string")))
        row_hash = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    else:
        row_hash = F.xxhash64(*[F.col(c) for c in list(features) + [label]])
    return df.withColumn("_batch", F.pmod(row_hash, F.lit(n_batches)).cast("int"))


def train_warm_start(
    df: DataFrame,
    features: Sequence[str],
    label: str = TARGET,
    valid_col: str | None = "is_validation",
    params: BoostParams = BOOST,
    n_batches: int = 10,
    init_model: BoostedTrees | None = None,
    key: str | None = None,
    folder: str | None = None,
) -> BoostedTrees:
    """Incremental training: ``n_batches`` hash batches of the training rows, each
    adding ``rounds_per_batch`` trees to the model so far (no early stopping).

    The batches are a table partitioned by batch, so each reads its own folder.
    Validation rows keep a running prediction that only new trees are added to;
    a batch's rows meet each earlier tree once, when their turn comes. With
    ``folder``, the batches and a checkpoint after each one stay there and a
    repeated call goes on with the next batch.
    """
    features = list(features)
    spark = df.sparkSession
    run = RunFolder(spark, f"{folder.rstrip('/')}/run", _settings(params, label, features, batches=n_batches)) if folder else None
    found = run.latest() if run else None
    with settings(spark, SMALL_BATCHES), StateTables(spark, "warm_start") as tables, StateTables(spark, "warm_start_validation") as kept, StateTables(spark, "boost_state") as steps:
        if found:
            validation, model, progress = found
            cuts, start, done = [np.array(c) for c in progress["cuts"]], progress["start"], progress["batches"]
            tagged = spark.read.parquet(f"{folder.rstrip('/')}/batches")
        else:
            dealt = warm_start_batches(df, features, label, n_batches, key)
            rows = _prepared(dealt, features, label, valid_col, keep=("_batch",))
            # Validation rows are a folder of their own, -1.
            rows = rows.withColumn("_batch", F.when(F.col(_VAL), -1).otherwise(F.col("_batch")))
            if run:
                rows.write.mode("overwrite").partitionBy("_batch").parquet(f"{folder.rstrip('/')}/batches")
                tagged = spark.read.schema(rows.schema).parquet(f"{folder.rstrip('/')}/batches")
            else:
                tagged = tables.write(rows, partition_by="_batch")
            training = tagged.where("_batch >= 0")
            cuts = quantile_cuts(training, features, params.max_bins)
            if init_model is None:
                model = BoostedTrees(features, expectile(training, _Y, params.underestimation_penalty))
            else:
                model = BoostedTrees(features, init_model.base_score, list(init_model.trees), -1, list(init_model.history))
            start, done = model.n_trees, 0
            validation = model.predict(few_partitions(tagged.where("_batch = -1").drop("_batch")), _P)
            validation = kept.write(to_blocks(validation, features, cuts))
        for b in range(done, n_batches):
            scored = model.predict(few_partitions(tagged.where(F.col("_batch") == b).drop("_batch")), _P)
            state = steps.write(to_blocks(scored, features, cuts).unionByName(validation))
            model, state = boost_state(state, model, cuts, params, params.rounds_per_batch, False, lambda new, *_: None if new is None else steps.write(new))
            # Blocks hold rows of one side only.
            validation = advance(state, [], only_validation=True)
            if run:
                validation = run.save(validation, model, {"cuts": [c.tolist() for c in cuts], "start": start, "batches": b + 1})
            else:
                validation = kept.write(validation)
    return model
