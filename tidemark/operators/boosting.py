"""MLlib's boosted trees, grown from binned rows and continued where a fit ended.

``BoostedTrees`` is ``GBTClassifier`` with a leaner loop.  It draws the same
rows and inputs, has the same thresholds and the same rule for a split, so its
trees are MLlib's but for the last digits of sums, which decide between splits of
exactly equal gain.  Rows lie in blocks, a byte for an input or for six flags; few
tasks sum one table for each level of a tree, and a fit asked for more rounds goes
on from the trees it has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, partial
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from tidemark.session import shared_folder

# Bytes of inputs in a block at most, and in a task that sums a table: its start costs as much as some megabytes.
BLOCK_CELLS, TASK_CELLS = 1 << 20, 1 << 22
# Rows from which flags share a byte; below, sums are in MLlib's order.
MANY_ROWS = 100_000
# Rounds whose trees every pass adds up again, before the rows' margins are stored; a bit each in a row's byte of draws.
KEPT_ROUNDS = 8
# Inputs and levels up to which rows are binned here; MLlib's own loop has no such bound.
MAX_INPUTS, MAX_DEPTH, MAX_BINS = 1000, 8, 256
# Tables of so many tasks are added up by the driver alone.
FEW_TASKS = 16
EPSILON = 2.0**-52
MASK = (1 << 64) - 1


# --- random numbers as Spark's tasks draw them -----------------------------------


def _rotated(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF


def _murmur(data: bytes, seed: int) -> int:
    h = seed
    for i in range(0, len(data), 4):
        k = _rotated(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (_rotated(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


def first_state(seed: int) -> int:
    """State of Spark's ``XORShiftRandom`` of a seed."""
    data = (seed & MASK).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def next_state(state):
    state = state ^ (state << np.uint64(21))
    state = state ^ (state >> np.uint64(35))
    return state ^ (state << np.uint64(4))


@lru_cache(maxsize=None)
def _jump(k: int) -> np.ndarray:
    """Table of ``2 ** k`` steps at once: the step is linear, so the images of a state's eight bytes are combined."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    images = next_state(bits) if k == 0 else jumped(jumped(bits, k - 1), k - 1)
    table = np.zeros((8, 256), dtype=np.uint64)
    for byte in range(8):
        for bit in range(8):
            table[byte, 1 << bit : 2 << bit] = table[byte, : 1 << bit] ^ images[8 * byte + bit]
    return table


def jumped(state: np.ndarray, k: int) -> np.ndarray:
    table, out = _jump(k), np.zeros_like(state)
    for byte in range(8):
        out ^= table[byte][(state >> np.uint64(8 * byte)) & np.uint64(255)]
    return out


def uniform(seed: int, start: int, n: int) -> np.ndarray:
    """Numbers ``start`` to ``start + n`` of ``XORShiftRandom(seed).nextDouble()``, drawn in lanes of 64."""
    lanes = np.array([first_state(seed)], dtype=np.uint64)
    for k in range((2 * start).bit_length()):
        if 2 * start >> k & 1:
            lanes = jumped(lanes, k)
    k = 7
    while len(lanes) * 64 < n:
        lanes = np.concatenate([lanes, jumped(lanes, k)])
        k += 1
    lanes = lanes[: -(-n // 64)]
    out = np.empty((len(lanes), 64))
    for i in range(64):
        lanes = next_state(lanes)
        high = lanes & np.uint64((1 << 26) - 1)
        lanes = next_state(lanes)
        out[:, i] = ((high << np.uint64(27)) + (lanes & np.uint64((1 << 27) - 1))).astype(np.float64)
    return out.ravel()[:n] * 2.0**-53


class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _int(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        value = self.state >> 16
        return value - (1 << 32) if value >> 31 else value

    def long(self) -> int:
        value = ((self._int() << 32) + self._int()) & MASK
        return value - (1 << 64) if value >> 63 else value


def drawn_inputs(n: int, k: int, seed: int) -> list[int]:
    """``k`` of ``n`` inputs by reservoir sampling, in Spark's order."""
    kept = list(range(k))
    for i, u in enumerate(uniform(seed, 0, n - k), k):
        at = int(u * (i + 1))
        if at < k:
            kept[at] = i
    return kept


def inputs_per_node(strategy: str, n: int) -> int:
    """How many of ``n`` inputs a node is offered."""
    named = {"auto": n, "all": n, "sqrt": ceil(sqrt(n)), "log2": max(1, ceil(log2(n))), "onethird": ceil(n / 3.0)}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), n) if strategy.isdigit() else ceil(float(strategy) * n)


# --- thresholds ------------------------------------------------------------------


def thresholds(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most ``most`` thresholds of one input, from a sample whose weight should be ``expected``."""
    there = values != 0.0
    distinct, place = np.unique(values[there], return_inverse=True)
    if not len(distinct):
        return np.empty(0)
    mass = np.bincount(place, weights[there])
    if expected - mass.sum() > EPSILON * there.sum() * 100:
        at = np.searchsorted(distinct, 0.0)
        distinct, mass = np.insert(distinct, at, 0.0), np.insert(mass, at, expected - mass.sum())
    between = (distinct[:-1] + distinct[1:]) / 2.0
    if len(between) <= most:
        return between
    stride = target = expected / (most + 1)
    found, seen = [], np.cumsum(mass).tolist()
    for i, (before, after) in enumerate(zip(seen, seen[1:])):
        if abs(before - target) < abs(after - target):
            found.append(between[i])
            target += stride
    return np.array(found)


# --- trees -----------------------------------------------------------------------


@dataclass
class Node:
    """Weight, sum, sum of squares and number of a node's rows; ``split`` is (input, last bin to the left)."""

    stats: np.ndarray
    impurity: float
    valid: bool = True
    gain: float = -1.0
    split: tuple[int, int] | None = None

    @property
    def prediction(self) -> float:
        return self.stats[1] / self.stats[0] if self.stats[0] else 0.0


@dataclass
class Tree:
    """Nodes by number: the children of ``i`` are ``2 i`` and ``2 i + 1``, the root is 1."""

    depth: int
    nodes: dict[int, Node] = field(default_factory=dict)

    def levels(self, lies: Sequence[tuple[int, int]]) -> list[list[tuple[int, int, int, int]]]:
        """(place in the level, column, bits, largest value to the left) of the splits of each level."""
        out = [[] for _ in range(self.depth)]
        for i, node in sorted(self.nodes.items()):
            if node.split:
                level, (j, last) = i.bit_length() - 1, node.split
                out[level].append((i - (1 << level), *lies[j], last))
        return out

    def values(self) -> np.ndarray:
        """Prediction at each place of the last level."""
        out = np.zeros(1 << self.depth)
        for i, node in self.nodes.items():
            if not node.split:
                below = self.depth - i.bit_length() + 1
                out[(i << below) - (1 << self.depth) :][: 1 << below] = node.prediction
        return out


def impurity(stats: np.ndarray) -> np.ndarray:
    """Variance of the labels behind ``stats`` (last axis)."""
    weight, total, squares = stats[..., 0], stats[..., 1], stats[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight == 0, 0.0, (squares - total * total / weight) / weight)


def best_split(node: Node | None, table: np.ndarray, offered: Sequence[int], least: int, least_gain: float) -> tuple[Node, Node, Node]:
    """The node with its best split, and what falls left and right of it.

    ``table`` holds stats by input and bin; of equal gains the first offered
    input and its lowest threshold are taken.  Without a split that leaves
    ``least`` rows on either side the node has none.
    """
    offered = [j for j in offered if table[j, 1:, 3].any() or table[j, 0, 3]]
    left = np.cumsum(table[offered], axis=1)
    right = left[:, -1:] - left
    left, right = left[:, :-1], right[:, :-1]
    if node is None:
        stats = left[0, 0] + right[0, 0]
        node = Node(stats, float(impurity(stats)))
    both = left[..., 0] + right[..., 0]
    low, high = impurity(left), impurity(right)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = node.impurity - left[..., 0] / both * low - right[..., 0] / both * high
    gain[(left[..., 3] < least) | (right[..., 3] < least) | ~(gain >= least_gain)] = -np.inf
    at = np.unravel_index(np.argmax(gain), gain.shape)
    valid = bool(np.isfinite(gain[at]))
    found = Node(node.stats, node.impurity, valid, float(gain[at]) if valid else -1.0)
    if valid and gain[at] > 0:
        found.split = (int(offered[at[0]]), int(at[1]))
    return found, Node(left[at], float(low[at])), Node(right[at], float(high[at]))


# --- what tasks do with their blocks -------------------------------------------------


def places(bins: np.ndarray, levels: Sequence[Sequence[tuple[int, int, int, int]]]) -> np.ndarray:
    """Each row's place in the level below the given ones."""
    at = np.zeros(bins.shape[1], dtype=np.uint8)
    for level, splits in enumerate(levels):
        right = np.zeros(len(at), dtype=bool)
        for place, column, bits, last in splits:
            goes = (bins[column] if bits == 255 else bins[column] & np.uint8(bits)) > last
            right |= goes & (at == place) if level else goes
        at = (at << 1) | right.view(np.uint8)
    return at


def added(block: dict, trees: Sequence[tuple[list, np.ndarray]]) -> np.ndarray:
    """The rows' margins with those of further ``trees``."""
    margin = block["margin"]
    for levels, values in trees:
        margin = margin + values[places(block["bins"], levels)]
    return margin


def packed(cuts: Sequence[np.ndarray], together: int) -> list[tuple[int, int]]:
    """Column and bits of each input: a column for bins, and one for ``together`` inputs of two bins at most."""
    lies, columns, flags, shared = [], 0, 0, 0
    for cut in cuts:
        if len(cut) > 1 or together == 1:
            lies.append((columns, 255))
            columns += 1
            continue
        if flags % together == 0:
            shared, columns = columns, columns + 1
        lies.append((shared, 1 << flags % together))
        flags += 1
    return lies


def binned(batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray], lies: Sequence[tuple[int, int]], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``size`` rows at most, in order: a row's bytes, labels, weights."""
    part, start, waiting, rows = 0, 0, [], 0

    def block() -> pa.RecordBatch:
        bins, y, w = (np.concatenate([piece[i] for piece in waiting], axis=-1) for i in range(3))
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (bins, y, w)]
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([start]), pa.array([len(y)]), *parts], names=["part", "start", "n", "bins", "y", "w"])

    for batch in batches:
        part = batch.column(3)[0].as_py() if batch.num_rows else part
        for at in range(0, batch.num_rows, size):
            piece = batch.slice(at, size)
            x = piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, len(cuts))
            bins = np.zeros((1 + max(column for column, _ in lies), piece.num_rows), dtype=np.uint8)
            for j, (cut, (column, bits)) in enumerate(zip(cuts, lies)):
                found = np.searchsorted(cut, x[:, j]).astype(np.uint8)
                bins[column] |= found if bits == 255 else found * np.uint8(bits)
            if rows and rows + piece.num_rows > size:
                yield block()
                waiting, start, rows = [], start + rows, 0
            waiting.append((bins, piece.column(0).to_numpy(zero_copy_only=False), piece.column(1).to_numpy(zero_copy_only=False)))
            rows += piece.num_rows
    if rows:
        yield block()


def unpacked(row) -> dict:
    """A block with margins of zero."""
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, row["n"])
    y, w = (np.frombuffer(row[c], dtype=np.float64) for c in "yw")
    return {"part": row["part"], "start": row["start"], "bins": bins, "y": y, "w": w, "margin": np.zeros(row["n"])}


def with_margins(block: dict, trees: Sequence, seed: int, rate: float) -> dict:
    """The block with the margins of ``trees``, and the rows drawn in the rounds that follow."""
    n, drawn = len(block["y"]), np.uint8(255)
    if rate < 1.0:
        draws = [uniform(seed + k + block["part"] + 1, block["start"], n) < rate for k in range(KEPT_ROUNDS)]
        drawn = np.packbits(draws, axis=0, bitorder="little")[0]
    return block | {"margin": added(block, trees), "drawn": drawn}


def level_table(
    blocks: Iterator[dict], trees: Sequence, levels: Sequence, slots: np.ndarray, nodes: int, columns: Sequence[int], bins: int,
    first: bool, kept: int, precise: bool,
) -> Iterator[tuple[int, np.ndarray]]:
    """Stats of a task's rows by column, node and byte."""
    out, part = None, 0
    for block in blocks:
        y, x = block["y"], block["bins"]
        if not first:
            power = 2.0 * y * added(block, trees)
            y = 4.0 * y / (1.0 + (np.exp(power.astype(np.longdouble)).astype(np.float64) if precise else np.exp(power)))
        count = (block["drawn"] >> np.uint8(kept) & np.uint8(1)) * np.ones(len(y))
        weight = block["w"] * count
        sums = (weight, weight * y, weight * y * y, count)
        base = slots[places(x, levels)] * bins
        table = np.empty((len(columns), nodes + 1, bins, 4))
        for i, column in enumerate(columns):
            at = base + x[column]
            for k, values in enumerate(sums):
                table[i, :, :, k] = np.bincount(at, values, (nodes + 1) * bins).reshape(nodes + 1, bins)
        if out is None:
            out, part = table[:, :nodes], block["part"]
        else:
            out += table[:, :nodes]
    if out is not None:
        yield part, out


def ordered_sum(tables: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sums in the order of the tasks, whichever ended first."""
    first, *others = (table for _, table in sorted(tables, key=lambda t: t[0]))
    for table in others:
        first = first + table
    return first


# --- the fit ---------------------------------------------------------------------


class BoostedTrees(GBTClassifier):
    """``GBTClassifier`` that goes on from its trees when it is fitted to the same rows with more rounds."""

    def _fit(self, dataset: DataFrame):
        if not self.lean():
            return super()._fit(dataset)
        if self.__dict__.get("_grown") is None or self._grown.dataset is not dataset:
            self.release()
            self._grown = Growing.start(self, dataset)
        if self._grown is None:
            return super()._fit(dataset)
        self._grown.grow(self.getMaxIter())
        return self._saved(dataset)

    def lean(self) -> bool:
        """Whether the settings are those that the loop here knows."""
        return (
            self.getMaxDepth() <= MAX_DEPTH
            and self.getMaxBins() <= MAX_BINS
            and self.getMinWeightFractionPerNode() == 0.0
            and self.isDefined(self.weightCol)
            and not self.isDefined(self.validationIndicatorCol)
        )

    def release(self) -> None:
        """Forget the trees and the stored blocks."""
        grown = self.__dict__.pop("_grown", None)
        if grown is not None:
            grown.release()

    def _saved(self, dataset: DataFrame) -> GBTClassificationModel:
        """The trees as a model: those of a fit to two rows are taken out of its files, and these put in."""
        spark, grown, size = dataset.sparkSession, self._grown, self.getMaxIter()
        label, weight, features = self.getLabelCol(), self.getWeightCol(), self.getFeaturesCol()
        rows = [(float(y), 1.0, Vectors.sparse(grown.inputs, [0], [float(y)])) for y in (0, 1)]
        tiny = self.copy({self.maxIter: 1, self.subsamplingRate: 1.0, self.featureSubsetStrategy: "all"})
        place = f"{shared_folder(spark)}/boosted-{uuid.uuid4().hex}"
        GBTClassifier._fit(tiny, spark.createDataFrame(rows, [label, weight, features])).write().save(f"{place}-tiny")
        (line,) = spark.read.text(f"{place}-tiny/metadata").collect()
        record = json.loads(line["value"])
        record["numTrees"] = size
        own = {"maxIter": size, "subsamplingRate": self.getSubsamplingRate(), "featureSubsetStrategy": self.getFeatureSubsetStrategy()}
        record["paramMap"] = {**record.get("paramMap", {}), **own}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{place}/metadata")
        data = spark.read.parquet(f"{place}-tiny/data")
        nodes = [(t, row) for t, tree in enumerate(grown.trees[:size]) for row in grown.node_rows(tree)]
        spark.createDataFrame(nodes, data.schema).coalesce(1).write.parquet(f"{place}/data")
        about = spark.read.parquet(f"{place}-tiny/treesMetadata")
        (one,) = about.collect()
        trees = [(t, one[1], grown.weight(t)) for t in range(size)]
        spark.createDataFrame(trees, about.schema).coalesce(1).write.parquet(f"{place}/treesMetadata")
        return GBTClassificationModel.load(place)


@dataclass
class Growing:
    """Rows in blocks, thresholds, and the trees so far."""

    dataset: DataFrame
    estimator: BoostedTrees
    cuts: list[np.ndarray]
    lies: list[tuple[int, int]]
    base: RDD
    tasks: int
    precise: bool
    rows: RDD | None = None
    stored: int = 0
    trees: list[Tree] = field(default_factory=list)
    applied: list[tuple[list, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def start(estimator: BoostedTrees, dataset: DataFrame) -> Growing | None:
        """Thresholds from the rows that MLlib samples, then all rows in blocks; nothing for very wide rows."""
        spark = dataset.sparkSession
        label, weight = F.col(estimator.getLabelCol()).cast("double"), F.col(estimator.getWeightCol()).cast("double")
        rows = dataset.select((label * 2 - 1).alias("y"), weight.alias("w"), vector_to_array(estimator.getFeaturesCol()).alias("x"), F.spark_partition_id().alias("part"))
        first = dataset.select(estimator.getFeaturesCol()).head()
        if first is None or not 0 < first[0].size <= MAX_INPUTS:
            return None
        inputs = first[0].size
        n, total = rows.agg(F.count(F.lit(1)), F.sum("w")).first()
        bins = min(estimator.getMaxBins(), n)
        asked = max(bins * bins, 10000)
        share = asked / n if asked < n else 1.0
        sampled = rows
        if share < 1:
            draw = int(next_state(np.array([first_state(estimator.getSeed())], dtype=np.uint64))[0]) & 0xFFFFFFFF
            draw = draw - (1 << 32) if draw >> 31 else draw
            picked = rows._jdf.toJavaRDD().sample(False, share, draw)
            sampled = DataFrame(spark._jsparkSession.createDataFrame(picked, rows._jdf.schema()), spark)
        table = sampled.select("w", "x").toArrow()
        w = table.column("w").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(w), inputs)
        cuts = [thresholds(x[:, j], w, share * total, bins - 1) for j in range(inputs)]
        precise = n < MANY_ROWS
        lies = packed(cuts, 1 if precise else min(6, bins.bit_length() - 1))
        columns = 1 + max(column for column, _ in lies)
        made = partial(binned, cuts=cuts, lies=lies, size=max(1, BLOCK_CELLS // columns))
        blocks = rows.mapInArrow(made, "part long, start long, n long, bins binary, y binary, w binary").rdd.map(unpacked)
        tasks = min(blocks.getNumPartitions(), ceil(n * columns / TASK_CELLS))
        return Growing(dataset, estimator, cuts, lies, blocks.persist(StorageLevel.DISK_ONLY), tasks, precise)

    @property
    def inputs(self) -> int:
        return len(self.cuts)

    def weight(self, t: int) -> float:
        return self.estimator.getStepSize() if t else 1.0

    def release(self) -> None:
        for rows in (self.rows, self.base):
            if rows is not None:
                rows.unpersist()

    def grow(self, rounds: int) -> None:
        """Trees up to ``rounds`` in all."""
        while len(self.trees) < rounds:
            if self.rows is None or len(self.trees) - self.stored >= KEPT_ROUNDS:
                self.keep_margins()
            tree = self.grown_tree()
            self.trees.append(tree)
            self.applied.append((tree.levels(self.lies), tree.values() * self.weight(len(self.trees) - 1)))

    def keep_margins(self) -> None:
        """Rows stored with the margins of all trees so far, always from the first blocks, so that no lineage grows."""
        before, self.stored = self.rows, len(self.trees)
        e = self.estimator
        told = partial(with_margins, trees=list(self.applied), seed=e.getSeed() + self.stored, rate=e.getSubsamplingRate())
        self.rows = self.base.coalesce(self.tasks).map(told).persist(StorageLevel.MEMORY_AND_DISK)
        if before is not None:
            before.unpersist()

    def table(self, task) -> np.ndarray:
        """What all tasks count, added up; many tasks in groups first."""
        found = self.rows.mapPartitions(task)
        if (n := found.getNumPartitions()) > FEW_TASKS:
            groups = ceil(sqrt(n))
            grouped = found.keyBy(lambda t: t[0] % groups).groupByKey(groups)
            found = grouped.map(lambda g: (g[0], ordered_sum(list(g[1]))))
        return ordered_sum(found.collect())

    def grown_tree(self) -> Tree:
        e, t = self.estimator, len(self.trees)
        seed, sizes = e.getSeed() + t, [len(c) + 1 for c in self.cuts]
        offer = inputs_per_node(e.getFeatureSubsetStrategy(), self.inputs)
        draws, tree, waiting = JavaRandom(seed), Tree(e.getMaxDepth()), [1]
        bins = max(2, *sizes, *(2 * bits for _, bits in self.lies if bits != 255))
        codes = np.arange(bins)
        while waiting:
            group, waiting = waiting[::-1], []
            offered = [drawn_inputs(self.inputs, offer, draws.long()) if offer < self.inputs else list(range(self.inputs)) for _ in group]
            columns = sorted({self.lies[j][0] for j in set().union(*offered)})
            level = group[0].bit_length() - 1
            slots = np.full(1 << level, len(group), dtype=np.int64)
            slots[[i - (1 << level) for i in group]] = range(len(group))
            task = partial(
                level_table, trees=self.applied[self.stored :], levels=tree.levels(self.lies)[:level], slots=slots, nodes=len(group),
                columns=columns, bins=bins, first=t == 0, kept=t - self.stored, precise=self.precise,
            )
            found = self.table(task)
            for k, i in enumerate(group):
                table = np.zeros((self.inputs, bins, 4))
                for j in offered[k]:
                    column, bits = self.lies[j]
                    own = found[columns.index(column), k]
                    if bits == 255:
                        table[j] = own
                    else:
                        table[j, :2] = own[codes & bits == 0].sum(axis=0), own[codes & bits > 0].sum(axis=0)
                usable = [j for j in offered[k] if sizes[j] > 1] or offered[k][:1]
                node, low, high = best_split(tree.nodes.get(i), table, usable, e.getMinInstancesPerNode(), e.getMinInfoGain())
                if level == tree.depth:
                    node.split = None
                tree.nodes[i] = node
                if node.split:
                    tree.nodes[2 * i], tree.nodes[2 * i + 1] = low, high
                    last = level + 1 == tree.depth
                    waiting += [2 * i + right for right, child in enumerate((low, high)) if not last and abs(child.impurity) >= EPSILON]
        return tree

    def node_rows(self, tree: Tree) -> list[tuple]:
        """Rows of MLlib's table of nodes, numbered from the root, left before right; leaves that say the same are one."""
        rows = []

        def same(i: int) -> float | None:
            """The prediction of a node whose leaves all say the same, pair by pair."""
            node = tree.nodes[i]
            if not node.split:
                return node.prediction
            low, high = same(2 * i), same(2 * i + 1)
            return low if low is not None and low == high else None

        def add(i: int) -> int:
            node, at, value = tree.nodes[i], len(rows), same(i)
            stats, count = [float(v) for v in node.stats[:3]], int(node.stats[3])
            rows.append(None)
            if value is not None:
                told = node.impurity if node.split or node.valid else -1.0
                rows[at] = (at, float(value), told, stats, count, -1.0, -1, -1, (-1, [], -1))
            else:
                low, high = add(2 * i), add(2 * i + 1)
                j, last = node.split
                rows[at] = (at, float(node.prediction), node.impurity, stats, count, node.gain, low, high, (j, [float(self.cuts[j][last])], -1))
            return at

        add(1)
        return rows
