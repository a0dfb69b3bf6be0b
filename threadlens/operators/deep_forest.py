"""Random forests of deep trees on many rows.

Features are cut once into bins of about equal counts. The first levels of all trees are grown together, one pass over the
rows per level, until a node holds at most ``subtreeRows`` rows. Its rows then meet in one task, which grows the rest of
that tree, so deep levels cost as much as their rows and no histograms of small nodes are moved. A node's features follow
from the seed, its tree and its place, a row's weight in a tree from the seed and the row, so the forest does not depend on
``subtreeRows``. Subtrees stay a table; rows are scored where their subtree is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_vector
from threadlens.operators.shared_trees import BINS, FAN_IN, LEAST_GAIN, MAX_SUMS, bin_edges
from threadlens.operators.shared_tuning import tree_sum
from threadlens.session import materialize

#: Rows of a node that is finished in one task, and rows that meet all trees at once.
SUBTREE_ROWS, ROWS = 1 << 16, 1024
#: Numbers of histograms that a task holds at once while it grows a subtree.
HELD_SUMS = 1 << 21
#: Rows scored by one subtree in one task, on average.
SCORED_ROWS = 1 << 20
#: Bytes of rows that a task should receive for its subtrees.
TASK_BYTES = 1 << 26
#: Votes are summed as whole numbers of this share, so their order does not matter.
VOTE = 1 << 40
#: Chances of weights up to 0, 1, 2, ... in a sample with replacement.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int, tree: np.ndarray, place: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(np.uint64(seed) + np.asarray(tree).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                  + np.asarray(place).astype(np.uint64))


def bag_weights(ids: np.ndarray, trees: int, seed: int, bootstrap: bool) -> np.ndarray:
    """(row, tree): how often a row is in a tree's sample."""
    if not bootstrap:
        return np.ones((len(ids), trees), np.uint8)
    draws = _keys(seed, np.arange(trees)[None, :], ids[:, None]) >> np.uint64(11)
    return np.searchsorted(POISSON, draws.astype(np.float64) / (1 << 53), side="right").astype(np.uint8)


def chosen(tree: np.ndarray, place: np.ndarray, width: int, size: int, seed: int) -> np.ndarray:
    """(node, size): the features that a node may split on."""
    if size >= width:
        return np.tile(np.arange(width), (len(place), 1))
    order = _mixed(_keys(seed + 1, tree, place)[:, None] + np.arange(1, width + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argpartition(order, size - 1, axis=1)[:, :size], axis=1)


def _sums(codes: np.ndarray, y: np.ndarray, w: np.ndarray, row: np.ndarray, slot: np.ndarray, some: np.ndarray,
          classes: int) -> np.ndarray:
    """Weights per node, feature, bin and class, flat, of the rows at each node."""
    size = some.shape[1]
    cell = ((slot[:, None] * size + np.arange(size)) * BINS + codes[row[:, None], some[slot]]) * classes + y[row][:, None]
    return np.bincount(cell.ravel(), np.repeat(w, size), len(some) * size * BINS * classes)


def best_cuts(sums: np.ndarray, nodes: int, size: int, classes: int, least: int) -> np.ndarray:
    """(node, 2 + classes): gain of Gini impurity, place among feature and bin, and weights of the left side."""
    left = sums.reshape(nodes, size, BINS, classes).cumsum(axis=2)
    whole = left[:, :, -1:, :]
    left = left[:, :, :-1, :]
    n, n_left = whole.sum(-1), left.sum(-1)
    n_right = n - n_left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left * left).sum(-1) / n_left + ((whole - left) ** 2).sum(-1) / n_right - (whole * whole).sum(-1) / n
        gain = np.where((n_left >= least) & (n_right >= least), gain / n, 0.0).reshape(nodes, -1)
    at = gain.argmax(axis=1)
    return np.hstack([gain.max(axis=1)[:, None], at[:, None], left.reshape(nodes, -1, classes)[np.arange(nodes), at]])


def _cut_of(best: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether it splits, feature, cut, weights of the left side) of each node."""
    at = best[:, 1].astype(np.int64)
    return best[:, 0] > LEAST_GAIN, some[np.arange(len(some)), at // (BINS - 1)], at % (BINS - 1), best[:, 2:]


def _open(sums: np.ndarray, depth: int, max_depth: int, least: int) -> np.ndarray:
    """Nodes that may split: of more than one class and enough rows."""
    return ((sums > 0).sum(axis=1) > 1) & (sums.sum(axis=1) >= 2 * least) & (depth < max_depth)


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, place: int, depth: int, classes: int, size: int,
         max_depth: int, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, cut, left child, class shares) of the nodes below one node, level by level. A right child follows
    its left one."""
    row, slot, places = np.arange(len(y)), np.zeros(len(y), np.int64), np.array([place], np.int64)
    sums, total, levels = np.bincount(y, w, classes)[None, :], 0, []
    while len(places):
        m = len(places)
        feature, cut, left_sums = np.full(m, -1, np.int32), np.zeros(m, np.uint8), np.zeros((m, classes))
        tried = np.flatnonzero(_open(sums, depth, max_depth, least))
        rank = np.full(m, -1)
        rank[tried] = np.arange(len(tried))
        keep = rank[slot] >= 0
        row, slot = row[keep], slot[keep]
        block = max(1, HELD_SUMS // (size * BINS * classes))
        for start in range(0, len(tried), block):
            own = tried[start:start + block]
            some = chosen(np.full(len(own), tree), places[own], codes.shape[1], size, seed)
            inside = slice(None) if len(tried) <= block else (rank[slot] >= start) & (rank[slot] < start + block)
            found = best_cuts(_sums(codes, y, w[row[inside]], row[inside], rank[slot[inside]] - start, some, classes),
                              len(own), size, classes, least)
            good, f, c, ls = _cut_of(found, some)
            feature[own[good]], cut[own[good]], left_sums[own[good]] = f[good], c[good], ls[good]
        split = np.flatnonzero(feature >= 0)
        left = np.full(m, -1, np.int32)
        left[split] = total + m + 2 * np.arange(len(split))
        levels.append((feature, cut, left, sums / sums.sum(axis=1, keepdims=True)))
        keep = feature[slot] >= 0
        row, slot = row[keep], slot[keep]
        slot = left[slot] - total - m + (codes[row, feature[slot]] > cut[slot])
        places = (2 * places[split][:, None] + np.arange(2)).ravel()
        sums = np.stack([left_sums[split], sums[split] - left_sums[split]], axis=1).reshape(-1, classes)
        total, depth = total + m, depth + 1
    return tuple(np.concatenate(x) for x in zip(*levels, strict=True))


def walk(codes: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Where rows end that start at ``node``, one column per start."""
    rows = np.arange(len(codes)).reshape(-1, *[1] * (node.ndim - 1))
    while True:
        f = feature[node]
        on = f >= 0
        if not on.any():
            return node
        node = np.where(on, left[node] + (codes[rows, np.maximum(f, 0)] > cut[node]), node)


def coded(arrays: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    """(row, feature): bin numbers; a bin number is at most c when the value is at most edge c."""
    if arrays.null_count:
        raise ValueError("features must not be null")
    x = np.asarray(arrays.flatten()).reshape(len(arrays), -1)
    if not np.isfinite(x).all():
        raise ValueError("features must be finite")
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _bytes(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _by_node(node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, places where it stands) of each different node."""
    order = np.argsort(node, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(node[order]) != 0])) if len(node) else []
    for own in np.split(order, first[1:]) if len(node) else []:
        yield int(node[own[0]]), own


class _ForestParams(Params):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth of a leaf", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a node", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "auto, sqrt or all", TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether trees sample their rows", TypeConverters.toBoolean)
    subtreeRows = Param(Params._dummy(), "subtreeRows", "rows of a node finished in one task", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of samples and features", TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)


class DeepForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Random forest of (features, label) with the parameters of MLlib's."""

    @keyword_only
    def __init__(self, *, numTrees=200, maxDepth=10, minInstancesPerNode=2, featureSubsetStrategy="sqrt", bootstrap=True,
                 subtreeRows=SUBTREE_ROWS, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(numTrees=200, maxDepth=10, minInstancesPerNode=2, featureSubsetStrategy="sqrt", bootstrap=True,
                         subtreeRows=SUBTREE_ROWS, seed=42)

    def _fit(self, dataset: DataFrame) -> DeepForestModel:
        trees, max_depth, least, subset, bootstrap, most, seed = (self.getOrDefault(p) for p in (
            self.numTrees, self.maxDepth, self.minInstancesPerNode, self.featureSubsetStrategy, self.bootstrap,
            self.subtreeRows, self.seed))
        width = len(dataset.first()["features"])
        size = {"auto": math.ceil(math.sqrt(width)), "sqrt": math.ceil(math.sqrt(width)), "all": width}[subset]
        rows = materialize(dataset.select(F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("x"),
                                          F.col("label").cast("int").alias("y"), F.col("label").alias("label")), "forest-input")
        edges = bin_edges(rows.select("x"), width, BINS)
        fits = F.coalesce((F.col("y") >= 0) & (F.col("y") == F.col("label")), F.lit(False))
        n, top, wrong = rows.agg(F.count("*"), F.max("y"), F.count_if(~fits)).first()
        if wrong or top > 255:
            raise ValueError("labels must be whole numbers from 0 to 255")
        classes = max(2, top + 1)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                codes = coded(batch.column(1), edges)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()),
                                                  batch.column(2)], names=["id", "codes", "y"])

        rows = materialize(rows.mapInArrow(code, "id long, codes binary, y int"), "forest-rows")

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(codes, label, weight in each tree) of some rows."""
            for batch in _slices(batches):
                weights = bag_weights(batch.column(0).to_numpy(), trees, seed, bootstrap)
                yield _bytes(batch.column(1), np.uint8).reshape(-1, width), batch.column(2).to_numpy(), weights

        # the head: nodes 0 .. trees - 1 are the roots, children come in pairs
        feature, cut, left = np.full(trees, -1, np.int32), np.zeros(trees, np.uint8), np.full(trees, -1, np.int32)
        tree, place, depth = np.arange(trees), np.ones(trees, np.int64), np.zeros(trees, np.int64)
        shares: dict[int, np.ndarray] = {}
        going = np.arange(trees) if n > most else np.zeros(0, np.int64)
        while len(going):
            found = []
            block = max(1, MAX_SUMS // (size * BINS * classes))
            for start in range(0, len(going), block):
                own = going[start:start + block]
                some = chosen(tree[own], place[own], width, size, seed)
                found.append(self._pass(rows, arrays, (feature, cut, left), own, some, classes, least))
            good, f, c, left_sums = _cut_of(np.vstack([b for b, _ in found]), np.vstack([s for _, s in found]))
            whole = np.vstack([b[:, -classes:] for b, _ in found])
            left_sums, good = left_sums[:, :classes], good & (depth[going] < max_depth)
            for i in np.flatnonzero(~good):
                shares[int(going[i])] = whole[i] / whole[i].sum()
            parents = going[good]
            feature[parents], cut[parents] = f[good], c[good]
            left[parents] = len(feature) + 2 * np.arange(len(parents))
            new = 2 * len(parents)
            feature, cut, left = (np.concatenate([a, np.full(new, v, a.dtype)]) for a, v in ((feature, -1), (cut, 0), (left, -1)))
            tree, depth = np.concatenate([tree, np.repeat(tree[parents], 2)]), np.concatenate([depth, np.repeat(depth[parents] + 1, 2)])
            place = np.concatenate([place, (2 * place[parents][:, None] + np.arange(2)).ravel()])
            sums = np.stack([left_sums[good], whole[good] - left_sums[good]], axis=1).reshape(-1, classes)
            ids = np.arange(len(feature) - new, len(feature))
            large = sums.sum(axis=1) > most
            on = large & _open(sums, 0, 1, least) & (depth[ids] < max_depth)
            for i in np.flatnonzero(large & ~on):
                shares[int(ids[i])] = sums[i] / sums[i].sum()
            going = ids[on]

        done = np.zeros(len(feature), bool)
        done[list(shares)] = True

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, y, weights in arrays(batches):
                at = walk(codes, np.tile(np.arange(trees), (len(codes), 1)), feature, cut, left)
                row, column = np.nonzero((weights > 0) & ~done[at])
                packed = np.hstack([codes, y[:, None].astype(np.uint8)])
                nodes, blocks = [], []
                for node, own in _by_node(at[row, column]):
                    nodes.append(node)
                    blocks.append(np.hstack([packed[row[own]], weights[row[own], column[own]][:, None]]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array(blocks, pa.binary())], names=["node", "block"])

        def grown(key: tuple, table: pa.Table) -> pa.Table:
            node = int(key[0].as_py())
            rows = _bytes(table.column("block"), np.uint8).reshape(-1, width + 2)
            found = grow(rows[:, :width], rows[:, width].astype(np.int64), rows[:, width + 1].astype(float), int(tree[node]),
                         int(place[node]), int(depth[node]), classes, size, max_depth, least, seed)
            return pa.table([pa.array([node], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in found]], names=SUBTREE)

        spark = dataset.sparkSession
        tasks = max(3 * spark.sparkContext.defaultParallelism, -(-n * trees * (width + 2) // TASK_BYTES))
        subtrees = rows.mapInArrow(dealt, "node int, block binary").repartition(tasks, "node").groupBy("node").applyInArrow(
            grown, SUBTREE_SCHEMA)
        if shares:
            leaf = [np.array(v, t).tobytes() for v, t in (([-1], np.int32), ([0], np.uint8), ([-1], np.int32))]
            subtrees = subtrees.unionByName(spark.createDataFrame(
                [(k, *map(bytearray, leaf), bytearray(s.tobytes())) for k, s in shares.items()], SUBTREE_SCHEMA))
        model = DeepForestModel(materialize(subtrees, "forest-subtrees"), edges, (feature, cut, left))
        return model._set(numTrees=trees, numClasses=classes)

    @staticmethod
    def _pass(rows, arrays, head, own, some, classes, least) -> tuple[np.ndarray, np.ndarray]:
        """((node, gain, place, left sums, sums), features tried) of the nodes ``own``, from one pass over the rows."""
        feature, cut, left = head
        slots = np.full(len(feature), -1)
        slots[own] = np.arange(len(own))
        size = some.shape[1]
        width = len(own) * size * BINS * classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for codes, y, weights in arrays(batches):
                at = slots[walk(codes, np.tile(np.arange(weights.shape[1]), (len(codes), 1)), feature, cut, left)]
                row, column = np.nonzero((weights > 0) & (at >= 0))
                total += _sums(codes, y, weights[row, column].astype(float), row, at[row, column], some, classes)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def finish(sums: np.ndarray) -> np.ndarray:
            whole = sums.reshape(len(own), size, -1, classes)[:, 0].sum(axis=1)
            return np.hstack([best_cuts(sums, len(own), size, classes, least), whole]).ravel()

        return tree_sum(rows.mapInArrow(run, "sums binary"), width, FAN_IN, finish).reshape(len(own), -1), some


SUBTREE = ["node", "feature", "cut", "left", "shares"]
SUBTREE_SCHEMA = "node int, feature binary, cut binary, left binary, shares binary"


class DeepForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """The head of all trees, its bins, and a table with one subtree per node where the head ends."""

    def __init__(self, subtrees: DataFrame | None = None, edges: list[np.ndarray] = (), head: tuple = ()):
        super().__init__()
        self.subtrees, self.edges, self.head = subtrees, edges, head

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, classes, edges = self.getOrDefault(self.numTrees), self.getOrDefault(self.numClasses), self.edges
        feature, cut, left = self.head
        width = len(edges)
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "forest-queries")
        n = rows.count()
        parts = max(1, -(-n // SCORED_ROWS))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                ids, codes = batch.column(0).to_numpy(), coded(batch.column(1), edges)
                at = walk(codes, np.tile(np.arange(trees), (len(codes), 1)), feature, cut, left)
                part = int(_mixed(ids[:1].astype(np.uint64))[0] % np.uint64(parts)) if len(ids) else 0
                nodes, own_ids, blocks = [], [], []
                for node, own in _by_node(at.ravel()):
                    nodes.append(node)
                    own_ids.append(ids[own // trees].tobytes())
                    blocks.append(codes[own // trees].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int32()), pa.array([part] * len(nodes), pa.int32()), pa.array(own_ids, pa.binary()),
                     pa.array(blocks, pa.binary())], names=["node", "part", "ids", "block"])

        names = [f"_v{k}" for k in range(classes)]

        def voted(key: tuple, found: pa.Table, subtree: pa.Table) -> pa.Table:
            if not (found.num_rows and subtree.num_rows):
                return pa.table([pa.array([], pa.int64())] * (1 + classes), names=["_row", *names])
            f, c, l, shares = (_bytes(subtree.column(k), t) for k, t in zip(
                SUBTREE[1:], (np.int32, np.uint8, np.int32, np.float64), strict=True))
            codes = _bytes(found.column("block"), np.uint8).reshape(-1, width)
            votes = np.rint(shares.reshape(-1, classes)[walk(codes, np.zeros(len(codes), np.int64), f, c, l)] * VOTE).astype(np.int64)
            return pa.table([pa.array(_bytes(found.column("ids"), np.int64)), *[pa.array(votes[:, k]) for k in range(classes)]],
                            names=["_row", *names])

        # a subtree goes to every part of the rows
        every = self.subtrees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        tasks = max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-n * trees * (width + 8) // TASK_BYTES))
        found = rows.select("_row", vector_to_array("features").alias("x")).mapInArrow(
            dealt, "node int, part int, ids binary, block binary").repartition(tasks, "node", "part")
        votes = found.groupBy("node", "part").cogroup(every.repartition(tasks, "node", "part").groupBy("node", "part")).applyInArrow(
            voted, ", ".join(["_row long", *[f"{k} long" for k in names]])).groupBy("_row").agg(*[F.sum(k).alias(k) for k in names])
        raw = F.array(*[F.col(k) / F.lit(float(VOTE)) for k in names])
        whole = sum((F.col(k) for k in names), F.lit(0))
        scored = votes.select(
            "_row", as_vector(raw).alias("rawPrediction"), as_vector(F.array(*[F.col(k) / whole for k in names])).alias("probability"),
            (F.array_position(F.array(*names), F.greatest(*names)) - 1).cast("double").alias("prediction"))
        return rows.join(scored, "_row").drop("_row")

    def write(self) -> _ForestWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> _ForestReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, model = self.sparkSession, self.model
        DefaultParamsWriter.saveMetadata(model, path, spark)
        model.subtrees.write.parquet(f"{path}/subtrees")
        spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(model.edges)], "feature int, edges array<double>"
                              ).write.parquet(f"{path}/edges")
        spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(zip(*model.head, strict=True))],
                              "node int, feature int, cut int, left int").write.parquet(f"{path}/head")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DeepForestModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark, self.cls.__module__ + "." + self.cls.__name__)
        edges = [np.array(r["edges"]) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        head = spark.read.parquet(f"{path}/head").orderBy("node").collect()
        model = self.cls(spark.read.parquet(f"{path}/subtrees"), edges, tuple(
            np.array([r[k] for r in head], t) for k, t in (("feature", np.int32), ("cut", np.uint8), ("left", np.int32))))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
