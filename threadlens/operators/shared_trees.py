"""Trees of many folds and feature sets, grown together: one pass over the rows per level for all of them.

Features are cut once into bins of about equal counts. A pass adds up, for every open node of every model, how many
training rows fall into each bin and the sum of their targets; the sums meet in a tree of partial sums, whose last task
keeps the best cut of each feature, and the driver, which sees neither rows nor bins, picks the splits. Recursive
elimination walks once down all sizes, and the cuts of nodes whose path has not changed are used again. Boosted trees are fitted on every size and fold side by side.

Nodes on the same path with the same targets are counted once: for folds of one column by fold value, so that a fold's
training rows are all rows less its own, and for models of one fold over the union of their features, as long as the
models have grown the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.shared_tuning import tree_sum
from threadlens.session import materialize
from threadlens.sources.readers import spread

BINS = 32
#: Sums of one pass, 8 bytes each; more open nodes take more passes. A task adds up FAN_IN of them.
MAX_SUMS, FAN_IN = 1 << 20, 16
#: Numbers kept between rounds of the elimination; beyond them histograms are counted again.
MAX_KEPT = 1 << 25
#: Boosting rounds between two writings of the margins.
WRITE_EVERY = 25
#: Features whose quantiles are asked for at once.
QUANTILE_FEATURES = 64
#: Rows that meet all trees at once.
ROWS = 4096
#: Per bin: rows, sum of targets, sum of curvatures.
SUMS = 3
#: Numbers that tell the best cut of a feature: gain, bin, sums on either side.
CUT = 2 + 2 * SUMS
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Side:
    """Training rows are those whose ``column`` is not ``value``, all without a column; only ``features`` may split."""

    features: np.ndarray
    column: str | None = None
    value: int = 0


@dataclass
class Tree:
    """Heap of nodes: the children of i are 2 i + 1 (bin of ``feature`` at most ``cut``) and 2 i + 2."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    sums: np.ndarray = field(init=False)  # rows, targets and curvatures of each node
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.cut = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.sums, self.gain = np.zeros((n, SUMS)), np.zeros(n)

    def path(self, node: int) -> tuple:
        steps = []
        while node:
            parent = (node - 1) // 2
            steps.append((int(self.feature[parent]), int(self.cut[parent]), node - 2 * parent))
            node = parent
        return tuple(reversed(steps))

    def importance(self, width: int) -> np.ndarray:
        """Sum of the gains of each feature's splits."""
        out = np.zeros(width)
        np.add.at(out, self.feature[self.feature >= 0], self.gain[self.feature >= 0])
        return out

    def values(self, rate: float) -> np.ndarray:
        """Newton step of each node."""
        return rate * self.sums[:, 1] / np.maximum(self.sums[:, 2], 1e-12)


def _table(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of equal length as the rows of a table, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return flat.view(kind).reshape(len(column), -1)


def _cells(table: np.ndarray) -> pa.Array:
    """The rows of a table as binary values."""
    flat = np.ascontiguousarray(table).view(np.uint8).reshape(len(table), -1)
    ends = np.arange(len(table) + 1, dtype=np.int64) * flat.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(table), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())


def _arrays(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, dict]:
    """Codes, labels, margins (None before they are written) and folds of a batch."""
    margins = _table(batch.column(2), np.float64) if batch.column(2).null_count == 0 else None
    folds = {c: batch.column(3 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
    return _table(batch.column(0), np.uint8), batch.column(1).to_numpy(), margins, folds


def _ends(features: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Node of one tree at which each row ends; ``features`` has the codes of a feature as a row."""
    node = np.zeros(features.shape[1], np.min_scalar_type(len(feature)))
    for i in np.flatnonzero(feature >= 0):
        child = (features[feature[i]] > cut[i]).astype(node.dtype)
        child += node.dtype.type(i + 1)
        np.multiply(child, node == i, out=child)
        node += child
    return node


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def bin_edges(x: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of all bins but the last, per component of the array column ``x``."""
    shares = [i / bins for i in range(1, bins)]
    edges: list[np.ndarray] = []
    for start in range(0, width, QUANTILE_FEATURES):
        some = range(start, min(width, start + QUANTILE_FEATURES))
        row = x.agg(*[F.percentile_approx(F.col("x")[i], shares, 10000).alias(f"q{i}") for i in some]).first()
        edges += [np.unique(np.array(row[f"q{i}"] or [])) for i in some]
    return edges


class BinnedRows:
    """Bin numbers of all features as bytes, label, fold columns and margins, written once."""

    def __init__(self, df: DataFrame, columns: list[str], bins: int = BINS, label: str = "label"):
        first = df.first()
        self.width, self.bins, self.columns = len(first["features"]) if first else 0, bins, columns
        edges = bin_edges(df.select(vector_to_array("features").alias("x")), self.width, bins)
        self.edges = edges

        @F.pandas_udf("binary")
        def coded(values):
            table = np.stack(values.to_numpy())
            codes = np.stack([np.searchsorted(e, table[:, i], side="left") for i, e in enumerate(edges)], axis=1)
            return values.__class__([c.tobytes() for c in codes.astype(np.uint8)])

        self.data = materialize(spread(df).select(
            coded(vector_to_array("features")).alias("codes"), F.col(label).cast("double").alias("y"),
            F.lit(None).cast("binary").alias("margins"), *[F.col(c).cast("int").alias(c) for c in columns]), "binned-rows")

    def passes(self, fn: Callable, width: int, finish: Callable | None = None) -> np.ndarray:
        """Sum of what fn(sums, codes, y, margins, folds) adds to the sums of each block; finish of it, made in a task."""
        columns = self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in _blocks(batches):
                fn(total, *_arrays(batch, columns))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        return tree_sum(self._plain().mapInArrow(run, "sums binary"), width, FAN_IN, finish)

    def with_margins(self, fn: Callable) -> BinnedRows:
        """The rows with new margins, fn(codes, y, margins, folds): (row, model); written, so no round is run again."""
        columns = self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _blocks(batches):
                margins = _cells(fn(*_arrays(batch, columns)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], margins, *batch.columns[3:]], names=batch.schema.names)

        out = BinnedRows.__new__(BinnedRows)
        out.__dict__ = dict(self.__dict__)
        out.data = materialize(self._plain().mapInArrow(run, self.data.schema), "boosted-rows")
        return out

    def _plain(self) -> DataFrame:
        return self.data.select("codes", "y", "margins", *self.columns)


def _masks(sides: list[Side], folds: dict, n: int) -> np.ndarray:
    """(row, model): whether the row is a training row."""
    known: dict = {}
    for side in sides:
        if (side.column, side.value) not in known:
            known[side.column, side.value] = np.ones(n, bool) if side.column is None else folds[side.column] != side.value
    return np.stack([known[side.column, side.value] for side in sides], axis=1)


def _best_cuts(hist: np.ndarray) -> np.ndarray:
    """(feature, [gain, bin, sums on the left, sums on the right]): of each feature the cut that lowers the sum of squares
    most; the first of equals."""
    left = hist.cumsum(axis=1)[:, :-1]
    total = hist[0].sum(axis=0)
    n_left, s_left = left[..., 0], left[..., 1]
    n_right, s_right = total[0] - n_left, total[1] - s_left
    gain = s_left ** 2 / np.maximum(n_left, 1) + s_right ** 2 / np.maximum(n_right, 1) - total[1] ** 2 / max(total[0], 1)
    gain = np.where((n_left > 0) & (n_right > 0), np.round(gain, 9), -1.0)
    cut = gain.argmax(axis=1)
    low = (np.arange(hist.shape[1]) <= cut[:, None])[..., None]
    out = np.empty((len(hist), CUT))
    out[:, 0], out[:, 1] = gain[np.arange(len(hist)), cut], cut
    out[:, 2:2 + SUMS], out[:, 2 + SUMS:] = np.where(low, hist, 0.0).sum(axis=1), np.where(low, 0.0, hist).sum(axis=1)
    return out


@dataclass
class Spot:
    """What is counted at one path for one column of folds: the cells of the union of the models' features, once for the
    rows of each fold value asked for and once for the others; with one value, for the rows without it alone."""

    source: int  # of the targets
    path: tuple
    column: str | None
    members: list[tuple[int, int]] = field(default_factory=list)  # (model, node)
    values: list[int] = field(default_factory=list)
    features: np.ndarray | None = None

    def shape(self, bins: int, sums: int) -> tuple[int, int, int, int]:
        return sums, len(self.values) + 1 if len(self.values) > 1 else 1, len(self.features), bins


def grow(rows: BinnedRows, sides: list[Side], depth: int, targets: Callable | None = None,
         kept: list[dict] | None = None, source: list[int] | None = None) -> list[Tree]:
    """One tree per side, least squares of the targets in the leaves.

    targets(codes, y, margins) gives (targets, curvatures), each (source, row), and ``source`` the row of each model;
    without it the label is the target of all. ``kept`` holds for each side the cuts of earlier trees on the same targets
    and at least the same features; nodes found there cost no pass.
    """
    bins, trees = rows.bins, [Tree(depth) for _ in sides]
    if source is None:
        source = [0] * len(sides) if targets is None else list(range(len(sides)))
    open_nodes = [(m, 0) for m in range(len(sides))]
    for level in range(depth):
        cuts: dict[tuple[int, int], np.ndarray] = {}
        spots: dict[tuple, Spot] = {}
        for m, node in open_nodes:
            path, side = trees[m].path(node), sides[m]
            known = kept[m].get(path) if kept is not None else None
            if known is not None:
                cuts[m, node] = known[1][np.searchsorted(known[0], side.features)]
                continue
            spot = spots.setdefault((source[m], path, side.column), Spot(source[m], path, side.column))
            spot.members.append((m, node))
            spot.features = side.features if spot.features is None else np.union1d(spot.features, side.features)
            if side.value not in spot.values:
                spot.values.append(side.value)
        ask = list(spots.values())
        while ask:
            part, used = [], 0
            while ask and (not part or used + math.prod(ask[0].shape(bins, SUMS)) <= MAX_SUMS):
                used += math.prod(ask[0].shape(bins, SUMS))
                part.append(ask.pop(0))
            found = _count(rows, sides, part, targets)
            cuts.update(found)
            if kept is not None:
                for (m, node), own in found.items():
                    if sum(c.size for _, c in kept[m].values()) + own.size <= MAX_KEPT // len(sides):
                        kept[m][trees[m].path(node)] = (sides[m].features, own)
        following = []
        for m, node in open_nodes:
            own, tree = cuts[m, node], trees[m]
            if level == 0:
                tree.sums[0] = own[0, 2:2 + SUMS] + own[0, 2 + SUMS:]
            at = int(own[:, 0].argmax())  # the first of equals
            gain, cut = float(own[at, 0]), int(own[at, 1])
            if gain <= LEAST_GAIN:
                continue
            tree.feature[node], tree.cut[node], tree.gain[node] = sides[m].features[at], cut, gain
            tree.sums[2 * node + 1], tree.sums[2 * node + 2] = own[at, 2:2 + SUMS], own[at, 2 + SUMS:]
            following += [(m, child) for child in (2 * node + 1, 2 * node + 2) if tree.sums[child, 0] >= 2]
        open_nodes = following
    return trees


def _count(rows: BinnedRows, sides: list[Side], spots: list[Spot], targets: Callable | None) -> dict[tuple[int, int], np.ndarray]:
    """Best cuts (feature, CUT) of the nodes (model, node) of the spots; the histograms stay in the tasks."""
    bins, sums = rows.bins, SUMS if targets is not None else SUMS - 1  # without targets curvatures are row counts
    shapes = [spot.shape(bins, sums) for spot in spots]
    starts = np.cumsum([0, *[math.prod(shape) for shape in shapes]])
    roots: dict[int, dict] = {}  # of each source, the paths as a tree: each split sends the rows on once
    for i, spot in enumerate(spots):
        at = roots.setdefault(spot.source, {"spots": [], "splits": {}})
        for feature, cut, side in spot.path:
            at = at["splits"].setdefault((feature, cut), {}).setdefault(side, {"spots": [], "splits": {}})
        at["spots"].append(i)

    def add(total, codes, y, margins, folds):
        told = targets(codes, y, margins) if targets is not None else None
        tables: dict[bytes, np.ndarray] = {}

        def count(i, some, weights):
            spot, (_, groups, width, _) = spots[i], shapes[i]
            fold = folds[spot.column][some] if spot.column is not None else None
            if groups == 1 and fold is not None:
                some = some[fold != spot.values[0]]
            key = spot.features.tobytes()
            if key not in tables:
                tables[key] = codes[:, spot.features].astype(np.intp) + np.arange(width) * bins
            cell = tables[key][some] if len(some) < len(y) else tables[key]
            if groups > 1:
                slot = np.zeros(len(some), np.intp)
                for k, value in enumerate(spot.values):
                    slot[fold == value] = k + 1
                cell = cell + (slot * (width * bins))[:, None]
            cell, size, at = cell.ravel(), groups * width * bins, starts[i]
            total[at:at + size] += np.bincount(cell, minlength=size)
            for w in weights:
                at += size
                total[at:at + size] += np.bincount(cell, np.repeat(w[some], width), size)

        def walk(at, some, weights):
            for i in at["spots"]:
                count(i, some, weights)
            for (feature, cut), ways in at["splits"].items():
                high = codes[some, feature] > cut
                for side, following in ways.items():
                    walk(following, some[high if side == 2 else ~high], weights)

        for source, root in roots.items():
            walk(root, np.arange(len(y)), (y,) if told is None else (told[0][source], told[1][source]))

    def cuts(flat: np.ndarray) -> np.ndarray:
        out = []
        for spot, shape, at in zip(spots, shapes, starts, strict=False):
            table = np.moveaxis(flat[at:at + math.prod(shape)].reshape(shape), 0, -1)
            if table.shape[-1] < SUMS:
                table = table[..., [0, 1, 0]]
            whole = table.sum(axis=0)
            out += [_best_cuts(whole - table[k + 1] if len(table) > 1 else whole).ravel() for k in range(len(spot.values))]
        return np.concatenate(out)

    flat, at, found = rows.passes(add, int(starts[-1]), cuts), 0, {}
    for spot in spots:
        own, step = {}, len(spot.features) * CUT
        for value in spot.values:
            own[value] = flat[at:at + step].reshape(-1, CUT)
            at += step
        for m, node in spot.members:
            found[m, node] = own[sides[m].value][np.searchsorted(spot.features, sides[m].features)]
    return found


# ---- elimination -------------------------------------------------------------------------------


def eliminate(rows: BinnedRows, sides: list[Side], sizes: list[int], depth: int = 10, step: int = 1) -> list[dict[int, np.ndarray]]:
    """For each side the features left at each size: a tree is grown, its ``step`` least important features go (the first
    of equals), and so on down to the smallest size. A step never leaps over a size.

    Features that no split uses go without a new tree, as the tree would be the same.
    """
    goals = sorted(set(sizes), reverse=True)
    left, out = [side.features for side in sides], [{} for _ in sides]
    kept: list[dict] = [{} for _ in sides]
    active = list(range(len(sides)))
    while active:
        trees = grow(rows, [Side(left[m], sides[m].column, sides[m].value) for m in active], depth, kept=[kept[m] for m in active])
        following = []
        for m, tree in zip(active, trees, strict=True):
            weight = tree.importance(rows.width)
            while True:
                if len(left[m]) in goals:
                    out[m][len(left[m])] = left[m]
                lower = [g for g in goals if g < len(left[m])]
                if not lower:
                    break
                order = left[m][np.argsort(weight[left[m]], kind="stable")]
                gone = order[:min(step, len(left[m]) - lower[0])]
                left[m] = np.setdiff1d(left[m], gone)
                if weight[gone].any():
                    following.append(m)
                    break
        for m in active:  # a histogram on a path that splits by a lost feature is never asked for again
            have = set(left[m].tolist())
            kept[m] = {p: h for p, h in kept[m].items() if all(f in have for f, _, _ in p)}
        active = following
    return out


# ---- boosting ----------------------------------------------------------------------------------


def boosted_counts(rows: BinnedRows, sides: list[Side], rounds: int = 100, depth: int = 3, rate: float = 0.1) -> np.ndarray:
    """(right, all) of each side's rows outside its training rows: boosted trees on the logistic loss, leaves by Newton steps.

    Sides with the same training rows have the same margins until their trees differ; margins are kept once for them.
    """
    n = len(sides)

    def share_of(total, codes, y, margins, folds):
        train = _masks(sides, folds, len(y))
        total += np.concatenate([train.sum(axis=0), (y[:, None] * train).sum(axis=0)])

    counts = rows.passes(share_of, 2 * n)
    share = np.clip(counts[n:] / np.maximum(counts[:n], 1), 1e-9, 1 - 1e-9)
    start = np.log(share / (1 - share))
    # of each set of sides that have grown the same trees: the sides, the written margin, the trees since then
    alike: dict[tuple, list[int]] = {}
    for m, side in enumerate(sides):
        alike.setdefault((side.column, side.value), []).append(m)
    sets = [(own, k, ()) for k, own in enumerate(alike.values())]
    first = np.array([start[own[0]] for own, _, _ in sets])

    def margins_of(codes, y, margins, folds=None):
        """(set, row)"""
        features = np.ascontiguousarray(codes.T)
        z = np.empty((len(sets), len(y)))
        for k, (_, written, trees) in enumerate(sets):
            z[k] = first[written] if margins is None else margins[:, written]
            for feature, cut, values in trees:
                z[k] += values[_ends(features, feature, cut)]
        return z

    def targets(codes, y, margins):
        p = 1.0 / (1.0 + np.exp(-margins_of(codes, y, margins)))
        return y - p, p * (1 - p)

    for done in range(1, rounds + 1):
        source = np.empty(n, int)
        for k, (own, _, _) in enumerate(sets):
            source[own] = k
        trees, following = grow(rows, sides, depth, targets, source=source.tolist()), []
        for own, written, before in sets:
            parted: dict[tuple, tuple[list[int], tuple]] = {}
            for m in own:
                tree = trees[m].feature, trees[m].cut, trees[m].values(rate)
                parted.setdefault(tuple(x.tobytes() for x in tree), ([], tree))[0].append(m)
            following += [(some, written, (*before, tree)) for some, tree in parted.values()]
        sets = following
        if done % WRITE_EVERY == 0 and done < rounds:
            rows = rows.with_margins(lambda *block: margins_of(*block).T)
            sets = [(own, k, ()) for k, (own, _, _) in enumerate(sets)]

    def score(total, codes, y, margins, folds):
        right = (margins_of(codes, y, margins) > 0) == (y > 0.5)
        test, of = ~_masks(sides, folds, len(y)), np.empty(n, int)
        for k, (own, _, _) in enumerate(sets):
            of[own] = k
        total += np.concatenate([(right[of].T & test).sum(axis=0), test.sum(axis=0)])

    return rows.passes(score, 2 * n).reshape(2, n).T


def elimination_sizes(width: int) -> list[int]:
    """4 to 104 by tens, then 204 to 904 by hundreds, as far as there are features; and all of them."""
    return sorted({s for s in [*range(4, 105, 10), *range(204, 905, 100)] if s < width} | {width})


CURVE_SCHEMA = "n_features int, folds int, mean_accuracy double, std_accuracy double, always_kept array<int>"


def elimination_curve(df: DataFrame, folds: list[tuple[str, int]], sizes: list[int] | None = None, depth: int = 10,
                      step: int = 1, rounds: int = 100, boost_depth: int = 3, rate: float = 0.1) -> list[tuple]:
    """Rows of CURVE_SCHEMA: for each size, test accuracy of boosted trees on the features that the elimination inside
    each fold has left, mean and population deviation over the folds, and the features that are left in all of them.

    df has features, label and the fold columns; a fold is (column, value), its rows with that value are the test side.
    """
    rows = BinnedRows(df, sorted({c for c, _ in folds}))
    sizes = sizes or elimination_sizes(rows.width)
    whole = np.arange(rows.width)
    left = eliminate(rows, [Side(whole, c, v) for c, v in folds], sizes, depth, step)
    sides = [Side(left[m][size], c, v) for size in sizes for m, (c, v) in enumerate(folds)]
    right, n = boosted_counts(rows, sides, rounds, boost_depth, rate).T
    share = (right / np.maximum(n, 1)).reshape(len(sizes), len(folds))
    out = []
    for i, size in enumerate(sizes):
        always = set(whole.tolist()).intersection(*[left[m][size].tolist() for m in range(len(folds))])
        out.append((size, len(folds), float(share[i].mean()), math.sqrt(float(share[i].var())), sorted(always)))
    return out
