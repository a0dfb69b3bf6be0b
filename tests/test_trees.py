import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_vector
from threadlens.operators import shared_trees as st
from threadlens.operators import splits as sp


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(240, 9)), 2)
    x[:, 8] = 1.0
    y = (x[:, 1] + x[:, 4] * (x[:, 6] > 0) + 0.3 * rng.normal(size=240) > 0).astype(float)
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(5)
    folded = sp.k_folds(df.select("id", as_vector(F.col("x")).alias("features"), "label"), ["id"], 3).cache()
    folds = {r.id: r.fold for r in folded.select("id", "fold").collect()}
    return folded, x, y, np.array([folds[i] for i in range(240)])


def codes_of(rows, x):
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(rows.edges)], axis=1)


def plain_tree(codes, s, h, features, depth):
    """(leaf sums per row, importances) of a tree grown by trying every split of every node."""
    weight, ends = np.zeros(codes.shape[1]), np.zeros((len(s), 2))

    def split(rows, d):
        best = (st.LEAST_GAIN, None, None)
        if d and len(rows) >= 2:
            for f in features:
                for cut in range(st.BINS - 1):
                    low = codes[rows, f] <= cut
                    a, b = rows[low], rows[~low]
                    if len(a) and len(b):
                        gain = round(s[a].sum() ** 2 / len(a) + s[b].sum() ** 2 / len(b) - s[rows].sum() ** 2 / len(rows), 9)
                        if gain > best[0]:
                            best = (gain, f, cut)
        gain, f, cut = best
        if f is None:
            ends[rows] = s[rows].sum(), h[rows].sum()
            return []
        weight[f] += gain
        low = codes[rows, f] <= cut
        return [(f, cut, split(rows[low], d - 1), split(rows[~low], d - 1))]

    return split(np.arange(len(s)), depth), weight, ends


def follow(tree, code):
    path = []
    while tree:
        f, cut, low, high = tree[0]
        side = code[f] > cut
        path.append((f, cut, bool(side)))
        tree = high if side else low
    return tuple(path)


def test_elimination_equals_a_walk_with_a_new_tree_each_time(table):
    df, x, y, fold = table
    rows = st.BinnedRows(df, ["fold"])
    codes = codes_of(rows, x)
    sides = [st.Side(np.arange(9), "fold", v) for v in range(3)] + [st.Side(np.arange(9))]
    for step in (1, 2):
        got = st.eliminate(rows, sides, [2, 5, 9], depth=3, step=step)
        for m, side in enumerate(sides):
            train = fold != side.value if side.column else np.ones(240, bool)
            left, expected = list(range(9)), {9: list(range(9))}
            while len(left) > 2:
                _, weight, _ = plain_tree(codes[train], y[train], np.ones(train.sum()), left, 3)
                lower = max(g for g in (2, 5) if g < len(left))
                for f in sorted(left, key=lambda f: (weight[f], f))[:min(step, len(left) - lower)]:
                    left = [g for g in left if g != f]
                if len(left) in (2, 5):
                    expected[len(left)] = left
            assert {k: v.tolist() for k, v in got[m].items()} == expected
            assert {1}.issubset(expected[2])


def test_boosting_equals_plain_boosting(table, monkeypatch):
    df, x, y, fold = table
    rows = st.BinnedRows(df, ["fold"])
    codes = codes_of(rows, x)
    monkeypatch.setattr(st, "WRITE_EVERY", 2)
    monkeypatch.setattr(st, "MAX_SUMS", 1500)
    sides = [st.Side(np.array([1, 4, 6]), "fold", 0), st.Side(np.arange(9), "fold", 2)]
    got = st.boosted_counts(rows, sides, rounds=5, depth=2, rate=0.3)
    for (right, n), side in zip(got, sides, strict=True):
        train = fold != side.value
        z = np.full(240, np.log(y[train].mean() / (1 - y[train].mean())))
        for _ in range(5):
            p = 1 / (1 + np.exp(-z))
            tree, _, ends = plain_tree(codes[train], (y - p)[train], (p * (1 - p))[train], side.features.tolist(), 2)
            value = {follow(tree, c): 0.3 * e[0] / e[1] for c, e in zip(codes[train], ends, strict=True)}
            z = z + np.array([value[follow(tree, c)] for c in codes])
        test = ~train
        assert n == test.sum() and right == ((z > 0) == (y > 0.5))[test].sum()


def test_curve_over_sizes(table):
    df, *_ = table
    rows = st.elimination_curve(df, [("fold", v) for v in range(3)], [2, 4, 9], depth=4, rounds=8, rate=0.3)
    assert [r[0] for r in rows] == [2, 4, 9] and all(r[1] == 3 for r in rows)
    assert 1 in rows[0][4] and len(rows[2][4]) == 9
    assert rows[1][2] > 0.75 and all(0 <= r[3] < 0.2 for r in rows)


def test_sizes():
    assert st.elimination_sizes(1024) == [*range(4, 105, 10), *range(204, 905, 100), 1024]
    assert st.elimination_sizes(64) == [4, 14, 24, 34, 44, 54, 64]


def test_driver_receives_cuts_and_no_histograms(table, monkeypatch):
    rows, received, plain = st.BinnedRows(table[0], ["fold"]), [], st.tree_sum

    def told(*args):
        received.append(plain(*args))
        return received[-1]

    monkeypatch.setattr(st, "tree_sum", told)
    st.grow(rows, [st.Side(np.arange(9), "fold", v) for v in range(3)], 2)
    assert [len(r) for r in received][0] == 3 * 9 * 8 < 3 * 9 * st.BINS  # gain, bin and six sums of each feature


def test_equal_nodes_are_counted_once(table, monkeypatch):
    df, x, y, fold = table
    rows, asked, plain = st.BinnedRows(df, ["fold"]), [], st.BinnedRows.passes

    def told(self, fn, width, finish=None):
        asked.append(width)
        return plain(self, fn, width, finish)

    monkeypatch.setattr(st.BinnedRows, "passes", told)
    folds = [st.Side(np.arange(9), "fold", v) for v in range(3)]
    trees = st.grow(rows, folds, 3)
    # at the root rows and targets of each fold value and of the others, not of the training rows of each fold
    assert asked[0] == 2 * 4 * 9 * st.BINS < 3 * 3 * 9 * st.BINS
    for side, tree in zip(folds, trees, strict=True):
        alone = st.grow(rows, [side], 3)[0]
        assert np.array_equal(tree.feature, alone.feature) and np.array_equal(tree.cut, alone.cut)
        assert np.allclose(tree.sums, alone.sums)
        codes, train = codes_of(rows, x), fold != side.value
        assert tree.sums[0].tolist() == [train.sum(), y[train].sum(), train.sum()] and len(codes) == 240
    # models of one fold over the larger of two nested sets of features, until their trees differ
    nested = [st.Side(f, "fold", 1) for f in (np.array([1, 4, 6]), np.arange(9))]
    asked.clear()
    both = st.boosted_counts(rows, nested, rounds=6, depth=2, rate=0.3)
    assert asked[1] == 3 * 9 * st.BINS
    assert both.tolist() == [st.boosted_counts(rows, [side], rounds=6, depth=2, rate=0.3)[0].tolist() for side in nested]


def test_ends_of_a_deep_tree():
    rng = np.random.default_rng(3)
    codes, tree = rng.integers(0, st.BINS, (200, 5)).astype(np.uint8), st.Tree(7)
    tree.feature[:127], tree.cut[:127] = rng.integers(-1, 5, 127), rng.integers(0, st.BINS, 127)
    for row, got in zip(codes, st._ends(np.ascontiguousarray(codes.T), tree.feature, tree.cut), strict=True):
        node = 0
        while tree.feature[node] >= 0:
            node = 2 * node + 1 + int(row[tree.feature[node]] > tree.cut[node])
        assert node == got
