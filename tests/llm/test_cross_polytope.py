import numpy as np
import pytest

from threadlens.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<float>, label int, links int, owner string"


def brute(rows, least=0.93):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links, of = len(rows), [0] * len(rows), {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i == j or a[2] is None or a[2] != b[2] or not ok(a[1]) or not ok(b[1]) or len(a[1]) != len(b[1]):
                continue
            if a[0] is None or b[0] is None:
                continue
            x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                r, s = sorted((root(a[0]), root(b[0])))
                of[s] = r
    return sorted(((r[0], k, root(r[0]) if r[0] is not None else None) for r, k in zip(rows, links, strict=True)), key=str)


def make_rows(seed):
    rng, rows = np.random.default_rng(seed), []
    for g in range(14):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            v = base + rng.normal(size=16) * rng.choice([0, 0.1, 0.25])
            rows.append([len(rows) + 5, (v * rng.choice([1, 3])).tolist(), int(g % 3), 0, "x"])
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [[1000 + i, v, 1, None, None] for i, v in enumerate(odd)]
    rows += [[2000, rows[0][1], None, 1, "y"], [None, rows[0][1], 0, 1, "y"], list(rows[3]), [2001, rows[3][1], 2, 0, ""]]
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("block", [1024, 7])
def test_links_match_brute_force(spark, block):
    rows = make_rows(block)
    df = spark.createDataFrame(rows, SCHEMA)
    out = cp.near_vectors(df, block=block, tables=10)
    assert out.columns == [*df.columns, "n_links", "component_id"]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert cp.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(1).normal(size=(3, 32))
    assert np.allclose(cp.hadamard(cp.hadamard(x)) / 32, x)


def test_recall_at_the_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * r / np.linalg.norm(r, axis=1)[:, None]
    group = np.zeros(len(x), np.uint64)
    a, b = cp.buckets(x, group), cp.buckets(y, group)
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() > 0.999


def test_batches_are_joined_across_blocks():
    """A block that is spread over several Arrow batches gives what it gives in one."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1, 8)) + rng.normal(size=(30, 8)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    keys = cp.buckets(x, np.zeros(30, np.uint64))
    bucket = keys[0, 0]
    rows = [i for i in range(30) if (keys[i] == bucket).any()]
    table = pa.table({"bucket": [int(bucket.view(np.int64))] * len(rows), "i": [0] * len(rows), "j": [0] * len(rows),
                      "chunk": [0] * len(rows), "owner": rows, "n": [1] * len(rows), "vec": [x[i].tobytes() for i in rows],
                      "keys": [keys[i].tobytes() for i in rows]})
    whole = [b.to_pydict() for b in cp.link_groups(iter(table.to_batches()), 0.93, cp.PROBES)]
    parts = [b.to_pydict() for b in cp.link_groups(iter(table.to_batches(max_chunksize=3)), 0.93, cp.PROBES)]
    assert parts == whole and sum(whole[0]["links"]) > 0


def test_more_probes_than_four():
    x = np.random.default_rng(0).normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    group = np.zeros(50, np.uint64)
    few, many = (cp.buckets(x, group, 2, p).reshape(50, 2, p) for p in (3, 9))
    assert (many[:, :, :2] == few[:, :, :2]).all()
    assert all(len(set(row)) == 9 for table in many for row in table)
    with pytest.raises(ValueError):
        cp.buckets(x[:, :1], group, 1, 10)
