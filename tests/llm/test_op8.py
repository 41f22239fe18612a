import numpy as np
import pytest

from manyfold.llm import op8_embeddings as op


def brute(rows, threshold=0.98):
    def ok(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = (np.array(np.array(x[1], np.float32), float) for x in (a, b))
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted(((r[0], links[i], least.get(find(i)), r[0] is not None and r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


def fixture(d=8):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, d))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=d) * 0.12], i % 3 if i % 5 else 0) for i in range(260)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(30)] + [(2000, [2 * x for x in rows[7][1]], rows[7][2])]
    rows += [(3000, None, 1), (3001, [0.0] * d, 1), (3002, [float("nan")] * d, 1), (3003, [float("inf")] + [1.0] * (d - 1), 1), (3004, [None] + [1.0] * (d - 1), 1)]
    rows += [(3005, rows[7][1], None), (3006, rows[7][1], None), (3007, [1.0, 2.0], 0), (3008, [1.0, 2.0], 0), (7, rows[7][1], rows[7][2]), (3009, [], 0), (None, rows[3][1], rows[3][2])]
    return rows


@pytest.mark.parametrize("block", [16, 1024])
def test_matches_brute_force(spark, block):
    rows = fixture()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, cls int, v string").repartition(3)
    got = sorted((tuple(r) for r in op.near_duplicates(frame, block=block).collect()), key=str)
    assert got == brute(rows)


def test_dense_groups_and_trees():
    rng = np.random.default_rng(2)
    for spread in (0.001, 0.05, 0.3):
        v = rng.normal(size=(1, 10)) + rng.normal(size=(200, 10)) * spread
        w = rng.integers(1, 4, 200)
        links = op.link_blocks([(v, w)])
        u = v / np.linalg.norm(v, axis=1)[:, None]
        near = (u @ u.T >= 0.98) & ~np.eye(200, dtype=bool)
        assert (links.counts == near @ w).all()
        two = op.link_blocks([(v[:80], w[:80]), (v[80:], w[80:])])
        cross = near.copy()
        cross[:80, :80] = cross[80:, 80:] = False
        assert (two.counts == cross @ w).all()
        tree = op.CoverTree(u)
        for node, kids in enumerate(tree.kids):
            if not tree.leaf[node]:
                assert sorted(np.concatenate([tree.rows[k] for k in kids])) == sorted(tree.rows[node])
                assert tree.centre[node] in tree.centre[kids]


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op.near_duplicates(frame).count() == 0
