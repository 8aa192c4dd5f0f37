"""Searches over vectors against brute force, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from filmstrip.llm import blocks, negatives, neighbours, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90, every=100):
    """Rows of (id, whole numbers, label), by position, so that copies are rows of their own."""
    out = []
    for a, (i, v, c) in enumerate(rows):
        if i % every:
            continue
        other = [(-sum(x * y for x, y in zip(v, w)), j, d == c) for b, (j, w, d) in enumerate(rows) if b != a and len(w) == len(v)]
        for p, j, _ in sorted(x for x in other if x[2])[:positives]:
            fits = sorted((s, k) for s, k, same in other if not same and low * -p <= 100 * -s <= high * -p)[:negatives]
            out += [(i, j, n, k, -p, -s) for n, (s, k) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"rows_per_block": 30, "sample": 20, "pivots": 3}, {"rows_per_block": 30, "sample": 5, "pivots": 1}])
def test_negatives(spark, options):
    r = np.random.default_rng(2)
    base = r.integers(-60, 60, (12, 6))
    rows = [(int(i), (base[i % 12] + r.integers(-25, 25, 6)).tolist(), int(i % 4)) for i in range(240)]
    rows += [(100, rows[100][1], 0), (100, rows[7][1], 3), (300, [0] * 6, 1), (400, [3, 4], 0), (401, [3, 5], 0), (402, [2, 1], 1), (500, [], 2), (501, [], 2), (502, [], 3)]
    rows += [(600 + k, rows[33][1], k % 2) for k in range(30)]
    odd = [(None, [1.0] * 6, 0), (700, None, 0), (700, [None] + [1.0] * 5, 0), (700, [NAN] + [1.0] * 5, 0), (700, [-INF] * 6, 0), (700, [1.0] * 6, None), (700, [1e10] * 6, 0)]
    df = spark.createDataFrame([(i, [float(x) for x in v], c) for i, v, c in rows] + odd, VECTORS).selectExpr("*", "1 as id", "2 as row", "3 as block", "'x' as norm").repartition(3)
    got = sorted(map(tuple, negatives.hard_negatives(df, "id % 100 = 0", **options).collect()))
    want = brute_negatives(rows)
    assert len(want) > 300 and got == want
    assert negatives.hard_negatives(df.limit(0), "id % 100 = 0").count() == 0


def test_negatives_beyond_doubles(spark):
    """Scores over 2^53 are exact."""
    r = np.random.default_rng(4)
    rows = [(int(i), [int(x) for x in r.integers(1 << 29, 1 << 30, 3)], int(i % 2)) for i in range(60)]
    df = spark.createDataFrame([(i, [float(x) for x in v], c) for i, v, c in rows], VECTORS)
    assert sorted(map(tuple, negatives.hard_negatives(df, "id % 20 = 0", rows_per_block=16).collect())) == brute_negatives(rows, every=20)


def test_brackets_hold_scores():
    r = np.random.default_rng(3)
    x, q = r.integers(-300, 300, (400, 8)).astype(float), r.integers(-300, 300, (30, 8)).astype(float)
    x[:100] = x[0] + r.integers(-9, 9, (100, 8))
    most = float((x * x).sum(axis=1).max())
    table = negatives.Pivots(x[::7], most)
    low, high = table.brackets(q, table.of_anchors(q), table.of_rows(x))
    s = q @ x.T
    assert (low <= s).all() and (s <= high).all()
    near = table.brackets(x[:5], table.of_anchors(x[:5]), table.of_rows(x))[1]
    assert (near[:, 100:] < (x[:5] @ x[:5].T).min()).mean() > 0.1  # and tell some rows apart


def test_negatives_query(spark):
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_negatives(spark, SF).collect())) == brute_negatives(rows)


def brute_neighbours(rows, most=20, every=20):
    out = {}
    for a, (i, v) in enumerate(rows):
        if i % every == 0:
            all_ = sorted((-float((np.array(v) * np.array(w)).sum()), j) for b, (j, w) in enumerate(rows) if b != a and len(w) == len(v))
            out.setdefault(i, []).append([(j, -s) for s, j in all_[:most]])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("options", [{}, {"rows_per_block": 50, "sample": 30}, {"probes": 1, "rows_per_block": 50}, {"tables": 1, "probes": 2, "recall": 0.2, "most": 7}])
def test_neighbours(spark, options):
    r = np.random.default_rng(6)
    base = r.standard_normal((25, 12)) * r.uniform(0.5, 3, (25, 1))
    rows = [(int(i), [float(x) for x in base[i % 25] + r.standard_normal(12) * 0.2]) for i in range(500)]
    rows += [(1000 + k, rows[40][1]) for k in range(40)] + [(2000, [3.0, 4.0]), (2001, [1.0, 1.0]), (2020, [5.0])]
    odd = [(3000, None), (3000, [0.0] * 12), (3000, [NAN] * 12), (3000, [None] + [1.0] * 11), (3000, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], VECTORS).selectExpr("*", "1 as id", "2 as row", "3 as bucket").repartition(3)
    most = options.get("most", 20)
    got, want = found(neighbours.neighbours(df, "id % 20 = 0", **options)), brute_neighbours(rows, most)
    assert set(got) == {i for i, (best,) in want.items() if best}
    hits = total = 0
    scores = {i: {j: s for j, s in brute[0]} for i, brute in brute_neighbours(rows, 10_000).items()}
    for i, rows_of in got.items():
        assert [x[0] for x in rows_of] == list(range(1, len(want[i][0]) + 1))
        assert [(-s, j) for _, j, s in rows_of] == sorted((-s, j) for _, j, s in rows_of)
        assert all(s == scores[i][j] for _, j, s in rows_of)
        hits += len({j for _, j, _ in rows_of} & {j for j, _ in want[i][0]})
        total += len(want[i][0])
    assert hits / total >= (0.9 if "recall" not in options else 0.2)
    assert neighbours.neighbours(df.limit(0), "id % 20 = 0").count() == 0


def test_probes_come_in_order_of_success():
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 10))
    h = neighbours.Tables(10, 4, 2, np.abs(x).max(), float(((x / np.abs(x).max()) ** 2).sum(axis=1).max()))
    q = x[:40] + r.standard_normal((40, 10)) * 0.01
    for t in range(2):
        few, many = h.probes(q, t, 30, 0.6), h.probes(q, t, 200, 0.6)
        assert (few == many[:, :30]).mean() > 0.99  # the best part-products lead to the best products
        assert all(len(set(p)) == len(p) for p in many.tolist())
    # a query's own bucket, that of its lifted vector, comes first
    own = np.floor(h._at(q, True))
    key = np.full(40, h._seed(0))
    for j in range(4):
        key = h._mixed(own[:, j], key, j)
    assert (h.probes(q, 0, 5, 0.3)[:, 0] == key.view(np.int64)).mean() > 0.6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_neighbours_query(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got, want = found(queries.op13_neighbours(spark, f"/root/testdata/{sf}")), brute_neighbours(rows)
    assert set(got) == set(want)
    hits = sum(len({j for _, j, _ in got[i]} & {j for j, _ in want[i][0]}) for i in want)
    assert hits >= 0.9 * sum(len(w[0]) for w in want.values())
    assert all(len(got[i]) == len(want[i][0]) for i in want)


def test_best_of_pairs():
    q = np.array([1, 0, 1, 1, 0, 1])
    neg, ids = np.array([3, 1, 2, 2, 1, 9]), np.array([5, 9, 8, 7, 4, 1])
    assert blocks.best(q, neg, ids, 2).tolist() == [4, 1, 3, 2]
    assert blocks.best(q[:0], neg[:0], ids[:0], 2).tolist() == []
