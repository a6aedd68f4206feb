"""Hard negatives: trees against all points, the operator against its definition, edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.llm import hard_negatives as H


def forest_of(points, ids, labels, sizes, leaf=4):
    trees, at = [], 0
    for n in sizes:
        part = slice(at, at + n)
        trees.append(H.build_tree(ids[part], labels[part], points[part], leaf))
        at += n
    return H.Forest(trees)


@pytest.mark.parametrize("spread", [3, 300])
def test_forest_equals_all_points(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (6, 5))
    points = (centres[rng.integers(0, 6, 400)] + rng.integers(-3, 4, (400, 5))).astype(float)
    points[50:90] = points[50]  # copies
    points[90] = 0
    ids, labels = rng.permutation(400), rng.integers(0, 3, 400)
    forest = forest_of(points, ids, labels, [150, 249, 1])
    for q in [*points[:12], np.zeros(5)]:
        scores = points @ q
        windows = [(-math.inf, math.inf), (scores.max() * 0.3, scores.max() * 0.9), (0.0, 0.0), (5.0, -5.0)]
        got = forest.search(q, windows, 7, lambda p: forest.labels[p] != 1)
        for (low, high), found in zip(windows, got):
            ok = [(int(i), int(s)) for i, s, y in zip(ids, scores, labels) if y != 1 and low <= s <= high]
            assert found == sorted(ok, key=lambda x: (-x[1], x[0]))[:7]


def test_tree_covers_its_points():
    rng = np.random.default_rng(1)
    points = rng.integers(-50, 50, (300, 4)).astype(float)
    tree = H.build_tree(np.arange(300), np.zeros(300, int), points, 8)
    assert sorted(tree.ids) == list(range(300))
    lifted = np.column_stack([tree.points, np.sqrt(np.maximum(tree.square - (tree.points**2).sum(axis=1), 0))])

    def below(node):
        if tree.leaf[node]:
            return list(range(tree.first[node], tree.last[node]))
        return [p for child in range(tree.first[node], tree.last[node]) for p in below(child)]

    assert sorted(below(0)) == list(range(300))
    for node in range(len(tree.centre)):
        gaps = np.linalg.norm(lifted[below(node)] - lifted[tree.centre[node]], axis=1)
        assert gaps.max() <= tree.radius[node]
        if not tree.leaf[node]:
            for child in range(tree.first[node], tree.last[node]):
                assert tree.radius[child] <= tree.radius[node] / H.BASE + 1e-5


def test_forest_skips_what_lies_outside():
    rng = np.random.default_rng(2)
    near = rng.integers(90, 110, (200, 3)).astype(float)
    far = -rng.integers(90, 110, (200, 3)).astype(float)
    points = np.concatenate([near, far])
    forest = forest_of(points, np.arange(400), np.zeros(400, int), [400], 8)
    seen = []

    def fits(p):
        seen.extend(p)
        return np.ones(len(p), bool)

    forest.search(np.array([100.0, 100.0, 100.0]), [(0.0, math.inf)], 5, fits)
    assert seen and max(forest.ids[seen]) < 200


def by_definition(rows, every=100):
    rows = {i: (y, [math.floor(256 * x) for x in v]) for i, y, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, (y, v) in rows.items():
        if i % every:
            continue
        scored = sorted(((-dot(v, w), j, z) for j, (z, w) in rows.items() if j != i))
        for s, p, _ in [x for x in scored if x[2] == y][:5]:
            ok = [(t, n) for t, n, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out |= {(i, p, r, n, -s, -t) for r, (t, n) in enumerate(ok, 1)}
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_operator_by_definition(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(H, "TREE_POINTS", 60)
    monkeypatch.setattr(H, "TREES", 3)
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(700)]
    rows = [(i, y, rows[0][2]) if i % 3 == 1 else (i, y, v) for i, y, v in rows]  # a third has one vector
    bad = [(None, 1, [1.0] * 6), (1000, None, [1.0] * 6), (1100, 1, None), (1200, 1, [1.0, None]), (1300, 1, [math.nan]), (1400, 1, [math.inf])]
    table = spark.createDataFrame(rows + bad + rows[:50], "vec_id long, label int, embedding array<float>")
    table = table.withColumn("v", F.lit(1)).withColumn("id", F.lit("x")).repartition(7)
    got = H.mine_hard_negatives(H.scaled_vectors(table), F.col("id") % 100 == 0).select(*COLUMNS).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == by_definition(rows)


def test_unlike_lengths_and_empty_tables(spark):
    rows = [(0, 1, [1.0]), (1, 1, [1.0, 2.0]), (2, 2, [0.5, 9.0]), (3, 1, []), (4, 2, [0.6])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = H.mine_hard_negatives(H.scaled_vectors(table), F.col("id") % 100 == 0).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == by_definition(rows)
    for none in (table.where("false"), table.where("vec_id > 0")):
        assert H.mine_hard_negatives(H.scaled_vectors(none), F.col("id") % 100 == 0).collect() == []
