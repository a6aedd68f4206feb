"""Hard negatives by exact inner-product search: forests of cover trees over norm-augmented vectors.

A vector x gets one more component, the root of M^2 - |x|^2 with M the largest norm of its tree, so all vectors of a tree
lie on a sphere and the inner product with a query q falls as the distance to (q, 0) grows: 2 q.x = |q|^2 + M^2 - d^2.
A node of a tree covers its points within a radius, which bounds d and so the inner product from both sides. Descent
opens the nodes with the best bounds first, skips those that lie outside every window or cannot reach the results
found so far, and computes the points of the leaves exactly, in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import write_table

#: Points of one tree (the mean), trees that one task searches together, points of a leaf, ratio of radii by level.
TREE_POINTS = 2048
TREES = 16
LEAF = 32
BASE = 1.3
#: Vectors at most that the space is first divided by; each is the centre of the nearest part of the space.
PIVOTS = 256
#: Queries that one task answers: as many as leave TASKS groups of them, between these two numbers.
QUERIES = (64, 4096)
TASKS = 8
#: Nodes that are opened together in the first step; each step opens twice as many.
OPEN = 64


def scaled_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """Rows (``id``, ``label``, ``v``) with whole components floor(scale * x); ``rows`` has vec_id, label, embedding.

    Rows with a null id, label or vector, or with any null or non-finite component take no part. Of rows that share an
    id, the first by label and vector counts. Vectors of unlike lengths are compared as if the shorter ended in zeros.
    Products are exact while they stay below 2^53. Other columns are ignored.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    valid = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    one = F.min(F.struct(F.col("label").cast("long").alias("label"), whole.alias("v"))).alias("one")
    return valid.groupBy(F.col("vec_id").cast("long").alias("id")).agg(one).select("id", "one.*")


def _matrix(vectors, width: int) -> np.ndarray:
    points = np.zeros((len(vectors), width))
    for row, v in zip(points, vectors):
        row[: len(v)] = v
    return points


@dataclass
class Tree:
    """Points in the order of the leaves. A node has a centre, a radius, and a range of child nodes or of points."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    square: float
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray


def build_tree(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf_size: int = LEAF) -> Tree:
    """A cover tree: the children of a node cover its points within its radius divided by BASE, their centres lie apart."""
    norms = (points * points).sum(axis=1)
    square = float(norms.max(initial=0.0))
    lifted = np.sqrt(square - norms)
    gaps = np.sqrt(np.maximum(2.0 * (square - (points @ points.T + np.outer(lifted, lifted))), 0.0))
    np.fill_diagonal(gaps, 0.0)
    order: list[np.ndarray] = []
    placed = 0
    nodes = [(0, np.arange(len(ids)))]
    centre, radius, first, last, leaf = [], [], [], [], []
    at = 0
    while at < len(nodes):  # breadth first, so that the children of a node are neighbours
        middle, members = nodes[at]
        at += 1
        reach = float(gaps[middle, members].max())
        centre.append(middle)
        radius.append(reach)
        if len(members) <= leaf_size or reach == 0.0:
            leaf.append(True)
            first.append(placed)
            order.append(members)
            placed += len(members)
            last.append(placed)
            continue
        leaf.append(False)
        first.append(len(nodes))
        rest = members
        while len(rest):
            covered = gaps[middle, rest] <= reach / BASE
            nodes.append((middle, rest[covered]))
            rest = rest[~covered]
            if len(rest):
                middle = int(rest[0])
        last.append(len(nodes))
    placed_at = np.concatenate(order)
    where = np.empty(len(ids), np.int64)
    where[placed_at] = np.arange(len(ids))
    return Tree(
        ids[placed_at],
        labels[placed_at],
        points[placed_at],
        square,
        where[np.array(centre)],
        # Rounding of the distances must not shut out a point.
        np.array(radius) * (1 + 1e-9) + 1e-6,
        np.array(first),
        np.array(last),
        np.array(leaf),
    )


class Forest:
    """Several trees searched as one."""

    def __init__(self, trees: list[Tree]):
        nodes = np.cumsum([0, *(len(t.centre) for t in trees)])
        points = np.cumsum([0, *(len(t.ids) for t in trees)])
        joined = lambda parts: np.concatenate(list(parts))
        self.ids = joined(t.ids for t in trees)
        self.labels = joined(t.labels for t in trees)
        self.points = joined(t.points for t in trees)
        self.square = np.repeat([t.square for t in trees], np.diff(nodes))
        self.centre = joined(t.centre + p for t, p in zip(trees, points))
        self.radius = joined(t.radius for t in trees)
        self.leaf = joined(t.leaf for t in trees)
        shift = [np.where(t.leaf, p, n) for t, p, n in zip(trees, points, nodes)]
        self.first = joined(t.first + s for t, s in zip(trees, shift))
        self.last = joined(t.last + s for t, s in zip(trees, shift))
        self.roots = nodes[:-1]

    def bounds(self, nodes: np.ndarray, q: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that any point below a node can have with the query."""
        both = size + self.square[nodes]
        far = np.sqrt(np.maximum(both - 2.0 * (self.points[self.centre[nodes]] @ q), 0.0))
        radius = self.radius[nodes]
        return (both - (far + radius) ** 2) / 2, (both - np.maximum(far - radius, 0.0) ** 2) / 2

    def _ranges(self, nodes: np.ndarray) -> np.ndarray:
        """All numbers of the ranges of some nodes."""
        lengths = self.last[nodes] - self.first[nodes]
        ends = np.cumsum(lengths)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[nodes] - (ends - lengths), lengths)

    def search(self, q: np.ndarray, windows: list[tuple[float, float]], k: int, fits) -> list[list[tuple[int, int]]]:
        """For each window (least and largest score) the k best fitting points as (id, score), ties by smaller id.

        ``fits`` maps point numbers to a mask.
        """
        high = np.array([w[1] for w in windows])
        low = np.array([w[0] if w[0] <= w[1] else math.inf for w in windows])
        best_ids = [np.empty(0, np.int64) for _ in windows]
        best = [np.empty(0) for _ in windows]
        size = float(q @ q)
        nodes = self.roots
        under, over = self.bounds(nodes, q, size)
        step = OPEN
        while len(nodes):
            # Scores are whole, so half a unit is more than any rounding of a bound.
            inside = ((over[:, None] > low - 0.5) & (under[:, None] < high + 0.5)).any(axis=1)
            nodes, under, over = nodes[inside], under[inside], over[inside]
            if len(nodes) > step:
                ahead = np.argpartition(-over, step)
                now, later = nodes[ahead[:step]], ahead[step:]
                nodes, under, over = nodes[later], under[later], over[later]
            else:
                now, nodes, under, over = nodes, nodes[:0], under[:0], over[:0]
            step *= 2
            leaf = self.leaf[now]
            points = self._ranges(now[leaf])
            if len(points):
                scores = self.points[points] @ q
                fit = fits(points) & (scores >= low.min())
                points, scores = points[fit], scores[fit]
                for w in range(len(windows)):
                    ok = (scores >= low[w]) & (scores <= high[w])
                    if ok.any():
                        ids = np.concatenate([best_ids[w], self.ids[points[ok]]])
                        found = np.concatenate([best[w], scores[ok]])
                        top = np.lexsort((ids, -found))[:k]
                        best_ids[w], best[w] = ids[top], found[top]
                        if len(top) == k:
                            low[w] = best[w][-1]
            children = self._ranges(now[~leaf])
            if len(children):
                lower, upper = self.bounds(children, q, size)
                nodes = np.concatenate([nodes, children])
                under, over = np.concatenate([under, lower]), np.concatenate([over, upper])
        return [list(zip(i.tolist(), s.astype(np.int64).tolist())) for i, s in zip(best_ids, best)]


_TREE_SCHEMA = (
    "piece int, width int, square double, ids binary, labels binary, points binary,"
    " centre binary, radius binary, first binary, last binary, leaf binary"
)
_PARTS = {
    "ids": np.int64,
    "labels": np.int64,
    "points": np.float64,
    "centre": np.int64,
    "radius": np.float64,
    "first": np.int64,
    "last": np.int64,
    "leaf": np.bool_,
}


def _planted(width: int):
    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "label"])
        points = _matrix(rows["v"], width)
        tree = build_tree(rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), points)
        parts = {name: [getattr(tree, name).astype(kind).tobytes()] for name, kind in _PARTS.items()}
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "width": [width], "square": [tree.square], **parts})

    return plant


def _grown(row) -> Tree:
    parts = {name: np.frombuffer(getattr(row, name), kind) for name, kind in _PARTS.items()}
    parts["points"] = parts["points"].reshape(len(parts["ids"]), row.width)
    return Tree(square=row.square, **parts)


def _divided(candidates: DataFrame, width: int, n: int) -> tuple[DataFrame, int]:
    """Candidates with their ``piece``, and the number of pieces.

    At most PIVOTS vectors, the first in the order of a hash, divide the space; a part with more vectors than a tree
    holds is divided further by a hash.
    """
    pivots = min(PIVOTS, -(-n // TREE_POINTS))
    chosen = candidates.orderBy(F.xxhash64("id", "label"), "id", "label", "v").limit(pivots).select("v").collect()
    centres = _matrix([r["v"] for r in chosen], width)
    squares = (centres * centres).sum(axis=1)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = _matrix(batch["v"], width)
            yield batch.assign(part=(squares - 2 * (points @ centres.T)).argmin(axis=1).astype(np.int32))

    dealt = write_table(candidates.mapInPandas(nearest, "id long, label long, v array<bigint>, part int"))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, pieces = [], 0
    for part in range(pivots):
        split = -(-sizes.get(part, 0) // TREE_POINTS)
        starts.append((pieces, max(split, 1)))
        pieces += split
    start = F.array(*(F.lit(s) for s, _ in starts))[F.col("part")]
    split = F.array(*(F.lit(s) for _, s in starts))[F.col("part")]
    piece = start + F.pmod(F.xxhash64(F.lit("piece"), "id", "label"), split.cast("long")).cast("int")
    return dealt.select("id", "label", "v", piece.alias("piece")), pieces


def _searched(trees: DataFrame, pieces: int, queries: DataFrame, n: int, k: int, same: bool) -> DataFrame:
    """The best points of each group of trees for each query: rows (anchor_id, window, id, score).

    ``queries`` has id, label, v and windows, an array of (low, high); ``n`` is their number.
    """
    groups = -(-n // max(QUERIES[0], min(QUERIES[1], -(-n // TASKS))))
    group = F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(groups)).cast("int").alias("group")
    numbers = lambda last: F.explode(F.sequence(F.lit(0), F.lit(last)))
    forests = -(-pieces // TREES)
    asked = queries.select("*", group, numbers(forests - 1).alias("forest"))
    grown = trees.select("*", F.floor(F.col("piece") / TREES).cast("int").alias("forest"), numbers(groups - 1).alias("group"))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            forest = Forest([_grown(r) for r in right.sort_values("piece").itertuples()])
            width = forest.points.shape[1]
            for row in left.itertuples():
                q = _matrix([row.v], width)[0]
                windows = [(w["low"], w["high"]) for w in row.windows]
                if same:
                    fits = lambda p: (forest.labels[p] == row.label) & (forest.ids[p] != row.id)  # noqa: B023, E731
                else:
                    fits = lambda p: forest.labels[p] != row.label  # noqa: B023, E731
                for w, best in enumerate(forest.search(q, windows, k, fits)):
                    found += [(row.id, w, i, s) for i, s in best]
        return pd.DataFrame(found, columns=["anchor_id", "window", "id", "score"])

    by = ["forest", "group"]
    return asked.groupBy(*by).cogroup(grown.groupBy(*by)).applyInPandas(
        search, "anchor_id long, window int, id long, score long"
    )


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key by score (high first) and id, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels in a window below the positive's score.

    ``vectors`` comes from `scaled_vectors`; ``anchors`` is a condition on its columns. An anchor's positives are its
    best ``positives`` other rows of the same label. A negative's score is at least ``low`` and at most ``high`` percent
    of the positive's; the best ``negatives`` are returned, fewer if there are no more. Ties go to the smaller id.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; no rows for an empty table.
    """
    spark = vectors.sparkSession
    rows = write_table(vectors)
    # Of rows that are equal in vector and label, only so many can be in any result.
    copies = max(positives + 1, negatives)
    alike = Window.partitionBy("v", "label").orderBy("id")
    candidates = write_table(
        rows.withColumn("_copy", F.row_number().over(alike)).where(F.col("_copy") <= copies).drop("_copy")
    )
    n, width = candidates.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = rows.where(anchors)
    n_anchors = asked.count()
    if not n_anchors:
        return spark.createDataFrame(
            [],
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        )
    dealt, pieces = _divided(candidates, width, n)
    trees = write_table(dealt.groupBy("piece").applyInPandas(_planted(width), _TREE_SCHEMA))

    everything = F.array(F.struct(F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")))
    near = _searched(trees, pieces, asked.withColumn("windows", everything), n_anchors, positives, same=True)
    near = write_table(_first(near, ["anchor_id"], positives))

    percent = lambda of: ((of - F.pmod(of, F.lit(100))) / 100).cast("double")  # noqa: E731 - floor of a hundredth
    least, most = -percent(-F.col("score") * low), percent(F.col("score") * high)
    window = F.struct("rank", least.alias("low"), most.alias("high"))
    windows = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    asked = asked.join(windows, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "windows")
    best = _searched(trees, pieces, asked, n_anchors, negatives, same=False)
    best = _first(best, ["anchor_id", "window"], negatives)
    positive = near.select(
        F.col("anchor_id").alias("_anchor"),
        (F.col("rank") - 1).alias("_window"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    on = (F.col("anchor_id") == F.col("_anchor")) & (F.col("window") == F.col("_window"))
    return best.join(positive, on).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
