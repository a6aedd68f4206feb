"""Near-duplicate documents by SetSketch registers: band, estimate jointly by likelihood, verify on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import (
    U64,
    WordHashes,
    mix64,
    release_shuffles,
    shingle_hashes,
    write_table,
)

#: Base of the register scale, the register of a minimum of 1, and the largest register.
BASE, OFFSET, LARGEST = 1.1, 30, 255
#: Elements that one round of vector work takes at most, but for a longer single text.
CHUNK = 1_500_000
#: Nodes of a bucket that may form pairs one by one, and nodes in a block of a larger family.
FEW, BLOCK = 24, 400
#: Parts of the documents whose texts are shuffled one after the other.
SLICES = 4


# ---- sketches -------------------------------------------------------------------------------------------------------


def text_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z in lower case; empty without words."""
    return np.unique(shingle_hashes(hashes.of_text(text or ""), width))


def set_key(members: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SetSketch registers (one row of ``m`` for each non-empty set).

    Each element emits points at exponentially spaced times with overall rate m, each to a register that its hash
    picks; a register keeps its earliest time, which for n elements is exponential with rate n. Times after a bound
    that depends on n cannot be minima if every register already has an earlier one, so an element stops there; the
    few sets with an open register go on to a larger bound. The stored value is floor(offset - log_b(minimum)),
    truncated to one byte: larger for earlier times, so the sketch of a union is the register-wise maximum.
    """
    out = np.full((len(sets), m), np.inf)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    todo, slack = np.flatnonzero(sizes), 3.0
    while len(todo):
        flat = out.reshape(-1)
        state = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, sizes[todo])
        bound = ((np.log(m) + slack) / sizes)[owner]
        time = np.zeros(len(state))
        with np.errstate(over="ignore"):
            while len(state):
                state = mix64(state + U64(0x9E3779B97F4A7C15))
                time = time - np.log(((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
                on = time <= bound
                state, owner, bound, time = state[on], owner[on], bound[on], time[on]
                place = (mix64(state ^ U64(0xD1B54A32D192ED03)) % U64(m)).astype(np.int64)
                np.minimum.at(flat, owner * m + place, time)
        todo, slack = todo[np.isinf(out[todo]).any(axis=1)], slack * 4
    with np.errstate(divide="ignore"):
        values = np.floor(OFFSET - np.log(out) / np.log(BASE))
    return np.clip(values, 0, LARGEST).astype(np.uint8)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 128) -> np.ndarray:
    """Jaccard similarity with the largest likelihood, for rows of registers of sets of known size.

    Given sizes in the ratio u : v (u + v = 1) a register of the first set is the larger one with probability
    p(u - vJ), of the second with p(v - uJ), where p(x) = -log_b(1 - x (b - 1) / b); ties have the rest.
    """
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, grid)[None, :]
    p = lambda x: np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    pa, pb = p(u - v * j), p(v - u * j)
    likelihood = above * np.log(pa) + below * np.log(pb) + same * np.log(np.clip(1 - pa - pb, 1e-9, 1))
    return np.take_along_axis(j, likelihood.argmax(axis=1)[:, None], 1)[:, 0]


def sketch_documents(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, node, sketch): node names the set, null if it is empty."""
    m = bands * rows

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            ids, texts, at = frame["doc_id"], frame["text"], 0
            while at < len(frame):
                sets, load = [], 0
                while at + len(sets) < len(frame) and (not sets or load < CHUNK):
                    sets.append(text_set(texts.iat[at + len(sets)], width, hashes))
                    load += len(sets[-1])
                values = registers(sets, m)
                yield pd.DataFrame(
                    {
                        "doc_id": ids.iloc[at : at + len(sets)].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "node": [set_key(s) if len(s) else None for s in sets],
                        "sketch": [v.tobytes() if len(s) else None for s, v in zip(sets, values, strict=True)],
                    }
                )
                at += len(sets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        sketch, f"doc_id {kind}, n_shingles long, node binary, sketch binary"
    )


# ---- candidate pairs ------------------------------------------------------------------------------------------------


def _estimated(pairs: DataFrame, m: int, least: float) -> DataFrame:
    """Pairs (a, b, sa, sb, na, nb) whose joint estimate reaches ``least``."""

    @F.pandas_udf("double")
    def estimate(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = np.empty(len(sa))
        for at in range(0, len(sa), 4000):
            part = slice(at, at + 4000)
            x, y = (np.frombuffer(b"".join(s.iloc[part]), np.uint8).reshape(-1, m) for s in (sa, sb))
            out[part] = joint_estimate(
                x, y, na.iloc[part].to_numpy(dtype=float), nb.iloc[part].to_numpy(dtype=float)
            )
        return pd.Series(out)

    return pairs.where(estimate("sa", "sb", "na", "nb") >= least).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs whose full sets reach the threshold: denominator x intersection >= numerator x union."""
    over, under = threshold

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        held_node, held = None, None
        for nodes, ones, others in batches:
            out = []
            for node, one, other in zip(nodes, ones, others, strict=True):
                if node != held_node:  # rows come sorted by this end of the pair
                    held_node, held = node, text_set(other, width, hashes)
                mine = text_set(one, width, hashes)
                both = len(np.intersect1d(mine, held, assume_unique=True))
                out.append(bool(under * both >= over * (len(mine) + len(held) - both)))
            yield pd.Series(out)

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").where(linked("b", "ta", "tb")).select("a", "b")


# ---- components -----------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected edges (a, b): label is the smallest node that is reachable.

    Every round points each node at its smallest neighbour, if that is smaller, follows the pointers to their ends, and
    goes on with the edges between different ends, once each. An end is smaller than all its neighbours, so the nodes that
    are left drop fast, and no edge is read again once its nodes are joined. The smallest node of a component always stays.
    """
    rounds = []
    while True:
        both = write_table(
            edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        )
        ends = _pointer_ends(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
        rounds.append(ends)
        half = both.where("a < b").join(ends.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a")
        half = half.join(ends.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b").where("_a != _b")
        edges = write_table(half.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        if edges.isEmpty():
            break
    labels = rounds.pop()
    while rounds:  # the ends of a round are the nodes of the next one
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = rounds.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
        labels = write_table(labels)
    return labels


def _pointer_ends(pointers: DataFrame) -> DataFrame:
    """(node, label) with each pointer followed to its end, twice as far every time."""
    pointers = write_table(pointers)
    while True:
        ahead = pointers.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = write_table(pointers.join(ahead, "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")))
        pointers = step.select("node", "label")
        if step.where("old != label").isEmpty():
            return pointers


# ---- the operator ---------------------------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (80, 100),
    bands: int | None = None,
    rows: int | None = None,
    margin: float = 0.12,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): classes of documents that links of similar shingle sets connect.

    Documents with the same set are one node, so copies never form pairs. Nodes that share the register values of a
    band share a bucket. First every node is compared with the pivot of its buckets, the node with the most collisions,
    which in a family of copies is the original: pairs pass the joint likelihood estimate (less ``margin``) and then the
    exact test on full sets. What is left are buckets with nodes of two or more classes. Nodes leave that share too few
    shingles with all the others there to link with any. Buckets of up to FEW nodes form the pairs that could share
    enough, to be estimated and tested alike. Larger ones are families of similar texts: a family is dealt into blocks
    of about BLOCK nodes and each pair of blocks is compared exactly inside one task, which returns at most one link for
    each node. So every pair that shares a bucket and could join two classes is tested; a pair at the
    threshold shares none with a probability below 4e-6. The cost of a family of k texts that resemble each other but
    mostly don't link grows as k x k / BLOCK rows; linked families and copies cost one comparison for each node.

    36 bands of 7 registers from a threshold of 0.85 on, else 42 bands of 6. Links need ``denominator x intersection >=
    numerator x union``. Fewer words than ``width`` make one shingle of the whole sequence. Null texts and texts without words have
    no shingles and link with nothing; null doc_ids keep a null component_id and are kept. Rows that repeat a doc_id
    are classified by their own text. component_id is the smallest doc_id of the class; kept is doc_id = component_id.
    """
    over, under = threshold
    strict = over / under >= 0.85
    rows, bands = rows or (7 if strict else 6), bands or (36 if strict else 42)
    m = bands * rows
    sketched = write_table(sketch_documents(docs, width, bands, rows))
    nodes = sketched.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    nodes = write_table(nodes)
    every = F.sequence(F.lit(0), F.lit(bands - 1))
    banded = nodes.select(
        "node",
        F.explode(
            F.transform(
                every, lambda i: F.xxhash64(i, F.substring("sketch", i * rows + 1, F.lit(rows)))
            )
        ).alias("bucket"),
    )
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    colliding = write_table(banded.join(shared, "bucket").select("bucket", "node", "size"))
    del banded, shared
    release_shuffles(docs.sparkSession)
    # From the written table: to band all nodes again for the degrees would double the disk.
    degree = write_table(colliding.groupBy("node").agg(F.sum("size").alias("degree")))
    known = write_table(nodes.join(degree, "node"))
    sized = write_table(colliding.select("bucket", "node").join(known.select("node", "n", "degree"), "node"))
    sketches = known.select("node", "n", "sketch")
    ids = known.select(F.col("doc_id").alias("_id"), "node")
    del degree, known
    release_shuffles(docs.sparkSession)
    texts = _node_texts(docs, ids, width)
    side = lambda to: sketches.select(
        F.col("node").alias(to), F.col("n").alias(f"n{to}"), F.col("sketch").alias(f"s{to}")
    )

    def test(pairs: DataFrame) -> DataFrame:
        near = _estimated(pairs.join(side("a"), "a").join(side("b"), "b"), m, over / under - margin)
        return write_table(_verified(near, texts, width, threshold))

    pivots = sized.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("p"))
    fits = under * F.least("n", "p.n") >= over * F.greatest("n", "p.n")
    links = _one_link_each(
        test(
            sized.join(pivots, "bucket")
            .where((F.col("node") != F.col("p.node")) & fits)
            .select(F.col("node").alias("a"), F.col("p.node").alias("b"))
            .distinct()
        )
    )
    labels = components(links)
    release_shuffles(docs.sparkSession)

    left = sized.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = write_table(_undecided(left))
    common = _common_sizes(texts, left, width).where(under * F.col("common") >= over * F.col("n"))
    left = write_table(_undecided(left.join(common.select("node", "common"), "node")))
    if not left.isEmpty():
        crowded = left.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("hub"))
        crowded = crowded.where(F.col("size") > FEW)
        to_hubs = left.join(crowded, "bucket").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        families = components(_one_link_each(to_hubs)).withColumnRenamed("label", "family")
        families = write_table(families)
        known_labels = left.select("node", "label").distinct()
        within = write_table(_family_links(families.join(known_labels, "node"), texts, width, threshold))
        sparse = left.join(crowded.select("bucket"), "bucket", "left_anti").join(families, "node", "left")
        names = ("node", "label", "n", "common", "family")
        one = sparse.select("bucket", *(F.col(c).alias(f"a_{c}") for c in names))
        other = sparse.select("bucket", *(F.col(c).alias(f"b_{c}") for c in names))
        most = F.least("a_common", "b_common")
        across = (
            one.join(other, "bucket")
            .where(
                (F.col("a_node") < F.col("b_node"))
                & (F.col("a_label") != F.col("b_label"))
                & (under * most >= over * (F.col("a_n") + F.col("b_n") - most))
                & ~F.coalesce(F.col("a_family") == F.col("b_family"), F.lit(False))
            )
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
            .distinct()
        )
        more = within.unionByName(test(across))
        if not more.isEmpty():
            labels = _joined_classes(labels, more)
    release_shuffles(docs.sparkSession)
    classes = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = classes.join(smallest, "label").select("node", "component_id")
    return (
        sketched.join(by_node, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def _joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links (a, b): only the classes at the ends of these are joined; a node without one is its own."""
    ends = write_table(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    known = labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    of_ends = write_table(known.join(ends, "node", "left_semi"))
    between = links.join(of_ends.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a")
    between = between.join(of_ends.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b")
    classes = components(between.where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    classes = classes.select(F.col("node").alias("label"), F.col("label").alias("joined"))
    return known.join(classes, "label", "left").select("node", F.coalesce("joined", "label").alias("label"))


def _one_link_each(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes: each node keeps one pivot, and its other pivots are linked with that one.

    A node has a pivot for each band at most, and the nodes of a family share few pivots, so about one link for each node
    is left.
    """
    own = links.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("pivots"))
    first = F.element_at("pivots", 1)
    others = F.transform(F.slice("pivots", 2, F.size("pivots")), lambda p: F.struct(first.alias("a"), p.alias("b")))
    edges = F.concat(F.array(F.struct(F.col("a"), first.alias("b"))), others)
    return write_table(own.select(F.explode(edges).alias("e")).select("e.a", "e.b").distinct())


def _undecided(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold nodes of two or more classes."""
    split = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    return rows.join(split.select("bucket"), "bucket", "left_semi")


def _common_sizes(texts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, common): how many shingles of each node in ``rows`` some other of these nodes has, too."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            for node, text in zip(frame["node"], frame["text"], strict=True):
                members = text_set(text, width, hashes)
                yield pd.DataFrame({"shingle": members.view(np.int64), "node": [node] * len(members)})

    nodes = rows.select("node", "n").distinct()
    shingles = texts.join(nodes, "node", "left_semi").mapInPandas(spread, "shingle long, node binary")
    own = (
        shingles.groupBy("shingle")
        .agg(F.count("*").alias("owners"), F.first("node").alias("node"))
        .where("owners = 1")
        .groupBy("node")
        .agg(F.count("*").alias("own"))
    )
    return nodes.join(own, "node", "left").select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def _intersections(sets: list[np.ndarray], others: list[np.ndarray], step: int = 16_384) -> np.ndarray:
    """Sizes of the intersections of all sets with all others, by products of 0/1 matrices over their shingles."""
    flat = np.concatenate([*sets, *others])
    shingle, column = np.unique(flat, return_inverse=True)
    shared = np.bincount(column) > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in (*sets, *others)])
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    out = np.zeros((len(sets), len(others)), np.float32)
    for at in range(0, int(shared.sum()), step):
        on = (column >= at) & (column < at + step)
        has = np.zeros((len(sets) + len(others), step), np.float32)
        has[owner[on], column[on] - at] = 1
        out += has[: len(sets)] @ has[len(sets) :].T
    return out


def _family_links(families: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join the classes of a family (node, family, label), from exact comparisons of its blocks."""
    over, under = threshold

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        frame = frame.sort_values("node", ignore_index=True)
        sets = [text_set(t, width, hashes) for t in frame["text"]]
        rows, columns = (np.flatnonzero(frame["block"] == frame[k].iat[0]) for k in ("i", "j"))
        sizes = np.array([len(s) for s in sets])
        both = _intersections([sets[r] for r in rows], [sets[c] for c in columns])
        union = sizes[rows][:, None] + sizes[columns][None, :] - both
        head = {x: x for x in frame["label"]}

        def find(x: bytes) -> bytes:
            while head[x] != x:
                head[x] = x = head[head[x]]
            return x

        found = []
        for r, c in np.argwhere(under * both >= over * union):
            a, b = rows[r], columns[c]
            one, other = find(frame["label"][a]), find(frame["label"][b])
            if one != other:
                head[one] = other
                found.append((frame["node"][a], frame["node"][b]))
        return pd.DataFrame(found, columns=["a", "b"])

    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.select("*", every.alias("with")).select(
        "family", "node", "label", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")
    )
    return (
        pairs.join(texts, "node").groupBy("family", "i", "j").applyInPandas(compare, "a binary, b binary")
    )


def _node_texts(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, text): one text for each node of ``ids`` (_id, node), found by its doc_id and confirmed by its set.

    The nodes are dealt into SLICES by a hash of the doc_id and found one slice after the other, so that the texts of one
    slice of the documents only lie in shuffle files at any time.
    """

    @F.pandas_udf("binary")
    def name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([set_key(text_set(t, width, hashes)) for t in texts])

    name = name.asNondeterministic()  # else the planner names every text to join on the names
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(SLICES))
    parts = []
    for k in range(SLICES):
        some, own = docs.select("doc_id", "text").where(deal("doc_id") == k), ids.where(deal("_id") == k)
        found = some.join(own, F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
        parts.append(write_table(found.where(name("text") == F.col("node")).dropDuplicates(["node"])))
        del some, own, found
        release_shuffles(docs.sparkSession)
    # One scan of all folders: a union would be planned anew for each part by every reader.
    folders = sorted({unquote(f.rsplit("/", 1)[0]) for part in parts for f in part.inputFiles()})
    return docs.sparkSession.read.schema(parts[0].schema).parquet(*folders) if folders else parts[0]
