"""Benchmark items in training text: BM25 over an inverted index with block-max bounds, then overlap checks."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?](?=\s)")
K1, B = 1.2, 0.75
#: Items in a block with common score bounds.
BLOCK = 4
#: Items that one index holds at most; further items are searched by further indexes, one after the other.
INDEX_ITEMS = 20_000
#: Words of a part up to which one changed word can take more than 0.4 of its trigrams.
SHORT_PART = 9


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return TOKEN.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item ends with its answer: what follows the last question mark, else the last sentence, else the last half."""
    ends = [m.end() for m in SENTENCE_END.finditer(text) if TOKEN.search(text, m.end()) and TOKEN.search(text[: m.end()])]
    asked = [e for e in ends if text[e - 1] == "?"]
    if ends:
        cut = (asked or ends)[-1]
        return tokens(text[:cut]), tokens(text[cut:])
    words = tokens(text)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def one_edit(part: list[str], passage: list[str]) -> bool:
    """Whether the passage has the part with at most one word changed, left out or put in."""
    n = len(part)
    for start in range(len(passage)):
        same = 0
        while same < n and start + same < len(passage) and passage[start + same] == part[same]:
            same += 1
        at, rest = start + same, n - same
        if rest <= 1:
            return True
        # What follows the first difference must be the rest: changed, left out of the passage, put into it.
        for skip_passage, skip_part in ((1, 1), (0, 1), (1, 0)):
            tail = part[same + skip_part :]
            if same + len(tail) >= n - 1 and passage[at + skip_passage : at + skip_passage + len(tail)] == tail:
                return True
    return False


def overlap(part: list[str], passage: list[str], known: dict[int, set] | None = None) -> float:
    """Share of a part's word trigrams that the passage has (shorter parts: the whole part); 1 for an empty part.

    One changed word takes three trigrams, most of those of a short part. A part of three to nine words that the
    passage has but for one word counts as the share of the words left. ``known`` keeps the passage's grams.
    """
    wanted = grams(part)
    if not wanted:
        return 1.0
    width, known = min(3, len(part)), {} if known is None else known
    if width not in known:
        known[width] = grams(passage, width)
    share = len(wanted & known[width]) / len(wanted)
    if share < 1 and 3 <= len(part) <= SHORT_PART and one_edit(part, passage):
        share = max(share, 1 - 1 / len(part))
    return share


@dataclass
class Index:
    """Postings of terms over items, sorted by item, with scores divided by the item's score for itself."""

    vocabulary: dict[str, int]
    items: list[tuple[object, list[str], list[str]]]  # id, question, answer
    half: int  # tokens of the longest item: any item fits into two neighbouring halves of a passage
    first: np.ndarray  # term -> its first posting
    item: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray  # term -> its first block
    block: np.ndarray
    block_max: np.ndarray
    list_max: np.ndarray


def build_index(rows: list[tuple[object, str]], frequency: dict[str, int], n_items: int, mean_length: float) -> Index:
    """Index of (item_id, text) rows; term frequencies over all items come from outside."""
    postings: dict[str, list[tuple[int, float]]] = {}
    items, longest = [], 1
    for place, (key, text) in enumerate(rows):
        counts = Counter(tokens(text))
        length = sum(counts.values())
        longest = max(longest, length)
        norm = K1 * (1 - B + B * length / mean_length)
        scores = {
            t: math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf * (K1 + 1) / (tf + norm)
            for t, tf in counts.items()
        }
        whole = sum(scores.values())
        for t, s in scores.items():
            postings.setdefault(t, []).append((place, s / whole))
        items.append((key, *question_and_answer(text)))
    vocabulary = {t: i for i, t in enumerate(postings)}
    sizes = [len(p) for p in postings.values()]
    item = np.array([i for p in postings.values() for i, _ in p], dtype=np.int64)
    impact = np.array([s for p in postings.values() for _, s in p])
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(item // BLOCK) != 0)]))
    starts = starts[: len(item)]
    block_max = np.maximum.reduceat(impact, starts) if len(item) else impact
    block_first = np.searchsorted(owner[starts], np.arange(len(sizes) + 1)).astype(np.int64)
    list_max = np.maximum.reduceat(impact, first[:-1]) if len(item) else impact
    return Index(
        vocabulary, items, longest, first, item, impact, block_first, item[starts] // BLOCK, block_max, list_max
    )


def _walk(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the postings of some terms, and for each the place of its term in ``terms``."""
    counts = first[terms + 1] - first[terms]
    owner = np.repeat(np.arange(len(terms)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[terms][owner] + offset, owner


def matches(index: Index, words: list[str], least: float) -> Iterator[tuple[int, float, int]]:
    """(item place, score, passage) of every item that scores at least ``least`` for a passage, in order of passages.

    Passages are windows of two halves, one half apart. The terms of a passage are its query. As in block-max WAND,
    terms whose list bound is so low that a passage full of them stays below half the threshold are not walked; they
    count by their bound. Blocks whose bound stays below the threshold are not scored. Both bounds are never too low,
    so the result is that of scoring every item for every passage.
    """
    known = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    at = np.flatnonzero(known >= 0)
    if not len(at) or not index.items:
        return
    n_terms, n_blocks = len(index.vocabulary), -(-len(index.items) // BLOCK)
    n_halves = -(-len(words) // index.half)
    pairs = np.unique((at // index.half) * n_terms + known[at])  # each term once in a half
    half, term = pairs // n_terms, pairs % n_terms
    low = index.list_max[term] <= least / (4 * index.half)
    bound = np.bincount(half[low], weights=index.list_max[term[low]], minlength=n_halves)
    posting, owner = _walk(index.block_first, term[~low])
    cells = half[~low][owner] * n_blocks + index.block[posting]
    bounds = np.bincount(cells, weights=index.block_max[posting], minlength=n_halves * n_blocks)
    bounds = bounds.reshape(n_halves, n_blocks) + bound[:, None]
    if n_halves > 1:
        bounds = bounds[:-1] + bounds[1:]
    slack = 1e-9
    for passage in np.flatnonzero(bounds.max(axis=1) >= least - slack):
        query = np.unique(term[(half == passage) | (half == passage + 1)])
        posting, _ = _walk(index.first, query)
        posting = posting[bounds[passage][index.item[posting] // BLOCK] >= least - slack]
        scores = np.bincount(index.item[posting], weights=index.impact[posting], minlength=len(index.items))
        for place in np.flatnonzero(scores >= least - slack):
            yield int(place), float(scores[place]), int(passage)


def search(index: Index, words: list[str], least: float) -> dict[int, tuple[float, int]]:
    """Item place -> (best score, passage) of ``matches``; the first of equal ones."""
    found: dict[int, tuple[float, int]] = {}
    for place, score, passage in matches(index, words, least):
        if score > found.get(place, (0.0, 0))[0]:
            found[place] = (score, passage)
    return found


def verified(
    index: Index, words: list[str], least_score: float, least_question: float, least_answer: float
) -> dict[int, tuple[float, float, float]]:
    """Item place -> (score, question overlap, answer overlap) in its best passage of those that have both parts.

    Every passage that reaches the score is checked: BM25 knows no order, so the best one may have the words alone.
    """
    found: dict[int, tuple[float, float, float]] = {}
    at, window, known = -1, [], {}
    for place, score, passage in matches(index, words, least_score):
        if passage != at:
            at, window, known = passage, words[passage * index.half : (passage + 2) * index.half], {}
        _, question, answer = index.items[place]
        if place in found and found[place][0] >= score:
            continue
        a = overlap(answer, window, known)
        if a >= least_answer and (q := overlap(question, window, known)) >= least_question:
            found[place] = (score, q, a)
    return found


def indexes(items: DataFrame) -> list[Index]:
    """The indexes of all items with a token (item_id, text): item counts and term frequencies cover all of them."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    rows = rows.withColumn("terms", F.filter(F.split(F.lower("text"), r"(?U)\W+"), lambda t: t != "")).where(
        F.size("terms") > 0
    )
    total = rows.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean")).first()
    if not total.n:
        return []
    shards = -(-total.n // INDEX_ITEMS)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    held = rows.withColumn("shard", shard)
    frequency = (
        held.select("shard", F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.collect_set("shard").alias("shards"))
    )
    out = []
    for k in range(shards):
        own = held.where(F.col("shard") == k).select("item_id", "text").orderBy("item_id", "text").collect()
        counts = {r.term: r.n for r in frequency.where(F.array_contains("shards", k)).collect()}
        # Python and the SQL pattern may cut rare letters differently; a term that only one of them sees counts once.
        counts = Counter(counts) | Counter({t: 1 for r in own for t in tokens(r.text)})
        out.append(build_index([(r.item_id, r.text) for r in own], counts, total.n, total.mean))
    return out


def leaks(
    text: Column, index: Index, id_type: str, least_score: float = 0.7, least_question: float = 0.6, least_answer: float = 0.6
) -> Column:
    """Array of (item_id, score, question_overlap, answer_overlap) of the items that a text contains.

    BM25 with a passage as the query retrieves every item that reaches ``least_score`` of its score for itself; it is
    contained if one of these passages has enough word trigrams of its question and of its answer.
    """

    @F.pandas_udf(f"array<struct<item_id:{id_type},score:double,question_overlap:double,answer_overlap:double>>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = verified(index, tokens(text), least_score, least_question, least_answer)
            hits = [
                {"item_id": index.items[place][0], "score": score, "question_overlap": q, "answer_overlap": a}
                for place, (score, q, a) in sorted(found.items())
            ]
            out.append(hits)
        return pd.Series(out)

    return find.asNondeterministic()(text)


def contaminated_pairs(docs: DataFrame, items: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): each document with each item that it contains.

    Whole texts are searched, passage by passage, where they are read; only the index travels. Null or empty texts and
    items match nothing; items that are equal as token lists all match. A row that repeats a doc_id gives its own
    pairs. Empty tables give an empty result; other columns are ignored.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    fields = ("item_id", "score", "question_overlap", "answer_overlap")
    parts = [
        docs.select("doc_id", F.explode(leaks(F.col("text"), i, kind, **limits)).alias("x")).select(
            "doc_id", *(f"x.{f}" for f in fields)
        )
        for i in indexes(items)
    ]
    if not parts:
        return docs.select("doc_id", *(F.lit(None).cast(kind if f == "item_id" else "double").alias(f) for f in fields)).where("false")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def clean_documents(docs: DataFrame, items: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    kind = items.schema["item_id"].dataType.simpleString()
    for i in indexes(items):
        docs = (
            docs.withColumn("_leaks", leaks(F.col("text"), i, kind, **limits)).where(F.size("_leaks") == 0).drop("_leaks")
        )
    return docs
