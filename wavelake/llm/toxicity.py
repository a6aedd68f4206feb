"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.fitting import bounded_sample, fit_in_task, isotonic, labelled_texts, sigmoid

WORD = re.compile(r"[^ \t-\r]+")
#: Labelled documents that the model is fitted on at most.
SAMPLE_ROWS = 6000
#: Learned words and word parts in the lexicons at most.
LEXICON = 400
PART = 5
NEAR = 5
SCHEMA = "score double, predicted int"

# Plain insults, pronouns of the second person in the four languages of the corpus, letter disguises.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting".split()
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros os".split()
)
DISGUISES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = (
    "insult density", "insults", "learned density", "learned words", "part density", "parts", "most in 20 words",
    "second person density", "insults near second person", "capital letters", "words in capitals",
    "exclamation marks", "question marks", "punctuation", "disguised words", "stretched words", "words",
)

# Bits of a word.
INSULT, LEARNED, PARTS, SECOND, CAPITALS, DISGUISED, STRETCHED = (1 << k for k in range(7))
STRETCH = re.compile(r"([^\W\d_])\1\1")
MIXED = re.compile(r"[^\W\d_][\d@$!*|]+[^\W\d_]")


def core(word: str) -> str:
    """A word in lower case without what isn't a letter or digit at its ends."""
    return word.lower().strip("\"'`.,;:!?()[]{}<>*#%&$|-_/\\…“”«»¡¿")


def parts(word: str) -> list[str]:
    """Every run of PART letters in a word."""
    return [word[i : i + PART] for i in range(len(word) - PART + 1)]


@dataclass
class Lexicons:
    learned: frozenset[str] = frozenset()
    parts: frozenset[str] = frozenset()

    def bits(self, word: str) -> int:
        plain = core(word)
        simple = plain.isalpha() or not MIXED.search(word)
        undone = plain if simple else core(word.translate(DISGUISES))
        out = 0
        if plain in _INSULTS or undone in _INSULTS:
            out |= INSULT
        if plain in self.learned or undone in self.learned:
            out |= LEARNED
        if len(plain) >= PART and not self.parts.isdisjoint(parts(plain)):
            out |= PARTS
        if plain in SECOND_PERSON:
            out |= SECOND
        if len(plain) > 1 and word.isupper():
            out |= CAPITALS
        if undone != plain:
            out |= DISGUISED
        if STRETCH.search(plain):
            out |= STRETCHED
        return out


_INSULTS = frozenset(INSULTS)


class WordBits(dict):
    """Word to its bits; forgets everything when full, which changes no value."""

    def __init__(self, lexicons: Lexicons, limit: int = 300_000):
        super().__init__()
        self.lexicons, self.limit = lexicons, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.lexicons.bits(word)
        return value


def dense_features(text: str, bits: WordBits) -> list[float]:
    """The values of FEATURES for a text; rates are by word or by character."""
    words = WORD.findall(text)
    n, size = max(1, len(words)), max(1, len(text))
    found = np.fromiter(map(bits.__getitem__, words), np.int64, len(words))
    insult, learned, part, second = ((found & b) != 0 for b in (INSULT, LEARNED, PARTS, SECOND))
    bad = insult | learned
    places, near, most = np.flatnonzero(bad | part), 0, 0
    if len(places):
        most = int((np.searchsorted(places, places + 20) - np.arange(len(places))).max())
    if bad.any() and second.any():
        spoken = np.flatnonzero(second)
        hits = np.flatnonzero(bad)
        right = np.minimum(np.searchsorted(spoken, hits), len(spoken) - 1)
        left = np.maximum(right - 1, 0)
        near = int((np.minimum(np.abs(spoken[right] - hits), np.abs(spoken[left] - hits)) <= NEAR).sum())
    count = lambda b: int(((found & b) != 0).sum())
    capitals = sum(map(len, _CAPITALS.findall(text)))
    marks, asks = text.count("!"), text.count("?")
    punctuation = marks + asks + sum(map(text.count, ".,;:"))
    return [
        insult.sum() / n, math.log1p(insult.sum()), learned.sum() / n, math.log1p(learned.sum()), part.sum() / n,
        math.log1p(part.sum()), most, second.sum() / n, near, capitals / size, count(CAPITALS) / n, marks / n,
        asks / n, punctuation / size, count(DISGUISED) / n, count(STRETCHED) / n, math.log1p(len(words)),
    ]


_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def learn_lexicons(texts: list[str], labels: np.ndarray) -> Lexicons:
    """Words and word parts that occur in at least three toxic texts (four of fewer than a hundred) and at ten times the
    rate of other texts."""
    toxic, other = labels > 0, labels <= 0
    found = []
    for split in (lambda w: [w], parts):
        seen = {True: Counter(), False: Counter()}
        for text, label in zip(texts, toxic, strict=True):
            words = {core(w) for w in WORD.findall(text)} - {""}
            seen[bool(label)].update({p for w in words for p in split(w)})
        ratio = lambda e: ((seen[True][e] + 0.5) / (toxic.sum() + 1)) / ((seen[False][e] + 0.5) / (other.sum() + 1))
        least = 3 if toxic.sum() >= 100 else 4
        good = [e for e, n in seen[True].items() if n >= least and ratio(e) >= 10]
        good.sort(key=lambda e: (-math.log(ratio(e)) * math.sqrt(seen[True][e]), e))
        found.append(frozenset(good[:LEXICON]))
    return Lexicons(*found)


@dataclass
class Boosting:
    """Regression trees of a fixed depth on the log odds: node k of a tree splits to 2k + 1 and 2k + 2."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    depth: int = 3

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            z += leaf[node - (2**self.depth - 1)]
        return z


def boost(x: np.ndarray, y: np.ndarray, trees: int = 120, rate: float = 0.15, bins: int = 32, ridge: float = 2.0) -> Boosting:
    """Newton boosting of the logistic loss on binned features."""
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Boosting(math.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = max(len(e) for e in edges) + 1
    inner = 2**model.depth - 1
    z = np.full(len(y), model.base)
    for _ in range(trees):
        p = sigmoid(z)
        g, h = p - y, p * (1 - p) + 1e-6
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(model.depth):
            start, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                key = (node - start) * width + binned[:, f]
                gs = np.bincount(key, weights=g, minlength=n * width).reshape(n, width).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=n * width).reshape(n, width).cumsum(axis=1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = (
                    gs**2 / (hs + ridge)
                    + (total_g - gs) ** 2 / (total_h - hs + ridge)
                    - total_g**2 / (total_h + ridge)
                )[:, : len(edge)]
                gain[(hs[:, : len(edge)] < 1) | ((total_h - hs)[:, : len(edge)] < 1)] = 0
                cut = gain.argmax(axis=1)
                value = gain[np.arange(n), cut]
                won = value > best
                best[won] = value[won]
                feature[start : start + n][won] = f
                limit[start : start + n][won] = edge[cut[won]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        place = node - inner
        leaf = -rate * np.bincount(place, weights=g, minlength=inner + 1) / (
            np.bincount(place, weights=h, minlength=inner + 1) + ridge
        )
        z += leaf[place]
        model.feature.append(feature)
        model.limit.append(limit)
        model.leaf.append(leaf)
    return model


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    trees: Boosting
    knots: np.ndarray
    heights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability for rows of features."""
        return np.interp(self.trees.margin(x), self.knots, self.heights) if len(x) else np.zeros(0)


def fit_rows(rows: pd.DataFrame) -> ToxicityModel | None:
    """Lexicons from one part of the rows, trees from a second, calibration from a third; None for one class.

    With under 100 rows of a class the trees and the calibration share their rows, with under 30 all steps do.
    """
    y = rows["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return None
    texts = rows["text"].fillna("").tolist()
    part = np.arange(len(y)) % 5
    least = min((y > 0).sum(), (y <= 0).sum())
    lexicon_on, trees_on, scale_on = part < 2, (part == 2) | (part == 3), part == 4
    if least < 100:
        trees_on = scale_on = part >= 2
    if least < 30:
        lexicon_on = trees_on = scale_on = part >= 0
    lexicons = learn_lexicons([t for t, on in zip(texts, lexicon_on, strict=True) if on], y[lexicon_on])
    bits = WordBits(lexicons)
    x = np.array([dense_features(t, bits) for t in texts])
    trees = boost(x[trees_on], y[trees_on])
    knots, heights = isotonic(trees.margin(x[scale_on]), y[scale_on])
    return ToxicityModel(lexicons, trees, knots, heights)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel | None:
    """Fits on at most ``sample_rows`` documents with a label of toxicity, in one task."""
    sample = bounded_sample(labels.select("doc_id", F.col("toxic").alias("label")), sample_rows, "toxicity")
    return fit_in_task(labelled_texts(docs, sample), fit_rows)


def judge_toxicity(text: Column, model: ToxicityModel | None) -> Column:
    """Struct of SCHEMA for a text: probability of being toxic, and 1 if it is at least one half.

    Whole texts count, null ones as empty. Without a model (no labels, or of one class only) every score is 0.
    """

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bits = WordBits(model.lexicons) if model else None
        for texts in batches:
            score = np.zeros(len(texts))
            if model and len(texts):
                score = model.score(np.array([dense_features(t or "", bits) for t in texts]))
            yield pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return judge.asNondeterministic()(text)


def score_documents(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, score, predicted) for every row; other columns are ignored. Empty tables give empty results."""
    return docs.select("doc_id", judge_toxicity(F.col("text"), model).alias("t")).select("doc_id", "t.*")
