"""Quality rules: fixed counts, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import U64, WORDS, WordHashes, shingle_hashes, text_udf
from wavelake.llm.fitting import bounded_sample, fit_in_task, labelled_texts, platt_scale, sigmoid

#: Features are hashed into so many buckets.
BUCKETS = 1 << 16
#: Longest n-grams of characters and of words.
CHARACTERS, WORD_RUNS = 4, 2
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Labelled documents that the model is fitted on at most.
SAMPLE_ROWS = 2000
#: Texts whose calibrated probability of good quality is below this are rejected.
LEAST_GOOD = 0.3

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, good double, kept boolean"
)


def repeated_words(windows: np.ndarray, n_words: int) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    covered = np.zeros(n_words, dtype=bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(lines) - len(set(lines))


def features(text: str, words: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of a text, one array for each order of characters, then of words, that it has."""
    places = []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, min(CHARACTERS, len(codes)) + 1):
            h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            places.append(h & np.uint32(BUCKETS - 1))
        for n in range(1, min(WORD_RUNS, len(words)) + 1):
            places.append((shingle_hashes(words, n) >> U64(48)).astype(np.uint32) & np.uint32(BUCKETS - 1))
    return places


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    scale: tuple[float, float]

    def good(self, text: str, words: np.ndarray) -> float:
        """Calibrated probability that a text is of good quality; each order of n-grams weighs by its mean."""
        z = self.bias + sum(float(self.weights[p].mean()) for p in features(text, words))
        a, b = self.scale
        return float(sigmoid(np.array(a * z + b)))


def fit_rows(rows: pd.DataFrame, rounds: int = 80, rate: float = 0.5, decay: float = 1e-5) -> QualityModel | None:
    """Logistic regression by Adam steps on two thirds of the rows, calibrated on the other third; None for one class."""
    if rows["label"].nunique() < 2:
        return None
    hashes = WordHashes()
    columns, values, owners = [], [], []
    for i, text in enumerate(rows["text"].fillna("")):
        total = np.zeros(BUCKETS)
        for p in features(text, hashes.of(WORDS.findall(text))):
            total += np.bincount(p, minlength=BUCKETS) / len(p)
        column = np.flatnonzero(total)
        columns.append(column.astype(np.int32))
        values.append(total[column].astype(np.float32))
        owners.append(np.full(len(column), i, np.int32))
    column, value, owner = np.concatenate(columns), np.concatenate(values), np.concatenate(owners)
    y = rows["label"].to_numpy(dtype=float)
    held = np.arange(len(y)) % 3 == 2
    if min(len(set(y[held])), len(set(y[~held]))) < 2:
        held[:] = False
    fit_on = (~held).astype(float)
    balance = np.where(y > 0, 0.5 / max(1, (y * fit_on).sum()), 0.5 / max(1, ((1 - y) * fit_on).sum())) * fit_on
    w, b = np.zeros(BUCKETS), 0.0
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    score = lambda: np.bincount(owner, weights=w[column] * value, minlength=len(y)) + b
    for t in range(1, rounds + 1):
        gap = (sigmoid(score()) - y) * balance
        g = np.append(np.bincount(column, weights=gap[owner] * value, minlength=BUCKETS) + decay * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    z = score()
    on = held if held.any() else ~held
    return QualityModel(w.astype(np.float32), float(b), platt_scale(z[on], y[on]))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """Fits on at most ``sample_rows`` documents with a quality label, in one task."""
    sample = bounded_sample(labels.select("doc_id", F.col("quality").alias("label")), sample_rows, "quality")
    return fit_in_task(labelled_texts(docs, sample), fit_rows)


def judge_quality(text: Column, model: QualityModel | None, least_good: float = LEAST_GOOD) -> Column:
    """Struct of SCHEMA for a text: the counts, the two fixed rules, the probability and the verdict.

    A text fails the fixed rules with fewer than 50 words or with more than half of its words in repeated windows; it
    is kept if it passes them and its probability reaches ``least_good``. A null text counts as empty and fails.
    Without a model (no labels, or of one class only) the fixed rules decide alone and ``good`` is null. Each text is
    judged whole, in Arrow batches, where it is read.
    """

    def make():
        hashes = WordHashes()

        def one(text):
            text = text or ""
            words = WORDS.findall(text)
            codes = hashes.of(words)
            n = len(words)
            repeats = repeated_words(shingle_hashes(codes, 3), n) if n >= 4 else 0
            failed = n < LEAST_WORDS or 100 * repeats > 50 * n
            good = model.good(text, codes) if model else None
            return (
                n,
                sum(map(len, words)),
                sum(map(text.count, SYMBOLS)),
                repeated_lines(text),
                repeats,
                failed,
                good,
                not failed and (good is None or good >= least_good),
            )

        return one

    return text_udf(make, SCHEMA)(text)


def score_documents(docs: DataFrame, model: QualityModel | None, least_good: float = LEAST_GOOD) -> DataFrame:
    """(doc_id, the columns of SCHEMA) for every row; other columns are ignored. Empty tables give empty results."""
    return docs.select("doc_id", judge_quality(F.col("text"), model, least_good).alias("q")).select("doc_id", "q.*")
