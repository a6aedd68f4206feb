"""Language by word-first backoff: known words by log frequency, others by progressively shorter n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import text_udf
from wavelake.llm.fitting import bounded_sample, fit_in_task, labelled_texts

LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"\w+")
#: Labelled documents that the model is fitted on at most.
SAMPLE_ROWS = 4000
#: Words and n-grams in a model at most, the most frequent ones; each must occur twice.
MODEL_WORDS, MODEL_GRAMS = 60_000, 40_000
LONGEST = 5
UNKNOWN = "und"

Row = tuple[float, ...]
SCHEMA = "lang_pred string, score double"


def padded_grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a mark at each end."""
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, Row]  # log frequency of a word in each language
    grams: list[dict[str, Row]]  # the same for character n-grams, longest first

    def word(self, word: str) -> Row:
        """Scores of a word: its own log frequencies, or the mean over its n-grams of the longest order it knows."""
        known = self.words.get(word)
        if known is not None:
            return known
        for n, table in zip(range(LONGEST, 0, -1), self.grams, strict=True):
            found = [row for row in map(table.get, padded_grams(word, n)) if row]
            if found:
                n_found = len(found)
                return tuple([s / n_found for s in map(sum, zip(*found))])  # noqa: B905
        return (0.0,) * len(self.languages)


def _table(counts: dict[str, Counter], languages: list[str], most: int, smoothing: float) -> dict[str, Row]:
    """Centred log frequencies by language of the entries that occur twice or more."""
    total = Counter()
    for language in languages:
        total.update(counts[language])
    kept = sorted((e for e, n in total.items() if n > 1), key=lambda e: (-total[e], e))[:most]
    sizes = np.array([sum(counts[g].values()) + smoothing * (len(total) + 1) for g in languages])
    out = {}
    for entry in kept:
        row = np.log((np.array([counts[g][entry] for g in languages]) + smoothing) / sizes)
        out[entry] = tuple((row - row.mean()).tolist())
    return out


def fit_rows(rows: pd.DataFrame, smoothing: float = 0.2) -> LanguageModel:
    """Counts words and n-grams of each language; n-grams count once per distinct word of a language."""
    words: dict[str, Counter] = defaultdict(Counter)
    for text, language in zip(rows["text"], rows["label"], strict=True):
        if text:
            words[language].update(WORD.findall(text.lower()))
    languages = sorted(words)
    grams = []
    for n in range(LONGEST, 0, -1):
        counts: dict[str, Counter] = defaultdict(Counter)
        for language in languages:
            for word in words[language]:
                counts[language].update(padded_grams(word, n))
        grams.append(_table(counts, languages, MODEL_GRAMS, smoothing))
    return LanguageModel(languages, _table(words, languages, MODEL_WORDS, smoothing), grams)


def fit_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on at most ``sample_rows`` of the given documents that have a language, in one task."""
    labels = docs.select("doc_id", F.col("lang").alias("label"))
    return fit_in_task(labelled_texts(docs, bounded_sample(labels, sample_rows, "language")), fit_rows)


def predict_language(text: Column, model: LanguageModel) -> Column:
    """Struct of SCHEMA for a text: the language whose words fit best, and its posterior share.

    Every word of the whole text counts, by the scores of ``LanguageModel.word``; the sum is divided by the square root
    of the number of words, so that the share grows with the evidence but words need not be independent. Ties go to
    the language that sorts first. A null text, or one without a letter, is ``und`` with score 0, as is every text
    if no language was learned.
    """

    def make():
        languages, width = model.languages, len(model.languages)
        limit = 300_000
        memo: dict[str, int] = {}
        scores = np.zeros((limit, max(1, width)), np.float32)

        class Places(dict):
            """Word to row of ``scores``; forgets everything when full, which changes no value."""

            def __missing__(self, word):
                place = self[word] = len(self)
                scores[place] = model.word(word)
                return place

        memo = Places()

        def one(text):
            if not text or not width or not LETTER.search(text):
                return UNKNOWN, 0.0
            words = WORD.findall(text.lower())
            total, at = np.zeros(width), 0
            while at < len(words):
                if len(memo) >= limit // 2:
                    memo.clear()
                part = words[at : at + limit // 2]
                places = np.fromiter(map(memo.__getitem__, part), np.int64, len(part))
                total += scores[places].sum(axis=0, dtype=np.float64)
                at += len(part)
            z = total / math.sqrt(len(words))
            share = np.exp(z - z.max())
            best = int(share.argmax())
            return languages[best], float(share[best] / share.sum())

        return one

    return text_udf(make, SCHEMA)(text)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; other columns are ignored. Empty tables give empty results."""
    return docs.select("doc_id", predict_language(F.col("text"), model).alias("p")).select("doc_id", "p.*")
