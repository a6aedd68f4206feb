"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of all n-grams of the training texts are rounded down to levels that grow by a ratio, and an n-gram of level L is
entered L times, as (n-gram, 1) to (n-gram, L). Its level is read back by repeated membership probes: the first level
that is not found ends them, so a false hit adds one level at most with a small probability. Probabilities are
interpolated: p(w | h) = (c(hw) + mu * p(w | shorter h)) / (c(h) + mu). Counts of n-grams are taken at the low end of their
level and those of histories at the high end, so the probabilities after a history never sum to more than one.

The filter is cut into segments by the hash of the n-gram; one shuffle brings the counts of a segment together, and the
task that has added them up fills it. The filter is broadcast while all segments stay within a bound; beyond it, the
n-grams of the texts travel to the segments instead, with the same result. Whatever travels is sorted and packed: a
n-gram takes about six bytes on its way to its segment, and less than one on its way back.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import U64, mix64, release_shuffles, shingle_hashes, write_table

ORDER = 2
#: Levels of counts: each begins at RATIO times the one before, or one higher.
RATIO = 1.1
#: Bits of the filter for each entry; bytes of text for each segment; bytes of a filter that is broadcast at most.
BITS = 10
SEGMENT_TEXT = 4 << 20
BROADCAST = 128 << 20
#: Words with at least a share of one in HEAVY of all training tokens are broadcast, so they are HEAVY at most.
HEAVY = 1 << 20
#: Tokens worked on together in a task, and tokens whose n-grams leave it together; those seen OFTEN in them are added up
#: over the whole task.
TOGETHER = 1 << 17
GATHER = 1 << 20
OFTEN = 4
#: Where n-grams travel: tokens of a chunk and of a part of a batch, bytes of text of a batch, segments that are asked
#: together, and parts of the texts that ask one after the other.
CHUNK = 4096
PART = 1 << 20
BATCH_TEXT = 6 << 20
LOT = 4
SLICES = 4
#: Stand for what precedes a text and for its end, among words (bytes) and among hashes.
BEFORE, AFTER = False, None
EDGES = {BEFORE: 0x5354415254, AFTER: 0x454E44}

_STEP = U64(0x9E3779B97F4A7C15)


def count_levels(most: int = 1 << 62) -> np.ndarray:
    """The least count of every level, from level 1 on."""
    found = [1]
    while found[-1] < most:
        found.append(max(found[-1] + 1, int(found[-1] * RATIO)))
    return np.array(found[:-1], np.int64)


LEVELS = count_levels()
#: Least and largest count of each level, level 0 included.
LOW = np.concatenate([[0], LEVELS]).astype(float)
HIGH = np.concatenate([[0], LEVELS[1:] - 1, LEVELS[-1:]]).astype(float)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


class Vocabulary(dict):
    """Numbers of the words that a task has met, with their 1-gram hashes and what ``about`` tells of new hashes.

    A word is looked up once for each occurrence; hashes, counts and levels are then taken from arrays. It starts over
    when it is asked to make room and holds more than ``limit`` words; results don't depend on that.
    """

    def __init__(self, about: Callable[[np.ndarray], list[np.ndarray]] | None = None, limit: int = 200_000):
        super().__init__()
        self.about, self.limit = about, limit
        self._start()

    def _start(self) -> None:
        self.clear()
        self.fresh: list[int] = []
        self.columns: list[np.ndarray] = []
        self.hashes = np.empty(0, U64)
        self.numbers_of([BEFORE, AFTER])

    def make_room(self) -> None:
        if len(self) > self.limit:
            self._start()

    def __missing__(self, word) -> int:
        self.fresh.append(EDGES[word] if word in EDGES else xxhash.xxh3_64_intdigest(word))
        number = self[word] = len(self)
        return number

    def numbers_of(self, words: list) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.fresh:
            fresh = shingle_hashes(np.array(self.fresh, U64), 1)
            told = self.about(fresh) if self.about else []
            self.columns = [np.concatenate(c) for c in zip(self.columns, told)] if len(self.hashes) else told
            self.hashes = np.concatenate([self.hashes, fresh])
            self.fresh = []
        return found


class EachHashed:
    """Instead of a `Vocabulary` where nothing else is looked up: words are hashed each time, which takes less time."""

    def numbers_of(self, words: list) -> np.ndarray:
        edges = [i for i, word in enumerate(words) if not word]  # a word is never empty
        stand = np.array([EDGES[words[i]] for i in edges], U64)
        for i in edges:
            words[i] = b""
        found = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
        found[edges] = stand
        self.hashes = shingle_hashes(found, 1)
        return np.arange(len(words), dtype=np.int32)

def _pieces(text: str | None, order: int, size: int) -> Iterator[tuple[list, list]]:
    """(what precedes, tokens) of every stretch of ``size`` words of a whole text; the last one ends with the end token.

    ASCII white space is what separates words, and only A-Z have another lower case among bytes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    before: list = [BEFORE] * (order - 1)
    for start in range(0, len(words) + 1, size):
        tokens = words[start : start + size]
        if start + size > len(words):
            tokens.append(AFTER)
        yield before, tokens
        before = (before + tokens)[len(before) + len(tokens) - (order - 1) :]


@dataclass
class Stretch:
    """Tokens of several pieces: their word numbers, and for every order the hash of the n-gram that ends at each token
    and of the history before it. An n-gram is hashed from the hashes of its words; one word is its own 1-gram."""

    numbers: np.ndarray
    grams: list[np.ndarray]  # at index o - 1, those of o tokens
    histories: list[np.ndarray]  # at index o - 1, those of o - 1 tokens; none for o = 1
    lengths: np.ndarray  # tokens of each piece


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes if width == 1 else shingle_hashes(hashes, width)


def stretch_of(pieces: list[tuple[list, list]], words_of: Vocabulary | EachHashed, order: int) -> Stretch:
    numbers = words_of.numbers_of([word for piece in pieces for part in piece for word in part])
    whole = words_of.hashes[numbers]
    lengths = np.array([len(tokens) for _, tokens in pieces])
    starts = np.cumsum(lengths + (order - 1)) - lengths
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    runs = [_runs(whole, o) for o in range(1, order + 1)]
    grams = [runs[o - 1][at - (o - 1)] for o in range(1, order + 1)]
    histories = [np.empty(0, U64), *(runs[o - 2][at - (o - 1)] for o in range(2, order + 1))]
    return Stretch(numbers[at], grams, histories, lengths)


def _narrow(whole: np.ndarray) -> np.ndarray:
    """Bytes of whole numbers, one row for each, without the high bytes that none of them needs."""
    width = max(1, -(-int(whole.max()).bit_length() // 8)) if len(whole) else 1
    return np.ascontiguousarray(whole, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _widen(packed: bytes, entries: int) -> np.ndarray:
    """Whole numbers from the columns of `_narrow`."""
    out = np.zeros((entries, 8), np.uint8)
    columns = np.frombuffer(packed, np.uint8).reshape(-1, entries)
    out[:, : len(columns)] = columns.T
    return out.view("<u8").ravel()


@dataclass
class Boxes:
    """Sorted distinct hashes in the order of their segments, in one box for each lot of segments that has any."""

    order: np.ndarray  # places of the hashes in that order
    lots: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    packed: list[bytes]

    def slices(self, whole: np.ndarray) -> list[bytes]:
        """Whole numbers that belong to the hashes, packed box by box."""
        columns = _narrow(whole[self.order])
        return [columns[s:e].T.tobytes() for s, e in zip(self.starts, self.ends)]


_LOW_BITS = U64((1 << 40) - 1)


def pack_order(h: np.ndarray, segments: int) -> np.ndarray:
    """Where the hashes of each segment are, one segment after the other."""
    return np.argsort(_places(h, segments).astype(np.uint16 if segments <= 1 << 16 else np.int64), kind="stable")


def pack_hashes(h: np.ndarray, segments: int, lot: int = 1) -> Boxes:
    """Sorted distinct hashes by the lots of their segments, without loss: the first, then the steps between them.

    There are as many segments as a lot has, or more. What the segment tells of a hash is left out, so a step is short: it
    has the bits of a hash less those that tell apart the hashes which are packed together.
    """
    order = pack_order(h, segments)
    upper, place = np.divmod(h[order] >> U64(40), U64(segments))
    reach = U64(-(-(1 << 24) // segments))
    code = (place % U64(lot) * reach + upper << U64(40)) | (h[order] & _LOW_BITS)
    lots = (place // U64(lot)).astype(np.int32)
    starts = np.flatnonzero(np.diff(lots, prepend=-1))
    ends = np.append(starts[1:], len(h))
    steps = np.diff(code, prepend=code[:1])
    steps[starts] = 0
    columns = _narrow(steps)
    packed = [code[s].tobytes() + columns[s:e].T.tobytes() for s, e in zip(starts, ends)]
    return Boxes(order, lots[starts], starts, ends, packed)


def unpack_hashes(packed: bytes, entries: int, which: int, segments: int, lot: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a box of the lot ``which``, and the place of their segments in the lot."""
    if not entries:
        return np.empty(0, U64), np.empty(0, U64)
    code = np.frombuffer(packed, U64, 1) + np.cumsum(_widen(packed[8:], entries), dtype=U64)
    place, upper = np.divmod(code >> U64(40), U64(-(-(1 << 24) // segments)))
    return (upper * U64(segments) + (place + U64(which * lot)) << U64(40)) | (code & _LOW_BITS), place


def _added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one n-gram as one row, by hash."""
    by = np.argsort(h)
    h, n = h[by], n[by]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else by
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _counted(batches: Iterator[pd.DataFrame], order: int, segments: int) -> Iterator[pd.DataFrame]:
    """Counts of n-grams, packed by segment: ``size`` tokens, or 0 for what precedes a text.

    They are added up over GATHER tokens. Then rare ones leave, others are added up over the whole task.
    """
    words_of = EachHashed()
    held: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
    often: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    entries = 0

    def rows(size: int, h: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        boxes = pack_hashes(h, segments)
        columns = {"segment": boxes.lots, "size": np.int8(size), "entries": (boxes.ends - boxes.starts).astype(np.int32)}
        return pd.DataFrame(columns | {"h": boxes.packed, "n": boxes.slices(n)})

    def count(pieces, texts: int) -> None:
        nonlocal entries
        stretch = stretch_of(pieces, words_of, order)
        entries += len(stretch.numbers)
        for o in range(1, order + 1):
            held[o].append(stretch.grams[o - 1])
        if texts:
            start = shingle_hashes(np.array([EDGES[BEFORE]], U64), 1)
            for k in range(1, order):
                often[0].append((_runs(start.repeat(k), k), np.array([texts])))

    def leave(last: bool) -> Iterator[pd.DataFrame]:
        nonlocal entries
        entries = 0
        for size in range(order + 1):
            if held[size]:
                h, n = np.unique(np.concatenate(held[size]), return_counts=True)
                held[size].clear()
                more = n >= OFTEN
                often[size].append((h[more], n[more]))
                if not more.all():
                    yield rows(size, h[~more], n[~more])
            if often[size] and (last or sum(len(h) for h, _ in often[size]) > TOGETHER):
                h, n = _added(*map(np.concatenate, zip(*often[size])))
                often[size].clear()
                if not last and len(h) <= TOGETHER // 2:
                    often[size].append((h, n))
                elif len(h):  # the end, or too many to keep
                    yield rows(size, h, n)

    pieces, tokens, texts = [], 0, 0
    for batch in batches:
        for text in batch["text"]:
            texts += 1
            for piece in _pieces(text, order, TOGETHER):
                pieces.append(piece)
                tokens += len(piece[1])
                if tokens >= TOGETHER:
                    count(pieces, texts)
                    pieces, tokens, texts = [], 0, 0
                    if entries >= GATHER:
                        yield from leave(False)
    if pieces:
        count(pieces, texts)
    yield from leave(True)


def count_ngrams(docs: DataFrame, order: int = ORDER, segments: int = 1) -> DataFrame:
    """Counts of all n-grams of up to ``order`` tokens of whole texts, packed: `_fitted` adds up those of a segment.

    A null text is empty and has the end token alone. The rows of a segment are in one partition.
    """
    run = lambda batches: _counted(batches, order, segments)
    rows = docs.select("text").mapInPandas(run, "segment int, size byte, entries int, h binary, n binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "segment")


def _prior(contexts: pd.DataFrame, once: float) -> float:
    """The mu that leaves as many tokens to shorter histories as there are n-grams seen once (after Good and Turing)."""
    grams, mean = contexts["grams"].to_numpy(float), contexts["tokens"].to_numpy(float) / contexts["grams"].to_numpy(float)
    low, high = -7.0, 14.0
    for _ in range(60):
        middle = (low + high) / 2
        mu = 10.0**middle
        low, high = (middle, high) if (grams * mean * mu / (mean + mu)).sum() < once else (low, middle)
    return 10.0**low


def _places(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each hash: by its upper bits; `_marks` mixes the hash again."""
    return (h >> U64(40)) % U64(segments)


def _marks(h: np.ndarray, level: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the segment and four bits in it that stand for (n-gram, level)."""
    with np.errstate(over="ignore"):
        g = mix64(h + np.asarray(level, U64) * _STEP)
    one, low = U64(1), U64(63)
    bits = (one << (g & low)) | (one << (g >> U64(6) & low)) | (one << (g >> U64(12) & low)) | (one << (g >> U64(18) & low))
    return (g >> U64(24)) % np.asarray(words, U64), bits


def fill_segment(h: np.ndarray, level: np.ndarray, words: int) -> np.ndarray:
    """The bits of a segment that holds the given n-grams up to their levels."""
    bits = np.zeros(words, U64)
    k = 1
    while len(h):
        word, mark = _marks(h, k, words)
        np.bitwise_or.at(bits, word.astype(np.int64), mark)
        k += 1
        above = level >= k
        h, level = h[above], level[above]
    return bits


def probe_levels(h: np.ndarray, bits: np.ndarray, offset: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Levels of n-grams by probes of level 1, 2 and so on; the segment of each has ``words`` words from ``offset`` on."""
    found = np.zeros(len(h), np.int16)
    live = np.arange(len(h))
    k = 1
    while len(live) and k < len(LOW):
        word, mark = _marks(h[live], k, np.maximum(words[live], U64(1)))
        hit = bits[(offset[live] + word).astype(np.int64)] & mark == mark
        live = live[hit]
        found[live] = k
        k += 1
    return found


@dataclass
class Model:
    """Counts of the training texts: ``counts`` of words (h, n), and the filter as a table: segment, words, bits, and the
    same counts of its words once more, packed (known, known_h, known_n)."""

    order: int
    tokens: int
    distinct: int
    priors: list[float]
    counts: DataFrame
    filter: DataFrame
    segments: int
    bytes: int


_FITTED = (
    "kind byte, segment int, words int, bits binary, known int, known_h binary, known_n binary, "
    "size byte, level short, grams long, tokens long, h long, n long"
)
_SEGMENT, _LEVELS, _WORD = 0, 1, 2


def _fitted(rows: pd.DataFrame, bits: int, segments: int) -> pd.DataFrame:
    """What a segment's counts give: its bits, the n-grams and tokens of each size and level, and the counts of words."""
    segment = int(rows["segment"].iloc[0])
    parts = []
    for size, own in rows.groupby("size"):
        h = np.concatenate([unpack_hashes(p, k, segment, segments)[0] for p, k in zip(own["h"], own["entries"])])
        n = np.concatenate([_widen(p, k) for p, k in zip(own["n"], own["entries"])]).astype(np.int64)
        h, n = _added(h, n)
        parts.append((h, n, np.full(len(h), size, np.int8)))
    h, n, size = map(np.concatenate, zip(*parts))
    level = level_of(n)
    words = max(64, -(-int(level.sum()) * bits // 64))
    filled = {"kind": [_SEGMENT], "words": [words], "bits": [fill_segment(h, level, words).tobytes()]}
    told = pd.DataFrame({"size": size, "level": level, "grams": 1, "tokens": n})
    told = told.groupby(["size", "level"], as_index=False).sum().assign(kind=_LEVELS)
    one = size == 1
    boxes = pack_hashes(h[one], segments)
    packed = {"known_h": boxes.packed or [b""], "known_n": boxes.slices(n[one]) or [b""]}
    filled = pd.DataFrame(filled | {"known": [int(one.sum())]} | packed)
    counts = pd.DataFrame({"kind": _WORD, "h": h[one].view(np.int64), "n": n[one]})
    out = pd.concat([filled, told, counts]).assign(segment=segment)
    whole = {"words": "Int32", "known": "Int32", "size": "Int8", "level": "Int16", "grams": "Int64", "tokens": "Int64", "h": "Int64", "n": "Int64"}
    # The whole numbers pass through floats in the concatenation, where hashes would lose digits, so they are set anew.
    out["h"] = pd.array([0] * (1 + len(told)) + [0] * len(counts), "Int64")
    out.iloc[1 + len(told) :, out.columns.get_loc("h")] = counts["h"].to_numpy()
    return out.astype({k: v for k, v in whole.items() if k != "h"})[[part.split()[0] for part in _FITTED.split(", ")]]


def fit_model(docs: DataFrame, order: int = ORDER, bits: int = BITS) -> Model:
    """Counts the n-grams of all ``docs`` and enters them into the filter. Without rows every probability is one.

    ``bits`` is the number of bits of the filter for each level of an n-gram.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SEGMENT_TEXT))
    counts = count_ngrams(docs, order, segments)
    fitted = write_table(counts.groupBy("segment").applyInPandas(lambda rows: _fitted(rows, bits, segments), _FITTED))
    release_shuffles(spark)
    levels = fitted.where(F.col("kind") == _LEVELS).groupBy("size", "level")
    levels = levels.agg(F.sum("grams").alias("grams"), F.sum("tokens").alias("tokens")).toPandas()
    of = {size: levels[levels["size"] == size] for size in range(order + 1)}
    once = [int(of[o].loc[of[o]["level"] == 1, "grams"].sum()) for o in range(1, order + 1)]
    priors = [_prior(of[o - 1], once[o - 1]) if len(of[o - 1]) else 1.0 for o in range(2, order + 1)]
    tokens, distinct = int(of[1]["tokens"].sum()), int(of[1]["grams"].sum())
    filled = fitted.where(F.col("kind") == _SEGMENT).select("segment", "words", "bits", "known", "known_h", "known_n")
    words = filled.agg(F.sum(F.col("words").cast("long"))).first()[0] or 0
    counts = fitted.where(F.col("kind") == _WORD).select("h", "n")
    return Model(order, tokens, distinct, priors, counts, filled, segments, 8 * words)


def token_logs(grams: list[np.ndarray], histories: list[np.ndarray], model: dict) -> np.ndarray:
    """log10 of the probability of each token from the levels of its n-grams and histories."""
    p = (LOW[grams[0]] + 0.5) / (model["tokens"] + 0.5 * (model["distinct"] + 1))
    for o, mu in enumerate(model["priors"], 2):
        history = HIGH[histories[o - 1]]
        p = (np.minimum(LOW[grams[o - 1]], history) + mu * p) / (history + mu)
    return np.log10(p)


def _history_levels(stretch: Stretch, grams: list[np.ndarray], levels) -> list[np.ndarray]:
    """Levels of the histories: of a token within a piece, the n-gram that ends at the token before it."""
    first = np.zeros(len(stretch.numbers), bool)
    first[np.cumsum(stretch.lengths) - stretch.lengths] = True
    at = np.flatnonzero(first)
    found = [grams[0][:0]]
    for o in range(2, len(grams) + 1):
        before = np.concatenate([grams[o - 2][:1], grams[o - 2][:-1]])
        before[at] = levels(stretch.histories[o - 1][at])
        found.append(before)
    return found


_PASS = "_key long, n_tokens long, n_known long, base_score double, score double, rare array<long>, rare_n array<int>"


def _score_batches(batches: Iterator[pd.DataFrame], model: dict, heavy, bits) -> Iterator[pd.DataFrame]:
    """One row for each text: its score, its base score over frequent words, and its other words."""
    order, key = model["order"], TaskContext.get().partitionId() << 33
    unit = math.log10(model["tokens"] + 0.5 * (model["distinct"] + 1))
    heavy_h, heavy_n = heavy.value
    offsets, table = bits.value

    def levels(h: np.ndarray) -> np.ndarray:
        at = _places(h, model["segments"]).astype(np.int64)
        return probe_levels(h, table, offsets[at], offsets[at + 1] - offsets[at])

    def about(h: np.ndarray) -> list[np.ndarray]:
        """Exact count of a frequent word (0 for others) and level of each new word."""
        if len(heavy_h):
            near = np.minimum(np.searchsorted(heavy_h, h), len(heavy_h) - 1)
            counts = np.where(heavy_h[near] == h, heavy_n[near], 0)
        else:
            counts = np.zeros(len(h), np.int64)
        return [counts, levels(h)]

    words_of = Vocabulary(about)
    for batch in batches:
        texts = batch["text"].tolist()
        rows = len(texts)
        n_tokens, n_known = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        base, score = np.zeros(rows), np.zeros(rows)
        rare: list[list] = [[] for _ in texts]
        rare_n: list[list] = [[] for _ in texts]

        def add(owners: list[int], pieces: list) -> None:
            stretch = stretch_of(pieces, words_of, order)
            counts, word_levels = words_of.columns
            owner = np.repeat(owners, stretch.lengths)
            sums = lambda x: np.bincount(owner, x, rows)
            n_tokens[:] += np.bincount(owner, minlength=rows)
            grams = [word_levels[stretch.numbers], *(levels(h) for h in stretch.grams[1:])]
            score[:] += sums(token_logs(grams, _history_levels(stretch, grams, levels), model))
            c = counts[stretch.numbers]
            base[:] += sums(np.log10(c + 0.5) - unit)
            known = c > 0
            n_known[:] += np.bincount(owner[known], minlength=rows)
            pairs, times = np.unique((owner[~known].astype(np.int64) << 32) | stretch.numbers[~known], return_counts=True)
            own, word = pairs >> 32, words_of.hashes[pairs & 0xFFFFFFFF].view(np.int64)
            splits = np.flatnonzero(np.diff(own)) + 1
            for at, h, n in zip(own[np.r_[0, splits]] if len(own) else [], np.split(word, splits), np.split(times, splits)):
                rare[at].append(h)
                rare_n[at].append(n.astype(np.int32))
            words_of.make_room()

        owners, pieces, tokens = [], [], 0
        for at, text in enumerate(texts):
            for piece in _pieces(text, order, TOGETHER):
                owners.append(at)
                pieces.append(piece)
                tokens += len(piece[1])
                if tokens >= TOGETHER:
                    add(owners, pieces)
                    owners, pieces, tokens = [], [], 0
        if pieces:
            add(owners, pieces)
        kept = batch.drop(columns="text")
        yield kept.assign(
            _key=np.arange(key, key + rows),
            n_tokens=n_tokens,
            n_known=n_known,
            base_score=base,
            score=score,
            rare=[np.concatenate(r) if r else [] for r in rare],
            rare_n=[np.concatenate(r) if r else [] for r in rare_n],
        )
        key += rows


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """All columns, with ``_key`` by the order of the rows and ``_batch``, the key of the first of a run of rows."""
    key = TaskContext.get().partitionId() << 33
    first, load = key, 0
    for batch in batches:
        firsts = []
        for k, size in enumerate(pc.binary_length(batch.column("text")).to_pylist(), key):
            if load >= most:
                first, load = k, 0
            load += size or 0
            firsts.append(first)
        keys = pa.array(range(key, key + len(firsts)), pa.int64())
        key += len(firsts)
        yield pa.RecordBatch.from_arrays([*batch.columns, keys, pa.array(firsts, pa.int64())], [*batch.schema.names, "_key", "_batch"])


@dataclass
class Part:
    """Up to about PART tokens of a run of texts: which text each is of, and the hashes that are asked for them."""

    owner: np.ndarray
    stretch: Stretch
    words: np.ndarray  # distinct 1-grams, sorted, and where each token has its own
    word_at: np.ndarray
    others: np.ndarray  # distinct longer n-grams, and histories that no token of the part ends
    other_at: list[np.ndarray]


def _parts(texts: list[str | None], order: int, chunk: int, together: int, most: int) -> Iterator[Part]:
    """The parts of texts; the same for the same texts. Tokens of a chunk, worked on together, and of a part at most."""
    words_of = EachHashed()
    stretches: list[Stretch] = []
    owners: list[np.ndarray] = []
    waiting: list[tuple[int, tuple[list, list]]] = []

    def hashed() -> None:
        stretch = stretch_of([piece for _, piece in waiting], words_of, order)
        stretches.append(stretch)
        owners.append(np.repeat([at for at, _ in waiting], stretch.lengths))
        waiting.clear()

    def part() -> Part:
        joined = lambda name: [np.concatenate(x) for x in zip(*(getattr(s, name) for s in stretches))]
        whole = {k: np.concatenate([getattr(s, k) for s in stretches]) for k in ("numbers", "lengths")}
        stretch = Stretch(whole["numbers"], joined("grams"), joined("histories"), whole["lengths"])
        at = np.cumsum(stretch.lengths) - stretch.lengths
        words, word_at = np.unique(stretch.grams[0], return_inverse=True)
        asked = [*stretch.grams[1:], *(h[at] for h in stretch.histories[1:])]
        others, back = np.unique(np.concatenate([np.empty(0, U64), *asked]), return_inverse=True)
        found = Part(np.concatenate(owners), stretch, words, word_at, others, np.split(back[: (order - 1) * len(word_at)], order - 1) if order > 1 else [])
        stretches.clear()
        owners.clear()
        return found

    held = tokens = 0
    for at, text in enumerate(texts):
        for piece in _pieces(text, order, chunk):
            waiting.append((at, piece))
            tokens += len(piece[1])
            if tokens >= together:
                hashed()
                held, tokens = held + tokens, 0
                if held >= most:
                    yield part()
                    held = 0
    if waiting:
        hashed()
    if stretches:
        yield part()


_ASKED = "lot int, copy int, batch long, first long, number int, n_words int, words binary, n_others int, others binary"
_ANSWERED = "batch long, first long, number int, lot int, n_words int, counts binary, levels binary, n_others int, other_levels binary"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _asked(batches: Iterator[pa.RecordBatch], segments: int, copies: int, parts: Callable) -> Iterator[pa.RecordBatch]:
    """What the parts of each run of texts of a batch ask each lot of segments; a run is named by its first key."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def ask(texts: list, own: int, first: int) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(parts(texts)):
            lots: dict[int, list] = {}
            for at, h in ((0, part.words), (2, part.others)):
                boxes = pack_hashes(h, segments, LOT)
                for lot, entries, packed in zip(boxes.lots.tolist(), (boxes.ends - boxes.starts).tolist(), boxes.packed):
                    lots.setdefault(lot, [0, b"", 0, b""])[at : at + 2] = entries, packed
            copy = (own ^ own >> 33) % copies
            columns = zip(*((lot, copy, own, first, number, *asked) for lot, asked in lots.items()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _names(_ASKED))

    texts, own, first = [], None, None
    for batch in batches:
        for text, key, of in zip(*(batch.column(c).to_pylist() for c in ("text", "_key", "_batch"))):
            if texts and of != own:
                yield from ask(texts, own, first)
                texts = []
            if not texts:
                own, first = of, key
            texts.append(text)
    if texts:
        yield from ask(texts, own, first)


def _answered(left: pa.Table, right: pa.Table, segments: int) -> pa.Table:
    """Counts and levels of what is asked of a lot of segments. ``right`` has their bits and the counts of their words."""
    sizes, offsets, tables, at = np.zeros(LOT, U64), np.zeros(LOT, U64), [], 0
    known, n = [np.empty(0, U64)], [np.empty(0, U64)]
    for row in right.to_pylist():
        segment, entries = row["segment"], row["known"]
        tables.append(np.frombuffer(row["bits"], U64))
        sizes[segment % LOT], offsets[segment % LOT] = len(tables[-1]), at
        at += len(tables[-1])
        if entries:
            known.append(unpack_hashes(row["known_h"], entries, segment, segments)[0])
            n.append(_widen(row["known_n"], entries))
    offsets[sizes == 0] = at  # the word more is for segments without n-grams
    table = np.concatenate([*tables, np.zeros(1, U64)])
    known, n = np.concatenate(known), np.concatenate(n)
    by = np.argsort(known)
    known, n = np.append(known[by], U64(0)), np.append(n[by], U64(0))

    def probed(column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entries = left[f"n_{column}"].to_pylist()
        boxes = zip(left[column].to_pylist(), entries, left["lot"].to_pylist())
        h, place = map(np.concatenate, zip(*(unpack_hashes(p, k, lot, segments, LOT) for p, k, lot in boxes)))
        place = place.astype(np.int64)
        return h, probe_levels(h, table, offsets[place], sizes[place]), np.append(0, np.cumsum(entries))

    def sliced(whole: np.ndarray, ends: np.ndarray) -> pa.Array:
        columns = _narrow(whole)
        return pa.array([columns[s:e].T.tobytes() for s, e in zip(ends[:-1], ends[1:])], pa.binary())

    own = {k: left[k] for k in ("batch", "first", "number", "lot", "n_words", "n_others")}
    if left.num_rows:
        h, levels, ends = probed("words")
        near = np.searchsorted(known[:-1], h)
        counts = np.where(known[near] == h, n[near], 0)
        _, other_levels, other_ends = probed("others")
        told = {"counts": sliced(counts, ends), "levels": sliced(levels, ends), "other_levels": sliced(other_levels, other_ends)}
    else:
        told = dict.fromkeys(("counts", "levels", "other_levels"), pa.array([], pa.binary()))
    return pa.table({k: (own | told)[k] for k in _names(_ANSWERED)})


def _finished(left: pa.Table, right: pa.Table, model: dict, parts: Callable) -> pa.Table:
    """The rows of a batch with the results of their texts, from the answers to its parts."""
    segments = model["segments"]
    unit = math.log10(model["tokens"] + 0.5 * (model["distinct"] + 1))
    rows = left.num_rows
    n_tokens, n_known, base, score = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
    keys = left["_key"].to_numpy()
    texts, by = left["text"].to_pylist(), np.argsort(keys)
    answers: dict[tuple[int, int], list[dict]] = {}
    for row in sorted(right.to_pylist(), key=lambda row: row["lot"]):
        answers.setdefault((row["first"], row["number"]), []).append(row)

    def gathered(told: list[dict], column: str, n: str, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        out[pack_order(h, segments)] = np.concatenate([_widen(row[column], row[n]) for row in told if row[n]])
        return out

    runs = np.array(sorted({first for first, _ in answers}))
    for first, own in zip(runs, np.split(by, np.searchsorted(keys[by], runs[1:]))):
        for number, part in enumerate(parts([texts[i] for i in own])):
            told = answers[int(first), number]
            counts = gathered(told, "counts", "n_words", part.words)
            grams = [gathered(told, "levels", "n_words", part.words)[part.word_at]]
            others = gathered(told, "other_levels", "n_others", part.others) if len(part.others) else np.zeros(0, np.int64)
            grams += [others[at] for at in part.other_at]
            histories = _history_levels(part.stretch, grams, lambda h: others[np.searchsorted(part.others, h)])
            owner, c = own[part.owner], counts[part.word_at]
            n_tokens += np.bincount(owner, minlength=rows)
            n_known += np.bincount(owner[c > 0], minlength=rows)
            base += np.bincount(owner, np.log10(c + 0.5) - unit, rows)
            score += np.bincount(owner, token_logs(grams, histories, model), rows)
    out = left.drop_columns(["text", "_key", "_batch"])
    for name, column in (("n_tokens", n_tokens), ("n_known", n_known), ("base_score", base), ("score", score)):
        out = out.append_column(name, pa.array(column))
    return out


def _travelling_scores(docs: DataFrame, model: Model, plain: dict) -> DataFrame:
    """All columns of ``docs`` but the text, and the results, for a filter of any size: n-grams go to the segments,
    counts and levels come back.

    Texts go in batches, and SLICES parts of the batches one after the other, so that only what one part asks lies in
    shuffle files at any time. A lot that much text asks is copied, so that no group has to hold more than a few segments
    of text.
    """
    spark, order, segments = docs.sparkSession, model.order, model.segments
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    most, steps = BATCH_TEXT, (CHUNK, TOGETHER, PART)
    laid = write_table(docs.mapInArrow(lambda rows: _batches(rows, most), f"{schema}, _key long, _batch long"))
    size = laid.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    copies = max(1, -(-size // (SLICES * segments * SEGMENT_TEXT)))
    known = model.filter.withColumn("lot", F.floor(F.col("segment") / LOT).cast("int"))
    known = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    results = "n_tokens long, n_known long, base_score double, score double"
    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items() if k != "text"), results])

    def parts(texts):
        return _parts(texts, order, *steps)

    def ask(batches):
        return _asked(batches, segments, copies, parts)

    def answer(left, right):
        return _answered(left, right, segments)

    def finish(left, right):
        return _finished(left, right, plain, parts)

    def scored(k: int) -> DataFrame:
        some = laid.where(F.pmod(F.xxhash64("_batch"), F.lit(SLICES)) == k)
        asked = some.select("text", "_key", "_batch").mapInArrow(ask, _ASKED).groupBy("lot", "copy")
        told = asked.cogroup(known.groupBy("lot", "copy")).applyInArrow(answer, _ANSWERED)
        return write_table(some.groupBy("_batch").cogroup(told.groupBy("batch")).applyInArrow(finish, schema))

    slices = []
    for k in range(SLICES):
        slices.append(scored(k))
        for _ in range(2):  # what the last events of a query hold goes with the second one
            release_shuffles(spark)
            time.sleep(0.5)
    return reduce(DataFrame.unionByName, slices)


def score_texts(docs: DataFrame, model: Model, broadcast: int = BROADCAST) -> DataFrame:
    """All columns of ``docs`` but the text, with n_tokens, n_known, train_tokens, base_score and score of the whole text.

    Tokens are the words, A-Z in lower case, and one end. base_score is the sum of log10 of the smoothed exact relative
    frequencies, score that of the model's probabilities. A null text is empty. Equal rows get equal results. Columns of
    these names are replaced. ``broadcast`` is the number of bytes up to which the filter is broadcast.
    """
    context = docs.sparkSession.sparkContext
    added = ["n_tokens", "n_known", "base_score", "score", "train_tokens", "_key", "_batch", "rare", "rare_n"]
    docs = docs.drop(*added)
    names = [c for c in docs.columns if c != "text"]
    plain = {k: getattr(model, k) for k in ("order", "tokens", "distinct", "priors", "segments")}
    source = docs.select(*names, "text")
    train = F.lit(model.tokens).cast("long").alias("train_tokens")
    if model.bytes > broadcast:
        travelled = _travelling_scores(source, model, plain)
        return travelled.select(*names, "n_tokens", "n_known", train, "base_score", "score")
    share = max(1, -(-model.tokens // HEAVY))
    found = model.counts.where(F.col("n") >= share).toPandas()  # HEAVY words at most
    h, n = found["h"].to_numpy(np.int64).view(U64), found["n"].to_numpy(np.int64)
    by = np.argsort(h)
    heavy = context.broadcast((h[by], n[by]))
    sizes = np.zeros(model.segments + 1, np.int64)
    for row in model.filter.select("segment", "words").toLocalIterator():
        sizes[row.segment + 1] = row.words
    offsets = np.cumsum(sizes).astype(U64)
    table = np.zeros(model.bytes // 8 + 1, U64)  # the word more is for segments without n-grams
    for row in model.filter.select("segment", "bits").toLocalIterator():  # one partition at a time; their sum is bounded
        at = int(offsets[row.segment])
        table[at : at + len(row.bits) // 8] = np.frombuffer(row.bits, U64)
    bits = context.broadcast((offsets, table))
    del table
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), _PASS])
    run = lambda batches: _score_batches(batches, plain, heavy, bits)
    passed = write_table(source.mapInPandas(run, schema))

    terms = passed.select("_key", F.explode(F.arrays_zip("rare", "rare_n")).alias("t")).select("_key", "t.*")
    lookup = model.counts.where(F.col("n") < share).select(F.col("h").alias("word"), "n")
    known = terms.join(lookup, F.col("rare") == F.col("word"))
    more = known.groupBy(F.col("_key").alias("_of")).agg(
        F.sum("rare_n").alias("more_known"),
        F.sum(F.col("rare_n") * (F.log10(F.col("n") + 0.5) - math.log10(0.5))).alias("more_base"),
    )
    return passed.drop("rare", "rare_n").join(more, F.col("_key") == F.col("_of"), "left").select(
        *names,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        train,
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
