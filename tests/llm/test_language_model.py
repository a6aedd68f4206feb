"""Scores of the language model: the filter, exact base scores, both ways of asking it, edges."""

import math
import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.llm import language_model as M
from wavelake.llm.common import U64, mix64
from wavelake.session import ensure_checkpoint_dir

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + [None]


def test_levels_bound_the_counts():
    counts = np.concatenate([np.arange(1, 5000), [10**9, 10**15]])
    level = M.level_of(counts)
    assert (M.LOW[level] <= counts).all() and (counts <= M.HIGH[level]).all()
    assert (M.HIGH[level] <= np.maximum(counts * M.RATIO, counts)).all()
    assert level[:10].tolist() == list(range(1, 11))


def test_filter_gives_levels_back():
    rng = np.random.default_rng(0)
    h = mix64(np.arange(1, 40001, dtype=U64))
    level = rng.geometric(0.6, 40000)
    words = int(level.sum()) * M.BITS // 64
    bits = M.fill_segment(h, level, words)
    found = M.probe_levels(h, bits, np.zeros(len(h), U64), np.full(len(h), words, U64))
    assert (found >= level).all()  # never less
    assert (found > level).mean() < 0.03
    strange = mix64(np.arange(10**6, 10**6 + 40000, dtype=U64))
    assert (M.probe_levels(strange, bits, np.zeros(40000, U64), np.full(40000, words, U64)) > 0).mean() < 0.03


def base_by_definition(train, texts):
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    score = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
    return n, [(len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), score(t)) for t in texts]


def model_by_definition(train, texts, order, priors):
    """Interpolated probabilities from exact counts, rounded to their levels; no filter."""
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        row = ["\0s"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(row)):
            for o in range(1, order + 1):
                grams[o][tuple(row[i - o + 1 : i + 1])] += 1
        for k in range(1, order):
            grams[0][("\0s",) * k] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    low = lambda c: M.LOW[M.level_of(np.array([c]))[0]]
    high = lambda c: M.HIGH[M.level_of(np.array([c]))[0]]
    out = []
    for t in texts:
        row = ["\0s"] * (order - 1) + tokens(t)
        total = 0.0
        for i in range(order - 1, len(row)):
            p = (low(grams[1][(row[i],)]) + 0.5) / (n + 0.5 * (v + 1))
            for o in range(2, order + 1):
                before = tuple(row[i - o + 1 : i])
                c = high(grams[len(before)][before] + grams[0][before])
                p = (min(low(grams[o][tuple(row[i - o + 1 : i + 1])]), c) + priors[o - 2] * p) / (c + priors[o - 2])
            total += math.log10(p)
        out.append(total)
    return out


TEXTS = [
    "The cat sat on the mat", "the CAT sat on a hat\nand a cat", "", None, "   \t ", "the the the the the",
    "Zoë saw the cat\x0con the mat\x0band left", "unseen words only here", "the cat sat on the mat", "x " * 3000,
]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_definition(spark, monkeypatch, order):
    monkeypatch.setattr(M, "HEAVY", 8)  # most words are looked up by a join
    train = [t for i, t in enumerate(TEXTS) if i != 7] * 3
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rare", F.lit(0))
    learned = spark.createDataFrame([(t,) for t in train], "text string").repartition(4)
    model = M.fit_model(learned, order, bits=256)  # no false hits here
    n, base = base_by_definition(train, [t for _, t in rows])
    want = model_by_definition(train, [t for _, t in rows], order, model.priors)
    for broadcast in (M.BROADCAST, 0):
        got = M.score_texts(docs, model, broadcast)
        assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        key = lambda r: (str(r[0]), round(r[1], 6))
        mine = sorted(((r.doc_id, r.base_score, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got.collect()), key=key)
        exact = sorted(((i, b[2], b[0], b[1], n, s) for (i, _), b, s in zip(rows, base, want)), key=key)
        for a, b in zip(mine, exact, strict=True):
            assert a[0] == b[0] and a[2:5] == b[2:5]
            assert (a[1], a[5]) == pytest.approx((b[1], b[5]), rel=1e-9, abs=1e-9)


def test_probabilities_after_a_history_sum_to_one_at_most():
    rng = np.random.default_rng(4)
    follow = rng.geometric(0.05, 200)  # how often each word follows a history
    lower = follow / follow.sum()
    levels = M.level_of(follow)
    model = {"tokens": 0, "distinct": 0, "priors": [3.0]}
    for share in (1.0, 0.5):
        kept = np.where(rng.random(200) < share, levels, 0)
        history = M.level_of(np.array([follow[kept > 0].sum()])).repeat(200)
        first = M.token_logs([np.zeros(200, int)], [], model | {"priors": []})
        p = 10 ** M.token_logs([np.zeros(200, int), kept], [np.zeros(0), history], model)
        # The lower order is one for every word here, so its share is taken out and put back as a distribution.
        mass = 3.0 / (M.HIGH[history] + 3.0)
        assert (first == 0).all()
        assert (p - mass + mass * lower).sum() <= 1 + 1e-9


def test_long_texts_go_in_stretches(spark, monkeypatch):
    text = " ".join(f"w{i % 97} v{i % 89}" for i in range(4000))
    docs = spark.createDataFrame([(1, text), (2, text[:500]), (3, None)], "doc_id long, text string")
    model = M.fit_model(docs)
    whole = {r.doc_id: (r.score, r.base_score, r.n_tokens) for r in M.score_texts(docs, model).collect()}
    assert whole[1][2] == 8001 and whole[3][2] == 1
    monkeypatch.setattr(M, "CHUNK", 100)
    parts = {r.doc_id: r.score for r in M.score_texts(docs, model, broadcast=0).collect()}
    assert all(parts[k] == pytest.approx(whole[k][0], rel=1e-9) for k in whole)
    pieces = list(M._pieces(text, 3, 100))
    assert sum(len(p[1]) for p in pieces) == 8001 and pieces[1][0] == pieces[0][1][-2:]
    assert [len(t) for _, t in M._pieces("a b c d", 2, 2)] == [2, 2, 1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = M.fit_model(docs.where("false"))
    got = M.score_texts(docs, model).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 2
    assert M.score_texts(docs.where("false"), M.fit_model(docs)).collect() == []
    assert M.score_texts(docs.where("false"), M.fit_model(docs), broadcast=0).collect() == []


def test_known_text_scores_above_shuffled_text(spark):
    line = "we gather here today to read the long report about trains and ships and planes"
    docs = spark.createDataFrame([(i, f"{line} number {i}") for i in range(30)], "doc_id long, text string")
    model = M.fit_model(docs)
    two = spark.createDataFrame([(1, line), (2, " ".join(sorted(line.split())))], "doc_id long, text string")
    got = {r.doc_id: r for r in M.score_texts(two, model).collect()}
    assert got[1].score > got[2].score and got[1].score > got[1].base_score
    assert got[1].base_score == pytest.approx(got[2].base_score)


@pytest.mark.parametrize("segments", [4, 5, 7, 240, 70_001])
@pytest.mark.parametrize("lot", [1, 4])
def test_packed_hashes_come_back(segments, lot):
    h = np.unique(np.concatenate([mix64(np.arange(1, 5001, dtype=U64)), np.array([0, 1, 2**40 - 1, 2**64 - 1], U64)]))
    n = np.arange(len(h)) * 77
    boxes = M.pack_hashes(h, segments, lot)
    entries = boxes.ends - boxes.starts
    order = M.pack_order(h, segments)
    found = [M.unpack_hashes(p, k, w, segments, lot) for p, k, w in zip(boxes.packed, entries, boxes.lots)]
    assert (np.concatenate([f[0] for f in found]) == h[order]).all() and sorted(order) == list(range(len(h)))
    places = np.concatenate([place + U64(w * lot) for (_, place), w in zip(found, boxes.lots)])
    assert (places == M._places(h, segments)[order]).all() and len(set(boxes.lots)) == len(boxes.lots)
    assert (np.concatenate([M._widen(p, k) for p, k in zip(boxes.slices(n), entries)]) == n[order]).all()


def test_rare_and_frequent_words_leave_once_each(monkeypatch):
    monkeypatch.setattr(M, "TOGETHER", 50)
    monkeypatch.setattr(M, "GATHER", 100)
    texts = [" ".join(f"w{i % 7} v{i % 11} x{k}y{i}" for i in range(60)) for k in range(30)] + [None, ""]
    want = Counter(w for t in texts for w in tokens(t))
    found = Counter()
    for rows in M._counted(iter([M.pd.DataFrame({"text": texts})]), 2, 8):
        for row in rows.itertuples():
            h, n = M.unpack_hashes(row.h, row.entries, row.segment, 8)[0], M._widen(row.n, row.entries)
            assert (M._places(h, 8) == row.segment).all()
            found.update({(row.size, int(a)): 0 for a in h})
            for a, b in zip(h, n):
                found[row.size, int(a)] += int(b)
    assert sorted(n for (size, _), n in found.items() if size == 1) == sorted(want.values())
    assert sum(n for (size, _), n in found.items() if size == 2) == sum(want.values())
    assert [n for (size, _), n in found.items() if size == 0] == [len(texts)]


def test_travelling_keeps_little_beside_the_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(map("{:x}".format, rng.integers(0, 1 << 20, 900)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = Path(urlparse(ensure_checkpoint_dir(spark)).path)
    kept = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    model = M.fit_model(docs)
    before = kept()
    got = {r.doc_id: r for r in M.score_texts(docs, model, broadcast=0).collect()}
    assert kept() - before < 1.5 * sum(len(t) for _, t in rows)  # 5.0 times the texts when every n-gram was a row
    whole = {r.doc_id: r for r in M.score_texts(docs, model).collect()}
    for i, _ in rows:
        assert (got[i].n_tokens, got[i].n_known) == (whole[i].n_tokens, whole[i].n_known)
        assert (got[i].score, got[i].base_score) == pytest.approx((whole[i].score, whole[i].base_score), rel=1e-9)


def test_batches_runs_and_parts_of_any_size(spark, monkeypatch):
    rows = [(i, None if i % 9 == 0 else " ".join(f"w{i * k % 53}" for k in range(i % 40))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (2**62 + 1, "w1 w2"), (None, "w1 w2")], "doc_id long, text string").repartition(2)
    model = M.fit_model(docs)
    key = lambda r: (str(r.doc_id), r.n_tokens)
    want = sorted(M.score_texts(docs.where("doc_id < 1000"), model).collect(), key=key)
    for name, value in (("BATCH_TEXT", 300), ("PART", 60), ("TOGETHER", 20), ("CHUNK", 7), ("SEGMENT_TEXT", 1)):
        monkeypatch.setattr(M, name, value)
    got = sorted(M.score_texts(docs, model, broadcast=0).collect(), key=key)
    assert {2**62 + 1, None} < {r.doc_id for r in got}  # ids keep every digit beside a null
    got = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
