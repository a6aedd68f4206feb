"""Spelling variants: signatures against all pairs, chains of forms, edges."""

import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelake.llm import spelling as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


words = st.text("abà", min_size=1, max_size=9)


@given(words, st.integers(0, 9), st.sampled_from("abcéà"), st.sampled_from(["insert", "delete", "replace"]))
@settings(max_examples=400, deadline=None)
def test_words_one_edit_apart_share_a_signature(a, at, letter, how):
    at %= len(a)
    b = {"insert": a[:at] + letter + a[at:], "delete": a[:at] + a[at + 1 :], "replace": a[:at] + letter + a[at + 1 :]}[how]
    if not b or a == b:
        return
    if len(a) == len(b):
        shared = set(S.multiset_signatures(a, 2, len(a))) & set(S.multiset_signatures(b, 2, len(b)))
    else:
        least = min(len(a), len(b))
        shared = set(S.multiset_signatures(a, 1, least)) & set(S.multiset_signatures(b, 1, least))
    assert shared


def by_definition(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return out


def test_groups_by_definition(spark):
    counts = {
        "letters": 5000, "leters": 400, "lettrs": 300, "letterss": 30, "leterss": 3, "leter": 2, "lettars": 500,
        "straße1": 1, "grüßend": 20, "grußend": 2, "aaaaaaa": 10, "aaaaaaaa": 100, "aaaaaaab": 100, "aaaaaaac": 1000,
    }
    counts |= {f"crowded{i:03d}": 2 + i for i in range(300)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit("other"))
    got = {tuple(r) for r in S.group_spellings(table).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == by_definition(counts)


def runs_by_definition(docs):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + "\n":
            if ("A" <= c <= "Z") or ("a" <= c <= "z") or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_words_of_texts_by_definition(spark):
    words = ["Beginning", "ÉTRANGER", "abcdefg", "a×b÷cdefgh", "shortly", "tiny", "x" * 5000, "don't-separate"]
    docs = [(i, " ".join(words[(i * k) % 8] for k in range(1, 60)) + f" unique{i}") for i in range(40)]
    docs += [(None, "Beginning beginning BEGINNING"), (3, None), (4, ""), (7, docs[7][1]), (7, docs[7][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.word: r.n for r in S.vocabulary(S.damaged_runs(table)).collect()}
    assert got == runs_by_definition(docs)
    assert any(len(w) == 4999 for w in got) or all(len(w) in range(7, 5001) for w in got)
    full = {tuple(r) for r in S.spelling_variants(table).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert full == by_definition(got)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_variants(nothing).collect() == []
    assert S.group_spellings(spark.createDataFrame([(None, 3)], "word string, n long")).collect() == []
    assert S.group_spellings(spark.createDataFrame([("alone", 3)], "word string, n long")).count() == 1


@pytest.mark.parametrize("a, b, near", [("abcdefg", "abcdefg", False), ("abcdefg", "gabcdef", False), ("abcdefg", "abcdeg", True)])
def test_pairs(spark, a, b, near):
    table = spark.createDataFrame([(w, 1) for w in {a, b}], "word string, n long")
    assert (S.near_pairs(table).count() > 0) == near
