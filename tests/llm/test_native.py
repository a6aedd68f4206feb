"""Source mix, perspective rotation and secret scan: against SQL, brute force and edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wavelake.llm import chat, mixing, secret_scan
from wavelake.llm import queries as Q

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, target int"
FOLDER = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Rows of (doc_id, text, source); size and target are extra columns whose names clash."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 7) for i, t, s in rows], DOCS)


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x " * 5000, None), (None, "q r", "t"), (1, "a b c", "s")]
    out = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(out) == 6 and all(r.taken in (0, r.size, 2 * r.size) for r in out)
    assert {(r.doc_id, r.size) for r in out} == {(1, 3), (2, 0), (3, 0), (4, 5000), (None, 2)}
    assert len({(r.copies) for r in out if r.doc_id == 1}) == 1  # repeated rows are drawn alike


def test_mix_hits_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i * i % 97), f"s{0 if i % 3 else i % 8}") for i in range(1500)]
    table = docs(spark, rows)
    out = mixing.mix_sources(table)
    total = sum(len(t.split()) for _, t, _ in rows)
    per = out.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("source_size").alias("size")).collect()
    assert sum(r.target for r in per) == pytest.approx(1.5 * total)
    for r in per:
        assert r.target <= 2 * r.size and abs(r.taken - r.target) <= 2
    again = mixing.mix_sources(table.repartition(7)).select("doc_id", "copies").collect()
    assert sorted(again) == sorted(out.select("doc_id", "copies").collect())


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mix_sources(docs(spark, [(1, None, None)])).first().taken == 0


TURNS = "conv_id bigint, turn bigint, role string, text string, speaker string"


def test_rotation_of_three_speakers(spark):
    said = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "é"), (2, 0, "system", "alone")]
    turns = spark.createDataFrame([(*r, "clash") for r in said], TURNS)
    rows = {r.speaker: r for r in chat.rotate_perspectives(turns).collect()}
    assert set(rows) == {"ann", "bob", "unknown"}  # a dialogue without participants gives nothing
    for name, r in rows.items():
        expected = ""
        spans = []
        for _, _, role, text in said[:4]:
            role = role or "unknown"
            head = "assistant" if role == name else "system" if role == "system" else f"user {role}"
            expected += f"<|im_start|>{head}\n"
            if role == name:
                spans.append((len(expected), len(expected) + len(text or "") + len("<|im_end|>")))
            expected += f"{text or ''}<|im_end|>\n"
        assert r.rendered == expected and [(m.start, m.end) for m in r.mask] == spans
        assert r.n_turns == 4 and r.n_target_turns == 1


def test_rotation_cuts_long_dialogues(spark):
    turns = spark.createDataFrame([(1, t, "ab"[t % 2], str(t), "") for t in range(1000)], TURNS)
    rows = chat.rotate_perspectives(turns, 100).orderBy("speaker", "chunk").collect()
    assert len(rows) == 20 and all(r.n_turns == 100 for r in rows)
    whole = "".join(r.rendered for r in rows if r.speaker == "a")
    assert re.findall(r"\n(\d+)<", whole) == [str(t) for t in range(1000)]
    assert chat.rotate_perspectives(turns.where("false")).count() == 0


def test_rotation_ties_and_nulls(spark):
    turns = spark.createDataFrame([(None, 1, "b", "2", ""), (None, 1, "a", "1", ""), (None, None, "a", "3", ""), (None, 1, "b", "2", "")], TURNS)
    rows = chat.rotate_perspectives(turns).where("speaker = 'a'").orderBy(F.col("chunk").asc_nulls_last()).collect()
    assert [re.findall(r"\n(\d)<", r.rendered) for r in rows] == [["1", "2", "2"], ["3"]]


def base_by_definition(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))


HEX = "0123456789abcdef" * 2
TEXTS = [
    None, "", "plain words only", f"token = {HEX}", f"é🙂 Password='abc' secret:abcdef api_key=\"{HEX}\" tail", "AKIA" + "Z9" * 8 + " AKIAXAKIA",
    "token=token:abcdefgh passwd===x secret=secret=secret", HEX * 2000, "word " * 30000 + "SECRET : zzzzzz", f"{HEX}{HEX}AKIA{HEX}",
]


def test_secret_base_spans_by_definition(spark):
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, base string")
    weights = [0.0] * (secret_scan.CODES**2)
    rows = secret_scan.find_secrets(table, weights).select("doc_id", secret_scan.span_text(F.col("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in rows} == {i: base_by_definition(t or "") for i, t in enumerate(TEXTS)}


def test_markov_models_find_other_keys(spark):
    ordinary = ["configurationmanager", "getuseraccountinfo", "thequickbrownfoxjumps", "internationalization", "anotherordinaryword"]
    random = ["x9Kq2ZtR7mLw4VbN8sYc", "Q7z0PkR3wVt9XbL5mJ2d", "b81kZq0RmT7xWc4LvN9p", "7fG2kLq9XzT4vRb8NwPm", "mZ3xQ8vK1tR6yLw9Bc0J"]
    samples = spark.createDataFrame([(t, False, 1) for t in ordinary] + [(t, True, 1) for t in random], "token string, random boolean, n bigint")
    weights = secret_scan.fit_weights(samples)
    key = "Z4kQ9xT2mV7bR0wL8nJ5pY3c"
    table = spark.createDataFrame([(1, f"see {key} or administratorinformationmanager"), (2, f"token={key}")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in secret_scan.find_secrets(table, weights, least_total=8, least_mean=0.3).collect()}
    assert [(s.start, s.end) for s in rows[1].added] == [(4, 4 + len(key))]
    assert rows[2].added == [] and len(rows[2].base) == 1
    red = secret_scan.redacted(F.col("text"), F.array_sort(F.concat("base", "added")))
    assert secret_scan.find_secrets(table, weights, 8, 0.3).orderBy("doc_id").select(red).first()[0].startswith("see [SECRET] or adm")


def test_short_joined_and_partly_known_keys(spark):
    weights = secret_scan.fit_weights(secret_scan.labelled_samples(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    key, other = "Z4kQ9xT2mV7bR0", "Q7z0PkR3wVt9XbL5mJ2d"
    word = "andthtionatti"
    hexes = "24be64439e3e49cf46b2d7c90f3602a3"
    cases = [
        (f"see {key} now", [key]),
        (f"see {word * 4}/{other}/{word * 4} now", [other]),
        (f"see {word * 6}_{other}-{word * 6}+{key} now", [other, key]),
        (f"see X9{other}G{hexes}GqZ7 now", [f"X9{other}G", "GqZ7"]),
        (f"see {other}AKIA{'Z9' * 8} now", [other]),
        (f"see {word} and {word * 3} now", []),
    ]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    found = {r.doc_id: r.added for r in secret_scan.find_secrets(table, weights).collect()}
    for i, (text, want) in enumerate(cases):
        assert [text[s.start : s.end] for s in found[i]] == want
    spans = F.array_sort(F.concat("base", "added"))
    clean = secret_scan.find_secrets(table.where("doc_id = 3"), weights).select(secret_scan.redacted(F.col("text"), spans)).first()[0]
    assert clean.replace("[SECRET]", "") == "see  now"


def test_models_without_samples(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert set(secret_scan.fit_weights(secret_scan.labelled_samples(empty))) == {0.0}
    assert secret_scan.find_secrets(empty, [0.0] * 16384).count() == 0


def test_secret_query_by_definition(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in Q.op5_secret_scan(spark, FOLDER).collect():
        want = base_by_definition(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
