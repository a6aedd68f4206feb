"""Near duplicates against all pairs, and the pipeline."""

import numpy as np
import pytest

from wavelake.llm import neardup as N
from wavelake.llm import queries as Q
from wavelake.llm.common import WordHashes

FOLDER = "/root/testdata/sf0.001"


def classes_by_definition(texts, width, over, under):
    """Smallest reachable id from comparing every pair of sets of word tuples."""
    sets = {}
    for i, t in texts.items():
        words = [w for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").split() if w]
        n = min(width, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
    head = {i: i for i in texts}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if under * both >= over * (len(sets[a]) + len(sets[b]) - both):
                    old, new = head[b], head[a]
                    old, new = max(old, new), min(old, new)
                    head = {k: new if v == old else v for k, v in head.items()}
    return {i: (len(sets[i]), head[i]) for i in texts}


@pytest.mark.parametrize("margin", [0, 0.3])
def test_joint_estimate_is_near_the_truth(margin):
    h = N.mix64(np.arange(1, 4001, dtype=np.uint64))
    a, b = h[:2000], h[int(2000 * margin) : 2100]
    k = N.registers([a, b], 2048)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert N.joint_estimate(k[:1], k[1:], np.array([len(a)]), np.array([len(b)]))[0] == pytest.approx(truth, abs=0.05)
    assert (N.merge_registers(k[0], k[1]) == N.registers([np.union1d(a, b)], 2048)[0]).all()


def test_query_by_definition(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = classes_by_definition(texts, 3, 85, 100)
    for r in Q.op7_near_duplicates(spark, FOLDER).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_families_and_edges(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = {0: None, 1: "", 2: "Only Two", 3: "only two", 4: "\n \t", 5: "x " * 20_000, 6: "X " * 20_000}
    for i in range(10, 90):  # a family whose members mostly resemble each other without a link to the original
        words = list(base)
        for k in rng.choice(120, 3 + i % 5, replace=False):
            words[k] = words[k - 1]
        texts[i] = " ".join(words)
    for i in range(90, 120):
        texts[i] = " ".join(base)
    schema = "doc_id bigint, text string, node string, n int, label string, bucket string"
    table = spark.createDataFrame([(i, t, "clash", 1, "x", "y") for i, t in texts.items()], schema)
    few, N.FEW, block, N.BLOCK = N.FEW, 4, N.BLOCK, 16
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(table, 5, (80, 100)).collect()}
    finally:
        N.FEW, N.BLOCK = few, block
    assert got == classes_by_definition(texts, 5, 80, 100)
    assert N.near_duplicates(table.where("false")).count() == 0


def test_repeated_and_null_ids(spark):
    table = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "q r s t u")], "doc_id bigint, text string")
    rows = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in N.near_duplicates(table).collect())
    assert rows == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 7, True)]


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, 200).astype(np.uint64)) for _ in range(9)]
    got = N._intersections(sets[:4], sets[4:], step=64)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]).all()


def test_short_texts_are_one_shingle():
    hashes = WordHashes()
    assert len(N.text_set("One two", 3, hashes)) == 1 and len(N.text_set("", 3, hashes)) == 0
    assert (N.text_set("ONE two", 3, hashes) == N.text_set("one two", 3, hashes)).all()


def test_pipeline_takes_effect(spark):
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    judged = {r.doc_id: r.kept for r in Q.op8_quality_rules(spark, folder).collect()}
    first = P.quality_rules(spark, docs, folder).cache()
    assert {r.doc_id for r in first.select("doc_id").collect()} == {i for i, kept in judged.items() if kept}
    assert first.columns == P.COLUMNS
    final = P.run(spark, folder).collect()
    ids = {r.doc_id for r in final}
    assert ids and ids <= {i for i, kept in judged.items() if kept} and all(r.copies in (1, 2) for r in final)
    leaked = {r.doc_id for r in Q.op9_benchmark_leaks(spark, folder).collect()}
    assert not ids & leaked
    docs.unpersist()
    first.unpersist()


def test_near_dedup_keeps_one_row_of_repeats_and_null_ids(spark):
    import corpus_pipeline as P

    one, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    near = one + " tail"
    rows = [(5, one), (5, one), (-3, near), (7, other), (7, third), (None, third), (None, third), (None, other), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect()), key=str)
    assert kept == sorted([(-3, near), (7, other), (7, third), (9, None), (9, None)], key=str)
    alone = [r.text for r in P.near_dedup(spark, docs.where("doc_id is null"), "").collect()]
    assert sorted(alone) == [other, third]


def test_mix_returns_the_text_of_its_rows(spark):
    import corpus_pipeline as P

    rows = [(i % 40 if i % 5 else None, f"text{i} " + "w " * (i % 11), f"s{i % 3}" if i % 7 else None) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = P.mix(spark, docs, "").collect()
    want = P.mixing.mix_sources(docs).where("copies > 0").collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.copies, r.taken))
    assert sorted(map(key, mixed)) == sorted(map(key, want))
    assert len({r.text for r in mixed}) == len(mixed) and {(r.doc_id, r.text, r.source) for r in mixed} <= set(rows)


def smallest_reachable(pairs):
    head = {x: x for p in pairs for x in p}
    while any(head[a] != head[b] for a, b in pairs):
        for a, b in pairs:
            head[a] = head[b] = min(head[a], head[b])
    return head


def test_components_do_not_read_joined_edges_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    family = [(n, 10_000 + int(k)) for n in range(240) for k in rng.choice(20, 12, replace=False)]
    chain = [(20_000 + i, 20_001 + i) for i in range(40)]
    alike = [(30_000, 30_000), (30_001, 30_000), (30_000, 30_001)]
    pairs = family + chain + alike
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    sizes, kind = [], type(edges)
    join = kind.join

    def counted(self, *args):
        out = join(self, *args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(kind, "join", counted)
    got = {r.node: r.label for r in N.components(edges).collect()}
    monkeypatch.undo()
    assert got == smallest_reachable(pairs)
    assert sum(sizes) < 4 * len(pairs)
    assert N.components(edges.where("false")).count() == 0


def test_more_links_join_classes(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node bigint, label bigint")
    more = spark.createDataFrame([(2, 6), (6, 7), (8, 9), (3, 4)], "a bigint, b bigint")
    got = {r.node: r.label for r in N._joined_classes(labels, more).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8, 3: 3, 4: 3}


def test_texts_are_found_in_slices(spark, monkeypatch):
    written, write = [], N.write_table

    def spy(df):
        written.append(df.columns)
        return write(df)

    monkeypatch.setattr(N, "write_table", spy)
    texts = {i: f"{'ÀÉ ab' if i % 2 else 'Zz cd'} {i // 2}" for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (None, "null id")], "doc_id bigint, text string")
    key = lambda t: N.set_key(N.text_set(t, 2, WordHashes()))
    ids = spark.createDataFrame([(i, key(t)) for i, t in texts.items()] + [(None, key("null id"))], "_id bigint, node binary")
    got = {bytes(r.node): r.text for r in N._node_texts(docs, ids, 2).collect()}
    assert got == {key(t): t for t in [*texts.values(), "null id"]} and written == [["node", "text"]] * N.SLICES


def test_words_of_bytes_are_the_words_of_the_text():
    from wavelake.llm.common import LOWER_ASCII, WORDS

    hashes = WordHashes()
    for text in ("", " \t\n\x0b\x0c\r ", "A B   ÄÖ\x1cX\x85Yİ I\x0bJ", "lone \ud800 K\x00L"):
        want = hashes.of(WORDS.findall(text.translate(LOWER_ASCII)))
        assert (hashes.of_text(text) == want).all() and len(hashes.of_text(text)) == len(want)


def test_texts_of_nodes_are_one_scan(spark):
    rows = [(i, f"text number {i} of a few") for i in range(40)] + [(None, "without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = WordHashes()
    nodes = {N.set_key(N.text_set(t, 3, hashes)): t for _, t in rows}
    ids = spark.createDataFrame([(i, n) for (i, _), n in zip(rows, nodes)], "_id long, node binary")
    found = N._node_texts(docs, ids, 3)
    assert "Union" not in found._jdf.queryExecution().toString()  # a union of parts is planned anew by every reader
    assert {bytes(r.node): r.text for r in found.collect()} == nodes
