"""Personal data, language, toxicity, quality, benchmark leaks and page text."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wavelake.llm import contamination, extraction, language, pii, quality, toxicity
from wavelake.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
NULLS = [(None, None), (1, None), (2, ""), (3, "word " * 30_000), (3, "word " * 30_000), (4, "x" * 200_000), (5, "\n\t \x0b")]
SCHEMA = "doc_id bigint, text string, score string, kept int, p string, q string, t string"


def edge_table(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "clash", 1, "p", "q", "t") for i, t in NULLS], SCHEMA)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


# Personal data --------------------------------------------------------------------------------------------------


def pii_by_definition(text):
    def luhn(d):
        return sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0

    def digits(m):
        return [int(c) for c in m[0] if c in "0123456789"]

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if good(m)] for k, (p, good) in kinds.items()}


def test_base_spans_by_definition():
    rng = random.Random(3)
    pieces = ["ab@.-", "0123456789", "0123. ", "+ ()1-", "a@b.c", "4", "\n ", "é🙂"]
    for _ in range(5000):
        text = "".join(rng.choice(rng.choice(pieces)) for _ in range(rng.randint(0, 60)))
        assert pii.find(text)[0] == pii_by_definition(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write john.doe [at] mail (dot) example (dot) com now", "email", "john.doe [at] mail (dot) example (dot) com"),
        ("mail john at example dot com please", "email", "john at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("xy@a​.com", "email", "xy@a​.com"),
        ("１９２.168.0.1 end", "ip", "１９２.168.0.1"),
        ("call +one four one five five five five two six seven one today", "phone", "+one four one five five five five two six seven one"),
        ("pay four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, added = pii.find(text)
    spans = sorted(base[kind] + added[kind])
    assert found in [text[s:e] for s, e in spans] or [text[s:e] for s, e in added[kind]] == [found]


@pytest.mark.parametrize(
    ("text", "kind", "base", "whole"),
    [
        ("to jоhn@example.com now", "email", "hn@example.com", "jоhn@example.com"),
        ("to john@example.cоm now", "email", "john@example.c", "john@example.cоm"),
        ("to john@example.c\u200bom now", "email", "john@example.c", "john@example.c\u200bom"),
        ("to ann@mail4.example [dot] com now", "email", "ann@mail4.example", "ann@mail4.example [dot] com"),
        ("call +49 30 55512\uff13\uff14 now", "phone", "+49 30 55512", "+49 30 55512\uff13\uff14"),
    ],
)
def test_a_fragment_does_not_hide_the_whole_identifier(text, kind, base, whole):
    found = pii.find(text)
    assert [text[s:e] for s, e in found[0][kind]] == [base]
    assert [text[s:e] for s, e in found[1][kind]] == [whole]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("call +४९ ३० ५५५१२३४ now", "phone", "+४९ ३० ५५५१२३४"),
        ("call +๔๙ 30 5551234 now", "phone", "+๔๙ 30 5551234"),
        ("call +৪৯ 30 5551234 now", "phone", "+৪৯ 30 5551234"),
        ("from 𝟏𝟗𝟐.168.0.1 on", "ip", "𝟏𝟗𝟐.168.0.1"),
        ("mail john@example dot com now", "email", "john@example dot com"),
        ("mail john at example.com now", "email", "john at example.com"),
        ("mail jo at mail dot example dot com now", "email", "jo at mail dot example dot com"),
        ("call +49 30 five five five 1234 now", "phone", "+49 30 five five five 1234"),
        ("call +49 (30) 555123 four now", "phone", "+49 (30) 555123 four"),
        ("call plus 49 30 5551234 now", "phone", "plus 49 30 5551234"),
        ("call plus four nine 30 555 12 34 now", "phone", "plus four nine 30 555 12 34"),
        ("pay 4111 1111 1111 111 one now", "card", "4111 1111 1111 111 one"),
        ("pay four 111 1111 1111 1111 now", "card", "four 111 1111 1111 1111"),
        ("host 192.168.0.one up", "ip", "192.168.0.one"),
        ("host one.one.one.one up", "ip", "one.one.one.one"),
    ],
)
def test_one_disguised_part_is_enough(text, kind, found):
    assert found in [text[s:e] for s, e in pii.find(text)[1][kind]]


def test_sentences_are_no_addresses():
    for text in ("look at example.com", "he was at home.The end", "open at 10.30 or 11.45", "run\nat java.lang.Thread", "ſix ſeven"):
        assert not any(pii.find(text)[1].values())


def test_what_the_base_finds_whole_is_not_added_again():
    text = "а mail john@example.com and +49 30 5551234, card 4111 1111 1111 1111 and 10.0.0.1"
    assert not any(pii.find(text)[1].values())


def test_clean_text_has_no_identifiers():
    for text in ("at the end. the at of than dot", "one two three four", "a dot at b", "un deux un un un"):
        assert pii.find(text) == ({k: [] for k in pii.KINDS}, {k: [] for k in pii.KINDS})


def test_identifier_query_by_definition(spark):
    source = texts(spark)
    for r in Q.op3_personal_data(spark, FOLDER).collect():
        want = pii_by_definition(source[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, want.values()))
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()


def test_identifier_edges(spark):
    rows = pii.find_identifiers(edge_table(spark)).collect()
    assert len(rows) == len(NULLS) and all(r.spans == "" and r.kind == [] for r in rows)
    assert pii.find_identifiers(edge_table(spark).where("false")).count() == 0


# Language -------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.op4_language(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    learn = spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, "de"), (4, "un", None)], "doc_id bigint, text string, lang string")
    model = language.fit_languages(learn)
    assert model.languages == ["en", "fr"]
    got = [r.lang_pred for r in language.identify_languages(edge_table(spark), model).collect()]
    assert got.count("und") == 4
    nothing = language.fit_languages(learn.where("false"))
    assert {r.lang_pred for r in language.identify_languages(edge_table(spark), nothing).collect()} == {"und"}


def test_backoff_goes_to_shorter_grams():
    import pandas as pd

    model = language.fit_rows(pd.DataFrame.from_records([("aaa bbb aaa aab", "x"), ("ccc ddd ccc ccd", "y")], columns=["text", "label"]))
    assert "aaa" in model.words and "zaa" not in model.words
    assert model.word("zaa")[0] > model.word("zaa")[1] and model.word("qqq") == (0.0, 0.0)


# Toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(300)])
    rows = []
    for i in range(900):
        body = list(rng.choice(words, 60))
        label = i % 4 == 0
        if label:
            body[10:12] = ["you", "grobian"] if i % 8 else ["ID1OT", "you"]
        rows.append((i, " ".join(body), int(label)))
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "label"])
    model = toxicity.fit_rows(frame[:700])
    bits = toxicity.WordBits(model.lexicons)
    score = model.score(np.array([toxicity.dense_features(t, bits) for t in frame["text"][700:]]))
    assert np.mean((score >= 0.5) == frame["label"][700:].to_numpy()) > 0.97
    assert toxicity.fit_rows(frame[frame["label"] == 0]) is None
    edges = toxicity.score_documents(edge_table(spark), model).collect()
    assert len(edges) == len(NULLS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in edges)
    assert {r.score for r in toxicity.score_documents(edge_table(spark), None).collect()} == {0.0}


def test_isotonic_pools_what_is_out_of_order():
    from wavelake.llm.fitting import isotonic, platt_scale

    knots, heights = isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert np.all(np.diff(heights) >= 0) and np.interp(2.5, knots, heights) == pytest.approx(0.5)
    a, _ = platt_scale(np.array([-2.0, -1, 1, 2]), np.array([0.0, 0, 1, 1]))
    assert a > 0


# Quality --------------------------------------------------------------------------------------------------------


def counts_by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_counts_by_definition(spark):
    source = {i: t for i, t in texts(spark).items() if len(t) < 4000}
    for r in Q.op8_quality_rules(spark, FOLDER).collect():
        if r.doc_id in source:
            want = counts_by_definition(source[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_model_and_edges(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice(["river", "stone", "bright", "walks", "under"], 80) + np.char.mod("%d", rng.integers(0, 99, 80))) for _ in range(40)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 80, 2)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.fit_quality(table, labels)
    rows = quality.score_documents(table, model).collect()
    assert np.mean([r.kept == (r.doc_id < 40) for r in rows]) > 0.97
    assert quality.fit_quality(table, labels.where("quality = 1")) is None
    edges = quality.score_documents(edge_table(spark), None).collect()
    assert len(edges) == len(NULLS) and not any(r.kept for r in edges if r.doc_id != 3) and all(r.good is None for r in edges)


# Benchmark leaks ------------------------------------------------------------------------------------------------


def test_search_equals_scoring_everything():
    rng = np.random.default_rng(8)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 40)))) for i in range(60)]
    frequency = {}
    for _, t in items:
        for w in set(contamination.tokens(t)):
            frequency[w] = frequency.get(w, 0) + 1
    index = contamination.build_index(items, frequency, len(items), 22.0)
    for _ in range(60):
        words = list(rng.choice(vocabulary + ["other"] * 300, rng.integers(1, 300)))
        words[5:5] = contamination.tokens(items[rng.integers(60)][1])
        expected = {}
        for passage in range(max(1, -(-len(words) // index.half) - 1)):
            query = set(words[passage * index.half : (passage + 2) * index.half])
            for place in range(len(items)):
                score = 0.0
                for term in query & set(index.vocabulary):
                    span = slice(*index.first[index.vocabulary[term] : index.vocabulary[term] + 2])
                    score += index.impact[span][index.item[span] == place].sum()
                if score >= 0.4:
                    expected[place] = max(score, expected.get(place, 0))
        got = {k: v[0] for k, v in contamination.search(index, words, 0.4).items()}
        assert got == pytest.approx(expected)


def test_leaks_need_question_and_answer(spark):
    question, answer = "Which river runs past the old mill of Arden?", "The silver Wend does."
    items = spark.createDataFrame([(7, f"{question} {answer}"), (8, None), (9, ""), (7, f"{question} {answer}")], "item_id bigint, text string")
    filler = "lorem ipsum dolor sit amet " * 40
    rows = [(1, filler + f"{question.upper()} {answer} " + filler), (2, filler + question + filler), (3, None), (None, f"{question} {answer}")]
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, score string")
    found = contamination.contaminated_pairs(table, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (None, 7)}
    assert {r.doc_id for r in contamination.clean_documents(table, items).collect()} == {2, 3}
    assert contamination.contaminated_pairs(table, items.where("false")).count() == 0
    assert contamination.contaminated_pairs(edge_table(spark), items).count() == 0


def leaked(text, item, fillers=()):
    rows = [(0, item), *((i + 1, f) for i, f in enumerate(fillers))]
    frequency = {}
    for _, t in rows:
        for w in set(contamination.tokens(t)):
            frequency[w] = frequency.get(w, 0) + 1
    index = contamination.build_index(rows, frequency, len(rows), 12.0)
    return 0 in contamination.verified(index, contamination.tokens(text), 0.7, 0.6, 0.6)


def test_every_passage_above_the_threshold_is_verified():
    item = "Which river runs past the old stone mill of Arden in the spring? The silver Wend does so."
    shuffled = " ".join(sorted(contamination.tokens(item)))
    gap = " filler" * 60 + " "
    edited = item.replace("old stone", "ancient stone")
    for copy in (item, edited):
        assert leaked(shuffled + gap + copy, item) and leaked(copy + gap + shuffled, item)
    assert not leaked(shuffled + gap + shuffled, item)


def test_one_changed_word_in_a_short_answer():
    question = "Which river runs past the old stone mill of Arden in the spring of every year?"
    for answer in ("The golden Wend does.", "The Wend does.", "The silver old Wend does."):
        assert leaked(f"{question} {answer}", f"{question} The silver Wend does.")
    assert not leaked(f"{question} A golden Rhine does.", f"{question} The silver Wend does.")
    assert contamination.overlap(["a", "b"], ["a", "c"]) == 0 and contamination.overlap(["a"], ["b"]) == 0


def test_leak_query_finds_all_whole_items(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts(spark).items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in Q.op9_benchmark_leaks(spark, FOLDER).collect()}
    assert want <= got and all(d in {x for x, _ in want} for d, _ in got)


# Page text ------------------------------------------------------------------------------------------------------


def test_pages_by_definition(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in Q.op10_main_text(spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        lines = []
        for part in re.split(r"</?(?:p|h1)>", article):
            lines.append(" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", part)).split()))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-ads", "nav-fixed", "page-with-banner", "sidebar", "widget"])
def test_a_name_on_a_wrapper_does_not_empty_the_page(name):
    body = "".join(f"<p>Paragraph {i} tells a long and winding story about the sea and the men on it.</p>" for i in range(8))
    for title in ("<h1>Title</h1>", ""):
        page = f'<html><body><div class="{name}"><div>{title}{body}</div></div><div class="ad">Buy this now</div></body></html>'
        text = extraction.main_text(page)
        assert text.count("Paragraph") == 8 and "Buy" not in text and ("Title" in text) == bool(title)


def test_a_form_around_the_page_does_not_empty_it():
    """Server pages lie in one form as a whole; the controls in it still go, and other forms go altogether."""
    words = "The river rose in the night and the lower road was under water before the morning came to the village."
    body = "".join(f"<p>{i} {words}</p>" for i in range(6))
    search = "<form><h1>Search</h1><label>Find</label><input value=x><button>Go</button></form>"
    for page in (
        f"<html><body><form action='/'><div>{body}<button>Send</button><select><option>one</select></div></form></body></html>",
        f"<html><body>{search}<form id=page><main>{body}</main></form></body></html>",
        f"<html><body><div>{body}</div>{search}</body></html>",
    ):
        assert extraction.main_text(page).split("\n") == [f"{i} {words}" for i in range(6)]
    assert extraction.main_text(f"<html><body>{search}</body></html>") == ""


def test_names_inside_an_article_are_hints():
    body = "".join(f"<p>Paragraph {i} tells a long and winding story about the sea and the men on it.</p>" for i in range(8))
    parts = '<h1 class="entry-header">Head</h1>', body, '<section id="related-work"><p>Others wrote of this.</p></section>', '<p class="notice-period">A month is due.</p>'
    noise = '<div class="ad-box sidebar">One</div><p>x <span class="ad">Two</span></p><div id="comments"><article class="comment">Three</article></div>'
    text = extraction.main_text(f"<html><body><article>{''.join(parts)}{noise}</article></body></html>")
    assert all(x in text for x in ("Head", "Paragraph 7", "Others wrote", "A month")) and not any(x in text for x in ("One", "Two"))
    assert "Three" not in text


def test_density_without_names():
    links = "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(30))
    body = "".join(f"<p>Paragraph {i} tells a long and winding story about the sea and the men on it.</p>" for i in range(8))
    page = f"<html><body><div><ul>{links}</ul></div><div><h2>Title &amp; more</h2>{body}</div><div><a href=x>a</a> <a href=y>b</a></div></body></html>"
    text = extraction.main_text(page)
    assert text.startswith("Title & more\nParagraph 0") and text.count("\n") == 8 and "entry" not in text


@pytest.mark.parametrize("page", [None, "", "<", "<html>", "<p>", "<!-- <p>x</p>", "<script>var a='<p>x</p>'", "<div class='comments'><p>nice post</p></div>"])
def test_pages_without_text(page):
    assert extraction.main_text(page) in ("", "<")


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "clash"), (None, "u", "<p>a<p>b &lt; c" + " d" * 50_000, "x"), (2, "u", "<div>" * 5000 + "deep", "")], "page_id bigint, url string, html string, text string")
    rows = {r.page_id: r for r in extraction.extract_pages(pages).collect()}
    assert rows[1].text == "" and rows[None].text.startswith("a\nb < c d d") and rows[2].text == "deep"
