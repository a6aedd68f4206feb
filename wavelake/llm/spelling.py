"""Groups spelling variants: words one edit apart are found by partition-and-enumerate signatures of letter multisets.

One inserted, deleted or replaced letter changes the multiset of letters of a word by at most two elements, so words
that are near have multisets at a Hamming distance of one (unlike lengths) or of at most two (like lengths). The
elements are dealt to a few parts; two sets at distance k differ in k parts at most, so they agree on at least one
choice of all parts but k. Each such choice gives an exact signature, signatures meet in an equi-join, and every pair
that meets is verified. Such words also have their first or their last half in common, so each signature is made twice,
with either half in it, which keeps the words that share one few. No pair of near words is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import write_table

#: Maximal runs of these code points are words (of enough letters).
LETTERS = "A-Za-zÀ-ÿ"
MIN_LETTERS = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Parts of the elements for words of like lengths (distance two) and of unlike lengths (distance one).
PARTS = {2: 3, 1: 2}


def damaged_runs(docs: DataFrame, every: int = 31, least: int = MIN_LETTERS) -> DataFrame:
    """One row ``word`` for each run of letters of every whole text, with one letter deleted in one of ``every`` runs.

    h is the unsigned crc32 of ``<doc_id>:<run>``, the run with A-Z lower-cased; where ``every`` divides h, the code
    point h % length goes. A null doc_id counts as the text ``null``. Runs too short for ``least`` letters are left out,
    as deleting never lengthens a word; null and empty texts give no row. Repeated rows count as often as they occur.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lower, F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return rows.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = MIN_LETTERS, count: int = MIN_COUNT) -> DataFrame:
    """Distinct words (``word``, ``n``) of at least ``least`` code points and ``count`` occurrences."""
    counted = words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= count)


def _elements(word: str) -> list[tuple[str, int]]:
    """The letter multiset as a set: the k-th occurrence of a letter is an element of its own."""
    seen: dict[str, int] = {}
    found = []
    for letter in word:
        k = seen[letter] = seen.get(letter, -1) + 1
        found.append((letter, k))
    return sorted(found)


def multiset_signatures(word: str, distance: int, least: int) -> list[int]:
    """Signatures of a word for pairs of which the shorter has ``least`` letters; see the head of this module.

    The common prefix and the common suffix of two words one edit apart cover all but one letter of the shorter one, so
    one of them has half of these.
    """
    parts = PARTS[distance]
    texts = [""] * parts
    for letter, k in _elements(word):
        texts[(ord(letter) * 7 + k * 3) % parts] += f"{letter}{k}"
    half = least // 2
    halves = f"^{word[:half]}", f"{word[len(word) - half :]}$"
    found = []
    for chosen in combinations(range(parts), parts - distance):
        text = f"{distance}:{least}:{chosen}:" + "|".join(texts[p] for p in chosen)
        for shared in halves:
            found.append(xxhash.xxh3_64_intdigest(f"{text}:{shared}".encode("utf-8", "surrogatepass")) - (1 << 63))
    return found


def _signed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each word and signature."""
    for batch in batches:
        rows = []
        for word, n in zip(batch["word"], batch["n"]):
            length = len(word)
            rows += [(word, n, sig) for sig in multiset_signatures(word, 2, length)]
            for least in (length - 1, length):
                rows += [(word, n, sig) for sig in multiset_signatures(word, 1, least)]
        yield pd.DataFrame(rows, columns=["word", "n", "sig"])


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of distinct words that differ by one inserted, deleted or replaced code point, each once.

    ``words`` has ``word`` and ``n``; the pairs carry both words and counts as ``word_a < word_b``, ``n_a``, ``n_b``.
    """
    signed = words.select("word", "n").mapInPandas(_signed_rows, "word string, n long, sig long")
    a, b = (signed.select(*(F.col(c).alias(f"{c}_{side}") for c in signed.columns)) for side in "ab")
    met = (F.col("sig_a") == F.col("sig_b")) & (F.col("word_a") < F.col("word_b"))
    near = F.levenshtein("word_a", "word_b", 1) == 1
    return a.join(b, met & near).select("word_a", "n_a", "word_b", "n_b").distinct()


def _best_form(word: Column, n: Column) -> Column:
    """Of several near words the most frequent one, ties to the smallest in code-point order."""
    best = F.min_by(F.struct(word.alias("form"), n.alias("form_n")), F.struct((-n).alias("less"), word.alias("word")))
    return best


def group_spellings(words: DataFrame) -> DataFrame:
    """Each word with its near words' number, its form (or null) and the root that its chain of forms ends at.

    ``words`` has one row for each ``word`` with its count ``n``; other columns are ignored, and so are rows without a
    word. A form is the most frequent near word (ties: the smallest), if it is RATIO times as frequent. An empty table
    gives no rows.
    """
    words = write_table(words.select("word", "n").where("word is not null"))
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("word_a").alias("at"), F.col("word_b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("word_b").alias("at"), F.col("word_a").alias("other"), F.col("n_a").alias("other_n")),
    )
    best = (
        pairs.select(F.explode(sides).alias("s"))
        .groupBy(F.col("s.at").alias("at"))
        .agg(F.count(F.lit(1)).alias("n_near"), _best_form(F.col("s.other"), F.col("s.other_n")).alias("best"))
    )
    joined = words.join(best, F.col("word") == F.col("at"), "left")
    frequent = F.col("best.form_n") >= RATIO * F.col("n")
    formed = write_table(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("best.form")).alias("form"),
            F.when(frequent, F.col("best.form_n")).alias("form_n"),
        )
    )
    steps = formed.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("to"))
    moved = True
    while moved:  # doubles the steps each time; counts grow RATIO times along a chain, so no chain is long
        onward = steps.select(F.col("at").alias("_at"), F.col("to").alias("_to"))
        further = steps.join(onward, F.col("to") == F.col("_at"), "left")
        further = write_table(further.select("at", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("on")))
        moved, steps = not further.where("on").isEmpty(), further.select("at", "to")
    rooted = formed.join(steps, F.col("word") == F.col("at"), "left")
    return rooted.select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Spelling variants among all words of whole ``docs`` texts; see `damaged_runs`, `vocabulary`, `group_spellings`."""
    return group_spellings(vocabulary(damaged_runs(docs)))


#: The same by another way: every word with one letter left out (or masked) meets its like; crc32 by its bitwise rule.
SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), long_runs AS (
  SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL
), crc AS (
  SELECT run, times, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(coalesce(doc_id::VARCHAR, 'null') || ':' || run, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT]
                ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END))),
    lambda s, b: xor(s >> 8, tab.t[(xor(s, b) & 255) + 1]))) AS h
  FROM long_runs, (
    SELECT list(v ORDER BY i) AS t FROM (
      SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda s, _: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END) AS v
      FROM range(256) r(i))) tab
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0
      THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), masked AS (
  SELECT word, n, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS k FROM places
), shorter AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM places
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.k = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.k = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n
  FROM near GROUP BY word, n
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, e.root FROM formed f JOIN ends e ON f.word = e.word
"""
