"""Secrets: key formats by pattern, other random strings by character Markov models. DataFrame functions only."""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they must capture.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models judge, and learn ordinary identifiers from.
LEARNED = r"[A-Za-z0-9+/_-]{12,}={0,2}"
#: A shorter string needs its share of the total, and a stretch of a run a piece without separators.
FULL_LENGTH = 20
LEAST_LENGTH = 12
PIECE = r"[A-Za-z0-9]{8}"
#: Codes of characters are below this.
CODES = 128
SPAN = "struct<start:int,kind:int,end:int>"


def _empty() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def _found(text: Column, pattern: str, kind: int, keep=None, parts=None) -> Column:
    """Spans of the leftmost non-overlapping matches, from the lengths of the matches and of the pieces between them.

    ``keep`` says which matches count; ``parts`` gives what of a match counts, as structs (first, end).
    """
    kind_lit = F.lit(kind)
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")),
    )
    start = F.struct(F.lit(0).alias("at"), _empty().alias("out"))

    def step(acc, x):
        first = (acc["at"] + x["gap"]).cast("int")
        last = (first + F.coalesce(F.length(x["match"]), F.lit(0))).cast("int")
        if parts is not None:
            place = lambda p: F.struct(
                (first + p["first"]).cast("int").alias("start"), kind_lit.alias("kind"), (first + p["end"]).cast("int").alias("end")
            )
            found = F.transform(parts(x["match"]), place)
            return F.struct(
                last.alias("at"),
                F.when(x["match"].isNotNull(), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"),
            )
        good = x["match"].isNotNull() if keep is None else F.coalesce(keep(x["match"]), F.lit(False))
        span = F.struct(first.alias("start"), kind_lit.alias("kind"), last.alias("end"))
        return F.struct(
            last.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")
        )

    spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(_empty())


def base_spans(text: Column) -> Column:
    """Sorted spans of the three fixed patterns, as structs (start, kind, end)."""
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    return F.array_sort(
        F.concat(_found(text, ASSIGN, 0, long_value), _found(text, ACCESS, 1), _found(text, HEX, 2))
    )


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, random, n): what the fixed patterns capture counts as random, other long tokens as ordinary."""
    text = F.coalesce(F.col("text"), F.lit(""))
    values = lambda p, group: F.when(
        text.rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(group))
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return (
        docs.select(
            F.filter(F.concat(values(ASSIGN, 2), values(ACCESS, 0), values(HEX, 0)), lambda v: F.length(v) >= 12).alias(
                "secrets"
            ),
            F.regexp_extract_all(text, F.lit(LEARNED), F.lit(0)).alias("tokens"),
        )
        .select(
            F.explode(
                F.concat(
                    F.transform("secrets", lambda t: F.struct(t.alias("token"), F.lit(True).alias("random"))),
                    F.transform(
                        F.filter("tokens", lambda t: ~F.exists("secrets", lambda s: F.contains(s, t) | F.contains(t, s))),
                        lambda t: F.struct(t.alias("token"), F.lit(False).alias("random")),
                    ),
                )
            ).alias("x")
        )
        .groupBy("x.token", "x.random")
        .agg(F.count("*").alias("n"))
    )


def fit_weights(samples: DataFrame, smoothing: float = 1.0) -> list[float]:
    """Log ratio of the two models for each pair of neighbours, at index 128 x first + second.

    Pairs are counted over all samples on the cluster; what comes back is at most one row for each pair of characters
    and label. A string counts once per label however often it is repeated. The random model is smoothed toward even
    odds of all characters, the ordinary one toward the frequencies of its characters, so pairs that neither has seen
    lean to random as far as their second character is rare in ordinary strings. Without samples every weight is 0.
    """
    pairs = (
        samples.select("random", F.split("token", "").alias("c"))
        .select(
            "random",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("c") - 1),
                    lambda i: F.ascii(F.element_at("c", i)) * CODES + F.ascii(F.element_at("c", i + 1)),
                )
            ).alias("pair"),
        )
        .where(F.col("pair").between(0, CODES * CODES - 1))
        .groupBy("random", "pair")
        .agg(F.count("*").alias("n"))
    )
    counts: dict[bool, dict[int, int]] = {True: defaultdict(int), False: defaultdict(int)}
    for row in pairs.collect():  # at most 2 x 128 x 128 rows
        counts[row.random][row.pair] += row.n
    alphabet = 67  # letters, digits and + / _ - =
    firsts = {k: defaultdict(int) for k in counts}
    seconds: dict[int, int] = defaultdict(int)
    for label, by_pair in counts.items():
        for pair, n in by_pair.items():
            firsts[label][pair // CODES] += n
            if not label:
                seconds[pair % CODES] += n
    common = sum(seconds.values()) + 0.5 * alphabet

    def logp(label: bool, pair: int) -> float:
        prior = 1 / alphabet if label or not seconds else (seconds[pair % CODES] + 0.5) / common
        strength = smoothing * alphabet
        return math.log((counts[label][pair] + strength * prior) / (firsts[label][pair // CODES] + strength))

    return [round(logp(True, k) - logp(False, k), 4) for k in range(CODES * CODES)]


def _gains(token: Column, weights: list[float]) -> Column:
    """Log ratio of each pair of neighbours of a token, and a null at the end."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # folded to a constant by the optimizer
    codes = F.transform(F.split(token, ""), F.ascii)
    return F.zip_with(codes, F.slice(codes, 2, 1 << 30), lambda a, b: F.get(table, a * CODES + b))


def random_spans(token: Column, weights: list[float], least_total: float, least_mean: float) -> Column:
    """Spans of a token that look random, as structs (first, end): the whole token, or else stretches of it.

    One pass keeps the total and a running sum. The sum starts anew where it falls to zero or by ``least_total`` below
    its peak, so a key stands out from ordinary words joined to it. A stretch goes from the start of a sum to its peak
    and is widened to the next separators; a separator at its border, with one character of the word beyond it, goes.
    """
    int_of = lambda k: F.lit(k).cast("int")
    start = F.struct(
        int_of(0).alias("at"),
        F.lit(0.0).alias("total"),
        F.lit(0.0).alias("sum"),
        int_of(0).alias("first"),
        F.lit(0.0).alias("peak"),
        int_of(0).alias("end"),
        F.expr("cast(array() as array<struct<first:int,end:int>>)").alias("out"),
    )

    def enough(total: Column, pairs: Column) -> Column:
        share = F.least(F.lit(1.0), F.greatest(pairs, F.lit(LEAST_LENGTH - 1)) / F.lit(float(FULL_LENGTH - 1)))
        return (total >= least_total * share) & (total >= least_mean * pairs)

    def step(acc, gain):
        total = acc["sum"] + gain
        stop = gain.isNull() | (total <= 0) | (total < acc["peak"] - least_total)
        good = stop & enough(acc["peak"], acc["end"] - acc["first"] - 1)
        after = (acc["at"] + 1).cast("int")
        span = F.struct(acc["first"].alias("first"), acc["end"].alias("end"))
        return F.struct(
            after.alias("at"),
            (acc["total"] + F.coalesce(gain, F.lit(0.0))).alias("total"),
            F.when(stop, 0.0).otherwise(total).alias("sum"),
            F.when(stop, after).otherwise(acc["first"]).alias("first"),
            F.when(stop, 0.0).otherwise(F.greatest(acc["peak"], total)).alias("peak"),
            F.when(~stop & (total > acc["peak"]), (after + 1).cast("int")).otherwise(acc["end"]).alias("end"),
            F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    length = F.length(token)

    def widened(s):
        before = F.length(F.regexp_extract(F.substring(token, F.lit(1), s["first"]), "[A-Za-z0-9]*$", 0))
        inner = token.substr(s["first"] + 1, s["end"] - s["first"])
        lead = F.length(F.regexp_extract(inner, "^[A-Za-z0-9]?[+/_-]+", 0))
        trail = F.length(F.regexp_extract(inner, "[+/_-]+[A-Za-z0-9]?$", 0))
        after = F.length(F.regexp_extract(token.substr(s["end"] + 1, length), "^[A-Za-z0-9]*=*", 0))
        return F.struct(
            F.when(lead > 0, s["first"] + lead).otherwise(s["first"] - before).cast("int").alias("first"),
            F.when(trail > 0, s["end"] - trail).otherwise(s["end"] + after).cast("int").alias("end"),
        )

    def decide(acc):
        whole = F.array(F.struct(int_of(0).alias("first"), length.cast("int").alias("end")))
        stretches = F.filter(acc["out"], lambda s: token.substr(s["first"] + 1, s["end"] - s["first"]).rlike(PIECE))
        return F.when(enough(acc["total"], length - 1), whole).otherwise(F.transform(stretches, widened))

    return F.aggregate(_gains(token, weights), start, step, decide)


def _outside(span: Column, base: Column) -> Column:
    """The parts of a span outside sorted base spans."""
    kind = F.lit(KINDS.index("markov"))
    part = lambda first, end: F.array(F.struct(first.alias("start"), kind.alias("kind"), end.alias("end")))
    start = F.struct(span["start"].alias("at"), _empty().alias("out"))

    def step(acc, b):
        last = F.least(b["start"], span["end"])
        return F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.when(last > acc["at"], F.concat(acc["out"], part(acc["at"], last))).otherwise(acc["out"]).alias("out"),
        )

    def end(acc):
        rest = part(acc["at"], span["end"])
        return F.when(acc["at"] < span["end"], F.concat(acc["out"], rest)).otherwise(acc["out"])

    touching = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return F.aggregate(touching, start, step, end)


def find_secrets(
    docs: DataFrame, weights: list[float], least_total: float = 25.0, least_mean: float = 0.8
) -> DataFrame:
    """The rows of ``docs`` with ``base`` (spans of the fixed patterns) and ``added`` (spans found by the models).

    The models judge each maximal run of 12 or more token characters: it is a secret if its log ratio is at least
    ``least_total`` (for less than 20 characters, their share of it) and at least ``least_mean`` for each pair of
    neighbours. Where the whole run is none, its stretches are judged alike. What lies outside base spans is added.
    Spans are arrays of (start, kind, end) in code points, end exclusive; kind indexes ``KINDS``. A null text has no
    spans. Columns of ``docs`` with these two names are replaced. Nothing is shuffled: each text is scanned where it
    is read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = lambda match: random_spans(match, weights, least_total, least_mean)
    split = lambda m: F.filter(
        _outside(m, F.col("base")), lambda s: text.substr(s["start"] + 1, s["end"] - s["start"]).rlike("[A-Za-z0-9]")
    )
    return (
        docs.withColumn("base", base_spans(text))
        .withColumn("added", _found(text, LEARNED, KINDS.index("markov"), parts=judged))
        .withColumn("added", F.when(F.size("base") > 0, F.flatten(F.transform("added", split))).otherwise(F.col("added")))
    )


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``. Spans are sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
        )

    end = lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)
