"""Personal data: base patterns on the text, and disguised identifiers found on a normalised copy of it."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import text_udf

KINDS = ("email", "ip", "card", "phone")
SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "kind array<string>, start array<int>, end array<int>"
)

# The base patterns, in forms that read each character a bounded number of times.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones, in the order of the Latin letters below them.
LOOKALIKES = dict(
    zip(
        "асԁеһіјорѕхуАВСЕНІКМОРЅТХ"
        "ανορΑΒΕΗΙΚΜΝΟΡΤΥΧΖ",
        "acdehijopsxyABCEHIKMOPSTX" "avopABEHIKMNOPTYXZ",
        strict=True,
    )
)
# Characters without width, and names of digits in the four languages of the corpus.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_NAMES = {
    name: str(digit)
    for names in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, name in enumerate(names.split())
} | {"oh": "0"}

#: What each single character is replaced by: lookalikes, full-width forms, digits of any script, none without width.
PLAIN = (
    {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}
    | {c: str(unicodedata.decimal(c)) for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isdecimal()}
    | LOOKALIKES
    | dict.fromkeys(INVISIBLE, "")
)
#: A word, and what may lie between two words of a run of digits: between names, else where digits are on a side.
TOKEN = re.compile(r"\w+")
BETWEEN_NAMES = re.compile(r"[ ,.()-]+")
BETWEEN_DIGITS = re.compile(r"[ ()-]+|\.")
PLUS = "plus"
#: Marks for @ and a dot: bracketed anywhere, plain words only where the other side of the address is.
BRACKETED_AT = re.compile(r"[\[({<]\s*(?:at|@)\s*[\])}>]\s*", re.IGNORECASE)
BRACKETED_DOT = re.compile(r"[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*", re.IGNORECASE)
WORDED = re.compile(
    r"(?<=[A-Za-z0-9._%+-])(?:(?P<at>\s++at\s+)|@)(?P<host>[A-Za-z0-9-]++(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]++)++)(?!\w)",
    re.IGNORECASE | re.ASCII,
)
WORDED_DOT = re.compile(r"\s+dot\s+", re.IGNORECASE)
HOST_DOT = re.compile(r"\s+dot\s+|\.", re.IGNORECASE)
LAST_LABEL = re.compile(r"[A-Za-z]{2,}")
#: Words that come before "at" in a sentence. Before a domain without any disguise they are no local part.
PROSE = frozenset(
    "a all and are arrive arrived ask at available be been buy call called check click contact download find found here "
    "him her host hosted i is it join know live look looked looking looks me meet met more not now off on online or order "
    "out page read register registered see seen site sold start stay stayed that them there they this those up us visit "
    "was we website were work worked working works you".split()
)


Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @: the characters of a local part before it and the domain after it; matches don't overlap."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in LOCAL_CHARACTERS:
            first -= 1
        if first < at and (host := DOMAIN.match(text, at + 1)):
            end = host.end()
            out.append((first, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m.groups()))]


def _digits(text: str, span: Span) -> str:
    return "".join(DIGIT.findall(text, *span))


def cards(text: str) -> list[Span]:
    found = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13]
    return [s for s in found if 13 <= len(d := _digits(text, s)) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(text, m.span())) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


class Tape:
    """A text with, for each character, the source range that it stands for. Each transducer writes a new tape."""

    def __init__(self, text: str, first: Sequence[int] | None = None, last: Sequence[int] | None = None):
        self.text = text
        self.first = range(len(text)) if first is None else first
        self.last = range(1, len(text) + 1) if last is None else last

    def replace(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replaces ranges (in order, apart from each other); every new character stands for its whole range."""
        if not edits:
            return self
        text, first, last, at = [], [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:start])
            first += self.first[at:start]
            last += self.last[at:start]
            if new:
                text.append(new)
                first += [self.first[start]] * len(new)
                last += [self.last[end - 1]] * len(new)
            at = end
        return Tape("".join(text), first, last)

    def source(self, span: Span) -> Span:
        return self.first[span[0]], self.last[span[1] - 1]


def _plain_characters(tape: Tape) -> Tape:
    """Homoglyphs, full-width forms and digits of other scripts as ASCII; characters without width vanish."""
    if tape.text.isascii() or PLAIN.keys().isdisjoint(tape.text):
        return tape
    return tape.replace([(i, i + 1, PLAIN[c]) for i, c in enumerate(tape.text) if c in PLAIN])


def _bracketed(tape: Tape, mark: re.Pattern, new: str) -> Tape:
    edits, end = [], 0
    for m in mark.finditer(tape.text):
        first = m.start()
        while first > end and tape.text[first - 1].isspace():
            first -= 1
        end = m.end()
        edits.append((first, end, new))
    return tape.replace(edits)


def _marks(tape: Tape) -> Tape:
    """Disguised @ and dots. One disguise is enough: ``name@host dot domain`` and ``name at host.domain`` count too."""
    if any(c in tape.text for c in "[({<"):
        tape = _bracketed(_bracketed(tape, BRACKETED_AT, "@"), BRACKETED_DOT, ".")
    edits = []
    for m in WORDED.finditer(tape.text):
        first, last = m.span("host")
        # The domain ends with its last label that can be one.
        dots = list(HOST_DOT.finditer(tape.text, first, last))
        while dots and not LAST_LABEL.fullmatch(tape.text, dots[-1].end(), last):
            last = dots.pop().start()
        spelled = [d.span() for d in dots if d.group() != "."]
        if not dots or not (spelled or m["at"]):
            continue
        if m["at"]:
            if not spelled and not _addressed(tape.text, m, last):
                continue
            edits.append((*m.span("at"), "@"))
        edits += [(*d, ".") for d in spelled]
    return tape.replace(edits)


def _addressed(text: str, m: re.Match, last: int) -> bool:
    """Whether ``word at domain``, all else written out, can be an address and no sentence or two of them."""
    start = m.start()
    while start > 0 and text[start - 1] in LOCAL_CHARACTERS:
        start -= 1
    end = text[text.rindex(".", 0, last) + 1 : last]
    one_case = end.islower() or text[m.start("host") : last].isupper()
    return one_case and "\n" not in m["at"] and text[start : m.start()].lower() not in PROSE


def _spelled_digits(tape: Tape) -> Tape:
    """Names of digits beside digits or other names, and a spelled plus before them.

    Separators between two names vanish, apart from the dots of four numbers; others stay. How many digits make an
    identifier is left to the finders.
    """
    text = tape.text
    words = TOKEN.findall(text.lower())
    if not any(a in DIGIT_NAMES and _counts(b) or b in DIGIT_NAMES and _counts(a) or a == PLUS and _counts(b) for a, b in pairwise(words)):
        return tape
    edits: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str, bool]] = []  # start, end, digits, whether spelled
    plus: tuple[int, int] | None = None

    def finish() -> None:
        nonlocal plus
        names = sum(r[3] for r in run)
        if run and (plus or names and len(run) > 1):
            if plus:
                edits.append((plus[0], run[0][0], "+"))
            elif names and run[0][0] > 1 and text[run[0][0] - 2 : run[0][0]] == "+ ":
                edits.append((run[0][0] - 1, run[0][0], ""))
            dotted = len(run) == 4 and all(text[a[1] : b[0]] == "." for a, b in pairwise(run))
            for k, (first, end, digits, spelled) in enumerate(run):
                if spelled:
                    edits.append((first, end, digits))
                    if k + 1 < len(run) and run[k + 1][3] and not dotted:
                        edits.append((end, run[k + 1][0], ""))
        run.clear()
        plus = None

    for m in TOKEN.finditer(text):
        first, end = m.span()
        word = m.group().lower()
        spelled = word in DIGIT_NAMES
        if spelled or word.isascii() and word.isdigit():
            if run:
                rule = BETWEEN_NAMES if spelled and run[-1][3] else BETWEEN_DIGITS
                if not rule.fullmatch(text, run[-1][1], first):
                    finish()
            elif plus and text[plus[1] : first].strip(" "):
                plus = None
            run.append((first, end, DIGIT_NAMES[word] if spelled else word, spelled))
        else:
            finish()
            if word == PLUS:
                plus = (first, end)
    finish()
    return tape.replace(edits)


def _counts(word: str) -> bool:
    return word in DIGIT_NAMES or word[0].isdigit() or word[-1].isdigit()


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base, added) spans by kind, in code points of the source."""
    some = DIGIT.search(text)
    base = {kind: finder(text) if some or kind == "email" else [] for kind, finder in FINDERS.items()}
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    tape = _spelled_digits(_marks(_plain_characters(Tape(text))))
    if tape.text != text:
        taken = sorted(s for spans in base.values() for s in spans)
        for kind, finder in FINDERS.items():
            for span in map(tape.source, finder(tape.text)):
                if not any(s <= span[0] and span[1] <= e for s, e in taken):
                    added[kind].append(span)
                    taken.append(span)
    return base, added


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in sorted(spans[kind]))


def identifiers(text: Column) -> Column:
    """Struct of SCHEMA for a text: counts and digest of the base matches, all spans as text and as arrays.

    The base patterns run on the text itself. Then transducers make a normalised copy (lookalike letters, characters
    without width, digits of other scripts, spelled digits, words and brackets for @ and dots), each keeping for every
    character the source range it stands for; identifiers found there that lie inside no span so far are added, as
    source spans: a wider one stands beside the base span that is a fragment of it. A null text counts as empty.
    """

    def make():
        def one(text):
            text = text or ""
            base, added = find(text)
            every = {k: sorted(base[k] + added[k]) for k in KINDS}
            flat = [(k, *s) for k in KINDS for s in every[k]]
            return (
                *(len(base[k]) for k in KINDS),
                hashlib.sha256(joined(base).encode()).hexdigest(),
                joined(every),
                [k for k, _, _ in flat],
                [s for _, s, _ in flat],
                [e for _, _, e in flat],
            )

        return one

    return text_udf(make, SCHEMA)(text)


def find_identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, the columns of SCHEMA) for every row, with nothing shuffled; other columns are ignored."""
    return docs.select("doc_id", identifiers(F.col("text")).alias("p")).select("doc_id", "p.*")
