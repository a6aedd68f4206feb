"""Main text of a web page by composite text density."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import text_udf

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>[^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^\"'>]*+)*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|(?P<text>[^<]++|<)",
    re.DOTALL,
)
PLAIN = re.compile(r"(?P<text>.+)", re.DOTALL)  # nothing can end a tag any more
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: A start tag ends an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An open p ends at the start of any element that isn't inline.
SCOPES = frozenset("table td th ul ol dl div article section body html main".split())
DROPPED = frozenset(
    "head nav footer aside script style noscript template svg canvas button select textarea iframe object menu "
    "dialog title input xmp noembed noframes".split()
)
#: Class or id names hint at what surrounds an article: by their last word, or by the beginning of the name. A name
#: like ``has-sidebar`` says what a page has or lacks and hints at nothing.
SURROUND = frozenset(
    "ad ads adv nav navbar menu footer header masthead topbar toolbar sidebar aside widget share sharing social related "
    "comment comments reply replies disqus cookie cookies consent gdpr notice notices alert banner popup modal overlay "
    "promo login signup search subscribe newsletter sponsor sponsored breadcrumb breadcrumbs pagination pager skip".split()
)
SURROUND_START = ("advert", "sidebar", "comment", "cookie", "sponsor", "breadcrumb", "newsletter", "navigation", "banner")
KEPT = frozenset("html body article main".split())
CORE = frozenset("article main h1".split())
#: Characters outside links from which an element can be the text of a page.
BODY_SIZE = 100
STATES = frozenset("no not has have with without hide show".split())
HINT_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hints(value: str) -> bool:
    """Whether a class or id names what surrounds an article."""
    for name in value.split():
        words = [w.lower() for w in HINT_WORDS.findall(name)]
        if not words or STATES.intersection(words[:-1]):
            continue
        if words[-1] in SURROUND or words[0].startswith(SURROUND_START) or words[-1].startswith(SURROUND_START):
            return True
    return False


def surrounds(tag: str, rest: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no part of an article by its kind or because it is hidden; whether its names hint so."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, False
    # A form is no part of an article, but some pages lie in one as a whole; its controls go by their kind.
    hint = tag == "form"
    if "=" not in rest and "hidden" not in rest:
        return False, hint
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            hint = hint or hints(value)
        elif tag in KEPT:
            continue
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, hint
        elif name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True, hint
        elif name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
            return True, hint
    return False, hint


@dataclass
class Tree:
    """Block elements in page order; inline elements belong to the block around them."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    hint: list[bool] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    link_tags: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # (element, block, text)

    def add(self, tag: str, parent: int, dropped: bool, hint: bool = False) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.dropped.append(dropped)
        self.hint.append(hint)
        for counts in (self.tags, self.link_tags, self.chars, self.link_chars):
            counts.append(0)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    """The tree of a page. Elements of a raw kind end at their own end tag only; missing end tags are implied."""
    tree = Tree()
    open_: list[tuple[str, int]] = [("#root", tree.add("#root", -1, False))]
    articles = links = block = at = 0
    names: dict[str, int] = {}  # open elements by kind

    def close(down_to: int) -> None:
        nonlocal articles, links, block
        while len(open_) > down_to:
            tag, _ = open_.pop()
            names[tag] -= 1
            articles -= tag == "article"
            links -= tag == "a"
            block += tag not in INLINE

    def last(kinds: tuple[str, ...], scopes: frozenset[str]) -> int:
        if not any(names.get(k) for k in kinds):
            return 0
        for k in range(len(open_) - 1, 0, -1):
            if open_[k][0] in kinds:
                return k
            if open_[k][0] in scopes:
                return 0
        return 0

    last_end = page.rfind(">")
    while at < len(page):
        m = TOKEN.match(page, at) if at <= last_end or page[at] != "<" else PLAIN.match(page, at)
        at = m.end() if m else at + 1
        if not m:
            continue
        if (text := m["text"]) is not None:
            node = open_[-1][1]
            if not tree.dropped[node] and (clean := html.unescape(text) if "&" in text else text):
                tree.texts.append((node, block, clean))
                size = len(clean) - clean.count(" ") - clean.count("\n") - clean.count("\t")
                tree.chars[node] += size
                if links:
                    tree.link_chars[node] += size
            continue
        tag, end, rest = (m["tag"] or m["tag2"]), (m["end"] or m["end2"]), (m["rest"] or m["rest2"] or "")
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            if names.get(tag):
                k = len(open_) - 1
                while open_[k][0] != tag:
                    k -= 1
                close(k)
            elif tag == "p":
                block += 1
            continue
        inline = tag in INLINE
        if not inline:
            if k := last(("p",), SCOPES):
                close(k)
            block += 1
        if tag in ENDS and (k := last(ENDS[tag], frozenset(("ul", "ol", "dl", "table")))):
            close(k)
        parent = open_[-1][1]
        gone, hint = (True, False) if tree.dropped[parent] else surrounds(tag, rest, articles > 0)
        if inline and (tree.dropped[parent] or not (gone or hint)):
            node = parent
            if not gone:
                tree.tags[node] += 1
                tree.link_tags[node] += tag == "a"
        else:
            node = tree.add(tag, parent, gone, hint)
            tree.link_tags[node] += tag == "a"
        if tag == "br":
            tree.texts.append((node, block, " "))
        if tag in VOID or rest.endswith("/"):
            block += not inline
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else len(page)
            block += 1
            continue
        open_.append((tag, node))
        names[tag] = names.get(tag, 0) + 1
        articles += tag == "article"
        links += tag == "a"
    return tree


def drop_hinted(tree: Tree) -> None:
    """Drops the elements whose names hint at surroundings, unless they hold what the page is about.

    An element stays if it holds an article, main or h1 whose own name doesn't hint at surroundings, or BODY_SIZE
    characters and most of the text outside links; on a page without these three, also if it holds as much as is left.
    """
    if not any(tree.hint):
        return
    n = len(tree.tag)
    plain = [0 if tree.dropped[i] else tree.chars[i] - tree.link_chars[i] for i in range(n)]
    own = list(plain)
    core = [tree.tag[i] in CORE and not tree.dropped[i] and not (tree.hint[i] and tree.tag[i] == "article") for i in range(n)]
    holds = list(core)
    whole = [core[i] and tree.tag[i] != "h1" for i in range(n)]  # a form may well have a heading of its own
    for i in range(n - 1, 0, -1):
        plain[tree.parent[i]] += plain[i]
        holds[tree.parent[i]] |= holds[i]
        whole[tree.parent[i]] |= whole[i]
    kept = [whole[i] if tree.tag[i] == "form" else holds[i] for i in range(n)]
    going = [tree.hint[i] and tree.tag[i] not in KEPT and not kept[i] for i in range(n)]
    large = [plain[i] >= BODY_SIZE for i in range(n)]
    going = [going[i] and not (large[i] and 2 * plain[i] > plain[0]) for i in range(n)]
    under = list(going)
    for i in range(1, n):
        under[i] = under[i] or under[tree.parent[i]]
    if not any(core):
        left = sum(own[i] for i in range(n) if not under[i])
        going = [going[i] and not (large[i] and plain[i] >= left) for i in range(n)]
    for i in range(1, n):
        tree.dropped[i] = tree.dropped[i] or going[i] or tree.dropped[tree.parent[i]]


def content_elements(tree: Tree) -> list[bool]:
    """Which elements lie in the main text.

    The density of an element is its characters per tag, lowered by the share of characters and tags in links (the
    composite text density, with the page's own link share in the base of the logarithm). The element whose children
    have the largest sum of densities leads; the least density on its way up to the body is the threshold. In every
    element that reaches the threshold, the one with the largest sum below or at it is content with all that it holds.
    """
    n = len(tree.tag)
    tags, link_tags, chars, link_chars = (list(c) for c in (tree.tags, tree.link_tags, tree.chars, tree.link_chars))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if not tree.dropped[i]:
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
    bodies = [i for i in range(n) if tree.tag[i] == "body" and not tree.dropped[i]]
    body = bodies[0] if bodies else 0
    density, total = [0.0] * n, [0.0] * n
    body_share = link_chars[body] / max(1, chars[body])
    for i in range(n):
        c, lc = chars[i], link_chars[i]
        if tree.dropped[i] or not c:
            continue
        base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
        inner = max(1.0, (c / max(1, lc)) * (max(1, tags[i]) / max(1, link_tags[i])))
        density[i] = c / max(1, tags[i]) * math.log(inner) / math.log(base) if base > 1 else c / max(1, tags[i]) * math.log(inner)
        if i:
            total[tree.parent[i]] += density[i]
    for i in range(n):
        if total[i] == 0 and chars[i]:
            total[i] = density[i]  # a block without blocks inside
    lead = max(range(body, n), key=lambda i: (total[i], -i))
    threshold, i = density[lead], lead
    while i > 0:
        threshold = min(threshold, density[i])
        i = tree.parent[i] if i != body else 0
    if body == 0:
        threshold = min(threshold, density[0])
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if not tree.dropped[i] and (total[best[i]], -best[i]) > (total[best[p]], -best[p]):
            best[p] = best[i]
    content = [False] * n
    for i in range(body, n):
        if not tree.dropped[i] and chars[i] and density[i] >= threshold:
            content[best[i]] = True
    for i in range(1, n):
        content[i] = content[i] or content[tree.parent[i]]
    return content


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, one a line; white space inside a block is one space."""
    if not page:
        return ""
    tree = parse(page)
    drop_hinted(tree)
    content = content_elements(tree)
    blocks: dict[int, list[str]] = {}
    for node, block, text in tree.texts:
        if content[node] and not tree.dropped[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(pieces).split()) for _, pieces in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def extract_text(page: Column) -> Column:
    """Struct (text, n_chars) of a page: its main text and the length in code points.

    Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, comments of readers and hidden elements go by
    kind, or by a class or id that hints at them; a form or a hint only where the element does not hold the page's text.
    The density decides the rest. A null or empty page, or one without text, gives an
    empty text. Whole pages are read, each on its own; nothing is shuffled.
    """

    def make():
        def one(page):
            text = main_text(page)
            return text, len(text)

        return one

    return text_udf(make, "text string, n_chars long")(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; other columns are ignored. Empty tables give empty results."""
    return pages.select("page_id", "url", extract_text(F.col("html")).alias("x")).select("page_id", "url", "x.*")
