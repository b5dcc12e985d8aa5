"""Main text of web pages by tag-path ratios (operator 7).

A page is cut into text leaves, each with the path of tags from the root. Text length and
punctuation are aggregated per path, smoothed along the page and fused to one score, and
paths above the threshold are content. The element that holds the content gives the text.
"""

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.llm.common import record_batches

#: Possessive, so that odd quotes are not tried in all ways; a tag with an unclosed quote
#: ends at the next >.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?:(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|(?P<loose>[^>]*+)>)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@][-\w:.@]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Tags whose content is no text of the page.
RAW = frozenset("script style noscript template svg math iframe object head title textarea select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Parts of a page that are not its article, by tag, role, and words in class or id.
ASIDE_TAGS = frozenset("nav header footer aside form button menu dialog".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar sidenav aside rail header masthead topbar toolbar footer bottombar "
    "breadcrumb breadcrumbs pagination pager ad ads adv advert adverts advertisement advertising adsense adbox "
    "sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay lightbox newsletter subscribe subscription signup login register share sharing "
    "social related recommended recommendations trending popular widget widgets comment comments commentlist "
    "disqus replies respond reply form search skip hidden tags taglist byline".split()
)
#: Of these, the words that also name a whole layout (as in has-sidebar): an element is
#: only left out for them if it does not hold the page's text.
LAYOUT_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar sidenav aside rail header masthead topbar toolbar footer bottombar "
    "banner form search overlay widget widgets notice alert share sharing social tags related hidden".split()
)
#: Words of the readers' part, which may well be longer than the article.
READER_WORDS = frozenset("comment comments commentlist disqus replies respond reply".split())
CONTAINERS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A tag that closes an open one of the second kind, where no closing tag stands.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"),
}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",)}


NO, LAYOUT, WORDS, READERS, YES = range(5)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int  # number of the tag path from the root
    aside: int  # whether it is left out: NO, YES, or by words only: LAYOUT, other WORDS, or READERS
    inside: bool  # in an article or main element, or one itself


@dataclass(slots=True)
class Leaf:
    element: int
    text: str
    linked: int


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def _words(attributes: dict[str, str]) -> set[str]:
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))


def _is_aside(tag: str, attributes: dict[str, str]) -> int:
    if tag in ("html", "body", "main"):
        return NO
    words = _words(attributes) & ASIDE_WORDS
    if (
        tag in ASIDE_TAGS
        or attributes.get("role", "").lower() in ASIDE_ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    ):
        return YES
    if words & READER_WORDS:
        return READERS
    if words - LAYOUT_WORDS:
        return WORDS
    return LAYOUT if words and tag != "article" else NO


def _last(elements: list[Element]) -> list[int]:
    """The last element inside each; elements are in page order, so what lies between is inside too."""
    last = list(range(len(elements)))
    for number in range(len(elements) - 1, 0, -1):
        last[elements[number].parent] = max(last[elements[number].parent], last[number])
    return last


def _totals(elements: list[Element], sizes: list[int]) -> list[int]:
    """Per element, the sum of ``sizes`` over it and all inside it."""
    total = list(sizes)
    for number in range(len(elements) - 1, 0, -1):  # children follow their parents
        total[elements[number].parent] += total[number]
    return total


def _sizes(elements: list[Element], leaves: list[Leaf], out: set[int]) -> list[int]:
    """Characters inside each element, but for parts whose kind is in ``out``."""
    gone = [element.aside in out for element in elements]
    for number in range(1, len(elements)):
        gone[number] |= gone[elements[number].parent]
    sizes = [0] * len(elements)
    for leaf in leaves:
        if not gone[leaf.element]:
            sizes[leaf.element] += len(leaf.text)
    return _totals(elements, sizes)


def settle(elements: list[Element], leaves: list[Leaf], share: float = 0.8) -> None:
    """Decides on elements with words of other parts, then hands each decision on to what is inside.

    Words weigh less than what an element holds. It stays in if it holds a main or article
    element that is none of these itself. Where no such element lies elsewhere, it also
    stays if it holds ``share`` of the text of the page, or of the container around it, or
    is the page's only article; the readers' part does not, long as it may be. Layout words
    alone ask for a main element or ``share`` of the text that is left then.
    """
    holds_main = _totals(elements, [int(element.tag == "main") for element in elements])
    plain = _totals(elements, [int(e.tag in CONTAINERS and e.aside in (NO, LAYOUT)) for e in elements])
    articles = sum(element.tag == "article" for element in elements)
    size = _sizes(elements, leaves, {YES})
    around = [0] * len(elements)  # the next container above, or the page
    for number, element in enumerate(elements[1:], 1):
        above = element.parent
        around[number] = above if elements[above].tag in CONTAINERS and elements[above].aside in (NO, LAYOUT) else around[above]
        if element.aside not in (WORDS, READERS):
            continue
        own = around[number]
        others = plain[own] - (own > 0) - plain[number]
        fits = size[number] > 0 and size[number] >= share * size[own] or element.tag == "article" and articles == 1
        element.aside = NO if plain[number] or element.aside == WORDS and not others and fits else YES
    size = _sizes(elements, leaves, {YES})
    for number, element in enumerate(elements):
        if element.aside == LAYOUT and (holds_main[number] or size[number] >= share * size[0]):
            element.aside = NO
        if number and elements[element.parent].aside:
            element.aside = YES


def parse(page: str) -> tuple[list[Element], list[Leaf]]:
    """The block elements of a page and its text leaves, in page order."""
    elements = [Element("", -1, 0, NO, False)]
    leaves: list[Leaf] = []
    paths: dict[tuple[int, str], int] = {}
    stack = [0]
    opened: defaultdict[str, int] = defaultdict(int)  # open elements by tag
    links = 0  # open links
    inline_aside: list[str] = []  # open inline tags of an inline part that is not the article
    pending: list[str] = []
    linked = at = 0

    def close_to(place: int) -> None:
        for number in stack[place:]:
            opened[elements[number].tag] -= 1
        del stack[place:]

    def close(tag: str) -> None:
        """Closes the last open element of this tag, and what is open inside it."""
        place = len(stack) - 1
        while elements[stack[place]].tag != tag:
            place -= 1
        close_to(place)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pending)).split())
        if text:
            leaves.append(Leaf(stack[-1], text, linked))
        pending.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not inline_aside:
            pending.append(text)
            if links:
                linked += len(text)

    last = page.rfind(">") + 1  # no tag ends behind it
    tail = page[last:].split("<!", 1)[0]
    page = page[:last]
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            if at == len(page) and token[0].startswith("<!--") and not token[0].endswith("-->"):
                tail = ""
            continue
        attributes_text = token["attributes"] if token["attributes"] is not None else token["loose"]
        if token["close"]:
            if tag in INLINE:
                if tag == "a":
                    links = max(0, links - 1)
                if inline_aside and inline_aside[-1] == tag:
                    inline_aside.pop()
                continue
            if tag == "p" or opened[tag]:
                flush()
                links, inline_aside = 0, []
                if opened[tag]:
                    close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>|\Z", re.IGNORECASE).search(page, at)
            at = end.end()
            if not end[0]:
                tail = ""
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                links += 1
            elif tag not in VOID and (inline_aside or _is_aside(tag, _attributes(attributes_text)) != NO):
                inline_aside.append(tag)
            continue
        flush()
        links, inline_aside = 0, []
        if tag in VOID:
            continue
        if opened["p"]:  # a paragraph holds no blocks
            close("p")
        if any(opened[other] for other in _CLOSES.get(tag, ())):
            scope = _SCOPES.get(tag, ())
            for place in range(len(stack) - 1, 0, -1):
                if elements[stack[place]].tag in scope:
                    break
                if elements[stack[place]].tag in _CLOSES[tag]:
                    close_to(place)
                    break
        attributes = _attributes(attributes_text)
        above = elements[stack[-1]]
        own = _is_aside(tag, attributes)
        if tag == "header" and above.inside and above.aside == NO:
            own = NO  # an article's own header: only its headings count, see below
        name = ".".join([tag, *sorted(_words(attributes))])
        elements.append(Element(
            tag, stack[-1], paths.setdefault((above.path, name), len(paths) + 1), own, above.inside or tag in CONTAINERS
        ))
        stack.append(len(elements) - 1)
        opened[tag] += 1
    add(tail)
    flush()
    settle(elements, leaves)
    return elements, leaves


def path_scores(elements: list[Element], leaves: list[Leaf]) -> list[float]:
    """Per leaf, the smoothed and fused ratios of its path.

    The text ratio of a path is its text length per leaf, its punctuation ratio the marks
    per leaf; linked text does not count. Both are smoothed over neighbouring leaves and
    multiplied.
    """
    nodes, length, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for leaf in leaves:
        path = elements[leaf.element].path
        nodes[path] += 1
        length[path] += max(0, len(leaf.text) - leaf.linked)
        marks[path] += len(_PUNCTUATION.findall(leaf.text)) if leaf.linked * 2 < len(leaf.text) else 0
    paths = [elements[leaf.element].path for leaf in leaves]

    def smooth(values: list[float]) -> list[float]:
        padded = [values[0], *values, values[-1]]
        return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]

    text = smooth([length[p] / nodes[p] for p in paths])
    punctuation = smooth([marks[p] / nodes[p] for p in paths])
    return [a * (1 + b) for a, b in zip(text, punctuation, strict=True)]


def main_text(page: str | None, threshold: float = 0.5, share: float = 0.7) -> str:
    """The blocks of the article, joined by line feeds; empty if there is none.

    Leaves of other parts (by tag, role, class or id) are left out first. Content leaves
    are those whose path score reaches ``threshold`` times the mean. The text is in the
    page's only article (or main) element, if it has one with at least a tenth of the text.
    Otherwise, from the root down, the element that holds at least ``share`` of the content
    is followed, as far as an article or main element; headings right above it come back.
    """
    if not page:
        return ""
    elements, leaves = parse(page)
    header = [False] * len(elements)
    for number, element in enumerate(elements[1:], 1):
        header[number] = element.tag == "header" or header[element.parent]
    leaves = [
        leaf for leaf in leaves
        if not elements[leaf.element].aside and (not header[leaf.element] or elements[leaf.element].tag in HEADINGS)
    ]
    if not leaves:
        return ""
    scores = path_scores(elements, leaves)
    least = threshold * sum(scores) / len(scores)
    weight = [len(leaf.text) if score >= least else 0 for leaf, score in zip(leaves, scores, strict=True)]
    held, all_leaves, no_headings = [0] * len(elements), [0] * len(elements), [0] * len(elements)
    for leaf, size in zip(leaves, weight, strict=True):
        held[leaf.element] += size
        all_leaves[leaf.element] += 1
        no_headings[leaf.element] += elements[leaf.element].tag not in HEADINGS
    held, all_leaves, no_headings = (_totals(elements, x) for x in (held, all_leaves, no_headings))
    last = _last(elements)
    children = defaultdict(list)
    for number, element in enumerate(elements[1:], 1):
        children[element.parent].append(number)
    top = _only_container(elements, leaves)
    while elements[top].tag not in CONTAINERS and children[top]:
        best = max(children[top], key=lambda e: held[e])
        if held[best] < share * held[top] or not held[best] or elements[best].tag in ("p", *HEADINGS):
            break
        top = best

    while top and elements[top].tag not in CONTAINERS and elements[elements[top].parent].tag not in ("body", "html", ""):
        parent = elements[top].parent
        # What the parent holds besides are headings, and some.
        if all_leaves[parent] == all_leaves[top] or no_headings[parent] > no_headings[top]:
            break
        top = parent
    in_container = elements[top].inside
    return "\n".join(
        leaf.text for leaf, size in zip(leaves, weight, strict=True)
        if top <= leaf.element <= last[top] and (in_container or size or leaf.linked * 2 < len(leaf.text))
    )


def _only_container(elements: list[Element], leaves: list[Leaf]) -> int:
    """The one article or main element that holds text; 0 if there is none, or several.

    A main element is left for an article that is alone in it.
    """
    size = _sizes(elements, leaves, set())
    last = _last(elements)
    for tag in ("article", "main"):
        outer, end = [], -1
        for number, element in enumerate(elements):
            if number > end and element.tag == tag and size[number]:
                outer.append(number)
                end = last[number]
        if len(outer) == 1 and size[outer[0]] * 10 >= size[0]:
            return outer[0]
    return 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the page's id and url, ``text`` and ``n_chars`` (its code points).

    A null or empty page has an empty text. Rows with equal ids are rows of their own; ids
    and urls are passed on as they are, null included. Extra columns are not read.
    """
    arrow = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for number, url, page in zip(*[batch.column(i) for i in range(3)], strict=True):
                yield number.as_py(), url.as_py(), main_text(page.as_py())

    return (
        pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col))
        .mapInArrow(lambda batches: record_batches(rows(batches), arrow, 512), "id long, url string, text string")
        .select(
            F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
            F.char_length("text").cast("long").alias("n_chars"),
        )
    )
