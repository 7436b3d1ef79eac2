"""Main text of web pages by tag-path ratios.

A tolerant scan turns a page into text nodes, each with its tag path from the root to the
leaf; containers on the path are told apart, so that a footer's paragraphs are another
path than the article's. Over all nodes of a path the text length and the punctuation are
added up and divided by the number of nodes; text in links counts for less, and so does
text below containers whose class or id says that they are no article. Both ratios are
smoothed along the page within a section and fused, and paths whose fused ratio reaches
the threshold are content. The article is the element over the content paths' text: its
content nodes, and what stands among them, headings and short blocks too, make the result.
Containers that call themselves adverts, comments or the like only weigh less: what is in
them stays where its path is content all the same, inside an article element as elsewhere.

Elements that HTML itself sets apart from an article (menus, forms, scripts and so on) are
left out before.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, elements whose content is no markup,
# block elements, and elements that never belong to an article's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("aside button dialog footer form head input label menu nav object search select audio video canvas".split())
ROLES = frozenset("banner navigation complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())

#: Words of class and id that speak against a container, wherever it stands.
APART = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar widget widgets "
    "related recommended recommendations share sharing social follow subscribe newsletter signup login "
    "comment comments commentlist respond replies disqus "
    "cookie cookies consent gdpr popup modal overlay paywall pagination pager".split()
)
#: Words of class and id that speak against a container outside of an article element.
DOUBTFUL = frozenset(
    "banner topbar toolbar masthead header footer foot side aside reply discussion "
    "notice notices notification alert disclaimer copyright legal tags skip search hidden sr".split()
)
#: Words that say nothing beside those above; with any other word a name is about something ("share-price") and speaks against nothing.
NEUTRAL = frozenset(
    "area bar banner block body bottom box button buttons card cards column container content count feed form frame grid group heading holder icon icons "
    "inner inline item items js label latest left link links list lists module more outer panel placement popular posts post rail read right row section "
    "slot small story stories text title top unit view wrap wrapper zone button"
    .split()
)
#: Words that take back what others of APART and DOUBTFUL say (an "article-header" is the article's).
ARTICLE = frozenset("article content post entry story main body text".split())
#: Words that ARTICLE does not take back.
FIRM = frozenset("comment comments ad ads sidebar related share nav menu footer".split())
#: Elements whose class and id are looked at: containers, not headings, paragraphs or inline ones.
CONTAINER = frozenset("address article aside blockquote body center div dl fieldset figure footer header main ol section table tbody td tr ul".split())
#: Containers that a path tells apart from others of their kind.
SECTION = frozenset("article aside body center div footer header main section table td".split())

_TOKEN = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

#: Elements that an opening one of the kind ends, within the nearest of its containers.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEAR = frozenset("table td th button caption html template".split())

#: Share of the page's mean fused ratio (of all its text, character by character) that a path must reach.
THRESHOLD = 0.5
#: Width of the smoothing, in text nodes.
SMOOTHING = 1.0
#: What a character counts in a link, below a doubtful container, and below one whose name speaks against it.
LINKED, DOUBTED, AGAINST = 0.1, 0.2, 0.05


def _standing(tag: str, attributes: str, in_article: bool) -> float:
    """0 for an element that no article text is in, AGAINST or DOUBTED for a container by its names, else 1."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return 0.0
    if tag in ("html", "body", "article", "main") or not attributes:
        return 1.0
    doubt = 1.0
    for name, double, single, bare in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (double or single or bare).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return 0.0
        if name == "style" and "display:none" in value.replace(" ", ""):
            return 0.0
        if name in ("class", "id") and tag in CONTAINER:
            for part in value.split():
                words = set(_WORD.findall(part))
                taken_back = words & ARTICLE and not words & FIRM
                if taken_back or words - APART - DOUBTFUL - NEUTRAL - ARTICLE:
                    continue
                if words & APART:
                    doubt = AGAINST
                elif words & DOUBTFUL and not in_article:
                    doubt = min(doubt, DOUBTED)
    return doubt


class Node:
    """A run of text: its block, its path, the elements on the path, its innermost section, what a character of it counts, and counts by its containers alone."""

    __slots__ = ("text", "block", "path", "owners", "section", "weight", "standing", "tag")

    def __init__(self, text: str, block: int, path: str, owners: tuple[tuple[int, str], ...], section: int, weight: float, standing: float, tag: str):
        self.text, self.block, self.path, self.owners, self.section, self.weight, self.standing, self.tag = text, block, path, owners, section, weight, standing, tag


def text_nodes(page: str) -> list[Node]:
    """The page's text nodes outside of elements that are no article's, in page order."""
    nodes: list[Node] = []
    tags: list[str] = []
    # of each open element: number and tag, its part of the path, the number of its innermost section, what a character counts
    owners: list[tuple[int, str]] = []
    steps: list[str] = []
    steps_at: list[int] = []
    sections: list[int] = []
    weights: list[float] = []
    block, made, at = 0, 0, 0
    size = len(page)
    path, above = "", ()

    def close(depth: int) -> None:
        nonlocal path, above
        del tags[depth:], owners[depth:], steps_at[depth:], sections[depth:], weights[depth:]
        del steps[steps_at[-1] if steps_at else 0 :]
        path, above = "/".join(steps), tuple(owners)

    def say(text: str) -> None:
        weight = weights[-1] if weights else 1.0
        if text and weight:
            leaf = next((t for t in reversed(tags) if t in BLOCK), "")
            nodes.append(Node(html.unescape(text), block, path, above, sections[-1] if sections else 0, weight * (LINKED if "a" in tags else 1.0), weight, leaf))

    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            rest = page[at:]
            cut = re.search(r"</?[a-zA-Z!]", rest)
            say(rest[: cut.start()] if cut else rest)
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCK:
                block += 1
            for depth in range(len(tags) - 1, -1, -1):
                if tags[depth] == tag:
                    close(depth)
                    break
                if tags[depth] in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            block += 1
            for depth in range(len(tags) - 1, -1, -1):
                if tags[depth] == "p":
                    close(depth)
                    break
                if tags[depth] in _NEAR:
                    break
        if tag in _CLOSES:
            ended, within = _CLOSES[tag]
            low = None
            for depth in range(len(tags) - 1, -1, -1):
                if tags[depth] in within:
                    break
                if tags[depth] in ended:
                    low = depth
            if low is not None:
                close(low)
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            if end is None:
                if tag in ("script", "style"):
                    break
                continue
            closing = page.find(">", end.end())
            at = size if closing < 0 else closing + 1
            continue
        if found[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        made += 1
        standing = _standing(tag, found[3], "article" in tags or "main" in tags)
        weights.append((weights[-1] if weights else 1.0) * standing)
        tags.append(tag)
        owners.append((made, tag))
        # inline elements are part of the path of their block
        steps += [f"{tag}{made}"] if tag in SECTION else [tag] if tag in BLOCK or tag == "a" else []
        steps_at.append(len(steps))
        sections.append(made if tag in SECTION else sections[-1] if sections else 0)
        path, above = "/".join(steps), tuple(owners)
    return nodes


def _smooth(values: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Gaussian mean over the two nodes before and after that are in the same section."""
    total, weights = np.zeros(len(values)), np.zeros(len(values))
    for shift in range(-2, 3):
        share = math.exp(-(shift**2) / (2 * SMOOTHING**2))
        here, there = slice(max(0, -shift), len(values) - max(0, shift)), slice(max(0, shift), len(values) + min(0, shift))
        same = share * (sections[here] == sections[there])
        total[here] += same * values[there]
        weights[here] += same
    return total / weights


def content_nodes(nodes: list[Node]) -> list[bool]:
    """Which nodes lie on content paths: length and punctuation per path, smoothed, fused, over the threshold."""
    paths: dict[str, list[int]] = {}
    for k, node in enumerate(nodes):
        paths.setdefault(node.path, []).append(k)
    length, marks = np.zeros(len(nodes)), np.zeros(len(nodes))
    for members in paths.values():
        length[members] = sum(nodes[k].weight * len(nodes[k].text.strip()) for k in members) / len(members)
        marks[members] = sum(nodes[k].weight * len(_PUNCTUATION.findall(nodes[k].text)) for k in members) / len(members)
    sections = np.array([n.section for n in nodes])
    fused = _smooth(length, sections) * (1 + _smooth(marks, sections))
    sizes = np.array([n.weight * len(n.text.strip()) for n in nodes])
    least = THRESHOLD * float(fused @ sizes / sizes.sum())
    high = [float(fused[members].mean()) for members in paths.values()]
    chosen = {p for p, h in zip(paths, high, strict=True) if h >= least}
    return [node.path in chosen for node in nodes]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks of text in page order, one a line; empty if there is none."""
    nodes = text_nodes(page or "")
    inked = [n for n in nodes if n.text.strip()]
    if not inked:
        return ""
    chosen = [n for n, c in zip(inked, content_nodes(inked), strict=True) if c] or inked
    if all(n.standing <= AGAINST for n in chosen):
        return ""
    # the article: the innermost element over most of the content paths' text
    weight: dict[int, float] = {}
    place: dict[int, tuple[int, str]] = {}
    for node in chosen:
        n = node.weight * len(node.text.strip())
        for depth, (owner, tag) in enumerate(node.owners):
            weight[owner] = weight.get(owner, 0) + n
            place[owner] = depth, tag
    total = sum(n.weight * len(n.text.strip()) for n in chosen)
    holders = [o for o, w in weight.items() if place[o][1] in ("article", "main") and w >= 0.5 * total]
    named = bool(holders)
    if not named:
        holders = [o for o, w in weight.items() if place[o][1] in SECTION and w >= 0.9 * total]
    root = max(holders, key=lambda o: place[o][0]) if holders else None
    inside = [n for n in nodes if root is None or any(o == root for o, _ in n.owners)]
    content = {id(n) for n in chosen}
    held = [k for k, n in enumerate(inside) if id(n) in content]
    first, last = held[0], held[-1]
    lead = first
    while lead and (inside[lead - 1].tag in _HEADINGS or not inside[lead - 1].text.strip()):
        lead -= 1
    # outside of a named article, what comes before the first content node and its headings, or after the last,
    # belongs to it only by sharing a section with content, and not as links
    sections = {inside[k].section for k in held}
    blocks: dict[int, list[str]] = {}
    linked: dict[int, float] = {}
    for node in inside:
        linked[node.block] = max(linked.get(node.block, 0.0), node.weight if node.text.strip() else 0.0)
    for k, node in enumerate(inside):
        if node.standing < 1 and id(node) not in content:
            continue
        if not (named or lead <= k <= last) and (linked[node.block] <= LINKED or node.section not in sections):
            continue
        blocks.setdefault(node.block, []).append(node.text)
    lines = (_SPACES.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points).

    A null or empty page has an empty text; null ids and urls stay; other columns are
    ignored. Repeated rows give repeated results; an empty table gives no rows. Pages are
    taken whole, however long, cut off or badly nested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).alias(url_col), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long")
