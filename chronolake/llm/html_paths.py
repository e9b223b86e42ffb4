"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path. A path's ratio is its text length for each node; it is fused with the path's
punctuation and with what the markup says about it (menus, footers, adverts weigh less, an article element more), smoothed along
the page and held against a threshold. The blocks on paths above it are the text, wherever they stand, and with them the headings and
short blocks that the region of most content holds between them. Only scripts, styles and hidden parts are left out beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements without an end tag, whose content is no markup, and that start a new block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math textarea select title head canvas audio video".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An element of the first kind closes an open one of the second, unless one of the third lies between.
CLOSES = {t: ({"p"}, {"table", "td", "button"}) for t in BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}} | {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Elements that can hold an article.
HOLDERS = set("article main section div body td html center".split())
OTHER = set("nav footer aside form menu button dialog search label input fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names of a class or id speak against a path if all their words are of the first or the second kind and one is of the first, or one is of the third.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent gdpr notice notices alert share sharing social related "
    "recommended newsletter subscribe subscription signup login search popup modal overlay pagination pager widget toolbar skip copyright disclaimer".split()
)
FILLERS = set("site page global main top bottom left right bar box block list item items wrap wrapper container inner outer section area links link buttons posts form first last row col column the".split())
REMARKS = set("comment comments reply replies respond disqus".split())
#: What one mark against a path leaves of its score, and what an article or main element makes of it.
AGAINST, FOR = 0.03, 4.0
#: The share of the page's mean score for each letter from which a path is one of content.
LEVEL = 0.35
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: So many blocks of nothing but links in a row are a list of links.
LINKS = 3

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S)
_attribute = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_name = re.compile(r"[a-z]+", re.I)
_punctuation = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


def _speaks_against(value: str) -> bool:
    for token in value.split():
        words = set(_name.findall(token))
        if words & REMARKS and "no" not in words or words & NAMES and words <= NAMES | FILLERS:
            return True
    return False


def _marks(tag: str, attributes: str, inside_article: bool) -> tuple[bool, int]:
    """Whether an element is hidden, and how many marks it has against being part of the article."""
    against = int(tag in OTHER or tag == "header" and not inside_article)
    for name, value in _attribute.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"' ").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0
        if name == "role" and value in ROLES or name in ("class", "id") and tag not in ("body", "html", *ARTICLE) and _speaks_against(value):
            against += 1
    return False, against


def text_nodes(html: str) -> list[tuple[tuple[str, ...], int, str, int]]:
    """(tag path, number of its block, text, marks against it) of the visible text nodes, in page order."""
    nodes: list[tuple[tuple[str, ...], int, str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, hidden, marks against it
    block, at, skipped, inside, against = 0, 0, 0, 0, 0
    path: tuple[str, ...] | None = ()

    def pop() -> None:
        nonlocal skipped, inside, against
        tag, hidden, marks = stack.pop()
        skipped -= hidden
        against -= marks
        inside -= tag in ARTICLE

    def text(piece: str) -> None:
        nonlocal path
        if piece and not skipped:
            if path is None:
                path = tuple(t for t, *_ in stack)
            nodes.append((path, block, unescape(piece), against))

    while (found := _token.search(html, at)) is not None:
        text(html[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            continue
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\s*>" if tag != "head" else r"</head\s*>|<body\b", re.I).search(html, at)
            at = (end.start() if tag == "head" and end.group().lower().startswith("<body") else end.end()) if end else (len(html) if tag != "head" else at)
            continue
        if tag in BLOCK:
            block += 1
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        path = None
        if closing:
            if any(t == tag for t, *_ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in closed:
                    while len(stack) > k:
                        pop()
                    if tag in ("p",) or "p" not in closed or len(closed) == 1:
                        break
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            hidden, marks = _marks(tag, attributes, inside > 0)
            stack.append((tag, hidden, marks))
            skipped += hidden
            against += marks
            inside += tag in ARTICLE
    text(html[at:])
    return nodes


def _ratios(nodes: list[tuple[tuple[str, ...], int, str, int]], length: np.ndarray) -> np.ndarray:
    """For each node the text length of its path for each of the path's nodes, fused with the path's punctuation."""
    marks = np.array([len(_punctuation.findall(t)) for _, _, t, _ in nodes], float)
    _, which = np.unique(np.array([hash((p, against)) for p, _, _, against in nodes]), return_inverse=True)
    count = np.bincount(which)
    return ((np.bincount(which, length) / count) * (1 + np.log1p(np.bincount(which, marks) / count)))[which]


def _evidence(nodes: list[tuple[tuple[str, ...], int, str, int]], weight: np.ndarray) -> np.ndarray:
    """What the markup makes of each node's score. Marks that an article has, or else nearly all of the weight, are those of a wrapper, and say nothing."""
    against = np.array([n for *_, n in nodes])
    article = np.array([bool(ARTICLE.intersection(p)) for p, *_ in nodes])
    wrapped = against[article].min() if article.any() else max(k for k in {0, *against.tolist()} if weight[against >= k].sum() >= 0.8 * weight.sum())
    return np.where(against > wrapped, AGAINST ** np.maximum(against - wrapped, 0), np.where(article, FOR, 1.0))


def path_scores(nodes: list[tuple[tuple[str, ...], int, str, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """For each node the score of its path, that smoothed along the page, and the threshold of content.

    The threshold is a share of the mean score for each letter of the page, so that many short nodes do not lower it.
    """
    length = np.array([len(t.strip()) for _, _, t, _ in nodes], float)
    ratio = _ratios(nodes, length)
    evidence = _evidence(nodes, length * ratio)
    score = ratio * evidence
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = score
    if len(score) >= 5:  # neighbours lift a node, but its own marks still weigh
        smooth = np.convolve(score, kernel, "same") / np.convolve(np.ones(len(score)), kernel, "same")
        smooth = np.where(evidence < 1, np.minimum(smooth, score), smooth)
    return score, smooth, LEVEL * float((length * score).sum() / length.sum())


def main_text(html: str | None) -> str:
    """The article's blocks joined by two newlines; empty if there is none."""
    nodes = [n for n in text_nodes(html or "") if n[2]]
    own = [n for n in nodes if n[2].strip()]
    if not own:
        return ""
    alone, score, least = path_scores(own)
    content = score >= least
    if not content.any():
        return ""
    length = np.array([len(t.strip()) for _, _, t, _ in own], float)
    blocks_of = lambda p: tuple(t for t in p if t in BLOCK)
    # the deepest element that holds nearly all content
    weight: dict[tuple[str, ...], float] = {}
    for (path, *_), n in zip(own, np.where(content, length, 0.0).tolist(), strict=True):
        trail = blocks_of(path)
        for k in range(len(trail) + 1):
            weight[trail[:k]] = weight.get(trail[:k], 0.0) + n
    region = max((p for p, w in weight.items() if w >= 0.8 * weight[()] and (not p or p[-1] in HOLDERS)), key=len)
    article = bool(ARTICLE.intersection(region))
    # what lies on a path of content is text: in the region of one that its surroundings may have lifted, elsewhere of one that is content alone
    keys = [(blocks_of(path), n) for path, _, _, n in own]
    inside = [key[: len(region)] == region for key, _ in keys]
    chosen = {key for key, near, keep in zip(keys, inside, content, strict=True) if near and keep}
    chosen |= {key for key, value in zip(keys, alone, strict=True) if value >= least}
    taken = {block for key, (_, block, _, _) in zip(keys, own, strict=True) if key in chosen}
    unlinked = {block for path, block, _, _ in own if "a" not in path or HEADINGS.intersection(path)}
    # of the region's other blocks, those that have no more marks than its content: all in an article, else what stands between text, and the heading before it
    marks = max(n for (_, n), near, keep in zip(keys, inside, content, strict=True) if near and keep) if article else min(n for _, n in chosen)
    first, last = min(taken), max(taken)
    order, links = [], 0
    for near, (path, block, _, n) in zip(inside, own, strict=True):
        if order and order[-1][0] == block:
            continue
        links = links + 1 if block not in unlinked else 0
        order.append((block, near and n <= marks, path, links))
    before = next(k for k, (block, *_) in enumerate(order) if block == first) - 1
    if not article and before >= 0 and order[before][1] and HEADINGS.intersection(order[before][2]):
        taken.add(order[before][0])
    long = set()  # of lists of links
    for k, (*_, links) in enumerate(order):
        if links >= LINKS:
            long.update(block for block, *_ in order[k - links + 1 : k + 1])
    taken -= long
    taken.update(block for block, fits, *_ in order if fits and block not in long and (article or first < block < last and block in unlinked))
    parts: dict[int, list[str]] = {}
    for _, block, piece, _ in nodes:
        if block in taken:
            parts.setdefault(block, []).append(piece)
    texts = (" ".join("".join(p).split()) for p in parts.values())
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text.

    Null, empty and text-free pages have an empty text. Broken markup is read as far as it goes. Repeated rows and null ids are
    extracted one by one; no rows give no rows; other columns are ignored. Pages are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
