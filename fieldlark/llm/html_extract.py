"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import returns

#: Lines in a block of the distribution; a surge is a block of the largest one over CONTRAST, or of LEAST if that is less.
WINDOW, CONTRAST, LEAST = 3, 16, 40
#: Characters that a paragraph, heading or list item weighs besides its own.
PROSE_BONUS = 40
#: Characters less that a line weighs outside all marks of the article, where there is one.
OUTSIDE = 400

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?:^|\s)(hidden)(?=\s|/|$)")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math select option button canvas audio video head".split())
#: Elements that start a new line.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that hold a region of the page and are kept on the stack.
REGION = frozenset("article aside blockquote body center dd details dialog div dt fieldset figcaption figure footer form header html li main menu nav ol section span table td tr ul a".split())
#: Elements that end where the next of their kind begins, and the elements that part them.
IMPLIED = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr")}
#: Elements of one line; with the others here they hold prose.
LINE = frozenset("p h1 h2 h3 h4 h5 h6".split())
PROSE = LINE | frozenset("li blockquote dd dt pre figcaption".split())
#: Regions that are not the article.
APART = frozenset("nav footer aside form dialog menu header".split())
#: Words in class, id or role that set a region apart, always or unless an ARTICLE word stands beside them.
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo complementary comment comments disqus replies respond share sharing social related recommended newsletter subscribe signup cookie cookies consent gdpr notice notices alert popup modal overlay login search pagination pager toolbar form dialog".split()
)
WEAK_NAMES = frozenset("header head masthead top widget meta tools".split())
ARTICLE_NAMES = frozenset("article post entry story content main body text".split())
#: Names of reader comments, which may be most of a page.
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
#: Words that do not change what a compound name means: `related-posts` is set apart, `related-work` is not.
COMPANIONS = frozenset(
    "left right bottom main site page global primary secondary list box block area section wrapper wrap container inner outer content item items bar link links button buttons icon icons post posts article articles story stories footer title body slot unit panel group row col column mobile desktop widgets field us now text".split()
)
#: A compound that begins so says what an element is beside or without, not what it is.
BESIDE = frozenset("no not has with without is hide show".split())
#: Regions that hold the article, from the surest kind to the least.
ARTICLE, MAIN, NAMED = 3, 2, 1


class Line(NamedTuple):
    """A block of a page: its text, the characters of it in links, whether it is set apart, the
    surest mark of the article around it, and whether an element of prose holds it."""

    text: str
    links: int
    apart: bool
    rank: int
    prose: bool


def _names(attributes: str) -> tuple[set[str], bool, bool]:
    """Words of class, id and role; whether they set the element apart, and whether it is hidden."""
    words: set[str] = set()
    apart = weak = hidden = False
    if attributes:
        for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
            name, value = (bare or name).lower(), a or b or c
            if name in ("class", "id", "role"):
                for token in value.split():
                    parts = [x.lower() for x in _NAME_WORD.findall(token)]
                    if not parts or len(parts) > 1 and parts[0] in BESIDE:
                        continue
                    words.update(parts)
                    if all(x in APART_NAMES or x in WEAK_NAMES or x in COMPANIONS or len(x) == 1 or x.isdigit() for x in parts):
                        apart |= not APART_NAMES.isdisjoint(parts)
                        weak |= not WEAK_NAMES.isdisjoint(parts)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    return words, apart or weak and words.isdisjoint(ARTICLE_NAMES), hidden


def lines_of(page: str) -> list[Line]:
    """The page as lines, one per block.

    An element is set apart by its kind or its names, with all in it.  One that is so by its
    names, or is a form, and holds most of the page's text is a wrapper of the article and
    is not, unless it is named for comments.
    """
    out: list[tuple[str, int, tuple[int, ...], int, bool]] = []
    buffer: list[str] = []
    links = regions = 0
    line: tuple[int, ...] = ()
    prose = False
    wrappers: set[int] = set()
    stack: list[tuple[str, tuple[int, ...], int, bool]] = [("", (), 0, False)]  # tag, regions set apart around it, rank, in a link

    def close() -> None:
        nonlocal links, line, prose
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((text, links, stack[-1][1] + line, stack[-1][2], prose))
            buffer.clear()
        links, line, prose = 0, (), False

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            buffer.append(chunk)
            if stack[-1][3]:
                links += len(chunk.strip())
        if not m:
            break
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close()
            prose = not slash and tag in PROSE
        elif tag in ("br", "td", "th", "img", "wbr"):
            if tag != "wbr":
                buffer.append(" ")
        if slash:
            if tag in REGION:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if tag in ("a", "span") and stack[k][0] not in ("a", "span"):
                        break
            continue
        if tag in RAW:
            if not attributes.endswith("/") and tag != "head":
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag in LINE:
            _, apart, hidden = _names(attributes)
            if apart or hidden:
                regions += 1
                line = (regions,)
            continue
        if tag not in REGION or attributes.endswith("/"):
            continue
        if tag in IMPLIED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag or {stack[k][0], tag} == {"dd", "dt"}:
                    del stack[k:]
                    break
                if stack[k][0] in IMPLIED[tag]:
                    break
        names, apart, hidden = _names(attributes)
        _, around, rank, link = stack[-1]
        own = 0
        if tag == "article":
            own = ARTICLE
        elif tag == "main" or names >= {"main"} and tag != "body" and not apart:
            own = MAIN
        elif tag in ("div", "section") and names & ARTICLE_NAMES and not apart:
            own = NAMED
        away = hidden or apart and tag not in ("html", "body")
        if tag in ("article", "main") and not away and not any(s[1] and s[0] not in ("form", "header", "nav", "menu") for s in stack):
            around = ()  # a page inside one big form, or after a menu that was never closed
        kind = tag in APART and not (tag == "header" and rank >= NAMED and not away)
        if kind or away:
            regions += 1
            around = (*around, regions)
            if not hidden and (tag == "form" or not kind) and names.isdisjoint(COMMENT_NAMES):
                wrappers.add(regions)
        stack.append((tag, around, max(rank, own), link or tag == "a"))
    close()
    held: dict[int, int] = {}
    for text, n, around, _, _ in out:
        for x in wrappers.intersection(around):
            held[x] = held.get(x, 0) + max(len(text) - n, 0)
    total = sum(max(len(text) - n, 0) for text, n, *_ in out)
    free = {x for x, n in held.items() if 2 * n > total}
    return [Line(text, n, any(x not in free for x in around), rank, prose) for text, n, around, rank, prose in out]


def line_weights(lines: list[Line]) -> np.ndarray:
    """Weight of every line, in characters.

    A line weighs its characters outside links; within the surest mark of the article on the
    page those in links too.  Prose weighs a little more.  Lines in a less sure mark, or in none,
    weigh less, by the square of what they lack of the surest one.
    """
    size, links = np.array([len(x.text) for x in lines], dtype=float), np.array([x.links for x in lines], dtype=float)
    rank, prose = np.array([x.rank for x in lines], dtype=float), np.array([x.prose for x in lines])
    surest = rank.max()
    inside = (rank == surest) & (surest > 0)
    weights = np.where(inside, size, np.maximum(size - links, 0))
    weights += np.where(prose & (inside | (2 * links <= size)), PROSE_BONUS, 0)
    return weights - (OUTSIDE * (1 - rank / surest) ** 2 if surest else 0)


def surges(weights: np.ndarray, window: int = WINDOW, contrast: float = CONTRAST) -> list[tuple[int, int]]:
    """[start, end) of the lines between each surge and the dive after it.

    A block is the text, all weight above zero, of ``window`` lines from a line on.  A surge is a
    line with text whose block reaches the largest one over ``contrast``, or LEAST if that is
    less; the dive is the first line after it whose block is empty.
    """
    n = len(weights)
    text = np.maximum(weights, 0)
    sums = np.concatenate(([0], np.cumsum(text)))
    sums = sums[np.minimum(np.arange(n) + window, n)] - sums[:n]
    surge = min(LEAST, sums.max(initial=0) / contrast)
    found, i = [], 0
    while i < n:
        if text[i] > 0 and sums[i] >= surge:
            j = i + 1
            while j < n and sums[j] > 1e-6:
                j += 1
            found.append((i, j))
            i = j
        else:
            i += 1
    return found


def main_text(page: str | None, window: int = WINDOW, contrast: float = CONTRAST) -> str:
    """The article's blocks, one a line: the lines between surges and dives that weigh no less than nothing."""
    lines = [x for x in lines_of(page) if not x.apart] if page else []
    if not lines:
        return ""
    weights = line_weights(lines)
    return "\n".join(lines[k].text for a, b in surges(weights, window, contrast) for k in range(a, b) if weights[k] >= 0)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of every page: the columns ``keep``, ``text``, ``n_chars``.

    Markup is stripped to lines, a line per block element, with all that is in a menu, header,
    footer, sidebar, notice, advert, form or reader comment.  A line weighs its characters
    outside links.  Weights are summed over sliding windows of lines, surge and dive points
    located, and the lines between them kept.  A surge is relative to the page's largest
    block, so short pages keep their text, and never more than ``LEAST`` characters, so long
    pages keep their short paragraphs; a link between paragraphs is no dive.  Elements that
    mark the article or hold prose shift the weights of their lines and decide nothing else.

    Edge cases: null, empty and textless pages give an empty text; unclosed elements end
    with their parents; pages of any length are read whole; repeated pages are extracted
    each; an empty table gives an empty table; other columns are ignored.  No shuffle.
    """
    d = pages.select(*keep, F.col(html_col).alias("_page"))

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return d.mapInArrow(run, returns("text string, n_chars bigint", **{c: d.schema[c].dataType for c in keep}))
