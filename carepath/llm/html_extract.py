"""HTML extraction by tag-path ratios.

A page is read into blocks of text, each with the tag path from the root to it. Text length and punctuation
are summed per path; their ratios to the path's number of blocks are smoothed over the page, fused, and
thresholded to choose the paths that hold content. Elements that never are content (menus, footers, forms,
adverts, comments and the like, by tag, role or class) are left out before. Where a page marks articles or a
main part, the mark is a prior: the ratio that a path needs is lower in the largest marked regions than in
the other ones, and higher outside all of them; and the totals per path tell what is foreign whatever it is called: a
path outside all marks that holds little text beside the marked one, and a named part that stands beside the path of the
prose, within it or after it, and holds little of the region's text (a thread of comments, a notice, a box).
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: Elements whose content is not text of the page; read up to their end tag.
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object textarea select title canvas audio video xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame command".split())
#: Elements that do not break a block of text and are not part of a path.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meta link math mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics nobr output q s samp small span strike strong sub sup time tt u var wbr br ruby rb rt rp area map picture source track param embed base".split())
BAD_TAGS = frozenset("nav footer aside form button dialog menu menuitem fieldset legend datalist head".split())
#: Of these, an element is left out though it holds an article: a teaser or a comment.
STRICT_TAGS = BAD_TAGS - {"form", "fieldset"}
STRICT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended recommendations teaser teasers".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog tablist".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail aside footer footers masthead topbar "
    "comment comments commentlist disqus reply replies respond discussion notice notices cookie cookies consent gdpr popup modal overlay alert "
    "subscribe subscription newsletter signup login register social share sharing sharebar related recommended recommendations "
    "teaser teasers widget widgets toolbar pagination pager search form hidden copyright legal disclaimer skip".split()
)
#: Words that say where or how large an element is, not what; beside them a bad word still names the whole element,
#: beside any other it does not ("site-footer", but not "legal-analysis").
PLACE_WORDS = frozenset(
    "site page main list lists box block blocks section container wrapper wrap area inner outer top bottom left right header bar item items "
    "link links inline slot unit global primary secondary post article entry user new icon icons button buttons content body panel row col column "
    "group label title text message msg wide narrow small large first last js fixed sticky float mobile desktop leaderboard "
    "articles posts stories story news videos reading topics tags tag us our your my web info warning important trail next prev previous dialog "
    "feed bottombar strip card cards module component region zone holder in on the by and of for to".split()
)
#: An open element that the start of another one ends, up to the nearest of the third set.
ENDS = {
    "p": (frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), frozenset("table td th button object".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr tbody thead tfoot".split()), frozenset(["table"])),
    "td": (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    "option": (frozenset("option optgroup".split()), frozenset(["select"])),
}
TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
MARK = re.compile(r"[.,;:!?…。，、！？；：]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("table thead tbody tfoot tr td th".split())
#: Width of the smoothing in blocks, and the share of the mean fused ratio that a path needs.
SMOOTH, SHARE = 1.0, 0.25
#: What the share is multiplied by outside the marked regions, inside them (and on pages without any), and in
#: the ones that hold nearly as much text as the largest.
PRIOR = np.array([4.0, 1.0, 0.5])
OUTSIDE, NEUTRAL, CORE = range(3)
#: Share of the core's text that a path outside all marks needs; the shares below which a named part of the core is
#: foreign to it, after the prose and within; and the share that the path of the prose must hold for that.
RIVAL, TAIL, WITHIN, PROSE = 0.5, 0.3, 0.15, 0.5
#: Words of a list's items, on average, from which a list of links among the prose is content.
ITEM_WORDS = 2
#: What a named part may be, and what it may hold without being foreign.
PARTS, FIGURES = frozenset("div section ul ol dl".split()), frozenset("pre table blockquote figure".split())
LISTS = frozenset("ul ol li dl dt dd".split())


@dataclass
class Element:
    tag: str
    parent: int
    path: str
    bad: bool
    article: bool
    main: bool
    header: bool
    strict: bool  # bad even if it holds an article


@dataclass
class Block:
    element: int
    text: str
    links: int  # characters inside links


def read(page: str) -> tuple[list[Element], list[Block]]:
    """Elements, and blocks of text in page order with white space collapsed. Broken markup is read as browsers
    do in the main: an open paragraph, list item or cell ends where the next begins, stray end tags are passed by."""
    elements = [Element("", -1, "", False, False, False, False, False)]
    blocks: list[Block] = []
    stack = [0]
    held: list[str] = []
    linked = in_link = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append(Block(stack[-1], text, min(linked, len(text))))
            held.clear()
        linked = 0

    def words(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if in_link:
                linked += len(text)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a":
                in_link = 0
            elif tag == "p" and not any(elements[k].tag == "p" for k in stack):
                flush()
            elif tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if elements[stack[k]].tag == tag:
                        flush()
                        del stack[k:]
                        break
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag in RAW:
            if not attrs.endswith("/") or tag in ("script", "style", "title", "textarea"):
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = n if close is None else page.find(">", close.start()) + 1 or n
                if tag not in ("svg", "annotation", "annotation-xml"):
                    held.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                in_link = 1
            continue
        flush()
        for ended, (by, upto) in ENDS.items():
            if tag in by:
                for k in range(len(stack) - 1, 0, -1):
                    t = elements[stack[k]].tag
                    if t == ended:
                        del stack[k:]
                        break
                    if t in upto:
                        break
        if tag in VOID:
            continue
        elements.append(_element(tag, stack[-1], elements[stack[-1]].path, attrs))
        if not attrs.endswith("/") or tag in ("p", "div", "article"):
            stack.append(len(elements) - 1)
    flush()
    return elements, blocks


def _element(tag: str, parent: int, path: str, attrs: str) -> Element:
    strict = tag in STRICT_TAGS
    bad, article, main, header, label = tag in BAD_TAGS, tag == "article", tag == "main", tag == "header", ""
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class" or name == "id" and tag not in HEADINGS:  # a heading's id is a target of links
                for one in value.split():
                    found = {w.lower() for w in SPLIT.split(one) if w and not w.isdigit()}
                    named = found & BAD_WORDS and found <= BAD_WORDS | PLACE_WORDS and not (tag in CELLS and found <= {"form"})
                    bad |= bool(named)
                    strict |= bool(named and found & STRICT_WORDS)
                    header |= "header" in found
                if name == "class":
                    label = "." + value.strip()
            elif name == "role":
                bad |= value.lower() in BAD_ROLES
                article |= value.lower() == "article"
                main |= value.lower() == "main"
            elif name == "itemprop":
                article |= value.lower() == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                bad = True
    if tag in ("html", "body", "main"):
        bad = header = strict = False
    return Element(tag, parent, f"{path}/{tag}{label}", bad, article, main, header and not article and tag not in HEADINGS, strict)


def _chosen(elements: list[Element], blocks: list[Block]) -> tuple[list[Block], np.ndarray]:
    """Blocks outside bad elements, and for each one where it stands to the regions that the page marks."""
    n = len(elements)
    kids = np.zeros(n, bool)  # holds an article or main that is not bad itself
    for k in range(n - 1, 0, -1):
        e = elements[k]
        if (kids[k] or (e.article or e.main) and not e.bad) and not e.strict:
            kids[e.parent] = True
    out, region, header = [False] * n, [-1] * n, [False] * n
    for k in range(1, n):
        e = elements[k]
        out[k] = out[e.parent] or e.bad and (e.strict or not kids[k])
        region[k] = k if (e.article or e.main) and not out[k] else region[e.parent]
        # a page's header is left out; an article's header may hold its headline
        header[k] = header[e.parent] or e.header
        if header[k] and not kids[k] and region[k] < 0:
            out[k] = True
    good = [b for b in blocks if not out[b.element] and not (header[b.element] and region[b.element] >= 0 and not _heading(elements, b.element))]
    size: dict[int, int] = defaultdict(int)
    for b in good:
        k, seen = region[b.element], set()
        while k > 0 and k not in seen:
            seen.add(k)
            size[k] += len(b.text) - b.links
            k = region[elements[k].parent]
    if not size or not max(size.values()):
        return good, np.full(len(good), NEUTRAL)
    most = max(size.values())
    # the core is regions of nearly as much text as the largest, without those that have such a one inside
    core = {k for k, v in size.items() if v >= 0.7 * most}
    for k in sorted(core, reverse=True):
        k = region[elements[k].parent]
        while k > 0:
            core.discard(k)
            k = region[elements[k].parent]
    level = [OUTSIDE] * n
    for k in range(1, n):
        up = level[elements[k].parent]
        level[k] = CORE if k in core else max(NEUTRAL, up) if region[k] == k else up
    return good, np.array([level[b.element] for b in good])


def _heading(elements: list[Element], k: int) -> bool:
    while k > 0:
        if elements[k].tag in HEADINGS:
            return True
        k = elements[k].parent
    return False


def ratios(paths: list[tuple[int, str]], blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block's path its text and punctuation per block, the share of its text in links, its whole text; and
    the two ratios smoothed over the blocks and fused."""
    sums: dict[tuple[int, str], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for path, b in zip(paths, blocks):
        s = sums[path]
        s[0] += len(b.text)
        s[1] += len(MARK.findall(b.text))
        s[2] += 1
        s[3] += b.links
    text, marks, linked, total = (np.array(x) for x in zip(*((s[0] / s[2], (s[1] + 0.5) / s[2], s[3] / s[0], s[0]) for s in (sums[path] for path in paths))))
    near = np.exp(-0.5 * (np.arange(-3, 4) / SMOOTH) ** 2)
    near /= near.sum()
    smooth = lambda x: np.convolve(np.pad(x, 3, mode="edge"), near, "valid")
    return text, marks, linked, total, np.sqrt(smooth(text) * smooth(marks))


def _foreign(elements: list[Element], blocks: list[Block], level: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, int]:
    """Blocks that the totals per path tell to be no content, and the parent of the prose (0: there is none)."""
    core = np.flatnonzero(level == CORE)
    out = np.zeros(len(blocks), bool)
    if not len(core):
        return out, 0
    sizes = np.array([len(b.text) for b in blocks])
    whole = sizes[core].sum()
    out |= (level == OUTSIDE) & (total < RIVAL * whole)
    top = core[total[core].argmax()]
    path = elements[blocks[top].element].path
    prose = [k for k in core.tolist() if elements[blocks[k].element].path == path]
    if total[top] < PROSE * whole:
        return out, 0
    up: set[int] = set()
    for k in prose:
        e = blocks[k].element
        while e > 0 and e not in up:
            up.add(e)
            e = elements[e].parent
    figures = set()
    for k, e in enumerate(elements):
        if e.tag in FIGURES:
            while k > 0 and k not in figures:
                figures.add(k)
                k = elements[k].parent
    parts: dict[int, int] = {}
    shares: dict[tuple[str, bool], int] = defaultdict(int)
    kind = lambda k: (elements[parts[k]].path, k > prose[-1])
    for k in core.tolist():
        e, part = blocks[k].element, 0
        while e > 0 and e not in up:
            if elements[e].tag in PARTS and "." in elements[e].path.rsplit("/", 1)[-1]:
                part = e
            e = elements[e].parent
        if part and part not in figures and k > prose[0]:
            parts[k] = part
            shares[kind(k)] += int(sizes[k])
    for k in parts:
        out[k] = shares[kind(k)] < (TAIL if k > prose[-1] else WITHIN) * whole
    return out, elements[blocks[top].element].parent


def _listed(elements: list[Element], blocks: list[Block], prose: int) -> np.ndarray:
    """Which blocks are of a plain list that stands among the paragraphs of the prose and whose items are phrases, or
    that a colon leads to."""
    lists: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(blocks):
        k, top = b.element, 0
        while k > 0 and elements[k].tag in LISTS and "." not in elements[k].path.rsplit("/", 1)[-1]:
            k, top = elements[k].parent, k
        if top and prose > 0 and k == prose:
            lists[top].append(i)
    out = np.zeros(len(blocks), bool)
    for items in lists.values():
        led = items[0] > 0 and blocks[items[0] - 1].text.endswith(":")
        out[items] = led or sum(len(blocks[i].text.split()) for i in items) >= ITEM_WORDS * len(items)
    return out


def _by_ratio(elements: list[Element], blocks: list[Block], level: np.ndarray) -> list[Block]:
    """Blocks whose path's smoothed and fused ratios of text and punctuation pass the threshold of their level, and
    whose totals do not tell them foreign."""
    if len(blocks) < 2:
        return blocks
    text, marks, linked, total, fused = ratios([(k, elements[b.element].path) for k, b in zip(level.tolist(), blocks)], blocks)
    foreign, prose = _foreign(elements, blocks, level, total)
    # links with the marks of sentences, such as a list of sources, are content in the core, and so is a plain list
    # among the paragraphs; menus are neither
    listed = (level == CORE) & ((marks >= 1.5) & (text >= 20) | _listed(elements, blocks, prose))
    size = np.where(level > OUTSIDE, [len(b.text) for b in blocks], 0.0)
    fused *= np.where(listed, 1, 1 - linked)
    keep = (fused >= SHARE * PRIOR[level] * (fused @ size) / max(1.0, size.sum())) & ((linked < 0.6) | listed) & ((text >= 20) | (level == CORE))
    keep &= ~foreign
    # a heading goes with the content that follows it, in the core up to the next heading
    heading = [_heading(elements, b.element) for b in blocks]
    follows = bool(keep[-1])
    for k in range(len(blocks) - 2, -1, -1):
        if heading[k]:
            keep[k] = (follows if level[k] == CORE else keep[k + 1]) and linked[k] < 0.6 and not foreign[k]
            follows = bool(keep[k]) and heading[k - 1]
        else:
            follows = follows and not heading[k + 1] or bool(keep[k])
    return [b for b, k in zip(blocks, keep.tolist()) if k] or [b for b, k in zip(blocks, level.tolist()) if k > OUTSIDE]


def extract(page: str) -> str:
    """The main text of a page: its blocks in page order, joined by line breaks; empty for an empty page."""
    if not page:
        return ""
    elements, blocks = read(page)
    return "\n".join(b.text for b in _by_ratio(elements, *_chosen(elements, blocks)))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: page_id, url, text, n_chars (code points of the text).

    Null and empty html and pages without text give an empty text. Null ids and urls stay null; repeated rows
    stay repeated. Nothing is shuffled, and a task holds one Arrow batch. A page of any length is read whole; an
    empty table gives an empty table; other columns are not read, whatever their names.
    """

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [extract(x) for x in texts_of(batch.column(2))]
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

        return f

    rows = pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"cast(`{url_col}` as string) as url", f"cast(`{html_col}` as string) as html")
    return map_batches(rows, make, "page_id long, url string, text string, n_chars long")
