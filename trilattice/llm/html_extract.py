"""Main text of HTML pages by two passes of block rules.

Pass one cuts the page into blocks and classifies each by link density, length and stop-word density as good, bad, near
good or short; on a page none of whose blocks has known stop words, length and links alone decide. Pass two gives the
undecided blocks the label of their nearest decided neighbours, headings looking to what follows them, in one sweep either
way. Elements that never hold article text (scripts, menus, asides) make no blocks. An element whose class, id or role names
a notice, an advert, a sidebar or comments is a suspect: its blocks go, unless it holds the article or most of the text.
Where a page marks its article, only blocks inside it are considered, and inside it an undecided block is good unless
its neighbours are bad.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trilattice.llm.common import slices, table

#: Elements whose content is no text. Fixed values.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "svg", "math", "object", "canvas", "audio", "video", "map", "button", "select", "head", "dialog", "menu", "menuitem", "fieldset", "datalist", "embed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = {"article", "main"}
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"}
#: Words of a class, id or role that mark reader comments, adverts and notices, and parts of the page's frame. Fixed values.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond"}
NOTICES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "adsense", "consent", "cookie", "cookies", "gdpr", "modal", "newsletter", "notice", "notices", "popup", "promo", "promoted",
    "promotion", "signup", "sponsor", "sponsored", "sponsors", "subscribe", "subscription",
}
FRAME = {
    "banner", "breadcrumb", "breadcrumbs", "complementary", "contentinfo", "footer", "masthead", "menu", "nav", "navbar", "navigation", "overlay", "pagination", "related",
    "share", "sharing", "sidebar", "social", "toolbar", "topbar", "widget", "widgets",
}
#: Words beside which a marker states how the page is laid out, as in no-sidebar or ad-free. Fixed values.
STATES = {"has", "have", "no", "not", "non", "with", "without", "is", "free", "open", "opened", "closed", "enabled", "disabled", "active", "off", "on", "allowed", "left", "right"}
#: Frequent function words of the languages of the corpus. Fixed values.
STOP_WORDS = set(
    "a an and are as at be by for from has have he in is it its of on or she that the they this to was were which will with you not but we "
    "au aux avec ce ces dans de des du elle en est et il la le les leur lui mais ne nous ou par pas pour que qui sur un une vous sont cette "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einen einer es fur für ich im in ist mit nicht oder sich sie sind so und von vor war wie wir zu zum zur "
    "al como con de del el ella en es esta este la las lo los mas más no o para pero por que qué se ser si su sus un una y".split()
)
LINK_DENSITY, SHORT, LONG, STOP_LOW, STOP_HIGH, NEAR = 0.5, 70, 200, 0.1, 0.2, 3

# an attribute as HTML reads it: a quote opens a value only right after the equals sign
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)))?+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\0]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]*+))?+""", re.S)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Letters of scripts that put no space between words; one says about as much as two others. Fixed ranges.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
HIDDEN, OF_COMMENTS, OF_NOTICES, OF_FRAME = "hidden", "comments", "notices", "frame"


def _sort_of(name: str, attributes: str) -> str:
    """What the attributes of an element say it is: hidden, comments, a notice, a part of the frame, or "" for none."""
    found = ""
    if not attributes or attributes.isspace():
        return found
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NOT_SHOWN.search(value):
            return HIDDEN
        # the id of a paragraph or heading is an anchor
        if key in ("class", "role") or key == "id" and name != "p" and name not in HEADINGS:
            for token in value.split():
                words = set(_WORDS.findall(_CAMEL.sub(" ", token).lower()))
                if words & STATES:
                    continue
                if words & COMMENTS:
                    found = OF_COMMENTS
                elif words & NOTICES and found != OF_COMMENTS:
                    found = OF_NOTICES
                elif words & FRAME and not found:
                    found = OF_FRAME
    return found


class Block:
    """One stretch of text without block tags in it."""

    __slots__ = ("parts", "linked", "heading", "region", "suspect", "text", "label")

    def __init__(self, region: int, suspect: int, heading: bool):
        self.parts, self.linked, self.heading, self.region, self.suspect, self.text, self.label = [], 0, heading, region, suspect, "", ""

    def letters(self) -> int:
        return len(self.text) - self.text.count(" ")

    def size(self) -> int:
        """Length, letters of unspaced scripts counting twice."""
        return len(self.text) + len(_UNSPACED.findall(self.text))


class Suspect:
    """An element that its attributes call boilerplate; `outer` is the suspect around it, -1 for none."""

    __slots__ = ("sort", "outer", "region", "articles", "mains")

    def __init__(self, sort: str, outer: int, region: int):
        self.sort, self.outer, self.region, self.articles, self.mains = sort, outer, region, False, False


def blocks_of(page: str) -> tuple[list[Block], list[Suspect], set[int]]:
    """The blocks of a page in order, its suspects, and the regions that stand in no suspect.

    region is 0 outside any article or main element, else the number of the outermost one.
    """
    out: list[Block] = []
    suspects: list[Suspect] = []
    clear: set[int] = set()
    # open elements: name, whether it drops its content, whether it opened the article region, the suspect around it
    stack: list[tuple[str, bool, bool, int]] = []
    # how often each name is open, and where the open block elements stand
    open_names: dict[str, int] = {}
    open_blocks: list[int] = []
    dropped = links = region = regions = 0
    suspect, comments = -1, 0
    heading = False
    block: Block | None = None
    at, size = 0, len(page)

    def text(piece: str) -> None:
        nonlocal block
        if dropped or not piece:
            return
        if block is None:
            if not piece.strip():
                return
            block = Block(region, suspect, heading)
            out.append(block)
        piece = html.unescape(piece)
        block.parts.append(piece)
        if links:
            block.linked += len("".join(piece.split()))

    def close(i: int) -> None:
        nonlocal dropped, links, region, heading, block, suspect, comments
        while len(stack) > i:
            name, drops, opens, outer = stack.pop()
            open_names[name] -= 1
            dropped -= drops
            links -= name == "a"
            if opens:
                region = 0
            if suspect != outer:
                comments -= suspects[suspect].sort == OF_COMMENTS
                suspect, block = outer, None
            if name in BLOCKS:
                open_blocks.pop()
                block = None
            if name in HEADINGS:
                heading = False

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if open_names.get(name):
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                close(i)
            if name in BLOCKS:
                block = None
            continue
        if name in ENDS_P and open_blocks and stack[open_blocks[-1]][0] == "p":
            close(open_blocks[-1])
        if name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack:
            peers = {"li"} if name == "li" else {"dt", "dd"} if name in ("dt", "dd") else {"option"} if name == "option" else {"td", "th"} if name in ("td", "th") else {"tr", "td", "th"}
            while stack and stack[-1][0] in peers:
                close(len(stack) - 1)
        if name in BLOCKS:
            block = None
        elif name == "br" and block is not None:
            block.parts.append("\n")
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if m[3].endswith("/") and name not in BLOCKS:
            continue
        sort = _sort_of(name, m[3]) if name not in ("html", "body") else ""
        if name == "form" and not sort:
            sort = OF_FRAME
        drops = name in DROPPED or name == "header" and not region or sort == HIDDEN
        outer = suspect
        # a comment may be an article of its own, but never the page's
        opens = name in CONTENT and not region and not drops and not dropped and (name == "main" or not comments and sort != OF_COMMENTS)
        if opens:
            sort = ""
        if name in CONTENT and not dropped:
            i = suspect
            while i >= 0 and not (suspects[i].mains if name == "main" else suspects[i].articles):
                suspects[i].articles = True
                suspects[i].mains = suspects[i].mains or name == "main"
                i = suspects[i].outer
        if sort and not drops and not dropped:
            suspects.append(Suspect(sort, suspect, region))
            suspect, block = len(suspects) - 1, None
            comments += sort == OF_COMMENTS
        if opens:
            regions += 1
            region = regions
            if suspect < 0:
                clear.add(region)
        dropped += drops
        links += name == "a"
        if name in HEADINGS:
            heading = True
        if name in BLOCKS:
            open_blocks.append(len(stack))
        open_names[name] = open_names.get(name, 0) + 1
        stack.append((name, drops, opens, outer))
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text], suspects, clear


def without_suspects(found: list[Block], suspects: list[Suspect], clear: set[int]) -> list[Block]:
    """The blocks outside suspects, and those of suspects that hold what the page is about.

    Comments hold it if they hold the main element. Others hold it if an article stands in them and none with text stands
    outside suspects. A part of the frame does so too if more than half of the text is in it, of the region it stands
    in or of a page without a region, and two blocks of it are good.
    """
    if not suspects:
        return found
    sizes, good = [0] * len(suspects), [0] * len(suspects)
    whole: dict[int, int] = {}
    article = False
    for b, label in zip(found, map(_first_pass, found)):
        article |= b.region in clear and b.suspect < 0
        whole[b.region] = whole.get(b.region, 0) + b.letters()
        if b.suspect >= 0:
            sizes[b.suspect] += b.letters()
            good[b.suspect] += label == "good"
    for i in range(len(suspects) - 1, -1, -1):
        if suspects[i].outer >= 0:
            sizes[suspects[i].outer] += sizes[i]
            good[suspects[i].outer] += good[i]
    total = sum(whole.values())
    kept = []
    for i, s in enumerate(suspects):
        holds = s.mains or s.sort != OF_COMMENTS and s.articles and not article
        if s.sort == OF_FRAME and (s.region or not article):
            holds |= good[i] > 1 and 2 * sizes[i] > (whole.get(s.region, 0) if s.region else total)
        kept.append(holds and (s.outer < 0 or kept[s.outer]))
    return [b for b in found if b.suspect < 0 or kept[b.suspect]]


def _density(b: Block) -> float:
    """Share of stop words among the words of a block."""
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def _first_pass(b: Block, known: bool = True) -> str:
    if b.linked > LINK_DENSITY * b.letters():
        return "bad"
    size = b.size()
    if size < SHORT:
        return "short"
    density = _density(b) if known else STOP_HIGH
    if density >= STOP_HIGH:
        return "good" if size > LONG else "near"
    if density >= STOP_LOW:
        return "near"
    return "bad"


def _nearest(found: list[Block], decided: list[str], order: range) -> list[str]:
    """For each block the label of the decided block of its region last met in this order, "" if there is none."""
    out, last, region = [""] * len(found), "", -1
    for i in order:
        if found[i].region != region:
            last, region = "", found[i].region
        out[i] = last
        if decided[i] in ("good", "bad"):
            last = decided[i]
    return out


def classify(found: list[Block], marked: bool) -> None:
    """Sets the label of each block to good or bad."""
    first = [_first_pass(b) for b in found]
    if not {"good", "near"} & set(first):
        # no stop word of a known language: a text without links is judged by its length
        first = [_first_pass(b, False) for b in found]
    for b, label in zip(found, first):
        if marked:
            # the page itself says where its article is; text with few links in it needs no stop words
            label = "bad" if not b.region else label if label != "bad" or b.linked * 2 > b.letters() else "good"
        b.label = label
    decided = [b.label for b in found]
    befores, afters = _nearest(found, decided, range(len(found))), _nearest(found, decided, range(len(found) - 1, -1, -1))
    for b, label, before, after in zip(found, decided, befores, afters):
        if label in ("good", "bad"):
            continue
        if b.region:
            # in a marked article only a block between bad ones falls with them
            b.label = "bad" if before == after == "bad" and not b.heading else "good"
        elif b.heading:
            b.label = after or "bad"
        elif before and before == after:
            b.label = before
        elif label == "near":
            b.label = "good" if "good" in (before, after) or not before and not after else "bad"
        else:
            b.label = "bad"


def main_text(page: str | None) -> str:
    """The article of a page: its good blocks in page order, joined by an empty line. Null and empty pages have none."""
    if not page:
        return ""
    found, suspects, clear = blocks_of(page)
    found = without_suspects(found, suspects, clear)
    marked = any(b.region for b in found)
    classify(found, marked)
    if marked and not any(b.label == "good" for b in found):
        for b in found:
            b.label = ""
        classify(found, False)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, page: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    A null or empty page, and one without article text, has the empty text. Null ids and urls and repeated rows pass
    through; other columns play no part; an empty table gives an empty one.
    """
    schema = pages.select(key, url).schema.add("text", "string", False).add("n_chars", "long", False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, page).mapInArrow(of, schema)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page of the table."""
    return extract(table(spark, sf_dir, "pages"))
