"""Main text of web pages by line-block distribution.

The markup is stripped into lines, one for each block of the page. Lines of page furniture (navigation, headers, footers,
sidebars, notices, adverts, forms, reader comments) go. A class or id names furniture if it is one of
the known names, or a phrase of them and of words for places (``site-footer``); ``has-sidebar`` or ``related-work`` is none.
Names don't count on headings and paragraphs of a marked article, nor ids on them and on sections of a main part, where they
are slugs of titles, nor on an element that holds the page's only article, unless there is more text outside it. A form that
holds most of the page's text is a page, not a form.

Every other line gets a length: its characters outside links. Marks weigh the lines: where the page marks an article, or else
a main part, and no more than it holds (or than two surges) is outside, its lines alone count, with their links and ``SURGE`` more; an article that is a minor part (a teaser in the main part, a remark) is weighed like any other text. Lengths
are summed over sliding windows of ``WINDOW`` lines. A line of some length whose window sum is ``SURGE`` or more (or the page's
largest, if that is less) is a surge point. The text runs from there to the next dive point, where a window sum is 0, and so
on from surge to dive. All lines between are kept, those that are one link included.

Defined cases: null and empty pages have the empty text; broken markup is read as far as it goes (an unclosed comment,
script or tag reaches to the end of the page); character references are decoded once, after the markup is gone, also
without their semicolon where HTML allows that; repeated rows are extracted each for itself.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common as C

WINDOW = 3
SURGE = 80

#: Elements whose content is no text, furniture elements, elements inside a line, void elements.
_RAW = frozenset("script style noscript template iframe svg math object canvas video audio textarea title head".split())
_FURNITURE = frozenset("nav footer aside menu dialog button select fieldset".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"},
}
#: Blocks that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: Class and id names that mark furniture, and words that may stand beside them in a phrase.
_FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup skyscraper social sponsor sponsored "
    "subscribe subscription toolbar topbar trending widget widgets alert form search".split()
)
_PLACES = frozenset("site page global main primary secondary top bottom box bar area list block links link section container wrapper wrap posts articles item items form".split())
_ARTICLE_NAMES = frozenset("article articlebody entry post story".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_MARKUP = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_furniture(value: str, in_article: bool) -> bool:
    """Whether one of the names of a class or id is a furniture name or phrase. An article has headers of its own."""
    for name in value.split():
        parts = {w.lower() for w in _WORDS.findall(name)}
        known = parts & _FURNITURE_NAMES
        if (name.lower() in _FURNITURE_NAMES or known and parts <= _FURNITURE_NAMES | _PLACES) and not (in_article and known == {"header"}):
            return True
    return False


def _kind(tag: str, attributes: str, in_article: bool, in_main: bool = False) -> str:
    """furniture, named (furniture by its class or id), article (marked), main, or plain."""
    if tag in _FURNITURE or tag == "header" and not in_article:
        return "furniture"
    found, named = "", tag == "form"
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "role":
                if value.lower() in _ROLES:
                    return "furniture"
                found = found or ("main" if value.lower() == "main" else "article" if value.lower() == "article" else "")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                return "furniture"
            elif name in ("class", "id"):
                slug = in_article and tag in _HEADINGS or name == "id" and (in_article or in_main) and (tag in _HEADINGS or tag == "section")
                named = named or tag not in ("body", "html", "main") and not slug and _names_furniture(value, in_article)
                parts = {w.lower() for w in _WORDS.findall(value)}
                if parts & _ARTICLE_NAMES and tag in ("div", "section"):
                    found = found or "main"
            elif name == "itemprop" and value.lower() == "articlebody":
                found = "article"
    return "named" if named else "article" if tag == "article" else found or ("main" if tag == "main" else "")


def lines_of(page: str, holders: bool = False, forms: bool = True) -> list[tuple[str, int, int, int]]:
    """(text, characters or 0 for furniture, those outside links, level) of every line with text; level 2: in a marked
    article, 1: in the main part, 0: elsewhere. With ``holders``, named furniture that holds an article is none; without
    ``forms``, no form is."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, str]] = []
    counts = {"furniture": 0, "named": 0, "article": 0, "main": 0, "a": 0}
    pieces: list[str] = []
    plain: list[str] = []
    at, n = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            pieces.append(piece)
            if not counts["a"]:
                plain.append(piece)

    def flush() -> None:
        if pieces:
            line = " ".join(html.unescape("".join(pieces)).split())
            if line:
                shown = not (counts["furniture"] or counts["named"])
                size, free = (len("".join(html.unescape("".join(p)).split())) if shown else 0 for p in (pieces, plain))
                out.append((line, size, free, 2 if counts["article"] else 1 if counts["main"] else 0))
            pieces.clear()
            plain.clear()

    def push(tag: str, kind: str) -> None:
        stack.append((tag, kind))
        if kind:
            counts[kind] += 1
        if tag == "a":
            counts["a"] += 1

    def pop() -> None:
        tag, kind = stack.pop()
        if kind:
            counts[kind] -= 1
        if tag == "a":
            counts["a"] -= 1

    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m.group() == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        tag, closing, attributes = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if tag in _RAW and not closing:
            if tag == "head" or attributes.endswith("/"):
                continue
            end = re.compile(f"</{tag}[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in _INLINE:
            flush()
        if closing:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in _VOID and not attributes.endswith("/"):
            closes = _CLOSES.get(tag) or ({"p"} if tag in _ENDS_P else ())
            if closes:
                _close(stack, closes, pop)
            kind = _kind(tag, attributes, counts["article"] > 0, counts["main"] > 0) if forms or tag != "form" else ""
            if holders and kind == "article" and counts["named"]:
                stack[:] = [(t, "" if k == "named" else k) for t, k in stack]
                counts["named"] = 0
            if kind in ("furniture", "named") and tag in _INLINE:
                flush()
            push(tag, kind)
    flush()
    return out


def _close(stack, tags, pop) -> None:
    """Ends an open element of ``tags`` with the inline elements above it."""
    depth = len(stack)
    while depth and (stack[depth - 1][0] in _INLINE or stack[depth - 1][0] in tags):
        depth -= 1
    if any(t in tags for t, _ in stack[depth:]):
        while len(stack) > depth:
            pop()


def _shown(lines: list[tuple[str, int, int, int]]) -> int:
    return sum(size for _, size, _, _ in lines)


def _marked(page: str) -> list[tuple[str, int, int, int]]:
    """The page's lines. Where no article is outside furniture, one in named furniture counts, if it has most of the text; and a
    form is furniture only if it has less text than the rest of the page."""
    lines = lines_of(page)
    if "<form" in page.lower() and _shown(open_form := lines_of(page, forms=False)) > 2 * _shown(lines):
        lines = open_form
    if any(lv == 2 and size for _, size, _, lv in lines) or not any(lv == 2 for *_, lv in lines):
        return lines
    again = lines_of(page, holders=True)
    return again if sum(size for _, size, _, lv in again if lv == 2) > _shown(lines) else lines


def weighed(lines: list[tuple[str, int, int, int]]) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """The lines that may be text, by the marks of the page, and their lengths."""
    total = sum(size if lv else free for _, size, free, lv in lines)
    for level in (2, 1):
        part = [x for x in lines if x[3] >= level]
        if part and total - _shown(part) <= max(_shown(part), 2 * SURGE):
            return part, [size + SURGE for _, size, _, _ in part]
    return lines, [free for _, _, free, _ in lines]


def spans(lengths: list[int]) -> list[tuple[int, int]]:
    """(surge, end) of every stretch of lines from a surge point to the next dive point."""
    n = len(lengths)
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    surge = max(1, min(SURGE, max(sums, default=0)))
    out, at = [], 0
    while (first := next((i for i in range(at, n) if lengths[i] and sums[i] >= surge), n)) < n:
        at = next((i for i in range(first, n) if sums[i] == 0), n)
        last = max(i for i in range(first, at) if lengths[i])
        out.append((first, last + 1))
    return out


def main_text(page: str | None) -> str:
    lines, lengths = weighed([line for line in _marked(page or "") if line[1]])
    return "\n".join(line for first, end in spans(lengths) for line, *_ in lines[first:end])


def extract(pages: DataFrame, id_cols: list[str], html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``id_cols`` with the text of every page. A map over the scan, without a shuffle."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    name = C.free_name(id_cols, out_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in id_cols] + [pa.array(texts, pa.string())], names=[*id_cols, name])

    schema = ", ".join([f"`{c}` {types[c]}" for c in id_cols] + [f"`{name}` string"])
    return C.map_rows(pages, list(dict.fromkeys([*id_cols, html_col])), schema, run)
