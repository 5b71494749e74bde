"""Operator 9: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags, in one pass whose time grows with
the page's length alone, whatever the markup. Pass one decides what structure,
link density, stop-word density and length can decide; pass two gives short and
unsure blocks the label of their nearest decided neighbour. Stop words count only
where they fit the page: text in other scripts, and pages whose long blocks are
in a language without a list, are judged by length and link density.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import read

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"<>]*"|'[^'<>]*')*+)(>?)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_STOP = re.compile("[>\"']")
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0{4,}"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_TOKEN, _PART = re.compile(r"[a-z]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WIDE, _LATIN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0eff]"), re.compile(r"[A-Za-z\u00c0-\u024f]")
_EDGE = re.compile(r"^\W+|\W+$")
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: skipped up to their end tag.
_RAW = frozenset("script style title textarea noscript iframe template svg math object noframes xmp".split())
#: Of these, those whose content is text to the page's end if they stay open.
_TEXT_ONLY = frozenset("script style title textarea xmp noframes iframe".split())
_BOILER_TAGS = frozenset("nav footer aside form button select option optgroup menu dialog search fieldset label".split())
#: Words of a class or id that make it boilerplate, alone or beside words of
#: layout: "site-footer" is, "ad-lib" and "navigation-guide" are not.
_BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar cookie cookies consent gdpr newsletter subscribe subscription signup comments disqus modal popup overlay toolbar login pagination pager".split())
#: These only beside words of layout: "related-posts" is boilerplate, but
#: "related-work" is not.
_WEAK_WORDS = frozenset("banner promo promotion notice comment reply replies respond share sharing social related recommended widget copyright disclaimer skip more".split())
_LAYOUT_WORDS = _WEAK_WORDS | frozenset("area articles bar block body box btn button buttons card cards col column container content entry feed form group header icons inner item items left link links list main media module news outer panel posts reading right row section site stories story text thread title top us wrap wrapper".split())
#: More words of layout, and words after which a name tells what an element has
#: or lacks, not what it is.
_QUALIFIERS = _LAYOUT_WORDS | _BOILER_WORDS | frozenset("a active bg bottom center close desktop fixed float footer full global google header hero horizontal inline large lg local md meta mini mobile new open page primary responsive secondary sec sidebar slot sm small sticky sub tertiary unit utility v vertical web wide xs".split())
_HAVING = frozenset("has have hide no non not show with without".split())
#: What readers write, and asks of them: never the main text, however long.
_NEVER = frozenset("comment comments cookie cookies consent disqus gdpr login newsletter popup replies reply respond signup subscribe subscription".split())
_HEADER_WORDS = frozenset(["header", "headers", "topbar"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SCOPES = frozenset(["article", "main"])
#: Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    (
        "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
        "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous "
        "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch sein sich sie sind so über um und von war wie wird zu zum zur "
        "al como con de del el ella en entre era es esta este fue ha la las lo los más no o para pero por que se ser si sin sobre su sus también un una y"
    ).split()
)
MIN_CHARS, MAX_LINKS, LOW_STOPS, HIGH_STOPS = 70, 0.5, 0.15, 0.3
#: A form, or an element of a boilerplate name, is the page and no boilerplate if
#: it has so many characters of good text and HOLDS times as many as the rest.
FORM_CHARS, NAMED_CHARS, HOLDS = 140, 280, 3


class Block:
    """A run of text without a block boundary."""

    __slots__ = ("parts", "linked", "boiler", "scope", "heading", "text", "label", "soft", "main")

    def __init__(self, boiler: bool, scope: int, heading: bool, soft: tuple[int, int] | None = None, main: bool = False):
        self.parts, self.linked, self.boiler, self.scope, self.heading, self.text, self.label = [], 0, boiler, scope, heading, "", None
        self.soft, self.main = soft, main  # the one container that makes it boilerplate but may hold the page, and how much it must hold


def _named_boiler(value: str) -> str:
    """Whether a class or id value names boilerplate: "never" is the main text,
    "name" may hold it, or ""."""
    found = ""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not parts or parts[0] in _HAVING:
            continue
        strong = any(p in _BOILER_WORDS for p in parts) and all(p in _QUALIFIERS for p in parts)
        if strong or any(p in _WEAK_WORDS and p != "more" for p in parts) and all(p in _LAYOUT_WORDS for p in parts):
            if any(p in _NEVER for p in parts):
                return "never"
            found = "name"
    return found


def _is_boiler(name: str, attrs: str, in_scope: bool) -> str:
    """Why an element is boilerplate: "never", "form" or "name" (these two may
    hold the page), or "" if it is none."""
    if name in _BOILER_TAGS and name != "form" or name == "header" and not in_scope:
        return "never"
    why = "form" if name == "form" else ""
    if not attrs or name in ("html", "body", "main"):
        return why
    for key, value in _ATTR.findall(attrs):
        key, raw = key.lower(), value.strip("\"'")
        value = raw.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES or key == "style" and re.search(r"display\s*:\s*none", value):
            return "never"
        if key in ("class", "id"):
            if name == "article":
                if set(_TOKEN.findall(value)) & {"comment", "comments", "ad", "advert", "sponsored"}:
                    return "never"
            elif named := _named_boiler(raw):
                if named == "never":
                    return named
                why = named
            elif not in_scope and set(_TOKEN.findall(value)) & _HEADER_WORDS and not set(_TOKEN.findall(value)) & _HAVING:
                why = why or "name"
    return why


class _Page:
    """Where tags end. Searches that find nothing are not made again, so a page
    is read once whatever is left open in it."""

    def __init__(self, page: str):
        self.page, self.absent = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The end of a tag whose attributes go on at `at`, past quoted values;
        -1 if it is cut off. A quote that is never closed is a plain character."""
        while True:
            if ">" in self.absent or not (m := _STOP.search(self.page, at)):
                self.absent.add(">")
                return -1
            at = m.end()
            if m[0] == ">":
                return at
            close = self.find(m[0], at)
            if close >= 0:
                at = close + 1

    def raw_end(self, name: str, at: int) -> int:
        """The end of an element without markup, or -1."""
        if name in self.absent:
            return -1
        m = re.compile(rf"</{name}\s*+>", re.I).search(self.page, at)
        if not m:
            self.absent.add(name)
        return m.end() if m else -1


def _plain(raw: str) -> str:
    """Character references decoded, white space as one space."""
    if "&" in raw:
        if "&#" in raw:
            raw = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", raw))
        raw = html.unescape(raw)
    return " ".join(raw.split())


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple] = []  # open elements: name, boilerplate, scope, container that may hold the page, in main
    opened: dict[str, int] = {}  # how often each name is in the stack
    boiler, scope, soft, in_main, links, scopes, softs = False, 0, None, False, 0, 0, 0
    block, ends = Block(False, 0, False), _Page(page)

    def flush(heading: bool) -> Block:
        block.text = _plain("".join(block.parts))
        if block.text:
            out.append(block)
        return Block(boiler, scope, heading, soft, in_main)

    def add(raw: str) -> None:
        if raw:
            block.parts.append(raw)
            if links:
                block.linked += len("".join(raw.split()))

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at, name, attrs = m.end(), (m[2] or "").lower(), m[3]
        if not name:
            continue
        if not m[4]:  # quotes that hold markup, or a tag that breaks off
            end = ends.tag_end(m.end(2))
            if end < 0:
                after = page.find("<", at)
                at = len(page) if after < 0 else after  # markup up to the next tag
                continue
            attrs, at = page[m.end(2) : end - 1], end
        if name in ("br", "wbr", "img"):
            block.parts.append(" " if name == "br" else "")
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if opened.get(name):
                while pop() != name:
                    pass
            boiler, scope, soft, in_main = stack[-1][1:] if stack else (False, 0, None, False)
            if name in _BLOCK:
                links = 0
                block = flush(False)
            continue
        closed = attrs.endswith("/")
        if name in _RAW and not (closed and name in ("svg", "math")):
            end = ends.raw_end(name, at)
            at = end if end >= 0 else len(page) if name in _TEXT_ONLY else at
            if name in _BLOCK:
                block = flush(False)
            continue
        if name == "a":
            links += 1
        if name not in _VOID and not closed:
            if name == "p" and stack and stack[-1][0] == "p":
                pop()
            inside = opened.get("article", 0) + opened.get("main", 0) > 0
            if name in _SCOPES:
                scopes += 1
                scope = scopes
            in_main = in_main or name == "main"
            if not boiler or soft:
                why = _is_boiler(name, attrs, inside)
                if why and (boiler or why == "never"):
                    boiler, soft = True, None
                elif why:
                    softs += 1
                    boiler, soft = True, (softs, FORM_CHARS if why == "form" else NAMED_CHARS)
            stack.append((name, boiler, scope, soft, in_main))
            opened[name] = opened.get(name, 0) + 1
        if name in _BLOCK:
            links = 0
            block = flush(len(name) == 2 and name[0] == "h" and name[1].isdigit())
    add(page[at:])
    flush(False)
    return out


@functools.lru_cache(1 << 16)
def _stops(word: str) -> bool | None:
    """Whether a word is a stop word; None for what is no word."""
    word = _EDGE.sub("", word).lower()
    return word in STOP_WORDS if word else None


def stop_density(text: str) -> float:
    kinds = [k for k in map(_stops, text.split()) if k is not None]
    return sum(kinds) / len(kinds) if kinds else 0.0


def _length(text: str) -> int:
    """Characters; those of scripts without spaces count twice."""
    return len(text) + (0 if text.isascii() else len(_WIDE.findall(text)))


def _listed_script(text: str) -> bool:
    """Whether most letters are of the script that the stop words are in."""
    letters = len(text) if text.isascii() else sum(map(str.isalpha, text))
    return text.isascii() or 2 * len(_LATIN.findall(text)) >= letters


def _linked(b: Block) -> bool:
    return b.linked > MAX_LINKS * max(1, len(b.text) - b.text.count(" "))


def _release(blocks: list[Block]) -> None:
    """Forms and named elements that hold the page are no boilerplate; what is
    boilerplate inside them stays so."""
    most: dict[tuple[int, int], int] = {}
    for b in blocks:
        if b.soft:
            most[b.soft] = most.get(b.soft, 0) + _length(b.text)
    if not any(n >= c[1] for c, n in most.items()):
        return
    held: dict[tuple[int, int], int] = {}
    free = 0
    for b in blocks:
        n = _length(b.text)
        if b.boiler and not b.soft or n < MIN_CHARS or _linked(b) or _listed_script(b.text) and stop_density(b.text) < LOW_STOPS:
            continue
        if b.soft:
            held[b.soft] = held.get(b.soft, 0) + n
        else:
            free += n
    pages = {c for c, n in held.items() if n >= c[1] and n > HOLDS * (free + sum(held.values()) - n)}
    for b in blocks:
        if b.soft in pages:
            b.boiler, b.soft = False, None


def _first_pass(blocks: list[Block]) -> None:
    """True: main text, False: boilerplate, None: open."""
    dense: list[tuple[Block, int, float]] = []
    for b in blocks:
        n = _length(b.text)
        if b.boiler or _linked(b):
            b.label = False
        elif n < MIN_CHARS:
            b.label = None
        elif not _listed_script(b.text):
            b.label = True
        else:
            dense.append((b, n, stop_density(b.text)))
    # The lists fit the page if what passes them is at least half of what they judge.
    fit = 2 * sum(n for _, n, d in dense if d >= LOW_STOPS) >= sum(n for _, n, _ in dense)
    for b, n, d in dense:
        if not fit:
            b.label = True
        elif d >= LOW_STOPS and (d >= HIGH_STOPS or n >= 2 * MIN_CHARS or b.scope):
            b.label = True
        else:
            b.label = None if b.scope or d >= LOW_STOPS else False


def _second_pass(blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided one, of their own
    article if it has any; at equal distance the main text wins, and headings
    go with what follows them. An article without decided blocks is main text."""
    first = [b.label for b in blocks]
    before: list[int | None] = []
    last: dict[int, int] = {}  # by scope, and -1 for anywhere

    def see(i: int) -> None:
        if first[i] is not None:
            last[-1] = i
            if not blocks[i].boiler:
                last[blocks[i].scope] = i

    for i, b in enumerate(blocks):
        before.append(last.get(b.scope if b.scope else -1))
        see(i)
    last.clear()
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        left, right = before[i], last.get(b.scope if b.scope else -1)
        see(i)
        if first[i] is not None:
            continue
        if left is None and right is None:
            b.label = bool(b.scope)
        elif left is None or right is not None and (b.heading or right - i < i - left):
            b.label = first[right]
        elif right is None or i - left < right - i:
            b.label = first[left]
        else:
            b.label = first[left] or first[right]


def main_text(page: str | None) -> str:
    """The article of a page, or "" if it has none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    _release(blocks)
    _first_pass(blocks)
    if not any(b.label or b.scope for b in blocks):  # a short page: what is no boilerplate is all there is
        for b in blocks:
            b.label = b.label is None
    long = sum(len(b.text) for b in blocks if b.label and not b.scope)
    _second_pass(blocks)
    good = [b for b in blocks if b.label]
    inside = [b for b in good if b.scope]
    # Text outside article elements is none of it, unless they are small ones
    # beside a longer text. A main element is always the page.
    if inside and (any(b.main for b in inside) or sum(len(b.text) for b in inside) >= long):
        good = inside
    return " ".join(b.text for b in good)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each row of pages (page_id, url, html).

    Returns page_id, url, text ("" if none), n_chars (code points). A page is
    worked whole, whatever its length; unclosed tags and pages that break off
    are read as far as they go.

    Null or empty html: text "". Null ids and urls stay null. Repeated rows:
    each gives its row. Empty table: empty result. Other columns are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [main_text(x) for x in part.pop("html")]
            yield part.assign(text=text, n_chars=[len(x) for x in text])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op9_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
