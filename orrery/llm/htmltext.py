"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides each block by itself: many links make it
boilerplate; of the others a long one is main text if enough of its words are stop words, boilerplate if few are.
On a page where no long block has the stop words of a known language they tell nothing; there a long block is main
text if it is punctuated as prose is.  Blocks in between, short ones and headings stay ambiguous.  The second pass
gives each of those the label of the nearest decided block of the same part of the page (a heading: of the one that
follows it), main text if two are as near.

Markup is evidence besides: navigation, footers, sidebars, forms and hidden elements, and headers outside an article,
are never main text.  A part whose class, id or role names it as comments, notice, advert and the like is not either,
unless that would leave the page without its main text: a wrapper such as ``has-sidebar`` or ``share-enabled``
around the article counts for nothing.  Where articles hold a good part of the page's main text, all of it is in them, and in
them long blocks with few stop words are ambiguous, not boilerplate.

Defined results: null or empty html gives an empty text; of a page with nothing decided, ambiguous blocks are its
text; markup left open at the end closes there; html of any length is read whole; repeated rows are extracted one by
one; an empty table gives an empty result; further columns are kept by ``extract``.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.runtime import arrow_limits

SHORT, FEW_STOPS, MANY_STOPS, MOST_LINKS = 70, 0.15, 0.25, 0.4
#: Share of a page's main text that articles must hold to be all of it; share that a wrapper must hold to be no boilerplate.
ARTICLE_SHARE, WRAPPER_SHARE = 0.3, 0.5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this
    to was we were which will with you
    aber als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht
    noch oder sich sie sind so um und von vor war wie wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qui que
    sa se ses son sont sur un une vous
    al ante con como cuando del desde donde el ella ellos entre era es esta este la las lo los más muy no nos o para pero por que se
    sin sobre son su sus también un una y ya""".split()
)
_BAD_TAGS = frozenset("nav footer aside form button select dialog menu".split())
_SKIP_TAGS = "script|style|noscript|template|title|textarea|iframe|svg|object|math|canvas|audio|video"
#: Names that hold for a part of any size, and names that a wrapper of the main text may bear as well.
_SURE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsbygoogle breadcrumb breadcrumbs comment comments commentlist consent contentinfo
    cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter pager pagination popup replies reply respond
    signup skyscraper sponsor sponsored subscribe subscription toolbar""".split()
)
_WEAK_NAMES = frozenset(
    """alert banner complementary dialog header notice notification promo promotion recommended related search share sharing sidebar
    social widget widgets""".split()
)
#: A name that begins or ends so speaks of the layout, not of the part.
_LAYOUT = frozenset("has no with without is not js enabled disabled free open closed on off".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN_TAGS = frozenset(("article", "main"))
_BLOCK_TAGS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th
    thead tr ul button""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_SKIP_TAGS})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[/!?][^>]*>|<[a-zA-Z][^<>]*(?:>|\Z)""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Scripts that write a word in one to three characters; marks of prose in many scripts.
_DENSE = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_PROSE = re.compile("[.,;:!?\u2026\u060c\u061b\u061f\u06d4\u0964\u0965\u3001\u3002\uff0c\uff0e\uff1a\uff1b\uff01\uff1f]")


@dataclass
class Block:
    """text; linked: its characters inside links; barred: in an element that never is main text; main: article it stands in, or 0;
    named: the open parts that a name speaks against; heading: whether it is one."""

    text: str
    linked: int
    barred: bool
    main: int
    named: tuple[int, ...]
    heading: bool


def _barred(tag: str, attributes: str, main: int) -> bool:
    if tag in _BAD_TAGS or tag == "header" and not main:
        return True
    return bool(attributes) and tag not in ("html", "body", "article", "main") and bool(_HIDDEN.search(attributes))


def _name_strength(tag: str, attributes: str, main: int) -> int:
    """2: a name that holds for a part of any size; 1: one that a wrapper may bear; 0: none.

    Inside an article only whole names count, and the ids of headings (anchors) do not.
    """
    found = 0
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    for m in _NAMED.finditer(attributes):
        if main and tag in _HEADINGS and m[0][:2].lower() == "id":
            continue
        for name in m[1].strip("\"'").split():
            parts = [x.lower() for x in _NAME_PART.findall(name)]
            if not parts or parts[0] in _LAYOUT or parts[-1] in _LAYOUT or main and len(parts) > 1:
                continue
            found = max(found, 2 if not _SURE_NAMES.isdisjoint(parts) else 1 if not _WEAK_NAMES.isdisjoint(parts) else 0)
    return found


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page in order, and the strength of the name of each named part."""
    out: list[Block] = []
    strength: list[int] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []
    text: list[str] = []
    barred, main, named, links, linked, mains, breaks, heading = False, 0, (), 0, 0, 0, 0, False

    def flush() -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append(Block(whole, linked, barred, main, named, heading))
        text.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if not piece.isspace():
                breaks = 0
            if links:
                linked += len(html.unescape(piece).strip())
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            text.append(" ")
            if breaks == 2:
                flush()
            continue
        if tag == "a":
            links = 0 if m[2] else 1
            continue
        if tag in _BLOCK_TAGS:
            flush()
            heading = tag in _HEADINGS and not m[2]
        if tag in _VOID or m[4].endswith("/") and tag not in _BLOCK_TAGS:
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in _BLOCK_TAGS:
                        flush()
                    _, barred, main, named = stack[i]
                    del stack[i:]
                    break
            continue
        bars, says = _barred(tag, m[4], main), _name_strength(tag, m[4], main)
        if tag in _BLOCK_TAGS or bars or says:
            if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and not bars and not says:
                continue  # often left open; they hold no part of the page
            if tag not in _BLOCK_TAGS:
                flush()
            if tag in _MAIN_TAGS:  # a menu or header left open does not reach into the article
                while stack and stack[-1][0] in ("nav", "header", "footer", "ul", "ol"):
                    _, barred, main, named = stack.pop()
            stack.append((tag, barred, main, named))
            barred = barred or bars
            if says:
                named = (*named, len(strength))
                strength.append(says)
            if tag in _MAIN_TAGS and not main:
                mains += 1
                main = mains
    text.append(page[at:])
    flush()
    return out, strength


def size(text: str) -> int:
    """Length in characters; scripts that write words in few of them count threefold."""
    return len(text) + 2 * len(_DENSE.findall(text))


def stop_share(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / max(1, len(found))


def first_pass(found: list[Block]) -> list[bool | None]:
    """For each block by itself True for main text, False for boilerplate, None where ambiguous."""
    wordy = [not b.barred and b.linked <= MOST_LINKS * len(b.text) for b in found]
    stops = [stop_share(b.text) if w and not b.heading and size(b.text) >= SHORT else None for b, w in zip(found, wordy)]
    known = any(s is not None and s >= FEW_STOPS for s in stops)  # else stop words tell nothing of the page's language
    labels: list[bool | None] = []
    for b, w, s in zip(found, wordy, stops):
        if s is None:
            labels.append(None if w else False)
        elif known:
            labels.append(True if s >= MANY_STOPS else None if s >= FEW_STOPS or b.main else False)
        else:
            labels.append(True if _PROSE.search(b.text) and b.linked <= MOST_LINKS / 2 * len(b.text) else None)
    return labels


def bar_parts(found: list[Block], strength: list[int], labels: list[bool | None]) -> list[bool | None]:
    """Labels with the evidence of names and articles: what stands in a part that they speak against is boilerplate."""
    sure = {i for i, s in enumerate(strength) if s == 2}
    # what names of any size leave; an article weighs more than text around it, so that its wrapper holds most of the page
    weight = [size(b.text) * (4 if b.main else 1) if label and sure.isdisjoint(b.named) else 0 for b, label in zip(found, labels)]
    inside: Counter[int] = Counter()
    for b, n in zip(found, weight):
        for part in b.named:
            inside[part] += n
    against = sure | {i for i in range(len(strength)) if inside[i] <= WRAPPER_SHARE * sum(weight)}
    able = [b for b, label in zip(found, labels) if label is not False]
    if able and not any(against.isdisjoint(b.named) for b in able):  # nothing would be left: the largest part is the page
        held = Counter({b.named[0]: 0 for b in able})
        for b in able:
            held[b.named[0]] += size(b.text)
        against.discard(max(held, key=lambda p: (held[p], -p)))
    labels = [False if any(p in against for p in b.named) else label for b, label in zip(found, labels)]
    held = sum(size(b.text) for b, label in zip(found, labels) if label)
    in_articles = sum(size(b.text) for b, label in zip(found, labels) if label and b.main)
    if in_articles > ARTICLE_SHARE * held or not held and any(b.main and label is None for b, label in zip(found, labels)):
        labels = [label if b.main else False for b, label in zip(found, labels)]
    return labels


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided block of their part; without one they are main text in an
    article, and on a page with no main text decided."""
    n = len(labels)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            if labels[i] is None:
                near[i] = last.get(found[i].main)
            else:
                last[found[i].main] = (i, bool(labels[i]))
    none_decided = not any(labels)
    out = []
    for i, (b, label) in enumerate(zip(found, labels)):
        if label is not None:
            out.append(label)
            continue
        sides = [(abs(i - s[0]), not s[1]) for s in ((after[i],) if b.heading and after[i] else (before[i], after[i])) if s]
        out.append(not min(sides)[1] if sides and not none_decided else bool(b.main) or none_decided)
    return out


def main_text(page: str | None) -> str:
    found, strength = blocks(page or "")
    kept = second_pass(found, bar_parts(found, strength, first_pass(found)))
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def _extract(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in parts:
        yield pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with the column ``text``, never null, in place of the html."""
    arrow_limits(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (column, "text")]
    return pages.select(*kept, F.arrow_udf(_extract, "string")(F.col(column)).alias("text"))
