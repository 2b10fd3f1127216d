"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. The first pass judges every block by itself: link
density, length and stop-word density make it good or bad, or leave it ambiguous if it is short or of
middling density. The second pass lets ambiguous blocks inherit the label of their nearest decided
neighbours. Blocks that come out good are the text.

What element holds a block is a feature of the rules. Menus, forms, adverts, notices, sidebars, comment
sections and the like are bad by that cue alone, and so is what lies outside the article or main element
of a page that has one. Inside it, densities and neighbours decide, with a leaning: few stop words make
a block ambiguous, not bad (it may be in any language); its edges count as good neighbours; and an
ambiguous block is bad only between two bad neighbours.

A page without an article has the rules alone. Stop words count there if the page's words hold a share of KNOWN of them;
else its language is none that STOP knows, and length and links decide (ideographs count for three
characters). If no block is decided good, the ambiguous ones are text, and if there are none either, class, id and role
are outvoted: what they mark, menus, forms and the like aside, is text where densities say so. A page with any text
but menus and their like thus seldom gives none.

Defined results: null or empty html gives an empty text; an unclosed comment, script or excluded
element reaches to the end of its parent or the page, an unclosed tag to the end of the page; after
QUOTE_FAILURES tags whose quotes never close, quotes in tags are no longer minded, so that reading takes
time in proportion to the page; each row is a page, repeated ones too; only page_id, url and html are
read, so other columns can have any name; an empty table stays empty.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by their part in a page.
RAW = "script|style|noscript|template|iframe|svg|math|object|canvas|select|textarea|title|noembed|noframes|xmp"
OUTSIDE = frozenset("nav footer aside form head menu dialog button fieldset header".split())
INSIDE = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end tags are counted; the others end with the next block.
NESTED = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form head header html main menu nav ol section table ul button".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark what is no article text.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead cookie cookies consent notice notices notification alert popup modal overlay comment comments disqus respond reply replies share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search widget widgets pagination pager toolbar skip complementary contentinfo "
    "sidenav topbar toc tags".split()
)
# Frequent function words of the languages judged by density.
STOP = frozenset(
    "the of and to in a is that it for on was with as be by this are from or have an they which you at not he his but had we her she there been if their who will so "
    "de la le les et des en un une du que qui dans est pour par sur pas plus au avec ce se il ne son "
    "der die das und ist von zu den mit nicht ein eine auf für im dem als auch es sich an werden aus er hat dass sie nach bei wird "
    "el los las y del por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre".split()
)
#: What can decide a block.
BY = ("cue", "density", "neighbours")
#: Lengths in characters, densities as shares.
SHORT, LONG, LINKED, STOP_LOW, STOP_HIGH, KNOWN = 70, 200, 0.5, 0.15, 0.25, 0.08

#: Tags with quotes that don't close before quotes are given up.
QUOTE_FAILURES = 16

_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW.split("|")}
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    outside: bool = False
    inside: bool = False
    marked: bool = False
    heading: bool = False
    text: str = ""


def _marked(attributes: str, inside: bool) -> bool:
    """Whether class, id or role hold one of the words, alone or joined by hyphens or underscores. An article's own header is no mark."""
    for value in _MARKS.findall(attributes):
        for word in _WORD.findall(value.lower().replace("_", "-")):
            if not MARKED.isdisjoint({word, *word.split("-")} - ({"header"} if inside else set())):
                return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, is it an end tag, attributes) of every piece of markup in order; what is no element has no name."""
    at, failures, last = 0, 0, page.rfind(">")
    while m := _START.search(page, at):
        name, attributes, end = (m[3] or "").lower(), "", len(page)
        if m[1]:
            closed = _COMMENT_END.search(page, m.end())
            end = closed.end() if closed else end
        elif m.end() <= last:
            quoted = _QUOTED.match(page, m.end()) if name and failures < QUOTE_FAILURES else None
            failures += bool(name) and quoted is None
            end = quoted.end() if quoted else page.index(">", m.end()) + 1
            attributes = page[m.end() : end - 1]
        if name in _RAW_END and not m[2]:
            closed = _RAW_END[name].search(page, end)
            name, end = "", closed.end() if closed else len(page)
        at = end
        yield m.start(), end, name, m[2] == "/", attributes


def blocks(page: str) -> Iterator[Block]:
    """The page's blocks that hold text, in order."""
    stack: list[tuple[str, bool, bool, bool]] = []  # name, outside, inside, outside by more than a mark, of the open nested elements
    opened: dict[str, int] = {}
    now, links, at = Block(), 0, 0
    heading = False

    def closed() -> Block | None:
        now.text = " ".join(entities.unescape("".join(now.parts)).split())
        return now if now.text else None

    def fresh() -> Block:
        top = stack[-1] if stack else ("", False, False, False)
        return Block(outside=top[1], inside=top[2], marked=top[1] and not top[3], heading=heading)

    for start, end, name, is_end, attributes in tags(page):
        if start > at:
            now.parts.append(page[at:start])
            now.link_chars += (start - at) * bool(links)
        at = end
        if name == "a":
            links = max(0, links - 1) if is_end else links + 1
        if name not in BLOCK and name not in NESTED:
            continue
        if done := closed():
            yield done
        links = 0 if name in NESTED else links
        heading = name in HEADING and not is_end
        if name in NESTED:
            if not is_end:
                outside, inside, named = stack[-1][1:] if stack else (False, False, False)
                is_main = name in INSIDE or _MAIN.search(attributes) is not None
                named = named or name in OUTSIDE and not (name == "header" and inside)
                apart = name in OUTSIDE and not (name == "header" and inside) or name not in ("body", "html") and not is_main and _marked(attributes, inside)
                apart = apart or name == "article" and inside and _marked(attributes, inside)
                if not attributes.endswith("/"):
                    stack.append((name, outside or apart, inside or is_main and not (outside or apart), named))
                    opened[name] = opened.get(name, 0) + 1
            elif opened.get(name):
                gone = ""
                while gone != name:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
        now = fresh()
    if at < len(page):
        now.parts.append(page[at:])
    if done := closed():
        yield done


def _stop_words(text: str) -> tuple[int, int]:
    tokens = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP for w in tokens), len(tokens)


def known_language(found: list[Block]) -> bool:
    """Whether the words of the page's blocks, cues aside, hold enough stop words for these to be a measure."""
    counts = [_stop_words(b.text) for b in found if not b.outside or b.marked]
    return sum(n for n, _ in counts) >= KNOWN * sum(n for _, n in counts)


def classify(block: Block, has_main: bool, known: bool = True, cues: bool = True) -> tuple[str, str]:
    """First pass: good, bad, or what is ambiguous (near: middling, short), from the block alone; and whether a cue or the densities say so."""
    if block.outside and (cues or not block.marked) or has_main and not block.inside:
        return "bad", "cue"
    size = len(block.text)
    linked = min(block.link_chars, size) / size
    if linked > (LINKED if has_main else LINKED / 2) and not (has_main and block.heading):
        return "bad", "density"
    if not has_main and not known:
        size += 2 * sum(c >= "\u3040" for c in block.text)
    if size < SHORT:
        return ("bad", "density") if linked > 0 and not has_main else ("short", "")
    if not has_main and not known:
        return "good", "density"
    n, words = _stop_words(block.text)
    if n / words >= STOP_HIGH and size > LONG:
        return "good", "density"
    return ("near", "") if n / words >= STOP_LOW or has_main else ("bad", "density")


def labels(found: list[Block]) -> list[tuple[bool, str]]:
    """For every block whether it is text, and what decided that: cue, density, or neighbours (the second pass)."""
    has_main = any(b.inside and not b.outside for b in found)
    known = has_main or known_language(found)
    first = [classify(b, has_main, known) for b in found]
    if not has_main and all(label == "bad" for label, _ in first):  # marks are outvoted
        again = [classify(b, has_main, known, cues=False) for b in found]
        return [(True, "density") if new == ("good", "density") else (False, by) for (_, by), new in zip(first, again, strict=True)]
    edge = "good" if has_main else "bad"
    before, after = _nearest(first, edge, has_main), _nearest(first[::-1], edge, has_main)[::-1]
    none_good = not any(label == "good" for label, _ in first)
    out = []
    for block, (label, by), left, right in zip(found, first, before, after, strict=True):
        if by:
            out.append((label == "good", by))
        elif not has_main and none_good:
            out.append((True, "neighbours"))
        elif has_main or label == "near":  # one good neighbour is enough
            out.append(("good" in (left, right), "neighbours"))
        else:  # short: both, or what follows for a heading
            out.append((left == right == "good" or block.heading and right == "good", "neighbours"))
    return out


def _nearest(first: list[tuple[str, str]], edge: str, has_main: bool) -> list[str]:
    """The label of the nearest decided block at or before each; where a page has a main element, cues don't speak for what is in it."""
    out, last = [], edge
    for label, by in first:
        last = label if by == "density" or by == "cue" and not has_main else last
        out.append(last)
    return out


def main_text(page: str | None) -> tuple[str, list[int]]:
    """The text, and how many blocks were decided by cues, by densities and by neighbours."""
    found = list(blocks(page or ""))
    decided = labels(found)
    by = [b for _, b in decided]
    return " ".join(b.text for b, (good, _) in zip(found, decided, strict=True) if good), [by.count(x) for x in BY]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, and by_cue, by_density, by_neighbours (how many blocks each decided) of every page."""

    def run(batches):
        for batch in batches:
            done = [main_text(x) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in done], pa.string()), pa.array([len(x) for x, _ in done], pa.int64())]
            columns += [pa.array([n[k] for _, n in done], pa.int64()) for k in range(len(BY))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", *(f"by_{x}" for x in BY)])

    rows = pages.select("page_id", "url", "html")
    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint" + "".join(f", by_{x} bigint" for x in BY))
