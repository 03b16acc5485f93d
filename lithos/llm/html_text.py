"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each with its root-to-leaf tag path. For
every path the text length and the punctuation are summed and divided by the
number of its blocks; the two ratios are fused, smoothed along the page, weighed
by what the elements of the path say of themselves, and compared with a
threshold, which selects paths. What elements say is one factor of the score: a
navigation, a footer, or a class that names a part which isn't content lowers
it, a marked article raises it; a label on what holds most of the page's text has
no say. The selected paths give the content nodes: the elements that hold their
blocks, or the marked element around them, whose short blocks are taken too.

Defined results. A null or empty page has an empty text, and so has one without
content. Unclosed and stray tags are repaired as browsers do for paragraphs and
lists. A raw element (script, style), a comment or a tag that is never closed
ends with the page. Repeated rows are reported one by one; an empty table gives
no rows. Extra columns are ignored. Time grows with a page's length alone,
however its tags are nested.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm._common import chunks, ship

#: Elements whose content is not markup.
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp noframes".split())
NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
#: Ends a tag, or opens a quoted value in it.
VALUE = re.compile(r"""=\s*["']|>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block; they don't split it and aren't part of a path.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never content.
NEVER = frozenset("head nav footer aside form button input label fieldset legend menu dialog audio video canvas".split())
#: Elements that close an open paragraph.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words of a class or id that name a part which isn't content.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion promoted recommend recommended related replies reply respond share sharing sidebar sidebars social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Words of a class, id, role or itemprop that mark the content.
MARKS = frozenset("articlebody main maincontent postcontent entrycontent articlecontent".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，！？、]")
WORD = re.compile(r"[A-Za-z]+|[0-9]+")


#: Factors of a path's score: inside marked content, and inside an element that
#: says that it is none.
MARKED, LABELLED = 2.0, 0.01
#: Least score of a selected path, and the threshold as a share of the mean score,
#: in which each block counts as much as it scores.
LEAST, SHARE = 1.0, 0.25


class Tag(NamedTuple):
    """A tag from ``start`` to ``end``; without a name it is no element's."""

    start: int
    end: int
    name: str
    closes: bool
    rest: str


def tags(page: str) -> Iterator[Tag]:
    """Tags in order, raw elements and comments as one each. One pass: what is
    not closed is searched for once."""
    at, n = 0, len(page)
    open_quotes: set[str] = set()
    raw_ends: dict[str, re.Pattern] = {}
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 1)
            end = n if end < 0 else end + 3
            yield Tag(start, end, "", False, "")
            at = end
            continue
        m = NAME.match(page, at)
        if m is None:
            if page[at : at + 1] in ("!", "?", "/"):
                end = page.find(">", at)
                end = n if end < 0 else end + 1
                yield Tag(start, end, "", False, "")
                at = end
            continue
        name, pos = m[0].lower(), m.end()
        while (v := VALUE.search(page, pos)) and v[0] != ">":
            quote, pos = v[0][-1], v.end()
            if quote not in open_quotes:
                close = page.find(quote, pos)
                if close < 0:
                    open_quotes.add(quote)
                else:
                    pos = close + 1
        end = v.end() if v else n
        rest = page[m.end() : end - 1] if v else ""
        if name in RAW and v:
            stop = raw_ends.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)).search(page, end)
            end, name = stop.end() if stop else n, ""
        yield Tag(start, end, name.removeprefix("/") if v else "", name.startswith("/"), rest)
        at = end


class Block(NamedTuple):
    """Text of a block, its path, the characters in links, and what its
    ancestors say: whether one is no content, and which hold it."""

    text: str
    path: int
    leaf: str
    linked: int
    labelled: bool
    marked: bool
    holder: int
    region: int


class _Open(NamedTuple):
    """An open element; all but the name is of its ancestors too."""

    name: str
    number: int  # 0 for the document and its body
    path: int
    no_content: bool
    named: tuple | None  # the elements named like noise, innermost first, as a chain
    holder: int  # number of the innermost element around it that isn't inline
    region: int  # number of the outermost marked element
    block: int  # index of the innermost element that isn't inline


def _says(name: str, rest: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is no content, is named like noise, and marks content."""
    named = False
    noise = name in NEVER or (name == "header" and not inside)
    marked = name in ("article", "main")
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            tokens = [WORD.findall(v) for v in value.split()]
            # The whole token or its first word: "has-sidebar" names a page with one.
            named = named or any(t and (t[0] in NOISE or "".join(t) in NOISE) for t in tokens) and not (name == "header" and inside) and name not in ("body", "html")
            marked = marked or any("".join(t) in MARKS for t in tokens)
        elif key == "role":
            noise = noise or value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
            marked = marked or value == "main"
        elif key == "itemprop":
            marked = marked or value == "articlebody"
        elif key == "hidden" or value == "true":
            noise = True
    return noise, named, marked and not noise


def _weight(b: Block) -> int:
    """Characters that aren't in links, less those that are."""
    return max(0, len(b.text) - 2 * b.linked)


def _judged(found: list[tuple[Block, tuple | None]]) -> list[Block]:
    """Blocks inside elements named like noise as labelled, except for elements
    that hold most of the page's text, or its only marked content and at least as
    much of it as there is text outside of such elements. ``held`` adds up along
    the chains, from the innermost."""
    total = outside = 0
    marks = False
    held: dict[int, int] = defaultdict(int)
    content: dict[int, int] = defaultdict(int)
    chains: dict[int, tuple] = {}
    for b, chain in found:
        if b.labelled:
            continue
        w = _weight(b)
        total += w
        if chain is None:
            outside += w
            marks = marks or b.marked
        else:
            chains[chain[0]] = chain
            held[chain[0]] += w
            content[chain[0]] += w * b.marked
    # Inner elements have larger numbers.
    todo = sorted(chains)
    exempt: dict[int, bool] = {}
    while todo:
        n = todo.pop()
        chain = chains[n]
        exempt[n] = not marks and (2 * held[n] > total or content[n] > 0 and content[n] >= outside)
        outer = chain[1]
        if outer is not None:
            if outer[0] not in chains:
                chains[outer[0]] = outer
                bisect.insort(todo, outer[0])
            held[outer[0]] += held[n]
            content[outer[0]] += content[n]
    fine: dict[int, bool] = {}
    for n in sorted(exempt):  # outer ones first
        outer = chains[n][1]
        fine[n] = exempt[n] and (outer is None or fine[outer[0]])
    judged = [b._replace(labelled=b.labelled or (chain is not None and not fine.get(chain[0], False))) for b, chain in found]
    # Labelled and other blocks of like elements are of different paths.
    return [b._replace(path=2 * b.path + b.labelled) for b in judged]


def blocks(page: str) -> list[Block]:
    """Non-empty blocks of a page in order."""
    out: list[tuple[Block, tuple | None]] = []
    stack = [_Open("", 0, 0, False, None, 0, 0, 0)]
    paths: dict[tuple[int, str, bool, bool], int] = {}
    places: dict[str, list[int]] = defaultdict(list)  # indices in the stack by name
    parts: list[str] = []
    link_depth, linked, opened = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            leaf = stack[stack[-1].block]
            block = Block(text, leaf.path, leaf.name, linked, leaf.no_content, leaf.region > 0, leaf.holder, leaf.region)
            top = stack[-1]  # an inline element may say something too
            out.append((block._replace(labelled=top.no_content, marked=top.region > 0), top.named))
        parts.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal link_depth
        for o in reversed(stack[k:]):
            link_depth -= o.name == "a"
            places[o.name].pop()
        del stack[k:]

    def last(*names: str) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    at = 0
    for t in tags(page):
        if t.start > at:
            parts.append(page[at : t.start])
            linked += (t.start - at) * (link_depth > 0)
        at = t.end
        name = t.name
        if not name:
            continue
        if name in ("br", "img", "wbr"):
            parts.append(" " if name != "wbr" else "")
            continue
        inline = name in INLINE
        if not inline:
            close()
        if t.closes:
            k = last(name)
            if k and not (inline and k < stack[-1].block):
                pop(k)
            continue
        if name in CLOSES_P:
            k = last("p")
            if k and k >= stack[-1].block:
                pop(k)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("td", "th") if name in ("td", "th") else ("dt", "dd") if name in ("dt", "dd") else (name,)
            k = last(*same)
            if k > last("ul", "ol", "dl", "table", *(("tr",) if name in ("td", "th") else ())):
                pop(k)
        if name not in VOID and not t.rest.endswith("/"):
            outer = stack[-1]
            noise, named, marked = _says(name, t.rest, outer.region > 0)
            opened += 1
            # Elements of one name are different steps if they say different things.
            path = outer.path if inline else paths.setdefault((outer.path, name, noise or named, marked), len(paths) + 1)
            index = len(stack)
            stack.append(
                _Open(
                    name, 0 if name in ("html", "body") else opened, path, outer.no_content or noise, (opened, outer.named) if named else outer.named,
                    outer.holder if inline else stack[outer.block].number, outer.region or (opened if marked else 0), outer.block if inline else index,
                )
            )
            places[name].append(index)
            link_depth += name == "a"
    parts.append(page[at:])
    linked += (len(page) - at) * (link_depth > 0)
    close()
    return _judged(out)


def _smooth(x: list[float]) -> list[float]:
    weights = (0.25, 0.5, 0.25)
    padded = [x[0], *x, x[-1]]
    return [sum(w * v for w, v in zip(weights, padded[i : i + 3], strict=True)) for i in range(len(x))]


def path_scores(all_blocks: list[Block]) -> tuple[dict[int, float], float]:
    """Score of each path, and the threshold."""
    length: dict = defaultdict(int)
    points: dict = defaultdict(int)
    count: dict = defaultdict(int)
    for b in all_blocks:
        length[b.path] += _weight(b)
        points[b.path] += len(PUNCTUATION.findall(b.text))
        count[b.path] += 1
    ratios = [length[b.path] / count[b.path] * (1 + points[b.path] / count[b.path]) for b in all_blocks]
    around = _smooth(ratios)
    own = [math.sqrt(r * s) * (LABELLED if b.labelled else 1.0) * (MARKED if b.marked else 1.0) for b, r, s in zip(all_blocks, ratios, around, strict=True)]
    sums: dict = defaultdict(float)
    for b, v in zip(all_blocks, own, strict=True):
        sums[b.path] += v
    total = sum(own)
    return {p: s / count[p] for p, s in sums.items()}, max(LEAST, SHARE * sum(v * v for v in own) / total if total else LEAST)


def chosen_blocks(found: list[Block]) -> list[Block]:
    """The blocks of the selected paths and of the content nodes they give."""
    scores, threshold = path_scores(found)
    chosen = {p for p, s in scores.items() if s >= threshold}
    first = [k for k, b in enumerate(found) if b.path in chosen]
    holders = {found[k].holder for k in first}
    regions = {found[k].region for k in first if found[k].region}
    # What holds labelled blocks too, like the document's body, isn't content as
    # a whole: of it the headings and what stands between selected blocks.
    whole = {0} | {b.holder for b in found if b.labelled}
    spans: dict[int, list[int]] = defaultdict(list)
    for k in first:
        spans[found[k].holder].append(k)

    def taken(k: int, b: Block) -> bool:
        if b.path in chosen:
            return True
        if b.labelled:
            return False
        if b.region:
            return b.region in regions
        if b.holder not in holders:
            return False
        return b.holder not in whole or b.leaf in HEADINGS or spans[b.holder][0] < k < spans[b.holder][-1]

    return [b for k, b in enumerate(found) if taken(k, b)]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by line feeds."""
    found = blocks(page) if page else []
    return "\n".join(b.text for b in chosen_blocks(found)) if found else ""


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep``, then ``text`` and ``n_chars``."""
    ship(pages.sparkSession)
    source = pages.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(html_col).alias("_html"))
    kinds = source.dtypes[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(k for k, _ in kinds), "text", "n_chars"]
        for batch in chunks(batches, "_html"):
            texts = [main_text(x) for x in batch.column(len(kinds)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kinds)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return source.mapInArrow(run, ", ".join([*(f"{k} {t}" for k, t in kinds), "text string, n_chars bigint"])).toDF(*keep, "text", "n_chars")
