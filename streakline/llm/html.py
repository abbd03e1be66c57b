"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a tree of tags in which texts are slots. Repeated siblings are
folded into one repeated group, so that all pages of a layout have one short
tree. The distinct trees of a host are aligned one after the other: children
are matched by a longest common subsequence of their labels, what only one side
has becomes optional, what one side has several times becomes repeated, and
texts become slots. The result is the host's wrapper. Its slots are classed by
where they lie. Extraction takes a page's texts that lie in slots of the best
kind of region that this page has, since a host may have several layouts.

The trees hold no texts. Which texts are the wrapper's own and which are data
is told by counts: a block of text that all different pages of a host with its
slot have there is the wrapper's, and extraction leaves it out.

Trees are made distinct before the shuffle and a host's trees are aligned in
parts of about ``TREES``, round after round, until one is left: a host of any
number of layouts spreads over as many tasks as it needs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Generator, Iterator
from functools import lru_cache
from html import unescape
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.llm.common import small, stored
from streakline.llm.urls import url_host

#: Distinct trees of one host that a task aligns in a round.
TREES = 1_000
WRAPPERS = 20_000
#: Different pages with a slot from which a text that all of them have there is the wrapper's.
ALIKE = 8

# Fixed values of HTML: names of elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset(("html", "head", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option"))
#: An opening tag ends an open element of these names, up to the nearest of those.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Where no main text lies, by element, and by words of class, id and role.
ASIDE = frozenset(
    "nav header footer aside form script style noscript template iframe svg button select textarea dialog menu head title"
    " canvas object audio video label input fieldset xmp".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sidebar side cookie cookies consent notice notices alert"
    " comment comments commentlist reply replies respond discussion menu menus nav navbar navigation breadcrumb breadcrumbs"
    " header masthead footer share sharing social related recommended promo promotion sponsor sponsored newsletter subscribe"
    " subscription signup login popup modal overlay widget toolbar pagination pager tags disqus contentinfo complementary search"
    " skip hidden".split()
)
MAIN = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main post entry story content articlebody".split())

_TAG = re.compile(r"</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[A-Za-z][^>]*+>?")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_WORDS_OF = re.compile(r"[\s/\"'](?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"[\s\"']hidden(?=[\s=>/])|aria-hidden\s*=\s*[\"']?true", re.I)
SLOT = "#"


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): 'open', 'close' and 'text' in page order; comments and declarations are left out.

    The contents of scripts and the like are dropped. A < that begins nothing is text.
    """
    at, size = 0, len(html)
    while at < size:
        next_ = html.find("<", at)
        if next_ < 0:
            next_ = size
        if next_ > at:
            yield "text", "", html[at:next_]
            at = next_
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = size if end < 0 else end + 1
        elif tag := _TAG.match(html, at):
            name, whole = _NAME.match(html, at).group(1).lower(), tag.group()
            at = tag.end()
            if whole.startswith("</"):
                yield "close", name, whole
            else:
                yield "open", name, whole
                if name in RAW and not whole.endswith("/>"):
                    end = _raw_end(name).search(html, at)
                    at = end.start() if end else size
                elif whole.endswith("/>") and name not in VOID and name not in BLOCK:
                    yield "close", name, whole
        else:
            yield "text", "", "<"
            at += 1


@lru_cache(maxsize=None)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def label(name: str, tag: str) -> str:
    """Element name with the words of class, id and role that say what it is for."""
    if len(tag) == len(name) + 2:
        return name
    words = {w for m in _WORDS_OF.finditer(tag) for w in re.findall(r"[a-z]+", (m.group(1) or m.group(2) or m.group(3) or "").lower())}
    telling = sorted(words & (ASIDE_WORDS | MAIN_WORDS))
    if _HIDDEN.search(tag):
        telling = sorted({*telling, "hidden"})
    return ".".join([name, *telling])


def events(html: str) -> Iterator[tuple[str, object]]:
    """('text', (path, text, elements)), ('block', None) and ('gap', None) of a page.

    A path is the tuple of labels of open elements, ``elements`` that of their
    numbers. Elements that HTML closes by itself (paragraphs, list items, cells)
    are closed.
    """
    names: list[str] = []
    path: tuple[str, ...] = ()
    elements: tuple[int, ...] = ()
    opened = 0

    def shut(name: str, stops: tuple[str, ...]) -> None:
        nonlocal path, elements
        for i in range(len(names) - 1, -1, -1):
            if names[i] == name:
                del names[i:]
                path, elements = path[:i], elements[:i]
                return
            if names[i] in stops:
                return

    for kind, name, text in tokens(html):
        if kind == "text":
            yield "text", (path, text, elements)
            continue
        if name == "br":
            yield "gap", None
            continue
        if name in BLOCK:
            yield "block", None
        if kind == "open":
            if name in CLOSES_P:
                shut("p", ("td", "th", "li", "article", "section", "div", "body", "button"))
            if name in ENDS:
                for other in ENDS[name][0]:
                    shut(other, ENDS[name][1])
            if name not in VOID:
                names.append(name)
                opened += 1
                path, elements = (*path, label(name, text)), (*elements, opened)
        elif name not in VOID:
            shut(name, ("table",) if name not in ("table", "body", "html") and name in ENDS else ())


# --- wrappers: [label, optional, repeated, children]; a slot is [SLOT, optional, repeated, []] ---


def _same(a: list, b: list) -> bool:
    return a[0] == b[0]


def _whole(step: Generator) -> list:
    """What a generator returns that yields other such generators and is sent what they return: nesting of any depth."""
    open_, value = [step], None
    while open_:
        try:
            open_.append(open_[-1].send(value))
            value = None
        except StopIteration as end:
            open_.pop()
            value = end.value
    return value


def packed(tree: list) -> str:
    """The tree as a flat JSON list, parents before children: [label, optional, repeated, number of children]."""
    flat, open_ = [], [tree]
    while open_:
        node = open_.pop()
        flat.append([node[0], int(node[1]), int(node[2]), len(node[3])])
        open_.extend(reversed(node[3]))
    return json.dumps(flat, separators=(",", ":"))


def unpacked(flat: list) -> list:
    """The tree of a flat list."""
    top: list = []
    open_ = [(top, 1)]
    for name, optional, repeated, size in flat:
        while len(open_[-1][0]) == open_[-1][1]:
            open_.pop()
        node: list = [name, bool(optional), bool(repeated), []]
        open_[-1][0].append(node)
        open_.append((node[3], size))
    return top[0]


def page_tree(html: str) -> list:
    """The page's tree of labels with repeated siblings folded."""
    root: list = ["", False, False, []]
    open_: list[list] = []
    before: tuple[int, ...] = ()
    for kind, value in events(html):
        if kind != "text":
            continue
        path, text, elements = value
        if not text.strip():
            continue
        common = 0
        while common < min(len(elements), len(before)) and elements[common] == before[common]:
            common += 1
        del open_[common:]
        for name in path[common:]:
            child = [name, False, False, []]
            (open_[-1] if open_ else root)[3].append(child)
            open_.append(child)
        at = open_[-1] if open_ else root
        if not at[3] or at[3][-1][0] != SLOT:
            at[3].append([SLOT, False, False, []])
        before = elements
    return fold(root)


def fold(node: list) -> list:
    """``node`` with runs of siblings of one label aligned into one repeated child."""
    return _whole(_fold(node))


def _fold(node: list) -> Generator:
    children: list = []
    for child in node[3]:
        child = yield _fold(child)
        if children and _same(children[-1], child):
            children[-1] = yield _align(children[-1], child)
            children[-1][2] = True
        else:
            children.append(child)
    # a repeated group of several labels: the same pair again and again
    width = 2
    while width <= len(children) // 2:
        at, made = 0, []
        while at < len(children):
            group = children[at : at + width]
            if len(made) >= width and len(group) == width and all(map(_same, made[-width:], group)):
                for i, b in enumerate(group, len(made) - width):
                    made[i] = _repeated((yield _align(made[i], b)))
                at += width
            else:
                made.append(children[at])
                at += 1
        children = made
        width += 1
    return [node[0], node[1], node[2], children]


def _repeated(node: list) -> list:
    return [node[0], node[1], True, node[3]]


def align(a: list, b: list) -> list:
    """The least wrapper of this form that covers both, which have one label."""
    return _whole(_align(a, b))


def _align(a: list, b: list) -> Generator:
    return [a[0], a[1] or b[1], a[2] or b[2], (yield _aligned(a[3], b[3]))]


def _aligned(one: list, two: list) -> Generator:
    """Children of both sides in order: matched ones aligned, others optional."""
    if [x[0] for x in one] == [x[0] for x in two]:
        paired = []
        for x, y in zip(one, two):
            paired.append(x if x[0] == SLOT and x == y else (yield _align(x, y)))
        return paired
    longest = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i in range(len(one) - 1, -1, -1):
        for j in range(len(two) - 1, -1, -1):
            longest[i][j] = 1 + longest[i + 1][j + 1] if _same(one[i], two[j]) else max(longest[i + 1][j], longest[i][j + 1])
    i = j = 0
    made: list = []
    while i < len(one) or j < len(two):
        if i < len(one) and j < len(two) and _same(one[i], two[j]):
            made.append((yield _align(one[i], two[j])))
            i, j = i + 1, j + 1
        elif j >= len(two) or (i < len(one) and longest[i + 1][j] >= longest[i][j + 1]):
            made.append([one[i][0], True, *one[i][2:]])
            i += 1
        else:
            made.append([two[j][0], True, *two[j][2:]])
            j += 1
    # an optional element next to one of its label is a repetition of it
    merged: list = []
    for child in made:
        if merged and _same(merged[-1], child) and (merged[-1][1] or child[1]):
            optional = merged[-1][1] and child[1]
            merged[-1] = _repeated((yield _align(merged[-1], child)))
            merged[-1][1] = optional
        else:
            merged.append(child)
    return merged


def as_expression(node: list) -> str:
    """The wrapper as a regular expression over tags, for people to read."""
    made: list[str] = []
    open_: list = [node]
    while open_:
        one = open_.pop()
        if isinstance(one, str):
            made.append(one)
            continue
        mark = ("*" if one[1] else "+") if one[2] else "?" if one[1] else ""
        made.append(("(" if mark else "") + (SLOT if one[0] == SLOT else f"<{one[0]}>" if one[0] else ""))
        open_.append(("</>" if one[0] not in ("", SLOT) else "") + (f"){mark}" if mark else ""))
        open_.extend(reversed(one[3]))
    return "".join(made)


def slot_paths(node: list) -> Iterator[tuple[str, ...]]:
    """Paths of the slots of a tree or of its flat list."""
    open_: list = [(node if isinstance(node[0], str) else unpacked(node), ())]
    while open_:
        one, path = open_.pop()
        if one[0] == SLOT:
            yield path[:-1]
        else:
            open_.extend((child, (*path, child[0])) for child in reversed(one[3]))


#: Where a slot lies: in something set aside, or in one of the kinds of regions, best first.
ASIDE_KIND = 1
REGIONS = (2, 4, 8)


@lru_cache(maxsize=100_000)
def _kinds(one: str) -> int:
    """What an element of this label makes of the slots in it."""
    name, *words = one.split(".")
    aside = name in ASIDE or not ASIDE_WORDS.isdisjoint(words)
    regions = (name == "article", name in MAIN or "main" in words, not MAIN_WORDS.isdisjoint(words))
    return ASIDE_KIND * aside + sum(kind for kind, there in zip(REGIONS, regions) if there)


@lru_cache(maxsize=1_000)
def wrapper_slots(wrapper: str) -> list:
    """The wrapper as a tree of paths: [kinds, number of the slot or -1, {label: below}]."""
    root: list = [0, -1, {}]
    open_, count = [(unpacked(json.loads(wrapper)), root)], 0
    while open_:
        node, at = open_.pop()
        for child in node[3]:
            if child[0] != SLOT:
                open_.append((child, at[2].setdefault(child[0], [at[0] | _kinds(child[0]), -1, {}])))
            elif at[1] < 0:
                at[1] = count
                count += 1
    return root


def _blocks(items: Iterator[tuple[int, str]]) -> list[tuple[int, str]]:
    """(slot of the first text, text) of the blocks of a page, white space as single spaces; an item of slot -2 ends a block, -1 has no slot."""
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    first = -1
    for slot, text in chain(items, [(-2, "")]):
        if slot == -2:
            block = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if block:
                blocks.append((first, block))
            first = -1
        else:
            parts.append(text)
            if first < 0 and text.strip():
                first = slot
    return blocks


def page_blocks(html: str | None, slots: list) -> list[tuple[int, str]]:
    """(slot, text) of the blocks of a page's main text.

    Main text lies in an article or main element, or in one whose class, id or
    role says so, and in nothing that is set aside. The best of these kinds that
    has text on this page is taken; of nested regions the elements win over the
    words. A page without such a region gives every slot that is not set aside.
    """
    found: list[tuple[int, int, str]] = []
    for kind, value in events(html or ""):
        if kind == "text":
            at = slots
            for name in value[0]:
                at = at[2].get(name)
                if at is None:
                    break
            if at is not None and at[1] >= 0 and not at[0] & ASIDE_KIND:
                found.append((at[0], at[1], value[1]))
        else:
            found.append((sum(REGIONS), -2 if kind == "block" else -1, " "))
    there = 0
    for kinds, slot, text in found:
        if slot >= 0 and text.strip():
            there |= kinds
    wanted = next((kind for kind in REGIONS if there & kind), sum(REGIONS))
    return _blocks((slot, text) for kinds, slot, text in found if kinds & wanted or not there)


def main_text(html: str | None, wanted: frozenset | set) -> str:
    """Texts of a page that lie at the wanted paths: blocks joined by an empty line."""
    items = ((0, v[1]) if k == "text" else (-2 if k == "block" else -1, " ") for k, v in events(html or "") if k != "text" or v[0] in wanted)
    return "\n\n".join(text for _, text in _blocks(items))


def _merged(trees: pd.Series) -> str:
    """One wrapper for the trees, aligned in order of size and text so that the result is always the same."""
    ordered = sorted(trees, key=lambda t: (len(t), t))
    wrapper = unpacked(json.loads(ordered[0]))
    for tree in ordered[1:]:
        wrapper = align(wrapper, unpacked(json.loads(tree)))
    return packed(wrapper)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of every host's pages as a flat JSON list. ``pages`` has host and html."""

    def trees(htmls: pd.Series) -> pd.Series:
        return pd.Series([packed(page_tree(h or "")) for h in htmls], dtype=object)

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [_merged(group["tree"])]})

    made = stored(pages.select("host", F.pandas_udf(trees, "string")("html").alias("tree")).distinct())
    while True:
        counts = stored(made.groupBy("host").agg(F.count(F.lit(1)).alias("trees")))
        if (counts.agg(F.max("trees")).first()[0] or 0) <= 1:
            return made.withColumnRenamed("tree", "wrapper")
        part = F.pmod(F.xxhash64("tree"), F.ceil(F.col("trees") / TREES))
        parts = made.join(small(counts, WRAPPERS), "host").select("host", "tree", part.alias("part"))
        made = stored(parts.groupBy("host", "part").applyInPandas(merged, "host string, tree string"))


def extract_articles(pages: DataFrame) -> DataFrame:
    """Digest: page_id, url, text and n_chars of the main text of every page.

    A null or empty html has an empty text. Pages without a host (null or
    relative URLs) share a wrapper. Texts of the wrapper are left out, unless a
    page has no other. Rows that repeat each other are answered each.
    """
    rows = pages.select("page_id", "url", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), "html")
    wrappers = infer_wrappers(rows.select("host", "html"))

    def blocks(htmls: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[{"slot": n, "block": t} for n, t in page_blocks(h, wrapper_slots(w))] for h, w in zip(htmls, found)], dtype=object)

    made = F.pandas_udf(blocks, "array<struct<slot:int,block:string>>")("html", "wrapper").alias("blocks")
    page = F.struct(F.xxhash64("html").alias("page"), F.length("html").alias("size")).alias("page")
    found = stored(rows.join(small(wrappers, WRAPPERS), "host").select("page_id", "url", "host", page, made))
    known = F.struct(F.col("slot"), F.xxhash64("block").alias("block"))
    kept = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("own", F.array().cast("array<struct<slot:int,block:bigint>>")), F.struct(b["slot"].alias("slot"), F.xxhash64(b["block"]).alias("block"))))
    # a page of nothing else keeps them
    left = F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks"))
    own = stored(_own_texts(found, known))
    texts = found.join(small(own, WRAPPERS), "host", "left").select("page_id", "url", F.array_join(F.transform(left, lambda b: b["block"]), "\n\n").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def _own_texts(found: DataFrame, known: Column) -> DataFrame:
    """(host, own): slots and hashes of the texts of each host's wrapper. Pages that repeat each other count once."""
    seen = stored(found.select("host", "page", F.inline("blocks")).select("host", "page", known.alias("text")).distinct())
    slots = seen.select("host", F.col("text.slot").alias("slot"), "page").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages"))
    texts = seen.groupBy("host", "text").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= ALIKE)
    texts = texts.withColumn("slot", F.col("text.slot"))
    return texts.join(slots, ["host", "slot", "pages"]).groupBy("host").agg(F.collect_list("text").alias("own"))
