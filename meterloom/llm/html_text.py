"""Main text of web pages with site templates removed (operator 2).

1. Every page is read once for its element subtrees: each gets a hash of its mark-up with white space made even. An element whose
   class or id has a word of boilerplate also gets the hash of its tag, class and id alone, its slot.
2. Spark counts, per host, beside how many different contents each subtree and each slot stands.
3. Pages are read again with their host's recurring subtrees and slots, which are deleted; the blocks of what is left are the text.

Where a page has articles, or else a main element, that hold as much prose as stands outside them, these are the content and nothing
else is; on other pages it is the least element that holds the title and all prose that does not recur (the flow). Outside the flow what
recurs goes. Inside the content recurrence alone deletes nothing: headings, list items and cells never go, and a paragraph, list or
container goes only if it also shows that it is no part of the article, by a third of its words standing in links or by a word like
newsletter in its text. ``INSIDE`` and ``PROSE`` say on how many of the host's contents, and on what share of them, a block has to stand; one rule
for hosts of every size, under which nothing can recur on a single page.

Class and id speak only by whole names made of boilerplate's words (``ad-box``, not ``cookie-recipe``). Of such elements adverts, cookie
notices, newsletters and readers' comments go; others go unless they hold prose, and with prose where their slot (tag, class, id)
recurs, as a sidebar's does whatever it says. A title and what holds it, an article or a main element never go as templates. A form goes
unless it is wrapped round an article or half of the page's prose; its fields go in any case.

The pages of a subtree count once for each longest stretch of the main content beside it, so that copies of one article with small
changes don't make its paragraphs look like a template. Menus, footers, asides, scripts and the like go by their tag or role.

Defined results: null or empty html gives empty text; text outside any tag is text; repeated rows give equal results row by row, and
count once as content; an empty table gives no rows; other columns are neither read nor changed. Reading is linear in the page, and
no page, attribute or text is cut.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from meterloom.llm.common import texts_of
from meterloom.session import cut

OUTSIDE = (2, 0.05)  # a slot recurs that stands on so many contents at least, and on this share of the host's,
INSIDE = (3, 0.5)  # a block,
PROSE = (10, 0.9)  # and one with prose
LINKED = 3  # one word in so many stands in links where a block is no part of an article
PROSE_WORDS = 15  # so many words outside links in one block are prose

#: Elements by what they do to the text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
DROPPED = frozenset("head script style noscript template iframe noembed noframes nav footer aside button select textarea input svg canvas object audio video map dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in class or id that mark boilerplate: that never drop prose, that may, and that mark readers' comments; and words that
#: say nothing beside them.
WEAK = frozenset("sponsor sponsored promo promotion banner notice notices alert sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar discussion share sharing social related recommended signup login popup modal overlay widget widgets pagination pager".split())
STRONG = frozenset("ad ads advert adverts advertisement adbox adsense cookie cookies consent gdpr newsletter subscribe subscription".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
NEUTRAL = frozenset("area article bar block body bottom box btn button buttons card center col column container content current el element entry fixed form global group head inline inner item items js l label large layer left link links list main message mobile module outer page pane panel policy post posts primary reader readers right row secondary section sections side site slot small sticky text thread title top unit user users wide wrap wrapper wp".split())
#: Words in a recurring block's text that tell that it is no part of the article.
_TOLD = re.compile(r"\b(?:advertisement|newsletter|sponsored|subscribe)\b", re.IGNORECASE)
#: Blocks that may go inside the content if they recur.
BOILERPLATE = WEAK | STRONG | COMMENTS
KNOWN = BOILERPLATE | NEUTRAL
APART = frozenset("address center div dl fieldset hr ol p section table ul".split())
ASIDES = COMMENTS | frozenset("ad ads advert promo related".split())  # an article so marked is none
WHOLE = frozenset(["", "html", "body", "article", "main", *VOID])  # elements that are no template by themselves
#: Which open elements a start tag closes, as the HTML standard has it for tags that may be left out.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPES = frozenset("article section div main body html td th table li ul ol blockquote figure".split())

#: A tag, or a comment, or a declaration. A value in quotes may hold ``>``; a quote that never closes opens none.
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>|[!?/][^>]*+>)", re.DOTALL)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_SPACES = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
_PARTS = re.compile(r"[^a-z]+")


class Element:
    __slots__ = ("children", "dropped", "end", "holds", "linked", "mark", "name", "prose", "prose_words", "sign", "slot", "start", "tag_end", "total", "words")

    def __init__(self, name: str, start: int, tag_end: int, dropped: bool = False, mark: int = 0, slot: str = ""):
        self.name, self.start, self.tag_end, self.end, self.children = name, start, tag_end, -1, []
        self.dropped, self.mark, self.slot = dropped, mark, slot


def attributes(attrs: str) -> dict[str, str]:
    """The attributes of a tag by their whole names in lower case; of a name given twice the first stands."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _marks(*names: str) -> set[str]:
    """The words of the names in class and id that are made of boilerplate's words alone, numbers aside."""
    words = set()
    for name in " ".join(names).lower().split():
        parts = {x for x in _PARTS.split(name) if x}
        if parts & BOILERPLATE and parts <= KNOWN:
            words |= parts & BOILERPLATE
    return words


def _judged(name: str, attrs: str) -> tuple[bool, int, str]:
    """Whether an element goes by its tag or role, what its class and id mark it as (0 nothing, 1 weak, 2 strong, 3 comments), its slot."""
    if name in DROPPED:
        return True, 0, ""
    if not attrs or attrs.isspace():
        return False, 0, ""
    found = attributes(attrs)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True, 0, ""
    kind, own = found.get("class", ""), found.get("id", "")
    if name in ("html", "body", "main") or not (kind or own):
        return False, 0, ""
    words = _marks(kind, own)
    mark = 3 * bool(words & ASIDES) if name == "article" else 3 if words & COMMENTS else 2 if words & STRONG else 1 if words & WEAK else 0
    return False, mark, _DIGITS.sub("", f"{name} {kind} {own}") if mark else ""


def parse(page: str) -> Element:
    """The tree of a page: children are elements and (start, end) stretches of text. Tags left open or closed twice are mended."""
    root = Element("", 0, 0)
    stack, at = [root], 0
    still: Counter = Counter()  # how many elements of each name are open
    size, last = len(page), page.rfind(">") + 1

    def close(depth: int, where: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            still[e.name] -= 1
            e.end = where

    def shut(names, bounds, where: int) -> None:
        """Closes the innermost open element of these names, unless one of ``bounds`` stands between."""
        if any(still[n] for n in names):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in names:
                    return close(depth, where)
                if stack[depth].name in bounds:
                    return None
        return None

    while m := _TAG.search(page, at, last):
        if m.start() > at:
            stack[-1].children.append((at, m.start()))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if still[name]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        close(depth + 1, m.start())
                        close(depth, at)
                        break
                    if stack[depth].name in ("table", "article", "main") and name not in BLOCKS - {"p", "li"}:
                        break  # a stray end tag does not reach past these
            continue
        if name in BLOCKS:  # a block ends an open paragraph, with the inline elements left open in it
            shut(("p",), SCOPES, m.start())
        if name in CLOSES:
            shut(*CLOSES[name], m.start())
        element = Element(name, m.start(), at, *_judged(name, m["attrs"]))
        stack[-1].children.append(element)
        if name in VOID or (m["attrs"].endswith("/") and name not in BLOCKS and name not in RAW):
            element.end = at
        elif name in RAW:
            stop = _raw_end(name).search(page, at)
            element.children.append((at, stop.start() if stop else size))
            at = element.end = stop.end() if stop else size
        else:
            stack.append(element)
            still[name] += 1
    if (open_comment := page.find("<!--", at)) >= 0:  # one that never closes holds the rest
        size = open_comment
    if at < size:
        stack[-1].children.append((at, size))
    close(1, size)
    root.end = size
    return root


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE)


def _signed(data: str, seed: int = 0) -> int:
    n = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"), seed)
    return n - (1 << 64) if n >> 63 else n


TITLE, CONTENT = 1, 2  # what an element may hold


def sign(page: str, root: Element) -> None:
    """Gives each element that doesn't go in any case the hash of its subtree, from its tag, texts and children's hashes with white
    space made even; whether it holds prose; whether it holds a title, an article or a main element; and its words, in links and in prose."""
    forms = []
    for e in reversed(list(_walk(root))):  # children stand after their parents
        told = [" ".join(page[e.start : e.tag_end].split())]
        e.prose, e.words, e.total, e.linked, e.prose_words = False, 0, 0, 0, 0
        e.holds = TITLE if e.name == "h1" else CONTENT if e.name == "main" or (e.name == "article" and not e.mark) else 0
        for c in e.children:
            if not isinstance(c, Element):
                words = page[c[0] : c[1]].split()
                told.append(" ".join(words))
                e.words += len(words)
                e.total += len(words)
            elif not c.dropped:
                told.append(f"\x00{c.sign}")
                e.holds |= c.holds
                e.total += c.total
                e.linked += c.linked
                e.prose_words += c.prose_words
                if c.name != "a":
                    e.prose |= c.prose
                    if c.name not in BLOCKS:
                        e.words += c.words
        if e.name == "a":
            e.linked, e.prose_words = e.total, 0
        if e.words >= PROSE_WORDS:
            e.prose = True
            e.prose_words = max(e.prose_words, e.words)
        e.sign = _signed("\x00".join(told))
        if e.mark:
            e.slot = _signed(e.slot, 1)
        if e.name == "form":
            forms.append(e)
    for e in forms:
        e.dropped = not e.holds and (not e.prose or 2 * e.prose_words < root.prose_words)


def _walk(root: Element):
    """The elements, parents first, without what goes in any case."""
    stack = [root]
    while stack:
        e = stack.pop()
        yield e
        stack += [c for c in e.children if isinstance(c, Element) and not c.dropped]


class Template(NamedTuple):
    """The hashes of what recurs on a host, by how much of it."""

    outside: frozenset[int] = frozenset()
    inside: frozenset[int] = frozenset()
    prose: frozenset[int] = frozenset()


def _boilerplate(e: Element, inside: bool, template: Template) -> bool:
    """Whether an element goes by its tag, its class and id, or its slot, ``inside`` an article."""
    if e.dropped:
        return True
    if e.name == "header" and not inside:  # an article's own header holds its title
        return not e.holds & CONTENT
    if e.mark == 3 and inside and not e.holds & TITLE:  # articles inside an article are its comments
        return True
    if e.holds or not e.mark:
        return False
    return e.mark > 1 or not e.prose or e.slot in template.outside


def _recurs(e: Element, template: Template) -> bool:
    return e.name not in WHOLE and not e.holds and e.sign in (template.prose if e.prose else template.inside)


def _is_apart(page: str, e: Element) -> bool:
    """Whether a block inside the content looks like no part of it."""
    if e.name not in APART:
        return False
    return (e.total > 0 and LINKED * e.linked >= e.total) or any(_TOLD.search(page, *c) for x in _walk(e) for c in x.children if isinstance(c, tuple))


def _regions(root: Element, template: Template) -> list[Element]:
    """The articles outside boilerplate and outside each other, else the main element, where they hold as much prose as stands outside."""
    for name in ("article", "main"):
        found, stack = [], [root]
        while stack:
            e = stack.pop()
            if _boilerplate(e, False, template):
                continue
            if e.name == name:
                found.append(e)
            else:
                stack += [c for c in reversed(e.children) if isinstance(c, Element)]
        if found and 2 * sum(e.prose_words for e in found) >= _counted(root, template):
            return found
    return []


def _counted(root: Element, template: Template) -> int:
    """Words of prose that is neither boilerplate nor recurs."""
    n, stack = 0, [root]
    while stack:
        e = stack.pop()
        if _boilerplate(e, False, template) or _recurs(e, template):
            continue
        n += e.words if e.words >= PROSE_WORDS and e.name in (BLOCKS | {""}) else 0
        stack += [c for c in e.children if isinstance(c, Element)]
    return n


def _flow(root: Element, template: Template) -> Element | None:
    """The least element that holds the title and all prose that does not recur; none where there is neither."""
    held: dict[int, int] = {}
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        if _boilerplate(e, False, template) or _recurs(e, template):
            continue
        order.append(e)
        held[id(e)] = e.name == "h1" or (e.words >= PROSE_WORDS and e.name in (BLOCKS | {""}))
        stack += [c for c in e.children if isinstance(c, Element)]
    for e in reversed(order):
        held[id(e)] += sum(held.get(id(c), 0) for c in e.children if isinstance(c, Element))
    at, whole = root, held.get(id(root), 0)
    if not whole:
        return None
    while below := next((c for c in at.children if isinstance(c, Element) and held.get(id(c), 0) == whole), None):
        if below.name == "h1" or below.name == "p":
            break
        at = below
    return at


def _blocks(page: str, region: Element, template: Template, flow: Element | None) -> list[str]:
    """The texts of a region's blocks; what recurs goes outside ``flow``, everywhere without one, and inside it where it is apart."""
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = _SPACES.sub(" ", entities.unescape("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    stack: list = [(iter(region.children), True, region.name in ("article", "main"), region is flow)]
    while stack:
        children, block, inside, flowing = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            if block:
                flush()
        elif isinstance(c, tuple):
            now.append(page[c[0] : c[1]])
        elif c.name == "br":
            now.append(" ")
        else:
            block = c.name in BLOCKS
            if block:
                flush()
            goes = _boilerplate(c, inside, template) or (block and _recurs(c, template) and (not flowing or _is_apart(page, c)))
            if not goes:
                stack.append((iter(c.children), block, inside or c.name in ("article", "main"), flowing or c is flow))
    flush()
    return blocks


def _content(root: Element, template: Template) -> list[tuple[Element, Element | None]]:
    """The regions that hold the content, each with its flow."""
    found = _regions(root, template)
    return [(e, e) for e in found] if found else [(root, _flow(root, template))]


def main_text(page: str, template: Template | None = None) -> str:
    """The blocks of the main content in page order, joined by an empty line; by what recurs on the page's host."""
    root, template = parse(page), template or Template()
    sign(page, root)
    return "\n\n".join(block for region, flow in _content(root, template) for block in _blocks(page, region, template, flow))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


PLACED = ArrayType(StructType([StructField("subtree", LongType()), StructField("beside", LongType())]))
SUBTREES = StructType([StructField("content", LongType()), StructField("subtrees", PLACED)])


def signs(page: str) -> tuple[int, list[tuple[int, int]]]:
    """The hash of a page's main content, of its longest stretch where the page says what its content is; and those of its subtrees
    and slots, each once with the hash of the longest stretch of the main content that stands outside it."""
    root = parse(page)
    sign(page, root)
    regions = _regions(root, Template()) or [root]
    texts = sorted(c for region in regions for e in _walk(region) for c in e.children if isinstance(c, tuple))
    starts = [a for a, _ in texts]
    longer = lambda x, y: y if y[1] - y[0] > x[1] - x[0] else x
    before = list(accumulate(texts, longer, initial=(0, 0)))
    after = list(accumulate(reversed(texts), longer, initial=(0, 0)))[::-1]

    @cache
    def told(a: int, b: int) -> int:
        return _signed(" ".join(page[a:b].split()))

    found: dict[int, int] = {}
    for e in _walk(root):
        if e.name not in WHOLE and not e.holds:
            beside = told(*longer(before[bisect_left(starts, e.start)], after[bisect_left(starts, e.end)]))
            found.setdefault(e.sign, beside)
            if e.mark:
                found.setdefault(e.slot, beside)
    content = told(*before[-1]) if root.holds & CONTENT else _signed(" ".join(str(r.sign) for r in regions))
    return content, list(found.items())


@F.arrow_udf(SUBTREES)
def _subtrees(column: pa.Array) -> pa.Array:
    rows = [{"content": c, "subtrees": [{"subtree": s, "beside": b} for s, b in x]} for c, x in map(signs, texts_of(column))]
    return pa.array(rows, to_arrow_type(SUBTREES))


def templates(pages: DataFrame) -> DataFrame:
    """host, outside, inside, prose of each host: what recurs on it, by how much of it. A list holds at most the subtrees of 1 / share
    pages."""
    read = pages.select(host_of(F.col("url")).alias("host"), _subtrees("html").alias("s")).where("host <> ''").select("host", "s.*")
    whole = F.struct(F.lit(None).cast("long").alias("subtree"), F.col("content").alias("beside"))
    seen = read.select("host", F.explode(F.array_append("subtrees", whole)).alias("s")).select("host", "s.*")
    counts = seen.groupBy("host", "subtree", "beside").count().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("contents"))
    counts = cut(counts, "counts")  # read twice
    known = counts.where("subtree is null").select("host", F.col("contents").alias("all"))
    meets = lambda level: F.col("contents") >= F.greatest(F.lit(level[0]), level[1] * F.col("all"))
    both = counts.where(F.col("contents") >= OUTSIDE[0]).join(known, "host")
    listed = lambda level, name: F.collect_list(F.when(F.col("subtree").isNotNull() & meets(level), F.col("subtree"))).alias(name)
    return both.groupBy("host").agg(listed(OUTSIDE, "outside"), listed(INSIDE, "inside"), listed(PROSE, "prose"))


TEXT = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])


@F.arrow_udf(TEXT)
def _extract(column: pa.Array, *levels: pa.Array) -> pa.Array:
    """The text of each page; a null level says that nothing recurs on its host."""
    texts = []
    own: tuple = (None, None)  # pages of a host come in a row more often than not
    for page, *lists in zip(texts_of(column), *(x for x in levels), strict=True):
        if lists[0].is_valid and lists != own[0]:
            own = lists, Template(*(frozenset(x.as_py()) for x in lists))
        texts.append(main_text(page, own[1] if lists[0].is_valid else None))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["text", "n_chars"])


def extract(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars, one row per row of ``pages`` (page_id, url, html); ``found`` as from ``templates``."""
    if found is None:
        found = cut(templates(pages), "templates")
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = hosted.join(found, "host", "left")
    return joined.select("page_id", "url", _extract("html", "outside", "inside", "prose").alias("t")).select("page_id", "url", "t.*")
