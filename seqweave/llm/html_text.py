"""HTML extraction by tree scoring.

A page is read into a light tree that follows the usual rules for omitted end tags.  Elements that are never article
text are cut out by tag, role or class words, unless one that is only marked by a word, or a form, holds the bulk of the page.  Every text block then passes points, one for itself, one a comma and up
to three for length, to its parent, half of them to its grandparent and less to the ancestors above; an element's points
are discounted by the share of its text that is in links.  The best element is the container; if it lies in a <main>, that
is, if in an <article>, all articles are.  Beside it and beside each element that holds it, text blocks, lists, tables and
elements with a line of prose are kept, and what lies between, unless it is mostly links.

Defined results: a null or empty page has the text ""; unknown tags are inline; a tag that the page's end cuts off is
dropped; unclosed elements end with the page; repeated rows repeat; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math textarea title iframe xmp noembed noframes".split())
#: RAW ones that a slash at the end of their tag closes.
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
#: How firmly an element is cut: MILD and FIRM ones are weighed against what is kept, LAST ones return only if nothing else is.
MILD, FIRM, LAST, ALWAYS = 1, 2, 3, 4
#: Never article text, whatever they hold.
CUT = frozenset("nav button select menu head canvas audio video".split())
#: Rarely article text; weighed.
CUT_TAGS = dict.fromkeys("form fieldset object search".split(), MILD) | dict.fromkeys("header footer aside dialog".split(), FIRM)
CUT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
ROLES_MILD = frozenset("form alert search".split())
#: Words in class or id that mark what is not the article.
CUT_WORDS = (
    dict.fromkeys("promo promotion banner header notice notices notification notifications social related recommended recommendations widget widgets alert".split(), MILD)
    | dict.fromkeys("sidebar footer masthead modal overlay toc".split(), FIRM)
    | dict.fromkeys(
        "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation menu menus breadcrumb breadcrumbs"
        " cookie cookies consent gdpr popup newsletter subscribe subscription signup share sharing comment comments commentlist disqus reply"
        " replies respond toolbar pagination pager login hidden skip adsbygoogle editsection".split(),
        LAST,
    )
)
#: A class or id with one of these parts says how the page is laid out or filed, not what the element is.
LAYOUT = frozenset("with without no not non has have overflow backface layout template category tag status elementor".split())
#: Parts that may follow the word that says what the element is.
PLACES = frozenset(
    "area articles bar block bottom box button buttons col column container desktop fixed form frame global group icon icons inner item items"
    " label left link links list mobile outer panel post posts primary right row secondary section sections site slot sticky stories toggle top"
    " unit units wrap wrapper zone thread law info message".split()
)
#: Parts that may follow what names a thing beside the article, but not what names a state or an offer of the article itself.
BODIES = frozenset("content text body".split())
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sidebar footer nav navbar navigation menu cookie cookies consent gdpr popup notice"
    " notices notification notifications widget widgets related newsletter comment comments disqus reply replies toolbar promo social".split()
)
#: Whole names of readers' talk, which are an article's too: they cut only outside of articles and sections.
TALK = frozenset("discussion discussions response responses".split())
#: Before "header" or "banner" these name a part of the article.
PARTS = frozenset("article chapter content entry page post section story title".split())
COMMENTS = frozenset("comment comments reply replies".split())
KEEP_TAGS = frozenset("html body main article".split())
#: A start tag closes an open element of the same kind, looked for up to a boundary.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
ENDS_P = BLOCK - frozenset("body html caption dd dt li legend option tbody td tfoot th thead tr".split())
P_BOUNDARY = frozenset("td th caption table button object".split())
START_POINTS = {"article": 10, "main": 8, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "table": 0}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:(>)|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table".split())
#: Text of the article whatever its length, where it stands beside it.
TEXT_TAGS = HEADINGS | LISTS | frozenset("p pre blockquote figure".split())
#: Other elements beside the article are its text from so many characters outside links.
MIN_TEXT = 80
#: Ancestors that a block's points reach.
LEVELS = 64
#: Links of a menu have so many words at most.
LABEL_WORDS = 3
#: So many times the text kept holds an element that is kept in spite of a FIRM cut.
FIRM_SHARE = 4
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("children", "cut", "parent", "points", "tag", "within")

    def __init__(self, tag: str, parent: Node | None, cut: int = 0):
        self.tag, self.parent, self.cut, self.points = tag, parent, cut, 0.0
        #: The nearest block element around it.
        self.within: Node | None = parent if parent is None or parent.tag in BLOCK else parent.within
        self.children: list[Node | str] = []


def named(name: str) -> list[str]:
    """The parts of a class or id, cut at signs, digits and humps; two that make a known word are one (side-bar)."""
    out: list[str] = []
    for part in WORD.findall(HUMP.sub("-", name).lower()):
        if out and out[-1] + part in CUT_WORDS:
            out[-1] += part
        else:
            out.append(part)
    while len(out) > 1 and len(out[-1]) == 1:
        out.pop()
    return out


def word_cut(name: str) -> int:
    """How firmly a class or id cuts: its last part counts, or the last before PLACES or, if it is BESIDE the article, BODIES."""
    parts = named(name)
    if not LAYOUT.isdisjoint(parts):
        return 0
    body = False
    while len(parts) > 1 and parts[-1] not in CUT_WORDS and (parts[-1] in PLACES or parts[-1] in BODIES):
        body |= parts.pop() in BODIES
    if not parts or parts[-1] not in CUT_WORDS or (parts[-1] in ("header", "banner") and not PARTS.isdisjoint(parts[:-1])):
        return 0
    if body and parts[-1] not in BESIDE:
        return 0
    return max(CUT_WORDS.get(p, 0) for p in parts)


def is_cut(tag: str, attributes: str, section: bool = False) -> int:
    """How firmly an element is cut, 0 for not at all; section: it lies in an article or section, whose headers and talk are its own."""
    if tag in CUT:
        return ALWAYS
    cut = 0 if tag == "header" and section else CUT_TAGS.get(tag, 0)
    if not attributes or (tag in KEEP_TAGS and tag != "article"):
        return cut
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, written = name.lower(), a or b or c
        value = written.lower()
        if tag == "article":
            # Only a reader's comment is an article that isn't kept.
            if name == "class" and any(word_cut(w) and not COMMENTS.isdisjoint(named(w)) for w in written.split()):
                return LAST
        elif name in ("class", "id"):
            words = max(map(word_cut, written.split()), default=0)
            if tag == "div" and not section and value in TALK and "sec" not in attributes.lower():
                words = LAST
            cut = max(cut, words if words > MILD or tag not in HEADINGS else 0)
        elif name == "role" and value in CUT_ROLES:
            cut = max(cut, MILD if value in ROLES_MILD else FIRM if value not in ("navigation", "menu", "menubar", "toolbar") else ALWAYS)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            return ALWAYS
    return cut


def weigh(root: Node) -> None:
    """Takes back cuts of elements that hold the bulk of a page.  Sizes are characters outside links.

    A MILD element is kept if it holds more than all that is kept; a FIRM one if it holds FIRM_SHARE times as much and no
    <article> or <main> has text; of those not cut always, the largest of the least firm while nothing is kept.
    """
    order: list[tuple[Node, bool, bool]] = []
    todo = [(root, False, False)]
    while todo:
        n, in_link, marked = todo.pop()
        if n.cut < ALWAYS:
            order.append((n, in_link, marked))
            here = in_link or n.tag == "a", marked or n.tag in ("article", "main")
            todo.extend((c, *here) for c in n.children if not isinstance(c, str))
    if not any(n.cut for n, _, _ in order):
        return
    # Of each element: its text outside cuts, the same with MILD ones, with all.
    sizes: dict[int, list[int]] = {}
    for n, in_link, _ in reversed(order):
        own = 0 if in_link or n.tag == "a" else sum(len(c.strip()) for c in n.children if isinstance(c, str))
        total = [own, own, own]
        for c in n.children:
            if not isinstance(c, str) and c.cut < ALWAYS:
                got = sizes[id(c)]
                total[0] += got[0] if not c.cut else 0
                total[1] += got[1] if c.cut <= MILD else 0
                total[2] += got[2]
        sizes[id(n)] = total

    def below(top: Node) -> list[Node]:
        """The highest cut elements below top that are weighed."""
        out, todo = [], [top]
        while todo:
            for c in todo.pop().children:
                if not isinstance(c, str) and c.cut < ALWAYS:
                    (out if c.cut else todo).append(c)
        return out

    places = {id(n): marked for n, _, marked in order}
    kept, candidates = sizes[id(root)][0], below(root)
    # Within an article or <main> a cut can only be taken back where it is the bulk of that.
    has_article = any(not n.cut and n.tag in ("article", "main") and sizes[id(n)][0] for n, _, _ in order)
    while candidates:
        if kept:
            fit = [n for n in candidates if n.cut == MILD and sizes[id(n)][1] > kept]
            fit += [n for n in candidates if n.cut == FIRM and sizes[id(n)][2] > FIRM_SHARE * kept and (not has_article or places[id(n)])]
        else:
            fit = [n for n in candidates if sizes[id(n)][2]]
            fit = [n for n in fit if n.cut == min(x.cut for x in fit)]
        if not fit:
            return
        best = max(fit, key=lambda n: sizes[id(n)][2])
        best.cut = 0
        kept += sizes[id(best)][0]
        candidates.remove(best)
        candidates += below(best)


class Open:
    """The open elements, with the places of each tag, so that the nearest of a kind is found without a walk."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.block_places.append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags: tuple[str, ...] | frozenset) -> int:
        """Place of the innermost open element of these; 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """Ends the element at a place and all in it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.block_places.pop()

    def close_nearest(self, tags: tuple[str, ...] | frozenset, bounds: tuple[str, ...] | frozenset) -> None:
        place = self.nearest(tags)
        if place and place > self.nearest(bounds):
            self.close(place)

    def end(self, tag: str) -> None:
        """An end tag; that of an inline element doesn't reach out of the block around."""
        place = self.nearest((tag,))
        if place and (tag in BLOCK or not self.block_places or place > self.block_places[-1]):
            self.close(place)


def parse(html: str) -> Node:
    root = Node("#root", None)
    open_ = Open(root)
    at = 0
    find = TOKEN.search
    while True:
        m = find(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            open_.stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        if m[2] is None or m[4] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.end(tag)
            continue
        if tag in FOREIGN and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|\Z", re.I).search(html, at)
            at = end.end()
            continue
        if tag in ENDS_P:
            open_.close_nearest(("p",), P_BOUNDARY)
        if tag in CLOSES:
            open_.close_nearest(*CLOSES[tag])
        node = Node(tag, open_.stack[-1], is_cut(tag, m[3], tag in ("header", "div") and bool(open_.nearest(("article", "section")))))
        open_.stack[-1].children.append(node)
        if tag not in VOID and (tag in BLOCK or not m[3].endswith("/")):
            open_.push(node)


def blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(element that holds it, text, characters of it in links) of each block below node, in page order."""
    out: list[tuple[Node, str, int]] = []
    buffer: list[str] = []
    linked = 0
    owner = node

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                out.append((owner, text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    # Iterative, as pages nest as deeply as they like.
    todo: list[tuple[Node, int, bool]] = [(node, 0, False)]
    while todo:
        here, k, in_link = todo.pop()
        if k == 0 and here.tag in BLOCK:
            flush()
            owner = here
        while k < len(here.children):
            child = here.children[k]
            k += 1
            if isinstance(child, str):
                buffer.append(child)
                if in_link:
                    linked += len(child.strip())
            elif child.cut:
                if child.tag in BLOCK:
                    flush()
                else:
                    buffer.append(" ")
            elif child.tag == "br":
                buffer.append(" ")
            else:
                todo.append((here, k, in_link))
                todo.append((child, 0, in_link or child.tag == "a"))
                break
        else:
            if here.tag in BLOCK:
                flush()
                owner = here.within or node
    flush()
    return out


def container(found: list[tuple[Node, str, int]], root: Node) -> list[Node]:
    """What holds the best element, or all articles, with what is kept beside them; the rest in it is cut."""
    stats = Stats(found, root)
    texts, nodes = stats.texts, stats.nodes
    for n in nodes.values():
        n.points = START_POINTS.get(n.tag, 0)
    for holder, text, linked in found:
        if holder.tag in HEADINGS or holder.tag in ("th", "option"):
            continue
        points = (1 + text.count(",") + text.count("、") + min(3, len(text) / 100)) * (1 - linked / len(text))
        level, up = 0, holder if holder.tag not in ("p", "li", "td", "dd", "dt") else holder.parent
        while up is not None and level <= LEVELS:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            level, up = level + 1, up.parent
    if not nodes:
        return []

    def discounted(n: Node) -> float:
        total, linked = texts[id(n)]
        return n.points * (1 - linked / total)

    best = max(nodes.values(), key=discounted)
    outer = None
    up = best
    while up is not None:
        if up.tag == "article" or (up.tag == "main" and outer is None):
            outer = up
        up = up.parent
    if outer is not None and outer.tag == "main":
        return [outer]
    if outer is not None:
        # All articles that lie in no other, and what is kept beside them.
        tops = [outer]
        todo = [root]
        while todo:
            n = todo.pop()
            for c in n.children:
                if not isinstance(c, str) and not c.cut:
                    if c.tag != "article":
                        todo.append(c)
                    elif c is not outer and id(c) in texts and not linked_text(c, texts):
                        tops.append(c)
    else:
        tops = [best]
    # Up from the kept ones, siblings outside them are cut at each level, so that the root is left with what is kept.
    kept = {id(n) for n in tops}
    ways: dict[int, Node] = {}
    for n in tops:
        while n.parent is not None and id(n.parent) not in ways:
            n = n.parent
            ways[id(n)] = n
    bar = min(MIN_TEXT, 0.2 * max(texts[id(n)][0] for n in tops))
    for up in ways.values():
        members = [c for c in up.children if not isinstance(c, str) and not c.cut]
        on_way = [id(c) in kept or id(c) in ways for c in members]
        good = on_way if outer is not None else [w or fits(c, stats, bar) for w, c in zip(on_way, members, strict=True)]
        first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
        for k, c in enumerate(members):
            if not on_way[k] and id(c) in texts and (not first <= k <= last or (not good[k] and boilerplate(c, stats))):
                c.cut = ALWAYS
        # Stray text outside is no element that could be cut.
        if outer is not None:
            a, b = up.children.index(members[first]), up.children.index(members[last])
            up.children = [c for k, c in enumerate(up.children) if a <= k <= b or not isinstance(c, str)]
    return [root]


def linked_text(node: Node, texts: dict[int, list[int]]) -> bool:
    """More than half of its text is in links."""
    total, linked = texts[id(node)]
    return linked > 0.5 * total


def boilerplate(node: Node, stats: Stats) -> bool:
    """A menu, or an element of links that is no list."""
    return menu(node, stats) if node.tag in LISTS else linked_text(node, stats.texts)


def fits(node: Node, stats: Stats, bar: float) -> bool:
    """A sibling of the article's best element that is the article's too: text blocks, lists and tables whatever their length."""
    if id(node) not in stats.texts or boilerplate(node, stats):
        return False
    total, linked = stats.texts[id(node)]
    return node.tag in TEXT_TAGS or total - linked >= bar


class Stats:
    """Of each element with text, from its blocks: characters and those in links, blocks, blocks that no menu has, the last block."""

    def __init__(self, found: list[tuple[Node, str, int]], root: Node):
        self.found = found
        self.texts: dict[int, list[int]] = {}
        self.blocks: dict[int, list[int]] = {}
        self.nodes: dict[int, Node] = {}
        for k, (holder, text, linked) in enumerate(found):
            self._add(holder, len(text), linked, 1, linked < 0.8 * len(text) or len(text.split()) > LABEL_WORDS, k)
        order = [root]
        for n in order:
            order.extend(c for c in n.children if not isinstance(c, str))
        for n in reversed(order):
            if id(n) in self.texts and n.parent is not None:
                self._add(n.parent, *self.texts[id(n)], *self.blocks[id(n)])
        self.before: dict[int, Node | str | None] = {}
        for n in order:
            last: Node | str | None = None
            for c in n.children:
                if not isinstance(c, str):
                    self.before[id(c)] = last
                    last = c
                elif c.strip():
                    last = c

    def _add(self, node: Node, total: int, linked: int, n: int, odd: int, last: int) -> None:
        self.nodes[id(node)] = node
        held = self.texts.setdefault(id(node), [0, 0])
        held[0] += total
        held[1] += linked
        held = self.blocks.setdefault(id(node), [0, 0, -1])
        held[0] += n
        held[1] += odd
        held[2] = max(held[2], last)


def menu(node: Node, stats: Stats) -> bool:
    """A list of three or more short links that no heading or colon introduces."""
    if node.tag not in LISTS or node.tag == "ol":
        return False
    n, odd, _ = stats.blocks.get(id(node), (0, 0, -1))
    if n < 3 or odd:
        return False
    before = stats.before.get(id(node))
    if before is None or isinstance(before, str):
        return before is None or not before.rstrip().endswith(":")
    last = stats.blocks.get(id(before), (0, 0, -1))[2]
    return before.tag not in HEADINGS and not (last >= 0 and stats.found[last][1].endswith(":"))


def extract(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    weigh(root)
    found = blocks(root)
    chosen = container(found, root)
    if not chosen:
        return ""
    stats = Stats([b for n in chosen for b in blocks(n)], root)
    todo: list[Node] = list(chosen)
    while todo:
        n = todo.pop()
        for c in n.children:
            if not isinstance(c, str) and not c.cut:
                if menu(c, stats):
                    c.cut = ALWAYS
                if not c.cut:
                    todo.append(c)
    return "\n\n".join(t for n in chosen for _, t, _ in blocks(n))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 500):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return common.map_batches(pages.select("page_id", "url", "html"), run, schema)
