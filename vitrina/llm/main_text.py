"""Main text of HTML pages by a minimum cut.

The blocks of a page are nodes. A block's classifier score becomes the capacity
of its edge to the content or to the boilerplate terminal; neighbours in page
order, and blocks below one container, are tied by smoothness edges. The side of
the minimum cut that stays with the content terminal is the main text.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# HTML element groups and common class or id words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("button canvas datalist head iframe noscript object option script select style svg template textarea title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
NOISE_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adbox alert banner breadcrumb breadcrumbs byline comment commentlist
 comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr hidden legal login masthead menu menus modal nav navbar
 navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond responses reviews search share sharing sidebar
 signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget""".split())
MODIFIERS = frozenset("has have no not with without".split())  # "has-sidebar" names what is elsewhere in the box
OTHERS_WORDS = frozenset("comment comments commentlist discussion disqus recommended related replies respond".split())  # what readers wrote, other pages
STATE_WORDS = frozenset("closed disabled enabled off on open".split())  # "comments-open" says something about the box, not what it holds
GUESSED_TAGS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
CONTENT_WORDS = frozenset("article articlebody body content entry maincontent post postbody story text".split())
WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
DROPPED_TAG = re.compile(rf"<(/?)({'|'.join(sorted(DROPPED))})\b", re.I)

NOISE, CONTENT_PLACE, LONG_TEXT, SENTENCE, LINKS, BARE = -8.0, 3.0, 2.0, 1.0, -3.0, -1.0
NEXT, SAME_PARENT, SAME_CONTAINER = 0.3, 0.6, 0.4


class Element:
    """``hidden``: in navigation, a footer or the like, or not shown. ``mark``: the
    nearest element whose class, id or form tag only suggests boilerplate.
    ``others``: in a box named for comments or for other pages, whatever its length."""

    __slots__ = ("tag", "parent", "hidden", "mark", "outer", "void", "others", "content", "block")

    def __init__(self, tag: str, parent: Element | None, attrs: dict[str, str | None]):
        self.tag, self.parent = tag, parent
        tokens = [t for key in ("class", "id") for t in (attrs.get(key) or "").split()]
        names, plain, others = set(), set(), False
        for t in tokens:
            words = [w.lower() for w in WORD.findall(t)]
            names.update(words, (t.lower(),))
            if not (len(words) > 1 and words[0] in MODIFIERS):
                plain.update(words, (t.lower(),))
                others |= bool(words) and (words[0] in OTHERS_WORDS or words[-1] in OTHERS_WORDS) and words[-1] not in STATE_WORDS
        up = parent
        self.content = bool(up and up.content) or tag in ("article", "main") or attrs.get("role") == "main" or bool(names & CONTENT_WORDS)
        style = (attrs.get("style") or "").replace(" ", "").lower()
        own = (tag in NOISE_TAGS and tag not in GUESSED_TAGS or tag == "header" and not self.content
               or attrs.get("role") in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style)
        guess = (tag in GUESSED_TAGS or "header" in plain and not self.content
                 or bool(plain & NOISE_WORDS) and tag not in ("html", "body"))
        self.hidden = bool(up and up.hidden) or own
        self.others = bool(up and up.others) or others and tag not in ("html", "body", "article", "main")
        self.outer, self.void = up.mark if up else None, False
        self.mark: Element | None = self if guess else self.outer
        self.block = tag in BLOCKS

    def boilerplate(self) -> Element | None:
        """The nearest mark that stands."""
        mark = self.mark
        while mark is not None and mark.void:
            mark = mark.outer
        return mark

    @property
    def noise(self) -> bool:
        return self.hidden or self.boilerplate() is not None


class Block:
    __slots__ = ("parts", "element", "link_chars")

    def __init__(self, element: Element):
        self.parts: list[str] = []
        self.element, self.link_chars = element, 0


class OpenDropped(HTMLParser):
    """Which start tags of dropped elements, in page order, have no end tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.n = 0
        self.unclosed: dict[str, list[int]] = {t: [] for t in DROPPED}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.unclosed[tag].append(self.n)
            self.n += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        if self.unclosed.get(tag):
            self.unclosed[tag].pop()


def unclosed_dropped(html: str) -> frozenset[int]:
    count: dict[tuple[str, str], int] = {}
    for end, tag in DROPPED_TAG.findall(html):
        count[end, tag.lower()] = count.get((end, tag.lower()), 0) + 1
    if all(count.get(("/", t), 0) == n for (end, t), n in count.items() if not end):
        return frozenset()
    page = OpenDropped()
    page.feed(html)
    page.close()
    return frozenset(n for ns in page.unclosed.values() for n in ns)


class PageBlocks(HTMLParser):
    """Text blocks in page order; tolerates missing and crossed end tags.

    A dropped element without end tag (``unclosed``) ends at the next block's
    start tag or at the end tag of a block around it; the head ends at the first
    tag or text that belongs to the body.
    """

    def __init__(self, unclosed: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.unclosed, self.n, self.loose = unclosed, 0, False
        self.stack: list[Element] = [Element("html", None, {})]
        self.count: Counter = Counter()  # open elements by tag, so that nobody walks the stack for a tag that is not there
        self.blocks: list[Block] = []
        self.open: Block | None = None
        self.dropped: list[str] = []
        self.links = 0

    def _close_to(self, tags: tuple[str, ...], scopes: tuple[str, ...] = ()) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.count.subtract(e.tag for e in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i].tag in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        number = self.n
        self.n += tag in DROPPED
        if self.dropped == ["head"] and tag not in HEAD_TAGS and tag != "head" or self.loose and (tag in BLOCKS or tag == "body"):
            self._end_dropped()
        if self.dropped:
            # an unclosed tag of the same name has no end of its own to wait for
            if tag == self.dropped[-1] and number not in self.unclosed and tag != "head" or self.dropped == ["head"] and tag in DROPPED and tag != "head":
                self.loose = self.loose or number in self.unclosed
                self.dropped.append(tag)
            return
        if tag in VOID:
            if tag == "br" and self.open:
                self.open.parts.append(" ")
            elif tag == "hr":
                self.open = None
            return
        if tag in DROPPED:
            self.dropped.append(tag)
            self.loose = tag != "head" and number in self.unclosed
            return
        if tag in BLOCKS:
            self.open = None
            self._close_to(("p",), ("article", "aside", "body", "button", "div", "footer", "form", "header", "main", "nav", "section", "td", "th", "table", "blockquote", "li"))
        if tag in CLOSES:
            self._close_to(CLOSES[tag], SCOPES.get(tag, ()))
        if tag == "a":
            self.links += 1
        self.stack.append(Element(tag, self.stack[-1], dict(attrs)))
        self.count[tag] += 1

    def _end_dropped(self) -> None:
        self.dropped.clear()
        self.loose = False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in DROPPED and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag in self.dropped:
                del self.dropped[len(self.dropped) - 1 - self.dropped[::-1].index(tag) :]
                self.loose = self.loose and bool(self.dropped)
                return
            if not (self.loose and tag in BLOCKS and self.count[tag]):
                return
            self._end_dropped()
        if tag in BLOCKS:
            self.open = None
        if tag == "a" and self.links:
            self.links -= 1
        if self.count[tag]:
            self._close_to((tag,), () if tag in BLOCKS else tuple(BLOCKS))

    def handle_data(self, data: str) -> None:
        if self.dropped == ["head"] and data.strip():
            self._end_dropped()
        if self.dropped:
            return
        if self.open is None:
            if not data.strip():
                return
            element = self.stack[-1]
            while element.parent is not None and not element.block:
                element = element.parent
            self.open = Block(element)
            # inline ancestors may carry noise marks of their own
            if self.stack[-1].noise and not element.noise:
                self.open.element = self.stack[-1]
            self.blocks.append(self.open)
        self.open.parts.append(data)
        if self.links:
            self.open.link_chars += len(data)


def lift_marks(texts: list[str], elements: list[Element]) -> None:
    """Voids marks that cannot be right: below a marked container lies most of
    the page's sentence text (what deeper marks hold not counted), the text
    without any mark is less than half of it, and no more than headings of it
    are in a content place. Boxes of comments or of other pages are never the
    main text, so theirs does not count and their marks stand."""
    size = [len(t) if t.count(" ") >= 9 and not e.hidden and not e.others else 0 for t, e in zip(texts, elements)]
    total = sum(size)
    while True:
        free, own, below = 0, {}, {}
        for n, e in zip(size, elements):
            mark = e.boilerplate()
            if mark is None:
                if e.content and not e.hidden and e.tag not in HEADINGS:
                    return
                free += n
            elif n:
                own[mark] = own.get(mark, 0) + n
        for mark, n in own.items():
            up = mark.outer
            while up is not None:
                below[up] = below.get(up, 0) + n
                up = up.outer
        fit = [m for m, n in own.items() if 2 * n > total - below.get(m, 0) and 2 * free < n]
        if not fit:
            return
        # the outermost first: what it holds may make the others needless
        next((m for m in fit if m in below), fit[0]).void = True


def block_score(text: str, element: Element, link_share: float) -> float:
    """Classifier score: above 0 speaks for content."""
    words = text.count(" ") + 1
    score = (NOISE if element.noise else 0.0) + (CONTENT_PLACE if element.content else BARE)
    if words >= 10:
        score += LONG_TEXT
    if text[-1] in ".!?…:;\"”»)" or element.tag in HEADINGS:
        score += SENTENCE
    if link_share > 0.5:
        score += LINKS
    return score


def minimum_cut(capacity: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side. A positive capacity ties a node to
    the source, a negative one to the sink; edges are undirected. Dinic."""
    n = len(capacity)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(capacity):
        if c > 0:
            add(s, i, c, 0.0)
        elif c < 0:
            add(i, t, -c, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1
            else:
                break


def main_blocks(html: str) -> list[str]:
    """The page's content blocks, white space as single spaces."""
    page = PageBlocks(unclosed_dropped(html))
    page.feed(html)
    page.close()
    texts, elements, links = [], [], []
    for b in page.blocks:
        raw = "".join(b.parts)
        text = " ".join(raw.split())
        if text:
            texts.append(text)
            elements.append(b.element)
            links.append(b.link_chars / max(1, len(raw)))
    lift_marks(texts, elements)
    capacity = [block_score(t, e, share) for t, e, share in zip(texts, elements, links)]
    edges, last = [], {}
    for i, e in enumerate(elements):
        if i:
            edges.append((i - 1, i, SAME_PARENT if e.parent is elements[i - 1].parent else NEXT))
        box = e.parent.parent if e.parent else None
        if box is not None:
            j = last.get(id(box))
            if j is not None and j < i - 1:
                edges.append((j, i, SAME_CONTAINER))
            last[id(box)] = i
    keep = minimum_cut(capacity, edges)
    return [t for t, k in zip(texts, keep) if k]


def main_text(html: Column) -> Column:
    """Main text of a page: content blocks joined by an empty line.

    NULL and empty pages, and pages without content, give the empty string. Each
    page is taken alone, whole, whatever its length.
    """

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: "\n\n".join(main_blocks(h)))

    return extract(F.coalesce(html.cast("string"), F.lit("")))
