"""Operator 9: main text of web pages by tree scoring.

A page is read into a tree, with the implied ends of HTML. Its text falls into blocks: stretches between block-level tags.
Each block passes points to the elements around it, one and one for each comma and one for each hundred characters up to
three, all of them to the nearest and half as many to each next one. An element's points are discounted by its link
density. The best element is the container. Inside article or main it is lifted to that, and its siblings stay too if they
score well or are headings or prose with few links. Elsewhere it is lifted to the outermost ancestor beside which there are
headings or prose with few links, and all siblings with few links stay, whatever their length or tag.

Before that, parts that are never the article go: by tag, by role, or by the words of class and id. Inside article or main
such words never decide alone: a part goes if its links, its form, its place or its lack of prose say so too. Elsewhere
words that may be a topic as well are forgiven if without those parts no prose is left.

Every step takes time in proportion to the page: what is known of an element's inside is added up from its children.

Defined results: null or empty html, and pages without an article, give the empty text; what cannot be parsed is text; no
block is dropped for its length; repeated rows are treated alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import computed

_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*(?:>|\Z))""", re.S)
_REST = re.compile(r"<[!?/].*", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open element of those named, unless one of the bounds stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPES = ("table", "td", "th", "caption", "object")
CELLS = frozenset("td th tr tbody thead tfoot caption".split())
BOUNDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
NEVER = frozenset("head script style noscript template svg annotation annotation-xml nav footer aside form button select textarea iframe object canvas audio video map dialog menu title input fieldset noembed noframes".split())
FORMS = frozenset("form button select textarea input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status form".split())
#: Words of class and id, by what they name.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox sponsor sponsored sponsors promo promoted promotion banner taboola outbrain".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply discussion feedback".split())
ASKING = frozenset("cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription login signin signup".split())
AROUND = frozenset(
    "nav navbar navigation menu menus submenu sidebar sidebars aside widget widgets footer foot header masthead topbar toolbar breadcrumb breadcrumbs crumbs pagination pager "
    "share sharing social related recommended recommendations recommend more notice notices alert alerts disclaimer copyright legal search skip hidden "
    "tags toc trending popular sitemap policy toolbox shoutbox rail".split()
)
NAMES = ADVERTS | COMMENTS | ASKING | AROUND
#: Of these, words that may be what an article is about.
TOPICS = frozenset("advertising promotion promoted sponsors discussion feedback respond replies reply consent subscription navigation share sharing social related recommended recommendations more notice notices alert alerts disclaimer copyright legal search hidden tags trending popular policy".split())

#: Share of the text in links from which an element is not of the article, and characters of a block of prose.
LINKED, PROSE = 0.25, 80


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "size", "linked", "prose", "first", "last", "holds", "gone", "kept")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.holds, self.gone, self.kept = 0, False, False
        self.clear()

    def clear(self) -> None:
        """What blocks add up to: points, characters, those in links, blocks of prose, the first and last block's places."""
        self.points, self.size, self.linked, self.prose, self.first, self.last = 0.0, 0, 0, 0, -1, -1


#: What an element holds, at any depth.
MAIN, TITLE, HEADING, FORM, COMMENTS_IN = 1, 2, 4, 8, 16


class _Open:
    """The open elements of a page that is being read, and where in their order each tag is."""

    def __init__(self, root: Node):
        self.path, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of some tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop_to(self, place: int) -> None:
        """End the element at a place and all within it."""
        while len(self.path) > place:
            self.places[self.path.pop().tag].pop()

    def end(self, tags: tuple, bounds: tuple) -> None:
        """End the outermost open element of some tags within the innermost of the bounds."""
        bound = self.last(*bounds)
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, bound)) < len(p)]
        if found:
            self.pop_to(min(found))


def parse(html: str) -> Node:
    """The tree of a page; text is kept as it stands, with its references."""
    root = Node("html", "", None)
    open_, end, last = _Open(root), 0, html.rfind(">")
    while m := _TOKEN.search(html, end) if end <= last else _REST.search(html, end):
        at = open_.path[-1]
        if m.start() > end:
            at.children.append(html[end : m.start()])
        end = m.end()
        if m.re is _REST:  # no tag can end any more; a comment or the like takes the rest
            continue
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            place = open_.last(tag)
            if place and place >= open_.last(*(("table",) if tag in CELLS else () if tag in SCOPES else SCOPES)):
                open_.pop_to(place)
            elif tag == "p":
                at.children.append(Node("p", "", at))
            continue
        if tag == "html" or tag == "body" and open_.places.get("body"):
            continue
        if tag in BLOCK:
            if open_.places.get("p"):
                open_.end(("p",), ("button", "td", "th", "caption", "table", "object"))
            if tag in HEADINGS and open_.path[-1].tag in HEADINGS:
                open_.pop_to(len(open_.path) - 1)
            if tag in ENDS:
                open_.end(ENDS[tag], BOUNDS.get(tag, ("table", "select")))
        at = open_.path[-1]
        node = Node(tag, attrs, at)
        at.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, end)
            node.children.append(html[end : stop.start() if stop else len(html)])
            end = stop.end() if stop else len(html)
        elif tag not in VOID and (not attrs.endswith("/") or tag in BLOCK):
            open_.push(node)  # a slash does not end an HTML element
    if end < len(html):
        open_.path[-1].children.append(html[end:])
    return root


def _path(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _order(root: Node) -> list[Node]:
    """All elements, each before those within it."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return out


def _says(attrs: str) -> tuple[str, set[str], bool]:
    """Role, words of class and id, and whether the element is hidden."""
    role, words, hidden = "", set(), False
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words.update(w.lower() for w in _WORDS.findall(value))
        elif name == "role":
            role = value.lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return role, words, hidden


def _prune(order: list[Node]) -> list[tuple[Node, set[str], bool]]:
    """Mark what goes by tag, role or style; the elements that names speak against: element, words, whether in an article."""
    said = {id(n): _says(n.attrs) for n in order if n.attrs}
    for node in reversed(order):
        tag = node.tag
        words = said[id(node)][1] if node.attrs else ()
        own = (tag in ("article", "main", "body")) * MAIN | (tag == "h1") * TITLE | (tag in HEADINGS) * HEADING | (tag in FORMS) * FORM | (not COMMENTS.isdisjoint(words)) * COMMENTS_IN
        if node.parent is not None:
            node.parent.holds |= node.holds | own
    named, inside = [], {}
    for node in order:
        if node.parent is None:
            inside[id(node)] = False
            continue
        if node.parent.gone:
            node.gone = True
            continue
        tag, within = node.tag, inside[id(node.parent)]
        inside[id(node)] = within or tag in ("article", "main")
        role, words, hidden = said[id(node)] if node.attrs else ("", set(), False)
        if tag in NEVER:
            node.gone = not (tag == "form" and node.holds & (MAIN | TITLE))  # some pages are one form as a whole
        elif tag not in ("html", "body"):
            node.gone = hidden or role in ROLES
            if not node.gone and (words & NAMES or tag == "header"):
                named.append((node, words & NAMES | ({"header"} if tag == "header" else set()), within))
    return named


def _tells_against(node: Node, words: set[str], within: bool, article: Node | None, prose_before: list[int]) -> bool:
    """Whether an element that is named like no part of an article is none."""
    if node.tag == "main" or node.tag in ("article", "p", *HEADINGS) and not words & (COMMENTS | ADVERTS | ASKING):
        return False
    if not within:  # a wrapper of the whole page may be named like one of its parts; readers' comments may be articles themselves
        return bool(words & COMMENTS and not words <= TOPICS) or not node.holds & MAIN
    linked, short = _density(node) >= LINKED, node.prose == 0
    if words & (ADVERTS | ASKING) and not words <= TOPICS:
        return linked or node.prose <= 1 and not node.holds & TITLE or bool(words & ASKING and node.holds & FORM) or bool(words & ADVERTS and article and node.size < 0.25 * article.size and not node.holds & HEADING)
    if words & COMMENTS:
        last = article.last if article else node.last
        at_the_end = prose_before[last + 1] == prose_before[node.last + 1]
        if words <= TOPICS:  # a discussion may be the article's own
            return linked or bool(node.holds & (FORM | COMMENTS_IN))
        return linked or at_the_end or bool(node.holds & (FORM | COMMENTS_IN))
    return linked or short and not node.holds & HEADING


def _prune_named(order: list[Node], named: list[tuple[Node, set[str], bool]], blocks: list[tuple[Node, str, int]], forgiven: frozenset) -> None:
    """Mark what goes by the words of class and id; a page header inside an article keeps its headings and its prose."""
    prose_before = [0]
    for _, text, linked in blocks:
        prose_before.append(prose_before[-1] + _is_prose(text, linked))
    headers = []
    for node, words, within in named:
        words = words - forgiven
        if not words or node.first < 0:
            continue
        article = next((n for n in _path(node.parent) if n.tag in ("article", "main")), None) if within else None
        if "header" in words and (within or node.tag == "header" and node.holds & MAIN):
            headers.append(node)
        elif _tells_against(node, words, within, article, prose_before):
            node.gone = True
    stack = headers
    while stack:
        for child in stack.pop().children:
            if isinstance(child, Node) and child.tag in BLOCK and child.tag not in HEADINGS:
                if not child.holds & HEADING and not child.prose:
                    child.gone = True
                else:
                    stack.append(child)
            elif isinstance(child, Node) and child.tag not in HEADINGS:
                stack.append(child)
    for node in order:
        if node.parent is not None and node.parent.gone:
            node.gone = True


def _is_prose(text: str, linked: int) -> bool:
    return len(text) >= PROSE and linked < LINKED * len(text)


def _measure(order: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Add up the blocks of each element."""
    for node in order:
        node.clear()
    for k, (owner, text, linked) in enumerate(blocks):
        owner.size += len(text)
        owner.linked += linked
        owner.prose += _is_prose(text, linked)
        owner.first, owner.last = k if owner.first < 0 else owner.first, k
    for node in reversed(order):
        up = node.parent
        if up is not None and node.first >= 0:
            up.size += node.size
            up.linked += node.linked
            up.prose += node.prose
            up.first, up.last = node.first if up.first < 0 else min(up.first, node.first), max(up.last, node.last)


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(nearest block-level element, text, characters in links) of the page's blocks, in order."""
    out: list[tuple[Node, str, int]] = []
    text: list[str] = []
    links = [0]

    def flush(owner: Node) -> None:
        if text:
            words = "".join(text).split()
            if words:
                joined = " ".join(words)
                out.append((owner, joined, min(links[0], len(joined))))
            text.clear()
        links[0] = 0

    stack: list = [(root, root, False, iter(root.children))]
    while stack:
        node, owner, linked, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCK:
                flush(owner)
        elif isinstance(child, str):
            child = unescape(child) if "&" in child else child
            text.append(child)
            if linked:
                links[0] += len(" ".join(child.split()))
        elif child.gone:
            continue
        elif child.tag == "br":
            text.append(" ")
        elif child.tag in BLOCK:
            flush(owner)
            stack.append((child, child, linked or child.tag == "a", iter(child.children)))
        else:
            stack.append((child, owner, linked or child.tag == "a", iter(child.children)))
    flush(root)
    return out


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _score(node: Node) -> float:
    return node.points * (1 - _density(node))


def _beside(node: Node) -> list[Node]:
    """The elements beside ``node`` that have text; none beside the page as a whole."""
    if node.parent is None or node.tag in ("body", "html"):
        return []
    return [other for other in node.parent.children if isinstance(other, Node) and other is not node and not other.gone and other.size]


def _choose(blocks: list[tuple[Node, str, int]]) -> list[Node]:
    """The container and the siblings that stay with it; sizes are added up already."""
    scored: dict[int, Node] = {}
    for owner, text, linked in blocks:
        points, share = (0.0 if owner.tag in HEADINGS else 1 + text.count(",") + text.count("，") + text.count("、") + min(3, len(text) // 100)), 1.0
        points *= 1 - linked / len(text)
        if owner.tag in ("p", "li", "pre", "dt", "dd", "td", "th", "figcaption", "caption", "summary", *HEADINGS) and owner.parent is not None:
            owner = owner.parent
        for node in _path(owner):
            node.points += points * share
            scored[id(node)] = node
            share /= 2
            if share <= 0.05:
                break
    if not scored:
        return []
    best = max(scored.values(), key=_score)  # of equals the first, which is the innermost
    if _score(best) <= 0:
        return []
    lifted = [n for n in _path(best) if n.tag in ("article", "main")]
    if lifted:
        best = lifted[-1] if lifted[-1].tag == "article" or len(lifted) == 1 else next(n for n in reversed(lifted) if n.tag == "article")
        least = max(3.0, 0.2 * _score(best))
        beside = lambda other: other.tag in HEADINGS or _score(other) >= least or other.tag == "p" and _density(other) < LINKED or other.tag in ("article", "section") and other.tag == best.tag and _density(other) < LINKED
        return [best, *filter(beside, _beside(best))]
    for node in _path(best):  # the container may be one of the article's parts, alone in wrappers of its own
        if any(_density(other) < LINKED and (other.points >= 3 or other.tag in ("p", *HEADINGS) or other.holds & HEADING) for other in _beside(node)):
            best = node
    return [best, *(other for other in _beside(best) if other.tag in HEADINGS or _density(other) < LINKED)]


def _menus(order: list[Node], blocks: list[tuple[Node, str, int]]) -> set[int]:
    """Lists of three or more entries, over half of it in links, that no prose of an article leads to."""
    out, inside, prose_before = set(), {}, [0]
    for _, text, linked in blocks:
        prose_before.append(prose_before[-1] + _is_prose(text, linked))
    for node in order:
        up = node.parent
        inside[id(node)] = node.tag in ("article", "main") or up is not None and inside[id(up)]
        if up is not None and id(up) in out:
            out.add(id(node))
        elif node.tag in ("ul", "ol") and node.first >= 0 and not inside[id(node)] and node.last - node.first >= 2 and node.linked > node.size / 2:
            if up.tag in ("body", "html") or prose_before[node.first] == prose_before[max(up.first, 0)]:
                out.add(id(node))
    return out


def main_text(html: str) -> str:
    """The article of a page; blocks are joined by two line feeds."""
    if not html.strip():
        return ""
    root = parse(html)
    order = _order(root)
    named = _prune(order)
    blocks = _blocks(root)
    _measure(order, blocks)
    if named:
        by_tag = [n.gone for n in order]
        had_prose = root.prose
        for forgiven in (frozenset(), TOPICS):
            _prune_named(order, named, blocks, forgiven)
            left = _blocks(root)
            if any(_is_prose(text, linked) for _, text, linked in left) or not had_prose or forgiven:
                break
            for node, gone in zip(order, by_tag):
                node.gone = gone
        blocks = left
        _measure(order, blocks)
    menus = _menus(order, blocks)
    if menus:
        blocks = [b for b in blocks if id(b[0]) not in menus]
        _measure(order, blocks)
    for node in _choose(blocks):
        node.kept = True
    for node in order:
        node.kept = node.kept or node.parent is not None and node.parent.kept
    return "\n\n".join(text for owner, text, _ in blocks if owner.kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")

    def compute(texts):
        found = [main_text(t) for t in texts]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return computed(rows, ["page_id", "url"], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], compute, "html")
