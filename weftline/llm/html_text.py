"""Main text of web pages by tree scoring.

The page is read into blocks (runs of text between block tags) that hang on a tree of containers. A paragraph gives its
parent, and half as much its grandparent, points for itself, its length and its commas; a container's points count less
the more of its text stands in links, and more or less by what its tag and class name say. The best container is kept,
and of its siblings those that score well beside it or read like prose.

Tags and names that speak of menus, notices, adverts and the like mark a container. A mark cuts its container out only if the
text agrees: not if it holds most of the page's prose (a form around a whole page), not where it is a paragraph or heading
that is no link list, and not where it is the header of an article. If the marks would leave nothing, those of names, then all, are dropped.

What readers wrote is told by its build as well: two or more siblings alike, each with an author or a time and none with a
heading, which together aren't most of the page. So are menus: containers of links outside articles that hold no prose.

Every step takes time in proportion to the page: tags and attributes are read forwards only, elements to be closed are known
from each open one, and sums go up the tree once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, text_or_empty

NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"([^\s/>=]+|=)\s*(=?)\s*")
UNQUOTED = re.compile(r"[^\s>]*")
SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content or end tag, elements whose content is no text of the page, those whose content is raw, and elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DEAD = frozenset("head script style textarea title noscript template svg math iframe object canvas select option button".split())
VERBATIM = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_SCOPE = frozenset("div article section td th li body blockquote".split())
LIST_SCOPE = frozenset("ul ol dl table select".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre li td dd dt blockquote figcaption".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())

BOILER_TAGS = frozenset("nav header footer aside menu form".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words that mark a container where they are a whole class or id, or the last part of one (main-nav).
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu nav navbar "
    "navigation newsletter notice pager pagination popup promo promos promotion related replies reply responses share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: What may follow such a word (ad-box, related-posts).
BOILER_TAILS = frozenset("area bar block body box boxes button buttons container content count form group holder icons inner item items label link links list message module news overlay panel posts row section slot stories thread unit units widget wrap wrapper".split())
#: What stands in front of such a word where both are written as one (topnav); behind it stands a tail (cookiebar).
PLACES = frozenset("bottom foot global head left main page right side site sticky sub top user".split())
#: Names of containers that readers may have filled; they count where no heading is inside.
TALK = frozenset("discussion feedback talkback".split())
#: Names of parts that tell who wrote something, or when.
BYLINE = re.compile(r"(?i)author|avatar|byline|commenter|date|posted|published|time|user|vcard")
COMMENT_WORDS = frozenset("comment comments disqus replies reply responses".split())
#: What comes before such a word where it says the contrary (has-sidebar), or names the header of an article (entry-header).
EXEMPT = frozenset("has no not with without".split())
HEADER = re.compile(r"(?i)(?:article|content|entry|post|section|story)[-_]header\b")
GOOD = re.compile(r"(?i)article|body|content|entry|main|page|post|story|text")
BASE = {"article": 10, "main": 10, "section": 3, "div": 3, "td": 3, "pre": 3, "blockquote": 3, "body": 0, "ul": -3, "ol": -3, "li": -3, "dl": -3, "form": -3, "th": -5}
#: Points that a mark takes from a container that isn't cut out, and the link density from which a marked line is a list of links.
MARKED, LINK_LIST = 25, 0.3
#: Articles with less than this part of the prose of one marked container are teasers.
TEASER = 4


class Node:
    __slots__ = ("tag", "parent", "names", "dead", "mark", "near", "order", "score", "chars", "linked", "prose", "holds_article", "cut", "kept", "byline", "headed")

    def __init__(self, tag: str, parent: Node | None, names: str, dead: bool, mark: str, near: dict[str, Node], order: int) -> None:
        self.tag, self.parent, self.names, self.dead, self.mark, self.near, self.order = tag, parent, names, dead, mark, near, order
        self.score, self.chars, self.linked, self.prose, self.holds_article = 0.0, 0, 0, 0, tag in ("article", "main")
        self.cut = self.kept = False
        self.byline, self.headed = False, tag in HEADINGS


#: Both kinds of words written as one.
COMPOUNDS = frozenset({w + t for w in BOILER for t in BOILER_TAILS} | {p + w for p in PLACES for w in BOILER})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def name_mark(names: str, in_article: bool) -> str:
    """"comment", "name" or "" for the classes and id of an element."""
    found = ""
    for token in names.lower().replace("_", "-").split():
        parts = token.split("-")
        if parts[0] in EXEMPT or len(parts) > 2 and EXEMPT & set(parts[:-1]):
            continue
        if parts[-1] == "header" and (in_article or HEADER.search(token)):
            continue
        if parts[-1] in BOILER or parts[0] in BOILER and (len(parts) == 1 or parts[1] in BOILER_TAILS or parts[1] in BOILER or parts[1].isdigit()) or len(parts) > 2 and parts[-2] in BOILER and parts[-1] in BOILER_TAILS:
            if COMMENT_WORDS & set(parts):
                return "comment"
            found = "name"
        elif parts[-1] in TALK or parts[0] in TALK and len(parts) == 2 and parts[1] in BOILER_TAILS:
            found = "talk"
        elif COMPOUNDS & set(parts):
            found = "comment" if any(p.startswith(("comment", "repl", "response", "disqus")) for p in parts) else found or "name"
    return found


class Reader:
    """Reads a page once, forwards."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.root = Node("body", None, "", False, "", {}, 0)
        self.nodes = [self.root]
        self.open: dict[str, int] = {}
        self.here, self.links = self.root, False
        self.blocks: list[tuple[Node, list[str], list[int]]] = [(self.root, [], [0])]
        self.none: dict[str, bool] = {}

    def find(self, what: str, at: int) -> int:
        """``page.find`` that asks no second time for what the rest of the page lacks."""
        if self.none.get(what):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none[what] = True
        return found

    def say(self, text: str, references: bool = True) -> None:
        if text and not self.here.dead:
            text = html.unescape(text) if references and "&" in text else text
            self.blocks[-1][1].append(text)
            if self.links:
                self.blocks[-1][2][0] += len(text)

    def turn(self, node: Node) -> None:
        """Text from here on stands in the open element ``node``; those inside it are closed."""
        left = self.here
        while left is not node:
            self.open[left.tag] = self.open.get(left.tag, 0) - 1
            left = left.parent
        self.here = node
        self.new_block()

    def new_block(self) -> None:
        if self.blocks[-1][1]:
            self.blocks.append((self.here, [], [0]))
        else:
            self.blocks[-1] = (self.here, [], [0])

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes of a tag from ``at`` on, the place behind its end, and whether it ends itself."""
        found: dict[str, str] = {}
        page, n = self.page, len(self.page)
        while at < n:
            at = GAP.match(page, at).end()
            if at == n or page[at] == ">":
                return found, min(at + 1, n), page[at - 1] == "/"
            m = ATTRIBUTE.match(page, at)
            at, value = m.end(), ""
            if m[2]:
                quote = page[at] if at < n else ""
                end = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    u = UNQUOTED.match(page, at)
                    value, at = u[0], u.end()
            name = m[1].lower()
            if name in ("class", "id", "hidden", "aria-hidden", "style", "role"):
                found.setdefault(name, html.unescape(value))
        return found, n, False

    def start(self, tag: str, found: dict[str, str]) -> None:
        here = self.here
        if tag in ENDS_P and "p" in here.near:
            self.turn(here.near["p"].parent)
        for t in CLOSES.get(tag, ()):
            while t in self.here.near:
                self.turn(self.here.near[t].parent)
        here = self.here
        if tag in VOID:
            self.new_block()
            return
        near = here.near
        if tag in P_SCOPE or tag in LIST_SCOPE or tag == "p" or tag in CLOSES:
            near = dict(near)
            if tag in P_SCOPE:
                near.pop("p", None)
            if tag in LIST_SCOPE:
                for t in CLOSES:
                    near.pop(t, None)
        in_article = here.holds_article
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        dead = here.dead or hidden or tag in DEAD
        names = f"{found.get('class', '')} {found.get('id', '')}"
        mark = "" if tag in ("body", "html", "article", "main") else name_mark(names, in_article)
        titles = tag == "header" and (in_article or HEADER.search(names) is not None)
        if not mark and (tag in BOILER_TAGS and not titles or found.get("role", "") in BOILER_ROLES):
            mark = "tag"
        node = Node(tag, here, names, dead, mark, near, len(self.nodes))
        node.holds_article = in_article or node.holds_article  # while reading: stands in an article
        if tag == "p" or tag in CLOSES:
            near[tag] = node
        node.byline = names != " " and BYLINE.search(names) is not None
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.here = node
        self.new_block()

    def end(self, tag: str) -> None:
        if tag == "p" and self.here.tag != "p" and "p" not in self.here.near:
            self.new_block()
        elif tag not in INLINE and self.open.get(tag, 0) > 0:
            node = self.here
            while node.tag != tag:
                node = node.parent
            self.links = False
            self.turn(node.parent)

    def read(self) -> list[tuple[Node, str, int]]:
        page, at = self.page, 0
        while True:
            opens = self.find("<", at)
            if opens < 0:
                break
            m = NAME.match(page, opens)
            if m is None:
                if page.startswith("<!--", opens):
                    end = self.find("-->", opens + 4)
                    self.say(page[at:opens])
                    at = end + 3 if end >= 0 else len(page)
                    continue
                if page.startswith("<![CDATA[", opens) and (end := self.find("]]>", opens)) >= 0:
                    self.say(page[at:opens])
                    self.say(page[opens + 9 : end], False)
                    at = end + 3
                    continue
                if page[opens + 1 : opens + 2] in ("!", "?") and (end := self.find(">", opens)) >= 0:
                    self.say(page[at:opens])
                    at = end + 1
                    continue
                self.say(page[at : opens + 1])
                at = opens + 1
                continue
            self.say(page[at:opens])
            if self.find(">", m.end()) < 0:
                at = len(page)  # a tag without an end
                break
            tag = m[1].lower()
            found, at, ends_itself = self.attributes(m.end())
            if page[opens + 1] == "/":
                if tag == "a":
                    self.links = False
                else:
                    self.end(tag)
            elif tag in VERBATIM:
                if not ends_itself:
                    close = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if not self.none.get(tag) else None
                    self.none[tag] = close is None
                    at = close.end() if close else len(page)
                self.say(" ")
            elif tag in INLINE:
                if tag == "a":
                    self.links = True
                elif tag == "br":
                    self.say(" ")
                if tag == "time" or "class" in found and BYLINE.search(found["class"]):
                    self.here.byline = True
            elif not (ends_itself and tag in DEAD):
                self.start(tag, found)
        self.say(page[at:])
        out = []
        for node, parts, linked in self.blocks:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((node, text, min(linked[0], len(text))))
        return out


def _density(node: Node) -> float:
    return min(1.0, node.linked / node.chars) if node.chars else 0.0


def _prune(nodes: list[Node], blocks: list[tuple[Node, str, int]], marks: tuple[str, ...]) -> None:
    """Sums of text up the tree, and the nodes that marks of these kinds cut out."""
    for n in nodes:
        n.chars = n.linked = n.prose = 0
        n.score, n.cut, n.kept = 0.0, False, False
        n.holds_article = False
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        if linked < 0.5 * len(text):
            node.prose += len(text)
    for n in reversed(nodes):
        n.holds_article = n.holds_article or n.tag in ("article", "main") and n.chars > 0
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.linked += n.linked
            up.holds_article = up.holds_article or n.holds_article
            up.byline = up.byline or n.byline
            up.headed = up.headed or n.headed
            if not (n.mark == "comment" or n.tag == "nav"):
                up.prose += n.prose
    whole = nodes[0]
    # Prose of the outermost articles; and what stands in one.
    articles, inside = 0, set()
    alike: dict[tuple[int, str, str], list[Node]] = {}
    for n in nodes:
        if n.parent is not None and n.parent.order in inside:
            inside.add(n.order)
        elif n.tag in ("article", "main"):
            inside.add(n.order)
            articles += n.prose
        if n.byline and not n.headed and n.parent is not None and n.tag not in INLINE and n.chars:
            alike.setdefault((n.parent.order, n.tag, n.names), []).append(n)
    talk = {n.order for group in alike.values() if len(group) > 1 and 2 * sum(n.prose for n in group) <= whole.prose for n in group} if "comment" in marks else set()
    for n in nodes:
        if n.parent is not None and n.parent.cut or n.order in talk:
            n.cut = True
        elif n.mark == "talk" and "comment" in marks:
            n.cut = not n.headed and not n.holds_article and n.prose <= 0.5 * whole.prose
        elif not n.mark and "name" in marks and n.tag in ("div", "ul", "ol", "section", "table") and n.order not in inside and not n.prose and n.linked >= 0.7 * n.chars > 0:
            n.cut = True
        elif n.mark in marks:
            if n.mark == "comment" or n.tag == "nav":
                n.cut = True
            elif n.tag in LINES:
                n.cut = _density(n) >= LINK_LIST
            else:
                # With an article on the page the rest of it is no article, unless that is but a teaser beside it; else what holds most of the prose is.
                n.cut = not n.holds_article and n.prose <= TEASER * articles if articles else n.prose <= 0.5 * whole.prose


def _best(nodes: list[Node], blocks: list[tuple[Node, str, int]], marks: tuple[str, ...]) -> str:
    _prune(nodes, blocks, marks)
    candidates: list[Node] = []
    seen: set[int] = set()
    for node, text, linked in blocks:
        if node.cut:
            continue
        commas = text.count(",") + text.count("，") + text.count("、")
        points = (1 + commas + min(3, len(text) // 100)) * (1 - min(1.0, linked / len(text)))
        # A block's own element is the paragraph; text that stands bare in a container makes the container its parent.
        n: Node | None = node.parent if node.tag in PARAGRAPH and node.parent is not None else node
        share = 1.0
        for _ in range(3):
            if n is None:
                break
            if n.order not in seen:
                seen.add(n.order)
                candidates.append(n)
                n.score = BASE.get(n.tag, 0) + (25 if GOOD.search(n.names) else 0) - (MARKED if n.mark else 0)
            n.score += points * share
            share = share / 2 if share == 1.0 else share / 3
            n = n.parent
    if not candidates:
        return ""
    best = max(candidates, key=lambda n: (n.score * (1 - _density(n)), -n.order))
    top = best.score * (1 - _density(best))
    # Where the best one is a part of an article or main element, the whole element is the article.
    n = best
    while n is not None:
        if n.tag in ("article", "main"):
            best = n
        n = n.parent

    def fits(n: Node) -> bool:
        own = n.score * (1 - _density(n)) if n.order in seen else 0.0
        bonus = 0.2 * top if n.names.strip() and n.names == best.names else 0.0
        prose = n.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and (_density(n) < 0.25 if n.chars > 80 else not n.linked)
        return own + bonus >= max(10, 0.2 * top) or prose

    for n in nodes:  # parents come first
        if n is best or n.parent is not None and (n.parent.kept or n.parent is best.parent and fits(n)):
            n.kept = True
    return " ".join(text for node, text, _ in blocks if not node.cut and (node.kept or node is best.parent))


def main_text(page: str) -> str:
    """The blocks of the best container and its fit siblings, joined by one space; empty if the page has no text."""
    reader = Reader(page)
    blocks = reader.read()
    if not blocks:
        return ""
    for marks in (("comment", "name", "tag"), ("tag",), ()):
        text = _best(reader.nodes, blocks, marks)
        if text:
            return text
    return ""


def extract_text(df: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The main text of every whole page: id_column, the columns in ``keep``, text, n_chars (code points).

    A null or empty page has an empty text, an empty table an empty result. Pages are independent: nothing is shuffled, ids
    may be null or repeat, and pages of any length take time in proportion to it. Columns that aren't kept aren't read, whatever their names.
    """
    kinds = dict(df.dtypes)

    def work(columns: list[list]) -> Iterator[list]:
        texts = [main_text(h) for h in columns[1]]
        yield [columns[0], *columns[2:], texts, [len(t) for t in texts]]

    source = df.select(F.col(id_column).alias("__id"), text_or_empty(html_column).alias("__html"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    schema = ", ".join([f"`{id_column}` {kinds[id_column]}", *[f"`{c}` {kinds[c]}" for c in keep], "text string", "n_chars bigint"])
    return map_batches(source, source.columns, work, schema)
