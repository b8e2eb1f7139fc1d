"""Main text of HTML pages by tree scoring.

A page becomes a tree. Scripts, menus, hidden elements and the like leave it by their element names. Elements that forms,
roles or class names set apart leave it after scoring, but one that holds nearly all of the page's prose stays.
Each paragraph passes points for its length and commas to its ancestors, fewer the farther they are; an ancestor's
points are discounted by the share of its text that is inside links. The best container leads to the article:

- the article or main element around it, or
- the lowest ancestor that holds most of what all paragraphs of the page are worth; beside it stay its siblings that
  are mostly text, and of the siblings of its ancestors those with the title or with a fair share of the points.

Everything in the kept elements is returned but furniture: elements whose class or id is made of names such as
``comments`` or ``share-buttons`` alone. ``related-work`` is no such name. Names that an article's own parts may have
too, such as ``discussion``, only lower an element's score, and an element with enough prose stays.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_words = lambda text: frozenset(text.split())

# Element names of HTML by the way they are treated here.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title noscript iframe xmp noembed noframes")
BLOCKS = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul"
)
PARAGRAPHS = _words("p pre td blockquote li dd figcaption")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
LISTS = _words("dl ol ul")
NEVER = _words(
    "aside audio button canvas datalist dialog embed footer head iframe input link map menu meta nav noembed noframes "
    "noscript object optgroup option script select style svg template textarea title video"
)
#: An open element that a start tag of the same group closes.
CLOSES = {
    "li": _words("li"),
    "dt": _words("dt dd"),
    "dd": _words("dt dd"),
    "tr": _words("tr td th"),
    "td": _words("td th"),
    "th": _words("td th"),
    "option": _words("option"),
}
#: Elements beyond which an end tag, or a start tag's implied end tag, does not reach.
WALLS = {
    "li": _words("ul ol menu dir"),
    "dt": _words("dl"),
    "dd": _words("dl"),
    "tr": _words("table"),
    "td": _words("table tr"),
    "th": _words("table tr"),
    "option": _words("select"),
}
#: Words that name what stands beside an article, as a class or id of their own or with words of FILLERS.
APART = _words(
    "ad ads adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pager pagination popup "
    "promo promoted share sharing shoutbox sidebar signup sitemap social sponsor sponsored toolbar widget widgets"
)
#: Words that name such parts or parts of an article.
UNSURE = _words(
    "banner byline copyright discussion header notice notices overlay promotion recommended related replies reply respond "
    "responses search subscribe tags"
)
#: Words that say nothing on their own.
FILLERS = _words(
    "area articles bar block body bottom bottombar box buttons col column container content count entry form global icons "
    "inner items left links list main meta middle network outer page panel popular post posts primary right secondary "
    "section site slot stories story strip tools top topbar unit wrap wrapper zone"
)
ARTICLE = _words("article body content entry main post story text")
#: Words that name what readers have written, with whatever word in front.
COMMENTS = _words("comments commentlist disqus")
#: What words of UNSURE leave of an element's score, and the score from which it stays.
LOWERED, ENOUGH = 0.3, 3.0
#: An element with a larger share of its text inside links is not mostly text.
LINKS = 0.25
#: The share of what all paragraphs are worth that the article's container holds at least.
MOST = 0.75
ROLES = _words("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar form")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w=\"'-])(hidden)(?![\w=-])", re.S)
_TOKEN = re.compile(r"[^\W_]+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    """An element: children are nodes and decoded strings in page order."""

    __slots__ = ("attributes", "children", "holds", "length", "link_length", "name", "parent", "points", "worth")

    def __init__(self, name: str, parent: Node | None, attributes: dict[str, str]):
        self.name, self.parent, self.attributes = name, parent, attributes
        self.children: list[Node | str] = []
        self.points = self.worth = 0.0  # worth: of all paragraphs inside, wherever they stand
        self.length = self.link_length = 0
        self.holds: frozenset[str] = frozenset()  # which of TITLED are inside

    def inner(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]

    def density(self) -> float:
        """The share of its text that is inside links."""
        return self.link_length / max(self.length, 1)


def _attributes(rest: str) -> dict[str, str]:
    if "=" not in rest and "hidden" not in rest:
        return {}
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def parse(page: str) -> Node:
    """The page's tree; end tags that are missing are implied and those that fit nothing are ignored."""
    root = Node("#root", None, {})
    at, here = 0, root

    open_names: Counter[str] = Counter()

    def text(piece: str) -> None:
        if piece:
            here.children.append(html.unescape(piece))

    def leave(upto: Node) -> None:
        """Makes the parent of ``upto`` the open element."""
        nonlocal here
        while True:
            open_names[here.name] -= 1
            left, here = here, here.parent
            if left is upto:
                return

    def close(names: frozenset[str], walls: frozenset[str]) -> None:
        if not any(open_names[name] for name in names):
            return
        node = here
        while node is not root and node.name not in walls:
            if node.name in names:
                leave(node)
                return
            node = node.parent

    while match := _TAG.search(page, at):
        text(page[at : match.start()])
        at = match.end()
        name = (match["name"] or match["name2"] or "").lower()
        if not name:
            continue
        if match["end"] or match["end2"]:
            close(frozenset((name,)), WALLS.get(name, frozenset()) if name != "p" else frozenset())
            continue
        if name in BLOCKS:
            close(frozenset(("p",)), frozenset(("table", "td", "th", "button", "object")))
            if name in HEADINGS and here.name in HEADINGS:
                leave(here)
        if name in CLOSES:
            close(CLOSES[name], WALLS[name])
        rest = match["rest"] if match["name"] else match["rest2"]
        node = Node(name, here, _attributes(rest or ""))
        here.children.append(node)
        if name in RAW:
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not (rest or "").endswith("/") or name in BLOCKS:
            if name not in VOID:
                here = node
                open_names[name] += 1
    text(page[at:])
    return root


#: Elements with the article or its title.
TITLED = _words("article main h1")


def _names(node: Node) -> list[list[str]]:
    """The words of each class and of the id."""
    if not node.attributes:
        return []
    groups = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split()
    return [_TOKEN.findall(_CAMEL.sub("-", group).lower()) for group in groups]


def _named(node: Node, names: frozenset[str]) -> bool:
    """Has it a class or id with words of ``names``, and else with words of the three lists and numbers alone?"""
    for words in _names(node):
        if any(w in names for w in words) and all(w in APART or w in UNSURE or w in FILLERS or w.isdigit() for w in words):
            return True
    return False


def _gone(node: Node) -> bool:
    """Is it no text of the page, or hidden?"""
    if node.name in NEVER - {"header"} or "hidden" in node.attributes or node.attributes.get("aria-hidden") == "true":
        return True
    return bool(re.search(r"display\s*:\s*none", node.attributes.get("style", "")))


def _comments(node: Node) -> bool:
    """Is it named after what readers have written: ``comments``, ``reader-comments``, ``comments-area``?"""
    return any(1 < len(words) < 3 and words[-1] in COMMENTS for words in _names(node)) or _named(node, COMMENTS)


def _apart(node: Node, inside: bool) -> bool:
    """Do its name, role or class set it beside the article? ``inside``: it is in an article or main element."""
    if node.name == "form":  # some pages are one form
        return not node.holds
    if node.name == "header" and not inside:
        return not node.holds & {"article", "main"}
    if node.name in ("html", "body", "main", "article") or node.holds & {"main", "h1"}:
        return False
    return node.attributes.get("role", "").lower() in ROLES or _comments(node) or _named(node, APART)


def _doubtful(node: Node, root: Node) -> bool:
    """Is it set apart by a form, a role or a compound name only, on a page without articles, and holds most of the prose?"""
    if node.worth < MOST * root.worth or not root.worth or root.holds & {"article", "main"} - node.holds or _comments(node):
        return False
    return not any(len(words) == 1 and words[0] in APART for words in _names(node))


def _prune(root: Node) -> None:
    """Drops what is gone, scores the rest, then drops what is apart; no page with prose is left without any."""
    for node in reversed(_in_order(root)):
        node.children = [c for c in node.children if isinstance(c, str) or not _gone(c)]
    for node in reversed(_in_order(root)):
        found = node.holds | ({node.name} & TITLED)
        if found and node.parent is not None:
            node.parent.holds |= found
    _score(root)
    stack, apart = [(root, False)], []
    while stack:
        node, inside = stack.pop()
        inside = inside or node.name in ("article", "main")
        for child in node.inner():
            if _apart(child, inside):
                apart.append((node, child))
            if not apart or apart[-1][1] is not child or _doubtful(child, root):
                stack.append((child, inside))
    taken = [c for _, c in apart if not _doubtful(c, root)]
    if root.worth - sum(c.worth for c in taken) <= 0 < root.worth and not root.holds & {"article", "main"}:
        richest = max(taken, key=lambda c: c.worth)  # all prose is in elements set apart
        taken = [c for c in taken if c is not richest]
    gone = {id(c) for c in taken}
    for node, _ in apart:
        node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]


def _in_order(root: Node) -> list[Node]:
    """Every element, parents first."""
    found = [root]
    for node in found:
        found.extend(node.inner())
    return found


def _text(node: Node) -> str:
    parts, stack = [], [node]
    while stack:
        one = stack.pop()
        if isinstance(one, str):
            parts.append(one)
        elif one.name == "br":
            parts.append(" ")
        else:
            stack.extend(reversed(one.children))
    return " ".join("".join(parts).split())


def _score(root: Node) -> list[Node]:
    """Gives every element its points and lengths; returns them, parents first."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.points = node.worth = 0.0
        node.length = own + sum(c.length for c in node.inner())
        node.link_length = node.length if node.name == "a" else sum(c.link_length for c in node.inner())
    for node in nodes:
        blocks = any(not isinstance(c, str) and c.name in BLOCKS for c in node.children)
        loose = node.name in BLOCKS and not blocks and node.name not in HEADINGS
        if not node.length or not (node.name in PARAGRAPHS and not blocks or loose):
            if not (node.name in BLOCKS and blocks and any(isinstance(c, str) and len(c.strip()) > 25 for c in node.children)):
                continue
            text = " ".join(c for c in node.children if isinstance(c, str))
        else:
            text = _text(node)
        worth = (1.0 if len(text) >= 25 else 0.1) + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
        worth *= 1 - node.density()
        node.worth += worth
        parent = node if blocks or node.name not in PARAGRAPHS else node.parent
        level = 0
        while parent is not None and level < 5:
            parent.points += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            parent, level = parent.parent, level + 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.worth += node.worth
    return nodes


def _rank(node: Node) -> float:
    names = {w for words in _names(node) for w in words}
    bonus = 1.5 if node.name in ("article", "main") else 1.25 if names & ARTICLE else 1.0
    lowered = LOWERED if _named(node, UNSURE) else 1.0
    return node.points * bonus * lowered * (1 - node.density())


def _drop_unsure(root: Node) -> bool:
    """Elements with an unsure name and little prose go, but never what holds most of the page's prose or its title."""
    stack, dropped = [root], False
    while stack:
        node = stack.pop()
        for child in node.inner():
            if (
                child.name not in ("html", "body", "main", "article")
                and not child.holds
                and _named(child, UNSURE)
                and child.worth * LOWERED * (1 - child.density()) < ENOUGH
                and child.worth < MOST * root.worth
            ):
                node.children = [c for c in node.children if c is not child]
                dropped = True
            else:
                stack.append(child)
    return dropped


def _blocks(node: Node, found: list[str]) -> None:
    """Appends the text of each block below the element, in page order."""
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            found.append(text)
        line.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        one = stack.pop()
        if one is None:
            flush()
        elif isinstance(one, str):
            line.append(one)
        elif one.name == "br":
            line.append(" ")
        elif one.name in BLOCKS:
            flush()
            stack.append(None)
            stack.extend(reversed(one.children))
        else:
            stack.extend(reversed(one.children))
    flush()


def _kept(best: Node, root: Node) -> list[Node]:
    """The elements that make up the article around the best container, in page order."""
    around, above = [], best
    while above is not None:
        if above.name in ("article", "main") and above.density() < LINKS:
            around.append(above)
        above = above.parent
    if around:  # several articles in one main element are one text unless one of them is most of it
        return [next((n for n in around if n.worth >= MOST * root.worth), around[-1])]
    while best.parent is not None and best.name != "body" and best.worth < MOST * root.worth:
        best = best.parent
    if best.parent is None or best.name == "body":  # a page without containers: what is mostly links is a menu
        menus = [c for c in best.inner() if c.name in BLOCKS - PARAGRAPHS - HEADINGS and c.density() > 0.5]
        best.children = [c for c in best.children if c not in menus]
        return [best]
    kept: set[int] = {id(best)}
    fair = max(10.0, 0.2 * _rank(best))
    here = best
    while here.parent is not None and here.name != "body":
        before = None
        for node in here.parent.inner():
            text = node.length and node.density() < LINKS
            # references: a list under a heading, with text besides its links
            listed = node.name in LISTS and before is not None and before.name in HEADINGS and node.density() < 0.9
            near = node.name in HEADINGS or text or listed
            before = node
            prose = text and node.worth >= 1 and node.name in BLOCKS  # a paragraph at least, however far it stands
            if (near and here is best) or (text and "h1" in node.holds | {node.name}) or prose or _rank(node) >= fair:
                if node is not here:
                    kept.add(id(node))
        here = here.parent
    found, stack = [], [here]
    while stack:
        node = stack.pop()
        if id(node) in kept:
            found.append(node)
        else:
            stack.extend(reversed(node.inner()))
    return found


def main_text(page: str) -> str:
    """The article's blocks joined by empty lines; white space inside a block is one space."""
    root = parse(page)
    _prune(root)
    nodes = _score(root)
    if _drop_unsure(root):
        nodes = _score(root)
    nodes = [n for n in nodes if n.name in BLOCKS or n is root]
    best = max(nodes, key=_rank)
    if best.points <= 0:
        best = next((n for n in nodes if n.name in ("article", "main")), root)
    found: list[str] = []
    for node in _kept(best, root):
        _blocks(node, found)
    return "\n\n".join(found)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, ``text`` and ``n_chars`` (its code points).

    A null or empty page has an empty text, and so has a page without text. Null ids and urls stay null; repeated
    rows stay rows of their own; other columns are ignored; an empty table gives an empty result. Of containers with
    equal points the outermost, then the first of the page leads. A page of any length or depth is read whole, in time
    that grows with its length; nothing recurses. There is no shuffle: a page needs only itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column(2)]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
