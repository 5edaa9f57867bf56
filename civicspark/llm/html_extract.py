"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements.  Every paragraph earns points for
its length and commas and passes them to its ancestors, less the further up they
are; a container's points are discounted by the share of its text inside links.
The best container, raised to the article around it, and those of its siblings
that score well are kept, without navigation, adverts, forms, notices and comments.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
# Elements by the role they have in HTML.
_BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select"
    " summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
_RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside form button select menu dialog fieldset object canvas video audio".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Dropped elements that may be wrapped round a whole page.
_WRAPPERS = frozenset({"form"})
#: Ancestors that a paragraph passes points to.
LEVELS = 6
#: Words of a class or id that mark what is not the article.
_MARKS = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies"
    " disclaimer disqus dropdown footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination"
    " popup promo promoted promotion recommended related remark replies reply respond share sharing sidebar sidebars skip social sponsor sponsored"
    " subscribe subscription tags toolbar topbar widget widgets alert login signup search".split()
)
#: Those of them that an article's own parts may bear: inside one they tell nothing unless the part is mostly links or holds a form.
_VAGUE_MARKS = frozenset("alert disclaimer dropdown hidden login promotion recommended related remark search signup skip social tags topbar masthead footer widget widgets".split())
#: Share of links from which a part of an article is navigation, and above which a neighbour is none of it.
_MOSTLY_LINKS, _FEW_LINKS = 0.5, 0.25
#: Such words before or after a mark tell a page's state.
_STATE_BEGINS, _STATE_ENDS = frozenset("has no with without".split()), frozenset("open opened closed collapsed expanded active enabled disabled visible".split())
_HEAD_MARKS = frozenset({"header", "head"})
_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form".split())
#: An open element of the first kind ends where one of the second begins, up to one of the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


@dataclass
class Node:
    """A block element with its runs of text and child blocks in page order."""

    tag: str
    marks: frozenset
    parent: Node | None = None
    parts: list = field(default_factory=list)  # str or Node
    points: float = 0.0
    chars: int = 0
    linked: int = 0


def _marks(attrs: str) -> frozenset:
    found = set()
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                parts = [x for x in re.split(r"[^a-z0-9]+", word) if x]
                if not (len(parts) > 1 and (parts[0] in _STATE_BEGINS or parts[-1] in _STATE_ENDS)):  # has-sidebar, nav-open
                    found.update(parts)
        elif name == "role" and value in _ROLES:
            found.add("widget")
    return frozenset(found)


def _tree(page: str) -> Node:
    """The blocks of a page; end tags that are left out are implied, and unknown ones ignored."""
    root = now = Node("html", frozenset())
    opened: Counter = Counter()  # open elements or more by name, so that an end tag without one is known at once
    run: list[tuple[str, bool]] = []
    at, links = 0, 0

    def flush():
        nonlocal run
        text = " ".join(entities.unescape("".join(t for t, _ in run)).split())
        if text:
            linked = len(" ".join(entities.unescape("".join(t for t, link in run if link)).split()))
            now.parts.append(text)
            now.chars += len(text)
            now.linked += min(linked, len(text))
        run = []

    def close_to(node):
        nonlocal now
        flush()
        now = node.parent or root

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            run.append((page[at:], links > 0))
            break
        if m.start() > at:
            run.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                run.append((m[0][9:].removesuffix("]]>"), links > 0))
            continue
        if m["close"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCKS:
                node = now if opened[name] else root
                while node is not root and node.tag != name:
                    opened[node.tag] -= 1
                    node = node.parent
                if node is not root:
                    opened[name] -= 1
                    close_to(node)
                    links = 0 if node.tag != "p" else links
                else:
                    flush()
            continue
        if name in _RAW or name == "script" or name == "style":
            m2 = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = m2.end() if m2 else (end if name in ("script", "style") else at)
            run.append((" ", False))
            continue
        if name == "br":
            run.append((" ", links > 0))
        elif name == "a":
            links = 1  # links do not nest
        elif name in _BLOCKS:
            flush()
            node = now
            if name != "p" or now.tag == "p":
                while node is not root and node.tag == "p":
                    opened["p"] -= 1
                    now, node = node.parent, node.parent
            if name in _CLOSES:
                ends, limit = _CLOSES[name]
                node, last = now, None
                while node is not root and node.tag not in limit:
                    last = node if node.tag in ends else last
                    node = node.parent
                while last is not None and now is not last.parent:
                    opened[now.tag] -= 1
                    now = now.parent
            if name in ("body", "html"):
                continue
            child = Node(name, _marks(m["attrs"]), now)
            now.parts.append(child)
            if name not in _VOID and not m["attrs"].rstrip().endswith("/"):
                now = child
                opened[name] += 1
                links = 0
    flush()
    return root


def _boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element, inside an article or main element or not, is by its tag, class or role not part of an article."""
    if node.tag in ("html", "main"):
        return False
    if node.tag in _DROPPED:
        return True
    if inside and not node.marks & (_MARKS - _VAGUE_MARKS) and node.marks & _MARKS and not _is_navigation(node):
        return False
    if node.tag == "header" or (node.marks & _HEAD_MARKS and node.tag != "article"):
        if not (inside and any(isinstance(p, Node) and (p.tag in _HEADINGS or p.tag == "hgroup") for p in node.parts)):
            return node.tag == "header" or not any(isinstance(p, Node) and p.tag in ("p", "article", "section") for p in node.parts)
    return bool(node.marks & _MARKS)


def _is_navigation(node: Node) -> bool:
    """Whether a subtree is mostly links, or holds a form."""
    stack, chars, linked = [node], 0, 0
    while stack:
        n = stack.pop()
        if n.tag in ("form", "button", "select"):
            return True
        chars, linked = chars + n.chars, linked + n.linked
        stack.extend(p for p in n.parts if isinstance(p, Node))
    return linked > _MOSTLY_LINKS * chars


def _own_points(node: Node) -> float:
    """Points of an element's own text, less by its share of links; call it before :func:`_score`."""
    if node.tag in _HEADINGS:
        return 0.0
    return sum(1 + p.count(",") + p.count("、") + p.count("，") + min(len(p) / 100, 3) for p in node.parts if isinstance(p, str)) * (1 - _density(node))


class _Page:
    """What a page's subtrees hold, to tell a marked wrapper of the article from boilerplate."""

    def __init__(self, root: Node) -> None:
        nodes, stack = [], [root]
        while stack:  # parents first, in page order
            n = stack.pop()
            nodes.append(n)
            stack.extend(p for p in reversed(n.parts) if isinstance(p, Node) and p.tag not in _DROPPED - _WRAPPERS)
        place = {id(n): i for i, n in enumerate(nodes)}
        self.points, self.heading = [_own_points(n) for n in nodes], [n.tag == "h1" for n in nodes]
        self.end = list(range(1, len(nodes) + 1))
        for i in range(len(nodes) - 1, 0, -1):
            up = place[id(nodes[i].parent)]
            self.points[up] += self.points[i]
            self.heading[up] |= self.heading[i]
            self.end[up] = max(self.end[up], self.end[i])
        found = [i for i, n in enumerate(nodes) if n.tag in ("article", "main") and self.points[i] > 0]
        # unmarked articles lead, else any; those of most points first
        self.leads = sorted([i for i in found if not nodes[i].marks & _MARKS] or found, key=lambda i: -self.points[i])
        self.place = place

    def holds_article(self, node: Node) -> bool:
        """Whether an element has the page's best article, or without articles its heading or most of its points."""
        i = self.place.get(id(node))
        if i is None or not self.points[i]:
            return False
        most = None
        for k in self.leads:
            if k < i < self.end[k]:  # the element lies in it
                continue
            if most is not None and self.points[k] < most:
                break
            most = self.points[k]
            if i <= k < self.end[i]:
                return True
        if most is not None:
            return False
        return self.heading[i] and node.tag not in _WRAPPERS or self.points[i] > self.points[0] / 2


def _prune(node: Node) -> None:
    page, stack = None, [(node, False)]
    while stack:
        n, inside = stack.pop()
        inside |= n.tag in ("article", "main")
        kept = []
        for p in n.parts:
            if not isinstance(p, str) and _boilerplate(p, inside):
                if p.tag not in _WRAPPERS and (p.tag in _DROPPED or p.tag == "header" or not p.marks & _MARKS):
                    continue
                page = page or _Page(node)
                if not page.holds_article(p):
                    continue
            kept.append(p)
        n.parts = kept
        stack.extend((p, inside) for p in n.parts if isinstance(p, Node))


def _walk(node: Node) -> list[Node]:
    """All nodes below, parents first."""
    out = [node]
    for n in out:
        out.extend(p for p in n.parts if isinstance(p, Node))
    return out


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _score(root: Node) -> list[Node]:
    nodes = _walk(root)
    for n in reversed(nodes):  # totals of whole subtrees
        if n.parent is not None and n is not root:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    for n in nodes:
        own = [p for p in n.parts if isinstance(p, str)]
        if not own or n.tag in _HEADINGS:
            continue
        points = sum(1 + p.count(",") + p.count("、") + p.count("，") + min(len(p) / 100, 3) for p in own)
        up, share = (n if n.tag not in ("p", "li", "td", "pre", "blockquote", "dd", "dt") else n.parent), 1.0
        level = 0
        while up is not None and level < LEVELS:
            up.points += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level)
            up = up.parent
    for n in nodes:
        n.points *= 1 - _density(n)
    return nodes


def _blocks(node: Node, out: list[str], in_article: bool) -> None:
    """Texts below a node in page order; outside an article without lists of links."""
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        links = sum(1 for p in n.parts if isinstance(p, Node))
        if not in_article and n.tag in ("ul", "ol") and links > 2 and _density(n) > 0.6:
            continue
        stack.extend(reversed(n.parts))


def _with_siblings(best: Node) -> list[Node]:
    """The best container and its siblings that score well, with what has few links between them and headings before them.

    Where no article or main element tells the limits, neighbours of few links
    before and behind belong to it as well, as a lead, a byline or a last word.
    """
    if best.parent is None:
        return [best]
    least = max(3.0, 0.2 * best.points)
    around = [p for p in best.parent.parts if isinstance(p, Node)]
    good = [k for k, p in enumerate(around) if p is best or p.points >= least or p.tag == "p" and p.chars > 80 and _density(p) < 0.25]
    first, last = good[0], good[-1]
    plain = lambda p: _density(p) < _FEW_LINKS
    while first and (around[first - 1].tag in _HEADINGS or best.tag not in ("article", "main") and plain(around[first - 1])):
        first -= 1
    while best.tag not in ("article", "main") and last + 1 < len(around) and plain(around[last + 1]):
        last += 1
    return [p for k, p in enumerate(around) if k in good or first <= k <= last and p.chars and plain(p)]


def main_text(page: str | None) -> str:
    """The article's blocks, each with white space as one space, joined by blank lines."""
    if not page:
        return ""
    root = _tree(page)
    _prune(root)
    nodes = _score(root)
    holders = [n for n in nodes if n.points > 0]
    if not holders:
        return ""
    best = max(holders, key=lambda n: n.points)  # the first of equals, so the outermost
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            best = node
            if node.tag == "article":
                break
        node = node.parent
    out: list[str] = []
    for part in _with_siblings(best):
        _blocks(part, out, best.tag in ("article", "main"))
    return "\n\n".join(out)


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each row, and ``n_chars``, its code points.

    Columns of these names are replaced; ``html`` is read whole and kept.  Null,
    empty and text-free pages have an empty text; each row is treated by itself.
    """
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*names)

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
