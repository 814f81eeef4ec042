"""HTML extraction by composite text density.

Every node of the tree gets its composite text density: characters per tag, adjusted by how much of the text is links and how
that compares with the whole body. A node's density sum is the sum of its children's densities. The subtree with the
greatest sum is the core of the content, and the least density on its path to the body is the threshold.

From the core the content grows up the path while what a parent adds is text as dense as that threshold (or mere headings);
beside the path, whatever reaches the threshold belongs to the content too. Inside it, lists of links whose density lies below the
threshold are left out. Elements that hold no article text by the standard (scripts, navigation, forms ...) never count.
Names in class, id and role are weak evidence: a node so named counts as link text, which takes its density, unless it holds the
page's heading or main element, or nothing but such nodes is left.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import over_column

# Element names of the HTML standard by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption legend summary".split())
NO_TEXT = frozenset(
    "head script style noscript template iframe object svg canvas audio video select option button input textarea datalist form nav footer aside menu "
    "title dialog search noembed noframes math map xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks that are text of their own, whatever lies beside them; other blocks are containers.
TEXTUAL = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
#: An open element that a start tag of the key ends, up to the named limits.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
P_LIMITS = ("article", "section", "div", "td", "th", "li", "blockquote", "body", "button")
#: Elements nest so deep at most, as in browsers; deeper start tags add no level.
DEPTH = 512
#: A list of links has so many at least, and so much of its text in them.
LINKS, LINK_SHARE = 3, 0.6

#: Words in class, id, role or aria-label that speak of boilerplate, if the name holds no others than these and the neutral ones.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar side foot footer siteheader pageheader masthead cookie cookies consent gdpr notice notices popup popups modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion related recommend recommended recommendations share sharing "
    "social widget widgets pagination pager toolbar copyright contentinfo complementary alert skiplink skip hidden".split()
)
NEUTRAL = frozenset(
    "a an and area bar block body bottom box btn button buttons by card col column container content element footer for form google group header holder icons image in inner item items js left "
    "link links list main med middle module more my of on outer page panel post posts right row section site slot small stories story text the this title to top unit user users view wide "
    "wrap wrapper wrapped x xl your".split()
)
_WORDS = re.compile(r"[a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|=)""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """An element. `children` holds nodes and decoded strings in page order. `dropped`: never text; `named`: boilerplate by its name."""

    __slots__ = ("chars", "children", "density", "depth", "dropped", "link_chars", "link_tags", "name", "named", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False, named: bool = False) -> None:
        self.name, self.parent, self.dropped, self.named = name, parent, dropped, named
        self.depth = parent.depth + 1 if parent is not None else 0
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        if parent is not None:
            parent.children.append(self)

    @property
    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and not c.dropped]


def _speaks_of_boilerplate(value: str) -> bool:
    """Whether one of the names is made of boilerplate words (one at least) and neutral ones only."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).split():
        words = _WORDS.findall(name.lower())
        joined = "".join(words)
        if joined in NAMED or any(w in NAMED for w in words) and all(w in NAMED or w in NEUTRAL for w in words):
            return True
    return False


def _evidence(name: str, attributes: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """(no text at all, boilerplate by its name). A header counts as text inside an article or main element."""
    dropped = name in NO_TEXT or name == "header" and not inside
    named = False
    for key, value in attributes.items():
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            dropped = dropped or name not in ("html", "body")
        elif key in ("class", "id", "role", "aria-label") and name not in ("html", "body", "main"):
            named = named or _speaks_of_boilerplate(value)
    return dropped, named


def tree(page: str) -> Node:
    """The element tree of a page. Missing end tags are implied as the HTML standard does; end tags without a start are ignored, and so
    is a tag that the page's end cuts off. Takes time in proportion to the page."""
    root = Node("html", None)
    opened, ignored = Counter(), Counter()
    now, i, size = root, 0, len(page)
    held: list[str] = []

    def text(part: str) -> None:
        held.append(part)

    def flush() -> None:
        if held:
            now.children.append(html.unescape("".join(held)))
            held.clear()

    def up(to: Node) -> Node:
        """Closes everything from `now` to below `to`."""
        at = now
        while at is not to:
            opened[at.name] -= 1
            at = at.parent
        return to

    def close(names: tuple[str, ...], limits: tuple[str, ...]) -> Node:
        if not any(opened[x] for x in names):
            return now
        at = now
        while at.parent is not None and at.name not in limits:
            if at.name in names:
                return up(at.parent)
            at = at.parent
        return now

    while i < size:
        start = page.find("<", i)
        if start < 0:
            text(page[i:])
            break
        if start > i:
            text(page[i:start])
        mark = page[start + 1 : start + 2]
        if mark == "!" or mark == "?":
            flush()
            if page.startswith("<!--", start):
                stop = start + 4 if page.startswith(("<!-->", "<!--->"), start) else page.find("-->", start + 4)
                i = size if stop < 0 else page.index(">", stop) + 1
            else:
                stop = page.find(">", start)
                i = size if stop < 0 else stop + 1
            continue
        end_tag = mark == "/"
        m = _NAME.match(page, start + 1 + end_tag)
        if not m:
            if end_tag and (stop := page.find(">", start)) >= 0:
                i = stop + 1
            else:
                text("<")
                i = start + 1
            continue
        flush()
        name, i, attributes = m[0].lower(), m.end(), {}
        while i < size and page[i] != ">":
            a = _ATTRIBUTE.match(page, i)
            if a is None or a.end() == i:
                i += 1
                continue
            i = a.end()
            if a[1] and not end_tag:
                attributes.setdefault(a[1].lower(), next((g for g in a.groups()[1:] if g is not None), ""))
        if i >= size:
            break  # cut off
        i += 1
        if end_tag:
            if ignored[name]:
                ignored[name] -= 1
            elif opened[name]:
                at = now
                while at.name != name and (name in BLOCK or at.name not in ("td", "th", "table", "article", "body")):
                    at = at.parent
                if at.name == name:  # an inline end tag doesn't end a block above
                    now = up(at.parent)
            continue
        if name in ("html", "body", "head") and (now.name == name or opened[name]):
            continue
        if name == "html":
            continue
        if name in CLOSES_P:
            now = close(("p",), P_LIMITS)
        if name in ENDS:
            now = close(*ENDS[name])
        if now.name == "head" and name in BLOCK:
            now = up(now.parent)
        if name in VOID:
            Node(name, now)
            continue
        if name in RAW:
            Node(name, now, True)
            m = _RAW_END[name].search(page, i)
            stop = page.find(">", m.end()) if m else -1
            i = stop + 1 if stop >= 0 else size
            continue
        if now.depth >= DEPTH:
            ignored[name] += 1
            continue
        now = Node(name, now, *_evidence(name, attributes, opened["article"] + opened["main"] > 0))
        opened[name] += 1
    flush()
    return root


def order(root: Node) -> list[Node]:
    """All nodes that may hold text, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.nodes))
    return out


def weigh(body: Node) -> list[Node]:
    """Sets chars, tags, link chars, link tags, densities and density sums of the body and all below; returns them, parents first.

    With C, T, LC and LT the characters, tags, link characters and link tags of a node, and the body's LC and C for its share of
    links (0 counts as 1 in denominators), the composite text density is C/T times the logarithm of C/LC * T/LT to the base
    ln(C/(C - LC) * LC + share * C + e).
    """
    nodes = order(body)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c) - sum(map(c.count, " \n\t\r"))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.named or node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags if node.named else node.link_tags
        node.link_tags += node.name == "a" or node.named
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.sum = sum(c.density for c in node.nodes)
    return nodes


def composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """The composite text density of a node."""
    if not c:
        return 0.0
    t, plain = max(1, t), max(1, c - lc)
    base = math.log(c * lc / plain + share * c + math.e)
    return c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt))) / max(math.log(base), 1.0)


def _is_link_list(node: Node) -> bool:
    return node.name in BLOCK and node.link_tags >= LINKS and node.link_chars >= LINK_SHARE * node.chars


def _settle_names(body: Node) -> None:
    """Names stop to count where they are set over a main element or first heading, or if all plain text outside headings is so
    named; elsewhere they hold for everything below."""
    nodes = order(body)
    principal: set[int] = set()
    for n in reversed(nodes):
        if n.name in ("main", "h1") or any(id(c) in principal for c in n.nodes):
            principal.add(id(n))
    below = {id(n): n.named and id(n) not in principal for n in nodes}
    linked, plain = set(), 0
    for n in nodes:
        below[id(n)] = below[id(n)] or n is not body and below[id(n.parent)]
        if n.name == "a" or n.name in HEADINGS or n is not body and id(n.parent) in linked:
            linked.add(id(n))
        elif not below[id(n)]:
            plain += sum(len(c.strip()) for c in n.children if isinstance(c, str))
    for n in nodes:
        n.named = below[id(n)] and plain > 0


def content(root: Node) -> tuple[list[Node | str], set[int]]:
    """The top nodes of the content in page order, and the ids of nodes below them that are left out."""
    body = next((n for n in order(root) if n.name == "body"), root)
    _settle_names(body)
    nodes = weigh(body)
    core = max(nodes, key=lambda n: n.sum)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min((n.density for n in path[:-1]), default=body.density)

    dense_chars: dict[int, int] = {}
    heading_chars: dict[int, int] = {}
    for n in reversed(nodes):
        heading_chars[id(n)] = n.chars if n.name in HEADINGS else sum(heading_chars[id(c)] for c in n.nodes)
        dense_chars[id(n)] = 0 if n.named else n.chars if n.density >= threshold else sum(dense_chars[id(c)] for c in n.nodes)

    def dense(n: Node) -> bool:
        """Whether most of the node's text outside headings lies in nodes that reach the threshold."""
        return dense_chars[id(n)] > 0 and 2 * dense_chars[id(n)] >= n.chars - heading_chars[id(n)]

    top = 0
    for k in range(1, len(path) - 1):  # grow: a parent comes in if most of the plain text that it adds is dense, or it adds only headings
        added = [c for c in path[k].nodes if c is not path[k - 1] and not c.named and not _is_link_list(c)]
        plain = sum(c.chars for c in added if c.name not in HEADINGS) + sum(len(c.strip()) for c in path[k].children if isinstance(c, str))
        if 2 * sum(c.chars for c in added if dense(c)) >= plain or path[k].name in ("article", "main"):
            top = k
    left_out: set[int] = set()
    on_path = {id(n) for n in path}
    for n in order(path[top]):
        if id(n) not in on_path and (n.named or _is_link_list(n) and n.density < threshold):
            left_out.add(id(n))
    if path[top] is body:
        # the body itself is the core: containers without dense text are none of it, text beside them is
        for n in body.nodes:
            if n.name in BLOCK and n.name not in TEXTUAL and not dense(n):
                left_out.add(id(n))
        return [body], left_out
    chosen: list[Node | str] = []
    above = {id(n) for n in path[top + 1 :]}
    todo: list[Node | str] = [body]
    while todo:
        n = todo.pop()
        if n is path[top]:
            chosen.append(n)
        elif id(n) in above:
            todo.extend(reversed(n.nodes))
        elif n.name in BLOCK and dense(n) and not _is_link_list(n):
            chosen.append(n)
            left_out.update(id(x) for x in order(n) if x.named or _is_link_list(x) and x.density < threshold)
    return chosen, left_out


def blocks(nodes: list[Node | str], left_out: set[int] = frozenset()) -> list[str]:
    """The texts of blocks in page order, white space turned into single spaces."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        at = todo.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            held.append(at)
        elif at.dropped or id(at) in left_out:
            if at.name in BLOCK:
                flush()
        elif at.name == "br":
            held.append(" ")
        else:
            block = at.name in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(at.children))
    flush()
    return out


def extract_text(page: str | None) -> str:
    """The main text of a page; empty for null, empty or textless pages."""
    return "\n\n".join(blocks(*content(tree(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row. Null html counts as empty; page_id and url may be null or repeat;
    other columns are ignored."""

    def work(values):
        texts = [extract_text(p) for p in values]
        return texts, [len(t) for t in texts]

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return over_column(rows, "html", work, "text string, n_chars long")
