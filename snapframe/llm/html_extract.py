"""Main text of HTML pages by tree scoring.

A lenient parser builds the element tree. Boilerplate elements are dropped by tag or role, and by
class or id if that is wholly a boilerplate name, however much they hold; headings never are, and
what holds every heading and paragraph of the page is the page and no boilerplate, but for comments.
Forms are boilerplate by name. A boilerplate word in a longer name lowers the element's score, and
drops it only if it is mostly links or holds no prose and a short text. Every remaining
paragraph passes points for its length and commas to its ancestors, fewer the further up,
discounted by its share of link text. The container with most points after the same discount is
kept, with those siblings that read like content; inside an article or main element, that element
is the container, and of its siblings other articles may join it. What is kept is kept whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"""[<>"']""")
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption "
    "figure figcaption hr address details summary center fieldset form menu dialog hgroup search".split()
)
DROPPED = frozenset("head nav footer aside script style noscript template svg math iframe object embed applet button select option textarea input menu dialog title canvas audio video search label datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist feed status".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox adslot sponsor sponsored sponsors promo promos promoted promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register paywall sidebar sidebars rail widget widgets "
    "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing sharebar social related recommended recommendations recirc trending popular "
    "comment comments commentlist disqus respond reply replies discussion footer footnav copyright disclaimer masthead topbar toolbar tagcloud skip outbrain taboola".split()
)
# Words that also name content: alone they never make a boilerplate name.
WEAK_WORDS = frozenset("notification alert promotion rail share sharing social related recommended recommendations trending popular respond reply replies discussion copyright register subscription skip banner overlay consent".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
AFFIXES = frozenset("area list section container wrapper wrap box block bar left right top bottom primary secondary links buttons item items inner outer thread posts articles stories body content text form holder unit slot".split())
CONTENT_WORDS = frozenset("content main article post story entry page layout site text body".split())
NEUTRAL_BEFORE = frozenset("has with no without hide".split())
KEPT_TAGS = frozenset("html body main".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"html", "body"}
# An opening tag ends these open elements, unless one of the fences stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
CELLS = ("td", "th", "table")
CLOSES_CELLS = frozenset("table tr td th tbody thead tfoot div section article main body html".split())  # closing tags that end what is open in a cell
ANCESTOR_SHARES = (1.0, 0.5, 1 / 3)
ARTICLE_BONUS = 25.0
SIBLING_SHARE = 0.2
PROSE = HEADINGS | {"p", "pre", "blockquote"}
PARTLY, WHOLLY, COMMENTS = 1, 2, 3
NAMED_SHARES = (1.0, 0.5, 0.25, 0.25)
SMALL = 80


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "length", "linked", "commas", "named", "prose")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.dropped = False
        self.named = 0
        self.points = 0.0
        self.length = self.linked = self.commas = self.prose = 0


def _is_dropped(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if tag in KEPT_TAGS or not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        if m[3]:
            return True
        name, value = m[1].lower(), m[2].strip("\"'")
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _name(tag: str, attrs: str) -> int:
    """How far class and id name boilerplate: not at all, in part of a name, by a whole name, or as comments."""
    if tag == "form":
        return WHOLLY
    if tag in KEPT_TAGS or tag in HEADINGS or not attrs:
        return 0
    found, content = 0, False
    for m in _ATTR.finditer(attrs):
        if m[3] or m[1].lower() not in ("class", "id"):
            continue
        for one in m[2].strip("\"'").split():
            words = [w.lower() for w in _WORDS.findall(one)]
            content |= bool(words) and CONTENT_WORDS.issuperset(words)
            hits = {w for i, w in enumerate(words) if w in DROPPED_WORDS and not (i and words[i - 1] in NEUTRAL_BEFORE)}
            if hits:
                whole = not hits <= WEAK_WORDS and all(w in hits or w in AFFIXES for w in words)
                found = max(found, (COMMENTS if hits & COMMENT_WORDS else WHOLLY) if whole else PARTLY)
    found = min(found, PARTLY) if content else found
    return 0 if tag in PROSE and found == PARTLY else found


class Tags:
    """The tags of a page in order. A tag ends at its first `>` outside quotes; one that meets a `<`
    before that, outside quotes, is text. Every character is looked at a bounded number of times.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def _end(self, at: int) -> int:
        """Place of the `>` that ends a tag whose attributes begin at `at`, or -1."""
        while (m := _STOP.search(self.page, at)) is not None:
            at = m.end()
            if m[0] == ">":
                return m.start()
            if m[0] == "<" or at > self.last[">"]:
                return -1
            if at <= self.last[m[0]]:  # a quote that is never closed is a character like others
                at = self.page.index(m[0], at) + 1
        return -1

    def following(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start and end of the next tag or comment from `at` on, its name ("" for a comment), whether it closes, and attributes."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            if page[at : at + 1] in ("!", "?") and at < self.last[">"]:
                return start, page.index(">", at) + 1, "", False, ""
            if (m := _NAME.match(page, at)) and (end := self._end(m.end())) >= 0:
                return start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
        return None


def parse(page: str) -> Node:
    """Element tree of a page; dropped elements are marked. Never fails on bad markup."""
    root, tags = Node("html", None), Tags(page)
    stack, at, articles, length = [root], 0, 0, len(page)
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of each tag's open elements
    paragraphs = [-1]  # for each open element, where the paragraph stands that a block inside it ends

    def cut(to: int) -> None:
        nonlocal articles
        for n in stack[to:]:
            opened[n.tag].pop()
            articles -= n.tag in ("article", "main")
        del stack[to:], paragraphs[to:]

    def innermost(names) -> int:
        return max((opened[t][-1] for t in names if opened[t]), default=0)

    while at < length:
        found = tags.following(at)
        if found is None:
            stack[-1].children.append(page[at:])
            break
        start, end, tag, closing, attrs = found
        if start > at:
            stack[-1].children.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if opened[tag] and (tag in CLOSES_CELLS or opened[tag][-1] > innermost(CELLS)):
                cut(opened[tag][-1])
            continue
        if tag == "html" and len(stack) == 1:
            continue
        if stack[-1].tag == "head" and tag in BLOCK:
            cut(len(stack) - 1)
        if tag in IMPLIED:
            ends, fences = IMPLIED[tag]
            ends = ends | {"p"} if tag != "body" else ends
            fence = innermost(fences)
            inside = [places[i] for t in ends if (i := bisect_right(places := opened[t], fence)) < len(places)]
            if inside:
                cut(min(inside))
        elif tag in CLOSES_P and paragraphs[-1] >= 0:
            cut(paragraphs[-1])
        node = Node(tag, stack[-1])
        node.dropped = stack[-1].dropped or _is_dropped(tag, attrs, articles > 0)
        node.named = _name(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW and not attrs.rstrip().endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else length
        elif tag not in VOID:
            paragraphs.append(len(stack) if tag == "p" else -1 if tag in ("td", "th", "table", "button") else paragraphs[-1])
            stack.append(node)
            opened[tag].append(len(stack) - 1)
            articles += tag in ("article", "main")
    return root


def _nodes(root: Node) -> list[Node]:
    """Elements that are not dropped, parents first."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if not node.dropped:
            out.append(node)
            waiting += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters, link characters and commas below each element, and the headings and paragraphs there."""
    for node in reversed(nodes):
        node.length = node.linked = node.commas = 0
        node.prose = int(node.tag in PROSE)
        for child in node.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                node.length += len(text)
                node.commas += text.count(",")
            elif not child.dropped:
                node.length += child.length
                node.linked += child.linked
                node.commas += child.commas
                node.prose += child.prose
        if node.tag == "a":
            node.linked = node.length


def _link_share(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _drop_named(nodes: list[Node]) -> bool:
    """Mark measured elements that their names give away as boilerplate; false if there are none."""
    any_dropped = False
    for node in nodes:
        if not node.named or (node.named != COMMENTS and 0 < node.prose == nodes[0].prose):
            continue
        if node.named > PARTLY or _link_share(node) > 0.5 or (node.length < SMALL and not node.prose):
            node.dropped = any_dropped = True
    return any_dropped


def _is_paragraph(node: Node) -> bool:
    if node.tag in PARAGRAPHS:
        return True
    return node.tag in ("div", "section", "article", "main", "body", "html") and any(isinstance(c, str) and c.strip() for c in node.children)


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        if not node.length or not _is_paragraph(node):
            continue
        points = (1 + node.commas + min(node.length / 100, 3)) * (1 - _link_share(node))
        if node.tag not in PARAGRAPHS:  # its own text, and not what its paragraphs have given already
            own = [" ".join(c.split()) for c in node.children if isinstance(c, str)]
            points = (1 + sum(t.count(",") for t in own) + min(sum(map(len, own)) / 100, 3)) * (1 - _link_share(node))
            node.points += points
        above = node.parent
        for share in ANCESTOR_SHARES:
            if above is None:
                break
            above.points += points * share
            above = above.parent


def _is_content(sibling: Node, best: float) -> bool:
    if sibling.dropped or not sibling.length:
        return False
    if sibling.named > PARTLY:
        return False
    if sibling.points * NAMED_SHARES[sibling.named] * (1 - _link_share(sibling)) >= SIBLING_SHARE * best:
        return True
    if sibling.tag in HEADINGS:
        return _link_share(sibling) < 0.5
    return (sibling.tag in PARAGRAPHS or sibling.tag in ("ul", "ol", "table", "figure", "dl")) and _link_share(sibling) < 0.25


def _enclosing(node: Node, tag: str) -> Node | None:
    found = None
    while node is not None:
        if node.tag == tag:
            found = node
        node = node.parent
    return found


def _blocks(tops: list[Node]) -> list[str]:
    """Text of each block in page order; inline elements and line breaks join with what is around."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(held)).split()):
            out.append(text)
        held.clear()

    for top in tops:
        flush()
        waiting: list[Node | str | None] = [top]
        while waiting:
            item = waiting.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                held.append(item)
            elif not item.dropped:
                if item.tag in ("br", "wbr"):
                    held.append(" " if item.tag == "br" else "")
                elif item.tag in BLOCK:
                    flush()
                    waiting.append(None)
                waiting += reversed(item.children)
        flush()
    return out


def extract(page: str | None) -> str:
    """Main text of one page: blocks joined by two line feeds; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    nodes = _nodes(root)
    _measure(nodes)
    if not root.length:
        return ""
    if _drop_named(nodes):
        nodes = _nodes(root)
        _measure(nodes)
    _score(nodes)
    value = lambda n: (n.points + (ARTICLE_BONUS if n.tag in ("article", "main") else 0.0)) * NAMED_SHARES[n.named] * (1 - _link_share(n))
    best = max((n for n in nodes if n.length and n.tag in BLOCK and n.tag not in PARAGRAPHS), key=value, default=root)
    if best.points <= 0 and best.tag not in ("article", "main"):
        best = root
    whole = _enclosing(best, "article") or _enclosing(best, "main")
    if whole is not None:
        top, around = value(whole), whole.parent.children if whole.parent else [whole]
        return "\n\n".join(_blocks([c for c in around if c is whole or (isinstance(c, Node) and c.tag == "article" == whole.tag and _is_content(c, top))]))
    if best.parent is None:
        return "\n\n".join(_blocks([best]))
    top = value(best)
    return "\n\n".join(_blocks([c for c in best.parent.children if isinstance(c, Node) and (c is best or _is_content(c, top))]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p) for p in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null, empty and textless pages give '', and so do pages that are boilerplate by tag, role or name
    throughout (an element with every heading and paragraph of the page is not, unless named as comments). Elements named in part like boilerplate go if more than half of their text is links, or if they
    hold less than SMALL characters and no prose. Text outside any element counts as a paragraph of the
    page. Of equally good containers the first in page order wins. Pages are read one by one and
    whole; repeated rows give equal results, empty input an empty result; extra columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
