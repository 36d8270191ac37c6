"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each gets the characters and tags below it, and the characters
and tags of its links; its composite density is

    C / T * log_b((C / LC') * (T / LT))   with   b = ln(C / NLC * LC + LC_body / C_body * C + e)

(C characters, T tags, LC characters in links, NLC others, LT link tags; LC' is LC or 1). The sum of
an element's children's densities says how much text it holds together. The element with the largest
sum within the body marks the content; the threshold is the least density on the path from it to the
body. From the mark the main subtree grows upwards while the parent reaches the threshold and brings
no more linked than other text. Beside it every subtree is kept that reaches the threshold without
being mostly links, and the headings of its ancestors. Blocks of these subtrees are the text, in the
order of the page, without the elements that are never content.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of the HTML standard, and words that name parts of pages.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SKIP = frozenset("script style noscript template head title svg math canvas object iframe select option button textarea input nav header footer aside menu dialog noembed noframes audio video map datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "li", "dd", "dt"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": set(), "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl html body div article section td th".split())
#: A class or id that is made of such words only; in others (no-sidebar, comments-open) they are about something else.
_WORDS = r"(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|side-?bar|widget|footer|header|masthead|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|comment-list|disqus|respond|replies|related|recommended|pagination|pager|toolbar|skip-link)"
_BOILER = re.compile(rf"{_WORDS}(?:[_-]{_WORDS})*")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INNER = _HEADINGS | frozenset("a span b i em strong p li blockquote pre td tr tbody table ul ol".split())
_NAME = re.compile(r"(/?)([A-Za-z][^\s/<>]*)")
#: What may end a tag, and what starts a quoted value.
_STOP = re.compile(r"[<>]|=\s*[\"']")
_COMMENT_END = re.compile(r"--!?>")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_GAP = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "skip", "named", "paragraph", "chars", "tags", "link_chars", "link_tags", "total", "density")

    def __init__(self, tag: str, parent: Node | None, skip: bool, named: bool = False):
        self.tag, self.parent, self.skip, self.named = tag, parent, skip, named
        # the paragraph that is open here, unless a block lies between
        self.paragraph = self if tag == "p" else parent.paragraph if parent is not None and tag not in _BLOCK else None
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.total = self.density = 0.0


def _named(tag: str, attributes: str) -> bool:
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for m in _NAMED.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        if value in _ROLES or any(_BOILER.fullmatch(x) for x in value.split()):
            return True
    return False


def _hidden(tag: str, attributes: str) -> bool:
    return tag in _SKIP or bool(attributes) and tag not in ("html", "body", "main", "article") and _HIDDEN.search(attributes) is not None


def _settle(root: Node) -> None:
    """Skip forms and elements named as boilerplate, with all below, unless they hold blocks with most of the body's text outside links."""
    nodes = _order(root)
    if not any(x.named for x in nodes):
        return
    plain: dict[Node, int] = {}
    for x in reversed(nodes):
        plain[x] = 0 if x.skip or x.tag == "a" else sum(plain[k] if type(k) is Node else 0 if k.isspace() else len(k) for k in x.kids)
    whole = plain[next((x for x in nodes if x.tag == "body"), root)]
    for x in nodes:
        if x.parent is not None and (x.parent.skip or x.named and not (2 * plain[x] > whole and any(type(k) is Node and k.tag in _BLOCK for k in x.kids))):
            x.skip = True


def _tag_end(page: str, at: int, open_quotes: dict[str, bool]) -> tuple[int, int]:
    """(end of the attributes that start at ``at``, end of the tag): at the next > or before the next < outside quoted values.

    A quote that never closes is an ordinary character. Each character is passed once; a search for
    a closing quote that fails is not repeated.
    """
    n = len(page)
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return n, n
        found = page[m.end() - 1]
        if found == ">":
            return m.start(), m.end()
        if found == "<":
            return m.start(), m.start()
        at = m.end()
        if open_quotes.get(found, True):
            close = page.find(found, at)
            if close < 0:
                open_quotes[found] = False
            else:
                at = close + 1


def parse(page: str) -> Node:
    """The element tree. Unclosed paragraphs, items, cells and inline elements end where the standard ends them;
    stray end tags and a tag that the page's end cuts off are dropped. The time is in proportion to the page."""
    root = Node("#root", None, False)
    now, at, n = root, 0, len(page)
    opened: dict[str, int] = {}
    quotes: dict[str, bool] = {}

    def close(last: Node) -> Node:
        """Ends the open elements up to ``last``."""
        node = now
        while node is not last.parent:
            opened[node.tag] -= 1
            node = node.parent
        return node

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            now.kids.append(page[at:])
            break
        m = _NAME.match(page, lt + 1)
        if m is None and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            end = page.find("<", lt + 1)  # a sign, no tag
            end = n if end < 0 else end
            now.kids.append(page[at:end])
            at = end
            continue
        if lt > at:
            now.kids.append(page[at:lt])
        if m is None:
            if page.startswith("!--", lt + 1):
                end = _COMMENT_END.search(page, lt + 4)
                at = end.end() if end else n
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        stop, at = _tag_end(page, m.end(), quotes)
        if stop == n:
            break
        tag, attributes = m[2].lower(), page[m.end() : stop]
        if m[1]:
            if opened.get(tag):
                node = now
                while node.tag != tag:
                    node = node.parent
                now = close(node)
            continue
        if (tag in _CLOSES_P or tag == "p") and now.paragraph is not None:
            now = close(now.paragraph)
        same = _SAME.get(tag)
        if same is not None and any(opened.get(x) for x in same):
            node, last = now, None
            while node is not root and node.tag not in ("table", "ul", "ol", "dl", "select", "div", "article", "section", "body"):
                if node.tag in same:
                    last = node
                    if tag in ("li", "dt", "dd", "option", "td", "th"):
                        break
                node = node.parent
            if last is not None:
                now = close(last)
        child = Node(tag, now, now.skip or _hidden(tag, attributes), _named(tag, attributes))
        now.kids.append(child)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK and tag not in _RAW and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = n if end is None else page.find(">", end.end()) + 1 or n
            continue
        opened[tag] = opened.get(tag, 0) + 1
        now = child
    _settle(root)
    return root


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if type(k) is Node)
    return out


def measure(nodes: list[Node], body: Node) -> None:
    """Composite densities and sums of all nodes, children before parents."""
    for node in reversed(nodes):
        if node.skip:
            continue
        for k in node.kids:
            if type(k) is str:
                node.chars += len(k) - k.count(" ") if k.isspace() is False else 0
            elif not k.skip:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, max(1, node.link_tags)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        if node.skip or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        plain = max(1, c - lc)
        base = math.log(c / plain * lc + ratio * c + math.e)
        value = max(1.0, c / max(1, lc) * (t / lt))
        node.density = c / t * math.log(value, base) if base > 1 else c / t * math.log(value)
        node.total = sum(k.density for k in node.kids if type(k) is Node)
        own = sum(len(k) for k in node.kids if type(k) is str and not k.isspace())
        node.total += own / (t + 1) if own else 0.0  # text right under an element counts as an unnamed child


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the text, in order; none lies in another."""
    nodes = _order(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    if not body.chars:
        measure(nodes, body)
    within = [x for x in _order(body) if not x.skip and x.chars]
    if not within:
        return [body]
    best = max(within, key=lambda x: x.total)
    path, node = [], best
    while node is not None:
        if node.density > 0:
            path.append(node.density)
        if node is body:
            break
        node = node.parent
    threshold = min(path, default=0.0)
    main = best
    # text right beside an element of running text belongs to it
    while main is not body and main.tag in _INNER:
        main = main.parent
    while main is not body and main.parent is not body:
        up = main.parent
        if up.density < threshold or 2 * (up.link_chars - main.link_chars) > up.chars - main.chars:
            break
        main = up
    above, node = set(), main
    while node is not body:
        node = node.parent
        above.add(node)
    kept, todo = [], [body]
    while todo:
        x = todo.pop()
        if x.skip or not x.chars and x is not body:
            continue
        plain = 2 * x.link_chars <= x.chars
        if x is main or plain and x not in above and (x.density >= threshold or x.tag in _HEADINGS and x.parent in above):
            kept.append(x)
        else:
            todo.extend(k for k in reversed(x.kids) if type(k) is Node)
    return kept


def blocks(node: Node) -> list[str]:
    """Text of the subtree by blocks, white space joined, boilerplate left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _GAP.sub(" ", html_lib.unescape("".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if type(x) is str:
            run.append(x)
        elif type(x) is tuple:
            flush()
        elif x.skip:
            if x.tag in _BLOCK:
                flush()
        elif x.tag in ("br", "wbr"):
            run.append(" " if x.tag == "br" else "")
        else:
            if x.tag in _BLOCK:
                flush()
                todo.append(())
            todo.extend(reversed(x.kids))
    flush()
    return out


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by two line breaks; empty where there is none."""
    if not page or page.isspace():
        return ""
    return "\n\n".join(x for node in main_nodes(parse(page)) for x in blocks(node))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each input row.

    Null, empty and blank pages have an empty text. Repeated rows come back as often as they came;
    null ids and urls stay null; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return source.mapInArrow(run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long")
