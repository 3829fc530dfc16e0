"""Main text of web pages by composite text density.

Each page becomes a tree of nodes. Boilerplate by markup (scripts, styles, navigation, forms, elements whose class, id or
role names such a part: "comments", "left-sidebar", not "has-sidebar" or "search-results") takes no part; a class, id or
role does not count where it would take the article with it (``_settle``). For every node the composite density is characters per tag, adjusted by
links:

    d(x) = C/T * log(C/LC * T/LT) to the base ln(C/(C - LC) * LC + LCb/Cb * C + e)

with C characters, T tags, LC and LT those in links, LCb/Cb the share of links in the body; zero denominators count as 1.
A node's sum adds the densities of its children; the node of the largest sum is the core. The least density on the path
from the core to the body is the threshold. The core grows to its parents; what stands beside it stays, headings and short
sections too, unless it is mostly links and below the threshold. This decides on every page: an article or main element
around the core that holds most of the text only says where growth ends.

A page is one row and its tree one page's size; nothing is shared between pages, so tasks are independent. Every step
takes time in proportion to the page, however deep its tags are nested.

Cases. Null or empty html, and pages without text, give ''. Unclosed and stray tags are taken as browsers do for the
common cases (p, li, td, option close their like). Truncated markup ends with the page. Character references without a
semicolon are decoded where the standard does so. Repeated rows are extracted one by one; extra columns are dropped by
``extract`` unless named in keep.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks_of

# Element names of the HTML standard by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav footer form iframe svg canvas object embed video audio button select option textarea input label menu dialog map".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
P_CLOSERS = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend"}
P_SCOPE = frozenset("html body table td th caption button object".split())
CONTAINERS = ("td", "th", "table", "article", "body")
RAW_END = {tag: re.compile(f"</{tag}[\\s/>]", re.I) for tag in RAW}
CELLS = frozenset("li dt dd tr td th".split())
# Names of parts of a page in class, id and role, by what they are.
MENUS = "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar skip"
HEADERS = "header masthead topbar"
FOOTERS = "footer contentinfo"
SIDEBARS = "sidebar sidebars complementary"
NOTICES = "notice notices cookie cookies consent gdpr alert popup modal overlay banner"
FORMS = "search searchform login signup subscribe subscription newsletter"
ADVERTS = "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion"
COMMENTS = "comment comments commentlist disqus respond replies reply"
LAYOUT = frozenset(" ".join((MENUS, HEADERS, FOOTERS, SIDEBARS, NOTICES, FORMS)).split())
NOISE = LAYOUT | frozenset(f"{ADVERTS} {COMMENTS}".split())
# Words that begin the name of a state ("has-sidebar"), not of a part.
STATES = frozenset("has have with without no not is in on hide show".split())
#: How an element is marked: not, by a name that ends in a word of LAYOUT, by a word of LAYOUT, by an advert's or comment's
#: name, by what it is.
PLAIN, DOUBTFUL, NAMED, FOREIGN, FIRM = range(5)
WORDS = re.compile(r"[a-z0-9]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Node:
    __slots__ = ("tag", "parent", "inside", "items", "noise", "c", "t", "lc", "lt", "density", "sum", "free", "out", "holds")

    def __init__(self, tag: str, parent: Node | None, noise: int = PLAIN):
        self.tag, self.parent, self.items, self.noise = tag, parent, [], noise
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.free = self.out = 0
        self.holds = False
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.sum = 0.0


def _named(name: str, inside: bool) -> int:
    """What one name of a class, id or role says. The last word tells what a thing is: a "left-sidebar" is a sidebar, a
    "content-sidebar-wrap" is not."""
    words = [w for w in WORDS.findall(name) if not w.isdigit()]
    if not words or words[-1] not in NOISE or (len(words) > 1 and words[0] in STATES) or (inside and words[-1] in HEADERS.split()):
        return PLAIN
    return FOREIGN if words[-1] not in LAYOUT else DOUBTFUL if len(words) > 1 else NAMED


def _marked(node: Node, attrs: str) -> int:
    """Whether an element is boilerplate by its name or attributes, and how surely."""
    tag = node.tag
    if tag in DROPPED or (tag in ("header", "aside") and not node.inside):
        return FIRM
    if not attrs or tag in ("html", "body", "article", "main"):
        return PLAIN
    found = PLAIN
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return FIRM
        if name in ("class", "id", "role") and not (name == "role" and value == "banner" and node.inside):
            found = max([found, *(_named(one, node.inside) for one in value.split())])
    return found


def _settle(root: Node) -> None:
    """Take the marks by class, id or role from elements that hold the article: those around an article or main where no
    other stands outside all marked elements (a FOREIGN one must have more text than stands unmarked); those with more
    than half of the text outside links (nine tenths, unless DOUBTFUL); and, where marks would still take more than half of it, all DOUBTFUL ones that are not mostly links."""
    nodes, todo, marked = [], [root], False
    while todo:
        x = todo.pop()
        nodes.append(x)
        marked = marked or x.noise != PLAIN
        todo.extend(i for i in x.items if isinstance(i, Node) and i.noise != FIRM)
    if not marked:
        return
    for x in reversed(nodes):
        for i in x.items:
            if isinstance(i, str):
                n = sum(map(len, i.split()))
                x.c, x.free, x.out = x.c + n, x.free + n, x.out + n
            elif i.noise != FIRM:
                x.c, x.free, x.holds = x.c + i.c, x.free + i.free, x.holds or i.holds or (i.tag in ("article", "main") and i.free > 0)
                if i.noise == PLAIN:
                    x.out += i.out
        if x.tag == "a":
            x.free = x.out = 0
    waiting: list[tuple[int, int, int, bool, Node]] = []
    left: list[Node] = []
    semantic, plain, count = False, 0, 0

    def enter(x: Node, inside: bool) -> None:
        nonlocal semantic, plain, count
        plain += x.out
        todo = [(x, inside)]
        while todo:
            y, within = todo.pop()
            if y.tag in ("article", "main"):
                within = True
                semantic = semantic or y.out > 0
            for i in y.items:
                if isinstance(i, Node) and i.noise != FIRM:
                    if i.noise == PLAIN:
                        todo.append((i, within))
                    else:
                        count += 1
                        heapq.heappush(waiting, (i.noise, -i.free, count, within, i))

    enter(root, False)
    while waiting:
        noise, _, _, inside, x = heapq.heappop(waiting)
        most = 10 * x.free > (5 if noise == DOUBTFUL else 9) * root.free
        around = x.holds and not semantic and (noise != FOREIGN or x.free > plain)
        if around or (most and (inside or not semantic)):
            x.noise = PLAIN
            enter(x, inside)
        else:
            left.append(x)
    if 2 * plain < root.free and not semantic:
        for x in left:
            if x.noise == DOUBTFUL and 2 * x.free > x.c:
                x.noise = PLAIN
    for x in nodes:
        x.c = 0


class _Open:
    """The open elements, and for each name the places of those that have it."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def last(self, names) -> int:
        """Place of the innermost open element with one of a few names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        for node in self.stack[place:]:
            self.places[node.tag].pop()
        del self.stack[place:]


def parse(page: str) -> Node:
    root = Node("#root", None)
    open_, at, n = _Open(root), 0, len(page)

    def text(raw: str) -> None:
        if raw:
            open_.stack[-1].items.append(html.unescape(raw) if "&" in raw else raw)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            place = open_.last((tag,))
            # A stray end tag does not leave its container.
            if place and (tag in BLOCK or tag in CONTAINERS or open_.last(CONTAINERS) < place):
                open_.close(place)
            continue
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3] or ""
        if tag in P_CLOSERS and (place := open_.last(("p",))) > open_.last(P_SCOPE):
            open_.close(place)
        if tag in CLOSES:
            like, scope = CLOSES[tag]
            outer = open_.last(scope)
            inner = [x for x in (open_.last((t,)) for t in like) if x > outer]
            if inner:
                open_.close(max(inner))
        node = Node(tag, open_.stack[-1])
        node.noise = _marked(node, attrs)
        open_.stack[-1].items.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            stop = end.start() if end else n
            node.items.append(page[at:stop])
            close = page.find(">", stop)
            at = n if end is None or close < 0 else close + 1
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            open_.push(node)
    _settle(root)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that take part, parents before children, without recursion."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(i for i in x.items if isinstance(i, Node) and not i.noise)
    return out


def measure(root: Node) -> list[Node]:
    nodes = _order(root)
    for x in reversed(nodes):
        for i in x.items:
            if isinstance(i, str):
                x.c += sum(map(len, i.split()))
            elif not i.noise:
                x.c, x.t, x.lc, x.lt = x.c + i.c, x.t + i.t + 1, x.lc + i.lc, x.lt + i.lt
        if x.tag == "a":
            x.lc, x.lt = x.c, x.t + 1
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.lc / max(body.c, 1)
    for x in nodes:
        if x.c:
            t, lc, lt = max(x.t, 1), max(x.lc, 1), max(x.lt, 1)
            base = math.log(x.c / max(x.c - x.lc, 1) * x.lc + share * x.c + math.e)
            value = x.c / lc * t / lt
            x.density = x.c / t * (math.log(value) / math.log(base) if base > 1 and value > 0 else math.log(max(value, 1e-9)))
    for x in nodes:
        x.sum = sum(i.density for i in x.items if isinstance(i, Node) and not i.noise) or x.density * 0.5
    return nodes


def core(root: Node) -> Node | None:
    """The subtree that holds the article."""
    nodes = measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    able = [x for x in nodes if x.c]
    if not able:
        return None
    top = max(able, key=lambda x: x.sum)
    path, x = [], top
    while x is not None and x is not root:
        path.append(x)
        if x is body:
            break
        x = x.parent
    threshold = min((p.density for p in path), default=0.0)
    # A hint after the densities: growth ends at an article or main that holds most of the text.
    hints = [p for p in path if p.tag in ("article", "main") and 2 * (p.c - p.lc) > body.c - body.lc]
    end = hints[-1] if hints else body
    while top is not end and top.parent is not None and top.parent is not root:
        _leave_out(top.parent, top, threshold)
        top = top.parent
    return top


def _leave_out(parent: Node, inner: Node, threshold: float) -> None:
    """Take from a parent the blocks beside inner that are mostly links and less dense than the threshold. Text and inline
    elements between two blocks count as one block, so that links within a sentence stay in it; cells of a table or list with
one link stay."""
    kept: list = []
    run: list = []

    def end_run() -> None:
        c = sum(sum(map(len, i.split())) if isinstance(i, str) else i.c for i in run)
        lc = sum(i.lc for i in run if isinstance(i, Node))
        t = sum(i.t + 1 for i in run if isinstance(i, Node))
        if inner in run or 2 * lc <= c or c / max(t, 1) * math.log(c / lc) >= threshold:
            kept.extend(run)
        run.clear()

    for i in parent.items:
        if isinstance(i, Node) and i.noise:
            continue
        if isinstance(i, str) or i.tag not in BLOCK:
            run.append(i)
            continue
        end_run()
        if i is inner or 2 * i.lc <= i.c or i.density >= threshold or (i.tag in CELLS and i.lt <= 1):
            kept.append(i)
    end_run()
    parent.items = kept


def blocks(top: Node) -> list[str]:
    """Texts of the blocks under top, in page order, white space made single and trimmed."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        words = " ".join("".join(buffer).split())
        buffer.clear()
        if words:
            out.append(words)

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            buffer.append(x)
        elif x.noise and x is not top:
            continue
        elif x.tag == "br":
            buffer.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    top = core(parse(page))
    return "" if top is None else "\n\n".join(blocks(top))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """keep, text, n_chars (code points of text) for each row of pages."""
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches, column, 4_000_000):
            texts = [main_text(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return pages.select(*keep, column).mapInArrow(run, schema)
