"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks (runs of inline text between block-level tags). A linear classifier on each block's place in
the DOM, link share, size and words gives a cost for either label; these are the capacities from the source (content) and
to the sink (boilerplate). Smoothness edges join neighbours in page order and neighbours among the children of one
container, stronger the closer they are in the DOM and weak over the border of a menu, sidebar or the like. All weights
are on one scale, a few units each, so a block that looks out of place is outvoted by its neighbours: the minimum cut
labels all blocks of a page at once.

A name (class, id) is evidence, not a verdict. It counts less the more of the page's text its element holds around an
article or another well-named element, and for half if it holds a word for content, too.

An article element is the main one only by what it holds: those inside boilerplate (reader comments) and those of little
text beside the largest (teaser cards) are none, and without half of the text that could be content in the others, articles
do not decide for the page. What stands under a heading of reader comments, to its container's end, gains nothing by the
article, or the largest container, that it is in.

The cut is exact. Blocks whose own cost outweighs all their edges are settled first and passed on to their neighbours,
and parts of the graph in which all blocks lean one way are labelled that way (neither changes a minimum); Dinic's
algorithm finds the flow through the rest.

Defined results: null, empty and blockless pages have the empty text; tags that are never closed, cut-off tags and
entities at the end of a page, stray closing tags and unknown elements are tolerated; raw text elements that are not
closed run to the end; pages of any length are read whole; equal pages have equal texts; repeated rows stay; columns of pages
that have the name of a result's column give way to it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import numbered, pick, table, without

# HTML elements by their role.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
UNSEEN = frozenset("head button select option optgroup datalist svg math canvas object audio video map applet label input".split())
#: Which open element a new one closes by itself.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot tr".split())
CLOSE_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption", "title"}
# Names and roles that speak for boilerplate or for content.
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations trending sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus footer foot header masthead topbar toolbar pagination pager tags widget widgets search form paywall toc skip outbrain taboola hidden print copyright disclaimer".split())
GOOD_WORDS = frozenset("article articlebody content post entry main story text body maintext prose".split())
#: A name with one of the first (has-sidebar) tells of another element; the second beside a good word (post-header) hold a title.
ABOUT_WORDS, TITLE_WORDS = frozenset("no has with without".split()), frozenset("header head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form button".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset address".split())
#: First words of what stands at the head or the end of reader comments.
CUES = re.compile(r"(?:\d+\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\b.{0,12}$|(?:leave|post|write) an? (?:reply|comment)\b|(?:reply|antworten|répondre|responder)$", re.I)
#: Weights of the classifier's features, in units of cost (positive: content), and of the smoothness edges. `dense` and
#: `sparse`: of a page without article, the share of a block's container in the text of the largest one, and what it needs.
WEIGHTS = {"bias": -0.5, "in_article": 2.0, "outside": -3.0, "good_name": 1.0, "bad": -6.0, "header": -6.0, "link_share": -4.0, "paragraph": 1.0, "heading": 0.6, "title": 1.2, "item": -0.3, "length": 0.4, "sentence": 0.6, "cue": -3.0, "dense": 3.0, "sparse": -2.2}
NEXT, SIBLING, BORDER, UNIT = 1.5, 1.0, 0.3, 1000
#: Evidence for boilerplate from which on an element's text is none of the page's own; the text of an article by that of the
#: largest one, and of all such articles by all text of the page's own, that they need at least.
FOREIGN, LESSER, MAJOR = 0.5, 0.25, 0.5
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    """An open or closed element: `bad` and `good` are what its tag, names and role say, `size` its text, `main` whether
    it is or holds an article or a well-named element, `plain` its text outside links, `inside` whether it is or is in a
    main article; `at` and `end` are its own and its last descendant's place in page order."""

    __slots__ = ("tag", "parent", "depth", "block", "article", "header", "bad", "good", "hidden", "size", "direct", "main", "plain", "inside", "at", "end")

    def __init__(self, tag: str, parent: "Element | None", attributes: str = ""):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.bad, self.good, self.hidden = _judge(tag, attributes) if parent else (0.0, False, False)
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        # 1: in the header of an article, 2: in another one
        self.header = (1 if self.article else 2) if tag == "header" else parent.header if parent else 0
        self.size = self.direct = self.plain = self.at = self.end = 0
        self.inside = False
        self.main = self.good or tag in ("article", "main")


class Block:
    __slots__ = ("text", "at", "linked")

    def __init__(self, text: str, at: Element, linked: int):
        self.text, self.at, self.linked = text, at, linked


def _judge(tag: str, attributes: str) -> tuple[float, bool, bool]:
    """(weight of evidence for boilerplate, 0 to 1; evidence for content; not shown) of an element."""
    bad, good = float(tag in BAD_TAGS), tag in ("article", "main")
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return 1.0, False, True
        if name == "role" and value.lower() in BAD_ROLES:
            bad = 1.0
        if name in ("role", "itemprop") and value.lower() in ("main", "article", "articlebody"):
            good = True
        if name in ("class", "id") and tag not in ("html", "body"):
            poor = rich = False
            for one in value.split():
                parts = {p.lower() for p in _NAME_PART.findall(one)} | {p.lower() for p in re.split(r"[^a-zA-Z0-9]+", one)}
                if parts & ABOUT_WORDS:
                    continue
                fine = bool(parts & GOOD_WORDS)
                rich |= fine
                poor |= bool(parts & BAD_WORDS - (TITLE_WORDS if fine else frozenset()))
            if poor:
                bad = max(bad, 0.5 if rich and good else 1.0)
            good |= rich and not poor
    return bad, good and bad < 1.0, False


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page in order and its elements, parents first."""
    out: list[Block] = []
    root = Element("", None)
    elements, here = [root], root
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = unseen = skip_to = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, here, linked))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal here, unseen
        open_tags[here.tag] -= 1
        unseen -= here.tag in UNSEEN or here.hidden
        here = here.parent

    def take(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            parts.append(text)
            if open_tags["a"]:
                linked += len(text.strip())

    def pop_to(top: Element) -> None:
        while here is not top:
            pop()

    for m in _TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        take(page[skip_to : m.start()])
        skip_to = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if open_tags[tag] > 0:
                e, crosses = here, False
                while e.tag != tag:
                    crosses |= e.tag in BLOCK
                    e = e.parent
                if crosses:
                    flush()
                pop_to(e.parent)
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSE_P:
            while open_tags["p"] > 0:
                pop()
        if any(open_tags[c] > 0 for c in CLOSES.get(tag, ())):
            e = here
            while e.parent and e.tag not in CLOSES[tag] and e.tag not in ("ul", "ol", "table", "dl", "select"):
                e = e.parent
            if e.tag in CLOSES[tag]:
                pop_to(e.parent)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, m.end())
            skip_to = end.end() if end else len(page)
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        here = Element(tag, here, m[3])
        elements.append(here)
        open_tags[tag] += 1
        unseen += tag in UNSEEN or here.hidden
    if skip_to < len(page):
        rest = page[skip_to:]
        cut = re.search(r"<(?:[a-zA-Z/!?][^>]*)?\Z", rest)  # a tag cut off at the page's end
        take(rest[: cut.start()] if cut else rest)
    flush()
    return out, elements


def _home(e: Element) -> Element:
    """The container that a block's own element stands in; lists and tables belong to theirs."""
    e = e.block.parent.block if e.block.parent else e
    while e.parent and e.tag in LISTS:
        e = e.parent.block
    return e


def costs_of(blocks: list[Block], elements: list[Element]) -> list[float]:
    """The classifier: above 0 for content. Each element is looked at once, so depth costs nothing."""
    w, root = WEIGHTS, elements[0]
    for b in blocks:
        b.at.size += len(b.text)
        b.at.plain += len(b.text) - b.linked
        _home(b.at).direct += len(b.text) - b.linked
    for i, e in enumerate(elements):
        e.at = e.end = i
    for e in reversed(elements[1:]):
        e.parent.size += e.size
        e.parent.plain += e.plain
        e.parent.end = max(e.parent.end, e.end)
        e.parent.main |= e.main and e.size > 0
    outer = root.main  # some element, anywhere, that may be the main one
    largest = max((e.direct for e in elements), default=0) or 1
    for e in elements[1:]:
        if e.bad:
            share = e.size / max(root.size, 1)
            if e.main and e.tag not in ("article", "main"):
                e.bad *= max(0.1, 1 - 1.6 * share)
            elif not outer:
                e.bad *= max(0.1, 1 - 1.2 * share)
        e.bad, e.good = max(e.bad, e.parent.bad), e.good or e.parent.good
    articles = _main_articles(blocks, elements)
    under = _under_cues(blocks)
    out = []
    for b, below in zip(blocks, under):
        e, tag, size = b.at, b.at.block.tag, len(b.text)
        cost = w["bias"] + w["bad"] * e.bad + w["good_name"] * (e.good and not e.article)
        if articles:
            cost += w["in_article"] if e.inside and not below else w["outside"]
        else:
            share = _home(e).direct / largest
            cost += w["sparse"] + w["dense"] * (0.0 if below and share == 1.0 else share)
        if e.header and not (e.header == 1 and tag in ("h1", "h2", "h3")):
            cost += w["header"]
        cost += w["link_share"] * min(1.0, b.linked / size) + w["cue"] * bool(CUES.match(b.text))
        cost += w["paragraph"] * (tag in ("p", "pre", "blockquote")) + w["heading"] * (tag in HEADINGS) + w["title"] * (tag == "h1") + w["item"] * (tag == "li")
        out.append(cost + w["length"] * min(4.0, math.log2(1 + size / 40)) + w["sentence"] * (b.text[-1] in ".!?:”\"'…"))
    return out


def _main_articles(blocks: list[Block], elements: list[Element]) -> bool:
    """Whether articles decide for the page; marks what is inside the main ones."""
    tops = [e for e in elements[1:] if e.tag in ("article", "main") and not e.parent.article and e.plain and e.bad < FOREIGN]
    most = max((e.plain for e in tops), default=0)
    for e in tops:
        e.inside = e.plain >= LESSER * most
    for e in elements[1:]:
        e.inside |= e.parent.inside
    own = [(len(b.text) - b.linked, b.at.inside) for b in blocks if b.at.bad < FOREIGN and b.at.header != 2]
    return bool(tops) and sum(n for n, inside in own if inside) >= MAJOR * sum(n for n, _ in own)


def _under_cues(blocks: list[Block]) -> list[bool]:
    """Whether a block is a heading of reader comments, or follows one in its container before a heading as high of another kind."""
    out, top, level = [], None, ""
    for b in blocks:
        tag = b.at.block.tag
        if top is not None and (not top.at <= b.at.at <= top.end or (tag in HEADINGS and tag <= level and not CUES.match(b.text))):
            top = None
        if tag in HEADINGS and top is None and CUES.match(b.text):
            top, level = _home(b.at), tag
        out.append(top is not None)
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: next in page order, weaker with the DOM steps between; next among one container's blocks."""
    out, last_in = [], {}
    for i, b in enumerate(blocks):
        one = b.at.block
        if i:
            x, y, steps, border = one, blocks[i - 1].at.block, 0, False
            while x is not y:  # over a page, no step is taken more than twice
                if x.depth < y.depth:
                    x, y = y, x
                steps, border = steps + 1, border or x.bad > (x.parent.bad if x.parent else 0.0)
                x = x.parent.block
            out.append((i - 1, i, NEXT / max(1, steps - 1) * (BORDER if border else 1.0)))
        parent = one.parent.block if one.parent else one
        if id(parent) in last_in:
            j = last_in[id(parent)]
            border = any(e.bad > parent.bad for e in (one, blocks[j].at.block) if e is not parent)
            out.append((j, i, SIBLING * (BORDER if border else 1.0)))
        last_in[id(parent)] = i
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise sum |cost| of labels against the cost's sign + sum of cut edges."""
    unary = [round(c * UNIT) for c in costs]
    near: list[dict[int, int]] = [{} for _ in costs]
    for i, j, c in edges:
        c = round(c * UNIT)
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * len(costs)
    queue = deque(range(len(costs)))
    while queue:  # settle what outweighs its edges
        i = queue.popleft()
        if label[i] is None and abs(unary[i]) >= sum(near[i].values()):
            label[i] = unary[i] > 0
            for j, c in near[i].items():
                unary[j] += c if label[i] else -c
                del near[j][i]
                queue.append(j)
            near[i] = {}
    for start in range(len(costs)):
        if label[start] is not None:
            continue
        part, seen = [start], {start}
        for i in part:
            fresh = [j for j in near[i] if j not in seen]
            seen.update(fresh)
            part += fresh
        leans = {unary[i] > 0 for i in part}
        sides = [leans.pop()] * len(part) if len(leans) == 1 else _source_side(part, unary, near)
        for i, side in zip(part, sides):
            label[i] = side
    return [bool(x) for x in label]


def _source_side(nodes: list[int], unary: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Dinic's maximum flow on the nodes left; which of them the source still reaches."""
    at = {i: k + 2 for k, i in enumerate(nodes)}
    cap: list[dict[int, int]] = [{} for _ in range(len(nodes) + 2)]
    for i, k in at.items():
        if unary[i] > 0:
            cap[0][k], cap[k][0] = unary[i], 0
        elif unary[i] < 0:
            cap[k][1], cap[1][k] = -unary[i], 0
        for j, c in near[i].items():
            cap[k][at[j]] = c
    while True:
        level = {0: 0}
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for w, c in cap[v].items():
                if c > 0 and w not in level:
                    level[w] = level[v] + 1
                    queue.append(w)
        if 1 not in level:
            return [at[i] in level for i in nodes]
        todo = [iter(list(c)) for c in cap]
        path = [0]
        while path:
            v = path[-1]
            if v == 1:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0) + flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] == 0)
                del path[cut + 1 :]
                continue
            step = next((w for w in todo[v] if cap[v][w] > 0 and level.get(w) == level[v] + 1), None)
            if step is None:
                path.pop()
            else:
                path.append(step)


def extract(page: str | None, smoothness: float = 1.0) -> str:
    """The main text: the content blocks joined by an empty line. Edges are taken `smoothness` times."""
    if not page:
        return ""
    blocks, elements = blocks_of(page)
    if not blocks:
        return ""
    costs = costs_of(blocks, elements)
    keep = minimum_cut(costs, [(i, j, c * smoothness) for i, j, c in edges_of(blocks)])
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame, html_col: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The columns of pages without the html, and the text and its length in code points."""
    kept = without(pages.columns, html_col, text, n_chars)
    width = len(kept)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [extract(p) for p in part.column(width).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, text, n_chars])

    schema = pages.select(*pick(kept)).schema.add(text, "string").add(n_chars, "long")
    return numbered(pages, kept, F.col(html_col)).mapInArrow(kernel, schema)


def op1_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
