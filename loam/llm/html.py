"""Main-text extraction by wrapper induction.

The pages of one host and layout are aligned with the layout's reference page
by simple tree matching (the largest order-preserving top-down mapping of two
DOM trees). Text nodes that keep the reference's text on most telling pages are
template; varying slots are content. Template nodes go. Of the varying slots,
those in elements that are no article by their tag or name (menus, footers,
adverts, forms, scripts, comments ...) go too, and where a page marks its
article (``<article>``, else ``<main>``), so do those outside it.

Inside a marked article only an element whose whole name says so (``ad-slot``,
not ``search-methods``) falls by its name, and constant headings, paragraphs
and table cells of its flow stay ("Abstract"); constant text in other
containers falls. Where no article is marked, lists and blocks made of links
alone are menus.

A layout is the set of block containers and their classes. Each that has
``MIN_PAGES`` pages gets a wrapper of its own; pages of rarer ones use that of
the host's most frequent layout.

The counts per (host, layout, node) are sums over all pages, pre-aggregated by
Spark. How much of the reference's text a page lacks tells a copy from a page:
only pages that lack ``LEAST_TENTH`` tenths and half as much as the most
different ``MIN_PAGES`` pages count, so boilerplate longer than the article is
found, and copies and near copies say nothing about what is constant.

Defined cases: null or empty html gives an empty text; a page without url
belongs to the empty host; layouts with fewer than ``MIN_PAGES`` telling pages
have no template; very long pages are aligned exactly in bounded memory (lists
of children by halves, trees of any depth without recursion) and read in slices
of a few megabytes; character references are decoded once; white space inside a
block becomes one space, blocks are joined by one space; repeated rows give
equal texts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import cut_lineage, slices

MIN_PAGES = 5
CONSTANT_SHARE = 0.8
#: A page that lacks fewer tenths of the reference's text than this is a copy.
LEAST_TENTH = 3
#: Child lists longer than this (product) are halved (Hirschberg), so that the
#: alignment stays exact and takes memory for one row.
ALIGN_CELLS = 20_000
#: Elements whose set makes a layout.
CONTAINERS = "div|section|header|footer|main|article|aside|nav|form"

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements that an open one of the same kind ends.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
#: Where an implied end tag must not reach through.
BARRIER = {"article", "main", "section", "div", "table", "ul", "ol", "dl", "body", "aside", "nav", "footer", "header", "form", "blockquote", "td", "th", "li"}
NEVER = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "math", "button", "select", "textarea", "title", "head", "dialog", "menu", "object", "canvas", "input"}
WORDS = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side-bar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|comments?|reply|replies|disqus|share|sharing|social|newsletter|subscri\w*|related|recommend\w*|footer|masthead|"
    r"site-header|page-header|popup|modal|widget|toolbar|pagination|pager|login|signup|search|skip-link"
)
#: A name that holds such a word, and one that holds nothing else.
BOILER = re.compile(rf"(?:^|[^a-z])(?:{WORDS})(?:$|[^a-z])")
WHOLE = re.compile(
    rf"(?:{WORDS})(?:[-_](?:{WORDS}|box|bar|list|links?|form|block|container|wrapper|section|area|buttons?|icons?|unit|slot|posts|articles|stories|top|bottom|left|right|\d+))*"
)
#: How sure it is that an element is no article: never by name, a word of its
#: name, its whole name, its tag or role.
KEEP, HINT, NAMED, SURE = range(4)
#: Elements that a marked article's running text is made of.
FLOW = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figure", "figcaption", "header", "hgroup", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "dl", "dt", "dd"}
#: Elements that are menus if they hold links alone.
LISTS = {"ul", "ol", "dl", "div", "section", "table"}
BOILER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|(<(?![a-zA-Z/!?]))", re.S)
#: A tag whose quotes don't close ends at the next '>'.
LOOSE = re.compile(r"<(/?)([a-zA-Z]?[^\s/>]*)([^>]*)>")
ATTR = re.compile(r"(?i)(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "mark", "kids", "text", "size", "number", "drop", "shape")

    def __init__(self, tag: str, mark: str = "", text: str = ""):
        self.tag, self.mark, self.text = tag, mark, text
        self.kids: list[Node] = []
        self.size, self.number, self.drop, self.shape = 1, 0, KEEP, 0


def _is_boiler(tag: str, attrs: str) -> tuple[str, int]:
    mark, drop = "", SURE if tag in NEVER else KEEP
    if not attrs:
        return mark, drop
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            mark += value + " "
            if BOILER.search(value) and tag not in ("html", "body", "main"):
                drop = max(drop, NAMED if any(WHOLE.fullmatch(w) for w in value.split()) else HINT)
        elif (name == "role" and value in BOILER_ROLE) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            drop = SURE
    return mark, drop


def parse(html: str | None) -> Node:
    """A forgiving DOM: text nodes have the tag '#', '\\n' nodes break lines."""
    root = Node("root")
    stack = [root]
    p_at = [0]  # per open element: place of the open p that no barrier hides, or 0
    opened: dict[str, int] = {}

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:], p_at[i:]

    html = html or ""
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        m = m or LOOSE.match(html, at)
        if m is None:  # an unfinished tag at the end
            break
        at = m.end()
        name = m[2]
        if name is None:
            text = m[4] or m[5]  # null for comments and declarations
            if text:
                kids = stack[-1].kids
                if kids and kids[-1].tag == "#":
                    kids[-1].text += text
                else:
                    kids.append(Node("#", text=text))
            continue
        name = name.lower()
        if m[1]:  # an end tag closes up to its start tag, if there is one
            for i in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                if stack[i].tag == name:
                    close(i)
                    break
                if name in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if name in CLOSES:
            ends = CLOSES[name] | {"p"}
            for i in range(len(stack) - 1, 0, -1) if any(opened.get(tag) for tag in ends) else ():
                tag = stack[i].tag
                if tag in ends:
                    close(i)
                    break
                if tag in BARRIER:
                    break
        elif name not in INLINE and name not in VOID and p_at[-1]:
            close(p_at[-1])
        mark, drop = _is_boiler(name, m[3])
        node = Node(name, mark)
        node.drop = SURE if name in VOID else drop
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            node.drop = SURE
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            p_at.append(len(stack) if name == "p" else 0 if name in BARRIER else p_at[-1])
            opened[name] = opened.get(name, 0) + 1
            stack.append(node)
    order = []
    walk = [root]
    while walk:
        x = walk.pop()
        x.number = len(order)
        order.append(x)
        walk.extend(reversed(x.kids))
    seal(order)
    return root


def seal(order: list[Node]) -> None:
    """Sizes and shapes of nodes that are given parents first; subtrees of one
    shape have the same tags and marks throughout."""
    for x in reversed(order):
        kids = x.kids
        if kids:
            x.size = 1 + sum([k.size for k in kids])
            x.shape = hash((x.tag, x.mark, *[k.shape for k in kids]))
        else:
            x.shape = hash((x.tag, x.mark))


def _same(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.mark == b.mark


def match(a: Node, b: Node, out: dict[int, Node] | None = None) -> int:
    """Simple tree matching of two subtrees: the size of the largest mapping;
    ``out`` gets the partner in ``b`` of every mapped node number of ``a``.
    Subtrees are compared once per pair of shapes."""
    table: dict[tuple[int, int], tuple[int, list]] = {}

    def gain(x: Node, y: Node) -> int:
        if x.shape == y.shape:
            return x.size
        return table[x.shape, y.shape][0] if _same(x, y) else 0

    def missing(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node, bool]]:
        kinds: dict[tuple[str, str], dict[int, Node]] = {}
        for y in ys:
            kinds.setdefault((y.tag, y.mark), {})[y.shape] = y
        shapes = {x.shape: x for x in xs}.values()
        return [(x, y, False) for x in shapes for s, y in kinds.get((x.tag, x.mark), {}).items() if x.shape != s and (x.shape, s) not in table]

    def solve(x: Node, y: Node) -> int:
        todo = [(x, y, False)] if x.shape != y.shape and _same(x, y) else []
        while todo:  # children first
            p, q, ready = todo.pop()
            if (p.shape, q.shape) in table:
                continue
            below = [] if ready else missing(p.kids, q.kids)
            if below:
                todo.append((p, q, True))
                todo += below
            else:
                table[p.shape, q.shape] = align(p.kids, q.kids)
        return gain(x, y)

    def align(xs: list[Node], ys: list[Node]) -> tuple[int, list]:
        m, n = len(xs), len(ys)
        if not m or not n:
            return 1, []
        if m * n > ALIGN_CELLS:
            pairs = align_long(xs, ys)
            return 1 + sum(gain(xs[i], ys[j]) for i, j in pairs), pairs
        rows = [[0] * (n + 1)]
        for p in xs:
            up, row, left = rows[-1], [0], 0
            for j, q in enumerate(ys):
                best = up[j] + (p.size if p.shape == q.shape else gain(p, q) if p.tag == q.tag else 0)
                left = max(best, left, up[j + 1])
                row.append(left)
            rows.append(row)
        pairs, i, j = [], m, n
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return 1 + rows[m][n], pairs

    def align_long(xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
        i0, i1, j0, j1 = 0, len(xs), 0, len(ys)
        pairs = []
        while i0 < i1 and j0 < j1 and xs[i0].shape == ys[j0].shape:  # equal ends always pair up in a largest mapping
            pairs.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and xs[i1 - 1].shape == ys[j1 - 1].shape:
            i1, j1 = i1 - 1, j1 - 1
            pairs.append((i1, j1))
        kinds = {y.shape: y for y in ys}
        code = {s: k for k, s in enumerate(kinds)}
        codes = np.array([code[y.shape] for y in ys])
        gains: dict[int, np.ndarray] = {}

        def gain_row(x: Node) -> np.ndarray:
            got = gains.get(x.shape)
            if got is None:
                got = gains[x.shape] = np.array([gain(x, y) for y in kinds.values()], dtype=np.int64)
            return got

        def last_row(some: list[Node], at: np.ndarray) -> np.ndarray:
            row = np.zeros(len(at) + 1, dtype=np.int64)
            for x in some:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain_row(x)[at]))
            return row

        todo = [(i0, i1, j0, j1)]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            if i0 == i1 or j0 == j1:
                continue
            if i1 - i0 == 1:
                row = gain_row(xs[i0])[codes[j0:j1]]
                j = int(row.argmax())
                if row[j]:
                    pairs.append((i0, j0 + j))
            elif (i1 - i0) * (j1 - j0) <= ALIGN_CELLS:
                pairs += [(i0 + i, j0 + j) for i, j in align(xs[i0:i1], ys[j0:j1])[1]]
            else:
                mid = (i0 + i1) // 2
                ahead = last_row(xs[i0:mid], codes[j0:j1])
                behind = last_row(xs[mid:i1][::-1], codes[j0:j1][::-1])[::-1]
                cut = j0 + int((ahead + behind).argmax())
                todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
        return pairs

    size = solve(a, b)
    if out is not None and size:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            out[x.number] = y
            if x.shape == y.shape:
                todo += zip(x.kids, y.kids)
            else:
                todo += [(x.kids[i], y.kids[j]) for i, j in table[x.shape, y.shape][1]]
    return size


def _texts(node: Node):
    walk = [node]
    while walk:
        x = walk.pop()
        if x.drop:
            continue
        if x.tag == "#":
            if x.text.strip():
                yield x
        else:
            walk.extend(reversed(x.kids))


def regions(root: Node) -> list[Node]:
    """The outermost article (else main) elements; the whole tree if none."""
    for tag in ("article", "main"):
        found, walk = [], [root]
        while walk:
            x = walk.pop()
            if x.drop:
                continue
            if x.tag == tag:
                found.append(x)
            else:
                walk.extend(reversed(x.kids))
        if found:
            return found
    return [root]


def evidence(page: Node, ref: Node) -> tuple[int, list[tuple[int, int]]]:
    """How many tenths of the reference's text the page lacks, and (reference
    text node, 1 if the page has the same text there); nothing for a page that
    lacks none."""
    pairs: dict[int, Node] = {}
    match(ref, page, pairs)
    out, alike, total = [], 0, 0
    for x in _texts(ref):
        y = pairs.get(x.number)
        if y is not None and y.tag == "#":
            same = x.text.split() == y.text.split()
            out.append((x.number, int(same)))
            alike += len(x.text) * same
        total += len(x.text)
    return (10 * (total - alike) // total, out) if alike < total else (0, [])


def menus(root: Node) -> set[int]:
    """Numbers of the lists and blocks that hold three links or more and no
    letter or digit beside them."""
    order, walk = [], [(root, False)]
    while walk:
        x, linked = walk.pop()
        order.append((x, linked))
        linked = linked or x.tag == "a"
        walk += [(k, linked) for k in x.kids]
    links: dict[int, int] = {}
    plain: dict[int, bool] = {}
    for x, linked in reversed(order):  # children first
        links[x.number] = sum(links[k.number] for k in x.kids) + (x.tag == "a")
        plain[x.number] = any(plain[k.number] for k in x.kids) or (x.tag == "#" and not linked and any(c.isalnum() for c in entities.unescape(x.text)))
    return {x.number for x, _ in order if x.tag in LISTS and links[x.number] >= 3 and not plain[x.number]}


def main_text(page: Node, ref: Node | None, template: set[int]) -> str:
    """The page's content: its region's blocks without template nodes."""
    tops = regions(page)
    skip: set[int] = set()
    if template and ref is not None:
        pairs: dict[int, Node] = {}
        match(ref, page, pairs)
        skip = {pairs[i].number for i in template if i in pairs}
    marked = tops[0].tag != "root"
    gone = NAMED if marked else HINT
    listed = set() if marked else menus(page)
    parts: list[str] = []
    for top in tops:
        walk: list[tuple[Node, bool] | None] = [(top, marked)]
        while walk:
            at = walk.pop()
            if at is None:
                parts.append("\n")
                continue
            x, flow = at
            if x.tag == "#":
                if flow or x.number not in skip:
                    parts.append(entities.unescape(x.text))
            elif x.tag == "br":
                parts.append("\n")
            # a page's header goes, an article's own holds its title
            elif x.drop < gone and x.number not in listed and (marked or x.tag != "header"):
                if x.tag not in INLINE:
                    parts.append("\n")
                    walk.append(None)
                flow = flow and (x is top or x.tag in FLOW or x.tag in INLINE)
                walk += [(k, flow) for k in reversed(x.kids)]
    return " ".join("".join(parts).split())


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)), F.lit(""))


def _layout(html) -> F.Column:
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)<({CONTAINERS})\b"), F.lit(1))
    names = F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{CONTAINERS})\b[^>]*?\sclass\s*=\s*[\"']?([^\"'>]*)"), F.lit(1))
    seen = F.array_sort(F.array_distinct(F.transform(F.concat(tags, names), F.lower)))
    return F.xxhash64(F.array_join(F.coalesce(seen, F.array()), "\n"))


def references(pages: DataFrame) -> DataFrame:
    """host, sig, layout, ref: for every (host, set of containers) the layout
    whose wrapper its pages use and the html of that layout's page with the
    smallest id (ties: smallest html). Only narrow rows are grouped."""
    full = pages.where(F.length("html") > 0)
    seen = cut_lineage(full.groupBy("host", "sig").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")))
    most = seen.groupBy("host").agg(F.max_by("sig", F.struct("n", "sig")).alias("most"))
    layouts = seen.join(most, "host").select("host", "sig", F.when(F.col("n") >= MIN_PAGES, F.col("sig")).otherwise(F.col("most")).alias("layout"))
    html = full.join(seen.select("host", "sig", "page_id"), ["host", "sig", "page_id"]).groupBy("host", F.col("sig").alias("layout")).agg(F.min("html").alias("ref"))
    return layouts.join(html, ["host", "layout"]).select("host", "sig", "layout", "ref")


def templates(votes: DataFrame) -> DataFrame:
    """host, layout, template (node numbers) from summed votes (host, layout,
    tenth, node, n, same); node -1 counts the pages."""
    depth = Window.partitionBy("host", "layout").orderBy(F.desc("tenth"))  # ten rows a layout
    most = (
        votes.where("node = -1").withColumn("upto", F.sum("n").over(depth))
        .where(F.col("upto") >= MIN_PAGES).groupBy("host", "layout").agg(F.max("tenth").alias("most"))
    )
    return (
        votes.where("node >= 0").join(most, ["host", "layout"]).where("2 * tenth >= most")
        .groupBy("host", "layout", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
        .where((F.col("n") >= MIN_PAGES) & (F.col("same") >= CONSTANT_SHARE * F.col("n")))
        .groupBy("host", "layout").agg(F.sort_array(F.collect_list("node")).alias("template"))  # at most the nodes of one page
    )


VOTES = "host string, layout long, tenth int, node int, n long, same long"


def _count(batches):
    held, tree = None, None
    for big in batches:
        for b in slices(big, "html"):
            sums: dict[tuple[str, int, int, int], list[int]] = {}
            for host, layout, page, ref in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("host", "layout", "html", "ref")]):
                if not page or ref is None or page == ref:
                    continue
                if ref != held:
                    held, tree = ref, parse(ref)
                tenth, nodes = evidence(parse(page), tree)
                if tenth >= LEAST_TENTH:
                    for node, same in [(-1, 0), *nodes]:
                        s = sums.setdefault((host, layout, tenth, node), [0, 0])
                        s[0] += 1
                        s[1] += same
            cols = list(zip(*[(*key, *s) for key, s in sums.items()])) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "layout", "tenth", "node", "n", "same"])


def _apply(batches):
    held, tree = None, None
    for big in batches:
        for b in slices(big, "html"):
            texts = []
            for page, ref, nodes in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("html", "ref", "template")]):
                if nodes and ref != held:
                    held, tree = ref, parse(ref)
                texts.append(main_text(parse(page), tree if nodes else None, set(nodes or ())))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("page_id")), b.column(b.schema.get_field_index("url")), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html)."""
    base = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"), _layout(F.coalesce("html", F.lit(""))).alias("sig"))
    # One row per (host, set of containers), written, so that its size is known:
    # Spark broadcasts it below its own threshold, and splits a hot host's
    # pages (skew join) beyond.
    refs = cut_lineage(references(base))
    votes = base.join(refs, ["host", "sig"]).select("host", "layout", "html", "ref").mapInArrow(_count, VOTES)
    votes = cut_lineage(votes.groupBy("host", "layout", "tenth", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same")))
    wrappers = cut_lineage(refs.join(templates(votes), ["host", "layout"]).select("host", "sig", "ref", "template"))
    schema = pages.select("page_id", "url").schema.add("text", "string", False)
    return base.join(wrappers, ["host", "sig"], "left").select("page_id", "url", "html", "ref", "template").mapInArrow(_apply, schema)
