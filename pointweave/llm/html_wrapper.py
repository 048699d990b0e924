"""Main text of web pages by wrappers that are inferred for each host.

A wrapper is a union-free regular expression over a host's token streams (element starts and
ends, and texts): a tree whose nodes are elements.  A node's children stand in a sequence of single
elements and repeated groups, each may be optional, and each node holds a text slot.

* Within a page, elements of one kind (tag, class and id words) under one parent fold into a repeated group,
  with whatever stands between them.
* ``merge`` aligns one tree with another: elements of one kind are laid over one another; what one side lacks
  becomes optional; what stands in another order becomes a repeated group.  Of a text slot it keeps the strings that
  all pages agree in (the template) and counts the rest (the data).  Tasks merge their own pages by host before
  anything is shuffled; a host's partial wrappers are merged in groups of ``group_size``, round after round.
* ``decide`` finds the article in a wrapper.  A slot is template if two different pages hold the same strings in it
  and no page holds another (pages that agree in their three longest blocks count as copies, not as different).
  The region is the element whose own and children's slots hold most data outside links, each element's
  share divided by how often a page repeats it; first those inside ``article`` or ``main``.  It reaches up to
  the nearest of these, or as far as parents hold a heading.  Inside it, subtrees without data (but headings) go, as do menus,
  headers, footers, sidebars and forms by their elements, and reader comments: repeated ``article`` elements inside one, and, outside ``article``,
  records.  A record is an element that the alignment has put into a repeated group and whose own slots, lists, tables and quotes
  apart, hold data of two kinds or more, none of them a heading: a name and a reply, say.  Nested lists, callouts and
  list items with paragraphs have one kind and stay.  Subtrees all of links go outside ``article`` only.  A page without the region takes
  the next best that it has.
* A page's text is what its match with the wrapper yields in the region, in page order.

Class and id words decide nothing on a host with two different pages, but for ``comment`` and names that say advert and nothing else; on others, where
there is nothing to align, words for menus, adverts and the like break the tie.

Defined cases: null html is empty and gives an empty text; a page without a host has the
host ''; rows that repeat an id each get a row; copies of a page get equal texts; equal scores go to the element
that comes first; pages of any length and depth are read once, in a time that grows with their length.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.beside import mapped_beside
from pointweave.sources.scratch import Scratch

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "select", "option", "label",
}
#: An element of the first kind ends open ones of the second that are nearer than any of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set())}
ENDS_P = BLOCKS - {"button", "select", "option", "label", "body", "html", "head"}
#: Elements that aren't the article, and names that break the tie where a host has but one page.
APART = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "option", "dialog", "search", "fieldset", "legend", "label"}
APART_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead",
    "cookie", "cookies", "notice", "notices", "alert", "consent", "gdpr", "comment", "comments", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "login", "signup", "subscribe", "newsletter", "popup", "modal",
    "search", "pagination", "pager", "widget", "skip", "contentinfo", "complementary", "hidden", "form", "dialog", "toolbar", "copyright",
}
ADVERT_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsored"}
MAIN = {"article", "main"}
#: Their slots are not a record's own.
NESTED = {"ul", "ol", "dl", "table", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a ``p`` further out is shut off by.
P_SCOPE = {"button", "td", "th", "caption", "table"}


def _names(attributes: str) -> set[str]:
    """Words of class and id without digits, ``role=`` words, and ``hidden``."""
    out: set[str] = set()
    for name, value in NAMED.findall(attributes):
        words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if name.lower() != "hidden" else ["hidden"]
        out |= {f"role={w}" if name.lower() == "role" else w for w in words if w}
    return out


Event = tuple[str, str, int]


def events(page: str) -> Iterator[Event]:
    """A page as (``<``, kind, 0), (``>``, kind, 0) and (``#``, text, characters in links), elements in balance."""
    tags, kinds = [""], [""]
    at_of: dict[str, list[int]] = {}  # where each tag is open
    text: list[str] = []
    links: list[str] = []
    link = False

    def last(names: set[str]) -> int:
        return max((at_of[n][-1] for n in names if at_of.get(n)), default=0)

    def flush() -> Iterator[Event]:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            inside = len(" ".join(html.unescape("".join(links)).split())) if links else 0
            text.clear()
            links.clear()
            if line:
                yield "#", line, min(inside, len(line))

    def close_to(depth: int) -> Iterator[Event]:
        while len(tags) > depth:
            at_of[tags.pop()].pop()
            yield ">", kinds.pop(), 0

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            text.append(piece)
            if link:
                links.append(piece)
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        ending, tag, attributes = m[1] or m[4], tag.lower(), m[3] if m[2] else m[6]
        if tag in RAW:
            if not ending and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br" or tag in VOID and tag != "hr":
            text.append(" ")
            continue
        if tag == "a":
            link = not ending
        if tag not in BLOCKS:
            continue
        yield from flush()
        link = False
        if ending:
            if at_of.get(tag):
                yield from close_to(at_of[tag][-1])
            continue
        inner, limit = CLOSES.get(tag, (set(), P_SCOPE if tag in ENDS_P else set()))
        if tag in ENDS_P:
            inner = inner | {"p"}
        while (depth := last(inner)) > last(limit):
            yield from close_to(depth)
        if tag == "hr":
            continue
        kind = ".".join([tag, *sorted(_names(attributes))])
        at_of.setdefault(tag, []).append(len(tags))
        tags.append(tag)
        kinds.append(kind)
        yield "<", kind, 0
    yield from flush()
    yield from close_to(1)


class Node:
    """An element of a wrapper.

    ``groups`` is the sequence of its children: [kinds, repeated].  ``pages`` and ``count``: pages that have the element, and how
    often.  ``n``, ``chars``, ``links``: pages with text in its slot, and their distinct strings' characters, also those in
    links.  ``same``: hash and length of the strings that all of these pages hold.  ``seen``: two different pages among them.
    """

    __slots__ = ("kind", "kids", "groups", "optional", "pages", "count", "n", "chars", "links", "same", "seen")

    def __init__(self, kind: str):
        self.kind, self.kids, self.groups, self.optional = kind, {}, [], False
        self.pages, self.count, self.n, self.chars, self.links, self.same, self.seen = 1, 1, 0, 0, 0, {}, []


def page_tree(page: str) -> Node:
    """One page as a wrapper of its own."""
    root = Node("")
    node, above, kinds = root, [], []
    closed: set[int] = set()  # elements that have ended once
    longest: list[tuple[int, int]] = []
    texts: list[Node] = []

    def close() -> None:
        """Lays this element's row of children over those of its kind before it."""
        groups = fold(kinds)
        if id(node) not in closed:
            closed.add(id(node))
            node.groups = groups
            return
        node.groups = sequence(node.groups, groups)
        for kind in node.kids.keys() - set(kinds):
            node.kids[kind].optional = True

    for what, value, links in events(page):
        if what == "<":
            kinds.append(value)
            above.append((node, kinds))
            if value in node.kids:
                node.kids[value].count += 1
            else:
                node.kids[value] = Node(value)
                node.kids[value].optional = id(node) in closed
            node, kinds = node.kids[value], []
        elif what == ">":
            close()
            node, kinds = above.pop()
        else:
            h = xxhash.xxh64_intdigest(value) >> 1
            if h not in node.same:
                if not node.same:
                    texts.append(node)
                node.same[h] = len(value)
                node.chars += len(value)
                node.links += links
            if (len(value), h) not in longest:
                longest = sorted([*longest, (len(value), h)])[-3:]
    close()
    page_id = xxhash.xxh64_intdigest(repr(longest)) >> 1
    for node in texts:
        node.n, node.seen = 1, [page_id]
    return root


def fold(kinds: list[str]) -> list[list]:
    """A row of kinds as a sequence in which each occurs once: from the first to the last of one that repeats is one group."""
    end = {k: i for i, k in enumerate(kinds)}
    out, at = [], 0
    while at < len(kinds):
        stop, to = end[kinds[at]], at
        while to <= stop:
            stop = max(stop, end[kinds[to]])
            to += 1
        out.append([list(dict.fromkeys(kinds[at:to])), to - at > 1])
        at = to
    return out


def sequence(a: list[list], b: list[list]) -> list[list]:
    """One sequence that stands for both: common groups in order, those in another order as one repeated group."""
    in_a, in_b = ({k: i for i, (kinds, _) in enumerate(x) for k in kinds} for x in (a, b))
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if j == len(b) or i < len(a) and in_b.keys().isdisjoint(a[i][0]):
            out.append(a[i])
            i += 1
        elif i == len(a) or in_a.keys().isdisjoint(b[j][0]):
            out.append(b[j])
            j += 1
        else:
            # The shortest stretches from here on whose kinds are shared with each other only.
            to_a, to_b, done_a, done_b = i + 1, j + 1, i, j
            while done_a < to_a or done_b < to_b:
                for kinds, _ in a[done_a:to_a]:
                    to_b = max([to_b, *(in_b[k] + 1 for k in kinds if k in in_b)])
                done_a = to_a
                for kinds, _ in b[done_b:to_b]:
                    to_a = max([to_a, *(in_a[k] + 1 for k in kinds if k in in_a)])
                done_b = to_b
            kinds = list(dict.fromkeys(k for x in a[i:to_a] + b[j:to_b] for k in x[0]))
            out.append([kinds, len(kinds) > 1 or a[i][1] or b[j][1]])
            i, j = to_a, to_b
    return out


def merge(a: Node, b: Node) -> Node:
    """The wrapper a, made to stand for b as well."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.optional |= y.optional
        x.pages += y.pages
        x.count += y.count
        if y.n:
            x.same = {h: size for h, size in x.same.items() if h in y.same} if x.n else y.same
            x.seen = sorted({*x.seen, *y.seen})[:2]
            x.n, x.chars, x.links = x.n + y.n, x.chars + y.chars, x.links + y.links
        x.groups = sequence(x.groups, y.groups)
        for kind, kid in x.kids.items():
            if kind not in y.kids:
                kid.optional = True
        for kind, kid in y.kids.items():
            if kind in x.kids:
                todo.append((x.kids[kind], kid))
            else:
                kid.optional = True
                x.kids[kind] = kid
    return a


def packed(root: Node) -> str:
    """A wrapper as text: its nodes in a flat list, parents first, so that depth costs nothing."""
    flat, todo = [], [(root, -1)]
    while todo:
        node, above = todo.pop()
        flat.append([above, node.kind, int(node.optional), node.groups, node.pages, node.count, node.n, node.chars, node.links, list(node.same.items()), node.seen])
        todo += [(kid, len(flat) - 1) for kid in reversed(node.kids.values())]
    return json.dumps(flat, ensure_ascii=False)


def unpacked(text: str) -> Node:
    nodes: list[Node] = []
    for above, kind, optional, *rest in json.loads(text):
        node = Node(kind)
        node.optional = bool(optional)
        node.groups, node.pages, node.count, node.n, node.chars, node.links, same, node.seen = rest
        node.same = dict(map(tuple, same))
        if nodes:
            nodes[above].kids[kind] = node
        nodes.append(node)
    return nodes[0]


def expression(root: Node) -> str:
    """The wrapper as a regular expression over ``<kind>``, ``#`` and ``</kind>``."""
    done: dict[int, str] = {}
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo += [(node, True), *((kid, False) for kid in node.kids.values())]
            continue
        slot = "#*" if node.n else ""
        parts = []
        for kinds, repeated in node.groups:
            if repeated:
                inner = "".join(f"(?:{done[id(node.kids[k])]}{slot})?" for k in kinds) if len(kinds) > 1 else done[id(node.kids[kinds[0]])] + slot
                parts.append(f"(?:{inner})" + ("*" if len(kinds) > 1 or node.kids[kinds[0]].optional else "+"))
            else:
                parts.append(f"(?:{done[id(node.kids[kinds[0]])]}{slot})" + ("?" if node.kids[kinds[0]].optional else ""))
        inside = slot + "".join(parts)
        done[id(node)] = f"<{re.escape(node.kind)}>{inside}</{re.escape(node.kind)}>" if node.kind else inside
    return done[id(root)]


def _preorder(root: Node) -> list[tuple[Node, int]]:
    out, todo = [], [(root, -1)]
    while todo:
        node, above = todo.pop()
        out.append((node, above))
        todo += [(kid, len(out) - 1) for kid in reversed(node.kids.values())]
    return out


def decide(root: Node) -> str:
    """Where the article is: [parent, kind, rank of the region (-1: none), goes (0, 1)] of the wrapper's nodes, as JSON."""
    rows = _preorder(root)
    n = len(rows)
    tag = [x.kind.partition(".")[0] for x, _ in rows]
    names = [set(x.kind.split(".")[1:]) for x, _ in rows]
    lone = not any(len(x.seen) > 1 for x, _ in rows)
    main, apart = [-1] * n, [False] * n  # the nearest article or main element; an article in another is part of it
    for i, (_, up) in enumerate(rows):
        main[i] = main[up] if up >= 0 else -1
        if (tag[i] in MAIN or "role=main" in names[i]) and not (tag[i] == "article" and main[i] >= 0 and tag[main[i]] == "article"):
            main[i] = i
        bare = {w.removeprefix("role=") for w in names[i]}
        apart[i] = up >= 0 and apart[up] or tag[i] in APART and not (tag[i] == "header" and main[i] >= 0) or bool(bare & {"comment", "comments"}) or bool(bare) and bare <= ADVERT_NAMES
        if lone and tag[i] not in ("html", "body", *MAIN, *HEADINGS) and "main" not in bare:
            apart[i] |= bool(bare & APART_NAMES)
    # Data in each slot; the same outside links; and in each subtree.
    data = [x.chars - x.n * sum(x.same.values()) if len(x.seen) > 1 else x.chars for x, _ in rows]
    if not any(d and not out for d, out in zip(data, apart)):  # all pages agree in all: nothing tells the template
        data = [x.chars for x, _ in rows]
    own = [0.0 if apart[i] or not data[i] else data[i] * (1 - x.links / x.chars) for i, (x, _) in enumerate(rows)]
    full, all_chars, all_links, near, titled = data[:], [x.chars for x, _ in rows], [x.links for x, _ in rows], own[:], [False] * n
    for i in range(n - 1, 0, -1):
        up = rows[i][1]
        full[up] += full[i]
        all_chars[up] += all_chars[i]
        all_links[up] += all_links[i]
        near[up] += own[i]
        titled[up] |= tag[i] in HEADINGS and data[i] > 0
    score = [near[i] * x.pages / x.count for i, (x, _) in enumerate(rows)]
    inside = [i for i in range(n) if score[i] > 0 and not apart[i]]
    rank, best = [-1] * n, {}
    for i in sorted(inside, key=lambda i: (main[i] < 0, -score[i], i)):
        region = main[i]
        if region < 0:
            region = i
            while rows[region][1] > 0 and tag[rows[region][1]] not in ("html", "body") and titled[rows[region][1]]:
                region = rows[region][1]
        if region not in best:
            best[region] = i
            rank[region] = len(best) - 1
    spared = [False] * n  # what the best elements lie in
    for i in best.values():
        while i >= 0 and not spared[i]:
            spared[i] = True
            i = rows[i][1]
    # What the alignment has found to repeat, and how many kinds of data its elements hold themselves.
    repeated, slots = [False] * n, [0] * n
    for i, (x, up) in enumerate(rows):
        if up >= 0:
            repeated[i] = any(again and x.kind in kinds for kinds, again in rows[up][0].groups)
    for i in range(n - 1, -1, -1):
        slots[i] += data[i] > 0
        if i and tag[i] not in NESTED:
            slots[rows[i][1]] += slots[i]
    goes = []
    for i, (x, up) in enumerate(rows):
        within = main[up] if up >= 0 else -1
        article = within >= 0 and tag[within] == "article"
        still = all_chars[i] > 0 and not full[i] and tag[i] not in HEADINGS
        linked = not article and tag[i] in ("ul", "ol", "div", "section", "table") and all_chars[i] > 0 and all_links[i] >= 0.9 * all_chars[i]
        record = repeated[i] and x.count > x.pages and not titled[i] and slots[i] > 1 and tag[i] in ({"article"} if article else {"div", "li", "article"})
        goes.append(int(apart[i] or not spared[i] and (still or linked or record)))
    return json.dumps([[up, x.kind, rank[i], goes[i]] for i, (x, up) in enumerate(rows)], ensure_ascii=False)


class Decided:
    """A wrapper's decisions, to match pages with."""

    def __init__(self, text: str):
        rows = json.loads(text)
        self.kids: list[dict[str, int]] = [{} for _ in rows]
        self.rank, self.goes = [r[2] for r in rows], [r[3] for r in rows]
        for i, (up, kind, *_) in enumerate(rows):
            if up >= 0:
                self.kids[up][kind] = i

    def text_of(self, page: str) -> str:
        """The texts in the best region that the page has."""
        found: dict[int, list[str]] = {}
        above, node, out, regions = [], 0, False, [self.rank[0]] if self.rank[0] >= 0 else []
        for r in regions:
            found[r] = []
        for what, value, _ in events(page):
            if what == "<":
                above.append((node, out, len(regions)))
                node = self.kids[node].get(value, -1) if node >= 0 else -1
                out = out or node < 0 or bool(self.goes[node])
                if not out and self.rank[node] >= 0:
                    regions.append(self.rank[node])
                    found.setdefault(self.rank[node], [])
            elif what == ">":
                node, out, n = above.pop()
                del regions[n:]
            elif not out:
                for r in regions:
                    found[r].append(value)
        return "\n".join(found[min(found)]) if found else ""


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(len(names))], names)


def page_wrappers(pages: DataFrame, held_chars: int = 20_000_000) -> DataFrame:
    """``host, wrapper`` from ``host, html``: one for each host and task, or more where a task's wrappers pass that size."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        size = 0
        for b in batches:
            for host, page in zip(b.column(0), b.column(1)):
                host, page = host.as_py(), page.as_py()
                tree = page_tree(page)
                if host in held:
                    merge(held[host], tree)
                else:
                    held[host] = tree
                size += len(page)
                if size > held_chars:  # what is held can't be more than what was read
                    yield _rows([(h, packed(w)) for h, w in held.items()], ["host", "wrapper"])
                    held, size = {}, 0
        yield _rows([(h, packed(w)) for h, w in held.items()], ["host", "wrapper"])

    return pages.select("host", "html").mapInArrow(seen, "host string, wrapper string")


def infer_wrappers(partial: DataFrame, group_size: int = 100) -> DataFrame:
    """``host, wrapper``: one for each host from its partial wrappers, merged in groups until one is left."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[str, int] | None = None
        held: Node | None = None
        for b in batches:
            out = []
            for host, part, text in zip(*(c.to_pylist() for c in b.columns)):
                if (host, part) == key:
                    merge(held, unpacked(text))
                    continue
                if key:
                    out.append((key[0], packed(held)))
                key, held = (host, part), unpacked(text)
            yield _rows(out, ["host", "wrapper"])
        yield _rows([(key[0], packed(held))] if key else [], ["host", "wrapper"])

    tmp, now = Scratch(partial.sparkSession, "wrappers"), partial
    while True:
        sizes = tmp.write(now.groupBy("host").agg(F.count("*").alias("n")), "sizes")
        if sizes.where("n > 1").isEmpty():
            return now
        dealt = now.join(sizes, "host").withColumn("part", F.expr(f"cast(pmod(xxhash64(wrapper), ceil(n / {group_size})) as int)"))
        dealt = dealt.select("host", "part", "wrapper").repartition("host", "part").sortWithinPartitions("host", "part", "wrapper")
        now = tmp.write(dealt.mapInArrow(together, "host string, wrapper string"), "level")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32_000_000, salts: int = 64) -> DataFrame:
    """``page_id, url, text`` of every page.

    Decisions go to the pages by broadcast if they are at most ``broadcast_bytes``; else each host's are dealt under ``salts``
    keys and its pages to one of them, so that no task holds all of a host.
    """
    tmp = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    wrappers = infer_wrappers(tmp.write(page_wrappers(rows), "partial"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(h, decide(unpacked(w))) for h, w in zip(*(c.to_pylist() for c in b.columns))], ["host", "value"])

    chosen = tmp.write(wrappers.mapInArrow(decided, "host string, value string"), "decided")

    def texts(b: pa.RecordBatch, value_of: Callable[[str], object]) -> pa.RecordBatch:
        held, out = {}, []
        for host, page in zip(b.column("host").to_pylist(), b.column("html")):
            if host not in held:
                held[host] = Decided(value_of(host))
            out.append(held[host].text_of(page.as_py()))
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return mapped_beside(rows.select("page_id", "url", "html", "host"), "host", chosen, texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string", broadcast_bytes, salts)
