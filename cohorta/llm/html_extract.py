"""Main text of web pages by wrapper induction.

Pages of a host are grouped by template, told by the names of its block elements. Of each group with at
least ``LEAST`` different bodies, a few pages (``SAMPLE``, by a hash, equal bodies counted once) are
aligned by simple tree matching (Yang, 1991); pages of smaller groups take the wrapper of a sample of
the whole host. Blocks that carry the same text in all aligned pages are template, inside of the article as
well as outside; the node that holds nearly all of the varying text is the content slot. A wrapper is
the path of that slot and the template's texts. It is then applied to every page of its
group: the slot is looked up by its path, where siblings of one name are aligned in order with the
wrapper's by what they hold, all siblings that share a slot's class are slots, and their blocks are read in
page order without the template's. Trees are walked without recursion and aligned whole, however deep or wide:
equal subtrees are compared once, and long lists by halves, in memory of their length.

Inside and outside of the slot, elements that are never article text are left out: scripts, styles,
forms, menus, headers and footers of the page, sidebars, and elements whose class, id or role names an
advert, notice, comment section and the like. Pages without a wrapper (few pages on the host, or the
slot is missing) fall back to their ``main`` element or outermost ``article`` elements, else to what holds
most text: the innermost block with ``MOST_SHARE`` of the text outside of links.

Edge cases: null html gives an empty text; markup that is cut off is read as far as it goes; a page of
plain text is its own article; elements may be nested to any depth; rows that repeat are read one by one,
and their bodies count once for a wrapper; an empty table gives no rows; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, maybe_broadcast
from .urlfilter import host

SAMPLE, LEAST = 6, 3
#: Share of the varying text that a slot's child must hold to become the slot itself.
SLOT_SHARE = 0.85
#: Share of the text outside of links that a child must hold to stand for a page without wrapper.
MOST_SHARE = 0.7
#: Cells of an alignment that are held at once; beyond it the longer list is halved first.
CELLS = 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|/|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes svg canvas audio video".split())
NEVER = frozenset("head title nav footer aside form button select option fieldset dialog menu menuitem".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table tr pre blockquote".split())
_SAME = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words of class, id or role that mark what is no article text.
NOISE = re.compile(
    r"^(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    r"topbar|toolbar|comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|pagination|pager|search|skip|complementary|contentinfo|dialog|form)$",
    re.I,
)


class Node:
    __slots__ = ("children", "name", "noise", "parent", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        words = [w for m in _NAMES.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").split()] if "=" in attrs else []
        self.name = ".".join([tag, *sorted(words)[:3]])
        # names such as side-bar, comment_list or adSlot are read by their parts
        parts = [p for w in words for p in (w, *re.split(r"[-_]|(?<=[a-z])(?=[A-Z])", w))]
        self.noise = tag in NEVER or any(NOISE.match(p) for p in parts) or (bool(attrs) and _HIDDEN.search(attrs) is not None)


def parse(text: str) -> Node:
    """A tree of nodes; children are nodes or strings, whose character references are decoded."""
    root = at = Node("#root", "", None)
    last = 0
    opened: Counter[str] = Counter()

    def close(x: Node) -> Node:
        """The parent of ``x``, which is closed with all that is open in it."""
        y = at
        while y is not x.parent:
            opened[y.tag] -= 1
            y = y.parent
        return y

    for m in _TOKEN.finditer(text):
        if m.start() < last:
            continue
        if m.start() > last:
            at.children.append(html.unescape(text[last : m.start()]))
        last = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag] > 0:
                x = at
                while x.tag != tag:
                    x = x.parent
                at = close(x)
            elif tag in ("p", "br"):
                at.children.append("\n")
            continue
        stops = ("p", "button", "table", "td") if tag in CLOSES_P and opened["p"] > 0 else (tag, *_SAME[tag]) if tag in _SAME and opened[tag] > 0 else ()
        if stops:
            x = at
            while x is not root and x.tag not in stops:
                x = x.parent
            if x.tag == stops[0]:
                at = close(x)
        attrs = m[3] or m[6] or ""
        node = Node(tag, attrs, at)
        at.children.append(node)
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(text, last)
            last = end.end() if end else len(text)
        elif tag not in VOID:
            at = node
            opened[tag] += 1
    if last < len(text):
        at.children.append(html.unescape(text[last:]))
    return root


def _article(node: Node) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def dropped(node: Node) -> bool:
    return node.noise or node.tag == "header" and not _article(node)


def pieces(node: Node, constant: dict[str, set[str]] | None = None) -> list[str]:
    """Text below a node with breaks at blocks; blocks of the template's texts (``constant``, by name) are left out."""
    out: list[str] = []
    stack = node.children[::-1]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif not dropped(c) and not (constant and c.name in constant and c.tag not in INLINE and joined(pieces(c)) in constant[c.name]):
            if c.tag not in INLINE:
                out.append("\n")
                stack.append("\n")
            stack += c.children[::-1]
    return out


def joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def shape(node: Node, constant: dict[str, set[str]]) -> list:
    """What a node is told by among siblings of its name: the names below it, and its text if that is the template's."""
    text = joined(pieces(node)) if node.name in constant else None
    return [sorted({c.name for c in elements(node)}), text if text is not None and text in constant[node.name] else None]


def path_of(node: Node, constant: dict[str, set[str]]) -> list:
    """Name, place among the siblings of that name, and their shapes, from the root down."""
    steps = []
    while node.parent is not None:
        same = [c for c in elements(node.parent) if c.name == node.name]
        steps.append([node.name, next(k for k, c in enumerate(same) if c is node), [shape(c, constant) for c in same]])
        node = node.parent
    return steps[::-1]


def _likeness(known: list, node: Node, told: list) -> float:
    if known[1] is not None:
        return 3.0 if told[1] == known[1] else 0.2
    if told[1] is not None:
        return 0.1
    a, b = set(known[0]), set(told[0])
    return 1 + (len(a & b) / len(a | b) if a | b else 1)


def find(root: Node, path: list, constant: dict[str, set[str]]) -> list[Node]:
    """The nodes at ``path``: at each step, siblings of the name are aligned in order with those of the wrapper; in the last, all that share a class."""
    at = root
    for step, (name, place, known) in enumerate(path):
        same = [c for c in elements(at) if c.name == name]
        if step == len(path) - 1 and "." in name:
            return same
        if len(same) == 1 and len(known) == 1:
            at = same[0]
            continue
        told = [shape(c, constant) for c in same]
        rows = [np.array([_likeness(k, c, t) for c, t in zip(same, told)]) for k in known]
        at = next((same[j] for i, j in align(rows.__getitem__, len(known), len(same)) if i == place), None)
        if at is None:
            return []
    return [at]


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def below(node: Node) -> list[Node]:
    """A node and all below it, each after those that it holds."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += elements(x)
    return out[::-1]


def _next(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The row after ``row`` of the table of best order-preserving matchings."""
    return np.concatenate(([0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights)))) if len(weights) else row


def align(weights, n: int, k: int, first: int = 0, at: int = 0) -> list[tuple[int, int]]:
    """The heaviest order-preserving matching of n rows from ``first`` and k columns from ``at``; ``weights(i)`` is a row of weights."""
    if not n or not k:
        return []
    if n > 1 and n * k > CELLS:
        half = n // 2
        ahead = np.zeros(k + 1)
        for i in range(first, first + half):
            ahead = _next(ahead, weights(i)[at : at + k])
        back = np.zeros(k + 1)
        for i in range(first + n - 1, first + half - 1, -1):
            back = _next(back, weights(i)[at : at + k][::-1])
        cut = int(np.argmax(ahead + back[::-1]))
        return align(weights, half, cut, first, at) + align(weights, n - half, k - cut, first + half, at + cut)
    rows = [np.zeros(k + 1)]
    for i in range(first, first + n):
        rows.append(_next(rows[-1], weights(i)[at : at + k]))
    out, i, j = [], n, k
    while i and j:
        w = weights(first + i - 1)[at + j - 1]
        if w and rows[i][j] == rows[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((first + i, at + j))
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


class Matcher:
    """Simple tree matching: the largest order-preserving matching of two trees. Equal subtrees are one kind, and two kinds are compared once."""

    def __init__(self):
        self.kinds: dict[tuple, int] = {}
        self.names: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def kind(self, root: Node) -> dict[int, int]:
        """Kind of each node, by its identity."""
        of: dict[int, int] = {}
        for x in below(root):
            key = (x.name, tuple(of[id(c)] for c in elements(x)))
            if key not in self.kinds:
                self.kinds[key] = len(self.names)
                self.names.append(x.name)
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
            of[id(x)] = self.kinds[key]
        return of

    def _rows(self, x: tuple[int, ...], y: tuple[int, ...]):
        """Rows of weights for the children of two kinds, one for each different child."""
        different, place = np.unique(np.array(y, dtype=np.int64), return_inverse=True)
        rows = {p: np.array([self.value(p, q) for q in different.tolist()], dtype=float)[place] for p in set(x)}
        return lambda i: rows[x[i]]

    def value(self, a: int, b: int) -> int:
        if a == b:
            return self.sizes[a]
        return 0 if self.names[a] != self.names[b] else self.known[a, b]

    def size(self, a: int, b: int) -> int:
        stack = [(a, b)]
        while stack:
            p, q = stack[-1]
            if p == q or self.names[p] != self.names[q] or (p, q) in self.known:
                stack.pop()
                continue
            x, y = self.kids[p], self.kids[q]
            wanted = [(c, d) for c in set(x) for d in set(y) if c != d and self.names[c] == self.names[d] and (c, d) not in self.known]
            if wanted:
                stack += wanted
                continue
            row, weights = np.zeros(len(y) + 1), self._rows(x, y) if x and y else None
            for i in range(len(x) if y else 0):
                row = _next(row, weights(i))
            self.known[p, q] = 1 + int(row[-1])
            stack.pop()
        return self.value(a, b)

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The pairs of the matching."""
        left, right = self.kind(a), self.kind(b)
        if not self.size(left[id(a)], right[id(b)]):
            return []
        out, stack = [], [(a, b)]
        while stack:
            p, q = stack.pop()
            out.append((p, q))
            x, y = elements(p), elements(q)
            for c, d in zip(x, y) if left[id(p)] == right[id(q)] else ():
                stack.append((c, d))
            if left[id(p)] != right[id(q)] and x and y:
                kinds = tuple(left[id(c)] for c in x), tuple(right[id(d)] for d in y)
                stack += [(x[i], y[j]) for i, j in align(self._rows(*kinds), len(x), len(y))]
        return out


def match(a: Node, b: Node) -> int:
    """The size of the largest order-preserving matching of two trees."""
    m = Matcher()
    return m.size(m.kind(a)[id(a)], m.kind(b)[id(b)])


def induce(pages: list[str]) -> dict | None:
    """The wrapper of a host from some of its pages: the content slot's path and the template's texts outside of it."""
    trees, seen = [], set()
    for p in pages:
        t = parse(p)
        if (key := joined(pieces(t))) not in seen:
            seen.add(key)
            trees.append(t)
    if len(trees) < LEAST:
        return None
    first = trees[0]
    own = lambda x: joined([c for c in x.children if isinstance(c, str)])
    texts: dict[int, list[Node]] = {}
    same: dict[int, list[str]] = {}
    nodes: dict[int, Node] = {}
    matcher = Matcher()
    for other in trees[1:]:
        for a, b in matcher.pairs(first, other):
            nodes[id(a)] = a
            same.setdefault(id(a), []).append(own(b))
            texts.setdefault(id(a), []).append(b)
    weights: dict[int, int] = {}
    # text below a node that varies between the pages, or that the others lack
    for x in below(first):
        fixed = len(same.get(id(x), ())) == len(trees) - 1 and set(same[id(x)]) == {own(x)}
        weights[id(x)] = (0 if fixed else len(own(x))) + sum(weights[id(c)] for c in elements(x) if not dropped(c))
    at = first
    while at.tag not in ("article", "main"):
        parts = [c for c in elements(at) if not dropped(c)]
        # a heading beside a part belongs to the text as well
        if any(c.tag in ("h1", "h2", "h3") and weights[id(c)] for c in parts):
            break
        best = max((c for c in parts if c.tag not in INLINE and c.tag not in LEAVES), key=lambda c: weights[id(c)], default=None)
        if best is None or not weights[id(best)] or weights[id(best)] < SLOT_SHARE * weights[id(at)]:
            break
        at = best
    # a block is the template's where all pages have it with the same text; blocks that hold varying text can't be
    constant: dict[str, set[str]] = {}
    for k, a in nodes.items():
        if len(texts[k]) == len(trees) - 1 and not weights[k] and a.tag not in INLINE and not dropped(a) and (text := joined(pieces(a))):
            if all(joined(pieces(b)) == text for b in texts[k]):
                constant.setdefault(a.name, set()).add(text)
    return {"slot": path_of(at, constant), "constant": {k: sorted(v) for k, v in sorted(constant.items())}}


def most_text(root: Node) -> Node:
    """The innermost block that holds ``MOST_SHARE`` of its parent's text outside of links, from the root down."""
    weights: dict[int, int] = {}
    for x in below(root):
        own = len(joined([c for c in x.children if isinstance(c, str)]))
        weights[id(x)] = 0 if x.tag == "a" else own + sum(weights[id(c)] for c in elements(x) if not dropped(c))
    at = root
    while True:
        parts = [c for c in elements(at) if not dropped(c)]
        # a heading beside a part belongs to the text as well
        if any(c.tag in ("h1", "h2", "h3") and weights[id(c)] for c in parts):
            return at
        best = max((c for c in parts if c.tag not in INLINE and c.tag not in LEAVES), key=lambda c: weights[id(c)], default=None)
        if best is None or not weights[id(best)] or weights[id(best)] < MOST_SHARE * weights[id(at)]:
            return at
        at = best


def extract(page: str | None, wrapper: dict | None = None) -> str:
    """The main text of a page, by its host's wrapper where there is one."""
    if not page:
        return ""
    root = parse(page)
    constant = {k: set(v) for k, v in wrapper["constant"].items()} if wrapper else {}
    found = find(root, wrapper["slot"], constant) if wrapper and wrapper["slot"] else []
    if not found:
        todo = deque([root])
        while todo:
            x = todo.popleft()
            if x.tag == "main" and not dropped(x):
                found = [x]
                break
            todo += [c for c in elements(x) if not dropped(c)]
    if not found:
        todo = deque([root])
        while todo:
            x = todo.popleft()
            if x.tag == "article" and not dropped(x):
                found.append(x)
            else:
                todo.extendleft([c for c in elements(x) if not dropped(c)][::-1])
    return joined([y for x in found or [most_text(root)] for y in ["\n", *pieces(x, constant), "\n"]])


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [induce([h or "" for h in x]) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(w) if w else None for w in made], pa.string())], names=["w_host", "wrapper"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        out = []
        for page, w in zip(batch.column(2), batch.column(3).to_pylist()):
            if w and w not in known:
                if len(known) > 10_000:
                    known.clear()
                known[w] = json.loads(w)
            out.append(extract(page.as_py(), known[w] if w else None))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def template(text: Column) -> Column:
    """A number for the names of a page's block elements, digits left out."""
    names = F.regexp_extract_all(text, F.lit(r"""(?i)<((?:body|main|article|section|div|table|header|footer|nav|aside)(?=[\s>])(?:[^>]*?\sclass\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)"""), F.lit(1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(names, lambda x: F.lower(F.concat(F.regexp_extract(x, r"^\w+", 0), F.lit(" "), F.regexp_replace(F.regexp_extract(x, r"(?i)\sclass\s*=\s*(.*)$", 1), "[0-9]", "")))))))


def body(text: Column) -> Column:
    """A number for the text of a page, without scripts, styles and marks."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1", ""), r"<[^>]*>|\s+", " "))


def wrappers(pages: DataFrame) -> DataFrame:
    """(w_host, w_kind, wrapper as JSON) of the templates that have one; null is the kind of the whole host. ``pages`` has page_id, host, kind and html."""
    told = pages.where("host != '' and html is not null").select("host", "kind", F.coalesce("page_id", F.lit(-1)).alias("id"), body(F.col("html")).alias("body"))
    told = materialize(told.groupBy("host", "body").agg(F.min(F.struct("id", "kind")).alias("first")).select("host", "body", "first.id", "first.kind"), "bodies")

    def taken(by: list[str], kind: Column) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.xxhash64("body"), "body")
        return told.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).select("host", kind.alias("w_kind"), "id", "body")

    some = materialize(taken(["host", "kind"], F.col("kind")).union(taken(["host"], F.lit(None).cast("long"))), "taken")
    some = maybe_broadcast(some.withColumnRenamed("host", "w_host"), some.count())
    full = pages.where("html is not null").join(some, (F.col("host") == F.col("w_host")) & (F.coalesce("page_id", F.lit(-1)) == F.col("id")), "inner").where(body(F.col("html")) == F.col("body"))
    # rows that repeat an id and its body are one page
    once = full.groupBy("w_host", "w_kind", "body").agg(F.min("html").alias("html"))
    kept = once.groupBy("w_host", "w_kind").agg(F.collect_list("html").alias("pages")).select(F.to_json(F.struct("w_host", "w_kind")).alias("w"), "pages")
    made = kept.mapInArrow(_wrappers, "w_host string, wrapper string").where("wrapper is not null")
    return made.select(F.from_json("w_host", "w_host string, w_kind long").alias("w"), "wrapper").select("w.*", "wrapper")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: id, url, text and n_chars."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host(F.col("url")))
    p = p.withColumn("kind", template(F.col("html")))
    known = materialize(wrappers(p), "wrappers")
    size = known.agg(F.sum(F.length("wrapper") + F.length("w_host"))).first()[0] or 0
    side = F.broadcast if size <= BROADCAST_BYTES else lambda x: x
    by_kind = known.where("w_kind is not null")
    by_host = known.where("w_kind is null").select(F.col("w_host").alias("a_host"), F.col("wrapper").alias("any"))
    full = p.join(side(by_kind), (F.col("host") == F.col("w_host")) & (F.col("kind") == F.col("w_kind")), "left").join(side(by_host), F.col("host") == F.col("a_host"), "left")
    full = full.select("page_id", "url", "html", F.coalesce("wrapper", "any").alias("wrapper"))
    return full.mapInArrow(_texts, "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})
