"""Main text of web pages by wrapper induction (operator 6).

1. Every page becomes a DOM tree of its containers, repeated siblings (equal tag, role, class and
   id) merged into one node, with text blocks hanging on the nodes. Of siblings that repeat with
   others between them, the first SIBLING_RUNS runs are nodes and later ones share the last. Whether a block is skipped
   or inside an article is judged for its own element, whichever node that shares.
2. The most frequent tree of a host is its reference. Every page is aligned with the reference of
   its host by simple tree matching, which gives its nodes common names. Siblings match only under
   equal labels, so the best order-keeping matching is a heaviest increasing subsequence of the
   equal pairs, found in ``k log k``.
3. A block that stands in the same node on at least TEMPLATE_SHARE of a host's distinct pages (and
   on TEMPLATE_PAGES of them) is constant: it belongs to the template. Pages are distinct by the
   texts of their blocks that step 4 does not skip, so another advert, menu or comment makes no
   new page. Blocks inside ``article`` or ``main`` never belong to the template. The counts cover
   all pages and are aggregated before every shuffle, so one host may hold any share of them.
   A node is a template node, too, where its texts change without being a page's own: on average
   every text stands there on two pages or more (``REUSE``), and it holds less than SMALL_SHARE
   of the distinct text of the host's largest node, so near copies of a story are no template.
   All other nodes are varying slots. Outside articles a template node is no content; of several
   articles on a page, those that lie in template nodes only are not, if another has a slot.
4. Varying slots are content, unless their element, role or class names them as menu, header,
   footer, sidebar, notice, advert, form or comment. A form, or an element with such a word
   among the parts of its names (``site-header``), is content after all where it holds a main,
   more than half of the varying text, or articles with more text than the rest of a page
   without other articles; parts behind a no, has, with or without say nothing. Only elements
   named wholly as advert, comment or related text stay skipped however large. Inside an
   article a whole name must be such a word, and notes and headers are content. ``article``
   elements with text bound the
   content, or ``main`` where it has no such article or more text of its own than any of them.
   Else the content is all that varies below the lowest container of all varying text that is
   not links, without lists of links. So on hosts with too few pages for a template, unnamed
   boilerplate stays.

Character references are decoded, white space in a block becomes one space, and blocks are
joined in page order by one space. Defined results: a null page is the empty page and gives an
empty text; unclosed and stray tags are tolerated; pages of an unknown host (null or odd URL)
share the empty host. Rows are judged one by one, copies of a page count once in step 3; extra
columns have no influence.
"""

from __future__ import annotations

import functools
import html as html_lib
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksmith.llm.common import checkpointed, map_batches, read, short_batches, written
from marksmith.llm.url_filter import host_of

TEMPLATE_SHARE = 0.8
TEMPLATE_PAGES = 3
REUSE = 2
SMALL_SHARE = 0.1
#: So many runs of equal siblings below one parent are nodes of their own.
SIBLING_RUNS = 4
#: So many neighbouring blocks of half or more link text, in one container or list, are a list of
#: links; fewer are part of the text.
LINK_RUN = 3
#: Containers nested deeper than this share the node of their ancestor at this depth.
MAX_DEPTH = 40
#: Host tables up to this many characters of wrappers are broadcast; larger ones are shuffled.
MAX_BROADCAST_CHARS = 32_000_000

CONTAINERS = frozenset("html body div section article main nav header footer aside form dialog "
                       "details fieldset menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead "
                                "tbody tfoot tr td th caption figure figcaption hr address "
                                "summary option select center".split())
RAW = frozenset("script style textarea title noscript template iframe svg object video audio "
                "canvas select button annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("head nav footer aside dialog menu".split())
FORMS = frozenset("form fieldset".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert "
                          "alertdialog menu menubar toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer header masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pagination pager popup promo promotion "
    "related recommended replies reply share sharing sidebar social sponsor sponsored subscribe "
    "toolbar widget gdpr alert signup login overlay".split())
#: Whole names of what is never content, however much text it holds.
FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments disqus promo promotion "
    "related recommended replies reply sponsor sponsored".split())
#: Words that inside an article or main name parts of it.
ARTICLE_WORDS = frozenset("alert banner header masthead notice notices notification overlay".split())
COMMENT_WORDS = frozenset("comment comments reply".split())
#: Parts of a name behind one of these tell what a container has or lacks, not what it is.
STATES = frozenset("has no with without".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)"
                 r"((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PART = re.compile(r"[a-z]+")


CONTENT, DOUBTFUL, FOREIGN = 0, 1, 2


@functools.lru_cache(maxsize=4096)
def _kind(tag: str, names: str, role: str, frame: str) -> int:
    """What tag, names (class and id) and role say of an element inside ``frame``: "article",
    "main" or ""."""
    if tag in SKIPPED_TAGS or role in SKIPPED_ROLES or (tag == "header" and not frame):
        return FOREIGN
    kind = DOUBTFUL if tag in FORMS or role == "form" else CONTENT
    if tag in ("html", "body", "main"):
        return kind
    words = COMMENT_WORDS if tag == "article" else SKIPPED_WORDS
    if frame:
        words = words - ARTICLE_WORDS
    # inside an article, and on a line of text inside a main, a part of a name says too little
    whole = frame == "article" or (frame == "main" and tag not in CONTAINERS)
    for name in names.lower().split():
        parts = NAME_PART.findall(name)
        if len(parts) == 1 and parts[0] in words:
            if parts[0] in FOREIGN_WORDS:
                return FOREIGN
            kind = DOUBTFUL
        elif not whole:
            said = next((i for i, w in enumerate(parts) if w in STATES), len(parts))
            if any(w in words for w in parts[:said]):
                kind = DOUBTFUL
    return kind


@functools.lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


class Page:
    """Containers in page order (``tags``, ``kinds``: what names them or what they lie in,
    ``frames``: whether they are, or lie inside, an article or main that is not FOREIGN), each with
    its node in the tree (``labels``, ``parents``), and text blocks ``(container, text, characters
    inside links)``."""

    def __init__(self, source: str):
        self.labels, self.parents, self.depth = ["#"], [-1], [0]
        self._last: list[int] = [-1]  # newest child of each node
        self._runs: dict[tuple[int, str], list[int]] = {}  # children by label
        self.tags, self.up, self.nodes = ["#"], [-1], [0]
        self.kinds, self.frames = [CONTENT], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._links = 0
        self._parse(source)

    def _flush(self, at: int) -> None:
        if self._text:
            text = "".join(self._text)
            text = " ".join((html_lib.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((at, text, min(self._links, len(text))))
            self._text.clear()
            self._links = 0

    def _node(self, parent: int, tag: str, names: str, role: str) -> int:
        label = tag + ("." + names if names else "") + ("@" + role if role else "")
        last = self._last[parent]
        if last >= 0 and self.labels[last] == label:
            return last  # a repeated sibling
        if self.depth[parent] >= MAX_DEPTH:
            return parent
        runs = self._runs.setdefault((parent, label), [])
        if len(runs) == SIBLING_RUNS:
            self._last[parent] = runs[-1]
            return runs[-1]
        runs.append(len(self.labels))
        self.labels.append(label)
        self.parents.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self._last.append(-1)
        self._last[parent] = len(self.labels) - 1
        return len(self.labels) - 1

    def _open(self, up: int, tag: str, names: str, role: str) -> int:
        frame = self.frames[up]
        kind = FOREIGN if self.kinds[up] == FOREIGN else _kind(tag, names, role, frame)
        self.tags.append(tag)
        self.up.append(up)
        self.nodes.append(self._node(self.nodes[up], tag, ".".join(NAME_PART.findall(
            names.lower())), role))
        self.kinds.append(kind)
        if tag in ("article", "main") and kind != FOREIGN:
            frame = "article" if "article" in (tag, frame) else "main"
        self.frames.append(frame)
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        pos, links, end, pending = 0, 0, len(source), self._text
        find = TAG.search
        while pos < end:
            m = find(source, pos)
            stop = m.start() if m else end
            if stop > pos:
                pending.append(source[pos:stop])
                if links:
                    self._links += stop - pos
            if not m:
                break
            pos = m.end()
            closing, tag, attributes, closing2, tag2, attributes2 = m.groups()
            tag = (tag or tag2 or "").lower()
            if tag in BLOCKS or tag == "head":
                self._flush(stack[-1][1])
                if closing or closing2:
                    self._close(stack, tag)
                elif tag not in VOID:
                    self._enter(stack, tag, attributes or attributes2 or "")
            elif tag == "a":
                links = 0 if closing or closing2 else 1
            elif tag == "br":
                pending.append(" ")
            elif tag in RAW and not (closing or closing2):
                if tag in ("button", "select"):
                    pending.append(" ")
                close = _end_of(tag).search(source, pos)
                if close:
                    pos = close.end()
                elif tag in ("script", "style", "textarea", "title"):
                    pos = end
        self._flush(stack[-1][1])

    @staticmethod
    def _close(stack: list[tuple[str, int]], tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            # a stray end of a paragraph or list does not close a container
            if stack[i][0] in CONTAINERS and tag not in CONTAINERS:
                return

    def _enter(self, stack: list[tuple[str, int]], tag: str, attributes: str) -> None:
        names = role = ""
        if "=" in attributes:
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}".strip()
            role = found.get("role", "").lower()
        if tag == "p":  # an open paragraph ends where the next one starts
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CONTAINERS:
                    break
                if stack[i][0] == "p":
                    del stack[i:]
                    break
        at = stack[-1][1]
        if tag in CONTAINERS or tag == "head" or names or role:
            at = self._open(at, tag, names, role)
        stack.append((tag, at))

    def skips(self, blocks: list[tuple[int, str, int]], forms: bool = True) -> list[bool]:
        """Which containers are skipped, where ``blocks`` are those that vary; ``forms``: whether
        forms are judged, else they are content."""
        size = len(self.tags)
        if DOUBTFUL not in self.kinds:
            return [k == FOREIGN for k in self.kinds]
        # characters that are not links below a container: all, in main, in articles
        below, main, articles = [0] * size, [0] * size, [0] * size
        own = [0] * size
        for at, text, links in blocks:
            if self.kinds[at] != FOREIGN:
                own[at] += len(text) - links
        below[:] = own
        for i in range(size - 1, 0, -1):
            up = self.up[i]
            below[up] += below[i]
            main[up] += below[i] if self.tags[i] == "main" else main[i]
            articles[up] += below[i] if self.tags[i] == "article" else articles[i]

        def skipped(rescued: set[int]) -> list[bool]:
            out: list[bool] = []
            for i, kind in enumerate(self.kinds):
                out.append(kind == FOREIGN or (i > 0 and out[self.up[i]])
                           or (kind == DOUBTFUL and i not in rescued))
            return out

        doubtful = [i for i, k in enumerate(self.kinds) if k == DOUBTFUL]
        rescued = {i for i in doubtful if main[i] or 2 * below[i] > below[0]
                   or (not forms and self.tags[i] in FORMS)}
        out = skipped(rescued)
        if any(n and self.frames[i] and not out[i] for i, n in enumerate(own)):
            return out
        # no article so far: doubtful containers of articles, if those hold more than the rest
        held = {i for i in doubtful if articles[i] or (self.tags[i] == "article" and below[i])}
        again = skipped(rescued | held)
        rest = sum(n for n, skip in zip(own, out, strict=True) if not skip)
        gain = sum(n for i, n in enumerate(own) if self.frames[i] and not again[i])
        return again if gain > rest else out

    def copy(self) -> int:
        """Equal on pages that differ in skipped blocks or markup only. What varies is not known
        yet, so forms count: one may hold a story shorter than the template."""
        skipped = self.skips(self.blocks, forms=False)
        return _hash64("\n".join(t for at, t, _ in self.blocks if not skipped[at]))

    def tree(self) -> str:
        return json.dumps([self.labels, self.parents], separators=(",", ":"))


def _children(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            out[p].append(i)
    return out


def heaviest_chain(pairs: list[tuple[int, int, int]], width: int
                   ) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs of the heaviest subset of ``(i, j, weight)`` that grows in i and in j.
    ``pairs`` come by rising i, then falling j; j is below ``width``."""
    best: list[tuple[int, int]] = [(0, -1)] * (width + 1)  # Fenwick tree: (weight, last pair)
    before: list[int] = []
    for at, (_, j, weight) in enumerate(pairs):
        found, k = (0, -1), j
        while k > 0:
            found = max(found, best[k])
            k -= k & -k
        before.append(found[1])
        reached, k = (found[0] + weight, at), j + 1
        while k <= width:
            if reached[0] > best[k][0]:
                best[k] = reached
            k += k & -k
    top, k = (0, -1), width
    while k > 0:
        top = max(top, best[k])
        k -= k & -k
    chain, at = [], top[1]
    while at >= 0:
        chain.append(pairs[at][:2])
        at = before[at]
    return top[0], chain[::-1]


@functools.lru_cache(maxsize=4096)
def align(page: str, reference: str) -> tuple[int, ...]:
    """Simple tree matching: the reference node of every page node, -1 where it has none."""
    labels, parents = json.loads(page)
    ref_labels, ref_parents = json.loads(reference)
    kids, ref_kids = _children(parents), _children(ref_parents)
    scores: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(a: int, b: int) -> int:
        if labels[a] != ref_labels[b]:
            return 0
        if (a, b) in scores:
            return scores[a, b][0]
        places: dict[str, list[int]] = {}
        for j, y in enumerate(ref_kids[b]):
            places.setdefault(ref_labels[y], []).append(j)
        total, pairs = heaviest_chain([
            (i, j, match(x, ref_kids[b][j])) for i, x in enumerate(kids[a])
            for j in reversed(places.get(labels[x], ()))], len(ref_kids[b]))
        pairs = [(kids[a][i], ref_kids[b][j]) for i, j in pairs]
        scores[a, b] = total + 1, pairs
        return scores[a, b][0]

    out = [-1] * len(labels)
    todo = [(0, 0)] if match(0, 0) else []
    while todo:
        a, b = todo.pop()
        out[a] = b
        todo += scores[a, b][1]
    return tuple(out)


def _hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def block_key(node: int, block: int) -> int:
    """Name of a block (its text's hash) at a reference node."""
    return _hash64(f"{node} {block}")


def content(page: Page, names: tuple[int, ...], template: frozenset[int],
            steady: frozenset[int] = frozenset()) -> str:
    """The page's main text, given its aligned node names, its host's constant blocks and its
    host's template nodes (``steady``)."""
    varying = [(at, text, links) for at, text, links in page.blocks
               if page.kinds[at] != FOREIGN
               and (page.frames[at] or names[page.nodes[at]] < 0
                    or (names[page.nodes[at]] not in steady
                        and block_key(names[page.nodes[at]], _hash64(text)) not in template))]
    skipped = page.skips(varying)
    varying = [b for b in varying if not skipped[b[0]]]
    in_article = _outermost(page, "article", skipped)
    in_main = _outermost(page, "main", skipped)
    # articles of template nodes only are no content beside one that has a varying slot
    slots = {in_article[at] for at, _, _ in varying
             if in_article[at] >= 0 and names[page.nodes[at]] not in steady}
    if slots:
        varying = [b for b in varying if in_article[b[0]] < 0 or in_article[b[0]] in slots]
    main, articles = 0, {-1: 0}
    for at, text, links in varying:
        if in_article[at] >= 0:
            articles[in_article[at]] = articles.get(in_article[at], 0) + len(text) - links
        elif in_main[at] >= 0:
            main += len(text) - links
    bounds = [in_article, in_main]
    for inside in bounds[::-1] if main > max(articles.values()) else bounds:
        found = [text for at, text, _ in varying if inside[at] >= 0]
        if found:
            return " ".join(found)
    varying = _without_link_lists(page, varying)
    below = [0] * len(page.up)
    prose = [at for at, text, links in varying if 2 * links < len(text)]
    for at in prose or [at for at, _, _ in varying]:
        below[at] += 1
    total = sum(below)
    for i in range(len(below) - 1, 0, -1):
        below[page.up[i]] += below[i]
    # containers that hold all of it lie on one path, the lowest comes last
    root = max(i for i, n in enumerate(below) if n == total)
    inside = [False] * len(page.up)
    for i, up in enumerate(page.up):
        inside[i] = i == root or (up >= 0 and inside[up])
    return " ".join(text for at, text, _ in varying if inside[at])


def _outermost(page: Page, tag: str, skipped: list[bool]) -> list[int]:
    """Of every container, the outermost unskipped element ``tag`` that it is or lies in, or -1."""
    out: list[int] = []
    for i, (up, own) in enumerate(zip(page.up, page.tags, strict=True)):
        above = out[up] if up >= 0 else -1
        out.append(above if above >= 0 else i if own == tag and not skipped[i] else -1)
    return out


def _without_link_lists(page: Page, blocks: list[tuple[int, str, int]]
                        ) -> list[tuple[int, str, int]]:
    out: list[tuple[int, str, int]] = []
    run: list[tuple[int, str, int]] = []

    def listed(a: int, b: int) -> bool:
        x, y = page.nodes[a], page.nodes[b]
        return x == y or (page.parents[x] == page.parents[y] and page.tags[a] == page.tags[b]
                          and page.tags[a] not in CONTAINERS)

    for block in [*blocks, None]:
        linked = block is not None and 2 * block[2] >= len(block[1])
        if run and not (linked and listed(run[-1][0], block[0])):
            out += run if len(run) < LINK_RUN else []
            run = []
        if linked:
            run.append(block)
        elif block is not None:
            out.append(block)
    return out


def _with_hosts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_h")).withColumn(
        "host", host_of(F.col("url")))


def _lookup(pages: DataFrame, hosts: DataFrame, chars: str, keys: list[str]) -> DataFrame:
    """Join pages with a table of one row per key, by broadcast after a check of its size."""
    size = hosts.agg(F.sum(F.length(chars) + 64)).first()[0] or 0
    return pages.join(F.broadcast(hosts) if size <= MAX_BROADCAST_CHARS else hosts, keys, "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, reference, constant, steady)``: reference tree, keys of the template's blocks and
    the reference nodes that are no varying slots."""
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("host", "copy", "tree_id", "tree", "nodes",
                                                "blocks", "sizes", "framed")}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("_h").to_pylist(),
                                strict=True):
            page = Page(source)
            tree = page.tree()
            found = sorted({(page.nodes[at], _hash64(t), len(t), bool(page.frames[at]))
                            for at, t, _ in page.blocks if page.kinds[at] != FOREIGN})
            out["host"].append(host)
            out["copy"].append(page.copy())
            out["tree_id"].append(_hash64(tree))
            out["tree"].append(tree)
            for i, c in enumerate(("nodes", "blocks", "sizes", "framed")):
                out[c].append([f[i] for f in found])
        return out

    placed = map_batches(pages.select("host", "_h"), run, "host string, copy long, tree_id long, tree string, "
                         "nodes array<int>, blocks array<long>, sizes array<int>, framed array<boolean>")
    # copies of a page count once
    distinct = written(placed.groupBy("host", "copy").agg(
        F.min(F.struct("tree_id", "tree", "nodes", "blocks", "sizes", "framed")).alias("page"))
        .select("host", "page.*"), "pages")
    counted = (distinct.select("host", "tree_id", F.explode(F.arrays_zip(
        "nodes", "blocks", "sizes", "framed")).alias("at"))
        .groupBy("host", "tree_id", F.col("at.nodes").alias("node"), F.col("at.blocks").alias("block"),
                 F.col("at.sizes").alias("size"), F.col("at.framed").alias("framed"))
        .agg(F.count(F.lit(1)).alias("n")))
    trees = distinct.groupBy("host", "tree_id").agg(F.first("tree").alias("tree"),
                                                    F.count(F.lit(1)).alias("n"))
    refs = checkpointed(trees.groupBy("host").agg(
        F.min_by("tree", F.struct(-F.col("n"), "tree")).alias("reference"),
        F.sum("n").alias("pages")))
    pairs = checkpointed(trees.select("host", "tree_id", "tree").join(
        refs.select("host", "reference"), "host"))
    named = _lookup(counted, pairs, "tree", ["host", "tree_id"])

    def rename(batch: pa.RecordBatch) -> dict:
        node = [align(t, r)[n] for t, r, n in zip(*(batch.column(c).to_pylist() for c in (
            "tree", "reference", "node")), strict=True)]
        return {**{c: batch.column(c) for c in ("host", "n", "size", "framed")}, "node": node,
                "key": [block_key(n, b) for n, b in
                        zip(node, batch.column("block").to_pylist(), strict=True)]}

    texts = written(
        map_batches(named, rename, "host string, n long, size int, framed boolean, node int, key long")
        .filter("node >= 0").groupBy("host", "node", "key").agg(
            F.sum("n").alias("n"), F.max("size").alias("size"),
            F.sum(F.when(~F.col("framed"), F.col("n"))).alias("free")), "blocks")
    # a block needs TEMPLATE_PAGES pages; a host has about as many constant blocks as a page
    constant = (texts.filter(F.col("free") >= TEMPLATE_PAGES)
                .join(refs.select("host", "pages"), "host")
                .filter(F.col("free") >= TEMPLATE_SHARE * F.col("pages"))
                .groupBy("host").agg(F.collect_list("key").alias("constant")))
    nodes = checkpointed(texts.groupBy("host", "node").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum("size").alias("chars")))
    largest = nodes.groupBy("host").agg(F.max("chars").alias("most"))
    # nodes of the reference tree, so no more than one page has
    steady = (nodes.filter(F.col("n") >= F.greatest(F.lit(TEMPLATE_PAGES), REUSE * F.col("texts")))
              .join(largest, "host").filter(F.col("chars") < SMALL_SHARE * F.col("most"))
              .groupBy("host").agg(F.collect_list("node").alias("steady")))
    return checkpointed(refs.select("host", "reference").join(constant, "host", "left")
                        .join(steady, "host", "left"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row."""
    short_batches(pages.sparkSession)
    rows = _with_hosts(pages)
    joined = _lookup(rows, wrappers(rows), "reference", ["host"])
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"],
                           T.StructField("text", T.StringType())])

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for source, ref, constant, steady in zip(*(batch.column(c).to_pylist() for c in (
                "_h", "reference", "constant", "steady")), strict=True):
            page = Page(source)
            out.append(content(page, align(page.tree(), ref), frozenset(constant or ()),
                               frozenset(steady or ())))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out}

    return map_batches(joined, run, schema)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


ORACLE_SQL = None
