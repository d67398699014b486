"""HTML extraction with a site style tree (operator 3).

A page is parsed into elements, none left out but scripts, styles and other text
that is never shown.  The pages of a host are merged into one style tree.  An
element node of the tree has style nodes, one for each sequence of children that
it has on some page; a child is an element node of its own under each style and
place.  Elements without children have contents instead of styles.  Both are
counted by pages: of the m pages that show an element node, n show one style or
content.  The importance of a node is the entropy of its presentation or content,
  imp = 1 - sum n ln n / (m ln m),
0 if all pages show the same and 1 if all differ, averaged with ``PRIOR`` pages of
importance 1, so that little evidence never removes anything.  The composite
importance of a node with l styles adds its branches, bottom up, level by level:
  comp = (1 - GAMMA^l) imp + GAMMA^l * mean over pages of (mean of the children's comp);
a content counts as imp, a style of one page as 1.

From each page go the branches under elements whose composite importance is below
a bar.  Roles of elements move the bar: ``LOW`` for elements outside article and
main, ``INNER`` for those inside, ``DOUBT`` for those with the name of a role (a nav
element, a class "ad") and for those inside an article of which a part of a name
looks like one.  Above its bar an element with the name of a role goes too: adverts and
comments differ on every page, so their entropy says "content", and a host's only
page has no entropy at all.

The tree is counted by (node, style) with partial sums over distinct pages, and
its levels are joined by node, so a host with a third of all pages is spread over
all tasks.  The nodes to remove are 64-bit numbers; up to ``SMALL`` of them are
broadcast, more are joined with the pages' nodes.

Defined results.  Null html: empty text.  Null url: the pages without host are one
host.  Pages with equal host and html count once in the tree and give equal rows.
Extra columns are dropped; an empty table gives an empty one.  Unclosed elements
end with their parent, stray end tags and comments are passed over.  Elements
nested deeper than ``DEEP`` count as content of the one above them, so that the
tree's levels are bounded; their text stays.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import cut, ready, slices, table

GAMMA, PRIOR, LOW, INNER, DOUBT, SMALL, DEEP = 0.9, 4.0, 0.3, 0.15, 0.75, 1_000_000, 64
# fixed values: elements by how they are laid out, and names of roles that are not content
RAW = frozenset("script style textarea title iframe xmp noembed".split())
UNSEEN = frozenset("head noscript template svg select button canvas object math".split()) | RAW
ROLES = frozenset("nav footer aside form header menu dialog figcaption".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("br td th wbr option".split())
NAMES = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies respond disqus widget widgets toolbar pagination pager skip hidden".split())
PARTS = NAMES - frozenset("side skip hidden share reply respond".split())  # those that name a role also as part of a longer name
COMMENTS = frozenset("comment comments reply replies respond".split())
SAME = frozenset("p li tr dt dd h1 h2 h3 h4 h5 h6".split())  # ended by the next of their kind
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|[^>]*>)""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
PLAIN, INSIDE, DOUBTFUL, ROLE = range(4)
BAR = {PLAIN: LOW, INSIDE: INNER, DOUBTFUL: DOUBT, ROLE: DOUBT}


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m.group(1).lower() if m else ""


def _h(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def kind_of(tag: str, attrs: str, inside: bool) -> tuple[str, int]:
    """The class as the tree shows it, and the kind of the element: a whole name is a role anywhere, a part of one only outside article and main."""
    shown, whole, part = "", False, False
    for k, v in ATTR.findall(attrs) if "=" in attrs else ():
        v = v.strip("\"'").lower()
        if k.lower() == "class":
            shown = " ".join(sorted(v.split()))
        names = NAMES if tag not in ("html", "body", "article", "main") else COMMENTS if tag == "article" else frozenset()
        whole = whole or not names.isdisjoint(v.split())
        part = part or not (names & PARTS).isdisjoint(WORD.findall(v))
    role = whole or (tag in ROLES and not (inside and tag in ("header", "figcaption"))) or (part and not inside)
    return shown, ROLE if role else DOUBTFUL if part else INSIDE if inside else PLAIN


class Page:
    """Elements in page order (label, parent, kind, place among siblings, depth), and blocks of (element, text) pieces."""

    def __init__(self, page: str):
        self.label, self.parent, self.kind, self.kids, self.depth = [""], [-1], [PLAIN], [[]], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._parse(page)

    def _add(self, label: str, parent: int, kind: int) -> int:
        if self.depth[parent] >= DEEP and kind != ROLE:
            return parent
        i = len(self.label)
        self.label.append(label)
        self.parent.append(parent)
        self.kind.append(kind)
        self.kids.append([])
        self.depth.append(self.depth[parent] + 1)
        self.kids[parent].append(i)
        return i

    def _parse(self, page: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, element, inside article or main, unseen
        text: list[tuple[int, str]] = []
        at, n = 0, len(page)

        def say(x: str) -> None:
            if not stack[-1][3]:
                text.append((stack[-1][1], x))

        def flush() -> None:
            if text:
                self.blocks.append(text.copy())
                text.clear()

        def close(tag: str) -> bool:
            block = tag in BLOCKS
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    return True
                if not block and stack[k][0] in BLOCKS:
                    return False  # an inline end tag never ends a block
            return False

        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                say(page[at:])
                break
            if lt > at:
                say(page[at:lt])
            m = TAG.match(page, lt)
            if not m:
                say("<")
                at = lt + 1
                continue
            at = m.end()
            tag = (m.group(2) or "").lower()
            if not tag:
                continue
            if tag in BREAKS:
                say(" ")
            if m.group(1):
                if (close(tag) or tag == "p") and tag in BLOCKS:
                    flush()
                continue
            if tag in VOID or m.group(3).endswith("/>") and tag not in BLOCKS:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                    continue
            if tag in BLOCKS:
                flush()
                if tag == "body":
                    close("head")
                top = len(stack) - 1
                while top and stack[top][0] not in BLOCKS:
                    top -= 1
                if stack[top][0] == "p" or tag in SAME and stack[top][0] == tag:
                    del stack[top:]
            _, parent, inside, unseen = stack[-1]
            unseen = unseen or tag in UNSEEN
            shown, kind = kind_of(tag, m.group(3), inside)
            node = parent
            if not unseen and (tag in BLOCKS or shown or kind in (ROLE, DOUBTFUL)):
                node = self._add(f"{tag}.{shown}/{kind}", parent, kind)
            stack.append((tag, node, inside or tag in ("article", "main"), unseen))
        flush()

    def nodes(self, host: str) -> list[tuple[int, int, int, bool]]:
        """(node, style above, style or content, has children) of every element; a node is known by host, styles and places above it."""
        own: dict[int, list[str]] = {}
        for block in self.blocks:
            for i, x in block:
                own.setdefault(i, []).append(x)
        ids, out = [0] * len(self.label), []
        ids[0] = _h("host", host)
        up = [0] * len(self.label)
        for i, kids in enumerate(self.kids):
            if kids:
                style = _h(ids[i], *[self.label[k] for k in kids])
                for j, k in enumerate(kids):
                    ids[k], up[k] = _h(style, j), style
            else:
                style = _h("content", " ".join("".join(own.get(i, ())).split()))
            out.append((ids[i], up[i], style, bool(kids)))
        return out

    def text(self, noise=frozenset(), ids: list[int] | None = None) -> list[str]:
        """Blocks without the branches of plain roles and of the given nodes, in page order."""
        gone = [False] * len(self.label)
        for i, p in enumerate(self.parent):
            gone[i] = (p >= 0 and gone[p]) or self.kind[i] == ROLE or (ids is not None and ids[i] in noise)
        out = []
        for block in self.blocks:
            x = " ".join(entities.unescape("".join(x for i, x in block if not gone[i])).split())
            if x:
                out.append(x)
        return out


def page_nodes(pages: DataFrame) -> DataFrame:
    """(host, page, node, up, v, inner, kind, depth) of (url, html): a row for each element; page is a hash of host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page", "node", "up", "v", "inner", "kind", "depth"]
        for b in slices(batches, 1_000_000):
            cols: list[list] = [[] for _ in names]
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, host = Page(page or ""), host_of(url)
                rows = [(*r, kind, depth) for r, kind, depth in zip(p.nodes(host), p.kind, p.depth, strict=True) if depth <= DEEP]
                cols[0] += [_h("page", host, page or "")] * len(rows)
                for k in range(6):
                    cols[k + 1] += [r[k] for r in rows]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return pages.select("url", "html").mapInArrow(run, "page long, node long, up long, v long, inner boolean, kind int, depth int")


def style_tree(nodes: DataFrame) -> DataFrame:
    """(node, up, kind, depth, v, inner, n): on how many distinct pages a node shows a style or content."""
    key = ["node", "up", "kind", "depth", "v", "inner"]
    return nodes.select(*key, "page").distinct().groupBy(*key).agg(F.count("*").alias("n"))


def importances(tree: DataFrame) -> DataFrame:
    """(node, kind, depth, m, comp) of the nodes on two pages or more; all others have importance 1."""
    tree = cut(tree)
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    of = tree.groupBy("node").agg(
        F.max("up").alias("up"), F.max("kind").alias("kind"), F.max("depth").alias("depth"), F.sum("n").alias("m"), F.count("*").alias("l"),
        F.sum(F.col("n") * F.log("n")).alias("s"), share(~F.col("inner")).alias("contents"), share(F.col("inner") & (F.col("n") == 1)).alias("single"),
    ).where("m > 1")
    imp = (F.col("m") * (1 - F.col("s") / (F.col("m") * F.log("m"))) + PRIOR) / (F.col("m") + PRIOR)
    fade = F.pow(F.lit(GAMMA), F.col("l"))
    of = of.withColumn("imp", imp).withColumn("fade", fade)
    of = cut(of.select("node", "up", "kind", "depth", "m", "fade", ((1 - fade) * F.col("imp") + fade * (F.col("contents") * F.col("imp") + F.col("single"))).alias("own")))
    styles = tree.where(F.col("inner") & (F.col("n") > 1)).select("node", "depth", F.col("v").alias("style"), "n")
    deepest = of.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = of.where(F.col("depth") == depth)
        if levels:
            below = levels[-1].groupBy(F.col("up").alias("style")).agg(F.avg("comp").alias("c"))
            shown = styles.where(F.col("depth") == depth).join(below, "style", "left").groupBy("node").agg(F.sum(F.col("n") * F.coalesce("c", F.lit(1.0))).alias("x"))
            here = here.join(shown, "node", "left")
        else:  # styles here have only children beyond DEEP
            here = here.join(styles.where(F.col("depth") == depth).groupBy("node").agg(F.sum("n").cast("double").alias("x")), "node", "left")
        comp = F.col("own") + F.col("fade") * F.coalesce("x", F.lit(0.0)) / F.col("m")
        levels.append(cut(here.select("node", "up", "kind", "depth", "m", comp.alias("comp"))))
    out = of.select("node", "up", "kind", "depth", "m", "own").limit(0).withColumnRenamed("own", "comp")
    for x in levels:
        out = out.unionByName(x)
    return out.drop("up")


def noise(importance: DataFrame) -> DataFrame:
    """(node): those below their bar."""
    bar = F.element_at(F.create_map(*[F.lit(x) for kv in BAR.items() for x in kv]), F.col("kind"))
    return importance.where(F.col("comp") < bar).select("node")


def extract(df: DataFrame, small: int = SMALL) -> DataFrame:
    """page_id, url, text of (page_id, url, html) rows."""
    spark = ready(df.sparkSession)
    pages = df.select("page_id", "url", F.col("html").cast("string").alias("html"))
    nodes = page_nodes(pages)
    bad = cut(noise(importances(style_tree(nodes))))
    schema = f"page_id {dict(df.dtypes)['page_id']}, url string, text string"
    many = bad.count() > small
    sent = None if many else spark.sparkContext.broadcast(np.sort(np.array([r.node for r in bad.collect()], np.int64)))  # ``small`` numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None if sent is None else frozenset(sent.value.tolist())
        for b in slices(batches):
            out = []
            lists = b.column(3).to_pylist() if whole is None else [None] * b.num_rows
            for url, page, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), lists, strict=True):
                p = Page(page or "")
                gone = whole if whole is not None else frozenset(own or ())
                out.append("\n".join(p.text(gone, [r[0] for r in p.nodes(host_of(url))] if gone else None)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    if not many:
        return pages.mapInArrow(run, schema)
    # a page's own nodes that go, by two hashes of its row
    two = [F.xxhash64("url", "html").alias("h1"), F.xxhash64(F.lit(3), "url", "html").alias("h2")]
    keyed = pages.select("page_id", "url", "html", *two)
    of = page_nodes_of(keyed).join(bad, "node").groupBy("h1", "h2").agg(F.collect_set("node").alias("bad"))
    return keyed.join(of, ["h1", "h2"], "left").select("page_id", "url", "html", "bad").mapInArrow(run, schema)


def page_nodes_of(keyed: DataFrame) -> DataFrame:
    """(h1, h2, node) of (h1, h2, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000_000):
            rows = [(h1, h2, r[0]) for h1, h2, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in Page(page or "").nodes(host_of(url))]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["h1", "h2", "node"])

    return keyed.select("h1", "h2", "url", "html").mapInArrow(run, "h1 long, h2 long, node long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op3_html_extract": op3_html_extract}
ORACLE_SQL: dict[str, str] = {}
