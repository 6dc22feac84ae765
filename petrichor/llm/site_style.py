"""Main text of web pages with a site style tree.

The DOMs of a host are merged: nodes with the same path of tags and classes are one style node. Its presentation
entropy says how much its children's styles vary over the host's pages, its content importance how rarely its own
texts repeat, those in no container below it. The texts of nodes of low importance (the same box on page after page)
are removed from every page, as are branches whose tag, class, id or role says that they aren't part of the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from petrichor.llm.common import fresh, small_or_not, written
from petrichor.llm.shingles import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Their content is text up to the closing tag, never markup.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("article aside body center details dialog div dl fieldset figure footer form header main nav ol section table ul".split())
BLOCKS = CONTAINERS | set("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr html legend li p pre summary tbody td tfoot th thead tr".split())
#: A start tag ends an open element of these kinds, if it is nearer than a container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE_TAGS = set("aside button canvas datalist dialog footer head iframe input menu nav noscript optgroup option select svg template".split()) | RAW
NOISE_NAMES = set(
    "ad ads adbox adsense advert adverts advertisement advertisements alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Their texts differ from page to page by nature, so that rare texts don't speak for them.
VARYING = NOISE_NAMES & set(
    "ad ads adbox adsense advert adverts advertisement advertisements comment comments disqus promo promoted promotion recommended related replies reply respond share sharing social sponsor sponsored".split()
)
#: "has-comments", "no-sidebar": how the page is, not what the element is.
STATES = {"has", "is", "no", "with", "without"}
NOISE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())


#: Containers nested deeper share the path of the one that is this deep.
DEPTH = 256


@dataclass
class Node:
    tag: str
    path: str
    noise: bool
    article: bool
    main: bool
    above: tuple[int, ...] = ()
    root: int = 0
    names: tuple[int, ...] = ()
    children: list[str] = field(default_factory=list)
    outside: list[str] | None = None  # text of the block around an inline element that isn't part of the article


@dataclass
class Block:
    text: str
    noise: bool
    article: bool
    main: bool
    above: tuple[int, ...]  # containers as hashed paths, the outermost first
    root: int  # so many of them lead to the article or main element, itself included
    names: tuple[int, ...] = ()  # the elements around it whose names are those of noise, by number
    named: tuple[int, ...] | None = None  # if only names make it noise that rare texts can outweigh: their hashed paths


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text else {}


def _noisy(tag: str, attributes: dict[str, str], in_content: bool) -> bool:
    """A header belongs to the article if it lies in one."""
    if tag in NOISE_TAGS or tag == "header" and not in_content:
        return True
    if tag in ("html", "body", "main"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _named(tag: str, attributes: dict[str, str], in_content: bool) -> str:
    """"varying" or "fixed" if class, id, role or the form tag suggest noise, else ""; only a prior, see ``_outweighed``."""
    if tag in ("html", "body", "main"):
        return ""
    names = set()
    for word in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", word).lower())
        names.update(() if parts[0] in STATES else parts)
    if names & VARYING:
        return "varying"
    return "fixed" if tag == "form" or names & NOISE_NAMES or not in_content and "header" in names or attributes.get("role", "").lower() in NOISE_ROLES else ""


def _outweighed(named: list[tuple[int, bool]], articles: list[tuple[int, ...]], mains: list[tuple[int, ...]]) -> set[int]:
    """Numbers of the named elements that hold the article: those around the article elements with the fewest such
    names, else the main elements; varying names only if nothing else is left."""
    cost = lambda names: (sum(named[i][1] for i in names), len(names))
    for found in ([x for x in articles if not cost(x)[0]], [x for x in mains if not cost(x)[0]], articles, mains):
        if found:
            least = min(map(cost, found))
            return {i for x in found if cost(x) == least for i in x}
    return set()


def parse(page: str) -> tuple[list[Block], dict[int, list[str]]]:
    """(text blocks in order, children's styles per container path)."""
    root = Node("", "", False, False, False)
    stack, blocks, styles, held = [root], [], {}, []
    named, articles, mains = [], [], []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            top = stack[-1]
            blocks.append(Block(text, top.noise, top.article, top.main, top.above, top.root, top.names))

    def leave(keep: int) -> None:
        while len(stack) > keep:
            flush()
            if (outside := stack.pop().outside) is not None:
                held[:] = [*outside, " "]

    def opened(tag: str, raw: str) -> None:
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the item before it
                if stack[i].tag in CONTAINERS:
                    break
                if stack[i].tag == "p" or stack[i].tag in ENDS.get(tag, ()):
                    leave(i)
                    break
        if tag in VOID:
            held.append(" ")
            return
        top, attributes = stack[-1], _attributes(raw)
        noise = top.noise or _noisy(tag, attributes, top.article or top.main)
        classes = ".".join(sorted(attributes.get("class", "").lower().split()))
        style = f"{tag}.{classes}" if classes else tag
        top.children.append(style)
        main = top.main or tag == "main" or attributes.get("role", "").lower() == "main"
        node = Node(tag, top.path, noise, top.article or tag == "article", main, top.above, top.root, top.names)
        if name := _named(tag, attributes, top.article or top.main):
            node.names += (len(named),)
            named.append((_hash(f"{top.path}/{style}"), name == "varying"))
        if not noise and (tag == "article" or main and not top.main):
            (articles if tag == "article" else mains).append(node.names)
        if tag in CONTAINERS and len(top.above) < DEPTH:
            node.path = f"{top.path}/{style}"
            node.above = top.above + (_hash(node.path),)
            node.children = styles.setdefault(node.above[-1], [])
            node.children.append("|")
            if tag == "article" and not top.article or tag == "main" and not top.root:
                node.root = len(node.above)
        if tag in BLOCKS:
            stack.append(node)
        elif noise and not top.noise or node.names != top.names:
            node.outside = held[:]
            held.clear()
            stack.append(node)

    def closed(tag: str) -> None:
        if tag in BLOCKS:
            flush()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                leave(i)
                return
            if stack[i].tag in CONTAINERS and tag not in CONTAINERS:
                return

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            held.append(html.unescape(page[at : m.start()]))
        at = m.end()
        end, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            closed(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag == "plaintext":
            break
        else:
            opened(tag, raw)
    held.append(html.unescape(page[at:]))
    leave(1)
    flush()
    free = _outweighed(named, articles, mains)
    for b in blocks:
        if live := [i for i in b.names if i not in free]:
            b.named = tuple(named[i][0] for i in live) if not b.noise and not any(named[i][1] for i in live) else None
            b.noise = True
    return blocks, styles


def _node(block: Block) -> int:
    """The container whose own text a block is; 0 outside of all."""
    return block.above[-1] if block.above else 0


def main_text(page: str | None, low: set[int], dull: set[int] = frozenset(), rare: set[int] = frozenset()) -> str:
    """The article's blocks, else those of the main element, else all, without noise and the texts of low nodes.

    If only texts of ``dull`` nodes would be left, low nodes that aren't dull stay; if all are dull, the article
    itself repeats and nothing is removed. Named nodes that are ``rare`` aren't noise.
    """
    blocks = [b for b in parse(page or "")[0] if not b.noise or b.named and rare.issuperset(b.named)]
    for inside in (lambda b: b.article, lambda b: b.main, lambda b: True):
        if own := [b for b in blocks if inside(b)]:
            kept = [b for b in own if _node(b) not in low]
            if all(_node(b) in dull for b in kept):
                kept = [b for b in own if _node(b) not in low or _node(b) not in dull] if any(_node(b) not in dull for b in own) else own
            return "\n\n".join(b.text for b in kept)
    return ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def style_tree(pages: DataFrame, *, gamma: float = 0.9) -> DataFrame:
    """(host, path, pages, importance, own, holds, named) for the style nodes of ``pages`` (host, html) with text.

    With m pages that have the node, presentation is the entropy, to base m, of its children's styles; content is
    the mean over the node's own texts, noise excluded, of 1 - log_m(pages with that text). Importance is
    (1 - gamma) * presentation + gamma * content; ``own`` is the sum of these text values a page, which repeated
    texts beside them don't lower. Both are 1 for a node of one page. ``named`` is the mean value of all texts in an
    element whose name is that of noise, NULL for others and on one page. ``holds`` marks the nodes that hold the
    article. Pages of a host with the same texts, noise excluded, are one page: a copied article is no repeated box.
    A page hands over each of its (node, style) and (node, text) once; they are counted before the shuffle, so a
    host with a third of all pages is no single task's work.
    """
    fields = [("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("holds", pa.int32())]
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("nodes", pa.list_(pa.struct(fields)))])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages_of, ends, rows = [], [], [0], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                blocks, styles = parse(page or "")
                inner = {p for b in blocks if not b.noise for p in b.above[: b.root or 1]}
                found = {(p, 0, _hash(" ".join(children))) for p, children in styles.items()}
                found |= {(_node(b), 1, _hash(b.text)) for b in blocks if (not b.noise or b.named) and b.above}
                found |= {x for b in blocks for p in b.named or () for x in ((p, 2, _hash(b.text)), (p, 3, 0))}
                hosts.append(host)
                pages_of.append(_hash("\n".join(b.text for b in blocks if not b.noise or b.named)))
                rows += [(*x, int(x[0] in inner)) for x in sorted(found)]
                ends.append(len(rows))
            columns = [pa.array(x, t) for x, (_, t) in zip(zip(*rows) if rows else [[]] * 4, fields)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in fields]))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages_of, pa.int64()), lists], schema=schema)

    rows = pages.select("host", "html").mapInArrow(nodes, "host string, page bigint, nodes array<struct<path bigint, kind int, value bigint, holds int>>")
    rows = rows.groupBy("host", "page").agg(F.max("nodes").alias("nodes")).select("host", F.inline("nodes"))
    counted = rows.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("k"), F.sum("holds").alias("holds"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    k = F.col("k").cast("double")
    sums = counted.groupBy("host", "path").agg(
        of(0, k).alias("m"), of(0, k * F.log(k)).alias("styled"), of(1, k).alias("texts"), of(1, k * F.log(k)).alias("repeated"), of(0, F.col("holds")).alias("holding"),
        of(2, k).alias("named_texts"), of(2, k * F.log(k)).alias("named_repeated"), of(3, k).alias("named_pages"),
    )
    m = F.col("m")
    presentation = F.log(m) - F.col("styled") / m
    content = F.log(m) - F.col("repeated") / F.col("texts")
    own = F.when(m > 1, content / F.log(m) * F.col("texts") / m).otherwise(1.0)
    importance = F.when(m > 1, ((1 - gamma) * presentation + gamma * content) / F.log(m)).otherwise(1.0)
    named = F.when(F.col("named_pages") > 1, 1 - F.col("named_repeated") / F.col("named_texts") / F.log("named_pages"))
    return sums.filter("texts > 0 OR named_texts > 0").select("host", "path", m.cast("long").alias("pages"), importance.alias("importance"), own.alias("own"), (F.col("holding") * 2 > m).alias("holds"), named.alias("named"))


def low_branches(tree: DataFrame, *, threshold: float) -> DataFrame:
    """(host, path, low, dull, rare): the nodes with one of these marks. Low nodes are of low importance and don't
    lead to the article in most pages; dull ones, which may hold the article, have hardly an own text a page that
    doesn't repeat. Rare ones have the name of noise, which halves their importance, and still aren't of low
    importance. Nodes of one page are neither."""
    marks = {"low": ~F.col("holds") & (F.col("importance") < threshold), "dull": F.col("own") < threshold, "rare": F.col("named") / 2 >= threshold}
    marked = tree.select("host", "path", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in marks.items()])
    return marked.filter("low OR dull OR rare")


def _lists(marked: DataFrame, *keys: str) -> DataFrame:
    return marked.groupBy(*keys).agg(*[F.collect_set(F.when(F.col(k), F.col("path"))).alias(k) for k in ("low", "dull", "rare")])


def _page_lists(pages: DataFrame, marked: DataFrame) -> DataFrame:
    """(host, page, low, dull, rare): the marked nodes of each page of ``pages`` (host, html); page is its MD5."""
    schema = pa.schema([("host", pa.string()), ("page", pa.string()), ("path", pa.int64())])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                rows += [(host, key, p) for p in {p for b in parse(page or "")[0] for p in (_node(b), *(b.named or ()))}]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    found = pages.select("host", F.md5("html").alias("page"), "html").mapInArrow(paths, "host string, page string, path bigint")
    return _lists(found.join(marked, ["host", "path"]), "host", "page")


def extract(
    pages: DataFrame, *, url_col: str = "url", html_col: str = "html", threshold: float = 0.25, list_nodes: int = 1000,
) -> DataFrame:
    """Every row with ``text`` and ``n_chars`` (its code points); columns of these names are replaced.

    Blocks are trimmed, their white space is one space, character references are decoded, and two line breaks
    join them. A NULL or empty page gives an empty text, a NULL or odd URL belongs to the host "", whose pages
    aren't merged; pages of a host with the same texts count once. An empty table gives no rows. Marked nodes travel
    as one list per host if no host has more than ``list_nodes``, else each page joins its own; the result is the same.
    """
    small_batches(pages.sparkSession)
    named = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host <> ''")
    marked = written(low_branches(written(style_tree(named), "style-tree"), threshold=threshold), "low-branches")
    most = marked.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    by_page = most > list_nodes
    lows = written(_page_lists(named, marked) if by_page else _lists(marked, "host"), "low-lists")

    @pandas_udf("string")
    def text_of(page: pd.Series, low: pd.Series, dull: pd.Series, rare: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, *(set(x) if x is not None else set() for x in b)) for p, *b in zip(page, low, dull, rare)], dtype=object)

    host, low_host, low_page, low, dull, rare = fresh(pages, "host", "low_host", "low_page", "low", "dull", "rare")
    lows = small_or_not(lows.select(F.col("host").alias(low_host), *([F.col("page").alias(low_page)] if by_page else []), F.col("low").alias(low), F.col("dull").alias(dull), F.col("rare").alias(rare)), lows.count(), 0 if by_page else 100_000)
    same = F.col(host) == F.col(low_host)
    same = same & (F.md5(F.col(html_col)) == F.col(low_page)) if by_page else same
    rows = pages.withColumn(host, host_of(F.col(url_col))).join(lows, same, "left")
    rest = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    out = rows.select(*[F.col(f"`{c}`") for c in rest], text_of(F.col(html_col), F.col(low), F.col(dull), F.col(rare)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
