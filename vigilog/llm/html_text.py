"""Main text of pages by a site style tree.

A page is read into its block elements; inline tags do not part text, ``br`` is
white space, scripts, styles and comments are skipped whole. The pages of a host
are merged into a style tree: nodes are block elements named by the path of
their tags and classes. Two importances are kept for each node:

* presentation: the entropy of its styles (the orders of its child elements)
  over the host's ``m`` pages that have the node, to the base ``m``;
* content: 1 less the mean entropy of the texts below it, over the pages they
  stand in: a text on every page is worth 0, one on a single page 1.

They are mixed as ``(1 - g**l) * presentation + g**l * content`` for ``l`` styles.
Branches below ``threshold`` are cut from each page, if their node is on at least
``min_pages`` pages. Some elements say what they are, which fixes their
importance: ``article`` and ``main`` stay; menus, headers, footers, asides and
dialogs go, also inside them (a header inside an article is its own), as does what
is classed with a whole word for what differs from page to page, so that a style
tree cannot tell it (see ``_NOISE``: ads, comments, sharing). Words for parts of a
layout (``_LAYOUT``) and forms, which may be around a whole page, are left to the
style tree; inside an article some of them go. An article inside what only a word
cuts stays, but not inside comments and related stories, where only ``main`` does.

Counts are summed per host and node from partial counts, so a host of any size
is no single group; what goes back to the pages is the list of a host's nodes to
cut, which is as long as its style tree is wide.

Defined results: null or empty html: empty text; null url or one without a host:
the pages without host are one site; repeated pages count each; broken markup is
read as far as it goes; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import store
from .url_filter import parts

# Element names of the HTML standard by what they mean here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object select noembed noframes xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img input br button".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split())
_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article main section div body nav".split())
_MAIN = frozenset(("article", "main"))
_NOISE_TAGS = frozenset("nav footer aside dialog menu head".split())
#: Whole words of class, id or role that say a branch is no main text.
_NOISE = frozenset(
    "ad ads advert advertisement adverts comment comments consent cookie cookies cookie-banner cookie-consent cookie-notice disqus "
    "gdpr newsletter popup promo related share sharing social sponsor sponsored subscribe".split())
#: Those whose articles are others'.
_OTHERS = frozenset("comment comments disqus related".split())
#: Words of a layout; inside an article they are no main text either.
_LAYOUT = frozenset("breadcrumb breadcrumbs footer menu nav navbar navigation sidebar widget".split())
#: What comes back inside a branch that is cut.
_BACK = {"gone": frozenset(), "others": frozenset(("main",)), "cut": _MAIN}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class _Node:
    __slots__ = ("tag", "path", "state", "children")

    def __init__(self, tag: str, path: str, state: str):
        self.tag, self.path, self.state = tag, path, state
        self.children: list[str] = []


def read(page: str) -> tuple[list[tuple[str, tuple[_Node, ...]]], list[_Node]]:
    """The text blocks of a page, each with the nodes around it, and all nodes."""
    root = _Node("", "", "open")
    stack, nodes, blocks, pending = [root], [root], [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(pending)).split())
        pending.clear()
        if text:
            blocks.append((text, tuple(stack)))

    def close_until(names, scopes=frozenset()) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in names:
                del stack[at:]
                return
            if stack[at].tag in scopes:
                return

    at, lower = 0, None
    for found in _TAG.finditer(page):
        if found.start() < at:
            continue  # inside raw text
        pending.append(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            if found.group().startswith("<![CDATA["):
                pending.append(html.escape(found.group()[9:-3]))
            continue
        name = name.lower()
        if name in _RAW and not closing:
            if not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
                lower = page.lower() if lower is None else lower
                if len(lower) != len(page):
                    lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
                end = lower.find(f"</{name}", at)
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            if name not in ("svg", "math", "object", "select"):
                continue
            continue
        if name == "br":
            pending.append(" ")
        if name in _INLINE or name in _RAW:
            continue
        flush()
        if closing:
            if any(n.tag == name for n in stack[1:]):
                close_until({name})
            continue
        if name in _CLOSES_P:
            close_until({"p"}, _SCOPES - {"p"})
        if name in _ITEMS:
            close_until(_ITEMS[name], _SCOPES)
        if name in ("html", "body") and any(n.tag == name for n in stack):
            continue
        parent = stack[-1]
        css = _CLASS.search(attributes)
        css = ".".join(sorted((css.group(1) or css.group(2) or css.group(3) or "").lower().split())) if css else ""
        named = set()
        for n in _NAMES.findall(attributes):
            named.update("".join(n).lower().split())
        state = parent.state
        if state in _BACK:
            if name in _BACK[state]:
                state = "kept"
            elif name in _NOISE_TAGS:
                state = "gone"
        elif name in _NOISE_TAGS:
            state = "gone"
        elif name in _MAIN:
            state = "kept"
        elif name not in ("html", "body"):
            inside = state == "kept"
            if named & _OTHERS:
                state = "others"
            elif named & _NOISE or (name == "header" and not inside) or (inside and (name == "form" or named & _LAYOUT)):
                state = "cut"
        label = f"{name}.{css}" if css else name
        if not parent.children or parent.children[-1] != label:
            parent.children.append(label)
        node = _Node(name, f"{parent.path}/{label}", state)
        nodes.append(node)
        if name not in _VOID:
            stack.append(node)
    pending.append(page[at:] if at < len(page) else "")
    flush()
    return blocks, nodes


def _number(*parts_: str) -> int:
    """A 64-bit name of texts, the same in every process."""
    import hashlib

    return int.from_bytes(hashlib.blake2b("\x00".join(parts_).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _observed(pages: DataFrame) -> DataFrame:
    """(node, kind, value, k, klogk): what each page adds to the style tree of
    its host; a node is named by host and path. kind 0: a style, 1: a text."""
    names = ["host", "node", "kind", "value", "k", "klogk"]

    def rows(batches):
        for batch in batches:
            out = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks, nodes = read(page or "")
                seen: Counter = Counter()
                for node in nodes:
                    seen[node.path, 0, "|".join(node.children)] += 1
                for text, around in blocks:
                    for node in reversed(around):
                        seen[node.path, 1, text] += 1
                        if node.tag in _MAIN or node.state == "gone":
                            break  # what is above is not judged by what is fixed
                out += [(host, path, kind, _number(value), k, k * math.log(k)) for (path, kind, value), k in seen.items()]
            columns = list(zip(*out)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int8(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return pages.select("host", "html").mapInArrow(rows, "host string, node string, kind byte, value long, k long, klogk double")


def style_tree(pages: DataFrame, mix: float = 0.9) -> DataFrame:
    """(host, node, pages, styles, presentation, content, importance) of the
    merged pages (host, html)."""
    seen = _observed(pages).groupBy("host", "node", "kind", "value").agg(
        F.sum("k").alias("n"), F.sum("klogk").alias("klogk"), F.count("*").alias("pages"))
    # A page shows a node in some styles; p is a style's share of all showings.
    node = seen.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == 0, F.col("pages"))).alias("most"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("shown"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("styles"),
        F.sum(F.when(F.col("kind") == 0, F.col("pages"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("nlogn"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("texts"),
        # The entropy of a text over its pages: log n - (sum of k log k) / n.
        F.sum(F.when(F.col("kind") == 1, F.log("n") - F.col("klogk") / F.col("n"))).alias("spread"))
    base = F.log(F.greatest("pages", F.lit(2)))
    presentation = F.when(F.col("pages") > 1, F.least(F.lit(1.0), (F.log("shown") - F.col("nlogn") / F.col("shown")) / base)).otherwise(1.0)
    content = F.when((F.col("pages") > 1) & (F.col("texts") > 0), F.greatest(F.lit(0.0), 1 - F.col("spread") / F.col("texts") / base)).otherwise(
        F.when(F.col("texts") > 0, 1.0).otherwise(0.0))
    out = node.withColumns({"presentation": presentation, "content": content})
    weight = F.pow(F.lit(mix), F.col("styles"))
    return out.select(
        "host", "node", "pages", "styles", "presentation", "content",
        ((1 - weight) * F.col("presentation") + weight * F.col("content")).alias("importance"))


def main_text(page: str | None, cut: frozenset | set = frozenset()) -> str:
    """The blocks of a page that stay, ``cut`` being the nodes to remove."""
    out = []
    for text, around in read(page or "")[0]:
        state = around[-1].state
        if state == "kept" or (state == "open" and not any(n.path in cut for n in around)):
            out.append(text)
    return "\n\n".join(out)


def extract(
    pages: DataFrame, mix: float = 0.9, threshold: float = 0.2, min_pages: int = 3, small: int = 200_000,
) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html).

    Up to ``small`` nodes to cut (some 100 bytes each) are sent to the pages as
    they are; beyond that pages and nodes are joined by host.
    """
    rows = pages.select("page_id", "url", parts()[0].alias("host"), "html")
    tree = style_tree(rows, mix)
    low = tree.where((F.col("importance") < threshold) & (F.col("pages") >= min_pages) & (F.col("node") != ""))
    low = low.where("node not like '%/body' and node not like '%/html'")
    low = store(low.groupBy("host").agg(F.collect_set("node").alias("cut")), "nodes")
    if (low.agg(F.sum(F.size("cut"))).first()[0] or 0) <= small:
        low = F.broadcast(low)

    def texts(batches):
        for batch in batches:
            out = [main_text(page, set(cut or ())) for page, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    joined = rows.join(low, "host", "left").select("page_id", "url", "html", "cut")
    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
