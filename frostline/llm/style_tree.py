"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node is a path of element styles (tag, id and
classes, digits levelled). A branch is important if its presentation is that of an article, and if its
contents differ from page to page: menus, notices and adverts repeat, articles do not.

Presentation weighs by fixed classes of tags and names. Elements that are page furniture go everywhere, and so do, inside an
article, those of which a whole class name says so (``comments``, ``ad-banner``). A name that merely holds such a
word (``related-work``, ``notice-period``) is evidence only: inside an article its branch goes if the contents repeat as well.
For all other branches, inside articles or not, the normalised entropy of their contents over the host's pages
decides; headings of an article, which may well be the same on every page, stay. A page that would lose all its text keeps it.

Each distinct page of a host counts once, whatever its copies. Entropies are sums over (host, path, content)
counts, combined before the shuffle, so a host with a third of all pages is no task of its own. Only low branches
travel back, as a list of paths per host.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.shared import Run

LOW = 0.5                # branches whose contents have less than this share of the possible entropy go
LEAST_PAGES = 4          # distinct pages a branch must stand on before its entropy counts

# Elements by their part in a page.
MAIN = {"article", "main"}
FURNITURE = {
    "aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "menu", "nav",
    "noscript", "object", "select", "svg", "template", "textarea", "video", "audio",
}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub",
    "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"article", "aside", "body", "div", "footer", "header", "html", "main", "nav", "section", "table", "ul", "ol", "dl", "form", "td", "th", "blockquote"}
# Words in an id, a class or a role that name page furniture.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "gdpr",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination",
    "popup", "promo", "promoted", "promotion", "related", "reply", "respond", "search", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

# Words that say nothing about an element's part beside one of those names.
NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "container", "content", "inner", "item", "items", "js", "left", "link", "links", "list", "outer", "page", "right", "site", "top", "wrap", "wrapper"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "title", "hgroup", "header"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\s+|/|[^\s\"'>/=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']*)|[\"'])*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(id|class|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")


def named(names: str) -> int:
    """What id, class and role say: 2 if a whole name is that of page furniture, 1 if one holds such a word, 0 otherwise."""
    found = 0
    for name in names.split():
        words = set(WORDS.findall(name)) - NEUTRAL
        if not NAMES.isdisjoint(words):
            found = max(found, 2 if words <= NAMES else 1)
    return found


def style_of(tag: str, attributes: str) -> tuple[str, int]:
    """The element's style, and the evidence that it is page furniture: 3 by its tag or because it is hidden, else by its names."""
    if not attributes or attributes.isspace():
        return tag, 3 if tag in FURNITURE else 0
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in NAMED.finditer(attributes)}
    names = " ".join(found.get(k, "") for k in ("id", "class", "role")).lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    evidence = 3 if tag in FURNITURE or hidden else 0
    if not evidence and names and tag not in MAIN | {"html", "body"}:
        evidence = named(names)
    if tag == "article" and {"comment", "reply"} & set(WORDS.findall(names)):
        evidence = 3
    label = DIGITS.sub("0", ".".join(names.split()))
    return (f"{tag}.{label}" if label else tag), evidence


def blocks(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, path, text) of each block of text in page order.

    kind: "article" or "main" below such an element, "doubtful" below one inside an article whose name holds a word of page
    furniture, "furniture" below page furniture, "other" elsewhere. White space inside a block is one space; character references are decoded.
    """
    stack: list[tuple[str, str, str, str]] = [("", "", "other", "")]  # tag, path, kind, element that opened the kind
    held: list[str] = []
    at = 0

    def flush() -> Iterator[tuple[str, str, str]]:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                yield stack[-1][2], stack[-1][1], text

    def close(tags: set[str], scope: bool) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if scope and stack[k][0] in SCOPES:
                return

    while at < len(page):
        found = TOKEN.search(page, at)
        if not found:
            held.append(page[at:])
            break
        if found.start() > at:
            held.append(page[at:found.start()])
        at = max(found.end(), found.start() + 1)
        tag = (found[2] or "").lower()
        if not tag or tag in INLINE:
            continue
        yield from flush()
        if found[1]:
            close({tag}, False)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?:[\s>/]|\Z)", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = len(page) if stop < 0 else stop + 1
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            close(CLOSES[tag], True)
        elif stack[-1][0] == "p":
            stack.pop()
        style, evidence = style_of(tag, found[3])
        _, path, kind, _ = stack[-1]
        if kind != "furniture":
            # a header belongs to the page unless it stands in an article
            inside = kind in ("article", "doubtful")
            if evidence > 1 or evidence and not inside or tag == "header" and kind == "other":
                kind = "furniture"
            elif evidence:
                kind = "doubtful"
            elif tag == "article" or tag == "main" and kind != "article":
                kind = tag
        stack.append((tag, f"{path}/{style}", kind, tag))
    yield from flush()


def main_text(page: str, low: set[str]) -> str:
    """Text of the article, else of the main part, else of all other branches; without those that are low, unless nothing else is left."""
    parts: dict[str, list[tuple[bool, str]]] = {"article": [], "main": [], "other": []}
    for kind, path, text in blocks(page):
        if kind != "furniture":
            heading = kind == "article" and path.rsplit("/", 1)[-1].split(".")[0] in HEADINGS
            parts["article" if kind == "doubtful" else kind].append((path in low and not heading, text))
    found = parts["article"] or parts["main"] or parts["other"]
    return " ".join([text for goes, text in found if not goes] or [text for _, text in found])


def host(url: Column) -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, kind, pages, importance): contents' entropy over the host's distinct pages, as a share of
    the most that as many pages could have; 1 for a branch on one page."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list[dict]] = {}
            for site, digest, page in zip(*(c.to_pylist() for c in batch.columns)):
                if (site, digest) in found:
                    continue
                content: dict[tuple[str, str], int] = {}
                for kind, path, text in blocks(page):
                    content[path, kind] = zlib.crc32(text.encode("utf-8", "surrogatepass"), content.get((path, kind), 0))
                found[site, digest] = [{"path": path, "kind": kind, "content": c} for (path, kind), c in content.items()]
            nodes = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("content", pa.int64())]))
            sites, digests = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sites, pa.string()), pa.array(digests, pa.int64()), pa.array(list(found.values()), nodes)], names=["host", "digest", "nodes"])

    page = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(host(pages["url"]).alias("host"), F.xxhash64(page).alias("digest"), page.alias("html"))
    trees = rows.mapInArrow(read, "host string, digest long, nodes array<struct<path: string, kind: string, content: long>>")
    distinct = trees.groupBy("host", "digest").agg(F.first("nodes").alias("nodes"))
    each = distinct.select("host", F.inline("nodes")).groupBy("host", "path", "kind", "content").agg(F.count("*").alias("n"))
    node = each.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")
    return node.select("host", "path", "kind", "pages", F.when(F.col("pages") > 1, F.greatest(entropy, F.lit(0.0))).otherwise(1.0).alias("importance"))


def extract(pages: DataFrame, run: Run, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null html is an empty page, text empty if there is none.

    Pages without a URL or host share one tree. Repeated rows each give a row.
    """
    tree = run.store(style_tree(pages), "style-tree")
    lows = (
        tree.filter((F.col("kind") != "furniture") & (F.col("importance") < low) & (F.col("pages") >= least_pages))
        .groupBy("host").agg(F.collect_set("path").alias("low"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(page, set(paths or ())) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"),
        host(pages["url"]).alias("host"))
    found = rows.join(lows, "host", "left").select("page_id", "url", "html", "low").mapInArrow(read, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
