"""Main text of web pages by differencing each page with the nearest URL of its host.

Pages of one host are ordered by URL path; each page is compared with the path before or after its own,
whichever shares the longer beginning. The text lines of both pages are aligned by their longest common
subsequence, and lines that both have are template and deleted. Lines inside an article are protected from
this: a sentence that two articles quote is content. Markup then removes what only one page shows: lines in
menus, headers, footers, adverts, notices, forms and comments, and lines outside an article that is there.
A class, id or role marks an element if a whole token, or what stands before its first hyphen or underscore, is
a mark. Such names never mark body, main, article or what an article stands in; articles below comments or
links to other pages are part of those, unless the page has no article elsewhere.

The order is made by range partitioning on (host, path), so a host of any size is spread over tasks; only
hashes of lines outside articles travel for the comparison, and page bodies are shuffled once, compressed.

Defined results: null or empty html gives empty text; pages without a usable URL, and pages that are alone on
their host, are cleaned by markup only; pages that share host and path share one neighbour, which is never
another copy of the same path; truncated pages are read to their end; repeated rows are separate pages.
"""

from __future__ import annotations

import html
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import numbered, rank_in_class, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|([^<]+|<)", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
HEAD = re.compile(r"[-_]")

# fixed values: elements and the words in class, id and role that mark what surrounds an article
ARTICLE = {"article", "main"}
OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog"}
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond "
    "disqus share sharing social related recommended newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager widget "
    "toolbar form copyright complementary contentinfo".split())
LISTS = set("comment comments reply replies respond disqus related recommended".split())  # marks of places with articles of their own
UNMARKED = {"html", "body", "main", "article"}  # no class, id or role marks these
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

BOILERPLATE, OPEN, CONTENT = 0, 1, 2
NAMED, LISTED = 3, 4  # boilerplate by class, id or role only; LISTED also drops the articles inside
DROPPED = {BOILERPLATE, NAMED, LISTED}


def _kind(name: str, attributes: str, kind: int, lists: bool) -> int:
    """Kind of an element inside one of ``kind``; ``lists`` says whether comments may keep their articles to themselves."""
    if kind == BOILERPLATE or (name in OUTSIDE and not (kind == CONTENT and name == "header")):
        return BOILERPLATE
    found: dict[str, str] = {}
    for key, *values in ATTRIBUTE.findall(attributes or ""):
        found.setdefault(key.lower(), "".join(values).strip().lower())
    if found.get("hidden", "false") != "false" or found.get("aria-hidden") == "true" or UNSHOWN.search(found.get("style", "")):
        return BOILERPLATE
    if name in ARTICLE and kind != LISTED:
        return CONTENT
    if name in UNMARKED or kind == LISTED:
        return kind
    tokens = [t for key in ("class", "id", "role") for t in found.get(key, "").split()]
    marks = {m for t in tokens for m in (t, HEAD.split(t)[0])} & MARKS
    if lists and marks & LISTS:
        return LISTED
    return NAMED if marks else kind


def text_lines(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block in page order; white space is one space."""
    lines, listed = _blocks(page, True)
    return _blocks(page, False)[0] if listed and all(kind != CONTENT for kind, _ in lines) else lines


def _blocks(page: str, lists: bool) -> tuple[list[tuple[int, str]], bool]:
    """The blocks, and whether an article was dropped with the comments around it."""
    listed = False
    lines: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = [("", OPEN)]

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append((BOILERPLATE if stack[-1][1] in DROPPED else stack[-1][1], text))

    for found in TOKEN.finditer(page):
        _, closing, name, attributes, text = found.groups()
        if text is not None:
            parts.append(text)
            continue
        if not name:
            continue
        name = name.lower()
        kind = stack[-1][1]
        if closing:
            if name not in INLINE:
                end_block()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                if name in INLINE:
                    end_block()
                del stack[depth:]
            elif name == "p":
                continue
            continue
        own = _kind(name, attributes, kind, lists)
        if name in INLINE and not (own in DROPPED and kind not in DROPPED):
            if name == "br":
                parts.append(" ")
            continue
        end_block()
        if name in ("p", "li", "option", "tr", "td") and stack[-1][0] == name:
            stack.pop()
            own = _kind(name, attributes, stack[-1][1], lists)
        if name not in VOID and not attributes.endswith("/"):
            listed = listed or (name in ARTICLE and own == LISTED)
            stack.append((name, own))
    end_block()
    return lines, listed


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence, by matches sorted into increasing chains."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = set(range(head)) | set(range(len(a) - tail, len(a)))
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    chain = links[-1] if links else None
    while chain:
        shared.add(chain[0])
        chain = chain[1]
    return shared


def line_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - 2**63


def address(url: str | None) -> tuple[str | None, str | None]:
    """Host and path of a URL, without scheme, port, query and fragment."""
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)(?::\d+)?([^?#]*)", url or "")
    return (found[1].lower(), found[2].rstrip("/") or "/") if found else (None, None)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        lines = [text_lines(page or "") for page in batch["html"]]
        where = [address(url) for url in batch["url"]]
        yield pd.DataFrame({
            "page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "host": [h for h, _ in where], "path": [p for _, p in where],
            "outside": [[line_hash(t) for kind, t in page if kind != CONTENT] for page in lines],
            "body": [pack("\n".join(f"{kind}{t}" for kind, t in page).encode("utf-8", "surrogatepass")) for page in lines]})


def parsed_pages(pages: DataFrame) -> DataFrame:
    columns = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInPandas(_parsed, "page_id bigint, url string, host string, path string, outside array<bigint>, body binary")


def nearest_paths(parsed: DataFrame) -> DataFrame:
    """(host, path) with path and lines of the paths before and after it on the same host."""
    paths = parsed.filter("host is not null").groupBy("host", "path").agg(F.min_by("outside", "page_id").alias("outside"))
    ordered = paths.repartitionByRange("host", "path").sortWithinPartitions("host", "path")
    ranked = rank_in_class(numbered(ordered, "paths").withColumn("_all", F.lit(0)), "_all", "n")
    own = ranked.select("n", "host", "path")

    def side(name: str, step: int) -> DataFrame:
        return ranked.select((F.col("n") + step).alias("n"), F.col("host").alias(f"{name}_host"), F.struct("path", "outside").alias(name))

    joined = own.join(side("before", 1), "n", "left").join(side("after", -1), "n", "left")
    same = lambda name: F.when(F.col(f"{name}_host") == F.col("host"), F.col(name)).alias(name)
    return joined.select("host", "path", same("before"), same("after"))


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = []
        for path, before, after, body in zip(batch["path"], batch["before"], batch["after"], batch["body"]):
            lines = [(int(x[0]), x[1:]) for x in unpack(body).decode("utf-8", "surrogatepass").split("\n") if x]
            near = [m for m in (before, after) if m is not None]
            mate = max(near, key=lambda m: len(os.path.commonprefix([m["path"], path])), default=None)
            outside = [i for i, (kind, _) in enumerate(lines) if kind != CONTENT]
            template = set()
            if mate is not None:
                found = common_lines([line_hash(lines[i][1]) for i in outside], [int(h) for h in mate["outside"]])
                template = {outside[k] for k in found}
            kept = [(kind, t) for i, (kind, t) in enumerate(lines) if i not in template and kind != BOILERPLATE]
            has_article = any(kind == CONTENT for kind, _ in kept)
            texts.append("\n".join(t for kind, t in kept if kind == CONTENT or not has_article))
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    parsed = parsed_pages(pages)
    near = nearest_paths(parsed)
    joined = parsed.select("page_id", "url", "host", "path", "body").join(near, ["host", "path"], "left")
    return joined.select("page_id", "url", "path", "before", "after", "body").mapInPandas(_cleaned, "page_id bigint, url string, text string, n_chars bigint")


def op1_nearest_url_differencing(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))
