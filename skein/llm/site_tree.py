"""HTML extraction by site style trees.

The DOMs of a host's pages are merged: nodes with the same path of tags and class, id and role names are one node of
the tree. A node's importance is entropy-based: a container's grows with the variety of its pages' child sequences, a
leaf's falls with the evenness with which its texts repeat over pages. Each host's importance is shrunk towards that of
the same path over all hosts, which decides for hosts of few pages. Nodes of low importance are cut from each page.

Statistics can't tell unique furniture from unique text: adverts, reader comments and menus that differ on every page.
Elements that are furniture by their tag or name are therefore cut as well, whatever their entropy, and an article or main
element outweighs what is around it. The README says how far either part decides on the given tables.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import chunks

# Tag and name lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head title script style noscript template iframe object svg math canvas audio video select textarea button form input nav footer aside dialog menu".split())
NAMES = frozenset("ad ads advert adverts advertisement sponsored sponsor promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies respond widget toolbar pagination pager skip copyright legal".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: An opening tag of the group closes an open element of the set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table select".split())
BLOCKS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

#: Elements whose inside is no markup.
RAW = frozenset("script style textarea title noscript template iframe".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
QUOTE = re.compile("[>\"']")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: A branch below this importance goes; a host's own importance weighs as its pages against so many of all hosts.
LEAST, PRIOR_PAGES = 0.7, 20
#: The same for branches inside an article or main element, which hold the text more often than not.
LEAST_INSIDE = 0.3
#: Cut nodes that a task may hold; more are joined to the pages by host.
HELD = 100_000


def _node(tag: str, attrs: str) -> tuple[str, bool]:
    """The node's name in the tree, and whether it is furniture by its tag or names."""
    if not attrs.strip():
        return tag, tag in DROPPED
    names, role, hidden = [], "", bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", attrs, re.I))
    for kind, *value in NAMED.findall(attrs):
        text = next((v for v in value if v), "").lower()
        if kind.lower() == "role":
            role = text
        else:
            names += re.findall(r"[^\s]+", re.sub(r"\d+", "0", text))
    parts = {p for n in names for p in re.split(r"[-_]", n)}
    return ".".join([tag, *sorted(set(names)), *([f"@{role}"] if role else [])]), tag in DROPPED or hidden or bool(parts & NAMES) or role in ROLES


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """The page's parts as (kind, name or text, attributes): text, open, close, raw (an element whose inside is skipped).
    Each place is looked at a bounded number of times: when the quotes of a tag never end, the rest of the page is read
    without them, and when there is no > left, the rest is text."""
    at, quotes, closing = 0, True, True
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            yield "text", page[at:end], ""
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        tag = TAG.match(page, at) if closing else None
        if tag is None:
            end = page.find(">", at) if closing and page[at + 1 : at + 2] in ("!", "?", "/") else -1
            if end < 0:
                closing = closing and page[at + 1 : at + 2] not in ("!", "?", "/")
                yield "text", "<", ""
            at = end + 1 if end >= 0 else at + 1
            continue
        end = tag.end()
        while quotes:
            m = QUOTE.search(page, end)
            if m is None:
                quotes = False
            elif m[0] == ">":
                end = m.start()
                break
            else:
                end = page.find(m[0], m.end()) + 1
                quotes = end > 0
        if not quotes:
            end = page.find(">", tag.end())
            if end < 0:
                closing = False
                continue
        name, attrs = tag[2].lower(), page[tag.end() : end]
        at = end + 1
        if tag[1]:
            yield "close", name, ""
        elif name in RAW:
            m = ENDS[name].search(page, at)
            at = m.end() if m else len(page)
            yield "raw", name, ""
        else:
            yield "open", name, attrs


def parse(page: str | None) -> tuple[list[tuple[int, str, bool, bool]], dict[int, tuple[list[str], bool]]]:
    """Blocks in page order as (node, text, furniture, inside an article or main element), and for each node its child
    sequence and whether it is inside. A node is the hash of its path, made from its parent's. Inline elements do not part
    a block; br does, as white space. The work is in proportion to the page: what is looked for on the stack is either
    counted, at a known place, or taken off."""
    # tag, node, furniture, inside, place of the topmost block element
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    opened: Counter[str] = Counter()
    blocks: list[tuple[int, str, bool, bool]] = []
    children: dict[int, tuple[list[str], bool]] = {}
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                blocks.append((stack[-1][1], whole, stack[-1][2], stack[-1][3]))

    def cut(place: int) -> None:
        opened.subtract(s[0] for s in stack[place:])
        del stack[place:]

    for kind, tag, attrs in scan(page or ""):
        if kind == "text":
            text.append(tag)
        elif kind == "raw":
            text.append(" " if tag == "noscript" else "")
        elif tag in INLINE:
            continue
        elif tag == "br":
            text.append(" ")
        elif kind == "close":
            flush()
            if tag == "p":
                place = stack[-1][4]
                if stack[place][0] == "p":
                    cut(place)
            elif opened[tag]:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
        else:
            flush()
            if tag in BLOCKS and stack[-1][0] == "p":
                cut(len(stack) - 1)
            closes = CLOSES.get(tag, ())
            if any(opened[t] for t in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in LISTS:
                        break
                    if stack[i][0] in closes:
                        cut(i)
                        break
            name, odd = _node(tag, attrs)
            _, node, furniture, inside, block = stack[-1]
            if tag == "header":
                odd = not inside
            children.setdefault(node, ([], inside))[0].append(name)
            if tag not in VOID and not attrs.endswith("/"):
                opened[tag] += 1
                stack.append((tag, _hash(f"{node}>{name}"), furniture or odd, inside or tag in ("article", "main"), len(stack) if tag in BLOCKS else block))
    flush()
    return blocks, children


def host_of(url: str | None) -> str:
    m = re.match(r"[^:]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, body, features for each distinct body of a host in the piece. A page has two bodies, what is inside an article
    or main element and what is not; the second one's hash covers the first too. Features are (path, kind, value): kind 0
    is the page's node (value: whether the path is inside an article), 1 its child sequence, 2 a text."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int64()), ("value", pa.int64())]))
    for batch in chunks(batches, 2):
        seen: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            host = _hash(host_of(url))
            blocks, children = parse(page)
            found = {(p, int(i), 0, int(i)) for p, (_, i) in children.items()} | {(p, int(i), 0, int(i)) for p, _, _, i in blocks}
            found |= {(p, int(i), 1, _hash("\n".join(c))) for p, (c, i) in children.items()}
            found |= {(p, int(i), 2, _hash(t)) for p, t, _, i in blocks}
            inner, outer = sorted(f for f in found if f[1]), sorted(f for f in found if not f[1])
            body = _hash(repr((inner, [t for _, t, _, i in blocks if i])))
            seen.setdefault((host, body), [(p, k, v) for p, _, k, v in inner])
            seen.setdefault((host, _hash(repr((body, outer, [t for _, t, _, _ in blocks])))), [(p, k, v) for p, _, k, v in outer])
        rows = [(h, b, [dict(zip(("path", "kind", "value"), f, strict=True)) for f in found]) for (h, b), found in seen.items() if found]
        hosts, bodies, found = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(bodies, pa.int64()), pa.array(found, kind)], names=["host", "body", "features"])


def _importance(features: DataFrame, keys: list[str]) -> DataFrame:
    """pages and importance of each node. Over m pages a child sequence's share p adds -p log_m p; a text on n pages
    counts 1 - log_m n for each of its occurrences; a node that has both takes the larger."""
    counts = features.groupBy(*keys, "kind", "value").agg(F.sum("n").alias("n"))
    log = F.when(F.col("n") > 1, F.log("n")).otherwise(0.0)
    part = lambda k, x: F.sum(F.when(F.col("kind") == k, x).otherwise(0))
    sums = counts.groupBy(*keys).agg(part(0, F.col("n")).alias("pages"), part(1, F.col("n")).alias("styles"), part(1, F.col("n") * log).alias("style_log"), part(2, F.col("n")).alias("texts"), part(2, F.col("n") * log).alias("text_log"), F.max(F.when(F.col("kind") == 0, F.col("value"))).alias("inside"))
    m = F.log("pages")
    style = F.when((F.col("styles") > 0) & (m > 0), (F.log("styles") - F.col("style_log") / F.col("styles")) / m).otherwise(0.0)
    leaf = F.when(F.col("texts") > 0, 1 - F.coalesce(F.when(m > 0, F.col("text_log") / F.col("texts") / m), F.lit(0.0))).otherwise(0.0)
    return sums.select(*keys, "pages", "texts", "inside", F.when(F.col("pages") > 1, F.greatest(style, leaf)).otherwise(1.0).alias("imp"))


def cut_nodes(pages: DataFrame) -> DataFrame:
    """host, path (hashes): the nodes with text whose importance, the host's shrunk towards all hosts', is under LEAST, or
    LEAST_INSIDE. A body that several pages of a host repeat counts once there, and one that several hosts repeat once
    for all hosts, so copies of an article do not make it boilerplate."""
    bodies = pages.mapInArrow(_bodies, "host long, body long, features array<struct<path:bigint,kind:bigint,value:bigint>>")
    bodies = bodies.groupBy("host", "body").agg(F.first("features").alias("features"))
    counted = lambda b, *keys: b.select(*keys, F.inline("features")).groupBy(*keys, "path", "kind", "value").agg(F.count("*").alias("n"))
    own = _importance(counted(bodies, "host"), ["host", "path"])
    once = bodies.groupBy("body").agg(F.first("features").alias("features"))
    every = _importance(counted(once), ["path"]).select("path", F.col("imp").alias("all_imp"), F.col("pages").alias("all_pages"))
    shrunk = (F.col("imp") * F.col("pages") + F.col("all_imp") * PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    least = F.when(F.col("inside") == 1, LEAST_INSIDE).otherwise(LEAST)
    return own.where("texts > 0").join(every, "path").where((F.col("all_pages") > 2) & (shrunk < least)).select("host", "path")


def extract_page(page: str | None, cut: set[int]) -> str:
    """The page's blocks that are neither furniture nor in a cut node, joined by one space. If a page has an article or main
    element, only what is inside counts."""
    kept = [(inside, t) for node, t, furniture, inside in parse(page)[0] if not furniture and node not in cut]
    return " ".join([t for inside, t in kept if inside] or [t for _, t in kept])


def _extract(held: dict[int, set[int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2):
            urls, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if held is None:
                cuts = [set(c or ()) for c in batch.column(3).to_pylist()]
            else:
                cuts = [held.get(_hash(host_of(u)), set()) for u in urls]
            texts = [extract_page(p, c) for p, c in zip(pages, cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def _host_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([_hash(host_of(u)) for u in b.column(1).to_pylist()], pa.int64())], names=["page_id", "url", "html", "host"])


def extract(pages: DataFrame, held: int = HELD) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html).

    Null and empty html, and pages of furniture only, give an empty text; null or odd urls form one host; repeated rows
    give repeated rows, equal pages of a host equal texts; a very long page takes time and memory in proportion to it; an
    empty table gives an empty table; other columns are ignored. The statistics cover the
    distinct bodies of all pages. Up to `held` cut nodes go to the tasks with the code; beyond that they are
    gathered by host and joined to the pages, a hot host being split by the adaptive skew join."""
    base = pages.select("page_id", "url", "html")
    kind = dict(base.dtypes)["page_id"]
    cut = cut_nodes(base)
    rows = cut.limit(held + 1).collect()
    if len(rows) <= held:
        by_host: dict[int, set[int]] = {}
        for r in rows:
            by_host.setdefault(r.host, set()).add(r.path)
        return base.mapInArrow(_extract(by_host), f"page_id {kind}, url string, text string")
    keyed = base.mapInArrow(_host_key, f"page_id {kind}, url string, html string, host long")
    joined = keyed.join(cut.groupBy("host").agg(F.collect_list("path").alias("cut")), "host", "left")
    return joined.select("page_id", "url", "html", "cut").mapInArrow(_extract(None), f"page_id {kind}, url string, text string")
