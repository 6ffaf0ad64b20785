"""Main text of web pages by differencing with the page of the nearest URL, judged by structure.

1. A page becomes text lines, one per block, each with its zone: `frame` inside menus, headers, footers, sidebars, notices,
   adverts, forms and comments, `main` inside <article> or <main>, else `loose`. Scripts, styles and the like are no lines.
2. Pages of a host are ordered by path; a page is paired with the neighbour that has the longer common path prefix (the
   one before it, if equal), so no other page of its host is nearer. All pages are dealt by ranges of (host, path), whose
   first and last rows go to the ranges beside them too: a large host is split and no pair is lost.
3. All lines of the pair are aligned by longest common subsequence, and the shared ones are deleted: what two neighbours
   repeat in the same order is the site's frame. The article itself may be syndicated, or quote a passage that others
   quote: its lines are deleted only if the neighbours on both sides have them, and neither shares half of its text.
4. Of what is left, lines of the frame zone go too: those that differ from page to page, such as comments. Beside a main
   zone, loose lines stay if they have more text than it: then the page's body is not what it put into <article>. A
   page that would lose all its lines keeps those outside of the frame.

Defined results: null html is an empty text; a null or odd URL is a host of its own name; repeated rows with equal URLs
pair with each other; very long pages take memory in proportion to their lines; columns of other names are left out; an
empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, tidy

#: Elements without text of the page, and elements of its frame. Fixed words of the markup language.
RAW = ("script", "style", "template", "noscript", "textarea", "title", "svg", "iframe", "object", "canvas", "math", "select")
FRAME = ("nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "head", "fieldset")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of class, id or role that name a part of the frame.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|aside|footer|header|masthead|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|share|social|related|comments?|comment-list|disqus|replies|widget|pagination|pager|login|search|toolbar|copyright|legal|disclaimer|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: An article, or a part of one, is of the frame if a whole class name says so, or one of its items: a story may well be called
#: "has-sidebar", and a paragraph in it "share-price".
_FRAMED = re.compile(
    r"(?:^|\s)(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|footer|cookies?|consent|popup|modal|related|comments?|comment-list|disqus|replies|reply|widget|newsletter|subscribe|signup|share|social|pagination|pager|toolbar)(?:[_-]+(?:\d+|item|card|block|box|teaser|post|entry|body|list|article|story|links?|buttons?|bar|form|section|thread))*(?:$|\s)",
    re.I,
)
#: A quote that is not closed before the end of the page is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|$)", re.S)
#: Zones of lines.
LOOSE, MAIN, IN_FRAME = 0, 1, 2
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_CLOSE_RAW = {name: re.compile(rf"</{name}\s*(?:>|$)|$(?![\s\S])", re.I) for name in RAW}


def lines(page: str) -> tuple[list[str], list[int]]:
    """(text of each block, its zone)."""
    out, zones = [], []
    stack: list[tuple[str, bool, bool]] = []  # name, frame, main
    frame = zone = 0
    part: list[str] = []
    pos, n = 0, len(page)

    def end_block() -> None:
        nonlocal part
        if part:
            text = _SPACE.sub(" ", html.unescape("".join(part))).strip()
            if text:
                out.append(text)
                zones.append(IN_FRAME if frame else MAIN if zone else LOOSE)
            part = []

    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            part.append(page[pos:])
            break
        if m.start() > pos:
            part.append(page[pos : m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                part.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name not in INLINE:
            end_block()
        elif name == "br":
            part.append(" ")
        if m[1]:
            if any(name == s[0] for s in reversed(stack)):
                while True:
                    top, was_frame, was_main = stack.pop()
                    frame -= was_frame
                    zone -= was_main
                    if top == name:
                        break
            continue
        if name in _CLOSE_RAW:
            close = _CLOSE_RAW[name].search(page, pos)
            pos = close.end() if close else n
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        named = " ".join(x for t in _NAMED.findall(m[3]) for x in t if x) if "=" in m[3] else ""
        # An article has a header of its own, with its title.
        is_frame = name in FRAME and not (zone and name == "header") or bool(named and name not in ("html", "body", "main") and (_FRAMED if zone or name == "article" else MARKED).search(named))
        is_main = name in ("article", "main")
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # closed by the next of their kind
            if stack and stack[-1][0] == name:
                _, was_frame, was_main = stack.pop()
                frame -= was_frame
                zone -= was_main
        stack.append((name, is_frame, is_main))
        frame += is_frame
        zone += is_main
    end_block()
    return out, zones


def shared(a: list[str], b: list[str]) -> list[bool]:
    """For each line of a, whether it is in a longest common subsequence with b. A row of the table is a number with a bit per
    line of b, clear where the subsequence grows; every so many rows one is kept, and the rows between are made again on the
    way back, so memory is as the root of the lines times the lines."""
    both = set(a) & set(b)
    at = [i for i, s in enumerate(a) if s in both]
    x, y = [a[i] for i in at], [s for s in b if s in both]
    out = [False] * len(a)
    where: dict[str, int] = {}
    for j, s in enumerate(y):
        where[s] = where.get(s, 0) | 1 << j
    full = (1 << len(y)) - 1

    def rows(v: int, part: list[str]) -> list[int]:
        made = [v]
        for s in part:
            hit = v & where[s]
            v = ((v + hit) | (v - hit)) & full
            made.append(v)
        return made

    step = max(1, int(len(x) ** 0.5))
    kept = [full]
    for i in range(0, len(x), step):
        kept.append(rows(kept[-1], x[i : i + step])[-1])
    j = len(y)
    for k in range(len(kept) - 2, -1, -1):
        part = x[k * step : (k + 1) * step]
        table = rows(kept[k], part)
        for i in range(len(part) - 1, -1, -1):
            left = (1 << j) - 1
            if (table[i] & left).bit_count() > (table[i + 1] & left).bit_count():  # longer with this line, so by its last match
                j = (where[part[i]] & left).bit_length() - 1
                out[at[k * step + i]] = True
    return out


def prefix(a: str | None, b: str | None) -> int:
    if a is None or b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


KEY = ("host", "path", "_id", "_tie")


def key_columns(page_id: str, url: str, page: str) -> list[Column]:
    """Host, path, id and hash of the page: the order of pages, without nulls."""
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    return [x.alias(k) for k, x in zip(KEY, (host, path, F.coalesce(F.col(page_id).cast("long"), F.lit(-(2**63)).cast("long")), F.xxhash64(F.col(url).cast("string"), F.col(page).cast("string"))))]


def ranges(keys: DataFrame, n: int) -> tuple[list[tuple], dict[int, tuple[tuple, tuple]]]:
    """(keys that begin a range, range -> its least and its greatest key), for about n ranges that are not empty. The driver
    holds some keys per range."""
    every = max(1, keys.count() // (8 * n))
    sample = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64(*KEY), F.lit(every)) == 0).select(*KEY).collect()) if n > 1 else []
    starts = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        for b in batches:
            for k in zip(*(c.to_pylist() for c in b.columns)):
                i = bisect.bisect_right(starts, k)
                least, most = found.setdefault(i, [k, k])
                found[i] = [min(least, k), max(most, k)]
        rows = [(i, *k) for i, ks in found.items() for k in ks]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["_range", *KEY])

    whole = F.struct(*KEY)
    found = keys.select(*KEY).mapInArrow(tidy(bounds), "_range long, host string, path string, _id long, _tie long").groupBy("_range").agg(F.min(whole).alias("a"), F.max(whole).alias("z"))
    return starts, {r._range: (tuple(r.a), tuple(r.z)) for r in found.collect()}


def main_text(ls: list[str], zones: list[int], nearest: list[str] | None, other: list[str] | None) -> tuple[str, int]:
    """(text of a page, lines that differencing deleted) from its lines, their zones and its neighbours' lines."""
    near, far = shared(ls, nearest or []), shared(ls, other or [])
    size = lambda use: sum(len(t) for t, u in zip(ls, use) if u)
    main = [z == MAIN for z in zones]
    # A neighbour with half of the article has a copy of it.
    copies = [2 * size([m and s for m, s in zip(main, one)]) >= size(main) for one in (near, far)]
    deleted = [s and (not m or t and not any(copies)) for s, t, m in zip(near, far, main)]
    stays = [not d and z != IN_FRAME for d, z in zip(deleted, zones)]
    left = {zone: size([k and z == zone for k, z in zip(stays, zones)]) for zone in (MAIN, LOOSE)}
    kept = [t for t, k, z in zip(ls, stays, zones) if k and (z == MAIN or left[LOOSE] > left[MAIN])]
    return "\n".join(kept or [t for t, z in zip(ls, zones) if z != IN_FRAME]), sum(deleted)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", range_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that differencing deleted) of each row of pages."""
    d = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), *key_columns(page_id, url, page), F.col(page).cast("string").alias("html"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).head()[0]
    starts, ends = ranges(d.select(*KEY), max(1, -(-size // range_bytes)))
    order = sorted(ends)
    beside = {i: (a, z) for i, a, z in zip(order, [None, *order], [*order[1:], None])}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int8()))
        for b in slices(batches, "html"):
            rows = []
            for one, address, *key, text in zip(*(c.to_pylist() for c in b.columns)):
                own, key = lines(text) if text else ([], []), tuple(key)
                at = bisect.bisect_right(starts, key)
                rows.append((one, address, *key, at, False, *own))
                rows += [(one, address, *key, to, True, *own) for to, end in zip(beside[at], ends[at]) if to is not None and key == end]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=["page_id", "url", *KEY, "_range", "_guest", "lines", "zones"])

    parsed = d.mapInArrow(tidy(parse), "page_id long, url string, host string, path string, _id long, _tie long, _range long, _guest boolean, lines array<string>, zones array<byte>")
    near = W.partitionBy("_range").orderBy(*KEY)
    own = lambda f, c: F.when(f("host").over(near) == F.col("host"), f(c).over(near))
    paired = parsed.select("page_id", "url", "path", "lines", "zones", own(F.lag, "path").alias("p1"), own(F.lag, "lines").alias("l1"), own(F.lead, "path").alias("p2"), own(F.lead, "lines").alias("l2"), "_guest").where("not _guest").drop("_guest")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            for _, _, path, ls, zones, p1, l1, p2, l2 in zip(*(c.to_pylist() for c in b.columns)):
                text, n = main_text(ls, zones, *((l1, l2) if prefix(path, p1) >= prefix(path, p2) else (l2, l1)))
                texts.append(text)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_shared"])

    return paired.mapInArrow(tidy(difference), "page_id long, url string, text string, n_chars long, n_shared long")
