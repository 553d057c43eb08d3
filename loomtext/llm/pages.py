"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host, URL path and id, so that each stands beside those whose paths are nearest. A page's text
lines are aligned by longest common subsequence with those of the nearest page before and after that differs from
it, and shared lines are deleted, on every page. Element names break ties: what stands in an article or main element
is not deleted for being shared, as near copies share their text; and a line that differs from page to page, as
menus, adverts and footers may, goes if its elements name it as such, or if the page has an article and it stands
beside it. ``n_shared``, ``n_named`` and ``n_beside`` count what each rule removed; a line counts for the first.

The order is cut into parts at pages chosen by a hash of their place, about PAGES_PER_PART pages apart. With each part
comes the last page before it that differs from its first, and the first page after it that differs from its last: a
first pass digests the lines of every page, and the runs at the parts' ends tell how far back or on that page stands,
over as many parts as a run of copies fills. So a host or a run of copies of any size is spread, and the result is the
same wherever the cuts fall. A task holds one run of copies (their ids, and the lines once) and two pages. A page whose
lines another holds all is told nothing by that one.

Nulls: a null html is empty, a null url has the empty host and path. Equal rows are copies. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.storage import Scratch, map_batches, only

#: Element names of HTML by what they do here.
_RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("nav menu footer aside form dialog search button head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id attributes that name furniture.
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar toolbar footer sidebar ad ads advert adverts advertisement adsense banner "
    "promo sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup social share sharing "
    "comment comments disqus respond replies reply related recommended widget login search pagination pager skip".split()
)
#: Beginnings of such words.
_BEGINNINGS = ("navbar", "navig", "advert", "sidebar", "footer", "comment", "cookie", "newsletter", "sponsor", "promo", "breadcrumb", "popup", "disqus", "masthead")
_CLOSES_P = _BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "caption", "summary", "figcaption"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


#: Pages of a part, on average; more where a table would have over about MOST_PARTS parts, whose bounds pass through the driver.
PAGES_PER_PART, MOST_PARTS = 250, 4000


class Line(NamedTuple):
    text: str
    furniture: bool
    article: bool


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in _FURNITURE or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if key not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        words = set(re.split(r"[^a-z0-9]+", f"{value} {_CAMEL.sub(' ', value)}".lower()))
        if key == "hidden" or key == "aria-hidden" and "true" in words or key == "role" and words & _ROLES:
            return True
        if key in ("class", "id") and (words & _NAMES or any(w.startswith(_BEGINNINGS) for w in words) or "header" in words and not in_article):
            return True
    return False


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, white space folded, each with what its elements say of it."""
    out: list[Line] = []
    held: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # element, furniture, article; what holds for all within

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(Line(text, *(open_[-1][1:] if open_ else (False, False))))

    def close(to: int):
        flush()
        del open_[to:]

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        if not tag:
            held.append(page[at:])
            break
        held.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    close(i)
                    break
            else:
                if name in _BLOCK:
                    flush()
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            held.append(" ")
            if name == "hr":
                flush()
            continue
        furniture, article = open_[-1][1:] if open_ else (False, False)
        if name in _BLOCK:
            flush()
            ends = _SIBLINGS.get(name, ()) + (("p",) if name in _CLOSES_P else ())
            if open_ and open_[-1][0] in ends:
                close(len(open_) - 1)
                furniture, article = open_[-1][1:] if open_ else (False, False)
        marked = _is_furniture(name, tag[3], article)
        if tag[3].rstrip().endswith("/") and name not in _BLOCK:
            continue
        if name in _BLOCK or marked:
            if name not in _BLOCK:
                flush()
            open_.append((name, furniture or marked, article or name in ("article", "main")))
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``.

    Equal ends belong to one in any case. Between them, lines that the other side lacks are left out, and the rest is
    solved over its matches if they are few, and by bit vectors if lines recur very often; both are exact.
    """
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    inner_b = b[low : len(b) - high]
    known = set(inner_b)
    place = [i for i in range(low, len(a) - high) if a[i] in known]
    known = {a[i] for i in place}
    rest_a, rest_b = [a[i] for i in place], [x for x in inner_b if x in known]
    times = Counter(rest_b)
    few = sum(times[x] for x in rest_a) <= 16 * (len(rest_a) + len(rest_b))
    return out | {place[i] for i in (_by_matches if few else _by_bits)(rest_a, rest_b)}


def _by_matches(a: list[str], b: list[str]) -> set[int]:
    """A longest increasing run over all matches."""
    places: dict[str, list[int]] = {}
    for j, text in enumerate(b):
        places.setdefault(text, []).append(j)
    ends: list[int] = []
    chain: list[tuple[int, tuple | None]] = []
    for i, text in enumerate(a):
        for j in reversed(places.get(text, ())):
            k = bisect_left(ends, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[k], chain[k] = j, node
    out, node = set(), chain[-1] if chain else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _by_bits(a: list[str], b: list[str]) -> set[int]:
    """Rows of the table of lengths as bit vectors, a bit for each of ``a``; every so many rows are kept and the others made again on the way back."""
    masks: dict[str, int] = {}
    for i, text in enumerate(a):
        masks[text] = masks.get(text, 0) | 1 << i
    full, every = (1 << len(a)) - 1, isqrt(len(b)) + 1

    def after(row: int, text: str) -> int:
        met = row & masks[text]
        return ((row + met) | (row - met)) & full

    row, kept = full, []
    for j, text in enumerate(b):
        if j % every == 0:
            kept.append(row)
        row = after(row, text)
    out, i, j, rows = set(), len(a), len(b), {len(b): row}
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if j not in rows:
            first = j // every * every
            rows = {first: kept[j // every]}
            for k in range(first, j):
                rows[k + 1] = after(rows[k], b[k])
        if not j or rows[j] >> (i - 1) & 1:
            i -= 1
            out.add(i)
    return out


def main_lines(own: list[Line], neighbours: list[list[Line]]) -> tuple[list[str], tuple[int, int, int]]:
    """The lines of the main text, and how many were deleted as shared, as named and as beside an article."""
    texts, shared = [x.text for x in own], set()
    for other in neighbours:
        found = common_lines(texts, [x.text for x in other])
        if len(found) < len(texts):  # a page that another holds whole is told nothing by it
            shared |= found
    told = any(x.article and not x.furniture for x in own)
    kept, gone = [], [0, 0, 0]
    for i, x in enumerate(own):
        inside = x.article and not x.furniture
        if i in shared and not inside:
            gone[0] += 1
        elif x.furniture:
            gone[1] += 1
        elif told and not inside:
            gone[2] += 1
        else:
            kept.append(x.text)
    return kept, tuple(gone)


_OUT = "page_id long, url string, text string, n_chars long, n_shared long, n_named long, n_beside long"
#: Characters of results that are gathered before they are passed on.
FLUSH_CHARS = 1 << 20


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads parts in order. A run of pages with equal lines is done once a page that differs, or the part's end, is met."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), *(pa.int64(),) * 4)
    part, before, run, members, rows, held = None, None, None, [], [], 0

    def done(after):
        nonlocal held
        if members:
            sides = [p[1] for p in (before, after) if p is not None and p[0] == run[0]]
            kept, gone = main_lines(run[1], sides)
            text = "\n".join(kept)
            held += len(text) * len(members)
            rows.extend((page_id, url, text, len(text), *gone) for page_id, url in members)
            members.clear()

    def batch_of():
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        rows.clear()
        held = 0
        return out

    for batch in batches:
        for at, role, page_id, host, url, page in zip(*(batch.column(c).to_pylist() for c in ("part", "role", "page_id", "host", "url", "html"))):
            if at != part:
                done(None)
                part, before, run = at, None, None
            now = (host, lines(page or ""))
            if run is None or now != run:
                done(now)
                before, run = run, now
            if role == 1:
                members.append((page_id, url))
            if held > FLUSH_CHARS:
                yield batch_of()
    done(None)
    if rows:
        yield batch_of()


def _part_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are not above the key, by halving."""
    given = F.split(F.lit(",".join(bounds)), ",") if bounds else F.array().cast("array<string>")

    def halve(s, _):
        middle = F.shiftright(s["low"] + s["high"], 1)
        upper, lower = F.struct((middle + 1).alias("low"), s["high"].alias("high")), F.struct(s["low"].alias("low"), middle.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(F.get(given, middle) <= key, upper).otherwise(lower)

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda s: s["low"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each page's host and lines: equal ones are copies."""
    for batch in batches:
        host, page = (batch.column(c).to_pylist() for c in ("host", "html"))
        made = [hashlib.blake2b(repr((h, lines(p or ""))).encode("utf-8", "surrogatepass"), digest_size=16).digest() for h, p in zip(host, page)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copy"), pa.array(made, pa.binary())], ["key", "copy", "lines"])


def _carried(ends: dict[int, dict], parts: int) -> list[tuple[str, int, int, int]]:
    """key, copy, part and role of the pages that parts need from others: of each part's ends, the nearest page beyond that differs.

    ends: of each part that has pages, the place and the lines of its first and last page, and the places of the last page
    that differs from the last (``tail``) and of the first that differs from the first (``head``).
    """
    out = []
    for step, role, edge, far, inner in ((1, 0, "first", "last", "tail"), (-1, 2, "last", "first", "head")):
        seen: dict | None = None  # of the parts passed so far, the nearest with pages
        found: tuple | None = None  # the nearest page that differs from the page at the end of ``seen``
        for part in range(parts) if step > 0 else range(parts - 1, -1, -1):
            own = ends.get(part)
            if own is None:
                continue
            before = None
            if seen is not None:
                before = seen[far] if seen[f"{far}_lines"] != own[f"{edge}_lines"] else found
            if before is not None:
                out.append((*before, part, role))
            found = own[inner] if own[inner] is not None else before
            seen = own
    return out


def extract(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, and the lines removed: n_shared, n_named, n_beside."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    placed = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), path.alias("path"))
    number = F.lpad(F.hex(F.coalesce("page_id", F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    key = F.hex(F.concat("host", F.lit("\x00"), "path", F.lit("\x00"), number))  # its order is that of host, path and id
    placed = placed.withColumn("key", key).withColumn("copy", F.xxhash64("url", "html"))
    scratch = Scratch()
    slim = scratch.settle(map_batches(placed.select("key", "copy", "host", "html"), _digests, "key string, copy long, lines binary"), "page-digests")
    apart = max(pages_per_part, slim.count() // MOST_PARTS)
    bounds = sorted(r[0] for r in slim.filter(F.pmod(F.xxhash64("key"), F.lit(apart)) == 0).select("key").distinct().collect())
    part, place = _part_of(F.col("key"), bounds), F.struct("key", "copy")
    ends = slim.groupBy(part.alias("part")).agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.min_by("lines", place).alias("first_lines"), F.max_by("lines", place).alias("last_lines")
    )
    ends = scratch.settle(ends, "page-ends")  # a row a part
    differs = lambda side: F.when(F.col("lines") != F.col(f"{side}_lines"), F.struct("key", "copy"))
    inner = slim.withColumn("part", part).join(F.broadcast(ends.select("part", "first_lines", "last_lines")), "part").groupBy("part").agg(F.min(differs("first")).alias("head"), F.max(differs("last")).alias("tail"))
    known = {r["part"]: r.asDict() for r in ends.join(inner, "part").collect()}
    carried = pages.sparkSession.createDataFrame(_carried(known, len(bounds) + 1), "key string, copy long, part int, role int")
    scratch.drop()
    whose = carried.groupBy("key", "copy").agg(F.collect_list(F.struct("part", "role")).alias("more"))  # at most two rows a part
    dealt = placed.join(F.broadcast(whose), ["key", "copy"], "left").withColumn("own", F.array(F.struct(part.cast("int").alias("part"), F.lit(1).alias("role"))))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("more").isNull(), F.col("own")).otherwise(F.concat("own", "more"))))
    ordered = dealt.select("to.part", "to.role", "page_id", "host", "url", "html", "key", "copy").repartition("part").sortWithinPartitions("part", "role", "key", "copy")
    return map_batches(ordered.drop("key", "copy"), _extract, _OUT)
