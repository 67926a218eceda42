"""Main text of web pages: nearest-URL page differencing, helped by markup.

Pages are ordered by (host, path, page_id) and dealt by ranges of that order, so a host of any size is spread over many
tasks; the first and the last page of a range also go to the range beside it, where they serve as neighbours only. Each
page becomes text lines, one per block. It is paired with the neighbour whose path shares the longer prefix (ties: the
one before); a neighbour with the very same lines is a copy and tells nothing, so the next page beyond the copies takes
its place. The two pages' lines are aligned by a longest common subsequence, and shared lines are deleted. Markup helps
in two ways: blocks that name themselves menus, headers, footers, sidebars, notices, adverts, forms or reader comments go
even where the neighbour does not share them, and lines of an <article> or <main> element stay even where it does
(a copied passage is content). Inside such an element only adverts, comments, menus and forms go; an <article> within an
<article> is a comment. If the lines outside that are left hold more characters than those inside, they stay too;
else the element is the article.

Null html gives an empty text. A null or malformed url has no host; such pages are neighbours only of each other. A page
alone in its host loses no lines to differencing. Repeated rows are separate copies. An empty table gives an empty
result. Columns other than page_id, url and html are ignored. Tokenising takes time in proportion to the page. The common
subsequence is a longest one however often lines repeat: where few pairs of lines match it takes time in proportion to
them, else a bit for each pair of lines left between the pages' equal heads and tails. The result depends on the ranges in one case: where copies reach over the edge of
a range, the page beyond them is not seen.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import whole

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag; possessive, so a tag that does not end fails in one pass.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ROLE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "title")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HIDDEN = set("head button select canvas object".split())
_CLUTTER = set("nav footer aside form dialog menu".split())
_MAIN = {"article", "main"}
_CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "body": {"head"}}
#: Parts of class names, ids and roles that mark clutter: anywhere, and outside the main element only.
_ALWAYS = set("ad ads advert adverts advertisement sponsored comment comments commentlist disqus respond responses replies".split())
_OUTSIDE = set(
    "banner breadcrumb breadcrumbs contentinfo cookie cookies consent footer header masthead menu modal nav navbar navigation newsletter notice notices popup"
    " promo related search share sharing sidebar social sponsor sponsors subscribe toolbar topbar".split()
)
PLAIN, MAIN, CLUTTER = 0, 1, 2
#: Matching pairs for a line of the page, beyond which pages are aligned by rows of bits.
PAIRS = 8
#: Bits of remembered rows of matches; others are made again.
MASK_BITS = 1 << 28


def _tokens(html: str) -> Iterator[tuple[str, str]]:
    """("", text), (tag, rest of a start tag) and ("/" + tag, "") in order, without comments, declarations and the
    content of raw elements. Where a tag's quotes do not close, tags end at the next > from there on; where no > follows,
    the rest is text."""
    at, quoted, open_tags, n = 0, True, True, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or not open_tags:
            yield "", html[at:]
            return
        if lt > at:
            yield "", html[at:lt]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(html, lt)
        if m is None:
            end = html.find(">", lt) if html.startswith(("<!", "<?", "</"), lt) else -1
            if end < 0:
                yield "", "<"
                at = lt + 1
            else:
                at = end + 1
            continue
        rest = _REST.match(html, m.end()) if quoted else None
        if rest is None:
            quoted = False
            end = html.find(">", m.end())
            if end < 0:
                open_tags, at = False, lt
                continue
            at, attributes = end + 1, html[m.end() : end]
        else:
            at, attributes = rest.end(), rest[0][:-1]
        tag = m[1].lower()
        if html[lt + 1] == "/":
            yield "/" + tag, ""
            continue
        if tag in _RAW and not attributes.endswith("/"):
            end = _RAW[tag].search(html, at)
            at = end.end() if end else n
            continue
        yield tag, attributes


def _names(attributes: str) -> tuple[set[str], bool]:
    """The parts of class names, ids and roles; whether the role is main."""
    names: set[str] = set()
    main = False
    for kind, *values in _ROLE.findall(attributes):
        value = "".join(values)
        main |= kind.lower() == "role" and value.strip().lower() == "main"
        names.update(x.lower() for x in _NAME.findall(value))
        names.update(x.lower() for x in value.split())
    return names, main


def page_lines(html: str | None) -> list[tuple[int, str]]:
    """(PLAIN, MAIN or CLUTTER, text) of each block that can be seen, in page order."""
    lines: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, hidden, clutter, main
    hidden = clutter = main = False

    def flush() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                lines.append((CLUTTER if clutter else MAIN if main else PLAIN, line))
            text.clear()

    for tag, rest in _tokens(html or ""):
        if not tag:
            if not hidden:
                text.append(rest)
            continue
        name = tag.lstrip("/")
        if name in _INLINE:
            if name in ("br", "img") and text:
                text.append(" ")
            continue
        flush()
        if tag[0] == "/":
            for k in range(len(stack) - 1, max(-1, len(stack) - 200), -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif tag not in _VOID and not rest.endswith("/"):
            closes = _CLOSES.get(tag, ())
            while stack and (stack[-1][0] == "p" or stack[-1][0] in closes):
                stack.pop()
            up = stack[-1] if stack else ("", False, False, False)
            names, role = _names(rest) if rest else (set(), False)
            own = tag in _MAIN or role
            marked = bool(names & _ALWAYS) or (not up[3] and not own and bool(names & _OUTSIDE))
            gone = tag in _CLUTTER or (tag == "header" and not up[3]) or (tag == "article" and any(x[0] == "article" for x in stack[-200:]))
            stack.append((tag, up[1] or tag in _HIDDEN, up[2] or gone or (marked and tag not in ("html", "body")), up[3] or own))
        hidden, clutter, main = stack[-1][1:] if stack else (False, False, False)
    flush()
    return lines


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b: over matching pairs (Hunt and Szymanski), or over rows of
    bits where there are more than PAIRS of them for a line of a."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    if sum(len(where.get(line, ())) for line in a) > PAIRS * len(a):
        return _common_dense(a, b)
    ends: list[int] = []
    nodes: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    out, node = set(), nodes[-1] if nodes else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _common_dense(a: list[str], b: list[str]) -> set[int]:
    """The same where many lines repeat. Equal heads and tails belong to a longest common subsequence. Of the rest, row i
    is a number whose bit j is 0 where the subsequence with a[: i + 1] grows at b[j] (Hyyro); about the root of the rows
    are kept, and those between are made again on the way back."""
    head, tail, most = 0, 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    here, there = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    rows = [i for i in range(head, len(a) - tail) if a[i] in there]
    right = [line for line in b[head : len(b) - tail] if line in here]
    if not rows:
        return out
    size = len(right)
    full = (1 << size) - 1
    where: dict[str, list[int]] = {}
    for j, line in enumerate(right):
        where.setdefault(line, []).append(j)
    masks: dict[str, int] = {}

    def mask(line: str) -> int:
        if line in masks:
            return masks[line]
        bits = np.zeros(size, bool)
        bits[where[line]] = True
        made = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(masks) * size < MASK_BITS:
            masks[line] = made
        return made

    def after(row: int, i: int) -> int:
        both = row & mask(a[i])
        return ((row + both) | (row - both)) & full

    step = isqrt(len(rows)) + 1
    kept, row = [], full
    for n, i in enumerate(rows):
        if n % step == 0:
            kept.append(row)
        row = after(row, i)
    j = (row ^ full).bit_length() - 1
    for lo in range((len(kept) - 1) * step, -1, -step):
        block = [kept[lo // step]]
        part = rows[lo : lo + step]
        for i in part[:-1]:
            block.append(after(block[-1], i))
        for i, before in zip(reversed(part), reversed(block), strict=True):
            if j >= 0 and a[i] == right[j]:
                out.add(i)
                j = ((before ^ full) & ((1 << j) - 1)).bit_length() - 1
    return out


def article(lines: list[tuple[int, str]], partner: list[tuple[int, str]] | None) -> tuple[str, int, int]:
    """(text, lines outside the main element that the partner shares, lines that go for their markup alone)."""
    shared = common_lines([x for _, x in lines], [x for _, x in partner]) if partner else set()
    outside = [k for k, (kind, _) in enumerate(lines) if kind == PLAIN and k not in shared]
    inside = [k for k, (kind, _) in enumerate(lines) if kind == MAIN]
    size = lambda own: sum(len(lines[k][1]) for k in own)
    kept = inside if inside and size(inside) >= size(outside) else sorted(inside + outside)
    n_shared = sum(lines[k][0] != MAIN for k in shared)
    return "\n".join(lines[k][1] for k in kept), n_shared, sum(kind == CLUTTER and k not in shared for k, (kind, _) in enumerate(lines))


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _key(host: str, path: str, page_id) -> tuple:
    return host, path, page_id is not None, page_id if page_id is not None else 0


def _dealer(ranges: list[tuple[tuple, tuple]]):
    """Rows -> rows with the number of their range; first and last pages also, as ghosts, to the range beside theirs."""
    starts, ends = [x[0] for x in ranges], [x[1] for x in ranges]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, to, ghosts = [], [], []
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_id")), strict=True)):
                key = _key(*key)
                own = bisect_right(starts, key) - 1
                for part, ghost in ((own, False), (own - 1, True), (own + 1, True)):
                    if not ghost or (part >= 0 and part < own and key == starts[own]) or (own < part < len(starts) and key == ends[own]):
                        at.append(k)
                        to.append(part)
                        ghosts.append(ghost)
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(ghosts, pa.bool_()), *out.columns], ["part", "ghost", *batch.schema.names])

    return deal


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, host, path, page_id) -> rows with text. Holds the lines of three different pages at a
    time; pages with the same lines side by side are one run."""

    def runs():
        """((part, host), lines, [(page_id, url, path, ghost)]) of equal pages side by side."""
        held = None
        for batch in batches:
            for part, ghost, page_id, url, host, path, html in zip(*batch.columns, strict=True):
                place, lines = (part.as_py(), host.as_py()), page_lines(html.as_py())
                own = (page_id, url, path.as_py(), ghost.as_py())
                if held and held[0] == place and held[1] == lines:
                    held[2].append(own)
                    continue
                if held:
                    yield held
                held = (place, lines, [own])
        if held:
            yield held

    def done(run, before, after):
        place, lines, pages = run
        near = [x for x in (before, after) if x and x[0] == place]
        made: dict[int, tuple] = {}
        for page_id, url, path, ghost in pages:
            if ghost:
                continue
            which = max(range(len(near)), key=lambda k: _near(path, near[k][2][0 if near[k] is after else -1][2])) if near else -1
            if which not in made:
                made[which] = article(lines, near[which][1] if near else None)
            text, shared, marked = made[which]
            yield page_id.as_py(), url.as_py(), text, len(text), len(lines), shared, marked

    def rows():
        before = run = None
        for after in runs():
            if run:
                yield from done(run, before, after)
            before, run = run, after
        if run:
            yield from done(run, before, None)

    def batch_of(held):
        kinds = [kind, pa.string(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_marked"])

    held: list[tuple] = []
    first = next(batches, None)
    if first is None:
        return
    kind, rest = first.schema.field("page_id").type, batches

    def again():
        yield first
        yield from rest

    batches = again()
    for row in rows():
        held.append(row)
        if len(held) == 500:
            yield batch_of(held)
            held = []
    if held:
        yield batch_of(held)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_lines (blocks that can be seen), n_shared (those outside the main
    element that the paired page shares), n_marked (those that go for their markup alone)."""
    host = F.lower(F.regexp_extract(whole("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(whole("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    keyed = pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    order = ["host", "path", "page_id"]
    place = F.struct(*order)
    # Two keys a partition reach the driver.
    own = keyed.select(*order).repartitionByRange(*order).groupBy(F.spark_partition_id().alias("_part")).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    ranges = sorted((_key(*r.lo), _key(*r.hi)) for r in own.collect())
    kind = pages.schema["page_id"].dataType.simpleString()
    dealt = keyed.mapInArrow(_dealer(ranges), f"part int, ghost boolean, page_id {kind}, url string, host string, path string, html string")
    laid = dealt.repartition("part").sortWithinPartitions("part", *order)
    return laid.mapInArrow(_pair, f"page_id {kind}, url string, text string, n_chars long, n_lines long, n_shared long, n_marked long")
