"""Main text of web pages by nearest-URL page differencing.

Every page is cut into its text lines, one for each block element, menus and
footers with them, and paired with the page of its host whose URL path is
nearest: of the two beside it in the order of (host, path, page_id), the one
with the longer common beginning of the path.  Pages with equal lines of
content tell nothing of each other and are passed over.  The lines of a pair
are aligned by a longest common subsequence, and those that both pages have
are template lines.

Then each line's markup is checked, as differencing alone is wrong on both
counts: pages of a host share sentences and whole articles, and adverts and
footers differ from page to page.  ``page_blocks`` tells what a line is:

* MAIN, of the main element (article or main): it stays, shared or not;
* FREE, in a page that marks no main element: it stays if it is not shared;
* OUT: menus, headers, footers, asides, forms, adverts, notices, comments and
  what is beside a main element; it goes, shared or not;
* DOUBT and more, one number an element: within a main element, but with a
  class or id that an article may use for parts of its own (menu, alert,
  share).  The element goes if half of its characters are in links, or if all
  its lines are shared while most MAIN lines are not, so that the pages do not
  hold one article.

Pages move as 64-bit codes of their lines.  A range sort by (host, path,
page_id) deals out a host of very many pages and brings partners together
without a join; the driver joins the ends of its partitions, four pages each.
Texts are exchanged once, packed, to meet the codes of the partner.

Defined results: null or empty html gives an empty text; a null or odd URL has
an empty host; pages are never dropped; repeated rows, equal URLs and ties of
path go by page id, and a page is never paired with one of its own id, nor is
one without id; an empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from os.path import commonprefix
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm.shelf import Shelf

MAIN, FREE, OUT, DOUBT = range(4)
#: What markup says of an element: it stays, it goes, its links or the neighbour decide, the neighbour decides.
_STAYS, _GOES, _LINKS, _SHARED = range(4)

_token = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comment
    r"|<(?P<raw>script|style|template|svg|iframe|textarea|title|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_attribute = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_void = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_inline = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mrow mi mn mo ms mtext msup msub mfrac msqrt mstyle semantics annotation object".split())
_headings = frozenset("h1 h2 h3 h4 h5 h6".split())
_named_blocks = _headings | {"p", "li", "header", "article"}
_left_out = frozenset("nav header footer aside form head button dialog menu fieldset audio video canvas".split())
_roles = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of elements that are boilerplate wherever they stand, and names that an article may use for parts of its own.
_sure = re.compile(r"^(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|cookies?\w*|consent\w*|gdpr|notices?|notification\w*|newsletter\w*|subscri\w*|comments?|disqus)$")
#: The same of containers alone.
_sure_around = re.compile(r"^related$")
_doubtful = re.compile(
    r"^(?:banner\w*|side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|alert|popup|modal|overlay"
    r"|share|sharing|social|replies|reply|respond|recommend\w*|widgets?|pagination|pager|toolbar|login|signup)$"
)
#: What may stand beside such a name in a hyphenated one; with any other word it is a name of its own.
_layout = re.compile(r"^(?:bars?|box(?:es)?|lists?|links?|wrap(?:per)?|container|section|area|block|panel|unit|slot|buttons?|icons?|top|bottom|left|right|main|site|page|inner|outer|form|items?|inline|sticky|posts?|articles?|stories|more|js|\d+)$")
#: Share of a doubtful element's characters in links, from which it is boilerplate within an article.
LINK_SHARE = 0.5
_containers = frozenset("div section ul ol dl table aside nav form figure iframe details".split())
#: Block elements that close an open p.
_closes_p = frozenset("p div ul ol dl li table tr td th h1 h2 h3 h4 h5 h6 pre blockquote section article main aside nav header footer form hr figure address fieldset details".split())


def _sign(name: str) -> int:
    return 3 if _sure.match(name) else 2 if _sure_around.match(name) else 1 if _doubtful.match(name) else 0


def _named(word: str) -> int:
    """3: a name of boilerplate; 2: of a container with boilerplate; 1: one that may be; 0: neither. All parts of a hyphenated name have a say."""
    parts = [x for x in re.split(r"[-_]+", word) if x] if not _sign(word) else [word]
    signs = list(map(_sign, parts))
    return max(signs, default=0) if all(k or _layout.match(x) for k, x in zip(signs, parts, strict=True)) else 0


def _verdict(tag: str, attrs: str, in_main: bool) -> int:
    """_STAYS, _GOES, or who decides of an element that by its name may be boilerplate."""
    if tag in _left_out and not (tag == "header" and in_main):
        return _GOES
    if not attrs or attrs.isspace():
        return _STAYS
    sign = 0
    for m in _attribute.finditer(attrs):
        name = m[1].lower()
        value = (m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "").lower()
        if name in ("class", "id"):
            sign = max(sign, *map(_named, value.split()), 0)
        elif name == "role" and value in _roles or name == "aria-hidden" and value == "true" or name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _GOES
    if tag in _containers:
        return _LINKS if sign == 1 and in_main else _GOES if sign else _STAYS
    return _GOES if sign == 3 else _SHARED if sign and in_main and tag in _named_blocks else _STAYS


def page_blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each text block in page order, boilerplate too: MAIN, FREE, OUT, or from DOUBT on the number of a doubtful element."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, tuple[int, int, int, int] | None]] = []  # tag, left out, main; of a doubtful element what markup says and the counts as it opens
    text: list[str] = []
    hidden = main = doubts = chars = linked = 0  # characters are counted while a doubtful element is open
    named = DOUBT  # number of the next doubtful element

    def flush():
        nonlocal text
        if text:
            line = " ".join(unescape("".join(text)).split())
            text = []
            if line:
                out.append((line, OUT if hidden else MAIN if main else FREE))

    def take(piece: str):
        nonlocal chars, linked
        if doubts and not hidden:
            n = len("".join(piece.split()))
            chars += n
            linked += n * any(x[0] == "a" for x in stack)
        text.append(piece)

    def close(at: int):
        nonlocal hidden, main, doubts, named
        flush()
        for _, h, m, doubt in reversed(stack[at:]):
            hidden -= h
            main -= m
            if doubt:
                doubts -= 1
                says, first, chars_before, linked_before = doubt
                by_links = says == _LINKS and linked - linked_before >= LINK_SHARE * (chars - chars_before)
                for j in range(first, len(out)):
                    if by_links or out[j][1] == MAIN:
                        out[j] = (out[j][0], OUT if by_links else named)
                named += 1
        del stack[at:]

    at = 0
    html = html or ""
    for m in _token.finditer(html):
        if m.start() > at:
            take(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _inline and not any(stack[j][1] or stack[j][0] not in _inline for j in range(k, len(stack))):
                        del stack[k:]
                    elif tag not in _inline or stack[k][1]:
                        close(k)
                    break
            else:
                if tag not in _inline:
                    flush()
            continue
        if tag in _void:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in _closes_p:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in _inline:
                    break
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table"):
                    break
        if m["attrs"].endswith("/"):
            continue
        says = _verdict(tag, m["attrs"], main > 0)
        left_out = says == _GOES
        is_main = tag in ("article", "main") or 'role="main"' in m["attrs"]
        if tag not in _inline or left_out:
            flush()
        doubt = (says, len(out), chars, linked) if says in (_LINKS, _SHARED) else None
        doubts += doubt is not None
        stack.append((tag, left_out, is_main, doubt))
        hidden += left_out
        main += is_main
    if at < len(html):
        take(html[at:])
    close(0)
    if any(kind not in (FREE, OUT) for _, kind in out):
        out = [(x, OUT if kind == FREE else kind) for x, kind in out]
    return out


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(text, MAIN or FREE) of the blocks that markup alone would keep."""
    return [(x, MAIN if kind >= DOUBT else kind) for x, kind in page_blocks(html) if kind != OUT]


#: Rows of the alignment kept at a time, and between two rows that are kept throughout.
_ROWS = 256


def common_lines[T: (str, bytes)](a: list[T], b: list[T]) -> list[bool]:
    """Which lines of a are in a longest common subsequence with b.

    Lines that only one page has are out from the start, and equal ends belong
    to the subsequence.  The rest is bit-parallel; of its rows every _ROWS-th
    is kept, and those between are worked out again on the way back.
    """
    shared = [False] * len(a)
    both = set(a).intersection(b)
    at, b = [k for k, x in enumerate(a) if x in both], [x for x in b if x in both]
    head = tail = 0
    while head < min(len(at), len(b)) and a[at[head]] == b[head]:
        shared[at[head]] = True
        head += 1
    while tail < min(len(at), len(b)) - head and a[at[-1 - tail]] == b[-1 - tail]:
        shared[at[-1 - tail]] = True
        tail += 1
    at, b = at[head : len(at) - tail], b[head : len(b) - tail]
    where: dict[T, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    ones = (1 << len(b)) - 1

    def rows(first: int, v: int) -> list[int]:
        out = []
        for k in at[first : first + _ROWS]:
            u = v & where.get(a[k], 0)
            v = ((v + u) | (v - u)) & ones
            out.append(v)
        return out

    before = [ones]  # the row before each run of _ROWS
    for first in range(0, len(at), _ROWS):
        before.append(rows(first, before[-1])[-1])
    i, j, run, held = len(at) - 1, len(b) - 1, -1, []
    while i >= 0 and j >= 0:
        if i // _ROWS != run:
            run = i // _ROWS
            held = rows(run * _ROWS, before[run])
        above = held[i % _ROWS - 1] if i % _ROWS else before[run]
        if held[i % _ROWS] >> j & 1:
            j -= 1
        elif i and not above >> j & 1:
            i -= 1
        else:
            shared[at[i]] = True
            i, j = i - 1, j - 1
    return shared


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; query and fragment are no part of the path."""
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


#: Bytes of the code of a line.
_CODE = 8


def _code(line: str) -> bytes:
    return blake2b(line.encode("utf-8", "replace"), digest_size=_CODE).digest()


def _codes(packed: bytes) -> list[bytes]:
    return [packed[k : k + _CODE] for k in range(0, len(packed), _CODE)]


def kept(codes: list[bytes], kinds: list[int], other: list[bytes]) -> list[bool]:
    """Which lines of a page are its main text, by differencing with the partner's lines (none: no partner) and a check of the markup."""
    shared = common_lines(codes, other)
    plain = [s for s, kind in zip(shared, kinds, strict=True) if kind == MAIN]
    same = 2 * sum(plain) >= len(plain)  # both hold one article, or nothing tells
    own = {kind for s, kind in zip(shared, kinds, strict=True) if kind >= DOUBT and (same or not s)}
    return [kind == MAIN or kind == FREE and not s or kind in own for s, kind in zip(shared, kinds, strict=True)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            yield whole.slice(start, 512)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where pages are, a digest of the lines that markup would keep, and the codes of all lines."""
    for batch in _slices(batches):
        places = [place(x) for x in batch.column(1).to_pylist()]
        pages = [[(_code(x), kind) for x, kind in page_blocks(html)] for html in batch.column(2).to_pylist()]
        content = [blake2b(b"".join(c for c, kind in x if kind != OUT), digest_size=16).digest() for x in pages]
        codes = [b"".join(c for c, _ in x) for x in pages]
        yield pa.record_batch([batch.column(0), *(pa.array(x, pa.string()) for x in zip(*places, strict=True)), pa.array(content, pa.binary()), pa.array(codes, pa.binary())], names=["page_id", "host", "path", "content", "codes"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes and kinds of all lines, and the texts of those that markup doesn't leave out, compressed."""
    for batch in _slices(batches):
        pages = [page_blocks(html) for html in batch.column(2).to_pylist()]
        codes = [b"".join(_code(x) for x, _ in page) for page in pages]
        kinds = [[kind for _, kind in page] for page in pages]
        texts = [zlib.compress("\n".join(x for x, kind in page if kind != OUT).encode("utf-8", "replace"), 1) for page in pages]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(kinds, pa.list_(pa.int32())), pa.array(texts, pa.binary())], names=["page_id", "url", "codes", "kinds", "texts"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        out = []
        for codes, kinds, texts, other in zip(*(batch.column(x).to_pylist() for x in ("codes", "kinds", "texts", "other")), strict=True):
            stays = kept(_codes(codes), kinds, _codes(other or b""))
            lines = zlib.decompress(texts).decode().split("\n")
            out.append("\n".join(x for x, s in zip(lines, (s for s, kind in zip(stays, kinds, strict=True) if kind != OUT)) if s))  # noqa: B905 - no lines are one empty text
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


Place = tuple[str, str, int]  # host, path, page_id


def nearest(before: Place | None, page: Place, after: Place | None) -> int | None:
    """Which of the neighbours by (host, path, page_id) has the longer part of the path in common, if either is of the host; the first of equals."""
    near = [x for x in (before, after) if x is not None and x[0] == page[0]]
    return max(near, key=lambda x: len(commonprefix((x[1], page[1]))))[2] if near else None


_PAGE = pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("content", pa.binary()), ("codes", pa.binary())])
_PAGE_SCHEMA = "struct<host string, path string, page_id long, content binary, codes binary>"
_FOUND = pa.schema([("page_id", pa.int64()), ("other", pa.binary()), ("part", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("before", _PAGE), ("after", _PAGE), ("ends", pa.list_(_PAGE))])
_FOUND_SCHEMA = f"page_id long, other binary, part int, host string, path string, before {_PAGE_SCHEMA}, after {_PAGE_SCHEMA}, ends array<{_PAGE_SCHEMA}>"


def _where(page: dict | None) -> Place | None:
    return page and (page["host"], page["path"], page["page_id"])


def _partner(before: dict | None, at: Place, after: dict | None) -> bytes | None:
    """The codes of the nearest of the pages before and after, if either is of the host."""
    found = nearest(_where(before), at, _where(after))
    return None if found is None else (before if before and before["page_id"] == found else after)["codes"]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partner's codes for each page of a sorted partition."""
    rows, size = [], 0
    for row in _by_runs(page for batch in _slices(batches) for page in batch.to_pylist()):
        rows.append(row)
        size += sum(len(row[x]["codes"]) for x in ("before", "after") if row.get(x)) + len(row.get("other") or b"")
        if len(rows) == 4096 or size > 2**22:
            yield pa.RecordBatch.from_pylist(rows, _FOUND)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, _FOUND)


def _by_runs(pages: Iterator[dict]) -> Iterator[dict]:
    """Rows of _FOUND for pages in order, taken by runs of one host and content.

    The neighbours are the last page before the run and the first after it.
    Pages of the first and last run, of which a neighbour may be in another
    partition, go on with what is known.  A row of its own tells the ends: the
    first page, the first of the second run, the last page, and the last of
    the run before the last.
    """
    part = TaskContext.get().partitionId()
    ends: list[dict | None] = [None] * 4
    before: dict | None = None
    last: dict | None = None
    run: list[tuple[str, int]] = []

    def found(after: dict | None) -> Iterator[dict]:
        for path, page_id in run:
            if before is not None and after is not None:
                yield {"page_id": page_id, "other": _partner(before, (last["host"], path, page_id), after)}
            else:
                yield {"page_id": page_id, "part": part, "host": last["host"], "path": path, "before": before, "after": after}

    for page in pages:
        if last and (page["host"], page["content"]) != (last["host"], last["content"]):
            yield from found(page)
            ends[1] = ends[1] or page
            ends[3] = before = last
            run = []
        ends[0] = ends[0] or page
        run.append((page["path"], page["page_id"]))
        ends[2] = last = page
    if last:
        yield from found(None)
        yield {"part": part, "ends": ends}


def _across(ends: list[list], at: int, step: int) -> dict | None:
    """The neighbour of a partition's first (step -1) or last (step 1) run among the partitions before or after it."""
    own = ends[at][0 if step < 0 else 2]
    at += step
    while 0 <= at < len(ends):
        _, second, _, second_last = ends[at]
        facing, beyond = (ends[at][2], second_last) if step < 0 else (ends[at][0], second)
        near = facing if (facing.host, facing.content) != (own.host, own.content) else beyond
        if near is not None:
            return near.asDict() if near.host == own.host else None
        at += step
    return None


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            rows = batch.slice(start, 512).to_pylist()
            other = [_partner(r["before"], (r["host"], r["path"], r["page_id"]), r["after"]) for r in rows]
            yield pa.record_batch([pa.array([r["page_id"] for r in rows], pa.int64()), pa.array(other, pa.binary())], names=["page_id", "other"])


def partners(sketches: DataFrame, shelf: Shelf) -> DataFrame:
    """(page_id, other): the line codes of the page of the host whose path is nearest and whose content is another, from a range sort by (host, path, page_id)."""
    spark = sketches.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "page_id"]
    found = shelf.put(sketches.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _FOUND_SCHEMA), "neighbours")
    # a row of four pages a partition
    parts = sorted(found.where("ends is not null").select("part", "ends").collect(), key=lambda r: (r.ends[0].host.encode(), r.ends[0].path.encode(), r.ends[0].page_id))
    ends = [r.ends for r in parts]
    across = [(r.part, _across(ends, k, -1), _across(ends, k, 1)) for k, r in enumerate(parts)]
    joined = spark.createDataFrame(across, f"part int, left {_PAGE_SCHEMA}, right {_PAGE_SCHEMA}")
    open_ends = found.where("part is not null and ends is null").join(F.broadcast(joined), "part")
    open_ends = open_ends.select("page_id", "host", "path", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))
    both = found.where("part is null").select("page_id", "other").unionByName(open_ends.mapInArrow(_join_ends, "page_id long, other binary"))
    return both.where("other is not null")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html)."""
    shelf = Shelf(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # parsed once for the codes and once for the texts, so that no texts are stored
    sketches = rows.where("page_id is not null").mapInArrow(_sketch, "page_id long, host string, path string, content binary, codes binary")
    one = sketches.groupBy("page_id").agg(F.min(F.struct("host", "path", "content", "codes")).alias("_at")).select("_at.host", "_at.path", "page_id", "_at.content", "_at.codes")
    pairs = partners(shelf.put(one, "sketches"), shelf)
    packed = rows.mapInArrow(_pack, "page_id long, url string, codes binary, kinds array<int>, texts binary")
    text = packed.join(pairs.hint("merge"), "page_id", "left").mapInArrow(_cut, "page_id long, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
