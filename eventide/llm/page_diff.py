"""HTML extraction by differencing each page with the page of the nearest URL.

A page is read into lines (blocks of text) with two marks: inside the main element (``article``
or ``main``), and inside an element whose name, role, class or id says that it is no main text.
Pages are ordered by host and URL path; each is paired with the neighbour on its host that
shares the longer start of the path. The lines of both are aligned by their longest common
subsequence, and the lines shared with the neighbour are deleted: what a site repeats from page to page
is its template.

Two checks follow. Lines inside the main element are not deleted for being shared, because
copies of an article and quoted passages repeat across pages, and a neighbour that shares
nearly all unmarked lines is a copy and proves nothing. Lines that the markup names as
menus, adverts, comments and the like go even when the neighbour words them differently. Words of
a class or id that may as well describe the layout (``with-sidebar``) do not hide a main element
that is the only one, nor running text inside it, and an article's own names count only if they
call it a comment. Where a main element holds the page's main text (``MAIN_SHARE`` of what is not
named), only its lines stay; on other pages the neighbours decide.

Only line hashes travel for the pairing. URLs are range-sorted over the cluster, so that no
host meets in one task; the neighbours across partition edges are found from the edge rows.

Defined results: NULL or empty html gives empty text; a NULL or malformed URL has an empty host
and is paired among such pages; repeated rows count once in the pairing and give equal rows; an
unclosed tag or comment at the end of a cut page is dropped; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_text, ship_package, written

# fixed values: elements by their meaning in HTML
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset(("head script style noscript template iframe svg canvas object audio video nav footer aside form button "
                   "select option textarea title dialog menu fieldset label xmp noembed noframes").split())
MAIN = frozenset("article main".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr").split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that name something other than main text.
NOISE_WORDS = frozenset((
    "ad ads advert advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar side widget "
    "widgets menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies respond disqus share sharing "
    "social related recommended footer header masthead topbar toolbar pagination pager skip copyright legal disclaimer").split())
#: Those that never hold main text; the others also name a page's layout (``with-sidebar``).
NEVER_MAIN = frozenset((
    "ad ads advert advertisement advertising adbox adslot sponsor sponsored promo promotion comment comments reply replies "
    "respond disqus related recommended").split())
COMMENT = frozenset("comment comments reply replies respond disqus".split())
#: Elements of running text: inside the main element only ``NEVER_MAIN`` counts on them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd figure figcaption table tr td th".split())
#: The main element is taken for the page's main text if it has this share of the characters that nothing names noise.
MAIN_SHARE = 0.25

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)"
                    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

IN_MAIN, NAMED, LAYOUT = 1, 2, 4


def _named_noise(name: str, attrs: str, in_main: bool, is_main: bool) -> int:
    """``NAMED`` for an element that is no main text, ``LAYOUT`` if only a layout word outside the
    main element says so, else 0."""
    if name in NOISE or (name == "header" and not in_main):
        return NAMED
    if not attrs or name in ("html", "body", "main"):
        return 0
    out = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return NAMED
        if key == "role" and value.lower() in ROLES:
            return NAMED
        if key in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(_CAMEL.sub("-", value))}
            if is_main:  # its names are categories of the text, but a reader's comment may be an article too
                words &= COMMENT
            elif in_main and name in TEXT:
                words &= NEVER_MAIN
            if words & NOISE_WORDS:
                if in_main or words & NEVER_MAIN:
                    return NAMED
                out = LAYOUT
    return out


def page_lines(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, with the marks ``IN_MAIN`` and ``NAMED``."""
    lines: list[tuple[str, int]] = []
    run: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the marks that hold inside them
    marks = 0
    at = 0
    end = len(page)

    def flush() -> None:
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                lines.append((text, marks))

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None or not m[4]:  # a comment, a declaration, or a tag that the end of the page cuts
            continue
        name = name.lower()
        if name == "br":
            run.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    outer = stack[k - 1][1] if k else 0
                    if outer != marks:
                        flush()
                    del stack[k:]
                    marks = outer
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag closes nothing outside its block
            continue
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end if close is None else close.start()
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p":  # a paragraph ends at the next one
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    marks = stack[-1][1] if stack else 0
                    break
                if stack[k][0] not in INLINE:
                    break
        new = marks
        is_main = name in MAIN or bool(m[3] and re.search(r"""role\s*=\s*["']?main\b""", m[3], re.I))
        noise = _named_noise(name, m[3], is_main or bool(new & IN_MAIN), is_main)
        new |= noise
        if is_main and not noise:
            new |= IN_MAIN
        if new != marks:
            flush()
            marks = new
        stack.append((name, marks))
    flush()
    # a layout word around the main element does not count if no other main text is there
    kept = IN_MAIN if any(m == IN_MAIN for _, m in lines) else IN_MAIN | LAYOUT
    return [(t, IN_MAIN if m == kept else m & IN_MAIN | (NAMED if m & (NAMED | LAYOUT) else 0)) for t, m in lines]


def main_only(lines: list[tuple[str, int]]) -> bool:
    """Whether the main element's lines hold the main text, so that no other lines stay."""
    main = sum(len(t) for t, m in lines if m == IN_MAIN)
    return main > 0 and main >= MAIN_SHARE * sum(len(t) for t, m in lines if not m & NAMED)


def _line_hashes(lines: list[tuple[str, int]]) -> list[int]:
    """Signed 64-bit hashes; the lowest two bits hold the marks."""
    import xxhash
    return [((xxhash.xxh3_64_intdigest(t) >> 3) << 2) | marks for t, marks in lines]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the elements of ``a`` in a longest common subsequence of ``a`` and ``b``.

    Memory is bounded: long inputs are split in the middle of ``a`` (Hirschberg)."""
    out = np.zeros(len(a), bool)
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        out[hi_a - 1] = True
        hi_a, hi_b = hi_a - 1, hi_b - 1
    a, b = a[lo:hi_a], b[lo:hi_b]
    if len(a) and len(b):
        keep = np.isin(a, b)  # lines that the other page lacks cannot be shared
        inner = np.zeros(len(a), bool)
        inner[keep] = _lcs(a[keep], b[np.isin(b, a)])
        out[lo:hi_a] = inner
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        step = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(step)
    return row


def _lcs(a: np.ndarray, b: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    out = np.zeros(len(a), bool)
    if not len(a) or not len(b):
        return out
    if len(a) == 1:
        out[0] = bool((b == a[0]).any())
        return out
    if len(a) * len(b) > cells:
        mid = len(a) // 2
        cut = int(np.argmax(_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]))
        out[:mid], out[mid:] = _lcs(a[:mid], b[:cut], cells), _lcs(a[mid:], b[cut:], cells)
        return out
    rows = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + (b == x)))
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and rows[i, j] == rows[i - 1, j - 1] + 1:
            out[i - 1] = True
            i, j = i - 1, j - 1
        elif rows[i - 1, j] >= rows[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def _start_shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def deleted_lines(own: list[int], neighbours: list[list[int]], copy_share: float = 0.8) -> list[int]:
    """Positions of ``own`` to delete: lines shared with the first neighbour that is no copy."""
    mine = np.array(own, np.int64)
    marks = mine & 3
    free = marks != IN_MAIN  # lines of the main element are never deleted for being shared
    plain = (marks & NAMED) == 0
    for other in neighbours:
        shared = common_subsequence(mine >> 2, np.array(other, np.int64) >> 2)
        if plain.any() and not (marks & IN_MAIN).any() and shared[plain].mean() > copy_share:
            continue
        return np.flatnonzero(shared & free).tolist()
    return []


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = [_line_hashes(page_lines(t or "")) for t in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("host"), b.column("path"), pa.array(hashes, pa.list_(pa.int64()))],
            names=["key", "host", "path", "lines"])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the rows before and after them; the first and last row of a partition
    are marked, as they may have another neighbour elsewhere."""
    names = ["key", "host", "path", "lines"]

    def row(x, before, after) -> list:
        return [*x, *(before[1:] if before else (None,) * 3), *(after[1:] if after else (None,) * 3), before is None or after is None]

    schema = pa.schema([("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64()))]
                       + [(f"{p}_{n}", t) for p in ("low", "high") for n, t in
                          (("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())))] + [("edge", pa.bool_())])

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    before, held = None, None
    for b in batches:
        rows = []
        for x in zip(*[b.column(n).to_pylist() for n in names]):
            if held is not None:
                rows.append(row(held, before, x))
                before = held
            held = x
        if rows:
            yield batch(rows)
    if held is not None:
        yield batch([row(held, before, None)])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, gone = [], []
        for r in b.to_pylist():
            near = [(_start_shared(r["path"], r[f"{p}_path"]), r[f"{p}_lines"]) for p in ("low", "high")
                    if r[f"{p}_host"] is not None and r[f"{p}_host"] == r["host"]]
            near.sort(key=lambda x: -x[0])  # stable: the earlier neighbour first among equals
            keys.append(r["key"])
            gone.append(deleted_lines(r["lines"], [n for _, n in near]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["gone_key", "gone"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that the markup allows, deflated: ``position, text`` of each."""
    for b in batches:
        out = []
        for t in b.column("html").to_pylist():
            lines = page_lines(t or "")
            need = IN_MAIN if main_only(lines) else 0
            out.append(zlib.compress("\n".join(f"{i} {t}" for i, (t, m) in enumerate(lines) if m in (need, IN_MAIN)).encode("utf-8", "replace"), 1))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("page_id"), b.column("url"), pa.array(out, pa.binary())],
                                         names=["key", "page_id", "url", "body"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for body, gone in zip(b.column("body").to_pylist(), b.column("gone").to_pylist()):
            drop = set(gone or ())
            lines = (x.split(" ", 1) for x in zlib.decompress(body).decode().split("\n") if x)
            texts.append("\n".join(t for i, t in lines if int(i) not in drop))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""
    ship_package(pages.sparkSession)
    url = empty_text(F.col("url"))
    pattern = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)"
    rows = pages.select(
        F.xxhash64("page_id", "url", "html").alias("key"), F.col("page_id").cast("long").alias("page_id"), "url",
        F.lower(F.regexp_extract(url, pattern, 1)).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"),
        empty_text(F.col("html")).alias("html"))
    hashed = written(rows.mapInArrow(_hashed, "key long, host string, path string, lines array<long>").dropDuplicates(["key"]),
                     "page-lines")
    order = ["host", "path", "key"]
    near = hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _beside, "key long, host string, path string, lines array<long>, low_host string, low_path string, low_lines array<long>, "
                 "high_host string, high_path string, high_lines array<long>, edge boolean")
    near = written(near, "page-pairs")
    # two rows per partition at most: across an edge, the neighbour is the next edge row
    one = Window.orderBy(*order)
    edges = near.where("edge")
    edges = edges.select("key", "host", "path", "lines", *[
        F.when(F.col(f"{p}_host").isNull(), f(c).over(one)).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}")
        for p, f in (("low", F.lag), ("high", F.lead)) for c in ("host", "path", "lines")])
    gone = near.where("not edge").drop("edge").unionByName(edges).mapInArrow(_differences, "gone_key long, gone array<int>")
    stored = rows.select("key", "page_id", "url", "html").mapInArrow(_stored, "key long, page_id long, url string, body binary")
    texts = (stored.join(gone, F.col("key") == F.col("gone_key"), "left").select("page_id", "url", "body", "gone")
             .mapInArrow(_assembled, "page_id long, url string, text string"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
