"""Main text of pages by differencing each page with the one whose URL is nearest.

1. A page becomes lines, one per block of markup, in page order. A line is *declared* content (inside ``article`` or
   ``main``), *marked* as something else (navigation, footer, aside, form, advert, comments, by element, role or class), or *open*.
2. Pages of a host with the same declared and open lines are copies; one stands for all. These are range-sorted by host, path and id. Each is paired
   with the one before it in its host, the first with the one after it, so no page is differenced against its copy; pairs across partitions are made in
   a second, small step, so the result does not depend on how the sort was cut.
3. The lines outside declared content of both pages are aligned by longest common subsequence, and shared lines are deleted: the host's template.
4. Declared lines that ``SITE_PAGES`` pages or more of a host share, and at least half of its pages with declared lines, are deleted as template too.
5. What is left of the declared lines is the text. Where that is less than ``SMALL`` of it and the open lines left (a few cards beside a text that
   is not declared), or nothing is declared, open lines left are text as well. Marked lines that are not shared are deleted as marked.

Only line hashes are sorted and paired; whole texts cross the network once, by page. Fewer shared declared lines are text: articles of
one host do share lines (quotations, licences, copies), and deleting those would lose text.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import partitions, settle, small_batches
from .url_lists import host_of, path_of

DECLARED, OPEN, MARKED = 0, 1, 2
SITE_PAGES, SMALL = 3, 0.25
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button title".split())
CHOICES = frozenset("option optgroup".split())  # blocks that stand in a silent part
MARKS = frozenset("nav footer aside form menu dialog".split())
STRUCTURE = frozenset("article main section div header ul ol table".split()) | MARKS
#: Words in class, id and role that mark a part as not of the article.
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo
cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related respond
search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget""".split())
COMMENTS = frozenset("comment comments disqus respond".split())


class _Tags(HTMLParser):
    """A page as (kind, tag or text, attributes), kind 1 for a start tag, -1 for an end tag, 0 for text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, list]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append((1, tag, attrs))

    def handle_startendtag(self, tag, attrs):
        if tag in SILENT:
            return
        self.handle_starttag(tag, attrs)
        if tag in STRUCTURE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.found.append((-1, tag, ()))

    def handle_data(self, data):
        self.found.append((0, data, ()))


def _silent_ends(tags: list) -> dict[int, int]:
    """Per start tag of a silent part where it goes on: behind its end tag; without one, at the next block or the end of the enclosing one."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    count: Counter = Counter()
    unclosed = []
    for i, (kind, tag, _) in enumerate(tags):
        if not kind or tag not in BLOCKS and tag not in SILENT:
            continue
        if kind == 1:
            stack.append((tag, i))
            count[tag] += 1
            continue
        while count[tag]:
            name, start = stack.pop()
            count[name] -= 1
            if name == tag:
                if tag in SILENT:
                    ends[start] = i + 1
                break
            if name in SILENT:
                unclosed.append((start, i))
    unclosed += [(start, len(tags)) for name, start in stack if name in SILENT]
    if unclosed:
        starts = [i for i, (kind, tag, _) in enumerate(tags) if kind == 1 and tag in BLOCKS and tag not in CHOICES]
        for start, end in unclosed:
            at = bisect(starts, start)
            ends[start] = min(end, starts[at]) if at < len(starts) else end
    return ends


class _Lines:
    def __init__(self):
        self.lines: list[tuple[str, int]] = []
        self.words: list[str] = []
        self.open: list[tuple[str, int, bool]] = []  # structural element, zone inside it, whether in comments
        self.in_head = False

    def read(self, tags: list):
        ends = _silent_ends(tags)
        i = 0
        while i < len(tags):
            kind, tag, attrs = tags[i]
            if kind == 1 and tag in SILENT:
                i = ends[i]
                continue
            if kind == 1:
                self._start(tag, attrs)
            elif kind:
                self._end(tag)
            elif not self.in_head:
                self.words.append(tag)
            i += 1
        self._end_line()

    def _zone(self) -> int:
        return self.open[-1][1] if self.open else OPEN

    def _end_line(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.lines.append((text, self._zone()))

    def _start(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
        if tag == "head":
            self.in_head = True
        elif tag in BLOCKS:
            self.in_head = False
        if tag == "br":
            self.words.append(" ")
        if tag not in STRUCTURE:
            return
        zone, comments = (self.open[-1][1], self.open[-1][2]) if self.open else (OPEN, False)
        names = {w for k, v in attrs if k in ("class", "id", "role") and v for w in re.split(r"[^a-z0-9]+", v.lower())}
        if tag in ("article", "main"):  # its class says what it has or looks like; only its role, and what it stands in, say what it is
            names = set(re.split(r"[^a-z0-9]+", (dict(attrs).get("role") or "").lower()))
        comments = comments or bool(names & COMMENTS)
        if comments or tag in MARKS or names & WORDS:
            zone = MARKED
        elif tag in ("article", "main") or "main" in names and dict(attrs).get("role") == "main":
            zone = DECLARED
        elif zone == OPEN and (tag == "header" or names & {"header", "masthead"}):
            zone = MARKED
        self.open.append((tag, zone, comments))

    def _end(self, tag):
        if tag in BLOCKS:
            self._end_line()
        if tag == "head":
            self.in_head = False
        if tag in STRUCTURE:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """(line, zone) in page order: white space as one space, character references decoded, no empty lines."""
    tags = _Tags()
    tags.feed(html or "")
    tags.close()
    lines = _Lines()
    lines.read(tags.found)
    return lines.lines


# --- alignment ----------------------------------------------------------------------

def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel rows: in row i, a zero at j means that b[j] raises the length of the common subsequence with a[:i + 1]."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        out.append(row)
    return out


def _lengths(row: int, n: int) -> list[int]:
    out, total = [0], 0
    for j in range(n):
        total += not row >> j & 1
        out.append(total)
    return out


def shared_lines(a: list, b: list, cells: int = 1 << 26) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``; memory stays below ``cells`` bits by halving."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    ends = [*range(low)], [*range(len(a) - high, len(a))]
    a, b = a[low: len(a) - high], b[low: len(b) - high]
    known = set(b)
    at = [i for i, x in enumerate(a) if x in known]  # lines that b does not have are in no common subsequence
    a = [a[i] for i in at]
    known = set(a)
    b = [x for x in b if x in known]
    return [*ends[0], *(low + at[i] for i in _align(a, b, cells)), *ends[1]]


def _align(a: list, b: list, cells: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > cells:
        half = len(a) // 2
        left = _lengths(_rows(a[:half], b)[-1], len(b))
        right = _lengths(_rows(a[half:][::-1], b[::-1])[-1], len(b))
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _align(a[:half], b[:cut], cells) + [half + i for i in _align(a[half:], b[cut:], cells)]
    rows, out = _rows(a, b), []
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


# --- pairing ------------------------------------------------------------------------

OUTLINE = "k long, host string, path string, content long, lines array<long>, own array<long>"


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page key, host, path, hash of declared and open lines, and the hashes of lines that are not declared and that are."""
    for batch in batches:
        content, lists, own = [], [], []
        for html in batch.column("html").to_pylist():
            found = [(_hash(t), zone) for t, zone in lines_of(html)]
            content.append(xxhash.xxh3_64_intdigest(array("q", [x for f in found if f[1] != MARKED for x in f]).tobytes()) - (1 << 63))
            lists.append([h for h, zone in found if zone != DECLARED])
            own.append(list({h for h, zone in found if zone == DECLARED}))
        kind = pa.list_(pa.int64())
        yield pa.record_batch([batch.column("k"), batch.column("host"), batch.column("path"), pa.array(content, pa.int64()), pa.array(lists, kind),
                               pa.array(own, kind)], names=["k", "host", "path", "content", "lines", "own"])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


SHARED = "k long, host string, copied boolean, part int, place int, lines array<long>, shared array<int>, other array<long>"
PARTNER = "k long, copied boolean, shared array<int>, other array<long>"


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages: the shared lines of pages whose partner stands in this partition, and the partner's lines where copies need them; the first and
    the last page also keep their lines (place 0 and 1, 2 if both)."""
    part = TaskContext.get().partitionId()
    names = ("k", "host", "copied", "lines")
    before = row = None

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names))

    def out(me, prev, after):
        """With its partner in this partition, if it has one."""
        other = prev if prev and prev[1] == me[1] else after if after and after[1] == me[1] else None
        place = 2 if prev is None and after is None else 0 if prev is None else 1 if after is None else None
        return (*me[:3], part, place, None if place is None else me[3], shared_lines(me[3], other[3]) if other else None,
                other[3] if other and me[2] else None)

    buffer = []
    for following in rows():
        if row is not None:
            buffer.append(out(row, before, following))
            before = row
        row = following
        if len(buffer) >= 512:
            yield _shared_batch(buffer)
            buffer = []
    if row is not None:
        buffer.append(out(row, before, None))
    if buffer:
        yield _shared_batch(buffer)


def _shared_batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)],
                           names=["k", "host", "copied", "part", "place", "lines", "shared", "other"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [shared_lines(a, b) for a, b in zip(*(batch.column(c).to_pylist() for c in ("lines", "other")))]
        yield pa.record_batch([batch.column("k"), batch.column("copied"), pa.array(shared, pa.list_(pa.int32())), batch.column("other")],
                              names=["k", "copied", "shared", "other"])


def template_lines(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, shared): per page key the positions, among its lines outside declared content, of those shared with the page of the nearest URL that is
    not its copy (with its copies, if its host has no other page); and (host, site): per host the hashes of declared lines that are template."""
    outlines = settle(keyed.mapInArrow(_outline, OUTLINE), "page_outlines")
    order = ["host", "path", "k"]
    ones = outlines.groupBy("host", "content").agg(F.min_by(F.struct("path", "k", "lines", "own"), F.struct("path", "k")).alias("one"),
                                                   (F.min("k") != F.max("k")).alias("copied"))
    ones = settle(ones.select("host", "content", "copied", "one.*"), "page_ones")
    found = settle(ones.select(*order, "copied", "lines").repartitionByRange(partitions(keyed.sparkSession), *order).sortWithinPartitions(*order)
                   .mapInArrow(_pair, SHARED), "page_pairs")
    # two rows per partition at most: its first page looks back, its last one forward if it has no partner yet
    edges = found.filter("place IS NOT NULL")
    inner = W.orderBy("part", "place")
    step = edges.withColumn("last_host", F.lag("host").over(inner)).withColumn("last_lines", F.lag("lines").over(inner)) \
        .withColumn("next_host", F.lead("host").over(inner)).withColumn("next_lines", F.lead("lines").over(inner))
    back = F.when((F.col("place") != 1) & (F.col("last_host") == F.col("host")), F.col("last_lines"))
    ahead = F.when((F.col("place") != 0) & F.col("shared").isNull() & (F.col("next_host") == F.col("host")), F.col("next_lines"))
    mended = step.drop("other").withColumn("other", F.coalesce(back, ahead)).filter("other IS NOT NULL").select("k", "copied", "lines", "other") \
        .mapInArrow(_across, PARTNER)
    mended = settle(mended, "page_edges")
    paired = found.filter("shared IS NOT NULL").select("k", "copied", "shared", "other").join(mended.select("k"), "k", "left_anti").unionAll(mended)
    # copies may differ in marked lines, so each is aligned with the partner of the one that stands for them
    partners = ones.filter("copied").select("host", "content", "k", F.col("lines").alias("same")).join(
        paired.filter("copied").select("k", "other"), "k", "left").select("host", "content", F.coalesce("other", "same").alias("other"))
    copies = outlines.select("host", "content", "k", "lines").join(partners, ["host", "content"]).select(
        "k", F.lit(True).alias("copied"), "lines", "other").mapInArrow(_across, PARTNER).select("k", "shared").dropDuplicates(["k"])
    return paired.filter("NOT copied").select("k", "shared").unionAll(copies), _site_lines(ones)


def _site_lines(ones: DataFrame) -> DataFrame:
    declared = ones.filter(F.size("own") > 0)
    lines = declared.select("host", F.explode("own").alias("line")).groupBy("host", "line").count().filter(F.col("count") >= SITE_PAGES)
    most = declared.groupBy("host").agg(F.count("*").alias("pages"))
    return lines.join(most, "host").filter("2 * count >= pages").groupBy("host").agg(F.collect_list("line").alias("site"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its lines, marked ones empty, and their zones."""
    for batch in batches:
        texts, zones = [], []
        for html in batch.column("html").to_pylist():
            lines = lines_of(html)
            texts.append("\n".join("" if zone == MARKED else t for t, zone in lines))
            zones.append([zone for _, zone in lines])
        yield pa.record_batch([*(batch.column(c) for c in ("k", "id", "url", "host")), pa.array(texts, pa.string()), pa.array(zones, pa.list_(pa.int32()))],
                              names=["k", "id", "url", "host", "texts", "zones"])


def _decide(lines: list[tuple[str, int]], shared: set[int], site: set[int]) -> tuple[str, int, int]:
    """Text, number of lines deleted as template, and as marked, from the lines of a page."""
    own, fresh, opened, marks, rest = [], [], [], [], 0
    for at, (t, zone) in enumerate(lines):
        if zone == DECLARED:
            own.append(at)
            continue
        if zone == MARKED:
            marks.append(rest)
        else:
            opened.append(at)
            if rest not in shared:
                fresh.append(at)
        rest += 1
    kept = [at for at in own if _hash(lines[at][0]) not in site] if site else own
    words = sum(len(lines[at][0]) for at in kept)
    if words < SMALL * (words + sum(len(lines[at][0]) for at in fresh)):
        kept = sorted(kept + fresh)
    gone = len(shared) + len(own) - sum(lines[at][1] == DECLARED for at in kept)
    if not kept:  # like its host's other pages throughout
        kept = own or opened
        gone = len(shared) if own else sum(m in shared for m in marks)
    return "\n".join(lines[at][0] for at in kept), gone, sum(m not in shared for m in marks)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("texts", "zones", "shared", "site")))
        out = [_decide(list(zip(t.split("\n"), zones)), set(shared or ()), set(site or ())) for t, zones, shared, site in rows]
        text, shared, marked = zip(*out) if out else ((), (), ())
        yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(text, pa.string()), pa.array(shared, pa.int64()),
                               pa.array(marked, pa.int64())], names=["id", "url", "text", "n_shared", "n_marked"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, text, n_chars, n_shared, n_marked.

    ``text`` is '' where nothing is left (null or empty html too). A page of which nothing would be left keeps its declared or else its open lines.
    Pages without a host (null URLs too) are one host of their own. Rows that repeat are all kept and answered alike. ``n_shared`` lines were deleted as
    the host's template, ``n_marked`` others by their marks. Other columns are not read. No rows give no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    base = base.withColumn("k", F.xxhash64("id", "url", "html")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    shared, site = template_lines(base.select("k", "host", "path", "html"))
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    texts = base.select("k", "id", "url", "host", "html").mapInArrow(
        _texts, f"k long, id {kind}, url string, host string, texts string, zones array<int>")
    joined = texts.join(shared, "k", "left").join(settle(site, "page_site"), "host", "left").select("id", "url", "texts", "zones", "shared", "site")
    found = joined.mapInArrow(_decided, f"id {kind}, url string, text string, n_shared long, n_marked long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                        F.length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")
