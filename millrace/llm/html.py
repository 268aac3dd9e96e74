"""Main text of web pages: page structure, and differencing against the page nearest by URL.

Pages with different lines are ordered by host and path; each is compared with
its nearest neighbour in that order on the same host that is no near copy (the
one whose path has more leading characters in common first). Their text lines
(blocks) are aligned by a longest common subsequence, and lines outside an
explicit article that both share are site furniture and go. Markup settles what differencing cannot: a page's
``article`` or ``main`` is its text, and elements that are no text of an
article (scripts, menus, forms, adverts, comments ...) never count. Inside an
explicit article no shared line goes, since copies and quotations of an article
share its lines too, but for lines of blocks whose names leave open what they
are (``related-work``, ``share-price``): those go if the neighbour has them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from html import unescape
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.scratch import written

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'<>]+)""")
#: Elements whose content is not text of the page, raw ones first.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "xmp")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)|\Z", re.I) for t in RAW}
DROPPED = {"head", "nav", "aside", "footer", "form", "button", "select", "dialog", "template", "svg", "canvas", "video", "audio", "menu", "datalist"}
#: Words of class, id or role that mark furniture; those of OUTSIDE do so only outside an article.
FURNITURE = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer comment comments respond disqus related recommended widget toolbar skip login search searchbox contentinfo complementary".split())
OUTSIDE = {"header", "masthead", "topbar", "branding"}
#: Words of layout: a name of these and words of FURNITURE marks furniture as those words do (``cookie-banner-wrap``).
LAYOUT = set("area aside bar block body bottom box btn button buttons card col column container content element footer form group head header heading holder icon icons inner item items layout left link links list main module new outer page pane panel post posts reader right row section site slot tab text title top unit user view wrap wrapper".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the first kind closes, if the second is open and nothing of the third lies between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Neighbours on each side that a page may be compared with.
SIDE = 3
#: Share of a page's letters that a neighbour may hold before it counts as a copy, which tells nothing about furniture.
COPY = 0.8


class Line(NamedTuple):
    text: str
    article: bool
    #: In an article, but in a block whose name says so and so: it goes if a neighbour shares it.
    doubtful: bool = False


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c, alone in _ATTRIBUTE.findall(source):
        found.setdefault((name or alone).lower(), a or b or c)
    return found


def _names(own: dict[str, str]) -> list[list[str]]:
    """The words of each class, id and role of an element."""
    found = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", " \0 ".join("\0".join(own.get(k, "").split()) for k in ("class", "id", "role")))
    return [w for name in found.lower().split("\0") if (w := re.findall("[a-z0-9]+", name))]


def _furniture(tag: str, source: str, article: bool) -> tuple[bool, bool]:
    """Whether an element is no part of the page's main text, and whether that is in doubt.

    Inside an article a name marks furniture if it has no words but those of
    FURNITURE and LAYOUT; one with others (``related-work``) leaves it open.
    """
    if tag in DROPPED or tag == "header" and not article:
        return True, False
    if not source.strip():
        return False, False
    own = _attributes(source)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return True, False
    if tag in ("body", "html", "main"):
        return False, False
    names = _names(own)
    said = [n for n in names if FURNITURE.intersection(n)]
    if not article:
        return bool(said) or any(OUTSIDE.intersection(n) for n in names), False
    marked = any(FURNITURE.union(LAYOUT).issuperset(n) for n in said)
    return marked, bool(said) and not marked


class _Stack:
    """Open elements as (tag, furniture from here, article from here, in doubt from here), and where each tag is open."""

    def __init__(self):
        self.items: list[tuple[str, bool, bool, bool]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, gone: bool, inside: bool, doubtful: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, gone, inside, doubtful))

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost of these tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def cut(self, k: int) -> list[str]:
        """Close everything from place k on; its tags."""
        closed = [t for t, *_ in self.items[k:]]
        del self.items[k:]
        for t in closed:
            self.places[t].pop()
        return closed

    def state(self) -> tuple[bool, bool, bool]:
        return self.items[-1][1:] if self.items else (False, False, False)


def _tokens(html: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text before, tag in small letters or null, whether it closes, its attributes), each character being read a bounded number of times.

    A null tag stands for a comment, a declaration or the end. CDATA is text. A
    ``<`` that begins no tag is text. A quote in a tag that is never closed is
    no quote, in this tag and all later ones.
    """
    at = begin = 0
    last, quotes, cdata = html.rfind(">"), True, True
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            yield html[begin:at], None, False, ""
            at = begin = len(html) if end < 0 else end + 3
            continue
        if cdata and html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            cdata = end >= 0
            if cdata:
                yield html[begin:at] + html[at + 9 : end].replace("&", "&amp;"), None, False, ""
                at = begin = end + 3
                continue
        if at > last:
            break
        if html[at + 1] in "!?":
            yield html[begin:at], None, False, ""
            at = begin = html.find(">", at) + 1
            continue
        name = _NAME.match(html, at + 1)
        if name is None:
            at += 1
            continue
        rest = _REST.match(html, name.end()) if quotes else None
        quotes = rest is not None
        end = rest.end() if rest else html.find(">", name.end()) + 1
        if not end:
            at += 1
            continue
        tag = name[2].lower()
        yield html[begin:at], tag, bool(name[1]), html[name.end() : end - 1]
        if not name[1] and tag in RAW and not (html[end - 2] == "/" and tag not in ("script", "style", "title", "textarea")):
            end = _RAW_END[tag].search(html, end).end()
        at = begin = end
    yield html[begin:], None, False, ""


def lines(html: str | None) -> list[Line]:
    """The page's lines of text in order, without furniture; ``article`` marks those in an article or main element."""
    if not html:
        return []
    out: list[Line] = []
    parts: list[str] = []
    stack = _Stack()
    gone = inside = doubtful = False

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Line(text, inside, inside and doubtful))
            parts.clear()

    for text, tag, closes, source in _tokens(html):
        if text and not gone:
            parts.append(text)
        if tag is None:
            continue
        if closes:
            if tag == "p" and not gone:
                flush()
            if (k := stack.last((tag,))) >= 0:
                if not all(t in INLINE for t, *_ in stack.items[k:]):
                    flush()
                stack.cut(k)
                gone, inside, doubtful = stack.state()
            continue
        if tag in RAW:
            if tag in ("title", "textarea", "iframe") and not gone:
                flush()
            continue
        if tag not in INLINE:
            if not gone:
                flush()
            if ends := _CLOSES.get(tag):
                k = stack.last(ends[0])
                if k > stack.last(ends[1]):
                    stack.cut(k)
                    gone, inside, doubtful = stack.state()
        if tag in VOID or tag == "p" or source.endswith("/") and tag not in DROPPED:
            if tag != "p" or not any(_furniture(tag, source, inside)):
                continue
        if tag == "body":
            gone = inside = doubtful = False
            stack.cut(0)
        marked, open_ = (False, False) if gone else _furniture(tag, source, inside)
        if marked:
            flush()
            gone = True
        elif open_ and tag not in INLINE:
            flush()
            doubtful = True
        elif not gone and (tag in ("article", "main") or "role" in source and _attributes(source).get("role", "").lower() in ("main", "article")):
            flush()
            inside = True
        stack.push(tag, gone, inside, doubtful)
    if not gone:
        flush()
    return out


def common(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Positions in a of one longest common subsequence with b."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    here, there = Counter(a[first : len(a) - last]), Counter(b[first : len(b) - last])
    mine = [i for i in range(first, len(a) - last) if a[i] in there]
    theirs = [x for x in b[first : len(b) - last] if x in here]
    middle = _aligned([a[i] for i in mine], theirs)
    return [*range(first), *(mine[k] for k in middle), *range(len(a) - last, len(a))]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """A longest common subsequence by pairs of equal lines, or by halves of a where those are too many."""
    out, todo = [], [(0, a, b)]
    while todo:
        at, a, b = todo.pop()
        there = Counter(b)
        if not a or not b:
            continue
        if sum(there[x] for x in a) <= 16 * (len(a) + len(b)) or len(a) == 1:
            out += [at + i for i in _by_pairs(a, b)]
            continue
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        todo += [(at + half, a[half:], b[cut:]), (at, a[:half], b[:cut])]
    return sorted(out)


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b, by one long integer of a bit for each line of b."""
    masks: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    for x, js in places.items():
        bits = np.zeros(len(b), np.uint8)
        bits[js] = 1
        masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = v = (1 << len(b)) - 1
    for x in a:
        if u := v & masks.get(x, 0):
            v = ((v + u) | (v - u)) & full
    free = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - free.astype(np.int64))))


def _by_pairs(a: list[int], b: list[int]) -> list[int]:
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # smallest last place in b of a common subsequence of each length
    chain: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()) if len(a) > 1 else places.get(x, ())[:1]:
            k = bisect_left(ends, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[k], chain[k] = j, node
    found, node = [], chain[-1] if chain else None
    while node:
        found.append(node[0])
        node = node[1]
    return found[::-1]


def line_hashes(found: Sequence[Line]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.text) - (1 << 63) for x in found]


def shared(own: Sequence[int], marks: Sequence[int], neighbours: Sequence[Sequence[int]]) -> tuple[int, list[int]]:
    """How many of the text's lines the first neighbour that is no copy has as well, and the places among them of those that go (none, if every one is a copy).

    ``own`` are the hashes of a page's lines, ``marks`` their lengths: 0 for a
    line that is not of the text, negative for one that stays.
    """
    kept = [(h, m) for h, m in zip(own, marks) if m]
    hashes, letters = [h for h, _ in kept], sum(abs(m) for _, m in kept)
    for other in neighbours:
        both = common(hashes, other)
        if sum(abs(kept[i][1]) for i in both) < COPY * letters:
            return len(both), sorted(i for i in both if kept[i][1] > 0)
    return 0, []


def _place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, as pages of one site write it."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return (parts.hostname or "").removeprefix("www."), re.sub(r"(\.html?|/)$", "", parts.path) or "/"


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def parsed(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, host, path, text, bare, marks, hashes)``, written to the shared folder.

    ``text`` is that of an explicit article without doubtful lines, which loses
    none; ``bare`` are the lines of other pages (of their article, if they have
    one); ``hashes`` are those of all lines of a page, and ``marks`` say which
    are of the text, how long they are and whether they stay whatever neighbours
    share: see :func:`shared`. Every page is read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for url, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    found = lines(html)
                    inside = any(x.article for x in found)
                    kept = [x for x in found if x.article or not inside]
                    settled = all(x.article and not x.doubtful for x in kept)
                    bare = [] if settled else kept
                    rows.append((*_place(url), " ".join(x.text for x in kept) if settled else "", [x.text for x in bare], [0 if inside and not x.article else -len(x.text) if x.article and not x.doubtful else len(x.text) for x in found], line_hashes(found)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["page_id", "url", "host", "path", "text", "bare", "marks", "hashes"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(base.mapInArrow(run, "page_id long, url string, host string, path string, text string, bare array<string>, marks array<int>, hashes array<long>"), "parsed")


def differences(pages: DataFrame) -> DataFrame:
    """``(host, path, hashes, marks)`` of parsed pages -> ``(host, key, marks, n_shared, gone)`` of every page: what :func:`shared` finds in up to SIDE pages on each side, nearest first.

    ``key`` is the hash of the page's lines; pages of a host with the same lines
    are one, compared once for each of their ``marks``. Only hashes travel, no
    texts. The result is written to the shared folder.
    """
    spark = pages.sparkSession
    one = pages.select("host", "path", F.xxhash64("hashes").alias("key"), "hashes", "marks").groupBy("host", "key").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.collect_set("marks").alias("marks"))
    order = ["host", "path", "key"]
    ranged = one.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "pages")
    # the pages at the ends of a range are shown to the ranges beside it
    parts = ranged.select("part").distinct()
    over = Window.orderBy("part")
    beside = F.broadcast(parts.select("part", F.lag("part").over(over).alias("before"), F.lead("part").over(over).alias("after")))  # a row for each range
    inside = Window.partitionBy("part").orderBy(*order)
    back = Window.partitionBy("part").orderBy(*(F.desc(c) for c in order))
    placed = ranged.withColumn("first", F.row_number().over(inside)).withColumn("last", F.row_number().over(back)).join(beside, "part")
    shown = placed.where(f"first <= {SIDE} and before is not null").withColumn("part", F.col("before")).unionByName(placed.where(f"last <= {SIDE} and after is not null").withColumn("part", F.col("after")))
    rows = ranged.withColumn("own", F.lit(True)).unionByName(shown.select(*ranged.columns, F.lit(False).alias("own")))
    row = F.struct("host", "path", "hashes")
    others = F.array(*(f(row, k).over(inside) for k in range(1, SIDE + 1) for f in (F.lag, F.lead)))
    near = rows.withColumn("others", others).where("own").select("host", "path", "key", "hashes", "marks", "others")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for host, path, key, own, marks, others in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    found = [x for x in others if x and x["host"] == host]
                    found.sort(key=lambda x: -_alike(path, x["path"]))
                    out += [(host, key, m, *shared(own, m, [x["hashes"] for x in found])) for m in marks]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["host", "key", "marks", "n_shared", "gone"])

    return written(near.mapInArrow(choose, "host string, key long, marks array<int>, n_shared long, gone array<int>"), "differences")


def main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text, n_chars)``, a row for each row.

    ``text`` joins the blocks of the whole page's main text by one space, with
    character references decoded and white space inside a block as one space;
    it is empty for null or empty html and pages without main text. Null and
    unreadable URLs count as one host without a name. Rows that are equal are
    treated alike; a page whose neighbours are all near copies of it keeps its
    lines; an empty table gives no rows; other columns are ignored.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(x for i, x in enumerate(found) if i not in (gone or ())) for found, gone in zip(*(batch.column(i).to_pylist() for i in (2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    split = parsed(pages)
    settled = split.where("size(bare) = 0").select("page_id", "url", "text")
    less = differences(split).where("size(gone) > 0").select("host", "key", F.xxhash64("marks").alias("mark"), "gone")
    rest = split.where("size(bare) > 0").withColumns({"key": F.xxhash64("hashes"), "mark": F.xxhash64("marks")}).join(less, ["host", "key", "mark"], "left")
    rest = rest.select("page_id", "url", "bare", "gone").mapInArrow(compared, "page_id long, url string, text string")
    return settled.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
