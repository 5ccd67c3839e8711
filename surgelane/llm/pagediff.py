"""Main text of web pages by differencing each with its nearest page by URL.

A page becomes text lines, one per block, with the chain of elements around
them. Elements that HTML names for other things than the article (navigation,
forms, adverts by whole class names, ...) lose their lines at once. The pages of a host are
then sorted by URL path; each is aligned with the nearest different page by a
longest common subsequence of lines, and the lines that both share are the
site's, not the article's: they go. Two articles may quote the same passage, so
prose of an explicit article element goes only if ``SUPPORT`` different pages of
the host or more, and three quarters of those compared, share it.

Rows are range-partitioned by host, path and id, so a hot host is spread over
many partitions; a task streams its sorted pages and remembers ``REMEMBERED``
different ones. Pages that share more than half the larger one's text with
a remembered one are its copies: they are not remembered beside it, however many follow, nor
compared with it. Where a host has nothing but such pages, a line goes if
``SUPPORT`` neighbours share the same lines with the page and their rests have
little in common, as with short articles in much site text. The first pages of a
host or partition wait for those after them, up to ``WAITING`` characters. A
host's page that stands alone at a partition's edge has no partner and keeps its
lines; partitions have at least ``LEAST_ROWS`` rows on average, so these are few.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Different pages of a host that partners are chosen from.
REMEMBERED = 12
# Pages that share more of the larger one's text than this are copies, or have the same site text around short articles.
COPY_SHARE = 0.5
# A page that shares so much of its own text is a part of the other one.
PART_SHARE = 0.9
# Partners that must share a line of an article's prose, or the lines of pages that are alike, and their part of all compared.
SUPPORT, SUPPORT_SHARE = 5, 0.75
# Rests of two pages with more of the smaller one's words in common are edits of one text.
REST_SHARE = 0.5
# Characters of a host's first pages that wait for partners after them.
WAITING = 1 << 25
# Rows of a partition on average, at least.
LEAST_ROWS = 256

# HTML element names by how they lay out text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
NOT_TEXT = frozenset(
    "head title nav footer aside form button select textarea option menu dialog template iframe object svg canvas audio video noscript search".split()
)
# Words of class, id and role that mark what is not the article, and what is.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus reply "
    "replies responses discussion related recommended share sharing social newsletter subscribe subscription signup login popup modal "
    "overlay pagination pager widget toolbar search copyright legal contentinfo complementary".split()
)
ARTICLE = frozenset("article main content post entry story".split())
# Words that say nothing on their own beside one of these in the same class name.
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons container footer global header inner item items left link links list outer page pages "
    "panel posts primary right secondary section site text top wrap wrapper".split()
)
# Elements whose class can name the article where no element is called so.
HOLDERS = frozenset("div section td center dd".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRS = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def attributes(attrs: str) -> dict[str, str]:
    """Names and values of a start tag's attributes; the first of a name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRS.findall(attrs):
        found.setdefault(name.lower(), a or b or c)
    return found


def names(token: str, words: frozenset[str]) -> bool:
    """Whether a whole class name is made of ``words``, of neutral ones beside them, and of numbers."""
    parts = _WORDS.findall(token)
    return any(w in words for w in parts) and all(w in words or w in NEUTRAL or w in ARTICLE or w.isdigit() for w in parts)


class Element:
    """An open or closed element: what its tag says, and the text below it."""

    __slots__ = ("name", "path", "parent", "never", "other", "holder", "prose", "size", "gone", "inside")

    def __init__(self, name: str, path: str, parent: Element | None, never: bool, other: bool, holder: bool):
        self.name, self.path, self.parent = name, path, parent
        self.never, self.other, self.holder = never, other, holder  # unseen or named for other things; by class; an article by class
        self.prose = self.size = 0  # characters in prose, and in all
        self.gone = self.inside = False

    def above(self) -> Iterator[Element]:
        """The element and those around it."""
        e: Element | None = self
        while e is not None:
            yield e
            e = e.parent


def mark(elements: list[Element]) -> None:
    """Sets which elements are not the article's, and which are in one. Parents come before children.

    The article or main element with most prose is never lost by a class name, nor
    are those around it. Class names make an article only where no element is
    called so, and where they hold at least half of the page's prose.
    """
    for e in elements:
        e.gone = e.parent is not None and e.parent.gone or e.never
    for e in reversed(elements):
        if e.parent is not None and not e.gone:
            e.parent.prose += e.prose
            e.parent.size += e.size
    real = [e for e in elements if e.name in ("article", "main") and not e.gone]
    articles: set[Element] = set(real)
    if not real:
        held = [e for e in elements if e.holder and not e.gone]
        outer = [e for e in held if not any(x.holder for x in e.above() if x is not e)]
        if 2 * sum(e.prose for e in outer) >= elements[0].prose > 0:
            articles = set(held)
    plain = [e for e in real if not any(x.other for x in e.above())] or real or [e for e in articles if 2 * e.prose >= elements[0].prose]
    kept = set(max(plain, key=lambda e: (e.prose, e.size)).above()) if plain else set()
    for e in elements:
        up = e.parent
        e.gone = up is not None and up.gone or e.never or (e.other and e not in kept) or (e.name == "header" and e not in kept and not (up and up.inside))
        e.inside = bool(up and up.inside) or e in articles


def lines_of(page: str) -> list[tuple[str, str, bool, bool]]:
    """(elements around it, text, in an article element, prose) of each line in page order."""
    root = Element("", "", None, False, False, False)
    elements, stack = [root], [root]
    runs: list[list[tuple[Element, Element, str]]] = [[]]  # of each line: element, block and text

    def flush() -> None:
        if runs[-1]:
            runs.append([])

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            top = stack[-1]
            if not top.never:
                block = next((e for e in reversed(stack) if e.name in BLOCKS), root)
                n = len(text) if not text.isspace() else 0
                top.size += n
                if block.name in PROSE:
                    top.prose += n
                runs[-1].append((top, block, text))
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            runs[-1].append((stack[-1], root, " "))
            continue
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if depth:
                if any(e.name in BLOCKS for e in stack[depth:]):
                    flush()
                del stack[depth:]
            continue
        attrs = m["attrs"]
        if name in BLOCKS:
            flush()
            opened = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in BLOCKS), 0)
            if opened and (stack[opened].name == "p" or (name == stack[opened].name and name in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                del stack[opened:]
        if name in VOID:
            continue
        up = stack[-1]
        hints, hidden = "", False
        if attrs and not attrs.isspace():
            said = attributes(attrs)
            hints = " ".join(said[k] for k in ("class", "id", "role") if k in said).lower()
            hidden = "hidden" in said or said.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(said.get("style", "")))
        tokens = hints.split()
        words = sorted(set(_WORDS.findall(hints))) if hints else ()
        whole = name not in ("html", "body")
        e = Element(
            name, f"{up.path}/{name}.{'.'.join(words)}", up, up.never or (whole and (name in NOT_TEXT or hidden)),
            whole and any(names(t, OTHER) for t in tokens), name in HOLDERS and any(names(t, ARTICLE) for t in tokens),
        )
        elements.append(e)
        stack.append(e)
        if attrs.endswith("/") and name not in BLOCKS:
            stack.pop()
    mark(elements)
    lines: list[tuple[str, str, bool, bool]] = []
    for run in runs:
        seen = [x for x in run if not x[0].gone]
        first = next((x for x in seen if not x[2].isspace()), None)
        text = " ".join(html.unescape("".join(x[2] for x in seen)).split()) if first else ""
        if text:
            lines.append((first[1].path, text, first[0].inside, first[1].name in PROSE))
    return lines


def candidates(page: str) -> list[tuple[str, str, bool]]:
    """(path, text, prose of an article): the lines of the article elements, or of the whole page if it has none."""
    lines = lines_of(page)
    if any(inside for _, _, inside, _ in lines):
        lines = [x for x in lines if x[2]]
    return [(path, text, inside and prose) for path, text, inside, prose in lines]


def common(a: list, b: list) -> list[int]:
    """Positions in a of a longest common subsequence of a and b (Hunt-Szymanski between their equal ends)."""
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    if head or tail:
        middle = common(a[head : len(a) - tail], b[head : len(b) - tail]) if n > head + tail else []
        return [*range(head), *(head + k for k in middle), *range(len(a) - tail, len(a))]
    where: dict = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            node = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    out, node = [], last[-1] if last else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


class Page:
    """A page's lines, and what it takes to compare them with another's."""

    def __init__(self, at: int, lines: list[tuple[str, str, bool]]):
        self.at, self.lines = at, lines
        self.keys = [line[:2] for line in lines]
        self.counts = Counter(self.keys)
        self.size = sum(len(text) for _, text in self.keys)

    def shared(self, other: Page) -> int:
        """Characters of lines that both have, in any order."""
        a, b = self.counts, other.counts
        return sum(min(n, b[key]) * len(key[1]) for key, n in a.items() if key in b)

    def copies(self, other: Page) -> bool:
        shared = self.shared(other)
        return shared > COPY_SHARE * max(self.size, other.size) or shared >= PART_SHARE * min(self.size, other.size)

    def rest(self, other: Page) -> set[str]:
        return {w for _, text in self.counts - other.counts for w in text.lower().split()}

    def text(self, gone=frozenset()) -> str:
        return "\n\n".join(text for k, (_, text) in enumerate(self.keys) if k not in gone)


def unlike(page: Page, other: Page) -> bool:
    """Whether what two pages don't share is two texts, rather than edits of one."""
    a, b = page.rest(other), other.rest(page)
    return bool(a and b) and len(a & b) <= REST_SHARE * min(len(a), len(b))


def without_shared(page: Page, remembered: Iterable[Page], alike: Iterable[Page]) -> str:
    """The page's text without the site's lines.

    ``remembered`` are different pages of the host, ``alike`` the neighbours that
    share more than half of its text, which decide where no other page does.
    """
    partners = sorted((p for p in remembered if p is not page and not page.copies(p)), key=lambda p: (abs(p.at - page.at), p.at))
    if partners:
        shared = [common(page.keys, p.keys) for p in partners]
        gone = {k for k in shared[0] if not page.lines[k][2]}
        votes = Counter(chain.from_iterable(shared))
        need = max(SUPPORT, SUPPORT_SHARE * len(partners))
        return page.text(gone | {k for k, n in votes.items() if n >= need})
    near = sorted((p for p in alike if p.counts != page.counts), key=lambda p: (abs(p.at - page.at), p.at))
    if any(prose for _, _, prose in page.lines):
        # Prose aside, copies of an article have the site's lines in common as other pages do.
        for p in near:
            gone = {k for k in common(page.keys, p.keys) if not page.lines[k][2]}
            if sum(len(page.keys[k][1]) for k in gone) <= COPY_SHARE * page.size:
                return page.text(gone)
        return page.text()
    if len(near) >= SUPPORT and all(unlike(page, p) for p in near):
        shared = [common(page.keys, p.keys) for p in near]
        if all(x == shared[0] for x in shared):
            return page.text(set(shared[0]))
    return page.text()


class Host:
    """A host's sorted pages, seen one by one: their texts, as soon as partners are there."""

    def __init__(self):
        self.seen = 0
        self.remembered: deque[Page] = deque(maxlen=REMEMBERED)
        self.alike: deque[Page] = deque(maxlen=REMEMBERED)  # the last different contents
        self.held: dict[tuple, tuple[Page, list]] | None = {}  # by content: pages that wait and their rows
        self.size = 0
        self.last: tuple[Page, str] | None = None

    def add(self, row: tuple, lines: list[tuple[str, str, bool]]) -> Iterator[tuple[tuple, str]]:
        """(row, text) of the rows that are decided now."""
        if self.held is not None and tuple(lines) in self.held:
            self.held[tuple(lines)][1].append(row)
            return
        if self.held is None and self.last and self.last[0].lines == lines:
            yield row, self.last[1]
            return
        page = Page(self.seen, lines)
        self.seen += 1
        original = next((p for p in self.remembered if p.copies(page)), None)
        if original is not None:
            self.remembered.remove(original)  # seen again: it is the last one to be forgotten
        if lines:
            self.remembered.append(original or page)
            if all(p.counts != page.counts for p in self.alike):
                self.alike.append(page)
        if self.held is None:
            self.last = page, without_shared(page, self.remembered, self.alike)
            yield row, self.last[1]
            return
        self.held[tuple(lines)] = page, [row]
        self.size += page.size
        if len(self.remembered) == REMEMBERED or self.size > WAITING:
            yield from self.close()

    def close(self) -> Iterator[tuple[tuple, str]]:
        """The rows that still wait."""
        held, self.held = self.held or {}, None
        for page, rows in held.values():
            text = without_shared(page, self.remembered, self.alike)
            yield from ((row, text) for row in rows)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``page_id``, ``url``, ``html``.

    Lines stand in page order, two line ends between them. A null or empty page,
    or one without article lines, has an empty text. Pages with a null address
    share a host of that name. Repeated rows are copies: each has its text.
    """
    n = min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // LEAST_ROWS) or 1)
    address = F.coalesce("url", F.lit(""))
    rows = pages.select(
        "page_id", "url", "html",
        F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1).alias("path"),
    )
    near = rows.repartitionByRange(n, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id", "url")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def result(done: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = (list(c) for c in zip(*done)) if done else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, pages_of = None, Host()
        for batch in batches:
            done: list[tuple] = []
            ids, urls, hosts = (batch[c].to_pylist() for c in ("page_id", "url", "host"))
            for k, raw in enumerate(batch["html"]):
                if hosts[k] != host:
                    done += [(*row, text) for row, text in pages_of.close()]
                    host, pages_of = hosts[k], Host()
                done += [(*row, text) for row, text in pages_of.add((ids[k], urls[k]), candidates(raw.as_py() or ""))]
            yield result(done)
        yield result([(*row, text) for row, text in pages_of.close()])

    return near.select(F.col("page_id").cast("long"), "url", "html", "host").mapInArrow(run, "page_id long, url string, text string, n_chars long")
