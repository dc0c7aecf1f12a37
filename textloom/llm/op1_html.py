"""Main text of web pages, by differencing each page with the pages nearest to it by URL within its host.

1. A page is cut into text lines at block tags. Character references are decoded, white space becomes one space.
   Scripts, styles and comments give no lines.
2. Pages are dealt out in ranges of (host, path) and sorted. Of a host, the two pages before and the two after by path
   are a page's neighbours; pages of the very same lines count as one, so that copies don't stand for the host. A range
   is a stream, of which five different pages are held at a time: a host with a third of all pages is many tasks' work.
3. The lines of every page are aligned with those of each neighbour by longest common subsequence. A line that two of
   the neighbours share, or the only one, is the host's template, and goes: one alone may be a near copy.
4. What is left is checked by markup, where a page has it, since a menu or an advert may differ from page to page, and a
   paragraph may be on several. Lines of an element that is frame by its tag, role or by being hidden go, and so do lines
   of one that a class or id names as menu, header, footer, sidebar, notice, advert, form or reader comments. An
   <article> or <main> of which the alignment leaves any line is the article, with all its lines that nothing marks as
   frame, and nothing outside such elements is; one of which it leaves none, as of a teaser that the host's pages share,
   goes, unless there is no other. A page left with nothing keeps its free lines, shared or not; with none of them, those
   that only a class or id marks.

Null and empty html gives the empty text, null urls are pages of the empty host. A page alone on its host is aligned
with nothing. At the ends of a range, of 8 MB or more, the pages of the next one are not seen: up to four pages a border
have neighbours on one side alone. Repeated rows and page_ids each give a
row; extra columns are ignored; an empty table gives no rows. Tags cut off at the end of a page are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import steady
from .store import bound_batches

#: Elements whose text is never shown as text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes"}
#: Elements of the frame of a page.
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head", "object", "audio", "video", "canvas"}
MAIN = {"article", "main"}
#: Elements that don't end a line.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in role, class or id that mark an element as frame,
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus"
    " footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion promoted related reply replies respond search"
    " share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo alert".split()
)
#: and those beside which they mark nothing: left-sidebar is frame, has-sidebar and entry-header are not.
BESIDE = set("article body closed disabled enabled entry full has hide is layout no not off on one open show single story template two width with without".split())
#: An attribute, with its value quoted or not.
_ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?+)?+"
#: Tags, comments and declarations; what is cut off at the end of a page too.
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*+))?+)?+")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")

#: What markup says of a line: nothing, article, frame by a class or id, frame by more than that.
FREE, ARTICLE, NAMED, FRAMED = range(4)


@dataclass
class Line:
    text: str
    kind: int
    #: The number of the innermost <article> or <main> of the page that it is in; 0 for none.
    part: int = 0


def _is_mark(name: str) -> bool:
    found = WORD.findall(CAMEL.sub(r"\1 \2", name).lower())
    return not MARKS.isdisjoint(found) and BESIDE.isdisjoint(found)


def _said(attributes: str) -> tuple[int, bool]:
    """FREE, NAMED or FRAMED by an element's attributes; and whether its role is main."""
    out, main = FREE, False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role":
            main |= value.strip().lower() == "main"
            if value.strip().lower() in MARKS:
                out = FRAMED
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out = FRAMED
        elif name in ("class", "id") and any(map(_is_mark, value.split())):
            out = max(out, NAMED)
    return out, main


class _Open:
    """The open elements that matter, with how many of each kind there are."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []
        self.names: Counter[str] = Counter()
        self.kinds = [0] * 4
        self.parts = [0]
        self.made = 0

    def push(self, name: str, kind: int, main: bool) -> None:
        self.stack.append((name, kind, main))
        self.names[name] += 1
        self.kinds[kind] += 1
        if main:
            self.made += 1
            self.parts.append(self.made)

    def pop(self) -> str:
        name, kind, main = self.stack.pop()
        self.names[name] -= 1
        self.kinds[kind] -= 1
        if main:
            self.parts.pop()
        return name

    def close(self, name: str) -> bool:
        if not self.names[name]:
            return False
        while self.pop() != name:
            pass
        return True

    def state(self) -> tuple[int, int]:
        """The kind and the part of a line here."""
        part = self.parts[-1]
        return FRAMED if self.kinds[FRAMED] else NAMED if self.kinds[NAMED] else ARTICLE if part else FREE, part


def lines(page: str) -> list[Line]:
    """The text lines of a page, in order, with what their elements say about them."""
    out: list[Line] = []
    held: list[str] = []
    open_, kind, part, at = _Open(), FREE, 0, 0
    never_closed: set[str] = set()

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Line(text, kind, part))
            held.clear()

    m = TAG.search(page)
    while m:
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name in RAW:
            flush()
            if not m[1] and name not in never_closed:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if end:
                    at = end.start()
                else:
                    # a cut-off script hides the rest of the page, other elements don't
                    never_closed.add(name)
                    at = len(page) if name in ("script", "style") else at
        elif name in INLINE:
            if m[1]:
                if open_.names[name]:
                    flush()
                    open_.close(name)
                    kind, part = open_.state()
            elif name not in VOID and m[3]:
                said, _ = _said(m[3])
                if said or open_.names[name]:
                    flush()
                    open_.push(name, said, False)
                    kind, part = open_.state()
            elif name not in VOID and open_.names[name]:
                # so that its end doesn't close a marked one
                open_.push(name, FREE, False)
        elif name:
            flush()
            if open_.stack and open_.stack[-1][0] in ("p", "li") and not m[1] and (open_.stack[-1][0] == "p" or name == "li"):
                open_.pop()
                kind, part = open_.state()
            if m[1]:
                if open_.close(name):
                    kind, part = open_.state()
            elif name not in VOID:
                said, main = _said(m[3]) if m[3] else (FREE, False)
                if name in MAIN:
                    said, main = said if said == FRAMED else FREE, True
                elif name in FRAME:
                    said = FRAMED
                elif name in ("html", "body"):
                    # a body that is marked as a whole is still the page
                    said = FREE
                if said or main or name not in LEAVES:
                    open_.push(name, said, main)
                    kind, part = open_.state()
        elif not m[0].startswith("<!--"):
            flush()
        m = TAG.search(page, at)
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


#: Elements that end without a tag, of which only marked ones are remembered.
LEAVES = {"p", "li", "html", "body", "tr", "td", "th", "dt", "dd", "option"}


def shared(a: list[str], b: list[str]) -> list[bool]:
    """Which of ``a`` are in a longest common subsequence with ``b``."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    inner, other = a[low : len(a) - high], b[low : len(b) - high]
    common = set(inner) & set(other)
    keep, other = [i for i, x in enumerate(inner) if x in common], [x for x in other if x in common]
    found = [False] * len(inner)
    for i, hit in zip(keep, _aligned([inner[i] for i in keep], other), strict=True):
        found[i] = hit
    return [True] * low + found + [True] * high


#: Bits that an alignment may hold; longer pairs are split in two.
MOST_BITS = 1 << 28


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each beginning of ``a``, a number whose bit j is 0 where the length of the longest common subsequence with
    the beginning of ``b`` grows at j (bit-parallel dynamic programming)."""
    masks: dict[str, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        hit = v & masks.get(x, 0)
        v = (v + hit | v - hit) & full
        yield v


def _aligned(a: list[str], b: list[str]) -> list[bool]:
    if not a or not b:
        return [False] * len(a)
    if len(a) * len(b) > MOST_BITS and len(a) > 1:
        mid = len(a) // 2
        (*_, head), (*_, tail) = _rows(a[:mid], b), _rows(a[mid:][::-1], b[::-1])
        grow, back = [0], [0]
        for j in range(len(b)):
            grow.append(grow[-1] + (not head >> j & 1))
            back.append(back[-1] + (not tail >> j & 1))
        cut = max(range(len(b) + 1), key=lambda j: grow[j] + back[len(b) - j])
        return _aligned(a[:mid], b[:cut]) + _aligned(a[mid:], b[cut:])
    full = (1 << len(b)) - 1
    rows = [full, *_rows(a, b)]
    out, j = [False] * len(a), len(b)
    for i in range(len(a), 0, -1):
        # the length at (i, j) against (i - 1, j): the row above has more zeros below j or as many
        mask = (1 << j) - 1
        here, above = j - (rows[i] & mask).bit_count(), j - (rows[i - 1] & mask).bit_count()
        if here > above:
            while j and a[i - 1] != b[j - 1]:
                j -= 1
            out[i - 1] = True
            j -= 1
    return out


def template(page: list[Line], neighbours: list[list[Line]]) -> list[bool]:
    """Which lines two of the neighbours share, or the only one."""
    own = [x.text for x in page]
    counts = [0] * len(page)
    for other in neighbours:
        for i, hit in enumerate(shared(own, [x.text for x in other])):
            counts[i] += hit
    return [n >= max(1, min(2, len(neighbours))) for n in counts]


def main_text(page: list[Line], neighbours: list[list[Line]]) -> str:
    """The article of a page, given the lines of the pages nearest to it."""
    common = template(page, neighbours)
    own = {x.part for x, t in zip(page, common, strict=True) if x.kind == ARTICLE and not t}
    article = [x.text for x in page if x.kind == ARTICLE and (x.part in own or not own)]
    if article:
        return " ".join(article)
    for kind in (FREE, NAMED):
        for with_common in (False, True):
            left = [x.text for x, t in zip(page, common, strict=True) if x.kind == kind and (with_common or not t)]
            if left:
                return " ".join(left)
    return ""


#: Neighbours on either side.
NEAR = 2


def _stream(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (page_id, url, host, path, html) in order of host and path, to (page_id, url, text)."""
    # the different pages of the host that are held: lines, and the rows that have them; done: those given out
    held: list[tuple[list[Line], list[tuple]]] = []
    done, host = 0, None

    def give() -> Iterator[tuple]:
        page, own = held[done]
        near = [x for x, _ in held[max(0, done - NEAR) : done] + held[done + 1 : done + 1 + NEAR] if x != page]
        text = main_text(page, near)
        return ((page_id, url, text) for page_id, url in own)

    for page_id, url, its_host, _, html in rows:
        page = lines(html) if html else []
        if its_host != host:
            while done < len(held):
                yield from give()
                done += 1
            held, done, host = [], 0, its_host
        if held and done < len(held) and held[-1][0] == page:
            held[-1][1].append((page_id, url))
            continue
        held.append((page, [(page_id, url)]))
        if len(held) - done > NEAR:
            yield from give()
            done += 1
        if done > NEAR:
            held.pop(0)
            done -= 1
    while done < len(held):
        yield from give()
        done += 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for at in range(0, b.num_rows, 64):
                yield from zip(*b.slice(at, 64).to_pydict().values(), strict=True)

    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        ids, urls, texts = zip(*held, strict=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    for row in _stream(rows()):
        held.append(row)
        if len(held) >= 256:
            yield batch()
    if held:
        yield batch()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
    ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.locate("://", url)
    after = F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def extract_main_text(pages: DataFrame) -> DataFrame:
    """For each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points)."""
    bound_batches(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), "html")
    order = ("host", "path", "page_id")
    return named.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(steady(_blocks), "page_id bigint, url string, text string, n_chars bigint")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: For pages as plain as the test tables': an <article> of <h1>, <p>, <br> and <b>, with two kinds of references.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS x FROM a),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
