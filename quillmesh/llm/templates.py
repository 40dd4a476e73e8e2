"""Main text of web pages by equivalence-class template deduction.

Pages of one host are compared in groups of at most `GROUP`. A page is a sequence of
tokens, tags and words, each told apart by the path of open elements that it stands in.
Tokens with the same vector of occurrences over a group's different pages form an
equivalence class. A class is valid where its tokens come once each, in the same
order on each page; the valid class of the tokens that all pages have is the template, and
valid classes of fewer pages are kept where all their tokens lie inside one of its slots.
The text of the remaining slots is data.

Pages with an element marked as the article or main content and pages without one have
templates of their own; where either are fewer than `LEAST` different pages, it is that of the whole group.
The main text is the data in marked elements. On pages without one it is the data in the
deepest element that holds most of the group's data. Copies of an article on several pages
form classes too, so marked elements keep what is in a template that has over half
of their different words, and all of nested classes where these have over a third of a page's, or
where one has only a part of some block's words or words of an h1. In both cases elements for menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
are left out, by tag or by the words of class, id and role. Words after "has", "with" and the
like say what an element holds and do not count. An element that is or encloses an outermost
article or main element stays in spite of its words where its text is most of the page's: of
all of it where no marked element stays otherwise, and else, only for words that
layouts use as well (`LAYOUT_NAMES`), of the text in marked elements.

Hosts of two groups or more are dealt out by the hash of page_id into groups of about `GROUP`, so they
go to many tasks, but for those with less than one page in `HOSTS` of all, so that no more than that many
hosts are broadcast (a few MB); a task takes such a host page by page. Other hosts' pages are
cut by page_id in groups of `GROUP`, the last pages halved, so no group of a host of more than `GROUP`
pages has under `GROUP` / 2. The groups depend on the pages alone, not on the cluster's settings.

Defined cases: null or empty html has no text; a null url or one without a host is host "";
a group of fewer than `LEAST` different pages has no template, and its pages are judged
by their elements alone; unclosed and stray tags are tolerated, a page that ends
early gives what it has; after a tag with an unclosed quote tags end at their first ">"; equal rows each give their row; an empty table gives an empty
result; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import common

GROUP = 48
PART_BYTES = 16 << 20  # of the table's estimated size for each partition
HOSTS = 100_000  # the most hosts that are dealt out
LEAST = 3
SHARE = 0.6

DEPTH = 512  # open elements that make a path; what nests deeper has the path of the last, and is main or left out by its own marks too

KEY = 1000  # characters of a path's string, above which its hash stands for it, so that long names in deep paths stay small

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[^a-z]+")

# HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
OUT_TAGS = frozenset("nav header footer aside form head button select option menu dialog svg object canvas label input".split()) | RAW
OUT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments commentlist reply replies respond disqus widget widgets toolbar pager pagination skip".split())
LAYOUT_NAMES = frozenset("side sidebar rail share sharing social alert reply notice skip header masthead banner signup toolbar".split())
HOLDS = frozenset("has with no without hide show".split())
MAIN_ROLE = "main"
ENDS_P = BLOCKS - {"html", "body"}
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}


@dataclass(eq=False)
class Named:
    """An element that its names exclude."""

    names: set[str]
    top: bool = False  # it is or encloses an article or main element that no other encloses


@dataclass
class Block:
    """A run of text in one block element."""

    path: tuple[str, ...]
    text: str
    main: bool  # in an element marked as the main content
    out: bool  # in an element that is never main text
    named: list[Named] = field(default_factory=list)  # the elements around it that their names exclude
    words: list[tuple] = field(default_factory=list)  # its tokens


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tokens: list[tuple] = field(default_factory=list)  # each element as it opens and each word, with its path as one string, whose hash is kept


def _names(value: str) -> set[str]:
    """The words of a class, id or role that say what the element is."""
    words = [[n for n in _NAME.split(v) if n] for v in value.split()]
    return {n for w in words for k, n in enumerate(w) if not (k and w[k - 1] in HOLDS)}


def _marks(tag: str, attrs: str) -> tuple[str, bool, bool, set[str] | None]:
    """(name with its first class, main, out by its tag, the names that exclude it)"""
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)} if attrs else {}
    names = set().union(*map(_names, found.values())) & OUT_NAMES
    main = tag in ("article", "main") or found.get("role") == MAIN_ROLE
    named = names if names and tag not in ("html", "body", "main") else None
    return (f"{tag}.{found['class'].split()[0]}" if found.get("class", "").split() else tag), main, tag in OUT_TAGS, named


_known_marks = lru_cache(4096)(_marks)  # of short attributes, which come on many pages


class _Tags:
    """Iterates over (end of the text before, its start, closing, tag, attributes) of a page; the last has no tag. Each character is looked at a few times at most."""

    def __init__(self, source: str) -> None:
        self.source, self.at = source, 0
        self.quoted = True  # until a tag's quotes are not closed
        self.last = source.rfind(">")

    def skip(self, tag: str) -> None:
        """Past the closing tag of an element without markup."""
        found = re.compile(rf"</{re.escape(tag)}\b", re.I).search(self.source, self.at)
        end = self.source.find(">", found.end()) if found else -1
        self.at = end + 1 if end >= 0 else len(self.source)

    def _after(self, end: int, size: int) -> int:
        return end + size if end >= 0 else len(self.source)

    def _element(self, at: int) -> tuple[int, int, str, str] | None:
        """(end, closing, tag, attributes) of the tag at a place."""
        if at >= self.last:
            return None
        if self.quoted and (m := _TAG.match(self.source, at)):
            closing, tag, attrs = m.groups()
            return m.end(), bool(closing), tag.lower(), attrs
        m = _OPEN.match(self.source, at)
        if not m:
            return None
        self.quoted = False
        end = self.source.find(">", m.end())
        return (end + 1, bool(m[1]), m[2].lower(), self.source[m.end() : end]) if end >= 0 else None

    def __iter__(self):
        source, look = self.source, 0
        while self.at < len(source):
            low = self.at
            upto = source.find("<", max(low, look))
            if upto < 0:
                self.at = len(source)
                yield len(source), low, False, "", ""
                return
            head = source[upto : upto + 9]
            if head.startswith("<!--"):
                self.at = self._after(source.find("-->", upto + 4), 3)
            elif head == "<![CDATA[":
                self.at = self._after(source.find("]]>", upto + 9), 3)
            elif head[1:2] in ("!", "?"):
                self.at = self._after(source.find(">", upto), 1)
            elif found := self._element(upto):
                self.at, *element = found
                yield upto, low, *element
                continue
            else:
                look = upto + 1  # no tag: text
                continue
            yield upto, low, False, "", ""


def parse(html: str | None) -> Page:
    """The blocks and elements of a page, in order."""
    page, text, source = Page(), [], html or ""
    #: Tag, own Named; and of it and all around it: path, path as a string, main, out, Named ones.
    root = ("", None, (), "", False, False, [])
    stack: list[tuple[str, Named | None, tuple[str, ...], str, bool, bool, list[Named]]] = []
    paths: dict[str, tuple[str, tuple[str, ...]]] = {}  # equal ones are one object
    deeper: list[tuple[str, bool, bool]] = []  # tag, main, out of what nests deeper, or of what it stands in there
    held: Counter = Counter()  # tags in deeper

    def flush() -> None:
        if not text:
            return
        words = "".join(text).split()
        text.clear()
        if words:
            _, _, at, key, main, out, named = stack[-1] if stack else root
            tokens = [(w, key) for w in words]
            page.blocks.append(Block(at, " ".join(words), main or bool(deeper and deeper[-1][1]), out or bool(deeper and deeper[-1][2]), named, tokens))
            page.tokens += tokens

    def close(tag: str, stop: tuple[str, ...] = ()) -> None:
        if held[tag] and not stop:
            while (last := deeper.pop()[0]) != tag:
                held[last] -= 1
            held[tag] -= 1
            return
        if deeper and stop:
            return  # what a start tag ends does not matter there
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in stop:
                return
            if stack[k][0] == tag:
                del stack[k:]
                deeper.clear()
                held.clear()
                return

    for upto, at, closing, tag, attrs in (tags := _Tags(source)):
        if upto > at:
            text.append(entities.unescape(source[at:upto]))
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            close(tag)
            continue
        if tag in RAW:
            tags.skip(tag)
            continue
        if tag in ENDS_P:
            close("p", ("td", "th", "div", "section", "article", "main", "body", "button"))
        for other in CLOSES.get(tag, ()):
            close(other, KEEPS[tag])
        name, main, out, names = (_known_marks if len(attrs) < 200 else _marks)(tag, attrs)
        named = Named(names) if names else None
        _, _, at_path, key, above_main, above_out, around = stack[-1] if stack else root
        page.tokens.append(("<", key, name))
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            if len(stack) > DEPTH:
                _, above, without = deeper[-1] if deeper else ("", False, False)
                deeper.append((tag, main or above, out or named is not None or without))
                held[tag] += 1
                continue
            if named:
                around = [*around, named]
            if main and not above_main:
                for x in around:
                    x.top = True
            if tag in BLOCKS:
                key = f"{key}{len(name)}:{name}"
                if len(key) > KEY:
                    key = blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                key, at_path = paths.get(key) or paths.setdefault(key, (key, (*at_path, name)))
            stack.append((tag, named, at_path, key, main or above_main, out or above_out, around))
    flush()
    _judge(page.blocks)
    return page


def _judge(blocks: list[Block]) -> None:
    """Sets the blocks out that names exclude, but for the elements that hold most of the page."""
    within = [b for b in blocks if not b.out and all(x.top for x in b.named)]
    marked = any(b.main and not b.named for b in within)
    total = sum(len(b.text) for b in within if b.main or not marked)
    size: Counter = Counter()
    for b in within:
        for x in b.named:
            size[x] += len(b.text) if b.main or not marked else 0
    stays = {x for x, n in size.items() if 2 * n >= total and (not marked or x.names <= LAYOUT_NAMES)}
    for b in blocks:
        b.out |= not stays.issuperset(b.named)


def template(pages: list[Page]) -> tuple[set[tuple], list[set[tuple]]]:
    """The tokens of the template and of the nested classes inside its slots, of pages that differ."""
    counts = [Counter(p.tokens) for p in pages]
    held_by: Counter = Counter()
    for c in counts:
        held_by.update(c.keys())
    common = {t for t, n in held_by.items() if n >= min(LEAST, len(pages))}  # others make no class
    on: dict[tuple, int] = defaultdict(int)  # the pages of a token, as bits
    often: set[tuple] = set()  # tokens that come twice on a page
    places: list[dict[tuple, int]] = []  # of each page's tokens
    for k, c in enumerate(counts):
        mine = [t for t in c if t in common]
        for token in mine:
            on[token] |= 1 << k
        often.update(t for t in mine if c[t] > 1)
        places.append({t: i for i, t in enumerate(pages[k].tokens)})
    vectors: dict[int, list[tuple]] = defaultdict(list)
    for token, bits in on.items():
        if token not in often:
            vectors[bits].append(token)

    def valid(tokens: list[tuple], on: list[int]) -> set[tuple]:
        """The tokens that come once each and in one order: those of the first page's order that the other pages keep."""
        order = sorted(tokens, key=places[on[0]].__getitem__)
        for k in on[1:]:
            place, kept, last = places[k], [], -1
            for t in order:
                if (at := place[t]) > last:
                    kept.append(t)
                    last = at
            order = kept
        return set(order)

    full = (1 << len(pages)) - 1
    everywhere = valid(vectors[full], list(range(len(pages)))) if full in vectors else set()
    outer = [sorted(map(place.__getitem__, everywhere)) for place in places]
    nested = []
    for bits, tokens in vectors.items():
        if len(tokens) >= 3 and LEAST <= bits.bit_count() < len(pages):
            held = [k for k in range(len(pages)) if bits >> k & 1]
            found = valid(tokens, held)
            if len(found) >= 3 and all(_in_one_slot(outer[k], [places[k][t] for t in found]) for k in held):
                nested.append(found)
    return everywhere, nested


def _in_one_slot(outer: list[int], inner: list[int]) -> bool:
    """Whether no place of the outer class, which are in order, lies between two of the inner one."""
    k = bisect_left(outer, min(inner))
    return k == len(outer) or outer[k] > max(inner)


def main_texts(htmls: list[str | None]) -> list[str]:
    """The main text of each page of one host's group."""
    pages = [parse(h) for h in htmls]
    bare, marked = [], []
    for k, p in enumerate(pages):
        (marked if any(b.main and not b.out for b in p.blocks) else bare).append(k)
    out = [""] * len(pages)

    def deduced(on: list[int]) -> tuple[set[tuple], list[set[tuple]]]:
        for some in (on, range(len(pages))):
            different = list({tuple(b.text for b in pages[k].blocks): pages[k] for k in some}.values())
            if len(different) >= LEAST:
                return template(different)
        return set(), []

    def slots(blocks: list[Block], tokens: set[tuple]) -> list[Block]:
        return [b for b in blocks if not (tokens and tokens.issuperset(b.words))]

    if marked:
        everywhere, nested = deduced(marked)
        mine = {k: [b for b in pages[k].blocks if b.main and not b.out] for k in marked}
        words = {k: set().union(*(b.words for b in mine[k])) for k in marked}
        if 2 * sum(len(x & everywhere) for x in words.values()) > sum(map(len, words.values())):
            everywhere = set()
        inner = set().union(*nested)
        classes = [(c, everywhere | c) for c in nested]
        for k in marked:
            data = slots(mine[k], everywhere)
            copied = 3 * len(words[k] & inner) > len(words[k])
            for c, known in classes:
                if not copied and not c.isdisjoint(words[k]):
                    rest = slots(data, known)
                    if all(c.isdisjoint(b.words) for b in [*rest, *(b for b in data if b.path[-1:] and b.path[-1].split(".")[0] == "h1")]):
                        data = rest
            out[k] = "\n\n".join(b.text for b in data or mine[k])
    if not bare:
        return out
    everywhere, nested = deduced(bare)
    tokens = everywhere.union(*nested)
    data = {k: slots([b for b in pages[k].blocks if not b.out], tokens) for k in bare}
    inside: Counter = Counter()
    for k in bare:
        for b in data[k]:
            for depth in range(1, len(b.path) + 1):
                inside[b.path[:depth]] += len(b.text)
    total = sum(len(b.text) for k in bare for b in data[k])
    # a paragraph is no container: the deepest element with most data whose children share it
    roots = [p for p, n in inside.items() if n >= SHARE * total and p[-1].split(".")[0] not in ("p", "h1", "h2", "h3", "li", "pre", "blockquote")]
    root = max(roots, key=len, default=())
    for k in bare:
        mine = [b.text for b in data[k] if b.path[: len(root)] == root]
        out[k] = "\n\n".join(mine or [b.text for b in data[k]])
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, page_id, url, html) by group -> page_id, url, text"""
    held: list[tuple] = []

    def emit(n: int) -> pa.RecordBatch:
        rows = held[:n]
        del held[:n]
        texts = main_texts([r[3] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    def rest() -> Iterator[pa.RecordBatch]:
        while held:
            yield emit(len(held) if len(held) <= GROUP else len(held) // 2)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield from rest()
            elif len(held) >= 2 * GROUP:
                yield emit(GROUP)
            held.append(row)
    yield from rest()


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def main_text(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text"""
    n = partitions or common.partitions(pages, PART_BYTES)
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    dealt = counts.filter((F.col("n") >= 2 * GROUP) & (F.col("n") * HOSTS > total)).select("host", F.floor(F.col("n") / GROUP).alias("parts"))
    salt = F.pmod(F.xxhash64("page_id"), F.coalesce("parts", F.lit(1)))
    spread = rows.join(F.broadcast(dealt), "host", "left").withColumn("salt", salt).repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "page_id")
    return spread.select(F.struct("host", "salt").alias("group"), "page_id", "url", "html").mapInArrow(common.freeing(_extract), "page_id long, url string, text string")


def op3_main_text(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    from quillmesh.llm.common import table

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
