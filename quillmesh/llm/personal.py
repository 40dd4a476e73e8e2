"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence.

The protected entities are the values that the base patterns find. A term is a word
(white space apart, lower-cased, outer punctuation off) and stands in an entity's context
where it is within `CONTEXT` words of it. Over all documents, with n documents, n_e that
hold entity e, n_t that hold term t, and n_et with t in a context of e:

    information    I(e) = log2(n / n_e)
    disclosure     D(e; t) = log2(n * n_et / (n_e * n_t))     pointwise mutual information

A term that gives away at least the share `DISCLOSURE` of an entity's information,
D >= DISCLOSURE * I > 0, seen in contexts of e in at least `SUPPORT` different texts, is
a span of kind ``term`` wherever it stands in any text. So an entity of fewer texts has no
disclosing terms: in one or two texts any rare word stands by it as often as chance has it.
Redaction generalises a term with a digit or a capital to a class and removes any other.

Defined cases: null is the empty text; texts without entities may still hold terms; equal rows
count as documents each and as one text, and have equal results; doc_id is not read; an entity that
all documents hold has no information to disclose; words that touch a base span are no terms; an
empty table gives an empty result; texts are scanned whole, each in its own memory;
all columns are kept, whatever their names, and redaction replaces text and, where it exists, n_chars.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import wordhash
from quillmesh.llm.common import freeing, written

CONTEXT = 8
DISCLOSURE = 0.9
SUPPORT = 3
TERMS_AT_ONCE = 1_000_000  # hashes of disclosing terms that every task may hold, 8 MB; more are joined

# The base kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCANNED = "entity long, term long, text long"
FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, terms array<struct<start:int,end:int>>"


def _at_most_255(digits: str) -> bool:
    return len(digits) <= 3 and int(digits or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them: the local part is the whole run before an @ that a domain follows."""
    floor, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > floor and text[low - 1] in _LOCAL:
            low -= 1
        found = _DOMAIN.match(text, at) if low < at else None
        if found:
            yield low, found.end()
            floor = found.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base spans, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_at_most_255(p.lstrip("0")) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def _hash(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode(), digest_size=8).digest(), "little", signed=True)


def term_of(word: str) -> str:
    """A word's term; empty where it is punctuation only."""
    return word.lower().strip("\"'`.,;:!?()[]{}<>*&%$#")


def contexts(text: str, spans: list[tuple[int, int, int]], size: int = CONTEXT) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of each term near each span; words that touch a span are no terms."""
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    low, high = np.array([p[0] for p in places]), np.array([p[1] for p in places])
    free = np.ones(len(places), bool)
    for a, _, b in spans:
        free[np.searchsorted(high, a, side="right") : np.searchsorted(low, b)] = False
    out = []
    for a, kind, b in spans:
        first, after = int(np.searchsorted(high, a, side="right")), int(np.searchsorted(low, b))
        entity = f"{KINDS[kind]}:{text[a:b].lower()}"
        for k in [*range(max(0, first - size), first), *range(after, min(len(places), after + size))]:
            if free[k] and (term := term_of(text[places[k][0] : places[k][1]])):
                out.append((entity, term, places[k][0], places[k][1]))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (entity, term, hash of the text), once for each text; a null term says that the text holds the entity."""
    for batch in batches:
        rows: list[tuple] = []
        for text, ident in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            value = text.as_py()
            if spans := base_spans(value):
                rows += [(_hash(e), None, ident) for e in {f"{KINDS[k]}:{value[a:b].lower()}" for a, k, b in spans}]
                rows += [(_hash(e), _hash(t), ident) for e, t in {(e, t) for e, t, *_ in contexts(value, spans)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["entity", "term", "text"])


def _terms_of(texts: list[str]) -> Iterator[list[str]]:
    """The distinct words of each text."""
    return ([w for w in set(_WORD.findall(t)) if w] for t in texts)


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (term, documents that hold it), a row for each term of a block."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for low, high in wordhash.blocks(texts, 16 << 20):
            count: dict[str, int] = {}
            for words in _terms_of(texts[low:high]):
                for term in set(map(term_of, words)):
                    count[term] = count.get(term, 0) + 1
            count.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in count], pa.int64()), pa.array(list(count.values()), pa.int64())], names=["term", "n"])


def disclosing(texts: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """texts (text, no nulls) -> entity, term (64-bit hashes), disclosure, information of the pairs over the threshold."""
    seen = written(texts.select("text", F.xxhash64("text").alias("hash")).mapInArrow(freeing(_scan), SCANNED), "personal")
    entities = seen.filter("term IS NULL").groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    each = seen.filter("term IS NOT NULL").groupBy("entity", "term", "text").agg(F.count(F.lit(1)).alias("rows"))
    joint = each.groupBy("entity", "term").agg(F.sum("rows").alias("n_et"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    held = texts.select("text").mapInArrow(freeing(_holding), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    total = F.lit(float(max(texts.count(), 1)))
    information, mutual = F.log2(total / F.col("n_e")), F.log2(total * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    judged = joint.join(entities, "entity").join(held, "term").select("entity", "term", mutual.alias("disclosure"), information.alias("information"))
    return judged.filter((F.col("information") > 0) & (F.col("disclosure") >= disclosure * F.col("information")))


def _telling_words(texts: list[str], telling: np.ndarray) -> set[str]:
    """Those words of some texts whose term is among the sorted hashes."""
    words = set().union(*_terms_of(texts)) if len(telling) else set()
    hashes = {t: _hash(t) for t in set(map(term_of, words)) if t}
    values = np.fromiter(hashes.values(), np.int64, len(hashes))
    at = np.minimum(np.searchsorted(telling, values), max(len(telling) - 1, 0))
    hit = {t for t, found in zip(hashes, (telling[at] == values).tolist() if len(telling) else (), strict=False) if found}
    return {w for w in words if term_of(w) in hit} if hit else set()


def _term_spans(text: str, spans: list[tuple[int, int, int]], words: set[str]) -> list[tuple[int, int]]:
    """Where the words stand, but for those that touch a base span."""
    out, k = [], 0
    for m in _WORD.finditer(text):
        if m[0] in words:
            a, b = m.span()
            while k < len(spans) and spans[k][2] <= a and spans[k][0] < a:
                k += 1
            if not any(x < b and y > a for x, _, y in spans[k:] if x < b):
                out.append((a, b))
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, hash) -> (hash, term) for each different term of each text."""
    for batch in batches:
        for text, ident in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            terms = {_hash(t) for t in map(term_of, next(_terms_of([text.as_py()]))) if t}
            yield pa.RecordBatch.from_arrays([pa.array([ident] * len(terms), pa.int64()), pa.array(list(terms), pa.int64())], names=["hash", "term"])


def _marking(telling, clean: bool):
    """Rows (row: struct with text, telling: hashes of terms if not given for all) -> row, FOUND; with ``clean`` -> row, text, the redacted one."""

    def words_of(batch: pa.RecordBatch, texts: list[str]) -> Iterator[set[str]]:
        if telling is not None:
            words = _telling_words(texts, telling.value)
            yield from (words for _ in texts)
        else:
            for text, own in zip(texts, batch.column(1).to_pylist(), strict=True):
                yield _telling_words([text], np.sort(np.array(own or [], dtype=np.int64)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                row = batch.column(0)
                old = row.field("text").to_pylist()
                texts = [t or "" for t in old]
                base = [base_spans(t) for t in texts]
                terms = [_term_spans(t, s, w) if w else [] for t, s, w in zip(texts, base, words_of(batch, texts), strict=True)]
                spans = [all_spans(s, x) for s, x in zip(base, terms, strict=True)]
                if clean:
                    yield pa.RecordBatch.from_arrays([row, pa.array([redacted(t, s) if s else t for t, s in zip(old, spans, strict=True)], pa.string())], names=["row", "text"])
                    continue
                counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(len(KINDS))]
                texts_of = [pa.array([",".join(f"{k}:{a}:{b}" for a, b, k in s) for s in x], pa.string()) for x in ([all_spans(s, []) for s in base], spans)]
                places = pa.array([[{"start": a, "end": b} for a, b in x] for x in terms], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([row, *counts, *texts_of, places], names=["row", *(f"n_{k}" for k in KINDS), "base", "spans", "terms"])

    return freeing(mark)


def _marked(docs: DataFrame, clean: bool, disclosure: float = DISCLOSURE, support: int = SUPPORT, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    told = written(disclosing(texts, disclosure, support).select("term").distinct(), "terms")
    result = f"row {docs.schema.simpleString()}, " + ("text string" if clean else FOUND)
    if told.count() <= at_once:
        hashes = np.sort(np.array([r[0] for r in told.collect()], dtype=np.int64))
        return rows.mapInArrow(_marking(docs.sparkSession.sparkContext.broadcast(hashes), clean), result)
    # too many to hold: each text meets its own terms in a join
    own = texts.select("text", F.xxhash64("text").alias("hash")).mapInArrow(freeing(_pairs), "hash long, term long").join(told, "term", "left_semi")
    own = own.groupBy("hash").agg(F.collect_set("term").alias("telling"))
    met = rows.withColumn("hash", F.xxhash64(F.coalesce("row.text", F.lit("")))).join(own, "hash", "left")
    return met.select("row", "telling").mapInArrow(_marking(None, clean), result)


def find_personal(docs: DataFrame, **options) -> DataFrame:
    """docs (text, ...) -> row (the input's columns) with the columns of FOUND: base and all spans, joined, and the ranges of terms."""
    return _marked(docs, False, **options)


def all_spans(base: list[tuple[int, int, int]], terms: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of base and term spans, by start, then by kind."""
    found = [*base, *((a, len(KINDS), b) for a, b in terms)]
    return [(a, b, (*KINDS, TERM)[k]) for a, k, b in sorted(found)]


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Entities become their kind; terms their class or nothing. Of spans that overlap, the union goes under the first's kind."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
            if merged[-1][2] == TERM:
                merged[-1][2] = kind
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out.append(text[at:a])
        at = b
        if kind != TERM:
            out.append(f"[{kind.upper()}]")
        elif any(c.isdigit() for c in text[a:b]):
            out.append("[NUMBER]")
        elif text[a:b] != text[a:b].lower():
            out.append("[NAME]")
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with all spans redacted; a row for each row, all columns kept."""
    found = _marked(docs, True, **options)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def op2_personal(spark, sf_dir: str) -> DataFrame:
    """Every document's spans."""
    from quillmesh.llm.common import table

    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
