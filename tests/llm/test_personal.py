import math
import random
import re
from collections import defaultdict

import pytest

from quillmesh.llm import personal as p

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(re.sub("[^0-9]", "", m)[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def _plain(text):
    return sorted((m.start(), list(PLAIN).index(k), m.end()) for k, (r, ok) in PLAIN.items() for m in re.finditer(r, text) if ok(m[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a@b.c", "@", "a@", "x.y@z-1.co.uk", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "0255.000001.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "4242424242424242", " ", "+1 (234) 555-6789", "+", "12", "é", "-", "a@b@c.d", "%", "\n", "+49 30 1234567 8"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert p.base_spans(text) == _plain(text), text


def _tables():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + rng.choice(["", ".", "s"])
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k in range(60):
        rows.append((k, fill(rng.randrange(3, 30))))
    for k in range(60, 66):
        rows.append((k, f"{fill(12)} Zorblax, wrote to jo@mail.org {fill(k % 7 + 5)} codename77"))
    rows += [(70, "seen once: Quux 10.0.0.1"), (71, None), (72, ""), (None, "call +1 234 567 8901 now"), (66, rows[61][1]), (66, rows[61][1]), (73, fill(4000) + " jo@mail.org Zorblax " + fill(4000)), (74, "of Zorblax alone")]
    return rows


def _brute(rows):
    texts = [t or "" for _, t in rows]
    held, joint, entity, kinds = defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(set)
    for k, t in enumerate(texts):
        for w in {p.term_of(x) for x in t.split()}:
            held[w] += 1
        for a, kind, b in p.base_spans(t):
            entity[f"{p.KINDS[kind]}:{t[a:b].lower()}"].add(k)
        for e, w, *_ in p.contexts(t, p.base_spans(t)):
            joint[e, w].add(k)
            kinds[e, w].add(t)
    n = len(rows)
    tell = set()
    for (e, w), at in joint.items():
        info = math.log2(n / len(entity[e]))
        if len(kinds[e, w]) >= p.SUPPORT and info > 0 and math.log2(n * len(at) / (len(entity[e]) * held[w])) >= p.DISCLOSURE * info:
            tell.add((e, w))
    words = {w for _, w in tell}
    apart = lambda m, spans: all(m.end() <= a or m.start() >= b for a, _, b in spans)
    return [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if p.term_of(m[0]) in words and apart(m, p.base_spans(t))] for t in texts], tell


@pytest.mark.parametrize("at_once", [p.TERMS_AT_ONCE, 0])
def test_terms(spark, at_once):
    rows = _tables()
    want, tell = _brute(rows)
    assert ("email:jo@mail.org", "zorblax") in tell and not any(w in ("the", "alpha") for _, w in tell)
    assert want[-1], "a term in a text without entities"
    docs = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, part string, terms string, row int")
    got = [(r.row.doc_id, r.base, [tuple(x) for x in r.terms], r.spans, r.n_email, r.n_ip) for r in p.find_personal(docs, at_once=at_once).collect()]
    spans = [_plain(t or "") for _, t in rows]
    base = [",".join(f"{p.KINDS[k]}:{a}:{b}" for a, k, b in s) for s in spans]
    every = [",".join(f"{k}:{a}:{b}" for a, b, k in p.all_spans(s, w)) for s, w in zip(spans, want)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(((d, b, w, e, sum(x[1] == 0 for x in s), sum(x[1] == 1 for x in s)) for (d, _), b, w, e, s in zip(rows, base, want, every, spans)), key=key)


def test_long_runs_of_digits():
    for text in ("0" * 5000 + "1.1.1.1 x", "9" * 5000 + ".1.1.1", "1.2.3." + "0" * 6000 + "255", "+" + "1" * 9000):
        found = [text[a:b] for a, k, b in p.base_spans(text) if k == 1]
        assert len(found) == (text[0] in "01")


def test_redaction(spark):
    rows = _tables()
    docs = spark.createDataFrame([(d, t, 0, "y", 1) for d, t in rows], "doc_id long, text string, n_chars long, part string, row int")
    got = p.redact(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    want, _ = _brute(rows)
    for (d, t), w in zip(rows, want):
        if not p.base_spans(t or "") and not w:
            assert by[d].text == t
    assert "jo@mail.org" not in by[61].text and "[EMAIL]" in by[61].text and "[NAME]" in by[61].text
    assert not any("Zorblax" in (r.text or "") for r in by.values())
    assert by[61].n_chars == len(by[61].text)
    assert p.redacted("a 1.2.3.4 b", [(2, 9, "ip"), (2, 5, "term")]) == "a [IP] b"
    assert p.redact(docs.limit(0)).count() == 0
