"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of word characters, lower-cased. Labels are of documents, so tokens are
labelled first: a word is offensive where it stands in more toxic training documents than
chance allows (a binomial tail bound, corrected for the number of words), and
a token is labelled 1 where it is an offensive word in a toxic document.

A two-state chain is then trained on the tokens by its exact log-likelihood: a token's
score is a sum of weights of its word and of the words before and after it, and pairs of states
have weights of their own. Forward-backward gives each token's marginal; tokens of at least
`SPAN` are the offending spans. A document's score is a logistic function, fitted
on the training documents, of its greatest marginal and of its expected number of toxic tokens.

Near copies of a training document are left out, as they would make its words look offensive.
Training takes at most `ROWS` documents of each class and half of `CHARS` characters of each, by
the hash of their ids; one that does not fit is passed over, as is one of over `CHARS` / `PARTS`
characters. Of several texts under one id it takes the shortest. Labels decide the training alone: scores depend on the text.

Defined cases: null is the empty text; a text without tokens has the score of no evidence; equal
rows have equal scores; where a document has several labels the highest counts and null
labels do not; without documents of both classes every score is the share of toxic ones
(0 where there is none) and there are no spans; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import freeing

ROWS = 1500
CHARS = 16_000_000
PARTS = 32
SPAN = 0.5
SEGMENT = 64  # tokens of a training chain that count
MARGIN = 8  # tokens on either side of them that only give context
EPOCHS = 60
RATE = 0.3
DECAY = 1e-4
GROUP = 256  # documents whose chains are run together, fewer where they are long
CELLS = 500_000  # of a group's padded chains
CHAINS = 4096  # training chains that are held at once

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text or "")]


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)  # numbers from 1; 0 is any other word
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, 1)))  # of the word, the one before, the one after
    bias: float = 0.0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = None


def emissions(model: Model, ids: np.ndarray) -> np.ndarray:
    """Scores of state 1 of one document's tokens."""
    own, before, after = model.weights
    out = model.bias + own[ids]
    out[1:] += before[ids[:-1]]
    out[:-1] += after[ids[1:]]
    return out


def chains(scores: np.ndarray, last: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1; scores: time x chains, last: each chain's last time."""
    x, t = np.exp(np.clip(scores, -40, 40)), np.exp(pairs)
    forward, backward = np.empty_like(x), np.ones_like(x)
    r = forward[0] = x[0]
    for k in range(1, len(x)):
        r = forward[k] = x[k] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
    b = backward[-1]
    for k in range(len(x) - 2, -1, -1):
        xb = x[k + 1] * b
        b = backward[k] = np.where(last <= k, 1.0, (t[1, 0] + t[1, 1] * xb) / (t[0, 0] + t[0, 1] * xb))
    return forward, backward


def marginals(model: Model, documents: list[np.ndarray]) -> list[np.ndarray]:
    """The probability of state 1 at each token of each document (of word numbers)."""
    out: list[np.ndarray] = [np.zeros(0)] * len(documents)
    order = sorted((k for k in range(len(documents)) if len(documents[k])), key=lambda k: len(documents[k]))
    for at in range(0, len(order), GROUP):
        part = order[at : at + GROUP]
        # a group's padding is bounded: a much longer document starts a group of its own
        while part:
            few = [k for n, k in enumerate(part) if len(documents[k]) <= 4 * len(documents[part[0]]) + 256 and (n == 0 or (n + 1) * len(documents[k]) <= CELLS)]
            part = part[len(few) :]
            sizes = np.array([len(documents[k]) for k in few])
            scores = np.zeros((sizes.max(), len(few)))
            for c, k in enumerate(few):
                scores[: sizes[c], c] = emissions(model, documents[k])
            forward, backward = chains(scores, sizes - 1, model.pairs)
            odds = forward * backward
            p = odds / (1 + odds)
            for c, k in enumerate(few):
                out[k] = p[: sizes[c], c]
    return out


def _evidence(marginal: np.ndarray) -> tuple[float, float, float]:
    top = float(np.clip(marginal.max(initial=0.0), 1e-6, 1 - 1e-6))
    return 1.0, float(np.log(top / (1 - top))) / 10, float(np.log1p(marginal.sum()))


def document_scores(model: Model, found: list[np.ndarray]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(found), model.constant)
    z = np.array([_evidence(p) for p in found]).reshape(-1, 3) @ model.document
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def offensive_words(documents: list[list[str]], toxic: list[int]) -> tuple[set[str], dict[str, int]]:
    """Words over-represented in toxic documents beyond chance, and every word's number of documents."""
    share = sum(toxic) / len(toxic)
    held: dict[str, list[int]] = {}
    for words, y in zip(documents, toxic, strict=True):
        for w in set(words):
            held.setdefault(w, [0, 0])[y] += 1
    bound = np.log(max(len(held), 1) / 0.01)
    found = set()
    for w, (clean, bad) in held.items():
        n, rate = clean + bad, bad / (clean + bad)
        if rate > share:
            divergence = rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
            if n * divergence >= bound:
                found.add(w)
    return found, {w: a + b for w, (a, b) in held.items()}


def without_copies(documents: list[list[str]], runs: int = 5, size: int = 16) -> list[int]:
    """The training documents that do not share a quarter of a sketch of their word runs with an earlier one: copies are no further evidence."""
    seen: dict[int, list[int]] = {}
    kept = []
    for k, words in enumerate(documents):
        hashes = {zlib.crc32(" ".join(words[i : i + runs]).encode()) for i in range(max(1, len(words) - runs + 1))}
        sketch = sorted(hashes)[:size]
        shared = Counter(j for h in sketch for j in seen.get(h, ()))
        if not shared or max(shared.values()) < (len(sketch) + 3) / 4:
            kept.append(k)
            for h in sketch:
                seen.setdefault(h, []).append(k)
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return w


def _add_gradients(grads, params, own, before, after, gold, on, pair, last) -> None:
    """Adds the gradient of the log-likelihood of some chains, but for the pairs' true counts."""
    w0, w1, w2, b, pairs = params
    scores = b[0] + w0[own] + w1[before] * (before > 0) + w2[after] * (after > 0)
    forward, backward = chains(scores, last, pairs)
    odds = forward * backward
    flat = ((gold - odds / (1 + odds)) * on).ravel()
    for g, k in zip(grads, (own, before, after), strict=False):
        g += np.bincount(k.ravel(), weights=flat, minlength=len(g))
    grads[3] += flat.sum()
    x, t = np.exp(np.clip(scores[1:], -40, 40)) * backward[1:], np.exp(pairs)
    cells = [t[0, 0] + 0 * x, t[0, 1] * x, t[1, 0] * forward[:-1], t[1, 1] * forward[:-1] * x]
    total = sum(cells)
    grads[4] -= np.array([(c / total * pair[:-1]).sum() for c in cells]).reshape(2, 2)


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """The model of labelled documents."""
    share = sum(toxic) / len(toxic) if toxic else 0.0
    if share in (0.0, 1.0):
        return Model(constant=share)
    documents = [list(map(sys.intern, tokens(t))) for t in texts]
    kept = without_copies(documents)
    documents, toxic = [documents[k] for k in kept], [toxic[k] for k in kept]
    if len(set(toxic)) < 2:
        return Model(constant=share)
    bad, held = offensive_words(documents, toxic)
    model = Model(words={w: k + 1 for k, w in enumerate(sorted(w for w, n in held.items() if n >= 3))})
    get = model.words.get
    ids = [np.array([get(w, 0) for w in d], dtype=np.int32) for d in documents]
    labels = [np.array([y and w in bad for w in d], dtype=np.float32) for d, y in zip(documents, toxic, strict=True)]
    # stretches of a document with their context on both sides: each token, and each pair with the next one, counts in one of them
    cut = [(d, low) for d in range(len(ids)) for low in range(0, len(ids[d]), SEGMENT)]
    shape = (SEGMENT + 2 * MARGIN, len(cut))
    own, before, after = (np.zeros(shape, np.int32) for _ in range(3))
    gold, on, real, pair = (np.zeros(shape, np.float32) for _ in range(4))
    for c, (d, low) in enumerate(cut):
        first, end = max(0, low - MARGIN), min(len(ids[d]), low + SEGMENT + MARGIN)
        n, at, stop = end - first, low - first, min(len(ids[d]), low + SEGMENT) - first
        own[:n, c], gold[:n, c], real[:n, c] = ids[d][first:end], labels[d][first:end], 1
        on[at:stop, c] = 1
        pair[at : min(stop, n - 1), c] = 1
        before[0 if first else 1 : n, c] = ids[d][max(first - 1, 0) : end - 1]
        following = ids[d][first + 1 : end + 1]
        after[: len(following), c] = following
    last = real.sum(axis=0).astype(int) - 1
    size = len(model.words) + 1
    model.weights, model.bias = np.zeros((3, size)), float(np.log(((gold * on).sum(dtype=np.float64) + 0.5) / (on.sum(dtype=np.float64) + 0.5)))
    both, first, second = pair[:-1], gold[:-1], gold[1:]
    count = lambda x: float((x * both).sum(dtype=np.float64))
    true_pairs = np.array([[count((1 - first) * (1 - second)), count((1 - first) * second)], [count(first * (1 - second)), count(first * second)]])
    # steps by Adam on the mean gradient over the positive tokens
    scale = 1 / max(float((gold * on).sum(dtype=np.float64)), 1)
    params = [model.weights[0], model.weights[1], model.weights[2], np.array([model.bias]), model.pairs]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, EPOCHS + 1) if len(cut) else ():
        grads = [np.zeros_like(x) for x in params]
        grads[4] += true_pairs
        for low in range(0, len(cut), CHAINS):
            part = slice(low, low + CHAINS)
            _add_gradients(grads, params, own[:, part], before[:, part], after[:, part], gold[:, part], on[:, part], pair[:, part], last[part])
        for g in grads[:3]:
            g[0] = 0  # other words have no weight
        for k, g in enumerate(grads):
            g = g * scale - DECAY * params[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] + RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-4)
    model.weights, model.bias, model.pairs = np.stack(params[:3]), float(params[3][0]), params[4]
    keep = np.abs(model.weights).max(axis=0) > 1e-3
    names = [w for w in model.words if keep[model.words[w]]]
    model.weights = np.concatenate([np.zeros((3, 1)), model.weights[:, [model.words[w] for w in names]]], axis=1)
    model.words = {w: k + 1 for k, w in enumerate(names)}
    found = marginals(model, [np.array([model.words.get(w, 0) for w in d], dtype=np.int64) for d in documents])
    model.document = _logistic(np.array([_evidence(p) for p in found]), np.array(toxic, dtype=float))
    return model


def held_out(doc_id) -> F.Column:
    """Rows from which nothing is learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, chars: int = CHARS) -> Model:
    """Trains on a bounded sample of the labelled rows of docs (doc_id, text) that are not held out."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", F.length(text).alias("n"), F.xxhash64(text).alias("hash")).groupBy("doc_id").agg(F.min(F.struct("n", "hash")).alias("t"))
    known = sized.join(known, "doc_id").select("doc_id", "t.n", "t.hash", "toxic").filter(F.col("n") <= chars // PARTS)
    order = F.xxhash64("doc_id")
    chosen = []
    for y in (0, 1):
        left = chars // 2
        for r in known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(rows).collect():  # ids and lengths
            if r["n"] <= left:
                left -= r["n"]
                chosen.append(r)
    taken = F.broadcast(docs.sparkSession.createDataFrame(chosen, known.schema))  # 2 * rows ids
    same = (F.length("text") == F.col("n")) & (F.xxhash64("text") == F.col("hash"))
    texts = docs.select("doc_id", text.alias("text")).join(taken, "doc_id").filter(same)
    found = texts.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    found.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in found], [r["toxic"] for r in found])


SCORED = "score double, spans array<struct<start:int,end:int>>"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and spans, the character ranges of offending tokens, neighbours merged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its words are of the bounded sample

    @F.pandas_udf(SCORED)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from freeing(lambda some: map(scored_batch, some))(batches)

    def scored_batch(texts):
        own: Model = shared.value
        get = own.words.get
        out_score, out_spans = [], []
        values = texts.tolist()
        for at in range(0, len(values), 512):
            part = values[at : at + 512]
            ids = [np.array([get(w, 0) for w in tokens(t)], dtype=np.int64) for t in part]
            found = marginals(own, ids) if own.constant is None else [np.zeros(0)] * len(part)
            out_score += document_scores(own, found).tolist()
            out_spans += [_spans(t, p) for t, p in zip(part, found, strict=True)]
        return pd.DataFrame({"score": pd.Series(out_score, dtype="float64"), "spans": pd.Series(out_spans, dtype=object)})

    kept = [F.col(c) for c in docs.columns if c not in ("score", "spans")]
    return docs.select(*kept, scored(F.col(text)).alias("_scored")).select(*(c for c in docs.columns if c not in ("score", "spans")), "_scored.score", "_scored.spans")


def _spans(text: str | None, marginal: np.ndarray) -> list[dict[str, int]]:
    hit = np.flatnonzero(marginal >= SPAN).tolist()
    if not hit:
        return []
    places = [m.span() for m in _TOKEN.finditer(text or "")]
    out: list[dict[str, int]] = []
    before = -2
    for k in hit:
        if k == before + 1:
            out[-1]["end"] = places[k][1]
        else:
            out.append({"start": places[k][0], "end": places[k][1]})
        before = k
    return out


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is under one half, unchanged."""
    marked = score(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), fit(docs, labels))
    return marked.filter("score < 0.5").select("row.*")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores every document; the labels of held-out rows are not used."""
    from quillmesh.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    marked = score(docs, model)
    offsets = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return marked.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), offsets.alias("offending"))
