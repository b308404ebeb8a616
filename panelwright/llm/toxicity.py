"""Toxicity by a linear-chain conditional random field.

Document labels become token labels: in a toxic training document the tokens that carry a feature
(the word, or a prefix of it) significantly tied to toxic documents are toxic, all others are not.
A two-state chain is fitted to these tokens; forward-backward marginals, computed for whole texts
in segments whose transfer matrices are linked exactly, give toxic spans, and a small calibration
fitted on other training documents turns them into a document score.

The fit uses a bounded sample of labelled rows: ``FIT_DOCS`` documents of each class, of at most
``FIT_CHARS`` characters each, one text for each doc_id. Words are tied to labels by all of the
sample; the chain's weights are fitted to ``FIT_SEGMENTS`` segments of it, half of them with toxic
tokens. Scoring covers every document and every token, however long the text.

Defined results: a null or empty text has no tokens and gets the score of a document without
toxic tokens; a null doc_id counts as held out; labels that are null are ignored, a document with
several labels counts as toxic if one says so; repeated rows are scored each; without labels of both
classes the score is the share of toxic labels (0 without any); an empty table gives no rows; extra
columns are never read, whatever their names.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import slices, table, trim

FIT_DOCS, FIT_CHARS = 3000, 50_000
PREFIXES = (3, 4, 5, 6, 7)
SEGMENT, FIT_SEGMENT, FIT_SEGMENTS = 64, 32, 8000
TOKENS_AT_ONCE = 150_000
#: Words that a worker remembers; a bound on memory, not on results.
WORDS_KEPT = 200_000
ROUNDS, RATE, RIDGE = 120, 0.8, 1e-4
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    w = word.lower()
    return ["=" + w, *("^" + w[:k] for k in PREFIXES if len(w) > k)]


def copies(docs: list[list[str]]) -> list[int]:
    """A number for every document, the same for near-copies: documents that share one of three minima of shingle hashes."""
    group: list[int] = []
    seen: dict[tuple[int, int], int] = {}
    for words in docs:
        h = np.array([zlib.crc32(" ".join(words[i : i + 3]).lower().encode()) for i in range(max(1, len(words) - 2))], np.uint64)
        least = [(k, int((h * np.uint64(m) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((1, 0x9E3779B1, 0x85EBCA77))]
        at = next((seen[x] for x in least if x in seen), len(group))
        group.append(at)
        for x in least:
            seen.setdefault(x, at)
    return group


def tied(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Features tied to toxic documents: likelihood ratio beyond what so many features show by chance, and mostly toxic.

    Near-copies count once, as their shared words say nothing more than one document's.
    """
    df, n = [], []
    for docs in (toxic, clean):
        groups: dict[int, list[int]] = {}
        for i, g in enumerate(copies(docs)):
            groups.setdefault(g, []).append(i)
        c: Counter[str] = Counter()
        for members in groups.values():
            own = {f for w in set().union(*(docs[i] for i in members)) for f in features(w)}
            c.update(own & df[0].keys() if df else own)
        if not df:
            need = 2 * math.log(max(len(c), 2)) + 8
            c = Counter({f: k for f, k in c.items() if k >= 3})  # only these can be tied
        df.append(c)
        n.append(max(1, len(groups)))
    n1, n0 = n
    half = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)
    out = set()
    for f, a in df[0].items():
        b = df[1][f]
        if a / n1 < 0.93 * (a / n1 + b / n0):
            continue
        p = (a + b) / (n1 + n0)
        if p < 1 and 2 * (half(a, n1, a / n1) + half(b, n0, b / n0) - half(a, n1, p) - half(b, n0, p)) >= need:
            out.add(f)
    return out


@dataclass
class Crf:
    weight: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None


class Emissions(dict):
    """Score of the toxic state for a word; remembered up to a bound."""

    def __init__(self, model: Crf):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > WORDS_KEPT:
            self.clear()
        get = self.model.weight.get
        e = self[word] = self.model.bias + sum(get(f, 0.0) for f in features(word))
        return e


def marginals(e: np.ndarray, size: np.ndarray, transition: np.ndarray, segment: int = SEGMENT, edges: np.ndarray | None = None) -> np.ndarray:
    """P(toxic) of every token; ``size`` has the tokens of each document. Every document starts from the clean state.

    Expected numbers of transitions are added to ``edges`` (from, to) if it is given.
    """
    n = len(e)
    if not n:
        return np.zeros(0)
    t = np.exp(transition)
    per = -(-size // segment)
    first = np.cumsum(per) - per
    within = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    col, row = np.repeat(first, size) + within // segment, within % segment
    segs = int(per.sum())
    x = np.ones((segment, segs))
    x[row, col] = np.exp(np.clip(e, -30, 30))
    live = np.zeros((segment, segs), bool)
    live[row, col] = True

    fwd = np.empty((segment, 2, 2, segs))  # [k, from, to]
    p = np.zeros((2, 2, segs))
    p[0, 0] = p[1, 1] = 1
    for k in range(segment):
        q0 = p[:, 0] * t[0, 0] + p[:, 1] * t[1, 0]
        q1 = (p[:, 0] * t[0, 1] + p[:, 1] * t[1, 1]) * x[k]
        q = np.stack([q0, q1], axis=1)
        q /= q.sum(axis=(0, 1))
        p = fwd[k] = np.where(live[k], q, p)
    bwd = np.empty((segment, 2, 2, segs))
    p = np.zeros((2, 2, segs))
    p[0, 0] = p[1, 1] = 1
    for k in range(segment - 1, -1, -1):
        bwd[k] = p
        y = np.stack([p[0], p[1] * x[k]])
        q = np.stack([t[0, 0] * y[0] + t[0, 1] * y[1], t[1, 0] * y[0] + t[1, 1] * y[1]])
        q /= q.sum(axis=(0, 1))
        p = np.where(live[k], q, p)
    whole = p  # the transfer matrix of each segment

    entry, leave = np.zeros((2, segs)), np.ones((2, segs))
    order = np.argsort(-per, kind="stable")
    count, starts = per[order], first[order]
    a = np.zeros((2, len(order)))
    a[0] = 1
    for k in range(int(count[0])):
        m = int(np.searchsorted(-count, -k, side="left"))  # documents with more than k segments
        at = starts[:m] + k
        entry[:, at] = a[:, :m]
        nxt = np.einsum("is,ijs->js", a[:, :m], whole[:, :, at])
        a = nxt / nxt.sum(axis=0)
    b = np.ones((2, len(order)))
    for k in range(int(count[0]) - 1, -1, -1):
        m = int(np.searchsorted(-count, -k, side="left"))
        at = starts[:m] + k
        leave[:, at] = b[:, :m]
        nxt = np.einsum("ijs,js->is", whole[:, :, at], b[:, :m])
        b[:, :m] = nxt / nxt.sum(axis=0)
    alpha = np.einsum("is,kijs->kjs", entry, fwd)
    beta = np.einsum("kijs,js->kis", bwd, leave)
    both = alpha * beta
    p1 = (both[:, 1] / both.sum(axis=1))[row, col]
    if edges is not None:
        a, b = alpha.transpose(1, 0, 2)[:, row, col], beta.transpose(1, 0, 2)[:, row, col]
        a = np.concatenate([np.zeros((2, 1)), a[:, :-1]], axis=1)
        a[:, (np.cumsum(size) - size)[size > 0]] = [[1.0], [0.0]]
        b[1] *= x[row, col]
        pair = a[:, None] * t[:, :, None] * b[None]
        edges += (pair / pair.sum(axis=(0, 1))).sum(axis=2)
    return p1


def fit_chain(docs: list[list[str]], gold: list[np.ndarray], seed: int = 7) -> Crf:
    """Maximum conditional likelihood on segments of the sample, by AdaGrad on the full batch."""
    rng = np.random.default_rng(seed)
    pieces = [(d, k) for d, words in enumerate(docs) for k in range(0, len(words), FIT_SEGMENT)]
    hot = [p for p in pieces if gold[p[0]][p[1] : p[1] + FIT_SEGMENT].any()]
    cold = [p for p in pieces if not gold[p[0]][p[1] : p[1] + FIT_SEGMENT].any()]
    take = lambda x: [x[i] for i in rng.permutation(len(x))[: FIT_SEGMENTS // 2]]
    pieces = take(hot) + take(cold)
    vocab: dict[str, int] = {}
    words, y, size = [], [], []
    for d, k in pieces:
        w = docs[d][k : k + FIT_SEGMENT]
        words += [vocab.setdefault(x, len(vocab)) for x in w]
        y.append(gold[d][k : k + FIT_SEGMENT])
        size.append(len(w))
    word, y, size = np.array(words), np.concatenate(y).astype(float), np.array(size)
    seen: Counter[str] = Counter()  # words with a feature; a word's own feature counts its tokens
    often = {"=" + w.lower(): 0 for w in vocab}
    for w, k in zip(vocab, np.bincount(word, minlength=len(vocab)).tolist()):
        seen.update(features(w)[1:])
        often["=" + w.lower()] += k
    seen.update(dict.fromkeys(often, 1))
    index = {f: i for i, f in enumerate(f for f, c in seen.items() if c >= 2 or f[0] == "=" and often[f] >= 3)}
    pairs = np.array([(i, index[f]) for w, i in vocab.items() for f in features(w) if f in index]).reshape(-1, 2)
    weight, bias, trans = np.zeros(len(index)), -2.0, np.zeros((2, 2))
    gw, gb, gt = np.full(len(index), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    starts = np.cumsum(size) - size
    prev = np.append(0, y[:-1]).astype(int)
    prev[starts] = 0
    observed = np.bincount(prev * 2 + y.astype(int), minlength=4).reshape(2, 2)
    for _ in range(ROUNDS):
        e = bias + np.bincount(pairs[:, 0], weight[pairs[:, 1]], len(vocab))[word]
        expected = np.zeros((2, 2))
        p = marginals(e, size, trans, FIT_SEGMENT, expected)
        d = np.bincount(word, y - p, len(vocab))
        grad = np.bincount(pairs[:, 1], d[pairs[:, 0]], len(index)) / len(y) * 100 - RIDGE * weight
        edge = (observed - expected) / len(y) * 100
        gw += grad**2
        weight += RATE * grad / np.sqrt(gw)
        b = (y - p).sum() / len(y) * 100
        gb += b * b
        bias += RATE * b / math.sqrt(gb)
        gt += edge**2
        trans += 0.3 * RATE * edge / np.sqrt(gt)
    return Crf({f: float(weight[i]) for f, i in index.items() if abs(weight[i]) > 1e-3}, bias, trans)


def summary(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per document: 1, the largest marginal, log(1 + expected toxic tokens), expected share of toxic tokens."""
    out = np.zeros((len(size), 4))
    out[:, 0] = 1
    has = size > 0
    at = (np.cumsum(size) - size)[has]
    if len(at):
        total = np.add.reduceat(np.where(p > 0.05, p, 0.0), at)
        out[has, 1] = np.maximum.reduceat(p, at)
        out[has, 2] = np.log1p(total)
        out[has, 3] = np.sqrt(total / size[has])
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * w * (np.arange(len(w)) > 0))
    return w


def fit(texts: list[str], labels: list[int], share: float) -> Crf:
    """``share``: toxic share among all labelled rows, as the sample is drawn per class."""
    y = np.array(labels)
    if len(y) == 0 or y.min() == y.max():
        return Crf(constant=share)
    words = [list(map(sys.intern, WORD.findall(t or ""))) for t in texts]  # one string for each distinct word
    third = np.arange(len(y)) % 3 == 2  # calibrates
    if len(set(y[third])) < 2 or len(set(y[~third])) < 2:
        third[:] = False
    own = np.flatnonzero(~third)
    marks = tied([words[i] for i in own if y[i]], [words[i] for i in own if not y[i]])
    if not marks:
        return Crf(constant=share)
    marked: dict[str, bool] = {}
    gold = []
    for i in own:
        for w in words[i] if y[i] else ():
            if w not in marked:
                marked[w] = not marks.isdisjoint(features(w))
        gold.append(np.array([marked[w] for w in words[i]] if y[i] else [False] * len(words[i]), bool))
    model = fit_chain([words[i] for i in own], gold)
    rest = np.flatnonzero(third) if third.any() else own
    size = np.array([len(words[i]) for i in rest])
    x = summary(doc_marginals(model, [words[i] for i in rest]), size)
    weight = np.where(y[rest] == 1, share / max(y[rest].mean(), 1e-9), (1 - share) / max(1 - y[rest].mean(), 1e-9))
    model.calibration = logistic(x, y[rest], weight)
    return model


def doc_marginals(model: Crf, words: list[list[str]], emissions: Emissions | None = None) -> np.ndarray:
    get = (emissions or Emissions(model)).__getitem__
    flat = np.fromiter((get(w) for d in words for w in d), float, sum(map(len, words)))
    return marginals(flat, np.array([len(d) for d in words], np.int64), model.transition)


def bucket(k: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(k))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Crf:
    """Fit on at most ``fit_docs`` labelled training rows of each class, chosen by a hash of doc_id."""
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.where(bucket(5) != 0)
    n = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    picks = [named.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs) for k in (0, 1)]
    picked = docs.select("doc_id", "text").where(F.char_length(F.coalesce("text", F.lit(""))) <= FIT_CHARS).join(F.broadcast(picks[0].union(picks[1])), "doc_id")
    text = F.coalesce("text", F.lit(""))
    one = picked.groupBy("doc_id", "toxic").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    rows = sorted(one.collect(), key=lambda r: (hash_of(r["doc_id"]), r["doc_id"]))  # at most 2 * fit_docs
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], share)


def hash_of(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 >> 11) & 0xFFFFFFFF


def runs(words: list[list[str]]):
    at = 0
    while at < len(words):
        to, n = at, 0
        while to < len(words) and (to == at or n + len(words[to]) <= TOKENS_AT_ONCE):
            n += len(words[to])
            to += 1
        yield at, to
        at = to


class Scorer:
    """Scores and spans on an executor; words are remembered between batches."""

    def __init__(self, model: Crf):
        self.model, self.emissions = model, Emissions(model)

    def marginals(self, words: list[list[str]]) -> np.ndarray:
        return np.concatenate([doc_marginals(self.model, words[a:b], self.emissions) for a, b in runs(words)] or [np.zeros(0)])

    def score(self, texts: list[str | None], spans: list[list] | None = None, least: float = 0.5) -> np.ndarray:
        """Score of every text; the toxic spans (start, end, marginal) of each are added to ``spans``."""
        if self.model.constant is not None:
            if spans is not None:
                spans.extend([] for _ in texts)
            return np.full(len(texts), self.model.constant)
        out = np.empty(len(texts))
        for at in range(0, len(texts), 200):
            part = texts[at : at + 200]
            words = [WORD.findall(t) if t else [] for t in part]
            size = np.array([len(w) for w in words], np.int64)
            p = self.marginals(words)
            out[at : at + 200] = 1 / (1 + np.exp(-np.clip(summary(p, size) @ self.model.calibration, -30, 30)))
            if spans is not None:
                for t, q in zip(part, np.split(p, np.cumsum(size)[:-1])):
                    hit = q >= least
                    spans.append([(*m.span(), x) for m, h, x in zip(WORD.finditer(t), hit.tolist(), q.tolist()) if h] if hit.any() else [])
        return out

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        self.score([text], out := [], least)
        return out[0]


def toxicity(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` with a column toxicity_score (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for text in batches:
            yield pd.Series(scorer.score(text.where(text.notna(), None).tolist()))
        del scorer
        trim()

    return docs.withColumn("toxicity_score", score("text"))


def toxic_spans(docs: DataFrame, model: Crf, least: float = 0.5) -> DataFrame:
    """doc_id, score, and the toxic tokens' code point offsets with their marginals."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])

    def run(batches):
        scorer = Scorer(shared.value)
        for b in slices(batches):
            found: list[list] = []
            score = scorer.score(b.column("text").to_pylist(), found, least)
            spans = [[dict(zip(("start", "end", "marginal"), s)) for s in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(spans, pa.list_(kind))], ["doc_id", "score", "spans"])
        del scorer
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, marginal: double>>")


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is below 0.5, with the columns of ``docs``."""
    scored = toxicity(docs.select(F.struct("*").alias("row"), "text"), train(docs, labels))
    return scored.where("toxicity_score < 0.5").select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the offending offsets as start:end, comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = toxic_spans(docs, train(docs, table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select("doc_id", (bucket(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), spans.alias("spans"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
