"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a document: densities of a lexicon of words and of word beginnings, how many of its hits stand near
a second-person pronoun, shares of capitals, of '!' and '?', and of obfuscated words (a letter, then a digit or
sign, then a letter). Digits and signs that stand for letters are read as those letters before the lexicon is
looked up. Lexicon, trees and calibration are fitted on labelled documents; calibration on a part that neither
lexicon nor trees saw.

Defined cases: a null or empty text scores as a document without words. A document with several labels counts as
toxic if one says so; labels without a document, or null, are ignored. Without labels of both kinds every
document gets the share of toxic ones among them, 0 if there are none. Repeated rows give repeated results, a
null doc_id is passed through, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import BATCH, WORD, Words, arrow_filter, arrow_map, picked, hash_of, per_document, table, texts_of
from graphloom.session import written

#: Labelled documents to fit on: those with the least hash of doc_id.
TRAIN_DOCS = 12_000
#: Of these, the share that calibrates.
CALIBRATE = 0.3
#: A unit (word or beginning) is in the lexicon if it is in so many toxic training documents and if its rate in
#: them is so many times that in clean ones.
LEAST_TOXIC, LEAST_ODDS = 4, 20.0
#: From this many times on it's in a second, weak part, whose hits are features of their own: several together tell what one doesn't.
WEAK_ODDS = 5.0
#: Bytes of word beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: Words to either side in which a pronoun makes a lexicon hit personal.
NEAR = 5
#: Calibrated probability from which a document is toxic.
THRESHOLD = 0.5
ROUNDS, DEPTH, RATE, BINS, L2 = 60, 3, 0.2, 64, 1.0

PRONOUNS = "you your yours yourself u ur tu te toi ton tes vous votre vos du dich dir dein deine ihr euch euer ti tú usted ustedes vosotros".split()
FEATURES = ["words", "word_hits", "start_hits", "log_hits", "kinds", "personal", "second_person", "capitals", "marks", "obfuscated", "weak_hits", "log_weak"]
SCHEMA = "doc_id bigint, toxicity double, toxic boolean"

_READ_AS = np.arange(256, dtype=np.uint8)
for _a, _b in zip("0134578@$", "oieastbas", strict=True):
    _READ_AS[ord(_a)] = ord(_b)
_LETTER = WORD.copy()
_LETTER[ord("0") : ord("9") + 1] = False
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "0123456789@$*"]] = True


def units(w: Words) -> list[np.ndarray]:
    """Hashes of the words, and of their beginnings where they are longer than these (0 elsewhere)."""
    out = [w.hash]
    for n in BEGINNINGS:
        long = w.ends - w.starts > n
        h = np.zeros(len(w.hash), np.uint64)
        h[long] = w.between(w.starts[long], w.starts[long] + n) ^ np.uint64(n)
        out.append(h)
    return out


def read(data: np.ndarray, off: np.ndarray) -> Words:
    return Words(_READ_AS[data], off)


def _in(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)] == h


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return (c[off[1:]] - c[off[:-1]]).astype(float)


def features(low: np.ndarray, off: np.ndarray, lexicon: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """documents x FEATURES of lower-cased bytes and their offsets; capitals are left at 0."""
    w = read(low, off)
    count = np.diff(w.off).astype(float)
    per = np.maximum(count, 1)
    whole, *starts = units(w)
    word_hit = _in(whole, lexicon)
    start_hit = np.zeros(len(word_hit), bool)
    for h in starts:
        start_hit |= _in(h, lexicon)
    start_hit &= ~word_hit
    hit = word_hit | start_hit
    weak_hit = _in(whole, weak)
    for h in starts:
        weak_hit |= _in(h, weak)
    weak_hits = _sums(weak_hit & ~hit, w.off)
    you = _in(whole, _PRONOUN_HASHES)
    doc = w.doc()
    near = np.concatenate([[0], np.cumsum(you, dtype=np.int64)])
    at = np.flatnonzero(hit)
    lo, hi = np.maximum(at - NEAR, w.off[:-1][doc[at]]), np.minimum(at + NEAR + 1, w.off[1:][doc[at]])
    personal = np.zeros(len(hit), bool)
    personal[at] = near[hi] > near[lo]
    hits = _sums(hit, w.off)
    kinds = np.zeros(len(count))
    if len(at):
        pairs = np.unique(np.stack([doc[at].astype(np.uint64), whole[at]]), axis=1)[0]
        kinds += np.bincount(pairs.astype(np.int64), minlength=len(count))
    odd = np.zeros(len(low), bool)
    if len(low) > 2:
        odd[1:-1] = _LETTER[low[:-2]] & _SIGN[low[1:-1]] & _LETTER[low[2:]]
    return np.stack([np.log1p(count), _sums(word_hit, w.off) / per, _sums(start_hit, w.off) / per, np.log1p(hits), kinds, _sums(personal, w.off) / per, _sums(you, w.off) / per, np.zeros(len(count)), _sums((low == ord("!")) | (low == ord("?")), off) / np.maximum(np.diff(off), 1), _sums(odd, off) / per, weak_hits / per, np.log1p(weak_hits)], axis=1)


_PRONOUN_HASHES = np.sort(np.array([hash_of(p) for p in PRONOUNS], np.uint64))


def batch_features(texts: pa.Array, lexicon: np.ndarray, weak: np.ndarray) -> np.ndarray:
    from graphloom.llm.text import buffers

    parts = []
    raw, raw_off = buffers(texts)
    upper = np.concatenate([[0], np.cumsum((raw >= ord("A")) & (raw <= ord("Z")), dtype=np.int64)])
    share = (upper[raw_off[1:]] - upper[raw_off[:-1]]) / np.maximum(np.diff(raw_off), 1)
    for _, _, low, off in per_document(texts):
        parts.append(features(low, off, lexicon, weak))
    x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    x[:, FEATURES.index("capitals")] = share
    return x


@dataclass
class Trees:
    """Binary trees of one depth, each node a feature and a bound (go right if greater), added up."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1), np.int64))
    bound: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, b, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
        """Histogram boosting on the logistic loss with Newton leaves."""
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        score, grown = np.full(len(y), base := float(np.log(p / (1 - p)))), []
        inner = 2**DEPTH - 1
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, q * (1 - q)
            feature, bound, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                split_at = np.full(inner, BINS)
                for j, c in enumerate(cuts):
                    key = (node - first) * BINS + binned[:, j]
                    sg, sh = (np.bincount(key, v, many * BINS).reshape(many, BINS) for v in (g, h))
                    lg, lh, tg, th = sg.cumsum(1), sh.cumsum(1), sg.sum(1), sh.sum(1)
                    gain = lg**2 / (lh + L2) + (tg[:, None] - lg) ** 2 / (th[:, None] - lh + L2) - (tg**2 / (th + L2))[:, None]
                    gain[:, len(c) :] = -1
                    k = gain.argmax(1)
                    better = np.flatnonzero(gain[np.arange(many), k] > best)
                    best[better] = gain[better, k[better]]
                    feature[first + better], split_at[first + better] = j, k[better]
                    bound[first + better] = np.array([c[i] for i in k[better]])
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split_at[node])
            at = node - inner
            sg, sh = np.bincount(at, g, 2**DEPTH), np.bincount(at, h, 2**DEPTH)
            grown.append((feature, bound, leaf := -RATE * sg / (sh + L2)))
            score += leaf[at]
        return Trees(base, *(np.stack(a) for a in zip(*grown, strict=True)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending scores and the calibrated probability at each."""
    at, where = np.unique(score, return_inverse=True)
    n = np.bincount(where).astype(float)
    blocks: list[list[float]] = []  # sum, weight, members
    for s, w in zip(np.bincount(where, y), n, strict=True):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, k2 = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += w2
            blocks[-1][2] += k2
    return at, np.concatenate([np.full(int(k), s / w) for s, w, k in blocks]) if blocks else np.zeros(0)


@dataclass
class Model:
    lexicon: np.ndarray
    weak: np.ndarray
    trees: Trees
    at: np.ndarray
    value: np.ndarray
    prior: float

    def probability(self, texts: pa.Array) -> np.ndarray:
        if not len(self.at):
            return np.full(len(texts), self.prior)
        return np.interp(self.trees.raw(batch_features(texts, self.lexicon, self.weak)), self.at, self.value)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    of = picked(labels, doc_id="bigint", toxic="int").dropna()
    of = of.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    of = of.select("doc_id", "toxic", ((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)) / 1000) < CALIBRATE).alias("held"))
    # train_docs rows of three numbers at most.
    sample = written(texts_of(docs).where("text is not null").join(F.broadcast(of), "doc_id"), "toxic-sample")

    def make():
        def count(b: pa.RecordBatch) -> pa.RecordBatch:
            toxic = np.array(b.column("toxic").to_pylist(), np.int64) > 0
            keys, docs_of = [], []
            for i, _, data, off in per_document(b.column("text")):
                w = read(data, off)
                doc = w.doc().astype(np.uint64)
                for h in units(w):
                    d, u = np.unique(np.stack([doc, h])[:, h != 0], axis=1)
                    keys.append(u)
                    docs_of.append(d.astype(np.int64) + i)
            u, at = np.unique(np.concatenate(keys), return_inverse=True)
            t = np.bincount(at, toxic[np.concatenate(docs_of)], len(u)).astype(np.int64)
            return pa.record_batch({"u": pa.array(u.view(np.int64)), "toxic": pa.array(t), "clean": pa.array(np.bincount(at, minlength=len(u)) - t)})

        return count

    totals = {r.toxic: r.n for r in sample.where("not held").groupBy(F.expr("int(toxic > 0)").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    every = sample.agg(F.avg(F.expr("int(toxic > 0)")).alias("p")).first().p or 0.0
    if len(totals) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.uint64), Trees(), np.zeros(0), np.zeros(0), float(every))
    u = arrow_map(sample.where("not held"), make, "u bigint, toxic bigint, clean bigint", BATCH).groupBy("u").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = (F.col("toxic") / totals[1]) / ((F.col("clean") + 0.5) / totals[0])
    rows = u.where(F.col("toxic") >= LEAST_TOXIC).where(odds >= WEAK_ODDS).select("u", (odds >= LEAST_ODDS).alias("strong")).collect()
    lexicon, weak = (np.sort(np.array([r.u for r in rows if r.strong == strong], np.int64).view(np.uint64)) for strong in (True, False))
    x, y, held = dense(sample, lexicon, weak)
    trees = Trees.fit(x[~held], y[~held])
    hold = held if held.any() else ~held
    return Model(lexicon, weak, trees, *isotonic(trees.raw(x[hold]), y[hold]), float(every))


def dense(sample: DataFrame, lexicon: np.ndarray, weak: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and whether it calibrates, of each document of the bounded sample, in a fixed order."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            x = batch_features(b.column("text"), lexicon, weak)
            cols = [b.column("doc_id"), b.column("toxic"), b.column("held"), *(pa.array(c) for c in x.T)]
            return pa.record_batch(cols, names=["doc_id", "toxic", "held", *(f"f_{n}" for n in FEATURES)])

        return f

    got = arrow_map(sample, make, "doc_id bigint, toxic int, held boolean, " + ", ".join(f"f_{n} double" for n in FEATURES), BATCH).toPandas()
    names = [f"f_{n}" for n in FEATURES]
    got = got.sort_values(["doc_id", *names], ignore_index=True)
    return got[names].to_numpy(), (got.toxic.to_numpy() > 0).astype(float), got.held.to_numpy().astype(bool)


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, calibrated toxicity and whether it reaches THRESHOLD, for every row."""
    docs = texts_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def score(b: pa.RecordBatch) -> pa.RecordBatch:
            p = np.round(sent.value.probability(b.column("text")), 6)
            return pa.record_batch({"doc_id": b.column("doc_id"), "toxicity": pa.array(p), "toxic": pa.array(p >= THRESHOLD)})

        return score

    return arrow_map(docs, make, SCHEMA, BATCH)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that aren't toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_filter(docs, lambda: lambda b: np.round(sent.value.probability(b.column(b.schema.get_field_index("text"))), 6) < THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, table(spark, sf_dir, "labels")))
