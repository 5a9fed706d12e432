"""LM scoring by cross-entropy difference, as Moore and Lewis do: bigram models of the target (documents labelled as of
quality) and of the background (all documents), alike in order, smoothing and vocabulary, give each token a loss; the
mean difference is the document's score, lower for text that is like the target.

    p(w | v) = (c(vw) + MU p(w)) / (c(v) + MU),  p(w) = (c(w) + 1) / (N + size of the vocabulary)

A document runs from a boundary to a boundary, which is predicted too. Bigram counts leave out the document that is
scored. The vocabulary is all words, and grows with the input; if a size is given, it is the most frequent words, those of lesser hash first among
equals, and all others are one word.

Counts are of all documents, and never in one place: texts are written as pieces of some megabytes, the distinct words of each and their places;
each piece sends its distinct words and bigrams to buckets, which add them up and return the totals of those that other pieces have too; then the
piece's documents are scored. So what is shipped is a few bytes a bigram of a piece, and a frequent one costs its bucket an entry a piece. Words are
named by 64-bit hashes, and within a bucket words and bigrams by 40 bits.

Defined cases: null and empty texts, and texts without a word, aren't counted and have null scores (n_tokens 0). Repeated rows count as often as they
occur and get equal scores. A null doc_id is passed through and isn't labelled; of several labels the highest counts. Without labelled
documents the target's counts are zero. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.jaccard import _blobs, _join, _split, _starts
from graphloom.llm.text import Words, arrow_map, picked, mix, per_document, table, texts_of
from graphloom.session import ship, written

MU = 500.0
#: Labelled documents whose ids are sent to all tasks; if there are more, they are joined.
TARGETS_AT_ONCE = 4_000_000
#: Bytes of text in a piece.
AT_ONCE = 8 << 20
#: Hashes of the word that stands for all outside the vocabulary, and of the boundary.
UNKNOWN, BOUNDARY = np.uint64(0), np.uint64(1)
SCHEMA = "doc_id bigint, n_tokens bigint, ce_target double, ce_background double, score double"
PIECES = "piece bigint, doc_ids array<bigint>, targets binary, lengths binary, words binary, tokens binary"
_WORD = np.dtype([("word", "<u8"), ("target", "<i8"), ("all", "<i8")])


#: Bytes of a word or bigram within its bucket, of a piece's counts, and of totals.
_CODE, _COUNT, _TOTAL = 5, 4, 6


def _planes(x: np.ndarray, cuts: np.ndarray, width: int) -> pa.Array:
    """Byte strings of x[cuts[i] : cuts[i + 1]]: the lowest bytes of all, then the next ones, so that what is zero is together and is compressed away."""
    b = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return pa.array([np.ascontiguousarray(b[i:j].T).tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def _values(blob: pa.Scalar, width: int) -> np.ndarray:
    planes = np.frombuffer(blob.as_buffer(), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _all_values(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(_values(x, width) for x in column)])


@dataclass
class Sums:
    """Documents with a word and words, of the target and of all; the size of the vocabulary."""

    docs: list[int]
    words: list[int]
    size: int


def tagged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """doc_id, text, and target where labels had to be joined; and what tells of a batch which documents are the target."""
    docs = texts_of(docs)
    good = picked(labels, doc_id="bigint", quality="int").where("quality > 0 and doc_id is not null").select("doc_id").distinct()
    if good.count() > TARGETS_AT_ONCE:
        docs = docs.join(good.withColumn("target", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
        return docs, lambda b: b.column("target").to_numpy(zero_copy_only=False)
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(good.toPandas().doc_id.to_numpy(np.int64)))

    def is_target(b: pa.RecordBatch) -> np.ndarray:
        # No second Python process only to add a column.
        ids = b.column("doc_id")
        known, none = sent.value, ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        return (known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids) & ~none if len(known) else np.zeros(len(ids), bool)

    return docs, is_target


def _word_counts(docs: DataFrame, is_target: Callable, buckets: int, most: int) -> pd.DataFrame:
    """Counts of the most frequent words of each bucket; the first that is left out has cut set. Two rows of totals, of documents and words."""

    def make():
        def count(b: pa.RecordBatch) -> pa.RecordBatch:
            flag = is_target(b)
            parts, which, totals = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], np.zeros((2, 2), np.int64)
            for i, j, data, off in per_document(b.column("text")):
                w = Words(data, off)
                n = np.diff(w.off)
                parts.append(w.hash)
                which.append(np.repeat(flag[i:j], n))
                totals += [[(flag[i:j] & (n > 0)).sum(), (n > 0).sum()], [n[flag[i:j]].sum(), n.sum()]]
            h, good = np.concatenate(parts), np.concatenate(which)
            order = np.argsort(h)
            h, good = h[order], good[order]
            at = _starts(h)
            words = np.zeros(len(at), _WORD)
            words["word"], words["all"] = h[at], np.diff(np.append(at, len(h)))
            if len(at):
                words["target"] = np.add.reduceat(good.astype(np.int64), at)
            words, keys, cuts = _split((mix(words["word"]) % np.uint64(buckets)).astype(np.int64), words, buckets)
            return pa.record_batch([pa.array(np.append(keys, -1).astype(np.int32)), pa.concat_arrays([_blobs(words, cuts), pa.array([totals.tobytes()], pa.binary())])], names=["key", "a"])

        return count

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            a = _join(t.column("a"), np.int64).reshape(-1, 2, 2).sum(axis=0)
            return pa.table({"word": pa.array([0, 1]), "target": pa.array(a[:, 0]), "all": pa.array(a[:, 1]), "kind": pa.array(["total"] * 2)})
        x = _join(t.column("a"), _WORD)
        x = x[np.argsort(x["word"])]
        at = _starts(x["word"])
        target, every = (np.add.reduceat(x[c], at) if len(at) else np.zeros(0, np.int64) for c in ("target", "all"))
        word = x["word"][at].view(np.int64)
        top = np.lexsort((word, -every))[: most + 1]
        kind = ["word"] * min(most, len(top)) + ["cut"] * (len(top) - most)
        return pa.table({"word": pa.array(word[top]), "target": pa.array(target[top]), "all": pa.array(every[top]), "kind": pa.array(kind, pa.string())})

    return arrow_map(docs, make, "key int, a binary", AT_ONCE).groupBy("key").applyInArrow(add, "word bigint, target bigint, all bigint, kind string").toPandas()


def vocabulary(docs: DataFrame, is_target: Callable, buckets: int, size: int) -> np.ndarray:
    """The size - 2 most frequent words of all documents, as sorted hashes. Buckets send somewhat more than their share of them; in the rare case that
    one holds more, all send as many as there can be."""
    size -= 2
    for most in (2 * size // buckets + 16, size):
        got = _word_counts(docs, is_target, buckets, most)
        words = got[got.kind == "word"].sort_values(["all", "word"], ascending=[False, True])[:size]
        cut = got[got.kind == "cut"]["all"].max()
        if most == size or len(words) == size and not cut >= words["all"].iloc[-1] or np.isnan(cut):
            break
    return np.sort(words.word.to_numpy(np.int64).view(np.uint64))


def pieces_of(docs: DataFrame, is_target: Callable, sent=None) -> DataFrame:
    """Rows of documents: doc_ids, whether each is of the target, its number of words, the distinct words (frequent ones first), and which each word is, low
    halves before high ones."""

    def make():
        def encode(b: pa.RecordBatch) -> pa.RecordBatch:
            lengths, parts = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
            for _, _, data, off in per_document(b.column("text")):
                w = Words(data, off)
                lengths.append(np.diff(w.off).astype(np.uint32))
                parts.append(w.hash)
            h = np.concatenate(parts)
            if sent is not None:
                known = sent.value
                h = np.where(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h, h, UNKNOWN) if len(known) else np.zeros_like(h)
            words, of, n = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            tokens = np.ascontiguousarray(rank[of].view(np.uint16).reshape(-1, 2).T)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id"))
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (is_target(b), np.concatenate(lengths), words[order], tokens)]
            return pa.record_batch([pa.array([secrets.randbits(63)]), ids, *blobs], names=["piece", "doc_ids", "targets", "lengths", "words", "tokens"])

        return encode

    return arrow_map(docs, make, PIECES, AT_ONCE)


def sums_of(pieces: DataFrame, buckets: int) -> Sums:
    """Distinct words are counted in buckets."""

    def make():
        def send(b: pa.RecordBatch) -> pa.RecordBatch:
            parts, totals = [np.zeros(0, np.uint64)], np.zeros((2, 2), np.int64)
            for x in zip(*(b.column(c) for c in ("targets", "lengths", "words")), strict=True):
                flag, n, words = (np.frombuffer(v.as_buffer(), t) for v, t in zip(x, (bool, np.uint32, np.uint64), strict=True))
                parts.append(words[words != UNKNOWN])
                totals += [[(flag & (n > 0)).sum(), (n > 0).sum()], [n[flag].sum(dtype=np.int64), n.sum(dtype=np.int64)]]
            h = np.unique(np.concatenate(parts))
            h, keys, cuts = _split((mix(h) % np.uint64(buckets)).astype(np.int64), h, buckets)
            return pa.record_batch([pa.array(np.append(keys, -1).astype(np.int32)), pa.concat_arrays([_blobs(h, cuts), pa.array([totals.tobytes()], pa.binary())])], names=["key", "a"])

        return send

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = _join(t.column("a"), np.int64)
        x = x.reshape(-1, 4).sum(axis=0) if key[0].as_py() < 0 else [0, 0, 0, 0]
        size = 0 if key[0].as_py() < 0 else len(np.unique(_join(t.column("a"), np.uint64)))
        return pa.table({k: pa.array([int(v)], pa.int64()) for k, v in zip(("d0", "d1", "w0", "w1", "n"), (*x, size), strict=True)})

    got = arrow_map(pieces.select("targets", "lengths", "words"), make, "key int, a binary").groupBy("key").applyInArrow(add, "d0 bigint, d1 bigint, w0 bigint, w1 bigint, n bigint")
    r = [int(x or 0) for x in got.agg(*(F.sum(c) for c in got.columns)).first()]
    return Sums(r[:2], r[2:4], r[4] + 2)


class Piece:
    """Words and bigrams of a piece's documents that have a word; a word's number is one more than its place, the boundary's is 0."""

    def __init__(self, targets: bytes, lengths: bytes, words: bytes, tokens: bytes):
        flag, n = np.frombuffer(targets, bool), np.frombuffer(lengths, np.uint32).astype(np.int64)
        low, high = np.frombuffer(tokens, np.uint16).reshape(2, -1).astype(np.uint32)
        self.hash = np.concatenate([[BOUNDARY], np.frombuffer(words, np.uint64)])
        self.rows, self.docs = len(n), np.flatnonzero(n)
        self.target, n = flag[self.docs], n[self.docs]
        self.off = np.concatenate([[0], np.cumsum(n + 1)])
        self.token = np.zeros(self.off[-1], np.uint32)
        inner = np.ones(len(self.token), bool)
        inner[self.off[:-1]] = False
        self.token[inner] = (low | high << np.uint32(16)) + np.uint32(1)  # each document's first is its boundary
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        code = self.token.astype(np.uint64) << np.uint64(32) | np.append(self.token[1:], np.uint32(0))
        self.code, self.of, many = np.unique(code, return_inverse=True, return_counts=True)
        good = self.target[self.doc]
        #: Of the words, then of the distinct bigrams: how often, and how often in the target.
        self.all = np.concatenate([np.bincount(self.token, minlength=len(self.hash)), many])
        self.good = np.concatenate([np.bincount(self.token, good, len(self.hash)), np.bincount(self.of, good, len(self.code))]).astype(np.int64)

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is sent of the words and bigrams, the bucket of each, and the order by bucket and what is sent."""
        a, b = self.hash[(self.code >> np.uint64(32)).astype(np.int64)], self.hash[(self.code & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        h = np.concatenate([mix(self.hash), mix(mix(a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + b)])
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        low = h & np.uint64((1 << 8 * _CODE) - 1)
        return low, bucket, np.argsort(bucket.astype(np.uint64) << np.uint64(8 * _CODE) | low, kind="stable")

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values of each document: document, value, how often."""
        key = self.doc.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64)
        key.sort()
        at = _starts(key)
        return (key[at] >> np.uint64(32)).astype(np.int64), key[at].astype(np.uint32).astype(np.int64), np.diff(np.append(at, len(key)))


def _sent(pieces: DataFrame, buckets: int) -> DataFrame:
    def make():
        def send(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for piece, *x in zip(*(b.column(c) for c in ("piece", "targets", "lengths", "words", "tokens")), strict=True):
                p = Piece(*(v.as_py() for v in x))
                low, bucket, order = p.keys(buckets)
                low, bucket = low[order], bucket[order]
                at = _starts(bucket)
                cuts = np.append(at, len(bucket))
                step = np.diff(low, prepend=np.uint64(0))  # they ascend within a bucket
                step[at] = low[at]
                out.append(pa.record_batch([pa.array(bucket[at].astype(np.int32)), pa.array([piece.as_py()] * len(at), pa.int64()), _planes(step, cuts, _CODE), *(_planes(v[order], cuts, _COUNT) for v in (p.all, p.good))], names=["key", "piece", "code", "all", "target"]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(r.num_rows for r in out) else None

        return send

    return arrow_map(pieces.select("piece", "targets", "lengths", "words", "tokens"), make, "key int, piece bigint, code binary, all binary, target binary")


def _added(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Reduces a bucket: to each piece the totals of those of its words and bigrams that are in others too, and which these are, as bits in the order in
    which it sent them."""
    n, good = (_all_values(t.column(c), _COUNT).astype(np.uint32) for c in ("all", "target"))
    size = np.array([len(x.as_buffer()) // _COUNT for x in t.column("all")], np.int64)
    of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(_values(x, _CODE)) for x in t.column("code"))]), return_inverse=True)[1]
    total, in_target = np.bincount(of, n).astype(np.int64), np.bincount(of, good).astype(np.int64)
    many = total[of] > n
    off = np.concatenate([[0], np.cumsum(size)])
    bits = [np.packbits(many[i:j]).tobytes() for i, j in zip(off[:-1], off[1:], strict=True)]
    cuts = np.concatenate([[0], np.cumsum(many)])[off]
    of = of[many]
    pa.default_memory_pool().release_unused()  # the worker lives on, beside others
    return pa.table({"piece": t.column("piece"), "key": pa.array([key[0].as_py()] * len(size), pa.int32()), "shared": pa.array(bits, pa.binary()), "all": _planes(total[of], cuts, _TOTAL), "target": _planes(in_target[of], cuts, _TOTAL)})


def _scorer(sums: Sums, buckets: int):
    def score(key: tuple[pa.Scalar, ...], piece: pa.Table, totals: pa.Table) -> pa.Table:
        p = Piece(*(piece.column(c)[0].as_py() for c in ("targets", "lengths", "words", "tokens")))
        _, bucket, order = p.keys(buckets)
        size = np.bincount(bucket, minlength=buckets)
        totals = totals.sort_by("key")
        bits = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(size[k])) for k, x in zip(totals.column("key").to_pylist(), totals.column("shared"), strict=True)]
        at = order[np.flatnonzero(np.concatenate([np.zeros(0, np.uint8), *bits]))]
        p.all[at], p.good[at] = (_all_values(totals.column(c), _TOTAL).astype(np.int64) for c in ("all", "target"))
        m = len(p.hash)
        of_context, of_bigram = p.own(p.token), p.own(p.of)
        next_word = (p.code & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = []
        for i, (counts, mine) in enumerate(((p.good, p.target), (p.all, np.ones(len(p.docs), bool)))):
            doc, v, k = of_context
            loss = np.bincount(doc, k * np.log(counts[v] - k * mine[doc] + MU), len(p.docs))
            doc, c, k = of_bigram
            prior = MU * (counts[next_word[c]] + 1) / (sums.words[i] + sums.docs[i] + sums.size)
            loss -= np.bincount(doc, k * np.log(counts[m + c] - k * mine[doc] + prior), len(p.docs))
            out.append(loss / np.diff(p.off))
        words = np.zeros(p.rows, np.int64)
        words[p.docs] = np.diff(p.off) - 1
        t, a = (np.full(p.rows, np.nan) for _ in range(2))
        t[p.docs], a[p.docs] = out
        ids = piece.column("doc_ids").combine_chunks().values
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": ids, "n_tokens": pa.array(words), **{k: pa.array(np.round(x, 6), from_pandas=True) for k, x in (("ce_target", t), ("ce_background", a), ("score", t - a))}})

    return score


def score(docs: DataFrame, labels: DataFrame, size: int | None = None) -> DataFrame:
    """A row for every row of docs; n_tokens counts words. size: of the vocabulary, else it holds all words."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs, is_target = tagged(docs, labels)
    sent = spark.sparkContext.broadcast(vocabulary(docs, is_target, parts, size)) if size else None
    pieces = written(pieces_of(docs, is_target, sent), "pieces")
    sums = sums_of(pieces, parts)
    totals = _sent(pieces, parts).groupBy("key").applyInArrow(_added, "piece bigint, key int, shared binary, all binary, target binary")
    return pieces.groupBy("piece").cogroup(totals.withColumnRenamed("piece", "of").groupBy("of")).applyInArrow(_scorer(sums, parts), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
