"""Language ID by language-bitmask n-gram filters.

One Bloom filter a language, bit-sliced: row h of the table is a word whose bit l is bit h of the filter of
language l, so that the AND of the few rows of an n-gram gives every language that holds it. The popcount of
each language over a document's n-grams, less the hits that its filter gives by chance, decides.

Defined cases: a null or empty text, or one without an n-gram, has no language (lang_pred null) and is not
accepted. Repeated rows give repeated results; a null doc_id is passed through. Ties go to the language that
sorts first. Columns other than doc_id, text and lang are ignored; an empty table gives an empty result, and
so does a corpus without language labels give no language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.text import BATCH, WORD, arrow_filter, arrow_map, per_document, table, texts_of

#: Labelled documents that the filters are fitted on, for each language (those of the least hash of doc_id).
TRAIN_DOCS = 600
#: Languages of a word of a table row, one bit each; a row has as many words as the languages need.
WORD_LANGS = 64
#: Bits of a filter, and rows that an n-gram reads.
BITS, HASHES = 1 << 20, 3
#: An n-gram belongs to a language if it makes up this share, against the language where it is most frequent.
RELATIVE, LEAST = 0.25, 3
#: Shares of a document's n-grams: that the winner holds at least, and by which it leads.
MIN_SHARE, MIN_LEAD = 0.3, 0.01

LETTER = WORD.copy()
LETTER[ord("0") : ord("9") + 1] = False
SCHEMA = "doc_id bigint, lang_pred string, n_grams bigint, share double, lead double, accepted boolean"


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All byte 4-grams of each document with all but letters as blanks, no two blanks side by side;
    with offsets. A blank is put before and after each document."""
    n = np.diff(off)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(len(n)) + 1, n)
    b = np.full(len(data) + 2 * len(n), 32, np.uint32)
    b[at] = np.where(LETTER[data], data, 32)
    ends = np.cumsum(n + 2)
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(n) + 1, np.int64)
    g = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    two = (b[:-1] == 32) & (b[1:] == 32)
    # A gram that crosses a document's end holds the two blanks that meet there.
    ok = ~(two[:-2] | two[1:-1] | two[2:])
    return g[ok], np.concatenate([[0], np.cumsum(ok)])[np.minimum(np.concatenate([[0], ends]), len(ok))]


def rows_of(g: np.ndarray, bits: int) -> list[np.ndarray]:
    """The table rows of each gram."""
    h = (g.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return [(h >> np.uint64(64 - 21 * (i + 1))) & np.uint64(bits - 1) for i in range(HASHES)]


@dataclass
class Filters:
    """langs in order of their bits; table of BITS rows, of several words each (bits x words) beyond WORD_LANGS languages; chance of a false hit of each
    language."""

    langs: list[str]
    table: np.ndarray
    chance: np.ndarray

    @staticmethod
    def build(of: dict[str, np.ndarray], bits: int = BITS) -> Filters:
        langs = sorted(of)
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        t = np.zeros((bits, max(1, -(-len(langs) // WORD_LANGS))), kind)
        for i, lang in enumerate(langs):
            for r in rows_of(of[lang], bits):
                t[np.unique(r), i // WORD_LANGS] |= kind(1 << i % WORD_LANGS)
        fill = np.array([((t[:, i // WORD_LANGS] >> kind(i % WORD_LANGS)) & kind(1)).mean() for i in range(len(langs))])
        return Filters(langs, t if t.shape[1] > 1 else t[:, 0], fill**HASHES)

    def masks(self, g: np.ndarray) -> np.ndarray:
        """The languages that hold each gram, as a bit mask; with the filters' false positives."""
        a, *rest = (self.table[r] for r in rows_of(g, len(self.table)))
        for r in rest:
            a &= r
        return a

    def counts(self, g: np.ndarray, off: np.ndarray) -> np.ndarray:
        """documents x languages: grams held, corrected for chance hits."""
        m, n = self.masks(g), np.diff(off)
        out = np.empty((len(n), len(self.langs)))
        for i in range(len(self.langs)):
            own = m if m.ndim == 1 else m[:, i // WORD_LANGS]
            hit = np.concatenate([[0], np.cumsum((own >> m.dtype.type(i % WORD_LANGS)) & m.dtype.type(1), dtype=np.int64)])
            out[:, i] = hit[off[1:]] - hit[off[:-1]]
        return np.clip((out - n[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9), 0, None)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Filters:
    """Filters from the documents whose lang is set: the train_docs of each language with the least hash."""
    docs = texts_of(docs, "lang").where("lang is not null and text is not null")
    ids = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= train_docs)
    # At most train_docs rows of two values for each language are sent to the tasks.
    ids = ids.select("doc_id", "lang").distinct()
    sample = docs.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")

    def make():
        def count(b: pa.RecordBatch) -> pa.RecordBatch:
            names = b.column("lang").to_pylist()
            parts: dict[str, list] = {}
            for i, j, data, off in per_document(b.column("text")):
                g, go = grams(data, off)
                for d in range(j - i):
                    parts.setdefault(names[i + d], []).append(g[go[d] : go[d + 1]])
            out = [(k, *np.unique(np.concatenate(v), return_counts=True)) for k, v in parts.items()]
            return pa.record_batch({"lang": pa.array([k for k, g, _ in out for _ in range(len(g))], pa.string()), "g": pa.array(np.concatenate([g for _, g, _ in out]).astype(np.int64)), "n": pa.array(np.concatenate([n for *_, n in out]).astype(np.int64))})

        return count

    counts = arrow_map(sample, make, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    best = Window.partitionBy("g")
    kept = counts.withColumn("top", F.max("share").over(best)).where((F.col("n") >= LEAST) & (F.col("share") >= RELATIVE * F.col("top"))).select("lang", "g").toPandas()
    return Filters.build({k: v.g.to_numpy().astype(np.uint32) for k, v in kept.groupby("lang")})


def decide(f: Filters, g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each document: index of the language (len(f.langs): none), grams, share, lead, whether it is accepted."""
    n = np.diff(off)
    c = f.counts(g, off) if f.langs else np.zeros((len(n), 0))
    c = np.concatenate([c, np.zeros((len(n), 2))], axis=1) / np.maximum(n, 1)[:, None]
    two = -np.partition(-c, 1, axis=1)[:, :2]
    share, lead = two[:, 0], two[:, 0] - two[:, 1]
    best = np.where(share > 0, np.minimum(c.argmax(axis=1), len(f.langs)), len(f.langs))
    return best, n, share, lead, (share > 0) & (share >= MIN_SHARE) & (lead >= MIN_LEAD)


def apply(docs: DataFrame, filters: Filters) -> DataFrame:
    """The language of each document."""
    docs = texts_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast((filters.langs, filters.table, filters.chance))

    def make():
        f = Filters(*sent.value)
        names = np.array([*f.langs, None], object)

        def score(b: pa.RecordBatch) -> pa.RecordBatch:
            parts = [decide(f, *grams(data, off)) for _, _, data, off in per_document(b.column("text"))]
            best, n, share, lead, ok = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array(names[best], pa.string()), "n_grams": pa.array(n.astype(np.int64)), "share": pa.array(np.round(share, 6)), "lead": pa.array(np.round(lead, 6)), "accepted": pa.array(ok)})

        return score

    return arrow_map(docs, make, SCHEMA, BATCH)


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, lang_pred, n_grams, share, lead, accepted for every row of docs."""
    return apply(docs, fit(docs, train_docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def accepted(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows of docs, all columns, whose language the filters decide."""
    sent = docs.sparkSession.sparkContext.broadcast((filters.langs, filters.table, filters.chance))

    def make():
        f = Filters(*sent.value)

        def mask(b: pa.RecordBatch) -> np.ndarray:
            parts = [decide(f, *grams(data, off))[-1] for _, _, data, off in per_document(b.column(b.schema.get_field_index("text")))]
            return np.concatenate(parts) if parts else np.zeros(0, bool)

        return mask

    return arrow_filter(docs, make)
