"""Semantic chunking: sentences, context, distances, breakpoints, slices. Rows are keyed by doc and ordered by ord; what is sequential in a document
is a fold over its own array, so documents run side by side."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import give_back, ship

#: Sentence ends for plain text, and for Markdown: before headings and list items, and after a sentence before a long capitalised word.
PLAIN = r"(?<=[!.?])\s+"
_LONG_NAME = r"(?<=[.!?])(?<=[a-z].)\s+(?=[A-Z]\w{8})"
MARKDOWN = "|".join([r"\n\n+(?=#|- )", _LONG_NAME, r"(?=#)(?<!#)"])
#: By kind: the amount that is used unless told otherwise.
AMOUNTS = {"percentile": 95.0, "standard_deviation": 3.0, "interquartile": 1.5, "gradient": 95.0}


@dataclass(frozen=True)
class Chunking:
    kind: str = "percentile"
    amount: float | None = None
    buffer: int = 5
    min_size: int = 2000
    max_size: int = 20000
    pattern: str = MARKDOWN


def sentences(docs: DataFrame, pattern: str = MARKDOWN, text: str = "text") -> DataFrame:
    """doc, ord, sentence: stripped, empty ones dropped. (?U) gives \\w and \\s their Unicode meaning."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(F.col(text), "(?U)" + pattern, -1), strip), lambda x: x != "")
    return docs.select("doc", F.posexplode(parts).alias("ord", "sentence"))


def _by_doc(order: str) -> Window:
    return Window.partitionBy("doc").orderBy(order)


def with_context(rows: DataFrame, buffer: int, order: str = "ord", text: str = "sentence") -> DataFrame:
    """combined: the sentences before run together, then this one, then each following after a blank."""
    w = _by_doc(order)
    if buffer <= 0:
        return rows.withColumn("combined", F.col(text))
    before = F.array_join(F.collect_list(text).over(w.rowsBetween(-buffer, -1)), "")
    after = F.collect_list(text).over(w.rowsBetween(1, buffer))
    return rows.withColumn("combined", F.concat(before, F.col(text), F.array_join(F.transform(after, lambda x: F.concat(F.lit(" "), x)), "")))


def distances(rows: DataFrame, vector: str = "embedding", order: str = "ord") -> DataFrame:
    """distance: 1 - cosine with the next row's vector; the last row of a document has none and goes. A zero vector is as far as can be from all."""
    w = _by_doc(order)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    out = rows.withColumn("__next", F.lead(vector).over(w)).where("__next is not null")
    norm = F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("__next"), F.col("__next")))
    return out.withColumn("distance", F.lit(1.0) - F.coalesce(F.try_divide(dot(F.col(vector), F.col("__next")), norm), F.lit(0.0))).drop("__next")


def gradient(rows: DataFrame, value: str = "distance", order: str = "ord") -> DataFrame:
    """Central differences, one-sided at the ends; null for a document of one value."""
    w = _by_doc(order)
    a, x, b = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    return rows.withColumn("gradient", F.when(a.isNull(), b - x).when(b.isNull(), x - a).otherwise((b - a) / 2))


def thresholds(rows: DataFrame, kind: str = "percentile", amount: float | None = None) -> DataFrame:
    """doc and the threshold of its distances (for 'gradient', of their gradient)."""
    if kind not in AMOUNTS:
        raise ValueError(f"unknown kind of breakpoint: {kind}")
    k = AMOUNTS[kind] if amount is None else amount
    x = "gradient" if kind == "gradient" else "distance"
    if kind == "gradient":
        rows = gradient(rows)
    how = {
        "percentile": F.percentile(x, k / 100),
        "gradient": F.percentile(x, k / 100),
        "standard_deviation": F.avg(x) + k * F.stddev_pop(x),
        "interquartile": F.avg(x) + k * (F.percentile(x, 0.75) - F.percentile(x, 0.25)),
    }[kind]
    return rows.groupBy("doc").agg(how.alias("threshold"))


def threshold_for_chunks(rows: DataFrame, chunks: int) -> DataFrame:
    """The percentile that falls from 100 for one chunk to 0 for as many as there are distances, linearly and clamped, interpolated."""
    d = rows.groupBy("doc").agg(F.array_sort(F.collect_list("distance")).alias("d"))
    n = F.size("d")
    wanted = F.least(F.greatest(F.lit(float(chunks)), F.lit(1.0)), n.cast("double"))
    y = F.when(n <= 1, F.lit(0.0)).otherwise(F.least(F.greatest((n - wanted) / (n - 1.0), F.lit(0.0)), F.lit(1.0)))
    at = y * (n - 1)
    lo = F.floor(at)
    value = F.get("d", lo) + (at - lo) * (F.get("d", F.least(lo + 1, n - 1)) - F.get("d", lo))
    return d.select("doc", value.alias("threshold"))


def breakpoints(rows: DataFrame, limits: DataFrame, value: str = "distance") -> DataFrame:
    """Rows whose value is above the document's threshold."""
    return rows.join(limits, "doc").where(F.col(value) > F.col("threshold")).select("doc", "ord")


def slices(rows: DataFrame, points: DataFrame, min_size: int, text: str = "sentence") -> DataFrame:
    """doc, chunk_ord, text: sentences up to each breakpoint joined by blanks. A piece shorter than min_size lets its breakpoint pass, the last
    stays as it is. One fold over a document's sentences."""
    marked = rows.select("doc", "ord", text).join(points.select("doc", "ord").distinct().withColumn("cut", F.lit(True)), ["doc", "ord"], "left")
    s = marked.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", F.col(text).alias("t"), F.coalesce("cut", F.lit(False)).alias("cut")))).alias("s"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        held = F.concat(acc["open"], F.array(x["t"]))
        piece = F.array_join(held, " ")
        ends = x["cut"] & (F.length(piece) >= min_size)
        return F.struct(F.when(ends, F.concat(acc["done"], F.array(piece))).otherwise(acc["done"]).alias("done"), F.when(ends, F.array().cast("array<string>")).otherwise(held).alias("open"))

    end = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])
    return s.select("doc", F.posexplode(F.aggregate("s", empty, step, end)).alias("chunk_ord", "text"))


def head(chunks: DataFrame, n: int | None, order: str = "chunk_ord") -> DataFrame:
    """The first n chunks of each document; all if n is null."""
    return chunks if n is None else chunks.withColumn("k", F.row_number().over(_by_doc(order))).where(F.col("k") <= n).drop("k")


def start_indices(chunks: DataFrame) -> DataFrame:
    """Where each chunk would begin if chunks followed each other without separators."""
    w = Window.partitionBy("doc").orderBy("chunk_ord").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start_index", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))


#: The number and sign of each word that was met, so that a common word is hashed once a worker; started anew at so many. Longer words aren't kept.
_SLOTS: dict[str, int] = {}
KEPT_WORDS, KEPT_LENGTH = 50_000, 40
#: Characters of documents whose chunks leave a worker at once.
AT_ONCE = 2 << 20
_WORD = re.compile(r"\w+")


class Hashed:
    """The embedder that needs no model: signed hashed counts of words, of length 1. An embedder is called with texts; one that has windows()
    can tell those of all sentences with their neighbours at once."""

    def __init__(self, width: int = 256):
        self.width = width

    def slots(self, text: str) -> list[int]:
        """Of each word 2 * number + (1 if it counts up)."""
        out = []
        for w in _WORD.findall(text.lower()):
            if (h := _SLOTS.get(w)) is None:
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                if len(w) <= KEPT_LENGTH:
                    if len(_SLOTS) >= KEPT_WORDS:
                        _SLOTS.clear()
                    _SLOTS[w] = h
            out.append(h)
        return [(h >> 1) % self.width * 2 + (h & 1) for h in out]

    def counts(self, texts: list[str]) -> np.ndarray:
        slots = [self.slots(t or "") for t in texts]
        flat = np.array([x for s in slots for x in s], np.int64)
        row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        return np.bincount(row * self.width + (flat >> 1), (flat & 1) * 2.0 - 1.0, len(slots) * self.width).reshape(len(slots), self.width)

    def __call__(self, texts: pd.Series) -> list[np.ndarray]:
        v = self.counts(list(texts))
        return list((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32))

    def windows(self, parts: list[str], buffer: int) -> np.ndarray | None:
        """The counts of each sentence with buffer neighbours on both sides: sums, as no word goes over a border. None where one does."""
        if any((a[-1].isalnum() or a[-1] == "_") and (b[0].isalnum() or b[0] == "_") for a, b in zip(parts, parts[1:], strict=False)):
            return None
        done = np.concatenate([np.zeros((1, self.width)), np.cumsum(self.counts(parts), axis=0)])
        n = np.arange(len(parts))
        return done[np.minimum(n + 1 + buffer, len(parts))] - done[np.maximum(n - buffer, 0)]


hashed_vectors = Hashed()


def split_text(text: str, cfg: Chunking, embed: Callable[[pd.Series], list[np.ndarray]] = hashed_vectors) -> list[str]:
    """One document's semantic chunks, as the operators above make them; for the recursion, whose passes depend on sizes."""
    parts = [p for p in (x.strip() for x in re.split(cfg.pattern, text)) if p]
    if len(parts) <= 1 or cfg.kind == "gradient" and len(parts) == 2:
        return parts
    b = max(cfg.buffer, 0)
    v = embed.windows(parts, b) if hasattr(embed, "windows") else None
    if v is None:
        combined = ["".join(parts[max(0, i - b) : i]) + parts[i] + "".join(" " + x for x in parts[i + 1 : i + 1 + b]) for i in range(len(parts))]
        v = np.stack(embed(pd.Series(combined))).astype(float)
    norm = np.linalg.norm(v, axis=1)
    both = norm[:-1] * norm[1:]
    d = 1 - np.divide((v[:-1] * v[1:]).sum(axis=1), both, out=np.zeros(len(both)), where=both > 0)
    k = AMOUNTS[cfg.kind] if cfg.amount is None else cfg.amount
    if cfg.kind == "gradient":
        d = np.gradient(d)
    limit = {"percentile": lambda: np.percentile(d, k), "gradient": lambda: np.percentile(d, k), "standard_deviation": lambda: d.mean() + k * d.std(), "interquartile": lambda: d.mean() + k * (np.percentile(d, 75) - np.percentile(d, 25))}[cfg.kind]()
    out, start = [], 0
    for i in np.flatnonzero(d > limit).tolist():
        piece = " ".join(parts[start : i + 1])
        if len(piece) >= cfg.min_size:
            out.append(piece)
            start = i + 1
    return out + ([" ".join(parts[start:])] if start < len(parts) else [])


def recursive(text: str, cfg: Chunking, embed: Callable[[pd.Series], list[np.ndarray]] = hashed_vectors) -> list[str]:
    """Pieces longer than max_size are split again until none is or a pass changes nothing; a last piece shorter than min_size is glued to the one before
    (a single one stays)."""
    pieces, stop = [text], False
    while not stop and any(len(p) >= cfg.max_size for p in pieces):
        new: list[str] = []
        for p in pieces:
            parts = split_text(p, cfg, embed) if len(p) > cfg.max_size else [p]
            if len(parts) > 1 and len(parts[-1]) < cfg.min_size:
                parts[-2:] = [parts[-2] + parts[-1]]
            new += parts
        stop, pieces = len(new) == len(pieces), new
    return pieces


def chunk_documents(docs: DataFrame, cfg: Chunking = Chunking(), max_chunks: int | None = None, embed: Callable[[pd.Series], list[np.ndarray]] = hashed_vectors) -> DataFrame:  # noqa: B008
    """doc, chunk_ord, text of documents (doc, text). Null texts have no chunk, an empty one an empty chunk. Batches are bounded by bytes on their way in
    (session.ship), and by AT_ONCE characters, to the end of a document, on their way out."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc", pa.string()), ("chunk_ord", pa.int32()), ("text", pa.string())])

    def split(batches):
        for b in batches:
            rows, size = [], 0
            for d, t in zip(b.column("doc"), b.column("text"), strict=True):
                if t.is_valid:
                    rows += [(d.as_py(), i, c) for i, c in enumerate(recursive(t.as_py(), cfg, embed)[:max_chunks])]
                    size += len(t.as_py())
                if size >= AT_ONCE:
                    yield pa.record_batch(list(zip(*rows, strict=True)) or [[], [], []], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch(list(zip(*rows, strict=True)), schema=schema)
            b = rows = d = t = None
            give_back()

    return docs.select(F.col("doc").cast("string").alias("doc"), "text").mapInArrow(split, "doc string, chunk_ord int, text string")
