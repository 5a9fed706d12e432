"""Whole texts as numpy arrays: words, word hashes and shingles without a Python object per word.

A word is a maximal run of [a-z0-9] and non-ASCII characters of the lower-cased text; in a regular expression,
``[a-z0-9\\x{80}-\\x{10FFFF}]+``. Words become 64-bit hashes by sums of a mixed number for each byte and its place in the word, so the
cost is a fixed number of vector operations a byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.session import give_back, ship

#: Bytes that are worked on at once; a longer document is a chunk of its own.
CHUNK = 1 << 18
#: Bytes of text of a batch that is sent through a function.
BATCH = 8 << 20
#: The words of a text, for regular expressions.
WORD_RE = r"[a-z0-9\x{80}-\x{10FFFF}]+"

WORD = np.zeros(256, bool)
WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True

_BASE = 0x9E3779B97F4A7C15
_OF_BYTE = np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums (a zero first) of a number for each element and its place after the last of starts, which has no algebraic form: the difference of two
    sums between a start and its end is a hash of what lies there."""
    back = np.zeros(len(x), np.int64)  # of each start, how far the one before lies back; so sums give places
    if len(starts):
        back[starts[1:]] = np.diff(starts)
        back[starts[0]] = starts[0]
    at = np.arange(1, len(x) + 1)
    at -= np.cumsum(back, out=back)
    h = at.view(np.uint64)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= _OF_BYTE[x] if x.dtype == np.uint8 else (x.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(h, out=out[1:])
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def lower(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))


def slices(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents i..j of at most that many bytes, or of one document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of some documents: hash, first and last byte of each, and n + 1 word offsets of the documents."""

    __slots__ = ("data", "ends", "hash", "off", "starts", "sums")

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        self.data = data
        word = WORD[data]
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            cut = off[1:-1]
            a, b = cut[cut < n], cut[cut > 0] - 1
            first[a] = word[a]
            last[b] = word[b]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.starts, off)
        self.sums = places(data, self.starts)
        self.hash = self.between(self.starts, self.ends)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges, which begin where words do."""
        return mix(self.sums[ends] - self.sums[starts])

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def hash_of(word: str | bytes) -> int:
    """The hash that Words gives a lower-case word."""
    b = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(mix(places(b, np.zeros(min(len(b), 1), np.int64))[-1:])[0])


def shingles(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within each document, and their offsets. A document of fewer words, but
    one at least, has one shingle of all of them."""
    count = np.diff(off)
    have = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    out_off = np.concatenate([[0], np.cumsum(have)])
    if not len(h):
        return np.zeros(0, np.uint64), out_off
    pad = np.concatenate([h, np.zeros(n, np.uint64)])
    at = np.repeat(off[:-1] - out_off[:-1], have) + np.arange(out_off[-1])
    end = np.repeat(off[1:], have)
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        part = pad[at + i] * np.uint64(2 * i + 3) + np.uint64(i + 1)
        out = mix(out * np.uint64(_BASE) + np.where(at + i < end, part, np.uint64(0)))
    return out, out_off


def per_document(texts: pa.Array, most: int = CHUNK, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) of runs of documents of an Arrow string array, lower-cased unless told otherwise."""
    data, off = buffers(lower(texts) if fold else texts)
    for i, j in slices(off, most):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def pieces(b: pa.RecordBatch, most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """b in parts of at most that many bytes of text, or of one row."""
    off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    for i, j in slices(off, most):
        yield b.slice(i, j - i)


#: What this worker keeps from task to task; a task that doesn't ask for it drops it.
_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def begin(key: str | None = None) -> None:
    """Drop what tasks of other functions left in this worker."""
    for k in _KEPT.keys() - {key}:
        del _KEPT[k]
    give_back()


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType, most: int | None = None, text: str = "text", keep: str | None = None) -> DataFrame:
    """df through a function of record batches, of at most that many bytes of the column text if told so; make() is called once a task. keep: key of what the
    worker keeps for the next one."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(keep)
        f = make()
        for whole in batches:
            for b in [whole] if most is None else pieces(whole, most, text):
                if b.num_rows and (out := f(b)) is not None:
                    yield out
            whole = b = out = None
            give_back()
        f = None
        give_back()

    return df.mapInArrow(run, schema)


def picked(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns as these types, nulls where df has none. Names are matched exactly and by place, so that columns which
    differ in case only don't clash."""
    c = df.columns
    by_place = df.toDF(*(f"c{i}" for i in range(len(c))))
    return by_place.select(*((F.col(f"c{c.index(k)}") if k in c else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def texts_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id bigint, text string and the named string columns, whatever else df holds."""
    return picked(df, doc_id="bigint", text="string", **dict.fromkeys(more, "string"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_filter(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], most: int = BATCH) -> DataFrame:
    """The rows of df, all columns, for which a function of record batches, of at most that many bytes of text, says true; make() is called once a
    task."""

    names = df.columns
    by_place = df.toDF(*(f"c{i}" for i in range(len(names))))  # names that differ in case only don't clash

    def filtered():
        f = make()
        return lambda b: b.filter(pa.array(f(b.rename_columns(names)), pa.bool_()))

    return arrow_map(by_place, filtered, by_place.schema, most, f"c{names.index('text')}").toDF(*names)
