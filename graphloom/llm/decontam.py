"""Benchmark decontamination by latent semantic retrieval.

1. Passages of PASSAGE words of all documents and items are TF-IDF rows (a word counts once a passage). Words of the benchmark are hashed to WORD_COLUMNS columns, all
   other words to OTHER_COLUMNS, whatever their number. A randomised SVD is taken in one distributed pass: each task adds up T'(T W) and
   the document frequencies of its passages T for one random W, and the driver factorises the sum (columns x RANK) as Halko,
   Martinsson and Tropp do for a positive semidefinite matrix. Scaling by IDF comes after, as it only scales W.
2. Windows of WINDOW words, STEP apart, of every document are projected; those whose cosine with an item is
   MIN_COSINE at least are candidates. Of an item of more than WINDOW words so are its own windows, 2 * STEP apart, and the margin is the
   item's length then, so that the stretch holds the whole item whichever of its parts was met.
   So are, exactly, places that share a run of SHORT_RUN or RUN words with an item: what lies on about the same diagonal is one candidate, of the
   item's length and a margin of a quarter of it on both sides. No verbatim item is lost, however short, and none of more than
   five words of which up to 40 % are replaced where runs are of SHORT_RUN words.
3. A candidate is contaminated if the longest common subsequence of the words of the item and of the window with a margin is LCS_SHARE of
   the item at least, and that with the item's answer ANSWER_SHARE of the answer: the column answer where the benchmark has one, else
   the item's last sentence. An item of less than MIN_WORDS words must stand there word for word, one of a single word must be all of the document.

The benchmark is searched ITEMS_AT_ONCE items at a time, in one latent space; what tasks are sent of it is in proportion to these.

Defined cases: null and empty texts hold nothing, and null or empty items match nothing. A document that holds
several items has a row for each, one that holds an item repeatedly one, with its best window. Repeated rows give
repeated results; items that repeat an item_id are matched by the one that sorts first. A null doc_id is passed
through; items without an item_id are ignored. Ties go to the first window. Other columns are ignored; an empty table of either kind gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import Words, arrow_filter, arrow_map, begin, buffers, give_back, lower, mix, per_document, picked, pieces, table, texts_of
from graphloom.session import ship

#: Words of a passage of the SVD; of a window, and between windows.
PASSAGE, WINDOW, STEP = 256, 64, 16
#: Latent dimensions, and further ones of the sketch.
RANK, OVERSAMPLE = 64, 8
#: Columns for benchmark words and for all others, and bits of the filter that tells them apart.
WORD_COLUMNS, OTHER_COLUMNS, FILTER_BITS = 8192, 1024, 24
WIDTH = WORD_COLUMNS + OTHER_COLUMNS
#: Squared IDF: what a passage and an item share by chance is frequent words.
IDF_POWER = 2
MIN_COSINE, LCS_SHARE, ANSWER_SHARE, MIN_WORDS = 0.4, 0.6, 0.5, 5
#: Words of a run that an item and a document share; the shorter one for items of less than SHORT words.
SHORT, SHORT_RUN, RUN = 16, 2, 3
#: Runs in common that are looked at once.
HITS = 1 << 20
#: Items that are sent to the tasks at once; a larger benchmark is searched in several passes.
ITEMS_AT_ONCE = 20_000
SEED = 20_240_601
SCHEMA = "doc_id bigint, item_id bigint, cosine double, lcs int, lcs_share double, answer_share double, word_at bigint"
#: Rows of passages, and bytes of text, that are worked on at once.
_ROWS, AT_ONCE = 512, 8 << 20


@dataclass
class Items:
    """Items in the order of their ids: ids, words as indices of vocab (sorted hashes), answers likewise."""

    ids: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocab: np.ndarray

    def index(self, h: np.ndarray) -> np.ndarray:
        """Of each word, its index in vocab, or -1."""
        if not len(self.vocab):
            return np.full(len(h), -1, np.int64)
        i = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[i] == h, i, -1)


def column(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each word, its column; known are the bits of the benchmark's words."""
    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    own = (known[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1)
    return np.where(own > 0, (h % np.uint64(WORD_COLUMNS)).astype(np.int64), WORD_COLUMNS + (h % np.uint64(OTHER_COLUMNS)).astype(np.int64))


def known_words(h: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The bits with those of these words set."""
    known = np.zeros(1 << (FILTER_BITS - 3), np.uint8) if known is None else known
    at = np.unique(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    np.bitwise_or.at(known, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return known


def hashes(text: str | None) -> np.ndarray:
    return Words(*buffers(lower(pa.array([text or ""], pa.string())))).hash


def answer_of(text: str) -> str:
    """The last sentence that has a word."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if len(hashes(p))]
    return parts[-1] if parts else ""


def items_of(rows: list) -> Items:
    """From rows of item_id, text, answer."""
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, text, answer in sorted((r[0], r[1] or "", r[2] or "") for r in rows if r[0] is not None):
        h = hashes(text)
        if len(h) and i not in kept:
            kept[i] = h, hashes(answer or answer_of(text))
    vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for pair in kept.values() for x in pair)]))
    at = lambda h: np.searchsorted(vocab, h)
    return Items(np.array(list(kept), np.int64), [at(h) for h, _ in kept.values()], [at(a) for _, a in kept.values()], vocab)


def test_matrix() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((WIDTH, RANK + OVERSAMPLE)).astype(np.float32)


def passages(w: Words, known: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of zeros and ones, some passages at a time."""
    col = column(w.hash, known)
    count = np.diff(w.off)
    many = -(-count // PASSAGE)
    first = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(first[:-1], count) + (np.arange(len(col)) - np.repeat(w.off[:-1], count)) // PASSAGE
    for a in range(0, int(first[-1]), _ROWS):
        i, j = np.searchsorted(row, [a, a + _ROWS])
        t = np.zeros((min(_ROWS, int(first[-1]) - a), WIDTH), np.float32)
        t[row[i:j] - a, col[i:j]] = 1
        yield t


def sketch(texts: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """T'(T W), document frequencies and the number of passages, over all texts."""
    spark = texts.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(known)
    rank, block = RANK + OVERSAMPLE, 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        known, w = sent.value, test_matrix()
        y, n = np.zeros((WIDTH, rank + 1)), 0
        for whole in batches:
            for b in pieces(whole, AT_ONCE):
                for _, _, data, off in per_document(b.column("text")):
                    for t in passages(Words(data, off), known):
                        y[:, :rank] += t.T @ (t @ w)
                        y[:, rank] += t.sum(axis=0)
                        n += len(t)
            whole = b = data = off = t = None
            give_back()
        if n:
            out = y.astype(np.float32)
            sums = [out[i : i + block].tobytes() for i in range(0, WIDTH, block)]
            yield pa.record_batch({"part": pa.array(range(0, WIDTH, block), pa.int32()), "n": pa.array([n] * len(sums)), "sums": pa.array(sums, pa.binary())})

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(float) for x in t.column("sums"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([pc.sum(t.column("n")).as_py()]), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, n bigint, sums binary"
    rows = texts.select("text").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect()
    if not rows:
        return np.zeros((WIDTH, rank)), np.zeros(WIDTH), 0
    total = np.concatenate([np.frombuffer(r.sums, float).reshape(-1, rank + 1) for r in sorted(rows, key=lambda r: r.part)])
    return total[:, :rank], total[:, rank], rows[0].n


@dataclass
class Space:
    """Latent vectors of the columns (IDF and singular values included) and of the items, then of windows of long ones; the item of each."""

    items: Items
    known: np.ndarray
    columns: np.ndarray
    of_items: np.ndarray
    owner: np.ndarray


def factorised(y: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """The latent vector of each column."""
    w = test_matrix()
    idf = (np.log((1 + n) / (1 + df)) + 1) ** IDF_POWER
    # With S = diag(idf), S T'T S = A, and y = T'T w, so S y = A (w / idf).
    y, test = y * idf[:, None], w / idf[:, None]
    shift = 1e-6 * np.linalg.norm(y)
    y = y + shift * test
    q, r = np.linalg.qr(y)
    core = test.T @ y
    core = np.linalg.pinv((core + core.T) / 2, hermitian=True)
    value, vector = np.linalg.eigh(r @ core @ r.T)
    order = np.argsort(-value)[:RANK]
    order = order[value[order] > 1e-5 * value.max()]  # a corpus of few different passages has fewer dimensions; the others are noise
    value = value[order] - shift
    columns = (q @ vector[:, order]) * idf[:, None] / np.sqrt(np.maximum(value, 1e-300) / n)
    return (columns - df / n @ columns / max(df.sum() / n, 1)).astype(np.float32)


def space_of(items: Items, known: np.ndarray, columns: np.ndarray) -> Space:
    parts, owner = [], []
    for k, x in enumerate(items.words):
        col = column(items.vocab[x], known)
        starts = sorted({*range(0, len(x) - WINDOW, 2 * STEP), len(x) - WINDOW}) if len(x) > WINDOW else []
        for part in (col, *(col[a : a + WINDOW] for a in starts)):
            v = columns[np.unique(part)].sum(axis=0, dtype=float) * (len(x) >= MIN_WORDS)  # shorter ones aren't searched for so
            parts.append(v / max(float(np.linalg.norm(v)), 1e-12))
            owner.append(k)
    return Space(items, known, columns, np.stack(parts).astype(np.float32), np.array(owner, np.int64))


def lcs(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence; the item's words are the bits of a number."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for x in words.tolist():
        if m := masks.get(x):
            u = v & m
            v = (v + u) | (v - u)
    return len(item) - (v & full).bit_count()


def _first(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def _codes(word: np.ndarray, n: int) -> np.ndarray:
    """Of each run of n words, a hash."""
    m = max(len(word) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word[i : i + m].astype(np.uint64) + np.uint64(1))
    return out


class Search:
    """Finds items in documents."""

    def __init__(self, space: Space):
        self.space, items = space, space.items
        self.columns = np.concatenate([space.columns, np.zeros((1, space.columns.shape[1]), np.float32)])
        self.size = np.array([len(x) for x in items.words], np.int64)
        self.least = np.where(self.size < MIN_WORDS, self.size, np.ceil(self.size * LCS_SHARE - 1e-9)).astype(np.int64)
        self.margin = np.where(self.size > WINDOW, self.size, STEP)
        # Item and word in one number, sorted, with the bits of the item's first 64 words that the word is.
        code, bit = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k, x in enumerate(items.words):
            code.append(k * (len(items.vocab) + 1) + x)
            bit.append(np.where(np.arange(len(x)) < 64, np.uint64(1) << (np.arange(len(x)) & 63).astype(np.uint64), np.uint64(0)))
        code, bit = np.concatenate(code), np.concatenate(bit)
        order = np.argsort(code, kind="stable")
        code, bit = code[order], bit[order]
        at = _first(code)
        self.code, self.bits = code[at], np.bitwise_or.reduceat(bit, at) if len(at) else bit
        self.full = np.array([(1 << min(n, 64)) - 1 for n in self.size.tolist()], np.uint64)

        self.step = np.maximum(self.size // 4, 2)
        self.runs = []
        exact = [(n, self.size == n) for n in range(1, MIN_WORDS)]
        for n, chosen in (*exact, (SHORT_RUN, (self.size >= MIN_WORDS) & (self.size < SHORT)), (RUN, self.size >= SHORT)):
            k = np.flatnonzero(chosen)
            if not len(k):
                continue
            many = self.size[k] - n + 1
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            code = np.concatenate([_codes(items.words[i], n) for i in k.tolist()])
            order = np.argsort(code)
            self.runs.append((n, code[order], np.repeat(k, many)[order], at[order]))

    def shared(self, word: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Stretches (document, item, first word, end) that share a run of words with an item."""
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for n, code, item, at in self.runs:
            p = np.arange(max(len(word) - n + 1, 0))
            p = p[np.logical_and.reduce([word[p + i] >= 0 for i in range(n)]) & (doc[p] == doc[p + n - 1])] if len(p) else p
            mine = np.zeros(len(word), np.uint64)
            mine[: max(len(word) - n + 1, 0)] = _codes(word, n)
            a = np.searchsorted(code, mine[p])
            many = np.searchsorted(code, mine[p], side="right") - a
            a, p, many = a[many > 0], p[many > 0], many[many > 0]
            done = np.concatenate([[0], np.cumsum(many)])
            i = 0
            while i < len(p):
                j = max(i + 1, int(np.searchsorted(done, done[i] + HITS, side="right")) - 1)
                m = many[i:j]
                hit = np.repeat(a[i:j] - (done[i:j] - done[i]), m) + np.arange(m.sum())
                d, k = np.repeat(doc[p[i:j]], m), item[hit]
                if n == 1:  # the item must be all of the document
                    alone = np.diff(off)[d] == 1
                    d, k, hit, m = d[alone], k[alone], hit[alone], np.bincount(np.repeat(np.arange(j - i), m)[alone], minlength=j - i)
                diagonal = (np.repeat(p[i:j], m) - off[d] - at[hit]) // self.step[k]
                order = np.lexsort((diagonal, k, d))
                d, k, diagonal = d[order], k[order], diagonal[order]
                new = np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (diagonal[1:] != diagonal[:-1]))
                d, k, diagonal = d[new], k[new], diagonal[new]
                lo = off[d] + (diagonal - 1) * self.step[k]
                yield d, k, np.maximum(lo, off[d]), np.minimum(lo + 3 * self.step[k] + self.size[k], off[d + 1])
                i = j

    def cosine(self, col: np.ndarray, item: int) -> float:
        v = self.columns[col].sum(axis=0)
        return float(v @ self.space.of_items[item] / max(float(np.linalg.norm(v)), 1e-12))

    def windows(self, col: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Latent vectors of the windows, the document of each and its first word."""
        count = np.diff(off)
        blocks = -(-count // STEP)
        b_off = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(count)), blocks)
        start = off[doc] + (np.arange(len(doc)) - b_off[doc]) * STEP
        many = np.maximum(blocks - WINDOW // STEP + 1, np.minimum(blocks, 1))
        first = np.repeat(b_off[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        rank = self.space.columns.shape[1]
        if not len(doc):
            return np.zeros((0, rank), np.float32), doc, start
        sums = np.zeros((len(doc) + WINDOW // STEP, rank), np.float32)
        full = np.full(len(doc) * STEP, len(self.columns) - 1)  # no word
        full[np.repeat(b_off[:-1] * STEP - off[:-1], count) + np.arange(len(col))] = col
        for a in range(0, len(doc), 512):  # stays in the cache
            np.take(self.columns, full[a * STEP : (a + 512) * STEP], axis=0).reshape(-1, STEP, rank).sum(axis=1, out=sums[a : min(a + 512, len(doc))])
        out = sums[first]
        d = doc[first]
        for k in range(1, WINDOW // STEP):
            out += sums[first + k] * (first + k < b_off[d + 1])[:, None]
        return out, d, start[first]

    def find(self, data: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple]:
        """(document, item): lcs, its share, that of the answer, cosine, first word of the best window."""
        items, w = self.space.items, Words(data, off)
        word = items.index(w.hash)
        vec, doc, start = self.windows(column(w.hash, self.space.known), w.off)
        vec /= np.maximum(np.sqrt(np.einsum("ij,ij->i", vec, vec)), 1e-12)[:, None]
        best: dict[tuple[int, int], tuple] = {}
        for a in range(0, len(vec), 8192):
            cosine = vec[a : a + 8192] @ self.space.of_items.T
            at, item = np.nonzero(cosine >= MIN_COSINE)
            cos, at, item = cosine[at, item], at + a, self.space.owner[item]
            if len(self.space.owner) > len(items.ids):  # several windows of an item: the nearest
                order = np.lexsort((-cos, item, at))
                cos, at, item = cos[order], at[order], item[order]
                new = _first(at * len(items.ids) + item)
                cos, at, item = cos[new], at[new], item[new]
            lo = np.maximum(start[at] - self.margin[item], w.off[doc[at]])
            hi = np.minimum(start[at] + WINDOW + self.margin[item], w.off[doc[at] + 1])
            for i in range(0, len(at), 1 << 15):
                part = slice(i, i + (1 << 15))
                for k, n in self.long_enough(word, lo[part], hi[part], item[part]):
                    k += i
                    self.keep(best, int(doc[at[k]]), int(item[k]), word[lo[k] : hi[k]], n, float(cos[k]), int(start[at[k]] - w.off[doc[at[k]]]))
        known = np.sort(np.array([d * len(items.ids) + k for d, k in best], np.int64))
        for d, item, lo, hi in self.shared(word, w.off):
            new = ~np.isin(d * len(items.ids) + item, known)
            d, item, lo, hi = d[new], item[new], lo[new], hi[new]
            for i in range(0, len(d), 1 << 15):
                part = slice(i, i + (1 << 15))
                for k, n in self.long_enough(word, lo[part], hi[part], item[part]):
                    k += i
                    own = slice(lo[k], hi[k])
                    self.keep(best, int(d[k]), int(item[k]), word[own], n, self.cosine(column(w.hash[own], self.space.known), int(np.searchsorted(self.space.owner, item[k]))), int(lo[k] - w.off[d[k]]))
        return best

    def long_enough(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> list[tuple[int, int]]:
        """The candidates with a common subsequence of the least length, and its length; all stretches word[lo:hi] go through the
        bits of their items together."""
        n = hi - lo
        end = np.cumsum(n)
        flat, of = word[np.repeat(lo - end + n, n) + np.arange(end[-1])], np.repeat(item, n)
        key = np.where(flat >= 0, of * (len(self.space.items.vocab) + 1) + flat, -1)
        at = np.minimum(np.searchsorted(self.code, key), len(self.code) - 1)
        hit = self.code[at] == key
        done = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        few = np.flatnonzero(done[end] - done[end - n] >= self.least[item])
        out = [(k, got) for k in few[self.size[item[few]] > 64].tolist() if (got := lcs(self.space.items.words[item[k]], word[lo[k] : hi[k]])) >= self.least[item[k]]]
        few = few[self.size[item[few]] <= 64]
        mask = np.where(hit, self.bits[at], np.uint64(0))
        first, n, item = (end - n)[few], n[few], item[few]
        v = np.full(len(few), ~np.uint64(0))
        for j in range(int(n.max(initial=0))):
            m = np.where(j < n, mask[np.minimum(first + j, len(mask) - 1)], np.uint64(0))
            u = v & m
            v = (v + u) | (v - u)
        size = self.size[item]
        got = size - np.bitwise_count(v & self.full[item])
        return out + [(int(few[k]), int(got[k])) for k in np.flatnonzero(got >= self.least[item])]

    def keep(self, best: dict, doc: int, item: int, words: np.ndarray, n: int, cosine: float, at: int) -> None:
        if (old := best.get((doc, item))) and (old[0], old[3], -old[4]) >= (n, cosine, -at):
            return
        answer = self.space.items.answers[item]
        share = lcs(answer, words) / len(answer) if len(answer) else 1.0
        if share >= ANSWER_SHARE:
            best[doc, item] = n, n / int(self.size[item]), share, cosine, at


def spaces(docs: DataFrame, benchmark: DataFrame) -> Iterator[Space]:
    """One latent space, with each part of the benchmark; one, unless it's larger than ITEMS_AT_ONCE."""
    some = picked(benchmark, item_id="bigint", text="string", answer="string").where("item_id is not null")
    parts, known = -(-some.count() // ITEMS_AT_ONCE), None
    of = [some.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) for k in range(parts)]
    first = None
    for part in of:  # the driver holds one part at a time
        items = items_of(part.collect())
        first, known = first or items, known_words(items.vocab, known)
    if known is None or not known.any():
        return
    columns = factorised(*sketch(texts_of(docs).select("text").unionByName(some.select("text")), known))
    for k, part in enumerate(of):
        items = items_of(part.collect()) if k else first
        if len(items.ids):
            yield space_of(items, known, columns)


def contaminated(docs: DataFrame, space: Space) -> DataFrame:
    """A row for each document and item that it holds."""
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def make():
        search = Search(sent.value)
        names = sent.value.items.ids

        def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for i, _, data, off in per_document(b.column("text")):
                rows += [(d + i, names[k], round(c, 4), n, round(s, 6), round(a, 6), at) for (d, k), (n, s, a, c, at) in sorted(search.find(data, off).items())]
            if not rows:
                return None
            d, *rest = zip(*rows, strict=True)
            return pa.record_batch([b.column("doc_id").take(pa.array(d)), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()), strict=True))], names=["doc_id", "item_id", "cosine", "lcs", "lcs_share", "answer_share", "word_at"])

        return f

    return arrow_map(texts_of(docs), make, SCHEMA, AT_ONCE)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for space in spaces(docs, benchmark):
        out = out.unionByName(contaminated(docs, space))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    out = docs
    for space in spaces(docs, benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(space)

        def make(sent=sent):
            search = Search(sent.value)

            def mask(b: pa.RecordBatch) -> np.ndarray:
                ok = np.ones(b.num_rows, bool)
                for i, _, data, off in per_document(b.column(b.schema.get_field_index("text"))):
                    ok[[d + i for d, _ in search.find(data, off)]] = False
                return ok

            return mask

        out = arrow_filter(out, make)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
