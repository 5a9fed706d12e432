"""Token ids as Simple-8b: 64-bit little-endian words, the high four bits of each a selector of how many ids it holds.

Blocks of BLOCK ids start at a word of their own, whose place is in block_offsets, so any block can be decoded alone and all of
them at once. Greedy packing: each word takes the selector of most ids that all fit; what a block's last word has no ids for is
zero. An id of more than 60 bits is an escape: a word with selector 15, then the id as a word.

Defined cases: a null or empty text has no ids (n_tokens 0, no words, no blocks). Null ids, or a null among them, give null words. Ids are
unsigned 64-bit, so negative ones are escapes and come back as they were. Repeated rows give repeated results, a null doc_id is
passed through, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.bpe import PATTERN, VOCABULARY, Batches, load, named
from graphloom.llm.text import BATCH, arrow_map, picked, table, texts_of

BLOCK = 128
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15
#: Blocks that are packed at once.
_AT_ONCE = 1 << 14
SCHEMA = "doc_id bigint, n_tokens bigint, n_words bigint, words binary, block_offsets array<int>, round_trip boolean"


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each unsigned id, 0 for 0."""
    out = np.zeros(ids.shape, np.uint8)
    for s in (32, 16, 8, 4, 2, 1):
        big = ids >> np.uint64(s) != 0
        out += big * np.uint8(s)
        ids = np.where(big, ids >> np.uint64(s), ids)
    return out + (ids != 0)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """Of each position of each block, the first selector all of whose ids fit; ids after the block count as zero."""
    n, m = bits.shape
    most = {1: np.concatenate([bits, np.zeros((n, 128), np.uint8)], axis=1)}
    k = 1
    while k < 64:
        a = most[k]
        most[2 * k] = np.maximum(a, np.concatenate([a[:, k:], np.zeros((n, k), np.uint8)], axis=1))
        k *= 2
    out = np.full((n, m), ESCAPE, np.uint8)
    for s in range(ESCAPE - 1, -1, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        top = np.maximum(most[p][:, :m], most[p][:, c - p : c - p + m])
        out[top <= WIDTHS[s]] = s
    return out


def pack(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents, n + 1 offsets of the documents' words, and of each block (with those of the document before
    it) the first word."""
    ids = ids.astype(np.int64).view(np.uint64)
    count = np.diff(off)
    blocks = -(-count // BLOCK)
    b_off = np.concatenate([[0], np.cumsum(blocks)])
    start = np.repeat(off[:-1] - b_off[:-1] * BLOCK, blocks) + np.arange(b_off[-1]) * BLOCK
    size = np.minimum(np.repeat(off[1:], blocks) - start, BLOCK)
    words, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a in range(0, len(start), _AT_ONCE):
        w, n = _pack_blocks(ids, start[a : a + _AT_ONCE], size[a : a + _AT_ONCE])
        words.append(w)
        many.append(n)
    w_off = np.concatenate([[0], np.cumsum(np.concatenate(many))])
    return np.concatenate(words), w_off[b_off], w_off[:-1]


def _pack_blocks(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(start), BLOCK + 120), np.uint64)
    end = np.cumsum(size)
    row = np.repeat(np.arange(len(start)), size)
    x[row, np.arange(end[-1]) - np.repeat(end - size, size)] = ids[np.repeat(start - end + size, size) + np.arange(end[-1])]
    best = _selectors(_bits(x[:, :BLOCK]))
    at, block, found = np.zeros(len(start), np.int64), np.arange(len(start)), []
    while len(block):  # a word of every block that isn't done
        s = best[block, at[block]]
        found.append((block, at[block], s))
        at[block] = at[block] + COUNTS[s]
        block = block[at[block] < size[block]]
    which, pos, sel = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(which, kind="stable")  # words of a block were found in order
    which, pos, sel = which[order], pos[order], sel[order]
    length = 1 + (sel == ESCAPE)
    place = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint64)
    out[place] = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel).tolist():
        k = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[place[k] + 1] = x[which[k], pos[k]]
        elif WIDTHS[s]:
            c = int(COUNTS[s])
            part = x[which[k][:, None], pos[k][:, None] + np.arange(c)]
            out[place[k]] |= np.bitwise_or.reduce(part << (np.arange(c) * WIDTHS[s]).astype(np.uint64), axis=1)
    return out, np.bincount(which, length, len(start)).astype(np.int64)


def unpack(words: np.ndarray, block_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at these words and hold so many ids each, one after the other."""
    n = np.diff(np.append(block_at, len(words)))
    block = np.repeat(np.arange(len(n)), n)
    sel = (words >> np.uint64(60)).astype(np.int64)
    plain = np.ones(len(words), bool)
    escapes: list[int] = []
    # A word after an escape is an id, whatever its selector seems to be.
    for i in np.flatnonzero(sel == ESCAPE).tolist():
        if plain[i]:
            plain[i + 1] = False
            escapes.append(i)
    many = np.where(plain, COUNTS[sel], 0)
    before = np.cumsum(many) - many
    first = before[np.minimum(block_at, len(words) - 1)] if len(words) else before
    many = np.clip(size[block] - (before - first[block]), 0, many)
    end = np.cumsum(many)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    for s in range(1, ESCAPE):
        k = np.flatnonzero(plain & (sel == s))
        if len(k):
            c, w = int(COUNTS[s]), np.uint64((1 << int(WIDTHS[s])) - 1)
            part = words[k][:, None] >> (np.arange(c) * WIDTHS[s]).astype(np.uint64) & w
            ok = np.arange(c) < many[k][:, None]
            out[((end - many)[k][:, None] + np.arange(c))[ok]] = part[ok]
    for i in escapes:
        out[end[i] - 1] = words[i + 1]
    return out.view(np.int64)


def sizes(count: np.ndarray) -> np.ndarray:
    """Ids of each block of documents of so many ids."""
    blocks = -(-count // BLOCK)
    last = np.cumsum(blocks) - 1
    out = np.full(int(blocks.sum()), BLOCK)
    out[last[blocks > 0]] = count[blocks > 0] - (blocks[blocks > 0] - 1) * BLOCK
    return out


def _batch(doc_id: pa.Array, ids: np.ndarray, off: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
    words, w_off, b_at = pack(ids, off)
    count = np.diff(off)
    back = unpack(words, b_at, sizes(count)) == ids
    done = np.concatenate([[0], np.cumsum(~back)])
    blocks = -(-count // BLOCK)
    b_off = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((w_off * 8).astype(np.int32)), pa.py_buffer(words)])
    starts = pa.ListArray.from_arrays(pa.array(b_off), pa.array((b_at - np.repeat(w_off[:-1], blocks)).astype(np.int32)))
    cols = {"n_tokens": pa.array(count), "n_words": pa.array(np.diff(w_off)), "words": binary, "block_offsets": starts, "round_trip": pa.array(done[off[1:]] == done[off[:-1]])}
    if not ok.all():
        cols = {k: pc.if_else(pa.array(ok), c, pa.scalar(None, c.type)) for k, c in cols.items()}
    return pa.record_batch([doc_id, *cols.values()], names=["doc_id", *cols])


def packed(ids: DataFrame) -> DataFrame:
    """Rows of doc_id and token_ids as words."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            lists = b.column("token_ids")
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            none = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            off = np.concatenate([[0], np.cumsum(count)])
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(none[off]) == 0)
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False)[np.repeat(ok, count)]
            return _batch(b.column("doc_id"), flat, np.concatenate([[0], np.cumsum(np.where(ok, count, 0))]), ok)

        return f

    return arrow_map(picked(ids, doc_id="bigint", token_ids="array<bigint>"), make, SCHEMA)


def unpacked(words: DataFrame) -> DataFrame:
    """doc_id and token_ids of what packed() gave."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = b.column("words"), b.column("block_offsets")
            ok = data.is_valid().to_numpy(zero_copy_only=False)
            count = np.where(ok, b.column("n_tokens").fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            n_words = np.array(pc.fill_null(pc.binary_length(data), 0)).astype(np.int64) // 8
            first = np.cumsum(n_words) - n_words
            blocks = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = unpack(np.frombuffer(b"".join(data.drop_null().to_pylist()), np.uint64), at.flatten().to_numpy(zero_copy_only=False) + np.repeat(first, blocks), sizes(count))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat), mask=pa.array(~ok))
            return pa.record_batch({"doc_id": b.column("doc_id"), "token_ids": lists})

        return f

    return arrow_map(picked(words, doc_id="bigint", n_tokens="bigint", words="binary", block_offsets="array<int>"), make, "doc_id bigint, token_ids array<bigint>")


_CODECS: dict[str, Batches] = {}


def _codec(key: str, ranks: dict[bytes, int]) -> Batches:
    """The public encoder of a vocabulary, with what this worker has encoded."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = codec = Batches(ranks)
        public = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        codec.prefixes.encode = lambda piece: public.encode_ordinary(piece.decode())
    return _CODECS[key]


def documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The byte-level BPE ids of each document as words, for every row."""
    ranks = load(vocabulary)
    sent, key = docs.sparkSession.sparkContext.broadcast(ranks), named(ranks)

    def make():
        codec = _codec(key, sent.value)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, off = codec.encode(b.column("text"))
            return _batch(b.column("doc_id"), ids.astype(np.int64), off, np.ones(len(off) - 1, bool))

        return f

    return arrow_map(texts_of(docs), make, SCHEMA, BATCH)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents"))
