"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs, so
every prefix of a text has one valid last token: the one that ends there and is valid after the last token of
the prefix before it. These last tokens are stored. An append goes on from them, and an edit encodes again only
from the pretoken before it to the first boundary after it that both texts share.

Documents are encoded a batch at a time: pretokens are cut by vector operations that follow the public pattern
exactly, each distinct one is encoded once a worker, and ids are gathered.

Defined cases: a null or empty text has no ids and is round-tripped. Repeated rows give repeated results; a
null doc_id is passed through; other columns are ignored; an empty table gives an empty result. Decoding: null ids, a null among them,
and an id that the vocabulary lacks (a negative one too) give a null text, no ids an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.text import BATCH, CHUNK, arrow_map, buffers, kept, mix, picked, places, slices, table, texts_of

#: A vocabulary of ranks: base64 bytes and the id on each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pretokens, and pairs of tokens, that a worker keeps before it starts anew, and steps of the automaton that it keeps; only speed and memory depend on them.
KEPT, KEPT_PAIRS, KEPT_STEPS = 400_000, 1_000_000, 500_000
SCHEMA = "doc_id bigint, n_tokens bigint, token_ids array<int>, round_trip boolean"


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of the least rank, the first of equals, until none is left."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Prefixes:
    """The dynamic programme over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.valid: dict[int, bool] = {}  # by a << 32 | b: a number is smaller than a pair
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.size = [0] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.size[i] = len(t)
        self.longest = max(self.size)
        # An automaton of the tokens: where a byte leads (by state << 8 | byte; those that fall back are added as they occur), the state of the longest
        # end that is also a beginning of tokens, the longest token that ends in a state; and of each token the next shorter one that ends it.
        self.to: dict[int, int] = {}
        self.falls, self.ends, level = [0], [-1], []
        own: list[int] = [-1]
        for t, i in ranks.items():
            state = 0
            for x in t:
                if (to := self.to.get(state << 8 | x)) is None:
                    to = self.to[state << 8 | x] = len(own)
                    own.append(-1)
                    level.append((state, x, to))
                state = to
            own[state] = i
        self.falls, self.ends, self.shorter = [0] * len(own), list(own), [-1] * len(self.size)
        depth = [0] * len(own)
        for state, _, to in level:  # a state comes after the one that it goes on from
            depth[to] = depth[state] + 1
        for state, x, to in sorted(level, key=lambda e: depth[e[2]]):
            back = self.falls[state]
            while state and (at := self.to.get(back << 8 | x)) is None and back:
                back = self.falls[back]
            self.falls[to] = (at or 0) if state else 0
            below = self.ends[self.falls[to]]
            if own[to] >= 0:
                self.shorter[own[to]] = below
            else:
                self.ends[to] = below

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merging makes this one of last; twice itself if it's a byte; None if merging doesn't make it."""
        if token in self.halves:
            return self.halves[token]
        text = self.bytes_of[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        last = (token, token)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                last = None
                break
            last = self.ranks[parts[i]], self.ranks[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.halves[token] = last
        return last

    def pair(self, a: int, b: int) -> bool:
        """Whether the tokens a and b are the encoding of their bytes: undo the merges that made them, latest first; no merge over the border may
        have come before what is left."""
        if (ok := self.valid.get(a << 32 | b)) is not None:
            return ok
        key, ok, bound = a << 32 | b, self.whole(a) and self.whole(b), 1 << 60
        ranks, bytes_of = self.ranks, self.bytes_of
        while ok:
            over = ranks.get(bytes_of[a] + bytes_of[b])
            if over is not None and over < bound:
                ok = False
                break
            left, right = self.split(a)[1], self.split(b)[0]
            if left == a and right == b:
                break
            # The later merge is undone; of equals the left one came first.
            if right == b or left != a and a > b:
                bound, a = a, left
            else:
                bound, b = b + 1, right
        if len(self.valid) > KEPT_PAIRS:
            self.valid.clear()
        self.valid[key] = ok
        return ok

    def whole(self, token: int) -> bool:
        return self.split(token) is not None

    def extend(self, text: bytes, last: list[int]) -> list[int]:
        """last[i] is the last token of text[:i], last[0] is -1. It may hold a first part; the rest is added."""
        to, ends, size, shorter, valid, start, state, add = self.to.get, self.ends, self.size, self.shorter, self.valid.get, len(last), 0, last.append
        for x in text[max(0, start - 1 - self.longest) : start - 1]:
            state = self.step(state, x)
        for end in range(start, len(text) + 1):
            x = text[end - 1]
            if (at := to(state << 8 | x)) is None:
                at = self.step(state, x)
            state = at
            token = ends[state]
            while True:  # longest first; the last byte alone is a token
                before = last[end - size[token]]
                if before < 0:
                    if self.whole(token):
                        break
                else:
                    ok = valid(before << 32 | token)
                    if ok or ok is None and self.pair(before, token):
                        break
                token = shorter[token]
            add(token)
        return last

    def step(self, state: int, x: int) -> int:
        """The state after another byte."""
        if (at := self.to.get(state << 8 | x)) is None:
            at = self.step(self.falls[state], x) if state else 0
            if len(self.to) < KEPT_STEPS:
                self.to[state << 8 | x] = at
        return at

    def back(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the first end bytes."""
        at, out = len(last) - 1 if end is None else end, []
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def encode(self, text: bytes) -> list[int]:
        token = self.ranks.get(text, -1)
        return [token] if token >= 0 and self.whole(token) else self.back(self.extend(text, [-1]))


class Editable:
    """A text with its ids, which appends and edits keep exact without encoding it all again."""

    def __init__(self, prefixes: Prefixes, text: str = ""):
        self.prefixes, self.text = prefixes, ""
        self.cuts: list[int] = [0]
        self.lasts: list[list[int]] = []
        self.encoded_bytes = 0
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for last in self.lasts for i in self.prefixes.back(last)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, a: int, b: int, new: str) -> None:
        """Put new in place of characters a to b."""
        text = self.text[:a] + new + self.text[b:]
        # The pattern looks back never, and ahead at most three characters or over white space: a pretoken that
        # ends before the two that precede the one with the edit stays.
        k = max(0, int(np.searchsorted(self.cuts, a, side="left")) - 3)
        old = {c + len(text) - len(self.text): i for i, c in enumerate(self.cuts) if c >= b and i >= k}
        at, cuts, lasts = self.cuts[k], self.cuts[: k + 1], self.lasts[:k]
        rest = self.lasts[k:]
        if at < len(text):
            for n, m in enumerate(regex.finditer(PATTERN, text, pos=at)):
                word = m.group().encode()
                last = [-1]
                if n < len(rest):  # what this pretoken begins with may be encoded already
                    before = self.text[self.cuts[k + n] : self.cuts[k + n + 1]].encode()
                    same = next((i for i, (x, y) in enumerate(zip(before, word, strict=False)) if x != y), min(len(before), len(word)))
                    last = rest[n][: same + 1]
                self.encoded_bytes += len(word) + 1 - len(last)
                lasts.append(self.prefixes.extend(word, list(last)))
                cuts.append(m.end())
                if m.end() in old and m.end() > a + len(new) and m.end() < len(text):
                    i = old[m.end()]
                    cuts += [c + len(text) - len(self.text) for c in self.cuts[i + 1 :]]
                    lasts += self.lasts[i:]
                    break
        self.text, self.cuts, self.lasts = text, cuts, lasts


_CLASS = np.zeros(0, np.uint8)


def classes() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 other."""
    global _CLASS
    if not len(_CLASS):
        out = np.zeros(0x110000, np.uint8)
        low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
        for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for base, s in ((0, low), (0xE000, high)):
                for m in regex.finditer(p, s):
                    out[base + m.start() : base + m.end()] = k
        _CLASS = out
    return _CLASS


def pretokens(code: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pretokens start, in code points of documents that begin at off[:-1]."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[code]
    first = np.zeros(n + 1, bool)
    begin = off[:-1][off[:-1] < n]
    first[begin] = True
    doc_start = np.zeros(n + 1, bool)
    doc_start[off] = True
    first[1:n] |= kind[1:] != kind[:-1]
    # White space before a word: its last character goes with the word if it is a blank, else it stands alone.
    b = np.flatnonzero(first[1:n] & (kind[:-1] == 3) & ~doc_start[1:n]) + 1
    first[b - 1] = True
    blank = b[code[b - 1] == 32]
    first[blank] = False
    # Contractions: an apostrophe that begins a pretoken, and one or two letters.
    q = np.flatnonzero((code == 39) & first[:n])
    q = q[q + 1 < n]
    if len(q):
        q = q[~doc_start[q + 1]]
        pad = np.concatenate([code, np.zeros(3, np.uint32)])
        x, y = pad[q + 1], pad[q + 2]
        one = np.isin(x, [ord(c) for c in "sdmt"])
        two = ~doc_start[np.minimum(q + 2, n)] & ((x == ord("l")) & (y == ord("l")) | (x == ord("v")) & (y == ord("e")) | (x == ord("r")) & (y == ord("e")))
        for at, length in ((q[one], 2), (q[two & ~one], 3)):
            first[at + 1] = False
            end = at + length
            # A following blank or class starts anew by itself; more letters start here.
            first[end[end < n]] = True
    return np.flatnonzero(first[:n])


class Batches:
    """Encodes and decodes arrays of texts, and keeps what a worker has seen."""

    def __init__(self, ranks: dict[bytes, int]):
        self.prefixes = Prefixes(ranks)
        tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.begin = np.zeros(len(self.size), np.int64)
        ids = np.array(sorted(ranks.values()))
        self.size[ids] = [len(t) for t in tokens]
        self.begin[ids] = np.cumsum(self.size[ids]) - self.size[ids]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 offsets of the documents."""
        data, off = buffers(texts)
        ids, count = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for i, j in slices(off, 4 * CHUNK):
            x, n = self._run(bytes(data[off[i] : off[j]]), off[i : j + 1] - off[i])
            ids.append(x)
            count.append(n)
        return np.concatenate(ids), np.cumsum(np.concatenate(count))

    def _run(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = raw.decode()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(code) == len(raw):
            code_off = off
        else:
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            code_off = lead[off]
        starts = pretokens(code, code_off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        sums = places(code, starts)
        ends = np.concatenate([starts[1:], [len(code)]])
        which, distinct = pd.factorize(mix(sums[ends] - sums[starts]))
        sample = np.zeros(len(distinct), np.int64)
        sample[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if len(self.seen) + len(distinct) > KEPT and self.seen:
            self.forget()
        seen = self.seen
        slot = np.fromiter((seen.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh, size, first = [], [], len(seen)
            a, b = starts[sample[new]].tolist(), ends[sample[new]].tolist()
            encode = self.prefixes.encode
            for x, y in zip(a, b, strict=True):
                ids = encode(text[x:y].encode())
                fresh += ids
                size.append(len(ids))
            slot[new] = np.arange(first, first + len(new))
            seen.update(zip(distinct[new].tolist(), range(first, first + len(new)), strict=True))
            if len(self.at) <= len(seen) + 1:
                self.at = np.concatenate([self.at, np.zeros(max(len(self.at), len(new) + 1), np.int64)])
            filled = self.at[first]
            if len(self.flat) < filled + len(fresh):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(fresh)), np.int32)])
            self.flat[filled : filled + len(fresh)] = fresh
            self.at[first + 1 : first + 1 + len(new)] = filled + np.cumsum(size)
        begin, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        ids = gather(self.flat, begin[which], size[which])
        done = np.concatenate([[0], np.cumsum(size[which])])
        return ids, np.diff(done[np.searchsorted(starts, code_off)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return gather(self.bytes, self.begin[ids], self.size[ids])

    def returns(self, texts: pa.Array, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each document, whether its ids decode to its bytes."""
        data, at = buffers(texts)
        out = np.zeros(len(off) - 1, bool)
        for i, j in slices(at):
            part = ids[off[i] : off[j]]
            size = np.concatenate([[0], np.cumsum(self.size[part])])[off[i : j + 1] - off[i]]
            same = np.diff(size) == np.diff(at[i : j + 1])
            if same.all():
                wrong = np.flatnonzero(self.decode(part) != data[at[i] : at[j]])
                same[np.searchsorted(at[i : j + 1] - at[i], wrong, side="right") - 1] = False
            else:
                for d in np.flatnonzero(same) + i:
                    same[d - i] = bool(np.array_equal(self.decode(ids[off[d] : off[d + 1]]), data[at[d] : at[d + 1]]))
            out[i:j] = same
        return out


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin[i] : begin[i] + size[i]] of every i, one after the other."""
    done = np.cumsum(size)
    return flat[np.repeat(begin - done + size, size) + np.arange(done[-1] if len(done) else 0)]


def worker(key: str, ranks: dict[bytes, int]) -> Batches:
    """This worker's encoder of a vocabulary, kept from task to task of these functions."""
    return kept(key, lambda: Batches(ranks))


def named(ranks: dict[bytes, int]) -> str:
    """A name of the vocabulary's content."""
    h = hashlib.sha256()
    for t, i in ranks.items():
        h.update(b"%d %d " % (i, len(t)) + t)
    return h.hexdigest()


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, token_ids and whether they decode to the text, for every row."""
    docs = texts_of(docs)
    ranks = load(vocabulary)
    sent, key = docs.sparkSession.sparkContext.broadcast(ranks), named(ranks)

    def make():
        codec = worker(key, sent.value)

        def encode(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, off = codec.encode(b.column("text"))
            ok = codec.returns(b.column("text"), ids, off)
            return pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array(np.diff(off)), "token_ids": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), "round_trip": pa.array(ok)})

        return encode

    return arrow_map(docs, make, SCHEMA, BATCH, keep=key)


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows of doc_id and token_ids; ids that aren't UTF-8 together are read with U+FFFD."""
    ranks = load(vocabulary)
    sent, key = ids.sparkSession.sparkContext.broadcast(ranks), named(ranks)

    def make():
        codec = worker(key, sent.value)

        def texts(b: pa.RecordBatch) -> pa.RecordBatch:
            lists = b.column("token_ids")
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            off = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            known = (flat >= 0) & (flat < len(codec.size))
            known[known] = codec.size[flat[known]] > 0
            flat = np.where(known, flat, 0)
            wrong = np.concatenate([[0], np.cumsum(~known)])
            at = np.concatenate([[0], np.cumsum(codec.size[flat])])[off].tolist()
            data = bytes(codec.decode(flat))
            ok = (np.diff(wrong[off]) == 0) & lists.is_valid().to_numpy(zero_copy_only=False)
            return pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array([data[at[i] : at[i + 1]].decode(errors="replace") if k else None for i, k in enumerate(ok.tolist())], pa.string())})

        return texts

    return arrow_map(picked(ids, doc_id="bigint", token_ids="array<bigint>"), make, "doc_id bigint, text string", keep=key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
