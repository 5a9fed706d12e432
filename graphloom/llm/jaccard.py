"""N-gram Jaccard join: a size-aware heavy-light join.

Two documents are linked if the Jaccard similarity of their sets of word n-grams is THRESHOLD at least. It is exact:

1. A first pass names the set of every document, and finds the n-grams that so many sets hold that their postings must not meet in one place (hot).
2. Every other n-gram is sent to a bucket, which counts the sets that hold it. N-grams of one set only are dropped; what
   is left goes back to its set, and so do, straight, the hot ones, whose counts are known. A set of size n with a partner shares
   need = ceil(THRESHOLD * n) n-grams or more, so one that has fewer shared n-grams is done with.
3. The shared n-grams of a set are ordered, rare ones first. Partners share k of the first
   shared - need + k of them, for any k. Sets up to a boundary of size (light) enumerate the subsets of k = 2 of
   theirs, and those of need = 1 single n-grams too, and two that have a subset in common are a candidate. Larger sets (heavy) scan the inverted lists of
   theirs for k = 1, in which all sets stand. The boundary is the size that makes the counted cost of
   both least. Lists live where the least set of their n-gram says, so that a pair found by many n-grams
   is mostly found in one place. A list of more than LIST sets is cut into parts, and each two parts meet in a place of their own.
4. Sets take all their shared n-grams along, and candidates are verified where they meet, some sets against some others at a time: from the candidates, or where there are
   many, as in a cluster of near copies, all with all by bits. A pair counts only in the place of the first n-gram that both have, so no pair leaves its place but those that are the result.
5. Where only what is connected is asked for (forest), sets that stand in long lists are first compared with the least sets of their n-grams. A long list of sets that this connects
   is left out; of one where all but LIST sets at most are connected, the connected ones go to one place each, and the others meet them in all. Parts of other long lists
   meet as above. So a cluster of near copies is sent in proportion to its size.

Sets are named by 64-bit fingerprints and n-grams by 48 bits and their bucket. Documents with equal sets are one set while pairs are searched, and copies are never
expanded into pairs: classes gives each document its class (the least doc_id of all that links connect it with) and its number of links, copies and
near copies alike; join gives the pairs of the least documents of the sets, and pairs each other document of a set with the least.

Defined cases: texts without a word (null, empty) have an empty set and no partner. A text of less than N words has one
n-gram of all of them. Rows without a doc_id are ignored; rows that repeat a doc_id with the same set count once, those that repeat it with another set are documents
of their own. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.text import Words, arrow_map, begin, give_back, mix, per_document, shingles, table, texts_of
from graphloom.session import ship, written

#: Words of an n-gram, and the least similarity.
N, THRESHOLD = 5, 0.5
#: What it costs to ship and group a subset, where to look at an entry of an inverted list costs 1.
SUBSET_COST = 4.0
#: Bytes of text whose n-grams are sorted at once.
AT_ONCE = 16 << 20
#: Entries that are compared at once, sets of a part of an inverted list, and pairs of sets that are verified at once.
BLOCK, LIST, VERIFIED = 1_000_000, 1024, 250_000
#: N-grams of the sets on one side that are verified at once; sets that have more subsets are heavy.
TOKENS, SUBSETS = 1_000_000, 2048
#: Bytes that a set's places are sent in at once, and the least sets that a set in long lists is compared with.
SENT_AT_ONCE, STARS = 4 << 20, 4
#: An n-gram is hot if batches that hold it OFTEN times count it so many times, and more than a millionth of all n-grams; so there are a million hot ones at most.
OFTEN, HOT, HOT_SHARE = 16, 50_000, 1e-6
#: Documents whose ids are sent to all tasks; if there are more, they are joined.
IDS_AT_ONCE = 2_000_000

_RUN = np.dtype([("set", "<u8"), ("size", "<u4"), ("count", "<u4")])
_DOC = np.dtype([("set", "<u8"), ("id", "<i8"), ("size", "<u4")])
_POST = np.dtype([("token", "<u8"), ("df", "<u4"), ("home", "<u4")])
_OFTEN = np.dtype([("gram", "<u8"), ("n", "<u4")])
#: Bytes of an n-gram that are sent to its bucket.
_SENT = 6
_LOW = np.uint64((1 << 8 * _SENT) - 1)
BLOBS = "kind int, key int, a binary, b binary"
SETS = "id bigint, size bigint, p1 int, subsets double, lists double, own bigint, long int, tokens binary, homes binary, dfs binary"
MET = "key int, id bigint, size bigint, copies bigint, heavy boolean, a binary, b binary, tokens binary, homes binary, dfs binary"


def _blobs(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Byte strings x[cuts[i] : cuts[i + 1]]."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.dtype.itemsize * (x.shape[1] if x.ndim > 1 else 1)).astype(np.int32)), pa.py_buffer(x)])


def _join(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)])


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _set_bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(name) % np.uint64(buckets)).astype(np.int64)


def _split(key: np.ndarray, x: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x ordered by key (stable), the keys that occur, and where each begins, with the end."""
    order = np.argsort(key.astype(np.uint16) if buckets <= 1 << 16 else key, kind="stable")
    s = key[order]
    at = _starts(s)
    return x[order], s[at], np.append(at, len(s))


def _sets(ids: np.ndarray, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_DOC of each document with a word; then the distinct n-grams of each distinct set and which set each is of (index into the first rows
    of unique sets)."""
    docs, grams, owner, known, base = [np.zeros(0, _DOC)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], set(), 0
    for i, j, data, off in per_document(texts):
        w = Words(data, off)
        g, go = shingles(w.hash, w.off, n)
        d = np.repeat(np.arange(j - i), np.diff(go))
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
        g, d = g[new], d[new]
        at = _starts(d)
        if not len(at):
            continue
        size = np.diff(np.append(at, len(d)))
        name = mix(np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A5)), at) ^ size.astype(np.uint64))
        doc = np.zeros(len(at), _DOC)
        doc["set"], doc["id"], doc["size"] = name, ids[i + d[at]], size
        docs.append(doc)
        _, first = np.unique(name, return_index=True)
        fresh = np.zeros(len(at), bool)
        fresh[[k for k in first.tolist() if int(name[k]) not in known]] = True
        known.update(name[fresh].tolist())
        take = np.repeat(fresh, size)
        grams.append(g[take])
        owner.append(np.repeat(np.arange(base, base + fresh.sum()), size[fresh]).astype(np.uint64))
        docs[-1] = np.concatenate([doc[fresh], doc[~fresh]])
        base += int(fresh.sum())
    return docs, grams, owner


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _token(low: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """The name of an n-gram, from what is sent of it and its bucket."""
    return low + mix(np.asarray(bucket).astype(np.uint64) << np.uint64(8 * _SENT))


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """A row for each batch: its documents, the n-grams that many of its sets hold with how many do, and how many n-grams all its sets have."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            docs, grams, _ = _sets(b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text"), n)
            g = np.sort(np.concatenate(grams))
            at = _starts(g)
            many = np.diff(np.append(at, len(g)))
            often = np.zeros(int((many >= OFTEN).sum()), _OFTEN)
            often["gram"], often["n"] = g[at][many >= OFTEN], many[many >= OFTEN]
            return pa.record_batch([pa.array([np.concatenate(docs).tobytes()], pa.binary()), pa.array([often.tobytes()], pa.binary()), pa.array([len(g)])], names=["docs", "often", "grams"])

        return one

    return arrow_map(docs, make, "docs binary, often binary, grams bigint", AT_ONCE)


def _documents(first: DataFrame) -> DataFrame:
    """id, name (of its set) and size of the documents with a word, each once."""

    def make():
        def rows(b: pa.RecordBatch) -> pa.RecordBatch:
            d = _join(b.column("docs"), _DOC)
            return pa.record_batch([pa.array(d["id"].astype(np.int64)), pa.array(d["set"].astype(np.uint64).view(np.int64)), pa.array(d["size"].astype(np.int64))], names=["id", "name", "size"])

        return rows

    return arrow_map(first.select("docs"), make, "id bigint, name bigint, size bigint").distinct()


def _hot(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot n-grams, sorted, and their counts."""

    def make():
        def rows(b: pa.RecordBatch) -> pa.RecordBatch:
            x = _join(b.column("often"), _OFTEN)
            return pa.record_batch([pa.array(x["gram"].astype(np.uint64).view(np.int64)), pa.array(x["n"].astype(np.int64))], names=["gram", "n"])

        return rows

    least = max(HOT, int((first.agg(F.sum("grams")).first()[0] or 0) * HOT_SHARE))
    got = arrow_map(first.select("often"), make, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    gram = got["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], np.minimum(got["n"].to_numpy(np.int64)[order], (1 << 32) - 1).astype(np.uint32)


def _postings(docs: DataFrame, n: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Kind 0: the n-grams of a bucket, by set; kind 1: hot n-grams, for the bucket of their set."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def make():
        known, count = sent.value

        def post(b: pa.RecordBatch) -> pa.RecordBatch:
            docs, grams, owner = _sets(b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text"), n)
            g, o = np.concatenate(grams), np.concatenate(owner).astype(np.int64)
            heads = np.concatenate([d[: int(m)] for d, m in zip(docs[1:], _fresh_counts(owner[1:]), strict=True)] or [np.zeros(0, _DOC)])
            is_hot = np.zeros(len(g), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                is_hot = known[at] == g
            bucket = _bucket(g, buckets)
            direct = _direct(g[is_hot], o[is_hot], bucket[is_hot], count[at[is_hot]], heads, buckets) if is_hot.any() else None
            bucket, o, g = bucket[~is_hot], o[~is_hot], g[~is_hot]
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            bucket, o, g = bucket[order], o[order], g[order]
            at = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (o[1:] != o[:-1])])) if len(g) else np.zeros(0, np.int64)
            runs = np.zeros(len(at), _RUN)
            runs["set"], runs["size"], runs["count"] = heads["set"][o[at]], heads["size"][o[at]], np.diff(np.append(at, len(g)))
            key_at = _starts(bucket)
            low = (g & _LOW).view(np.uint8).reshape(-1, 8)[:, :_SENT]
            made = pa.record_batch([pa.array(np.zeros(len(key_at), np.int32)), pa.array(bucket[key_at].astype(np.int32)), _blobs(runs, np.append(np.searchsorted(at, key_at), len(runs))), _blobs(low, np.append(key_at, len(g)))], names=["kind", "key", "a", "b"])
            return pa.Table.from_batches([made, direct]).combine_chunks().to_batches()[0] if direct is not None and len(key_at) else direct if direct is not None else made

        return post

    return arrow_map(docs, make, BLOBS, AT_ONCE)


def _posted(post: np.ndarray, name: np.ndarray, size: np.ndarray, kind: int, buckets: int) -> pa.RecordBatch:
    """Rows for the buckets of the sets: runs and posts."""
    to = _set_bucket(name, buckets)
    order = np.lexsort((name, to))
    post, name, size, to = post[order], name[order], size[order], to[order]
    at = _starts(name)  # sets of one bucket are side by side
    out = np.zeros(len(at), _RUN)
    out["set"], out["size"], out["count"] = name[at], size[at], np.diff(np.append(at, len(name)))
    key_at = _starts(to)
    return pa.record_batch([pa.array(np.full(len(key_at), kind, np.int32)), pa.array(to[key_at].astype(np.int32)), _blobs(out, np.append(np.searchsorted(at, key_at), len(out))), _blobs(post, np.append(key_at, len(post)))], names=["kind", "key", "a", "b"])


def _direct(g: np.ndarray, o: np.ndarray, bucket: np.ndarray, df: np.ndarray, heads: np.ndarray, buckets: int) -> pa.RecordBatch:
    post = np.zeros(len(g), _POST)
    post["token"], post["df"] = _token(g & _LOW, bucket), df
    post["home"] = (mix(post["token"]) >> np.uint64(32)).astype(np.uint32)
    return _posted(post, heads["set"][o], heads["size"][o], 1, buckets)


def _fresh_counts(owner: list[np.ndarray]) -> Iterator[int]:
    done = 0
    for o in owner:
        most = int(o[-1]) + 1 if len(o) else done
        yield most - done
        done = most


def _shared(buckets: int):
    """Reduces a bucket of n-grams: those of several sets go to the bucket of each set."""

    def reduce(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        mine = t.filter(pa.array(kind == 0))
        runs = _join(mine.column("a"), _RUN)
        low = _join(mine.column("b"), np.uint8).reshape(-1, _SENT)
        tok = np.zeros((len(low), 8), np.uint8)
        tok[:, :_SENT] = low
        tok = _token(tok.view(np.uint64).ravel(), key[0].as_py())
        _, first = np.unique(runs["set"], return_index=True)  # one set came from several tasks
        keep = np.zeros(len(runs), bool)
        keep[first] = True
        run = np.repeat(np.arange(len(runs)), runs["count"])
        take = keep[run]
        tok, run = tok[take], run[take]
        order = np.argsort(tok)
        tok, run = tok[order], run[order]
        at = _starts(tok)
        df = np.diff(np.append(at, len(tok)))
        name = runs["set"][run]
        home = np.minimum.reduceat(name, at) if len(at) else np.zeros(0, np.uint64)
        many = np.repeat(df >= 2, df)
        post = np.zeros(int(many.sum()), _POST)
        post["token"], post["df"], post["home"] = tok[many], np.repeat(df, df)[many], (mix(np.repeat(home, df)[many]) >> np.uint64(32)).astype(np.uint32)
        made = pa.Table.from_batches([_posted(post, name[many], runs["size"][run[many]], 0, buckets)])
        return pa.concat_tables([made, t.filter(pa.array(kind == 1)).select(["kind", "key", "a", "b"]).cast(made.schema)])

    return reduce


def _need(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.maximum(np.ceil(size * threshold - 1e-9), 1).astype(np.int64)


def _survivors(threshold: float):
    """Reduces a bucket of sets: those that may have a partner, with their shared n-grams."""

    def reduce(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        runs, post = _join(t.column("a"), _RUN), _join(t.column("b"), _POST)
        run = np.repeat(np.arange(len(runs)), runs["count"])
        name = runs["set"][run]
        order = np.lexsort((post["token"], post["df"], name))
        name, post, run = name[order], post[order], run[order]
        new = np.append(True, (name[1:] != name[:-1]) | (post["token"][1:] != post["token"][:-1]))[: len(name)]  # hot ones of a set that came from several tasks
        name, post, run = name[new], post[new], run[new]
        at = _starts(name)
        shared, size = np.diff(np.append(at, len(name))), runs["size"][run[at]].astype(np.int64)
        need = _need(size, threshold)
        ok = shared >= need
        p1 = np.maximum(shared - need + 1, 0)
        done = np.concatenate([[0], np.cumsum(post["df"], dtype=np.int64)])
        lists = (done[at + p1] - done[at]).astype(float) if len(at) else np.zeros(0)
        in_first = np.arange(len(name)) - np.repeat(at, shared) < np.repeat(p1, shared)
        longs = np.bincount(np.repeat(np.arange(len(at)), shared)[in_first & (post["df"] > LIST)], minlength=len(at))
        take = np.repeat(ok, shared)
        cuts = np.concatenate([[0], np.cumsum(shared[ok])])
        of = {"tokens": "token", "homes": "home", "dfs": "df"}
        plain = {"id": name[at].view(np.int64), "size": size, "p1": p1.astype(np.int32), "subsets": p1 * (p1 + 1) / 2.0, "lists": lists, "own": (mix(name[at]) >> np.uint64(32)).astype(np.int64), "long": longs.astype(np.int32)}
        return pa.table({k: pa.array(v[ok]) for k, v in plain.items()} | {k: _blobs(post[v][take], cuts) for k, v in of.items()})

    return reduce


def boundary(sets: DataFrame) -> float:
    """The size up to which sets are light: where subsets of all up to it and inverted lists of the larger cost least, no set having too many subsets to be sent."""
    rows = sets.groupBy(F.floor(F.log2("size") * 4).alias("c")).agg(F.sum("subsets").alias("s"), F.max("subsets").alias("most"), F.sum("lists").alias("l"), F.max("size").alias("m")).orderBy("c").collect()
    subsets, lists = np.array([r.s * SUBSET_COST for r in rows]), np.array([r.l for r in rows])
    cost = np.concatenate([[0], np.cumsum(subsets)]) + np.concatenate([np.cumsum(lists[::-1])[::-1], [0]])
    few = next((i for i, r in enumerate(rows) if r.most > SUBSETS), len(rows))
    k = int(cost[: few + 1].argmin())
    return float(rows[k - 1].m) if k else 0.0


def _parts(df: np.ndarray, most: int) -> np.ndarray:
    """Of how many parts lists are: powers of 2, so that lists of one home are mostly cut alike."""
    return (1 << np.ceil(np.log2(np.maximum(-(-df.astype(np.int64) // most), 1))).astype(np.int64)).astype(np.int64)


def _part(home: np.ndarray, n: np.ndarray, name: np.ndarray | np.uint64) -> np.ndarray:
    return (mix(home.astype(np.uint64) ^ name) % n.astype(np.uint64)).astype(np.int64)


def _place(home: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket where parts x and y of a list meet, and a name of the two."""
    two = (np.minimum(x, y) << 32 | np.maximum(x, y)).astype(np.uint64)
    apart = mix(home.astype(np.uint64) + mix(two + np.uint64(1)) + mix(n.astype(np.uint64))) % np.uint64(buckets)
    return np.where(n > 1, apart.astype(np.int64), home.astype(np.int64) % buckets), two


def _placed(value: np.ndarray, home: np.ndarray, df: np.ndarray, name: int, buckets: int, most: int, fate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists that a set stands in and their buckets. A long list is cut into parts: the set is in one of them, and meets each part of the list in a
    place of its own; unless its fate is another (_fates)."""
    n = _parts(df, most)
    long = n > 1
    at = home.astype(np.int64) % buckets
    if not long.any():
        return value, at
    short, fate = ~long, np.full(len(n), APART) if fate is None else fate
    keys, places = [value[short]], [at[short]]
    for what in (APART, MAIN, OTHER):
        some = long & (fate == what)
        if not some.any():
            continue
        v, h, m = value[some], home[some], n[some]
        mine = _part(h, m, np.uint64(name & 0xFFFFFFFFFFFFFFFF))
        if what == MAIN:
            to, two = _place(h, m, mine, mine, buckets)
        else:
            other = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            v, h, mine, m = np.repeat(v, m), np.repeat(h, m), np.repeat(mine, m), np.repeat(m, m)
            to, two = _place(h, m, mine if what == APART else other, other, buckets)
        keys.append(mix(v + mix(two + np.uint64(1))))
        places.append(to)
    return np.concatenate(keys), np.concatenate(places)


#: What becomes of a set in a long list: it meets each part; it's of the connected ones; it meets all those; the list is left out.
APART, MAIN, OTHER, GONE = 0, 1, 2, 3


def _fates(tok: np.ndarray, of: int, plan: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a set's n-grams, where the set is connected with of; plan: n-grams of long lists, in order, what most of their sets are connected with, how many others there are."""
    known, main, others = plan
    if not len(known):
        return np.full(len(tok), APART)
    at = np.minimum(np.searchsorted(known, tok), len(known) - 1)
    return np.where(known[at] != tok, APART, np.where(others[at] == 0, GONE, np.where(main[at] == of, MAIN, OTHER)))


def _keys(sets: DataFrame, light: float, buckets: int, plan: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """A row for each set and bucket of lists: keys of subsets (a), n-grams (b); all n-grams of the set, and of the first ones home and number of parts. sets has
    star, what a set is connected with. A set may go to many places, so rows are given away a few megabytes at a time."""
    ship(sets.sparkSession)
    sent = sets.sparkSession.sparkContext.broadcast(plan) if plan else None
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 5)
    names = [c.split()[0] for c in MET.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(v), kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        rows, held = [], 0
        for b in batches:
            for name, size, copies, p1, star, tokens, homes, dfs in zip(*(b.column(c) for c in ("id", "size", "copies", "p1", "star", "tokens", "homes", "dfs")), strict=True):
                tok, home, df = np.frombuffer(tokens.as_buffer(), np.uint64), np.frombuffer(homes.as_buffer(), np.uint32), np.frombuffer(dfs.as_buffer(), np.uint32)
                name, p, heavy = name.as_py(), p1.as_py(), size.as_py() > light
                fate = _fates(tok, star.as_py(), sent.value) if sent else np.full(len(tok), APART)
                subs, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if not heavy:
                    i, j = np.triu_indices(min(p + 1, len(tok)), 1)
                    subs, where, many, then = mix(tok[i] * np.uint64(0x9E3779B97F4A7C15) + mix(tok[j])), home[i], df[i], fate[i]
                    if p == len(tok):  # need = 1: a partner may share a single n-gram, and then has need = 1 too
                        subs, where, many, then = np.concatenate([subs, mix(tok)]), np.concatenate([where, home]), np.concatenate([many, df]), np.concatenate([then, fate])
                    subs, at = _placed(subs, where, many, name, buckets, LIST, then)
                keys, to = _placed(tok[:p], home[:p], df[:p], name, buckets, LIST, fate[:p])
                rest = memoryview(tokens.as_buffer()), home[:p].tobytes(), df[:p].tobytes()
                for h in np.unique(np.concatenate([at, to])).tolist():
                    rows.append((h, name, size.as_py(), copies.as_py(), heavy, subs[at == h].tobytes(), keys[to == h].tobytes(), *rest))
                    held += sum(map(len, rows[-1][5:]))
                    if held >= SENT_AT_ONCE:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)
                rows, held = [], 0
            give_back()

    return sets.select("id", "size", "copies", "p1", "star", "tokens", "homes", "dfs").mapInArrow(post, MET)


def _stars(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """Similar pairs of sets in long lists and the least sets of their n-grams (a, b, jaccard, links), what these connect (id, least), and a plan of the long lists
    of which LIST sets at most aren't connected with the others."""
    within = sets.where("long > 0")
    if not within.count():
        return None

    def members():
        def rows(b: pa.RecordBatch) -> pa.RecordBatch:
            who, to = [], []
            for k, homes in enumerate(b.column("homes")):
                h, n = np.unique(np.frombuffer(homes.as_buffer(), np.uint32), return_counts=True)
                h = h[np.argsort(-n, kind="stable")[:STARS]]
                who += [k] * len(h)
                to.append(h.astype(np.int64))
            return pa.record_batch([pa.array(np.concatenate(to)), *(b.column(c).take(pa.array(who)) for c in ("id", "size", "tokens"))], names=["own", "id", "size", "tokens"])

        return rows

    def similar():
        def rows(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y = b.column("size").to_numpy(), b.column("size_b").to_numpy()
            both = np.array([len(np.intersect1d(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), assume_unique=True)) for s, t in zip(b.column("tokens"), b.column("tokens_b"), strict=True)])
            sim = both / (x + y - both)
            ok = pa.array((both > 0) & (sim >= threshold - 1e-12))
            return pa.record_batch([b.column("id"), b.column("b"), pa.array(sim), pa.nulls(len(sim), pa.int64())], names=["a", "b", "jaccard", "links"]).filter(ok)

        return rows

    def tally():
        def rows(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [np.zeros((0, 2), np.int64)]
            for star, p1, tokens, dfs in zip(*(b.column(c) for c in ("star", "p1", "tokens", "dfs")), strict=True):
                p = p1.as_py()
                tok = np.frombuffer(tokens.as_buffer(), np.int64)[:p][np.frombuffer(dfs.as_buffer(), np.uint32)[:p] > LIST]
                out.append(np.stack([tok, np.full(len(tok), star.as_py(), np.int64)], axis=1))
            two, n = np.unique(np.concatenate(out), axis=0, return_counts=True)
            return pa.record_batch([pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), pa.array(n.astype(np.int64))], names=["token", "star", "n"])

        return rows

    sent = written(arrow_map(within.select("id", "size", "tokens", "homes"), members, "own bigint, id bigint, size bigint, tokens binary", 1 << 20, "tokens"), "jaccard-members")
    wanted = written(sent.select("own").distinct(), "jaccard-wanted")
    few = wanted.count() <= IDS_AT_ONCE
    least = sets.select("own", "id", "size", "tokens").join(F.broadcast(wanted) if few else wanted, "own", "left_semi").toDF("own", "b", "size_b", "tokens_b")
    pairs = written(arrow_map(sent.join(least, "own").where("id <> b").drop("own"), similar, "a bigint, b bigint, jaccard double, links bigint", 1 << 20, "tokens"), "jaccard-stars")
    stars = components(pairs.select(F.col("a").alias("left_id"), F.col("b").alias("right_id")))
    of = within.join(stars, "id", "left").select(F.coalesce("least", "id").alias("star"), "p1", "tokens", "dfs")
    n = arrow_map(of, tally, "token bigint, star bigint, n bigint", 1 << 20, "tokens").groupBy("token", "star").agg(F.sum("n").alias("n"))
    main = n.groupBy("token").agg(F.max(F.struct("n", "star")).alias("m"), F.sum("n").alias("all")).select("token", F.col("m.star").alias("star"), (F.col("all") - F.col("m.n")).alias("others"))
    got = main.where(F.col("others") <= LIST).toPandas()  # of every thousand n-grams of sets one at most is that of a long list
    token = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return pairs, stars, (token[order], got["star"].to_numpy(np.int64)[order], got["others"].to_numpy(np.int64)[order])


def _flat(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all blobs, and where each begins, with the end."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate([np.zeros(0, kind), *parts]), np.cumsum([0, *(len(p) for p in parts)])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i] to begin[i] + size[i] of every i, one after the other."""
    end = np.cumsum(size)
    return np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)


class _Lists:
    """The lists of a place that several sets stand in: entries in the order of list and set."""

    def __init__(self, column: pa.ChunkedArray):
        k, off = _flat(column, np.uint64)
        m = len(off) - 1
        who = np.repeat(np.arange(m), np.diff(off))
        order = np.argsort(k, kind="stable")
        k, who = k[order], who[order]
        at = _starts(k)
        n = np.diff(np.append(at, len(k)))
        several = np.repeat(n > 1, n)
        self.who, self.m = who[several], m
        self.run = np.repeat(np.arange(int((n > 1).sum())), n[n > 1])
        self.both = self.run * m + self.who

    def between(self, i: int, j: int, k: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the sets from i to j those that stand in a list before others from k to z: the sets, of each the first of the others, and how many."""
        e = np.flatnonzero((self.who >= i) & (self.who < j))
        base = self.run[e] * self.m
        lo = np.maximum(np.searchsorted(self.both, base + k), e + 1)
        n = np.maximum(np.searchsorted(self.both, base + z) - lo, 0)
        some = n > 0
        return self.who[e[some]], lo[some], n[some]


def _tiles(count: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of sets of a bounded number and a bounded number of n-grams, or of one set."""
    out, i, done = [], 0, np.concatenate([[0], np.cumsum(count)])
    while i < len(count):
        j = min(max(i + 1, int(np.searchsorted(done, done[i] + TOKENS, side="right")) - 1), i + max(int(most**0.5), 1))
        out.append((i, j))
        i = j
    return out


class _Met:
    """The sets that meet in a place, by size."""

    def __init__(self, t: pa.Table, threshold: float, here: int, buckets: int, longest: int, most: int, again: bool = False):
        t = t.take(pa.array(np.argsort(t.column("size").to_numpy(), kind="stable")))
        self.name, self.size, self.copies, self.heavy = (t.column(c).to_numpy() for c in ("id", "size", "copies", "heavy"))
        self.unsigned = self.name.astype(np.int64).view(np.uint64)
        self.tok, self.off = _flat(t.column("tokens"), np.uint64)
        self.home, self.first = _flat(t.column("homes"), np.uint32)
        self.df, _ = _flat(t.column("dfs"), np.uint32)
        self.count = np.diff(self.off)
        self.threshold, self.here, self.buckets, self.longest, self.most, self.again = threshold, here, buckets, longest, most, again
        self.lists = [_Lists(t.column("a")), _Lists(t.column("b"))]
        self.dense = 0

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The similar pairs that count here and their similarities."""
        tiles = _tiles(self.count, self.most)
        for x, (i, j) in enumerate(tiles):
            for k, z in tiles[x:]:
                if self.size[k] * self.threshold > self.size[j - 1] + 1e-9:
                    break  # sizes only grow
                met = [lists.between(i, j, k, z) for lists in self.lists]
                entries = sum(int(n.sum()) for _, _, n in met)
                if entries:
                    yield self.tile(met, entries, i, j, k, z)

    def tile(self, met: list, entries: int, i: int, j: int, k: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = np.unique(np.concatenate([w for w, _, _ in met]))
        right = np.unique(np.concatenate([x.who[(x.who >= k) & (x.who < z)] for x in self.lists]))
        sets = np.union1d(left, right)
        held = int(self.count[sets].sum())
        # In some nanoseconds: to look at entries and search the n-grams of each pair, or else to number n-grams and compare bits.
        sparse = 30.0 * entries + 80.0 * min(entries, len(left) * len(right)) * self.count[left].mean()
        if sparse > 150.0 * held:
            values, number, n = np.unique(self.tok[_ranges(self.off[sets], self.count[sets])], return_inverse=True, return_counts=True)
            width = -(-int((n > 1).sum()) // 64)
            if width and width * 64 * len(sets) <= 64 * BLOCK and 2.0 * width * len(left) * len(right) < sparse:
                self.dense += 1
                return self.by_bits(left, right, sets, values, number, n, width)
        return self.by_search(met, sets)

    def counts_here(self, a: np.ndarray, b: np.ndarray, home: np.ndarray, df: np.ndarray) -> np.ndarray:
        n = _parts(df, self.longest)
        here = _place(home, n, _part(home, n, self.unsigned[a]), _part(home, n, self.unsigned[b]), self.buckets)[0] == self.here
        return here | (n > 1) if self.again else here  # pairs of long lists may meet in several places

    def by_search(self, met: list, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, found = len(self.name), np.zeros(0, np.int64)
        for need_heavy, (who, lo, n), lists in zip((False, True), met, self.lists, strict=True):
            done, x = np.concatenate([[0], np.cumsum(n)]), 0
            while x < len(who):
                y = max(x + 1, int(np.searchsorted(done, done[x] + BLOCK, side="right")) - 1)
                a, b = np.repeat(who[x:y], n[x:y]), lists.who[_ranges(lo[x:y], n[x:y])]
                ok = (self.size[a] >= self.threshold * self.size[b] - 1e-9) & (a != b)
                if need_heavy:
                    ok &= self.heavy[a] | self.heavy[b]
                found = np.union1d(found, a[ok] * m + b[ok])
                x = y
        a, b = found // m, found % m
        small = np.where(self.count[a] <= self.count[b], a, b)
        large = a + b - small
        salt = mix(np.arange(1, m + 1).astype(np.uint64))
        code = np.sort(self.tok[_ranges(self.off[sets], self.count[sets])] + np.repeat(salt[sets], self.count[sets]))
        work = np.cumsum(self.count[small])
        both, first, x = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), 0
        while x < len(a):
            y = max(x + 1, int(np.searchsorted(work, (work[x - 1] if x else 0) + BLOCK, side="right")))
            n = self.count[small[x:y]]
            end = np.cumsum(n)
            probe = self.tok[_ranges(self.off[small[x:y]], n)] + np.repeat(salt[large[x:y]], n)
            hit = np.flatnonzero(code[np.minimum(np.searchsorted(code, probe), len(code) - 1)] == probe)
            at = np.searchsorted(hit, end - n)
            both[x:y] = np.searchsorted(hit, end) - at
            first[x:y] = (np.append(hit, 0)[at] - end + n) if len(n) else 0
            x = y
        sim = both / (self.size[a] + self.size[b] - both)
        ok = (both > 0) & (sim >= self.threshold - 1e-12)
        a, b, sim = a[ok], b[ok], sim[ok]
        at = self.first[small[ok]] + first[ok]  # of a similar pair it is one of the first n-grams of both
        ok = self.counts_here(a, b, self.home[at], self.df[at])
        return a[ok], b[ok], sim[ok]

    def by_bits(self, left: np.ndarray, right: np.ndarray, sets: np.ndarray, values: np.ndarray, number: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All with all. N-grams that are among the first of no set are numbered last; the first that a similar pair shares is not of them."""
        first = np.diff(self.first)[sets]
        at = _ranges(self.first[sets], first)
        of = np.searchsorted(values, self.tok[_ranges(self.off[sets], first)])
        df, home = np.full(len(values), (1 << 32) - 1, np.uint32), np.zeros(len(values), np.uint32)
        df[of], home[of] = self.df[at], self.home[at]
        shared = np.flatnonzero(n > 1)
        shared = shared[np.lexsort((values[shared], df[shared]))]
        place = np.full(len(values), -1)
        place[shared] = np.arange(len(shared))
        column, row = place[number], np.repeat(np.arange(len(sets)), self.count[sets])
        flags = np.zeros((len(sets), width * 64), bool)
        flags[row[column >= 0], column[column >= 0]] = True
        bits = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
        del flags
        x, y = bits[np.searchsorted(sets, left)], bits[np.searchsorted(sets, right)]
        out = []
        rows = max(1, BLOCK // 4 // (width * len(right)))
        for r in range(0, len(left), rows):
            common = x[r : r + rows, None, :] & y[None, :, :]
            both = np.bitwise_count(common).sum(axis=2, dtype=np.int64)
            sim = both / (self.size[left[r : r + rows], None] + self.size[None, right] - both)
            p, q = np.nonzero((sim >= self.threshold - 1e-12) & (both > 0) & (left[r : r + rows, None] < right[None, :]))
            w = common[p, q]
            word = (w != 0).argmax(axis=1)
            w = w[np.arange(len(w)), word]
            t = shared[word * 64 + np.bitwise_count((w & (~w + np.uint64(1))) - np.uint64(1))]
            a, b = left[r + p], right[q]
            ok = self.counts_here(a, b, home[t], df[t])
            out.append((a[ok], b[ok], sim[p, q][ok]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matched(threshold: float, mode: str, buckets: int):
    """Of a place's pairs those that are similar: all ('pairs'); as many as connect what all connect ('forest'); or these, and for each set how many
    documents its partners have (links, with b null: 'classes')."""

    def reduce(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        met = _Met(t, threshold, key[0].as_py(), buckets, LIST, VERIFIED, mode == "forest")
        name, links, root = met.name, np.zeros(len(met.name), np.int64), np.arange(len(met.name))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a, b, sim in met.pairs():
            links += np.bincount(a, met.copies[b], len(name)).astype(np.int64) + np.bincount(b, met.copies[a], len(name)).astype(np.int64)
            if mode == "pairs":
                out.append((a, b, sim))
                continue
            for x in range(0, len(a), 20_000):  # what is connected by now is left out, without a step a pair
                c, d, s = a[x : x + 20_000], b[x : x + 20_000], sim[x : x + 20_000]
                new = root[c] != root[d]
                if new.any():
                    c, d, s = c[new], d[new], s[new]
                    keep = spanning(root[c], root[d], len(name))
                    out.append((c[keep], d[keep], s[keep]))
                    root = _roots(root, root[c[keep]], root[d[keep]])
        a, b, sim = (np.concatenate(c) for c in zip(*out, strict=True))
        swap = name[a] > name[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        made = pa.table({"a": pa.array(name[a], pa.int64()), "b": pa.array(name[b], pa.int64()), "jaccard": pa.array(sim, pa.float64()), "links": pa.nulls(len(a), pa.int64())})
        if mode != "classes":
            return made
        some = np.flatnonzero(links)
        return pa.concat_tables([made, pa.table({"a": pa.array(name[some], pa.int64()), "b": pa.nulls(len(some), pa.int64()), "jaccard": pa.nulls(len(some), pa.float64()), "links": pa.array(links[some])})])

    return reduce


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after the roots a[i] and b[i] are connected, in trees."""
    up = np.arange(len(root))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        up[max(x, y)] = min(x, y)
    while (up[up] != up).any():
        up = up[up]
    return up[root]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of edges that connect what all edges connect."""
    up, keep = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def _found(docs: DataFrame, n: int, threshold: float, mode: str, light: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What _matched gives (a, b, jaccard, links); the documents (id, name of the set); the sets (name, copies, rep: the least of their documents)."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = texts_of(docs).where("text is not null and doc_id is not null")
    first = written(_first_pass(docs, n), "jaccard-first")
    of = _documents(first)
    stats = of.groupBy("name").agg(F.count("*").alias("copies"), F.min("id").alias("rep"))
    shared = _postings(docs, n, parts, _hot(first)).groupBy("key").applyInArrow(_shared(parts), BLOBS)
    sets = written(shared.groupBy("key").applyInArrow(_survivors(threshold), SETS), "jaccard-sets")
    light = boundary(sets) if light is None else light
    kinds = "a bigint, b bigint, jaccard double, links bigint"
    if mode == "forest" and (linked := _stars(sets, threshold)):
        pairs, stars, plan = linked
        met = _keys(sets.join(stars, "id", "left").withColumns({"copies": F.lit(1).cast("bigint"), "star": F.coalesce("least", "id")}), light, parts * 4, plan)
        return met.groupBy("key").applyInArrow(_matched(threshold, mode, parts * 4), kinds).unionByName(pairs), of, stats
    met = _keys(sets.join(stats.select(F.col("name").alias("id"), "copies"), "id").withColumn("star", F.col("id")), light, parts * 4)
    return met.groupBy("key").applyInArrow(_matched(threshold, mode, parts * 4), kinds), of, stats


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, forest: bool = False, light: float | None = None) -> DataFrame:
    """left_id < right_id, jaccard: the pairs of the least documents of two sets, and each other document of a set with its least. forest: of the pairs of sets
    that are found in one place, only as many as connect the same documents. light: the boundary, else it's the one of least cost."""
    true, of, stats = _found(docs, n, threshold, "forest" if forest else "pairs", light)
    rep = stats.select("name", "rep")
    near = true.join(rep.select(F.col("name").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("name").alias("b"), F.col("rep").alias("y")), "b")
    near = near.where("x <> y").groupBy(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).agg(F.max("jaccard").alias("jaccard"))
    same = of.join(rep, "name").where("id <> rep").select(F.col("rep").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("jaccard"))
    return near.withColumn("jaccard", F.round("jaccard", 6)).unionByName(same)


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, light: float | None = None) -> DataFrame:
    """A row for each document with a doc_id: doc_id, class_id (the least doc_id of those that links connect it with, itself among them) and n_links, how many other
    documents it is similar to, copies and near copies. Documents without a word have no link. Work and rows for copies are in proportion to their number."""
    true, of, stats = _found(docs, n, threshold, "classes", light)
    true = written(true, "jaccard-classes")
    of, stats = written(of.select("id", "name"), "jaccard-docs"), written(stats, "jaccard-stats")
    rep = stats.select("name", "rep")
    edges = true.where("b is not null").join(rep.select(F.col("name").alias("a"), F.col("rep").alias("left_id")), "a").join(rep.select(F.col("name").alias("b"), F.col("rep").alias("right_id")), "b")
    least = components(edges).select(F.col("id").alias("rep"), "least")
    links = true.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))
    sets = stats.join(links, "name", "left").join(least, "rep", "left")
    sets = sets.select("name", F.coalesce("least", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = of.join(sets, "name").select(F.col("id").alias("doc_id"), "class_id", "n_links")
    rest = texts_of(docs).where("doc_id is not null").select("doc_id").distinct().join(of.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    return linked.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


def components(pairs: DataFrame) -> DataFrame:
    """id and the least id that pairs connect it with, by alternating stars: every node points its larger
    neighbours, then its smaller ones, to the least."""
    edges = written(pairs.select(F.greatest("left_id", "right_id").alias("u"), F.least("left_id", "right_id").alias("v")).where("u <> v").distinct(), "edges")
    before = _sum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, "edges")
        now = _sum(after)
        if now == before:
            return after.select(F.col("u").alias("id"), F.col("v").alias("least"))
        edges, before = after, now


def _sum(edges: DataFrame) -> tuple:
    """Tells whether two sets of edges are the same."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, without those whose doc_id is connected with a lesser one. Of rows that repeat a doc_id and text one stays;
    rows without a doc_id stay."""
    gone = written(components(join(docs, n, threshold, forest=True)).select(F.col("id").alias("gone")), "gone")
    names = docs.columns
    d = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names that differ in case only don't clash
    key, text = (F.col(f"c{names.index(k)}") for k in ("doc_id", "text"))
    few = gone.count() <= IDS_AT_ONCE  # then no text is shuffled
    left = d.join(F.broadcast(gone) if few else gone, key.cast("bigint") == F.col("gone"), "left_anti")
    twice = written(d.where(key.isNotNull()).groupBy(key.alias("k"), F.xxhash64(text).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("k", "h"), "repeated")
    many = twice.count()
    if not many:
        return left.toDF(*names)
    repeated = (key == F.col("k")) & (F.xxhash64(text) == F.col("h"))
    of = F.broadcast(twice) if many <= IDS_AT_ONCE else twice
    copies = left.join(of, repeated, "left_semi")
    copy = F.row_number().over(Window.partitionBy(key, F.xxhash64(text)).orderBy(F.xxhash64(text)))
    return left.join(of, repeated, "left_anti").unionByName(copies.withColumn("copy", copy).where("copy = 1").drop("copy")).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE = rf"""
with recursive w as (
    select doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from documents where doc_id is not null and text is not null
), s as (
    select distinct doc_id, list_sort(list_distinct(case when len(w) < {N} then [array_to_string(w, ' ')] else [array_to_string(w[i:i + {N - 1}], ' ') for i in range(1, len(w) - {N - 2})] end)) as grams from w where len(w) > 0
), e as materialized (
    select doc_id, len(grams) as size, unnest(grams) as gram from s
), p as materialized (
    select a.doc_id as x, b.doc_id as y from e a join e b on a.gram = b.gram and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.size, b.size having count(*) / (a.size + b.size - count(*)) >= {THRESHOLD}
), r as (
    select distinct doc_id as a, doc_id as b from documents where doc_id is not null
    union select r.a, p.y from r join p on r.b = p.x
)
select doc_id, class_id, coalesce(n, 0) as n_links
from (select a as doc_id, min(b) as class_id from r group by a) left join (select x as doc_id, count(*) as n from p group by x) using (doc_id)
"""
