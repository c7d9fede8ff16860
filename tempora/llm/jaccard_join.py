"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered by estimated frequency, those surely of one text first, then rare ones; copies count once. Documents that
share nothing in their shortest prefixes cannot link, so these prefixes deal documents out to clusters (a
star a shingle, no pairs; shingles surely of one text match nothing and aren't sent).
Inside a cluster each document lengthens its prefix as far as the estimated candidate cost falls; a pair
is verified only if it shares as many prefix shingles as the shorter of its two lengthenings asks for.
A cluster too large for one task is dealt out in blocks, each linked alone; then representatives of the
components found meet, and at last what is still apart: the largest component's blocks with the others'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table, text_slices, thrifty, without
from .components import components
from .shingles import shingle_sets

#: Cells of the frequency sketch (1 byte each): so many a document, at least and at most.
CELLS_PER_DOC, LEAST_CELLS, MOST_CELLS = 16, 1 << 16, 1 << 24
#: Bits of the filter of repeated shingles: so many a document, at least and at most. Beyond the most, fewer shingles are known to be one text's alone; nothing else changes.
BITS_PER_DOC, LEAST_BITS, MOST_BITS = 256, 1 << 20, 1 << 29
#: Bits of the filter of rows that are counted, one of each text: so many a row, at least and at most. Beyond the most, copies are counted, too.
ROW_BITS, LEAST_ROW_BITS, MOST_ROW_BITS = 16, 1 << 16, 1 << 28
#: Bits of such a filter that tasks merge at a time.
FILTER_CHUNK = 1 << 22
#: Ranges of hashes that are counted apart, at most; shingles of a range that one task counts, at SHINGLES_PER_DOC, and those that a task holds before it sends them.
MOST_RANGES, RANGE_SHINGLES, SHINGLES_PER_DOC, HELD = 1 << 16, 1 << 24, 512, 1 << 22
#: Shingles of a cluster that one task verifies; larger clusters go in blocks of half as many.
UNIT_SHINGLES = 256_000
#: Components of a cluster's blocks, the largest ones, that meet by representatives, and these of each.
MEET, REPRESENTATIVES = 32, 4
#: Members of clusters that are broadcast (about 60 bytes each) to fetch their texts; more are joined.
BROADCAST_MEMBERS = 500_000
#: Most shared prefix shingles that a pair may be asked for.
MOST_MATCHES = 8


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n with any set that links to it."""
    return -(-percent * n // 100)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def cell(s: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each hash, of so many cells (a power of 2)."""
    return (s >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def among(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether a filter has each hash, or seems to."""
    at = cell(s, len(bits) << 3)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


@dataclass
class Order:
    """The global order of shingles: those of one text alone, then by class of the sketch's cell, then by hash."""

    classes: np.ndarray
    twice: np.ndarray

    def repeated(self, s: np.ndarray) -> np.ndarray:
        """False for shingles that surely only one text has."""
        return among(self.twice, s)

    def prefix(self, s: np.ndarray, n: int) -> np.ndarray:
        """Those of the first n shingles of a sorted set that another text may have."""
        again = self.repeated(s)
        n -= len(s) - int(again.sum())
        if n <= 0:
            return s[:0]
        s = s[again]
        return s[np.argsort(self.classes[cell(s, len(self.classes))], kind="stable")[:n]]


def size_of(each: int, n: int, least: int, most: int) -> int:
    """A power of 2 above each * n, within bounds."""
    return min(most, max(least, 1 << (each * n).bit_length()))


def counted_rows(texts: DataFrame, docs: int) -> np.ndarray:
    """A filter of the keys of one row at least of each distinct text; texts (doc_id, text, h, key), docs rows."""
    bits = size_of(ROW_BITS, docs, LEAST_ROW_BITS, MOST_ROW_BITS)
    one = texts.filter("text IS NOT NULL").groupBy("h", F.xxhash64(F.lit(1), "text").alias("g")).agg(F.min("doc_id").alias("doc_id"))

    codec, chunk = pa.Codec("zstd", 1), min(bits, FILTER_CHUNK) >> 3
    names = ["chunk", "x"]

    def row(c: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([pa.Codec("zstd", 1).compress(x.tobytes(), asbytes=True)], pa.binary())], names=names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            at = cell(batch.column(0).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(out, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        for c in range(len(out) // chunk):
            if out[c * chunk : (c + 1) * chunk].any():
                yield row(c, out[c * chunk : (c + 1) * chunk])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for c, x in zip(*(k.to_pylist() for k in batch.columns), strict=True):
                part = np.frombuffer(pa.Codec("zstd", 1).decompress(x, chunk, asbytes=True), np.uint8)
                if c != now:
                    if held is not None:
                        yield row(now, held)
                    now, held = c, part.copy()
                else:
                    held |= part
        if held is not None:
            yield row(now, held)

    schema = "chunk int, x binary"
    dealt = one.select(key_of("doc_id", "h")).mapInArrow(thrifty(mark), schema).repartition(partitions(texts.sparkSession), "chunk").sortWithinPartitions("chunk")
    total = np.zeros(bits >> 3, np.uint8)
    for r in dealt.mapInArrow(thrifty(merge), schema).toLocalIterator():  # MOST_ROW_BITS / 8 bytes at most, whatever the number of tasks
        total[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(codec.decompress(bytes(r["x"]), chunk, asbytes=True), np.uint8)
    return total


def key_of(doc_id: str, h: str) -> Column:
    return F.xxhash64(doc_id, h).alias("key")


def packed(x: np.ndarray, base: int) -> bytes:
    """Sorted numbers from base on as differences, byte by byte of these, compressed."""
    steps = np.diff(x, prepend=np.uint64(base))
    return pa.Codec("zstd", 1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int, base: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd", 1).decompress(data, 8 * n, asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(base)


def measure(texts: DataFrame) -> tuple[DataFrame, Order, np.ndarray]:
    """((doc_id, h, n, a, b) of each row: hash of its text, size and 128-bit digest of its set; the order of shingles; the filter of rows that were counted). texts (doc_id, text, h, key).

    One pass over the texts once the rows to count are known, of copies one. Each task sends its sets'
    shingles, cut to as many bits as tell nearly all apart, packed by range of hashes (some 2 bytes each);
    one task counts a range and keeps a filter and a sketch of those met twice or more. So these depend on
    what is repeated, not on the input's size: MOST_BITS / 8 and MOST_CELLS bytes at most. The number of ranges
    follows the number of documents, so that a task's range stays at some RANGE_SHINGLES.
    """
    docs, shuffled = texts.count(), partitions(texts.sparkSession)
    cells, bits = size_of(CELLS_PER_DOC, docs, LEAST_CELLS, MOST_CELLS), size_of(BITS_PER_DOC, docs, LEAST_BITS, MOST_BITS)
    wide = min(56, max(32, (docs << 15).bit_length()))  # 64 cells a shingle at 512 of them a document
    ranges = min(MOST_RANGES, 1 << (max(shuffled, docs * SHINGLES_PER_DOC // RANGE_SHINGLES) - 1).bit_length())
    below = wide - (ranges.bit_length() - 1)  # bits of a hash within its range
    counted = counted_rows(texts, docs)
    known = texts.sparkSession.sparkContext.broadcast(counted)
    names = ["doc_id", "h", "n", "a", "b", "part", "x"]

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.sort(np.concatenate(held)) >> np.uint64(64 - wide)
        at = np.searchsorted(flat, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(below))
        some = np.flatnonzero(np.diff(at))
        x = [packed(flat[at[c] : at[c + 1]], c << below) for c in some.tolist()]
        none = pa.nulls(len(x), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(np.diff(at)[some], pa.int64()), none, none, pa.array(some, pa.int32()), pa.array(x, pa.binary())], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met, size = [], set(), 0
        for batch in batches:
            here = among(known.value, batch.column(3).to_numpy().view(np.uint64))
            for lo, hi, raw, off in text_slices(batch, 1):
                sets = shingle_sets(raw, off)
                keys = [digest(s) for s in sets]
                for s, key, count in zip(sets, keys, here[lo:hi].tolist(), strict=True):
                    if count and len(s) and key not in met:
                        met.add(key)
                        held.append(s)
                        size += len(s)
                m = hi - lo
                spread = pa.array(-1 - np.arange(lo, hi) % MOST_RANGES, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, m), batch.column(2).slice(lo, m), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), spread, pa.nulls(m, pa.binary())], names=names)
                if size >= HELD:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            times = np.diff(first, append=len(x))
            x, times = x[first[times > 1]] - np.uint64(at << below), times[times > 1]
            marks, classes = np.zeros(bits // ranges, bool), np.zeros(cells // ranges, np.uint8)
            marks[(x >> np.uint64(wide - (bits.bit_length() - 1))).astype(np.int64)] = True
            np.maximum.at(classes, (x >> np.uint64(wide - (cells.bit_length() - 1))).astype(np.int64), np.minimum(255, np.log2(times) * 7).astype(np.uint8))
            both = np.packbits(marks, bitorder="little").tobytes() + classes.tobytes()
            none = pa.nulls(1, pa.int64())
            return pa.RecordBatch.from_arrays([none] * 5 + [pa.array([at], pa.int32()), pa.array([pa.Codec("zstd", 1).compress(both, asbytes=True)], pa.binary())], names=names)

        for batch in batches:
            docs = int(np.searchsorted(batch.column(5).to_numpy(), 0))
            if docs:
                yield batch.slice(0, docs)
            for n, c, x in zip(*(batch.column(k).slice(docs).to_pylist() for k in (2, 5, 6)), strict=True):
                if c != at:
                    if held:
                        yield done()
                    at, held = c, []
                held.append(unpacked(x, n, c << below))
        if held:
            yield done()

    schema = "doc_id long, h long, n long, a long, b long, part int, x binary"
    dealt = texts.mapInArrow(thrifty(read), schema).repartition(shuffled, "part").sortWithinPartitions("part")
    rows = cut(dealt.mapInArrow(thrifty(add), schema))
    classes, twice, codec = np.zeros(cells, np.uint8), np.zeros(bits >> 3, np.uint8), pa.Codec("zstd", 1)
    w, v = (bits >> 3) // ranges, cells // ranges
    for r in rows.filter("part >= 0").select("part", "x").coalesce(8).toLocalIterator():
        both = np.frombuffer(codec.decompress(bytes(r["x"]), w + v, asbytes=True), np.uint8)
        twice[r["part"] * w : (r["part"] + 1) * w], classes[r["part"] * v : (r["part"] + 1) * v] = both[:w], both[w:]
    return rows.filter("part < 0").select("doc_id", "h", "n", "a", "b"), Order(classes, twice), counted


def star_edges(texts: DataFrame, order: Order, counted: np.ndarray, percent: int) -> DataFrame:
    """(a, b) edges from each shingle of shortest prefixes' least set to its others, sets named by the first 64 bits of their digests; texts (text, key), of which rows outside the filter counted are copies of others.

    Sets that share these bits by chance only make a cluster larger. A batch already joins what its
    documents share and sends a single posting a shingle on, and none for copies; so a shingle or set
    that very many documents have takes a few rows a task.
    """
    spark = texts.sparkSession
    known, rows = spark.sparkContext.broadcast(order), spark.sparkContext.broadcast(counted)
    names = ["tok", "a", "b"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(among(rows.value, batch.column(1).to_numpy().view(np.uint64))))
            prefixes: dict[int, np.ndarray] = {}
            for _, _, raw, off in text_slices(batch, 0):
                for s in shingle_sets(raw, off):
                    if len(s) and (key := digest(s)[0]) not in prefixes:
                        prefixes[key] = known.value.prefix(s, len(s) - needed(len(s), percent) + 1)
            if not any(map(len, prefixes.values())):
                continue
            key = np.array(sorted(prefixes), np.int64)
            tok = np.concatenate([prefixes[k] for k in key.tolist()]).view(np.int64)
            doc = np.repeat(np.arange(len(key)), [len(prefixes[k]) for k in key.tolist()])
            by = np.argsort(tok, kind="stable")  # in a run of one shingle the least set comes first
            tok, doc = tok[by], doc[by]
            first = np.append(True, tok[1:] != tok[:-1])
            lead = doc[np.maximum.accumulate(np.where(first, np.arange(len(tok)), 0))]
            pair = np.unique(doc[~first] * len(key) + lead[~first])
            x, y = key[pair // len(key)], key[pair % len(key)]
            cols = [np.append(tok[first], x), np.append(key[doc[first]], x), np.append(np.zeros(first.sum(), np.int64), y)]
            for lo in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in cols], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tok, open_a = None, None  # the last run, which the next batch may go on with
        for batch in batches:
            tok, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            done = b != 0
            out = [np.stack([a[done], b[done]])]
            tok, a = tok[~done], a[~done]
            if len(tok):
                first = np.append(True, tok[1:] != tok[:-1])
                lead = a[np.maximum.accumulate(np.where(first, np.arange(len(tok)), 0))]
                if tok[0] == open_tok:
                    n = int(np.argmin(np.append(tok == open_tok, False)))
                    lead[:n], first[0] = open_a, False
                out.append(np.stack([a, lead])[:, ~first])
                open_tok, open_a = tok[-1], lead[-1]
            got = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(got[:, got[0] != got[1]], axis=1)], names=names[1:])

    dealt = texts.mapInArrow(thrifty(emit), "tok long, a long, b long").repartition(partitions(spark), "tok").sortWithinPartitions("tok", "a")
    return dealt.mapInArrow(thrifty(join), "a long, b long")


def lengthen(df: np.ndarray, spare: int) -> int:
    """The number of matches to ask for, given the frequencies of a set's shingles (rare first) and its shortest prefix's length.

    With l matches the prefix is l - 1 longer; at most the sum of its frequencies over l sets can match l
    times. Scanning postings costs 1 each, verifying a candidate as much as the set's size.
    """
    most = min(MOST_MATCHES, len(df) - spare + 1)
    lists = np.cumsum(df)[spare - 1 : spare - 1 + most]
    cost = lists + lists / np.arange(1, most + 1) * len(df)
    return int(np.argmin(cost)) + 1


def link(sets: list[np.ndarray], side: np.ndarray | None, percent: int, known: np.ndarray | None = None, pairs: list[tuple[int, int, int]] | None = None) -> tuple[np.ndarray, int, int]:
    """(root of each set, pairs verified, links found that joined two components), roots being indexes.

    side: where given, only pairs of different sides are compared. A pair whose sets are in one component
    already needs no verification; known: the first set of each one's component, if some are known.
    pairs: where given, all candidates are verified and every link (set, set, shared shingles) is added.
    """
    m, size = len(sets), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, local, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    order = np.lexsort((local, count[local], owner))  # in each set by frequency here
    local, start = local[order], np.append(0, np.cumsum(size))
    place = np.arange(len(flat)) - start[owner]
    spare = size - needed(size, percent) + 1
    ask = np.array([lengthen(count[local[start[d] : start[d + 1]]], spare[d]) for d in range(m)])
    # postings of the lengthened prefixes, by shingle, with the match number from which a posting counts
    level = np.maximum(1, place - spare[owner] + 2)
    used = (level <= ask[owner]) & (count[local] > 1)
    p_tok, p_doc, p_level = local[used], owner[used], level[used]
    by = np.argsort(p_tok, kind="stable")
    p_tok, p_doc, p_level = p_tok[by], p_doc[by], p_level[by]
    p_at = np.searchsorted(p_tok, np.arange(len(count) + 1))
    a_by = np.argsort(local, kind="stable")
    a_doc, a_at = owner[a_by], np.append(0, np.cumsum(count))
    root = np.arange(m) if known is None else known.copy()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def gather(doc: np.ndarray, at: np.ndarray, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of all postings of toks, the number of the shingle that each belongs to)."""
        n = at[toks + 1] - at[toks]
        return np.repeat(at[toks] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()), np.repeat(np.arange(len(toks)), n)

    verified = joined = 0
    for d in range(1, m):
        own = slice(start[d], start[d + 1])
        pre = used[own]
        toks, lev = local[own][pre], level[own][pre]
        pos, nth = gather(p_doc, p_at, toks)
        other = p_doc[pos]
        both = np.minimum(ask[d], ask[other])
        fits = (other < d) & (np.maximum(p_level[pos], lev[nth]) <= both)
        hits = np.bincount(other[fits], minlength=d)
        cand = np.flatnonzero(hits)
        cand = cand[hits[cand] >= np.minimum(ask[d], ask[cand])]
        cand = cand[100 * np.minimum(size[cand], size[d]) >= percent * np.maximum(size[cand], size[d])]
        if side is not None:
            cand = cand[side[cand] != side[d]]
        if not len(cand):
            continue
        mine = find(d)
        if pairs is None:
            cand = np.array([c for c in cand.tolist() if find(c) != mine])
        if not len(cand):
            continue
        every = local[own]
        if (a_at[every + 1] - a_at[every]).sum() <= 20 * size[cand].sum():
            inter = np.bincount(a_doc[gather(a_doc, a_at, every)[0]], minlength=m)[cand]
        else:
            mark = np.zeros(len(count), bool)
            mark[every] = True
            inter = np.array([np.count_nonzero(mark[local[start[c] : start[c + 1]]]) for c in cand.tolist()])
        verified += len(cand)
        linked = 100 * inter >= percent * (size[cand] + size[d] - inter)
        if pairs is not None:
            pairs += [(c, d, n) for c, n in zip(cand[linked].tolist(), inter[linked].tolist(), strict=True)]
        for c in cand[linked].tolist():
            a, b = find(c), find(d)
            if a != b:
                root[max(a, b)] = min(a, b)
                joined += 1
    return np.array([find(x) for x in range(m)]), verified, joined


def verify(members: DataFrame, percent: int, of_labels: bool = False, every: bool = False) -> DataFrame:
    """(a, b) struct edges that join linked sets, each unit's to the root of its component; members (unit, side, la, lb, a, b, text): each unit's texts, which one task takes together.

    every: instead all links, with the number of shared shingles, n.

    Sets of one side aren't compared if a unit has several; sets of one label (la, lb; null: none) are
    known to be in one component. A member may come with several texts; the one that its digest is of
    counts. of_labels: edges are of labels, not of sets.
    """

    def solve(rows: dict[tuple, None]) -> Iterator[pa.RecordBatch]:
        data = [t.encode() for *_, t in rows]
        off = np.append(0, np.cumsum([len(x) for x in data]))
        raw = np.frombuffer(b"".join(data), np.uint8)
        sets, lo = [], 0
        while lo < len(data):  # a few MB at a time
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 21), side="right")) - 1)
            sets += shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi
        found: dict[tuple[int, int], tuple] = {}
        for i, (side, la, lb, a, b, _) in enumerate(rows):
            if (a, b) not in found and digest(sets[i]) == (a, b):  # another row of the same doc_id isn't meant
                found[a, b] = (i, side, (la, lb))
        if len(found) < 2:
            return
        fine, sides, labels = zip(*found.values(), strict=True)
        first: dict[tuple, int] = {}
        known = np.array([k if x[0] is None else first.setdefault(x, k) for k, x in enumerate(labels)])
        pairs: list[tuple[int, int, int]] | None = [] if every else None
        root, _, _ = link([sets[i] for i in fine], np.array(sides) if len(set(sides)) > 1 else None, percent, known, pairs)
        key = np.array(labels if of_labels else list(found), np.int64)
        if every:
            both = np.array(pairs, np.int64).reshape(-1, 3)
            for lo in range(0, len(both), 1 << 16):
                x, y, n = both[lo : lo + (1 << 16)].T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*key[x].T, *key[y].T, n)], names=["a", "b", "la", "lb", "n"])
            return
        moved = np.flatnonzero(root != known)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*key[moved].T, *key[root[moved]].T)], names=["a", "b", "la", "lb"])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}  # rows without repeats, in order
        for batch in batches:
            for unit, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != at:
                    yield from solve(held)
                    at, held = unit, {}
                held[tuple(row)] = None
        yield from solve(held)

    dealt = members.repartition(partitions(members.sparkSession), "unit").sortWithinPartitions("unit")
    pairs = dealt.select("unit", "side", "la", "lb", "a", "b", "text").mapInArrow(thrifty(units), "a long, b long, la long, lb long" + ", n long" * every)
    return pairs.select(F.struct("a", "b").alias("a"), F.struct(F.col("la").alias("a"), F.col("lb").alias("b")).alias("b"), *["n"][: int(every)])


def hot_edges(hot: DataFrame, texts: DataFrame, first: DataFrame, percent: int, unit_shingles: int, few: bool) -> DataFrame:
    """(a, b) struct edges that, with the first ones, join all linked sets of clusters too large for a unit; hot (cluster, a, b, n), texts (a, b, text), first: edges of the blocks, each linked alone, to their roots.

    Of each cluster's largest components, representatives meet in one unit: copies become one component
    here, whatever their number. What is then outside the cluster's largest component is compared in full,
    with its blocks and with one another; pairs inside a component are skipped. few: hot may be broadcast.
    """

    def by_size(rows: DataFrame) -> DataFrame:
        """(cluster, la, lb, total, place): components of each cluster by shingles, largest first."""
        sums = rows.groupBy("cluster", "la", "lb").agg(F.sum("n").alias("total"))
        return sums.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("total"), "la", "lb")))

    def linked(dealt: DataFrame, of_labels: bool) -> DataFrame:
        sent = dealt.select("unit", "side", "la", "lb", F.col("a").alias("ta"), F.col("b").alias("tb"))
        both = texts.join(F.broadcast(sent) if few else sent, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")))
        return cut(verify(both, percent, of_labels))

    pairs = lambda edges, a, b: edges.select(F.col("a.a").alias(a + "a"), F.col("a.b").alias(a + "b"), F.col("b.a").alias(b + "a"), F.col("b.b").alias(b + "b"))
    rooted = hot.join(pairs(first, "s", "r"), (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")), "left")
    rows = cut(rooted.select(*hot.columns, F.coalesce("ra", "a").alias("la"), F.coalesce("rb", "b").alias("lb")))
    largest = by_size(rows).filter(F.col("place") <= MEET).select("cluster", "la", "lb")
    least = F.array_sort(F.collect_list(F.struct("a", "b")))  # of one block and component: sets of a unit at most
    chosen = rows.join(largest, ["cluster", "la", "lb"]).groupBy("cluster", "la", "lb").agg(F.slice(least, 1, REPRESENTATIVES).alias("r"))
    met = linked(chosen.select(F.col("cluster").alias("unit"), F.lit(0).alias("side"), "la", "lb", F.explode("r").alias("r")).select("unit", "side", "la", "lb", "r.a", "r.b"), True).distinct()
    again = rows.join(pairs(met, "s", "r"), (F.col("la") == F.col("sa")) & (F.col("lb") == F.col("sb")), "left")
    rows = cut(again.select(*hot.columns, F.coalesce("ra", "la").alias("la"), F.coalesce("rb", "lb").alias("lb")))
    # blocks 0 to x - 1 hold what is outside the largest component, x to x + g - 1 that one
    sizes = cut(by_size(rows))
    blocks = lambda total: F.ceil(F.coalesce(F.sum(total), F.lit(0)) * 2 / unit_shingles).cast("int")
    counts = sizes.groupBy("cluster").agg(blocks(F.when(F.col("place") > 1, F.col("total"))).alias("x"), blocks(F.when(F.col("place") == 1, F.col("total"))).alias("g")).filter("x > 0")
    if counts.isEmpty():
        return met
    places = rows.join(sizes.filter("place = 1").select("cluster", F.col("la").alias("ga"), F.col("lb").alias("gb")), "cluster").join(counts, "cluster")
    within = (F.col("la") == F.col("ga")) & (F.col("lb") == F.col("gb"))
    side = F.when(within, F.col("x") + F.pmod(F.col("b"), F.col("g"))).otherwise(F.pmod(F.col("b"), F.col("x"))).cast("int")
    others = F.explode(F.when(within, F.sequence(F.lit(0), F.col("x") - 1)).otherwise(F.sequence(F.lit(0), F.col("x") + F.col("g") - 1)))
    dealt = places.withColumn("side", side).withColumn("j", others).withColumn("unit", F.xxhash64("cluster", F.least("side", "j"), F.greatest("side", "j")))
    return met.unionByName(linked(dealt, False))


def clusters(docs: DataFrame, percent: int, unit_shingles: int, broadcast_members: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """(rows (doc_id, h, n, a, b) of all documents; sets (a, b, doc_id, h, n), each by one of its rows; members of clusters, sets that may link, with the block of a large one's; the members with their texts; whether members may be broadcast)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    keyed = texts.withColumn("key", key_of("doc_id", "h"))
    rows, order, counted = measure(keyed)
    # each set by one of its rows: that of the smallest doc_id (null last), then of the smallest hash of its text
    named_by = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("row")
    sets = cut(rows.filter("n > 0").groupBy("a", "b").agg(named_by, F.first("n").alias("n")).select("a", "b", "row.doc_id", "row.h", "n"))
    near = components(star_edges(keyed.select("text", "key"), order, counted, percent))  # nodes are the first halves of digests
    # clusters of sets that may link, with the number of blocks that each is dealt out in
    nodes = near.select(F.col("node").alias("a"), "root").unionByName(near.select(F.col("root").alias("a"), "root").distinct())
    at = cut(nodes.join(sets, "a"))
    blocks = at.groupBy("root").agg(F.sum("n").alias("total")).select("root", F.when(F.col("total") <= unit_shingles, 1).otherwise(F.ceil(F.col("total") * 2 / unit_shingles)).cast("int").alias("blocks"))
    block = F.when(F.col("blocks") > 1, F.pmod(F.col("b"), F.col("blocks"))).cast("int").alias("block")
    members = cut(at.join(blocks, "root").select(F.col("doc_id").alias("id"), F.col("h").alias("of"), "a", "b", "n", F.xxhash64("root").alias("cluster"), block, "blocks"))
    few = members.count() <= broadcast_members
    texts_of = texts.filter("text IS NOT NULL").join(F.broadcast(members) if few else members, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("of")))
    return rows, sets, members, texts_of, few


def jaccard_links(docs: DataFrame, percent: int = 80, unit_shingles: int = UNIT_SHINGLES, broadcast_members: int = BROADCAST_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(links (a, b, shared, total), membership (doc_id, set_id, n_shingles)) of docs (doc_id, text): every link between different sets, none skipped.

    A link joins two sets, by set_id (a string), a < b, with the sizes of their intersection and union,
    100 * shared >= percent * total. membership has a row for each row of docs; rows of one set_id have
    equal sets, and link with one another and with all that their set links with. Rows without shingles
    have a null set_id and link with nothing. Texts, nulls and repeated rows are as in jaccard_components.
    A cluster too large for a unit is dealt out in pairs of blocks, each of which compares what shares
    enough of its lengthened prefixes: the work grows with the pairs that there are, which are as many as
    the square of a group of near copies that all differ.
    """
    rows, sets, _, texts_of, _ = clusters(docs, percent, unit_shingles, broadcast_members)
    k, last = F.coalesce("block", F.lit(0)), F.col("blocks") - 1
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    dealt = texts_of.select("text", "a", "b", "cluster", k.alias("k"), other)
    null = F.lit(None).cast("long")
    # of two blocks each is a side; a block with itself is one
    units = dealt.select("text", "a", "b", F.xxhash64("cluster", F.least("k", "other"), F.greatest("k", "other")).alias("unit"), F.when(F.col("k") > F.col("other"), 1).otherwise(0).alias("side"), null.alias("la"), null.alias("lb"))
    found = verify(units, percent, every=True)
    name = lambda a, b: F.concat(F.hex(a), F.lit("-"), F.hex(b))
    size = sets.select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("n").alias("size"))
    for side in ("a", "b"):
        found = found.join(size, (F.col(f"{side}.a") == F.col("sa")) & (F.col(f"{side}.b") == F.col("sb"))).drop("sa", "sb").withColumnRenamed("size", f"n_{side}")
    x, y = name("a.a", "a.b"), name("b.a", "b.b")
    links = found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col("n").alias("shared"), (F.col("n_a") + F.col("n_b") - F.col("n")).alias("total"))
    return cut(links), rows.select("doc_id", F.when(F.col("n") > 0, name("a", "b")).alias("set_id"), F.col("n").alias("n_shingles"))


def link_counts(docs: DataFrame, percent: int = 80, **more: int) -> DataFrame:
    """(doc_id, n_shingles, n_links long) of each row of docs: the other rows that it links with, those of an equal set included."""
    links, membership = jaccard_links(docs, percent, **more)
    size = cut(membership.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies")))
    both = links.select(F.col("a").alias("set_id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("set_id"), F.col("a").alias("other")))
    near = both.join(size.select(F.col("set_id").alias("other"), "copies"), "other").groupBy("set_id").agg(F.sum("copies").alias("near"))
    total = size.join(near, "set_id", "left").select("set_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return membership.join(total, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, percent: int = 80, unit_shingles: int = UNIT_SHINGLES, broadcast_members: int = BROADCAST_MEMBERS) -> DataFrame:
    """(doc_id, n_shingles long, component_id long) of each row of docs (doc_id, text).

    Texts link when their sets of five-word shingles (A-Z lower-cased, ASCII white space between words;
    a text of fewer words is one shingle) have a Jaccard index of percent / 100 or more; equal sets
    always do. component_id is the smallest doc_id that links lead to. Null, empty and blank texts have
    no shingle and link with nothing: component_id is their own doc_id. Rows of one doc_id are texts of
    their own. A null doc_id never names a component unless all of it are null. An empty table gives no
    rows; columns but these two are not looked at.
    """
    rows, sets, members, texts_of, few = clusters(docs, percent, unit_shingles, broadcast_members)
    # each cluster, and each block of a large one, is a unit
    alone = texts_of.select("text", "a", "b", F.when(F.col("block").isNull(), F.col("cluster")).otherwise(F.xxhash64("cluster", "block")).alias("unit"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("la"), F.lit(None).cast("long").alias("lb"))
    joined = cut(verify(alone, percent))
    large = members.filter("block IS NOT NULL")
    if large.isEmpty():  # each cluster in one unit: its edges lead to roots already
        found = joined.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        hot = cut(texts_of.filter("block IS NOT NULL").select("a", "b", "text"))
        found = components(joined.unionByName(hot_edges(large.select("cluster", "a", "b", "n"), hot, joined, percent, unit_shingles, few)))
    roots = found.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("root.a").alias("ra"), F.col("root.b").alias("rb"))
    named = sets.join(roots, ["a", "b"], "left").select("a", "b", "doc_id", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    least = named.groupBy("ra", "rb").agg(F.min("doc_id").alias("component_id"))
    classes_of = cut(named.join(least, ["ra", "rb"]).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "component_id"))
    out = rows.join(classes_of, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, in the manner of jaccard_components."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs that share a shingle, then what links reach from each document; for small tables.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
),
links AS (
  SELECT x, y FROM shared JOIN sizes nx ON nx.doc_id = x JOIN sizes ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)
),
reached AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.other = l.x
),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
"""


def keep_one(docs: DataFrame, percent: int = 80, broadcast_members: int = BROADCAST_MEMBERS) -> DataFrame:
    """docs less all but the smallest doc_id of each group of linked texts; documents that link with nothing stay.

    Rows of one doc_id stay or go together; those of null doc_id stay.
    """
    found = jaccard_components(docs.select("doc_id", "text"), percent)
    gone = cut(found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_members else gone, F.col("doc_id") == F.col("_gone"), "left_anti")
