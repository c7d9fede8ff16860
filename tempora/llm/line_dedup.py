"""Line dedup: two Bloom filters for once-seen and twice-seen hashes; only suspected repeats shuffle, for exact confirmation and the choice of the document that keeps a line."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, partitions, table, text_slices, thrifty, without

#: White space that is stripped at both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"
#: Bits of a filter: so many a document, at least and at most; beyond the most, more lines are suspected, none is missed.
BITS_PER_DOC, LEAST_BITS, MOST_BITS = 256, 1 << 20, 1 << 29
PROBES = 3
CHUNK = 1 << 20
#: Confirmed repeats that are broadcast (24 bytes each); more are joined.
BROADCAST_KEYS = 1_000_000


def line_key(line: bytes, least: int) -> bytes | None:
    """The line stripped and lower-cased, if it has at least so many code points."""
    if len(line) < least:
        return None
    key = line.strip(SPACE).lower()  # bytes.lower() turns A-Z only
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode()) < least):
        return None
    return key


def doc_keys(text: bytes, least: int) -> set[bytes]:
    return {k for x in text.split(b"\n") if (k := line_key(x, least)) is not None}


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers of each hash, one row a probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1) for i in range(PROBES)]).astype(np.int64)


def seen(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def add(filter_: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def batch_hashes(b: pa.RecordBatch, column: int, least: int) -> Iterator[np.ndarray]:
    """Hashes of each document's distinct keys, slice by slice."""
    for lo, hi, raw, off in text_slices(b, column):
        data = raw.tobytes()
        found = [xxhash.xxh3_64_intdigest(k) for i in range(hi - lo) for k in doc_keys(data[off[i] : off[i + 1]], least)]
        yield np.array(found, dtype=np.uint64)


def twice_filter(texts: DataFrame, bits: int, least: int) -> bytes:
    """The twice-seen filter of all documents: each task fills its own pair, and equal chunks of all pairs are merged.

    Merging two pairs, a bit is seen twice if either has it so or both have it once; a key of two
    documents is thus always suspected.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for b in batches:
            for h in batch_hashes(b, 0, least):
                keys, n = np.unique(h, return_counts=True)
                at = slots(keys, bits)
                again = seen(once, at) | (n > 1)
                add(twice, at[:, again])
                add(once, at)
        codec = pa.Codec("zstd", 1)
        for c in range(max(1, bits // CHUNK)):
            x, y = once[c * CHUNK >> 3 : (c + 1) * CHUNK >> 3], twice[c * CHUNK >> 3 : (c + 1) * CHUNK >> 3]
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([codec.compress(x.tobytes(), asbytes=True)], pa.binary()), pa.array([codec.compress(y.tobytes(), asbytes=True)], pa.binary())], names=["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, n, at, once, twice = pa.Codec("zstd", 1), min(CHUNK, bits) >> 3, None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([codec.compress(twice.tobytes(), asbytes=True)], pa.binary())], names=["chunk", "twice"])
        for b in batches:
            for c, x, y in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if c != at:
                    if at is not None:
                        yield done()
                    at, once, twice = c, np.zeros(n, np.uint8), np.zeros(n, np.uint8)
                x, y = (np.frombuffer(codec.decompress(v, n, asbytes=True), np.uint8) for v in (x, y))
                twice |= y | (once & x)
                once |= x
        if at is not None:
            yield done()

    parts = texts.mapInArrow(thrifty(fill), "chunk int, once binary, twice binary")
    merged = parts.repartition(partitions(texts.sparkSession), "chunk").sortWithinPartitions("chunk").mapInArrow(thrifty(merge), "chunk int, twice binary")
    whole, codec = bytearray(bits >> 3), pa.Codec("zstd", 1)
    for r in merged.collect():  # MOST_BITS / 8 bytes at most
        n = min(CHUNK, bits) >> 3
        whole[r["chunk"] * n : (r["chunk"] + 1) * n] = codec.decompress(bytes(r["twice"]), n, asbytes=True)
    return bytes(whole)


def suspects(texts: DataFrame, filter_: Broadcast, bits: int, least: int) -> DataFrame:
    """(key, n, last): digests of suspected keys, with the documents and the largest doc_id of a batch that have them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            ids = b.column(1).to_pylist()
            count: dict[bytes, list] = {}
            for lo, hi, raw, off in text_slices(b, 0):
                data = raw.tobytes()
                keys = [(k, i) for i in range(hi - lo) for k in doc_keys(data[off[i] : off[i + 1]], least)]
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k, _ in keys], dtype=np.uint64)
                for j in np.flatnonzero(seen(twice, slots(hashes, bits))) if keys else ():
                    k, i = keys[j]
                    x, doc = count.setdefault(k, [0, None]), ids[lo + i]
                    x[0] += 1
                    x[1] = doc if x[1] is None or doc is not None and doc > x[1] else x[1]
            if count:
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(k, digest_size=16).digest() for k in count], pa.binary()), pa.array([x[0] for x in count.values()], pa.int64()), pa.array([x[1] for x in count.values()], pa.int64())], names=["key", "n", "last"])

    return texts.mapInArrow(thrifty(find), "key binary, n long, last long")


def line_dedup(docs: DataFrame, least: int = 20, min_docs: int = 3, broadcast_keys: int = BROADCAST_KEYS, most_bits: int = MOST_BITS) -> DataFrame:
    """docs with text less its repeated lines, n_lines long (before) and n_dropped long.

    Keys (stripped, A-Z lower-cased) of at least `least` code points that min_docs documents hold lose
    all their lines but in the largest doc_id that holds one; min_docs is 2 or more. Lines of other
    keys stay. Null text counts as one empty line and becomes empty. Rows of the same doc_id are
    documents of their own when counting and keep or lose alike; null doc_id is below all others.
    A document may become empty; none goes. Columns called n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    bits = min(most_bits, max(LEAST_BITS, 1 << (BITS_PER_DOC * docs.count()).bit_length()))
    filter_ = spark.sparkContext.broadcast(twice_filter(texts.select("text"), bits, least))
    found = suspects(texts, filter_, bits, least)
    repeats = cut(found.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= min_docs).select("key", "last"))
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema]
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds) + ", n_lines long, n_dropped long"
    at_text, at_id = docs.columns.index("text"), docs.columns.index("doc_id")

    def rebuilt(b: pa.RecordBatch, new: list, lines: list, dropped: list) -> pa.RecordBatch:
        cols = [pa.array(new, pa.binary()).cast(pa.string()) if i == at_text else b.column(i) for i in range(len(kinds))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*(n for n, _ in kinds), "n_lines", "n_dropped"])

    if repeats.count() <= broadcast_keys:
        got = repeats.toArrow()
        known = spark.sparkContext.broadcast(dict(zip(got.column("key").to_pylist(), got.column("last").to_pylist(), strict=True)))

        def drop_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, twice = known.value, np.frombuffer(filter_.value, np.uint8)
            for b in batches:
                ids, new, lines, dropped = b.column(at_id).to_pylist(), [], [], []
                for lo, hi, raw, off in text_slices(b, at_text):
                    data = raw.tobytes()
                    split = [data[off[i] : off[i + 1]].split(b"\n") for i in range(hi - lo)]
                    at = [(i, j, k) for i, x in enumerate(split) for j, y in enumerate(x) if (k := line_key(y, least)) is not None]
                    hashes = np.array([xxhash.xxh3_64_intdigest(k) for _, _, k in at], dtype=np.uint64)
                    gone: dict[int, set] = {}
                    for s in np.flatnonzero(seen(twice, slots(hashes, bits))) if at else ():
                        i, j, k = at[s]
                        d = hashlib.blake2b(k, digest_size=16).digest()
                        if d in last and last[d] != ids[lo + i]:
                            gone.setdefault(i, set()).add(j)
                    for i, x in enumerate(split):
                        g = gone.get(i)
                        new.append(b"\n".join([y for j, y in enumerate(x) if j not in g]) if g else data[off[i] : off[i + 1]])
                        lines.append(len(x))
                        dropped.append(len(g) if g else 0)
                yield rebuilt(b, new, lines, dropped)

        return docs.mapInArrow(thrifty(drop_known), schema)

    # more repeats than may be broadcast: each document gets its own list by a join
    def with_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            ids = b.column(1).to_pylist()
            for lo, hi, raw, off in text_slices(b, 0):
                data = raw.tobytes()
                keys = [(k, i) for i in range(hi - lo) for k in doc_keys(data[off[i] : off[i + 1]], least)]
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k, _ in keys], dtype=np.uint64)
                hit = [keys[j] for j in np.flatnonzero(seen(twice, slots(hashes, bits)))] if keys else []
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(k, digest_size=16).digest() for k, _ in hit], pa.binary()), pa.array([ids[lo + i] for _, i in hit], pa.int64())], names=["key", "doc"])

    (gone_col, doc_col) = fresh(docs, "_gone", "_doc")
    held = texts.mapInArrow(thrifty(with_docs), "key binary, doc long").join(repeats, "key").filter(~F.col("doc").eqNullSafe(F.col("last")))
    gone_by_doc = held.groupBy(F.col("doc").alias(doc_col)).agg(F.collect_set("key").alias(gone_col))
    joined = docs.join(gone_by_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(doc_col)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone_col)

    def drop_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, new, lines, dropped = b.column(len(kinds)).to_pylist(), [], [], []
            for lo, hi, raw, off in text_slices(b, at_text):
                data = raw.tobytes()
                for i in range(hi - lo):
                    g, x = set(gone[lo + i] or ()), data[off[i] : off[i + 1]].split(b"\n")
                    kept = [y for y in x if not g or (k := line_key(y, least)) is None or hashlib.blake2b(k, digest_size=16).digest() not in g]
                    new.append(b"\n".join(kept))
                    lines.append(len(x))
                    dropped.append(len(x) - len(kept))
            yield rebuilt(b, new, lines, dropped)

    return joined.mapInArrow(thrifty(drop_listed), schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document, in the manner of line_dedup."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: A document holds a key once however often it repeats it; rows of one doc_id are documents of their own.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, p, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (
    SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p
    FROM docs
  )
),
repeats AS (
  SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3
),
marked AS (
  SELECT l.r, l.doc_id, l.p, l.line, r.k IS NOT NULL AND r.keep IS DISTINCT FROM l.doc_id AS gone
  FROM lines l LEFT JOIN repeats r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
