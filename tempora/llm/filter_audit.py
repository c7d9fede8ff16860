"""Filter interaction audit: fingerprint-routed RDD. Texts go by xxhash to partitions that keep collision chains of full texts with their least id; counts of failure masks are merged by combineByKey."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

#: Filters by their bits; SAME is that of texts with a smaller id elsewhere.
FILTERS = "ABCDE"
SAME = 1 << FILTERS.index("E")
#: A document fails A with fewer words, B with a smaller percentage of distinct words, C with a larger percentage of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes of texts that a task holds before it hands its chains on, and that a routed partition gets on average.
HELD_BYTES, ROUTED_BYTES = 32 << 20, 64 << 20
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: (doc_id, part, mask, copies) of rows of one doc_id, text and part.
Marked = tuple[int | None, str, int, int]


def own_mask(text: str) -> int:
    """Bits of the filters that a text fails by itself: A to D."""
    data = text.encode()
    words = data.split()  # at ASCII white space
    mask = int(len(words) < LEAST_WORDS)
    mask |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    mask |= (100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)) << 2
    return mask | (len(data.translate(None, MARKS)) < len(data)) << 3


class Chains:
    """Texts by fingerprint; each with its least id and the number of its rows there in each part. Rows that turn out not to be least come back marked."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def add(self, fingerprint: int, text: bytes, mask: int, id_: int, parts: dict[str, int]) -> Iterator[Marked]:
        chain = self.by_print.setdefault(fingerprint, [])
        for link in chain:
            if link[0] == text:
                if id_ == link[2]:
                    for p, n in parts.items():
                        link[3][p] = link[3].get(p, 0) + n
                else:
                    if id_ < link[2]:
                        link[2], id_, link[3], parts = id_, link[2], parts, link[3]
                    yield from ((id_, p, mask | SAME, n) for p, n in parts.items())
                return
        chain.append([text, mask, id_, parts])
        self.held += len(text)

    def drain(self) -> Iterator[tuple[int, list]]:
        for fingerprint, chain in self.by_print.items():
            yield from ((fingerprint, link) for link in chain)
        self.by_print, self.held = {}, 0


def marked(docs: DataFrame, held_bytes: int = HELD_BYTES, routed_bytes: int = ROUTED_BYTES) -> RDD[Marked]:
    """Every document's id, part and failure mask, equal ones counted.

    Tasks chain the texts they read and send each text once, with its least id there; ids that aren't
    least go on without their text, dealt in turn, so that thousands of copies don't meet in one partition.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // routed_bytes))

    def read(rows: Iterator[Row]) -> Iterator[tuple[int, tuple]]:
        chains = Chains()
        for row, (id_, text, part) in enumerate(rows):
            text = text or ""
            mask, data = own_mask(text), text.encode()
            if id_ is None:
                yield row, (None, part, mask, 1)
                continue
            for m in chains.add(xxhash.xxh3_64_intdigest(data), data, mask, id_, {part: 1}):
                yield row, m
            if chains.held > held_bytes:
                yield from chains.drain()
        yield from chains.drain()

    def settle(records: Iterator[tuple[int, tuple | list]]) -> Iterator[Marked]:
        chains = Chains()
        for fingerprint, x in records:
            if isinstance(x, list):
                yield from chains.add(fingerprint, *x)
            else:
                yield x
        for _, (_, mask, id_, parts) in chains.drain():
            yield from ((id_, p, mask, k) for p, k in parts.items())

    rows = docs.select("doc_id", "text", F.coalesce(F.col("source"), F.lit(""))).rdd
    return rows.mapPartitions(read).partitionBy(n, int).mapPartitions(settle)


def mask_counts(rows: DataFrame) -> RDD[tuple[str, np.ndarray]]:
    """Of each part a table of counts, one row a mask: documents, good ones, toxic ones; rows: part, mask, copies, good, toxic."""

    def add(v: np.ndarray, x: tuple) -> np.ndarray:
        mask, copies, good, toxic = x
        v[mask] += (copies, copies * good, copies * toxic)
        return v

    first = lambda x: add(np.zeros((1 << len(FILTERS), 3), np.int64), x)
    return rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4]))).combineByKey(first, add, lambda a, b: a + b)


def interactions(counts: np.ndarray) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of the filters, from the counts of masks."""
    masks = np.arange(len(counts))
    out, share = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, gone = masks & bit > 0, masks & before > 0
            removed = counts[fails & ~gone].sum(axis=0)
            before |= bit
            kept = counts[masks & before == 0, 0].sum()
            out.append(("".join(order), step, int(kept), int(removed[0]), int(counts[fails & gone, 0].sum()), int(counts[bit, 0]), int(removed[1]), int(removed[2])))
            share[letter] += int(removed[0])
    return [(*row, share[row[0][row[1] - 1]]) for row in out]


def audit(docs: DataFrame, labels: DataFrame, held_bytes: int = HELD_BYTES, routed_bytes: int = ROUTED_BYTES) -> DataFrame:
    """What each filter does in each order and place, for each part (source): columns of AUDIT.

    Filters and counts are those of the query below; docs needs doc_id, text and source, and other
    columns are ignored. Null text is empty; null source is the part ''. E fails where the same text has
    a smaller doc_id; rows of one doc_id and text don't fail each other, and a null doc_id neither fails
    nor makes others fail. A document is good or toxic if any row of labels for its doc_id says 1. An
    empty table gives no row. A partition holds its distinct texts, some routed_bytes on average.
    """
    spark = docs.sparkSession
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = spark.createDataFrame(marked(docs, held_bytes, routed_bytes), "doc_id long, part string, mask int, copies long", verifySchema=False)
    rows = rows.join(known, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "copies", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    return spark.createDataFrame(mask_counts(rows).flatMap(lambda x: [(x[0], *r) for r in interactions(x[1])]), AUDIT, verifySchema=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley over whole documents: 600 rows a part."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(docs.t, '[^A-Z]', '', 'g')) > 2 * length(docs.t),
     'D': regexp_matches(docs.t, '[#$%&*|]'), 'E': coalesce(docs.doc_id > first_id, false)} AS f
  FROM docs JOIN least ON docs.t = least.t LEFT JOIN known ON docs.doc_id = known.doc_id),
masks AS (SELECT part, [f.A, f.B, f.C, f.D, f.E] AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL),
letter AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o, row_number() OVER () AS id FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT id, o, s.k AS step, o[s.k] AS filter FROM orders, letter s),
counted AS (
  SELECT part, id, o, step, filter,
    sum(CASE WHEN len(list_filter(o[1:step], lambda x: f[x])) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN f[filter] AND len(list_filter(o[1:step - 1], lambda x: f[x])) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN f[filter] AND len(list_filter(o[1:step - 1], lambda x: f[x])) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN f[filter] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN f[filter] AND len(list_filter(o[1:step - 1], lambda x: f[x])) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN f[filter] AND len(list_filter(o[1:step - 1], lambda x: f[x])) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM counted
"""
