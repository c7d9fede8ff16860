"""op1 on small Parquet tables and clusters too large for a unit, against brute force and its SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_small import brute_components, shingles

from tempora.llm import jaccard_join
from tempora.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, n_shingles string, component_id string"


def crowd(r):
    """Near copies of few texts, chains of them, texts that share passages only, and lone ones: all in one cluster."""
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for g in range(5):
        base = passage + [f"g{g}_{k}" for k in range(60)]
        for _ in range(45):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            rows.append(" ".join(own))
    for g in range(3):  # each next one differs a little more from the first
        own = passage + [f"c{g}_{k}" for k in range(60)]
        for k in range(25):
            own = own[:70] + own[71:] + [f"d{g}_{k}"]
            rows.append(" ".join(own))
    rows += [" ".join(passage + [f"l{k}_{j}" for j in range(r.choice([4, 9, 17, 30]))]) for k in range(60)]
    return list(enumerate(rows))


@pytest.mark.parametrize("unit", [2_000, 12_000])
def test_large_clusters_lose_no_link(spark, unit):
    rows = crowd(random.Random(11))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(4)
    got = jaccard_join.jaccard_components(docs, unit_shingles=unit).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows) and len(got) == len(rows)


def test_op1_equals_its_sql(spark, tables):
    rows = crowd(random.Random(12))[::3] + [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A\tB"), (9005, "a b c"), (9006, "Ünï a b c d"), (9007, "ünï a b c d")]
    d = tables("documents", [(i, t, "x", "y") for i, t in rows], DOCS)
    got = sorted(map(tuple, jaccard_join.op1_ngram_jaccard(spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(jaccard_join.SQL).fetchall()) == sorted((i, *c) for i, c in brute_components(rows).items())
    assert jaccard_join.op1_ngram_jaccard(spark, tables("documents", [], DOCS)).count() == 0


@pytest.mark.parametrize("copies", [1, 4])
def test_own_shingles_are_known_as_such(spark, monkeypatch, copies):
    """Neither copies of a text nor more shingles than the filter has bits make a text's own shingles look like those of others, so none goes to a cluster by them."""
    own = [" ".join(f"w{k}_{j}" for j in range(60)) for k in range(150)]
    rows = [(1000 * copy + k, t + "".join(f" p{j}" for j in range(30))) for copy in range(copies) for k, t in enumerate(own)]
    found, measure = [], jaccard_join.measure
    monkeypatch.setattr(jaccard_join, "measure", lambda texts: (found.append(measure(texts)), found[-1])[1])
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 1 << 13)
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 1 << 13)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (86, i % 1000) for i, _ in rows}
    raw = np.frombuffer("".join(own).encode(), np.uint8)
    sets = shingle_sets(raw, np.cumsum([0, *(len(t.encode()) for t in own)]))
    assert sum(map(len, sets)) == 150 * 56 and found[0][1].repeated(np.concatenate(sets)).mean() < 0.05


def plain_links(rows, percent=80):
    """{(set, set): (shared, total)} of different sets, and the number of links of each row."""
    sets = [shingles(t) for _, t in rows]
    far = lambda x, y: 100 * len(x & y) < percent * len(x | y)
    distinct = list({s for s in sets if s})
    found = {frozenset((x, y)): (len(x & y), len(x | y)) for i, x in enumerate(distinct) for y in distinct[:i] if not far(x, y)}
    counts = [sum(bool(x and y) and not far(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    return found, counts


@pytest.mark.parametrize("more", [{}, {"unit_shingles": 300, "broadcast_members": 0}])
def test_op1_gives_every_link(spark, more):
    r = random.Random(8)
    rows = [(None, None), (1, ""), (2, "a b c"), (3, "A b  c"), (4, "a b c d e f")]
    for k in range(9):
        base = [f"g{k}_{j}" for j in range(50)]
        for _ in range(r.choice([1, 3, 12])):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                own[r.randrange(50)] = r.choice(["x", f"y{r.random()}"])
            rows += [(r.choice([None, 7, 100 + len(rows)]), " ".join(own))] * r.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, counts = plain_links(rows)
    links, membership = jaccard_join.jaccard_links(df, **more)
    got = links.collect()
    assert sorted((x["shared"], x["total"]) for x in got) == sorted(found.values()) and len({(x["a"], x["b"]) for x in got}) == len(got) and all(x["a"] < x["b"] for x in got)
    assert len({x["set_id"] for x in membership.collect() if x["set_id"]}) == len({s for _, t in rows if (s := shingles(t))})
    assert sorted((str(x["doc_id"]), x["n_links"]) for x in jaccard_join.link_counts(df, **more).collect()) == sorted((str(i), n) for (i, _), n in zip(rows, counts, strict=True))
    assert jaccard_join.link_counts(df.limit(0)).count() == 0


def test_op1_merges_its_filter_of_rows_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FILTER_CHUNK", 1 << 12)
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1000).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("key", jaccard_join.key_of("doc_id", "h"))
    bits = jaccard_join.counted_rows(texts.repartition(7), 3000)
    first, rest = texts.filter("doc_id < 1000"), texts.filter("doc_id >= 1000")
    held = lambda df: jaccard_join.among(bits, np.array([r["key"] for r in df.select("key").collect()]).view(np.uint64))
    assert held(first).all() and held(rest).mean() < 0.2
