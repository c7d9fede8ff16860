"""op5 against its SQL and op6 against a plain mix, on small Parquet tables with rows in any order."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_small import brute_lines

from tempora.llm import line_dedup, mixing

DOCS = "doc_id long, text string, source string, size int, n_lines string"


def lines(r):
    pool = [f"  Boilerplate line number {k} here " for k in range(9)] + ["ünïcode länge äöü ßß und", "short", "\x0bvertical tab line of some length\x0c", "", "  "]
    return "\n".join(r.choice(pool) for _ in range(r.randrange(7)))


def test_op5_equals_its_sql_on_repeated_rows(spark, tables):
    r = random.Random(5)
    rows = [(k, lines(r)) for k in range(60)] + [(7, lines(r)) for _ in range(9)] + [(None, lines(r)) for _ in range(9)] + [(100, None), (101, ""), (102, "twin of a line that is long\n" * 3)]
    rows += rows[:6]
    d = tables("documents", [(i, t, "x", 1, "y") for i, t in rows], DOCS)
    got = sorted(map(str, map(tuple, line_dedup.op5_line_dedup(spark, d).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    assert got == sorted(map(str, con.execute(line_dedup.SQL).fetchall())) and len(got) == len(rows)
    assert line_dedup.op5_line_dedup(spark, tables("documents", [], DOCS)).count() == 0


def test_op5_of_lone_rows(spark, tables):
    r = random.Random(6)
    rows = [(k, lines(r)) for k in range(80)]
    d = tables("documents", [(i, t, "x", 1, "y") for i, t in rows], DOCS)
    want = brute_lines(rows)
    assert {x["doc_id"]: (x["n_lines"], x["n_dropped"]) for x in line_dedup.op5_line_dedup(spark, d).collect()} == {i: (n, g) for i, (_, n, g) in want.items()}


def plain_targets(size):
    """Targets by trying again and again: whatever is above twice its source's size goes to the others by weight."""
    names = sorted(n for n in size if n is not None) + [None] * (None in size)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    fixed, left = {}, 1.5 * sum(size.values())
    while True:
        free = [n for n in names if n not in fixed]
        share = {n: (left - sum(fixed.values())) * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 2 * size[n]]
        if not over:
            return fixed | share
        fixed |= {n: 2.0 * size[n] for n in over}


@pytest.mark.parametrize("seed", [1, 2])
def test_op6_equals_a_plain_mix(spark, tables, seed):
    r = random.Random(seed)
    sources = ["b", "a", "ö", None, "z\n\x0b", "hot", "tiny"]
    rows = [(k, r.choice([None, "", "w " * r.randrange(1, 40), "x\u00a0y \t z"]), r.choices(sources, [5, 3, 2, 2, 1, 20, 0.05])[0]) for k in range(1500)]
    rows += [(7, "same id " * 3, "a"), (7, "same id " * 3, "a"), (None, "no id", "a"), (2000, "long " * 20_000, "hot"), (2001, "only", "lone")]
    d = tables("documents", [(i, t, s, 1, "clash") for i, t, s in rows], DOCS)
    got = mixing.op6_mixing(spark, d).collect()
    count = lambda t: len((t or "").replace("\u00a0", "_").split())
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + count(t)
    goal = plain_targets(size)
    key = {(size[s], round(goal[s], 6)): s for s in size}
    assert sorted((str(x["doc_id"]), x["size"]) for x in got) == sorted((str(i), count(t)) for i, t, _ in rows)
    taken, most = {}, {}
    for x in got:
        s = key[x["source_size"], round(x["target"], 6)]
        assert x["taken"] in (0, x["size"], 2 * x["size"])
        taken[s], most[s] = taken.get(s, 0) + x["taken"], max(most.get(s, 0), x["size"])
    for s in size:
        assert abs(taken.get(s, 0) - goal[s]) <= most[s] + 1
    assert sorted(map(str, mixing.op6_mixing(spark, d).collect())) == sorted(map(str, got))
    assert mixing.op6_mixing(spark, tables("documents", [], DOCS)).count() == 0


def test_mixed_documents_keep_the_cap(spark):
    """Where a source is taken as often as may be, documents without words aren't taken once more."""
    rows = [(k, "w " * 50 if k % 40 == 0 else "", "a") for k in range(400)] + [(1000 + k, "v " * 400, "b") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for _ in range(2):
        times = {}
        for x in mixing.mix_documents(docs).select("doc_id").collect():
            times[x[0]] = times.get(x[0], 0) + 1
        assert times and max(times.values()) == 2
        docs = docs.withColumn("source", F.lit("a"))
