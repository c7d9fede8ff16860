"""op11 against a plain audit of one document after another, and its SQL."""

import random
from itertools import permutations

import duckdb
import pytest

from tempora.llm import filter_audit

DOCS = "doc_id long, text string, source string, mask int, good string, part string"
LABELS = "doc_id long, quality int, toxic int, part int"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(rows, labels):
    """Every order applied to every document, filter by filter."""

    def fails(i, t):
        words = [w for w in t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        out = set()
        if len(words) < 200:
            out.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            out.add("C")
        if any(c in "#$%&*|" for c in t):
            out.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            out.add("E")
        return out

    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    docs = [(s or "", i, fails(i, t or "")) for i, t, s in rows]
    out = []
    for part in {p for p, _, _ in docs}:
        mine, share, got = [(i, f) for p, i, f in docs if p == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                share[x] += len(gone)
                redundant = sum(x in f for _, f in mine) - len(gone)
                got.append([part, order, step, len(left), len(gone), redundant, sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out += [(*g, share[g[1][g[2] - 1]]) for g in got]
    return sorted(out)


def sample(seed, n=120):
    r = random.Random(seed)
    texts = [None, "", "  \n\x0b ", "a b c", "Same Text #1", "long one " * 150, "x y\x1cz " * 3, "Ünï ÀÉ " * 120 + "Z", "w " * 199 + "end", "A" * 3000]
    texts += [" ".join(r.choice(["alpha", "Beta", "c&d", f"v{k}", f"u{r.random()}"]) for _ in range(r.randrange(400))) for k in range(25)]
    rows = [(r.choice([None, *range(60)]) if r.random() < 0.4 else 100 + k, r.choice(texts), r.choice(["hot", "hot", "hot", None, "", "ö", "rare"])) for k in range(n)]
    rows += rows[:9]
    labels = [(r.choice([None, *range(220)]), r.choice([0, 1, None, 7]), r.choice([0, 1, None])) for _ in range(150)]
    return rows, labels


def written(tables, rows, labels):
    tables("labels", [(*x, 5) for x in labels], LABELS)
    return tables("documents", [(*x, 1, "clash", "clash") for x in rows], DOCS)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_a_plain_audit_and_its_sql(spark, tables, seed):
    rows, labels = sample(seed)
    d = written(tables, rows, labels)
    got = filter_audit.op11_filter_audit(spark, d)
    assert tuple(got.columns) == COLUMNS
    want = plain(rows, labels)
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    sql = con.execute(filter_audit.SQL)
    at = [[c[0] for c in sql.description].index(c) for c in COLUMNS]
    assert sorted(tuple(r[k] for k in at) for r in sql.fetchall()) == want


def test_chains_that_a_task_hands_on_early(spark):
    rows, labels = sample(3)
    docs, known = spark.createDataFrame([(*x, 1, "", "") for x in rows], DOCS).repartition(4), spark.createDataFrame([(*x, 1) for x in labels], LABELS)
    assert sorted(map(tuple, filter_audit.audit(docs, known, held_bytes=50, routed_bytes=2000).collect())) == plain(rows, labels)


def test_collision_chain_keeps_texts_apart():
    chains = filter_audit.Chains()
    got = [m for t, i in [(b"x", 5), (b"y", 1), (b"x", 3), (b"x", 9), (b"y", 1), (b"x", 3)] for m in chains.add(7, t, 0, i, {"p": 1})]
    assert got == [(5, "p", 16, 1), (9, "p", 16, 1)]
    assert sorted(x[1] for x in chains.drain()) == [[b"x", 0, 3, {"p": 2}], [b"y", 0, 1, {"p": 2}]]


def test_a_third_of_all_rows_alike_sends_one_text_a_task(spark):
    docs = spark.createDataFrame([(k, "copy of one text" if k % 3 else f"own {k}", "s") for k in range(3000)], "doc_id long, text string, source string").repartition(5)
    marks = filter_audit.marked(docs).collect()
    assert sum(m[3] for m in marks) == 3000 and sum(m[3] for m in marks if m[2] & filter_audit.SAME) == 1999
    assert all(m[2] & filter_audit.SAME for m in marks if m[0] % 3 and m[0] != 1)


def test_empty_tables(spark, tables):
    rows, _ = sample(4, 20)
    assert filter_audit.op11_filter_audit(spark, written(tables, [], [])).count() == 0
    got = filter_audit.op11_filter_audit(spark, written(tables, rows, []))
    assert sorted(map(tuple, got.collect())) == plain(rows, [])
