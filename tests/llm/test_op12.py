"""op12 against plain Python over words and lines, and its SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

from tempora.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, n_words string, kept int"


def plain(text):
    t = text or ""
    words = WORD.findall(t)
    chars = sum(map(len, words))
    seen, lines, line_chars = set(), 0, 0
    for x in t.split("\n"):
        w = WORD.findall(x)
        if w and x in seen:
            lines += 1
            line_chars += sum(map(len, w))
        seen.add(x)

    def inside(n, first):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        old, hit = set(), set()
        for i, g in enumerate(grams):
            if g in old or (first and grams.count(g) > 1):
                hit |= set(range(i, i + n))
            old.add(g)
        return hit

    repeat = len(inside(5, True))
    dup = [sum(len(words[i]) for i in inside(n, False)) for n in sorted(repetition.LIMITS)]
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    kept = not failed and 100 * line_chars <= 20 * chars and all(100 * d <= p * chars for d, (_, p) in zip(dup, sorted(repetition.LIMITS.items()), strict=True))
    return (len(words), chars, sum(c in "#*$%&|<>" for c in t), lines, repeat, failed, kept, line_chars, *dup)


def sample(seed):
    r = random.Random(seed)
    texts = [None, "", " \n\n\t", "one", "a b c d e a b c d e", "a b c d e " * 40, "same line here\n" * 6 + "end", "\r\n\r\nx y\r\nx y\n x y\nx y", "ü ß ✓ é x y \x1f z # * <b> $ | & % ü ß ✓ é", "w" * 50_000, "# " * 30]
    for k in range(90):
        vocab = [f"w{j}" for j in range(r.choice([3, 8, 400]))] + ["Ünï", "a|b", "ABC", "abc"]
        body = [r.choice(vocab) for _ in range(r.choice([4, 9, 10, 11, 40, 160]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            i, n = r.randrange(len(body)), r.randrange(1, 14)
            body += body[i : i + n]
        texts.append("".join(w + r.choice([" ", " ", "\n", "\t", "  "]) for w in body))
    return [(r.choice([None, 7, k]), t) for k, t in enumerate(texts)] + [(3, "twin of a row"), (3, "twin of a row")]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_plain_python_and_its_sql(spark, tables, seed):
    rows = sample(seed)
    d = tables("documents", [(*x, "clash", 1) for x in rows], DOCS)
    out = repetition.op12_repetition_rules(spark, d)
    got = sorted(map(str, map(tuple, out.collect())))
    assert got == sorted(str((i, *plain(t))) for i, t in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    sql = con.execute(repetition.SQL)
    at = [[c[0] for c in sql.description].index(c) for c in out.columns]
    assert sorted(str(tuple(r[k] for k in at)) for r in sql.fetchall()) == got


def test_long_texts_in_pieces():
    raw = ("Ünïcode wörter und \n mehr " * 300 + "x" * 900 + " tail").encode()
    data, off = np.frombuffer(raw * 2, np.uint8), np.array([0, len(raw), 2 * len(raw)])
    whole = repetition.word_table(data, off)
    for piece in (1, 7, 100, 1000):
        assert all((a == b).all() for a, b in zip(whole, repetition.word_table(data, off, piece), strict=True))
    assert len(whole[0]) == 2 * len(raw.split()) and whole[1].sum() == 2 * sum(len(w.decode()) for w in raw.split())


def test_limits_and_empty_table(spark, tables):
    assert repetition.op12_repetition_rules(spark, tables("documents", [], DOCS)).count() == 0
    text = " ".join(f"w{k}" for k in range(100)) + " w1 w2 w3 w4 w5 w6 w7"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [repetition.measure(docs, {7: p}).first()["kept"] for p in (5, 4)] == [True, False]
