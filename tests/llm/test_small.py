"""Each training-data operator against brute force on small texts: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import ann, bpe, exact_search, html_text, jaccard_join, line_dedup, mixing, quality, sharding, toxicity
from tempora.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", len(t or "")) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(400)] + ["Ünïcode", "ABC", "é"]
    out = []
    for k in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 40, 90, 200]))]
        for _ in range(r.choice([1, 1, 1, 2, 4])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 3])):
                if own:
                    own[r.randrange(len(own))] = r.choice(vocab)
            sep = r.choice([" ", "\n", "\t "])
            out.append(sep.join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in own))
    out += [None, "", " \n ", "x" * 100_000, "y " * 20_000, "a common line of more than twenty\nz", "A common LINE of more than twenty  \nq", "a common line of more than twenty\np"]
    return list(enumerate(out))


# 1


def shingles(t):
    w = WORDS.findall((t or "").translate(AZ))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("more", [{}, {"unit_shingles": 150, "broadcast_members": 0}])
def test_jaccard(spark, texts, more):
    got = jaccard_join.jaccard_components(docs_of(spark, texts), **more).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts) and len(got) == len(texts)


def test_jaccard_hot_group(spark):
    r = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(r.choice([1, 2, 3, 5])):
            own[r.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(own)))
    rows += [(150 + k, rows[0][1]) for k in range(50)]
    got = jaccard_join.jaccard_components(docs_of(spark, rows)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(rows)
    assert jaccard_join.keep_one(docs_of(spark, rows)).count() == len({c for _, c in brute_components(rows).values()})


def test_jaccard_empty_table_and_null_ids(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", "x"), (3, "a b c d e f", "x"), (3, "other", "x")], "doc_id long, text string, component_id string")
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard_join.jaccard_components(rows).collect()) == [("3", 3), ("3", 3), ("None", 3)]


@pytest.mark.parametrize("more", [{}, {"unit_shingles": 150, "broadcast_members": 0}])
def test_jaccard_repeated_and_null_ids(spark, more):
    r = random.Random(5)
    rows = [(None, None), (7, None), (None, ""), (7, " ")]
    for k in range(12):  # texts of all groups share words, so that they cluster
        base = [f"c{j}" for j in range(12)] + [f"g{k}_{j}" for j in range(60)]
        for _ in range(4):
            own = list(base)
            own[r.randrange(12, 72)] = "x"
            rows += [(r.choice([None, 7, 7, 8, 100 + len(rows)]), " ".join(own))] * r.choice([1, 1, 2])
    for _ in range(2):
        r.shuffle(rows)
        root = {k: c for k, (_, c) in brute_components([(k, t) for k, (_, t) in enumerate(rows)]).items()}
        want = []
        for k, (i, t) in enumerate(rows):
            ids = [j for m, (j, _) in enumerate(rows) if root[m] == root[k] and j is not None]
            n = len(shingles(t))
            want.append((i, n, min(ids, default=None) if n else i))
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 99), (5, 5), (100, 98)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 99: 98, 100: 98}


# 2


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_html(spark):
    art = "<nav><a href=/x>menu</a></nav><div class='sidebar w1'><p>side</p></div><div class='content c{0}'><h1>Head &amp; co</h1><p>One <b>bo</b>ld&nbsp;text.<br>two<p>three<script>bad('</p>')</script><div class='comments'><p>rant</p></div><form>f</form></div><footer>foot</footer>"
    want = "Head & co One bold text. two three"
    rows = [(k, f"http://h.example/{k}", page(art.format(k)), "old") for k in range(20)] + [(20, None, None, "old"), (21, "odd", "", "old"), (22, "http://h.example/z", "plain &lt;words&gt; only", "old"), (22, "http://h.example/z", "plain &lt;words&gt; only", "old"), (23, "http://one.example/", "<p>" + "word " * 30_000, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for limit in (1 << 20, 0):
        got = [(r["page_id"], r["text"]) for r in html_text.extract(df, limit).collect()]
        assert len(got) == len(rows)
        text = dict(got)
        assert all(text[k] == want for k in range(20))
        assert text[20] == text[21] == "" and text[22] == "plain <words> only" and len(text[23]) == 5 * 30_000 - 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_votes_decide():
    # a page whose longest text is an unmarked widget still follows its host
    p = html_text.parse("<div class=x1><p>story</p></div><div class=y2><p>" + "noise " * 50 + "</p></div>")
    assert p.best() == "body>div.y#" and p.text("body>div.x#") == "story"


# 3


@pytest.fixture(scope="module")
def own_bpe():
    pytest.importorskip("public_tokenizers")
    return bpe.Bpe(bpe.default_path())


def test_bpe_equals_library(own_bpe):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    r, letters = random.Random(3), "aeéE ñ'sStllΣσ12½<|>endoftext .!?\n\té́  漢字🎉‍\x1c\x85"
    cases = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)]
    cases += ["", " ", "foo<|endoftext|>Bar<|startoftext|>", "ab" * 3000, "I'VE it's'll 'S", "ΑΣ. Σ", "İ ẞ", "a" * 63 + " " + "b" * 64 + " " + "c" * 65]
    for text, ids in zip(cases, own_bpe.encode_all(cases), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want, text
        assert own_bpe.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_merges_are_leftmost_lowest():
    r = random.Random(1)
    for _ in range(300):
        ranks = {(a, b): (10 * a + b, 3 + (a + b) % 4) for a in range(7) for b in range(7) if r.random() < 0.3}
        word = [r.randrange(3) for _ in range(r.randrange(30))]
        want = list(word)
        while pairs := [(ranks[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks]:
            i = min(pairs)[1]
            want[i : i + 2] = [ranks[want[i], want[i + 1]][1]]
        assert bpe.merge_all(list(word), ranks) == want


def test_bpe_table(spark, texts, own_bpe):
    df = docs_of(spark, texts).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, outputs=("n_tokens", "ids", "ids_sha256", "decoded")).collect()}
    for i, t in texts:
        ids = own_bpe.encode(t or "")
        assert got[i]["n_tokens"] == len(ids) // 4 == len(got[i]["ids"]) and got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and got[i]["decoded"] == own_bpe.decode(ids)
    assert bpe.encode_decode(df.limit(0)).count() == 0


# 4 and 8


def test_quality_learns(spark):
    r = random.Random(7)
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        n = r.randrange(4, 80)
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n)]
        rows.append((k, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((k, int(good)))
    rows += [(400, None), (401, ""), (402, "x" * 50_000)]
    df, lab = docs_of(spark, rows), spark.createDataFrame(labels + [(5, None)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.classify(df, quality.learnable(lab, 5, 0)).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(got) == 403 and all(0 <= x["score"] <= 1 for x in got.values())
    assert np.mean([got[k]["predicted"] == labels[k][1] for k in held]) > 0.97
    assert {x["score"] for x in quality.classify(df, lab.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), lab).count() == 0


def test_discriminant_equals_densities():
    r = np.random.default_rng(0)
    covs = [np.cov(r.normal(size=(3, 50)) * [[1], [2], [0.5]]) for _ in range(2)]
    inv = [np.linalg.inv(np.linalg.cholesky(c)) for c in covs]
    m = [np.zeros(3), np.array([0.3, -0.2, 0.1])]
    d = quality.Discriminant(np.zeros(3), np.ones(3), m, inv, 0.4)
    x = r.normal(size=(20, 3))
    log = [-0.5 * np.einsum("ij,jk,ik->i", x - m[k], np.linalg.inv(covs[k]), x - m[k]) - 0.5 * np.linalg.slogdet(covs[k])[1] for k in (0, 1)]
    assert np.allclose(d.log_odds(x), log[1] - log[0] + 0.4)


def test_toxicity_learns_and_locates(spark):
    r = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        s = [" ".join(r.choice(["sun", "tree", "house", "river", "stone", "cloud"]) for _ in range(6)) for _ in range(r.randrange(1, 12))]
        bad = k % 4 == 0
        if bad:
            at = r.randrange(len(s))
            s[at] += " " + r.choice(["vilewort", "grumblex", "grumblexen"])
        rows.append((k, ". ".join(s) + "."))
        labels.append((k, int(bad)))
    rows += [(600, None), (601, ""), (602, "tree " * 30_000)]
    df, lab = docs_of(spark, rows).withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, toxicity.learnable(lab, 3, 1))
    got = {x["doc_id"]: x for x in toxicity.score(df, model).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(got) == 603 and all(got[k]["predicted"] == labels[k][1] for k in held)
    assert got[600]["score"] == got[601]["score"] == 0 and got[602]["predicted"] == 0
    text = dict(rows)
    for k in held:
        assert all(re.search("vilewort|grumblex", text[k][o["start"] : o["end"]]) for o in got[k]["offending"]) and bool(got[k]["offending"]) == bool(labels[k][1])
    none = toxicity.train(df, lab.limit(0))
    assert max(x["score"] for x in toxicity.score(df, none).collect()) < 0.1
    assert toxicity.score(df.limit(0), model).count() == 0


def test_op8_locates(spark):
    d, cache = "/root/testdata/sf0.001", {}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, toxicity.learnable(spark.read.parquet(f"{d}/labels.parquet"), 3, 1))
    want = []
    for r in docs.collect():
        zs = [z for _, _, z in model.sentences(r["text"] or "", cache)]
        bad = toxicity.noisy_or(zs) >= 0.7
        want.append((r["doc_id"], int(bad), max(1, sum(1 / (1 + math.exp(-z)) >= 0.7 for z in zs)) if bad else 0))
    got = [(r["doc_id"], r["predicted"], r["n_offending"]) for r in toxicity.op8_toxicity(spark, d).collect()]
    assert sorted(got) == sorted(want)


def test_noisy_or():
    zs = [-1.0, 0.5, -30.0]
    assert abs(toxicity.noisy_or(zs) - (1 - math.prod(1 - 1 / (1 + math.exp(-z)) for z in zs))) < 1e-12 and toxicity.noisy_or([]) == 0


# 5


def brute_lines(rows, least=20, docs=3):
    strip = " \t\n\x0b\x0c\r"
    holders = {}
    for i, t in rows:
        for k in {x.strip(strip).translate(AZ) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= docs}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(x.strip(strip).translate(AZ), i) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("more", [{}, {"broadcast_keys": 0}, {"most_bits": 1 << 20, "broadcast_keys": 0}, {"min_docs": 2}])
def test_lines(spark, texts, more):
    r = random.Random(6)
    pool = [f"  Boilerplate line number {k} here " for k in range(12)] + ["ünïcode länge äöü", "ünïcode länge äöü ßß", "short", "\x0bvertical tab line of some length\x0c"]
    rows = texts + [(1000 + k, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for k in range(40)]
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_dropped"]) for x in line_dedup.line_dedup(docs_of(spark, rows).withColumn("n_lines", F.lit("clash")), **more).collect()}
    assert got == brute_lines(rows, docs=more.get("min_docs", 3))


def test_lines_empty_table(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


# 6


def test_targets():
    t = mixing.targets({"a": 100, "b": 10, None: 50}, {"a": 1, "b": 5, None: 2})
    assert t["b"] == 20 and abs(sum(t.values()) - 240) < 1e-9 and abs(t[None] - 100) < 1e-9 and abs(t["a"] - 120) < 1e-9


def test_mix_documents(spark):
    r = random.Random(9)
    rows = [(k, " ".join(["w"] * r.randrange(1, 30))) for k in range(3000)] + [(3000, None), (3001, "")]
    df = docs_of(spark, rows)
    mixed, quota = mixing.mix(df, F.array("source"), mixing.words(F.col("text")))
    want = {q["source_json"]: q["target"] for q in quota.collect()}
    taken, size = {}, {}
    for x in mixed.collect():
        assert 0 <= x["copies"] <= 2
        taken[x["pattern"]] = taken.get(x["pattern"], 0) + x["copies"] * x["size"]
        size[x["pattern"]] = size.get(x["pattern"], 0) + x["size"]
    assert "[null]" in want and all(abs(taken[p] - want[p]) <= 30 and want[p] <= 2 * size[p] for p in want)
    again = mixing.mix(df, F.array("source"), mixing.words(F.col("text")))[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))
    assert mixing.mix_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0), F.array("source"), mixing.words(F.col("text")))[0].count() == 0


def test_op6_keeps_every_source(spark, tmp_path):
    sources = ["é", "漢字🎉", 'a "b" \\ c/d', "tab\tnew\nline\x0b\x1b\x7f", "\u2028", "", "null", None, "s0"]
    rows = [(k, "w " * (1 + k % 9), sources[k % len(sources)]) for k in range(180)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op6_mixing(spark, str(tmp_path)).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    names = mixing.source_order(list(size))
    goal = mixing.targets(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == [(k, len(t.split()), size[s], round(goal[s], 6)) for k, t, s in rows]


def test_flow_serves_overlapping_sources():
    flow = mixing.route({"a": 10, "ab": 10, "b": 0}, {"a": ["a"], "ab": ["a", "b"], "b": ["b"]}, {"a": 12, "b": 6}, 2)
    assert sum(f["a"] for f in flow.values() if "a" in f) == 12 and sum(f["b"] for f in flow.values() if "b" in f) == 6
    assert flow["ab"]["b"] == 6 and sum(flow["a"].values()) <= 10 and sum(flow["ab"].values()) <= 10  # no repeat is needed


# 7 and 9


def vectors(spark, n=400, dim=8):
    r = np.random.default_rng(3)
    x = r.integers(-4, 5, (n, dim)).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(n, None), (n + 1, [1.0, None] + [0.0] * 6), (n + 2, [float("nan")] * 8), (n + 3, [float("inf")] + [0.0] * 7), (n + 4, []), (n + 5, [1.0] * 3), (7, x[7].tolist()), (None, [1.0] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), x


def test_exact_search(spark):
    df, x = vectors(spark)
    ids = np.append(np.arange(len(x)), 7)
    y = np.vstack([x, x[7]])
    got = {}
    for r in exact_search.top_products(df, F.col("vec_id") % 20 == 0, 9, (1, 2, 4)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, len(x), 20):
        s = y @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:9]
        assert got[q] == [(k + 1, ids[j], int(s[j])) for k, j in enumerate(order)]
    assert exact_search.top_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = exact_search.top_products(df.filter("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2


def test_large_products_stay_exact():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])
    assert exact_search.products(q, x)[0, 0] == float(2**60 + 3)


def test_bounds_hold():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(30, 13)), r.normal(size=(40, 13))
    for s in (1, 2, 5, 13, 20):
        assert (exact_search.segment_statistics(a, s) @ exact_search.segment_statistics(b, s).T >= a @ b.T - 1e-9).all()


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 32)) + 2 * r.normal(size=(30, 32))[r.integers(0, 30, 3000)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5000, [0.0] * 32), (5001, None), (5002, [float("nan")] * 32)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        best = set(np.lexsort((np.arange(3000), -s))[:5].tolist())
        rows = sorted(got[q])
        assert [k for k, _, _ in rows] == [1, 2, 3, 4, 5] and all(abs(c - s[v]) < 1e-12 for _, v, c in rows)
        hits += len(best & {v for _, v, _ in rows})
    assert set(got) == set(range(0, 3000, 50)) and hits / 300 >= 0.9
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chi_square():
    assert abs(ann.chi2_quantile(0.95, 10) - 18.307038) < 1e-5 and abs(ann.chi2_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9


# 10


def test_shards(spark, texts):
    rows = texts + [(k, "same text for all") for k in range(5000, 7000)] + [(9000, "twin"), (9000, "twin")]
    df = docs_of(spark, rows).withColumn("shard", F.lit("clash"))
    got = sharding.shard_documents(df.filter("n_chars < 1000"), 5).collect()
    rows = [(i, t) for i, t in rows if len(t or "") < 1000]
    assert len(got) == len(rows) and {x["law"] for x in got} == {"bytes"} and all(x["grown_shard"] is None for x in got)
    total, slots = {}, {}
    for x in got:
        assert x["size"] == len((x["text"] or "").encode()) + 8 and x["text_crc32"] == zlib.crc32((x["text"] or "").encode())
        total[x["shard"]] = total.get(x["shard"], 0) + x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    mean = sum(total.values()) / 5
    assert set(total) == set(range(5)) and all(abs(v - mean) <= 0.01 * mean + 1100 for v in total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(df.limit(0), 5).count() == 0
