"""op3's query against the tokenizers library, on small tables and on documents of the driver's."""

import hashlib
import random
import struct

import tokenizers

from tempora.llm import bpe

DOCS = "doc_id long, text string, n_tokens string, ids int"


def wanted(rows):
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    lib.no_truncation()
    lib.no_padding()
    out = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text.encode())))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect()), key=str)


def test_query_equals_the_library(spark, tables):
    r = random.Random(3)
    letters = "abcdefgh ÀÉÜßœñ 0123456789 .,;'\"!?#$-_ \n\t ​ 中文 日本 Ωλ 🙂👩‍🚀 é"
    rows = [(r.choice([None, 7, k]), "".join(r.choice(letters) for _ in range(r.randrange(60)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "<|startoftext|>Hello<|endoftext|> World"), (204, "ABC abc's don't we'll"), (205, "x" * 5000), (206, "lorem ipsum " * 3000)]
    rows += rows[:5]
    d = tables("documents", [(*x, "clash", 1) for x in rows], DOCS)
    assert found(bpe.op3_bpe(spark, d)) == wanted(rows)
    assert bpe.op3_bpe(spark, tables("documents", [], DOCS)).count() == 0


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert found(bpe.op3_bpe(spark, d)) == wanted(rows)
