"""run() gives what the stages give one after another, and copes with empty tables."""

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def full(df):
    return sorted(str(r.asDict()) for r in df.collect())


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert full(corpus_pipeline.run(spark, DIR)) == full(docs)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "é", 0), (1, "a b c d e f g", "en", "é", 13), (2, "a b c d e f g", "en", None, 13), (3, "  ", "en", "é", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {None, 1, 3} and all(r["n_tokens"] == len(r["ids"]) for r in got) and 1 in {r["doc_id"] for r in got}
