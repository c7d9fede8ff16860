"""Small tables for the queries."""

import random

import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes rows as a table, in a shuffled order and several files, and returns the folder."""

    def write(name, rows, schema, seed=1):
        rows = list(rows)
        random.Random(seed).shuffle(rows)
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
