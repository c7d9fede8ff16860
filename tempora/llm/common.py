"""What the operators of this subpackage share: reading tables, cutting lineage, packing text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds the temporary arrays of a Python worker.
SLICE_BYTES = 1 << 20
#: Size of a text is its number of these; the class is ASCII white space without U+001C..1F.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none a local one is set on a local master, as in tests; on a cluster that is an error, as executors would lose each other's data."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tempora-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept as files in the shared checkpoint folder, so that lost executors cost a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of results of cut() that nothing reads any more."""
    for df in dfs:
        file = df._jdf.logicalPlan().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, one for each of names."""
    have = {c.lower() for c in df.columns}
    return [n if n.lower() not in have else f"{n}_{uuid.uuid4().hex[:8]}" for n in names]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that the caller is about to add under the same names."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


Batches = Iterator[pa.RecordBatch]


def thrifty(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """function for mapInArrow, whose worker gives freed memory back when a task is over: Spark keeps workers for later stages."""

    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) of a string column as UTF-8 bytes and offsets from 0 on (hi - lo + 1 of them).

    Null is taken as empty. A slice holds at most limit bytes, or a single row of any length.
    """
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    n = len(col)
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
