"""Record files as DataFrames: text-headed fixed records, acquisition files with a fixed header, packed probe words, and mixture files.

Files are read as Spark's binary files, so any file system that Spark knows will do. Large ones are dealt
out in slices of whole records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X

# Fixed values of the file formats.
TYPE_CODES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 8: "u4", 9: "i1", 10: "S1", 11: "u2", 12: "i8", 13: "u8"}
ACQUISITION_HEADER = 16384
CSC_SAMPLES = 512
TICKS_PER_SECOND = 1e4
MICROS_PER_SECOND = 1e6
LAYOUTS = {
    "csc": [("timestamp", "<u8"), ("channelnumber", "<u4"), ("samplefreq", "<u4"), ("numvalidsamples", "<u4"), ("signal", "<i2", (CSC_SAMPLES,))],
    "event": [("nstx", "<i2"), ("npkt_id", "<i2"), ("npkt_data_size", "<i2"), ("timestamp", "<u8"), ("nevent_id", "<i2"), ("nttl", "<i2"), ("ncrc", "<i2"), ("ndummy1", "<i2"), ("ndummy2", "<i2"), ("dnExtra", "<i4", (8,)), ("eventstring", "S128")],
    "video": [("swstx", "<u2"), ("swid", "<u2"), ("swdata_size", "<u2"), ("timestamp", "<u8"), ("points", "<u4", (400,)), ("sncrc", "<i2"), ("x", "<i4"), ("y", "<i4"), ("angle", "<i4"), ("targets", "<i4", (50,))],
}


def spike_layout(samples: int = 32, channels: int = 4) -> np.dtype:
    return np.dtype([("timestamp", "<u8"), ("scnumber", "<u4"), ("cellnumber", "<u4"), ("params", "<u4", (8,)), ("waveform", "<i2", (samples, channels))])


def layout_of(fields: str) -> np.dtype:
    """Record type of a tab-separated list of name,type code,size,shape."""
    out = []
    for f in fields.strip().split("\t"):
        name, code, size, shape = (x.strip() for x in f.split(",", 3))
        dims = tuple(int(x) for x in shape.strip("[]").replace(",", " ").split())
        kind = TYPE_CODES[int(code)]
        if np.dtype(kind).itemsize != int(size):
            raise ValueError(f"{name}: type {code} has not {size} bytes")
        out.append((name, f"S{dims[0]}") if kind == "S1" else (name, "<" + kind) if dims == (1,) else (name, "<" + kind, dims))
    return np.dtype(out)


def fields_of(layout: np.dtype) -> str:
    """Inverse of layout_of."""
    codes = {np.dtype(v): k for k, v in TYPE_CODES.items() if v != "S1"}
    out = []
    for name in layout.names:
        t = layout[name]
        base, shape = t.subdtype or (t, (1,))
        if base.kind == "S":
            out.append(f"{name},10,1,{base.itemsize}")
        else:
            out.append(f"{name},{codes[base.newbyteorder('=')]},{base.itemsize},{shape[0] if len(shape) == 1 else '[' + ' '.join(map(str, shape)) + ']'}")
    return "\t".join(out)


def parse_header(text: str, mark: str = "%") -> dict[str, str]:
    """Parameters of a text header: lines of mark, name, colon (or white space), value."""
    out = {}
    for line in text.splitlines():
        body = line.lstrip(mark + "#-").strip()
        for sep in (":", "\t", " "):
            if sep in body:
                name, value = body.split(sep, 1)
                out[name.strip()] = value.strip()
                break
    return out


def spark_type(layout: np.dtype) -> str:
    kinds = {"u": "long", "i": "long", "f": "double", "S": "string"}

    def of(t: np.dtype) -> str:
        base, shape = t.subdtype or (t, ())
        return "array<" * len(shape) + kinds[base.kind] + ">" * len(shape)

    return ", ".join(f"{n} {of(layout[n])}" for n in layout.names)


def read_records(spark: SparkSession, path: str, layout: np.dtype, offset: int) -> DataFrame:
    """(path, record, fields) of files of records after a header of offset bytes; a broken last record is left out."""
    names = list(layout.names)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                n = max(0, len(content) - offset) // layout.itemsize
                for lo in range(0, n, 4096):
                    x = np.frombuffer(content, layout, min(4096, n - lo), offset + lo * layout.itemsize)
                    cols = {c: [v.split(b"\0")[0].decode("latin-1") for v in x[c].tolist()] if x[c].dtype.kind == "S" else x[c].astype(np.float64 if x[c].dtype.kind == "f" else np.int64).tolist() for c in names}
                    yield pd.DataFrame({"path": p, "record": np.arange(lo, lo + len(x)), **cols})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, f"path string, record long, {spark_type(layout)}")


def write_records(rows: np.ndarray, header: bytes = b"") -> bytes:
    return header + rows.tobytes()


def read_csc(spark: SparkSession, path: str, volts_per_bit: float = 1.0, inverted: bool = False, limit: int | None = None) -> DataFrame:
    """(path, record, t, v): valid samples of continuous records, each with its own time; clipped ones (limit or more) are nan."""
    r = read_records(spark, path, np.dtype(LAYOUTS["csc"]), ACQUISITION_HEADER)
    x = r.select("path", "record", "timestamp", "samplefreq", F.posexplode(F.slice("signal", 1, F.col("numvalidsamples").cast("int"))).alias("k", "raw"))
    v = F.col("raw") * (-volts_per_bit if inverted else volts_per_bit)
    clipped = F.lit(False) if limit is None else F.abs("raw") >= limit
    return x.select("path", "record", (F.col("timestamp") / MICROS_PER_SECOND + F.col("k") / F.col("samplefreq")).alias("t"), F.when(clipped, F.lit(float("nan"))).otherwise(v).alias("v"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    r = read_records(spark, path, np.dtype(LAYOUTS["event"]), ACQUISITION_HEADER)
    return r.select("path", (F.col("timestamp") / MICROS_PER_SECOND).alias("t"), F.col("nevent_id").alias("id"), F.col("nttl").alias("ttl"), F.rtrim("eventstring").alias("eventstring"))


def event_times(events: DataFrame, eventstring: str) -> DataFrame:
    return events.filter(F.col("eventstring") == eventstring).select("t")


def read_spikes(spark: SparkSession, path: str, samples: int = 32, channels: int = 4) -> DataFrame:
    r = read_records(spark, path, spike_layout(samples, channels), ACQUISITION_HEADER)
    return r.select("path", (F.col("timestamp") / MICROS_PER_SECOND).alias("t"), F.col("cellnumber").alias("cell"), "waveform")


def video_points(points: Column) -> Column:
    """Array of struct(x, y, flags) of non-empty packed points: x in bits 0-11, y in bits 16-27."""
    full = F.filter(points, lambda p: p != 0)
    return F.transform(full, lambda p: F.struct(p.bitwiseAND(0xFFF).alias("x"), F.shiftright(p, 16).bitwiseAND(0xFFF).alias("y"), F.shiftright(p, 12).bitwiseAND(0xF).alias("low"), F.shiftright(p, 28).bitwiseAND(0xF).alias("high")))


def expand_buffers(buffers: DataFrame, fs: Column, gain: Column | float = 1.0) -> DataFrame:
    """Buffers (t, samples) as one row a sample with its own time."""
    return buffers.select("*", F.posexplode("samples").alias("_k", "_v")).select(*[c for c in buffers.columns if c not in ("t", "samples")], (F.col("t") + F.col("_k") / fs).alias("t"), (F.col("_v") * gain).alias("v"))


def ticks_to_seconds(ticks: Column) -> Column:
    return ticks / TICKS_PER_SECOND


def timeslice(df: DataFrame, start: float | None = None, stop: float | None = None, t: str = "t") -> DataFrame:
    """Rows from start to stop, ends included; a filter that Parquet readers push down."""
    return df.filter(X.inrange(F.col(t), start, stop)) if start is not None or stop is not None else df


def unpack_words(words: DataFrame, word: str = "word") -> DataFrame:
    """(…, k, v): three samples of each packed word."""
    return words.select(*[c for c in words.columns if c != word], F.posexplode(X.packed_samples(F.col(word))).alias("k", "v"))


def waveform_amplitudes(waveform: Column) -> Column:
    """Largest sample of each channel of samples by channels."""
    return F.transform(F.sequence(F.lit(0), F.size(waveform[0]) - 1), lambda c: F.array_max(F.transform(waveform, lambda row: row[c])))


def mixture_bytes(components: list[tuple[float, list[float], list[list[float]]]], sum_n: float, sum_weights: float, sample_covariance: list[list[float]] | None = None) -> bytes:
    """A mixture file of (weight, mean, covariance): counts and sums, an optional sample covariance, then the components."""
    d = len(components[0][1]) if components else len(sample_covariance or [])
    cov = lambda m: struct.pack("<HB", d, 0) + np.asarray(m, "<f8").tobytes()
    out = struct.pack("<HIddB", d, len(components), sum_n, sum_weights, sample_covariance is not None)
    out += cov(sample_covariance) if sample_covariance is not None else b""
    for w, mean, c in components:
        out += struct.pack("<Hd", d, w) + np.asarray(mean, "<f8").tobytes() + cov(c)
    return out


def parse_mixture(content: bytes) -> tuple[float, float, list[tuple[float, list[float], list[list[float]]]]]:
    d, n, sum_n, sum_weights, has = struct.unpack_from("<HIddB", content)
    at = struct.calcsize("<HIddB")
    size = 3 + 8 * d * d
    at += size * has
    out = []
    for _ in range(n):
        _, w = struct.unpack_from("<Hd", content, at)
        at += 10
        mean = np.frombuffer(content, "<f8", d, at).tolist()
        at += 8 * d
        out.append((w, mean, np.frombuffer(content, "<f8", d * d, at + 3).reshape(d, d).tolist()))
        at += size
    return sum_n, sum_weights, out


def read_mixtures(spark: SparkSession, path: str) -> DataFrame:
    """(source, comp_id, weight, mean, var, cov) of mixture files; source is the file's name without its ending."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                comps = parse_mixture(content)[2]
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame({"source": name, "comp_id": range(len(comps)), "weight": [c[0] for c in comps], "mean": [c[1] for c in comps], "var": [np.diag(c[2]).tolist() for c in comps], "cov": [c[2] for c in comps]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "source string, comp_id long, weight double, mean array<double>, var array<double>, cov array<array<double>>")


def check_sources(spikes: DataFrame, least: int = 10) -> DataFrame:
    """spikes; a source with fewer than least of them fails the query."""
    n = spikes.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") < least, F.raise_error(F.concat(F.lit("too few spikes: "), F.col("source").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return spikes.join(n.filter(ok).select("source"), "source", "left_semi")
