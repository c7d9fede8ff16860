"""Record files as a data source: partitions are ranges of records, a time filter becomes a range by binary search, and writes are committed whole.

    register(spark)
    spark.read.format("records").load(path)                       # by the files' own headers
    spark.read.format("records").option("layout", fields).option("offset", 0).load(path)
    df.write.format("records").option("layout", fields).mode("append").save(folder)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from . import records as R
from .filestore import Local, Remote, plain, store_of

NAME = "records"
#: Bytes of a partition, and of the records that a task turns into a batch at a time.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
MANIFEST = "_records.json"

# Fixed values of the file formats.
HEADER_BEGIN, HEADER_END = b"%%BEGINHEADER", b"%%ENDHEADER"
KINDS_BY_ENDING = {"ncs": "csc", "nev": "event", "nse": "spike", "nst": "spike", "ntt": "spike", "nvt": "video", "moz": "tahiti"}
KINDS_BY_NAME = {"CSC": "csc", "Event": "event", "Spike": "spike", "Video": "video", "MOZ": "tahiti"}
SPIKE_CHANNELS = {"nse": 1, "nst": 2, "ntt": 4}
#: Counters and words of three samples each in a probe packet; its words are big-endian.
PACKET_COUNTERS, PACKET_WORDS = 20, 480


@dataclass(frozen=True)
class Form:
    """What a file holds: records of a layout after offset bytes; time: the fields and scale that give seconds, or None."""

    layout: np.dtype
    offset: int
    time: tuple[tuple[str, float], ...]
    header: tuple[tuple[str, str], ...] = ()

    def seconds(self, x: np.ndarray) -> np.ndarray:
        return sum(x[name].astype(float) * scale for name, scale in self.time)


def tahiti_layout(channels: int, samples: int) -> np.dtype:
    return np.dtype([("seconds", "<i4"), ("nanoseconds", "<i4"), ("dt", "<i4"), ("data", "<i2", (samples, channels))])


def text_header(head: bytes) -> tuple[dict[str, str], int] | None:
    """(parameters, bytes) of a text header between its two marks; None without the first one, an error without the second."""
    if not head.startswith(HEADER_BEGIN):
        return None
    at = head.find(HEADER_END)
    if at < 0:
        raise ValueError("no end of header")
    end = head.find(b"\n", at) + 1 or len(head)
    out: dict[str, str] = {}
    for line in head[len(HEADER_BEGIN) : at].decode("latin-1").splitlines():
        name, colon, value = line.strip("% \r").partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out, end


def acquisition_header(head: bytes) -> dict[str, str]:
    """Parameters of lines -name value."""
    out: dict[str, str] = {}
    for line in head.decode("latin-1").splitlines():
        if line.startswith("-"):
            name, _, value = line[1:].strip().partition(" ")
            out[name] = value.strip()
    return out


def form_of(store: Local | Remote, path: str, options: dict[str, str]) -> Form:
    """By the options layout (fields), offset, byteorder, timefield and timescale; else by the file's header, the option kind, or its ending."""
    kind, fields = options.get("kind"), options.get("layout")
    if fields:
        layout = R.layout_of(fields).newbyteorder(">" if options.get("byteorder") == "big" else "<")
        name = options.get("timefield") or ("timestamp" if "timestamp" in layout.names else None)
        return Form(layout, int(options.get("offset", 0)), ((name, float(options.get("timescale", 1 / R.TICKS_PER_SECOND))),) if name else ())
    with store.open(path) as f:
        head = f.read(1 << 20)
    found = text_header(head)
    if found:
        header, size = found
        if header.get("File type", "Binary") != "Binary":
            raise ValueError(f"{path}: not a binary file")
        layout = R.layout_of(header["Fields"])
        return Form(layout, size, (("timestamp", 1 / R.TICKS_PER_SECOND),) if "timestamp" in layout.names else (), tuple(header.items()))
    ending = path.rsplit(".", 1)[-1].lower()
    header = acquisition_header(head[: R.ACQUISITION_HEADER])
    kind = kind or KINDS_BY_NAME.get(header.get("FileType", "")) or KINDS_BY_ENDING.get(ending)
    micros = (("timestamp", 1 / R.MICROS_PER_SECOND),)
    if kind == "spike":
        layout = R.spike_layout(int(options.get("samples", header.get("WaveformLength", 32))), int(options.get("channels", header.get("NumADChannels", SPIKE_CHANNELS.get(ending, 4)))))
    elif kind == "tahiti":
        layout, micros = tahiti_layout(int(header["NumADChannels"]), int(header["SamplesPerRecord"])), (("seconds", 1.0), ("nanoseconds", 1e-9))
    elif kind in R.LAYOUTS:
        layout = np.dtype(R.LAYOUTS[kind])
    else:
        raise ValueError(f"{path}: neither a header nor the options say what it holds")
    return Form(layout, R.ACQUISITION_HEADER, micros, tuple(header.items()))


def arrow_of(x: np.ndarray) -> pa.Array:
    """A field of records: text to its first zero byte, whole numbers as longs, others as doubles, more dimensions as lists."""
    if x.dtype.kind == "S":
        return pa.array([v.split(b"\0")[0].decode("latin-1") for v in x.tolist()], pa.string())
    flat = np.ascontiguousarray(x).astype(np.float64 if x.dtype.kind == "f" else np.int64)
    out = pa.array(flat.ravel())
    for size in reversed(x.shape[1:]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, size, dtype=np.int32)), out)
    return out


@dataclass
class Range(InputPartition):
    """Records lo to hi of a file, numbered from first on in what is read."""

    path: str
    lo: int
    hi: int
    first: int


class RecordSource(DataSource):
    """Records of a file, a glob or a folder: path, record (by file, or counted through a written folder), time where records have one, and the fields."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.path = plain(options["path"])
        self.store = store_of(self.path)

    def parts(self) -> tuple[list[tuple[str, int]], dict[str, str]]:
        """(files with the number of their first record, options): a written folder's by its manifest, others as they lie."""
        if self.store.exists(f"{self.path}/{MANIFEST}"):
            held = manifest(self.store, self.path)
            out, at = [], 0
            for p in held["parts"]:
                out.append((f"{self.path}/{p['name']}", at))
                at += p["records"]
            return out, CaseInsensitiveDict({**held["options"], **self.options})
        files = self.store.files(self.path)
        if not files:
            raise FileNotFoundError(self.path)
        return [(f, 0) for f in files], self.options

    def form(self) -> tuple[list[tuple[str, int]], Form]:
        files, options = self.parts()
        return files, form_of(self.store, files[0][0] if files else self.path, options)

    def schema(self) -> str:
        form = self.form()[1]
        return "path string, record long, " + ("time double, " if form.time else "") + R.spark_type(form.layout)

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(*self.form(), self.store, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.path, self.store, CaseInsensitiveDict(self.options), schema.fieldNames(), overwrite)


class RecordReader(DataSourceReader):
    """Times are taken to rise with the records where a filter, or the options start and stop, bound them; both ends are in."""

    def __init__(self, files: list[tuple[str, int]], form: Form, store: Local | Remote, options: dict[str, str]) -> None:
        self.files, self.form, self.store = files, form, store
        self.low, self.high = float(options.get("start", "-inf")), float(options.get("stop", "inf"))
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.form.time and getattr(f, "attribute", None) == ("time",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, float(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, float(f.value))
            yield f  # Spark applies them again

    def count(self, path: str) -> int:
        return max(0, self.store.size(path) - self.form.offset) // self.form.layout.itemsize

    def bound(self, path: str, n: int, x: float, after: bool) -> int:
        """Records of a file before time x (after: or at it), by some log n reads of one record."""
        size, lo, hi = self.form.layout.itemsize, 0, n
        with self.store.open(path) as f:
            while lo < hi:
                mid = (lo + hi) // 2
                f.seek(self.form.offset + mid * size)
                t = float(self.form.seconds(np.frombuffer(f.read(size), self.form.layout))[0])
                if t < x or (after and t == x):
                    lo = mid + 1
                else:
                    hi = mid
        return lo

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        per = max(1, self.size // self.form.layout.itemsize)
        for path, first in self.files:
            n = self.count(path)
            lo = self.bound(path, n, self.low, False) if self.form.time and self.low > -np.inf else 0
            hi = self.bound(path, n, self.high, True) if self.form.time and self.high < np.inf else n
            out += [Range(path, k, min(k + per, hi), first + k) for k in range(lo, hi, per)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.lo >= partition.hi:
            return
        layout, names = self.form.layout, list(self.form.layout.names)
        step = max(1, BATCH_BYTES // layout.itemsize)
        with self.store.open(partition.path) as f:
            f.seek(self.form.offset + partition.lo * layout.itemsize)
            for lo in range(partition.lo, partition.hi, step):
                x = np.frombuffer(f.read(min(step, partition.hi - lo) * layout.itemsize), layout)
                number = partition.first + lo - partition.lo + np.arange(len(x))
                time = [pa.array(self.form.seconds(x))] if self.form.time else []
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(x), pa.string()), pa.array(number), *time, *(arrow_of(x[c]) for c in names)], names=["path", "record", *["time"][: len(time)], *names])


def manifest(store: Local | Remote, path: str) -> dict:
    with store.open(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    records: int


class RecordWriter(DataSourceArrowWriter):
    """Each task writes a file of its own, with header, beside the others; commit gives them their places after what is there and changes the manifest in one step. What isn't in the manifest isn't read, so failed tasks and jobs leave nothing to see."""

    def __init__(self, path: str, store: Local | Remote, options: dict[str, str], columns: list[str], overwrite: bool) -> None:
        self.path, self.store, self.overwrite = path, store, overwrite
        held = manifest(store, path) if store.exists(f"{path}/{MANIFEST}") else None
        self.kept = {"parts": [], "options": {}} if overwrite or held is None else held
        self.old = held["parts"] if overwrite and held else []
        self.fields = options.get("layout") or self.kept["options"].get("layout")
        if not self.fields:
            raise ValueError("option layout says what a record holds")
        if self.kept["options"].get("layout", self.fields) != self.fields:
            raise ValueError("the folder holds records of another layout")
        self.layout, self.columns = R.layout_of(self.fields), columns
        missing = [n for n in self.layout.names if n not in columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        self.header = header_bytes(self.fields, json.loads(options.get("header", "{}"))) if options.get("headed", "false").lower() == "true" else b""
        keep = {k: options[k] for k in ("timefield", "timescale") if k in options}
        self.options = {**self.kept["options"], "layout": self.fields, "offset": str(len(self.header)), **keep}
        if self.kept["parts"] and self.kept["options"].get("offset") != self.options["offset"]:
            raise ValueError("the folder's files have another header")
        self.job = uuid.uuid4().hex
        self.folder = f"{path}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        name, n = f"{uuid.uuid4().hex}.rec", 0
        with self.store.create(f"{self.folder}/{name}") as f:
            f.write(self.header)
            for b in iterator:
                f.write(packed(b, self.columns, self.layout))
                n += b.num_rows
        return Written(TaskContext.get().partitionId(), name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = list(self.kept["parts"])
        for m in sorted((m for m in messages if m and m.records), key=lambda m: m.partition):
            name = f"part-{len(parts):06d}-{self.job}.rec"
            self.store.move(f"{self.folder}/{m.name}", f"{self.path}/{name}")
            parts.append({"name": name, "records": m.records})
        temp = f"{self.path}/_manifest-{self.job}"
        with self.store.create(temp) as f:
            f.write(json.dumps({"parts": parts, "options": self.options}).encode())
        self.store.move(temp, f"{self.path}/{MANIFEST}")
        for p in self.old:
            self.store.remove(f"{self.path}/{p['name']}")
        self.store.remove(self.folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.store.remove(self.folder)


def header_bytes(fields: str, parameters: dict[str, str]) -> bytes:
    """A text header of parameters and the list of fields."""
    lines = [f"% {k}: {v}" for k, v in {"File type": "Binary", **parameters, "Fields": fields}.items()]
    return b"\n".join([HEADER_BEGIN, *(line.encode("latin-1") for line in lines), HEADER_END, b""])


def packed(b: pa.RecordBatch, columns: list[str], layout: np.dtype) -> bytes:
    """Rows of a batch as records; null and list entries that are missing fail."""
    out = np.zeros(b.num_rows, layout)
    for name in layout.names:
        col, (base, shape) = b.column(columns.index(name)), layout[name].subdtype or (layout[name], ())
        if base.kind == "S":
            out[name] = [(v or "").encode("latin-1") for v in col.to_pylist()]
            continue
        for size in shape:
            if b.num_rows and not (np.diff(col.offsets.to_numpy()) == size).all():
                raise ValueError(f"{name}: rows without {size} entries")
            col = col.flatten()
        if col.null_count:
            raise ValueError(f"{name}: null")
        values = col.to_numpy(zero_copy_only=False)
        if base.kind in "iu" and len(values) and (values.min() < np.iinfo(base).min or values.max() > np.iinfo(base).max):
            raise ValueError(f"{name}: beyond {base}")
        out[name] = values.reshape(b.num_rows, *shape)
    return out.tobytes()


def register(spark: SparkSession) -> None:
    """Makes the source known by its name, with filters pushed to it."""
    spark.dataSource.register(RecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, start: float | None = None, stop: float | None = None, **options: object) -> DataFrame:
    """Records of path; with start or stop, those of files in order of time from start to stop, both in."""
    register(spark)
    bounds = {k: v for k, v in (("start", start), ("stop", stop)) if v is not None}
    return spark.read.format(NAME).options(**{**options, **bounds}).load(path)


def write(df: DataFrame, folder: str, layout: str, mode: str = "append", **options: object) -> None:
    """df's rows as records of layout in a folder that read() reads, in the order of its partitions. mode: append, overwrite, or error if records are there."""
    register(df.sparkSession)
    if mode == "error":
        if store_of(plain(folder)).exists(f"{plain(folder)}/{MANIFEST}"):
            raise FileExistsError(f"{folder} exists")
        mode = "overwrite"
    df.write.format(NAME).options(layout=layout, **options).mode(mode).save(folder)


def assemble(spark: SparkSession, folder: str, file: str) -> int:
    """A written folder's records as one file with one header, and their number. Every task copies parts to their places in the file, which must be on a file system that tasks share; the file appears when all are there."""
    folder, file = plain(folder), plain(file)
    store = store_of(folder)
    if not isinstance(store, Local) or "://" in file:
        raise ValueError("one file is put together on a shared local path only")
    held = manifest(store, folder)
    size, offset = R.layout_of(held["options"]["layout"]).itemsize, int(held["options"]["offset"])
    temp, at, rows, header = f"{file}.writing-{uuid.uuid4().hex}", offset, [], b""
    for p in held["parts"]:
        rows.append((f"{folder}/{p['name']}", at))
        at += p["records"] * size
    if rows:
        with open(rows[0][0], "rb") as f:
            header = f.read(offset)
    with open(temp, "wb") as f:
        f.write(header)
        f.truncate(at)

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, place in zip(frame["path"], frame["place"], strict=True):
                with open(path, "rb") as old, open(temp, "r+b") as new:
                    old.seek(offset)
                    new.seek(place)
                    while block := old.read(BATCH_BYTES):
                        new.write(block)
            yield pd.DataFrame({"n": [len(frame)]})

    if rows:
        spark.createDataFrame(rows, "path string, place long").repartition(len(rows)).mapInPandas(copy, "n long").agg(F.sum("n")).first()
    store.move(temp, file)
    return (at - offset) // size


def probe_channel(samples: Column, channel: int) -> Column:
    """The ten bits of a channel (from 0) in a packet's words of three samples each."""
    return F.shiftright(samples[channel // 3], 10 * (channel % 3)).bitwiseAND(1023)


def convert(spark: SparkSession, packets: str, folder: str, channels: list[int] | None = None, n: int | None = None, mode: str = "error", counters: int = PACKET_COUNTERS, words: int = PACKET_WORDS) -> None:
    """Samples of a file of probe packets as records (signal) of whole numbers of the chosen channels (from 0; all by default), for the first n packets or all."""
    layout = f"sync,8,4,1\tcounter,8,4,{counters}\tsamples,8,4,{words}"
    rows = read(spark, packets, layout=layout, offset=0, byteorder="big")
    if n is not None:
        rows = rows.filter(F.col("record") < n)
    picked = channels if channels is not None else list(range(3 * words))
    signal = F.array(*[probe_channel(F.col("samples"), c) for c in picked])
    write(rows.select(signal.alias("signal")), folder, f"signal,2,2,{len(picked)}", mode)


def samples_by_time(records: DataFrame, rate: Column | float, signal: str = "data") -> DataFrame:
    """(path, record, k, time, values) of records with time and an array of samples: the k-th is k / rate later."""
    x = records.select("path", "record", F.col("time").alias("_t"), F.posexplode(signal).alias("k", "values"))
    return x.select("path", "record", "k", (F.col("_t") + F.col("k") / rate).alias("time"), "values")


def diodes(records: DataFrame) -> DataFrame:
    """(path, record, time, front, back) of tracked diodes."""
    point = lambda side: F.struct(F.col(f"x{side}").alias("x"), F.col(f"y{side}").alias("y")).alias(side)
    return records.select("path", "record", "time", point("front"), point("back"))
