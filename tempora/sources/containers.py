"""Hierarchical containers (HDF5 of the first layout: superblocks 0 and 1, version 1 headers) as a data source: partitions are ranges of rows, and a task reads and unpacks only the chunks of its rows.

    spark.read.format("container").option("datasets", "behavior/time,behavior/speed").load(path)
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .filestore import Local, Remote, plain, store_of
from .recordfiles import arrow_of

NAME = "container"
#: Rows of a partition hold about so many bytes, unpacked; a batch is some rows of one.
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 8192

# Fixed values of the format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
SPACE, TYPE, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, GROUP = 0x01, 0x03, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3


@dataclass(frozen=True)
class Chunk:
    """Stored bytes of a chunk whose first element is at start; filters in mask weren't applied."""

    start: tuple[int, ...]
    at: int
    size: int
    mask: int = 0


@dataclass
class Dataset:
    """Shape and type of a dataset, and where it lies: whole at a place, or in chunks."""

    path: str
    shape: tuple[int, ...]
    dtype: np.dtype
    at: int = UNDEFINED
    chunk: tuple[int, ...] | None = None
    tree: int = UNDEFINED
    filters: tuple[tuple[int, tuple[int, ...]], ...] = ()
    attributes: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize


def dtype_of(b: bytes) -> np.dtype:
    """The type that a message describes: whole numbers, floats, fixed text, and enumerations of whole numbers."""
    kind, order, size = b[0] & 15, "<" if not b[1] & 1 else ">", struct.unpack_from("<I", b, 4)[0]
    if kind == 0:
        return np.dtype(f"{order}{'i' if b[1] & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    if kind == 8:
        return dtype_of(b[8:])
    raise ValueError(f"type class {kind} isn't read")


def shape_of(b: bytes) -> tuple[int, ...]:
    at = 8 if b[0] == 1 else 4
    return struct.unpack_from(f"<{b[1]}Q", b, at)


def natural_key(name: str) -> list:
    """Sorts a name with its digits read as whole numbers."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def padded(n: int) -> int:
    return -(-n // 8) * 8


class Container:
    """An open file: groups and datasets by path. Reads headers and indexes only; values are read by rows."""

    def __init__(self, store: Local | Remote, path: str) -> None:
        self.file, self.base = store.open(path), 0
        size = store.size(path)
        while self.read(self.base, 8) != SIGNATURE:  # a block of the user's may come before
            self.base = self.base * 2 or 512
            if self.base + 96 > size:
                raise ValueError(f"{path}: not a container")
        start = self.base
        version = self.read(start + 8, 1)[0]
        if version > 1:
            raise ValueError(f"{path}: superblock {version} isn't read")
        if self.read(start + 13, 2) != b"\x08\x08":
            raise ValueError(f"{path}: addresses of other than eight bytes aren't read")
        entry = start + 24 + 4 * version + 32
        self.base = self.number(start + 24 + 4 * version)
        self.root = self.number(entry + 8)

    def __enter__(self) -> Container:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def number(self, at: int) -> int:
        return struct.unpack("<Q", self.read(at, 8))[0]

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(kind, body) of an object's header, continued blocks included."""
        at = self.base + address
        head = self.read(at, 16)
        if head[0] != 1:
            raise ValueError(f"object header {head[0]} isn't read")
        count, blocks, out = struct.unpack_from("<H", head, 2)[0], [(at + 16, struct.unpack_from("<I", head, 8)[0])], []
        while blocks and len(out) < count:
            place, size = blocks.pop(0)
            body, k = self.read(place, size), 0
            while k + 8 <= size and len(out) < count:
                kind, n = struct.unpack_from("<HH", body, k)
                data = body[k + 8 : k + 8 + n]
                out.append((kind, data))
                if kind == CONTINUED:
                    far, length = struct.unpack_from("<QQ", data)
                    blocks.append((self.base + far, length))
                k += 8 + n
        return out

    def members(self, address: int) -> dict[str, int]:
        """Header addresses of what a group holds, by name; empty for a dataset."""
        found = [b for k, b in self.messages(address) if k == GROUP]
        if not found:
            return {}
        tree, heap = struct.unpack_from("<QQ", found[0])
        names = self.base + self.number(self.base + heap + 24)
        out: dict[str, int] = {}
        nodes = [tree]
        while nodes:
            at = self.base + nodes.pop()
            head = self.read(at, 24)
            if head[:4] == b"SNOD":
                n = struct.unpack_from("<H", head, 6)[0]
                rows = self.read(at + 8, 40 * n)
                for k in range(n):
                    name, place = struct.unpack_from("<QQ", rows, 40 * k)
                    out[self.text(names + name)] = place
            else:
                n = struct.unpack_from("<H", head, 6)[0]
                keys = struct.unpack(f"<{2 * n + 1}Q", self.read(at + 24, 8 * (2 * n + 1)))
                nodes += reversed(keys[1::2])
        return out

    def text(self, at: int) -> str:
        out = b""
        while b"\0" not in out:
            more = self.read(at + len(out), 64)
            if not more:
                break
            out += more
        return out.split(b"\0")[0].decode()

    def address(self, path: str) -> int:
        at = self.root
        for name in filter(None, path.split("/")):
            have = self.members(at)
            if name not in have:
                raise KeyError(path)
            at = have[name]
        return at

    def names(self, path: str = "/") -> list[str]:
        """What a group holds, in natural order."""
        return sorted(self.members(self.address(path)), key=natural_key)

    def attributes(self, path: str) -> dict:
        """Attributes of an object: numbers, arrays and fixed texts; others are left out."""
        out = {}
        for kind, b in self.messages(self.address(path)):
            if kind == ATTRIBUTE:
                sizes = struct.unpack_from("<HHH", b, 2)
                step = padded if b[0] == 1 else int
                at = 8 + (b[0] == 3)
                name = b[at : at + sizes[0]].split(b"\0")[0].decode()
                at += step(sizes[0])
                try:
                    dtype = dtype_of(b[at : at + sizes[1]])
                except ValueError:
                    continue
                at += step(sizes[1])
                shape = shape_of(b[at : at + sizes[2]])
                at += step(sizes[2])
                value = np.frombuffer(b, dtype, int(np.prod(shape, dtype=np.int64)), at).reshape(shape)
                value = np.char.decode(np.char.rstrip(value, b"\0"), "utf-8") if dtype.kind == "S" else value
                out[name] = value.tolist()
        return out

    def dataset(self, path: str) -> Dataset:
        parts = dict(self.messages(self.address(path)))
        if TYPE not in parts or LAYOUT not in parts:
            raise ValueError(f"{path} is no dataset")
        out, b = Dataset(path, shape_of(parts[SPACE]), dtype_of(parts[TYPE])), parts[LAYOUT]
        if b[0] != 3:
            raise ValueError(f"layout {b[0]} isn't read")
        if b[1] == 2:
            n = b[2]
            out.tree = struct.unpack_from("<Q", b, 3)[0]
            out.chunk = struct.unpack_from(f"<{n - 1}I", b, 11)
            out.filters = filters_of(parts.get(FILTERS, b""))
        elif b[1] == 1:
            out.at = struct.unpack_from("<Q", b, 2)[0]
        else:
            raise ValueError("values kept in headers aren't read")
        return out

    def chunks(self, d: Dataset, lo: int, hi: int) -> list[Chunk]:
        """The stored chunks that hold rows lo to hi, found down the index."""
        rank, out, nodes = len(d.shape), [], [d.tree] if d.tree != UNDEFINED else []
        width = 8 + 8 * (rank + 1)
        while nodes:
            at = self.base + nodes.pop()
            head = self.read(at, 24)
            level, n = head[5], struct.unpack_from("<H", head, 6)[0]
            body = self.read(at + 24, n * (width + 8) + width)
            keys = [struct.unpack_from(f"<II{rank + 1}Q", body, k * (width + 8)) for k in range(n + 1)]
            for k in range(n):
                child = struct.unpack_from("<Q", body, k * (width + 8) + width)[0]
                if level:  # what lies below begins at this key and before the next
                    if keys[k][2] < hi and (keys[k + 1][2] >= lo or k == n - 1):
                        nodes.append(child)
                elif keys[k][2] < hi and keys[k][2] + d.chunk[0] > lo:
                    out.append(Chunk(keys[k][2:-1], child, keys[k][0], keys[k][1]))
        return sorted(out, key=lambda c: c.start)

    def rows_of(self, d: Dataset, lo: int, hi: int, chunks: list[Chunk] | None = None) -> np.ndarray:
        """Rows lo to hi; chunks that were never written are zeros."""
        shape = (hi - lo, *d.shape[1:])
        if d.chunk is None:
            if d.at == UNDEFINED:
                return np.zeros(shape, d.dtype)
            return np.frombuffer(self.read(self.base + d.at + lo * d.row_bytes, (hi - lo) * d.row_bytes), d.dtype).reshape(shape)
        out = np.zeros(shape, d.dtype)
        for c in self.chunks(d, lo, hi) if chunks is None else chunks:
            x = unpacked(self.read(self.base + c.at, c.size), d, c.mask)
            a, b = max(lo, c.start[0]), min(hi, c.start[0] + d.chunk[0], d.shape[0])
            if a < b:
                to = tuple(slice(s, min(s + w, n)) for s, w, n in zip(c.start[1:], d.chunk[1:], d.shape[1:], strict=True))
                of = tuple(slice(0, s.stop - s.start) for s in to)
                out[(slice(a - lo, b - lo), *to)] = x[(slice(a - c.start[0], b - c.start[0]), *of)]
        return out


def filters_of(b: bytes) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """(filter, its values) in the order in which they were applied."""
    if not b:
        return ()
    version, n = b[0], b[1]
    at, out = 8 if version == 1 else 2, []
    for _ in range(n):
        kind = struct.unpack_from("<H", b, at)[0]
        named = version == 1 or kind >= 256
        length = struct.unpack_from("<H", b, at + 2)[0] if named else 0
        at += 4 if named else 2
        values = struct.unpack_from("<H", b, at + 2)[0]
        at += 4 + (padded(length) if version == 1 else length)
        out.append((kind, struct.unpack_from(f"<{values}I", b, at)))
        at += 4 * (values + (values % 2 if version == 1 else 0))
    return tuple(out)


def unpacked(raw: bytes, d: Dataset, mask: int) -> np.ndarray:
    """A stored chunk as an array: its filters undone, last first."""
    for k in reversed(range(len(d.filters))):
        kind, _ = d.filters[k]
        if mask >> k & 1:
            continue
        if kind == DEFLATE:
            raw = zlib.decompress(raw)
        elif kind == SHUFFLE:
            size = d.dtype.itemsize
            whole = len(raw) // size * size
            raw = np.frombuffer(raw, np.uint8, whole).reshape(size, -1).T.tobytes() + raw[whole:]
        elif kind == CHECKSUM:
            raw = raw[:-4]
        else:
            raise ValueError(f"filter {kind} isn't read")
    return np.frombuffer(raw, d.dtype, int(np.prod(d.chunk))).reshape(d.chunk)


def spark_kind(d: Dataset) -> str:
    base = {"S": "string", "f": "double"}.get(d.dtype.kind, "long")
    inner = len(d.shape[1:])
    return "array<" * inner + base + ">" * inner


@dataclass
class Rows(InputPartition):
    """Rows lo to hi of datasets of a file, with their stored chunks, if any."""

    path: str
    lo: int
    hi: int
    datasets: list[Dataset]
    chunks: list[list[Chunk]]


class ContainerSource(DataSource):
    """index, and a column for each of the option datasets (paths, comma between), named by the option columns or their last parts; all must have the same number of rows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.path = plain(options["path"])
        self.store = store_of(self.path)

    def found(self) -> tuple[list[str], list[Dataset]]:
        paths = [p.strip() for p in self.options["datasets"].split(",")]
        with Container(self.store, self.path) as c:
            sets = [c.dataset(p) for p in paths]
        if len({d.rows for d in sets}) > 1:
            raise ValueError(f"{paths}: different numbers of rows")
        names = self.options.get("columns")
        return ([n.strip() for n in names.split(",")] if names else [p.rsplit("/", 1)[-1] for p in paths]), sets

    def schema(self) -> str:
        names, sets = self.found()
        return "index long, " + ", ".join(f"`{n}` {spark_kind(d)}" for n, d in zip(names, sets, strict=True))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ContainerReader(self.path, self.store, *self.found(), int(self.options.get("partitionbytes", PARTITION_BYTES)))


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, store: Local | Remote, names: list[str], sets: list[Dataset], size: int) -> None:
        self.path, self.store, self.names, self.sets = path, store, names, sets
        n, each = sets[0].rows, max(1, sum(d.row_bytes for d in sets))
        per = max(1, size // each)
        longest = max((d.chunk[0] for d in sets if d.chunk), default=1)
        self.per, self.n = max(longest, per // longest * longest), n  # whole chunks of the longest kind

    def partitions(self) -> list[InputPartition]:
        with Container(self.store, self.path) as c:
            every = [sorted(c.chunks(d, 0, d.rows), key=lambda x: x.start[0]) if d.chunk else [] for d in self.sets]
        out, first = [], [0] * len(every)
        for lo in range(0, self.n, self.per):
            hi, mine = min(self.n, lo + self.per), []
            for k, (d, chunks) in enumerate(zip(self.sets, every, strict=True)):
                while first[k] < len(chunks) and chunks[first[k]].start[0] + d.chunk[0] <= lo:
                    first[k] += 1
                last = first[k]
                while last < len(chunks) and chunks[last].start[0] < hi:
                    last += 1
                mine.append(chunks[first[k] : last])
            out.append(Rows(self.path, lo, hi, self.sets, mine))
        return out or [Rows(self.path, 0, 0, [], [])]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.lo >= partition.hi:
            return
        with Container(self.store, partition.path) as c:
            values = [c.rows_of(d, partition.lo, partition.hi, chunks if d.chunk else None) for d, chunks in zip(partition.datasets, partition.chunks, strict=True)]
        for lo in range(0, partition.hi - partition.lo, BATCH_ROWS):
            some = [v[lo : lo + BATCH_ROWS] for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(partition.lo + lo + np.arange(len(some[0]))), *(arrow_of(v) for v in some)], names=["index", *self.names])


def read(spark: SparkSession, path: str, *datasets: str, columns: list[str] | None = None, **options: object) -> DataFrame:
    """(index, a column a dataset) of datasets of one length."""
    spark.dataSource.register(ContainerSource)
    names = {"columns": ",".join(columns)} if columns else {}
    return spark.read.format(NAME).options(datasets=",".join(datasets), **names, **options).load(path)


def opened(path: str) -> Container:
    return Container(store_of(plain(path)), plain(path))


def read_dataset(spark: SparkSession, path: str, least: int = 10) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """(behavior (t, linear_position, speed), spikes (source, spike_id, t, amp), (start, stop)) of a preprocessed dataset: behavior/{time, linear_position, speed}, ephys/<sensor>/spikes/{times, amplitudes} and general/{start_time, stop_time}. Sensors come in natural order of their names; one with fewer than least spikes fails."""
    with opened(path) as c:
        ends = tuple(float(c.rows_of(d, 0, 1)[0]) for d in (c.dataset("general/start_time"), c.dataset("general/stop_time")))
        sensors = c.names("ephys")
        for s in sensors:
            n = [c.dataset(f"ephys/{s}/spikes/{x}").rows for x in ("times", "amplitudes")]
            if n[0] != n[1]:
                raise ValueError(f"{s}: {n[0]} times and {n[1]} amplitudes")
            if n[0] < least:
                raise ValueError(f"{s}: too few spikes")
    behavior = read(spark, path, "behavior/time", "behavior/linear_position", "behavior/speed", columns=["t", "linear_position", "speed"]).drop("index")
    spikes = None
    for s in sensors:
        one = read(spark, path, f"ephys/{s}/spikes/times", f"ephys/{s}/spikes/amplitudes", columns=["t", "amp"])
        one = one.select(F.lit(s).alias("source"), F.col("index").alias("spike_id"), "t", "amp")
        spikes = one if spikes is None else spikes.unionByName(one)
    if spikes is None:
        spikes = spark.createDataFrame([], "source string, spike_id long, t double, amp array<double>")
    return behavior, spikes, ends


def sample_rate(path: str, recording: int = 0) -> float:
    """The attribute sample_rate of a recording."""
    with opened(path) as c:
        return float(c.attributes(f"recordings/{recording}")["sample_rate"])


def start_time(path: str) -> float:
    """Seconds of the second message: the experiment's start."""
    with opened(path) as c:
        d = c.dataset("event_types/Messages/events/time_samples")
        return float(c.rows_of(d, 1, 2)[0]) / sample_rate(path)


def event_times(spark: SparkSession, path: str, channel: int = 0, rising: bool = True) -> DataFrame:
    """(t) of a TTL channel's rising or falling edges."""
    e = "event_types/TTL/events"
    rows = read(spark, path, f"{e}/time_samples", f"{e}/user_data/event_channels", f"{e}/user_data/eventID")
    return rows.filter((F.col("event_channels") == channel) & (F.col("eventID") == int(rising))).select((F.col("time_samples") / sample_rate(path)).alias("t"))


def read_position(spark: SparkSession, path: str) -> DataFrame:
    """(index, time, position, velocity, head_direction, diodes: map of a diode's name to its values) of a position file."""
    with opened(path) as c:
        have, led = c.names("/"), c.names("diodes") if "diodes" in c.names("/") else []
    fields = [f for f in ("time", "position", "velocity", "head_direction") if f in have]
    rows = read(spark, path, *fields, *[f"diodes/{x}" for x in led], columns=[*fields, *[f"_led{k}" for k in range(len(led))]])
    if not led:
        return rows
    pairs = [x for k, n in enumerate(led) for x in (F.lit(n), F.col(f"_led{k}"))]
    return rows.withColumn("diodes", F.create_map(*pairs)).drop(*[f"_led{k}" for k in range(len(led))])
