"""The container source against files that these tests build byte by byte."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.sources import containers as X

UNDEFINED = struct.pack("<Q", X.UNDEFINED)


def pad(b):
    return b + b"\0" * (-len(b) % 8)


class Builder:
    """A file with groups as nested dicts and datasets as (array, options)."""

    def __init__(self, tree, attributes=None, user=0, names_per_node=3):
        self.out, self.user, self.per, self.attributes = bytearray(96), user, names_per_node, attributes or {}
        root = self.group(tree, "")
        head = X.SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<Q", user) + UNDEFINED + struct.pack("<Q", len(self.out)) + UNDEFINED
        self.out[:96] = head + struct.pack("<QQII", 0, root, 0, 0) + b"\0" * 16
        self.bytes = b"u" * user + bytes(self.out)

    def put(self, b):
        at = len(self.out)
        self.out += pad(b)
        return at

    def header(self, messages, path):
        for name, value in self.attributes.get(path, {}).items():
            x = np.asarray(value)
            kind, space = self.kind(x.dtype), self.space(x.shape)
            raw = name.encode() + b"\0"
            messages.append((X.ATTRIBUTE, struct.pack("<BBHHH", 1, 0, len(raw), len(kind), len(space)) + pad(raw) + pad(kind) + pad(space) + x.tobytes()))
        body = lambda ms: b"".join(struct.pack("<HHBBBB", k, len(pad(b)), 0, 0, 0, 0) + pad(b) for k, b in ms)
        if len(messages) > 3:  # the rest in a block elsewhere
            far = body(messages[2:])
            place = self.put(far)
            messages = [*messages[:2], (X.CONTINUED, struct.pack("<QQ", place, len(far)))]
            return self.put(struct.pack("<BBHII", 1, 0, len(messages) + far_count(far), 1, len(body(messages))) + b"\0" * 4 + body(messages))
        return self.put(struct.pack("<BBHII", 1, 0, len(messages), 1, len(body(messages))) + b"\0" * 4 + body(messages))

    def group(self, tree, path):
        places = {n: self.group(v, f"{path}/{n}") if isinstance(v, dict) else self.dataset(*v, f"{path}/{n}") for n, v in tree.items()}
        text, at = b"\0" * 8, {}
        for n in sorted(places):
            at[n] = len(text)
            text += pad(n.encode() + b"\0")
        heap = self.put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(text), 1, self.put(text)))
        names, nodes = sorted(places), []
        for k in range(0, max(len(names), 1), self.per):
            rows = b"".join(struct.pack("<QQII", at[n], places[n], 0, 0) + b"\0" * 16 for n in names[k : k + self.per])
            nodes.append(self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(names[k : k + self.per])) + rows))
        level = 0
        while level == 0 or len(nodes) > 1:
            above = []
            for k in range(0, len(nodes), 2):
                some = nodes[k : k + 2]
                above.append(self.put(b"TREE" + struct.pack("<BBH", 0, level, len(some)) + UNDEFINED * 2 + b"".join(struct.pack("<QQ", 0, n) for n in some) + struct.pack("<Q", 0)))
            nodes, level = above, level + 1
        return self.header([(X.GROUP, struct.pack("<QQ", nodes[0], heap))], path)

    def kind(self, t):
        order = 1 if t.byteorder == ">" else 0
        if t.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, t.itemsize)
        if t.kind == "f":
            return struct.pack("<BBBBI", 0x11, 0x20 | order, 63, 0, t.itemsize) + b"\0" * 12
        return struct.pack("<BBBBI", 0x10, order | (8 if t.kind == "i" else 0), 0, 0, t.itemsize) + struct.pack("<HH", 0, 8 * t.itemsize)

    def space(self, shape):
        return struct.pack("<BBBBI", 1, len(shape), 0, 0, 0) + struct.pack(f"<{len(shape)}Q", *shape)

    def dataset(self, x, chunk, filters, path, skip=()):
        size = x.dtype.itemsize
        messages = [(X.SPACE, self.space(x.shape)), (X.TYPE, self.kind(x.dtype))]
        if chunk is None:
            at = self.put(x.tobytes()) if x.size else X.UNDEFINED
            return self.header([*messages, (X.LAYOUT, struct.pack("<BBQQ", 3, 1, at, x.nbytes))], path)
        entries = []
        for start in np.ndindex(*[-(-n // c) for n, c in zip(x.shape, chunk, strict=True)]):
            start = tuple(s * c for s, c in zip(start, chunk, strict=True))
            if start in skip:
                continue
            full = np.zeros(chunk, x.dtype)
            part = x[tuple(slice(s, s + c) for s, c in zip(start, chunk, strict=True))]
            full[tuple(slice(0, n) for n in part.shape)] = part
            raw, mask = full.tobytes(), 0
            for k, f in enumerate(filters):
                if f == X.SHUFFLE and sum(start) % 3 == 1:
                    mask |= 1 << k  # left out for this chunk
                elif f == X.SHUFFLE:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes()
                elif f == X.DEFLATE:
                    raw = zlib.compress(raw)
                else:
                    raw += b"csum"
            entries.append((len(raw), mask, start, self.put(raw)))
        key = lambda n, m, s: struct.pack(f"<II{len(s) + 1}Q", n, m, *s, 0)
        end = key(0, 0, x.shape)
        nodes, level = [(e[:3], e[3]) for e in entries], 0
        while nodes and (level == 0 or len(nodes) > 1):
            above = []
            for k in range(0, len(nodes), 4):
                some = nodes[k : k + 4]
                last = key(*nodes[k + 4][0]) if k + 4 < len(nodes) else end
                above.append((some[0][0], self.put(b"TREE" + struct.pack("<BBH", 1, level, len(some)) + UNDEFINED * 2 + b"".join(key(*e) + struct.pack("<Q", c) for e, c in some) + last)))
            nodes, level = above, level + 1
        tree = nodes[0][1] if nodes else X.UNDEFINED
        pipeline = struct.pack("<BB", 1, len(filters)) + b"\0" * 6 + b"".join(struct.pack("<HHHH", f, 8, 0, 1) + b"filter\0\0" + struct.pack("<II", 6, 0) for f in filters)
        layout = struct.pack("<BBB", 3, 2, len(chunk) + 1) + struct.pack("<Q", tree) + struct.pack(f"<{len(chunk) + 1}I", *chunk, size)
        return self.header([*messages, (X.LAYOUT, layout), *([(X.FILTERS, pipeline)] if filters else [])], path)


def far_count(b):
    n, k = 0, 0
    while k < len(b):
        k += 8 + struct.unpack_from("<H", b, k + 2)[0]
        n += 1
    return n


R = np.random.default_rng(5)
PLAIN = R.normal(size=1000)
WIDE = R.normal(size=(1000, 7)).astype(">f4")
WHOLE = R.integers(-9, 9, (1000, 3, 2)).astype("<i2")
TEXT = np.array([f"e{k}".encode() for k in range(1000)], "S6")


@pytest.fixture
def path(tmp_path):
    tree = {
        "plain": (PLAIN, None, ()),
        "a": {"wide": (WIDE, (64, 3), (X.SHUFFLE, X.DEFLATE, X.CHECKSUM)), "whole": (WHOLE, (37, 2, 2), (X.DEFLATE,)), "text": (TEXT, (100,), ())},
        "many": {f"n{k}": (np.arange(k + 1, dtype="u1"), None, ()) for k in range(20)},
        "empty": (np.zeros(0), None, ()),
        "none": {},
    }
    attributes = {"": {"name": np.bytes_("root")}, "/a/whole": {"scale": 2.5, "shape": np.arange(4), "unit": np.bytes_("mV")}}
    file = tmp_path / "x.h5"
    file.write_bytes(Builder(tree, attributes, user=512).bytes)
    return str(file)


def test_names_attributes_and_shapes(path):
    with X.opened(path) as c:
        assert c.names() == ["a", "empty", "many", "none", "plain"] and c.names("many") == [f"n{k}" for k in range(20)] and c.names("none") == []
        assert c.attributes("a/whole") == {"scale": 2.5, "shape": [0, 1, 2, 3], "unit": "mV"} and c.attributes("/") == {"name": "root"} and c.attributes("plain") == {}
        d = c.dataset("a/wide")
        assert d.shape == (1000, 7) and d.chunk == (64, 3) and d.dtype == np.dtype(">f4") and [f for f, _ in d.filters] == [X.SHUFFLE, X.DEFLATE, X.CHECKSUM]
        for lo, hi in ((0, 1000), (0, 1), (63, 65), (500, 700), (999, 1000), (64, 64)):
            assert (c.rows_of(d, lo, hi) == WIDE[lo:hi]).all() and (c.rows_of(c.dataset("a/whole"), lo, hi) == WHOLE[lo:hi]).all() and (c.rows_of(c.dataset("plain"), lo, hi) == PLAIN[lo:hi]).all()
        assert len(c.chunks(d, 64, 128)) == 3 and len(c.chunks(d, 0, 1000)) == 48
        with pytest.raises(KeyError):
            c.dataset("a/other")
        with pytest.raises(ValueError, match="no dataset"):
            c.dataset("a")


def test_datasets_as_columns_in_many_partitions(spark, path):
    df = X.read(spark, path, "plain", "a/wide", "a/whole", "a/text", partitionbytes=3000)
    assert df.columns == ["index", "plain", "wide", "whole", "text"] and df.rdd.getNumPartitions() == 10  # a hundred rows: whole chunks of the longest kind
    got = df.orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(1000)) and np.allclose([r["plain"] for r in got], PLAIN) and np.allclose([r["wide"] for r in got], WIDE)
    assert np.array_equal(np.array([r["whole"] for r in got]), WHOLE) and [r["text"].encode() for r in got] == TEXT.tolist()
    assert X.read(spark, path, "many/n7", columns=["x"]).collect()[-1] == (7, 7) and X.read(spark, path, "empty").count() == 0
    with pytest.raises(Exception, match="different numbers"):
        X.read(spark, path, "plain", "empty").count()


def test_what_was_never_written_is_zero(tmp_path):
    class Holes(Builder):
        def dataset(self, x, chunk, filters, path, skip=()):
            return super().dataset(x, chunk, filters, path, {(4,), (0,)} if path == "/holes" else {(k,) for k in range(0, 12, 4)} if path == "/all" else skip)

    x = np.arange(1, 13, dtype="<i8")
    file = tmp_path / "h.h5"
    file.write_bytes(Holes({"holes": (x, (4,), ()), "all": (x, (4,), ()), "nothing": (np.zeros(0), None, ())}).bytes)
    with X.opened(str(file)) as c:
        assert c.rows_of(c.dataset("holes"), 0, 12).tolist() == [0] * 8 + [9, 10, 11, 12] and c.rows_of(c.dataset("all"), 2, 9).tolist() == [0] * 7


def test_what_is_not_read_says_so(tmp_path, path):
    good = open(path, "rb").read()
    for at, value, match in ((512 + 8, 2, "superblock"), (512 + 13, 4, "eight bytes"), (512, 0, "not a container")):
        bad = bytearray(good)
        bad[at] = value
        (tmp_path / "bad.h5").write_bytes(bytes(bad))
        with pytest.raises(ValueError, match=match):
            X.opened(str(tmp_path / "bad.h5"))
    with pytest.raises(ValueError, match="class 9"):
        X.dtype_of(b"\x19" + b"\0" * 15)


def test_preprocessed_dataset(spark, tmp_path):
    t = np.arange(400) / 20
    sensor = lambda n: {"spikes": {"times": (np.sort(R.uniform(0, 20, n)), (16,), (X.DEFLATE,)), "amplitudes": (R.normal(size=(n, 4)), (16, 4), (X.DEFLATE,))}}
    tree = {
        "general": {"start_time": (np.array([1.5]), None, ()), "stop_time": (np.array([19.0]), None, ())},
        "behavior": {"time": (t, (50,), ()), "linear_position": (t * 3, None, ()), "speed": (t + 1, (64,), (X.DEFLATE,))},
        "ephys": {"TT10": sensor(30), "TT2": sensor(12)},
    }
    file = str(tmp_path / "d.h5")
    open(file, "wb").write(Builder(tree).bytes)
    behavior, spikes, ends = X.read_dataset(spark, file)
    assert ends == (1.5, 19.0) and sorted(map(tuple, behavior.collect())) == [(a, b, c) for a, b, c in zip(t, t * 3, t + 1, strict=True)]
    for s in ("TT10", "TT2"):
        got = spikes.filter(F.col("source") == s).orderBy("spike_id").collect()
        assert [r["t"] for r in got] == tree["ephys"][s]["spikes"]["times"][0].tolist() and np.allclose([r["amp"] for r in got], tree["ephys"][s]["spikes"]["amplitudes"][0])
    with pytest.raises(ValueError, match="too few"):
        X.read_dataset(spark, file, 20)
    tree["ephys"]["TT2"]["spikes"]["times"] = (np.zeros(11), None, ())
    open(file, "wb").write(Builder(tree).bytes)
    with pytest.raises(ValueError, match="11 times and 12 amplitudes"):
        X.read_dataset(spark, file)


def test_acquisition_and_position_files(spark, tmp_path):
    at = np.arange(100, 200, 10, dtype="<u8")
    channels, ids = np.arange(10, dtype="u1") % 2, np.array([1, 1, 0, 0] * 2 + [1, 1], "u1")
    tree = {"recordings": {"0": {}, "1": {}}, "event_types": {"TTL": {"events": {"time_samples": (at, (4,), ()), "user_data": {"event_channels": (channels, None, ()), "eventID": (ids, None, ())}}}, "Messages": {"events": {"time_samples": (np.array([5, 60], "<u8"), None, ())}}}}
    file = str(tmp_path / "o.h5")
    open(file, "wb").write(Builder(tree, {"/recordings/0": {"sample_rate": np.float32(20)}, "/recordings/1": {"sample_rate": np.float32(5)}}).bytes)
    assert X.sample_rate(file) == 20 and X.sample_rate(file, 1) == 5 and X.start_time(file) == 3.0
    assert sorted(r["t"] for r in X.event_times(spark, file, 1).collect()) == [t / 20 for t, c, i in zip(at, channels, ids, strict=True) if c == 1 and i == 1]
    assert X.event_times(spark, file, 0, False).count() == sum((channels == 0) & (ids == 0))
    xy = R.normal(size=(9, 2))
    tree = {"time": (np.arange(9.0), None, ()), "position": (xy, (4, 2), ()), "diodes": {"red": (xy + 1, None, ()), "blue": (xy + 2, None, ())}}
    open(file, "wb").write(Builder(tree).bytes)
    got = X.read_position(spark, file).orderBy("index").collect()
    assert np.allclose([r["position"] for r in got], xy) and np.allclose([r["diodes"]["blue"] for r in got], xy + 2) and [r["time"] for r in got] == list(range(9))
