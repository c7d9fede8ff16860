"""The record source and sink: ranges, pushed time filters, commits and aborts, conversion of packets, mixtures trained and saved."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import encoding as N
from tempora.sources import filestore, recordfiles as X
from tempora.sources import records as R

FIELDS = "timestamp,8,4,1\tpos,2,2,2\tgrid,5,8,[2 3]\tlabel,10,1,6"
LAYOUT = R.layout_of(FIELDS)


def some(n):
    rows = np.zeros(n, LAYOUT)
    rows["timestamp"] = 5 * np.arange(n)
    rows["pos"] = np.arange(2 * n).reshape(n, 2) - n
    rows["grid"] = np.arange(6 * n).reshape(n, 2, 3) / 7
    rows["label"] = [f"e{k % 9}" for k in range(n)]
    return rows


def as_tuples(df):
    return [(r["record"], round(r["time"], 9), list(r["pos"]), [list(x) for x in r["grid"]], r["label"]) for r in df.orderBy("record").collect()]


def wanted(rows, first=0):
    return [(first + k, round(float(r["timestamp"]) / 1e4, 9), r["pos"].tolist(), r["grid"].tolist(), r["label"].decode()) for k, r in enumerate(rows)]


@pytest.fixture
def headed(tmp_path):
    rows = some(1000)
    path = tmp_path / "a.dat"
    path.write_bytes(X.header_bytes(FIELDS, {"Program": "adextract", "rate": "32"}) + rows.tobytes() + b"broken")
    return str(path), rows


def test_records_by_the_files_header_in_many_partitions(spark, headed):
    path, rows = headed
    df = X.read(spark, path, partitionbytes=LAYOUT.itemsize * 64)
    assert df.columns == ["path", "record", "time", *LAYOUT.names] and df.rdd.getNumPartitions() == 16
    assert as_tuples(df) == wanted(rows) and {r["path"] for r in df.select("path").distinct().collect()} == {path}
    assert df.filter("label = 'e3'").count() == sum(r["label"] == b"e3" for r in rows)


@pytest.mark.parametrize(("low", "high"), [(0.1, 0.2), (-5, 0.0), (0.4995, 9), (0.2, 0.1), (0.10001, 0.10001), (-np.inf, np.inf)])
def test_time_filter_reads_its_range_only(spark, headed, low, high):
    path, rows = headed
    t = rows["timestamp"] / 1e4
    inside = np.flatnonzero((t >= low) & (t <= high))
    want = wanted(rows[inside], int(inside[0]) if len(inside) else 0)
    assert as_tuples(X.read(spark, path, float(low), float(high))) == want
    assert as_tuples(X.read(spark, path).filter(F.col("time").between(float(low), float(high)))) == want
    source = X.RecordSource({"path": path})
    reader = source.reader(None)
    list(reader.pushFilters([X.GreaterThanOrEqual(("time",), low), X.LessThan(("time",), high), X.GreaterThan(("record",), 3)]))
    assert sum(p.hi - p.lo for p in reader.partitions()) == len(inside)


class Counting:
    """A store that counts the bytes that are read."""

    def __init__(self):
        self.local, self.bytes = filestore.Local(), 0

    def __getattr__(self, name):
        return getattr(self.local, name)

    def open(self, path):
        outer, f = self, self.local.open(path)
        read = f.read

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

            def seek(self, *a):
                return f.seek(*a)

            def read(self, *a):
                out = read(*a)
                outer.bytes += len(out)
                return out

        return File()


def test_a_file_of_3_gb_is_split_and_a_second_of_it_read(spark, tmp_path):
    layout = np.dtype(R.LAYOUTS["csc"])
    n = 3 * (1 << 30) // layout.itemsize + 1
    path = f"{tmp_path}/big.ncs"
    one = np.zeros(1, layout)
    one["samplefreq"], one["numvalidsamples"] = 32000, 512
    with open(path, "wb") as f:  # sparse: only records that a search looks at have their times
        f.write(b"######## file\r\n-FileType CSC\r\n-ADBitVolts 1e-8\r\n".ljust(R.ACQUISITION_HEADER))
        f.truncate(R.ACQUISITION_HEADER + n * layout.itemsize)
        stamp = lambda k: 16_000 * k
        look, goal = set(), (1_000_000, 1_000_063)
        for g in goal:
            lo, hi = 0, n
            while lo < hi:
                mid = (lo + hi) // 2
                look.add(mid)
                lo, hi = (mid + 1, hi) if mid < g else (lo, mid)
            look |= {g - 1, g, g + 1}
        for k in sorted(look | set(range(*goal))):
            one["timestamp"] = stamp(k)
            f.seek(R.ACQUISITION_HEADER + k * layout.itemsize)
            f.write(one.tobytes())
    source = X.RecordSource({"path": path})
    source.store = Counting()
    whole = source.reader(None)
    assert len(whole.partitions()) > 40 and source.store.bytes < 1 << 21
    bounded = X.RecordReader(*source.form(), source.store, {"start": str(stamp(goal[0]) / 1e6), "stop": str(stamp(goal[1] - 1) / 1e6)})
    source.store.bytes = 0
    parts = bounded.partitions()
    assert [(p.lo, p.hi) for p in parts] == [goal] and sum(b.num_rows for b in bounded.read(parts[0])) == 63
    assert source.store.bytes < 200 * layout.itemsize
    got = X.read(spark, path, stamp(goal[0]) / 1e6, stamp(goal[1] - 1) / 1e6)
    assert got.count() == 63 and got.select(F.min("record"), F.max("record")).first() == (goal[0], goal[1] - 1)


def test_acquisition_files_by_name_and_ending(spark, tmp_path):
    pad = lambda text: text.encode().ljust(R.ACQUISITION_HEADER)
    tetrode = np.zeros(3, R.spike_layout(32, 4))
    tetrode["timestamp"] = [1_000_000, 2_000_000, 3_000_000]
    (tmp_path / "t.ntt").write_bytes(pad("") + tetrode.tobytes())
    single = np.zeros(2, R.spike_layout(16, 1))
    (tmp_path / "s.dat").write_bytes(pad("-FileType Spike\n-NumADChannels 1\n-WaveformLength 16\n") + single.tobytes())
    got = X.read(spark, f"{tmp_path}/t.ntt").filter("time >= 2").orderBy("record").collect()
    assert [r["time"] for r in got] == [2.0, 3.0] and np.shape(got[0]["waveform"]) == (32, 4)
    assert np.shape(X.read(spark, f"{tmp_path}/s.dat").first()["waveform"]) == (16, 1)
    raw = np.zeros(2, X.tahiti_layout(2, 3))
    raw["seconds"], raw["nanoseconds"], raw["data"] = [5, 6], [500_000_000, 0], np.arange(12).reshape(2, 3, 2)
    (tmp_path / "r.moz").write_bytes(pad("-NumADChannels 2\n-SamplesPerRecord 3\n-SamplingFrequency 10\n") + raw.tobytes())
    records = X.read(spark, f"{tmp_path}/r.moz", start=5.2)
    assert [(r["record"], r["k"], round(r["time"], 6), list(r["values"])) for r in X.samples_by_time(records, 10.0).orderBy("record", "k").collect()] == [(0, 0, 5.5, [0, 1]), (0, 1, 5.6, [2, 3]), (0, 2, 5.7, [4, 5]), (1, 0, 6.0, [6, 7]), (1, 1, 6.1, [8, 9]), (1, 2, 6.2, [10, 11])]
    fields = "timestamp,8,4,1\txfront,2,2,1\tyfront,2,2,1\txback,2,2,1\tyback,2,2,1"
    led = np.array([(10_000, 1, 2, 3, 4)], R.layout_of(fields))
    (tmp_path / "d.p").write_bytes(X.header_bytes(fields, {"File Format": "diode"}) + led.tobytes())
    row = X.diodes(X.read(spark, f"{tmp_path}/d.p")).first()
    assert (row["time"], tuple(row["front"]), tuple(row["back"])) == (1.0, (1, 2), (3, 4))
    for bad in (b"%%BEGINHEADER\n% x: 1\n", b"no header"):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(Exception, match="header"):
            X.read(spark, f"{tmp_path}/bad.bin").count()
    with pytest.raises(Exception, match="nothing"):
        X.read(spark, f"{tmp_path}/nothing*").count()


def test_written_records_come_back_in_order_and_append(spark, tmp_path, headed):
    path, rows = headed
    folder = f"{tmp_path}/out"
    df = X.read(spark, path).repartitionByRange(5, "record").sortWithinPartitions("record")
    X.write(df, folder, FIELDS, headed="true")
    assert as_tuples(X.read(spark, folder)) == wanted(rows)
    assert as_tuples(X.read(spark, folder, 0.1, 0.11)) == wanted(rows)[200:221]
    X.write(df.filter("record < 10"), folder, FIELDS, headed="true")
    more = X.read(spark, folder)
    assert more.count() == 1010 and as_tuples(more)[1000:] == [(1000 + k, *r[1:]) for k, r in enumerate(wanted(rows)[:10])]
    parts = [f for f in os.listdir(folder) if f.endswith(".rec")]
    assert all(X.text_header(open(f"{folder}/{p}", "rb").read())[0]["Fields"] == FIELDS for p in parts) and not [f for f in os.listdir(folder) if f.startswith("_writing")]
    one = f"{tmp_path}/one.dat"
    assert X.assemble(spark, folder, one) == 1010
    held = open(one, "rb").read()
    assert held[X.text_header(held)[1] :] == rows.tobytes() + rows[:10].tobytes() and as_tuples(X.read(spark, one)) == as_tuples(more)
    X.write(df.filter("record < 3"), folder, FIELDS, "overwrite", headed="true")
    assert as_tuples(X.read(spark, folder)) == wanted(rows)[:3] and len(os.listdir(folder)) == 1 + len(X.manifest(filestore.Local(), folder)["parts"])
    X.write(df.limit(0), folder, FIELDS, "overwrite")
    assert X.read(spark, folder).count() == 0
    with pytest.raises(Exception, match="another layout"):
        X.write(df.select("record"), folder, "record,12,8,1")


def test_failed_tasks_leave_nothing(spark, tmp_path, headed):
    path, rows = headed
    folder = f"{tmp_path}/out"
    df = X.read(spark, path).repartitionByRange(4, "record").sortWithinPartitions("record")
    X.write(df.filter("record < 20"), folder, FIELDS)
    for bad in (F.when(F.col("record") == 700, F.lit(None)).otherwise(F.col("timestamp")), F.when(F.col("record") == 700, -1).otherwise(F.col("timestamp")), F.when(F.col("record") == 700, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("timestamp"))):
        with pytest.raises(Exception):  # noqa: B017
            X.write(df.withColumn("timestamp", bad), folder, FIELDS)
        assert as_tuples(X.read(spark, folder)) == wanted(rows)[:20] and not [f for f in os.listdir(folder) if f.startswith("_writing")]
    with pytest.raises(Exception, match="entries"):
        X.write(df.withColumn("pos", F.array(F.lit(1))), folder, FIELDS)
    with pytest.raises(Exception, match="no columns"):
        X.write(df.drop("pos"), folder, FIELDS)


def test_packets_to_a_signal_and_back(spark, tmp_path):
    words, n = 4, 500
    samples = np.random.default_rng(1).integers(0, 1024, (n, 3 * words))
    packets = np.zeros(n, np.dtype([("sync", ">u4"), ("counter", ">u4", 2), ("samples", ">u4", words)]))
    packets["samples"] = samples[:, 0::3] | samples[:, 1::3] << 10 | samples[:, 2::3] << 20
    (tmp_path / "p.nsk").write_bytes(packets.tobytes())
    X.convert(spark, f"{tmp_path}/p.nsk", f"{tmp_path}/all", counters=2, words=words)
    X.convert(spark, f"{tmp_path}/p.nsk", f"{tmp_path}/some", [0, 4, 11], 123, counters=2, words=words)
    assert np.array([r["signal"] for r in X.read(spark, f"{tmp_path}/all").orderBy("record").collect()]).tolist() == samples.tolist()
    X.assemble(spark, f"{tmp_path}/some", f"{tmp_path}/some.bin")
    assert np.fromfile(f"{tmp_path}/some.bin", "<i2").reshape(-1, 3).tolist() == samples[:123, [0, 4, 11]].tolist()
    with pytest.raises(Exception, match="(?i)exist"):
        X.convert(spark, f"{tmp_path}/p.nsk", f"{tmp_path}/all", counters=2, words=words)


def test_mixtures_are_trained_and_saved(spark, tmp_path):
    r = np.random.default_rng(2)
    t = np.arange(0, 100, 0.5)
    behavior = spark.createDataFrame([(float(x), float(3 * x)) for x in t], "t double, linear_position double")
    spikes = [(s, k, float(u), [float(v)]) for s, n in (("tt1", 60), ("tt2", 40), ("few", 3)) for k, (u, v) in enumerate(zip(r.uniform(0, 100, n), r.normal(size=n), strict=True))]
    df = spark.createDataFrame(spikes, "source string, id long, t double, x array<double>")
    train = spark.createDataFrame([("run", 10.0, 40.0), ("run", 60.0, 90.0)], "set_id string, start double, stop double")
    got = N.encode(df, behavior, train, [0.1, 4.0], 0.0, 30.0, 5)
    inside = lambda u: 10 <= u < 40 or 60 <= u < 90
    assert got.seconds == 60 and {x["source"]: x["n"] for x in got.counts.collect()} == {s: sum(inside(u) for q, _, u, _ in spikes if q == s) for s in ("tt1", "tt2", "few") if any(inside(u) for q, _, u, _ in spikes if q == s)}
    # threshold 0 merges nothing, so components are the samples with their places
    want = sorted((s, round(v[0], 6), round(3 * u, 6)) for s, _, u, v in spikes if s != "few" and inside(u) and (u <= 39.5 or u >= 60) and u <= 89.5)
    both = sorted((c["source"], round(c["mean"][0], 6), round(c["mean"][1], 6)) for c in got.components.collect())
    assert [w for w in want if w in both] == want and {b[0] for b in both} == {"tt1", "tt2"}
    assert N.save_mixtures(got.components, got.counts, f"{tmp_path}/m", [0.1, 4.0]) == ["tt1.mixture", "tt2.mixture"]
    again = R.read_mixtures(spark, f"{tmp_path}/m/*.mixture")
    key = lambda c: (c["source"], c["comp_id"], round(c["weight"], 12), [round(v, 9) for v in c["mean"]], [round(v, 9) for v in c["var"]])
    assert sorted(map(key, again.collect())) == sorted(map(key, got.components.collect()))
    n, weights, comps = R.parse_mixture(open(f"{tmp_path}/m/tt1.mixture", "rb").read())
    assert n == got.counts.filter("source = 'tt1'").first()["n"] and abs(weights - 1) < 1e-12 and comps
    broken = got.components.withColumn("mean", F.when(F.col("source") == "tt2", F.raise_error(F.lit("broken")).cast("array<double>")).otherwise(F.col("mean")))
    before = sorted(os.listdir(f"{tmp_path}/m"))
    with pytest.raises(Exception, match="broken"):
        N.save_mixtures(broken, got.counts, f"{tmp_path}/m")
    assert sorted(os.listdir(f"{tmp_path}/m")) == before


def test_stores_by_uri(tmp_path):
    here, there = filestore.Local(), filestore.store_of(f"file://{tmp_path}/x")
    assert isinstance(there, filestore.Remote) and filestore.plain("file:///a/b/") == "/a/b"
    uri = f"file://{tmp_path}/x"
    with there.create(f"{uri}/one.rec") as f:
        f.write(b"abc")
    there.move(f"{uri}/one.rec", f"{uri}/two.rec")
    assert [f.split("/")[-1] for f in there.files(uri)] == ["two.rec"] == [f.split("/")[-1] for f in here.files(f"{tmp_path}/x")]
    assert there.exists(f"{uri}/two.rec") and not there.exists(f"{uri}/one.rec") and there.size(f"{uri}/two.rec") == 3
    with there.open(f"{uri}/two.rec") as f:
        f.seek(1)
        assert f.read() == b"bc"
    there.remove(f"{uri}/two.rec")
    there.remove(uri)
    assert not there.exists(uri) and not os.path.exists(f"{tmp_path}/x")
