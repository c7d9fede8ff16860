"""The online loop as a stateful stream: event gate, low-activity skips, p-value over the last bins and cumulative score, by session."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.surrogates import Ring, least_p

OUT = "session string, bin long, mua double, detected boolean, p double, score double"
STATE = "last long, run int, armed boolean, detected boolean, skips int, score double, grid int, logs binary, at binary, weight binary"
IN = ("bin", "mua", "pax", "own", "minus")


@dataclass(frozen=True)
class Rules:
    """Threshold and run of the gate, spikes below which a bin is skipped, skips that clear, windows tested, level of p, surrogates (the first is the truth), rows of the ring that they draw from, and their seed."""

    threshold: float = 8.1
    consecutive: int = 3
    least: int = 3
    skips: int = 3
    windows: tuple[int, ...] = (5, 6, 7, 8, 9, 10)
    level: float = 0.05
    shuffles: int = 1001
    ring: int = 5000
    seed: int = 0

    def start(self) -> Ring:
        return Ring(self.ring, self.shuffles, self.seed, max(self.windows))


#: (last bin, run, armed, detected, skips, score) before the first bin.
START = (-1, 0, True, False, 0, 0.0)


def step(state: tuple, ring: Ring, row: tuple, rules: Rules, states: np.ndarray) -> tuple[tuple, tuple]:
    """(state, output) after one bin (bin, mua, pax, own, minus), which ring takes in; a bin not after the last one is late and only passes the score on."""
    last, run, armed, detected, skips, score = state
    at, mua, pax, own, minus = row
    if at <= last:
        return state, (at, mua, detected, 1.0, score)
    run, armed = (run + 1, armed) if mua >= rules.threshold and armed else (run, armed) if mua >= rules.threshold else (0, True)
    if run >= rules.consecutive:
        run, armed, detected, score = 0, False, True, 0.0
    if mua < rules.least or not len(pax):
        skips += 1
        if skips >= rules.skips:
            detected, score = False, 0.0
        return (at, run, armed, detected, skips, score), (at, mua, detected, 1.0, score)
    ready = ring.update(np.array(list(pax), float), np.array(own, np.int64), np.array(minus, float)) is not None
    value = least_p(ring, rules.windows, states)[1] if detected and ready else 1.0
    if value < rules.level:
        score -= math.log(value)
    return (at, run, armed, detected, 0, score), (at, mua, detected, value, score)


def taken(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Rows of bins in order."""
    pdf = pdf.sort_values("bin")
    for bin_, mua, pax, own, minus in zip(*(pdf[c] for c in IN), strict=True):
        yield int(bin_), float(mua), () if pax is None else pax, own, minus


def assess_stream(bins: DataFrame, states: np.ndarray, rules: Rules = Rules()) -> DataFrame:
    """bins (session string, bin long, mua double, pax, own, minus), a stream, with each bin's verdict; a session's batch is taken in order of bin.

    The state of a session is its ring, bounded by rules.ring rows of the grid, and its last bins' likeliest
    points; the oldest rows go as new ones come.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(group.get) if group.exists else None
        state, ring = (held[:6], rules.start().unpack(*held[6:])) if held else (START, rules.start())
        out = []
        for row in taken(pd.concat(list(batches))):
            state, got = step(state, ring, row, rules, states)
            out.append((key[0], *got))
        group.update((*state, *ring.pack()))
        yield pd.DataFrame(out, columns=["session", "bin", "mua", "detected", "p", "score"])

    return bins.select("session", *IN).groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def assess_batch(bins: DataFrame, states: np.ndarray, rules: Rules = Rules()) -> DataFrame:
    """The same over a table: a session is one task's work, bin after bin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, ring, out, session = START, rules.start(), [], pdf["session"].iloc[0]
        for row in taken(pdf):
            state, got = step(state, ring, row, rules, states)
            out.append((session, *got))
        return pd.DataFrame(out, columns=["session", "bin", "mua", "detected", "p", "score"])

    return bins.select("session", *IN).groupBy("session").applyInPandas(run, OUT)


def shuffle_test(bins: DataFrame, states: np.ndarray, rules: Rules = Rules()) -> DataFrame:
    """(session, bin, rwd, p) of each bin once the ring is full, without gate: the truth's correlation over the longest of rules.windows that has bins, and the least p over them all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring, out, session = rules.start(), [], pdf["session"].iloc[0]
        for bin_, _, pax, own, minus in taken(pdf):
            if len(pax) and ring.update(np.array(list(pax), float), np.array(own, np.int64), np.array(minus, float)) is not None:
                out.append((session, bin_, *least_p(ring, rules.windows, states)))
        return pd.DataFrame(out, columns=["session", "bin", "rwd", "p"])

    return bins.select("session", *IN).groupBy("session").applyInPandas(run, "session string, bin long, rwd double, p double")


def windowed_rates(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, train, n, total) of a stream of events (ts timestamp, train, mark) in tumbling windows; later rows than the watermark are dropped."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "train").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("total")).select(F.col("window.start").alias("start"), "train", "n", "total")


def replay(source: DataFrame | list[DataFrame], folder: str, build, schema: StructType | None = None) -> DataFrame:
    """build(stream) run to the end over a table, or several that come one after another, written to folder as a file stream and its output read back: for tests and queries over tables."""
    import uuid

    parts = source if isinstance(source, list) else [source]
    spark = parts[0].sparkSession
    path, name = f"{folder}/{uuid.uuid4().hex}", f"replay_{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema or parts[0].schema)
    stream = (stream.option("maxFilesPerTrigger", 1) if len(parts) > 1 else stream).parquet(f"{path}/in")
    query = build(stream).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).queryName(name).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{path}/out")
