"""Training of a decoder: spikes and behaviour of the training time, attached, merged into mixtures by source, and saved."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.filestore import plain, store_of
from ..sources.records import mixture_bytes
from . import decoding as C
from . import density as D
from . import segments as S


@dataclass
class Encoded:
    """components (source, comp_id, weight, mean, var) with the position last, behavior (x: positions of the training time), counts (source, n: its spikes in the training time), seconds: duration of the training segments."""

    components: DataFrame
    behavior: DataFrame
    counts: DataFrame
    seconds: float


def encode(spikes: DataFrame, behavior: DataFrame, train: DataFrame, var: list[float], threshold: float, width: float, least: int = 10) -> Encoded:
    """spikes (source, id, t, x array of features) and behavior (t, linear_position) inside the segments train, as mixtures.

    Sources with more than least spikes there are merged, spike after spike in order of id, at the
    threshold; each spike has the position interpolated between behaviour of the training time as its last
    dimension, and spikes outside that time go. var: of the features, then of the position.
    """
    inside = S.contains(spikes, train.select("start", "stop"), width)
    where = S.contains(behavior.select("t", "linear_position"), train.select("start", "stop"), width)
    counts = inside.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    points = C.attach(C.included_sources(inside, least), where)
    samples = points.select("source", "id", F.concat(F.col("x").cast("array<double>"), F.array("linear_position")).alias("x"))
    seconds = train.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0.0
    return Encoded(D.merge_samples(samples, var, list(range(len(var))), threshold), where.select(F.col("linear_position").alias("x")), counts, float(seconds))


def save_mixtures(components: DataFrame, counts: DataFrame, folder: str, var: list[float] | None = None) -> list[str]:
    """A mixture file a source in folder, <source>.mixture, and their names. Tasks write beside the folder's files, which the new ones replace only when all are there; a failed job leaves none."""
    folder = plain(folder)
    store, temp = store_of(folder), f"{folder}/_writing-{uuid.uuid4().hex}"

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("comp_id")
        rows = [(float(w), list(m), (np.array([list(r) for r in c]) if c is not None else np.diag(v)).tolist()) for w, m, v, c in zip(pdf["weight"], pdf["mean"], pdf["var"], pdf["cov"], strict=True)]
        name = f"{pdf['source'].iloc[0]}.mixture"
        attempt = f"{name}.{uuid.uuid4().hex}"
        with store.create(f"{temp}/{attempt}") as f:
            f.write(mixture_bytes(rows, float(pdf["n"].iloc[0] or 0), float(pdf["weight"].sum()), None if var is None else np.diag(var).tolist()))
        return pd.DataFrame({"name": [name], "attempt": [attempt]})

    cov = F.col("cov") if "cov" in components.columns else F.lit(None).cast("array<array<double>>")
    rows = components.select("source", "comp_id", "weight", "mean", "var", cov.alias("cov")).join(counts.select("source", F.col("n").cast("double").alias("n")), "source", "left")
    try:
        done = rows.groupBy("source").applyInPandas(save, "name string, attempt string").collect()  # a row a source
        for r in done:
            store.move(f"{temp}/{r['attempt']}", f"{folder}/{r['name']}")
    finally:
        store.remove(temp)
    return sorted(r["name"] for r in done)
