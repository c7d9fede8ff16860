"""Conversions of recorded values and headers to physical units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file formats.
AMPLIFIER_RANGE, BIT_LEVELS = 10.0, 2048
UNITS = {"V": 1.0, "mV": 1e3, "uV": 1e6}
PROGRAMS = {"posextract": "diode", "spikeparms": "feature", "spikeparms2": "feature", "crextract": "feature"}
EXTRACTIONS = {"event strings": "event", "continuous data": "eeg", "extended dual diode position": "rawpos", "tetrode waveforms": "waveform"}


def seconds_to_ticks(t: Column) -> Column:
    return (t * 10000).cast("long")


def seconds_to_micros(t: Column) -> Column:
    return (t * 1000000).cast("long")


def volts_per_bit(gain: Column | float = 1.0) -> Column:
    return F.lit(AMPLIFIER_RANGE / BIT_LEVELS) / gain


def to_volts(raw: Column, gain: Column | float = 1.0, inverted: bool = True, units: str = "V") -> Column:
    """Samples in units, turned over again if they were recorded upside down."""
    return raw * volts_per_bit(gain) * ((-1 if inverted else 1) * UNITS[units])


def waveform_to_volts(waveform: Column, gains: Column, inverted: bool = True, units: str = "V") -> Column:
    """Samples by channels in units; gains by channel."""
    return F.transform(waveform, lambda row: F.zip_with(row, gains, lambda v, g: to_volts(v, g, inverted, units)))


def sample_times(buffer_time: Column, samples: Column, rate: Column | float) -> Column:
    """Ticks of a buffer's samples: whole steps from its own."""
    step = F.floor(F.lit(10000) / rate)
    return F.transform(F.sequence(F.lit(0), F.size(samples) - 1), lambda k: buffer_time + k * step)


def record_of(sample: Column, per_record: int) -> Column:
    """struct(record, offset) of a sample's number."""
    return F.struct(F.floor(sample / per_record).alias("record"), F.pmod(sample, F.lit(per_record)).alias("offset"))


def sample_of(record: Column, offset: Column, per_record: int) -> Column:
    return record * per_record + offset


def may_alias(header: dict) -> bool:
    """Whether a low-pass filter that is on lets more than half the sampling rate through."""
    return bool(header["DSPHighCutFilterEnabled"]) and 2 * float(header["DspHighCutFrequency"]) > float(header["SamplingFrequency"])


def enabled_channels(channels: int, header: dict) -> list[bool]:
    """False for the channels that a header lists as disabled."""
    off = {int(c) for c in header.get("DisabledSubChannels", []) if str(c).isdigit()}
    return [k not in off for k in range(channels)]


def file_type(header: dict[str, str]) -> str:
    """The kind of records that a text header announces, or 'unknown'."""
    if "File Format" in header:
        return header["File Format"]
    program = header.get("Program")
    if not program:
        return f"ad {header['adversion']}" if header.get("adversion") else "unknown"
    if program == "adextract":
        return EXTRACTIONS.get(header.get("Extraction type", ""), "unknown")
    if program.lower() in ("xclust", "xclust3"):
        return "cluster" if "Cluster" in header else "clbound"
    return PROGRAMS.get(program, "unknown")


def peaks(waveform: Column, inverted: bool = True) -> Column:
    """Largest sample of each channel, spikes being turned upwards."""
    up = F.lit(1.0 if inverted else -1.0)
    return F.transform(F.sequence(F.lit(0), F.size(waveform[0]) - 1), lambda c: F.array_max(F.transform(waveform, lambda row: up * row[c])))


def epochs_of(info: dict, session: str) -> dict[str, dict]:
    """The epochs of a session's info by id, each with the folder that holds it."""
    return {e["id"]: {**e, "path": f"{session}/epochs/{e['id']}"} for e in info.get("epochs", [])}


# Fixed values of the file formats: cut-offs in hertz by the bits of a filter code.
HIGH_PASS = {0: 0.1, 1: 1.0, 2: 10.0, 4: 100.0, 8: 300.0, 16: 600.0, 24: 900.0}
LOW_PASS = {0: 50.0, 32: 100.0, 256: 200.0, 512: 250.0, 288: 275.0, 544: 325.0, 768: 400.0, 800: 475.0, 64: 3000.0, 128: 6000.0, 192: 9000.0}
HIGH_BITS, LOW_BITS = 31, 992


def filter_of(code: Column) -> Column:
    """struct(low, high): the cut-offs of a filter code; null for bits that mean none."""
    pick = lambda table, bits: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), code.cast("int").bitwiseAND(bits))
    return F.struct(pick(HIGH_PASS, HIGH_BITS).alias("low"), pick(LOW_PASS, LOW_BITS).alias("high"))


def code_of(low: float, high: float) -> int:
    return next(k for k, v in HIGH_PASS.items() if v == low) + next(k for k, v in LOW_PASS.items() if v == high)
