"""What tape records mean: scene headers, accessory messages, data lines, and the files that an ingest leaves."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decode
from ..operators.signal import C
from . import binary, files, rpf

#: Fixed values of the tape format: record types.
DUMMY, SCENE, DATA, NULL, EOF = 0, 1, 2, 3, 15
#: Fixed values of the tape format: a scene header's fields as (name, byte, type). H, I and B are unsigned, h signed,
#: `p` a float with base 16, `t` four characters.
SCENE_FIELDS = [
    ("byte_count", 0, "H"), ("scene_number", 2, "H"), ("start_collect", 4, "I"), ("volume", 18, "H"), ("mission_id", 20, "t"), ("sar_mode", 25, "B"), ("unused_1", 26, "H"), ("time_t0", 28, "I"),
    ("pri", 32, "H"), ("target_select", 34, "B"), ("receiver_gain", 35, "B"), ("heading_t0", 36, "p"), ("velocity_t0", 40, "p"), ("track_angle_t0", 44, "p"), ("altitude_t0", 48, "I"),
    ("target_latitude_t0", 52, "p"), ("target_longitude_t0", 56, "p"), ("target_range_t0", 60, "I"), ("target_azimuth_t0", 64, "p"), ("target_depression_t0", 68, "p"), ("scene_range", 72, "I"),
    ("scene_eta", 76, "p"), ("scene_depression", 80, "p"), ("tau_amplitude", 84, "H"), ("radar_frequency", 86, "H"), ("pulse_width", 88, "H"), ("pri_change", 92, "B"),
    ("variable_delay", 93, "B"), ("phase_correction", 94, "B"), ("curvature_disabled", 95, "B"), ("control_version", 96, "t"), ("navigation_version", 100, "t"), ("unused_2", 104, "I"), ("end_code", 108, "H"),
]
#: Fixed values of the tape format: the longest header, lines of a scene, of a spotlight, and nanoseconds of a delay unit.
HEADER_BYTES, SCENE_LINES, SPOT_LINES, DELAY_NS = 122, 32772, 12448, 20.0 / 256.0
#: Fixed values of the tape format: where an accessory record's messages stand, and how one looks.
MESSAGES = slice(528, 2576)
MESSAGE = re.compile(rb"TR(.{6})(.{8})(.{9})(.{8})(?:\n\r|\r\n)", re.DOTALL)


def _unsigned(payload: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(payload, at + 1, size)), 16, 10).cast("long")


def _signed(payload: Column, at: int, size: int) -> Column:
    raw = _unsigned(payload, at, size)
    return F.when(raw >= 1 << (8 * size - 1), raw - (1 << (8 * size))).otherwise(raw)


def scene_headers(tape: DataFrame) -> DataFrame:
    """The decoded scene headers among tape records: path, ordinal and one column a field; all within the JVM.

    Delays are nanoseconds (coarse and fine parts joined); the sampling code
    255 stands for 500 MHz and 31 for 31.25; a rate of 22 for 22.5.
    """
    raw = F.col("payload")

    def field(at: int, kind: str) -> Column:
        if kind == "t":
            return F.decode(F.substring(raw, at + 1, 4), "ISO-8859-1")
        if kind == "p":
            return decode.base16_float(_unsigned(raw, at, 4))
        return _unsigned(raw, at, {"B": 1, "H": 2, "I": 4}[kind])

    code, rate = _unsigned(raw, 24, 1), _unsigned(raw, 90, 2)
    own = {n: field(at, kind) for n, at, kind in SCENE_FIELDS}
    own["byte_count"] = F.least(own["byte_count"], F.lit(HEADER_BYTES))
    own |= {
        "initial_delay_ns": (256.0 * _unsigned(raw, 8, 3) + _unsigned(raw, 11, 1)) * DELAY_NS,
        "delay_step_ns": _signed(raw, 12, 2) * DELAY_NS,
        # a byte without sign and one with it; negative sums wrap
        "spot_pulses": F.pmod(256 * _unsigned(raw, 14, 1) + _signed(raw, 15, 1), F.lit(65536)),
        "strip_end": F.pmod(256 * _signed(raw, 16, 1) + _signed(raw, 17, 1) + 32768, F.lit(65536)) - 32768,
        "sampling_mhz": F.when(code == 255, 500.0).when(code == 31, 31.25).otherwise(code.cast("double")),
        "fm_rate_mhz_us": F.when(rate == 22, 22.5).otherwise(rate.cast("double")),
    }
    return tape.where((F.col("type") == SCENE) & (F.octet_length("payload") >= 110)).select("path", "ordinal", *[c.alias(n) for n, c in own.items()])


def expected_lines(mode: Column, strip_end: Column, spot_pulses: Column) -> Column:
    """Data lines that a scene header promises: of several scenes a fixed number (bit 16) or up to the strip's end,
    of a spotlight its pulses up to 12448; null where that is not positive."""
    several = mode.bitwiseAND(1) != 0
    n = F.when(several, F.when(mode.bitwiseAND(16) != 0, SCENE_LINES).otherwise(strip_end)).otherwise(F.least(F.lit(SPOT_LINES), spot_pulses))
    return F.when(n > 0, n)


def scene_parameters(headers: DataFrame, lines: Column | int, complex_samples: bool = True) -> DataFrame:
    """The derived parameters of scene headers in SI units; what can't be derived is 0."""
    n = F.lit(lines) if isinstance(lines, int) else lines
    carrier = F.col("radar_frequency") * 1e6
    return headers.select(
        "path",
        carrier.alias("carrier_hz"),
        F.when(carrier > 0, C / carrier).otherwise(0.0).alias("wavelength_m"),
        (F.col("pulse_width") * 1e-9).alias("pulse_s"),
        (F.col("sampling_mhz") * 1e6).alias("sampling_hz"),
        (F.col("fm_rate_mhz_us") * 1e12).alias("fm_rate_hz_s"),
        F.col("velocity_t0").alias("velocity_m_s"),
        F.col("scene_range").cast("double").alias("range_m"),
        F.radians("scene_eta").alias("eta_rad"),
        F.when(F.col("pri") > 0, 1 / (F.col("pri") * 1e-6)).otherwise(0.0).alias("prf_hz"),
        n.cast("long").alias("lines"),
        F.lit((binary.RECORD - binary.HEADER - binary.RAMP) // 2).alias("samples"),
        F.lit("c" if complex_samples else "s").alias("data_type"),
    )


def target_messages(spark: SparkSession, path: str) -> DataFrame:
    """The target positions in the accessory records of tapes: path, nth, range, time (from hex), longitude and latitude as written."""

    def rows(r: dict) -> Iterator[tuple]:
        with files.opened(files.uri(r["path"])) as f:
            head = f.read_at(min(f.size(), binary.ACCESSORY + 4), 0)
        sync = binary.SYNC.to_bytes(4, "big")
        if head[:4] == sync or head[binary.ACCESSORY : binary.ACCESSORY + 4] != sync:
            return
        for nth, found in enumerate(MESSAGE.finditer(head[MESSAGES])):
            distance, time, lon, lat = (x.decode("latin-1").strip(" \0") for x in found.groups())
            number = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", distance)
            code = re.match(r"\s*(0[xX])?([0-9a-fA-F]+)", time)
            yield r["path"], nth, float(number[0]) if number else 0.0, int(code[2], 16) if code else 0, lon, lat

    return rpf._mapped(files.listed(spark, path).select("path"), rows, "path string, nth int, range double, time long, longitude string, latitude string")


def kept_records(tape: DataFrame, fatal: bool) -> DataFrame:
    """Records of each file up to its first bad sync word if that is fatal, else all of them."""
    if not fatal:
        return tape
    bad = tape.where("not sync_valid").groupBy(F.col("path").alias("_file")).agg(F.min("ordinal").alias("_bad"))
    return tape.join(bad, F.col("path") == F.col("_file"), "left").where("_bad is null or ordinal < _bad").drop("_bad", "_file")


def data_lines(tape: DataFrame, fatal: bool = True) -> DataFrame:
    """The data records of each file that an ingest takes, with `line` from 0: in order, up to a fatal record, and as many as the
    scene header before them promises. Other record types carry no lines."""
    kept = kept_records(tape, fatal)
    scenes = scene_headers(kept).groupBy(F.col("path").alias("_file")).agg(F.max_by(expected_lines(F.col("sar_mode"), F.col("strip_end"), F.col("spot_pulses")), "ordinal").alias("_expected"))
    data = kept.where(F.col("type") == DATA)
    # lines are numbered within runs of 32768 records, and get the count of the runs before
    run = F.floor(F.col("ordinal") / 32768)
    counts = data.groupBy(F.col("path").alias("_p"), run.alias("_r")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_p", "_r", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("path", "_run").orderBy("ordinal")) - 1
    lined = data.withColumn("_run", run).withColumn("_nth", own).join(F.broadcast(counts), (F.col("path") == F.col("_p")) & (F.col("_run") == F.col("_r")))
    lined = lined.join(F.broadcast(scenes), F.col("path") == F.col("_file"), "left").withColumn("line", F.col("_before") + F.col("_nth"))
    return lined.where("_expected is null or line < _expected").select(*tape.columns, "line")


def complex_lines(lines: DataFrame) -> DataFrame:
    """path, line, time, re and im of data lines: signed byte pairs, 972 samples; an odd last byte is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode.iq_pairs(x or b"") for x in batch.column(3).to_pylist()]
            cuts = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            flat = np.concatenate(found) if found else np.zeros(0, complex)
            parts = (pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.float32))) for x in (flat.real, flat.imag))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *parts], ["path", "line", "time", "re", "im"])

    return lines.select("path", "line", "time", "payload").mapInArrow(run, "path string, line long, time long, re array<float>, im array<float>")


def magnitude_lines(lines: DataFrame) -> DataFrame:
    """|I + jQ| of each record's signed byte pairs: (path, line, values), within the JVM.

    Bytes are read from the payload's hex digits; an odd last byte is dropped.
    """
    digits = F.hex("payload")
    count = F.floor(F.octet_length("payload") / 2).cast("int")

    def signed(at: Column) -> Column:
        value = F.conv(F.substr(digits, at, F.lit(2)), 16, 10).cast("int")
        return F.when(value > 127, value - 256).otherwise(value).cast("double")

    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return lines.select("path", "line", F.transform(places, lambda k: F.hypot(signed(k * 4 + 1), signed(k * 4 + 3))).alias("values"))


def to_product(spark: SparkSession, tape_path: str, path: str, fatal: bool = True, grid_lines: int = 4) -> int:
    """One tape as a product of whole-number magnitudes (pixel type 2), a line for each data record; returns the lines."""
    lines = data_lines(binary.read(spark, "sartape", tape_path), fatal)
    height = lines.count()
    if not height:
        raise ValueError("the tape has no data lines")
    width = (binary.RECORD - binary.HEADER - binary.RAMP) // 2
    pixels = magnitude_lines(lines).select(F.col("line").alias("row"), F.posexplode("values").alias("col", "value"))
    rpf.write(pixels, path, height, width, 2, grid=rpf.flat_lines(1, height, grid_lines))
    return height


def ingest(spark: SparkSession, tape_path: str, prefix: str, complex_samples: bool = False, fatal: bool = True) -> int:
    """One tape as prefix.dat (samples), .vts (time stamps), .hdr and .ssp (JSON); returns the lines.

    Samples are the record's 1944 signed bytes, or 972 complex floats. The
    bytes around them, which are not samples, are not written.
    """
    tape = binary.read(spark, "sartape", tape_path)
    lines = data_lines(tape, fatal)
    n = lines.count()
    if complex_samples:
        re_im = F.arrays_zip("re", "im")
        flat = complex_lines(lines).select(F.col("line").alias("row"), F.flatten(F.transform(re_im, lambda v: F.array(v["re"], v["im"]))).alias("v"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, "<f4").tobytes() for v in batch.column(1).to_pylist()], pa.binary())], ["row", "bytes"])

        samples = flat.mapInArrow(packed, "row long, bytes binary")
    else:
        samples = lines.select(F.col("line").alias("row"), F.col("payload").alias("bytes"))
    files.write_rows(samples, f"{prefix}.dat", n)
    files.write_rows(lines.select(F.col("line").alias("row"), F.concat(F.col("time").cast("string"), F.lit("\n")).cast("binary").alias("bytes")), f"{prefix}.vts", n)
    headers = scene_headers(kept_records(tape, fatal)).orderBy(F.desc("ordinal")).limit(1)
    head = [json.loads(x) for x in headers.drop("path", "ordinal").toJSON().collect()]
    if head:
        messages = [json.loads(x) for x in target_messages(spark, tape_path).orderBy("nth").drop("path", "nth").toJSON().collect()]
        found = head[0] | ({"target_positions": messages} if messages else {})
        ssp = json.loads(scene_parameters(headers, n, complex_samples).drop("path").toJSON().first())
        files.write_bytes(f"{prefix}.hdr", (json.dumps(found, indent=2) + "\n").encode())
        files.write_bytes(f"{prefix}.ssp", (json.dumps(ssp, indent=2) + "\n").encode())
    return n
