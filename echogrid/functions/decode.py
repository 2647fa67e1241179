"""Decoders of stored number formats, as columns or NumPy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def base16_float(word: Column) -> Column:
    """A 32-bit float with base 16: sign bit, 7 exponent bits (excess 64), 24 fraction bits; word is a long."""
    sign = F.when(F.shiftright(word, 31).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(word, 24).bitwiseAND(127).cast("int") - 64
    return sign * (word.bitwiseAND(0xFFFFFF) / F.lit(float(1 << 24))) * F.pow(F.lit(16.0), exponent)


def packed_time(high: Column, low: Column) -> Column:
    """12-bit year, month, day, hour, minute, second and 10-bit millisecond in two 32-bit words; null where the date is none."""
    whole = F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(0xFFFFFFFF))

    def field(shift: int, bits: int) -> Column:
        return F.shiftrightunsigned(whole, shift).bitwiseAND((1 << bits) - 1)

    year, month, day = field(52, 12), field(48, 4), field(43, 5)
    hour, minute, second, milli = field(38, 5), field(32, 6), field(26, 6), field(16, 10)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%03d", year, month, day, hour, minute, second, milli)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))


def iq_pairs(payload: bytes) -> np.ndarray:
    """Signed byte pairs (I, Q) as complex numbers; an odd last byte is dropped."""
    x = np.frombuffer(payload, np.int8)
    x = x[: len(x) // 2 * 2].astype(np.float64)
    return x[::2] + 1j * x[1::2]


def half_bytes(values: np.ndarray, truncate: bool = False) -> bytes:
    """Big-endian half floats: rounded to nearest, or with the mantissa cut off as some writers do."""
    x = np.asarray(values, np.float32)
    if not truncate:
        with np.errstate(over="ignore"):
            return x.astype(">f2").tobytes()
    nearest = x.astype(np.float16)
    over = np.abs(nearest.astype(np.float32)) > np.abs(x)
    cut = nearest.copy()
    cut[over] = (nearest[over].view(np.uint16) - 1).view(np.float16)
    cut[~np.isfinite(x)] = nearest[~np.isfinite(x)]
    cut[np.abs(x) >= 65536] = (np.sign(x) * np.inf)[np.abs(x) >= 65536].astype(np.float16)
    cut.view(np.uint16)[np.isnan(x)] = 0x7FFF
    return cut.astype(">f2").tobytes()


#: Big-endian pixel formats by type number.
PIXELS = {0: ">u1", 1: ">u2", 2: ">u4", 3: ">f4", 4: ">f2", 5: ">c8", 6: ">f2"}


def pixels(payload: bytes, width: int, height: int, kind: int) -> np.ndarray:
    """A matrix of pixels; complex types become magnitudes. Wrong sizes and types are errors."""
    if width <= 0 or height <= 0:
        raise ValueError("the image has no size")
    if kind not in PIXELS:
        raise ValueError(f"unknown pixel type {kind}")
    per = 2 if kind == 6 else 1
    need = width * height * per * np.dtype(PIXELS[kind]).itemsize
    if len(payload) < need:
        raise ValueError("the image is cut short")
    x = np.frombuffer(payload[:need], PIXELS[kind])
    if kind == 5:
        x = np.abs(x)
    elif kind == 6:
        x = np.hypot(x[::2].astype(np.float32), x[1::2].astype(np.float32))
    return x.astype(np.float32).reshape(height, width)
