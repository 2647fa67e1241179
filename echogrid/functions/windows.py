"""Window functions: weights as NumPy vectors, and the same as array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hann(count: int) -> np.ndarray:
    """Symmetric Hann weights; ones for two samples or fewer."""
    return np.hanning(count) if count > 2 else np.ones(count)


def taylor_cosines(nbar: int = 4, sidelobe_db: float = 35.0) -> np.ndarray:
    """The amplitudes of the Taylor weights' nbar - 1 cosines, which follow from the pattern's zeros."""
    if not 2 <= nbar <= 32 or not 15 <= sidelobe_db <= 120:
        raise ValueError("nbar must be in [2, 32] and the sidelobes in [15, 120] dB")
    a = np.arccosh(10 ** (sidelobe_db / 20)) / np.pi
    m = np.arange(1, nbar)
    sigma2 = nbar**2 / (a**2 + (nbar - 0.5) ** 2)
    top = np.prod(1 - m[:, None] ** 2 / (sigma2 * (a**2 + (m[None, :] - 0.5) ** 2)), axis=1)
    bottom = np.array([np.prod([1 - k**2 / j**2 for j in m if j != k]) for k in m])
    return (-1.0) ** (m + 1) * top / (2 * bottom)


def taylor(count: int, nbar: int = 4, sidelobe_db: float = 35.0) -> np.ndarray:
    """Taylor weights with mean 1."""
    f = taylor_cosines(nbar, sidelobe_db)
    x = (np.arange(count) - (count - 1) / 2) / count
    weights = 1 + 2 * (f[:, None] * np.cos(2 * np.pi * np.arange(1, nbar)[:, None] * x)).sum(0)
    if (weights < 0).any() or weights.sum() <= 0:
        raise ValueError("these parameters give invalid weights")
    return weights


def weight_at(place: Column, count: Column, name: str, nbar: int = 4, sidelobe_db: float = 35.0) -> Column:
    """The weight at one place (from 0) of a window over `count` samples, all as columns."""
    if name == "none":
        return F.lit(1.0)
    if name == "hann":
        return F.when(count > 2, 0.5 - 0.5 * F.cos(2 * F.pi() * place / F.greatest(count - 1, F.lit(1)))).otherwise(1.0)
    if name != "taylor":
        raise ValueError("window must be hann, none or taylor")
    x = (place - (count - 1) / 2) / count
    weight = F.lit(1.0)
    for m, f in enumerate(taylor_cosines(nbar, sidelobe_db).tolist(), 1):
        weight = weight + 2 * f * F.cos(2 * m * F.pi() * x)
    return F.when(weight < 0, F.raise_error(F.lit("these parameters give invalid weights"))).otherwise(weight)


def weight_sum(count: Column, name: str) -> Column:
    """The sum of such a window over all its places."""
    return F.when(count > 2, (count - 1) / 2).otherwise(count) if name == "hann" else count.cast("double")


def window(count: int, name: str, nbar: int = 4, sidelobe_db: float = 35.0) -> np.ndarray:
    if count < 1:
        raise ValueError("count must be positive")
    if name == "taylor":
        return taylor(count, nbar, sidelobe_db)
    if name not in ("hann", "none"):
        raise ValueError("window must be hann, none or taylor")
    return hann(count) if name == "hann" else np.ones(count)


def hamming(count: int, coefficient: float = 0.54) -> np.ndarray:
    """alpha - (1 - alpha) cos; 0.54 where the coefficient is not positive; one sample weighs 0.08."""
    a = coefficient if coefficient > 0 else 0.54
    if count == 1:
        return np.array([2 * a - 1])
    return a - (1 - a) * np.cos(2 * np.pi * np.arange(count) / (count - 1))


def shaped(weights: np.ndarray, broadening: float = 1.0, scaling: str = "") -> np.ndarray:
    """Weights to the power 1 / broadening, then scaled by their rms (`totalpower`) or sum (`sum`); other names scale nothing."""
    out = np.power(weights, 1 / broadening) if broadening > 0 else weights
    by = {"totalpower": np.sqrt((out**2).mean()), "sum": out.sum()}.get(scaling, 1.0)
    return out / by if by else out


def hann_array(count: int) -> Column:
    """The same Hann weights as an array<double> column, computed by the JVM."""
    if count <= 2:
        return F.array_repeat(F.lit(1.0), count)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: 0.5 - 0.5 * F.cos(2 * F.pi() * i / (count - 1)))


def weights_array(weights: np.ndarray) -> Column:
    return F.lit([float(w) for w in weights])
