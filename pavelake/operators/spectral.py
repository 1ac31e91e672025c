"""Filters and spectra per pack. A pack is one recording, so a task holds one at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from . import timeseries as ts


def butterworth(order: int, cutoff: float, fs: float, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a low- or high-pass by the bilinear transform; even orders."""
    k = np.tan(np.pi * cutoff / fs)
    out = []
    for i in range(order // 2):
        q = 1 / (2 * np.cos(np.pi * (2 * i + 1) / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        b = np.array([k * k, 2 * k * k, k * k]) if kind == "low" else np.array([1.0, -2.0, 1.0])
        out.append((b * norm, np.array([1.0, 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm])))
    return out


def butterworth_band(order: int, low: float, high: float, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a band-pass of twice the order: the low-pass prototype's poles moved to the band, then the bilinear transform."""
    warped = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    half = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(half * half - centre * centre)
    poles = np.concatenate([half + root, half - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    z = z[z.imag > 0]
    out = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * q.real, abs(q) ** 2])) for q in z]
    # unit gain at the centre, shared out over the sections
    at = np.exp(-1j * 2 * np.arctan(centre / (2 * fs)))
    powers = np.array([1, at, at * at])
    return [(b / abs((b @ powers) / (a @ powers)), a) for b, a in out]


STRETCH = 32


def run_sections(sections, x: np.ndarray) -> np.ndarray:
    """Filter from the steady state of the first value; x: samples, or samples x signals.

    Stretches of the signal are filtered side by side from rest. Then each gets what it owes to the state before it, which is
    linear in its two numbers: STRETCH steps over arrays and one step a stretch, not a dozen for every sample.
    """
    n, y, length = len(x), x.reshape(len(x), -1).astype(float), STRETCH
    many = -(-n // length)
    for b, a in sections:
        b0, b1, b2 = b.tolist()
        _, a1, a2 = a.tolist()
        gain = (b0 + b1 + b2) / (1.0 + a1 + a2)
        # what a state of one in either number gives in a stretch, and what is left of it at the stretch's end
        echo, left = np.empty((length, 2)), np.eye(2)
        for i in range(length):
            echo[i] = left[0]
            left = np.stack([left[1] - a1 * left[0], -a2 * left[0]])
        parts = np.zeros((many * length, y.shape[1]))
        parts[:n] = y
        parts = parts.reshape(many, length, -1).transpose(1, 0, 2).copy()
        z1, z2 = np.zeros(parts.shape[1:]), np.zeros(parts.shape[1:])
        for i in range(length):
            value = parts[i]
            out = b0 * value + z1
            z1 = b1 * value - a1 * out + z2
            z2 = b2 * value - a2 * out
            parts[i] = out
        second = (b2 - a2 * gain) * y[0]
        (l00, l01), (l10, l11) = left.tolist()
        before = np.empty((2, *parts.shape[1:]))
        for c, (p, q) in enumerate(zip(((b1 - a1 * gain) * y[0] + second).tolist(), second.tolist())):
            firsts, seconds = [], []
            for own, other in zip(z1[:, c].tolist(), z2[:, c].tolist()):
                firsts.append(p)
                seconds.append(q)
                p, q = l00 * p + l01 * q + own, l10 * p + l11 * q + other
            before[0, :, c], before[1, :, c] = firsts, seconds
        parts += echo[:, 0, None, None] * before[0] + echo[:, 1, None, None] * before[1]
        y = parts.transpose(1, 0, 2).reshape(many * length, -1)[:n]
    return y.reshape(x.shape)


def zero_phase(sections, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd extension at both ends."""
    n = min(3 * (2 * len(sections) + 1), len(x) - 1)
    if n < 1:
        return x.copy()
    ext = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    return run_sections(sections, run_sections(sections, ext)[::-1])[::-1][n:-n]


def band_pass(x: np.ndarray, fs: float, low: float = 1.0, high: float = 20.0, order: int = 4) -> np.ndarray:
    return zero_phase(butterworth_band(order, low, min(high, 0.45 * fs), fs), x)


def motion(acc: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude of the acceleration without gravity (its slow part), and its component along gravity. acc: samples x 3."""
    slow = butterworth(4, 0.5, fs, "low")
    g = zero_phase(slow, acc)
    free = acc - g
    along = (free * g).sum(axis=1) / np.maximum(np.linalg.norm(g, axis=1), 1e-6)
    return np.linalg.norm(free, axis=1), along


def prepare(resampled: DataFrame, fs: float = 100.0) -> DataFrame:
    """pack_id, t_ms, event_id (the row's number), lin_mag, vz, bp_mag, bp_vz. resampled: pack_id, t_ms, ax, ay, az on a grid.

    The filters run forward and backward over a whole recording, so a task holds one at a time.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_ms")
        mag, vz = motion(pdf[["ax", "ay", "az"]].fillna(0.0).to_numpy(float), fs)
        banded = band_pass(np.stack([mag, vz], axis=1), fs)
        return pd.DataFrame({"pack_id": key[0], "t_ms": pdf["t_ms"], "event_id": np.arange(len(pdf)), "lin_mag": mag, "vz": vz, "bp_mag": banded[:, 0], "bp_vz": banded[:, 1]})

    return resampled.select("pack_id", "t_ms", "ax", "ay", "az").groupBy("pack_id").applyInPandas(run, "pack_id long, t_ms long, event_id long, lin_mag double, vz double, bp_mag double, bp_vz double")


def band_energy(fs: float, low: tuple[float, float] = (1.0, 8.0), high: tuple[float, float] = (8.0, 20.0)):
    """Pandas UDF over windows of at most 128 values: shares of spectral power in two bands (the upper end of the second included)."""

    @F.pandas_udf("struct<energy_low:double,energy_high:double>")
    def run(windows: pd.Series) -> pd.DataFrame:
        out = []
        for x in windows:
            x = np.asarray(x, float)
            n = len(x)
            power = np.abs(np.fft.rfft((x - x.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)))) ** 2
            power[1 : (n + 1) // 2] *= 2  # both sides, but for the mean and the highest of an even number
            f = np.fft.rfftfreq(n, 1 / fs)
            total = power.sum() or 1e-9
            out.append((power[(f >= low[0]) & (f < low[1])].sum() / total, power[(f >= high[0]) & (f <= high[1])].sum() / total))
        return pd.DataFrame(out, columns=["energy_low", "energy_high"])

    return run


def lowest_since_higher(x: list[float]) -> list[float]:
    """For each value the lowest one since the last that was higher, in one pass with a stack."""
    out, stack = [], []
    for value in x:
        low = value
        while stack and stack[-1][0] <= value:
            low = min(low, stack.pop()[1])
        stack.append((value, low))
        out.append(low)
    return out


def bases(x: np.ndarray) -> np.ndarray:
    """For each value the higher of the two lowest points on the way to higher ground."""
    return np.maximum(lowest_since_higher(x.tolist()), lowest_since_higher(x[::-1].tolist())[::-1])


def prominences(x: np.ndarray, peaks: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """Height over the base; `base` as from bases() where it is asked for more than once."""
    return x[peaks] - (bases(x) if base is None else base)[peaks]


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles of the flat tops that are higher than what is on either side."""
    ends = np.flatnonzero(np.diff(x, append=np.nan) != 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    inner = (starts > 0) & (ends < len(x) - 1)
    starts, ends = starts[inner], ends[inner]
    top = (x[starts - 1] < x[starts]) & (x[ends + 1] < x[ends])
    return (starts[top] + ends[top]) // 2


def find_peaks(x: np.ndarray, height: np.ndarray, prominence: np.ndarray, distance: int, base: np.ndarray | None = None) -> np.ndarray:
    """Local maxima by height, then distance (higher ones first), then prominence; `base` as from bases(x), for many settings of one signal."""
    p = local_maxima(x)
    p = p[x[p] >= height[p]]
    keep = np.ones(len(p), bool)
    for i in np.argsort(x[p], kind="stable")[::-1].tolist():
        if keep[i]:
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(p) and abs(p[j] - p[i]) < distance:
                    keep[j] = False
                    j += step
    p = p[keep]
    return p[prominences(x, p, base) >= prominence[p]] if len(p) else p


def peaks(ready: DataFrame, fs: float = 100.0, k: float = v.NOISE_FACTOR, least: float = v.MIN_THRESHOLD, x: str = "bp_mag") -> DataFrame:
    """pack_id, t_ms, event_id, and x at peaks well above the floor. ready: pack_id, t_ms, event_id, x, floor, in packs of one recording."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_ms", "event_id"])
        y, floor = pdf[x].to_numpy(float), pdf["floor"].to_numpy(float)
        p = find_peaks(y, np.maximum(least, k * floor), np.maximum(least / 2, k / 2 * floor), max(1, int(0.04 * fs))) if len(y) >= int(2 * fs) + 8 else np.zeros(0, int)
        return pdf.iloc[p][["pack_id", "t_ms", "event_id", x]]

    return ready.select("pack_id", "t_ms", "event_id", x, "floor").groupBy("pack_id").applyInPandas(run, f"pack_id long, t_ms long, event_id long, {x} double")


def detect(resampled: DataFrame, fs: float = 100.0) -> DataFrame:
    """pack_id, t_ms, height of events in the motion signal. resampled: pack_id, t_ms, ax, ay, az on a grid."""
    ready = ts.centered_quantile_floor(prepare(resampled, fs), max(8, int(3 * fs)), x="bp_mag")
    return ts.merge_peaks(peaks(ready, fs)).select("pack_id", "t_ms", F.col("bp_mag").alias("height"))
