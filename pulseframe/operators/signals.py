"""Filters and spectra in numpy, applied to whole channels of a DataFrame.

A channel is one subject's one sensor of one trial, so it fits a task; channels
are dealt by their key and each is filtered on its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulseframe.operators.ranks import spread


def butterworth(order: int, cut, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital low-pass (one cut-off) or band-pass (two), by the bilinear transform of the analog prototype."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    edges = 2 * fs * np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / fs)  # warped, rad/s
    if len(edges) == 1:
        poles, zeros = poles * edges[0], np.zeros(0)
        gain = edges[0] ** order
    else:
        width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros, gain = np.r_[half + root, half - root], np.zeros(order), width**order
    gain = gain * np.real(np.prod(2 * fs - zeros) / np.prod(2 * fs - poles))
    z = np.r_[(2 * fs + zeros) / (2 * fs - zeros), -np.ones(len(poles) - len(zeros))]
    return gain * np.real(np.poly(z)), np.real(np.poly((2 * fs + poles) / (2 * fs - poles)))


def notch(f0: float, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a second-order notch of quality q."""
    w = 2 * np.pi * f0 / fs
    g = 1 / (1 + np.tan(w / q / 2))
    return g * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * g * np.cos(w), 2 * g - 1])


def _companion(b: np.ndarray, a: np.ndarray):
    """State form of the filter (transposed direct form II): z' = A z + B x, y = z[0] + b0 x."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    big = np.zeros((n - 1, n - 1))
    big[:, 0] = -a[1:]
    big[:-1, 1:] = np.eye(n - 2)
    return big, b[1:] - a[1:] * b[0], b[0]


_MEMO: dict = {}  # filters of a task's channels; a few for each rate


def _memo(kind: str, make, *key):
    """make(*key), once in a task."""
    if (kind, *key) not in _MEMO:
        if len(_MEMO) > 500:
            _MEMO.clear()
        _MEMO[(kind, *key)] = make(*key)
    return _MEMO[(kind, *key)]


def _blocks(b: tuple, a: tuple, block: int):
    """What a filter needs for blocks of samples: outputs from the state, outputs from own samples, state from own samples, state over a block."""
    big, into, b0 = _companion(np.array(b), np.array(a))
    powers = [np.eye(len(into))]
    for _ in range(block):
        powers.append(big @ powers[-1])
    see = np.array([p[0] for p in powers[:block]])
    impulse = np.r_[b0, [p[0] @ into for p in powers[: block - 1]]]
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    own = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    carry = np.stack([powers[block - 1 - i] @ into for i in range(block)], 1)
    return see, own, carry, powers[block]


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 128) -> np.ndarray:
    """Recursive filter, a block of samples at a time: the response to the block's own samples is one matrix product, the state's another."""
    see, own, carry, over = _memo("blocks", _blocks, tuple(b), tuple(a), block)
    rows = np.pad(x, (0, -len(x) % block)).reshape(-1, block)
    y, push = rows @ own.T, rows @ carry.T
    states, z = np.empty((len(rows), len(over))), state.astype(float)
    for i in range(len(rows)):
        states[i] = z
        z = over @ z + push[i]
    return (y + states @ see.T).ravel()[: len(x)]


def _steady(b: tuple, a: tuple) -> np.ndarray:
    """State at rest under a constant input of one."""
    big, into, _ = _companion(np.array(b), np.array(a))
    return np.linalg.solve(np.eye(len(into)) - big, into)


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter: forward and backward over an odd extension, from the step response's steady state."""
    edge = 3 * max(len(a), len(b))
    if len(x) <= edge:
        return np.full(len(x), np.nan)
    ext = np.r_[2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]]
    steady = _memo("steady", _steady, tuple(b), tuple(a))
    y = lfilter(b, a, ext, steady * ext[0])[::-1]
    return lfilter(b, a, y, steady * y[0])[::-1][edge:-edge]


def welch(x: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density) along the last axis: Hann windows, half overlap, each segment's mean removed."""
    m = min(segment, x.shape[-1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    parts = np.lib.stride_tricks.sliding_window_view(x, m, axis=-1)[..., :: max(1, m - m // 2), :]
    power = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * w)) ** 2
    power = power.mean(-2) / (fs * (w**2).sum())
    power[..., 1 : -1 if m % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(m, 1 / fs), power


def mean_frequency(x: np.ndarray, fs: float, least: int = 32) -> float:
    if len(x) < least:
        return np.nan
    f, p = welch(x, fs, 256)
    return float((f * p).sum() / p.sum()) if p.sum() > 0 else np.nan


def median_frequency(x: np.ndarray, fs: float, least: int = 32) -> float:
    if len(x) < least:
        return np.nan
    f, p = welch(x, fs, 256)
    c = np.cumsum(p)
    return float(f[np.searchsorted(c, c[-1] / 2)]) if c[-1] > 0 else np.nan


def has_mains_peak(x: np.ndarray, fs: float, ratio: float = 5.0) -> bool:
    """Mean power in 45-55 Hz over that in 60-80 Hz reaches the ratio; False if too short."""
    m = int(2 * fs)
    if len(x) < m:
        return False
    f, p = welch(x, fs, m)
    near, aside = p[(f >= 45) & (f <= 55)], p[(f >= 60) & (f <= 80)]
    return bool(len(near) and len(aside) and aside.mean() > 0 and near.mean() / aside.mean() >= ratio)


def emg_envelope(x: np.ndarray, fs: float, band=(20.0, 450.0), order: int = 4, cut: float = 6.0, q: float = 30.0) -> tuple[np.ndarray, np.ndarray, bool]:
    """(band-passed, envelope, whether the mains notch was used); gaps count as 0."""
    x = np.where(np.isfinite(x), x, 0.0)
    high = min(band[1], 0.49 * fs)
    bp = filtfilt(*butterworth(order, (band[0], high), fs), x)
    mains = has_mains_peak(np.nan_to_num(bp), fs)
    if mains:
        bp = filtfilt(*notch(50.0, q, fs), bp)
    return bp, filtfilt(*butterworth(order, cut, fs), np.abs(bp)), mains


def low_pass(x: np.ndarray, fs: float, cut: float, order: int = 4) -> np.ndarray:
    """Zero-phase low-pass; as it is where too short, without rate, or beyond half of it."""
    x = np.where(np.isfinite(x), x, 0.0)
    if len(x) < 10 or not fs > 0 or cut >= fs / 2:
        return x
    y = filtfilt(*butterworth(order, cut, fs), x)
    return x if np.isnan(y).any() else y


def _by_channel(df: DataFrame, keys, order, make, extra: list[tuple[str, T.DataType]]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in extra]])

    def run(pdf):
        return make(pdf.sort_values(list(order), kind="stable"))

    return spread(df, *keys).groupBy(*keys).applyInPandas(run, schema)


def _rate(t: np.ndarray, given: float | None) -> float:
    d = np.diff(t)
    d = d[d > 0]
    return given or (1 / d.mean() if len(d) else np.nan)


def _mean_rate(t: np.ndarray, fallback: float = 148.0) -> float:
    """Rate of all steps as they stand, also those back in time between sensors' blocks."""
    d = np.diff(t)
    return float(1 / d.mean()) if len(d) and d.mean() != 0 else fallback


def emg_channels(df: DataFrame, x: str, keys=("subject", "trial", "sensor"), order=("t",), fs: float | None = None, fs_column: str | None = None) -> DataFrame:
    """Adds bp, env and notched to the samples of each channel; the rate is that of a column, if named, or given, or the mean of the steps."""

    def make(p):
        rate = float(p[fs_column].iloc[0]) if fs_column else _rate(p["t"].to_numpy(float), fs)
        bp, env, mains = emg_envelope(p[x].to_numpy(float), rate)
        return p.assign(bp=bp, env=env, notched=mains)

    return _by_channel(df, keys, order, make, [("bp", T.DoubleType()), ("env", T.DoubleType()), ("notched", T.BooleanType())])


def imu_channels(df: DataFrame, gyro: str, acc: str, keys=("subject", "trial", "sensor"), order=("t",), fs: float | None = None, gate_hz: float = 10.0, gravity_hz: float = 0.5, fs_column: str | None = None) -> DataFrame:
    """Adds gyro_gate, acc_dyn (magnitude less its slow part; missing where the magnitude is) and acc_gate."""

    def make(p):
        rate = float(p[fs_column].iloc[0]) if fs_column else _rate(p["t"].to_numpy(float), fs)
        a = p[acc].to_numpy(float)
        dyn = a - low_pass(a, rate, gravity_hz, 2)
        return p.assign(gyro_gate=low_pass(p[gyro].to_numpy(float), rate, gate_hz), acc_dyn=dyn, acc_gate=low_pass(np.abs(dyn), rate, gate_hz))

    return _by_channel(df, keys, order, make, [(n, T.DoubleType()) for n in ("gyro_gate", "acc_dyn", "acc_gate")])


def tremor_gate(df: DataFrame, x: str, keys=("subject", "trial"), order=("row",), cut: float = 7.0, cut_column: str | None = None, fallback: float = 148.0) -> DataFrame:
    """Gate of a trial from all sensors' samples in the order of the given row number, low-passed as they stand."""

    def make(p):
        hz = float(p[cut_column].iloc[0]) if cut_column else cut
        return p.assign(gate=low_pass(p[x].to_numpy(float), _mean_rate(p["t"].to_numpy(float), fallback), hz, 2))

    return _by_channel(df, keys, order, make, [("gate", T.DoubleType())])


def spectral_features(df: DataFrame, x: str, keys, fs: float, order=("t",), batch=None, least: int = 32) -> DataFrame:
    """MNF and MDF of each window; windows that share the `batch` keys (all keys, if not given) go to Python together, those of one size as a matrix."""
    import pandas as pd

    from pulseframe.operators.window_pass import spectra, stacks

    names = list(keys)
    schema = T.StructType([df.schema[k] for k in names] + [T.StructField(n, T.DoubleType()) for n in ("MNF", "MDF")])

    def run(pdf):
        pdf = pdf.sort_values([*names, *order], kind="stable").reset_index(drop=True)
        first = np.flatnonzero(~pdf.duplicated(names).to_numpy())
        last = np.r_[first[1:], len(pdf)]
        out, v = np.full((2, len(first)), np.nan), pdf[x].to_numpy(float)
        for own, at in stacks(first, last, least):
            out[:, own] = spectra(v[at], np.full(len(own), float(fs)))
        return pd.concat([pdf.loc[first, names].reset_index(drop=True), pd.DataFrame({"MNF": out[0], "MDF": out[1]})], axis=1)

    return spread(df, *(batch or names)).groupBy(*(batch or names)).applyInPandas(run, schema)
