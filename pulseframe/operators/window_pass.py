"""Figures of sliding windows in one pass: samples and windows of a stretch of a recording meet once, in Arrow batches.

A stretch is `span` seconds of a trial, so that a long recording is many groups: a window belongs to the stretch of its
start, and samples near a border go to both sides.  Many stretches are worked on at once: their times are complex numbers,
the stretch's number as real part, which numpy orders by stretch and then by time, so that steps inside a stretch stay
exact.  Each channel is sorted once and windows are ranges of it, found by bisection; windows of equal size are the rows
of one matrix, on which every figure is array arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.operators.ranks import spread

#: Cells of a matrix of windows.
CELLS = 1 << 22
#: Samples and windows that are worked on at once, if a single stretch does not hold more.
ROWS = 1 << 17


def by_stretch(group: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.empty(len(t), complex)
    out.real, out.imag = group, t
    return out


def seconds(t: np.ndarray) -> np.ndarray:
    """Times without their stretch."""
    return t.imag if np.iscomplexobj(t) else t


def stacks(lo: np.ndarray, hi: np.ndarray, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ranges of one size, their places as a matrix) for all ranges of at least `least` places."""
    size = hi - lo
    for n in np.unique(size[size >= least]):
        every = np.flatnonzero(size == n)
        for k in range(0, len(every), max(1, CELLS // int(n))):
            own = every[k : k + max(1, CELLS // int(n))]
            yield own, lo[own][:, None] + np.arange(n)


def meet(samples: DataFrame, windows: DataFrame, figures: Callable, fields: list[T.StructField], length: float, trial=("subject", "trial"), span: float = 120.0, at_once: int = ROWS) -> DataFrame:
    """windows with the columns that figures(samples' columns, t_start, t_end, rate) -> {name: array} gives to those of some stretches.

    samples need trial and t; windows trial, t_start and t_end, which lie `length` apart; rate is their column __fs, if any.
    figures gets times by stretch, see above.
    """
    first, last = F.floor((F.col("t") - length - 1e-9) / span), F.floor(F.col("t") / span)
    s = samples.where(F.col("t").isNotNull() & ~F.isnan("t")).withColumn("t", F.col("t").cast("double")).withColumn("__stretch", F.explode(F.sequence(first, last)))
    w = windows.withColumn("__stretch", F.floor(F.col("t_start") / span))
    own = [c for c in windows.columns if c not in {f.name for f in fields}]
    schema = T.StructType([windows.schema[c] for c in own] + fields)
    kinds = {f.name: {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in fields}
    keys, plain = [*trial, "__stretch"], [c for c in samples.columns if c not in trial]
    same_kind = [F.col(c).cast(windows.schema[c].dataType).alias(c) for c in trial]
    left = s.select(*same_kind, "__stretch", *[F.col(c).alias(f"__s_{c}") for c in plain], F.lit(False).alias("__window"))
    both = left.unionByName(w.withColumn("__window", F.lit(True)), allowMissingColumns=True)

    def groups(table: pa.Table) -> np.ndarray:
        """0, 1, ... by stretch; rows of one lie together."""
        new = np.zeros(table.num_rows, bool)
        for c in keys:
            code = table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    def values(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().to_numpy(zero_copy_only=False)

    def whole(table: pa.Table, group: np.ndarray):
        is_window = values(table["__window"])
        right, at = table.filter(pa.array(is_window)), group[is_window]
        if not right.num_rows:
            return
        needed = ~is_window & (np.bincount(at, minlength=group[-1] + 1) > 0)[group]
        samples = table.filter(pa.array(needed))
        s = {c: values(samples[f"__s_{c}"]) for c in plain}
        s["t"] = by_stretch(group[needed], s["t"])
        start, end = (by_stretch(at, values(right[c])) for c in ("t_start", "t_end"))
        got = figures(s, start, end, values(right["__fs"]).astype(float) if "__fs" in right.column_names else None)
        out = [right[c] for c in own]
        for name, kind in kinds.items():
            v = got.get(name)
            if v is None:
                out.append(pa.nulls(right.num_rows, kind))
            else:
                v = np.asarray(v)
                out.append(pa.array(v, mask=np.isnan(v) if v.dtype.kind == "f" else None).cast(kind))
        yield from pa.table(out, names=[*own, *kinds]).combine_chunks().to_batches()

    def run(batches):
        held, rows, limit = [], 0, at_once
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                table = pa.Table.from_batches(held)
                group = groups(table)
                cut = int(np.searchsorted(group, group[-1]))  # the last stretch may go on
                if cut:
                    yield from whole(table.slice(0, cut), group[:cut])
                held, rows = table.slice(cut).to_batches(), rows - cut
                limit = max(at_once, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held)
            yield from whole(table, groups(table))

    return spread(both, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


# --- coverage ---


def coverage(t: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct times, rows and largest gap of each window, of times in any order."""
    t = np.sort(t)
    u = np.unique(t)
    lo, hi = np.searchsorted(u, start, "left"), np.searchsorted(u, end, "left")
    gap = np.full(len(start), np.nan)
    two = np.flatnonzero(hi - lo >= 2)
    if len(two):
        # reduceat takes [lo, hi - 1) from each even place; a last zero keeps every place inside.
        gap[two] = np.maximum.reduceat(np.r_[np.diff(seconds(u)), 0.0], np.c_[lo[two], hi[two] - 1].ravel())[::2]
    return {"n": hi - lo, "n_rows": np.searchsorted(t, end, "left") - np.searchsorted(t, start, "left"), "max_gap_s": gap}


# --- muscle windows ---


def spectra(x: np.ndarray, fs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and median frequency of each row by one Welch spectrum."""
    from pulseframe.operators.signals import welch

    f, p = welch(x, 1.0, 256)
    whole = p.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(whole > 0, (p * f).sum(1) / whole, np.nan)
    c = np.cumsum(p, axis=1)
    at = np.minimum((c < c[:, -1:] / 2).sum(1), len(f) - 1)
    ok = np.isfinite(fs) & (fs > 0)
    return np.where(ok, mean * fs, np.nan), np.where(ok & (c[:, -1] > 0), f[at] * fs, np.nan)


def autoregression(x: np.ndarray, order: int = 4) -> np.ndarray:
    """Yule-Walker coefficients of each row (missing where a row is constant, too short or not finite)."""
    n = x.shape[1]
    out = np.full((len(x), order), np.nan)
    if n < order + 10:
        return out
    x = x - x.mean(1, keepdims=True)
    r = np.stack([(x[:, k:] * x[:, : n - k]).sum(1) for k in range(order + 1)], 1)
    ok = np.flatnonzero(np.isfinite(r).all(1) & (r[:, 0] != 0))
    at = np.abs(np.arange(order)[:, None] - np.arange(order))
    full = np.linalg.matrix_rank(r[ok][:, at]) == order if len(ok) else np.zeros(0, bool)
    for i in [ok[full], *ok[~full][:, None]]:
        try:
            out[i] = np.linalg.solve(r[i][:, at], r[i][:, 1:, None])[..., 0]
        except np.linalg.LinAlgError:
            pass
    return out


MUSCLE = ("MAV", "RMS", "WL", "WAMP", "ZC", "MNF", "MDF", "AR1", "AR2", "AR3", "AR4", "fs_used")


def muscle_figures(t: np.ndarray, x: np.ndarray, start: np.ndarray, end: np.ndarray, fs: np.ndarray, least: int = 32, th_rel: float = 0.01, th_abs: float = 50e-6) -> dict[str, np.ndarray]:
    """MUSCLE of each window of one channel, sorted by time; fs is the windows' rate, else that of the times inside."""
    out = {c: np.full(len(start), np.nan) for c in MUSCLE}
    lo, hi = np.searchsorted(t, start, "left"), np.searchsorted(t, end, "left")
    for own, at in stacks(lo, hi, least):
        v = x[at]
        step, sign = np.abs(np.diff(v, axis=1)), np.where(v >= 0, 1, -1)
        seen = np.isfinite(v)
        mean = np.where(seen, v, 0).sum(1) / np.maximum(seen.sum(1), 1)
        sd = np.sqrt((np.where(seen, v - mean[:, None], 0) ** 2).sum(1) / np.maximum(seen.sum(1), 1))[:, None]
        rate = fs[own].copy()
        poor = ~(np.isfinite(rate) & (rate > 0))
        if poor.any():
            rate[poor] = 1 / median_step(t, lo[own][poor], hi[own][poor])
        crossed = (sign[:, 1:] != sign[:, :-1]) & seen[:, 1:] & seen[:, :-1] & (step > th_rel * sd)
        got = [np.abs(v).mean(1), np.sqrt((v * v).mean(1)), step.sum(1), (step > np.maximum(th_abs, th_rel * sd)).sum(1), crossed.sum(1), *(spectra(v, rate) if v.shape[1] >= 32 else (np.nan, np.nan)), *autoregression(v).T, rate]
        for c, y in zip(MUSCLE, got):
            out[c][own] = y
    return out


def median_step(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = 3) -> np.ndarray:
    """Median step of the distinct times in ranges of sorted times; missing below `least` of them."""
    u, place = np.unique(t, return_inverse=True)
    out = np.full(len(lo), np.nan)
    some = np.flatnonzero(hi > lo)
    a, b = np.zeros(len(lo), int), np.zeros(len(lo), int)
    a[some], b[some] = place[lo[some]], place[hi[some] - 1] + 1
    d = np.diff(seconds(u))
    for own, at in stacks(a, b - 1, least - 1):
        out[own] = np.median(d[at], axis=1)
    return out


def _merged(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct times with their mean values; missing values left out."""
    ok = np.isfinite(x)
    u, place = np.unique(t[ok], return_inverse=True)
    return u, np.bincount(place, x[ok], len(u)) / np.maximum(np.bincount(place, minlength=len(u)), 1)


def _held_line(t: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x at the times `at`, linear inside the range [lo, hi) of each and held at the range's ends."""
    j = np.clip(np.searchsorted(t, at, "right"), lo + 1, np.maximum(hi - 1, lo + 1))
    i, j = j - 1, np.minimum(j, hi - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.clip(np.where(j > i, seconds(at - t[i]) / seconds(t[j] - t[i]), 0.0), 0.0, 1.0)
    return x[i] + (x[j] - x[i]) * part


def overlap_figure(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Area of the lesser over that of the greater of two envelopes (times, values), both on a grid of their common median step."""
    out = np.full(len(start), np.nan)
    (ta, xa), (tb, xb) = _merged(*one), _merged(*two)
    u = np.unique(np.r_[ta, tb])
    bounds = [(np.searchsorted(v, start, "left"), np.searchsorted(v, end, "left")) for v in (u, ta, tb)]
    dt = median_step(u, *bounds[0])
    own = np.flatnonzero((bounds[1][1] > bounds[1][0]) & (bounds[2][1] > bounds[2][0]) & (dt > 0))
    if not len(own):
        return out
    first, last, dt = u[bounds[0][0][own]], u[bounds[0][1][own] - 1], dt[own]
    n = np.ceil((seconds(last) + 1e-12 - seconds(first)) / dt).astype(int)
    own, first, dt, n = (v[n >= 3] for v in (own, first, dt, n))
    if not len(own):
        return out
    begin = np.cumsum(n) - n
    grid = np.repeat(seconds(first), n) + (np.arange(int(n.sum())) - np.repeat(begin, n)) * np.repeat(dt, n)
    places = by_stretch(np.repeat(first.real, n), grid) if np.iscomplexobj(first) else grid
    a, b = (np.maximum(_held_line(t, x, np.repeat(lo[own], n), np.repeat(hi[own], n), places), 0.0) for (t, x), (lo, hi) in zip(((ta, xa), (tb, xb)), bounds[1:]))

    def area(v: np.ndarray) -> np.ndarray:
        inner = (v[1:] + v[:-1]) / 2 * np.diff(grid)
        inner[begin[1:] - 1] = 0  # from one window's grid to the next's
        return np.add.reduceat(np.r_[inner, 0.0], begin)

    low, high = area(np.minimum(a, b)), area(np.maximum(a, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        out[own] = np.where(high > 0, low / high, np.nan)
    return out


# --- inertial windows ---

MOTION = ("gyro_mag_mean", "gyro_mag_std", "gyro_mag_peak", "acc_mag_mean", "acc_mag_std", "acc_mag_peak", "acc_dyn_mean", "acc_dyn_std", "jerk_norm_mean", "dt_median_s")


def _summary(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, sample deviation and largest of each row's values that are there."""
    seen = np.isfinite(v)
    n = seen.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, np.where(seen, v, 0).sum(1) / n, np.nan)
        sd = np.where(n > 1, np.sqrt((np.where(seen, v - mean[:, None], 0) ** 2).sum(1) / (n - 1)), np.nan)
    return mean, sd, np.where(n > 0, np.where(seen, v, -np.inf).max(1, initial=-np.inf), np.nan)


def motion_figures(t: np.ndarray, columns: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray, least: int = 8) -> dict[str, np.ndarray]:
    """MOTION of each window of one sensor, sorted by time."""
    out = {c: np.full(len(start), np.nan) for c in MOTION}
    lo, hi = np.searchsorted(t, start, "left"), np.searchsorted(t, end, "left")
    out["dt_median_s"] = median_step(t, lo, hi)
    for own, at in stacks(lo, hi):
        for c in ("gyro_mag", "acc_mag", "acc_dyn"):
            for name, y in zip(("mean", "std", "peak"), _summary(columns[c][at])):
                if f"{c}_{name}" in out:
                    out[f"{c}_{name}"][own] = y
        if at.shape[1] >= max(least, 2):
            norm = np.sqrt(sum(np.diff(columns[c][at], axis=1) ** 2 for c in ("acc_x_g", "acc_y_g", "acc_z_g")))
            out["jerk_norm_mean"][own] = _summary(norm)[0] / out["dt_median_s"][own]
    return out


# --- the passes ---


def coverage_of(emg: DataFrame, imu: DataFrame, windows: DataFrame, length: float, trial=("subject", "trial"), span: float = 120.0) -> DataFrame:
    """windows with <m>_n, <m>_n_rows and <m>_max_gap_s of both modalities."""
    both = emg.select(*trial, "t", F.lit(False).alias("moving")).unionByName(imu.select(*trial, "t", F.lit(True).alias("moving")))
    names = {"n": T.LongType(), "n_rows": T.LongType(), "max_gap_s": T.DoubleType()}

    def figures(s, start, end, _):
        moving = s["moving"].astype(bool)
        return {f"{m}_{c}": v for m, own in (("emg", ~moving), ("imu", moving)) for c, v in coverage(s["t"][own], start, end).items()}

    got = meet(both, windows, figures, [T.StructField(f"{m}_{c}", k) for m in ("emg", "imu") for c, k in names.items()], length, trial, span)
    return got.fillna(0, [f"{m}_{c}" for m in ("emg", "imu") for c in ("n", "n_rows")])


def features_of(emg: DataFrame, imu: DataFrame, windows: DataFrame, muscles: list[str], sensors: list[str], pair, length: float, fs: float | None = None, least_emg: int = 32, least_imu: int = 8, trial=("subject", "trial"), span: float = 120.0) -> DataFrame:
    """windows with all figures of both modalities, one column for each channel and figure; see features.window_features()."""
    axes = ("gyro_mag", "acc_mag", "acc_dyn", "acc_x_g", "acc_y_g", "acc_z_g")
    none = F.lit(None).cast("double")
    number = lambda c: F.col(c).cast("double").alias(c)
    one = emg.select(*trial, "sensor", number("t"), F.lit(False).alias("moving"), number("emg_bp"), number("env_norm"), *[none.alias(c) for c in axes])
    two = imu.select(*trial, "sensor", number("t"), F.lit(True).alias("moving"), none.alias("emg_bp"), none.alias("env_norm"), *map(number, axes))
    # The windows' own rate, where they have one, reaches the pass as a column of theirs.
    rate = F.lit(float(fs)) if fs is not None else F.col("fs_emg_est").cast("double") if "fs_emg_est" in windows.columns else none
    names = [f"EMG_{m}_{c}" for m in muscles for c in MUSCLE] + ["EMG_global_effort_MAV_sum", "EMG_CoAct_Bic_Tri"]
    names += ["IMU_all_gyro_mag_mean", "IMU_all_gyro_mag_peak"] + [f"IMU_{s}_{c}" for s in sensors for c in MOTION]
    counts = {f"EMG_{m}_{c}" for m in muscles for c in ("WAMP", "ZC")}
    fields = [T.StructField("has_emg", T.BooleanType()), T.StructField("has_imu", T.BooleanType())]
    fields += [T.StructField(c, T.LongType() if c in counts else T.DoubleType()) for c in names]

    def figures(s, start, end, given):
        order = np.argsort(s["t"], kind="stable")
        s = {c: v[order] for c, v in s.items()}
        moving = s["moving"].astype(bool)
        number = {c: v.astype(float) for c, v in s.items() if c not in ("sensor", "moving", "t")} | {"t": s["t"]}
        out: dict[str, np.ndarray] = {}

        def channel(own):
            return {c: v[own] for c, v in number.items()}

        for flag, rows in (("has_emg", ~moving), ("has_imu", moving)):
            t = number["t"][rows]
            out[flag] = np.searchsorted(t, end, "left") > np.searchsorted(t, start, "left")
        effort, any_effort = np.zeros(len(start)), np.zeros(len(start), bool)
        held = {}
        for m in sorted(set(s["sensor"][~moving].tolist()) - {None}):
            c = held[m] = channel(~moving & (s["sensor"] == m))
            got = muscle_figures(c["t"], c["emg_bp"], start, end, given, least_emg)
            enough = np.searchsorted(c["t"], end, "left") - np.searchsorted(c["t"], start, "left") >= least_emg
            effort += np.nan_to_num(got["MAV"])
            any_effort |= enough
            out |= {f"EMG_{m}_{k}": v for k, v in got.items()}
        out["EMG_global_effort_MAV_sum"] = np.where(any_effort, effort, np.nan)
        if set(pair) <= set(held):
            a, b = ((held[m]["t"], held[m]["env_norm"]) for m in pair)
            out["EMG_CoAct_Bic_Tri"] = overlap_figure(a, b, start, end)
        every = channel(moving)
        lo, hi = np.searchsorted(every["t"], start, "left"), np.searchsorted(every["t"], end, "left")
        out["IMU_all_gyro_mag_mean"], out["IMU_all_gyro_mag_peak"] = np.full(len(start), np.nan), np.full(len(start), np.nan)
        for own, at in stacks(lo, hi):
            out["IMU_all_gyro_mag_mean"][own], _, out["IMU_all_gyro_mag_peak"][own] = _summary(every["gyro_mag"][at])
        for m in sorted(set(s["sensor"][moving].tolist()) - {None}):
            c = channel(moving & (s["sensor"] == m))
            out |= {f"IMU_{m}_{k}": v for k, v in motion_figures(c["t"], c, start, end, least_imu).items()}
        return out

    return meet(one.unionByName(two), windows.withColumn("__fs", rate), figures, fields, length, trial, span).drop("__fs")
