"""Per-drive recursions that no window expresses: cross-correlation and the drive filter. Spark groups by drive, numpy runs inside."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the filter: first variances, growth a second of speed and heading, variances of a fix's speed and heading.
FIRST = (25.0, 25.0, 9.0, 0.3)
GROWTH = (0.35, 0.02)
SPEED_VARIANCE, HEADING_VARIANCE, LEAST_BEARING_SPEED = 0.5, 0.05, 2.0


def best_lag(ref: np.ndarray, sig: np.ndarray, max_lag: int, least: int = 50) -> tuple[int, float, int]:
    """(lag, correlation, points): the lag of ``sig`` with the largest |correlation|; (0, 0, n) under ``least`` points."""
    ok = np.isfinite(ref) & np.isfinite(sig)
    n = int(ok.sum())
    if n < least:
        return 0, 0.0, n
    a, b = (np.where(ok, x - x[ok].mean(), 0.0) for x in (ref, sig))
    size = 1 << int(np.ceil(np.log2(2 * len(a))))
    full = np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size)
    lags = np.arange(-max_lag, max_lag + 1)
    values = np.where(np.abs(lags) < len(a), full[lags % size], 0.0) / (n * a[ok].std() * b[ok].std() + 1e-12)
    at = int(np.argmax(np.round(np.abs(values), 12)))
    return int(lags[at]), float(values[at]), n


def xcorr_lag(df: DataFrame, ref: str, sig: str, keys: Sequence[str] = ("trip_id",), order: str = "i", max_lag: int = 150, effective: float = 50.0) -> DataFrame:
    """Per drive ``lag, corr, n, z``: by how many samples ``sig`` is late against ``ref``; nulls count as missing.

    One drive is one group: an hour at 100 Hz is 3 MB a column.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order)
        lag, corr, n = best_lag(t[ref].to_numpy(float), t[sig].to_numpy(float), max_lag)
        return pd.DataFrame({**{k: [t[k].iloc[0]] for k in keys}, "lag": [lag], "corr": [corr], "n": [n], "z": [abs(corr) * np.sqrt(n / effective)]})

    return df.select(*keys, order, ref, sig).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "lag int, corr double, n long, z double"]))


def filtered(t: np.ndarray, accel: np.ndarray, yaw: np.ndarray, x: np.ndarray, y: np.ndarray, var: np.ndarray, speed: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """(x, y, v, heading, sigma) after each row: a step of the motion model, then the row's fix, if it has one (NaN: none)."""
    s, p = np.zeros(4), np.diag(FIRST)
    out, last, anchored = np.empty((len(t), 5)), None, False
    move = np.eye(4)
    for i in range(len(t)):
        dt = 0.0 if last is None else t[i] - last
        last = t[i]
        if dt > 0:
            s[3] += yaw[i] * dt
            s[2] = max(0.0, s[2] + accel[i] * dt)
            c, n = np.cos(s[3]), np.sin(s[3])
            s[0] += s[2] * c * dt
            s[1] += s[2] * n * dt
            move[0, 2], move[0, 3], move[1, 2], move[1, 3] = c * dt, -s[2] * n * dt, n * dt, s[2] * c * dt
            p = move @ p @ move.T
            p[2, 2] += GROWTH[0] * dt
            p[3, 3] += GROWTH[1] * dt
        if not np.isnan(x[i]):
            if not anchored:
                # The first fix starts heading and speed; the plane's origin is where it lies.
                anchored = True
                s[3] = s[3] if np.isnan(heading[i]) else heading[i]
                s[2] = s[2] if np.isnan(speed[i]) else max(0.0, speed[i])
            else:
                seen = [(0, x[i], var[i]), (1, y[i], var[i])]
                if not np.isnan(speed[i]):
                    seen.append((2, max(0.0, speed[i]), SPEED_VARIANCE))
                    if not np.isnan(heading[i]) and speed[i] >= LEAST_BEARING_SPEED:
                        seen.append((3, heading[i], HEADING_VARIANCE))
                rows = [r for r, _, _ in seen]
                gap = np.array([z for _, z, _ in seen]) - s[rows]
                if rows[-1] == 3:
                    gap[-1] = (gap[-1] + np.pi) % (2 * np.pi) - np.pi
                gain = np.linalg.solve(p[np.ix_(rows, rows)] + np.diag([v for _, _, v in seen]), p[rows]).T
                s = s + gain @ gap
                p = p - gain @ p[rows]
        out[i] = *s, np.sqrt(max(p[0, 0], 0) + max(p[1, 1], 0))
    return out


def fuse_drive(df: DataFrame, keys: Sequence[str] = ("drive",), t: str = "t_s", accel: str = "accel", yaw: str = "yaw", x: str = "fix_x", y: str = "fix_y", variance: str = "fix_var", speed: str = "fix_speed", heading: str = "fix_heading") -> DataFrame:
    """A 4-state filter (position, speed, heading) over each drive: ``x, y, v, heading, sigma`` after every row.

    Rows are IMU samples in time order; those with a fix (metres from the drive's first one, heading in radians from east,
    nulls where it has none) correct the state. Null accelerations and yaw rates count as 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [t, accel, yaw, x, y, variance, speed, heading]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(t, kind="stable")
        cols = [d[c].to_numpy(float) for c in names]
        cols[1], cols[2] = np.nan_to_num(cols[1]), np.nan_to_num(cols[2])
        made = pd.DataFrame(filtered(*cols), columns=["x", "y", "v", "heading", "sigma"])
        return pd.concat([d[[*keys, t]].reset_index(drop=True), made], axis=1)

    return df.select(*keys, *names).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, t]), "x double, y double, v double, heading double, sigma double"]))
