"""Motion of a phone that may lie any way: gravity followed along a drive, and the yaw rate about it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import PIECE, carried

#: Seconds, microseconds, degrees.
GRAVITY_S, WOBBLE_US, HANDLING_DEG = 2.0, 1_000_000, 3.0


def _follow(tau_s: float):
    def step(frame: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list]:
        """Low-passed acceleration: the step's weight is that of the time since the row before; none for rows of one time."""
        out = []
        for t, *a in zip(*(frame[c].tolist() for c in ("t_us", "ax", "ay", "az")), strict=True):
            if state is None:
                state = [t, *a]
            else:
                keep = math.exp(-(t - state[0]) / 1e6 / tau_s) if t > state[0] else 1.0
                state = [t, *(g * keep + x * (1 - keep) for g, x in zip(state[1:], a, strict=True))]
            out.append(state[1:])
        return pd.DataFrame(out, columns=["up_x", "up_y", "up_z"]), state

    return step


def yaw_rate_invariant(imu: DataFrame, key: str = "drive_id", tau_s: float = GRAVITY_S, piece: int = PIECE) -> DataFrame:
    """Adds ``up_x, up_y, up_z`` (low-passed acceleration), ``yaw_rate``, ``wobble_deg`` and ``handling`` to samples ``t_us, ax, ay,
    az, gx, gy, gz``.

    The yaw rate is that about the vertical, clockwise from above, however the phone lies: less the gyroscope's share along
    the low-passed up direction (0 while that has no length). ``wobble_deg`` is the angle between the up directions now and
    at the first sample of the last second; over 3 degrees somebody handles the phone. Only the low pass goes from row to
    row, in pieces with carried state. Rows with a null or infinite value or without a time are left out.
    """
    c = F.col
    whole = " AND ".join(f"abs({x}) < double('infinity')" for x in ("ax", "ay", "az", "gx", "gy", "gz")) + " AND t_us IS NOT NULL"
    d = carried(imu.where(whole), key, ["t_us", "ax", "ay", "az"], ["t_us", "ax", "ay", "az"], _follow(tau_s), "up_x double, up_y double, up_z double", piece)
    size = F.sqrt(c("up_x") * c("up_x") + c("up_y") * c("up_y") + c("up_z") * c("up_z"))
    d = d.withColumn("__up", F.when(size > 1e-6, F.array(*(c(f"up_{x}") / size for x in "xyz"))))
    last = Window.partitionBy(key).orderBy("t_us").rangeBetween(-WOBBLE_US, 0)
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    d = d.withColumn("__first", F.first("__up", True).over(last))
    turn = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(c("__first"), c("__up"))))
    d = d.withColumns({"yaw_rate": F.coalesce(-dot(F.array("gx", "gy", "gz"), c("__up")), F.lit(0.0)), "wobble_deg": F.coalesce(F.degrees(F.acos(turn)), F.lit(0.0))})
    return d.withColumn("handling", c("wobble_deg") > HANDLING_DEG).drop("__up", "__first")
