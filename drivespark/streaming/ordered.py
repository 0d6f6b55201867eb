"""Streams in the order of their event times, and what must see them so: arbitrary state by key, with timers.

Rows wait in the state until their key's own watermark (its latest time less a delay) has passed them, and are then gone
through in order. A key that falls silent is released by a timer of processing time. Such a query goes on looking
for silent keys, so it takes a trigger of processing time (or ``once``), not ``availableNow``. The state is part of the query's
checkpoint, so a restart neither loses nor repeats what was released; with a sink that a replayed batch overwrites, each row
is there once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import gnss


def _in_order(stream: DataFrame, key: str, t_us: str, columns: Sequence[str], kernel: Callable, fields: StructType, delay_us: int, quiet_ms: int) -> DataFrame:
    """Calls ``kernel(rows, refused, upto, state)`` for each key and batch: rows that are due as (time, columns) in order, those
    that came too late or twice with their status, the time up to which the key is complete, and the state so far."""
    key_field = stream.schema[key]
    rows = stream.select(key, F.col(t_us).cast("long").alias("__t"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("__row")).where("__t IS NOT NULL")

    def run(keys, frames, state):
        held = json.loads(state.get[0]) if state.exists else {"wait": {}, "seen": None, "done": None, "own": None}
        wait, refused = {int(t): x for t, x in held["wait"].items()}, []
        for frame in frames:
            for t, x in zip(frame["__t"].tolist(), frame["__row"].tolist(), strict=True):
                if held["done"] is not None and t <= held["done"]:
                    refused.append((t, json.loads(x), "late"))
                elif t in wait:
                    refused.append((t, json.loads(x), "repeated"))
                else:
                    wait[t] = x
                    held["seen"] = t if held["seen"] is None else max(held["seen"], t)
        upto = math.inf if state.hasTimedOut else held["seen"] - delay_us
        due = sorted(t for t in wait if t <= upto)
        upto = max([held["done"], *due] if held["done"] is not None else due, default=None) if upto == math.inf else upto
        found, held["own"] = kernel([(t, json.loads(wait.pop(t))) for t in due], refused, upto, held["own"])
        held["done"] = upto if held["done"] is None else max(held["done"], upto) if upto is not None else held["done"]
        state.update((json.dumps(held | {"wait": wait}),))
        if wait:
            state.setTimeoutDuration(quiet_ms)
        if found:
            yield pd.DataFrame([(keys[0], *x) for x in found], columns=[key, *fields.names]).astype({key: object})

    out = StructType([key_field, *fields])
    return rows.groupBy(key).applyInPandasWithState(run, out, StructType([StructField("held", StringType())]), "append", GroupStateTimeout.ProcessingTimeTimeout)


def release_in_order(stream: DataFrame, key: str, t_us: str, columns: Sequence[str], delay_us: int = 200_000, quiet_ms: int = 10_000) -> DataFrame:
    """``key, t_us, status`` and ``columns`` of the stream: each row once, in the order of time within its key.

    ``released`` rows come when their key has seen a time ``delay_us`` later, or nothing for ``quiet_ms``. ``late`` rows came
    after a later time had been released, ``repeated`` ones while a row of their key and time was waiting; both are passed on,
    so counting them is an aggregate. Rows without a time are left out; a null key is a key.
    """
    kinds = StructType([stream.schema[c] for c in columns])
    fields = StructType.fromDDL("t_us long, status string, body string")

    def kernel(rows, refused, upto, state):
        return [(t, "released", json.dumps(x)) for t, x in rows] + [(t, status, json.dumps(x)) for t, x, status in refused], state

    out = _in_order(stream, key, t_us, columns, kernel, fields, delay_us, quiet_ms)
    return out.select(key, "t_us", "status", F.from_json("body", kinds).alias("b")).select(key, "t_us", "status", "b.*")


class ReceiverState:
    """What the health of one receiver depends on, by event; ``held`` is all of it, and JSON can hold it."""

    def __init__(self, held: dict | None):
        self.held = held or {"fix": None, "sample": None, "cn0": [], "gain": [], "accuracy": [], "clock": None, "rejects": [], "shown": None, "told": None}

    def timer(self) -> int | None:
        """When the receiver is without a fix for too long, unless one comes."""
        h = self.held
        return None if h["fix"] is None or h["told"] == h["fix"] else h["fix"] + gnss.STALE_US + 1

    def at(self, t: int, event: dict | None) -> tuple[str, list[str], str | None]:
        """The reported state at an event (None: the timer), the reasons of the evidence, and the state before."""
        h, sample = self.held, event is not None and event["kind"] == "sample"
        if event is not None and event["kind"] == "fix":
            if event["reject"] in (None, "none"):
                h["fix"] = t
                if event["accuracy_m"] is not None and math.isfinite(event["accuracy_m"]):
                    h["accuracy"] = (h["accuracy"] + [event["accuracy_m"]])[-gnss.ACCURACIES :]
            else:
                h["rejects"].append([t, event["reject"]])
        elif event is None:
            h["told"] = h["fix"]
        else:
            h["sample"] = {c: event[c] for c in gnss.SAMPLE}
        h["rejects"] = [r for r in h["rejects"] if t - r[0] <= gnss.REJECTS_US]
        raw, why = self._evidence(t)
        if sample:
            for name, column in (("cn0", "mean_cn0"), ("gain", "gain_db")):
                if event[column] is not None:
                    h[name] = (h[name] + [event[column]])[-gnss.HISTORY :]
            h["clock"] = event["clock_count"] if event["clock_count"] is not None else h["clock"]
        before = h["shown"] and h["shown"][0]
        h["shown"] = gnss.settle(t, raw, h["shown"])
        return h["shown"][0], why, before

    def _evidence(self, t: int) -> tuple[str, list[str]]:
        h = self.held
        if h["fix"] is None:
            return "waiting", ["no_fix_yet"]
        if t - h["fix"] > gnss.STALE_US:
            return "outage", ["no_accepted_fix"]
        s = h["sample"] or dict.fromkeys(gnss.SAMPLE)
        mean = lambda xs: sum(xs) / len(xs)
        least = lambda x, bound: x is not None and x >= bound
        drop = lambda xs, x: mean(xs) - x if xs and x is not None else None
        rejects, jumps = (sum(r[1] in names for r in h["rejects"]) for names in (gnss.JUMP_REASONS, gnss.TURN_REASONS))
        *earlier, last = h["accuracy"] or [0.0]
        rules = {
            "interference": {"signal_drop": least(drop(h["cn0"], s["mean_cn0"]), gnss.DROP_DB) and least(s["kinds"], gnss.DROP_KINDS) and least(s["visible"], gnss.DROP_SATELLITES), "gain_drop": least(drop(h["gain"], s["gain_db"]), gnss.GAIN_DB), "clock_jump": None not in (s["clock_count"], h["clock"]) and s["clock_count"] > h["clock"] and rejects > 0},
            "multipath": {"many_multipath": least(s["multipath"], gnss.MANY_MULTIPATH), "wide_and_low": least(s["cn0_range"], gnss.WIDE_DB) and least(s["low_share"], gnss.LOW_SHARE), "jumps_while_strong": jumps >= gnss.JUMPS and least(s["mean_cn0"], gnss.STRONG_DB)},
            "degraded": {"few_used": bool(s["used"]) and s["used"] < gnss.FEW_USED, "weak_signal": s["mean_cn0"] is not None and s["mean_cn0"] < gnss.WEAK_DB, "accuracy_worsens": len(earlier) >= 2 and mean(earlier) > 0 and last > 1.5 * mean(earlier), "rejected_fixes": rejects > 0},
        }
        for state, tests in rules.items():
            if any(tests.values()):
                return state, [name for name, holds in tests.items() if holds]
        return "normal", []


def gnss_health_stream(stream: DataFrame, key: str = "drive_id", t_us: str = "t_us", delay_us: int = 2_000_000, quiet_ms: int = 10_000) -> DataFrame:
    """``key, t_us, state, before, reasons``: the changes of ``gnss.gnss_health``, for a stream of its events.

    An outage begins six seconds after the last accepted fix, once the key's watermark is past that, whether an event tells it
    or not; a receiver that falls silent altogether is in an outage from the first later event on. Late and repeated events
    are left out.
    """
    fields = StructType.fromDDL("t_us long, state string, before string, reasons array<string>")

    def kernel(rows, refused, upto, state):
        own, out = ReceiverState(state), []

        def note(t, event):
            shown, why, before = own.at(t, event)
            if shown != before:
                out.append((t, shown, before, why))

        for t, event in rows:
            if (due := own.timer()) is not None and due < t:
                note(due, None)
            note(t, event)
        if upto is not None and (due := own.timer()) is not None and due <= upto:
            note(due, None)
        return out, own.held

    finite = {n: F.when(~F.isnan(n), F.col(n)) for n, kind in stream.dtypes if kind in ("double", "float")}
    stream = stream.withColumns(finite) if finite else stream
    return _in_order(stream, key, t_us, ["kind", "reject", "accuracy_m", *gnss.SAMPLE], kernel, fields, delay_us, quiet_ms)
