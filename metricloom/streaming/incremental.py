"""Metrics of a stream: sums are kept by slice as state, values are expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.slicing import fan_out
from metricloom.plans.config import EvalConfig
from metricloom.plans.evaluate import plan, valued


def running_metrics(stream: DataFrame, config: EvalConfig, time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """``[window,] slice_key`` and a column for each metric; the same for a stream or a table.

    With ``time`` and ``window`` sums are kept for each window until the watermark (``late`` behind the latest time) has
    passed it; without, for all time: the state grows with the slices, not with the rows.
    """
    p = plan(config.verified())
    by: list[Column | str] = ["slice_key"]
    if time and window:
        stream = stream.withWatermark(time, late)
        by = [F.window(time, window).alias("window"), *by]
    sums = fan_out(stream.withColumns({f"__s{i}": c for i, c in enumerate(p.states.values())}), config.slices).groupBy(*by).agg(*(getattr(F, p.kinds.get(n, "sum"))(f"__s{i}").alias(n) for i, n in enumerate(p.states)))
    keep = ["window", "slice_key"] if time and window else ["slice_key"]
    return valued(sums, p, keep).select(*keep, *(f"`{x}`" for x in p.shown()))
