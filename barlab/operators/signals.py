"""Sessions, slots and causal signals of bars. Every window is within a contract and, but
for the gap from the bar before, within a session."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_session():
    return Window.partitionBy("contract", "session").orderBy("ts")


def with_slots(bars: DataFrame) -> DataFrame:
    """Adds the session (the day) and the bar's slot in it, from 0."""
    return bars.withColumn("session", F.to_date("ts")).withColumn("slot", F.row_number().over(in_session()) - 1)


def window_slots(window: tuple[float, float], session_bars: int) -> tuple[int, int]:
    """Slots [start, stop) of a fraction of the calendar session, not of the seen one: what
    is cut off the data's end changes no slot before it."""
    low, high = window
    if not 0 <= low < high <= 1 or session_bars <= 1:
        raise ValueError("a window is 0 <= start < end <= 1 of more than one bar")
    return math.floor(low * session_bars), math.ceil(high * session_bars)


def momentum(bars: DataFrame, window: tuple[float, float] = (0.1, 0.9), session_bars: int = 24) -> DataFrame:
    """Adds ``signal``: the direction of the bar's own open-to-close return, in the window."""
    start, stop = window_slots(window, session_bars)
    inside = (F.col("slot") >= start) & (F.col("slot") < stop)
    return with_slots(bars).withColumn("signal", F.when(inside, F.signum(F.ln(F.col("close") / F.col("open")))).otherwise(0).cast("int"))


def mean_reversion(bars: DataFrame, window: tuple[float, float] = (0.1, 0.9), session_bars: int = 24) -> DataFrame:
    return momentum(bars, window, session_bars).withColumn("signal", -F.col("signal"))


#: Strategies by name; any other name is refused.
SIGNALS: dict[str, Callable] = {"current_bar_momentum": momentum, "current_bar_mean_reversion": mean_reversion}


def session_numbers(bars: DataFrame) -> DataFrame:
    """(contract, session, number): sessions counted from 0 in each contract."""
    days = bars.select("contract", "session").distinct()
    return days.withColumn("number", F.row_number().over(Window.partitionBy("contract").orderBy("session")) - 1)


def volume_thresholds(slotted: DataFrame, quantile: float = 0.993, lookback: int = 20) -> DataFrame:
    """(contract, session, threshold): the exact interpolated quantile of the bars' volumes in
    the ``lookback`` sessions before; sessions without a predecessor have none."""
    numbers = session_numbers(slotted)
    numbered = slotted.select("contract", "session", "volume").join(numbers, ["contract", "session"])
    reach = F.sequence(F.col("number") + 1, F.col("number") + lookback)
    shifted = numbered.select("contract", "volume", F.explode(reach).alias("number"))
    return shifted.groupBy("contract", "number").agg(F.percentile("volume", quantile).alias("threshold")).join(numbers, ["contract", "number"]).select("contract", "session", "threshold")


def volume_tail(bars: DataFrame, window: tuple[float, float] = (0.1, 0.9), session_bars: int = 24, quantile: float = 0.993, lookback: int = 20) -> DataFrame:
    """Adds ``signal``: direction of the open-interest change in bars of tail volume."""
    start, stop = window_slots(window, session_bars)
    slotted = with_slots(bars)
    rows = slotted.join(volume_thresholds(slotted, quantile, lookback), ["contract", "session"], "left")
    rows = rows.withColumn("oi_change", F.col("open_interest") - F.lag("open_interest").over(in_session()))
    active = (F.col("slot") >= max(1, start)) & (F.col("slot") < stop) & (F.col("volume") >= F.col("threshold"))
    return rows.withColumn("signal", F.when(active, F.signum("oi_change")).otherwise(0).cast("int")).drop("oi_change", "threshold")


def causality_breaks(bars: DataFrame, signal: Callable[[DataFrame], DataFrame], cuts: list[int]) -> DataFrame:
    """(cut, contract, ts, on_prefix, on_all): bars whose signal differs when the data end
    after each contract's first ``cut`` bars. All prefixes go through one plan."""
    w = Window.partitionBy("contract").orderBy("ts")
    numbered = bars.withColumn("position", F.row_number().over(w))
    full = signal(bars).select("contract", "ts", F.col("signal").alias("on_all"))
    prefixes = numbered.withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).filter("position <= cut")
    named = prefixes.withColumn("contract", F.struct("contract", "cut")).drop("cut", "position")
    part = signal(named).select("contract.contract", "contract.cut", "ts", F.col("signal").alias("on_prefix"))
    return part.join(full, ["contract", "ts"]).filter("on_prefix <> on_all").select("cut", "contract", "ts", "on_prefix", "on_all")


def cut_points(length: int) -> list[int]:
    """Where causality is tried: everywhere in short data, else at 8 even places at most."""
    if length <= 10:
        return list(range(2, length + 1))
    n = min(8, length - 2)
    return sorted({int(2 + (length - 3) * i / (n - 1)) for i in range(n)})
