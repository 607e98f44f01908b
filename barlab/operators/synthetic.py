"""Synthetic bars, nulls and planted effects. The recursive volatility needs a group; what
is rebuilt from log-return components is a running sum over a contract."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.sources.bars import BAR


def path():
    return Window.partitionBy("contract").orderBy("ts")


def running():
    return path().rowsBetween(Window.unboundedPreceding, 0)


def generate(spark: SparkSession, seeds: list[int], *, sessions: int = 20, bars: int = 60, start: str = "2024-01-01", price: float = 18_000.0, sigma: float = 0.18, gap_bps: float = 20.0, jitter_bps: float = 0.5, wick_bps: float = 2.0, profile: tuple[float, ...] = (1.6, 1.0, 0.8, 1.0, 1.5)) -> DataFrame:
    """Bars with clustered volatility, one contract for each seed, each by its own task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf["seed"].iloc[0])
        rng, n = np.random.default_rng(seed), sessions * bars
        z = rng.standard_normal(n)
        base = sigma**2 / (252 * bars)
        r, var, last = np.empty(n), base, 0.0
        for i in range(n):
            var = base if i == 0 else max(0.02 * base + 0.08 * last * last + 0.90 * var, 1e-16)
            last = r[i] = np.sqrt(var) * z[i]
        shape = np.interp(np.linspace(0, 1, bars), np.linspace(0, 1, len(profile)), profile)
        r *= np.tile(shape / shape.mean(), sessions)
        first = np.arange(n) % bars == 0
        gap = rng.normal(0, np.where(first, gap_bps, jitter_bps) / 1e4)
        close = price * np.exp(np.cumsum(gap + r))
        open_ = close / np.exp(r)
        up, down = np.abs(rng.normal(0, wick_bps / 1e4, (2, n)))
        volume = np.exp(rng.normal(np.log(1000), 0.35, n)).astype(int)
        oi = np.maximum(100_000, 250_000 + np.cumsum(rng.normal(0, 200, n))).astype(int)
        days = pd.bdate_range(start, periods=sessions) + pd.Timedelta(hours=9, minutes=15)
        ts = (days.repeat(bars) + pd.to_timedelta(np.tile(np.arange(bars), sessions), unit="min")).as_unit("us")
        return pd.DataFrame({"contract": f"SYN{seed}", "ts": ts, "open": open_, "high": np.maximum(open_, close) * np.exp(up), "low": np.minimum(open_, close) * np.exp(-down), "close": close, "volume": volume, "open_interest": oi})

    return spark.createDataFrame([(s,) for s in seeds], "seed bigint").groupBy("seed").applyInPandas(run, BAR)


def components(bars: DataFrame) -> DataFrame:
    """Adds the log returns from the close before to the open (``gap``, of the first bar from
    its own close) and from open to close (``intrabar``), and the wicks over the body."""
    before = F.coalesce(F.lag("close").over(path()), F.col("close"))
    return (
        bars.withColumn("gap", F.ln(F.col("open") / before)).withColumn("intrabar", F.ln(F.col("close") / F.col("open")))
        .withColumn("wick_up", F.ln(F.col("high") / F.greatest("open", "close"))).withColumn("wick_down", F.ln(F.least("open", "close") / F.col("low")))
    )


def rebuilt(parts: DataFrame) -> DataFrame:
    """Prices from components: the first close, times the exponential of the running sum."""
    start = F.first("close").over(running())
    rows = parts.withColumn("_close", start * F.exp(F.sum(F.col("gap") + F.col("intrabar")).over(running())))
    rows = rows.withColumn("_open", F.col("_close") / F.exp("intrabar")).withColumn("open", F.col("_open")).withColumn("close", F.col("_close"))
    rows = rows.withColumn("high", F.greatest("open", "close") * F.exp("wick_up")).withColumn("low", F.least("open", "close") * F.exp(-F.col("wick_down")))
    return rows.drop("_open", "_close", "gap", "intrabar", "wick_up", "wick_down")


def coin(seed: int, name: str) -> Column:
    """A sign that depends on seed, contract and time only."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "contract", "ts"), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def directional_null(bars: DataFrame, seed: int = 31) -> DataFrame:
    """Both return components keep their sizes and get independent signs."""
    parts = components(bars)
    return rebuilt(parts.withColumn("gap", F.col("gap") * coin(seed, "gap")).withColumn("intrabar", F.col("intrabar") * coin(seed, "intrabar")))


def block_bootstrap(bars: DataFrame, block: int = 5, seed: int = 11) -> DataFrame:
    """Whole sessions in drawn blocks, laid over the original calendar. The draws are a row a
    session; bars meet them in an equi-join on contract and session number."""
    parts = components(bars).withColumn("session", F.to_date("ts"))
    days = parts.groupBy("contract").agg(F.array_sort(F.collect_set("session")).alias("days"))
    place = F.posexplode("days").alias("at", "target")
    slots = days.select("contract", "days", F.size("days").alias("n"), place)
    draw = F.pmod(F.xxhash64(F.lit(seed), "contract", F.floor(F.col("at") / block)), F.greatest(F.col("n") - block + 1, F.lit(1)))
    drawn = slots.select("contract", "target", F.col("days")[(draw + F.col("at") % block).cast("int")].alias("session"))
    w = Window.partitionBy("contract", "session").orderBy("ts")
    source = parts.withColumn("slot", F.row_number().over(w))
    calendar = bars.select("contract", "ts", F.to_date("ts").alias("target")).withColumn("slot", F.row_number().over(Window.partitionBy("contract", "target").orderBy("ts")))
    rows = drawn.join(source.drop("ts"), ["contract", "session"]).join(calendar, ["contract", "target", "slot"])
    return rebuilt(rows.drop("session", "target", "slot"))


def planted_edge(signals: DataFrame, net_bps: float, cost_bps: float = 2.0) -> DataFrame:
    """Adds a move in the signal's direction to the next bar's open-to-close return within
    the session; net of the cost it is worth ``net_bps``."""
    w = Window.partitionBy("contract", "session").orderBy("ts")
    push = F.coalesce(F.lag("signal").over(w), F.lit(0)) * ((net_bps + cost_bps) / 10000)
    return rebuilt(components(signals).withColumn("intrabar", F.col("intrabar") + push))


def gap_canary(signals: DataFrame, bps: float = 25.0) -> DataFrame:
    """Shifts all prices after a signal by its direction: the move lies wholly between a close
    and the next open, where only a look-ahead fill can earn it."""
    rows = signals.withColumn("_push", F.coalesce(F.lag("signal").over(path()), F.lit(0)) * (bps / 10000))
    rows = rows.withColumn("_f", F.exp(F.sum("_push").over(running())))
    for c in ("open", "high", "low", "close"):
        rows = rows.withColumn(c, F.col(c) * F.col("_f"))
    return rows.drop("_push", "_f")
