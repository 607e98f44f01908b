"""Metrics of forward performance. Functions of a frame with (key, session, net_pnl) rows
work within the key; a key is a strategy or contract, whose sessions are a short list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SESSIONS_A_YEAR = 252.0


def _order(key: str, order: str = "session"):
    return Window.partitionBy(key).orderBy(order)


def session_pnl(trades: DataFrame, key: str = "contract") -> DataFrame:
    """Trades and sums by the session of their entry."""
    return trades.groupBy(key, F.to_date("entry_ts").alias("session")).agg(F.count("*").alias("trades"), F.sum("gross_pnl").alias("gross_pnl"), F.sum("net_pnl").alias("net_pnl"))


def session_returns(sessions: DataFrame, capital: float, key: str = "contract") -> DataFrame:
    """Adds ``ret``: a session's result over the equity before it, 8 places. Equity of zero
    or less stops the query."""
    before = F.coalesce(F.sum("net_pnl").over(_order(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + capital
    rows = sessions.withColumn("equity", before)
    return rows.withColumn("ret", F.when(F.col("equity") > 0, F.round(F.col("net_pnl") / F.col("equity"), 8)).otherwise(F.raise_error(F.lit("insolvent")).cast("double"))).drop("equity")


def rolling_sharpe(returns: DataFrame, width: int = 30, least: int = 10, key: str = "contract") -> DataFrame:
    """Adds ``sharpe`` of the last ``width`` sessions; null for fewer than ``least`` sessions
    or no spread."""
    w = _order(key).rowsBetween(-width + 1, 0)
    n, s = F.count("ret").over(w), F.stddev_samp("ret").over(w)
    return returns.withColumn("sharpe", F.when((n >= least) & (s * s > 1e-14), F.round(F.try_divide(F.avg("ret").over(w), s) * SESSIONS_A_YEAR**0.5, 4)))


def rolling_pnl(sessions: DataFrame, width: int, key: str = "contract") -> DataFrame:
    return sessions.withColumn("rolling_pnl", F.round(F.sum("net_pnl").over(_order(key).rowsBetween(-width + 1, 0)), 4))


def equity_curve(events: DataFrame, capital: float, key: str = "contract", at: str = "session", value: str = "net_pnl") -> DataFrame:
    """(key, at, equity): capital and all results up to each time."""
    sums = events.groupBy(key, at).agg(F.sum(value).alias("v"))
    return sums.select(key, at, (F.sum("v").over(_order(key, at).rowsBetween(Window.unboundedPreceding, 0)) + capital).alias("equity"))


def drawdown_bps(curve: DataFrame, key: str = "contract", at: str = "session") -> DataFrame:
    """Largest fall from the running peak in hundredths of a percent of it; 10000 where
    equity is used up, and never more."""
    peak = F.max("equity").over(_order(key, at).rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumn("peak", peak)
    fall = F.when((F.col("peak") <= 0) | (F.col("equity") <= 0), 10000.0).otherwise(F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")) * 10000)
    return rows.groupBy(key).agg(F.round(F.least(F.lit(10000.0), F.greatest(F.lit(0.0), F.max(fall))), 4).alias("drawdown_bps"))


def drawdown_of_capital(trades: DataFrame, capital: float, key: str = "contract", at: str = "entry_ts") -> DataFrame:
    """Largest fall of the summed results below their peak (zero at the start), in
    hundredths of a percent of the capital."""
    w = _order(key, at).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.select(key, at, F.sum("net_pnl").over(w).alias("total"))
    rows = rows.select(key, "total", F.greatest(F.lit(0.0), F.max("total").over(w)).alias("peak"))
    return rows.groupBy(key).agg((F.max(F.col("peak") - F.col("total")) / capital * 10000).alias("drawdown_bps"))


def inactive_sessions(sessions: DataFrame, key: str = "contract") -> DataFrame:
    """(key, inactive): sessions without trades since the last one with trades."""
    numbered = sessions.withColumn("i", F.row_number().over(_order(key)))
    return numbered.groupBy(key).agg((F.count("*") - F.coalesce(F.max(F.when(F.col("trades") > 0, F.col("i"))), F.lit(0))).alias("inactive"))


def trade_quality(trades: DataFrame, key: str = "contract", least: int = 5, value: str = "net_pnl") -> DataFrame:
    """Share of trades above zero and mean result; null for fewer than ``least`` trades."""
    enough = F.count("*") >= least
    return trades.groupBy(key).agg(F.count("*").alias("trades"), F.when(enough, F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0))).alias("win_rate"), F.when(enough, F.avg(value)).alias("expectancy"))


def fill_costs(fills: DataFrame, key: str, lot_size: int = 1) -> DataFrame:
    """Cost and slippage in hundredths of a percent of turnover, from fills (price,
    quantity, cost, slippage); no turnover gives zeros."""
    turnover = F.sum(F.col("price") * F.col("quantity") * lot_size)
    bps = lambda x: F.when(turnover > 0, F.try_divide(x, turnover) * 10000).otherwise(0.0)
    cost, slip = F.greatest(F.lit(0.0), F.sum("cost")), F.greatest(F.lit(0.0), F.sum("slippage"))
    return fills.groupBy(key).agg(turnover.alias("turnover"), bps(cost + slip).alias("cost_bps"), bps(slip).alias("slippage_bps"))


def peak_exposure(positions: DataFrame, key: str, lot_size: int = 1) -> DataFrame:
    return positions.groupBy(key).agg(F.max(F.abs("quantity") * F.col("price") * lot_size).alias("peak_exposure"))


def rejection_rate(orders: DataFrame, key: str, rejected: str) -> DataFrame:
    """Orders, rejected ones, and their share. A key without orders has no row."""
    bad = F.count_if(F.col("status") == rejected)
    return orders.groupBy(key).agg(F.count("*").alias("submitted"), bad.alias("rejected"), (bad / F.count("*")).alias("rejection_rate"))


def latest_pnl(positions: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """The realised result at each key's last snapshot; of ties the one recorded first."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), "recorded")
    return positions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*key, at, value)


def overnight_spills(trades: DataFrame, key: str, entry: str, exit_: str) -> DataFrame:
    return trades.groupBy(key).agg(F.count_if(F.col(entry).isNotNull() & F.col(exit_).isNotNull() & (F.col(entry) != F.col(exit_))).alias("spills"))


def frequency_ratio(trades, sessions, base_trades, base_sessions, least: int = 10):
    """Trades a session against the baseline's; null below ``least`` sessions."""
    base = F.try_divide(base_trades, base_sessions)
    return F.when((sessions >= least) & (base > 0), F.try_divide(F.try_divide(trades, sessions), base))


def drawdown_ratio(observed, baseline, sessions, least: int = 5):
    """Observed over baseline drawdown, the latter of at least one hundredth of a percent."""
    return F.when(sessions >= least, observed / F.greatest(F.lit(1.0), baseline))


def closed_window(rows: DataFrame, at: str, start: str, stop: str) -> DataFrame:
    """Rows of an evaluation window; both ends belong to it (zones leave their end out)."""
    return rows.filter(F.col(at).between(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")))


# The degradation rules' names and least samples.
DROPOUT_SESSIONS, LEAST_ORDERS = 30, 10
RULES = ("RULE_DD_EXPANSION_CRITICAL", "RULE_RISK_REJECTION_SPIKE", "RULE_SHARPE_COLLAPSE", "RULE_SLIPPAGE_ANOMALY", "RULE_TRADE_DROPOUT")


def degradations(snapshots: DataFrame, *, expansion: float = 1.5, least_sharpe: float = 0.0, drift: float = 2.0, most_rejected: float = 0.2) -> DataFrame:
    """(key, rule, observed, threshold) for each broken rule, from one wide row a snapshot:
    (key, drawdown_bps, base_drawdown_bps, sharpe, slippage_bps, base_slippage_bps,
    rejection_rate, submitted, inactive). All limits are strict, but for inactivity."""
    rule = lambda name, hit, observed, threshold: F.when(hit, F.struct(F.lit(name).alias("rule"), observed.cast("double").alias("observed"), threshold.cast("double").alias("threshold")))
    dd, slip = F.col("base_drawdown_bps") * expansion, F.col("base_slippage_bps") * drift
    found = F.array(
        rule(RULES[0], F.col("drawdown_bps") > dd, F.col("drawdown_bps"), dd),
        rule(RULES[1], (F.col("submitted") >= LEAST_ORDERS) & (F.col("rejection_rate") > most_rejected), F.col("rejection_rate"), F.lit(most_rejected)),
        rule(RULES[2], F.col("sharpe") < least_sharpe, F.col("sharpe"), F.lit(least_sharpe)),
        rule(RULES[3], F.col("slippage_bps") > slip, F.col("slippage_bps"), slip),
        rule(RULES[4], F.col("inactive") >= DROPOUT_SESSIONS, F.col("inactive"), F.lit(DROPOUT_SESSIONS)),
    )
    return snapshots.select("key", F.explode(F.array_compact(found)).alias("r")).select("key", "r.*")


def holding_bars(trades: DataFrame, key: str = "contract", bars: str = "bars_held") -> DataFrame:
    """(key, trades, mean_bars): the mean number of bars that a key's trades were held."""
    return trades.groupBy(key).agg(F.count(bars).alias("trades"), F.round(F.avg(bars), 4).alias("mean_bars"))


def limit_utilisation(peak, limit):
    """A peak over the limit set for it, 4 places, not below 0; null without a limit."""
    return F.when(limit > 0, F.round(F.greatest(F.lit(0.0), peak) / limit, 4))
