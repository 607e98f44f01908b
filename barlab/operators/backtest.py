"""Next-bar backtests as windows, with date-effective costs by a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEXT_OPEN, SAME_CLOSE = "next_bar_open_v1", "same_bar_close_v0"


def cost_schedule(spark: SparkSession, periods: list[tuple[str, str | None, float]]) -> DataFrame:
    """(effective_from, effective_to, round_trip_bps); both ends belong to a period."""
    return spark.createDataFrame(periods, "f string, t string, round_trip_bps double").select(F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to"), "round_trip_bps")


def spans(periods: DataFrame, columns: list[str]) -> DataFrame:
    """(since, until, n, columns...): the time line cut where a period begins or is over,
    how many periods hold each piece, and the columns of that period where it is one. The
    pieces are disjoint, the last has a null ``until``. A piece begins at a date of its own,
    so there are no more pieces than dates; what runs over them in order is that short."""
    known = periods.filter("effective_from is not null and (effective_to is null or effective_to >= effective_from)")
    known = known.select("effective_from", "effective_to", *columns).withColumn("_i", F.row_number().over(Window.orderBy("effective_from", "effective_to", *columns)))
    begin = known.select(F.col("effective_from").alias("since"), F.lit(1).alias("d"), F.col("_i").alias("i"))
    over = known.filter("effective_to is not null").select(F.date_add("effective_to", 1).alias("since"), F.lit(-1).alias("d"), (-F.col("_i")).alias("i"))
    edges, order = begin.unionByName(over).groupBy("since").agg(F.sum("d").alias("d"), F.sum("i").alias("i")), Window.orderBy("since")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)  # where one period holds, the sum of the numbers is its number
    held = edges.select("since", F.lead("since").over(order).alias("until"), F.sum("d").over(so_far).alias("n"), F.sum("i").over(so_far).alias("_i"))
    return held.withColumn("_i", F.when(F.col("n") == 1, F.col("_i"))).join(known.select("_i", *columns), "_i", "left").drop("_i")


def with_period(rows: DataFrame, date: str, periods: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``columns`` of the period (effective_from, effective_to) that holds ``date``,
    both ends included, an end of null open; a date in no period or in several stops the
    query. Nothing runs while the plan is built. The rows meet the pieces of the time line
    by month, each the one piece that holds its day; months behind the last edge are all
    alike and count as one. The rows are read once and not moved: pieces are sent to them,
    at most one for each date between the first edge and the last, and one for each month."""
    month = lambda d: F.trunc(d, "month")
    pieces = spans(periods, columns)
    behind = F.add_months(month(F.max("since")), 1)
    last = pieces.agg(behind.alias("m")).scalar()  # a month that stands for all later ones
    until = F.coalesce(month(F.date_sub("until", 1)), F.add_months(month("since"), 1))
    sent = pieces.withColumn("_month", F.explode(F.sequence(month("since"), until, F.expr("interval 1 month"))))
    sent = sent.select("_month", F.col("since").alias("_since"), F.col("until").alias("_until"), F.col("n").alias("_n"), *(F.col(c).alias(f"_of_{c}") for c in columns))
    dated = rows.withColumn("_day", F.to_date(date)).withColumn("_key", F.least(month("_day"), last))
    within = (F.col("_key") == F.col("_month")) & (F.col("_day") >= F.col("_since")) & (F.col("_until").isNull() | (F.col("_day") < F.col("_until")))
    joined = dated.join(F.broadcast(sent), within, "left")
    stop = lambda kind: F.raise_error(F.concat(F.lit("not one period for "), F.coalesce(F.col("_day").cast("string"), F.lit("null")))).cast(kind)
    kinds = dict(periods.dtypes)
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_n") == 1, F.col(f"_of_{c}")).otherwise(stop(kinds[c])))
    return joined.drop("_day", "_key", "_month", "_since", "_until", "_n", *(f"_of_{c}" for c in columns))


def with_cost(rows: DataFrame, date: str, schedule: DataFrame) -> DataFrame:
    """Adds ``cost_bps`` of the cost period that holds ``date``."""
    return with_period(rows, date, schedule.withColumnRenamed("round_trip_bps", "cost_bps"), ["cost_bps"])


INPUT = ("contract", "session", "ts", "open", "close", "signal")


def trades(signals: DataFrame, *, model: str = NEXT_OPEN, slippage_bps: float = 0.0, schedule: DataFrame | None = None, quantity: int = 1, lot_size: int = 1, same_session: bool = True) -> DataFrame:
    """One trade for each non-zero signal that has a next bar: entered and left at that bar
    (or, in the look-ahead canary model, from this close to the next open)."""
    if model not in (NEXT_OPEN, SAME_CLOSE):
        raise ValueError(f"no trades by a model called {model!r}")
    if quantity <= 0 or lot_size <= 0 or slippage_bps < 0:
        raise ValueError("quantity and lot size are positive, slippage is not negative")
    lack = [c for c in INPUT if c not in signals.columns]
    if lack:
        raise ValueError(f"the signals lack {', '.join(lack)}")
    number = F.col("signal").cast("double")
    wild = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    signals = signals.withColumn("signal", F.when(wild, F.raise_error(F.lit("a signal is not finite")).cast("double")).otherwise(number))
    w = Window.partitionBy(*(["contract", "session"] if same_session else ["contract"])).orderBy("ts")
    rows = signals.select("contract", "session", "ts", "close", F.signum("signal").cast("int").alias("side"), F.lead("ts").over(w).alias("entry_ts"), F.lead("open").over(w).alias("next_open"), F.lead("close").over(w).alias("next_close"))
    rows = rows.filter("side <> 0 and entry_ts is not null")
    raw_in, raw_out = ("next_open", "next_close") if model == NEXT_OPEN else ("close", "next_open")
    slip, size = slippage_bps / 10000.0, quantity * lot_size
    rows = rows.withColumn("entry_price", F.col(raw_in) * (1 + F.col("side") * slip)).withColumn("exit_price", F.col(raw_out) * (1 - F.col("side") * slip))
    rows = with_cost(rows, "entry_ts", schedule) if schedule is not None else rows.withColumn("cost_bps", F.lit(0.0))
    gross = F.col("side") * (F.col("exit_price") / F.col("entry_price") - 1) * 10000
    rows = rows.withColumn("gross_bps", gross).withColumn("net_bps", gross - F.col("cost_bps"))
    rows = rows.withColumn("gross_pnl", F.col("side") * (F.col("exit_price") - F.col("entry_price")) * size).withColumn("costs", F.col("entry_price") * size * (F.col("cost_bps") / 10000))
    return rows.withColumn("net_pnl", F.col("gross_pnl") - F.col("costs")).select("contract", "session", F.col("ts").alias("signal_ts"), "entry_ts", F.col("entry_ts").alias("exit_ts"), "side", "entry_price", "exit_price", "gross_bps", "cost_bps", "net_bps", "gross_pnl", "costs", "net_pnl")


def totals(of: DataFrame, by: list[str]) -> DataFrame:
    """Sums and means of trades; without grouping, no trades give zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return of.groupBy(*by).agg(
        F.count("*").alias("trades"), zero(F.sum("gross_pnl")).alias("gross_pnl"), zero(F.sum("costs")).alias("costs"), zero(F.sum("net_pnl")).alias("net_pnl"),
        zero(F.avg("gross_bps")).alias("mean_gross_bps"), zero(F.avg("net_bps")).alias("mean_net_bps"),
    )
