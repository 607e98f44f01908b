"""Registered queries of the core library over the driver's tables, and the SQL that each
must equal. Bars are hourly bars of events; fills come from lineitem, ledgers from orders."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.scalars import rounded, to_tick
from barlab.operators import backtest, ledger, monitoring, readmodels, replay, signals, statistics, synthetic, zones
from barlab.plans import research
from barlab.sources.bars import bars_of_events, violations
from barlab.streaming import bars as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SLIP_BPS, CAPITAL = 1.0, 100_000.0
COSTS = [("2024-01-01", "2024-01-14", 2.0), ("2024-01-15", None, 5.0)]
STATES = ["O", "F", "P", "X"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark, sf) -> DataFrame:
    return bars_of_events(load(spark, sf, "events"))


def made_trades(spark, sf, model: str = backtest.NEXT_OPEN) -> DataFrame:
    return backtest.trades(signals.momentum(bars(spark, sf)), model=model, slippage_bps=SLIP_BPS, schedule=backtest.cost_schedule(spark, COSTS))


def r6(*columns: str) -> list:
    return [rounded(F.col(c)).alias(c) for c in columns]


def day():
    return F.col("session").cast("string").alias("session")


def s6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


BARS = """bars AS (SELECT event_type AS contract, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, events.ts) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, events.ts) AS close, count(*) AS volume, count(DISTINCT user_id) AS open_interest FROM events WHERE value > 0 GROUP BY 1, 2)"""
SLOTS = BARS + """, slots AS (SELECT *, ts::DATE AS session, row_number() OVER (PARTITION BY contract, ts::DATE ORDER BY ts) - 1 AS slot FROM bars),
sig AS (SELECT *, (CASE WHEN slot >= 2 AND slot < 22 THEN sign(ln(close / open)) ELSE 0 END)::INTEGER AS signal FROM slots)"""


def _trades_sql(model: str = "next") -> str:
    entry, leave = ("no", "nc") if model == "next" else ("close", "no")
    return SLOTS + f""", nxt AS (SELECT *, lead(ts) OVER w AS entry_ts, lead(open) OVER w AS no, lead(close) OVER w AS nc FROM sig WINDOW w AS (PARTITION BY contract, session ORDER BY ts)),
px AS (SELECT contract, session, ts AS signal_ts, entry_ts, signal AS side, {entry} * (1 + signal * 0.0001::DOUBLE) AS entry_price, {leave} * (1 - signal * 0.0001::DOUBLE) AS exit_price,
 CASE WHEN entry_ts::DATE <= DATE '2024-01-14' THEN 2.0::DOUBLE ELSE 5.0::DOUBLE END AS cost_bps FROM nxt WHERE signal <> 0 AND entry_ts IS NOT NULL),
tr AS (SELECT *, side * (exit_price / entry_price - 1) * 10000 AS gross_bps, side * (exit_price / entry_price - 1) * 10000 - cost_bps AS net_bps,
 side * (exit_price - entry_price) AS gross_pnl, entry_price * (cost_bps / 10000) AS costs, side * (exit_price - entry_price) - entry_price * (cost_bps / 10000) AS net_pnl FROM px)"""


TRADES = _trades_sql()
TRADE_NUMBERS = ["entry_price", "exit_price", "gross_bps", "cost_bps", "net_bps", "gross_pnl", "costs", "net_pnl"]
SESSIONS = TRADES + ", ses AS (SELECT contract, entry_ts::DATE AS session, count(*) AS trades, sum(gross_pnl) AS gross_pnl, sum(net_pnl) AS net_pnl FROM tr GROUP BY 1, 2)"
RETURNS = SESSIONS + ", ret AS (SELECT *, round(net_pnl / (100000.0::DOUBLE + coalesce(sum(net_pnl) OVER (PARTITION BY contract ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 8) AS ret FROM ses)"


@query("q_bars_ohlcv", f"WITH {BARS} SELECT * FROM bars")
def _(spark, sf):
    return bars(spark, sf)


@query("q_bar_violations", """WITH b AS (SELECT event_type AS contract, date_trunc('hour', ts) AS h, min(value) AS low, arg_min(value, ts) AS o, arg_max(value, ts) AS c FROM events GROUP BY 1, 2)
SELECT contract, 'not_positive' AS rule, count(*) AS n FROM b WHERE least(low, o, c) <= 0 GROUP BY 1""")
def _(spark, sf):
    return violations(bars_of_events(load(spark, sf, "events"), positive=False))


@query("q_signal_momentum", f"WITH {SLOTS} SELECT contract, ts, slot::BIGINT AS slot, signal FROM sig")
def _(spark, sf):
    return signals.momentum(bars(spark, sf)).select("contract", "ts", F.col("slot").cast("bigint").alias("slot"), "signal")


@query("q_signal_mean_reversion", f"WITH {SLOTS} SELECT contract, ts, -signal AS signal FROM sig")
def _(spark, sf):
    return signals.mean_reversion(bars(spark, sf)).select("contract", "ts", "signal")


@query("q_backtest_trades", f"WITH {TRADES} SELECT contract, signal_ts, entry_ts, side, {s6(*TRADE_NUMBERS)} FROM tr")
def _(spark, sf):
    return made_trades(spark, sf).select("contract", "signal_ts", "entry_ts", "side", *r6(*TRADE_NUMBERS))


@query("q_backtest_same_close", f"WITH {_trades_sql('same')} SELECT contract, signal_ts, entry_ts, side, {s6(*TRADE_NUMBERS)} FROM tr")
def _(spark, sf):
    return made_trades(spark, sf, backtest.SAME_CLOSE).select("contract", "signal_ts", "entry_ts", "side", *r6(*TRADE_NUMBERS))


TOTALS = ["gross_pnl", "costs", "net_pnl", "mean_gross_bps", "mean_net_bps"]


@query("q_backtest_totals", f"WITH {TRADES}, t AS (SELECT contract, count(*) AS trades, sum(gross_pnl) AS gross_pnl, sum(costs) AS costs, sum(net_pnl) AS net_pnl, avg(gross_bps) AS mean_gross_bps, avg(net_bps) AS mean_net_bps FROM tr GROUP BY 1) SELECT contract, trades, {s6(*TOTALS)} FROM t")
def _(spark, sf):
    return backtest.totals(made_trades(spark, sf), ["contract"]).select("contract", "trades", *r6(*TOTALS))


@query("q_cost_schedule_join", f"WITH {TRADES}, c(f, t, bps) AS (VALUES (DATE '2024-01-01', DATE '2024-01-14', 2.0::DOUBLE), (DATE '2024-01-15', NULL, 5.0::DOUBLE)) SELECT contract, entry_ts, bps AS cost_bps FROM px JOIN c ON entry_ts::DATE >= f AND (t IS NULL OR entry_ts::DATE <= t)")
def _(spark, sf):
    plain = backtest.trades(signals.momentum(bars(spark, sf))).drop("cost_bps")
    return backtest.with_cost(plain, "entry_ts", backtest.cost_schedule(spark, COSTS)).select("contract", "entry_ts", "cost_bps")


MOMENTS = ["mean", "std", "skewness", "kurtosis", "sharpe"]


@query("q_return_moments", f"WITH {TRADES}, m AS (SELECT contract AS trial_id, count(*) AS n, avg(net_bps) AS mean, stddev_samp(net_bps) AS std, skewness(net_bps) AS skewness, kurtosis(net_bps) AS kurtosis, avg(net_bps) / stddev_samp(net_bps) AS sharpe FROM tr GROUP BY 1) SELECT trial_id, n, {s6(*MOMENTS)} FROM m")
def _(spark, sf):
    return statistics.return_moments(trial_returns(spark, sf)).select("trial_id", "n", *r6(*MOMENTS))


def trial_returns(spark, sf) -> DataFrame:
    return made_trades(spark, sf).select(F.col("contract").alias("trial_id"), "signal_ts", F.col("net_bps").alias("net_return_bps"))


PAIRS = TRADES + """, pr AS (SELECT a.contract AS trial_a, b.contract AS trial_b, count(*) AS n_common, corr(a.net_bps, b.net_bps) AS r
 FROM tr a JOIN tr b ON a.signal_ts = b.signal_ts AND a.contract < b.contract GROUP BY 1, 2)"""


@query("q_pairwise_corr", f"WITH {PAIRS} SELECT trial_a, trial_b, n_common, CASE WHEN n_common >= 50 THEN round(r, 6) + 0.0 END AS r FROM pr")
def _(spark, sf):
    return statistics.aligned_pairs(trial_returns(spark, sf), 50).select("trial_a", "trial_b", "n_common", *r6("r"))


@query("q_eict_distance", f"WITH {PAIRS} SELECT trial_a, trial_b, round(sqrt(2 * (1 - r)), 6) + 0.0 AS dist FROM pr WHERE n_common >= 50")
def _(spark, sf):
    return statistics.aligned_pairs(trial_returns(spark, sf), 50).filter("sufficient").select("trial_a", "trial_b", *r6("dist"))


@query("q_singletons", f"WITH {PAIRS} SELECT DISTINCT contract AS trial_id FROM tr WHERE contract NOT IN (SELECT trial_a FROM pr WHERE n_common >= 220 UNION ALL SELECT trial_b FROM pr WHERE n_common >= 220)")
def _(spark, sf):
    r = trial_returns(spark, sf)
    return statistics.singletons(r, statistics.aligned_pairs(r, 220))


@query("q_eict_clusters")
def _(spark, sf):
    r = trial_returns(spark, sf)
    return statistics.clusters(r.select(F.lit("all").alias("scope"), "trial_id"), statistics.aligned_pairs(r, 50))


@query("q_deflated_sharpe")
def _(spark, sf):
    r = trial_returns(spark, sf)
    members = statistics.clusters(r.select(F.lit("all").alias("scope"), "trial_id"), statistics.aligned_pairs(r, 50))
    d = statistics.deflated_sharpe(statistics.return_moments(r), members)
    return d.select("scope", "trial_id", "n", "effective", *r6("sharpe", "sigma", "best", "se"), *(rounded(F.col(c), 5).alias(c) for c in ("z", "dsr")), "passes")


THRESHOLDS = SLOTS + """, num AS (SELECT contract, session, row_number() OVER (PARTITION BY contract ORDER BY session) - 1 AS k FROM (SELECT DISTINCT contract, session FROM slots)),
thr AS (SELECT a.contract, a.session, quantile_cont(s.volume, 0.9) AS threshold FROM num a JOIN num b ON a.contract = b.contract AND b.k BETWEEN a.k - 5 AND a.k - 1
 JOIN slots s ON s.contract = b.contract AND s.session = b.session GROUP BY 1, 2)"""


@query("q_volume_tail_threshold", f"WITH {THRESHOLDS} SELECT contract, session::VARCHAR AS session, round(threshold, 6) + 0.0 AS threshold FROM thr")
def _(spark, sf):
    return signals.volume_thresholds(signals.with_slots(bars(spark, sf)), 0.9, 5).select("contract", day(), *r6("threshold"))


@query("q_volume_tail_signal", f"""WITH {THRESHOLDS}, d AS (SELECT s.*, threshold, open_interest - lag(open_interest) OVER (PARTITION BY s.contract, s.session ORDER BY ts) AS d FROM slots s LEFT JOIN thr USING (contract, session))
SELECT contract, ts, (CASE WHEN slot >= 2 AND slot < 22 AND volume >= threshold THEN sign(d) ELSE 0 END)::INTEGER AS signal FROM d""")
def _(spark, sf):
    return signals.volume_tail(bars(spark, sf), quantile=0.9, lookback=5).select("contract", "ts", "signal")


@query("q_causality_check", "SELECT 'current_bar_momentum' AS signal, 0::BIGINT AS breaks UNION ALL SELECT 'current_bar_mean_reversion', 0")
def _(spark, sf):
    b = bars(spark, sf)
    cuts = signals.cut_points(b.groupBy("contract").count().agg(F.max("count")).first()[0] or 2)
    parts = [signals.causality_breaks(b, f, cuts).agg(F.count("*").alias("breaks")).select(F.lit(n).alias("signal"), "breaks") for n, f in signals.SIGNALS.items()]
    return parts[0].unionByName(parts[1])


@query("q_causality_lookahead", f"""WITH {BARS}, n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY contract) AS c, lead(close) OVER w AS nc FROM bars WINDOW w AS (PARTITION BY contract ORDER BY ts))
SELECT contract, i::BIGINT AS cut FROM n WHERE i IN (5, 40, 200) AND i < c AND sign(nc - close) <> 0""")
def _(spark, sf):
    """A signal that reads the next bar is caught at every cut behind which a bar follows."""
    from pyspark.sql import Window

    def ahead(rows):
        w = Window.partitionBy("contract").orderBy("ts")
        return rows.withColumn("signal", F.coalesce(F.signum(F.lead("close").over(w) - F.col("close")), F.lit(0)).cast("int"))

    return signals.causality_breaks(bars(spark, sf), ahead, [5, 40, 200]).select("contract", F.col("cut").cast("bigint").alias("cut")).distinct()


@query("q_session_pnl", f"WITH {SESSIONS} SELECT contract, session::VARCHAR AS session, trades, {s6('gross_pnl', 'net_pnl')} FROM ses")
def _(spark, sf):
    return monitoring.session_pnl(made_trades(spark, sf)).select("contract", day(), "trades", *r6("gross_pnl", "net_pnl"))


@query("q_session_returns", f"WITH {RETURNS} SELECT contract, session::VARCHAR AS session, {s6('ret')} FROM ret")
def _(spark, sf):
    return monitoring.session_returns(monitoring.session_pnl(made_trades(spark, sf)), CAPITAL).select("contract", day(), *r6("ret"))


@query("q_rolling_sharpe", f"""WITH {RETURNS} SELECT contract, session::VARCHAR AS session, CASE WHEN count(ret) OVER w >= 10 AND stddev_samp(ret) OVER w * stddev_samp(ret) OVER w > 1e-14
 THEN round(avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252.0), 4) + 0.0 END AS sharpe FROM ret WINDOW w AS (PARTITION BY contract ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    returns = monitoring.session_returns(monitoring.session_pnl(made_trades(spark, sf)), CAPITAL)
    return monitoring.rolling_sharpe(returns, 20).select("contract", day(), (F.col("sharpe") + 0.0).alias("sharpe"))


@query("q_rolling_pnl", f"WITH {SESSIONS} SELECT contract, session::VARCHAR AS session, round(sum(net_pnl) OVER (PARTITION BY contract ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) + 0.0 AS rolling_pnl FROM ses")
def _(spark, sf):
    return monitoring.rolling_pnl(monitoring.session_pnl(made_trades(spark, sf)), 5).select("contract", day(), (F.col("rolling_pnl") + 0.0).alias("rolling_pnl"))


CURVE = SESSIONS + ", eq AS (SELECT contract, session, 100000.0::DOUBLE + sum(net_pnl) OVER (PARTITION BY contract ORDER BY session) AS equity FROM ses)"


@query("q_equity_curve", f"WITH {CURVE} SELECT contract, session::VARCHAR AS session, {s6('equity')} FROM eq")
def _(spark, sf):
    return monitoring.equity_curve(monitoring.session_pnl(made_trades(spark, sf)), CAPITAL).select("contract", day(), *r6("equity"))


@query("q_max_drawdown", f"WITH {CURVE}, pk AS (SELECT *, max(equity) OVER (PARTITION BY contract ORDER BY session) AS peak FROM eq) SELECT contract, round(least(10000.0::DOUBLE, greatest(0.0::DOUBLE, max(CASE WHEN peak <= 0 OR equity <= 0 THEN 10000.0 ELSE (peak - equity) / peak * 10000 END))), 4) + 0.0 AS drawdown_bps FROM pk GROUP BY 1")
def _(spark, sf):
    curve = monitoring.equity_curve(monitoring.session_pnl(made_trades(spark, sf)), CAPITAL)
    return monitoring.drawdown_bps(curve).select("contract", (F.col("drawdown_bps") + 0.0).alias("drawdown_bps"))


@query("q_drawdown_of_capital", f"WITH {TRADES}, c AS (SELECT contract, entry_ts, sum(net_pnl) OVER (PARTITION BY contract ORDER BY entry_ts) AS t FROM tr), p AS (SELECT contract, t, greatest(0.0::DOUBLE, max(t) OVER (PARTITION BY contract ORDER BY entry_ts)) AS k FROM c) SELECT contract, round(max(k - t) / 100000 * 10000, 6) + 0.0 AS drawdown_bps FROM p GROUP BY 1")
def _(spark, sf):
    return monitoring.drawdown_of_capital(made_trades(spark, sf), CAPITAL).select("contract", *r6("drawdown_bps"))


@query("q_trailing_inactive", "WITH s AS (SELECT event_type AS contract, ts::DATE AS session, count(*) FILTER (value > 150) AS trades FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY session) AS i FROM s) SELECT contract, count(*) - coalesce(max(i) FILTER (trades > 0), 0) AS inactive FROM n GROUP BY 1")
def _(spark, sf):
    s = load(spark, sf, "events").groupBy(F.col("event_type").alias("contract"), F.to_date("ts").alias("session")).agg(F.count_if(F.col("value") > 150).alias("trades"))
    return monitoring.inactive_sessions(s)


@query("q_win_rate", f"WITH {TRADES} SELECT contract, count(*) AS trades, CASE WHEN count(*) >= 5 THEN round(avg(CASE WHEN net_pnl > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) + 0.0 END AS win_rate, CASE WHEN count(*) >= 5 THEN round(avg(net_pnl), 6) + 0.0 END AS expectancy FROM tr GROUP BY 1")
def _(spark, sf):
    return monitoring.trade_quality(made_trades(spark, sf)).select("contract", "trades", *r6("win_rate", "expectancy"))


FILLS = "f AS (SELECT l_suppkey AS strategy, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice * l_tax / 100 AS cost, l_extendedprice * l_discount / 100 AS slippage FROM lineitem)"


def fills(spark, sf) -> DataFrame:
    c = F.col
    return load(spark, sf, "lineitem").select(c("l_suppkey").alias("strategy"), (c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_quantity").alias("quantity"), (c("l_extendedprice") * c("l_tax") / 100).alias("cost"), (c("l_extendedprice") * c("l_discount") / 100).alias("slippage"))


@query("q_cost_to_turnover", f"WITH {FILLS} SELECT strategy, round((greatest(0, sum(cost)) + greatest(0, sum(slippage))) / sum(price * quantity) * 10000, 4) + 0.0 AS cost_bps, round(greatest(0, sum(slippage)) / sum(price * quantity) * 10000, 4) + 0.0 AS slippage_bps FROM f GROUP BY 1")
def _(spark, sf):
    return monitoring.fill_costs(fills(spark, sf), "strategy").select("strategy", rounded(F.col("cost_bps"), 4).alias("cost_bps"), rounded(F.col("slippage_bps"), 4).alias("slippage_bps"))


@query("q_peak_exposure", f"WITH {FILLS} SELECT strategy, round(max(abs(quantity) * price * 50), 4) + 0.0 AS peak_exposure FROM f GROUP BY 1")
def _(spark, sf):
    return monitoring.peak_exposure(fills(spark, sf), "strategy", 50).select("strategy", rounded(F.col("peak_exposure"), 4).alias("peak_exposure"))


@query("q_rejection_rate", "SELECT o_orderpriority AS strategy, count(*) AS submitted, count(*) FILTER (o_orderstatus = 'P') AS rejected, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 6) + 0.0 AS rejection_rate FROM orders GROUP BY 1")
def _(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("status"))
    return monitoring.rejection_rate(o, "strategy", "P").select("strategy", "submitted", "rejected", *r6("rejection_rate"))


@query("q_latest_positions", "SELECT o_custkey AS strategy, arg_max(o_totalprice, (o_orderdate, -o_orderkey)) AS realized FROM orders GROUP BY 1")
def _(spark, sf):
    c = F.col
    p = load(spark, sf, "orders").select(c("o_custkey").alias("strategy"), c("o_orderdate").alias("at"), c("o_orderkey").alias("recorded"), c("o_totalprice").alias("realized"))
    return monitoring.latest_pnl(p, ["strategy"], "at", "realized").select("strategy", "realized")


@query("q_ratios", f"WITH {SESSIONS} SELECT contract, round(sum(trades) / count(*) / 2.0, 6) + 0.0 AS frequency_ratio FROM ses GROUP BY 1 HAVING count(*) >= 10")
def _(spark, sf):
    s = monitoring.session_pnl(made_trades(spark, sf)).groupBy("contract").agg(F.sum("trades").alias("t"), F.count("*").alias("n"))
    ratio = monitoring.frequency_ratio(F.col("t").cast("double"), F.col("n"), F.lit(400.0), F.lit(200))
    return s.filter("n >= 10").select("contract", rounded(ratio).alias("frequency_ratio"))


@query("q_window_slice", "SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1")
def _(spark, sf):
    e = load(spark, sf, "events").select("event_type", "ts")
    return monitoring.closed_window(e, "ts", "2024-01-05 00:00:00", "2024-01-12 00:00:00").groupBy("event_type").agg(F.count("*").alias("n"))


SNAP = """sn AS (SELECT o_custkey AS key, max(o_totalprice) / 100 AS drawdown_bps, 2500.0::DOUBLE AS base_drawdown_bps, CASE WHEN count(*) >= 5 THEN (avg(o_totalprice) - 150000) / 100000 END AS sharpe,
 avg(o_totalprice) / 100000 AS slippage_bps, 0.9::DOUBLE AS base_slippage_bps, count(*) FILTER (o_orderstatus = 'P') / count(*) AS rejection_rate, count(*) AS submitted, count(*) FILTER (o_totalprice < 100000) AS inactive FROM orders GROUP BY 1)"""


@query("q_degradation_rules", f"""WITH {SNAP}, r AS (
SELECT key, 'RULE_DD_EXPANSION_CRITICAL' AS rule, drawdown_bps AS observed, base_drawdown_bps * 1.5 AS threshold FROM sn WHERE drawdown_bps > base_drawdown_bps * 1.5
UNION ALL SELECT key, 'RULE_RISK_REJECTION_SPIKE', rejection_rate, 0.02 FROM sn WHERE submitted >= 10 AND rejection_rate > 0.02
UNION ALL SELECT key, 'RULE_SHARPE_COLLAPSE', sharpe, 0.0 FROM sn WHERE sharpe < 0
UNION ALL SELECT key, 'RULE_SLIPPAGE_ANOMALY', slippage_bps, base_slippage_bps * 2 FROM sn WHERE slippage_bps > base_slippage_bps * 2
UNION ALL SELECT key, 'RULE_TRADE_DROPOUT', inactive, 30 FROM sn WHERE inactive >= 30) SELECT key, rule, round(observed, 11) + 0.0 AS observed, round(threshold, 11) + 0.0 AS threshold FROM r""")
def _(spark, sf):
    return monitoring.degradations(snapshots(spark, sf), most_rejected=0.02).select("key", "rule", *(rounded(F.col(c), 11).alias(c) for c in ("observed", "threshold")))


def snapshots(spark, sf) -> DataFrame:
    p, n = F.col("o_totalprice"), F.count("*")
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(
        (F.max(p) / 100).alias("drawdown_bps"), F.lit(2500.0).alias("base_drawdown_bps"), F.when(n >= 5, (F.avg(p) - 150000) / 100000).alias("sharpe"), (F.avg(p) / 100000).alias("slippage_bps"),
        F.lit(0.9).alias("base_slippage_bps"), (F.count_if(F.col("o_orderstatus") == "P") / n).alias("rejection_rate"), n.alias("submitted"), F.count_if(p < 100000).alias("inactive"),
    )


@query("q_split_bounds", """WITH t AS (SELECT o_orderdate AS t, row_number() OVER (ORDER BY o_orderdate) - 1 AS i FROM (SELECT DISTINCT o_orderdate FROM orders)), n AS (SELECT count(*) AS n FROM t),
s AS (SELECT n, greatest(1, floor((n - 18) * (0.5::DOUBLE / 0.9)))::BIGINT AS r, greatest(1, floor((n - 18) * (0.2::DOUBLE / 0.9)))::BIGINT AS v FROM n),
z AS (SELECT 'research' AS zone, 0 AS a, r AS b, n FROM s UNION ALL SELECT 'validation_purge', r, r + 6, n FROM s UNION ALL SELECT 'validation_embargo', r + 6, r + 9, n FROM s UNION ALL SELECT 'validation', r + 9, r + 9 + v, n FROM s
UNION ALL SELECT 'holdout_purge', r + 9 + v, r + 15 + v, n FROM s UNION ALL SELECT 'holdout_embargo', r + 15 + v, r + 18 + v, n FROM s UNION ALL SELECT 'holdout', r + 18 + v, least(n, r + 18 + v + v), n FROM s UNION ALL SELECT 'forward', least(n, r + 18 + v + v), n, n FROM s)
SELECT zone, x.t AS start, y.t AS stop FROM z JOIN t x ON x.i = least(a, n - 1) JOIN t y ON y.i = least(b, n - 1)""")
def _(spark, sf):
    return zones.split_manifest(load(spark, sf, "orders").select("o_orderdate"), zones.Gaps(2, 2, 2, 0, 3), column="o_orderdate")


@query("q_zone_slice", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-07-01' GROUP BY 1")
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_orderdate", "o_orderstatus")
    zone = spark.createDataFrame([("Research", datetime(1996, 1, 1), datetime(1997, 7, 1))], "zone string, start timestamp_ntz, stop timestamp_ntz")
    return zones.load_zone(o, zone.filter("zone = 'none'"), "research", named=zone, kind="LICENSED", allowed_kinds={"LICENSED"}, column="o_orderdate").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def trials(spark, sf) -> DataFrame:
    c = F.col
    return load(spark, sf, "orders").select(
        c("o_orderkey").alias("trial_id"), c("o_custkey").cast("string").alias("strategy_id"), c("o_orderdate").alias("experiment_id"), c("o_orderpriority").alias("dataset"), c("o_orderstatus").alias("status"), c("o_orderdate").alias("started"),
        F.when(c("o_orderstatus") == "F", c("o_totalprice") / 1000).alias("actual_minutes"), (c("o_totalprice") / 2000).alias("estimated_minutes"), F.lit(None).cast("double").alias("actual_cost"), F.lit(0.5).alias("estimated_cost"),
    )


@query("q_budget_usage", "SELECT o_orderpriority AS dataset, count(*) AS trials, count(DISTINCT o_orderdate) AS experiments, count(DISTINCT o_custkey) AS strategies, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 ELSE o_totalprice / 2000 END), 3) + 0.0 AS minutes, round(count(*) * 0.5, 3) + 0.0 AS cost FROM orders GROUP BY 1")
def _(spark, sf):
    return ledger.usage(trials(spark, sf), ["dataset"]).select("dataset", "trials", "experiments", "strategies", rounded(F.col("minutes"), 3).alias("minutes"), rounded(F.col("cost"), 3).alias("cost"))


@query("q_trials_filter", "SELECT o_orderkey AS trial_id, o_orderdate AS started FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(spark, sf):
    return ledger.matching(trials(spark, sf), status="F", dataset="1-URGENT", strategy_id=None).select("trial_id", "started")


@query("q_latest_per_key", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, sf):
    return ledger.latest(load(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("q_topn_per_group", "SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 10")
def _(spark, sf):
    return ledger.latest(load(spark, sf, "events").select("event_type", "event_id", "ts"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 10)


@query("q_topk_recent", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, sf):
    return readmodels.recent(load(spark, sf, "events").select("event_id", "ts", "event_type"), [F.desc("ts"), F.desc("event_id")], 50)


@query("q_state_counts_zero_filled", "SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def _(spark, sf):
    return readmodels.zero_filled(spark, load(spark, sf, "orders"), "o_orderstatus", STATES)


@query("q_dashboard_totals", "WITH t AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) SELECT round(sum(o_totalprice), 2) + 0.0 AS net_pnl, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) + 0.0 AS mean_sharpe, (SELECT count(*) FROM orders) AS reports FROM t")
def _(spark, sf):
    o = load(spark, sf, "orders")
    top = readmodels.recent(o.select("o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 50)
    sums = top.agg(rounded(F.sum("o_totalprice"), 2).alias("net_pnl"), rounded(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("mean_sharpe")).withColumn("k", F.lit(1))
    return sums.join(o.agg(F.count("*").alias("reports")).withColumn("k", F.lit(1)), "k").drop("k")


@query("q_dataset_zone_count", "SELECT r_name, count(n_nationkey) AS zones_count, coalesce(array_to_string(list_sort(list(n_name)), ','), '') AS zones FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf):
    r, n = load(spark, sf, "region"), load(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    out = readmodels.with_children(r, n, "r_regionkey", ["n_name"], "zones")
    return out.select("r_name", "zones_count", F.coalesce(F.array_join("zones.n_name", ","), F.lit("")).alias("zones"))


@query("q_dossier_join", "WITH o AS (SELECT o_custkey, count(*) AS trials, max(o_orderdate) AS last_trial FROM orders GROUP BY 1) SELECT c_custkey AS strategy, n_name AS dataset, c_mktsegment AS state, coalesce(trials, 0) AS trials, last_trial FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey")
def _(spark, sf):
    c, n = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), load(spark, sf, "nation").select("n_nationkey", "n_name")
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("trials"), F.max("o_orderdate").alias("last_trial"))
    d = c.join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return d.select(F.col("c_custkey").alias("strategy"), F.col("n_name").alias("dataset"), F.col("c_mktsegment").alias("state"), F.coalesce("trials", F.lit(0)).alias("trials"), "last_trial")


def links(spark, sf) -> DataFrame:
    o, c = load(spark, sf, "orders"), F.concat
    trial = o.select(c(F.lit("T"), "o_orderkey").alias("source"), c(F.lit("S"), "o_custkey").alias("target"), F.lit("trial_of").alias("kind"))
    part = load(spark, sf, "lineitem").select(c(F.lit("F"), "l_orderkey", F.lit("-"), "l_linenumber").alias("source"), c(F.lit("T"), F.col("l_orderkey") * F.when(F.col("l_linenumber") == 7, -1).otherwise(1)).alias("target"), F.lit("fill_of").alias("kind"))
    return trial.unionByName(part)


def graph_nodes(spark, sf) -> DataFrame:
    s = load(spark, sf, "customer").select(F.concat(F.lit("S"), "c_custkey").alias("i"))
    t = load(spark, sf, "orders").select(F.concat(F.lit("T"), "o_orderkey").alias("i"))
    return readmodels.nodes([(s, "i", "strategy"), (t, "i", "trial")])


GRAPH = """ln AS (SELECT 'T' || o_orderkey AS source, 'S' || o_custkey AS target, 'trial_of' AS kind FROM orders
UNION ALL SELECT 'F' || l_orderkey || '-' || l_linenumber, 'T' || (l_orderkey * CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END), 'fill_of' FROM lineitem),
nd AS (SELECT 'S' || c_custkey AS node, 'strategy' AS kind FROM customer UNION ALL SELECT 'T' || o_orderkey, 'trial' FROM orders)"""


@query("q_provenance_nodes", f"WITH {GRAPH} SELECT * FROM nd")
def _(spark, sf):
    return graph_nodes(spark, sf)


@query("q_provenance_edges", f"WITH {GRAPH} SELECT source, target, kind FROM ln WHERE target IN (SELECT node FROM nd)")
def _(spark, sf):
    return readmodels.edges(links(spark, sf), graph_nodes(spark, sf))


@query("q_broken_provenance", f"WITH {GRAPH} SELECT source, target, kind FROM ln WHERE target NOT IN (SELECT node FROM nd)")
def _(spark, sf):
    return readmodels.broken(links(spark, sf), graph_nodes(spark, sf))


@query("q_identifier_resolution", "WITH u AS (SELECT c_custkey::VARCHAR AS identifier, c_custkey::VARCHAR AS strategy_id, 0 AS p FROM customer UNION ALL SELECT o_orderkey::VARCHAR, o_custkey::VARCHAR, 1 FROM orders) SELECT identifier, strategy_id FROM u QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY p, strategy_id) = 1")
def _(spark, sf):
    return readmodels.resolve([(load(spark, sf, "customer"), "c_custkey", "c_custkey"), (load(spark, sf, "orders"), "o_orderkey", "o_custkey")])


CAND = """cd AS (SELECT c_custkey AS strategy, coalesce(n, 0) AS trades, coalesce(n, 0) AS observations, coalesce(p, 0) - 1500000 AS net_pnl, CASE WHEN c_custkey % 7 = 0 THEN 'FAILED' WHEN c_custkey % 3 = 0 THEN 'PASSED' ELSE 'NOT_TESTED' END AS robustness,
 CASE c_custkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PASSED' WHEN 2 THEN 'BURNED' ELSE 'UNTOUCHED' END AS holdout FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query("q_qualification_status", f"""WITH {CAND} SELECT strategy, CASE WHEN holdout = 'FAILED' THEN 'REJECTED_FINAL_HOLDOUT' WHEN net_pnl <= 0 OR robustness = 'FAILED' OR holdout = 'BURNED' THEN 'REJECTED' WHEN trades < 12 OR observations < 12 THEN 'UNDERPOWERED'
 WHEN holdout = 'PASSED' THEN 'PAPER_ELIGIBLE' WHEN holdout = 'UNTOUCHED' THEN 'HOLDOUT_REQUIRED' ELSE 'VALIDATION' END AS status FROM cd""")
def _(spark, sf):
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("p"))
    c = load(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("c_custkey")
    rob = F.when(k % 7 == 0, "FAILED").when(k % 3 == 0, "PASSED").otherwise("NOT_TESTED")
    hold = F.when(k % 5 == 0, "FAILED").when(k % 5 == 1, "PASSED").when(k % 5 == 2, "BURNED").otherwise("UNTOUCHED")
    rows = c.select(k.alias("strategy"), F.coalesce("n", F.lit(0)).alias("trades"), F.coalesce("n", F.lit(0)).alias("observations"), (F.coalesce("p", F.lit(0.0)) - 1500000).alias("net_pnl"), rob.alias("robustness"), hold.alias("holdout"))
    return ledger.qualification(rows, 12, 12).select("strategy", "status")


@query("q_holdout_state", """SELECT c_custkey AS strategy_id, CASE WHEN n_regionkey = 1 THEN 'BURNED' WHEN c_custkey % 2 = 0 THEN 'PASSED' ELSE 'UNTOUCHED' END AS holdout FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(spark, sf):
    n = load(spark, sf, "nation")
    rows = load(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("strategy_id"), F.col("n_name").alias("dataset"), F.lit("v2").alias("protocol"))
    burns = n.filter("n_regionkey = 1").select(F.col("n_name").alias("dataset"), F.lit("v2").alias("protocol"))
    done = rows.filter("strategy_id % 2 = 0").withColumn("state", F.lit("PASSED"))
    return ledger.holdout_state(rows, burns, done).select("strategy_id", "holdout")


@query("q_illegal_transitions", """WITH t AS (SELECT o_custkey AS strategy_id, o_orderkey AS seq, o_orderstatus AS b, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders)
SELECT strategy_id, seq, 'no such step' AS reason FROM t WHERE a IS NOT NULL AND NOT ((a = 'O' AND b = 'F') OR (a = 'O' AND b = 'P') OR (a = 'F' AND b = 'P'))""")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    status = F.col("o_orderstatus")
    o = load(spark, sf, "orders").withColumn("to_state", F.when(status == "O", "CANDIDATE").when(status == "F", "VALIDATION").otherwise("HOLDOUT_REQUIRED"))
    t = o.select(F.col("o_custkey").alias("strategy_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("at"), "to_state", F.lag("to_state").over(w).alias("from_state"))
    return ledger.illegal_steps(t.filter("from_state is not null"), ledger.step_table(spark)).select("strategy_id", "seq", "reason")


@query("q_gap_returns", f"WITH {BARS}, g AS (SELECT contract, ts, ln(open / coalesce(lag(close) OVER (PARTITION BY contract ORDER BY ts), close)) AS gap, ln(close / open) AS intrabar FROM bars) SELECT contract, ts, {s6('gap', 'intrabar')} FROM g")
def _(spark, sf):
    return synthetic.components(bars(spark, sf)).select("contract", "ts", *r6("gap", "intrabar"))


@query("q_level_shift", f"WITH {SLOTS}, p AS (SELECT *, coalesce(lag(signal) OVER w, 0) * 0.0025::DOUBLE AS push FROM sig WINDOW w AS (PARTITION BY contract ORDER BY ts)), x AS (SELECT contract, ts, open * exp(sum(push) OVER (PARTITION BY contract ORDER BY ts)) AS open, close * exp(sum(push) OVER (PARTITION BY contract ORDER BY ts)) AS close FROM p) SELECT contract, ts, {s6('open', 'close')} FROM x")
def _(spark, sf):
    return synthetic.gap_canary(signals.momentum(bars(spark, sf))).select("contract", "ts", *r6("open", "close"))


@query("q_edge_injection", f"""WITH {SLOTS}, p AS (SELECT *, ln(open / coalesce(lag(close) OVER w, close)) AS gap, ln(close / open) + coalesce(lag(signal) OVER (PARTITION BY contract, session ORDER BY ts), 0) * 0.0012::DOUBLE AS intrabar, first(close) OVER w AS c0 FROM sig WINDOW w AS (PARTITION BY contract ORDER BY ts)),
x AS (SELECT contract, ts, c0 * exp(sum(gap + intrabar) OVER (PARTITION BY contract ORDER BY ts)) AS close FROM p) SELECT contract, ts, round(close, 4) + 0.0 AS close FROM x""")
def _(spark, sf):
    return synthetic.planted_edge(signals.momentum(bars(spark, sf)), 10.0).select("contract", "ts", rounded(F.col("close"), 4).alias("close"))


@query("q_tick_rounding", "SELECT l_orderkey, l_linenumber, round(round_even(l_extendedprice / 0.05, 0) * 0.05, 4) + 0.0 AS price FROM lineitem")
def _(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (to_tick(F.col("l_extendedprice"), 0.05) + 0.0).alias("price"))


@query("q_json_projection", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def _(spark, sf):
    return readmodels.json_fields(load(spark, sf, "events").select("event_id", "props"), "props", {"k": "int"}).select("event_id", "k")


REPLAY = SLOTS + """, b AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY ts) AS i, lead(session) OVER (PARTITION BY contract ORDER BY ts) AS ns, lead(open, 1) OVER (PARTITION BY contract ORDER BY ts) AS o1, lead(ts, 1) OVER (PARTITION BY contract ORDER BY ts) AS t1, lead(open, 2) OVER (PARTITION BY contract ORDER BY ts) AS o2, lead(ts, 2) OVER (PARTITION BY contract ORDER BY ts) AS t2 FROM sig),
e AS (SELECT * FROM b WHERE signal <> 0 AND ns = session),
ch(contract, i) AS (SELECT contract, min(i) FROM e GROUP BY 1 UNION ALL SELECT ch.contract, (SELECT min(e.i) FROM e WHERE e.contract = ch.contract AND e.i >= ch.i + 2) FROM ch WHERE ch.i IS NOT NULL)"""


@query("q_replay_trades", f"WITH RECURSIVE {REPLAY} SELECT e.contract, t1 AS entry_ts, t2 AS ts, signal AS side, round(signal * (o2 - o1), 6) + 0.0 AS gross_pnl FROM ch JOIN e ON e.contract = ch.contract AND e.i = ch.i WHERE o2 IS NOT NULL")
def _(spark, sf):
    return replay.replay(signals.momentum(bars(spark, sf))).filter("kind = 'trade'").select("contract", "entry_ts", "ts", "side", *r6("gross_pnl"))


@query("q_replay_risk")
def _(spark, sf):
    cfg = replay.Settings(quantity=2, lot_size=5, tick=0.05, slippage_bps=1.0, round_trip_bps=2.0, risk=replay.Risk(max_session_orders=6, max_daily_loss=500.0))
    return replay.report(replay.replay(signals.momentum(bars(spark, sf)), cfg), cfg)


@query("q_tumbling_windows", "SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = streaming.tumbling(e, "15 minutes")
    return w.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", rounded(F.col("total"), 4).alias("total"))


@query("q_session_windows", """WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM d) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def _(spark, sf):
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sessions(e, "user_id", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("q_synthetic_bars")
def _(spark, sf):
    return synthetic.generate(spark, [1, 2, 3])


@query("q_synthetic_null")
def _(spark, sf):
    return synthetic.block_bootstrap(synthetic.directional_null(synthetic.generate(spark, [1, 2])))


@query("q_monte_carlo_gate")
def _(spark, sf):
    return research.null_runs(spark, list(range(12)))


from barlab import paper_queries, scale_queries  # noqa: E402, F401  they register their queries here
