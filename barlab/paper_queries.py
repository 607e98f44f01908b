"""Registered queries of paper evaluation, governance, trial ledgers and registries over the
driver's tables, and the SQL that each must equal. A customer is a strategy; its orders are
orders, fills, positions and risk events; months of orders are sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from barlab.functions.scalars import rounded
from barlab.operators import backtest, evaluation, governance, ledger, monitoring, readmodels, statistics, zones
from barlab.operators.staging import staged, staged_path
from barlab.plans import research
from barlab.queries import BARS, CURVE, TRADES, bars, load, made_trades, query, s6
from barlab.sources import bars as sources

START, STOP = "1995-01-01 00:00:00", "1997-12-31 00:00:00"
ntz = lambda text: F.lit(text).cast("timestamp_ntz")
k = lambda: F.col("c_custkey")


def strategies(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_custkey").cast("string").alias("strategy_id"), F.concat(F.lit("Q"), "c_custkey").alias("qualification_hash"))


def paper_orders(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("strategy_id"), "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")


def evaluated(spark, sf) -> evaluation.Evaluation:
    c, o, key, price = strategies(spark, sf), paper_orders(spark, sf), F.col("o_orderkey"), F.col("o_totalprice")
    windows = c.select(F.concat(F.lit("W"), k()).alias("window_id"), "strategy_id", "qualification_hash", ntz(START).alias("window_start"), ntz(STOP).alias("window_end"), F.when(k() % 4 != 0, F.concat(F.lit("O"), k())).alias("observed_report"))
    qualifications = c.select(F.col("qualification_hash").alias("record_hash"), "strategy_id", F.when(k() % 11 == 0, "REJECTED").otherwise("PAPER_ELIGIBLE").alias("final_status"))
    terms = lambda version, cost: [F.lit(version).alias("dataset_version"), F.concat(F.lit("s"), "c_nationkey").alias("dataset_sha256"), F.lit("next_open").alias("execution_policy"), cost.alias("cost_schedule_hash"), F.lit("r").alias("risk_config_hash")]
    baselines = c.filter(k() % 13 != 0).select("strategy_id", "qualification_hash", F.concat(F.lit("B"), k()).alias("report_hash"), *terms("v1", F.lit("c")))
    month = F.date_format("o_orderdate", "yyyy-MM")
    late = F.col("strategy_id").cast("bigint") % 23 == 0
    s = o.filter((F.col("o_orderdate") <= ntz(STOP)) | late).groupBy("strategy_id", month.alias("session_id")).agg(
        F.min("o_orderdate").alias("start_ts"), F.max("o_orderdate").alias("end_ts"), F.count_if(price > 100_000).alias("trades"), F.sum((price - 150_000) / 1000).alias("net_pnl"))
    s = s.groupBy("strategy_id").agg(F.collect_list(F.struct("session_id", "start_ts", "end_ts", "trades", "net_pnl")).alias("sessions"))
    kind = s.schema["sessions"].dataType
    numbers = lambda fall: [F.lit(1).alias("lot_size"), F.lit(100_000.0).alias("initial_capital"), fall.alias("max_drawdown_bps"), F.lit(1.5).alias("slippage_bps")]
    base = c.select(F.concat(F.lit("B"), k()).alias("report_hash"), "strategy_id", "qualification_hash", F.lit("FORWARD_PAPER").alias("split_zone"), *numbers(F.when(k() % 17 == 0, 0.0).otherwise(300.0)), F.array().cast(kind).alias("sessions"), *terms("v1", F.when(k() % 19 == 0, "other").otherwise("c")))
    seen = c.join(s, "strategy_id").select(F.concat(F.lit("O"), k()).alias("report_hash"), "strategy_id", "qualification_hash", F.when(k() % 29 == 0, "VALIDATION").otherwise("FORWARD_PAPER").alias("split_zone"), *numbers(F.lit(0.0)), "sessions", *terms("v2", F.lit("c")))
    fills = o.select(key.alias("fill_id"), "strategy_id", F.col("o_orderdate").alias("fill_ts"), (price / 100).alias("price"), F.when(key % 1009 == 0, 0).otherwise(1 + key % 3).alias("quantity"), (price / 10_000).alias("cost"), (price / 20_000).alias("slippage"))
    fills = fills.unionByName(fills.filter(F.col("fill_id") % 997 == 0))
    return evaluation.evaluate(
        windows, qualifications=qualifications, baselines=baselines, reports=base.unionByName(seen), fills=fills,
        orders=o.select(key.alias("order_id"), "strategy_id", F.col("o_orderdate").alias("submit_ts"), F.when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("FILLED").alias("status")),
        positions=o.select("strategy_id", F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), key.alias("seq"), (1 + key % 4).alias("quantity"), (price / 100).alias("price"), ((price - 150_000) / 100).alias("realized_pnl")),
        risk_events=o.filter("o_orderstatus = 'P'").select(key.alias("event_id"), "strategy_id", F.col("o_orderdate").alias("ts"), F.when(key % 1013 == 0, "").otherwise("MAX_LOSS").alias("rule_name")),
        config=evaluation.Config(window_sessions=15, most_rejected=0.3),
    )


_W = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{STOP}'"
EVALUATED = f"""o AS (SELECT *, o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer),
se AS (SELECT k, strftime(o_orderdate, '%Y-%m') AS session_id, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) FILTER (o_totalprice > 100000) AS trades, sum((o_totalprice - 150000) / 1000) AS pnl FROM o WHERE o_orderdate <= TIMESTAMP '{STOP}' OR k % 23 = 0 GROUP BY 1, 2),
ob AS (SELECT k, bool_or(b > TIMESTAMP '{STOP}') AS later, bool_and(b < TIMESTAMP '{START}') AS older FROM se GROUP BY 1),
st AS (SELECT c.k, k % 13 <> 0 AS hasb, k % 4 <> 0 AS wants, later, older, ob.k IS NOT NULL AND c.k % 4 <> 0 AS haso FROM c LEFT JOIN ob USING (k)),
pf AS (SELECT k, unnest(list_filter([CASE WHEN k % 11 = 0 THEN 'qualification: final_status' END, CASE WHEN NOT hasb THEN 'no baseline' END, CASE WHEN wants AND NOT haso THEN 'no observed report' END,
 CASE WHEN haso AND k % 29 = 0 THEN 'split_zone' END, CASE WHEN hasb AND k % 17 = 0 THEN 'baseline drawdown' END, CASE WHEN hasb AND k % 19 = 0 THEN 'baseline report: cost_schedule_hash' END,
 CASE WHEN haso AND later THEN 'observed: later sessions' END, CASE WHEN haso AND older THEN 'observed: older sessions' END], lambda x: x IS NOT NULL)) AS fault FROM st),
f AS (SELECT o_orderkey AS id, k, o_totalprice AS p, CASE WHEN o_orderkey % 1009 = 0 THEN 0 ELSE 1 + o_orderkey % 3 END AS q FROM o WHERE o_orderdate {_W}),
sf AS (SELECT k, 'repeated fill_id' AS fault FROM f WHERE id % 997 = 0 UNION SELECT k, 'fill quantity' FROM f WHERE q <= 0 UNION SELECT k, 'risk event without rule' FROM o WHERE o_orderstatus = 'P' AND o_orderkey % 1013 = 0 AND o_orderdate {_W}),
fit AS (SELECT * FROM st WHERE k NOT IN (SELECT k FROM pf) AND k NOT IN (SELECT k FROM sf)),
m1 AS (SELECT k, count(*) AS total_trades, round(sum(p / 20000) / sum(p / 100 * q) * 10000, 4) AS slippage_bps, round((sum(p / 10000) + sum(p / 20000)) / sum(p / 100 * q) * 10000, 4) AS cost_bps FROM f GROUP BY 1),
m2 AS (SELECT k, count(*) AS submitted, count(*) FILTER (o_orderstatus = 'P') AS rejected FROM o WHERE o_orderdate {_W} GROUP BY 1),
ps AS (SELECT k, o_orderdate AS ts, o_orderkey AS seq, o_orderpriority AS symbol, (o_totalprice - 150000) / 100 AS pnl, (1 + o_orderkey % 4) * o_totalprice / 100 AS expo FROM o WHERE o_orderdate {_W}),
m3 AS (SELECT k, round(sum(pnl), 4) AS net_pnl FROM (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY k, symbol ORDER BY ts DESC, seq) = 1) GROUP BY 1),
cv AS (SELECT k, ts, 100000 + sum(pnl) AS e FROM ps GROUP BY 1, 2), cp AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY ts) AS peak FROM cv),
m4 AS (SELECT k, round(least(10000, greatest(0, max(CASE WHEN peak <= 0 OR e <= 0 THEN 10000 ELSE (peak - e) / peak * 10000 END))), 4) AS drawdown_bps FROM cp GROUP BY 1),
m5 AS (SELECT k, round(max(expo), 4) AS peak_exposure FROM ps GROUP BY 1),
cs AS (SELECT se.*, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS n, 100000 + coalesce(sum(pnl) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM se JOIN st USING (k) WHERE haso AND a >= TIMESTAMP '{START}' AND b <= TIMESTAMP '{STOP}' WINDOW w AS (PARTITION BY k ORDER BY a, session_id)),
m6 AS (SELECT k, count(*) AS completed_sessions, count(*) - coalesce(max(i) FILTER (trades > 0), 0) AS inactive, min(e) AS le, avg(round(pnl / e, 8)) FILTER (i > n - 15) AS me, stddev_samp(round(pnl / e, 8)) FILTER (i > n - 15) AS sd, count(*) FILTER (i > n - 15) AS used FROM cs GROUP BY 1),
sn AS (SELECT fit.k::VARCHAR AS strategy_id, coalesce(total_trades, 0) AS total_trades, coalesce(net_pnl, 0) + 0.0 AS net_pnl, coalesce(drawdown_bps, 0) + 0.0 AS drawdown_bps, CASE WHEN used >= 10 AND sd * sd > 1e-14 AND le > 0 THEN round(me / sd * sqrt(252.0), 4) + 0.0 END AS sharpe,
 coalesce(slippage_bps, 0) + 0.0 AS slippage_bps, coalesce(cost_bps, 0) + 0.0 AS cost_bps, coalesce(rejected, 0) AS risk_events, coalesce(completed_sessions, 0) AS completed_sessions, coalesce(inactive, 0) AS inactive, coalesce(peak_exposure, 0) + 0.0 AS peak_exposure, coalesce(submitted, 0) AS submitted, coalesce(rejected, 0) AS rejected
 FROM fit LEFT JOIN m1 USING (k) LEFT JOIN m2 USING (k) LEFT JOIN m3 USING (k) LEFT JOIN m4 USING (k) LEFT JOIN m5 USING (k) LEFT JOIN m6 USING (k))"""
FLOATS = ["net_pnl", "drawdown_bps", "sharpe", "slippage_bps", "cost_bps", "peak_exposure"]
COUNTS = ["total_trades", "risk_events", "completed_sessions", "inactive", "submitted", "rejected"]


@query("q_window_snapshots", f"WITH {EVALUATED} SELECT strategy_id, {', '.join(COUNTS)}, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in FLOATS)} FROM sn")
def _(spark, sf):
    return evaluated(spark, sf).snapshots.select("strategy_id", *COUNTS, *(rounded(F.col(c), 4).alias(c) for c in FLOATS))


@query("q_window_faults", f"WITH {EVALUATED} SELECT 'W' || k AS window_id, fault FROM pf UNION ALL SELECT 'W' || k, fault FROM sf WHERE k NOT IN (SELECT k FROM pf)")
def _(spark, sf):
    return evaluated(spark, sf).faults


@query("q_window_events", f"""WITH {EVALUATED}, ev AS (
SELECT strategy_id, 'RULE_DD_EXPANSION_CRITICAL' AS rule, drawdown_bps AS observed, 450.0 AS threshold FROM sn WHERE drawdown_bps > 450
UNION ALL SELECT strategy_id, 'RULE_RISK_REJECTION_SPIKE', rejected / submitted, 0.3 FROM sn WHERE submitted >= 10 AND rejected / submitted > 0.3
UNION ALL SELECT strategy_id, 'RULE_SHARPE_COLLAPSE', sharpe, 0.0 FROM sn WHERE sharpe < 0
UNION ALL SELECT strategy_id, 'RULE_SLIPPAGE_ANOMALY', slippage_bps, 3.0 FROM sn WHERE slippage_bps > 3
UNION ALL SELECT strategy_id, 'RULE_TRADE_DROPOUT', inactive, 30 FROM sn WHERE inactive >= 30) SELECT strategy_id, rule, round(observed, 4) + 0.0 AS observed, round(threshold, 4)::DOUBLE + 0.0 AS threshold FROM ev""")
def _(spark, sf):
    return evaluated(spark, sf).events.select("strategy_id", "rule", rounded(F.col("observed"), 4).alias("observed"), rounded(F.col("threshold"), 4).alias("threshold"))


@query("q_window_again", "SELECT 0::BIGINT AS snapshots, 0::BIGINT AS events")
def _(spark, sf):
    """The windows are evaluated, what comes of them is stored, and all are evaluated again
    from the tables: this adds nothing to what is stored."""
    first = evaluated(spark, sf)
    stored = [staged(df.select(key, F.col(key).alias("digest")), "stored")[0] for df, key in ((first.snapshots, "snapshot_hash"), (first.events, "event_hash"))]
    snaps, events = evaluated(spark, sf).new(*stored)
    return snaps.agg(F.count("*").alias("snapshots")).withColumn("_k", F.lit(1)).join(events.agg(F.count("*").alias("events")).withColumn("_k", F.lit(1)), "_k").drop("_k")


# ---- feedback


def degradation_events(spark, sf):
    """An event and a snapshot for each error event of the events table."""
    e = load(spark, sf, "events").filter("event_type = 'error'").withColumn("m", F.col("event_id") % 4)
    m = F.col("m")
    rule = F.when(m == 0, "RULE_DD_EXPANSION_CRITICAL").when(m == 1, "RULE_SHARPE_COLLAPSE").when(m == 2, "RULE_DD_EXPANSION_CRITICAL").otherwise("RULE_OF_NO_MODE")
    details = F.when(m == 0, '{"baseline_max_dd_bps": 50.0}').when(m == 2, '{"max_drawdown_expansion_limit": 1.5}').otherwise("{}")
    of = lambda prefix: F.sha2(F.concat(F.lit(prefix), F.col("event_id").cast("string")), 256)
    events = e.select("event_id", of("e").alias("event_hash"), of("s").alias("snapshot_hash"), F.col("user_id").cast("string").alias("strategy_id"), rule.alias("rule"), (F.col("event_id") % 300).cast("double").alias("observed"), F.lit(90.0).alias("threshold"), details.alias("details"))
    snapshots = e.select(of("s").alias("snapshot_hash"), (F.col("event_id") % 200).cast("double").alias("drawdown_bps"), F.lit(-1.0).alias("sharpe"), F.lit(2.0).alias("slippage_bps"))
    return events, snapshots


FED = """fd AS (SELECT event_id, user_id::VARCHAR AS strategy_id, sha256('e' || event_id) AS event_hash, CASE event_id % 4 WHEN 0 THEN 'DRAWDOWN_EXPANSION' WHEN 1 THEN 'SHARPE_COLLAPSE' WHEN 2 THEN 'DRAWDOWN_EXPANSION' ELSE 'RULE_OF_NO_MODE' END AS failure_mode,
 CASE event_id % 4 WHEN 0 THEN (event_id % 200) / 50.0::DOUBLE WHEN 2 THEN (event_id % 300) / 60.0::DOUBLE ELSE 1.0::DOUBLE END AS ratio FROM events WHERE event_type = 'error')"""


@query("q_feedback", f"WITH {FED} SELECT event_hash, strategy_id, failure_mode, round(ratio, 6) + 0.0 AS drawdown_ratio FROM fd")
def _(spark, sf):
    return ledger.feedback(*degradation_events(spark, sf)).select("event_hash", "strategy_id", "failure_mode", rounded(F.col("drawdown_ratio")).alias("drawdown_ratio"))


@query("q_task_id", f"""WITH {FED}, h AS (SELECT event_hash, sha256(concat_ws(chr(31), strategy_id, event_hash, failure_mode, '-1.0', '1.0', '2.0')) AS fh FROM fd WHERE ratio = 1)
SELECT event_hash, 'TASK-RFB-' || substr(sha256(fh || ':RP-2'), 1, 16) AS task_id FROM h""")
def _(spark, sf):
    records = ledger.feedback(*degradation_events(spark, sf)).filter("drawdown_ratio = 1")
    return ledger.research_tasks(records, "RP-2").select("event_hash", "task_id")


# ---- lifecycle and governance

_LIFE = {"O": "PAPER_ELIGIBLE", "F": "PAPER_ACTIVE", "P": "DEGRADED"}


def lifecycle(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    state = F.lit(None).cast("string")
    for letter, name in _LIFE.items():
        state = F.when(F.col("o_orderstatus") == letter, name).otherwise(state)
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", state.alias("to_state"))
    t = o.select(F.col("o_custkey").alias("strategy_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("at"), "to_state", F.lag("to_state").over(w).alias("from_state"))
    return t.filter("from_state is not null")


@query("q_lifecycle_illegal", """WITH t AS (SELECT o_custkey AS strategy_id, o_orderkey AS seq, o_orderstatus AS b, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders)
SELECT strategy_id, seq, 'no such step' AS reason FROM t WHERE a IS NOT NULL AND NOT ((a = 'O' AND b = 'F') OR (a = 'O' AND b = 'P') OR (a = 'F' AND b = 'P'))""")
def _(spark, sf):
    return ledger.illegal_steps(lifecycle(spark, sf), ledger.step_table(spark, governance.LIFECYCLE_STEPS)).select("strategy_id", "seq", "reason")


_TABLES = {
    "lifecycle": "IDEA>RESEARCH IDEA>REJECTED RESEARCH>VALIDATION RESEARCH>REJECTED VALIDATION>PAPER_ELIGIBLE VALIDATION>REJECTED PAPER_ELIGIBLE>PAPER_ACTIVE PAPER_ELIGIBLE>DEGRADED PAPER_ELIGIBLE>RETIRED PAPER_ELIGIBLE>REJECTED PAPER_ACTIVE>DEGRADED PAPER_ACTIVE>RETIRED DEGRADED>RETIRED DEGRADED>RESEARCH",
    "validation": "CANDIDATE>UNDERPOWERED CANDIDATE>VALIDATION CANDIDATE>REJECTED CANDIDATE>HOLDOUT_REQUIRED UNDERPOWERED>CANDIDATE UNDERPOWERED>REJECTED VALIDATION>HOLDOUT_REQUIRED VALIDATION>UNDERPOWERED VALIDATION>REJECTED HOLDOUT_REQUIRED>HOLDOUT_PASSED HOLDOUT_REQUIRED>REJECTED_FINAL_HOLDOUT HOLDOUT_REQUIRED>REJECTED HOLDOUT_PASSED>PAPER_ELIGIBLE HOLDOUT_PASSED>REJECTED",
}


@query("q_state_steps", "SELECT machine, split_part(s, '>', 1) AS from_state, split_part(s, '>', 2) AS to_state FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS machine, unnest(string_split('{t}', ' ')) AS s" for m, t in _TABLES.items()) + ")")
def _(spark, sf):
    part = lambda name, steps: ledger.step_table(spark, steps).select(F.lit(name).alias("machine"), "from_state", "to_state")
    return part("lifecycle", governance.LIFECYCLE_STEPS).unionByName(part("validation", ledger.VALIDATION_STEPS))


def governed(spark, sf):
    """Requests of customers' strategies, and the evidence that they name."""
    c = strategies(spark, sf)
    state = F.when(k() % 3 == 0, "PAPER_ELIGIBLE").when(k() % 3 == 1, "PAPER_ACTIVE").otherwise("DEGRADED")
    registry = c.select("strategy_id", state.alias("state"), F.when(k() % 31 != 0, F.col("qualification_hash")).alias("qualification_hash"), ntz("2020-01-01 00:00:00").alias("updated_at"), F.lit(None).cast("string").alias("transition_hash"))
    action = F.when(k() % 4 == 0, "activate").when(k() % 4 == 1, "degrade").when(k() % 4 == 2, "retire").otherwise("re_research")
    requests = c.select(
        k().alias("request_id"), action.alias("action"), "strategy_id", F.when(k() % 37 == 0, ntz("2019-06-01 00:00:00")).otherwise(ntz("2020-06-01 00:00:00")).alias("at"), F.when(k() % 41 == 0, " ").otherwise("decided").alias("reason"),
        F.when(k() % 43 == 0, 2.0).otherwise(0.0).alias("position"), F.when(k() % 4 == 1, F.concat(F.lit("e"), k())).alias("event_id"), F.when(k() % 8 == 3, F.concat(F.lit("f"), k())).alias("feedback_id"),
    )
    signed = lambda df, columns, name: df.withColumn(name, ledger.content_digest(columns))
    text = lambda names: [F.lit("x").alias(n) for n in names]
    baselines = c.filter(k() % 7 != 0).select("strategy_id", "qualification_hash", F.concat(F.lit("b"), k()).alias("binding_hash"), ntz("2020-02-01 00:00:00").alias("created_at"))
    regimes = signed(c.select("c_custkey", "strategy_id", "qualification_hash", *text([n for n in evaluation.REGIME if n not in ("strategy_id", "qualification_hash")])), evaluation.REGIME, "regime_hash")
    own = ("strategy_id", "qualification_hash", "window_end", "regime_hash")
    snapshots = signed(regimes.select("c_custkey", "strategy_id", "qualification_hash", "regime_hash", ntz("2020-03-01 00:00:00").alias("window_end"), *text([n for n in evaluation.SNAPSHOT if n not in own])), evaluation.SNAPSHOT, "snapshot_hash")
    own = ("strategy_id", "qualification_hash", "snapshot_hash", "rule")
    events = signed(snapshots.select("c_custkey", "strategy_id", "qualification_hash", "snapshot_hash", F.lit(monitoring.RULES[2]).alias("rule"), *text([n for n in evaluation.EVENT if n not in own])), evaluation.EVENT, "event_hash")
    events = events.withColumn("at", ntz("2020-03-01 00:00:00")).withColumn("observed", F.when(k() % 5 == 0, "changed").otherwise(F.col("observed")))  # those of every fifth are damaged
    own = ("strategy_id", "event_hash")
    feedback = signed(events.select("c_custkey", "strategy_id", "event_hash", ntz("2020-04-01 00:00:00").alias("created_at"), *text([n for n in ledger.FEEDBACK if n not in own])), ledger.FEEDBACK, "feedback_hash")
    requests = requests.join(events.filter(k() % 47 != 0).select(F.concat(F.lit("e"), k()).alias("event_id"), "event_hash"), "event_id", "left").join(feedback.select(F.concat(F.lit("f"), k()).alias("feedback_id"), "feedback_hash"), "feedback_id", "left")
    judged = governance.judged(requests, registry, baselines=baselines, events=events, snapshots=snapshots, regimes=regimes, feedback=feedback)
    return registry, judged


GOVERNED = """g AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'activate' WHEN 1 THEN 'degrade' WHEN 2 THEN 'retire' ELSE 're_research' END AS action, CASE c_custkey % 3 WHEN 0 THEN 'PAPER_ELIGIBLE' WHEN 1 THEN 'PAPER_ACTIVE' ELSE 'DEGRADED' END AS state FROM customer),
j AS (SELECT *, CASE WHEN k % 4 >= 2 AND k % 41 = 0 THEN 'no reason' WHEN k % 4 >= 2 AND k % 43 = 0 THEN 'open position' WHEN action = 'degrade' AND k % 47 = 0 THEN 'no event' WHEN action = 'degrade' AND k % 5 = 0 THEN 'damaged event'
 WHEN (action = 'activate' AND state <> 'PAPER_ELIGIBLE') OR (action = 'degrade' AND state = 'DEGRADED') OR (action = 're_research' AND state <> 'DEGRADED') THEN 'state'
 WHEN action = 'activate' AND k % 31 = 0 THEN 'no qualification' WHEN action = 'activate' AND k % 7 = 0 THEN 'no baseline' WHEN action = 'degrade' AND k % 31 = 0 THEN 'event of another qualification'
 WHEN action = 'degrade' AND k % 37 = 0 THEN 'event is later' WHEN k % 37 = 0 THEN 'too early' END AS refused,
 CASE action WHEN 'activate' THEN 'PAPER_ACTIVE' WHEN 'degrade' THEN 'DEGRADED' WHEN 'retire' THEN 'RETIRED' ELSE 'RESEARCH' END AS new_state,
 CASE action WHEN 'activate' THEN 'baseline_binding' WHEN 'degrade' THEN 'degradation_event' WHEN 'retire' THEN 'retirement_decision' ELSE CASE WHEN k % 8 = 3 THEN 'RESEARCH_FEEDBACK' ELSE 're_research_decision' END END AS evidence_type FROM g)"""


@query("q_governance_requests", f"WITH {GOVERNED} SELECT k AS request_id, action, state AS old_state, new_state, evidence_type, refused FROM j")
def _(spark, sf):
    return governed(spark, sf)[1].select("request_id", "action", "old_state", "new_state", "evidence_type", "refused")


@query("q_governance_registry", f"WITH {GOVERNED} SELECT k::VARCHAR AS strategy_id, CASE WHEN refused IS NULL THEN new_state ELSE state END AS state, CASE WHEN k % 31 <> 0 AND NOT (refused IS NULL AND new_state = 'RESEARCH') THEN 'Q' || k END AS qualification_hash, refused IS NULL AS moved FROM j")
def _(spark, sf):
    registry, judged = governed(spark, sf)
    after = governance.moved(registry, governance.transitions_of(judged))
    return after.select("strategy_id", "state", "qualification_hash", F.col("transition_hash").isNotNull().alias("moved"))


@query("q_governance_linkage", f"WITH {GOVERNED} SELECT k::VARCHAR AS strategy_id, CASE WHEN refused IS NULL THEN k % 9 <> 0 ELSE state = 'PAPER_ELIGIBLE' END AS linked FROM j")
def _(spark, sf):
    registry, judged = governed(spark, sf)
    made = governance.transitions_of(judged)
    damaged = made.withColumn("reason", F.when(F.col("strategy_id").cast("bigint") % 9 == 0, "changed").otherwise(F.col("reason")))
    return governance.linkage(governance.moved(registry, made), damaged)


@query("q_promotion_faults", """SELECT c_custkey::VARCHAR AS strategy_id, CASE WHEN c_custkey % 5 = 0 THEN 'state' WHEN c_custkey % 7 = 0 THEN 'no qualification' WHEN c_custkey % 11 = 0 THEN 'damaged qualification' WHEN c_custkey % 13 = 0 THEN 'another specification'
 WHEN c_custkey % 17 = 0 THEN 'final_status' WHEN c_custkey % 19 = 0 THEN 'holdout_state' END AS fault FROM customer WHERE fault IS NOT NULL""")
def _(spark, sf):
    c = strategies(spark, sf)
    asked = c.select("strategy_id", F.when(k() % 5 == 0, "RESEARCH").otherwise("VALIDATION").alias("state"), F.lit("spec").alias("spec_hash"))
    columns = ["strategy_id", "spec_hash", "final_status", "holdout_state"]
    records = c.filter(k() % 7 != 0).select("c_custkey", "strategy_id", F.when(k() % 13 == 0, "x").otherwise("spec").alias("spec_hash"), F.when(k() % 17 == 0, "REJECTED").otherwise("PAPER_ELIGIBLE").alias("final_status"), F.when(k() % 19 == 0, "FAILED").otherwise("PASSED").alias("holdout_state"))
    records = records.withColumn("record_hash", F.when(k() % 11 != 0, ledger.content_digest(columns)).otherwise("damaged"))
    return governance.promotion_faults(asked, records, columns)


@query("q_paper_eligibility", "SELECT c_custkey::VARCHAR AS strategy_id, CASE WHEN c_custkey % 11 = 0 THEN 'tampered' WHEN c_custkey % 17 = 0 THEN 'status is REJECTED' WHEN c_custkey % 19 = 0 THEN 'holdout is FAILED' ELSE 'eligible' END AS reason, reason = 'eligible' AS eligible FROM customer")
def _(spark, sf):
    columns = ["strategy_id", "qualification_id", "final_status", "holdout_state"]
    records = strategies(spark, sf).select("c_custkey", "strategy_id", F.col("qualification_hash").alias("qualification_id"), F.when(k() % 17 == 0, "REJECTED").otherwise("PAPER_ELIGIBLE").alias("final_status"), F.when(k() % 19 == 0, "FAILED").otherwise("PASSED").alias("holdout_state"))
    records = records.withColumn("record_hash", F.when(k() % 11 != 0, ledger.content_digest(columns)).otherwise("damaged"))
    return ledger.paper_eligibility(records, columns).select("strategy_id", "reason", "eligible")


# ---- trials


def run_trials(spark, sf):
    o, key = load(spark, sf, "orders"), F.col("o_orderkey")
    mode = F.when(key % 3 == 0, "FIXTURE").otherwise("PRODUCTION")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    return o.select(
        key.alias("trial_id"), F.col("o_orderpriority").alias("scope"), F.col("o_custkey").cast("string").alias("strategy_id"), F.date_format("o_orderdate", "yyyy-MM").alias("experiment_id"), mode.alias("mode"), status.alias("status"), F.col("o_orderdate").alias("started"),
        F.lit(None).cast("double").alias("actual_minutes"), F.lit(None).cast("double").alias("actual_cost"), (F.col("o_totalprice") / 1000).alias("estimated_minutes"), F.lit(0.5).alias("estimated_cost"),
        F.when(key % 7 != 0, F.concat(F.lit('{"artifact_sha256":"a'), key % 5, F.lit('"}'))).otherwise("{}").alias("result_json"),
    )


ELIGIBLE = """el AS (SELECT o_orderkey AS trial_id, o_orderpriority AS scope, o_custkey::VARCHAR AS strategy_id, 'a' || (o_orderkey % 4) AS artifact_sha256 FROM orders
 WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 5 = o_orderkey % 4) AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)"""


def eligible_trials(spark, sf):
    t, key = run_trials(spark, sf), F.col("trial_id")
    artifacts = t.filter(key % 2 == 0).select("trial_id", F.concat(F.lit("a"), key % 4).alias("sha256"), F.concat(F.lit("/artifacts/"), key).alias("path"))
    files = artifacts.filter(key % 11 != 0).select("path", "sha256")
    returns = t.select("trial_id", F.when(key % 13 == 0, float("nan")).otherwise(1.0).alias("net_return_bps"))
    return ledger.eligible(t, artifacts, files, returns)


@query("q_eligible_trials", f"WITH {ELIGIBLE} SELECT trial_id, strategy_id, artifact_sha256 FROM el")
def _(spark, sf):
    return eligible_trials(spark, sf).select("trial_id", "strategy_id", "artifact_sha256")


@query("q_population_hash", f"""WITH {ELIGIBLE} SELECT scope, sha256('[' || string_agg('{{"artifact_sha256":"' || artifact_sha256 || '","strategy_id":"' || strategy_id || '","trial_id":"' || trial_id || '"}}', ',' ORDER BY trial_id::VARCHAR) || ']') AS population_hash FROM el GROUP BY 1""")
def _(spark, sf):
    return ledger.population_hash(eligible_trials(spark, sf))


@query("q_population_summary", """SELECT o_orderpriority AS scope, count(*) FILTER (o_orderkey % 3 <> 0) AS production_trials, count(DISTINCT strftime(o_orderdate, '%Y-%m')) FILTER (o_orderkey % 3 <> 0) AS production_experiments,
 count(DISTINCT o_custkey) FILTER (o_orderkey % 3 <> 0) AS production_variants, count(*) FILTER (o_orderkey % 3 = 0) AS fixture_trials FROM orders GROUP BY 1""")
def _(spark, sf):
    return readmodels.population_summary(run_trials(spark, sf), ["scope"])


@query("q_trial_ends", "SELECT o_orderkey AS trial_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'REJECTED_NONCAUSAL' ELSE 'RUNNING' END END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 2.5::DOUBLE END AS actual_minutes FROM orders")
def _(spark, sf):
    t = run_trials(spark, sf)
    ends = t.filter("status = 'RUNNING' and trial_id % 4 = 0").select("trial_id", F.lit("REJECTED_NONCAUSAL").alias("status"), F.lit(2.5).alias("actual_minutes"), F.lit(0.0).alias("actual_cost"), ntz("2020-01-01 00:00:00").alias("completed"))
    return ledger.complete(t, ends).select("trial_id", "status", "actual_minutes")


@query("q_stale_trials", "SELECT o_orderkey AS trial_id, 'ABANDONED' AS status, round(o_totalprice / 1000, 6) + 0.0 AS actual_minutes FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 1440 MINUTE")
def _(spark, sf):
    return ledger.stale(run_trials(spark, sf), "1996-01-01 00:00:00", 1440).select("trial_id", "status", rounded(F.col("actual_minutes"), 6).alias("actual_minutes"))


@query("q_existence", "SELECT true AS known, false AS unknown")
def _(spark, sf):
    t = run_trials(spark, sf)
    return spark.createDataFrame([(ledger.exists(t, status="COMPLETED", mode="FIXTURE"), ledger.exists(t, status="COMPLETED", mode="NONE"))], "known boolean, unknown boolean")


@query("q_reports_range", "SELECT o_orderkey AS trial_id, o_orderdate AS started FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 <> 0 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def _(spark, sf):
    rows = ledger.matching(run_trials(spark, sf), status="FAILED", mode="PRODUCTION", experiment_id=None)
    return ledger.in_time_order(ledger.between(rows.withColumn("started", F.col("started")), "started", datetime(1996, 1, 1), datetime(1996, 6, 30)), "started", "trial_id").select("trial_id", "started")


# ---- registries, sources, zones


@query("q_register_datasets", "SELECT n_name AS version, 'LICENSED' AS kind, 'parquet' AS format, '/data/' || n_name AS path, sha256(n_name) AS sha256 FROM nation WHERE n_nationkey % 3 <> 0")
def _(spark, sf):
    n = load(spark, sf, "nation")
    rows = n.select(F.col("n_name").alias("version"), F.lit("LICENSED").alias("kind"), F.lit("parquet").alias("format"), F.concat(F.lit("/data/"), "n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"), "n_nationkey")
    return sources.register(rows, rows.filter("n_nationkey % 3 = 0"))


@query("q_csv_scan", f"WITH {BARS} SELECT contract, ts, round(open, 6) + 0.0 AS open, round(close, 6) + 0.0 AS close, volume, 0::BIGINT AS open_interest FROM bars")
def _(spark, sf):
    """Bars written without open interest as CSV, and scanned with the bars' schema."""
    path = staged_path(spark, "csv")
    bars(spark, sf).withColumn("open_interest", F.lit(None).cast("bigint")).write.option("header", True).csv(path)
    return sources.read_csv(spark, path).select("contract", "ts", rounded(F.col("open")).alias("open"), rounded(F.col("close")).alias("close"), "volume", "open_interest")


@query("q_parquet_scan", f"WITH {BARS} SELECT contract, count(*) AS n, sum(volume)::BIGINT AS volume, 0::BIGINT AS open_interest FROM bars GROUP BY 1")
def _(spark, sf):
    path = staged_path(spark, "parquet")
    bars(spark, sf).drop("open_interest").write.parquet(path)
    return sources.read_parquet(spark, path).groupBy("contract").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.sum("open_interest").alias("open_interest"))


@query("q_artifact", f"WITH {TRADES} SELECT 'T1' AS trial_id, signal_ts, entry_ts, side, {s6('net_bps')} FROM tr")
def _(spark, sf):
    path = staged_path(spark, "artifact")
    research.write_artifact(made_trades(spark, sf), path, "T1")
    read = research.read_artifact(spark, path)
    return read.select("trial_id", "signal_ts", "entry_ts", F.col("side").cast("int").alias("side"), rounded(F.col("net_return_bps")).alias("net_bps"))


@query("q_verified_file", "SELECT count(*) AS n FROM orders")
def _(spark, sf):
    """A registered file, read because it has the registered digest."""
    path = staged_path(spark, "verified")
    load(spark, sf, "orders").select("o_orderkey").coalesce(1).write.parquet(path)
    found = sources.file_digests(spark, path).filter("path like '%.parquet'").first()
    return sources.verified(spark, found.path, found.sha256).agg(F.count("*").alias("n"))


@query("q_feed_digest", f"""WITH {BARS}, t AS (SELECT contract, concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), printf('%.8f', open), printf('%.8f', high), printf('%.8f', low), printf('%.8f', close), volume::VARCHAR, open_interest::VARCHAR) AS s FROM bars)
SELECT contract, count(*) AS n, sha256(count(*)::VARCHAR || ':' || sum(('0x' || substr(sha256(s), 1, 15))::UBIGINT::HUGEINT)::VARCHAR) AS digest FROM t GROUP BY 1""")
def _(spark, sf):
    return sources.feed_digest(sources.feed(bars(spark, sf)))


@query("q_bar_rules", f"""WITH {BARS}, b AS (SELECT contract, ts, extract(hour FROM ts) AS h, extract(day FROM ts) AS d, open, close, high, low FROM bars)
SELECT contract, 'high_low' AS rule, count(*) AS n FROM b WHERE h = 3 GROUP BY 1 UNION ALL SELECT contract, 'negative_volume', count(*) FROM b WHERE h = 5 GROUP BY 1 UNION ALL SELECT contract, 'not_finite', count(*) FROM b WHERE h = 7 GROUP BY 1
UNION ALL SELECT contract, 'not_positive', count(*) FROM b WHERE h = 3 AND least(low, open, close) - 1 <= 0 GROUP BY 1 UNION ALL SELECT contract, 'null', count(*) FROM b WHERE h = 9 GROUP BY 1 UNION ALL SELECT contract, 'duplicate_ts', count(*) FROM b WHERE h = 11 GROUP BY 1""")
def _(spark, sf):
    h = F.hour("ts")
    b = bars(spark, sf).withColumn("high", F.when(h == 3, F.least("open", "close", "low") - 1).when(h == 7, float("inf")).otherwise(F.col("high"))).withColumn("volume", F.when(h == 5, -F.col("volume")).otherwise(F.col("volume"))).withColumn("close", F.when(h == 9, F.lit(None)).otherwise(F.col("close")))
    return sources.violations(b.unionByName(b.filter(h == 11)))


SPECS = [("2024-01-01", "2024-01-10", 50, 0.05), ("2024-01-11", "2024-01-20", 75, 0.1), ("2024-01-21", None, 25, 0.25)]


@query("q_contract_spec", "SELECT event_id, CASE WHEN ts::DATE <= DATE '2024-01-10' THEN 50 WHEN ts::DATE <= DATE '2024-01-20' THEN 75 ELSE 25 END AS lot_size, CASE WHEN ts::DATE <= DATE '2024-01-10' THEN 0.05::DOUBLE WHEN ts::DATE <= DATE '2024-01-20' THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS tick FROM events")
def _(spark, sf):
    periods = spark.createDataFrame(SPECS, "f string, t string, lot_size int, tick double").select(F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to"), "lot_size", "tick")
    return backtest.with_period(load(spark, sf, "events").select("event_id", "ts"), "ts", periods, ["lot_size", "tick"]).select("event_id", "lot_size", "tick")


@query("q_zone_bounds", """SELECT n_name AS version, CASE WHEN n_nationkey % 2 = 0 THEN 'LICENSED' ELSE 'FIXTURE' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 2 END AS start, CASE WHEN n_nationkey % 3 = 0 THEN 10 ELSE 20 END AS stop FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 = 0""")
def _(spark, sf):
    n = load(spark, sf, "nation").withColumn("version", F.col("n_name"))
    datasets = n.select("version", F.when(F.col("n_nationkey") % 2 == 0, "LICENSED").otherwise("FIXTURE").alias("kind"))
    zone = lambda part, name, a, b: part.select("version", F.lit(name).alias("zone"), F.lit(a).alias("start"), F.lit(b).alias("stop"))
    return zones.zone_bounds(datasets, zone(n.filter("n_nationkey % 3 = 0"), "RESEARCH", 1, 10), zone(n.filter("n_nationkey % 5 = 0"), "research", 2, 20), "research")


@query("q_zone_overlaps", "SELECT 'a' AS zone_a, 'b' AS zone_b, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1996-09-01' HAVING count(*) > 0")
def _(spark, sf):
    z = spark.createDataFrame([("a", "1995-01-01", "1996-09-01"), ("b", "1996-06-01", "1997-01-01"), ("c", "1997-01-01", "1998-01-01")], "zone string, f string, t string")
    z = z.select("zone", F.col("f").cast("timestamp_ntz").alias("start"), F.col("t").cast("timestamp_ntz").alias("stop"))
    return zones.overlaps(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), z, "o_orderdate")


@query("q_manifest_faults", "SELECT unnest(['validation is empty', 'holdout_purge begins before validation ends', 'holdout_purge has no width']) AS fault")
def _(spark, sf):
    """A manifest of the orders' days is sound; with its validation zone turned around, it is not."""
    m = zones.split_manifest(load(spark, sf, "orders").select("o_orderdate"), zones.Gaps(2, 2, 2, 0, 3), column="o_orderdate")
    assert zones.manifest_faults(m, zones.Gaps(2, 2, 2, 0, 3)) == []
    v = F.col("zone") == "validation"
    bad = m.select("zone", F.when(v, F.col("stop")).otherwise(F.col("start")).alias("start"), F.when(v, F.col("stop")).otherwise(F.col("stop")).alias("stop"))
    hp = F.col("zone") == "holdout_purge"
    bad = bad.withColumn("stop", F.when(hp, F.col("start") - F.expr("interval 1 day")).otherwise(F.col("stop"))).withColumn("start", F.when(hp, F.col("stop")).otherwise(F.col("start")))
    return spark.createDataFrame([(f,) for f in zones.manifest_faults(bad, zones.Gaps(2, 2, 2, 0, 3))], "fault string")


@query("q_final_evaluation", f"""WITH {TRADES}, lastday AS (SELECT min(ts::DATE) + 20 AS d FROM bars), t AS (SELECT count(*) AS trades, coalesce(sum(net_pnl), 0) AS net FROM (SELECT side * (nc - no) AS net_pnl FROM (
 SELECT signal AS side, lead(open) OVER w AS no, lead(close) OVER w AS nc FROM sig WHERE ts::DATE >= (SELECT d FROM lastday) WINDOW w AS (PARTITION BY contract, session ORDER BY ts)) WHERE side <> 0 AND no IS NOT NULL))
SELECT CASE WHEN net > 0 AND trades >= 1 THEN 'PASSED' ELSE 'FAILED' END AS state, CASE WHEN net > 0 AND trades >= 1 THEN 'COMPLETED' ELSE 'REJECTED_FINAL_HOLDOUT' END AS status, trades, round(net, 4) + 0.0 AS net_pnl FROM t""")
def _(spark, sf):
    b = bars(spark, sf)
    first = b.agg(F.to_date(F.min("ts")).alias("d"))
    manifest = first.select(F.lit("holdout").alias("zone"), F.date_add("d", 20).cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("stop"))
    spec = research.Spec("current_bar_momentum", 24)
    trial = spark.createDataFrame([(spec.strategy_id, "d", "p", "COMPLETED", "research", "E1", None, 1.0, None, 0.0)], "strategy_id string, dataset string, protocol string, status string, zone string, experiment_id string, actual_minutes double, estimated_minutes double, actual_cost double, estimated_cost double")
    none = spark.createDataFrame([], "strategy_id string, dataset string, protocol string")
    out = research.final_evaluation(b, spec, manifest, dataset="d", protocol="p", trials=trial, burns=none, evaluations=none)
    return out.select("state", "status", "trades", rounded(F.col("net_pnl"), 4).alias("net_pnl"))


# ---- read models and metrics


@query("q_paper_overview", """SELECT (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS active_strategies, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 1) AS degraded_strategies, (SELECT count(*) FROM orders) AS total_orders, (SELECT count(*) FROM lineitem) AS total_fills,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total_risk_events, (SELECT round(sum(v), 2) + 0.0 FROM (SELECT value AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)) AS total_net_pnl""")
def _(spark, sf):
    states = load(spark, sf, "customer").select(F.when(k() % 3 == 0, "PAPER_ACTIVE").when(k() % 3 == 1, "DEGRADED").otherwise("RETIRED").alias("state"))
    e = load(spark, sf, "events")
    reports = e.select(F.struct("ts", "event_id").alias("created_at"), F.to_json(F.struct(F.col("value").alias("net_pnl"))).alias("report_json"))
    o = load(spark, sf, "orders")
    out = readmodels.paper_overview(states, o, load(spark, sf, "lineitem"), o.filter("o_orderstatus = 'P'"), reports)
    return out.withColumn("total_net_pnl", F.col("total_net_pnl") + 0.0)


@query("q_open_positions", "SELECT l_orderkey, l_linenumber, l_quantity - 25 AS quantity FROM lineitem WHERE abs(l_quantity - 25) > 0")
def _(spark, sf):
    return readmodels.open_positions(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("quantity")))


@query("q_dossiers", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM (SELECT DISTINCT o_custkey, o_orderdate, o_orderkey FROM orders)),
l AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS latest, count(*) AS n FROM t WHERE i <= 3 GROUP BY 1)
SELECT c_custkey::VARCHAR AS strategy_id, coalesce(latest, '') AS latest, coalesce(n, 0)::INTEGER AS snapshots_count, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS baselines_count FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def _(spark, sf):
    c = strategies(spark, sf)
    snaps = load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("strategy_id"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    base = c.filter(k() % 2 == 0).select("strategy_id", F.lit(1).alias("created_at"), F.lit("v1").alias("version"))
    d = readmodels.dossiers(c.select("strategy_id"), [("snapshots", snaps, "at", 3), ("baselines", base, "created_at", None)])
    return d.select("strategy_id", F.array_join(F.transform("snapshots", lambda x: x["at"]["o_orderkey"].cast("string")), ",").alias("latest"), "snapshots_count", "baselines_count")


@query("q_holding_bars", "SELECT o_orderpriority AS strategy, count(*) AS trades, round(avg(date_diff('day', o_orderdate, l_shipdate)), 4) + 0.0 AS mean_bars FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf):
    t = load(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = t.select(F.col("o_orderpriority").alias("strategy"), F.date_diff("l_shipdate", "o_orderdate").alias("bars_held"))
    return monitoring.holding_bars(held, "strategy").withColumn("mean_bars", F.col("mean_bars") + 0.0)


@query("q_spilled_trades", "SELECT o_orderpriority AS strategy, count(*) FILTER (o_orderdate::DATE <> l_shipdate::DATE) AS spills FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf):
    t = load(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("b")).join(load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.col("o_orderpriority").alias("strategy")), F.col("l_orderkey") == F.col("o_orderkey"))
    return monitoring.overnight_spills(t, "strategy", "a", "b")


@query("q_limit_utilisation", "SELECT l_suppkey AS strategy, round(max(l_extendedprice * 50) / 4000000.0, 4) + 0.0 AS utilisation FROM lineitem GROUP BY 1")
def _(spark, sf):
    c = F.col
    p = load(spark, sf, "lineitem").select(c("l_suppkey").alias("strategy"), c("l_quantity").alias("quantity"), (c("l_extendedprice") / c("l_quantity")).alias("price"))
    return monitoring.peak_exposure(p, "strategy", 50).select("strategy", (monitoring.limit_utilisation(F.col("peak_exposure"), F.lit(4_000_000.0)) + 0.0).alias("utilisation"))


@query("q_drawdown_ratio", f"WITH {CURVE}, pk AS (SELECT *, max(equity) OVER (PARTITION BY contract ORDER BY session) AS peak FROM eq), d AS (SELECT contract, round(max((peak - equity) / peak * 10000), 4) AS dd, count(*) AS n FROM pk GROUP BY 1) SELECT contract, round(dd / 1.0, 4) + 0.0 AS drawdown_ratio FROM d WHERE n >= 5")
def _(spark, sf):
    s = monitoring.session_pnl(made_trades(spark, sf))
    d = monitoring.drawdown_bps(monitoring.equity_curve(s, 100_000.0)).join(s.groupBy("contract").agg(F.count("*").alias("n")), "contract")
    return d.select("contract", rounded(monitoring.drawdown_ratio(F.col("drawdown_bps"), F.lit(0.25), F.col("n")), 4).alias("drawdown_ratio")).filter("drawdown_ratio is not null")


_TAIL = lambda a, b, p: f"(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM (SELECT unnest(range({a}, {b})) AS i))"


@query("q_gates", f"""WITH r AS (SELECT o_custkey % 40 AS run, count(*) AS n, count(*) FILTER (o_totalprice > 495000) AS few, count(*) FILTER (o_totalprice > 60000) AS many FROM orders GROUP BY 1)
SELECT run, n >= 200 AND few <= 4 AND {_TAIL("0", "few + 1", "0.05::DOUBLE")} <= 0.05 AS false_pass, n >= 100 AND many >= 87 AND {_TAIL("many", "n + 1", "0.8::DOUBLE")} <= 0.05 AS detection FROM r""")
def _(spark, sf):
    price = F.col("o_totalprice")
    r = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("run")).agg(F.count("*").alias("n"), F.count_if(price > 495_000).alias("few"), F.count_if(price > 60_000).alias("many"))
    return r.select("run", statistics.false_pass("few", "n").alias("false_pass"), statistics.detection("many", "n").alias("detection"))
