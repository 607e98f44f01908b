"""Registered queries of the operators that hold at any size, and the SQL that each must
equal. Imported by ``queries``, which they extend."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions.scalars import rounded
from barlab.operators import evaluation, ledger, ordered, readmodels, signals, statistics, synthetic, zones
from barlab.operators.commits import Ledger
from barlab.operators.staging import staged_path
from barlab.paper_queries import paper_orders, strategies
from barlab.plans import research, trials
from barlab.queries import BARS, SQL, TRADES, bars, load, made_trades, query, s6

# ---- clusters of trials: five variants of each contract's returns, the later the noisier

VARIANTS = 5
_NOISE = "((dayofyear(signal_ts) * 24 + hour(signal_ts)) * (7 * k + 3) % 97 - 48)"
_VARIANTS = f"SELECT contract || '-' || k AS trial_id, signal_ts, net_bps + k * 4000.0::DOUBLE * {_NOISE} AS net_bps FROM tr, (SELECT unnest(range({VARIANTS})) AS k)"
_POPULATION = f"""{TRADES}, v AS (%s),
pd AS (SELECT a.trial_id AS a, b.trial_id AS b, count(*) AS n, corr(a.net_bps, b.net_bps) AS r FROM v a JOIN v b ON a.signal_ts = b.signal_ts AND a.trial_id < b.trial_id GROUP BY 1, 2),
ids AS (SELECT DISTINCT trial_id AS t FROM v)"""
# A round merges the closest pair of clusters; the distances of a union are the sums of its parts'.
_LINKAGE = f"""{_POPULATION}, p(it, a, b, size, total) AS (
 SELECT 0, x.t, y.t, 1::BIGINT, coalesce(CASE WHEN n >= 50 THEN sqrt(greatest(0, 2 * (1 - greatest(-1, least(1, r))))) END, 2.0)::DOUBLE FROM ids x JOIN ids y ON x.t < y.t LEFT JOIN pd ON pd.a = x.t AND pd.b = y.t
 UNION ALL SELECT it + 1, least(x, y), greatest(x, y), sum(size)::BIGINT, sum(total) FROM (
  SELECT p.it, CASE WHEN p.a = m.b THEN m.a ELSE p.a END AS x, CASE WHEN p.b = m.b THEN m.a ELSE p.b END AS y, p.size, p.total FROM p, (SELECT a, b FROM p WHERE total / size <= 0.6325 ORDER BY total / size, a, b LIMIT 1) m) WHERE x <> y GROUP BY 1, 2, 3),
m AS (SELECT it, arg_min(a, (total / size, a, b)) AS kept, arg_min(b, (total / size, a, b)) AS gone FROM p GROUP BY it HAVING min(total / size) <= 0.6325),
f(t, c, it) AS (SELECT t, t, 0 FROM ids UNION ALL SELECT t, CASE WHEN c = gone THEN kept ELSE c END, f.it + 1 FROM f JOIN m ON m.it = f.it),
cl AS (SELECT t AS trial_id, c AS cluster FROM f WHERE it = (SELECT max(it) FROM f))"""


def population(spark, sf):
    noise = F.expr(_NOISE)
    rows = made_trades(spark, sf).select("contract", "signal_ts", "net_bps", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("k"))
    return rows.select(F.concat_ws("-", "contract", "k").alias("trial_id"), "signal_ts", (F.col("net_bps") + F.col("k") * 4000.0 * noise).alias("net_return_bps"))


def clustered(spark, sf):
    r = population(spark, sf)
    return r, statistics.clusters(r.select(F.lit("all").alias("scope"), "trial_id"), statistics.aligned_pairs(r, 50))


@query("q_linkage_clusters", f"WITH RECURSIVE {_LINKAGE.replace('%s', _VARIANTS)} SELECT 'all' AS scope, trial_id, cluster FROM cl")
def _(spark, sf):
    return clustered(spark, sf)[1]


# The normal distribution by Simpson's rule over 1,000 steps, its inverse by halving.
_PHI = "0.5 + z / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * i / 1000) * (z * i / 1000) / 2)))"
_DEFLATED = """, mo AS (SELECT trial_id, count(*) AS n, avg(net_bps) / stddev_samp(net_bps) AS sharpe, skewness(net_bps) AS skew, kurtosis(net_bps) AS kurt FROM v GROUP BY 1),
sc AS (SELECT stddev_samp(sharpe) AS sigma, count(DISTINCT cluster) AS effective FROM mo JOIN cl USING (trial_id)),
h(q, lo, hi, it) AS (SELECT unnest([1 - 1.0::DOUBLE / effective, 1 - 1.0::DOUBLE / (effective * exp(1.0))]), -9.0::DOUBLE, 9.0::DOUBLE, 0 FROM sc
 UNION ALL SELECT q, CASE WHEN {PHI} < q THEN z ELSE lo END, CASE WHEN {PHI} < q THEN hi ELSE z END, it + 1 FROM (SELECT *, (lo + hi) / 2 AS z FROM h WHERE it < 52)),
be AS (SELECT sigma, effective, CASE WHEN effective <= 1 THEN 0 ELSE sigma * ((1 - 0.5772156649015329) * min(lo) + 0.5772156649015329 * max(lo)) END AS best FROM h, sc WHERE it = 52 GROUP BY sigma, effective),
dz AS (SELECT *, sqrt(greatest(1e-12, (1 - skew * sharpe + (kurt + 2) / 4 * sharpe * sharpe) / (n - 1))) AS se, (sharpe - best) / se AS z FROM mo, be)""".replace("{PHI}", _PHI)


@query("q_deflated_population", f"WITH RECURSIVE {_LINKAGE.replace('%s', _VARIANTS)}{_DEFLATED} SELECT trial_id, n, effective, round(sharpe, 6) + 0.0 AS sharpe, round(best, 6) + 0.0 AS best, round(z, 5) + 0.0 AS z, round({_PHI}, 5) + 0.0 AS dsr FROM dz")
def _(spark, sf):
    r, members = clustered(spark, sf)
    d = statistics.deflated_sharpe(statistics.return_moments(r), members)
    return d.select("trial_id", "n", "effective", rounded(F.col("sharpe")).alias("sharpe"), rounded(F.col("best")).alias("best"), rounded(F.col("z"), 5).alias("z"), rounded(F.col("dsr"), 5).alias("dsr"))


# The same SQL of the contracts themselves, for the queries of them.
_OF_CONTRACTS = _LINKAGE.replace("%s", "SELECT contract AS trial_id, signal_ts, net_bps FROM tr")
SQL["q_eict_clusters"] = f"WITH RECURSIVE {_OF_CONTRACTS} SELECT 'all' AS scope, trial_id, cluster FROM cl"
SQL["q_deflated_sharpe"] = f"WITH RECURSIVE {_OF_CONTRACTS}{_DEFLATED} SELECT 'all' AS scope, trial_id, n, effective, {s6('sharpe', 'sigma', 'best', 'se')}, round(z, 5) + 0.0 AS z, round({_PHI}, 5) + 0.0 AS dsr, {_PHI} >= 0.95 AS passes FROM dz"


# ---- windows of a year, begun every month, of every strategy

FIRST, MONTHS = "1995-01-01", 36


@query("q_rolling_windows", f"""WITH w AS (SELECT c_custkey AS k, m, TIMESTAMP '{FIRST}' + to_months(m::INTEGER) AS a, TIMESTAMP '{FIRST}' + to_months(m::INTEGER + 12) AS b FROM customer, (SELECT unnest(range({MONTHS})) AS m)),
o AS (SELECT w.k, m, orders.*, (1 + o_orderkey % 3) AS q, (o_totalprice - 150000) / 100 AS pnl, (1 + o_orderkey % 4) * o_totalprice / 100 AS expo FROM w JOIN orders ON o_custkey = k AND o_orderdate BETWEEN a AND b),
s AS (SELECT k, m, count(*) AS total_trades, count(*) FILTER (o_orderstatus = 'P') AS rejected, sum(o_totalprice / 20000) / sum(o_totalprice / 100 * q) * 10000 AS slippage_bps, max(expo) AS peak_exposure FROM o GROUP BY 1, 2),
n AS (SELECT k, m, sum(pnl) AS net_pnl FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k, m, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) = 1) GROUP BY 1, 2),
c AS (SELECT k, m, o_orderdate AS ts, 100000 + sum(pnl) AS e FROM o GROUP BY 1, 2, 3), d AS (SELECT *, max(e) OVER (PARTITION BY k, m ORDER BY ts) AS peak FROM c),
f AS (SELECT k, m, least(10000, greatest(0, max(CASE WHEN peak <= 0 OR e <= 0 THEN 10000 ELSE (peak - e) / peak * 10000 END))) AS fall FROM d GROUP BY 1, 2)
SELECT w.k || '-' || w.m AS window_id, coalesce(total_trades, 0) AS total_trades, coalesce(rejected, 0) AS rejected, round(coalesce(slippage_bps, 0), 4) + 0.0 AS slippage_bps, round(coalesce(peak_exposure, 0), 4) + 0.0 AS peak_exposure,
 round(coalesce(net_pnl, 0), 4) + 0.0 AS net_pnl, round(coalesce(fall, 0), 4) + 0.0 AS drawdown_bps FROM w LEFT JOIN s USING (k, m) LEFT JOIN n USING (k, m) LEFT JOIN f USING (k, m)""")
def _(spark, sf):
    c, o, key, price = strategies(spark, sf), paper_orders(spark, sf), F.col("o_orderkey"), F.col("o_totalprice")
    start = lambda months: F.add_months(F.lit(FIRST).cast("date"), months).cast("timestamp_ntz")
    w = c.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
    windows = w.select(F.concat_ws("-", "c_custkey", "m").alias("window_id"), "strategy_id", "qualification_hash", start(F.col("m")).alias("window_start"), start(F.col("m") + 12).alias("window_end"), F.lit(None).cast("string").alias("observed_report"))
    terms = [F.lit("x").alias(n) for n in evaluation.BOUND]
    sessions = F.array().cast("array<struct<session_id:string,start_ts:timestamp_ntz,end_ts:timestamp_ntz,trades:bigint,net_pnl:double>>")
    numbers = [F.lit(1).alias("lot_size"), F.lit(100_000.0).alias("initial_capital"), F.lit(300.0).alias("max_drawdown_bps"), F.lit(1.5).alias("slippage_bps"), sessions.alias("sessions")]
    report = F.concat(F.lit("B"), "c_custkey").alias("report_hash")
    done = evaluation.evaluate(
        windows, qualifications=c.select(F.col("qualification_hash").alias("record_hash"), "strategy_id", F.lit("PAPER_ELIGIBLE").alias("final_status")), baselines=c.select("strategy_id", "qualification_hash", report, *terms),
        reports=c.select(report, "strategy_id", "qualification_hash", F.lit("FORWARD_PAPER").alias("split_zone"), *numbers, *terms),
        orders=o.select(key.alias("order_id"), "strategy_id", F.col("o_orderdate").alias("submit_ts"), F.when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("FILLED").alias("status")),
        fills=o.select(key.alias("fill_id"), "strategy_id", F.col("o_orderdate").alias("fill_ts"), (price / 100).alias("price"), (1 + key % 3).alias("quantity"), (price / 10_000).alias("cost"), (price / 20_000).alias("slippage")),
        positions=o.select("strategy_id", F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), key.alias("seq"), (1 + key % 4).alias("quantity"), (price / 100).alias("price"), ((price - 150_000) / 100).alias("realized_pnl")),
        risk_events=o.filter("o_orderstatus = 'P'").select(key.alias("event_id"), "strategy_id", F.col("o_orderdate").alias("ts"), F.lit("RULE").alias("rule_name")),
    )
    return done.snapshots.select("window_id", "total_trades", "rejected", *(rounded(F.col(c), 4).alias(c) for c in ("slippage_bps", "peak_exposure", "net_pnl", "drawdown_bps")))


# ---- provenance: an order rests on its customer and suppliers, these on nations, those on regions, which lead back

_LINKS = """ln AS (SELECT 'O' || o_orderkey AS s, 'C' || o_custkey AS t FROM orders UNION SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
 UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || n_regionkey, 'N' || min(n_nationkey) FROM nation GROUP BY 1)"""


def provenance_links(spark, sf):
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    link = lambda table, a, b: load(spark, sf, table).select(node(*a).alias("source"), node(*b).alias("target"))
    nation = load(spark, sf, "nation")
    back = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")).select(node("R", "n_regionkey").alias("source"), node("N", "n").alias("target"))
    links = link("orders", ("O", "o_orderkey"), ("C", "o_custkey")).unionByName(link("lineitem", ("O", "l_orderkey"), ("S", "l_suppkey"))).unionByName(link("customer", ("C", "c_custkey"), ("N", "c_nationkey")))
    return links.unionByName(link("supplier", ("S", "s_suppkey"), ("N", "s_nationkey"))).unionByName(link("nation", ("N", "n_nationkey"), ("R", "n_regionkey"))).unionByName(back)


@query("q_provenance_closure", f"""WITH RECURSIVE {_LINKS}, r(start, node, distance) AS (SELECT 'O' || o_orderkey, 'O' || o_orderkey, 0 FROM orders UNION SELECT start, t, distance + 1 FROM r JOIN ln ON s = node WHERE distance < 8)
SELECT start, node, min(distance)::INTEGER AS distance FROM r GROUP BY 1, 2""")
def _(spark, sf):
    starts = load(spark, sf, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("start"))
    return readmodels.closure(provenance_links(spark, sf), starts).select("start", "node", "distance")


@query("q_provenance_broken", """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), s AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT k::VARCHAR AS identifier, count(*) AS nodes, count(*) FILTER (broken) AS broken, max(d)::INTEGER AS furthest FROM (
 SELECT k, 0 AS d, false AS broken FROM s UNION ALL SELECT k, 1, n % 5 = 0 FROM s JOIN c USING (k) UNION ALL SELECT k, 2, n_regionkey = 3 FROM s JOIN c USING (k) JOIN nation ON n_nationkey = n) GROUP BY 1""")
def _(spark, sf):
    """Customers with orders, whose nations and regions are known but for some."""
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    links = c.select(node("C", "c_custkey").alias("source"), node("N", "c_nationkey").alias("target")).unionByName(n.select(node("N", "n_nationkey").alias("source"), node("R", "n_regionkey").alias("target")))
    known = readmodels.nodes([(c.select(node("C", "c_custkey").alias("id")), "id", "customer"), (n.filter("n_nationkey % 5 <> 0").select(node("N", "n_nationkey").alias("id")), "id", "nation"), (n.filter("n_regionkey <> 3").select(node("R", "n_regionkey").alias("id")).distinct(), "id", "region")])
    held = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), node("C", "o_custkey").alias("strategy_id")).distinct()
    got = readmodels.provenance(held.select(F.col("id").cast("string").alias("identifier")), [(held, "id", "strategy_id")], links, known)
    return got.groupBy("identifier").agg(F.count("*").alias("nodes"), F.count_if("broken").alias("broken"), F.max("distance").alias("furthest"))


# ---- the dossier of a strategy: nine tables, the latest ten of snapshots, events and feedback

PARTS = {"qualifications": 1, "baselines": None, "reports": 1, "regimes": None, "transitions": None, "snapshots": 10, "events": 10, "feedback": 10, "positions": None}


def _dossier_sql() -> str:
    of = {n: f"FILTER (o_orderkey % {len(PARTS)} = {i})" for i, n in enumerate(PARTS)}
    count = lambda n: f"least(count(o_orderkey) {of[n]}, {PARTS[n]})" if PARTS[n] else f"count(o_orderkey) {of[n]}"
    columns = ", ".join(f"({count(n)})::INTEGER AS {n}_count, max(o_orderkey) {of[n]} AS {n}_latest" for n in PARTS)
    return f"SELECT c_custkey AS strategy_id, {columns} FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


@query("q_dossier_nine", _dossier_sql())
def _(spark, sf):
    o = load(spark, sf, "orders").withColumn("strategy_id", F.col("o_custkey"))
    parts = [(n, o.filter(F.col("o_orderkey") % len(PARTS) == i).select("strategy_id", "o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey", most) for i, (n, most) in enumerate(PARTS.items())]
    out = readmodels.dossiers(load(spark, sf, "customer").select(F.col("c_custkey").alias("strategy_id")), parts)
    return out.select("strategy_id", *(c for n in PARTS for c in (F.col(f"{n}_count"), F.get(n, F.lit(0))["o_orderkey"].alias(f"{n}_latest"))))


# ---- trials as events, ledgers, files, long contracts


def trial_events(spark, sf):
    """A start of every order's trial, and the end of those that are over."""
    o, key = load(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    text = lambda c, name: c.cast("string").alias(name)
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    start = o.select(
        key.alias("trial_id"), F.lit("STARTED").alias("event"), text(F.col("o_orderpriority"), "dataset"), F.lit("p").alias("protocol"), F.when(F.col("o_orderkey") % 3 == 0, "FIXTURE").otherwise("PRODUCTION").alias("mode"), text(F.col("o_custkey"), "strategy_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("experiment_id"), F.lit("research").alias("zone"), *none("status"), (F.col("o_totalprice") / 1000).alias("minutes"), F.lit(0.5).alias("cost"), *none("artifact_sha256"), F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    over = o.filter("o_orderstatus <> 'O'")
    end = over.select(
        key.alias("trial_id"), F.lit("ENDED").alias("event"), *none("dataset", "protocol", "mode", "strategy_id", "experiment_id", "zone"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("status"),
        (F.col("o_totalprice") / 2000).alias("minutes"), F.lit(0.25).alias("cost"), *none("artifact_sha256"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 hour")).alias("at"),
    )
    return start.unionByName(end).withColumn("digest", ledger.content_digest(trials.CONTENT))


@query("q_trial_states", """SELECT o_orderpriority AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN 'FIXTURE' ELSE 'PRODUCTION' END AS mode, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status, count(*) AS trials, count(DISTINCT o_custkey) AS strategies,
 round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 1000 ELSE o_totalprice / 2000 END), 6) + 0.0 AS minutes, sum(CASE WHEN o_orderstatus = 'O' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) AS cost FROM orders GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Events written as a version of a ledger, and the trials as they leave them."""
    kept = trials.Trials(spark, staged_path(spark, "trials"))
    kept.store.append(trial_events(spark, sf))
    used = ledger.usage(kept.state(), ["dataset", "mode", "status"])
    return used.select("dataset", "mode", "status", "trials", "strategies", rounded(F.col("minutes")).alias("minutes"), "cost")


@query("q_ledger_commits", "SELECT 1::BIGINT AS version, count(*) AS rows FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT 2, (SELECT count(*) FROM events) UNION ALL SELECT 3, (SELECT count(*) FROM events)")
def _(spark, sf):
    """Two of three events, then all of them, then all again, which makes no version."""
    e = load(spark, sf, "events").select("event_id", "event_type", "value")
    e = e.withColumn("digest", ledger.content_digest(["event_id", "event_type", "value"]))
    store = Ledger(spark, staged_path(spark, "ledger"), e.schema, ["event_id"])
    store.append(e.filter("event_id % 3 <> 0"))
    store.append(e)
    store.append(e)
    at = [store.read(v).agg(F.lit(v).cast("bigint").alias("version"), F.count("*").alias("rows")) for v in (1, 2, 3)]
    return at[0].unionByName(at[1]).unionByName(at[2])


@query("q_artifact_result", f"WITH {TRADES} SELECT count(*) AS rows, min(signal_ts) AS first_signal, max(entry_ts) AS last_exit, count(*) AS read FROM tr")
def _(spark, sf):
    """What an artifact says of itself, and its rows once its digest is verified."""
    made = research.write_artifact(made_trades(spark, sf), staged_path(spark, "artifact"), "T1")
    return made.row(spark).select("rows", "first_signal", "last_exit", F.lit(research.read_verified(spark, made).count()).alias("read"))


@query("q_long_contract", "WITH l AS (SELECT event_id, ts, value, lag(ts) OVER w AS t, lag(value) OVER w AS v FROM events WINDOW w AS (ORDER BY event_id)) SELECT event_type, count(*) FILTER (l.ts < t) AS back, count(*) FILTER (l.ts = t) AS again, round(sum(abs(l.value - v)), 4) + 0.0 AS path FROM l JOIN events USING (event_id) GROUP BY 1")
def _(spark, sf):
    """All events as one contract in arrival order, each beside the one before."""
    e = load(spark, sf, "events").select(F.lit("all").alias("contract"), "event_id", "event_type", "ts", "value")
    e = ordered.with_previous(e, "contract", "event_id", ["ts", "value"])
    return e.groupBy("event_type").agg(F.count_if(F.col("ts") < F.col("before_ts")).alias("back"), F.count_if(F.col("ts") == F.col("before_ts")).alias("again"), rounded(F.sum(F.abs(F.col("value") - F.col("before_value"))), 4).alias("path"))


@query("q_session_zone_overlaps", f"""WITH {BARS}, z AS (SELECT DISTINCT ts::DATE AS d FROM bars), p AS (SELECT a.d AS a, b.d AS b FROM z a JOIN z b ON b.d = a.d + 1)
SELECT p.a::VARCHAR AS zone_a, p.b::VARCHAR AS zone_b, count(*) AS n FROM p JOIN bars ON ts >= p.b AND ts < p.b + INTERVAL 6 HOUR GROUP BY 1, 2""")
def _(spark, sf):
    """Each day's zone runs six hours into the next day's."""
    b = bars(spark, sf)
    d = b.select(F.to_date("ts").alias("d")).distinct()
    z = d.select(F.col("d").cast("string").alias("zone"), F.col("d").cast("timestamp_ntz").alias("start"), (F.col("d").cast("timestamp_ntz") + F.expr("interval 30 hours")).alias("stop"))
    return zones.overlaps(b, z)


@query("q_causality_cuts", f"""WITH {BARS}, n AS (SELECT contract, count(*) AS c FROM bars GROUP BY 1), t AS (SELECT max(c) AS m FROM n), k AS (SELECT DISTINCT floor(2 + (m - 3) * i / 7) AS x FROM t, (SELECT unnest(range(8)) AS i)) SELECT contract, count(*) AS cuts FROM n, k WHERE x < c GROUP BY 1""")
def _(spark, sf):
    """How many cut points a signal that reads ahead is tried at, and caught, in each contract:
    it gives another sign at every one behind which bars follow."""
    b = bars(spark, sf)
    cuts = signals.cut_points(b.groupBy("contract").count().agg(F.max("count")).first()[0] or 2)

    def ahead(rows):
        from pyspark.sql import Window

        last = F.max("ts").over(Window.partitionBy("contract"))
        return rows.withColumn("signal", F.when(F.col("ts") == last, 1).otherwise(-1))

    return signals.causality_breaks(b, ahead, cuts).groupBy("contract").agg(F.count_distinct("cut").alias("cuts"))


_USED = {"view": "CANDIDATE", "click": "VALIDATION", "purchase": "HOLDOUT_REQUIRED", "signup": "HOLDOUT_PASSED", "error": "REJECTED"}
_AS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _USED.items()) + " END"


@query("q_legal_steps", f"""WITH t AS (SELECT {_AS} AS b, lag({_AS}) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events)
SELECT a AS from_state, b AS to_state, count(*) AS n FROM t WHERE (a = 'CANDIDATE' AND b IN ('VALIDATION', 'REJECTED', 'HOLDOUT_REQUIRED')) OR (a = 'VALIDATION' AND b IN ('HOLDOUT_REQUIRED', 'REJECTED')) OR (a IN ('HOLDOUT_REQUIRED') AND b IN ('HOLDOUT_PASSED', 'REJECTED')) OR (a = 'HOLDOUT_PASSED' AND b = 'REJECTED') GROUP BY 1, 2""")
def _(spark, sf):
    """The steps of users' events that the table of validation steps allows."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    state = F.lit(None).cast("string")
    for kind, name in _USED.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    t = load(spark, sf, "events").withColumn("to_state", state).select("user_id", "event_id", "to_state", F.lag("to_state").over(w).alias("from_state"))
    return t.join(ledger.step_table(spark), ["from_state", "to_state"], "left_semi").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


@query("q_acquisition_runs")
def _(spark, sf):
    """200 directionless copies of the bars, their returns a hundredth as large, and 100 with
    an edge, and the gates' verdicts on the counts."""
    parts = synthetic.components(bars(spark, sf))
    calm = synthetic.rebuilt(parts.withColumns({c: F.col(c) / 100 for c in ("gap", "intrabar", "wick_up", "wick_down")}))
    return research.acquisition(calm, lambda b: signals.volume_tail(b, quantile=0.9, lookback=5), edge_bps=60.0)
