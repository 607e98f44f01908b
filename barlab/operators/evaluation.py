"""Evaluation of paper trading over inclusive windows, for many strategies in one plan:
provenance of what is compared, evidence of the window, its integrity, metrics, snapshots
and degradation events. Windows of a strategy may overlap; its evidence is still summed once.

A window is a row (window_id, strategy_id, qualification_hash, window_start, window_end,
observed_report), the last null where no replay of the window was reported. Whatever makes
a window's inputs unfit is a row of ``faults``; such windows give no snapshot, so nothing
is measured against the wrong baseline.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import content_hash
from barlab.operators import monitoring
from barlab.operators.ledger import content_digest, insert
from barlab.operators.staging import drop_staged, staged

#: Fields of a baseline that its own report, or the observed one, must have alike.
BOUND = ("dataset_version", "dataset_sha256", "execution_policy", "cost_schedule_hash", "risk_config_hash")
EXECUTION = BOUND[2:]
FORWARD = "FORWARD_PAPER"
LEAST_SESSIONS = 10
SNAPSHOT = ["strategy_id", "qualification_hash", "report_hash", "dataset_version", "dataset_sha256", "split_zone", "config_hash", "window_start", "window_end", "total_trades", "net_pnl", "drawdown_bps", "sharpe", "slippage_bps", "cost_bps", "risk_events", "regime_hash"]
REGIME = ["strategy_id", "qualification_hash", "baseline_report", "dataset_version", "dataset_sha256", *EXECUTION, "protocol"]
EVENT = ["strategy_id", "qualification_hash", "snapshot_hash", "rule", "observed", "threshold", "details"]


@dataclass(frozen=True)
class Config:
    """Limits of a monitoring protocol."""

    protocol: str = "MP-1"
    window_sessions: int = 30
    expansion: float = 1.5
    least_sharpe: float = 0.0
    drift: float = 2.0
    most_rejected: float = 0.2

    @property
    def config_hash(self) -> str:
        return content_hash(asdict(self))


@dataclass
class Evaluation:
    snapshots: DataFrame
    events: DataFrame
    faults: DataFrame

    def new(self, snapshots: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The snapshots and events to append to those that are stored: evaluating a window
        again adds nothing."""
        return insert(self.snapshots.withColumn("digest", F.col("snapshot_hash")), snapshots, ["snapshot_hash"]), insert(self.events.withColumn("digest", F.col("event_hash")), events, ["event_hash"])


def future_sessions(sessions: Column, end: Column) -> Column:
    """Whether a report has a session that ends after the window."""
    return F.exists(sessions, lambda s: s["end_ts"] > end)


def only_older_sessions(sessions: Column, start: Column) -> Column:
    """Whether a report has sessions, and all end before the window."""
    return (F.size(sessions) > 0) & F.forall(sessions, lambda s: s["end_ts"] < start)


def bound(windows: DataFrame, qualifications: DataFrame, baselines: DataFrame, reports: DataFrame) -> DataFrame:
    """Each window with its qualification ``q``, baseline ``b``, the baseline's report ``r``
    and the observed report ``o``, as structs that are null where there is none. Each join is
    a merge: small files of records do not mean small rows."""
    row = lambda df, key, name: df.select(*(F.col(c).alias(f"_{c}") for c in key), F.struct(*df.columns).alias(name)).hint("merge")
    pairs = windows.select("strategy_id", "qualification_hash").distinct()  # many windows rest on the same records
    pairs = pairs.join(row(qualifications, ["record_hash"], "q").withColumnRenamed("_record_hash", "qualification_hash"), "qualification_hash", "left")
    b = row(baselines, ["strategy_id", "qualification_hash"], "b")
    pairs = pairs.join(b.withColumnsRenamed({"_strategy_id": "strategy_id", "_qualification_hash": "qualification_hash"}), ["strategy_id", "qualification_hash"], "left")
    pairs = pairs.withColumn("baseline_report", F.col("b.report_hash"))
    pairs = pairs.join(row(reports, ["report_hash"], "r").withColumnRenamed("_report_hash", "baseline_report"), "baseline_report", "left")
    o = row(reports, ["report_hash"], "o").withColumnRenamed("_report_hash", "observed_report")
    seen = windows.filter("observed_report is not null").join(o, "observed_report", "left")
    seen = seen.unionByName(windows.filter("observed_report is null").withColumn("o", F.lit(None).cast(o.schema["o"].dataType)))
    return seen.join(pairs.hint("merge"), ["strategy_id", "qualification_hash"], "left")


@contextmanager
def dealt_once(spark: SparkSession):
    """Tables that are dealt by a strategy alone are joined as they lie, though the join has
    more keys, and summed as they are sorted; else Spark deals both sides anew by all keys."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def named(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold. Few rows have any, so the list is made for these."""
    some = reduce(lambda a, b: a | b, checks.values())
    return F.when(some, F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in checks.items())))).otherwise(F.array().cast("array<string>"))


def provenance_faults() -> Column:
    """Of what ``bound`` gives: the names of every check that a window fails."""
    c = F.col
    differs = lambda x, y: ~c(x).eqNullSafe(c(y))
    has = {n: c(n).isNotNull() for n in "qbro"}
    seen = F.coalesce("o", "r")  # what the snapshot is bound to
    checks: dict[str, Column] = {
        "window": c("window_start").isNull() | c("window_end").isNull() | (c("window_start") > c("window_end")),
        "no qualification": ~has["q"],
        "qualification: strategy_id": has["q"] & differs("q.strategy_id", "strategy_id"),
        "qualification: final_status": has["q"] & ~c("q.final_status").eqNullSafe("PAPER_ELIGIBLE"),
        "no baseline": ~has["b"],
        "no baseline report": has["b"] & ~has["r"],
        "no observed report": c("observed_report").isNotNull() & ~has["o"],
        "split_zone": F.coalesce(has["r"] | has["o"], F.lit(False)) & ~seen["split_zone"].eqNullSafe(FORWARD),
        "baseline drawdown": has["r"] & ~F.coalesce(c("r.max_drawdown_bps") > 0, F.lit(False)),
        "configured slippage": has["r"] & ~F.coalesce(c("r.slippage_bps") >= 0, F.lit(False)),
        "baseline dataset_sha256": has["o"] & has["b"] & c("o.dataset_version").eqNullSafe(c("b.dataset_version")) & differs("o.dataset_sha256", "b.dataset_sha256"),
        "observed: later sessions": has["o"] & future_sessions(c("o.sessions"), c("window_end")),
        "observed: older sessions": has["o"] & only_older_sessions(c("o.sessions"), c("window_start")),
    }
    for name, of in (("r", "baseline report"), ("o", "observed")):
        checks |= {f"{of}: {f}": has[name] & differs(f"{name}.{f}", f) for f in ("strategy_id", "qualification_hash")}
    checks |= {f"baseline report: {f}": has["r"] & has["b"] & differs(f"r.{f}", f"b.{f}") for f in BOUND}
    checks |= {f"observed: {f}": has["o"] & has["b"] & differs(f"o.{f}", f"b.{f}") for f in EXECUTION}
    return named(checks)


KEYS = ["strategy_id", "piece"]
OWN = ("strategy_id", "window_id")


@dataclass
class Pieces:
    """The times of a strategy's windows cut at their ends, so that windows may overlap and
    each row of evidence still counts once. Both ends belong to a window, so a piece is over a
    microsecond behind an end. ``ends`` (window_id, strategy_id, first, stop) are the pieces of
    each window; ``cells`` (strategy_id, piece, since, until, level, cell) are the disjoint
    pieces that a window covers, in one or two cells of 2^level days, the least level of which
    a cell is as long as the piece. No table has a row for each day of a piece. ``evaluate``
    goes by ``runs``, which sorts a strategy's evidence in one task; pieces spread a table of
    evidence over the cells of its strategies."""

    cells: DataFrame
    ends: DataFrame

    @classmethod
    def of(cls, windows: DataFrame) -> Pieces:
        tick = F.expr("interval '0.000001' second")
        own = windows.select("window_id", "strategy_id", F.col("window_start").alias("since"), (F.col("window_end") + tick).alias("until"))
        edge = lambda at, opens: F.struct(F.col(at).alias("since"), F.lit(opens).alias("opens"))
        edges = own.select("strategy_id", F.inline(F.array(edge("since", 1), edge("until", -1)))).groupBy("strategy_id", "since").agg(F.sum("opens").alias("opens"))
        order = Window.partitionBy("strategy_id").orderBy("since")  # two edges a window
        edges = edges.withColumn("piece", F.row_number().over(order)).withColumn("until", F.lead("since").over(order)).withColumn("open", F.sum("opens").over(order))
        first = edges.select("strategy_id", "since", F.col("piece").alias("first"))
        stop = edges.select("strategy_id", F.col("since").alias("until"), F.col("piece").alias("stop"))
        ends = own.join(first.hint("merge"), ["strategy_id", "since"]).join(stop.hint("merge"), ["strategy_id", "until"])
        low, days = F.unix_date(F.to_date("since")), F.col("_high") - F.col("_low")
        cells = edges.filter("open > 0").withColumn("_low", low).withColumn("_high", F.unix_date(F.to_date(F.col("until") - tick)))
        cells = cells.withColumn("level", F.when(days == 0, 0).otherwise(F.length(F.bin(days))))
        cells = cells.withColumn("cell", F.explode(F.expr("sequence(shiftright(_low, level), shiftright(_high, level))")))
        return cls(cells.select("strategy_id", "piece", "since", "until", "level", "cell"), ends.select("window_id", "strategy_id", "first", "stop"))

    def levels(self) -> list[int]:
        """The levels that occur, two dozen at most."""
        return [r.level for r in self.cells.select("level").distinct().collect()]

    def deal(self, rows: DataFrame, at: str, levels: list[int]) -> DataFrame:
        """Adds ``piece`` to the rows that are in one, each in one piece at most. They meet the
        pieces in the cell of each level that holds their day."""
        found = rows.withColumn("level", F.explode(F.array(*(F.lit(n) for n in levels)).cast("array<int>"))).withColumn("_day", F.unix_date(F.to_date(at)))
        found = found.withColumn("cell", F.expr("shiftright(_day, level)")).join(self.cells.hint("merge"), ["strategy_id", "level", "cell"])
        return found.filter((F.col(at) >= F.col("since")) & (F.col(at) < F.col("until"))).drop("level", "cell", "_day", "since", "until")

    def cover(self, used: DataFrame) -> DataFrame:
        """(window_id, strategy_id, piece) of the ``used`` (strategy_id, piece) alone, which
        are numbered anew without gaps: a window has no row for a piece without evidence."""
        spots = self.ends.select("strategy_id", F.explode(F.array("first", "stop")).alias("piece"), F.lit(0).alias("used"))
        spots = spots.unionByName(used.select(*KEYS, F.lit(1).alias("used"))).groupBy(*KEYS).agg(F.max("used").alias("used"))
        order = Window.partitionBy("strategy_id").orderBy("piece")
        spots = spots.withColumn("slot", F.sum("used").over(order) - F.col("used"))
        at = lambda name: spots.select("strategy_id", F.col("piece").alias(name), F.col("slot").alias(f"_{name}")).hint("merge")
        held = self.ends.join(at("first"), ["strategy_id", "first"]).join(at("stop"), ["strategy_id", "stop"]).filter("_first < _stop")
        held = held.select("window_id", "strategy_id", F.explode(F.expr("sequence(_first, _stop - 1)")).alias("slot"))
        return held.join(spots.filter("used = 1").select(*KEYS, "slot").hint("merge"), ["strategy_id", "slot"]).select("window_id", *KEYS)


def runs(windows: DataFrame, evidence: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(strategy_id, at, run, window, and a struct for each name of ``evidence``): the ends of
    the windows (window_id, strategy_id, capital, window_start, window_end) and the rows of
    evidence that lie in a window, one of the structs in each. Evidence is given as rows, the
    column of their time and the columns that are wanted.

    A run is the evidence of a strategy between two neighbouring ends of windows; runs are
    numbered without gaps, and an end has the number of the last run before it, so that a
    window holds the runs after its start's up to its stop's. One sort of a strategy's ends
    and evidence by time finds them; no end meets evidence in a join. Both ends belong to a
    window: it stops a microsecond behind."""
    tick = F.expr("interval '0.000001' second")
    edge = lambda at, opens: F.struct(at.alias("at"), F.struct("window_id", "capital", F.lit(opens).alias("opens")).alias("window"))
    edges = windows.select("strategy_id", F.inline(F.array(edge(F.col("window_start"), 1), edge(F.col("window_end") + tick, -1))))
    tables = [rows.filter(F.col(at).isNotNull()).select("strategy_id", F.col(at).alias("at"), F.struct(*columns).alias(name)) for name, (rows, at, columns) in evidence.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables, edges).repartition("strategy_id")
    order = Window.partitionBy("strategy_id").orderBy("at", F.col("window").isNull())  # at one time, ends go first
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_begins", F.col("window").isNull() & F.lag(F.col("window").isNotNull(), 1, True).over(order))
    rows = rows.withColumn("run", F.sum(F.col("_begins").cast("bigint")).over(so_far)).withColumn("_open", F.sum(F.coalesce("window.opens", F.lit(0))).over(so_far))
    return rows.filter(F.col("window").isNotNull() | (F.col("_open") > 0)).drop("_begins", "_open")


def spans(rows: DataFrame) -> DataFrame:
    """(strategy_id, window_id, capital, last, run): a row for each run of each window, of what
    ``runs`` gives, and its last one. A window without evidence has none."""
    ends = rows.filter(F.col("window").isNotNull()).select("strategy_id", "window.window_id", "window.capital", "run").repartition("strategy_id")
    ends = ends.groupBy(*OWN, "capital").agg(F.min("run").alias("first"), F.max("run").alias("last")).filter("first < last")
    return ends.select(*OWN, "capital", "last", F.explode(F.expr("sequence(first + 1, last)")).alias("run"))


def repeated(rows: DataFrame) -> DataFrame:
    """(strategy_id, run, fault, id, n): how often each id, of those that its strategy has
    more than once in one table of evidence, is in a run."""
    ids = {"order": "order_id", "fill": "fill_id", "risk": "event_id"}
    marked = [F.when(F.col(name).isNotNull(), F.struct(F.lit(f"repeated {c}").alias("fault"), F.col(f"{name}.{c}").cast("string").alias("id"))) for name, c in ids.items()]
    found = rows.select("strategy_id", "run", F.coalesce(*marked).alias("i")).select("strategy_id", "run", "i.*").filter("id is not null").repartition("strategy_id")
    found = found.groupBy("strategy_id", "fault", "id", "run").agg(F.count("*").alias("n"))
    found = found.withColumn("_all", F.sum("n").over(Window.partitionBy("strategy_id", "fault", "id")))
    return found.filter("_all > 1").drop("_all")


def run_sums(rows: DataFrame, capitals: DataFrame) -> DataFrame:
    """Sums of a run's orders, fills and risk events, how many of them have no positive price
    or quantity or no rule, and of its positions the largest and, for each of the strategy's
    ``capitals`` (strategy_id, capital), the highest and lowest equity and the largest fall.
    Equity is the capital and what is realised at a time."""
    has = lambda name, holds: F.count_if(F.col(name).isNotNull() & holds)
    bad = lambda c: has("fill", ~F.coalesce(F.col(f"fill.{c}") > 0, F.lit(False)))
    sums = {
        "submitted": F.count("order"), "rejected": F.count_if(F.col("order.status") == "REJECTED"), "total_trades": F.count("fill"), "value": F.sum(F.col("fill.price") * F.col("fill.quantity")), "cost": F.sum("fill.cost"), "slippage": F.sum("fill.slippage"),
        "bad_price": bad("price"), "bad_quantity": bad("quantity"), "risk_events": F.count("risk"), "unnamed": has("risk", F.coalesce(F.trim("risk.rule_name") == "", F.lit(True))),
    }
    held, realized = F.max(F.abs("position.quantity") * F.col("position.price")), F.sum("position.realized_pnl")
    found = rows.filter(F.col("window").isNull()).select("strategy_id", "run", "at", "order", "fill", "risk", "position").repartition("strategy_id")
    found = found.groupBy("strategy_id", "run", "at").agg(*(c.alias(n) for n, c in sums.items()), held.alias("held"), realized.alias("_realized"))
    found = found.join(capitals.hint("merge"), "strategy_id").withColumn("_equity", F.col("capital") + F.col("_realized"))
    peak = F.max("_equity").over(Window.partitionBy("strategy_id", "run", "capital").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_fall", F.when(F.col("_equity").isNotNull(), drop(peak, F.col("_equity"))))
    return found.groupBy("strategy_id", "run", "capital").agg(*(F.sum(n).alias(n) for n in sums), F.max("held").alias("held"), F.max("_equity").alias("top"), F.min("_equity").alias("low"), F.max("_fall").alias("fall"))


def drop(peak: Column, low: Column) -> Column:
    """The fall in basis points, all of it once equity is used up."""
    return F.when((peak <= 0) | (low <= 0), 10000.0).otherwise(F.try_divide(peak - low, peak) * 10000)


def run_ends(rows: DataFrame) -> DataFrame:
    """(strategy_id, run, ends): the last realised result of each symbol in a run, and the next
    run that has the symbol. Of equal times the first recorded counts."""
    last = F.max(F.struct("at", (-F.col("position.seq")).alias("s"), "position.realized_pnl"))
    ends = rows.filter(F.col("position").isNotNull()).select("strategy_id", "run", "at", "position").repartition("strategy_id")
    ends = ends.groupBy("strategy_id", F.col("position.symbol").alias("symbol"), "run").agg(last["realized_pnl"].cast("double").alias("realized"))
    ends = ends.withColumn("next", F.lead("run").over(Window.partitionBy("strategy_id", "symbol").orderBy("run")))
    return ends.groupBy("strategy_id", "run").agg(F.collect_list(F.struct("next", "realized")).alias("ends"))


def window_sums(cover: DataFrame, sums: DataFrame, ends: DataFrame) -> DataFrame:
    """The windows' sums of their runs' ``run_sums``, ``net_pnl`` and ``drawdown_bps``. The
    result of a window is what its symbols have realised in their last runs of it. Its largest
    fall is in one of its runs, or from the peak of earlier ones to the low of a later one."""
    rows = cover.join(sums.join(ends.hint("merge"), ["strategy_id", "run"], "left").hint("merge"), ["strategy_id", "run", "capital"])
    ended = lambda e: e["next"].isNull() | (e["next"] > F.col("last"))
    rows = rows.withColumn("net", F.aggregate("ends", F.lit(0.0), lambda net, e: net + F.when(ended(e), F.coalesce(e["realized"], F.lit(0.0))).otherwise(0.0))).drop("ends", "last")
    rows = rows.withColumn("_peak", F.max("top").over(Window.partitionBy(*OWN).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    fall = F.greatest("fall", F.when(F.col("_peak") > F.col("low"), drop(F.col("_peak"), F.col("low"))).otherwise(0.0))
    added = [F.sum(c).alias(c) for c in sums.columns if c not in ("strategy_id", "run", "capital", "held", "top", "low", "fall")]
    rows = rows.withColumn("fall", fall).groupBy(*OWN).agg(*added, F.max("held").alias("held"), F.max("fall").alias("fall"), F.sum("net").alias("net"), F.max("capital").alias("capital"))
    known = lambda c: F.when(~F.isnan("capital"), F.round(c, 4))
    return rows.withColumns({"net_pnl": known(F.col("net")), "drawdown_bps": known(F.least(F.lit(10000.0), F.greatest(F.lit(0.0), "fall")))}).drop("capital", "fall", "net")


def completed_sessions(rows: DataFrame) -> DataFrame:
    """(strategy_id, window_id, capital, session_id, start_ts, end_ts, trades, net_pnl) of the
    observed reports' sessions that lie in the window whole."""
    s = rows.filter("sessions is not null").repartition("strategy_id").select(*OWN, "window_start", "window_end", F.col("initial_capital").alias("capital"), F.explode("sessions").alias("s"))
    return s.filter("s.start_ts >= window_start and s.end_ts <= window_end").select(*OWN, "capital", "s.*")


def session_metrics(sessions: DataFrame, width: int, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """(keys, completed_sessions, sharpe, inactive): Sharpe ratio of the last ``width``
    session returns, null for fewer than ten, no spread or used-up equity."""
    order = Window.partitionBy(*keys).orderBy("start_ts", "session_id")
    before = F.col("capital") + F.coalesce(F.sum("net_pnl").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = sessions.withColumn("equity", before).withColumn("ret", F.when(F.col("equity") > 0, F.round(F.try_divide(F.col("net_pnl"), F.col("equity")), 8)))
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    late = F.when(F.col("i") > F.col("n") - width, F.col("ret"))
    m = rows.groupBy(*keys).agg(
        F.count("*").alias("completed_sessions"), F.avg(late).alias("mean"), F.stddev_samp(late).alias("std"), F.count(late).alias("used"),
        F.min("equity").alias("least_equity"), (F.count("*") - F.coalesce(F.max(F.when(F.col("trades") > 0, F.col("i"))), F.lit(0))).alias("inactive"),
    )
    fit = (F.col("used") >= LEAST_SESSIONS) & (F.col("std") * F.col("std") > 1e-14) & (F.col("least_equity") > 0)
    sharpe = F.when(fit, F.round(F.try_divide(F.col("mean"), F.col("std")) * monitoring.SESSIONS_A_YEAR**0.5, 4))
    return m.select(*keys, "completed_sessions", sharpe.alias("sharpe"), "inactive")


def evaluate(windows: DataFrame, *, qualifications: DataFrame, baselines: DataFrame, reports: DataFrame, orders: DataFrame, fills: DataFrame, positions: DataFrame, risk_events: DataFrame, config: Config = Config()) -> Evaluation:
    """Snapshots and degradation events of the windows without faults.

    ``qualifications`` (record_hash, strategy_id, final_status); ``baselines`` (strategy_id,
    qualification_hash, report_hash and BOUND); ``reports`` (report_hash, strategy_id,
    qualification_hash, split_zone, lot_size, initial_capital, max_drawdown_bps,
    slippage_bps, sessions and BOUND); evidence by strategy_id: ``orders`` (order_id,
    submit_ts, status), ``fills`` (fill_id, fill_ts, price, quantity, cost, slippage),
    ``positions`` (symbol, ts, seq, quantity, price, realized_pnl), ``risk_events``
    (event_id, ts, rule_name).
    """
    spark, seen = windows.sparkSession, F.coalesce("o", "r")
    rows, rows_at = staged(bound(windows, qualifications, baselines, reports).select(
        *OWN, "qualification_hash", "window_start", "window_end", "baseline_report", *(seen[c].alias(c) for c in ("report_hash", "dataset_version", "dataset_sha256", "split_zone")), *(F.col(f"b.{c}").alias(c) for c in EXECUTION),
        F.col("r.max_drawdown_bps").alias("base_drawdown_bps"), F.col("r.slippage_bps").alias("base_slippage_bps"), F.col("r.lot_size").alias("lot_size"), F.col("r.initial_capital").alias("initial_capital"), F.col("o.sessions").alias("sessions"), provenance_faults().alias("unfit"),
    ), "windows")
    bound_to, fit = [c for c in rows.columns if c not in ("initial_capital", "sessions", "unfit", "lot_size")], rows.filter(F.size("unfit") == 0)
    fit = fit.withColumn("capital", F.coalesce(F.col("initial_capital").cast("double"), F.lit(float("nan"))))
    evidence = {
        "order": (orders, "submit_ts", ["order_id", "status"]), "fill": (fills, "fill_ts", ["fill_id", "price", "quantity", "cost", "slippage"]),
        "risk": (risk_events, "ts", ["event_id", "rule_name"]), "position": (positions, "ts", ["symbol", "seq", "quantity", "price", "realized_pnl"]),
    }
    found, found_at = staged(runs(fit, evidence), "runs")
    again, again_at = staged(repeated(found), "repeated")

    # from here all is dealt by strategy once, and neither joins nor sums deal it again
    cover = spans(found)
    sums = window_sums(cover, run_sums(found, fit.select("strategy_id", "capital").distinct()), run_ends(found))
    again = cover.join(again.hint("merge"), ["strategy_id", "run"]).groupBy(*OWN, "fault", "id").agg(F.sum("n").alias("n")).filter("n > 1").groupBy(*OWN).agg(F.array_sort(F.collect_set("fault")).alias("again"))
    out = fit.select(*bound_to, "lot_size").repartition("strategy_id")
    for part in (sums, again, session_metrics(completed_sessions(fit), config.window_sessions, OWN)):
        out = out.join(part.hint("merge"), list(OWN), "left")
    turnover, slip = F.col("value") * F.col("lot_size"), F.greatest(F.lit(0.0), F.col("slippage"))
    bps = lambda x: F.when(turnover > 0, F.round(F.try_divide(x, turnover) * 10000, 4)).otherwise(0.0)
    damaged = named({"fill price": F.col("bad_price") > 0, "fill quantity": F.col("bad_quantity") > 0, "risk event without rule": F.col("unnamed") > 0})
    out = out.select(
        *bound_to, "total_trades", bps(slip).alias("slippage_bps"), bps(F.greatest(F.lit(0.0), F.col("cost")) + slip).alias("cost_bps"), "submitted", "rejected", "risk_events", F.round(F.col("held") * F.col("lot_size"), 4).alias("peak_exposure"),
        "net_pnl", "drawdown_bps", "completed_sessions", "sharpe", "inactive", F.concat(damaged, F.coalesce("again", F.array().cast("array<string>"))).alias("damaged"),
    )
    out = out.withColumn("protocol", F.lit(config.protocol)).withColumn("config_hash", F.lit(config.config_hash))
    out = out.na.fill(0, ["total_trades", "submitted", "rejected", "risk_events", "completed_sessions", "inactive"]).na.fill(0.0, ["slippage_bps", "cost_bps", "net_pnl", "drawdown_bps", "peak_exposure"])
    out = out.withColumn("rejection_rate", F.when(F.col("submitted") > 0, F.col("rejected") / F.col("submitted")))
    with dealt_once(spark):
        judged, _ = staged(out, "snapshots")
    faults = [df.select("window_id", F.explode(c).alias("fault")) for df, c in ((rows, "unfit"), (judged, "damaged"))]
    faults, _ = staged(faults[0].unionByName(faults[1]).distinct(), "faults")
    drop_staged(spark, rows_at, found_at, again_at)

    out = judged.filter(F.size("damaged") == 0).drop("damaged").withColumn("regime_hash", content_digest(REGIME)).withColumn("snapshot_hash", content_digest(SNAPSHOT))
    broken = monitoring.degradations(out.withColumn("key", F.col("snapshot_hash")), expansion=config.expansion, least_sharpe=config.least_sharpe, drift=config.drift, most_rejected=config.most_rejected)
    events = broken.withColumnRenamed("key", "snapshot_hash").join(out.select("snapshot_hash", "strategy_id", "qualification_hash", "base_drawdown_bps", F.col("window_end").alias("at")).hint("merge"), "snapshot_hash")
    details = F.when(F.col("rule") == monitoring.RULES[0], F.to_json(F.struct(F.col("base_drawdown_bps").alias("baseline_max_dd_bps"), F.lit(config.expansion).alias("max_drawdown_expansion_limit")))).otherwise("{}")
    events = events.withColumn("details", details).withColumn("event_hash", content_digest(EVENT)).drop("base_drawdown_bps")
    return Evaluation(out, events, faults)
