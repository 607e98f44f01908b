"""Research runs: a strategy specification through validation, zone, budget, causality,
backtest and ledger, and the gates that follow. Thin driver code over lazy plans."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barlab.functions.scalars import content_hash
from barlab.operators import backtest, ledger, signals, statistics, synthetic, zones
from barlab.sources.files import dataset_digest


@dataclass(frozen=True)
class Spec:
    """A strategy: one of the known signals with its parameters."""

    signal: str
    session_bars: int
    window: tuple[float, float] = (0.1, 0.9)

    def __post_init__(self):
        if self.signal not in signals.SIGNALS:
            raise ValueError(f"unknown signal: {self.signal}")
        if type(self.session_bars) is not int or self.session_bars <= 1:
            raise ValueError("session_bars is a whole number over 1")
        if len(self.window) != 2 or not all(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) for x in self.window) or not 0 <= self.window[0] < self.window[1] <= 1:
            raise ValueError("window is 0 <= start < end <= 1")

    @property
    def strategy_id(self) -> str:
        return "STRAT-" + content_hash({"signal": self.signal, "session_bars": self.session_bars, "window": list(map(float, self.window))})[:24]

    def compile(self, bars: DataFrame) -> DataFrame:
        return signals.SIGNALS[self.signal](bars, self.window, self.session_bars)


@dataclass
class Trial:
    status: str
    strategy_id: str
    trades: DataFrame | None = None
    mode: str = "PRODUCTION"


def run_trial(bars: DataFrame, spec: Spec, manifest: DataFrame, zone: str, *, trials: DataFrame | None = None, budget: ledger.Budget | None = None, minutes: float = 1.0, **execution) -> Trial:
    """Backtest a specification on a zone: refused beyond the budget or on the holdout, and
    not run if the signal at any bar depends on later ones."""
    return _run(zones.load_zone(bars, manifest, zone), spec.compile, spec.strategy_id, zone, trials, budget, minutes, **execution)


def run_fixture(bars: DataFrame, signal, name: str, *, trials: DataFrame | None = None, budget: ledger.Budget | None = None, minutes: float = 1.0, **execution) -> Trial:
    """Backtest any signal function of bars, or the name of a column that has the signal; a
    fixture never counts as production."""
    if isinstance(signal, str):
        column, signal = signal, lambda rows: signals.with_slots(rows).withColumn("signal", F.signum(column).cast("int"))
    trial = _run(bars, signal, f"FIXTURE-{name}", "fixture", trials, budget, minutes, **execution)
    trial.mode = "FIXTURE"
    return trial


def _run(rows: DataFrame, signal, strategy_id: str, zone: str, trials, budget, minutes: float, **execution) -> Trial:
    if trials is not None and budget is not None:
        ledger.reserve(trials, budget, experiment_id=content_hash([strategy_id, zone])[:24], strategy_id=strategy_id, minutes=minutes)
    longest = rows.groupBy("contract").count().agg(F.max("count")).first()[0] or 0
    if longest >= 2 and signals.causality_breaks(rows, signal, signals.cut_points(longest)).limit(1).count():
        return Trial("REJECTED_NONCAUSAL", strategy_id)
    return Trial("COMPLETED", strategy_id, backtest.trades(signal(rows), **execution))


def end_of(trial: Trial, trial_id: str, minutes: float, cost: float = 0.0) -> DataFrame | None:
    """The ledger's row (trial_id, status, actual_minutes, actual_cost, completed) of a trial
    that has ended, for ledger.complete."""
    if trial.trades is None:
        return None
    return trial.trades.sparkSession.createDataFrame([(trial_id, trial.status, float(minutes), float(cost))], "trial_id string, status string, actual_minutes double, actual_cost double").withColumn("completed", F.current_timestamp())


def passes(totals: DataFrame) -> DataFrame:
    """The default pass criterion: a net result over 0 from one trade or more."""
    return totals.withColumn("passed", (F.col("net_pnl") > 0) & (F.col("trades") >= 1))


#: What Spark's errors say when machines, not the plan, have failed.
CLUSTER_FAILED = ("ExecutorLostFailure", "FetchFailed", "MetadataFetchFailed", "SparkContext was shut down", "stopped SparkContext", "has been cancelled", "Connection refused", "OutOfMemoryError")


def final_evaluation(bars: DataFrame, spec: Spec, manifest: DataFrame, *, dataset: str, protocol: str, trials: DataFrame, burns: DataFrame, evaluations: DataFrame, budget: ledger.Budget = ledger.Budget(), criterion=passes, minutes: float = 0.01, **execution) -> DataFrame:
    """The one look at the holdout that a candidate has: (strategy_id, dataset, protocol,
    state, status, trades, net_pnl), to append to ``evaluations``. Refused when the holdout
    is burnt, the candidate was evaluated before, or no trial of it in research or validation
    is completed. A signal that reads ahead, and any error, fail the candidate."""
    spark, me = bars.sparkSession, {"dataset": dataset, "protocol": protocol}
    if ledger.exists(burns, **me):
        raise PermissionError("the holdout is burnt")
    if ledger.exists(evaluations, strategy_id=spec.strategy_id, **me):
        raise PermissionError("the candidate has been evaluated on this holdout")
    before = ledger.matching(trials, strategy_id=spec.strategy_id, status="COMPLETED", **me).filter(F.upper("zone").isin("RESEARCH", "VALIDATION"))
    if not before.limit(1).count():
        raise PermissionError("the candidate has passed no earlier gate")
    rows = zones.load_zone(bars, manifest, "holdout", allow_holdout=True)
    state, status, n, net = "FAILED", "FAILED", 0, 0.0
    try:
        trial = _run(rows, spec.compile, spec.strategy_id, "holdout", trials, budget, minutes, **execution)
        status = trial.status
        if trial.trades is not None:
            r = criterion(backtest.totals(trial.trades, [])).first()
            state, status, n, net = ("PASSED", "COMPLETED", r.trades, r.net_pnl) if r.passed else ("FAILED", "REJECTED_FINAL_HOLDOUT", r.trades, r.net_pnl)
    except ledger.BudgetExceeded:
        raise
    except Exception as e:  # a candidate that cannot be evaluated has had its look, one whose cluster failed has not
        if isinstance(e, Py4JError | PySparkException) and any(sign in str(e) for sign in CLUSTER_FAILED):
            raise
        status = "FAILED"
    return spark.createDataFrame([(spec.strategy_id, dataset, protocol, state, status, n, net)], "strategy_id string, dataset string, protocol string, state string, status string, trades bigint, net_pnl double")


ARTIFACT = "signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, side tinyint, gross_return_bps double, cost_bps double, net_return_bps double, trial_id string"


@dataclass(frozen=True)
class Artifact:
    """What is known of a trial's returns once they are written."""

    trial_id: str
    path: str
    sha256: str
    rows: int
    first_signal: datetime | None
    last_exit: datetime | None

    def row(self, spark: SparkSession) -> DataFrame:
        """The artifact as a row of the registry, with its digest as content."""
        rows = spark.createDataFrame([(self.trial_id, self.path, self.sha256, self.rows, self.first_signal, self.last_exit)], "trial_id string, path string, sha256 string, rows bigint, first_signal timestamp_ntz, last_exit timestamp_ntz")
        return rows.withColumn("digest", ledger.content_digest(rows.columns))


def write_artifact(trades: DataFrame, path: str, trial_id: str) -> Artifact:
    """The returns of a trial, once: an existing artifact is not overwritten. Rows and times
    are observed while the rows are written, and the digest is that of the files written, so
    the trades are computed once and the files read once."""
    out = trades.select(F.lit(trial_id).alias("trial_id"), "signal_ts", "entry_ts", "exit_ts", F.col("side").cast("tinyint").alias("side"), F.col("gross_bps").alias("gross_return_bps"), "cost_bps", F.col("net_bps").alias("net_return_bps"))
    seen = Observation(f"artifact-{trial_id}")
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("signal_ts").alias("first_signal"), F.max("exit_ts").alias("last_exit"))
    out.write.mode("errorifexists").partitionBy("trial_id").parquet(path)
    found = seen.get
    return Artifact(trial_id, path, dataset_digest(trades.sparkSession, path), found["rows"], found["first_signal"], found["last_exit"])


def read_artifact(spark: SparkSession, path: str, trial_id: str | None = None) -> DataFrame:
    """The returns of an artifact in its fixed schema; of one trial, only that partition."""
    rows = spark.read.schema(ARTIFACT).parquet(path)
    return rows if trial_id is None else rows.filter(F.col("trial_id") == trial_id)


def read_verified(spark: SparkSession, artifact: Artifact) -> DataFrame:
    """The returns of an artifact whose files are still what was written: a file that is
    missing, changed or new is refused."""
    where = spark._jvm.org.apache.hadoop.fs.Path(artifact.path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(artifact.path)
    if dataset_digest(spark, artifact.path) != artifact.sha256:
        raise ValueError(f"the files of {artifact.path} do not have the digest of trial {artifact.trial_id}")
    return read_artifact(spark, artifact.path)


def qualify(returns: DataFrame, candidates: DataFrame, least_common: int = 100, **limits) -> DataFrame:
    """Each candidate's deflated Sharpe ratio within its scope and its status. ``returns`` is
    (scope, trial_id, signal_ts, net_return_bps) of the population, ``candidates`` what
    ledger.qualification reads, without observations."""
    members = statistics.clusters(returns, statistics.aligned_pairs(returns, least_common))
    deflated = statistics.deflated_sharpe(statistics.return_moments(returns), members)
    rows = candidates.join(deflated.select("trial_id", F.col("n").alias("observations"), "dsr", "passes", "effective"), "trial_id")
    return ledger.qualification(rows, **limits)


def null_runs(spark: SparkSession, seeds: list[int], level: float = 1.645) -> DataFrame:
    """(contract, t, passes): a strategy's mean net return on directionless bars, each seed a
    contract; a run passes when its t value is over ``level``."""
    bars = synthetic.directional_null(synthetic.generate(spark, seeds))
    made = backtest.trades(signals.momentum(bars, session_bars=60))
    t = F.try_divide(F.avg("net_bps") * F.sqrt(F.count("*")), F.stddev_samp("net_bps"))
    return made.groupBy("contract").agg(t.alias("t")).withColumn("passes", F.coalesce(F.col("t") > level, F.lit(False)))


def acquisition(bars: DataFrame, signal, *, nulls: int = 200, controls: int = 100, edge_bps: float = 10.0, cost_bps: float = 2.0, level: float = 2.576) -> DataFrame:
    """(kind, runs, passes, ok): whether a signal of volumes finds what is there and nothing
    else. ``nulls`` copies of the bars lose their direction, ``controls`` copies do too and
    then have an edge planted behind the signal; a copy passes when the t value of its net
    returns, over all contracts, is above ``level``. ``ok`` is the verdict of the exact gate
    on the counted passes. Copies are rows under their own contract names, so all runs are
    one plan that grows with bars and runs."""
    plain = bars.select("contract", "ts", "open", "high", "low", "close", "volume", "open_interest")
    copies = lambda n, kind: plain.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("contract", F.concat_ws("#", "contract", F.lit(kind), "run")).drop("run")
    edged = synthetic.planted_edge(signal(synthetic.directional_null(copies(controls, "control"))), edge_bps, cost_bps).select(plain.columns)
    both = synthetic.directional_null(copies(nulls, "null")).select(plain.columns).unionByName(edged)
    schedule = backtest.cost_schedule(bars.sparkSession, [("0001-01-01", None, cost_bps)])
    made = backtest.trades(signal(both), schedule=schedule).withColumn("kind", F.element_at(F.split("contract", "#"), -2)).withColumn("run", F.element_at(F.split("contract", "#"), -1))
    t = F.try_divide(F.avg("net_bps") * F.sqrt(F.count("*")), F.stddev_samp("net_bps"))
    passed = made.groupBy("kind", "run").agg(F.coalesce(t > level, F.lit(False)).alias("passed"))
    counted = passed.groupBy("kind").agg(F.count_if("passed").alias("passes"))
    counted = counted.withColumn("runs", F.when(F.col("kind") == "null", nulls).otherwise(controls).cast("bigint"))
    ok = F.when(F.col("kind") == "null", statistics.false_pass("passes", "runs")).otherwise(statistics.detection("passes", "runs"))
    return counted.select("kind", "runs", "passes", ok.alias("ok"))
