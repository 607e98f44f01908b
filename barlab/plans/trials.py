"""Trials that are recorded as they run: a reservation within a budget, the run, its
artifact and its end, in a ledger of events whose state is derived and never changed."""

from __future__ import annotations

from datetime import datetime, timezone
from time import monotonic

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import content_hash
from barlab.operators import ledger
from barlab.operators.commits import Ledger
from barlab.plans import research

EVENT = "trial_id string, event string, dataset string, protocol string, mode string, strategy_id string, experiment_id string, zone string, status string, minutes double, cost double, artifact_sha256 string, at timestamp, digest string"
CONTENT = [c.split()[0] for c in EVENT.split(", ")][:-1]
STARTED, ENDED = "STARTED", "ENDED"


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Trials:
    """The trials of a ledger at a path. A trial has one start and one end at most; both are
    published as versions, each checked against the version before it, so that writers side
    by side never go beyond a budget together and never end a trial twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Ledger(spark, path, EVENT, ["trial_id", "event"])

    def _row(self, **values) -> DataFrame:
        row = self.spark.createDataFrame([tuple(values.get(c) for c in CONTENT)], EVENT.rpartition(",")[0])
        return row.withColumn("digest", ledger.content_digest(CONTENT))

    def state(self, events: DataFrame | None = None) -> DataFrame:
        """(trial_id, dataset, protocol, mode, strategy_id, experiment_id, zone, status, started,
        completed, estimated_minutes, actual_minutes, estimated_cost, actual_cost,
        artifact_sha256): each trial as its events leave it."""
        e = self.store.read() if events is None else events
        start = e.filter(F.col("event") == STARTED).select("trial_id", "dataset", "protocol", "mode", "strategy_id", "experiment_id", "zone", F.col("at").alias("started"), F.col("minutes").alias("estimated_minutes"), F.col("cost").alias("estimated_cost"))
        end = e.filter(F.col("event") == ENDED).select("trial_id", "status", F.col("at").alias("completed"), F.col("minutes").alias("actual_minutes"), F.col("cost").alias("actual_cost"), "artifact_sha256")
        return start.join(end, "trial_id", "left").withColumn("status", F.coalesce("status", F.lit("RUNNING")))

    def reserve(self, trial_id: str, *, dataset: str, protocol: str, strategy_id: str, zone: str, budget: ledger.Budget, minutes: float, cost: float = 0.0, mode: str = "PRODUCTION", experiment_id: str | None = None, at: datetime | None = None) -> str:
        """Record the start of a trial, unless it goes beyond the budget of its dataset,
        protocol and mode. A trial id is used once. Returns the experiment's id."""
        experiment_id = experiment_id or "EXP-" + content_hash([strategy_id, dataset, protocol, zone])[:24]
        scope = {"dataset": dataset, "protocol": protocol, "mode": mode}

        def check(events: DataFrame) -> None:
            if ledger.exists(events, trial_id=trial_id):
                raise ValueError(f"trial {trial_id} has been started")
            ledger.reserve(ledger.matching(self.state(events), **scope), budget, experiment_id=experiment_id, strategy_id=strategy_id, minutes=minutes, cost=cost)

        self.store.append(self._row(trial_id=trial_id, event=STARTED, strategy_id=strategy_id, experiment_id=experiment_id, zone=zone, minutes=float(minutes), cost=float(cost), at=at or now(), **scope), check=check)
        return experiment_id

    def end(self, trial_id: str, status: str, *, minutes: float, cost: float = 0.0, artifact_sha256: str | None = None, at: datetime | None = None) -> None:
        """Record the end of a running trial."""
        if status not in ledger.TERMINAL[:-1] or minutes < 0 or cost < 0:
            raise ValueError(f"no such end: {status} after {minutes} minutes at {cost}")

        def check(events: DataFrame) -> None:
            mine = {r.event for r in ledger.matching(events, trial_id=trial_id).select("event").collect()}  # two rows at most
            if mine != {STARTED}:
                raise ValueError(f"trial {trial_id} is not running")

        self.store.append(self._row(trial_id=trial_id, event=ENDED, status=status, minutes=float(minutes), cost=float(cost), artifact_sha256=artifact_sha256, at=at or now()), check=check)

    def reap(self, at: datetime, max_age_minutes: float, tries: int = 10) -> int:
        """End the running trials that began that long before, abandoned, at what was estimated
        for them; how many they were. A trial that ends meanwhile keeps its own end."""
        empty = [F.lit(None).cast("string").alias(c) for c in ("dataset", "protocol", "mode", "strategy_id", "experiment_id", "zone")]
        for _ in range(tries):
            ends = ledger.stale(self.state(), at, max_age_minutes)
            rows = ends.select("trial_id", F.lit(ENDED).alias("event"), *empty, "status", F.col("actual_minutes").alias("minutes"), F.col("actual_cost").alias("cost"), F.lit(None).cast("string").alias("artifact_sha256"), F.col("completed").alias("at"))
            try:
                return self.store.append(rows.withColumn("digest", ledger.content_digest(CONTENT)))[1]
            except ValueError:  # one of them has another end by now
                continue
        raise RuntimeError("trials go on ending")

    def budgets(self) -> DataFrame:
        """The usage of every dataset, protocol and mode."""
        return ledger.usage(self.state(), ["dataset", "protocol", "mode"])

    def attempts(self) -> DataFrame:
        """(strategy_id, n, first, status): how often a strategy was tried, when first, and how
        its latest trial stands."""
        s = self.state()
        last = Window.partitionBy("strategy_id").orderBy(F.desc("started"), F.desc("trial_id"))
        newest = s.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("strategy_id", "status")
        return s.groupBy("strategy_id").agg(F.count("*").alias("n"), F.min("started").alias("first")).join(newest, "strategy_id")


def run_recorded(trials: Trials, trial_id: str, bars: DataFrame, spec: research.Spec, manifest: DataFrame, zone: str, *, dataset: str, protocol: str, artifacts: str, budget: ledger.Budget = ledger.Budget(), minutes: float = 1.0, **execution) -> research.Artifact | None:
    """A research trial from its reservation to its end: refused beyond the budget, rejected
    if its signal reads ahead, else backtested, with its returns as the artifact
    ``artifacts``/trial_id. An error ends the trial as FAILED, at the time it took, and is
    raised again. Returns the artifact, or None for a rejected trial."""
    trials.reserve(trial_id, dataset=dataset, protocol=protocol, strategy_id=spec.strategy_id, zone=zone, budget=budget, minutes=minutes)
    began = monotonic()
    took = lambda: (monotonic() - began) / 60
    try:
        trial = research.run_trial(bars, spec, manifest, zone, **execution)
        made = research.write_artifact(trial.trades, f"{artifacts}/{trial_id}", trial_id) if trial.trades is not None else None
    except BaseException:
        trials.end(trial_id, "FAILED", minutes=took())
        raise
    trials.end(trial_id, trial.status, minutes=took(), artifact_sha256=made.sha256 if made else None)
    return made
