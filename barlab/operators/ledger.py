"""Append-only tables: idempotent inserts by key and content hash, conflicts, budgets and
ends of trials, latest states, qualification, holdouts and feedback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns as text; floating-point columns must be rounded text."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)


def conflicts(new: DataFrame, stored: DataFrame, key: list[str], digest: str = "digest") -> DataFrame:
    """New rows whose key is stored with other content."""
    old = stored.select(*key, F.col(digest).alias("_stored"))
    return new.join(old, key).filter(F.col(digest) != F.col("_stored")).drop("_stored")


def insert(new: DataFrame, stored: DataFrame, key: list[str], digest: str = "digest") -> DataFrame:
    """The rows to append: those whose key is not stored. A row whose key is stored with
    other content stops it, and so do two rows of one key with different content."""
    if conflicts(new, stored, key, digest).limit(1).count():
        raise ValueError("a stored key has other content")
    if new.groupBy(*key).agg(F.count_distinct(digest).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("a key comes with different content")
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def tampered(stored: DataFrame, columns: list[str], digest: str = "digest") -> DataFrame:
    """Rows whose content no longer has the recorded digest."""
    return stored.filter(content_digest(columns) != F.col(digest))


def latest(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows equal to all values that are given; None does not restrict."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def between(rows: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """Rows from ``first`` to ``last``, both included; None does not restrict."""
    kind = rows.schema[column].dataType.simpleString()
    edge = lambda x: F.lit(str(x) if kind.startswith(("timestamp", "date")) else x).cast(kind)
    if first is not None:
        rows = rows.filter(F.col(column) >= edge(first))
    return rows if last is None else rows.filter(F.col(column) <= edge(last))


def in_time_order(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """Rows by time, those of one time by a unique column, so that the order is one."""
    return rows.orderBy(F.asc(at), F.asc(tie))


def exists(rows: DataFrame, **wanted) -> bool:
    """Whether a row has all the values; reading ends at the first."""
    return bool(matching(rows, **wanted).limit(1).count())


def usage(trials: DataFrame, by: list[str]) -> DataFrame:
    """Trials, experiments, strategies, and minutes and cost (actual, else estimated)."""
    return trials.groupBy(*by).agg(
        F.count("*").alias("trials"), F.count_distinct("experiment_id").alias("experiments"), F.count_distinct("strategy_id").alias("strategies"),
        F.coalesce(F.sum(F.coalesce("actual_minutes", "estimated_minutes")), F.lit(0.0)).alias("minutes"), F.coalesce(F.sum(F.coalesce("actual_cost", "estimated_cost")), F.lit(0.0)).alias("cost"),
    )


@dataclass(frozen=True)
class Budget:
    trials: int = 10_000
    experiments: int | None = None
    strategies: int | None = None
    minutes: float = 120.0
    cost: float | None = None


class BudgetExceeded(RuntimeError):
    pass


def reserve(trials: DataFrame, budget: Budget, *, experiment_id: str, strategy_id: str, minutes: float, cost: float = 0.0) -> None:
    """Raises when one more trial would go beyond the budget. One driver writes the ledger."""
    u = usage(trials, []).first()
    more = lambda **key: 0 if exists(trials, **key) else 1
    planned = {"trials": u.trials + 1, "experiments": u.experiments + more(experiment_id=experiment_id), "strategies": u.strategies + more(strategy_id=strategy_id), "minutes": u.minutes + minutes, "cost": u.cost + cost}
    over = [k for k, v in planned.items() if getattr(budget, k) is not None and v > getattr(budget, k)]
    if over:
        raise BudgetExceeded(", ".join(over))


# How a trial may end; only the reaper abandons one.
TERMINAL = ("COMPLETED", "REJECTED_NONCAUSAL", "REJECTED_FINAL_HOLDOUT", "FAILED", "ABANDONED")


def complete(trials: DataFrame, ends: DataFrame) -> DataFrame:
    """The trials with ``ends`` (trial_id, status, actual_minutes, actual_cost, completed)
    applied to running ones. An end of a trial that is not running, an unknown status, or a
    negative runtime or cost stops the query."""
    ends = ends.select("trial_id", *(F.col(c).alias(f"_{c}") for c in ("status", "actual_minutes", "actual_cost", "completed")))
    rows = trials.join(ends, "trial_id", "left")
    ended = F.col("_status").isNotNull()
    wrong = ended & ((F.col("status") != "RUNNING") | ~F.col("_status").isin(*TERMINAL[:-1]) | (F.col("_actual_minutes") < 0) | (F.col("_actual_cost") < 0))
    stop = F.raise_error(F.concat(F.lit("no such end of trial "), F.col("trial_id").cast("string"))).cast("string")
    rows = rows.withColumn("_status", F.when(wrong, stop).otherwise(F.col("_status")))
    for c in ("status", "actual_minutes", "actual_cost", "completed"):
        rows = rows.withColumn(c, F.when(ended, F.col(f"_{c}")).otherwise(F.col(c)) if c in trials.columns else F.col(f"_{c}"))
    return rows.select(*trials.columns, *([] if "completed" in trials.columns else ["completed"]))


def stale(trials: DataFrame, now, max_age_minutes: float) -> DataFrame:
    """Ends of the running trials that began ``max_age_minutes`` or longer before ``now``:
    abandoned, at the runtime and cost that were estimated."""
    if max_age_minutes <= 0:
        raise ValueError("the age is over 0 minutes")
    at = F.lit(now).cast("timestamp")
    old = trials.filter((F.col("status") == "RUNNING") & (F.unix_micros(F.col("started").cast("timestamp")) <= F.unix_micros(at) - int(max_age_minutes * 60_000_000)))
    return old.select("trial_id", F.lit("ABANDONED").alias("status"), F.col("estimated_minutes").alias("actual_minutes"), F.col("estimated_cost").alias("actual_cost"), at.alias("completed"))


def eligible(trials: DataFrame, artifacts: DataFrame, files: DataFrame | None = None, returns: DataFrame | None = None) -> DataFrame:
    """Completed production trials whose artifact is registered with the digest that the
    trial names, or that names none; with ``files`` (path, sha256) also found at its path
    with that digest, and with ``returns`` (trial_id, net_return_bps) without any that is
    not finite. Others are left out silently."""
    done = trials.filter("mode = 'PRODUCTION' and status = 'COMPLETED'")
    named = F.get_json_object("result_json", "$.artifact_sha256")
    joined = done.join(artifacts.select("trial_id", F.col("sha256").alias("artifact_sha256"), *(["path"] if files is not None else [])), "trial_id")
    joined = joined.filter(named.isNull() | (named == F.col("artifact_sha256")))
    if files is not None:
        joined = joined.join(files.select("path", F.col("sha256").alias("artifact_sha256")), ["path", "artifact_sha256"], "left_semi")
    if returns is not None:
        r = F.col("net_return_bps")
        joined = joined.join(returns.filter(r.isNull() | F.isnan(r) | (F.abs(r) == float("inf"))).select("trial_id"), "trial_id", "left_anti")
    return joined


def population_hash(trials: DataFrame, by: str = "scope") -> DataFrame:
    """(by, population_hash): SHA-256 of the canonical JSON of each scope's eligible trials,
    sorted by trial_id. A scope is one budgeted run, so its list of three strings a trial is
    short."""
    text = lambda c: F.to_json(F.struct(F.col(c).cast("string").alias("v")))
    quoted = lambda c: F.expr(f"substring(_{c}, 6, length(_{c}) - 6)")  # noqa: E731  the value as JSON writes it
    fields = ("artifact_sha256", "strategy_id", "trial_id")  # JSON keys in order
    rows = trials.select(by, F.col("trial_id").cast("string").alias("_order"), *(text(c).alias(f"_{c}") for c in fields))
    item = F.concat(*(x for i, c in enumerate(fields) for x in (F.lit(("{" if i == 0 else ",") + f'"{c}":'), quoted(c))), F.lit("}"))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_order", item.alias("item")))).alias("items"))
    return lists.select(by, F.sha2(F.concat(F.lit("["), F.array_join("items.item", ","), F.lit("]")), 256).alias("population_hash"))


# States of a candidate's validation, and those that may follow each.
VALIDATION_STEPS = {
    "CANDIDATE": ["UNDERPOWERED", "VALIDATION", "REJECTED", "HOLDOUT_REQUIRED"],
    "UNDERPOWERED": ["CANDIDATE", "REJECTED"],
    "VALIDATION": ["HOLDOUT_REQUIRED", "UNDERPOWERED", "REJECTED"],
    "HOLDOUT_REQUIRED": ["HOLDOUT_PASSED", "REJECTED_FINAL_HOLDOUT", "REJECTED"],
    "HOLDOUT_PASSED": ["PAPER_ELIGIBLE", "REJECTED"],
    "PAPER_ELIGIBLE": [],
    "REJECTED": [],
    "REJECTED_FINAL_HOLDOUT": [],
}


def step_table(spark, steps: dict[str, list[str]] = VALIDATION_STEPS) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in steps.items() for b in bs], "from_state string, to_state string")


def illegal_steps(transitions: DataFrame, steps: DataFrame) -> DataFrame:
    """Transitions that the table does not have, or that are earlier than the one before."""
    w = Window.partitionBy("strategy_id").orderBy("seq")
    marked = transitions.withColumn("_late", F.coalesce(F.col("at") < F.lag("at").over(w), F.lit(False)) | F.coalesce(F.col("from_state") != F.lag("to_state").over(w), F.lit(False)))
    bad = marked.join(steps, ["from_state", "to_state"], "left_anti").withColumn("reason", F.lit("no such step"))
    late = marked.filter("_late").withColumn("reason", F.lit("out of order"))
    return bad.unionByName(late).drop("_late")


def current_state(transitions: DataFrame) -> DataFrame:
    return latest(transitions, ["strategy_id"], [F.desc("at"), F.desc("seq")]).select("strategy_id", F.col("to_state").alias("state"), "at")


def qualification(candidates: DataFrame, least_trades: int = 30, least_observations: int = 30, require_holdout: bool = True) -> DataFrame:
    """Adds the status of a candidate (trades, observations, net_pnl, robustness, holdout):
    a failed holdout goes before a rejection, that before too few observations."""
    rejected = (F.col("net_pnl") <= 0) | (F.col("robustness") == "FAILED") | (F.col("holdout") == "BURNED")
    few = (F.col("trades") < least_trades) | (F.col("observations") < least_observations)
    status = F.when(F.col("holdout") == "FAILED", "REJECTED_FINAL_HOLDOUT").when(rejected, "REJECTED").when(few, "UNDERPOWERED").when(F.col("holdout") == "PASSED", "PAPER_ELIGIBLE")
    if require_holdout:
        status = status.when(F.col("holdout") == "UNTOUCHED", "HOLDOUT_REQUIRED")
    return candidates.withColumn("status", status.otherwise("VALIDATION"))


def holdout_state(candidates: DataFrame, burns: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Adds ``holdout``: a burnt partition goes before what the candidate's own evaluation says."""
    scope = ["dataset", "protocol"]
    rows = candidates.join(burns.select(*scope).distinct().withColumn("_burnt", F.lit(True)), scope, "left")
    rows = rows.join(evaluations.select("strategy_id", *scope, F.col("state").alias("_state")), ["strategy_id", *scope], "left")
    return rows.withColumn("holdout", F.when(F.col("_burnt"), "BURNED").otherwise(F.coalesce("_state", F.lit("UNTOUCHED")))).drop("_burnt", "_state")


def paper_eligibility(records: DataFrame, columns: list[str], digest: str = "record_hash") -> DataFrame:
    """(strategy_id, qualification_id, eligible, reason) of qualification records
    (strategy_id, qualification_id, final_status, holdout_state, and their digest over
    ``columns``): the first condition that a record breaks is its reason."""
    sound = content_digest(columns) == F.col(digest)
    reason = (
        F.when(~F.coalesce(sound, F.lit(False)), "tampered").when(~F.col("final_status").eqNullSafe("PAPER_ELIGIBLE"), F.concat(F.lit("status is "), F.coalesce("final_status", F.lit("null"))))
        .when(~F.col("holdout_state").eqNullSafe("PASSED"), F.concat(F.lit("holdout is "), F.coalesce("holdout_state", F.lit("null")))).otherwise("eligible")
    )
    return records.select("strategy_id", "qualification_id", reason.alias("reason")).withColumn("eligible", F.col("reason") == "eligible")


# The failure mode that a broken rule stands for.
FAILURE_MODES = {
    "RULE_DD_EXPANSION_CRITICAL": "DRAWDOWN_EXPANSION",
    "RULE_SHARPE_COLLAPSE": "SHARPE_COLLAPSE",
    "RULE_SLIPPAGE_ANOMALY": "SLIPPAGE_ANOMALY",
    "RULE_RISK_REJECTION_SPIKE": "RISK_REJECTION_SPIKE",
    "RULE_TRADE_DROPOUT": "TRADE_DROPOUT",
}
FEEDBACK = ["strategy_id", "event_hash", "failure_mode", "realized_sharpe", "drawdown_ratio", "realized_slippage_bps"]


def feedback(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Feedback on degradation events (event_hash, snapshot_hash, strategy_id, rule,
    observed, threshold, details as JSON) from their snapshots (snapshot_hash,
    drawdown_bps, sharpe, slippage_bps). A rule without a failure mode keeps its name. The
    drawdown ratio is the snapshot's drawdown over the baseline's that the details name;
    without that, for an expanded drawdown, the observed value over threshold / limit; else
    1. ``feedback_hash`` is the digest of FEEDBACK."""
    mode = F.col("rule")
    for rule, name in FAILURE_MODES.items():
        mode = F.when(F.col("rule") == rule, name).otherwise(mode)
    base = F.get_json_object("details", "$.baseline_max_dd_bps").cast("double")
    limit = F.coalesce(F.get_json_object("details", "$.max_drawdown_expansion_limit").cast("double"), F.lit(1.0))
    estimate = F.try_divide(F.col("threshold"), limit)
    ratio = F.when(base > 0, F.col("drawdown_bps") / base).when((F.col("rule") == "RULE_DD_EXPANSION_CRITICAL") & (F.col("threshold") > 0) & (estimate > 0), F.try_divide(F.col("observed"), estimate)).otherwise(1.0)
    rows = events.join(snapshots.select("snapshot_hash", "drawdown_bps", F.col("sharpe").alias("realized_sharpe"), F.col("slippage_bps").alias("realized_slippage_bps")), "snapshot_hash")
    rows = rows.select("snapshot_hash", "event_hash", "strategy_id", "rule", mode.alias("failure_mode"), F.round(ratio, 6).alias("drawdown_ratio"), "realized_sharpe", "realized_slippage_bps")
    return rows.withColumn("feedback_hash", content_digest(FEEDBACK))


def research_tasks(records: DataFrame, protocol: str) -> DataFrame:
    """Feedback records with the id of the research task that each one asks for, by its
    hash and the protocol. A record whose content does not have its hash stops the query."""
    if not protocol.strip():
        raise ValueError("the protocol has a name")
    sound = F.when(content_digest(FEEDBACK) == F.col("feedback_hash"), F.col("feedback_hash")).otherwise(F.raise_error(F.lit("damaged feedback")).cast("string"))
    return records.withColumn("task_id", F.concat(F.lit("TASK-RFB-"), F.substring(F.sha2(F.concat_ws(":", sound, F.lit(protocol)), 256), 1, 16)))
