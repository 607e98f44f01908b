"""Window evaluation, governance, holdouts, clusters and ledgers beyond what SQL holds them to."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import backtest, commits, evaluation, governance, ledger, monitoring, staging, statistics, zones
from barlab.operators.graph import components
from barlab.plans import research
from barlab.sources import bars as sources
from barlab.streaming import bars as streaming


def test_future_and_older_sessions(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    s = spark.createDataFrame([([(t(1), t(2))], t(3), t(5)), ([(t(1), t(6))], t(3), t(5)), ([(t(4), t(5))], t(3), t(5)), ([], t(3), t(5))], "s array<struct<start_ts:timestamp_ntz,end_ts:timestamp_ntz>>, a timestamp_ntz, b timestamp_ntz")
    rows = s.select(evaluation.future_sessions(F.col("s"), F.col("b")).alias("f"), evaluation.only_older_sessions(F.col("s"), F.col("a")).alias("o")).collect()
    assert [(r.f, r.o) for r in rows] == [(False, True), (True, False), (False, False), (False, False)]


def test_session_metrics_need_ten_and_solvency(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(w, 100.0, f"s{i:02}", t0 + dt.timedelta(days=i), t0 + dt.timedelta(days=i, hours=1), int(i < 8), pnl(i)) for w, n, pnl in (("few", 9, lambda i: 1.0 + i), ("ten", 12, lambda i: 1.0 + i % 3), ("flat", 12, lambda i: 0.0), ("broke", 12, lambda i: -30.0 - i)) for i in range(n)]
    df = spark.createDataFrame(rows, "window_id string, capital double, session_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, trades int, net_pnl double")
    got = {r.window_id: r for r in evaluation.session_metrics(df, 10).collect()}
    assert got["few"].sharpe is None and got["flat"].sharpe is None and got["broke"].sharpe is None and got["ten"].inactive == 4
    equity, returns = 100.0, []
    for i in range(12):
        returns.append(round((1.0 + i % 3) / equity, 8))
        equity += 1.0 + i % 3
    last = np.array(returns[-10:])
    assert got["ten"].sharpe == pytest.approx(last.mean() / last.std(ddof=1) * 252**0.5, abs=1e-3)


def test_conflicts_inside_a_batch(spark):
    stored = spark.createDataFrame([], "k int, digest string")
    with pytest.raises(ValueError, match="different content"):
        ledger.insert(spark.createDataFrame([(1, "a"), (1, "b")], "k int, digest string"), stored, ["k"])
    assert ledger.insert(spark.createDataFrame([(1, "a"), (1, "a")], "k int, digest string"), stored, ["k"]).count() == 1


def test_ends_of_trials(spark):
    trials = spark.createDataFrame([(1, "RUNNING", None, None), (2, "COMPLETED", 1.0, 0.0)], "trial_id int, status string, actual_minutes double, actual_cost double")
    end = lambda *r: spark.createDataFrame([(*r, None)], "trial_id int, status string, actual_minutes double, actual_cost double, completed timestamp")
    assert {r.trial_id: r.status for r in ledger.complete(trials, end(1, "FAILED", 2.0, 0.0)).collect()} == {1: "FAILED", 2: "COMPLETED"}
    for wrong in ((2, "FAILED", 1.0, 0.0), (1, "ABANDONED", 1.0, 0.0), (1, "DONE", 1.0, 0.0), (1, "FAILED", -1.0, 0.0)):
        with pytest.raises(Exception, match="no such end"):
            ledger.complete(trials, end(*wrong)).collect()
    with pytest.raises(ValueError):
        ledger.stale(trials, "2024-01-01", 0)


def test_feedback_follows_the_event(spark):
    """Golden cases: the details' baseline goes first, then threshold over limit, else 1."""
    events = spark.createDataFrame([("e1", "s1", "a", "RULE_DD_EXPANSION_CRITICAL", 240.0, 150.0, '{"baseline_max_dd_bps": 100.0}'), ("e2", "s1", "a", "RULE_DD_EXPANSION_CRITICAL", 240.0, 150.0, '{"max_drawdown_expansion_limit": 1.5}'), ("e3", "s1", "a", "RULE_TRADE_DROPOUT", 30.0, 30.0, "{}"), ("e4", "s1", "a", "RULE_X", 1.0, 1.0, "not json")], "event_hash string, snapshot_hash string, strategy_id string, rule string, observed double, threshold double, details string")
    snaps = spark.createDataFrame([("s1", 250.0, 0.5, 2.0)], "snapshot_hash string, drawdown_bps double, sharpe double, slippage_bps double")
    got = {r.event_hash: (r.failure_mode, r.drawdown_ratio) for r in ledger.feedback(events, snaps).collect()}
    assert got == {"e1": ("DRAWDOWN_EXPANSION", 2.5), "e2": ("DRAWDOWN_EXPANSION", 2.4), "e3": ("TRADE_DROPOUT", 1.0), "e4": ("RULE_X", 1.0)}
    records = ledger.feedback(events, snaps)
    assert all(r.task_id.startswith("TASK-RFB-") and len(r.task_id) == 25 for r in ledger.research_tasks(records, "RP-1.0").collect())
    with pytest.raises(Exception, match="damaged feedback"):
        ledger.research_tasks(records.withColumn("failure_mode", F.lit("other")), "RP-1.0").collect()
    with pytest.raises(ValueError):
        ledger.research_tasks(records, " ")


def test_lifecycle_tables_are_closed():
    for steps in (governance.LIFECYCLE_STEPS, ledger.VALIDATION_STEPS):
        assert {b for bs in steps.values() for b in bs} <= set(steps)
    assert not governance.LIFECYCLE_STEPS["RETIRED"] and not ledger.VALIDATION_STEPS["PAPER_ELIGIBLE"] and len(governance.LIFECYCLE_STEPS) == 8


def test_open_and_distant_periods(spark):
    rows = spark.createDataFrame([("2024-01-31",), ("2024-02-01",), ("2300-05-05",)], "d string")
    periods = backtest.cost_schedule(spark, [("2023-12-31", "2024-01-31", 2.0), ("2024-02-01", None, 5.0)])
    assert [r.cost_bps for r in backtest.with_cost(rows, "d", periods).orderBy("d").collect()] == [2.0, 5.0, 5.0]
    for wrong in ([("2024-02-01", None, 5.0)], [("2024-01-01", None, 5.0), ("2024-01-01", None, 6.0)]):
        with pytest.raises(Exception, match="not one period"):
            backtest.with_cost(rows, "d", backtest.cost_schedule(spark, wrong)).collect()
    assert backtest.with_cost(rows.limit(0), "d", periods).count() == 0


def test_signals_are_checked(spark):
    good = spark.createDataFrame([("a", dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, h), 1.0, 1.0, s) for h, s in ((1, 1.0), (2, float("nan")), (3, 0.0))], "contract string, session date, ts timestamp_ntz, open double, close double, signal double")
    with pytest.raises(Exception, match="not finite"):
        backtest.trades(good).collect()
    with pytest.raises(ValueError, match="lack close"):
        backtest.trades(good.drop("close"))


def test_clusters_of_components_equal_the_whole(spark):
    """Average linkage by components of close pairs gives the clusters of the whole matrix."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.25, (7, 2)) for c in ((0, 0), (1.2, 0), (5, 5), (5.6, 5.2))] + [rng.uniform(-20, 20, (6, 2))])
    d = np.minimum(np.linalg.norm(x[:, None] - x[None], axis=2), statistics.FAR)
    n = len(x)
    pairs = spark.createDataFrame([(f"t{i:02}", f"t{j:02}", float(d[i, j]), True) for i in range(n) for j in range(i + 1, n)], "trial_a string, trial_b string, dist double, sufficient boolean")
    trials = spark.createDataFrame([(s, f"t{i:02}") for s in ("p", "q") for i in range(n)], "scope string, trial_id string")
    whole = statistics.average_linkage(d)
    got = {(r.scope, r.trial_id): r.cluster for r in statistics.clusters(trials, pairs).collect()}
    for i in range(n):
        for j in range(n):
            assert (got["p", f"t{i:02}"] == got["p", f"t{j:02}"]) == (whole[i] == whole[j])
    assert got["p", "t00"] == got["q", "t00"] == "t00" and len(got) == 2 * n


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a int, b int")
    found, _ = components(edges)
    assert {(r.id, r.component) for r in found.collect()} == {(i, 1) for i in range(2, 41)} | {(101, 100)}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="share"):
        staging.shared_dir(Session)


def bars(spark, n=60):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i, 10, 5) for i in range(n)]
    return spark.createDataFrame(rows, "contract string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, open_interest bigint")


def test_zones_by_name_and_kind(spark):
    b, t = bars(spark), dt.datetime(2024, 1, 2)
    manifest = spark.createDataFrame([("holdout", t, None)], "zone string, start timestamp_ntz, stop timestamp_ntz")
    named = spark.createDataFrame([("EXTRA", None, t), ("VOID", dt.datetime(2030, 1, 1), None)], "zone string, start timestamp_ntz, stop timestamp_ntz")
    assert zones.load_zone(b, manifest, "extra", named=named).count() == 24
    for wrong, error in (({"zone": "none"}, KeyError), ({"zone": "holdout"}, PermissionError), ({"zone": "extra", "allowed_kinds": {"LICENSED"}, "kind": "FIXTURE"}, PermissionError), ({"zone": "void"}, ValueError)):
        with pytest.raises(error):
            zones.load_zone(b, manifest, named=named, **wrong)


def test_registered_feed(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    bars(spark).coalesce(1).write.parquet(path)
    file = sources.file_digests(spark, path).filter("path like '%.parquet'").first()
    row = lambda kind, sha: spark.createDataFrame([("v1", kind, file.path, sha)], "version string, kind string, path string, sha256 string")
    assert sources.registry_feed(spark, row("LICENSED", file.sha256), "v1").count() == 60
    with pytest.raises(KeyError):
        sources.registry_feed(spark, row("LICENSED", file.sha256), "v2")
    with pytest.raises(PermissionError):
        sources.registry_feed(spark, row("FIXTURE", file.sha256), "v1")
    with pytest.raises(PermissionError):
        sources.registry_feed(spark, row("LICENSED", file.sha256), "v1", zone="holdout")
    with pytest.raises(ValueError, match="digest"):
        sources.registry_feed(spark, row("LICENSED", "0" * 64), "v1")
    with pytest.raises(ValueError, match="negative_volume"):
        sources.feed(bars(spark).withColumn("volume", F.lit(-1)))
    with pytest.raises(ValueError, match="lacks close"):
        sources.feed(bars(spark).drop("close"))


def test_dataset_versions_are_immutable(spark):
    new = lambda sha, kind="csv": spark.createDataFrame([("v1", "LICENSED", kind, "/p", sha)], "version string, kind string, format string, path string, sha256 string")
    none = new("a").limit(0)
    assert sources.register(new("a"), none).count() == 1 and sources.register(new("a"), new("a")).count() == 0
    with pytest.raises(ValueError, match="other content"):
        sources.register(new("b"), new("a"))
    with pytest.raises(ValueError, match="formats"):
        sources.register(new("a", "orc"), none)


def test_the_holdout_is_seen_once(spark):
    b, spec, t = bars(spark), research.Spec("current_bar_momentum", 24), dt.datetime(2024, 1, 2)
    manifest = spark.createDataFrame([("holdout", t, None)], "zone string, start timestamp_ntz, stop timestamp_ntz")
    schema = "strategy_id string, dataset string, protocol string, status string, zone string, experiment_id string, actual_minutes double, estimated_minutes double, actual_cost double, estimated_cost double"
    trials = spark.createDataFrame([(spec.strategy_id, "d", "p", "COMPLETED", "validation", "E", None, 1.0, None, 0.0)], schema)
    none = spark.createDataFrame([], "strategy_id string, dataset string, protocol string")
    look = lambda **k: research.final_evaluation(b, spec, manifest, **({"dataset": "d", "protocol": "p", "trials": trials, "burns": none, "evaluations": none} | k))
    first = look()
    r = first.first()
    assert (r.state, r.status) == ("PASSED", "COMPLETED") and r.trades > 0 and r.net_pnl > 0
    failed = look(criterion=lambda totals: totals.withColumn("passed", F.lit(False))).first()
    assert (failed.state, failed.status) == ("FAILED", "REJECTED_FINAL_HOLDOUT")
    for wrong, match in (({"evaluations": first}, "has been evaluated"), ({"burns": spark.createDataFrame([("x", "d", "p")], "strategy_id string, dataset string, protocol string")}, "burnt"), ({"trials": trials.withColumn("zone", F.lit("holdout"))}, "earlier gate")):
        with pytest.raises(PermissionError, match=match):
            look(**wrong)


def test_fixture_trials(spark):
    rows = bars(spark).withColumn("mine", F.lit(1.0))
    trial = research.run_fixture(rows, "mine", "column")
    assert trial.mode == "FIXTURE" and trial.status == "COMPLETED" and trial.trades.count() > 0
    assert research.end_of(trial, "T", 1.0).first().status == "COMPLETED"


def test_rows_are_appended_once(spark, tmp_path):
    source, table, schema = f"{tmp_path}/in", f"{tmp_path}/table", "k int, digest string"
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    for checkpoint in ("one", "two"):  # the second run sees every row again
        streaming.append_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), table, ["k"], f"{tmp_path}/{checkpoint}").awaitTermination(120)
    stored = commits.Ledger(spark, table, schema, ["k"])
    assert sorted(tuple(r) for r in stored.read().collect()) == [(1, "a"), (2, "b"), (3, "c")] and stored.files()[0] == 2


def test_holding_and_limits(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "contract string, bars_held int")
    assert {r.contract: (r.trades, r.mean_bars) for r in monitoring.holding_bars(t).collect()} == {"a": (2, 1.5), "b": (0, None)}
    one = spark.range(1).select(monitoring.limit_utilisation(F.lit(80.0), F.lit(100.0)), monitoring.limit_utilisation(F.lit(-5.0), F.lit(100.0)), monitoring.limit_utilisation(F.lit(5.0), F.lit(0.0))).first()
    assert tuple(one) == (0.8, 0.0, None)
