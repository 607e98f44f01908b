"""Trials that are recorded as they run."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from barlab.operators import commits, ledger, zones
from barlab.plans import research, trials

T0 = dt.datetime(2024, 1, 1)
SCOPE = {"dataset": "d", "protocol": "p", "zone": "research"}


@pytest.fixture
def kept(spark, tmp_path):
    return trials.Trials(spark, f"{tmp_path}/trials")


def test_budgets_hold_for_writers_side_by_side(spark, tmp_path, kept):
    budget, failed, done = ledger.Budget(trials=3), [], []

    def start(i):
        try:
            trials.Trials(spark, f"{tmp_path}/trials").reserve(f"T{i}", strategy_id=f"S{i}", budget=budget, minutes=1.0, **SCOPE)
            done.append(i)
        except ledger.BudgetExceeded as e:
            failed.append(str(e))

    threads = [threading.Thread(target=start, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert len(done) == 3 and failed == ["trials"] * 2 and kept.state().count() == 3


def test_starts_and_ends_are_recorded_once(kept):
    kept.reserve("A", strategy_id="S", budget=ledger.Budget(), minutes=5.0, cost=2.0, at=T0, **SCOPE)
    with pytest.raises(ValueError, match="has been started"):
        kept.reserve("A", strategy_id="S", budget=ledger.Budget(), minutes=5.0, **SCOPE)
    with pytest.raises(ledger.BudgetExceeded, match="minutes"):
        kept.reserve("B", strategy_id="S", budget=ledger.Budget(minutes=6.0), minutes=2.0, **SCOPE)
    for wrong in ({"status": "ABANDONED", "minutes": 1.0}, {"status": "DONE", "minutes": 1.0}, {"status": "FAILED", "minutes": -1.0}):
        with pytest.raises(ValueError, match="no such end"):
            kept.end("A", **wrong)
    kept.end("A", "COMPLETED", minutes=1.5, cost=0.5, artifact_sha256="x")
    for other in ("A", "none"):
        with pytest.raises(ValueError, match="not running"):
            kept.end(other, "FAILED", minutes=1.0)
    r = kept.state().first()
    assert (r.status, r.estimated_minutes, r.actual_minutes, r.actual_cost, r.artifact_sha256, r.mode) == ("COMPLETED", 5.0, 1.5, 0.5, "x", "PRODUCTION")
    kept.reserve("B", strategy_id="S", budget=ledger.Budget(minutes=6.0), minutes=2.0, at=T0 + dt.timedelta(hours=1), **SCOPE)
    kept.reserve("C", strategy_id="S", budget=ledger.Budget(), minutes=2.0, at=T0 + dt.timedelta(hours=9), **SCOPE)
    assert kept.reap(T0 + dt.timedelta(hours=9), 60) == 1 and kept.reap(T0 + dt.timedelta(hours=9), 60) == 0
    assert {r.trial_id: r.status for r in kept.state().collect()} == {"A": "COMPLETED", "B": "ABANDONED", "C": "RUNNING"}
    u = kept.budgets().first()
    assert (u.trials, u.strategies, u.minutes) == (3, 1, 1.5 + 2.0 + 2.0)
    a = kept.attempts().first()
    assert (a.n, a["first"], a.status) == (3, T0, "RUNNING")


def bars(spark, n=60):
    rows = [("a", T0 + dt.timedelta(hours=i), 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i, 10, 5) for i in range(n)]
    return spark.createDataFrame(rows, "contract string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, open_interest bigint")


def test_a_recorded_run(spark, tmp_path, kept):
    manifest = zones.split_manifest(bars(spark), zones.Gaps(1, 1, 1, 0, 0))
    spec = research.Spec("current_bar_momentum", 24)
    run = lambda trial_id, zone="research", **more: trials.run_recorded(kept, trial_id, bars(spark), spec, manifest, zone, dataset="d", protocol="p", artifacts=f"{tmp_path}/artifacts", **more)
    made = run("T1")
    assert made.rows == research.read_verified(spark, made).count() > 0
    r = kept.state().first()
    assert (r.status, r.artifact_sha256, r.strategy_id, r.zone) == ("COMPLETED", made.sha256, spec.strategy_id, "research") and r.actual_minutes > 0
    with pytest.raises(PermissionError):  # the holdout is sealed, and the trial is over
        run("T2", "holdout")
    with pytest.raises(ledger.BudgetExceeded):
        run("T3", budget=ledger.Budget(trials=2))
    assert {r.trial_id: r.status for r in kept.state().collect()} == {"T1": "COMPLETED", "T2": "FAILED"}
    assert ledger.tampered(kept.store.read(), trials.CONTENT).count() == 0


def test_checks_see_the_version_that_is_followed(spark, tmp_path):
    led = commits.Ledger(spark, f"{tmp_path}/l", "k int, digest string", ["k"])
    seen = []
    row = lambda k: spark.createDataFrame([(k, "x")], "k int, digest string")
    led.append(row(1), check=lambda df: seen.append(df.count()))
    led.append(row(2), check=lambda df: seen.append(df.count()))
    with pytest.raises(RuntimeError, match="no more"):
        led.append(row(3), check=lambda df: (_ for _ in ()).throw(RuntimeError("no more")))
    assert seen == [0, 1] and led.read().agg(F.max("k")).first()[0] == 2


def test_acquisition_finds_what_is_planted_and_nothing_else(spark):
    """The gates judge counted runs of given bars: an edge is found, its absence is seen."""
    from barlab.operators import signals, synthetic

    b = synthetic.generate(spark, [1, 2], sessions=12, bars=16)
    signal = lambda rows: signals.volume_tail(rows, quantile=0.7, lookback=3)
    got = {r.kind: r for r in research.acquisition(b, signal, edge_bps=60.0).collect()}
    assert (got["null"].runs, got["null"].ok, got["control"].runs, got["control"].ok) == (200, True, 100, True)
    assert got["null"].passes <= 4 and got["control"].passes >= 87
    without = {r.kind: r for r in research.acquisition(b, signal, edge_bps=-2.0).collect()}
    assert without["control"].ok is False and without["control"].passes < 10
