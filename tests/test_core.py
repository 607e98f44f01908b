"""Hand-computed goldens and properties of the core operators."""

import math
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.scalars import binomial_lower, binomial_tail, binomial_upper, content_hash, detection_gate, expected_max_sharpe, false_pass_gate, tick_price
from barlab.operators import backtest, ledger, monitoring, readmodels, replay, signals, statistics, synthetic, zones
from barlab.plans.research import Spec, run_trial
from barlab.sources import bars as sources

BAR = sources.BAR


def make(spark, rows):
    start = dt.datetime(2023, 1, 2, 9, 15)
    data = [("A", start + dt.timedelta(days=d, minutes=m), float(o), float(max(o, c) + 1), float(min(o, c) - 1), float(c), int(v), int(i)) for d, m, o, c, v, i in rows]
    return spark.createDataFrame(data, BAR)


def rising(spark, n=10):
    return make(spark, [(0, i, 100 + 2 * i, 100.5 + 2 * i, 1000, 500) for i in range(n)])


def test_gates_and_bounds():
    assert false_pass_gate(4, 200) and not false_pass_gate(5, 200)
    assert detection_gate(87, 100) and not detection_gate(86, 100)
    assert binomial_upper(3, 3) == 1.0 and binomial_lower(0, 5) == 0.0
    with pytest.raises(ValueError):
        binomial_upper(4, 3)
    assert expected_max_sharpe(0.5, 1) == 0.0 < expected_max_sharpe(0.5, 4)


def test_bounds_of_many_runs_take_few_terms(monkeypatch):
    plain = lambda k, n, p: math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    for n, p in ((1, 0.3), (7, 0.5), (60, 0.05), (60, 0.8), (200, 0.999)):
        for k in range(n + 2):
            assert binomial_tail(k, n, p) == pytest.approx(plain(k, n, p), rel=1e-9, abs=1e-300)
    calls = []
    real = math.lgamma
    monkeypatch.setattr(math, "lgamma", lambda x: calls.append(x) or (real(x) if len(calls) < 5_000 else pytest.fail("a call for each term")))
    assert detection_gate(801_000, 1_000_000) and not detection_gate(800_500, 1_000_000) and binomial_upper(50_000, 1_000_000) == pytest.approx(0.05036, abs=1e-5)


def test_tick_and_hash():
    assert tick_price(100.075, 0.05) == 100.1 or tick_price(100.075, 0.05) == 100.05
    assert tick_price(3.3, 0) == 3.3
    assert content_hash({"b": 1, "a": [1.5]}) == content_hash({"a": [1.5], "b": 1})


def test_next_open_backtest(spark):
    t = backtest.trades(signals.momentum(rising(spark), (0.0, 1.0), 10)).orderBy("signal_ts").collect()
    assert len(t) == 9
    assert (t[0].entry_price, t[0].exit_price, t[0].net_pnl) == (102.0, 102.5, 0.5)


def test_costs_by_date(spark):
    s = backtest.cost_schedule(spark, [("2023-01-01", "2023-01-02", 2.0), ("2023-01-03", None, 5.0)])
    b = make(spark, [(d, m, 100, 101, 10, 5) for d in (0, 1) for m in range(3)])
    rows = signals.momentum(b, (0.0, 1.0), 3)
    t = backtest.with_cost(backtest.trades(rows).drop("cost_bps"), "entry_ts", s)
    assert sorted(r.cost_bps for r in t.collect()) == [2.0, 2.0, 5.0, 5.0]
    with pytest.raises(Exception, match="not one period"):
        backtest.trades(rows, schedule=backtest.cost_schedule(spark, [("2023-01-03", None, 5.0)])).collect()


def test_sessions_limit_trades(spark):
    b = make(spark, [(d, m, 100, 101, 10, 5) for d in (0, 1) for m in range(3)])
    rows = signals.momentum(b, (0.0, 1.0), 3)
    assert backtest.trades(rows).count() == 4
    assert backtest.trades(rows, same_session=False).count() == 5
    with pytest.raises(ValueError):
        backtest.trades(rows, model="other")


def test_canary_is_seen_by_same_close_only(spark):
    b = synthetic.generate(spark, [7], sessions=8, bars=60)
    sig = signals.momentum(b, session_bars=60)
    shifted = synthetic.gap_canary(sig, 25.0)
    mean = lambda d, m: backtest.totals(backtest.trades(d, model=m), []).first().mean_gross_bps
    assert abs(mean(shifted, backtest.NEXT_OPEN) - mean(sig, backtest.NEXT_OPEN)) < 0.05
    assert mean(shifted, backtest.SAME_CLOSE) - mean(sig, backtest.SAME_CLOSE) > 20


def test_planted_edge_is_recovered(spark):
    sig = signals.momentum(synthetic.generate(spark, [3], sessions=6, bars=50), session_bars=50)
    mean = lambda d: backtest.totals(backtest.trades(d), []).first().mean_gross_bps
    assert abs(mean(synthetic.planted_edge(sig, 10.0, 2.0)) - mean(sig) - 12.0) < 0.1


def test_nulls_keep_sizes(spark):
    b = synthetic.generate(spark, [5], sessions=6, bars=20)
    size = lambda d: synthetic.components(d).agg(F.sum(F.abs("intrabar"))).first()[0]
    assert size(synthetic.directional_null(b)) == pytest.approx(size(b), rel=1e-9)
    boot = synthetic.block_bootstrap(b, 2)
    assert boot.count() == b.count() and sorted(boot.columns) == sorted(b.columns)
    assert synthetic.directional_null(b).select("ts", "close").exceptAll(synthetic.directional_null(b.repartition(3)).select("ts", "close")).count() == 0


def test_signals_are_causal(spark):
    b = synthetic.generate(spark, [1], sessions=3, bars=20)
    for f in signals.SIGNALS.values():
        assert signals.causality_breaks(b, lambda d, f=f: f(d, session_bars=20), signals.cut_points(60)).count() == 0

    def peeks(d):
        from pyspark.sql import Window

        return signals.with_slots(d).withColumn("signal", F.signum(F.lead("close").over(Window.partitionBy("contract").orderBy("ts")) - F.col("close")).cast("int")).fillna(0, ["signal"])

    assert signals.causality_breaks(b, peeks, [10]).count() > 0


def test_spec_is_strict():
    assert Spec("current_bar_momentum", 60).strategy_id.startswith("STRAT-")
    for bad in ("60", 60.0, True, 1):
        with pytest.raises(ValueError):
            Spec("current_bar_momentum", bad)
    with pytest.raises(ValueError):
        Spec("other", 60)
    with pytest.raises(ValueError):
        Spec("current_bar_momentum", 60, (0.9, 0.1))


def test_split_manifest(spark):
    b = make(spark, [(0, i, 100, 101, 1, 1) for i in range(100)])
    gaps = zones.Gaps(2, 2, 2, 0, 3)
    found = {n: (a, z) for n, a, z in zones.zone_indices(100, gaps)}
    assert [found[k][1] - found[k][0] for k in ("validation_purge", "validation_embargo", "holdout_purge", "holdout_embargo")] == [6, 3, 6, 3]
    m = zones.split_manifest(b, gaps)
    assert zones.load_zone(b, m, "research").count() == found["research"][1]
    with pytest.raises(PermissionError):
        zones.load_zone(b, m, "holdout")
    with pytest.raises(ValueError):
        zones.zone_indices(19, gaps)
    trial = run_trial(b, Spec("current_bar_momentum", 100), m, "research")
    assert trial.status == "COMPLETED" and trial.trades.count() > 0


def test_monitoring_goldens(spark):
    rows = lambda v: spark.createDataFrame([("a", i, float(x), 1) for i, x in enumerate(v)], "contract string, session int, net_pnl double, trades int")
    last = lambda d, c: d.orderBy(F.desc("session")).first()[c]
    assert last(monitoring.rolling_pnl(rows([10, 20, 30, 40, 50]), 3), "rolling_pnl") == 120
    assert [r.ret for r in monitoring.session_returns(rows([5000, -2100]), 100000).orderBy("session").collect()] == [0.05, -0.02]
    with pytest.raises(Exception, match="insolvent"):
        monitoring.session_returns(rows([-12000, 500]), 10000).collect()
    same = rows([1] * 12).withColumn("ret", F.lit(0.01))
    assert last(monitoring.rolling_sharpe(same), "sharpe") is None
    curve = lambda v: spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "contract string, session int, equity double")
    assert monitoring.drawdown_bps(curve([100000, 95000, 110000, 99000])).first().drawdown_bps == 1000
    assert monitoring.drawdown_bps(curve([100000, 0, -1000])).first().drawdown_bps == 10000
    q = monitoring.trade_quality(rows([100, 50, 0, -20, -80])).first()
    assert q.win_rate == 0.4
    assert monitoring.trade_quality(rows([100, 200, -50, -50, 300])).first().expectancy == 100
    assert monitoring.trade_quality(rows([1, 2])).first().win_rate is None
    idle = rows([1, 1, 1, 1]).withColumn("trades", F.when(F.col("session") == 1, 2).otherwise(0))
    assert monitoring.inactive_sessions(idle).first().inactive == 2
    f = spark.createDataFrame([("s", 18000.0, 2, 18.0, 9.0), ("s", 18050.0, 2, 18.05, 9.025)], "k string, price double, quantity int, cost double, slippage double")
    r = monitoring.fill_costs(f, "k", 50).first()
    assert round(r.cost_bps, 2) == 0.15 and round(r.slippage_bps, 2) == 0.05
    one = spark.range(1)
    assert one.select(monitoring.frequency_ratio(F.lit(30.0), F.lit(15), F.lit(200.0), F.lit(200.0))).first()[0] == 2.0
    assert one.select(monitoring.drawdown_ratio(F.lit(1200.0), F.lit(800.0), F.lit(5)), monitoring.drawdown_ratio(F.lit(50.0), F.lit(0.0), F.lit(5))).first() == (1.5, 50.0)


def test_degradations_are_strict(spark):
    cols = "key string, drawdown_bps double, base_drawdown_bps double, sharpe double, slippage_bps double, base_slippage_bps double, rejection_rate double, submitted int, inactive int"
    at = spark.createDataFrame([("a", 150.0, 100.0, 0.0, 2.0, 1.0, 0.2, 10, 29)], cols)
    assert monitoring.degradations(at).count() == 0
    over = spark.createDataFrame([("a", 150.1, 100.0, -0.1, 2.1, 1.0, 0.3, 10, 30), ("b", 0.0, 1.0, None, 0.0, 0.0, 1.0, 9, 0)], cols)
    assert sorted(r.rule for r in monitoring.degradations(over).collect()) == list(monitoring.RULES)


def test_clusters(spark):
    rng = np.random.default_rng(101)
    base = {"A": rng.normal(size=120), "B": rng.normal(size=120)}
    series = {f"A{i}": base["A"] + rng.normal(scale=0.1, size=120) for i in (1, 2, 3)} | {f"B{i}": base["B"] + rng.normal(scale=0.1, size=120) for i in (1, 2)}
    series |= {f"S{i}": rng.normal(size=40) for i in (1, 2)}
    t0 = dt.datetime(2023, 1, 3)
    rows = [("x", k, t0 + dt.timedelta(hours=h), float(v)) for k, s in series.items() for h, v in enumerate(s)]
    r = spark.createDataFrame(rows, "scope string, trial_id string, signal_ts timestamp_ntz, net_return_bps double")
    pairs = statistics.aligned_pairs(r)
    assert {x.trial_id for x in statistics.singletons(r, pairs).collect()} == {"S1", "S2"}
    c = {x.trial_id: x.cluster for x in statistics.clusters(r, pairs).collect()}
    assert len(set(c.values())) == 4 and len({c["A1"], c["A2"], c["A3"]}) == 1 and c["B1"] == c["B2"]
    d = statistics.deflated_sharpe(statistics.return_moments(r), statistics.clusters(r, pairs)).collect()
    assert all(0 <= x.dsr <= 1 and x.effective == 4 for x in d)


def test_moments_of_flat_and_short(spark):
    r = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("c", 1.0), ("c", 2.0)], "trial_id string, net_return_bps double")
    m = {x.trial_id: x for x in statistics.return_moments(r).collect()}
    assert m["a"].sharpe == m["b"].sharpe == 0 and m["b"].std == 0 and m["c"].skewness == 0 and m["c"].sharpe > 0


def test_replay_and_risk(spark):
    sig = signals.momentum(rising(spark), (0.0, 1.0), 10)
    e = replay.replay(sig)
    trades = e.filter("kind = 'trade'").orderBy("ts").collect()
    assert len(trades) == 4 and trades[0].net_pnl == 2.0
    kinds = lambda risk: {(r.kind, r.rule) for r in replay.replay(sig, replay.Settings(risk=risk)).collect()}
    assert kinds(replay.Risk(kill_switch=True)) == {("rejected", "kill_switch")}
    assert ("rejected", "max_order_quantity") in kinds(replay.Risk(max_order=0))
    assert ("rejected", "max_position") in kinds(replay.Risk(max_position=0))
    assert ("rejected", "max_exposure") in kinds(replay.Risk(max_exposure=1.0))
    assert ("rejected", "max_trades_per_session") in kinds(replay.Risk(max_session_orders=2))
    assert replay.replay(sig, replay.Settings(entries=False)).count() == 0


def test_replay_stream_equals_batch(spark, tmp_path):
    """Also when the query is started anew from its checkpoint after every session."""
    from barlab.streaming.bars import replay_stream, typed_state

    b = synthetic.generate(spark, [1, 2], sessions=3, bars=12)
    sig = signals.momentum(b, session_bars=12).select("contract", "ts", "session", "open", "close", "signal")
    want = {tuple(r) for r in replay.replay(sig).filter("kind = 'trade'").select("contract", "ts", "side", "net_pnl").collect()}
    days = [r.session for r in sig.select("session").distinct().orderBy("session").collect()]
    for way in ("once", "again"):
        at = f"{tmp_path}/{way}"
        for i, day in enumerate(days):
            sig.filter(F.col("session") == day).coalesce(1).write.mode("append").parquet(f"{at}/in")
            if way == "once" and i + 1 < len(days):
                continue
            stream = spark.readStream.schema(sig.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/in")
            with typed_state(spark):
                q = replay_stream(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
            q.awaitTermination(120)
        got = [tuple(r) for r in spark.read.parquet(f"{at}/out").filter("kind = 'trade'").select("contract", "ts", "side", "net_pnl").collect()]
        assert set(got) == want and len(got) == len(want) and want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None or "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_violations(spark):
    t = dt.datetime(2023, 1, 2, 9, 15)
    rows = [("A", t, 1.0, 2.0, 0.5, 1.5, 1, 1, 1), ("A", t, 1.0, 0.9, 0.5, 1.5, 1, 1, 2), ("A", t - dt.timedelta(minutes=1), -1.0, 2.0, -1.0, float("nan"), 1, 1, 3), ("A", None, None, 2.0, 0.5, 1.5, -1, 1, 4)]
    found = {r.rule: r.n for r in sources.violations(spark.createDataFrame(rows, BAR + ", seq int")).collect()}
    assert found == {"high_low": 2, "duplicate_ts": 1, "out_of_order": 1, "not_positive": 1, "not_finite": 1, "null": 1, "negative_volume": 1} or found["duplicate_ts"] == found["out_of_order"] == 1


def test_sources(spark, tmp_path):
    rising(spark).drop("open_interest").coalesce(1).write.parquet(f"{tmp_path}/p")
    assert {r.open_interest for r in sources.read_parquet(spark, f"{tmp_path}/p").collect()} == {0}
    rising(spark).coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    assert sources.read_csv(spark, f"{tmp_path}/c").count() == 10
    sha = sources.file_digests(spark, f"{tmp_path}/p/part-*").first().sha256
    assert len(sha) == 64
    with pytest.raises(ValueError):
        sources.verified(spark, f"{tmp_path}/p/part-*", "0" * 64)


def test_ledger(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn("digest", ledger.content_digest(["k", "v"]))
    assert ledger.insert(rows, rows, ["k"]).count() == 0
    other = spark.createDataFrame([(1, "x")], "k int, v string").withColumn("digest", ledger.content_digest(["k", "v"]))
    with pytest.raises(ValueError):
        ledger.insert(other, rows, ["k"])
    assert ledger.tampered(rows.withColumn("v", F.lit("z")), ["k", "v"]).count() == 2
    trials = spark.createDataFrame([(1, "e", "s", None, 50.0, None, 1.0)], "trial_id int, experiment_id string, strategy_id string, actual_minutes double, estimated_minutes double, actual_cost double, estimated_cost double")
    ledger.reserve(trials, ledger.Budget(), experiment_id="e", strategy_id="s", minutes=70)
    with pytest.raises(ledger.BudgetExceeded):
        ledger.reserve(trials, ledger.Budget(), experiment_id="e", strategy_id="s", minutes=71)
    with pytest.raises(ledger.BudgetExceeded):
        ledger.reserve(trials, ledger.Budget(experiments=1), experiment_id="f", strategy_id="s", minutes=1)
    ledger.reserve(trials.limit(0), ledger.Budget(), experiment_id="e", strategy_id="s", minutes=1)
    t = spark.createDataFrame([("s", 1, 1, "CANDIDATE", "VALIDATION"), ("s", 2, 2, "VALIDATION", "PAPER_ELIGIBLE")], "strategy_id string, seq int, at int, from_state string, to_state string")
    assert ledger.illegal_steps(t, ledger.step_table(spark)).count() == 1
    assert ledger.current_state(t).first().state == "PAPER_ELIGIBLE"


def test_eligible(spark):
    t = spark.createDataFrame([(1, "PRODUCTION", "COMPLETED", '{"artifact_sha256":"x"}'), (2, "PRODUCTION", "COMPLETED", '{"artifact_sha256":"y"}'), (3, "FIXTURE", "COMPLETED", "{}"), (4, "PRODUCTION", "COMPLETED", None)], "trial_id int, mode string, status string, result_json string")
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x")], "trial_id int, sha256 string")
    assert sorted(r.trial_id for r in ledger.eligible(t, a).collect()) == [1, 4]


def test_read_models(spark):
    rows = spark.createDataFrame([("O",), ("O",)], "s string")
    assert {r.s: r.n for r in readmodels.zero_filled(spark, rows, "s", ["O", "F"]).collect()} == {"O": 2, "F": 0}
    a = spark.createDataFrame([("1", "s1")], "i string, s string")
    b = spark.createDataFrame([("1", "s2"), ("2", "s3")], "i string, s string")
    assert {(r.identifier, r.strategy_id) for r in readmodels.resolve([(a, "i", "s"), (b, "i", "s")]).collect()} == {("1", "s1"), ("2", "s3")}
