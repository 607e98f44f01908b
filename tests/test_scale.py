"""Operators that must hold at any size: lookups without actions, windows that overlap,
linkage in rounds, large files, ledgers with commits, closures, long contracts, replays."""

import datetime as dt
import hashlib
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import backtest, commits, evaluation, ordered, readmodels, replay, statistics, zones
from barlab.plans import research
from barlab.sources import files
from barlab.sources.bars import BAR, violations

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def jobs(spark, run):
    """How many jobs a call starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext._jsc.clearJobGroup()
    return len(tracker.getJobIdsForGroup(group))


PERIODS = [("2024-01-01", "2024-01-31", 1.0), ("2024-02-10", "2024-02-10", 2.0), ("2024-03-01", None, 3.0)]


def dated(spark, *days):
    return spark.createDataFrame([(i, None if d is None else dt.date.fromisoformat(d)) for i, d in enumerate(days)], "i int, d date")


def test_periods_are_looked_up_without_an_action(spark):
    rows = dated(spark, "2024-01-01", "2024-01-31", "2024-02-10", "2024-03-01", "2024-03-02", "2031-12-31", "2024-01-15", "2024-01-15")
    schedule = backtest.cost_schedule(spark, PERIODS)
    assert jobs(spark, lambda: backtest.with_cost(rows, "d", schedule)) == 0
    out = backtest.with_cost(rows, "d", schedule)
    assert out.columns == ["i", "d", "cost_bps"] and [r.cost_bps for r in out.orderBy("i").collect()] == [1, 1, 2, 3, 3, 3, 1, 1]
    for gap in ("2023-12-31", "2024-02-01", "2024-02-11", "2024-02-29", None):
        with pytest.raises(Exception, match="not one period"):
            backtest.with_cost(dated(spark, gap), "d", schedule).collect()
    assert backtest.with_cost(dated(spark), "d", schedule).count() == 0
    with pytest.raises(Exception, match="not one period"):
        backtest.with_cost(rows, "d", backtest.cost_schedule(spark, [])).collect()


def test_overlapping_periods_stop_only_their_own_dates(spark):
    schedule = backtest.cost_schedule(spark, [("2024-01-01", "2024-01-20", 1.0), ("2024-01-10", None, 2.0), ("2024-05-01", "2024-04-01", 9.0)])
    assert [r.cost_bps for r in backtest.with_cost(dated(spark, "2024-01-09", "2024-01-21", "2025-05-01"), "d", schedule).orderBy("i").collect()] == [1, 2, 2]
    for day in ("2024-01-10", "2024-01-20"):
        with pytest.raises(Exception, match="not one period"):
            backtest.with_cost(dated(spark, day), "d", schedule).collect()
    twice = backtest.cost_schedule(spark, [("2024-01-01", None, 1.0)] * 2)
    with pytest.raises(Exception, match="not one period"):
        backtest.with_cost(dated(spark, "2024-01-01"), "d", twice).collect()


def test_zones_of_any_number_and_repeated_rows(spark):
    at = lambda d, h=0: T0 + d * DAY + dt.timedelta(hours=h)
    many = [(f"z{i:04}", at(i), at(i + 1, 6)) for i in range(1200)]  # each shares six hours with the next
    rows = spark.createDataFrame([(at(i, 3),) for i in range(1, 1200)], "ts timestamp_ntz")
    z = lambda rows: spark.createDataFrame(rows, "zone string, start timestamp_ntz, stop timestamp_ntz")
    found = zones.overlaps(rows, z(many)).collect()
    assert len(found) == 1199 and {r.n for r in found} == {1}
    rows = spark.createDataFrame([(at(0),)] * 2 + [(at(1),), (at(9),), (at(-9),), (None,)], "ts timestamp_ntz")
    got = {(r.zone_a, r.zone_b): r.n for r in zones.overlaps(rows, z([("a", at(0), at(1)), ("b", None, at(2)), ("c", at(1), None), ("d", None, None)])).collect()}
    assert got == {("a", "b"): 2, ("a", "d"): 2, ("b", "c"): 1, ("b", "d"): 4, ("c", "d"): 2}
    assert zones.overlaps(rows, z([])).count() == 0


def linked(spark, d, scopes=("p",), known=None):
    n = len(d)
    rows = [(f"t{i:03}", f"t{j:03}", float(d[i, j]), True) for i in range(n) for j in range(i + 1, n) if known is None or known[i, j]]
    pairs = spark.createDataFrame(rows, "trial_a string, trial_b string, dist double, sufficient boolean")
    return spark.createDataFrame([(s, f"t{i:03}") for s in scopes for i in range(n)], "scope string, trial_id string"), pairs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linkage_in_rounds_equals_the_plain_one(spark, seed):
    rng = np.random.default_rng(seed)
    n = 40
    x = rng.normal(0, 0.55, (n, 2))
    d = np.minimum(np.linalg.norm(x[:, None] - x[None], axis=2), statistics.FAR)
    known = rng.random((n, n)) < 0.8
    known |= known.T
    plain = statistics.average_linkage(np.where(known, d, statistics.FAR))
    got = {r.trial_id: r.cluster for r in statistics.clusters(*linked(spark, d, known=known)).collect()}
    least = {}
    for i, k in enumerate(plain):
        least.setdefault(k, f"t{i:03}")
    assert got == {f"t{i:03}": least[k] for i, k in enumerate(plain)} and 1 < len(set(plain)) < n


def test_linkage_of_a_long_chain(spark):
    """One component of 20,000 trials: no task has its distances whole."""
    n = 20_000
    rng = np.random.default_rng(8)
    gaps = spark.createDataFrame([(i, float(g)) for i, g in enumerate(rng.uniform(0.1, 0.6, n - 1))], "i int, dist double")
    name = lambda c: F.format_string("t%06d", c)
    pairs = gaps.select(name(F.col("i")).alias("trial_a"), name(F.col("i") + 1).alias("trial_b"), "dist", F.lit(True).alias("sufficient"))
    trials = spark.range(n).select(F.lit("s").alias("scope"), name(F.col("id").cast("int")).alias("trial_id"))
    sizes = statistics.clusters(trials, pairs).groupBy("cluster").count().groupBy("count").count().collect()
    # two neighbours merge; a third is unknown to one of them, and so further than the cut from both
    assert {r["count"] for r in sizes} == {1, 2} or {r[0] for r in sizes} == {1, 2}


def evidence(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    at = [T0 + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 60 * 24 * 60, n)]
    who = [["a", "a", "a", "b"][int(i)] for i in rng.integers(0, 4, n)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    orders = [(f"o{i}", w, t, "REJECTED" if i % 5 == 0 else "FILLED") for i, (w, t) in enumerate(zip(who, at, strict=True))]
    fills = [(f"f{i}", w, t, float(50 + i % 7), 1 + i % 3, 0.5, 0.25) for i, (w, t) in enumerate(zip(who, at, strict=True))]
    positions = [(w, "xy"[i % 2], t, i, 1 + i % 4, float(50 + i % 9), float(rng.normal(0, 400))) for i, (w, t) in enumerate(zip(who, at, strict=True))]
    risks = [(f"r{i}", w, t, "RULE") for i, (w, t) in enumerate(zip(who, at, strict=True)) if i % 6 == 0]
    return (
        frame(orders, "order_id string, strategy_id string, submit_ts timestamp_ntz, status string"), frame(fills, "fill_id string, strategy_id string, fill_ts timestamp_ntz, price double, quantity int, cost double, slippage double"),
        frame(positions, "strategy_id string, symbol string, ts timestamp_ntz, seq bigint, quantity int, price double, realized_pnl double"), frame(risks, "event_id string, strategy_id string, ts timestamp_ntz, rule_name string"),
    )


SESSIONS = "array<struct<session_id:string,start_ts:timestamp_ntz,end_ts:timestamp_ntz,trades:bigint,net_pnl:double>>"


def evaluated(spark, windows, parts, capital=2000.0):
    orders, fills, positions, risks = parts
    terms = {"dataset_version": "v", "dataset_sha256": "s", "execution_policy": "e", "cost_schedule_hash": "c", "risk_config_hash": "r"}
    names = ", ".join(f"{t} string" for t in terms)
    w = spark.createDataFrame([(f"w{i}", s, f"q-{s}", a, b, None) for i, (s, a, b) in enumerate(windows)], "window_id string, strategy_id string, qualification_hash string, window_start timestamp_ntz, window_end timestamp_ntz, observed_report string")
    who = ("a", "b")
    q = spark.createDataFrame([(f"q-{s}", s, "PAPER_ELIGIBLE") for s in who], "record_hash string, strategy_id string, final_status string")
    b = spark.createDataFrame([(s, f"q-{s}", f"b-{s}", *terms.values()) for s in who], f"strategy_id string, qualification_hash string, report_hash string, {names}")
    r = spark.createDataFrame([(f"b-{s}", s, f"q-{s}", "FORWARD_PAPER", 10, capital, 300.0, 1.0, [], *terms.values()) for s in who], f"report_hash string, strategy_id string, qualification_hash string, split_zone string, lot_size int, initial_capital double, max_drawdown_bps double, slippage_bps double, sessions {SESSIONS}, {names}")
    return evaluation.evaluate(w, qualifications=q, baselines=b, reports=r, orders=orders, fills=fills, positions=positions, risk_events=risks)


def plain_window(parts, strategy, a, b, capital=2000.0):
    orders, fills, positions, risks = ([r for r in p.collect() if r.strategy_id == strategy] for p in parts)
    inside = lambda rows, at: [r for r in rows if a <= r[at] <= b]
    f, o, p, k = inside(fills, "fill_ts"), inside(orders, "submit_ts"), inside(positions, "ts"), inside(risks, "ts")
    turnover = sum(r.price * r.quantity * 10 for r in f)
    last = {}
    for r in sorted(p, key=lambda r: (r.ts, -r.seq)):
        last[r.symbol] = r.realized_pnl
    curve = {}
    for r in p:
        curve[r.ts] = curve.get(r.ts, capital) + r.realized_pnl
    peak, fall = -1e18, 0.0
    for t in sorted(curve):
        peak = max(peak, curve[t])
        fall = max(fall, 10000.0 if peak <= 0 or curve[t] <= 0 else (peak - curve[t]) / peak * 10000)
    return {
        "total_trades": len(f), "submitted": len(o), "rejected": sum(r.status == "REJECTED" for r in o), "risk_events": len(k), "net_pnl": sum(last.values()), "drawdown_bps": min(fall, 10000.0),
        "slippage_bps": sum(r.slippage for r in f) / turnover * 10000 if turnover else 0.0, "peak_exposure": max((r.quantity * r.price * 10 for r in p), default=0.0),
    }


def test_windows_that_overlap_equal_each_alone(spark):
    parts = evidence(spark)
    windows = [(s, T0 + i * 2 * DAY, T0 + (i * 2 + n) * DAY) for s in ("a", "b") for i in range(0, 24, 3) for n in (1, 9, 30)]
    some = parts[0].filter("strategy_id = 'a'").first().submit_ts
    windows += [("a", some, some), ("b", T0 - 9 * DAY, T0 - 8 * DAY), ("a", T0, T0 + 90 * DAY)]
    got = {r.window_id: r for r in evaluated(spark, windows, parts).snapshots.collect()}
    assert len(got) == len(windows) and got[f"w{len(windows) - 3}"].submitted >= 1
    for i, w in enumerate(windows):
        for name, value in plain_window(parts, *w).items():
            assert got[f"w{i}"][name] == pytest.approx(value, abs=6e-5), (w, name)


def test_faults_belong_to_the_windows_that_have_them(spark):
    orders, fills, positions, risks = evidence(spark, 60)
    one = fills.filter("strategy_id = 'a'").orderBy("fill_ts").first()
    again = fills.filter(F.col("fill_id") == one.fill_id).withColumn("fill_ts", F.lit(one.fill_ts + 5 * DAY).cast("timestamp_ntz"))
    windows = [("a", one.fill_ts, one.fill_ts + 5 * DAY), ("a", one.fill_ts, one.fill_ts + 4 * DAY), ("a", one.fill_ts + DAY, one.fill_ts + 9 * DAY), ("b", T0, T0 + 90 * DAY), ("a", T0 + DAY, T0)]
    e = evaluated(spark, windows, (orders, fills.unionByName(again), positions, risks.unionByName(risks.limit(0))))
    assert {tuple(r) for r in e.faults.collect()} == {("w0", "repeated fill_id"), ("w4", "window")}


def test_long_windows_have_two_cells_a_piece_and_rows_for_evidence_alone(spark):
    windows = [("w0", "a", dt.datetime(1000, 1, 1), dt.datetime(2999, 12, 31)), ("w1", "a", T0, T0), ("w2", "a", T0, T0 + 9 * DAY), ("w3", "b", T0 + 400 * DAY, T0 + 401 * DAY), ("w4", "b", dt.datetime(1969, 12, 31, 23), dt.datetime(1970, 1, 2))]
    windows += [(f"x{i}", "c", T0 + i * DAY, T0 + (i + 500) * DAY) for i in range(500)]
    rows = [("a", t) for t in (T0 - DAY, T0, T0 + 9 * DAY, T0 + 10 * DAY, dt.datetime(3000, 1, 1))] + [("b", t) for t in (T0 + 401 * DAY, T0 + 402 * DAY, dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31, 22))] + [("c", T0 + 500 * DAY), ("c", None)]
    pieces = evaluation.Pieces.of(spark.createDataFrame(windows, "window_id string, strategy_id string, window_start timestamp_ntz, window_end timestamp_ntz"))
    assert pieces.cells.count() <= 2 * pieces.cells.select("strategy_id", "piece").distinct().count()  # 730,000 days
    dealt = pieces.deal(spark.createDataFrame(rows, "strategy_id string, ts timestamp_ntz"), "ts", pieces.levels())
    cover = pieces.cover(dealt.select("strategy_id", "piece").distinct())
    got = [tuple(r) for r in dealt.join(cover, ["strategy_id", "piece"]).select("window_id", "ts").collect()]
    assert sorted(got) == sorted((w, t) for w, s, a, b in windows for k, t in rows if k == s and t is not None and a <= t <= b)
    assert cover.filter("strategy_id = 'c'").count() == 500


def test_windows_and_evidence_are_dealt_by_strategy_once(spark, monkeypatch):
    plans, real = {}, evaluation.staged
    monkeypatch.setattr(evaluation, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and real(df, name))
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    got = evaluated(spark, [("a", T0 + i * DAY, T0 + (i + 30) * DAY) for i in range(9)], evidence(spark, 60))
    dealt = [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\),", plans["snapshots"])]
    assert got.snapshots.count() == 9 and len(plans) <= 5 and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    assert dealt and {keys for keys in dealt if "capital" not in keys} == {"strategy_id"} and len(dealt) <= 10


def test_results_and_falls_across_runs_of_windows(spark):
    """Symbols that come back in later runs, falls from a peak of an earlier run, equal times."""
    at = lambda d: T0 + d * DAY
    p = [("a", "x", at(0), 1, 1, 9.0, 100.0), ("a", "y", at(1), 2, 1, 9.0, 7.0), ("a", "x", at(4), 3, 2, 9.0, 900.0), ("a", "x", at(6), 5, 1, 9.0, -50.0), ("a", "x", at(6), 4, 1, 9.0, 30.0), ("a", "z", at(8), 6, 3, 9.0, -700.0), ("b", "x", at(3), 7, 1, 9.0, 5.0)]
    orders, fills, _, risks = evidence(spark, 40)
    positions = spark.createDataFrame(p, "strategy_id string, symbol string, ts timestamp_ntz, seq bigint, quantity int, price double, realized_pnl double")
    windows = [("a", at(i), at(i + n)) for i in range(-1, 10) for n in (0, 1, 3, 5, 9)] + [("b", at(0), at(9)), ("b", at(4), at(9))]
    parts = (orders, fills, positions, risks)
    got = {r.window_id: r for r in evaluated(spark, windows, parts).snapshots.collect()}
    for i, w in enumerate(windows):
        for name, value in plain_window(parts, *w).items():
            assert got[f"w{i}"][name] == pytest.approx(value, abs=6e-5), (w, name)


def test_digest_of_a_file_over_two_gigabytes(spark, tmp_path):
    big, h = tmp_path / "big", hashlib.sha256()
    with big.open("wb") as f:
        f.write(b"start")
        f.truncate((2 << 30) + 77)
    with big.open("rb") as f:
        while piece := f.read(1 << 24):
            h.update(piece)
    r = files.file_digests(spark, str(big)).collect()
    assert [(x.sha256, x.length) for x in r] == [(h.hexdigest(), (2 << 30) + 77)] and files.dataset_digest(spark, str(big)) == h.hexdigest()
    big.unlink()


def test_tree_digests(spark, tmp_path):
    for root in ("one", "two"):
        for i in range(1, 31):
            where = tmp_path / root / f"part={i % 3}" / f"file {i}#%.bin"
            where.parent.mkdir(parents=True, exist_ok=True)
            where.write_bytes(bytes([i]) * i)
        (tmp_path / root / "_SUCCESS").write_text("")
    digest = lambda root: files.dataset_digest(spark, str(tmp_path / root))
    assert digest("one") == digest("two")
    entries = {}
    for p in sorted((tmp_path / "one").rglob("*.bin")):
        name = str(p.relative_to(tmp_path / "one"))
        entries.setdefault(hashlib.sha256(name.encode()).hexdigest()[:3], []).append(f"{name}:{hashlib.sha256(p.read_bytes()).hexdigest()}")
    lines = [f"{b}:{hashlib.sha256(chr(10).join(sorted(e)).encode()).hexdigest()}" for b, e in sorted(entries.items())]
    assert digest("one") == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    (tmp_path / "two" / "part=0" / "file 3#%.bin").write_bytes(b"other")
    assert digest("one") != digest("two")


def test_artifacts_tell_what_was_written_and_refuse_what_changed(spark, tmp_path):
    rows = [(T0 + i * DAY, T0 + i * DAY, T0 + (i + 1) * DAY, 1, 1.0, 0.5, 0.5) for i in range(7)]
    trades = spark.createDataFrame(rows, "signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, side int, gross_bps double, cost_bps double, net_bps double")
    made = research.write_artifact(trades, f"{tmp_path}/a", "T1")
    assert (made.rows, made.first_signal, made.last_exit, len(made.sha256)) == (7, T0, T0 + 7 * DAY, 64)
    assert research.read_verified(spark, made).count() == 7 and made.row(spark).first().sha256 == made.sha256
    with pytest.raises(Exception, match="(?i)exists"):
        research.write_artifact(trades, f"{tmp_path}/a", "T1")
    part = next((tmp_path / "a" / "trial_id=T1").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="do not have the digest"):
        research.read_verified(spark, made)
    with pytest.raises(FileNotFoundError):
        research.read_verified(spark, research.Artifact("T", f"{tmp_path}/none", "0", 0, None, None))
    assert research.write_artifact(trades.limit(0), f"{tmp_path}/b", "T2").rows == 0


LEDGER = "k string, v int, digest string"


def entries(spark, ks, v=1):
    return spark.createDataFrame([(f"k{k}", v, f"d{v}") for k in ks], LEDGER)


def test_ledger_appends_read_only_their_buckets(spark, tmp_path):
    led = commits.Ledger(spark, f"{tmp_path}/l", LEDGER, ["k"])
    assert led.read().count() == 0 and led.append(entries(spark, range(500))) == (1, 500)
    assert led.append(entries(spark, [3, 700, 700])) == (2, 1) and led.append(entries(spark, [3])) == (2, 0)
    version, files_ = led.files()
    read = led.touched(entries(spark, [3]), files_).inputFiles()
    assert version == 2 and len(files_) >= 60 and 1 <= len(read) <= 2 and len({f.split("bucket=")[1].split("/")[0] for f in read}) == 1
    with pytest.raises(ValueError, match="other content"):
        led.append(entries(spark, [3], v=2))
    assert led.conflicts(entries(spark, [3, 901], v=2)).count() == 1
    assert led.read(1).count() == 500 and led.read().count() == 501 and commits.Ledger(spark, f"{tmp_path}/l", LEDGER, ["k"]).read().count() == 501


def test_two_writers_store_a_key_once(spark, tmp_path):
    path = f"{tmp_path}/l"
    both, failed = threading.Barrier(3), []

    def write(shift):
        led = commits.Ledger(spark, path, LEDGER, ["k"])
        publish, first = led._publish, [True]

        def late(version, manifest):  # all have read the same version before anyone publishes
            if first.pop() if first else False:
                both.wait(60)
            publish(version, manifest)

        led._publish = late
        try:
            led.append(entries(spark, range(shift, shift + 10)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(s,)) for s in (0, 5, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    led = commits.Ledger(spark, path, LEDGER, ["k"])
    assert not failed and sorted(r.k for r in led.read().collect()) == sorted(f"k{i}" for i in range(15))
    with pytest.raises(commits.Conflict):
        led._publish(1, {"version": 1, "added": []})


def test_ledger_manifests_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 3)
    led = commits.Ledger(spark, f"{tmp_path}/l", LEDGER, ["k"])
    for i in range(7):
        led.append(entries(spark, [i]))
    read = []
    one = led._read
    monkeypatch.setattr(led, "_read", lambda p: read.append(p.getName()) or one(p))
    assert led.read().count() == 7 and len(read) == 2
    assert led.read(4).count() == 4


@pytest.mark.parametrize("few", [0, 100])
def test_closure_is_the_same_with_few_and_many_nodes(spark, monkeypatch, few):
    monkeypatch.setattr(readmodels, "FEW", few)
    links = [(f"s{i}", f"h{i % 3}") for i in range(40)] + [("h0", "r"), ("h1", "r"), ("h2", "h1"), ("r", "h0"), ("s1", "s1"), ("s2", "s1"), ("s1", "s2")]
    edge = spark.createDataFrame(links, "source string, target string")
    got = readmodels.closure(edge, edge.filter("source like 's%'").select(F.col("source").alias("start")))
    want = set()
    for s in {a for a, _ in links if a[0] == "s"}:
        at, front = {s: 0}, [s]
        while front:
            front = [b for n in front for a, b in links if a == n and b not in at and at.setdefault(b, at[n] + 1)]
        want |= {(s, n, d) for n, d in at.items()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_closure_counts_least_links_and_ends_in_cycles(spark):
    rng = np.random.default_rng(3)
    links = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 40, (70, 2)).tolist()} | {("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n5", "n5")}
    links |= {(f"c{i}", f"c{i + 1}") for i in range(45)}  # longer than the rounds that are kept apart
    starts = ["n0", "n5", "n7", "c0", "lone"]
    want = set()
    for s in starts:
        seen, now, d = {s}, {s}, 0
        while now:
            want |= {(s, n, d) for n in now}
            now = {b for a, b in links if a in now} - seen
            seen |= now
            d += 1
    edge = spark.createDataFrame([*links, ("n0", None)], "source string, target string")
    start = spark.createDataFrame([(s,) for s in [*starts, None, "n0"]], "start string")
    got = [tuple(r) for r in readmodels.closure(edge, start).collect()]
    assert sorted(got) == sorted(want)
    assert {tuple(r) for r in readmodels.closure(edge, start, 2).collect()} == {w for w in want if w[2] <= 2}


def test_provenance_tells_what_is_broken(spark):
    links = spark.createDataFrame([("S1", "Q1"), ("Q1", "T1"), ("Q1", "lost"), ("T1", "S1"), ("S2", "Q2")], "source string, target string")
    known = spark.createDataFrame([("S1", "strategy"), ("Q1", "qualification"), ("T1", "task"), ("S2", "strategy"), ("Q2", "qualification")], "node string, kind string")
    table = spark.createDataFrame([("T1", "S1"), ("S2", "S2")], "id string, strategy_id string")
    got = readmodels.provenance(spark.createDataFrame([("T1",), ("nobody",)], "identifier string"), [(table, "id", "strategy_id")], links, known)
    assert {(r.node, r.kind, r.distance, r.broken) for r in got.collect()} == {("S1", "strategy", 0, False), ("Q1", "qualification", 1, False), ("T1", "task", 2, False), ("lost", None, 2, True)}


@pytest.mark.parametrize("order, kind", [("ts", "timestamp_ntz"), ("seq", "bigint"), ("day", "date")])
def test_previous_rows_over_ranges_equal_lag(spark, monkeypatch, order, kind):
    from pyspark.sql import Window

    monkeypatch.setattr(ordered, "WIDTH", 7)
    rng = np.random.default_rng(1)
    value = {"ts": lambda i: T0 + dt.timedelta(hours=5 * i), "seq": lambda i: i - 50, "day": lambda i: (T0 + i * DAY).date()}[order]
    rows = [(k, value(int(i)), None if i % 9 == 0 else int(i)) for k in ("a", "b", None) for i in rng.permutation(150)] + [("a", None, 5)]
    df = spark.createDataFrame(rows, f"k string, {order} {kind}, v int")
    got = ordered.with_previous(df, "k", order, [order, "v"])
    w = Window.partitionBy("k").orderBy(order)
    want = df.withColumns({f"before_{order}": F.lag(order).over(w), "before_v": F.lag("v").over(w)})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert "_range" in got._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(k", 1)[1].split(")")[0]


def test_disorder_across_ranges_is_seen(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WIDTH", 4)
    at = [T0 + dt.timedelta(minutes=m) for m in (0, 1, 2, 3, 2, 5, 6, 7, 7, 9)]  # the breaks are where ranges meet
    rows = [("A", t, 1.0, 2.0, 0.5, 1.5, 1, 1, i) for i, t in enumerate(at)]
    assert {r.rule: r.n for r in violations(spark.createDataFrame(rows, BAR + ", seq bigint")).collect()} == {"out_of_order": 1, "duplicate_ts": 1}


def bars_with_signals(spark, seed, sessions=9, bars=14):
    rng = np.random.default_rng(seed)
    rows = []
    for c in ("A", "B", "C"):
        p = 100.0
        for s in range(sessions):
            for b in range(bars):
                p += float(rng.normal(0, 1))
                rows.append((c, T0 + s * DAY + dt.timedelta(minutes=b), (T0 + s * DAY).date(), p, p + 0.1, int(rng.integers(-1, 2))))
    return spark.createDataFrame(rows, "contract string, ts timestamp_ntz, session date, open double, close double, signal int")


@pytest.mark.parametrize("risk", [{}, {"max_session_orders": 4}, {"max_daily_loss": 3.0}, {"max_drawdown": 6.0}, {"max_drawdown": 25.0}, {"kill_switch": True}, {"max_position": 0}])
@pytest.mark.parametrize("hold", [1, 3])
def test_replay_by_sessions_equals_the_whole(spark, risk, hold):
    sig = bars_with_signals(spark, 7)
    cfg = replay.Settings(hold_bars=hold, round_trip_bps=2.0, risk=replay.Risk(**risk))
    got, want = replay.replay(sig, cfg).collect(), replay.whole(sig, cfg).collect()
    key = lambda r: str((r.contract, r.ts, r.kind, r.rule, r.side, r.price, r.net_pnl))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_sessions_are_independent_where_no_limit_is_reached(spark):
    sig, cfg = bars_with_signals(spark, 7), replay.Settings(risk=replay.Risk(max_drawdown=1e6))
    events = replay.by_session(sig, cfg)
    assert events.filter("_carried").count() > 0 and replay.bound(events, cfg).count() == 0
    tight = replay.Settings(risk=replay.Risk(max_drawdown=2.0))
    assert replay.bound(replay.by_session(sig, tight), tight).count() > 0


def test_idle_contracts_are_forgotten(spark, tmp_path):
    from barlab.streaming.bars import replay_stream, typed_state

    rows = [("A", T0 + dt.timedelta(minutes=i), T0.date(), 1.0, 1.0, 0) for i in range(3)]
    late = [("B", T0 + dt.timedelta(minutes=i), T0.date(), 1.0, 1.0, 0) for i in (300, 301)]
    later = [("B", T0 + dt.timedelta(minutes=i), T0.date(), 1.0, 1.0, 0) for i in (302, 303)]
    schema = "contract string, ts timestamp_ntz, session date, open double, close double, signal int"
    for i, part in enumerate((rows, late, later)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 minute")
        with typed_state(spark):
            q = replay_stream(stream, idle=600).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.contract, r.kind) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("A", "idle")]
