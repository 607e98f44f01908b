"""Paper replay: one position at a time, orders filled at the next bar's open after risk
checks. The state runs through bars in order: those of a session where sessions are
independent, else those of a contract; its step functions serve the batch replay and the
streaming one alike."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import tick_price
from barlab.operators.staging import staged


@dataclass(frozen=True)
class Risk:
    kill_switch: bool = False
    max_order: int = 10
    max_position: int = 10
    max_session_orders: int = 1000
    max_daily_loss: float = 1e12
    max_drawdown: float = 1e12
    max_exposure: float = 1e15


@dataclass(frozen=True)
class Settings:
    capital: float = 100_000.0
    quantity: int = 1
    hold_bars: int = 1
    lot_size: int = 1
    tick: float = 0.0
    slippage_bps: float = 0.0
    round_trip_bps: float = 0.0
    same_session: bool = True
    entries: bool = True
    risk: Risk = field(default_factory=Risk)


@dataclass
class State:
    """All that is carried from bar to bar; plain values, so that it can be stored."""

    bar: int = 0
    position: int = 0
    entry_bar: int = 0
    entry_price: float = 0.0
    entry_cost: float = 0.0
    entry_ts: str = ""
    realized: float = 0.0
    pending_side: int = 0
    pending_exit: bool = False
    pending_ts: str = ""
    session: str = ""
    session_orders: int = 0
    session_loss: float = 0.0
    peak: float = 0.0
    equity: float = 0.0


EVENT = "kind string, ts timestamp_ntz, signal_ts timestamp_ntz, entry_ts timestamp_ntz, side int, quantity int, price double, cost double, slippage double, gross_pnl double, net_pnl double, rule string"
FIELDS = [f.split()[0] for f in EVENT.split(", ")]


def broken_rule(s: State, side: int, price: float, cfg: Settings) -> str | None:
    """The first risk rule that an order breaks. Rules from the position limit on do not
    hold back orders that make the position smaller."""
    r, q = cfg.risk, cfg.quantity
    after = s.position + side * q
    reducing = abs(after) < abs(s.position)
    if q <= 0 or side not in (1, -1):
        return "invalid_order_parameters"
    if r.kill_switch:
        return "kill_switch"
    if q > r.max_order:
        return "max_order_quantity"
    if reducing:
        return None
    limits = (
        ("max_position", abs(after) > r.max_position),
        ("max_trades_per_session", s.session_orders >= r.max_session_orders),
        ("max_daily_loss", s.session_loss >= r.max_daily_loss),
        ("max_strategy_drawdown", max(0.0, s.peak - s.equity) >= r.max_drawdown),
        ("max_exposure", abs(after) * price * max(1, cfg.lot_size) > r.max_exposure),
    )
    return next((name for name, hit in limits if hit), None)


def open_bar(s: State, bar, cfg: Settings) -> list[dict]:
    """Fill or reject the pending order at the open of a bar (ts, session, open) and tell
    what happens. What is decided at the bar's close is ``close_bar``'s."""
    out = []

    def tell(kind: str, **values) -> None:
        out.append({"kind": kind, "ts": bar.ts, "quantity": cfg.quantity, **values})

    if s.pending_side:
        side, signal_ts = s.pending_side, pd.Timestamp(s.pending_ts)
        s.pending_side = 0
        if str(bar.session) != s.session:  # limits of a day start anew with its first order
            s.session, s.session_orders, s.session_loss = str(bar.session), 0, 0.0
        rule = broken_rule(s, side, bar.open, cfg)
        if rule:
            tell("rejected", signal_ts=signal_ts, side=side, price=float(bar.open), rule=rule)
        else:
            s.session_orders += 1
            price = tick_price(bar.open * (1 + side * cfg.slippage_bps / 10000), cfg.tick)
            size = cfg.quantity * cfg.lot_size
            cost, slip = price * size * (cfg.round_trip_bps / 2 / 10000), abs(price - bar.open) * size
            tell("fill", signal_ts=signal_ts, side=side, price=price, cost=cost, slippage=slip)
            if s.position == 0:
                s.position, s.entry_bar, s.entry_price, s.entry_cost, s.entry_ts = side * cfg.quantity, s.bar, price, cost, str(bar.ts)
            else:
                held = 1 if s.position > 0 else -1
                gross = held * (price - s.entry_price) * size
                net = gross - (s.entry_cost + cost)
                tell("trade", signal_ts=signal_ts, entry_ts=pd.Timestamp(s.entry_ts), side=held, price=price, cost=s.entry_cost + cost, gross_pnl=gross, net_pnl=net)
                s.realized += net
                s.equity = cfg.capital + s.realized
                s.peak = max(s.peak, s.equity)
                s.session_loss += max(0.0, -net)
                s.position = 0
    return out


def close_bar(s: State, bar, last_of_session: bool, more: bool, cfg: Settings) -> None:
    """Decide at the close of a bar (ts, signal) on an order for the next bar's open.
    ``last_of_session``: the next bar is in another session; ``more``: there is a next bar."""
    leave = cfg.same_session and last_of_session
    if s.position:
        if more and (leave or s.bar - s.entry_bar + 1 >= cfg.hold_bars):
            s.pending_side, s.pending_exit, s.pending_ts = (-1 if s.position > 0 else 1), True, str(bar.ts)
    elif bar.signal and more and cfg.entries and not leave:
        s.pending_side, s.pending_exit, s.pending_ts = int(bar.signal), False, str(bar.ts)
    s.bar += 1


def frame(events: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(events, columns=FIELDS)
    for c in ("ts", "signal_ts", "entry_ts"):
        out[c] = pd.to_datetime(out[c]).astype("datetime64[ns]")
    for c in ("side", "quantity"):
        out[c] = out[c].astype("int32")
    for c in ("kind", "rule"):
        out[c] = out[c].astype(object)
    for c in ("price", "cost", "slippage", "gross_pnl", "net_pnl"):
        out[c] = out[c].astype(float)
    return out


def _steps(rows: list, cfg: Settings, behind=None) -> list[dict]:
    """What happens over bars in order; ``behind`` is the bar after them, which fills what is
    pending at their end."""
    state, events = State(), []
    for i, bar in enumerate(rows):
        after = rows[i + 1] if i + 1 < len(rows) else behind
        events += open_bar(state, bar, cfg)
        close_bar(state, bar, after is not None and after.session != bar.session, after is not None, cfg)
    return events + (open_bar(state, behind, cfg) if behind is not None else [])


def whole(bars: DataFrame, cfg: Settings, key: str = "contract") -> DataFrame:
    """The replay of each contract in one group, for positions and limits that run through
    all of its bars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = frame(_steps(list(pdf.sort_values("ts").itertuples(index=False)), cfg))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    bars = bars.select(key, "ts", "session", "open", "close", "signal")
    return bars.groupBy(key).applyInPandas(run, f"{key} {dict(bars.dtypes)[key]}, {EVENT}")


def by_session(bars: DataFrame, cfg: Settings, key: str = "contract") -> DataFrame:
    """The replay of each session in a group of its own, with ``_session``, the session of an
    event's bar. Positions are left by a session's last bar, and an exit decided there is
    filled at the next session's first open, which comes with the group."""
    first = bars.groupBy(key, "session").agg(F.min_by(F.struct("ts", "open"), "ts").alias("f"))
    after = F.lead(F.struct("f.ts", "f.open", "session")).over(Window.partitionBy(key).orderBy("f.ts"))  # a row for each session
    behind = first.select(key, F.col("session").alias("_group"), after.alias("n")).filter("n is not null")
    rows = bars.select(key, F.col("session").alias("_group"), "ts", "session", "open", "close", "signal", F.lit(False).alias("_behind"))
    empty = lambda c: F.lit(None).cast(dict(bars.dtypes)[c]).alias(c)
    rows = rows.unionByName(behind.select(key, "_group", "n.ts", "n.session", "n.open", empty("close"), empty("signal"), F.lit(True).alias("_behind")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = list(pdf[~pdf["_behind"]].sort_values("ts").itertuples(index=False))
        last = list(pdf[pdf["_behind"]].itertuples(index=False))
        events = _steps(own, cfg, last[0] if last else None)
        out = frame(events)
        out.insert(0, key, pdf[key].iloc[0])
        out["_session"] = [last[0].session if last and e["ts"] == last[0].ts else own[0].session for e in events] if events else pd.Series([], dtype=object)
        out["_carried"] = [bool(last) and e["ts"] == last[0].ts for e in events] if events else pd.Series([], dtype=bool)
        return out

    kinds = dict(bars.dtypes)
    return rows.groupBy(key, "_group").applyInPandas(run, f"{key} {kinds[key]}, {EVENT}, _session {kinds['session']}, _carried boolean")


def bound(events: DataFrame, cfg: Settings, key: str = "contract") -> DataFrame:
    """The contracts in which a limit that runs on from session to session may have held
    something back: orders or losses of a session into which an exit was carried, or the
    fall of equity. Where none was reached, sessions were independent."""
    carried, net = F.max("_carried"), F.when(F.col("kind") == "trade", F.col("net_pnl"))
    own = events.groupBy(key, "_session").agg(
        carried.alias("carried"), F.count_if(F.col("kind") == "fill").alias("orders"), F.coalesce(F.sum(F.greatest(F.lit(0.0), -net)), F.lit(0.0)).alias("loss"), F.coalesce(F.sum(net), F.lit(0.0)).alias("net"),
    )
    run = Window.partitionBy(key, "_session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    trades = events.filter("kind = 'trade'").select(key, "_session", F.sum("net_pnl").over(run).alias("total"), "ts")
    trades = trades.withColumn("high", F.max("total").over(run))
    falls = trades.groupBy(key, "_session").agg(F.max("high").alias("high"), F.min("total").alias("low"), F.max(F.col("high") - F.col("total")).alias("fall"))
    days = own.join(falls, [key, "_session"], "left")
    before = Window.partitionBy(key).orderBy("_session").rowsBetween(Window.unboundedPreceding, -1)  # a row for each session
    days = days.withColumn("base", F.coalesce(F.sum("net").over(before), F.lit(0.0)))
    days = days.withColumn("peak", F.max(F.col("base") + F.col("high")).over(before))
    fall = F.greatest("fall", F.coalesce(F.col("peak") - (F.col("base") + F.col("low")), F.lit(0.0)), -(F.lit(cfg.capital) + F.col("base") + F.col("low")))
    r = cfg.risk
    hit = (F.col("carried") & ((F.col("orders") > r.max_session_orders) | (F.col("loss") >= r.max_daily_loss))) | (fall * (1 + 1e-9) >= r.max_drawdown)
    return days.filter(F.coalesce(hit, F.lit(False))).select(key).distinct()


def replay(signals: DataFrame, cfg: Settings | None = None, key: str = "contract") -> DataFrame:
    """Fills, rejections and closed trades of each contract, from bars with signals. A trade
    that is open at the end of the data is neither closed nor told.

    Where positions do not outlive a session (``same_session``), sessions are replayed side
    by side, as if no limit ran on from one to the next, and staged; contracts in which such
    a limit was reached are replayed again, whole. A session's bars follow each other."""
    cfg = cfg or Settings()
    bars = signals.select(key, "ts", "session", "open", "close", "signal")
    if not cfg.same_session:
        return whole(bars, cfg, key)
    events, _ = staged(by_session(bars, cfg, key), "replay")
    held, _ = staged(bound(events, cfg, key), "held-back")
    free = events.join(held, key, "left_anti").drop("_session", "_carried")
    return free.unionByName(whole(bars.join(held, key, "left_semi"), cfg, key)) if held.limit(1).count() else free


def report(events: DataFrame, cfg: Settings | None = None, key: str = "contract") -> DataFrame:
    """A replay's summary for each contract: trades, results, costs, win rate, drawdown of
    the capital and the Sharpe ratio of trades."""
    from barlab.operators.monitoring import drawdown_of_capital

    cfg = cfg or Settings()
    trades = events.filter("kind = 'trade'")
    n, spread = F.count("*"), F.stddev_samp("net_pnl")
    sums = trades.groupBy(key).agg(
        n.alias("trades"), F.sum("gross_pnl").alias("gross_pnl"), F.sum("net_pnl").alias("net_pnl"), F.avg(F.when(F.col("net_pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("net_pnl").alias("expectancy"),
        F.when(n > 1, F.avg("net_pnl") / F.when(spread == 0, 1.0).otherwise(spread) * 250.0**0.5).alias("sharpe"), (n * cfg.quantity * cfg.lot_size).cast("double").alias("exposure"),
    )
    paid = events.filter("kind = 'fill'").groupBy(key).agg(F.count("*").alias("fills"), F.sum("cost").alias("costs"), F.sum("slippage").alias("slippage"))
    return paid.join(sums, key, "left").join(drawdown_of_capital(trades, cfg.capital, key, "ts"), key, "left")


def settings_of(cfg: Settings) -> dict:
    return asdict(cfg)
