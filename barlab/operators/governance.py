"""Strategies' lifecycle and its governance as an event log: requests are judged by joins
against the evidence that they name, and the state of a strategy follows from the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.operators.evaluation import EVENT, REGIME, SNAPSHOT
from barlab.operators.ledger import FEEDBACK, content_digest, latest

# States of a strategy, and those that may follow each.
LIFECYCLE_STEPS = {
    "IDEA": ["RESEARCH", "REJECTED"],
    "RESEARCH": ["VALIDATION", "REJECTED"],
    "VALIDATION": ["PAPER_ELIGIBLE", "REJECTED"],
    "REJECTED": [],
    "PAPER_ELIGIBLE": ["PAPER_ACTIVE", "DEGRADED", "RETIRED", "REJECTED"],
    "PAPER_ACTIVE": ["DEGRADED", "RETIRED"],
    "DEGRADED": ["RETIRED", "RESEARCH"],
    "RETIRED": [],
}
#: States in which an action may be asked for, and the state that it leads to.
ACTIONS = {
    "activate": (["PAPER_ELIGIBLE"], "PAPER_ACTIVE"),
    "degrade": (["PAPER_ACTIVE", "PAPER_ELIGIBLE"], "DEGRADED"),
    "retire": (["PAPER_ELIGIBLE", "PAPER_ACTIVE", "DEGRADED"], "RETIRED"),
    "re_research": (["DEGRADED"], "RESEARCH"),
}
GOVERNED = ("PAPER_ACTIVE", "DEGRADED", "RETIRED")
TRANSITION = ["strategy_id", "old_state", "new_state", "evidence_type", "evidence_hash", "reason", "at", "qualification_hash"]
FLAT = 1e-9


def _first(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that is broken, or null."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for broken, name in checks))


def judged(requests: DataFrame, strategies: DataFrame, *, baselines: DataFrame, events: DataFrame, snapshots: DataFrame, regimes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each request (request_id, action, strategy_id, at, reason, position, event_hash,
    feedback_hash) with ``refused``, the first condition that it breaks (null if none), and
    the transition that it asks for.

    To activate needs the bound baseline; to degrade an event and its snapshot and regime,
    undamaged, of this strategy and qualification and not from the future; to retire or to
    research again a reason and a flat position, and research may name the feedback that it
    acts on. No transition is earlier than the strategy's last one.
    """
    c = F.col
    known = strategies.select("strategy_id", "state", c("qualification_hash").alias("qualification"), "updated_at")
    rows = requests.join(known, "strategy_id", "left")
    b = baselines.select("strategy_id", c("qualification_hash").alias("qualification"), F.struct("binding_hash", "created_at").alias("b"))
    rows = rows.join(b, ["strategy_id", "qualification"], "left")
    sound = lambda columns, digest: (content_digest(columns) == c(digest)).alias("sound")
    e = events.select("event_hash", F.struct(c("strategy_id"), c("qualification_hash"), c("snapshot_hash"), c("at"), c("rule"), sound(EVENT, "event_hash")).alias("e"))
    s = snapshots.select("snapshot_hash", F.struct(c("strategy_id"), c("qualification_hash"), c("window_end"), c("regime_hash"), sound(SNAPSHOT, "snapshot_hash")).alias("s"))
    g = regimes.select("regime_hash", F.struct(c("strategy_id"), c("qualification_hash"), sound(REGIME, "regime_hash")).alias("g"))
    f = feedback.select("feedback_hash", F.struct(c("strategy_id"), c("created_at"), sound(FEEDBACK, "feedback_hash")).alias("f"))
    rows = rows.join(e, "event_hash", "left").withColumn("snapshot_hash", c("e.snapshot_hash")).join(s, "snapshot_hash", "left").withColumn("regime_hash", c("s.regime_hash"))
    rows = rows.join(g, "regime_hash", "left").join(f, "feedback_hash", "left")

    of = lambda *names: c("action").isin(*names)
    wrong_state = F.lit(False)
    target = F.lit(None).cast("string")
    for name, (states, to) in ACTIONS.items():
        wrong_state = wrong_state | (of(name) & ~c("state").isin(*states))
        target = F.when(of(name), to).otherwise(target)
    other = lambda x, y: ~c(x).eqNullSafe(c(y))
    regime = c("s.regime_hash").isNotNull() & (c("s.regime_hash") != "")
    refused = _first(
        (~of(*ACTIONS), "unknown action"), (c("state").isNull(), "unknown strategy"),
        (of("retire", "re_research") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "no reason"), (of("retire", "re_research") & (F.abs(F.coalesce("position", F.lit(0.0))) > FLAT), "open position"),
        (of("degrade") & c("e").isNull(), "no event"), (of("degrade") & ~c("e.sound"), "damaged event"), (of("degrade") & other("e.strategy_id", "strategy_id"), "event of another strategy"),
        (wrong_state, "state"), (of("activate") & c("qualification").isNull(), "no qualification"), (of("activate") & c("b").isNull(), "no baseline"),
        (of("degrade") & other("e.qualification_hash", "qualification"), "event of another qualification"), (of("degrade") & (c("e.at") > c("at")), "event is later"),
        (c("at") < c("updated_at"), "too early"), (of("activate") & (c("b.created_at") > c("at")), "baseline is later"),
        (of("degrade") & c("s").isNull(), "no snapshot"), (of("degrade") & ~c("s.sound"), "damaged snapshot"),
        (of("degrade") & (other("s.strategy_id", "strategy_id") | other("s.qualification_hash", "qualification")), "snapshot of another strategy"), (of("degrade") & (c("s.window_end") > c("at")), "snapshot is later"),
        (of("degrade") & regime & c("g").isNull(), "no regime"), (of("degrade") & regime & ~c("g.sound"), "damaged regime"),
        (of("degrade") & regime & (other("g.strategy_id", "strategy_id") | other("g.qualification_hash", "qualification")), "regime of another strategy"),
        (of("re_research") & c("feedback_hash").isNotNull() & c("f").isNull(), "no feedback"), (of("re_research") & ~c("f.sound"), "damaged feedback"),
        (of("re_research") & c("f").isNotNull() & other("f.strategy_id", "strategy_id"), "feedback of another strategy"), (of("re_research") & (c("f.created_at") > c("at")), "feedback is later"),
    )
    decision = F.sha2(F.concat_ws(":", "strategy_id", "reason", c("at").cast("string")), 256)
    told = of("re_research") & c("feedback_hash").isNotNull()
    kind = F.when(of("activate"), "baseline_binding").when(of("degrade"), "degradation_event").when(of("retire"), "retirement_decision").when(told, "RESEARCH_FEEDBACK").otherwise("re_research_decision")
    evidence = F.when(of("activate"), c("b.binding_hash")).when(of("degrade"), c("event_hash")).when(told, c("feedback_hash")).otherwise(decision)
    why = F.when(of("activate"), "baseline verified").when(of("degrade"), F.concat(F.lit("degradation: "), "e.rule")).otherwise(c("reason"))
    out = rows.select("request_id", "action", "strategy_id", "at", c("state").alias("old_state"), target.alias("new_state"), kind.alias("evidence_type"), evidence.alias("evidence_hash"), why.alias("reason"), c("qualification").alias("qualification_hash"), refused.alias("refused"))
    return out.withColumn("transition_hash", content_digest(TRANSITION))


def transitions_of(requests: DataFrame) -> DataFrame:
    """The transitions to append from judged requests: of each strategy the earliest one
    that is not refused, as later ones rest on a state that is no more."""
    fit = requests.filter(F.col("refused").isNull()).drop("refused")
    return latest(fit, ["strategy_id"], [F.asc("at"), F.asc("request_id")])


def moved(strategies: DataFrame, transitions: DataFrame) -> DataFrame:
    """The registry (strategy_id, state, qualification_hash, updated_at, transition_hash)
    after each strategy's latest transition; research makes it qualify anew."""
    t = latest(transitions, ["strategy_id"], [F.desc("at"), F.desc("transition_hash")]).select("strategy_id", F.struct("new_state", "at", "transition_hash").alias("t"))
    rows, new = strategies.join(t, "strategy_id", "left"), F.col("t").isNotNull()
    again = new & (F.col("t.new_state") == "RESEARCH")
    return rows.select(
        "strategy_id", F.when(new, F.col("t.new_state")).otherwise(F.col("state")).alias("state"), F.when(~again, F.col("qualification_hash")).alias("qualification_hash"),
        F.when(new, F.col("t.at")).otherwise(F.col("updated_at")).alias("updated_at"), F.when(new, F.col("t.transition_hash")).otherwise(F.col("transition_hash")).alias("transition_hash"),
    )


def promotion_faults(strategies: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """(strategy_id, fault) of strategies in validation that ask to be paper-eligible, from
    their qualification records (strategy_id, spec_hash, final_status, holdout_state and
    ``record_hash`` over ``columns``); strategies without a fault may go."""
    c = F.col
    r = records.select("strategy_id", F.struct(c("spec_hash"), c("final_status"), c("holdout_state"), (content_digest(columns) == c("record_hash")).alias("sound")).alias("r"))
    fault = _first(
        (c("state") != "VALIDATION", "state"), (c("r").isNull(), "no qualification"), (~c("r.sound"), "damaged qualification"), (~c("r.spec_hash").eqNullSafe(c("spec_hash")), "another specification"),
        (~c("r.final_status").eqNullSafe("PAPER_ELIGIBLE"), "final_status"), (~c("r.holdout_state").eqNullSafe("PASSED"), "holdout_state"),
    )
    return strategies.join(r, "strategy_id", "left").select("strategy_id", fault.alias("fault")).filter("fault is not null")


def linkage(strategies: DataFrame, transitions: DataFrame) -> DataFrame:
    """(strategy_id, linked): whether a strategy's registered transition is in the log,
    undamaged, its own, leads to its state and has its qualification. A strategy without a
    transition is linked as long as it is in no state that only governance gives."""
    c = F.col
    t = transitions.select("transition_hash", F.struct(c("strategy_id"), c("new_state"), c("qualification_hash"), (content_digest(TRANSITION) == c("transition_hash")).alias("sound")).alias("t"))
    rows = strategies.join(t, "transition_hash", "left")
    both = c("qualification_hash").isNotNull() & c("t.qualification_hash").isNotNull()
    good = c("t.sound") & c("t.strategy_id").eqNullSafe(c("strategy_id")) & c("t.new_state").eqNullSafe(c("state")) & (~both | (c("qualification_hash") == c("t.qualification_hash")))
    return rows.select("strategy_id", F.when(c("transition_hash").isNull(), ~c("state").isin(*GOVERNED)).otherwise(F.coalesce(good, F.lit(False))).alias("linked"))
