"""Read models: zero-filled counts, dossiers, identifier resolution, provenance graphs."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.operators.ledger import latest
from barlab.operators.staging import drop_staged, staged


def zero_filled(spark: SparkSession, rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of each listed value, also of those that do not occur."""
    names = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def recent(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order, found without sorting the rest."""
    return rows.orderBy(*order).limit(n)


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Adds the number of a parent's children and their sorted list."""
    lists = children.groupBy(key).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(f"{name}_count", F.coalesce("_n", F.lit(0))).drop("_n")


def resolve(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(identifier, strategy_id): each identifier by the first table that has it."""
    parts = [df.select(F.col(i).cast("string").alias("identifier"), F.col(s).cast("string").alias("strategy_id"), F.lit(p).alias("priority")) for p, (df, i, s) in enumerate(tables)]
    return latest(reduce(DataFrame.unionByName, parts), ["identifier"], [F.asc("priority"), F.asc("strategy_id")]).select("identifier", "strategy_id")


def nodes(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(node, kind): of nodes that several tables have, the first one's."""
    parts = [df.select(F.col(i).cast("string").alias("node"), F.lit(k).alias("kind"), F.lit(p).alias("priority")) for p, (df, i, k) in enumerate(tables)]
    return latest(reduce(DataFrame.unionByName, parts), ["node"], [F.asc("priority")]).select("node", "kind")


def edges(links: DataFrame, known: DataFrame) -> DataFrame:
    """(source, target, kind) whose target is a node."""
    return links.join(known.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target", "kind")


def broken(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose target is not a node."""
    return links.join(known.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target", "kind")


#: Rows of nodes or links that a round of ``closure`` may send to every task.
FEW = 100_000


def closure(links: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, distance): every node that each of the ``starts`` (start) reaches along
    ``links`` (source, target), itself at 0, and the least number of links to it; with
    ``most``, no further than that.

    A round follows the links of what the round before has found new, so a node is followed
    once for each start and a cycle ends where it comes back. Rounds are as many as the
    longest shortest path; each is staged, and a lost executor costs one round at most.

    The first round is the links of the starts. Later ones read the links of the nodes that
    the round before could reach alone, and compare what they find with those pairs that end
    in a node that they can reach; up to ``FEW`` such nodes or links travel to the tasks."""
    spark = links.sparkSession
    links, links_at = staged(links.select("source", "target").filter("source is not null and target is not null").distinct(), "links")
    new, at = staged(starts.select("start", F.col("start").alias("node")).filter("start is not null").distinct(), "reached")
    seen, paths, found = new, [at], [new.withColumn("distance", F.lit(0))]
    few = lambda df: df.count() <= FEW
    goals, goals_at = None, None
    for distance in itertools.count(1):
        if most is not None and distance > most:
            break
        drop = [] if goals_at is None else [goals_at]
        if distance == 1:
            step = links.join(new.select(F.col("node").alias("source")), "source", "left_semi").filter("source <> target")
            new, at = staged(step.select(F.col("source").alias("start"), F.col("target").alias("node")), "reached")
            goals, goals_at = staged(new.select("node").distinct(), "goals")
        else:
            sources = goals.withColumnRenamed("node", "source")
            onward, onward_at = staged(links.join(F.broadcast(sources) if few(goals) else sources.hint("merge"), "source", "left_semi"), "onward")
            goals, goals_at = staged(onward.select(F.col("target").alias("node")).distinct(), "goals")
            step = new.join(F.broadcast(onward) if few(onward) else onward.hint("merge"), F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
            known = seen.join(F.broadcast(goals), "node", "left_semi") if few(goals) else seen
            new, at = staged(step.join(known.hint("merge"), ["start", "node"], "left_anti"), "reached")
            drop.append(onward_at)
        drop_staged(spark, *drop)
        if not new.limit(1).count():
            drop_staged(spark, at)
            break
        paths.append(at)
        found.append(new.withColumn("distance", F.lit(distance)))
        seen = seen.unionByName(new)
        if len(found) > 32:  # long chains: one table of what is found so far
            whole, at = staged(reduce(DataFrame.unionByName, found), "reached")
            drop_staged(spark, *paths)
            new, seen, paths, found = whole.filter(F.col("distance") == distance).drop("distance"), whole.drop("distance"), [at], [whole]
    drop_staged(spark, links_at, *([] if goals_at is None else [goals_at]))
    return reduce(DataFrame.unionByName, found)


def provenance(identifiers: DataFrame, aliases: list[tuple[DataFrame, str, str]], links: DataFrame, known: DataFrame, most: int | None = None) -> DataFrame:
    """(identifier, strategy_id, node, kind, distance, broken): what each of the
    ``identifiers`` (identifier) rests on. It is resolved to a strategy by the first table of
    ``aliases`` that has it, and the links are followed from there; ``known`` (node, kind)
    are the nodes that exist, and one that a link names without existing is broken. An
    identifier that no table has is left out."""
    found = resolve(aliases).join(identifiers.select(F.col("identifier").cast("string").alias("identifier")).distinct(), "identifier", "left_semi")
    reached = closure(links, found.select(F.col("strategy_id").alias("start")), most)
    named = reached.join(known.select("node", "kind"), "node", "left").withColumn("broken", F.col("kind").isNull())
    return found.join(named, F.col("strategy_id") == F.col("start")).select("identifier", "strategy_id", "node", "kind", "distance", "broken")


def dossiers(strategies: DataFrame, parts: list[tuple[str, DataFrame, str, int | None]], key: str = "strategy_id") -> DataFrame:
    """Each strategy with the rows of other tables: for (name, table, order, n), a column
    ``name`` of its rows as structs, the latest ``n`` by ``order`` (None: all), and their
    count. Strategies without rows have an empty array."""
    out = strategies
    for name, df, order, n in parts:
        rows = latest(df, [key], [F.desc(order)], n) if n else df
        fields = [order, *(c for c in df.columns if c not in (key, order))]
        lists = rows.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct(*fields)))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array())).withColumn(f"{name}_count", F.size(name))
    return out


def json_fields(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """The rows with fields of a JSON text column, by name and type; null where the text is
    no JSON or lacks the field."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    return rows.withColumn("_json", F.from_json(column, schema)).select(*rows.columns, *(F.col(f"_json.`{name}`").alias(name) for name in fields))


def open_positions(positions: DataFrame) -> DataFrame:
    return positions.filter(F.abs("quantity") > 0)


def paper_overview(strategies: DataFrame, orders: DataFrame, fills: DataFrame, risk_events: DataFrame, reports: DataFrame, latest_reports: int = 50) -> DataFrame:
    """One row: strategies active and degraded, orders, fills and risk events, and the net
    result of the latest reports (created_at, report_json)."""
    one = lambda df, *columns: df.agg(*columns).withColumn("_k", F.lit(1))
    state = lambda name: F.count_if(F.col("state") == name)
    parts = [
        one(strategies, state("PAPER_ACTIVE").alias("active_strategies"), state("DEGRADED").alias("degraded_strategies")), one(orders, F.count("*").alias("total_orders")),
        one(fills, F.count("*").alias("total_fills")), one(risk_events, F.count("*").alias("total_risk_events")),
        one(recent(json_fields(reports, "report_json", {"net_pnl": "double"}), [F.desc("created_at"), F.desc("report_json")], latest_reports), F.round(F.coalesce(F.sum("net_pnl"), F.lit(0.0)), 2).alias("total_net_pnl")),
    ]
    return reduce(lambda a, b: a.join(b, "_k"), parts).drop("_k")


def population_summary(trials: DataFrame, by: list[str]) -> DataFrame:
    """(by..., production_trials, production_experiments, production_variants,
    fixture_trials): the usage of production and fixture trials side by side."""
    live = F.col("mode") == "PRODUCTION"
    of = lambda c: F.count_distinct(F.when(live, F.col(c)))
    return trials.groupBy(*by).agg(
        F.count_if(live).alias("production_trials"), of("experiment_id").alias("production_experiments"), of("strategy_id").alias("production_variants"), F.count_if(F.col("mode") == "FIXTURE").alias("fixture_trials"),
    )
