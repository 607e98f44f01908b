"""Statistics over trials: return moments, aligned correlations, clusters of correlated
trials, and Sharpe ratios deflated by the number of effective trials."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from barlab.functions.scalars import detection_gate, expected_max_sharpe, false_pass_gate
from barlab.operators.graph import components
from barlab.operators.staging import drop_staged, staged

CUT, FAR, LEAST_COMMON = 0.6325, 2.0, 100


def return_moments(returns: DataFrame, by: str = "trial_id", value: str = "net_return_bps") -> DataFrame:
    """n, mean, std, unbiased skewness and excess kurtosis, and Sharpe ratio of each trial;
    a trial without spread has zeros but for its mean."""
    v = F.col(value)
    m = returns.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("s"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    n, flat = F.col("n"), F.coalesce(F.col("s"), F.lit(0.0)) == 0
    skew = F.when(flat | (n < 3), 0.0).otherwise(F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1)) * F.col("g1"))
    kurt = F.when(flat | (n < 4), 0.0).otherwise((n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1)) * ((n + 1) * F.col("g2") + 6))
    sharpe = F.when(flat, 0.0).otherwise(F.try_divide(F.col("mean"), F.col("s")))
    return m.select(by, "n", "mean", F.coalesce("s", F.lit(0.0)).alias("std"), skew.alias("skewness"), kurt.alias("kurtosis"), sharpe.alias("sharpe"))


def aligned_pairs(returns: DataFrame, least_common: int = LEAST_COMMON) -> DataFrame:
    """(trial_a, trial_b, n_common, r, dist, sufficient) for each pair of trials that share a
    timestamp; r and dist are null for too few common ones or no spread."""
    rows = returns.select("trial_id", "signal_ts", "net_return_bps")
    a = rows.select(F.col("trial_id").alias("trial_a"), "signal_ts", F.col("net_return_bps").alias("x"))
    b = rows.select(F.col("trial_id").alias("trial_b"), "signal_ts", F.col("net_return_bps").alias("y"))
    pairs = a.join(b, "signal_ts").filter("trial_a < trial_b").groupBy("trial_a", "trial_b").agg(F.count("*").alias("n_common"), F.nanvl(F.corr("x", "y"), F.lit(None)).alias("c"))
    enough = F.col("n_common") >= least_common
    r = F.when(enough, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c"))))
    return pairs.select("trial_a", "trial_b", "n_common", r.alias("r"), enough.alias("sufficient")).withColumn("dist", F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.col("r")))))


def singletons(trials: DataFrame, pairs: DataFrame) -> DataFrame:
    """Trials without any sufficiently overlapping partner."""
    good = pairs.filter("sufficient")
    partners = good.select(F.col("trial_a").alias("trial_id")).unionByName(good.select(F.col("trial_b").alias("trial_id")))
    return trials.select("trial_id").distinct().join(partners, "trial_id", "left_anti")


def average_linkage(distance: np.ndarray, cut: float = CUT) -> np.ndarray:
    """Cluster numbers of the rows, by merging the closest pair of clusters (mean distance)
    while it is not further apart than ``cut``; the plain version of ``clusters``."""
    d, size = distance.astype(float).copy(), np.ones(len(distance))
    np.fill_diagonal(d, np.inf)
    member = np.arange(len(d))
    while len(d) > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] <= cut:
            break
        i, j = min(i, j), max(i, j)
        joined = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1] + 1


def _means() -> tuple[Column, Column]:
    """Number of known pairs of two clusters, and their mean distance, where unknown pairs
    count as the largest distance; ``na`` and ``nb`` are the clusters' sizes."""
    size = F.col("na") * F.col("nb")
    return size, (F.col("total") + (size - F.col("known")) * FAR) / size


def clusters(trials: DataFrame, pairs: DataFrame, scope: str = "scope", cut: float = CUT) -> DataFrame:
    """(scope, trial_id, cluster): the effective trials of each scope by average linkage, a
    cluster named by the least of its trials. ``trials`` has (scope, trial_id), ``pairs``
    what aligned_pairs gives. Unknown distances count as the largest.

    Average linkage is reducible: what is merged never comes closer to a third cluster than
    the nearer of its parts was. So clusters that are each other's nearest, no further apart
    than ``cut``, may be merged all at once, in any order, with the result of merging the
    closest pair again and again. Each round finds every cluster's nearest one, of equal
    means the one of the least name, merges the mutual pairs, and adds up the table of
    distances (sums and counts of known pairs, as mean distances of unions follow from
    these) under the new names. Rows of the table only become fewer, and no task holds the
    distances of a component, let alone of a scope. Rounds end when no mutual pair is left
    within ``cut``; the closest pair always is one, so a round merges something.

    Clusters merge only if some pair of their trials is within ``cut``, so the table starts
    with the components of such pairs, and trials in none are clusters of their own.
    """
    spark = trials.sparkSession
    members = trials.select(scope, "trial_id").distinct()
    known = pairs.filter("sufficient").select("trial_a", "trial_b", F.least(F.greatest(F.coalesce("dist", F.lit(FAR)), F.lit(0.0)), F.lit(FAR)).alias("dist"))
    inside = known.join(members.withColumnRenamed("trial_id", "trial_a"), "trial_a").join(members.withColumnRenamed("trial_id", "trial_b"), [scope, "trial_b"])
    inside, inside_at = staged(inside.select(scope, "trial_a", "trial_b", "dist"), "distances")
    name = lambda c: F.to_json(F.struct(scope, F.col(c).alias("trial_id")))  # noqa: E731  a trial may be in several scopes
    parts, parts_at = components(inside.filter(F.col("dist") <= cut).select(name("trial_a").alias("a"), name("trial_b").alias("b")))
    both = parts.unionByName(parts.select(F.col("component").alias("id"), "component").distinct())
    rows = inside.withColumns({"_a": name("trial_a"), "_b": name("trial_b")}).join(both.select(F.col("id").alias("_a"), F.col("component").alias("part")), "_a").join(both.select(F.col("id").alias("_b"), F.col("component").alias("other")), "_b").filter("part = other")
    ends = lambda d: (F.least("trial_a", "trial_b") if d else F.greatest("trial_a", "trial_b"))
    one = F.lit(1).cast("bigint")
    table, table_at = staged(rows.select(scope, ends(True).alias("a"), ends(False).alias("b"), one.alias("na"), one.alias("nb"), one.alias("known"), F.col("dist").alias("total")), "linkage")
    of, of_at = staged(members.withColumn("cluster", F.col("trial_id")), "clusters")
    drop_staged(spark, inside_at, parts_at)
    while True:
        _, mean = _means()
        near = table.withColumn("d", mean).filter(F.col("d") <= cut)
        each = near.select(scope, "d", F.col("a").alias("c"), F.col("b").alias("to")).unionByName(near.select(scope, "d", F.col("b").alias("c"), F.col("a").alias("to")))
        nearest = each.groupBy(scope, "c").agg(F.min(F.struct("d", "to")).alias("m")).select(scope, "c", F.col("m.to").alias("to"))
        back = nearest.select(scope, F.col("c").alias("to"), F.col("to").alias("c"))
        merged, merged_at = staged(nearest.join(back, [scope, "c", "to"]).filter("to < c").select(scope, F.col("c").alias("gone"), F.col("to").alias("into")), "merges")
        if not merged.limit(1).count():
            drop_staged(spark, merged_at, table_at)
            return of
        sizes = table.select(scope, F.col("a").alias("c"), F.col("na").alias("n")).unionByName(table.select(scope, F.col("b").alias("c"), F.col("nb").alias("n"))).distinct()
        became = sizes.join(merged.withColumnRenamed("gone", "c"), [scope, "c"], "left").select(scope, "c", "n", F.coalesce("into", "c").alias("now"))
        total = became.groupBy(scope, "now").agg(F.sum("n").alias("size"))
        named = became.join(total, [scope, "now"]).select(scope, "c", "now", "size")
        as_ = lambda side: named.select(scope, F.col("c").alias(side), F.struct("now", "size").alias(f"_{side}"))  # noqa: E731, B023
        moved = table.join(as_("a"), [scope, "a"]).join(as_("b"), [scope, "b"]).filter("_a.now <> _b.now")
        low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
        moved = moved.select(scope, low["now"].alias("a"), high["now"].alias("b"), low["size"].alias("na"), high["size"].alias("nb"), "known", "total")
        table, new = staged(moved.groupBy(scope, "a", "b", "na", "nb").agg(F.sum("known").alias("known"), F.sum("total").alias("total")), "linkage")
        drop_staged(spark, table_at)
        table_at = new
        of, new = staged(of.join(merged.withColumnRenamed("gone", "cluster"), [scope, "cluster"], "left").select(scope, "trial_id", F.coalesce("into", "cluster").alias("cluster")), "clusters")
        drop_staged(spark, of_at, merged_at)
        of_at = new


@F.pandas_udf(BooleanType())
def false_pass(passes: pd.Series, runs: pd.Series) -> pd.Series:
    """Whether null runs passed seldom enough, by the exact upper bound of the rate."""
    return pd.Series([false_pass_gate(int(k), int(n)) for k, n in zip(passes, runs, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def detection(found: pd.Series, runs: pd.Series) -> pd.Series:
    """Whether planted edges were found often enough, by the exact lower bound of the rate."""
    return pd.Series([detection_gate(int(k), int(n)) for k, n in zip(found, runs, strict=True)], dtype=bool)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """The normal distribution: its density integrated from 0 by Gauss's rule, exact to
    double precision; beyond 9 nothing is left."""
    x = np.clip(z.to_numpy(float), -9.0, 9.0)
    nodes, weights = np.polynomial.legendre.leggauss(64)
    at = (nodes[:, None] + 1) / 2 * x
    return pd.Series(np.clip(0.5 + weights @ np.exp(-at * at / 2) * x / 2 / np.sqrt(2 * np.pi), 0.0, 1.0))


@F.pandas_udf(DoubleType())
def best_of(sigma: pd.Series, n: pd.Series) -> pd.Series:
    """Of one row a scope."""
    return pd.Series([expected_max_sharpe(s, k) for s, k in zip(sigma, n, strict=True)])


def deflated_sharpe(moments: DataFrame, members: DataFrame, scope: str = "scope", level: float = 0.95) -> DataFrame:
    """The probability that each trial's Sharpe ratio beats what the best of the scope's
    effective trials would show without skill. ``members`` is what clusters() gives. Trials
    of fewer than two returns have no value."""
    rows = members.join(moments, "trial_id")
    scopes = rows.groupBy(scope).agg(F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("sigma"), F.count_distinct("cluster").alias("effective"))
    rows = rows.join(scopes.withColumn("best", best_of("sigma", "effective")), scope)
    sr, spread = F.col("sharpe"), (F.col("kurtosis") + 2) / 4
    variance = (1 - F.col("skewness") * sr + spread * sr * sr) / F.greatest(F.col("n") - 1, F.lit(1))
    rows = rows.withColumn("se", F.sqrt(F.greatest(F.lit(1e-12), variance)))
    rows = rows.withColumn("z", F.when(F.col("n") >= 2, (sr - F.col("best")) / F.col("se")))
    rows = rows.withColumn("dsr", F.when(F.col("z").isNotNull(), normal_cdf(F.coalesce("z", F.lit(0.0)))))
    return rows.select(scope, "trial_id", "n", "sharpe", "sigma", "effective", "best", "se", "z", "dsr", (F.col("dsr") >= level).alias("passes"))
