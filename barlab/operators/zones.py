"""Leakage-safe zones of a calendar: sizes, purge and embargo gaps, and slicing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gaps:
    """Bars that must lie between zones."""

    feature_lookback: int = 0
    horizon: int = 0
    holding: int = 0
    forward: int = 0
    embargo: int = 0

    def __post_init__(self):
        if any(not isinstance(v, int) or isinstance(v, bool) or v < 0 for v in vars(self).values()):
            raise ValueError("gaps are whole numbers of bars, not below 0")

    @property
    def purge(self) -> int:
        return self.feature_lookback + self.horizon + self.holding + self.forward


def zone_indices(n: int, gaps: Gaps, ratios: tuple[float, float, float] = (0.5, 0.2, 0.2)) -> list[tuple[str, int, int]]:
    """(name, first, stop) over the indices of n sorted times: research, validation and
    holdout with a purge and an embargo before the latter two, and what is left forward.
    Sizes are cut to whole bars."""
    spare = 2 * (gaps.purge + gaps.embargo)
    if n < 20 or n <= spare + 10:
        raise ValueError(f"{n} bars do not suffice")
    whole = sum(ratios)
    if not 0 < whole <= 1:
        raise ValueError("ratios sum to more than 0 and at most 1")
    sizes = [max(1, int((n - spare) * (r / whole))) for r in ratios]
    out, at = [], 0
    for name, size in zip(("research", "validation", "holdout"), sizes, strict=True):
        if name != "research":
            for gap, width in (("purge", gaps.purge), ("embargo", gaps.embargo)):
                out.append((f"{name}_{gap}", at, at + width))
                at += width
        stop = min(n, at + size) if name == "holdout" else at + size
        out.append((name, at, stop))
        at = stop
    return [*out, ("forward", at, n)]


def split_manifest(times: DataFrame, gaps: Gaps, ratios: tuple[float, float, float] = (0.5, 0.2, 0.2), column: str = "ts") -> DataFrame:
    """(zone, start, stop): half-open zones of the distinct times. An index past the end
    stands for the last time, so that time may be in no zone. The driver learns the count
    and gets the dozen times at the zones' bounds; positions are numbered by month first."""
    distinct = times.select(F.col(column).alias("t")).filter("t is not null").distinct()
    n = distinct.count()
    zones = zone_indices(n, gaps, ratios)
    month = distinct.withColumn("m", F.trunc("t", "month"))
    counts = month.groupBy("m").agg(F.count("*").alias("c"))
    counts = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = month.join(counts, "m").withColumn("i", F.col("base") + F.row_number().over(Window.partitionBy("m").orderBy("t")) - 1)
    wanted = sorted({min(i, n - 1) for _, a, b in zones for i in (a, b)})
    at = {r.i: r.t for r in numbered.filter(F.col("i").isin(wanted)).select("i", "t").collect()}
    rows = [(name, at[min(a, n - 1)], at[min(b, n - 1)]) for name, a, b in zones]
    return times.sparkSession.createDataFrame(rows, f"zone string, start {dict(distinct.dtypes)['t']}, stop {dict(distinct.dtypes)['t']}")


def zone_slice(rows: DataFrame, start=None, stop=None, column: str = "ts") -> DataFrame:
    """Rows with start <= time < stop; an end that is None is open. Reaches the scan."""
    kind = rows.schema[column].dataType.simpleString()
    edge = lambda x: F.lit(str(x) if kind.startswith(("timestamp", "date")) else x).cast(kind)  # noqa: E731  as the column has it, in no other time zone
    if start is not None:
        rows = rows.filter(F.col(column) >= edge(start))
    return rows if stop is None else rows.filter(F.col(column) < edge(stop))


def manifest_faults(manifest: DataFrame, gaps: Gaps | None = None) -> list[str]:
    """What is wrong with a manifest (zone, start, stop) of a dozen rows: zones that do not
    end after they start, zones out of order or overlapping, and gaps of no width where
    ``gaps`` declare some."""
    at = {r.zone: (r.start, r.stop) for r in manifest.collect()}
    order = ["research", *(f"{z}{part}" for z in ("validation", "holdout") for part in ("_purge", "_embargo", ""))]
    missing = [z for z in order if z not in at]
    if missing:
        return [f"no {z}" for z in missing]
    faults = [f"{z} is empty" for z in ("research", "validation", "holdout") if not at[z][0] < at[z][1]]
    if "forward" in at and at["forward"][1] is not None and not at["forward"][0] <= at["forward"][1]:  # nothing may be left for it
        faults.append("forward ends before it starts")
    order += ["forward"] * ("forward" in at)
    faults += [f"{b} begins before {a} ends" for a, b in zip(order, order[1:], strict=False) if not at[a][1] <= at[b][0]]
    faults += [f"{z} ends before it starts" for z in order if "_" in z and not at[z][0] <= at[z][1]]
    for name, bars in (("purge", gaps.purge if gaps else 0), ("embargo", gaps.embargo if gaps else 0)):
        if bars > 0:
            faults += [f"{z}_{name} has no width" for z in ("validation", "holdout") if at[f"{z}_{name}"][0] == at[f"{z}_{name}"][1]]
    return faults


def overlaps(rows: DataFrame, zones: DataFrame, column: str = "ts") -> DataFrame:
    """(zone_a, zone_b, n): pairs of zones that share rows, and how many, a row that occurs
    twice counted twice; none if the zones are disjoint. A null start or stop is open.

    The zones' bounds cut time into disjoint pieces, so each row is in one piece, which it
    finds by its day; days before the first bound and behind the last count as one each. Rows
    are counted by piece, and pairs made of the zones of a piece."""
    kind = rows.schema[column].dataType.simpleString()
    bounds = zones.select(F.explode(F.array(F.col("start").cast(kind), F.col("stop").cast(kind))).alias("since")).filter("since is not null").distinct()
    ends = bounds.agg(F.date_sub(F.to_date(F.min("since")), 1).alias("first"), F.date_add(F.to_date(F.max("since")), 1).alias("last"))
    first, last = (F.coalesce(ends.select(c).scalar(), F.lit("1970-01-01").cast("date")) for c in ("first", "last"))
    order = Window.orderBy(F.asc_nulls_first("since"))  # two bounds a zone
    pieces = bounds.unionByName(rows.sparkSession.createDataFrame([(None,)], f"since {kind}")).withColumn("until", F.lead("since").over(order))
    inside = (F.col("start").isNull() | (F.col("since") >= F.col("start").cast(kind))) & (F.col("stop").isNull() | (F.col("until") <= F.col("stop").cast(kind)))
    shared = pieces.join(zones, inside).groupBy("since", "until").agg(F.array_sort(F.collect_set("zone")).alias("z")).filter(F.size("z") > 1)
    days = shared.withColumn("day", F.explode(F.sequence(F.coalesce(F.to_date("since"), first), F.coalesce(F.to_date("until"), last))))
    at = F.col(column)
    dealt = rows.select(at.alias("at"), F.least(F.greatest(F.to_date(at), first), last).alias("day")).filter("at is not null").groupBy("day", "at").agg(F.count("*").alias("n"))
    held = dealt.join(days, "day").filter("(since is null or at >= since) and (until is null or at < until)").groupBy("z").agg(F.sum("n").alias("n"))
    pairs = F.flatten(F.transform("z", lambda a: F.transform(F.filter("z", lambda b: b > a), lambda b: F.struct(a.alias("zone_a"), b.alias("zone_b")))))
    return held.select(F.explode(pairs).alias("p"), "n").groupBy("p.zone_a", "p.zone_b").agg(F.sum("n").alias("n"))


def zone_bounds(datasets: DataFrame, manifests: DataFrame, named: DataFrame, zone: str) -> DataFrame:
    """(version, kind, start, stop) of a zone in each dataset: from its manifest (version,
    zone, start, stop) if that has the zone, else from its own named zones; datasets that
    have it nowhere are left out."""
    pick = lambda df, name: df.filter(F.upper("zone") == zone.upper()).select("version", F.struct("start", "stop").alias(name))
    rows = datasets.join(pick(manifests, "m"), "version", "left").join(pick(named, "n"), "version", "left").withColumn("z", F.coalesce("m", "n"))
    return rows.filter("z is not null").select("version", "kind", "z.start", "z.stop")


def load_zone(rows: DataFrame, manifest: DataFrame, zone: str, *, named: DataFrame | None = None, kind: str | None = None, allowed_kinds: set[str] | None = None, allow_holdout: bool = False, column: str = "ts") -> DataFrame:
    """A zone of the manifest, or one of the ``named`` zones (zone, start, stop) if that has
    none of the name; the sealed holdout only on demand, only datasets of allowed kinds. An
    unknown or empty zone is an error."""
    if allowed_kinds is not None and kind not in allowed_kinds:
        raise PermissionError(f"kind {kind} is not allowed")
    if zone.lower() == "holdout" and not allow_holdout:
        raise PermissionError("the holdout zone is sealed")
    found = manifest.filter(F.lower("zone") == zone.lower()).limit(1).collect()
    if not found and named is not None:
        found = named.filter(F.lower("zone") == zone.lower()).limit(1).collect()
    if not found:
        raise KeyError(zone)
    part = zone_slice(rows, found[0].start, found[0].stop, column)
    if not part.limit(1).count():
        raise ValueError(f"zone {zone} is empty")
    return part
