"""Bar sources: CSV and Parquet scans, bars of events, file digests and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.operators.ordered import with_previous
from barlab.sources.files import dataset_digest, file_digests  # noqa: F401

BAR = "contract string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, open_interest bigint"


def filled(bars: DataFrame) -> DataFrame:
    """Missing open interest is 0; other columns stay."""
    if "open_interest" not in bars.columns:
        return bars.withColumn("open_interest", F.lit(0).cast("bigint"))
    return bars.withColumn("open_interest", F.coalesce("open_interest", F.lit(0)).cast("bigint"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return filled(spark.read.schema(BAR).csv(path, header=True))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return filled(spark.read.parquet(path))


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The Parquet file or folder at ``path``, if its digest is the registered one."""
    if dataset_digest(spark, path) != sha256:
        raise ValueError(f"{path} does not have the registered digest")
    return read_parquet(spark, path)


FEED = ("ts", "open", "high", "low", "close", "volume", "open_interest")


def missing_columns(df: DataFrame, wanted) -> list[str]:
    """Columns that a frame lacks, in the order of ``wanted``."""
    return [c for c in wanted if c not in df.columns]


def feed(bars: DataFrame) -> DataFrame:
    """Bars fit for replay; a missing column or a bar that breaks a rule is an error."""
    lack = missing_columns(bars, FEED)
    if lack:
        raise ValueError(f"the feed lacks {', '.join(lack)}")
    found = violations(bars).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.contract}: {r.rule} ({r.n})" for r in found))
    return bars


def feed_digest(bars: DataFrame, places: int = 8) -> DataFrame:
    """(contract, n, digest): a digest of each contract's seven columns, the same in any
    order of the rows: the sum of the rows' hashes, so that no task needs a contract whole."""
    text = [F.coalesce(F.format_string(f"%.{places}f", F.col(c).cast("double")) if c in FEED[1:5] else F.col(c).cast("string"), F.lit("-")) for c in FEED]
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return bars.groupBy("contract").agg(F.count("*").alias("n"), F.sum(row).alias("s")).select("contract", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("digest"))


def registry_feed(spark: SparkSession, datasets: DataFrame, version: str, *, manifest: DataFrame | None = None, zone: str | None = None, licensed: bool = True) -> DataFrame:
    """The feed of a registered dataset (version, kind, path, sha256): its file has the
    registered digest, production replay is of LICENSED data only, and the holdout is out
    of reach. With ``manifest`` and ``zone``, only that zone."""
    from barlab.operators.zones import load_zone

    found = datasets.filter(F.col("version") == version).limit(1).collect()
    if not found:
        raise KeyError(version)
    if licensed and found[0].kind != "LICENSED":
        raise PermissionError(f"{version} is {found[0].kind}, not LICENSED")
    if zone is not None and zone.lower() == "holdout":
        raise PermissionError("the holdout zone is sealed")
    rows = verified(spark, found[0].path, found[0].sha256)
    return feed(rows if zone is None or manifest is None else load_zone(rows, manifest, zone))


def register(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The dataset versions to append: the same again adds nothing, other content or a
    format but csv and parquet is an error."""
    from barlab.operators.ledger import content_digest, insert

    if new.filter(~F.lower("format").isin("csv", "parquet") | F.col("version").isNull() | (F.trim("version") == "")).limit(1).count():
        raise ValueError("versions have names, and formats are csv or parquet")
    content = ["version", "kind", "format", "path", "sha256"]
    digest = lambda df: df.select(*content, content_digest(content).alias("digest"))
    return insert(digest(new), digest(stored), ["version"]).select(*content)


def bars_of_events(events: DataFrame, positive: bool = True) -> DataFrame:
    """Hourly bars of each event type; prices of 0 or less are no prices."""
    rows = events.select("event_type", "ts", "value", "user_id")
    rows = rows.filter("value > 0") if positive else rows
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return rows.groupBy(F.col("event_type").alias("contract"), hour.alias("ts")).agg(
        F.min_by("value", rows.ts).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", rows.ts).alias("close"),
        F.count("*").alias("volume"), F.count_distinct("user_id").alias("open_interest"),
    )


def violations(bars: DataFrame) -> DataFrame:
    """(contract, rule, n): how many bars break each rule; rules nobody breaks are absent.

    Each row is judged by itself and against its predecessor in arrival order ``seq`` where
    the frame has one (else in time order), so that duplicates and disorder show. A long
    contract is judged in many tasks: see ``ordered.with_previous``.
    """
    order = "seq" if "seq" in bars.columns else "ts"
    prices = ["open", "high", "low", "close"]
    null = F.lit(False)
    for c in ("ts", *prices):
        null = null | F.col(c).isNull()
    wild = F.lit(False)
    for c in prices:
        wild = wild | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rules = {
        "null": null,
        "not_finite": wild,
        "not_positive": F.least(*prices) <= 0,
        "high_low": (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")),
        "negative_volume": (F.col("volume") < 0) | (F.col("open_interest") < 0),
        "duplicate_ts": F.col("ts") == F.col("before_ts"),
        "out_of_order": F.col("ts") < F.col("before_ts"),
    }
    judged = with_previous(bars.select("contract", "ts", *prices, "volume", "open_interest", *(["seq"] if order == "seq" else [])), "contract", order, ["ts"])
    marked = judged.select("contract", F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())).alias("rules")).select("contract", F.explode("rules").alias("rule"))
    return marked.filter("rule is not null").groupBy("contract", "rule").agg(F.count("*").alias("n"))
