"""Hard negatives by norm-bucketed inner-product search, exact in whole numbers.

Candidates are sorted by norm, longest first, and dealt to buckets; a bucket is a run of
blocks, each with the largest norm in it. Anchors are dealt to chunks of alike needs. A
chunk reads the buckets in that order and holds, for each anchor and window of scores, the
best rows so far. By Cauchy and Schwarz no row of a block scores above the anchor's norm
times the block's; so an anchor leaves a block out when that is below the window's lower
limit or below the score of the last row it holds, and a chunk never receives the buckets
that all its anchors leave out. The search has two waves: the longest eighth of the
buckets, then the others, in groups that run side by side and begin with the scores that
the first wave has reached. What a group finds, a few rows for each window, is merged by a
window function.

First the positives of each anchor are searched for, in one window without limits; then
the negatives, in a window for each positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import drop_staged, lean, staged, table

BLOCK, CHUNK, MOST_BUCKETS = 4096, 512, 4096  # rows, anchors, buckets
LAST = (1 << 63) - 1  # orders null ids behind all others
LOOSE = 1 + 1e-9  # norms are rounded
FOUND = "anchor bigint, slot int, score bigint, id bigint, rid bigint"


def numbers(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False)
    return out


def blocks(width: int):
    """Rows (bucket, high, rid, id, label, body) of up to BLOCK rows (rid, id, label, norm, x)
    that come by falling norm; those of a block by id, so that the first of equal scores
    goes first. ``body`` is the matrix in the fewest bytes that hold it."""
    names = ["bucket", "high", "rid", "id", "label", "body"]

    def block(bucket: int, rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("id", "ascending"), ("rid", "ascending")]).combine_chunks()
        x = numbers(rows["x"].combine_chunks(), width)
        kind = next(t for t in (np.int16, np.int32, np.int64) if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
        lists = [pa.array([rows[c].to_numpy().tobytes()], pa.binary()) for c in ("rid", "id", "label")]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([float(rows["norm"].to_numpy().max())]), *lists, pa.array([x.astype(kind).tobytes()], pa.binary())], names=names)

    def run(batches):
        bucket, held = TaskContext.get().partitionId(), []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield block(bucket, rows.slice(0, BLOCK))
                held = rows.slice(BLOCK).to_batches()
        if sum(map(len, held)):
            yield block(bucket, pa.Table.from_batches(held))

    return run


class Chunk:
    """Anchors, each with windows (low, high) of scores, and the best rows of each window."""

    def __init__(self, anchors: pa.StructArray, width: int, k: int, same: bool):
        self.k, self.same = k, same
        self.rid, self.label, self.norm = (anchors.field(c).to_numpy(zero_copy_only=False) for c in ("rid", "label", "norm"))
        self.x = numbers(anchors.field("x"), width)
        slots = anchors.field("slots")
        self.owner = np.repeat(np.arange(len(self.rid)), pa.compute.list_value_length(slots).to_numpy(zero_copy_only=False))
        flat = pa.compute.list_flatten(slots)
        self.slot, self.low, self.high, self.floor = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("slot", "low", "high", "floor"))
        self.best = np.zeros((0, 4), np.int64)  # window, score, id, rid

    def add(self, high: float, rid: np.ndarray, id_: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        bound = self.norm * high * LOOSE
        least = np.maximum(self.low, self.floor)
        windows = np.flatnonzero(bound[self.owner] >= least)
        if not len(windows):
            return
        used, at = np.unique(self.owner[windows], return_inverse=True)
        most = float(bound[used].max())
        if most >= 2.0**63:
            raise OverflowError("scores do not fit 64 bits")
        # sums below 2^53 are exact as floating-point numbers, in any order
        scores = (self.x[used].astype(float) @ x.T.astype(float)).astype(np.int64) if most < 2.0**53 else self.x[used] @ x.T.astype(np.int64)
        fit = (self.label[used][:, None] == label) == self.same
        if self.same:
            fit &= self.rid[used][:, None] != rid
        for w, i in zip(windows.tolist(), at.tolist(), strict=True):
            s = scores[i]
            good = np.flatnonzero(fit[i] & (s >= least[w]) & (s <= self.high[w]))
            if len(good) > self.k:  # the first k by falling score; equal ones keep their order
                s_ = s[good]
                last = np.partition(s_, len(s_) - self.k)[len(s_) - self.k]
                above, ties = good[s_ > last], good[s_ == last]
                good = np.concatenate([above, ties[: self.k - len(above)]])
            if len(good):
                self.best = np.concatenate([self.best, np.stack([np.full(len(good), w), s[good], id_[good], rid[good]], 1)])
        w, s, i, r = self.best.T
        self.best = self.best[np.lexsort((r, i, -s, w))]
        w = self.best[:, 0]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        self.best, place = self.best[place < self.k], place[place < self.k]
        full = self.best[place == self.k - 1]
        self.floor = self.floor.copy()
        self.floor[full[:, 0]] = np.maximum(self.floor[full[:, 0]], full[:, 1])

    def rows(self) -> pa.RecordBatch:
        w, s, i, r = self.best.T
        return pa.RecordBatch.from_arrays([pa.array(self.rid[self.owner[w]]), pa.array(self.slot[w], pa.int32()), pa.array(s), pa.array(i), pa.array(r)], names=["anchor", "slot", "score", "id", "rid"])


def searched(width: int, k: int, same: bool):
    """Rows (chunk, group, kind, bucket, anchors, high, rid, id, label, body): a chunk's
    anchors, kind 0, before the blocks of a group of buckets, by falling norm."""

    def run(batches):
        now, chunk = None, None
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for i, (c, group, kind) in enumerate(keys):
                if (c, group) != now:
                    if chunk is not None:
                        yield chunk.rows()
                    now, chunk = (c, group), None
                if kind == 0:
                    chunk = Chunk(batch.column(4)[i].values, width, k, same)
                    continue
                rid, id_, label = (np.frombuffer(batch.column(j)[i].as_py(), np.int64) for j in (6, 7, 8))
                body = batch.column(9)[i].as_py()
                x = np.frombuffer(body, f"i{len(body) // (len(rid) * width)}" if width else np.int64).reshape(len(rid), width)
                chunk.add(batch.column(5)[i].as_py(), rid, id_, label, x)
        if chunk is not None:
            yield chunk.rows()

    return run


def _wave(anchors: DataFrame, packed: DataFrame, highs: list[float], first: int, stop: int, width: int, k: int, same: bool) -> DataFrame:
    """What the buckets from ``first`` to ``stop`` have for anchors (rid, label, norm, x, slots)."""
    spark = anchors.sparkSession
    need = F.when(F.col("norm") > 0, F.array_min(F.transform("slots", lambda s: F.greatest(s["low"], s["floor"]))).cast("double") / F.col("norm")).otherwise(F.lit(-1.0))
    kinds = anchors.withColumn("need", need).withColumn("class", F.when(F.col("need") > 0, F.floor(F.log2("need") * 4)).otherwise(F.lit(-10_000)))
    sizes = kinds.groupBy("class").count().collect()  # powers of two that a number can have, at most some thousands
    if not sizes:
        return spark.createDataFrame([], FOUND)
    parts = spark.createDataFrame([(r["class"], -(-r["count"] // CHUNK)) for r in sizes], "class bigint, parts bigint")
    chunk = F.concat_ws(":", "class", F.pmod(F.xxhash64("rid"), F.col("parts")))
    chunks = kinds.join(F.broadcast(parts), "class").groupBy(chunk.alias("chunk")).agg(F.min("need").alias("need"), F.collect_list(F.struct("rid", "label", "norm", "x", "slots")).alias("anchors"))
    width_ = max(4, (stop - first) // 64)  # buckets of a group
    wanted = F.size(F.filter(F.lit(highs[first:stop]), lambda h: h * LOOSE >= F.col("need")))  # buckets of falling norm: the first ones
    chunks = chunks.withColumn("wanted", wanted).filter("wanted > 0")
    chunks = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.expr(f"cast((wanted - 1) div {width_} as int)"))))
    near = packed.filter(F.col("bucket").between(first, stop - 1)).withColumn("group", F.expr(f"cast((bucket - {first}) div {width_} as int)"))
    sent = chunks.select("chunk", "group", "wanted").join(near, "group").filter(F.col("bucket") - first < F.col("wanted"))
    null = lambda c: F.lit(None).cast(dict(packed.dtypes)[c]).alias(c)
    rows = chunks.select("chunk", "group", F.lit(0).alias("kind"), null("bucket"), "anchors", *(null(c) for c in packed.columns[1:]))
    rows = rows.unionByName(sent.select("chunk", "group", F.lit(1).alias("kind"), "bucket", F.lit(None).cast(dict(chunks.dtypes)["anchors"]).alias("anchors"), *packed.columns[1:]))
    return rows.repartition("chunk", "group").sortWithinPartitions("chunk", "group", "kind", "bucket", F.desc("high")).mapInArrow(lean(searched(width, k, same)), FOUND)


def best(anchors: DataFrame, packed: DataFrame, highs: list[float], width: int, k: int, same: bool, name: str) -> tuple[DataFrame, str]:
    """(anchor, slot, rank, score, id): the first ``k`` rows of each window of the anchors
    (rid, label, norm, x, slots), and the table's path."""
    spark, cut = anchors.sparkSession, max(1, len(highs) // 8)
    one, one_at = staged(_wave(anchors, packed, highs, 0, cut, width, k, same), name)
    paths, found = [one_at], one
    if cut < len(highs):
        reached = one.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
        reached = reached.groupBy(F.col("anchor").alias("rid")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("reached"))
        raised = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["low"].alias("low"), s["high"].alias("high"), F.coalesce(F.element_at("reached", s["slot"]), s["floor"]).alias("floor")))
        rest = anchors.join(reached, "rid", "left").withColumn("slots", raised).drop("reached")
        two, two_at = staged(_wave(rest, packed, highs, cut, len(highs), width, k, same), name)
        paths, found = [*paths, two_at], one.unionByName(two)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "rid")
    out = staged(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("anchor", "slot", "rank", "score", "id"), name)
    drop_staged(spark, *paths)
    return out


def hard_negatives(vectors: DataFrame, anchor: Column, *, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are cut to ``floor(scale * x)``; a score is the inner product of two rows,
    and higher ones come first, equal ones by the smaller id. Rows that ``anchor`` holds for
    are anchors. An anchor's positives are the first rows of its label but itself; the
    negatives of a positive are the first rows of other labels that score from ``low`` to
    ``high`` hundredths of it. Ids and labels are whole numbers.

    Rows with a null label or vector, or any null or non-finite component, take no part;
    shorter vectors count as filled up with zeros, and a null id comes behind all others.
    Rows that repeat an id, or all, are rows of their own: each is a candidate, and each an
    anchor with rows of the result. Other columns are ignored, an empty table gives no rows,
    and scores beyond 64 bits stop the query.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(sound)
    x = F.transform("v", lambda c: F.floor(c.cast("double") * scale))
    rows = rows.select("id", "label", "anchor", x.alias("x")).withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))
    rows, rows_at = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width")).first()
    buckets = max(1, min(MOST_BUCKETS, -(-size.n // BLOCK)))
    ordered = rows.select("rid", "id", "label", "norm", "x").repartitionByRange(buckets, F.desc("norm"), "rid").sortWithinPartitions(F.desc("norm"), "rid")
    packed, packed_at = staged(ordered.mapInArrow(lean(blocks(size.width)), "bucket int, high double, rid binary, id binary, label binary, body binary"), "blocks")
    ends = {r.bucket: r.high for r in packed.groupBy("bucket").agg(F.max("high").alias("high")).collect()}  # MOST_BUCKETS at most
    highs, above = [], 0.0
    for b in range(max(ends, default=-1), -1, -1):  # an empty bucket is as high as the next
        above = max(above, ends.get(b, 0.0))
        highs.insert(0, above)

    slot = "array<struct<slot:int,low:bigint,high:bigint,floor:bigint>>"
    anchors = rows.filter("anchor").select("rid", "id", "label", "norm", "x")
    whole = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-LAST).alias("low"), F.lit(LAST).alias("high"), F.lit(-LAST).alias("floor"))).cast(slot)
    near, near_at = best(anchors.withColumn("slots", whole), packed, highs, size.width, positives, True, "positives")
    part = lambda way, p: F.expr(f"cast({way}(cast(score as decimal(20, 0)) * {p} / 100) as bigint)")
    windows = near.select("anchor", F.col("rank").alias("slot"), part("ceil", low).alias("low"), part("floor", high).alias("high")).filter("low <= high")
    windows = windows.groupBy(F.col("anchor").alias("rid")).agg(F.collect_list(F.struct("slot", "low", "high", F.lit(-LAST).alias("floor"))).cast(slot).alias("slots"))
    far, far_at = best(anchors.join(windows, "rid"), packed, highs, size.width, negatives, False, "negatives")

    known = lambda c: F.nullif(F.col(c), F.lit(LAST))
    pairs = near.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    out = far.withColumnsRenamed({"id": "negative", "score": "negative_score"}).join(pairs, ["anchor", "slot"]).join(anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("own")), "anchor")
    out, _ = staged(out.select(known("own").alias("anchor_id"), known("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative").alias("negative_id"), "positive_score", "negative_score"), "hard-negatives")
    drop_staged(spark, rows_at, packed_at, near_at, far_at)
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=label)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def brute_force(rows: list[tuple], scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> list[tuple]:
    """Sorted rows of the result for (id, label, vector, whether it is an anchor), by scoring all."""
    import math

    sound = [r for r in rows if r[1] is not None and r[2] is not None and all(c is not None and math.isfinite(c) for c in r[2])]
    x = [[math.floor(scale * c) for c in r[2]] for r in sound]
    key = lambda t: (-t[0], LAST if t[1] is None else t[1])
    out = []
    for a, (own, label, _, anchor) in enumerate(sound):
        if not anchor:
            continue
        scored = [(sum(p * q for p, q in zip(x[a], x[b], strict=False)), r[0], r[1] == label) for b, r in enumerate(sound) if b != a]
        for p, pid, _ in sorted((t for t in scored if t[2]), key=key)[:positives]:
            fit = sorted((t for t in scored if not t[2] and low * p <= 100 * t[0] <= high * p), key=key)[:negatives]
            out += [(own, pid, i, nid, p, n) for i, (n, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=str)
