"""MinHash near-duplicate detection with odd sketches.

1. One pass gives each document its shingle-set size, a hash of the whole set, the band
   keys of 128 MinHashes, and an odd sketch: MinHash samples of one permutation in BINS
   bins (the least hash of each bin that has one), folded into a bitmap by parity.
2. Documents of equal sets are one class, of which the smallest id takes part further.
3. Classes in a common band bucket are candidates. Each member of a bucket is paired with
   the bucket's smallest id only, so that a bucket of m members gives m pairs. The XOR
   population count of two odd sketches estimates how many samples differ; pairs with more
   than a pair at the threshold can show (by five deviations of the samples and of the
   bitmap) go. The others are confirmed on the full shingle sets of their texts.
4. Members of buckets that are not one component then are searched again, by their least
   common shingles. In one order of all shingles, by the number of sets that have them, the
   first shingle that two sets of similarity t share is among the first n - ceil(t n) + 1 of
   the larger set and the first n - ceil(2t n / (1 + t)) + 1 of the smaller, and behind it
   both have as many left as they must share. Sets of different components that meet in
   such a shingle, at such places, and whose sketches let them pass, are confirmed in the
   same way. Sets that share a long passage but differ in the rest do not meet, as what is
   common to many comes last; and members of one component are not compared with each
   other, as components that have a shingle meet before their members do. So every pair in
   a common bucket is found or already connected; a pair at the threshold shares no bucket
   with probability (1 - 0.8^4)^32, under 1e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import by_id, drop_staged, lean, slices, staged, table
from barlab.operators.graph import components
from barlab.llm.decontaminate import arrow_type

BANDS, ROWS, BITS, BINS, DEVIATIONS = 32, 4, 2048, 8192, 5
SALTS = 64  # tasks that a very common centre's pairs are dealt to
SLICE_BYTES, CACHE = 1 << 20, 150_000
_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct word shingles of texts, as sorted 64-bit hashes."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.hash, self.seen = size, xxhash.xxh3_64_intdigest, {}

    def _word(self, word: bytes) -> int:
        if len(self.seen) >= CACHE:
            self.seen.clear()
        self.seen[word] = h = self.hash(word)
        return h

    def __call__(self, text: bytes | None) -> np.ndarray:
        tokens = (text or b"").lower().split()  # ASCII case and ASCII white space only
        get, word = self.seen.get, self._word
        h = np.array([get(w) or word(w) for w in tokens], np.uint64)
        k = min(self.size, len(h))
        if not k:
            return h
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = (out + h[j : len(h) - k + 1 + j]) * STEP
        return np.unique(mix(out))


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of the MinHash samples of sorted hashes, as 64-bit words: their highest
    bits are the bin, so each bin's least hash is the first."""
    which = hashes >> np.uint64(64 - (BINS - 1).bit_length())
    samples = hashes[np.concatenate([[True], which[1:] != which[:-1]])[: len(hashes)]]
    bits = np.bincount((samples >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(size: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("n", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def part(ids: pa.Array, sets: list[np.ndarray], digest) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        keys = np.zeros((0, BANDS), np.int64)
        if full:
            joined = np.concatenate(full)
            starts = np.cumsum([0, *map(len, full[:-1])])
            least = np.stack([np.minimum.reduceat(joined * m + a, starts) for m, a in zip(MULTIPLY, ADD, strict=True)])
            band = least.reshape(BANDS, ROWS, len(full))
            key = np.arange(BANDS, dtype=np.uint64)[:, None] * STEP
            for r in range(ROWS):
                key = mix((key + band[:, r]) * STEP)
            keys = key.T.view(np.int64)
        rows = iter(keys)
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([next(rows) if len(s) else None for s in sets], schema.field("bands").type),
            pa.array([odd_sketch(s) if len(s) else None for s in sets], schema.field("odd").type),
        ], schema=schema)

    def run(batches):
        import xxhash

        shingle = Shingler(size)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in slices(pa.compute.binary_length(texts).fill_null(0).to_pylist(), SLICE_BYTES):
                yield part(batch.column(0).slice(a, b - a), [shingle(t) for t in texts[a:b].to_pylist()], xxhash.xxh3_128_digest)

    return run


def may_link(percent: int):
    """Condition on two rows x and y of (n, odd): sizes and odd sketches leave room for the
    similarity t. A union of u = r B shingles fills B (1 - e^-r) of B bins, whose least
    hashes are a sample of it without replacement, and a share of 1 - t of which, never more
    than all that the sets differ in, is in one set only; such a one differs in a second
    sample where the other set fills its bin, too. m odd elements set
    N / 2 (1 - e^-2m/N) bits of N."""
    t, union = percent / 100, (F.col("x.n") + F.col("y.n")) / (1 + percent / 100)
    r = union / BINS
    filled = BINS * (1 - F.exp(-r))
    spread = F.sqrt(filled * t * (1 - t) * F.greatest(F.lit(0.0), 1 - filled / union))
    alone = F.least(union * (1 - t), filled * (1 - t) + DEVIATIONS * spread + 1)
    twice = alone * (1 - F.exp(-r))
    differ = F.least(2 * alone, alone + twice + DEVIATIONS * F.sqrt(twice) + 1)
    bits = BITS / 2 * (1 - F.exp(-2 * differ / BITS)) + DEVIATIONS / 2 * F.sqrt(BITS * (1 - F.exp(-4 * differ / BITS)))
    count = sum((F.bit_count(F.col("x.odd")[i].bitwiseXOR(F.col("y.odd")[i])) for i in range(BITS // 64)), F.lit(0))
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    return sizes & (count <= F.least(differ, bits))


def confirm(size: int, percent: int, id_type: pa.DataType):
    """From rows (b, salt, side, id, texts) in order, a centre b of side 0 before those of
    side 1 that it may be linked with: (id, b) whose full shingle sets are similar enough;
    ids that stand for several texts link by any of them."""
    schema = pa.schema([("a", id_type), ("b", id_type)])

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    def run(batches):
        shingle, centre = Shingler(size), []
        for batch in batches:
            keep = []
            for i, side in enumerate(batch.column(2).to_pylist()):
                sets = [s for s in (shingle(t.encode()) for t in batch.column(4)[i].as_py()) if len(s)]
                if side == 0:
                    centre = sets
                elif any(similar(x, y) for x in sets for y in centre):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(0).take(at)], schema=schema)

    return run


def shingle_sets(size: int, id_type: pa.DataType):
    """(id, n, hashes) for each row (id, text) with any shingle."""
    schema = pa.schema([("id", id_type), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        shingle = Shingler(size)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in slices(pa.compute.binary_length(texts).fill_null(0).to_pylist(), SLICE_BYTES):
                sets = [shingle(t).view(np.int64) for t in texts[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, schema.field("hashes").type)], schema=schema)

    return run


def find_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents``.

    Documents are linked when the Jaccard similarity of their sets of ``shingle``-word
    shingles is ``percent`` hundredths or more; a component is named by its smallest id,
    and that document is kept. Null, empty and blank texts have empty sets and no links.
    Rows that repeat an id are one document in the linking and are all returned. A row of
    a null id is linked to nothing, with a null component, and kept. Other columns are
    ignored, whatever their names.
    """
    spark, id_type = documents.sparkSession, arrow_type(documents, id_col)
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked, marked_at = staged(docs.mapInArrow(lean(sketches(shingle, id_type)), f"doc_id {kind}, n bigint, set_hash binary, bands array<bigint>, odd array<bigint>"), "sketches")
    live = marked.filter("n > 0 and doc_id is not null")
    reps, reps_at = staged(
        live.groupBy("set_hash").agg(F.min_by(F.struct("doc_id", "n", "bands", "odd"), "doc_id").alias("r")).select("r.*"), "representatives"
    )
    banded = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    centres = banded.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("centre")).filter("m > 1").drop("m")
    buckets, buckets_at = staged(banded.join(centres, "key").select("key", "id", "centre"), "buckets")
    sketch = reps.select(F.col("doc_id").alias("id"), "n", "odd")
    near = may_link(percent)

    def texts_of(ids: DataFrame) -> DataFrame:
        return by_id(docs, ids, "doc_id", "left_semi")

    def sketched(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sketch.select(F.col("id").alias("a"), F.struct("n", "odd").alias("x")), "a")
        return pairs.join(sketch.select(F.col("id").alias("b"), F.struct("n", "odd").alias("y")), "b").filter(near).select("a", "b")

    def verified(pairs: DataFrame) -> tuple[DataFrame, str]:
        pairs, pairs_at = staged(pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS))), "pairs")
        ids, ids_at = staged(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
        texts = texts_of(ids).groupBy("doc_id").agg(F.collect_set("text").alias("t")).withColumnRenamed("doc_id", "id")
        centres = pairs.select("b", "salt").distinct().select("b", "salt", F.lit(0).alias("side"), F.col("b").alias("id")).join(texts, "id")
        members = pairs.select("b", "salt", F.lit(1).alias("side"), F.col("a").alias("id")).join(texts, "id")
        rows = centres.unionByName(members).select("b", "salt", "side", "id", "t").repartition("b", "salt").sortWithinPartitions("b", "salt", "side")
        out = staged(rows.mapInArrow(lean(confirm(shingle, percent, id_type)), f"a {kind}, b {kind}"), "links")
        drop_staged(spark, pairs_at, ids_at)
        return out

    first = buckets.filter("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    links, links_at = verified(sketched(first))
    labels, labels_at = components(links)

    rest = buckets.filter("id <> centre").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    split = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    open_, open_at = staged(rest.join(split, "key", "left_semi").groupBy(F.col("id").alias("doc_id")).agg(F.min("label").alias("label")), "open")
    sets = texts_of(open_.select("doc_id")).mapInArrow(lean(shingle_sets(shingle, id_type)), f"id {kind}, n bigint, hashes array<bigint>")
    rows, rows_at = staged(sets.select("id", "n", F.xxhash64("hashes").alias("set"), F.explode("hashes").alias("h")), "shingles")
    rows = rows.join(rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "h")  # what one set has comes first and joins nothing
    own = Window.partitionBy("id", "n", "set")  # an id may have several texts
    rows = rows.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h")))
    rows = rows.filter(F.col("place") <= F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1)
    rare, rare_at = staged(rows.select("h", "id", "n", "place").distinct().join(open_.withColumnRenamed("doc_id", "id"), "id"), "rare")
    few = rare.filter(F.col("place") <= F.col("n") - F.expr(f"(n * {2 * percent} + {99 + percent}) div {100 + percent}") + 1)
    # sets of one component and size are one group until two groups turn out to be near enough
    grouped = lambda df, name: df.groupBy("h", "label", "n").agg(F.max(F.col("n") - F.col("place")).alias("left")).alias(name)
    enough = lambda p, q: F.floor(((p + q) * percent + 99 + percent) / (100 + percent))
    x, y = grouped(few, "x"), grouped(rare, "y")
    near_sizes = (F.col("x.n") <= F.col("y.n")) & (F.col("x.n") * 100 >= F.col("y.n") * percent)
    fit = (F.col("x.h") == F.col("y.h")) & (F.col("x.label") != F.col("y.label")) & near_sizes & (1 + F.least("x.left", "y.left") >= enough(F.col("x.n"), F.col("y.n")))
    apart = x.join(y, fit).select("x.h", F.col("x.label").alias("one"), F.col("x.n").alias("p"), F.col("y.label").alias("other"), F.col("y.n").alias("q"))
    side = lambda df, label, size, name: df.select("h", F.col("label").alias(label), F.col("n").alias(size), F.col("id").alias(name), (F.col("n") - F.col("place")).alias(f"_{name}"))
    met = apart.join(side(few, "one", "p", "x"), ["h", "one", "p"]).join(side(rare, "other", "q", "y"), ["h", "other", "q"])
    met = met.filter((1 + F.least("_x", "_y") >= enough(F.col("p"), F.col("q"))) & ((F.col("p") < F.col("q")) | (F.col("x") < F.col("y"))))
    second = sketched(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    more, more_at = verified(second)
    final, final_at = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    classes = live.groupBy("set_hash").agg(F.min("doc_id").alias("id")).join(final, "id", "left")
    classes, classes_at = staged(classes.select("set_hash", F.coalesce("component", "id").alias("class")), "classes")
    # rows of one id are one document: its component is the least that its texts reach
    out = marked.select("doc_id", "n", "set_hash").join(classes, "set_hash", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))
    out, _ = staged(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups")
    drop_staged(spark, marked_at, reps_at, buckets_at, links_at, labels_at, open_at, rows_at, rare_at, more_at, final_at, classes_at)
    return out


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` that stay: one of each group of near-duplicates, the one
    of the smallest id, and all of null ids. Of rows that repeat an id and stay, the one of
    the least text stays, of equal texts one by a hash of the whole row."""
    groups = find_groups(documents, id_col=id_col, text_col=text_col, **options)
    gone, _ = staged(groups.filter("not kept").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    out = by_id(documents, gone, id_col, "left_anti").select(documents.columns)
    if not groups.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return out
    order = Window.partitionBy(id_col).orderBy(text_col, F.xxhash64(*(F.col(f"`{c}`") for c in documents.columns)))
    first = out.filter(F.col(id_col).isNotNull()).withColumn("__first", F.row_number().over(order)).filter("__first = 1").drop("__first")
    return first.unionByName(out.filter(F.col(id_col).isNull()))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, by 4-word shingles at 0.8."""
    return find_groups(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def brute_force(documents: list[tuple], size: int = 4, percent: int = 80) -> dict:
    """doc_id -> (set size, component), by comparing all pairs; for small tests."""
    sets = {}
    for doc, text in documents:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in ids}
