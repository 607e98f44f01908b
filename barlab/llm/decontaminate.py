"""Benchmark decontamination: an FM-index for each shard of training documents, in which
test phrases are found by backward search.

A shard is a run of documents of bounded size inside one task. Words that no phrase has
can be part of no occurrence, so the shard's index holds the maximal runs of phrase words
that are at least as long as the shortest phrase, set apart by a separator, and the place
of each word in its document. No row is shuffled; the phrases travel to the documents in
blocks of bounded size, one pass over the documents for each block, and every pass merges
its hits into the columns that the pass before has left. After PASSES of them the rows are
staged and the blocks let go, so that a benchmark of any size holds that many at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import drop_staged, lean, slices, staged
from barlab.llm.fm_index import FMIndex

#: Words: digits, lower-cased ASCII letters and all bytes of characters beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD_BYTES, SLICE_BYTES, BLOCK_BYTES, PASSES = 8 << 20, 2 << 20, 4 << 20, 4
HITS = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:bigint,stop:bigint>>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Phrases:
    """Windows of test items as ids of their words, by length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[i : i + window])].add(item)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for phrase in owners:
            by_length[len(phrase)].append(phrase)
        self.groups = [(np.array(p), [sorted(owners[x]) for x in p]) for p in by_length.values()]
        self.shortest = min(by_length, default=0)


class Shard:
    """Documents whose phrase-word runs are indexed together."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.n_words, self.bytes = phrases, [], 0
        self.text, self.places, self.total = [], [], 0

    def add(self, texts: list[bytes | None]) -> None:
        get, ids = self.phrases.vocabulary.get, []
        for text in texts:
            tokens = words(text)
            self.n_words.append(len(tokens))
            self.bytes += len(text or b"")
            ids += [get(w, 0) for w in tokens]
            ids.append(0)
        known = np.array(ids, np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known != 0, [0]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        kept = stops - starts >= self.phrases.shortest
        starts, lengths = starts[kept], (stops - starts)[kept] + 1  # with the 0 behind the run
        if len(starts):
            inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            places = np.repeat(starts, lengths) + inner
            self.text.append(known[places])
            self.places.append(places + self.total)
        self.total += len(known)

    def hits(self) -> list[tuple[int, list[str], list[tuple[int, int]]]]:
        """For each document: its words, the items that occur, the merged spans."""
        n_words = np.array(self.n_words, np.int64)
        begin = np.cumsum(n_words + 1) - n_words - 1
        change, found = np.zeros(self.total + 1, np.int64), defaultdict(set)
        if self.text:
            places = np.concatenate(self.places)
            index = FMIndex(np.concatenate(self.text), len(self.phrases.vocabulary) + 1)
            for group, owners in self.phrases.groups:
                low, high = index.ranges(group)
                which = np.repeat(np.arange(len(group)), high - low)
                if not len(which):
                    continue
                inner = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                at = places[index.locate(low[which] + inner)]
                np.add.at(change, at, 1)
                np.add.at(change, at + group.shape[1], -1)
                documents = np.searchsorted(begin, at, "right") - 1
                for d, w in np.unique(np.stack([documents, which]), axis=1).T.tolist():
                    found[d].update(owners[w])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change) > 0, [0]]).astype(np.int8)))
        spans = defaultdict(list)
        owner = np.searchsorted(begin, edges[::2], "right") - 1
        for d, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            spans[d].append((a - int(begin[d]), b - int(begin[d])))
        return [(n, sorted(found[d]) if d in found else [], spans[d] if d in spans else []) for d, n in enumerate(self.n_words)]


def merged(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def searcher(phrases, schema: pa.Schema, text_at: int):
    """A mapInArrow function: searches the phrases of one block in every document."""
    names = schema.names

    def finish(shard: Shard, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        old = [rows[c].to_pylist() for c in ("item_ids", "spans")]
        columns = defaultdict(list)
        for (n, items, spans), items0, spans0 in zip(shard.hits(), *old, strict=True):
            spans = merged(spans, [(s["start"], s["stop"]) for s in spans0 or []])
            columns["n_words"].append(n)
            columns["n_hit"].append(sum(b - a for a, b in spans))
            columns["item_ids"].append(sorted({*items, *(items0 or [])}))
            columns["spans"].append([{"start": a, "stop": b} for a, b in spans])
        arrays = [pa.array(columns[c], schema.field(c).type) if c in columns else rows[c].combine_chunks() for c in names]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches):
        shard, held = Shard(phrases.value), []
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
            for a, b in slices(sizes, SLICE_BYTES):
                shard.add(texts[a:b].to_pylist())
                held.append(batch.slice(a, b - a))
                if shard.bytes >= SHARD_BYTES:
                    yield finish(shard, held)
                    shard, held = Shard(phrases.value), []
        if held:
            yield finish(shard, held)

    return run


def phrase_blocks(spark, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> Iterator:
    """The benchmark's phrases as broadcasts of about ``block_bytes`` of text each."""
    benchmark = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    for block in range(n_blocks):
        part = benchmark.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        items = [(r.item, None if r.text is None else r.text.encode()) for r in part.toLocalIterator()]
        yield spark.sparkContext.broadcast(Phrases(items, window))


def find_benchmark(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in whole documents.

    Returns a row for each row of ``documents`` (repeated rows and null ids included):
    (doc_id, text, n_words, n_hit, item_ids, spans). ``spans`` are merged, half-open word
    ranges. A null or empty text has no words. An item of fewer than ``window`` words is
    one window, a null or empty one has none, a null item id counts as "". Items with equal
    windows are all listed. Other columns are ignored, whatever their names.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    df = documents.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"),
        F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
    )
    schema = pa.schema([("doc_id", arrow_type(documents, id_col)), ("text", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
    blocks = phrase_blocks(documents.sparkSession, benchmark, item_col=item_col, item_text_col=item_text_col, window=window, block_bytes=block_bytes)
    return in_passes(df, blocks, lambda rows, phrases: rows.mapInArrow(lean(searcher(phrases, schema, 1)), f"doc_id {kind}, text string, {HITS}"))


def in_passes(rows: DataFrame, blocks: Iterator, one_pass) -> DataFrame:
    """``one_pass`` of each block over the rows; rows are staged after every PASSES of them
    but the last, and the blocks that are done with are destroyed."""
    held, path = [], None
    for block in blocks:
        if len(held) == PASSES:
            old = path
            rows, path = staged(rows, "searched")
            for done in held:
                done.destroy()
            if old:
                drop_staged(rows.sparkSession, old)
            held = []
        rows = one_pass(rows, block)
        held.append(block)
    return rows


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def without_spans(text: str | None, spans: list) -> str | None:
    """The text without the words of its spans."""
    if not text or not spans:
        return text
    raw, out, at = text.encode(), [], 0
    folded, places, i = raw.translate(FOLD), [], 0
    for word in folded.split():
        i = folded.index(word, i)
        places.append((i, i := i + len(word)))
    for span in spans:
        out.append(raw[at : places[span["start"]][0]])
        at = places[span["stop"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def clean_texts(found: DataFrame) -> DataFrame:
    """Adds ``clean_text``: each text with the words of its spans taken out."""
    names = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields]

    def run(frames):
        for frame in frames:
            frame["clean_text"] = [without_spans(t, list(s)) for t, s in zip(frame["text"], frame["spans"], strict=True)]
            yield frame

    return found.mapInPandas(run, ", ".join([*names, "clean_text string"]))


def without_benchmark(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that no benchmark window occurs in, with all their columns;
    rows of null text stay. The search is that of ``find_benchmark``, block by block."""
    at = documents.columns.index("text")

    def filtering(phrases):
        def run(batches):
            for batch in batches:
                texts = batch.column(at).cast(pa.binary())
                sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
                for a, b in slices(sizes, SHARD_BYTES):
                    shard = Shard(phrases.value)
                    for c, d in slices(sizes[a:b], SLICE_BYTES):
                        shard.add(texts[a + c : a + d].to_pylist())
                    yield batch.slice(a, b - a).filter(pa.array([not spans for _, _, spans in shard.hits()], pa.bool_()))

        return run

    blocks = phrase_blocks(documents.sparkSession, benchmark, **options)
    return in_passes(documents, blocks, lambda rows, phrases: rows.mapInArrow(lean(filtering(phrases)), documents.schema))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    from barlab.llm.common import table

    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(documents: list[tuple], benchmark: list[tuple], window: int = 10) -> dict:
    """doc_id -> (n_words, n_hit, item ids), for small tests."""
    out = {}
    for doc, text in documents:
        tokens, hit, items = words(text and text.encode()), set(), set()
        for item, item_text in benchmark:
            w = words(item_text and item_text.encode())
            for i in range(max(1, len(w) - window + 1) if w else 0):
                phrase = w[i : i + window]
                for p in range(len(tokens) - len(phrase) + 1):
                    if tokens[p : p + len(phrase)] == phrase:
                        hit.update(range(p, p + len(phrase)))
                        items.add(str(item))
        out[doc] = (len(tokens), len(hit), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    return out
