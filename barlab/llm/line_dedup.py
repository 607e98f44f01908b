"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are within one edit (a character put in, taken out or changed) when a deletion
variant of one equals the other or, with the same place deleted, a variant of the other.
All variants of all lines would be as many as the text's characters, so they are made from
coarse to fine: first a quarter of the line is deleted, then sixteenths of the quarters
whose variants another line has, and so on down to single characters. A variant's key is a
hash of its place, what stands before it and what stands behind it, of 128 bits in the last
step; a place that no other line shares is dropped before it is made finer. No step pairs the lines of a bucket: in a
bucket of changes at one place all lines are within one edit of the earliest, and in one of
deletions each variant needs the one line that equals it. Candidates are verified by edit
distance at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import by_id, drop_staged, staged, table

COARSE, FINE = 4, 16


def lines_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): every line of every text, also empty ones."""
    return documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def _marked(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with a hash of 128 bits and their length."""
    full = lines.filter(F.length(F.trim("line")) > 0)
    return full.select("doc_id", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("n"))


def _split(q: Column, low: Column, high: Column, parts: int) -> Column:
    """Sub-ranges of [low, high) of a line whose pair's shorter line has q characters. The
    last one stays when it is empty, as an edit may stand at its end."""
    edge = lambda i: low + F.floor(i * (high - low) / parts).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(q.alias("q"), edge(i).alias("low"), edge(i + 1).alias("high")))
    return F.filter(pieces, lambda p: (p["low"] < p["high"]) | (p["high"] == q))


def _with_key(rows: DataFrame) -> DataFrame:
    """Adds the key of the variant that lacks [low, high) as the shorter line counts it."""
    after = F.col("q") - F.col("high")
    before, behind = F.substring("line", F.lit(1), F.col("low")), F.substring("line", F.col("n") - after + 1, after)
    return rows.withColumn("key", F.xxhash64("q", "low", "high", before, behind))


def _shared(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Keys that two different lines have; what a task has seen of a key is three numbers."""
    keys = rows.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    return staged(keys, name)


def nearest_earlier(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged tables of the distinct lines: all of them (h1, h2, first) with the place of
    their earliest copy, and (h1, h2, of) the earliest line within one edit before it."""
    spark = documents.sparkSession
    marked = _marked(lines_of(documents, id_col, text_col))
    place = F.struct("doc_id", "line_no")
    distinct, _ = staged(marked.groupBy("h1", "h2").agg(F.min(place).alias("first")), "lines")

    whole = F.concat(*(_split(q, F.lit(0), q, COARSE) for q in (F.col("n"), F.col("n") - 1)))
    rows = _with_key(marked.withColumn("piece", F.explode(whole)).select("doc_id", "line_no", "line", "h1", "h2", "n", "piece.*"))
    keys, keys_at = _shared(rows.select("h1", "key"), "keys0")
    rows = by_id(rows, keys, "key", "left_semi").groupBy("h1", "h2", "q", "low", "high").agg(F.min(place).alias("first"), F.first("line").alias("line"), F.first("n").alias("n"))
    state, state_at = staged(rows, "state0")
    drop_staged(spark, keys_at)
    step = 1
    while (state.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0) > 1:
        finer = F.when(F.col("high") - F.col("low") > 1, _split(F.col("q"), F.col("low"), F.col("high"), FINE)).otherwise(F.array(F.struct("q", "low", "high")))
        rows = state.withColumn("piece", F.explode(finer)).select("h1", "h2", "first", "line", "n", "piece.*")
        rows = _with_key(rows)
        keys, keys_at = _shared(rows.select("h1", "key"), f"keys{step}")
        rows = by_id(rows, keys, "key", "left_semi").drop("key")
        (state, path), old = staged(rows, f"state{step}"), state_at
        drop_staged(spark, old, keys_at)
        state_at, step = path, step + 1

    short = F.col("n") == F.col("q")
    # here a key stands for its earliest line before that is verified, so it has 128 bits
    named = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*parts).alias("key"), F.xxhash64(F.lit(1), *parts).alias("key2"))
    cut = lambda at: F.concat(F.substring("line", F.lit(1), at), F.substring("line", at + 2, F.col("n")))
    variants = F.when(short, F.array(
        named("change", "q", "low", F.substring("line", F.lit(1), F.col("low")), F.substring("line", F.col("low") + 2, F.col("n"))), named("whole", "line"),
    )).otherwise(F.transform(F.array_distinct(F.array(F.col("low"), F.least(F.col("low") + 1, F.col("n") - 1))), lambda at: named("lack", cut(at))))
    found = state.select("h1", "h2", "first", F.explode(variants).alias("v")).select("h1", "h2", "first", "v.*").distinct()
    found, found_at = staged(found, "variants")
    earliest = found.groupBy("kind", "key", "key2").agg(F.min("first").alias("of"))
    of_kind = F.when(F.col("kind") == "whole", "lack").when(F.col("kind") == "lack", "whole").otherwise(F.col("kind"))
    candidates = found.join(earliest.withColumn("kind", of_kind), ["kind", "key", "key2"]).filter(F.col("of") < F.col("first"))
    candidates = candidates.select("h1", "h2", "of").distinct()
    texts = state.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.first("first").alias("first"))
    both = candidates.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(texts.select(F.col("first").alias("of"), F.col("line").alias("of_line")), "of")
    near, _ = staged(both.filter(F.levenshtein("line", "of_line", 1) >= 0).groupBy("h1", "h2").agg(F.min("of").alias("of")), "near")
    drop_staged(spark, state_at, found_at)
    return distinct, near


def mark_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, kept, dup_doc, dup_line) for every line of every text.

    A line is dropped when an equal line, or a line within one edit, stands earlier, by
    (doc_id, line number from 0); ``dup_doc`` and ``dup_line`` name the earliest such line.
    Blank lines are kept. A null text has no lines, an empty one has one blank line. A null
    id is earlier than any other; rows that repeat an id have the same places, and both
    lines at a place are kept or dropped together. Other columns are ignored.
    """
    distinct, near = nearest_earlier(documents, id_col, text_col)
    verdict, _ = staged(distinct.join(near, ["h1", "h2"], "left").select("h1", "h2", F.least("first", "of").alias("dup")), "verdict")
    lines = lines_of(documents, id_col, text_col)
    full = F.length(F.trim("line")) > 0
    lines = lines.select("doc_id", "line_no", F.when(full, F.xxhash64("line")).alias("h1"), F.when(full, F.xxhash64(F.lit(1), "line")).alias("h2"))
    out = lines.join(verdict, ["h1", "h2"], "left")
    later = F.coalesce(F.col("dup") < F.struct("doc_id", "line_no"), F.lit(False))
    return out.select("doc_id", "line_no", (~later).alias("kept"), F.when(later, F.col("dup.doc_id")).alias("dup_doc"), F.when(later, F.col("dup.line_no")).alias("dup_line"))


def without_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the kept lines; ids are unique and not null here. A text whose lines
    all go is empty, a null text stays null."""
    marks = mark_lines(documents, id_col=id_col, text_col=text_col).filter("kept").select("doc_id", "line_no")
    kept = lines_of(documents, id_col, text_col).join(marks, ["doc_id", "line_no"])
    texts = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    texts = texts.select(F.col("doc_id").alias("id"), F.array_join(F.col("l.line"), "\n").alias("joined"))
    out = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("old")).join(texts, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.when(F.col("old").isNotNull(), F.coalesce("joined", F.lit(""))).alias("text"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, line_no, kept, dup_doc, dup_line for every line of the documents."""
    return mark_lines(table(spark, sf_dir, "documents"))


def brute_force(documents: list[tuple]) -> dict:
    """(doc_id, line_no) -> (kept, dup), by comparing all pairs; for small tests."""
    places = [((d, i), line) for d, t in documents if t is not None for i, line in enumerate(t.split("\n"))]

    def near(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > 1:
            return False
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    out = {}
    for at, line in places:
        earlier = [b for b, other in places if b < at and near(line, other)] if line.strip(" ") else []
        out[at] = (not earlier, min(earlier) if earlier else None)
    return out
