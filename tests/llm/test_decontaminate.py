"""Benchmark decontamination against a brute-force search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm.decontaminate import brute_force, clean_texts, find_benchmark, without_benchmark, without_spans
from barlab.llm.fm_index import FMIndex

DOC, ITEM = "doc_id bigint, text string, item_id string, n_words string", "item_id bigint, text string, spans int"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, None), (2, ""), (3, "   \n"), (4, PASSAGE), (5, f"Before it, {PASSAGE.upper()}! And after."), (6, "one two three four five six seven eight nine"),
    (7, "short item"), (8, "a short item in a text, a SHORT-ITEM twice"), (9, f"{PASSAGE} {PASSAGE}"), (10, "ten nine eight seven six five four three two one"),
    (11, "straße ünd ñandú"), (12, "x " * 3000 + PASSAGE + " y" * 3000), (13, "same same same same same same same same same same same same"),
]
ITEMS = [(1, PASSAGE), (2, "Short item"), (3, None), (4, ""), (5, "straße ÜND"), (6, "three four five six seven eight nine ten eleven twelve thirteen"), (7, PASSAGE), (8, "same same same same same same same same same same"), (9, "straße ünd")]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(d, t, "clash", "clash") for d, t in docs], DOC), spark.createDataFrame([(i, t, 0) for i, t in items], ITEM)


def digest(rows):
    import hashlib

    return {r.doc_id: (r.n_words, r.n_hit, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest()) for r in rows}


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_equals_brute_force(spark, block_bytes):
    found = find_benchmark(*frames(spark), block_bytes=block_bytes).collect()
    assert digest(found) == brute_force(DOCS, ITEMS)


def test_random_texts(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    docs, items = [(i, text(60)) for i in range(40)], [(i, text(n)) for i, n in enumerate([3, 4, 5, 6, 7, 9])]
    assert digest(find_benchmark(*frames(spark, docs, items), window=5).collect()) == brute_force(docs, items, 5)


def test_stage_drops_what_is_hit(spark):
    docs, items = frames(spark)
    want = {d for d, (_, hit, _) in brute_force(DOCS, ITEMS).items() if not hit}
    out = without_benchmark(docs, items)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    assert {r.doc_id for r in without_benchmark(docs, items, block_bytes=60).collect()} == want


def test_empty_tables_repeats_and_null_ids(spark):
    docs, items = frames(spark)
    assert find_benchmark(docs.limit(0), items).count() == 0 and without_benchmark(docs.limit(0), items).count() == 0
    assert find_benchmark(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    twice = docs.unionByName(docs).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    rows = find_benchmark(twice, items).collect()
    assert len(rows) == 2 * len(DOCS) and sum(r.doc_id is None for r in rows) == 2
    none = frames(spark, DOCS, [(None, PASSAGE)])[1]
    assert [r.item_ids for r in find_benchmark(docs.filter("doc_id = 4"), none).collect()] == [[""]]


def test_spans_are_taken_out(spark):
    found = {r.doc_id: r.clean_text for r in clean_texts(find_benchmark(*frames(spark))).collect()}
    assert found[5] == "Before it, ! And after." and found[10] == DOCS[9][1] and found[1] is None
    assert without_spans("é one, two", [{"start": 1, "stop": 3}]) == "é "


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 300)
    index = FMIndex(text, 5)
    for phrase in rng.integers(1, 5, (30, 3)):
        want = [i for i in range(298) if (text[i : i + 3] == phrase).all()]
        low, high = index.ranges(phrase[None, :])
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_many_blocks_in_passes(spark):
    """A benchmark of many blocks is searched a few at a time, with the same result."""
    words = [f"w{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(words[7 * k : 7 * k + 12])) for k in range(50)]
    docs = [(k, "start " + " ".join(words[7 * k : 7 * k + 11 + k % 3]) + " stop") for k in range(50)] + [(99, None)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    one = {r.doc_id: (r.n_words, r.n_hit, tuple(r.item_ids)) for r in find_benchmark(d, b).collect()}
    many = {r.doc_id: (r.n_words, r.n_hit, tuple(r.item_ids)) for r in find_benchmark(d, b, block_bytes=300).collect()}
    assert one == many and sum(n > 0 for _, n, _ in one.values()) == 50
    assert {r.doc_id for r in without_benchmark(d, b, block_bytes=300).collect()} == {99}
