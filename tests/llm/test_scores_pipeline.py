"""Suffix-tree and unigram scores, toxicity, the pipeline, and queries against their SQL."""

import math
import os
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barlab.llm import suffix_tree, toxicity
from barlab.llm.suffix_tree import BETA, DEPTH, build_tree, grams, score_texts, words

SF = os.environ.get("BARLAB_TEST_SF", "/root/testdata/sf0.001")
DOC = "doc_id bigint, text string, score string, n int, word int"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash", 0, 0) for d, t in docs], DOC)


def some_texts(n=60, seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "then", "there", "cat", "catalogue", "dog", "Dogma", "überall", "and", "sand"]
    return [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30))))) for i in range(n)]


# LM scores


def plain_tree(texts, divergence, DEPTH=DEPTH):  # noqa: N803
    """Scores of texts' codes by dictionaries: counts, smoothing, tests and longest states."""
    counts = [Counter() for _ in range(DEPTH + 1)]
    for c in grams([words(t and t.encode()) for t in texts], DEPTH)[0].tolist():
        for k in range(DEPTH + 1):
            counts[k][c & ((1 << 8 * (k + 1)) - 1)] += 1
    total = sum(counts[0].values())
    p0 = lambda s: (counts[0][s] + 1) / (total + 256)
    totals = [Counter() for _ in range(DEPTH + 1)]
    for k in range(1, DEPTH + 1):
        for c, n in counts[k].items():
            totals[k][c >> 8] += n

    def p(k, c):
        """Interpolated probability of the symbol of code c after its last k symbols."""
        if k == 0:
            return p0(c & 255)
        c &= (1 << 8 * (k + 1)) - 1
        return (counts[k][c] + BETA * p(k - 1, c)) / (totals[k][c >> 8] + BETA) if totals[k][c >> 8] else p(k - 1, c)

    states = [{0}] + [set() for _ in range(DEPTH)]
    for k in range(DEPTH, 0, -1):
        gain = defaultdict(float)
        for c, n in counts[k].items():
            gain[c >> 8] += n * math.log(p(k, c) / p(k - 1, c))
        states[k] = {x for x, g in gain.items() if g >= divergence}
        if k < DEPTH:
            states[k] |= {x & ((1 << 8 * k) - 1) for x in states[k + 1]}

    def score(c):
        k = next(k for k in range(DEPTH, -1, -1) if ((c >> 8) & ((1 << 8 * k) - 1)) in states[k])
        return math.log10(p(k, c))

    return score


@pytest.mark.parametrize("divergence", [2.0, 12.0, 1e9])
def test_tree_equals_plain(spark, divergence):
    texts = [t for _, t in some_texts()] + [None, ""]
    tree = build_tree(spark.createDataFrame([(t,) for t in texts], "text string"), divergence=divergence)
    score = plain_tree(texts, divergence)
    codes = grams([words(t.encode()) for t in ["the cat", "unseen words here", "", "sand dogma überall", *texts[:5]]])[0]
    assert np.allclose(tree.score(codes), [score(c) for c in codes.tolist()], atol=1e-9)


@pytest.mark.parametrize("depth", [4, 5, 7])
def test_depth_is_a_parameter(spark, depth):
    texts = [t for _, t in some_texts()]
    frame_ = spark.createDataFrame([(t,) for t in texts], "text string")
    codes = grams([words(t.encode()) for t in ["the cat", "", "sand dogma überall", *texts[:5]]], depth)[0]
    score = plain_tree(texts, 2.0, depth)
    for head in (0, 2_000_000):
        assert np.allclose(build_tree(frame_, depth=depth, divergence=2.0, head_entries=head).score(codes), [score(c) for c in codes.tolist()], atol=1e-9)
    with pytest.raises(ValueError, match="4 to 7"):
        build_tree(frame_, depth=8)


def test_counts_beyond_32_bits():
    code, n = np.array([3, 9, 200], np.uint64), np.array([1, 2**32 + 7, 2**50], np.int64)
    for level, key in ((suffix_tree.BRANCH, 2**32 - 1), (suffix_tree.LOW + 1, 5), (suffix_tree.LOW, 0xFFFF)):
        got = suffix_tree._unpacked(level, key, suffix_tree._packed(level, code, n))
        assert got[1].tolist() == n.tolist() and (got[0] & np.uint64(0xFF)).tolist() == [3, 9, 200]
        rows = suffix_tree._dealt(level, np.sort(got[0]), n, 7)
        assert len(rows) == 1 and suffix_tree._gathered(rows[0][2])[0].tolist() == np.sort(got[0]).tolist() and suffix_tree._gathered(rows[0][2])[1].tolist() == n.tolist()
        held = suffix_tree.Sums()
        for _ in range(3):
            held.add(*suffix_tree._gathered(rows[0][2]))
        assert held.all()[1].tolist() == (3 * n).tolist()
    turned = np.random.default_rng(1).integers(-(2**63), 2**63, 99)
    assert suffix_tree._turned_back(suffix_tree._turned(turned)).tolist() == turned.tolist()


def test_branches_and_buckets_are_split(spark, monkeypatch):
    """Branches that end in the same three symbols are grown apart, and asked in many buckets."""
    monkeypatch.setattr(suffix_tree, "BRANCH_GRAMS", 5)
    monkeypatch.setattr(suffix_tree, "BUCKET_ENTRIES", 10)
    texts = [t for _, t in some_texts(80, 5)]
    tree = build_tree(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), divergence=2.0, head_entries=0)
    codes, score = grams([words(t.encode()) for t in texts[:30]])[0], plain_tree(texts, 2.0)
    assert tree.buckets > 20 and np.allclose(tree.score(codes), [score(c) for c in codes.tolist()], atol=1e-9)
    rows = suffix_tree.asked(np.unique(codes), 7, tree.buckets)
    assert len(rows) > 10 and sorted(c for r in rows for c in suffix_tree._codes(r[2]).tolist()) == np.unique(codes).tolist()


def test_bytes_zero_and_one_are_told_apart(spark):
    docs = [(i, "a\0b c\1d " * 20) for i in range(1, 9)] + [(20, "a\0b"), (21, "a\1b")]
    rows = {r.doc_id: r.score for r in score_texts(frame(spark, docs), divergence=2.0).collect()}
    assert rows[20] > rows[21]


def test_scores(spark):
    docs = [*some_texts(), (900, None), (901, ""), (902, "the cat " * 20000), (903, "never seen words"), (904, "The\x0bCAT")]
    rows = {r.doc_id: r for r in score_texts(frame(spark, docs), head=3).collect()}
    for d, want in suffix_tree.brute_force(docs).items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4] and r.base_score == pytest.approx(want[4], abs=1e-6)
    assert rows[900].score == rows[901].score and all(r.score < 0 for r in rows.values())
    assert sum(rows[d].score > rows[d].base_score for d in range(60)) > 40  # the tree knows more than frequencies


def test_score_edges(spark):
    docs = frame(spark, [(None, "a b"), (None, "a b"), (1, "a"), (1, "a")])
    rows = score_texts(docs).collect()
    assert len(rows) == 4 and not any(r.held_out for r in rows if r.doc_id is None)
    assert score_texts(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one(spark):
    tree = build_tree(spark.createDataFrame([(t,) for _, t in some_texts()], "text string"), divergence=2.0)
    for context in (b"\xff\xff\xff\xff\xff", b"he ca", b"t the", b"zzzzz"):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** tree.score(np.arange(256) + base)).sum() == pytest.approx(1, abs=1e-6)


def test_states_beyond_the_head_count(spark):
    docs = some_texts(120)
    texts = [t for d, t in docs if crc32(str(d).encode()) % 10]
    score = plain_tree(texts, 2.0)
    assert DEPTH >= 6
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    codes = grams([words(t.encode()) for _, t in docs])[0]
    for head in (0, 40, 90):  # no size of the head changes a probability
        tree = build_tree(train, divergence=2.0, head_entries=head)
        assert np.isnan(tree.head.score(codes)).any() and np.allclose(tree.score(codes), [score(c) for c in codes.tolist()], atol=1e-9)
    rows = {r.doc_id: r.score for r in score_texts(frame(spark, docs), divergence=2.0, head_entries=40).collect()}
    for d, t in docs:
        assert rows[d] == pytest.approx(sum(score(c) for c in grams([words(t.encode())])[0].tolist()), abs=1e-6)


# toxicity


def test_restoring():
    counts = np.ones((28, 28, 28), np.int64)
    for word in ["idiot", "stupid", "hello", "moron"] * 500:
        padded = "  " + word + " "
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            counts[tuple(0 if x == " " else toxicity.kind_of(x) for x in (a, b, c))] += 1
    model = toxicity.CharModel(counts)
    for token, want in [("1d1ot", "idiot"), ("stup1d", "stupid"), ("$tupid", "stupid"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("m0r0n", "moron"), ("hello", "hello"), ("hel1o", "hello")]:
        assert model.words(token.encode()) == [want], token
    assert model.words(b"12345") == [] and model.words(b"") == [] and model.words(b"...") == []
    read = toxicity.Reader(model)
    assert "=idiot" in read(b"you i d i o t now") and "=stupid" in read(b"S T U P I D") and read(None) == set()


def test_spacing_is_part_of_the_lattice():
    texts = ["  the stupid dog is a moron  ", "  you are a fool and an idiot  ", "  a kiss is an ass  ", "  i am a stupid idiot  "] * 400
    counts = np.zeros((28, 28, 28), np.int64)
    for a, b, c in zip(*("".join(texts)[k:] for k in range(3)), strict=False):
        counts[tuple(0 if x == " " else toxicity.kind_of(x) for x in (a, b, c))] += 1
    model = toxicity.CharModel(counts)
    read = toxicity.Reader(model)
    for text in (b"you are a s t u p i d fool", b"you s  t  u  p  i  d fool", b"s\tt\nu\np\ti\td", b"a $ t u p 1 d dog", b"s t up id dog"):
        assert "=stupid" in read(text), text
    assert {"=stupid", "=idiot"} <= read(b"s t u p i d i d i o t") and "=astupid" not in read(b"you are a s t u p i d fool")
    assert model.run_words("i am a") == ["i", "am", "a"] and model.run_words("1 2 3 44 5") == []  # neither is glued
    assert model.words(b"@$$") == ["ass"] and model.words(b"2024") == model.words(b"3.14") == model.words(b"$100") == []
    assert len(model.run_words("a b " * 20000)) > 0  # long runs, too


def test_restoring_equals_trying_every_path():
    """Viterbi's reading costs what the cheapest of all paths through the lattice costs."""
    from itertools import product

    rng = np.random.default_rng(4)
    model = toxicity.CharModel(rng.integers(0, 50, (28, 28, 28)))

    def cost_of(path):
        total, a, b = 0.0, 0, 0
        for piece, extra in path:
            c, a, b = model.step(a, b, piece)
            total += c + extra
        return total + model.end(a, b)

    text_of = lambda path: "".join(" " if p == toxicity.NUMBER else p for p, _ in path)
    for token in ["a", "1d1", "$$p", "x.y", "0ooo", "st-1", "9", "a11", "..", "h3!"]:
        paths = list(product(*toxicity.lattice(token, False)))
        best = min(map(cost_of, paths))
        got = model.restore(token)
        assert min(cost_of(p) for p in paths if text_of(p) == got) == pytest.approx(best), token
    for run in ["a b c", "1 d 1", "s t", "4 4 a"]:
        paths = list(product(*toxicity.lattice(run, True)))
        assert min(cost_of(p) for p in paths if text_of(p) == model.restore(run, True)) == pytest.approx(min(map(cost_of, paths))), run


def test_very_long_tokens():
    model = toxicity.CharModel(np.ones((28, 28, 28), np.int64))
    read = toxicity.Reader(model)
    assert len(model.words(b"a1" * 150_000)) >= 0 and read(b"x." * 100_000 + b" " + b"z" * 500_000) is not None


def test_one_text_for_each_labelled_id(spark):
    """An id that repeats brings one text, so a sample of ids bounds what is learnt from."""
    docs, labels = toxic_texts(60)
    df = frame(spark, docs + [(1, f"other {i}") for i in range(500)])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")
    model = toxicity.char_model(df)
    plain = frame(spark, [d for d in docs if d[0] != 1] + [(1, min([docs[1][1], *(f"other {i}" for i in range(500))]))])
    a, b = toxicity.train(df, marks, model), toxicity.train(plain, marks, model)
    assert a.known == b.known and np.allclose(a.weights, b.weights)


def toxic_texts(n=600):
    rng = np.random.default_rng(7)
    clean, bad = [f"fine{chr(97 + i)}word" for i in range(20)], ["vilething", "nastyone", "grimfool"]
    leet = str.maketrans("aeio", "4310")
    docs, labels = [], []
    for i in range(n):
        w = rng.choice(clean, 25).tolist()
        if i % 3 == 0:
            x = bad[i % 9 // 3]
            x = x.translate(leet) if i % 2 else x
            w[int(rng.integers(0, 25))] = x
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0), "clash"))
    return docs, labels


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = toxic_texts()
    df, marks = frame(spark, [*docs, (9000, None), (9001, "")]), spark.createDataFrame([*labels, (None, 1, 1, ""), (9000, 1, None, "")], "doc_id bigint, quality int, toxic int, text string")
    scorer = toxicity.train(df, marks, toxicity.char_model(df))
    rows = {r.doc_id: r.score for r in toxicity.score(df, scorer).collect()}
    held = [i for i, _ in docs if crc32(str(i).encode()) % 5 == 0]
    assert sum((rows[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert rows[9000] == rows[9001] < 0.5 and all(0 <= s <= 1 for s in rows.values())
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(df, flipped, toxicity.char_model(df))
    assert again.known == scorer.known and np.allclose(again.weights, scorer.weights)  # held-out labels are not read
    kept = toxicity.without_toxic(df, marks)
    assert {r.doc_id for r in kept.collect()} == {d for d, s in rows.items() if s < 0.5} and kept.columns == df.columns


def test_toxicity_edges(spark):
    docs, labels = toxic_texts(30)
    df = frame(spark, docs)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for marks in (none, spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")):
        scorer = toxicity.train(df, marks, toxicity.char_model(df))
        assert len({r.score for r in toxicity.score(df, scorer).collect()}) == 1
    empty = df.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, none, toxicity.char_model(empty))).count() == 0
    twice = df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    assert toxicity.score(twice, toxicity.train(df, none, toxicity.char_model(df))).count() == 60


# the pipeline and the registered queries


@here
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.collect()}
        assert now < kept and len(now) > 0.5 * len(kept), name
        if name == "near_dedup":
            from barlab.llm.near_dedup import brute_force

            assert now == {d for d, (_, c) in brute_force([(d, texts[d]) for d in kept], 5).items() if c == d}
        if name == "decontamination":
            from barlab.llm.decontaminate import brute_force

            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert now == {d for d, (_, hit, _) in brute_force([(d, texts[d]) for d in kept], items).items() if not hit}
        kept = now
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(kept)


@here
def test_pipeline_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src1", 0), (-3, "just words", None, None, None), (-3, "just words", None, None, None), (None, None, None, None, None)], docs.schema)
    for rows in (docs.limit(0), docs.limit(30).unionByName(odd)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            path = f"{spark.conf.get('spark.checkpoint.dir')}/edge-{name}-{rows.schema.json().__hash__()}"
            out.write.mode("overwrite").parquet(path)
            assert spark.read.parquet(path).count() <= rows.count()


@here
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cells = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert cells(df.select(*columns).collect()) == cells(c.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall())


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
