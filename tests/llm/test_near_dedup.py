"""Near-duplicate groups against all pairs, odd sketches, and components of graphs."""

import numpy as np
from pyspark.sql import functions as F

from barlab.operators.graph import components
from barlab.llm import near_dedup
from barlab.llm.near_dedup import BITS, Shingler, brute_force, find_groups, keep_one, odd_sketch

DOC = "doc_id bigint, text string, component_id string, n string, kept int"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash", "clash", 0) for d, t in docs], DOC)


def texts(seed=3, n=30, size=80):
    """Texts and copies of them with words changed: some above 0.8, some below."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for i in range(n):
        base = rng.choice(words, size).tolist()
        out.append(" ".join(base))
        for changes in range(i % 4):
            copy = list(base)
            for at in rng.choice(size, changes + 1, replace=False):
                copy[at] = "Changed"
            out.append(" ".join(copy))
    order = rng.permutation(len(out))
    return [(int(10 * k), out[i]) for k, i in enumerate(order)]


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark):
    docs = [*texts(), (7, None), (8, ""), (9, " \t\n"), (11, "two words"), (12, "TWO  words"), (13, "words two"), (14, "a b c d"), (15, "a b c d e"), (16, "long " * 20000), (17, "long " * 30000)]
    for size in (4, 5):
        found = find_groups(frame(spark, docs), shingle=size)
        assert groups(found) == brute_force(docs, size)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_long_texts_are_sampled_but_confirmed(spark):
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(4000)]
    docs = []
    for i in range(6):
        base = rng.choice(words, 3000).tolist()
        docs.append((2 * i, " ".join(base)))
        for at in rng.choice(3000, 60 + 20 * i, replace=False):
            base[at] = "x"
        docs.append((2 * i + 1, " ".join(base)))
    assert groups(find_groups(frame(spark, docs), shingle=4)) == brute_force(docs, 4)


def test_large_group_of_copies_is_one_class(spark):
    base = " ".join(f"k{i}" for i in range(60))
    docs = [(i, base if i % 3 else f"{base} e{i}") for i in range(400)]
    found = groups(find_groups(frame(spark, docs)))
    assert {c for _, c in found.values()} == {0}


def test_nulls_repeats_and_empty(spark):
    base = " ".join(f"k{i}" for i in range(30))
    docs = frame(spark, [(None, base), (None, base), (1, base), (1, base), (1, "another text altogether here now"), (2, "another text altogether here now"), (3, base + " end")])
    rows = find_groups(docs).collect()
    assert len(rows) == 7 and {r.component_id for r in rows if r.doc_id is None} == {None} and all(r.kept for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id == 3} == {1}
    kept = [r.doc_id for r in keep_one(docs).collect()]
    assert sorted(kept, key=str) == [1, None, None] and keep_one(docs).columns == docs.columns
    assert find_groups(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(20):
        shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (200, 20, 30))
        sets = [np.unique(np.concatenate([shared, s]) * np.uint64(2)) for s in (a, b)]
        x, y = map(odd_sketch, sets)
        samples = [{} for _ in sets]
        for least, hashes in zip(samples, sets, strict=True):
            for h in hashes.tolist():  # the least hash of each bin, by its highest bits
                least.setdefault(h >> (64 - (near_dedup.BINS - 1).bit_length()), h)
        differ = len(set(samples[0].values()) ^ set(samples[1].values()))
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64).tolist())
        assert len(x) * 64 == BITS and bits <= differ and bits % 2 == differ % 2 and bits > 0.7 * differ


def test_shingles():
    s = Shingler(4)
    assert len(s(b"a b c d a b c d")) == 4 and len(s(b"a b")) == 1 and len(s(None)) == 0
    assert (s(b"A b\tc d") == s(b"a B c\x0bd")).all() and not (s(b"a b") == s(b"a b c")).any()
    assert len(s(" x y z w".encode())) == 1  # only ASCII white space parts words


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    found, _ = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.id: r.component for r in found.collect()} == {x: root(x) for x in list(parent) if root(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint"))[0].count() == 0
    assert F  # the session's functions are importable where tests run alone


def test_a_shared_passage_is_not_searched_in_pairs(spark):
    """Sets that share most words but never link meet in no rare shingle; copies among them do."""
    rng = np.random.default_rng(8)
    shared = " ".join(f"common{i}" for i in range(60))
    docs = [(i, shared + " " + " ".join(f"own{x}" for x in rng.integers(0, 10**9, 15))) for i in range(250)]
    docs += [(1000 + i, docs[i][1] + " tail") for i in range(0, 250, 10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), shingle=4).collect()}
    assert got == near_dedup.brute_force(docs, 4)
    assert sum(c != d for d, (_, c) in got.items()) == 25


def test_odd_sketches_keep_similar_sets(spark):
    """No pair at the threshold is lost by the sketches, and far ones mostly are."""
    rng = np.random.default_rng(3)
    rows, kinds = [], {}
    for i in range(300):
        n, j = int(rng.integers(5, 4000)), [0.8, 0.5][i % 2]
        common = int(np.ceil(2 * n * j / (1 + j)))
        h = rng.permutation(np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64) * np.uint64(2)))[: 2 * n - common]
        x, y = np.sort(h[:n]), np.sort(np.concatenate([h[:common], h[n:]]))
        kinds[i] = (j, n)
        rows.append((i, *((len(s), near_dedup.odd_sketch(s).tolist()) for s in (x, y))))
    df = spark.createDataFrame(rows, "i int, x struct<n:bigint,odd:array<bigint>>, y struct<n:bigint,odd:array<bigint>>")
    kept = {r.i for r in df.filter(near_dedup.may_link(80)).select("i").collect()}
    assert {i for i, (j, _) in kinds.items() if j == 0.8} <= kept
    assert not [i for i, (j, n) in kinds.items() if j == 0.5 and n > 200 and i in kept]


def test_keep_one_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b b b b b b", "x"), (1, "a a a a a a", "y"), (1, "a a a a a a", "y"), (None, "a a a a a a", "z"), (2, "c d e f g h", "w")], "doc_id bigint, text string, kept string")
    rows = sorted((str(r.doc_id), r.text, r.kept) for r in near_dedup.keep_one(docs).collect())
    assert rows == [("1", "a a a a a a", "y"), ("2", "c d e f g h", "w"), ("None", "a a a a a a", "z")]
