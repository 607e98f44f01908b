"""Budgets of source trees and contiguous shards against plain versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import mixture
from barlab.llm.mixture import mix, mixed_documents
from barlab.llm.shards import brute_force, cut_points, shard

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, domain int, copies string"


def frame(spark, docs):
    return spark.createDataFrame([(*d, 0, 0, "clash") for d in docs], DOC)


def sample(n=300, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["en", "de", "fr", "xx"][int(rng.integers(0, 4))], f"src{int(rng.integers(0, 3) ** 3) + int(rng.integers(0, 12))}") for i in range(n)]


def shares(budget, children):
    """Budgets of (name, weight, cap): those that cannot use their share are filled up."""
    out, open_ = {}, list(children)
    while True:
        left, weight = budget - sum(out.values()), sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] * weight <= left * c[1]]
        if not full:
            parts = {n: left * w // weight for n, w, _ in open_}
            over = left - sum(parts.values())  # what the division leaves goes to the first names
            return out | {n: b + (i < over) for i, (n, b) in enumerate(sorted(parts.items()))}
        out |= {n: cap for n, _, cap in full}
        open_ = [c for c in open_ if c not in full]


def plain(docs, share, epochs, seed=7):
    of = {s: d for d, names in mixture.DOMAINS.items() for s in names}
    leaf = defaultdict(int)
    keys = {}
    for d, t, lang, source in docs:
        keys[d] = (of.get(source, mixture.REST), lang or mixture.NONE, source or mixture.NONE)
        leaf[keys[d]] += len((t or "").split())
    total = sum(leaf.values())
    cap = lambda *head: sum(n * epochs for k, n in leaf.items() if k[: len(head)] == head)
    budgets = {}
    for dom, b in shares(min(total * share, total * epochs * 100) // 100, [(d, mixture.DOMAIN_WEIGHTS.get(d, 1), cap(d)) for d in sorted({k[0] for k in leaf})]).items():
        for lang, b2 in shares(b, [(x, mixture.LANG_WEIGHTS.get(x, 1), cap(dom, x)) for x in sorted({k[1] for k in leaf if k[0] == dom})]).items():
            budgets |= {(dom, lang, s): b3 for s, b3 in shares(b2, [(x, mixture.SOURCE_WEIGHTS.get(x, 1), cap(dom, lang, x)) for x in sorted({k[2] for k in leaf if k[:2] == (dom, lang)})]).items()}
    out = {}
    for k, budget in budgets.items():
        copies, rest = divmod(budget, leaf[k]) if leaf[k] else (0, 0)
        mine = sorted((hashlib.md5(f"{seed}:{copies}:{d}".encode()).hexdigest(), len((t or "").split()), d) for d, t, _, _ in docs if keys[d] == k)
        for _, n, d in mine:
            out[d] = (*k, n, copies, max(0, min(n, rest)))
            rest -= n
    return out


@pytest.mark.parametrize(("share", "epochs"), [(60, 2), (10, 1), (95, 1), (180, 2), (500, 3)])
def test_mixture_equals_plain(spark, share, epochs):
    docs = [*sample(), (1000, None, None, None), (1001, "", "en", "src0"), (1002, "a b c", "only", "lonely"), (1003, "w " * 20000, "en", "src1")]
    found = {r.doc_id: (r.domain, r.lang, r.source, r.n_tokens, r.copies, r.part_tokens) for r in mix(frame(spark, [(*d, 0)[:4] for d in docs]), share=share, max_epochs=epochs).collect()}
    assert found == plain(docs, share, epochs)


def test_mixture_meets_the_budget(spark):
    docs = sample(500)
    rows = mix(frame(spark, docs), share=60, max_epochs=2)
    used, total = rows.agg(F.sum(F.col("n_tokens") * F.col("copies") + F.col("part_tokens")), F.sum("n_tokens")).first()
    assert total * 60 // 100 - 100 <= used <= total * 60 // 100


def test_mixture_edges(spark):
    df = frame(spark, sample(20))
    assert mix(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0
    rows = mix(df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))))
    assert rows.count() == 40
    assert mix(df.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("part_tokens")).first()[0] == 0


def test_stage_keeps_what_is_used(spark):
    docs = sample(400)
    want = {d for d, (_, _, _, n, c, part) in plain(docs, 80, 1).items() if c * n + part > 0 or n == 0}
    out = mixed_documents(frame(spark, docs), share=80)
    assert {r.doc_id for r in out.collect()} == want and len(want) < 400 and out.columns == [c.split()[0] for c in DOC.split(", ")]


@pytest.mark.parametrize("k", [1, 3, 16, 60])
def test_capacity_is_smallest(spark, k):
    rng = np.random.default_rng(k)
    sizes = (rng.pareto(1.2, 500) * 20 + 1).astype(int).tolist()
    keys = sorted(rng.choice(1 << 60, 500, replace=False).tolist())
    capacity, cuts = cut_points(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key bigint, size bigint"), k)
    assert capacity == brute_force(sizes, k) and len(cuts) < k
    edges = [0, *cuts, 1 << 61]
    assert all(sum(s for q, s in zip(keys, sizes, strict=True) if a <= q < b) <= capacity for a, b in zip(edges, edges[1:], strict=False))


def test_close_keys_are_read_in_detail(spark):
    rows = [((5 << 50) + i, 10 + i % 7) for i in range(300)]
    capacity, _ = cut_points(spark.createDataFrame(rows, "key bigint, size bigint"), 7, most=4)
    assert capacity == brute_force([s for _, s in rows], 7)


def test_shards(spark):
    docs = [(i, f"text {i % 90} " * (i % 90 + 1), "en", "s") for i in range(400)] + [(1000, None, None, None), (1001, "", None, None), (1002, "ß" * 50, None, None)]
    rows = shard(frame(spark, [(*d, 0)[:4] for d in docs]), 5).collect()
    assert len(rows) == len(docs)
    by_text, slots, total = defaultdict(set), defaultdict(list), defaultdict(int)
    texts = {d: t or "" for d, t, _, _ in docs}
    for r in rows:
        by_text[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        assert r.size == len(texts[r.doc_id].encode()) + 1
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) <= rows[0].capacity and set(total) <= set(range(5))


def test_shard_edges(spark):
    df = frame(spark, [(1, "a", None, None)] * 9)
    assert shard(df.limit(0)).count() == 0
    rows = shard(df.withColumn("doc_id", F.lit(None).cast("bigint"))).collect()
    assert {r.shard for r in rows} == {0} and sorted(r.slot for r in rows) == list(range(9))


def test_a_given_tree_and_no_token_lost(spark):
    tree = mixture.Tree({"a": ["src0", "src1"], "b": ["src2"]}, rest="c", domain_weights={"a": 3, "b": 7}, lang_weights={"en": 2}, source_weights={"src1": 5})
    docs = frame(spark, sample(400, 5))
    rows = mix(docs, tree=tree, share=37).collect()
    assert {r.domain for r in rows} == {"a", "b", "c"} and all(r.domain == {"src0": "a", "src1": "a", "src2": "b"}.get(r.source, "c") for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.copies * r.n_tokens + r.part_tokens for r in rows) == total * 37 // 100
    for wrong in ({"domain_weights": {"a": 0}}, {"source_weights": {"x": 1.5}}):
        with pytest.raises(ValueError):
            mixture.Tree({"a": ["x"]}, **wrong)
    with pytest.raises(ValueError):
        mixture.Tree({"a": ["x"], "b": ["x"]})


def test_registered_shards_against_a_plain_version(spark, tmp_path):
    """Every column of op7: sizes, checksums, groups kept together, slots without gaps, and
    the cuts that greedy filling makes at the smallest capacity that trying finds."""
    from collections import Counter
    from zlib import crc32

    from barlab.llm.shards import op7_shards

    rng = np.random.default_rng(9)
    texts = [None, "", "é" * 50, *("word " * int(rng.integers(1, 60)) + str(i % 90) for i in range(400))]
    docs = [(i, texts[int(rng.integers(0, len(texts)))]) for i in range(700)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op7_shards(spark, str(tmp_path)).collect()}
    groups: dict = defaultdict(list)
    for d, t in docs:
        raw = (t or "").encode()
        r = rows[d]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc32(raw), "bytes", None)
        groups[int(hashlib.md5(raw).hexdigest()[:15], 16)].append(d)
    order = sorted(groups)
    sizes = [sum(rows[d].size for d in groups[key]) for key in order]
    capacity, shard_, used = brute_force(sizes, 16), 0, 0
    for key, size in zip(order, sizes, strict=True):
        if used + size > capacity:
            shard_, used = shard_ + 1, 0
        used += size
        assert {rows[d].shard for d in groups[key]} == {shard_}
    for s, n in Counter(r.shard for r in rows.values()).items():
        assert sorted(r.slot for r in rows.values() if r.shard == s) == list(range(n))
