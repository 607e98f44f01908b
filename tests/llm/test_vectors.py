"""Hard negatives and whitening against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import hard_negatives as hn
from barlab.llm import whitening as wh

VECTORS = "vec_id bigint, label int, embedding array<float>, anchor string, norm string, x string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, label, v, "clash", "clash", "clash") for i, label, v in rows], VECTORS).repartition(parts)


def sample(n=260, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(size=dim) * rng.choice([0.05, 1, 4])]) for i in range(n)]
    copy = rows[7][2]
    rows += [(i, i % 4, copy) for i in range(n, n + 60)]  # ties
    rows += [(1000, None, copy), (1001, 1, None), (1002, 1, [1.0, None]), (1003, 1, [float("nan")] * dim), (1004, 2, [float("inf")] + [0.0] * (dim - 1)), (1005, 1, []), (1006, 2, [0.5]), (1010, 1, [0.0] * dim), (1050, 9, [3.0] * dim)]
    return [*rows, rows[20], rows[20], (None, 1, copy), (None, 2, copy)]


def expected(rows, **options):
    dim = max(len(v) for _, _, v in rows if v is not None)
    return hn.brute_force([(i, label, None if v is None else [*v, *[0.0] * (dim - len(v))], i is not None and i % 10 == 0) for i, label, v in rows], **options)


@pytest.mark.parametrize("block, chunk", [(4096, 512), (16, 8)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "CHUNK", chunk)
    rows = sample()
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_scores_beyond_exact_floating_point(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.normal(size=4) * 1e6]) for i in range(80)]
    assert sorted(map(tuple, hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()), key=str) == expected(rows)
    with pytest.raises(Exception, match="64 bits"):
        hn.hard_negatives(frame(spark, [(i, 0, [3e16]) for i in range(20)]), F.col("vec_id") % 10 == 0).collect()


def test_no_anchors_and_no_rows(spark):
    assert hn.hard_negatives(frame(spark, []), F.lit(True)).count() == 0
    assert hn.hard_negatives(frame(spark, sample()), F.col("vec_id") < 0).count() == 0
    assert hn.hard_negatives(frame(spark, [(0, 1, [1.0])]), F.lit(True)).count() == 0


def test_blocks_are_left_out_by_length(monkeypatch):
    """Blocks that are too short for the window, or for the rows held, are not scored."""
    import pyarrow as pa

    slots = [{"slot": 0, "low": 400, "high": hn.LAST, "floor": -hn.LAST}]
    anchors = pa.array([{"rid": 0, "label": 0, "norm": 10.0, "x": [10], "slots": slots}])
    chunk = hn.Chunk(anchors, 1, 1, False)
    add = lambda high, *x: chunk.add(float(high), np.arange(len(x)) + 5, np.arange(len(x)) + 5, np.ones(len(x), np.int64), np.array(x)[:, None])
    add(60, 60, 50)
    assert chunk.best.tolist() == [[0, 600, 5, 5]] and chunk.floor.tolist() == [600]
    monkeypatch.setattr(np, "partition", None)
    chunk.x = None  # scoring would fail
    add(59, 59)
    add(39, 39)
    assert chunk.best.tolist() == [[0, 600, 5, 5]]


def whitened(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.component):
        got.setdefault(r.vec_id, []).append(r)
    return got


@pytest.mark.parametrize("slice_, fan", [(4096, 8), (10, 2)])
def test_whitening_equals_one_covariance(spark, monkeypatch, slice_, fan):
    monkeypatch.setattr(wh, "SLICE", slice_)
    monkeypatch.setattr(wh, "FAN_IN", fan)
    rng = np.random.default_rng(11)
    mixing = rng.normal(size=(7, 7))
    rows = [(i, 0, [float(np.float32(c)) for c in rng.normal(size=7) @ mixing]) for i in range(300)]
    rows += [(i, 0, rows[0][2]) for i in range(300, 380)]  # copies count once
    rows += [(400, 0, None), (401, 0, [1.0, None]), (402, 0, [float("nan")] * 7), (403, 0, [2.0]), (404, None, rows[1][2])]
    got = whitened(wh.whiten(frame(spark, rows, 9), components=5))
    plain = wh.brute_force([(i, None if v is None else [*v, *[0.0] * (7 - len(v))]) for i, _, v in rows], components=5)
    assert set(got) == set(plain) and 400 not in got and 404 in got
    w, e = np.array([[r.whitened for r in got[i]] for i in plain]), np.array([plain[i][2] for i in plain])
    assert np.abs(w - e * np.sign((w * e).sum(0))).max() < 1e-9
    for i, (n, deviation, _, explained) in plain.items():
        assert [r.component for r in got[i]] == [1, 2, 3, 4, 5] and {(r.n, r.deviation) for r in got[i]} == {(n, deviation)}
        assert np.allclose([r.explained for r in got[i]], explained, rtol=1e-9)
    assert {r.identity_error for rs in got.values() for r in rs}.pop() < 1e-10


def test_merges_lose_nothing(monkeypatch):
    """The factor of any tree of merges gives the scatter of all rows, beside a large mean."""
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (200, 6)) + 10**9
    parts = [wh.Summary.of(p) for p in np.array_split(x, 13)]
    held = parts[0]
    for p in parts[1:7]:
        held = held.merge(p)
    rest = parts[7]
    for p in parts[8:]:
        rest = p.merge(rest)
    whole = rest.merge(held)
    c = x - x.mean(0)
    assert whole.n == 200 and whole.sums == x.sum(0).tolist()
    assert np.abs(whole.factor.T @ whole.factor - c.T @ c).max() < 1e-6 * np.abs(c.T @ c).max() * 1e-4


def test_fewer_vectors_than_dimensions_and_none(spark):
    few = whitened(wh.whiten(frame(spark, [(1, 0, [1.0, 2.0, 3.0]), (2, 0, [2.0, 2.0, 3.5])])))
    assert {k: len(v) for k, v in few.items()} == {1: 1, 2: 1} and few[1][0].explained == pytest.approx(1.0)
    assert abs(few[1][0].whitened) == pytest.approx(1.0) and few[1][0].whitened == pytest.approx(-few[2][0].whitened)
    assert wh.whiten(frame(spark, [(1, 0, [1.0]), (2, 0, [1.0]), (3, 0, [])])).filter("vec_id < 3").count() == 2  # the empty one is a zero
    assert wh.whiten(frame(spark, [(1, 0, [1.0]), (2, 0, [1.0])])).count() == 0
    assert wh.whiten(frame(spark, [])).count() == 0 and wh.whiten(frame(spark, [(1, 0, None)])).count() == 0
    twice = wh.whiten(frame(spark, [(1, 0, [1.0]), (1, 0, [1.0]), (None, 0, [5.0])]))
    assert sorted(str(r.vec_id) for r in twice.collect()) == ["1", "1", "None"]


def test_wide_numbers(spark):
    rows = [(i, 0, [float(i * 3_000_000_000), 1.0]) for i in range(9)]
    with pytest.raises(Exception, match="64 bits"):
        wh.whiten(frame(spark, rows)).collect()
    m = wh.Model(wh.Summary.of(np.array([[1 << 61, 1], [-(1 << 61), 2], [5, 5]])), 2)
    assert m.sums == [5, 8] and abs(m.whitened(np.array([[1 << 61, 1], [-(1 << 61), 2]]))[:, 0].sum()) < 1e-6
