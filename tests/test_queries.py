"""Every core query against its SQL in DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from barlab.queries import QUERIES, SQL  # noqa: E402

SF = os.environ.get("BARLAB_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cells(rows):
    return sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert cells(df.select(*columns).collect()) == cells(found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_entry_imports_without_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_causality_is_tried_to_the_end(spark, monkeypatch):
    from barlab import queries
    from barlab.operators import signals

    tried = []
    real = signals.causality_breaks
    monkeypatch.setattr(signals, "causality_breaks", lambda b, f, cuts: tried.append(cuts) or real(b, f, cuts))
    rows = QUERIES["q_causality_check"](spark, SF).collect()
    longest = max(r["count"] for r in queries.bars(spark, SF).groupBy("contract").count().collect())
    assert tried == [signals.cut_points(longest)] * 2 and max(tried[0]) >= longest - 1 and all(r.breaks == 0 for r in rows)


def test_windows_are_evaluated_a_second_time(spark, monkeypatch):
    """A second evaluation that gave other rows would show: it is held against the first's."""
    from barlab import paper_queries
    from barlab.operators.evaluation import Evaluation

    table = lambda name, hashes: spark.createDataFrame([(h,) for h in hashes], f"{name} string")
    made = [Evaluation(table("snapshot_hash", s), table("event_hash", e), None) for s, e in (("ab", "x"), ("abc", "xyz"))]
    monkeypatch.setattr(paper_queries, "evaluated", lambda spark, sf: made.pop(0))
    assert [tuple(r) for r in QUERIES["q_window_again"](spark, SF).select("snapshots", "events").collect()] == [(1, 2)] and not made
