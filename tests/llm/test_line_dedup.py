"""Line dedup against all pairs of lines."""

import numpy as np
from pyspark.sql import functions as F

from barlab.llm.line_dedup import brute_force, lines_of, mark_lines, without_repeats

DOC = "doc_id bigint, text string, line string, line_no int, n int, h1 string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash", 0, 0, "clash") for d, t in docs], DOC)


def marks(df):
    return {(r.doc_id, r.line_no): (r.kept, None if r.kept else (r.dup_doc, r.dup_line)) for r in mark_lines(df).collect()}


def edited(rng, line):
    at, kind = int(rng.integers(0, len(line) + 1)), int(rng.integers(0, 4))
    if kind == 0:
        return line[:at] + "q" + line[at:]
    if kind == 1 and line:
        return line[: max(at - 1, 0)] + line[max(at, 1) :]
    return line[:at] + "zß"[kind - 2] + line[at + 1 :] if kind > 1 else line


def test_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abc d"), n)) for n in (1, 2, 3, 5, 9, 17, 40, 90, 200) for _ in range(3)]
    docs = [(i, "\n".join(edited(rng, pool[int(rng.integers(0, len(pool)))]) for _ in range(6))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n  \n"), (103, "a\nb\n\nab\nba"), (104, "x" * 5000), (105, "x" * 4999), (106, "x" * 2500 + "y" + "x" * 2499), (107, "ünïcode line 1\nünïcode line 2\nunïcode line 1")]
    assert marks(frame(spark, docs)) == brute_force(docs)


def test_short_alphabet(spark):
    rng = np.random.default_rng(6)
    docs = [(i, "\n".join("".join(rng.choice(list("ab"), int(rng.integers(0, 6)))) for _ in range(5))) for i in range(12)]
    assert marks(frame(spark, docs)) == brute_force(docs)


def test_frequent_line_and_chain(spark):
    line = "The same line stands in every document of this table."
    docs = [(i, f"{line}\nown line of document number {i * 1111}") for i in range(300)] + [(400, "aaaa\naaab\naabb\nabbb\nbbbb")]
    found = marks(frame(spark, docs))
    assert found[0, 0] == (True, None) and all(found[i, 0] == (False, (0, 0)) for i in range(1, 300))
    assert found[400, 2] == (False, (400, 1)) and found == brute_force(docs)


def test_nulls_repeats_and_empty(spark):
    docs = frame(spark, [(None, "first line here"), (1, "first line here"), (2, "twice the same\nother"), (2, "twice the same\nother")])
    rows = mark_lines(docs).collect()
    assert len(rows) == 6
    assert [(r.kept, r.dup_doc, r.dup_line) for r in rows if r.doc_id == 1] == [(False, None, 0)]
    assert all(r.kept for r in rows if r.doc_id == 2)  # equal places
    assert mark_lines(docs.limit(0)).count() == 0


def test_texts_without_repeats(spark):
    docs = frame(spark, [(1, "one line of text\n\nanother line of text"), (2, "one line of text!\nnew stuff"), (3, None), (4, "new stuff")])
    assert {r.doc_id: r.text for r in without_repeats(docs).collect()} == {1: "one line of text\n\nanother line of text", 2: "new stuff", 3: None, 4: ""}


def test_plan_has_no_python(spark):
    df = frame(spark, [(1, "a line\nanother")])
    plan = mark_lines(df)._jdf.queryExecution().toString() + lines_of(df).select(F.length("line"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Pandas" not in plan
