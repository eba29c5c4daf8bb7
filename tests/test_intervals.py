"""Joins of intervals, fence state and packing, against plain loops and over documents larger than a task."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scan
from quillspark.operators import intervals as I


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    made = lambda: [(d, *sorted((rng.randrange(300), rng.randrange(300))), k) for k, d in enumerate(rng.choices((1, 2, 3, None), k=150))]
    left, right = made(), made()
    got = I.overlaps(spark.createDataFrame(left, "doc_id int, start int, end int, a int"), spark.createDataFrame(right, "doc_id int, start int, end int, b int"), width=16)
    assert got.columns == ["doc_id", "start", "end", "a", "r_start", "r_end", "b"]
    rows = [(r["a"], r["b"]) for r in got.collect()]
    want = {(x[3], y[3]) for x in left for y in right if x[0] is not None and x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])}
    assert len(rows) == len(want) and set(rows) == want


def test_a_document_of_a_million_spans(spark):
    spans = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end"))
    lines = spark.range(250_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 40).alias("start"), (F.col("id") * 40 + 40).alias("end"), F.col("id").alias("line"))
    met = I.overlaps(spans, lines)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert tuple(met.agg(F.count(F.lit(1)), F.count_distinct("line")).first()) == (1_000_000, 250_000)


SIGNS = ["```", "````", "~~~", "~~~~", "x", "  ```", "```py", "`````", "", "```  ", "~~~ x", "``"]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_fence_state_equals_the_fold(spark, block):
    rng = random.Random(block)
    docs = {d: [rng.choice(SIGNS) for _ in range(rng.randrange(1, 60))] for d in range(60)}
    lines = spark.createDataFrame([(d, k, x) for d, v in docs.items() for k, x in enumerate(v, 1)], "doc_id int, line_no long, line string")
    got = {(r["doc_id"], r["line_no"]): r["in_fence"] for r in I.fence_state(lines, block=block).collect()}
    assert got == {(d, k): f for d, v in docs.items() for k, f in enumerate(scan.inside_fence(v), 1)}


def test_a_document_of_a_million_lines(spark):
    line = F.when(F.col("id") % 1000 == 7, "````").when(F.col("id") % 1000 == 507, "`````").when(F.col("id") % 1000 == 300, "```").otherwise("text")
    lines = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).alias("line_no"), line.alias("line"))
    state = I.fence_state(lines)
    assert tuple(state.agg(F.count(F.lit(1)), F.count_if("in_fence")).first()) == (1_000_000, 500_000)
    odd = state.where(F.col("in_fence") != (F.pmod(F.col("line_no") - 2, F.lit(1000)).between(7, 506)))
    assert odd.count() == 0


def plainly(sizes, most):
    out, chunk, held = [], 1, 0
    for k, n in enumerate(sizes):
        if k and held and held + n > most:
            chunk, held = chunk + 1, 0
        out.append(chunk)
        held += n
    return out


def test_packing_equals_the_loop(spark):
    rng = random.Random(2)
    docs = {d: [rng.randrange(0, 11) for _ in range(rng.randrange(1, 70))] for d in range(40)}
    docs[50] = [rng.choice((1, 2, 3, 500, 1000)) for _ in range(100_000)]
    for keys, most, block in ((range(40), 10, 8), ((50,), 1000, 4096)):
        units = spark.createDataFrame([(d, k, x) for d in keys for k, x in enumerate(docs[d], 1)], "doc_id int, unit int, size long")
        got = {(r["doc_id"], r["unit"]): r["chunk"] for r in I.packed(units, most, block=block).collect()}
        assert got == {(d, k): c for d in keys for k, c in enumerate(plainly(docs[d], most), 1)}
