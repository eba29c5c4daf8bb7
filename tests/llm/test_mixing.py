import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import mixing as M

CLASH = "doc_id long, text string, source string, size string, target string, copies string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], CLASH)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare the excess by weight, round by round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= most * sizes[s]]
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in full]
        if not full:
            for s in free:
                target[s] = level * weight[s]
            break
    return target


def corpus(n=3000, seed=1):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", None, "é"]
    return [(k, "w " * rng.choice((1, 5, 40, 200)), rng.choices(names, (30, 10, 10, 2, 5, 5))[0]) for k in range(n)]


def test_targets_sizes_and_totals(spark):
    rows = corpus()
    got = M.mix(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    expected, taken = brute_targets(sizes), {}
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 200  # less than one long document


def test_reruns_and_layouts_agree(spark):
    rows = corpus(9000, 4)
    one = {(r["doc_id"], r["copies"]) for r in M.mix(docs(spark, rows)).collect()}
    assert one == {(r["doc_id"], r["copies"]) for r in M.mix(docs(spark, rows[::-1]).repartition(7)).collect()}


def test_every_document_has_its_chance(spark):
    part = np.full(400, 0.3)
    size = np.sort(np.random.default_rng(0).integers(1, 50, 400))[::-1]
    every = []
    for k in range(600):
        rng = np.random.default_rng(k)
        out, left = M.settle(size, part, rng)
        if left >= 0:  # the operator draws what is left over
            out[left] = rng.random() < out[left]
        every.append(out)
    taken = np.mean(every, axis=0)
    assert abs(taken.mean() - 0.3) < 0.01 and np.abs(taken - 0.3).max() < 0.12
    assert set(np.unique(every)) == {0.0, 1.0}


@pytest.mark.parametrize(
    "size, part", [((1, 1, 1), (0.5, 0.9, 0.1)), ((10, 5, 3, 1), (0.2, 0.8, 0.3, 0.9)), ((100, 7, 7, 2, 1), (0.01, 0.99, 0.5, 0.3, 0.6)), ((3, 2), (0.5, 0.25))]
)
def test_fractions_are_kept_in_expectation(size, part):
    """Also through the tree: residuals of two halves meet and the last one is drawn."""
    n, size, part = 20_000, np.array(size), np.array(part)
    rng, whole, halves = np.random.default_rng(3), np.zeros(size.size), np.zeros(size.size)
    for _ in range(n):
        out, left = M.settle(size, part, rng)
        if left >= 0:
            out[left] = rng.random() < out[left]
        whole += out
        out, cut = part.copy(), size.size // 2
        out[:cut], a = M.settle(size[:cut], part[:cut], rng)
        out[cut:], b = M.settle(size[cut:], part[cut:], rng)
        ends = [k for k in (a, b + cut if b >= 0 else -1) if k >= 0]
        if ends:
            out[ends], left = M.settle(size[ends], out[ends], rng)
            if left >= 0:
                out[ends[left]] = rng.random() < out[ends[left]]
        halves += out
    assert np.abs(whole / n - part).max() < 4 * np.sqrt(part * (1 - part) / n).max()
    assert np.abs(halves / n - part).max() < 4 * np.sqrt(part * (1 - part) / n).max()


def test_columns_with_the_names_of_inner_ones(spark):
    odd = docs(spark, corpus(300, 2))
    for name in ("mix_key", "Mix_Own", "__id", "__size", "rank", "block", "part"):
        odd = odd.withColumn(name, M.F.lit("q"))
    plain = {(r["doc_id"], r["copies"]) for r in M.mixture(docs(spark, corpus(300, 2))).collect()}
    got = M.mixture(odd)
    assert {(r["doc_id"], r["copies"]) for r in got.collect()} == plain and "Mix_Own" in got.columns


def test_levels_of_many_sources(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice((1, 3, 50)), rng.choice([None, *(f"s{j}" for j in range(60))])) for k in range(400)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for share in (0.3, 1.5, 1.99, 2.0, 3.0):
        table = docs(spark, rows).selectExpr("source", "cast(size(split(trim(text), ' ')) as long) as size")
        got = {r["source"]: (r["rank"], r["target"]) for r in M.source_targets(table, share=share).collect()}
        wanted = brute_targets(sizes, share=share)
        assert all(got[s][1] == pytest.approx(wanted[s]) for s in sizes) and [s for s, _ in sorted(got.items(), key=lambda x: x[1][0])] == list(wanted)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.floats(0.01, 0.99)), min_size=1, max_size=50), st.integers(0, 99))
def test_settling_keeps_the_mass(units, seed):
    size, part = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    out, left = M.settle(size, part, np.random.default_rng(seed))
    assert (size * out).sum() == pytest.approx((size * part).sum(), abs=1e-5)
    assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != left) and -1e-9 <= out[left] <= 1 + 1e-9


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r", None), (4, "a b\x1cc\x85d e", None), (5, "x " * 100_000, "b"), (5, "x " * 100_000, "b"), (None, "q", "a")]
    got = M.mix(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == [(-1, 1), (1, 0), (2, 0), (3, 0), (4, 3), (5, 100_000), (5, 100_000)]
    assert M.mix(docs(spark, [])).collect() == [] and M.mixture(docs(spark, [])).collect() == []
    nothing = M.mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [r["taken"] for r in nothing] == [0, 0] and [r["target"] for r in nothing] == [0.0, 0.0]


def test_the_mixture_holds_what_is_taken(spark):
    rows = corpus(800, 9) + [(5, "w " * 40, "a")] * 3
    mixed, got = M.mix(docs(spark, rows)), M.mixture(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    assert got.where("copies < 1").count() == 0
    assert got.selectExpr("sum(taken)").first()[0] == mixed.selectExpr("sum(taken)").first()[0]


@pytest.mark.parametrize("part", [0.1, 0.37, 0.5, 0.93])
@pytest.mark.parametrize("big", [(5184, 1834, 1749, 1000), (1473, 1403, 1304, 1121), (9000,)])
def test_heavy_tails_stay_near_their_targets(big, part):
    size = np.array([*big, *sorted(np.random.default_rng(1).integers(50, 900, 90).tolist(), reverse=True), 60, 30, 9, 4, 2, 1])
    goal, far, means = part * size.sum(), [], 0
    for k in range(500):
        rng = np.random.default_rng(k)
        out, left = M.settle(size, np.full(size.size, part), rng)
        if left >= 0:
            out[left] = rng.random() < out[left]
        far.append(abs(out @ size - goal))
        means = means + out / 500
    assert np.median(far) < 0.01 * goal and np.abs(means - part).max() < 0.1
    if min(part, 1 - part) * size[1:].sum() > max(part, 1 - part) * size[0]:  # where those behind the largest can carry it
        assert np.quantile(far, 0.95) < 0.03 * goal
