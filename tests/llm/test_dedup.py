"""Exact and near dedup against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quillspark.llm import exact_dedup as E, simhash as S
from quillspark.llm.components import connected_components

CLASH = "doc_id long, text string, digest string, fp long, row string, `a.b` string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y", "z") for i, t in rows], CLASH)


ROWS = [(1, "Ab"), (2, "aB"), (3, "ab "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (9, "X" * 200_000), (10, "ab"), (None, "ab"), (None, "solo")]


def test_exact_dedup_matches_brute_force(spark):
    got = E.exact_dedup(docs(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(i)
    for r in got:
        text = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        best = max((i for i in groups[text] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(groups[text]))
    assert sum(r["kept"] for r in got) == len(groups)
    assert {r["doc_id"] for r in got if r["kept"]} == {10, 3, 5, 6, 7, 9, None}


def test_heavy_hitters_take_the_broadcast_way(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k}") for k in range(3000)]
    hashed = E.digests(docs(spark, rows))
    heavy = E.heavy_digests(hashed, counters=15).collect()
    assert [(h["group_size"], h["best"]["doc_id"]) for h in heavy] == [(1000, 2997)]
    got = E.exact_dedup(docs(spark, rows), counters=15)
    assert got.where("kept").count() == 2001 and got.where("doc_id % 3 = 0 AND NOT kept AND keep_id = 2997").count() == 999


def test_summaries_find_every_frequent_value():
    rng = random.Random(3)
    values = [b"a"] * 400 + [b"b"] * 250 + [str(rng.random()).encode() for _ in range(1000)]
    rng.shuffle(values)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(values[k : k + 100], pa.binary())], ["digest"]) for k in range(0, len(values), 100)]
    out = next(E.misra_gries(9)(iter(batches)))
    assert {b"a", b"b"} <= set(out.column(0).to_pylist()) and out.num_rows <= 9


def test_dropping_copies_keeps_columns_and_one_of_repeated_rows(spark):
    kept = E.drop_exact_copies(docs(spark, ROWS))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r["doc_id"] or -1, lower(r["text"])) for r in kept.collect()) == sorted([(10, "ab"), (3, "ab "), (5, ""), (6, "É"), (7, "é"), (9, "x" * 200_000), (-1, "solo")])


@pytest.mark.parametrize("run", [E.exact_dedup, E.drop_exact_copies, S.near_duplicates, S.drop_near_copies])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).collect() == []


def brute_fingerprint(text, n=4):
    words = lower(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "A b  c\nd e", "é " * 50, "w\x1cx y\x85z q", "ab cd ef gh " * 9000])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, rng = S.covering_masks(radius), random.Random(5)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(28 <= m.bit_count() <= 44 for m in masks)
    for _ in range(5000):
        dropped = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & dropped for m in masks)


def brute_components(fps, ids, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for f, i in zip(fps, ids, strict=True):
        least[find(f)] = min(i, least.get(find(f), i))
    return [least[find(f)] for f in fps]


@pytest.mark.parametrize("level", [0, 1, 2])
def test_finer_masks_cover_too(level):
    masks, rng = S.covering_masks(4), random.Random(level)
    for k in range(level):
        masks = S.finer_masks(masks, 4, k)
    finer = S.finer_masks(masks, 4, level)
    assert len(finer) == 5 * len(masks) <= S.TABLE + 1
    for _ in range(2000):
        dropped, k = sum(1 << b for b in rng.sample(range(64), 4)), rng.randrange(len(masks))
        assert masks[k] & dropped or any(not m & dropped for m in finer[5 * k : 5 * k + 5])
    assert all(m & ~f == 0 and f.bit_count() > m.bit_count() for k, m in enumerate(masks) for f in finer[5 * k : 5 * k + 5])


@pytest.mark.parametrize("bucket", [1 << 13, 4])
def test_links_connect_what_all_pairs_connect(spark, bucket, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", bucket)  # small ones are dealt again down to the last level
    rng = random.Random(11)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0]
    for _ in range(240):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice((1, 2, 4, 5, 6))):
            f ^= 1 << b
        fps.append(f)
    distinct = sorted(set(fps))
    signed = [f - (f >> 63 << 64) for f in distinct]
    links = S.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    component = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    expected = brute_components(distinct, signed)
    label = lambda xs: {tuple(k for k, y in enumerate(xs) if y == x) for x in set(xs)}
    assert label([component.get(f, f) for f in signed]) == label(expected)


def test_a_dense_bucket_yields_a_forest_not_all_pairs():
    fps = np.unique(np.array([np.uint64(1 << a | 1 << b) for a in range(40) for b in range(40)], np.uint64))
    left, right = S.bucket_forest(fps, 4)
    assert sum(map(len, left)) == fps.size - 1 == sum(map(len, right))


def test_open_buckets_over_many_batches():
    import pyarrow as pa

    fps = np.unique(np.array([1 << a | 1 << b for a in range(30) for b in range(30)], np.uint64))
    keys = np.repeat([S.TABLE + 1, 2 * S.TABLE + 2], [5, fps.size - 5])
    for size in (1, 7, 1000):
        for most in (None, 6, 3):
            batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(fps[k : k + size].view(np.int64))], ["key", "fp"]) for k in range(0, fps.size, size)]
            rows = [r for b in S.links_of_buckets(4, most)(batches) for r in b.to_pylist()]
            given_on = sorted(r["a"] for r in rows if r["table"] is not None)
            assert given_on == ([] if most is None else sorted(fps[5 if most == 6 else 0 :].view(np.int64).tolist()))
            assert sum(r["b"] is not None for r in rows) == (fps.size - 2 if most is None else 4 if most == 6 else 0)


def test_near_duplicates_matches_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(12, 60):
        w = base[k % 12].split()
        for _ in range(rng.choice((0, 1, 2, 8))):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    rows += [(60, None), (61, ""), (62, "  "), (63, "one two"), (64, "one two"), (64, "one two"), (65, "x " * 30_000)]
    got = S.near_duplicates(docs(spark, rows)).collect()
    expected = brute_components([brute_fingerprint(t) for _, t in rows], [i for i, _ in rows])
    assert sorted((r["doc_id"], r["component_id"], int(r["fingerprint"], 16)) for r in got) == sorted((i, c, brute_fingerprint(t)) for (i, t), c in zip(rows, expected, strict=True))
    kept = S.drop_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.collect()} == set(expected)


def test_components_of_paths_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}
