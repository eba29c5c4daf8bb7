"""The pipeline's stages against what brute force keeps, and its contract."""

import random
from pathlib import Path

import corpus_pipeline as P
from quillspark.llm import queries

WORDS = [a + b + c for a in "bcdfghklmnprst" for b in "aeiou" for c in ("n", "r", "s", "")]


def make(spark, folder, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(k, text(25)) for k in range(6)]
    clean = [(k, text(120)) for k in range(60)]
    near = [(200 + k, t.replace(t.split()[5], "zzz", 1)) for k, t in clean[:6]]
    rows = clean + [(100, clean[0][1].upper()), (101, clean[1][1])] + near + [(300 + k, f"{text(30)} {i} {text(30)}") for k, i in items] + [(400, "12 34 !!"), (401, None), (402, "")]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows]
    make(spark, tmp_path, rows, items)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append((name, docs.columns, {r["doc_id"] for r in docs.collect()}))
    every = {r[0] for r in rows}
    assert seen[0][2] == every - {400, 401, 402}
    assert seen[1][2] == seen[0][2] - {0, 1}
    from quillspark.llm.simhash import fingerprint

    fps = {i: fingerprint(t) for i, t, *_ in rows if i in seen[1][2]}
    close = {b for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4}
    assert seen[2][2] == seen[1][2] - close and close <= {100, 101} | {200 + k for k in range(6)} | {0, 1}
    assert seen[3][2] == seen[2][2] - {300 + k for k in range(6)}
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, columns, _ in seen[:-1])
    assert seen[4][2] <= seen[3][2] and [n for n, _ in P.STAGES] == [n for n, _, _ in seen]
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).select("doc_id", "copies", "taken").collect())) == sorted(map(tuple, docs.select("doc_id", "copies", "taken").collect()))


def test_texts_without_a_letter_go_without_labels_too(spark):
    rows = [(1, "words"), (2, "12 34 !!"), (3, None), (4, ""), (5, "中")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.known_language(spark, docs, "").collect()} == {1, 5}


def test_empty_documents(spark, tmp_path):
    make(spark, tmp_path, [], [(1, "a b c d e f")])
    assert P.run(spark, str(tmp_path)).collect() == []


def test_names_and_guard():
    assert sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])) == [n for n in queries.queries()] and len(queries.queries()) == 13
    assert set(queries.oracle_sql()) <= set(queries.queries())
    root = Path(P.__file__).parent
    for path in [*(root / "quillspark").rglob("*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "quillspark.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_queries_run_on_the_smallest_tables(spark):
    for name, query in queries.queries().items():
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
