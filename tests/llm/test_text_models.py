"""Language identification, quality and token counts."""

import random
import zlib

import numpy as np
import pytest

from quillspark.llm import language_id as L, quality as Q, token_count as T

LETTERS = {"aa": "abcdefgh", "bb": "ghijklmnop", "cc": "абвгдежз"}


def word(rng, lang):
    return "".join(rng.choices(LETTERS[lang], k=rng.randint(2, 7)))


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    return [(k, " ".join(word(rng, lang) for _ in range(rng.randint(5, 60))), lang) for k in range(n) for lang in [rng.choice(list(LETTERS))]]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1.5, "y") for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string, score double, label string")


def is_held_out(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 4 == 2


def test_language_of_held_out_rows(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in L.identify(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i]["held_out"] == is_held_out(i) for i, _, _ in rows)
    held = [(i, lang) for i, _, lang in rows if is_held_out(i)]
    assert len(held) > 100 and np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_never_reads_held_out_labels(spark):
    rows = corpus(300, 3)
    swapped = [(i, t, "zz" if is_held_out(i) else lang) for i, t, lang in rows]
    pick = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in df.collect())
    assert pick(L.identify(docs(spark, rows))) == pick(L.identify(docs(spark, swapped)))


def test_language_of_odd_rows(spark):
    odd = [(9001, None, "aa"), (9002, "", "aa"), (9003, "12 !? \n", "bb"), (9004, "gh", None), (9005, "ж " * 100_000, None), (9005, "ж " * 100_000, None), (None, "gg hh", "aa"), (9006, "漢字", None)]
    got = L.identify(docs(spark, corpus(200) + odd))
    by = [(r["doc_id"], r["lang_pred"]) for r in got.collect() if r["doc_id"] is None or r["doc_id"] > 9000]
    assert {i: p for i, p in by if i in (9001, 9002, 9003)} == dict.fromkeys((9001, 9002, 9003), "und")
    assert by.count((9005, "cc")) == 2 and all(p != "und" for i, p in by if i in (None, 9004, 9005, 9006))
    kept = L.drop_unidentified(docs(spark, corpus(200) + odd))
    assert kept.columns == docs(spark, []).columns and kept.count() == 205


def test_language_without_anything_to_learn(spark):
    assert L.identify(docs(spark, [])).collect() == [] and L.drop_unidentified(docs(spark, [])).collect() == []
    got = L.identify(docs(spark, [(1, "abc", None), (2, None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_kernel_is_the_presence_kernel():
    texts = ["abc abd", "bca", "xyz"]
    model = L.Model(texts, ["a", "b", "c"])

    def grams(t):
        s = f" {t} "
        return {s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)} - {" "}

    for k, t in enumerate(texts):
        for j, u in enumerate(texts):
            expected = len(grams(t) & grams(u)) / (len(grams(t)) * len(grams(u))) ** 0.5
            assert model.kernel([model._marks(t)])[0, j] == pytest.approx(expected, abs=1e-5), (k, j)


def test_grams_of_pieces_equal_grams_of_the_whole(monkeypatch):
    table = L.symbol_table(["abc def"])
    text = "abc, def!! a  bcd e fed " * 20
    whole = {int(x) for p in L.grams(text, table) for x in p}
    monkeypatch.setattr(L, "CHUNK", 7)
    assert {int(x) for p in L.grams(text, table) for x in p} == whole


def quality_rows(n=900):
    rng, rows, labels = random.Random(8), [], []
    for k in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        bad = rng.random() < 0.3
        if bad:
            words = rng.choice(([w.upper() + "!!" for w in words], [w + "%%%" for w in words], words[:1] * 60))
        rows.append((k, " ".join(words), None))
        if rng.random() < 0.8:
            labels.append((k, int(not bad), 0, "z"))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_quality_of_held_out_rows(spark):
    rows, labels = quality_rows()
    df = docs(spark, rows)
    got = {r["doc_id"]: r for r in Q.score_quality(df, Q.fit(df, label_table(spark, labels))).collect()}
    held = [(i, q) for i, q, _, _ in labels if is_held_out(i)]
    assert len(got) == len(rows) and np.mean([got[i]["predicted"] == q for i, q in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == is_held_out(r["doc_id"]) for r in got.values())


def test_quality_of_odd_rows(spark):
    rows, labels = quality_rows(300)
    odd = [(9001, None, None), (9002, "", None), (9003, "x " * 100_000, None), (9003, "x " * 100_000, None), (None, "a", None)]
    df = docs(spark, rows + odd)
    model = Q.fit(df, label_table(spark, labels + [(9001, 1, 0, "z"), (9002, None, 0, "z"), (None, 1, 0, "z"), (5, 1, 0, "z"), (5, 0, 1, "z")]))
    assert all(0 <= r["score"] <= 1 for r in Q.score_quality(df, model).collect())
    assert Q.score_quality(docs(spark, []), model).collect() == []
    empty = Q.fit(df, label_table(spark, []))
    assert {r["score"] for r in Q.score_quality(df, empty).collect()} == {0.5}
    one = Q.Model(Q.matrix(["a", "b"]), np.ones(2))
    assert one.scores(Q.matrix(["c"]))[0] == pytest.approx(0.75)


def test_scores_are_sums_of_looked_up_bins():
    rows, labels = quality_rows(400)
    x, y = Q.matrix([rows[i][1] for i, *_ in labels]), np.array([q for _, q, _, _ in labels], float)
    model = Q.Model(x, y)
    row = x[7]
    total = model.start + sum(t[np.searchsorted(c, v, "right")] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
    total += sum(t[np.searchsorted(model.coarse[f], row[f], "right"), np.searchsorted(model.coarse[g], row[g], "right")] for (f, g), t in zip(model.pairs, model.pair_tables, strict=True))
    assert model.scores(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-total))) and len(model.pairs) <= Q.PAIRS


ODD = ["", " ", "  a  b   ", "▁▁x ▁", "\n\n\t x", "a" * 500, "😀👩‍👩 é̀  日本語  \x00x", "<s></s><unk> <0x0A>", "     " * 30, "ab" * 3000 + "  " * 400, "aaaaaaaaa bbbbbbbbbbb   ccc", " x　y", "__--==__" * 60, "Ünïcödé " * 300]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=T.model_path())


def test_token_counts_equal_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("aAbeio tnh  \n.,1é▁日😀", k=rng.randint(0, 400))) for _ in range(300)] + [" ".join(word(rng, "aa") for _ in range(200)) for _ in range(30)]
    assert T.vocabulary(T.model_path()).count(texts) == [len(library.encode(t)) for t in texts]


def test_both_ways_to_merge_agree(library):
    vocab, rng = T.vocabulary(T.model_path()), random.Random(2)
    words = ["▁" + "".join(rng.choices("abcdeinorst", k=rng.randint(1, 180))) for _ in range(300)] + ["▁" * k for k in range(1, 40)]
    assert vocab.merge_all(words).tolist() == [vocab.merge_one(w) for w in words]


def test_token_counts_of_a_table(spark, library):
    rows = [(k, t, None) for k, t in enumerate(ODD)] + [(100, None, None), (101, "word " * 6000, None), (101, "word " * 6000, None), (None, "a", None)]
    got = T.token_counts(docs(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(
        (-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, _ in rows
    )
    assert T.token_counts(docs(spark, [])).collect() == []
