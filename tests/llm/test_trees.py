"""Merkle manifest, fill-in-the-middle and byte-level BPE against brute force, SQL and the library."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import quillspark.llm.bpe as B
from quillspark.llm import fill_middle as M, merkle as T, queries as Q

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path int, root string, row int, own string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_fill_middle"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_DIR}/documents.parquet')")
    answer = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    got = Q.queries()[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(answer.fetchall())


# Merkle manifest


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k - k % 3 : k - k % 3 + 3]
        out.append((run[: k % 3], run[k % 3 + 1 :]))
        k //= 3
    return out


def brute_manifest(rows, changed):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    trees = {s: levels_of(list(map(leaf, rs))) for s, rs in groups.items()}
    top = levels_of([trees[s][-1][0] for s in groups])
    out = []
    for i, (s, rs) in enumerate(groups.items()):
        for k, r in enumerate(rs):
            path, at = way(trees[s], k) + way(top, i), leaf(changed(r))
            for left, right in path:
                at = sha([*left, at, *right])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(d for p in path for side in p for d in side), at, at == top[-1][0]))
    return sorted(out, key=str)


def even(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0


def tampered(row):
    return (*row[:4], row[4].replace("\n", "")) if even(row) and row[4] else row


def manifest(docs, reach=T.REACH):
    changed = T.digest_of(*(T.without_line_ends(docs) if c == "text" else F.col(c) for c in T.FIELDS))
    return sorted(map(tuple, T.verified(T.proofs(T.leaves(docs, extra={"changed": changed}), reach), "changed").collect()), key=str)


@pytest.mark.parametrize("reach", [2, 6])
def test_manifest_of_every_size_matches_brute_force(spark, reach):
    sizes = {None: 1, "": 2, "a": 3, "b": 4, "c": 9, "d": 10, "e": 27, "ä": 28, "z": 83, "hot": 300}
    rows = [(100 * g + k, s, "en", k, f"text\n{k}\n" if k % 3 else None) for g, (s, n) in enumerate(sizes.items()) for k in range(n)]
    assert manifest(table(spark, rows).repartition(5), reach) == brute_manifest(rows, tampered)


def test_manifest_of_odd_tables(spark):
    assert manifest(table(spark, [])) == []
    one = [(7, "s", None, None, "é\n")]
    assert manifest(table(spark, one)) == brute_manifest(one, tampered)
    assert {r[1] for r in manifest(table(spark, one))} == {r[3] for r in manifest(table(spark, one))}  # a lone leaf is the root
    odd = [(None, None, None, None, None), (None, "s", "en", 1, "x\n"), (1, "s", "", 0, ""), (1, "s", "", 0, ""), (1, "s", "", 0, "b"), (2, "s", "en", -5, "y" * 100_000), (-3, "s", "en", 2, "\n\n")]
    assert manifest(table(spark, odd)) == brute_manifest(odd, tampered)


def test_fields_cannot_run_into_each_other(spark):
    rows = [(1, "a", "1:b", 1, "x"), (1, "a1:", "b", 1, "x"), (1, "-", None, 1, "x"), (1, None, "-", 1, "x")]
    assert T.leaves(table(spark, rows)).select("leaf").distinct().count() == 4


# Fill in the middle

TEXTS = [None, "", "a", "ab cd", "<P>", "x <S> y", "<M", "line\nline\r\n", "é ü 中文 😀a", "12-ab", " ", "word " * 30_000, "b" * 50_000, "ZzaAz[`{@"]


def brute_middle(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return key, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_middle_matches_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "null id"), (3, "ab cd"), (3, "ab cd")]
    docs = table(spark, [(k, "s", "en", 1, t) for k, t in rows])
    got = M.fill_middle(docs).withColumn("back", M.restored())
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_middle(k, t) for k, t in rows), key=str)
    assert M.fill_middle(docs.where("false")).count() == 0


def test_marks_that_pieces_almost_make_are_not_taken_for_marks(spark):
    texts = ["<P<S<M", "<<<", "P>S>M>", "<S <P <M >", "a<", ">b<", "<P" * 9]
    docs = table(spark, [(k, "s", "en", 1, t) for k, t in enumerate(texts * 40)])
    assert M.fill_middle(docs).where(~(M.restored() == F.lit(""))).join(docs.select("doc_id", "text"), "doc_id").where(M.restored() != F.col("text")).count() == 0


# Byte-level BPE

SIGNS = [" ", "  ", "\n", "a", "b", "ab", "the", "'s", "'re", "'", "<|endoftext|>", "<|", "endof", "text|>", "中", "文字", "é", "😀", "1", "23", "!", "?!", "ß", "aaaa", "ing", "\t", "՘", "\U0001fae0", "　", "₏", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.vocabulary_path())


@pytest.fixture(scope="module")
def bpe():
    return B.Bpe(B.vocabulary_path())


def made(rng, most):
    few = rng.choice([None, 1, 2, 3, 5])
    signs = rng.sample(SIGNS, few) if few else SIGNS
    return "".join(rng.choice(signs) for _ in range(rng.randrange(most)))


def test_texts_joined_from_pieces_encode_as_the_library_does(bpe, library):
    rng = random.Random(5)
    for _ in range(1500):
        text = made(rng, 120)
        parts, at = [], 0
        for piece in B._halves(text, rng.choice([1, 2, 5, 17, 40])):
            c = bpe.encode([piece])[0]
            parts.append(B.Coded(c.at + at, c.before, c.ids))
            at += len(piece)
        whole, want = bpe.concatenated(text, parts), library.encode(text, add_special_tokens=False).ids
        assert whole.ids.tolist() == want and bpe.tokens([text])[0].tolist() == want, text
        assert (np.diff(whole.at) > 0).all() and whole.before[-1] == len(want) and bpe.decode(whole.ids) == library.decode(want, skip_special_tokens=False) == text


ALPHABETS = ["a", "ab", "中文国", "=-", "!", "0123456789", "éa", "日本語のー", "abcdefghijklmnopqrstuvwxyz", ["the", "in", "g", "s", "er"], [" "], ["\n", " "], "😀😁"]


@pytest.mark.parametrize("long", [1, 3, 8, 40])
def test_long_words_encode_as_the_library_does(bpe, library, monkeypatch, long):
    rng = random.Random(long)
    halves = B._halves
    monkeypatch.setattr(B, "_halves", lambda text, most=long: halves(text, most))
    words = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 300))) for signs in ALPHABETS * 25]
    words = [w for w in words if len(bpe.words(w)) == 1]
    assert len(words) > 250
    assert bpe.long_words(words) == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_a_very_long_word_takes_about_linear_time(bpe, library):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    assert bpe.long_words([word])[0] == library.encode(word, add_special_tokens=False).ids


def test_encode_and_decode_over_tables(spark, library):
    rng = random.Random(11)
    texts = [None, "", "a", "<|endoftext|>x", "é" * 5_000, " " * 3_000, "a" * 9_000, "中文" * 3_000, "it's 12 o'clock\n\n\nnow  ", *(made(rng, 3000) for _ in range(40))]
    docs = table(spark, [(k % 40 or None, "s", "en", 1, t) for k, t in enumerate(texts + texts[5:12])])
    coded = B.decode(B.encode(docs, span=500)).collect()
    want = [(k % 40 or None, library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in enumerate(texts + texts[5:12])]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in coded), key=str) == sorted(want, key=str)
    assert B.encode(docs.where("false")).count() == 0


def test_bytes_that_are_no_text_decode_as_the_library_does(bpe, library):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(50_257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(12))]
        assert bpe.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_query_counts_and_digests(spark, library):
    con = duckdb.connect()
    texts = dict(con.execute(f"SELECT doc_id, text FROM read_parquet('{SF_DIR}/documents.parquet')").fetchall())
    for r in Q.op13_bpe(spark, SF_DIR).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids))) and r["decoded_sha256"] == sha(texts[r["doc_id"]] or "")
