import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import decontam as D

WORDS = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "l", "")]
CLASH = "doc_id long, text string, item_id long, similarity string"


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def brute(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), st.text("abc", max_size=24))
def test_infix_distance(item, text):
    assert D.infix_distance(item, text) == brute(item, text)


plain = D.plain


def test_words_are_folded_and_freed_of_punctuation():
    assert plain("Ünïts, (42) a_b!  \n&&& 中文x") == "ünïts 42 a b 中文x"
    assert plain("") == plain(" .. ") == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", min_size=1, max_size=140), st.text("abcé ", max_size=200)), min_size=1, max_size=5))
def test_the_array_bound_is_the_distance_where_symbols_differ(pairs):
    items, width = [D.symbols()[D.codes(i)] for i, _ in pairs], max(len(t) for _, t in pairs)
    texts = np.full((len(pairs), width), 64)
    for k, (_, t) in enumerate(pairs):
        texts[k, : len(t)] = D.symbols()[D.codes(t)] & 63
    assert D.least_edits(items, np.arange(len(pairs)), texts).tolist() == [D.infix_distance(i, t) for i, t in pairs]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], CLASH)


@pytest.mark.parametrize("rate, least", [(0.0, 1.0), (0.05, 0.95), (0.1, 0.92)])
def test_recall_under_edits(rate, least):
    rng = random.Random(17)
    items = [(k, sentence(rng, rng.randint(15, 60))) for k in range(150)]
    index, texts, wanted = D.Index.of(items), [], []
    for k, item in items:
        words = [rng.choice(WORDS) if rng.random() < rate else w for w in item.split() if rng.random() > rate / 3]
        text = f"{sentence(rng, 70)}. {' '.join(words)}&&& {sentence(rng, 70)}"
        if 1 - brute(plain(item), plain(text)) / len(plain(item)) >= D.SIMILARITY:
            texts.append(text)
            wanted.append((len(texts) - 1, k))
    found = {(t, items[i][0]) for t, i, _, _ in index.hits(texts)}
    assert sum(w in found for w in wanted) >= least * len(wanted)
    assert found <= set(wanted)  # nothing clean is hit


def test_operator_matches_brute_force(spark):
    rng = random.Random(5)
    items = [(k, sentence(rng, n)) for k, n in enumerate([5, 7, 9, 12, 18, 40, 3, 1])] + [(20, None), (21, " .. ")]
    items[7] = (7, "unheardof")
    rows = [(k, sentence(rng, 120)) for k in range(30)]
    for k in range(8):
        rows.append((100 + k, f"{sentence(rng, 30)} {items[k][1].upper()}! {sentence(rng, 30)}"))
    rows += [(200, items[5][1]), (201, None), (202, ""), (203, f"{items[4][1]} {sentence(rng, 20_000)} {items[5][1]}"), (204, items[0][1]), (204, items[0][1]), (None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in D.contamination(docs(spark, rows), bench).collect())
    wanted = []
    for i, t in rows:
        for k, item in items:
            if item and plain(item) and t and len(t) < 50_000 and brute(plain(item), plain(t)) <= 0.2 * len(plain(item)):
                wanted.append((i or -1, k))
    wanted += [(203, 4), (203, 5)]
    long = [g for g in got if g[1] not in (6,)]  # three short words may also occur by chance, cut differently
    assert [w for w in sorted(wanted) if w[1] != 6 and w not in long] == []
    assert [g for g in long if g not in wanted and g[0] != 203] == []
    clean = D.drop_contaminated(docs(spark, rows), bench)
    assert clean.columns == docs(spark, []).columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {(None if g[0] == -1 else g[0]) for g in got}


def test_empty_tables_and_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, sentence(random.Random(k), 20)) for k in range(5)], "item_id long, text string")
    rows = [(k, sentence(random.Random(k), 20)) for k in range(8)]
    assert D.contamination(docs(spark, []), bench).collect() == [] and D.drop_contaminated(docs(spark, []), bench).collect() == []
    assert D.contamination(docs(spark, rows), bench.limit(0)).collect() == [] and D.drop_contaminated(docs(spark, rows), bench.limit(0)).count() == 8
    monkeypatch.setattr(D, "BLOCK_ANCHORS", 40)
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contamination(docs(spark, rows), bench).collect()) == [(k, k) for k in range(5)]
    assert sorted(r["doc_id"] for r in D.drop_contaminated(docs(spark, rows), bench).collect()) == [5, 6, 7]


LETTERS = "abcdefghijklmnopqrstuvwxyz "


def _at(rng, s):
    return rng.randrange(len(s))


def _words(change):
    def run(rng, s):
        words = s.split()
        change(rng, words)
        return " ".join(words)

    return run


EDITS = {
    "substitution": lambda rng, s: s[: (p := _at(rng, s))] + rng.choice(LETTERS) + s[p + 1 :],
    "insertion": lambda rng, s: s[: (p := _at(rng, s))] + rng.choice(LETTERS) + s[p:],
    "deletion": lambda rng, s: s[: (p := _at(rng, s))] + s[p + 1 :],
    "other word": _words(lambda rng, w: w.__setitem__(_at(rng, w), rng.choice(WORDS))),
    "word less": _words(lambda rng, w: w.pop(_at(rng, w))),
    "word more": _words(lambda rng, w: w.insert(_at(rng, w), rng.choice(WORDS))),
}


def recall(words, kind, share, n=80):
    """Share found of items of so many words, in passages with a share of the edits that the similarity lets pass."""
    rng, items, texts = random.Random(f"{words} {kind}"), [], []
    for k in range(n):
        item, last = " ".join(rng.choices(WORDS, k=words)), None
        most, part = share * (1 - D.SIMILARITY) * len(item), item
        while D.infix_distance(item, plain(part)) <= most and part:
            last, part = part, EDITS[kind](rng, part)
        items.append((k, item))
        texts.append(f"{sentence(rng, 30)} {last} {sentence(rng, 30)}")
    found = {(t, i) for t, i, _, _ in D.Index.of(items).hits(texts)}
    return sum((k, k) in found for k in range(n)) / n


@pytest.mark.parametrize("kind", EDITS)
@pytest.mark.parametrize("words", [4, 5, 6, 8, 10, 12, 15, 18, 20, 25, 30, 40, 60])
def test_recall_by_length_and_kind_of_edit(words, kind):
    assert recall(words, kind, 1.0) >= 0.9  # as unlike as an item may be
    assert recall(words, kind, 0.5) >= 0.97


def test_small_items_are_found_exactly():
    rng = random.Random(9)
    items = sorted({" ".join("".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))[:9].strip() for _ in range(120)} - {""})
    index = D.Index.of(list(enumerate(items)))
    texts = [" ".join("".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(8)) for _ in range(40)]
    found = {(t, i) for t, i, _, _ in index.hits(texts)}
    wanted = set()
    for t, text in enumerate(texts):
        starts = [k for k in range(len(text)) if not k or text[k - 1] == " "]
        for i, item in enumerate(items):
            room = int(0.2 * len(item) + 1e-9)
            if any(levenshtein(item, text[k : k + n]) <= room and (room or text[k + n : k + n + 1] in ("", " ")) for k in starts for n in range(len(item) - room, len(item) + room + 1)):
                wanted.add((t, i))
    assert sum(len(items[i]) in range(5, 10) for _, i in wanted) > 30 and wanted <= found
    assert all(D.infix_distance(items[i], texts[t]) <= int(0.2 * len(items[i]) + 1e-9) for t, i in found)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_verbatim_copies_are_certain():
    rng = random.Random(3)
    items = [(k, sentence(rng, 1 + k % 14)) for k in range(420)] + [(500, "the the the"), (501, "a b a b a b a b a b")]
    texts = [f"{sentence(rng, 20)} {item} {sentence(rng, 20)}" for _, item in items]
    found = {(t, i) for t, i, e, _ in D.Index.of(items).hits(texts) if e == 0}
    assert all((k, k) in found for k in range(len(items)))
