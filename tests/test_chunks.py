import pytest
from hypothesis import given, settings, strategies as st

from quillspark.functions import chunks as K

TEXTS = st.lists(st.sampled_from(["# h\n", "para one. ", "word ", "\n\n", "\n", "```\n", "x" * 30, "\r\n\r\n", "    ", "终。 ", "$$"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(20, 200))
def test_round_trip_and_limit(text, most):
    chunks = K.plan(text, most)
    assert K.rebuild(chunks) == text
    assert all(0 < len(c.source_text) <= most for c in chunks)
    assert [c.chunk_id for c in chunks] == [f"chunk-{k:04d}" for k in range(1, len(chunks) + 1)]


def test_headings_start_chunks_but_not_inside_code():
    text = "intro\n\n# One\n\na\n\n```\n# no heading\n```\n\n## Two\nb\n"
    assert [c.source_text.splitlines()[0] for c in K.plan(text, 1000)] == ["intro", "# One", "## Two"]


def test_packing_resets_at_the_limit():
    chunks = K.plan("aaaa\n\nbbbb\n\ncccc", 12)
    assert [c.source_text for c in chunks] == ["aaaa\n\nbbbb\n\n", "cccc"]
    assert [c.separators for c in chunks] == [["\n\n", "\n\n"], [""]]


def test_cuts_prefer_sentences_then_lines_then_spaces():
    assert [c.source_text for c in K.plan("One. Two three", 10)] == ["One. ", "Two three"]
    assert [c.source_text for c in K.plan("aaa\nbbb ccc", 8)] == ["aaa", "\nbbb ccc"]
    assert [c.source_text for c in K.plan("aaa bbb ccc", 8)] == ["aaa bbb", " ccc"]
    assert [c.source_text for c in K.plan("x" * 1000, 100)] == ["x" * 100] * 10


def test_separator_without_room_stands_alone():
    chunks = K.plan("x" * 199 + "\n\ny", 100)
    assert K.rebuild(chunks) == "x" * 199 + "\n\ny" and max(len(c.source_text) for c in chunks) <= 100


def test_separator_takes_the_next_indentation():
    assert K.plan("a\n\n    b", 100)[0].separators == ["\n\n    ", ""]


def test_errors():
    with pytest.raises(K.PlanError, match="max-chunk-chars must be positive"):
        K.plan("a", 0)
    with pytest.raises(K.PlanError, match="separator exceeds max-chunk-chars"):
        K.plan("a" + "\n" * 30 + "b", 10)
    assert K.plan("", 10) == []


def test_wide_plans_have_wide_ids():
    chunks = K.plan("\n\n".join(["x" * 10] * 10001), 12)
    assert len(chunks) >= 10000 and {len(c.chunk_id) for c in chunks} == {len("chunk-") + 5}
