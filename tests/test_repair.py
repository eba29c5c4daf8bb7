import pytest
from hypothesis import given, settings, strategies as st

from quillspark.functions import answers as A
from quillspark.functions.autofix import autofix, guard, indent_list_blocks
from quillspark.functions.lint import lint, report
from quillspark.functions.sanitize import clean_fetched, clean_links, collapse_blanks, drop_residue, sanitize, shorten_openers, split_double_fences, split_glued, split_requires

LINES = st.lists(st.sampled_from(["- item", "1. one", "  * deep", "    - deeper", "```", "```python", "    ```", "~~~", "text", "", "a```js", "- x ```y", "[](https://a.b)L", "check explain", "``````", "`c`"]), max_size=25).map("\n".join)


def rules(text, **kw):
    return [(i.rule_id, i.line) for i in lint(text, **kw)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a\n~~~\nb", [("FENCE_UNBALANCED", 2)]),
        ("```\na\n````\n", []),
        ("````\na\n```\n", [("FENCE_UNBALANCED", 1)]),
        ("see ~~~ here", [("FENCE_INLINE", 1)]),
        ("- see ``` here", [("FENCE_INLINE", 1)]),
        ("see ``` here", [("PROSE_TRIPLE_BACKTICKS", 1)]),
        ("see ```python here", [("PROSE_TRIPLE_BACKTICKS", 1)]),
        ("see```python", [("FENCE_GLUE_AFTER_PROSE", 1)]),
        ("code ```x``` end", []),
        ("[](https://a.b)Label", [("BROKEN_LINK_EMPTY_LABEL", 1)]),
        ("[](https://a.b) Label", []),
        ("(Missing Answer)", [("INTERACTIVE_RESIDUE", 1)]),
        ("1. one\n- two", [("LIST_CONTEXT_DRIFT", 2)]),
        ("- a\n```\nb\n```", [("LIST_FENCE_INDENT", 2)]),
        ("- a\n    ```\n    b\n    ```", []),
        ("- a\n    - b\n        ```\n        c\n        ```", [("LIST_FENCE_COMPLEX_DEPTH", 3)]),
        ("- a\n    ```\n    ```\n    ```\n    ```", [("LIST_FENCE_CHAINING", 4)]),
        ("- a\n\ntext\n```\nb\n```", []),
        ("", []),
    ],
)
def test_lint_rules(text, expected):
    assert rules(text) == expected


def test_lenient_lint_knows_fewer_rules():
    assert rules("1. one\n- two\n[](https://a.b)L\na```py", strict=False) == [("PROSE_TRIPLE_BACKTICKS", 4)]
    assert rules("- a\n    - b\n        ```\n        ```", max_depth=2) == []


def test_order_inside_a_line_and_report():
    found = lint("- [](https://a.b)check explain ``` x")
    assert [i.rule_id for i in found] == ["BROKEN_LINK_EMPTY_LABEL", "INTERACTIVE_RESIDUE", "FENCE_INLINE"]
    assert report(found).splitlines()[2] == "FENCE_INLINE line 1: fence marker appears mid-line | - [](https://a.b)check explain ``` x"
    assert report([]) == "No markdown lint issues."
    assert lint("x" * 200 + "```")[0].excerpt == "x" * 117 + "..."


@pytest.mark.parametrize(
    "line, expected",
    [
        ("[](https://a.b)Label  ", "[Label](https://a.b)"), ("[](https://a.b)[L](c)", "[L](c)"), ("x [](https://a.b) y", "x  y"),
        ("[a](b)[c](d)", "[a](b) [c](d)"), ("end  ", "end"),
    ],
)
def test_clean_links(line, expected):
    assert clean_links(line) == expected


def test_sanitize_passes():
    assert split_double_fences("a\n``````\nb\n  ``````\n") == "a\n```\n```\nb\n  ``````\n"
    assert drop_residue(["a", "", "#@ex-1", "q", "check explain", "", "b"]) == ["a", "", "b"]
    assert drop_residue(["```", "check explain", "```", "(missing answer)"]) == ["```", "check explain", "```"]
    assert split_requires("requires: p effects: q") == ["requires:p", "effects: q"]
    assert split_glued("prose```python") == ["prose", "```python"] and split_glued("prose ```python") == ["prose ```python"]
    assert shorten_openers(["`````py", "x", "```"]) == ["```py", "x", "```"]
    assert shorten_openers(["`````py", "x", "`````"]) == ["`````py", "x", "`````"]
    assert collapse_blanks(["a", "", " ", "", "b", "```", "", "", "", "```"]) == ["a", "", "", "b", "```", "", "", "", "```"]


def test_sanitize_as_a_whole():
    assert sanitize("") == ""
    assert sanitize("a\r\nb  \r\n") == "a\nb\n"
    assert sanitize("x```python\ny\n```") == "x\n```python\ny\n```"
    assert sanitize("```\n[](https://a.b)L\n```\n") == "```\n[](https://a.b)L\n```\n"
    assert clean_fetched("```\n[](https://a.b) x\n```\n") == "```\nx\n```\n"
    assert sanitize("a\ncheck explain\n", aggressive=False) == "a\ncheck explain\n"


def test_autofix_passes():
    assert autofix("a```js\nb\n```\n") == "a\n```js\nb\n```\n"
    assert autofix("- see ``` here\n") == "- see\n    ``` here\n"
    assert autofix("see ``` now\n") == "see triple backticks now\n" and autofix("use ```js x\n") == "use triple backticks (js) x\n"
    assert indent_list_blocks("- a\n```\nb\n\n```\nc") == "- a\n    ```\n    b\n\n    ```\nc"
    assert autofix("- a\n    - b\n        ```text\n        c\n        ```") == "- a\n    - b\n    ```text\n    c\n    ```"
    assert autofix("      ```text\n      c\n      ```", max_depth=1) == "    ```text\n    c\n    ```"


@settings(max_examples=200, deadline=None)
@given(LINES)
def test_repairs_keep_the_final_newline_and_end(text):
    for change in (sanitize, autofix):
        assert change(text + "\n").endswith("\n") or not text
    value, issues, error = guard(text)
    assert (error is None) == (not issues)


def test_guard_reports_what_it_cannot_fix():
    assert guard("ok\n") == ("ok\n", [], None)
    assert guard("```\nopen")[2].startswith("markdown guardrails failed:\nFENCE_UNBALANCED line 1")


def test_answers():
    kept = {"__INLINE_CODE_001__": "`x`", "__URL_001__": "u"}
    assert A.unwrap_tokens("a `__URL_001__` b\n```\n__INLINE_CODE_001__\n```\n") == "a __URL_001__ b\n__INLINE_CODE_001__\n"
    assert A.drop_unknown("__URL_001__ __URL_009__", kept) == "__URL_001__ "
    assert A.strip_markers("<<<\ntext\n>>>\n") == "text\n"
    assert A.part_headings("> q # H") == "> q \n# H" and A.part_headings("End. ## H") == "End.\n## H"
    assert A.inline_short_blocks("run ```text\nls\n```\n now") == "run `ls`  now"
    assert A.finish("see __INLINE_CODE_001__ (__URL_001__)", "see `x` (u)", kept) == ("see `x` (u)", [])
    text, warnings = A.finish("see", "see [a](u)", {})
    assert text == "see" and warnings == ["QA warning: URL target mismatch"]


@pytest.mark.parametrize("original", ["Be.\n\n", "\nand so", "\n\nand\n\n\n ", "Be. ", "\n\n", " \n\n", ""])
def test_answers_end_as_their_originals(original):
    assert A.finish(original, original, {}) == A.finish(f"<<<\n{original}", original, {}) == (original, [])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("use\n```\nls\n```\nnow", "use `ls` now"), ("use ```\nls\n``` now", "use `ls` now"), ("```text\nls\n```\nnow", "`ls` now"), ("a\n\n```\nls\n```\nb", "a\n\n```\nls\n```\nb"),
        ("use\n```\nls\n```\n\nnow", "use\n```\nls\n```\n\nnow"), ("use\n```python\nls\n```\nnow", "use\n```python\nls\n```\nnow"), ("use\n```\na\nb\n```\nnow", "use\n```\na\nb\n```\nnow"),
        ("a ~~~\nx\n~~~\nb ~~~\ny\n~~~\nc", "a `x` b `y` c"), ("use\n```\n" + "x" * 81 + "\n```\nnow", "use\n```\n" + "x" * 81 + "\n```\nnow"), ("```\nx = 1\n\n```\nshort\n```\nfoo\nbar\n```\nend", "```\nx = 1\n\n```\nshort\n```\nfoo\nbar\n```\nend"), ("", ""),
    ],
)
def test_short_blocks_in_prose(text, expected):
    assert A.inline_short_blocks(text) == expected
