"""DataFrame operators, sources, the translation plan and the command line."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions import chunks as K, columns as C, diagrams as D, profiles as R
from quillspark.functions.register import register
from quillspark.operators import assemble, chunking, diagrams, glossary as G, markdown as M, model, preserve
from quillspark.operators.answers import answered
from quillspark.operators.lineage import numbered
from quillspark.plans import lint_fix
from quillspark.plans.documents import converter, url_documents
from quillspark.plans.queries import EchoClient
from quillspark.plans.translate import Options, translate
from quillspark.sources import files, reader
from quillspark.streaming.url_lists import stream_urls

EXOTIC = "a\r\nb\rc\nd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", [EXOTIC, EXOTIC + "\n", "", "\n", "\n\n", "a", "a\r\n"])
def test_lines_split_as_python_does(spark, text):
    assert one(spark, C.lines(F.col("t")), t=text) == text.splitlines()


def test_native_columns(spark):
    assert one(spark, C.strip(F.col("t")), t=" \t a b  \n") == "a b"
    assert one(spark, C.excerpt(F.col("t")), t=" " + "x" * 130) == "x" * 117 + "..."
    assert one(spark, C.indent_width(F.col("t")), t=" \t x") == 6
    assert one(spark, C.glossary_text(F.col("t")), t=" Straße-Bau  X ") == "strasse bau x"
    assert one(spark, C.fence_for(F.col("t")), t="a ````` b") == "``````"
    assert one(spark, C.unwrap_json_fence(F.col("t")), t='```json\n{"a": 1}\n```\n') == '{"a": 1}' and one(spark, C.unwrap_json_fence(F.col("t")), t=" x ") == "x"
    assert one(spark, C.strip_prompt_markers(F.col("t")), t="<<<\ntext\n>>> # H\n") == "text\n# H\n"
    assert one(spark, C.url_slug(F.col("t")), t="https://Ex.com/A%20b/c.html?q=1&r#f") == "ex-com-a-b-c-html-q-1-r"
    assert one(spark, C.url_slug(F.col("t")), t="https://ex.com/%zz") == "ex-com-zz" and one(spark, C.url_slug(F.col("t")), t="///") == "url"
    assert len(one(spark, C.url_slug(F.col("t")), t="https://e.com/" + "a" * 300)) == 120


@pytest.mark.parametrize("text", ["a\n```\nb\n~~~\n```\nc", "~~~~\na\n~~~\n~~~~~ \nb", "  ```py\nx", "x```\ny", ""])
def test_native_fence_fold_agrees_with_the_scanner(spark, text):
    from quillspark.functions.scan import inside_fence

    docs = spark.createDataFrame([(1, text)], "doc_id long, md string")
    assert [r["in_fence"] for r in M.fence_mask(docs).orderBy("line_no").collect()] == inside_fence(text.splitlines())
    open_lines = [(i.line, i.excerpt) for i in __import__("quillspark.functions.lint", fromlist=["lint"]).lint(text) if i.rule_id == "FENCE_UNBALANCED"]
    assert [(r["line"], r["excerpt"]) for r in M.unclosed_fences(docs).collect()] == open_lines


def test_numbering(spark):
    rows = [(k * 7919 % 500, None if k % 5 == 0 else k % 3, f"v{k % 11}") for k in range(500)]
    df = spark.createDataFrame(rows, "k int, g int, v string")
    assert sorted((r["n"], r["k"]) for r in numbered(df, "n", "k").collect()) == [(i + 1, i) for i in range(500)]
    got = {}
    for r in numbered(df.repartition(7), "n", "k", within="g").collect():
        got.setdefault(r["g"], []).append((r["n"], r["k"]))
    for g in (None, 0, 1, 2):
        assert sorted(got[g]) == [(i + 1, k) for i, k in enumerate(sorted(k for k, x, _ in rows if x == g))]
    assert numbered(df, "n", "k").columns == ["k", "g", "v", "n"] and numbered(df.limit(0), "n", "k").collect() == []


def test_dollar_counts(spark):
    df = spark.createDataFrame([("$a$ $$b$$ \\$ $$$",)], "t string")
    assert tuple(df.select(*C.dollar_counts(F.col("t"))).first()) == (3, 3)


def test_errors_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, "`a` b"), (2, "__URL_001__"), (3, None)], "doc_id long, md string")
    rows = {r["doc_id"]: r for r in preserve.protect(docs).collect()}
    assert rows[1]["error"] is None and rows[2]["error"].startswith("input text contains") and rows[3]["protected_text"] is None
    back = {r["doc_id"]: r for r in preserve.restore(preserve.protect(docs).where("error IS NULL")).collect()}
    assert back[1]["text"] == "`a` b"
    plan = chunking.chunk_plan(spark.createDataFrame([(1, "a" + "\n" * 30 + "b"), (2, ""), (3, "ok")], "doc_id long, md string"), most=10)
    assert sorted((r["doc_id"], r["error"], r["source_text"]) for r in plan.collect()) == [(1, "separator exceeds max-chunk-chars", None), (3, None, "ok")]


def test_batches_are_taken_in_parts():
    from quillspark.functions.arrow import SLICE, slices

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 3000] * 10_000)], ["t"])
    parts = list(slices([batch]))
    assert sum(p.num_rows for p in parts) == 10_000 and max(p.nbytes for p in parts) <= SLICE + 3100
    assert [p.num_rows for p in slices([pa.RecordBatch.from_arrays([pa.array(["y" * (2 * SLICE)] * 2)], ["t"])])] == [1, 1]


def test_glued_headings_as_columns_and_as_text(spark):
    from quillspark.functions.answers import part_headings

    rng = random.Random(3)
    pieces = [".", "!", "?", "。", "！", "？", "]", ")", "\n", " ", "\n\n", "#", "##", "## ", "###### ", "- ", "1. ", "> ", "---", "a", "b c"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", C.heading_collisions(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == [part_headings(t) for t in texts] and any(t != part_headings(t) for t in texts)


def test_residue_goes_from_batches_larger_than_a_part(spark):
    rows = [(k, None if k % 100 == 7 else f"(missing answer)\n{'x' * 2000}\n{k}\n") for k in range(1500)]
    got = spark.createDataFrame(rows, "k int, md string").coalesce(1).select("k", M.residue_dropped(F.col("md")).alias("md")).collect()
    assert [tuple(x) for x in got] == [(k, t and t.removeprefix("(missing answer)\n")) for k, t in rows]



def test_plans_of_batches_larger_than_a_part(spark):
    rows = [(k, None if k % 100 == 7 else "\n" * 30 if k % 100 == 8 else f"# {k}\n\n{'x' * 2000}\r\n\r\n \n{'y' * 9}\n") for k in range(1200)]
    got = chunking.chunk_plan(spark.createDataFrame(rows, "doc_id int, md string").coalesce(1), most=20).groupBy("doc_id").agg(F.count("source_text").alias("n"), F.max("error").alias("error")).collect()
    want = {k: (0, "separator exceeds max-chunk-chars") if k % 100 == 8 else (len(K.plan(t, 20)), None) for k, t in rows if t}
    assert {x["doc_id"]: (x["n"], x["error"]) for x in got} == want



def test_plans_are_handed_on_part_by_part(spark):
    """No batch of results is held: a part is out before the next is made, and chunk plans are made that way."""
    from pyspark.util import PythonEvalType

    from quillspark.functions.arrow import SLICE, arrow_function

    seen = []
    run = arrow_function(lambda t: seen.append(t) or len(t), "bigint", streamed=True)
    texts = pa.array(["x" * (SLICE // 16)] * 100 + [None])
    parts = run.func(iter([texts]))
    assert 0 < len(next(parts)) == len(seen) < 20 and 101 - len(seen) == sum(map(len, parts))
    plan = chunking.chunk_plan(spark.createDataFrame([(1, "a")], "doc_id int, md string"))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan._jdf.queryExecution().executedPlan().toString()


def test_units_of_batches_larger_than_a_part(spark):
    rows = [(k, f"# {k}\n\n{'x' * 3000}\n\nend\n") for k in range(900)]
    got = chunking.chunk_units(spark.createDataFrame(rows, "doc_id int, md string").coalesce(1), most=1000).groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("unit").alias("n")).collect()
    assert {x["doc_id"]: (x["size"], x["n"]) for x in got} == {k: (len(t), len(K.units(t, 1000))) for k, t in rows}



def test_equal_questions_are_asked_once(spark, tmp_path):
    rows = spark.range(300).select("id", F.array(F.struct(F.lit("user").alias("role"), (F.col("id") % 7).cast("string").alias("content"))).alias("messages"))
    got = answered(rows, lambda: model.FakeClient(), ("id",), str(tmp_path / "a"), "m", concurrency=3).collect()
    assert {(r["id"] % 7, r["response"]) for r in got} == {(k, str(k)) for k in range(7)} and len(got) == 300
    assert spark.read.parquet(str(tmp_path / "a")).count() == 7 and [f.name for f in tmp_path.iterdir()] == ["a"]  # no copies of questions or answers beside the table


def test_documents_with_more_spans_than_names_round_trip(spark):
    docs = spark.createDataFrame([(1, "$$a$$ `b`\n" * 1500), (2, "`c`")], "doc_id long, md string")
    safe = preserve.protect(docs)
    assert {r["doc_id"]: (r["n"], r["error"]) for r in safe.select("doc_id", F.size("map").alias("n"), "error").collect()} == {1: (3000, None), 2: (1, None)}
    back = preserve.restore(safe).join(docs, "doc_id").where("text = md AND error IS NULL")
    assert back.count() == 2 and preserve.protect(docs, most=999).where("error = 'too many placeholders for MATH_BLOCK'").count() == 1


def test_text_of_a_document_with_more_spans_than_names(spark):
    row = preserve.protect(spark.createDataFrame([(1, "$$a$$ x " * 1001)], "doc_id long, md string")).first()
    assert row["error"] is None and row["protected_text"].startswith("__MATH_BLOCK_100__ x __MATH_BLOCK_100__ x __MATH_BLOCK_999__ x ") and [m["nth"] for m in row["map"]][99::900] == [3, 2]


OWN_TOKENS = ["x __URL_001__ y `c` [a](u)", "__BOLD__`x` z", "`__URL_001__`", "$x$__FOO_001__", "`a`INLINE_CODE_001__", "__URL_001__ [a](u) __URL_001__ `__URL_001__`", "__A_001__"]


def test_documents_with_tokens_of_their_own_round_trip(spark):
    docs = spark.createDataFrame([*enumerate(OWN_TOKENS), (99, None)], "doc_id long, md string")
    for strict in (True, False):
        back = preserve.restore(preserve.protect(docs, own=True), strict=strict)
        assert {r["doc_id"]: (r["text"], r["error"]) for r in back.collect()} == {k: (t, None) for k, t in [*enumerate(OWN_TOKENS), (99, None)]}
    rows = preserve.protect(docs, most=999).where("error IS NOT NULL")
    assert rows.where("error LIKE '%placeholder%'").count() == 7  # a model has to tell them apart


def test_protected_text_of_odd_documents_agrees_with_sql(spark, tmp_path):
    import duckdb

    from quillspark.plans import queries as Q

    texts = [None, "", *OWN_TOKENS[:3], "x __MATH_INLINE_001__ $a+b$"]
    rows = [(8 * k + v, t) for k, t in enumerate(texts) for v in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name, columns in (("protected_text", "doc_id, protected_text, n_placeholders, error"), ("protect_restore_roundtrip", "doc_id, text, error")):
        wanted = con.execute(f"SELECT {columns} FROM ({Q.SQL[name]}) ORDER BY doc_id").fetchall()
        assert [tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).select(*columns.split(", ")).orderBy("doc_id").collect()] == wanted


def test_chunk_payloads(spark):
    good = [{"chunk_id": "c", "source_text": "t", "separators": ["\n\n"]}]
    texts = [json.dumps(["a", "b"]), json.dumps(good), "{}", "no json", json.dumps([{"chunk_id": "c"}]), json.dumps([1]), "[]", json.dumps(["a", 1])]
    rows = chunking.parse_chunk_payload(spark.createDataFrame(list(enumerate(texts)), "doc_id long, payload string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["chunk_id"], r["source_text"], r["separators"], r["error"]))
    assert by[0] == [("chunk-0001", "a", [], None), ("chunk-0002", "b", [], None)] and by[1] == [("c", "t", ["\n\n"], None)]
    assert by[2][0][3] == by[3][0][3] == "chunks must be a JSON array" and by[4][0][3].startswith("chunk items must include")
    assert by[5][0][3] == by[7][0][3] == "chunks must be a JSON array of objects" and by[6] == [(None, None, None, None)]


GLOSSARY = [("Neural Network", "神经网络", "n", True), ("loss", "损失", "n", True), ("deep learning model", "深度", "n", True), ("C++", "C加", "n", True), ("art", "艺术", "n", True)]


def glossary_rows(spark, text):
    schema = "doc_id long, source_text string, glossary array<struct<term_en:string,term_zh:string,note_zh:string,keep_en_on_first_use:boolean>>"
    return spark.createDataFrame([(1, text, GLOSSARY)], schema)


@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_glossary_priorities_and_budget(spark, most_sent):
    rows = glossary_rows(spark, "A neural-network start. The LOSS of a deep model in c++.")
    terms = G.as_terms(rows)
    ranked = G.ranked_terms(rows, terms, ("doc_id",), most_sent=most_sent).first()["ranked"]
    assert [(r["priority"], r["entry"]["term_en"]) for r in ranked] == [(1, "Neural Network"), (2, "loss"), (2, "C++"), (3, "deep learning model")]
    kept = lambda **kw: [t["term_en"] for t in G.filter_glossary(rows, terms, ("doc_id",), most_sent=most_sent, **kw).first()["terms"]]
    assert kept(most_terms=2) == ["Neural Network", "loss"] and kept(most_chars=10) == ["loss"] and kept(most_terms=0) == []
    assert kept(most_chars=27) == ["Neural Network", "loss"]
    warned = rows.select(G.lost_forms(F.lit("the loss of art 艺术"), F.col("glossary")).alias("w")).first()["w"]
    assert warned == ["glossary term 'loss' missing Chinese form '损失'"]


def plain_priority(term, text):
    """The rule itself, for one pair."""
    fold = lambda t: " ".join(t.lower().replace("ß", "ss").replace("-", " ").split())
    f, c = fold(term), fold(text)
    words, there = set(re.findall("[a-z0-9]+", f)), set(re.findall("[a-z0-9]+", c))
    if not f or not c:
        return None
    if len(words) >= 2:
        return 1 if f in c else 3 if 2 * len(words & there) >= len(words) else None
    if re.search(r"[^\w\s]", f):
        return 2 if f in c else None
    return 2 if re.search(rf"\b{re.escape(f)}\b", c) else None


@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_glossary_join_equals_the_rule_for_every_pair(spark, monkeypatch, most_sent):
    monkeypatch.setattr(G, "HOT_CHUNKS", 20)
    rng = random.Random(8)
    parts = ["art", "b", "smart", "bus", "the", "c++", ".net", "node.js", "中文", "é", "caf", "café", "x_y", "(", ")", "a", "of", "of", "deep", "ß", "-", "1", "22", "++", "foo", "_", "'", "/"]
    made = lambda most: "".join(rng.choice(parts) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.randrange(most)))
    terms = [(g, k, made(5)) for g in (0, 1) for k in range(150)]
    texts = [(k, k % 2, made(25)) for k in range(150)] + [(500, 0, ""), (501, 1, None), (502, 7, "art")]
    got = G.matched_terms(spark.createDataFrame(texts, "id long, g int, source_text string"), spark.createDataFrame(terms, "g int, ord int, term_en string"), ("id",), ("g",), most_sent=most_sent)
    want = {(i, o, p) for i, g, t in texts for h, o, e in terms if g == h and (p := plain_priority(e, t or ""))}
    assert len(want) > 1000 and {p for *_, p in want} == {1, 2, 3}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_glossary_of_a_hundred_thousand_terms(spark):
    words = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in "bcdfglmnprst"]
    rng = random.Random(3)
    terms = [(0, k, f"{rng.choice(words)} {rng.choice(words)} {rng.choice(words)} {k}") for k in range(100_000)]
    texts = [(k, 0, " ".join(rng.choice(words) for _ in range(40)) + " " + terms[k][2]) for k in range(20)]
    chunks, glossary = spark.createDataFrame(texts, "id long, g int, source_text string"), spark.createDataFrame(terms, "g int, ord int, term_en string")
    ways = [{tuple(r) for r in G.matched_terms(chunks, glossary, ("id",), ("g",), most_sent=most).collect()} for most in (10**6, 0)]
    assert ways[0] == ways[1] and {(k, k, 1) for k in range(20)} <= ways[0]
    sample = rng.sample(range(100_000), 2000)
    assert {(i, o, p) for i, _, t in texts for o in sample if (p := plain_priority(terms[o][2], t))} == {x for x in ways[0] if x[1] in set(sample)}


PAGE = '<h1>One &amp; two</h1><script type="application/snapdown">a -&gt; b</script><h2> </h2><script type="application/snapdown+json">x</script><h2>Three</h2><script TYPE=\'application/snapdown\'>c</script><script type="application/snapdown"> </script>'


def test_diagrams(spark):
    assert [(d["content"], d["heading"]) for d in D.extract(PAGE)] == [("a -> b", "One & two"), ("c", "Three")]
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    found = diagrams.extract_diagrams(pages)
    assert sorted((r["content"], r["heading"]) for r in found.collect()) == [("a -> b", "One & two"), ("c", "Three")]
    docs = spark.createDataFrame([(1, "# Three\n\ntext\n"), (2, "# x\n")], "page_id long, md string")
    out = {r["page_id"]: r["md"] for r in diagrams.insert_diagrams(docs, found).collect()}
    assert out[2] == "# x\n" and out[1].count("a -> b") == out[1].count("\nc\n") == 1
    assert out[1].startswith("# Three\n\n```snapdown\nc\n```\n\ntext\n") and "## Snapdown Diagrams (extracted)\n\n```snapdown\na -> b\n```\n" in out[1]


@pytest.mark.parametrize(
    "response, expected",
    [('{"mermaid": "```mermaid\\ngraph `a`\\n```"}', "graph a"), ("graph b", "graph b"), ('{"other": 1}', None), ("", None), (None, None), ('["x"]', None), ('{"mermaid": 3}', None)],
)
def test_converter_answers(response, expected):
    assert D.answer(response) == expected


VALID = {"doc": {"title": "T", "source": {"type": "file", "value": "v"}, "language": {"source": "en", "target": "zh"}}, "outline": [{"level": 1, "heading": "H", "summary_bullets": "s", "key_takeaways": None}],
         "glossary": [{"term_en": "a|b", "term_zh": "z", "note_zh": "n\nm", "keep_en_on_first_use": False}], "style_guide": {"tone": "technical-but-friendly", "annotation_density": "medium", "rules": " "}}


def test_profiles():
    done = R.complete(R.parse(json.dumps(VALID)), "url", "u", "hint")
    assert done["doc"] == {"title": "T", "source": {"type": "url", "value": "u"}, "language": {"source": "en", "target": "zh-CN"}} and done["glossary"][0]["keep_en_on_first_use"]
    assert done["outline"][0]["summary_bullets"] == ["s"] and done["outline"][0]["key_takeaways"] == [] and done["style_guide"]["rules"] == []
    assert R.render(done) == "# T\n\n## Outline\n### H\n- Summary\n  - s\n\n## Glossary\n| Term (EN) | Term (ZH) | Note (ZH) | Keep EN First Use |\n| --- | --- | --- | --- |\n| a\\|b | z | n<br>m | true |\n"
    assert R.complete(VALID | {"doc": VALID["doc"] | {"title": " "}}, "file", "v", "hint")["doc"]["title"] == "hint"


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda p: p.pop("doc"), "doc must be a JSON object"), (lambda p: p["outline"][0].update(level=True), "outline[0].level must be an integer"), (lambda p: p["outline"][0].update(key_takeaways=[1]), "outline[0].key_takeaways[0] must be a string"),
        (lambda p: p["doc"]["source"].update(type="x"), "doc.source.type must be 'url' or 'file'"), (lambda p: p["style_guide"].update(annotation_density="low"), "style_guide.annotation_density must be 'medium'"),
        (lambda p: p["glossary"][0].update(keep_en_on_first_use=1), "glossary[0].keep_en_on_first_use must be a boolean"),
    ],
)
def test_broken_profiles(change, message):
    payload = json.loads(json.dumps(VALID))
    change(payload)
    with pytest.raises(R.ProfileError) as e:
        R.parse(json.dumps(payload))
    assert str(e.value) == message


def test_attempts_and_retries():
    answers = iter(["", "__URL_001__", "__URL_001__ __URL_002__"])
    client = model.FakeClient(lambda text, call: next(answers))
    assert model.best_attempt(client, [{"role": "user", "content": "x"}], ["__URL_001__", "__URL_002__"]) == ("__URL_001__ __URL_002__", 3)
    assert model.best_attempt(model.FakeClient(lambda t, k: "__URL_001__" if k == 2 else ""), [{"role": "user", "content": "x"}], ["__URL_001__", "__URL_002__"]) == ("__URL_001__", 3)
    with pytest.raises(RuntimeError, match="translation failed"):
        model.best_attempt(model.FakeClient(lambda t, k: ""), [{"role": "user", "content": "x"}], ["__URL_001__"])
    calls, said = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise model.TransientError("429")
        return "ok"

    assert model.Retry(5, 0.001, 0.002, said.append).call(flaky) == "ok" and len(calls) == 3 and len(said) == 2
    with pytest.raises(model.TransientError):
        model.Retry(2, 0.001, 0.002).call(lambda: (_ for _ in ()).throw(model.TransientError("x")))


def test_reader(spark):
    ok = json.dumps({"code": 200, "data": {"content": "- a\n```\nb\n```\n" + "x" * 200}})
    seen = []

    def transport(url, form, headers, timeout):
        seen.append((url, form))
        return (200, ok) if "good" in (url + str(form)) else (404, "no json")

    options = reader.ReaderOptions("https://r/", attempts=1)
    assert reader.fetch_one("https://good#x", options, transport).startswith("- a\n    ```\n    b\n    ```\n") and seen[0] == ("https://r/", {"url": "https://good#x"})
    with pytest.raises(reader.ReaderError, match="Unexpected HTTP 404 with non-JSON body"):
        reader.fetch_one("https://bad", options, transport)
    for body, message in ((json.dumps({"code": 1, "status": 2, "message": "m"}), "Unexpected response code=1 status=2 message=m"), (json.dumps({"code": 200}), "Missing content"), (json.dumps({"code": 200, "content": "x"}), "Content too short")):
        with pytest.raises(reader.ReaderError, match=message):
            reader.markdown_of(200, body, 200)
    urls = spark.createDataFrame([("https://good",), ("https://good",), ("https://bad",)], "url string")
    got = {r["url"]: r for r in reader.fetch_markdown(urls, options, transport=lambda u, f, h, t: (200, ok) if "good" in u else (404, "x")).collect()}
    assert len(got) == 2 and got["https://good"]["error"] is None and got["https://bad"]["md"] is None


def documents(spark, rows):
    return spark.createDataFrame([(i, "file", f"d/{i}.md", "", md) for i, md in rows], "doc_id long, source_type string, source_value string, title_hint string, md string")


MD = "# Title\n\nSome `code` and [a link](https://x.y).\n\n```python\nx = 1\n```\n\n## Next\n\nEnd of it.\n"


def test_translation_with_a_model_that_changes_nothing(spark):
    out = translate(documents(spark, [(1, MD), (2, "__URL_001__ x\n"), (3, "```\nopen")]), EchoClient, Options(concurrency=2, model="echo"))
    docs = {r["doc_id"]: r for r in out["documents"].collect()}
    # a chunk that ends in blank lines keeps one line end, so a heading may follow a fence directly
    assert docs[1]["error"] is None and docs[1]["text"].endswith(MD.replace("```\n\n## Next", "```\n## Next")) and docs[1]["text"].startswith("# 1.md\n\n## Meta\n- Source: file d/1.md\n")
    assert "## Outline\n_No outline entries._\n\n## Glossary\n_No glossary entries._\n" in docs[1]["text"]
    assert docs[2]["error"].startswith("input text contains") and docs[3]["error"].startswith("markdown guardrails failed")
    assert all(r["warnings"] == [] for r in out["chunks"].where("doc_id = 1").collect())


def test_one_failed_chunk_fails_its_document_only(spark):
    class Failing:
        def complete(self, messages, json_mode=False):
            if json_mode:
                return EchoClient().complete(messages, True)
            if "Bad" in messages[-1]["content"]:
                raise ValueError("no")
            return messages[-1]["content"].rpartition("\n<<<\n")[2].removesuffix("\n>>>").replace("`", "")

    out = translate(documents(spark, [(1, MD), (2, "# Good\n\nx\n\n# Bad\n\ny\n")]), Failing, Options(retry=model.Retry(1)))
    docs = {r["doc_id"]: r for r in out["documents"].collect()}
    assert docs[1]["error"] is None and docs[2]["error"] == "ValueError: no" and docs[2]["text"] is None
    with pytest.raises(ValueError, match="glossary_mode"):
        translate(documents(spark, []), Failing, Options(glossary_mode="x"))


def counted(notes, deadly=None):
    """Makes clients that note each call in a file, and whose process dies at the first chunk that holds ``deadly``."""

    class Counted(EchoClient):
        def complete(self, messages, json_mode=False):
            content = messages[-1]["content"]
            if deadly and not json_mode and deadly in content:
                import os

                os._exit(1)  # the worker is gone, and with it the task and the job
            with open(notes, "a") as f:
                f.write(json.dumps([json_mode, content[-60:]]) + "\n")
            return super().complete(messages, json_mode)

    return Counted


def test_a_killed_translation_takes_up_where_it_stopped(spark, tmp_path):
    notes, folder = str(tmp_path / "calls"), str(tmp_path / "work")
    docs = documents(spark, [(k, f"# Doc {k}\n\ntext {k}\n\n# More\n\nend {k}\n") for k in range(6)])
    options = Options(concurrency=2, waves=6)
    with pytest.raises(Exception, match="crashed|exited|EOF"):
        translate(docs, counted(notes, "text 3"), options, folder)
    before = [json.loads(x) for x in open(notes)]
    assert sum(j for j, _ in before) == 6 and 0 < sum(not j for j, _ in before) < 12  # all profiles, some chunks
    out = translate(docs, counted(notes), options, folder)
    calls = [json.loads(x) for x in open(notes)]
    assert {r["error"] for r in out["documents"].collect()} == {None} and sum(j for j, _ in calls) == 6
    kept_waves = {c for _, c in before} & {c for _, c in map(tuple, calls[len(before) :])}
    assert len(kept_waves) <= 2 + 12 // 6  # at most what the one wave that was lost had asked
    whole = sorted(map(tuple, out["documents"].select("doc_id", "text").collect()))
    again = translate(docs, counted(notes), options, folder)
    assert [json.loads(x) for x in open(notes)] == calls and sorted(map(tuple, again["documents"].select("doc_id", "text").collect())) == whole
    other = translate(docs.where("doc_id < 5").unionByName(documents(spark, [(9, "# Doc 1\n\ntext 1\n\n# More\n\nend 1\n")])), counted(notes), options, folder)
    assert other["documents"].count() == 6 and len([json.loads(x) for x in open(notes)]) == len(calls) + 1  # one new profile: its source differs; its chunks are known


def test_failures_are_asked_again_and_answers_are_not(spark, tmp_path):
    class Half:
        def complete(self, messages, json_mode=False):
            if messages[0]["content"] == "no":
                raise ValueError("down")
            return "yes"

    rows = spark.createDataFrame([(1, "a"), (2, "no"), (3, "a")], "k int, t string").select("k", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"))
    ask = lambda client: {r["k"]: (r["response"], r["error"], r["calls"]) for r in answered(rows, client, ("k",), str(tmp_path / "a"), "m", retry=model.Retry(1)).collect()}
    assert ask(Half) == {1: ("yes", None, 1), 2: (None, "ValueError: down", 0), 3: ("yes", None, 1)}
    assert ask(lambda: model.FakeClient(lambda t, k: "new")) == {1: ("yes", None, 0), 2: ("new", None, 1), 3: ("yes", None, 0)}


def test_merging_uses_the_last_separator(spark):
    chunks = spark.createDataFrame([(1, 0, ["\n\n", "\n\n\n"]), (1, 1, [""]), (2, 0, [""])], "doc_id long, idx long, separators array<string>")
    said = spark.createDataFrame([(1, 0, "a\n"), (1, 1, "b\n")], "doc_id long, idx long, text string")
    assert {r["doc_id"]: r["body"] for r in assemble.merge_translations(chunks, said).collect()} == {1: "a\n\n\nb\n", 2: None}


def test_merging_repeats_no_separator_that_ends_with_indentation(spark):
    chunks = spark.createDataFrame([(1, 0, ["\n\n  "]), (1, 1, [""])], "doc_id long, idx long, separators array<string>")
    said = spark.createDataFrame([(1, 0, "a\n\n  "), (1, 1, "b\n")], "doc_id long, idx long, text string")
    assert assemble.merge_translations(chunks, said).first()["body"] == "a\n\n  b\n"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n")
    (tmp_path / "urls.txt").write_text("# list\n https://x.y/a \n\nhttps://x.y/a\n")
    row = files.read_texts(spark, [str(tmp_path / "a.md")]).first()
    assert (row["title_hint"], row["md"], row["source_type"]) == ("a.md", "# A\n", "file")
    named = files.batch_paths(files.url_lists(spark, [str(tmp_path / "urls.txt")] * 2)).orderBy("idx").collect()
    assert [r["out_name"] for r in named] == [f"00{k}-x-y-a.md" for k in range(1, 5)]
    out = files.write_files(spark.createDataFrame([("x.md", "é\n"), ("y.md", None)], "out_name string, text string"), str(tmp_path)).collect()
    assert (tmp_path / "x.md").read_text() == "é\n" and {r["out_name"]: r["error"] for r in out} == {"x.md": None, "y.md": "no text"}
    with pytest.raises(FileNotFoundError):
        files.atomic_write_text(str(tmp_path / "no" / "x"), "a")
    assert not list(tmp_path.glob(".tmp-*"))


def test_url_lists_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("https://a\n# no\n\n")
    query = stream_urls(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("urls").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text(" https://b \n")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM urls").collect())) == [("https://a", "a.txt"), ("https://b", "b.txt")]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT md_autofix('a```js\nb\n```') AS a, size(md_lint('a```js')) AS n, md_sanitize(CAST(NULL AS STRING)) AS z, md_spans('`x`')[0].kind AS k, size(md_chunks('# a\n# b\n')) AS c").first()
    assert tuple(row) == ("a\n```js\nb\n```", 1, None, "INLINE_CODE", 2)


def test_table_functions(spark):
    register(spark)
    docs = spark.createDataFrame([(1, "a```js\nb\n```\n"), (2, "fine\n"), (3, None), (4, "`x` and `y`")], "doc_id long, md string")
    rows = spark.sql("SELECT d.doc_id, i.* FROM {docs} d, LATERAL md_issues(d.md) i", docs=docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(x) for x in ("ArrowEvalPythonUDTF", "BatchEvalPythonUDTF")) == 1 and "ArrowEvalPython " not in plan
    assert [(r["doc_id"], r["ord"], r["rule_id"], r["line"]) for r in rows.collect()] == [(1, 1, "FENCE_GLUE_AFTER_PROSE", 1), (1, 2, "FENCE_UNBALANCED", 3)]
    assert sorted(map(tuple, spark.sql("SELECT d.doc_id, s.* FROM {docs} d, LATERAL md_span_rows(d.md) s WHERE d.doc_id = 4", docs=docs).collect())) == [(4, 0, 3, "INLINE_CODE"), (4, 8, 11, "INLINE_CODE")]


@pytest.mark.parametrize("plan", ["lint_issues", "lint_report", "chunk_plan", "protect", "protected_spans", "sentence_pieces"])
def test_every_scanner_runs_once(spark, plan):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, md string")
    made = {"lint_issues": M.lint_issues, "lint_report": M.lint_report, "chunk_plan": chunking.chunk_plan, "protect": preserve.protect, "protected_spans": preserve.protected_spans, "sentence_pieces": lambda d: chunking.sentence_pieces(d, text_col="md")}
    shown = made[plan](docs)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("ArrowEvalPython") == 1


def test_lint_and_fix_plans(spark):
    docs = spark.createDataFrame([(1, "a```js\nb\n```\n"), (2, "```\nopen"), (3, "")], "doc_id long, md string")
    assert {r["rule_id"]: (r["n_issues"], r["n_docs"]) for r in lint_fix.lint_counts(docs).collect()} == {"FENCE_GLUE_AFTER_PROSE": (1, 1), "FENCE_UNBALANCED": (2, 2)}
    assert sorted(r["doc_id"] for r in lint_fix.fix(docs).where("size(issues) = 0").collect()) == [1, 3]


def test_command_line(spark, tmp_path, capsys):
    source, out, kept = tmp_path / "in.md", tmp_path / "out.md", tmp_path / "map.json"
    source.write_text("a```js\nb\n```\n")
    assert cli.main(["lint-md", "--in", str(source)]) == 1 and "FENCE_GLUE_AFTER_PROSE line 1" in capsys.readouterr().err
    assert cli.main(["lint-md", "--in", str(source), "--fix"]) == 2
    assert cli.main(["lint-md", "--in", str(source), "--fix", "--out", str(out)]) == 0 and out.read_text() == "a\n```js\nb\n```\n"
    assert cli.main(["sanitize-md", "--in", str(source), "--in-place"]) == 0 and source.read_text() == out.read_text()
    source.write_text(MD)
    assert cli.main(["debug-protect", "--in", str(source), "--out", str(out), "--map", str(kept)]) == 0
    assert cli.main(["debug-restore", "--in", str(out), "--out", str(tmp_path / "back.md"), "--map", str(kept)]) == 0 and (tmp_path / "back.md").read_text() == MD
    capsys.readouterr()
    assert cli.main(["debug-chunk", "--in", str(source), "--json"]) == 0
    (tmp_path / "chunks.json").write_text(capsys.readouterr().out)
    assert cli.main(["debug-reconstruct", "--chunks", str(tmp_path / "chunks.json")]) == 0 and capsys.readouterr().out == MD
    assert cli.main(["debug-protect", "--in", "no", "--out", "x", "--map", "y"]) == 1


def test_documents_from_addresses(spark):
    text = "# Three\n\n" + "words " * 60 + "\n"
    pages = {"https://r/https://a": (200, json.dumps({"code": 200, "content": text})), "https://a": (200, PAGE), "https://r/https://b": (200, json.dumps({"code": 200, "content": text})), "https://b": (500, "")}
    urls = spark.createDataFrame([("https://a", 1), ("https://b", 2), ("https://c", 3)], "url string, idx int")
    convert = converter(lambda: model.FakeClient(lambda t, k: json.dumps({"mermaid": "graph " + t[-1]})), 2)
    got = {r["idx"]: r for r in url_documents(urls, reader.ReaderOptions("https://r/", attempts=1), convert, lambda u, f, h, t: pages.get(u, (404, "x"))).collect()}
    assert got[1]["md"].startswith("# Three\n\n```mermaid\ngraph c\n```\n\nwords") and "```mermaid\ngraph b\n```" in got[1]["md"]
    assert got[2]["md"] == text and got[3]["error"] == "Unexpected HTTP 404 with non-JSON body" and len({r["doc_id"] for r in got.values()}) == 3


def test_options_from_the_environment():
    env = {"QUILLSPARK_STRICT": "Off", "QUILLSPARK_MAX_LIST_DEPTH": "-2", "QUILLSPARK_GLOSSARY_TERMS": "x", "QUILLSPARK_GLOSSARY_CHARS": "0"}
    options = Options.from_env(env, model="m")
    assert (options.strict, options.max_depth, options.most_terms, options.most_chars, options.model) == (False, 1, 30, 0, "m")


def test_the_archive_holds_the_package(tmp_path):
    import subprocess
    import sys

    from quillspark.shipping import archive

    path = archive(str(tmp_path / "quillspark.zip"))
    code = f"import sys; sys.path.insert(0, {path!r}); import quillspark.functions.lint as m; print(m.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.startswith(path)


def test_long_documents_fold_in_time(spark):
    import time

    docs = spark.createDataFrame([(1, "a\n```\nb\n```\n" * 15_000)], "doc_id long, md string")
    began = time.monotonic()
    assert M.fenced_lines(docs).where("in_fence").count() == 30_000
    assert time.monotonic() - began < 30
