"""Documents from files and addresses, as the translation plan takes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quillspark.functions import columns as C
from quillspark.operators import diagrams as D, messages as P
from quillspark.operators.answers import answered
from quillspark.operators.model import Client, Retry, complete
from quillspark.sources.reader import ReaderOptions, Transport, fetch_html, fetch_markdown, http


def converter(make_client: Callable[[], Client], concurrency: int = 3, retry: Retry = Retry(), answers: str | None = None, model: str = "unknown") -> Callable[[DataFrame], DataFrame]:
    """A diagram converter for ``convert_diagrams``: one model call for each distinct content.

    ``answers``: a table in a folder that executors share; contents that it holds an answer for aren't asked again, in any later run.
    """

    def convert(contents: DataFrame) -> DataFrame:
        asked = contents.select("content_sha1", P.diagram_messages(F.col("content")).alias("messages"))
        if answers:
            said = answered(asked, make_client, ("content_sha1",), answers, model, True, concurrency, retry)
        else:
            said = complete(asked, make_client, ("content_sha1",), True, concurrency, retry)
        return said.select("content_sha1", C.unwrap_json_fence(F.col("response")).alias("response"))

    return convert


def url_documents(urls: DataFrame, options: ReaderOptions, convert: Callable[[DataFrame], DataFrame] | None = None, transport: Transport = http, concurrency: int = 3, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``urls`` (url and other columns) with doc_id, source_type, source_value, title_hint, md, error.

    Diagrams of the raw page go into the text under their headings, converted if ``convert`` is given;
    a page that can't be fetched raw only lacks them.  ``keep`` writes and rereads what was fetched.
    """
    texts = keep(fetch_markdown(urls, options, transport=transport, concurrency=concurrency))
    raw = keep(fetch_html(texts.where("error IS NULL"), options.timeout, transport=transport, concurrency=concurrency))
    found = D.extract_diagrams(raw.where("html IS NOT NULL"), "url")
    found = D.convert_diagrams(found, convert) if convert else found
    whole = D.insert_diagrams(texts, found, "url")
    ids = urls.withColumn("doc_id", F.xxhash64(*urls.columns)).withColumn("source_type", F.lit("url")).withColumn("source_value", F.col("url")).withColumn("title_hint", F.lit(""))
    return ids.join(whole, "url", "left")
