"""Documents from addresses: a reader service over HTTP, and a stand-in over a table of pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.autofix import indent_list_blocks
from quillspark.operators.model import Retry, TransientError, is_transient


@dataclass(frozen=True)
class ReaderOptions:
    """Limits of the reader service; times in seconds."""

    base_url: str = ""
    least_chars: int = 200
    timeout: int = 30
    attempts: int = 5
    first_pause: float = 1.0
    longest_pause: float = 20.0
    key: str | None = None


class ReaderError(RuntimeError):
    pass


class Transport(Protocol):
    """GET, or POST with a form: status and body."""

    def __call__(self, url: str, form: dict | None, headers: dict[str, str], timeout: int) -> tuple[int, str]: ...


def http(url: str, form: dict | None, headers: dict[str, str], timeout: int) -> tuple[int, str]:
    import requests

    try:
        sent = requests.post(url, data=form, headers=headers, timeout=timeout) if form else requests.get(url, headers=headers, timeout=timeout)
    except requests.RequestException as e:
        raise TransientError(str(e)) from e
    return sent.status_code, sent.text


def headers_of(options: ReaderOptions) -> dict[str, str]:
    return {"Accept": "application/json", "X-Return-Format": "markdown"} | ({"Authorization": f"Bearer {options.key}"} if options.key else {})


def content_of(payload: dict) -> str | None:
    """The text of an answer, on top or under data."""
    data = payload.get("data")
    options = (payload.get("content"), data.get("content") if isinstance(data, dict) else None)
    return next((c for c in options if isinstance(c, str)), None)


def markdown_of(status: int, body: str, least_chars: int) -> str:
    """The text of an answer whose status, code and length are as they should be."""
    try:
        payload = json.loads(body)
    except ValueError:
        payload = None
    payload = payload if isinstance(payload, dict) else None
    if status != 200 or payload is not None and payload.get("code") != 200:
        if payload is None:
            raise ReaderError(f"Unexpected HTTP {status} with non-JSON body")
        raise ReaderError(f"Unexpected response code={payload.get('code')} status={payload.get('status')} message={payload.get('message')}")
    if payload is None:
        raise ReaderError("Expected JSON response from reader service")
    content = content_of(payload)
    if not content:
        raise ReaderError("Missing content in reader response")
    if len(content) < least_chars:
        raise ReaderError(f"Content too short ({len(content)} < {least_chars})")
    return indent_list_blocks(content)


def route(url: Column) -> Column:
    """GET for an address, POST for one with a fragment, which a path can't carry."""
    return F.when(F.contains(url, F.lit("#")), "POST").otherwise("GET")


def fetch_one(url: str, options: ReaderOptions, transport: Transport = http) -> str:
    clean = url.strip()
    if not clean:
        raise ReaderError("URL must be a non-empty string")

    def attempt() -> str:
        form = {"url": clean} if "#" in clean else None
        status, body = transport(options.base_url if form else options.base_url + clean, form, headers_of(options), options.timeout)
        if is_transient(status):
            raise TransientError(f"Transient HTTP {status} from reader service")
        return markdown_of(status, body, options.least_chars)

    return Retry(options.attempts, options.first_pause, options.longest_pause).call(attempt)


def fetch_markdown(urls: DataFrame, options: ReaderOptions, url_col: str = "url", transport: Transport = http, concurrency: int = 3) -> DataFrame:
    """url, md, error; distinct addresses are fetched once."""
    return _fetched(urls, lambda u: fetch_one(u, options, transport), "md", url_col, concurrency)


def fetch_html(urls: DataFrame, timeout: int = 30, url_col: str = "url", transport: Transport = http, concurrency: int = 3) -> DataFrame:
    """url, html, error: raw pages, for enrichment only - a failure leaves html null."""

    def one(url: str) -> str:
        status, body = transport(url.strip(), None, {"User-Agent": "quillspark/1.0"}, timeout)
        if status >= 400:
            raise ReaderError(f"HTTP {status}")
        return body

    return _fetched(urls, one, "html", url_col, concurrency)


def _fetched(urls: DataFrame, one: Callable[[str], str], to: str, url_col: str, concurrency: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for url in batch.column(0).to_pylist():
                try:
                    texts.append(one(url))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a failed address belongs to its row
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["url", to, "error"])

    distinct = urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    return distinct.repartition(concurrency, "url").mapInArrow(run, f"url string, {to} string, error string")
