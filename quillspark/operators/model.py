"""The language-model step: a client per partition, retries, placeholder attempts, failures in their row."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.functions.answers import missing
from quillspark.functions.arrow import slices


class Client(Protocol):
    """What answers messages.  ``json_mode`` asks for a JSON object."""

    def complete(self, messages: list[dict], json_mode: bool = False) -> str: ...


class TransientError(RuntimeError):
    """A failure worth a retry: rate limits, server errors, lost connections."""


@dataclass(frozen=True)
class Retry:
    """Transport attempts with growing, jittered pauses.  ``log`` gets a line for each retry."""

    attempts: int = 5
    first: float = 1.0
    longest: float = 20.0
    log: Callable[[str], None] | None = None

    def call(self, function: Callable[[], str]) -> str:
        for k in range(1, self.attempts + 1):
            try:
                return function()
            except TransientError as e:
                if k == self.attempts:
                    raise
                pause = random.uniform(0, min(self.longest, self.first * 2**k))
                if self.log:
                    self.log(f"retry attempt={k} error={e} sleep={pause:.2f}s")
                time.sleep(pause)
        raise AssertionError("unreachable")


class FakeClient:
    """A client for tests: echoes what stands between the markers, as ``change(text, call)`` leaves it."""

    def __init__(self, change: Callable[[str, int], str] = lambda text, call: text):
        self.change, self.calls = change, 0

    def complete(self, messages: list[dict], json_mode: bool = False) -> str:
        self.calls += 1
        content = messages[-1]["content"]
        body = content.rpartition("\n<<<\n")[2] if "\n<<<\n" in content else content
        return self.change(body.removesuffix("\n>>>"), self.calls)


def is_transient(status: int) -> bool:
    return status == 429 or status >= 500


class HttpChatClient:
    """A chat-completions service over HTTP; the answer must be whole and not empty."""

    def __init__(self, base_url: str, model: str, key: str, timeout: float = 180.0):
        if not key:
            raise ValueError("an API key is required")
        self.url, self.model, self.key, self.timeout = base_url.rstrip("/") + "/chat/completions", model, key, timeout

    def complete(self, messages: list[dict], json_mode: bool = False) -> str:
        import requests

        body = {"model": self.model, "messages": messages} | ({"response_format": {"type": "json_object"}} if json_mode else {})
        try:
            response = requests.post(self.url, json=body, headers={"Authorization": f"Bearer {self.key}"}, timeout=self.timeout)
        except requests.RequestException as e:
            raise TransientError(str(e)) from e
        if is_transient(response.status_code):
            raise TransientError(f"HTTP {response.status_code}")
        response.raise_for_status()
        choice = (response.json().get("choices") or [None])[0]
        if choice is None:
            raise RuntimeError("chat completion returned no choices")
        if choice.get("finish_reason") != "stop":
            raise RuntimeError(f"chat completion truncated (finish_reason={choice.get('finish_reason')})")
        if not (content := (choice.get("message") or {}).get("content")):
            raise RuntimeError("chat completion returned empty content")
        return content


def best_attempt(client: Client, messages: list[dict], expected: list[str], attempts: int = 3) -> tuple[str, int]:
    """The first answer with every placeholder, else the one that lacks fewest; and how many calls it took."""
    best, lacks = None, len(expected)
    for k in range(1, (attempts if expected else 1) + 1):
        answer = client.complete(messages)
        if not (n := missing(answer, expected)):
            return answer, k
        if n < lacks:
            best, lacks = answer, n
    if best is None:
        raise RuntimeError("translation failed after placeholder validation retries")
    return best, attempts


def complete(rows: DataFrame, make_client: Callable[[], Client], key_cols: tuple[str, ...], json_mode: bool = False, concurrency: int = 3, retry: Retry = Retry(), distinct: bool = False) -> DataFrame:
    """key columns, response, error, calls for rows with messages and, optionally, placeholders; ``distinct``: one row a key, whose rows ask the same.

    One client a partition; ``concurrency`` partitions, so as many calls at once.  A
    retried task repeats its calls: write the result before using it twice.
    """
    has = "placeholders" in rows.columns
    given = rows.select(*key_cols, "messages", *(["placeholders"] if has else [F.array().cast("array<string>").alias("placeholders")]))
    n = len(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, last = make_client(), None
        for batch in slices(batches):
            if distinct:  # rows of a key are neighbours
                keys = list(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True))
                batch = batch.filter(pa.array([k != before for before, k in zip([last, *keys], keys)], pa.bool_()))
                last = keys[-1]
            out = []
            for messages, expected in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                try:
                    if json_mode:
                        out.append((retry.call(lambda m=messages: client.complete(m, True)), None, 1))
                    else:
                        answer, calls = best_attempt(_Retrying(client, retry), messages, expected or [])
                        out.append((answer, None, calls))
                except Exception as e:  # noqa: BLE001  whatever a client raises belongs to its row
                    out.append((None, f"{type(e).__name__}: {e}", 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())],
                names=[*key_cols, "response", "error", "calls"],
            )

    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key_cols)
    dealt = given.repartition(concurrency, *key_cols)
    return (dealt.sortWithinPartitions(*key_cols) if distinct else dealt).mapInArrow(run, f"{keys}, response string, error string, calls long")


class _Retrying:
    def __init__(self, client: Client, retry: Retry):
        self.client, self.retry = client, retry

    def complete(self, messages: list[dict], json_mode: bool = False) -> str:
        return self.retry.call(lambda: self.client.complete(messages, json_mode))


def best_of_attempts(attempts: DataFrame, key_cols: tuple[str, ...]) -> DataFrame:
    """key columns, text, n_missing, attempt chosen from rows of attempt, text, placeholders.

    The first complete attempt wins, else the one that lacks fewest, the earliest of these; an attempt
    that lacks every placeholder never does, and then there is no row.
    """
    lacks = F.size(F.filter("placeholders", lambda p: ~F.contains(F.col("text"), p)))
    rated = attempts.withColumn("n_missing", lacks.cast("long"))
    useful = rated.where((F.col("n_missing") < F.size("placeholders")) | (F.size("placeholders") == 0))
    best = F.min_by(F.struct("text", "n_missing", "attempt"), F.struct("n_missing", "attempt"))
    return useful.groupBy(*key_cols).agg(best.alias("b")).select(*key_cols, "b.text", "b.n_missing", "b.attempt")
