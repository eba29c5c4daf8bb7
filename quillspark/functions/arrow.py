"""Arrow UDFs over text scanners: one batch crosses to Python, failures stay in their row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType, _parse_datatype_string


#: Most bytes of a batch that are Python objects at a time; a larger row is taken alone.
SLICE = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``most`` bytes: memory for Python objects doesn't grow with a batch."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_function(function: Callable, returns: str, streamed: bool = False):
    """An Arrow UDF, to be called on columns or registered for SQL; a null argument gives null.

    One that is ``streamed`` hands its rows on part by part, so that no batch of results is held; it has a step of the plan for itself.
    """
    kind: DataType = _parse_datatype_string(returns)
    arrow = to_arrow_type(kind)

    def parts(arrays: Iterable[pa.Array]) -> Iterator[pa.Array]:
        for part in slices([pa.RecordBatch.from_arrays(list(arrays), [str(k) for k in range(len(arrays))])]):
            rows = zip(*(a.to_pylist() for a in part.columns), strict=True)
            yield pa.array([None if None in row else function(*row) for row in rows], arrow)

    if streamed:

        @F.arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for given in batches:  # of one column, the array itself
                yield from parts(given if isinstance(given, tuple) else (given,))

    else:

        @F.arrow_udf(kind)
        def run(*arrays: pa.Array) -> pa.Array:
            return pa.concat_arrays([pa.array([], arrow), *parts(arrays)])

    return run


def scanner(function: Callable, returns: str, streamed: bool = False) -> Callable[..., Column]:
    """A column function from a Python function of one text or more; made when it is first called."""
    made: list = []

    def call(*columns: Column) -> Column:
        if not made:
            made.append(arrow_function(function, returns, streamed))
        return made[0](*columns)

    return call


def once(value: Column) -> Column:
    """A column that a select computes once a row, whatever later steps filter, explode or take apart: a generator isn't inlined."""
    return F.explode(F.array(value))


def checked(function: Callable, returns: str, *errors: type[Exception]) -> Callable[..., Column]:
    """Like ``scanner``, for functions that may refuse a row: struct<value, error>, one of them null."""
    inner = _parse_datatype_string(returns)

    def attempt(*row):
        try:
            return {"value": function(*row), "error": None}
        except errors as e:
            return {"value": None, "error": str(e)}

    return scanner(attempt, StructType().add("value", inner).add("error", "string").simpleString(), streamed=True)
