"""Answers of a model as a table that outlives runs: what was answered once isn't asked again.

The table is addressed by content: a row's key is a digest of its messages, the model's name and the
kind of answer.  Questions without an answer there are asked in ``waves``, jobs of
their own, each of which appends its answers before the next begins; a run that is killed loses one wave at
most.  Failures are noted with the run that met them and count for it alone, so the next run asks again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.operators.model import Client, Retry, complete

ANSWER = "request string, response string, error string, calls long, run string, json boolean"


def request_key(messages: Column, model: str, json_mode: bool) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n{json_mode}\n"), F.to_json(messages)).cast("binary"), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def known_answers(spark: SparkSession, path: str) -> DataFrame:
    """request, response, one row each, of the answers that are there."""
    rows = spark.read.schema(ANSWER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], ANSWER)
    return rows.where("error IS NULL").groupBy("request").agg(F.min_by("response", "response").alias("response"))


def known_or_not(rows: DataFrame, path: str, model: str, json_mode: bool = False) -> DataFrame:
    """``rows`` with messages, and a column known: whether the table of answers has theirs."""
    keyed = rows.withColumn("__request", request_key(F.col("messages"), model, json_mode))
    known = known_answers(rows.sparkSession, path).select(F.col("request").alias("__request"), F.lit(True).alias("known"))
    return keyed.join(known, "__request", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("__request")


def answered(rows: DataFrame, make_client: Callable[[], Client], key_cols: tuple[str, ...], path: str, model: str, json_mode: bool = False, concurrency: int = 3, retry: Retry = Retry(), waves: int = 1) -> DataFrame:
    """key columns, response, error, calls (0 for an answer that was there) for rows with messages and, optionally, placeholders.

    Eager: the questions are asked when this returns.  ``path``: the table of answers, in a folder that executors share.
    """
    spark, run = rows.sparkSession, str(uuid.uuid4())
    asked = rows.withColumn("request", request_key(F.col("messages"), model, json_mode))
    held = ["messages", *(["placeholders"] if "placeholders" in rows.columns else [])]
    open_ = asked.select("request", *held)
    if _exists(spark, path):
        known = spark.read.schema(ANSWER).parquet(path).where(F.col("error").isNull() & F.coalesce(F.col("json") == json_mode, F.lit(True)))
        if not known.isEmpty():  # a join would shuffle the messages
            open_ = open_.join(known.select("request"), "request", "left_anti")
    for wave in range(waves):
        part = open_.where(F.pmod(F.xxhash64("request"), F.lit(waves)) == wave) if waves > 1 else open_
        said = complete(part, make_client, ("request",), json_mode, concurrency, retry, distinct=True)
        said.withColumns({"run": F.lit(run), "json": F.lit(json_mode)}).write.mode("append").parquet(path)
    own = F.col("run") == run  # what this run asked, with the reason where there is no answer
    told = spark.read.schema(ANSWER).parquet(path).groupBy("request").agg(F.min("response").alias("response"), F.max(F.when(own, F.col("error"))).alias("error"), F.max(F.when(own, F.col("calls"))).alias("calls"))
    met = asked.select(*key_cols, "request").join(told, "request", "left")
    return met.select(*key_cols, "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"), F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))
