"""Answers of slow or paid services, kept in an append-only log so that none is asked for twice.

A question has a SHA-256 key. What the log lacks is asked in slices of bounded size, and each slice is one append: a
run that ends early loses at most the slice it was in, and the next run asks only the rest. A lost executor repeats the
calls of its tasks, but an append shows its files only when the whole slice is done, so a key is kept once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir

SLICE_ROWS = 100_000


def with_retry(call: Callable, attempts: int = 3, first_wait: float = 4, top_wait: float = 10) -> Callable:
    """call(text) -> (result, attempt, error), waiting longer after each failure."""
    def run(body):
        wait = first_wait
        for i in range(1, attempts + 1):
            try:
                return call(body), i, None
            except Exception as err:  # noqa: BLE001
                if i == attempts:
                    return None, i, f"{type(err).__name__}: {err}"
                time.sleep(min(wait, top_wait))
                wait *= 2
        return None, attempts, "no attempt"

    return run


def _one_each(call: Callable[[list[str]], list]) -> Callable[[list[str]], list]:
    """A call whose answer has to match its texts, one for one."""
    def run(texts: list[str]) -> list:
        got = list(call(texts))
        if len(got) != len(texts) or any(g is None for g in got):
            raise ValueError(f"{sum(g is not None for g in got)} answers to {len(texts)} texts")
        return got

    return run


def log_schema(kind: str) -> str:
    return f"key string, answer {kind}, attempts int, error string, at timestamp, status string"


def known(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """All entries of a log; a log that is not there yet has none, one that can't be read is an error."""
    try:
        return spark.read.schema(log_schema(kind)).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], log_schema(kind))


def latest(log: DataFrame) -> DataFrame:
    """(key, answer, status, attempts, error): an answer before any failure, then the latest entry."""
    entry = F.struct("answer", "status", "attempts", "error")
    return log.groupBy("key").agg(F.max_by(entry, F.struct(F.col("status") == "ok", "at")).alias("e")).select("key", "e.*")


def missing(questions: DataFrame, log: DataFrame, retry_failed: bool = True) -> DataFrame:
    """(key, body) of the questions without an answer, each key once; a null body is no question."""
    done = log.where("status = 'ok'") if retry_failed else log
    open_ = questions.where("key is not null and body is not null").select("key", "body").dropDuplicates(["key"])
    return open_.join(done.select("key"), "key", "left_anti")


def ask(questions: DataFrame, path: str, call: Callable[[list[str]], list], kind: str = "string", attempts: int = 3,
        wait: float = 4, threads: int = 8, batch: int = 1, slice_rows: int = SLICE_ROWS, retry_failed: bool = True) -> int:
    """Ask for every (key, body) the log at path lacks, append the answers, and tell how many were asked for.

    call maps up to batch texts to as many answers. A text whose answer fails after all attempts is kept as failed,
    with its error, and asked again by a later run unless retry_failed is off; the others of its batch go out alone.
    """
    spark = questions.sparkSession
    todo = cut_lineage(missing(questions, known(spark, path, kind), retry_failed))
    n = todo.count()
    slices = -(-n // slice_rows)
    if slices > 1:                       # each slice in its own folder, so that it is read once
        folder = f"{shared_dir(spark)}/reportlens/questions-{uuid.uuid4().hex}"
        todo.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices))).write.partitionBy("slice").parquet(folder)
        todo = spark.read.schema("key string, body string, slice long").parquet(folder)
    run = with_retry(_one_each(call), attempts, wait)

    def together(texts: list[str]) -> list[tuple]:
        got, tries, error = run(texts)
        if error is None:
            return [(g, tries, None) for g in got]
        if len(texts) == 1:
            return [(None, tries, error)]
        return [row for text in texts for row in together([text])]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                texts = pdf["body"].tolist()
                parts = [texts[at:at + batch] for at in range(0, len(texts), batch)]
                got = [row for rows in pool.map(together, parts) for row in rows]
                yield pd.DataFrame({"key": pdf["key"], "answer": [g[0] for g in got], "attempts": [g[1] for g in got],
                                    "error": [g[2] for g in got]})

    tasks = spark.sparkContext.defaultParallelism
    for i in range(slices):
        part = todo if slices == 1 else todo.where(F.col("slice") == i)
        asked = part.select("key", "body").repartition(tasks, "key") \
            .mapInPandas(answer, f"key string, answer {kind}, attempts int, error string")
        asked.withColumns({"at": F.current_timestamp(), "status": F.when(F.col("error").isNull(), "ok").otherwise("failed")}) \
            .write.mode("append").partitionBy("status").parquet(path)
    return n


def answered(questions: DataFrame, path: str, call: Callable[[list[str]], list], kind: str = "string", **options) -> DataFrame:
    """The questions with answer, status, attempts and error; what the log lacks is asked for first."""
    ask(questions, path, call, kind, **options)
    return questions.join(latest(known(questions.sparkSession, path, kind)), "key", "left")
