"""Incremental work: files that arrive are processed once, by a stream's checkpoint or by a ledger of stems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import lacking


def process_new_files(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], extension: str = ".txt") -> int:
    """Gives handle(batch of (stem, value), number) all files that no earlier call with this checkpoint has processed; returns how many."""
    seen = {"n": 0}

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "").alias("stem"), "value")
        seen["n"] += rows.count()
        handle(rows, number)

    stream = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", f"*{extension}").load(folder)
    query = stream.select("value", F.col("_metadata.file_path").alias("path")).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen["n"]


def resume(df: DataFrame, ledger: str, key: str, work: Callable[[DataFrame], tuple[DataFrame, DataFrame]], output: str) -> None:
    """One resumable pass: rows whose key the ledger lacks go through work, which gives (output rows, ledger rows).

    The output is written before the ledger and both by commit, so a crash in between leads to repeated, never to lost work.
    """
    spark = df.sparkSession
    try:
        done = spark.read.parquet(ledger)
        df = lacking(df, done, key)
    except Exception as e:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    out, status = work(df)
    out.write.mode("append").json(output)
    status.write.mode("append").parquet(ledger)
