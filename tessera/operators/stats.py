"""Summaries: metrics of predictions, lengths, duplicates, fill ratios, counts of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import approx_tokens
from ..functions.udfs import METRICS, eval_json, schema_error
from .ranks import fresh

CUTOFFS, PERCENTILES = (2048, 4096, 8192, 16384), (50, 75, 90, 95, 99)


def evaluated(df: DataFrame, pred: str = "pred_json", gold: str = "gold_json", schema: str = "json_schema") -> DataFrame:
    """df with no_output, exact_match, schema_valid, noise_ratio and value_match of each row (replaced if they are there), from one Python call."""
    m = fresh(df, "_m")
    scored = df.withColumn(m, eval_json(pred, gold, schema))
    return scored.withColumns({f: F.col(m)[f] for f in METRICS.names}).drop(m)


def summary(df: DataFrame, judged: str | None = None) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    more = [F.avg(judged).alias("llm_score")] if judged else []
    return df.agg(F.count("*").alias("n"), share("no_output"), share("exact_match"), share("schema_valid"), F.avg("noise_ratio").alias("noise_ratio"), F.avg("value_match").alias("value_match"), *more)


def length_stats(df: DataFrame, length: Column, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Mean, exact percentiles, maximum, and how many (and what share) exceed each cutoff, in one aggregate."""
    df = df.select(length.alias("x"))
    p = F.percentile("x", F.array(*[F.lit(q / 100) for q in PERCENTILES]))
    out = df.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), p.alias("p"), F.max("x").alias("max"), *[F.count_if(F.col("x") > c).alias(f"over_{c}") for c in cutoffs])
    return out.select("n", "mean", *[F.get("p", F.lit(k)).alias(f"p{q}") for k, q in enumerate(PERCENTILES)], "max", *[F.col(f"over_{c}") for c in cutoffs], *[(F.col(f"over_{c}") * 100.0 / F.col("n")).alias(f"over_{c}_pct") for c in cutoffs])


def recommended_cutoffs(df: DataFrame, length: Column, cutoff: int = 8192) -> DataFrame:
    """How many fit the cutoff and how many don't, and the cutoffs that would keep 90, 95 and 99 %; lengths that fail count 0."""
    return df.select(F.coalesce(length, F.lit(0)).alias("x")).agg(*cutoff_counts(F.col("x"), cutoff))


def cutoff_counts(x: Column, cutoff: int) -> list[Column]:
    return [F.count_if(x <= cutoff).alias("fits"), F.count_if(x > cutoff).alias("exceeds"), *[F.floor(F.percentile(x, F.lit(q / 100))).cast("bigint").alias(f"cutoff_p{q}") for q in (90, 95, 99)]]


def short_enough(df: DataFrame, text: str, most: int, count=approx_tokens) -> DataFrame:
    """Rows of at most ``most`` tokens by the counter given."""
    return df.where(count(F.col(text)) <= most)


def duplicates(df: DataFrame, first_user: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), repeats(first_user))


def repeats(text: Column) -> Column:
    """How many texts came before; nulls count as empty."""
    return (F.count("*") - F.count_distinct(F.coalesce(text, F.lit("")))).alias("duplicates")


def outcomes(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def fill_ratio(cells: DataFrame, files: DataFrame | None = None, threshold: float = 0.6, file: str = "file", value: str = "value") -> DataFrame:
    """(file, filled, cells, ratio, sparse): the share of cells with a value; files without cells have ratio 0."""
    counts = cells.groupBy(file).agg(F.count(value).alias("filled"), F.count("*").alias("cells"))
    if files is not None:
        counts = files.select(file).distinct().join(counts, file, "left").na.fill(0, ["filled", "cells"])
    ratio = F.when(F.col("cells") > 0, F.col("filled") / F.col("cells")).otherwise(F.lit(0.0))
    return counts.withColumn("ratio", ratio).withColumn("sparse", F.col("ratio") < threshold)


def audited(values: DataFrame, schemas: DataFrame, stem: str = "stem") -> DataFrame:
    """(stem, status, error): valid, invalid (empty objects and lists too) or missing_schema."""
    from ..functions.udfs import empty_json

    rows = values.join(schemas, stem, "left").withColumn("error", schema_error("json", "json_schema")).withColumn("empty", empty_json("json"))
    status = F.when(F.col("json_schema").isNull(), "missing_schema").when(F.col("empty") | F.col("error").isNotNull(), "invalid").otherwise("valid")
    return rows.select(stem, status.alias("status"), F.when(F.col("json_schema").isNotNull(), F.when(F.col("empty"), "empty").otherwise(F.col("error"))).alias("error"))
