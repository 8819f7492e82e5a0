"""Readers: parallel folders of one file a stem, JSON lines, JSON arrays, CSV with unknown separators, Parquet."""

from __future__ import annotations

import csv
import io
import itertools
import os
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Column of the wide table -> folder and extension.
ARTIFACTS = {"user_prompt": ".txt", "user_prompt_question": ".txt", "report": ".txt", "json": ".json", "json_schema": ".json"}


class NoRows(ValueError):
    """A source that must not be empty is."""


def artifacts(spark: SparkSession, path: str, extension: str = ".txt", value: str = "value") -> DataFrame:
    """(stem, file_name, value) of the files of a folder, or of one file; order by file_name where order counts."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{extension}")
    name = F.col("_metadata.file_name")
    return files.select(F.regexp_replace(name, "\\.[^.]*$", "").alias("stem"), name.alias("file_name"), F.col("value").alias(value)).where(~F.col("file_name").startswith("~$"))


def wide(spark: SparkSession, root: str, folders: dict[str, str] = ARTIFACTS) -> DataFrame:
    """(id, user_prompt, json, json_schema, report, user_prompt_question): a row for each prompt, null where a folder has no such stem."""
    out = artifacts(spark, f"{root}/user_prompt", folders["user_prompt"], "user_prompt").drop("file_name")
    for name, extension in folders.items():
        if name != "user_prompt":
            if os.path.isdir(f"{root}/{name}") or "://" in root:
                out = out.join(artifacts(spark, f"{root}/{name}", extension, name).drop("file_name"), "stem", "left")
            else:
                out = out.withColumn(name, F.lit(None).cast("string"))
    return out.select(F.col("stem").alias("id"), "user_prompt", "json", "json_schema", "report", "user_prompt_question")


def texts(spark: SparkSession, paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with a column ``value``: the UTF-8 text of each file, null where it can't be read or decoded. Files that executors reach by their path."""

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for _, row in pdf.iterrows():
                yield pd.DataFrame([[*row, _text(row[path])]], columns=[*pdf.columns, "value"])

    return paths.mapInPandas(work, StructType([*paths.schema.fields, StructField("value", StringType())]))


def _text(path: str | None) -> str | None:
    try:
        with open((path or "").removeprefix("file://"), encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


def jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines: strict stops at a bad line; otherwise bad and blank lines are dropped and an empty result is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if not strict and df.isEmpty():
        raise NoRows(path)
    return df


def json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def sniff_separator(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def csv_table(spark: SparkSession, path: str, sep: str | None = None, columns: list[str] | None = None, most: int | None = None, encoding: str = "UTF-8", skip_rows: int = 0, types: dict[str, str] | None = None) -> DataFrame:
    """A CSV table with a header; the separator is told from the first lines unless given.

    Columns are strings, or of the Spark type that ``types`` gives for their names (values that aren't of it stop the
    query). ``skip_rows`` lines come before the header of each file; then a file is read as one text, as only that tells which lines these are.
    """
    if skip_rows:
        texts = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", f"^(?:[^\n]*\n){{{skip_rows}}}", "").alias("value"))
        lines = [r["value"] for r in texts.select(F.slice(F.split("value", "\r?\n"), 1, 20).alias("v")).limit(1).select(F.explode("v").alias("value")).collect()]
    else:
        lines = [r["value"] for r in spark.read.text(path).limit(20).collect()]
    sep = sep or sniff_separator("\n".join(x.lstrip("﻿") for x in lines))
    if skip_rows:
        head = next(csv.reader(lines[:1], delimiter=sep), [])
        rows = texts.mapInPandas(lambda pdfs: _parsed(pdfs, sep, len(head)), StructType([StructField(f"c{k}", StringType()) for k in range(len(head))]))
        df = rows.toDF(*head) if head else spark.createDataFrame([], StructType())
    else:
        df = spark.read.option("header", "true").option("sep", sep).option("escape", '"').option("encoding", encoding).option("multiLine", "true").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip().replace("\n", " ") for c in df.columns])
    df = df.select(*[f"`{c}`" for c in columns]) if columns else df
    df = df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in (types or {}).items()})
    return df.limit(most) if most is not None else df


def _parsed(pdfs: Iterator[pd.DataFrame], sep: str, width: int) -> Iterator[pd.DataFrame]:
    """The records below the header of whole files, in runs of bounded length."""
    names = [f"c{k}" for k in range(width)]
    for pdf in pdfs:
        for text in pdf["value"]:
            records = (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r)
            next(records, None)
            while run := list(itertools.islice(records, 10_000)):
                yield pd.DataFrame([[v or None for v in (r + [""] * width)[:width]] for r in run], columns=names)


class DatasetProvider(Protocol):
    """What stands for a hub of datasets; a real one lives outside."""

    def load(self, spark: SparkSession, name: str, split: str, token: str | None) -> DataFrame: ...


class FolderProvider:
    """Datasets as folders root/name/split of Parquet, or root/name/split.jsonl and root/name/split.parquet."""

    def __init__(self, root: str, schema: str | StructType | None = None):
        self.root, self.schema = root.rstrip("/"), schema

    def load(self, spark: SparkSession, name: str, split: str = "train", token: str | None = None) -> DataFrame:
        at = f"{self.root}/{name}/{split}"
        for path, kind in ((at, "parquet"), (f"{at}.parquet", "parquet"), (f"{at}.jsonl", "json")):
            try:
                reader = spark.read if self.schema is None else spark.read.schema(self.schema)
                return reader.format(kind).load(path)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        raise FileNotFoundError(at)


def dataset(spark: SparkSession, provider: DatasetProvider, name: str, split: str = "train", columns: list[str] | None = None, token: str | None = None) -> DataFrame:
    """A split of a dataset by name; the token is by default that of the settings."""
    df = provider.load(spark, name, split, token or setting(spark, "HF_TOKEN"))
    return df.select(*columns) if columns else df


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting by its name in the environment (LLM_MODEL, HF_TOKEN); the session's spark.tessera.<name in lower case, with dots> comes first."""
    return spark.conf.get(f"spark.tessera.{name.lower().replace('_', '.')}", None) or os.environ.get(name, default)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def workbook_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".xlsx", ".xls", ".xlsm", ".xlsb")) -> DataFrame:
    """(path, file_name, stem) of the workbooks below a folder, without office programs' temporary files and without reading contents."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", name.alias("file_name"))
    wanted = F.lower(F.regexp_extract("file_name", "(\\.[^.]*)$", 1)).isin(*extensions)
    return files.where(wanted & ~F.col("file_name").startswith("~$")).withColumn("stem", F.regexp_replace("file_name", "\\.[^.]*$", ""))


def peek(df: DataFrame, n: int = 3, width: int = 300) -> DataFrame:
    """The first rows with strings cut short."""
    return df.limit(n).select(*[F.substring(F.col(f.name).cast("string"), 1, width).alias(f.name) for f in df.schema.fields])


def project_root(start: str, marks: tuple[str, ...] = ("pyproject.toml", ".git")) -> str:
    """The nearest folder upwards that holds one of the marks."""
    at = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in marks):
            return at
        if os.path.dirname(at) == at:
            raise FileNotFoundError(f"no {' or '.join(marks)} above {start}")
        at = os.path.dirname(at)


def prompt_template(root: str, name: str) -> str:
    with open(os.path.join(root, "prompt", name), encoding="utf-8") as f:
        return f.read()
