"""Sinks: JSON lines, JSON arrays, a file for each stem, workbooks, registries, and plans of deletions and renames."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display_cell, safe_sheet_name
from ..operators.relational import free_numbers
from .readers import ARTIFACTS
from .xlsx import workbook_bytes


def write_jsonl(df: DataFrame, path: str, append: bool = False, single: bool = False) -> None:
    """JSON lines; each write is committed as a whole, so a crash leaves no half lines."""
    (df.coalesce(1) if single else df).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str, drop: tuple[str, ...] = ("stem",)) -> int:
    """One pretty JSON array, streamed row by row; returns the number of rows. For results that fit one file."""
    rows = df.drop(*[c for c in drop if c in df.columns]).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in rows.toLocalIterator():
            f.write((",\n" if n else "\n") + "\n".join("  " + x for x in json.dumps(json.loads(r["j"]), ensure_ascii=False, indent=2).split("\n")))
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def write_per_stem(df: DataFrame, root: str, columns: dict[str, str], stem: str = "id") -> DataFrame:
    """A file root/column/stem + extension for each value that is neither null nor empty; rows (column, stem) of what was written.

    Executors write; root is a folder that all of them share. Writing a file again gives the same file, so retries are harmless.
    """
    parts = [F.struct(F.lit(c).alias("column"), F.lit(ext).alias("extension"), F.col(c).alias("value")) for c, ext in columns.items()]
    rows = df.select(F.col(stem).alias("stem"), F.explode(F.array(*parts)).alias("p")).select("stem", "p.*").where("value is not null and value <> ''")

    def work(batches) -> Iterator:
        for pdf in batches:
            for s, c, ext, v in pdf[["stem", "column", "extension", "value"]].itertuples(index=False):
                os.makedirs(os.path.join(root, c), exist_ok=True)
                path = os.path.join(root, c, f"{s}{ext}")
                with open(f"{path}.part", "w", encoding="utf-8") as f:
                    f.write(v)
                os.replace(f"{path}.part", path)
            yield pdf[["column", "stem"]]

    return rows.mapInPandas(work, "column string, stem string")


#: Rows of a sheet, its header included: the format's limit.
SHEET_ROWS = 1_048_576


class TooManyRows(ValueError):
    """A table that no sheet can hold."""


def _table(df: DataFrame) -> list[list]:
    """The rows of a sheet on the driver, at most as many as the format has."""
    rows = [[None if v is None else v if isinstance(v, (bool, int, float)) else str(v) for v in r] for r in df.limit(SHEET_ROWS).toLocalIterator()]
    if len(rows) >= SHEET_ROWS:
        raise TooManyRows(f"a sheet has {SHEET_ROWS} rows with its header; write JSON lines or Parquet")
    return [df.columns, *rows]


def write_workbook(sheets: dict[str, DataFrame], path: str, cut: bool = False) -> None:
    """A workbook with a sheet for each DataFrame (of at most the format's 1,048,576 rows); ``cut`` shortens long texts for display."""
    tables = {}
    for name, df in sheets.items():
        if cut:
            df = df.select(*[display_cell(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields])
        tables[name] = _table(df)
    with open(path, "wb") as f:
        f.write(workbook_bytes(tables))


def write_dual(df: DataFrame, jsonl_path: str, workbook_path: str) -> None:
    """All as JSON lines, and a workbook for reading with texts cut to 32,000 characters."""
    df = df.cache()
    try:
        write_jsonl(df, jsonl_path, append=True)
        write_workbook({"Sheet1": df}, workbook_path, cut=True)
    finally:
        df.unpersist()


def write_triples(made: DataFrame, root: str, stem: str = "stem") -> DataFrame:
    """What synthesis made, of status ok: report, json and json_schema as files of their folders; rows (column, stem) of what was written."""
    return write_per_stem(made.where("status = 'ok'"), root, {c: ARTIFACTS[c] for c in ("report", "json", "json_schema")}, stem)


def write_markdown(texts: DataFrame, root: str, file: str = "file", text: str = "text") -> DataFrame:
    """A Markdown file root/markdown/name.md for each text, named after its workbook."""
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), "\\.[^.]*$", "")
    return write_per_stem(texts.select(name.alias("id"), F.col(text).alias("markdown")), root, {"markdown": ".md"})


def sheets_to_workbooks(cells: DataFrame, root: str, file: str = "file") -> DataFrame:
    """A workbook root/<workbook>_<sheet>.xlsx for each sheet of cells in long form; rows (file, sheet, path, error).

    Each sheet is a group of its own, written by an executor into a folder that all share; one that fails is a row with
    its error and the others go on. Slashes in sheet names become underscores.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        base = os.path.splitext(os.path.basename(first[file]))[0]
        path = os.path.join(root, f"{base}_{re.sub(r'[/\\\\]', '_', first['sheet'])}.xlsx")
        try:
            names = dict(zip(pdf["col_idx"], pdf["col_name"], strict=True))
            at = {c: k for k, c in enumerate(sorted(names))}
            table: dict[int, list] = {}
            for r, c, v in zip(pdf["row_idx"], pdf["col_idx"], pdf["value"], strict=True):
                table.setdefault(r, [None] * len(at))[at[c]] = v
            if len(table) >= SHEET_ROWS:
                raise TooManyRows(path)
            _replace(path, workbook_bytes({first["sheet"]: [[names[c] for c in at], *(table[r] for r in sorted(table))]}))
            error = None
        except (OSError, ValueError) as e:
            path, error = None, str(e)
        return pd.DataFrame([(first[file], first["sheet"], path, error)], columns=["file", "sheet", "path", "error"])

    return cells.groupBy(file, "sheet").applyInPandas(one, "file string, sheet string, path string, error string")


def _replace(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)


def parquet_file(df: DataFrame, path: str) -> None:
    """One Parquet file: for tables that one sheet may hold."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    df.limit(SHEET_ROWS).toPandas().to_parquet(path)


def parquet_to_workbooks(spark: SparkSession, folder: str, root: str) -> list[str]:
    """A workbook root/name.xlsx for each Parquet file of a folder, one after the other; returns their paths."""
    made = []
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".parquet")):
        os.makedirs(root, exist_ok=True)
        made.append(os.path.join(root, f"{os.path.splitext(name)[0]}.xlsx"))
        write_workbook({"Sheet1": spark.read.parquet(os.path.join(folder, name))}, made[-1])
    return made


def split_sheets(cells: DataFrame, path: str) -> None:
    """Cells of workbooks as Parquet, a folder for each file and sheet (with safe names)."""
    cells.withColumn("sheet_name", safe_sheet_name(F.col("sheet"))).write.mode("overwrite").partitionBy("file", "sheet_name").parquet(path)


def write_list(df: DataFrame, path: str, column: str = "stem") -> None:
    """One value a line, sorted, without a newline at the end."""
    with open(path, "w", encoding="utf-8") as f:
        for k, r in enumerate(df.select(column).orderBy(column).toLocalIterator()):
            f.write(("\n" if k else "") + r[0])


def upsert_registry(path: str, name: str, entry: dict) -> dict:
    """Sets one entry of a registry file; the others stay. Returns the registry."""
    registry = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            registry = json.load(f)
    registry[name] = entry
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(registry, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.part", path)
    return registry


def registry_entry(file_name: str, kind: str = "sharegpt", ranking: bool = False) -> dict:
    """What a trainer's registry says of a file: messages, sharegpt conversations, or with ``ranking`` preference pairs."""
    if kind == "messages":
        columns, tags = {"messages": "messages"}, {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "system_tag": "system"}
    else:
        columns, tags = {"messages": "conversations"}, {"role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt", "system_tag": "system"}
    entry = {"file_name": file_name, "formatting": "sharegpt", "columns": columns, "tags": tags}
    if ranking:
        entry |= {"ranking": True, "columns": columns | {"chosen": "chosen", "rejected": "rejected"}}
    return entry


def rename_plan(files: DataFrame, prefix: str = "data_", start: int = 1) -> DataFrame:
    """(path, new_path) of workbooks (path, file_name, stem) that aren't named prefix and number: in order of their names they get the numbers that are free."""
    number = F.regexp_extract(F.lower("stem"), f"^{re.escape(prefix.lower())}([0-9]+)$", 1)
    rows = files.withColumn("used", F.when(number != "", number.cast("long")))
    renamed = free_numbers(rows.where("used is null").withColumn("order", F.struct(F.lower("file_name"), "path")), rows.where("used is not null").select(F.col("used").alias("n")).distinct(), "order", start=start)
    folder, extension = F.regexp_extract("path", "^(.*/)[^/]*$", 1), F.regexp_extract("file_name", "(\\.[^.]*)$", 1)
    return renamed.select("path", F.concat(folder, F.lit(prefix), F.col("n").cast("string"), extension).alias("new_path"))


def apply_renames(plan: DataFrame, dry_run: bool = True) -> list[tuple[str, str]]:
    """Renames what a plan names (or with dry_run only tells), by way of temporary names so that none is overwritten; returns the pairs."""
    pairs = [(a.removeprefix("file:"), b.removeprefix("file:")) for a, b in plan.orderBy("path").toLocalIterator()]
    if not dry_run:
        for a, _ in pairs:
            os.rename(a, f"{a}.renaming")
        for a, b in pairs:
            if os.path.exists(b):
                raise FileExistsError(b)
            os.rename(f"{a}.renaming", b)
    return pairs


def deletion_plan(bad: DataFrame, root: str, columns: dict[str, str], reason: str) -> DataFrame:
    """(stem, path, reason) of the files of bad stems in all folders: a plan; nothing is deleted."""
    paths = F.array(*[F.concat(F.lit(f"{root}/{c}/"), F.col("stem"), F.lit(ext)) for c, ext in columns.items()])
    return bad.select("stem", F.explode(paths).alias("path"), F.lit(reason).alias("reason"))


def apply_deletions(plan: DataFrame, dry_run: bool = True) -> list[str]:
    """Deletes what a plan names (or with dry_run only tells); returns the paths that exist."""
    found = [r["path"] for r in plan.select("path").toLocalIterator() if os.path.exists(r["path"])]
    for p in [] if dry_run else found:
        os.remove(p)
    return found
