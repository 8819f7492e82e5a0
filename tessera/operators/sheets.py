"""Sheets to Markdown: one table a sheet, then whole sheets of a workbook while they fit a budget of characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOTE = "\n\n(Further sheets left out: the limit of characters is reached.)\n"


def _is_number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def markdown_table(columns: list[str], rows: list[list], max_rows: int | None = None) -> str:
    """A pipe table: numbers to the right, missing values as nan, headers stripped and on one line."""
    columns = [str(c).strip().replace("\n", " ") for c in columns]
    rows = rows if max_rows is None else rows[:max_rows]
    text = [["nan" if v is None or v != v else str(v) for v in r] for r in rows]
    right = [bool(text) and all(_is_number(r[k]) for r in text) for k in range(len(columns))]
    width = [max([len(c) + 2, *(len(r[k]) for r in text)]) for k, c in enumerate(columns)]
    put = lambda r: "| " + " | ".join(v.rjust(w) if n else v.ljust(w) for v, w, n in zip(r, width, right, strict=True)) + " |"
    rule = "|" + "|".join("-" * (w + 1) + ":" if n else ":" + "-" * (w + 1) for w, n in zip(width, right, strict=True)) + "|"
    return "\n".join([put(columns), rule, *map(put, text)])


def sheet_markdown(cells: DataFrame, max_rows: int | None = 2000) -> DataFrame:
    """(file, sheet, sheet_idx, markdown) of cells in long form: empty rows and columns dropped first, then rows cut."""

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        full = pdf.dropna(subset=["value"])
        keep_rows, keep_cols = set(full["row_idx"]), set(full["col_idx"])
        pdf = pdf[pdf["row_idx"].isin(keep_rows) & pdf["col_idx"].isin(keep_cols)].sort_values(["row_idx", "col_idx"])
        names = dict(zip(pdf["col_idx"], pdf["col_name"], strict=True))
        order = sorted(names)
        table: dict[int, dict[int, str]] = {}
        for r, c, v in zip(pdf["row_idx"], pdf["col_idx"], pdf["value"], strict=True):
            table.setdefault(r, {})[c] = v
        md = markdown_table([names[c] for c in order], [[table[r].get(c) for c in order] for r in sorted(table)], max_rows)
        return md

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame([(first["file"], first["sheet"], int(first["sheet_idx"]), render(pdf))], columns=["file", "sheet", "sheet_idx", "markdown"])

    return cells.groupBy("file", "sheet", "sheet_idx").applyInPandas(one, "file string, sheet string, sheet_idx int, markdown string")


def within_budget(blocks: DataFrame, most: int, key: str = "file", order: str = "sheet_idx", block: str = "block", note: str = NOTE) -> DataFrame:
    """(key, text): blocks in order while their lengths' sum is at most ``most``; the first that isn't ends all, with a note if that still fits."""
    w = Window.partitionBy(key).orderBy(order)
    rows = blocks.withColumn("_sum", F.sum(F.length(block)).over(w))
    rows = rows.withColumn("_stop", F.max(F.when(F.col("_sum") > most, 1).otherwise(0)).over(w))
    kept = F.array_sort(F.collect_list(F.when(F.col("_stop") == 0, F.struct(F.col(order).alias("o"), F.col(block).alias("b")))))
    out = rows.groupBy(key).agg(kept.alias("k"), F.max("_stop").alias("cut"))
    body = F.array_join(F.transform("k", lambda x: x["b"]), "")
    text = F.when((F.col("cut") == 1) & (F.length(body) + len(note) <= most), F.concat(body, F.lit(note))).otherwise(body)
    return out.select(key, F.regexp_replace(text, "(?U)^\\s+", "").alias("text"))


def workbook_markdown(cells: DataFrame, max_total_chars: int = 300_000, max_rows: int | None = 2000) -> DataFrame:
    """(file, text): the sheets of each workbook, each with a heading."""
    blocks = sheet_markdown(cells, max_rows).withColumn("block", F.concat(F.lit("\n\n## Sheet: "), "sheet", F.lit("\n\n"), "markdown", F.lit("\n")))
    return within_budget(blocks, max_total_chars)
