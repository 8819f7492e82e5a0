"""The registered queries of readers and sinks: each writes a driver table into the shared folder and reads it back."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import udfs as U
from .operators import sheets as H
from .queries import Tables, query
from .session import new_path
from .sources import readers, sinks
from .sources.xlsx import XlsxSource


def _folder(t: Tables, name: str) -> str:
    """A new folder for files that the driver or executors open by their path."""
    path = new_path(t.spark, name).removeprefix("file://").removeprefix("file:")
    os.makedirs(path)
    return path


# -- JSON ------------------------------------------------------------------------------------------------------------


@query("k1_jsonl_overwrite", "SELECT * FROM labels")
def k1(t):
    path = new_path(t.spark, "k1")
    sinks.write_jsonl(t.orders.select("o_orderkey"), path)
    sinks.write_jsonl(t.labels, path)
    return readers.jsonl(t.spark, path, t.labels.schema)


@query("k2_jsonl_append", "SELECT * FROM labels UNION ALL SELECT * FROM labels WHERE toxic = 1")
def k2(t):
    path = new_path(t.spark, "k2")
    sinks.write_jsonl(t.labels, path, append=True)
    sinks.write_jsonl(t.labels.where("toxic = 1"), path, append=True)
    return readers.jsonl(t.spark, path, t.labels.schema)


@query("s4_jsonl_permissive", "SELECT doc_id, toxic FROM labels WHERE doc_id % 7 > 1")
def s4(t):
    path = new_path(t.spark, "s4")
    bad = F.when(F.col("doc_id") % 7 == 0, '{"doc_id": ').when(F.col("doc_id") % 7 == 1, "")
    t.labels.select(F.coalesce(bad, F.to_json(F.struct("doc_id", "toxic")))).write.text(path)
    return readers.jsonl(t.spark, path, t.labels.select("doc_id", "toxic").schema, strict=False)


@query("s5_json_array", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s5(t):
    path = f"{_folder(t, 's5')}/customers.json"
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    sinks.write_json_array(rows.withColumn("stem", F.col("c_name")), path)
    return readers.json_array(t.spark, path, rows.schema)


@query("k7_dual_sink", "SELECT r_regionkey, repeat(r_name, 10000) AS long, length(r_name) * 10000 > 32000 AS cut FROM region")
def k7(t):
    at = _folder(t, "k7")
    sinks.write_dual(t.region.select("r_regionkey", F.repeat("r_name", 10_000).alias("long")), f"{at}/rows", f"{at}/rows.xlsx")
    t.spark.dataSource.register(XlsxSource)
    cells = t.spark.read.format("xlsx").load(f"{at}/rows.xlsx")
    number = lambda name: F.max(F.when(F.col("col_name") == name, F.col("value")))
    shown = cells.groupBy("row_idx").agg(number("r_regionkey").cast(t.region.schema["r_regionkey"].dataType).alias("r_regionkey"), (F.length(number("long")) == 32_001).alias("cut")).drop("row_idx")
    return readers.jsonl(t.spark, f"{at}/rows", t.region.select("r_regionkey", F.col("r_name").alias("long")).schema).join(shown, "r_regionkey")


# -- folders of texts ------------------------------------------------------------------------------------------------


def _suppliers(t: Tables) -> DataFrame:
    return t.supplier.select(F.concat(F.lit("data_"), F.col("s_suppkey").cast("string")).alias("id"), F.concat("s_name", F.lit("\nline two")).alias("report"))


@query("s1_artifact_folder", "SELECT 'data_' || s_suppkey AS stem, 'data_' || s_suppkey || '.txt' AS file_name, s_name || chr(10) || 'line two' AS value FROM supplier")
def s1(t):
    at = _folder(t, "s1")
    sinks.write_per_stem(_suppliers(t), at, {"report": ".txt"}).count()
    return readers.artifacts(t.spark, f"{at}/report")


@query("s2_texts_or_null", "SELECT 'data_' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name || chr(10) || 'line two' END AS value FROM supplier")
def s2(t):
    at = _folder(t, "s2")
    sinks.write_per_stem(_suppliers(t), at, {"report": ".txt"}).count()
    even = F.replace("id", F.lit("data_"), F.lit("")).cast("int") % 2 == 0
    paths = t.supplier.select(F.concat(F.lit("data_"), F.col("s_suppkey").cast("string")).alias("id"))
    paths = paths.withColumn("path", F.concat(F.lit(f"{at}/report/"), "id", F.when(even, ".txt").otherwise(".none")))
    return readers.texts(t.spark, paths).select("id", "value")


@query("k4_written_stems", "SELECT 'report' AS \"column\", 'data_' || s_suppkey AS stem FROM supplier WHERE s_suppkey % 3 > 0")
def k4(t):
    rows = _suppliers(t).join(t.supplier.select(F.concat(F.lit("data_"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") % 3).alias("k")), "id")
    return sinks.write_per_stem(rows.withColumn("report", F.when(F.col("k") > 0, F.col("report")).otherwise("")), _folder(t, "k4"), {"report": ".txt"})


@query("k5_artifact_triples", """SELECT 'data_' || n_nationkey AS stem, n_name AS report, '{"k": ' || n_nationkey || '}' AS json, '{}' AS json_schema FROM nation WHERE n_nationkey % 2 = 0""")
def k5(t):
    at = _folder(t, "k5")
    made = t.nation.select(F.concat(F.lit("data_"), F.col("n_nationkey").cast("string")).alias("stem"), F.col("n_name").alias("report"), F.format_string('{"k": %d}', "n_nationkey").alias("json"), F.lit("{}").alias("json_schema"), F.when(F.col("n_nationkey") % 2 == 0, "ok").otherwise("invalid").alias("status"))
    sinks.write_triples(made, at).count()
    read = lambda c: readers.artifacts(t.spark, f"{at}/{c}", readers.ARTIFACTS[c], c).drop("file_name")
    return read("report").join(read("json"), "stem").join(read("json_schema"), "stem")


@query("k9_split_list", "SELECT s_name AS value FROM supplier WHERE s_suppkey % 10 = 3")
def k9(t):
    path = f"{_folder(t, 'k9')}/list.txt"
    sinks.write_list(t.supplier.where("s_suppkey % 10 = 3").select(F.col("s_name").alias("stem")), path)
    return t.spark.read.text(path)


@query("k10_registry", """SELECT unnest(['one', 'two']) AS name, unnest(['b.json', 'c.json']) AS file_name, unnest([false, true]) AS ranking""")
def k10(t):
    path = f"{_folder(t, 'k10')}/registry.json"
    sinks.upsert_registry(path, "one", sinks.registry_entry("a.json"))
    sinks.upsert_registry(path, "two", sinks.registry_entry("c.json", ranking=True))
    sinks.upsert_registry(path, "one", sinks.registry_entry("b.json", "messages"))
    with open(path, encoding="utf-8") as f:
        rows = [(k, v["file_name"], v.get("ranking", False)) for k, v in json.load(f).items()]
    return t.spark.createDataFrame(rows, "name string, file_name string, ranking boolean")


@query("k11_deletion_plan", """SELECT 'data_' || doc_id AS stem, '/store/' || d || '/data_' || doc_id || e AS path, 'toxic' AS reason FROM labels, (VALUES ('user_prompt', '.txt'), ('user_prompt_question', '.txt'), ('report', '.txt'), ('json', '.json'), ('json_schema', '.json')) AS folders(d, e) WHERE toxic = 1""")
def k11(t):
    bad = t.labels.where("toxic = 1").select(F.concat(F.lit("data_"), F.col("doc_id").cast("string")).alias("stem"))
    return sinks.deletion_plan(bad, "/store", readers.ARTIFACTS, "toxic")


# -- CSV, workbooks --------------------------------------------------------------------------------------------------


@query("s6_csv", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_mktsegment || ', \"quoted\"' || chr(10) || 'second line' AS note FROM customer")
def s6(t):
    path = new_path(t.spark, "s6")
    note = F.concat("c_mktsegment", F.lit(', "quoted"\nsecond line'))
    t.customer.select("c_custkey", "c_name", note.alias("note"), F.lit("x").alias("unused")).write.option("header", "true").option("sep", ";").option("quoteAll", "true").option("escape", '"').csv(path)
    return readers.csv_table(t.spark, path, sep=";", columns=["c_custkey", "c_name", "note"], types={"c_custkey": "int"})


@query("s6_csv_sniffed_below_notes", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def s6b(t):
    path = f"{_folder(t, 's6')}/suppliers.csv"
    rows = t.supplier.select(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name").alias("stem"))
    sinks.write_list(rows.union(t.spark.createDataFrame([("!!made by hand, for tests",), ("!s_suppkey|s_name",)], "stem string")), path)
    return readers.csv_table(t.spark, path, skip_rows=1).withColumnRenamed("!s_suppkey", "s_suppkey")


def _book(t: Tables, name: str) -> str:
    at = _folder(t, name)
    sinks.write_workbook({"regions/all": t.region.select("r_regionkey", "r_name"), "nations": t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey")}, f"{at}/book.xlsx")
    t.spark.dataSource.register(XlsxSource)
    return at


@query("s7_workbook_cells", "SELECT 'nations' AS sheet, n_nationkey AS row_idx, c AS col_name, CASE c WHEN 'n_name' THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation, (VALUES ('n_nationkey'), ('n_name')) AS columns(c)")
def s7(t):
    cells = t.spark.read.format("xlsx").option("include", "nations").load(_book(t, "s7"))
    first = cells.where("col_name = 'n_nationkey'").select("row_idx", F.col("value").cast(t.nation.schema["n_nationkey"].dataType).alias("k"))
    return cells.join(first, "row_idx").select("sheet", F.col("k").alias("row_idx"), "col_name", "value")


@query("s8_sheet_catalogue", "SELECT unnest(['regions/all', 'nations']) AS sheet, unnest([0, 1]) AS sheet_idx")
def s8(t):
    return t.spark.read.format("xlsx").option("mode", "sheets").load(_book(t, "s8")).select("sheet", "sheet_idx")


@query("s9_sheets_but_one", "SELECT 'regions/all' AS sheet, count(*) * 2 AS cells FROM region")
def s9(t):
    return t.spark.read.format("xlsx").option("exclude", "nations").load(_book(t, "s9")).groupBy("sheet").agg(F.count("*").alias("cells"))


@query("s13_workbook_files", "SELECT unnest(['a.XLSX', 'b.xls']) AS file_name, unnest(['a', 'b']) AS stem")
def s13(t):
    at = _folder(t, "s13")
    for name in ("a.XLSX", "b.xls", "~$a.xlsx", "c.txt"):
        with open(f"{at}/{name}", "wb") as f:
            f.write(b"x")
    return readers.workbook_files(t.spark, at).select("file_name", "stem")


@query("k12_markdown_files", "SELECT 'book' AS stem, count(*) AS files, 2 AS headings")
def k12(t):
    at = _book(t, "k12")
    sinks.write_markdown(H.workbook_markdown(t.spark.read.format("xlsx").load(at)), at).count()
    made = readers.artifacts(t.spark, f"{at}/markdown", ".md")
    return made.groupBy("stem").agg(F.count("*").alias("files"), F.max(F.regexp_count("value", F.lit("## Sheet: "))).alias("headings"))


@query("k13_sheets_to_workbooks", "SELECT unnest(['book_regions_all.xlsx', 'book_nations.xlsx']) AS file, unnest([(SELECT count(*) FROM region), (SELECT count(*) FROM nation)]) AS n")
def k13(t):
    at = _book(t, "k13")
    sinks.sheets_to_workbooks(t.spark.read.format("xlsx").load(at), f"{at}/out").count()
    cells = t.spark.read.format("xlsx").load(f"{at}/out")
    return cells.groupBy(F.element_at(F.split("file", "/"), -1).alias("file")).agg(F.count_distinct("row_idx").alias("n"))


@query("k14_parquet_to_workbooks", "SELECT 'nation.xlsx' AS file, n_name AS value FROM nation UNION ALL SELECT 'region.xlsx', r_name FROM region")
def k14(t):
    at = _folder(t, "k14")
    for name in ("nation", "region"):
        sinks.parquet_file(getattr(t, name), f"{at}/in/{name}.parquet")
    sinks.parquet_to_workbooks(t.spark, f"{at}/in", f"{at}/out")
    t.spark.dataSource.register(XlsxSource)
    cells = t.spark.read.format("xlsx").load(f"{at}/out").where("col_name in ('n_name', 'r_name')")
    return cells.select(F.element_at(F.split("file", "/"), -1).alias("file"), "value")


@query("w7_rename_files", "SELECT unnest(['Other.xlsx', 'b.xlsx']) AS old, unnest(['data_3.xlsx', 'data_1.xlsx']) AS new")
def w7(t):
    at = _folder(t, "w7")
    for name in ("b.xlsx", "Other.xlsx", "data_2.xlsx"):
        with open(f"{at}/{name}", "wb") as f:
            f.write(b"x")
    plan = sinks.rename_plan(readers.workbook_files(t.spark, at, (".xlsx",)))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return plan.select(name("path").alias("old"), name("new_path").alias("new"))


# -- schemas ---------------------------------------------------------------------------------------------------------


@query("j15_local_refs", "SELECT p_partkey, p_size >= 10 AS valid, CAST(p_size AS VARCHAR) AS made FROM part")
def j15(t):
    # The first schema refers to a definition by way of another and of an escaped name; the second is the one instances are made for.
    ten = F.lit('{"$defs":{"a/b":{"$ref":"#/$defs/n"},"n":{"type":"integer","minimum":10}},"$ref":"#/$defs/a~1b"}')
    own = F.format_string('{"$defs":{"a/b":{"$ref":"#/$defs/n"},"n":{"type":"integer","minimum":%d}},"$ref":"#/$defs/a~1b"}', "p_size")
    return t.part.select("p_partkey", U.schema_validate(F.col("p_size").cast("string"), ten).alias("valid"), U.json_minimal(own).alias("made"))
