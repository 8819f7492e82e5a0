import importlib
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import queries as Q
from tessera.functions import text as X
from tessera.functions import udfs as U
from tessera.operators import chat as C
from tessera.operators import relational as R
from tessera.operators import sheets as H
from tessera.operators import stats as A
from tessera.plans import pipelines as P
from tessera.plans.contracts import CONTRACTS
from tessera.plans.provider import StubProvider, generate
from tessera.sources import readers, sinks
from tessera.sources.xlsx import UnsupportedWorkbook, XlsxSource, read_cells, workbook_bytes
from tessera.streaming.resume import process_new_files, resume

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(spark, duck, sf, name):
    df = Q.QUERIES[name](spark, sf)
    want = duck.sql(Q.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_others_run(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row["n"] == 1500 and 0 < row["exact_match"] < 1


def test_works_without_llm():
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, p, t=None):\n        if n.startswith('tessera.llm') or n == 'corpus_pipeline': raise ModuleNotFoundError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root}, timeout=120)
    importlib.import_module("tessera.queries")


def test_text_columns(spark):
    df = spark.createDataFrame([("a ", "=== JSON === {} === JSON_SCHEMA === x", "data_41000"), (None, "nothing", "data-1")], "a string, b string, c string")
    rows = df.select(X.py_strip(F.col("a")).alias("a"), X.between_sections(F.col("b")).alias("b"), X.file_id(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("a", "{}", 41000), (None, None, -1)]
    joined = spark.range(1).select(X.parse_paragraph_chat(F.lit("USER: a\n\nmore\n\nASSISTANT: b"), join_paragraphs=True).alias("t")).first()["t"]
    assert [r["value"] for r in joined] == ["a\nmore", "b"]


def test_sql_functions(spark):
    U.register_all(spark)
    r = spark.sql("""select json_loads_ok('{"a":1}x') a, extract_json('[{"a":1}]', 'completion') b, json_minimal('{"type":"integer"}') c, strip_think('x</think> y ') d""").first()
    assert tuple(r) == (False, '{"a": 1}', "0", "y")
    assert spark.sql("select * from chat_turns('x USER: a ASSISTANT: b')").count() == 2


def test_artifacts_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("a", "pa", '{"x":1}', "{}", "ra", None), ("a-1", "pb", "", None, "rb", "q")], "id string, user_prompt string, json string, json_schema string, report string, user_prompt_question string")
    written = sinks.write_per_stem(wide, str(tmp_path), readers.ARTIFACTS).collect()
    assert len(written) == 7
    back = {r["id"]: r for r in readers.wide(spark, str(tmp_path)).collect()}
    assert back["a"]["json"] == '{"x":1}' and back["a-1"]["json"] is None and back["a-1"]["user_prompt_question"] == "q"
    names = [r["file_name"] for r in readers.artifacts(spark, str(tmp_path / "user_prompt")).orderBy("file_name").collect()]
    assert names == sorted(names) == ["a-1.txt", "a.txt"]
    plan = sinks.deletion_plan(spark.createDataFrame([("a",)], "stem string"), str(tmp_path), readers.ARTIFACTS, "too long")
    assert len(sinks.apply_deletions(plan)) == 4 and os.path.exists(tmp_path / "json/a.json")
    sinks.apply_deletions(plan, dry_run=False)
    assert not os.path.exists(tmp_path / "json/a.json") and os.path.exists(tmp_path / "report/a-1.txt")


def test_json_readers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":2}\n{bad\n')
    assert readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    (tmp_path / "e.jsonl").write_text("\n")
    with pytest.raises(readers.NoRows):
        readers.jsonl(spark, str(tmp_path / "e.jsonl"), "a int", strict=False)
    df = spark.createDataFrame([("s", 1), ("t", None)], "stem string, a int")
    assert sinks.write_json_array(df, str(tmp_path / "arr.json")) == 2
    assert json.loads((tmp_path / "arr.json").read_text()) == [{"a": 1}, {"a": None}]
    assert readers.json_array(spark, str(tmp_path / "arr.json"), "a int").count() == 2
    sinks.write_jsonl(df, str(tmp_path / "out"))
    sinks.write_jsonl(df, str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    sinks.write_list(df, str(tmp_path / "l.txt"))
    assert (tmp_path / "l.txt").read_text() == "s\nt"


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿a;b\n1;x\n2;y\n", encoding="utf-8")
    df = readers.csv_table(spark, str(tmp_path / "x.csv"), columns=["b", "a"], most=1)
    assert df.columns == ["b", "a"] and [tuple(r) for r in df.collect()] == [("x", "1")]


def test_workbooks(spark, tmp_path):
    spark.dataSource.register(XlsxSource)
    data = workbook_bytes({"one/1": [["k", "v"], [1, "a<b"], [None, None], [2.5, True]], "two": [["x"]]})
    (tmp_path / "b.xlsx").write_bytes(data)
    (tmp_path / "~$b.xlsx").write_bytes(b"lock")
    cells = spark.read.format("xlsx").load(str(tmp_path))
    got = {(r["sheet"], r["row_idx"], r["col_name"]): r["value"] for r in cells.collect()}
    assert got[("one/1", 0, "k")] == "1" and got[("one/1", 0, "v")] == "a<b" and got[("one/1", 1, "k")] is None and got[("one/1", 2, "v")] == "True"
    assert [r["sheet"] for r in spark.read.format("xlsx").option("mode", "sheets").load(str(tmp_path)).orderBy("sheet_idx").collect()] == ["one/1", "two"]
    assert spark.read.format("xlsx").option("exclude", "one/1").load(str(tmp_path)).count() == 0
    ratio = A.fill_ratio(cells, spark.createDataFrame([(str(tmp_path / "b.xlsx"),), ("none",)], "file string")).orderBy("ratio").collect()
    assert [(r["ratio"], r["sparse"]) for r in ratio] == [(0.0, True), (pytest.approx(4 / 6), False)]
    text = H.workbook_markdown(cells).first()["text"]
    assert text.startswith("## Sheet: one/1\n\n|") and "2.5" in text
    sinks.split_sheets(cells, str(tmp_path / "split"))
    assert any("sheet_name=one_1" in d for d, _, _ in os.walk(tmp_path / "split"))
    sinks.write_workbook({"s": spark.createDataFrame([("x" * 40_000,)], "t string")}, str(tmp_path / "o.xlsx"), cut=True)
    assert len(next(read_cells(str(tmp_path / "o.xlsx")))[-1]) == 32_001
    with pytest.raises(UnsupportedWorkbook):
        next(read_cells("a.xlsb"))
    assert readers.workbook_files(spark, str(tmp_path)).where("file_name = 'b.xlsx'").count() == 1


def test_budget(spark):
    rows = [("f", 0, "a" * 40), ("f", 1, "b" * 70), ("f", 2, "c" * 10)]
    df = spark.createDataFrame(rows, "file string, sheet_idx int, block string")
    assert H.within_budget(df, 100, note="!" * 60).first()["text"] == "a" * 40 + "!" * 60
    assert H.within_budget(df, 100, note="!" * 61).first()["text"] == "a" * 40
    assert len(H.within_budget(df, 120).first()["text"]) == 120


def test_registry(tmp_path):
    path = str(tmp_path / "r.json")
    sinks.upsert_registry(path, "a", sinks.registry_entry("a.json"))
    sinks.upsert_registry(path, "a", sinks.registry_entry("b.json", ranking=True))
    assert sinks.upsert_registry(path, "c", {})["a"]["columns"]["chosen"] == "chosen"
    assert len(CONTRACTS) == 12


def test_shards_cover(spark):
    df = spark.createDataFrame([(str(i),) for i in range(5)], "stem string")
    got = [[r["stem"] for r in R.shard(df, 2, i, "stem").collect()] for i in (0, 1)]
    assert sorted(sum(got, [])) == list("01234") and sorted(got[1]) == ["1", "3"]
    with pytest.raises(ValueError):
        R.shard(df, 2, 2, "stem")


@pytest.mark.parametrize("n,train", [(10, 9), (29, 26), (1, 0)])
def test_splits(spark, n, train):
    df = spark.range(n)
    for out in (R.split_by_hash(df, "id"), R.split_by_shuffle(df, "id")):
        assert out.where("split = 'train'").count() == train and out.count() == n


def test_free_numbers(spark):
    used = spark.createDataFrame([(1,), (3,)], "n long")
    files = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted((r["name"], r["n"]) for r in R.free_numbers(files, used, "name").collect()) == [("a", 2), ("b", 4)]


def test_generation_errors(spark):
    class Fails:
        def generate(self, prompts, samples):
            return [ValueError("no") if p == "bad" else p.upper() for p in prompts]

    df = spark.createDataFrame([("1", "ok"), ("2", "bad")], "stem string, prompt string")
    got = {(r["stem"], r["sample_idx"]): (r["raw_output"], r["error"]) for r in generate(df, Fails, 2).collect()}
    assert got[("1", 1)] == ("OK", None) and got[("2", 0)] == (None, "no") and len(got) == 4


def test_preference_order_and_resume(spark, tmp_path):
    schema = '{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":%d}}}'
    prompts = spark.createDataFrame([(f"{i:02d}", f"p{i}\n=== JSON Schema ===\n{schema % i}") for i in range(12)], "stem string, user_prompt string")
    gold = spark.createDataFrame([(f"{i:02d}", '{"k":%d}' % (i if i % 4 else -1)) for i in range(0, 12, 1) if i != 5], "stem string, gold_json string")
    schemas = spark.createDataFrame([(f"{i:02d}", schema % i) for i in range(12)], "stem string, json_schema string")

    def work(rows):
        return P.preference_pairs(rows, gold, schemas, StubProvider, n=6, pairs=2, most=8)

    pairs, ledger = work(prompts)
    status = {r["stem"]: r["status"] for r in ledger.collect()}
    assert len(status) == 8 and "05" not in status and status["00"] == status["04"] == "invalid_gold"
    per = {r["_stem"]: r["count"] for r in pairs.groupBy("_stem").count().collect()}
    assert per and max(per.values()) <= 2 and set(per) == {k for k, v in status.items() if v == "accepted"}
    for _ in range(2):
        resume(prompts, str(tmp_path / "ledger"), "stem", work, str(tmp_path / "pairs"))
    first = spark.read.parquet(str(tmp_path / "ledger")).count()
    assert first == 11  # all with gold; none twice
    resume(prompts, str(tmp_path / "ledger"), "stem", work, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == first


def test_streaming_resume(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in "abc":
        (folder / f"{n}.txt").write_text(f"{n}\n{n}")
    seen = []
    run = lambda: process_new_files(spark, str(folder), str(tmp_path / "cp"), lambda b, k: seen.extend(r["stem"] for r in b.collect()))
    assert run() == 3 and run() == 0
    (folder / "d.txt").write_text("d")
    assert run() == 1 and sorted(seen) == list("abcd")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.to_messages(none).count() == 0 and C.last_user_before(none).count() == 0
    assert R.split_by_hash(spark.range(0), "id").count() == 0
    assert A.summary(A.evaluated(spark.createDataFrame([], "pred_json string, gold_json string, json_schema string"))).first()["n"] == 0
