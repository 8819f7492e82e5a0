"""Readers, sinks and commands that the queries don't reach."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import udfs as U
from tessera.operators import relational as R
from tessera.operators import stats as A
from tessera.plans import pipelines as P
from tessera.plans.contracts import CONTRACTS
from tessera.plans.provider import named
from tessera.sources import readers, sinks
from tessera.sources.xlsx import XlsxSource, read_cells, workbook_bytes

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@pytest.mark.parametrize("lines", ["a;b\n1;x\n2;\n", "﻿a;b\r\n1;x\r\n2;\r\n"])
def test_csv_types_and_skipped_rows(spark, tmp_path, lines):
    (tmp_path / "plain.csv").write_text(lines, newline="")
    (tmp_path / "head.csv").write_text("made, by, hand\n\n" + lines.lstrip("﻿"), newline="")
    want = [(1, "x"), (2, None)]
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "plain.csv"), types={"a": "int"}).collect()] == want
    got = readers.csv_table(spark, str(tmp_path / "head.csv"), skip_rows=2, types={"a": "int"})
    assert [tuple(r) for r in got.collect()] == want and got.dtypes == [("a", "int"), ("b", "string")]


def test_csv_quotes_survive_skipped_rows(spark, tmp_path):
    (tmp_path / "q.csv").write_text('skip\na,b\n"1,5","two\nlines"\n3\n')
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "q.csv"), sep=",", skip_rows=1).collect()] == [("1,5", "two\nlines"), ("3", None)]


def test_texts_that_cannot_be_read_are_null(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    paths = [str(tmp_path / n) for n in ("a.txt", "b.txt", "c.txt")] + [None]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, path string")
    assert {r["k"]: r["value"] for r in readers.texts(spark, rows).collect()} == {0: "é", 1: None, 2: None, 3: None}


def test_datasets_and_settings(spark, tmp_path, monkeypatch):
    spark.range(3).write.parquet(str(tmp_path / "d/train"))
    (tmp_path / "d/test.jsonl").write_text('{"id":1}\n')
    hub = readers.FolderProvider(str(tmp_path))
    assert readers.dataset(spark, hub, "d").count() == 3 and readers.dataset(spark, hub, "d", "test", ["id"]).first()["id"] == 1
    with pytest.raises(FileNotFoundError):
        readers.dataset(spark, hub, "d", "none")
    monkeypatch.setenv("LLM_MODEL", "one")
    assert readers.setting(spark, "LLM_MODEL") == "one" and readers.setting(spark, "NOT_SET", "x") == "x"
    spark.conf.set("spark.tessera.llm.model", "two")
    assert readers.setting(spark, "LLM_MODEL") == "two"
    spark.conf.unset("spark.tessera.llm.model")


@pytest.fixture
def book(tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "data_41000.xlsx").write_bytes(workbook_bytes({"a/b": [["n", "t"], [1, "x"], [2, None]], "c": [["m"], ["y"]]}))
    (folder / "Other.xlsx").write_bytes(workbook_bytes({"s": [["k"], [1]]}))
    return folder


def test_sheets_to_workbooks(spark, book, tmp_path):
    spark.dataSource.register(XlsxSource)
    made = sinks.sheets_to_workbooks(spark.read.format("xlsx").load(str(book)), str(tmp_path / "out")).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["Other_s.xlsx", "data_41000_a_b.xlsx", "data_41000_c.xlsx"]
    assert all(r["error"] is None for r in made)
    assert [c[6] for c in read_cells(str(tmp_path / "out/data_41000_a_b.xlsx"))] == ["1", "x", "2", None]
    (tmp_path / "blocked").write_text("a file where the folder should be")
    assert all(r["error"] and r["path"] is None for r in sinks.sheets_to_workbooks(spark.read.format("xlsx").load(str(book)), str(tmp_path / "blocked")).collect())


def test_sheets_have_a_limit(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 4)
    sinks.write_workbook({"s": spark.range(3)}, str(tmp_path / "a.xlsx"))
    with pytest.raises(sinks.TooManyRows):
        sinks.write_workbook({"s": spark.range(4)}, str(tmp_path / "b.xlsx"))


def test_parquet_to_workbooks(spark, tmp_path):
    for n in "ab":
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / f"in/{n}.parquet"))
    cli.main(["to-workbook", str(tmp_path / "in"), str(tmp_path / "out"), "--each"])
    assert sorted(os.listdir(tmp_path / "out")) == ["a.xlsx", "b.xlsx"]


def test_renames(spark, tmp_path):
    for n in ("b", "A", "data_2"):
        (tmp_path / f"{n}.xlsx").write_text(n)
    cli.main(["rename", str(tmp_path)])
    assert (tmp_path / "b.xlsx").exists()
    cli.main(["rename", str(tmp_path), "--apply"])
    assert {n: (tmp_path / n).read_text() for n in os.listdir(tmp_path)} == {"data_1.xlsx": "A", "data_2.xlsx": "data_2", "data_3.xlsx": "b"}


def test_token_counts(spark):
    from tokenizers import Tokenizer

    texts = ["A word, and more.", "", None, "<|endoftext|>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["n"] for r in df.select("k", U.token_counter(VOCABULARY)(F.col("t")).alias("n")).collect()}
    model = Tokenizer.from_file(VOCABULARY)
    model.encode_special_tokens = True
    assert got == {k: None if t is None else len(model.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    U.register_all(spark)
    assert spark.sql("select token_count('A word, and') n").first()["n"] == 4
    U.register_all(spark, VOCABULARY)
    assert spark.sql("select token_count('A word, and more.') n").first()["n"] == got[0]


def test_contracts_give_views(spark):
    df = spark.range(100).withColumn("len", F.col("id") * 100)
    for name, (_, _, cutoff, _, val) in CONTRACTS.items():
        got = P.contracted(df, name, F.col("len"), "id").collect()
        assert sum(r["split"] == "train" for r in got) == int(100 * (1 - val)) and all(r["cut"] == (r["len"] > cutoff) for r in got)


def test_own_columns_survive(spark):
    df = spark.createDataFrame([(i, f"p{i}", i * 10, 7, 7) for i in range(6)], "k long, position string, _at long, _n int, _in int")
    for out in (R.shard(df, 2, 0, "k"), R.batches(df, 2, "k").drop("batch"), R.split_by_hash(df, "k").drop("split"), R.split_by_shuffle(df, "k").drop("split"), R.numbered(df, "d", "k").drop("new_stem"), R.first_k(df, 9, ["_in"], "k")):
        assert out.columns == df.columns and all(r["position"] == f"p{r['k']}" and r["_at"] == r["k"] * 10 and r["_n"] == 7 for r in out.collect())
    scored = A.evaluated(A.evaluated(spark.createDataFrame([("{}", "{}", "{}")], "pred_json string, gold_json string, json_schema string")))
    assert len(scored.columns) == len(set(scored.columns)) == 8


class FivesJudge:
    def generate(self, prompts, samples):
        return ["5" if '"a": 1' in p and p.endswith('{"a":1}') else "none" for p in prompts]


def test_judged_evaluation(spark):
    rows = spark.createDataFrame([("1", '{"a":1}', '{"a":1}', "{}"), ("2", '{"a":2}', '{"a":1}', "{}"), ("3", "", '{"a":1}', "{}")], "stem string, pred_json string, gold_json string, json_schema string")
    scored, total = P.evaluation(rows, named("tests.test_surface:FivesJudge"))
    assert {r["stem"]: r["llm_score"] for r in scored.collect()} == {"1": 1.0, "2": None, "3": None}
    assert total.first()["llm_score"] == 1.0 and total.first()["n"] == 3


@pytest.fixture
def store(tmp_path):
    schema = '{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":%d}}}'
    for name, ext, value in (("user_prompt", ".txt", "Take.\n\n=== JSON Schema ===\n" + schema), ("report", ".txt", "r%d"), ("json", ".json", '{"k":%d}'), ("json_schema", ".json", schema)):
        (tmp_path / name).mkdir()
        for k in range(8):
            (tmp_path / name / f"data_{k}{ext}").write_text(value % k)
    (tmp_path / "test.txt").write_text("data_0\ndata_1")
    return tmp_path


def test_builders_from_the_command_line(spark, store):
    at = str(store)
    cli.main(["infer", at, f"{at}/inferred", "--test-list", f"{at}/test.txt", "--split", "test", "--workbook", f"{at}/inferred.xlsx"])
    assert sorted(r["stem"] for r in spark.read.json(f"{at}/inferred").collect()) == ["data_0", "data_1"]
    for _ in range(2):  # the second run finds all stems in the ledger
        cli.main(["preference-pairs", at, f"{at}/pairs", "--max-pairs-per-prompt", "2", "--test-list", f"{at}/test.txt"])
        assert spark.read.json(f"{at}/pairs").groupBy("_stem").count().collect() and spark.read.json(f"{at}/pairs").count() == 12
    cli.main(["rejection-samples", at, f"{at}/samples"])
    n = spark.read.json(f"{at}/samples").count()
    cli.main(["rejection-samples", at, f"{at}/samples"])
    assert 8 < n == spark.read.json(f"{at}/samples").count()
    cli.main(["training-view", "dpo_8B", f"{at}/pairs", f"{at}/view"])
    assert spark.read.parquet(f"{at}/view").where("split = 'train'").count() == 11


def test_prompts_from_the_command_line(spark, store):
    for n in ("data_3.txt", "data_5.txt"):
        (store / "user_prompt" / n).unlink()
    for n in "ab":
        (store / n).write_text("Ask: ")
    cli.main(["make-prompts", str(store), str(store / "a"), str(store / "b")])
    assert "=== Report ===\nr3\n" in (store / "user_prompt/data_3.txt").read_text() and len(os.listdir(store / "user_prompt")) == 8


def test_synthesis_from_the_command_line(spark, book, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text('=== JSON Schema ===\n{"type":"array"}\n')
    cli.main(["markdown", str(book), str(tmp_path / "md")])
    assert "## Sheet: a/b" in (tmp_path / "md/markdown/data_41000.md").read_text()
    cli.main(["synthesize", str(book), str(tmp_path / "made"), str(tmp_path / "a"), str(tmp_path / "b")])
    cli.main(["synthesize", str(book / "Other.xlsx"), str(tmp_path / "one"), str(tmp_path / "a"), str(tmp_path / "b"), "--min-id", "-1", "--no-validate"])
    for made in ("made", "one"):
        for folder, _, names in os.walk(tmp_path / made):
            for n in names:
                assert n.startswith("data_41000" if made == "made" else "Other"), (folder, n)


def test_audit_deletes_what_it_is_told(spark, store, capsys):
    (store / "json/data_1.json").write_text("{}")
    (store / "json_schema/data_2.json").unlink()
    command = ["audit", str(store / "json"), str(store / "json_schema"), "--report-dir", str(store / "report"), "--user-prompt-dir", str(store / "user_prompt"), "--delete-invalid", "--delete-missing"]
    cli.main([*command, "--dry-run"])
    assert str(store / "report/data_1.txt") in capsys.readouterr().out and (store / "json/data_1.json").exists()
    cli.main(command)
    assert not any((store / f).exists() for f in ("json/data_1.json", "json_schema/data_1.json", "report/data_1.txt", "user_prompt/data_1.txt", "json/data_2.json"))
    assert (store / "report/data_2.txt").exists() and (store / "json/data_3.json").exists()


def test_evaluation_with_a_judge(spark, tmp_path, capsys):
    (tmp_path / "rows.jsonl").write_text(json.dumps({"stem": "a", "pred_json": '{"a":1}', "gold_json": '{"a":1}', "json_schema": "{}"}) + "\n")
    cli.main(["evaluate", "--input", str(tmp_path / "rows.jsonl"), "--output", str(tmp_path / "e.xlsx"), "--rows", str(tmp_path / "scored"), "--llm", "tests.test_surface:FivesJudge"])
    assert '"llm_score":1.0' in capsys.readouterr().out and spark.read.json(str(tmp_path / "scored")).first()["llm_score"] == 1.0
