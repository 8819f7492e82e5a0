"""What the builders do after generation must grow with the input alone: rows carry what is needed, and are spread over all tasks."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tessera import queries as Q
from tessera.functions import udfs as U
from tessera.plans import pipelines as P
from tessera.plans.provider import StubProvider, generate


def _counts(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [plan.count(x) for x in ("Join ", "Aggregate ", "Window ", "MapInArrow ")] + ["RepartitionByExpression" in plan]


def _from(case, wrong):
    """A schema or prompt and what else the builders take."""
    schema = '{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":%d}}}' % case
    return f"p\n=== JSON Schema ===\n{'{' if wrong else schema}", schema


def test_c7_schema_pairs(spark, sf):
    assert _counts(Q.QUERIES["c7_schema_pairs"](spark, sf)) == [0, 0, 0, 1, True]


def test_c8_rejection_sampling(spark, sf):
    assert _counts(Q.QUERIES["c8_rejection_sampling"](spark, sf)) == [0, 0, 0, 1, True]


@pytest.mark.parametrize("name", ["c9_preference_pairs", "c9_preference_ledger"])
def test_c9_preference(spark, sf, name):
    # gold exists, gold with its schema, chosen
    assert _counts(Q.QUERIES[name](spark, sf)) == [3, 0, 0, 1, True]


def test_c9_statuses(spark):
    prompts = spark.createDataFrame([(f"{i}", _from(i, i == 1)[0]) for i in range(4)], "stem string, user_prompt string")
    gold = spark.createDataFrame([(f"{i}", '{"k":%d}' % (-1 if i == 2 else i)) for i in range(4)], "stem string, gold_json string")
    schemas = spark.createDataFrame([(f"{i}", _from(i, False)[1]) for i in range(4)], "stem string, json_schema string")
    for every, want in ((1, "accepted"), (0, "no_failure")):
        made, ledger = P.preference_pairs(prompts, gold, schemas, lambda: StubProvider(spoil_every=every), n=3, pairs=2)  # noqa: B023
        assert {r["stem"]: r["status"] for r in ledger.collect()} == {"0": want, "1": "no_schema", "2": "invalid_gold", "3": want}
        assert sorted(r["_stem"] for r in made.collect()) == (["0", "0", "3", "3"] if every else [])


def test_c13_inference(spark, sf):
    assert _counts(Q.QUERIES["c13_inference"](spark, sf)) == [2, 0, 0, 1, True]


def test_c10_synthesis(spark, sf):
    assert _counts(Q.QUERIES["c10_synthesis"](spark, sf)) == [0, 0, 0, 1, True]


def test_c10_failures(spark):
    class Fails(StubProvider):
        def generate(self, prompts, samples):
            return [ValueError("no") if "bad" in p else r for p, r in zip(prompts, super().generate(prompts, samples), strict=True)]

    rows = spark.createDataFrame([("data_41000", 'x\n=== JSON Schema ===\n{"type":"object","required":["a"]}'), ("data_41001", "bad"), ("data_41002", None), ("data_7", "x")], "stem string, text string")
    got = {r["stem"]: r["status"] for r in P.synthesis(rows, "R: ", "J: ", lambda: Fails(0, True)).collect()}
    assert got == {"data_41000": "ok", "data_41001": "failed", "data_41002": "failed"}


def test_null_prompt_leaves_its_batch_alone(spark):
    df = spark.createDataFrame([(f"{i}", None if i == 2 else "p") for i in range(4)], "stem string, prompt string").coalesce(1)
    got = sorted((r["stem"], r["sample_idx"], r["error"]) for r in generate(df, StubProvider, 2).collect())
    assert got == [(f"{i}", s, "no prompt" if i == 2 else None) for i in range(4) for s in range(2)]


def test_j13_leaf_rows(spark, sf):
    df = Q.QUERIES["j13_leaf_rows_udtf"](spark, sf)
    # with Arrow, Spark makes a table of each row's leaves
    assert U.JsonLeafRows.evalType == PythonEvalType.SQL_TABLE_UDF and _counts(df)[-1]
    spark.createDataFrame([(1, '{"a":[1,"é"],"b":{"c":null}}'), (2, "{bad"), (3, None), (4, "{}")], "i int, x string").createOrReplaceTempView("leaf_rows")
    got = [(r["i"], r["path"], json.loads(r["value"])) for r in spark.sql("select i, l.* from leaf_rows, lateral json_leaf_rows(x) l").orderBy(F.col("path")).collect()]
    assert got == [(1, "a[0]", 1), (1, "a[1]", "é"), (1, "b.c", None)]


@pytest.mark.parametrize("name", ["c9_preference_pairs", "c9_preference_ledger"])
def test_c9_broadcasts_no_stems(spark, sf, name):
    plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and not [line for line in plan.split("\n") if "LeftSemi" in line and "SortMergeJoin" not in line]
