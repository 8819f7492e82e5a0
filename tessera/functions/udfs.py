"""The JSON functions as Arrow-batched column functions and table functions, and their registration for SQL.

Python is used only where Spark's own JSON differs from JSON as Python reads it (trailing text, NaN, duplicate keys, big
numbers, key order) or has no such operation at all.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsonx
from .schema import outcome


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


METRICS = _struct(no_output=T.BooleanType(), exact_match=T.BooleanType(), schema_valid=T.BooleanType(), noise_ratio=T.DoubleType(), value_match=T.DoubleType())


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def json_ok(text: pd.Series) -> pd.Series:
    return text.map(lambda t: jsonx.loads(t) is not jsonx.NOTHING).astype(bool)


@F.pandas_udf(T.StringType())
def json_error(text: pd.Series) -> pd.Series:
    return _each(jsonx.parse_error, text)


@F.pandas_udf(T.StringType())
def json_pretty(text: pd.Series) -> pd.Series:
    return _each(lambda t: None if (v := jsonx.loads(t)) is jsonx.NOTHING else jsonx.pretty(v), text)


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series, mode: pd.Series) -> pd.Series:
    return _each(jsonx.extract, text, mode)


@F.pandas_udf(T.StringType())
def function_call(text: pd.Series) -> pd.Series:
    return _each(jsonx.function_call, text)


@F.pandas_udf(T.StringType())
def tool_call(text: pd.Series) -> pd.Series:
    return _each(jsonx.tool_call, text)


@F.pandas_udf(_struct(json=T.StringType(), json_schema=T.StringType(), error=T.StringType()))
def json_and_schema(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jsonx.sections(t) for t in text], columns=["json", "json_schema", "error"])


@F.pandas_udf(T.StringType())
def prompt_schema(text: pd.Series) -> pd.Series:
    return _each(jsonx.prompt_schema, text)


@F.pandas_udf(T.BooleanType())
def schema_validate(value: pd.Series, schema: pd.Series) -> pd.Series:
    return _each(lambda v, s: (x := jsonx.loads(v)) is not jsonx.NOTHING and s is not None and outcome(x, s)[0], value, schema).astype(bool)


@F.pandas_udf(T.StringType())
def schema_error(value: pd.Series, schema: pd.Series) -> pd.Series:
    return _each(lambda v, s: "not JSON" if (x := jsonx.loads(v)) is jsonx.NOTHING else "no schema" if s is None else outcome(x, s)[1], value, schema)


@F.pandas_udf(_struct(ok=T.BooleanType(), clean=T.StringType()))
def check_output(raw: pd.Series, schema: pd.Series, mode: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jsonx.check_output(*row) for row in zip(raw, schema, mode, strict=True)], columns=["ok", "clean"])


@F.pandas_udf(T.StringType())
def trivial_reason(schema: pd.Series) -> pd.Series:
    return _each(jsonx.trivial_reason, schema)


@F.pandas_udf(T.BooleanType())
def empty_json(text: pd.Series) -> pd.Series:
    return _each(jsonx.empty_json, text)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_leaves(text: pd.Series) -> pd.Series:
    return _each(lambda t: None if (v := jsonx.loads(t)) is jsonx.NOTHING else {p: jsonx.dumps(x) for p, x in jsonx.leaves(v).items()}, text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def schema_key_names(schema: pd.Series) -> pd.Series:
    return _each(lambda s: None if (v := jsonx.loads(s)) is jsonx.NOTHING else sorted(jsonx.key_names(jsonx.schema_paths(v))), schema)


@F.pandas_udf(T.ArrayType(T.StringType()))
def schema_leaf_paths(schema: pd.Series) -> pd.Series:
    return _each(lambda s: None if (v := jsonx.loads(s)) is jsonx.NOTHING else sorted(jsonx.schema_paths(v)), schema)


@F.pandas_udf(T.StringType())
def json_minimal(schema: pd.Series) -> pd.Series:
    return _each(jsonx.minimal, schema)


@F.pandas_udf(METRICS)
def eval_json(pred: pd.Series, gold: pd.Series, schema: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jsonx.evaluate(*row) for row in zip(pred, gold, schema, strict=True)], columns=METRICS.names)


@F.pandas_udf(T.DoubleType())
def schema_reward(completion: pd.Series, schema: pd.Series) -> pd.Series:
    return _each(jsonx.reward, completion, schema).astype(float)


def token_counter(path: str):
    """A column function: how many tokens a text has by the vocabulary file given (tokenizers' JSON, or a sentencepiece model); null for null."""
    found: dict[str, object] = {}

    def load():
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]

    @F.pandas_udf(T.LongType())
    def token_count(text: pd.Series) -> pd.Series:
        count = found.get("f") or found.setdefault("f", load())
        counts = iter(count([t for t in text if t is not None]))
        return pd.Series([None if t is None else next(counts) for t in text], dtype=object)

    return token_count


@F.udtf(returnType=_struct(path=T.StringType(), value=T.StringType()), useArrow=False)
class JsonLeafRows:
    """json_leaf_rows(json): a row for each leaf."""

    def eval(self, text: str):
        value = jsonx.loads(text)
        if value is not jsonx.NOTHING:
            for path, x in jsonx.leaves(value).items():
                yield path, json.dumps(x, ensure_ascii=False)


@F.udtf(returnType=_struct(idx=T.IntegerType(), role=T.StringType(), content=T.StringType()), useArrow=True)
class ChatTurns:
    """chat_turns(chat): the turns of a flat transcript."""

    def eval(self, chat: str):
        import re

        parts = re.split(r"\b(USER|ASSISTANT):\s*", chat or "")
        for k in range(1, len(parts) - 1, 2):
            yield (k - 1) // 2, parts[k].lower(), parts[k + 1].strip()


FUNCTIONS = {
    "json_loads_ok": json_ok, "json_error": json_error, "json_pretty": json_pretty, "extract_json": extract_json, "function_call": function_call, "tool_call": tool_call,
    "json_and_schema": json_and_schema, "prompt_schema": prompt_schema, "schema_validate": schema_validate, "schema_errors": schema_error, "check_output": check_output,
    "trivial_reason": trivial_reason, "empty_json": empty_json, "json_leaves": json_leaves, "schema_key_names": schema_key_names, "schema_leaf_paths": schema_leaf_paths,
    "json_minimal": json_minimal, "eval_json": eval_json, "schema_reward": schema_reward,
}


def register_all(spark: SparkSession, vocabulary: str | None = None) -> None:
    """All functions for spark.sql, and the xlsx source. token_count counts by the vocabulary file given; without one it is the approximation of approx_tokens."""
    from ..sources.xlsx import XlsxSource

    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    if vocabulary:
        spark.udf.register("token_count", token_counter(vocabulary))
    else:
        spark.sql("create or replace temporary function token_count(t string) returns bigint return cast(coalesce(regexp_count(t, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\\\s]'), 0) as bigint)")
    spark.udtf.register("json_leaf_rows", JsonLeafRows)
    spark.udtf.register("chat_turns", ChatTurns)
    spark.sql("create or replace temporary function strip_think(t string) returns string return regexp_replace(element_at(split(t, '</think>', 2), -1), '(?U)^[\\\\s\\\\x1c-\\\\x1f]+|[\\\\s\\\\x1c-\\\\x1f]+$', '')")
    spark.dataSource.register(XlsxSource)
