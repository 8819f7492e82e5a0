"""The registered queries of the engine's operators over the driver tables, each with DuckDB SQL where SQL has it.

Keys begin with the operator's id. Inputs stand in for the engine's own artifacts: conversations for chats, documents for
prompts and reports, labels for the side that may lack a stem, orders for structured records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import udfs as U
from .operators import chat as C
from .operators import relational as R
from .operators import sheets as H
from .operators import stats as A
from .plans import pipelines as P
from .plans.provider import StubProvider

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None, flat: tuple[str, str, str] | None = None):
    """Registers a query; ``flat`` (column, two fields) writes its messages as one string, which all engines compare alike."""

    def put(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            if flat:
                c, one, two = flat
                out = out.withColumn(c, F.array_join(F.transform(c, lambda m: F.concat(m[one], F.lit("="), m[two])), "|"))
            return out

        QUERIES[name] = run
        if sql:
            c, one, two = flat or ("", "", "")
            ORACLE[name] = f"SELECT * REPLACE (array_to_string(list_transform({c}, lambda m: m.\"{one}\" || '=' || m.\"{two}\"), '|') AS {c}) FROM ({sql})" if flat else sql
        return f

    return put


#: str.strip() in DuckDB's regular expressions.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


big = lambda c: c.cast("bigint")


# -- scans -----------------------------------------------------------------------------------------------------------


@query("s10_parquet_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def s10(t):
    from .sources.readers import parquet

    return parquet(t.spark, f"{t.dir}/orders.parquet", ["o_orderkey", "o_orderstatus"]).where("o_orderstatus = 'F'")


@query("s12_peek", "SELECT substr(CAST(r_regionkey AS VARCHAR), 1, 300) AS r_regionkey, substr(r_name, 1, 300) AS r_name FROM region ORDER BY region.r_regionkey LIMIT 3")
def s12(t):
    from .sources.readers import peek

    return peek(t.region.orderBy("r_regionkey"), 3)


@query("s15_page_links", r"SELECT DISTINCT unnest(regexp_extract_all(html, 'href=[\"'']([^\"'']*)[\"'']', 1)) AS link FROM pages")
def s15(t):
    return t.pages.select(F.explode(F.regexp_extract_all("html", F.lit("href=[\"']([^\"']*)[\"']"), 1)).alias("link")).distinct()


@query("s15_detail_links", r"""SELECT DISTINCT page_id, 'https://example.org/data' || l || '/fileData.do' AS link
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"'']*)"', 1)) AS l FROM pages)""")
def s15b(t):
    html = F.regexp_replace("html", "href=\"(/[^\"']*)\"", 'href="/data$1/fileData.do"')
    return t.pages.select("page_id", F.explode(X.detail_links(html, "https://example.org")).alias("link"))


# -- projections -----------------------------------------------------------------------------------------------------


@query("p1_strip_think", f"SELECT doc_id, 'c' AS after, {_strip("'c ' || text")} AS before, {_strip('text')} AS without FROM documents")
def p1(t):
    mark = F.lit(" b</think>c ")
    return t.documents.select("doc_id", X.strip_think(F.concat("text", mark)).alias("after"), X.strip_think(F.concat(mark, "text")).alias("before"), X.strip_think(F.col("text")).alias("without"))


@query("p2_normalize_newlines", "SELECT doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)) || chr(13), '\\r\\n?', chr(10), 'g') AS text FROM documents")
def p2(t):
    return t.documents.select("doc_id", X.normalize_newlines(F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r"))).alias("text"))


@query("p3_between_sections", f"SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN {_strip('text')} END AS part FROM documents")
def p3(t):
    body = F.concat(F.lit("x\n=== json ===\n"), "text", F.when(F.col("doc_id") % 7 != 0, "\n=== JSON_SCHEMA ===\n{}").otherwise("\n=== end ==="))
    return t.documents.select("doc_id", X.between_sections(body).alias("part"))


@query("p4_after_schema_header", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS schema_text FROM events""")
def p4(t):
    body = F.concat(F.lit("do it\n"), F.when(F.col("event_id") % 5 != 0, "=== json schema ===\n").otherwise("== none ==\n"), "props", F.lit(" \n"))
    return t.events.select("event_id", X.after_schema_header(body).alias("schema_text"))


@query("p4_prompt_schema_parsed", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS schema_text FROM events""")
def p4b(t):
    body = F.concat(F.lit("do it\n"), F.when(F.col("event_id") % 5 != 0, "=== JSON Schema ===\n").otherwise("=== JSON Schema === and "), "props")
    return t.events.select("event_id", U.prompt_schema(body).alias("schema_text"))


@query("p5_fill_table", "SELECT doc_id, replace('<original_table>|' || text || '<original_table>', '<original_table>', lang) AS text FROM documents")
def p5(t):
    return t.documents.select("doc_id", X.fill_table(F.concat(F.lit("<original_table>|"), "text", F.lit("<original_table>")), F.col("lang")).alias("text"))


@query("p6_user_prompt", "SELECT doc_id, lang || chr(10) || chr(10) || '=== Report ===' || chr(10) || text || chr(10) || chr(10) || '=== JSON Schema ===' || chr(10) || source AS prompt FROM documents")
def p6(t):
    return t.documents.select("doc_id", X.user_prompt(F.col("lang"), F.col("text"), F.col("source")).alias("prompt"))


@query("p7_file_id", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id WHEN 1 THEN doc_id WHEN 2 THEN -doc_id WHEN 3 THEN -1 ELSE -1 END AS file_id FROM documents")
def p7(t):
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 5
    stem = F.when(k == 0, F.concat(F.lit("data_"), n)).when(k == 1, F.concat(F.lit("data"), n)).when(k == 2, F.concat(F.lit("data-"), n)).when(k == 3, F.concat(F.lit("sheet"), n)).otherwise(F.concat(n, F.lit("x")))
    return t.documents.select("doc_id", X.file_id(stem).alias("file_id"))


@query("p8_chat_projection", "SELECT doc_id, [{'role': 'system', 'content': lang}, {'role': 'user', 'content': source}, {'role': 'assistant', 'content': text}] AS messages FROM documents", flat=("messages", "role", "content"))
def p8(t):
    return t.documents.select("doc_id", X.chat(("system", F.col("lang")), ("user", F.col("source")), ("assistant", F.col("text"))).alias("messages"))


@query("p9_sharegpt_projection", """SELECT doc_id, [{'from': 'human', 'value': source}, {'from': 'gpt', 'value': text}] AS conversations FROM documents""", flat=("conversations", "from", "value"))
def p9(t):
    return t.documents.select("doc_id", X.sharegpt(("human", F.col("source")), ("gpt", F.col("text"))).alias("conversations"))


@query("p10_system_prefix", f"SELECT doc_id, {_strip('text')} AS system FROM documents")
def p10(t):
    return t.documents.select("doc_id", X.drop_system_prefix(F.concat(F.when(F.col("doc_id") % 2 == 0, "SYSTEM:  ").otherwise("system:\n"), "text")).alias("system"))


@query("p11_paragraph_chat", "SELECT doc_id, [{'from': 'human', 'value': source}, {'from': 'gpt', 'value': lang}, {'from': 'observation', 'value': '{}'}] AS turns FROM documents", flat=("turns", "from", "value"))
def p11(t):
    nl = "\n\n\n"
    chat = F.concat(F.lit("USER: "), "source", F.lit(f"{nl}ASSISTANT: "), "lang", F.lit(f" <|endoftext|>\n\ndropped paragraph{nl}FUNCTION RESPONSE: {{}}{nl}USER: "))
    return t.documents.select("doc_id", X.parse_paragraph_chat(chat).alias("turns"))


@query("p12_marker_chat", "SELECT doc_id, [{'role': 'user', 'content': source}, {'role': 'assistant', 'content': lang || ' FUNCTION RESPONSE: {}'}, {'role': 'user', 'content': ''}] AS turns FROM documents", flat=("turns", "role", "content"))
def p12(t):
    chat = F.concat(F.lit("lost USER: "), "source", F.lit("\n\n\nASSISTANT:  "), "lang", F.lit(" FUNCTION RESPONSE: {} \n\nUSER: "))
    return t.documents.select("doc_id", X.parse_marker_chat(chat).alias("turns"))


@query("p13_role_names", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE role END AS role FROM conversations")
def p13(t):
    source = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", X.role_name(source).alias("role"))


@query("p14_file_names", f"SELECT page_id, {_strip('''regexp_replace(url, '[^\\p{L}\\p{N} ._]', '', 'g')''')} AS name FROM pages")
def p14(t):
    return t.pages.select("page_id", X.safe_file_name(F.col("url")).alias("name"))


@query("p15_header_names", f"SELECT doc_id, replace({_strip('text')}, chr(10), ' ') AS name FROM documents")
def p15(t):
    return t.documents.select("doc_id", X.header_name(F.col("text")).alias("name"))


@query("p17_prompt_assembly", "SELECT doc_id, lang || '=======INPUT MARKDOWN======' || text AS prompt FROM documents")
def p17(t):
    return t.documents.select("doc_id", X.with_markdown(F.col("lang"), F.col("text")).alias("prompt"))


@query("p18_language_route", "SELECT doc_id, CASE WHEN doc_id * 100 >= 20000 THEN 'en' ELSE 'ko' END AS prompt FROM documents")
def p18(t):
    return t.documents.select("doc_id", X.by_language(F.col("doc_id") * 100, F.lit("en"), F.lit("ko")).alias("prompt"))


@query("p19_last_content", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def p19(t):
    return C.to_messages(t.conversations).select("conv_id", X.last_content(F.concat("messages", X.chat(("tool", F.lit(None).cast("string"))))).alias("text"))


@query("p20_model_paths", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a/b' WHEN page_id % 3 = 1 THEN 'org/repo' ELSE '/abs/a/b' END AS repo, CASE WHEN page_id % 3 = 1 THEN 'x/y' END AS subfolder FROM pages")
def p20(t):
    path = F.when(F.col("page_id") % 3 == 0, "a/b").when(F.col("page_id") % 3 == 1, "org/repo/x/y").otherwise("/abs/a/b")
    return t.pages.select("page_id", X.model_path(path).alias("p")).select("page_id", "p.repo", "p.subfolder")


@query("p21_previews", "SELECT conv_id, turn, substr(text, 1, CASE WHEN role = 'assistant' THEN 300 ELSE 200 END) AS text FROM conversations")
def p21(t):
    return t.conversations.select("conv_id", "turn", F.when(F.col("role") == "assistant", X.preview(F.col("text"), 300)).otherwise(X.preview(F.col("text"), 200)).alias("text"))


@query("p22_sheet_names", r"SELECT page_id, translate(url, '/\', '__') AS name FROM pages")
def p22(t):
    return t.pages.select("page_id", X.safe_sheet_name(F.col("url")).alias("name"))


@query("p23_status", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'FAIL' WHEN quality = 1 THEN 'OK' ELSE 'WARN' END AS status FROM labels")
def p23(t):
    return t.labels.select("doc_id", X.status_label(F.col("toxic") == 1, F.col("quality") == 1).alias("status"))


@query("p24_templates", """SELECT [{'role': 'system', 'content': 'be brief'}, {'role': 'user', 'content': 'Schema:' || chr(10) || s || chr(10) || 'Answer.'}] AS prompt, s AS schema_str, item_id AS unique_id
FROM (SELECT item_id, '{"title":"' || item_id || '"}' AS s FROM benchmark)""", flat=("prompt", "role", "content"))
def p24(t):
    schemas = t.benchmark.select(F.concat(F.lit('{"title":"'), "item_id", F.lit('"}')).alias("json_schema"), F.col("item_id").alias("unique_id"))
    return P.schema_prompts(schemas, "be brief", "Schema:\n{schema}\nAnswer.")


@query("k7_display_cut", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '…' ELSE text END AS cell FROM documents")
def k7(t):
    return t.documents.select("doc_id", X.display_cell(F.col("text"), 1000).alias("cell"))


# -- JSON ------------------------------------------------------------------------------------------------------------


@query("j1_parse_check", "SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def j1(t):
    return t.events.select("event_id", U.json_ok(F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props"))).alias("ok"))


@query("j2_extract_chunk", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE '{"k": ' || json_extract(props, '$.k') || '}' END AS found FROM events""")
def j2(t):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("see [1] ```json\n"), "props", F.lit("\n``` done"))).when(k == 1, F.concat(F.lit("so "), "props", F.lit("  "))).otherwise(F.concat(F.lit("```json\n{bad}\n``` "), "props"))
    return t.events.select("event_id", U.extract_json(text, F.lit("chunk")).alias("found"))


@query("j3_extract_completion", """SELECT event_id, '{"k": ' || json_extract(props, '$.k') || '}' AS found FROM events""")
def j3(t):
    return t.events.select("event_id", U.extract_json(F.concat(F.lit("["), "props", F.lit("]")), F.lit("completion")).alias("found"))


@query("j4_extract_output", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k": ' || json_extract(props, '$.k') || '}' END AS found FROM events""")
def j4(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("hm {x</think> the answer "), "props", F.lit("."))).otherwise("</think>[1,2]")
    return t.events.select("event_id", U.extract_json(text, F.lit("output")).alias("found"))


@query("j5_strict", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k": ' || json_extract(props, '$.k') || '}' END AS found FROM events""")
def j5(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```\n"))).otherwise(F.concat(F.lit("so "), "props"))
    return t.events.select("event_id", U.extract_json(text, F.lit("strict")).alias("found"))


@query("j6_function_call", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '123' END AS found FROM events""")
def j6(t):
    k = F.col("event_id") % 3
    return t.events.select("event_id", U.function_call(F.when(k == 0, F.concat(F.lit("<functioncall> "), "props", F.lit(" ok"))).when(k == 1, "123").otherwise("no call")).alias("found"))


@query("j7_tool_call", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k": ' || json_extract(props, '$.k') || '}' END AS found FROM events""")
def j7(t):
    one = F.concat(F.lit("<tool_call>\n"), "props", F.lit("\n</tool_call>"))
    return t.events.select("event_id", U.tool_call(F.when(F.col("event_id") % 2 == 0, one).otherwise(F.concat(one, one))).alias("found"))


@query("j8_json_and_schema", """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN '{"k": ' || json_extract(props, '$.k') || '}' END AS json, CASE WHEN event_id % 4 <> 0 THEN '{"type": "object"}' END AS json_schema, event_id % 4 = 0 AS failed FROM events""")
def j8(t):
    text = F.concat(F.lit("=== JSON ===\r\n"), "props", F.when(F.col("event_id") % 4 != 0, '\r\n=== JSON_SCHEMA ===\n```json\n{"type":"object"}\n```').otherwise("\n=== NOTHING ==="))
    return t.events.select("event_id", U.json_and_schema(text).alias("p")).select("event_id", "p.json", "p.json_schema", F.col("p.error").isNotNull().alias("failed"))


K_SCHEMA = '{"type":"object","required":["k"],"properties":{"k":{"type":"integer","maximum":49}}}'


@query("j9_schema_validate", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) <= 49 AS valid FROM events")
def j9(t):
    return t.events.select("event_id", U.schema_validate("props", F.lit(K_SCHEMA)).alias("valid"))


@query("j10_output_check", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) <= 49 AS ok, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) <= 49 THEN '{' || chr(10) || '  "k": ' || json_extract(props, '$.k') || chr(10) || '}' END AS clean FROM events""")
def j10(t):
    return t.events.select("event_id", U.check_output(F.concat(F.lit("<think>a</think> it is "), "props"), F.lit(K_SCHEMA), F.lit("bare")).alias("c")).select("event_id", "c.ok", "c.clean")


@query("j11_sections_check", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) <= 49 AND event_id % 2 = 0 AS ok FROM events")
def j11(t):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("=== JSON ===\n"), "props", F.lit("\n=== JSON_SCHEMA ===\n{}"))).otherwise(F.col("props"))
    return t.events.select("event_id", U.check_output(raw, F.lit(K_SCHEMA), F.lit("sections")).alias("c")).select("event_id", "c.ok")


@query("j12_strict_check", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) <= 49 AND event_id % 2 = 0 AS ok FROM events")
def j12(t):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("so "), "props"))
    return t.events.select("event_id", U.check_output(raw, F.lit(K_SCHEMA), F.lit("strict")).alias("c")).select("event_id", "c.ok")


@query("j13_leaves", """SELECT o_orderkey, path, value FROM (
  SELECT o_orderkey, unnest(['id', 'customer.key', 'customer.tags[0]', 'customer.tags[1]', 'note']) AS path,
         unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '"' || o_orderstatus || '"', '"x"', 'null']) AS value FROM orders)""")
def j13(t):
    doc = F.format_string('{"id":%d,"customer":{"key":%d,"tags":["%s","x"]},"none":{},"note":null}', "o_orderkey", "o_custkey", "o_orderstatus")
    return t.orders.select("o_orderkey", F.explode(U.json_leaves(doc)).alias("path", "value"))


@query("j13_leaf_rows_udtf", "SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def j13b(t):
    U.register_all(t.spark)
    R.spread(t.events.select("event_id", "props"), "event_id").createOrReplaceTempView("leaf_events")
    return t.spark.sql("SELECT e.event_id, l.path, l.value FROM leaf_events e, LATERAL json_leaf_rows(e.props) l")


@query("j14_schema_paths", "SELECT n_nationkey, ['a', 'a.' || n_name, 'm', 'm.*.z'] AS paths FROM nation")
def j14(t):
    schema = F.concat(F.lit('{"properties":{"a":{"properties":{"'), "n_name", F.lit('":{}}},"m":{"additionalProperties":{"properties":{"z":{}}},"items":{"properties":{"no":{}}}}}}'))
    return t.nation.select("n_nationkey", U.schema_leaf_paths(schema).alias("paths"))


@query("j16_minimal_instances", """SELECT p_partkey, '{"size": ' || (CAST(ceil(p_size / 4.0) AS INTEGER) * 4) || ', "name": "a", "kind": "a", "at": "2024-01-01", "list": [true, "a", "a"], "ref": ' || p_size || '}' AS made FROM part""")
def j16(t):
    schema = F.format_string(
        '{"type":"object","required":["size","name","kind","at","list","ref"],"$defs":{"n":{"type":"integer"}},"properties":{"name":{"type":["null","string"]},"size":{"type":"integer","minimum":%d,"multipleOf":4},'
        '"kind":{"anyOf":[{"enum":[]},{"type":"string"}]},"at":{"type":"string","format":"date","minLength":3},"list":{"type":"array","prefixItems":[{"type":"boolean"}],"items":{"type":"string"},"minItems":3},"ref":{"$ref":"#/$defs/n","minimum":%d}}}',
        "p_size",
        "p_size",
    )
    return t.part.select("p_partkey", U.json_minimal(schema).alias("made"))


@query("j17_self_check", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || '.0' END AS made FROM part")
def j17(t):
    key = F.when(F.col("p_size") % 2 == 0, "minimum").otherwise("exclusiveMinimum")
    return t.part.select("p_partkey", U.json_minimal(F.format_string('{"type":"number","%s":%d}', key, "p_size")).alias("made"))


@query("j18_trivial_schemas", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'trivial' WHEN 1 THEN 'trivial' WHEN 2 THEN 'type' WHEN 3 THEN 'parse' END AS reason FROM nation")
def j18(t):
    k = F.col("n_nationkey") % 5
    return t.nation.select("n_nationkey", U.trivial_reason(F.when(k == 0, "{}").when(k == 1, '{"type":"object","properties":{}}').when(k == 2, "[]").when(k == 3, "{").otherwise('{"type":"string"}')).alias("reason"))


@query("j19_empty_json", "SELECT n_nationkey, n_nationkey % 3 <> 2 AS empty FROM nation")
def j19(t):
    k = F.col("n_nationkey") % 3
    return t.nation.select("n_nationkey", U.empty_json(F.when(k == 0, " {} ").when(k == 1, "[]").otherwise("[{}]")).alias("empty"))


@query("j20_pretty", """SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract(props, '$.k') || chr(10) || '}' AS text FROM events""")
def j20(t):
    return t.events.select("event_id", U.json_pretty("props").alias("text"))


# -- metrics ---------------------------------------------------------------------------------------------------------

ORDER_SCHEMA = '{"type":"object","required":["id","status","total"],"properties":{"id":{"type":"integer"},"status":{"enum":["F","O","P"]},"total":{"type":"number"}},"additionalProperties":false}'


def predictions(t: Tables) -> DataFrame:
    """An order as gold JSON, and a prediction that is spoilt in one of six ways by its number."""
    gold = F.format_string('{"id":%d,"status":"%s","total":%d}', "o_orderkey", "o_orderstatus", F.floor("o_totalprice"))
    k = F.col("o_orderkey") % 6
    pred = (
        F.when(k == 0, gold).when(k == 1, F.format_string('{"id":%d,"status":"%s"}', "o_orderkey", "o_orderstatus")).when(k == 2, F.format_string('{"id":%d,"status":"Q","total":%d}', "o_orderkey", F.floor("o_totalprice")))
        .when(k == 3, F.concat(gold, F.lit(" x"))).when(k == 4, F.lit("")).otherwise(F.format_string('{"id":%d,"status":"%s","total":%d,"more":1}', "o_orderkey", "o_orderstatus", F.floor("o_totalprice")))
    )
    return t.orders.select(F.col("o_orderkey").alias("stem"), gold.alias("gold_json"), F.lit(ORDER_SCHEMA).alias("json_schema"), pred.alias("pred_json"))


_METRIC_SQL = """SELECT o_orderkey AS stem, k IN (3, 4) AS no_output, k = 0 AS exact_match, k = 0 AS schema_valid,
  CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 5 THEN 0.25 ELSE 1.0 END::DOUBLE AS noise_ratio,
  CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 / 3 WHEN 2 THEN 2.0 / 3 WHEN 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS value_match
FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)"""


@query("a1_row_metrics", f"SELECT stem, no_output, exact_match, schema_valid, round(noise_ratio, 9) AS noise_ratio, round(value_match, 9) AS value_match FROM ({_METRIC_SQL})")
def a1(t):
    return A.evaluated(predictions(t)).select("stem", "no_output", "exact_match", "schema_valid", F.round("noise_ratio", 9).alias("noise_ratio"), F.round("value_match", 9).alias("value_match"))


@query("c14_evaluation_summary", f"""SELECT count(*) AS n, round(avg(no_output::INT), 9) AS no_output, round(avg(exact_match::INT), 9) AS exact_match, round(avg(schema_valid::INT), 9) AS schema_valid,
  round(avg(noise_ratio), 9) AS noise_ratio, round(avg(value_match), 9) AS value_match FROM ({_METRIC_SQL})""")
def c14(t):
    out = P.evaluation(predictions(t))[1]
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("a2_deep_equality", "SELECT event_id, event_id % 2 = 0 AS exact_match FROM events")
def a2(t):
    pred = F.when(F.col("event_id") % 2 == 0, '{"b":[1,2],"a":1.0}').otherwise('{"b":[2,1],"a":true}')
    return t.events.select("event_id", U.eval_json(pred, F.lit('{"a":1,"b":[1,2]}'), F.lit("{}")).alias("m")).select("event_id", "m.exact_match")


@query("a4_value_match", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS value_match FROM events")
def a4(t):
    k = F.col("event_id") % 3
    return t.events.select("event_id", U.eval_json(F.when(k == 0, '{"b":1}').when(k == 1, '{"b":2}').otherwise('{"a":null,"b":1,"c":0}'), F.lit('{"a":null,"b":1}'), F.lit("{}")).alias("m")).select("event_id", "m.value_match")


@query("a5_noise_arrays", """SELECT event_id, round(CASE event_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 WHEN 4 THEN 2.0 / 3 ELSE 1.0 / 3 END::DOUBLE, 9) AS noise FROM events""")
def a5(t):
    # A bare value, a value under an empty key, a list of bare values, an unknown key, one in a list, and a dotted property.
    preds = ["5", '{"":1}', "[1,2]", '{"a":1,"z":2}', '[{"a":1,"z":2}]', '{"b":{"x":"1"},"q":"2"}']
    schema = '{"type":"object","required":["none"],"properties":{"a":{"type":"integer"},"c.b":{"properties":{"x":{"type":"integer"}}}}}'
    pred = F.element_at(F.array(*map(F.lit, preds)), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", U.eval_json(pred, F.lit("{}"), F.lit(schema)).alias("m")).select("event_id", F.round("m.noise_ratio", 9).alias("noise"))


@query("a6_judge_scores", "SELECT event_id, CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN (event_id % 7 - 1) / 4.0 END::DOUBLE AS score FROM events")
def a6(t):
    return t.events.select("event_id", X.judge_score(F.concat(F.lit("Score: "), (F.col("event_id") % 7).cast("string"), F.lit(" / none"))).alias("score"))


@query("a8_length_stats", "SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, " + ", ".join(f"round(quantile_cont(n_chars, {q / 100}), 6) AS p{q}" for q in A.PERCENTILES) + ", max(n_chars) AS max, " + ", ".join(f"count(*) FILTER (n_chars > {c}) AS over_{c}, round(count(*) FILTER (n_chars > {c}) * 100.0 / count(*), 6) AS over_{c}_pct" for c in A.CUTOFFS) + " FROM documents")
def a8(t):
    out = A.length_stats(t.documents, F.col("n_chars"))
    return out.select(*[F.round(c, 6).alias(c) if c == "mean" or c.startswith("p") or c.endswith("pct") else F.col(c) for c in out.columns])


@query("a9_cutoffs", "SELECT count(*) FILTER (x <= 8192) AS fits, count(*) FILTER (x > 8192) AS exceeds, " + ", ".join(f"CAST(floor(quantile_cont(x, {q / 100})) AS BIGINT) AS cutoff_p{q}" for q in (90, 95, 99)) + " FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS x FROM documents)")
def a9(t):
    return A.recommended_cutoffs(t.documents, F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")))


@query("a10_format_errors", """SELECT conv_id, e AS error FROM (
  SELECT conv_id, 'no user message' AS e FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = 0
  UNION ALL SELECT conv_id, 'no assistant message' FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') = 0
  UNION ALL SELECT conv_id, 'blank content at ' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) FROM conversations QUALIFY turn % 3 = 2)""")
def a10(t):
    blanked = t.conversations.withColumn("text", F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("text")))
    return C.format_errors(C.to_messages(blanked))


@query("a11_duplicates", "SELECT count(*) AS n, count(*) - count(DISTINCT coalesce(u, '')) AS duplicates FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)")
def a11(t):
    first = t.conversations.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("u"))
    return A.duplicates(first, F.col("u"))


@query("a12_fill_ratio", "SELECT source AS file, count(v) AS filled, count(*) AS cells, count(v) / count(*)::DOUBLE AS ratio, count(v) / count(*)::DOUBLE < 0.6 AS sparse FROM (SELECT source, CASE WHEN n_chars % 3 > 0 THEN lang END AS v FROM documents) GROUP BY source")
def a12(t):
    cells = t.documents.select(F.col("source").alias("file"), F.when(F.col("n_chars") % 3 > 0, F.col("lang")).alias("value"))
    return A.fill_ratio(cells, t.documents.select(F.col("source").alias("file")))


@query("a13_outcomes", "SELECT CASE WHEN toxic = 1 THEN 'rejected' ELSE 'accepted' END AS status, count(*) AS n FROM labels GROUP BY 1")
def a13(t):
    return A.outcomes(t.labels.select(F.when(F.col("toxic") == 1, "rejected").otherwise("accepted").alias("status")))


@query("a14_audit", "SELECT doc_id AS stem, CASE WHEN toxic IS NULL THEN 'missing_schema' WHEN doc_id % 4 = 0 OR toxic = 1 THEN 'invalid' ELSE 'valid' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def a14(t):
    values = t.documents.select(F.col("doc_id").alias("stem"), F.when(F.col("doc_id") % 4 == 0, "{}").otherwise('{"a":1}').alias("json"))
    schemas = t.labels.select(F.col("doc_id").alias("stem"), F.when(F.col("toxic") == 1, '{"required":["b"]}').otherwise('{"type":"object"}').alias("json_schema"))
    return A.audited(values, schemas).select("stem", "status")


@query("a15_reward", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN CAST(json_extract(props, '$.k') AS INTEGER) <= 49 THEN 1.0 ELSE 0.3 END::DOUBLE AS reward FROM events")
def a15(t):
    return t.events.select("event_id", U.schema_reward(F.when(F.col("event_id") % 3 == 0, "nope").otherwise(F.col("props")), F.lit(K_SCHEMA)).alias("reward"))


@query("a16_parsed_count", "SELECT count(*) FILTER (o_orderkey % 6 NOT IN (3, 4)) AS parsed FROM orders")
def a16(t):
    rows = predictions(t).withColumn("p", F.coalesce(U.extract_json("pred_json", F.lit("strict")), F.lit("")))
    return rows.agg(F.count_if(F.col("p") != "").alias("parsed"))


@query("a17_roles_present", "SELECT complete, count(*) AS convs, CAST(sum(turns) AS BIGINT) AS turns FROM (SELECT conv_id, bool_or(role = 'user') AND bool_or(role = 'assistant') AS complete, count(*) AS turns FROM conversations GROUP BY conv_id) GROUP BY complete")
def a17(t):
    m = C.to_messages(t.conversations)
    return m.groupBy(C.has_roles(F.col("messages"), "user", "assistant", field="role").alias("complete")).agg(F.count("*").alias("convs"), big(F.sum(F.size("messages"))).alias("turns"))


@query("a18_length_filter", r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) <= 300")
def a18(t):
    return A.short_enough(t.documents, "text", 300).select("doc_id")


# -- joins -----------------------------------------------------------------------------------------------------------


@query("n1_inner_three", "SELECT doc_id, d.n_chars, l.quality, b.item_id FROM documents d JOIN labels l USING (doc_id) JOIN benchmark b ON b.item_id = d.doc_id")
def n1(t):
    return R.join_all("doc_id", t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), t.benchmark.select(F.col("item_id").alias("doc_id"), "item_id"))


@query("n2_left_outer", "SELECT d.doc_id, quality, toxic, item_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def n2(t):
    return R.join_all("doc_id", t.documents.select("doc_id"), t.labels, t.benchmark.select(F.col("item_id").alias("doc_id"), "item_id"), how="left").select("doc_id", "quality", "toxic", "item_id")


@query("n3_left_or_empty", "SELECT doc_id, coalesce(b.text, '') AS gold_json FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def n3(t):
    return R.left_or_empty("doc_id", t.documents.select("doc_id"), t.benchmark.select(F.col("item_id").alias("doc_id"), F.col("text").alias("gold_json")))


@query("n4_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def n4(t):
    return R.having(t.documents.select("doc_id"), t.labels, "doc_id")


@query("n5_anti_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def n5(t):
    return R.lacking(t.documents.select("doc_id"), t.labels, "doc_id")


@query("n6_split_list", "SELECT doc_id, 'test' AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'train' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def n6(t):
    d, test = t.documents.select("doc_id"), t.labels.where("toxic = 1")
    return R.of_split(d, test, "test", "doc_id").withColumn("split", F.lit("test")).union(R.of_split(d, test, "train", "doc_id").withColumn("split", F.lit("train")))


@query("n7_valid_gold", "SELECT event_id AS stem FROM events WHERE event_id % 2 = 0 AND CAST(json_extract(props, '$.k') AS INTEGER) <= 49")
def n7(t):
    gold = t.events.select(F.col("event_id").alias("stem"), F.col("props").alias("gold_json"))
    schemas = t.events.where("event_id % 2 = 0").select(F.col("event_id").alias("stem"), F.lit(K_SCHEMA).alias("json_schema"))
    return P.chosen_responses(gold, schemas).select("stem")


@query("n8_key_union", "SELECT doc_id AS k FROM labels UNION SELECT item_id FROM benchmark UNION SELECT conv_id FROM conversations")
def n8(t):
    return R.all_keys("k", t.labels.select(F.col("doc_id").alias("k")), t.benchmark.select(F.col("item_id").alias("k")), t.conversations.select(F.col("conv_id").alias("k")))


@query("n9_keyed_zip", "SELECT o_orderkey AS stem, no_output, gold FROM (SELECT stem AS o_orderkey, no_output FROM (" + _METRIC_SQL + ")) JOIN (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS gold FROM orders) USING (o_orderkey)")
def n9(t):
    return A.evaluated(predictions(t)).select("stem", "no_output").join(t.orders.select(F.col("o_orderkey").alias("stem"), F.floor("o_totalprice").alias("gold")), "stem")


@query("n10_missing_side", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def n10(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where("toxic is null").select("doc_id")


@query("n11_free_numbers", "WITH used AS (SELECT doc_id AS n FROM labels), gaps AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT unnest(range(1, (SELECT max(n) FROM used) + (SELECT count(*) FROM benchmark) + 1)) AS n) WHERE n NOT IN (SELECT n FROM used)) SELECT item_id, n FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) JOIN gaps USING (k)")
def n11(t):
    return R.free_numbers(t.benchmark.select("item_id"), t.labels.select(F.col("doc_id").alias("n")), "item_id").select("item_id", "n")


@query("n12_nearest_user", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_text FROM conversations QUALIFY role = 'assistant'")
def n12(t):
    return C.last_user_before(t.conversations).where("role = 'assistant'").select("conv_id", "turn", "user_text")


@query("n13_repeat_prompts", "SELECT item_id, CAST(i AS INTEGER) AS sample_idx FROM benchmark, range(4) r(i)")
def n13(t):
    return R.repeated(t.benchmark.select("item_id"), 4)


# -- order -----------------------------------------------------------------------------------------------------------


@query("w1_shard", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p % 3 = 1")
def w1(t):
    return R.shard(t.documents.select("doc_id"), 3, 1, "doc_id")


@query("w2_batches", "SELECT doc_id, CAST((row_number() OVER (ORDER BY source, doc_id) - 1) // 20 AS BIGINT) AS batch FROM documents")
def w2(t):
    return R.batches(t.documents.select("doc_id", "source"), 20, "source", "doc_id").select("doc_id", "batch")


@query("w3_last_user", "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_text FROM conversations")
def w3(t):
    return C.last_user_before(t.conversations).select("conv_id", "turn", "role", "user_text")


@query("w4_prefixes", "SELECT conv_id, turn, coalesce(list({'role': role, 'content': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS earlier FROM conversations", flat=("earlier", "role", "content"))
def w4(t):
    return C.earlier_turns(t.conversations).select("conv_id", "turn", "earlier")


@query("w5_budget", "WITH b AS (SELECT source, doc_id, text, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents) SELECT source AS file, coalesce(regexp_replace(string_agg(text, '' ORDER BY doc_id) FILTER (s <= 20000), '^\\s+', ''), '') AS text FROM b GROUP BY source")
def w5(t):
    rows = t.documents.select(F.col("source").alias("file"), F.col("doc_id").alias("sheet_idx"), F.col("text").alias("block"))
    return H.within_budget(rows, 20_000, note="")


@query("w6_numbering", "SELECT source, 'data-' || row_number() OVER (ORDER BY source) AS new_stem FROM (SELECT DISTINCT source FROM documents)")
def w6(t):
    return R.numbered(t.documents.select("source").distinct(), "data", "source")


@query("w7_rename_plan", "WITH used AS (SELECT DISTINCT turn AS n FROM conversations WHERE turn > 0 AND turn % 2 = 1), gaps AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT unnest(range(1, 100)) AS n) WHERE n NOT IN (SELECT n FROM used)) SELECT n_name, 'data_' || n || '.xlsx' AS new_name FROM (SELECT n_name, row_number() OVER (ORDER BY lower(n_name)) AS k FROM nation) JOIN gaps USING (k)")
def w7(t):
    files = t.nation.select("n_name", F.lower("n_name").alias("o"))
    used = t.conversations.where("turn > 0 and turn % 2 = 1").select(F.col("turn").alias("n")).distinct()
    return R.free_numbers(files, used, "o").select("n_name", F.format_string("data_%d.xlsx", "n").alias("new_name"))


@query("w8_first_k", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w8(t):
    return R.first_k(t.conversations, 3, ["conv_id"], F.desc("turn")).select("conv_id", "turn", "role")


@query("w9_regroup", "SELECT conv_id, list(text ORDER BY turn) AS samples FROM conversations GROUP BY conv_id")
def w9(t):
    return R.regroup(t.conversations, "conv_id", "turn", "text")


@query("l1_sorted_names", "SELECT doc_id, source FROM documents ORDER BY source, doc_id")
def l1(t):
    return t.documents.select("doc_id", "source").orderBy("source", "doc_id")


@query("l2_prefix_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def l2(t):
    return R.limited(t.documents.select("doc_id"), 100, "doc_id")


@query("l3_limit_after_filter", "SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 50")
def l3(t):
    return R.limited(t.documents.where("lang = 'de'").select("doc_id"), 50, "doc_id")


@query("l4_seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents")
def l4(t):
    from .operators.ranks import with_position

    return with_position(t.documents.select("doc_id"), R.seeded_order(42, "doc_id"), "doc_id")


@query("l5_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= CAST(floor((SELECT count(*) FROM documents) * 0.9) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM documents")
def l5(t):
    return R.split_by_hash(t.documents.select("doc_id"), "doc_id")


@query("l5_split_shuffled")
def l5b(t):
    return R.split_by_shuffle(t.documents.select("doc_id"), "doc_id")


@query("l6_id_range", "SELECT doc_id FROM documents WHERE doc_id BETWEEN 100 AND 300")
def l6(t):
    return t.documents.where(F.col("doc_id").between(100, 300)).select("doc_id")


@query("l7_head_per_sheet", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def l7(t):
    return R.first_k(t.documents.select("source", "doc_id"), 5, ["source"], "doc_id")


@query("l8_trainer_view", "WITH d AS (SELECT doc_id, n_chars > 2048 AS cut FROM documents ORDER BY doc_id LIMIT 150) SELECT doc_id, cut, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= CAST(floor((SELECT count(*) FROM d) * 0.95) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM d")
def l8(t):
    return P.trainer_view(t.documents.select("doc_id", "n_chars"), F.col("n_chars"), 150, 2048, 0.05, "doc_id").select("doc_id", "cut", "split")


# -- sets ------------------------------------------------------------------------------------------------------------


@query("u1_union_all", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def u1(t):
    return C.merged(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))


@query("u2_union_sheets", "SELECT 'region' AS __sheet__, r_regionkey AS k, r_name AS name, CAST(NULL AS INTEGER) AS region FROM region UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey FROM nation")
def u2(t):
    return R.union_sheets({"region": t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), "nation": t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))})


@query("u3_distinct", "SELECT DISTINCT lang, source FROM documents")
def u3(t):
    return t.documents.select("lang", "source").distinct()


@query("u4_key_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("u5_drop_empty", "SELECT doc_id FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id END AS doc_id FROM documents) WHERE doc_id IS NOT NULL")
def u5(t):
    return R.drop_empty(t.documents.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("never")))


# -- builders --------------------------------------------------------------------------------------------------------


def _marked(t: Tables) -> DataFrame:
    chat = F.concat(F.lit("USER: ask "), F.col("event_id").cast("string"), F.lit("\n\n\nASSISTANT: <functioncall> "), "props", F.lit(" <|endoftext|>\n\n\nFUNCTION RESPONSE: ok\n\n\nASSISTANT: plain words"))
    return t.events.select(F.col("event_id").alias("position"), F.lit("SYSTEM: help").alias("system"), chat.alias("chat"))


@query("c1_marked_tool_calls", """SELECT event_id AS position, 1 AS turn, [{'role': 'system', 'content': 'help'}, {'role': 'user', 'content': 'ask ' || event_id}, {'role': 'assistant', 'content': props}] AS messages FROM events""", flat=("messages", "role", "content"))
def c1(t):
    clean = _marked(t).withColumn("chat", F.replace("chat", F.lit("FUNCTION RESPONSE: ok"), F.lit("")))
    return C.convert_marked(clean)


@query("c2_tool_calls", """SELECT event_id AS position, 1 AS turn, [{'role': 'user', 'content': 'ask'}, {'role': 'assistant', 'content': '{"k": ' || json_extract(props, '$.k') || '}'}] AS messages FROM events WHERE event_id % 2 = 0""", flat=("messages", "role", "content"))
def c2(t):
    call = F.concat(F.lit("<tool_call>"), "props", F.lit("</tool_call>"))
    conv = X.sharegpt(("human", F.lit("ask")), ("gpt", F.when(F.col("event_id") % 2 == 0, call).otherwise(F.concat(call, call))))
    return C.convert_tool_calls(t.events.select(F.col("event_id").alias("position"), conv.alias("conversations")))


@query("c3_paragraph_sft", """SELECT [{'from': 'system', 'value': 'help'}, {'from': 'human', 'value': 'ask ' || event_id}, {'from': 'gpt', 'value': '<functioncall> ' || props}, {'from': 'observation', 'value': 'ok'}, {'from': 'gpt', 'value': 'plain words'}] AS conversations FROM events""", flat=("conversations", "from", "value"))
def c3(t):
    return C.paragraph_conversations(_marked(t))


@query("c4_tool_sft", """SELECT [{'from': 'human', 'value': 'ask'}, {'from': 'gpt', 'value': props}] AS conversations FROM events WHERE event_id % 2 = 0""", flat=("conversations", "from", "value"))
def c4(t):
    conv = F.when(F.col("event_id") % 2 == 0, X.sharegpt(("human", F.lit("ask")), ("gpt", F.col("props")))).otherwise(X.sharegpt(("human", F.lit("ask"))))
    return C.tool_conversations(t.events.select(F.col("event_id").alias("position"), conv.alias("conversations")))


def _schemas(t: Tables) -> DataFrame:
    schema = F.when(F.col("event_id") % 5 == 0, '{"type":"object"}').otherwise(F.format_string('{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":%d}}}', F.get_json_object("props", "$.k").cast("int")))
    return t.events.select(schema.alias("json_schema"), F.col("event_id").alias("unique_id"))


_SCHEMA_SQL = """'{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":' || json_extract(props, '$.k') || '}}}'"""


@query("c5_schema_prompts", f"""SELECT [{{'role': 'system', 'content': 'be brief'}}, {{'role': 'user', 'content': 'Schema: ' || s}}] AS prompt, s AS schema_str, event_id AS unique_id FROM (SELECT event_id, {_SCHEMA_SQL} AS s FROM events WHERE event_id % 5 <> 0)""", flat=("prompt", "role", "content"))
def c5(t):
    return P.schema_prompts(_schemas(t), "be brief", "Schema: {schema}")


@query("c6_minimal_answers", f"""SELECT [{{'from': 'system', 'value': 'be brief'}}, {{'from': 'human', 'value': {_SCHEMA_SQL}}}, {{'from': 'gpt', 'value': '{{"k": ' || json_extract(props, '$.k') || '}}'}}] AS conversations, event_id AS unique_id FROM events WHERE event_id % 5 <> 0""", flat=("conversations", "from", "value"))
def c6(t):
    return P.minimal_answers(_schemas(t), "be brief", None)


def _asked_sql(prompt: str) -> str:
    """Events with schema s, its minimal answer a, prompt p, and r: the stub spoils sample i (takes the last character from its answer) where r + i is a multiple of 3."""
    rows = f"""SELECT event_id, props, CASE WHEN event_id % 5 = 0 THEN '{{"type":"object"}}' ELSE {_SCHEMA_SQL} END AS s, CASE WHEN event_id % 5 = 0 THEN '{{}}' ELSE '{{"k": ' || json_extract(props, '$.k') || '}}' END AS a FROM events"""
    return f"(SELECT *, CAST(md5_number(p) % 3 AS INTEGER) AS r FROM (SELECT *, {prompt} AS p FROM ({rows})))"


_FENCED = "'```json' || chr(10) || {} || chr(10) || '```'"
_SPOILT = _FENCED.format("left(a, length(a) - 1)")
_PROMPT = "'Take it out.' || chr(10, 10) || '=== Report ===' || chr(10) || 'r' || chr(10, 10) || '=== JSON Schema ===' || chr(10) || s".replace("chr(10, 10)", "chr(10) || chr(10)")


def _flat_turns(df: DataFrame) -> DataFrame:
    """chosen and rejected as strings, which all engines compare alike."""
    return df.withColumns({c: F.concat(F.col(c)["from"], F.lit("="), F.col(c)["value"]) for c in ("chosen", "rejected")})


@query("c7_schema_pairs", f"""SELECT [{{'from': 'human', 'value': p}}] AS conversations, 'gpt=' || {_FENCED.format('a')} AS chosen, 'gpt=' || {_SPOILT} AS rejected, event_id AS _unique_id
FROM {_asked_sql("'=== JSON Schema ===' || chr(10) || s")} WHERE event_id % 5 <> 0""", flat=("conversations", "from", "value"))
def c7(t):
    return _flat_turns(P.schema_pairs(_schemas(t), StubProvider, most=None))


def _prompts(t: Tables) -> DataFrame:
    s = _schemas(t)
    return s.select(F.col("unique_id").cast("string").alias("stem"), F.concat(F.lit("Take it out.\n\n=== Report ===\nr\n\n=== JSON Schema ===\n"), "json_schema").alias("user_prompt"))


@query("c8_rejection_sampling", f"""SELECT [{{'from': 'human', 'value': p}}, {{'from': 'gpt', 'value': '=== JSON ===' || chr(10) || a || chr(10) || '=== JSON_SCHEMA ===' || chr(10) || s}}] AS conversations, CAST(event_id AS VARCHAR) AS _stem
FROM {_asked_sql(_PROMPT)}, range(4) AS samples(i) WHERE (r + i) % 3 <> 0""", flat=("conversations", "from", "value"))
def c8(t):
    return P.rejection_sampled(_prompts(t), lambda: StubProvider(sections=True))


def _gold(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = _schemas(t)
    gold = t.events.where("event_id % 3 <> 0").select(F.col("event_id").cast("string").alias("stem"), F.col("props").alias("gold_json"))
    return gold, s.select(F.col("unique_id").cast("string").alias("stem"), "json_schema")


@query("c9_preference_pairs", f"""SELECT [{{'from': 'human', 'value': p}}] AS conversations, 'gpt={{' || chr(10) || '  "k": ' || json_extract(props, '$.k') || chr(10) || '}}' AS chosen, 'gpt=' || {_SPOILT} AS rejected, CAST(event_id AS VARCHAR) AS _stem
FROM {_asked_sql(_PROMPT)}, range(8) AS samples(i) WHERE event_id % 3 <> 0 AND (r + i) % 3 = 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY i) <= 3""", flat=("conversations", "from", "value"))
def c9(t):
    return _flat_turns(P.preference_pairs(_prompts(t), *_gold(t), StubProvider)[0])


@query("c9_preference_ledger", "SELECT CAST(event_id AS VARCHAR) AS stem, 'accepted' AS status FROM events WHERE event_id % 3 <> 0")
def c9b(t):
    return P.preference_pairs(_prompts(t), *_gold(t), StubProvider)[1]


@query("c10_synthesis", """WITH d AS (SELECT doc_id, text || chr(10) || '=== JSON Schema ===' || chr(10) || '{"type":"object","required":["a"],"properties":{"a":{"type":"string"}}}' AS text FROM documents),
r AS (SELECT doc_id, md5_number('Report: =======INPUT MARKDOWN======' || text) % 3 = 0 AS spoilt_report, md5_number('JSON: =======INPUT MARKDOWN======' || text) % 3 = 0 AS spoilt FROM d)
SELECT 'data_' || (doc_id + 41000) AS stem, '=== JSON ===' || chr(10) || '{"a": "a"' || CASE WHEN spoilt_report THEN '' ELSE '}' END || chr(10) || '=== JSON_SCHEMA ===' || chr(10) || '{"type":"object","required":["a"],"properties":{"a":{"type":"string"}}}' AS report,
  CASE WHEN NOT spoilt THEN concat_ws(chr(10), '{', '  "a": "a"', '}') END AS json,
  CASE WHEN NOT spoilt THEN concat_ws(chr(10), '{', '  "type": "object",', '  "required": [', '    "a"', '  ],', '  "properties": {', '    "a": {', '      "type": "string"', '    }', '  }', '}') END AS json_schema,
  CASE WHEN spoilt THEN 'no_sections' ELSE 'ok' END AS status FROM r""")
def c10(t):
    rows = t.documents.select(F.format_string("data_%d", F.col("doc_id") + 41_000).alias("stem"), F.concat("text", F.lit('\n=== JSON Schema ===\n{"type":"object","required":["a"],"properties":{"a":{"type":"string"}}}')).alias("text"))
    return P.synthesis(rows, "Report: ", "JSON: ", lambda: StubProvider(sections=True))


@query("c11_prompt_synthesis", """SELECT 'data_' || doc_id AS stem, '```json' || chr(10) || '{' || CASE WHEN md5_number(CASE WHEN doc_id >= 20000 THEN 'Ask: ' ELSE '질문: ' END || text) % 3 = 0 THEN '' ELSE '}' END || chr(10) || '```' || chr(10) || chr(10)
  || '=== Report ===' || chr(10) || text || chr(10) || chr(10) || '=== JSON Schema ===' || chr(10) || concat_ws(chr(10), '{', '  "type": "object"', '}') AS user_prompt
FROM documents JOIN labels USING (doc_id) WHERE doc_id > 0""")
def c11(t):
    reports = t.documents.select(F.format_string("data_%d", F.col("doc_id")).alias("stem"), F.col("text").alias("report"))
    schemas = t.labels.select(F.format_string("data_%d", F.col("doc_id")).alias("stem"), F.lit('{"type":"object"}').alias("json_schema"))
    return P.prompt_synthesis(reports, schemas, reports.where("stem < 'data_1'").select("stem"), "Ask: ", "질문: ", StubProvider)


@query("c12_training_split", """SELECT doc_id AS stem, [{'role': 'system', 'content': 'sys'}, {'role': 'user', 'content': source}, {'role': 'assistant', 'content': lang}] AS messages, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= CAST(floor((SELECT count(*) FROM labels) * 0.9) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id)""", flat=("messages", "role", "content"))
def c12(t):
    d = t.documents.withColumnRenamed("doc_id", "stem")
    return P.training_split(d.select("stem", F.col("source").alias("user_prompt")), t.labels.select(F.col("doc_id").alias("stem")), d.select("stem", F.col("lang").alias("gold_json")), "sys")


@query("c13_inference", f"""SELECT CAST(event_id AS VARCHAR) AS stem, p AS user_prompt, CASE WHEN event_id % 3 <> 0 THEN props ELSE '' END AS gold_json, s AS json_schema,
  '<think>0</think>' || chr(10) || CASE WHEN r = 0 THEN {_SPOILT} ELSE {_FENCED.format('a')} END AS raw_output, CASE WHEN r = 0 THEN '' ELSE a END AS pred_json FROM {_asked_sql(_PROMPT)}""")
def c13(t):
    gold, schemas = _gold(t)
    return P.inference(_prompts(t), gold, schemas, StubProvider)


@query("c15_pruned", r"SELECT doc_id AS id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) <= 500 AS kept FROM documents")
def c15(t):
    wide = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("user_prompt"))
    kept, long = P.pruned(wide, 500)
    return kept.select("id", F.lit(True).alias("kept")).union(long.select("id", F.lit(False).alias("kept")))


_QA_SQL = """WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole, arg_min(text, turn) FILTER (role = 'user') AS first_user, count(*) FILTER (role = 'user') AS users,
  count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (trim(text) = '') AS blanks FROM (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN ' ' WHEN role = 'assistant' AND turn % 2 = 1 THEN '{"turn": ' || turn || '}' ELSE text END AS text FROM conversations) GROUP BY conv_id),
a AS (SELECT conv_id, arg_min(turn, turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
n AS (SELECT *, len(regexp_extract_all(whole, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS tokens FROM c)
SELECT count(*) AS n, CAST(sum((users = 0)::INT + (assistants = 0)::INT + blanks) AS BIGINT) AS format_errors, count(a.turn) FILTER (a.turn % 3 = 2 OR a.turn % 2 = 0) AS json_errors,
  count(*) - count(DISTINCT coalesce(first_user, '')) AS duplicates, count(*) FILTER (tokens <= 500) AS fits, count(*) FILTER (tokens > 500) AS exceeds,
  CAST(floor(quantile_cont(tokens, 0.9)) AS BIGINT) AS cutoff_p90, CAST(floor(quantile_cont(tokens, 0.95)) AS BIGINT) AS cutoff_p95, CAST(floor(quantile_cont(tokens, 0.99)) AS BIGINT) AS cutoff_p99
FROM n LEFT JOIN a USING (conv_id)"""


@query("c16_dataset_checks", _QA_SQL)
def c16(t):
    answer = (F.col("role") == "assistant") & (F.col("turn") % 2 == 1)
    text = F.when(F.col("turn") % 3 == 2, " ").when(answer, F.format_string('{"turn": %d}', "turn")).otherwise(F.col("text"))
    return P.dataset_checks(C.to_messages(t.conversations.withColumn("text", text)), cutoff=500)


@query("p16_markdown", """WITH w AS (SELECT greatest(5, max(length(CAST(n_nationkey AS VARCHAR)))) AS k, greatest(6, max(length(n_name))) AS n FROM nation)
SELECT 'book' AS file, '## Sheet: nations' || chr(10) || chr(10) || '| ' || lpad('key', (SELECT CAST(k AS INTEGER) FROM w), ' ') || ' | ' || rpad('name', (SELECT CAST(n AS INTEGER) FROM w), ' ') || ' |' || chr(10)
  || '|' || repeat('-', (SELECT k + 1 FROM w)) || ':|:' || repeat('-', (SELECT n + 1 FROM w)) || '|' || chr(10)
  || string_agg('| ' || lpad(CAST(n_nationkey AS VARCHAR), (SELECT CAST(k AS INTEGER) FROM w), ' ') || ' | ' || rpad(n_name, (SELECT CAST(n AS INTEGER) FROM w), ' ') || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation""")
def p16(t):
    rows = t.nation.select(F.lit("book").alias("file"), F.lit("nations").alias("sheet"), F.lit(0).alias("sheet_idx"), F.col("n_nationkey").alias("row_idx"), F.explode(F.array(F.struct(F.lit(0).alias("col_idx"), F.lit("key").alias("col_name"), F.col("n_nationkey").cast("string").alias("value")), F.struct(F.lit(1).alias("col_idx"), F.lit("name").alias("col_name"), F.col("n_name").alias("value")))).alias("c"))
    return H.workbook_markdown(rows.select("file", "sheet", "sheet_idx", "row_idx", "c.*"))


from . import file_queries  # noqa: E402, F401  (registers its queries with the decorator above)
