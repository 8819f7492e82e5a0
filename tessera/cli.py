"""Command line: ``python -m tessera.cli COMMAND``; each command is a function of the engine over files, with its defaults."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import approx_tokens
from .functions.udfs import token_counter, trivial_reason
from .operators import relational as R
from .operators.chat import convert_marked, convert_tool_calls, format_errors, merged, paragraph_conversations, tool_conversations
from .operators.sheets import workbook_markdown
from .operators.stats import audited, fill_ratio, length_stats, outcomes
from .plans import pipelines as P
from .plans.provider import named
from .session import local_session
from .sources import readers, sinks
from .sources.xlsx import XlsxSource, list_files
from .streaming.resume import resume

ROWS = "stem string, user_prompt string, gold_json string, json_schema string, raw_output string, pred_json string"
SCHEMAS = "json_schema string, unique_id string"


def counter(vocabulary: str | None):
    """Counts tokens by a vocabulary file, or approximately."""
    return token_counter(vocabulary) if vocabulary else approx_tokens


def show(df: DataFrame) -> None:
    for r in df.toJSON().toLocalIterator():
        print(r)


def evaluate(spark: SparkSession, a) -> None:
    scored, total = P.evaluation(readers.jsonl(spark, a.input, ROWS), named(a.llm) if a.llm else None)
    if a.rows:
        sinks.write_jsonl(scored, a.rows)
    sinks.write_workbook({"Sheet1": scored}, a.output, cut=True)
    show(total)


def lengths(spark: SparkSession, a) -> None:
    texts = readers.artifacts(spark, a.input)
    show(length_stats(texts, counter(a.tokenizer)(F.col("value"))))


def split(spark: SparkSession, a) -> None:
    stems = readers.artifacts(spark, a.input).select("stem", "file_name")
    parts = R.split_by_shuffle(stems, "file_name", seed=a.seed) if a.exact else R.split_by_hash(stems, "stem", seed=a.seed)
    sinks.write_list(parts.where("split = 'test'"), a.output)
    show(outcomes(parts, "split"))


def prune(spark: SparkSession, a) -> None:
    kept, long = P.pruned(readers.wide(spark, a.input), a.max_tokens, counter(a.tokenizer))
    plan = sinks.deletion_plan(long.select(F.col("id").alias("stem")), a.input, readers.ARTIFACTS, f"over {a.max_tokens} tokens")
    for path in sinks.apply_deletions(plan, a.dry_run)[:20]:
        print(path)
    if a.output:
        kept.write.mode("overwrite").parquet(a.output)


def audit(spark: SparkSession, a) -> None:
    values = readers.artifacts(spark, a.json_dir, ".json", "json").drop("file_name")
    schemas = readers.artifacts(spark, a.schema_dir, ".json", "json_schema").drop("file_name")
    out = audited(values, schemas).cache()
    show(out.where("status <> 'valid'"))
    show(outcomes(out))
    whole = {a.json_dir: ".json", a.schema_dir: ".json", a.report_dir: ".txt", a.user_prompt_dir: ".txt"}
    for status, wanted, folders in (("invalid", a.delete_invalid, whole), ("missing_schema", a.delete_missing, {a.json_dir: ".json"})):
        if wanted:
            plan = sinks.deletion_plan(out.where(F.col("status") == status), ".", {os.path.abspath(f): ext for f, ext in folders.items() if f}, status)
            for path in sinks.apply_deletions(plan.withColumn("path", F.substr("path", F.lit(3))), a.dry_run):
                print(path)
    out.unpersist()


def number(spark: SparkSession, a) -> None:
    stems = R.all_keys("stem", *[readers.artifacts(spark, d, a.extension).select("stem") for d in a.folders])
    show(R.numbered(stems, a.prefix, "stem"))


def export(spark: SparkSession, a) -> None:
    sinks.write_per_stem(spark.read.parquet(a.input), a.output, readers.ARTIFACTS).count()


def collect(spark: SparkSession, a) -> None:
    readers.wide(spark, a.input).write.mode("overwrite").parquet(a.output)


def schema_sets(spark: SparkSession, a) -> None:
    rows = readers.jsonl(spark, a.input, SCHEMAS, strict=False)
    made = {"prompts": lambda: P.schema_prompts(rows, a.system, most_tokens=None if a.no_token_filter else a.max_tokens, count=counter(a.tokenizer)), "answers": lambda: P.minimal_answers(rows, a.system, a.num), "pairs": lambda: P.schema_pairs(rows, named(a.provider), most=a.num)}[a.kind]()
    sinks.write_jsonl(made, a.output)
    show(outcomes(rows.withColumn("status", F.coalesce(trivial_reason("json_schema"), F.lit("kept")))))


def tool_calls(spark: SparkSession, a) -> None:
    position = F.monotonically_increasing_id().alias("position")
    marked = readers.jsonl(spark, a.marked, "system string, chat string").select(position, "*")
    turns = readers.jsonl(spark, a.turns, "conversations array<struct<`from`:string,value:string>>").select(position, "*")
    if a.sft:
        out = merged(paragraph_conversations(marked, a.num_marked, a.seed), tool_conversations(turns, a.num_turns, a.seed))
    else:
        out = merged(convert_marked(marked, a.num_marked).select("messages"), convert_tool_calls(turns, a.num_turns).select("messages"))
    if a.existing:
        out = merged(spark.read.schema(out.schema).option("multiLine", "true").json(a.existing), out, merge=not a.no_merge)
    print(sinks.write_json_array(out, a.output))


def check(spark: SparkSession, a) -> None:
    rows = readers.json_array(spark, a.data, "messages array<struct<role:string,content:string>>").withColumn("conv_id", F.monotonically_increasing_id())
    errors = format_errors(rows)
    show(errors.limit(10))
    show(P.dataset_checks(rows, a.cutoff, counter(a.tokenizer)))


def sparse(spark: SparkSession, a) -> None:
    spark.dataSource.register(XlsxSource)
    files = spark.createDataFrame([(f,) for f in list_files(a.input)], "file string")
    show(fill_ratio(spark.read.format("xlsx").load(a.input), files, a.threshold).orderBy("ratio"))


def to_workbook(spark: SparkSession, a) -> None:
    if a.each:
        print(*sinks.parquet_to_workbooks(spark, a.input, a.output), sep="\n")
    else:
        sinks.write_workbook({"Sheet1": readers.parquet(spark, a.input)}, a.output)


def sheet_texts(spark: SparkSession, path: str, a) -> DataFrame:
    """(file, text): the Markdown of a workbook or of all below a folder."""
    spark.dataSource.register(XlsxSource)
    return workbook_markdown(spark.read.format("xlsx").load(path), a.max_chars, a.max_rows)


def markdown(spark: SparkSession, a) -> None:
    print(sinks.write_markdown(sheet_texts(spark, a.input, a), a.output).count())


def split_sheets(spark: SparkSession, a) -> None:
    spark.dataSource.register(XlsxSource)
    show(sinks.sheets_to_workbooks(spark.read.format("xlsx").load(a.input), a.output))


def rename(spark: SparkSession, a) -> None:
    files = readers.workbook_files(spark, a.input, (".xlsx",))
    for old, new in sinks.apply_renames(sinks.rename_plan(files, a.prefix, a.start), not a.apply):
        print(old, "->", new)


def store(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prompts, gold and schemas of a folder of artifacts, those of the split only where a list of held-out stems is given."""
    read = lambda folder, extension, name: readers.artifacts(spark, f"{a.input}/{folder}", extension, name).drop("file_name")
    prompts = read("user_prompt", ".txt", "user_prompt")
    if a.test_list:
        prompts = R.of_split(prompts, spark.read.text(a.test_list).toDF("stem"), a.split)
    return prompts, read("json", ".json", "gold_json"), read("json_schema", ".json", "json_schema")


def infer(spark: SparkSession, a) -> None:
    prompts, gold, schemas = store(spark, a)
    rows = P.inference(prompts, gold, schemas, named(a.provider), a.system)
    if a.workbook:
        sinks.write_dual(rows, a.output, a.workbook)
    else:
        sinks.write_jsonl(rows, a.output, append=True)


def rejection_samples(spark: SparkSession, a) -> None:
    def work(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        made = P.rejection_sampled(rows, named(a.provider), a.num_samples).cache()
        return made, made.select(F.col("_stem").alias("stem")).distinct()

    resume(R.limited(store(spark, a)[0], a.max_prompts or None, "stem"), f"{a.output}.ledger", "stem", work, a.output)


def preference_pairs(spark: SparkSession, a) -> None:
    prompts, gold, schemas = store(spark, a)
    rows = R.limited(R.having(prompts, gold, "stem"), a.max_prompts or None, "stem")
    rows = rows if a.num_shards == 1 else R.shard(rows, a.num_shards, a.shard_index, "stem")
    resume(rows, f"{a.output}.ledger", "stem", lambda r: P.preference_pairs(r, gold, schemas, named(a.provider), a.num_samples, a.max_pairs_per_prompt), a.output)


def synthesize(spark: SparkSession, a) -> None:
    texts = sheet_texts(spark, a.input, a)
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), "\\.[^.]*$", "")
    with open(a.report_prompt, encoding="utf-8") as one, open(a.json_prompt, encoding="utf-8") as two:
        made = P.synthesis(texts.select(stem.alias("stem"), "text"), one.read(), two.read(), named(a.provider), None if a.min_id < 0 else a.min_id, not a.no_validate).cache()
    sinks.write_triples(made, a.output).count()
    show(outcomes(made))
    made.unpersist()


def make_prompts(spark: SparkSession, a) -> None:
    read = lambda folder, extension, name: readers.artifacts(spark, f"{a.input}/{folder}", extension, name).drop("file_name")
    done = read("user_prompt", ".txt", "user_prompt") if os.path.isdir(f"{a.input}/user_prompt") else spark.createDataFrame([], "stem string")
    with open(a.english, encoding="utf-8") as one, open(a.korean, encoding="utf-8") as two:
        made = P.prompt_synthesis(read("report", ".txt", "report"), read("json_schema", ".json", "json_schema"), done, one.read(), two.read(), named(a.provider), a.min_id, a.max_id)
    print(sinks.write_per_stem(made, a.input, {"user_prompt": ".txt"}, "stem").count())


def training_view(spark: SparkSession, a) -> None:
    rows = spark.read.json(a.input)
    length = counter(a.tokenizer)(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    P.contracted(rows, a.contract, length, a.key).write.mode("overwrite").parquet(a.output)


def registry(spark: SparkSession, a) -> None:
    print(json.dumps(sinks.upsert_registry(a.path, a.name, sinks.registry_entry(a.file, a.kind, a.ranking)), ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    commands = p.add_subparsers(required=True)

    def add(f, *positional, **options):
        c = commands.add_parser(f.__name__.replace("_", "-"))
        for name in positional:
            c.add_argument(name, nargs="+" if name == "folders" else None)
        for name, default in options.items():
            flag = f"--{name.replace('_', '-')}"
            if isinstance(default, bool):
                c.add_argument(flag, action="store_true", default=default)
            else:
                c.add_argument(flag, default=default, type=type(default) if default is not None else str)
        c.set_defaults(run=f)

    add(evaluate, input=None, output="evaluation.xlsx", rows=None, llm=None)
    add(lengths, input=None, tokenizer=None)
    add(split, input=None, output="test_split.txt", seed=42, exact=False)
    add(prune, "input", max_tokens=8192, dry_run=False, output=None, tokenizer=None)
    add(audit, "json_dir", "schema_dir", report_dir=None, user_prompt_dir=None, delete_invalid=False, delete_missing=False, dry_run=False)
    chosen = {"provider": "stub", "split": "train", "test_list": None}
    add(infer, "input", "output", system="", workbook=None, **chosen | {"split": "all"})
    add(rejection_samples, "input", "output", num_samples=4, max_prompts=0, **chosen | {"provider": "stub-sections"})
    add(preference_pairs, "input", "output", num_samples=8, max_prompts=0, max_pairs_per_prompt=3, num_shards=1, shard_index=0, **chosen)
    add(synthesize, "input", "output", "report_prompt", "json_prompt", provider="stub-sections", min_id=41_000, no_validate=False, max_chars=300_000, max_rows=2000)
    add(make_prompts, "input", "english", "korean", provider="stub", min_id=0, max_id=10**9)
    add(training_view, "contract", "input", "output", key="_stem", tokenizer=None)
    add(markdown, "input", "output", max_chars=300_000, max_rows=2000)
    add(split_sheets, "input", "output")
    add(rename, "input", prefix="data_", start=1, apply=False)
    add(number, "folders", prefix="data", extension=".json")
    add(export, "input", "output")
    add(collect, "input", "output")
    add(schema_sets, "kind", "input", "output", system="", max_tokens=1024, num=2500, no_token_filter=False, tokenizer=None, provider="stub")
    add(tool_calls, "marked", "turns", "output", num_marked=5000, num_turns=2000, seed=42, existing=None, no_merge=False, sft=False)
    add(check, data=None, cutoff=8192, tokenizer=None)
    add(sparse, "input", threshold=0.6)
    add(to_workbook, "input", "output", each=False)
    add(registry, "path", "name", "file", kind="sharegpt", ranking=False)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.getActiveSession() or local_session(), a)


if __name__ == "__main__":
    main()
