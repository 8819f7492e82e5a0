"""URL rules by a sort-merge range join (DataFrame functions only).

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's.
Each url gives one key for each domain above it (no deeper than the deepest rule), written with the host
reversed (``com.example``); under such a key a rule is the interval of all paths that start with its own.
Urls and rules are dealt by key and sorted by path; a sweep carries the stack of rules that enclose the last
rule seen. All rules that fit a path are on that stack, as a rule which sorts between a prefix of the path and
the path itself also starts with that prefix. Keys with much traffic are dealt over several tasks, with the
key's rules in each.

Cases: null urls and urls without ``://`` have an empty host and path; a rule without host fits nothing, one
without path fits every path; of rules with one host and path the greatest verdict (block) holds; the longest
rule wins, of equally long ones that with the longer host. Repeated rows each get their row. No urls give no
rows, no rules the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, partitions


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _key(labels: Column, depth: Column) -> Column:
    """The last labels of a host, as many as depth says, reversed and joined."""
    return F.array_join(F.slice(F.reverse(labels), F.lit(1), depth), ".")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (), default: str = "allow") -> DataFrame:
    """A row for each page: the kept columns, then host, path, rule (host and path of the one that holds), verdict."""
    spark = pages.sparkSession
    rules = (
        rules.where(F.col("host").isNotNull())
        .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", F.split("host", "\\."))
    )
    deepest = rules.agg(F.max(F.size("labels"))).first()[0] or 1
    rules = rules.select(_key(F.col("labels"), F.size("labels")).alias("key"), "host", "path", "verdict")
    # The stack of a rule: the rules of its host whose paths its own starts with, itself last.
    starts = rules.select("key", F.col("path").alias("under"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).withColumn("path", F.substring("under", F.lit(1), F.col("n")))
    stacks = (
        starts.join(rules, ["key", "path"])
        .groupBy("key", F.col("under").alias("path"))
        .agg(F.array_sort(F.collect_list(F.struct(F.length("path").alias("n"), "path", "host", "verdict"))).alias("stack"))
    )

    rows = pages.select(F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(None).alias("kept"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", "\\.")
    keys = rows.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: _key(labels, n))))

    # At most 2 * parts keys can hold more than that share of all, so what is broadcast here is bounded.
    parts = partitions(spark)
    counts = keys.groupBy("key").count()
    share = max(1.0, (counts.agg(F.sum("count")).first()[0] or 0) / (2.0 * parts))
    hot = F.broadcast(counts.where(F.col("count") > share).select("key", F.ceil(F.col("count") / share).cast("int").alias("spread")))
    spread = F.coalesce("spread", F.lit(1))
    events = keys.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("row"), spread).cast("int").alias("part"), "path", F.lit(1).alias("kind"), "row", "host", "kept", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    bounds = stacks.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), spread - 1)).alias("part"), "path", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("host"), F.lit(None).cast(rows.schema["kept"].dataType).alias("kept"), "stack")
    sweep = Window.partitionBy("key", "part").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.unionByName(bounds).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    path = F.col("path")
    top = F.try_element_at(F.filter("stack", lambda r: path.startswith(r["path"])), F.lit(-1))
    best = F.when(top.isNotNull(), F.struct((top["n"] + F.length(top["host"])).alias("n"), F.length(top["host"]).alias("of_host"), F.concat(top["host"], top["path"]).alias("rule"), top["verdict"].alias("verdict")))
    out = swept.select("row", "host", "path", "kept", best.alias("best")).groupBy("row").agg(F.first("kept").alias("kept"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
