import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix, mixed_documents, source_targets
from tessera.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def water_filled(sizes):
    """Targets by the words of the contract: shares by weight, capped at three sizes, the excess shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 100}, {"a": 0, "b": 7}, {"x": 1, "y": 1, "z": 1, "é": 1}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(water_filled(sizes))


def test_query(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_mixing"](spark, sf).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(WORDS.findall(docs[r["doc_id"]]["text"] or "")) and r["taken"] <= 3 * r["size"]
        sizes[docs[r["doc_id"]]["source"]] += r["size"]
    target = water_filled(sizes)
    for s in sizes:
        own = [r for r in rows if docs[r["doc_id"]]["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own)


def test_reruns_agree_and_levels(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(0), F.col("id") % 17)).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("big")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    take = lambda d: sorted((r["doc_id"], r["copies"]) for r in mix(d, fan_in=16).collect())
    a = take(docs)
    assert a == take(docs.repartition(7, "text")) and len(a) == 3000
    out = mix(docs, fan_in=16).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 17 for r in out)


def test_odd_documents(odd, none):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["copies"] <= 3 for r in rows)
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns
    due = Counter()
    for r in mix(odd.withColumn("k", F.xxhash64("doc_id", "text", "source")), key=("k",)).collect():
        due[r["k"]] += r["copies"]
    got = Counter(r["k"] for r in mixed.select(F.xxhash64("doc_id", "text", "source").alias("k")).collect())
    assert got == +due
