import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.functions import text as X
from tessera.operators import chat as C
from tessera.plans import pipelines as P

N = 700


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("events")
    spark.range(N).selectExpr("id as event_id", """concat('{"k": ', id % 100, '}') as props""").write.parquet(str(d / "events.parquet"))
    return str(d)


def _schema(i):
    return '{"type":"object"}' if i % 5 == 0 else '{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":%d}}}' % (i % 100)


def _spoilt(i, s, head="Take it out.\n\n=== Report ===\nr\n\n=== JSON Schema ===\n"):
    """Whether the stub spoils this sample: every third, from a place that hangs on the prompt."""
    return (int(hashlib.md5((head + _schema(i)).encode()).hexdigest(), 16) + s) % 3 == 0


def _stems(df, c="_stem"):
    return Counter(int(r[c]) for r in df.collect())


#: Events whose prompts the queries build: all, those with bare schemas too.
PROMPTS = range(N)


def test_rejection_sampling_takes_all(spark, events):
    got = _stems(Q.QUERIES["c8_rejection_sampling"](spark, events))
    assert got == Counter({i: sum(not _spoilt(i, s) for s in range(4)) for i in PROMPTS})


def test_preference_pairs_take_all_shards(spark, events):
    got = _stems(Q.QUERIES["c9_preference_pairs"](spark, events))
    assert got == Counter({i: min(3, sum(_spoilt(i, s) for s in range(8))) for i in PROMPTS if i % 3})


def test_ledger_has_all(spark, events):
    rows = Q.QUERIES["c9_preference_ledger"](spark, events).collect()
    assert sorted((int(r["stem"]), r["status"]) for r in rows) == [(i, "accepted") for i in PROMPTS if i % 3]


def test_schema_pairs_take_all(spark, events):
    got = _stems(Q.QUERIES["c7_schema_pairs"](spark, events), "_unique_id")
    bad = {i: sum(_spoilt(i, s, "=== JSON Schema ===\n") for s in range(4)) for i in range(N) if i % 5}
    assert got == Counter(i for i, n in bad.items() if 0 < n < 4)


def test_inference_has_all(spark, events):
    rows = Q.QUERIES["c13_inference"](spark, events).collect()
    parsed = {int(r["stem"]): r["pred_json"] != "" for r in rows}
    assert len(rows) == N and parsed == {i: not _spoilt(i, 0) for i in PROMPTS}


def test_limits_of_the_builders(spark, events):
    t = Q.Tables(spark, events)
    assert [r["position"] for r in C.convert_marked(Q._marked(t), 3).collect()] == [0, 1, 2]
    assert [r["position"] for r in C.convert_tool_calls(_calls(t), 3).collect()] == [0, 1, 2]
    seeded = sorted(range(N), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:3]
    got = C.paragraph_conversations(Q._marked(t), 3).collect()
    assert sorted(r["conversations"][1]["value"] for r in got) == sorted(f"ask {i}" for i in seeded)
    assert C.tool_conversations(_calls(t), 3).count() == 3
    assert [r["unique_id"] for r in P.minimal_answers(Q._schemas(t), "be brief", 3).collect()] == [1, 2, 3]


def _calls(t):
    conv = X.sharegpt(("human", F.lit("ask")), ("gpt", F.concat(F.lit("<tool_call>"), "props", F.lit("</tool_call>"))))
    return t.events.select(F.col("event_id").alias("position"), conv.alias("conversations"))
