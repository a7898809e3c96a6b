"""The replay of answers, and tables that are published together."""

import pytest
from pyspark.sql import functions as F

from quern.operators import answerlog
from quern.operators.policy import Denied
from quern.sources import shared
from quern.sources.snapshots import Snapshots

STEP = "struct<step:string,hits:bigint,score:double,reasons:string>"


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "T1", "t-1", "why", False, "agentic", "high"), (2, "T2", "t-2", "how", True, "agentic", "low"), (3, "T1", "t-3", "who", False, "single", "high")]
    answers = spark.createDataFrame(rows, "insight_id int, tenant_id string, thread_id string, question string, degraded boolean, strategy string, confidence string")
    step = lambda name, hits, score, reasons: F.struct(F.lit(name).alias("step"), F.lit(hits).cast("long").alias("hits"), F.lit(score).cast("double").alias("score"), F.lit(reasons).cast("string").alias("reasons"))
    steps = F.array(step("plan", None, None, "x"), step("judge", 3, 0.5, None)).cast(f"array<{STEP}>")
    none = F.array().cast(f"array<{STEP}>")
    calls = F.array(answerlog.call(F.lit("query_metric"), F.lit("agentic"), F.lit("m"), steps), answerlog.call(F.lit("search_kb"), F.col("strategy"), F.col("question"), steps), answerlog.call(F.lit("search_kb"), F.lit("agentic"), F.lit("again"), F.when(F.col("insight_id") == 2, steps).otherwise(none)))
    path = shared.new_path(spark, "log")
    answerlog.logged(answers, calls).write.parquet(path)
    return spark.read.parquet(path)


def test_rounds_come_back_from_the_log(log):
    assert log.schema["tool_trace"].dataType.typeName() == "variant"
    rows = sorted(tuple(r) for r in answerlog.replayed(log, "admin").select("insight_id", "call", "query", "place", "step", F.coalesce("hits", F.lit(-1)), F.coalesce("score", F.lit(-1.0))).collect())
    two = lambda i, c, q: [(i, c, q, 0, "plan", -1, -1.0), (i, c, q, 1, "judge", 3, 0.5)]
    assert rows == two(1, 1, "why") + two(2, 1, "how") + two(2, 2, "again")  # neither other tools, nor single searches, nor empty traces


def test_a_brand_sees_its_own_answers_only(log):
    assert {r.insight_id for r in answerlog.replayed(log, "brand", "T1").collect()} == {1}
    assert [r.insight_id for r in answerlog.recent(log, 5, "brand", "T1").collect()] == [3, 1]
    assert [r.insight_id for r in answerlog.recent(log, 2, "admin").collect()] == [3, 2]
    for role, own, asked in (("brand", "T1", "T2"), ("ops", None, None), ("guest", None, "T1")):
        with pytest.raises(Denied):
            answerlog.replayed(log, role, own, asked)


def test_tables_are_published_together(spark):
    shots = Snapshots(spark, shared.new_path(spark, "snapshots"))
    assert shots.latest() is None
    one, two = spark.range(3), spark.range(5)
    first = shots.published({"a": one, "b": one})
    bad = spark.range(1).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):  # fails between two writes
        shots.published({"a": two, "b": bad})
    now = shots.latest()
    assert now.version == 0 and now.table("a").count() == 3 and now.table("b").count() == 3
    second = shots.published({"a": two})
    assert second.version == 1 and second.table("a").count() == 5 and second.table("b").count() == 3
    assert first.table("a").count() == 3 and Snapshots(spark.newSession(), shots.path).latest().paths == second.paths
