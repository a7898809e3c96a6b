"""The nightly chain: cleaned tables, rollups, the quality gate, metrics, knowledge chunks."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quern.operators import checks, retrieval
from quern.plans import dag
from quern.plans.warehouse import END, START, Detail
from quern.sources.sinks import overwrite, overwrite_tenants


def nightly(spark: SparkSession, sf_dir: str, out: str, least_rate: float = 0.99, action: str = "degraded") -> dag.Outcome:
    """Writes all layers under ``out``.

    Where the quality rules' overall pass rate is below ``least_rate``, metrics
    are written all the same (action ``degraded``, which is their step's result),
    left as they were (``skip``) or held back until someone decides (``hold``,
    which fails their step).
    """
    if action not in ("degraded", "skip", "hold"):
        raise ValueError(f"unknown action {action}")
    d = Detail(spark, sf_dir)
    table = lambda name: spark.read.parquet(f"{out}/{name}")

    def write(name: str, build, *partitions: str):
        return dag.Step(name, lambda _: overwrite(build(), f"{out}/{name}", *partitions))

    def gate(_):
        found = checks.results({"raw_order": d.raw_order(), "raw_refund": checks.with_order_max(d.raw_refund(), d.raw_order()), "dwd_order": d.dwd_order_sku()})
        overwrite(found, f"{out}/dq_result")
        rate = checks.summary(table("dq_result")).first().overall_pass_rate
        return "pass" if rate is None or rate >= least_rate else action

    def metrics(results):
        verdict = results["dq_result"]
        if verdict == "hold":
            raise dag.Fatal("held back by the quality gate")
        if verdict == "skip":
            return verdict
        from quern.operators.metrics import Engine

        engine = Engine({n: table(n) for n in ("dwd_order", "dwd_refund", "dwd_cs_session")})
        overwrite_tenants(engine.materialized(START, END), f"{out}/metric_result")
        return verdict

    steps = [write("dwd_order", d.dwd_order), write("dwd_cs_session", d.dwd_cs_session), write("dwd_refund", d.dwd_refund), write("dws_shop_day", d.shop_day), dag.Step("dq_result", gate), dag.Step("metric_result", metrics), write("kb_chunk", lambda: retrieval.chunked(d.kb_document()), "tenant_id")]
    after = {"dwd_refund": ("dwd_order",), "dws_shop_day": ("dwd_order", "dwd_refund", "dwd_cs_session"), "dq_result": ("dwd_order",), "metric_result": ("dws_shop_day", "dq_result")}
    for s in steps:
        s.after = after.get(s.name, ())
    return dag.run(steps)
