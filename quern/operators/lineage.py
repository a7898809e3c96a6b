"""Lineage of tables and metrics as tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.metrics import DEFINITIONS, formula_parts
from quern.sources.shared import kept

#: What each task reads and writes: (task, sources, targets).
FLOWS = (
    ("dwd_orders", ("raw_order", "map_platform_sku"), ("dwd_order",)),
    ("dwd_refunds", ("raw_refund", "dwd_order"), ("dwd_refund",)),
    ("dwd_cs", ("raw_cs_session",), ("dwd_cs_session",)),
    ("dws", ("dwd_order", "dwd_refund", "dwd_cs_session", "dim_shop"), ("dws_shop_day", "dws_tenant_day")),
    ("quality", ("raw_order", "raw_refund", "dwd_order"), ("dq_result",)),
    ("kb_rebuild", ("kb_document",), ("kb_chunk",)),
    ("metrics", ("dwd_order", "dwd_refund", "dwd_cs_session"), ("metric_result",)),
)


def table_edges(spark: SparkSession) -> DataFrame:
    rows = [(s, t, task) for task, sources, targets in FLOWS for t in targets for s in sources]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "source string, target string, via string, place int")


def metric_edges(definitions: DataFrame) -> DataFrame:
    """Edges into each metric, by its latest version in force or not: from its table, or from the metrics of its formula."""
    latest = F.row_number().over(W.partitionBy("metric_code").orderBy(F.desc("effective_from"), F.desc("caliber_version")))
    once = definitions.withColumn("k", latest).where("k = 1")
    parts = F.regexp_extract_all("agg_expr", F.lit("([A-Z][A-Z0-9_]*)"), F.lit(1))
    sources = F.when(F.col("source_table") == "derived", F.array_distinct(parts)).otherwise(F.array("source_table"))
    return once.select(F.explode(sources).alias("source"), F.col("metric_code").alias("target"), F.concat(F.lit("metric "), "caliber_version").alias("via"))


def all_edges(spark: SparkSession, definitions: DataFrame) -> DataFrame:
    """Both kinds; of several edges between two nodes the first stays, by the order of the flows, those of metrics after them."""
    after = F.lit(len(FLOWS) * 1000)
    every = table_edges(spark).unionByName(metric_edges(definitions).withColumn("place", after))
    return every.groupBy("source", "target").agg(F.min(F.struct("place", "via")).alias("e")).select("source", "target", F.col("e.via").alias("via"))


def upstream(edges: DataFrame, node: str) -> DataFrame:
    """Every node that leads to ``node``, with its least distance; steps are taken until one finds nothing new."""
    found = edges.sparkSession.createDataFrame([(node, 0)], "node string, distance int")
    edge, k = found, 0
    while not edge.isEmpty():
        k += 1
        step = edges.join(edge, F.col("target") == F.col("node")).select(F.col("source").alias("node"), F.lit(k).alias("distance")).distinct()
        edge = kept(step.join(found.select("node"), "node", "left_anti"), "step")
        found = found.unionByName(edge)
    return found.where(F.col("node") != node)


def cyclic_metrics() -> list[str]:
    """Derived metrics that lead back to themselves."""
    parts = {m.code: formula_parts(m.formula) for m in DEFINITIONS if m.source == "derived"}

    def reaches(code: str, goal: str, seen: frozenset) -> bool:
        return any(p == goal or p not in seen and reaches(p, goal, seen | {p}) for p in parts.get(code, ()))

    return [c for c in parts if reaches(c, c, frozenset())]
