"""Data quality rules, the gate on them, and checks of what was materialized."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Rule:
    id: str
    table: str
    kind: str
    column: str
    predicate: str
    severity: str


#: The rules. ``order_max`` is the greatest raw amount of the refund's order.
RULES = (
    Rule("DQ001", "raw_order", "not_null", "pay_amount", "pay_amount IS NOT NULL", "error"),
    Rule("DQ002", "raw_order", "range", "pay_amount", "pay_amount > 0", "error"),
    Rule("DQ003", "raw_order", "range", "qty", "qty > 0 AND qty <= 100", "warn"),
    Rule("DQ004", "raw_refund", "business", "refund_amount", "refund_amount > 0 AND refund_amount <= order_max", "error"),
    Rule("DQ005", "dwd_order", "referential", "sku_id", "sku_id IS NOT NULL", "warn"),
    Rule("DQ006", "dwd_order", "range", "net_amount", "net_amount >= 0", "error"),
)


def with_order_max(refunds: DataFrame, orders: DataFrame) -> DataFrame:
    most = orders.groupBy(F.col("order_id").alias("o")).agg(F.max("pay_amount").alias("order_max"))
    return refunds.join(most, F.col("order_id") == F.col("o"), "left").drop("o")


def results(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule_id, table_name, severity, checked_rows, failed_rows, pass_rate (6 places), status; one scan per table.

    A row fails where the predicate is false; where it is null it doesn't. A
    rule of kind ``unique`` counts rows beyond the distinct values of its
    column.
    """
    return results_by(tables, rules)


def results_by(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES, *by: str) -> DataFrame:
    """The same for each value of the columns ``by``, which all tables have."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name in dict.fromkeys(r.table for r in rules):
        own = [r for r in rules if r.table == name]
        wide = tables[name].groupBy(*by).agg(F.count("*").alias("n"), *(_failed(r).alias(f"f{k}") for k, r in enumerate(own)))
        each = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.lit(name).alias("table_name"), F.lit(r.severity).alias("severity"), F.col("n").alias("checked_rows"), F.col(f"f{k}").alias("failed_rows")) for k, r in enumerate(own)))
        rows = wide.select(*by, F.explode(each).alias("r")).select(*by, "r.*")
        out = rows if out is None else out.unionByName(rows)
    return _rated(spark.createDataFrame([], _COUNTED) if out is None else out)


_COUNTED = "rule_id string, table_name string, severity string, checked_rows long, failed_rows long"


def _failed(rule: Rule, predicate: str | None = None) -> Column:
    if rule.kind == "unique":
        return F.count("*") - F.count_distinct(rule.column)
    return F.count_if(F.expr(f"NOT ({predicate or rule.predicate})"))


def _rated(counted: DataFrame) -> DataFrame:
    rate = F.when(F.col("checked_rows") > 0, F.round((F.col("checked_rows") - F.col("failed_rows")) / F.col("checked_rows"), 6)).otherwise(1.0)
    return counted.select("*", rate.alias("pass_rate"), F.when(F.col("failed_rows") == 0, "pass").otherwise(F.col("severity")).alias("status"))


def observed(rows: DataFrame, rules: dict[Rule, str]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``rows`` that count, as they are written, what fails rules, and a function that gives the results once they are.

    ``rules`` has the predicate of each over the rows' columns. No job runs for
    the counts. A rule of kind ``unique`` can't be counted so.
    """
    if any(r.kind == "unique" for r in rules):
        raise ValueError("distinct values can't be counted while rows pass by")
    seen = Observation()
    out = rows.observe(seen, F.count(F.lit(1)).alias("n"), *(_failed(r, p).alias(r.id) for r, p in rules.items()))

    def told() -> DataFrame:
        found = seen.get
        return _rated(rows.sparkSession.createDataFrame([(r.id, r.table, r.severity, found["n"], found[r.id]) for r in rules], _COUNTED))

    return out, told


def logged(found: DataFrame, path: str, run: str = "run_id") -> None:
    """Appends the results of runs to a log partitioned by run. Runs that it has stay as they are, so that an append may be repeated."""
    spark = found.sparkSession
    spark.createDataFrame([], found.schema).write.mode("ignore").partitionBy(run).parquet(path)
    there = spark.read.schema(found.schema).parquet(path).select(run).distinct()
    found.join(there, run, "left_anti").repartition(run).write.mode("append").partitionBy(run).parquet(path)


def latest_run(log: DataFrame, run: str = "run_id") -> DataFrame:
    """The rows of the greatest run of a log partitioned by it. Only that run's files are read: its name is a subquery's, known before the scan."""
    return log.where(F.col(run) == log.agg(F.max(run)).scalar())


def history(log: DataFrame, run: str = "run_id") -> DataFrame:
    """A row per run: rules, failed_rules, overall_pass_rate by rows, mean_pass_rate over rules, and the gate."""
    return log.groupBy(run).agg(*_summed(), F.round(F.sum(F.col("pass_rate").cast("decimal(20,6)")).cast("double") / F.count("*"), 6).alias("mean_pass_rate"))


def summary(found: DataFrame) -> DataFrame:
    """One row: rules, failed_rules, overall_pass_rate by rows, and the gate: hold on an error, degraded on a warning, else pass."""
    return found.agg(*_summed())


def _summed() -> list[Column]:
    rate = 1 - F.sum("failed_rows") / F.nullif(F.sum("checked_rows"), F.lit(0))
    gate = F.when(F.count_if(F.col("status") == "error") > 0, "hold").when(F.count_if(F.col("status") == "warn") > 0, "degraded").otherwise("pass")
    return [F.count("*").alias("rules"), F.count_if(F.col("failed_rows") > 0).alias("failed_rules"), F.round(rate, 6).alias("overall_pass_rate"), gate.alias("gate")]


def failing(rows: DataFrame, rule: Rule, n: int = 20, tenant: str | None = None, order: str | None = None) -> DataFrame:
    """Up to n rows that fail a rule, of one tenant if named (the tenant's filter comes before the limit)."""
    bad = rows.where(F.expr(f"NOT ({rule.predicate})"))
    bad = bad if tenant is None else bad.where(F.col("tenant_id") == tenant)
    return (bad.orderBy(order) if order else bad).limit(n)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def volume(results: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """For each day with two days before it: its points, the mean of up to six days before, and the level (error below half, warn above twice)."""
    days = results.groupBy("dt").agg(F.count("*").alias("n"))
    # A row per day: the window's one partition is as small as the calendar.
    before = W.orderBy("dt").rowsBetween(-6, -1)
    seen = days.select("dt", "n", F.sum("n").over(before).alias("s"), F.count("n").over(before).alias("days_before")).where("days_before >= 2")
    mean = F.col("s") / F.col("days_before")
    level = F.when(F.col("n") < mean * low, "error").when(F.col("n") > mean * high, "warn").otherwise("pass")
    return seen.select("dt", "n", F.round(mean, 4).alias("mean_before"), level.alias("level"))


def unknown_versions(results: DataFrame, definitions: DataFrame) -> DataFrame:
    return results.select("metric_code", "caliber_version").distinct().join(definitions, ["metric_code", "caliber_version"], "left_anti")


def negatives(results: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    return results.where(F.col("metric_code").isin(*codes)).groupBy("metric_code").agg(F.min("value").alias("least")).where("least < 0")


def verified(results: DataFrame, definitions: DataFrame, amounts: tuple[str, ...]) -> DataFrame:
    """One row: verdict, failed, warned, and how many findings each check has: the latest day's volume, versions that the dictionary lacks, negative amounts.

    A day's volume counts against the six days before it, if there are two at
    least. Errors make the verdict fail, warnings alone warn.
    """
    days = volume(results)
    last = results.agg(F.max("dt").alias("last"))  # one row, as are the next
    level = days.join(last, F.col("dt") == F.col("last")).agg(F.count_if(F.col("level") == "error").alias("volume_errors"), F.count_if(F.col("level") == "warn").alias("volume_warnings"))
    ghosts = unknown_versions(results, definitions).agg(F.least(F.count("*"), F.lit(1)).alias("version_errors"))
    below = negatives(results, amounts).agg(F.count("*").alias("negative_errors"))
    every = level.crossJoin(ghosts).crossJoin(below)
    failed, warned = F.col("volume_errors") + F.col("version_errors") + F.col("negative_errors"), F.col("volume_warnings")
    return every.select(F.when(failed > 0, "fail").when(warned > 0, "warn").otherwise("pass").alias("verdict"), failed.alias("failed"), warned.alias("warned"), "volume_errors", "volume_warnings", "version_errors", "negative_errors")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def rules_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.id, r.table, r.kind, r.column, r.predicate, r.severity) for r in RULES], "rule_id string, table_name string, rule_type string, column_name string, expression string, severity string")
