"""Counts taken while a table is written, the log of runs, pages in order, rollups by grouping sets, totals of many metrics at once."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quern.operators import checks, warehouse
from quern.operators.metrics import DEFINITIONS
from quern.operators.pages import Pages
from quern.operators.products import Matcher, common_length, lcs, without
from quern.plans import knowledge, registry  # noqa: F401
from quern.plans.warehouse import END, START, Detail
from quern.sources import shared

DATA = "/root/testdata/sf0.001"


def jobs(spark, group, run):
    """How many jobs a call starts."""
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_come_with_the_write_and_no_job_of_their_own(spark):
    rows = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("v"), (F.col("id") - 3).alias("w"))
    rules = {checks.Rule("A", "t", "not_null", "v", "v IS NOT NULL", "error"): "v IS NOT NULL", checks.Rule("B", "t", "range", "w", "x >= 0", "warn"): "w >= 0"}
    counted, told = checks.observed(rows, rules)
    path = shared.new_path(spark, "observed")
    _, wrote = jobs(spark, "write", lambda: counted.write.parquet(path))
    found, told_jobs = jobs(spark, "told", lambda: [tuple(r) for r in told().collect()])
    assert wrote == 1 and told_jobs <= 1  # the second is the collect of two local rows
    assert found == [("A", "t", "error", 100, 10, 0.9, "error"), ("B", "t", "warn", 100, 3, 0.97, "warn")]
    with pytest.raises(ValueError):
        checks.observed(rows, {checks.Rule("U", "t", "unique", "v", "TRUE", "warn"): "TRUE"})


def test_observed_results_are_those_of_a_scan(spark):
    d = Detail(spark, DATA)
    tables = {"raw_order": d.raw_order(), "raw_refund": checks.with_order_max(d.raw_refund(), d.raw_order()), "dwd_order": d.dwd_order_sku()}
    assert sorted(map(tuple, d.quality().collect())) == sorted(map(tuple, checks.results(tables).collect()))


def test_the_log_keeps_runs_and_reads_the_latest_alone(spark):
    path = shared.new_path(spark, "log")
    runs = spark.createDataFrame([(r, f"DQ{k}", k) for r in ("2026-01", "2026-02", "2026-03") for k in range(3)], "run_id string, rule_id string, failed_rows int")
    checks.logged(runs.where("run_id < '2026-03'"), path)
    checks.logged(runs.withColumn("failed_rows", F.lit(99)), path)  # the runs that are there stay as they are
    log = spark.read.schema(runs.schema).parquet(path)
    assert sorted((r.run_id, r.failed_rows) for r in log.collect()) == [(r, 99 if r == "2026-03" else k) for r in ("2026-01", "2026-02", "2026-03") for k in ((99,) * 3 if r == "2026-03" else range(3))]
    latest = checks.latest_run(log)
    assert {r.run_id for r in latest.collect()} == {"2026-03"}
    assert "PartitionFilters: [isnotnull(run_id" in plan_of(latest) and "ubquery" in plan_of(latest)


def test_kept_queries_work_after_clearing(spark):
    stats = sorted(map(tuple, registry.QUERIES["kb_stats"](spark, DATA).collect()))
    assert registry.QUERIES["match_stats"](spark, DATA).count() == 3
    shared.cleared(spark)
    assert sorted(map(tuple, registry.QUERIES["kb_stats"](spark, DATA).collect())) == stats
    assert registry.QUERIES["match_stats"](spark, DATA).count() == 3


def test_a_page_reads_the_parts_that_hold_it(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("a"), F.col("id").alias("b"))
    pages = Pages(rows, "a", "b", part_rows=100)
    want = sorted((r.a, r.b) for r in rows.collect())
    for offset, limit in ((0, 10), (495, 10), (990, 50), (95, 30)):
        assert sorted((r.place, r.a, r.b) for r in pages.page(offset, limit).collect()) == [(offset + k + 1, *x) for k, x in enumerate(want[offset : offset + limit])]
    assert pages.page(1000, 10).count() == 0
    middle = pages.page(530, 5)
    assert "(part#" in plan_of(middle).split("PartitionFilters: ")[1] and " = 5)" in plan_of(middle).split("PartitionFilters: ")[1]
    assert Pages(rows.limit(0), "a", "b").page(0, 5).count() == 0


def test_the_dashboard_scans_the_days_once(spark):
    path = shared.new_path(spark, "days")
    Detail(spark, DATA).shop_day().write.parquet(path)
    board = warehouse.dashboard(spark.read.parquet(path))
    assert plan_of(board).count("FileScan") == 1 and "Expand" in plan_of(board)
    parts = {p: board.where(F.col("part") == p).agg(F.sum("order_cnt")).first()[0] for p in ("all", "day", "tenant", "platform")}
    assert len(set(parts.values())) == 1


def test_totals_of_many_are_those_of_each(spark):
    engine = Detail(spark, DATA).engine()
    for tenant in (None, "T1"):
        found = engine.totals([(m.code, m.version, START, END) for m in DEFINITIONS], tenant).orderBy("place").collect()
        for m, r in zip(DEFINITIONS, found, strict=True):
            assert (r.metric_code, r.value) == (m.code, pytest.approx(engine.total(m.code, m.version, start=START, end=END, tenant=tenant).first().value))
    never = engine.totals([("GMV_PAID", "v1.0", date(1980, 1, 1), date(1980, 1, 2)), ("AOV_PAID", None, date(1995, 1, 1), date(1995, 1, 2))]).orderBy("place").collect()
    assert never[0].value is None and never[1].value == pytest.approx(engine.total("AOV_PAID", start=date(1995, 1, 1), end=date(1995, 1, 2)).first().value)


def test_comparisons_without_a_version_then(spark):
    engine = Detail(spark, DATA).engine()
    found = engine.comparisons([("ORDER_CNT", "yoy"), ("ORDER_CNT", "mom")], date(1990, 1, 5), date(1990, 1, 6)).collect()
    assert [(r.total, r.previous_total, r.delta) for r in found] == [(0.0, None, None), (0.0, 0.0, 0.0)]


def test_common_subsequences_as_expressions(spark):
    words = ["", "A", "ABCBDAB", "BDCABA", "X" * 62, "XYX" * 20, "ABC漢字", "漢C字"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.select("a", "b", common_length(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == lcs(r.a, r.b)
    got = spark.range(4).select(without(F.lit("ABCA"), F.col("id").cast("int")).alias("s")).collect()
    assert [sorted(r.s) for r in got] == [["ABCA"], ["ABA", "ABC", "ACA", "BCA"], ["AA", "AB", "AC", "BA", "BC", "CA"], ["A", "B", "C"]]


def test_codes_of_many_shapes_are_compared_by_lengths(spark, monkeypatch):
    monkeypatch.setattr("quern.operators.products.SHAPES", 1)
    pool = ["ABCDEFGHIJ", "ABCDEFGHIX", "QQQQQQQQ12", "Z" * 80]
    mapping = spark.createDataFrame([(i, "T", "p", "s", c, f"k{i}") for i, c in enumerate(pool)], "id long, tenant_id string, platform string, shop_id string, platform_sku_code string, sku_id string")
    asked = ["ABCDEFGHIK", "QQQQQQQQ13", "Z" * 79 + "Y"]
    got = {(r.code, r.matched): r.score for r in Matcher(mapping).scored(spark.createDataFrame([("T", c) for c in asked], "tenant_id string, code string"), 88.0).collect()}
    assert got == {(a, b): 200 * lcs(a, b) / (len(a) + len(b)) for a in asked for b in pool if 200 * lcs(a, b) >= 88 * (len(a) + len(b))}
