from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.operators import checks, products, warehouse
from quern.operators.metrics import DEFINITIONS, Dictionary, Engine, MetricError, derived_points, formula_column, formula_parts, shifted
from quern.operators.products import Matcher, lcs
from quern.plans.warehouse import Detail

DATA = "/root/testdata/sf0.001"
NOON = datetime(2026, 9, 23, 12)


@pytest.fixture(scope="module")
def orders(spark):
    rows = [("null", "O-NULL", None, 1), ("neg", "O-NEG", -88, 1), ("good", "O-GOOD", 100, 1), ("many", "O-MANY", 5, 101), ("both", "O-BOTH", 0, 101)]
    rows = [(k, o, None if a is None else Decimal(a), Decimal(q), Decimal(12 if k == "neg" else 0)) for k, o, a, q in rows]
    df = spark.createDataFrame(rows, "order_line_id string, order_id string, pay_amount decimal(18,4), qty decimal(10,2), freight decimal(10,2)")
    return df.select("*", F.lit("T").alias("tenant_id"), F.lit("S").alias("shop_id"), F.lit("p").alias("platform"), F.lit("paid").alias("order_status"), F.lit(False).alias("is_presale"), F.lit(NOON).alias("created_at"), F.lit(NOON).alias("paid_at"))


@pytest.fixture(scope="module")
def refunds(spark):
    rows = [("R1", "O-GOOD", 50000), ("R2", "O-GOOD", 100), ("R3", "O-NULL", 10), ("R4", "O-NONE", 10), ("R5", "O-GOOD", None), ("R6", "O-GOOD", -1)]
    return spark.createDataFrame([(k, o, None if a is None else Decimal(a)) for k, o, a in rows], "refund_id string, order_id string, refund_amount decimal(18,5)")


def test_first_reason_counts_and_amounts_fall_back(orders):
    got = {r.order_line_id: r for r in warehouse.clean_orders(orders).collect()}
    assert {k: r.invalid_reason for k, r in got.items()} == {"null": "pay_amount_null", "neg": "pay_amount_not_positive", "good": None, "many": "qty_out_of_range", "both": "pay_amount_not_positive"}
    assert (got["neg"].pay_amount, got["neg"].net_amount, got["many"].pay_amount) == (0, -12, 5)


def test_refunds_are_capped_by_cleaned_amounts(orders, refunds):
    got = {r.refund_id: r.invalid_reason for r in warehouse.clean_refunds(refunds, warehouse.clean_orders(orders)).collect()}
    assert got == {"R1": "refund_exceeds_order_amount", "R2": None, "R3": "refund_exceeds_order_amount", "R4": None, "R5": "refund_amount_null", "R6": "refund_amount_not_positive"}


def test_null_predicates_dont_fail_rules(orders, refunds):
    tables = {"raw_order": orders, "raw_refund": checks.with_order_max(refunds, orders), "dwd_order": warehouse.clean_orders(orders).withColumn("sku_id", F.lit("x"))}
    got = {r.rule_id: (r.failed_rows, r.status) for r in checks.results(tables).collect()}
    assert got == {"DQ001": (1, "error"), "DQ002": (2, "error"), "DQ003": (2, "warn"), "DQ004": (2, "error"), "DQ005": (0, "pass"), "DQ006": (1, "error")}
    assert checks.summary(checks.results(tables)).first().gate == "hold"


def test_unique_rule(orders):
    rule = checks.Rule("U", "t", "unique", "order_id", "TRUE", "warn")
    assert checks.results({"t": orders.unionByName(orders.limit(2))}, (rule,)).first().failed_rows == 2


def test_sessions_keep_the_first_copy(spark):
    df = spark.createDataFrame([("a", 1, -5.0, 9), ("a", 0, None, 3), ("b", 0, 7.0, 0)], "session_id string, copy_no int, first_response_sec double, satisfaction int")
    got = {r.session_id: (r.first_response_sec, r.satisfaction) for r in warehouse.clean_sessions(df).collect()}
    assert got == {"a": (0.0, 3), "b": (7.0, None)}


def test_fuzzy_matches_equal_brute_force(spark):
    d = Detail(spark, DATA)
    pool = {}
    for r in Matcher(d.map_platform_sku()).mapping.orderBy("id").collect():
        pool.setdefault(r.tenant_id, {}).setdefault(r.code, (r.id, r.sku_id))
    rows = d.dwd_order_sku().where("match_type = 'fuzzy'").select("tenant_id", F.upper(F.translate(F.trim("platform_sku_code"), "－", "-")).alias("code"), "sku_id", "map_confidence").distinct().collect()
    assert rows
    for r in rows:
        best = max((200 * lcs(r.code, c) / (len(r.code) + len(c)), -i, s) for c, (i, s) in pool[r.tenant_id].items())
        assert best[0] >= 88 and r.sku_id == best[2] and r.map_confidence == pytest.approx(best[0] / 100, abs=6e-4)


def test_candidates_have_no_cutoff(spark):
    matcher = Matcher(spark.createDataFrame([(1, "T", "p", "s", "ABCD-1", "k1"), (2, "T", "p", "s", "ABCD-2", "k2"), (3, "T", "q", "s", "ZZ", "k3"), (4, "U", "p", "s", "ABCD-3", "k4")], "id long, tenant_id string, platform string, shop_id string, platform_sku_code string, sku_id string"))
    got = matcher.candidates(spark.createDataFrame([("T", "ABCD-3")], "tenant_id string, code string")).orderBy("rank").collect()
    assert [(r.sku_id, r.score) for r in got] == [("k1", 0.833), ("k2", 0.833), ("k3", 0.0)]


def test_scores_and_candidates_equal_brute_force(spark, monkeypatch):
    pool = ["ABCDEFGHIJ", "ABCDEFGHIX", "BACDEFGHIJ", "ABCDEFGHI", "A", "AABBAABBAABB", "AABBAABBAAB", "X" * 40, "X" * 37 + "YZ", "X" * 30 + "ABC" * 3]
    mapping = spark.createDataFrame([(i, "T", "p", "s", c, f"k{i}") for i, c in enumerate(pool)], "id long, tenant_id string, platform string, shop_id string, platform_sku_code string, sku_id string")
    asked = ["ABCDEFGHIK", "ABDEFGHIJ", "AABBAABBAABA", "B", "X" * 39, "X" * 20 + "Q" + "X" * 18, "QQQQ"]
    codes = spark.createDataFrame([("T", c) for c in asked], "tenant_id string, code string")
    score = lambda a, b: 200 * lcs(a, b) / (len(a) + len(b))
    for most in (4096, 5):  # with 5 most codes are compared by their lengths
        monkeypatch.setattr(products, "MOST", most)
        for cutoff in (88.0, 75.0):
            got = {(r.code, r.matched): r.score for r in Matcher(mapping).scored(codes, cutoff).collect()}
            assert got == {(a, b): score(a, b) for a in asked for b in pool if score(a, b) >= cutoff}
    monkeypatch.setattr(products, "BLOCK", 3)
    got = sorted((r.code, r["rank"], r.matched) for r in Matcher(mapping).candidates(codes).collect())
    best = {a: sorted(range(len(pool)), key=lambda i: (-score(a, pool[i]), i))[:3] for a in asked}
    assert got == sorted((a, k + 1, pool[i]) for a, three in best.items() for k, i in enumerate(three))


def test_versions():
    d = Dictionary()
    assert d.resolve("GMV_PAID", date(1997, 8, 15)).version == "v1.0" and d.resolve("GMV_PAID", date(1998, 9, 15)).version == "v1.1"
    assert d.resolve("NONE", date(1998, 1, 1)) is None and len(DEFINITIONS) == 15
    assert [m.version for m in d.parts(d.get("GMV_SETTLE", "v1.0"), date(1998, 9, 1))] == ["v1.0", "v1.0"]


def points(spark, *rows):
    return spark.createDataFrame([(date(2026, 1, d), "T", "T", v) for d, v in rows], "dt date, tenant_id string, dim_value string, value double")


def test_derived_points_need_all_parts_and_a_divisor(spark):
    a, b = points(spark, (1, 10.0), (2, 5.0), (3, 4.0)), points(spark, (1, 4.0), (3, 0.0))
    assert [r.value for r in derived_points([("A", a), ("B", b)], "A - B").orderBy("dt").collect()] == [6.0, 4.0]
    assert [r.value for r in derived_points([("A", a), ("B", b)], "A / B").collect()] == [2.5]


def test_formulas_are_checked():
    assert formula_parts("GMV_PAID / PAID_CNT") == ["GMV_PAID", "PAID_CNT"]
    for bad in ("__import__('os')", "a + b", "1 + 2", ""):
        with pytest.raises(MetricError):
            formula_column(bad)


def test_totals_over_nothing(spark):
    engine = Detail(spark, DATA).engine()
    never = {"start": date(1980, 1, 1), "end": date(1980, 1, 2)}
    value = lambda code: engine.total(code, "v1.0", **never).first().value
    assert (value("GMV_PAID"), value("PAID_CNT"), value("AOV_PAID"), value("CS_BOT_RATIO")) == (None, 0.0, None, None)


def test_errors(spark):
    engine = Detail(spark, DATA).engine()
    day = {"start": date(1997, 1, 1), "end": date(1997, 1, 2)}
    for call in (lambda: engine.series("X", **day), lambda: engine.series("GMV_PAID", "v9", **day), lambda: engine.series("CS_BOT_CNT", dim="platform", **day), lambda: engine.series("GMV_PAID", dim="city", **day), lambda: engine.series("GMV_PAID", start=day["end"], end=day["start"])):
        with pytest.raises(MetricError):
            call()


def test_additive_totals_are_sums_and_ratios_are_not(spark):
    engine = Engine(Detail(spark, DATA).engine().tables)
    year = {"start": date(1995, 1, 1), "end": date(1995, 12, 31)}
    both = lambda code: (engine.series(code, "v1.0", **year).agg(F.sum("value")).first()[0], engine.total(code, "v1.0", **year).first().value)
    days, total = both("GMV_ORDER")
    assert days == pytest.approx(total)
    days, total = both("REFUND_RATE")
    assert 0 <= total <= 1 < days


def test_windows():
    assert shifted(date(2026, 3, 1), date(2026, 3, 31), "mom") == (date(2026, 1, 29), date(2026, 2, 28))
    assert shifted(date(2024, 2, 29), date(2024, 3, 31), "yoy") == (date(2023, 2, 28), date(2023, 3, 28))
    with pytest.raises(MetricError):
        shifted(date(2026, 1, 1), date(2026, 1, 1), "wow")


def test_volume_levels(spark):
    rows = [(date(2026, 1, d),) for d, n in ((1, 10), (2, 10), (3, 4), (4, 30)) for _ in range(n)]
    got = {r.dt.day: r.level for r in checks.volume(spark.createDataFrame(rows, "dt date")).collect()}
    assert got == {3: "error", 4: "warn"}


def test_keys_are_unique(spark):
    d = Detail(spark, DATA)
    for df, keys in ((d.shop_day(), ("dt", "shop_id")), (d.tenant_day(), ("dt", "tenant_id")), (d.dwd_cs_session(), ("session_id",)), (d.results(), ("metric_code", "caliber_version", "tenant_id", "dt", "dim_type", "dim_value"))):
        assert checks.duplicates(df, *keys).isEmpty()
    # The given rows repeat a line's key; cleaning neither adds nor drops any.
    counts = lambda df: df.groupBy("order_line_id").count()
    assert counts(d.dwd_order()).exceptAll(counts(d.raw_order())).isEmpty() and d.dwd_order().count() == d.raw_order().count()
