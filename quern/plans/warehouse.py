"""Queries of the commerce warehouse, and the same in SQL."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import extract_numeric, normalize_barcode, normalize_code, normalize_text
from quern.operators import checks, lineage, policy, warehouse
from quern.operators.metrics import AMOUNTS, DEFINITIONS, DIMENSIONS, TARGETS, Dictionary, Engine, daily_series, in_force, kpis, notices, shifted
from quern.operators.pages import Pages
from quern.operators.products import Matcher
from quern.plans.registry import ORACLES, QUERIES
from quern.sources.commerce import SQL, Commerce, table
from quern.sources.shared import kept, new_path, once
from quern.sources.snapshots import Snapshots

START, END = date(1992, 1, 1), date(1998, 12, 31)
#: A window of the comparisons.
MONTH = date(1997, 3, 1), date(1997, 3, 31)


class Detail(Commerce):
    """The cleaned tables of one data folder. Those of orders and refunds are written when first wanted by an application and read from then on."""

    def _written(self, name: str, build) -> DataFrame:
        return once(self.spark, (name, self.sf_dir), lambda: kept(build(), name))

    def dwd_order(self) -> DataFrame:
        return self._written("dwd_order", lambda: warehouse.clean_orders(self.raw_order()))

    def _order_sku(self):
        def make():
            # The raw amount is what rules of raw orders are about; every raw order is a row here.
            raw = self.raw_order().withColumn("raw_pay_amount", F.col("pay_amount"))
            rows = Matcher(self.map_platform_sku()).resolved(warehouse.clean_orders(raw))
            predicates = {r: re.sub(r"\bpay_amount\b", "raw_pay_amount", r.predicate) if r.table == "raw_order" else r.predicate for r in checks.RULES if r.table != "raw_refund"}
            counted, told = checks.observed(rows, predicates)
            return kept(counted.drop("raw_pay_amount"), "dwd_order_sku"), told

        return once(self.spark, ("dwd_order_sku", self.sf_dir), make)

    def dwd_order_sku(self) -> DataFrame:
        return self._order_sku()[0]

    def quality(self) -> DataFrame:
        """Results of all rules; those of orders were counted while dwd_order_sku was written."""
        refunds = checks.results({"raw_refund": checks.with_order_max(self.raw_refund(), self.raw_order())}, tuple(r for r in checks.RULES if r.table == "raw_refund"))
        return self._order_sku()[1]().unionByName(refunds)

    def quality_log(self) -> DataFrame:
        """Results of all rules for each month, a run each: a log partitioned by run."""

        def make():
            month = lambda df, day: df.withColumn("run_id", F.date_format(day, "yyyy-MM"))
            refunds = checks.with_order_max(self.raw_refund(), self.raw_order())
            tables = {"raw_order": month(self.raw_order(), "created_at"), "raw_refund": month(refunds, "refund_dt"), "dwd_order": month(self.dwd_order_sku(), "order_dt")}
            path, found = new_path(self.spark, "dq_result"), checks.results_by(tables, checks.RULES, "run_id")
            checks.logged(found, path)
            return self.spark.read.schema(found.schema).parquet(path)

        return once(self.spark, ("dq_result", self.sf_dir), make)

    def dwd_refund(self) -> DataFrame:
        return self._written("dwd_refund", lambda: warehouse.clean_refunds(self.raw_refund(), self.dwd_order()))

    def dwd_cs_session(self) -> DataFrame:
        return warehouse.clean_sessions(self.raw_cs_session())

    def shop_day(self) -> DataFrame:
        return self._written("dws_shop_day", lambda: warehouse.shop_day(self.dwd_order(), self.dwd_refund(), self.dwd_cs_session(), self.dim_shop()))

    def tenant_day(self) -> DataFrame:
        return warehouse.tenant_day(self.shop_day())

    def engine(self) -> Engine:
        return Engine({"dwd_order": self.dwd_order(), "dwd_refund": self.dwd_refund(), "dwd_cs_session": self.dwd_cs_session()})

    def results(self) -> DataFrame:
        return self.engine().materialized(START, END)


#: The cleaned tables and rollups in DuckDB's SQL.
DETAIL = (
    "WITH "
    + SQL.strip()
    + """,
dwd_order AS (
  SELECT * EXCLUDE (pay_amount), CASE WHEN pay_amount IS NULL THEN 'pay_amount_null' WHEN pay_amount <= 0 THEN 'pay_amount_not_positive' WHEN qty <= 0 OR qty > 100 THEN 'qty_out_of_range' END AS invalid_reason,
    NOT (pay_amount IS NULL OR pay_amount <= 0 OR qty <= 0 OR qty > 100) AS is_valid, CASE WHEN pay_amount IS NULL OR pay_amount <= 0 THEN 0 ELSE pay_amount END AS pay_amount,
    CAST(round(CASE WHEN pay_amount IS NULL OR pay_amount <= 0 THEN 0 ELSE pay_amount END - freight, 2) AS DECIMAL(18,2)) AS net_amount,
    CAST(created_at AS DATE) AS order_dt, CAST(paid_at AS DATE) AS paid_dt, order_status = 'cancelled' AS is_cancelled
  FROM raw_order
),
dwd_refund AS (
  SELECT r.* EXCLUDE (refund_amount), cap,
    CASE WHEN refund_amount IS NULL THEN 'refund_amount_null' WHEN refund_amount <= 0 THEN 'refund_amount_not_positive' WHEN refund_amount > cap + 0.01 THEN 'refund_exceeds_order_amount' END AS invalid_reason,
    (refund_amount > 0 AND coalesce(refund_amount <= cap + 0.01, TRUE)) IS TRUE AS is_valid, CASE WHEN refund_amount IS NULL OR refund_amount <= 0 THEN 0 ELSE refund_amount END AS refund_amount
  FROM raw_refund r LEFT JOIN (SELECT order_id, max(pay_amount) AS cap FROM dwd_order GROUP BY order_id) c USING (order_id)
),
dwd_cs_session AS (
  SELECT session_id, shop_id, tenant_id, is_bot, CAST(CASE WHEN first_response_sec < 0 OR first_response_sec IS NULL THEN 0 ELSE first_response_sec END AS DOUBLE) AS first_response_sec,
    CASE WHEN satisfaction BETWEEN 1 AND 5 THEN satisfaction END AS satisfaction, resolved, intent_l1, session_dt
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY copy_no) AS rn FROM raw_cs_session) x WHERE rn = 1
),
d_order AS (SELECT order_dt AS dt, shop_id, count(*) AS order_cnt, sum(pay_amount) AS order_gmv FROM dwd_order WHERE is_valid AND NOT is_cancelled GROUP BY ALL),
d_paid AS (SELECT paid_dt AS dt, shop_id, count(*) AS paid_cnt, sum(pay_amount) AS paid_gmv FROM dwd_order WHERE is_valid AND paid_dt IS NOT NULL AND order_status <> 'cancelled' GROUP BY ALL),
d_refund AS (SELECT refund_dt AS dt, shop_id, count(*) AS refund_cnt, sum(refund_amount) AS refund_amount FROM dwd_refund WHERE is_valid AND refund_status = 'success' GROUP BY ALL),
d_cs AS (
  SELECT session_dt AS dt, shop_id, count(*) AS cs_session_cnt, sum(is_bot::INT) AS cs_bot_cnt, sum(resolved::INT) AS cs_resolved_cnt, count(satisfaction) AS cs_satisfaction_cnt, sum(first_response_sec::DECIMAL(20,5)) AS cs_first_response_sum, sum(satisfaction) AS cs_satisfaction_sum
  FROM dwd_cs_session GROUP BY ALL
),
dws_shop_day AS (
  SELECT dt, coalesce(tenant_id, '') AS tenant_id, shop_id, coalesce(platform, '') AS platform,
    coalesce(order_cnt, 0)::BIGINT AS order_cnt, coalesce(paid_cnt, 0)::BIGINT AS paid_cnt, coalesce(refund_cnt, 0)::BIGINT AS refund_cnt, coalesce(cs_session_cnt, 0)::BIGINT AS cs_session_cnt,
    coalesce(cs_bot_cnt, 0)::BIGINT AS cs_bot_cnt, coalesce(cs_resolved_cnt, 0)::BIGINT AS cs_resolved_cnt, coalesce(cs_satisfaction_cnt, 0)::BIGINT AS cs_satisfaction_cnt,
    round(coalesce(order_gmv, 0), 2)::DOUBLE AS order_gmv, round(coalesce(paid_gmv, 0), 2)::DOUBLE AS paid_gmv, round(coalesce(refund_amount, 0), 2)::DOUBLE AS refund_amount,
    round(coalesce(cs_first_response_sum, 0), 2)::DOUBLE AS cs_first_response_sum, round(coalesce(cs_satisfaction_sum, 0), 2)::DOUBLE AS cs_satisfaction_sum, round(coalesce(paid_gmv, 0) - coalesce(refund_amount, 0), 2)::DOUBLE AS settlement_gmv
  FROM d_order FULL JOIN d_paid USING (dt, shop_id) FULL JOIN d_refund USING (dt, shop_id) FULL JOIN d_cs USING (dt, shop_id) LEFT JOIN (SELECT shop_id, tenant_id, platform FROM dim_shop) s USING (shop_id)
),
dws_tenant_day AS (
  SELECT dt, tenant_id, sum(order_cnt)::BIGINT AS order_cnt, round(sum(order_gmv::DECIMAL(20,2)), 2)::DOUBLE AS order_gmv, round(sum(paid_gmv::DECIMAL(20,2)), 2)::DOUBLE AS paid_gmv, round(sum(refund_amount::DECIMAL(20,2)), 2)::DOUBLE AS refund_amount,
    round(sum(settlement_gmv::DECIMAL(20,2)), 2)::DOUBLE AS settlement_gmv, sum(cs_session_cnt)::BIGINT AS cs_session_cnt
  FROM dws_shop_day GROUP BY dt, tenant_id
)
"""
)


def _query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _detail(name: str, sql: str | None):
    """Registers a function of Detail, with SQL over its tables."""

    def add(f):
        _query(name, None if sql is None else DETAIL + sql)(lambda spark, sf_dir: f(Detail(spark, sf_dir)))
        return f

    return add


def _agg_sql(formula: str) -> str:
    """A metric's aggregate for DuckDB, means as exact sums by counts."""
    mean = re.fullmatch(r"AVG\((\w+)\)", formula)
    if mean:
        return f"(sum({mean[1]}::DECIMAL(24,4)) / count({mean[1]}))::DOUBLE"
    return "avg(resolved::INT)" if formula.startswith("AVG(CASE") else f"CAST({formula} AS DOUBLE)"


# Points of simple metrics and their totals, written out for SQL.
_SIMPLE_SQL = {(m.code, m.version): (m.source, m.day, _agg_sql(m.formula), m.condition) for m in DEFINITIONS if m.source != "derived"}


def _points_sql(code: str, version: str, dim: str, start: date = START, end: date = END) -> str:
    source, day, agg, condition = _SIMPLE_SQL[code, version]
    return f"SELECT {day} AS dt, tenant_id, {DIMENSIONS[dim]} AS dim_value, {agg} AS value FROM {source} WHERE ({condition}) AND {day} BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY ALL HAVING {agg} IS NOT NULL"


def _derived_sql(left: str, op: str, right: str) -> str:
    value = f"a.value {op} b.value" if op != "/" else "a.value / nullif(b.value, 0)"
    return f"SELECT a.dt, a.tenant_id, a.dim_value, {value} AS value FROM ({left}) a JOIN ({right}) b USING (dt, tenant_id, dim_value) WHERE {value} IS NOT NULL"


_FORMULAS = {m.code: m.formula.split() for m in DEFINITIONS if m.source == "derived"}


def _series_sql(code: str, version: str, dim: str) -> str:
    if code in _FORMULAS:
        a, op, b = _FORMULAS[code]
        return _derived_sql(_points_sql(a, "v1.0", dim), op, _points_sql(b, "v1.0", dim))
    return _points_sql(code, version, dim)


def _version(code: str) -> str:
    return Dictionary().resolve(code, END).version


_RESULTS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS metric_code, '{_version(c)}' AS caliber_version, tenant_id, dt, '{d}' AS dim_type, dim_value, round(value, 4) AS value FROM ({_series_sql(c, _version(c), d)}) s" for c, d in TARGETS)
_WITH_RESULTS = DETAIL + f", metric_result AS ({_RESULTS_SQL}), daily AS (SELECT metric_code, dt, sum(value::DECIMAL(24,4))::DOUBLE AS value FROM metric_result WHERE dim_type = 'tenant' GROUP BY ALL) "


@_detail("dim_shops", "SELECT shop_id, tenant_id, platform, shop_name, name AS tenant_name FROM dim_shop JOIN dim_tenant USING (tenant_id)")
def _shops(d: Detail) -> DataFrame:
    return d.dim_shop().join(d.dim_tenant().withColumnRenamed("name", "tenant_name"), "tenant_id").select("shop_id", "tenant_id", "platform", "shop_name", "tenant_name")


@_detail("catalog_products", "SELECT s.sku_id, s.spu_id, sku_name, list_price, coalesce(n, 0)::BIGINT AS mappings FROM dim_sku s LEFT JOIN (SELECT sku_id, count(*) AS n FROM map_platform_sku GROUP BY sku_id) m USING (sku_id) WHERE s.spu_id LIKE '%STEEL%' OR s.spu_id LIKE '%Brand%' ORDER BY s.sku_id LIMIT 50 OFFSET 10")
def _products(d: Detail) -> DataFrame:
    """A page of the catalog: 50 SKUs after the first 10, with how many platform codes each has."""
    counts = d.map_platform_sku().groupBy(F.col("sku_id").alias("k")).agg(F.count("*").alias("n"))
    skus = d.dim_sku().join(d.dim_spu(), "spu_id").where("spu_id like '%STEEL%' or spu_id like '%Brand%'")
    page = skus.join(counts, F.col("sku_id") == F.col("k"), "left").orderBy("sku_id").offset(10).limit(50)
    return page.select("sku_id", "spu_id", "sku_name", "list_price", F.coalesce("n", F.lit(0)).alias("mappings"))


_ORDER_COLUMNS = ("order_line_id", "tenant_id", "shop_id", "platform", "order_id", "order_status", "is_presale", "is_cancelled", "order_dt", "paid_dt", "is_valid", "invalid_reason")


@_detail("dwd_order", f"SELECT {', '.join(_ORDER_COLUMNS)}, qty::DOUBLE AS qty, pay_amount::DOUBLE AS pay_amount, freight::DOUBLE AS freight, net_amount::DOUBLE AS net_amount FROM dwd_order")
def _orders(d: Detail) -> DataFrame:
    return d.dwd_order().select(*_ORDER_COLUMNS, *(F.col(c).cast("double").alias(c) for c in ("qty", "pay_amount", "freight", "net_amount")))


@_detail("dwd_refund", "SELECT refund_id, order_id, tenant_id, shop_id, platform, refund_status, refund_dt, invalid_reason, is_valid, refund_amount::DOUBLE AS refund_amount FROM dwd_refund")
def _refunds(d: Detail) -> DataFrame:
    return d.dwd_refund().select("refund_id", "order_id", "tenant_id", "shop_id", "platform", "refund_status", "refund_dt", "invalid_reason", "is_valid", F.col("refund_amount").cast("double").alias("refund_amount"))


@_detail("dwd_cs_session", "SELECT * FROM dwd_cs_session")
def _sessions(d: Detail) -> DataFrame:
    return d.dwd_cs_session()


@_detail("invalid_reasons", "SELECT 'order' AS kind, invalid_reason, count(*) AS n FROM dwd_order GROUP BY ALL UNION ALL SELECT 'refund', invalid_reason, count(*) FROM dwd_refund GROUP BY ALL")
def _reasons(d: Detail) -> DataFrame:
    count = lambda df, kind: df.groupBy("invalid_reason").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "invalid_reason", "n")
    return count(d.dwd_order(), "order").unionByName(count(d.dwd_refund(), "refund"))


@_detail("dws_shop_day", "SELECT * FROM dws_shop_day")
def _shop_days(d: Detail) -> DataFrame:
    return d.shop_day()


@_detail("dws_tenant_day", "SELECT * FROM dws_tenant_day")
def _tenant_days(d: Detail) -> DataFrame:
    return d.tenant_day()


@_detail("snapshot_tenant_day", "SELECT * FROM dws_tenant_day")
def _snapshot(d: Detail) -> DataFrame:
    """The tenants' days from the shops' days of a snapshot, to which the next one, of shops' days alone, makes no difference."""

    def make():
        shots = Snapshots(d.spark, new_path(d.spark, "snapshots"))
        pinned = shots.published({"dws_shop_day": d.shop_day(), "dim_shop": d.dim_shop()})
        shots.published({"dws_shop_day": d.shop_day().limit(0)})
        return pinned

    pinned = once(d.spark, ("snapshot", d.sf_dir), make)
    return warehouse.tenant_day(pinned.table("dws_shop_day"))


@_detail("dws_bounds", "SELECT min(dt) AS first_dt, max(dt) AS last_dt, CAST(max(dt) - 29 AS DATE) AS window_start FROM dws_tenant_day")
def _bounds(d: Detail) -> DataFrame:
    """The days that have data, and the start of the default window of 30 days."""
    return d.tenant_day().agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.date_sub(F.max("dt"), 29).alias("window_start"))


@_detail("tenant_comparison", """SELECT tenant_id, name, order_gmv::DOUBLE AS order_gmv, paid_gmv::DOUBLE AS paid_gmv, settlement_gmv::DOUBLE AS settlement_gmv, refund_amount::DOUBLE AS refund_amount,
  CASE WHEN paid_gmv <> 0 THEN round(refund_amount::DOUBLE / paid_gmv::DOUBLE, 4) ELSE 0 END AS refund_rate, order_cnt::BIGINT AS order_cnt, cs_session_cnt::BIGINT AS cs_session_cnt, CASE WHEN order_cnt <> 0 THEN round(paid_gmv::DOUBLE / order_cnt, 2) ELSE 0 END AS aov
FROM (SELECT t.tenant_id, name, coalesce(sum(order_gmv::DECIMAL(20,2)), 0) AS order_gmv, coalesce(sum(paid_gmv::DECIMAL(20,2)), 0) AS paid_gmv, coalesce(sum(settlement_gmv::DECIMAL(20,2)), 0) AS settlement_gmv,
  coalesce(sum(refund_amount::DECIMAL(20,2)), 0) AS refund_amount, coalesce(sum(order_cnt), 0) AS order_cnt, coalesce(sum(cs_session_cnt), 0) AS cs_session_cnt FROM dim_tenant t LEFT JOIN dws_tenant_day USING (tenant_id) GROUP BY ALL) x""")
def _comparison(d: Detail) -> DataFrame:
    return warehouse.tenant_comparison(d.tenant_day(), d.dim_tenant())


@_detail("platform_split", """SELECT platform, round(paid, 2)::DOUBLE AS paid_gmv, CASE WHEN paid <> 0 THEN round(refund::DOUBLE / paid::DOUBLE, 4) ELSE 0 END AS refund_rate, order_cnt, shop_count
FROM (SELECT platform, sum(paid_gmv::DECIMAL(20,2)) AS paid, sum(refund_amount::DECIMAL(20,2)) AS refund, sum(order_cnt)::BIGINT AS order_cnt, count(DISTINCT shop_id) AS shop_count FROM dws_shop_day GROUP BY platform) x""")
def _platforms(d: Detail) -> DataFrame:
    return warehouse.platform_split(d.shop_day())


_EXACT_SQL = """, m AS (SELECT *, upper(trim(platform_sku_code)) AS code FROM map_platform_sku), m1 AS (SELECT tenant_id, platform, shop_id, code, arg_min(sku_id, id) AS sku1 FROM m GROUP BY ALL), m2 AS (SELECT tenant_id, platform, code, arg_min(sku_id, id) AS sku2 FROM m GROUP BY ALL),
o AS (SELECT *, upper(replace(replace(coalesce(platform_sku_code, ''), ' ', ''), '－', '-')) AS code FROM dwd_order),
met AS (SELECT o.*, sku1, sku2 FROM o LEFT JOIN m1 USING (tenant_id, platform, shop_id, code) LEFT JOIN m2 USING (tenant_id, platform, code)),
pool AS (SELECT tenant_id, code AS matched, arg_min(sku_id, id) AS sku_id, min(id) AS id FROM m GROUP BY ALL),
near AS (SELECT * FROM (SELECT DISTINCT tenant_id, code FROM met WHERE sku1 IS NULL AND sku2 IS NULL AND code <> '') c JOIN pool USING (tenant_id) WHERE abs(length(code) - length(matched)) * 100 <= 12 * (length(code) + length(matched)) AND levenshtein(code, matched) * 100 <= 12 * (length(code) + length(matched))),
places AS MATERIALIZED (SELECT n.*, list_transform(string_split(matched, ''), lambda x: list_sum(list_transform(range(length(code)), lambda i: CASE WHEN code[i + 1] = x THEN 1::BIGINT << i ELSE 0 END))::BIGINT) AS masks, (1::BIGINT << length(code)) - 1 AS every FROM near n),
common AS (SELECT tenant_id, code, sku_id, id, length(code) + length(matched) AS chars, length(code) - bit_count(list_reduce(list_prepend(every, masks), lambda v, x: ((v + (v & x)) | (v - (v & x))) & every)) AS shared FROM places),
best AS (SELECT tenant_id, code, arg_max(struct_pack(sku := sku_id, score := round(2 * shared / chars, 3)), struct_pack(score := 2 * shared / chars, k := -id)) AS b FROM common WHERE 200 * shared >= 88 * chars GROUP BY ALL),
resolved AS (SELECT met.*, b.sku AS sku3, b.score AS score3, CASE WHEN sku1 IS NOT NULL OR sku2 IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_type, CASE WHEN sku1 IS NOT NULL THEN 1.0 WHEN sku2 IS NOT NULL THEN 0.99 END AS exact_confidence
  FROM met LEFT JOIN best USING (tenant_id, code)) """


@_detail("sku_exact_match", _EXACT_SQL + "SELECT order_line_id, match_type, coalesce(sku1, sku2) AS exact_sku_id, exact_confidence::DOUBLE AS exact_confidence FROM resolved")
def _exact(d: Detail) -> DataFrame:
    """How each order line's code was resolved; SKU and confidence where exactly."""
    exact = F.col("match_type") == "exact"
    return d.dwd_order_sku().select("order_line_id", "match_type", F.when(exact, F.col("sku_id")).alias("exact_sku_id"), F.when(exact, F.col("map_confidence")).alias("exact_confidence"))


@_detail("sku_fuzzy_match", _EXACT_SQL + "SELECT tenant_id, platform_sku_code, sku3 AS sku_id, score3::DOUBLE AS map_confidence, count(*) AS n FROM resolved WHERE match_type = 'fuzzy' GROUP BY ALL")
def _fuzzy(d: Detail) -> DataFrame:
    """Codes that only the nearest code of the tenant resolves, with SKU and confidence."""
    return d.dwd_order_sku().where("match_type = 'fuzzy'").groupBy("tenant_id", "platform_sku_code", "sku_id", "map_confidence").agg(F.count("*").alias("n"))


@_detail("mapping_conflicts", ", m AS (SELECT *, upper(platform_sku_code) AS code FROM map_platform_sku) SELECT m.tenant_id, m.platform, m.shop_id, code, kept, sku_id AS other FROM m JOIN (SELECT tenant_id, platform, shop_id, code, arg_min(sku_id, id) AS kept FROM m GROUP BY ALL) f USING (tenant_id, platform, shop_id, code) WHERE sku_id <> kept")
def _conflicts(d: Detail) -> DataFrame:
    return Matcher(d.map_platform_sku()).conflicts()


@_detail("mapping_coverage", _EXACT_SQL + "SELECT platform, count(*) AS orders, sum((match_type <> 'none')::INT)::BIGINT AS mapped, round(sum((match_type <> 'none')::INT) / count(*), 4) AS match_rate, sum((coalesce(exact_confidence, 0) < 0.999)::INT)::BIGINT AS below_exact FROM resolved GROUP BY platform")
def _coverage(d: Detail) -> DataFrame:
    """Coverage by platform; confidences below 0.999 are counted as inexact, those of other shops and of none too."""
    mapped = F.count_if(F.col("sku_id").isNotNull())
    return d.dwd_order_sku().groupBy("platform").agg(F.count("*").alias("orders"), mapped.alias("mapped"), F.round(mapped / F.count("*"), 4).alias("match_rate"), F.count_if(F.col("map_confidence") < 0.999).alias("below_exact"))


@_detail("mapping_review", _EXACT_SQL + "SELECT tenant_id, platform, platform_sku_code, count(*) AS n FROM resolved WHERE coalesce(exact_confidence, 0) < 0.99 GROUP BY ALL")
def _review(d: Detail) -> DataFrame:
    """Codes to look over by hand (confidence below 0.99) and their order lines."""
    return d.dwd_order_sku().where("map_confidence < 0.99").groupBy("tenant_id", "platform", "platform_sku_code").agg(F.count("*").alias("n"))


def _shared_sql(name: str, pairs: str) -> str:
    """A common table of pairs (tenant_id, code, matched, sku_id, id) with score, by a bit for each character of the code."""
    return f"""{name}_at AS MATERIALIZED (SELECT n.*, list_transform(string_split(matched, ''), lambda x: list_sum(list_transform(range(length(code)), lambda i: CASE WHEN code[i + 1] = x THEN 1::BIGINT << i ELSE 0 END))::BIGINT) AS masks, (1::BIGINT << length(code)) - 1 AS every FROM {pairs} n),
{name} AS (SELECT tenant_id, code, matched, sku_id, id, 200 * (length(code) - bit_count(list_reduce(list_prepend(every, masks), lambda v, x: ((v + (v & x)) | (v - (v & x))) & every))) / (length(code) + length(matched)) AS score FROM {name}_at)"""


# Codes with three matches of 88 or more, which few edits bound, need no other comparison.
_REVIEW_SQL = _EXACT_SQL + f""", bad AS (SELECT DISTINCT tenant_id, code FROM resolved WHERE coalesce(exact_confidence, 0) < 0.99 AND platform_sku_code IS NOT NULL),
few AS (SELECT tenant_id, code, matched, sku_id, id FROM bad JOIN pool USING (tenant_id) WHERE abs(length(code) - length(matched)) * 100 <= 12 * (length(code) + length(matched)) AND levenshtein(code, matched) * 100 <= 12 * (length(code) + length(matched))),
{_shared_sql("close", "few")},
full_three AS (SELECT tenant_id, code FROM close WHERE score >= 88 GROUP BY ALL HAVING count(*) >= 3),
rest AS (SELECT tenant_id, code, matched, sku_id, id FROM bad ANTI JOIN full_three USING (tenant_id, code) JOIN pool USING (tenant_id)),
{_shared_sql("far", "rest")},
every_pair AS (SELECT * FROM close SEMI JOIN full_three USING (tenant_id, code) UNION ALL SELECT * FROM far)
SELECT tenant_id, code, rank::INTEGER AS rank, matched, round(score / 100, 3) AS score, sku_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, code ORDER BY score DESC, id) AS rank FROM every_pair) r WHERE rank <= 3"""


@_detail("mapping_review_top", _EXACT_SQL + "SELECT tenant_id, platform, platform_sku_code, count(*) AS n, max(coalesce(exact_confidence, score3, 0))::DOUBLE AS confidence FROM resolved WHERE coalesce(exact_confidence, 0) < 0.99 GROUP BY ALL ORDER BY n DESC, tenant_id, platform, platform_sku_code NULLS LAST LIMIT 30")
def _review_top(d: Detail) -> DataFrame:
    """The thirty codes to look over that most order lines have, with their greatest confidence."""
    codes = d.dwd_order_sku().where("map_confidence < 0.99").groupBy("tenant_id", "platform", "platform_sku_code").agg(F.count("*").alias("n"), F.max("map_confidence").alias("confidence"))
    return codes.orderBy(F.desc("n"), "tenant_id", "platform", F.col("platform_sku_code").asc_nulls_last()).limit(30)


@_detail("review_candidates", _REVIEW_SQL)
def _candidates(d: Detail) -> DataFrame:
    """The three most similar codes for each code that no exact rule resolves."""
    matcher = Matcher(d.map_platform_sku())
    bad = d.dwd_order_sku().where("map_confidence < 0.99 and platform_sku_code is not null").select("tenant_id", normalize_code(F.col("platform_sku_code")).alias("code"))
    return matcher.candidates(bad)


@_detail("match_stats", _EXACT_SQL + "SELECT match_type, count(*) AS n FROM resolved GROUP BY ALL")
def _match_stats(d: Detail) -> DataFrame:
    return d.dwd_order_sku().groupBy("match_type").agg(F.count("*").alias("n"))


for _m in DEFINITIONS:
    for _dim in ("tenant", "shop", "platform"):
        if _dim == "tenant" or _dim == "shop" and _m.code in ("GMV_SETTLE", "CS_SATISFACTION_AVG") or _dim == "platform" and _m.code in ("GMV_PAID", "REFUND_RATE"):
            _name = f"metric_{_m.code.lower()}_{_m.version.replace('.', '_')}_{_dim}"
            _sql = f"SELECT dt, tenant_id, dim_value, round(value, 4) AS value FROM ({_series_sql(_m.code, _m.version, _dim)}) s"
            _detail(_name, _sql)(lambda d, m=_m, dim=_dim: d.engine().series(m.code, m.version, dim=dim, start=START, end=END).withColumn("value", F.round("value", 4)))


def _total_sql(code: str, version: str, start: date = START, end: date = END) -> str:
    if code in _FORMULAS:
        a, op, b = _FORMULAS[code]
        value = f"a.value {op} b.value" if op != "/" else "a.value / nullif(b.value, 0)"
        return f"SELECT {value} AS value FROM ({_total_sql(a, 'v1.0', start, end)}) a, ({_total_sql(b, 'v1.0', start, end)}) b"
    source, day, agg, condition = _SIMPLE_SQL[code, version]
    return f"SELECT {agg} AS value FROM {source} WHERE ({condition}) AND {day} BETWEEN DATE '{start}' AND DATE '{end}'"


_TOTALS_SQL = " UNION ALL ".join(f"SELECT '{m.code}' AS metric_code, '{m.version}' AS caliber_version, round(value, 4) AS value FROM ({_total_sql(m.code, m.version)}) t" for m in DEFINITIONS)


@_detail("metric_totals", _TOTALS_SQL)
def _totals(d: Detail) -> DataFrame:
    """Every metric over the whole period, aggregated from the detail."""
    wanted = [(m.code, m.version, START, END) for m in DEFINITIONS]
    return d.engine().totals(wanted).select("metric_code", "caliber_version", F.round("value", 4).alias("value"))


def _compare_sql(code: str, kind: str) -> str:
    s, e = shifted(*MONTH, kind)
    at = lambda a, b: _total_sql(code, Dictionary().resolve(code, b).version, a, b)
    return f"""SELECT '{code}' AS metric_code, '{kind}' AS compare, DATE '{s}' AS previous_start, DATE '{e}' AS previous_end, n AS total, p AS previous_total, round(n - p, 4) AS delta, round(round(n - p, 4) / nullif(abs(p), 0), 4) AS delta_pct
FROM (SELECT round(value, 4) AS n FROM ({at(*MONTH)}) x) x, (SELECT round(value, 4) AS p FROM ({at(s, e)}) y) y"""


_COMPARED = tuple((c, k) for c in ("GMV_PAID", "AOV_PAID", "ORDER_CNT") for k in ("mom", "yoy"))


@_detail("metric_compare", " UNION ALL ".join(_compare_sql(c, k) for c, k in _COMPARED))
def _compare(d: Detail) -> DataFrame:
    """A month against the one before and the same a year before."""
    return d.engine().comparisons(list(_COMPARED), *MONTH)


_PAGE = (40, 20)


@_detail("metric_points_page", f"""SELECT dt, tenant_id, dim_value, value, place, total FROM (SELECT *, row_number() OVER (ORDER BY dt, tenant_id, dim_value) AS place FROM (SELECT dt, tenant_id, dim_value, round(value, 4) AS value FROM ({_points_sql("GMV_PAID", "v1.1", "platform")}) p WHERE dim_value IN ('jd', 'tmall')) q) r, (SELECT round(value, 4) AS total FROM ({_total_sql("GMV_PAID", "v1.1")}) t) t WHERE place BETWEEN {_PAGE[0] + 1} AND {_PAGE[0] + _PAGE[1]}""")
def _points_page(d: Detail) -> DataFrame:
    """A page of the points of two platforms in order, beside the total of all, which the choice of platforms doesn't touch."""
    engine, window = d.engine(), {"start": START, "end": END}
    points = engine.series("GMV_PAID", dim="platform", **window).where(F.col("dim_value").isin("jd", "tmall")).withColumn("value", F.round("value", 4))
    page = Pages(points, "dt", "tenant_id", "dim_value").page(*_PAGE)
    # One row.
    return page.crossJoin(F.broadcast(engine.total("GMV_PAID", **window).select(F.round("value", 4).alias("total"))))


@_detail("dashboard_summary", """SELECT CASE grouping(dt, tenant_id, platform) WHEN 7 THEN 'all' WHEN 3 THEN 'day' WHEN 5 THEN 'tenant' ELSE 'platform' END AS part, dt, tenant_id, platform, round(sum(order_gmv::DECIMAL(20,2)), 2)::DOUBLE AS order_gmv, round(sum(paid_gmv::DECIMAL(20,2)), 2)::DOUBLE AS paid_gmv,
  round(sum(settlement_gmv::DECIMAL(20,2)), 2)::DOUBLE AS settlement_gmv, round(sum(refund_amount::DECIMAL(20,2)), 2)::DOUBLE AS refund_amount, sum(order_cnt)::BIGINT AS order_cnt, sum(cs_session_cnt)::BIGINT AS cs_session_cnt, count(DISTINCT shop_id) AS shop_count,
  CASE WHEN sum(paid_gmv::DECIMAL(20,2)) <> 0 THEN round(sum(refund_amount::DECIMAL(20,2))::DOUBLE / sum(paid_gmv::DECIMAL(20,2))::DOUBLE, 4) ELSE 0 END AS refund_rate, CASE WHEN sum(order_cnt) <> 0 THEN round(sum(paid_gmv::DECIMAL(20,2))::DOUBLE / sum(order_cnt), 2) ELSE 0 END AS aov
FROM dws_shop_day WHERE dt > (SELECT max(dt) FROM dws_shop_day) - 30 GROUP BY GROUPING SETS ((), (dt), (tenant_id), (platform))""")
def _dashboard(d: Detail) -> DataFrame:
    """The last thirty days that have data: all, by day, by tenant and by platform."""
    return warehouse.dashboard(d.shop_day())


@_detail("metric_result", f"SELECT * FROM ({_RESULTS_SQL}) r")
def _results(d: Detail) -> DataFrame:
    return d.results()


@_query("metric_daily", _WITH_RESULTS + "SELECT * FROM daily")
def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_series(Detail(spark, sf_dir).results())


@_query("metric_kpis", _WITH_RESULTS + "SELECT metric_code, CASE WHEN metric_code IN ('REFUND_RATE', 'CS_BOT_RATIO', 'CS_FIRST_RESP_AVG', 'CS_SATISFACTION_AVG') THEN round(sum(value::DECIMAL(24,4))::DOUBLE / count(*), 4) ELSE round(sum(value::DECIMAL(24,4)), 2)::DOUBLE END AS value FROM daily GROUP BY metric_code")
def _kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis(daily_series(Detail(spark, sf_dir).results()))


@_query("metric_volume", _WITH_RESULTS + """, n AS (SELECT dt, count(*) AS n FROM metric_result GROUP BY dt), w AS (SELECT dt, n, sum(n) OVER b AS s, count(n) OVER b AS k FROM n WINDOW b AS (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT dt, n, round(s / k, 4) AS mean_before, CASE WHEN n < s / k * 0.5 THEN 'error' WHEN n > s / k * 2 THEN 'warn' ELSE 'pass' END AS level FROM w WHERE k >= 2""")
def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.volume(Detail(spark, sf_dir).results())


@_query("metric_negatives", _WITH_RESULTS + "SELECT metric_code, min(value) AS least FROM metric_result WHERE metric_code IN ('GMV_ORDER', 'GMV_PAID', 'GMV_SETTLE', 'REFUND_AMOUNT') GROUP BY 1 HAVING min(value) < 0")
def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.negatives(Detail(spark, sf_dir).results(), AMOUNTS)


_BEFORE = "n AS (SELECT dt, count(*) AS n FROM metric_result GROUP BY dt), w AS (SELECT dt, n, sum(n) OVER b AS s, count(n) OVER b AS k FROM n WINDOW b AS (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)), last AS (SELECT * FROM w WHERE k >= 2 AND dt = (SELECT max(dt) FROM n))"
_VALID_DEFS = ", ".join(f"('{m.code}', '{m.version}', DATE '{m.start}', {f"DATE '{m.end}'" if m.end else 'NULL'})" for m in DEFINITIONS)


@_query("metric_unknown_versions", _WITH_RESULTS + f"SELECT DISTINCT metric_code, caliber_version FROM metric_result WHERE (metric_code, caliber_version) NOT IN (SELECT (c, v) FROM (VALUES {_VALID_DEFS}) d(c, v, a, b) WHERE v = 'v1.0')")
def _ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in the results that a dictionary of first versions lacks."""
    first = Dictionary(tuple(m for m in DEFINITIONS if m.version == "v1.0")).frame(spark)
    return checks.unknown_versions(Detail(spark, sf_dir).results(), first)


@_query("metric_verdict", _WITH_RESULTS + ", " + _BEFORE + f""", found AS (SELECT (SELECT count(*) FROM last WHERE n < s / k * 0.5) AS volume_errors, (SELECT count(*) FROM last WHERE n > s / k * 2) AS volume_warnings,
  (SELECT least(count(*), 1) FROM metric_result WHERE (metric_code, caliber_version) NOT IN (SELECT (c, v) FROM (VALUES {_VALID_DEFS}) d(c, v, a, b))) AS version_errors, (SELECT count(*) FROM (SELECT metric_code FROM metric_result WHERE metric_code IN ('GMV_ORDER', 'GMV_PAID', 'GMV_SETTLE', 'REFUND_AMOUNT') GROUP BY 1 HAVING min(value) < 0)) AS negative_errors)
SELECT CASE WHEN volume_errors + version_errors + negative_errors > 0 THEN 'fail' WHEN volume_warnings > 0 THEN 'warn' ELSE 'pass' END AS verdict, volume_errors + version_errors + negative_errors AS failed, volume_warnings AS warned, * FROM found""")
def _verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three checks of what was materialized as one verdict."""
    return checks.verified(Detail(spark, sf_dir).results(), Dictionary().frame(spark), AMOUNTS)


_NOTICES = ", ".join(f"('{m.code}', '{m.version}', 'version {m.version} ({m.start} to {m.end or 'now'}): {m.name}, in {m.unit}')" for m in DEFINITIONS)


@_query("metric_notices", _WITH_RESULTS + f"SELECT metric_code, caliber_version, notice, count(*) AS points FROM metric_result JOIN (VALUES {_NOTICES}) n(metric_code, caliber_version, notice) USING (metric_code, caliber_version) GROUP BY ALL")
def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the versions of the stored points mean, beside how many points each has."""
    used = Detail(spark, sf_dir).results().groupBy("metric_code", "caliber_version").agg(F.count("*").alias("points"))
    return used.join(notices(Dictionary().frame(spark)), ["metric_code", "caliber_version"]).select("metric_code", "caliber_version", "notice", "points")


@_query("metric_versions", f"SELECT as_of, metric_code, caliber_version FROM (SELECT x::DATE AS as_of, c AS metric_code, v AS caliber_version, row_number() OVER (PARTITION BY x, c ORDER BY a DESC, v DESC) AS k FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS x FROM orders) o, (VALUES {_VALID_DEFS}) d(c, v, a, b) WHERE a <= x AND (b IS NULL OR x <= b)) y WHERE k = 1")
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each metric in force on each day of orders."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    return in_force(Dictionary().frame(spark), days)


_DQ_SQL = DETAIL + _EXACT_SQL + """, dq AS (
  SELECT 'DQ001' AS rule_id, 'raw_order' AS table_name, 'error' AS severity, count(*) AS n, count(*) FILTER (WHERE NOT (pay_amount IS NOT NULL)) AS f FROM raw_order
  UNION ALL SELECT 'DQ002', 'raw_order', 'error', count(*), count(*) FILTER (WHERE NOT (pay_amount > 0)) FROM raw_order
  UNION ALL SELECT 'DQ003', 'raw_order', 'warn', count(*), count(*) FILTER (WHERE NOT (qty > 0 AND qty <= 100)) FROM raw_order
  UNION ALL SELECT 'DQ004', 'raw_refund', 'error', count(*), count(*) FILTER (WHERE NOT (refund_amount > 0 AND refund_amount <= most)) FROM raw_refund LEFT JOIN (SELECT order_id, max(pay_amount) AS most FROM raw_order GROUP BY 1) o USING (order_id)
  UNION ALL SELECT 'DQ005', 'dwd_order', 'warn', count(*), count(*) FILTER (WHERE coalesce(sku1, sku2, sku3) IS NULL) FROM resolved
  UNION ALL SELECT 'DQ006', 'dwd_order', 'error', count(*), count(*) FILTER (WHERE NOT (net_amount >= 0)) FROM dwd_order
) """


@_query("dq_results", _DQ_SQL + "SELECT rule_id, table_name, severity, n AS checked_rows, f AS failed_rows, round((n - f) / n, 6) AS pass_rate, CASE WHEN f = 0 THEN 'pass' ELSE severity END AS status FROM dq")
def _dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Detail(spark, sf_dir).quality()


@_query("dq_summary", _DQ_SQL + "SELECT count(*) AS rules, count(*) FILTER (WHERE f > 0) AS failed_rules, round(1 - sum(f) / sum(n), 6) AS overall_pass_rate, CASE WHEN bool_or(f > 0 AND severity = 'error') THEN 'hold' WHEN bool_or(f > 0) THEN 'degraded' ELSE 'pass' END AS gate FROM dq")
def _dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.summary(Detail(spark, sf_dir).quality())


def _run_sql(rule: str, name: str, severity: str, rows: str, day: str, bad: str) -> str:
    return f"SELECT strftime({day}, '%Y-%m') AS run_id, '{rule}' AS rule_id, '{name}' AS table_name, '{severity}' AS severity, count(*) AS n, count(*) FILTER (WHERE NOT ({bad})) AS f FROM {rows} GROUP BY 1"


_CAPPED = "(SELECT r.*, most AS order_max FROM raw_refund r LEFT JOIN (SELECT order_id, max(pay_amount) AS most FROM raw_order GROUP BY 1) o USING (order_id))"
_RUN_ROWS = {"raw_order": ("raw_order", "created_at"), "raw_refund": (_CAPPED, "refund_dt"), "dwd_order": ("(SELECT d.*, coalesce(sku1, sku2, sku3) AS sku_id FROM resolved d)", "order_dt")}
_RUNS_SQL = (
    DETAIL + _EXACT_SQL + ", runs AS (" + " UNION ALL ".join(_run_sql(r.id, r.table, r.severity, *_RUN_ROWS[r.table], r.predicate) for r in checks.RULES) + """),
rated AS (SELECT *, round((n - f) / n, 6) AS pass_rate, CASE WHEN f = 0 THEN 'pass' ELSE severity END AS status FROM runs) """
)


@_query("dq_history", _RUNS_SQL + "SELECT run_id, count(*) AS rules, count(*) FILTER (WHERE f > 0) AS failed_rules, round(1 - sum(f) / sum(n), 6) AS overall_pass_rate, CASE WHEN bool_or(status = 'error') THEN 'hold' WHEN bool_or(status = 'warn') THEN 'degraded' ELSE 'pass' END AS gate, round(sum(pass_rate::DECIMAL(20,6))::DOUBLE / count(*), 6) AS mean_pass_rate FROM rated GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def _dq_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten runs of the log of quality results."""
    return checks.history(Detail(spark, sf_dir).quality_log()).orderBy(F.desc("run_id")).limit(10)


@_query("dq_latest_run", _RUNS_SQL + "SELECT run_id, rule_id, table_name, severity, n AS checked_rows, f AS failed_rows, pass_rate, status FROM rated WHERE run_id = (SELECT max(run_id) FROM rated)")
def _dq_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's result in the latest run."""
    return checks.latest_run(Detail(spark, sf_dir).quality_log())


@_detail("dq_failing_orders", "SELECT order_line_id, tenant_id, pay_amount::DOUBLE AS pay_amount FROM raw_order WHERE NOT (pay_amount > 0) AND tenant_id = 'T1' ORDER BY order_line_id LIMIT 20")
def _failing(d: Detail) -> DataFrame:
    found = checks.failing(d.raw_order(), checks.RULES[1], 20, "T1", "order_line_id")
    return found.select("order_line_id", "tenant_id", F.col("pay_amount").cast("double").alias("pay_amount"))


@_detail("dq_repeated_sessions", "SELECT session_id, count(*) AS n FROM raw_cs_session GROUP BY 1 HAVING count(*) > 1")
def _repeated(d: Detail) -> DataFrame:
    return checks.duplicates(d.raw_cs_session(), "session_id")


_COUNTED = ("dim_tenant", "dim_shop", "dim_sku", "map_platform_sku", "raw_order", "raw_refund", "raw_cs_session", "kb_document")


@_detail("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNTED))
def _counts(d: Detail) -> DataFrame:
    return checks.row_counts({t: getattr(d, t)() for t in _COUNTED})


@_query("lineage_edges", None)
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.all_edges(spark, Dictionary().frame(spark))


@_query("lineage_upstream", "SELECT * FROM (VALUES ('GMV_PAID', 1), ('REFUND_AMOUNT', 1), ('dwd_order', 2), ('dwd_refund', 2), ('raw_order', 3), ('map_platform_sku', 3), ('raw_refund', 3)) v(node, distance)")
def _upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the settled GMV comes from."""
    return lineage.upstream(lineage.all_edges(spark, Dictionary().frame(spark)), "GMV_SETTLE")


_CODES = "concat_ws(' ', p_brand, '－', p_partkey, p_type)"


@_query("code_normalizing", f"SELECT p_partkey, upper(replace(replace({_CODES}, ' ', ''), '－', '-')) AS code, regexp_replace(upper({_CODES}), '[^0-9A-Z]', '', 'g') AS barcode, replace({_CODES}, '－', '-') AS text, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS number FROM part")
def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws(" ", "p_brand", F.lit("－"), "p_partkey", "p_type")
    spelled = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, "--").otherwise(F.concat("p_size", F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", normalize_code(raw).alias("code"), normalize_barcode(raw).alias("barcode"), normalize_text(raw).alias("text"), extract_numeric(spelled).alias("number"))


@_query("tenant_policy", "SELECT * FROM (VALUES ('admin', NULL, NULL, TRUE, NULL), ('admin', NULL, 'T1', TRUE, 'T1'), ('brand', 'T1', NULL, TRUE, 'T1'), ('brand', 'T1', 'T1', TRUE, 'T1'), ('brand', 'T1', 'T2', FALSE, NULL), ('brand', NULL, 'T1', FALSE, NULL), ('ops', NULL, NULL, FALSE, NULL), ('ops', NULL, 'T2', TRUE, 'T2'), ('guest', NULL, 'T1', FALSE, NULL)) v(role, own, asked, allowed, tenant_id)")
def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenant that each role gets for what it asks."""
    rows = []
    for role, own, asked in (("admin", None, None), ("admin", None, "T1"), ("brand", "T1", None), ("brand", "T1", "T1"), ("brand", "T1", "T2"), ("brand", None, "T1"), ("ops", None, None), ("ops", None, "T2"), ("guest", None, "T1")):
        try:
            rows.append((role, own, asked, True, policy.resolve_tenant(role, own, asked)))
        except policy.Denied:
            rows.append((role, own, asked, False, None))
    return spark.createDataFrame(rows, "role string, own string, asked string, allowed boolean, tenant_id string")


@_detail("tenant_paid_by_status", "SELECT shop_id, order_status, count(*) AS n, sum(pay_amount)::DOUBLE AS paid FROM dwd_order WHERE tenant_id = 'T2' AND is_valid GROUP BY ALL")
def _one_tenant(d: Detail) -> DataFrame:
    """One tenant's rows only, through the policy."""
    tenant = policy.resolve_tenant("brand", "T2", None)
    return d.dwd_order().where(policy.tenant_predicate(tenant)).where("is_valid").groupBy("shop_id", "order_status").agg(F.count("*").alias("n"), F.sum("pay_amount").cast("double").alias("paid"))
