"""The commerce tables as views of the benchmark's tables.

Suppliers are shops, regions tenants, order lines raw orders, returned lines
refunds, events service sessions, documents knowledge documents. Dirt (nulls,
negative amounts, odd spellings of codes, repeated sessions) is put in by rule,
so that every run sees the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Platforms by shop number modulo six.
PLATFORMS = ("tmall", "jd", "douyin", "pdd", "xhs", "wechat_mini")
#: Ids of mappings by shop: two for each SKU.
IDS = 100_000_000_000
#: Days from events to service sessions: those of January 2024 come to March 1997, within the orders' years.
SHIFT = 9802


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Commerce:
    """Lazily built tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def dim_tenant(self) -> DataFrame:
        return self._t("region").select(F.concat(F.lit("T"), F.col("r_regionkey")).alias("tenant_id"), F.col("r_name").alias("name"))

    def dim_shop(self) -> DataFrame:
        shop = self._t("supplier").join(self._t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        platform = F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.col("s_suppkey") % 6 + 1).cast("int"))
        return shop.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("shop_id"), F.concat(F.lit("T"), F.col("n_regionkey")).alias("tenant_id"), platform.alias("platform"), F.col("s_name").alias("shop_name"), F.col("s_suppkey").alias("shop_no"))

    def dim_spu(self) -> DataFrame:
        return self._t("part").select(F.concat_ws("/", "p_brand", "p_type").alias("spu_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category")).distinct()

    def dim_sku(self) -> DataFrame:
        """A SKU for each part."""
        part = self._t("part")
        return part.select(_sku_id(F.col("p_partkey")).alias("sku_id"), F.col("p_partkey").alias("sku_no"), F.concat_ws("/", "p_brand", "p_type").alias("spu_id"), F.col("p_name").alias("sku_name"), F.col("p_retailprice").alias("list_price"))

    def map_platform_sku(self) -> DataFrame:
        """A row for most of the SKUs that a shop has sold; some lack, some have a second row that contradicts the first."""
        sold = self._t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("sku_no")).distinct()
        each = self.dim_shop().join(sold, F.col("shop_no") == F.col("k"))
        each = each.where(((F.col("shop_no") + F.col("sku_no")) % 7 != 0) & (F.col("sku_no") % 40 != 13))
        code = _code(F.col("platform"), F.col("sku_no"))
        rows = F.array(F.struct(F.lit(0).alias("k"), code.alias("c"), _sku_id(F.col("sku_no")).alias("s")), F.struct(F.lit(1).alias("k"), F.lower(code).alias("c"), F.concat(F.lit("ALT"), F.col("sku_no")).alias("s")))
        both = each.select("*", F.explode(F.when(F.col("sku_no") % 50 == 5, rows).otherwise(F.slice(rows, 1, 1))).alias("r"))
        return both.select((F.col("shop_no") * IDS + F.col("sku_no") * 2 + F.col("r.k")).alias("id"), "tenant_id", "platform", "shop_id", F.col("r.c").alias("platform_sku_code"), F.col("r.s").alias("sku_id"))

    def raw_order(self) -> DataFrame:
        lines = self._t("lineitem").join(self._t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        shop = self.dim_shop().select("shop_id", "tenant_id", "platform", "shop_no")
        met = lines.join(shop, F.col("l_suppkey") == F.col("shop_no"))
        price = (F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
        dirt = F.col("l_partkey") % 500
        sku_no = F.col("l_partkey")
        code, kind = _code(F.col("platform"), sku_no), F.col("l_partkey") % 50
        spelled = F.when(kind == 1, F.lower(code)).when(kind == 2, F.concat(F.lit("  "), code, F.lit(" "))).when(kind == 3, F.translate(code, "-", "－")).when(kind == 4, F.expr("substring(c, 1, length(c) - 1)")).when(kind == 5, F.lit(None)).otherwise(code)
        return met.withColumn("c", code).select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("order_line_id"), "tenant_id", "shop_id", "platform", F.concat(F.lit("O"), F.col("l_orderkey")).alias("order_id"),
            sku_no.alias("sku_no"), spelled.alias("platform_sku_code"), F.col("l_quantity").cast("decimal(10,2)").alias("qty"),
            F.when(dirt == 7, F.lit(None)).when(dirt == 11, -price).otherwise(price).cast("decimal(18,4)").alias("pay_amount"),
            F.when(F.col("l_quantity") < 10, 12).otherwise(0).cast("decimal(10,2)").alias("freight"),
            F.when(F.col("o_orderstatus") == "P", "cancelled").when(F.col("o_orderstatus") == "F", "received").otherwise("paid").alias("order_status"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_presale"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "P", F.col("l_shipdate")).alias("paid_at"), "l_returnflag",
        )

    def raw_refund(self) -> DataFrame:
        half = F.when(F.col("sku_no") % 200 == 199, F.lit(None)).when(F.col("sku_no") % 97 == 3, F.col("pay_amount") * 2).otherwise(F.col("pay_amount") * F.lit(0.5).cast("decimal(2,1)"))
        return self.raw_order().where("l_returnflag = 'R'").select(
            F.concat(F.lit("R-"), F.col("order_line_id")).alias("refund_id"), "order_id", "tenant_id", "shop_id", "platform", half.cast("decimal(18,5)").alias("refund_amount"),
            F.when(F.col("sku_no") % 10 == 0, "processing").otherwise("success").alias("refund_status"), F.date_add(F.to_date("created_at"), 5).alias("refund_dt"),
        )

    def raw_cs_session(self) -> DataFrame:
        shop = self.dim_shop().select("shop_id", "tenant_id", "shop_no")
        copies = F.when(F.col("event_id") % 200 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        each = self._t("events").select("*", F.explode(copies).alias("copy_no")).join(shop, F.col("user_id") % 10 == F.col("shop_no"))
        value, k = F.col("value").cast("decimal(12,2)"), F.col("event_id")
        return each.select(
            F.concat(F.lit("CS"), k).alias("session_id"), "shop_id", "tenant_id", (F.col("user_id") % 3 != 0).alias("is_bot"),
            F.when(k % 200 == 9, F.lit(None)).when(k % 200 == 5, -value).otherwise(value).alias("first_response_sec"),
            F.when(k % 10 == 0, F.lit(None)).when(k % 150 == 4, 9).otherwise(1 + k % 5).cast("int").alias("satisfaction"),
            (F.col("event_type") != "error").alias("resolved"), F.col("event_type").alias("intent_l1"), F.date_sub(F.to_date("ts"), SHIFT).alias("session_dt"), "copy_no",
        )

    def kb_document(self) -> DataFrame:
        """Every third document names a numbered one at its beginning and a brand."""
        kind = F.element_at(F.array(*map(F.lit, ("cs_faq", "product", "policy", "sop"))), (F.col("doc_id") % 4 + 1).cast("int"))
        named = F.concat(F.lit("See POLICY-"), F.col("doc_id") % 50, F.lit(" of NOVA! "), F.coalesce("text", F.lit("")))
        content = F.when(F.col("doc_id") % 3 == 0, named).otherwise(F.col("text"))
        return self._t("documents").select(F.concat(F.lit("D"), F.col("doc_id")).alias("doc_id"), F.concat(F.lit("T"), F.col("doc_id") % 5).alias("tenant_id"), kind.alias("kb_type"), F.col("source").alias("title"), content.alias("content"), F.col("doc_id").alias("doc_no"))


def _sku_id(no) -> Column:
    return F.concat(F.lit("SKU"), no)


def _code(platform, no) -> Column:
    return F.concat(F.upper(platform), F.lit("-"), F.lpad(no.cast("string"), F.greatest(F.lit(7), F.length(no.cast("string"))), "0"))


#: The same tables in DuckDB's SQL, as common table expressions.
SQL = """
dim_tenant AS (SELECT 'T' || r_regionkey AS tenant_id, r_name AS name FROM region),
dim_shop AS (
  SELECT 'S' || s_suppkey AS shop_id, 'T' || n_regionkey AS tenant_id, ['tmall', 'jd', 'douyin', 'pdd', 'xhs', 'wechat_mini'][s_suppkey % 6 + 1] AS platform, s_name AS shop_name, s_suppkey AS shop_no
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
dim_sku AS (
  SELECT 'SKU' || p_partkey AS sku_id, p_partkey AS sku_no, p_brand || '/' || p_type AS spu_id, p_name AS sku_name, p_retailprice AS list_price FROM part
),
map_once AS (
  SELECT s.*, sku_no, upper(platform) || '-' || lpad(sku_no::VARCHAR, greatest(7, length(sku_no::VARCHAR))::INT, '0') AS code FROM dim_shop s JOIN (SELECT DISTINCT l_suppkey, l_partkey AS sku_no FROM lineitem) n ON shop_no = l_suppkey
  WHERE (shop_no + sku_no) % 7 <> 0 AND sku_no % 40 <> 13
),
map_platform_sku AS (
  SELECT shop_no * 100000000000 + sku_no * 2 AS id, tenant_id, platform, shop_id, code AS platform_sku_code, 'SKU' || sku_no AS sku_id FROM map_once
  UNION ALL SELECT shop_no * 100000000000 + sku_no * 2 + 1, tenant_id, platform, shop_id, lower(code), 'ALT' || sku_no FROM map_once WHERE sku_no % 50 = 5
),
raw_order AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS order_line_id, tenant_id, shop_id, platform, 'O' || l_orderkey AS order_id, l_partkey AS sku_no,
    CASE l_partkey % 50 WHEN 1 THEN lower(code) WHEN 2 THEN '  ' || code || ' ' WHEN 3 THEN replace(code, '-', '－') WHEN 4 THEN code[:-2] WHEN 5 THEN NULL ELSE code END AS platform_sku_code,
    CAST(l_quantity AS DECIMAL(10,2)) AS qty,
    CASE l_partkey % 500 WHEN 7 THEN NULL WHEN 11 THEN -1 ELSE 1 END * CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS pay_amount,
    CASE WHEN l_quantity < 10 THEN CAST(12 AS DECIMAL(10,2)) ELSE CAST(0 AS DECIMAL(10,2)) END AS freight,
    CASE o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'F' THEN 'received' ELSE 'paid' END AS order_status, o_orderpriority = '1-URGENT' AS is_presale,
    o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN l_shipdate END AS paid_at, l_returnflag
  FROM (SELECT *, upper(platform) || '-' || lpad(l_partkey::VARCHAR, greatest(7, length(l_partkey::VARCHAR))::INT, '0') AS code FROM lineitem JOIN dim_shop ON shop_no = l_suppkey) l JOIN orders ON l_orderkey = o_orderkey
),
raw_refund AS (
  SELECT 'R-' || order_line_id AS refund_id, order_id, tenant_id, shop_id, platform,
    CASE WHEN sku_no % 200 = 199 THEN NULL WHEN sku_no % 97 = 3 THEN CAST(pay_amount * 2 AS DECIMAL(18,5)) ELSE CAST(pay_amount * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,5)) END AS refund_amount,
    CASE WHEN sku_no % 10 = 0 THEN 'processing' ELSE 'success' END AS refund_status, CAST(CAST(created_at AS DATE) + 5 AS DATE) AS refund_dt
  FROM raw_order WHERE l_returnflag = 'R'
),
raw_cs_session AS (
  SELECT 'CS' || event_id AS session_id, shop_id, tenant_id, user_id % 3 <> 0 AS is_bot,
    CASE WHEN event_id % 200 = 9 THEN NULL WHEN event_id % 200 = 5 THEN -1 * CAST(value AS DECIMAL(12,2)) ELSE CAST(value AS DECIMAL(12,2)) END AS first_response_sec,
    CAST(CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 150 = 4 THEN 9 ELSE 1 + event_id % 5 END AS INTEGER) AS satisfaction,
    event_type <> 'error' AS resolved, event_type AS intent_l1, CAST(CAST(ts AS DATE) - 9802 AS DATE) AS session_dt, copy_no
  FROM events JOIN (SELECT 0 AS copy_no UNION ALL SELECT 1) d ON copy_no = 0 OR event_id % 200 = 0 JOIN dim_shop ON shop_no = user_id % 10
),
kb_document AS (
  SELECT 'D' || doc_id AS doc_id, 'T' || (doc_id % 5) AS tenant_id, ['cs_faq', 'product', 'policy', 'sop'][doc_id % 4 + 1] AS kb_type, source AS title,
    CASE WHEN doc_id % 3 = 0 THEN 'See POLICY-' || (doc_id % 50) || ' of NOVA! ' || coalesce(text, '') ELSE text END AS content, doc_id AS doc_no FROM documents
)"""
