"""Cleaned detail tables (no row is dropped but repeated sessions) and daily rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Amounts are summed as decimals, so that sums don't depend on their order.
MONEY = "decimal(18,4)"


def clean_orders(raw: DataFrame) -> DataFrame:
    """Adds order_dt, paid_dt, is_cancelled, invalid_reason, is_valid, and amounts with fallback: net of freight, after the fallback."""
    pay = F.col("pay_amount")
    reason = F.when(pay.isNull(), "pay_amount_null").when(pay <= 0, "pay_amount_not_positive").when((F.col("qty") <= 0) | (F.col("qty") > 100), "qty_out_of_range")
    amount = F.when(pay.isNull() | (pay <= 0), 0).otherwise(pay).cast(MONEY)
    kept = [c for c in raw.columns if c != "pay_amount"]
    return raw.select(*kept, reason.alias("invalid_reason"), reason.isNull().alias("is_valid"), amount.alias("pay_amount"), F.round(amount - F.col("freight"), 2).cast("decimal(18,2)").alias("net_amount"), F.to_date("created_at").alias("order_dt"), F.to_date("paid_at").alias("paid_dt"), (F.col("order_status") == "cancelled").alias("is_cancelled"))


def clean_refunds(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """Adds cap (the order's greatest cleaned amount), invalid_reason, is_valid and the amount with fallback."""
    caps = orders.groupBy(F.col("order_id").alias("cap_order")).agg(F.max("pay_amount").alias("cap"))
    met = raw.join(caps, F.col("order_id") == F.col("cap_order"), "left").drop("cap_order")
    amount = F.col("refund_amount")
    over = F.col("cap").isNotNull() & (amount > F.col("cap") + F.lit("0.01").cast("decimal(3,2)"))
    reason = F.when(amount.isNull(), "refund_amount_null").when(amount <= 0, "refund_amount_not_positive").when(over, "refund_exceeds_order_amount")
    kept = [c for c in met.columns if c != "refund_amount"]
    return met.select(*kept, reason.alias("invalid_reason"), reason.isNull().alias("is_valid"), F.when(amount.isNull() | (amount <= 0), 0).otherwise(amount).cast("decimal(18,5)").alias("refund_amount"))


def clean_sessions(raw: DataFrame, order: str = "copy_no") -> DataFrame:
    """The first row of each session_id by ``order``; response times below zero or null are 0, satisfaction outside 1 to 5 is null."""
    first = F.row_number().over(W.partitionBy("session_id").orderBy(order))
    once = raw.withColumn("rn", first).where("rn = 1").drop("rn", order)
    response, rating = F.col("first_response_sec"), F.col("satisfaction")
    return once.withColumn("first_response_sec", F.when(response.isNull() | (response < 0), 0).otherwise(response).cast("double")).withColumn("satisfaction", F.when(rating.between(1, 5), rating))


#: Columns of the shop's day, in order.
COUNTS = ("order_cnt", "paid_cnt", "refund_cnt", "cs_session_cnt", "cs_bot_cnt", "cs_resolved_cnt", "cs_satisfaction_cnt")
SUMS = ("order_gmv", "paid_gmv", "refund_amount", "cs_first_response_sum", "cs_satisfaction_sum")


def shop_day(orders: DataFrame, refunds: DataFrame, sessions: DataFrame, shops: DataFrame) -> DataFrame:
    """A row per day and shop with any activity. Orders count on their order day and again on their day of payment.

    The four kinds of rows are put under each other and summed once. Tenant and
    platform come from the shop alone, empty where it is unknown.
    """
    one, none = F.lit(1), F.lit(None)

    def rows(df: DataFrame, day: str, **values) -> DataFrame:
        columns = [(values.get(c, none)).cast("long").alias(c) for c in COUNTS] + [(values.get(c, none)).cast("decimal(20,5)").alias(c) for c in SUMS]
        return df.select(F.col(day).alias("dt"), "shop_id", *columns)

    valid = orders.where("is_valid")
    kinds = (
        rows(valid.where("not is_cancelled"), "order_dt", order_cnt=one, order_gmv=F.col("pay_amount")),
        rows(valid.where("paid_dt is not null and order_status <> 'cancelled'"), "paid_dt", paid_cnt=one, paid_gmv=F.col("pay_amount")),
        rows(refunds.where("is_valid and refund_status = 'success'"), "refund_dt", refund_cnt=one, refund_amount=F.col("refund_amount")),
        rows(sessions, "session_dt", cs_session_cnt=one, cs_bot_cnt=F.col("is_bot").cast("int"), cs_resolved_cnt=F.col("resolved").cast("int"), cs_satisfaction_cnt=F.col("satisfaction").isNotNull().cast("int"), cs_first_response_sum=F.col("first_response_sec"), cs_satisfaction_sum=F.col("satisfaction")),
    )
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    days = every.groupBy("dt", "shop_id").agg(*(zero(c).alias(c) for c in COUNTS), *(zero(c).alias(c) for c in SUMS))
    met = days.join(shops.select("shop_id", "tenant_id", "platform"), "shop_id", "left")
    settled = F.round(F.col("paid_gmv") - F.col("refund_amount"), 2)
    return met.select("dt", F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "shop_id", F.coalesce("platform", F.lit("")).alias("platform"), *COUNTS, *(F.round(c, 2).cast("double").alias(c) for c in SUMS), settled.cast("double").alias("settlement_gmv"))


def tenant_day(shop_days: DataFrame) -> DataFrame:
    """Sums of the shops' rounded days, rounded again."""
    money = lambda c: F.round(F.sum(F.col(c).cast("decimal(20,2)")), 2).cast("double").alias(c)
    return shop_days.groupBy("dt", "tenant_id").agg(F.sum("order_cnt").alias("order_cnt"), *map(money, ("order_gmv", "paid_gmv", "refund_amount", "settlement_gmv")), F.sum("cs_session_cnt").alias("cs_session_cnt"))


def tenant_comparison(days: DataFrame, tenants: DataFrame) -> DataFrame:
    """A row per tenant, with or without data: sums, refund rate and order value, 0 where the divisor is."""
    money = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,2)")), F.lit(0))
    met = tenants.join(days, "tenant_id", "left").groupBy("tenant_id", "name").agg(*(money(c).alias(c) for c in ("order_gmv", "paid_gmv", "settlement_gmv", "refund_amount")), F.coalesce(F.sum("order_cnt"), F.lit(0)).alias("order_cnt"), F.coalesce(F.sum("cs_session_cnt"), F.lit(0)).alias("cs_session_cnt"))
    share = lambda a, b, d: F.when(F.col(b) != 0, F.round(F.col(a).cast("double") / F.col(b).cast("double"), d)).otherwise(0.0)
    return met.select("tenant_id", "name", *(F.col(c).cast("double").alias(c) for c in ("order_gmv", "paid_gmv", "settlement_gmv", "refund_amount")), share("refund_amount", "paid_gmv", 4).alias("refund_rate"), "order_cnt", "cs_session_cnt", share("paid_gmv", "order_cnt", 2).alias("aov"))


def platform_split(shop_days: DataFrame) -> DataFrame:
    """A row per platform: paid sum, refund rate, orders and shops."""
    money = lambda c: F.sum(F.col(c).cast("decimal(20,2)"))
    sums = shop_days.groupBy("platform").agg(money("paid_gmv").alias("paid"), money("refund_amount").alias("refund"), F.sum("order_cnt").alias("order_cnt"), F.count_distinct("shop_id").alias("shop_count"))
    rate = F.when(F.col("paid") != 0, F.round(F.col("refund").cast("double") / F.col("paid").cast("double"), 4)).otherwise(0.0)
    return sums.select("platform", F.round("paid", 2).cast("double").alias("paid_gmv"), rate.alias("refund_rate"), "order_cnt", "shop_count")


def dashboard(shop_days: DataFrame, days: int = 30) -> DataFrame:
    """part (all, day, tenant, platform) with its dt, tenant_id or platform: sums over the last days that have data, in one pass over them."""
    last = shop_days.agg(F.max("dt")).first()[0]
    money = lambda c: F.sum(F.col(c).cast("decimal(20,2)"))
    by = ("dt", "tenant_id", "platform")
    sets = shop_days.where(F.col("dt") > F.date_sub(F.lit(last), days)).groupingSets([[], ["dt"], ["tenant_id"], ["platform"]], *by)
    sums = sets.agg(F.grouping_id().alias("g"), *(money(c).alias(c) for c in ("order_gmv", "paid_gmv", "settlement_gmv", "refund_amount")), F.sum("order_cnt").alias("order_cnt"), F.sum("cs_session_cnt").alias("cs_session_cnt"), F.count_distinct("shop_id").alias("shop_count"))
    share = lambda a, b, d: F.when(F.col(b) != 0, F.round(F.col(a).cast("double") / F.col(b).cast("double"), d)).otherwise(0.0)
    part = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "day").when(F.col("g") == 5, "tenant").otherwise("platform")
    amounts = (F.col(c).cast("double").alias(c) for c in ("order_gmv", "paid_gmv", "settlement_gmv", "refund_amount"))
    return sums.select(part.alias("part"), *by, *amounts, "order_cnt", "cs_session_cnt", "shop_count", share("refund_amount", "paid_gmv", 4).alias("refund_rate"), share("paid_gmv", "order_cnt", 2).alias("aov"))
