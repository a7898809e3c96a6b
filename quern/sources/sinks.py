"""Writing tables: whole, by tenant, where absent, row by key; and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def overwrite_tenants(df: DataFrame, path: str, tenant: str = "tenant_id") -> None:
    """Replaces the tenants that ``df`` has rows of; the others' partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tenant).parquet(path)


def absent(new: DataFrame, there: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` whose key isn't there: what a seed that may be run again appends."""
    return new.join(there.select(*keys), list(keys), "left_anti")


def merged(there: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``there`` with the rows of ``new`` in place of those of their key."""
    return there.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def without(there: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return there.join(gone.select(*keys), list(keys), "left_anti")


def document_upserted(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Documents with ``new`` in place. A document of another tenant under the same id, an empty title or content is an error when the rows are read."""
    other = documents.select(F.col("doc_id").alias("k"), F.col("tenant_id").alias("owner"))
    met = new.join(other, F.col("doc_id") == F.col("k"), "left")
    wrong = (F.col("owner").isNotNull() & (F.col("owner") != F.col("tenant_id"))) | (F.trim(F.coalesce("content", F.lit(""))) == "") | (F.trim(F.coalesce("title", F.lit(""))) == "")
    checked = met.withColumn("doc_id", F.when(wrong, F.raise_error(F.lit("not this tenant's document, or an empty one")).cast("string")).otherwise(F.col("doc_id"))).drop("k", "owner")
    return without(documents, new, "doc_id").unionByName(checked.select(*documents.columns))


def mapping_verified(mapping: DataFrame, skus: DataFrame, decisions: DataFrame) -> DataFrame:
    """The mapping with decisions made by hand (tenant_id, platform, shop_id, platform_sku_code, sku_id, id) in place.

    A decision for a SKU that isn't in the catalog, or without a code, is an
    error when the rows are read: none of the decisions is taken then.
    """
    keys = ["tenant_id", "platform", "shop_id", "platform_sku_code"]
    met = decisions.join(skus.select(F.col("sku_id").alias("known")).distinct(), F.col("sku_id") == F.col("known"), "left")
    wrong = F.col("known").isNull() | (F.trim(F.coalesce("platform_sku_code", F.lit(""))) == "")
    checked = met.withColumn("sku_id", F.when(wrong, F.raise_error(F.concat(F.lit("not a SKU of the catalog, or no code: "), F.coalesce("sku_id", F.lit("null"))))).otherwise(F.col("sku_id")))
    return merged(mapping, checked.select(*mapping.columns), *keys)


def exported(df: DataFrame, path: str, *columns: str) -> None:
    """CSV with a header, columns in the order given."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def exported_points(points: DataFrame, path: str, tenant: str | None, code: str, version: str) -> None:
    """A tenant's points (dt, tenant_id, dim_value, value) as CSV in the fixed columns. Without a tenant nothing is exported: brands don't mix in a file."""
    if not tenant:
        raise ValueError("an export needs a tenant")
    own = points.where(F.col("tenant_id") == tenant).withColumns({"metric_code": F.lit(code), "caliber_version": F.lit(version)})
    exported(own, path, "dt", "tenant_id", "dim_value", "value", "metric_code", "caliber_version")


def ensured(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; an empty one of the schema is made where there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)
