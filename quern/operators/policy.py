"""Who may see which tenant, and the trail of what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Denied(PermissionError):
    """A principal asked for a tenant that isn't its own."""


def resolve_tenant(role: str, own: str | None, asked: str | None) -> str | None:
    """The tenant to filter by, None for all.

    Brands see their own tenant only, admins the one they ask for or all,
    operators one that they have to name.
    """
    asked = (asked or "").strip() or None
    if role == "admin":
        return asked
    if role == "brand" and own and asked in (None, own):
        return own
    if role == "ops" and asked:
        return asked
    raise Denied(f"{role} of {own} asked for {asked}")


def tenant_predicate(tenant: str | None, column: str = "tenant_id") -> Column:
    return F.lit(True) if tenant is None else F.col(column) == F.lit(tenant)


def audited(log: DataFrame, user: str, action: str, target: str, allowed: bool, tenant: str | None) -> DataFrame:
    """The log (user, action, target, tenant_id, allowed, at) with a row more."""
    row = log.sparkSession.range(1).select(F.lit(user).alias("user"), F.lit(action).alias("action"), F.lit(target).alias("target"), F.lit(tenant).cast("string").alias("tenant_id"), F.lit(allowed).alias("allowed"), F.current_timestamp().alias("at"))
    return log.unionByName(row)


def denials(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_if(~F.col("allowed")).alias("denied"))
