"""A versioned dictionary of metrics, and series, totals and comparisons of them.

A definition names a detail table, its day column, an aggregate and a filter in
SQL; Catalyst plans them. A derived metric is a formula of others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MetricError(ValueError):
    """A metric, version, dimension or formula that can't be computed."""


@dataclass(frozen=True)
class Metric:
    code: str
    version: str
    name: str
    source: str
    day: str
    formula: str
    condition: str
    unit: str
    start: date
    end: date | None = None


_FROM, _CUT = date(1990, 1, 1), date(1998, 1, 1)

#: The dictionary. Codes, versions, aggregates and filters are fixed values; the validity is that of the benchmark's years.
DEFINITIONS = (
    Metric("GMV_ORDER", "v1.0", "order GMV", "dwd_order", "order_dt", "SUM(pay_amount)", "is_valid = TRUE AND is_cancelled = FALSE", "CNY", _FROM),
    Metric("GMV_PAID", "v1.0", "paid GMV with presale", "dwd_order", "paid_dt", "SUM(pay_amount)", "is_valid = TRUE AND paid_dt IS NOT NULL", "CNY", _FROM, _CUT - timedelta(1)),
    Metric("GMV_PAID", "v1.1", "paid GMV without presale", "dwd_order", "paid_dt", "SUM(pay_amount)", "is_valid = TRUE AND paid_dt IS NOT NULL AND is_presale = FALSE", "CNY", _CUT),
    Metric("REFUND_AMOUNT", "v1.0", "refunds", "dwd_refund", "refund_dt", "SUM(refund_amount)", "is_valid = TRUE AND refund_status = 'success'", "CNY", _FROM),
    Metric("GMV_SETTLE", "v1.0", "settled GMV", "derived", "", "GMV_PAID - REFUND_AMOUNT", "", "CNY", _FROM),
    Metric("ORDER_CNT", "v1.0", "order lines", "dwd_order", "order_dt", "COUNT(*)", "is_valid = TRUE AND is_cancelled = FALSE", "lines", _FROM),
    Metric("PAID_CNT", "v1.0", "paid lines", "dwd_order", "paid_dt", "COUNT(*)", "is_valid = TRUE AND paid_dt IS NOT NULL", "lines", _FROM),
    Metric("AOV_PAID", "v1.0", "paid GMV a line", "derived", "", "GMV_PAID / PAID_CNT", "", "CNY", _FROM),
    Metric("REFUND_RATE", "v1.0", "refunds of paid GMV", "derived", "", "REFUND_AMOUNT / GMV_PAID", "", "share", _FROM),
    Metric("CS_SESSION_CNT", "v1.0", "sessions", "dwd_cs_session", "session_dt", "COUNT(*)", "1 = 1", "sessions", _FROM),
    Metric("CS_BOT_CNT", "v1.0", "sessions with a bot", "dwd_cs_session", "session_dt", "SUM(CASE WHEN is_bot = TRUE THEN 1 ELSE 0 END)", "1 = 1", "sessions", _FROM),
    Metric("CS_BOT_RATIO", "v1.0", "share with a bot", "derived", "", "CS_BOT_CNT / CS_SESSION_CNT", "", "share", _FROM),
    Metric("CS_FIRST_RESP_AVG", "v1.0", "mean first response", "dwd_cs_session", "session_dt", "AVG(first_response_sec)", "1 = 1", "s", _FROM),
    Metric("CS_SATISFACTION_AVG", "v1.0", "mean satisfaction", "dwd_cs_session", "session_dt", "AVG(satisfaction)", "satisfaction IS NOT NULL", "points", _FROM),
    Metric("CS_RESOLVE_RATE", "v1.0", "share resolved", "dwd_cs_session", "session_dt", "AVG(CASE WHEN resolved = TRUE THEN 1.0D ELSE 0.0D END)", "1 = 1", "share", _FROM),
)

#: What materializing writes, in order: (code, dimension).
TARGETS = (
    ("GMV_ORDER", "tenant"), ("GMV_ORDER", "shop"), ("GMV_PAID", "tenant"), ("GMV_PAID", "shop"), ("REFUND_AMOUNT", "tenant"), ("REFUND_AMOUNT", "shop"), ("GMV_SETTLE", "tenant"), ("GMV_SETTLE", "shop"),
    ("ORDER_CNT", "tenant"), ("PAID_CNT", "tenant"), ("AOV_PAID", "tenant"), ("REFUND_RATE", "tenant"), ("CS_SESSION_CNT", "tenant"), ("CS_BOT_CNT", "tenant"), ("CS_BOT_RATIO", "tenant"),
    ("CS_FIRST_RESP_AVG", "tenant"), ("CS_SATISFACTION_AVG", "tenant"), ("CS_RESOLVE_RATE", "tenant"),
)
DIMENSIONS = {"tenant": "tenant_id", "shop": "shop_id", "platform": "platform"}
AMOUNTS = ("GMV_ORDER", "GMV_PAID", "GMV_SETTLE", "REFUND_AMOUNT")
#: Shown as the plain mean of daily values; all others as their sum.
MEANS = ("REFUND_RATE", "CS_BOT_RATIO", "CS_FIRST_RESP_AVG", "CS_SATISFACTION_AVG")
_KEYS = ["dt", "tenant_id", "dim_value"]


class Dictionary:
    def __init__(self, metrics: tuple[Metric, ...] = DEFINITIONS):
        self.metrics = metrics

    def get(self, code: str, version: str) -> Metric | None:
        return next((m for m in self.metrics if (m.code, m.version) == (code, version)), None)

    def resolve(self, code: str, on: date) -> Metric | None:
        """The version in force on a day; of several the latest start, then the greatest version."""
        good = [m for m in self.metrics if m.code == code and m.start <= on and (m.end is None or on <= m.end)]
        return max(good, key=lambda m: (m.start, m.version), default=None)

    def named(self, code: str, version: str | None, on: date) -> Metric:
        found = self.get(code, version) if version else self.resolve(code, on)
        if found is None:
            raise MetricError(f"no version of {code}: {version or on}")
        return found

    def parts(self, metric: Metric, on: date) -> list[Metric]:
        """What a formula refers to: each in the formula's own version where there is one, in force or not."""
        return [self.get(c, metric.version) or self.named(c, None, on) for c in formula_parts(metric.formula)]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(m.code, m.version, m.name, m.source, m.day, m.formula, m.condition, m.unit, m.start, m.end) for m in self.metrics]
        return spark.createDataFrame(rows, "metric_code string, caliber_version string, metric_name string, source_table string, dt_column string, agg_expr string, filter_expr string, unit string, effective_from date, effective_to date")


def formula_parts(formula: str) -> list[str]:
    if not re.fullmatch(r"[A-Z0-9_+\-*/(). ]+", formula):
        raise MetricError(f"not a formula of metrics: {formula}")
    found = list(dict.fromkeys(re.findall(r"[A-Z][A-Z0-9_]*", formula)))
    if not found:
        raise MetricError(f"a formula without metrics: {formula}")
    return found


def aggregate(formula: str) -> str:
    """The aggregate in SQL with means of decimals, which don't depend on the rows' order in their last places."""
    return re.sub(r"\bAVG\((\w+)\)", r"AVG(CAST(\1 AS DECIMAL(24,10)))", formula)


def formula_column(formula: str, names: dict[str, str] | None = None) -> Column:
    """The formula over columns named like its metrics, or by ``names``; null where a divisor, a single metric, is zero."""
    formula_parts(formula)
    named = re.sub(r"[A-Z][A-Z0-9_]*", lambda m: (names or {}).get(m[0], m[0]), re.sub(r"/\s*([A-Z][A-Z0-9_]*)", r"/ nullif(\1, 0)", formula).replace("nullif", "\0"))
    return F.expr(named.replace("\0", "nullif"))


def notices(definitions: DataFrame) -> DataFrame:
    """metric_code, caliber_version and notice: what a version means and when it holds."""
    until = F.coalesce(F.col("effective_to").cast("string"), F.lit("now"))
    return definitions.select("metric_code", "caliber_version", F.format_string("version %s (%s to %s): %s, in %s", "caliber_version", F.col("effective_from").cast("string"), until, "metric_name", "unit").alias("notice"))


def in_force(definitions: DataFrame, days: DataFrame) -> DataFrame:
    """For each day of ``days`` (as_of) and code the version in force."""
    met = definitions.join(days, (F.col("effective_from") <= F.col("as_of")) & (F.col("as_of") <= F.coalesce("effective_to", F.lit(date(9999, 12, 31)))))
    return met.groupBy("as_of", "metric_code").agg(F.max(F.struct("effective_from", "caliber_version")).alias("v")).select("as_of", "metric_code", F.col("v.caliber_version").alias("caliber_version"))


class Engine:
    """Metrics over detail tables by name (dwd_order, dwd_refund, dwd_cs_session)."""

    def __init__(self, tables: dict[str, DataFrame], dictionary: Dictionary | None = None):
        self.tables, self.dictionary = tables, dictionary or Dictionary()

    def _rows(self, metric: Metric, start: date, end: date, tenant: str | None) -> DataFrame:
        rows = self.tables[metric.source].where(F.col(metric.day).between(F.lit(start), F.lit(end)))
        return rows if tenant is None else rows.where(F.col("tenant_id") == tenant)

    def _dim(self, source: str, dim: str) -> str:
        if dim not in DIMENSIONS:
            raise MetricError(f"no such dimension: {dim}")
        if source != "derived" and DIMENSIONS[dim] not in self.tables[source].columns:
            raise MetricError(f"{source} has no {dim}")
        return DIMENSIONS[dim]

    def series(self, code: str, version: str | None = None, *, dim: str = "tenant", start: date, end: date, as_of: date | None = None, tenant: str | None = None) -> DataFrame:
        """dt, tenant_id, dim_value, value: a point per day, tenant and dimension that has one.

        The version is resolved once, on ``as_of`` or the end. A derived point
        needs all its parts, and no zero divisor.
        """
        if start > end:
            raise MetricError("the start is after the end")
        return self._series(self.dictionary.named(code, version, as_of or end), dim, start, end, as_of or end, tenant)

    def _series(self, metric: Metric, dim: str, start: date, end: date, on: date, tenant: str | None) -> DataFrame:
        by = self._dim(metric.source, dim)
        if metric.source != "derived":
            rows = self._rows(metric, start, end, tenant).where(F.expr(metric.condition))
            made = rows.groupBy(F.col(metric.day).alias("dt"), F.col("tenant_id").alias("tenant_id"), F.col(by).alias("dim_value")).agg(F.expr(aggregate(metric.formula)).cast("double").alias("value"))
            return made.where("value is not null")
        parts = self.dictionary.parts(metric, on)
        return derived_points([(p.code, self._series(p, dim, start, end, on, tenant)) for p in parts], metric.formula)

    def total(self, code: str, version: str | None = None, *, start: date, end: date, as_of: date | None = None, tenant: str | None = None) -> DataFrame:
        """One row, value: aggregated anew from the detail over the whole period, not from the points. Null without rows or where a part is null."""
        metric = self.dictionary.named(code, version, as_of or end)
        return self._total(metric, start, end, as_of or end, tenant)

    def _total(self, metric: Metric, start: date, end: date, on: date, tenant: str | None) -> DataFrame:
        if metric.source != "derived":
            return self._rows(metric, start, end, tenant).where(F.expr(metric.condition)).agg(F.expr(aggregate(metric.formula)).cast("double").alias("value"))
        each = [self._total(p, start, end, on, tenant).withColumnRenamed("value", p.code) for p in self.dictionary.parts(metric, on)]
        # Each is one row.
        return reduce(DataFrame.crossJoin, each).select(formula_column(metric.formula).alias("value"))

    def totals(self, wanted: list[tuple[str, str | None, date, date]], tenant: str | None = None) -> DataFrame:
        """A row per (code, version, start, end): place, metric_code, caliber_version, start, end and value, as ``total`` has it.

        Each detail table is aggregated once, with a filter for each metric and window.
        """
        named = [(self.dictionary.named(c, v, end), start, end) for c, v, start, end in wanted]
        parts = [(p, start, end) for m, start, end in named for p in ([m] if m.source != "derived" else self.dictionary.parts(m, end))]
        column = {x: f"v{k}" for k, x in enumerate(dict.fromkeys(parts))}
        wide = None
        for source in dict.fromkeys(m.source for m, _, _ in column):
            own = {x: name for x, name in column.items() if x[0].source == source}
            when = {x: f"{x[0].day} BETWEEN DATE '{x[1]}' AND DATE '{x[2]}'" for x in own}
            rows = self.tables[source].where(" OR ".join(dict.fromkeys(when.values())))
            rows = rows if tenant is None else rows.where(F.col("tenant_id") == tenant)
            one = rows.agg(*(F.expr(f"{aggregate(x[0].formula)} FILTER (WHERE ({x[0].condition}) AND {when[x]})").cast("double").alias(name) for x, name in own.items()))
            # Each is one row.
            wide = one if wide is None else wide.crossJoin(one)

        def value(m: Metric, start: date, end: date) -> Column:
            if m.source != "derived":
                return F.col(column[m, start, end])
            return formula_column(m.formula, {p.code: column[p, start, end] for p in self.dictionary.parts(m, end)})

        each = [F.struct(F.lit(k).alias("place"), F.lit(m.code).alias("metric_code"), F.lit(m.version).alias("caliber_version"), F.lit(start).alias("start"), F.lit(end).alias("end"), value(m, start, end).alias("value")) for k, (m, start, end) in enumerate(named)]
        return wide.select(F.explode(F.array(*each)).alias("t")).select("t.*")

    def comparisons(self, wanted: list[tuple[str, str]], start: date, end: date, tenant: str | None = None) -> DataFrame:
        """``compared`` for many (code, kind): a row each, from one aggregate a detail table."""
        windows = [(c, kind, *shifted(start, end, kind)) for c, kind in wanted]
        there = [self.dictionary.resolve(c, e) is not None for c, _, _, e in windows]
        asked = list(dict.fromkeys([(c, None, start, end) for c, _, _, _ in windows] + [(c, None, s, e) for (c, _, s, e), t in zip(windows, there) if t]))
        wide = self.totals(asked, tenant).select(F.round("value", 4).alias("value"), "place").groupBy().pivot("place", list(range(len(asked)))).agg(F.first("value"))
        at = lambda key: F.col(f"`{asked.index(key)}`")
        each = []
        for (c, kind, s, e), t in zip(windows, there):
            now, then = at((c, None, start, end)), at((c, None, s, e)) if t else F.lit(None).cast("double")
            each.append(F.struct(F.lit(c).alias("metric_code"), F.lit(kind).alias("compare"), F.lit(s).alias("previous_start"), F.lit(e).alias("previous_end"), now.alias("total"), then.alias("previous_total")))
        rows = wide.select(F.explode(F.array(*each)).alias("c")).select("c.*")
        delta = F.round(F.col("total") - F.col("previous_total"), 4)
        return rows.select("*", delta.alias("delta"), F.round(delta / F.nullif(F.abs("previous_total"), F.lit(0.0)), 4).alias("delta_pct"))

    def materialized(self, start: date, end: date, targets: tuple[tuple[str, str], ...] = TARGETS) -> DataFrame:
        """metric_code, caliber_version, tenant_id, dt, dim_type, dim_value, value (4 places) of all tenants and targets.

        All simple metrics of a table, day column and dimension are one
        aggregation, with a filter and a count of rows for each.
        """
        wanted = [(self.dictionary.named(c, None, end), d) for c, d in targets]
        simple: dict[tuple[str, str, str], dict[tuple[str, str], Metric]] = {}
        for metric, dim in wanted:
            for m in [metric] if metric.source != "derived" else self.dictionary.parts(metric, end):
                simple.setdefault((m.source, m.day, dim), {})[m.code, m.version] = m
        points = []
        for (source, day, dim), metrics in simple.items():
            by, listed = self._dim(source, dim), list(metrics.values())
            rows = self.tables[source].where(F.col(day).between(F.lit(start), F.lit(end)))
            aggs = [x for k, m in enumerate(listed) for x in (F.expr(f"{aggregate(m.formula)} FILTER (WHERE {m.condition})").cast("double").alias(f"v{k}"), F.expr(f"COUNT(*) FILTER (WHERE {m.condition})").alias(f"n{k}"))]
            wide = rows.groupBy(F.col(day).alias("dt"), F.col("tenant_id").alias("tenant_id"), F.col(by).alias("dim_value")).agg(*aggs)
            each = F.array(*(F.struct(F.lit(m.code).alias("metric_code"), F.lit(m.version).alias("caliber_version"), F.when(F.col(f"n{k}") > 0, F.col(f"v{k}")).alias("value")) for k, m in enumerate(listed)))
            points.append(wide.select(*_KEYS, F.lit(dim).alias("dim_type"), F.explode(each).alias("p")).select(*_KEYS, "dim_type", "p.*").where("value is not null"))
        every = reduce(DataFrame.unionByName, points)
        direct = [(m.code, m.version, d) for m, d in wanted if m.source != "derived"]
        out = [every.where(reduce(Column.__or__, ((F.col("metric_code") == c) & (F.col("caliber_version") == v) & (F.col("dim_type") == d) for c, v, d in direct)))] if direct else []
        for metric, dim in wanted:
            if metric.source == "derived":
                parts = [(p.code, every.where((F.col("metric_code") == p.code) & (F.col("caliber_version") == p.version) & (F.col("dim_type") == dim))) for p in self.dictionary.parts(metric, end)]
                made = derived_points(parts, metric.formula)
                out.append(made.select(*_KEYS, F.lit(dim).alias("dim_type"), F.lit(metric.code).alias("metric_code"), F.lit(metric.version).alias("caliber_version"), "value"))
        return reduce(DataFrame.unionByName, out).select("metric_code", "caliber_version", "tenant_id", "dt", "dim_type", "dim_value", F.round("value", 4).alias("value"))

    def compared(self, code: str, version: str | None = None, *, start: date, end: date, compare: str, tenant: str | None = None) -> DataFrame:
        """One row: total, previous_total, delta and delta_pct against the window before (mom) or a year before (yoy).

        Without a version each window resolves its own.
        """
        before = shifted(start, end, compare)
        now = self.total(code, version, start=start, end=end, tenant=tenant).select(F.round("value", 4).alias("total"))
        try:
            then = self.total(code, version, start=before[0], end=before[1], tenant=tenant).select(F.round("value", 4).alias("previous_total"))
        except MetricError:  # no version was in force then
            then = now.select(F.lit(None).cast("double").alias("previous_total"))
        delta = F.round(F.col("total") - F.col("previous_total"), 4)
        return now.crossJoin(then).select(F.lit(code).alias("metric_code"), F.lit(compare).alias("compare"), F.lit(before[0]).alias("previous_start"), F.lit(before[1]).alias("previous_end"), "total", "previous_total", delta.alias("delta"), F.round(delta / F.nullif(F.abs("previous_total"), F.lit(0.0)), 4).alias("delta_pct"))


def derived_points(parts: list[tuple[str, DataFrame]], formula: str) -> DataFrame:
    """Points where all parts have one and no divisor is zero. The parts are put under each other and met in one aggregation."""
    rows = reduce(DataFrame.unionByName, (s.select(*_KEYS, F.lit(code).alias("part"), "value") for code, s in parts))
    met = rows.groupBy(*_KEYS).agg(*(F.max(F.when(F.col("part") == c, F.col("value"))).alias(c) for c, _ in parts))
    return met.select(*_KEYS, formula_column(formula).alias("value")).where("value is not null")


def shifted(start: date, end: date, compare: str) -> tuple[date, date]:
    """The window compared with. A year back from 29 February both ends fall on a 28th."""
    if compare == "mom":
        return start - (end - start) - timedelta(1), start - timedelta(1)
    if compare == "yoy":
        try:
            return start.replace(year=start.year - 1), end.replace(year=end.year - 1)
        except ValueError:
            return start.replace(year=start.year - 1, day=28), end.replace(year=end.year - 1, day=28)
    raise MetricError(f"no such comparison: {compare}")


def daily_series(results: DataFrame, tenant: str | None = None) -> DataFrame:
    """metric_code, dt, value of the tenant dimension, summed over tenants where none is named."""
    rows = results.where("dim_type = 'tenant'")
    rows = rows if tenant is None else rows.where(F.col("tenant_id") == tenant)
    return rows.groupBy("metric_code", "dt").agg(F.sum(F.col("value").cast("decimal(24,4)")).cast("double").alias("value"))


def kpis(daily: DataFrame) -> DataFrame:
    """A figure per metric: the plain mean of days for shares and means (4 places), the sum (2) for others."""
    v = F.col("value").cast("decimal(24,4)")
    mean = F.round(F.sum(v).cast("double") / F.count("*"), 4)
    return daily.groupBy("metric_code").agg(F.when(F.col("metric_code").isin(*MEANS), mean).otherwise(F.round(F.sum(v), 2).cast("double")).alias("value"))
