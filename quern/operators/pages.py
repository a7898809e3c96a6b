"""Pages of an ordered table, read from the part that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.sources.shared import new_path


class Pages:
    """A table in order: parts by ranges of the keys, and how many rows lie before each.

    It is written once. A page then reads the parts that its places fall into,
    wherever it lies, in place of all rows up to it.
    """

    def __init__(self, rows: DataFrame, *keys: str, part_rows: int = 100_000):
        """``keys`` order the rows and are unique among them; a part holds some ``part_rows``."""
        spark = rows.sparkSession
        self.keys, self.columns, n = keys, rows.columns, rows.count()
        self.path = new_path(spark, "pages")
        parts = rows.repartitionByRange(max(1, -(-n // part_rows)), *keys).withColumn("part", F.spark_partition_id())
        parts.write.partitionBy("part").parquet(self.path)
        self.rows = spark.read.schema(parts.schema).parquet(self.path)
        # A row a part.
        before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        self.counts = self.rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
        self.n = n

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows at places offset + 1 to offset + limit, with place."""
        held = self.counts.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()
        if not held:
            return self.rows.limit(0).select(*self.columns, F.lit(0).cast("long").alias("place"))
        within = F.row_number().over(W.partitionBy("part").orderBy(*self.keys))
        before = F.element_at(F.create_map(*(F.lit(x) for r in held for x in (r.part, r.before))), F.col("part"))
        placed = self.rows.where(F.col("part").isin([r.part for r in held])).withColumn("place", before + within)
        return placed.where(F.col("place").between(offset + 1, offset + limit)).select(*self.columns, "place")
