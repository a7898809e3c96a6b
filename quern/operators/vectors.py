"""Exact nearest vectors by cells.

Vectors of length one are dealt to the cells of centres that Spark learns from a
bounded sample. A cell knows how far its farthest vector lies from its centre.
By the triangle inequality no vector of a cell is nearer to a query than the
query's distance to the centre less that radius: cells beyond the k-th distance
that the nearest cells gave are never looked into. The centres decide how much
is skipped, never what is found.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf

from quern.sources.shared import kept

#: Vectors that centres are learned from at most, and centres at most: 16 MB of 512 numbers each.
SAMPLE, CELLS = 50_000, 4096
#: Vectors of a cell in a part, and cells that are looked into before others are ruled out.
PART, PROBES = 5000, 4
#: Distances are compared with this much room for rounding.
ROOM = 1e-6


def _norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def _unit(rows: DataFrame, vector: str) -> DataFrame:
    """Adds v (doubles), vn (length) and u (of length one); rows that have no direction go."""
    out = rows.withColumn("v", F.col(vector).cast("array<double>")).withColumn("vn", _norm(F.col("v")))
    out = out.where((F.col("vn") > 0) & (F.col("vn") < float("inf")))
    return out.withColumn("u", F.transform("v", lambda x: x / F.col("vn")))


class VectorIndex:
    """Rows (vec_id, tenant_id, embedding) by cell, written once: centres, radii and the rows."""

    def __init__(self, rows: DataFrame, cells: int | None = None, seed: int = 7, sample: int = SAMPLE):
        unit = kept(_unit(rows.select("vec_id", "tenant_id", "embedding"), "embedding").select("vec_id", "tenant_id", "v", "vn", "u"), "unit")
        n = unit.count()
        self.n = n
        cells = max(2, min(CELLS, cells or isqrt(n)))
        if n:
            some = unit if n <= sample else unit.sample(min(1.0, sample / n), seed)
            learned = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(some.select(array_to_vector("u").alias("f")))
            self.centres = np.array(learned.clusterCenters())
        else:
            self.centres = np.zeros((1, 1))
        centres = self.centres

        @pandas_udf("cell int, far double")
        def nearest(u: pd.Series) -> pd.DataFrame:
            x = np.stack(u.to_numpy()) if len(u) else np.zeros((0, centres.shape[1]))
            square = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0)
            cell = square.argmin(1)
            return pd.DataFrame({"cell": cell.astype(np.int32), "far": np.sqrt(square[np.arange(len(x)), cell])})

        dealt = unit.withColumn("c", nearest("u")).select("vec_id", "tenant_id", "v", "vn", "c.cell", "c.far")
        # Vectors a cell and tenant: as few as there are centres, times tenants.
        dealt = kept(dealt, "dealt")
        self.sizes = kept(dealt.groupBy("tenant_id", "cell").agg(F.count("*").alias("m")), "sizes")
        parts = dealt.join(self.sizes, ["tenant_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("m") / PART)).cast("int"))
        self.rows = kept(parts.drop("m"), "cells")
        self.radii = np.zeros(len(centres))
        for r in dealt.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row a centre
            self.radii[r.cell] = r.far

    def _visits(self, asked: DataFrame, probes: int | None) -> DataFrame:
        """query_id, tenant_id, q, qn, cell: the nearest cells of each query, or those that may hold a vector within its reach."""
        centres, radii = self.centres, self.radii

        @pandas_udf("array<int>")
        def near(u: pd.Series, reach: pd.Series) -> pd.Series:
            x = np.stack(u.to_numpy()) if len(u) else np.zeros((0, centres.shape[1]))
            far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0))
            if probes is not None:
                first = np.argsort(far, axis=1, kind="stable")[:, :probes]
                return pd.Series(list(first.astype(np.int32)))
            return pd.Series([np.flatnonzero(d - radii <= r + ROOM).astype(np.int32) for d, r in zip(far, reach)])

        return asked.select("query_id", "tenant_id", "q", "qn", F.explode(near("u", "reach")).alias("cell"))

    def _met(self, visits: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score of the k best of each visited part."""
        parts = visits.join(self.sizes, ["tenant_id", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / PART).cast("int") - 1))).drop("m")
        met = parts.join(self.rows, ["tenant_id", "cell", "part"]).where("vec_id <> query_id")
        dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        scored = met.select("query_id", "vec_id", "cell", "part", F.round(dot / (F.col("qn") * F.col("vn")), 12).alias("score"))
        best = F.row_number().over(W.partitionBy("query_id", "cell", "part").orderBy(F.desc("score"), "vec_id"))
        return scored.withColumn("k", best).where(F.col("k") <= k).select("query_id", "vec_id", "score")

    def nearest(self, queries: DataFrame, k: int = 5, probes: int = PROBES) -> DataFrame:
        """query_id, rank, vec_id, score: the k vectors of the query's tenant (query_id, tenant_id, q) with the greatest cosine, itself left out."""
        first, later = self._rounds(queries, k, probes)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return first.unionByName(self._met(later, k)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def _rounds(self, queries: DataFrame, k: int, probes: int) -> tuple[DataFrame, DataFrame]:
        asked = _unit(queries.select("query_id", "tenant_id", "q"), "q").select("query_id", "tenant_id", F.col("v").alias("q"), F.col("vn").alias("qn"), "u")
        asked = kept(asked.withColumn("reach", F.lit(2.0)), "asked")
        visits = kept(self._visits(asked, probes), "visits")
        first = kept(self._met(visits, k), "first")
        order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        # On vectors of length one a cosine is a distance: d * d = 2 - 2 * cosine. Fewer than k found rule nothing out.
        reach = first.withColumn("k", order).where(F.col("k") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("within"))
        again = asked.join(reach, "query_id", "left").withColumn("reach", F.coalesce("within", F.lit(2.0)))
        done = visits.select("query_id", "cell")
        return first, self._visits(again, None).join(done, ["query_id", "cell"], "left_anti")

    def visited(self, queries: DataFrame, k: int = 5, probes: int = PROBES) -> DataFrame:
        """pairs (of queries with all of their tenants' vectors) and visited (those that were compared)."""
        asked = queries.groupBy("tenant_id").agg(F.count("*").alias("q"))
        every = self.sizes.groupBy("tenant_id").agg(F.sum("m").alias("n")).join(asked, "tenant_id").agg(F.sum(F.col("q") * F.col("n")).alias("pairs"))
        later = self._rounds(queries, k, probes)[1].select("query_id", "tenant_id", "cell")
        first = self._visits(_unit(queries.select("query_id", "tenant_id", "q"), "q").select("query_id", "tenant_id", F.col("v").alias("q"), F.col("vn").alias("qn"), "u").withColumn("reach", F.lit(2.0)), probes)
        seen = later.unionByName(first.select("query_id", "tenant_id", "cell")).join(self.sizes, ["tenant_id", "cell"]).agg(F.sum("m").alias("visited"))
        return every.crossJoin(seen)  # a row each
