"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.store import dropped, staged_at


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of n rows that each reaches by links i, j; within one task."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _plain(key: str) -> Column:
    # The same key as an expression: the join then shuffles both sides anew, and
    # adaptive execution can split the rows of a hot node among tasks.
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def _rewired(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Points the larger neighbours of each node (or the node and its smaller ones) at the least of them."""
    if both_ways:
        edges = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(_plain("u").alias("k"), F.least("u", "m").alias("m"))
    met = edges.join(least, F.col("u") == F.col("k"))
    if both_ways:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return met.select(F.explode(pairs).alias("e")).select("e.*").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the least node of its component) for every node that has an edge.

    ``edges`` has two columns of longs. Loops, repeated edges and edges with a
    null end are left out. Each round points larger neighbours and then smaller
    ones at the least neighbour of a node (large star, small star), until
    nothing changes; no node's neighbours are gathered in one place, and the
    driver sees a count and a checksum of each round.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    now = edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path = staged_at(now, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state[0] == 0 or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        after, new = staged_at(_rewired(_rewired(now, True), False).distinct(), "edges")
        dropped(spark, path)
        now, path = after, new
