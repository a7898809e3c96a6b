"""Retrieval for a table of questions in a few bounded rounds.

Questions are planned into parts, searched, and judged. A part whose own kind
of knowledge yields too little is searched in all; parts that still yield too
little are put in standard words and searched again. The round of the best mean
judgement counts; neighbours of its best hits join, and what a search for the
documents and brands that they name finds; texts are compressed, and what the
token budget holds stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import questions, retrieval
from quern.sources.shared import kept

THRESHOLD, REWRITES, BUDGET, TOP_K = 0.4, 2, 3000, 4


def _searched(parts: DataFrame, chunks: retrieval.Index, kind: bool, top_k: int) -> tuple[DataFrame, DataFrame]:
    """Hits and judgements by ``part_id`` of parts (part_id, text, tenant_id, kb_type)."""
    wanted = parts.select(F.col("part_id").alias("query_id"), F.col("text").alias("query"), "tenant_id", F.col("kb_type") if kind else F.lit(None).cast("string").alias("kb_type"))
    hits = kept(retrieval.search(wanted, chunks, top_k), "hits")
    return hits, questions.judged(wanted, hits)


def answered(asked: DataFrame, chunks: DataFrame | retrieval.Index, top_k: int = TOP_K, budget: int = BUDGET, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Context blocks (query_id, chunk_id, score, cost, used, compressed, text) and a row per question (query_id, attempt, confidence, degraded).

    ``asked`` has query_id, question, previous and tenant_id. Parts that only
    name metrics aren't searched, unless a question has no others.
    """
    index = chunks if isinstance(chunks, retrieval.Index) else retrieval.Index(chunks)
    chunks = index.chunks
    plan = questions.planned(asked)
    known = F.max((F.col("intent") != "metric").cast("int")).over(W.partitionBy("query_id"))
    plan = plan.withColumn("known", known).where("intent <> 'metric' or (known = 0 and part = 0)")
    parts = plan.join(asked.select("query_id", "tenant_id"), "query_id").select("query_id", F.concat_ws("/", "query_id", "part").alias("part_id"), "text", "kb_type", "tenant_id")
    current = kept(parts, "parts")
    rounds = []
    for attempt in range(1 + REWRITES):
        hits, verdict = _searched(current, index, True, top_k)
        verdict = kept(verdict, "verdict").withColumnRenamed("query_id", "part_id")
        weak = current.where("kb_type is not null").join(verdict.where(F.col("score") < THRESHOLD).select("part_id"), "part_id", "left_semi")
        open_hits, open_verdict = _searched(weak, index, False, top_k)
        open_verdict = kept(open_verdict, "verdict").select(F.col("query_id").alias("part_id"), F.col("score").alias("open_score"), F.col("reasons").alias("open_reasons"))
        met = verdict.join(open_verdict, "part_id", "left").withColumn("opened", F.coalesce(F.col("open_score") > F.col("score"), F.lit(False)))
        met = met.select("part_id", "opened", F.when(F.col("opened"), F.col("open_score")).otherwise(F.col("score")).alias("judge"), F.when(F.col("opened"), F.col("open_reasons")).otherwise(F.col("reasons")).alias("reasons"))
        met = kept(current.join(met, "part_id"), "judged")
        taken = hits.join(met.where("not opened").select(F.col("part_id").alias("query_id")), "query_id", "left_semi").unionByName(open_hits.join(met.where("opened").select(F.col("part_id").alias("query_id")), "query_id", "left_semi"))
        taken = taken.withColumnRenamed("query_id", "part_id").join(met.select("part_id", F.col("query_id")), "part_id")
        mean = met.groupBy("query_id").agg(F.avg("judge").alias("mean"))
        rounds.append(taken.join(mean, "query_id").withColumn("attempt", F.lit(attempt)))
        failed = met.where(F.col("judge") < THRESHOLD)
        new = questions.rewritten(F.col("text"), F.array_contains("reasons", "domain_mismatch"), F.col("kb_type"))
        current = kept(failed.withColumn("new", new).where("new <> text").select("query_id", "part_id", F.col("new").alias("text"), "kb_type", "tenant_id"), "parts")
        if attempt < REWRITES and current.isEmpty():
            break
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    every = kept(every, "rounds")
    # Of equally good rounds the earlier counts.
    best = every.groupBy("query_id").agg(F.max(F.struct("mean", (-F.col("attempt")).alias("k"))).alias("b")).select(F.col("query_id").alias("q"), (-F.col("b.k")).alias("a"), F.col("b.mean").alias("confidence"))
    hits = every.join(best, (F.col("query_id") == F.col("q")) & (F.col("attempt") == F.col("a")))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    top = kept(hits.withColumn("rank", order).where("rank <= 3").select("query_id", "rank", "chunk_id", "doc_id", "chunk_ix", "text"), "top")
    every = hits.select("query_id", "chunk_id", "score", "text")
    if hops >= 1:
        near = retrieval.neighbours(top, chunks).join(chunks.select("chunk_id", "text"), "chunk_id")
        every = every.unionByName(near.select("query_id", "chunk_id", F.lit(0.0).alias("score"), "text"))
    if hops >= 2:
        named = retrieval.entity_hop(asked, top, index).join(chunks.select("chunk_id", "text"), "chunk_id")
        every = every.unionByName(named.select("query_id", "chunk_id", "score", "text"))
    blocks = questions.context(every.join(asked.select("query_id", F.col("question").alias("query")), "query_id"), budget)
    has = blocks.select("query_id").distinct().withColumn("has", F.lit(True))
    rows = asked.select("query_id").join(best, F.col("query_id") == F.col("q"), "left").join(has, "query_id", "left")
    degraded = F.when(F.col("has").isNull(), "no_useful_hits").when(F.col("confidence") < THRESHOLD, "low_retrieval_confidence")
    return blocks, rows.select("query_id", F.col("a").alias("attempt"), F.round(F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1.0)), 4).alias("confidence"), degraded.alias("degraded"))
