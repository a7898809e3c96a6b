"""The log of answers and the replay of how they came about.

What tools were called is kept as it came, a VARIANT for each answer; the replay
takes the rounds of the knowledge search out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.policy import resolve_tenant, tenant_predicate

#: The tool and the strategy whose calls hold rounds.
TOOL, STRATEGY = "search_kb", "agentic"


def call(tool: Column, strategy: Column, query: Column, steps: Column) -> Column:
    """One tool's call, with its steps (an array of structs), as the log keeps it."""
    return F.struct(tool.alias("tool"), strategy.alias("strategy"), F.struct(query.alias("query")).alias("args"), steps.alias("trace"))


def logged(answers: DataFrame, calls: Column) -> DataFrame:
    """insight_id, tenant_id, thread_id, question, degraded, strategy, confidence and tool_trace (VARIANT) of answers that have all but the last."""
    columns = ("insight_id", "tenant_id", "thread_id", "question", "degraded", "strategy", "confidence")
    return answers.select(*columns, F.parse_json(F.to_json(calls)).alias("tool_trace"))


def replayed(log: DataFrame, role: str, own: str | None = None, asked: str | None = None) -> DataFrame:
    """insight_id, tenant_id, question, call (its place), query, place, step, hits, score, reasons: a row for each step of each round.

    A brand sees its own tenant's answers; another's aren't there for it.
    """
    seen = log.where(tenant_predicate(resolve_tenant(role, own, asked)))
    # Arrays of a VARIANT have no length to look at: entries are taken by casting the array once.
    calls = seen.select("insight_id", "tenant_id", "question", F.posexplode(F.col("tool_trace").cast("array<variant>")).alias("call", "c"))
    of = lambda column, path, kind: F.try_variant_get(column, path, kind)
    searches = calls.where((of("c", "$.tool", "string") == TOOL) & (of("c", "$.strategy", "string") == STRATEGY))
    steps = searches.select("insight_id", "tenant_id", "question", "call", of("c", "$.args.query", "string").alias("query"), F.posexplode(of("c", "$.trace", "array<variant>")).alias("place", "s"))
    return steps.select("insight_id", "tenant_id", "question", "call", "query", "place", *(of("s", f"$.{n}", k).alias(n) for n, k in (("step", "string"), ("hits", "long"), ("score", "double"), ("reasons", "string"))))


def recent(log: DataFrame, n: int, role: str, own: str | None = None, asked: str | None = None) -> DataFrame:
    """The latest n answers that a role may see, by id."""
    return log.where(tenant_predicate(resolve_tenant(role, own, asked))).orderBy(F.desc("insight_id")).limit(n)
