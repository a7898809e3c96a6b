"""Mixing sources to target weights: capped water-filling and seeded repetition.

A budget of words is shared among sources by weight; a source that would be
repeated beyond the most epochs is clamped there, and what it leaves goes to
the others by their weights until none is above. Each document then is taken a
whole number of times, and the fraction that remains by a seeded order: the
documents of a source up to the place in that order where its words reach the
target, the one document at that place in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.quality import words_of
from quern.llm.store import dropped, staged, staged_at

#: The order of a source is cut in two to this power slots.
SLOT_BITS = 12


def targets(sources: DataFrame, budget: float, epochs: float) -> DataFrame:
    """``sources`` (source, weight, source_size) with target.

    One number, the level (words per unit of weight), is raised round by round;
    sources whose cap is below their share at the level are clamped. Each round
    is one aggregate, and the clamped sources only grow. Weights that are null
    or not above zero get nothing. If every source is clamped, the targets are
    the caps and the budget is not used up.
    """
    cap, weight = F.col("source_size") * epochs, F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    level, clamped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * weight
        row = sources.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, cap).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(weight)).alias("open")).first()
        if row.n == clamped or not row.open:
            break
        clamped, level = row.n, max(level, (budget - row.used) / row.open)
    return sources.select("*", F.least(cap, F.lit(level) * weight).cast("double").alias("target") if row.open else F.when(weight > 0, cap).otherwise(0.0).cast("double").alias("target"))


def _placed(sized: DataFrame, seed: int) -> DataFrame:
    """Adds key (the source, with a value for null), h (place in the source's order) and slot."""
    h = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull(), F.lit(seed))
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    return sized.select("*", key.alias("key"), F.shiftrightunsigned(h, 1).alias("h")).select("*", F.shiftright("h", 63 - SLOT_BITS).alias("slot"))


def cut_points(sized: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """A row per source: how often its documents are taken whole, and where in its order the remaining fraction ends.

    ``sized`` has id, source and size; ``wanted`` has source, source_size and
    target. Words by source and slot of the order are summed, which gives the
    slot where the target is reached; only the documents of that slot are
    looked at one by one.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = _placed(wanted.withColumn("id", F.lit(None).cast("long")), seed).select("key", "source_size", "target", whole.alias("whole"))
    goal = goal.select("*", (F.round("target").cast("long") - F.col("whole") * F.col("source_size")).alias("rest"))
    placed = _placed(sized, seed)
    slots = placed.groupBy("key", "slot").agg(F.sum("size").alias("words"))
    to = F.sum("words").over(W.partitionBy("key").orderBy("slot"))
    ends = slots.select("key", "slot", "words", to.alias("to")).join(goal.select("key", "rest"), "key")
    cut = (F.col("to") > F.col("rest")) & (F.col("to") - F.col("words") < F.col("rest"))
    last = ends.groupBy("key").agg(F.max(F.when(F.col("to") <= F.col("rest"), F.col("slot"))).alias("last"), F.max(F.when(cut, F.col("slot"))).alias("cut"), F.max(F.when(cut, F.col("rest") - F.col("to") + F.col("words"))).alias("short"))
    goals, path = staged_at(goal.join(last, "key", "left"), "goals")
    inside = placed.join(goals.where("cut is not null").select(F.col("key").alias("k"), "cut", "short"), (F.col("key") == F.col("k")) & (F.col("slot") == F.col("cut")))
    at = inside.groupBy("key", "short", "h").agg(F.sum("size").alias("of"))
    at = at.select("*", F.sum("of").over(W.partitionBy("key").orderBy("h")).alias("to"))
    edge = at.where("to >= short and to - of < short").select("key", F.col("h").alias("edge"), (F.col("short") - F.col("to") + F.col("of")).alias("part"), "of")
    out = staged(goals.drop("short").join(edge, "key", "left"), "goals")
    dropped(sized.sparkSession, path)
    return out


def takes(sized: DataFrame, points: DataFrame, seed: int = 0) -> DataFrame:
    """``sized`` (id, source, size, any more of any names) with source_size, target and taken, which take the place of columns of those names, by the points of ``cut_points``.

    Documents that share an id share a place in the order; at the cut they share
    what is left in proportion to their sizes.
    """
    at = points.withColumnRenamed("key", "k")
    columns = [c for c in sized.columns if c not in ("source_size", "target", "taken")]
    met = _placed(sized.select(F.struct(*columns).alias("row"), "id", "source", "size"), seed).join(at, F.col("key") == F.col("k"))
    size = F.col("size")
    more = (
        F.when(F.col("slot") <= F.coalesce("last", F.lit(-1)), size)
        .when(F.col("slot") != F.coalesce("cut", F.lit(-1)), 0)
        .when(F.col("h") < F.col("edge"), size)
        .when(F.col("h") == F.col("edge"), F.floor(size * F.col("part") / F.col("of")))
        .otherwise(0)
    )
    return met.select(*(F.col("row")[c].alias(c) for c in columns), "source_size", "target", (F.col("whole") * size + more).cast("long").alias("taken"))


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def mix_points(sized: DataFrame, weights: DataFrame, share: float = 1.5, epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """``cut_points`` of ``sized`` (id, source, size) for ``weights`` (source, weight; a null source is one of its own)."""
    by_source = weights.select(F.col("source").alias("s"), F.col("weight").cast("double"))
    sums, path = staged_at(source_sizes(sized).join(by_source, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "sources")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    wanted, wanted_path = staged_at(targets(sums, share * total, epochs), "targets")
    points = cut_points(sized, wanted, seed)
    dropped(sized.sparkSession, path)
    dropped(sized.sparkSession, wanted_path)
    return points


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Weights dealt in turn to the distinct sources by code point, null last; one row a source.

    Sources are ranked in one task, a name each: meant for thousands of sources.
    For millions, such as hosts, bring a table of weights instead.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source").distinct().select("source", F.array(*map(F.lit, weights))[(rank % len(weights)).cast("int")].alias("weight"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("size"))


def repeated(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, seed: int = 0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus, columns as they were: each document as often as it is taken, a part of one cut after its first words.

    Empty and null texts are taken no words and go; so do sources without
    weight. Ids may be null or repeated, a very long text is taken whole or cut
    like any, an empty table stays empty, and further columns have any names.
    """
    sized = staged(sizes(docs, id_col, text_col, source_col), "sizes")
    points = mix_points(sized, cycled_weights(sized, weights), share, epochs, seed)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), words_of(F.col(text_col).cast("string")).alias("w"))
    met = takes(rows.select("row", "id", "source", "text", "w", F.size("w").cast("long").alias("size")), points, seed).where("taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    each = met.select("row", "text", "w", "size", "taken", F.explode(copies).alias("copy"))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    new = F.when(left >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice("w", F.lit(1), left.cast("int")), " "))
    made = each.select("row", new.alias("new"))
    return made.select(*(F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    sized = staged(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    out = takes(sized, mix_points(sized, cycled_weights(sized)))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
