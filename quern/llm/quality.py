"""Quality rules: a decision list learned by sequential covering, in Spark expressions.

A rule is a conjunction of thresholds ("symbol_share >= 0.11 and n_lines < 4")
that rejects a document. Rules are grown condition by condition on two thirds
of the labelled documents, cut back on the other third, and kept while they are
precise there; each next rule sees only what those before it leave. Every step
is one aggregation over all labelled rows, which returns counts by feature and
threshold. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf, log2, nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.store import dropped, staged, staged_at

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: What rules may look at, from the base columns and the shape of the text.
FEATURES = ("n_words", "n_lines", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share")
CUTS = 32


def words_of(text: Column) -> Column:
    """The words of a text, an array; empty for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns row (all of the document), id, the base counts and the features.

    Windows of five words are hashed in the document's own row and sorted there
    where any occurs twice, so that nothing is shuffled.
    """
    text = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = text.select("row", "id", "text", words_of(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    sized = split.select("*", F.size("w").alias("n"))
    hashed = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW))))
    seen = sized.select("*", F.when(F.col("n") >= WINDOW, hashed).alias("h"))
    twice = seen.select("*", (F.size(F.array_distinct("h")) < F.size("h")).alias("twice"))
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    at = twice.select("row", "id", "text", "w", "lines", "n", F.when(F.col("twice"), placed).alias("s"))
    same = lambda j, k: F.col("s")[j]["x"] == F.get("s", k)["x"]
    hit = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.coalesce(same(j, j + 1), F.lit(False)) | F.coalesce(same(j, j - 1), F.lit(False)))
    hits = at.select("row", "id", "text", "w", "lines", "n", "s", F.when(F.col("s").isNotNull(), hit).alias("j"))
    starts = hits.select("row", "id", "text", "w", "lines", "n", F.when(F.col("j").isNotNull(), F.sort_array(F.transform("j", lambda j: F.col("s")[j]["i"]))).alias("p"))
    covered = F.aggregate("p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), x - a["last"])).alias("sum")), lambda a: a["sum"])
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    counted = starts.select(
        "row", "id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("p").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        without("\\p{Lu}").cast("long").alias("n_upper"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    made = counted.select(
        "*", failed.alias("base_failed"), share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_distinct", "n_words").alias("distinct_share"), share("n_upper", "word_chars").alias("upper_share"),
    )
    # One row stays one row; a filter on the result isn't pushed below this, where it would evaluate all of the above again, within its loops.
    return made.select(F.explode_outer(F.array(F.struct("*"))).alias("q")).select("q.*")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float
    bin: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.at_least else F.col(self.feature) < self.cut

    def binned(self) -> Column:
        x = F.col("bins")[FEATURES.index(self.feature)]
        return x >= self.bin if self.at_least else x < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that the first fitting rule rejects has that rule's text, any other null."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            fits = rule[0].column()
            for c in rule[1:]:
                fits = fits & c.column()
            out = F.when(fits, " and ".join(map(str, rule))).otherwise(out)
        return out


def _gain(p: int, n: int, all_p: int, all_n: int) -> float:
    return p * (log2(p / (p + n)) - log2(all_p / (all_p + all_n))) if p else -1.0


def learned(labelled: DataFrame, max_rules: int = 12, max_conditions: int = 3, least_precision: float = 0.9, least_support: int = 5) -> DecisionList:
    """The decision list of rows with the features, ``id`` and ``bad`` (boolean).

    All rows count. Each rule's thresholds are quantiles of the features among
    the rows that the rules before it leave, of all of them and of the bad ones
    alone, so that they are as fine where bad rows are rare. Without rows, or
    without bad rows, the list is empty and rejects nothing.
    """
    spark = labelled.sparkSession
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(3)) == 0
    rows, path = staged_at(labelled.select("bad", part.alias("held"), *(F.col(f).cast("double").alias(f) for f in FEATURES)), "labelled")
    rules: list[tuple[Condition, ...]] = []
    remain = rows
    while len(rules) < max_rules:
        cuts = _cuts(remain)
        left, binned_path = staged_at(remain.select("bad", "held", F.array(*(_bin(f, cuts[f]) for f in FEATURES)).alias("bins")), "binned")
        rule: list[Condition] = []
        heldout: list[tuple[int, int]] = []
        support: list[int] = []
        inside = left
        while len(rule) < max_conditions:
            found = inside.select("bad", "held", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "held", "bad").count().collect()
            best = _best(found, cuts)
            if best is None:
                break
            gain, condition, grown, kept = best
            rule.append(condition)
            heldout.append(kept)
            support.append(grown[0] + kept[0])
            if not grown[1]:
                break
            inside = inside.where(condition.binned())
        dropped(spark, binned_path)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in heldout]
        if not worth:
            break
        keep = worth.index(max(worth)) + 1
        p, n = heldout[keep - 1]
        if support[keep - 1] < least_support or not p or p < least_precision * (p + n):
            break
        rules.append(tuple(rule[:keep]))
        fits = F.lit(True)
        for c in rule[:keep]:
            fits = fits & c.column()
        remain = remain.where(~F.coalesce(fits, F.lit(False)))
    dropped(spark, path)
    return DecisionList(tuple(rules))


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each feature: quantiles of all rows, and of the bad ones from their least value to just above their greatest."""
    inner, whole = (F.array(*(F.lit(k / CUTS) for k in ks)) for ks in (range(1, CUTS), range(CUTS + 1)))
    found = rows.agg(*(F.percentile_approx(f, inner, 10000).alias(f) for f in FEATURES), *(F.percentile_approx(F.when(F.col("bad"), F.col(f)), whole, 10000).alias(f"bad_{f}") for f in FEATURES)).first()
    bad = {f: found[f"bad_{f}"] or () for f in FEATURES}
    return {f: sorted({*(found[f] or ()), *bad[f], *(nextafter(x, inf) for x in bad[f])}) for f in FEATURES}


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many thresholds the feature reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(feature))) if cuts else F.lit(0)


def _best(found: list, cuts: dict[str, list]) -> tuple | None:
    """The condition of most gain on the growing rows: gain, condition, and its (bad, good) counts there and among the held-out rows."""
    counts: dict[tuple, int] = {(r.f, r.b, r.held, r.bad): r["count"] for r in found}
    all_of = lambda held, bad: sum(v for (f, _, h, x), v in counts.items() if f == 0 and h == held and x == bad)
    total = {(h, x): all_of(h, x) for h in (True, False) for x in (True, False)}
    if not total[False, True] or not total[False, False]:
        return None
    best = None
    for k, f in enumerate(FEATURES):
        below = dict.fromkeys(total, 0)
        for b, cut in enumerate(cuts[f], 1):
            for key in below:
                below[key] += counts.get((k, b - 1, *key), 0)
            for at_least in (True, False):
                side = {key: total[key] - below[key] if at_least else below[key] for key in total}
                gain = _gain(side[False, True], side[False, False], total[False, True], total[False, False])
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = gain, Condition(f, at_least, float(cut), b), (side[False, True], side[False, False]), (side[True, True], side[True, False])
    return best


def with_labels(features: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Feature rows whose id has a label, with ``bad``: the least label of the id is 0. Nulls are no label."""
    one = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg((F.min("y") == 0).alias("bad"))
    return features.where(~F.col("base_failed")).join(one, "id")


def judged(features: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds rule (text of the rule that rejects, else null) and kept."""
    rule = F.when(~F.col("base_failed"), rules.rejects())
    return features.select("*", rule.alias("rule"), (~F.col("base_failed") & rules.rejects().isNull()).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the base limits and the learned list keep, all columns as they were.

    Nulls and empty texts have no words and are rejected; repeated rows are
    judged alike; very long texts are judged whole. Without labels only the base
    limits decide. A column named like a feature does no harm. An empty table
    stays empty.

    The learner reads features alone, written once without the documents; their
    verdict is computed where each is read again. That costs the features twice,
    and neither a shuffle of texts nor a copy of them in the shared folder.
    """
    features, path = staged_at(with_features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").drop("row"), "features")
    rules = learned(with_labels(features, labels))
    dropped(docs.sparkSession, path)
    return judged(with_features(docs, id_col, text_col), rules).where("kept").select("row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its base counts, the base verdict and the learned list's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    features = staged(with_features(docs).drop("row"), "features")
    rules = learned(with_labels(features, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged(features, rules).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
