"""Platform codes to internal SKUs: exact in the shop, exact on the platform, then the nearest in the tenant."""

from __future__ import annotations

from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quern.functions.text import nfkc, normalize_code
from quern.sources.shared import kept

CUTOFF = 88.0
#: Scores looked for in turn: what is found at a higher one needs no search at a lower.
TIERS = (96.0, 92.0, CUTOFF)
#: Where any score will do, the search goes on at these.
ALL_TIERS = (*TIERS, 80.0, 70.0, 55.0, 35.0, 0.0)
#: Subsequences of a code that are looked up at most; what has more is compared outright.
MOST = 4096
#: Shapes of a side at most; beyond, lengths alone tell what can be similar.
SHAPES = 500
#: Codes of the pool in a block, where codes are compared outright.
BLOCK = 5000
#: Rows of a plan that are sent to all tasks at most.
FEW = 100_000


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    v = every = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


@pandas_udf(DoubleType())
def long_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """``lcs`` for texts of any length; null where either is."""
    return pd.Series([None if x is None or y is None else float(lcs(x, y)) for x, y in zip(a, b)], dtype="float64")


def common_length(a: Column, b: Column) -> Column:
    """``lcs`` as an expression, for texts a of 62 characters at most."""
    one = F.lit(1).cast("long")
    every = F.call_function("shiftleft", one, F.length(a)) - one
    places = F.sequence(F.lit(1), F.length(a))
    mask = lambda c: F.aggregate(places, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.when(F.substring(a, i, F.lit(1)) == c, F.call_function("shiftleft", one, i - 1)).otherwise(F.lit(0).cast("long"))))

    def step(v, c):
        u = v.bitwiseAND(mask(c))
        return (v + u).bitwiseOR(v - u).bitwiseAND(every)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.length(a) - F.bit_count(F.aggregate(F.split(b, ""), every, step)))


def without(code: Column, n: Column) -> Column:
    """The different subsequences of a code that lack n of its characters."""
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(code), lambda a, _: F.array_distinct(F.flatten(F.transform(a, less))))


def normalized(codes: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the normalized code. Only where there are texts beyond ASCII and full-width forms do rows go through Python."""
    odd = F.col(column).rlike("[^\\x00-\\x7F\\uFF01-\\uFF5E\\u3000]")
    if codes.where(odd).isEmpty():
        return codes.withColumn(to, normalize_code(F.col(column)))
    return codes.withColumn(to, normalize_code(F.coalesce(nfkc(F.when(odd, F.col(column))), F.col(column))))


class Matcher:
    """Lookup tables from rows of map_platform_sku (id, tenant_id, platform, shop_id, platform_sku_code, sku_id).

    Of rows that come to one code after normalizing, the least id counts; the
    others are conflicts if they name another SKU.
    """

    def __init__(self, mapping: DataFrame):
        self.mapping = kept(normalized(mapping, "platform_sku_code", "code").where("code <> ''"), "mapping")
        self.in_shop = self._first("tenant_id", "platform", "shop_id", "code")
        self.on_platform = self._first("tenant_id", "platform", "code")

    def _first(self, *keys: str) -> DataFrame:
        return self.mapping.groupBy(*keys).agg(F.min_by("sku_id", "id").alias("sku"))

    def conflicts(self) -> DataFrame:
        """tenant_id, platform, shop_id, code, kept and other SKU."""
        first = self.in_shop.withColumnRenamed("sku", "kept")
        return self.mapping.join(first, ["tenant_id", "platform", "shop_id", "code"]).where("sku_id <> kept").select("tenant_id", "platform", "shop_id", "code", "kept", F.col("sku_id").alias("other"))

    def scored(self, codes: DataFrame, cutoff: float) -> DataFrame:
        """Rows of ``codes`` (tenant_id, code, distinct) with each pool code of the tenant of at least ``cutoff``: matched, sku_id, score, id.

        A pair may come more than once. Codes are of shapes: what is left of a
        code without digits, and how many digits. Two codes share at most what
        their shapes share, so that most shapes needn't be compared, and a score
        says how many characters two codes of a length share in order: they then
        have a subsequence of just that many in common. Codes of two shapes meet
        by such subsequences, or outright where that makes fewer rows.
        """
        codes = kept(_shaped(codes.select("tenant_id", "code"), "code"), "codes")
        plan = kept(self._plan(codes, cutoff), "plan")
        few = F.broadcast if plan.count() <= FEW else (lambda df: df)
        asked = codes.join(few(plan.select("tenant_id", "letters", "digits", "at", F.col("x").alias("less"), "x", "y", "outright", "salts")), ["tenant_id", "letters", "digits"])
        salts = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: k.cast("long"))
        hashed = lambda code: F.transform(without(F.col(code), F.col("less")), lambda s: F.xxhash64(s))
        asked = asked.select("tenant_id", "code", "at", "x", "y", "outright", F.explode(F.when(F.col("outright"), salts).otherwise(hashed("code"))).alias("k"))
        side = plan.select("tenant_id", F.col("p_letters").alias("letters"), F.col("p_digits").alias("digits"), "at", F.col("y").alias("less"), "outright", "salts")
        own = self.shaped_pool.join(few(side), ["tenant_id", "letters", "digits"])
        own_salt = F.array(F.pmod(F.xxhash64("matched"), F.col("salts").cast("long")))
        own = own.select("at", "matched", "id", "sku_id", F.explode(F.when(F.col("outright"), own_salt).otherwise(hashed("matched"))).alias("k"))
        both = F.length("code") + F.length("matched")
        # Insertions and deletions are at least as many as edits.
        far = F.floor(both * (100 - cutoff) / 100 + 1e-9).cast("int")
        met = asked.join(own, ["at", "k"])
        if cutoff > 0:
            met = met.where(F.levenshtein("code", "matched") <= far)
        longest = codes.agg(F.max(F.length("code"))).first()[0] or 0
        long, shared = F.length("code") > 62, common_length(F.col("code"), F.col("matched"))
        if longest > 62:  # beyond a number's bits
            shared = F.when(long, long_lcs(F.when(long, F.col("code")), F.when(long, F.col("matched")))).otherwise(shared)
        # What met by a subsequence has that in common. It has more only if both sides left out a character: where each left out one, if they are the same.
        least = F.length("code") - F.col("x")
        same = (F.col("code") == F.col("matched")).cast("int")
        shared = F.when(F.col("outright"), shared).when(F.least("x", "y") == 0, least).when(F.greatest("x", "y") == 1, least + same).otherwise(shared)
        scored = met.withColumn("score", F.when(both > 0, 200.0 * shared / both).otherwise(100.0))
        return scored.where(F.col("score") >= cutoff).select("tenant_id", "code", "matched", "id", "sku_id", "score")

    def _plan(self, codes: DataFrame, cutoff: float) -> DataFrame:
        """Pairs of shapes that can reach a score: both shapes, at (their number), x and y (characters to leave out of each side's codes), outright and salts."""
        shapes = lambda df, *names: df.groupBy("tenant_id", "letters", "digits").agg(F.count("*").alias("count")).toDF("tenant_id", *names)
        q, p = shapes(codes, "letters", "digits", "q"), shapes(self.shaped_pool, "p_letters", "p_digits", "p")
        n, m = F.length("letters") + F.col("digits"), F.length("p_letters") + F.col("p_digits")
        met = q.join(p, "tenant_id").withColumns({"n": n, "m": m, "c": F.ceil(F.lit(cutoff) * (n + m) / 200 - 1e-9).cast("int")})
        met = met.where("c <= least(n, m)").withColumn("c", F.greatest("c", F.lit(0)))
        bound = common_length(F.col("letters"), F.col("p_letters")) + F.least("digits", "p_digits")
        met = met.where((F.length("letters") > 62) | (bound >= F.col("c"))).withColumns({"x": F.col("n") - F.col("c"), "y": F.col("m") - F.col("c")})
        ways = lambda n, x: F.aggregate(F.when(F.col(x) > 0, F.sequence(F.lit(1), x)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, i: a * (F.col(n) - F.col(x) + i) / i)
        met = met.withColumns({"a": ways("n", "x"), "b": ways("m", "y")})
        outright = (F.greatest("a", "b") > MOST) | (F.col("q") * F.col("p") <= 4 * (F.col("q") * F.col("a") + F.col("p") * F.col("b")))
        at = F.xxhash64("tenant_id", "letters", "digits", "p_letters", "p_digits")
        return met.select("tenant_id", "letters", "digits", "p_letters", "p_digits", at.alias("at"), "x", "y", outright.alias("outright"), F.ceil(F.col("p") / BLOCK).cast("int").alias("salts"))

    @cached_property
    def shaped_pool(self) -> DataFrame:
        return kept(_shaped(self.pool, "matched"), "shaped")

    @cached_property
    def pool(self) -> DataFrame:
        """tenant_id, matched, id, sku_id and n (length) of each code of a tenant: the least id's SKU."""
        pool = self.mapping.groupBy("tenant_id", F.col("code").alias("matched")).agg(F.min(F.struct("id", "sku_id")).alias("m"))
        return kept(pool.select("tenant_id", "matched", "m.id", "m.sku_id", F.length("matched").alias("n")), "pool")

    def _tiers(self, codes: DataFrame, n: int, tiers: tuple[float, ...] = TIERS) -> DataFrame:
        """The n best matches (rank, of equal scores the least id) of codes: of all that reach the last tier, each looked for at the first that gives n."""
        found, rest = [], codes
        for cutoff in tiers:
            rest = kept(rest, "rest")
            if rest.isEmpty():
                break
            best = kept(_best(self.scored(rest, cutoff), n), "best")
            done = best.where(F.col("rank") == n).select("tenant_id", "code")
            found.append(best if cutoff == tiers[-1] else best.join(done, ["tenant_id", "code"], "left_semi") if n > 1 else best)
            rest = rest.join(done, ["tenant_id", "code"], "left_anti")
        return reduce(DataFrame.unionByName, found) if found else _best(self.scored(codes, tiers[0]), n)

    def resolved(self, raw: DataFrame) -> DataFrame:
        """``raw`` (tenant_id, platform, shop_id, platform_sku_code, any more) with sku_id, map_confidence and match_type.

        Distinct codes are resolved once and joined back.
        """
        keys = ["tenant_id", "platform", "shop_id", "platform_sku_code"]
        codes = normalized(kept(raw.select(*keys).distinct(), "raw_codes"), "platform_sku_code", "code")
        exact = codes.join(self.in_shop.withColumnRenamed("sku", "sku1"), ["tenant_id", "platform", "shop_id", "code"], "left")
        exact = kept(exact.join(self.on_platform.withColumnRenamed("sku", "sku2"), ["tenant_id", "platform", "code"], "left"), "exact")
        open_codes = exact.where("sku1 is null and sku2 is null and code <> ''").select("tenant_id", "code").distinct()
        best = self._tiers(open_codes, 1)
        best = best.select("tenant_id", "code", F.col("sku_id").alias("sku3"), F.round(F.col("score") / 100, 3).alias("score3"))
        done = exact.join(best, ["tenant_id", "code"], "left").select(
            *keys, F.coalesce("sku1", "sku2", "sku3").alias("sku_id"),
            F.when(F.col("sku1").isNotNull(), 1.0).when(F.col("sku2").isNotNull(), 0.99).otherwise(F.coalesce("score3", F.lit(0.0))).alias("map_confidence"),
            F.when(F.coalesce("sku1", "sku2").isNotNull(), "exact").when(F.col("sku3").isNotNull(), "fuzzy").otherwise("none").alias("match_type"),
        )
        renamed = done.select(*(F.col(k).alias(f"k_{k}") for k in keys), "sku_id", "map_confidence", "match_type")
        same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) if k == keys[3] else F.col(k) == F.col(f"k_{k}") for k in keys]
        return raw.join(renamed, same, "left").drop(*(f"k_{k}" for k in keys))

    def candidates(self, codes: DataFrame, n: int = 3) -> DataFrame:
        """The n most similar codes of the tenant for each row of ``codes`` (tenant_id, code), whatever their score.

        The score looked for falls until a code has n, so that only the last few
        codes are compared with shapes that share little with theirs.
        """
        found = self._tiers(codes.select("tenant_id", "code").distinct(), n, ALL_TIERS)
        return found.select("tenant_id", "code", "rank", "matched", F.round(F.col("score") / 100, 3).alias("score"), "sku_id")


def _shaped(codes: DataFrame, column: str) -> DataFrame:
    """Adds letters and digits: the shape of a code. Where there are too many shapes, those of a length are one."""
    letters = F.regexp_replace(column, "[0-9]", "")
    most = codes.select("tenant_id", letters).distinct().groupBy("tenant_id").count().agg(F.max("count")).first()[0]
    if (most or 0) > SHAPES:
        letters = F.lit("")
    return codes.withColumn("letters", letters).withColumn("digits", F.length(column) - F.length("letters"))


def _best(found: DataFrame, n: int) -> DataFrame:
    """The n best of each code, each once. One is a plain aggregate, which leaves little to shuffle."""
    if n == 1:
        best = found.groupBy("tenant_id", "code").agg(F.min(F.struct((-F.col("score")).alias("k"), "id", "matched", "sku_id", "score")).alias("m"))
        return best.select("tenant_id", "code", "m.matched", "m.id", "m.sku_id", "m.score", F.lit(1).alias("rank"))
    once = found.groupBy("tenant_id", "code", "matched").agg(F.first(F.struct("id", "sku_id", "score")).alias("m")).select("tenant_id", "code", "matched", "m.*")
    rank = F.row_number().over(W.partitionBy("tenant_id", "code").orderBy(F.desc("score"), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= n)


def match_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("match_type").agg(F.count("*").alias("n"))
