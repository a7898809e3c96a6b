"""URL filters: given rules first, association rules for the rest.

Given rules name a host and the beginning of a path; the longest that fits
decides. The pages that they decide are labelled by them, and their URLs'
tokens are mined for what goes with "block":

- Tokens are counted. Those that occur on the same labelled rows throughout are
  one item, named by the least of them, so that a hundred words that always come
  together are one word to the miner.
- An item that is surer than any longer rule could be (all its rows are
  blocked) is a rule of its own and is not mined. One on every labelled row says
  nothing and isn't mined either: without it a rule has the same rows.
- FP-growth mines the combinations of the other items on the blocked rows of at
  most ``most_items`` of them. Rows of more would have it list every subset of
  their items: there, ``searched`` grows combinations of any length item by item
  and follows only those that a rule can still come from. What is frequent is on
  such a row, or it is frequent on the others alone: no combination is lost.
- Every combination is counted over all labelled rows, by inverted index, so
  that confidence and support are exact. Rules of enough of both stay, without
  those that a shorter rule of as much confidence makes needless.

URLs that no given rule fits are blocked by the rules whose items they hold:
each rule is filed under its rarest item, so that a URL meets only the rules of
its own items.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.store import dropped, staged, staged_at

#: (host, path, verdict); fixed by the contract of op4.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for a null and without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the scheme, each part of the host with its place, and words of the path and the query, numbers as one token."""
    word = lambda kind, x: F.transform(x, lambda t: F.concat(F.lit(kind), F.when(t.rlike("^[0-9]+$"), "#").otherwise(F.lower(t))))
    parts = F.filter(F.split(host, "\\."), lambda t: t != "")
    last = F.when(F.size(parts) > 0, F.array(F.concat(F.lit("tld:"), F.element_at(parts, -1)))).otherwise(F.array().cast("array<string>"))
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://[^?#]*(.*)$", 1)
    pieces = lambda x: F.filter(F.split(x, "[^\\p{L}\\p{N}_]+"), lambda t: t != "")
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1))))
    return F.array_distinct(F.concat(scheme, last, word("host:", parts), word("path:", pieces(path)), word("query:", pieces(rest))))


def with_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))


def rule_verdict(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does.

    Of equally long ones the greatest text by code point wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def items_of(rows: DataFrame, n: int, need: int) -> DataFrame:
    """token, item, n and b (rows of the item, and blocked ones) for the tokens of at least ``need`` blocked rows.

    ``rows`` has row, tokens and blocked. Tokens of the same rows, by count and
    two sums of the rows' hashes, share an item. Those on all ``n`` rows are
    left out.
    """
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    h = F.xxhash64("row")
    sums = each.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("blocked").alias("b"), F.sum(F.shiftrightunsigned(h, 24)).alias("h1"), F.bit_xor(h).alias("h2")
    )
    often = staged(sums.where((F.col("b") >= need) & (F.col("n") < n)), "tokens")
    named = often.groupBy("n", "b", "h1", "h2").agg(F.min("token").alias("item"))
    return staged(often.join(named, ["n", "b", "h1", "h2"]).select("token", "item", "n", "b"), "items")


def itemed(rows: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """key and items (an array, each once) of rows (key, tokens) that hold a token of the vocabulary (token, item)."""
    each = rows.select(key, F.explode("tokens").alias("token"))
    return each.join(vocabulary.select("token", "item"), "token").groupBy(key).agg(F.collect_set("item").alias("items"))


def met(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The columns of rows (items, any more) and of the rules (key, needs, any more) all of whose items they hold."""
    each = rows.select("*", F.explode("items").alias("at")).join(rules, F.col("at") == F.col("key"))
    return each.where(F.size(F.array_except("needs", "items")) == 0).drop("at")


def _filed(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Rules (rule, tokens, any more) with key, the rarest of their items by ``items`` (item, n); of equals the least."""
    each = rules.select("rule", F.explode("tokens").alias("item")).join(items.select("item", "n").distinct(), "item")
    key = each.groupBy("rule").agg(F.min(F.struct("n", "item")).alias("k")).select(F.col("rule").alias("of"), F.col("k.item").alias("key"))
    return rules.join(key, F.col("rule") == F.col("of")).drop("of")


def searched(alike: DataFrame, need: int, most_items: int, least_confidence: float) -> DataFrame:
    """tokens (sorted) of combinations of two items or more, all rules among them that may be wanted from rows of many items.

    ``alike`` has items (an array), n and b: rows of these items, and blocked
    ones. Combinations are of at least ``need`` blocked rows, one of them at least
    of more than ``most_items`` items, and of enough confidence; of any length.
    Those of a part with as few rows that aren't blocked are left out: the part
    is as sure.

    Combinations grow by items that come later in an order by doubt. Each has the
    rows that hold it, projected on the items it can still grow by; equal
    projections are one row with the sum of the counts. One is given up, with
    all that would grow from it, if the rows that hold it and everything it can
    grow by, and aren't blocked, are too many for any rule.
    """
    rows = alike.select("*", F.when(F.size("items") > most_items, F.col("b")).otherwise(0).alias("l"))
    sums = lambda x: x.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("l").alias("l"))
    frequent = (F.col("b") >= need) & (F.col("l") > 0)
    # An item's key begins with its doubt, in ten digits, so that the surest come first.
    doubt = F.format_string("%010d", ((F.col("n") - F.col("b")) / F.col("n") * 1e9).cast("long"))
    keys = sums(rows.select("n", "b", "l", F.explode("items").alias("item")).groupBy("item")).where(frequent)
    keys = staged(keys.select("item", F.concat(doubt, "item").alias("at")), "keys")
    keyed = rows.select("*", F.explode("items").alias("item")).join(keys, "item").groupBy("items", "n", "b", "l").agg(F.sort_array(F.collect_set("at")).alias("rest"))
    level, path = staged_at(sums(keyed.groupBy(F.array().cast("array<string>").alias("tokens"), "rest")), "level")
    known = level.groupBy("tokens").agg(F.sum("b").alias("b"), F.sum(F.col("n") - F.col("b")).alias("a"))
    found = []
    while not level.isEmpty():
        grown = sums(level.select("tokens", "n", "b", "l", F.explode("rest").alias("at")).groupBy("tokens", "at")).where(frequent)
        grown = staged(grown.select("tokens", "at", F.concat("tokens", F.array("at")).alias("whole"), "b", (F.col("n") - F.col("b")).alias("a")), "grown")
        parts = grown.select("whole", "a", F.explode(F.transform("whole", lambda t: F.array_remove("whole", t))).alias("tokens"))
        as_sure = parts.join(known.select("tokens", "a"), ["tokens", "a"]).select("whole").distinct()
        alive = staged(grown.join(as_sure, "whole", "left_anti"), "alive")
        tails = staged(alive.groupBy("tokens").agg(F.collect_set("at").alias("tail"), F.collect_set(F.when(F.col("a") > 0, F.col("at"))).alias("open")), "tails")
        whole = F.size(F.array_except("tail", "rest")) == 0
        left = level.join(tails, "tokens").groupBy("tokens").agg(F.sum(F.when(whole, F.col("n") - F.col("b")).otherwise(0)).alias("left"))
        # A little less than the bound, for rounding: what is given up is surely no rule.
        hope = left.join(known, "tokens").where(F.col("b") >= least_confidence * (F.col("left") + F.col("b")) * (1 - 1e-9))
        hope = staged(hope.select("tokens").join(tails, "tokens"), "hope")
        sure = alive.join(hope, "tokens", "left_semi").where((F.size("whole") > 1) & (F.col("b") >= least_confidence * (F.col("a") + F.col("b"))))
        found.append(sure.select(F.sort_array(F.transform("whole", lambda t: F.substring(t, 11, 1 << 30))).alias("tokens")))
        narrow = level.join(hope, "tokens").select("tokens", "open", "n", "b", "l", F.array_intersect("rest", "tail").alias("rest"))
        each = narrow.select("*", F.posexplode("rest").alias("k", "at")).where(F.array_contains("open", F.col("at")))
        each = each.select(F.concat("tokens", F.array("at")).alias("tokens"), F.slice("rest", F.col("k") + 2, F.size("rest")).alias("rest"), "n", "b", "l")
        done, (level, path) = path, staged_at(sums(each.where(F.size("rest") > 0).groupBy("tokens", "rest")), "level")
        dropped(alike.sparkSession, done)
        known = alive.select(F.col("whole").alias("tokens"), "b", "a")
    return reduce(DataFrame.unionByName, found) if found else alike.select(F.col("items").alias("tokens")).limit(0)


def mined(labelled: DataFrame, least_support: float = 0.001, least_confidence: float = 0.9, most_items: int = 10) -> DataFrame:
    """Rules for blocking: rule, tokens (its items), confidence and support, from rows of tokens (array) and verdict.

    All rows count, repeated ones as often as they come. Without rows, or
    without two blocked ones, there are no rules.
    """
    return mined_with_items(labelled, least_support, least_confidence, most_items)[0]


def mined_with_items(labelled: DataFrame, least_support: float = 0.001, least_confidence: float = 0.9, most_items: int = 10) -> tuple[DataFrame, DataFrame]:
    """``mined`` and the items (token, item, n, b) that its rules are made of."""
    blocked = F.coalesce(F.col("verdict") == "block", F.lit(False))
    rows = staged(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", blocked.alias("blocked")), "labelled")
    n, b = rows.agg(F.count("*"), F.count_if("blocked")).first()
    need = max(2, ceil(least_support * n))
    items = items_of(rows, n, need)
    each = items.groupBy("item").agg(F.first("n").alias("n"), F.first("b").alias("b"))
    single = each.where(F.col("b") >= least_confidence * F.col("n"))
    rules = [single.select(F.col("item").alias("rule"), F.array("item").alias("tokens"), "n", "b", F.lit(True).alias("asked"))]
    mixed = items.where("b < n")
    held = itemed(rows, "row", mixed)
    held = held.join(rows.select("row", "blocked"), "row").groupBy(F.sort_array("items").alias("items"))
    alike = staged(held.agg(F.count("*").alias("n"), F.count_if("blocked").alias("b")), "alike")
    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offered = alike.where("b > 0")
    short = offered.where(F.size("items") <= most_items).select("items", F.explode(F.sequence(F.lit(1), F.col("b"))))
    short = staged(short.select("items").repartition(tasks), "offered")
    m, many = short.count(), offered.where(F.size("items") > most_items).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    sets = []
    if m >= need:
        grown = FPGrowth(itemsCol="items", minSupport=need / m * (1 - 1e-9), numPartitions=tasks).fit(short).freqItemsets
        sets.append(grown.where(F.size("items") > 1).select(F.sort_array("items").alias("tokens"), F.lit(True).alias("asked")))
    if many and m + many >= need:
        found = staged(searched(alike, need, most_items, least_confidence), "found")
        sets.append(found.select("tokens", F.lit(True).alias("asked")))
        # Their parts are counted only to compare.
        parts = found.where(F.size("tokens") > 2).select(F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("tokens"))
        sets.append(parts.select("tokens", F.lit(False).alias("asked")))
    if sets:
        grown = reduce(DataFrame.unionByName, sets).groupBy("tokens").agg(F.max("asked").alias("asked"))
        grown = staged(grown.withColumn("rule", F.array_join("tokens", " ")), "grown")
        filed = _filed(grown, items).select("rule", "key", F.col("tokens").alias("needs"))
        counts = met(alike, filed).groupBy("rule").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        counts = counts.where((F.col("b") >= need) & (F.col("b") >= least_confidence * F.col("n")))
        rules.append(grown.join(counts, "rule").select("rule", "tokens", "n", "b", "asked"))
    kept = rules[0] if len(rules) == 1 else rules[0].unionByName(rules[1])
    kept = staged(kept.select("rule", "tokens", (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / n if n else F.lit(0.0)).alias("support"), "asked"), "rules")
    # A rule is needless if one with an item less is as sure.
    less = F.transform("tokens", lambda t: F.array_join(F.array_remove("tokens", t), " "))
    parts = kept.where(F.size("tokens") > 1).select("rule", "confidence", F.explode(less).alias("part"))
    shorter = kept.select(F.col("rule").alias("part"), F.col("confidence").alias("sure"))
    needless = parts.join(shorter, "part").where("sure >= confidence").select("rule").distinct()
    return staged(kept.where("asked").drop("asked").join(needless, "rule", "left_anti"), "rules"), items


def judged(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    least_support: float = 0.001,
    least_confidence: float = 0.9,
    most_items: int = 10,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, and mined (the surest mined rule where one blocks, else null).

    Null and malformed URLs have an empty host and path; no given rule fits them
    and they are allowed, as are URLs without a mined rule. A URL on many pages
    counts as often in the rules. Ids may be null and repeated; very long URLs
    are taken whole; an empty table gives no rows; other columns are left out,
    whatever their names.
    """
    parts = with_parts(pages, id_col, url_col)
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    given = parts.select("*", rule.alias("rule"), verdict.alias("given"))
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    found, items = mined_with_items(given.where("given is not null").select(tokens, F.col("given").alias("verdict")), least_support, least_confidence, most_items)
    index = staged(_filed(found, items).select("key", F.col("rule").alias("name"), F.col("tokens").alias("needs"), "confidence", "support"), "index")
    used = index.select(F.explode("needs").alias("item")).distinct()
    # One judgement for each distinct URL that no given rule fits.
    open_urls = given.where("given is null and url is not null").groupBy("url", "host", "path").count().select("url", tokens)
    hits = met(itemed(open_urls, "url", items.join(used, "item", "left_semi")), index)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", "support", "name")).alias("m"))
    best = staged(best.select(F.col("url").alias("u"), F.col("m.name").alias("mined")), "best")
    out = given.join(best, F.col("url") == F.col("u"), "left")
    hit = F.when(F.col("given").isNull(), F.col("mined"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(hit.isNotNull(), "block").otherwise("allow")).alias("verdict"), hit.alias("mined"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
