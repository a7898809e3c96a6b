"""A Merkle manifest of a dataset: a digest for each row, for each source and for all, and each row's proof.

A row's place among its source's rows decides where it hangs in the tree.
Places come from histograms of the keys' hexadecimal digits, without a sort of
all rows: rows are counted by their leading digits, prefixes with many rows by
more digits, level by level, and sums over the counts of the prefixes before
say how many rows come before one's own. Only the rows of one prefix, a bounded
number, are ordered among each other.

The digits of a place to the base of the tree's fanout then are the row's path:
all nodes of a level that share all digits but the last have one parent. Levels
are reduced from the longest prefixes up. On the way back each node hands its
children their siblings, so that a proof needs no search.
"""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.store import staged

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digits by which a prefix that holds many rows is lengthened.
DIGITS = 3
#: Rows of a prefix that are ordered in one task at least; more where a hundred-thousandth of all rows is more.
MOST, BIGGEST = 1 << 16, 100_000
#: Copies of one row that a task makes.
COPIES = 4096


def hash_text(*parts: Column) -> Column:
    """The SHA-256 of texts put together, in lower-case hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def told(value: Column) -> Column:
    """A value as it is hashed: - for a null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return hash_text(*map(told, values))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digits_of(value: Column, kind: str) -> Column:
    """Hexadecimal digits that sort as the values do, nulls first: those of a whole number with its sign turned, or of a text's bytes and a blank."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        digits = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    else:
        digits = F.concat(F.hex(value.cast("string").cast("binary")), F.lit(" "))
    return F.coalesce(F.concat(F.lit("1"), digits), F.lit("0"))


def ranked(rows: DataFrame, key: Column, most: int | None = None) -> DataFrame:
    """Adds rank: how many copies of rows of the same g come before by ``key``, digits that no two rows of a g share.

    ``rows`` has g, copies and any more. Prefixes of more than ``most`` rows are
    counted by longer ones; there are ``BIGGEST`` of those at most, so that they
    are sent to all tasks.
    """
    n, low, high = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    most = most or max(MOST, -(-n // BIGGEST))
    length = len(commonprefix([low or "", high or ""])) + DIGITS
    inside, levels = rows.select("g", "copies", key.alias("key")), []
    while True:
        counts = staged(inside.groupBy("g", F.substring("key", 1, length).alias("label")).agg(F.count("*").alias("n"), F.sum("copies").alias("copies")), "digits")
        big = counts.where(F.col("n") > most).select("g", "label")
        levels.append((length, counts, big))
        if big.isEmpty():
            break
        inside = inside.withColumn("label", F.substring("key", 1, length)).join(F.broadcast(big), ["g", "label"], "left_semi")
        length += DIGITS
    ends, above, label = [], None, F.substring("key", 1, levels[0][0])
    out = rows.withColumn("key", key)
    for length, counts, big in levels:
        # A prefix has as many lengthened ones as DIGITS digits make.
        before = F.sum("copies").over(W.partitionBy("g", "parent").orderBy("label").rowsBetween(W.unboundedPreceding, -1))
        placed = counts.withColumn("parent", F.substring("label", 1, length - DIGITS)).withColumn("before", F.coalesce(before, F.lit(0)))
        if above is not None:
            placed = placed.join(above.select("g", F.col("label").alias("parent"), F.col("before").alias("more")), ["g", "parent"]).withColumn("before", F.col("before") + F.col("more"))
        ends.append(placed.where(F.col("n") <= most).select(F.col("g").alias("of"), F.col("label").alias("end"), "before"))
        above = placed.where(F.col("n") > most)
        if length != levels[-1][0]:
            out = out.join(F.broadcast(big.select(F.col("g").alias("of"), F.col("label").alias("end"))), (F.col("g") == F.col("of")) & (F.substring("key", 1, length) == F.col("end")), "left")
            label = F.when(F.col("end").isNotNull(), F.substring("key", 1, length + DIGITS)).otherwise(label)
            out = out.withColumn("label", label).drop("of", "end")
            label = F.col("label")
    out = out.withColumn("label", label).join(reduce(DataFrame.unionByName, ends), (F.col("g") == F.col("of")) & (F.col("label") == F.col("end"))).drop("of", "end")
    within = F.sum("copies").over(W.partitionBy("g", "label").orderBy("key").rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("rank", F.col("before") + F.coalesce(within, F.lit(0))).drop("before", "label", "key")


def spread(rows: DataFrame) -> DataFrame:
    """Each row as often as copies says, at places of its own: pos in place of rank and copies."""
    parts = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("part"))
    if (rows.agg(F.max("copies")).first()[0] or 0) > COPIES:
        parts = parts.repartition("g", F.col("rank") + F.col("part"))
    each = parts.select("*", F.explode(F.sequence("part", F.least(F.col("part") + COPIES, "copies") - 1)).alias("copy"))
    return each.withColumn("pos", F.col("rank") + F.col("copy")).drop("rank", "copies", "part", "copy")


def grouped(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """g, pos and d of the parents of a level, with their members (i, d, any more) in order.

    ``nodes`` has g, pos, d and any more. A g's only node has no parent: it goes
    up as it is. No other run at place 0 has one member.
    """
    more = [c for c in nodes.columns if c not in ("g", "pos", "d")]
    i = F.pmod("pos", F.lit(fanout)).cast("int")
    runs = nodes.groupBy("g", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.sort_array(F.collect_list(F.struct(i.alias("i"), "d", *more))).alias("members"))
    alone = (F.col("pos") == 0) & (F.size("members") == 1)
    parent = F.unhex(hash_text(F.array_join(F.transform("members", lambda m: _hex(m["d"])), "")))
    return runs.select("g", "pos", F.when(alone, F.get("members", F.lit(0))["d"]).otherwise(parent).alias("d"), "members")


def levels_of(nodes: DataFrame, n: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above nodes (g, pos, d, any more) of gs of ``n`` nodes at most, up to one node each. One level at least."""
    found = [staged(grouped(nodes, fanout), "level")]
    n = -(-n // fanout)
    while n > 1:
        found.append(staged(grouped(found[-1].select("g", "pos", "d"), fanout), "level"))
        n = -(-n // fanout)
    return found


def handed_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's members with path, their siblings level by level, and what ``tops`` (g, path, any more) says of their g.

    A path's step is the digests left and right of a node, in one piece each.
    """
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.select("g", F.lit(0).cast("long").alias("pos"), "path", *more)
    for level in reversed(levels):
        joined = lambda keep: F.aggregate(F.filter("members", keep), F.lit(b""), lambda a, m: F.concat(a, m["d"]))
        met = level.drop("d").join(above, ["g", "pos"]).select("*", F.explode("members").alias("m"))
        at = F.col("m.i")
        step = F.struct(joined(lambda m: m["i"] < at).alias("left"), joined(lambda m: m["i"] > at).alias("right"))
        alone = (F.col("pos") == 0) & (F.size("members") == 1)
        path = F.when(alone, F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        below = met.select("g", (F.col("pos") * FANOUT + at).alias("pos"), path.alias("path"), *more, "m")
        above = below.drop("m")
    return below.select("g", "pos", "path", *more, "m.*")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda a, s: hash_text(_hex(s["left"]), a, _hex(s["right"])))


def proof_of(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return hash_text(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", changed: Column | None = None, most: int | None = None) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof (the siblings left and right, level by level) and folded_root.

    A leaf is the digest of ``columns``, ``changed`` one of other content that is
    held against the original's proof, or null: folded_root comes from it, or
    from the leaf without. Leaves ascend by id in each source, nulls first,
    then by leaf; runs of ``FANOUT`` have a parent, level by level, and so have
    the sources, nulls first, then by their bytes.

    Ids may be whole numbers or texts, null and repeated; equal rows have places
    of their own next to each other and are counted, not gathered. Null columns
    are part of a leaf; a very long text is hashed whole; an empty table gives no
    rows; other columns are left out, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    changed = F.lit(None).cast("string") if changed is None else changed
    leaf = leaf_of(*(F.col(c) for c in columns))
    g = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    leaves = docs.select(g.alias("g"), F.col(id_col).alias("id"), F.unhex(leaf).alias("d"), F.unhex(changed).alias("other"))
    leaves = staged(leaves.groupBy("g", "id", "d", "other").agg(F.count("*").alias("copies")), "leaves")
    key = F.concat(digits_of(F.col("id"), kind), F.hex("d"), F.coalesce(F.hex("other"), F.lit("")))
    sizes = staged(leaves.groupBy("g").agg(F.sum("copies").alias("n")), "sizes")
    n, sources = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    levels = levels_of(spread(ranked(leaves, key, most)), n)
    subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "d", F.lit(1).cast("long").alias("copies"))
    places = ranked(staged(subroots, "subroots"), F.hex(F.col("source").cast("binary")), most).withColumnRenamed("rank", "pos").drop("copies")
    top = levels_of(places, sources)
    root = top[-1].select("g", F.col("d").alias("root"), F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    tops = handed_down(top, root).select(F.col("source").alias("g"), "path", F.col("d").alias("subroot"), "root")
    rows = handed_down(levels, tops)
    leaf, root = _hex(F.col("d")), _hex(F.col("root"))
    return rows.select(F.col("id").alias("doc_id"), leaf.alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), F.col("path").alias("proof"), folded(F.coalesce(_hex(F.col("other")), leaf), F.col("path")).alias("folded_root"))


def lower_cased(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the root folded from it, or from a copy with a lower-cased text where five divides the id's CRC-32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    other = F.when(chosen, leaf_of(*(lower_cased(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS)))
    found = manifest(docs, changed=other)
    columns = ("doc_id", "leaf", "subroot", "root", proof_of(F.col("proof")).alias("proof_sha256"), "folded_root")
    return found.select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 5, tops: int = 3) -> str:
    """The same in DuckDB's SQL, for sources of up to 16 ** levels rows and 16 ** tops sources."""
    told = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(told(c) for c in COLUMNS[:-1])} || {told(text)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        "RECURSIVE bits(i, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8)",
        "crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8)",
        "checked AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1])), 4294967295) AS h FROM documents d, crc)",
        f"leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS s, {leaf('text')} AS d, CASE WHEN h % 5 = 0 THEN {leaf(lower)} END AS other FROM checked)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, d, other NULLS FIRST) - 1 AS pos FROM leaves)",
    ]

    def up(name: str, k: int, keys: str) -> str:
        return f"{name}{k + 1} AS (SELECT {keys} pos // 16 AS pos, CASE WHEN pos // 16 = 0 AND count(*) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{k} GROUP BY {keys} pos // 16)"

    def beside(name: str, k: int, keys: str) -> str:
        same = f"x.{keys[:-1]} = y.{keys[:-1]} AND " if keys else ""
        own = f"x.{keys[:-1]} AS s, " if keys else ""
        text = lambda op: f"coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (WHERE y.pos {op} x.pos), '')"
        return f"{name}s{k} AS (SELECT {own}x.pos, {text('<')} AS l, {text('>')} AS r FROM {name}{k} x JOIN {name}{k} y ON {same}x.pos // 16 = y.pos // 16 GROUP BY ALL)"

    parts += [up("a", k, "s,") for k in range(levels)] + [beside("a", k, "s,") for k in range(levels)]
    parts.append(f"b0 AS (SELECT s, d, row_number() OVER (ORDER BY encode(s)) - 1 AS pos FROM a{levels})")
    parts += [up("b", k, "") for k in range(tops)] + [beside("b", k, "") for k in range(tops)]
    step = lambda n: f"CASE WHEN l = '' AND r = '' AND place // 16 = 0 THEN f ELSE sha256(l || f || r) END AS f, p || l || r AS p, place // 16 AS place"
    parts.append("f0 AS (SELECT doc_id, s, d AS leaf, coalesce(other, d) AS f, '' AS p, pos AS place FROM a0)")
    parts += [f"f{k + 1} AS (SELECT doc_id, f.s, leaf, {step(k)} FROM f{k} f JOIN as{k} x ON x.s = f.s AND x.pos = place)" for k in range(levels)]
    parts.append(f"g0 AS (SELECT doc_id, leaf, b0.d AS subroot, f, p, b0.pos AS place FROM f{levels} JOIN b0 USING (s))")
    parts += [f"g{k + 1} AS (SELECT doc_id, leaf, subroot, {step(k)} FROM g{k} JOIN bs{k} x ON x.pos = place)" for k in range(tops)]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM g{tops}, (SELECT d AS root FROM b{tops}) t"


OP11_SQL = _sql()
