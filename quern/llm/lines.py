"""Line dedup by overlapping three-line windows.

Windows of three consecutive lines (lines without a word left out) are hashed
in the document's row. The first occurrence of each window over the whole
table, by document and place, stays; lines that any later occurrence covers
go. Every removed line so has an earlier copy that stays. A text of fewer than
three lines is one window of all its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import staged

LINES = 3


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per window: id, t (hash of the text), a and b (its first and last line) and the window's hashes h1 and h2."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = text.select("id", F.xxhash64("text").alias("t"), F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))).alias("lines"))
    full = lines.select("id", "t", F.filter("lines", lambda x: x["x"].rlike("[^\\x20\\x09-\\x0D]")).alias("l"))
    line = lambda j, k: F.get("l", j + k)["x"]
    last = lambda j: F.least(j + (LINES - 1), F.size("l") - 1)
    window = lambda j: F.struct(F.get("l", j)["i"].alias("a"), F.get("l", last(j))["i"].alias("b"), F.xxhash64(*(line(j, k) for k in range(LINES))).alias("h1"), F.xxhash64(F.lit("again"), *(line(j, LINES - 1 - k) for k in range(LINES))).alias("h2"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("l") - LINES, F.lit(0)))
    made = full.select("id", "t", F.transform(starts, window).alias("w"))
    # An outer explode: the filter that Spark infers for a plain one would evaluate all of the above again, within its loops.
    return made.select("id", "t", F.explode_outer("w").alias("w")).where("w.a is not null").select("id", "t", "w.*")


def covered_lines(windows: DataFrame) -> DataFrame:
    """For each text with lines to remove: id, t and spans, an array of (a, b), first and last line of later occurrences."""
    place = F.struct(F.col("id").isNull().alias("null"), "id", "t", "a")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    first = first.select(F.col("h1").bitwiseXOR(F.lit(0).cast("long")).alias("k1"), F.col("h2").bitwiseXOR(F.lit(0).cast("long")).alias("k2"), "first")
    later = windows.join(first, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(place != F.col("first"))
    return later.groupBy("id", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stats_col: str | None = "line_dedup") -> DataFrame:
    """The documents, all columns, with ``text_col`` without covered lines.

    ``stats_col``, unless it is None, is added: a struct of n_lines_in and
    n_lines_removed. A column of that name in ``docs`` is an error.

    A null text stays null, and a text whose lines all go becomes empty. Rows
    that repeat an id and a text are one document: both stay whole or lose the
    same lines. Null ids come last in the order. Very long texts are taken
    whole. An empty table stays empty.
    """
    if stats_col is not None and stats_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {stats_col} already: name another, or None, for the counts of lines")
    windows = staged(line_windows(docs, id_col, text_col), "windows")
    covered = covered_lines(windows).select(F.col("id").alias("k"), F.col("t").alias("kt"), "spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The text is beside the other columns, not among them too: it is what the join shuffles.
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("row", "id", "text", F.xxhash64(text).alias("t"))
    met = rows.join(covered, F.col("id").eqNullSafe(F.col("k")) & (F.col("t") == F.col("kt")), "left")
    # The lines that spans cover, each once.
    merged = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["a"], x["b"]))))
    lines = met.select("row", "text", "spans", F.split("text", "\n").alias("lines")).select("*", F.when(F.col("spans").isNotNull(), merged).alias("gone"))
    marked = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = lines.select("row", "text", "lines", "gone", F.when(F.col("gone").isNotNull(), marked).alias("stay"))
    joined = F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n")
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(joined)
    stats = F.struct(F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines_in"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_lines_removed"))
    made = kept.select("row", new.alias("new"), stats.alias("stats"))
    columns = [F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return made.select(*columns, *([F.col("stats").alias(stats_col)] if stats_col is not None else []))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: its count of lines, how many went, and the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", F.col("line_dedup.n_lines_in").alias("n_lines"), F.col("line_dedup.n_lines_removed").alias("n_removed"), "text")


#: DuckDB compares the lines themselves.
OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) x
), worded AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, count(*) OVER (PARTITION BY doc_id) AS m
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), ahead AS (
  SELECT doc_id, i, j, m, line, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3 FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY j)
), windows AS (
  SELECT doc_id, i AS a, coalesce(i3, i2, i) AS b, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) AS nth FROM ahead WHERE j <= greatest(m - 2, 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM windows WHERE nth > 1
)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL WHEN g.n IS NULL THEN d.text ELSE coalesce(s.kept, '') END AS text
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) c USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id) s USING (doc_id)
"""
