import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import lines, quality

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(windows)
    covered = {p for k, w in enumerate(windows) if count[w] > 1 for p in range(k, k + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def base(df):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return Counter((r.id, *(r[c] for c in columns)) for r in quality.with_features(df).drop("row").collect())


def test_base_counts_equal_brute_force(docs, odd, none):
    for df in (docs, odd, none):
        assert base(df) == Counter((r.doc_id, *plain_counts(r.text)) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a a a a a a a", "x\ty\n\nx\x0by  x y x y x y", "é É | é & <>", " lead and trail ", "a b c d e f a b c d e f a b c d e"])
def test_base_counts_of_small_texts(spark, text):
    assert base(spark.createDataFrame([(1, text)], "doc_id long, text string")) == Counter([(1, *plain_counts(text))])


def labelled(spark):
    rows = [(k, f"w{k} " * 3 + "good plain words that go on and on for a while so that it counts " + ("".join(f"###{j}&& " for j in range(8)) if k % 3 == 0 else "".join(f"word{j}x " for j in range(8)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("rule", F.lit(0))
    return docs, spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(0, 300, 2)] + [(None, 0), (5, None)], "doc_id long, quality int")


def test_rules_are_learned_and_hold_on_rows_without_labels(spark):
    docs, labels = labelled(spark)
    kept = quality.filtered(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(300) if k % 3]


def test_rules_are_thresholds_in_order(spark):
    docs, labels = labelled(spark)
    rules = quality.learned(quality.with_labels(quality.with_features(docs), labels)).rules
    assert 1 <= len(rules) <= 3 and any(c.feature == "symbol_share" for r in rules for c in r)


def test_no_labels_keep_what_the_base_limits_keep(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    want = sorted(str(r.doc_id) for r in odd.collect() if not plain_counts(r.text)[-1])
    assert sorted(str(r.doc_id) for r in quality.filtered(odd, labels).collect()) == want
    assert quality.filtered(none, labels).count() == 0


def test_held_out_accuracy(spark, docs):
    """Learned on two thirds of the labels, the list is right on nearly all of the rest."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    features = quality.with_features(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    rows = quality.with_labels(features, labels)
    rules = quality.learned(rows.where("id % 3 <> 0"))
    judged = rows.where("id % 3 = 0").withColumn("out", rules.rejects().isNotNull())
    right, n = judged.agg(F.count_if(F.col("out") == F.col("bad")), F.count("*")).first()
    assert right >= 0.97 * n


def test_rules_are_learned_where_one_row_in_a_hundred_is_bad(spark):
    """Of 3000 rows 30 are bad, of two kinds; no other row is like them, but both lie within a 32nd of all rows."""
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        x = dict.fromkeys(quality.FEATURES, 0.5) | {"n_words": rng.randrange(20, 900), "n_lines": rng.randrange(2, 40), "symbol_share": rng.random() * 0.1, "upper_share": rng.random() * 0.2}
        if k % 100 == 7:
            x |= {"n_lines": 1} if k % 300 == 7 else {"symbol_share": 0.11 + rng.random() * 0.1}
        rows.append((k, k % 100 == 7, *(float(x[f]) for f in quality.FEATURES)))
    df = spark.createDataFrame(rows, ["id", "bad", *quality.FEATURES])
    out = df.withColumn("out", quality.learned(df).rejects().isNotNull())
    caught, lost = out.agg(F.count_if(F.col("out") & F.col("bad")), F.count_if(F.col("out") & ~F.col("bad"))).first()
    assert caught >= 28 and lost <= 3


def plain_dedup(rows):
    """(id, text) by id: the lines that stay."""
    first, spans = {}, {}
    for i, text in rows:
        full = [(k, x) for k, x in enumerate((text or "").split("\n")) if WORD.search(x)]
        for j in range(max(len(full) - 2, 1) if full else 0):
            window = full[j : j + 3]
            key = tuple(x for _, x in window)
            if first.setdefault(key, (i, window[0][0])) != (i, window[0][0]):
                spans.setdefault(i, set()).update(range(window[0][0], window[-1][0] + 1))
    return {i: (text, 0) if i not in spans else ("\n".join(x for k, x in enumerate(text.split("\n")) if k not in spans[i]), len(spans[i])) for i, text in rows}


def test_line_dedup_equals_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.text, r.line_dedup.n_lines_removed) for r in lines.deduplicated(docs).collect()}
    assert got == plain_dedup(rows)


def test_line_dedup_of_overlaps_and_odd_rows(spark, odd, none):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\nd\ny", "r\nr\nr\nr\nr", "a\nb", "a\nb", "q", "p\nq", "a\n \nb\nc\nz", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("t", F.lit("t")).withColumn("row", F.lit(2))
    out = lines.deduplicated(df)
    assert out.columns == [*df.columns, "line_dedup"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {k: v for k, (v, _) in plain_dedup(list(enumerate(texts))).items()}
    assert got[1] == "x\ny" and got[2] == "r" and got[4] == "" and got[8] is None
    assert lines.deduplicated(odd).count() == odd.count() and lines.deduplicated(none).count() == 0


def test_line_dedup_leaves_a_column_of_its_own_name_alone(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 7), (2, "a\nb\nc", 8)], "doc_id long, text string, line_dedup int")
    with pytest.raises(ValueError, match="line_dedup"):
        lines.deduplicated(df)
    out = lines.deduplicated(df, stats_col=None)
    assert out.columns == df.columns and {r.doc_id: (r.text, r.line_dedup) for r in out.collect()} == {1: ("a\nb\nc", 7), 2: ("", 8)}
    assert {r.doc_id: r.n.n_lines_removed for r in lines.deduplicated(df, stats_col="n").collect()} == {1: 0, 2: 3}


def spread(rng, bad, **values):
    x = dict.fromkeys(quality.FEATURES, 0.5) | {"n_words": float(rng.randrange(20, 900)), "symbol_share": rng.random() * 0.3, "upper_share": rng.random() * 0.3, "distinct_share": rng.random()}
    return bad, x | values


def caught(spark, rows):
    """The list learned of rows (bad, features), how many bad rows it rejects, and how many good ones."""
    df = spark.createDataFrame([(k, bad, *(float(x[f]) for f in quality.FEATURES)) for k, (bad, x) in enumerate(rows)], ["id", "bad", *quality.FEATURES])
    rules = quality.learned(df)
    out = df.withColumn("out", rules.rejects().isNotNull())
    return rules.rules, *out.agg(F.count_if(F.col("out") & F.col("bad")), F.count_if(F.col("out") & ~F.col("bad"))).first()


def test_a_rule_of_two_conditions(spark):
    """Bad is what has many symbols and many capitals; one of them alone is as often good."""
    rng = random.Random(1)
    rows = [spread(rng, False) for _ in range(2400)]
    rows = [(x["symbol_share"] >= 0.2 and x["upper_share"] >= 0.2, x) for _, x in rows]
    rules, bad, good = caught(spark, rows)
    assert any({c.feature for c in r} == {"symbol_share", "upper_share"} and len(r) == 2 for r in rules)
    assert bad >= 0.95 * sum(b for b, _ in rows) and good <= 5


def test_two_rules_in_order(spark):
    """Two kinds of bad rows that no one rule holds: the list has one for the larger kind first."""
    rng = random.Random(2)
    rows = [spread(rng, False) for _ in range(1200)]
    rows += [spread(rng, True, symbol_share=0.5 + rng.random()) for _ in range(300)] + [spread(rng, True, distinct_share=-rng.random() - 0.1) for _ in range(120)]
    rules, bad, good = caught(spark, rows)
    assert [r[0].feature for r in rules][:2] == ["symbol_share", "distinct_share"]
    assert bad >= 415 and good <= 2
