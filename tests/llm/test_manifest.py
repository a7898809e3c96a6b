"""The manifest against a tree built in plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root and each node's siblings (left, right), level by level."""
    paths, level, places = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for n, at in enumerate(places):
            a = at // 16 * 16
            paths[n].append(("".join(level[a:at]), "".join(level[at + 1 : a + 16])))
        level = [H(*level[a : a + 16]) for a in range(0, len(level), 16)]
        places = [at // 16 for at in places]
    return level[0], paths


def brute(rows, columns, changed=lambda r: None):
    """(doc_id, leaf, subroot, root, proof, folded_root) of rows as dicts."""
    by_source = defaultdict(list)
    for r in rows:
        leaf, other = H(*(told(r[c]) for c in columns)), changed(r)
        by_source[r["source"]].append((r["doc_id"] is not None, r["doc_id"], leaf, other or "", r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        by_source[s].sort(key=lambda x: (x[0], x[1] if x[0] else 0, x[2], x[3]))
        made[s] = tree([x[2] for x in by_source[s]])
    root, tops = tree([made[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, doc_id, leaf, other, _), path in zip(by_source[s], made[s][1]):
            whole, at = path + top, other or leaf
            for left, right in whole:
                at = H(left, at, right)
            out.append((doc_id, leaf, made[s][0], root, H(*(left + right for left, right in whole)), at))
    return out


def same(spark, rows, schema, columns=("doc_id", "source", "text"), most=None, changed=None, plain=lambda r: None):
    table = spark.createDataFrame(rows, schema)
    found = manifest.manifest(table, columns, changed=changed, most=most)
    found = found.withColumn("proof", manifest.proof_of(F.col("proof"))).collect()
    want = brute([dict(zip(table.columns, r)) for r in rows], columns, plain)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


SCHEMA = "doc_id long, source string, text string, rank long, copies string"


@pytest.mark.parametrize("most", [None, 3])
def test_sources_of_every_size(spark, most):
    rows = [(k * 7 - 900, s, f"text {k}", k, "x") for s, n in (("a", 300), ("b", 17), ("c", 16), ("d", 1), (None, 2), ("", 33), ("é", 1)) for k in range(n)]
    same(spark, rows, SCHEMA, most=most)


def test_more_sources_than_a_run_holds(spark):
    same(spark, [(k, f"s{k % 40}", "t", k, "x") for k in range(100)], SCHEMA)


def test_nulls_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPIES", 4)
    rows = [(5, "a", "same", 0, "")] * 21 + [(5, "a", f"tie {k}", 0, "") for k in range(30)] + [(None, "a", None, 1, None), (None, "a", "x", 1, None), (None, None, None, None, None), (2**63 - 1, "a", "", 1, ""), (-(2**63), "a", "ü" * 5000, 1, "")]
    same(spark, rows, SCHEMA, most=2)


def test_ids_of_text(spark):
    rows = [(i, s, "t", 0, "") for s in ("a", "b") for i in ("", "a", "aa", "ab", "b", "é", "z" * 40, None)]
    same(spark, rows, SCHEMA.replace("doc_id long", "doc_id string"), most=1)


def test_a_changed_row_does_not_verify_and_others_do(spark):
    rows = [(k, "ab"[k % 2], "Text" if k % 3 else "text", 0, "") for k in range(50)]
    other = F.when(F.col("doc_id") % 2 == 0, manifest.leaf_of(F.col("doc_id"), F.col("source"), manifest.lower_cased(F.col("text"))))
    same(spark, rows, SCHEMA, changed=other, plain=lambda r: H(told(r["doc_id"]), told(r["source"]), told(r["text"].lower())) if r["doc_id"] % 2 == 0 else None)
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA), ("doc_id", "source", "text"), changed=other).collect()
    assert all((r.folded_root != r.root) == (r.doc_id % 2 == 0 and r.doc_id % 3 != 0) for r in found)


def test_one_row_and_none(spark, none):
    same(spark, [(1, "a", "only", 0, "")], SCHEMA)
    assert manifest.manifest(none, ("doc_id", "text")).count() == 0


def test_ranks_are_exact_where_prefixes_are_lengthened(spark):
    rows = spark.range(2000).select(F.lit("g").alias("g"), (F.col("id") * F.col("id") * 977).alias("id"), (1 + F.col("id") % 3).alias("copies"))
    found = manifest.ranked(rows, manifest.digits_of(F.col("id"), "bigint"), most=5).orderBy("id").collect()
    before = 0
    for r in found:
        assert r["rank"] == before
        before += r.copies
