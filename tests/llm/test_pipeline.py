import re

import corpus_pipeline
from pyspark.sql import functions as F

from quern.llm import packing
from quern.llm.store import staged
from tests.llm.test_minhash import jaccard, plain_shingles

DATA = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, at = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        at.append(staged(stage(spark, at[-1], DATA), name))
    assert [x.columns for x in at[1:-1]] == [columns] * 4
    start, kept, lined, once, mixed, packed = at
    # Quality: a subset, texts untouched, all of ten words or more.
    assert kept.exceptAll(start).isEmpty() and 0 < kept.count() < start.count()
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 10 for r in kept.select("text").collect())
    # Lines: the same documents.
    assert sorted(r.doc_id for r in lined.select("doc_id").collect()) == sorted(r.doc_id for r in kept.select("doc_id").collect())
    # Near duplicates, by brute force: of any two documents of similarity 0.8 one went, and each that went has an earlier such one.
    found = {r.doc_id: plain_shingles(r.text) for r in lined.select("doc_id", "text").collect()}
    similar = {(a, b) for a in found for b in found if a < b and jaccard(found[a], found[b]) >= 0.8}
    stay = {r.doc_id for r in once.select("doc_id").collect()}
    assert stay < set(found) and not any(a in stay and b in stay for a, b in similar)
    assert all(any((a, d) in similar for a in found) for d in set(found) - stay)
    # Mixing: one and a half times the words, of the same documents.
    words = lambda df: df.agg(F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))).first()[0]
    assert abs(words(mixed) - 1.5 * words(once)) <= 50
    assert mixed.select("doc_id").distinct().exceptAll(once.select("doc_id")).isEmpty()
    # Packing: every token of every row.
    total = lambda df: df.agg(F.sum("length")).first()[0]
    assert total(packed) == total(packing.pieces(mixed))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
