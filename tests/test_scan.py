import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions.text import fixed_chunks, plain_tokens, tokens
from quern.operators import retrieval, scan

TEXTS = ["", "退货政策：7 天无理由退货", "A退b货 C", "naïve İstanbul ＡＢ K9 x_y", "𝄞退𝄞货", "the the The 12ab", "中 文 only 中"]


def corpus(spark):
    """Chunks of few words, so that many score the same, of three kinds and two tenants; one has no tenant."""
    rng = random.Random(4)
    words = ["the"] * 6 + [f"w{k}" for k in range(40)] + ["退", "货", "政策"]
    rows = [(f"C{k:05d}", f"D{k}", f"T{k % 2}" if k else None, ("policy", "sop", "product")[k % 3], k % 4, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(2500)]
    return retrieval.Index(spark.createDataFrame(rows, "chunk_id string, doc_id string, tenant_id string, kb_type string, chunk_ix int, text string").repartition(5))


def asked(spark):
    """More questions than a block holds, one asked twice, some of one kind only."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "政策", "unknown"] + [f"W{k}" for k in range(45)], k=rng.randint(1, 12))) for _ in range(150)] + ["the", "the", "w1 w1 w2", " ", "nothing"]
    return spark.createDataFrame([(k, t, f"T{k % 2}", "sop" if k % 5 == 0 else None) for k, t in enumerate(texts)] + [(900, "the", None, None)], "query_id long, query string, tenant_id string, kb_type string")


def rows(found):
    return sorted((r.query_id, r.kb_type, r.chunk_id, round(r.score, 8), r["rank"]) for r in found.collect())


def test_tokens_of_one_text(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", tokens(F.col("t")).alias("n")).collect()
    assert [[x.decode() for x in plain_tokens(r.t)] for r in got] == [r.n for r in got] and plain_tokens(None) == []


def test_a_pass_finds_what_postings_and_vectors_do(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 70)
    index, queries = corpus(spark), asked(spark)
    for top_k in (2, 5):
        got = retrieval.channels(queries, index, top_k)
        want = retrieval.channels(queries, index, top_k, scanned=False)
        for mode in ("dense", "sparse"):
            assert rows(got[mode]) == rows(want[mode]) and len(rows(want[mode])) > 1000


def test_few_questions_write_no_postings_and_no_vectors(spark):
    index = corpus(spark)
    assert retrieval.search(asked(spark), index).count() > 100
    assert not {"postings", "banded", "vectors", "idf", "greatest"} & index.__dict__.keys()


def test_more_questions_than_are_sent(spark, monkeypatch):
    index, queries = corpus(spark), asked(spark)
    few = sorted(map(str, retrieval.search(queries, index).collect()))
    monkeypatch.setattr(scan, "QUESTIONS", 20)
    assert scan.questions_of(queries) is None
    assert sorted(map(str, retrieval.search(queries, index).collect())) == few and "vectors" in index.__dict__


def test_no_questions(spark):
    queries = asked(spark).where("query_id = 900")
    assert retrieval.search(queries, corpus(spark)).count() == 0
    found = retrieval.channels(queries, corpus(spark))
    assert [found[m].count() for m in ("dense", "sparse")] == [0, 0]


def test_tokens_beyond_those_remembered(spark, monkeypatch):
    coded = scan.Coded({b"x": 3}, 1024)
    monkeypatch.setattr(scan, "REMEMBERED", 2)
    small = scan.Coded({b"x": 3}, 1024)
    for t in (b"a", b"b", b"c", b"x", b"d", b"a"):
        n, m = small[t], coded[t]
        assert small.place[n] == coded.place[m] and small.word[n] == (3 if t == b"x" else -1)


@pytest.mark.parametrize("size, overlap", [(200, 40), (7, 3), (5, 0)])
def test_windows_of_characters(spark, size, overlap):
    texts = ["", "  ", "a b", "  x" * 300 + " \n", "𝄞退 " * 150, "y" * 201, "z" * size, "q" * (2 * size - overlap)]

    def plain(t):
        t, step = t.strip(" "), size - overlap
        last = max(-(-(len(t) - size) // step), 0)
        return [p for p in (t[k * step : k * step + size].strip(" ") for k in range(last + 1)) if p]

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fixed_chunks(F.col("t"), size, overlap).alias("c")).collect()
    assert [r.c for r in got] == [plain(r.t) for r in got]
    assert re.search("[^ ]", got[3].c[0])


def test_passages_in_documents(spark, monkeypatch):
    """A few passages are looked for outright, with what windows of words find."""
    from quern.plans import knowledge

    got = {}
    for sent in (1000, 0):
        monkeypatch.setattr(knowledge, "SENT", sent)
        found = knowledge._truth(spark, "/root/testdata/sf0.001")
        got[sent] = sorted(map(tuple, found.collect()))
        assert ("Generate" in found._jdf.queryExecution().executedPlan().toString()) == (not sent)
    assert got[1000] == got[0]


@pytest.mark.parametrize("name", ["entity_hop", "rag_recent_answers", "kb_evaluation", "rag_answers", "kb_recall_sparse", "rag_ablation", "entity_seeds", "kb_hybrid_search", "rag_trace"])
def test_queries_write_no_postings_and_no_vectors(spark, name):
    from quern.plans import knowledge

    data = "/root/testdata/./sf0.001"  # a path that no other test reads by
    knowledge.QUERIES[name](spark, data).collect()
    assert not {"postings", "banded", "vectors", "idf", "greatest"} & knowledge.index(spark, data).__dict__.keys()
