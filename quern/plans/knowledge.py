"""Queries of the knowledge base and of questions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators import answerlog, questions, retrieval
from quern.operators.segments import StoredIndex
from quern.operators.vectors import VectorIndex
from quern.plans.registry import ORACLES, QUERIES
from quern.sources.commerce import SQL, Commerce, table
from quern.sources.shared import kept, new_path, once


def _query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def index(spark: SparkSession, sf_dir: str, strategy: str = "fixed") -> retrieval.Index:
    """The knowledge base of a data folder as this application ingested it: chunks, postings and vectors, each written once and read by all queries."""
    return once(spark, ("index", sf_dir, strategy), lambda: retrieval.Index(retrieval.chunked(Commerce(spark, sf_dir).kb_document(), strategy)))


def chunks(spark: SparkSession, sf_dir: str, strategy: str = "fixed") -> DataFrame:
    return index(spark, sf_dir, strategy).chunks


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries of tenants."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("T"), F.col("item_id") % 5).alias("tenant_id"))


_CHUNKS = (
    "WITH "
    + SQL.strip()
    + """,
cut AS (SELECT doc_id, doc_no, tenant_id, kb_type, trim(coalesce(content, ''), ' ') AS t FROM kb_document),
windows AS (SELECT doc_id, doc_no, tenant_id, kb_type, t, unnest(range(0, greatest(CAST(ceil((length(t) - 200) / 160) AS BIGINT), 0) + 1)) AS k FROM cut),
pieces AS (SELECT doc_id, doc_no, tenant_id, kb_type, row_number() OVER (PARTITION BY doc_no ORDER BY k) - 1 AS chunk_ix, text FROM (SELECT *, trim(substring(t, k * 160 + 1, 200), ' ') AS text FROM windows) x WHERE text <> ''),
kb_chunk AS (
  SELECT printf('%s#%03d', doc_id, chunk_ix) AS chunk_id, doc_id, tenant_id, kb_type, chunk_ix::INTEGER AS chunk_ix, text, length(text)::INTEGER AS char_len, left(sha1(text), 16) AS content_hash
  FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, kb_type, text ORDER BY doc_no, chunk_ix) AS rn FROM pieces) y WHERE rn = 1
),
post AS (SELECT chunk_id, tenant_id, kb_type, token, round(1 + ln(count(*)), 6) AS w FROM (SELECT chunk_id, tenant_id, kb_type, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x))) AS token FROM kb_chunk) p GROUP BY ALL),
q AS (SELECT item_id AS query_id, 'T' || (item_id % 5) AS tenant_id, text AS query FROM benchmark),
qpost AS (SELECT query_id, tenant_id, token, round(1 + ln(count(*)), 6) AS qw FROM (SELECT query_id, tenant_id, unnest(list_transform(regexp_extract_all(query, '[a-zA-Z0-9]+'), lambda x: lower(x))) AS token FROM q) p GROUP BY ALL),
idf AS (SELECT kb_type, token, ln(1 + n / (1 + count(*))) AS idf FROM post JOIN (SELECT kb_type, count(*) AS n FROM kb_chunk GROUP BY 1) c USING (kb_type) GROUP BY kb_type, token, n),
sparse AS (SELECT query_id, kb_type, chunk_id, round(sum(qw * idf * w), 9) AS score FROM qpost JOIN post USING (token, tenant_id) JOIN idf USING (kb_type, token) GROUP BY ALL),
per_kind AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_type ORDER BY score DESC, chunk_id) AS k FROM sparse),
sparse_rank AS (SELECT query_id, kb_type, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM per_kind WHERE k <= 30),
cplace AS (SELECT chunk_id, tenant_id, kb_type, ('0x' || left(md5(token), 8))::BIGINT % 1024 AS dim, 1 + ln(count(*)) AS x FROM (SELECT chunk_id, tenant_id, kb_type, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x))) AS token FROM kb_chunk) p GROUP BY ALL),
cvec AS (SELECT p.*, x / norm AS v FROM cplace p JOIN (SELECT chunk_id, sqrt(sum(x * x)) AS norm FROM cplace GROUP BY 1) n USING (chunk_id)),
qplace AS (SELECT query_id, tenant_id, ('0x' || left(md5(token), 8))::BIGINT % 1024 AS dim, 1 + ln(count(*)) AS x FROM (SELECT query_id, tenant_id, unnest(list_transform(regexp_extract_all(query, '[a-zA-Z0-9]+'), lambda x: lower(x))) AS token FROM q) p GROUP BY ALL),
qvec AS (SELECT p.*, x / norm AS v FROM qplace p JOIN (SELECT query_id, sqrt(sum(x * x)) AS norm FROM qplace GROUP BY 1) n USING (query_id)),
dense AS (SELECT query_id, kb_type, chunk_id, round(sum(a.v * b.v), 9) AS score FROM qvec a JOIN cvec b USING (dim, tenant_id) GROUP BY ALL),
dense_kind AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_type ORDER BY score DESC, chunk_id) AS k FROM dense),
dense_rank AS (SELECT query_id, kb_type, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_kind WHERE k <= 30),
hybrid_rank AS (
  SELECT query_id, chunk_id, round(sum(1 / (60.0::DOUBLE + rank)), 12) AS score, max(d) AS dense FROM (SELECT query_id, chunk_id, rank, TRUE AS d FROM dense_rank UNION ALL SELECT query_id, chunk_id, rank, FALSE FROM sparse_rank) r GROUP BY ALL
),
qtok AS (SELECT query_id, list_distinct(list_transform(regexp_extract_all(query, '[a-zA-Z0-9]+'), lambda x: lower(x))) AS toks FROM q),
truth AS (SELECT DISTINCT query_id, doc_id FROM q JOIN kb_document d ON d.tenant_id = q.tenant_id AND contains(content, query))
"""
)


def _ranked_sql(mode: str, rerank: bool, name: str) -> str:
    """A common table of the five best of a mode, with the columns of a search."""
    source = f"'{mode}'" if mode != "hybrid" else "CASE WHEN dense THEN 'dense' ELSE 'sparse' END"
    lexical = "coalesce(round(list_sum(list_transform(list_intersect(toks, list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x))), lambda x: 1.6::DOUBLE)) / list_sum(list_transform(toks, lambda x: 1.6::DOUBLE)), 4), 0)" if rerank else "0.0::DOUBLE"
    share = "CASE WHEN most > 0 THEN fused / most ELSE 0 END"
    final = f"0.55::DOUBLE * ({share}) + 0.45::DOUBLE * lexical" if rerank else share
    return f"""{name}_pool AS (SELECT *, max(fused) OVER (PARTITION BY query_id) AS most FROM (SELECT query_id, chunk_id, score AS fused, {source} AS source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM {mode}_rank) p WHERE k <= 30),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, k) AS rank FROM (SELECT *, round({final}, 9) AS final FROM (SELECT p.*, c.doc_id, c.kb_type, c.chunk_ix, c.text, {lexical} AS lexical FROM {name}_pool p JOIN kb_chunk c USING (chunk_id) JOIN qtok USING (query_id)) a) b) c WHERE rank <= 5)"""


_HITS = _CHUNKS.rstrip() + ",\n" + _ranked_sql("hybrid", True, "hits") + "\n"


def _recall_sql(found: str) -> str:
    return f"SELECT count(*) AS queries, round(avg((rank IS NOT NULL)::INT), 4) AS recall_at_k, round(avg(coalesce(1 / rank, 0)), 4) AS mrr FROM (SELECT DISTINCT query_id FROM truth) t LEFT JOIN (SELECT query_id, min(rank) AS rank FROM {found} JOIN truth USING (query_id, doc_id) GROUP BY 1) b USING (query_id)"


def _cut_sql(most: str, prefix: str) -> str:
    """Chunks of whole sentences, by one step for each part of a document."""
    return (
        "WITH RECURSIVE "
        + SQL.strip()
        + f""",
sized AS (SELECT doc_id, doc_no, tenant_id, kb_type, coalesce(content, '') AS t, {prefix} AS prefix FROM kb_document),
sentence AS (
  SELECT doc_no, {most} AS most, i, trim(CASE WHEN i > 1 THEN regexp_replace(s, '^\\s+', '') ELSE s END, ' ') AS s
  FROM (SELECT doc_no, prefix, unnest(regexp_extract_all(t, '[^。！？；!?;]*[。！？；!?;]|[^。！？；!?;]+')) AS s, generate_subscripts(regexp_extract_all(t, '[^。！？；!?;]*[。！？；!?;]|[^。！？；!?;]+'), 1) AS i FROM sized) x
),
part AS (
  SELECT doc_no, most, row_number() OVER (PARTITION BY doc_no ORDER BY i, k) AS p, substring(s, k * most + 1, most) AS s, length(s) > (k + 1) * most AS hard
  FROM (SELECT *, unnest(range(0, CAST(floor((length(s) - 1) / most) AS BIGINT) + 1)) AS k FROM sentence WHERE s <> '') y
),
fold(doc_no, p, buf, made) AS (
  SELECT doc_no, 0::BIGINT, '', []::VARCHAR[] FROM sized
  UNION ALL SELECT f.doc_no, f.p + 1, CASE WHEN hard THEN '' WHEN length(buf) + length(s) <= most THEN buf || s ELSE s END,
    CASE WHEN hard AND buf <> '' THEN [buf, s] WHEN hard THEN [s] WHEN length(buf) + length(s) <= most OR buf = '' THEN []::VARCHAR[] ELSE [buf] END
  FROM fold f JOIN part ON part.doc_no = f.doc_no AND part.p = f.p + 1
),
made AS (
  SELECT doc_no, p, unnest(made) AS c, generate_subscripts(made, 1) AS k FROM fold
  UNION ALL SELECT doc_no, p + 1, buf, 1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY p DESC) AS back FROM fold) z WHERE back = 1
),
pieces AS (
  SELECT doc_id, doc_no, tenant_id, kb_type, row_number() OVER (PARTITION BY doc_no ORDER BY p, k) - 1 AS chunk_ix, prefix || trim(c, ' ') AS text FROM made JOIN sized USING (doc_no) WHERE trim(c, ' ') <> ''
)
SELECT printf('%s#%03d', doc_id, chunk_ix) AS chunk_id, doc_id, tenant_id, kb_type, chunk_ix::INTEGER AS chunk_ix, text, length(text)::INTEGER AS char_len, left(sha1(text), 16) AS content_hash
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, kb_type, text ORDER BY doc_no, chunk_ix) AS rn FROM pieces) y WHERE rn = 1"""
    )


_SEMANTIC_SQL = _cut_sql("220", "''")
_HIERARCHICAL_SQL = _cut_sql("greatest(60, 220 - length(prefix))", "CASE WHEN coalesce(title, '') = '' THEN '' ELSE '【' || title || '】' END")


@_query("kb_chunks", _CHUNKS + "SELECT * FROM kb_chunk")
def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


@_query("kb_chunks_semantic", _SEMANTIC_SQL)
def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "semantic")


@_query("kb_chunks_hierarchical", _HIERARCHICAL_SQL)
def _hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "hierarchical")


@_query("kb_stats", _CHUNKS + "SELECT kb_type, count(*) AS n, round(avg(char_len), 4) AS mean_chars, count(DISTINCT doc_id) AS documents FROM kb_chunk GROUP BY kb_type")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("kb_type").agg(F.count("*").alias("n"), F.round(F.avg("char_len"), 4).alias("mean_chars"), F.count_distinct("doc_id").alias("documents"))


@_query("kb_ingest_stats", _CHUNKS + "SELECT kb_type, pieces, coalesce(chunks, 0)::BIGINT AS chunks, (pieces - coalesce(chunks, 0))::BIGINT AS repeats FROM (SELECT kb_type, count(*) AS pieces FROM pieces GROUP BY 1) p LEFT JOIN (SELECT kb_type, count(*) AS chunks FROM kb_chunk GROUP BY 1) c USING (kb_type)")
def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, the chunks that they became, and the repeats that were left out, by kind."""
    pieces = retrieval.pieces_of(Commerce(spark, sf_dir).kb_document(), "fixed").groupBy("kb_type").agg(F.count("*").alias("pieces"))
    kept_ones = chunks(spark, sf_dir).groupBy("kb_type").agg(F.count("*").alias("chunks"))
    n = F.coalesce("chunks", F.lit(0))
    return pieces.join(kept_ones, "kb_type", "left").select("kb_type", "pieces", n.alias("chunks"), (F.col("pieces") - n).alias("repeats"))


@_query("kb_document_chunks", _CHUNKS + "SELECT chunk_ix, chunk_id, text, char_len FROM kb_chunk WHERE doc_id = 'D9' AND tenant_id = 'T4'")
def _document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document's chunks in order, for its tenant."""
    own = chunks(spark, sf_dir).where("doc_id = 'D9' and tenant_id = 'T4'")
    return own.orderBy("chunk_ix").select("chunk_ix", "chunk_id", "text", "char_len")


@_query("kb_documents", _CHUNKS + "SELECT d.doc_id, d.tenant_id, d.kb_type, title, coalesce(n, 0)::BIGINT AS chunks FROM kb_document d LEFT JOIN (SELECT doc_id, count(*) AS n FROM kb_chunk GROUP BY 1) c USING (doc_id)")
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return Commerce(spark, sf_dir).kb_document().join(counts, "doc_id", "left").select("doc_id", "tenant_id", "kb_type", "title", F.coalesce("n", F.lit(0)).alias("chunks"))


@_query("kb_sparse_search", _CHUNKS + "SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM sparse_rank WHERE rank <= 5")
def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.channels(asked(spark, sf_dir), index(spark, sf_dir), modes=("sparse",))["sparse"]
    return found.where("rank <= 5").select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


_PASSAGES = "text AS query FROM benchmark)"
_KEYWORDS = "array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x))), lambda x: {'k': -length(x), 't': x})), 1, 5), lambda s: s.t), ' ') AS query FROM benchmark)"


@_query("kb_keyword_search", _CHUNKS.replace(_PASSAGES, _KEYWORDS, 1) + "SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM sparse_rank WHERE rank <= 5")
def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest words of each passage as a question: short ones, which the search answers by bounds."""
    words = F.array_sort(F.transform(F.array_distinct(tokens(F.col("query"))), lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t"))))
    wanted = asked(spark, sf_dir).withColumn("query", F.array_join(F.transform(F.slice(words, 1, 5), lambda w: w["t"]), " "))
    found = retrieval.channels(kept(wanted, "keywords"), index(spark, sf_dir), modes=("sparse",), scanned=False)["sparse"]
    return found.where("rank <= 5").select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


_SEARCHED = "query_id, rank, chunk_id, doc_id, kb_type, chunk_ix, text, round(final, 6) AS score, round(fused, 6) AS rrf_score, lexical AS lexical_score, source"


@_query("kb_hybrid_search", _HITS + f"SELECT {_SEARCHED} FROM hits")
def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(asked(spark, sf_dir), index(spark, sf_dir))


def changed_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The base stored, then changed: a seventh of the documents revised, an eleventh deleted."""

    def make():
        docs = Commerce(spark, sf_dir).kb_document()
        base = StoredIndex.created(docs, new_path(spark, "base"))
        revised = docs.where("doc_no % 7 = 0 and doc_no % 11 <> 0").withColumn("content", F.concat(F.lit("Revised edition. "), F.coalesce("content", F.lit(""))))
        revised = revised.withColumn("title", F.coalesce("title", F.lit("untitled")))
        return base.changed(revised, docs.where("doc_no % 11 = 0"))

    return once(spark, ("changed index", sf_dir), make)


_CHANGED = _CHUNKS.replace("kb_document AS (", "kb_before AS (", 1).replace("\ncut AS (", """
kb_document AS (SELECT doc_id, tenant_id, kb_type, title, CASE WHEN doc_no % 7 = 0 THEN 'Revised edition. ' || coalesce(content, '') ELSE content END AS content, doc_no FROM kb_before WHERE doc_no % 11 <> 0),
cut AS (""", 1)


@_query("kb_after_changes", _CHANGED + "SELECT * FROM kb_chunk")
def _after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a stored base after a change of some documents, as a rebuild would have them."""
    return changed_index(spark, sf_dir).chunks


@_query("kb_search_after_changes", _CHANGED + "SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM sparse_rank WHERE rank <= 5")
def _search_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse search of the changed base, with document frequencies summed over its segments."""
    found = retrieval.channels(asked(spark, sf_dir), changed_index(spark, sf_dir), modes=("sparse",))["sparse"]
    return found.where("rank <= 5").select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


#: Passages up to which every one is looked for in all documents of its tenant.
SENT = 1000


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the query's tenant that hold the whole passage."""
    docs = Commerce(spark, sf_dir).kb_document().select("doc_id", "tenant_id", "content")
    if asked(spark, sf_dir).count() <= SENT:
        # A few passages are looked for in every document of their tenant; there are no more rows than finds.
        some = asked(spark, sf_dir).where("query <> ''").select("query_id", F.col("tenant_id").alias("of"), "query")
        return docs.join(F.broadcast(some), F.expr("tenant_id = of and contains(content, query)")).select("query_id", "doc_id").distinct()
    # A passage is looked for only where its first five words are those of a window of the document.
    first = lambda x: F.array_join(F.slice(x, 1, 5), " ")
    words = lambda c: F.split(c, " ")
    wanted = asked(spark, sf_dir).select("query_id", "tenant_id", "query", words(F.col("query")).alias("w")).where("query <> ''")
    long, short = wanted.where(F.size("w") >= 7), wanted.where(F.size("w") < 7)
    # The first and the last word may be the end and the beginning of longer ones.
    keys = long.select("query_id", "tenant_id", "query", first(F.slice(F.col("w"), 2, 5)).alias("key"))
    w = words(F.col("content"))
    windows = docs.select("doc_id", "tenant_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda k: F.array_join(F.slice(w, k, 5), " ")))).alias("key"))
    # Windows meet keys without the texts, which are fetched for the documents that met.
    met = windows.join(keys, ["tenant_id", "key"]).select("query_id", "doc_id", "query").distinct().join(docs.select("doc_id", "content"), "doc_id")
    rest = docs.join(short, "tenant_id")
    both = met.select("query_id", "doc_id", "content", "query").unionByName(rest.select("query_id", "doc_id", "content", "query"))
    return both.where(F.expr("contains(content, query)")).select("query_id", "doc_id").distinct()


@_query("kb_recall_sparse", _CHUNKS.rstrip() + ", found AS (SELECT query_id, rank, doc_id FROM sparse_rank JOIN kb_chunk USING (chunk_id) WHERE rank <= 5) " + _recall_sql("found"))
def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = index(spark, sf_dir)
    found = retrieval.channels(asked(spark, sf_dir), known, modes=("sparse",))["sparse"].where("rank <= 5")
    return retrieval.recall(found.join(known.chunks.select("chunk_id", "doc_id"), "chunk_id"), _truth(spark, sf_dir))


@_query("kb_recall_hybrid", _HITS + _recall_sql("hits"))
def _recall_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall(_hybrid(spark, sf_dir), _truth(spark, sf_dir))


_GRID = [(m, r, f"{m}_{'reranked' if r else 'plain'}") for m in retrieval.MODES for r in (False, True)]
_GRID_SQL = _CHUNKS.rstrip() + "".join(",\n" + _ranked_sql(*g) for g in _GRID) + ", grid AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, {r} AS rerank, * FROM ({_recall_sql(n)}) x" for m, r, n in _GRID) + ") SELECT *, row_number() OVER (ORDER BY recall_at_k DESC, mrr DESC, mode, rerank) = 1 AS best FROM grid"


@_query("kb_evaluation", _GRID_SQL)
def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of each mode with and without reranking, and which configuration is best."""
    return retrieval.evaluated(asked(spark, sf_dir), index(spark, sf_dir), _truth(spark, sf_dir))


def _chunking_sql(strategy: str, cut: str | None) -> str:
    """The figures of one way of cutting: the tables of the search over its chunks."""
    tables = _CHUNKS
    if cut is not None:
        head, tail = cut.rsplit("\nSELECT printf", 1)
        tables = f"{head},\nkb_chunk AS (SELECT printf{tail}),\npost AS (" + _CHUNKS.split("\npost AS (", 1)[1]
    hits = tables.rstrip() + ",\n" + _ranked_sql("hybrid", True, "hits")
    return f"SELECT * FROM ({hits} SELECT '{strategy}' AS strategy, c.*, r.* FROM (SELECT count(*) AS chunks, round(avg(char_len), 4) AS mean_chars FROM kb_chunk) c, ({_recall_sql('hits')}) r) x"


_COMPARISON_SQL = "WITH found AS (" + " UNION ALL ".join(_chunking_sql(*x) for x in (("fixed", None), ("semantic", _SEMANTIC_SQL), ("hierarchical", _HIERARCHICAL_SQL))) + ") SELECT *, row_number() OVER (ORDER BY recall_at_k DESC, mrr DESC, strategy) = 1 AS best FROM found"


@_query("kb_chunking_comparison", _COMPARISON_SQL)
def _chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each way of cutting chunks."""
    return retrieval.compared_chunking(Commerce(spark, sf_dir).kb_document(), asked(spark, sf_dir), kept(_truth(spark, sf_dir), "truth"))


# Two passages of a tenant as one question, and their right documents: those of either.
_PAIRS_SQL = "q AS (SELECT a.item_id AS query_id, 'T' || (a.item_id % 5) AS tenant_id, a.text || ' ' || b.text AS query FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 5 WHERE a.item_id % 10 < 5)"
_PARTS_SQL = "q AS (SELECT item_id AS query_id, 'T' || (item_id % 5) AS tenant_id, text AS query FROM benchmark)"
_RIGHT_SQL = "SELECT DISTINCT item_id - CASE WHEN item_id % 10 >= 5 THEN 5 ELSE 0 END AS query_id, doc_id FROM benchmark b JOIN kb_document d ON d.tenant_id = 'T' || (item_id % 5) AND contains(content, text)"


def _ablation_sql(strategy: str, hits: str, query: str) -> str:
    whole = hits.split("WITH ", 1)[1]
    return f"""SELECT '{strategy}' AS strategy, count(*) AS queries, round(avg((n > 0)::INT), 4) AS recall_at_k, round(avg(n), 4) AS mean_hits FROM (
WITH {whole}, right_docs AS ({_RIGHT_SQL}), pairs AS (SELECT DISTINCT r.query_id FROM right_docs r JOIN benchmark b ON b.item_id = r.query_id + 5)
SELECT p.query_id, count(DISTINCT f.doc_id) AS n FROM pairs p LEFT JOIN (SELECT {query} AS query_id, doc_id FROM hits) h USING (query_id) LEFT JOIN right_docs f ON f.query_id = p.query_id AND f.doc_id = h.doc_id GROUP BY 1) x"""


@_query("rag_ablation", _ablation_sql("single", _HITS.replace(_PARTS_SQL, _PAIRS_SQL, 1), "query_id") + " UNION ALL " + _ablation_sql("split", _HITS, "query_id - CASE WHEN query_id % 10 >= 5 THEN 5 ELSE 0 END"))
def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two parts, searched whole and part by part: how many find a right document, and how many of those."""
    known, parts = index(spark, sf_dir), asked(spark, sf_dir)
    first = lambda c: F.col(c) - F.when(F.col(c) % 10 >= 5, 5).otherwise(0)
    later = parts.select((F.col("query_id") - 5).alias("query_id"), F.col("query").alias("second"))
    whole = parts.where("query_id % 10 < 5").join(later, "query_id").select("query_id", F.concat_ws(" ", "query", "second").alias("query"), "tenant_id")
    right = _truth(spark, sf_dir).select(first("query_id").alias("query_id"), "doc_id").distinct().join(whole.select("query_id"), "query_id", "left_semi")
    right = kept(right, "right")
    single = retrieval.search(kept(whole, "pairs"), known)
    split = _hybrid(spark, sf_dir).select(first("query_id").alias("query_id"), "doc_id")
    return retrieval.ablation({"single": single, "split": split}, right)


_ENTITIES = _HITS.rstrip() + """,
named AS (SELECT query_id, rank, unnest(list_concat(regexp_extract_all(text, '\\b((?:POLICY|SOP|FAQ)-\\d+)\\b', 1), regexp_extract_all(text, '\\b(NOVA|AURORA|LUMEN|VERDE)\\b', 1))) AS seed,
  generate_subscripts(list_concat(regexp_extract_all(text, '\\b((?:POLICY|SOP|FAQ)-\\d+)\\b', 1), regexp_extract_all(text, '\\b(NOVA|AURORA|LUMEN|VERDE)\\b', 1)), 1) AS place FROM hits),
firsts AS (SELECT query_id, seed, min([rank, place]) AS f FROM named GROUP BY ALL),
counted AS (SELECT *, count(*) OVER (PARTITION BY query_id ORDER BY f[1] RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM firsts)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY f[1], f[2]))::INTEGER AS place, seed FROM counted WHERE before < 3"""


@_query("entity_seeds", _ENTITIES)
def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hits of each passage name: the questions of a second hop."""
    return retrieval.entity_seeds(_hybrid(spark, sf_dir))


# A second search of the three best for each name, of twenty a kind: the same tables with the names as questions.
_NAMES_SQL = (
    (_CHUNKS.replace(_PARTS_SQL, "q AS (SELECT s.query_id || '|' || s.place AS query_id, 'T' || (s.query_id % 5) AS tenant_id, seed AS query FROM seeds s)", 1).replace("per_kind WHERE k <= 30", "per_kind WHERE k <= 20").replace("dense_kind WHERE k <= 30", "dense_kind WHERE k <= 20")).rstrip()
    + ",\n" + _ranked_sql("hybrid", True, "hits").replace("rank <= 5", "rank <= 3") + " SELECT query_id, rank, chunk_id, round(final, 6) AS score FROM hits"
)
_HOP_SQL = f"""WITH seeds AS MATERIALIZED ({_ENTITIES}), asked_hits AS MATERIALIZED ({_HITS} SELECT query_id, chunk_id FROM hits),
met AS (SELECT s.query_id, s.place, s.seed, f.rank, f.chunk_id, f.score FROM ({_NAMES_SQL}) f JOIN seeds s ON f.query_id = s.query_id || '|' || s.place),
new AS (SELECT * FROM met ANTI JOIN asked_hits USING (query_id, chunk_id))
SELECT query_id, seed, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY place, rank) AS k FROM new) n WHERE k = 1"""


@_query("entity_hop", _HOP_SQL)
def _hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second search for the names in the hits adds."""
    return retrieval.entity_hop(asked(spark, sf_dir), _hybrid(spark, sf_dir), index(spark, sf_dir))


@_query("kb_neighbours", _CHUNKS + """, hits AS (SELECT query_id, rank, chunk_id, doc_id, chunk_ix FROM sparse_rank JOIN kb_chunk USING (chunk_id) WHERE rank <= 5),
best AS (SELECT query_id, doc_id, min(rank) AS rank, arg_min(chunk_ix, rank) AS ix FROM hits GROUP BY ALL), four AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM best)
SELECT DISTINCT query_id, c.chunk_id FROM four JOIN kb_chunk c ON c.doc_id = four.doc_id AND abs(c.chunk_ix - ix) = 1 WHERE k <= 4 AND (query_id, c.chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM hits)""")
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = index(spark, sf_dir)
    found = retrieval.channels(asked(spark, sf_dir), known, modes=("sparse",))["sparse"].where("rank <= 5")
    return retrieval.neighbours(found.join(known.chunks.select("chunk_id", "doc_id", "chunk_ix"), "chunk_id"), known.chunks).distinct()


_VECTORS_SQL = """WITH v AS (SELECT vec_id, label % 5 AS tenant, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (q.n * v.n) AS score FROM v q JOIN v ON q.tenant = v.tenant AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) r WHERE rank <= 5"""


@_query("vector_search", _VECTORS_SQL)
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of its tenant for each vector whose id is a multiple of twenty."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 5).alias("tenant_id"), "embedding")
    wanted = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "tenant_id", F.col("embedding").alias("q"))
    return retrieval.nearest_vectors(wanted, rows).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@_query("vector_search_indexed", _VECTORS_SQL)
def _vectors_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cells of an index that is written once."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 5).alias("tenant_id"), "embedding")
    index = once(spark, ("vectors", sf_dir), lambda: VectorIndex(rows))
    wanted = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "tenant_id", F.col("embedding").alias("q"))
    return index.nearest(wanted).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@_query("conversation_last_turns", "SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) x WHERE b <= 3) y")
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "place")


def _cases(text: str, terms, fold: bool = False) -> str:
    """SQL for the values whose term a text holds, in order, as a list."""
    holds = lambda t: f"contains({text}, '{t}')" + (f" OR contains(lower({text}), '{t}')" if fold else "")
    return "list_filter([" + ", ".join(f"CASE WHEN {holds(t)} THEN '{v}' END" for t, v in terms) + "], lambda x: x IS NOT NULL)"


def _replaced(text: str, words, by: str) -> str:
    for w in words:
        text = f"replace({text}, '{w}', {by})"
    return text


_ASKED_SQL = "asked AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user')"
_BACK = " OR ".join([f"contains(trim(text, ' '), '{t}')" for t in questions.TEMPORAL_TERMS] + [f"starts_with(trim(text, ' '), '{d}')" for d in questions.DEICTIC])
_PLAN_SQL = f"""WITH {_ASKED_SQL},
told AS (SELECT *, trim(text, ' ') AS t, coalesce(previous, '') AS before, trim({_replaced("coalesce(previous, '')", questions.TEMPORAL_TERMS, "''")}, ' 的呢吗？?，,') AS core, ({_BACK}) AS back FROM asked WHERE text IS NOT NULL),
whole AS (SELECT conv_id, turn, CASE WHEN before = '' OR length(t) > 12 OR NOT back THEN text WHEN len({_cases("before", questions.METRIC_TERMS, True)}) > 0 AND core <> '' AND core <> t THEN t || ' ' || core
  WHEN len({_cases("before", questions.DOMAIN_TERMS)}) > 0 THEN t || ' ' || {_cases("before", questions.DOMAIN_TERMS)}[1] ELSE text END AS q FROM told),
cut AS (SELECT conv_id, turn, q, list_filter(list_transform(string_split({_replaced("q", questions.CONNECTORS, "chr(1)")}, chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 2) AS good FROM whole),
parts AS (SELECT conv_id, turn, unnest(CASE WHEN len(good) > 1 THEN good ELSE [q] END) AS text, generate_subscripts(CASE WHEN len(good) > 1 THEN good ELSE [q] END, 1) - 1 AS part FROM cut),
named AS (SELECT *, {_cases("text", questions.METRIC_TERMS, True)} AS m, {_cases("text", questions.DOMAIN_TERMS)} AS d FROM parts)
SELECT conv_id, turn, part::INTEGER AS part, text, CASE WHEN len(m) > 0 AND len(d) > 0 THEN 'hybrid' WHEN len(m) > 0 THEN 'metric' ELSE 'knowledge' END AS intent, d[1] AS kb_type, array_to_string(list_sort(list_distinct(m)), ',') AS codes FROM named"""


def _turns_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's turn with the one before it in its conversation."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), before.alias("previous"))


@_query("question_plan", _PLAN_SQL)
def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every user's turn, with what they ask for."""
    rows = _turns_asked(spark, sf_dir).select(F.struct("conv_id", "turn").alias("query_id"), "question", "previous").where("question is not null")
    return questions.planned(rows).select("query_id.conv_id", "query_id.turn", "part", "text", "intent", "kb_type", F.array_join(F.array_sort("metric_codes"), ",").alias("codes"))


_SYNONYM_CASES = ", ".join(f"CASE WHEN contains(text, '{t}') THEN '{s}' END" for t, s in questions.SYNONYMS)


@_query("question_rewrite", f"WITH {_ASKED_SQL}, words AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(array_to_string(list_filter([text, {_SYNONYM_CASES}], lambda x: x IS NOT NULL), ' '), '\\s+'), lambda x: x <> '') AS w FROM asked WHERE text IS NOT NULL) SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS text FROM words")
def _rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's turn in standard words."""
    rows = _turns_asked(spark, sf_dir).where("question is not null")
    return rows.select("conv_id", "turn", questions.rewritten(F.col("question"), F.lit(False), F.lit(None).cast("string")).alias("text"))


_WEIGHT = "list_sum(list_transform({}, lambda t: CASE WHEN length(t) >= 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END))"
_TOKENS = "list_transform(regexp_extract_all({}, '[a-zA-Z0-9]+'), lambda x: lower(x))"
_JUDGED_SQL = _HITS.rstrip() + f""",
per AS (SELECT query_id, count(*) AS n, avg(lexical) FILTER (WHERE rank <= 3) AS lex, list_distinct(flatten(list({_TOKENS.format("text")}) FILTER (WHERE rank <= 3))) AS seen FROM hits GROUP BY 1),
raw AS (SELECT q.query_id, n, (0.5::DOUBLE * lex + 0.5::DOUBLE * coalesce({_WEIGHT.format("list_intersect(toks, seen)")} / {_WEIGHT.format("toks")}, 0)) * CASE WHEN n < 2 THEN 0.7::DOUBLE ELSE 1 END AS raw FROM q LEFT JOIN per USING (query_id) LEFT JOIN qtok USING (query_id))
SELECT query_id, CASE WHEN n IS NULL THEN 0 ELSE round(least(raw, 1), 4) END AS score, CASE WHEN n IS NULL THEN 'no_hits' ELSE concat_ws(',', CASE WHEN n < 2 THEN 'few_results' END, CASE WHEN raw < 0.5 THEN 'low_coverage' END) END AS reasons FROM raw"""


@_query("retrieval_judged", _JUDGED_SQL)
def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = asked(spark, sf_dir).withColumn("kb_type", F.lit(None).cast("string"))
    return questions.judged(wanted, _hybrid(spark, sf_dir)).select("query_id", "score", F.array_join("reasons", ",").alias("reasons"))


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as questions: every second one searched in rounds, the others once, every third with a metric besides. Written once."""

    def make():
        wanted = asked(spark, sf_dir)
        hits = _hybrid(spark, sf_dir)
        judged = questions.judged(wanted.withColumn("kb_type", F.lit(None).cast("string")), hits).select("query_id", "score", F.array_join("reasons", ",").alias("reasons"))
        rows = wanted.join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").join(judged, "query_id")
        none = F.lit(None)
        step = lambda name, hits, score, reasons: F.struct(F.lit(name).alias("step"), hits.cast("long").alias("hits"), score.cast("double").alias("score"), reasons.cast("string").alias("reasons"))
        steps = F.array(step("retrieve", F.coalesce("n", F.lit(0)), none, none), step("judge", none, F.col("score"), F.col("reasons")))
        strategy = F.when(F.col("query_id") % 2 == 0, "agentic").otherwise("single")
        search = answerlog.call(F.lit("search_kb"), strategy, F.col("query"), steps)
        metric = answerlog.call(F.lit("query_metric"), none.cast("string"), F.lit("GMV_PAID"), F.array().cast(steps_type))
        calls = F.when(F.col("query_id") % 3 == 0, F.array(metric, search)).otherwise(F.array(search))
        rows = rows.select(F.col("query_id").alias("insight_id"), "tenant_id", F.concat(F.lit("thread-"), "query_id").alias("thread_id"), F.col("query").alias("question"), (F.col("score") < 0.5).alias("degraded"), strategy.alias("strategy"), F.lit("high").alias("confidence"), "query_id", "query", "n", "score", "reasons")
        return kept(answerlog.logged(rows, calls), "answers")

    steps_type = "array<struct<step:string,hits:bigint,score:double,reasons:string>>"
    return once(spark, ("answers", sf_dir), make)


_LOG_SQL = _JUDGED_SQL.rsplit("\nSELECT", 1)
_TRACE_SQL = f"""{_LOG_SQL[0]},
judged AS (SELECT{_LOG_SQL[1]}),
answers AS (SELECT query_id AS insight_id, tenant_id, query AS question, CASE WHEN query_id % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS call, query, coalesce(n, 0) AS n, score, reasons FROM q JOIN judged USING (query_id) LEFT JOIN per USING (query_id) WHERE query_id % 2 = 0 AND tenant_id = 'T2')
SELECT insight_id, tenant_id, question, call, query, 0::INTEGER AS place, 'retrieve' AS step, n AS hits, NULL::DOUBLE AS score, NULL AS reasons FROM answers
UNION ALL SELECT insight_id, tenant_id, question, call, query, 1::INTEGER, 'judge', NULL, score::DOUBLE, reasons FROM answers"""


@_query("rag_trace", _TRACE_SQL)
def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds of the answers that one brand may see, from the log."""
    return answerlog.replayed(answer_log(spark, sf_dir), "brand", "T2")


@_query("rag_recent_answers", _LOG_SQL[0] + f", judged AS (SELECT{_LOG_SQL[1]}) SELECT query_id AS insight_id, tenant_id, query AS question, score < 0.5 AS degraded, CASE WHEN query_id % 2 = 0 THEN 'agentic' ELSE 'single' END AS strategy FROM q JOIN judged USING (query_id) WHERE tenant_id = 'T1' ORDER BY 1 DESC LIMIT 5")
def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest five answers of the tenant that an operator names."""
    return answerlog.recent(answer_log(spark, sf_dir), 5, "ops", None, "T1").select("insight_id", "tenant_id", "question", "degraded", "strategy")


#: Chunks of 200 characters are never compressed; a hit is taken while more than 200 of 400 tokens are left.
_CONTEXT_SQL = _HITS.rstrip() + """,
costs AS (SELECT query_id, chunk_id, round(final, 6) AS score, CAST(floor(length(text) / 4) + 1 AS INTEGER) AS cost FROM hits),
runs AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING)::INTEGER AS used FROM costs)
SELECT query_id, chunk_id, score, cost, used, FALSE AS compressed FROM runs WHERE 400 - (used - cost) > 200"""


@_query("context_budget", _CONTEXT_SQL)
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hybrid(spark, sf_dir).join(asked(spark, sf_dir).select("query_id", "query"), "query_id")
    return questions.context(hits, budget=400).drop("text")


_GROUNDED_SQL = _HITS.rstrip() + f""",
cites AS (SELECT query_id, doc_id, chunk_ix FROM hits WHERE rank = 1 UNION ALL SELECT query_id, doc_id, -1 FROM hits WHERE rank = 1 AND query_id % 5 = 0),
held AS (SELECT c.query_id, h.text, coalesce({_WEIGHT.format("list_intersect(toks, " + _TOKENS.format("h.text") + ")")} / {_WEIGHT.format("toks")}, 0) AS support FROM cites c JOIN qtok USING (query_id) LEFT JOIN hits h ON h.query_id = c.query_id AND h.doc_id = c.doc_id AND h.chunk_ix = c.chunk_ix),
sums AS (SELECT query_id, count(*) AS citations, count(*) FILTER (WHERE text IS NULL) AS missing, avg(support) FILTER (WHERE text IS NOT NULL) AS s FROM held GROUP BY 1)
SELECT query_id, coalesce(citations, 0) AS citations, coalesce(missing, 0) AS missing, round(coalesce(s, 0), 4) AS mean_support,
  CASE WHEN citations IS NULL THEN 'high' WHEN missing > 0 THEN 'low' WHEN s >= 0.45 THEN 'high' WHEN s >= 0.25 THEN 'medium' ELSE 'low' END AS confidence FROM q LEFT JOIN sums USING (query_id)"""


@_query("answer_grounding", _GROUNDED_SQL)
def _grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages themselves as answers, each citing its first hit and every fifth one a chunk that isn't among its hits."""
    hits = _hybrid(spark, sf_dir)
    answers = asked(spark, sf_dir).select("query_id", F.col("query").alias("answer"))
    first = hits.where("rank = 1").select("query_id", "doc_id", "chunk_ix")
    wrong = first.where("query_id % 5 = 0").select("query_id", "doc_id", F.lit(-1).alias("chunk_ix"))
    return questions.grounded(answers, first.unionByName(wrong), hits)


@_query("events_hourly", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL")
def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the batch form of the streaming rollup of ``quern.streaming.rollup``."""
    from quern.streaming.rollup import hourly

    return hourly(table(spark, sf_dir, "events"))


@_query("event_sessions_gap", """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM e) SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL""")
def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of a user's events with gaps below 30 minutes."""
    last = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    starts = table(spark, sf_dir, "events").withColumn("new", F.coalesce(F.col("ts") > last + F.expr("INTERVAL 30 MINUTES"), F.lit(True)).cast("int"))
    number = F.sum("new").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return starts.withColumn("session", number).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@_query("rag_answers", None)
def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each benchmark passage is answered from its tenant's chunks."""
    from quern.operators.answers import answered

    wanted = asked(spark, sf_dir).select("query_id", F.col("query").alias("question"), F.lit(None).cast("string").alias("previous"), "tenant_id")
    return answered(wanted, index(spark, sf_dir))[1]
