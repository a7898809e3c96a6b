"""A knowledge base that is stored once and changed by segments.

Each change is a segment: the pieces of its documents, the chunks that they
bring or bring back, with their postings, and the ids of documents and chunks
that are gone. What earlier segments hold stays as it was written; readers leave
out what a later one says is gone. Document frequencies are sums over segments,
which hold what a change took away as negative counts, so that no posting is
read to count again. A version is a list of segments, written last.

Of equal chunks of a tenant and kind one counts, the first by document and
place. A change that takes that one away brings back the next, so that a stored
base is at any time what a rebuild from its documents would be.
"""

from __future__ import annotations

import time
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import Index, hashed_vectors, pieces_of, postings, with_ids

_KEY = ("tenant_id", "kb_type", "content_hash")
_PARTITIONS = ("seq", "kb_type", "tenant_id")
#: Columns of the tables; an empty one has no file to tell them.
_SCHEMAS = {
    "pieces": "doc_id string, doc_no long, chunk_ix int, text string, content_hash string, seq long, kb_type string, tenant_id string",
    "chunks": "chunk_id string, doc_id string, chunk_ix int, text string, char_len int, content_hash string, seq long, kb_type string, tenant_id string",
    "postings": "chunk_id string, token string, weight double, seq long, kb_type string, tenant_id string",
    "gone_documents": "doc_id string, seq long",
    "gone_chunks": "chunk_id string, kb_type string, seq long",
    "frequencies": "kb_type string, token string, df long, seq long",
    "sizes": "kb_type string, n long, seq long",
}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")


class StoredIndex(Index):
    """The latest version of a base under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        last = spark.read.parquet(f"{path}/versions").orderBy(F.desc("version")).first()
        self.version, self.segments, self.strategy = last.version, list(last.segments), last.strategy

    @classmethod
    def created(cls, docs: DataFrame, path: str, strategy: str = "fixed") -> "StoredIndex":
        """A new base of documents (doc_id, doc_no, tenant_id, kb_type, title, content)."""
        spark = docs.sparkSession
        pieces = pieces_of(docs, strategy).withColumn("doc_no", F.col("doc_no").cast("long"))
        pieces.withColumn("seq", F.lit(0).cast("long")).write.partitionBy(*_PARTITIONS).parquet(f"{path}/pieces")
        written = _read(spark, path, "pieces")
        first = written.groupBy(*_KEY).agg(F.min(F.struct("doc_no", "chunk_ix", "doc_id", "text")).alias("c")).select(*_KEY, "c.*")
        _segment(spark, path, 0, with_ids(first), None, None, None)
        _published(spark, path, 0, [0], strategy)
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        return _read(self.spark, self.path, name).where(F.col("seq").isin(self.segments))

    def _live(self, name: str, gone: str, key: str) -> DataFrame:
        """Rows that no later segment says are gone."""
        last = self._table(gone).groupBy(F.col(key).alias("of")).agg(F.max("seq").alias("until"))
        met = self._table(name).join(last, F.col(key) == F.col("of"), "left")
        return met.where(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("of", "until", "seq")

    @cached_property
    def pieces(self) -> DataFrame:
        """All pieces, equal ones too."""
        return self._live("pieces", "gone_documents", "doc_id")

    @cached_property
    def chunks(self) -> DataFrame:
        return self._live("chunks", "gone_chunks", "chunk_id").select("chunk_id", "doc_id", "tenant_id", "kb_type", "chunk_ix", "text", "char_len", "content_hash")

    @cached_property
    def postings(self) -> DataFrame:
        return self._live("postings", "gone_chunks", "chunk_id").select("chunk_id", "tenant_id", "kb_type", "token", "weight")

    @cached_property
    def idf(self) -> DataFrame:
        sizes = self._table("sizes").groupBy("kb_type").agg(F.sum("n").alias("n"))
        counts = self._table("frequencies").groupBy("kb_type", "token").agg(F.sum("df").alias("df")).where("df > 0").join(sizes, "kb_type")
        return counts.select("kb_type", "token", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))

    #: Postings of segments are not in bands, and are there already.
    banded, scanned = None, False

    @cached_property
    def vectors(self) -> DataFrame:
        return hashed_vectors(self.chunks, "chunk_id", "tenant_id", "kb_type")

    def of_document(self, doc_id: str, tenant: str) -> DataFrame:
        """A document's chunks in order, of the tenant that has to be named."""
        return self.chunks.where((F.col("doc_id") == doc_id) & (F.col("tenant_id") == tenant)).orderBy("chunk_ix")

    def changed(self, new: DataFrame | None = None, deleted: DataFrame | None = None) -> "StoredIndex":
        """The base with documents ``new`` in place of those of their ids, and without those of ``deleted`` (doc_id, tenant_id).

        A document of another tenant under an id that is there is an error, and
        so is an empty title or content; nothing is published then. Only folders
        of kinds and tenants that the change touches get files.
        """
        # What a change that failed has left is of no version, and its number isn't used again.
        seq, here = max(max(self.segments) + 1, time.time_ns() // 1000), self.path
        owners = self.pieces.select("doc_id", F.col("tenant_id").alias("owner")).distinct()
        asked = [df.select("doc_id", "tenant_id", F.lit(k).alias("kind")) for df, k in ((new, "new"), (deleted, "deleted")) if df is not None]
        every = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
        if not every.join(owners, "doc_id").where("owner <> tenant_id").isEmpty():
            raise PermissionError("a document of another tenant")
        if new is not None and not new.where("trim(coalesce(title, '')) = '' or trim(coalesce(content, '')) = ''").isEmpty():
            raise ValueError("a document without a title or content")
        every.select("doc_id").distinct().withColumn("seq", F.lit(seq).cast("long")).write.mode("append").partitionBy("seq").parquet(f"{here}/gone_documents")
        leaving = _read(self.spark, here, "gone_documents").where(F.col("seq") == seq).select("doc_id")
        columns = [c for c in self.pieces.columns]
        if new is not None:
            added = pieces_of(new, self.strategy).withColumn("doc_no", F.col("doc_no").cast("long"))
            added.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").partitionBy(*_PARTITIONS).parquet(f"{here}/pieces")
        added = _read(self.spark, here, "pieces").where(F.col("seq") == seq).select(*columns)
        removed = self.pieces.join(leaving, "doc_id", "left_semi")
        keys = removed.select(*_KEY).unionByName(added.select(*_KEY)).distinct()
        # Who is first among equal chunks is asked anew only where a piece came or went.
        stay = self.pieces.join(keys, list(_KEY), "left_semi").join(leaving, "doc_id", "left_anti").select(*columns)
        first = stay.unionByName(added).groupBy(*_KEY).agg(F.min(F.struct("doc_no", "chunk_ix", "doc_id", "text")).alias("c")).select(*_KEY, "c.*")
        now, before = with_ids(first), self.chunks.join(keys, list(_KEY), "left_semi")
        same = ["chunk_id", "content_hash", "tenant_id", "kb_type"]
        _segment(self.spark, here, seq, now.join(before.select(*same), same, "left_anti"), before.join(now.select(*same), same, "left_anti"), self.postings, "append")
        _published(self.spark, here, self.version + 1, [*self.segments, seq], self.strategy)
        return StoredIndex(self.spark, here)

    def compacted(self, path: str) -> "StoredIndex":
        """The same base as one segment under another path."""
        self.pieces.withColumn("seq", F.lit(0).cast("long")).write.partitionBy(*_PARTITIONS).parquet(f"{path}/pieces")
        _segment(self.spark, path, 0, self.chunks, None, None, None)
        _published(self.spark, path, 0, [0], self.strategy)
        return StoredIndex(self.spark, path)


def _segment(spark: SparkSession, path: str, seq: int, chunks: DataFrame, gone: DataFrame | None, old_postings: DataFrame | None, mode: str | None) -> None:
    """Writes a segment's chunks, what is gone, postings and signed frequencies."""
    write = lambda df, name, *by: df.withColumn("seq", F.lit(seq).cast("long")).write.mode(mode or "errorifexists").partitionBy("seq", *by).parquet(f"{path}/{name}")
    own = lambda name: _read(spark, path, name).where(F.col("seq") == seq).drop("seq")
    write(chunks, "chunks", "kb_type", "tenant_id")
    write(spark.createDataFrame([], "chunk_id string, kb_type string") if gone is None else gone.select("chunk_id", "kb_type"), "gone_chunks")
    if mode is None:
        spark.createDataFrame([], "doc_id string, seq long").write.partitionBy("seq").mode("ignore").parquet(f"{path}/gone_documents")
    here = own("chunks").select("chunk_id", "tenant_id", "kb_type", "text")
    write(postings(here, "chunk_id", "tenant_id", "kb_type"), "postings", "kb_type", "tenant_id")
    plus = own("postings").groupBy("kb_type", "token").agg(F.count("*").alias("df"))
    sizes = here.groupBy("kb_type").agg(F.count("*").alias("n"))
    if gone is not None:
        lost = own("gone_chunks")
        minus = old_postings.join(lost.select("chunk_id"), "chunk_id", "left_semi").groupBy("kb_type", "token").agg((-F.count("*")).alias("df"))
        plus, sizes = plus.unionByName(minus), sizes.unionByName(lost.groupBy("kb_type").agg((-F.count("*")).alias("n")))
    write(plus, "frequencies")
    write(sizes, "sizes")


def _published(spark: SparkSession, path: str, version: int, segments: list[int], strategy: str) -> None:
    """Makes a version the latest: the last thing written of it."""
    spark.createDataFrame([(version, segments, strategy)], "version int, segments array<long>, strategy string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
