"""Token counts from one histogram of encoded lengths, and the encoder that other operators share.

``histogram`` counts documents by encoded length. Sums from its long end answer
totals, quantiles and truncated totals exactly for every context limit, without
going back to the documents.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.store import staged

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Letters, digits and signs on which all versions of Unicode and of the two libraries' patterns agree.
_PLAIN = re.compile("[^\\t\\n\\r -~¡-ɏΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")


class Encoder:
    """Token ids of a byte-level BPE vocabulary.

    ``ranks`` may name the same vocabulary as ranks. It then encodes texts of
    well-known characters about four times as fast, with the same ids; all
    others, and all without ``ranks``, go through ``vocabulary``'s own library,
    called without special tokens added. So do texts that hold the string of a
    token that the vocabulary adds to its pieces, such as an end of text; with
    ``plain`` such a string is text like any other.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, plain: bool = False):
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(vocabulary)
        self._slow.encode_special_tokens = plain
        added = () if plain else (re.escape(t.content) for t in self._slow.get_added_tokens_decoder().values())
        self._odd = re.compile("|".join((_PLAIN.pattern, *added)))
        self._fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self._fast is None or self._odd.search(text):
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.array(self.ids(text), "<u4") if text else np.empty(0, "<u4")


def place(name: str | None) -> str | None:
    """A path as it is; a name is looked up among the public tokenizers."""
    return name if name is None or "/" in name else public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, ranks: str | None = RANKS, plain: bool = False) -> Encoder:
    """One encoder a worker process, of names among the public tokenizers or paths."""
    return Encoder(place(vocabulary), place(ranks), plain)


def lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """A row per document, n_tokens alone: other columns are left out, whatever their names.

    A null or empty text has none. Repeated rows are rows of their own; a very
    long text is encoded whole, in one task; an empty table gives no rows.
    """

    def run(batches):
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x.as_py())) for x in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """n_tokens and n_docs, a row per length that occurs.

    Nulls and empty texts count at length zero, repeated rows each time; a very
    long text is encoded whole, in one task; empty input gives no rows; other
    columns are left out, whatever their names.
    """
    return lengths(docs, text_col, vocabulary, ranks).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, blocks: int = 1024) -> DataFrame:
    """The histogram with sums from the long end, for a context limit of n_tokens:

    docs_longer and tokens_longer (documents above the limit), docs_upto,
    truncated_total (tokens if each document is cut at the limit), total,
    and quantile (share of documents up to the limit). Lengths are summed by
    blocks of lengths first, so that no task sees more than one block or one row
    a block.
    """
    rows = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / blocks).alias("block"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.desc("block"))
    over = sums.select(F.col("block").alias("k"), F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"), F.sum("d").over(everything).alias("all_d"), F.sum("t").over(everything).alias("all_t"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    met = rows.join(over, F.col("block") == F.col("k"))
    longer = F.col("d") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    tokens = F.col("t") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0))
    out = met.select("n_tokens", "n_docs", "all_d", "all_t", longer.alias("docs_longer"), tokens.alias("tokens_longer"))
    return out.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", (F.col("all_d") - F.col("docs_longer")).alias("docs_upto"),
        (F.col("all_t") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"), F.col("all_t").alias("total"), ((F.col("all_d") - F.col("docs_longer")) / F.col("all_d")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens if each document is cut at ``limit``."""
    return hist.agg(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit)))).first()[0] or 0


def quantile(hist: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents don't exceed; None without documents."""
    return suffix_sums(hist).where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents with its sums for each context limit."""
    return suffix_sums(staged(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "histogram"))
