"""Best-fit packing of documents into token sequences, under several capacities.

A bin has capacities for tokens, documents and attention cost (the sum of
squared lengths). Pieces are placed longest first; of the bins that hold a
piece under every capacity, the one is taken whose residual after it is least,
by weighted norm, or whose residual the piece matches best, by weighted dot
product. Pieces are dealt by a hash to groups of about equal length mix, so
that each group is packed by itself and costs one part-filled bin at most.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import staged_at
from quern.llm.tokens import RANKS, VOCABULARY, encoder

END = 2
GROUP = 8192


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, the weights of what is left of each, and the score that chooses among bins.

    The defaults of documents and cost are those that the tokens alone imply;
    ``sequences`` says what lower ones take. The weights and the score are those
    of a measurement on a group of the synthetic documents: equal weights were
    within one sequence of the fewest at all capacities tried, and the norm
    needed up to 0.3 % fewer than the dot product.
    """

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    score: str = "norm"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole pieces of ``size``, and if n is no multiple a shorter first one."""
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def best_fit(sizes: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given.

    A piece that alone exceeds the cost capacity gets a bin of its own.
    """
    capacity = np.array([limits.tokens, limits.documents, limits.cost], np.float64)
    weights = np.array(limits.weights)
    need = np.stack([sizes, np.ones(len(sizes)), sizes.astype(np.float64) ** 2], 1) / capacity
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free, names, filled = np.empty((64, 3)), np.empty(64, np.int64), np.empty(64, np.int64)
    open_bins = made = 0
    order = np.argsort(-sizes, kind="stable")
    least = sizes.min() / limits.tokens if len(sizes) else 0
    for i in order:
        want = need[i]
        left = free[:open_bins] - want
        fits = np.flatnonzero((left >= -1e-12).all(axis=1))
        if len(fits):
            if limits.score == "norm":
                k = fits[np.argmin((left[fits] ** 2) @ weights)]
            else:
                k = fits[np.argmax(free[fits] @ (weights * want) / np.sqrt((free[fits] ** 2) @ weights))]
        else:
            if open_bins == len(free):
                free, names, filled = np.concatenate([free, np.empty_like(free)]), np.concatenate([names, names]), np.concatenate([filled, filled])
            k, free[open_bins], names[open_bins], filled[open_bins] = open_bins, 1.0, made, 0
            open_bins, made = open_bins + 1, made + 1
        bins[i], offsets[i] = names[k], filled[k]
        free[k] -= want
        filled[k] += sizes[i]
        if free[k, 0] < least - 1e-12 or (free[k] <= 1e-12).any():  # nothing more fits: the last open bin takes its place
            open_bins -= 1
            free[k], names[k], filled[k] = free[open_bins], names[open_bins], filled[open_bins]
    return bins, offsets


def pieces(docs: DataFrame, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces; its ids end with 2.

    A null text is empty: its end token is a piece. Ids may be null or repeated
    and rows stay; a very long text is encoded whole in one task; an empty table
    gives no rows; other columns are left out, whatever their names.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows, numbers = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py()), np.array([END], "<u4")).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), size)):
                    rows.append(k)
                    numbers.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            piece, start, length, crc = zip(*numbers) if numbers else ((), (), (), ())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    made = kept.select("doc_id", F.lit(0).alias("piece"), *(F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")))
    return kept.mapInArrow(run, made.schema)


def packed(found: DataFrame, limits: Limits = Limits(), group: int = GROUP) -> DataFrame:
    """Pieces (length, any more) with sequence_id and offset, which take the place of columns of those names.

    Repeated rows and null ids are packed like any; an empty table stays empty;
    other columns may have any names. A text's length doesn't matter here, its
    pieces are rows of their own.

    Pieces get a number where they are written, by which they are dealt to
    groups, so that many rows of one document don't meet in one group.
    """
    columns = [c for c in found.columns if c not in ("sequence_id", "offset")]
    rows, _ = staged_at(found.select(F.struct(*columns).alias("row"), F.col("length").alias("size"), F.monotonically_increasing_id().alias("number")), "pieces")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.select("row", "size", F.pmod(F.xxhash64("number"), F.lit(groups)).alias("bin_group"))

    def pack(key, table):
        bins, offsets = best_fit(table.column("size").to_numpy(), limits)
        ids = key[0].as_py() + groups * bins
        return table.select(["row"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = rows.select("row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    made = dealt.groupBy("bin_group").applyInArrow(pack, schema)
    return made.select(*(F.col("row")[c].alias(c) for c in columns), "sequence_id", "offset")


def sequences(found: DataFrame, settings: list[Limits], group: int = GROUP) -> DataFrame:
    """A row per setting: tokens, documents, cost, n_sequences that packing takes, and least, below which none can.

    ``least`` is the greatest of the three sums of need by capacity; a piece that
    alone exceeds the cost capacity fills a sequence. An empty table takes none.
    """
    length, out = F.col("length"), None
    for limits in settings:
        cost = F.least(length * length, F.lit(limits.cost)).cast("decimal(38,0)")
        over = lambda total, most: F.ceil(F.coalesce(total, F.lit(0)) / most).cast("long")
        least = found.agg(F.greatest(over(F.sum("length"), limits.tokens), over(F.count("*"), limits.documents), over(F.sum(cost), limits.cost)).alias("least"))
        used = packed(found, limits, group).agg(F.count_distinct("sequence_id").alias("n_sequences"))
        named = [F.lit(x).cast("long").alias(c) for c, x in (("tokens", limits.tokens), ("documents", limits.documents), ("cost", limits.cost))]
        one = used.crossJoin(least).select(*named, "n_sequences", "least")  # a row each
        out = one if out is None else out.unionByName(one)
    return out


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packed(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
