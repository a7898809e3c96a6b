"""Near-duplicate documents by SimHash: meet in the middle of the Hamming ball.

Two fingerprints differ in at most ``2 r`` bits exactly if some value differs
from each in at most ``r``. So every fingerprint emits all its variants within
``r`` bits; fingerprints that share a variant are linked.

A variant is shuffled by its leading bits. A fingerprint goes once to each
bucket that holds any of its variants, and the bucket's task makes the variants
that fall into it, so that the shuffle carries tens of rows instead of
thousands for a fingerprint. Equal fingerprints are one row before that. A
variant then has at most as many fingerprints as its ball has values, however
large a group of copies is, and a bucket emits at most one edge a fingerprint.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components, least_reachable
from quern.llm.store import staged

SEED, WIDTH, RADIUS = 42, 4, 4
#: Variants that a bucket's task makes at most, and rows of a broadcast table of bucket numbers at most.
BUCKET, FEW = 8_000_000, 100_000


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, repeats included; all words are one where they are fewer than ``width``."""
    words = text.lower().split() if text else []  # of bytes: A-Z, and the six white space characters
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), "<u8", max(1, len(words) - width + 1))


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if it is in more than half of them; zero without any."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for part in np.array_split(hashes, n // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint of a text in UTF-8; zero without words."""
    return bits_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, t (a hash of the text) and fp, a long with the fingerprint's bits."""
    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).alias("id"), text_hash(text).alias("t"), text.cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["id", "t", "fp"])

    return kept.mapInArrow(run, kept.select("id", "t", F.lit(0).cast("long").alias("fp")).schema)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _masks(bits: int, most: int) -> list[list[int]]:
    """Values with k of the low ``bits`` bits set, for each k up to ``most``."""
    return [[sum(1 << p for p in at) for at in combinations(range(bits), k)] for k in range(most + 1)]


def _bucket_edges(fps: np.ndarray, bucket: int, bits: int, radius: int, low: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges from fingerprints to others that have a variant in common with them in this bucket; none joins two that were joined already."""
    rest = np.uint64(64 - bits)
    used = np.bitwise_count((fps >> rest) ^ np.uint64(bucket))
    tail = fps & np.uint64((1 << (64 - bits)) - 1)
    rows, values = [], []
    for k in range(radius + 1):
        at = np.flatnonzero(used == k)
        masks = np.concatenate(low[: radius - k + 1])
        values.append((tail[at, None] ^ masks[None, :]).ravel())
        rows.append((at, len(masks)))
    value = np.concatenate(values)
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return fps[:0], fps[:0]
    owner, group = [], []
    for (at, wide), part in zip(rows, values):
        place = np.minimum(np.searchsorted(twice, part), len(twice) - 1)
        hit = np.flatnonzero(twice[place] == part)
        owner.append(at[hit // wide] if wide else at[:0])
        group.append(place[hit])
    owner, group = np.concatenate(owner), np.concatenate(group)
    first = np.full(len(twice), len(fps), np.int64)
    np.minimum.at(first, group, owner)
    pairs = np.unique(np.stack([owner, first[group]], 1), axis=0)
    near = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 2 * radius
    pairs = pairs[near & (pairs[:, 0] != pairs[:, 1])]
    root = least_reachable(len(fps), pairs[:, 0], pairs[:, 1])
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _deeper(rows: DataFrame, bits: int, radius: int, step: int) -> DataFrame:
    """Rows (fp, bucket, used) of buckets of ``bits`` leading bits, dealt on to buckets of ``step`` more; used counts the bits that a bucket differs in."""
    masks = _masks(step, radius)
    within = lambda k: F.array(*(F.struct(F.lit(m).cast("long").alias("flip"), F.lit(n).alias("n")) for n in range(k + 1) for m in masks[n]))
    flips = within(0)
    for used in range(radius):
        flips = F.when(F.col("used") == used, within(radius - used)).otherwise(flips)
    own = F.shiftrightunsigned("fp", 64 - bits - step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    dealt = rows.select("fp", "bucket", "used", F.explode(flips).alias("f"))
    return dealt.select("fp", F.shiftleft("bucket", step).bitwiseOR(own.bitwiseXOR(F.col("f.flip"))).alias("bucket"), (F.col("used") + F.col("f.n")).alias("used"))


def _meeting(bits: int, radius: int, low: list[np.ndarray]):
    def meet(key, table):
        fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
        u, v = _bucket_edges(fps, key[0].as_py(), bits, radius, low)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return meet


def links(unique: DataFrame, distance: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """Edges u, v of a forest that joins fingerprints (column ``fp``, distinct) within ``distance`` bits, directly or by way of others.

    Buckets that would make more than ``most`` variants, such as one that holds
    a third of all fingerprints, are dealt on by six more bits, again and again
    if need be; at 60 bits a bucket is small whatever the fingerprints are.
    """
    if distance % 2:
        raise ValueError("the distance has to be even: it is met in the middle")
    radius, n = distance // 2, unique.count()
    bits = max(10, ceil(log2(max(n, 2) / 2048)))
    rows = _deeper(unique.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("used")), 0, radius, bits)
    found = None
    while True:
        low = [np.array(m, np.uint64) for m in _masks(64 - bits, radius)]
        variants = F.lit(1)
        for used in range(radius):
            variants = F.when(F.col("used") == used, sum(len(low[k]) for k in range(radius - used + 1))).otherwise(variants)
        step, full = min(6, 60 - bits), None
        if step > 0:
            full = staged(rows.groupBy("bucket").agg(F.sum(variants).alias("n")).where(F.col("n") > most).select(F.col("bucket").alias("full")), "full")
            held = full.count()
            full = F.broadcast(full) if 0 < held <= FEW else full if held else None
        met = rows.join(full, F.col("bucket") == F.col("full"), "left_anti") if full is not None else rows
        edges = met.select("fp", "bucket").groupBy("bucket").applyInArrow(_meeting(bits, radius, low), "u long, v long")
        found = edges if found is None else found.unionByName(edges)
        if full is None:
            return found.distinct()
        rows = staged(_deeper(rows.join(full, F.col("bucket") == F.col("full"), "left_semi"), bits, radius, step), "deeper")
        bits += step


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """A row per document: id, t, fp, root (a fingerprint that names its component) and component (the component's least id)."""
    fps = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    unique = staged(fps.groupBy("fp").agg(F.min("id").alias("first")), "unique")
    found = staged(components(links(unique.select("fp"), distance)), "components")
    of = found.join(unique, found.node == unique.fp)
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    named = staged(found.join(least, "root").select(F.col("node").alias("fp"), "root", "least"), "components")
    by_fp = unique.join(named, "fp", "left").select(F.col("fp").bitwiseXOR(F.lit(0).cast("long")).alias("k"), F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component"))
    return fps.join(by_fp, fps.fp == by_fp.k).select("id", "t", "fp", "root", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """One row per document: the id, ``fp`` and ``component`` (the least id that links reach, itself included).

    Nulls and texts without words have the fingerprint zero and are linked like
    any other. A null id never is a component's id unless all ids in it are
    null. Repeated rows stay, each with the same component. Further columns are
    left out, whatever their names. Empty input gives an empty result.
    """
    return grouped(docs, id_col, text_col, distance, width).select(F.col("id").alias(id_col), "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """The documents, all columns, one of each component: that of the least id, and of rows that share it of the least text hash.

    A null id stays only where its component has no other. Of rows that repeat
    an id and a text one stays.
    """
    place = F.struct(F.col("id").isNull().alias("null"), "id", "t")
    kept = grouped(docs, id_col, text_col, distance, width).groupBy("root").agg(F.min(place).alias("p")).select("p.*")
    return rows_of(docs, kept.select(F.xxhash64("id", F.col("id").isNull()).alias("h"), "t"), id_col, text_col)


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents, all columns, whose hashes of the id and the text are rows (h, t) of ``kept``; one of those that share both."""
    # Rows meet and are made one by two hashes of the id and the text, so that one shuffle of the texts serves both.
    kept = staged(kept.distinct(), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_hash(F.col(text_col).cast("string")).alias("t"))
    rows = rows.select("row", F.xxhash64("id", F.col("id").isNull()).alias("h"), "t")
    return rows.join(kept, ["h", "t"], "left_semi").dropDuplicates(["h", "t"]).select("row.*")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the least doc_id within reach of links of at most four bits."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
