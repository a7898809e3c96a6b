"""Near-duplicate documents by the Jaccard similarity of their five-word shingles.

SimHash's meeting in the middle finds what differs in few bits; a similarity of
0.8 lies near ten bits of 64, far beyond it. Its links are therefore completed
by bands of least hashes: a pair of similarity 0.8 shares none of 24 bands of
four with a probability of (1 - 0.8 ** 4) ** 24, three in a million.

Both only say what is worth comparing. Documents that they join, directly or by
way of others, are compared exactly, by their shingles' hashes of 64 bits. Many
small groups share a task; a large one is cut into tiles by its documents'
counts of shingles, which similarity bounds, and each pair of tiles within that
bound is a task. A task never returns pairs.

A document goes if an earlier one that stays is similar to it. A task that holds
a whole group decides so at once. Of a group in tiles each document learns of
the earliest one similar to it: those without one stay, those whose earliest one
stays go, and the few that are left, which lean on documents that went, are
compared with what stays and among each other in another round.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.simhash import RADIUS, SEED, bits_of, links, rows_of, shingle_hashes, text_hash
from quern.llm.store import dropped, staged, staged_at

WIDTH, BANDS, DEPTH = 5, 24, 4
#: Similarity from which a document goes, as a fraction.
SHARED, OF = 4, 5
#: Documents of a tile, and hashes that a task holds.
TILE, HASHES = 1024, 2 << 20
#: Columns of the table of documents by shingles that is multiplied at once.
COLUMNS = 2048

_rng = np.random.default_rng(SEED)
_FLIPS = _rng.integers(0, 2**64, BANDS * DEPTH, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**64, BANDS * DEPTH, dtype=np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of distinct shingle hashes; none without any."""
    if not len(hashes):
        return []
    least = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for part in np.array_split(hashes, len(hashes) // 8192 + 1):
        np.minimum(least, ((part[None, :] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - 2**63 for k, band in enumerate(least.reshape(BANDS, DEPTH))]


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d (what a document is ordered and known by), w (a digest of the words), fp, n (distinct shingles) and keys, for each document."""
    text = F.col(text_col).cast("string")
    kept = docs.select(F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), text_hash(text).alias("t")).alias("d"), text.cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            digests, fps, sizes, keys = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                hashes = shingle_hashes(text, WIDTH)
                distinct = np.unique(hashes)
                digests.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split() if text else [])))
                fps.append(bits_of(hashes))
                sizes.append(len(distinct))
                keys.append(band_keys(distinct))
            fp = np.array(fps, np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(fp), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["d", "w", "fp", "n", "keys"])

    zero = F.lit(0).cast("long")
    return kept.mapInArrow(run, kept.select("d", F.lit(b"").alias("w"), zero.alias("fp"), zero.alias("n"), F.lit(None).cast("array<long>").alias("keys")).schema)


def candidates(unique: DataFrame) -> DataFrame:
    """node and root for the documents (c, fp, keys) that a band or few bits of the fingerprint join to others."""
    stars = lambda rows: rows.groupBy("key").agg(F.min("c").alias("u"), F.count("*").alias("m")).where("m > 1").select(F.col("key").alias("k"), "u")
    met = lambda rows: rows.join(stars(rows), F.col("key").bitwiseXOR(F.lit(0).cast("long")) == F.col("k")).select("c", "u")
    bands = met(unique.select("c", F.explode("keys").alias("key")))
    bits = met(unique.select("c", F.col("fp").alias("key")))
    first = staged(unique.groupBy("fp").agg(F.min("c").alias("c")), "first")
    near = links(first.select("fp"), RADIUS).join(first.select(F.col("fp").alias("u"), F.col("c").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("c").alias("b")), "v")
    return staged(components(bands.unionByName(bits).unionByName(near.select(F.col("a").alias("c"), F.col("b").alias("u"))).where("c <> u")), "candidates")


def similar_pairs(hashes: list[np.ndarray], first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i before j, of sets of similarity 0.8 or more; with ``first`` only pairs of one of the first ones and one of the others."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    m, end = len(hashes), len(hashes) if first is None else first
    start = 0 if first is None else first
    values, owner = np.concatenate(hashes), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    code = np.cumsum(new) - 1
    several = np.bincount(code)[code] > 1 if len(code) else np.empty(0, bool)
    code, owner = code[several], owner[several]
    code = np.cumsum(np.concatenate([[True], code[1:] != code[:-1]])) - 1 if len(code) else code
    both = np.zeros((end, m - start), np.float32)  # counts below 2 ** 24 are exact
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, (low, low + COLUMNS))
        held = np.zeros((m, COLUMNS), np.float32)
        held[owner[a:b], code[a:b] - low] = 1
        both += held[:end] @ held[start:].T
    both = both.astype(np.int64)
    i, j = np.nonzero(OF * both >= SHARED * (sizes[:end, None] + sizes[None, start:] - both))
    j = j + start
    keep = i < j
    return i[keep], j[keep]


def _gone(i: np.ndarray, j: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """Which rows go, in order: those with an earlier similar one (pairs i, j) that stays; rows of ``stays`` do so anyway."""
    gone = np.zeros(len(stays), bool)
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1], [True]])) if len(j) else np.zeros(1, int)
    for a, b in zip(cuts, cuts[1:]):
        gone[j[a]] = not stays[j[a]] and not gone[i[a:b]].all()
    return gone


def _compared(key, table):
    """What a task learns of documents: c, gone, and in a tile the earliest undecided one that is similar, as place (null, id, t) and c."""
    table = table.sort_by([("null", "ascending"), ("id", "ascending"), ("t", "ascending")])
    root, side, c, stays = (table.column(x).to_numpy() for x in ("root", "side", "c", "stays"))
    whole = key[0].as_py()["root"] == -1
    order = np.lexsort((side, root))  # places in the table tell which document is earlier
    root, side = root[order], side[order]
    hashes = [np.frombuffer(x.as_py(), "<u8") for x in table.column("hashes").take(pa.array(order))]
    cuts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]]))
    earlier, later = [], []
    for a, b in zip(cuts, cuts[1:]):
        split = int(np.searchsorted(side[a:b], 1))
        i, j = similar_pairs(hashes[a:b], split if split < b - a else None)
        x, y = order[a:b][i], order[a:b][j]
        earlier.append(np.minimum(x, y))
        later.append(np.maximum(x, y))
    i, j = np.concatenate(earlier), np.concatenate(later)
    if whole:
        gone, first = _gone(i, j, stays), np.full(len(c), -1)
    else:
        gone, first = np.zeros(len(c), bool), np.full(len(c), len(c))
        gone[j[stays[i]]] = True
        np.minimum.at(first, j[~stays[i]], i[~stays[i]])
        first[first == len(c)] = -1
    gone &= ~stays
    told = np.flatnonzero(gone | (first >= 0) & ~stays)
    at = pa.array(np.where(first[told] >= 0, first[told], 0), mask=first[told] < 0)
    columns = [pa.array(c[told]), pa.array(gone[told]), *(table.column(x).take(at).combine_chunks() for x in ("null", "id", "t", "c"))]
    return pa.table(columns, ["c", "gone", "null", "id", "t", "first"])


def _tasks(members: DataFrame) -> DataFrame:
    """c, root, side and task of members (c, root, n): where each is compared.

    Small groups are dealt to tasks whole. In a large one a document meets those
    of its own cell of counts and of the next: cells are a similarity wide.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    large = staged(sizes.where((F.col("m") > TILE) | (F.col("total") > HASHES)).select(F.col("root").alias("big")), "large")
    small = members.join(large, F.col("root") == F.col("big"), "left_anti")
    m, total = small.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, -(-m // TILE), -(-total // HASHES))
    out = small.select("c", "root", F.lit(0).alias("side"), F.struct(F.lit(-1).cast("long").alias("root"), F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("a"), F.lit(0).cast("long").alias("b")).alias("task"))
    cell = F.floor(F.log("n") / log(OF / SHARED) + 1e-9).cast("long")
    rows = members.where("n > 0").join(large, F.col("root") == F.col("big")).select("c", "root", "n", cell.alias("cell"))
    salts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / HASHES)).cast("int")
    cells = staged(rows.groupBy("root", "cell").agg(salts.alias("salts")), "cells")
    tile = lambda cell, salt: F.col(cell) * (1 << 31) + F.col(salt)
    tiles = cells.select("root", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = cells.select(F.col("root").alias("root2"), F.col("cell").alias("cell2"), F.col("salts").alias("salts2"))
    met = tiles.select("*", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("to")).join(other, (F.col("root") == F.col("root2")) & (F.col("to") == F.col("cell2")))
    met = met.select("root", "cell", "salt", "cell2", F.explode(F.sequence(F.lit(0), F.col("salts2") - 1)).alias("salt2")).where("cell < cell2 or salt <= salt2")
    met = met.withColumn("task", F.struct("root", tile("cell", "salt").alias("a"), tile("cell2", "salt2").alias("b")))
    sides = met.select("root", "cell", "salt", F.lit(0).alias("side"), "task").unionByName(met.where("task.a <> task.b").select("root", F.col("cell2").alias("cell"), F.col("salt2").alias("salt"), F.lit(1).alias("side"), "task"))
    salted = rows.join(cells, ["root", "cell"]).select("c", "root", "cell", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"))
    return out.unionByName(salted.join(sides, ["root", "cell", "salt"]).select("c", "root", "side", "task"))


def _hash(d: str):
    return F.xxhash64(F.col(f"{d}.id"), F.col(f"{d}.null"))


def remaining(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Column d of the documents that stay: the least of those with the same words, unless an earlier one that stays is similar."""
    same = signatures(docs, id_col, text_col).groupBy("w").agg(F.min("d").alias("d"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    unique, unique_path = staged_at(same.drop("w").withColumn("c", F.monotonically_increasing_id()), "unique")
    joined = candidates(unique.select("c", "fp", "keys"))
    members, members_path = staged_at(unique.select("c", "d", "n").join(joined, F.col("c") == F.col("node")).drop("node"), "members")
    open_ones, gone = members.withColumn("stays", F.lit(False)), None
    while True:
        found = staged(_told(docs, open_ones, id_col, text_col).groupBy("c").agg(F.max("gone").alias("gone"), F.min(F.when(F.col("first").isNotNull(), F.struct("null", "id", "t", "first"))).alias("f")), "told")
        # Without an earlier undecided one a document's case is clear; with one that stays as well.
        unclear = found.where("not gone and f is not null").select("c", F.col("f.first").alias("first"))
        leaning = staged(unclear.join(found.select(F.col("c").alias("first"), F.lit(True).alias("open")), "first", "left"), "leaning")
        now = found.where("gone").select("c").unionByName(leaning.where("open is null").select("c"))
        gone = staged(now if gone is None else gone.unionByName(now), "gone")
        rest = leaning.where("open").select("c")
        if rest.isEmpty():
            break
        rest = staged(members.join(rest, "c", "left_semi"), "rest")
        near = members.join(rest.select("root").distinct(), "root", "left_semi").join(gone, "c", "left_anti").join(rest.select("c"), "c", "left_anti")
        open_ones = staged(rest.withColumn("stays", F.lit(False)).unionByName(near.withColumn("stays", F.lit(True)).select(*rest.columns, "stays")), "open")
    stay = staged(unique.join(gone, "c", "left_anti").select("d"), "stay")
    for path in (unique_path, members_path):  # what stays is all that is read from here on
        dropped(docs.sparkSession, path)
    return stay


def _told(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What tasks learn of members (c, d, n, root, stays)."""
    # The texts of documents that are joined to no other aren't fetched.
    text = F.col(text_col).cast("string")
    wanted = members.select(_hash("d").alias("h"), F.col("d.t").alias("t"), "c")
    held = docs.select(F.xxhash64(F.col(id_col), F.col(id_col).isNull()).alias("h"), text_hash(text).alias("t"), text.cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            made = [np.unique(shingle_hashes(x.as_py(), WIDTH)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["c", "hashes"])

    hashed = held.join(wanted, ["h", "t"]).select("c", "text").mapInArrow(run, "c long, hashes binary")
    hashed = hashed.groupBy("c").agg(F.first("hashes").alias("hashes"))
    tasks = _tasks(members.select("c", "root", "n")).join(members.select(F.col("c").alias("k"), "d.*", "stays"), F.col("c") == F.col("k")).drop("c")
    dealt = hashed.join(tasks, F.col("c") == F.col("k")).select("task", "root", "side", "c", "null", "id", "t", "stays", "hashes")
    shape = dealt.select("c", F.lit(False).alias("gone"), "null", "id", "t", F.col("c").alias("first")).schema
    return dealt.groupBy("task").applyInArrow(_compared, shape)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that have an earlier one's words or are similar to an earlier one that stays: similarity 0.8 of five-word shingles.

    Earlier is the lesser id, a null after all others, then the lesser text
    hash. Nulls and texts without words are alike. Of rows that repeat an id and
    a text one stays. Very long texts are compared whole, an empty table stays
    empty, and columns may have any names.
    """
    return rows_of(docs, remaining(docs, id_col, text_col).select(_hash("d").alias("h"), F.col("d.t").alias("t")), id_col, text_col)
