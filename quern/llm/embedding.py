"""Near-duplicate embeddings by a PCA-ordered, tiled comparison.

Vectors are turned onto the principal axes of all of them. Those of a label are
cut into tiles by halving: at each level a part that is too large is cut at its
mean on the leading axis on which it varies most. A tile has a box, the least
and greatest coordinate on each leading axis and of the norm of the rest. Unit
vectors of cosine t are at most sqrt(2 - 2t) apart, so tiles whose boxes are
further apart are never met.

Where two tiles meet, dot products are summed over the leading axes first; the
norms of what is left bound the rest, and a pair is given up once its cosine
can't reach the threshold. What stays is computed in double precision from the
vectors as they came.

Equal vectors of a label are one row with a count. A pair of tiles yields a
count of links for each row and a forest of edges, never the pairs themselves.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.components import components, least_reachable
from quern.llm.store import staged

#: Rows of a tile at least, of one whose label has many, and its bytes at most.
TILE, LARGE, BYTES = 1024, 8192, 32 << 20
#: Axes of the boxes, levels of cuts at most, and tiles of a block of pairs.
LEADING, LEVELS, BLOCK = 8, 48, 256
STEPS = (8, 16, 32, 64, 128, 256, 512)


def packed_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, dim, raw (doubles) and h (raw's digest of 128 bits); both are null for vectors that link with nothing."""
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            raws, dims = [], []
            lists = batch.column(2)
            for row, label in zip(lists, batch.column(1)):
                x = None if not row.is_valid or not label.is_valid or row.values.null_count else row.values.to_numpy(zero_copy_only=False)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                raws.append((x + 0.0).astype("<f8").tobytes() if good else None)
                dims.append(len(x) if good else 0)
            digests = [None if r is None else xxhash.xxh3_128_digest(r) for r in raws]
            columns = [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "dim", "raw", "h"])

    return kept.mapInArrow(run, "id long, label string, dim int, raw binary, h binary")


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the principal axes of all unit vectors of that length, as columns, greatest first.

    Tasks sum outer products; a matrix of dim by dim is added up and brought to
    the driver, an array for each of its rows, however many vectors there are.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                unit = _unit(_matrix(batch.column(1).take(pa.array(np.flatnonzero(dims == dim))), dim))
                sums[dim] = sums.get(dim, 0) + unit.T @ unit
        for dim, s in sums.items():
            columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "i", "s"])

    rows = classes.select("dim", "raw").mapInArrow(run, "dim int, i int, s array<double>")
    cells = rows.select("dim", "i", F.posexplode("s").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    lines = cells.groupBy("dim", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda c: c["x"]).alias("s"))
    found: dict[int, np.ndarray] = {}
    for r in lines.collect():
        found.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.i] = r.s
    return {dim: np.linalg.eigh((s + s.T) / 2)[1][:, ::-1] for dim, s in found.items()}


class _Side:
    """Vectors of a tile as they came, as unit vectors, and on the principal axes."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray):
        self.raw, self.unit = raw, _unit(raw)
        self.turned, self.norms = self.unit @ axes, np.sqrt((raw**2).sum(1))

    def part(self, start: int, end: int) -> "_Side":
        out = object.__new__(_Side)
        out.raw, out.unit, out.turned, out.norms = self.raw[start:end], self.unit[start:end], self.turned[start:end], self.norms[start:end]
        lead = out.turned[:, :LEADING]
        out.low, out.high = lead.min(0), lead.max(0)
        return out


def _linked(one: _Side, two: _Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of rows of two sides with cosine at or above the threshold."""
    pa_, pb = one.turned, two.turned
    dim, low = pa_.shape[1], threshold - 1e-9
    dots, done, i, j = np.zeros((len(pa_), len(pb))), 0, None, None
    for upto in [s for s in STEPS if s < dim] + [dim]:
        if i is None:
            dots += pa_[:, done:upto] @ pb[:, done:upto].T
            bound = dots + np.sqrt((pa_[:, upto:] ** 2).sum(1))[:, None] * np.sqrt((pb[:, upto:] ** 2).sum(1))[None, :]
            near = bound >= low
            n = np.count_nonzero(near)
            if not n:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if n * 16 < near.size:  # few are left: go on pair by pair
                i, j = np.nonzero(near)
                dots = dots[i, j]
        else:
            dots = dots + np.einsum("ij,ij->i", pa_[i, done:upto], pb[j, done:upto])
            stay = dots + np.sqrt((pa_[i, upto:] ** 2).sum(1) * (pb[j, upto:] ** 2).sum(1)) >= low
            i, j, dots = i[stay], j[stay], dots[stay]
        done = upto
    if i is None:
        i, j = np.nonzero(dots >= low)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            cosine = np.einsum("ij,ij->i", one.raw[x], two.raw[y]) / (one.norms[x] * two.norms[y])
        odd = ~np.isfinite(cosine)
        if odd.any():  # squares too large or too small for doubles
            cosine[odd] = np.einsum("ij,ij->i", one.unit[x[odd]], two.unit[y[odd]])
        keep[s : s + (1 << 16)] = cosine >= threshold
    return i[keep], j[keep]


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of rows of two tables of vectors with cosine at or above the threshold."""
    return _linked(_Side(a, axes), _Side(b, axes), threshold)


def _compared(one: np.ndarray, two: np.ndarray | None, w: np.ndarray, axes: np.ndarray, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of a tile, or of two one after the other: how many vectors they link to, and the least row reachable.

    Rows are taken in the order of the first axis, by blocks whose boxes are
    within reach; what a block links is added up before the next one.
    """
    sides, at = [], []
    for k, raw in enumerate((one,) if two is None else (one, two)):
        side = _Side(raw, axes)
        order = np.argsort(side.turned[:, 0], kind="stable")
        side.raw, side.unit, side.turned, side.norms = side.raw[order], side.unit[order], side.turned[order], side.norms[order]
        sides.append([side.part(s, s + TILE) for s in range(0, len(raw), TILE)])
        at.append([(order + k * len(one))[s : s + TILE] for s in range(0, len(raw), TILE)])
    n, root, every = np.zeros(len(w), np.int64), np.arange(len(w)), np.arange(len(w))
    for s, (x, a) in enumerate(zip(sides[0], at[0])):
        for t, (y, b) in enumerate(zip(sides[-1], at[-1])):
            gap = np.maximum(0, np.maximum(y.low - x.high, x.low - y.high))
            if (gap**2).sum() > reach**2 or two is None and t < s:
                continue
            i, j = _linked(x, y, threshold)
            if two is None and s == t:
                i, j = i[i < j], j[i < j]
            if len(i):
                u, v = a[i], b[j]
                n += (np.bincount(u, w[v], len(w)) + np.bincount(v, w[u], len(w))).astype(np.int64)
                new = root[u] != root[v]
                if new.any():
                    root = least_reachable(len(w), np.concatenate([every, u[new]]), np.concatenate([root, v[new]]))
    return n, root


def _arrays(of: str, n: int) -> Column:
    return F.array(*(F.expr(f"{of}(p[{k}])") for k in range(n)))


def _cut(placed: DataFrame, tile: int) -> DataFrame:
    """c, node and leaf for the rows of ``placed`` (c, label, dim, p) whose label has more than one tile.

    A node is halved while it has more than leaf rows and varies on any leading
    axis. Each level is one aggregation of means and variances by node.
    """
    sizes = placed.groupBy("label", "dim").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(tile), F.least(F.lit(LARGE * tile // TILE), F.floor(F.lit(BYTES // 8) / F.col("dim"))))
    leaf = F.least(most, F.greatest(F.lit(tile), F.ceil(F.col("n") / 4))).cast("long")
    large = staged(sizes.select("label", "dim", leaf.alias("leaf"), "n").where("n > leaf").drop("n"), "large")
    open_rows = placed.select("c", "label", "dim", "p").join(large, ["label", "dim"]).withColumn("node", F.lit(1).cast("long"))
    done = None
    for _ in range(LEVELS):
        stats = open_rows.groupBy("label", "dim", "node").agg(F.count("*").alias("n"), F.first("leaf").alias("most"), _arrays("var_pop", LEADING).alias("v"), _arrays("avg", LEADING).alias("m"))
        axis = (F.array_position("v", F.array_max("v")) - 1).cast("int")
        cuts = staged(stats.where("n > most and array_max(v) > 1e-12").select("label", "dim", "node", axis.alias("axis"), F.get("m", axis).alias("at")), "cuts")
        if cuts.isEmpty():
            break
        met = open_rows.join(cuts, ["label", "dim", "node"], "left")
        right = (F.get("p", F.col("axis")) >= F.col("at")).cast("long")
        moved = met.select("c", "label", "dim", "p", "leaf", F.when(F.col("axis").isNull(), F.col("node")).otherwise(2 * F.col("node") + right).alias("node"), F.col("axis").isNotNull().alias("still"))
        level = staged(moved, "level")
        stay = level.where("not still").select("c", "node", "leaf")
        done = stay if done is None else done.unionByName(stay)
        open_rows = level.where("still").drop("still")
    rest = open_rows.select("c", "node", "leaf")
    return rest if done is None else done.unionByName(rest)


def _pairs(nodes: DataFrame, reach: float) -> DataFrame:
    """Pairs of tiles whose boxes are within reach: label, dim, pair, and node, salt and number of each (a, b), a before b or itself.

    ``nodes`` has label, dim, node, salts, low and high. Tiles of a label are
    numbered and dealt by blocks of numbers to pairs of blocks.
    """
    number = F.row_number().over(W.partitionBy("label", "dim").orderBy("node", "salt")) - 1
    tiles = nodes.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    tiles = tiles.withColumn("number", number).withColumn("last", F.max("number").over(W.partitionBy("label", "dim")))
    tiles = staged(tiles.withColumn("g", F.floor(F.col("number") / BLOCK).cast("int")), "tiles")
    of = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("node", "salt", "number", "low", "high")]
    a = tiles.select("label", "dim", *of("a"), F.col("g").alias("ga"), F.explode(F.sequence(F.col("g"), F.floor(F.col("last") / BLOCK).cast("int"))).alias("gb"))
    b = tiles.select("label", "dim", *of("b"), F.explode(F.sequence(F.lit(0), F.col("g"))).alias("ga"), F.col("g").alias("gb"))
    apart = lambda low, high: F.transform(F.arrays_zip(low, high), lambda z: F.greatest(F.lit(0.0), z[low] - z[high]))
    gap = F.zip_with(apart("low_b", "high_a"), apart("low_a", "high_b"), lambda x, y: F.greatest(x, y))
    far = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    met = a.join(b, ["label", "dim", "ga", "gb"]).where((F.col("number_a") <= F.col("number_b")) & (far <= reach * reach))
    return met.select("label", "dim", F.struct("label", "dim", "number_a", "number_b").alias("pair"), "node_a", "salt_a", "node_b", "salt_b", "number_a", "number_b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """A row per vector: id, n_links, component (least id reachable) and kept (the id is its component's).

    Vectors are compared only within a label and a length. A null label, and a
    vector that is null, empty or zero or holds a null, NaN or infinity, links
    with nothing. Rows that repeat an id are vectors of their own. A null id is
    a component's only where all its ids are null, and then kept. An empty table
    gives no rows; other columns are left out, whatever their names. A long
    vector is compared whole.

    A label's tiles hold a quarter of it, between ``tile`` rows and eight times
    as many (32 MB of numbers at most), so that the copies of a vector that the
    comparison shuffles stay at two or three up to 32 times ``tile`` rows.
    Beyond, they grow with the count of tiles within reach.
    """
    rows = staged(packed_vectors(vectors, id_col, vector_col, label_col), "vectors")
    classes = rows.where("h is not null").groupBy("label", "dim", "h").agg(F.min("id").alias("first"), F.count("*").alias("w"), F.first("raw").alias("raw"))
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    axes = principal_axes(classes)
    reach = sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def place(batches):
        for batch in batches:
            dims, p = batch.column(2).to_numpy(), np.zeros((batch.num_rows, LEADING + 1))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                turned = _unit(_matrix(batch.column(3).take(pa.array(at)), dim)) @ axes[dim]
                p[at, : min(dim, LEADING)] = turned[:, :LEADING]
                p[at, LEADING] = np.sqrt((turned[:, LEADING:] ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(p), pa.list_(pa.float64()))], ["c", "label", "dim", "p"])

    placed = staged(classes.select("c", "label", "dim", "raw").mapInArrow(place, "c long, label string, dim int, p array<double>"), "placed")
    cut = _cut(placed, tile).select(F.col("c").alias("k"), "node", "leaf")
    noded = placed.join(cut, F.col("c") == F.col("k"), "left").drop("k").withColumn("node", F.coalesce("node", F.lit(1).cast("long")))
    noded = staged(noded, "noded")
    salts = F.coalesce(F.ceil(F.count("*") / F.first("leaf")), F.lit(1)).cast("int")
    nodes = noded.groupBy("label", "dim", "node").agg(salts.alias("salts"), _arrays("min", LEADING + 1).alias("low"), _arrays("max", LEADING + 1).alias("high"))
    nodes = staged(nodes, "nodes")
    pairs = staged(_pairs(nodes, reach), "pairs")
    side = lambda s, k: pairs.select("label", "dim", F.col(f"node_{s}").alias("node"), F.col(f"salt_{s}").alias("salt"), "pair", F.lit(k).alias("side"))
    deals = side("a", 0).unionByName(side("b", 1).where("pair.number_a <> pair.number_b"))
    salted = noded.join(nodes.select("label", "dim", "node", "salts"), ["label", "dim", "node"])
    salted = salted.select(F.col("c").alias("k"), "node", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"))
    members = classes.select("c", "raw", "w", "label", "dim").join(salted, F.col("c") == F.col("k"))
    dealt = members.join(deals, ["label", "dim", "node", "salt"]).select("pair", "side", "dim", "c", "w", "raw")

    def compare(key, table):
        dim = table.column("dim")[0].as_py()
        table = table.sort_by("side")
        first = table.column("side").to_numpy().searchsorted(1)
        c, w = table.column("c").to_numpy(), table.column("w").to_numpy()
        raw = _matrix(table.column("raw"), dim)
        n, root = _compared(raw[:first], raw[first:] if first < len(raw) else None, w, axes[dim], threshold, reach)
        some = np.flatnonzero(n)
        return pa.table({"c": c[some], "n": n[some], "to": c[root[some]]})

    found = staged(dealt.groupBy("pair").applyInArrow(compare, "c long, n long, to long"), "links")
    n_links = found.groupBy("c").agg(F.sum("n").alias("n"))
    of = components(found.select("c", "to"))
    by_root = of.join(classes.select("c", "first"), F.col("node") == F.col("c")).groupBy("root").agg(F.min("first").alias("least"))
    named = of.join(by_root, "root").select(F.col("node").alias("cn"), "least")
    known = classes.select("c", "label", "dim", "h", "w", "first").join(n_links.withColumnRenamed("c", "cl"), F.col("c") == F.col("cl"), "left")
    known = known.join(named, F.col("c") == F.col("cn"), "left")
    links = (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")
    known = staged(known.select(F.col("label").alias("kl"), F.col("dim").alias("kd"), F.col("h").alias("kh"), links, F.coalesce("least", "first").alias("component")), "known")
    out = rows.select("id", "label", "dim", "h").join(known, (F.col("label") == F.col("kl")) & (F.col("dim") == F.col("kd")) & (F.col("h") == F.col("kh")), "left")
    component = F.when(F.col("kh").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector with its count of links of cosine 0.98 or more within its label, its component and whether it stays."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


#: Cosines of all pairs within a label; vectors with a null or non-finite component, or none above zero, are left out.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  WITH RECURSIVE r(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, link.v FROM r JOIN link ON r.v = link.u) SELECT u, min(v) AS component_id FROM r GROUP BY u
)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN reach ON vec_id = reach.u LEFT JOIN (SELECT u, count(*) AS n FROM link GROUP BY u) k ON vec_id = k.u
"""
