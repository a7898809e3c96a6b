import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import embedding, simhash
from quern.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[k : k + 4]) for k in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_and_components_equal_brute_force(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    root = reach(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (prints[k], rows[root[k]].doc_id) for k, r in enumerate(rows)}


def test_links_find_every_pair_within_the_ball(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    for base in fps[:20]:
        for bits in (1, 4, 5, 8):
            fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    root = reach(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    found = components(simhash.links(spark.createDataFrame([(x,) for x in set(signed)], "fp long"))).collect()
    name = {r.node: r.root for r in found}
    for i in range(len(fps)):
        for j in range(i):
            same = name.get(signed[i], signed[i]) == name.get(signed[j], signed[j])
            assert same == (root[i] == root[j])


def test_full_buckets_are_dealt_on(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**64, dtype=np.uint64))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(150)}
    fps |= {int(x) for x in rng.integers(0, 2**64, 30, dtype=np.uint64)}
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    of = lambda most: {(r.node, r.root) for r in components(simhash.links(df, most=most)).collect()}
    whole = of(simhash.BUCKET)
    assert whole and of(20_000) == whole == of(300)


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = {r.component for r in rows if r.fp == 0}
    assert empty == {2}
    assert {r.component for r in rows if r.doc_id in (1, 6)} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 7]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 340)]
    nodes = sorted({x for e in edges for x in e})
    at = {n: k for k, n in enumerate(nodes)}
    pairs = {(at[max(e)], at[min(e)]) for e in edges}
    root = reach(len(nodes), lambda i, j: (i, j) in pairs)
    # Whatever the columns are called, such as those that the rounds use themselves.
    names = (("a", "b"), ("u", "v"), ("c", "u"))[seed]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (7, None)], f"{names[0]} long, {names[1]} long")).collect()}
    assert got == {n: nodes[root[k]] for k, n in enumerate(nodes) if any(n in e and e[0] != e[1] for e in edges)}


def vectors_and_truth(spark, threshold):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    rows, k = [], 0
    for x in base:
        for noise in (0, 0, 0.01, 0.05, 0.12):
            rows.append((k, [float(v) for v in (x + rng.normal(size=16) * noise) * rng.uniform(0.1, 9)], int(k % 3 == 0)))
            k += 1
    rows.append((k, rows[0][1], rows[0][2]))
    rows += [(k + 1, None, 1), (k + 2, [0.0] * 16, 1), (k + 3, [float("nan")] * 16, 1), (k + 4, [1e300] * 16, 1), (k + 5, [2e300] * 16, 1), (k + 6, rows[0][1], None), (k + 7, [1.0, None] + [0.0] * 14, 1), (k + 8, [], 0), (k + 9, [1.0, 2.0], 0), (k + 10, [2.0, 4.0], 0)]

    def cosine(i, j):
        a, b = rows[i], rows[j]
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]) or None in a[1] or None in b[1]:
            return -1
        x, y = np.array(a[1]) / max(map(abs, a[1]), default=1), np.array(b[1]) / max(map(abs, b[1]), default=1)
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            return -1
        return x @ y / np.sqrt((x @ x) * (y @ y))

    return rows, lambda i, j: cosine(i, j) >= threshold


@pytest.mark.parametrize("tile", [8, 1024])
def test_embeddings_equal_brute_force(spark, tile):
    with np.errstate(all="ignore"):
        rows, linked = vectors_and_truth(spark, 0.98)
        root = reach(len(rows), linked)
        n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("raw", F.lit(1)).withColumn("w", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component, r.kept) for r in embedding.near_duplicates(df, tile=tile).collect()}
    assert got == {k: (n[k], root[k], root[k] == k) for k in range(len(rows))}


def test_tiles_are_cut_along_several_axes(spark):
    """A label of many clusters: few of its pairs of tiles are met, and no link is lost. Equal directions, which no cut parts, are salted."""
    rng = np.random.default_rng(9)
    centres = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    rows = [(k, [float(v) for v in centres[k % 24] + rng.normal(size=24) * 0.01], 1) for k in range(960)]
    rows += [(k, [float(v) for v in centres[0] * k], 2) for k in range(2000, 2100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component) for r in embedding.near_duplicates(df, tile=16).collect()}
    assert got == {k: (39, k % 24) for k in range(960)} | {k: (99, 2000) for k in range(2000, 2100)}
    packed = embedding.packed_vectors(df).withColumn("c", F.col("id"))
    axes = embedding.principal_axes(packed)[24]
    p = [(k, str(label), 24, [*(x := np.array(v) / np.linalg.norm(v) @ axes)[:8].tolist(), float(np.linalg.norm(x[8:]))]) for k, v, label in rows]
    placed = spark.createDataFrame(p, "c long, label string, dim int, p array<double>")
    cut = embedding._cut(placed.where("label = '1'"), 16)
    sizes = [r["count"] for r in cut.groupBy("node").count().collect()]
    assert sum(sizes) == 960 and max(sizes) <= 128 and len(sizes) >= 8


def test_linked_stops_early_but_misses_nothing():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(200, 64)), rng.normal(size=(150, 64))
    b[:40] = a[:40] + rng.normal(size=(40, 64)) * 0.2
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    i, j = embedding.linked(a, b, axes, 0.98)
    cosine = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(cosine >= 0.98))))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding.near_duplicates(df).count() == 0
    only = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1), (3, None, None)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.n_links, r.component, r.kept) for r in embedding.near_duplicates(only).collect() if r.vec_id) == [(0, 3, True)]
