import random

import corpus_pipeline
import numpy as np
import pytest

from quern.llm import minhash

DATA = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def families(seed):
    """Texts in families that differ in some words, on both sides of 0.8."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for changes in (0, 0, 1, 2, 3, 4, 5, 6, 8):
            words = list(base)
            for at in rng.sample(range(200), changes):
                words[at] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


def test_who_goes_has_an_earlier_one_at_0_8_and_who_stays_has_none_that_stays(spark):
    texts = families(1)
    sets = [plain_shingles(x) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, DATA).collect()}
    assert all(any(jaccard(sets[i], sets[j]) >= 0.8 for j in range(i)) for i in range(len(texts)) if i not in kept)
    assert not [(i, j) for i in kept for j in kept if j < i and jaccard(sets[i], sets[j]) >= 0.8]
    assert 12 <= len(kept) < len(texts)


def staying(sets):
    """Documents without an earlier similar one that stays."""
    kept = set()
    for i in range(len(sets)):
        if not any(jaccard(sets[i], sets[j]) >= 0.8 for j in kept):
            kept.add(i)
    return kept


def test_a_bucket_of_texts_that_are_not_similar(spark):
    """Half of the words are the same in all, so buckets stay full for several rounds; one pair at the end is similar."""
    common = " ".join(f"c{k}" for k in range(150))
    texts = [f"{common} " + " ".join(f"x{i}y{k}" for k in range(60)) for i in range(60)]
    texts.append(texts[-1] + " and more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.one_of_each(df).collect()) == list(range(60))


@pytest.mark.parametrize("first", [None, 30])
def test_similar_pairs_equal_brute_force(first):
    sets = [minhash.shingle_hashes(x.encode(), 5) for x in families(2)[:70]] + [np.empty(0, "<u8")]
    sets = [np.unique(x) for x in sets]
    found = set(zip(*(x.tolist() for x in minhash.similar_pairs(sets, first))))
    plain = [set(x.tolist()) for x in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(plain[i], plain[j]) >= 0.8 and (first is None or i < first <= j)}
    assert found == want and len(want) > 5


def test_a_large_group_is_cut_into_tiles(spark, monkeypatch):
    """With tiles of eight documents each family is a large group of many cells and salts."""
    monkeypatch.setattr(minhash, "TILE", 8)
    texts = [x if k % 3 else " ".join(x.split()[: 160 + k % 40]) for k, x in enumerate(families(4))]
    sets = [plain_shingles(x) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in minhash.one_of_each(df).collect()}
    assert kept == staying(sets)


def chain(n, of=100):
    """Texts of which each is about 0.83 similar to the one before, and less to those before that."""
    words = [f"w{k}" for k in range(of + 10 * n)]
    return [" ".join(words[9 * k : 9 * k + of]) for k in range(n)]


@pytest.mark.parametrize("tile", [1024, 4])
def test_only_what_resembles_one_that_stays_goes(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    texts = chain(12)
    sets = [plain_shingles(x) for x in texts]
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(sets, sets[1:])) and jaccard(sets[0], sets[2]) < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in minhash.one_of_each(df).collect()}
    assert kept == staying(sets) == set(range(0, 12, 2))


def test_rows_go_in_order():
    i, j = np.array([0, 1, 2, 0, 3]), np.array([1, 2, 3, 3, 4])
    assert minhash._gone(i, j, np.zeros(6, bool)).tolist() == [False, True, False, True, False, False]
    assert minhash._gone(i, j, np.array([0, 1, 0, 0, 0, 0], bool)).tolist() == [False, False, True, True, False, False]
    assert not minhash._gone(i[:0], j[:0], np.zeros(3, bool)).any()


def test_odd_rows_go_as_with_fingerprints(odd, none):
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 7]
    assert minhash.one_of_each(none).count() == 0
