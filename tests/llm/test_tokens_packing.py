import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import packing, tokens

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_both_ways_of_encoding_agree(docs, library):
    encode = tokens.encoder()
    texts = [r.text for r in docs.select("text").collect()] + ["<|endoftext|> x", "a <|endoftext|> b <|endoftext|", "a\u2003b\x85c\x1cd", "naïve 日本語 한국 привет ½ ²", "don't I'LL", "  lead", "x" * 5000, "\u180e", "e\u0301", "\ud7a4 \U0001f600!"]
    for text in texts:
        assert encode(text).tolist() == library(text)
    assert tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))("a b").tolist() == library("a b")
    assert encode(None).tolist() == encode("").tolist() == []


def test_histogram_and_sums(docs, library, odd, none):
    lengths = [len(library(r.text)) for r in docs.select("text").collect()]
    hist = tokens.histogram(docs)
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(lengths)
    for blocks in (16, 1024):
        for r in tokens.suffix_sums(hist, blocks).collect():
            n = r.n_tokens
            assert r.docs_longer == sum(x > n for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
            assert r.docs_upto == sum(x <= n for x in lengths) and r.truncated_total == sum(min(x, n) for x in lengths) and r.total == sum(lengths)
    assert tokens.truncated_total(hist, 100) == sum(min(x, 100) for x in lengths)
    assert tokens.quantile(hist, 0.5) == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert sum(r.n_docs for r in tokens.histogram(odd).collect()) == odd.count()
    assert tokens.suffix_sums(tokens.histogram(none)).count() == 0 and tokens.truncated_total(tokens.histogram(none), 5) == 0


def checked(rows, most=1024):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= most
    return len(at)


def test_packing_is_whole_and_tight(docs, library):
    rows = packing.packed(packing.pieces(docs), group=64).collect()
    ids = {r.doc_id: np.array(library(r.text) + [2], "<u4") for r in docs.select("doc_id", "text").collect()}
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == sum(x.length for x in got[r.doc_id]) and r.piece == len(got[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.length == 1024 or r.piece == 0
        got[r.doc_id].append(r)
    assert {k: sum(x.length for x in v) for k, v in got.items()} == {k: len(v) for k, v in ids.items()}
    groups = -(-len(rows) // 64)
    assert checked(rows) <= -(-sum(map(len, ids.values())) // 1024) + 2 * groups


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    sizes = np.random.default_rng(2).integers(1, 300, 400)
    limits = packing.Limits(1024, 7, 150_000, (1.0, 0.5, 0.5), score)
    bins, offsets = packing.best_fit(sizes, limits)
    for b in set(bins.tolist()):
        inside = sizes[bins == b]
        assert inside.sum() <= 1024 and len(inside) <= 7 and (inside**2).sum() <= 150_000
        assert sorted(offsets[bins == b].tolist()) == sorted(np.concatenate([[0], np.cumsum(inside[np.argsort(offsets[bins == b])])[:-1]]).tolist())


def test_what_capacities_that_bind_cost(docs, none):
    found = packing.pieces(docs).where("length < 1024")
    settings = [packing.Limits(), packing.Limits(documents=2), packing.Limits(cost=200_000), packing.Limits(documents=2, cost=200_000)]
    rows = packing.sequences(found, settings).collect()
    free, few, cheap, both = (r.n_sequences for r in rows)
    assert free < few <= both and free < cheap <= both
    assert all(r.least <= r.n_sequences for r in rows)
    sizes = [r.length for r in found.collect()]
    assert [r.least for r in rows] == [max(-(-sum(sizes) // 1024), -(-len(sizes) // s.documents), -(-sum(min(x * x, s.cost) for x in sizes) // s.cost)) for s in settings]
    assert [(r.n_sequences, r.least) for r in packing.sequences(packing.pieces(none), settings[:1]).collect()] == [(0, 0)]


def test_exact_fits_are_found():
    assert len(set(packing.best_fit(np.array([600, 424, 500, 524, 1024, 1000, 24]), packing.Limits())[0].tolist())) == 4


def test_odd_rows_pack(odd, none):
    rows = packing.packed(packing.pieces(odd)).collect()
    assert len({r.ids_crc32 for r in rows if r.length == 1}) == 1 and checked(rows)
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert packing.packed(packing.pieces(none)).count() == 0
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]
    assert odd.select(F.count("*")).first()[0] == 10


def test_columns_of_any_names_are_packed(spark):
    found = spark.createDataFrame([(k, 100 + k, "a", "b", k, -1) for k in range(30)], "doc_id long, length long, number string, bin_group string, row long, offset long")
    out = packing.packed(found)
    assert sorted(out.columns) == sorted([*found.columns, "sequence_id"])
    rows = out.collect()
    assert len(rows) == 30 and all((r.number, r.bin_group, r.row) == ("a", "b", r.doc_id) and r.offset >= 0 for r in rows)
