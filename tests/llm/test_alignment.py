"""The alignment against byte offsets worked out one document after another."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import alignment
from quern.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TEXTS = [
    "Plain words, twice twice.", " leading space", "two  spaces\n\nand lines\t\tand tabs", "<|endoftext|> and <s> </s> are text", "漢字かな混じり文、ひらがな", "naïve café ½ ﬁ", "\x00\x01 control",
    "🙂🙃 smile", "a▁b holds the piece's own space", "xx" * 3000, " ", "​﻿", "123456789 3.14159", None, "",
]


def groups(aligner, text):
    """Groups from the sets of both sides' ends, without a transducer; None without tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = aligner.encode_a(" " + text).tolist(), aligner._pieces.encode(text)
    if b"".join(aligner.bytes_a[k] for k in a) != whole or b"".join(aligner.bytes_b[k] for k in b) != whole:
        return None
    ends_a, ends_b = (np.cumsum([len(table[k]) for k in ids]).tolist() for table, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b)))
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:to_a], b[j:to_b]))
        i, j = to_a, to_b
    return out


def brute(aligner, rows):
    found = {d: groups(aligner, t) or [] for d, t in rows}
    counts = Counter((a[-1], b[-1]) for g in found.values() for a, b in g)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = {}
    for d, g in found.items():
        links = [(a[-1], b[-1]) for a, b in g]
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        digest = hashlib.sha256(told.encode()).hexdigest() if g else ""
        out[d] = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
    return out


@pytest.fixture(scope="module")
def aligner():
    return alignment.aligner()


def test_groups_are_those_of_the_common_ends(aligner):
    for text in TEXTS:
        found, want = aligner(text), groups(aligner, text)
        told = want and ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want)
        assert (found is None) == (want is None) and (found is None or aligner.told(*found) == told), text
    assert aligner("a▁b") is None and aligner("<|endoftext|>")[0] != [220, 50256]


def test_each_side_may_lead_by_several_tokens_and_differing_bytes_are_refused():
    made = alignment.Transducer([b"a", b"abc", b"b", b"cd", b"d"], [b"ab", b"abcd", b"c", b"d", b"x"])
    assert made.inner([1, 4], [0, 2, 3]) == ([], [0])  # abc|ab,c; d|d
    assert made.inner([0, 2, 3], [1]) == ([0, 1], [])
    for a, b in (([1], [4]), ([0], [0]), ([1], [0]), ([4], [3, 3]), ([4, 4], [3]), ([0, 2], [])):
        assert made.inner(a, b) is None


def test_the_memory_of_transitions_may_run_out(aligner):
    small = alignment.Transducer(aligner.bytes_a, aligner.bytes_b, memory=3)
    for text in TEXTS:
        if aligner(text):
            assert small.inner(*aligner(text)[:2]) == aligner(text)[2:]


def test_linked_pairs_are_suffixes_of_each_other(aligner, spark, docs):
    counts = alignment.pair_counts(alignment.aligned(docs)).collect()
    assert counts and len(counts) <= alignment.linkable(aligner.bytes_a, aligner.bytes_b) < 1_000_000
    for r in counts:
        x, y = aligner.bytes_a[r.a], aligner.bytes_b[r.b]
        assert x.endswith(y) or y.endswith(x)
    assert alignment.linkable([b"ab", b"b", b"b"], [b"b", b"ab", b"cab"]) == 9


def test_query_equals_the_brute_force(spark, docs, aligner):
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_token_alignment"](spark, DATA).collect()}
    assert rows == brute(aligner, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark, aligner):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in alignment.linked(table).collect()} == brute(aligner, list(enumerate(TEXTS)))


def test_odd_rows(spark, odd, none):
    named = odd.withColumnsRenamed({"fp": "pairs", "source": "times"}).withColumn("row", odd.doc_id)
    found = alignment.linked(named).collect()
    assert len(found) == odd.count() and sum(r.n_a == 0 for r in found) == 3
    assert alignment.linked(none).count() == 0
    assert len({tuple(r) for r in found if r.doc_id == 1}) == 1
