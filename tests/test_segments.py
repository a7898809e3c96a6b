"""A stored base after changes against one built anew from the same documents."""

import random
from pathlib import Path

import pytest

from quern.operators import retrieval
from quern.operators.segments import StoredIndex
from quern.sources import shared

SCHEMA = "doc_id string, doc_no long, tenant_id string, kb_type string, title string, content string"


def frame(spark, docs):
    return spark.createDataFrame([(d, int(d[1:]), *rest) for d, rest in docs.items()], SCHEMA)


def state(index):
    idf = {(r.kb_type, r.token): round(r.idf, 9) for r in index.idf.collect()}
    return sorted(map(tuple, index.chunks.select("chunk_id", "tenant_id", "kb_type", "text").collect())), sorted(map(tuple, index.postings.select("chunk_id", "token", "weight").collect())), idf


def files(path, name, *parts):
    return {str(p) for p in Path(path.removeprefix("file:")).glob(f"{name}/**/*.parquet") if all(x in str(p) for x in parts)}


def test_changes_equal_a_rebuild_and_touch_what_they_change(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "epsilon", "zeta")) for _ in range(rng.randint(3, 60)))
    docs = {f"D{k}": (f"T{k % 3}", ("policy", "sop")[k % 2], "t", sentence() if k % 4 else "the same words in several documents") for k in range(30)}
    path = shared.new_path(spark, "stored")
    index, versions = StoredIndex.created(frame(spark, docs), path), []
    for step in range(3):
        new = {f"D{k}": (docs.get(f"D{k}", (f"T{k % 3}", ""))[0], ("policy", "sop")[k % 2], "t", "the same words in several documents" if k % 2 else sentence()) for k in range(step, 34, 7)}
        gone = {d: docs[d] for d in (f"D{k}" for k in range(step * 4, 30, 9)) if d in docs and d not in new}
        index = index.changed(frame(spark, new), frame(spark, gone) if gone else None)
        docs = {d: v for d, v in (docs | new).items() if d not in gone}
        assert state(index) == state(retrieval.Index(retrieval.chunked(frame(spark, docs), "fixed")))
        versions.append(index.version)
    assert versions == [1, 2, 3]
    assert state(StoredIndex(spark.newSession(), path)) == state(index)
    small = index.compacted(shared.new_path(spark, "compacted"))
    assert state(small) == state(index) and small.segments == [0]


def test_other_tenants_files_stay(spark):
    docs = {f"D{k}": (f"T{k % 2}", "policy", "t", f"words of document {k} here") for k in range(10)}
    path = shared.new_path(spark, "stored")
    index = StoredIndex.created(frame(spark, docs), path)
    before = {n: files(path, n) for n in ("chunks", "postings", "pieces")}
    index.changed(frame(spark, {"D2": ("T0", "policy", "t", "other words")}), frame(spark, {"D4": docs["D4"]}))
    for n, old in before.items():
        now = files(path, n)
        assert old <= now and now - old and all("tenant_id=T0" in f for f in now - old)


def test_deleting_the_first_of_equal_chunks_brings_back_the_next(spark):
    docs = {"D1": ("T", "sop", "t", "equal text"), "D2": ("T", "sop", "t", "equal text"), "D3": ("T", "sop", "t", "other")}
    index = StoredIndex.created(frame(spark, docs), shared.new_path(spark, "stored"))
    chunks = lambda i: sorted(r.chunk_id for r in i.chunks.collect())
    assert chunks(index) == ["D1#000", "D3#000"]
    after = index.changed(deleted=frame(spark, {"D1": docs["D1"]}))
    assert chunks(after) == ["D2#000", "D3#000"] and chunks(index) == ["D1#000", "D3#000"]
    assert [r.chunk_id for r in after.of_document("D2", "T").collect()] == ["D2#000"] and after.of_document("D2", "other").count() == 0
    found = retrieval.channels(spark.createDataFrame([(1, "equal", "T")], "query_id int, query string, tenant_id string"), after, modes=("sparse",))["sparse"]
    assert [r.chunk_id for r in found.collect()] == ["D2#000"]


def test_refused_changes_publish_nothing(spark):
    docs = {"D1": ("T", "sop", "t", "text")}
    path = shared.new_path(spark, "stored")
    index = StoredIndex.created(frame(spark, docs), path)
    with pytest.raises(PermissionError):
        index.changed(frame(spark, {"D1": ("U", "sop", "t", "text")}))
    with pytest.raises(PermissionError):
        index.changed(deleted=frame(spark, {"D1": ("U", "sop", "t", "text")}))
    with pytest.raises(ValueError):
        index.changed(frame(spark, {"D9": ("T", "sop", "t", " ")}))
    assert StoredIndex(spark, path).version == 0


def test_a_change_that_fails_midway_is_not_seen(spark, monkeypatch):
    from quern.operators import segments

    docs = {"D1": ("T", "sop", "t", "text"), "D2": ("T", "sop", "t", "more text")}
    path = shared.new_path(spark, "stored")
    index = StoredIndex.created(frame(spark, docs), path)

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(segments, "_published", fails)
    with pytest.raises(OSError):
        index.changed(deleted=frame(spark, {"D1": docs["D1"]}))
    again = StoredIndex(spark, path)
    assert again.version == 0 and sorted(r.chunk_id for r in again.chunks.collect()) == ["D1#000", "D2#000"]
    monkeypatch.undo()
    once_more = again.changed(deleted=frame(spark, {"D2": docs["D2"]}))
    assert sorted(r.chunk_id for r in once_more.chunks.collect()) == ["D1#000"]
