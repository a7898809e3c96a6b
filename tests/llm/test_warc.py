import hashlib
import io

import zstandard
from pyspark.sql import functions as F

from quern.llm import warc
from quern.llm.store import new_path


def round_trip(spark, df, payload=True):
    path = new_path(spark, "warc-test")
    manifest = warc.archived(warc.with_types(df), path)
    return warc.read_back(manifest, path, payload), manifest


def test_records_round_trip(spark):
    big, other = "<p>" + "same ü " * 40, "x" * 100
    rows = [(3, "http://a/\r\nb c", big), (1, None, big), (2, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", other), (7, "u", other), (8, "u", "x" * 99), (9, "u", "x" * 99), (None, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    out, manifest = round_trip(spark, df)
    got = out.collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    seen = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        first = min(same) if len(data) >= 100 and same else page
        want.append(str((page, len(data), hashlib.sha256(data).hexdigest(), "response" if first == page else "revisit", None if first == page else first)))
    assert seen == sorted(want)
    assert all((r.payload.decode() == next(h or "" for p, _, h in rows if p == r.page_id)) for r in got if r.record_type == "response" and r.page_id)
    assert next(r.url for r in got if r.page_id == 3) == "http://a/%0D%0Ab%20c"


def test_all_pages_come_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out, _ = round_trip(spark, pages)
    met = out.join(pages.withColumnRenamed("url", "was"), "page_id").where(F.col("payload") == F.col("html").cast("binary"))
    assert met.count() == pages.count()
    assert round_trip(spark, pages.limit(0))[0].count() == 0


def test_the_file_starts_with_its_dictionary_and_frames_stand_alone():
    records = [warc.record_bytes(k, "u", (f"<html>{k}" + "shared words of all pages " * 30).encode(), "response", None) for k in range(300)]
    out = io.BytesIO()
    assert warc.archive_of(iter(records), out) == 300
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    n = int.from_bytes(data[4:8], "little")
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompressobj()
    assert opened.decompress(data[8 + n :]) == records[0]
    assert list(warc.records_of(io.BytesIO(data))) == records
    assert len(data) < sum(map(len, records)) / 3


def test_a_changed_payload_is_an_error():
    record = warc.record_bytes(1, "u", b"payload" * 20, "response", None)
    assert warc.parsed(record)["payload_bytes"] == 140
    try:
        warc.parsed(record.replace(b"payloadpayload", b"paylaodpayload"))
    except ValueError:
        return
    raise AssertionError
