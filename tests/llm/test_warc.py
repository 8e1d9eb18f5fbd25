"""Archives: round trip, revisits, predicates, and archives of others."""

import base64
import gzip
import hashlib
import io

import pyarrow as pa
import pytest
from cases import rows
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull

from tallyframe.llm import warc
from tallyframe.session import scratch_path

PAGES = [
    (1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c/", ""),
    (5, "http://d/\r\nX: y", "x" * 3_000_000), (6, "http://e/", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://a/", "x" * 3_000_000),
    (8, "http://f/", "only"), (8, "http://f/", "only"), (None, "http://g/", "<p>é</p>"), (None, "http://h/", "alone"),
]


def pages(spark, given=PAGES):
    return spark.createDataFrame(given, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))


def want(least=0):
    first = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    count = {}
    for _, _, html in PAGES:
        count[html or ""] = count.get(html or "", 0) + 1
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        source = first.get(html or "") if count[html or ""] > 1 else i
        again = source is not None and source != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if again else "response", source if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, least):
    path = scratch_path(spark, "warc")
    warc.write_pages(pages(spark).repartition(3), path, least)
    archive = warc.read_archive(spark, path)
    assert rows(warc.page_digests(archive)) == want(least)
    texts = {(r["record_id"], bytes(r["payload"])) for r in archive.filter("record_type = 'response'").collect()}
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    responses = {(w[0], w[2]) for w in want(least) if w[3] == "response"}
    assert texts == {(f"urn:page:{'null' if i is None else i}", (h or "").encode()) for i, _, h in PAGES
                     if (i, sha(h)) in responses}


def test_predicates_reach_the_reader(spark):
    path = scratch_path(spark, "warc")
    warc.write_pages(pages(spark), path)
    got = warc.read_archive(spark, path).filter("record_type = 'revisit' and target_uri in ('http://b/', 'http://a/')")
    assert {r["record_id"] for r in got.collect()} == {"urn:page:2", "urn:page:7"}
    reader = warc.WarcReader(path, True)
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("http://b/",)), IsNotNull(("date",))]))
    assert [type(x) for x in left] == [IsNotNull]
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in found] == ["urn:page:2"]
    bare = warc.read_archive(spark, path, payload=False)
    assert bare.filter("payload is not null").count() == 0
    assert rows(bare.select("payload_bytes")) == sorted(((w[1],) for w in want()), key=str)


def test_unwanted_payloads_stay_packed():
    """Stepping over a record inflates its head only."""
    big = warc.member(warc.record_bytes(dict(record_type="response", record_id="a", target_uri="u", payload_digest="D",
                                             refers_to=None, payload=bytes(5_000_000)), "2020-01-01T00:00:00Z"))
    spoiled = big[:-2000] + b"\xff" * 2000  # would fail if inflated to the end
    file = io.BufferedReader(io.BytesIO(spoiled + big))
    kept = list(warc.records(file, len(spoiled + big), {"target_uri": {"other"}}))
    assert kept == []


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(packed):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: text/x\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    page = warc.record_bytes(dict(record_type="response", record_id="urn:page:1", target_uri="u", payload_digest="D",
                                  refers_to=None, payload=b"abc" * 100_000), "2020-01-01T00:00:00Z")
    parts = [info, page, info]
    data = b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts)
    got = list(warc.records(io.BufferedReader(io.BytesIO(data)), len(data)))
    assert [(r[0], r[-1]) for r in got] == [("warcinfo", b"hello"), ("response", b"abc" * 100_000), ("warcinfo", b"hello")]
    only = list(warc.records(io.BufferedReader(io.BytesIO(data)), len(data), {"record_type": {"warcinfo"}}))
    assert len(only) == 2
    with pytest.raises(ValueError):
        list(warc.records(io.BufferedReader(io.BytesIO(b"no archive")), 10))


def test_only_committed_files_count(spark):
    path = scratch_path(spark, "warc")
    writer = warc.WarcWriter(path, "2020-01-01T00:00:00Z", False)
    batch = warc.page_records(pages(spark)).toArrow().to_batches()
    lost, kept = writer.write(iter(batch)), writer.write(iter(batch))
    assert lost.names != kept.names
    writer.commit([kept])
    assert warc.read_archive(spark, path).count() == len(PAGES)


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_pages(pages(spark, []), path)
    assert warc.page_digests(warc.read_archive(spark, path)).count() == 0


def test_jobs_that_append_at_once_keep_each_other(spark):
    """Both have written their files before either commits."""
    path = f"file://{scratch_path(spark, 'warc')}"
    names = [x.split()[0] for x in warc.SCHEMA.split(", ") if not x.startswith("payload_bytes")]
    jobs = [warc.WarcWriter(path, "2020-01-01T00:00:00Z", False) for _ in range(2)]
    done = []
    for i, job in enumerate(jobs):
        row = dict.fromkeys(names) | {"record_type": "response", "record_id": f"urn:page:{i}", "payload_digest": "X", "payload": b"x"}
        done.append(job.write(iter([pa.RecordBatch.from_pylist([row], schema=pa.schema(
            [(n, pa.binary() if n == "payload" else pa.string()) for n in names]))])))
    jobs[0].commit([done[0]])
    jobs[1].commit([done[1]])
    assert sorted(r["record_id"] for r in warc.read_archive(spark, path).collect()) == ["urn:page:0", "urn:page:1"]
    third = warc.WarcWriter(path, "2020-01-01T00:00:00Z", False)
    third.abort([])
    assert warc.read_archive(spark, path).count() == 2
    assert len(warc.WarcReader(path, True, 8).partitions()) == 2  # small files, but enough tasks for both
