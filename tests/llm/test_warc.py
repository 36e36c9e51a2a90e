import base64
import hashlib
import io
import struct

import pytest
import zstandard
from inkspan.llm import warc


def archive(records):
    out = io.BytesIO()
    assert warc.write_archive(iter(records), out) == len(records)
    return out.getvalue()


RECORDS = [warc.record(i, f"http://x.example/{i}?é x\n", (b"<p>page %d</p>" % i) * i, None if i % 3 else 7) for i in range(60)]


def test_round_trip_with_plain_and_packed_dictionary():
    data = archive(RECORDS)
    magic, n = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + n])
    other = struct.pack("<II", magic, len(packed)) + packed + data[8 + n :]
    for x in (data, other):
        got = list(warc.read_archive(io.BytesIO(x)))
        assert [warc._page(r.headers["warc-record-id"]) for r in got] == list(range(60))
        assert [r.type for r in got] == ["response" if i % 3 else "revisit" for i in range(60)]
        assert all(r.http[1] == (b"<p>page %d</p>" % i) * i for i, r in enumerate(got) if i % 3)
        assert all(int(r.http[0]["content-length"]) == len(b"<p>page %d</p>" % i) * i for i, r in enumerate(got))


def test_small_reads_cross_frame_ends(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    assert len(list(warc.read_archive(io.BytesIO(archive(RECORDS[:9]))))) == 9


@pytest.mark.parametrize("spoil", ["cut", "no dictionary", "frame", "length", "version", "header", "digest"])
def test_bad_archives_are_refused(spoil):
    data = archive(RECORDS)
    if spoil == "cut":
        data = data[:-5]
    elif spoil == "no dictionary":
        data = data[8 + struct.unpack("<I", data[4:8])[0] :]
    elif spoil == "frame":
        data = data + b"junk that is no frame"
    else:
        r = RECORDS[4]
        r = {"length": r.replace(b"Content-Length: ", b"Content-Length: 1", 1), "version": r.replace(b"WARC/1.1", b"WARC/7.7"), "header": r.replace(b"WARC-Date", b"X-Date"), "digest": r.replace(b"page", b"gape")}[spoil]
        data = archive([r])
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(io.BytesIO(data)))


def test_query_equals_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").limit(60)
    own = [(10**6 + i, "http://y.example/", t) for i, t in enumerate([None, "", "", "same", "same", "é", "same", None])]
    own += [(None, None, "no id"), (None, None, "no id"), (None, "u", "same")]
    extra = spark.createDataFrame(own, pages.schema)
    rows = pages.union(extra)
    first = {}
    for r in rows.collect():
        t = r.html or ""
        first[t] = max((x for x in (first.get(t), r.page_id) if x is not None), default=None)
    want = []
    for r in rows.collect():
        body = (r.html or "").encode()
        refers = first[r.html or ""] if first[r.html or ""] != r.page_id else None
        want.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers))
    key = lambda x: tuple(str(v) for v in x)
    got = [tuple(r) for r in warc.op9(rows.repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_least_size_archive_size_and_empty(spark):
    rows = spark.createDataFrame([(i, "u", "ab" if i % 2 else "abc" * 50) for i in range(40)], "page_id long, url string, html string")
    got = warc.with_references(rows, least=3).where("refers_to is not null").count()
    assert got == 19
    from inkspan.llm.common import delete_path, scratch_path

    folder = scratch_path(spark, "test-warc")
    archives = warc.write(warc.with_references(rows).coalesce(1), folder, archive_bytes=2000)
    assert archives.count() > 3 and warc.read(archives, folder).count() == 40
    delete_path(spark, folder)
    assert warc.op9(rows.limit(0)).count() == 0
