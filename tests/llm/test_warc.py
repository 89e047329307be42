import base64
import hashlib
import struct

import pyarrow as pa
import pytest
import zstandard
from framewise.llm import warc


def test_round_trip_and_types(spark):
    big, other = "é" * 60, "x" * 5000
    rows = [(5, "http://a/", big), (2, "http://b/\r\nX: y", big), (9, None, big), (None, "u", big), (1, "v", "short"), (3, "w", "short"), (4, "q", None), (6, "q", ""), (7, "z", other), (7, "z", other), (8, "z", other)]
    rows += [(100 + i, f"http://h/{i}", f"<html>{i}" + "common body text " * 40) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, n long, digest string")
    out = sorted(map(tuple, warc.round_trip(df).collect()), key=repr)
    expect = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if len(data) >= 100 and same else page_id
        revisit = first is not None and first != page_id
        expect.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert out == sorted(expect, key=repr)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def _archive(records, dictionary=b""):
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=trained) if trained else zstandard.ZstdCompressor()
    return (warc.frame_of(dictionary) if dictionary else b"") + b"".join(map(c.compress, records))


def test_reader_streams_frames_with_and_without_dictionary():
    payloads = [b"page %d " % i * (1 + i % 50) for i in range(300)]
    records = [warc.record(i, "http://x", p, hashlib.sha256(p).hexdigest(), None, "2000-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    for dictionary in (b"", warc.train(records, 4096)):
        data = _archive(records, dictionary)
        for chunk in (7, 64, 1 << 20):
            assert list(warc.read_records(pa.BufferReader(data), chunk)) == records
        with pytest.raises(warc.WarcError):
            list(warc.read_records(pa.BufferReader(data[:-3])))
    assert warc.train(records, 4096)


@pytest.mark.parametrize(
    "old,new",
    [(b"WARC/1.1", b"WARC/7"), (b"WARC-Date", b"X-Date"), (b"Content-Length: ", b"Content-Length: 9"), (b"hello", b"hellO"), (b"WARC-Type:", b"WARC-Type"), (b"sha256:", b"sha1:")],
)
def test_validation(old, new):
    good = warc.record(1, "http://x", b"hello", hashlib.sha256(b"hello").hexdigest(), None, "2000-01-01T00:00:00Z")
    assert warc.page_facts(good)["page_id"] == 1
    with pytest.raises(warc.WarcError):
        warc.parse(good.replace(old, new))


def _record(kind, block, *more, content="application/http; msgtype=response", version="WARC/1.0"):
    head = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:12345678-9abc-4def-8123-456789abcdef>", "WARC-Date: 2020-02-03T04:05:06Z", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_of_other_writers():
    page = b"<html>hello</html>"
    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\nX-Long: a\r\n b\r\nContent-Length: 18\r\n\r\n" + page
    info = warc.parse(_record("warcinfo", b"software: x\r\n", content="application/warc-fields"))
    assert (info["record_type"], info["payload_bytes"], info["record_id"]) == ("warcinfo", None, "urn:uuid:12345678-9abc-4def-8123-456789abcdef")
    assert warc.parse(_record("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "WARC-Target-URI: <http://x/>"))["target"] == "http://x/"
    assert warc.parse(_record("metadata", b"", content="application/warc-fields"))["n_block"] == 0
    got = warc.parse(_record("response", http, f"WARC-Payload-Digest: {_sha1(page)}", f"WARC-Block-Digest: {_sha1(http)}"))
    assert got["payload_bytes"] == 18 and got["payload_digest"] == _sha1(page)
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n"
    assert warc.parse(_record("response", chunked, f"WARC-Payload-Digest: {_sha1(b'ab')}"))["payload_bytes"] == 12
    assert warc.parse(_record("resource", b"any", content="image/png"))["n_block"] == 3
    assert warc.parse(_record("response", b"20200203 dns", content="text/dns"))["payload_bytes"] is None
    revisit = _record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", f"WARC-Payload-Digest: {_sha1(page)}", "WARC-Refers-To-Target-URI: http://x/")
    assert warc.parse(revisit)["payload_bytes"] is None
    assert warc.parse(_record("response", http, "WARC-Payload-Digest: blake3:00"))["payload_bytes"] == 18
    for bad in (
        _record("response", http, f"WARC-Payload-Digest: {_sha1(b'other')}"),
        _record("response", http, f"WARC-Block-Digest: {_sha1(b'other')}"),
        _record("response", http + b"!"),
        _record("response", b"no http"),
        _record("revisit", b"HTTP/1.1 200 OK\r\n\r\n"),
        _record("revisit", http, f"WARC-Payload-Digest: {_sha1(page)}"),
        _record("response", http, "X\xff: y").replace(b"\xc3\xbf", b"\xff"),
    ):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_other_frames_and_limits():
    records = [_record("resource", b"x" * n, content="text/plain") for n in (5, 300_000, 0)]
    frames = [zstandard.ZstdCompressor().compress(r) for r in records]
    other = struct.pack("<II", warc.SKIPPABLE_MAGIC + 3, 70_000) + bytes(70_000)
    data = other + frames[0] + other + frames[1] + frames[2] + other
    for chunk in (5, 4096, 1 << 20):
        assert list(warc.read_records(pa.BufferReader(data), chunk)) == records
    for n in (4, 7, 20, len(other) + 3):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(pa.BufferReader(data[:n])))
    with pytest.raises(warc.WarcError, match="over"):
        list(warc.read_records(pa.BufferReader(data), most=200_000))
    swelling = zstandard.ZstdCompressor(level=19).compress(bytes(200_000_000))
    with pytest.raises(warc.WarcError, match="over"):
        list(warc.read_records(pa.BufferReader(swelling), most=1 << 20))
    assert list(warc.read_records(pa.BufferReader(b""))) == []


def test_long_pages_and_a_payload_that_most_share(spark):
    rows = [(i, f"http://h/{i}", "the same error page " * 10) for i in range(300)] + [(1000, "u", "é" * 2_000_000)]
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert out[0].record_type == "response" and all(out[i].refers_to == 0 for i in range(1, 300))
    assert out[1000].payload_bytes == 4_000_000


def test_archives_of_other_writers(spark, tmp_path):
    page = b"<html>hello</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 18\r\n\r\n" + page
    records = [_record("warcinfo", b"software: x\r\n", content="application/warc-fields"), _record("response", http, f"WARC-Payload-Digest: {_sha1(page)}", "WARC-Target-URI: http://x/"), _record("metadata", b"")]
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", warc.SKIPPABLE_MAGIC, 3) + b"any" + b"".join(zstandard.ZstdCompressor().compress(r) for r in records))
    (tmp_path / "b.warc.zst").write_bytes(b"")
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.zst", 1) for n in "ab"], "path string, n_records int")
    out = {r.record_type: r for r in warc.read_any(paths).collect()}
    assert set(out) == {"warcinfo", "response", "metadata"} and out["response"].payload_bytes == 18 and out["response"].target == "http://x/"


def test_written_files_are_plain_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "common body text " * 40) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    samples = warc.sample(df)
    manifest = warc.write_archives(warc.classify(df), warc.train(samples), f"file://{tmp_path}/w").collect()
    found = []
    for r in manifest:
        with open(r.path.removeprefix("file://"), "rb") as f:  # as any other reader would
            assert f.read(4) == struct.pack("<I", warc.SKIPPABLE_DICTIONARY_MAGIC)
            f.seek(0)
            found += [warc.page_facts(x)["page_id"] for x in warc.read_records(f)]
        assert r.n_bytes + len(warc.frame_of(warc.train(samples))) == (tmp_path / "w" / r.path.rsplit("/", 1)[-1]).stat().st_size
    assert sorted(found) == list(range(40))
