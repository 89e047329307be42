"""Zstandard web archives (.warc.zst): one frame per record, the dictionary in a leading skippable frame.

Writing deals the pages over archives in the shared folder; the manifest, itself a committed table, names the archives
of the tasks that succeeded, so that a repeated task leaves no second copy of its records. Reading streams frame by
frame: an archive is never held whole, only one record is, and none over a given size.

`parse` validates any WARC/1.0 or 1.1 record: version, header lines, the mandatory headers, the length, block and payload
digests (sha1, sha256 or md5, in hex or base32) where they are given, and what a revisit must name. Records of all
types pass; further skippable frames are left out. `read_archives` reads the archives of `write_archives`.

Defined results: a null payload is empty; payloads under MIN_REVISIT bytes are always responses; of equal larger
payloads the smallest page_id is the response, and rows that repeat that very page_id are responses too; a null page_id
revisits a numbered one, and among only null ids all are responses; a null url gives the record's own urn as target; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, materialize, scratch_path, slices, table

#: Payloads shorter than this are stored again rather than revisited.
MIN_REVISIT = 100
#: Pages whose records train the dictionary, bytes taken of each at most, and bytes of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 16_384, 65_536
#: An archive is closed once it has so many bytes; a record or dictionary that unpacks to more than so many is refused.
ARCHIVE_BYTES, RECORD_BYTES = 64 << 20, 1 << 30
#: Compressed bytes that are unpacked at once.
BITE = 1 << 12

#: Fixed values of the zstd and WARC formats.
SKIPPABLE_MAGIC, SKIPPABLE_DICTIONARY_MAGIC = 0x184D2A50, 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGESTS = ("sha1", "sha256", "md5")
REQUIRED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone; its Content-Length is the full payload's."""
    name = f"urn:page:{'none' if page_id is None else page_id}"
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[str]) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with a blank continues the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        key, colon, value = line.partition(":")
        if not colon or not key.strip() or key != key.strip():
            raise WarcError(f"bad header line: {line[:80]!r}")
        last = key.lower()
        out[last] = value.strip()
    return out


def _matches(labelled: str, data: bytes) -> bool:
    """Whether a digest such as sha1:BASE32 or sha256:hex is that of the data; one of an unknown kind is not judged."""
    algorithm, _, value = labelled.partition(":")
    if algorithm.lower() not in DIGESTS:
        return True
    raw = hashlib.new(algorithm.lower(), data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parse(data: bytes) -> dict:
    """The record's facts, after validation: record_id, record_type, date, target, refers_to, n_block, headers, and of
    HTTP responses and revisits payload_bytes (null where a revisit does not tell it) and payload_digest."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("the headers are no UTF-8") from e
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC version: {lines[0][:40]!r}")
    headers = _headers(lines[1:])
    if missing := [h for h in REQUIRED if h.lower() not in headers]:
        raise WarcError(f"missing headers: {', '.join(missing)}")
    if not (headers["content-length"].isascii() and headers["content-length"].isdigit()):
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}; the frame holds {len(rest) - 4} bytes and its end")
    block, kind = rest[:n], headers["warc-type"]
    if "warc-block-digest" in headers and not _matches(headers["warc-block-digest"], block):
        raise WarcError("the block differs from its digest")
    unwrapped = lambda name: headers[name].removeprefix("<").removesuffix(">") if name in headers else None
    facts = {"record_id": unwrapped("warc-record-id"), "record_type": kind, "date": headers["warc-date"], "target": unwrapped("warc-target-uri"), "refers_to": unwrapped("warc-refers-to"), "n_block": n, "headers": headers, "payload_bytes": None, "payload_digest": headers.get("warc-payload-digest")}
    if kind == "revisit" and not {"warc-refers-to", "warc-refers-to-target-uri", "warc-payload-digest"} & set(headers):
        raise WarcError("a revisit that names neither a record, a target nor a digest")
    if kind not in ("response", "revisit") or not headers.get("content-type", "").lower().startswith("application/http"):
        return facts
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not http.startswith(b"HTTP/") or not sep:
        raise WarcError("the block is no HTTP message")
    fields = _headers(http.decode("latin-1").split("\r\n")[1:])
    length = fields.get("content-length", "")
    full = int(length) if length.isascii() and length.isdigit() else None
    if kind == "revisit":
        if payload:
            raise WarcError("a revisit with a payload")
        return facts | {"payload_bytes": full}
    if "transfer-encoding" not in fields and full not in (None, len(payload)) and headers.get("warc-truncated") is None:
        raise WarcError(f"the payload has {len(payload)} bytes; its length is {full}")
    if "warc-payload-digest" in headers and "transfer-encoding" not in fields and not _matches(headers["warc-payload-digest"], payload):
        raise WarcError("the payload differs from its digest")
    return facts | {"payload_bytes": len(payload)}


def page_facts(data: bytes) -> dict:
    """The columns of a record that `record` made."""
    facts = parse(data)
    number = lambda urn: None if urn in (None, "urn:page:none") else int(urn.removeprefix("urn:page:"))
    algorithm, _, digest = (facts["payload_digest"] or "").partition(":")
    if algorithm != "sha256" or facts["payload_bytes"] is None:
        raise WarcError("no sha256 payload digest, or no length of the payload")
    return {"page_id": number(facts["record_id"]), "payload_bytes": facts["payload_bytes"], "payload_digest": digest, "record_type": facts["record_type"], "refers_to": number(facts["refers_to"])}


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or b"" where there are too few samples to train one."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8_192:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def frame_of(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary in it is itself compressed."""
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_DICTIONARY_MAGIC, len(packed)) + packed


def _exactly(stream, n: int, what: str) -> bytes:
    parts, held = [], 0
    while held < n:
        part = stream.read(n - held)
        if not part:
            raise WarcError(f"{what} is cut short")
        parts.append(part)
        held += len(part)
    return b"".join(parts)


def read_records(stream, chunk: int = 1 << 16, most: int = RECORD_BYTES) -> Iterator[bytes]:
    """The records of an open archive, each from a frame of its own and of at most so many bytes."""
    dictionary, buffer, first = None, b"", True
    decompressor = zstandard.ZstdDecompressor()
    while True:
        while len(buffer) < 8:
            part = stream.read(chunk)
            if not part:
                break
            buffer += part
        if not buffer:
            return
        magic = struct.unpack("<I", buffer[:4])[0] if len(buffer) >= 4 else 0
        if SKIPPABLE_MAGIC <= magic < SKIPPABLE_MAGIC + 16:
            if len(buffer) < 8:
                raise WarcError("a skippable frame is cut short")
            length = struct.unpack("<I", buffer[4:8])[0]
            raw, buffer = buffer[8 : 8 + length], buffer[8 + length :]
            if len(raw) < length:
                if magic == SKIPPABLE_DICTIONARY_MAGIC and length > most:
                    raise WarcError(f"the dictionary frame has over {most} bytes")
                raw += _exactly(stream, length - len(raw), "a skippable frame")
            if first and magic == SKIPPABLE_DICTIONARY_MAGIC:
                if raw[:4] == ZSTD_MAGIC:
                    raw = _unpacked(zstandard.ZstdDecompressor(), raw, most)
                dictionary = zstandard.ZstdCompressionDict(raw)
                decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
            first = False
            continue
        first = False
        frame, parts, size = decompressor.decompressobj(), [], 0
        while not frame.eof:
            try:
                # small bites, so that a frame that swells is noticed before much of it is held
                parts.append(frame.decompress(buffer[:BITE]))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            size += len(parts[-1])
            if size > most:
                raise WarcError(f"a record has over {most} bytes")
            buffer = (frame.unused_data if frame.eof else b"") + buffer[BITE:]
            if not frame.eof and not buffer:
                buffer = stream.read(chunk)
                if not buffer:
                    raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def _unpacked(decompressor: zstandard.ZstdDecompressor, data: bytes, most: int) -> bytes:
    try:
        return decompressor.decompress(data, max_output_size=most)
    except zstandard.ZstdError as e:
        raise WarcError(f"bad dictionary frame: {e}") from e


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri.removeprefix("file:"))


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to of each page.

    Copies are found from ids and digests alone. The pages themselves are shuffled once, by id and digest, to meet what
    they refer to: a payload that many pages share is dealt like any other.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    known = materialize(base.filter(F.length("html") >= MIN_REVISIT).select("page_id", "digest"), "digests")
    first = known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL")
    copies = known.join(first.select("digest", F.col("first_id").cast("long").alias("refers_to")), "digest").filter("NOT page_id <=> refers_to")
    copies = copies.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "refers_to").distinct()
    met = base.join(copies, base["page_id"].eqNullSafe(copies["id"]) & (base["digest"] == copies["of"]), "left")
    return met.select("page_id", "url", "html", "digest", "refers_to")


def sample(pages: DataFrame, rows: int = SAMPLE_PAGES, most: int = SAMPLE_BYTES) -> list[bytes]:
    """The first bytes of a fixed, bounded choice of pages, for the dictionary alone."""
    ids = pages.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    ids = sorted({r[0] for r in ids.collect()})
    if not ids:
        return []
    part = F.substring(F.col("html").cast("binary"), 1, most).alias("part")
    rows_ = pages.filter(F.col("page_id").isin(ids) & F.col("html").isNotNull()).select("page_id", part).limit(2 * rows).collect()
    return [bytes(r.part) for r in sorted(rows_, key=lambda r: (r.page_id, bytes(r.part)))]


def write_archives(classified: DataFrame, dictionary: bytes, folder: str, date: str = "2000-01-01T00:00:00Z", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write .warc.zst archives into folder (a URI); returns the manifest: path, n_records, n_bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        options = {"level": 3, "write_content_size": True, "write_checksum": True}
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if trained:
            trained.precompute_compress(level=3)
        compressor = zstandard.ZstdCompressor(dict_data=trained, **options) if trained else zstandard.ZstdCompressor(**options)
        out, path, records, size, done = None, "", 0, 0, []
        for batch in slices(batches, 100):
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out, records, size = fs.open_output_stream(path, compression=None), 0, 0
                    if dictionary:
                        out.write(frame_of(dictionary))
                frame = compressor.compress(record(page_id, url, html, digest, refers_to, date))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= most:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
        yield pa.RecordBatch.from_pydict({"path": [prefix + p for p, _, _ in done], "n_records": pa.array([n for _, n, _ in done], pa.int64()), "n_bytes": pa.array([n for _, _, n in done], pa.int64())}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return materialize(mapped(classified, write, "path string, n_records long, n_bytes long"), "warc-manifest")


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORDS = "path string, record_id string, record_type string, date string, target string, refers_to string, n_block long, payload_bytes long, payload_digest string"


def _read(archives: DataFrame, facts: Callable[[bytes], dict], schema: str, tasks: int | None) -> DataFrame:
    """A row per record of the archives: path and n_records, which is checked unless it is null."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _open(path)
                rows, n = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for data in read_records(stream):
                        rows.append({"path": path, **facts(data)})
                        n += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                if expected is not None and n != expected:
                    raise WarcError(f"{path}: {n} records; the manifest has {expected}")
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    spark = archives.sparkSession
    dealt = archives.select("path", "n_records").repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path"))
    return mapped(dealt, read, schema)


def read_archives(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """The validated page records of the archives named in the manifest of write_archives."""
    return _read(manifest, page_facts, _PAGES, tasks)


def read_any(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """The validated records, of every type, of archives by any writer. paths: path."""
    return _read(paths.select("path", F.lit(None).cast("long").alias("n_records")), parse, _RECORDS, tasks)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read those, and return a row per record."""
    dictionary = train(sample(pages))
    manifest = write_archives(classify(pages), dictionary, scratch_path(pages.sparkSession, "warc"))
    return read_archives(manifest)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""
