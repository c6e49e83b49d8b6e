"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

``write_archives`` turns page rows into such archives in the shared folder; ``read_archives`` reads any of them back as a
stream of records, checking frames, headers, lengths and digests. Both hold one record at a time.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import release_memory, stored
from auditloom.session import scratch_path

# Fixed values of the two formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

RECORD = (
    "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
    "payload string, archive string, problem string"
)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


class ArchiveError(ValueError):
    """The archive is not a sequence of frames as described above."""


def train(samples: list[bytes], size: int = 64 * 1024) -> bytes:
    """A dictionary of ``size`` bytes at most; too few samples give their content as it is."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return (VERSION + b"\r\nWARC-Type: response\r\n" + b"".join(samples))[:size]


def dictionary_frame(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """One record from one decoded frame; ArchiveError names what is wrong with it."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] != VERSION:
        raise ArchiveError("no record header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(": ")
        if not colon or not name:
            raise ArchiveError("malformed header line")
        headers[name] = value
    missing = [name for name in REQUIRED if name not in headers]
    if missing:
        raise ArchiveError(f"missing {missing[0]}")
    length = headers["Content-Length"]
    if not (length.isascii() and length.isdigit()) or int(length) + 4 != len(rest) or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError("length differs from Content-Length")
    return Record(headers, rest[:-4])


def read_frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an archive, one at a time, from any object with ``read``."""

    def need(buffer: bytes, size: int) -> bytes:
        while len(buffer) < size:
            more = stream.read(chunk)
            if not more:
                raise ArchiveError("archive ends inside a frame")
            buffer += bytes(more)
        return buffer

    head = need(b"", 8)
    magic, size = struct.unpack_from("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ArchiveError("no leading dictionary frame")
    head = need(head, 8 + size)
    content, rest = head[8 : 8 + size], head[8 + size :]
    if content[:4] == struct.pack("<I", ZSTD_MAGIC):  # a dictionary may be stored compressed
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    while True:
        rest = rest or bytes(stream.read(chunk))
        if not rest:
            return
        rest = need(rest, 4)
        if struct.unpack_from("<I", rest)[0] != ZSTD_MAGIC:
            raise ArchiveError("unknown frame")
        frame, parts = decoder.decompressobj(), []
        try:
            parts.append(frame.decompress(rest))
            while not frame.eof:
                more = bytes(stream.read(chunk))
                if not more:
                    raise ArchiveError("archive ends inside a frame")
                parts.append(frame.decompress(more))
        except zstandard.ZstdError as error:
            raise ArchiveError(f"frame cannot be decoded: {error}") from error
        rest = frame.unused_data
        yield b"".join(parts)


def _clean(url: str | None) -> str:
    """A target that fits one header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url) if url else "urn:unknown"


def page_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit that keeps the payload's digest and length only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return encode_record(headers, http if refers_to is not None else http + payload)


def parse_page(data: bytes, payloads: bool) -> tuple:
    """The fields of RECORD but archive, from one decoded frame; a bad record has only its problem."""
    try:
        record = decode_record(data)
        h = record.headers
        kind = h["WARC-Type"]
        if kind not in ("response", "revisit"):
            raise ArchiveError("unknown WARC-Type")
        http, blank, payload = record.block.partition(b"\r\n\r\n")
        if not blank or not http.startswith(b"HTTP/"):
            raise ArchiveError("no HTTP header")
        fields = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:])
        size, digest = int(fields["Content-Length"]), h.get("WARC-Payload-Digest", "")
        if not digest.startswith("sha256:"):
            raise ArchiveError("no payload digest")
        refers = None
        if kind == "response":
            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest[7:]:
                raise ArchiveError("payload differs from its length or digest")
        else:
            if payload or not h.get("WARC-Refers-To", "").startswith("<urn:page:"):
                raise ArchiveError("malformed revisit")
            refers = h["WARC-Refers-To"][10:-1]
        page = h["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">") or None
        url = h.get("WARC-Target-URI")
        text = payload.decode("utf-8", "replace") if payloads and kind == "response" else None
        return page, None if url == "urn:unknown" else url, kind, refers, size, digest[7:], text, None
    except (ArchiveError, KeyError, ValueError) as error:
        return None, None, None, None, None, None, None, f"{type(error).__name__}: {error}"


def write_archives(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 100,
    archive_bytes: int = 64 << 20,
    dict_samples: int = 400,
    level: int = 3,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per page to archives in the shared folder; returns their manifest (path, records, bytes).

    Of pages with equal payloads of at least ``min_revisit_bytes``, those with the smallest id are responses and the others
    revisits of it; all else are responses. A null payload is empty; a null id or url is left out of the record. Rows that
    repeat the smallest id are responses too. A page with a null id revisits if any equal page has an id. Other columns are
    ignored. The dictionary is trained on ``dict_samples`` different pages chosen by hash; an empty table gives no archive.

    A task that is run again writes files of new names; the manifest lists only those of the attempts that counted.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2(F.col("payload").cast("binary"), 256)
    )
    firsts = (
        rows.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("_digest"), "first")
    )
    planned = rows.join(firsts, F.col("digest") == F.col("_digest"), "left").select(
        F.col("id").cast("string").alias("id"),
        "url",
        "payload",
        "digest",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers_to"),
    )
    # hashes first: no more than ``dict_samples`` different payloads are cut, and copies of one are cut once
    least = rows.select(F.xxhash64("payload").alias("h")).distinct().orderBy("h").limit(dict_samples).collect()
    chosen = rows.select(F.xxhash64("payload").alias("h"), F.substring("payload", 1, 8192).alias("p")).filter(F.col("h").isin([r["h"] for r in least]))
    samples = chosen.groupBy("h").agg(F.min("p").alias("p")).orderBy("h")
    content = train([r["p"].encode("utf-8", "surrogatepass") for r in samples.collect()])
    folder = scratch_path(spark, "warc")

    def write(batches):
        words = zstandard.ZstdCompressionDict(content)
        words.precompute_compress(level=level)
        coder = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True, write_content_size=True)
        out, path, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, text, digest, refers in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    store, where = pyarrow.fs.FileSystem.from_uri(folder)
                    store.create_dir(where, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{where}/{name}")
                    count, size = 0, out.write(dictionary_frame(content))
                frame = coder.compress(
                    page_record(page.as_py(), url.as_py(), text.as_buffer().to_pybytes(), digest.as_py(), refers.as_py(), date)
                )
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        coder = words = None
        release_memory()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return stored(planned.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``manifest`` (a ``path`` column), as RECORD; streamed, one archive a task at a time.

    A record with a bad header, length or digest gives a row with only ``archive`` and ``problem``; an archive that breaks
    off gives such a row for its rest. ``payloads=False`` checks payloads but leaves them out.
    """
    paths = manifest.select("path").filter("path IS NOT NULL")
    tasks = max(1, min(paths.count(), 20_000))

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                store, where = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_stream(where) as stream:
                    try:
                        for frame in read_frames(stream):
                            *fields, problem = parse_page(frame, payloads)
                            rows.append((*fields, path, problem))
                            held += len(frame) if payloads else 500
                            if held > 8 << 20:
                                yield _records(rows)
                                rows, held = [], 0
                    except ArchiveError as error:
                        rows.append((*[None] * 7, path, f"ArchiveError: {error}"))
                if rows:
                    yield _records(rows)
                release_memory()

    return paths.repartition(tasks, F.xxhash64("path")).mapInArrow(read, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if name == "payload_bytes" else pa.string() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
