import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from auditloom.llm import warc_zstd as wz


def test_pages_round_trip_and_the_smallest_id_responds(spark):
    long = "<p>é" * 60
    rows = [(4, "http://a/", long), (2, "http://b/ c", long), (2, "http://b/ c", long), (9, None, None), (8, "u", ""), (7, "v", "short"), (6, "v", "short"), (None, "n", long), (11, "x", "y" * 3_000_000), (12, "z\r\nWARC-Type: x", "\0\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as payload", "4 as id")
    manifest = wz.write_archives(pages, archive_bytes=2000)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = sorted(wz.read_archives(spark, manifest).collect(), key=lambda r: (str(r["page_id"]), str(r["url"])))
    assert len(got) == len(rows) and not any(r["problem"] for r in got)
    for r in got:
        source = [(u, h or "") for i, u, h in rows if str(i) == str(r["page_id"])][0]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(source[1].encode()), hashlib.sha256(source[1].encode()).hexdigest())
        assert r["payload"] == (source[1] if r["record_type"] == "response" else None)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["record_type"] == "revisit")
    assert kinds == [("4", "revisit", "2"), ("None", "revisit", "2")]
    empty = wz.write_archives(pages.limit(0))
    assert empty.count() == 0 and wz.read_archives(spark, empty).count() == 0


def archive(records, dictionary=b"", tail=b""):
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return io.BytesIO(wz.dictionary_frame(dictionary) + b"".join(map(coder.compress, records)) + tail)


GOOD = wz.page_record("1", "u", b"<p>body</p>", hashlib.sha256(b"<p>body</p>").hexdigest(), None, "2024-01-01T00:00:00Z")


def test_frames_are_read_in_small_chunks_with_plain_and_compressed_dictionaries():
    words = wz.train([b"WARC/1.1 some header line %d and body" % i for i in range(500)], 2000)
    assert list(wz.read_frames(archive([GOOD, b"x" * 5000, GOOD], words), chunk=7)) == [GOOD, b"x" * 5000, GOOD]
    packed = archive([GOOD], words).getvalue()[8 + len(words) :]
    frame = zstandard.ZstdCompressor().compress(words)
    assert list(wz.read_frames(io.BytesIO(wz.dictionary_frame(frame) + packed))) == [GOOD]


def test_broken_archives_are_told():
    whole = archive([GOOD, GOOD]).getvalue()
    for data in (whole[:-3], whole[:5], whole + b"junk!", b"PK" + whole, struct.pack("<II", 0x184D2A50, 0) + whole[8:]):
        with pytest.raises(wz.ArchiveError):
            list(wz.read_frames(io.BytesIO(data)))
    flipped = bytearray(whole)
    flipped[20] ^= 0xFF
    with pytest.raises(wz.ArchiveError):
        list(wz.read_frames(io.BytesIO(bytes(flipped)))) and wz.decode_record(next(wz.read_frames(io.BytesIO(bytes(flipped)))))


@pytest.mark.parametrize(
    "record",
    [
        GOOD[:-1],
        GOOD.replace(b"<p>body", b"<p>bodi"),
        GOOD.replace(b"WARC/1.1", b"WARC/9"),
        GOOD.replace(b"WARC-Date: ", b"Some-Date: "),
        GOOD.replace(b"WARC-Type: response", b"WARC-Type: metadata"),
        GOOD.replace(b"Content-Length: 11", b"Content-Length: 12"),
        GOOD + b"more",
        b"",
    ],
)
def test_bad_records_are_told(record):
    assert wz.parse_page(record, True)[-1] and wz.parse_page(GOOD, True)[-1] is None
