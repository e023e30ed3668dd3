"""Round trips, revisits and every kind of damage."""

import struct

import pytest
import zstandard

from stemweave.llm import warc as W


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


BIG = "<html>" + "é payload " * 40 + "</html>"


def test_round_trip_and_revisits(spark):
    rows = [(3, "http://a", BIG, "x"), (1, "http://b\r\nX: y", BIG, "x"), (2, None, "short", None), (4, "u", "short", None), (5, "u", None, None), (6, "u", "", None), (7, "u", "z" * 5_000_000, None), (8, "u", BIG + "2", None), (None, "u", BIG, None)]
    pages = make(spark, rows)
    archives = W.write_archives(pages, W.train_dictionary(pages))
    got = {r.page_id: r for r in W.read_archives(archives).collect()}
    assert len(got) == len(rows)
    assert (got[1].record_type, got[1].refers_to, got[1].payload.decode()) == ("response", None, BIG)
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes, got[3].payload_digest) == ("revisit", 1, len(BIG.encode()), got[1].payload_digest)
    assert got[None].refers_to == 1 and got[2].record_type == got[4].record_type == "response"
    assert got[5].payload_bytes == 0 and got[6].payload_digest == got[5].payload_digest and got[7].payload_bytes == 5_000_000
    assert W.read_archives(W.write_archives(make(spark, []))).count() == 0


def test_dictionary_frame_and_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><title>{i}</title><p>" + "common text of every page " * 20 + str(i * 7919), None) for i in range(200)]
    pages = make(spark, rows)
    d = W.train_dictionary(pages, size=4096)
    assert d
    content = W.write_archives(pages.coalesce(1), d).first().content
    magic, n = struct.unpack_from("<II", content)
    assert magic == W.DICTIONARY_MAGIC and content[8 : 8 + n] == d
    records = list(W.read_archive(bytes(content)))
    assert len(records) == 200
    packed = W.archive_head(zstandard.ZstdCompressor().compress(d)) + bytes(content[8 + n :])  # a compressed dictionary
    (tmp_path / "a.warc.zst").write_bytes(packed)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.page_id for r in W.read_archives(files).collect()} == set(range(200))


def test_damage_is_found(spark):
    import hashlib

    ok = W.write_record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert W.parse_record(ok)["payload"] == b"hello"
    for bad in (ok[:-2], ok.replace(b"Content-Length: 5", b"Content-Length: 6"), ok.replace(b"WARC/1.1", b"HTTP/1.1"), ok.replace(b"hello", b"jello"), ok.replace(b"WARC-Date", b"X-Date"), ok.replace(b"Content-Length: 5", b"Content-Length: x")):
        with pytest.raises(ValueError):
            W.parse_record(bad)
    z = zstandard.ZstdCompressor(write_checksum=True)
    good = z.compress(ok)
    broken = good[:-6] + bytes([good[-6] ^ 1]) + good[-5:]
    df = spark.createDataFrame([(good + z.compress(ok[:-2]) + good,), (good + broken,), (good[:-3],), (b"",), (None,)], "content binary")
    got = W.read_archives(df, strict=False).collect()
    assert sum(r.error is None for r in got) == 3 and sum(r.error is not None for r in got) == 3


def test_dates_of_records(spark):
    import datetime

    rows = [(1, "u", "a" * 200, datetime.datetime(2021, 3, 4, 5, 6, 7)), (2, "u", "b" * 200, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, seen timestamp")
    content = W.write_archives(pages.coalesce(1), date_col="seen").first().content
    heads = sorted(r.split(b"WARC-Date: ")[1][:20] for r in W.read_archive(bytes(content)))
    assert heads == [b"2021-03-04T05:06:07Z", b"2024-01-01T00:00:00Z"]


def test_a_payload_of_very_many_pages(spark, monkeypatch):
    from stemweave.llm import common

    monkeypatch.setattr(common, "SMALL_ROWS", 1)
    rows = [(i, "u", BIG if i % 3 else f"{BIG}{i % 9}", None) for i in range(1, 400)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in W.read_archives(W.write_archives(make(spark, rows))).collect()}
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h, i)
    assert got == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h, _ in rows}
