import base64
import hashlib
import io
import struct

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from drawlake.llm import warc_bundles as W


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [
    (5, "http://a.example/5", "<p>copy</p>"), (3, "http://a.example/3", "<p>copy</p>"), (9, "http://a.example/9", "<p>copy</p>"),
    (4, None, None), (2, "http://b.example/ x\r\ny", ""), (1, "http://c.example/", "\r\n\r\nWARC/1.1\r\n\r\n é日本"),
    (7, "http://d.example/", "z" * 3_000_000), (8, "http://d.example/", "y" * 70_000), (None, "http://e.example/", "<p>copy</p>"),
    (None, None, "only null ids"), (6, "http://f.example/", "twice"), (6, "http://f.example/", "twice"),
    *[(100 + k, f"http://g.example/{k}", "hot") for k in range(200)],
]
SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "x") for p in PAGES], SCHEMA + ", digest string, bytes string").repartition(4).cache()


def expected(min_revisit=0):
    first = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    rows = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        small = first.get(html or "")
        again = len(payload) >= min_revisit and page_id != small
        rows.append((page_id, len(payload), digest(payload), "revisit" if again else "response", small if again else None))
    return sorted(rows, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("min_revisit", [0, 5])
def test_records_come_back(spark, pages, tmp_path, min_revisit):
    folder = str(tmp_path)
    index = W.write_archive(pages, folder, min_revisit=min_revisit, frame_bytes=4096, bundle_bytes=2_000)
    got = W.read_archive(index, folder, payload=True).cache()
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str) == expected(min_revisit)
    html = {p[0]: (p[2] or "").encode() for p in PAGES if p[0] is not None}
    for row in got.collect():
        assert row.payload == (b"" if row.record_type == "revisit" else html.get(row.page_id, b"only null ids"))
    urls = {r.page_id: r.url for r in got.collect()}
    assert urls[4] == "urn:page:4" and urls[2] == "http://b.example/%20x%0D%0Ay"
    assert index.select("bundle").distinct().count() > 4  # a small limit starts new bundles
    # An uncommitted file beside the bundles changes nothing.
    (tmp_path / "left-behind.warc.zst").write_bytes(b"half a frame")
    assert W.read_archive(index, folder).count() == len(PAGES)


def test_index_leads_to_single_records(spark, pages, tmp_path):
    folder = tmp_path.as_uri()
    index = W.write_archive(pages, folder, frame_bytes=10_000)
    for row in index.filter("page_id < 9").collect():
        with W.fs.FileSystem.from_uri(folder)[0].open_input_file(f"{tmp_path}/{row.bundle}") as source:
            start, size, raw = W.seek_table(source)[row.frame]
            data = W.read_frame(source, start, size, raw)
        found = W.parse(data, row.offset)
        assert found.end == row.offset + row.length and found.headers["WARC-Page-ID"] == str(row.page_id)
    wanted = index.filter("page_id IN (1, 7, 150)").select("record_id")
    got = {r.page_id: (r.record_type, r.payload) for r in W.fetch(index, folder, wanted).collect()}
    assert got == {1: ("response", PAGES[5][2].encode()), 7: ("response", b"z" * 3_000_000), 150: ("revisit", b"")}
    assert W.fetch(index, folder, wanted.limit(0)).collect() == []


def test_bundle_is_a_plain_zstandard_stream(tmp_path):
    records = [W.record(k, "u", b"p" * k, digest(b"p" * k), k, k, False, "1970-01-01T00:00:00Z")[1] for k in range(60)]
    path = tmp_path / "b.warc.zst"
    bundle = W.Bundle(pa.OSFile(str(path), "wb"), frame_bytes=2_000)
    places = [bundle.add(r) for r in records]
    bundle.close()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read()
    assert whole == b"".join(records)
    with pa.OSFile(str(path)) as source:
        table = W.seek_table(source)
        for (frame, offset), data in zip(places, records):
            assert W.read_frame(source, *table[frame])[offset: offset + len(data)] == data
    assert all(raw <= 2_000 for _, _, raw in table) and len(table) > 5
    raw = path.read_bytes()
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    path.write_bytes(raw[:-1])
    with pa.OSFile(str(path)) as source, pytest.raises(ValueError):
        W.seek_table(source)
    with pytest.raises(ValueError):
        W.parse(records[5].replace(b"p\r\n\r\n", b"q\r\n\r\n"), 0)


def test_empty_table_and_roles_of_hot_class(spark, pages, tmp_path):
    none = pages.limit(0)
    index = W.write_archive(none, str(tmp_path))
    assert W.read_archive(index, str(tmp_path)).collect() == [] and list(tmp_path.iterdir()) == []
    hot = spark.range(5000).select((F.col("id") + 7).alias("page_id"), F.lit("u").alias("url"), F.lit(b"same").alias("payload"))
    assert W.roles(hot).agg(F.min("first_id"), F.max("first_id"), F.count_if("revisit")).first() == (7, 7, 4999)
