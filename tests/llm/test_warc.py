import base64
import hashlib

import duckdb
import pytest
import zstandard

from trilattice.llm import warc
from trilattice.llm.jpeg_media import op7_jpeg_media
from trilattice.llm.token_count import op9_token_counts


def brute(rows):
    best = {}
    for p, _, h in rows:
        key = h or ""
        best[key] = max([x for x in (p, best.get(key)) if x is not None], default=None)
    for p, _, h in rows:
        data, original = (h or "").encode(), best[h or ""]
        back = p != original
        yield p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if back else "response", original if back else None


ROWS = [(1, "http://a/", "x"), (4, None, "x"), (2, "u\r\nX: y é", "x"), (7, "u", None), (8, "u", ""), (9, "u", "é\r\n\r\n" * 90_000), (None, "u", "x"), (None, "v", "lone"), (5, "w", "twice"), (5, "w", "twice"), (3, "w", "\0<p>")]


@pytest.mark.parametrize("frame", [200, 1 << 18])
def test_round_trip(spark, frame):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, refers_to long")
    got = [tuple(r) for r in warc.round_trip(pages, frame_bytes=frame, bundle_bytes=2000).collect()]
    assert sorted(got, key=str) == sorted(brute(ROWS), key=str)
    assert warc.round_trip(pages.where("false")).collect() == []
    few = warc.with_revisits(pages, broadcast_rows=0).select("page_id", "refers_to").collect()
    assert sorted(map(str, few)) == sorted(map(str, warc.with_revisits(pages).select("page_id", "refers_to").collect()))


def test_seek_by_record(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    found = 0
    for row in warc.write_archives(warc.with_revisits(pages).coalesce(1), frame_bytes=300).collect():
        bundle = bytes(row.bundle)
        plain = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read()
        assert plain == b"".join(warc.read_frame(bundle, i) for i in range(len(warc.seek_table(bundle))))
        for r in row.records:
            headers, _ = warc.fetch(bundle, r.frame, r.offset)
            assert headers["WARC-Record-ID"] == warc.record_id(r.page_id)
            found += 1
    assert found == len(ROWS)


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(duck.sql(warc.ORACLE).fetchall())
    assert sorted(tuple(r) for r in warc.op6_warc(spark, sf).collect()) == want


def test_no_setting_of_the_session_changes(spark):
    before = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.conf().getAll())
    before = {k: v for k, v in dict(before).items() if k != "spark.checkpoint.dir"}
    for query in (warc.op6_warc, op7_jpeg_media, op9_token_counts):
        query(spark, "/root/testdata/sf0.001").count()
    after = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.conf().getAll())
    assert {k: v for k, v in dict(after).items() if k != "spark.checkpoint.dir"} == before


def test_one_page_by_its_place(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (40 * i % 700)) for i in range(60)], "page_id long, url string, html string")
    made = warc.write_archives(warc.with_revisits(pages), frame_bytes=2000, bundle_bytes=9000).collect()
    assert len(made) > 1 and max(r["frame"] for m in made for r in m.records) > 1
    for m in made:
        for r in m.records:
            assert warc.fetch(m.bundle, r["frame"], r["offset"])[0]["X-Page-ID"] == str(r["page_id"])
    assert warc.read_archives(spark.createDataFrame(made)).count() == 60
