import base64
import hashlib

import pytest

from panelyard.llm import warc
from panelyard.session import shared_path


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")


ROWS = [(1, "http://a/", "x\r\n\r\ny"), (2, None, "x\r\n\r\ny"), (3, "http://b/\r\nEvil: 1", None), (4, "u", ""), (5, "u", "é\0 日"), (5, "u", "é\0 日"), (6, "u", "é\0 日"), (None, "u", "n"), (None, "u", "n"), (7, "u", "z" * 300000), (6, "v", "é\0 日")]


def test_round_trip_and_edge_cases(spark):
    path = warc.write_archive(pages(spark, ROWS), shared_path(spark, "w"))
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    records = warc.read_records(spark, path).collect()
    assert len(records) == len(ROWS)
    for r in records:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and len(block) == int(fields[b"Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
    got = warc.parse_records(warc.read_records(spark, path)).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for r in got:
        if r.is_response:
            assert (r.page_id, sha(bytes(r.payload).decode())) in [(p, sha(h)) for p, _, h in ROWS] and r.payload_digest == sha(bytes(r.payload).decode())
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("1", "revisit", "2"), ("2", "response", "None"), ("3", "revisit", "4"), ("4", "response", "None"), ("5", "revisit", "6"), ("5", "revisit", "6"), ("6", "response", "None"), ("6", "response", "None"), ("None", "response", "None"), ("None", "response", "None"), ("7", "response", "None")]
    )


def test_urls_that_are_not_ascii_come_back(spark):
    urls = ["http://a/é?日=ü", "http://b/\u00c5ngström/\u0085x\u2028y", "http://c/\U0001f600", "http://d/plain"]
    path = shared_path(spark, "case")
    pages(spark, [(i, u, f"p{i % 3}") for i, u in enumerate(urls)]).write.parquet(f"{path}/pages.parquet")
    assert {r.page_id: r.url for r in warc.op9_warc(spark, path).collect()} == dict(enumerate(urls))


def test_empty_table_threshold_and_damage(spark):
    path = warc.write_archive(pages(spark, ROWS).where("false"), shared_path(spark, "w"))
    assert warc.read_records(spark, path).collect() == []
    path = warc.write_archive(pages(spark, ROWS), shared_path(spark, "w"), min_revisit_bytes=100)
    assert all(r.record_type == "response" for r in warc.parse_records(warc.read_records(spark, path)).collect())
    bad = shared_path(spark, "w")
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    spark.read.parquet(f"{path}/payloads").selectExpr("sha2(digest, 256) as digest", "payload").write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{bad}/records").selectExpr("page_id", "sha2(digest, 256) as digest", "is_response", "headers").write.mode("overwrite").parquet(f"{bad}/records2")
    import shutil

    shutil.rmtree(bad.removeprefix("file://") + "/records")
    shutil.move(bad.removeprefix("file://") + "/records2", bad.removeprefix("file://") + "/records")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(spark, bad).collect()


def test_query_with_copies(spark):
    path = shared_path(spark, "case")
    pages(spark, ROWS).write.parquet(f"{path}/pages.parquet")
    got = {(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.op9_warc(spark, path).collect()}
    assert (3, "revisit", 0, 4) in got and (5, "revisit", 7, 6) in got and (7, "response", 300000, None) in got
