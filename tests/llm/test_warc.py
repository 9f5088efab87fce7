import base64
import gzip
import hashlib

from millrace.llm import warc
from millrace.llm.storage import filesystem, scratch_path

PAGE = "page_id long, url string, html string, digest string, body int"
ROWS = [
    (1, "https://www.B.example.org:8080/x?q=1#f", "<p>one</p>", "d", 1), (2, "http://a.example.org", "<p>one</p>", "d", 1), (3, "http://a.example.org/", None, None, None), (4, None, "", "d", 2),
    (5, "http://a.example.org/\r\nX: y", "é" * 50_000, "d", 1), (6, "http://a.example.org/z", "line\r\n\r\nbreaks\r\n", "d", 1), (6, "http://a.example.org/z", "line\r\n\r\nbreaks\r\n", "d", 1), (None, "http://c.example.org/", "<p>one</p>", "d", 1),
]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_digests_and_revisits(spark):
    pages = spark.createDataFrame(ROWS, PAGE)
    captures, files = warc.archive(pages)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(warc.read_index(files)).collect()), key=str)
    first = {}
    for i, _, h, *_ in ROWS:
        first[h or ""] = max(i or 0, first.get(h or "", 0))
    want = sorted(((i or 0, len((h or "").encode()), sha(h), "response" if (i or 0) == first[h or ""] else "revisit", None if (i or 0) == first[h or ""] else first[h or ""]) for i, _, h, *_ in ROWS), key=str)
    assert got == want
    payloads = {r.page_id: r.payload for r in warc.read_records(captures).collect() if r.record_type == "response"}
    assert bytes(payloads[5]).decode() == "é" * 50_000 and bytes(payloads[6]) == b"line\r\n\r\nbreaks\r\n"


def test_small_payloads_are_not_revisited(spark):
    captures, _ = warc.archive(spark.createDataFrame(ROWS, PAGE), least_bytes=12)
    kinds = {(r.page_id, r.record_type) for r in captures.collect()}
    assert (1, "response") in kinds and (2, "response") in kinds and (6, "response") in kinds


def test_lookup_by_binary_search(spark):
    rows = [(i, f"http://h{i % 50:02d}.example.com/p/{i}", f"<p>{i}</p>", None, None) for i in range(3000)] + [(9000 + i, "http://h07.example.com/same", f"v{i}", None, None) for i in range(40)]
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(spark.createDataFrame(rows, PAGE), folder)
    files = warc.write_index(captures, folder + "-index", block_lines=16)
    asked = spark.createDataFrame([("http://h07.example.com/p/57",), ("https://WWW.h07.example.com/same",), ("http://h07.example.com/none",), (None,)], ["url"])
    found = warc.lookup(asked, files)
    assert sorted(r.page_id for r in found.where("asked like '%/57'").collect()) == [57]
    assert sorted(r.page_id for r in found.where("asked like '%same'").collect()) == list(range(9000, 9040))
    assert found.where("asked like '%none' or asked is null").count() == 0
    records = warc.read_records(found.where("asked like '%/57'").drop("asked")).collect()
    assert [bytes(r.payload) for r in records] == [b"<p>57</p>"]


def test_records_are_gzip_members_with_standard_fields(spark):
    captures, _ = warc.archive(spark.createDataFrame(ROWS[:2], PAGE))
    row = captures.where("page_id = 1").first()
    fs, path = filesystem(row.file)
    with fs.open_input_file(path) as f:
        f.seek(row.offset)
        text = gzip.decompress(f.read(row.length)).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n") and f"WARC-Refers-To: {warc.record_id(2, sha(ROWS[0][2]))}" in text and text.endswith("\r\n\r\n")


def test_url_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("https://www.B.example.org:8080/x?q=1#f",), ("b.example.org",), ("http://u@b.example.org?q",), ("",), (None,)], ["u"])
    assert [r.k for r in df.select(warc.url_key(F.col("u")).alias("k")).collect()] == ["org,example,b)/x?q=1", "org,example,b)/", "org,example,b)/?q", ")/", ")/"]


def test_empty_table(spark):
    captures, files = warc.archive(spark.createDataFrame([], PAGE))
    assert captures.count() == 0 and files.count() == 0
    assert warc.read_records(warc.read_index(files)).count() == 0
    assert warc.lookup(spark.createDataFrame([("http://x/",)], ["url"]), files).count() == 0
