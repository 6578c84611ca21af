import hashlib
import random

import duckdb
import pytest
from pyarrow import fs

from lakeweave.llm import _common as c
from lakeweave.llm import oracles, queries, warc


@pytest.fixture
def folder(spark):
    return warc.new_folder(spark)


def test_url_keys():
    assert warc.url_key("https://User@M.Example.ORG:8080/a/b?x=1#f", 1) == "org,example,m:8080)/a/b?x=1"
    assert warc.url_key("http://a.b", 1) == "b,a)/"
    assert warc.url_key(None, 7) == "urn:page:7" and warc.url_key("", None) == "urn:page:None"
    assert warc.url_key("no url\there", 1) == ")no%20urlhere" or "\t" not in warc.url_key("no url\there", 1)
    assert warc.url_key("http://[bad", 1) == "http://[bad"


@pytest.mark.parametrize("payload", [b"", b"x", b"\r\n\r\n", b"WARC/1.1\r\n" * 300, bytes(range(256)) * 50])
def test_record_round_trip(payload):
    sha1 = hashlib.sha1(payload).hexdigest()
    raw = warc.make_record(5, "http://a.b/ü\r\nX: y", payload, sha1, None)
    record = warc.parse_record(raw)
    assert record["payload"] == payload and warc._row(record) == (5, "http://a.b/%C3%BC%0D%0AX:%20y", len(payload), sha1, "response", None)
    again = warc._row(warc.parse_record(warc.make_record(4, None, payload, sha1, 5)))
    assert again == (4, "urn:page:4", len(payload), sha1, "revisit", 5)
    for damaged in (raw[:-1], raw.replace(b"HTTP", b"HTTQ"), b"X" + raw):
        with pytest.raises(ValueError):
            warc.parse_record(damaged)


def test_query_equals_its_sql(spark, sf_dir):
    got = queries.queries()["op9_warc"](spark, sf_dir)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
        want = con.sql(oracles.oracle_sql()["op9_warc"])
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_revisits_equal_brute_force(spark, folder):
    rng = random.Random(6)
    bodies = [None, "", "s" * 999, "b" * 1000, "é" * 500, "y" * 4000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(["http://h.org/1", "http://h.org/2", None]), rng.choice(bodies), "x") for _ in range(120)]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(warc.archive(pages, folder), pages).collect()), key=repr)
    want = []
    for i, _, body, _ in rows:
        data = (body or "").encode()
        top = max((k for k, _, b, _ in rows if (b or "").encode() == data and k is not None), default=None)
        full = len(data) < 1000 or i == top
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if full else "revisit", None if full else top))
    assert got == sorted(want, key=repr)


def test_broadcast_bound_has_another_way(spark, folder, monkeypatch):
    monkeypatch.setattr(c, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", "z" * 2000) for i in range(30)], "page_id long, url string, html string")
    got = warc.read_pages(warc.archive(pages, folder), pages).collect()
    assert len(got) == 30 and all(r.refers_to == (None if r.page_id == 29 else 29) for r in got)


def test_search_bisects_shards_directories_and_blocks(spark, folder, monkeypatch):
    urls = [f"http://s{i % 5}.example.org/{i}" for i in range(200)] + ["http://hot.example.net/"] * 100
    pages = spark.createDataFrame([(i, u, f"page {i} " * 30) for i, u in enumerate(urls)], "page_id long, url string, html string")
    captures = warc.archive(pages, folder, archive_bytes=3000, block_lines=7)
    shards = [tuple(r) for r in captures.shards.select("first_key", "first_id", "last_key", "last_id", "shard", "offset", "length").collect()]
    assert sum(r.lines for r in captures.shards.collect()) == 300 and sum(r.blocks for r in captures.shards.collect()) > 40
    by_url = {u: sorted(r.page_id for r in warc.lookup(captures, [u]).collect()) for u in (urls[3], urls[150], "http://hot.example.net/", "http://none.example.org/", "http://zzz.zzz/")}
    assert list(by_url.values()) == [[3], [150], list(range(200, 300)), [], []]
    assert warc.lookup(captures, list(by_url)).count() == 102
    store, root = fs.FileSystem.from_uri(f"{folder}/archives")
    assert len(store.get_file_info(fs.FileSelector(root))) > 10
    # one capture of the hot key costs one directory and one block
    index, read = warc._Index(f"{folder}/index", shards), []
    text = index._text
    monkeypatch.setattr(index, "_text", lambda *at: (read.append(at), text(*at))[1])
    key = warc.url_key("http://hot.example.net/", None)
    assert len(list(index.find((key, 250), (key, 250)))) == 1 and len(read) == 2
    assert len(list(index.find((key, 251), (key, 251)))) == 1 and len(read) <= 3
    # every capture by its own key, in any order of the pages
    assert sorted(r.page_id for r in warc.read_pages(captures, pages.orderBy("page_id")).collect()) == list(range(300))
    assert warc.read_pages(captures, pages.where("page_id % 50 = 7")).count() == 6


def test_empty_table(spark, folder):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    captures = warc.archive(pages, folder)
    assert warc.read_pages(captures, pages).count() == 0 and warc.lookup(captures, ["http://a.b/"]).count() == 0


def test_long_page(spark, folder):
    pages = spark.createDataFrame([(1, "http://a.b/", "long é" * 500_000)], "page_id int, url string, html string")
    (row,) = warc.read_pages(warc.archive(pages, folder), pages).collect()
    assert row.payload_bytes == 3_500_000
