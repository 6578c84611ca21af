"""WARC archives with a two-level capture index.

Archives. Each page is one WARC/1.1 record in a gzip member of its own; of equal payloads of at least
``REVISIT_BYTES`` bytes only the one with the largest page id is stored, others are revisit records
that name it. Which rows revisit is settled on narrow rows (id, SHA-1, length) with a map-side maximum
for each digest; the pages themselves are not shuffled unless more rows revisit than may be broadcast,
and then by their own ids.

Index. Captures are sorted by reversed-host URL key (``org,example,www)/path``) and page id, so that a
key with a third of all captures is split too, and cut into compressed blocks of ``BLOCK_LINES`` lines
in shard files. Behind its blocks a shard holds a sparse directory, each block's first and last key,
offset and length; a table of one row a shard says what keys it has. A search sorts the keys that are
wanted over tasks; each bisects the shards, reads the directory of the one that it is at, bisects that,
reads the block's byte range and bisects its lines. The records' byte ranges are then read file by file.
Nothing but the table of shards, one row for each task that wrote the index, comes to the driver.

Files go straight to the folder that the cluster shares, under names no other attempt uses, and are
known only through tables written after they are closed: a lost or repeated task leaves at most files
that no table names. The folder may be any that pyarrow's file systems open (file, hdfs, s3, gs).

Defined results: a null page is an empty payload; a null url is the page's own urn; rows repeated with
the largest id are all responses, and a null id is never the largest unless there is no other; a
missing header value reads as null; no rows give no archives and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import _common as c

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000

#: An archive file is closed once it has so many bytes.
ARCHIVE_BYTES = 64 << 20

#: About so many archive bytes are read back in one task.
READ_BYTES = 16 << 20

#: Lines to a block of the index.
BLOCK_LINES = 3000

LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "urlkey string, page_id long, file string, offset long, length long"
SHARDS = "first_key string, first_id long, last_key string, last_id long, shard string, offset long, length long, blocks long, lines long"
WANTED = "urlkey string, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None, page_id: int | None) -> str:
    """The reversed-host key of a url, without control characters."""
    if not url:
        return f"urn:page:{page_id}"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), key)


# -- records -------------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _digest(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, revisits: int | None) -> bytes:
    """A response record, or, if `revisits` is a page id, a revisit record of it; not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits is not None else http + payload
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:page:{page_id}"
    head = {
        "WARC-Type": "response" if revisits is None else "revisit",
        "WARC-Record-ID": record_id(page_id, sha1),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": _digest(sha1),
        "WARC-Block-Digest": _digest(hashlib.sha1(block).hexdigest()),
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["WARC-Page-ID"] = str(page_id)
    if revisits is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(revisits, sha1)
        head["WARC-Refers-To-Page-ID"] = str(revisits)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(raw: bytes) -> dict:
    """Headers by lower-cased name, `block`, and of HTTP blocks `http` and `payload`; checks lengths and digests."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(out["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut")
    if _digest(hashlib.sha1(block).hexdigest()) != out.get("warc-block-digest"):
        raise ValueError("a record's block is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    out |= {"block": block, "http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("latin-1").split("\r\n")[1:])}, "payload": payload}
    if out["warc-type"] == "response" and _digest(hashlib.sha1(payload).hexdigest()) != out["warc-payload-digest"]:
        raise ValueError("a record's payload is damaged")
    return out


def _row(record: dict) -> tuple:
    number = lambda x: int(x) if x is not None else None
    full = record["warc-type"] == "response"
    sha1 = hashlib.sha1(record["payload"]).hexdigest() if full else base64.b32decode(record["warc-payload-digest"][5:]).hex()
    size = len(record["payload"]) if full else int(record["http"]["content-length"])
    return number(record.get("warc-page-id")), record["warc-target-uri"], size, sha1, record["warc-type"], number(record.get("warc-refers-to-page-id"))


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*(x.split() for x in ddl.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(columns, types)], names=list(names))


# -- writing -------------------------------------------------------------------------------------


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    out, rows, name, at = None, [], "", 0
    for whole in batches:
        for b in c.slices(whole):
            pages = zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "sha1", "refers_to")))
            for page_id, url, html, sha1, refers_to in pages:
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = gzip_member(make_record(page_id, url, html or b"", sha1, refers_to))
                out.write(data)
                rows.append((url_key(url, page_id), page_id, name, at, len(data)))
                at += len(data)
                if at >= archive_bytes:
                    out.close()
                    yield _table(rows, MANIFEST)
                    out, rows = None, []
    if out is not None:
        out.close()
        yield _table(rows, MANIFEST)


def _blocks(batches: Iterator[pa.RecordBatch], folder: str, block_lines: int) -> Iterator[pa.RecordBatch]:
    """One shard: its blocks, then its directory."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    out, name, at, lines, found, total = None, "", 0, [], [], 0

    def flush() -> None:
        nonlocal out, name, at, lines
        if out is None:
            name = f"{uuid.uuid4().hex}.cdx.gz"
            out = store.open_output_stream(f"{root}/{name}", compression=None)
        data = gzip_member("".join(lines).encode())
        out.write(data)
        first, last = (x.split("\t", 2)[:2] for x in (lines[0], lines[-1]))
        found.append((*first, *last, at, len(data)))
        at += len(data)
        lines = []

    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns)):
            lines.append("\t".join("" if x is None else str(x) for x in row) + "\n")
            total += 1
            if len(lines) == block_lines:
                flush()
    if lines:
        flush()
    if out is not None:
        directory = gzip_member("".join("\t".join(map(str, x)) + "\n" for x in found).encode())
        out.write(directory)
        out.close()
        number = lambda x: int(x) if x else None
        yield _table([(found[0][0], number(found[0][1]), found[-1][2], number(found[-1][3]), name, at, len(directory), len(found), total)], SHARDS)


@dataclass(frozen=True)
class Captures:
    """Archives and their index: the folder of files, the written table of shards, and the archives' bytes in all."""

    folder: str
    shards: DataFrame
    archive_bytes: int


def archive(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> Captures:
    """Write (page_id, url, html) as WARC archives with an index into the shared folder."""
    c.ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), c.clean_text("html").cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    narrow = c.materialize(rows.select("page_id", "sha1", F.octet_length("html").alias("n")).where(F.col("n") >= revisit_bytes), "warc-digests")
    stored = narrow.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null")
    revisits = narrow.join(stored, "sha1").where("not page_id <=> first").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("first").alias("refers_to"))
    revisits = c.materialize(revisits.distinct(), "warc-revisits")
    told = rows.join(c.guarded(revisits), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left").drop("_id", "_sha1")
    manifest = c.materialize(told.mapInArrow(lambda it: _write(it, f"{folder}/archives", archive_bytes), MANIFEST), "warc-manifest")
    order = ("urlkey", "page_id", "file", "offset")
    shards = manifest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _blocks(it, f"{folder}/index", block_lines), SHARDS)
    shards, size = c.materialize(shards, "warc-shards"), manifest.agg(F.sum("length")).first()[0] or 0
    for old in (narrow, revisits, manifest):
        c.discard(old)
    return Captures(folder, shards, size)


# -- reading -------------------------------------------------------------------------------------


_LEAST = -(1 << 63)


def _place(key: str, page_id: str) -> tuple[str, int]:
    """A capture's place in the index; a null id comes first."""
    return key, int(page_id) if page_id else _LEAST


class _Index:
    """Searches in ascending order: of directories and blocks, the last one read is kept."""

    def __init__(self, folder: str, shards: list[tuple]):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.shards = sorted(((k, _LEAST if i is None else i), (m, _LEAST if j is None else j), name, at, n) for k, i, m, j, name, at, n in shards)
        self.ends = [x[1] for x in self.shards]
        self.directory: tuple[str, list] = ("", [])
        self.block: tuple[tuple[str, int], list] = (("", 0), [])

    def _text(self, name: str, offset: int, length: int) -> list[list[str]]:
        with self.store.open_input_file(f"{self.root}/{name}") as f:
            text = zlib.decompress(f.read_at(length, offset), 31).decode()
        return [x.split("\t") for x in text.split("\n")[:-1]]

    def _blocks(self, name: str, offset: int, length: int) -> list:
        if self.directory[0] != name:
            self.directory = name, [(_place(k, i), _place(m, j), int(at), int(n)) for k, i, m, j, at, n in self._text(name, offset, length)]
        return self.directory[1]

    def _lines(self, name: str, offset: int, length: int) -> list:
        if self.block[0] != (name, offset):
            self.block = (name, offset), [(_place(k, i), f, int(at), int(n)) for k, i, f, at, n in self._text(name, offset, length)]
        return self.block[1]

    def find(self, first: tuple[str, int], last: tuple[str, int]) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the captures from `first` to `last`, both included."""
        for shard in range(bisect_left(self.ends, first), len(self.shards)):
            begin, _, name, at, n = self.shards[shard]
            if begin > last:
                return
            blocks = self._blocks(name, at, n)
            for block in range(bisect_left(blocks, first, key=lambda x: x[1]), len(blocks)):
                if blocks[block][0] > last:
                    return
                lines = self._lines(name, *blocks[block][2:])
                for line in range(bisect_left(lines, first, key=lambda x: x[0]), len(lines)):
                    if lines[line][0] > last:
                        return
                    yield lines[line][1:]


ENTRY = "file string, offset long, length long"


def _found(batches: Iterator[pa.RecordBatch], folder: str, shards: list[tuple], any_id: bool) -> Iterator[pa.RecordBatch]:
    index, out = _Index(folder, shards), []
    for b in batches:
        for key, page_id in zip(*(x.to_pylist() for x in b.columns)):
            own = _LEAST if page_id is None else page_id
            for entry in index.find((key, _LEAST), (key, 1 << 63)) if any_id else index.find((key, own), (key, own)):
                out.append(entry)
                if len(out) >= 10_000:  # a key may have any number of captures
                    yield _table(out, ENTRY)
                    out = []
    yield _table(out, ENTRY)


def _records(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    file, name = None, None
    for whole in batches:
        for b in c.slices(whole):
            rows = []
            for where, offset, length in zip(*(x.to_pylist() for x in b.columns)):
                if where != name:
                    if file is not None:
                        file.close()
                    file, name = store.open_input_file(f"{root}/{where}"), where
                rows.append(_row(parse_record(zlib.decompress(file.read_at(length, offset), 31))))
            yield _table(rows, RECORD)
    if file is not None:
        file.close()


def search(captures: Captures, wanted: DataFrame, any_id: bool = False) -> DataFrame:
    """RECORD rows of the captures with a wanted (urlkey, page_id), each once; with `any_id` those of a wanted urlkey, whatever their id."""
    folder, spark = captures.folder, captures.shards.sparkSession
    shards = [tuple(r) for r in captures.shards.select("first_key", "first_id", "last_key", "last_id", "shard", "offset", "length").collect()]
    shared = spark.sparkContext.broadcast(shards)
    names = ["urlkey"] if any_id else ["urlkey", "page_id"]
    keys = wanted.select(*names).distinct()
    keys = keys.repartitionByRange(*names).sortWithinPartitions(*names).select("urlkey", F.lit(None).cast("long").alias("page_id") if any_id else F.col("page_id"))
    entries = keys.mapInArrow(lambda it: _found(it, f"{folder}/index", shared.value, any_id), ENTRY)
    # an entry is short and what it points to is long, so the number of tasks follows the archives' bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-captures.archive_bytes // READ_BYTES))
    by_file = entries.repartition(tasks, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(lambda it: _records(it, f"{folder}/archives"), RECORD)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("page_id").to_pylist()
        yield _table([(url_key(u, i), i) for u, i in zip(b.column("url").to_pylist(), ids)], WANTED)


def read_pages(captures: Captures, pages: DataFrame) -> DataFrame:
    """RECORD rows of the captures of these pages (page_id, url), each once."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return search(captures, rows.mapInArrow(_keys, WANTED))


def lookup(captures: Captures, urls: list[str]) -> DataFrame:
    """RECORD rows of all captures of some urls."""
    spark = captures.shards.sparkSession
    keys = sorted({(url_key(u, None),) for u in urls})
    return search(captures, spark.createDataFrame(keys, "urlkey string"), any_id=True)


def new_folder(spark: SparkSession) -> str:
    return c.scratch_path(spark, "warc")
