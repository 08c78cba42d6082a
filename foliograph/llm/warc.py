"""Operator 10: WARC archives with revisit records, and a splittable reader.

A page is one record, a gzip member of its own. Of pages with equal payloads of ``least`` bytes or more, the one with the
largest page_id is a response and the others are revisits of it, which hold the payload's digest and not the payload.
Groups are found by SHA-256 and length. Which page revisits which is worked out on a table without payloads; a payload moves
once, by its row's number, so no task gets all copies of one.

The reader gives each task a byte range of an archive. The task looks for the gzip magic, takes a candidate for a member
if it decodes to a record's header, owns the records that start within its range, and reads on past its end to finish the
last. From one member it goes straight to the next, and after its last one it makes sure that a whole member or the end of
the archive follows. So each member is checked by its own task or the one before, and a damaged one raises an error.

Defined results: null html is an empty payload; a null page_id is smaller than any other; rows that share the largest
page_id of a group are one response, the others revisit it; an empty table makes no archive; other columns are ignored.
Archives are written under names of the attempt's own and counted only through the table that Spark commits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, prepare, scratch, written

MAGIC = b"\x1f\x8b\x08"
#: A split's bytes, an archive's bytes before the next is begun, and bytes read at once.
SPLIT, ARCHIVE, STEP = 64 << 20, 1 << 30, 1 << 18
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def _clean(text: str | None) -> str:
    """A header's value holds no line ends."""
    return " ".join((text or "").split())


def record(page_id: int | None, row: int, url: str | None, payload: bytes, original: tuple | None = None) -> bytes:
    """A record as a gzip member. ``original``: page_id, row and url of the response that a revisit points to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if original else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, row)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if original:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*original[:2])}", f"WARC-Refers-To-Target-URI: {_clean(original[2])}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {'' if original[0] is None else original[0]}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zip_.compress(data) + zip_.flush()


def write(pages: DataFrame, least: int = 0) -> list[tuple[str, int]]:
    """Write ``pages`` (page_id, url, html) as archives; their URIs and sizes. One row an archive comes to the driver."""
    spark = pages.sparkSession
    prepare(spark)
    folder = scratch(spark, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    key = F.concat(F.sha2(html, 256), F.lit(":"), F.octet_length(html))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.when(F.octet_length(html) >= least, key).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "warc-rows")
    best = F.max(F.struct("page_id", "row", "url")).alias("best")
    several = rows.where("key is not null").groupBy(F.col("key").alias("__key")).agg(best, F.count("*").alias("n")).where("n > 1").select("__key", "best")
    several = written(several, "warc-groups")  # before it is joined back: only then may the join split a large group
    revisits = rows.select("row", "key").join(several, F.col("key") == F.col("__key")).where("best.row <> row").select(F.col("row").alias("__row"), "best")
    joined = rows.join(revisits, F.col("row") == F.col("__row"), "left")
    out = joined.select("page_id", "row", "url", "html", F.col("best.page_id").alias("p"), F.col("best.row").alias("r"), F.col("best.url").alias("u"))

    def save(batches):
        context, file, name, size, number = TaskContext.get(), None, "", 0, 0
        done = []
        fs, path = filesystem(folder)
        for batch in batches:
            for page_id, row, url, html, p, r, u in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    name = f"{context.partitionId():07d}-{context.taskAttemptId()}-{number}.warc.gz"
                    file, size, number = fs.open_output_stream(f"{path}/{name}", compression=None), 0, number + 1
                data = record(page_id, row, url, html.encode(), None if r is None else (p, r, u))
                file.write(data)
                size += len(data)
                if size >= ARCHIVE:
                    file.close()
                    done.append((name, size))
                    file = None
        if file is not None:
            file.close()
            done.append((name, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done]), pa.array([s for _, s in done], pa.int64())], ["name", "size"])

    made = written(out.mapInArrow(save, "name string, size long"), "warc-manifest").orderBy("name").collect()
    from pyarrow.fs import FileSelector

    kept = {r.name for r in made}
    for info in fs.get_file_info(FileSelector(path)):
        if info.base_name.endswith(".warc.gz") and info.base_name not in kept:
            fs.delete_file(info.path)
    return [(f"{folder}/{r['name']}", r["size"]) for r in made]


class _Window:
    """Bytes of a file from a place on, read in steps as they are asked for."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.begin, self.data = file, size, at, b""

    def byte(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``; what lies before is let go, and read again if it is asked for again."""
        if at < self.begin:
            self.data, self.begin = b"", at
        elif at > self.begin:
            self.data, self.begin = self.data[at - self.begin :], at
        while len(self.data) < n and self.begin + len(self.data) < self.size:
            self.file.seek(self.begin + len(self.data))
            self.data += self.file.read(max(STEP, n - len(self.data)))
        return self.data[:n]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place and the place after it, if it is a whole WARC record."""
    if not window.byte(at, 18).startswith(MAGIC):
        return None
    unzip, out, place = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof:
            data = window.byte(place, STEP)
            if not data:
                return None
            out.append(unzip.decompress(data))
            if len(out) == 1 and not b"WARC/1.".startswith(out[0][:7]):
                return None
            place += len(data) - len(unzip.unused_data)
    except zlib.error:
        return None
    content = b"".join(out)
    head, found, rest = content.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    length = _fields(head).get("content-length", "")
    return (content, place) if length.isdigit() and len(rest) == int(length) + 4 else None


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def records(file, size: int, begin: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records that start in [begin, end) of an archive; an error if a member is damaged."""
    window, at, found = _Window(file, size, begin), begin, None
    while at < end and (found := _member(window, at)) is None:  # look for the first member
        if begin == 0:
            raise ValueError("the archive does not begin with a whole member")
        data = window.byte(at + 1, STEP)
        if len(data) < len(MAGIC):
            return
        k = data.find(MAGIC)
        at += 1 + (k if k >= 0 else len(data) - len(MAGIC) + 1)
    while found is not None:
        content, at = found
        head, _, rest = content.partition(b"\r\n\r\n")
        yield _fields(head), rest[:-4]
        found = _member(window, at) if at < size else None
        if found is None and at < size:
            raise ValueError(f"no whole member at byte {at}, where the one before it ends")
        if at >= end:
            return


SCHEMA = "record_id string, record_type string, url string, page_id long, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _number(text: str) -> int | None:
    return int(text) if text else None


def read(spark: SparkSession, archives: list[tuple[str, int]], split: int = SPLIT) -> DataFrame:
    """The records of archives, a task for each range of ``split`` bytes. A response's digest is checked."""
    prepare(spark)
    listed, total = [], 0
    for uri, size in archives:  # one row an archive; its ranges are made by the tasks
        listed.append((uri, size, total))
        total += -(-size // split)
    if not total:
        return spark.createDataFrame([], SCHEMA)
    ranges = spark.createDataFrame(listed, "uri string, size long, first long").select("uri", "size", "first", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {split}"))).alias("k"))
    ranges = ranges.where("size > 0").select("uri", "size", (F.col("k") * split).alias("begin"), (F.col("first") + F.col("k")).cast("int").alias("range")).repartitionById(total, "range")

    def scan(batches):
        for batch in batches:
            for uri, size, begin in zip(*(c.to_pylist() for c in batch.columns[:3])):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for fields, block in records(file, size, begin, min(size, begin + split)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        response = fields["warc-type"] == "response"
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if response and digest_of(payload) != digest:
                            raise ValueError(f"a payload's digest is wrong in {uri}")
                        n = len(payload) if response else int(_fields(http)["content-length"])
                        rows.append((fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), _number(fields.get("x-page-id", "")), digest, n, _number(fields.get("x-refers-to-page-id", "")), payload if response else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return ranges.mapInArrow(scan, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])
