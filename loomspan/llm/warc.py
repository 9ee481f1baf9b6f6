"""WARC archives with a two-level capture index.

`write_archives` turns pages into WARC 1.1 records, one gzip member each, and packs them into archives of about
`archive_bytes`: rows (archive, data) of a table in the shared folder, each data being a complete .warc.gz, so that any
store that Spark writes can hold them. Of records with equal payloads (SHA-1) of at least `min_bytes` the one with the
smallest page_id is a response; the others are revisits that name it and carry headers, but no payload.

`capture_index` sorts lines keyed by the reversed-host URL into compressed blocks of `block_lines` lines, and groups of
blocks that follow each other. The sparse directory has the first key of each group: at most GROUPS entries and one for
each partition of the sort, of at most KEY letters each, however many captures there are, so it is broadcast. `locate`
searches it binarily for each key, sends the key to the groups that can hold it, searches these groups' blocks binarily,
opens the blocks that can hold it, and finds its lines there by binary search. `read_back` reads captures by range.
A query for some URLs and one for all of them go the same way.

Null html counts as empty, null or odd URLs get the key of their own text. Long html is one record; it is worked on alone.
Repeated page_ids: every row gets its own record; rows with the same page_id and payload as the response are responses as
well. Null page_ids sort last among equals, and are responses only where all of an equal payload's ids are null. Copies
of one payload may be any share of the rows: payloads that are surely alone aren't shuffled, and rows of a digest that many
rows have are dealt to many tasks. An empty table gives empty archives, index and result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common as C

DATE = "2024-01-01T00:00:00Z"

#: Groups of blocks in the sparse directory, and letters of a key there.
GROUPS, KEY = 1 << 15, 64


def url_key(url: str | None) -> str:
    """The host reversed and comma-joined, then ')' and path and query: 'com,example)/a?b'. Scheme and 'www.' don't count."""
    url = url or ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        host, parts, port = "", None, None
    if not host:
        return url.lower()
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + rest.lower()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. A revisit's block is the HTTP header alone, which states the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "about:blank") if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member; checks lengths, and the digest of what has a payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    own = headers["WARC-Record-ID"][len("<urn:page:") : -1]
    found = {"page_id": int(own) if own else None, "record_type": headers["WARC-Type"], "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": stated, "refers_to": None, "payload": None, "url": headers["WARC-Target-URI"]}
    if found["record_type"] == "revisit":
        found["refers_to"] = int(headers["WARC-Refers-To"][len("<urn:page:") : -1])
    else:
        found["payload"] = payload
        if len(payload) != stated or digest32(payload) != found["payload_digest"]:
            raise ValueError("payload and digest differ")
    return found


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long_enough = pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= min_bytes)
    firsts = long_enough.groupBy(F.sha1("payload").alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = C.materialise(firsts, "firsts")
    bitmap = C.bitmap_of(firsts.select(F.xxhash64("digest").alias("key")))
    alone = C.likely(rows, F.xxhash64("digest"), bitmap, wanted=False).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    near = C.split_join(C.likely(rows, F.xxhash64("digest"), bitmap), firsts, ["digest"], "copies", F.monotonically_increasing_id(), "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("long")
    return alone.unionByName(near.select("page_id", "url", "payload", refers_to.alias("refers_to")))


def write_archives(rows: DataFrame, archive_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Write archives; return them as (archive, data) and their captures (key, page_id, archive, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, captures, size = [], [], 0

        def flush() -> pa.RecordBatch:
            body = b"".join(data)
            name = hashlib.sha1(body).hexdigest()
            out = pa.RecordBatch.from_pydict({"archive": [name], "data": [body], "captures": [list(captures)]}, schema=schema)
            data.clear()
            captures.clear()
            return out

        schema = pa.schema([("archive", pa.string()), ("data", pa.binary()), ("captures", pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])))])
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                member = gzip_member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
                captures.append({"key": index_key(url.as_py()), "page_id": page_id.as_py(), "offset": size, "length": len(member)})
                data.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield flush()
                    size = 0
        if data:
            yield flush()

    written = C.materialise(rows.mapInArrow(run, "archive string, data binary, captures array<struct<key:string,page_id:long,offset:long,length:long>>"), "warc")
    # Archives are named by their content: two that are equal byte for byte are one archive.
    captures = written.select("archive", F.explode("captures").alias("c")).select("c.key", "c.page_id", "archive", "c.offset", "c.length")
    return written.select("archive", "data"), captures


def capture_index(captures: DataFrame, block_lines: int = 3000) -> DataFrame:
    """Blocks (part, number, first_key, last_key, block): sorted, zlib-compressed lines 'key page_id archive offset length'.

    Range partitioning sorts the whole table; equal keys in any number spread over blocks, so no host is too hot. Parts and
    numbers within them follow the keys.
    """
    line = F.concat_ws("\t", "key", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "archive", "offset", "length")
    # concat_ws skips nulls, and none is left here
    ordered = captures.select("key", F.xxhash64("archive", "offset").alias("tie"), line.alias("line"))
    ordered = ordered.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        lines: list[str] = []
        part, number = TaskContext.get().partitionId(), 0

        def flush(n: int) -> pa.RecordBatch:
            nonlocal number
            columns = [[part], [number], [keys[0]], [keys[n - 1]], [zlib.compress("\n".join(lines[:n]).encode())]]
            number += 1
            del keys[:n], lines[:n]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))], ["part", "number", "first_key", "last_key", "block"])

        for batch in batches:
            keys += batch.column("key").to_pylist()
            lines += batch.column("line").to_pylist()
            while len(lines) >= block_lines:
                yield flush(block_lines)
        if lines:
            yield flush(len(lines))

    return C.materialise(ordered.select("key", "line").mapInArrow(run, "part long, number long, first_key string, last_key string, block binary"), "captures")


def directory(blocks: DataFrame) -> tuple[int, list[tuple[str, int, int]]]:
    """(blocks in a group, sorted (first key, part, group)). A key is cut to KEY letters, which may only widen a search."""
    width = max(1, -(-blocks.count() // GROUPS))
    groups = blocks.groupBy("part", F.floor(F.col("number") / width).cast("long").alias("group")).agg(F.min("first_key").alias("first_key"))
    rows = groups.select(F.substring("first_key", 1, KEY).alias("first_key"), "part", "group").collect()
    return width, sorted((r["first_key"], r["part"], r["group"]) for r in rows)


def block_lines_of(block: bytes) -> tuple[list[str], list[str]]:
    """(keys, lines) of a block."""
    lines = zlib.decompress(block).decode().split("\n")
    return [x.split("\t", 1)[0] for x in lines], lines


_LOCATED = "key string, page_id long, archive string, offset long, length long"


def locate(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures (key, page_id, archive, offset, length) of distinct `keys` (key), by the directory and two binary searches."""
    width, entries = directory(blocks)
    shared = blocks.sparkSession.sparkContext.broadcast(entries)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [e[0] for e in shared.value]
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for key in batch.column("key").to_pylist():
                low = max(0, bisect.bisect_left(firsts, key[:KEY]) - 1)
                out += [(key, *shared.value[k][1:]) for k in range(low, bisect.bisect_right(firsts, key))]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["key", "part", "group"])

    def search(there: pa.Table, asked: pa.Table) -> pa.Table:
        held = sorted(zip(*(there.column(c).to_pylist() for c in ("number", "first_key", "last_key", "block"))), key=lambda b: b[0])
        firsts, lasts, opened, found = [b[1] for b in held], [b[2] for b in held], {}, []
        for key in sorted(asked.column("key").to_pylist()):
            for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                if k not in opened:
                    opened = {k: block_lines_of(held[k][3])}  # keys go up, so blocks before it are done
                own, lines = opened[k]
                found += [lines[i].split("\t") for i in range(bisect.bisect_left(own, key), bisect.bisect_right(own, key))]
        columns = [[f[0] for f in found], [int(f[1]) if f[1] else None for f in found], [f[2] for f in found], [int(f[3]) for f in found], [int(f[4]) for f in found]]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "page_id", "archive", "offset", "length"])

    asked = keys.select("key").mapInArrow(route, "key string, part long, group long")
    grouped = blocks.withColumn("group", F.floor(F.col("number") / width).cast("long"))
    return grouped.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInArrow(lambda there, asked: search(there, asked), _LOCATED)


_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(archives: DataFrame, captures: DataFrame) -> DataFrame:
    """Read every capture by its range. A group is one archive with the lines that point into it: bounded in size."""
    names = [c.split(" ")[0] for c in _OUT.split(", ")]

    def run(there: pa.Table, lines: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if len(there):
            data, last = memoryview(there.column("data")[0].as_py()), None
            for at, n in sorted(zip(lines.column("offset").to_pylist(), lines.column("length").to_pylist())):
                rows.append(rows[-1] if (at, n) == last else parse_record(data[at : at + n]))
                last = at, n
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], pa.string() if c in ("payload_digest", "record_type") else pa.int64()) for c in names], names)

    return archives.groupBy("archive").cogroup(captures.select("archive", "offset", "length").groupBy("archive")).applyInArrow(run, _OUT)


def lookup(blocks: DataFrame, archives: DataFrame, urls: list[str]) -> DataFrame:
    """Captures of some URLs."""
    keys = archives.sparkSession.createDataFrame([(k,) for k in sorted({index_key(u) for u in urls})], "key string")
    lines = C.materialise(locate(blocks, keys), "located")
    return read_back(archives.join(lines.select("archive").distinct(), "archive", "left_semi"), lines)


def index_key(url: str | None) -> str:
    """The key as the index holds it: tabs and line feeds are what separates its columns and lines."""
    return url_key(url).replace("\t", " ").replace("\n", " ")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, index them, ask the index for every key it can have, and read what it says."""
    archives, captures = write_archives(with_roles(C.table(spark, sf_dir, "pages")))
    keys = captures.select("key").distinct()
    return read_back(archives, locate(capture_index(captures), keys))
