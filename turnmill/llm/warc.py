"""A deterministic sharded archive writer and its reader.

Pages are cut into shards by exact prefix sums of their sizes along page_id, sorted inside, and written record by record;
a shard's file is closed and a new one begun when its compressed size reaches ``ROLL_BYTES``.  HTTP and archive headers and
all digests are made anew from the payload.  Every record is a gzip member of its own.  A task writes under temporary names
and reports its files in rows; those rows are staged, then files get their final names (``common.commit``).  Cuts, names,
dates and record ids depend on the data alone, so equal tables give equal archives.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest page_id is a response and the
others are revisits of it; smaller payloads are all responses.  The knowledge that a page's payload has copies travels as a
short note that sorts just before the page, so the pages themselves are shuffled once and never joined.  An id that many rows
share spans shards: ranges are cut by page_id and payload hash, and only rows with equal id and payload stay in one shard.

A null html is an empty payload, a null url the urn of the page.  Null page_ids sort first and are never the smallest of a
group; copies that all have null ids are responses.  Of repeated rows with one page_id and payload the first is the response
and the others revisit that id.  An empty table gives no files and an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import (MANIFEST, MANIFEST_ARROW, by_range, commit, dealt, file_system, fresh_path, range_cuts, range_of,
                                 read_only_columns, slices, stage)

MIN_REVISIT = 100
SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
# Bytes of headers, as the weight of a page without payload.
OVERHEAD = 600
READ = 1 << 16


# ---- records -------------------------------------------------------------------------------------------------------

def _uri(url: str | None, page: str) -> str:
    """The url with white space, control characters and anything outside ASCII percent-encoded, so that it fits in a header line."""
    if not url:
        return f"urn:page:{page}"
    return "".join(c if "!" <= c <= "~" and c not in "<>" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record_id(page: str, digest: str, kind: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}:{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int, date: str = DATE) -> bytes:
    """One archive record: a response with its payload, or a revisit with the headers alone."""
    page = "null" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest, kind, copy)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_uri(url, page)}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Page-Id: {page}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}",
                 f"WARC-Refers-To: {record_id(str(refers_to), digest, 'response', 0)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """``(headers, block)`` of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("ascii").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not an archive record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return headers, rest[:size]


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record in memory at a time."""
    data, unzip, parts = b"", None, []
    while True:
        data = data or stream.read(READ)
        if not data:
            if unzip:
                raise ValueError("an archive is cut short")
            return
        unzip = unzip or zlib.decompressobj(31)
        parts.append(unzip.decompress(data))
        data = unzip.unused_data
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = None, []


# ---- Spark jobs ----------------------------------------------------------------------------------------------------

def duplicates(sizes: DataFrame) -> DataFrame:
    """``(page_id, tie, digest, first)`` for payloads that occur more than once: the page that holds the response.

    ``sizes`` is (page_id, tie, digest, bytes).  Copies are counted by map-side sums.
    """
    large = sizes.where(F.col("bytes") >= MIN_REVISIT)
    firsts = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    return large.select("page_id", "tie", "digest").join(firsts.select("digest", "first"), "digest").distinct()


def write(pages: DataFrame, *, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = LEVEL,
          folder: str | None = None) -> tuple[str, DataFrame]:
    """Write every row of ``pages`` (page_id, url, html); returns the folder and the manifest."""
    folder = folder or fresh_path(pages.sparkSession, "archives")
    rows = read_only_columns(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("tie", F.xxhash64("payload"))
    sizes = stage(rows.select("page_id", "tie", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes")), "archive-sizes")
    cuts = range_cuts(sizes.withColumn("weight", F.col("bytes") + OVERHEAD), "page_id", "weight", shard_bytes, "tie")
    notes = duplicates(sizes).select("page_id", "tie", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
                                     F.lit(0).alias("kind"), "digest", "first")
    records = rows.select("*", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"))
    mixed = records.unionByName(notes).withColumn("shard", range_of(F.col("page_id"), cuts, F.col("tie")))
    ranged = by_range(mixed, "shard", cuts, "page_id", "tie", "kind", "url", "payload").select(
        "shard", "page_id", "tie", "kind", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root)
        shard, piece, open_file, page, firsts, seen = None, 0, None, None, {}, {}

        def begin() -> dict:
            temp = f"_temporary-{shard:05d}-{piece:05d}-{uuid.uuid4().hex}"
            return {"temp": temp, "stream": fs.open_output_stream(f"{root}/{temp}"), "hash": hashlib.sha256(), "bytes": 0, "records": 0, "payload": 0}

        def finish(f: dict) -> pa.RecordBatch:
            f["stream"].close()
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "piece": piece, "temp": f["temp"], "name": f"pages-{shard:05d}-{piece:05d}.warc.gz", "records": f["records"],
                "items": f["payload"], "bytes": f["bytes"], "sha256": f["hash"].hexdigest()}], schema=MANIFEST_ARROW)

        for batch in slices(batches):
            for s, p, tie, kind, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if open_file:
                        yield finish(open_file)
                    shard, piece, open_file, page, firsts, seen = s, 0, None, None, {}, {}
                # Rows of one page and payload stand together, so these hold one digest.
                if (p, tie) != page:
                    page, firsts, seen = (p, tie), {}, {}
                if kind == 0:
                    firsts[digest] = first
                    continue
                digest = hashlib.sha256(payload).hexdigest()
                copy = seen[digest] = seen.get(digest, -1) + 1
                first = firsts.get(digest)
                refers_to = None if first is None or (first == p and copy == 0) else first
                zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = zipped.compress(record(p, url, payload, digest, refers_to, copy)) + zipped.flush()
                open_file = open_file or begin()
                open_file["stream"].write(data)
                open_file["hash"].update(data)
                open_file["bytes"] += len(data)
                open_file["records"] += 1
                open_file["payload"] += len(payload)
                if open_file["bytes"] >= roll_bytes:
                    yield finish(open_file)
                    piece, open_file = piece + 1, None
        if open_file:
            yield finish(open_file)

    return folder, commit(ranged.mapInArrow(run, MANIFEST), folder, "archives")


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` of every record, digests verified."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parse(data)
                        if headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                            raise ValueError(f"{name}: a block differs from its digest")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if headers["WARC-Type"] == "response" and digest != hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest():
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page, refers = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id")
                        rows.append((None if page == "null" else int(page), headers["WARC-Target-URI"], int(headers["X-Payload-Length"]), digest,
                                     headers["WARC-Type"], None if refers is None else int(refers)))
                        if len(rows) == 4096:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return dealt(manifest).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
