"""WARC archives of pages with a two-level capture index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import shared_dir, stored, table
from footfall.llm.tokens import WholeFile, file_system

#: A WARC file is closed beyond this.
FILE_BYTES = 256 << 20
#: Lines of an index block.
BLOCK_LINES = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def url_key(url: str | None) -> str:
    """The URL with its host reversed, without scheme, fragment and default port: ``com,example)/a?b``."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return "!)" + quote(url, safe="/?&=%:;,+~")
    name = ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme.lower()):
        name += f":{port}"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{name}){quote(rest, safe='/?&=%:;,+~@!$()*')}"


def record_id(page: int | None) -> str:
    """A UUID that holds the page's number."""
    return f"<urn:uuid:{uuid.UUID(int=(0 if page is None else (1 << 64) | (page & (2**64 - 1))))}>"


def page_of(rid: str) -> int | None:
    n = uuid.UUID(rid[10:-1]).int
    if not n >> 64:
        return None
    n &= 2**64 - 1
    return n - 2**64 if n >> 63 else n


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()


def read_record(data: bytes) -> dict:
    """What a record says: page, type, digest, payload bytes, refers_to, payload. A response's digest is computed anew."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    said = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    out = {"page_id": page_of(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "url": fields["WARC-Target-URI"]}
    if out["type"] == "revisit":
        return out | {"digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "bytes": said, "refers_to": page_of(fields["WARC-Refers-To"]), "payload": None}
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if len(payload) != said or f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return out | {"digest": digest, "bytes": said, "refers_to": None, "payload": payload}


def write_warcs(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Writes a record per row and returns the captures: key, page, file, offset, length.

    Of rows with equal payloads of at least ``min_payload`` bytes, that with the smallest id is the response and the
    others revisit it (rows that repeat both id and payload of a response are responses too); a null id comes last.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    src = src.withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
    # Stored, so that the join deals out both sides and can split the rows of a payload that is everywhere.
    firsts = stored(
        src.filter(F.octet_length("payload") >= min_payload).groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("sha").alias("_sha"), "first"), "firsts",
    )
    joined = src.join(firsts, F.col("sha") == F.col("_sha"), "left").select(
        "page", "url", "payload", "sha", "first", (F.col("_sha").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))).alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, part = None, "", 0, TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for page, url, payload, sha, first, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    # Rows come in another order when a task runs again: each attempt has its own files.
                    name, at = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = WholeFile(f"{root}/{name}")
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                rec = make_record(page, url, payload.encode(), digest, first, revisit)
                out.write(rec)
                rows.append((url_key(url), page, name, at, len(rec)))
                at += len(rec)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)],
                ["key", "page", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return stored(joined.mapInArrow(run, "key string, page long, file string, offset long, length long"), "captures")


class CaptureIndex:
    """Sorted captures in compressed blocks (``cdx-*.gz``), each file with a sparse directory of its blocks (``cdx-*.dir``).

    ``shards`` lists the files in order with the first key and page of each: as many as the sort had tasks.
    """

    def __init__(self, spark: SparkSession, root: str, shards: list[tuple[str, int, int]]) -> None:
        self.spark, self.root, self.shards = spark, root, shards

    def find(self, requests: DataFrame) -> DataFrame:
        """file, offset, length of all captures asked for: ``key`` and the pages from ``low`` to ``high``.

        Each request is searched in the list of shards, then in the shard's directory; only then is a block read. A
        request over many blocks becomes one row a block, so a URL with a third of all captures is spread.
        """
        root, shards = self.root, self.shards
        heads = [(k, p) for k, p, _ in shards]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[list, list]] = {}
            for b in batches:
                rows = []
                for key, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for s in range(max(0, bisect_left(heads, (key, low)) - 1), bisect_right(heads, (key, high))):
                        if s not in held:
                            if len(held) > 64:
                                held.clear()
                            fs, path = file_system(f"{root}/cdx-{shards[s][2]:06d}.dir")
                            with fs.open_input_file(path) as f:
                                lines = [x.split("\t") for x in zlib.decompress(f.read(), 31).decode().split("\n")]
                            held[s] = [(x[0], int(x[1])) for x in lines], [(int(x[2]), int(x[3])) for x in lines]
                        firsts, blocks = held[s]
                        for i in range(max(0, bisect_left(firsts, (key, low)) - 1), bisect_right(firsts, (key, high))):
                            rows.append((key, low, high, shards[s][2], *blocks[i]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)],
                    ["key", "low", "high", "shard", "at", "size"],
                )

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, keys, rest = None, [], []
            for b in batches:
                rows = []
                for key, low, high, shard, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (shard, at) != now:
                        fs, path = file_system(f"{root}/cdx-{shard:06d}.gz")
                        with fs.open_input_file(path) as f:
                            lines = [x.split("\t") for x in zlib.decompress(f.read_at(size, at), 31).decode().split("\n")]
                        now, keys, rest = (shard, at), [(x[0], int(x[1])) for x in lines], lines
                    for i in range(bisect_left(keys, (key, low)), bisect_right(keys, (key, high))):
                        rows.append((rest[i][2], int(rest[i][3]), int(rest[i][4])))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int64()], strict=True)], ["file", "offset", "length"])

        asked = requests.select("key", "low", "high").distinct().repartitionByRange("key", "low").sortWithinPartitions("key", "low")
        placed = asked.mapInArrow(place, "key string, low long, high long, shard int, at long, size long")
        by_block = placed.repartition("shard", "at").sortWithinPartitions("shard", "at", "key", "low")
        return by_block.mapInArrow(search, "file string, offset long, length long")


def build_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorts captures by (key, page) and writes blocks and directories. Ranges break ties by the capture's place, so
    that captures of one URL and page are spread too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, at, directory, lines, head = None, 0, [], [], None

        def close_block() -> None:
            nonlocal at, lines, head
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = c.compress("\n".join(lines).encode()) + c.flush()
            out.write(data)
            directory.append(f"{head[0]}\t{head[1]}\t{at}\t{len(data)}")
            at, lines, head = at + len(data), [], None

        first = None
        for b in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = WholeFile(f"{root}/cdx-{part:06d}.gz")
                page = LOWEST if page is None else page
                first, head = first or (key, page), head or (key, page)
                lines.append(f"{key}\t{page}\t{file}\t{offset}\t{length}")
                if len(lines) >= block_lines:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            sparse = WholeFile(f"{root}/cdx-{part:06d}.dir")
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            sparse.write(c.compress("\n".join(directory).encode()) + c.flush())
            sparse.close()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([part], pa.int32())], ["key", "page", "part"])

    order = ["key", "page", "file", "offset"]
    shards = captures.select("key", "page", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "key string, page long, part int"
    ).collect()
    return CaptureIndex(captures.sparkSession, root, sorted(((r.key, r.page, r.part) for r in shards), key=lambda x: x[2]))


def read_records(places: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """Range-reads the records at (file, offset, length): page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        types = {"page_id": pa.int64(), "url": pa.string(), "type": pa.string(), "bytes": pa.int64(), "digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        for b in batches:
            got = []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != now:
                    if f is not None:
                        f.close()
                    fs, path = file_system(f"{root}/{file}")
                    now, f = file, fs.open_input_file(path)
                got.append(read_record(f.read_at(length, offset)))
                if not with_payload:
                    got[-1]["payload"] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[k] for g in got], t) for k, t in types.items()],
                ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"],
            )
        if f is not None:
            f.close()

    ordered = places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(
        run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    )


class Archive:
    """Pages as WARC files with their index, below ``root``.

    Null payloads are empty ones; a null, odd or very long URL has a key of its own and is found by it; rows that
    repeat an id, a URL or a payload each have a record; an empty table gives no file and look-ups give no row.
    """

    def __init__(self, pages: DataFrame, root: str | None = None, **columns) -> None:
        self.root = root or shared_dir(pages.sparkSession, "warc")
        self.captures = write_warcs(pages, self.root, **columns)
        self.index = build_index(self.captures, self.root)

    def lookup(self, requests: DataFrame, with_payload: bool = True) -> DataFrame:
        """The records of all captures of ``url``, or of that one ``page`` if the column is there and not null."""

        def keys(urls: pa.Array) -> pa.Array:
            return pa.array([url_key(u) for u in urls.to_pylist()], pa.string())

        key = F.arrow_udf(keys, "string")
        page = F.col("page").cast("long") if "page" in requests.columns else F.lit(None).cast("long")
        asked = requests.select(key("url").alias("key"), F.coalesce(page, F.lit(LOWEST)).alias("low"), F.coalesce(page, F.lit(HIGHEST)).alias("high"))
        return read_records(self.index.find(asked), self.root, with_payload)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages and looks every one of them up again."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = Archive(pages)
    got = archive.lookup(pages.select("url", F.coalesce("page_id", F.lit(LOWEST)).alias("page")), with_payload=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base32 by 5-bit groups of the 20 bytes of the digest; 32 of them, so there is no padding.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p),
b AS (
  SELECT *, list_transform(range(0, 4), lambda j: CAST('0x' || substr(h, CAST(j * 10 + 1 AS INTEGER), 10) AS BIGINT)) AS w FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((w[CAST(i // 8 + 1 AS INTEGER)] >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
