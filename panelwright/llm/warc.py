"""WARC archives with a two-level capture index.

Pages are written as gzip members, one record each, into archives in the session's shared folder; of
equal payloads the largest page id is stored and the others are revisit records that refer to it. The
index holds one line per record, sorted by reversed-host key, in compressed blocks. A sparse directory
keeps the first key of each block. A look-up searches the shard bounds, then the shard's directory, opens
one block, and reads one range of one archive.

Files written by a task that failed are never referred to: the written index names only the archives
of tasks that finished.

Defined results: a null html is an empty payload; a null url has an empty key; a null page id never is
the stored copy unless all equal pages lack one; repeated rows are written each, and rows that repeat
the stored page are responses too; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import query, table
from panelwright.session import materialize, scratch_dir

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 512
SHARDS = 4096  # most ranges of the index; the driver holds one key of each
DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture


def digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a text."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def capture_key(url: Column, page_id: Column) -> Column:
    """Reversed host, path and page id: ``com,example,www)/path?x 0000000000000000042``."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(whole, F.lit("://")), F.regexp_replace(whole, r"^[\s\S]*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    surt = F.concat(F.array_join(F.reverse(F.split(F.lower(host), "[.]")), ","), F.lit(")"), F.regexp_replace(tail, r"\s", "+"))
    return F.concat_ws(" ", surt, F.lpad(F.coalesce(page_id.cast("string"), F.lit("-")), 20, "0"))


def decided(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)`` of ``(page_id, url, html)``; ``refers_to`` is null for responses."""
    made = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", digest(F.col("html")))
    keeper = made.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("m")).where("m > 1 AND keeper IS NOT NULL").select("digest", "keeper")
    return made.join(keeper, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")).alias("refers_to"))


def _record(page_id, url, html: bytes, digest_: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if refers_to is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest_}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def write_archives(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write ``(page_id, url, html)`` and return ``(key, file, offset, length)``, one row per record."""
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}"
    rows = decided(pages, least_bytes=least_bytes).withColumn("key", capture_key(F.col("url"), F.col("page_id")))

    def run(batches):
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        out = path = None
        at = 0
        for batch in batches:
            made = []
            for page_id, url, html, sha, refers, key in zip(*[batch.column(i) for i in range(6)]):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(path, compression=None)  # members are compressed one by one
                data = _member(_record(page_id.as_py(), url.as_py(), html.as_py().encode(), sha.as_py(), refers.as_py()))
                out.write(data)
                made.append((key.as_py(), path, at, len(data)))
                at += len(data)
            columns = list(zip(*made)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                             ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    order = ["page_id", "url", "html", "digest", "refers_to", "key"]
    return materialize(rows.select(*order).mapInArrow(run, "key string, file string, offset bigint, length bigint"), "captures")


class CaptureIndex:
    """Blocks ``(shard, block, first, data)`` and, per shard, the sparse directory of first keys."""

    def __init__(self, captures: DataFrame, *, block_lines: int = BLOCK_LINES, shards: int | None = None):
        spark = captures.sparkSession
        shards = min(SHARDS, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = captures.repartitionByRange(shards, "key").sortWithinPartitions("key", "file", "offset")

        def run(batches):
            from pyspark import TaskContext

            shard, block, lines = TaskContext.get().partitionId(), 0, []

            def packed():
                first = lines[0].split("\t", 1)[0]
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array(
                    [zlib.compress("\n".join(lines).encode(), 6)], pa.binary())], ["shard", "block", "first", "data"])

            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    lines.append("\t".join(map(str, row)))
                    if len(lines) == block_lines:
                        yield packed()
                        block, lines = block + 1, []
            if lines:
                yield packed()

        self.blocks = materialize(ordered.select("key", "file", "offset", "length").mapInArrow(
            run, "shard int, block int, first string, data binary"), "blocks")
        self.directory = self.blocks.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("first", "block"))).alias("entries")).select(
            "shard", F.col("entries.first").alias("firsts"))
        bounds = self.blocks.groupBy("shard").agg(F.min("first").alias("first")).collect()  # at most SHARDS rows
        self.bounds = sorted((r["first"], r["shard"]) for r in bounds)

    def find(self, keys: DataFrame) -> DataFrame:
        """``(key, file, offset, length)`` of every capture of the distinct keys in column ``key``."""
        starts, shards = [b[0] for b in self.bounds], [b[1] for b in self.bounds]

        def to_shard(batches):
            for batch in batches:
                key, shard = [], []
                for k in batch.column(0).to_pylist():
                    # equal keys may run over a border: from the last shard that starts before the key on
                    for i in range(max(bisect_left(starts, k) - 1, 0), bisect_right(starts, k)):
                        key.append(k)
                        shard.append(shards[i])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(shard, pa.int32())], ["key", "shard"])

        def to_block(batches):
            for batch in batches:
                key, shard, block = [], [], []
                for k, s, firsts in zip(*[c.to_pylist() for c in batch.columns]):
                    for i in range(max(bisect_left(firsts, k) - 1, 0), bisect_right(firsts, k)):
                        key.append(k)
                        shard.append(s)
                        block.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(shard, pa.int32()), pa.array(block, pa.int32())],
                                                 ["key", "shard", "block"])

        def to_range(batches):
            for batch in batches:
                rows = []
                for keys_, data in zip(*[c.to_pylist() for c in batch.columns]):
                    lines = [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
                    names = [x[0] for x in lines]
                    for k in keys_:
                        rows += [(k, x[1], int(x[2]), int(x[3])) for x in lines[bisect_left(names, k):bisect_right(names, k)]]
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                                 ["key", "file", "offset", "length"])

        asked = keys.select("key").distinct().mapInArrow(to_shard, "key string, shard int")
        blocked = asked.join(self.directory, "shard").select("key", "shard", "firsts").mapInArrow(to_block, "key string, shard int, block int")
        grouped = blocked.groupBy("shard", "block").agg(F.collect_list("key").alias("keys"))  # a block's own keys at most
        return grouped.join(self.blocks, ["shard", "block"]).select("keys", "data").mapInArrow(
            to_range, "key string, file string, offset bigint, length bigint")


def _parse(data: bytes) -> dict:
    """Fields of one gzip member; a response's payload must match its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name):
        value = fields.get(name, "<urn:page:None>")[len("<urn:page:"):-1]
        return None if value == "None" else int(value)

    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": sha,
            "record_type": kind, "refers_to": page("WARC-Refers-To"), "html": payload.decode() if kind == "response" else None}


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"


def read_ranges(found: DataFrame, *, payload: bool = False) -> DataFrame:
    """The records at ``(file, offset, length)``; rows are sorted so that a task reads each archive forward."""
    spark: SparkSession = found.sparkSession
    folder = scratch_dir(spark)
    names = [f.split(" ")[0] for f in RECORD.split(", ")][:None if payload else -1]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def run(batches):
        where, _ = fs.FileSystem.from_uri(folder)
        path = source = None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if file != path:
                    if source is not None:
                        source.close()
                    path, source = file, where.open_input_file(file)
                rows.append(_parse(source.read_at(length, offset)))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
        if source is not None:
            source.close()

    return found.select("file", "offset", "length").sortWithinPartitions("file", "offset").mapInArrow(
        run, ", ".join(RECORD.split(", ")[:len(names)]))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHARS = " || ".join(
    f"substr('{_ALPHABET}', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * j}) & 31 AS BIGINT) + 1, 1)"
    for g in range(8) for j in range(4))


@query("op8_warc_archives", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_CHARS} AS payload_digest, h FROM p),
k AS (SELECT h, max(page_id) AS keeper FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d JOIN k USING (h)""")
def op8_warc_archives(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = CaptureIndex(write_archives(pages))
    found = index.find(pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key")))
    return read_ranges(found).drop("url")
