"""Merkle fixity audit of WARC replicas.

Each record is hashed; the records of a fixed range of file offsets make a leaf, LEVELS levels of FAN-fold nodes stand above it, and
a file's root covers all of it. Replicas are compared by their roots; only branches whose hashes differ are descended into, and the
records of the leaves reached are compared. Nodes are grouped by file and range, so a file that holds a third of all records is built
and searched by many tasks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sparkquill.llm.batches import stored

RANGE_BITS, FAN_BITS, LEVELS = 16, 8, 4


def _digest(items: Column, line: str) -> Column:
    """sha256 of the sorted items, one text line each."""
    return F.sha2(F.concat_ws("\n", F.transform(F.array_sort(items), lambda x: _line(x, line))), 256)


def _line(x: Column, names: str) -> Column:
    return F.concat_ws(":", *[x[n].cast("string") for n in names.split()])


def trees(records: DataFrame) -> list[DataFrame]:
    """(file, node, hash) of each level, leaves first, roots (node 0) last. records has file, offset, length and sha256.

    A leaf covers offsets [node << RANGE_BITS, (node + 1) << RANGE_BITS); LEVELS levels cover files of up to 256 TB.
    """
    items = F.collect_list(F.struct("offset", "length", "sha256"))
    level = stored(records.groupBy("file", F.shiftright("offset", RANGE_BITS).alias("node")).agg(_digest(items, "offset length sha256").alias("hash")))
    out = [level]
    for _ in range(LEVELS):
        items = F.collect_list(F.struct("node", "hash"))
        level = stored(level.groupBy("file", F.shiftright("node", FAN_BITS).alias("up")).agg(_digest(items, "node hash").alias("hash")).withColumnRenamed("up", "node"))
        out.append(level)
    return out


def _differing(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    x, y = a.select(*key, F.col(value).alias("mine")), b.select(*key, F.col(value).alias("other"))
    return x.join(y, key, "full").where(~F.col("mine").eqNullSafe(F.col("other")))


def audit(mine: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where two replicas differ, and the roots of both.

    Both have file, offset, length and sha256 (of the record); file and offset name a record. Returns (differences, roots):
    differences has file, offset and status (changed, missing: not in `other`, extra: only in `other`); roots has file, root,
    other_root (null where a replica lacks the file). Rows with a null file or offset are left out of the trees. Repeated equal rows
    of a record are part of its leaf's hash, so another number of them shows as changed. Empty replicas have no roots.
    """
    keys = ["file", "offset"]
    mine, other = (x.select(*keys, "length", "sha256").dropna(subset=keys) for x in (mine, other))
    a, b = trees(mine), trees(other)
    roots = a[-1].select("file", F.col("hash").alias("root")).join(b[-1].select("file", F.col("hash").alias("other_root")), "file", "full")
    bad = roots.where(~F.col("root").eqNullSafe(F.col("other_root"))).select("file", F.lit(0).cast("long").alias("node"))
    for x, y in zip(a[-2::-1], b[-2::-1], strict=True):
        bad = stored(bad.select("file", F.col("node").alias("up")))
        x, y = (z.withColumn("up", F.shiftright("node", FAN_BITS)).join(bad, ["file", "up"], "left_semi") for z in (x, y))
        bad = _differing(x, y, ["file", "node"], "hash").select("file", "node")
    bad = stored(bad)
    record = F.sha2(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat_ws(":", F.col("length").cast("string"), "sha256")))), 256)
    x, y = (z.withColumn("node", F.shiftright("offset", RANGE_BITS)).join(bad, ["file", "node"], "left_semi").groupBy(*keys).agg(record.alias("hash")) for z in (mine, other))
    found = _differing(x, y, keys, "hash")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("changed")
    return found.select(*keys, status.alias("status")), roots


#: WARC-Date of records whose time of crawl isn't known.
NO_DATE = "1970-01-01T00:00:00Z"


def warc_record(url: Column, html: Column, date: str = NO_DATE) -> Column:
    """A resource record (no HTTP headers are kept) named by a digest of url and html; null url and html count as empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    digest = F.md5(F.concat(url, F.lit("\n"), html))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = [("WARC-Type", F.lit("resource")), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", url), ("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(html).cast("string"))]
    lines = [x for name, value in head for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))]
    return F.concat(F.lit("WARC/1.0\r\n"), *lines, F.lit("\r\n"), html, F.lit("\r\n\r\n"))


_HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers with lower-cased names, content) of each record of an uncompressed WARC file. What isn't a record is an error."""
    at = 0
    while at < len(data):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in m[1].decode("utf-8", "replace").split("\r\n")) if k}
        end = m.end() + int(head["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield at, end + 4 - at, head, data[m.end() : end]
        at = end + 4


#: Compressed bytes that are looked at at once.
PIECE = 1 << 16


def gzip_members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each member of a gzip file, one after the other."""
    at = 0
    while at < len(data):
        member, parts, to = zlib.decompressobj(31), [], at
        while not member.eof:
            if to >= len(data):
                raise ValueError(f"the gzip member at byte {at} is cut off")
            try:
                parts.append(member.decompress(data[to : to + PIECE]))
            except zlib.error as e:
                raise ValueError(f"no gzip member at byte {at}") from e
            to = min(to + PIECE, len(data))
        end = to - len(member.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def warc_records(data: bytes) -> Iterator[tuple[int, int, bytes, dict[str, str], bytes]]:
    """(offset, length, record, headers, content) of a WARC file, plain or with a gzip member for each record, whose place is the member's."""
    if not data.startswith(b"\x1f\x8b"):
        for at, n, head, content in parse_warc(data):
            yield at, n, data[at : at + n], head, content
        return
    for at, n, raw in gzip_members(data):
        records = list(parse_warc(raw))
        if len(records) != 1:
            raise ValueError(f"the gzip member at byte {at} has {len(records)} records")
        yield at, n, raw, records[0][2], records[0][3]


#: Bytes of records that are handed on at once.
HANDED = 1 << 20


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, sha256 of the record, type, record_id, target_uri, content) of WARC files, plain or compressed by record
    (.warc.gz), a file at a time: what audit() takes. Digests are those of the records as they are without compression, so a plain replica
    and a compressed one compare by content. A file must fit into an executor's memory; records are handed on in small batches."""
    schema = "file string, offset long, length long, sha256 string, type string, record_id string, target_uri string, content binary"
    kinds = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("content", pa.binary())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for at, n, record, head, content in warc_records(data.as_py()):
                    rows.append((file, at, n, hashlib.sha256(record).hexdigest(), head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), content))
                    size += len(content)
                    if size > HANDED:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


#: Hex digits of a record's digest by which the records of one id are dealt; rows that one array makes at once.
BLOCK_HEX, COPIES = 3, 4096


def _placed(rows: DataFrame) -> DataFrame:
    """rows (page_id, file, length, sha256, other) with each record's offset: records of a file by page_id, then sha256.

    Equal rows are counted first and become rows again at the end. Offsets are sums over a file's blocks (id and first digits of the
    digest), then within a block, so no window sees more than a file's blocks or a block's different records, however many rows
    share an id or have none.
    """
    key = ["file", "page_id", "block"]
    each = rows.groupBy("page_id", "file", "length", "sha256", "other").agg(F.count("*").alias("n")).withColumn("block", F.substring("sha256", 1, BLOCK_HEX))
    each = stored(each)
    so_far = lambda size, w: F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    blocks = each.groupBy(*key).agg(F.sum(F.col("length") * F.col("n")).alias("size"))
    blocks = blocks.select(*key, so_far("size", W.partitionBy("file").orderBy("page_id", "block")).alias("start")).alias("b")
    each = each.withColumn("inside", so_far(F.col("length") * F.col("n"), W.partitionBy(*key).orderBy("sha256"))).alias("a")
    each = each.join(blocks, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
    each = each.select("a.page_id", "a.file", "length", "sha256", "other", "n", (F.col("start") + F.col("inside")).alias("first"))
    some = each.withColumn("lot", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).withColumn("copy", F.explode(F.expr(f"sequence(lot * {COPIES}, least(n, (lot + 1) * {COPIES}) - 1)")))
    return some.select("page_id", "file", "length", "sha256", "other", (F.col("first") + F.col("copy") * F.col("length")).alias("offset"))


#: Records of one WARC file.
FILE_RECORDS = 1000


def replica_audit(pages: DataFrame) -> DataFrame:
    """The pages as WARC files of FILE_RECORDS ids each, audited against a replica that has known damage.

    In the replica, records of ids divisible by 50 begin with another character of html, and those of ids that leave 7 by 50 are
    missing. A row per page: page_id, file, offset, length (bytes of the record), sha256, root (of its file), other_root, status (ok,
    changed or missing). Null ids make a file of their own; pages with equal ids follow each other by their records' hashes. An empty
    html can't be changed and is ok. Other columns are not read; an empty table gives an empty table.
    """
    record = warc_record(F.col("url"), F.col("html"))
    damaged = warc_record(F.col("url"), F.concat(F.lit("\0"), F.substring("html", 2, 2**31 - 1)))
    damaged = F.when((F.col("page_id") % 50 == 0) & (F.col("html") != ""), F.sha2(damaged, 256)).when(F.col("page_id") % 50 == 7, None).otherwise(F.col("sha256"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("sha256", F.sha2(record, 256))
    rows = rows.select("page_id", F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), F.lit(-1)).cast("long").alias("file"), F.octet_length(record).cast("long").alias("length"), "sha256", damaged.alias("other"))
    rows = stored(_placed(rows))
    found, roots = audit(rows, rows.where("other is not null").withColumn("sha256", F.col("other")))
    out = rows.drop("other").join(stored(roots), "file", "left").join(stored(found), ["file", "offset"], "left")
    return out.select("page_id", F.concat(F.lit("crawl-"), F.col("file").cast("string")).alias("file"), "offset", "length", "sha256", "root", "other_root", F.coalesce("status", F.lit("ok")).alias("status"))
