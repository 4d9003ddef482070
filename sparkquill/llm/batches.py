"""Shared pieces of the text operators: Arrow text buffers, words as byte ranges, word and shingle hashes, scratch tables.

Texts are handled as the UTF-8 bytes of an Arrow column, many documents at a time, in slices of a few megabytes, so the memory a
task needs does not depend on the size of its partition. A null text counts as an empty one.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Bytes of text that are worked on at once (one longer document is worked on alone).
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to Python at once.
BATCH_ROWS = 1000

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.array([seed], U64)))


STEP = stream(23, 8) | U64(1)
#: Longer byte ranges are hashed one by one.
LONG_RANGE = 128
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range of buf: eight bytes at a step, each step's bits mixed before the next one, so that no family of
    texts collides by construction. Ranges of one length of up to eight bytes never collide."""
    n = end - start
    out = mix(n.astype(U64) + STEP[7])
    if not len(n):
        return out
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place on
    at, k = np.flatnonzero((n > 0) & (n <= LONG_RANGE)), 0
    while len(at):
        left = n[at] - k
        out[at] = mix(out[at] ^ ((eight[start[at] + k] & _MASK[np.minimum(left, 8)]) * STEP[(k >> 3) & 7]))
        at, k = at[left > 8], k + 8
    for i in np.flatnonzero(n > LONG_RANGE).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def text_column(column: pa.Array) -> pa.Array:
    """A string array without nulls (they become empty texts) and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text_column, and where each text starts in them (one more entry than texts)."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with about `limit` bytes of text each, and their text columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = text_column(batch.column(text))
        _, off = buffers(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), column.slice(at, to - at)
            at = to


class Words:
    """The words (maximal runs of other bytes than white space) of many texts.

    buf, off: the texts. start, end: byte ranges in buf. first: for each text the index of its first word, one entry more than
    texts. Words never run over the end of a text.
    """

    def __init__(self, column: pa.Array, between: np.ndarray = SPACE):
        """between: whether each byte value lies between words."""
        self.buf, self.off = buf, off = buffers(column)
        n = len(buf)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(off), np.int64)
            return
        edge = np.ones(n + 1, bool)  # edge[i]: byte i - 1 is white space, or a text starts at i
        space = between[buf]
        edge[1:] = space
        edge[off] = True
        self.start = np.flatnonzero(edge[:-1] & ~space)
        edge[:n] = space  # edge[i]: byte i is white space, or a text starts at i
        edge[n] = True
        edge[off] = True
        self.end = np.flatnonzero(edge[1:] & ~space) + 1
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, of A-Z as a-z if lower."""
        return range_hashes(LOWER[self.buf] if lower else self.buf, self.start, self.end)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, size, U64)
    for i in range(size):
        out += words[i : i + n] * STEP[i % 8] if size <= 8 else mix(words[i : i + n] + U64(i)) * STEP[i % 8]
    return mix(out)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text with fewer words has its whole sequence as one shingle."""
    words = Words(column)
    h, first = words.hashes(), words.first
    all_ = shingle_hashes(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(all_[a : b - size + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(shingle_hashes(h[a:b], b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands at most BATCH_ROWS texts to Python at once: they are whole texts, and may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='quill-')}"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all machines share, spark.checkpoint.dir. Where that is unset a session of one machine gets a local
    folder; on a cluster it's an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(base or _local_folder()).rstrip('/')}/quill-{uuid.uuid4().hex}"


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def _shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, not when the driver happens to collect garbage. The session's own setting
    is back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def stored(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there and lost executors lose none of it."""
    spark = spark or df.sparkSession
    path = scratch(spark)
    with _shuffles_cleared(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table that stored() returned and that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def binary_column(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes first[i], first[i] + 1, ... (count[i] of them) one after the other."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)


#: Bytes of labelled texts of each label that are learnt from at most, as the driver learns from whole texts.
SAMPLE_BYTES = 32 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> tuple[list, float]:
    """(rows, shift): rows (doc_id, text, y) of each label that may be learnt from, the same ones on every run: those with the least hashes of their ids,
    at most `most` of a label, and as many of them as have SAMPLE_BYTES of text together (a longer text alone is left out).
    shift: the log odds of label 1 among all labels that may be learnt from less those among the rows. A model learnt from the rows adds it
    to its own log odds, so that the bounds don't change how often it says 1.

    Rows without a label are left out, and of a repeated id the least text counts. held_out is a condition on doc_id; such rows are never taken.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.withColumn("rank", F.xxhash64("doc_id"))
    picked = known.where("y = 0").orderBy("rank", "doc_id").limit(most).union(known.where("y = 1").orderBy("rank", "doc_id").limit(most))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")  # 2 * most rows at most
    sizes = texts.groupBy("doc_id", "y", "rank").agg(F.max(F.octet_length("text")).cast("long").alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES)
    sizes = sizes.withColumn("upto", F.sum("bytes").over(W.partitionBy("y").orderBy("rank", "doc_id"))).where(F.col("upto") <= SAMPLE_BYTES)  # `most` rows a label
    few = [r.doc_id for r in sizes.collect()]
    rows = texts.where(F.col("doc_id").isin(few)).groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y").collect()
    all_ = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    own = {y: sum(r.y == y for r in rows) for y in (0, 1)}
    shift = math.log(all_[1] / all_[0]) - math.log(own[1] / own[0]) if own[0] and own[1] else 0.0
    return sorted(rows, key=lambda r: r.doc_id), shift


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k
