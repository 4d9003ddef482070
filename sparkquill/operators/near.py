"""Places of words near each other: counts from positional postings, and a partial index of the pairs that are asked for most.

The places of all words that are asked for meet by document, one shuffle of them however many pairs a word is in.
An index can keep such pairs (`keep_pairs`): a row for each pair and document with the number of close places and the document's length,
laid out by a hash of the first word as postings are by their term. Pairs that are kept are read from there, all others are counted from
their places, so the rows are the same whatever is kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkquill.operators.index import Index, bucket_of, pruned
from sparkquill.operators.tables import read_text, settled, write_text

NEAR = 100
#: A row's places are below 2**31; each row of a batch has a range of its own on one line, wide enough for a place and `near` on both sides.
_ROW, _WIDEST = 1 << 33, 1 << 32


def close_places(p1: Column, p2: Column, near: int) -> Column:
    """How many pairs of one place of each array are closer than `near`. Arrow, since Spark's own lambdas are interpreted: the places of all rows of
    a batch lie on one line, and two binary searches for each place of p1 count those of p2 around it, whatever the arrays' lengths."""
    near = min(near, _WIDEST)

    @F.arrow_udf(T.LongType())
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        left, sizes = _on_a_line(a)
        right, _ = _on_a_line(b)
        right.sort(kind="stable")
        around = np.searchsorted(right, left + near, "left") - np.searchsorted(right, left - near, "right")
        sums = np.concatenate([[0], np.cumsum(np.maximum(around, 0))])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.array(np.diff(sums))

    return count(p1, p2)


#: Pairs that are asked for up to which tasks get them all and meet a document's places there; more pairs meet by joins.
FEW_PAIRS = 200_000
#: Places that are searched at once, so that they stay in a processor's cache; a document with more is a stretch of its own.
PLACES = 100_000


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _on_a_line(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of a batch's rows, each row's in its own range, and how many each row has."""
    sizes = _sizes(lists)
    places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return places + np.repeat(np.arange(len(sizes), dtype=np.int64) * _ROW, sizes), sizes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one row's after the other."""
    return np.arange(sizes.sum(), dtype=np.int64) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _close(line: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, near: int, compat_window: bool = False) -> np.ndarray:
    """How many pairs of one place of row a[i] and one of row b[i] are closer than `near`, for each i. Two binary searches for each place of the row
    with fewer places count the other's around it. compat_window: places of b at exactly `near` after one of a don't count, so b's are searched for."""
    near = min(near, _WIDEST)
    starts = np.cumsum(sizes) - sizes
    own, other = (b, a) if compat_window else (np.where(sizes[a] <= sizes[b], a, b), np.where(sizes[a] <= sizes[b], b, a))
    at = line[_spread(starts[own], sizes[own])] + np.repeat((other - own) * _ROW, sizes[own])
    around = np.searchsorted(line, at + near, "left") - np.searchsorted(line, at - near, "right")
    if compat_window:
        k = np.searchsorted(line, at - near, "left")
        around[line[np.minimum(k, len(line) - 1)] == at - near] = 0
    sums = np.concatenate([[0], np.cumsum(np.maximum(around, 0))])
    ends = np.cumsum(sizes[own])
    return sums[ends] - sums[ends - sizes[own]]


def pairs_met(doc: np.ndarray, word: np.ndarray, line: np.ndarray, sizes: np.ndarray, begins: np.ndarray, second: np.ndarray, near: int, compat_window: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (document, word) with their places on a line: each pair whose words a document has, the row of its first word, and how many places
    are close. Pairs are sorted by first word, begins says where each word's are; second has their other words."""
    words = len(begins) - 1
    key = doc * words + word
    by_key = np.argsort(key, kind="stable")
    key = key[by_key]
    many = begins[word + 1] - begins[word]
    pair, a = _spread(begins[word], many), np.repeat(np.arange(len(word), dtype=np.int64), many)
    want = doc[a] * words + second[pair]
    k = np.minimum(np.searchsorted(key, want), len(key) - 1)
    met = key[k] == want
    pair, a, b = pair[met], a[met], by_key[k[met]]
    return pair, a, _close(line, sizes, a, b, near, compat_window)


def counted(pairs: DataFrame, index: Index, near: int, compat_window: bool) -> DataFrame:
    """(first, second, doc_id, dl, near) of written pairs from the places of their words. The places of all words that are asked for are shuffled
    once, by document; where a document's places are, its pairs are counted."""
    wanted = index.wanted(pairs.select(F.explode(F.array("first", "second")).alias("term")))
    asked = pairs.limit(FEW_PAIRS + 1).collect()
    if len(asked) > FEW_PAIRS:
        return _joined(pairs, index.places_of(wanted), near, compat_window)
    words = sorted({w for r in asked for w in (r.first, r.second)})
    number = {w: k for k, w in enumerate(words)}
    spark = pairs.sparkSession
    terms = spark.createDataFrame(pa.table({"term": pa.array(words, pa.string()), "word": pa.array(range(len(words)), pa.int32())}))
    named = spark.createDataFrame(pa.table({"pair": pa.array(range(len(asked)), pa.int32()), "first": pa.array([r.first for r in asked], pa.string()), "second": pa.array([r.second for r in asked], pa.string())}))
    order = sorted(range(len(asked)), key=lambda k: number[asked[k].first])
    ids = np.array(order, np.int32)
    first, second = (np.array([number[asked[k][c]] for k in order], np.int64) for c in (0, 1))
    places = index.places_of(wanted).join(F.broadcast(terms), "term").select("word", "doc_id", "dl", "positions")
    places = places.repartition("doc_id").sortWithinPartitions("doc_id")
    types = {f.name: f.dataType for f in places.schema}
    rows = places.mapInArrow(_pairs_of_documents(ids, first, second, len(words), near, compat_window), T.StructType([T.StructField("pair", T.IntegerType()), *(T.StructField(c, types[c]) for c in ("doc_id", "dl")), T.StructField("near", T.LongType())]))
    return rows.join(F.broadcast(named), "pair").select("first", "second", "doc_id", "dl", "near")


def _pairs_of_documents(ids: np.ndarray, first: np.ndarray, second: np.ndarray, words: int, near: int, compat_window: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (word, doc_id, dl, positions), a document's rows one after the other, to (pair, doc_id, dl, near). Pairs are numbered by ids and sorted by
    their first word."""
    begins = np.searchsorted(first, np.arange(words + 1))

    def count(rows: pa.RecordBatch, doc: np.ndarray) -> pa.RecordBatch:
        word = rows.column("word").to_numpy(zero_copy_only=False).astype(np.int64)
        line, sizes = _on_a_line(rows.column("positions"))
        pair, a, close = pairs_met(doc, word, line, sizes, begins, second, near, compat_window)
        at = pa.array(a)
        return pa.RecordBatch.from_arrays([pa.array(ids[pair]), rows.column("doc_id").take(at), rows.column("dl").take(at), pa.array(close, pa.int64())], ["pair", "doc_id", "dl", "near"])

    def documents(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        """Whole documents counted, some at once; then what may go on in the next batch."""
        batch = table.combine_chunks().to_batches()[0]
        doc = batch.column("doc_id").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
        ends = np.concatenate([[0], np.cumsum(_sizes(batch.column("positions")))])[edges]
        whole = len(edges) - (1 if last else 2)
        at = 0
        while at < whole:
            to = min(whole, max(at + 1, int(np.searchsorted(ends, ends[at] + PLACES, "right")) - 1))
            yield count(batch.slice(edges[at], edges[to] - edges[at]), doc[edges[at] : edges[to]] - doc[edges[at]])
            at = to
        yield pa.Table.from_batches([batch.slice(edges[whole])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                own = pa.Table.from_batches([batch])
                *done, held = documents(own if held is None else pa.concat_tables([held, own]), False)
                yield from done
        if held is not None and held.num_rows:
            *done, _ = documents(held, True)
            yield from done

    return run


def _joined(pairs: DataFrame, places: DataFrame, near: int, compat_window: bool) -> DataFrame:
    """counted, by joins of the places of either word: for any number of pairs."""

    a = places.select(F.col("term").alias("first"), "doc_id", "dl", F.col("positions").alias("p1")).join(pairs, "first")
    b = places.select(F.col("term").alias("second"), "doc_id", F.col("positions").alias("p2")).join(pairs.select("second").distinct(), "second", "left_semi")
    p2 = F.array_except(F.col("p2"), F.transform("p1", lambda p: p + near)) if compat_window else F.col("p2")
    return a.join(b, ["second", "doc_id"]).select("first", "second", "doc_id", "dl", close_places(F.col("p1"), p2, near).alias("near"))


def pair_rows(pairs: DataFrame, index: Index, near: int = NEAR, compat_window: bool = False) -> DataFrame:
    """(first, second, doc_id, dl, near): for word pairs, in each document with both words how many places of theirs are closer than `near`, and
    the document's length. Kept pairs, if they were counted in the same way, are read; the others are counted."""
    pairs = settled(pairs.select("first", "second").where("first is not null and second is not null").distinct())
    kept = kept_pairs(index, pairs, near, compat_window)
    if kept is None:
        return counted(pairs, index, near, compat_window)
    known = settled(kept.join(pairs, ["first", "second"], "left_semi").select("first", "second"))
    rest = settled(pairs.join(known, ["first", "second"], "left_anti"))
    wanted = index.wanted(known.select(F.col("first").alias("term")))
    read = pruned(index.pairs["rows"], wanted, "first").select("first", "second", "doc_id", "dl", "near").join(known, ["first", "second"], "left_semi")
    return read if rest.isEmpty() else read.unionByName(counted(rest, index, near, compat_window))


def kept_pairs(index: Index, pairs: DataFrame, near: int, compat_window: bool) -> DataFrame | None:
    """(first, second, df) of the pairs that the index keeps counted in this way, and more perhaps; None if it keeps none."""
    if not index.pairs or index.pairs["how"] != [near, compat_window]:
        return None
    return pruned(index.pairs["lexicon"], index.wanted(pairs.select(F.col("first").alias("term"))), "first").select("first", "second", "df")


def pair_counts(pairs: DataFrame, index: Index, near: int = NEAR, compat_window: bool = False) -> DataFrame:
    """(first, second, doc_id, near): pair_rows without lengths. compat_window: places of the second word at exactly `near` after one of the first
    don't count. Pairs with a null, and pairs of words that no document has together, have no rows."""
    return pair_rows(pairs, index, near, compat_window).select("first", "second", "doc_id", "near")


def commonest_pairs(asked: DataFrame, index: Index, most: int) -> DataFrame:
    """(first, second): of the pairs (first, second) that topics ask for, one row for each time, the `most` that cost most to count: times asked,
    by the number of documents that have the rarer of both words; ties by the words. Pairs of unknown words are none of them."""
    times = asked.where("first is not null and second is not null").groupBy("first", "second").agg(F.count("*").alias("times"))
    df = lambda name: index.lexicon.select(F.col("term").alias(name), F.col("df").alias(f"{name}_df"))
    cost = F.col("times") * F.least("first_df", "second_df")
    return times.join(df("first"), "first").join(df("second"), "second").orderBy(cost.desc(), "first", "second").limit(most).select("first", "second")


def keep_pairs(index: Index, pairs: DataFrame, near: int = NEAR, compat_window: bool = False) -> Index:
    """Counts the pairs in all documents and keeps them with a saved positional index, in place of those that it kept before; gives the index
    with them. Readers that loaded the index earlier go on as before. Pairs that no document has are kept as such."""
    if index.path is None:
        raise ValueError("pairs are kept with a saved index")
    spark, folder = index.postings.sparkSession, f"{index.path}/pairs-{uuid.uuid4().hex}"
    pairs = settled(pairs.select("first", "second").where("first is not null and second is not null").distinct())
    laid = counted(pairs, index, near, compat_window).withColumn("bucket", bucket_of(F.col("first"), index.buckets))
    laid.hint("rebalance", "bucket").sortWithinPartitions("bucket", "first", "second", "doc_id").write.partitionBy("bucket").parquet(f"{folder}/rows")
    df = spark.read.schema(laid.schema).parquet(f"{folder}/rows").groupBy("first", "second").agg(F.count("*").alias("df"))
    lexicon = pairs.join(df, ["first", "second"], "left").select("first", "second", F.coalesce("df", F.lit(0)).alias("df"), bucket_of(F.col("first"), index.buckets).alias("bucket"))
    lexicon.repartition("bucket").sortWithinPartitions("bucket", "first", "second").write.partitionBy("bucket").parquet(f"{folder}/lexicon")
    made = json.loads(read_text(spark, f"{index.path}/index.json"))
    made["pairs"] = {"folder": folder.rsplit("/", 1)[1], "how": [near, compat_window], "schemas": {"rows": laid.schema.jsonValue(), "lexicon": lexicon.schema.jsonValue()}}
    write_text(spark, f"{index.path}/index.json", json.dumps(made))
    return Index.load(spark, index.path)
