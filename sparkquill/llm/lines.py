"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded with their places and hashed by their keys: a line without white space at its ends, A-Z as a-z. Only places and 128-bit
hashes are shuffled, never the lines. Keys that occur often enough at all are counted by distinct documents, and the places of the lines
that go meet their document once, where the others are put together again by place. A hot key is pre-aggregated where it is read, and
the joins by key and by document are ones whose hot keys Spark splits, as each key has one row on their other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkquill.functions.text import let
from sparkquill.llm.batches import drop_stored, fresh, stored

#: What is stripped at both ends of a line.
ENDS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ENDS)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _places(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, sig, place, h1, h2): the lines with a key of at least min_chars code points. sig tells texts of one id apart."""
    rows = docs.select("id", "sig", F.posexplode(_lines(F.col("text"))).alias("place", "line")).select("id", "sig", "place", line_key(F.col("line")).alias("k"))
    return rows.where(F.length("k") >= min_chars).select("id", "sig", "place", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(11), "k").alias("h2"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay as text_col, and with n_lines (before) and n_dropped; a column of docs that has one of these two
    names is replaced, others may have any names.

    A key of at least min_chars code points that at least min_docs documents have loses all its lines except in the document with the
    greatest id that has it. A null text counts as an empty one, which is one empty line; a text that loses all lines becomes empty. Rows
    of one id are one document, whose lines stay or go alike; rows of null id are one document that comes before all others. Repeated rows
    get equal results. An empty table gives an empty table.
    """
    id_, sig, text, places, lines = (fresh(x, docs) for x in ("id", "sig", "text", "places", "lines"))
    own = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), own.alias("text")).withColumn("sig", F.xxhash64("text"))
    every = stored(_places(rows, min_chars))
    often = every.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")
    often = stored(often)  # written, so that its join with the lines is one of two shuffled sides (or a broadcast of known size)
    some = stored(every.join(often, ["h1", "h2"]))
    drop_stored(every)
    drop_stored(often)
    documents = F.countDistinct("id") + F.max(F.col("id").isNull().cast("int"))
    shared = some.groupBy("h1", "h2").agg(documents.alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).drop("n")
    shared = stored(shared)
    gone = some.join(shared, ["h1", "h2"]).where(F.col("id").isNull() | (F.col("id") < F.col("last")))
    gone = stored(gone.groupBy("id", "sig").agg(F.collect_set("place").alias("places")))
    drop_stored(some)
    drop_stored(shared)
    gone = gone.select(F.col("id").alias(id_), F.col("sig").alias(sig), F.col("places").alias(places))
    wide = docs.drop(*[c for c in ("n_lines", "n_dropped") if c in docs.columns])
    met = wide.join(gone, wide[id_col].eqNullSafe(gone[id_]) & (F.xxhash64(own) == gone[sig]), "left")
    kept = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(places)), lambda i: F.get(x, i)), "\n")
    left = F.when(F.col(places).isNull(), own).otherwise(let(_lines(own), kept))
    n_lines = F.size(_lines(own)).cast("long")
    return met.select(*[left.alias(c) if c == text_col else F.col(f"`{c}`") for c in wide.columns], n_lines.alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup_audit(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the UTF-8 of the lines that stay) of each row; edges as in drop_repeated_lines."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return drop_repeated_lines(rows, min_docs, min_chars).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
