"""Tagged text corpora, topics, stop words, and the bulk JSON form of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkquill.functions.text import decode_entities
from sparkquill.operators.tables import in_order, settled

_TAG = r"<([a-zA-Z]*)>(.*)</[a-zA-Z]*>"


def tag_name(line: Column) -> Column:
    """The name of the first one-line tag, empty if there is none. Its closing name needn't agree."""
    return F.regexp_extract(line, _TAG, 1)


def tag_value(line: Column) -> Column:
    return F.regexp_extract(line, _TAG, 2)


#: What starts a document where a line starts.
_START = "<DOCNO>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, parent, text) of tagged files: a line that starts with <DOCNO> starts a document, PARENT is its metadata, other one-line
    tags and plain lines are its text; lines that only open or close a tag and blank lines are dropped. Lines are joined by a space. The
    last document of a file is kept. Lines before a file's first document belong to none, nor does a document whose DOCNO line doesn't
    close the tag. A name that comes again is that of the last file (by path) and place in it.

    Records end where the next document starts, so a large file is read by many tasks, each of which takes the records that start in its
    block, and a document is put together where it is read. Only the names that repeat, with their last places, are looked up afterwards.
    """
    rows = spark.read.option("lineSep", f"\n{_START}").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")]
    started = F.col("value").startswith(_START)  # only a file's first record still has its start
    lines = F.split(F.regexp_replace(F.when(started, F.col("value")).otherwise(F.concat(F.lit(_START), F.col("value"))), r"\r\z", ""), "\r?\n")
    rows = rows.select(*place, started.alias("started"), lines.alias("lines"))

    def content(line: Column) -> Column:
        tag = tag_name(line)
        return F.when(~line.startswith("<"), line).when(tag.isin("DOCNO", "PARENT", ""), None).otherwise(tag_value(line))

    head = F.get("lines", F.lit(0))
    parent = F.array_max(F.transform(F.filter("lines", lambda x: x.startswith("<") & (tag_name(x) == "PARENT")), lambda x: F.trim(tag_value(x))))
    text = F.array_join(F.filter(F.transform(F.filter("lines", lambda x: ~x.isin("", " ")), content), lambda x: x.isNotNull()), " ")
    parsed = settled(rows.select("file", "block", "n", "started", F.when(tag_name(head) == "DOCNO", F.trim(tag_value(head))).alias("doc_name"), parent.alias("parent"), decode_entities(text).alias("text")))
    # what stands before a file's first start is a record as well, the first one of its first block
    before = parsed.where("block = 0").groupBy("file").agg(F.min_by(F.struct("n", "started"), "n").alias("r")).where("not r.started").select("file", F.col("r.n").alias("n"))
    named = parsed.where("doc_name is not null").join(settled(before), ["file", "n"], "left_anti")
    again = named.groupBy("doc_name").agg(F.count("*").alias("times"), F.max(F.struct("file", "block", "n")).alias("last")).where("times > 1")
    newest = named.join(settled(again.select("doc_name", "last")), "doc_name", "left").where(F.col("last").isNull() | (F.struct("file", "block", "n") == F.col("last")))
    return newest.select("doc_name", "parent", "text")


def document_list(corpus: DataFrame) -> DataFrame:
    """(doc_id, doc_name): ids from 0 in the order of names."""
    return in_order(corpus.select("doc_name").distinct(), "doc_name", "doc_id")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, title, narrative) of topic files; narrative keeps its line breaks, null if there is none."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"</top>")).alias("b")).where(F.col("b").contains("<num>"))
    grab = lambda p: F.regexp_extract("b", p, 1)
    narrative = grab(r"(?s)<narr> Narrative[^\n]*\n(.*)$")
    return blocks.select(grab(r"<num> Number: ([0-9]+)").cast("int").alias("qid"), F.trim(grab(r"<title> Topic: ([^\n]+)")).alias("title"), F.when(F.col("b").contains("<narr>"), narrative).alias("narrative"))


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """The words of a stop-word file, one a line. Such a list is small and goes into expressions."""
    return sorted({r.value.strip() for r in spark.read.text(path).collect()} - {""})


def bulk_lines(docs: DataFrame) -> DataFrame:
    """(line_no, value) lines of a bulk load: an action with the id, then the document."""
    action = F.to_json(F.struct(F.struct(F.col("doc_id").cast("string").alias("_id")).alias("index")))
    body = F.to_json(F.struct(F.col("doc_name"), F.col("text")))
    return docs.select("doc_id", F.posexplode(F.array(action, body)).alias("line_no", "value"))


def write_bulk(docs: DataFrame, path: str) -> None:
    bulk_lines(docs).sortWithinPartitions("doc_id", "line_no").select("value").write.mode("overwrite").text(path)
