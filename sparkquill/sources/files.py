"""Runs, judgements, reports, search hits, and comma-separated indexes of other builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkquill.operators.index import Index, frequent_terms
from sparkquill.operators.tables import join_files, scratch

HITS = "struct<hits:struct<hits:array<struct<_id:string,_score:double,_source:struct<doc_name:string,text:string>>>>>"


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, iter, doc_name, rank, score, tag) of a run file with one or more spaces between its fields."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(f[0].cast("int").alias("qid"), f[1].cast("int").alias("iter"), f[2].alias("doc_name"), f[3].cast("int").alias("rank"), f[4].cast("double").alias("score"), f[5].alias("tag"))


def write_run(run: DataFrame, path: str) -> None:
    """Writes qid, iter, doc_name, rank, score and tag, one space apart, in order of query and rank, to one file. Ranges are sorted and written
    by tasks, and their files are joined end to end."""
    line = F.concat_ws(" ", "qid", F.lit("0"), "doc_name", "rank", "score", "tag")
    parts = scratch(run.sparkSession)
    run.repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank").select(line.alias("value")).write.text(parts)
    join_files(run.sparkSession, parts, path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, iter, doc_name, rel)."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].cast("int").alias("qid"), f[1].cast("int").alias("iter"), f[2].alias("doc_name"), f[3].cast("int").alias("rel"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of an evaluation report: counts, precision at documents and at recall levels, averages."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"))
    number = r"(-?[0-9]*\.?[0-9]+)\s*$"
    name = (
        F.when(F.col("v").rlike(r"^at\s+[0-9.]+"), F.concat(F.lit("iprec_"), F.format_number(F.regexp_extract("v", r"^at\s+([0-9.]+)", 1).cast("double"), 1)))
        .when(F.col("v").rlike(r"^At\s+[0-9]+ docs"), F.concat(F.lit("p_"), F.regexp_extract("v", r"^At\s+([0-9]+)", 1)))
        .when(F.col("v").rlike(r"^Exact:"), F.lit("r_precision"))
        .when(F.col("v").rlike(r"^Queryid"), F.lit("queries"))
        .when(F.col("v").rlike(r"^(Retrieved|Relevant|Rel_ret):"), F.lower(F.regexp_extract("v", r"^(\w+):", 1)))
        .when(F.col("v").rlike(rf"^{number}"), F.lit("map"))
    )
    rows = lines.select(name.alias("metric"), F.regexp_extract("v", number, 1).alias("n")).where("metric is not null and n <> ''")
    return rows.select("metric", F.col("n").cast("double").alias("value"))


def read_query_report(spark: SparkSession, path: str) -> DataFrame:
    """(qid, metric, value) of a report with a part for each query: ap and r_precision of each. A part begins with a line that names its
    query (``Queryid (Num): N``); the lines of a file are numbered by one task, as a report is small."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?=Queryid \(Num\):)")).alias("part"))
    number = lambda p: F.regexp_extract("part", p, 1)
    qid = number(r"Queryid \(Num\):\s+([0-9]+)")
    rows = lines.where(qid != "").select(qid.cast("int").alias("qid"), F.explode(F.array(F.struct(F.lit("ap").alias("metric"), number(r"(?m)^\s+([0-9]*\.[0-9]+)\s*$").alias("v")), F.struct(F.lit("r_precision").alias("metric"), number(r"Exact:\s+([0-9]*\.[0-9]+)").alias("v")))).alias("m"))
    return rows.select("qid", "m.metric", "m.v").where("v <> ''").select("qid", "metric", F.col("v").cast("double").alias("value"))


def parse_hits(payloads: DataFrame, tag: str = "ElasticSearch") -> DataFrame:
    """(qid, doc_name, rank, score, tag) from saved search answers (qid, body)."""
    hits = payloads.select("qid", F.posexplode(F.from_json("body", HITS)["hits"]["hits"]).alias("rank", "h"))
    return hits.select("qid", F.trim("h._source.doc_name").alias("doc_name"), F.col("rank").cast("long").alias("rank"), F.col("h._score").alias("score"), F.lit(tag).alias("tag"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term_id long, term string, df long").csv(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, doc_name string").csv(path).withColumn("doc_name", F.trim("doc_name"))


def _named(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    return rows.join(lexicon.select("term_id", "term"), "term_id").drop("term_id")


def read_ragged_index(spark: SparkSession, path: str, lexicon: DataFrame) -> Index:
    """An index with a line for each term: its id, then document and count in turn."""
    v = F.split("value", ",")
    pairs = F.transform(F.sequence(F.lit(1), F.size(v) - 2, F.lit(2)), lambda i: F.struct(F.get(v, i).cast("long").alias("doc_id"), F.get(v, i + 1).cast("long").alias("tf")))
    return Index(_named(spark.read.text(path).where(F.size(v) > 2).select(v[0].cast("long").alias("term_id"), F.inline(pairs)), lexicon).select("term", "doc_id", "tf"))


def read_posting_rows(spark: SparkSession, path: str, lexicon: DataFrame) -> Index:
    """An index with a line for each term and document: term id, document, count (phrase indexes)."""
    return Index(_named(spark.read.schema("term_id long, doc_id long, tf long").csv(path), lexicon).select("term", "doc_id", "tf"))


def read_positional_index(spark: SparkSession, path: str, lexicon: DataFrame) -> Index:
    """An index with a line for each term and document: term id, document, positions."""
    v = F.split("value", ",")
    positions = F.slice(v, 3, F.size(v)).cast("array<int>")
    rows = spark.read.text(path).where(F.trim("value") != "").select(v[0].cast("long").alias("term_id"), v[1].cast("long").alias("doc_id"), positions.alias("positions"))
    return Index(_named(rows, lexicon).select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions"))


def write_lexicon(index: Index, path: str) -> None:
    index.lexicon_ids().sortWithinPartitions("term_id").write.mode("overwrite").csv(path)


def _with_ids(index: Index) -> DataFrame:
    """The postings with term ids in place of terms."""
    return index.postings.join(index.lexicon_ids().select("term_id", "term"), "term")


def _lines(rows: DataFrame, path: str, *fields: Column) -> None:
    rows.repartitionByRange("term_id", "doc_id").sortWithinPartitions("term_id", "doc_id").select(F.concat_ws(",", *fields).alias("value")).write.mode("overwrite").text(path)


def write_ragged_index(index: Index, path: str) -> None:
    """The form that read_ragged_index reads. A term's line is put together from chunks; a term of more than CHUNK documents has a line
    for each chunk, which the reader takes as well."""
    ids = index.lexicon_ids().select("term_id", "term")
    entry = F.flatten(F.transform("entries", lambda e: F.array(e.doc_id.cast("string"), e.tf.cast("string"))))
    index.grouped().join(ids, "term").repartitionByRange("term_id", "chunk").sortWithinPartitions("term_id", "chunk").select(F.concat_ws(",", F.col("term_id").cast("string"), entry).alias("value")).write.mode("overwrite").text(path)


def write_positional_index(index: Index, path: str) -> None:
    """The form that read_positional_index reads: a line for each term and document."""
    _lines(_with_ids(index), path, F.col("term_id").cast("string"), F.col("doc_id").cast("string"), F.col("positions").cast("array<string>"))


def write_posting_rows(index: Index, path: str, least: int = 1) -> None:
    """The form that read_posting_rows reads, of the terms that at least `least` documents have. Term ids are those of these terms alone."""
    if least > 1:
        index = Index(frequent_terms(index.postings, least))
    _lines(_with_ids(index), path, F.col("term_id").cast("string"), F.col("doc_id").cast("string"), F.col("tf").cast("string"))


def write_documents(documents: DataFrame, path: str) -> None:
    """The document list (doc_id, doc_name) in the form that read_documents reads."""
    documents.select("doc_id", "doc_name").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").csv(path)


def write_index(index: Index, documents: DataFrame, folder: str, kind: str) -> None:
    """Index, lexicon and document list of a kind as comma-separated files of one folder."""
    write = {"positional": write_positional_index, "phrase": write_posting_rows}.get(kind, write_ragged_index)
    write(index, f"{folder}/{kind}.index")
    write_lexicon(index, f"{folder}/{kind}.lexicon")
    write_documents(documents, f"{folder}/document_list.csv")


def load_index(spark: SparkSession, folder: str, kind: str) -> tuple[Index, DataFrame]:
    """An index of a kind with lexicon and lengths, and the document list, from comma-separated files of one folder. What the models read
    is worked out once and kept as tables."""
    lexicon = read_lexicon(spark, f"{folder}/{kind}.lexicon")
    read = {"positional": read_positional_index, "phrase": read_posting_rows}.get(kind, read_ragged_index)
    return read(spark, f"{folder}/{kind}.index", lexicon).save(scratch(spark)), read_documents(spark, f"{folder}/document_list.csv")
