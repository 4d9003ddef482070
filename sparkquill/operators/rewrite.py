"""Query rewriting: reduction, pseudo-relevance expansion, Rocchio feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sparkquill.operators.index import Index
from sparkquill.operators.rank import query_weights
from sparkquill.operators.tables import settled


def reduce_query(query: DataFrame, index: Index, threshold: float, key: str = "qtf") -> DataFrame:
    """The best floor(n * threshold) of a query's n known terms by qtf, idf or qtf_idf, as a bag (each term once for idf)."""
    if key not in ("qtf", "idf", "qtf_idf"):
        raise ValueError(f"no such key: {key}")
    rows = query.join(index.idf_of(index.wanted(query)).select("term", "idf"), "term")
    value = {"qtf": F.col("qtf").cast("double"), "idf": F.round("idf", 6), "qtf_idf": F.round(F.col("qtf") * F.col("idf"), 6)}[key]
    n = F.count("*").over(W.partitionBy("qid"))
    rn = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("value"), "term"))
    kept = rows.withColumn("value", value).withColumn("n", n).withColumn("rn", rn).where(F.col("rn") <= F.floor(F.col("n") * threshold))
    return kept.select("qid", "term", (F.lit(1).cast("long") if key == "idf" else F.col("qtf")).alias("qtf"))


def feedback_documents(run: DataFrame, n: int, top: bool = True) -> DataFrame:
    """(qid, doc_id) of the first n, or the last n, of each ranked list, or of one that has at least these two ends."""
    if top:
        return run.where(F.col("rank") < n).select("qid", "doc_id")
    total = run.groupBy("qid").agg(F.max("rank").alias("last"))
    return run.join(total, "qid").where(F.col("rank") > F.col("last") - n).select("qid", "doc_id")


def expand(run: DataFrame, index: Index, documents: int = 10, terms: int = 10, criteria: str = "tfidf") -> DataFrame:
    """A new query of the best terms of the first documents, each once: by sum of tf * idf, or number of documents * idf (dfidf)."""
    chosen = settled(feedback_documents(run, documents))
    rows = index.postings.select("doc_id", "term", "tf").join(chosen, "doc_id").groupBy("qid", "term").agg((F.sum("tf") if criteria == "tfidf" else F.count("*")).alias("n"))
    scored = rows.join(index.idf.select("term", "idf"), "term").select("qid", "term", F.round(F.col("n") * F.col("idf"), 6).alias("score"))
    rn = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rn", rn).where(F.col("rn") <= terms).select("qid", "term", "score", F.lit(1).cast("long").alias("qtf"))


def _centroid(docs: DataFrame, index: Index) -> DataFrame:
    """(qid, term, w): the mean of the documents' vectors, each divided by its sum of squares. Only these documents' postings are weighed."""
    n = docs.groupBy("qid").agg(F.count("*").alias("n"))
    docs = settled(docs.join(index.norms(), "doc_id").join(n, "qid"))
    rows = index.postings.select("doc_id", "term", "tf").join(docs, "doc_id").join(index.idf.select("term", "idf"), "term")
    w = F.coalesce(F.try_divide((F.log10("tf") + 1) * F.col("idf"), F.col("dn")), F.lit(0.0))
    return rows.groupBy("qid", "term", "n").agg(F.sum(w).alias("w")).select("qid", "term", (F.col("w") / F.col("n")).alias("w"))


def rocchio(query: DataFrame, run: DataFrame, index: Index, alpha: float = 1.0, beta: float = 10.0, gamma: float = 0.0, n: int = 10, keep: int = 10) -> DataFrame:
    """(qid, term, w): alpha times the query's own weights, and beta times the centroid of the first n documents for terms that the
    query does not have (less gamma times that of the last n). Weights of at least the keep-th largest stay, ties included."""
    own = settled(query_weights(query, index))
    norm = own.groupBy("qid").agg(F.sum(F.col("w") * F.col("w")).alias("qn"))
    first = own.join(norm, "qid").select("qid", "term", (F.coalesce(F.try_divide(F.col("w"), F.col("qn")), F.lit(0.0)) * alpha).alias("w"))
    new = _centroid(feedback_documents(run, n), index).withColumn("w", F.col("w") * beta)
    if gamma:
        new = new.union(_centroid(feedback_documents(run, n, top=False), index).withColumn("w", F.col("w") * -gamma)).groupBy("qid", "term").agg(F.sum("w").alias("w"))
    vector = first.union(new.join(own.select("qid", "term"), ["qid", "term"], "left_anti")).withColumn("w", F.round("w", 6))
    return vector.withColumn("rk", F.rank().over(W.partitionBy("qid").orderBy(F.desc("w")))).where(F.col("rk") <= keep).drop("rk")
