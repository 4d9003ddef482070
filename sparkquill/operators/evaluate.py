"""Retrieval measures from a run and relevance judgements.

Means are taken over the queries that are in both. run: (qid, doc_id, rank); qrels: (qid, doc_id, rel).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RECALLS = tuple(i / 10 for i in range(11))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run's rows of judged queries with rel (0 if not judged), R (relevant documents of the query) and hits (relevant ones so far)."""
    good = qrels.where("rel > 0").select("qid", "doc_id").distinct()
    total = good.groupBy("qid").agg(F.count("*").alias("R"))
    rows = run.select("qid", "doc_id", "rank").join(total, "qid").join(good.withColumn("rel", F.lit(1)), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return rows.withColumn("hits", F.sum("rel").over(W.partitionBy("qid").orderBy("rank")))


def counts(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: queries, retrieved, relevant, rel_ret."""
    each = judged(run, qrels).groupBy("qid").agg(F.count("*").alias("retrieved"), F.first("R").alias("relevant"), F.sum("rel").alias("rel_ret"))
    return each.agg(F.count("*").alias("queries"), F.sum("retrieved").alias("retrieved"), F.sum("relevant").alias("relevant"), F.sum("rel_ret").alias("rel_ret"))


def by_query(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, metric, value): average precision, R-precision, precision at cutoffs, interpolated precision at recall levels."""
    rows = judged(run, qrels).withColumn("precision", F.col("hits") / (F.col("rank") + 1))
    at = [F.sum(F.when(F.col("rank") < k, F.col("rel")).otherwise(0)) / k for k in CUTOFFS]
    levels = [F.coalesce(F.max(F.when(F.col("hits") / F.col("R") >= r - 1e-9, F.col("precision"))), F.lit(0.0)) for r in RECALLS]
    named = [("ap", F.sum(F.col("precision") * F.col("rel")) / F.first("R")), ("r_precision", F.sum(F.when(F.col("rank") < F.col("R"), F.col("rel")).otherwise(0)) / F.first("R"))]
    named += [(f"p_{k}", a) for k, a in zip(CUTOFFS, at, strict=True)] + [(f"iprec_{r:.1f}", v) for r, v in zip(RECALLS, levels, strict=True)]
    wide = rows.groupBy("qid").agg(*[v.cast("double").alias(f"m{i}") for i, (_, v) in enumerate(named)])
    return wide.select("qid", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, (n, _) in enumerate(named)])).alias("m")).select("qid", "m.metric", "m.value")


def means(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(metric, value): means over queries; that of ap is called map."""
    return by_query(run, qrels).groupBy(F.when(F.col("metric") == "ap", "map").otherwise(F.col("metric")).alias("metric")).agg(F.avg("value").alias("value"))


def report(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(metric, value): counts and means together."""
    names = ["queries", "retrieved", "relevant", "rel_ret"]
    long_ = counts(run, qrels).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    return long_.union(means(run, qrels))
