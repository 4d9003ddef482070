"""Ranking models. Query terms are (qid, term, qtf); a run is (qid, doc_id, rank, score, tag) with ranks from 0.

Each model is one equi-join of query terms with postings and one sum for (query, document). The query terms with their statistics are
written first, so their size is known: while they are small Spark broadcasts them and the postings stay where they are; beyond that the
same join shuffles. They also prune the scan of the postings. The collection's totals are numbers in the expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from sparkquill.functions.text import adjacent_pairs
from sparkquill.operators.index import BLOCK_DOCS, Index, Wanted, block_of
from sparkquill.operators.near import NEAR, pair_rows
from sparkquill.operators.tables import settled


def query_bag(topics: DataFrame, words: Column) -> DataFrame:
    """(qid, term, qtf) from topics' word arrays."""
    return topics.select("qid", F.explode(words).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def known_terms(query: DataFrame, index: Index) -> DataFrame:
    """Query terms that the lexicon has, with its columns."""
    return query.join(index.lexicon_of(index.wanted(query)), "term")


def top_k(scores: DataFrame, k: int | None, tag: str, both_ends: int | None = None) -> DataFrame:
    """The best k documents of each query by score, then doc_id; all if k is None. Scores are rounded first, so that sums taken in
    another order give the same ranks. both_ends: only the first and the last so many of each query, with their ranks."""
    scores = scores.select("qid", "doc_id", F.round("score", 6).alias("score"))
    first = [F.desc("score"), F.col("doc_id")]
    named = [(F.col("rn") - 1).cast("long").alias("rank"), "score", F.lit(tag).alias("tag")]
    if both_ends is not None:
        scores = settled(_ends(scores, both_ends))
        pick = lambda order: scores.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("rn") <= both_ends)
        total = scores.groupBy("qid").agg(F.sum("n").alias("total"))
        last = pick([F.col("score"), F.desc("doc_id")]).join(total, "qid").withColumn("rn", F.col("total") + 1 - F.col("rn")).drop("total")
        return pick(first).unionByName(last).dropDuplicates(["qid", "rn"]).select("qid", "doc_id", *named)
    ranked = scores.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(*first)))
    if k is not None:
        ranked = ranked.where(F.col("rn") <= k)
    return ranked.select("qid", "doc_id", *named)


#: Rows that a task sorts at once to pick ends.
ROWS = 100_000


def _ends(scores: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, n): of each task's rows the first and the last k of each query, by score, then doc_id. n: one row of a query in a task
    has the number of all its rows there, the others 0."""

    def picked(table: pa.Table) -> pa.Table:
        keyed = table.append_column("nan", pc.is_nan(table["score"]))  # the greatest, as in Spark
        order = pc.sort_indices(keyed, [("qid", "ascending"), ("nan", "descending"), ("score", "descending"), ("doc_id", "ascending")])
        table = table.take(order).combine_chunks()
        codes = table["qid"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        sizes = np.diff(np.append(first, len(codes)))
        at = np.arange(len(codes)) - np.repeat(first, sizes)
        n = np.zeros(len(codes), np.int64)
        n[first] = np.add.reduceat(table["n"].to_numpy(), first)
        table = table.set_column(3, table.schema.field("n"), pa.array(n))
        return table.filter(pa.array((at < k) | (at >= np.repeat(sizes, sizes) - k)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        kept = 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= kept + ROWS:
                held = [picked(pa.concat_tables(held))]
                kept = held[0].num_rows
        if held:
            yield from picked(pa.concat_tables(held)).to_batches()

    rows = scores.select("qid", "doc_id", "score", F.lit(1).cast("long").alias("n"))
    return rows.mapInArrow(pick, rows.schema)


@dataclass
class Scoring:
    """A model's score of a document: finish(sum of weights of the terms that it has, its length, its norm). terms: written rows (qid, term,
    qtf, df, ...); weight is over their columns and grows with the count and falls with the length; whole: a row for each query with what
    finish needs besides. finish grows with the sum and falls with length and norm."""

    tag: str
    index: Index
    terms: DataFrame
    wanted: Wanted | None
    weight: Callable[[Column, Column], Column]
    finish: Callable[[Column, Column, Column], Column] = lambda s, dl, dn: s
    whole: DataFrame | None = None
    norms: bool = False
    lengths: DataFrame | None = None

    def rows(self) -> DataFrame:
        """(term, doc_id, tf, dl) of the queries' terms, dealt by document."""
        rows = self._met(self.index.postings_of(self.wanted), "doc_id")
        return rows if self.lengths is None else rows.drop("dl").join(self.lengths.select("doc_id", "dl"), "doc_id")

    def _met(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows of the queries' terms, dealt by the key over so many tasks that each has about SUMS sums of (query, document) at most. Spark by
        itself deals by the rows' bytes, which doesn't know how many queries ask for a term."""
        own = self.terms.agg(F.count_distinct("qid").alias("queries"), F.sum("df").alias("met")).first()
        sums = min(own.queries * (self.index.totals.N or 0), own.met or 0)
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-sums // SUMS)))
        return rows.join(self.terms.select("term").distinct(), "term", "left_semi").repartition(tasks, key)

    def _finished(self, sums: DataFrame) -> DataFrame:
        """(qid, ..., s, dl[, dn]) with the score."""
        if self.whole is not None:
            sums = sums.join(self.whole, "qid")
        return sums.withColumn("score", self.finish(F.col("s"), F.col("dl"), F.col("dn") if "dn" in sums.columns else F.lit(None)))

    def scores(self, rows: DataFrame | None = None, where: DataFrame | None = None) -> DataFrame:
        """(qid, doc_id, score, n) of all documents with one of the query's terms (n of them), or of those in the blocks (qid, block) alone."""
        # the terms' postings meet by document before they are multiplied by queries: the sums then stay where they are
        rows = (self.rows() if rows is None else self._met(rows, "doc_id")).join(self.terms, "term")
        if where is not None:
            rows = rows.withColumn("block", block_of(F.col("doc_id"))).join(where, ["qid", "block"], "left_semi")
        sums = rows.groupBy("qid", "doc_id").agg(F.sum(self.weight(F.col("tf"), F.col("dl"))).alias("s"), F.max("dl").alias("dl"), F.count("*").alias("n"))
        if self.norms:
            sums = sums.join(self.index.norms(), "doc_id")
        return self._finished(sums)

    def bounds(self) -> DataFrame:
        """(qid, block, most): what no document of the block scores more than. A term adds its weight at the block's greatest count and least
        length, or nothing if that is less."""
        if "blocks" in self.index.tables:
            rows = self.index.blocks_of(self.terms, self.wanted)
        else:  # made where the documents are
            dealt = self._met(self.index.postings_of(self.wanted).withColumn("block", block_of(F.col("doc_id"))), "block")
            rows = dealt.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        rows = rows.join(self.terms, "term")
        sums = rows.groupBy("qid", "block").agg(F.sum(F.greatest(self.weight(F.col("tf"), F.col("dl")), F.lit(0.0))).alias("s"), F.min("dl").alias("dl"))
        if self.norms:
            least = self.index.norms().groupBy(block_of(F.col("doc_id")).alias("block")).agg(F.min("dn").alias("dn"))
            sums = sums.join(least, "block")
        return self._finished(sums).select("qid", "block", F.col("score").alias("most"))

    def best(self, k: int | None, bounded: bool = False) -> DataFrame:
        """The run of the best k. bounded: documents of blocks that can't reach the k-th score aren't summed. A few blocks of each query, those
        with the greatest bounds, are scored first; their k-th score is the least that counts; blocks whose bound is below it are left out.
        The result is the same."""
        if not bounded or k is None:
            return top_k(self.scores(), k, self.tag)
        bounds = settled(self.bounds())
        seeds = bounds.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("most"), "block"))).where(F.col("rn") <= SEED_BLOCKS + k // BLOCK_DOCS)
        seeds = settled(seeds.select("qid", "block"))
        first = settled(top_k(self.scores(where=seeds), k, self.tag))
        least = first.where(F.col("rank") == k - 1).select("qid", F.col("score").alias("least"))
        rest = bounds.join(least, "qid", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - SLACK))
        rest = settled(rest.select("qid", "block").join(seeds, ["qid", "block"], "left_anti"))
        return top_k(self.scores(where=rest).select("qid", "doc_id", "score").unionByName(first.select("qid", "doc_id", "score")), k, self.tag)


#: Sums of (query, document) in a task, which hold some 100 bytes each in a few steps, and tasks at most.
SUMS, MOST_TASKS = 1_000_000, 20_000
#: Blocks of a query that are scored before a threshold is known, besides those that k documents fill.
SEED_BLOCKS = 4
#: Scores count with six digits, and sums of weights taken in another order may differ by less than this.
SLACK = 2e-6


def bm25_weight(tf: Column, qtf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float, b: float, k2: float) -> Column:
    idf = F.log10((n - df + 0.5) / (df + 0.5))
    return idf * ((k1 + 1) * tf / (tf + k1 * (1 - b + b * dl / avgdl))) * ((k2 + 1) * qtf / (k2 + qtf))


def bm25(query: DataFrame, index: Index, k: int | None = 10, k1: float = 1.2, b: float = 0.75, k2: float = 1.0, compat_avgdl: bool = False, tag: str = "BM25", doc_stats: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """BM25 with an idf that is not clipped. compat_avgdl: lengths are compared with the mean number of distinct terms. doc_stats: the
    lengths of another index of the documents; the mean is then theirs too."""
    lengths, totals = (None, index.totals) if doc_stats is None else _lengths(index, doc_stats)
    wanted = index.wanted(query)
    terms = settled(query.join(index.lexicon_of(wanted), "term"))
    mean = F.lit(float((totals.avg_distinct if compat_avgdl else totals.avgdl) or 0))
    weight = lambda tf, dl: bm25_weight(tf, F.col("qtf"), F.col("df"), F.lit(index.totals.N), dl, mean, k1, b, k2)
    return Scoring(tag, index, terms, wanted, weight, lengths=lengths).best(k, bounded and lengths is None)


def _lengths(index: Index, doc_stats: DataFrame | None) -> tuple[DataFrame, Row]:
    """(doc_id, dl) and the totals that go with them."""
    if doc_stats is None:
        return index.doc_stats.select("doc_id", "dl"), index.totals
    return doc_stats.select("doc_id", "dl"), doc_stats.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), F.avg("n_terms").alias("avg_distinct")).first()


def vector_cosine(vectors: DataFrame, index: Index, k: int | None = 10, tag: str = "COSINE", bounded: bool = False, both_ends: int | None = None) -> DataFrame:
    """Cosine of query vectors (qid, term, w) with the documents' TF-IDF weights. A query or document of norm 0 scores 0. Only the
    vectors' terms meet the lexicon, and only their postings are weighed. both_ends as in top_k. Blocks bound nothing for a vector with
    negative weights."""
    vectors = settled(vectors.select("qid", "term", "w"))
    wanted = index.wanted(vectors)
    terms = settled(vectors.join(index.idf_of(wanted).select("term", "df", "idf"), "term"))
    whole = settled(terms.groupBy("qid").agg(F.sum(F.col("w") * F.col("w")).alias("qn")))
    cosine = lambda s, dl, dn: F.coalesce(F.try_divide(s, F.sqrt("qn") * F.sqrt(dn)), F.lit(0.0))
    own = Scoring(tag, index, terms, wanted, lambda tf, dl: (F.log10(tf) + 1) * F.col("idf") * F.col("w"), cosine, whole, norms=True)
    return top_k(own.scores(), None, tag, both_ends) if both_ends is not None else own.best(k, bounded and terms.where("w < 0").isEmpty())


def query_weights(query: DataFrame, index: Index) -> DataFrame:
    """(qid, term, w): (log10(qtf) + 1) * idf."""
    return query.join(index.idf_of(index.wanted(query)), "term").select("qid", "term", ((F.log10("qtf") + 1) * F.col("idf")).alias("w"))


def tfidf(query: DataFrame, index: Index, k: int | None = 10, compat_norm: bool = False, bounded: bool = False, both_ends: int | None = None) -> DataFrame:
    """Cosine of TF-IDF vectors. compat_norm: query weights are also divided by their sum of squares, which scales a query's scores."""
    weights = query_weights(query, index)
    if not compat_norm:
        return vector_cosine(weights, index, k, bounded=bounded, both_ends=both_ends)
    qn = weights.groupBy("qid").agg(F.sum(F.col("w") * F.col("w")).alias("qn"))
    run = vector_cosine(weights, index, None).join(qn, "qid").withColumn("score", F.coalesce(F.try_divide(F.col("score"), F.col("qn")), F.lit(0.0)))
    return top_k(run, k, "COSINE")


def dirichlet(query: DataFrame, index: Index, k: int | None = 100, mu: float = 400.0, bounded: bool = False) -> DataFrame:
    """Dirichlet-smoothed language model over documents with at least one query term.

    The sum over all query terms splits into a part of the query, one of the document's length, and one of the matched terms, so no
    (document, term) pair without a match is made.
    """
    terms, wanted = _smoothed(query, index, mu)
    whole = settled(terms.groupBy("qid").agg(F.sum(F.col("qtf") * F.log("m")).alias("background"), F.sum("qtf").alias("ql")))
    weight = lambda tf, dl: F.col("qtf") * (F.log(tf + F.col("m")) - F.log("m"))
    finish = lambda s, dl, dn: F.col("background") - F.col("ql") * F.log(dl + mu) + s
    return Scoring("Dirichlet", index, terms, wanted, weight, finish, whole).best(k, bounded)


def jelinek_mercer(query: DataFrame, index: Index, k: int | None = 10, lam: float = 0.1, compat_repeat: bool = False, bounded: bool = False) -> DataFrame:
    """Jelinek-Mercer language model, split like dirichlet. compat_repeat: a score counts once for each matched term."""
    terms, wanted = _smoothed(query, index, lam)
    whole = settled(terms.groupBy("qid").agg(F.sum(F.col("qtf") * F.log10("m")).alias("background")))
    weight = lambda tf, dl: F.col("qtf") * (F.log10((1 - lam) * tf / dl + F.col("m")) - F.log10("m"))
    own = Scoring("JM", index, terms, wanted, weight, lambda s, dl, dn: F.col("background") + s, whole)
    if compat_repeat:
        return top_k(own.scores().withColumn("score", F.col("score") * F.col("n")), k, "JM")
    return own.best(k, bounded)


def _smoothed(query: DataFrame, index: Index, share: float) -> tuple[DataFrame, Wanted | None]:
    """Known terms with m, their share of the collection times `share`; written."""
    wanted = index.wanted(query)
    return settled(query.join(index.lexicon_of(wanted), "term").withColumn("m", share * F.col("ctf") / F.lit(index.totals.C))), wanted


def proximity(topics: DataFrame, words: Column, index: Index, k: int | None = 30, near: int = NEAR, k1: float = 1.2, b: float = 0.75, k2: float = 1.0, compat_window: bool = False, doc_stats: DataFrame | None = None) -> DataFrame:
    """BM25 over adjacent word pairs of the query: tf is the number of close places, df the number of documents with both words. doc_stats as
    in bm25; the number of documents is theirs too."""
    lengths, totals = _lengths(index, doc_stats)
    own = topics.select("qid", words.alias("w")).select("qid", F.inline(adjacent_pairs(F.col("w"))).alias("first", "second"))
    bag = settled(own.groupBy("qid", "first", "second").agg(F.count("*").alias("qtf")))
    counts = settled(pair_rows(bag, index, near, compat_window))
    df = counts.groupBy("first", "second").agg(F.count("*").alias("df"))
    rows = counts.join(settled(bag.join(df, ["first", "second"])), ["first", "second"])
    if doc_stats is not None:
        rows = rows.drop("dl").join(lengths, "doc_id")
    weight = bm25_weight(F.col("near"), F.col("qtf"), F.col("df"), F.lit(totals.N), F.col("dl"), F.lit(float(totals.avgdl or 0)), k1, b, k2)
    return top_k(rows.groupBy("qid", "doc_id").agg(F.sum(weight).alias("score")), k, "positional_index")


def fuse(phrase: DataFrame, positional: DataFrame, stem: DataFrame, alpha: float = 50, mu: float = 0.0, k: int | None = 50) -> DataFrame:
    """Weighted sum of three runs: mu for phrases, sin and cos of alpha / 1000 for the other two; a missing score is 0."""
    a = F.lit(alpha / 1000)
    parts = [(phrase, F.lit(float(mu))), (positional, F.sin(a)), (stem, F.cos(a))]
    rows = [r.select("qid", "doc_id", (F.col("score") * w).alias("score")) for r, w in parts]
    return top_k(rows[0].union(rows[1]).union(rows[2]).groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), k, "Positional")
