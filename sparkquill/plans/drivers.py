"""Command line: file-to-file runs of the engine.

    python -m sparkquill build CORPUS KIND OUT [--stop-words FILE] [--stemmer NAME] [--csv]
    python -m sparkquill query INDEX TOPICS MODEL KIND RUN [--reduce KEY] [--threshold X] [--size N]
    python -m sparkquill expand INDEX TOPICS KIND RUN [--documents N] [--terms N] [--criteria NAME]
    python -m sparkquill rocchio INDEX TOPICS KIND RUN [--documents N] [--gamma X]
    python -m sparkquill fuse INDEX TOPICS RUN [--alpha X] [--mu X]
    python -m sparkquill evaluate RUN QRELS OUT

INDEX is a folder that build has written (Parquet, or comma-separated files with --csv). A Parquet index knows its stop words and stemmer, and
topics are read by them; stop words that are given and aren't the index's are an error. Comma-separated files know nothing, so there they
have to be given. A reduced query takes title and narrative, any other one the title. --repeat N runs a command N times; the least, mean and
greatest time are printed.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkquill.functions.text import proximity_words
from sparkquill.operators import evaluate, rank
from sparkquill.operators.analysis import Analyser
from sparkquill.operators.index import Index
from sparkquill.operators.tables import settled
from sparkquill.plans import retrieval
from sparkquill.sources import corpus, files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkquill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, **options: object) -> None:
        p = commands.add_parser(name)
        for x in places:
            p.add_argument(x)
        for x, default in {**options, "repeat": 1}.items():
            p.add_argument(f"--{x.replace('_', '-')}", default=default, **({"action": "store_true"} if default is False else {"type": type(default) if default is not None else str}))

    add("build", "corpus", "kind", "out", stop_words=None, stemmer=None, csv=False)
    add("query", "index", "topics", "model", "kind", "run", reduce=None, threshold=1.0, size=100, stop_words=None, csv=False, compat_join=False)
    add("expand", "index", "topics", "kind", "run", documents=10, terms=10, criteria="tfidf", size=100, stop_words=None, csv=False)
    add("rocchio", "index", "topics", "kind", "run", documents=10, gamma=0.0, size=100, stop_words=None, csv=False)
    add("fuse", "index", "topics", "run", alpha=50.0, mu=0.0, size=100, stop_words=None, csv=False)
    add("evaluate", "run", "qrels", "out")
    return top


def _load(spark: SparkSession, a: argparse.Namespace, kind: str, stop: list[str] | None) -> tuple[Index, DataFrame]:
    if a.csv:
        index, documents = files.load_index(spark, a.index, kind)
        index.analyser = Analyser.of(kind, stop)
        return index, documents
    index, documents = retrieval.load_all(spark, a.index, kind)
    if stop and kind != "positional" and tuple(sorted(stop)) != index.analyser.stop_words:
        raise ValueError(f"the index was made with other stop words: {index.analyser}")
    return index, documents


def _build(spark: SparkSession, a: argparse.Namespace, stop: list[str] | None) -> None:
    index, documents = retrieval.build_from_files(spark, a.corpus, a.kind, a.out, stop, **({"stemmer": a.stemmer} if a.stemmer else {}))
    if a.csv:
        files.write_index(index, documents, a.out, a.kind)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    run, qrels = files.read_run(spark, a.run).withColumnRenamed("doc_name", "doc_id"), files.read_qrels(spark, a.qrels).withColumnRenamed("doc_name", "doc_id")
    evaluate.report(settled(run), settled(qrels)).coalesce(1).write.mode("overwrite").csv(a.out, header=True)


def _rank(spark: SparkSession, a: argparse.Namespace, stop: list[str] | None) -> None:
    topics = corpus.read_topics(spark, a.topics)
    if a.command == "fuse":
        stem, documents = _load(spark, a, "stem", stop)
        run = retrieval.run_fused(topics, stem, _load(spark, a, "phrase", stop)[0], _load(spark, a, "positional", stop)[0], a.alpha, a.mu, a.size)
    else:
        index, documents = _load(spark, a, a.kind, stop)
        reduced = a.command == "query" and a.reduce
        text = retrieval.topic_text(bool(reduced), getattr(a, "compat_join", False))
        query = index.analyser.query_terms(topics, text)
        if a.command == "expand":
            run = retrieval.run_expanded(query, index, a.documents, a.terms, a.criteria, a.size)
        elif a.command == "rocchio":
            run = retrieval.run_rocchio(query, index, a.documents, a.size, **({"gamma": a.gamma} if a.gamma else {}))
        elif a.model == "proximity":
            run = rank.proximity(topics, proximity_words(F.col("title")), index, a.size)
        else:
            run = retrieval.run_static(query, index, a.model, a.reduce, a.threshold, a.size)
    files.write_run(retrieval.named(settled(run), documents), a.run)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkquill").getOrCreate()
    stop = corpus.read_stop_words(spark, a.stop_words) if getattr(a, "stop_words", None) else None
    took = []
    for _ in range(max(1, a.repeat)):
        began = time.time()
        if a.command == "build":
            _build(spark, a, stop)
        elif a.command == "evaluate":
            _evaluate(spark, a)
        else:
            _rank(spark, a, stop)
        took.append(time.time() - began)
    print(f"{a.command}: {took[0]:.1f} s" if len(took) == 1 else f"{a.command}: {len(took)} times, least {min(took):.1f} s, mean {sum(took) / len(took):.1f} s, greatest {max(took):.1f} s")
