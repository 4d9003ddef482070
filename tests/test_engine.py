"""Indexes, ranking, rewriting, evaluation and files on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkquill.functions.text import plain_words
from sparkquill.operators import evaluate, near, rank, rewrite
from sparkquill.operators.index import Index, build_index, postings, word_tokens
from sparkquill.plans import retrieval
from sparkquill.sources import corpus, files


@pytest.fixture(scope="module")
def words():
    r = random.Random(3)
    return {i: [r.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(r.randrange(1, 40))] for i in range(25)}


@pytest.fixture(scope="module")
def index(spark, words):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()] + [(90, ""), (91, None)], "doc_id long, text string")
    return Index(postings(word_tokens(docs), positions=True).persist())


@pytest.fixture(scope="module")
def topics(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma zeta nothing"), (3, "nothing"), (4, "")], "qid int, title string")


def bag(topics):
    return rank.query_bag(topics, plain_words(F.col("title")))


def test_statistics(index, words):
    total = sum(map(len, words.values()))
    s = index.coll_stats.first()
    assert (s.N, s.C) == (len(words), total)
    assert index.lexicon.agg(F.sum("ctf")).first()[0] == total
    assert index.lexicon.agg(F.sum("df")).first()[0] == index.postings.count()
    ids = [(r.term_id, r.term) for r in index.lexicon_ids().orderBy("term_id").collect()]
    assert ids == list(enumerate(sorted({w for ws in words.values() for w in ws})))


def brute(words, score):
    out = {}
    for q, terms in {1: {"alpha": 1, "beta": 1}, 2: {"gamma": 2, "zeta": 1}}.items():
        for d, ws in words.items():
            if any(t in ws for t in terms):
                out[q, d] = score(terms, ws)
    return out


@pytest.mark.parametrize("model", ["bm25", "dirichlet", "jm", "cosine"])
def test_models(index, topics, words, model):
    n, c = len(words), sum(map(len, words.values()))
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    ctf = {t: sum(w.count(t) for w in words.values()) for t in df}

    def score(terms, ws):
        if model == "bm25":
            return sum(math.log10((n - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 * ws.count(t) / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) * n / c)) * 2 * q / (1 + q) for t, q in terms.items())
        if model == "dirichlet":
            return sum(q * math.log((ws.count(t) + 400 * ctf[t] / c) / (len(ws) + 400)) for t, q in terms.items())
        if model == "jm":
            return sum(q * math.log10(0.9 * ws.count(t) / len(ws) + 0.1 * ctf[t] / c) for t, q in terms.items())
        w = lambda tf, t: (math.log10(tf) + 1) * math.log10(n / df[t]) if tf else 0.0
        dot = sum(w(ws.count(t), t) * w(q, t) for t, q in terms.items())
        return dot / math.sqrt(sum(w(ws.count(t), t) ** 2 for t in set(ws)) * sum(w(q, t) ** 2 for t, q in terms.items()) or 1)

    run = {"bm25": rank.bm25, "dirichlet": rank.dirichlet, "jm": rank.jelinek_mercer, "cosine": rank.tfidf}[model](bag(topics), index, None)
    rows = run.collect()
    assert {(r.qid, r.doc_id): pytest.approx(r.score, abs=2e-6) for r in rows} == brute(words, score)
    for q in (1, 2):  # ranks follow scores
        own = sorted((r for r in rows if r.qid == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert all(a.score >= b.score for a, b in zip(own[:-1], own[1:], strict=True))


def test_repeated_jm_counts_terms(index, topics):
    a = {(r.qid, r.doc_id): r.score for r in rank.jelinek_mercer(bag(topics), index, None).collect()}
    b = {(r.qid, r.doc_id): r.score for r in rank.jelinek_mercer(bag(topics), index, None, compat_repeat=True).collect()}
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k]) or b[k] == pytest.approx(2 * a[k], abs=1e-5) for k in a)


@pytest.mark.parametrize("compat", [False, True])
def test_proximity_counts(spark, index, words, compat):
    pairs = spark.createDataFrame([("alpha", "beta"), ("gamma", "gamma")], "first string, second string")
    got = {(r.first, r.second, r.doc_id): r.near for r in near.pair_counts(pairs, index, 5, compat).select("first", "second", "doc_id", "near").toPandas().itertuples()}
    want = {}
    for x, y in (("alpha", "beta"), ("gamma", "gamma")):
        for d, w in words.items():
            p1, p2 = ([i for i, t in enumerate(w) if t == z] for z in (x, y))
            if p1 and p2:
                want[x, y, d] = sum(abs(a - b) < 5 and not (compat and b - 5 in p1) for a in p1 for b in p2)
    assert got == want


def test_rewriting(spark, index, topics):
    query = bag(topics)
    assert [(r.qid, r.term, r.qtf) for r in rewrite.reduce_query(query, index, 0.5, "qtf").orderBy("qid").collect()] == [(1, "alpha", 1), (2, "gamma", 2)]
    run = rank.tfidf(query, index, None)
    n = run.groupBy("qid").count().collect()
    assert rewrite.feedback_documents(run, 3).count() == rewrite.feedback_documents(run, 3, top=False).count() == sum(min(3, r["count"]) for r in n)
    assert rewrite.expand(run, index, 3, 4).groupBy("qid").count().where("count > 4").count() == 0
    vector = rewrite.rocchio(query, run, index, n=3, keep=3)
    assert {r.qid for r in vector.collect()} == {1, 2}
    assert retrieval.run_rocchio(query, index, n=3, size=5).count() > 0
    assert rewrite.rocchio(query, run, index, n=3, gamma=1.0).count() > 0


def test_fusion(spark):
    run = lambda rows: spark.createDataFrame(rows, "qid int, doc_id long, rank long, score double, tag string")
    out = rank.fuse(run([(1, 1, 0, 4.0, "a")]), run([(1, 2, 0, 2.0, "b")]), run([(1, 1, 0, 1.0, "c")]), alpha=50, mu=0.5)
    assert {r.doc_id: r.score for r in out.collect()} == {1: round(2 + math.cos(0.05), 6), 2: round(2 * math.sin(0.05), 6)}


def test_measures(spark):
    run = spark.createDataFrame([(1, d, i) for i, d in enumerate([10, 11, 12, 13])] + [(2, 10, 0)], "qid int, doc_id long, rank long")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 1), (1, 99, 1), (3, 10, 1)], "qid int, doc_id long, rel int")
    m = {r.metric: r.value for r in evaluate.means(run, qrels).collect()}
    assert m["map"] == pytest.approx((1 + 2 / 3) / 3) and m["r_precision"] == pytest.approx(2 / 3) and m["p_5"] == pytest.approx(0.4)
    assert m["iprec_0.0"] == 1 and m["iprec_0.5"] == pytest.approx(2 / 3) and m["iprec_1.0"] == 0
    assert evaluate.counts(run, qrels).first().asDict() == {"queries": 1, "retrieved": 4, "relevant": 3, "rel_ret": 2}


CORPUS = """<DOC>
<DOCNO> A-1 </DOCNO>
<PARENT> P1 </PARENT>
<TITLE>First &amp; best</TITLE>
one two

three
</DOC>
<DOC>
<DOCNO> A-2 </DOCNO>
four well-known
</DOC>
"""


def test_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f1").write_text(CORPUS)
    (tmp_path / "c" / "f2").write_text("<DOCNO>A-1</DOCNO>\nnew text\n")
    rows = {r.doc_name: (r.parent, r.text) for r in corpus.read_corpus(spark, str(tmp_path / "c")).collect()}
    assert rows == {"A-1": (None, "new text"), "A-2": (None, "four well-known")}
    (tmp_path / "c" / "f2").unlink()
    rows = {r.doc_name: (r.parent, r.text) for r in corpus.read_corpus(spark, str(tmp_path / "c")).collect()}
    assert rows == {"A-1": ("P1", "First & best one two three"), "A-2": (None, "four well-known")}
    index, documents = retrieval.build_from_files(spark, str(tmp_path / "c"), "positional", str(tmp_path / "i"))
    assert [(r.doc_id, r.doc_name) for r in documents.orderBy("doc_id").collect()] == [(0, "A-1"), (1, "A-2")]
    assert {r.term for r in index.postings.where("doc_id = 1").collect()} == {"four", "wellknown", "well", "known"}

    files.write_ragged_index(index, str(tmp_path / "ragged"))
    files.write_lexicon(index, str(tmp_path / "lexicon"))
    again = files.read_ragged_index(spark, str(tmp_path / "ragged"), files.read_lexicon(spark, str(tmp_path / "lexicon")))
    assert {tuple(r) for r in again.postings.collect()} == {(r.term, r.doc_id, r.tf) for r in index.postings.collect()}

    (tmp_path / "topics").write_text("<top>\n<num> Number: 301\n<title> Topic: Crime wave\n<desc> no\n<narr> Narrative:\nOne line\ntwo\n</top>\n<top>\n<num> Number: 302\n<title> Topic: Polio\n</top>\n")
    assert [tuple(r) for r in corpus.read_topics(spark, str(tmp_path / "topics")).orderBy("qid").collect()] == [(301, "Crime wave", "One line\ntwo\n"), (302, "Polio", None)]

    (tmp_path / "run").write_text("301  0  A-1  0  3.5  BM25\n301 0 A-2 1 2.5 BM25\n")
    run = files.read_run(spark, str(tmp_path / "run"))
    files.write_run(run, str(tmp_path / "run2"))
    assert files.read_run(spark, str(tmp_path / "run2")).orderBy("rank").collect() == run.orderBy("rank").collect()
    (tmp_path / "qrels").write_text("301 0 A-2 1\n")
    assert files.read_qrels(spark, str(tmp_path / "qrels")).first().rel == 1
    body = '{"hits":{"hits":[{"_id":"7","_score":2.5,"_source":{"doc_name":" A-2 ","text":"x"}}]}}'
    hits = files.parse_hits(spark.createDataFrame([(301, body)], "qid int, body string")).first()
    assert (hits.qid, hits.doc_name, hits["rank"], hits.score) == (301, "A-2", 0, 2.5)
    (tmp_path / "report").write_text("Queryid (Num):       20\n    Retrieved:     4431\n    at 0.00       0.4638\n                  0.3639\n  At    5 docs:   0.2700\n    Exact:        0.3297\n")
    assert {r.metric: r.value for r in files.read_report(spark, str(tmp_path / "report")).collect()} == {"queries": 20, "retrieved": 4431, "iprec_0.0": 0.4638, "map": 0.3639, "p_5": 0.27, "r_precision": 0.3297}


def test_drivers_from_files_to_files(spark, tmp_path):
    from sparkquill.plans.drivers import main

    (tmp_path / "c").mkdir()
    texts = ["crime wave in the city", "polio crime", "a wave of polio", "the old river in the city", "crime wave again, crime wave", "wave city river old"]
    (tmp_path / "c" / "f").write_text("".join(f"<DOC>\n<DOCNO> D-{i} </DOCNO>\n{t}\n</DOC>\n" for i, t in enumerate(texts)))
    (tmp_path / "t").write_text("<top>\n<num> Number: 301\n<title> Topic: Crime wave\n<narr> Narrative:\nOnly in the old city\n</top>\n<top>\n<num> Number: 302\n<title> Topic: polio\n</top>\n")
    (tmp_path / "s").write_text("the\nin\na\nof\n")
    (tmp_path / "q").write_text("301 0 D-4 1\n301 0 D-0 1\n302 0 D-1 1\n")
    at = lambda x: str(tmp_path / x)
    for kind in ("single", "stem", "positional", "phrase"):
        main(["build", at("c"), kind, at("i"), "--csv", *([] if kind == "positional" else ["--stop-words", at("s")])], spark)
    runs = {}
    for name, args in {
        "bm25": ["query", at("i"), at("t"), "bm25", "single"], "bm25_csv": ["query", at("i"), at("t"), "bm25", "single", "--csv"], "lm": ["query", at("i"), at("t"), "lm", "stem", "--stop-words", at("s")],
        "reduced": ["query", at("i"), at("t"), "cosine", "single", "--reduce", "qtf_idf", "--threshold", "0.5"], "near": ["query", at("i"), at("t"), "proximity", "positional"],
        "expand": ["expand", at("i"), at("t"), "single"], "rocchio": ["rocchio", at("i"), at("t"), "single"], "fuse": ["fuse", at("i"), at("t")],
    }.items():
        places = {"query": 5, "expand": 4, "rocchio": 4, "fuse": 3}[args[0]]
        main([*args[:places], at(name), *args[places:]], spark)
        runs[name] = sorted(tuple(r) for r in files.read_run(spark, at(name)).collect())
    assert all(runs.values()) and runs["bm25"] == runs["bm25_csv"]
    assert {r[2] for r in runs["bm25"] if r[0] == 301} == {"D-0", "D-1", "D-2", "D-4", "D-5"} and {r[2] for r in runs["near"]} == {"D-0", "D-4"}
    main(["evaluate", at("bm25"), at("q"), at("e")], spark)
    got = {r[0]: float(r[1]) for r in spark.read.csv(at("e"), header=True).collect()}
    assert (got["queries"], got["relevant"]) == (2, 3) and 0 < got["map"] <= 1
    # all kinds read back from comma-separated files as they were
    for kind in ("single", "positional", "phrase"):
        index, documents = files.load_index(spark, at("i"), kind)
        first, names = retrieval.load_all(spark, at("i"), kind)
        assert sorted(map(str, index.postings.collect())) == sorted(map(str, first.postings.select(index.postings.columns).collect()))
        assert sorted(map(str, documents.collect())) == sorted(map(str, names.collect())) and index.totals == first.totals


def test_topic_text(spark, tmp_path):
    topics = spark.createDataFrame([(1, "big river", "low tide\nof it"), (2, "x", None)], "qid int, title string, narrative string")
    terms = lambda **k: sorted(r.term for r in retrieval.topic_terms(topics, retrieval.topic_text(True, k.pop("compat_join", False)), **k).where("qid = 1").collect())
    assert terms() == ["big", "it", "low", "of", "river", "tide"]
    assert terms(compat_join=True) == ["big", "it", "of", "riverlow", "tide"]
    assert terms(compat_lines=True) == ["big", "it", "low", "river", "tide"]  # one word of class other, whose runs of three letters stay
    assert terms(stemmer=lambda t: t.withColumn("term", F.upper("term")))[0] == "BIG"
    retrieval.register_model("constant", lambda query, index, k: query)
    assert retrieval.run_static("same", None, "constant") == "same"
    with pytest.raises(ValueError, match="no such model"):
        retrieval.run_static(topics, None, "nothing")


def test_query_report(spark, tmp_path):
    part = "\nQueryid (Num):      {}\nTotal number of documents over all queries\n    Retrieved:     10\n    at 0.00       0.5000\nAverage precision (non-interpolated) for all rel docs(averaged over queries)\n                  {}\nPrecision:\n  At    5 docs:   0.2000\nR-Precision (precision after R (= num_rel for a query) docs retrieved):\n    Exact:        {}\n"
    (tmp_path / "r").write_text(part.format(301, "0.2500", "0.5000") + part.format(302, "0.7500", "1.0000"))
    got = {(r.qid, r.metric): r.value for r in files.read_query_report(spark, str(tmp_path / "r")).collect()}
    assert got == {(301, "ap"): 0.25, (301, "r_precision"): 0.5, (302, "ap"): 0.75, (302, "r_precision"): 1.0}


def test_close_places_of_many_places(spark):
    r = random.Random(9)
    rows = [(sorted(r.sample(range(3000), n)), sorted(r.sample(range(3000), m))) for n, m in ((70, 90), (500, 65), (1, 300), (66, 66), (80, 2))]
    got = [x.n for x in spark.createDataFrame(rows, "a array<int>, b array<int>").coalesce(1).select(near.close_places(F.col("a"), F.col("b"), 40).alias("n")).collect()]
    assert got == [sum(abs(x - y) < 40 for x in a for y in b) for a, b in rows]


def test_chunks_of_frequent_terms(spark, index, monkeypatch):
    from sparkquill.operators import index as module

    monkeypatch.setattr(module, "CHUNK", 5)
    rows = index.grouped().collect()
    assert max(len(r.entries) for r in rows) < 25 and len({r.chunk for r in rows}) > 1
    assert sorted((r.term, e.doc_id, e.tf) for r in rows for e in r.entries) == sorted((r.term, r.doc_id, r.tf) for r in index.postings.collect())


def test_qrels_of_short_items(spark, tmp_path):
    from sparkquill.plans import queries

    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    r = random.Random(4)
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))).replace("eta ", "eta\n") for _ in range(60)] + [None, "", " "]
    items = [t[a : a + n] for t in texts[:40] for a, n in [(r.randrange(len(t)), r.randrange(1, 60))]] + ["a", "pha", "zzz", "", " \n", "eta\n", "a b", None, "alpha  beta"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(x.qid, x.doc_id) for x in queries.qrels(spark, str(tmp_path)).collect()}
    assert got == {(q, d) for q, i in enumerate(items) if i and i.strip(" \n") for d, t in enumerate(texts) if t and i in t}


def test_positional_and_phrase_files(spark, tmp_path):
    (tmp_path / "lex").write_text("0,a,2\n1,b,1\n")
    (tmp_path / "pos").write_text("0,1,2,5\n0,2,1\n1,1,3\n")
    (tmp_path / "rows").write_text("0,1,2\n0,2,1\n1,1,1\n")
    lexicon = files.read_lexicon(spark, str(tmp_path / "lex"))
    got = {(r.term, r.doc_id): r.positions for r in files.read_positional_index(spark, str(tmp_path / "pos"), lexicon).postings.collect()}
    assert got == {("a", 1): [2, 5], ("a", 2): [1], ("b", 1): [3]}
    assert {tuple(r) for r in files.read_posting_rows(spark, str(tmp_path / "rows"), lexicon).postings.collect()} == {("a", 1, 2), ("a", 2, 1), ("b", 1, 1)}


def test_index_kinds(spark):
    docs = spark.createDataFrame([(1, "the running dogs"), (2, "running dogs ran")], "doc_id long, text string")
    assert {r.term for r in build_index(docs, "stem", ["the"]).lexicon.collect()} == {"run", "dog", "ran"}
    assert {r.term for r in build_index(docs, "phrase", phrase_df=2).lexicon.collect()} == {"running dogs"}
    with pytest.raises(ValueError, match="no such index"):
        build_index(docs, "x")
