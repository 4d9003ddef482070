"""The laid-out index: pruned scans, bounded ranking, analysers, segments; files that are split, names that are numbered, stems."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkquill.functions.stem import IRREGULAR, STEP2, STEP3, STEP4, stem, stem_of
from sparkquill.operators import analysis, index as layout, near, rank
from sparkquill.operators.analysis import Analyser
from sparkquill.operators.index import Index, build_index, index_of
from sparkquill.operators.segments import Segments
from sparkquill.plans import retrieval
from sparkquill.sources import corpus, files
from sparkquill.streaming.ingest import index_stream


def texts(n, seed=5, vocabulary=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(vocabulary)]
    return [" ".join(words[min(int(r.paretovariate(0.7)) - 1, vocabulary - 1)] for _ in range(r.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def small_blocks():
    held = layout.BLOCK_DF, layout.BLOCK_DOCS, rank.BLOCK_DOCS
    layout.BLOCK_DF, layout.BLOCK_DOCS, rank.BLOCK_DOCS = 20, 8, 8
    yield
    layout.BLOCK_DF, layout.BLOCK_DOCS, rank.BLOCK_DOCS = held


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts(400))) + [(900, ""), (901, None)], "doc_id long, text string")


@pytest.fixture(scope="module")
def saved(spark, docs, small_blocks, tmp_path_factory):
    return index_of(docs, Analyser(tokenizer="words")).save(str(tmp_path_factory.mktemp("i") / "words"), 32)


@pytest.fixture(scope="module")
def topics(spark):
    rows = texts(400)
    return spark.createDataFrame([(k, rows[7 * k][: 10 + 30 * k]) for k in range(8)] + [(50, "nothing"), (51, "")], "qid int, title string")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_saved_tables_are_what_postings_say(saved):
    plain = Index(saved.postings.select("term", "doc_id", "tf"))
    assert rows_of(saved.lexicon) == rows_of(plain.lexicon.select("term", "df", "ctf")) and rows_of(saved.doc_stats) == rows_of(plain.doc_stats)
    assert saved.totals == plain.totals
    dn = {r.doc_id: r.dn for r in plain.norms().collect()}
    assert {r.doc_id: pytest.approx(r.dn) for r in saved.norms().collect()} == dn


def test_terms_prune_the_scan(spark, saved):
    terms = saved.lexicon.where("df > 30").limit(3).select("term")
    wanted = saved.wanted(terms)
    plan = saved.postings_of(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert all(t in plan.split("PushedFilters")[1] for t in wanted.terms)
    few = saved.postings_of(wanted)
    assert {r.term for r in few.select("term").distinct().collect()} == set(wanted.terms)
    assert saved.postings_of(saved.wanted(terms.where("false"))).count() == 0


@pytest.mark.parametrize("limit", [0, 5])
def test_too_many_terms_for_a_filter(saved, topics, limit, monkeypatch):
    want = rows_of(rank.bm25(Analyser(tokenizer="words").query_terms(topics), saved, 10))
    monkeypatch.setattr(layout, "TERMS", 3)
    monkeypatch.setattr(layout, "FEW_TERMS", limit * 100)
    assert rows_of(rank.bm25(saved.analyser.query_terms(topics), saved, 10)) == want


@pytest.mark.parametrize(("model", "k"), [(rank.bm25, 1), (rank.bm25, 300), (rank.tfidf, 7), (rank.dirichlet, 7), (rank.jelinek_mercer, 7)])
def test_bounds_leave_no_result_out(saved, topics, model, k):
    query = saved.analyser.query_terms(topics)
    whole = rows_of(model(query, saved, k))
    assert rows_of(model(query, saved, k, bounded=True)) == whole and whole
    # and without laid-out tables
    assert rows_of(model(query, Index(saved.postings.select("term", "doc_id", "tf")), k)) == whole


def test_bounds_hold_and_prune(spark, small_blocks, tmp_path):
    """Documents of one block have words of their own beside common ones, as those of one site or time may have."""
    r = random.Random(2)
    name = lambda b: "own" + chr(97 + b // 26) + chr(97 + b % 26)
    rows = [(i, " ".join(r.choice([["the", "of", "and"][i % 3], f"{name(i // 8)}x", f"{name(i // 8)}y"]) for _ in range(30))) for i in range(320)]
    own = index_of(spark.createDataFrame(rows, "doc_id long, text string"), Analyser(tokenizer="words")).save(str(tmp_path / "i"), 4)
    query = own.analyser.query_terms(spark.createDataFrame([(q, f"the {name(q)}x of {name(q)}y") for q in range(5)], "qid int, title string"))
    wanted = own.wanted(query)
    weight = lambda tf, dl: rank.bm25_weight(tf, F.col("qtf"), F.col("df"), F.lit(own.totals.N), dl, F.lit(own.totals.avgdl), 1.2, 0.75, 1.0)
    scoring = rank.Scoring("x", own, rank.settled(query.join(own.lexicon_of(wanted), "term")), wanted, weight)
    most = {(r.qid, r.block): r.most for r in scoring.bounds().collect()}
    scores = scoring.scores().collect()
    assert all(r.score <= most[r.qid, r.doc_id // 8] + 1e-9 for r in scores)
    least = {q: sorted((r.score for r in scores if r.qid == q), reverse=True)[4] for q in range(5)}
    assert sum(m >= least[q] - 1e-6 for (q, _), m in most.items()) < 0.1 * len(most)  # blocks whose documents are summed, of all
    assert rows_of(scoring.best(5, bounded=True)) == rows_of(scoring.best(5))


def test_both_ends_of_a_ranking(saved, topics):
    query = saved.analyser.query_terms(topics)
    whole = rank.tfidf(query, saved, None).collect()
    total = {}
    for r in whole:
        total[r.qid] = total.get(r.qid, 0) + 1
    ends = rank.tfidf(query, saved, both_ends=5)
    assert rows_of(ends) == sorted(str(r) for r in whole if r.rank < 5 or r.rank >= total[r.qid] - 5)
    assert ends._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


# --- analysers


def test_an_index_knows_its_analyser(spark, docs, tmp_path):
    analysis.register_stemmer("first3", lambda c: F.substring(c, 1, 3))
    analysis.register_tokenizer("halves", lambda c: F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), " "), lambda w: F.array(F.substring(w, 1, 2), F.substring(w, 3, 9))))
    made = Analyser("stem", "halves", "first3", ("ab", "cd"))
    built = index_of(docs, made).save(str(tmp_path / "i"))
    own = Index.load(spark, str(tmp_path / "i"))
    assert own.analyser == made == Analyser.from_json(made.to_json())
    topics = spark.createDataFrame([(1, "ABcdef xxyyzz")], "qid int, title string")
    assert {r.term for r in own.analyser.query_terms(topics).collect()} == {"cde", "xx", "yyz"}
    assert not {"ab", "cd"} & {r.term for r in built.lexicon.collect()}
    with pytest.raises(ValueError, match="was made by"):
        Index.load(spark, str(tmp_path / "i"), Analyser("stem", "halves", "first3"))
    text = (tmp_path / "i" / "index.json").read_text()
    for change, error in (({"stemmer": "lost"}, "no such stemmer"), ({"version": 99}, "version 99")):
        content = json.loads(text)
        content["analyser"] |= change
        with pytest.raises(ValueError, match=error):
            Analyser.from_json(json.dumps(content["analyser"]))
    with pytest.raises(ValueError, match="no such tokenizer"):
        Analyser(tokenizer="lost")


def test_other_stop_words_are_an_error(spark, tmp_path):
    from sparkquill.plans.drivers import main

    (tmp_path / "c").write_text("<DOCNO>A</DOCNO>\ndoes the river run\n<DOCNO>B</DOCNO>\nold river\n")
    (tmp_path / "t").write_text("<top>\n<num> Number: 1\n<title> Topic: does the river\n</top>\n")
    (tmp_path / "s").write_text("does\nthe\n")
    (tmp_path / "s2").write_text("the\n")
    at = lambda x: str(tmp_path / x)
    main(["build", at("c"), "stem", at("i"), "--stop-words", at("s")], spark)
    main(["query", at("i"), at("t"), "bm25", "stem", at("r"), "--repeat", "2"], spark)
    assert len((tmp_path / "r").read_text().splitlines()) == 2  # one file, in order
    with pytest.raises(ValueError, match="other stop words"):
        main(["query", at("i"), at("t"), "bm25", "stem", at("r"), "--stop-words", at("s2")], spark)


def test_stem_postings_without_python(spark, docs):
    own = index_of(docs, Analyser.of("stem", ["the"])).postings
    assert "Python" not in own._jdf.queryExecution().executedPlan().toString()
    words = build_index(docs, "single", ["the"]).postings.collect()
    want = {}
    for r in words:
        want[stem(r.term), r.doc_id] = want.get((stem(r.term), r.doc_id), 0) + r.tf
    assert {(r.term, r.doc_id): r.tf for r in own.collect()} == want


def test_stem_expression(spark):
    r = random.Random(7)
    ends = [a for a, _ in STEP2 + STEP3] + STEP4 + "s es ies ed ing ied eed y alli e ll sses yy yyy".split()
    words = {"".join(r.choice("aeiouybcdlstz") for _ in range(r.randrange(1, 7))) + r.choice(ends) + r.choice(["", "", "s", "ly"]) for _ in range(2500)}
    words |= {x + "y" * k + e for x in ("", "a", "b") for k in range(1, 8) for e in ("", "b", "ing")} | set(IRREGULAR) | {"", "a", "b2b", "über", "x\ny"}
    got = {x.w: x.s for x in spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", stem_of(F.col("w")).alias("s")).collect()}
    assert got == {w: stem(w) for w in words}
    assert spark.range(1).select(stem_of(F.lit(None).cast("string")).alias("s")).first().s is None


# --- segments


def run_of(index, topics):
    query = index.analyser.query_terms(topics)
    return [rows_of(m(query, index, 20)) for m in (rank.bm25, rank.dirichlet, rank.tfidf)] + [rows_of(index.lexicon), rows_of(index.doc_stats), str(index.totals)]


@pytest.mark.parametrize("analyser", [Analyser(tokenizer="words"), Analyser("positional", "words")])
def test_segments_rank_as_one_index(spark, topics, tmp_path, analyser):
    rows = texts(300)
    frame = lambda x: spark.createDataFrame(sorted(x.items()), "doc_id long, text string")
    batches = [{i: rows[i] for i in range(k, 100, 3)} for k in range(3)] + [{i: rows[200 + i] for i in range(50, 60)} | {120: None, 121: rows[121]}]
    own = Segments.create(spark, str(tmp_path / "s"), analyser, 16)
    assert own.index().postings.count() == 0
    for k, b in enumerate([*batches[:3], batches[1], batches[3]]):  # one comes twice
        own.add(frame(b), f"b{batches.index(b)}")
    live = {i: t for b in batches for i, t in b.items()}
    own.delete(frame({3: "", 50: "", 999: ""}))
    own.delete(frame({3: ""}))
    live = {i: t for i, t in live.items() if i not in (3, 50)}
    own.add(frame({50: rows[250]}))
    live[50] = rows[250]
    want = run_of(index_of(frame(live), analyser).save(str(tmp_path / "one"), 16), topics)
    got = own.index()
    assert run_of(got, topics) == want and len(own.manifest()["segments"]) == 5
    if analyser.positions:
        assert rows_of(got.postings.select("term", "doc_id", "positions")) == rows_of(index_of(frame(live), analyser).postings.select("term", "doc_id", "positions"))
    query = got.analyser.query_terms(topics)
    assert rows_of(rank.bm25(query, got, 10, bounded=True)) == rows_of(rank.bm25(query, got, 10))
    own.compact()
    own.vacuum()
    assert run_of(own.index(), topics) == want and len(own.manifest()["segments"]) == 1
    own.add(frame({121: rows[0]}))
    assert own.index().doc_stats.where("doc_id = 121").first().dl == len(rows[0].split())
    with pytest.raises(ValueError, match="comes twice"):
        own.add(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"))


def test_phrases_of_segments(spark, tmp_path):
    own = Segments.create(spark, str(tmp_path / "s"), Analyser("phrase", phrase_df=2), 4)
    for k, t in enumerate(["big old house", "the big old tree", "old tree"]):
        own.add(spark.createDataFrame([(k, t)], "doc_id long, text string"))
    assert {r.term: r.df for r in own.index().lexicon.collect()} == {"big old": 2, "old tree": 2}


def test_one_of_two_writers_fails(spark, tmp_path):
    own = Segments.create(spark, str(tmp_path / "s"), Analyser(), 4)
    before = own.manifest()
    own._commit(before["version"] + 1, before)
    with pytest.raises(Exception, match="exists"):
        own._commit(before["version"] + 1, before)


def test_stream_of_segments(spark, tmp_path):
    own = Segments.create(spark, str(tmp_path / "s"), Analyser("positional"), 4)
    for rows in [[(1, "the running dogs"), (2, "old")], [(2, "new dogs"), (3, "")], [(4, "cats")]]:
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        index_stream(stream, own, str(tmp_path / "cp"), compact_at=3).awaitTermination(60)
    assert len(own.manifest()["segments"]) == 1 and len(own.manifest()["batches"]) == 3
    assert {(r.term, r.doc_id) for r in own.index().postings.collect()} == {("the", 1), ("running", 1), ("dogs", 1), ("new", 2), ("dogs", 2), ("cats", 4)}


# --- files


def test_names_are_numbered_once(spark):
    held = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        names = spark.range(100_000).select(F.concat(F.lit("n"), F.xxhash64("id").cast("string")).alias("doc_name"))
        ids = corpus.document_list(names)
        assert ids.agg(F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id"), F.count("*")).first()[:] == (100_000, 0, 99_999, 100_000)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", held)


@pytest.mark.parametrize("size", ["128m", "40000"])
def test_files_are_split(spark, tmp_path, size):
    r = random.Random(1)
    want = {}
    for f in range(2):
        out = ["<FILEID>x</FILEID>\n<DOC>\n"] if f else []
        for i in range(1200):
            name, lines = f"D-{r.randrange(1500)}", [r.choice(["plain words here", "<P>tagged &amp; more</P>", "<TEXT>", "", " ", "</TEXT>", "x < y <b>z</b>", "a <DOCNO>no</DOCNO>"]) for _ in range(r.randrange(6))]
            out.append(f"<DOCNO> {name} </DOCNO>\n<PARENT> P{i} </PARENT>\n" + "".join(x + ("\r\n" if i % 2 else "\n") for x in lines))
            kept = ["tagged & more" if x.startswith("<P>") else x for x in lines if x.strip() and (not x.startswith("<") or x.startswith("<P>"))]
            want[name] = (f"P{i}", " ".join(kept))
        (tmp_path / f"f{f}").write_bytes("".join(out).encode())
    (tmp_path / "f2").write_text("no document here\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert {x.doc_name: (x.parent, x.text) for x in corpus.read_corpus(spark, str(tmp_path)).collect()} == want
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_run_is_one_ordered_file(spark, tmp_path):
    rows = [(q, f"D-{d}", d, float(-d), "T") for q in range(20) for d in range(30)]
    files.write_run(spark.createDataFrame(rows, "qid int, doc_name string, rank int, score double, tag string").repartition(7), str(tmp_path / "run"))
    assert [tuple(map(int, x.split()[0:4:3])) for x in (tmp_path / "run").read_text().splitlines()] == [(q, d) for q, _, d, _, _ in rows]


def test_close_places_beyond_a_counter(spark):
    big = F.sequence(F.lit(0), F.lit(9_999))
    assert spark.range(1).select(near.close_places(big, big, 100_000).alias("n")).first().n == 10**8


def test_a_scoring_of_ones_own(saved, topics):
    query = saved.analyser.query_terms(topics)
    wanted = saved.wanted(query)
    terms = query.join(saved.lexicon_of(wanted), "term")
    retrieval.register_model("matches", lambda q, i, k: rank.Scoring("M", i, terms, wanted, lambda tf, dl: F.lit(1.0)).best(k))
    got = retrieval.run_static(query, saved, "matches", size=3).collect()
    assert got and all(r.score == int(r.score) for r in got)


def test_documents_are_counted_without_a_shuffle(spark, docs, monkeypatch):
    """Before, every token was shuffled by term and document, and each document's length once more by all its terms."""
    from sparkquill.operators import counts
    from sparkquill.operators.index import postings, word_tokens

    monkeypatch.setattr(counts, "WORDS", 50)  # several stretches of documents
    own = index_of(docs, Analyser("positional", "words")).postings
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    want = {(r.term, r.doc_id): (r.tf, r.positions) for r in postings(word_tokens(docs), True).collect()}
    rows = own.collect()
    assert {(r.term, r.doc_id): (r.tf, r.positions) for r in rows} == want and len(rows) == len(want)
    told = {r.doc_id: (r.dl, r.n_terms) for r in rows if r.n_terms is not None}
    assert told == {d: (sum(v[0] for k, v in want.items() if k[1] == d), sum(k[1] == d for k in want)) for d in {k[1] for k in want}}


@pytest.mark.parametrize("few", [10**6, 0])
def test_frequent_phrases_by_hashes(spark, monkeypatch, tmp_path, few):
    """Before, every phrase of every document was shuffled and written; now only hashes are, and rows of frequent ones."""
    from collections import Counter

    from sparkquill.operators import counts

    monkeypatch.setattr(counts, "WORDS", 40)
    monkeypatch.setattr(counts, "FEW_PHRASES", few)
    r = random.Random(9)
    rows = {i: " ".join(r.choice(["Alpha", "beta,", "b4", "the", "", "gamma", "x\ny", "Été"]) for _ in range(r.randrange(30))) for i in range(60)} | {70: "", 71: None, 72: "  "}
    given = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for stop in ([], ["the"]):
        want = Counter()
        for d, text in rows.items():
            words = "".join(c for c in (text or "").replace("\n", " ") if c not in "!\"&'*+:;<=>?[]^_`{|}~").lower().split()
            fits = [w.isascii() and w.isalpha() and w not in stop for w in words]
            want.update((" ".join(words[i : i + n]), d) for n in (2, 3) for i in range(len(words) - n + 1) if all(fits[i : i + n]))
        df = Counter(t for t, _ in want)
        want = {k: n for k, n in want.items() if df[k[0]] >= 5}
        own = build_index(given, "phrase", stop).save(str(tmp_path / f"p{few}{len(stop)}"), 4)
        got = own.postings.collect()
        assert {(x.term, x.doc_id): x.tf for x in got} == want and len(got) == len(want) > 20
        assert {x.doc_id: (x.dl, x.n_terms) for x in own.doc_stats.collect()} == {d: (sum(n for k, n in want.items() if k[1] == d), sum(k[1] == d for k in want)) for d in {k[1] for k in want}}


def test_rare_phrases_that_share_a_hash_go(spark, monkeypatch, tmp_path):
    from sparkquill.operators import counts

    monkeypatch.setattr(counts, "_mixed", lambda x: x & counts.np.uint64(1))  # two hashes for all phrases
    given = spark.createDataFrame([(i, f"same words here own{chr(97 + i)} end") for i in range(8)], "doc_id long, text string")
    own = build_index(given, "phrase").save(str(tmp_path / "p"), 4)
    terms = {r.term for r in own.lexicon.collect()}
    assert terms <= {"same words", "words here", "same words here"} and all(r.df == 8 for r in own.lexicon.collect())


def test_grouped_query_has_one_row_for_a_term_of_several_chunks(spark, monkeypatch):
    """Before, a term of more than CHUNK documents came as several rows, which its SQL doesn't have."""
    from sparkquill.plans import queries

    rows = [("a", d, d % 3 + 1) for d in range(50)] + [("b", 7, 2)]
    own = Index(spark.createDataFrame(rows, "term string, doc_id long, tf long"))
    monkeypatch.setattr(layout, "CHUNK", 6)
    assert own.grouped().where("term = 'a'").count() > 5
    want = {t: (0, ",".join(f"{d},{n}" for x, d, n in rows if x == t)) for t in "ab"}
    assert {r.term: (r.chunk, r.entries) for r in queries._grouped_text(own).collect()} == want


def test_tokens_without_places_are_those_of_the_full_tokenizer(spark):
    """Stem indexes take them from one pattern over the text, and look at unusual words alone; before, a lambda went over every word."""
    from sparkquill.functions.classes import token_bag, token_groups

    r = random.Random(8)
    parts = ["word", "Word,", "(word).", "..a.b", "march", "March", "march,", "may", "12", "2019", "3,", "(555)", "(555)123-4567", "555-1234", "(555/", "", "  ", "\n", "\t", "a-b1", "x@y.org", "$3,000.5", "12%", "été", "10.0.0.1", "(", ".,", "•dot", "i/o3", "01/02/2020", "www.a.b1", "μm", "pre-war"]
    texts_ = [" ".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(600)] + ["march 3, 2019 x", "march 3, 2019", "(555) 123-4567", None]
    rows = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = rows.select("text", F.sort_array(token_bag(F.col("text"))).alias("a"), F.sort_array(F.flatten(token_groups(F.col("text")))).alias("b")).collect()
    assert all(x.a == x.b for x in got) and sum(len(x.b) for x in got) > 1000
    plan = index_of(rows, Analyser.of("stem", ["word"])).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # stems are found where the words are


def test_sums_of_a_ranking_stay_with_their_documents(spark, saved, topics):
    """Before, each task's sums for (query, document) were shuffled, which are many times the postings."""
    query = saved.analyser.query_terms(topics)
    wanted = saved.wanted(query)
    scoring = rank.Scoring("x", saved, rank.settled(query.join(saved.lexicon_of(wanted), "term")), wanted, lambda tf, dl: tf * F.col("qtf"))
    plan = scoring.scores()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(qid" not in plan


@pytest.mark.parametrize("step", ["scores", "bounds"])
def test_sums_of_a_task_are_bounded(spark, saved, topics, monkeypatch, step):
    """Before, tasks were dealt by the postings' bytes, so their sums grew with the input and with the queries that share a term."""
    query = saved.analyser.query_terms(topics)
    wanted = saved.wanted(query)
    scoring = rank.Scoring("x", saved, rank.settled(query.join(saved.lexicon_of(wanted), "term")), wanted, lambda tf, dl: tf * F.col("qtf"))
    rows = lambda: {tuple(r) for r in getattr(scoring, step)().collect()}
    whole = rows()
    monkeypatch.setattr(rank, "SUMS", 100)
    assert rows() == whole
    parts = getattr(scoring, step)()
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert sum(sizes) == len(whole) and max(sizes) < 300 and plan.count("REPARTITION_BY_NUM") == 1
    assert "hashpartitioning(qid" not in plan


@pytest.mark.parametrize("k", [1, 3])
def test_ends_are_picked_in_their_tasks(spark, monkeypatch, request, k):
    """Before, all scores were written and sorted by two scans."""
    monkeypatch.setattr(rank, "ROWS", 20)
    r = random.Random(3)
    rows = [(f"q{r.randrange(4)}", i, r.choice([-1.0, 0.0, 0.5, float("inf"), float("nan"), None])) for i in range(300)] + [("one", 7, 2.0)]
    scores = spark.createDataFrame(rows, "qid string, doc_id long, score double").repartition(3).select("*", F.spark_partition_id().alias("part"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "15")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    ends = rank._ends(scores, k)
    assert ends.count() <= 3 * 5 * 2 * k
    assert {x.qid: x.n for x in ends.groupBy("qid").agg(F.sum("n").alias("n")).collect()} == {x.qid: x["count"] for x in scores.groupBy("qid").count().collect()}
    whole = rank.top_k(scores, None, "t").collect()
    total = {q: sum(x.qid == q for x in whole) for q in {x.qid for x in whole}}
    assert rows_of(rank.top_k(scores, None, "t", both_ends=k)) == sorted(str(x) for x in whole if x["rank"] < k or x["rank"] >= total[x.qid] - k)


def test_postings_of_frequent_terms_meet_their_idf_where_they_are(spark, saved, monkeypatch):
    """Before, all postings were shuffled by term as soon as the lexicon was too large to be broadcast."""
    df = {r.term: r.df for r in saved.lexicon.collect()}
    total = saved.totals
    monkeypatch.setattr(layout, "OFTEN", 20)
    assert 0 < sum(n < sum(df.values()) / 20 for n in df.values()) < len(df)
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = saved.weights()
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.doc_id, r.term): r.w for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    want = {(r.doc_id, r.term): (math.log10(r.tf) + 1) * math.log10(total.N / df[r.term]) for r in saved.postings.collect()}
    assert got == pytest.approx(want)


def test_many_terms_are_few_comparisons_of_a_scan(spark, saved):
    """Before, each of up to 200 terms was a comparison of its own for every row group and row: 15 s for 1 s on 12.7 million postings."""
    terms = sorted(r.term for r in saved.lexicon.collect())
    some = [t for k, t in enumerate(terms) if k % 8] + ["", "zz", "\u00e9", "\U0001f600"]
    assert 2 * layout.RANGES <= len(some) <= layout.TERMS
    wanted = saved.wanted(spark.createDataFrame([(t,) for t in some], "term string"))
    rows = layout.pruned(saved.postings, wanted)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"term#\d+ (?:=|>=|<=) ", plan)) <= 2 * layout.RANGES
    assert {(r.term, r.doc_id) for r in rows.collect()} == {(r.term, r.doc_id) for r in saved.postings.collect() if r.term in set(some)}


def test_distinct_words_of_a_stretch_are_looked_at_once(spark, monkeypatch):
    """Before, patterns went over every text in full; now they, and the tokenizer, see each distinct word of a stretch."""
    from sparkquill.operators import counts

    monkeypatch.setattr(counts, "WORDS", 40)
    r = random.Random(9)
    parts = ["word", "Word,", "(word).", "..a.b", "march", "March", "march,", "may", "12", "2019", "3,", "(555)", "(555)123-4567", "555-1234", "(555/", "", "  ", "\n", "\t", "a-b1", "x@y.org", "$3,000.5", "été", "10.0.0.1", "(", ".,", "•dot", "wor,d", "w'or'd", "the", "Kelvin", "İ", "ΟΣ", "pre-war", "running", "runs"]
    texts_ = [" ".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(400)] + ["march 3, 2019 x", "march 3, 2019", "(555) 123-4567", "", "\n \n", None, "x " * 500]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(3, "doc_id")
    key = lambda row: (row.doc_id, row.term)
    for analyser, given in ((Analyser("positional", "words"), None), (Analyser("single", "words", stop_words=("word",)), None), (Analyser.of("stem", ["the", "word"]), stem), (Analyser("single"), None)):
        plain = counts.postings_of_texts(analyser.arrays(docs), analyser.positions, given)
        made = index_of(docs, analyser).postings
        assert made.schema == plain.schema
        a, b = sorted(made.collect(), key=key), sorted(plain.collect(), key=key)
        same = [c for c in made.columns if c != "n_terms"]
        assert len(a) > 500 and [[x[c] for c in same] for x in a] == [[x[c] for c in same] for x in b]
        assert sorted((x.doc_id, x.n_terms) for x in a if x.n_terms) == sorted((x.doc_id, x.n_terms) for x in b if x.n_terms)
        assert not re.search("regexp_(?:replace|extract_all)[^\n]*text#", made._jdf.queryExecution().executedPlan().toString())
    phrases = {(x.doc_id, x.term): (x.tf, x.dl) for x in index_of(docs, Analyser("phrase", stop_words=("the",))).postings.collect()}
    counted = layout.postings(Analyser("phrase", stop_words=("the",)).tokens(docs))
    df = {x.term for x in counted.groupBy("term").count().where("count >= 5").collect()}
    assert {k: v[0] for k, v in phrases.items()} == {(x.doc_id, x.term): x.tf for x in counted.collect() if x.term in df} and phrases
    for text, want in (("word runs", {"word", "run"}), ("caf\u00e9", {"caf"}), ("\u00e9", set()), ("", set()), (None, set()), ("(555) 123-4567", {"555", "5551234567", "1234567", "123", "4567"})):
        one = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert {x.term for x in index_of(one, Analyser.of("stem")).postings.collect()} == want == {stem(x.term) for x in layout.group_tokens(one).collect()}
