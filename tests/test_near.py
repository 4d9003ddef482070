"""Close places, and an index that keeps pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkquill.operators import near, rank
from sparkquill.operators.analysis import Analyser
from sparkquill.operators.index import Index, index_of

WORDS = "alpha beta gamma delta eps zeta eta theta".split()
SCHEMA = "first string, second string"


def texts():
    r = random.Random(4)
    return {i: [WORDS[min(int(r.paretovariate(0.8)) - 1, 7)] for _ in range(r.randrange(1, 50))] for i in range(60)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in texts().items()] + [(90, ""), (91, None), (92, "lonely"), (93, "apart")], "doc_id long, text string")


@pytest.fixture(scope="module")
def plain(spark, docs, tmp_path_factory):
    return index_of(docs, Analyser("positional", "words")).save(str(tmp_path_factory.mktemp("near") / "words"), 16)


KEPT = [("alpha", "beta"), ("beta", "alpha"), ("gamma", "gamma"), ("lonely", "apart"), ("alpha", "nowhere"), (None, "alpha"), ("alpha", "beta")]
ASKED = [*KEPT, ("delta", "eta"), ("beta", "zeta"), ("nowhere", "alpha"), ("alpha", None)]


@pytest.fixture(scope="module")
def kept(spark, docs, tmp_path_factory):
    own = index_of(docs, Analyser("positional", "words")).save(str(tmp_path_factory.mktemp("near") / "pairs"), 16)
    return near.keep_pairs(own, spark.createDataFrame(KEPT, SCHEMA), 5)


def brute(pairs, width, compat=False):
    want = {}
    for x, y in set(pairs):
        for d, w in texts().items():
            p1, p2 = ([i for i, t in enumerate(w) if t == z] for z in (x, y))
            if p1 and p2:
                want[x, y, d] = sum(abs(a - b) < width and not (compat and b - width in p1) for a in p1 for b in p2)
    return want


@pytest.mark.parametrize("width,compat", [(5, False), (5, True), (3, False), (100, False)])
def test_rows_do_not_depend_on_what_is_kept(spark, plain, kept, width, compat):
    asked = spark.createDataFrame(ASKED, SCHEMA)
    want = brute(ASKED, width, compat)
    for index in (plain, kept):
        rows = near.pair_counts(asked, index, width, compat).collect()
        assert {(r.first, r.second, r.doc_id): r.near for r in rows} == want and len(rows) == len(want)


def test_no_pairs_and_no_documents(spark, plain, kept):
    none = spark.createDataFrame([], SCHEMA)
    assert near.pair_counts(none, plain).isEmpty() and near.pair_counts(none, kept, 5).isEmpty()
    empty = index_of(spark.createDataFrame([], "doc_id long, text string"), Analyser("positional", "words"))
    assert near.pair_counts(spark.createDataFrame(ASKED, SCHEMA), empty).isEmpty()


def test_kept_pairs_are_read_from_their_buckets_and_no_places_are(spark, kept):
    rows = near.pair_counts(spark.createDataFrame([("alpha", "beta"), ("lonely", "apart")], SCHEMA), kept, 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET|=)", plan) and "EqualTo(first,alpha)" in plan
    assert {r.first for r in rows.collect()} == {"alpha"}


def test_pairs_replace_those_kept_before_and_a_plain_index_has_no_place_for_them(spark, docs, tmp_path):
    own = index_of(docs, Analyser("positional", "words"))
    with pytest.raises(ValueError, match="saved"):
        near.keep_pairs(own, spark.createDataFrame(KEPT, SCHEMA))
    own = near.keep_pairs(own.save(str(tmp_path / "i"), 4), spark.createDataFrame(KEPT, SCHEMA))
    again = near.keep_pairs(own, spark.createDataFrame([("delta", "eta")], SCHEMA), 7)
    assert {(r.first, r.second, r.df) for r in again.pairs["lexicon"].select("first", "second", "df").collect()} == {("delta", "eta", len(brute([("delta", "eta")], 7)))}
    assert Index.load(spark, str(tmp_path / "i")).pairs["how"] == [7, False]
    assert {(r.first, r.second) for r in own.pairs["lexicon"].collect()} == {p for p in KEPT if None not in p}


def test_commonest_pairs(spark, plain):
    r = random.Random(2)
    asked = [(r.choice([*WORDS, "nowhere"]), r.choice(WORDS)) for _ in range(200)] + [(None, "alpha")]
    df = {w: sum(w in t for t in texts().values()) for w in WORDS}
    cost = {p: asked.count(p) * min(df[p[0]], df[p[1]]) for p in asked if p[0] in df}
    got = [(x.first, x.second) for x in near.commonest_pairs(spark.createDataFrame(asked, SCHEMA), plain, 20).collect()]
    assert sorted(got) == sorted(sorted(cost, key=lambda p: (-cost[p], p))[:20])


@pytest.mark.parametrize("lengths", [False, True])
def test_proximity_is_the_same_with_kept_pairs(spark, docs, plain, kept, lengths):
    topics = spark.createDataFrame([(1, "alpha beta alpha"), (2, "gamma gamma zeta nothing"), (3, "delta eta lonely apart"), (4, ""), (5, None)], "qid int, title string")
    # lengths of an index that lacks a document: it counts for the pairs' df, but isn't ranked
    other = {"doc_stats": index_of(docs.where("doc_id <> 3"), Analyser(tokenizer="words")).doc_stats} if lengths else {}
    runs = [sorted(rank.proximity(topics, F.split("title", " "), i, None, 5, **other).collect()) for i in (plain, kept)]
    assert runs[0] == runs[1] and len(runs[0]) > 40 and not (lengths and any(r.doc_id == 3 for r in runs[0]))


def test_close_places_of_any_arrays(spark):
    r = random.Random(1)
    rows = [(sorted(r.sample(range(2000), n)), sorted(r.sample(range(2000), m))) for n, m in ((0, 0), (0, 9), (9, 0), (1, 1), (300, 2), (2, 300), (400, 500))]
    rows += [([0, 2**31 - 1], [0, 2**31 - 1]), ([5, 1], [9, 2, 2])]
    given = spark.createDataFrame(rows, "a array<int>, b array<int>").coalesce(1)
    for width in (0, 1, 30, 2**31, 2**40):
        got = [x.n for x in given.select(near.close_places(F.col("a"), F.col("b"), width).alias("n")).collect()]
        assert got == [sum(abs(x - y) < width for x in a for y in b) for a, b in rows]


def test_close_places_of_a_very_long_text(spark):
    n = 3_000_000  # two million and one million places of one document; their product is beyond any loop
    long = spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).alias("s")).select(F.filter("s", lambda x: x % 3 != 0).alias("a"), F.filter("s", lambda x: x % 3 == 0).alias("b"))
    got = long.select(near.close_places(F.col("a"), F.col("b"), 2).alias("n")).first().n
    assert got == 2 * (n // 3) - 1


@pytest.mark.parametrize("width,compat", [(5, False), (5, True), (100, False), (0, False)])
def test_documents_are_counted_whole_wherever_batches_end(spark, plain, monkeypatch, width, compat):
    """The places of a document may come in several batches, and be more than are searched at once."""
    asked, own = spark.createDataFrame(ASKED, SCHEMA), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    whole = {(r.first, r.second, r.doc_id): r.near for r in near.pair_counts(asked, plain, width, compat).collect()}
    spark.conf.set(own[0], "3")
    monkeypatch.setattr(near, "PLACES", 20)
    try:
        parts = near.pair_counts(asked, plain, width, compat).collect()
    finally:
        spark.conf.set(*own)
    assert {(r.first, r.second, r.doc_id): r.near for r in parts} == whole == brute(ASKED, width, compat) and len(parts) == len(whole)
    monkeypatch.setattr(near, "FEW_PAIRS", 2)  # more pairs than tasks get meet by joins
    assert {(r.first, r.second, r.doc_id): r.near for r in near.pair_counts(asked, plain, width, compat).collect()} == whole


def test_places_are_shuffled_once_however_many_pairs_a_word_is_in(spark, plain):
    """Before, each pair carried a copy of its first word's places through a join by word and document."""
    r = random.Random(3)
    asked = spark.createDataFrame([(x, y) for x in WORDS for y in r.sample(WORDS, 5)], SCHEMA)
    plan = near.pair_counts(asked, plain)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1 and len(re.findall("Join ", plan)) == 2 and "MapInArrow" in plan
