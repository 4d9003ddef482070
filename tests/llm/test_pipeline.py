"""The pipeline's stages against brute force on small tables."""

import random

import corpus_pipeline
from sparkquill.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "a plain question without any slots that asks about the colour of the evening sky"


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(80)) for _ in range(60)]
    docs = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts)]
    docs += [(100 + i, " ".join(["nasty vile" if k % 10 == 0 else word() for k in range(80)]), "en", "s1", 9) for i in range(30)]
    docs += [(200, texts[3], "en", "s9", 9), (201, texts[4] + " tail", "de", "s9", 9), (202, " ".join(word() for _ in range(60)) + " " + ITEM, "en", "s2", 9), (203, texts[6][:300] + " password = 'q8w7e6r5t4' end", "en", "s3", 9), (204, None, "en", "s3", 0), (205, "", None, None, 0), (1, texts[1], "en", "s1", 9)]
    folder = str(tmp_path)
    frame = spark.createDataFrame(docs, SCHEMA)
    frame.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 130)) for i, *_ in docs if i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    read = spark.read.parquet(f"{folder}/documents.parquet")
    score = {x.doc_id: x.score for x in toxicity.toxicity_scores(read, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    now = read
    stages = {name: f for name, f in corpus_pipeline.STAGES}
    assert len(stages) == 5
    now = stages["toxicity"](spark, now, folder)
    assert now.columns == read.columns
    assert sorted(x.doc_id for x in now.collect()) == sorted(i for i, *_ in docs if score[i] < 0.5)
    assert sum(100 <= x.doc_id < 130 for x in now.collect()) < 5 and now.count() > 60
    before = {x.doc_id for x in now.collect()}
    now = stages["ngram_jaccard_join"](spark, now, folder)
    assert now.columns == read.columns
    assert sorted(x.doc_id for x in now.collect()) == sorted(before - {200, 201})
    now = stages["benchmark_decontamination"](spark, now, folder)
    assert now.columns == read.columns and {x.doc_id for x in now.collect()} == before - {200, 201, 202}
    now = stages["secret_scan"](spark, now, folder)
    assert now.columns == read.columns
    cut = {x.doc_id: x for x in now.collect()}
    assert cut.keys() == before - {200, 201, 202} and cut[203].text == texts[6][:300] + " [ASSIGN]' end" and cut[203].n_chars == len(cut[203].text)
    last = {x.doc_id: x for x in stages["sentencepiece"](spark, now, folder).collect()}
    assert {i: x.decoded for i, x in last.items()} == {i: x.text or "" for i, x in cut.items()}
    assert {x.doc_id for x in corpus_pipeline.run(spark, folder).collect()} == cut.keys()


def test_stages_with_clashing_columns_and_repeated_ids(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    a, b, c = (" ".join(word() for _ in range(50)) for _ in range(3))
    more = "row_ string, cuts string, text_ string, toxic_score double, id_ string, digest string, component_id string, sig string"
    docs = [(5, a, "en", "s", 1, *["x"] * 3, 0.9, *["x"] * 4), (5, b, "en", "s", 1, *["y"] * 3, 0.9, *["x"] * 4), (None, c, None, None, None, *[None] * 8), (None, c + " password = 'q8w7e6r5t4'", None, None, None, *[None] * 8), (7, None, "en", "s", 1, *["x"] * 3, 0.1, *["x"] * 4)]
    folder = str(tmp_path)
    frame = spark.createDataFrame(docs, f"{SCHEMA}, {more}")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == frame.columns, name
    kept = sorted(((x.doc_id, (x.text or "")[:20]) for x in now.collect()), key=str)
    assert [x[0] for x in kept].count(5) == 2 and len(kept) == 4 and sum(x[0] is None for x in kept) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), folder).count() == 0
