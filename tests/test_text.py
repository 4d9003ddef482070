"""Token classes against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparkquill.functions import classes, text
from sparkquill.functions.stem import stem

CASES = {
    "violence.": ["violence"], "u.s.": ["us"], "1,234": ["1234"], "1,234.5": ["1234.5"], "$1.50": ["$150"], "3.5%": ["3.5%"], "03/05/1994": ["03/05/1994"],
    "03/05/94": ["03/05/1994"], "03/05/68": ["03/05/2068"], "13/45/1994": [], "jan-5-1994": ["01/05/1994"], "jan-5-94": [], "12-31-1994": ["12311994", "1994"], "f-16": ["f16"],
    "pre-trial": ["pretrial", "trial"], "well-known": ["wellknown", "well", "known"], "192.168.0.1": ["192.168.0.1"], "300.1.2.3": ["300", "1", "2", "3", "300123"],
    "a@b@c.gov": ["a@b.c.gov", "a.b@c.gov"], "§12.3": ["§", "12.3"], "b2b": ["b2b"], "5mg/l": [], "mg/l": ["mg/l"], "-": [], "": [], "12345": ["12345"], "www.x1": ["www.x1"], "cañon": ["cañon"],
}


def test_classes(spark):
    rows = spark.createDataFrame([(w,) for w in CASES], "w string").select("w", classes.class_tokens(text.strip_word(F.col("w"))).alias("t")).collect()
    assert {r.w: r.t for r in rows} == CASES


@pytest.mark.parametrize(
    ("line", "groups"),
    [
        ("call (202) 523-4567 now", [["call"], ["202", "2025234567"], ["5234567", "523", "4567"], ["now"]]),
        ("call (202)523-4567 now", [["call"], ["202", "523", "4567", "2025234567"], ["now"]]),
        ("On March 5, 1994 it rained", [["on"], ["03/05/1994"], ["5"], ["1994"], ["it"], ["rained"]]),
        ("On March 45, 1994 it rained", [["on"], ["march"], ["45"], ["1994"], ["it"], ["rained"]]),
        ("a\nb", [["a"], ["b"]]),
        ("", []),
        (None, []),
    ],
)
def test_groups(spark, line, groups):
    assert spark.createDataFrame([(line,)], "t string").select(classes.token_groups(F.col("t")).alias("g")).first().g == groups


def test_phrases_do_not_cross_punctuation(spark):
    df = spark.createDataFrame([("The big red, house is old",), ("one",), (None,)], "t string")
    assert [r.p for r in df.select(text.phrases(F.col("t"), 2).alias("p")).collect()] == [["the big", "house is", "is old"], [], []]
    assert df.select(text.phrases(F.col("t"), 2, ["is"]).alias("p")).first().p == ["the big"]


def test_entities(spark):
    assert spark.range(1).select(text.decode_entities(F.lit("a &amp;para; &sect;3 x&hyph;y")).alias("x")).first().x == "a ¶ §3 x-y"


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("sky", "sky"), ("conditionally", "condit"), ("emotionally", "emot"), ("traditionally", "tradit"), ("hopefully", "hope"), ("fully", "fulli"), ("ally", "alli"), ("geologi", "geolog")])
def test_stems(word, root):
    assert stem(word) == root


def test_stems_against_sql():
    import duckdb
    import random

    from sparkquill.functions.stem import IRREGULAR, STEP2, STEP3, STEP4
    from sparkquill.plans.stemming import stem_table

    r = random.Random(7)
    ends = [a for a, _ in STEP2 + STEP3] + STEP4 + "s es ies ed ing ied eed y alli e ll sses".split()
    words = sorted({"".join(r.choice("aeiouybcdlstz") for _ in range(r.randrange(1, 7))) + r.choice(ends) + r.choice(["", "", "s", "ly"]) for _ in range(4000)} | set(IRREGULAR) | {"", "a", "b2b", "über"})
    con = duckdb.connect()
    con.execute("create table words as select unnest(?) as word", [words])
    assert dict(con.execute(stem_table("select word from words")).fetchall()) == {w: stem(w) for w in words}


def test_words_with_odd_characters(spark):
    """Whole-text expressions against the rules word by word."""
    import random
    import re

    r = random.Random(5)
    texts = ["".join(r.choice("ab .,;-'\\[]^&*()•\n\tÉ_|é$%1") for _ in range(80)) for _ in range(200)]
    low = lambda w: w.lower()
    split = lambda t: [x for x in (w.translate({ord(c): None for c in text.DELETED}) for w in t.replace("\n", " ").split(" ")) if x]
    strip = lambda w: re.sub(r"^\.+|\.+\Z", "", w.translate({ord(c): None for c in text.STRIPPED}))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for x in df.select("i", text.split_words(F.col("t")).alias("a"), text.plain_words(F.col("t")).alias("b"), text.phrases(F.col("t"), 2, ["a"]).alias("c")).collect():
        words = split(texts[x.i])
        assert x.a == words
        assert x.b == [w for w in (strip(low(w)) for w in words) if re.fullmatch("[a-z]+", w)]
        marked = [low(w) if re.fullmatch("[a-z]+", low(w)) and low(w) != "a" else None for w in words]
        assert x.c == [f"{p} {q}" for p, q in zip(marked[:-1], marked[1:], strict=True) if p and q]
