"""Porter's stemmer (1980) with the usual later extensions: a column expression, applied to a vocabulary rather than to every occurrence of
a word, and the same rules as a plain function for single words, which tests compare with it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sparkquill.functions.text import let

STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Words whose stems the rules would get wrong.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    s = _shape(w)
    return (len(w) >= 3 and s.endswith("cvc") and w[-1] not in "wxy") or (len(w) == 2 and s == "vc")


def stem(word: str) -> str:
    """The stem of one lower-cased word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = word
    # plurals
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past forms
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    # -alli goes before the other endings of its step, and its result takes that step again
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    for table in (STEP2, STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                root = w[: -len(end)]
                if _measure(root + "l" if end == "logi" else root) > 0:  # the l of -logi counts with the root
                    w = root + new
                break
    for end in sorted(STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        root = w[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short(root)):
            w = root
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _shape_of(word: Column) -> Column:
    """c and v for each letter, as _shape: of a run of y each one after a consonant is a vowel, so pairs of them are settled first, those
    after a consonant, then the others, then what is left of each run."""
    flat = F.translate(F.regexp_replace(word, "[^aeiouy]", "c"), "aeiou", "vvvvv")
    flat = F.regexp_replace(flat, r"(?:(?<=c)|(?<!^)\G)yy", "vc")
    flat = F.regexp_replace(flat, r"(?:(?<=v)|^|\G)yy", "cv")
    return F.translate(F.regexp_replace(flat, "(?<=c)y", "v"), "y", "c")


def _measure_of(word: Column) -> Column:
    return F.size(F.regexp_extract_all(_shape_of(word), F.lit("v+c+"), F.lit(0)))


def _short_of(word: Column) -> Column:
    return let(_shape_of(word), lambda s: (s.endswith("cvc") & ~F.right(word, F.lit(1)).isin("w", "x", "y")) | ((F.length(word) == 2) & (s == "vc")))


def _less(word: Column, n: int | Column) -> Column:
    return F.left(word, F.length(word) - n)


def _vowelled(word: Column) -> Column:
    return F.contains(_shape_of(word), F.lit("v"))


def _plural(w: Column) -> Column:
    four = w.endswith("ies") & (F.length(w) == 4)
    return F.when(four, _less(w, 1)).when(w.endswith("sses") | w.endswith("ies"), _less(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _less(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    def mended(x: Column) -> Column:
        double = (F.length(x) > 1) & (F.right(x, F.lit(1)) == F.substring(x, -2, 1)) & _shape_of(x).endswith("c")
        return (
            F.when(x.endswith("at") | x.endswith("bl") | x.endswith("iz"), F.concat(x, F.lit("e")))
            .when(double, F.when(F.right(x, F.lit(1)).isin("l", "s", "z"), x).otherwise(_less(x, 1)))
            .when((_measure_of(x) == 1) & _short_of(x), F.concat(x, F.lit("e")))
            .otherwise(x)
        )

    return (
        F.when(w.endswith("ied"), F.when(F.length(w) == 4, _less(w, 1)).otherwise(_less(w, 2)))
        .when(w.endswith("eed"), F.when(_measure_of(_less(w, 3)) > 0, _less(w, 1)).otherwise(w))
        .when(w.endswith("ed") & _vowelled(_less(w, 2)), let(_less(w, 2), mended))
        .when(w.endswith("ing") & _vowelled(_less(w, 3)), let(_less(w, 3), mended))
        .otherwise(w)
    )


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & (F.length(w) > 2) & _shape_of(_less(w, 1)).endswith("c"), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)


def _endings(table: list[tuple[str, str]], least: int) -> Callable[[Column], Column]:
    """A step that replaces a word's longest ending of the table if the measure of what stands before it is at least `least`."""
    longest = rf"^.*?({'|'.join(e for e, _ in table)})\z"

    def step(w: Column) -> Column:
        def replaced(end: Column) -> Column:
            def of_root(root: Column) -> Column:
                new = F.lit("")
                for e, x in table:
                    if x:
                        new = F.when(end == e, x).otherwise(new)
                counted = F.when(end == "logi", F.concat(root, F.lit("l"))).otherwise(root)  # the l of -logi counts with the root
                ion = (end != "ion") | root.endswith("s") | root.endswith("t")
                return F.when((_measure_of(counted) >= least) & ion, F.concat(root, new)).otherwise(w)

            return F.when(end == "", w).otherwise(let(_less(w, F.length(end)), of_root))

        return let(F.regexp_extract(w, longest, 1), replaced)

    return step


def _final_e(w: Column) -> Column:
    root = _less(w, 1)
    return F.when(w.endswith("e") & let(_measure_of(root), lambda m: (m > 1) | ((m == 1) & ~_short_of(root))), root).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & (_measure_of(_less(w, 1)) > 1), _less(w, 1)).otherwise(w)


def _alli(w: Column) -> Column:
    return F.when(w.endswith("alli") & (_measure_of(_less(w, 4)) > 0), _less(w, 2)).otherwise(w)


def stem_of(word: Column) -> Column:
    """The stem of a lower-cased word, as stem() gives it, without Python: each step is an expression over the one before, worked out once."""
    steps = [_plural, _past, _final_y, _alli, _endings(STEP2, 1), _endings(STEP3, 1), _endings([(e, "") for e in STEP4], 2), _final_e, _final_l]

    def after(k: int) -> Callable[[Column], Column]:
        return (lambda w: let(steps[k](w), after(k + 1))) if k < len(steps) else (lambda w: w)

    out = F.when(F.length(word) <= 2, word).otherwise(let(word, after(0)))
    for irregular, root in IRREGULAR.items():
        out = F.when(word == irregular, root).otherwise(out)
    return out


def stemmed(tokens: DataFrame, col: str = "term", stemmer: Callable[[Column], Column] = stem_of) -> DataFrame:
    """A table with the column's words as stems; each distinct word is stemmed once and joined back."""
    vocabulary = tokens.select(F.col(col).alias("_word")).distinct().withColumn("_stem", stemmer(F.col("_word")))
    return tokens.join(vocabulary, F.col(col) == F.col("_word"), "left").withColumn(col, F.coalesce("_stem", col)).drop("_stem", "_word")
