"""Text to words: entity decoding, splitting, stripping, phrases."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed values.
DELETED = "!\"&'*+:;<=>?[]^_`{|}~ "
STRIPPED = "(),•"
ENTITIES = [("&amp;", "&"), ("&para;", "¶"), ("&sect;", "§"), ("&hyph;", "-"), ("&times;", "×"), ("&blank;", " "), ("&mu;", "μ"), ("&ntilde", "ñ"), ("&bull;", "•")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once. A column that is named inside a lambda is worked out for each element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_entities(text: Column) -> Column:
    """Replaces the corpus' entities one after the other, so ``&amp;para;`` becomes the paragraph sign."""
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def _spaced(text: Column, lines: bool = True) -> Column:
    """A document's text without the punctuation that is deleted inside words: its words are the runs of other characters than spaces.
    Works on whole texts, so that words needn't be handled one by one."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(F.translate(text, "\n", " ") if lines else text, _DELETED_CLASS, "")


_DELETED_CLASS = "[" + re.sub(r"([\\^\]\[&-])", r"\\\1", DELETED.replace(" ", "")) + "]"


def split_words(text: Column, lines: bool = True) -> Column:
    """Splits at single spaces, deletes punctuation inside words and drops what is left empty. Tabs don't separate; line breaks do, unless
    lines is false."""
    return F.regexp_extract_all(_spaced(text, lines), F.lit("[^ ]+"), F.lit(0))


def strip_word(word: Column) -> Column:
    """Deletes brackets, commas and bullets, and full stops at either end."""
    return F.regexp_replace(F.translate(word, STRIPPED, ""), r"^\.+|\.+$", "")


def plain_words(text: Column) -> Column:
    """The words of letters only, lower-cased, in order: the word class of the full tokenizer. One pass over the text finds them."""
    low = F.regexp_replace(F.lower(_spaced(text)), f"[{STRIPPED}]", "")
    return F.regexp_extract_all(low, F.lit(r"(?<![^ ])\.*+([a-z]++)\.*+(?![^ ])"), F.lit(1))


def lowered(text: Column) -> Column:
    """A text's words, lower-cased and with spaces between them, as phrases() reads them."""
    return F.lower(_spaced(text))


def phrases(text: Column, size: int, stop_words: list[str] | None = None) -> Column:
    """Runs of `size` adjacent words. A word that has other characters than letters, or is a stop word, is a barrier."""
    low = F.regexp_replace(F.lower(_spaced(text)), " {2,}", " ")
    stop = rf"(?!(?:{'|'.join(map(re.escape, sorted(stop_words)))})(?![^ ]))" if stop_words else ""
    run = " ".join([rf"{stop}[a-z]++"] * size)
    return F.regexp_extract_all(low, F.lit(rf"(?<![^ ])(?=({run})(?![^ ]))[a-z]++"), F.lit(1))


def adjacent_pairs(words: Column) -> Column:
    """Each word of an array with its next one, as structs of first and second."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, 1, n).alias("first"), F.slice(words, 2, n).alias("second"))


#: What lies between the pieces of a text that are compared as they are.
BREAKS = " \n"


def pieces(text: Column) -> Column:
    """The runs of other characters than spaces and line breaks."""
    return F.regexp_extract_all(text, F.lit(f"[^{BREAKS}]+"), F.lit(0))


def piece_runs(text: Column, size: int) -> Column:
    """Every stretch of `size` whole pieces, with what lies between them, as it is in the text."""
    run = rf"(?:[^{BREAKS}]++[{BREAKS}]++){{{size - 1}}}[^{BREAKS}]++"
    return F.regexp_extract_all(text, F.lit(rf"(?<![^{BREAKS}])(?=({run}))[^{BREAKS}]++"), F.lit(1))


def proximity_words(query: Column) -> Column:
    """Words of a proximity query: tabs deleted, lower-cased, brackets as spaces, split at commas, spaces, slashes and bars."""
    clean = F.translate(F.translate(F.lower(query), "\t", ""), "()", "  ")
    return F.filter(F.split(clean, r"[, /|]"), lambda x: F.length(x) > 0)
