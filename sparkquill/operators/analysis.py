"""How texts become terms: a value that an index keeps, so that queries are read the same way."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparkquill.functions.classes import token_bag, token_groups
from sparkquill.functions.stem import stem_of, stemmed
from sparkquill.functions.text import phrases, plain_words

#: Changes when a built-in tokenizer or stemmer gives other terms for the same text.
VERSION = 1
#: Tokenizers by name: a text column to an array of arrays, the tokens of each word, which share a position.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"full": token_groups, "words": lambda text: F.transform(plain_words(text), lambda w: F.array(w))}
#: Stemmers by name: a column of terms to one of stems.
STEMMERS: dict[str, Callable[[Column], Column]] = {"porter": stem_of}
KINDS = ("single", "stem", "positional", "phrase")


def register_tokenizer(name: str, tokenizer: Callable[[Column], Column]) -> None:
    TOKENIZERS[name] = tokenizer


def register_stemmer(name: str, stemmer: Callable[[Column], Column]) -> None:
    STEMMERS[name] = stemmer


@dataclass(frozen=True)
class Analyser:
    """kind: single or stem (terms and their counts), positional (with places; no stop words go) or phrase (pairs and triples of words).
    tokenizer, stemmer: names of registered ones. stop_words go before stemming. An index of phrases keeps those of at least phrase_df
    documents. version: of the rules that made the index."""

    kind: str = "single"
    tokenizer: str = "full"
    stemmer: str | None = None
    stop_words: tuple[str, ...] = ()
    phrase_df: int = 5
    version: int = VERSION

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"no such index: {self.kind}")
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"no such tokenizer: {self.tokenizer}")
        if self.stemmer is not None and self.stemmer not in STEMMERS:
            raise ValueError(f"no such stemmer: {self.stemmer}")
        if self.version != VERSION:
            raise ValueError(f"the index was made by version {self.version} of the rules; this is {VERSION}")

    @staticmethod
    def of(kind: str, stop_words: list[str] | None = None, **options: object) -> Analyser:
        """The usual analyser of a kind."""
        stop = () if kind == "positional" else tuple(sorted(stop_words or ()))
        return Analyser(kind, stop_words=stop, **({"stemmer": "porter"} if kind == "stem" else {}) | options)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Analyser:
        own = json.loads(text)
        return Analyser(**own | {"stop_words": tuple(own["stop_words"])})

    @property
    def positions(self) -> bool:
        return self.kind == "positional"

    def _flat(self, text: Column) -> Column | None:
        """The tokens of a text, one a place; None for a tokenizer whose words may give several."""
        if self.kind == "phrase":
            stop = list(self.stop_words) or None
            return F.concat(phrases(text, 2, stop), phrases(text, 3, stop))
        if self.tokenizer != "words":
            return None
        words = plain_words(text)
        return F.filter(words, lambda t: ~t.isin(*self.stop_words)) if self.stop_words else words

    def _groups(self, text: Column) -> Column:
        """An array of each word's tokens, without stop words; words that are left without tokens are gone."""
        found = TOKENIZERS[self.tokenizer](text)
        if not self.stop_words:
            return found
        return F.filter(F.transform(found, lambda g: F.filter(g, lambda t: ~t.isin(*self.stop_words))), lambda g: F.size(g) > 0)

    def arrays(self, docs: DataFrame) -> DataFrame:
        """(doc_id, dl, w) of documents (doc_id, text), before stemming: w has a document's terms, in no order if the index has no places, or an
        array of tokens for each of its words; dl is the number of all its tokens."""
        flat = self._flat(F.col("text"))
        if flat is None and not self.positions and TOKENIZERS[self.tokenizer] is token_groups:  # without places their order doesn't matter
            bag = token_bag(F.col("text"))
            flat = F.filter(bag, lambda t: ~t.isin(*self.stop_words)) if self.stop_words else bag
        rows = docs.select("doc_id", (self._groups(F.col("text")) if flat is None else flat).alias("w"))
        return rows.select("doc_id", F.size(F.flatten("w") if flat is None else F.col("w")).cast("long").alias("dl"), "w")

    def tokens(self, docs: DataFrame) -> DataFrame:
        """(doc_id, dl, pos, term) of documents (doc_id, text), before stemming; dl is the number of the document's tokens."""
        # lengths are taken before the words are exploded: an expression beside explode() is worked out for each of its rows, arrays and all
        flat = self._flat(F.col("text"))
        rows = docs.select("doc_id", (self._groups(F.col("text")) if flat is None else flat).alias("w"))
        rows = rows.select("doc_id", F.size(F.flatten("w") if flat is None else F.col("w")).cast("long").alias("dl"), "w")
        if flat is not None:
            return rows.select("doc_id", "dl", F.posexplode("w").alias("pos", "term"))
        return rows.select("doc_id", "dl", F.posexplode("w").alias("pos", "group")).select("doc_id", "dl", "pos", F.explode("group").alias("term"))

    def query_terms(self, topics: DataFrame, text: Column | str = "title") -> DataFrame:
        """(qid, term, qtf) of topics (qid and text), read as the index's documents were."""
        text = F.col(text) if isinstance(text, str) else text
        flat = self._flat(text)
        terms = topics.select("qid", F.explode(F.flatten(self._groups(text)) if flat is None else flat).alias("term"))
        if self.stemmer:
            terms = stemmed(terms, stemmer=STEMMERS[self.stemmer])
        return terms.groupBy("qid", "term").agg(F.count("*").alias("qtf"))
