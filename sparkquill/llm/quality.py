"""Quality scores by a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each turn fits a shallow tree of one feature to the residuals, at a small rate, and adds it
to that feature's lookup table. The pairs that explain most of what is left then get tables of their own in the same way. A score is
the sum of the table entries of a text's bins, so the model can be read feature by feature and scoring is a few array additions. At
most SAMPLE labelled texts of each label are learnt from; the bias is shifted to the labels' true odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkquill.llm.batches import Words, labelled_sample, remainder, slices, text_column

BINS, PAIR_BINS = 32, 8
#: Labelled texts of each label that are learnt from at most, those with the least hashes of their ids.
SAMPLE = 2000
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 150, 60, 8, 0.1, 5.0

FEATURES = ("log_words", "word_length", "long_words", "short_words", "letters", "digits", "upper", "marks", "symbols", "pipes", "exclaims", "stops", "lines", "line_length", "repeated_words", "repeated_lines", "repeated_pairs", "top_word", "non_ascii", "spaces")


def _classes(values: str | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in values]] = True
    return out


_CLASS = {
    "letters": _classes([*range(65, 91), *range(97, 123), *range(128, 256)]), "digits": _classes("0123456789"), "upper": _classes([*range(65, 91)]),
    "marks": _classes(".,;:'\"()-?"), "symbols": _classes("#$%&*+=<>@[]^_`{}~\\/"), "pipes": _classes("|"), "exclaims": _classes("!"), "stops": _classes("."), "non_ascii": _classes([*range(0xC0, 256)]), "spaces": _classes(" \t\n\r"),
}


def _repeated(owner: np.ndarray, key: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the share of its keys that repeat an earlier one, and the share of its most frequent key."""
    n = np.bincount(owner, minlength=many)
    k = np.sort(owner.astype(np.uint64) << np.uint64(40) | key >> np.uint64(24))  # a slice has far fewer than 2**24 texts
    o = (k >> np.uint64(40)).astype(np.int64)
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    distinct = np.bincount(o[new], minlength=many)
    runs = np.diff(np.append(np.flatnonzero(new), len(k)))
    top = np.zeros(many, np.int64)
    np.maximum.at(top, o[new], runs)
    return 1 - distinct / np.maximum(n, 1), top / np.maximum(n, 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    many = len(column)
    words = Words(column)
    buf, off = words.buf, words.off
    size = np.diff(off)
    safe = np.maximum(size, 1)

    bytes_ = np.bincount(np.repeat(np.arange(many) * 256, size) + buf, minlength=256 * many).reshape(many, 256)
    share = {k: bytes_[:, c].sum(1) / safe for k, c in _CLASS.items()}
    owner, length = words.text_of(), words.end - words.start
    n = np.diff(words.first)
    safe_n = np.maximum(n, 1)
    by_word = lambda w: np.bincount(owner, weights=w, minlength=many) / safe_n
    h = words.hashes()
    again, top = _repeated(owner, h, many)
    same = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    pairs, _ = _repeated(owner[1:][same], (h[:-1] * np.uint64(3) + h[1:])[same], many) if same.any() else (np.zeros(many), None)
    breaks = np.zeros(256, bool)
    breaks[10] = True
    lines = Words(column, breaks)
    n_lines = np.diff(lines.first)
    line_again, _ = _repeated(lines.text_of(), lines.hashes(), many)
    columns = share | {"log_words": np.log1p(n), "word_length": by_word(length.astype(float)), "long_words": by_word(length > 12), "short_words": by_word(length < 4), "lines": n_lines / safe_n, "line_length": np.log1p(size / np.maximum(n_lines, 1)), "repeated_words": again, "repeated_lines": line_again, "repeated_pairs": pairs, "top_word": top}
    return np.stack([columns[f] for f in FEATURES], 1)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins with gradient and curvature sums g and h: its value in each bin."""
    out = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2:
        return out
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * a / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE)
    k = int(gain.argmax()) + 1
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _table2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of one cut of each feature (four leaves) over two features' bins: its values, and how much it gains."""
    a, b = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not i.size:
        return np.zeros_like(g), 0.0
    quads = lambda s: (s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j])
    gain = sum(p * p / (q + RIDGE) for p, q in zip(quads(a), quads(b), strict=True)) - a[-1, -1] ** 2 / (b[-1, -1] + RIDGE)
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    p, q = at[0] + 1, at[1] + 1
    out = np.zeros_like(g)
    for rows, cols in ((slice(0, p), slice(0, q)), (slice(0, p), slice(q, None)), (slice(p, None), slice(0, q)), (slice(p, None), slice(q, None))):
        out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return out, float(gain[at])


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """Cuts and lookup tables from features and labels."""
    k = x.shape[1]
    model: dict = {"cuts": [], "tables": [], "pair_cuts": [], "pairs": [], "pair_tables": [], "bias": 0.0}
    if not len(y) or len(set(y.tolist())) < 2:
        model |= {"cuts": [np.zeros(0)] * k, "tables": [np.zeros(1)] * k, "pair_cuts": [np.zeros(0)] * k, "bias": 4.0 if len(y) and y[0] else -4.0}
        return model
    model["cuts"] = [_cuts(x[:, f], BINS) for f in range(k)]
    model["pair_cuts"] = [_cuts(x[:, f], PAIR_BINS) for f in range(k)]
    fine = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model["cuts"])]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model["pair_cuts"])]
    tables = [np.zeros(len(c) + 1) for c in model["cuts"]]
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    model["bias"] = float(z[0])

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            r, w = residuals()
            step = RATE * _tree(np.bincount(fine[f], r, len(tables[f])), np.bincount(fine[f], w, len(tables[f])))
            tables[f] += step
            z += step[fine[f]]
    r, w = residuals()
    shape = [len(c) + 1 for c in model["pair_cuts"]]

    def sums(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[f] * shape[g] + rough[g], v, shape[f] * shape[g]).reshape(shape[f], shape[g])

    ranked = sorted(combinations(range(k), 2), key=lambda p: -_table2(sums(*p, r), sums(*p, w))[1])
    model["pairs"] = ranked[:PAIRS]
    extra = [np.zeros((shape[f], shape[g])) for f, g in model["pairs"]]
    for _ in range(PAIR_ROUNDS):
        for t, (f, g) in zip(extra, model["pairs"], strict=True):
            r, w = residuals()
            step = RATE * _table2(sums(f, g, r), sums(f, g, w))[0]
            t += step
            z += step[rough[f], rough[g]]
    return model | {"tables": tables, "pair_tables": extra}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model["bias"])
    for f, (c, t) in enumerate(zip(model["cuts"], model["tables"], strict=True)):
        z += t[np.searchsorted(c, x[:, f], side="right")]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model["pair_cuts"])]
    for (f, g), t in zip(model["pairs"], model["pair_tables"], strict=True):
        z += t[rough[f], rough[g]]
    return 1 / (1 + np.exp(-z))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 3) == 1


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    rows, shift = labelled_sample(docs, labels, "quality", held_out(F.col("doc_id")), SAMPLE)
    parts = [features(text_column(pa.array([r.text for r in rows[i : i + 100]], pa.string()))) for i in range(0, len(rows), 100)]  # some at a time: they need less room
    model = train(np.concatenate(parts) if parts else np.zeros((0, len(FEATURES))), np.array([r.y for r in rows], float))
    return model | {"bias": model["bias"] + shift}


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, held_out (its labels are never learnt from), score (0 to 1), predicted (1 if score >= 0.5).

    docs has doc_id and text, labels doc_id and quality. Only the text is an input of a score. Null and empty texts have the features
    of an empty text. Null ids are scored and count as not held out. Repeated rows get equal scores. With no labelled rows of both
    kinds every score is a constant. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in slices(batches, "text"):
            yield pa.record_batch([part.column("doc_id"), pa.array(score(model.value, features(column)))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
