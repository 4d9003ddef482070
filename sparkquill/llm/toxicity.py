"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Inputs. Each word (a run of letters, lower-cased) is the sum of a hashed word vector and the mean of its hashed character grams'
vectors (five bytes around each byte). Windows. A text is scored in all its windows of WINDOW words, one every STRIDE words; the text's
score is the greatest of its windows. Training. In the first FIRST rounds up to PICK windows of each text, other ones in each round, carry
their text's label; later rounds learn from each text's highest window of all (multiple instances), so clean texts' worst windows are
learnt as clean. At most SAMPLE labelled texts of each label are learnt from; the logits are shifted to the labels' true odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkquill.llm.batches import LOWER, U64, Words, labelled_sample, mix, remainder, slices, spread, text_column

WINDOW, STRIDE = 64, 48
WORDS, GRAMS, SIZE, HIDDEN, POOL = 1 << 15, 1 << 13, 12, 8, 8
#: Labelled texts of each label that are learnt from at most, those with the least hashes of their ids.
SAMPLE = 1200
ROUNDS, BATCH, RATE = 6, 64, 0.01
#: Rounds that learn from random windows, and how many of a text in each.
FIRST, PICK = 3, 3
#: Steps that a round takes at least; with few labelled texts a round goes over its windows several times.
STEPS = 60

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Inputs:
    """Words of many texts as numbers of distinct words, and the windows over them."""

    def __init__(self, column: pa.Array):
        words = Words(column, _BETWEEN)
        h = words.hashes()
        distinct, at, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (distinct & U64(WORDS - 1)).astype(np.int64)
        start, end = words.start[at], words.end[at]
        n = np.maximum(1, end - start)  # one five-byte gram around each byte of the word; beyond its edges there are zeros
        low = np.concatenate([np.zeros(2, np.uint8), LOWER[words.buf], np.zeros(3, np.uint8)]).astype(U64)
        self.gram = np.empty(int(n.sum()), np.int16)
        at = 0
        for k in range(0, len(n), 20_000):  # some words at a time: their grams take much more room than their numbers
            a, m = start[k : k + 20_000], n[k : k + 20_000]
            spot, first = spread(a, m), np.repeat(a, m)
            last = np.repeat(end[k : k + 20_000], m)
            gram = np.zeros(len(spot), U64)
            for j in range(-2, 3):
                inside = (spot + j >= first) & (spot + j < last)
                gram |= low[spot + (j + 2)] * inside << U64(8 * (j + 2))
            self.gram[at : at + len(spot)] = mix(gram) & U64(GRAMS - 1)
            at += len(spot)
        self.gram_at = np.cumsum(n) - n
        self.gram_n = n
        count = np.diff(words.first)
        many = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
        many[count == 0] = 0
        self.text = np.repeat(np.arange(len(count)), many)
        self.start = words.first[self.text] + STRIDE * (np.arange(len(self.text)) - np.repeat(np.cumsum(many) - many, many))
        self.length = np.minimum(WINDOW, words.first[self.text + 1] - self.start)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the distinct word, whether there is one) for each window and place."""
        place = np.arange(WINDOW)
        mask = place < self.length[which, None]
        return np.where(mask, self.word[np.minimum(self.start[which, None] + place, len(self.word) - 1)], 0), mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, k=1.0: (r.standard_normal(s) * k / np.sqrt(s[0])).astype(np.float32)
    m = {"E": f(WORDS, SIZE, k=0.1 * np.sqrt(WORDS)), "C": f(GRAMS, SIZE, k=0.1 * np.sqrt(GRAMS))}
    for d in "fb":
        m |= {f"W{d}": f(SIZE, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return m | {"A": f(2 * HIDDEN, POOL), "v": f(POOL, 1)[:, 0], "w": f(2 * HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)}


def _vectors(m: dict, x: Inputs) -> np.ndarray:
    """A vector for each distinct word."""
    if not len(x.bucket):
        return np.zeros((1, SIZE), np.float32)
    return m["E"][x.bucket] + np.add.reduceat(m["C"][x.gram], x.gram_at) / x.gram_n[:, None].astype(np.float32)


def _run(m: dict, d: str, inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray, out: np.ndarray, keep: list | None = None) -> None:
    """One direction over all windows; out[t] gets the state after place t (zero where there is no word)."""
    h = np.zeros((len(ids), HIDDEN), np.float32)
    U, H = m[f"U{d}"], HIDDEN
    live = mask.astype(np.float32)
    for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
        x = inputs[ids[:, t]]
        g = h @ U
        rz = _sigmoid(x[:, : 2 * H] + g[:, : 2 * H])
        n = np.tanh(x[:, 2 * H :] + rz[:, :H] * g[:, 2 * H :])
        new = (n + rz[:, H:] * (h - n)) * live[:, t, None]
        if keep is not None:
            keep.append((t, h, g, rz, n))
        h = out[t] = new


def forward(m: dict, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window."""
    states = np.zeros((2, WINDOW, len(ids), HIDDEN), np.float32)
    for k, d in enumerate("fb"):
        steps: list | None = None if keep is None else keep.setdefault(d, [])
        _run(m, d, vectors @ m[f"W{d}"] + m[f"c{d}"], ids, mask, states[k], steps)
    h = np.concatenate([states[0], states[1]], 2)  # place, window, both directions
    u = np.tanh(h @ m["A"])
    s = np.where(mask.T, u @ m["v"], -1e9)
    a = np.exp(s - s.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tw,twh->wh", a, h)
    if keep is not None:
        keep |= {"h": h, "u": u, "a": a, "pooled": pooled}
    return pooled @ m["w"] + m["b"]


def gradients(m: dict, x: Inputs, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss over the windows."""
    keep: dict = {}
    p = _sigmoid(forward(m, vectors, ids, mask, keep))
    dz = ((p - y) / len(y)).astype(np.float32)
    h, u, a, pooled = (keep[k] for k in ("h", "u", "a", "pooled"))
    g = {"w": pooled.T @ dz, "b": dz.sum(keepdims=True)}
    dp = dz[:, None] * m["w"]
    da = np.einsum("wh,twh->tw", dp, h)
    ds = a * (da - (a * da).sum(0))
    dh = a[:, :, None] * dp
    du = ds[:, :, None] * m["v"] * (1 - u * u)
    g["v"] = np.einsum("tw,twp->p", ds, u)
    g["A"] = np.einsum("twh,twp->hp", h, du)
    dh += du @ m["A"].T
    dvec = np.zeros_like(vectors)
    H, live = HIDDEN, mask.astype(np.float32)
    for k, d in enumerate("fb"):
        U, W = m[f"U{d}"], m[f"W{d}"]
        dU, dW, dc = np.zeros_like(U), np.zeros_like(W), np.zeros(3 * H, np.float32)
        carry = np.zeros((len(ids), H), np.float32)
        for t, before, gate, rz, n in reversed(keep[d]):
            dnew = (dh[t][:, k * H : (k + 1) * H] + carry) * live[:, t, None]
            r, z = rz[:, :H], rz[:, H:]
            dn = dnew * (1 - z) * (1 - n * n)
            dr = dn * gate[:, 2 * H :] * r * (1 - r)
            dzz = dnew * (before - n) * z * (1 - z)
            dx = np.concatenate([dr, dzz, dn], 1)
            dg = np.concatenate([dr, dzz, dn * r], 1)
            dU += before.T @ dg
            carry = dnew * z + dg @ U.T
            dW += vectors[ids[:, t]].T @ dx
            dc += dx.sum(0)
            np.add.at(dvec, ids[:, t], dx @ W.T)
        g |= {f"U{d}": dU, f"W{d}": dW, f"c{d}": dc}
    used = np.flatnonzero(np.abs(dvec).sum(1))
    g["E"], g["C"] = np.zeros_like(m["E"]), np.zeros_like(m["C"])
    np.add.at(g["E"], x.bucket[used], dvec[used])
    spots = spread(x.gram_at[used], x.gram_n[used])
    np.add.at(g["C"], x.gram[spots], np.repeat(dvec[used] / x.gram_n[used, None].astype(np.float32), x.gram_n[used], 0))
    return g


def train(texts: list[str], y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """A model from labelled texts, by Adam."""
    m = new_model(seed)
    x = Inputs(text_column(pa.array(texts, pa.string())))
    if not len(x.text) or len(set(y.tolist())) < 2:
        m["b"][:] = 4.0 if len(y) and y.all() else -4.0
        m["w"][:] = 0
        return m
    r = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    bounds = np.searchsorted(x.text, np.arange(len(texts) + 1))
    for round_ in range(ROUNDS):
        if round_ < FIRST:
            pick = np.concatenate([r.permutation(np.arange(a, b))[:PICK] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        else:
            z = logits(m, x)
            own = np.flatnonzero(np.diff(bounds))
            pick = np.array([bounds[i] + int(z[bounds[i] : bounds[i + 1]].argmax()) for i in own])
        size = max(1, len(pick) // BATCH)
        for at in (b for _ in range(-(-STEPS // size)) for b in np.array_split(r.permutation(pick), size)):
            ids, mask = x.windows(at)
            used, back = np.unique(ids, return_inverse=True)
            part = _Part(x, used)
            g = gradients(m, part, _vectors(m, part), back.reshape(ids.shape), mask, y[x.text[at]])
            step += 1
            for k, v in m.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] * g[k] - second[k])
                v -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return m


class _Part:
    """The distinct words of an Inputs that a batch has."""

    def __init__(self, x: Inputs, used: np.ndarray):
        self.bucket, self.gram_n = x.bucket[used], x.gram_n[used]
        self.gram = x.gram[spread(x.gram_at[used], self.gram_n)]
        self.gram_at = np.cumsum(self.gram_n) - self.gram_n


def logits(m: dict, x: Inputs, at_once: int = 1024) -> np.ndarray:
    """The logit of every window."""
    vectors = _vectors(m, x)
    out = [forward(m, vectors, *x.windows(np.arange(lo, min(lo + at_once, len(x.text))))) for lo in range(0, len(x.text), at_once)]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def score_texts(m: dict, column: pa.Array) -> np.ndarray:
    """The greatest score of each text's windows; a text without words has the score of no evidence at all."""
    x = Inputs(column)
    z = np.full(len(column), min(float(m["b"][0]), -2.0))
    if len(x.text):
        own, at = np.unique(x.text, return_index=True)
        z[own] = np.maximum.reduceat(logits(m, x), at)
    return _sigmoid(z.astype(np.float64))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 0


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    rows, shift = labelled_sample(docs, labels, "toxic", held_out(F.col("doc_id")), SAMPLE)
    model = train([r.text for r in rows], np.array([r.y for r in rows], np.float32))
    model["b"] += np.float32(shift)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, held_out (its labels are never learnt from), score (0 to 1), predicted (1 if score >= 0.5).

    docs has doc_id and text, labels doc_id and toxic. Only the text is an input of a score. Null and empty texts and those without
    letters get the same low score. Null ids are scored and count as not held out. Repeated rows get equal scores. With no labelled
    rows of both kinds every score is a constant. Other columns are not read; an empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in slices(batches, "text"):
            yield pa.record_batch([part.column("doc_id"), pa.array(score_texts(model.value, column))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below `least`, with all their columns, whatever their names. Edge cases as in toxicity_scores."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in slices(batches, "text"):
            yield part.filter(pa.array(score_texts(model.value, column) < least))

    return docs.mapInArrow(run, docs.schema)
