"""Periodic runs of words, by the divide and conquer of Main and Lorentz.

Words are interned as numbers. A text is halved again and again; a run that crosses the midpoint of a block and lies in it is found from
the Z-functions at that midpoint: how far the words from the midpoint on agree with those from each other place of the block on, and how
far those before the two agree backwards. The two together are the run with that distance as its period, extended over the block's ends as
far as it goes. Blocks of all texts of a slice are one level after the other, each level in a few array operations.

A Z-value below three decides nothing: a run has at least twelve words and two periods, so forward and backward agreement together reach six
and one of them three. Places that agree with the midpoint in three words, on either side, are told by interned runs of three words; only
these get their whole Z-values, exactly: step by step at first, and by interned runs of 2, 4, 8, ... words where they go on, so that
a text of one repeated word costs n log n as well.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkquill.llm.batches import Words, slices, spread

#: Least length of a run in words.
LEAST = 12
#: Words in one direction that are compared one by one before longer interned runs are made.
STEPS = 24
#: Pairs of places that are compared at once.
CHUNK = 1 << 18


def _interned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers (not negative, below 2**31), the same for equal pairs."""
    return np.unique((a.astype(np.int64) << 32) | b, return_inverse=True)[1].astype(np.int32)


def _doubled(w: np.ndarray) -> list[np.ndarray]:
    """Interned runs of 1, 2, 4, ... words from each place on, as far as any two runs of that length are equal. A run that goes over the end
    of w has a number of its own."""
    out = [w]
    while 2 << (len(out) - 1) <= len(w):
        last, k = out[-1], 1 << (len(out) - 1)
        pairs = _interned(last[:-k], last[k:])
        if pairs.max() + 1 == len(pairs):  # all different
            break
        out.append(np.concatenate([pairs, np.arange(len(w), len(w) + k, dtype=np.int32)]))
    return out


def _agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from the places a and b on, in log n steps. A sentinel at the end of levels[0] ends all agreement, and no two
    runs of twice the last level's length are equal."""
    far = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        far += (levels[k][a + far] == levels[k][b + far]).astype(np.int64) << k
    return far


def _steps(w: np.ndarray, a: np.ndarray, b: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from a and b on in direction `by`, STEPS at most, and whether that many do. Sentinels end all agreement."""
    far = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(STEPS):
        live = live[w[a[live] + by * k] == w[b[live] + by * k]]
        far[live] += 1
    more = np.zeros(len(a), bool)
    more[live] = True
    return far, more


def _candidates(w: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): places of which one is the midpoint of a block and which agree in the three words from there on or before. first, size:
    where the texts' words are in w; each text has a sentinel before and after it."""
    three = _interned(_interned(w[:-2], w[1:-1]), w[2:]) if len(w) > 2 else np.zeros(0, np.int32)
    three = np.concatenate([np.arange(3, dtype=np.int32) - 3, three, np.array([-4, -5], np.int32)])  # three[i + 3]: the words from i on
    lo, hi = first, first + size
    lows, highs = [], []
    while True:
        keep = hi - lo >= LEAST
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            break
        mid, n = (lo + hi) // 2, hi - lo
        at = spread(lo, n)
        same = (three[at + 3] == np.repeat(three[mid + 3], n)) | (three[at] == np.repeat(three[mid], n))
        spot = np.flatnonzero(same)
        middle = np.repeat(mid, n)[spot]
        spot = at[spot]
        other = spot != middle
        lows.append(np.minimum(spot, middle)[other].astype(np.int32))
        highs.append(np.maximum(spot, middle)[other].astype(np.int32))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    return (np.concatenate(lows), np.concatenate(highs)) if lows else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _distinct(start: np.ndarray, length: np.ndarray, period: np.ndarray, use: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs among these stretches, each interval once with its smallest period."""
    good = use & (length >= np.maximum(least, 2 * period))
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[first], length[first], period[first]


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of all texts, by text, start and period. words: numbers of the words (of at least 0),
    text after text; first: where each text starts, one entry more than texts. A run is a stretch of at least max(least, 2 * period) words
    with that smallest period which no neighbouring word extends; least is 12 or more."""
    size = np.diff(first)
    none = np.zeros(0, np.int64)
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not found")
    if not len(words) or size.max() < LEAST:
        return none, none, none, none
    _, ids = np.unique(words, return_inverse=True)
    texts = len(size)
    begin = first[:-1] + np.arange(texts) + 1  # a sentinel before each text, and one after the last
    w = np.empty(len(words) + texts + 1, np.int32)
    edge = np.append(begin - 1, len(w) - 1)
    w[edge] = len(words) + np.arange(texts + 1)
    w[spread(begin, size)] = ids
    found: list[tuple[np.ndarray, ...]] = []
    low, high = _candidates(w, begin, size)
    going_on = []
    for at in range(0, len(low), CHUNK):
        a, b = low[at : at + CHUNK], high[at : at + CHUNK]
        forward, on = _steps(w, a, b, 1)
        backward, back = _steps(w, a - 1, b - 1, -1)
        on |= back
        found.append(_distinct(a - backward, forward + backward + b - a, b - a, ~on, least))
        going_on.append(at + np.flatnonzero(on))
    going_on = np.concatenate(going_on) if going_on else none
    if len(going_on):
        low, high = low[going_on], high[going_on]
        owner = np.searchsorted(begin, low, side="right") - 1
        few = np.flatnonzero(np.bincount(owner, minlength=texts))
        n = size[few] + 2
        part = w[spread(begin[few] - 1, n)]  # these texts, each with its sentinels
        ends = np.flatnonzero(part >= len(words))  # one between two of them stands twice: each gets a number of its own
        part[ends] = len(words) + np.arange(len(ends))
        shift = np.zeros(texts, np.int64)
        shift[few] = begin[few] - 1 - (np.cumsum(n) - n)
        ahead, behind, last = _doubled(part), _doubled(np.ascontiguousarray(part[::-1])), len(part) - 1
        for at in range(0, len(low), CHUNK):
            a, b = low[at : at + CHUNK], high[at : at + CHUNK]
            move = shift[owner[at : at + CHUNK]]
            forward = _agreement(ahead, a - move, b - move)
            backward = _agreement(behind, last - b + move + 1, last - a + move + 1)
            found.append(_distinct(a - backward, forward + backward + b - a, b - a, np.ones(len(a), bool), least))
    if not found:
        return none, none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    start, length, period = _distinct(start, length, period, np.ones(len(start), bool), least)
    text = np.searchsorted(begin, start, side="right") - 1
    start = start - begin[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _spliced(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """For each word the index of the word that stands there: in texts of every tenth id, by crc32, a stretch is repeated to the end."""
    out = np.arange(first[-1])
    for i, a0, n in zip(ids, first[:-1].tolist(), np.diff(first).tolist(), strict=True):
        if i is None or not n:
            continue
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[a0 + a : a0 + n] = a0 + a + np.arange(n - a) % p
    return out


class _Texts:
    """Words of a slice of texts, in the order in which they stand, with their runs."""

    def __init__(self, column: pa.Array, order: np.ndarray | None = None, least: int = LEAST, words: Words | None = None):
        self.words = words = words or Words(column)
        self.first = words.first
        self.order = np.arange(len(words)) if order is None else order
        self.text, self.start, self.length, self.period = runs(words.hashes(lower=False)[self.order], self.first, least)
        self.of = np.searchsorted(self.text, np.arange(len(self.first)))  # of[i]: the first run of text i

    def collapsed(self) -> list[bytes]:
        """Each text's words, one space apart, without those after the first period of a run that has them."""
        words, total = self.words, len(self.words)
        covered = np.zeros(total + 1, np.int64)
        base = self.first[self.text] + self.start
        np.add.at(covered, base + self.period, 1)
        np.add.at(covered, base + self.length, -1)
        kept = np.cumsum(covered)[:total] == 0
        at = self.order[kept]
        n = words.end[at] - words.start[at] + 1
        ends = np.concatenate([[0], np.cumsum(n)])
        data = np.append(words.buf, np.uint8(32))[spread(words.start[at], n)]
        data[ends[1:] - 1] = 32
        raw, cuts = data.tobytes(), ends[np.concatenate([[0], np.cumsum(kept)])[self.first]].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text its run of greatest length (ties: the smallest start, then period), and whether it has one."""
        order = np.lexsort((self.period, self.start, -self.length, self.text))
        some = np.diff(self.of) > 0
        out = np.zeros(len(some), np.int64)
        out[some] = order[self.of[:-1][some]]
        return out, some


def periodic_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str | None = None, least: int = LEAST) -> DataFrame:
    """docs with each text's runs as an array of (start, length, period) by start and period, and with the text whose runs are cut down
    to their first period as another column if collapsed_col names it.

    Words are told apart by 64-bit hashes. Null, empty and short texts have no runs; a collapsed text has single spaces between its words.
    Columns of docs with these names are replaced, others may have any names. Repeated rows get equal results; an empty table gives an
    empty table.
    """
    own = docs.drop(*[c for c in (runs_col, collapsed_col) if c and c in docs.columns])
    one = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    more = [T.StructField(runs_col, T.ArrayType(one))] + [T.StructField(collapsed_col, T.StringType())] * bool(collapsed_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in slices(batches, text_col):
            x = _Texts(column, least=least)
            rows = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in (x.start, x.length, x.period)], ["start", "length", "period"])
            columns = [*part.columns, pa.ListArray.from_arrays(pa.array(x.of, pa.int32()), rows)]
            if collapsed_col:
                columns.append(pa.array([t.decode() for t in x.collapsed()], pa.string()))
            yield pa.record_batch(columns, names=[*part.schema.names, *[f.name for f in more]])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, *more]))


def run_audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every text, those of every tenth id (by crc32 of its decimal digits) with a stretch repeated up to their end first.

    Returns doc_id, n_runs; start, length, period and exponent_milli of the run of greatest length (ties: smallest start, then period; four
    nulls without runs); runs_sha256 (a line ``start,length,period`` for each run) and collapsed_sha256 (words outside of repetitions, one
    space apart). Null texts have no words; rows of null id are taken as they are; repeated rows get equal results; other columns are not
    read; an empty table gives an empty table.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in slices(batches, "text"):
            words = Words(column)
            x = _Texts(column, _spliced(part.column("doc_id").to_pylist(), words.first), words=words)
            lines = [f"{a},{b},{c}\n" for a, b, c in zip(x.start.tolist(), x.length.tolist(), x.period.tolist(), strict=True)]
            of = x.of.tolist()
            listed = [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(of[:-1], of[1:], strict=True)]
            best, some = x.best()
            top = [pa.array((v[best] if len(v) else np.zeros(len(best), np.int64)).astype(np.int64), mask=~some) for v in (x.start, x.length, x.period, 1000 * x.length // np.maximum(x.period, 1))]
            collapsed = [hashlib.sha256(t).hexdigest() for t in x.collapsed()]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(x.of).astype(np.int64)), *top, pa.array(listed), pa.array(collapsed)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
