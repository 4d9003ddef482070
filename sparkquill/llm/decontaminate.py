"""Benchmark decontamination by template windows.

Canonical form. A text's words are lower-cased; numbers, units after numbers and names (capitalised words) become typed
placeholders, so a question with other numbers or names has the same template. A capitalised word that opens a sentence may be a name
or not, so windows with such words are hashed in every reading, in items and in documents. Every window of WINDOW words of the benchmark is
hashed; windows of documents meet them by a hash join whose small side, the benchmark, goes to all executors in blocks of about BLOCK
windows (of more than one block, a first pass with a filter of all windows finds the rows that the blocks have to go over). An item counts as leaked where a document has enough of its windows in one
stretch, and the words behind the placeholders fit: one value of the item stands for one value of the document. For that the windows
are aligned first, as a template that repeats in an item also meets its other places: a chain of windows in the item's order.

Items without windows (fewer than WINDOW words, or too few plain ones in every window) leak where a document has all their words, one
after the other, as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkquill.llm.batches import U64, Words, drop_stored, mix, shingle_hashes, slices, spread, stored, text_column

WINDOW = 5
#: Words of a window that aren't placeholders, at least; share of an item's windows; share of slots that fit.
LITERAL, COVERAGE, FITTING = 3, 0.5, 0.8
#: How far apart (in words, plus a tenth of the item) windows of one stretch may be shifted.
SHIFT = 8
#: In the alignment of hits: what a change of shift costs, and what equal words behind the placeholders add (a hit counts 1).
CHANGE, SAME = 0.5, 0.25
BLOCK = 2_000_000
#: The filter of all blocks' windows has two to the power of this many bits at most (it only saves work).
FILTER_BITS = 27
#: Words of an item without windows that are hashed; the others are compared.
OPENING = 8
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml l gal ms s sec secs seconds second min mins minutes minute h hr hrs hours hour day days week weeks month months year years percent usd eur dollars dollar euros euro cents cent k c f w kw v a hz khz mhz ghz b kb mb gb tb mph kmh".split()
NUMBER, NAME, UNIT = (mix(np.array([x], U64))[0] for x in (101, 102, 103))

WORDS = np.arange(WINDOW)

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
#: Whether each code point is a capital letter (there are none further up).
_UPPER = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x20000)])
_STOP[[10, 13, 33, 46, 58, 63]] = True


def _hash_word(word: str) -> int:
    return int(Words(text_column(pa.array([word])), _BETWEEN).hashes()[0])


_UNITS = np.sort(np.array([_hash_word(u) for u in UNITS], U64))


def _capitals(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the characters that start at these bytes are capital letters, and how many bytes each has."""
    lead = buf[at]
    code, size = lead.astype(np.int64), np.ones(len(at), np.int64)
    for n, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        code[k], size[k] = lead[k] - low, n
        for j in range(1, n):
            code[k] = code[k] << 6 | (buf[np.minimum(at[k] + j, len(buf) - 1)] & 63)
    return _UPPER[np.minimum(code, len(_UPPER) - 1)], size


class Templates:
    """Template hashes of the words of many texts, and of their windows.

    plain: hash of each word; slot: whether it became a placeholder; maybe: whether it opens a sentence and may be a name, which is a
    slot too; first: each text's first word. window, at: hash and first word of each reading of a window that has enough plain words;
    base: the window's hash with plain openers; named: whether the window has enough plain words even if all its openers are names.
    """

    def __init__(self, column: pa.Array):
        w = Words(column, _BETWEEN)
        self.first = w.first
        self.plain = w.hashes()
        n = len(w)
        if not n:
            self.slot, self.maybe, self.named = np.zeros((3, 0), bool)
            self.window, self.base, self.at = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
            return
        total = np.zeros(len(w.buf) + 1, np.int32)

        def within(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            np.cumsum(mask[w.buf], out=total[1:], dtype=np.int32)
            return total[b] - total[a]

        number = within(_DIGIT, w.start, w.end) > 0
        opens = np.zeros(n, bool)
        opens[w.first[:-1][np.diff(w.first) > 0]] = True
        opens[1:] |= within(_STOP, w.end[:-1], w.start[1:]) > 0
        capital, size = _capitals(w.buf, w.start)
        capital &= ~number
        some = np.flatnonzero(capital)
        second = w.start[some] + size[some]
        capital[some[_capitals(w.buf, np.minimum(second, w.end[some] - 1))[0] | (second >= w.end[some])]] = False
        name, self.maybe = capital & ~opens, capital & opens
        after = np.flatnonzero(number[:-1] & ~opens[1:]) + 1
        unit = after[np.isin(self.plain[after], _UNITS)]
        template = self.plain.copy()
        template[number], template[name], template[unit] = NUMBER, NAME, UNIT
        self.slot = number | name
        self.slot[unit] = True
        base = shingle_hashes(template, WINDOW)
        at = np.arange(len(base))
        within = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])[np.stack([at, at + WINDOW])], axis=0)[0]
        ends = np.repeat(w.first[1:], np.diff(w.first))
        literal = within(~self.slot)
        at = at[(at + WINDOW <= ends[: len(base)]) & (literal >= LITERAL)]
        openers = np.zeros(len(base), np.uint8)
        for j in range(WINDOW):
            openers |= self.maybe[j : j + len(base)].astype(np.uint8) << j
        some = at[openers[at] > 0]
        window, place = [base[at]], [at]
        for mask in range(1, 1 << WINDOW):
            k = some[(openers[some] & mask == mask) & (literal[some] - mask.bit_count() >= LITERAL)]
            if len(k):
                words = template[k[:, None] + WORDS]
                words[:, (mask >> WORDS & 1) > 0] = NAME
                window.append(shingle_hashes(words.ravel(), WINDOW)[::WINDOW])
                place.append(k)
        self.window, self.at = np.concatenate(window), np.concatenate(place)
        self.base = base[self.at]
        bits = np.array([x.bit_count() for x in range(1 << WINDOW)])
        self.named = literal[self.at] - bits[openers[self.at]] >= LITERAL
        self.slot |= self.maybe


def chain(a: np.ndarray, b: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The hits (places a of a text, b of an item) of the chain that is worth most, in order: both places rise from hit to hit."""
    order = np.argsort(a, kind="stable")
    shift = a - b - int((a - b).min())
    total, before = np.zeros(len(a)), np.full(len(a), -1)
    # the best chain that ends at item place j - 1, and the last one on each shift; a first hit costs nothing
    top, who = np.full(int(b.max()) + 2, -np.inf), np.full(int(b.max()) + 2, -1)
    top[0] = CHANGE
    on, on_who = np.full(int(shift.max()) + 1, -np.inf), np.full(int(shift.max()) + 1, -1)
    places = np.arange(len(top))
    cuts = [*np.flatnonzero(np.diff(a[order], prepend=-1)).tolist(), len(order)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[lo:hi]
        j, s = b[k], shift[k]
        most = np.maximum.accumulate(top)
        best = who[np.maximum.accumulate(np.where(top == most, places, 0))[j]]
        stays = on[s] >= most[j] - CHANGE
        total[k] = worth[k] + np.where(stays, on[s], most[j] - CHANGE)
        before[k] = np.where(stays, on_who[s], best)
        on[s], on_who[s] = total[k], k
        more = total[k] > top[j + 1]
        top[j[more] + 1], who[j[more] + 1] = total[k[more]], k[more]
    out = [int(total.argmax())]
    while before[out[-1]] >= 0:
        out.append(int(before[out[-1]]))
    return np.array(out[::-1])


class Benchmark:
    """Windows of some items, ready to be looked up."""

    BITS = 20

    def __init__(self, ids: list[int], texts: list[str | None]):
        t = Templates(text_column(pa.array(texts, pa.string())))
        item = np.searchsorted(t.first, t.at, side="right") - 1
        order = np.argsort(t.window, kind="stable")
        self.window, self.item, self.place = t.window[order], item[order], (t.at - t.first[item])[order]
        self.base, self.named = t.base[order], t.named[order]
        self.ids, self.first, self.plain, self.slot, self.opener = ids, t.first, t.plain, t.slot, t.maybe
        # each item's windows, by item and hash
        self.by_item = np.lexsort((self.window, self.item))
        self.item_at = np.searchsorted(self.item[self.by_item], np.arange(len(ids) + 1))

        def count(some: np.ndarray) -> np.ndarray:
            pairs = np.unique(np.stack([self.item[some].astype(U64), self.base[some]], 1), axis=0)
            return np.bincount(pairs[:, 0].astype(np.int64), minlength=len(ids))

        self.windows = count(np.ones(len(item), bool))
        # with names for openers fewer windows have enough plain words; they stand for the item if they are COVERAGE of all
        self.renamed = count(self.named)
        self.renamed[self.renamed < COVERAGE * self.windows] = 0
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.window & U64((1 << self.BITS) - 1)).astype(np.int64)] = True
        # items without windows, by the number of words that are hashed
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in np.flatnonzero((self.windows == 0) & (np.diff(self.first) > 0)).tolist():
            n = min(OPENING, int(self.first[i + 1] - self.first[i]))
            self.short[n][int(shingle_hashes(self.plain[self.first[i] : self.first[i] + n], n)[0])].append(i)
        self.short = {n: dict(v) for n, v in self.short.items()}

    def candidates(self, t: Templates) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, item, windows of the text, windows of the benchmark) of each pair with enough different windows in common: all hits of
        the two, one pair at a time, so that a passage which many items share takes no room for all of them at once."""
        near = np.flatnonzero(self.maybe[(t.window & U64((1 << self.BITS) - 1)).astype(np.int64)])
        near = near[np.isin(t.window[near], self.window)]
        text = np.searchsorted(t.first, t.at[near], side="right") - 1
        order = np.lexsort((t.window[near], text))
        near, text = near[order], text[order]
        cut = [*np.searchsorted(text, np.unique(text)).tolist(), len(text)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = t.window[near[lo:hi]]
            distinct = own[np.concatenate([[True], own[1:] != own[:-1]])]
            a, b = (np.searchsorted(self.window, distinct, side=side) for side in ("left", "right"))
            some = np.bincount(self.item[spread(a, b - a)], minlength=len(self.ids))
            for i in np.flatnonzero((some > 0) & (some >= COVERAGE * np.where(self.renamed > 0, self.renamed, self.windows))).tolist():
                theirs = self.by_item[self.item_at[i] : self.item_at[i + 1]]
                a, b = (np.searchsorted(own, self.window[theirs], side=side) for side in ("left", "right"))
                yield int(text[lo]), i, near[lo:hi][spread(a, b - a)], np.repeat(theirs, b - a)

    def verbatim(self, t: Templates) -> list[tuple[int, int, float, int, bool]]:
        """The leaks of items without windows."""
        out = []
        ends = np.repeat(t.first[1:], np.diff(t.first))
        for n, items in self.short.items():
            h = shingle_hashes(t.plain, n)
            found = set()
            for k in np.flatnonzero(np.isin(h, np.array(list(items), U64))).tolist():
                for i in items[int(h[k])]:
                    own = self.plain[self.first[i] : self.first[i + 1]]
                    if k + len(own) <= ends[k] and (t.plain[k : k + len(own)] == own).all():
                        found.add((int(np.searchsorted(t.first, k, side="right")) - 1, i))
            out += [(d, i, 1.0, 0, False) for d, i in sorted(found)]
        return out

    def leaks(self, column: pa.Array) -> list[tuple[int, int, float, int, bool]]:
        """(text, item, share of the item's windows, slots compared, whether a placeholder's value differs) of each leaked item."""
        t = Templates(column)
        out = self.verbatim(t) if self.short else []
        for d, i, ours, theirs in self.candidates(t):
            a, b = t.at[ours], self.place[theirs]
            _, one = np.unique(a * (len(self.plain) + 1) + b, return_index=True)  # two readings of the same windows are one hit
            same = t.base[ours[one]] == self.base[theirs[one]]
            a, b, theirs = a[one], b[one], theirs[one]
            # any reading; if its slots don't fit, plain openers
            found = self._leak(t, i, a, b, theirs, True)
            if not found and not same.all():
                found = self._leak(t, i, a[same], b[same], theirs[same], False)
            if found:
                out.append((d, i, *found))
        return out

    def _leak(self, t: Templates, i: int, a: np.ndarray, b: np.ndarray, theirs: np.ndarray, named: bool) -> tuple[float, int, bool] | None:
        """(share, slots compared, whether a value differs) of the fullest stretch whose slots fit; named: openers may be names."""
        same = (t.plain[a[:, None] + WORDS] == self.plain[self.first[i] + b[:, None] + WORDS]).all(1)
        for share, _, c in self._stretches(i, a, b, theirs, same, named):
            c = c[chain(a[c], b[c], 1 + SAME * same[c])]
            fits, slots, differs = self._fits(t, a[c], self.first[i] + b[c], named)
            if fits:
                return share, slots, differs
        return None

    def _stretches(self, i: int, a: np.ndarray, b: np.ndarray, theirs: np.ndarray, same: np.ndarray, named: bool) -> list[tuple[float, int, np.ndarray]]:
        """(share of the item's windows, equal windows, hits) of each stretch with enough of them, the fullest first. A hit is in as many
        stretches as a stretch has shifts at most, so the work follows the hits however often a template repeats."""
        order = np.argsort(a - b, kind="stable")
        shift = (a - b)[order]
        to = np.searchsorted(shift, shift + SHIFT + int(self.first[i + 1] - self.first[i]) // 10, side="right")
        whole = np.flatnonzero(np.diff(to, prepend=0) > 0)  # not within the stretch before
        renamed = int(self.renamed[i]) if named else 0
        out = []
        for start in whole[to[whole] - whole >= COVERAGE * (renamed or self.windows[i])].tolist():
            c = order[start : to[start]]
            share = len(np.unique(self.base[theirs[c]])) / self.windows[i]
            if renamed:
                share = max(share, len(np.unique(self.base[theirs[c[self.named[theirs[c]]]]])) / renamed)
            if share >= COVERAGE:
                out.append((share, int(same[c].sum()), c))
        return sorted(out, key=lambda x: x[:2], reverse=True)

    def _fits(self, t: Templates, a: np.ndarray, b: np.ndarray, named: bool) -> tuple[bool, int, bool]:
        """Slot consistency over the aligned windows, a in the text and b in the item: each word of the text meets one of the item.
        An opener that is the same in both is compared only where it stands for a name elsewhere."""
        x, at = np.unique((a[:, None] + WORDS).ravel(), return_index=True)
        pairs = np.stack([x, (b[:, None] + WORDS).ravel()[at]], 1)
        pairs = pairs[t.slot[pairs[:, 0]] & self.slot[pairs[:, 1]]]
        opener = t.maybe[pairs[:, 0]] & self.opener[pairs[:, 1]] & (t.plain[pairs[:, 0]] == self.plain[pairs[:, 1]])
        names = self.plain[pairs[~opener, 1]] if named else np.zeros(0, U64)
        pairs = pairs[~opener | np.isin(self.plain[pairs[:, 1]], names)]
        if not len(pairs):
            return True, 0, False
        values: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for x, y in zip(t.plain[pairs[:, 0]].tolist(), self.plain[pairs[:, 1]].tolist(), strict=True):
            values[y][x] += 1
        agree = sum(max(v.values()) for v in values.values())
        return agree >= FITTING * len(pairs), len(pairs), any(x != y for y, v in values.items() for x in v)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and text <> ''")


def _blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in blocks of about BLOCK windows: items are dealt by their ids' hash, and one block at a time is at the driver."""
    rows = _items(benchmark)
    many = _many(rows)
    for k in range(many):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k).orderBy("item_id", "text").collect()
        if got:
            yield Benchmark([r.item_id for r in got], [r.text for r in got])


def _many(rows: DataFrame) -> int:
    return max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // (4 * BLOCK)))


def _filter_bits(rows: DataFrame, many: int) -> tuple[np.ndarray, list[int]]:
    """A bit for the low bits of each hash of a window, or of the opening of an item without windows, in the whole benchmark: eight bits
    a window or more, up to FILTER_BITS. Made by tasks, put together at the driver."""
    bits = min(FILTER_BITS, max(20, (8 * BLOCK * many).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in slices(batches, "text"):
            b = Benchmark(list(range(len(column))), column.to_pylist())
            h = np.concatenate([b.window, *[np.array(list(v), U64) for v in b.short.values()]])
            low = np.unique(h & U64((1 << bits) - 1)).astype(np.int64)
            sizes = sorted(b.short)
            yield pa.record_batch([pa.array(low >> 6), pa.array(low & 63), pa.nulls(len(low), pa.int64())], names=["word", "bit", "size"])
            yield pa.record_batch([pa.nulls(len(sizes), pa.int64()), pa.nulls(len(sizes), pa.int64()), pa.array(sizes, pa.int64())], names=["word", "bit", "size"])

    found = stored(rows.select("text").mapInArrow(run, "word long, bit long, size long"))
    words = np.zeros(1 << (bits - 6), U64)
    got = found.where("word is not null").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toPandas()  # 2**(FILTER_BITS - 6) rows at most
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(U64)
    sizes = [r["size"] for r in found.where("size is not null").select("size").distinct().collect()]  # up to OPENING
    drop_stored(found)
    return words, sizes


def _met(column: pa.Array, words: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Whether each text may have a hash of the benchmark."""
    t = Templates(column)
    low = U64(64 * len(words) - 1)
    inside = lambda h: (words[((h & low) >> U64(6)).astype(np.int64)] >> (h & U64(63)) & U64(1)) > 0
    out = np.zeros(len(column), bool)
    out[np.searchsorted(t.first, t.at[inside(t.window)], side="right") - 1] = True
    for n in sizes:
        k = np.flatnonzero(inside(shingle_hashes(t.plain, n)))
        out[np.searchsorted(t.first, k, side="right") - 1] = True
    return out


def _candidates(docs: DataFrame, benchmark: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may hold items, the others). A benchmark of one block takes all rows at once; beyond that one pass over the texts with a
    filter of all blocks' hashes leaves out the rows that meet none, so the blocks go over the few others only."""
    rows = _items(benchmark)
    many = _many(rows)
    if many == 1:
        return docs, None
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(rows, many))

    def keep(met: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, column in slices(batches, text_col):
                yield part.filter(pa.array(_met(column, *shared.value) == met))

        return run

    return stored(docs.mapInArrow(keep(True), docs.schema)), docs.mapInArrow(keep(False), docs.schema)


def leaked_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that leaked into it.

    Returns doc_id, item_id, coverage (share of the item's windows found in one stretch of the document), n_slots (placeholders
    compared) and reworded (a placeholder stands for another value than in the item). Items of fewer than WINDOW words, or without
    enough plain words, leak where all their words are found in a row (coverage 1, no slots); items without words leak nowhere; null and
    empty texts hold nothing. Repeated rows of either table give repeated rows. Null ids stay. Other columns are not read; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, n_slots long, reworded boolean"
    docs, _ = _candidates(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text")
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, column in slices(batches, "text"):
                if found := shared.value.leaks(column):
                    d, i, share, slots, differs = zip(*found, strict=True)
                    yield pa.record_batch([part.column("doc_id").take(pa.array(d)), pa.array([shared.value.ids[x] for x in i], pa.int64()), pa.array(share, pa.float64()), pa.array(slots, pa.int64()), pa.array(differs, pa.bool_())], names=["doc_id", "item_id", "coverage", "n_slots", "reworded"])

        one = docs.mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs into which no benchmark item leaked, with all their columns, whatever their names. Null, empty and repeated texts
    are judged as in leaked_items; an empty benchmark takes nothing away."""
    schema = docs.schema
    docs, others = _candidates(docs, benchmark, text_col)
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, column in slices(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in shared.value.leaks(column)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs if others is None else docs.union(others)
