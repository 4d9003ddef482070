"""Alignment of two tokenizers over the same bytes: common cuts, links between overlapping tokens, and their counts in the corpus.

A text is cut into units where a character that isn't white space meets a space. Neither a byte-level BPE nor a piece vocabulary without
pieces across words has a token over such a place, so a text's tokens are those of its units, and each place is a common cut. So a batch's
distinct units are tokenized and aligned together, in a few array operations: token ends by cumulative sums of byte lengths, common cuts
as the ends that both sides have, group labels by binary search among them, links by repeating each token over the range of those that it
overlaps.

Counts of id pairs are summed for each batch first, then in two shuffles: by pair and salt, then by pair. What comes back to a batch is
the count of each of its distinct pairs, once; texts refer to units, units to pairs. Batches have a bounded number of bytes (but for one
longer text), so neither a task nor a group grows with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from sparkquill.llm.batches import buffers, range_hashes, slices, spread, stored

#: The tokenizer files unless paths are given.
DEFAULT_A = "/opt/tokenizers/byte_bpe_50k.json"
DEFAULT_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose units and pairs are counted together.
BATCH_BYTES = 8 << 20
#: Salts of a pair in the first of the two shuffles.
SALTS = 16
#: Units that are tokenized at once, and their bytes.
AT_ONCE = 5_000
ENCODE_BYTES = 256 << 10
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the rest, in order, are
    U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id, end to end, and its decimal digits."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.raw = np.frombuffer(b"".join(entries), np.uint8)
        self.bytes = np.array([len(x) for x in entries], np.int64)
        self.at = np.cumsum(self.bytes) - self.bytes
        names = [str(i).encode() for i in range(len(entries))]
        self.digits = np.array([len(x) for x in names], np.int64)
        self.names = np.frombuffer(b"".join(x.ljust(8, b" ") for x in names), np.uint8).reshape(-1, 8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[spread(self.at[ids], self.bytes[ids])]


class Pair:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet = byte_alphabet()
        names = {i: n for n, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.va = Vocabulary([self._entry(names.get(i, ""), alphabet) for i in range(max(names) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.vb = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        shape = json.loads(a)
        before = shape.get("pre_tokenizer") or {}
        plain = not shape.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.by_units = plain and not any(MARK in p.lstrip(MARK) for p in pieces)

    @staticmethod
    def _entry(name: str, alphabet: dict[str, int]) -> bytes:
        return bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()


def unit_starts(buf: np.ndarray, off: np.ndarray, by_units: bool) -> np.ndarray:
    """Where units begin in texts that each begin with a space: at texts, and at spaces after a character that isn't white space of any kind,
    but for a text's last character."""
    begins = np.zeros(len(buf) + 1, bool)
    if by_units and len(buf) > 3:
        before = np.concatenate([np.zeros(3, np.uint8), buf])
        one, two, three = before[2:-1], before[1:-2], before[:-3]
        white = (one <= 0x20) | (one == 0x7F) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        white |= ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))
        begins[:-1] = (buf == 0x20) & ~white
        begins[off[1:] - 1] = False  # a unit isn't one space alone, which the piece model would take for an empty text
    begins[off[:-1]] = True
    return np.flatnonzero(begins[:-1])


class Units:
    """Distinct units, tokenized and aligned. All token arrays go over the units one after the other."""

    def __init__(self, pair: Pair, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        data, total = buf.tobytes(), len(start)
        ids_a, ids_b, n_a, n_b = [], [], np.zeros(total, np.int64), np.zeros(total, np.int64)
        size = np.cumsum(end - start)
        lo = 0
        while lo < total:
            hi = max(lo + 1, min(lo + AT_ONCE, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + ENCODE_BYTES, side="right"))))
            names = [data[s:e].decode() for s, e in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
            own = [x.ids for x in pair.a.encode_batch_fast(names, add_special_tokens=False)]
            n_a[lo:hi] = [len(x) for x in own]
            ids_a.append(np.array([i for x in own for i in x], np.int32))
            own = pair.b.encode([x[1:] for x in names], num_threads=1)  # the file puts the space before it again
            n_b[lo:hi] = [len(x) for x in own]
            ids_b.append(np.array([i for x in own for i in x], np.int32))
            lo = hi
        self.a = np.concatenate(ids_a) if ids_a else np.zeros(0, np.int32)
        self.b = np.concatenate(ids_b) if ids_b else np.zeros(0, np.int32)
        own = np.arange(total)
        self.ok = _faithful(pair.va, self.a, n_a, buf, start, end) & _faithful(pair.vb, self.b, n_b, buf, start, end)
        self.a, self.b = self.a[np.repeat(self.ok, n_a)], self.b[np.repeat(self.ok, n_b)]
        self.n_a, self.n_b = np.where(self.ok, n_a, 0), np.where(self.ok, n_b, 0)
        self._align(pair, own)

    def _align(self, pair: Pair, own: np.ndarray) -> None:
        end_a, end_b = np.cumsum(pair.va.bytes[self.a]), np.cumsum(pair.vb.bytes[self.b])  # one axis for all units: both sides have the same bytes
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        unit_a, unit_b = np.repeat(own, self.n_a), np.repeat(own, self.n_b)
        of_group = np.zeros(len(cuts), np.int64)
        of_group[group_a] = unit_a
        self.n_groups = np.bincount(of_group, minlength=len(own))
        # each A token with the B tokens from the one that ends after its start to the one that reaches its end
        low = np.searchsorted(end_b, end_a - pair.va.bytes[self.a], side="right")
        count = np.searchsorted(end_b, end_a, side="left") - low + 1
        self.links = np.repeat(self.a, count).astype(np.int64) * pair.vb.size + self.b[spread(low, count)]
        self.n_links = np.bincount(np.repeat(unit_a, count), minlength=len(own))
        self._write(pair, group_a, group_b)

    def _write(self, pair: Pair, group_a: np.ndarray, group_b: np.ndarray) -> None:
        """The units' groups as bytes, `a1,a2|b1;a3|b2,b3`."""
        side = np.concatenate([np.zeros(len(self.a), np.int8), np.ones(len(self.b), np.int8)])
        group = np.concatenate([group_a, group_b])
        order = np.lexsort((side, group))  # stable: tokens of one side stay in order
        names = np.concatenate([pair.va.names[self.a], pair.vb.names[self.b]])[order]
        digits = np.concatenate([pair.va.digits[self.a], pair.vb.digits[self.b]])[order]
        side, group = side[order], group[order]
        mark = np.full(len(order), ord(","), np.uint8)
        if len(order):
            last = np.append((side[1:] != side[:-1]) | (group[1:] != group[:-1]), True)
            mark[last & (side == 0)] = ord("|")
            mark[last & (side == 1)] = ord(";")
        rows = np.arange(len(order))
        cells = np.concatenate([names, np.zeros((len(order), 1), np.uint8)], axis=1)
        cells[rows, digits] = mark
        raw = cells[np.arange(9) <= digits[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(digits + 1)])
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        cuts = upto[tokens].tolist()
        self.groups = [raw[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _faithful(vocabulary: Vocabulary, ids: np.ndarray, count: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each unit's tokens are its bytes."""
    of = np.repeat(np.arange(len(count)), count)
    ok = np.bincount(of, vocabulary.bytes[ids], minlength=len(count)).astype(np.int64) == end - start
    ok &= np.bincount(of, vocabulary.bytes[ids] == 0, minlength=len(count)) == 0
    n = (end - start)[ok]
    differs = vocabulary.text(ids[ok[of]]) != buf[spread(start[ok], n)]
    if differs.any():
        ok[np.flatnonzero(ok)[np.unique(np.repeat(np.arange(len(n)), n)[differs])]] = False
    return ok


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.Table, pa.Array]]:
    """Rows with about `limit` bytes of text each, and their text columns."""
    parts, texts, size = [], [], 0
    for part, column in slices(batches, text, limit):
        n = len(buffers(column)[0])
        if parts and size + n > limit:
            yield pa.Table.from_batches(parts), pa.concat_arrays(texts)
            parts, texts, size = [], [], 0
        parts.append(part)
        texts.append(column)
        size += n
    if parts:
        yield pa.Table.from_batches(parts), pa.concat_arrays(texts)


#: kind 0: a batch's pairs (ids of A times the size of B, plus ids of B; ascending) with their counts; times and items: how many links each
#: of its units has, and their places among the pairs. kind 1: a text; items and times: its distinct units, as steps from one to the next, and
#: how often it has each.
_ROWS = "batch string, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>, times binary, items binary"
_PAIRS: dict[str, Pair] = {}


def _pair(files: Broadcast) -> Pair:
    """One pair a worker process."""
    key = files.value[0]
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(*files.value[1:])
    return _PAIRS[key]


def _batch(pair: Pair, doc_ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
    """The rows of one batch (see _ROWS)."""
    buf, off = buffers(column)
    some = np.diff(off) > 0
    # each text that isn't empty after a space
    size = np.where(some, np.diff(off) + 1, 0)
    at = np.concatenate([[0], np.cumsum(size)])
    spaced = np.full(at[-1], 0x20, np.uint8)
    spaced[spread(at[:-1][some] + 1, np.diff(off)[some])] = buf
    edges = at[np.append(some, True)]  # of these texts alone
    start = unit_starts(spaced, edges, pair.by_units) if len(spaced) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(spaced)).astype(np.int64)[: len(start)]
    _, pick, unit = np.unique(range_hashes(spaced, start, end), return_index=True, return_inverse=True)
    units = Units(pair, spaced, start[pick], end[pick])
    text = np.repeat(np.flatnonzero(some), np.diff(np.searchsorted(start, edges)))
    bad = np.unique(text[~units.ok[unit]])  # one unit that isn't its bytes leaves the whole text without tokens
    good = ~np.isin(text, bad)
    unit, text = unit[good], text[good]
    total = len(column)
    sums = [np.bincount(text, x[unit], minlength=total).astype(np.int64) for x in (units.n_a, units.n_b, units.n_groups, units.n_links)]
    cuts = np.searchsorted(text, np.arange(total + 1)).tolist()
    listed = unit.tolist()
    shas = [hashlib.sha256(b";".join([units.groups[u] for u in listed[a:b]])).hexdigest() if b > a else "" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    keys, times = np.unique(text * max(1, len(pick)) + unit, return_counts=True)
    whose, which = keys // max(1, len(pick)), keys % max(1, len(pick))
    ends = np.searchsorted(whose, np.arange(total + 1)).tolist()
    often = np.bincount(unit, minlength=len(pick))
    n_links = np.where(often > 0, units.n_links, 0)  # units of texts without tokens link nothing
    pairs, link = np.unique(units.links[np.repeat(often > 0, units.n_links)], return_inverse=True)
    counts = np.bincount(link, np.repeat(often, n_links), minlength=len(pairs)).astype(np.int64)
    steps = [np.diff(which[a:b], prepend=0) for a, b in zip(ends[:-1], ends[1:], strict=True)]  # units ascend within a text
    empty = [None] * total
    columns = [
        [str(uuid.uuid4())] * (total + 1), [0] + [1] * total, pa.concat_arrays([pa.array([None], pa.int64()), doc_ids]), *[np.append(0, x) for x in sums], [None, *shas],
        pa.array([pairs.tolist(), *empty], pa.list_(pa.int64())), pa.array([counts.tolist(), *empty], pa.list_(pa.int64())),
        pa.array([packed(n_links), *[packed(times[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]], pa.binary()),
        pa.array([packed(link), *map(packed, steps)], pa.binary()),
    ]
    types = [pa.string(), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string()]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, types[i]) for i, c in enumerate(columns)], names=[x.split()[0] for x in _ROWS.split(", ")])


def packed(values: np.ndarray) -> bytes:
    """Numbers (of at least 0) in as few bytes each as the greatest needs, after one byte that says how many."""
    width = next(k for k in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * k)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _files(docs: DataFrame, a_path: str, b_path: str) -> Broadcast:
    data = []
    for path in (a_path, b_path):  # the driver's own files, a few megabytes; executors get them by broadcast
        with open(path, "rb") as f:
            data.append(f.read())
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(data[0] + data[1]).hexdigest(), *data))


def _scored(texts: pa.Table, known: pa.Table) -> pa.Table:
    """The texts of one batch with the sums over their links. texts: the rows of _ROWS; known: the batch's pairs with counts and best."""
    kind = texts.column("kind").to_numpy()
    head = texts.slice(int(np.flatnonzero(kind == 0)[0]), 1)
    rows = texts.filter(pa.array(kind == 1))
    order = np.argsort(known.column("pair").to_numpy())
    count, best = (known.column(c).to_numpy().astype(np.int64)[order] for c in ("count", "best"))
    first = np.concatenate([[0], np.cumsum(unpacked(head.column("times")[0].as_py()))])
    link = unpacked(head.column("items")[0].as_py())
    of_unit = [np.diff(np.concatenate([[0], np.cumsum(x[link])])[first]) for x in (best, count)] if len(link) else [np.zeros(max(0, len(first) - 1), np.int64)] * 2
    unit = [np.cumsum(unpacked(x)) for x in rows.column("items").to_pylist()]
    times = [unpacked(x) for x in rows.column("times").to_pylist()]
    sums = [[int((v[u] * k).sum()) for u, k in zip(unit, times, strict=True)] for v in of_unit]
    keep = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return keep.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64())).append_column("groups_sha256", rows.column("groups_sha256"))


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): the stored rows of all batches (see _ROWS) of docs (doc_id, text), and (pair, count, best)."""
    files = _files(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in gathered(batches, "text", BATCH_BYTES):
            yield _batch(_pair(files), rows.column("doc_id").combine_chunks() if rows.num_rows else pa.array([], pa.int64()), column)

    rows = stored(docs.mapInArrow(run, _ROWS))  # batches have random names: from here on every reader sees the written ones
    each = rows.where("kind = 0").select(F.pmod(F.xxhash64("batch"), F.lit(SALTS)).alias("salt"), F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    part = each.groupBy(F.col("x.pairs").alias("pair"), "salt").agg(F.sum("x.counts").alias("count"))
    sums = stored(part.groupBy("pair").agg(F.sum("count").alias("count")))
    size = _pieces(b_path)
    most = sums.groupBy((F.col("pair") % size).alias("b")).agg(F.max("count").alias("most"))  # a row for each B id: no more than the vocabulary
    best = sums.withColumn("b", F.col("pair") % size).join(F.broadcast(most), "b")
    return rows, best.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _pieces(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def pair_counts(docs: DataFrame, a_path: str = DEFAULT_A, b_path: str = DEFAULT_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, count, best): how many links the corpus has between tokens of these ids, and whether no A id has more with this B id.
    Edges as in alignment."""
    _, pairs = _aligned(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), a_path, b_path)
    size = _pieces(b_path)
    return pairs.select(F.floor(F.col("pair") / size).alias("a_id"), (F.col("pair") % size).alias("b_id"), "count", "best")


def alignment(docs: DataFrame, a_path: str = DEFAULT_A, b_path: str = DEFAULT_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each text, after a space, by the tokenizer file A (tokenizers, byte-level) and the model B (sentencepiece), aligned by bytes.

    Returns doc_id, n_a, n_b, n_groups (stretches between places where tokens of both end), n_links (pairs of tokens that overlap), n_best
    (links whose id pair has the greatest count of all with its B id, ties included), count_sum (over links: how many links of the corpus
    have their id pair) and groups_sha256 (of the groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens).

    Null and empty texts, and texts whose A or B tokens' bytes aren't the space and the text (a text with the whitespace marker), have no
    tokens: zeros. Special tokens' strings are plain text. Units are told apart by 64-bit hashes. A row for each row of docs; rows of one id
    stay apart and repeated rows count each time; null ids stay null; other columns are not read; an empty table gives an empty table.
    """
    rows, pairs = _aligned(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), a_path, b_path)
    wanted = rows.where("kind = 0").select(F.col("batch").alias("owner"), F.explode("pairs").alias("pair"))
    known = wanted.join(pairs, "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    lean = rows.drop("pairs", "counts")
    return lean.groupBy("batch").cogroup(known.groupBy("owner")).applyInArrow(_scored, schema)
