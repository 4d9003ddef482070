"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The segmentation of a text is the one with the greatest sum of its pieces' log scores. A unigram file's scores are log probabilities and
taken as they are. A BPE file has merge ranks instead, whose sums mean nothing: there a piece of rank r has the log probability of
Zipf's law, -log(r + ZIPF) less the log of their sum. That is a rule, no training: no vocabulary or score is learnt here. Characters
that no piece covers become byte pieces, or the unknown piece where the model has none.

No piece of such a vocabulary goes over from a character to a whitespace marker, so the best segmentation of a text is that of its
units (a run of markers and the word after it) one after the other. Each batch's distinct units are segmented together, one array
operation for a step of all of them; texts are then put together from their units' ids. A vocabulary with pieces across words has
whole texts as units.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from sparkquill.llm.batches import buffers, range_hashes, slices, spread

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTES = 1, 2, 3, 4, 5, 6
#: How far below the least piece score an unknown character's score lies.
UNKNOWN_PENALTY = 10.0
#: Longer units (in bytes) are segmented one by one, and cached units are kept up to this many.
LONG_UNIT = 128
CACHE = 200_000
#: Offset of ranks in Zipf's law, for BPE files.
ZIPF = 100.0
UNIGRAM, BPE = 1, 2
#: The model file unless a path is given.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + n]
            at += n
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool = True
    squeeze: bool = True
    base: np.ndarray = field(default=None)
    check: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @property
    def unknown_score(self) -> float:
        return float(min(s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL)) - UNKNOWN_PENALTY

    @property
    def byte_ids(self) -> np.ndarray | None:
        """For each byte its piece, if the model has byte pieces."""
        found = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTES}
        return np.array([found[b] for b in range(256)], np.int32) if len(found) == 256 else None

    @property
    def by_words(self) -> bool:
        return not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER))


def parse_model(data: bytes) -> Model:
    """A model from the bytes of a .model file, with its trie. Files whose normaliser maps characters are refused."""
    pieces, scores, kinds, prefix, squeeze, family = [], [], [], True, True, UNIGRAM
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            family = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            own = dict(_fields(value))
            prefix, squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
            if own.get(2):
                raise ValueError("the model's normaliser has a character map, which isn't supported")
    if family not in (UNIGRAM, BPE):
        raise ValueError("the model is neither a unigram nor a BPE vocabulary")
    model = Model(pieces, log_scores(np.array(scores), kinds) if family == BPE else np.array(scores), kinds, prefix, squeeze)
    words = {p.replace(MARK, " ").encode(): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (NORMAL, USER, UNUSED)}
    model.base, model.check, model.value = double_array(words)
    return model


def log_scores(scores: np.ndarray, kinds: list[int]) -> np.ndarray:
    """Log probabilities of the pieces of a BPE file by the order of their scores, the highest first; 0 for pieces of other kinds."""
    own = np.flatnonzero(np.array(kinds) == NORMAL)
    rank = np.empty(len(own))
    rank[np.argsort(-scores[own], kind="stable")] = np.arange(len(own))
    out = np.zeros(len(scores))
    out[own] = -np.log(rank + ZIPF) - np.log((1 / (rank + ZIPF)).sum())
    return out


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie of byte strings as two arrays: from state s byte c leads to base[s] + c if check[base[s] + c] is s. value: the string's
    number, or -1. The root is state 1."""
    root: dict = {}
    for w, i in words.items():
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[-1] = i
    size = 1 << 12
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], check[1] = 0, 0
    low, todo = 2, [(1, root)]
    while todo:
        state, node = todo.pop()
        value[state] = node.get(-1, -1)
        codes = sorted(c for c in node if c >= 0)
        if not codes:
            continue
        while low < size and check[low] != -1:
            low += 1
        at, misses = max(low, codes[0] + 1), 0
        while True:
            b = at - codes[0]
            if b + 256 >= size:
                size *= 2
                base += [0] * (size - len(base))
                check += [-1] * (size - len(check))
                value += [-1] * (size - len(value))
            if check[at] == -1 and all(check[b + c] == -1 for c in codes):
                break
            at, misses = at + 1, misses + 1
        if misses > 200:
            low = max(low, at - 64)
        base[state] = b
        for c in codes:
            check[b + c] = state
        todo += [(b + c, node[c]) for c in codes]
    last = max(i for i, c in enumerate(check) if c != -1) + 257
    return tuple(np.array((x + [y] * 257)[:last], np.int32) for x, y in ((base, 0), (check, -1), (value, -1)))


def _char_bytes(first: np.ndarray) -> np.ndarray:
    return np.select([first < 0x80, first < 0xE0, first < 0xF0], [1, 2, 3], 4)


def _segment_one(m: Model, text: bytes) -> list[int]:
    """Ids of one unit, step by step (for units too long to be stacked)."""
    base, check, value, scores, bytes_ = m.lists
    n, low = len(text), m.unknown_score
    best: list[float | None] = [None] * (n + 1)
    back = [(0, 0)] * (n + 1)
    best[0] = 0.0
    for p in range(n):
        if best[p] is None or text[p] & 0xC0 == 0x80:
            continue
        own = best[p]
        wide = 1 if text[p] < 0x80 else 2 if text[p] < 0xE0 else 3 if text[p] < 0xF0 else 4
        s, single = 1, False
        for q in range(p, n):
            t = base[s] + text[q]
            if check[t] != s:
                break
            s = t
            if value[s] >= 0:
                single |= q + 1 - p == wide
                x = own + scores[value[s]]
                if best[q + 1] is None or x > best[q + 1]:
                    best[q + 1], back[q + 1] = x, (p, value[s])
        if not single and (best[p + wide] is None or own + low > best[p + wide]):
            best[p + wide], back[p + wide] = own + low, (p, -1)
    out: list[int] = []
    at = n
    while at:
        p, i = back[at]
        out += [i] if i >= 0 else [m.unknown] if bytes_ is None else [bytes_[b] for b in reversed(text[p:at])]
        at = p
    return out[::-1]


def segment(m: Model, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many units (byte ranges of buf), one after the other, and how many each has."""
    n = end - start
    count = np.zeros(len(n), np.int64)
    who, ids, place = [], [], []
    for u in np.flatnonzero(n > LONG_UNIT).tolist():
        x = _segment_one(m, buf[start[u] : end[u]].tobytes())
        who.append(np.full(len(x), u))
        ids.append(np.array(x, np.int32))
        place.append(np.arange(len(x)))
    short = np.flatnonzero((n > 0) & (n <= LONG_UNIT))
    short = short[np.argsort(n[short], kind="stable")]
    for lo in range(0, len(short), 20_000):
        u, i, p = _segment_block(m, buf, start[short[lo : lo + 20_000]], n[short[lo : lo + 20_000]])
        who.append(short[lo : lo + 20_000][u])
        ids.append(i)
        place.append(p)
    if not who:
        return np.zeros(0, np.int32), count
    who, ids, place = np.concatenate(who), np.concatenate(ids), np.concatenate(place)
    order = np.lexsort((place, who))
    return ids[order], np.bincount(who, minlength=len(n)).astype(np.int64)


def _segment_block(m: Model, buf: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, id, place in the unit) of units of similar lengths; each array operation is one step of all of them."""
    base, check, value, scores = m.base, m.check, m.value, m.scores
    width = int(n.max())
    best = np.full((len(n), width + 1), -np.inf)
    best[:, 0] = 0
    piece = np.full((len(n), width + 1), -1, np.int32)
    length = np.zeros((len(n), width + 1), np.int32)
    for p in range(width):
        unit = np.flatnonzero(n > p)
        first = buf[start[unit] + p]
        whole = (first & 0xC0) != 0x80
        unit, first = unit[whole], first[whole]
        if not len(unit):
            continue
        wide = _char_bytes(first)
        own = best[unit, p]
        single = np.zeros(len(unit), bool)
        row, state, d = np.arange(len(unit)), np.ones(len(unit), np.int32), 0
        while len(row):
            inside = n[unit[row]] > p + d
            row, state = row[inside], state[inside]
            to = base[state] + buf[start[unit[row]] + (p + d)]
            ok = check[to] == state
            row, state = row[ok], to[ok]
            d += 1
            ends = value[state] >= 0
            if ends.any():
                r, v = row[ends], value[state[ends]]
                single[r] |= wide[r] == d
                x = own[r] + scores[v]
                better = x > best[unit[r], p + d]
                r, v = r[better], v[better]
                best[unit[r], p + d], piece[unit[r], p + d], length[unit[r], p + d] = x[better], v, d
        r = np.flatnonzero(~single)
        if len(r):
            x, to = own[r] + m.unknown_score, p + wide[r]
            better = x > best[unit[r], to]
            r, to = r[better], to[better]
            best[unit[r], to], piece[unit[r], to], length[unit[r], to] = x[better], -1, wide[r]
    units, ids, places = [], [], []
    row, at = np.arange(len(n)), n.copy()
    bytes_ = m.byte_ids
    while len(row):
        i, k = piece[row, at], length[row, at]
        at = at - k
        known = i >= 0
        units.append(row[known])
        ids.append(i[known])
        places.append(at[known])
        if not known.all():
            r, p, k = row[~known], at[~known], k[~known]
            if bytes_ is None:
                units.append(r)
                ids.append(np.full(len(r), m.unknown, np.int32))
                places.append(p)
            else:
                for j in range(int(k.max())):
                    on = k > j
                    units.append(r[on])
                    ids.append(bytes_[buf[start[r[on]] + p[on] + j]])
                    places.append(p[on] + j)
        row, at = row[at > 0], at[at > 0]
    return np.concatenate(units), np.concatenate(ids), np.concatenate(places)


class Encoder:
    """Encodes and decodes columns of texts; keeps the ids of units that it has seen."""

    def __init__(self, model: Model):
        self.m = m = model
        m.lists = (m.base.tolist(), m.check.tolist(), m.value.tolist(), m.scores.tolist(), None if m.byte_ids is None else m.byte_ids.tolist())
        self.by_words = m.by_words
        self.forget()
        raw = [bytes([int(p[3:5], 16)]) if k == BYTES else b"" if k == CONTROL else " \xe2\x81\x87 ".encode("latin-1") if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int32)]
        self.count: list[np.ndarray] = [np.zeros(0, np.int64)]

    def encode(self, column: pa.Array) -> pa.LargeListArray:
        """The ids of each text."""
        if self.m.squeeze:
            column = pc.replace_substring_regex(pc.utf8_trim(column, characters=" "), pattern=" +", replacement=" ")
        column = pc.replace_substring(column, MARK, " ")
        full = pc.not_equal(pc.binary_length(column), 0)
        if self.m.dummy_prefix:
            column = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())), column)
        buf, off = buffers(column)
        n = len(buf)
        if not n:
            return pa.LargeListArray.from_arrays(pa.array(np.zeros(len(off), np.int64)), pa.array([], pa.int32()))
        begins = np.zeros(n, bool)
        if self.by_words:
            space = buf == 32
            begins[1:] = space[1:] & ~space[:-1]
        begins[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        h = range_hashes(buf, start, end)
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        # a unit whose hash another one has first, but not its bytes, stands for itself
        own, first = end - start, at[back]
        other = np.flatnonzero(own != own[first])
        same = np.flatnonzero((own == own[first]) & (first != np.arange(len(own))))
        differs = buf[spread(start[same], own[same])] != buf[spread(start[first[same]], own[same])]
        if differs.any():
            other = np.concatenate([other, same[np.unique(np.repeat(np.arange(len(same)), own[same])[differs])]])
        back[other] = len(at) + np.arange(len(other))
        at = np.concatenate([at, other])
        data = buf.tobytes()
        names = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        if len(self.known) + len(names) > CACHE:
            self.forget()
        known = self.known
        spot = np.array([known.get(x, -1) for x in names], np.int64)
        new = np.flatnonzero(spot < 0)
        if len(new):
            ids, count = segment(self.m, buf, start[at[new]], end[at[new]])
            spot[new] = np.arange(len(self.count[0]), len(self.count[0]) + len(new))
            known.update((names[i], int(spot[i])) for i in new.tolist() if len(names[i]) <= LONG_UNIT)
            self.ids.append(ids)
            self.count.append(count)
        if len(self.ids) > 1:
            self.ids, self.count = [np.concatenate(self.ids)], [np.concatenate(self.count)]
            self.first = np.cumsum(self.count[0]) - self.count[0]
        unit = spot[back]
        count = self.count[0][unit]
        flat = self.ids[0][spread(self.first[unit], count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        return pa.LargeListArray.from_arrays(pa.array(upto[np.searchsorted(start, off)]), pa.array(flat))

    def decode(self, ids: pa.LargeListArray) -> list[bytes]:
        """The UTF-8 bytes of each text: markers become spaces, byte pieces their bytes, and the first space goes if the model adds it."""
        off = ids.offsets.to_numpy()
        flat = ids.values.to_numpy()[off[0] : off[-1]]
        off = off - off[0]
        count = self.raw_len[flat]
        data = self.raw[spread(self.raw_at[flat], count)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(count)])[off].tolist()
        out = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [x[1:] if self.m.dummy_prefix and x[:1] == b" " else x for x in out]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model: Broadcast) -> Encoder:
    """One encoder a worker process and model."""
    key = model.value[0]
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model.value[1])
    return _ENCODERS[key]


def _shared(docs: DataFrame, path: str) -> Broadcast:
    with open(path, "rb") as f:  # the driver's own file; executors get the model by broadcast
        data = f.read()
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), parse_model(data)))


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the piece ids of each text as one more column (null or empty text: an empty list), and with the text that they decode
    to as another if decoded_col names it (bytes that aren't UTF-8 become the replacement character). A column of docs that has one of
    these names is replaced; other columns may have any names. Repeated rows get equal ids; an empty table gives an empty table."""
    model = _shared(docs, model_path)
    own = docs.drop(*[c for c in (ids_col, decoded_col) if c and c in docs.columns])
    more = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + [T.StructField(decoded_col, T.StringType())] * bool(decoded_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for part, column in slices(batches, text_col):
            ids = encoder.encode(column)
            columns = [*part.columns, ids.cast(pa.list_(pa.int32()))]
            if decoded_col:
                columns.append(pa.array([x.decode("utf-8", "replace") for x in encoder.decode(ids)], pa.string()))
            yield pa.record_batch(columns, names=[*part.schema.names, *[f.name for f in more]])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, *more]))


def encode_audit(docs: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: a row per row of docs.

    Returns doc_id, n_pieces, n_bytes (byte pieces among them), ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256
    (of the decoded UTF-8) and round_trip (the decoded text is the text). Null and empty texts have no pieces and round-trip to the
    empty text. The whitespace marker itself decodes to a space, so a text that has it does not round-trip. Repeated rows get equal
    results; other columns are not read; an empty table gives an empty table.
    """
    model = _shared(docs, model_path)
    schema = "doc_id long, n_pieces long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(model)
        is_byte = np.array([k == BYTES for k in own.m.kinds])
        for part, column in slices(batches, "text"):
            ids = own.encode(column)
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            some = np.concatenate([[0], np.cumsum(is_byte[flat])])
            decoded = own.decode(ids)
            buf, at = buffers(column)
            raw, data, cuts, edges = flat.astype("<i4").tobytes(), buf.tobytes(), (4 * off).tolist(), at.tolist()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            same = [x == data[a:b] for x, a, b in zip(decoded, edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(off)), pa.array(some[off[1:]] - some[off[:-1]]), pa.array(sha), pa.array([hashlib.sha256(x).hexdigest() for x in decoded]), pa.array(same)], names=["doc_id", "n_pieces", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
