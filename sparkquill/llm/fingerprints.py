"""Document fingerprints by a randomised edit embedding (CGK), with banded candidate search and verification.

Embedding. A text is walked character by character: at step t the walk stands on a character, and a shared random bit R[t, character]
says whether it goes on to the next one. Two texts at a small edit distance fall into step again soon after each edit, so their walks
agree at most steps: edit distance becomes Hamming distance. A walk covers a stretch of WINDOW characters in at most 3 * WINDOW steps,
and a text's embedding is that of its stretches one after the other; all stretches of many texts are walked at once. A step's value is a
hash of the GRAM characters from the walk's place on, so that unlike texts seldom agree at a step by chance (a single character of
prose often does); an edit then touches the steps of GRAM places.

Sampling. A fingerprint has SAMPLES steps of the embedding, eight bits each, chosen by shared random priorities: sample m is the step
with the least priority h_m among all steps that the text has. So texts of different lengths still sample the same steps with the
probability of their lengths' ratio, and no length is out of reach. Steps after a walk's end are marked and count only where the other
text goes on.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkquill.llm.batches import STEP, drop_stored, mix, slices, stored, stream
from sparkquill.llm.components import components

WINDOW = 4096
STEPS = 3 * WINDOW
SAMPLES = 128
GRAM = 4
#: Characters that are walked at once.
CHARS = 1 << 20
#: Keys of a fingerprint; samples of a key, and how many of them aren't end marks at least (following samples are added).
BANDS, ROWS, LIVE = 16, 4, 2
#: Nodes of a key that are compared pair by pair at once; rounds of hubs for keys of more, then nodes of a tile.
GROUP, ROUNDS, TILE = 32, 3, 2048
#: Classes up to which their names are broadcast to the documents.
BROADCAST_CLASSES = 100_000

_WALK = None


def _walk_bits() -> np.ndarray:
    """R[t, folded character]: 0 or 1; folded character 0 is a stretch's end, where the walk stays."""
    global _WALK
    if _WALK is None:
        bits = np.unpackbits(stream(5, STEPS * 4).view(np.uint8)).reshape(STEPS, 256)
        bits[:, 0] = 0
        _WALK = bits.astype(np.int32)
    return _WALK


class _Steps:
    """For each sample the steps that have the least priority among all up to some length: the records of a random sequence, drawn by
    their gaps and values, so that no priority is computed for the other steps."""

    def __init__(self) -> None:
        self.random = [np.random.default_rng(1000 + m) for m in range(SAMPLES)]
        self.at = [[0] for _ in range(SAMPLES)]
        self.value = [float(r.random()) for r in self.random]

    def upto(self, length: int) -> list[np.ndarray]:
        for m, r in enumerate(self.random):
            while self.at[m][-1] < length:
                v = self.value[m]
                self.at[m].append(self.at[m][-1] + int(min(r.geometric(max(v, 1e-15)), 1 << 60)))
                self.value[m] = v * float(r.random())
        return [np.array(x) for x in self.at]

    def chosen(self, lengths: np.ndarray) -> np.ndarray:
        """For each length (at least 1) and sample the chosen step."""
        at = self.upto(int(lengths.max(initial=1)))
        return np.stack([a[np.searchsorted(a, lengths, side="left") - 1] for a in at], 1)


_STEPS = _Steps()


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of SAMPLES bytes for each text; 0 marks a step after a walk's end. Equal texts have equal fingerprints; an empty text
    has zeros only."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    n = np.array([len(c) for c in codes])
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    steps = _STEPS.chosen(3 * n[full])
    stretches = -(-n[full] // WINDOW)
    first = np.concatenate([[0], np.cumsum(stretches)])
    # a buffer with every stretch followed by GRAM end marks
    sizes = np.full(first[-1], WINDOW)
    sizes[first[1:] - 1] = n[full] - (stretches - 1) * WINDOW
    start = np.concatenate([[0], np.cumsum(sizes + GRAM)])
    flat = np.concatenate([codes[i] for i in full])
    place = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * GRAM, sizes)
    buf = np.zeros(start[-1], np.uint8)
    buf[place] = (mix(flat.astype(np.uint64)) >> np.uint64(33)) % np.uint64(255) + np.uint64(1)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # what is asked for: at step t of stretch w the walk's place
    want_stretch = rank[first[:-1, None] + steps // STEPS].ravel()
    want_step = (steps % STEPS).ravel()
    by_step = np.argsort(want_step, kind="stable")
    cuts = np.searchsorted(want_step[by_step], np.arange(STEPS + 1))
    want_stretch = want_stretch[by_step]
    got = np.zeros(len(by_step), np.int64)
    walk, pos, size = _walk_bits(), start[:-1][order].copy(), sizes[order]
    active = np.searchsorted(-size, -(np.arange(STEPS) // 3), side="left")  # stretches with 3 * size > t
    spots = cuts.tolist()
    for t in range(min(STEPS, 3 * int(size[0]))):
        a, b = spots[t], spots[t + 1]
        if a < b:
            got[a:b] = pos[want_stretch[a:b]]
        live = pos[: active[t]]
        live += walk[t].take(buf.take(live))
    gram = np.zeros(len(got), np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(257) + buf[got + k]
    value = (mix(gram) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    value[buf[got] == 0] = 0
    rows = np.empty(len(got), np.uint8)
    rows[by_step] = value
    out[full] = rows.reshape(len(full), SAMPLES)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples among those that at least one of the texts has; 1 for two empty texts."""
    some = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    return np.where(some == 0, 1.0, same / np.maximum(some, 1))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sha(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, guest, doc_id, text) in order -> a row for each text but guests; the next row is the one after it in the bucket."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        if not pairs:
            return None
        changed = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
        f = fingerprints([r[3] for r in rows] + changed)
        own, following, new = f[pairs], f[[i + 1 for i in pairs]], f[len(rows) :]
        columns = [[rows[i][2] for i in pairs], [len(rows[i][3]) for i in pairs], [_sha(c) for c in changed], [x.tobytes() for x in own], [x.tobytes() for x in new], likeness(own, new), likeness(own, following)]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    held: list[tuple] = []
    chars = 0
    for part, column in slices(batches, "text"):
        for row in zip(*(x.to_pylist() for x in (part.column(0), part.column(1), part.column(2), column)), strict=True):
            held.append(row)
            chars += len(row[3])
            if chars > CHARS and len(held) > 1:
                if (out := settle(held)) is not None:
                    yield out
                held, chars = held[-1:], len(row[3])
    if (out := settle(held)) is not None:
        yield out


def _place(x: Column, cuts: list[int]) -> Column:
    """How many of the descending cuts are greater than x, by blocks of about the root of their number."""
    size = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)] or [[]]
    count = lambda a: F.size(F.filter(a, lambda c: c > x))
    whole = count(F.lit([b[-1] for b in blocks if len(b) == size]).cast("array<bigint>"))
    inside = F.element_at(F.lit([*blocks, []]).cast("array<array<bigint>>"), F.least(whole, F.lit(len(blocks))) + 1)
    return whole * size + count(inside)


def _bucket(docs: DataFrame, pieces: int) -> Column:
    """The number of the range that a row (doc_id, text, tie) falls into; ranges follow each other from the greatest id to the least, then null,
    and within an id by tie, the text's hash.

    Bounds are quantiles of the ids. An id that is more than one quantile, and null, is cut at quantiles of its texts' hashes as well, in
    as many ranges as it has quantiles, so that only copies of one row stay together whatever their number.
    """
    shares = [k / pieces for k in range(1, pieces)]
    row = docs.agg(F.percentile_approx("doc_id", shares, 25 * pieces).alias("cuts"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    times = Counter(row.cuts or [])
    cuts = sorted(times, reverse=True)
    wide = {c: k for c, k in times.items() if k > 1}
    wide[None] = math.ceil((row.n - row.known) * pieces / max(row.n, 1))
    inside: dict[int | None, list[int]] = {}
    if len(wide) > 1 or wide[None] > 1:
        some = docs.where(F.col("doc_id").isNull() | F.col("doc_id").isin(*[c for c in wide if c is not None]))
        for r in some.groupBy("doc_id").agg(F.percentile_approx("tie", shares, 25 * pieces).alias("ties")).collect():  # a row for each such id
            inside[r.doc_id] = sorted({r.ties[(k * pieces) // wide[r.doc_id] - 1] for k in range(1, wide[r.doc_id])})
    # range 0 of each id's piece of the order holds the ids before it, the others its own rows
    order = [*cuts, 0, None]  # after the last bound come the ids below it, then null
    ties = [inside.get(c) if k != len(cuts) else None for k, c in enumerate(order)]
    upto = [0]
    for t in ties:
        upto.append(upto[-1] + 1 + (len(t) + 1 if t is not None else 0))
    piece = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(_place(F.col("doc_id"), cuts)).cast("int")
    at = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), piece + 1)
    if not inside:
        return at(upto[:-1], "int")
    own = F.size(F.filter(at([t or [] for t in ties], "array<bigint>"), lambda c: c <= F.col("tie"))) + 1
    split = F.col("doc_id").eqNullSafe(at(order, "bigint")) & at([t is not None for t in ties], "boolean")
    return at(upto[:-1], "int") + F.when(split, own).otherwise(0)


def _spelt(rows: DataFrame) -> DataFrame:
    """Binary columns as lowercase hex."""
    return rows.select(*[F.lower(F.hex(c)).alias(c) if kind == "binary" else c for c, kind in rows.dtypes])


def fingerprint_audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the start of the next document.

    The next document is the one with the next smaller doc_id (null ids come last; rows with one id in the order of their texts'
    hashes); after the last comes the first. A null text counts as empty. Returns doc_id, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (hex), near_edited and near_next (likeness, 0 to 1). A single row follows itself; an empty table gives an empty
    table; other columns are not read.

    Rows are dealt by ranges of doc_id, and by ranges of their texts' hashes for null and for an id of very many rows; bounds come from
    quantile sketches. Each range also gets the first row of the next one, so neighbours meet in one shuffle of the texts.
    """
    return _spelt(_audit_rows(docs, id_col, text_col))


def _audit_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fingerprint_audit with digests and fingerprints as bytes."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    many = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    bucket = _bucket(docs, 4 * many)
    first = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("later"))).alias("first")  # the greatest id, null the least, then the least hash
    found = sorted((r.bucket, r.first.doc_id, ~r.first.later) for r in docs.groupBy(bucket.alias("bucket")).agg(first).collect())  # a row for each range
    # the first row of each range also goes to the range before it; the very first to the last
    size = found[-1][0] + 1 if found else 0
    ids, ties, goes = [None] * size, [None] * size, [None] * size
    for k, (b, id_, tie) in enumerate(found):
        ids[b], ties[b], goes[b] = id_, tie, found[k - 1][0]
    at = F.col("bucket") + 1
    known = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), at)
    guest = F.when(F.col("doc_id").eqNullSafe(known(ids, "bigint")) & (F.col("tie") == known(ties, "bigint")), known(goes, "int"))
    rows = docs.withColumn("bucket", bucket).select("bucket", guest.alias("goes"), "doc_id", "text", "tie")
    rows = rows.select(F.explode(F.filter(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("goes").alias("bucket"), F.lit(True).alias("guest"))), lambda x: x.bucket.isNotNull())).alias("at"), "doc_id", "text", "tie")
    rows = rows.select("at.bucket", "at.guest", "doc_id", "text", "tie").repartition(many, "bucket")
    # copies of a range's first row are all guests; the first in order is the neighbour
    rows = rows.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "tie")
    return rows.select("bucket", "guest", "doc_id", "text").mapInArrow(_audit, "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def band_keys(f: np.ndarray) -> np.ndarray:
    """BANDS keys of each fingerprint. A band of end marks says nothing of a text, so samples after it are added until LIVE are none."""
    out = np.zeros((len(f), BANDS), np.uint64)
    for b in range(BANDS):
        part = f[:, b * ROWS : (b + 1) * ROWS]
        key = np.uint64(b + 1) + (part * STEP[:ROWS]).sum(1)
        live = (part != 0).sum(1)
        for k in range(ROWS, SAMPLES):
            some = np.flatnonzero(live < LIVE)
            if not len(some):
                break
            m = (b * ROWS + k) % SAMPLES
            value = f[some, m]
            key[some] = np.where(value != 0, mix(key[some] + (np.uint64(256 * m) + value) * STEP[7]), key[some])
            live[some] += value != 0
        out[:, b] = mix(key)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SAMPLES)


def _linked(least: float, own: int, other: int):
    """(u, v, print, print) -> the (u, v) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(likeness(_matrix(batch.column(own)), _matrix(batch.column(other))) >= least))

    return run


def _within(least: float):
    """Rows (key, tile, node, label, print), sorted by key and tile -> links (u, v) between nodes of different labels of each tile."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, tile, node, label = (t.column(i).to_numpy() for i in range(4))
        f = _matrix(t.column(4).combine_chunks() if t.num_rows else t.column(4))
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), [True]]))
        u, v = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            for i in range(lo, hi - 1):
                rest = np.flatnonzero(label[i + 1 : hi] != label[i]) + i + 1
                if len(rest):
                    at = rest[likeness(f[rest], f[i : i + 1]) >= least]
                    u += [node[i]] * len(at)
                    v += node[at].tolist()
            if len(u) > 10_000:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            key, tile = t.column(0).to_numpy(), t.column(1).to_numpy()
            done = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
            stop = int(done[-1]) + 1 if len(done) else 0
            if stop:
                yield from settle(t.slice(0, stop))
            held = t.slice(stop).combine_chunks().to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links: a component's smallest node for each node that has a link."""
    return stored(components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(links)))


def _node_labels(node: DataFrame, least: float) -> DataFrame:
    """(node, fingerprint) -> (node, label) of the nodes with links.

    Keys of up to GROUP nodes are compared in full. In larger ones a hub meets all nodes that aren't in its component yet, ROUNDS
    times; what is still apart is compared in full, in tiles. Nodes of one component aren't compared again.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column(1)))
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "node"])

    keys = stored(node.select("node", "fingerprint").mapInArrow(spell, "key long, node long"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keys.join(shared, "key"))
    drop_stored(keys)
    few = met.where(f"n <= {GROUP}").join(node, "node").select("key", F.lit(0).alias("tile"), "node", F.col("node").alias("label"), "fingerprint")
    few = few.repartition("key").sortWithinPartitions("key", "tile")
    labels = stored(components(few.mapInArrow(_within(least), "u long, v long")))
    hot = met.where(f"n > {GROUP}").select("key", "node")
    for round_ in range(ROUNDS + 1):
        now = stored(hot.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        each = now.groupBy("key", "label").agg(F.count("*").alias("n"))
        open_ = stored(each.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1"))
        if open_.isEmpty():
            break
        here = now.join(open_, "key").join(node, "node")
        if round_ < ROUNDS:
            hubs = now.join(open_, "key").groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(round_))).alias("hub"))
            hubs = stored(hubs.join(node.select(F.col("node").alias("h"), F.col("fingerprint").alias("hub_print")), F.col("hub.node") == F.col("h")).select("key", "hub", "hub_print"))
            pairs = here.join(hubs, "key").where("label <> hub.label").select("node", F.col("hub.node").alias("v"), "fingerprint", "hub_print")
            links = pairs.mapInArrow(_linked(least, 2, 3), "u long, v long")
        else:
            tiled = here.withColumn("blocks", F.expr(f"cast(ceil(n / {TILE // 2}) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
            tiled = tiled.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("tile", F.expr("least(block, other) * 1000000L + greatest(block, other)"))
            tiled = tiled.select("key", "tile", "node", "label", "fingerprint").repartition("key", "tile").sortWithinPartitions("key", "tile")
            links = tiled.mapInArrow(_within(least), "u long, v long")
        labels = _merged(labels, links)
        drop_stored(now)
    drop_stored(met)
    return labels


def _with_classes(rows: DataFrame, least: float) -> DataFrame:
    """rows (written, with doc_id, binary fingerprint and n_chars) with a class_id. Ids with several texts link the texts."""
    prints = rows.where("n_chars > 0 and doc_id is not null").select("doc_id", "fingerprint")
    node = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).withColumn("node", F.col("first")))
    labels = _node_labels(node.select("node", "fingerprint"), least)
    text = F.xxhash64("fingerprint")
    several = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("doc_id"))
    of_id = None
    if not several.isEmpty():
        own = prints.join(several, "doc_id", "left_semi").distinct().join(node, "fingerprint")
        before, labels = labels, _merged(labels, own.select(F.col("first").alias("u"), F.col("doc_id").alias("v")))
        of_id = stored(several.join(labels, several.doc_id == labels.node, "left").select("doc_id", F.coalesce("label", "doc_id").alias("id_class")))
        drop_stored(before)
    named = stored(node.join(labels, "node", "left").where("n > 1 or label is not null").select("fingerprint", F.coalesce("label", "node").alias("class_id")))
    drop_stored(node)
    named = F.broadcast(named) if named.count() <= BROADCAST_CLASSES else named
    out = rows.join(named, "fingerprint", "left")
    class_id = F.when(F.col("n_chars") == 0, F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id"))
    if of_id is not None:
        out = out.join(of_id, "doc_id", "left")
        class_id = F.coalesce("id_class", class_id)
    return out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), class_id))


def fingerprint_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of fingerprint_audit with one more column, the class_id of near_documents."""
    rows = stored(_audit_rows(docs, id_col, text_col))
    return _spelt(_with_classes(rows, least).select(*rows.columns, "class_id"))


def near_documents(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near copies by their fingerprints: (doc_id, class_id) for each row, class_id the smallest id reachable by verified links.

    Banding: BANDS keys of ROWS sampled steps each; documents that share a key are candidates. Verification: likeness of at least
    `least`. No candidate is left out, but pairs that other links already join aren't verified. Equal texts have
    equal fingerprints and are one class. Rows of one id count as one document, whose texts are linked: its rows are all in one class. Null
    ids and empty texts have no links and are classes of their own: the class of a null id is null, whatever its text, that of an id which has
    empty texts only is the id. Other columns are not read; an empty table gives an empty table.
    """
    schema = "doc_id long, fingerprint binary, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in slices(batches, "text"):
            texts = column.to_pylist()
            yield pa.record_batch([part.column("doc_id"), pa.array([x.tobytes() for x in fingerprints(texts)], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "fingerprint", "n_chars"])

    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    return _with_classes(rows, least).select("doc_id", "class_id")
