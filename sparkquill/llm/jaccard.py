"""Exact set-similarity join on word shingles, and its connected components.

Method. A document is the set of its distinct five-word shingles (64-bit hashes); equal sets are one node. Two sets that are similar
enough share one of the first few elements of each in any fixed order of all shingles (prefix filter), so nodes meet by an equi-join
on those elements, frequent shingles ordered last. Within a join key, nodes are tiled by set size (a partner's size lies within the
threshold's ratio) and by the place of the key in both sets. Candidate pairs then meet hashed parity bitmaps, whose differing bits
bound the overlap from above, and what is left is settled by intersecting the exact sorted arrays.

Hot keys. A key of more than GROUP nodes links each node with one hub of its size band only (the key decides by a hash which node
is the hub). After the components of these links are known, further rounds take other hubs for the nodes of a key that are still in
different components, as long as there are many; the rest is compared in square tiles of bounded size, where bitmaps are met before
a pair is put out. So a group of very many near copies costs some comparisons a node, while no link between components is lost.

Numbers of links. All links of a set lie within its component, so once components are known their sets are dealt into blocks of bounded
size, and each pair of blocks is a tile that counts exact intersections as bits and puts out one number a set, never a pair. That costs
the square of a component's different sets in time, and each set is copied once for every block of its component.

The order of shingles only steers cost: counts of frequent shingles cover all documents, and any order gives the same links.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from sparkquill.llm.batches import STEP, U64, drop_stored, fresh, mix, shingle_sets, signed, slices, stored
from sparkquill.llm.components import components

SHINGLE = 5
GROUP = 32
TILE = 1024
#: Shingles whose frequency is broadcast at most (16 bytes each); the others count as rare. It bounds memory, not results.
FREQUENT = 300_000
#: Powers of two: the least and the greatest number of bits of the Bloom filter.
BLOOM_LEAST, BLOOM_MOST = 23, 27
#: Sets and elements of a block of a component, of which two make a tile when links are counted.
BLOCK_SETS, BLOCK_ELEMENTS = 1024, 1 << 20
#: Elements that a tile's intersections are counted over at once.
BIT_COLUMNS = 1 << 13
#: Rounds of other hubs before the keys' remaining nodes are compared in tiles.
ROUNDS = 1


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set that isn't empty: its name, and another one by which sets of one name are told apart."""
    x = np.array([[np.bitwise_xor.reduce(mix(s)), s[0], len(s)], [mix(s).sum(), s[-1], len(s)]], U64) * STEP[:3]
    name, other = mix(x.sum(1)).view(np.int64).tolist()
    return name, other


def _named(s: np.ndarray, shared: dict[int, int]) -> int:
    """The node of a set: its name, but of different sets with one name only that of `shared` has it; the others get names of their own."""
    name, other = _signature(s)
    if shared and shared.get(name, other) != other:
        return int(mix(np.array([name, other], np.int64).view(U64) * STEP[3:5]).sum(keepdims=True).view(np.int64)[0])
    return name


def _rows(text: str, keep: list[str], shared: Broadcast | None) -> tuple:
    """(kept columns, set size, node, other hash) of each document, a set's bitmap once in a stretch, and (nulls, shingle, count) of shingles
    seen often in a stretch."""
    fields = [("n_shingles", pa.int64()), ("sig", pa.int64()), ("other", pa.int64()), ("times", pa.int64()), ("bits", pa.binary())]
    schema = pa.schema([*[(k, pa.int64()) for k in keep], *fields])

    def flush(sets: list[np.ndarray]) -> pa.RecordBatch:
        x, c = np.unique(np.concatenate(sets), return_counts=True)
        often = c >= 3
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.record_batch([*[none] * (len(keep) + 1), pa.array(signed(x[often])), none, pa.array(c[often]), pa.nulls(int(often.sum()), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value if shared else {}
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for part, column in slices(batches, text):
            sets = shingle_sets(column, SHINGLE)
            sigs = [_named(s, own) if len(s) else None for s in sets]
            others = [_signature(s)[1] if len(s) else None for s in sets]
            bits: list[bytes | None] = [None] * len(sets)
            for k, (sig, s) in enumerate(zip(sigs, sets, strict=True)):
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    held.append(s)
                    size += len(s)
                    bits[k] = _bits(s)
            yield pa.record_batch([*[part.column(k) for k in keep], pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.array(others, pa.int64()), pa.nulls(len(sets), pa.int64()), pa.array(bits, pa.binary())], schema=schema)
            if size > 4_000_000:
                yield flush(held)
                held, size, seen = [], 0, set()
        if held:
            yield flush(held)

    return run, ", ".join(f"{k} long" for k in keep) + ", n_shingles long, sig long, other long, times long, bits binary"


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most FREQUENT of them, sorted, and how often each was seen."""
    counts = rows.where("times is not null").groupBy("sig").agg(F.sum("times").alias("times")).where("times >= 8")
    counts = stored(counts)
    bins = counts.groupBy(F.floor(F.log2("times") * 4).alias("bin")).count().orderBy(F.desc("bin")).collect()  # some hundred bins at most
    least, total = None, 0
    for r in bins:
        if total + r["count"] > FREQUENT:
            break
        total, least = total + r["count"], r["bin"]
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    got = counts.where(F.floor(F.log2("times") * 4) >= least).toPandas()
    drop_stored(counts)
    x = got["sig"].to_numpy(np.int64).view(U64)
    order = np.argsort(x)
    return x[order], got["times"].to_numpy(np.int64)[order]


def _prefixes(text: str, frequent: Broadcast, shared: Broadcast):
    """The keys of each distinct set: its first elements, the rarest first."""
    schema = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        seen: set[int] = set()
        for _, column in slices(batches, text):
            keys, sigs, sizes, poss = [], [], [], []
            for s in shingle_sets(column, SHINGLE):
                if not len(s) or (sig := _named(s, shared.value)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sig)
                n = len(s)
                take = n - (4 * n + 4) // 5 + 1
                if len(known):
                    at = np.searchsorted(known, s)
                    at[at == len(known)] = 0
                    hit = known[at] == s
                    if hit.any():
                        rare = s[~hit]
                        if len(rare) < take:
                            often = s[hit]
                            often = often[np.lexsort((often, times[at[hit]]))]
                            s = np.concatenate([rare, often[: take - len(rare)]])
                        else:
                            s = rare
                keys.append(s[:take])
                sigs.append(np.full(take, sig, np.int64))
                sizes.append(np.full(take, n, np.int32))
                poss.append(np.arange(take, dtype=np.int32))
            if keys:
                yield pa.record_batch([pa.array(signed(np.concatenate(keys))), *(pa.array(np.concatenate(x)) for x in (sigs, sizes, poss))], schema=schema)

    return run, "key long, sig long, size int, pos int"


def _may_link(sa: np.ndarray, pa_: np.ndarray, sb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether the sizes and the places of a shared key leave room for a link."""
    lo, hi = np.minimum(sa, sb), np.maximum(sa, sb)
    return (5 * lo >= 4 * hi) & (9 * (1 + np.minimum(sa - pa_, sb - pb) - 1) >= 4 * (sa + sb))


PAIR = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    keep = lo != hi
    both = np.unique(np.stack([lo[keep], hi[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    n = len(both)
    return pa.record_batch([pa.nulls(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], schema=PAIR)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size, place, band) sorted by key, band and a hash of the node -> candidate pairs (key null) of each key, and the
    rows of keys with over GROUP nodes.

    A key's rows are held only up to GROUP; beyond, they pass by the first node of their band and that of the band before.
    """
    tail = None  # rows of the last key, while they are few
    hot = None  # (key, {band: (node, size, place) of its hub}), if the last key is hot
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if tail is not None:
            rows = [np.concatenate(x) for x in zip(tail, rows, strict=True)]
        key, sig, size, pos, band = rows
        if not len(key):
            continue
        same = np.ones(len(key), bool)
        same[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])  # a node may come from several partitions
        if not same.all():
            key, sig, size, pos, band = (x[same] for x in (key, sig, size, pos, band))
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        counts = np.diff(bounds)
        big = counts > GROUP
        if hot is not None and key[0] == hot[0]:
            big[0] = True
        tail = None
        stop = len(key)
        if not big[-1]:
            stop = bounds[-2]
            tail = [x[stop:] for x in (key, sig, size, pos, band)]
        plain = ~np.repeat(big, counts)[:stop]
        k, s, z, p = (x[:stop][plain] for x in (key, sig, size, pos))
        for d in range(1, GROUP):
            at = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else ()
            if not len(at):
                break
            at = at[_may_link(z[at], p[at], z[at + d], p[at + d])]
            if len(at):
                yield _pairs(s[at], s[at + d])
        for g in np.flatnonzero(big):
            lo, hi = bounds[g], bounds[g + 1]
            if hot is None or hot[0] != key[lo]:
                hot = (key[lo], {})
            for at in lo + np.flatnonzero(np.concatenate([[True], band[lo + 1 : hi] != band[lo : hi - 1]])):
                own = int(band[at])
                to = lo + int(np.searchsorted(band[lo:hi], own, side="right"))
                hot[1].setdefault(own, (sig[at], size[at], pos[at]))
                for b in (own - 1, own):
                    if b in hot[1]:
                        node, n, place = hot[1][b]
                        ok = np.flatnonzero(_may_link(size[at:to], pos[at:to], np.int32(n), np.int32(place))) + at
                        yield _pairs(sig[ok], np.full(len(ok), node, np.int64))
            yield pa.record_batch([pa.array(key[lo:hi]), pa.array(sig[lo:hi]), pa.nulls(int(hi - lo), pa.int64()), pa.array(size[lo:hi]), pa.array(pos[lo:hi])], schema=PAIR)
        if tail is not None:
            hot = None
    if tail is not None and len(tail[0]) > 1:
        k, s, z, p, _ = tail
        i, j = np.triu_indices(len(k), 1)
        ok = _may_link(z[i], p[i], z[j], p[j])
        yield _pairs(s[i[ok]], s[j[ok]])


class _Bitmaps:
    """Bitmaps of different widths, compared at the smaller width of a pair."""

    def __init__(self, bitmaps: list[bytes]):
        self.width = np.array([len(b) for b in bitmaps])
        self.at: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            rows = np.zeros((len(bitmaps), w), np.uint8)
            for i, b in enumerate(bitmaps):
                x = np.frombuffer(b, np.uint8)
                while len(x) > w:
                    x = _fold(x)
                if len(x) == w:
                    rows[i] = x
            self.at[w] = rows

    def differing(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many bits differ between i and each of the others: at most as many as elements that only one of the sets has."""
        out = np.zeros(len(others), np.int64)
        low = np.minimum(self.width[others], self.width[i])
        for w in np.unique(low).tolist():
            on = low == w
            out[on] = np.bitwise_count(self.at[w][others[on]] ^ self.at[w][i]).sum(1)
        return out


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, sig, size, pos, label, bits), sorted by key and tile, at most some TILE rows each -> pairs of different labels
    whose sizes, places and bitmaps leave room for a link."""
    held: list[pa.RecordBatch] = []

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, tile, sig, size, pos, label = (t.column(i).to_numpy() for i in range(6))
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), [True]]))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            bits = _Bitmaps(t.column(6).slice(lo, hi - lo).to_pylist())
            for i in range(lo, hi):
                ok = np.flatnonzero((label[i + 1 : hi] != label[i]) & _may_link(size[i + 1 : hi], pos[i + 1 : hi], size[i], pos[i])) + i + 1
                if len(ok):
                    ok = ok[bits.differing(i - lo, ok - lo) <= (size[ok] + size[i]) // 9]
                    yield _pairs(sig[ok], np.full(len(ok), sig[i], np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        key, tile = t.column(0).to_numpy(), t.column(1).to_numpy()
        done = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
        stop = int(done[-1]) + 1 if len(done) else 0
        if stop:
            yield from settle(t.slice(0, stop))
        held = t.slice(stop).combine_chunks().to_batches()
    if held:
        yield from settle(pa.Table.from_batches(held))


def _bits(s: np.ndarray) -> bytes:
    """Parity bitmap of hashed elements, two to four bits an element, a power of two between 256 and 65,536."""
    width = min(1 << 16, max(256, 2 << int(len(s) - 1).bit_length()))
    odd = np.bincount((mix(s) & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _nodes(text: str, bloom: Broadcast, shared: Broadcast):
    """(sig, sorted elements) of the sets that the Bloom filter lets through."""
    schema = pa.schema([("sig", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        low = 64 * len(words) - 1
        seen: set[int] = set()
        for _, column in slices(batches, text):
            out = []
            for s in shingle_sets(column, SHINGLE):
                if not len(s) or (sig := _named(s, shared.value)) in seen:
                    continue
                at = sig & low
                if (int(words[at >> 6]) >> (at & 63)) & 1:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sig)
                    out.append((sig, s.tobytes()))
            if out:
                sig, members = zip(*out, strict=True)
                yield pa.record_batch([pa.array(sig, pa.int64()), pa.array(members, pa.binary())], schema=schema)

    return run, "sig long, members binary"


def _node_table(docs: DataFrame, text: str, pairs: DataFrame, shared: Broadcast) -> DataFrame:
    """The sets of the nodes in the pairs. A Bloom filter keeps most others from being shuffled, the join the rest. It has some eight bits
    for each node, up to BLOOM_MOST bits (it only saves work)."""
    spark = docs.sparkSession
    wanted = stored(pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct())
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, (8 * wanted.count()).bit_length()))
    low = F.col("sig").bitwiseAND(F.lit((1 << bits) - 1))
    words = np.zeros(1 << (bits - 6), U64)
    set_bits = wanted.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sig & 63 as int))")).alias("bits")).toPandas()  # 2**(BLOOM_MOST - 6) rows at most
    words[set_bits["word"].to_numpy(np.int64)] = set_bits["bits"].to_numpy(np.int64).view(U64)
    run, schema = _nodes(text, spark.sparkContext.broadcast(words), shared)
    nodes = docs.select(text).mapInArrow(run, schema).join(wanted, "sig", "left_semi").dropDuplicates(["sig"])
    nodes = stored(nodes)
    drop_stored(wanted)
    return nodes


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, bits_a, bits_b) -> (a, b) where the bitmaps leave room for a link."""
    for batch in batches:
        keep = []
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        for x, y, limit in zip(batch.column(4), batch.column(5), ((na + nb) // 9).tolist(), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
            while len(p) > len(q):
                p = _fold(p)
            while len(q) > len(p):
                q = _fold(q)
            keep.append(int(np.bitwise_count(p ^ q).sum()) <= limit)
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _fold(p: np.ndarray) -> np.ndarray:
    """A bitmap of half the width: the hash modulo half the width puts bit i and bit i + half together."""
    return p[: len(p) // 2] ^ p[len(p) // 2 :]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, members_a, members_b) -> (u, v) where the sets link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
            both = np.concatenate([p, q])
            both.sort(kind="stable")  # two sorted runs: a merge
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(9 * shared >= 4 * (len(p) + len(q)))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets (sorted, distinct) have in common, as a symmetric matrix."""
    m = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh_ = np.concatenate([[True], every[1:] != every[:-1]])
    run = np.cumsum(fresh_) - 1
    twice = np.bincount(run)[run] > 1  # an element of one set alone is in no intersection
    owner, column = owner[twice], (np.cumsum(fresh_ & twice) - 1)[twice]
    out = np.zeros((m, m), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, BIT_COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + BIT_COLUMNS])
        width = -(-(int(column[b - 1]) + 1 - lo) // 64) * 64
        has = np.zeros((m, width), bool)
        has[owner[a:b], column[a:b] - lo] = True
        words = np.packbits(has, axis=1).view(U64)
        for i in range(m - 1):
            out[i, i + 1 :] += np.bitwise_count(words[i + 1 :] & words[i]).sum(1, dtype=np.int64)
    return out + out.T


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, tile, block, sig, weight, members), sorted by label and tile -> (sig, links): the weights of the sets of the tile that
    link with this one, of the other block where the tile has two."""
    held: list[pa.RecordBatch] = []

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        label, tile, block, sig, weight = (t.column(i).to_numpy() for i in range(5))
        cut = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (tile[1:] != tile[:-1]), [True]]))
        links = np.zeros(len(label), np.int64)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(x.as_py(), U64) for x in t.column(5).slice(lo, hi - lo)]
            n = np.array([len(s) for s in sets])
            linked = 9 * _intersections(sets) >= 4 * (n[:, None] + n[None, :])
            np.fill_diagonal(linked, False)
            if tile[lo] // 1_000_000 != tile[lo] % 1_000_000:
                linked &= block[lo:hi, None] != block[None, lo:hi]
            links[lo:hi] = linked @ weight[lo:hi]
        some = links > 0
        yield pa.record_batch([pa.array(sig[some]), pa.array(links[some])], names=["sig", "links"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.slice(batch.num_rows - 1)
        first = held[0]
        if first.column(0)[0] == last.column(0)[0] and first.column(1)[0] == last.column(1)[0]:
            continue  # one tile still
        t = pa.Table.from_batches(held)
        label, tile = t.column(0).to_numpy(), t.column(1).to_numpy()
        stop = int(np.flatnonzero((label != label[-1]) | (tile != tile[-1]))[-1]) + 1
        yield from settle(t.slice(0, stop))
        held = t.slice(stop).combine_chunks().to_batches()
    if held:
        yield from settle(pa.Table.from_batches(held))


def _link_counts(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, links) of sets (sig, members) that link with other sets: the weights of those. classes has sig, label, weight and size of them."""
    of = classes.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    dealt = classes.join(of, "label").withColumn("block", F.expr("cast(pmod(xxhash64(sig, 5), blocks) as int)")).select("sig", "label", "weight", "blocks", "block")
    rows = sets.join(dealt, "sig").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("tile", F.expr("least(block, other) * 1000000L + greatest(block, other)"))
    rows = rows.select("label", "tile", "block", "sig", "weight", "members").repartition("label", "tile").sortWithinPartitions("label", "tile")
    return rows.mapInArrow(_count_links, "sig long, links long").groupBy("sig").agg(F.sum("links").alias("links"))


def _verified(pairs: DataFrame, bits: DataFrame, docs: DataFrame, shared: Broadcast) -> tuple[DataFrame, DataFrame]:
    """The links (u, v) among candidate pairs (a, b), and the sets (sig, members) of the nodes that were compared. bits has sig, n and bits of
    every node."""
    a, b = (bits.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}")) for x in "ab")
    left = stored(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_bounded, "a long, b long"))
    nodes = _node_table(docs, "text", left, shared)
    a, b = (nodes.select(F.col("sig").alias(x), F.col("members").alias(f"x{x}")) for x in "ab")
    links = stored(left.join(a, "a").join(b, "b").select("a", "b", "xa", "xb").mapInArrow(_exact, "u long, v long"))
    drop_stored(left)
    return links, nodes


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: the components of the labels that the links join, a component's smallest label for each node."""
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "uv")
    ends = links.join(a, "u", "left").join(b, "v", "left").select("u", "v", F.coalesce("lu", "u").alias("lu"), F.coalesce("lv", "v").alias("lv"))
    ends = stored(ends)
    over = stored(components(ends.select(F.col("lu").alias("u"), F.col("lv").alias("v"))))
    known = labels.union(ends.select("u", "lu")).union(ends.select("v", "lv")).distinct()
    return stored(known.join(over.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label")).distinct())


def _grouped(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows, labels, sets) of docs (kept integer columns and text): rows has the kept columns, n_shingles and sig, which is null without
    words; labels has (sig, label) of the sets that link with another one; sets are tables (sig, members) that have all of those."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    run, schema = _rows("text", keep, None)
    rows = stored(docs.mapInArrow(run, schema))
    # different sets of one name: each gets a node of its own
    several = rows.where("other is not null").groupBy("sig").agg(F.min("other").alias("least"), F.max("other").alias("most")).where("least <> most")
    shared = share({r.sig: r.least for r in several.collect()})  # some n**2 / 2**65 of n sets
    if shared.value:
        run, schema = _rows("text", keep, shared)
        rows = stored(docs.mapInArrow(run, schema))
    base = rows.where("times is null").select(*keep, "n_shingles", "sig")
    bits = stored(rows.where("bits is not null").select("sig", F.col("n_shingles").alias("n"), "bits").dropDuplicates(["sig"]))

    keys, keys_schema = _prefixes("text", share(_frequencies(rows)), shared)
    band = F.floor(F.log("size") / F.log(F.lit(1.25))).cast("int").alias("band")
    met = docs.select("text").mapInArrow(keys, keys_schema).select("key", "sig", "size", "pos", band).repartition("key")
    met = met.sortWithinPartitions("key", "band", F.xxhash64("sig", F.expr("key & 3")), "sig").mapInArrow(_meet, "key long, a long, b long, size int, pos int")
    met = stored(met)
    links, nodes = _verified(stored(met.where("key is null").select("a", "b").distinct()), bits, docs, shared)
    labels, sets = stored(components(links)), [nodes]

    hot = met.where("key is not null").select("key", F.col("a").alias("sig"), "size", "pos", band)
    for round_ in range(ROUNDS + 1):
        # rows of the keys whose nodes are in different components
        now = stored(hot.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
        each = now.groupBy("key", "label").agg(F.count("*").alias("n"))
        several = stored(each.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("labels")).where("labels > 1"))
        work = several.agg(F.sum(F.expr("(cast(n as double) * n - same) / 2")).alias("pairs"), F.sum("n").alias("rows")).first()
        if not work.rows:
            break
        open_ = now.join(several.select("key", "n"), "key")
        if round_ < ROUNDS and work.pairs > 8 * work.rows:
            hubs = open_.groupBy("key", "band").agg(F.min_by(F.struct("sig", "size", "pos", "label"), F.xxhash64("sig", F.expr(f"key & 3 | {4 + 4 * round_}"))).alias("hub"))
            hubs = stored(hubs.select("key", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "hub"))
            pairs = open_.join(hubs, ["key", "band"]).where("label <> hub.label and 5 * least(size, hub.size) >= 4 * greatest(size, hub.size) and 9 * least(size - pos, hub.size - hub.pos) >= 4 * (size + hub.size)")
            pairs = pairs.select(F.least("sig", "hub.sig").alias("a"), F.greatest("sig", "hub.sig").alias("b"))
        else:
            tiled = open_.withColumn("blocks", F.expr(f"cast(ceil(n / {TILE // 2}) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(sig), blocks) as int)"))
            tiled = tiled.join(bits.select("sig", "bits"), "sig").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("tile", F.expr("least(block, other) * 1000000L + greatest(block, other)"))
            tiled = tiled.select("key", "tile", "sig", "size", "pos", "label", "bits").repartition("key", "tile").sortWithinPartitions("key", "tile")
            pairs = tiled.mapInArrow(_cross, "key long, a long, b long, size int, pos int").select("a", "b")
            round_ = ROUNDS
        links, nodes = _verified(stored(pairs.distinct()), bits, docs, shared)
        labels = _merged(labels, links)
        sets.append(nodes)
        drop_stored(now)
        if round_ == ROUNDS:
            break
    drop_stored(met)
    drop_stored(bits)
    return base, labels.select(F.col("node").alias("sig"), "label"), sets


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose word shingle sets have a Jaccard similarity of at least 0.8, as connected components.

    Returns a row per row of docs: doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links, itself included) and
    n_links (other rows that it links with, those of an equal set included). Words are what lies between white space, A-Z lower-cased. A
    text of fewer words than a shingle has its whole sequence as its one element; null, empty and blank texts have none, link with
    nothing and are components of their own. Repeated rows are equal sets, so they link and are one component. A null id gives a null
    component_id unless a linked row has an id. Other columns are not read. An empty table gives an empty table. Elements are compared
    by 64-bit hashes, equal sets by 128 bits.
    """
    base, labels, sets = _grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    each = base.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.max("n_shingles").alias("size"))
    classes = stored(each.join(labels.withColumn("met", F.lit(True)), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    nodes = functools.reduce(DataFrame.union, sets)
    links = stored(_link_counts(nodes.dropDuplicates(["sig"]) if len(sets) > 1 else nodes, classes.where("met").select("sig", "label", "weight", "size")))
    for x in sets:
        drop_stored(x)
    least = stored(classes.groupBy("label").agg(F.min("least").alias("component_id")))
    named = classes.join(least, "label").join(links, "sig", "left")
    named = stored(named.select("sig", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return base.join(named, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: Removed rows up to which their keys are broadcast to the texts; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similarity_components, with all columns of docs: the one of the least id (a null comes last), of
    several texts with that id the one of the least hash, and of rows that have both in common the least row.

    Rows are told apart by id and text, so rows that only share an id, or have none, never stand for each other. Null, empty and blank
    texts have no copies: all their rows stay. Columns may have any names; an empty table gives an empty table.
    """
    key = lambda text: F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")))
    base, labels, sets = _grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), key(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")), ["doc_id", "digest"])
    for x in sets:
        drop_stored(x)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    rows = base.where("sig is not null").groupBy("sig", "doc_id", "digest").agg(F.count("*").alias("n")).join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    rows = stored(rows.select("label", "doc_id", "digest", "n"))
    first = stored(rows.groupBy("label").agg(F.min(rank).alias("best")))
    judged = stored(rows.join(first, "label").select("doc_id", "digest", "n", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))).alias("stays")))

    def meets(keys: DataFrame, how: str) -> DataFrame:
        few = keys.count() <= BROADCAST_ROWS
        a, b = fresh("id_", docs), fresh("digest_", docs)
        keys = keys.select(F.col("doc_id").alias(a), F.col("digest").alias(b))
        return docs.join(F.broadcast(keys) if few else keys, F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (key(F.col(text_col)) == F.col(b)), how)

    again = stored(judged.where("stays and n > 1"))
    gone = stored(judged.where("not stays").select("doc_id", "digest").union(again.select("doc_id", "digest")))
    kept = meets(gone, "left_anti")
    if again.isEmpty():
        return kept
    names = [f"`{c}`" for c in docs.columns]
    once = meets(again, "left_semi").select(F.struct(*names).alias("row")).groupBy(F.col(f"row.`{id_col}`").alias("a"), key(F.col(f"row.`{text_col}`")).alias("b")).agg(F.min("row").alias("row"))
    return kept.select(*names).union(once.select(*[F.col(f"row.{c}") for c in names]))
