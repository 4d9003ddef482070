"""Secret scan with corpus-wide ownership frequency.

Base patterns give spans of three kinds. Beside them, long tokens of high entropy are candidates. Every candidate's value is hashed;
the corpus is aggregated to the number of distinct owners and repositories of each hash. A value is

* live-looking: one owner has it, in at most LIVE_REPOSITORIES repositories;
* an example: EXAMPLE_OWNERS owners or more have it, or EXAMPLE_REPOSITORIES repositories or more (a hot owner may copy it alone);
* shared: anything between, which is neither clearly somebody's nor clearly public.

High-entropy tokens become spans of their own (kind ``token``) only where their value is live-looking; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkquill.llm.batches import LOWER, buffers, fresh, slices, stored

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 6, 20, 24, 20
#: Every match of ASSIGN has one of these, lower-cased.
WORDS = (b"passw", b"secret", b"token", b"apik", b"api_")
#: Bits a character that a token needs.
ENTROPY = 3.5
LIVE_REPOSITORIES, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 3, 4
LIVE, SHARED, EXAMPLE = "live", "shared", "example"
#: Groups of rows among which the spans of one value are dealt.
SALTS = 256

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return found


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with letters and digits and a high entropy that no base span touches."""
    out = []
    for m in TOKEN.finditer(text):
        x = m[0]
        if not (re.search("[0-9]", x) and re.search("[A-Za-z]", x)) or any(a < m.end() and m.start() < b for a, _, b, _ in taken):
            continue
        if round(-sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values()), 9) >= ENTROPY:
            out.append((m.start(), 3, m.end(), x))
    return out


def _worth(column: pa.Array) -> np.ndarray:
    """Whether each text can have a span: it has a keyword or a run of TOKEN_LEAST characters. (Both are necessary for a match.)"""
    buf, off = buffers(column)
    hit = np.zeros(len(column), bool)
    if not len(buf):
        return hit
    low = LOWER[buf].tobytes()
    for word in WORDS:
        at = low.find(word)
        while at >= 0:
            k = int(np.searchsorted(off, at, side="right")) - 1
            hit[k] = True
            at = low.find(word, int(off[k + 1])) if off[k + 1] > at else -1
    other = np.flatnonzero(~_RUN[buf])
    gap = np.diff(np.concatenate([[-1], other, [len(buf)]]))
    for i in np.flatnonzero(gap > TOKEN_LEAST):
        lo = 0 if i == 0 else int(other[i - 1]) + 1
        hit[np.searchsorted(off, lo, side="right") - 1 : np.searchsorted(off, lo + int(gap[i]) - 1, side="left")] = True
    return hit


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


SPAN = "struct<start:int,kind:int,end:int,value:bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))
    nothing = hashlib.sha256(b"").hexdigest()
    for part, column in slices(batches, "text"):
        n, spans, sha = np.zeros((3, len(column)), np.int64), [[]] * len(column), [nothing] * len(column)
        for i in np.flatnonzero(_worth(column)).tolist():
            text = column[i].as_py()
            found = sorted(base_spans(text))
            for kind in range(3):
                n[kind, i] = sum(f[1] == kind for f in found)
            if found:
                sha[i] = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found).encode()).hexdigest()
            found += token_spans(text, found)
            spans[i] = [{"start": a, "kind": k, "end": b, "value": _hash(v)} for a, k, b, v in found]
        yield pa.record_batch([part.column("row"), part.column("doc_id"), part.column("owner"), part.column("repo"), *map(pa.array, n), pa.array(sha), pa.array(spans, span)], names=["row", "doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def _row_key(id_: Column, text: Column) -> Column:
    """128 bits of id and text. Rows with both in common have equal keys; their spans are equal too."""
    return F.md5(F.concat_ws("\n", F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang") -> DataFrame:
    """Candidates of each row: row key, id, owner, repository, base counts and digest, found spans with their values' hashes.

    The repository is the owner's part that repo_col names. A null owner or repository counts as one of its own.
    """
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\0"))
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")) if repo_col else F.lit("")
    text = F.col(text_col)
    rows = docs.select(_row_key(F.col(id_col), text).alias("row"), F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), repo.alias("repo"), text.alias("text"))
    return rows.mapInArrow(_scan, f"row string, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories) over all candidates. Each step combines before its shuffle, so a value that a third of all
    documents has is a row for each owner and repository of a task at most."""
    each = found.where("size(found) > 0").select("owner", "repo", F.explode(F.array_distinct(F.expr("transform(found, f -> f.value)"))).alias("value"))
    by_owner = each.distinct().groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))


def value_class(owners: Column, repositories: Column) -> Column:
    """LIVE, SHARED or EXAMPLE."""
    example = (owners >= EXAMPLE_OWNERS) | (repositories >= EXAMPLE_REPOSITORIES)
    return F.when(example, EXAMPLE).when((owners == 1) & (repositories <= LIVE_REPOSITORIES), LIVE).otherwise(SHARED)


def _judged(found: DataFrame) -> DataFrame:
    """(row, spans) of the rows with candidates; each span has its value's class, owners and repositories. Rows with one id and text are
    judged once. A value meets its statistics once for each of SALTS groups of rows, and the spans meet them by value and group, so a value
    that a third of the rows has is SALTS keys."""
    stats = stored(ownership(found).withColumn("class", value_class(F.col("owners"), F.col("repositories"))))
    each = found.where("size(found) > 0").dropDuplicates(["row"]).select("row", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"), F.inline("found"))
    each = stored(each)
    salted = each.select("value", "salt").distinct().join(stats, "value")
    each = each.join(salted, ["value", "salt"])
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "class", "owners", "repositories"))).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang") -> DataFrame:
    """Spans of secrets in every text: a row per row of docs.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (digest of kind:start:end of the base spans by start, then kind), spans
    (base spans and live-looking tokens, likewise), and n_live, n_shared and n_example (candidates by the class of their values). Offsets
    count code points, ends are exclusive; a span of kind assign covers its whole match. Null and empty texts have no
    spans. Repeated rows get equal results; other columns are not read; an empty table gives an empty table.
    """
    found = stored(scan(docs, id_col, text_col, owner_col, repo_col))
    spans = stored(_judged(found))
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter("spans", lambda s: (s.kind < 3) | (s["class"] == LIVE))
    joined = F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    out = found.drop("found").join(spans, "row", "left")
    count = lambda name: F.when(F.col("spans").isNull(), 0).otherwise(F.size(F.filter("spans", lambda s: s["class"] == name))).cast("long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(joined, F.lit("")).alias("spans"), *[count(c).alias(f"n_{c}") for c in (LIVE, SHARED, EXAMPLE)])


#: Documents with live-looking spans up to which their spans are broadcast to the texts; beyond it the same join shuffles.
BROADCAST_ROWS = 100_000


def _without(text: Column, cuts: Column) -> Column:
    """The text with each of the cuts (start, kind, end; by start) replaced by its kind in brackets; one that lies in an earlier one is
    no cut, and one that begins in an earlier one only removes its rest."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(done: Column, s: Column) -> Column:
        tag = F.when(s.start < done.end, F.lit("")).otherwise(F.element_at(tags, s.kind + 1))
        own = F.struct(F.concat(done.out, F.substring(text, done.end + 1, F.greatest(s.start - done.end, F.lit(0))), tag).alias("out"), s.end.alias("end"))
        return F.when(s.end <= done.end, done).otherwise(own)

    return F.aggregate(cuts, F.struct(F.lit("").alias("out"), F.lit(0).alias("end")), step, lambda done: F.concat(done.out, F.substring(text, done.end + 1, F.length(text))))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang") -> DataFrame:
    """docs with each live-looking span replaced by its kind in brackets; shared values and examples stay. All rows and columns stay, in
    docs' order of columns and whatever their names; null and empty texts stay as they are; repeated rows are cut alike."""
    found = stored(scan(docs, id_col, text_col, owner_col, repo_col))
    row, cuts = fresh("row_", docs), fresh("cuts_", docs)
    live = F.transform(F.filter("spans", lambda s: s["class"] == LIVE), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    spans = stored(_judged(found).select(F.col("row").alias(row), live.alias(cuts)).where(F.size(cuts) > 0))
    few = spans.count() <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(spans) if few else spans, _row_key(F.col(id_col), F.col(text_col)) == F.col(row), "left")
    own = F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(cuts)))
    return joined.select(*[own.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
