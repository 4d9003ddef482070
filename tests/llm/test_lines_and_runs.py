"""Line dedup, tokenizer alignment and periodic runs against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkquill.llm import align, lines, repeats

SCHEMA = "doc_id long, text string, lang string, n_lines string, id string, sig string, line string, places string, place string, h1 string, batch string, kind string, pair string, runs string, start string, length string"


def table(spark, rows, parts=3):
    """documents with more columns, whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", *["x"] * 13) for i, t in rows], SCHEMA).repartition(parts)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- 11

LINE = "this line has more than twenty characters"


def brute_lines(rows, min_docs=3, min_chars=20):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    place = lambda i: (-1, 0) if i is None else (0, i)
    has = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                has[key(x)].add(place(i))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(has[key(x)]) < min_docs or place(i) == max(has[key(x)])]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_corpus():
    r = random.Random(3)
    pool = [f"{LINE} {k}" for k in range(12)] + ["short", "", "  ", "é" * 20, "É" * 20, "a" * 19, "b" * 20, "\x0bB" + "b" * 19 + "\t", "tail \r", " " + "c" * 19, LINE.upper() + " 1"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(8)))) for i in range(60)]
    rows += [(70, "\n".join([LINE] * 3000 + [f"own {k}" for k in range(3000)])), (71, LINE), (72, LINE + "\n"), (73, f" {LINE}\t")]  # a long text, and one that loses all
    rows += [(5, rows[5][1]), (5, rows[6][1]), (5, f"{LINE} 3"), (None, rows[7][1]), (None, f"{LINE} 1\n{LINE} 2"), (None, None), (80, None), (81, ""), (-4, f"{LINE} 1\nx")]
    return rows


def test_lines(spark):
    rows = line_corpus()
    out = lines.drop_repeated_lines(table(spark, rows))
    assert out.columns == [c.strip().split()[0] for c in SCHEMA.split(", ") if c != "n_lines string"] + ["n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr) == brute_lines(rows)
    assert any(n and t == "" for _, _, n, t in brute_lines(rows))
    got = lines.line_dedup_audit(table(spark, rows), min_docs=2, min_chars=3)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, a, b, sha(t)) for i, a, b, t in brute_lines(rows, 2, 3)), key=repr)


def test_lines_of_nothing(spark):
    assert lines.line_dedup_audit(table(spark, [])).count() == 0
    assert [tuple(r) for r in lines.line_dedup_audit(table(spark, [(None, None)])).collect()] == [(None, 1, 0, sha(""))]


def test_only_hashes_are_shuffled_by_line(spark):
    plan = lines._places(spark.createDataFrame([], "id long, text string, sig long"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- 12


@pytest.fixture(scope="module")
def pair():
    return align.Pair(open(align.DEFAULT_A, "rb").read(), open(align.DEFAULT_B, "rb").read())


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(align.DEFAULT_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.DEFAULT_B)


def token_texts():
    r = random.Random(2)
    usual = ["a", "é", "\n", " ", "th", "1", "'s", "日", "😀", "ing", " the", "end"]
    odd = [*usual, "▁", "́", "\x1f", "\x85", " ", "​", "　", " ", ".", "\xa0", "\t "]
    out = ["".join(r.choice(usual if k % 3 else odd) for _ in range(r.randrange(40))) for k in range(300)]
    out += ["", None, "▁x", "a ▁", "  two  spaces ", "<|endoftext|> <s> </s> <unk>", "\t x\n\n y\r\n z ", "x" * 3000, "<0x41> ", " ", "   ", "\x00 a\x01 b", "it's we'll   end", "the quick the quick", "the quick the quick"]
    return out + [" ".join(f"w{k % 50} walking" for k in range(3000))]


def brute_alignment(tokenizers, texts):
    """Whole texts token by token, with plain loops."""
    a, b = tokenizers
    alphabet = align.byte_alphabet()
    each, corpus = [], collections.Counter()
    for text in texts:
        ta = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text or "") for p in [b.id_to_piece(i)]]
        full = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in ta) != full or b"".join(x for _, x in tb) != full:
            each.append((0, 0, [], []))
            continue
        ends = []
        for tokens in (ta, tb):
            at = 0
            ends.append([])
            for i, x in tokens:
                ends[-1].append((at, at + len(x), i))
                at += len(x)
        links = []
        cuts = [0, *sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})]
        own = [{0: 0} | {e: k + 1 for k, (_, e, _) in enumerate(x)} for x in ends]
        groups = ["|".join(",".join(str(i) for _, _, i in side[at[lo] : at[hi]]) for side, at in zip(ends, own, strict=True)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        j = 0
        for s, e, i in ends[0]:
            while ends[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ends[1]) and ends[1][k][0] < e:
                links.append((i, ends[1][k][2]))
                k += 1
        corpus.update(links)
        each.append((len(ta), len(tb), groups, links))
    most = collections.Counter()
    for (_, i), n in corpus.items():
        most[i] = max(most[i], n)
    rows = [(na, nb, len(g), len(x), sum(corpus[p] == most[p[1]] for p in x), sum(corpus[p] for p in x), sha(";".join(g)) if g else "") for na, nb, g, x in each]
    return rows, corpus, most


@pytest.mark.parametrize("size", [16 << 20, 2000])
def test_alignment(spark, tokenizers, size, monkeypatch):
    monkeypatch.setattr(align, "BATCH_BYTES", size)
    texts = token_texts()
    ids = [None if k == 40 else 7 if k in (41, 42) else 1000 + k for k in range(len(texts))]
    docs = table(spark, list(zip(ids, texts, strict=True)))
    rows, corpus, most = brute_alignment(tokenizers, texts)
    out = align.alignment(docs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, *x) for i, x in zip(ids, rows, strict=True)), key=repr)
    assert sum(x[0] > 0 for x in rows) > 200
    if size > 2000:
        found = align.pair_counts(docs).collect()
        assert {((r.a_id, r.b_id), r["count"], r.best) for r in found} == {(p, n, n == most[p[1]]) for p, n in corpus.items()} and len(found) == len(corpus)


def test_alignment_of_nothing(spark):
    assert align.alignment(table(spark, [])).count() == 0
    assert sorted(tuple(r) for r in align.alignment(table(spark, [(1, None), (2, "")])).collect()) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_units_are_whole_texts_without_a_byte_level_vocabulary(pair):
    buf = np.frombuffer(b" ab cd ef", np.uint8)
    assert align.unit_starts(buf, np.array([0, 4, 9]), True).tolist() == [0, 4, 6]
    assert align.unit_starts(buf, np.array([0, 9]), True).tolist() == [0, 3, 6]
    assert align.unit_starts(buf, np.array([0, 9]), False).tolist() == [0]
    assert pair.by_units


# --- 13


def brute_runs(w):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def brute_audit(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = 1 if i is None else zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def run_texts():
    r = random.Random(4)
    out = []
    for _ in range(250):
        w = [f"w{r.randrange(r.choice([1, 2, 3, 60]))}" for _ in range(r.randrange(130))]
        for _ in range(r.randrange(6)):
            if len(w) > 5:
                a, p = r.randrange(len(w)), r.randrange(1, len(w) // 3 + 2)
                for k in range(a, r.randrange(a, len(w))):
                    w[k] = w[a + (k - a) % p]
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    return [*out, None, "", " \n", "Same same " * 30, "é ü " * 20, "one", "a b " * 6, "a " * 11, "a b c d e f " * 2, " ".join("ab"[k.bit_count() & 1] for k in range(512))]


def test_runs(spark):
    rows = [(k, t) for k, t in enumerate(run_texts())]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (3, rows[4][1])]
    out = repeats.run_audit(table(spark, rows))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((brute_audit(*x) for x in rows), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert sum(x[1] > 1 for x in want) > 15 and sum(x[1] > 0 for x in want) > 60
    shown = repeats.periodic_runs(table(spark, rows), collapsed_col="collapsed")
    assert shown.columns == [c.strip().split()[0] for c in SCHEMA.split(", ") if c != "runs string"] + ["runs", "collapsed"]
    for r in shown.collect():
        assert [tuple(x) for x in r.runs] == brute_runs(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert repeats.run_audit(table(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [1 << 18, 50])
def test_long_runs(chunk, monkeypatch):
    """Texts whose runs go on for thousands of words, beside each other."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    r = random.Random(9)
    texts = [[0] * 3000, [k % 7 for k in range(2000)], [r.randrange(2) for _ in range(600)], [k % 400 for k in range(1000)], list(range(500)), [], [1, 2] * 40 + [1, 2] * 3 + [5] + [1, 2] * 40]
    first = np.cumsum([0, *map(len, texts)])
    got = [[] for _ in texts]
    for t, *x in zip(*(v.tolist() for v in repeats.runs(np.array(sum(texts, [])), first)), strict=True):
        got[t].append(tuple(x))
    assert got == [brute_runs(t) for t in texts]


def test_runs_in_a_long_text():
    """More than one megabyte: one slice holds the text alone."""
    w = [f"word{k}" for k in range(150_000)]
    w[70_000:90_000] = [f"loop{k % 900}" for k in range(20_000)]
    x = repeats._Texts(pa.array([" ".join(w)], pa.large_string()))
    assert (x.start.tolist(), x.length.tolist(), x.period.tolist()) == ([70_000], [20_000], [900])
    assert x.collapsed()[0].decode().split() == w[:70_900] + w[90_000:]
