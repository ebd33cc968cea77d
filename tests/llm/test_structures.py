"""Prefix tries, Merkle trees and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pandas as pd
import pytest
from plain import words
from pyspark.sql import functions as F

from sensorloom.llm import prefix_trie as T
from sensorloom.llm import resample as R
from sensorloom.llm.merkle import PASSAGE, edited_fingerprints, edited_span, fingerprints, likeness, passages_of, tree, with_next_text
from sensorloom.llm.queries import op11_prefix_trie, op12_fingerprints, op13_resample

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --- tries -----------------------------------------------------------------------------------------------------


def turns_of(rows) -> dict[int, list[tuple[str, str]]]:
    out: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, sha(f"{len((r or '').encode())}:{r or ''}{x or ''}"), r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def trie(convs) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = set()
    for p, of in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in of if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.add((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), kids[p], sum(not kids[q] for q in below), saved, sha(",".join(map(str, ends)))))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def told(df) -> list[tuple]:
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = told(op11_prefix_trie(spark, SF))
    assert len(got) == len(set(got)) and set(got) == trie(rebuilt(turns_of(rows)))


def test_trie_edges(spark):
    """Nulls in each column, repeated and equal turns, negative ids, copies, a long conversation, ids that clash with the operator's columns."""
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "hé", "", None, "what"])) for c in [*range(-6, 14), 1 << 60] for t in range(rng.randint(1, 12))]
    rows += [(20, None, "user", "hi"), (20, 1, "user", "a"), (20, 1, "user", "a"), (20, 1, "bot", "a"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(30 + k, t, "user", f"same {t}") for k in range(12) for t in range(4)] + [(50, t, "bot", f"x{t % 3}") for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit("mine"), "key": F.lit(1), "name": F.lit(2)})
    convs = turns_of(rows)
    for got, want in ((T.prefix_trie(df), trie(convs)), (T.branched_trie(df), trie(rebuilt(convs)))):
        got = told(got)
        assert len(got) == len(set(got)) and set(got) == want
    assert T.branched_trie(df.limit(0)).count() == 0
    assert T.prefix_trie(df.filter("conv_id = 20")).columns == COLUMNS


def test_end_pieces(monkeypatch):
    """Ids of one node in several pieces and batches give the hash of one text."""
    monkeypatch.setattr(T, "PIECE", 3)
    rows = pd.DataFrame([(1, 0, c) for c in range(10)] + [(1, 2, 99)] + [(7, 2, c) for c in range(20, 25)], columns=["node", "depth", "conv_id"])
    for size in (1, 4, 16):
        pieces = pd.concat(T._pieces(iter([rows.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(rows), size)])), ignore_index=True)
        got = pd.concat(T._digests(iter([pieces.iloc[i : i + 2] for i in range(0, len(pieces), 2)])))
        want = {(1, 0): sha(",".join(map(str, range(10)))), (1, 2): sha("99"), (7, 2): sha(",".join(map(str, range(20, 25))))}
        assert {(r.node, r.depth): r.ends_sha256 for r in got.itertuples()} == want


# --- fingerprints ----------------------------------------------------------------------------------------------


def plain_tree(text: str | None):
    """(root, passages with their lengths), by loops."""
    import re

    lines = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    parts = [re.findall(PASSAGE, x) for x in lines]
    assert "".join(x for p in parts for x in p) == (text or "")
    hashes = [sha("".join(sha(x) for x in p)) for p in parts]
    sections, held = [], []
    for i, (line, h) in enumerate(zip(lines, hashes, strict=True)):
        held.append(h)
        if line == "\n" or h[0] in "01" or i == len(lines) - 1:
            sections.append(sha("".join(held)))
            held = []
    return sha("".join(sections)), [x for p in parts for x in p]


def plain_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = Counter(plain_tree(a)[1]), Counter(plain_tree(b)[1])
    return 2.0 * sum(n * len(t) for t, n in (x & y).items()) / (len(a) + len(b))


def plain_edits(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out[d] = (len(t), sha(e), plain_tree(t)[0], plain_tree(e)[0], plain_likeness(t, e), plain_likeness(t, after))
    return out


def test_fingerprint_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op12_fingerprints(spark, SF).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()}
    want = plain_edits(rows)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-12) if isinstance(want[d], float) else got[d] == want[d] for d in want)
    ahead = sum(v[4] > v[5] for v in got.values() if v[0] > 100)
    assert ahead > 0.95 * sum(v[0] > 100 for v in got.values()), "the half that stays is more like the text than the next text is"


LONG = "\n".join(f"Sentence {i} of many. And {i * i} more!" + ("\n" if i % 9 == 0 else "") for i in range(3000))
TEXTS = ["", "one", "a. b. c.", "a. b.\nc.\n\nd. e.\n", "\n\n\n", "a\n\nb\n\n\nc", "日本語。テキスト! é𝄞", "x" * 1000, "same. same. same.\nsame.", LONG, " \t. \n ?"]


def test_fingerprint_edges(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, ""), (1 << 50, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("tree", "_part", "_tie", "place", "_next", "lead")})
    got = {r.doc_id: r for r in edited_fingerprints(df).collect()}
    for d, want in plain_edits(rows).items():
        p = got[d].prints
        assert (p.n_chars, sha(p.edited), p.fingerprint, p.edited_fingerprint) == want[:4] and (p.near_edited, p.near_next) == pytest.approx(want[4:]), d
        assert got[d].tree == got[d]._next == "mine"
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (3, "c"), (3, "d")], "doc_id long, text string")
    assert edited_fingerprints(odd).count() == 5
    # Each row's text is once another row's next, whatever the ties.
    assert Counter(r.nxt for r in with_next_text(odd, "nxt").collect()) == Counter("abccd")
    assert edited_fingerprints(df.limit(0)).count() == 0 and edited_fingerprints(df.filter("doc_id = 3")).first().prints.near_next == 1.0


def test_next_texts_across_ranges(spark):
    rows = [(i * 7 % 1009, f"t{i * 7 % 1009}") for i in range(1, 1009)]
    order = sorted((d for d, _ in rows), reverse=True)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 2, 10, 5000):
        got = {r.doc_id: r.nxt for r in with_next_text(df, "nxt", rows=size).collect()}
        assert got == {d: f"t{order[(i + 1) % len(order)]}" for i, d in enumerate(order)}


def test_trees_locate_edits(spark):
    """The span that differing branches name holds the edit and not much else."""
    rng = random.Random(2)
    cases = [(TEXTS[3], TEXTS[3]), ("a. b. c.", "a. X. c."), ("", "new"), ("gone", ""), ("same. tail", "same. tail. more"), (LONG, LONG + "end."), (LONG, "start. " + LONG)]
    for _ in range(12):
        at = rng.randrange(len(LONG))
        cases.append((LONG, LONG[:at] + "###" + LONG[at + rng.randrange(3) :]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string").repartition(4)
    rows = df.select("i", "a", "b", F.struct(tree(F.col("a")).alias("x"), tree(F.col("b")).alias("y")).alias("t"))
    got = rows.select("i", edited_span(F.col("t.x"), F.col("t.y")).alias("s"), likeness(F.col("t.x"), F.col("t.y")).alias("l"), F.size(passages_of(F.col("t.y"))).alias("n")).collect()
    for r in got:
        a, b = cases[r.i]
        assert (r.s is None) == (a == b) and r.n == len(plain_tree(b)[1]) and r.l == pytest.approx(plain_likeness(a, b))
        if r.s:
            assert a.startswith(b[: r.s.start]) and a.endswith(b[r.s.end :]) and 0 <= r.s.start <= r.s.end <= len(b)
            if min(len(a), len(b)) > 1000:
                assert r.s.end - r.s.start < 300 and r.l > 0.98
    assert fingerprints(spark.createDataFrame([(1, None)], "i int, text string")).first().tree.n == 0


# --- resampling ------------------------------------------------------------------------------------------------


def features(text: str | None) -> tuple[int, list[int]]:
    w = words(text)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def drawn(docs, target) -> dict:
    own, other = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in other for b in f)
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    rows = []
    for (d, _), (n, f) in zip(docs, own, strict=True):
        h = int(sha(f"42:{d}")[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(enough[: 5 * len(enough) // 100]):
        r[5] = k + 1
    return {r[0]: tuple(r) for r in rows}


def test_resample_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in op13_resample(spark, SF).collect()}
    assert got == drawn(docs, target) and sum(r[5] is not None for r in got.values()) > 3


def test_resample_edges(spark, monkeypatch):
    """Copies, nulls, no words, letters beyond ASCII, a text in many pieces; pieces carry runs over their borders."""
    text = " ".join(f"w{i % 700} É{i}" for i in range(4000))
    docs = [(0, None), (1, ""), (2, "one"), (3, "one two"), (4, "A-b c_d É İ 9"), (5, text), *[(10 + i, "a copy of the same text " * 5) for i in range(40)], *[(100 + i, f"word{i} " * 25) for i in range(30)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("key", "copies", "weight", "rank", "score")})
    target = spark.createDataFrame([("word3 word3 copy",), (None,)], "text string")
    want = drawn(docs, ["word3 word3 copy", None])
    for piece in (1 << 16, 50):
        monkeypatch.setattr(R, "PIECE", piece)
        assert [len(x) > 1 for x in (list(R.run_hashes(text)),)] == [piece == 50]
        assert sorted(h for _, hs in R.run_hashes(text) for h in hs) == sorted(zlib.crc32(" ".join(w).encode()) for k in (1, 2, 3) for w in zip(*[words(text)[i:] for i in range(k)], strict=False))
    assert {r.doc_id: tuple(r) for r in R.resample(df, target).collect()} == want
    assert R.resample(df.limit(0), target).count() == 0
    assert R.resample(df, target.limit(0)).count() == len(docs)
    odd = spark.createDataFrame([(None, "a b " * 20), (7, "a b " * 20), (7, "c d e " * 20), (7, "c d e " * 20)], "doc_id long, text string")
    ranked = R.resample(odd, target, percent=100).collect()
    assert sorted(r.rank for r in ranked) == [1, 2, 3, 4] and len({r.weight for r in ranked}) == 2
