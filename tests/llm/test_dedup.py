"""Near-duplicates and repeated passages against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from plain import groups, shingles, simhash, without_repeats
from pyspark.sql import functions as F

from sensorloom.llm import simhash as S
from sensorloom.llm.automaton import SuffixAutomaton
from sensorloom.llm.components import components
from sensorloom.llm.queries import op4_simhash, op7_substring_dedup
from sensorloom.llm.simhash import fingerprint, near_dedup, simhash_groups
from sensorloom.llm.substring import remove_repeats, word_hashes

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "one", "one two", "A b\tc", "É x ß " * 30, "w " * 5000]


def make(spark, texts, **more):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})


def test_fingerprints():
    for t in ODD:
        assert fingerprint(t) == simhash(t)


def test_positions_cover_every_five():
    from itertools import combinations

    assert len(S.POSITIONS) == 14
    for five in combinations(range(8), 5):
        assert sum(set(p) <= set(five) for p in S.POSITIONS) == 1


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, SF).collect()}
    want = groups(rows)
    assert got == {d: (f"{simhash(t):016x}", want[d]) for d, t in rows}


def test_simhash_edges(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = ODD + [base, base + " more", base.upper(), None, ""]
    rows = make(spark, texts, fp=1, label="clash", salt=2)
    got = {r.doc_id: r.component_id for r in simhash_groups(rows).collect()}
    assert got == groups(list(enumerate(texts)))
    twice = rows.union(rows.filter("doc_id = 8")).union(rows.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    assert simhash_groups(twice).count() == len(texts) + 2
    assert simhash_groups(rows.limit(0)).count() == 0
    stay = near_dedup(twice)
    assert stay.columns == rows.columns and {r.doc_id for r in stay.collect()} == {d for d, c in got.items() if d == c}


def test_posting_lists_are_exact():
    """The sublists of a posting list give the same groups as comparing all members."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 32, 40).astype(np.uint64)) for _ in range(6)] + [base]))
    got = S._members(x, [0, 1, 2, 3])
    want = S._groups(len(x), lambda i, others: np.bitwise_count(x[i] ^ x[others]) <= 3)
    same = lambda v: {tuple(np.flatnonzero(v == k)) for k in np.unique(v)}
    assert same(got) == same(want) and len(same(got)) < len(x)


def jaccard(a: str | None, b: str | None) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def stays(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str | None]]:
    """One row of each group by similarity: the smallest doc_id, null last, then the smallest text's hash."""
    rows = list(dict.fromkeys(rows))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                up[root(i)] = root(j)
    out = {}
    for i, r in enumerate(rows):
        order = (r[0] is None, r[0] or 0)
        if root(i) not in out or order < out[root(i)][0]:
            out[root(i)] = (order, r)
    return [r for _, r in out.values()]


def words(tag: str, n: int = 80) -> str:
    return " ".join(f"{tag}{i * i % 97}{tag}{i}" for i in range(n))


@pytest.mark.parametrize(
    "rows",
    [
        [(3, "B"), (7, "A"), (7, "B"), (9, "A")],
        [(3, "B"), (None, "B"), (None, "C")],
        [(None, "A"), (None, "A"), (None, "B")],
        [(5, "A"), (5, "A"), (5, "B"), (2, "B"), (None, None), (4, "")],
        [(1, "A"), (1, "B"), (1, "C"), (0, "C")],
    ],
)
def test_rows_of_one_doc_id_go_each_for_itself(spark, rows):
    """No text without a near-duplicate is lost, whatever doc_ids it shares with others."""
    text = {"A": words("a"), "B": words("b"), "C": words("c"), None: None, "": ""}
    rows = [(d, text[t]) for d, t in rows]
    got = [(r.doc_id, r.text) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, stays(rows)))
    assert {t or "" for _, t in got} == {t or "" for _, t in rows}


def test_similar_texts(spark):
    """Pairs at a similarity of 0.8 or more go, all others stay."""
    base, rows, pairs = words("w", 200).split(), [], []
    for k in range(40):
        own = [f"{x}q{k}" for x in base]
        other = list(own)
        for i in range(k % 8):
            other[13 + 23 * i] = f"changed{k}x{i}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        pairs.append((2 * k, 2 * k + 1, jaccard(rows[-2][1], rows[-1][1])))
    got = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(j for *_, j in pairs) < 0.72 and max(j for *_, j in pairs) == 1.0
    assert all(a in got for a, _, _ in pairs)
    assert all((b in got) == (j < 0.8) for _, b, j in pairs) and any(0.75 < j < 0.8 for *_, j in pairs) and any(0.8 <= j < 0.85 for *_, j in pairs)


def test_a_large_group_of_near_copies(spark):
    base = words("n", 150).split()
    rows = [(i, " ".join(base[: i % 140] + [f"own{i}"] + base[i % 140 + 1 :])) for i in range(600)] + [(600 + i, words(f"x{i}y")) for i in range(50)]
    got = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, *range(600, 650)}


def test_near_dedup_against_all_pairs(spark):
    """On the largest of the tables: each pair of texts at 0.8 is found, and no text goes without one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r.doc_id for r in near_dedup(docs).select("doc_id").collect()}
    sets, up, holders = {}, {}, {}
    for r in docs.collect():
        key = S.shingle_hashes(r.text)
        up[r.doc_id] = sets.setdefault(key.tobytes(), (r.doc_id, key))[0]
    distinct = dict(sets.values())
    for d, key in distinct.items():
        for h in key.tolist():
            holders.setdefault(h, []).append(d)
    shared: dict[tuple[int, int], int] = {}
    for some in holders.values():
        for i, a in enumerate(some):
            for b in some[:i]:
                shared[b, a] = shared.get((b, a), 0) + 1

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    found = 0
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(distinct[a]) + len(distinct[b]) - n):
            found += 1
            up[max(root(a), root(b))] = min(root(a), root(b))
    assert found > 40 and got == {d for d in up if root(d) == d}


def test_uncertain_links_take_a_second_round(spark):
    """More uncertain links than the first round gives, of which the true ones are the less likely by bytes: none is lost."""
    base = words("u", 120).split()
    rows = [(i, " ".join([x if (j + i) % 11 else f"y{i}z{j}" for j, x in enumerate(base)])) for i in range(12)]
    rows += [(100 + i, " ".join([*base[: 100 - i], *[f"own{i}x{j}" for j in range(4)]])) for i in range(30)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in stays(rows))


def test_long_posting_lists(monkeypatch):
    """A list beyond the bound is read in parts and still links all that links."""
    monkeypatch.setattr(S, "LIST", 16)
    base = words("p", 150).split()
    texts = [" ".join(base[: i % 140] + [f"own{i}"] + base[i % 140 + 1 :]) for i in range(100)]
    marks = next(S._marks(iter([pd.DataFrame({"id": range(100), "unnamed": False, "hash": range(100), "text": texts})])))
    keys = S._own_keys(np.frombuffer(b"".join(marks["wide"]), np.uint8).reshape(-1, S.WIDE_BYTES))
    rows = pd.concat([pd.DataFrame({"key": k * 1000 + np.unique(keys[:, k], return_inverse=True)[1], "first": k, "second": -1, "node": marks["node"], "label": marks["node"], "wide": marks["wide"]}) for k in range(S.WIDE_KEYS)])
    rows = rows.sort_values("key", kind="stable", ignore_index=True)
    for size in (7, 100, 5000):
        links = pd.concat(S._links(4)(iter([rows.iloc[i : i + size] for i in range(0, len(rows), size)])))
        assert len(links) < 10 * len(texts), "a pair is looked at in one list"
        reached, todo = set(), [rows["node"].iat[0]]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += links.loc[links["u"] == x, "v"].tolist() + links.loc[links["v"] == x, "u"].tolist()
        assert len(reached) == 100


def test_pairs_of_a_long_list_meet_once(spark, monkeypatch):
    """Members that share one set of positions and no other, in a list beyond the bound: each pair is still looked at, once."""
    monkeypatch.setattr(S, "LIST", 16)
    wide = np.tile(np.random.default_rng(3).integers(0, 256, S.WIDE_BYTES, np.uint8), (100, 1))
    for k in range(1, S.WIDE_KEYS):
        wide[:, k * S.WIDE_KEY] = np.arange(100) + k
    nodes = spark.createDataFrame([(i, bytes(x)) for i, x in enumerate(wide)], "node long, wide binary")
    lists = S._wide_lists(nodes).join(nodes, "node").withColumn("label", F.col("node")).toPandas().sort_values("key", kind="stable", ignore_index=True)
    assert lists.groupby("key").size().max() < 100
    links = S._links(None)(iter([lists[["key", "first", "second", "node", "label", "wide"]]]))
    pairs = sorted((min(u, v), max(u, v)) for x in links for u, v in zip(x["u"], x["v"], strict=True))
    assert pairs == [(i, j) for i in range(100) for j in range(i + 1, 100)]


def test_near_copies_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST", 40)
    base, other = words("n", 150).split(), words("m", 150).split()
    rows = [(i, " ".join([f"own{i}" if j == i % 140 else x for j, x in enumerate(base)])) for i in range(200)]
    rows += [(1000 + i, " ".join([f"own{i}x{j}" if j % 12 == i % 12 and j < 60 + i else x for j, x in enumerate(other)])) for i in range(60)]
    got = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == sorted(d for d, _ in stays(rows))


def test_lists_with_company():
    """However rows are cut into batches, lists of one go and others are whole."""
    keys = [1, 2, 2, 3, 4, 4, 4, 4, 5, 6, 6]
    rows = pd.DataFrame({"key": keys, "first": 0, "node": range(len(keys))})
    for size in (1, 2, 3, 11):
        got = pd.concat(S._met(iter([rows.iloc[i : i + size] for i in range(0, len(rows), size)])))
        assert got["node"].tolist() == [i for i, k in enumerate(keys) if keys.count(k) > 1]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(10, 60)] + [(100, 101), (5, 5), (101, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 100: 100, 101: 100, 200: 100}


def test_automaton_matching_statistics():
    random.seed(2)
    for _ in range(200):
        s = [random.choice("ab" if random.random() < 0.7 else "abc") for _ in range(40)]
        sam = SuffixAutomaton()
        for i, c in enumerate(s):
            got = sam.extend(c)
            want = max(k for k in range(i + 2) if k == 0 or any(s[j - k + 1 : j + 1] == s[i - k + 1 : i + 1] for j in range(k - 1, i)))
            assert got == want


def test_repeat_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op7_substring_dedup(spark, SF).collect()}
    assert got == without_repeats(rows)


@pytest.mark.parametrize(("size", "gram", "shard", "hot"), [(20, 8, 100_000, 2000), (20, 8, 80, 2000), (12, 5, 200, 4)])
def test_repeats_in_repetitive_texts(spark, size, gram, shard, hot):
    random.seed(size + shard)
    base = [" ".join(random.choice("ab c d".split()) for _ in range(random.randint(0, 90))) for _ in range(30)]

    def text() -> str:
        t = random.choice(base).split()
        for _ in range(random.randint(0, 3)):
            if t:
                t[random.randrange(len(t))] = random.choice("a b c x".split())
        return " ".join((t + random.choice(base).split()) * random.choice([1, 1, 2]))

    texts = [text() if i % 13 else None for i in range(150)]
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept_sha256) for r in remove_repeats(make(spark, texts), size=size, gram=gram, shard=shard, hot=hot).collect()}
    assert got == without_repeats(list(enumerate(texts)), size)


def test_frequent_phrases(spark, monkeypatch):
    """Passages of frequent minimizers take another way to the same result, and are dealt out over many tasks."""
    from sensorloom.llm import substring

    random.seed(5)
    phrase = " ".join(f"common{i}" for i in range(40))
    texts = [f"{words(f'a{i}b', 30)} {phrase if i % 3 else phrase.replace('common30', 'x')} {words(f'c{i}d', i % 40)}" for i in range(300)] + [phrase, "", None]
    monkeypatch.setattr(substring, "SAMPLE", 0.5)
    rows = make(spark, texts).repartition(6)
    keyed = rows.select(F.col("doc_id").alias("key"), "text")
    assert 3 < len(substring.frequent_minimizers(keyed, 20, 8)) < 40
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept_sha256) for r in remove_repeats(rows.union(rows.filter("doc_id < 5"))).collect()}
    assert got == without_repeats(list(enumerate(texts)))


def test_a_phrase_in_a_million_places_is_dealt_out(spark):
    """The occurrences of one passage are in many tasks where they meet it."""
    from sensorloom.llm.substring import FOUND, _repeated_frequent

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = spark.range(1_000_000).select(F.lit(7).cast("long").alias("m"), F.lit(8).cast("long").alias("around"), F.lit(9).cast("long").alias("exact"), F.col("id").alias("key"), F.lit(3).cast("long").alias("place"))
        assert found.columns == [c.split()[0] for c in FOUND.split(", ")]
        codes = _repeated_frequent(found.hint("merge"), 2000)
        assert codes.count() == 999_999 and codes.select(F.spark_partition_id().alias('p')).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_repeat_edges(spark):
    long = " ".join(f"v{i}" for i in range(60))
    texts = [*ODD, long, "x " + long, long, long.upper(), " ".join(long.split()[:20])]
    rows = make(spark, texts, key=1, codes="clash", m=2)
    got = {r.doc_id: r for r in remove_repeats(rows, with_text=True).collect()}
    want = without_repeats(list(enumerate(texts)))
    assert {d: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept_sha256) for d, r in got.items()} == want
    assert got[9].kept_text == "x" and [(s.start, s.end) for s in got[9].spans] == [(1, 61)]
    again = remove_repeats(rows.union(rows)).collect()
    assert len(again) == 2 * len(texts) and {(r.doc_id, r.kept_sha256) for r in again} == {(d, w[2]) for d, w in want.items()}
    first = rows.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.doc_id: len(r.spans) for r in remove_repeats(first.union(rows.filter("doc_id in (9, 10)"))).collect()} == {None: 0, 9: 1, 10: 1}
    assert remove_repeats(rows.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from sensorloom.llm import substring

    raw = " ".join(["alpha", "beta", "é" * 40, "x" * 300, "beta", "alpha"] * 20).encode()
    whole = word_hashes(raw)
    monkeypatch.setattr(substring, "SLICE", 64)
    assert (word_hashes(raw) == whole).all() and len(whole) == len(raw.split()) and len(set(whole.tolist())) == 4
