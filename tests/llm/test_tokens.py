"""Token files, packing, counts and the tokeniser against the library's own encoding."""

from __future__ import annotations

import random

import numpy as np
from plain import crc, ids
from pyspark.sql import functions as F

from sensorloom.llm.packing import first_fit_decreasing, pack_documents
from sensorloom.llm.queries import op3_token_counts, op5_token_files, op6_packing
from sensorloom.llm.simple8b import decode_blocks, encode_blocks, pack_segment, unpack_segment
from sensorloom.llm.token_count import SegmentTree, count_tokens, document_trees, edited_counts, leaves_of, packed, repeated_line_edits, unpacked
from sensorloom.llm.token_files import read_token_files, write_token_files
from sensorloom.llm.tokenise import Encoder, default_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a  b", "a\n\nb", "\nx y", " lead", "trail ", "tab\tx y", "a b c", "don't 'sx 12a b", "x\n 'll", "<|endoftext|> hi", "é\n\r b", "日本 語 12\n3", "a \nb", "w " * 20_000, "(ab) ab, ab.", "½ Ⅷ x²"]


def make(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"start": F.lit("clash"), "n": F.lit(1)})


def test_encoder_equals_the_library():
    e = Encoder(default_path(), most=64)  # so small that what is held is dropped again and again
    for t in ODD * 2:
        assert (e.encode(t) == ids(t)[:-1]).all(), t


def test_simple8b_round_trip():
    random.seed(1)
    for n in (0, 1, 5, 4095, 4096, 4097, 9000):
        for top in (1, 2, 300, 50257, 1 << 31, 1 << 63):
            v = np.array([random.randrange(top) if random.random() < 0.7 else random.randrange(min(top, 3)) for _ in range(n)], np.uint64)
            w, o = encode_blocks(v)
            assert (decode_blocks(w, o, n) == v).all()
            if n > 8192:
                assert (decode_blocks(w, o, n, 1, 2) == v[4096:8192]).all()
    docs, counts, values = unpack_segment(pack_segment([3, None], [2, 1], np.array([7, 8, 9])))
    assert (docs, counts.tolist(), values.tolist()) == ([3, None], [2, 1], [7, 8, 9])


def by_hand(rows):
    at, out = 0, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        v = ids(t)
        out.append((d, at, len(v), crc(v)))
        at += len(v)
    return out


def test_token_files(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op5_token_files(spark, SF).collect()) == by_hand(rows)


def test_token_file_edges(spark):
    rows = make(spark, ODD)
    assert sorted(tuple(r) for r in read_token_files(write_token_files(rows)).collect()) == by_hand(list(enumerate(ODD)))
    assert read_token_files(write_token_files(rows.limit(0))).count() == 0
    null = rows.limit(3).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = read_token_files(write_token_files(null.union(null))).collect()
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 2
    assert sorted(r.start for r in got) == np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()


def check_packing(got, rows, size=1024):
    text = dict(rows)
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == text.keys()
    for d, parts in pieces.items():
        v, at = ids(text[d]), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(v) and r.ids_crc32 == crc(v[at : at + r.length])
            at += r.length
        assert at == len(v)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size


def test_packing(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op6_packing(spark, SF).collect()
    check_packing(got, rows)
    assert sum(r.length for r in got) / (1024 * len({r.sequence_id for r in got})) > 0.95


def test_packing_edges(spark):
    check_packing(pack_documents(make(spark, ODD), group=5).collect(), list(enumerate(ODD)))
    rows = make(spark, ODD)
    assert pack_documents(rows.limit(0)).count() == 0
    twice = pack_documents(rows.union(rows).withColumn("doc_id", F.lit(None).cast("long"))).agg(F.sum("length"), F.count_distinct("sequence_id", "offset"), F.count("*")).first()
    assert twice[0] == 2 * sum(len(ids(t)) for t in ODD) and twice[1] == twice[2]


def test_first_fit_decreasing():
    random.seed(4)
    for n in (0, 1, 2, 7, 100):
        lengths = [random.randint(1, 50) for _ in range(n)]
        got = first_fit_decreasing(lengths, 50)
        room, want = [], [None] * n
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(50)
            want[i] = (k, 50 - room[k])
            room[k] -= lengths[i]
        assert got == want


def test_counts(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op3_token_counts(spark, SF).collect():
        new = text[r.doc_id]
        for a, b, x in reversed(repeated_line_edits(new)):
            new = new[:a] + x + new[b:]
        assert (r.n_tokens, r.n_tokens_after) == (len(ids(text[r.doc_id])) - 1, len(ids(new)) - 1)


def test_repeated_lines():
    assert repeated_line_edits("a\nb\na\n\n\na") == [(3, 5, ""), (7, 9, "")]


def test_edits_as_a_column(spark):
    rows = make(spark, ["one two three", None, "x"]).withColumn("edits", F.expr("CASE WHEN doc_id = 0 THEN array(named_struct('start', 4, 'end', 7, 'text', 'four five')) END"))
    got = {r.doc_id: r for r in count_tokens(rows).collect()}
    assert got[0].n_tokens_after == len(ids("one four five three")) - 1 and got[1].n_tokens == 0 and got[2].n_edits == 0
    assert count_tokens(rows.limit(0)).count() == 0


def test_segment_tree_equals_encoding_again():
    e = Encoder(default_path())
    random.seed(3)
    parts = ["a", " ", "  ", "\n", "'s", "'", "re", "12", "ll.", "\t", "é b", "", ""]
    texts = [t or "" for t in ODD if len(t or "") < 1000] + ["The cat's  toy \n\n isn't here. " * 8]
    for t in texts:
        for _ in range(15):
            k = random.randint(1, 4)
            cuts = sorted(random.randint(0, len(t)) for _ in range(2 * k))
            tree, new = SegmentTree.of(t, e), t
            for i in reversed(range(k)):
                a, b, x = cuts[2 * i], cuts[2 * i + 1], "".join(random.choice(parts) for _ in range(random.randint(0, 3)))
                new = new[:a] + x + new[b:]
                tree.edit(a, b, x)
                assert tree.text() == new and tree.total == len(e.encode(new)) and [p for k in range(tree.size) for p in tree.slot(k)] == e.split.findall(new)


def test_little_is_encoded_again():
    e = Encoder(default_path())
    tree = SegmentTree.of("some words here, and more of them. " * 500, e)
    tree.edit(9000, 9004, "new")
    assert tree.encoded < 20 < tree.size


def test_trees_are_loaded_and_not_encoded(spark):
    """Edits are counted from the stored leaves: another number there shows in the counts, and few words are encoded again."""
    text = "\n".join(f"line {i} with some words in it" for i in range(400)) + "\nline 7 with some words in it"
    trees = document_trees(make(spark, [text, "no edits", None]), edits=repeated_line_edits)
    by = {r.doc_id: r for r in trees.collect()}
    assert by[0].text == text and by[1].text is None
    leaves, chars = leaves_of(text, Encoder(default_path()))
    assert unpacked(by[0].tokens).tolist() == leaves and unpacked(by[0].chars).tolist() == chars and by[0].n_tokens == sum(leaves)
    got = {r.doc_id: r for r in edited_counts(trees).collect()}
    assert got[0].n_tokens_after == len(ids(text[: text.rindex("\n")])) - 1 and got[0].n_encoded_again < 20 < got[0].n_tokens
    assert (got[1].n_edits, got[1].n_tokens_after, got[2].n_tokens) == (0, by[1].n_tokens, 0)
    leaves[50] += 1000
    other = spark.createDataFrame([(0, sum(leaves), packed(leaves), by[0].chars, by[0].edits, text)], trees.schema)
    assert edited_counts(other).first().n_tokens_after == got[0].n_tokens_after + 1000


def test_what_is_held_is_bounded_in_bytes():
    e = Encoder(default_path(), most=1 << 16)
    for i in range(20_000):
        e.encode_bytes(f"word{i} {'x' * (i % 300)}{i} a{i}, (b{i})")
        assert e.words.held <= e.words.most + 400 and e.tokens.held <= e.tokens.most + 400 and e.pieces.held <= e.pieces.most + 400
    assert all(len(k) <= 48 for held in (e.words, e.tokens, e.pieces) for k in held)
