"""The corpus pipeline against a plain version of its stages, and the contract of its stages."""

from __future__ import annotations

import random

import pytest
from plain import clean, depleted, ids, leaks, secrets, shingles
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def done(spark):
    return P.run(spark, SF).collect()


def plainly(docs: list[tuple], items: list[tuple], similar: float = 0.8) -> dict[int, int]:
    """doc_id -> tokens of what is left of (doc_id, text, source) rows, by plain loops."""
    verdicts, texts = depleted([(s, t) for _, t, s in docs]), clean([(s, t) for _, t, s in docs])
    left = {d: t for (d, _, _), (_, kept), (_, t) in zip(docs, verdicts, texts, strict=True) if kept}
    names = sorted(left)
    up = {d: d for d in names}
    sets = {d: shingles(left[d]) for d in names}

    def root(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    for i, a in enumerate(names):
        for b in names[:i]:
            if len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    left = {d: left[d] for d in names if root(d) == d}
    left = {d: t for d, t in left.items() if not leaks(t, items)[1]}
    return {d: len(ids(redacted(t))) for d, t in left.items()}


def redacted(text: str) -> str:
    """Overlapping spans go as the first of them, and what reaches beyond it is left as it is in no case."""
    out, at = [], 0
    for a, _, b, _ in secrets(text):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def tokens(done) -> dict[int, int]:
    sizes: dict[int, int] = {}
    for r in done:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    return sizes


def test_run(spark, done):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = tokens(done)
    assert got == plainly(docs, items) and len(got) > 100


def test_planted(spark, tmp_path):
    """Template lines, near copies, benchmark passages and secrets, against the plain stages; clean documents stay."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9)))
    prose = lambda n=90: "\n".join(" ".join(word() for _ in range(10)) for _ in range(n // 10))
    template = [" ".join(word() for _ in range(8)) for _ in range(6)]
    bench = [(f"i{k}", " ".join(word() for _ in range(25))) for k in range(3)]
    docs = [(i, prose(), "a") for i in range(20)]
    docs += [(20 + i, "\n".join([*template, prose(), template[0]]), "b") for i in range(14)]
    docs += [(40 + i, "\n".join([*template * 6, prose(60)]), "b") for i in range(2)]  # depleted
    docs += [(50 + i, docs[i][1].replace(docs[i][1].split()[30], "changed", 1), "a") for i in range(6)]  # near copies
    docs += [(60, docs[3][1], "a"), (61, docs[3][1], "c")]
    docs += [(70 + k, prose(40) + "\n" + bench[k][1] + "\n" + prose(40), "c") for k in range(3)]
    docs += [(80, prose() + '\npassword = "hunter2hunter2" and ' + "0123456789abcdef" * 2 + "\n" + prose(), "d"), (90, None, None), (91, "", "a"), (92, "short", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"quality": F.lit(1), "leak": F.lit(2), "secrets": F.lit(3)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = tokens(P.run(spark, str(tmp_path)).collect())
    assert got == plainly(docs, bench)
    assert got.keys() == {*range(34), 80}


def test_odd_rows(spark):
    """Null and repeated doc_ids, repeated rows, null texts, and columns named like the stages' own."""
    text = lambda k: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(10)) for i in range(7))
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (None, text(3)), (None, text(4)), (None, None), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("source", "quality", "leak", "secrets", "key", "hash", "label", "fp")})
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert all(r.quality == r.leak == r.secrets == r.hash == "mine" for r in docs.collect())
    assert sorted(((r.doc_id or 0), r.text) for r in docs.collect()) == sorted([(1, text(1)), (1, text(2)), (0, text(3)), (0, text(4))])
    assert P.pack(spark, docs, SF).count() >= 4


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    assert [n for n, _ in P.STAGES] == ["quality", "dedup", "decontaminate", "secrets", "pack"]
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(P.__file__).parent
    for path in (root / "sensorloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
