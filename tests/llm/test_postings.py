"""What the steps of the text operators carry along with each word."""

import sensorloom.llm.decontaminate as D


def test_postings_hash_a_text_once(spark, monkeypatch):
    monkeypatch.setattr(D, "kept", lambda df, name: df)
    docs = spark.createDataFrame([(1, "One two, one"), (2, None), (None, "two")], "doc_id long, text string")
    words = spark.createDataFrame([("one",), ("two",)], "word string")
    got = D.token_postings(docs, words, doc_id="doc_id", text="text")
    assert sorted((r.word, r.doc_id or 0, r.pos) for r in got.collect()) == [("one", 1, 0), ("one", 1, 2), ("two", 0, 0), ("two", 1, 1)]
    keys = {r.doc_id: r.key for r in docs.select("doc_id", D.doc_key(docs.doc_id, docs.text).alias("key")).collect()}
    assert all(r.key == keys[r.doc_id] for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("xxhash64(")  # the plan's later lines run first: the key is there before the words are
