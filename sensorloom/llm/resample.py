"""Importance resampling towards a target: documents whose word runs are frequent there are drawn more often.

Features are all runs of 1 to 3 words, hashed into buckets. Identical texts are collapsed by grouping the full text, so
features and weights are computed once a text; bucket counts multiply by the number of copies, and weights are joined
back before the noise that each document has for itself (Gumbel noise, so the highest scores are a draw without
replacement). The draw's ranks come from ranges of the score and their counts; no task sees all documents.

Null text: no words, weight 0. Null doc_id: its noise is that of the empty id; such rows are scored and ranked, last among equal scores. Repeated doc_ids: each
row for itself, with the same noise; ties go by a hash of the text. A very long text is cut into pieces of ``PIECE`` words
that carry their boundary on. No documents: empty result. No target: all gains compare with zero counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import batches_of, kept, need

#: Everything that is no word, and A-Z in lower case; UTF-8 bytes of characters beyond ASCII are all word bytes.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of a text that are held as features at once.
PIECE = 1 << 16
#: Rows of features that a Python worker gets at once.
READ = 500
FEATURES = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32()))])


def word_pieces(text: str) -> Iterator[list[bytes]]:
    """The words, at most about ``PIECE`` at once."""
    data, at = text.encode().translate(WORDS), 0
    while at < len(data):
        end = data.find(b" ", at + 4 * PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def run_hashes(text: str) -> Iterator[tuple[int, list[int]]]:
    """Pieces of (number of words, crc32 of each run of 1 to 3 words that ends in them); at least one piece."""
    crc, one, two, some = zlib.crc32, None, None, False
    for words in word_pieces(text):
        out = []
        for w in words:
            last, before, next_one = one, two, crc(w)
            out.append(next_one)
            two = None
            if last is not None:
                spaced = b" " + w
                two = crc(spaced, last)
                out.append(two)
                if before is not None:
                    out.append(crc(spaced, before))
            one = next_one
        some = True
        yield len(words), out
    if not some:
        yield 0, []


def _featuriser(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "copies")), strict=True):
                for n, hashes in run_hashes(text):
                    rows.append((key, copies, n, (np.array(hashes, np.int64) % buckets).astype(np.int32)))
                    if n >= PIECE // 8:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return features


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    key, copies, n, buckets = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, buckets)], dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(copies, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(buckets)))], schema=FEATURES)


def _counter(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            copies = np.repeat(batch.column("copies").to_numpy(), np.diff(lists.offsets.to_numpy()))
            total += np.bincount(lists.flatten().to_numpy(), copies, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    return count


def _weigher(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            sums = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy()])])
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            rows = {"key": batch.column("key"), "n_words": batch.column("n_words"), "n_features": pa.array(np.diff(ends).astype(np.int64)), "weight": pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64))}
            yield pa.RecordBatch.from_pydict(rows)

    return weigh


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def features(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, copies, n_words, buckets) of each distinct text, in one row or, if it is very long, several; a written table."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    rows = texts.select(text_key(F.col("text")).alias("key"), "text", "copies")
    return kept(rows.mapInArrow(_featuriser(buckets), "key binary, copies long, n_words long, buckets array<int>"), "features", batch=200)


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """The features in each bucket, copies included. What reaches the driver is one number a bucket, whatever the corpus."""
    sums = rows.select("copies", "buckets").mapInArrow(_counter(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    with batches_of(rows.sparkSession, READ):
        for r in sums.collect():
            out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over source share, both smoothed by one feature a bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; ``rank`` numbers those that are drawn from 1.

    Drawn are the given percentage of the rows with so many words, those with the highest scores.
    """
    need(docs, "doc_id", "text")
    need(target, "text")
    texts = features(docs, buckets)
    gains = bucket_gains(bucket_counts(texts, buckets), bucket_counts(features(target, buckets), buckets))
    weights = texts.select("key", "n_words", "buckets").mapInArrow(_weigher(gains), "key binary, n_words long, n_features long, weight long")
    weights = weights.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # A text's copies may be a third of all rows: what is joined to them is one row, and Spark splits such a partition of ids.
    rows = docs.select("doc_id", text_key(F.coalesce(F.col("text"), F.lit(""))).alias("key")).join(weights, "key")
    rows = kept(rows.withColumn("score", F.col("weight") + noise), "scores", batch=READ)
    most = rows.filter(F.col("n_words") >= least_words).count() * percent // 100
    enough = F.col("n_words") >= least_words
    ranked = numbered(rows, [F.when(enough, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key")], "place")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < most, F.col("place") + 1).alias("rank"))
