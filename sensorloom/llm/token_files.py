"""Token ids of documents in Simple-8b segments, in order of doc_id.

Documents are dealt out by ranges of doc_id and sorted; each task writes segments of about ``SEGMENT`` ids. Spark
writes the segments, one a row of a Parquet table that names its task and the ids before it there, so they can be
stored wherever Spark writes. Places in the whole sequence need only the sums of the tasks.

Null text: the end id alone. Null doc_id: first in order, kept as null. Repeated doc_ids stand in order of a hash
of their texts. A text is never cut, so a very long one makes a long segment. Empty table: no segments, empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kept, need, small
from .simple8b import pack_segment, unpack_segment
from .tokenise import default_path, encoder

SEGMENT = 1 << 17
#: Bytes of ids that a worker holds here, where it does little else: words that are met again fall out of half of it, and are encoded again.
HELD = 320 << 20
END = np.zeros(1, np.uint32).tobytes()
SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
#: Up to so many tasks' sums are broadcast.
TASKS = 200_000


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path, HELD), TaskContext.get().partitionId()
        ids, counts, data, held, before, seq = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(data), np.uint32)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "before": [before], "n_ids": [len(values)], "data": [pack_segment(ids, counts, values)]}, SEGMENTS)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = enc.encode_bytes(text) + END
                ids.append(doc)
                counts.append(len(got) // 4)
                data.append(got)
                held += counts[-1]
                if held >= SEGMENT:
                    yield segment()
                    before, seq = before + held, seq + 1
                    ids, counts, data, held = [], [], [], 0
        if ids:
            yield segment()

    return write


def write_token_files(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The table of segments (part, seq, before, n_ids, data), written to the shared folder."""
    need(docs, doc_id, text)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Null and repeated doc_ids are dealt out by their texts.
    rows = rows.withColumn("deal", F.xxhash64("text")).repartitionByRange(n, "doc_id", "deal").sortWithinPartitions("doc_id", "deal", "text").select("doc_id", "text")
    return kept(rows.mapInArrow(_writer(tokenizer or default_path()), "part int, seq long, before long, n_ids long, data binary"), "tokens", batch=128)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start, data in zip(batch["start"], batch["data"], strict=True):
            ids, counts, values = unpack_segment(data)
            ends = np.cumsum(counts.astype(np.int64))
            raw = memoryview(values.astype("<u4").tobytes())
            starts = ends - counts.astype(np.int64)
            yield pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"), "start": starts + start, "n_tokens": counts.astype(np.int64),
                "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
            })


def placed(segments: DataFrame) -> DataFrame:
    """(start, data): each segment and the number of ids before it."""
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    begin = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("begin"))
    return segments.select("part", "before", "data").join(small(begin, TASKS), "part").select((F.col("begin") + F.col("before")).alias("start"), "data")


def read_token_files(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the segments."""
    return placed(segments).mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
