"""Packing of documents into sequences: first-fit decreasing in randomised groups.

A document's ids are cut at multiples of the sequence length; full pieces are sequences of their own. What is left
of each document is packed by first-fit decreasing: a tournament tree over the bins holds the largest room
below each node, so the first bin with enough room is found in steps that grow with the logarithm of their number.
Groups hold about ``GROUP`` pieces, dealt at random, and are packed each for itself; ids stay where they are, only
lengths are moved. The cut by length and the random groups do not depend on any key of the data.

Null or empty text: a document of the end id alone. Null or repeated doc_id and repeated rows: each row is a
document. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, need
from .tokenise import default_path, encoder

GROUP = 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items go by length, the longest first, equal ones in their order."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    tree = [room] * (2 * leaves)
    out = [(0, 0)] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, node = lengths[item], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[item] = (node - leaves, room - tree[node])
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return out


def _cutter(path: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = memoryview(enc.encode_bytes(text) + b"\0\0\0\0")
                n = len(data) // 4
                for a in range(0, n, size):
                    for column, value in zip(out, (doc, a, min(size, n - a), zlib.crc32(data[4 * a : 4 * (a + size)]), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def _packer(size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order"])
        placed = np.array(first_fit_decreasing(group["length"].tolist(), size), np.int64).reshape(-1, 2)
        return group.assign(doc_id=group["doc_id"].astype("Int64"), sequence_id=group["grp"].to_numpy() * (1 << 32) + placed[:, 0], offset=placed[:, 1]).drop(columns=["grp", "order"])

    return pack


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = 1024, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece."""
    need(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = kept(rows.mapInArrow(_cutter(tokenizer or default_path(), size), PIECE), "pieces", batch=128)
    full = pieces.filter(F.col("length") == size).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    # Row numbers of a written table are the same whenever a task runs again, so the deal is too.
    rest = pieces.filter(F.col("length") < size).withColumn("order", F.monotonically_increasing_id())
    groups = -(-max(1, rest.count()) // group)
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("order"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(_packer(size), PIECE + ", sequence_id long, offset long")
    return full.unionByName(packed)
