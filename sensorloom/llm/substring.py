"""Exact substring de-duplication over words, by suffix automata of reference shards.

Method: words that stand in a window of ``size`` words which occurs earlier in the corpus are removed. The earlier
text is the reference. One automaton of all of it, broadcast in pieces and read by each document, would cost the
square of the corpus; so reference and documents are dealt by content instead of being broadcast. Each window
holds a smallest k-gram (its minimizer), and equal windows hold the same one at the same place. What stands around
a minimizer, up to ``size`` words to either side of it, is a passage; the passages of one minimizer are a
reference shard. A shard's automaton is built online in order of (document, place), and the matching statistic
of each word against all that came before gives the repeated windows; their union are the maximal spans.

Work is kept down: a minimizer that occurs once makes no passage, and a passage that equals an earlier one is repeated
as a whole and never gets to an automaton. Equal means equal hashes of 128 bits, 64 over the words and 64 over the
bytes; passages that differ in their white space alone are left to the automaton. Passages of frequent minimizers,
which a sample of the documents names, are reduced to the distinct ones before they are shuffled, and meet their
occurrences by salted joins, so no task holds all of a frequent phrase; the sample only decides which way a passage
takes, both give the same.

An automaton that outgrows ``SHARD`` words and minimizers with more than ``HOT`` different passages leave the method:
their windows are dealt out evenly and meet by hashes of 128 bits. The README says how often.

Null text: no words. Null doc_id: the row counts as a document that comes before all others. Repeated rows
(same doc_id and text) are one document and get equal results; rows of one doc_id with different texts get
a result each, from the places found in any of them. Texts of fewer words than a window are left. Extra columns
are ignored. Empty table: empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import kept, need, temporary

SIZE, GRAM = 20, 8
#: Words in a shard's automaton, beyond which windows are dealt out by their hashes.
SHARD = 100_000
#: Different passages of a minimizer, beyond which it makes no shard.
HOT = 2_000
#: The share of documents that are looked at for frequent minimizers, what share of their places makes one frequent, and how many at least.
SAMPLE, FREQUENT, LEAST = 0.01, 5_000, 16
SALTS = 32
#: What is known of a minimizer's place: the first of its passage, one that equals an earlier one, the first of a passage of a hot minimizer.
FIRST, AGAIN, SPREAD = 0, 1, 2
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
OUT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept_text string"


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a text that are hashed at once.
SLICE = 1 << 22


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(maxsize=1)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's and its inverse's powers, at least n of each; a worker keeps the longest table so far."""
    global _longest
    _longest = max(_longest, 1 << (n - 1).bit_length())
    return _power_table(_longest)


_longest = 1 << 16


def words_in(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of each word of a text in UTF-8; the hash depends on the word's bytes alone."""
    out = []
    at = 0
    while at < len(raw):
        part = np.frombuffer(raw, np.uint8, min(SLICE, len(raw) - at), at)
        end = len(part)
        if at + end < len(raw):  # cut between words, or take a longer part if there is none
            blanks = np.flatnonzero(SPACE[part])
            if len(blanks):
                end = int(blanks[-1]) + 1
            else:
                part = np.frombuffer(raw, np.uint8, len(raw) - at, at)
                blanks = np.flatnonzero(SPACE[part])
                end = int(blanks[0]) + 1 if len(blanks) else len(part)
        part = part[:end]
        edges = np.flatnonzero(np.diff(SPACE[part], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[: len(part)])))
        out.append((_mixed((sums[ends] - sums[starts]) * down[starts]), starts + at, ends + at))
        at += end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def word_hashes(raw: bytes) -> np.ndarray:
    return words_in(raw)[0]


def minimizers(text: str | None, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hash of the gram there, two hashes of the passage around it, by words and by bytes) of a text's minimizers."""
    raw = (text or "").encode()
    hashes, starts, ends = words_in(raw)
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3
    up, down = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])))
    grams = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    width = size - gram + 1
    at = np.unique(np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n - size + 1))
    a, b = np.maximum(0, at - (size - gram)), np.minimum(n, at + size)
    around = (sums[b] - sums[a]) * down[a] + ((at - a) * 64 + (b - at)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    digest = xxhash.xxh3_64_intdigest
    exact = np.array([digest(raw[x:y]) for x, y in zip(starts[a].tolist(), ends[b - 1].tolist(), strict=True)], np.uint64)
    return at, grams[at], _mixed(around), exact


FOUND = "m long, around long, exact long, key long, place long"


def _places(size: int, gram: int, frequent: np.ndarray, wanted: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(m, around, exact, key, place) of each minimizer that is among the frequent ones, or isn't. A passage that the same text
    has had before is known to be repeated: its row has place -1 - place and an m of its own, so that no text makes
    many rows of one minimizer."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["key"].tolist(), batch["text"], strict=True):
                at, grams, near, exact = minimizers(text, size, gram)
                first = np.zeros(len(at), bool)
                first[np.unique(near ^ (exact * np.uint64(BASE)), return_index=True)[1]] = True
                own = _mixed(at.astype(np.uint64) * np.uint64(BASE) + np.uint64(key % (1 << 64)))
                m = np.where(first, grams, own).view(np.int64)
                take = np.isin(m, frequent) == wanted if len(frequent) or wanted else slice(None)
                out.append((m[take], near.view(np.int64)[take], exact.view(np.int64)[take], np.full(len(at), key)[take], np.where(first, at, -1 - at)[take]))
            yield pd.DataFrame(dict(zip(("m", "around", "exact", "key", "place"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return find


def frequent_minimizers(rows: DataFrame, size: int, gram: int) -> np.ndarray:
    """Minimizers that make up a five-thousandth or more of the places in a sample of the documents: five thousand at most."""
    sample = rows.sample(SAMPLE, seed=42).mapInPandas(_places(size, gram, np.zeros(0, np.int64), False), FOUND)
    counts = kept(sample.groupBy("m").agg(F.count("*").alias("n")), "sampled", batch=256)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.array(sorted(r.m for r in counts.filter(F.col("n") >= max(LEAST, total / FREQUENT)).select("m").collect()), np.int64)


def _repeated(found: DataFrame, hot: int) -> DataFrame:
    """(key, code): 4 * place and what is known of it; firsts only where their minimizer has other passages too."""
    each = W.partitionBy("m")
    w = each.orderBy("around", "exact", "key", "place")
    before = F.lag(F.struct("around", "exact", "key", "place")).over(w)
    first = F.col("_before").isNull() | (F.col("_before.around") != F.col("around")) | (F.col("_before.exact") != F.col("exact"))
    rows = found.withColumn("_before", before).withColumn("_first", first).withColumn("_n", F.count_if("_first").over(each))
    same = (F.col("_before.key") == F.col("key")) & (F.col("_before.place") == F.col("place"))  # a repeated row
    code = (
        F.when(F.col("place") < 0, 4 * (-1 - F.col("place")) + AGAIN)
        .when(F.col("_first"), F.when(F.col("_n") > hot, 4 * F.col("place") + SPREAD).when(F.col("_n") > 1, 4 * F.col("place") + FIRST))
        .when(~same, 4 * F.col("place") + AGAIN)
    )
    return rows.select("key", code.alias("code")).filter(F.col("code").isNotNull())


def _repeated_frequent(found: DataFrame, hot: int) -> DataFrame:
    """The same for frequent minimizers: distinct passages come of partial aggregation and meet the occurrences by salted keys."""
    passages = kept(found.groupBy("m", "around", "exact").agg(F.min("key").alias("first")), "passages")
    numbers = passages.groupBy("m").agg(F.count("*").alias("n"))
    known = passages.join(numbers, "m").withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    met = found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(known, ["m", "around", "exact", "salt"])
    first = F.when(F.col("n") > hot, 4 * F.col("place") + SPREAD).when(F.col("n") > 1, 4 * F.col("place") + FIRST)
    code = F.when(F.col("key") == F.col("first"), first).otherwise(4 * F.col("place") + AGAIN)
    return met.select("key", code.alias("code")).filter(F.col("code").isNotNull())


def _passages(size: int, gram: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, codes in zip(batch["key"].tolist(), batch["text"], batch["codes"], strict=True):
                wanted = np.unique(codes[codes % 4 != AGAIN] // 4)
                if not len(wanted):
                    continue
                spread = set((codes[codes % 4 == SPREAD] // 4).tolist())
                words = text.encode().split()
                at, grams, *_ = minimizers(text, size, gram)
                keep = np.isin(at, wanted)
                for p, m in zip(at[keep].tolist(), grams[keep].view(np.int64).tolist(), strict=True):
                    a = max(0, p - size + gram)
                    hot = p in spread
                    rows.append((hash((key, p)) if hot else m, hot, key, a, b" ".join(words[a : p + size])))
            yield pd.DataFrame(rows, columns=["m", "hot", "key", "start", "words"])

    return cut


def _shards(size: int, shard: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Passages in order of (m, key, start). Gives the starts of repeated windows (high is null), or all windows'
    hashes of hot passages and where a shard has outgrown its bound."""

    def windows(key: int, start: int, words: list[bytes]) -> list[tuple]:
        out = []
        for i in range(len(words) - size + 1):
            h = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + size]))
            out.append((key, start + i, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
        return out

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, sam, held, n, barrier = None, None, [], 0, 0
        key, start, words, used = None, 0, [], 0  # the passage at hand and how much of it the automaton has
        rows: list[tuple] = []

        def read() -> None:
            """The automaton reads on in the passage at hand; windows that overlap it are only read once."""
            nonlocal used, n
            for i in range(used, len(words)):
                if sam.extend(words[i]) >= size and i + 1 >= size:
                    rows.append((key, start + i + 1 - size, None, None))
            n += len(words) - used
            used = len(words)

        for batch in batches:
            for m2, hot, key2, start2, text in zip(batch["m"].tolist(), batch["hot"].tolist(), batch["key"].tolist(), batch["start"].tolist(), batch["words"], strict=True):
                new = text.split(b" ")
                if hot:
                    rows += windows(key2, start2, new)
                    continue
                if m2 != m:
                    m, sam, held, n, barrier, key = m2, SuffixAutomaton(), [], 0, 0, None
                if sam is None:  # this shard has outgrown its bound
                    rows += windows(key2, start2, new)
                elif key2 == key and start2 <= start + len(words):
                    words += new[start + len(words) - start2 :]
                    held[-1] = (key, start, words)
                    read()
                else:
                    barrier += 1
                    sam.extend(barrier)  # a symbol of its own, so that nothing matches across passages
                    key, start, words, used = key2, start2, new, 0
                    held.append((key, start, words))
                    read()
                if sam is not None and n > shard:
                    for passage in held:
                        rows += windows(*passage)
                    sam, held = None, []
            yield pd.DataFrame(rows, columns=["key", "start", "high", "low"]).astype({"high": "Int64", "low": "Int64"})
            rows = []

    return match


def _removed(size: int, gram: int, with_text: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, codes, starts in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text"], batch["codes"], batch["starts"], strict=True):
                words = (text or "").encode().split()
                n = len(words)
                step = np.zeros(n + 1, np.int64)
                at = np.zeros(0, np.int64) if starts is None else np.asarray(starts, np.int64)
                at = at[at <= n - size]
                np.add.at(step, at, 1)
                np.add.at(step, at + size, -1)
                if codes is not None:  # all windows of a repeated passage: from its first word to its last
                    again = np.asarray(codes, np.int64)
                    again = again[again % 4 == AGAIN] // 4
                    again = again[again < n]
                    np.add.at(step, np.maximum(0, again - size + gram), 1)
                    np.add.at(step, np.minimum(n, again + size), -1)
                gone = np.cumsum(step)[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).tolist()
                left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if edges else b" ".join(words)
                spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                out.append((doc, n, spans, hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "spans", "kept_sha256", "kept_text"]).astype({"doc_id": "Int64"})

    return finish


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(text), F.lit(1 << 60)))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, shard: int = SHARD, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, kept_sha256, kept_text) of each row: the removed spans of words, and what is left, joined by one space."""
    need(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("key", _key(F.col("doc_id"), F.col("text")))
    with temporary(docs.sparkSession):
        keyed = rows.select("key", "text")
        frequent = frequent_minimizers(keyed, size, gram)
        codes = _repeated(keyed.mapInPandas(_places(size, gram, frequent, False), FOUND), hot)
        if len(frequent):
            often = kept(keyed.mapInPandas(_places(size, gram, frequent, True), FOUND), "frequent", batch=256)
            codes = codes.unionByName(_repeated_frequent(often, hot))
        codes = codes.groupBy("key").agg(F.collect_list("code").alias("codes")).withColumnRenamed("key", "_key")
        # Documents with a candidate are kept with their text; of the others all that is asked for is known here.
        joined = rows.join(codes, rows["key"] == codes["_key"], "left").select("doc_id", "key", "text", "codes")
        plain = joined.withColumn("starts", F.lit(None).cast("array<long>"))
        seen = kept(plain.mapInPandas(_first_look(size, gram, with_text), f"key long, text string, codes array<long>, {OUT}"), "seen", batch=256)
        some = seen.filter(F.col("codes").isNotNull())
        passages = some.select("key", "text", "codes").mapInPandas(_passages(size, gram), "m long, hot boolean, key long, start long, words binary")
        # Passages are short and many.
        matched = kept(passages.repartition("m").sortWithinPartitions("m", "key", "start").mapInPandas(_shards(size, shard), "key long, start long, high long, low long"), "matched", batch=1000)
        hashed = matched.filter(F.col("high").isNotNull())
        owners = hashed.groupBy("high", "low").agg(F.min(F.struct("key", "start")).alias("own")).select("high", "low", "own.key", "own.start")
        later = hashed.join(owners, ["high", "low", "key", "start"], "left_anti")
        starts = matched.filter(F.col("high").isNull()).select("key", "start").union(later.select("key", "start")).groupBy(F.col("key").alias("_key")).agg(F.collect_set("start").alias("starts"))
        done = some.join(starts, some["key"] == starts["_key"], "left").select("doc_id", "text", "codes", "starts").mapInPandas(_removed(size, gram, with_text), OUT)
        return kept(done.unionByName(seen.filter(F.col("codes").isNull()).select("doc_id", "n_words", "spans", "kept_sha256", "kept_text")), "removed", batch=256, keep=True)


def _first_look(size: int, gram: int, with_text: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    finish = _removed(size, gram, with_text)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = batch["codes"].notna()
            later = batch.loc[some, ["key", "text", "codes", "doc_id"]].astype({"doc_id": "Int64"})
            for c in ("n_words", "spans", "kept_sha256", "kept_text"):
                later[c] = pd.Series([None] * len(later), index=later.index, dtype="Int64" if c == "n_words" else object)
            if some.any():
                yield later
            if not some.all():
                rest = batch[~some]
                for done in finish(iter([rest])):
                    done.insert(0, "codes", pd.Series([None] * len(done), dtype=object))
                    done.insert(0, "text", pd.Series([None] * len(done), dtype=object))
                    done.insert(0, "key", rest["key"].to_numpy())
                    yield done

    return look
