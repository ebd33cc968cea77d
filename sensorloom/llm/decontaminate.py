"""Benchmark decontamination by a positional inverted index.

Method: the training texts' postings (word, document, position) are stored once, for the words that the benchmark has;
no other word can be looked up. Each window of a benchmark item is looked up by its rarest words, by the stored
postings' counts over the whole corpus: their posting lists, shifted by the words' places in the window, are
intersected, and the starts that remain are compared with the whole window. A window with a word that the corpus
lacks is dropped before. The store serves counts, phrases and proximity; texts are split into words once.

A document's key in the store is a hash of its doc_id and text, so null and repeated doc_ids make no hot group; what
meets a text by an equal key is compared with the text itself. Windows come from the benchmark; what is broadcast of
it is counted first, and beyond the bound it is shuffled.

Null text: no words. Items without words have no window. Null doc_ids, repeated rows and repeated doc_ids: each row is
compared by its own text. Extra columns of either table are ignored; a column named as the result is replaced.
Empty tables: an empty result, or no hits. Ties between equally rare words are broken by the place in the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, free, kept, let, need, parts, small, squeezed

#: Words of windows, up to which their table is broadcast.
BROADCAST_WORDS = 200_000
#: Documents with a candidate, up to which their table is broadcast and no text moves.
BROADCAST_DOCS = 50_000
#: Words of a window whose lists are intersected; with two, half of a corpus of common words has a candidate.
RAREST = 3


def words_of(text: Column) -> Column:
    return parts(ascii_lower(squeezed(text)))


def item_windows(items: DataFrame, *, item_id: str, text: str, size: int) -> DataFrame:
    """(window_id, window, n, item_ids): distinct windows; an item of fewer words is one window."""
    words = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("words"))
    cut = let(
        F.col("words"),
        lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))
        .when(F.size(w) > 0, F.array(F.array_join(w, " ")))
        .otherwise(F.array().cast("array<string>")),
    )
    return (
        words.select("item_id", F.explode(F.array_distinct(cut)).alias("window"))
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        .select(F.xxhash64("window").alias("window_id"), "window", F.size(F.split("window", " ")).alias("n"), "item_ids")
    )


def doc_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def token_postings(docs: DataFrame, words: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """The stored postings (word, key, doc_id, pos) of the given words."""
    # Keys come before the words do: beside ``posexplode`` each word would carry its text, and hash it again.
    keyed = docs.select(doc_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokens = keyed.select("key", "doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return kept(tokens.join(small(words, BROADCAST_WORDS), "word", "left_semi").select("word", "key", "doc_id", "pos"), "postings")


def places_in(windows: DataFrame) -> DataFrame:
    return windows.select("window_id", "n", F.posexplode(F.split("window", " ")).alias("shift", "word"))


def rarest_words(windows: DataFrame, postings: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(word, shift, window_id, needed): the rarest words of each window that the corpus can hold, and their places."""
    counts = postings.groupBy("word").agg(F.count("*").alias("freq"))
    ranked = places_in(windows).join(counts, "word").withColumn("all", F.count("*").over(W.partitionBy("window_id"))).filter("all = n")
    order = W.partitionBy("window_id").orderBy("freq", "shift")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rarest).select("word", "shift", "window_id", F.least("n", F.lit(rarest)).alias("needed"))


def candidate_starts(postings: DataFrame, looked_up: DataFrame) -> DataFrame:
    """(key, window_id, start): where the shifted posting lists of all a window's rarest words meet."""
    lists = postings.join(small(looked_up, BROADCAST_WORDS), "word").select("key", "window_id", (F.col("pos") - F.col("shift")).alias("start"), "needed").filter("start >= 0")
    return lists.groupBy("key", "window_id", "start", "needed").agg(F.count("*").alias("n")).filter("n >= needed").select("key", "window_id", "start")


def indexed(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored windows, the stored postings of their words, and the rarest words of each window."""
    need(docs, doc_id, text)
    need(items, item_id, item_text)
    windows = kept(item_windows(items, item_id=item_id, text=item_text, size=size), "windows")
    words = kept(places_in(windows).select("word").distinct(), "vocabulary")
    postings = token_postings(docs, words, doc_id=doc_id, text=text)
    return windows, postings, kept(rarest_words(windows, postings), "rarest")


def phrase_matches(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, out: str = "hits") -> DataFrame:
    """The documents' columns, and a struct ``out``: n_words, and ``places`` (start, n, window_id, item_ids) of all exact windows."""
    windows, postings, looked_up = indexed(docs, items, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, size=size)
    key, have, found = (free(docs, c) for c in ("_key", "_have", "_found"))
    # A document's candidates meet by its key and are compared within its row.
    candidates = candidate_starts(postings, looked_up).join(small(windows, BROADCAST_WORDS // 10), "window_id")
    by_doc = candidates.groupBy(F.col("key").alias(have)).agg(F.collect_list(F.struct("start", "n", "window_id", "window", "item_ids")).alias(found))
    by_doc = small(kept(by_doc, "candidates"), BROADCAST_DOCS)
    rows = docs.withColumn(key, doc_key(F.col(doc_id), F.col(text))).join(by_doc, F.col(key) == F.col(have), "left")
    place = "array<struct<start:int,n:int,window_id:bigint,item_ids:array<string>>>"

    def exact(w: Column) -> Column:
        right = F.filter(F.col(found), lambda c: F.array_join(F.slice(w, c["start"] + 1, c["n"]), " ") == c["window"])
        shown = F.transform(right, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["window_id"].alias("window_id"), c["item_ids"].alias("item_ids")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.col(found).isNull(), F.array().cast(place)).otherwise(F.sort_array(F.array_distinct(shown))).alias("places"))

    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], let(words_of(F.col(text)), exact).alias(out))


def covered_words(places: Column) -> Column:
    """Words inside any of the places, which are in order of start."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(F.greatest(a["end"], p["start"] + p["n"]).alias("end"), (a["n"] + F.greatest(F.lit(0), p["start"] + p["n"] - F.greatest(a["end"], p["start"]))).alias("n")),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, *, out: str = "leak", **options) -> DataFrame:
    """The documents' columns and a struct ``out``: n_words, n_hit, item_ids (sorted as strings), contaminated."""
    hits = free(docs, "_hits")
    places = F.col(hits)["places"]
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda p: p["item_ids"]))))
    leak = F.struct(F.col(hits)["n_words"].alias("n_words"), covered_words(places).alias("n_hit"), ids.alias("item_ids"), (F.size(places) > 0).alias("contaminated"))
    found = phrase_matches(docs, items, out=hits, **options)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], leak.alias(out))


def proximity_matches(docs: DataFrame, items: DataFrame, *, slop: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """(doc_id, window_id): the two rarest words of a window stand at most ``slop`` words from their places in it.

    Starts are put into buckets of ``slop`` + 1; a list meets the other one's bucket and its neighbours, so no list
    is paired with all of another. Windows of one word match wherever the word stands.
    """
    windows, postings, _ = indexed(docs, items, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, size=size)
    rarest = rarest_words(windows, postings, 2)
    looked_up = rarest.withColumn("rank", F.row_number().over(W.partitionBy("window_id").orderBy("shift")))
    lists = postings.join(small(looked_up, BROADCAST_WORDS), "word").select("key", "doc_id", "window_id", (F.col("pos") - F.col("shift")).alias("start"), "rank", "needed")
    bucket = F.floor(F.col("start") / (slop + 1))
    one = lists.filter("rank = 1").withColumn("bucket", bucket)
    two = lists.filter("rank = 2").select("key", "window_id", F.col("start").alias("other"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = one.join(two, ["key", "window_id", "bucket"]).filter(F.abs(F.col("start") - F.col("other")) <= slop).select("doc_id", "window_id")
    return near.union(one.filter("needed = 1").select("doc_id", "window_id")).distinct()
