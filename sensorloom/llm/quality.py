"""Quality rules: line frequency across the documents of a host, and counts within a document.

Method: normalised lines are hashed, distinct documents are counted for each (host, line), lines in more than
``max_docs`` distinct documents of their host are removed, and a document that loses more than half of its words is
rejected as depleted.

* Documents of a host with the same set of normalised lines are copies and count once, so that a group of copies does
  not turn its own lines into boilerplate. Near copies count each.
* The limit is a number of documents and does not grow with the host. Sets of lines meet the frequent lines by (host,
  line), hot lines dealt out by salts, and texts meet their own set's frequent lines by the set; no list of a host's
  frequent lines is ever in one row.

Null text: no words (rejected as too short). Null host: a host of its own. Null or repeated doc_id, repeated
rows and extra columns: each row is judged by itself and comes back once; a column named as the result is replaced.
Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, free, kept, let, need, small

#: A frequent line of a hot host is met by so many tasks.
#: Sets of lines with a frequent one, up to which their table is broadcast and no text moves.
BROADCAST_SETS = 100_000
SALTS = 32


def normal_line(line: Column) -> Column:
    """A line in lower case with digits as 0 and white space as one space."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, BLANK, " ")), "[0-9]", "0"))


def line_key(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def word_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def words_of(text: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))
    return let(squeezed, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ", -1)))


def n_words_of(text: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(text, BLANK, " "))
    return let(squeezed, lambda s: F.when(s == "", F.lit(0)).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1))


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that the same text has twice or more."""

    def keys(w: Column) -> Column:
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, x, k: F.coalesce(x["h"] == F.get(p, k)["h"], F.lit(False))
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, k: same(p, x, k + 1) | same(p, x, k - 1)), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    return let(keys(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered)))


def measures(text: Column) -> Column:
    """The counts within a document."""
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(t, BLANK, "")
    return F.struct(
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(word_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
    )


def line_set(text: Column) -> Column:
    """The keys of a text's distinct normalised lines, in order."""
    return F.array_sort(F.array_distinct(F.transform(word_lines(text), line_key)))


def host_of(host: Column) -> Column:
    return F.coalesce(host.cast("string"), F.lit(""))


def set_id(host: Column, keys: Column) -> Column:
    return F.xxhash64(host, keys)


def frequent_lines(docs: DataFrame, *, text: str, host: str, max_docs: int) -> DataFrame:
    """(set_id, lines): the keys of the frequent lines in each distinct set of lines of a host that holds any."""
    # Copies meet here, on short rows of hashes; what stays is one row for each set of lines.
    sets = kept(docs.select(host_of(F.col(host)).alias("host"), line_set(F.col(text)).alias("keys")).distinct().withColumn("set_id", set_id(F.col("host"), F.col("keys"))), "lines")
    lines = sets.select("set_id", "host", F.explode("keys").alias("key"))
    often = lines.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select("host", "key")
    salted = often.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    met = lines.withColumn("salt", F.pmod("set_id", F.lit(SALTS))).join(salted, ["host", "key", "salt"])
    return kept(met.groupBy("set_id").agg(F.collect_list("key").alias("lines")), "often")


def quality_rules(
    docs: DataFrame, *, text: str = "text", host: str = "source", min_words: int = 50, max_repeat: float = 0.5, max_docs: int = 10, max_depleted: float = 0.5, out: str = "quality"
) -> DataFrame:
    """The input's columns and a struct ``out``: the counts, ``n_removed`` (words in removed lines), ``base_failed``, ``depleted``, ``kept`` and ``clean_text``."""
    need(docs, text, host)
    often = frequent_lines(docs, text=text, host=host, max_docs=max_docs)
    # The counts are taken before the join, so that texts only move where the cleaned text is asked for.
    m, key, have, lines = (free(docs, c) for c in ("_measures", "_set", "_set_id", "_lines"))
    # A text's lines with their words, as (key, words): all that counting removed words needs.
    sizes = F.transform(word_lines(F.col(text)), lambda x: F.struct(line_key(x).alias("key"), n_words_of(x).alias("n")))
    rows = docs.withColumn(m, F.struct(measures(F.col(text)).alias("m"), sizes.alias("sizes")))
    rows = rows.withColumn(key, set_id(host_of(F.col(host)), F.array_sort(F.array_distinct(F.transform(F.col(m)["sizes"], lambda x: x["key"])))))
    rows = rows.join(small(often, BROADCAST_SETS).withColumnsRenamed({"set_id": have, "lines": lines}), F.col(key) == F.col(have), "left")
    gone = let(F.col(lines), lambda o: F.filter(F.col(m)["sizes"], lambda x: F.array_contains(o, x["key"])))
    removed = F.when(F.col(lines).isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    clean = F.when(F.col(lines).isNull(), F.col(text)).otherwise(
        let(F.col(lines), lambda o: F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x: ~F.array_contains(o, line_key(x))), "\n"))
    )
    counts = F.col(m)["m"]
    n, repeat = counts["w"]["n_words"], counts["w"]["n_repeat_words"]
    failed = (n < min_words) | (100 * repeat > 100 * max_repeat * n)

    def verdict(gone: Column) -> Column:
        depleted = gone > max_depleted * n
        return F.struct(
            n.alias("n_words"), counts["word_chars"].alias("word_chars"), counts["n_symbols"].alias("n_symbols"), counts["n_dup_lines"].alias("n_dup_lines"), repeat.alias("n_repeat_words"),
            gone.alias("n_removed"), failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
        )

    judged = rows.withColumn(m, let(removed, verdict).withField("clean_text", clean))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], F.col(m).alias(out))
