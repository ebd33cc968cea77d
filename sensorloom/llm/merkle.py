"""Fingerprints of documents as Merkle trees: passages, paragraphs, sections, root.

Paragraphs are lines. A section ends with a blank line, or with a paragraph whose hash falls among one in eight, so it is found again after an edit
elsewhere. Passages are sentences, or at most ``LONGEST`` characters of one. A node's hash is the SHA-256 of its
children's, a passage's that of its text, so equal roots mean equal texts and an edit changes the branches above it and no others.
Likeness is twice the characters in equal passages over the characters of both texts; the first and last differing
branches of each level locate an edit. All of it is DataFrame functions.

Null text: empty, whose tree has no sections. Null doc_id: smallest. Repeated doc_ids stand in order of a hash of
their texts. Rows equal in both follow each other. A very long text: its tree is held in its row, about as large as the
text. One document: its next document is itself. Empty table: empty result. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import constants, free, kept, let, need, temporary

LONGEST = 200
#: Up to the end of a sentence, its marks and blanks included; a longer one is cut.
PASSAGE = rf"[^.!?]{{0,{LONGEST}}}[.!?]+[\x20\n]*|[^.!?]{{1,{LONGEST}}}"
#: First digits of the hash of a paragraph that ends a section.
ENDS = ("0", "1")
#: Documents in a range whose neighbours are found together, and the most ranges that there are.
RANGE, RANGES = 500, 100_000


def _above(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256)


def _length(children: Column) -> Column:
    return F.aggregate(children, F.lit(0), lambda n, c: n + c["n"])


def _node(children: Column) -> Column:
    return let(children, lambda c: F.struct(_above(c).alias("hash"), _length(c).alias("n"), c.alias("parts")))


def _sections(paragraphs: Column) -> Column:
    """Arrays of neighbouring paragraphs."""
    last = lambda p: (F.substring(p["hash"], 1, 1).isin(*ENDS)) | (p["n"] == 1) & p["blank"]
    ends = F.filter(F.transform(paragraphs, lambda p, i: F.when(last(p) | (i == F.size(paragraphs) - 1), i)), lambda i: i.isNotNull())
    return let(ends, lambda e: F.transform(e, lambda end, k: F.slice(paragraphs, F.coalesce(F.get(e, k - 1), F.lit(-1)) + 2, end - F.coalesce(F.get(e, k - 1), F.lit(-1)))))


def tree(text: Column) -> Column:
    """struct(hash, n, parts) of the root; its parts are sections, theirs paragraphs, theirs passages (hash, n). ``n``: code points."""
    passages = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PASSAGE), 0), lambda s: F.struct(F.sha2(s, 256).alias("hash"), F.length(s).alias("n")))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)", -1), lambda p: p != "")
    paragraph = lambda p: let(passages(p), lambda s: F.struct(_above(s).alias("hash"), _length(s).alias("n"), (p == "\n").alias("blank"), s.alias("parts")))
    return let(F.transform(lines, paragraph), lambda p: _node(F.transform(_sections(p), _node)))


def passages_of(node: Column) -> Column:
    """The leaves in order."""
    return F.flatten(F.transform(F.flatten(F.transform(node["parts"], lambda s: s["parts"])), lambda p: p["parts"]))


def shared_length(a: Column, b: Column) -> Column:
    """Code points in passages that both trees have, a repeated one as often as both have it."""
    side = lambda t, k: F.transform(passages_of(t), lambda x: F.struct(x["hash"].alias("hash"), F.lit(k).alias("side"), x["n"].alias("n")))

    def counted(s: Column) -> Column:
        """Equal passages of one side stand together; each such row of them with how many there are."""
        new = lambda x, i: (i == 0) | (x["hash"] != F.get(s, i - 1)["hash"]) | (x["side"] != F.get(s, i - 1)["side"])
        starts = F.filter(F.transform(s, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("x"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("times"))))

    def both(m: Column) -> Column:
        here = lambda x, k: F.when((x["x"]["side"] == 0) & (F.get(m, k + 1)["x"]["hash"] == x["x"]["hash"]), F.least(x["times"], F.get(m, k + 1)["times"]) * x["x"]["n"])
        return F.aggregate(F.transform(m, here), F.lit(0).cast("long"), lambda t, n: t + F.coalesce(n, F.lit(0)))

    return let(F.array_sort(F.concat(side(a, 0), side(b, 1))), lambda s: let(counted(s), both))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1; 1 for equal texts, and their passages are not looked at."""
    return F.when(a["hash"] == b["hash"], F.lit(1.0)).otherwise(2.0 * shared_length(a, b) / (a["n"] + b["n"]))


def _leading(a: Column, b: Column) -> Column:
    """How many children are equal from the first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["hash"] == y["hash"], F.lit(False)))
    return let(F.array_position(same, F.lit(False)), lambda k: F.when(k == 0, F.size(same)).otherwise(k - 1).cast("int"))


def _agreed(a: Column, b: Column, level: int, back: bool) -> Column:
    """Code points of the equal branches before the first differing one, or, backwards, behind the last."""
    turned = F.reverse if back else lambda x: x

    def inside(x: Column, y: Column, n: Column) -> Column:
        equal = F.aggregate(F.slice(x, 1, n), F.lit(0), lambda t, c: t + c["n"])
        if not level:
            return equal
        deeper = _agreed(F.get(x, n)["parts"], F.get(y, n)["parts"], level - 1, back)
        return equal + F.when((n < F.size(x)) & (n < F.size(y)), deeper).otherwise(F.lit(0))

    return let(turned(a), lambda x: let(turned(b), lambda y: let(_leading(x, y), lambda n: inside(x, y, n))))


def edited_span(a: Column, b: Column) -> Column:
    """struct(start, end): what lies between the first and the last differing passage of ``b``, in its code points; null for equal texts."""
    start, after = _agreed(a["parts"], b["parts"], 2, False), _agreed(a["parts"], b["parts"], 2, True)
    span = let(F.struct(start.alias("s"), after.alias("e")), lambda x: F.struct(x["s"].alias("start"), F.greatest(x["s"], b["n"] - x["e"]).alias("end")))
    return F.when(a["hash"] != b["hash"], span)


def with_next_text(docs: DataFrame, out: str, rows: int = RANGE) -> DataFrame:
    """Adds the text of the next document in descending doc_id; after the last comes the first. Texts are moved once.

    Rows are dealt out by ranges of doc_id, whose bounds are every so many ids; a range also gets the first text of the next one.
    """
    need(docs, "doc_id", "text")
    with temporary(docs.sparkSession):
        ids = kept(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "ids")
        step = max(rows, -(-ids.count() // RANGES))
        bounds = sorted(r["doc_id"] for r in numbered(ids, ["doc_id"], "place").filter(F.col("place") % step == 0).collect())
    limits = constants(bounds, "bigint") if bounds else F.array().cast("array<bigint>")
    # Every 300th bound first, then those between two of them.
    coarse, fine = (constants(bounds[::300], "bigint") if bounds else limits), 300
    part, tie, guest, first = (free(docs, c) for c in ("_part", "_tie", "_guest", "_first"))
    below = lambda some: F.size(F.filter(some, lambda b: b <= F.col("doc_id")))
    where = let(below(coarse), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * fine + below(F.slice(limits, F.greatest((k - 1) * fine, F.lit(0)) + 1, fine))))
    text = F.coalesce(F.col("text"), F.lit(""))
    dealt = docs.withColumn(part, F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(where)).withColumn(tie, F.xxhash64(text))
    heads = kept(dealt.groupBy(part).agg(F.max(F.struct("doc_id", tie)).alias(first)), "heads")
    # A row for each range: at most RANGES + 2 in all, whatever the table.
    around = W.orderBy(part)
    into = heads.select(F.col(part).alias("p"), F.col(first)["doc_id"].alias("i"), F.col(first)[tie].alias("t"), F.coalesce(F.lead(part).over(around), F.min(part).over(W.partitionBy())).alias("to"))
    heads_of = dealt.join(F.broadcast(into), (F.col(part) == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col(tie) == F.col("t"))).groupBy("to").agg(F.first(text).alias("text"))
    guests = heads_of.select(F.col("to").alias(part), F.col("text").alias(first))
    rows_in = dealt.withColumn(guest, F.lit(False)).withColumn(first, text)
    all_rows = rows_in.unionByName(guests.withColumn(guest, F.lit(True)), allowMissingColumns=True)
    order = W.partitionBy(part).orderBy(guest, F.col("doc_id").desc_nulls_last(), F.col(tie).desc())
    return all_rows.withColumn(out, F.lead(first).over(order)).filter(~F.col(guest)).select(*[F.col(f"`{c}`") for c in docs.columns], out)


def fingerprints(docs: DataFrame, out: str = "tree") -> DataFrame:
    """Adds each document's tree."""
    need(docs, "text")
    return docs.withColumn(out, tree(F.col("text")))


def edited_fingerprints(docs: DataFrame, out: str = "prints") -> DataFrame:
    """Adds a struct: n_chars, the edited text and its tree's root, the document's root, both likenesses, and where the edit is.

    The edit puts the beginning of the next document's text in the place of the second half.
    """
    following = free(docs, "_next")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_next_text(docs, following)
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.left(text, F.length(text) - half), F.left(F.col(following), half))
    one = F.struct(F.length(text).cast("long").alias("n_chars"), edited.alias("edited"))

    def printed(x: Column) -> Column:
        return let(tree(text), lambda a: let(tree(x["edited"]), lambda b: F.struct(
            x["n_chars"].alias("n_chars"), x["edited"].alias("edited"), a["hash"].alias("fingerprint"), b["hash"].alias("edited_fingerprint"),
            likeness(a, b).alias("near_edited"), likeness(a, tree(F.col(following))).alias("near_next"), edited_span(a, b).alias("edit"),
        )))

    return rows.withColumn(out, let(one, printed)).drop(following)
