"""The trie of conversations by their turns: which conversations share how long a beginning.

Names are given by prefix doubling. Distinct turns get dense numbers; in round k two neighbouring named blocks of 2^k
turns give, as a pair, a block of twice the length, and distinct pairs get dense numbers again. A prefix of d turns is then put together by the
binary digits of d, largest block first: it is the pair of a shorter prefix and one block, and rows with equal pairs are a node, named by its smallest
conversation. There are as many rounds as the longest conversation has binary digits, and each level has half the rows of the one
before. Sums over subtrees double as well: in round k a node passes its sum on to its ancestor 2^k above. Nothing looks at a whole
conversation, node or level in one task, and no step knows how long a conversation is or how many start alike.

Turns are in order of ``turn``, null first, equal turns in order of a hash of role and text. Null role or text: empty. Null conv_id: no conversation, such rows are left
out. Repeated rows: each is a turn. Empty table: no nodes, not even the root, as it has no smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import kept, need, temporary

#: Ids of a node's ends that are joined to one text before they are moved to be hashed.
PIECE = 4096


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, key, n_bytes): each turn's number from 0 and its conversation's length, a hash of role and text, the text's UTF-8 bytes. Written."""
    need(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes"))
    # Equal rows may be many; their places in the input tell them apart.
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    rows = numbered(rows, ["conv_id", F.col("turn").asc_nulls_first(), "key", "row"], "at")
    each = rows.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n_turns"))
    return kept(rows.join(each, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("place"), "n_turns", "key", "n_bytes"), "placed")


def branched(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations, as (turns, lengths): each takes its first h turns from the first conversation of its group, and its own turns after its first h.

    ``turns`` as from ``placed_turns``; h is the crc32 of the decimal conv_id modulo ``most``, and a group's first conversation is the
    conv_id less its remainder by ``group``.
    """
    conv = F.col("conv_id")
    own = turns.filter("place = 0").select("conv_id", "n_turns", (conv - conv % group).alias("from"), (F.crc32(conv.cast("string")) % most).alias("h"))
    source = own.select(F.col("conv_id").alias("from"), F.col("n_turns").alias("there"))
    info = own.join(source, "from", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "n_turns")
    info = kept(info.withColumn("length", F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))), "branches")
    after = turns.drop("n_turns").join(info, "conv_id").filter("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "length", "key", "n_bytes")
    # At most the first turns of a conversation are taken over, so each is written out for the members of its group.
    first = turns.filter((conv % group == 0) & (F.col("place") < most - 1)).withColumn("to", F.explode(F.sequence(conv - (group - 1), conv + (group - 1)))).filter(F.col("to") - F.col("to") % group == conv)
    before = first.select(F.col("to").alias("conv_id"), "place", "key", "n_bytes").join(info, "conv_id").filter("place < h").select("conv_id", "place", "length", "key", "n_bytes")
    rows = after.unionByName(before)
    return kept(rows.withColumn("ends", F.col("place") == F.col("length") - 1).drop("length"), "rebuilt"), info.select("conv_id", F.col("length").alias("n_turns"))


def dense(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds the number of the row's combination of ``by`` among the distinct ones. A frequent one is summed up before it moves, and joined back as one row."""
    names = numbered(rows.select(*by).distinct(), [], out)
    return rows.join(names, by).drop(*by)


def named_prefixes(turns: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(prefixes, nodes) of turns (conv_id, place, key, n_bytes, ends): prefixes are (conv_id, depth, node, ends), nodes are (node, depth, n_convs, n_bytes).

    A node is named by its smallest conversation; the root has depth 0 and no row here.
    """
    blocks = [kept(dense(turns, ["key"], "name"), "blocks")]
    while 2 ** len(blocks) <= longest:
        low = F.col("place") % 2 == 0
        last = lambda c: F.max(F.when(~low, F.col(c))).alias(c)
        pairs = blocks[-1].groupBy("conv_id", F.floor(F.col("place") / 2).alias("place")).agg(F.max(F.when(low, F.col("name"))).alias("a"), last("name"), last("n_bytes"), last("ends"))
        pairs = kept(pairs.filter("name IS NOT NULL").withColumnRenamed("name", "b"), "pairs")
        blocks.append(kept(dense(pairs, ["a", "b"], "name"), "blocks"))
    prefixes = nodes = None
    for k in reversed(range(len(blocks))):
        # Blocks of 2^k turns at even places end prefixes whose last binary digit is 2^k; what is before them was named in a round before, or is the root.
        at = F.col("place").cast("long")
        rows = blocks[k].filter(at % 2 == 0).select("conv_id", (at * 2**k).alias("before"), ((at + 1) * 2**k).alias("depth"), "name", "n_bytes", "ends")
        root = F.lit(None).cast("long").alias("up")
        if prefixes is None:
            rows = rows.withColumn("up", root)
        else:
            known = prefixes.select("conv_id", F.col("depth").alias("before"), F.col("node").alias("up"))
            rows = rows.join(known, ["conv_id", "before"], "left")
        rows = kept(rows.drop("before"), "composed")
        groups = kept(rows.groupBy("depth", "up", "name").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes")), "nodes", keep=True)
        same = groups.select(F.col("depth").alias("d"), F.col("up").alias("u"), F.col("name").alias("m"), "node")
        found = rows.join(same, (F.col("depth") == F.col("d")) & F.col("up").eqNullSafe(F.col("u")) & (F.col("name") == F.col("m"))).select("conv_id", "depth", "node", "ends")
        found = kept(found, "prefixes", keep=True)
        prefixes = found if prefixes is None else prefixes.unionByName(found)
        groups = groups.select("node", "depth", "n_convs", "n_bytes")
        nodes = groups if nodes is None else nodes.unionByName(groups)
    return prefixes, nodes


def subtree_sums(nodes: DataFrame, prefixes: DataFrame, root: Column, longest: int, columns: list[str]) -> DataFrame:
    """(node, depth, columns): each column summed over the node and all below it.

    After k rounds a sum reaches all that is less than 2^k below; then each node adds its sum to its ancestor 2^k above,
    which is the prefix of its own conversation of so many turns less.
    """
    sums, up = kept(nodes.select("node", "depth", *columns), "sums"), prefixes.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("node").alias("above"))
    step = 1
    while step <= longest:
        lower = sums.filter(F.col("depth") > step)
        given = lower.join(up, (F.col("node") == F.col("c")) & (F.col("depth") - step == F.col("d"))).select(F.col("above").alias("node"), F.col("d").alias("depth"), *columns)
        top = sums.filter(F.col("depth") == step).select(root.alias("node"), F.lit(0).cast("long").alias("depth"), *columns)
        both = sums.unionByName(given).unionByName(top)
        sums, step = kept(both.groupBy("node", "depth").agg(*[F.sum(c).alias(c) for c in columns]), "sums"), 2 * step
    return sums


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (node, depth, conv_id) to one row for up to ``PIECE`` neighbours of a node."""
    for rows in batches:
        part = (rows[["node", "depth"]] != rows[["node", "depth"]].shift()).any(axis=1).cumsum()
        each = rows.groupby([part, rows.groupby(part).cumcount() // PIECE])
        yield each.agg(node=("node", "first"), depth=("depth", "first"), first=("conv_id", "first"), ids=("conv_id", lambda s: ",".join(map(str, s)))).reset_index(drop=True)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces to one hash a node, carried on from batch to batch."""
    at, state = None, hashlib.sha256()
    for rows in batches:
        out = []
        for node, depth, ids in zip(rows["node"].tolist(), rows["depth"].tolist(), rows["ids"].tolist(), strict=True):
            if at == (node, depth):
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                out.append((*at, state.hexdigest()))
            at, state = (node, depth), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["node", "depth", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=["node", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the conversations (node, depth, conv_id) that end in a node, as one text of ascending ids.

    Ids are sorted in ranges and joined to pieces there; a node's pieces then stream through one hash, so no task holds a node's ids.
    """
    order = ["node", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_pieces, "node long, depth long, first long, ids string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "ids").mapInPandas(_digests, "node long, depth long, ends_sha256 string")


def trie_nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv_id, place, key, n_bytes, ends); ``lengths``: (conv_id, n_turns), of all conversations, turnless ones too. Both should be written tables. The result is a written table, and what is written on
    the way goes with the ``temporary`` that the caller has opened.
    saved_tokens: what a cache of prefixes saves below and at the node, in bytes of text. Members are the prefixes of ``named_prefixes``.
    """
    spark = turns.sparkSession
    whole = lengths.agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.max("n_turns").alias("longest")).first()
    longest = whole["longest"] or 0
    with temporary(spark):
        prefixes, nodes = named_prefixes(turns.select("conv_id", "place", "key", "n_bytes", "ends"), longest)
    root = F.lit(whole["first"]).cast("long")
    up = prefixes.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("node").alias("above"))
    deep = nodes.filter("depth > 1").join(up, (F.col("node") == F.col("c")) & (F.col("depth") - 1 == F.col("d"))).select("node", "depth", "n_convs", "n_bytes", F.col("above").alias("parent"))
    flat = nodes.filter("depth = 1").select("node", "depth", "n_convs", "n_bytes", root.alias("parent"))
    top = lengths.limit(1).select(root.alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(whole["n"]).alias("n_convs"), F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("parent"))
    linked = kept(deep.unionByName(flat).unionByName(top), "linked")
    children = linked.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = prefixes.filter("ends").select("node", "depth", "conv_id").unionByName(lengths.filter("n_turns = 0").select(root.alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    rows = linked.join(children, ["node", "depth"], "left").join(end_digests(ends), ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    rows = rows.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    rows = kept(rows, "linked")
    sums = subtree_sums(rows, prefixes, root, longest, ["n_leaves", "saved_tokens"])
    rows = rows.drop("n_leaves", "saved_tokens").join(sums, ["node", "depth"])
    names = [F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")]
    return kept(rows.select(*names), "trie", keep=True)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations as they are."""
    with temporary(conversations.sparkSession):
        turns = placed_turns(conversations)
        lengths = turns.filter("place = 0").select("conv_id", "n_turns")
        return trie_nodes(turns.withColumn("ends", F.col("place") == F.col("n_turns") - 1), lengths)


def branched_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations, whose beginnings are shared within groups of five."""
    with temporary(conversations.sparkSession):
        return trie_nodes(*branched(placed_turns(conversations)))
