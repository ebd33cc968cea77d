"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Method: a fingerprint of 64 bits has 8 positional bytes. Two that differ in 3 bits or fewer share at least 5 of
them (the guaranteed minimum). Postings of single bytes would pair a share of the corpus with each document, so
the index is keyed by four positions at once: 14 sets of four positions such that any five positions contain
exactly one of them (the planes of the cube of side two). Within a posting list members meet by one more of the other
positions, are tallied by their shared positional bytes, and those with five or more are verified by their bits.

Equal fingerprints meet first and are indexed once, so copies make no pairs. A posting list is turned into the
links of a star for each group of it; no pairs are listed. Fingerprints that link are joined to components on the
cluster.

``near_dedup`` keeps one row of each group of texts whose five-word shingles have a similarity of 0.8 or more. At that similarity
SimHash signs differ in ten of 64 bits and share one or two bytes, which no count of shared bytes tells from chance; besides
operator 4's groups it therefore takes candidates from the same index over fingerprints whose positional bytes come from
min-wise hashing (one byte of each of 128 minima), which agree as often as the shingle sets overlap. A pair at 0.8 meets in
one of 25 keys of five bytes with a chance of 0.99995; the tally of shared bytes retains it from 0.7 on. Every link is then
verified by the exact similarity of the two texts, and nothing else makes two rows one group.

Null text: no words, fingerprint zero, linked like any other. Null doc_id: the row comes back, its
component is the smallest other doc_id reachable, or null. Repeated rows come back as often as they are there.
Extra columns are ignored. Empty table: empty result. Very long texts: shingles are summed in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, kept, need, small, temporary
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Any five of the eight positions hold exactly one of these sets of four.
POSITIONS = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
SHARED = 5
SALTS = 8
#: Five-word shingles; positional bytes from min-wise hashing; sets of positions that key the index; the least similarity.
WIDE_SHINGLE, WIDE_BYTES, WIDE_KEYS, WIDE_KEY, SIMILARITY = 5, 128, 25, 5, 0.8
#: By equal bytes (standard error 0.035 at 0.8): from the first on a pair surely links, below the second it does not; all between, and all that link, are verified exactly.
SURE, UNSURE = 0.9, 0.7
#: Uncertain links that a member of a posting list gives in the first round; a longer list is cut into parts; links verified by one task with one text.
MAYBE, LIST, DEGREE = 1, 4096, 1000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the shingles of the words in lower case (A-Z), as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], np.uint64).astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = np.array([fingerprint(x) for x in batch["text"]], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fps})


def _groups(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The smallest index of each one's group; ``near`` says which of the given others link to one."""
    label = np.arange(n)
    rest = np.arange(n)
    while len(rest) > 1:
        seed, queue = rest[0], [rest[0]]
        rest = rest[1:]
        while queue and len(rest):
            linked = near(queue.pop(), rest)
            label[rest[linked]] = seed
            queue += rest[linked].tolist()
            rest = rest[~linked]
    return label


def _members(x: np.ndarray, free: list[int]) -> np.ndarray:
    """For distinct fingerprints of one posting list: the smallest index of each one's group. ``free``: the positions outside the key.

    Those that share five bytes share one outside the key, so they meet in the sublist of one more position."""
    octets = x.view(np.uint8).reshape(-1, 8)
    up = np.arange(len(x))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for p in free:
        order = np.argsort(octets[:, p], kind="stable")
        cuts = np.flatnonzero(np.diff(octets[order, p])) + 1
        for sub in np.split(order, cuts):
            if len(sub) < 2:
                continue

            def near(i: int, others: np.ndarray, sub: np.ndarray = sub) -> np.ndarray:
                apart = x[sub[i]] ^ x[sub[others]]
                shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                return (shared >= SHARED) & (np.bitwise_count(apart) <= BITS)

            label = _groups(len(sub), near)
            for i in np.flatnonzero(label != np.arange(len(sub))).tolist():
                a, b = root(int(sub[i])), root(int(sub[label[i]]))
                up[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(x))])


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key; a list may span batches. Gives (u, v): the first member of a group, and another member."""
    free = [[p for p in range(8) if p not in four] for four in POSITIONS]
    last, held = None, []

    def links(key: int, fps: list[np.ndarray]) -> pd.DataFrame:
        x = np.unique(np.concatenate(fps)).view(np.uint64)
        label = _members(x, free[key >> 32])
        at = np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame({"u": x[label[at]].view(np.int64), "v": x[at].view(np.int64)})

    for batch in batches:
        keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        # Only runs of two or more, and those at the edges of the batch, need a look.
        look = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
        for a, b in zip(starts[look].tolist(), ends[look].tolist(), strict=True):
            if keys[a] != last:
                if sum(map(len, held)) > 1:
                    yield links(int(last), held)
                last, held = keys[a], []
            held.append(fps[a:b])
    if sum(map(len, held)) > 1:
        yield links(int(last), held)


def _keys(fp: Column) -> Column:
    """A key for each set of positions: its number above the four bytes."""
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))
    return F.array(*[sum((F.shiftleft(byte(p), 8 * k) for k, p in enumerate(four)), F.lit(i << 32).cast("long")) for i, four in enumerate(POSITIONS)])


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """(u, v): links enough to reach from each of the distinct fingerprints ``fp`` all that it links to."""
    postings = fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    return postings.repartition("key").sortWithinPartitions("key").mapInPandas(_stars, "u long, v long")


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, fp) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(_fingerprints, "doc_id long, fp long")


def simhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; the component is named by its smallest doc_id."""
    need(docs, doc_id, text)
    marked = kept(_marked(docs, doc_id, text), "fingerprints", batch=256)
    with temporary(docs.sparkSession):
        nodes = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
        labels = components(kept(linked_fingerprints(nodes.select("fp")), "links", batch=50_000))
        member = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
        smallest = member.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("of"))
        # Most fingerprints have one document, which names itself; the others' list goes to the salted documents.
        shared = kept(member.join(smallest.filter("of > 1"), "label").select("fp", "component_id"), "components", keep=True)
    named = shared.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    rows = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return rows.join(named, ["fp", "salt"], "left").select("doc_id", F.col("fp").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of the five-word shingles of the words in lower case (A-Z), sorted; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WIDE_SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-WIDE_SHINGLE])).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[WIDE_SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


_MIXERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, WIDE_BYTES), np.uint64) | np.uint64(1)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A byte of each of 128 min-wise hashes of the shingles; zeros for a text without words."""
    least = np.full(WIDE_BYTES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        block = (hashes[at : at + 1024, None] ^ _MIXERS[0]) * _MIXERS[1]
        least = np.minimum(least, (block ^ (block >> np.uint64(29))).min(axis=0))
    return (least >> np.uint64(17)).astype(np.uint8).tobytes() if len(hashes) else bytes(WIDE_BYTES)


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each row its SimHash fingerprint, a number for its set of shingles, and the set's wide fingerprint."""
    for batch in batches:
        sets = [shingle_hashes(x) for x in batch["text"]]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        fps = np.array([fingerprint(x) for x in batch["text"]], np.uint64).view(np.int64)
        yield batch[["id", "unnamed", "hash"]].assign(fp=fps, node=nodes, wide=[wide_fingerprint(s) for s in sets])


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that equal positional bytes tell, less what chance gives."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key: those of posting lists with two members or more. A list may span batches."""
    rest = None
    for rows in batches:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        keys = rows["key"].to_numpy()
        same = keys[1:] == keys[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        # The last row waits for the next batch, unless it is known to have company.
        rest = rows.iloc[-1:] if len(rows) and not many[-1] else None
        if rest is None and len(rows):
            rest = rows.iloc[-1:].assign(told=True)
        told = rows["told"].eq(True).to_numpy() if "told" in rows else np.zeros(len(rows), bool)
        yield rows[many & ~told][["key", "first", "node"]]


def _own_keys(octets: np.ndarray) -> np.ndarray:
    """The bytes of each set of positions as one number."""
    sets = octets[:, : WIDE_KEYS * WIDE_KEY].reshape(len(octets), WIDE_KEYS, WIDE_KEY).astype(np.uint64)
    return (sets << (np.uint64(8) * np.arange(WIDE_KEY, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def _meet_here(a: np.ndarray, b: np.ndarray, first: int | np.ndarray, one: int | np.ndarray, other: int | np.ndarray) -> np.ndarray:
    """Whether pairs are this list's: it is the list of the first set that they share, and, if it is one of two parts of a longer list, they are of different parts ``one`` and ``other``."""
    return ((a == b).argmax(axis=-1) == first) & ((np.asarray(one) < 0) | (np.asarray(one) != other))


def _links(most: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (key, first, second, node, label, wide) sorted by key to links (u, v, more).

    A pair is looked at in one of the lists in which it meets. Members that surely link are searched breadth first, so each costs one link. Of the uncertain
    links a member gives its ``most`` likeliest, and ``more`` says that it has others. Members of one label are linked already.
    """

    def search(x: pd.DataFrame) -> list[tuple[int, int, bool]]:
        node, label, first, part = x["node"].to_numpy(), x["label"].to_numpy(), int(x["first"].iat[0]), x["second"].to_numpy()
        octets = np.frombuffer(b"".join(x["wide"]), np.uint8).reshape(-1, WIDE_BYTES)
        keys = _own_keys(octets)
        group, rest, sure, maybe = np.arange(len(x)), np.arange(len(x)), [], []
        while len(rest):
            seed, queue, rest = rest[0], [rest[0]], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                like, known = similarity(octets[i], octets[rest]), label[rest] == label[i]
                here = _meet_here(keys[i], keys[rest], first, part[i], part[rest])
                linked = (like >= SURE) | known
                group[rest[linked]] = seed
                found = rest[linked & ~known & here]
                if most and part[i] >= 0:  # Members of one label in another part: one of them speaks for them in this round.
                    _, at, of = np.unique(label[found], return_index=True, return_counts=True)
                    sure += [(i, j, n > 1) for j, n in zip(found[at].tolist(), of.tolist(), strict=True)]
                else:
                    sure += [(i, j, False) for j in found.tolist()]
                near = ~linked & here & (like >= UNSURE)
                maybe += [(i, int(j), float(s)) for j, s in zip(rest[near], like[near], strict=True)]
                queue += rest[linked].tolist()
                rest = rest[~linked]
        out = [(node[i], node[j], more) for i, j, more in sure]
        if maybe:
            m = pd.DataFrame(maybe, columns=["i", "j", "like"])
            m = m[group[m["i"]] != group[m["j"]]].sort_values("like", ascending=False)
            place = m.groupby("j").cumcount()
            m = m.assign(more=place.groupby(m["j"]).transform("max") >= (most or len(x)))
            out += [(node[i], node[j], more) for i, j, more in m[place < (most or len(x))][["i", "j", "more"]].itertuples(index=False)]
        return out

    def pairs(rows: pd.DataFrame, at: np.ndarray) -> list[tuple[int, int, bool]]:
        """Lists of two members, of which the first are at ``at``, all at once."""
        two = [rows.iloc[at + k] for k in (0, 1)]
        octets = [np.frombuffer(b"".join(x["wide"]), np.uint8).reshape(-1, WIDE_BYTES) for x in two]
        node, label = ([x[c].to_numpy() for x in two] for c in ("node", "label"))
        good = (similarity(*octets) >= UNSURE) & (label[0] != label[1])
        good &= _meet_here(*map(_own_keys, octets), two[0]["first"].to_numpy(), *(x["second"].to_numpy() for x in two))
        return [(u, v, False) for u, v in zip(node[0][good].tolist(), node[1][good].tolist(), strict=True)]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            out = []
            keys = rows["key"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            sizes = np.diff(cuts)
            # The lists at the edges of a batch may go on in others.
            inner = np.arange(1, len(sizes) - 1)
            if len(at := cuts[inner[sizes[inner] == 2]]):
                out += pairs(rows, at)
            for i in [0, *inner[sizes[inner] > 2].tolist(), *([len(sizes) - 1] if len(sizes) > 1 else [])]:
                part = rows.iloc[cuts[i] : cuts[i + 1]]
                if held and held[0]["key"].iat[0] != part["key"].iat[0]:
                    out += search(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
            yield pd.DataFrame(out, columns=["u", "v", "more"]).astype({"u": "int64", "v": "int64", "more": "bool"})
        if held:
            yield pd.DataFrame(search(pd.concat(held, ignore_index=True)), columns=["u", "v", "more"]).astype({"u": "int64", "v": "int64", "more": "bool"})

    return links


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (u, salt), the ``other`` ones last: the exact similarity of each other one's text to the first one's."""
    at = own = None
    for rows in batches:
        out = []
        for u, salt, v, other, text in zip(*(rows[c].tolist() for c in ("u", "salt", "v", "other", "text")), strict=True):
            if not other:
                at, own = (u, salt), shingle_hashes(text)
            elif at == (u, salt):
                out.append((u, v, jaccard(own, shingle_hashes(text))))
        yield pd.DataFrame(out, columns=["u", "v", "similarity"]).astype({"u": "int64", "v": "int64", "similarity": "float64"})


def verified(docs: DataFrame, links: DataFrame, holders: DataFrame) -> DataFrame:
    """(u, v, similarity): the exact similarity of the two texts of each link. ``docs``: (doc_id, hash, text); ``holders``: (node, doc_id, hash), a row that has the node's text.

    Only texts that are in a link move, once for each of their links as ``v`` and once for each ``DEGREE`` links as ``u``.
    """
    ends = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
    wanted = holders.join(ends, "node").select(F.col("doc_id").alias("i"), F.col("hash").alias("h"), "node")
    wanted = small(kept(wanted, "wanted"), 200_000)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("node", "text").dropDuplicates(["node"])
    texts = kept(texts, "linked-texts")
    salts = links.groupBy("u").agg(F.ceil(F.count("*") / DEGREE).cast("int").alias("n"))
    links = links.select("u", "v").join(salts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("n")).cast("int").alias("salt"))
    others = links.join(texts, links["v"] == texts["node"]).select("u", "salt", "v", F.lit(True).alias("other"), "text")
    own = salts.join(texts, salts["u"] == texts["node"]).select("u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(0).cast("long").alias("v"), F.lit(False).alias("other"), "text")
    rows = own.unionByName(others).repartition("u", "salt").sortWithinPartitions("u", "salt", "other")
    return kept(rows.mapInPandas(_verify, "u long, v long, similarity double"), "similarities", batch=256)


def _wide_lists(nodes: DataFrame) -> DataFrame:
    """(key, first, second, node) of the posting lists with two members or more; ``second`` is -1.

    A list longer than ``LIST`` is cut into parts of about as many by a hash, and becomes a list of each part and one of each two parts, where ``second`` is the
    member's part: each pair of the long list meets in one of them. Its pairs are the square of its length, a task's are not.
    """
    number = lambda k: F.struct(F.xxhash64(F.lit(k), F.substring("wide", 1 + k * WIDE_KEY, WIDE_KEY)).alias("key"), F.lit(k).alias("k"))
    sets = F.inline(F.array(*[number(k) for k in range(WIDE_KEYS)]))
    postings = nodes.select("node", sets).withColumnRenamed("k", "first")
    met = kept(postings.repartition("key").sortWithinPartitions("key").mapInPandas(_met, "key long, first int, node long"), "met", batch=50_000).withColumn("second", F.lit(-1))
    long = kept(met.groupBy("key").agg(F.ceil(F.count("*") / LIST).cast("int").alias("n")).filter("n > 1"), "long-lists")
    if long.limit(1).count() == 0:
        return met.select("key", "first", "second", "node")
    parts = met.join(long, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    parts = parts.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "first", F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("second"), "node")
    return met.join(long, "key", "left_anti").select("key", "first", "second", "node").unionByName(parts)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, label) of each row of (doc_id, hash, text): rows of one label are linked by texts of a similarity of ``SIMILARITY`` or more."""
    # pandas would make a float of an id that may be null.
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("unnamed"), "hash", "text")
    marks = kept(rows.mapInPandas(_marks, "id long, unnamed boolean, hash long, fp long, node long, wide binary"), "marks", batch=256)
    marks = marks.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("id"))).drop("id", "unnamed")
    nodes = marks.groupBy("node").agg(F.first("wide").alias("wide"), F.min("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("holder"))
    nodes = kept(nodes, "nodes")
    holders = nodes.select("node", "holder.doc_id", "holder.hash")
    # What operator 4 groups: each member beside the group's first.
    named = nodes.select("node", "fp")
    groups = components(kept(linked_fingerprints(nodes.select("fp").distinct()), "links", batch=50_000))
    named = named.join(groups, named["fp"] == groups["node"], "left").select(named["node"], F.coalesce("label", "fp").alias("label"))
    heads = named.groupBy("label").agg(F.min("node").alias("u"), F.count("*").alias("n")).filter("n > 1")
    narrow = named.join(heads, "label").filter("node <> u").select("u", F.col("node").alias("v"), F.lit(False).alias("more"))
    lists = kept(_wide_lists(nodes.select("node", "wide")), "lists")

    def wide(lists: DataFrame, labels: DataFrame, most: int | None) -> DataFrame:
        rows = lists.join(nodes.select("node", "wide"), "node").join(labels, "node", "left").select("key", "first", "second", "node", F.coalesce("label", "node").alias("label"), "wide")
        return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_links(most), "u long, v long, more boolean")

    ordered = lambda x: x.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "more").groupBy("u", "v").agg(F.max("more").alias("more"))
    none = nodes.select("node", F.col("node").alias("label")).limit(0)
    links = kept(ordered(kept(wide(lists.filter("second < 0"), none, MAYBE).unionByName(narrow), "wide-links", batch=5000)), "links")
    true = verified(docs, links, holders).filter(F.col("similarity") >= SIMILARITY).select("u", "v")
    labels = components(true)

    def more(lists: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        rest = kept(ordered(kept(wide(lists, labels, most), "wide-links", batch=5000)).join(links, ["u", "v"], "left_anti"), "links")
        both = true.unionByName(verified(docs, rest, holders).filter(F.col("similarity") >= SIMILARITY).select("u", "v"))
        return links.unionByName(rest), both, components(both)

    across = lists.filter("second >= 0")
    if across.limit(1).count():
        # Parts of long lists meet once their members have labels.
        links, true, labels = more(across, MAYBE)
    if links.filter("more").limit(1).count():
        # All uncertain links between groups that are still apart.
        links, true, labels = more(lists, None)
    return kept(marks.join(labels, "node", "left").select("doc_id", "hash", F.coalesce("label", "node").alias("label")), "labelled", keep=True)


def _survivors(docs: DataFrame, labelled: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of the rows of each label the one with the smallest doc_id, then the smallest hash of its text; equal rows once.

    ``labelled``: (doc_id, hash, label) of each row; null doc_ids come last."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("hash").alias("hash"))
    first = labelled.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Fewer go than stay, so their list is what the texts meet; a row is told by its doc_id and its text's hash.
    salted = first.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    members = labelled.withColumn("salt", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SALTS))).join(salted, ["label", "salt"])
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    number, key = free(docs, "_id"), free(docs, "_hash")
    gone = members.filter(~stays).select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("u"), F.col("hash").alias("h")).distinct()
    twice = members.filter(stays).groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
    several = twice.limit(1).count() > 0
    rows = docs.withColumn(number, F.col(doc_id).cast("long")).withColumn(key, F.xxhash64(text))
    rows = rows.join(gone, (F.coalesce(F.col(number), F.lit(0)) == F.col("i")) & (F.col(number).isNull() == F.col("u")) & (F.col(key) == F.col("h")), "left_anti")
    return (rows.dropDuplicates([number, key]) if several else rows).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: of a similarity of 0.8 or more of their five-word shingles, directly or through others.
    Of a group the row with the smallest doc_id stays, null ones last. Rows of equal doc_id and text are one row, and any one of them stays."""
    need(docs, doc_id, text)
    with temporary(docs.sparkSession):
        labelled = near_groups(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")))
    return _survivors(docs, labelled, doc_id, text)
