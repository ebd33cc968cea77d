"""Secret scan: rules gated by a trigram index, candidates verified by the rules' regexes.

Method: a Boolean trigram query is derived from each regex (see ``trigrams``). The corpus' postings (trigram, document)
of the trigrams that the queries use are stored; each rule's query intersects them, and its regex runs over the
documents that are left. Rules without mandatory trigrams run over all. A document's key in the index is a hash
of its doc_id, where there is one, and its text, so copies make no hot group; two rows of one key share their
candidates, which are verified in each row.

Null or empty text: no spans. Null or repeated doc_id, repeated rows and extra columns: each row is judged by
itself; a column named as the result is replaced. Empty table: empty result. Positions count code points, the end is
exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import constants, free, kept, let, need, small, scanned, spans
from .trigrams import query


@dataclass(frozen=True)
class SecretRule:
    """``least``: how long the text of ``group`` must be; matches that fail are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in their order; matches are leftmost and do not overlap.
BASE = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
#: More kinds of credentials, by the forms that their issuers publish.
MORE = (
    SecretRule("aws-temporary", r"ASIA[A-Z0-9]{16}"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("github-fine", r"github_pat_[A-Za-z0-9_]{60,}"),
    SecretRule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("slack-hook", r"hooks\.slack\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9_]+"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("google-oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    SecretRule("npm", r"npm_[A-Za-z0-9]{36}"),
    SecretRule("pypi", r"pypi-AgEI[A-Za-z0-9_-]{50,}"),
    SecretRule("shopify", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    SecretRule("digitalocean", r"do[opr]_v1_[a-f0-9]{64}"),
    SecretRule("hosted-model", r"sk-(?:proj-)?[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20}"),
    SecretRule("hub", r"hf_[A-Za-z]{34}"),
    SecretRule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    SecretRule("json-web-token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=\s:,.-]{16,}-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    SecretRule("url-password", r"[a-z][a-z0-9+.-]{2,12}://[^\s:/@]{1,64}:([^\s:/@]{3,128})@[A-Za-z0-9]", 1, 3),
    SecretRule("bearer", r"(?i)authorization: (?:bearer|basic) ([A-Za-z0-9+/_.=-]{16,})", 1, 16),
    SecretRule("azure-account", r"AccountKey=[A-Za-z0-9+/]{80,}={0,2}"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,kind_order:int,end:int,kind:string>>"


def trigrams_of(rules: tuple[SecretRule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in query(r.pattern) for alternative in clause for t in alternative})


def present(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    """The queries' trigrams that stand in a text, upper and lower case alike."""
    return let(F.lower(text), lambda s: F.filter(constants(trigrams_of(rules)), lambda t: F.contains(s, t)))


def doc_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in (doc_id, text) if c in docs.columns])


#: Documents with a candidate, up to which their table is broadcast and no text moves.
BROADCAST_DOCS = 100_000


def trigram_postings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The stored index (trigram, key): which documents hold the trigrams that the rules' queries use."""
    need(docs, text)
    held = present(F.coalesce(F.col(text), F.lit("")), rules)
    return kept(docs.select(F.explode(held).alias("trigram"), doc_key(docs, doc_id, text).alias("key")), "trigrams")


def candidates(postings: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(key, rules): postings intersected by the rules' queries, as the numbers of the rules whose query a document meets.

    Rules without a query need a full scan and are not named here."""
    terms = [(r, c, a, t, len(alternative)) for r, rule in enumerate(rules) for c, clause in enumerate(query(rule.pattern)) for a, alternative in enumerate(clause) for t in alternative]
    table = postings.sparkSession.createDataFrame(terms, "rule int, clause int, alternative int, trigram string, size int")
    clauses = postings.sparkSession.createDataFrame([(i, len(query(r.pattern))) for i, r in enumerate(rules) if query(r.pattern)], "rule int, clauses int")
    # A repeated row has its postings twice, which may not count as two trigrams.
    met = postings.distinct().join(F.broadcast(table), "trigram").groupBy("key", "rule", "clause", "alternative", "size").agg(F.count("*").alias("n")).filter("n = size")
    every = met.groupBy("key", "rule").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(clauses), "rule").filter("n = clauses")
    return every.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def secret_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES, marker: str = "[secret]", out: str = "secrets") -> DataFrame:
    """The input's columns and a struct ``out``: ``spans`` (start, kind_order, end, kind) in order, and
    ``redacted``, the text with each span (overlapping ones as one) replaced by the marker."""
    need(docs, text)
    key, have, met, found = (free(docs, c) for c in ("_key", "_have", "_met", "_found"))
    left = kept(candidates(trigram_postings(docs, doc_id=doc_id, text=text, rules=rules), rules), "candidates").withColumnsRenamed({"key": have, "rules": met})
    rows = docs.withColumn(key, doc_key(docs, doc_id, text)).join(small(left, BROADCAST_DOCS), F.col(key) == F.col(have), "left")
    t = F.coalesce(F.col(text), F.lit(""))
    # Rules that read all texts have a cheap look first; of the others those run that the index has left for the row.
    always = [F.when(t.rlike(r.pattern), F.lit(i)) for i, r in enumerate(rules) if not query(r.pattern)]
    run = F.array_compact(F.concat(F.coalesce(F.col(met), F.array().cast("array<int>")), F.array(*always).cast("array<int>")))
    patterns, kinds = constants([r.pattern for r in rules]), constants([r.kind for r in rules])
    groups, least = constants([r.group for r in rules], "int"), constants([r.least for r in rules], "int")

    def of(r: Column) -> Column:
        return F.transform(
            F.filter(spans(t, F.get(patterns, r), F.get(groups, r)), lambda s: F.length(s["part"]) >= F.get(least, r)),
            lambda s: F.struct(s["start"].alias("start"), r.alias("kind_order"), s["end"].alias("end"), F.get(kinds, r).alias("kind")),
        ).cast(SPAN)

    rows = rows.withColumn(found, F.sort_array(F.flatten(F.transform(run, of))))
    redacted = F.when(F.size(found) == 0, F.col(text)).otherwise(let(F.col(found), lambda s: _redacted(t, s, marker)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], F.struct(F.col(found).alias("spans"), redacted.alias("redacted")).alias(out))


#: Characters of the pieces that a text is cut into, so that no part is looked for from the text's start.
PIECE = 1024


def _redacted(text: Column, found: Column, marker: str) -> Column:
    """Each span that begins beyond all before it puts the text since their end and the marker."""

    def part(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(pieces, first + 1, F.floor(b / PIECE).cast("int") - first + 1), ""), a - first * PIECE + 1, b - a)

    def build(pieces: Column, reach: Column) -> Column:
        shown = F.transform(found, lambda s, i: F.when(s["start"] < F.get(reach, i), F.lit("")).otherwise(F.concat(part(pieces, F.get(reach, i), s["start"]), F.lit(marker))))
        return F.concat(F.array_join(shown, ""), part(pieces, F.array_max(F.transform(found, lambda s: s["end"])), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), 0)
    return let(F.struct(cut.alias("pieces"), scanned(found, F.lit(0), lambda a, s: F.greatest(a, s["end"])).alias("reach")), lambda x: build(x["pieces"], x["reach"]))
