"""The same rows in SQL, for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .secret_scan import RULES

LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLAIN = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS win FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

REPEATS = f"""WITH d AS (SELECT doc_id, {PLAIN.format("text")} AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 19), ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS k FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS n FROM x) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 19)) AS p FROM r),
p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
k AS (SELECT p.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (g.p IS NULL) AS left_over FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_LINE = r"lower(regexp_replace(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g'))"
QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {PLAIN.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS k FROM d WHERE len(w) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, host, unnest(lines) AS l FROM d),
nl AS (SELECT doc_id, host, {_LINE} AS k FROM ln),
sets AS (SELECT DISTINCT host, list_sort(list(DISTINCT k)) AS ks FROM nl GROUP BY doc_id, host),
often AS (SELECT host, k FROM (SELECT host, unnest(ks) AS k FROM sets) GROUP BY host, k HAVING count(*) > 10),
gone AS (SELECT doc_id, sum(len({PLAIN.format("l")})) AS n FROM (SELECT ln.*, {_LINE} AS k FROM ln) x SEMI JOIN often ON often.host = x.host AND often.k = x.k GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_removed > 0.5 * n_words) AS kept FROM b"""


def _secret_sql() -> str:
    """Matches stand between the pieces that the regex splits a text into; the same in both engines for these rules."""
    each = []
    for order, rule in enumerate(RULES):
        rx = "'" + rule.pattern.replace("'", "''") + "'"
        each.append(
            f"SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, unnest(string_split_regex(t, {rx})) AS gap, unnest(list_concat(regexp_extract_all(t, {rx}, 0), [NULL])) AS hit, "
            f"unnest(list_concat(regexp_extract_all(t, {rx}, {rule.group}), [NULL])) AS part, unnest(generate_series(1, len(string_split_regex(t, {rx})))) AS i, {rule.least} AS least FROM d WHERE regexp_matches(t, {rx})"
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(each)}),
p AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, o ORDER BY i) AS e FROM m),
s AS (SELECT doc_id, o, kind, e - length(hit) AS a, e FROM p WHERE hit IS NOT NULL AND length(part) >= least),
g AS (SELECT doc_id, count_if(o = 0) AS n_assign, count_if(o = 1) AS n_access, count_if(o = 2) AS n_hex, string_agg(concat_ws(':', kind, a, e), ',' ORDER BY a, o, e) FILTER (o < 3) AS base, string_agg(concat_ws(':', kind, a, e), ',' ORDER BY a, o, e) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


#: The 256 steps of crc32, and with them the crc32 of a text's UTF-8 bytes.
CRC_STEPS = "list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, {1}[1 + (xor(c, b) & 255)])), 4294967295)"

RESAMPLE = f"""WITH steps AS MATERIALIZED (SELECT {CRC_STEPS} AS t),
w AS (SELECT 's' AS side, doc_id AS id, {WORDS.format("coalesce(text, '')")} AS w FROM documents UNION ALL SELECT 't', item_id, {WORDS.format("coalesce(text, '')")} FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
k AS MATERIALIZED (SELECT f, ({CRC.format("f", "t")} % 10000)::BIGINT AS b FROM (SELECT DISTINCT f FROM f), steps),
n AS (SELECT b, count_if(side = 's') AS s, count_if(side = 't') AS t FROM f JOIN k USING (f) GROUP BY b),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
g AS (SELECT b, floor(1000 * ln((n.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((n.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS g FROM n, total),
d AS (SELECT id, count(*) AS n, sum(g) AS weight FROM f JOIN k USING (f) JOIN g USING (b) WHERE side = 's' GROUP BY id),
r AS (SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT AS h FROM w LEFT JOIN d USING (id) WHERE side = 's'),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, count_if(n_words >= 20) OVER () AS most FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * most // 100 THEN place END AS rank FROM o"""


TRIE = f"""WITH steps AS MATERIALIZED (SELECT {CRC_STEPS} AS t),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
i AS MATERIALIZED (SELECT n.c, n.c - n.c % 5 AS b, ({CRC.format("n.c::VARCHAR", "t")} % 9)::BIGINT AS h, n.n, least(({CRC.format("n.c::VARCHAR", "t")} % 9)::BIGINT, coalesce(m.n, 0)) AS k FROM n, steps LEFT JOIN n m ON m.c = n.c - n.c % 5),
t AS (SELECT i.c, o.i AS p, r, x FROM i JOIN o ON o.c = i.b AND o.i < i.h UNION ALL SELECT i.c, k + o.i - h, r, x FROM i JOIN o ON o.c = i.c AND o.i >= i.h),
l AS (SELECT i.c, count(t.c) AS len FROM i LEFT JOIN t USING (c) GROUP BY i.c),
p AS MATERIALIZED (SELECT c, 0 AS d, '' AS path, NULL::VARCHAR AS up, 0 AS b FROM i
  UNION ALL SELECT c, p + 1, sha, lag(sha) OVER w, b FROM (SELECT c, p, octet_length(encode(x)) AS b, sha256(string_agg(sha256(r) || sha256(x), '') OVER (PARTITION BY c ORDER BY p)) AS sha FROM t) WINDOW w AS (PARTITION BY c ORDER BY p)),
g AS MATERIALIZED (SELECT d, path, min(c) AS c, count(*) AS n, any_value(b) AS b, any_value(CASE WHEN d = 1 THEN '' ELSE up END) AS up FROM p GROUP BY d, path),
ch AS (SELECT d - 1 AS d, up AS path, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
e AS (SELECT d, path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM p JOIN l USING (c) WHERE d = len GROUP BY d, path),
z AS MATERIALIZED (SELECT g.*, coalesce(ch.n, 0) AS kids, (g.n - 1) * g.b AS saved FROM g LEFT JOIN ch USING (d, path)),
s AS (SELECT a.d, a.path, sum((z.kids = 0)::INT) AS leaves, sum(z.saved) AS saved FROM z JOIN p q ON q.c = z.c AND q.d <= z.d JOIN g a ON a.d = q.d AND a.path = q.path GROUP BY a.d, a.path)
SELECT z.c AS conv_id, z.d::BIGINT AS depth, u.c AS parent_conv_id, z.n::BIGINT AS n_convs, z.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM z JOIN s USING (d, path) LEFT JOIN e USING (d, path) LEFT JOIN g u ON z.d > 0 AND u.d = z.d - 1 AND u.path = z.up"""


_LEAVES = r"regexp_extract_all({0}, '[^.!?]{{0,200}}[.!?]+[ \n]*|[^.!?]{{1,200}}')"
_LINES = r"regexp_extract_all({0}, '[^\n]*\n|[^\n]+')"
#: Lines with their hashes, the places where sections end, the sections' hashes, and the hash of those.
_ROOT = f"""(SELECT sha256(array_to_string(list_transform(range(1, len(e) + 1), lambda k: sha256(array_to_string(list_slice(h, coalesce(e[k - 1], 0) + 1, e[k]), ''))), '')) FROM
(SELECT h, list_filter(range(1, len(h) + 1), lambda i: i = len(h) OR l[i] = chr(10) OR h[i][1] IN ('0', '1')) AS e FROM
(SELECT l, list_transform(l, lambda p: sha256(array_to_string(list_transform({_LEAVES.format("p")}, lambda q: sha256(q)), ''))) AS h FROM (SELECT {_LINES.replace("{0}", "TEXT")} AS l))))"""

FINGERPRINTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx FROM d),
x AS (SELECT doc_id, t, nx, left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2) AS e FROM n),
p AS (SELECT doc_id, side, q, length(q) AS n, count(*) AS k FROM (SELECT doc_id, side, unnest(flatten(list_transform({_LINES.format("s")}, lambda l: {_LEAVES.format("l")}))) AS q
  FROM (SELECT doc_id, 't' AS side, t AS s FROM x UNION ALL SELECT doc_id, 'e', e FROM x UNION ALL SELECT doc_id, 'n', nx FROM x)) GROUP BY ALL),
c AS (SELECT a.doc_id, sum(least(a.k, b.k) * a.n) FILTER (b.side = 'e') AS e, sum(least(a.k, b.k) * a.n) FILTER (b.side = 'n') AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.q = b.q AND b.side <> 't' WHERE a.side = 't' GROUP BY a.doc_id)
SELECT x.doc_id, length(t)::BIGINT AS n_chars, sha256(x.e) AS edited_sha256, {_ROOT.replace("TEXT", "t")} AS fingerprint, {_ROOT.replace("TEXT", "x.e")} AS edited_fingerprint,
CASE WHEN t = x.e THEN 1.0 ELSE 2.0::DOUBLE * coalesce(c.e, 0) / (length(t) + length(x.e)) END::DOUBLE AS near_edited, CASE WHEN t = nx THEN 1.0 ELSE 2.0::DOUBLE * coalesce(c.n, 0) / (length(t) + length(nx)) END::DOUBLE AS near_next
FROM x LEFT JOIN c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": DECONTAMINATION, "op7_substring_dedup": REPEATS, "op9_secret_scan": _secret_sql(), "op10_quality_rules": QUALITY, "op11_prefix_trie": TRIE, "op12_fingerprints": FINGERPRINTS, "op13_resample": RESAMPLE}
