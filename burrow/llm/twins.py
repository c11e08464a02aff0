"""DuckDB twins of the operators that SQL can express: plain definitions over whole tables, without candidates or hashes."""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_RUN = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw), kinds AS (SELECT DISTINCT n, win FROM iw),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) u(k) WHERE len(w) >= n),
h AS (SELECT r, k, n, win FROM dw SEMI JOIN kinds USING (n, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, unnest(range(k, k + n)) u(p) GROUP BY r),
i AS (SELECT r, list_sort(list_distinct(list(item))) AS items FROM (SELECT DISTINCT r, n, win FROM h) JOIN iw USING (n, win) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)"""

_NORM = rf"lower(regexp_replace(trim(x, {_BLANKS}), '[\x20\x09-\x0D]+', ' ', 'g'))"

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_RUN}) AS words, string_split(t, chr(10)) AS lines FROM d),
runs AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS run FROM w, unnest(range(1, len(words) - 6)) u(i)),
twice AS (SELECT r, i FROM runs QUALIFY count(*) OVER (PARTITION BY r, run) > 1),
gaps AS (SELECT r, lead(i) OVER (PARTITION BY r ORDER BY i) - i AS gap FROM twice),
rep AS (SELECT r, sum(least(8, coalesce(gap, 8)))::BIGINT AS n FROM gaps GROUP BY r),
l AS (SELECT r, host, text, x, {_NORM} AS norm, len(regexp_extract_all(x, {_RUN})) AS n FROM w, unnest(lines) u(x) WHERE trim(x, {_BLANKS}) <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM l GROUP BY r),
hosts AS (SELECT host, count(DISTINCT coalesce('t' || text, 'n')) AS texts FROM d GROUP BY host),
common AS (SELECT host, norm FROM l JOIN hosts USING (host) GROUP BY host, norm, texts HAVING count(DISTINCT text) >= 20 AND count(DISTINCT text) > 0.1 * texts),
gone AS (SELECT r, sum(n) AS n, list(DISTINCT norm) AS norms FROM l JOIN common USING (host, norm) GROUP BY r),
m AS (SELECT w.*, len(words) AS n_words, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.n, 0) AS n_dup_lines, coalesce(gone.n, 0) AS lost, norms FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
k AS (SELECT *, NOT base_failed AND NOT (norms IS NOT NULL AND n_words - lost < 20 AND 2 * lost >= n_words) AS kept FROM v)
SELECT doc_id, n_words::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept,
CASE WHEN kept THEN CASE WHEN norms IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x: trim(x, {_BLANKS}) = '' OR NOT list_contains(norms, {_NORM})), chr(10)) END END AS clean_text FROM k"""


_PHRASES = "(VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit'))"

#: The license scan's first six columns; its labels and score are the method's own.
LICENSE_BASE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS q, label FROM {_PHRASES} t(phrase, label)),
h AS (SELECT r, k - 1 AS pos, label FROM d, p, unnest(range(1, len(w) - len(q) + 2)) u(k) WHERE len(w) >= len(q) AND w[k:k + len(q) - 1] = q),
a AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN a USING (r)"""


def jaccard(size: int) -> str:
    """Components of documents whose sets of shingles of so many words have a Jaccard similarity of 0.8 or more."""
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_RUN}) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + {size - 1}], ' ') AS sh FROM d, unnest(range(1, greatest(len(w) - {size - 2}, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT r, r AS t FROM n UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.t = links.a),
c AS (SELECT reach.r, min(d.doc_id) AS least FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE c.least END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""


MINHASH = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({jaccard(2)})"

_BYTES = "flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
# the checksum's remainder: a byte goes in by exclusive or, then eight bits go out
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"

PREFIX_TRIE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i, [coalesce(role, ''), coalesce(text, '')] AS t FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(t ORDER BY i) AS l FROM t GROUP BY conv_id), h AS (SELECT *, ({_CRC} % 6)::INT AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS k FROM c, unnest(range(0, len(l) + 1)) u(d)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(k[d][2]) END AS own, sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k, d)),
s AS (SELECT x.k[1:u.e] AS k, u.e AS d, sum((kids = 0)::INT)::BIGINT AS leaves, sum(own)::BIGINT AS saved FROM f x, unnest(range(0, x.d + 1)) u(e) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, g.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.kids::BIGINT AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (k, d) LEFT JOIN n g ON f.d > 0 AND g.d = f.d - 1 AND g.k = f.k[1:f.d - 1]"""

FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM d),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS c2,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || x[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM h)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
