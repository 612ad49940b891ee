"""The operators that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from . import decontaminate, merkle, neardup, rules, spelling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ARCHIVES = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, url, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {neardup.MIN_PERCENT} * (min(a.n) + min(b.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM s LEFT JOIN least USING (doc_id)"""


def class_sql() -> list[str]:
    sets = ["a-z", "A-Z", "0-9", None, ".,;:''\"?()\\-", "#*$%&|<>!@\\^~_=+/\\\\{}\\[\\]"]
    counts = ["length(t) - length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))" if s is None else f"length(regexp_replace(t, '[^{s}]', '', 'g'))" for s in sets]
    return [*counts, "length(regexp_replace(t, '[\\x00-\\x7F]+', '', 'g'))"]


def part(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"


K = range(len(rules.CLASS_NAMES))
QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
c0 AS (SELECT *, length(t) AS chars, len(ws) AS n, {', '.join(f'{c} AS k{i}' for i, c in enumerate(class_sql()))} FROM d),
c AS (SELECT *, chars - ({' + '.join(f'k{i}' for i in range(7))}) AS k7 FROM c0),
tri AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: [i::VARCHAR, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2]])) AS x FROM d WHERE len(ws) > 2),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, x[1]::INT AS i, count(*) OVER (PARTITION BY doc_id, x[2]) AS m FROM tri) WHERE m > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
base AS (SELECT c.*, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN covered USING (doc_id)),
langs AS (SELECT lang, count(*) AS n_docs, sum(n) AS total, {', '.join(f'sum(k{i}) / sum(chars) AS q{i}' for i in K)} FROM c GROUP BY lang HAVING count(*) >= {rules.MIN_REFERENCE_DOCS} AND sum(n) > 0),
lw AS (SELECT doc_id, lang, lower(w) AS w FROM (SELECT doc_id, lang, unnest(ws) AS w FROM d)),
freq AS (SELECT lang, w, count(*) AS m FROM lw GROUP BY ALL),
top AS (SELECT lang, w, m / total AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m DESC, w) AS r FROM freq) JOIN langs USING (lang) WHERE r <= {rules.COMMON_WORDS}),
cnt AS (SELECT doc_id, lang, w, count(*) AS m FROM lw GROUP BY ALL),
seen AS (SELECT b.doc_id, t.w, t.q, coalesce(m, 0) / b.n AS p FROM base b JOIN top t USING (lang) LEFT JOIN cnt x ON x.doc_id = b.doc_id AND x.w = t.w WHERE b.n >= {rules.MIN_WORDS}),
bins AS (SELECT doc_id, p, q FROM seen UNION ALL SELECT doc_id, 1 - sum(p), greatest(1 - sum(q), 0) FROM seen GROUP BY doc_id),
wd AS (SELECT doc_id, round(sqrt(greatest(sum({part('p')} + {part('q')}) / 2, 0)), 6) AS word_distance FROM bins GROUP BY doc_id),
cb AS ({' UNION ALL '.join(f'SELECT doc_id, k{i} / chars AS p, q{i} AS q FROM base JOIN langs USING (lang) WHERE chars >= {rules.MIN_CHARS}' for i in K)}),
cd AS (SELECT doc_id, round(sqrt(greatest(sum({part('p')} + {part('q')}) / 2, 0)), 6) AS class_distance FROM cb GROUP BY doc_id),
v AS (SELECT *, n < 50 OR 100 * n_repeat_words > 50 * n AS base_failed FROM base LEFT JOIN wd USING (doc_id) LEFT JOIN cd USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, class_distance, word_distance,
  NOT (base_failed OR coalesce(class_distance > {rules.MAX_CLASS_DISTANCE}::DOUBLE, false) OR coalesce(word_distance > {rules.MAX_WORD_DISTANCE}::DOUBLE, false)) AS kept FROM v"""

TERMS = "regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(UPPER, LOWER)
W = decontaminate.WINDOW
PASSAGES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS id, {TERMS} AS ws FROM benchmark),
win AS (SELECT DISTINCT id, k, x FROM (SELECT id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS x FROM (SELECT *, least(len(ws), {W}) AS k FROM b WHERE len(ws) > 0))),
grams AS (SELECT r, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: struct_pack(i := i, x := array_to_string(ws[i : i + k - 1], ' ')))) AS g FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k),
occ AS (SELECT r, g.i AS i, win.k AS k, id FROM grams JOIN win ON win.k = grams.k AND win.x = grams.g.x),
hits AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS w FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM occ) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a string of ASCII and Latin-1 letters, bit by bit over its UTF-8 bytes."""
    step = "list_reduce(range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, xor(s, b))"
    data = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END))::UBIGINT[]"
    return f"xor(list_reduce({data}, lambda s, b: {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def grown(prefix: str, levels: int) -> str:
    """Levels of nodes over ``prefix0 (tree, i, h, n)``; a tree of one node stays as it is."""
    step = "SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, i // {1} AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {0} GROUP BY tree, i // {1})"
    return ",\n".join(f"{prefix}{k + 1} AS ({step.format(f'{prefix}{k}', merkle.FANOUT)})" for k in range(levels))


def folded(name: str, prefix: str, levels: int) -> str:
    """Levels of ``name0 (r, tree, i, cur, sib)``: the document's digest on its way up, and the siblings that it met."""
    step = """SELECT r, f.tree, f.i // {2} AS i, CASE WHEN max(n) = 1 THEN min(cur) ELSE sha256(string_agg(CASE WHEN x.i = f.i THEN cur ELSE h END, '' ORDER BY x.i)) END AS cur, min(sib) || coalesce(string_agg(CASE WHEN x.i <> f.i THEN h END, '' ORDER BY x.i), '') AS sib
FROM {0} f JOIN {1} x ON x.tree = f.tree AND x.i // {2} = f.i // {2} GROUP BY r, f.tree, f.i"""
    return ",\n".join(f"{name}{k + 1} AS ({step.format(f'{name}{k}', f'{prefix}{k}', merkle.FANOUT)})" for k in range(levels))


#: Levels that the SQL spells out: 16 ** 6 documents a source, 16 ** 3 sources.
DEEP, WIDE = 6, 3
MANIFEST = f"""WITH d AS (SELECT row_number() OVER () AS r, *, CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM documents),
leaves AS (SELECT r, doc_id, source, sha256({" || ".join(map(field, merkle.FIELDS))}) AS leaf, sha256({" || ".join(map(field, [*merkle.FIELDS[:-1], "changed"]))}) AS replaced FROM d),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, replaced) - 1 AS i FROM leaves),
n0 AS (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed),
{grown("n", DEEP)},
m0 AS (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM n{DEEP}),
{grown("m", WIDE)},
f0 AS (SELECT r, tree, i, replaced AS cur, '' AS sib FROM placed),
{folded("f", "n", DEEP)},
g0 AS (SELECT r, 0 AS tree, tree AS i, cur, sib FROM f{DEEP}),
{folded("g", "m", WIDE)}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = t.h AS verified FROM placed p JOIN g{WIDE} USING (r) JOIN n{DEEP} s ON s.tree = p.tree CROSS JOIN m{WIDE} t"""

SPELLING = f"""WITH RECURSIVE runs AS (SELECT d, w, count(*) AS m FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= {spelling.MIN_LENGTH} GROUP BY d, w),
hashed AS (SELECT w, m, {crc32("d || ':' || w")} AS h FROM runs),
words AS (SELECT word, sum(m)::BIGINT AS n FROM (SELECT m, CASE WHEN h % {spelling.DROP_ONE_IN} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed) WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(m) >= {spelling.MIN_COUNT}),
holes AS (SELECT word, unnest(list_transform(range(length(word)), lambda k: struct_pack(k := k, x := left(word, k::INT) || substr(word, k::INT + 2)))) AS g FROM words),
cut AS (SELECT h.word AS a, w.word AS b FROM holes h JOIN words w ON h.g.x = w.word),
near AS (SELECT a.word AS word, b.word AS near FROM holes a JOIN holes b ON a.g = b.g AND a.word <> b.word UNION SELECT a, b FROM cut UNION SELECT b, a FROM cut),
best AS (SELECT near.word, count(*) AS n_near, max(w.n) AS top, arg_min(near, (-w.n, near)) AS best FROM near JOIN words w ON w.word = near.near GROUP BY near.word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {spelling.TIMES} * n THEN best END AS form, CASE WHEN top >= {spelling.TIMES} * n THEN top END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM forms UNION SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = root WHERE e.form IS NULL"""

ORACLE_SQL = {
    "op6_minhash_near_dedup": NEAR,
    "op8_warc_index": ARCHIVES,
    "op9_quality_rules": QUALITY,
    "op11_benchmark_passages": PASSAGES,
    "op12_spelling_variants": SPELLING,
    "op13_merkle_manifest": MANIFEST,
}
