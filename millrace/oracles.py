"""The same results as the registered queries, in DuckDB's SQL."""

from __future__ import annotations

from .functions import fixed
from .functions.text import TOKEN


def text_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TOKEN_SQL = TOKEN.replace("'", "''")
STOP = text_list(fixed.STOP_WORDS)


def words(text: str) -> str:
    """Folded words of ``text`` without stop words; the tables hold no other letter than ß whose folding is not its lower case."""
    return f"list_filter(regexp_extract_all(replace(lower(coalesce({text}, '')), 'ß', 'ss'), '{TOKEN_SQL}'), lambda w: NOT list_contains({STOP}, w))"


BM25 = f"""
toks AS (SELECT doc_id, {words('text')} AS ws FROM documents),
lens AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM toks),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM post GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({words('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM post JOIN df USING (term) JOIN asked USING (term), lens GROUP BY query_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM scored WHERE score > 0)"""

OVERLAP = f"""{BM25},
has AS (SELECT doc_id, list_distinct(ws) AS has FROM toks),
want AS (SELECT item_id AS query_id, list_distinct({words('text')}) AS want FROM benchmark),
ov AS (SELECT query_id, doc_id, rank AS old_rank, score AS bm_score, round(CASE WHEN len(want) > 0 THEN len(list_intersect(want, has)) / len(want) ELSE 0 END, 6) AS overlap
  FROM bm JOIN has USING (doc_id) JOIN want USING (query_id) WHERE rank <= 20),
second AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id DESC) AS rank2 FROM ov)"""

JUDGED = """
rows AS (SELECT lang AS query_id, doc_id, n_chars, quality::DOUBLE AS relevance FROM documents JOIN labels USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank, 'longest' AS method FROM rows
  UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, doc_id), 'shortest' FROM rows
  UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC), 'newest' FROM rows),
top AS (SELECT * FROM ranked WHERE rank <= 10),
ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN r <= 10 THEN (2 ** relevance - 1) / log2(r + 1) END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS r FROM rows WHERE relevance > 0) GROUP BY query_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY rank) AS nth FROM top WHERE relevance > 0),
found AS (SELECT query_id, method, sum((2 ** relevance - 1) / log2(rank + 1)) AS dcg, count(*) AS hits, sum(nth / rank) AS prec, min(rank) AS first FROM hits GROUP BY ALL),
scores AS (SELECT query_id, method, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(hits / relevant, 0), 6) AS recall,
    round(coalesce(prec / least(relevant, 10), 0), 6) AS ap, round(coalesce(1.0 / first, 0), 6) AS rr
  FROM ideal JOIN (SELECT DISTINCT query_id, method FROM ranked) USING (query_id) LEFT JOIN found USING (query_id, method))"""


def marker_score(text: str, markers: list[str], divisor: float) -> str:
    low = f"lower(coalesce({text}, ''))"
    hits = " + ".join(f"(length({low}) - length(replace({low}, '{m}', ''))) / {len(m)}.0" for m in markers)
    return f"round(least(1.0, ({hits}) / {divisor}), 6)"


SIGNALS = ", ".join(f"{marker_score('text', m, d)} AS {name}" for name, (m, d) in fixed.SIGNAL_MARKERS.items())


def pattern(p: str) -> str:
    return p.replace("'", "''")


def safety(table: str, key: str, text: str, extra: str = "0.0") -> str:
    """CTEs ending in ``scanned(key, categories, risk_score, decision)``."""
    checks = {name: f"regexp_matches(low, '(?s){'|'.join('(?:' + pattern(p) + ')' for p in ps)}')" for name, ps in fixed.SAFETY_PATTERNS.items()}
    checks["unicode_anomaly"] = "length(regexp_replace(raw, '[^\\p{Cf}\\p{Cc}]|[\\n\\r\\t]', '', 'g')) >= 2"
    checks["retrieval_trigger_shape"] = "len(ws) >= 24 AND list_max(map_values(list_histogram(ws))) >= 0.25 * len(ws)"
    names = sorted(checks)
    flags = ", ".join(f"({checks[n]}) AS {n}" for n in names)
    risk = " + ".join(f"CASE WHEN {n} THEN {fixed.SAFETY_WEIGHTS[n]}::DOUBLE ELSE 0 END" for n in names)
    some = " OR ".join(names)
    return f"""
src AS (SELECT {key} AS k, coalesce({text}, '') AS raw, lower(coalesce({text}, '')) AS low, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_:-]{{4,}}') AS ws FROM {table}),
flags AS (SELECT k, {flags} FROM src),
risks AS (SELECT *, round(least(1.0, {risk} + CASE WHEN {some} THEN {extra} ELSE 0 END), 6) AS risk_score FROM flags),
scanned AS (SELECT k, concat_ws(',', {', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in names)}) AS categories, risk_score,
  CASE WHEN exfiltration AND (instruction_override OR tool_control) THEN 'block' WHEN risk_score >= {fixed.QUARANTINE_FROM} THEN 'quarantine' WHEN risk_score >= {fixed.SANITIZE_FROM} THEN 'sanitize' ELSE 'allow' END AS decision FROM risks)"""


def claims() -> str:
    m = fixed.CLAIM_MARKERS
    groups = {"claim_marker_count": sorted({*m["positive"], *m["negative"], *m["finding"], *m["evidence"]}), "finding_marker_count": m["finding"], "evidence_marker_count": m["evidence"], "method_marker_count": m["method"], "hedge_marker_count": m["hedge"], "positive": m["positive"], "negative": m["negative"]}
    counts = ", ".join(f"len(list_intersect(list_distinct(ws), {text_list(v)})) AS {n}" for n, v in groups.items())
    raw = " + ".join(f"{n} * {w}::DOUBLE" for n, w in fixed.CLAIM_WEIGHTS.items())
    return f"""
folded AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM folded),
sents AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS position FROM parts),
toks AS (SELECT *, {words('sentence')} AS ws FROM sents),
counted AS (SELECT *, {counts}, least(len(ws), 60) AS sentence_token_count FROM toks),
claims AS (SELECT doc_id, position, sentence, ws, round(greatest(0.0, least(1.0, {fixed.CLAIM_INTERCEPT}::DOUBLE + {raw})), 6) AS confidence,
  CASE WHEN positive > negative THEN 'supportive' WHEN negative > positive THEN 'critical' WHEN positive > 0 THEN 'mixed' ELSE 'descriptive' END AS stance FROM counted),
kept AS (SELECT * FROM claims WHERE confidence >= {fixed.CLAIM_THRESHOLD})"""


def contains_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({text}, '')), '{t}')" for t in terms) + ")"


THEMES = ", ".join(f"CASE WHEN {contains_any('text', terms)} THEN '{name}' END" for name, terms in fixed.THEMES.items())
SUPPORT, OPPOSE, CONDITION = (contains_any("text", t) for t in (fixed.SUPPORT_TERMS, fixed.OPPOSE_TERMS, fixed.CONDITION_TERMS))
SPACES = "[ \\t\\n\\r\\x0b\\f]+"
ROUGH = "list_filter(string_split_regex(coalesce({0}, ''), '[\\s\\x0b\\x85\\p{{Z}}]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "bm25_topk": f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10",
    "bm25_term_stats": f"WITH {BM25} SELECT term, df, total_tf::BIGINT AS total_tf, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, lens",
    "knn_cosine_topk": """WITH p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM p) SELECT * FROM r WHERE rank <= 10""",
    "heuristic_rerank": f"WITH {OVERLAP}, r AS (SELECT query_id, doc_id, overlap, old_rank, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, old_rank) AS rank FROM ov) SELECT * FROM r WHERE rank <= 10",
    "rrf_fusion": f"WITH {OVERLAP}, u AS (SELECT query_id, doc_id, old_rank AS rank FROM ov UNION ALL SELECT query_id, doc_id, rank2 FROM second) SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(rank) AS best_rank, count(*) AS sources FROM u GROUP BY ALL",
    "weighted_fusion": f"""WITH {OVERLAP},
a AS (SELECT query_id, doc_id, CASE WHEN max(bm_score) OVER w > min(bm_score) OVER w THEN (bm_score - min(bm_score) OVER w) / (max(bm_score) OVER w - min(bm_score) OVER w) ELSE 1 END AS a FROM ov WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, doc_id, CASE WHEN max(overlap) OVER w > min(overlap) OVER w THEN (overlap - min(overlap) OVER w) / (max(overlap) OVER w - min(overlap) OVER w) ELSE 1 END AS b FROM ov WHERE overlap > 0 WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(0.45::DOUBLE * coalesce(a, 0) + (1 - 0.45::DOUBLE) * coalesce(b, 0), 6) AS score FROM a FULL JOIN b USING (query_id, doc_id)""",
    "source_diversity": f"WITH {BM25}, c AS (SELECT query_id, source, count(*) AS n FROM bm JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY ALL) SELECT query_id, count(*) AS distinct_sources, round(max(n) / sum(n), 6) AS dominant_share FROM c GROUP BY query_id",
    "near_duplicate_risk": f"""WITH {BM25}, s AS (SELECT query_id, doc_id, list_distinct(ws) AS s FROM bm JOIN toks USING (doc_id) WHERE rank <= 10),
p AS (SELECT a.query_id, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS t FROM s a JOIN s b ON a.query_id = b.query_id AND a.doc_id < b.doc_id)
SELECT query_id, count(*) AS pairs, round(avg(CASE WHEN t - i > 0 AND i / (t - i) >= 0.72 THEN 1 ELSE 0 END), 6) AS near_share FROM p GROUP BY query_id""",
    "parent_cap_diversify": """WITH r AS (SELECT role AS query_id, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY length(text) DESC, conv_id, turn) AS rank FROM conversations WHERE text IS NOT NULL),
m AS (SELECT *, (row_number() OVER (PARTITION BY query_id, conv_id ORDER BY rank) > 2)::INT AS o FROM r) SELECT query_id, conv_id, turn, rank, row_number() OVER (PARTITION BY query_id ORDER BY o, rank) AS new_rank FROM m""",
    "ir_metrics": f"WITH {JUDGED} SELECT query_id, ndcg, recall, ap, rr FROM scores WHERE method = 'longest'",
    "policy_leaderboard": f"WITH {JUDGED} SELECT method, count(*) AS queries, round(avg(ndcg), 8) AS mean_ndcg, round(avg(recall), 8) AS mean_recall, round(avg(ap), 8) AS mean_ap, round(avg(rr), 8) AS mean_rr FROM scores GROUP BY method",
    "rank_overlap": f"WITH {JUDGED}, l AS (SELECT query_id, method, list(doc_id) AS ids FROM top GROUP BY ALL) SELECT a.query_id, a.method AS left_method, b.method AS right_method, round(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))), 6) AS overlap FROM l a JOIN l b ON a.query_id = b.query_id AND a.method < b.method",
    "score_separation": """WITH c AS (SELECT n_chars AS score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1),
w AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS wins FROM c),
t AS (SELECT sum(p)::BIGINT AS relevant, sum(q)::BIGINT AS others, sum(wins)::DOUBLE AS wins FROM w)
SELECT relevant, others, round(wins / (relevant * others), 6) AS auc, round(1 - 2 * abs(wins / (relevant * others) - 0.5), 6) AS overlap FROM t""",
    "signal_summary": f"""WITH s AS (SELECT doc_id, lang, n_chars, {SIGNALS} FROM documents),
e AS ({' UNION ALL '.join(f"SELECT lang, '{n}' AS signal, {n}::DOUBLE AS value FROM s" for n in ['n_chars', *fixed.SIGNAL_MARKERS])})
SELECT lang, signal, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM e GROUP BY ALL""",
    "signal_correlation": "SELECT lang, round(CASE WHEN stddev_pop(n_chars) > 0 AND stddev_pop(quality) > 0 THEN corr(quality, n_chars) ELSE 0 END, 4) AS correlation, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "marker_signals": f"SELECT doc_id, {SIGNALS} FROM documents",
    "safety_scan": f"WITH {safety('documents', 'doc_id', 'text')} SELECT k AS doc_id, categories, risk_score, decision FROM scanned",
    "page_safety": f"WITH {safety('pages', 'page_id', 'html', '0.1::DOUBLE')} SELECT decision, categories, count(*) AS n FROM scanned GROUP BY ALL",
    "claim_features": f"WITH {claims()} SELECT doc_id, position::INT AS position, confidence, stance, sha1(sentence) AS sentence_sha1 FROM kept",
    "claim_conflicts": f"""WITH {claims()},
rv AS (SELECT doc_id, position, ws, lang AS cluster, CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'mixed' WHEN quality IS NOT NULL THEN 'supportive' ELSE stance END AS stance FROM kept JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)),
cnt AS (SELECT doc_id, position, stance, cluster, t, count(*) AS c FROM (SELECT doc_id, position, stance, cluster, unnest(list_filter(ws, lambda w: length(w) >= 4)) AS t FROM rv) GROUP BY ALL),
tops AS (SELECT doc_id, position, stance, cluster, list_sort(list(t)) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY c DESC, t) AS r FROM cnt) WHERE r <= 8 GROUP BY doc_id, position, stance, cluster),
cls AS (SELECT topics, stance, cluster, min(struct_pack(d := doc_id, p := position)) AS first, count(*) AS claims, min(doc_id) AS low, max(doc_id) AS high, row_number() OVER () AS id FROM tops WHERE len(topics) >= 2 AND stance IN ('supportive', 'critical', 'mixed') GROUP BY topics, stance, cluster),
tk AS (SELECT id, stance, unnest(topics) AS t FROM cls),
met AS (SELECT a.id AS l, b.id AS r FROM tk a JOIN tk b ON a.t = b.t AND a.stance = 'supportive' AND b.stance <> 'supportive' GROUP BY ALL HAVING count(*) >= 2)
SELECT a.first.d AS left_doc, a.first.p::INT AS left_position, b.first.d AS right_doc, b.first.p::INT AS right_position, b.stance AS right_stance, a.claims AS left_claims, b.claims AS right_claims, array_to_string(list_filter(a.topics, lambda x: list_contains(b.topics, x)), ',') AS shared_tokens,
  CASE WHEN a.cluster IS DISTINCT FROM b.cluster THEN 'cross_cluster_tension' ELSE 'within_cluster_tension' END AS conflict_type, CASE WHEN a.cluster IS DISTINCT FROM b.cluster THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS score
FROM met JOIN cls a ON a.id = l JOIN cls b ON b.id = r WHERE NOT (a.low = a.high AND b.low = b.high AND a.low = b.low)""",
    "sliding_chunks": f"""WITH w AS (SELECT doc_id, {ROUGH.format('text')} AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, greatest(ceil((len(ws) - 180) / 140.0)::INT, 0) + 1)) AS chunk FROM w WHERE len(ws) > 0)
SELECT doc_id, chunk::INT AS chunk, (chunk * 140)::INT AS token_start, least(chunk * 140 + 180, len(ws))::INT AS token_end, sha1(array_to_string(ws[chunk * 140 + 1 : chunk * 140 + 180], ' ')) AS text_sha1 FROM c""",
    "parent_context": f"""WITH n AS (SELECT conv_id, turn, {ROUGH.format('text')} AS ws FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
k AS (SELECT conv_id, turn, ws[1 : (220 - before)::INT] AS ws FROM r WHERE before < 220 AND len(ws) > 0)
SELECT conv_id, count(*) AS parts, sum(len(ws))::BIGINT AS tokens, sha1(string_agg(array_to_string(ws, ' '), chr(10) ORDER BY turn)) AS context_sha1 FROM k GROUP BY conv_id""",
    "theme_stance_counts": f"""WITH e AS (SELECT CASE WHEN {SUPPORT} AND ({OPPOSE} OR {CONDITION}) THEN 'mixed_or_conditional' WHEN {SUPPORT} THEN 'support' WHEN {OPPOSE} THEN 'concern_or_opposition' WHEN {CONDITION} THEN 'conditional_unclear' ELSE 'unclear' END AS stance,
  list_filter([{THEMES}], lambda t: t IS NOT NULL) AS ts FROM conversations)
SELECT theme, stance, count(*) AS n FROM (SELECT stance, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE ['uncategorized'] END) AS theme FROM e) GROUP BY ALL""",
    "contact_patterns": "SELECT source, count(*) AS n, count(*) FILTER ((contains(text, '@') AND contains(text, '.')) OR (regexp_matches(text, '[0-9]') AND regexp_matches(text, '[-()]'))) AS with_contact FROM documents GROUP BY source",
    "duplicate_text_groups": f"SELECT left(sha1(trim(regexp_replace(lower(text), '{SPACES}', ' ', 'g'))), 16) AS text_hash, count(*) AS members, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "topic_profile_terms": f"""WITH t AS (SELECT doc_id, unnest({words('text')}) AS term FROM documents), s AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) >= 4 GROUP BY ALL) GROUP BY term)
SELECT term, tf, df, round(tf * ln(1 + n / df), 6) AS weight FROM s, (SELECT count(*) AS n FROM documents) ORDER BY weight DESC, term LIMIT 100""",
    "topic_phrases": f"""WITH t AS (SELECT list_filter({words('text')}, lambda w: length(w) >= 4) AS ws FROM documents), g AS (SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS phrase FROM t WHERE len(ws) > 1)
SELECT phrase, count(*) AS n FROM g GROUP BY phrase HAVING count(*) >= 2 ORDER BY n DESC, phrase LIMIT 50""",
    "manifest_diff": """WITH p AS (SELECT doc_id, CASE WHEN toxic = 1 THEN upper(text) ELSE text END AS a FROM documents JOIN labels USING (doc_id)), b AS (SELECT doc_id, text AS b FROM documents)
SELECT CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a <> b THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM p FULL JOIN b USING (doc_id) GROUP BY 1""",
    "merged_modes": """WITH u AS (SELECT d.doc_id, lang, n_chars, 'good' AS m FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT d.doc_id, lang, n_chars, 'clean' FROM documents d JOIN labels USING (doc_id) WHERE toxic = 0)
SELECT doc_id, first(lang) AS lang, first(n_chars) AS n_chars, string_agg(DISTINCT m, ',' ORDER BY m) AS modes FROM u GROUP BY doc_id""",
    "coverage_report": "SELECT lang, count(*) AS n, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS labelled, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS good, round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS toxic, round(avg(CASE WHEN n_chars >= 2000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS long FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "stratified_sample": "WITH r AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS stratum_rank FROM documents) SELECT * FROM r WHERE stratum_rank <= 3",
    "author_activity": "SELECT user_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY user_id",
    "temporal_coverage": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d')",
    "connected_components": """WITH e AS (SELECT o_custkey * 2 AS u, o_orderkey * 2 + 1 AS v FROM orders), m AS (SELECT u, least(u, min(v)) AS component FROM e GROUP BY u)
SELECT u AS node, component FROM m UNION SELECT v, component FROM e JOIN m USING (u)""",
    "rank_table": f"""WITH {JUDGED}, p AS (SELECT query_id, doc_id, min(rank) FILTER (method = 'longest') AS longest, min(rank) FILTER (method = 'newest') AS newest, min(rank) FILTER (method = 'shortest') AS shortest FROM top GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(coalesce(longest, 2147483647), coalesce(newest, 2147483647), coalesce(shortest, 2147483647)), doc_id) AS place FROM p""",
    "html_text": """WITH a AS (SELECT page_id, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g') AS b FROM pages),
c AS (SELECT page_id, title, replace(replace(replace(replace(replace(replace(b, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS b FROM a),
d AS (SELECT page_id, title, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS t FROM c)
SELECT page_id, title, length(t) AS text_chars, sha1(t) AS text_sha1 FROM d""",
    "index_refresh": "SELECT doc_id, sha256(text) AS digest, CASE WHEN toxic = 0 THEN 'kept' ELSE 'encoded' END AS state FROM documents LEFT JOIN labels USING (doc_id)",
    "stale_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
