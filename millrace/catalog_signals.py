"""Registered queries of profiles, wording, safety, corroboration and chunk policies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .functions import fixed_profiles as P
from .functions import text as T
from .operators import chunking, corroboration, evidence, profiles, retrieval, syntax, trust
from .operators.first_stage import focus_terms  # noqa: F401  (the same terms as in ``focus_coverage``)
from .oracles import BM25, claims, contains_any, pattern, safety, text_list, words

CHUNK_TOKENS, OVERLAP_TOKENS = 220, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works: English ones from journals, others reports; toxic ones retracted, good ones cited."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    null = F.lit(None).cast("string")
    return rows.select("doc_id", null.alias("title"), null.alias("doi"), F.col("source").alias("source_name"), null.alias("landing_page_url"), null.alias("provenance"), F.lit(2020).alias("year"), F.when(F.col("lang") == "en", "journal").otherwise("report").alias("source_type"), F.col("text").alias("abstract"), (F.col("n_chars") % 30).cast("int").alias("referenced_work_count"), F.coalesce(F.col("quality") * 20, F.lit(0)).alias("cited_by_count"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_retracted"))


def source_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.source_trust(works(spark, sf_dir), "economics").select("doc_id", "source_trust", "trust_tier")


def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and web pages with their type and its traits."""
    null = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("work_id"), F.col("source").alias("source_name"), F.col("text").alias("abstract"), null.alias("landing_page_url"), null.alias("provenance"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id"), null, F.col("html"), F.col("url"), F.lit("web"))
    rows = docs.union(pages).withColumns({"title": null, "source_type": null, "doi": null, "referenced_work_count": F.lit(0)})
    return profiles.document_type(rows).select("work_id", "document_type", "evidence_family", "authority_signal", "adversarial_surface", "recommended_decision_role")


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.domain_fit(profiles.document_type(trust.source_trust(works(spark, sf_dir), "economics")), "economics")


def domain_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir).select("doc_id", "document_type", "domain_fit_score", "domain_fit_tier", F.array_join("domain_gate_flags", ",").alias("gate_flags"))


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir).groupBy("document_type", "evidence_family", "domain_fit_tier").agg(F.count("*").alias("n"), F.round(F.avg("domain_fit_score"), 5).alias("mean_fit"))


def use_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = evidence.safety_scan(table(spark, sf_dir, "documents"), "text").select("doc_id", F.col("decision").alias("safety_decision"))
    rows = _fits(spark, sf_dir).join(safe, "doc_id").withColumn("decision", F.when(F.col("is_retracted"), "reject").otherwise("allow"))
    return evidence.use_policy(rows).groupBy("allowed_uses", "use_reason").agg(F.count("*").alias("n"))


def chunk_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = profiles.document_type(works(spark, sf_dir))
    return chunking.with_policy(typed, CHUNK_TOKENS, OVERLAP_TOKENS).select("doc_id", "document_type", "strategy", "chunk_tokens", "overlap_tokens")


def dispatched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = chunking.with_policy(profiles.document_type(works(spark, sf_dir)), CHUNK_TOKENS, OVERLAP_TOKENS)
    chunks = chunking.dispatched(typed.withColumnRenamed("abstract", "text"))
    return chunks.select("doc_id", "chunk", "token_start", "token_end", "aligned", F.sha1("text").alias("text_sha1"))


def chunk_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk decision profiles of whole documents, as if each were one chunk; texts that end a sentence count as aligned."""
    typed = chunking.with_policy(profiles.document_type(works(spark, sf_dir)), CHUNK_TOKENS, OVERLAP_TOKENS)
    rows = typed.withColumns({"tokens": F.size(T.rough_tokens(F.col("abstract"))), "aligned": F.coalesce(F.trim("abstract").rlike("[.!?]$"), F.lit(False))})
    return chunking.decisions(rows).select("doc_id", "containment", "contamination", "tier", "expand")


def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.tokens(F.col("text"))
    intent = F.lit(None).cast("string")
    for name, known in fixed.QUERY_INTENTS.items():
        intent = F.coalesce(intent, F.when(F.arrays_overlap(terms, T.literals(known)), name))
    return asked(spark, sf_dir).select("query_id", F.coalesce(intent, F.lit("substantive")).alias("intent"))


def query_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = asked(spark, sf_dir).select("query_id", F.posexplode(syntax.query_targets(F.col("text"))).alias("i", "target"))
    return each.select("query_id", F.get(T.literals(syntax.CATEGORIES), F.col("i")).alias("category"), "target")


def syntax_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = syntax.with_vector(table(spark, sf_dir, "documents").select("text")).select("vector")
    one = syntax.corpus_profile(vectors)
    return one.select(F.inline(F.arrays_zip(T.literals(syntax.CATEGORIES).alias("category"), F.col("counts").alias("texts"), F.col("weights").alias("weight")))).toDF("category", "texts", "weight").withColumn("weight", F.round("weight", 6))


def focus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.focus_coverage(asked(spark, sf_dir), table(spark, sf_dir, "documents"))


def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.sanitize(evidence.safety_scan(table(spark, sf_dir, "pages"), "html", risky=True), "html")
    return rows.select("page_id", "decision", "removed", F.sha1("sanitized").alias("sanitized_sha1"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = evidence.claims(docs).select("doc_id", "stance", "sentence", "_tokens")
    return said.join(docs.select("doc_id", "lang", F.lower("source").alias("fingerprint")), "doc_id")


def corroboration_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corroboration.groups(_claims(spark, sf_dir))


def corroboration_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corroboration.groups(_claims(spark, sf_dir)).groupBy("verdict").agg(F.count("*").alias("groups"), F.sum("support").alias("support"), F.round(F.max("echo_risk"), 6).alias("max_echo_risk"))


def best_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's claim of the highest confidence, the first of equals."""
    found = evidence.claims(table(spark, sf_dir, "documents"))
    best = F.min_by(F.struct("position", "confidence", "stance"), F.struct(-F.col("confidence"), F.col("position")))
    return found.groupBy("doc_id").agg(F.count("*").alias("claims"), best.alias("b")).select("doc_id", "claims", "b.position", "b.confidence", "b.stance")


def language_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(T.language(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


def compact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.compact(F.col("text"), 120)).alias("compact_sha1"))


def external_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", T.external_query(F.col("text")).alias("query"))


def plural_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = asked(spark, sf_dir), table(spark, sf_dir, "documents")
    top = retrieval.bm25_top_k(queries, docs)
    want = queries.select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("want"))
    has = docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("has"))
    both = top.join(want, "query_id").join(has, "doc_id")
    return both.select("query_id", "doc_id", F.size(F.filter("want", lambda w: T.term_matches(w, F.col("has")))).alias("matched"))


QUERIES = {
    f.__name__: f
    for f in (
        source_trust, document_profiles, domain_fit, profile_summary, use_policies, chunk_policies, dispatched_chunks, chunk_decisions, query_intents, query_syntax, syntax_profile,
        focus_coverage, sanitized_pages, corroboration_groups, corroboration_verdicts, best_claims, language_aliases, compact_texts, external_queries, plural_matches,
    )
}


# The same in SQL


def type_case(hay: str, kind: str, refs: str, url: str, provenance: str) -> str:
    """The type rules as a CASE over the lower-case ``hay``."""

    def has(terms: list[str]) -> str:
        return "(" + " OR ".join(f"contains({hay}, '{t}')" for t in terms) + ")"

    arms = []
    for name, kinds, markers in P.TYPE_RULES:
        tests = [f"{kind} IN ({', '.join(repr(k) for k in kinds)})"] if kinds else []
        tests += [has(markers)] if markers else []
        tests += {"policy_report": [f"({kind} IN ('report', 'dataset') AND {has(P.INSTITUTIONS)})"], "academic_article": [f"{refs} >= 10"], "web_page": [f"{provenance} = 'web'", f"{url} <> ''"]}.get(name, [])
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE 'unknown_unstructured_text' END"


TRAITS = "traits(document_type, family, authority, risk, surface, role) AS (VALUES " + ", ".join(f"('{n}', '{v[0]}', {v[2]}::DOUBLE, {v[4]}::DOUBLE, {v[5]}::DOUBLE, '{v[8]}')" for n, v in P.TYPE_TRAITS.items()) + ")"
WORKS = "w AS (SELECT doc_id, text, lang, source, n_chars % 30 AS refs, coalesce(quality * 20, 0) AS cited, coalesce(toxic, 0) = 1 AS retracted, CASE WHEN lang = 'en' THEN 'journal' ELSE 'report' END AS kind FROM documents LEFT JOIN labels USING (doc_id))"
TRUST = f"""{WORKS},
tp AS (SELECT *, CASE WHEN trim(coalesce(source, '')) <> '' THEN 0.4::DOUBLE ELSE 0.15 END AS a, CASE WHEN retracted THEN 0 WHEN lang = 'en' THEN 0.8::DOUBLE ELSE 0.5 END AS b,
  least(1.0::DOUBLE, CASE WHEN refs >= 20 THEN 0.25::DOUBLE WHEN refs > 0 THEN 0.15 ELSE 0 END + CASE WHEN {contains_any('text', ['data', 'sample', 'method', 'model', 'archive'])} THEN 0.2 ELSE 0 END + CASE WHEN {contains_any('text', ['robustness', 'sensitivity', 'replication'])} THEN 0.2 ELSE 0 END + CASE WHEN {contains_any('text', ['limitation', 'uncertainty', 'bias'])} THEN 0.15 ELSE 0 END + 0.1) AS c,
  CASE WHEN {contains_any('text', ['preregister', 'pre-register', 'registered report'])} THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN {contains_any('text', ['data available', 'replication data', 'open data'])} THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN {contains_any('text', ['code available', 'github', 'osf', 'dataverse'])} THEN 0.2::DOUBLE ELSE 0 END AS d,
  least(1.0::DOUBLE, CASE WHEN cited <= 0 THEN 0 ELSE cited / (12.0::DOUBLE * 7) END) AS e FROM w)"""
TYPED = f"typed AS (SELECT *, {type_case('hay', 'kind', 'refs', chr(39) * 2, chr(39) * 2)} AS document_type FROM (SELECT *, concat_ws(' ', lower(source), lower(text), kind) AS hay FROM tp))"
ECONOMICS = P.DOMAIN_PREFERENCES["economics"]
FITS = f"""{TRUST}, {TYPED}, {TRAITS},
f0 AS (SELECT typed.*, family, risk, surface, role, list_filter([CASE WHEN retracted THEN 'integrity_gate_failed' END, CASE WHEN document_type = 'unknown_unstructured_text' THEN 'missing_document_type' END, CASE WHEN surface >= 0.7 THEN 'high_adversarial_surface' END], lambda x: x IS NOT NULL) AS flags,
  CASE WHEN list_contains({text_list(ECONOMICS[0])}, document_type) THEN 1.0::DOUBLE WHEN document_type = 'unknown_unstructured_text' THEN 0.25 ELSE 0.45 END AS tf,
  CASE WHEN list_contains({text_list(ECONOMICS[1])}, family) THEN 1.0::DOUBLE WHEN family = 'unknown' THEN 0.35 ELSE 0.55 END AS ff FROM typed JOIN traits USING (document_type)),
f1 AS (SELECT *, tf * 0.18::DOUBLE + ff * 0.12::DOUBLE + c * 0.22::DOUBLE + a * 0.15::DOUBLE + b * 0.13::DOUBLE + greatest(0, 1 - greatest(surface, risk * 0.8::DOUBLE)) * 0.2::DOUBLE AS base,
  0.08::DOUBLE * len(list_filter(flags, lambda x: x <> 'high_adversarial_surface')) + CASE WHEN surface >= 0.7 THEN 0.18::DOUBLE ELSE 0 END AS penalty FROM f0),
f2 AS (SELECT *, CASE WHEN retracted THEN 0 ELSE round(greatest(0, least(1, base - penalty)), 6) END AS score FROM f1),
fits AS (SELECT *, CASE WHEN retracted THEN 'blocked' WHEN surface >= 0.7 AND score < 0.5 THEN 'quarantine_review' WHEN score >= 0.75 THEN 'strong_fit' WHEN score >= 0.55 THEN 'moderate_fit' WHEN score >= 0.35 THEN 'weak_fit' ELSE 'low_fit' END AS tier FROM f2)"""
POLICIES = "policies(document_type, strategy, most, least, forced) AS (VALUES " + ", ".join(f"('{n}', '{s}', {m or 'NULL'}::INT, {o or 'NULL'}::INT, {'NULL' if f is None else f}::INT)" for n, (s, m, o, f) in fixed.CHUNK_POLICIES.items()) + ")"
POLICY = f"""{WORKS}, tp AS (SELECT * FROM w), {TYPED}, {POLICIES},
pol AS (SELECT doc_id, text, document_type, strategy, least({CHUNK_TOKENS}, coalesce(most, {CHUNK_TOKENS})) AS chunk_tokens, coalesce(forced, greatest({OVERLAP_TOKENS}, coalesce(policies.least, 0))) AS o FROM typed JOIN policies USING (document_type)),
policy AS (SELECT *, CASE WHEN o >= chunk_tokens THEN chunk_tokens // 4 ELSE o END AS overlap_tokens FROM pol)"""


def raw_marker_score(markers: list[str], divisor: float) -> str:
    hits = " + ".join(f"(length(low) - length(replace(low, '{m}', ''))) / {len(m)}.0::DOUBLE" for m in markers)
    return f"least(1.0::DOUBLE, ({hits}) / {divisor}::DOUBLE)"


def syntax_values() -> dict[str, str]:
    s = {n: raw_marker_score(m, d) for n, (m, d) in fixed.SIGNAL_MARKERS.items()}
    out = {c: f"least(1.0::DOUBLE, len(list_intersect(list_distinct(ws), {text_list([*terms, *fixed.SYNTAX_DOCUMENT_TERMS[c]])})) / 4.0::DOUBLE)" for c, terms in fixed.SYNTAX_QUERY_TERMS.items()}
    matched = {n: f"CASE WHEN regexp_matches(raw, '{pattern(p)}') THEN {v}::DOUBLE ELSE 0 END" for n, p, v in (("quantity", fixed.QUANTITY, 0.8), ("speaker", fixed.SPEAKER, 0.85), ("definition", fixed.DEFINITION, 0.85))}
    floors = {"method_detail": [s["method_signal"]], "limitation_caveat": [s["limitation_signal"], f"0.8::DOUBLE * {s['uncertainty_signal']}"], "quantitative_result": [s["evidence_specificity"], matched["quantity"]], "generic_claim": [s["claim_density"]], "dialogue_or_transcript": [matched["speaker"]], "definition_or_taxonomy": [matched["definition"]]}
    return {c: f"round(greatest({', '.join([v, *floors.get(c, [])])}), 6)" for c, v in out.items()}


def targets() -> dict[str, str]:
    raw = {c: [f"least(1.0::DOUBLE, len(list_intersect(list_distinct(ws), {text_list(terms)})) / 3.0::DOUBLE)"] for c, terms in fixed.SYNTAX_QUERY_TERMS.items()}
    for phrases, c, least in fixed.SYNTAX_QUERY_PHRASES:
        raw[c].append(f"CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN {least}::DOUBLE ELSE 0 END")
    return {c: f"round(greatest({', '.join([*v, '0'])}), 6)" for c, v in raw.items()}


SANITIZE = "html"
for _p in [p for patterns in fixed.SAFETY_PATTERNS.values() for p in patterns]:
    SANITIZE = f"regexp_replace({SANITIZE}, '(?is){pattern(_p)}', '[removed unsafe instruction]', 'g')"
SANITIZE = f"trim(regexp_replace(regexp_replace({SANITIZE}, '[\\p{{Cf}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g'), '\\s+', ' ', 'g'))"
REMOVED = []
_before = "html"
for _name, _patterns in fixed.SAFETY_PATTERNS.items():
    _after = _before
    for _p in _patterns:
        _after = f"regexp_replace({_after}, '(?is){pattern(_p)}', '[removed unsafe instruction]', 'g')"
    REMOVED.append(f"CASE WHEN {_after} <> {_before} THEN '{_name}' END")
    _before = _after

CLAIM_KEYS = f"""{claims()},
keyed AS (SELECT k.*, array_to_string(list_sort(list_distinct(list_filter(ws, lambda x: length(x) >= 5 AND NOT list_contains({text_list(fixed.CLAIM_KEY_STOP)}, x))))[1:8], ' ') AS claim_key, lower(source) AS fingerprint FROM kept k JOIN documents USING (doc_id)),
named AS (SELECT * FROM keyed WHERE claim_key <> ''),
sets AS (SELECT claim_key, list_sort(list_distinct(ws)) AS s, count(*) AS m FROM named GROUP BY ALL),
near AS (SELECT claim_key, sum(n) AS near FROM (SELECT claim_key, CASE WHEN len(s) > 0 THEN m * (m - 1) // 2 ELSE 0 END AS n FROM sets UNION ALL
  SELECT x.claim_key, x.m * y.m FROM sets x JOIN sets y ON x.claim_key = y.claim_key AND x.s < y.s WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.72) GROUP BY claim_key),
gc AS (SELECT claim_key, count(*) AS claims, count(*) FILTER (stance IN ('supportive', 'descriptive', 'mixed')) AS support, count(DISTINCT fingerprint) FILTER (stance IN ('supportive', 'descriptive', 'mixed')) AS independent,
  count(*) FILTER (stance = 'critical') AS contradictions, avg({contains_any('sentence', fixed.DEPENDENCE_MARKERS)}::INT) AS markers FROM named GROUP BY claim_key),
ge AS (SELECT *, support - independent AS echoes, round(least(1.0::DOUBLE, (support - independent) / claims * 0.35::DOUBLE + (1 - independent / claims) * 0.25::DOUBLE + CASE WHEN claims > 1 THEN near / (claims * (claims - 1) // 2) ELSE 0 END * 0.25::DOUBLE + markers * 0.15::DOUBLE), 6) AS echo_risk FROM gc JOIN near USING (claim_key)),
grp AS (SELECT claim_key, claims, support, independent, contradictions, echoes, echo_risk, CASE WHEN echo_risk >= 0.45 AND independent <= 1 THEN 'adversarial_echo_risk' WHEN contradictions > 0 THEN 'conflicted' WHEN independent >= 2 THEN 'independently_corroborated' WHEN independent = 1 THEN 'single_source_or_dependent' ELSE 'no_support' END AS verdict FROM ge)"""

FOCUS = f"list_filter(list_distinct({words('text')}), lambda w: length(w) >= 4 AND NOT list_contains({text_list(fixed.GENERIC_QUERY_TERMS)}, w))"
FOLDED = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"

ORACLE_SQL = {
    "source_trust": f"""WITH {TRUST},
s AS (SELECT doc_id, retracted, CASE WHEN retracted THEN 0 ELSE round((a * 0.2::DOUBLE + b * 0.25::DOUBLE + c * 0.25::DOUBLE + d * 0.15::DOUBLE + e * 0.15::DOUBLE) / 1.0, 6) END AS source_trust FROM tp)
SELECT doc_id, source_trust, CASE WHEN retracted THEN 'blocked' WHEN source_trust >= 0.75 THEN 'strong' WHEN source_trust >= 0.55 THEN 'moderate' WHEN source_trust >= 0.35 THEN 'limited' ELSE 'low' END AS trust_tier FROM s""",
    "document_profiles": f"""WITH w AS (SELECT 'd' || doc_id AS work_id, concat_ws(' ', lower(source), lower(text)) AS hay, '' AS kind, 0 AS refs, '' AS url, '' AS prov FROM documents
  UNION ALL SELECT 'p' || page_id, concat_ws(' ', lower(html), lower(url), 'web'), '', 0, coalesce(url, ''), 'web' FROM pages),
t AS (SELECT work_id, {type_case('hay', 'kind', 'refs', 'url', 'prov')} AS document_type FROM w), {TRAITS}
SELECT work_id, document_type, family AS evidence_family, authority AS authority_signal, surface AS adversarial_surface, role AS recommended_decision_role FROM t JOIN traits USING (document_type)""",
    "domain_fit": f"WITH {FITS} SELECT doc_id, document_type, score AS domain_fit_score, tier AS domain_fit_tier, array_to_string(flags, ',') AS gate_flags FROM fits",
    "profile_summary": f"WITH {FITS} SELECT document_type, family AS evidence_family, tier AS domain_fit_tier, count(*) AS n, round(avg(score), 5) AS mean_fit FROM fits GROUP BY ALL",
    "use_policies": f"""WITH {safety('documents', 'doc_id', 'text')}, {FITS},
u AS (SELECT CASE WHEN decision IN ('block', 'quarantine') THEN 'audit' WHEN retracted THEN 'audit' WHEN family = 'public_opinion' THEN 'audit,aggregate_public_opinion' WHEN tier IN ('blocked', 'quarantine_review') THEN 'audit' WHEN decision = 'sanitize' THEN 'audit,generator_context,sanitized_context' ELSE 'audit,generator_context' END AS allowed_uses,
  CASE WHEN decision IN ('block', 'quarantine') THEN 'safety_' || decision WHEN retracted THEN 'retrieval_decision_reject' WHEN family = 'public_opinion' THEN 'public_opinion_aggregate_only' WHEN tier IN ('blocked', 'quarantine_review') THEN 'domain_fit_' || tier ELSE 'generator_context_allowed' END AS use_reason FROM fits JOIN scanned ON k = doc_id)
SELECT allowed_uses, use_reason, count(*) AS n FROM u GROUP BY ALL""",
    "chunk_policies": f"WITH {POLICY} SELECT doc_id, document_type, strategy, chunk_tokens, overlap_tokens FROM policy",
    "chunk_decisions": f"""WITH {POLICY},
x AS (SELECT doc_id, document_type, chunk_tokens, len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x0b\\x85\\p{{Z}}]+'), lambda z: z <> '')) AS n, coalesce(regexp_matches(trim(text), '[.!?]$'), false) AS al FROM policy),
y AS (SELECT *, round(least(1, greatest(0, CASE WHEN document_type IN ('social_media_post', 'forum_comment') THEN 0.8::DOUBLE WHEN document_type = 'web_page' THEN 0.7 WHEN document_type = 'unknown_unstructured_text' THEN 0.6 WHEN document_type IN ('archival_primary_source', 'transcript') THEN 0.4 ELSE 0.25 END + CASE WHEN al THEN -0.15::DOUBLE ELSE 0.15 END)), 6) AS contamination,
  CASE WHEN n <= 0 THEN 0 ELSE round(least(1, CASE WHEN al THEN 0.65::DOUBLE ELSE 0.25 END + CASE WHEN n / chunk_tokens BETWEEN 0.35 AND 1.05 THEN 0.25::DOUBLE WHEN n / chunk_tokens < 0.35 THEN 0.15 ELSE 0.05 END + 0.1::DOUBLE), 6) END AS containment FROM x)
SELECT doc_id, containment, contamination, CASE WHEN contamination >= 0.75 THEN 'safety_sensitive' WHEN containment >= 0.85 AND contamination < 0.5 THEN 'strong_boundary_context' WHEN containment >= 0.6 THEN 'usable_with_review' ELSE 'weak_boundary_or_size_fit' END AS tier,
  al AND contamination < 0.65 AND document_type NOT IN ('social_media_post', 'forum_comment', 'web_page') AS expand FROM y""",
    "query_intents": "WITH t AS (SELECT item_id AS query_id, " + words("text") + " AS ws FROM benchmark) SELECT query_id, CASE " + " ".join(f"WHEN list_has_any(ws, {text_list(v)}) THEN '{n}'" for n, v in fixed.QUERY_INTENTS.items()) + " ELSE 'substantive' END AS intent FROM t",
    "query_syntax": f"""WITH t AS (SELECT item_id AS query_id, {words('text')} AS ws, lower(coalesce(text, '')) AS low FROM benchmark),
v AS (SELECT query_id, [{', '.join(targets().values())}] AS v FROM t), g AS (SELECT query_id, CASE WHEN list_max(v) > 0 THEN v ELSE {[0.4 if c == 'generic_claim' else 0.0 for c in syntax.CATEGORIES]}::DOUBLE[] END AS v FROM v)
SELECT query_id, unnest({text_list(syntax.CATEGORIES)}) AS category, unnest(v) AS target FROM g""",
    "syntax_profile": f"""WITH t AS (SELECT {words('text')} AS ws, coalesce(text, '') AS raw, lower(coalesce(text, '')) AS low FROM documents), v AS (SELECT [{', '.join(syntax_values().values())}] AS v FROM t),
e AS (SELECT unnest({text_list(syntax.CATEGORIES)}) AS category, unnest(v) AS x FROM v), c AS (SELECT category, count(*) FILTER (x >= 0.25) AS texts, ln((count(*) + 1.0) / (count(*) FILTER (x >= 0.25) + 1.0)) + 1.0 AS r FROM e GROUP BY category)
SELECT category, texts, round(r / max(r) OVER (), 6) AS weight FROM c""",
    "focus_coverage": f"""WITH q AS (SELECT item_id AS query_id, {FOCUS} AS f FROM benchmark), qe AS (SELECT query_id, len(f) AS n, unnest(f) AS term FROM q), d AS (SELECT doc_id, unnest(list_distinct({words('text')})) AS term FROM documents)
SELECT query_id, doc_id, round(count(*) / min(n), 6) AS focus FROM qe JOIN d USING (term) GROUP BY ALL""",
    "sanitized_pages": f"""WITH {safety('pages', 'page_id', 'html', '0.1::DOUBLE')}, j AS (SELECT page_id, decision, categories, html, concat_ws(',', {', '.join(REMOVED)}) AS names, {SANITIZE} AS clean FROM pages JOIN scanned ON k = page_id)
SELECT page_id, decision, CASE WHEN decision <> 'sanitize' THEN '' WHEN names = '' THEN categories ELSE names END AS removed, sha1(CASE WHEN decision = 'sanitize' THEN clean ELSE html END) AS sanitized_sha1 FROM j""",
    "corroboration_groups": f"WITH {CLAIM_KEYS} SELECT * FROM grp",
    "corroboration_verdicts": f"WITH {CLAIM_KEYS} SELECT verdict, count(*) AS groups, sum(support)::BIGINT AS support, max(echo_risk) AS max_echo_risk FROM grp GROUP BY verdict",
    "best_claims": f"WITH {claims()}, r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS claims, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, position) AS nth FROM kept) SELECT doc_id, claims, position::INT AS position, confidence, stance FROM r WHERE nth = 1",
    "language_aliases": "SELECT CASE " + " ".join(f"WHEN list_contains({text_list(v)}, lower(trim(coalesce(lang, '')))) THEN '{k}'" for k, v in fixed.LANGUAGE_NAMES.items()) + " ELSE lower(trim(coalesce(lang, ''))) END AS language, count(*) AS n FROM documents GROUP BY 1",
    "compact_texts": f"WITH f AS (SELECT doc_id, {FOLDED} AS t FROM documents) SELECT doc_id, sha1(CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(regexp_replace(left(t, 120), '\\s+\\S*$', ''), '[.,;: ]+$', '') || '.' END) AS compact_sha1 FROM f",
    "external_queries": "SELECT item_id AS query_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}_\\s./-]', ' ', 'g'), '\\s+', ' ', 'g')) AS query FROM benchmark",
    "plural_matches": f"""WITH {BM25}, q AS (SELECT item_id AS query_id, list_distinct({words('text')}) AS want FROM benchmark)
SELECT query_id, doc_id, len(list_filter(want, lambda x: list_contains(ws, x) OR (x LIKE '%s' AND length(x) > 3 AND list_contains(ws, x[:-2])) OR list_contains(ws, x || 's')))::INT AS matched FROM bm JOIN q USING (query_id) JOIN toks USING (doc_id) WHERE rank <= 10""",
}
