"""Registered queries of composed answers, their verification and their grounding, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .functions import text as T
from .functions.storage import materialise
from .operators import context, evidence, grounding, retrieval
from .oracles import BM25, OVERLAP, SIGNALS, claims, contains_any, safety, text_list, words

EVIDENCE_PER_QUERY = 5
LEAST_SHARE = 0.8


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Composed answers to the benchmark texts, in three variants, and their evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    top = materialise(retrieval.bm25_top_k(queries, docs, EVIDENCE_PER_QUERY), "top")
    found = materialise(grounding.collected(top, docs, EVIDENCE_PER_QUERY), "evidence")
    return materialise(grounding.perturbed(grounding.composed(queries, found)), "answers"), found


def composed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, _ = _answers(spark, sf_dir)
    return answers.select("query_id", "variant", F.size(T.sentences(F.col("answer"))).alias("sentences"), F.sha1("answer").alias("answer_sha1"))


def answer_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.verified(*_answers(spark, sf_dir))


def answer_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.faithfulness(*_answers(spark, sf_dir))


def faithfulness_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean measures of each variant, its place, and how many answers have over half of their sentences unsupported."""
    each = answer_faithfulness(spark, sf_dir)
    names = ["citation_validity", "evidence_token_support", "claim_backing_rate", "unsupported_sentence_rate", "faithfulness_score"]
    board = each.groupBy("variant").agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names], F.count_if(F.col("unsupported_sentence_rate") > 0.5).alias("failures"))
    order = grounding.Window.orderBy(F.desc("faithfulness_score"), "variant")  # a row a variant
    return board.withColumn("place", F.row_number().over(order))


def sentence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of the assistant's turns with the document sentence that has most of its words."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    sentences = turns.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))
    return grounding.aligned(sentences, spark.read.parquet(f"{sf_dir}/documents.parquet"), ["conv_id", "turn", "position"], LEAST_SHARE)


def _packets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packets of each query's ten best documents; a labelled document's claims have the stance of its review."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    tokens = materialise(retrieval.tokenised(docs), "tokens")
    top = materialise(retrieval.bm25_top_k(queries, docs, 10, tokens), "top")
    overlap = retrieval.overlap_scores(queries, top, docs, tokens)
    wanted = materialise(docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi"), "wanted")
    scanned = evidence.safety_scan(wanted, "text").select("doc_id", F.col("decision").alias("safety_decision"))
    most = top.groupBy("query_id").agg(F.max("score").alias("most"))
    rows = top.join(most, "query_id").withColumn("relevance", F.round(F.col("score") / F.col("most"), 6)).drop("most").join(overlap, ["query_id", "doc_id"]).join(evidence.chunk_signals(wanted), "doc_id").join(scanned, "doc_id")
    review = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "mixed").otherwise("supportive")
    said = evidence.claims(wanted).join(wanted.select("doc_id", F.lower("source").alias("fingerprint")), "doc_id").join(labels.select("doc_id", review.alias("review")), "doc_id", "left")
    said = materialise(said.withColumn("stance", F.coalesce("review", "stance")), "claims")
    return context.packets(materialise(rows, "rows"), said, EVIDENCE_PER_QUERY)


def context_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packets(spark, sf_dir)[0]


def packet_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packets(spark, sf_dir)[1].select("query_id", "groups", "max_independent", "support", "contradictions", "max_echo_risk", "overall_verdict")


QUERIES = {f.__name__: f for f in (composed_answers, answer_verification, answer_faithfulness, faithfulness_board, sentence_alignment, context_packets, packet_corroboration)}


def content(text: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter({words(text)}, lambda w: length(w) >= 4 AND NOT list_contains({text_list(stop)}, w)))"


def sentences(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def ordered_focus(text: str) -> str:
    ws = f"list_filter({words(text)}, lambda w: length(w) >= 4 AND NOT list_contains({text_list(fixed.GENERIC_QUERY_TERMS)}, w))"
    return f"(list_transform(list_sort(list_transform(list_distinct({ws}), lambda w: struct_pack(p := list_position({ws}, w), w := w))), lambda x: x.w))[1:8]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ANSWERS = f"""{BM25}, {claims().replace("toks AS", "ctoks AS").replace("FROM toks", "FROM ctoks")}, {safety('documents', 'doc_id', 'text')},
surest AS (SELECT doc_id, sentence, stance FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, position) = 1),
found AS (SELECT query_id, 'C' || rank AS citation_id, rank, doc_id, CASE WHEN length(coalesce(text, '')) > 280 THEN trim(left(text, 280)) || '...' ELSE coalesce(text, '') END AS preview, sentence AS claim, stance, decision AS safety_decision, decision NOT IN ('block', 'quarantine') AS allowed
  FROM bm JOIN documents USING (doc_id) JOIN scanned ON k = doc_id LEFT JOIN surest USING (doc_id) WHERE rank <= {EVIDENCE_PER_QUERY}),
lines AS (SELECT query_id, string_agg(CASE WHEN claim IS NOT NULL THEN citation_id || ' reports a ' || stance || ' claim: ' || claim ELSE citation_id || ' contributes contextual evidence from document ' || doc_id || '.' END, ' ' ORDER BY rank) AS said FROM found WHERE rank <= 3 GROUP BY query_id),
focus AS (SELECT item_id AS query_id, {ordered_focus('text')} AS focus FROM benchmark),
base AS (SELECT query_id, CASE WHEN said IS NULL THEN {quoted(grounding.NOTHING)} ELSE {quoted(grounding.OPENING)} || CASE WHEN len(focus) > 0 THEN ' The retrieval centered on: ' || array_to_string(focus, ', ') || '.' ELSE '' END || ' ' || said END AS answer FROM focus LEFT JOIN lines USING (query_id)),
answers AS (SELECT query_id, 'composed' AS variant, answer FROM base UNION ALL SELECT query_id, 'renumbered', regexp_replace(answer, '\\bC([0-9]+)\\b', 'C1\\1', 'g') FROM base UNION ALL SELECT query_id, 'uncited', regexp_replace(answer, '\\bC[0-9]+\\b', 'It', 'g') FROM base)"""


def reports(stop: list[str], only_allowed: bool) -> str:
    usable = "coalesce(allowed, false)" if only_allowed else "allowed IS NOT NULL"
    return f"""sents2 AS (SELECT query_id, variant, unnest(CASE WHEN len(ss) > 0 THEN ss ELSE [''] END) AS sentence, generate_subscripts(CASE WHEN len(ss) > 0 THEN ss ELSE [''] END, 1) AS position FROM (SELECT *, {sentences('answer')} AS ss FROM answers)),
w2 AS (SELECT *, {content('sentence', stop)} AS cw, regexp_extract_all(sentence, '\\bC[0-9]+\\b') AS cited FROM sents2),
known AS (SELECT query_id, citation_id, allowed, claim IS NOT NULL AS claimed, {content("concat_ws(' ', preview, claim)", stop)} AS has FROM found),
c2 AS (SELECT query_id, variant, position, sentence, cw, unnest(CASE WHEN len(cited) > 0 THEN cited ELSE [NULL] END) AS citation_id FROM w2),
j2 AS (SELECT c2.*, allowed, claimed, has FROM c2 LEFT JOIN known USING (query_id, citation_id)),
rep AS (SELECT query_id, variant, position, any_value(sentence) AS sentence, any_value(len(cw)) AS n_words, count(citation_id) AS n_cited, count(allowed) AS n_valid, len(list_distinct(flatten(list(CASE WHEN {usable} THEN list_intersect(cw, has) ELSE [] END)))) AS n_covered,
  coalesce(bool_or({usable} AND claimed), false) AS attached, list(DISTINCT citation_id) FILTER (citation_id IS NOT NULL AND allowed IS NULL) AS invalid, list(DISTINCT citation_id) FILTER (NOT allowed) AS disallowed FROM j2 GROUP BY query_id, variant, position)"""


def joined(c: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce({c}, []))))), ','), '')"


FAITH = f"""WITH {ANSWERS}, {reports(grounding.SCORE_STOP, False)},
s AS (SELECT *, CASE WHEN n_words > 0 THEN n_covered / n_words WHEN n_cited = 0 THEN 1.0 ELSE 0.0 END AS sup FROM rep),
b AS (SELECT *, CASE WHEN n_valid > 0 AND (sup >= 0.12 OR attached) THEN 1.0 ELSE 0.0 END AS backed FROM s),
f AS (SELECT query_id, variant, round(avg(CASE WHEN n_cited > 0 THEN round(n_valid / n_cited, 6) ELSE 0 END), 6) AS citation_validity, round(avg(round(sup, 6)), 6) AS evidence_token_support, round(avg(backed), 6) AS claim_backing_rate, round(avg(1 - backed), 6) AS unsupported_sentence_rate FROM b GROUP BY ALL),
faith AS (SELECT *, round(citation_validity * 0.35::DOUBLE + evidence_token_support * 0.35::DOUBLE + claim_backing_rate * 0.3::DOUBLE, 6) AS faithfulness_score FROM f)"""

PACKETS = f"""{OVERLAP}, {claims().replace("toks AS", "ctoks AS").replace("FROM toks", "FROM ctoks")}, {safety('documents', 'doc_id', 'text')},
sig AS (SELECT doc_id, source, {SIGNALS} FROM documents),
ev AS (SELECT ov.query_id, ov.doc_id, old_rank AS rank, bm_score AS score, overlap, round(bm_score / max(bm_score) OVER (PARTITION BY query_id), 6) AS relevance, limitation_signal, method_signal, evidence_specificity, source, decision IN ('block', 'quarantine') AS unsafe FROM ov JOIN sig USING (doc_id) JOIN scanned ON k = doc_id WHERE old_rank <= 10),
said AS (SELECT kept.*  REPLACE (CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'mixed' WHEN quality IS NOT NULL THEN 'supportive' ELSE stance END AS stance) FROM kept LEFT JOIN labels USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM ev)),
named AS (SELECT query_id, doc_id, sentence, stance, ws, lower(source) AS fingerprint, array_to_string(list_sort(list_distinct(list_filter(ws, lambda x: length(x) >= 5 AND NOT list_contains({text_list(fixed.CLAIM_KEY_STOP)}, x))))[1:8], ' ') AS claim_key FROM said JOIN ev USING (doc_id) WHERE NOT unsafe),
nk AS (SELECT * FROM named WHERE claim_key <> ''),
sets AS (SELECT query_id, claim_key, list_sort(list_distinct(ws)) AS s, count(*) AS m FROM nk GROUP BY ALL),
near AS (SELECT query_id, claim_key, sum(n) AS near FROM (SELECT query_id, claim_key, CASE WHEN len(s) > 0 THEN m * (m - 1) // 2 ELSE 0 END AS n FROM sets UNION ALL
  SELECT x.query_id, x.claim_key, x.m * y.m FROM sets x JOIN sets y ON x.query_id = y.query_id AND x.claim_key = y.claim_key AND x.s < y.s WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.72) GROUP BY ALL),
gc AS (SELECT query_id, claim_key, count(*) AS claims, count(*) FILTER (stance IN ('supportive', 'descriptive', 'mixed')) AS support, count(DISTINCT fingerprint) FILTER (stance IN ('supportive', 'descriptive', 'mixed')) AS independent,
  count(*) FILTER (stance = 'critical') AS contradictions, avg({contains_any('sentence', fixed.DEPENDENCE_MARKERS)}::INT) AS markers FROM nk GROUP BY ALL),
ge AS (SELECT *, round(least(1.0::DOUBLE, (support - independent) / claims * 0.35::DOUBLE + (1 - independent / claims) * 0.25::DOUBLE + CASE WHEN claims > 1 THEN near / (claims * (claims - 1) // 2) ELSE 0 END * 0.25::DOUBLE + markers * 0.15::DOUBLE), 6) AS echo_risk FROM gc JOIN near USING (query_id, claim_key)),
grp AS (SELECT *, CASE WHEN echo_risk >= 0.45 AND independent <= 1 THEN 'adversarial_echo_risk' WHEN contradictions > 0 THEN 'conflicted' WHEN independent >= 2 THEN 'independently_corroborated' WHEN independent = 1 THEN 'single_source_or_dependent' ELSE 'no_support' END AS verdict FROM ge)"""

ORACLE_SQL = {
    "packet_corroboration": f"""WITH {PACKETS},
o AS (SELECT query_id, count(*) AS groups, max(independent) AS max_independent, sum(support)::BIGINT AS support, sum(contradictions)::BIGINT AS contradictions, max(echo_risk) AS max_echo_risk, bool_or(verdict = 'adversarial_echo_risk') AS echo FROM grp GROUP BY query_id)
SELECT query_id, groups, max_independent, support, contradictions, max_echo_risk, CASE WHEN echo THEN 'adversarial_echo_risk' WHEN contradictions > 0 THEN 'conflicted' WHEN max_independent >= 2 THEN 'independently_corroborated' WHEN support > 0 THEN 'single_source_or_dependent' ELSE 'no_support' END AS overall_verdict FROM o""",
    "context_packets": f"""WITH {PACKETS},
cor AS (SELECT DISTINCT query_id, doc_id FROM nk JOIN grp USING (query_id, claim_key) WHERE verdict = 'independently_corroborated'),
bc AS (SELECT doc_id, stance, ws FROM said QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, position) = 1),
tc AS (SELECT doc_id, stance, list(t) AS topics FROM (SELECT doc_id, stance, t, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, t) AS r FROM (SELECT doc_id, stance, unnest(list_filter(ws, lambda w: length(w) >= 4)) AS t FROM bc) GROUP BY doc_id, stance, t) WHERE r <= 8 GROUP BY doc_id, stance),
q AS (SELECT query_id, doc_id, stance, topics FROM ev JOIN tc USING (doc_id) WHERE NOT unsafe),
link AS (SELECT DISTINCT a.query_id, a.doc_id FROM q a JOIN q b ON a.query_id = b.query_id AND a.doc_id <> b.doc_id AND ((a.stance = 'supportive' AND b.stance IN ('critical', 'mixed')) OR (b.stance = 'supportive' AND a.stance IN ('critical', 'mixed'))) AND len(list_intersect(a.topics, b.topics)) >= 2),
r AS (SELECT ev.*, CASE WHEN bc.stance = 'critical' OR link.doc_id IS NOT NULL THEN 'contradicting_source' WHEN limitation_signal >= 0.35 THEN 'limitation_or_caveat' WHEN method_signal >= 0.35 THEN 'method_detail' WHEN cor.doc_id IS NOT NULL THEN 'corroborating_source' WHEN overlap >= 0.25 OR relevance > 0 THEN 'direct_evidence' ELSE 'contextual_background' END AS role
  FROM ev LEFT JOIN bc USING (doc_id) LEFT JOIN link ON link.query_id = ev.query_id AND link.doc_id = ev.doc_id LEFT JOIN cor ON cor.query_id = ev.query_id AND cor.doc_id = ev.doc_id WHERE NOT unsafe),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY score DESC, relevance DESC, evidence_specificity DESC, rank) = 1 AS first FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, CASE WHEN first THEN list_position({text_list(context.ROLE_ORDER)}, role) ELSE 0 END, score DESC, relevance DESC, evidence_specificity DESC, rank) AS place FROM f),
x AS (SELECT query_id, count(*) FILTER (unsafe) AS excluded FROM ev GROUP BY query_id)
SELECT query_id, doc_id, place, role, CASE role WHEN 'contradicting_source' THEN 'use_for_conflict_or_caveat' WHEN 'limitation_or_caveat' THEN 'use_for_limitations' WHEN 'method_detail' THEN 'use_for_method_context' ELSE 'use_as_supporting_evidence' END AS allowed_use, excluded FROM p JOIN x USING (query_id) WHERE place <= {EVIDENCE_PER_QUERY}""",
    "composed_answers": f"WITH {ANSWERS} SELECT query_id, variant, len({sentences('answer')})::INT AS sentences, sha1(answer) AS answer_sha1 FROM answers",
    "answer_verification": f"""WITH {ANSWERS}, {reports(grounding.CHECK_STOP, True)},
r AS (SELECT query_id, variant, count(*) AS sentences, count(*) FILTER (n_words > 0 AND NOT starts_with(lower(sentence), {quoted(grounding.EXEMPT[0])}) AND NOT starts_with(lower(sentence), {quoted(grounding.EXEMPT[1])}) AND NOT (n_valid > 0 AND (n_covered / n_words >= 0.12 OR attached))) AS unsupported,
  {joined('invalid')} AS invalid_citations, {joined('disallowed')} AS disallowed_citations FROM rep GROUP BY query_id, variant),
l AS (SELECT a.query_id, variant, string_agg(DISTINCT citation_id, ',' ORDER BY citation_id) AS blocked FROM answers a JOIN found f ON a.query_id = f.query_id AND NOT allowed AND contains(answer, citation_id) GROUP BY ALL),
e AS (SELECT r.*, coalesce(blocked, '') AS blocked_leaks FROM r LEFT JOIN l USING (query_id, variant)),
n AS (SELECT *, concat_ws(',', CASE WHEN invalid_citations <> '' THEN 'invalid_citations' END, CASE WHEN disallowed_citations <> '' THEN 'disallowed_citations' END, CASE WHEN unsupported > 0 THEN 'unsupported_sentences' END, CASE WHEN blocked_leaks <> '' THEN 'blocked_or_quarantined_evidence_leaked' END) AS failures FROM e)
SELECT query_id, variant, CASE WHEN failures = '' THEN 'pass' ELSE 'fail' END AS status, failures, CASE WHEN invalid_citations = '' THEN 1.0::DOUBLE ELSE 0.0 END AS citation_validity, invalid_citations, disallowed_citations, blocked_leaks, unsupported, sentences FROM n""",
    "answer_faithfulness": f"{FAITH} SELECT * FROM faith",
    "faithfulness_board": f"""{FAITH}, g AS (SELECT variant, count(*) AS queries, {', '.join(f'round(avg({n}), 6) AS {n}' for n in ('citation_validity', 'evidence_token_support', 'claim_backing_rate', 'unsupported_sentence_rate', 'faithfulness_score'))}, count(*) FILTER (unsupported_sentence_rate > 0.5) AS failures FROM faith GROUP BY variant)
SELECT *, row_number() OVER (ORDER BY faithfulness_score DESC, variant) AS place FROM g""",
    "sentence_alignment": f"""WITH a AS (SELECT conv_id, turn, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS position FROM (SELECT *, {sentences('text')} AS ss FROM conversations WHERE role = 'assistant')),
aw AS (SELECT conv_id, turn, position, list_sort({content('sentence', grounding.CHECK_STOP)}) AS cw FROM a),
d AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS dp FROM (SELECT doc_id, {sentences('text')} AS ss FROM documents)),
dw AS (SELECT has, min(row(doc_id, dp)) AS first FROM (SELECT doc_id, dp, list_sort({content('sentence', grounding.CHECK_STOP)}) AS has FROM d) WHERE len(has) > 0 GROUP BY has),
q AS (SELECT DISTINCT cw FROM aw WHERE len(cw) > 0),
qt AS (SELECT cw, unnest(cw) AS w FROM q), dt AS (SELECT has, first, unnest(has) AS w FROM dw),
m AS (SELECT cw, has, first, count(*) AS c FROM qt JOIN dt USING (w) GROUP BY ALL HAVING count(*) >= ceil(len(cw) * {LEAST_SHARE}::DOUBLE)),
b AS (SELECT cw, round(c / len(cw), 6) AS share, first FROM m QUALIFY row_number() OVER (PARTITION BY cw ORDER BY round(c / len(cw), 6) DESC, first) = 1)
SELECT conv_id, turn, position::INT AS position, len(cw)::INT AS n_words, struct_extract(first, 1) AS doc_id, struct_extract(first, 2)::INT AS doc_position, share FROM aw LEFT JOIN b USING (cw)""",
}
