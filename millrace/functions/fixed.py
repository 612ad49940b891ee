"""Word lists, patterns and weights that results depend on."""

# Words that the tokenizer drops.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "its", "main", "of", "on", "or", "that", "the", "their", "to", "what", "whether", "with"]

# Substrings that each chunk signal counts, and the count that gives 1.0.
SIGNAL_MARKERS = {
    "claim_density": (["find", "finds", "found", "show", "shows", "suggest", "suggests", "argue", "argues", "evidence", "effect", "significant"], 8.0),
    "method_signal": (["data", "dataset", "sample", "model", "method", "identification", "regression", "interview", "archive", "ethnograph", "experiment"], 6.0),
    "limitation_signal": (["limitation", "caution", "uncertain", "bias", "confound", "cannot rule out", "not statistically", "mixed evidence", "future research"], 4.0),
    "evidence_specificity": (["percent", "percentage", "estimate", "coefficient", "confidence interval", "p-value", "case study", "from 19", "from 20", "n=", "respondents", "participants"], 5.0),
    "uncertainty_signal": (["may", "might", "suggest", "suggests", "uncertain", "mixed", "heterogeneous", "conditional", "depends"], 6.0),
}

# Weight of each importance of a section name.
SECTION_IMPORTANCE = [(["abstract", "conclusion"], 0.9), (["results", "findings", "discussion"], 0.85), (["methods", "methodology", "research design"], 0.75)]

# Patterns of the safety scanner, by category.
SAFETY_PATTERNS = {
    "instruction_override": [
        r"\bignore (all )?(previous|above|earlier) (instructions|directions|rules)\b",
        r"\bdisregard (the )?(previous|above|earlier) (instructions|directions|rules)\b",
        r"\boverride (the )?(system|developer|user) (prompt|message|instructions)\b",
        r"\breveal (the )?(system prompt|developer message|hidden instructions)\b",
        r"\bdo not (answer|follow|obey|mention|cite)\b",
        r"\byou are now\b",
        r"\bact as\b",
    ],
    "role_confusion": [
        r"(^|\n)\s*(system|developer|assistant|user)\s*:",
        r"\b(system|developer|assistant|user)\s*:",
        r"<\s*/?\s*(system|developer|assistant|user)\s*>",
        r"\[/?(system|developer|assistant|user)\]",
    ],
    "exfiltration": [
        r"\b(api[_ -]?key|token|password|credential|secret|private key)\b",
        r"\b(send|email|post|upload|exfiltrate|leak)\b.*\b(secret|token|credential|password)\b",
        r"\bchain[- ]of[- ]thought\b",
    ],
    "tool_control": [
        r"\b(run|execute|call|invoke)\b.*\b(shell|command|tool|function|python|powershell)\b",
        r"\bclick\b.*\blink\b",
        r"\bbrowse to\b",
        r"\bdownload\b.*\bfile\b",
    ],
    "hidden_text": [r"display\s*:\s*none", r"visibility\s*:\s*hidden", r"font-size\s*:\s*0", r"color\s*:\s*(white|#fff|#ffffff)", r"<!--.*?-->"],
}

# Risk of each safety category, and the scores from which a text is quarantined or sanitized.
SAFETY_WEIGHTS = {"instruction_override": 0.45, "role_confusion": 0.3, "exfiltration": 0.35, "tool_control": 0.3, "hidden_text": 0.25, "unicode_anomaly": 0.15, "retrieval_trigger_shape": 0.2}
QUARANTINE_FROM, SANITIZE_FROM = 0.55, 0.3

# The linear claim model.
CLAIM_THRESHOLD, CLAIM_INTERCEPT = 0.42, 0.18
CLAIM_WEIGHTS = {"claim_marker_count": 0.14, "finding_marker_count": 0.18, "evidence_marker_count": 0.16, "method_marker_count": 0.06, "hedge_marker_count": -0.04, "sentence_token_count": 0.01}
CLAIM_MARKERS = {
    "positive": ["associated", "effective", "improve", "improves", "increase", "increases", "lower", "reduce", "reduces", "robust", "significant", "support", "supports"],
    "negative": ["caveat", "contradict", "contradicts", "critics", "critique", "critiques", "fails", "failure", "insignificant", "mixed", "not", "rarely", "weak"],
    "finding": ["find", "finds", "found", "show", "shows", "suggest", "suggests"],
    "evidence": ["association", "associations", "effect", "effects", "evidence", "estimate", "estimates", "result", "results"],
    "method": ["experiment", "experiments", "model", "models", "specification", "specifications", "statistical", "test", "tests"],
    "hedge": ["may", "might", "could", "perhaps", "possible", "possibly"],
}

# Substrings of each public-opinion theme and stance.
THEMES = {
    "safety_risk": ["safety", "fire", "risk", "emergency", "harm", "hazard"],
    "trust_accountability": ["trust", "distrust", "clear", "transparent", "answers", "commitment"],
    "economic_material": ["jobs", "rent", "affordability", "cost", "price", "wage", "market"],
    "reliability_benefit": ["reliability", "grid", "benefit", "resilience", "backup"],
    "process_governance": ["planning board", "public meeting", "permit", "hearing", "regulator"],
    "support_condition": ["support", "if", "provided that", "commitment", "publish"],
    "opposition_concern": ["oppose", "against", "worry", "concern", "distrust", "split"],
}
SUPPORT_TERMS = ["support", "favor", "benefit", "approve", "help"]
OPPOSE_TERMS = ["oppose", "against", "reject", "distrust", "worry", "concern"]
CONDITION_TERMS = ["if", "provided that", "unless", "but", "only if", "commitment"]

# Names of languages that mean one code.
LANGUAGE_NAMES = {"en": ["en", "eng", "english"], "es": ["es", "spa", "spanish", "español"], "pt": ["pt", "por", "portuguese", "português"]}

# Query terms that say nothing about a query's focus.
GENERIC_QUERY_TERMS = ["about", "answer", "corpus", "does", "evidence", "literature", "research", "says", "this", "what", "where", "which"]

# Terms of each query intent, in order of precedence; others are substantive.
QUERY_INTENTS = {
    "method": ["method", "methods", "identification", "design", "sample", "data"],
    "limitation": ["limitation", "bias", "caveat", "weakness", "uncertainty"],
    "conflict": ["conflict", "contradict", "debate", "challenge", "mixed"],
    "current_state": ["current", "today", "recent", "latest", "market", "price"],
    "authority": ["law", "legal", "court", "statute", "filing", "contract"],
}

# Terms of each kind of wording, in queries and, besides those, in documents.
SYNTAX_QUERY_TERMS = {
    "method_detail": ["method", "methods", "methodology", "sample", "sampling", "data", "dataset", "measure", "measurement", "model", "design", "identification", "experiment", "regression", "estimate"],
    "limitation_caveat": ["limitation", "limitations", "caveat", "caveats", "bias", "uncertainty", "weakness", "threat", "validity", "confound"],
    "quantitative_result": ["number", "numbers", "share", "percent", "percentage", "rate", "effect", "estimate", "result", "results", "revenue", "market", "price", "growth"],
    "legal_authority": ["legal", "law", "court", "case", "statute", "regulation", "filing", "jurisdiction", "contract", "clause", "authority"],
    "public_expression": ["public", "opinion", "comments", "comment", "people", "residents", "community", "social", "forum", "sentiment", "stance"],
    "dialogue_or_transcript": ["transcript", "call", "speaker", "said", "statement", "interview", "hearing", "question", "answer"],
    "risk_disclosure": ["risk", "risks", "exposure", "liability", "forward", "looking", "disclosure", "uncertain", "material", "adverse"],
    "narrative_context": ["history", "historical", "archive", "archival", "fieldwork", "ethnography", "culture", "cultural", "anthropology", "narrative"],
    "definition_or_taxonomy": ["define", "definition", "means", "category", "categories", "taxonomy", "type", "classification", "concept"],
    "generic_claim": ["claim", "claims", "argument", "evidence", "finding", "findings", "conclusion"],
}
SYNTAX_DOCUMENT_TERMS = {
    "method_detail": ["robustness", "variable", "coded", "procedure"],
    "limitation_caveat": ["however", "although", "cannot", "may", "might"],
    "quantitative_result": ["significant", "coefficient", "mean", "median"],
    "legal_authority": ["plaintiff", "defendant", "holding", "section"],
    "public_expression": ["post", "thread", "tweet", "reply"],
    "dialogue_or_transcript": ["analyst", "operator", "q", "a"],
    "risk_disclosure": ["cautionary", "loss", "losses", "impairment"],
    "narrative_context": ["memoir", "oral", "chronicle"],
    "definition_or_taxonomy": ["refers", "consists", "class"],
    "generic_claim": ["suggests", "shows", "therefore"],
}
SYNTAX_QUERY_PHRASES = [(["what is", "what are"], "definition_or_taxonomy", 0.6), (["public opinion"], "public_expression", 0.9), (["case law", "legal authority"], "legal_authority", 0.9), (["risk factor", "forward-looking"], "risk_disclosure", 0.9), (["how many", "how much"], "quantitative_result", 0.7)]
QUANTITY = r"(?i)(?:[$€£]\s*\d|\d+(?:\.\d+)?\s*(?:%|percent|bps|million|billion|trillion|x)\b)"
SPEAKER = r"(?i)(^|\n)\s*(?:q|a|analyst|operator|speaker|interviewer|respondent|cfo|ceo)\s*[:\-]"
DEFINITION = r"(?i)\b(?:is defined as|are defined as|refers to|means|consists of)\b"

# Words that make no claim key, marks of dependent sources, weights of the echo risk.
CLAIM_KEY_STOP = ["about", "across", "claim", "evidence", "finds", "shows", "study"]
DEPENDENCE_MARKERS = ["press release", "reprinted", "syndicated", "copied", "mirror", "same dataset", "same source", "according to"]
ECHO_WEIGHTS = {"dependence": 0.35, "concentration": 0.25, "repetition": 0.25, "markers": 0.15}

# Component weights of the balanced policy.
BALANCED = {"relevance": 1.0, "semantic_similarity": 0.45, "syntax_relevance": 0.15, "source_quality": 0.35, "citation_centrality": 0.25, "author_score": 0.1, "section_role": 0.2, "claim_density": 0.2, "method_signal": 0.1, "limitation_signal": 0.05, "evidence_specificity": 0.1, "recency": 0.1}

# Chunk policy of each document type: strategy, most tokens, least overlap, forced overlap.
CHUNK_POLICIES = {
    "academic_article": ("section_sentence_boundary", None, None, None),
    "biomedical_web_article": ("paragraph_sentence_boundary", 260, None, None),
    "preprint": ("section_sentence_boundary", None, None, None),
    "policy_report": ("section_sentence_boundary", 220, None, None),
    "market_report": ("section_sentence_boundary", 220, None, None),
    "news_article": ("paragraph_sentence_boundary", 180, None, None),
    "web_page": ("web_section_boundary", 180, None, None),
    "legal_authority": ("legal_clause_boundary", 180, 24, None),
    "regulatory_filing": ("filing_section_boundary", 220, 24, None),
    "social_media_post": ("thread_or_post_boundary", 120, None, 0),
    "forum_comment": ("thread_or_post_boundary", 140, None, 0),
    "note": ("conservative_boundary", 160, None, None),
    "transcript": ("turn_boundary_candidate", 180, 20, None),
    "archival_primary_source": ("ocr_conservative_boundary", 90, 15, None),
    "unknown_unstructured_text": ("conservative_boundary", 160, None, None),
}
INSTRUCTION_LIKE = r"(?i)\b(ignore|disregard|override|reveal|exfiltrate|system:|developer:|api key|secret|password)\b"
