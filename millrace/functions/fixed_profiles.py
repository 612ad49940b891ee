"""Document types, their traits and what each domain prefers."""

# Document types in order of precedence, with the source types and the substrings that tell them.
TYPE_RULES = [
    ("note", ["note", "memo", "user_note", "research_note"], []),
    ("regulatory_filing", ["filing", "regulatory_filing"], ["10-k", "10-q", "8-k", "annual report", "sec filing", "edgar", "regulatory filing"]),
    ("legal_authority", ["legal", "case_law", "court_opinion", "statute"], ["court", "supreme court", "district court", "appellate", "statute", "regulation", "v. "]),
    ("transcript", [], ["transcript", "earnings call", "hearing", "interview transcript", "deposition"]),
    ("preprint", ["preprint", "repository"], ["preprint", "arxiv", "ssrn", "osf preprints"]),
    ("policy_report", ["policy_report", "institutional_report", "government_report"], []),
    ("market_report", ["market_report", "analyst_report", "report"], ["industry report", "market report", "investor presentation", "analyst report", "white paper"]),
    ("academic_article", ["journal", "book", "conference", "academic_article"], []),
    ("news_article", ["newspaper", "news", "magazine"], ["news", "newspaper", "press", "wire service"]),
    ("social_media_post", ["social_media", "social_media_post", "tweet", "post", "status"], ["social media", "public post", "tweet", "retweet", "likes", "shares", "reposts"]),
    ("forum_comment", ["forum", "forum_comment", "comment", "discussion_board"], ["forum comment", "discussion thread", "reddit", "hacker news", "public comment"]),
    ("archival_primary_source", [], ["archive", "archival", "manuscript", "collection", "primary source"]),
    ("web_page", ["web", "blog", " webpage", "webpage"], []),
]
INSTITUTIONS = ["world bank", "imf", "oecd", "united nations", "government", "regulator", "department", "ministry", "agency"]

# Evidence family, confidence, authority, need of timeliness, risk of intent, adversarial surface, risk of extraction, grey literature, role.
TYPE_TRAITS = {
    "note": ("user_supplied_text", 0.75, 0.35, 0.6, 0.45, 0.45, 0.25, True, "annotate_and_corroborate"),
    "regulatory_filing": ("official_record", 0.9, 0.85, 0.9, 0.45, 0.25, 0.35, True, "boost_or_gate_by_authority"),
    "legal_authority": ("official_record", 0.85, 0.9, 0.85, 0.2, 0.2, 0.4, True, "gate_by_jurisdiction_and_authority"),
    "transcript": ("primary_or_near_primary_text", 0.8, 0.55, 0.75, 0.55, 0.35, 0.45, True, "annotate_and_corroborate"),
    "preprint": ("scholarly_grey_literature", 0.8, 0.45, 0.65, 0.25, 0.2, 0.3, True, "annotate_review_status"),
    "policy_report": ("institutional_report", 0.8, 0.7, 0.7, 0.35, 0.2, 0.35, True, "rank_with_institution_and_method_context"),
    "market_report": ("commercial_or_market_analysis", 0.75, 0.45, 0.9, 0.65, 0.35, 0.35, True, "annotate_incentives_and_corroborate"),
    "academic_article": ("scholarly", 0.85, 0.7, 0.45, 0.2, 0.15, 0.3, False, "rank_with_method_and_domain_quality"),
    "news_article": ("journalistic", 0.7, 0.45, 0.85, 0.4, 0.4, 0.25, True, "annotate_and_corroborate"),
    "social_media_post": ("public_opinion", 0.75, 0.15, 0.9, 0.8, 0.85, 0.55, True, "aggregate_public_opinion_and_screen_safety"),
    "forum_comment": ("public_opinion", 0.75, 0.15, 0.8, 0.75, 0.8, 0.55, True, "aggregate_public_opinion_and_screen_safety"),
    "archival_primary_source": ("primary_or_near_primary_text", 0.75, 0.65, 0.25, 0.25, 0.2, 0.55, True, "annotate_context_and_provenance"),
    "web_page": ("open_web", 0.65, 0.2, 0.75, 0.7, 0.75, 0.45, True, "screen_safety_and_corroborate"),
    "unknown_unstructured_text": ("unknown", 0.25, 0.2, 0.5, 0.5, 0.5, 0.5, True, "annotate_missing_type"),
}
TRAIT_NAMES = ["evidence_family", "document_type_confidence", "authority_signal", "timeliness_need", "source_intent_risk", "adversarial_surface", "extraction_risk", "grey_literature", "recommended_decision_role"]

# The document types and evidence families that each domain prefers.
DOMAIN_PREFERENCES = {
    "general_academic": (["academic_article", "preprint", "policy_report"], ["scholarly", "scholarly_grey_literature", "institutional_report"]),
    "economics": (["academic_article", "preprint", "policy_report", "regulatory_filing", "market_report"], ["scholarly", "scholarly_grey_literature", "institutional_report", "official_record"]),
    "psychology": (["academic_article", "preprint", "policy_report"], ["scholarly", "scholarly_grey_literature", "institutional_report"]),
    "anthropology": (["academic_article", "book", "transcript", "archival_primary_source", "policy_report"], ["scholarly", "primary_or_near_primary_text", "institutional_report"]),
    "history": (["academic_article", "book", "archival_primary_source", "transcript", "legal_authority"], ["scholarly", "primary_or_near_primary_text", "official_record"]),
    "cultural_studies": (["academic_article", "book", "news_article", "archival_primary_source", "web_page"], ["scholarly", "journalistic", "primary_or_near_primary_text", "open_web"]),
    "legal_market": (["legal_authority", "regulatory_filing", "market_report", "news_article", "transcript"], ["official_record", "commercial_or_market_analysis", "journalistic", "primary_or_near_primary_text"]),
    "public_opinion": (["social_media_post", "forum_comment", "news_article", "transcript"], ["public_opinion", "journalistic", "primary_or_near_primary_text"]),
}

# Weights of the fit components in each domain; other domains take the last.
FIT_WEIGHTS = {
    "legal_market": {"document_type_fit": 0.2, "evidence_family_fit": 0.15, "authority_fit": 0.25, "provenance_fit": 0.15, "transparency_fit": 0.1, "safety_fit": 0.15},
    "history": {"document_type_fit": 0.2, "evidence_family_fit": 0.2, "provenance_fit": 0.2, "transparency_fit": 0.15, "publication_channel_fit": 0.1, "safety_fit": 0.15},
    "psychology": {"document_type_fit": 0.15, "evidence_family_fit": 0.1, "transparency_fit": 0.25, "open_science_fit": 0.2, "publication_channel_fit": 0.15, "safety_fit": 0.15},
    "public_opinion": {"document_type_fit": 0.25, "evidence_family_fit": 0.2, "provenance_fit": 0.15, "transparency_fit": 0.05, "safety_fit": 0.25, "publication_channel_fit": 0.1},
    "": {"document_type_fit": 0.18, "evidence_family_fit": 0.12, "transparency_fit": 0.22, "provenance_fit": 0.15, "publication_channel_fit": 0.13, "safety_fit": 0.2},
}
SHARES_HISTORY_WEIGHTS = ["history", "anthropology", "cultural_studies"]
FIT_TIERS = [("strong_fit", 0.75), ("moderate_fit", 0.55), ("weak_fit", 0.35)]
