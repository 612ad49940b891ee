"""Component weights and switches of the named retrieval policies."""

from __future__ import annotations

# The order of the columns below.
PARTS = ["relevance", "semantic_similarity", "syntax_relevance", "source_quality", "citation_centrality", "author_score", "section_role", "claim_density", "method_signal", "limitation_signal", "evidence_specificity", "recency"]

# Weights of each policy, in the order of PARTS.
WEIGHTS = {
    "lexical": [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "importance": [0.25, 0.15, 0.2, 0.45, 0.25, 0.15, 0.25, 0.25, 0.15, 0.1, 0.15, 0.05],
    "balanced": [1.0, 0.45, 0.15, 0.35, 0.25, 0.1, 0.2, 0.2, 0.1, 0.05, 0.1, 0.1],
    "recency": [0.8, 0.25, 0.1, 0.15, 0.0, 0.05, 0.1, 0.1, 0.1, 0.05, 0.1, 0.45],
    "diverse": [0.85, 0.35, 0.15, 0.25, 0.2, 0.1, 0.15, 0.15, 0.1, 0.05, 0.1, 0.05],
    "focus_diverse": [0.85, 0.35, 0.15, 0.25, 0.2, 0.1, 0.15, 0.15, 0.1, 0.05, 0.1, 0.05],
    "semantic": [0.1, 1.0, 0.2, 0.15, 0.05, 0.05, 0.1, 0.1, 0.1, 0.05, 0.1, 0.05],
    "rag": [0.75, 0.75, 0.2, 0.25, 0.2, 0.1, 0.2, 0.25, 0.15, 0.1, 0.15, 0.05],
    "committee_rag": [0.75, 0.75, 0.2, 0.25, 0.2, 0.1, 0.2, 0.25, 0.15, 0.1, 0.15, 0.05],
    "conflict_aware": [0.75, 0.65, 0.2, 0.25, 0.2, 0.1, 0.2, 0.35, 0.15, 0.15, 0.15, 0.05],
    "source_quality_heavy": [0.55, 0.4, 0.15, 0.75, 0.35, 0.25, 0.2, 0.2, 0.12, 0.08, 0.12, 0.05],
    "recency_heavy": [0.65, 0.45, 0.15, 0.2, 0.1, 0.05, 0.15, 0.15, 0.1, 0.08, 0.12, 0.8],
}

# What the policies do beside their weights.
SWITCHES = {
    "diverse": {"diversity": 0.35, "relevance_floor": 0.35, "low_relevance_penalty": 0.35},
    "focus_diverse": {"diversity": 0.35, "relevance_floor": 0.35, "low_relevance_penalty": 0.35, "diversity_relevance_floor": 0.45, "diversity_focus_floor": 0.25},
    "rag": {"diversity": 0.25, "relevance_floor": 0.35, "low_relevance_penalty": 0.22, "method_signal_bonus": 0.08, "limitation_signal_bonus": 0.06, "evidence_specificity_bonus": 0.08},
    "committee_rag": {"diversity": 0.25, "relevance_floor": 0.35, "low_relevance_penalty": 0.22, "method_signal_bonus": 0.08, "limitation_signal_bonus": 0.06, "evidence_specificity_bonus": 0.08, "candidate_k": 50, "committee_gate": 1.0},
    "conflict_aware": {"diversity": 0.35},
    "source_quality_heavy": {"diversity": 0.05, "relevance_floor": 0.35, "low_relevance_penalty": 0.3},
    "recency_heavy": {"diversity": 0.15, "relevance_floor": 0.35, "low_relevance_penalty": 0.22},
}

POLICIES = {name: dict(zip(PARTS, weights, strict=True)) for name, weights in WEIGHTS.items()}

# Words of a query that ask for disagreement, and the least diversity that such a query gets.
DISAGREEMENT_TERMS = ["challenge", "challenges", "conflict", "conflicts", "contradict", "contradicts", "contradiction", "critique", "critiques", "debate", "debates", "disagree", "disagreement", "disputes", "mixed", "skeptical", "tension", "versus"]
DISAGREEMENT_DIVERSITY = 0.25
# Words behind which a query names what it does not want, words that end that, and what a text with all of it loses.
EXCLUSION_MARKERS = ["excluding", "exclude", "except", "without"]
EXCLUSION_ENDS = ["and", "but", "compared", "rather", "than", "versus", "vs"]
EXCLUSION_PENALTY = 0.6
# Words of a query that asks about retracted work.
RETRACTION_TERMS = ["retracted", "retraction", "withdrawn", "correction", "fraud"]
# Factors of sanitized texts, of sources below the least trust, and of texts below the relevance floor.
SANITIZED, UNTRUSTED, LEAST_TRUST, BELOW_FLOOR = 0.65, 0.85, 0.25, 0.5
# How relevance and trust scale a score.
GATE, TRUST_SHARE, TRUST_FLOOR = 0.5, 0.15, 0.05
