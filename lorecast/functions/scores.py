"""Scoring functions: evidence, promotion, relation, decay, learning, importance, trust. All are Column -> Column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome signals of the learning log.
OUTCOMES = {
    "confirmed": 1.0, "used": 0.8, "helpful": 0.7, "continued": 0.3, "acknowledged": 0.2,
    "ignored": -0.2, "unhelpful": -0.5, "corrected": -0.8, "wrong": -1.0, "ambiguous": 0.0,
}
#: The outcome that an event of the test log stands for.
EVENTS = {"purchase": "confirmed", "click": "used", "view": "continued", "signup": "acknowledged", "error": "wrong"}
# Authority of a source by its type.
AUTHORITY = {
    "documentation": 0.90, "configuration": 0.85, "code_comment": 0.70, "assistant_response": 0.60, "conversation": 0.50, "user_message": 0.40, "log": 0.30, "unknown": 0.30,
}
# Importance of a segment by its type.
SEGMENT_IMPORTANCE = {
    "heading": 0.8, "summary": 0.9, "claim": 0.95, "paragraph": 0.5, "code_block": 0.6, "list_item": 0.4, "table_row": 0.5, "message": 0.6,
}
# Priors of relation types on a path.
RELATION_PRIORS = {
    "SUPPORTS": 1.00, "DERIVED_FROM": 0.95, "SUMMARIZES": 0.90, "PART_OF": 0.85, "INSTANCE_OF": 0.80, "UPDATED_BY": 0.80, "CONTRADICTS": 0.75, "MENTIONS": 0.70,
    "ABOUT": 0.65, "RELATED_TO": 0.35, "ALIAS_OF": 0.60, "PRECEDES": 0.55, "FOLLOWS": 0.55, "CAUSED_BY": 0.65, "LOCATED_IN": 0.50, "AUTHORED_BY": 0.55, "USES": 0.60,
    "DEFINED_BY": 0.70, "ELABORATES": 0.65, "SUPERSEDED_BY": 0.75, "PREFERENCE_OF": 0.70, "CORRECTION_OF": 0.80,
}
# Categories of edge types.
EDGE_CATEGORIES = {
    "operational": ["uses", "depends_on", "calls", "invokes", "connects_to", "reads_from", "writes_to"],
    "temporal": ["precedes", "follows", "concurrent_with", "triggers", "caused_by", "enables"],
    "ownership": ["owns", "manages", "administers", "created_by", "maintained_by"],
    "similarity": ["similar_to", "related_to", "alternative_to", "equivalent_to", "replaces"],
}
# How well kinds of items fit the modes of a question.
TYPE_FIT = {
    "fact_lookup": {"memory": 1.0, "claim": 0.9, "entity": 0.8, "segment": 0.5, "summary": 0.6}, "synthesis": {"summary": 1.0, "segment": 0.7, "claim": 0.6, "entity": 0.5, "memory": 0.5},
    "timeline": {"event": 1.0, "segment": 0.7, "claim": 0.6, "memory": 0.5}, "procedure": {"procedure": 1.0, "segment": 0.6, "summary": 0.5},
    "verification": {"claim": 1.0, "memory": 0.8, "segment": 0.6}, "assistant_memory": {"memory": 1.0, "claim": 0.5, "segment": 0.4},
    "report": {"summary": 1.0, "segment": 0.8, "claim": 0.7, "entity": 0.7},
}
# Texts that say nothing.
NOISE = ["ok", "okay", "done", "failed", "success", "error", "yes", "no", "true", "false", "null", "none"]
# Words of types that raise an item's score in a state of a session.
STATE_WORDS = {
    "debugging": {"error": 0.3, "log": 0.2, "config": 0.1, "diagnostic": 0.3}, "planning": {"architecture": 0.2, "design": 0.2, "how_to": 0.2, "procedure": 0.1},
    "recalling": {"conversation": 0.3, "decision": 0.2, "context": 0.2}, "exploring": {"documentation": 0.3, "explanation": 0.2, "overview": 0.2},
    "executing": {"procedure": 0.3, "command": 0.2, "config": 0.2}, "confirming": {"verification": 0.3, "test": 0.2, "result": 0.2},
}
CREDENTIALS = "password|passwd|api key|api_key|apikey|secret|credential|private key|access token|bearer"


def _n(x: float) -> Column:
    return F.lit(float(x))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, _n(0)), _n(1))


def logs(n: Column, base: float) -> Column:
    """min(1, ln(1 + n) / base)."""
    return F.least(_n(1), F.log1p(F.coalesce(n, F.lit(0))) / base)


def half_life(days: Column, life: float) -> Column:
    return F.exp(-F.greatest(days, _n(0)) * math.log(2) / life)


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(key == k, _n(v))
    return out.otherwise(_n(default))


def lookup_text(key: Column, values: dict[str, str]) -> Column:
    """The value of a key, null for others."""
    out = F
    for k, v in values.items():
        out = out.when(key == k, v)
    return out.otherwise(F.lit(None).cast("string"))


def event_signal(event_type: Column) -> Column:
    return lookup(event_type, {e: OUTCOMES[o] for e, o in EVENTS.items()}, 0.0)


def is_credential(text: Column) -> Column:
    return F.lower(text).rlike(CREDENTIALS)


def evidence(authority: Column, corroborations: Column, days: Column, specificity: Column, contradictions: Column, mentions: Column) -> Column:
    """Weighted authority, corroboration, recency, specificity and freedom from contradiction, damped by the last."""
    free = 1 - F.coalesce(F.try_divide(contradictions, F.greatest(mentions, F.lit(1))), _n(0))
    free = unit(free)
    base = 0.25 * authority + 0.30 * logs(corroborations, 1.8) + 0.15 * half_life(days, 60) + 0.10 * specificity + 0.20 * free
    return unit(base * F.pow(free, _n(1.5)))


def evidence_factors(authority: Column, corroborations: Column, days: Column, specificity: Column, free: Column) -> Column:
    """The five factors as a vector."""
    return F.array(authority, F.least(_n(1), F.log1p(corroborations) / 2), F.exp(-days / 60), specificity, free)


def source_authority(kind: Column, confidence: Column, citations: Column, primary: Column) -> Column:
    base = lookup(kind, AUTHORITY, 0.30) * (0.8 + 0.2 * confidence) * (1 + 0.1 * logs(citations, 3))
    return F.least(_n(1), base * F.when(primary, 1.1).otherwise(1.0))


def promotion(importance: Column, frequency: Column, diversity: Column, confidence: Column, novelty: Column, centrality: Column, relevance: Column) -> Column:
    parts = ((0.20, importance), (0.15, frequency), (0.10, diversity), (0.20, confidence), (0.10, novelty), (0.10, centrality), (0.15, relevance))
    return unit(sum((w * c for w, c in parts), _n(0)))


def promotion_step(score: Column, tier: Column) -> Column:
    return F.when((score >= 0.65) & (tier < 1), "promote").when((score < 0.35) & (tier > 0), "demote").otherwise("keep")


def legacy_promotion(parts: list[Column]) -> Column:
    return sum((w * c for w, c in zip((0.25, 0.20, 0.15, 0.15, 0.10, 0.10, 0.05), parts, strict=True)), _n(0))


def legacy_tier(score: Column) -> Column:
    return F.when(score >= 0.85, "manifold").when(score >= 0.70, "promoted").when(score >= 0.45, "provisional").otherwise("raw")


def promotion_importance(retrievals: Column, citations: Column, days: Column, authority: Column) -> Column:
    return 0.3 * logs(retrievals, 5) + 0.3 * logs(citations, 4) + 0.2 * half_life(days, 30) + 0.2 * authority


def retrieval_frequency(rate: Column, most: float = 30.0) -> Column:
    return F.least(_n(1), F.log1p(10 * rate) / math.log1p(most / 3))


def graph_centrality(degree: Column, betweenness: Column) -> Column:
    return 0.6 * logs(degree, 4) + 0.4 * betweenness


def source_diversity(distinct: Column, total: Column) -> Column:
    return F.when(distinct <= 1, 0.5).otherwise(F.least(_n(1), F.coalesce(F.try_divide(F.log1p(distinct), F.log1p(F.least(F.lit(10), total))), _n(0))))


def metric_promotion(citations: Column, retrievals: Column, contradictions: Column, days: Column, confirmations: Column) -> Column:
    """The seven factors of promotion from counters: citations over 10, retrievals over 50, contradictions, age over a year, confirmations over 5; diversity and centrality unknown."""
    part = lambda n, most: F.least(_n(1), n / most)
    return promotion(part(citations, 10), part(retrievals, 50), _n(0.5), F.greatest(_n(0), 1 - 0.2 * contradictions), F.greatest(_n(0), 1 - days / 365), _n(0.5), part(confirmations, 5))


def novelty(days: Column, growth: Column, emerging: Column) -> Column:
    """Half of what is left of 60 days (0.2 at least), a tenth of the growth of mentions (0.3 at most), and 0.2 if emerging."""
    return unit(0.5 * F.greatest(_n(0.2), 1 - days / 60) + F.when(growth > 0, F.least(_n(0.3), growth / 10)).otherwise(_n(0)) + F.when(emerging, 0.2).otherwise(0.0))


def confidence(extracted: Column, corroborations: Column, contradicted: Column) -> Column:
    """The confidence of the extraction, up to 0.2 more for corroboration, 0.3 less if contradicted."""
    return unit(unit(extracted) + F.least(_n(0.2), F.log1p(corroborations) / 9) - F.when(contradicted, 0.3).otherwise(0.0))


def user_relevance(retrievals: Column, citations: Column, feedback: Column) -> Column:
    """Use by a user, blended in halves with feedback in [-1, 1] where there is any."""
    use = F.least(_n(1), (F.log1p(retrievals) + F.log1p(citations)) / 6)
    return unit(F.when(feedback != 0, 0.5 * use + 0.5 * (feedback + 1) / 2).otherwise(use))


def spaces_of(status: Column, kind: Column) -> Column:
    """The spaces that an object is embedded in: none if raw, the topic, and from promoted on the one of its type."""
    own = lookup_text(kind, {"claim": "claim", "procedure": "procedure", "entity": "relation"})
    topic, none = F.array(F.lit("topic")), F.array().cast("array<string>")
    return F.when(status == "raw", none).when(status.isin("promoted", "manifold") & own.isNotNull(), F.concat(topic, F.array(own))).otherwise(topic)


def edge_category(edge_type: Column) -> Column:
    """The category of an edge type, whatever its case, hyphens and spaces; other if none."""
    plain = F.translate(F.lower(edge_type), "- ", "__")
    out = F
    for category, types in EDGE_CATEGORIES.items():
        out = out.when(plain.isin(types), category)
    return out.otherwise("other")


def type_fit(mode: Column, kind: Column) -> Column:
    """How well a kind of item fits the mode of a question; one half where nothing is said."""
    out = F
    for m, fits in TYPE_FIT.items():
        out = out.when(mode == m, lookup(kind, fits, 0.5))
    return out.otherwise(_n(0.5))


def noise_penalty(text: Column, kind: Column) -> Column:
    """For short texts, records of tools, and words that say nothing; 1 at most."""
    n = F.length(text)
    short = F.when(n < 20, 0.5).when(n < 50, 0.2).otherwise(0.0)
    return F.least(_n(1), short + F.when(kind.isin("tool_call", "tool_result"), 0.3).otherwise(0.0) + F.when(F.lower(F.trim(text)).isin(NOISE), 0.4).otherwise(0.0))


def compared(overlap: Column, new_top: Column, old_top: Column) -> Column:
    """The outcome of a comparison of two result lists by their overlap and top scores."""
    better = F.when(new_top > old_top * 1.1, "new_better").when(old_top > new_top * 1.1, "old_better").otherwise("divergent")
    return F.when(overlap >= 0.9, "match").when(overlap >= 0.5, "partial_match").when(overlap < 0.2, better).otherwise("divergent")


def winner(old_n: Column, new_n: Column, shared: Column, correlation: Column, old_ms: Column, new_ms: Column) -> Column:
    """Which of two result lists wins: the one that has any, a tie at high overlap and rank correlation, else the faster at some overlap."""
    overlap = F.try_divide(shared, F.least(old_n, new_n))
    return (
        F.when((old_n == 0) & (new_n == 0), "tie").when(old_n == 0, "new").when(new_n == 0, "old").when((overlap > 0.8) & (correlation > 0.8), "tie")
        .when((new_ms < old_ms * 0.7) & (overlap > 0.5), "new").when((old_ms < new_ms * 0.7) & (overlap > 0.5), "old").otherwise("unknown")
    )


def injection_score(state: Column, score: Column, segment_type: Column, source_type: Column) -> Column:
    """The score of an item for a state of a session: 0.5 if unknown, more for each word of the state in its types; 1 at most."""
    out = F
    for name, words in STATE_WORDS.items():
        has = lambda w: F.lower(segment_type).contains(w) | F.lower(source_type).contains(w)
        out = out.when(state == name, sum((F.when(F.coalesce(has(w), F.lit(False)), x).otherwise(0.0) for w, x in words.items()), _n(0)))
    return F.least(_n(1), F.coalesce(score, _n(0.5)) + out.otherwise(_n(0)))


def relation_score(structure: Column, shared: Column, path: Column) -> Column:
    return 0.4 * structure + 0.3 * logs(shared, 1.8) + F.coalesce(F.try_divide(_n(0.3), path), _n(0))


def log_centrality(degree: Column) -> Column:
    return F.log1p(degree) / math.log1p(100)


def path_score(anchor: Column, edges: Column, depth: Column, drift: Column, contradictions: Column) -> Column:
    """anchor + sum of prior * weight * confidence over edges, less depth, drift and contradictions; at least 0."""
    gained = F.aggregate(edges, _n(0), lambda a, e: a + lookup(e["type"], RELATION_PRIORS, 0.35) * e["weight"] * e["confidence"])
    return F.greatest(_n(0), anchor + gained - 0.15 * depth - 0.20 * drift - 0.25 * contradictions / (F.size(edges) + 1))


def hot(n: Column, days: Column) -> Column:
    """ln(n + 1) / (1 + 0.1 days); 0 without retrievals, 30 days if unknown."""
    return F.when(n == 0, _n(0)).otherwise(F.log1p(n) / (1 + 0.1 * F.coalesce(days, _n(30))))


def recency_bucket(days: Column) -> Column:
    return F.when(days < 1, 1.0).when(days < 7, 0.9).when(days < 30, 0.7).when(days < 90, 0.5).otherwise(0.3)


def decay_linear(score: Column, days: Column) -> Column:
    """Unchanged for a week, then 0.01 a day less, 0.1 at most; not below 0, four digits."""
    return F.when(days < 7, score).otherwise(F.round(F.greatest(_n(0), score - F.least(_n(0.1), 0.01 * (days - 7))), 4))


def decay_rate(score: Column, days: Column, rate: float, floor: float) -> Column:
    return F.greatest(_n(floor), score * (1 - rate * days))


def reinforce(score: Column, by: float = 0.2) -> Column:
    return F.least(_n(1), score + by)


def bandit_adjustment(positive: Column, negative: Column) -> Column:
    return F.greatest(_n(-0.3), F.least(_n(0.3), (positive * 1.0 + negative * 1.5) / 2.5 * 0.1))


def entity_importance(mentions: Column, sources: Column, retrievals: Column, centrality: Column) -> Column:
    """Logarithms of counters (1 at least) over fixed bases, and centrality; 1 at most."""
    part = lambda c, base: F.log(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))) / math.log(base)
    return F.least(_n(1), 0.3 * part(mentions, 100) + 0.3 * part(sources, 50) + 0.2 * part(retrievals, 100) + 0.2 * F.coalesce(centrality, _n(0)))


def trust(verified: Column, disputed: Column, n: Column) -> Column:
    return unit(0.5 * (verified - 0.5 * disputed) / n + 0.5)


def causal_strength(explicitness: Column, authority: Column, corroborations: Column) -> Column:
    return 0.4 * explicitness + 0.3 * authority + 0.3 * F.least(_n(1), corroborations / 3)


def success_rate(successes: Column, executions: Column) -> Column:
    return F.when(F.coalesce(executions, F.lit(0)) == 0, _n(0.5)).otherwise(F.try_divide(successes, executions))


def segment_importance(kind: Column, text: Column, boost: Column | float = 0.0) -> Column:
    """Importance by type, with a mode's boost, lowered for short texts."""
    base = F.least(_n(1), lookup(kind, SEGMENT_IMPORTANCE, 0.5) + boost)
    n = F.coalesce(F.length(text), F.lit(0))
    return base * F.when(n < 20, 0.1).when(n < 50, 0.3).when(n < 100, 0.7).otherwise(1.0)


def adaptive_threshold(threshold: Column, accepted: Column, shown: Column, target: float = 0.7) -> Column:
    """Moved by 0.05 where acceptance leaves the target by more than 0.1, from five shown, within 0.3 and 0.95."""
    rate = F.try_divide(accepted, shown)
    moved = F.when(shown < 5, threshold).when(rate < round(target - 0.1, 9), threshold + 0.05).when(rate > round(target + 0.1, 9), threshold - 0.05).otherwise(threshold)
    return F.greatest(_n(0.3), F.least(_n(0.95), moved))
