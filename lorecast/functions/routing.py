"""Routing of questions: intents by matched patterns, indexes with weights, feedback read from a turn, support of claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorecast.functions.text import jaccard, words

# Patterns of intents; each that matches counts once.
INTENTS = {
    "debugging": [r"\b(?:error|fail(?:ed|ure)?|bug|crash|exception|traceback)\b", r"\b(?:not working|broken|wrong|issue|problem)\b", r"\b(?:fix|debug|resolve|troubleshoot)\b", r"(?:why (?:is|does|did).+(?:fail|error|crash|break))", r"(?:getting (?:an?|this) error)"],
    "recalling": [r"\b(?:remember|recall|previously|earlier|before|last time)\b", r"(?:you (?:told|said|mentioned|showed) me)", r"(?:we (?:discussed|talked about|covered))", r"(?:what (?:was|were|did we))", r"\b(?:when did (?:we|i|you))\b", r"\b(?:history|past|ago)\b"],
    "exploring": [r"(?:what is|what are|what does)\b", r"\b(?:explain|describe|tell me about|overview)\b", r"\b(?:how does|how do).+(?:work|function)\b", r"(?:can you (?:explain|describe|tell me))", r"\b(?:definition|meaning|concept)\b"],
    "planning": [r"(?:how (?:should|do|can) (?:we|i))\b", r"\b(?:plan|strategy|approach|design|architect)\b", r"\b(?:steps to|best way to|implement)\b", r"(?:what's the (?:best|right) way)", r"\b(?:roadmap|milestones|timeline)\b"],
    "verifying": [r"\b(?:is it true|is that correct|verify|confirm|check)\b", r"(?:(?:did|does|is|are).+(?:true|correct|right|accurate))", r"\b(?:fact-check|validate|prove)\b", r"(?:according to|based on|evidence)"],
    "procedural": [r"(?:how (?:to|do i|can i))\b", r"\b(?:steps|instructions|guide|tutorial|walkthrough)\b", r"\b(?:run|execute|install|create|configure|set up)\b", r"(?:show me how)", r"\b(?:command|script|code to)\b"],
}
# Weights of the six spaces by intent (topic, claim, procedure, relation, time, evidence).
PROFILES = {
    "debugging": (0.15, 0.10, 0.35, 0.15, 0.15, 0.10), "recalling": (0.30, 0.25, 0.05, 0.10, 0.25, 0.05), "exploring": (0.40, 0.20, 0.10, 0.20, 0.05, 0.05),
    "planning": (0.20, 0.15, 0.30, 0.20, 0.05, 0.10), "verifying": (0.20, 0.35, 0.05, 0.10, 0.05, 0.25), "procedural": (0.15, 0.10, 0.45, 0.15, 0.10, 0.05),
    "default": (0.40, 0.20, 0.15, 0.10, 0.10, 0.05),
}
# Patterns of index routes in order, with what they add to the base weights, the primary index first.
BASE = {"segments": 0.3, "memories": 0.2}
ROUTES = [
    (r"\b(caused|because|due to|leads to|results? in|effect of|why did|why does|why is|reason for|consequence|trigger|what caused|what made|what led to|root cause)\b", {"causal": 0.5, "relations": 0.3, "claims": 0.2}),
    (r"\b(how to|how do|how can|steps to|instructions|guide|setup|configure|install|deploy|run|execute|create|build|procedure|workflow|process for|way to)\b", {"procedures": 0.5, "segments": 0.4}),
    (r"\b(related to|connected to|linked to|associated with|between .+ and|relationship|connection|dependencies|what .+ uses|what uses|who works with)\b", {"relations": 0.4, "entities": 0.4, "segments": 0.2}),
    (r"\b(what is|who is|tell me about|describe|details on|info about|information on|explain|definition of|what are the .+ of)\b", {"entities": 0.5, "claims": 0.3, "segments": 0.2}),
    (r"\b(is it true|verify|confirm|check if|fact.?check|did .+ really|was .+ actually|prove|evidence for|according to|source for)\b", {"claims": 0.5, "segments": 0.3}),
    (r"\b(prefer|preference|like|dislike|want|don't want|always|never|usually|style|habit)\b", {"memories": 0.5, "segments": 0.3}),
]
RECENT = r"\b(recent|latest|last|today|yesterday|this week|just|newly|current|now)\b"
HISTORICAL = r"\b(when did|history|historical|originally|in the past|previously|before|ago|back when)\b"
# Phrases of feedback.
NEGATIVE = ["that's wrong", "not correct", "incorrect", "no that's not", "actually", "you're wrong", "that doesn't", "that's not what", "i said", "i meant", "not what i asked"]
POSITIVE = ["thanks", "perfect", "exactly", "that's right", "correct", "yes", "great", "helpful", "that works"]
NEGATIONS = r"\b(?:not|never|no longer|doesn't|don't|isn't|wasn't|false|incorrect)\b"


def intent(text: Column, least: float = 0.4) -> Column:
    """The intent with most matched patterns, the first of equals; default if its share of all matches is below the least."""
    n = lambda ps: sum((F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)).cast("int") for p in ps), F.lit(0))
    found = F.array(*[F.struct(n(p).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, p) in enumerate(INTENTS.items())])
    best, whole = F.array_max(found), F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])
    return F.when((whole == 0) | (best["n"] / F.greatest(whole, F.lit(1)) < least), "default").otherwise(best["k"])


def space_weights(name: Column) -> Column:
    """The weights of the six spaces for an intent."""
    out = F
    for k, w in PROFILES.items():
        out = out.when(name == k, F.array(*[F.lit(x) for x in w]))
    return out.otherwise(F.array(*[F.lit(x) for x in PROFILES["default"]]))


def index_weights(text: Column) -> Column:
    """A map of indexes to weights that add up to 1, by the first route that matches, over the base."""
    def weights(extra: dict[str, float]) -> Column:
        merged = BASE | extra
        total = sum(merged.values())
        return F.map_from_arrays(F.array(*[F.lit(k) for k in merged]), F.array(*[F.lit(v / total) for v in merged.values()]))

    out = F
    for pattern, extra in ROUTES:
        out = out.when(text.rlike(f"(?i){pattern}"), weights(extra))
    return out.otherwise(weights({}))


def primary_index(text: Column) -> Column:
    out = F
    for pattern, extra in ROUTES:
        out = out.when(text.rlike(f"(?i){pattern}"), next(iter(extra)))
    return out.otherwise("segments")


def temporal_hint(text: Column) -> Column:
    return F.when(text.rlike(f"(?i){RECENT}"), "recent").when(text.rlike(f"(?i){HISTORICAL}"), "historical").otherwise("any")


def feedback(user: Column, retrieved: Column, cited: Column) -> Column:
    """What a turn says about what was retrieved: corrected, confirmed, used, continued or ambiguous, with confidence."""
    low = F.lower(user)
    has = lambda phrases: F.coalesce(F.array_max(F.array(*[low.contains(p) for p in phrases])), F.lit(False))
    share = F.try_divide(F.size(F.array_intersect(retrieved, cited)), F.size(retrieved))
    pair = lambda name, c: F.struct(F.lit(name).alias("outcome"), F.lit(c).alias("confidence"))
    return F.when(has(NEGATIVE), pair("corrected", 0.85)).when(has(POSITIVE), pair("confirmed", 0.75)).when(share > 0.5, pair("used", 0.7)).when(share > 0, pair("continued", 0.5)).otherwise(pair("ambiguous", 0.3))


def supports(claim: Column, text: Column, least: float = 0.7) -> Column:
    """Whether a text says nearly the same as a claim: word sets with a Jaccard of at least `least`."""
    return jaccard(F.array_distinct(words(claim)), F.array_distinct(words(text))) >= least


def contradicts(claim: Column, text: Column, overlap: float = 0.3) -> Column:
    """Whether a text with a negation covers more than `overlap` of a claim's words, and the claim has no negation."""
    mine = F.array_distinct(words(claim))
    shared = F.try_divide(F.size(F.array_intersect(mine, words(text))), F.size(mine))
    return F.coalesce((shared > overlap) & text.rlike(f"(?i){NEGATIONS}") & ~claim.rlike(f"(?i){NEGATIONS}"), F.lit(False))
