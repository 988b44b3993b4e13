"""Text functions: tokens, trigrams, sets, classifiers by ordered patterns, specificity. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of words padded with two spaces before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))).cast("double"))


def first_match(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern (ignoring case) that a text has."""
    out = F
    for name, pattern in patterns:
        out = out.when(F.trim(text).rlike(f"(?i){pattern}"), name)
    return out.otherwise(default)


# Patterns of the modes of a question, in the order in which they are tried.
MODES_V1 = [
    ("assistant_memory", r"\b(remember|recall|you told me|we discussed|last time|previous conversation|session|forgot|memory)\b"),
    ("verification", r"\b(is it true|verify|confirm|check if|did .+ really|was .+ actually|correct that|support|contradict)\b"),
    ("timeline", r"\b(when|timeline|history|chronolog|before|after|sequence|first|last|recent|march|april|january|february|date)\b"),
    ("synthesis", r"\b(summarize|overview|compare|contrast|relationship between|how .+ relate|differences? between|similarities)\b"),
    ("report", r"\b(report|all .+ about|comprehensive|everything|full list|enumerate|inventory|catalog)\b"),
    ("entity_centric", r"\b(who is|what is|tell me about|describe|details on|info on|explain)\b"),
]
# Patterns of the second classifier.
MODES_V2 = [
    ("assistant_memory", r"\b(remember|recall|you told me|we discussed|last time|previous conversation|session|forgot|memory|you said|you mentioned|earlier you|we talked about)\b"),
    ("verification", r"\b(is it true|verify|confirm|check if|did .+ really|was .+ actually|correct that|support|contradict|is this accurate|fact.?check|prove|evidence for|evidence against)\b"),
    ("procedure", r"\b(how to|how do i|how can i|steps to|instructions|guide|tutorial|procedure|process for|way to|method for|walk me through|show me how|help me)\b"),
    ("comparison", r"\b(compare|contrast|difference|differences|similar|similarities|versus|vs\.?|better|worse|pros and cons|advantages|disadvantages|how does .+ differ|what.+s the difference|which is)\b"),
    ("timeline", r"\b(when|timeline|history|chronolog|before|after|sequence|first|last|recent|march|april|january|february|may|june|july|august|september|october|november|december|date|year \d{4}|in \d{4}|yesterday|today|tomorrow|last (?:week|month|year)|what happened|occurred)\b"),
    ("synthesis", r"\b(summarize|overview|summary|combine|integrate|big picture|main points|key takeaways|essence of)\b"),
    ("report", r"\b(report|all .+ about|comprehensive|everything|full list|enumerate|inventory|catalog|complete|exhaustive|detailed|all instances|every|each)\b"),
    ("fact_lookup", r"\b(what|where|which|whose|how many|how much|password|ip address|port|version|name of|value of|setting|config|credential|key|secret|token)\b"),
]
# Patterns of the states of a session; each counts once.
STATES = {
    "debugging": [r"\b(?:error|fail|bug|crash|exception|traceback|broken|issue|problem)\b", r"\b(?:not working|doesn't work|won't start|can't connect)\b", r"\b(?:debug|investigate|diagnose|troubleshoot|fix)\b", r"stack\s*trace"],
    "planning": [r"\b(?:how (?:should|do|would|can) (?:we|I|you))\b", r"\b(?:plan|approach|strategy|design|architect)\b", r"\b(?:steps? to|roadmap|outline)\b"],
    "recalling": [r"\b(?:remember|recall|mentioned|said|told me)\b", r"\b(?:last time|previously|earlier|before|yesterday)\b", r"\b(?:what was|where was|when did)\b"],
    "exploring": [r"\b(?:what is|what are|explain|describe|tell me about)\b", r"\b(?:how does|how do|how is)\b", r"\b(?:overview|introduction|summary)\b"],
    "executing": [r"\b(?:do it|run it|execute|apply|make the change)\b", r"\b(?:go ahead|proceed|start|begin|continue)\b", r"\b(?:deploy|push|commit|save|update)\b"],
    "confirming": [r"\b(?:is that (?:right|correct)|does that (?:work|look))\b", r"\b(?:verify|confirm|check|validate)\b", r"\b(?:are you sure|did it work|is it working)\b"],
}


def state_scores(text: Column) -> Column:
    """A map of states to min(1, 0.2 times the patterns that match)."""
    score = lambda ps: F.least(F.lit(1.0), sum((F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)).cast("int") for p in ps), F.lit(0)) * 0.2)
    return F.map_from_arrays(F.array(*[F.lit(s) for s in STATES]), F.array(*[score(p) for p in STATES.values()]))


def best_state(text: Column) -> Column:
    """The state of the highest share, the first of equals; idle if its share is below one half or nothing matches."""
    scores = F.map_entries(state_scores(text))
    whole = F.aggregate(scores, F.lit(0.0), lambda a, e: a + e["value"])
    top = F.array_max(F.transform(scores, lambda e: e["value"]))
    name = F.get(F.filter(scores, lambda e: e["value"] == top), F.lit(0))["key"]
    return F.when((whole == 0) | (top / F.greatest(whole, F.lit(1e-9)) < 0.5), "idle").otherwise(name)


# Vague words, each of which lowers specificity, and the patterns that raise it.
VAGUE = ["some", "many", "few", "often", "usually", "sometimes", "maybe", "perhaps", "might", "could", "probably"]
SPECIFIC = [
    (r"[0-9]+", 0.15), (r"(?s)(^|^.|[^.] |[^ ])[A-Z][a-z]+", 0.10), (r"[a-z]+_[a-z]+|[a-z]+\.[a-z]+", 0.10),
    (r"(?i)[0-9]{1,2}[:/][0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}|January|February|March|April|May|June|July|August|September|October|November|December", 0.15),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|:[0-9]+|/[A-Za-z0-9_]+/", 0.10),
]


def specificity(text: Column) -> Column:
    """0.3, more for numbers, names (not at the start of a sentence), identifiers, dates and addresses, less for each vague word; within 0 and 1."""
    has = lambda p, w: F.when(text.rlike(p), w).otherwise(0.0)
    gained = sum((has(p, w) for p, w in SPECIFIC), F.lit(0.0))
    vague = sum((has(rf"(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])", 0.05) for w in VAGUE), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 + gained - vague))


def clean_page_text(text: Column) -> Column:
    """Repairs of extracted text: hyphens at line ends, ligatures, page numbers, rules, runs of blank lines."""
    out = F.regexp_replace(text, r"(\w)-[ \t]*\n[ \t]*(\w)", "$1$2")
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.regexp_replace(out, ligature, letters)
    out = F.regexp_replace(out, r"(?m)^[ \t]*(?:Page )?\d{1,4}[ \t]*$", "")
    out = F.regexp_replace(out, r"(?m)^[-_=]{4,}[ \t]*$", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def mime_type(name: Column) -> Column:
    """The type of a file by its extension."""
    kinds = {"md": "text/markdown", "txt": "text/plain", "jsonl": "application/jsonl", "json": "application/json", "pdf": "application/pdf", "sqlite": "application/x-sqlite3", "db": "application/x-sqlite3", "html": "text/html", "csv": "text/csv"}
    out = F
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    for k, v in kinds.items():
        out = out.when(ext == k, v)
    return out.otherwise("application/octet-stream")
