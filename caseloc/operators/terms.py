"""Terms, obligations and cleaned queries read off texts, addresses and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, collapse, normalize_path, tokens
from .evidence import url_parts

# Words that are no query, names of properties, terms that are no flow, words that ask for more terms, obligations.
STOP_QUERY_TOKENS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "does", "for", "from", "has", "have", "if", "in", "into", "is", "it",
    "its", "not", "of", "on", "or", "should", "that", "the", "their", "then", "this", "to", "was", "when", "where", "with", "without", "would",
    "you", "using", "use", "used", "true", "false", "null", "none", "issue", "problem", "expected", "actual", "error", "bug", "fix", "file", "code",
)
PROPERTY = r"\b(?:on[A-Z][A-Za-z0-9_]*|[A-Za-z_][A-Za-z0-9_]*_(?:id|url|path|state)|redirect_to|client_id)\b"
FLOW_STOP_TERMS = (
    "around", "behavior", "component", "evidence", "function", "implementation", "main", "only", "reproduction_understanding", "behavior_to_code_layer",
    "url_evidence_interpretation", "click", "clicked", "wordpress", "wordpress.com", "site", "div", "span",
)
TERM_HINTS = {
    "mouse": ("mousemove", "mouseout", "hover", "leave"), "legend": ("legend", "legendHitBoxes", "_hoveredItem"), "onleave": ("onLeave",), "onhover": ("onHover",),
}
#: Flow type, state, relation, and the words that raise it.
OBLIGATIONS = (
    ("state_selector_use_chain", "email_verified/current_user", "USED_BY", ("email_verified", "selector", "state selector", "current-user")),
    ("ui_event_to_handler", "mouse/legend item state", "CALL", ("hover", "leave", "legend", "mousemove", "mouseout", "onclick", "callback")),
    ("ownership_transfer_action_flow", "current_owner/selected_administrator", "ACTION+STATE", ("ownership",)),
    ("serializer_backend_call_chain", "kdf_rounds/encryption_algorithm", "CALL+PARAMETER", ("kdf", "openssh", "private_key", "serialize", "serialization")),
    ("visual_style_pipeline_flow", "style property/config", "CALL+CONFIG", ("margin", "stylesheet", "style", "layout", "react-pdf", "yoga")),
    ("url_builder_or_route_flow", "route/url parameters", "CALL+DATA", ("redirect", "href", "url builder", "route", "post_id", "client_id", "link")),
    ("python_type_binding_flow", "symbol table / TypeInfo", "TYPE_FLOW", ("mypy", "typeinfo", "deleted variable", "binder", "declaration", "typevars")),
    ("parameter_or_config_flow", "option/config parameter", "PARAMETER", ("option", "config", "parser", "flag", "parameter", "rounds")),
)
DOCS_HOSTS = ("readthedocs", "docs.", "developer.", "api.", "devdocs")
THEMES = (
    (10.0, ("woocommerce", "dashboard", "address", "location", "countries")), (8.0, ("legend", "plugin", "hover", "leave")), (8.0, ("stylesheet", "resolve", "expand", "layout", "margin")),
    (8.0, ("serializer", "serialization", "backend", "ssh", "kdf")), (8.0, ("binder", "semantic", "deleted", "type")),
)


def clean_query(query: Column | str) -> Column:
    """A query for retrieval: one with a slash, ``::`` or an extension is kept up
    to 180 letters, of others the first 12 tokens that say something."""
    text = collapse(query)
    kept = text.contains("/") | text.contains("::") | text.rlike(r"\.[A-Za-z0-9]{1,6}\b")
    words = F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_QUERY_TOKENS) & ~t.rlike(r"^\d+$"))
    return F.when(kept, F.substring(text, 1, 180)).otherwise(F.array_join(F.slice(words, 1, 12), " "))


def flow_terms(text: Column) -> Column:
    """Names of properties, identifiers and events in a text, and the terms that
    its words hint at, sorted; without stop terms and addresses."""
    low = F.lower(text)
    hinted = [F.when(low.contains(word), F.array(*map(F.lit, found))).otherwise(F.array().cast("array<string>")) for word, found in TERM_HINTS.items()]
    every = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(0)), *hinted))
    bare = lambda t: F.regexp_replace(F.lower(t), r"^[._\-$]+|[._\-$]+$", "")
    return F.array_sort(F.filter(every, lambda t: (bare(t) != "") & ~bare(t).isin(*FLOW_STOP_TERMS) & ~bare(t).rlike("^(?:http|www)")))


def flow_obligations(issues: DataFrame) -> DataFrame:
    """(instance_id, flow_type, state, relation): what a text obliges a change to
    follow, by independent rules."""
    low = F.lower("issue_text")
    rules = [F.when(any_of(low, words), F.struct(F.lit(kind).alias("flow_type"), F.lit(state).alias("state"), F.lit(relation).alias("relation"))) for kind, state, relation, words in OBLIGATIONS]
    return issues.select("instance_id", F.inline(F.array_compact(F.array(*rules))))


def planned_snapshot(url: Column) -> tuple[Column, Column]:
    """(terms, kind) of a page that is not fetched: words of its path, and
    whether it is documentation."""
    parts = url_parts(url)
    path = F.coalesce(parts["path"], F.lit(""))
    words = F.filter(F.split(path, r"[/_.-]+"), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin("docs", "latest", "html"))
    docs = F.lower(path).contains("/docs") | any_of(F.lower(parts["domain"]), DOCS_HOSTS)
    return F.slice(words, 1, 12), F.when(docs, "api_or_docs").otherwise("external_page")


def path_semantic(path: Column, terms: Column) -> Column:
    """Score of a path for terms: 6 for one that is a part of it, 3 inside it, of
    the first 12 that are there; 12 more for two, 10 more for four, and by themes."""
    low = F.lower(normalize_path(path))
    parts = F.array_distinct(F.split(low, r"[/_.\-\s]+"))
    found = F.slice(F.array_distinct(F.filter(terms, lambda t: (t != "") & low.contains(t))), 1, 12)
    each = F.aggregate(found, F.lit(0.0), lambda a, t: a + F.when(F.array_contains(parts, t), 6.0).otherwise(3.0))
    more = F.when(F.size(found) >= 2, 12.0).otherwise(0.0) + F.when(F.size(found) >= 4, 10.0).otherwise(0.0)
    for bonus, words in THEMES:
        more = more + F.when(F.arrays_overlap(found, F.array(*map(F.lit, words))), bonus).otherwise(0.0)
    return F.when(F.size(found) > 0, each + more).otherwise(0.0)


def packet_summary(facets: dict[str, DataFrame], leaks: DataFrame) -> DataFrame:
    """(facet, value, n): counts of each facet's values (value; missing ones are
    ``unknown``) and the number of leaking links."""
    out = leaks.agg(F.count("*").alias("n")).select(F.lit("leakage_urls").alias("facet"), F.lit("").alias("value"), "n")
    for name, df in facets.items():
        counts = df.groupBy(F.coalesce("value", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
        out = out.unionByName(counts.select(F.lit(name).alias("facet"), "value", "n"))
    return out


def flatten_metrics(metrics: DataFrame, ranked: DataFrame) -> DataFrame:
    """metrics with top1 and top5, the first items joined by `` | ``."""
    few = ranked.where("rank <= 5").groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("x"))
    items = F.transform("x", lambda r: r["item"])
    tops = few.select("instance_id", F.get(items, F.lit(0)).alias("top1"), F.array_join(items, " | ").alias("top5"))
    return metrics.join(tops, "instance_id", "left").na.fill("", ["top1", "top5"])
