"""Queries of terms, obligations and cleaned queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import metrics as M
from ..operators import terms as T
from .evidence_queries import CLASSIFIED_SQL, P5_SQL, _any
from .policy_queries import CAND_SQL, _candidates
from .search_queries import RG_SQL, _metrics_sql, _ranked, w14_rank_metrics
from .summary_queries import A6_SQL, a6_modality
from .views import ISSUES_SQL, issues, load, sql_list


def p20_clean_query(spark, sf_dir):
    texts = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query")).unionByName(
        load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("query"))
    )
    return texts.select("id", "query", T.clean_query("query").alias("cleaned"))


_Q = r"trim(regexp_replace(query, '\s+', ' ', 'g'))"
P20_SQL = rf"""WITH q AS (SELECT item_id AS id, text AS query FROM benchmark UNION ALL SELECT page_id, coalesce(url, '') FROM pages), c AS (SELECT *, {_Q} AS t FROM q),
w AS (SELECT *, list_filter(flatten(list_transform(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_.$-]*'), lambda m: [regexp_replace(lower(m), '^[._$-]+|[._$-]+$', '', 'g')] || string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' '))),
  lambda k: length(k) >= 3 AND NOT list_contains({sql_list(T.STOP_QUERY_TOKENS)}, k) AND NOT regexp_matches(k, '^\d+$')) AS l FROM c)
SELECT id, query, CASE WHEN contains(t, '/') OR contains(t, '::') OR regexp_matches(t, '\.[A-Za-z0-9]{{1,6}}\b') THEN substr(t, 1, 180) ELSE array_to_string(l[1:12], ' ') END AS cleaned FROM w"""


def p29_flow_terms(spark, sf_dir):
    return issues(spark, sf_dir).select("instance_id", F.array_join(T.flow_terms(F.col("issue_text")), ",").alias("terms"))


_HINTS = " || ".join(f"CASE WHEN contains(lower(issue_text), '{w}') THEN {sql_list(found)} ELSE [] END" for w, found in T.TERM_HINTS.items())
P29_SQL = rf"""WITH {ISSUES_SQL}, t AS (SELECT instance_id, list_distinct(regexp_extract_all(issue_text, '{T.PROPERTY}') || {_HINTS}) AS l FROM issues),
f AS (SELECT instance_id, list_filter(l, lambda x: regexp_replace(lower(x), '^[._\-$]+|[._\-$]+$', '', 'g') <> '' AND NOT list_contains({sql_list(T.FLOW_STOP_TERMS)}, regexp_replace(lower(x), '^[._\-$]+|[._\-$]+$', '', 'g'))
  AND NOT regexp_matches(regexp_replace(lower(x), '^[._\-$]+|[._\-$]+$', '', 'g'), '^(?:http|www)')) AS l FROM t)
SELECT instance_id, array_to_string(list_sort(l), ',') AS terms FROM f"""


def p32_flow_obligations(spark, sf_dir):
    return T.flow_obligations(issues(spark, sf_dir))


P32_SQL = f"WITH {ISSUES_SQL}, x AS (SELECT instance_id, lower(issue_text) AS low FROM issues) " + " UNION ALL ".join(
    f"SELECT instance_id, '{kind}' AS flow_type, '{state}' AS state, '{relation}' AS relation FROM x WHERE {_any('low', words)}" for kind, state, relation, words in T.OBLIGATIONS
)


def e14_planned_snapshot(spark, sf_dir):
    terms, kind = T.planned_snapshot(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(terms, ",").alias("terms"), kind.alias("doc_kind"))


_PATH = r"coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '')"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1))"
E14_SQL = rf"""SELECT page_id, array_to_string(list_filter(regexp_split_to_array({_PATH}, '[/_.-]+'), lambda t: length(t) >= 3 AND lower(t) NOT IN ('docs', 'latest', 'html'))[1:12], ',') AS terms,
CASE WHEN contains(lower({_PATH}), '/docs') OR {_any(_HOST, T.DOCS_HOSTS)} THEN 'api_or_docs' ELSE 'external_page' END AS doc_kind FROM pages"""

_TERMS = ("parser", "legend", "layout", "state", "type", "utils", "button", "backend", "url", "core")


def w6_path_semantic(spark, sf_dir):
    return _candidates(spark, sf_dir).select("doc_id", "path", T.path_semantic(F.col("path"), F.array(*map(F.lit, _TERMS))).alias("score"))


_THEMES = " + ".join(f"CASE WHEN len(list_intersect(m, {sql_list(words)})) > 0 THEN {bonus} ELSE 0 END" for bonus, words in T.THEMES)
W6_SQL = rf"""WITH {CAND_SQL}, l AS (SELECT doc_id, path, lower(regexp_replace(trim(replace(path, chr(92), '/')), '^[./]+', '')) AS low FROM cand),
f AS (SELECT *, regexp_split_to_array(low, '[/_.\-\s]+') AS parts, list_filter({sql_list(_TERMS)}, lambda t: contains(low, t)) AS m FROM l)
SELECT doc_id, path, CASE WHEN len(m) = 0 THEN 0.0 ELSE CAST(list_sum(list_transform(m, lambda t: CASE WHEN list_contains(parts, t) THEN 6.0 ELSE 3.0 END)) + CASE WHEN len(m) >= 2 THEN 12 ELSE 0 END
  + CASE WHEN len(m) >= 4 THEN 10 ELSE 0 END + {_THEMES} AS DOUBLE) END AS score FROM f"""


def a3_packet_summary(spark, sf_dir):
    links = E.classify_url(E.extract_urls(issues(spark, sf_dir)))
    tools = E.inspect_url(E.extract_urls(issues(spark, sf_dir)))
    facets = {
        "modality": a6_modality(spark, sf_dir).select(F.col("modality").alias("value")),
        "url_roles": links.select(F.col("role").alias("value")),
        "url_tools": tools.select(F.col("tool").alias("value")),
    }
    return T.packet_summary(facets, links.where("leakage_risk = 'high'"))


A3_SQL = f"""WITH {CLASSIFIED_SQL} SELECT 'leakage_urls' AS facet, '' AS value, count(*) AS n FROM links WHERE leakage_risk = 'high'
UNION ALL SELECT 'url_roles', role, count(*) FROM links GROUP BY role UNION ALL SELECT 'url_tools', tool, count(*) FROM ({P5_SQL}) GROUP BY tool
UNION ALL SELECT 'modality', modality, count(*) FROM ({A6_SQL}) GROUP BY modality"""


def r1_flatten_metrics(spark, sf_dir):
    return T.flatten_metrics(w14_rank_metrics(spark, sf_dir), M.unique_ranked(_ranked(spark, sf_dir)))


R1_SQL = f"""WITH {_metrics_sql()}, t AS (SELECT instance_id, max(CASE WHEN rank = 1 THEN 'd/' || doc_id END) AS top1, string_agg('d/' || doc_id, ' | ' ORDER BY rank) FILTER (WHERE rank <= 5) AS top5 FROM r GROUP BY 1)
SELECT m.*, top1, top5 FROM m JOIN t USING (instance_id)"""

QUERIES = {
    "p20_clean_query": (p20_clean_query, P20_SQL),
    "p29_flow_terms": (p29_flow_terms, P29_SQL),
    "p32_flow_obligations": (p32_flow_obligations, P32_SQL),
    "e14_planned_snapshot": (e14_planned_snapshot, E14_SQL),
    "w6_path_semantic": (w6_path_semantic, W6_SQL),
    "a3_packet_summary": (a3_packet_summary, A3_SQL),
    "r1_flatten_metrics": (r1_flatten_metrics, R1_SQL),
}
