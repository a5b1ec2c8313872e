"""Evidence queries over documents and pages, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from .views import ISSUES_SQL, issues, load, quoted, sql_list


def _any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(w)})" for w in words) + ")"


def _ends(expr: str, tails) -> str:
    return "(" + " OR ".join(f"ends_with({expr}, {quoted(w)})" for w in tails) + ")"


def _case(rules: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {quoted(k)}" for k, t in rules.items()) + f" ELSE {quoted(otherwise)} END"


def _labels(rules: dict[str, str]) -> str:
    """Labels that hold, joined by commas, in order."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN {quoted(k)} END" for k, t in rules.items()) + ")"


def _joined(c):
    return F.array_join(c, ",")


URLS_SQL = rf"""{ISSUES_SQL},
raw AS (SELECT instance_id, unnest(l) AS m, generate_subscripts(l, 1) AS k FROM
  (SELECT instance_id, regexp_extract_all(issue_text, 'https?://[^\s<>()\[\]"'']+') AS l FROM issues)),
urls AS (SELECT instance_id, url, row_number() OVER (PARTITION BY instance_id ORDER BY k) - 1 AS pos FROM
  (SELECT instance_id, rtrim(m, '.,;:') AS url, min(k) AS k FROM raw GROUP BY ALL) WHERE url <> '')"""

_DOMAIN = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_IS_IMAGE = f"(contains(lower(url), {quoted(E.IMAGE_HOST)}) OR {_ends('split_part(lower(url), chr(63), 1)', E.IMAGE_EXTENSIONS)})"

_KINDS = {
    "image_asset": f"contains(domain, {quoted(E.IMAGE_HOST)}) OR {_ends('path', E.IMAGE_EXTENSIONS)}",
    "github_pr": "contains(domain, 'github.com') AND contains(path, '/pull/')",
    "github_commit": "contains(domain, 'github.com') AND (contains(path, '/commit/') OR contains(path, '/commits/'))",
    "github_diff": "contains(domain, 'github.com') AND (contains(path, '/compare/') OR contains(path, '/files') OR ends_with(path, '.diff') OR ends_with(path, '.patch'))",
    "github_code": "contains(domain, 'github.com') AND contains(path, '/blob/')",
    "github_issue": "contains(domain, 'github.com') AND contains(path, '/issues/')",
    "github_repo_or_search": "contains(domain, 'github.com')",
    "reproduction_playground": f"{_any('domain', E.REPRODUCTION_HOSTS)} OR contains(lower(url), 'playground')",
    "docs_reproduction_sample": "contains(path, '/docs/') AND contains(path, '/samples/')",
    "docs_api": f"{_any('domain', E.DOCS_HOSTS)} OR contains(path, '/docs')",
    "product_or_repro_page": _ends("domain", E.PRODUCT_HOSTS),
}
CLASSIFIED_SQL = rf"""{URLS_SQL},
parts AS (SELECT *, {_DOMAIN} AS domain, lower({_PATH}) AS path FROM urls),
kinds AS (SELECT *, {_case(_KINDS, 'external_page')} AS url_type FROM parts),
links AS (SELECT instance_id, pos, url, domain, url_type, role,
  CASE WHEN role = 'leakage_risk' THEN 'high' WHEN url_type IN ('github_code', 'github_issue') THEN 'medium' ELSE 'low' END AS leakage_risk
  FROM (SELECT *, CASE WHEN url_type = 'image_asset' THEN 'visual_evidence'
    WHEN url_type IN ('github_pr', 'github_commit', 'github_diff') THEN 'leakage_risk'
    WHEN url_type = 'github_code' THEN 'code_evidence_seed' WHEN url_type = 'github_issue' THEN 'historical_discussion'
    WHEN url_type = 'github_repo_or_search' THEN 'repository_context'
    WHEN url_type IN ('reproduction_playground', 'docs_reproduction_sample', 'product_or_repro_page') THEN 'reproduction_entry'
    WHEN url_type = 'docs_api' THEN 'spec_or_api_semantics' ELSE 'weak_context' END AS role FROM kinds))"""


def _issue_column(name: str, column, sql: str, unnamed: bool = False):
    def run(spark, sf_dir):
        return issues(spark, sf_dir).select("instance_id", column(F.col("issue_text")).alias(name))

    return run, f"WITH {ISSUES_SQL} SELECT instance_id, {sql} AS {name} FROM issues"


def _urls(spark, sf_dir):
    return E.extract_urls(issues(spark, sf_dir))


def p2_merge_urls(spark, sf_dir):
    urls = _urls(spark, sf_dir)
    images = urls.where(E.is_image_url(F.col("url")))
    return E.merge_urls(images, urls)


def p3_image_urls(spark, sf_dir):
    return _urls(spark, sf_dir).select("instance_id", "pos", "url", E.is_image_url(F.col("url")).alias("is_image"))


def p4_classify_url(spark, sf_dir):
    return E.classify_url(_urls(spark, sf_dir))


def p5_inspect_url(spark, sf_dir):
    rows = E.inspect_url(_urls(spark, sf_dir))
    return rows.select("instance_id", "pos", "kind", "inspect_role", "inspect_risk", "tool", "localization_use")


_INSPECT = {
    "github": "ends_with(domain, 'github.com')",
    "playground": _any("domain", E.TOOL_PLAYGROUNDS),
    "product_or_repro_page": _ends("domain", E.PRODUCT_HOSTS),
    "docs_sample": "contains(path, '/docs/') AND contains(path, '/samples/')",
    "docs": f"{_any('domain', E.DOCS_HOSTS)} OR contains(path, '/docs')",
}
_GH_SQL = r"""CASE WHEN len(p) >= 4 AND p[3] = 'blob' THEN 'code' WHEN len(p) >= 3 AND p[3] = 'issues' THEN 'issue'
  WHEN len(p) >= 3 AND p[3] = 'pull' THEN 'pull_request' WHEN len(p) >= 3 AND p[3] IN ('commit', 'commits') THEN 'commit'
  WHEN len(p) >= 3 AND p[3] = 'compare' THEN 'diff_or_compare' ELSE 'unknown' END"""
_GH_PARTS = rf"list_filter(list_transform(string_split({_PATH}, '/'), lambda x: url_decode(x)), lambda x: x <> '')"
P5_SQL = rf"""WITH {URLS_SQL},
a AS (SELECT *, {_DOMAIN} AS domain, lower({_PATH}) AS path, {_GH_PARTS} AS p FROM urls),
b AS (SELECT *, {_case(_INSPECT, 'web')} AS kind, {_GH_SQL} AS gh FROM a),
c AS (SELECT *, CASE WHEN kind = 'github' AND gh IN ('pull_request', 'commit', 'diff_or_compare') THEN 'leak'
  WHEN kind = 'github' AND gh = 'code' THEN 'code' WHEN kind = 'github' AND gh = 'issue' THEN 'issue'
  WHEN kind IN ('playground', 'product_or_repro_page', 'docs_sample', 'docs') THEN kind
  WHEN kind = 'web' AND {_ends('path', E.IMAGE_EXTENSIONS)} THEN 'image' ELSE 'other' END AS r FROM b)
SELECT instance_id, pos, kind,
  CASE r WHEN 'leak' THEN 'leakage_skip' WHEN 'code' THEN 'code_evidence_seed' WHEN 'issue' THEN 'historical_discussion'
    WHEN 'docs' THEN 'spec_or_api_semantics' WHEN 'image' THEN 'visual_evidence' WHEN 'other' THEN 'weak_context' ELSE 'reproduction_entry' END AS inspect_role,
  CASE r WHEN 'leak' THEN 'high' WHEN 'code' THEN 'medium' WHEN 'issue' THEN 'medium' ELSE 'low' END AS inspect_risk,
  CASE r WHEN 'leak' THEN 'skip_for_localization' WHEN 'code' THEN 'repo_seed_expand' WHEN 'playground' THEN 'reproduction_extractor'
    WHEN 'docs_sample' THEN 'reproduction_extractor' WHEN 'image' THEN 'image_inspector' ELSE 'web_snapshot' END AS tool,
  CASE r WHEN 'leak' THEN 'do_not_use' WHEN 'code' THEN 'use_as_seed_not_target' WHEN 'issue' THEN 'extract_issue_terms_without_patch_links'
    WHEN 'playground' THEN 'extract_input_config_behavior' WHEN 'product_or_repro_page' THEN 'extract_route_query_business_entities_and_reproduction_behavior'
    WHEN 'docs_sample' THEN 'extract_docs_sample_api_behavior_and_event_config' WHEN 'docs' THEN 'extract_api_names_and_behavior_rules'
    WHEN 'image' THEN 'extract_visual_symptom' ELSE 'semantic_context' END AS localization_use FROM c"""


def p6_parse_github_url(spark, sf_dir):
    rows = E.parse_github_url(_urls(spark, sf_dir)).where(F.col("url").contains("github.com"))
    return rows.select("instance_id", "pos", "github_kind", "gh_repo", "gh_ref", "gh_path", "gh_line")


P6_SQL = rf"""WITH {URLS_SQL},
a AS (SELECT *, {_GH_PARTS} AS p, regexp_extract(regexp_extract(url, '^[^#]*#(.*)$', 1), 'L(\d+)', 1) AS line FROM urls WHERE contains(url, 'github.com')),
b AS (SELECT *, {_GH_SQL} AS github_kind FROM a)
SELECT instance_id, pos, github_kind, CASE WHEN len(p) >= 2 THEN p[1] || '/' || p[2] END AS gh_repo,
  CASE WHEN github_kind = 'code' THEN p[4] END AS gh_ref,
  CASE WHEN github_kind = 'code' AND len(p) > 4 THEN array_to_string(p[5:], '/') END AS gh_path,
  CASE WHEN github_kind = 'code' AND line <> '' THEN CAST(line AS INT) END AS gh_line FROM b"""


def _page_urls(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", "url")


def p7_route_terms(spark, sf_dir):
    return _page_urls(spark, sf_dir).select("page_id", _joined(E.route_terms(F.col("url"))).alias("terms"))


_FIRST = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_ROUTE_CTE = rf"""q AS (SELECT page_id, url, {_DOMAIN} AS domain,
  list_concat(
    list_filter(regexp_split_to_array(url_decode({_PATH}), '[/_.\-]+'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^\d+$') AND lower(t) NOT IN ('http', 'https', 'www', 'com')),
    list_filter(flatten(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]+=.+')),
      lambda x: [split_part(x, '=', 1), url_decode(regexp_extract(x, '=(.*)$', 1))])), lambda t: length(t) >= 3 AND length(t) <= 80)) AS l FROM pages),
r AS (SELECT page_id, url, domain, {_FIRST('l')}[1:24] AS terms FROM q)"""
P7_SQL = f"WITH {_ROUTE_CTE} SELECT page_id, array_to_string(terms, ',') AS terms FROM r"


def p8_semantic_terms(spark, sf_dir):
    links = E.inspect_url(_page_urls(spark, sf_dir))
    return links.select("page_id", _joined(E.semantic_terms(F.col("url"), F.col("kind"), F.col("inspect_role"))).alias("terms"))


P8_SQL = rf"""WITH {_ROUTE_CTE},
s AS (SELECT page_id, list_concat(terms, list_filter(regexp_split_to_array(domain, '[.\-]+'), lambda t: length(t) >= 3 AND t NOT IN ('www', 'com', 'org', 'net'))[1:4]) AS l FROM r)
SELECT page_id, array_to_string({_FIRST('l')}[1:32], ',') AS terms FROM s"""

_BODY = "split_part(split_part(split_part(issue_text, chr(10) || '[Multimodal Context - Compact]', 1), chr(10) || '[Adapter Note]', 1), chr(10) || '[adapter_fallback=', 1)"


def p9_classify_image(spark, sf_dir):
    base = issues(spark, sf_dir)
    images = E.extract_urls(base).where(E.is_image_url(F.col("url"))).join(base.select("instance_id", "issue_text"), "instance_id")
    kind, role, extension = E.classify_image(F.col("url"), F.col("issue_text"))
    return images.select("instance_id", "pos", kind.alias("image_type"), role.alias("role"), extension.alias("extension"))


_EXT = r"regexp_extract(split_part(lower(url), chr(63), 1), '[^/.](\.[^./]+)$', 1)"
IMAGES_SQL = rf"""{URLS_SQL},
images AS (SELECT u.instance_id, u.pos, {_EXT} AS extension, lower({_BODY}) AS low, issue_text
  FROM urls u JOIN issues i ON u.instance_id = i.instance_id WHERE {_IS_IMAGE}),
typed AS (SELECT *, {_case({'svg_or_vector': "extension = '.svg'"} | {k: _any('low', v) for k, v in E.IMAGE_WORDS.items()}, 'generic_visual')} AS image_type FROM images)"""
P9_SQL = f"WITH {IMAGES_SQL} SELECT instance_id, pos, image_type, CASE WHEN extension = '.svg' THEN 'non_raster_or_auxiliary' ELSE 'visual_evidence' END AS role, extension FROM typed"


def p10_image_queries(spark, sf_dir):
    base = issues(spark, sf_dir)
    images = E.extract_urls(base).where(E.is_image_url(F.col("url"))).join(base.select("instance_id", "issue_text"), "instance_id")
    kind = E.classify_image(F.col("url"), F.col("issue_text"))[0]
    typed = images.withColumn("image_type", kind)
    return typed.select(
        "instance_id",
        "pos",
        _joined(E.image_layers(F.col("image_type"))).alias("layers"),
        _joined(E.image_queries(F.col("image_type"), F.col("issue_text"))).alias("queries"),
    )


_LAYERS = "CASE image_type " + " ".join(f"WHEN {quoted(k)} THEN {quoted(','.join(v))}" for k, v in E.IMAGE_LAYERS.items()) + " END"
_TYPE_QUERIES = "CASE image_type " + " ".join(f"WHEN {quoted(k)} THEN {sql_list(v)}" for k, v in E.IMAGE_TYPE_QUERIES.items()) + " ELSE [] END"
_OWN_QUERIES = "list_filter(" + sql_list(E.IMAGE_QUERY_WORDS) + ", lambda w: contains(lower(issue_text), w))"
P10_SQL = f"""WITH {IMAGES_SQL}, q AS (SELECT *, list_concat({_OWN_QUERIES}, {_TYPE_QUERIES}) AS l FROM typed)
SELECT instance_id, pos, {_LAYERS} AS layers, array_to_string({_FIRST('l')}[1:12], ',') AS queries FROM q"""


def p11_image_heuristic(spark, sf_dir):
    rows = E.image_heuristic(issues(spark, sf_dir))
    return rows.select("instance_id", _joined("layers").alias("layers"), _joined("entities").alias("entities"), _joined("queries").alias("queries"), "symptom")


def _hint_sql(i: int) -> str:
    return "list_concat(" + ", ".join(f"CASE WHEN {_any('low', rule[0])} THEN {sql_list(rule[i])} ELSE CAST([] AS VARCHAR[]) END" for rule in E.IMAGE_HINTS) + ")"


_SYMPTOM = "CASE " + " ".join(f"WHEN {_any('low', r[0])} THEN {quoted(r[4])}" for r in reversed(E.IMAGE_HINTS)) + " ELSE 'visual evidence needs VLM inspection' END"
P11_SQL = f"""WITH {ISSUES_SQL}, a AS (SELECT *, lower(issue_text) AS low FROM issues),
b AS (SELECT instance_id, {_hint_sql(1)} AS l, {_hint_sql(2)} AS e, list_concat({_hint_sql(3)}, list_filter(string_split(replace(repo, '-', '/'), '/'), lambda p: length(p) > 2)[1:4]) AS q, {_SYMPTOM} AS symptom FROM a)
SELECT instance_id, array_to_string({_FIRST('l')}, ',') AS layers, array_to_string({_FIRST('e')}, ',') AS entities, array_to_string({_FIRST('q')}[1:30], ',') AS queries, symptom FROM b"""


def p17_problem_types(spark, sf_dir):
    return E.sketches(issues(spark, sf_dir)).withColumn("problem_types", _joined("problem_types"))


P17_SQL = f"""WITH {CLASSIFIED_SQL},
g AS (SELECT instance_id, count(*) FILTER (WHERE NOT image) AS url_count, count(*) FILTER (WHERE image) AS image_count,
  bool_or(NOT image AND role = 'reproduction_entry') AS reproduces, bool_or(NOT image AND leakage_risk = 'high') AS leaks
  FROM (SELECT *, {_IS_IMAGE} AS image FROM links) GROUP BY instance_id),
j AS (SELECT i.instance_id, lower(issue_text) AS low, coalesce(url_count, 0) AS url_count, coalesce(image_count, 0) AS image_count,
  coalesce(reproduces, false) AS reproduces, coalesce(leaks, false) AS leaks FROM issues i LEFT JOIN g ON i.instance_id = g.instance_id)
SELECT instance_id, url_count, image_count,
  CASE WHEN url_count > 0 AND image_count > 0 THEN 'image_and_url' WHEN image_count > 0 THEN 'image_only' WHEN url_count > 0 THEN 'url_only' ELSE 'text_only' END AS modality,
  {_labels({'multimodal_visual_issue': 'image_count > 0', 'url_grounded_issue': 'url_count > 0', 'reproduction_driven_issue': 'reproduces', 'contains_leakage_url': 'leaks'} | {k: _any('low', v) for k, v in E.PROBLEM_WORDS.items()})} AS problem_types FROM j"""


def p28_tokenize(spark, sf_dir):
    rows = issues(spark, sf_dir).select("instance_id", F.explode(T.tokens("issue_text")).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("instance_id").alias("n_issues"))


TOKENS_SQL = rf"""m AS (SELECT instance_id, unnest(regexp_extract_all(issue_text, '[A-Za-z_][A-Za-z0-9_.$-]*')) AS m FROM issues),
tokens AS (SELECT instance_id, token FROM (
  SELECT instance_id, regexp_replace(lower(m), '^[._$-]+|[._$-]+$', '', 'g') AS token FROM m
  UNION ALL SELECT instance_id, unnest(string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')) FROM m) WHERE length(token) >= 2)"""
P28_SQL = f"WITH {ISSUES_SQL}, {TOKENS_SQL} SELECT token, count(*) AS n, count(DISTINCT instance_id) AS n_issues FROM tokens GROUP BY token"


def p21_ground_queries(spark, sf_dir):
    base = issues(spark, sf_dir)
    return E.grounded_queries(_guesses(base), base)


GUESSES = ("parser options", "src/core/parser.py", "legend tooltip", "max_retries handling", "unrelated guesswork")


def _guesses(base):
    return base.select("instance_id", F.explode(F.array(*map(F.lit, GUESSES))).alias("query"))


P21_SQL = rf"""WITH {ISSUES_SQL}, {TOKENS_SQL},
own AS (SELECT DISTINCT instance_id, token FROM tokens WHERE length(token) >= 4),
g AS (SELECT unnest({sql_list(GUESSES)}) AS query),
gm AS (SELECT query, unnest(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_.$-]*')) AS m FROM g),
gt AS (SELECT DISTINCT query, token FROM (SELECT query, regexp_replace(lower(m), '^[._$-]+|[._$-]+$', '', 'g') AS token FROM gm
  UNION ALL SELECT query, unnest(string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')) FROM gm) WHERE length(token) >= 4)
SELECT DISTINCT instance_id, query FROM own JOIN gt USING (token)
UNION SELECT instance_id, query FROM issues, g WHERE contains(query, '/') AND NOT contains(query, ' ')"""


def a1_concern_queries(spark, sf_dir):
    return E.concern_queries(issues(spark, sf_dir))


A1_SQL = rf"""WITH {ISSUES_SQL},
w AS (SELECT instance_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS k FROM
  (SELECT instance_id, regexp_extract_all(issue_text, '[A-Za-z_][A-Za-z0-9_.$/-]{{2,}}') AS l FROM issues)),
x AS (SELECT instance_id, k, 1 AS n, regexp_replace(lower(raw), '^[_./-]+|[_./-]+$', '', 'g') AS word FROM w),
r AS (SELECT instance_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 + 1000000000 AS k FROM
  (SELECT instance_id, regexp_split_to_array(repo, '[/_.\-]+') AS l FROM issues)),
u AS (SELECT * FROM x WHERE length(word) >= 4 AND word NOT IN ({', '.join(map(quoted, E.CONCERN_STOPWORDS))}) AND NOT starts_with(word, 'http')
  UNION ALL SELECT instance_id, k, 2, lower(raw) FROM r WHERE length(raw) > 2),
c AS (SELECT instance_id, word, sum(n) AS n, min(k) AS first FROM u GROUP BY ALL)
SELECT instance_id, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY n DESC, first, word) AS rank FROM c) WHERE rank <= 16"""


def a2_evidence_summary(spark, sf_dir):
    return E.evidence_summary(E.classify_url(_urls(spark, sf_dir)))


A2_SQL = f"WITH {CLASSIFIED_SQL} " + " UNION ALL ".join(
    f"SELECT '{f}' AS facet, {f} AS value, count(*) AS n FROM links GROUP BY {f}" for f in ("url_type", "role", "leakage_risk")
)


def a4_url_distribution(spark, sf_dir):
    return E.url_distribution(E.classify_url(_urls(spark, sf_dir)))


A4_SQL = f"""WITH {CLASSIFIED_SQL}
SELECT url_type, n, example_no, url FROM (SELECT url_type, url, count(*) OVER (PARTITION BY url_type) AS n,
  row_number() OVER (PARTITION BY url_type ORDER BY instance_id, pos) AS example_no FROM links) WHERE example_no <= 3"""

_SUMMARY = lambda n: f"CASE WHEN length(c) <= {n} THEN c ELSE rtrim(substr(c, 1, {n - 3})) || '...' END"


def p19_summarize(spark, sf_dir):
    return issues(spark, sf_dir).select(
        "instance_id", *[T.summarize("issue_text", n).alias(f"summary_{n}") for n in (420, 480, 180)]
    )


P19_SQL = rf"""WITH {ISSUES_SQL}, x AS (SELECT instance_id, trim(regexp_replace(issue_text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS c FROM issues)
SELECT instance_id, {_SUMMARY(420)} AS summary_420, {_SUMMARY(480)} AS summary_480, {_SUMMARY(180)} AS summary_180 FROM x"""


def p18_clean_issue(spark, sf_dir):
    return issues(spark, sf_dir).select("instance_id", F.md5(T.clean_issue("issue_text")).alias("body_md5"), F.length(T.clean_issue("issue_text")).alias("size"))


_CLEAN = rf"trim(regexp_replace(regexp_replace({_BODY}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[Original Issue\]\s*', '', 'g'))"
P18_SQL = f"WITH {ISSUES_SQL} SELECT instance_id, md5({_CLEAN}) AS body_md5, length({_CLEAN}) AS size FROM issues"

_SYMBOLS = "list_filter(list_transform(regexp_extract_all(issue_text, '`([^`]{2,120})`', 1), lambda s: trim(s)), lambda s: NOT (regexp_matches(s, '[ \\n\\t]') AND length(s) > 60))"


def _symbols(c):
    return _joined(E.symbol_queries(c))


QUERIES = {
    "p1_extract_urls": (_urls, f"WITH {URLS_SQL} SELECT instance_id, pos, url FROM urls"),
    "p2_merge_urls": (
        p2_merge_urls,
        f"WITH {URLS_SQL}, g AS (SELECT instance_id, url, min(CASE WHEN {_IS_IMAGE} THEN pos ELSE pos + 1000000 END) AS k FROM urls GROUP BY ALL) "
        "SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY k) - 1 AS pos, url FROM g",
    ),
    "p3_image_urls": (p3_image_urls, f"WITH {URLS_SQL} SELECT instance_id, pos, url, {_IS_IMAGE} AS is_image FROM urls"),
    "p4_classify_url": (p4_classify_url, f"WITH {CLASSIFIED_SQL} SELECT * FROM links"),
    "p5_inspect_url": (p5_inspect_url, P5_SQL),
    "p6_parse_github_url": (p6_parse_github_url, P6_SQL),
    "p7_route_terms": (p7_route_terms, P7_SQL),
    "p8_semantic_terms": (p8_semantic_terms, P8_SQL),
    "p9_classify_image": (p9_classify_image, P9_SQL),
    "p10_image_queries": (p10_image_queries, P10_SQL),
    "p11_image_heuristic": (p11_image_heuristic, P11_SQL),
    "p14_symbol_queries": _issue_column("symbols", _symbols, f"array_to_string({_FIRST(_SYMBOLS)}[1:12], ',')"),
    "p15_flow_hypotheses": _issue_column(
        "flows", lambda c: _joined(E.flow_hypotheses(c)), _labels({k: _any("lower(issue_text)", v) for k, v in E.FLOW_WORDS.items()})
    ),
    "p16_task_type": _issue_column("task", E.task_type, _case({k: _any("lower(issue_text)", v) for k, v in E.TASK_WORDS.items()}, "behavior_change")),
    "p17_problem_types": (p17_problem_types, P17_SQL),
    "p18_clean_issue": (p18_clean_issue, P18_SQL),
    "p19_summarize": (p19_summarize, P19_SQL),
    "p21_ground_queries": (p21_ground_queries, P21_SQL),
    "p28_tokenize": (p28_tokenize, P28_SQL),
    "a1_concern_queries": (a1_concern_queries, A1_SQL),
    "a2_evidence_summary": (a2_evidence_summary, A2_SQL),
    "a4_url_distribution": (a4_url_distribution, A4_SQL),
}
