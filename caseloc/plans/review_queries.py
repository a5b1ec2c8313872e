"""Reviews and result logs: each document makes an answer, whole, fenced, cut off or
without an object, and each customer a nested result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import dealt, kept
from ..operators import followups as U
from ..operators import reviews as R
from .views import load


def _responses(spark, sf_dir):
    """One of five forms of an answer about documents doc_id and doc_id + 1."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    quote = F.regexp_extract("text", r"[A-Za-z]{2,} [A-Za-z]{2,} [A-Za-z]{2,}", 0)
    return docs.select("doc_id", quote.alias("q")).selectExpr("doc_id AS instance_id", f"{_ANSWER} AS response")


_ONE = """'{"path": "./d/' || doc_id || '", "role": "Patch_Target", "confidence": 0.9, "evidence_quote": "' || q || '", "mechanism_verified": true, "patch_mechanism": "set {x} ' || chr(92) || '"y' || chr(92) || '"", "matched_issue_axes": ["concern", "flow", "Flow"], "entities": [{"kind": "Function", "name": "' || split_part(q, ' ', 1) || '"}, {"kind": "other", "name": "zz"}]}'"""
_TWO = """'{"path": "d/' || (doc_id + 1) || '", "role": "supporting_target", "confidence": "1.7", "evidence_quote": "no such } quote { at all", "entities": []}'"""
_REST = """'{"path": "d/' || doc_id || '", "role": "unlikely"}, {"path": "zz", "role": "patch_target"}'"""
_LIST = f"""'{{"candidates": [' || {_ONE} || ', ' || {_TWO} || ', ' || {_REST} || '], "continue_search": ' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || ', "missing_evidence": [' || CASE WHEN doc_id % 4 = 0 THEN '"The  caller of it"' ELSE '"a log"' END || ']}}'"""
_CUT = f"""'{{"continue_search": true, "candidates": [' || {_ONE} || ', ' || {_TWO} || ', {{"path": "d/' || doc_id || '", "role": "unl'"""
_ANSWER = f"""CASE doc_id % 5 WHEN 0 THEN {_LIST} WHEN 1 THEN '```json' || chr(10) || {_LIST} || chr(10) || '```' WHEN 2 THEN {_CUT} WHEN 3 THEN 'no object }} here {{ "candidates": none'
  ELSE 'Here it is: ' || {_LIST} || ' as asked' END"""


def _reviewed(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    heads, candidates = R.review_objects(_responses(spark, sf_dir))
    place = lambda step: docs.select(F.col("doc_id").alias("instance_id"), F.concat(F.lit("d/"), (F.col("doc_id") + step).cast("string")).alias("path"))
    shown = docs.select(F.col("doc_id").alias("instance_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return kept(heads, "heads"), R.validated_reviews(candidates, place(0).unionByName(place(1)), shown)


def u12_validate_reviews(spark, sf_dir):
    _, reviews = _reviewed(spark, sf_dir)
    names = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["name"])), ",")
    return reviews.select("instance_id", "path", "role", "confidence", "evidence_quote", "grounded", "quote_supported", "entity_supported", "mechanism_verified", F.array_join("axes", ",").alias("axes"), names.alias("entities"))


def u12_review_stops(spark, sf_dir):
    return R.review_stops(*_reviewed(spark, sf_dir))


# The same from what the answers were made of, without reading them.
REVIEWED_SQL = r"""d AS (SELECT doc_id AS instance_id, regexp_extract(text, '[A-Za-z]{2,} [A-Za-z]{2,} [A-Za-z]{2,}') AS q, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS ctx FROM documents),
one AS (SELECT instance_id, 'd/' || instance_id AS path, 'patch_target' AS role, 0.9 AS confidence, q AS evidence_quote, true AS grounded, length(q) >= 8 AND contains(ctx, lower(q)) AS quote_supported,
  q <> '' AND contains(ctx, lower(split_part(q, ' ', 1))) AS entity_supported, 'concern,flow' AS axes, CASE WHEN q = '' THEN '' ELSE 'function:' || split_part(q, ' ', 1) END AS entities FROM d WHERE instance_id % 5 <> 3),
two AS (SELECT instance_id, 'd/' || (instance_id + 1), 'supporting_target', 1.0, 'no such } quote { at all', false, false, false, '', '' FROM d WHERE instance_id % 5 <> 3),
rv AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""
U12_SQL = f"""WITH {REVIEWED_SQL} SELECT instance_id, path, role, CAST(confidence AS DOUBLE) AS confidence, evidence_quote, grounded, quote_supported, entity_supported, quote_supported AND entity_supported AS mechanism_verified, axes, entities FROM rv"""
U12_STOPS_SQL = f"""WITH {REVIEWED_SQL} SELECT d.instance_id, CASE d.instance_id % 5 WHEN 2 THEN 'partial_candidate_recovery' WHEN 3 THEN 'invalid' ELSE 'complete_json' END AS mode,
  CASE WHEN d.instance_id % 5 = 3 THEN 0 ELSE 2 END AS candidates, CASE d.instance_id % 5 WHEN 2 THEN true WHEN 3 THEN false ELSE d.instance_id % 3 = 0 END AS continue_search,
  CASE WHEN d.instance_id % 5 IN (0, 1, 4) AND d.instance_id % 4 = 0 THEN 1 ELSE 0 END AS critical,
  coalesce(quote_supported AND entity_supported, false) AND NOT (d.instance_id % 5 IN (0, 1, 4) AND d.instance_id % 4 = 0) AS stop_ready FROM d LEFT JOIN one USING (instance_id)"""


# --- nested results of customers ---


def _results(spark, sf_dir):
    customers = dealt(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return customers.selectExpr("c_custkey AS instance_id", f"parse_json({_RESULT}) AS result")


_FLOWS = """CASE c_custkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{"backend": "chain", "flow_type": "a"}]' ELSE '[{"backend": "slice", "flow_type": "b"}, {"backend": "chain", "flow_type": "b"}, {"term": "t"}]' END"""
_RESULT = f"""'{{"instance_id": "' || c_custkey || '", "status": "' || CASE WHEN c_custkey % 9 = 0 THEN 'error' ELSE 'ok' END || '", "elapsed_seconds": ' || (c_custkey % 70) || ', "evidence": {{"evidence_packet": {{"modality": "' || c_mktsegment
  || '", "url_inspections": [1, 2], "image_inspections": []}}, "llm_planning": {{"decision": "plan ' || c_custkey || '"}}, "llm_understanding": ' || CASE WHEN c_custkey % 2 = 0 THEN '{{}}' ELSE '{{"analysis": "' || c_name || '"}}' END
  || '}}, "localization": {{"flow_traces": ' || {_FLOWS} || ', "ranked_locations": [{{"path": "a' || (c_custkey % 5) || '.py"}}, {{"path": "b.py"}}], "react_agent_trace": {{"steps": [{{"tool": "x"}}, {{"llm_raw": "' || repeat('ab', CAST(c_custkey % 1200 AS INT))
  || '", "usage": {{"total_tokens": ' || c_custkey || '}}}}]}}}}, "zz": {{"raw_response": {{"id": "r' || c_custkey || '", "usage": {{"n": 1}}, "llm_raw": "hidden"}}, "content": "done"}}}}'"""


def a9_llm_events(spark, sf_dir):
    return R.llm_events(_results(spark, sf_dir))


A9_SQL = """WITH e AS (
  SELECT c_custkey AS instance_id, 1 AS o, 'evidence.llm_planning' AS path, 'llm_evidence_planning' AS event_type, '' AS response_id, 'plan ' || c_custkey AS content, '{}' AS usage FROM customer
  UNION ALL SELECT c_custkey, 2, 'evidence.llm_understanding', 'llm_evidence_understanding', '', c_name, '{}' FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, 3, 'localization.react_agent_trace.steps[1]', 'react_or_controller_raw', '', CASE WHEN c_custkey % 1200 = 0 THEN '{"llm_raw":"","usage":{"total_tokens":' || c_custkey || '}}'
    WHEN 2 * (c_custkey % 1200) > 2000 THEN repeat('ab', 1000) || '...<truncated>' ELSE repeat('ab', c_custkey % 1200) END, '{"total_tokens":' || c_custkey || '}' FROM customer
  UNION ALL SELECT c_custkey, 4, 'zz', 'llm_response', 'r' || c_custkey, 'done', '{"n":1}' FROM customer)
SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY o) AS event_no, path, event_type, response_id, content, usage FROM e"""


def a10_compact_trace(spark, sf_dir):
    return R.compact_traces(_results(spark, sf_dir))


A10_SQL = """SELECT c_custkey AS instance_id, CASE WHEN c_custkey % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CAST(c_custkey % 70 AS DOUBLE) AS elapsed_seconds, c_mktsegment AS modality, 2 AS urls, 0 AS images,
  CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS flows, CASE c_custkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"chain":1}' ELSE '{"chain":1,"slice":1,"unknown":1}' END AS backends,
  CASE c_custkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"a":1}' ELSE '{"b":2,"unknown":1}' END AS flow_types, 'a' || (c_custkey % 5) || '.py|b.py' AS top_files FROM customer"""

# --- rounds of tool requests: each customer plans one ---


def _tool_rounds(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance_id"))
    tools = F.array(*[F.lit(t) for t in _TOOLS])
    source = F.concat(F.lit("u"), F.col("instance_id").cast("string"))
    planned = c.select("instance_id", F.get(tools, (F.col("instance_id") % 4).cast("int")).alias("tool"), source.alias("source"))
    outcomes = c.select("instance_id", F.explode(tools).alias("tool"), source.alias("source")).selectExpr("*", f"{_SUCCESS} AS success", "instance_id % 8 = 0 AS requires_browser", "CASE WHEN instance_id % 7 < 3 THEN 'api_or_docs' ELSE 'page' END AS doc_kind")
    return U.tool_rounds(planned, outcomes)


_TOOLS = ("playground_decoder", "web_snapshot_fetcher", "vlm_image_inspector", "browser_reproduction_reader")
_SUCCESS = "CASE tool WHEN 'browser_reproduction_reader' THEN instance_id % 5 > 1 ELSE instance_id % 3 <> 0 END"


def p34_followup_requests(spark, sf_dir):
    return _tool_rounds(spark, sf_dir)[0]


def p34_round_stops(spark, sf_dir):
    return _tool_rounds(spark, sf_dir)[1]


def _next_sql(i: int) -> str:
    rules = " UNION ".join(f"SELECT instance_id, '{tool}' AS tool FROM r{i} WHERE tool = '{ran}' AND {test}" for ran, test, tool, _, _ in U.RULES)
    before = " AND ".join(f"(instance_id, tool) NOT IN (SELECT instance_id, tool FROM r{k})" for k in range(1, i + 1))
    return f"""r{i + 1} AS (SELECT instance_id, tool, tool <> 'web_doc_reader' AND {_SUCCESS} AS success, tool <> 'web_doc_reader' AND instance_id % 8 = 0 AS requires_browser,
  CASE WHEN tool <> 'web_doc_reader' AND instance_id % 7 < 3 THEN 'api_or_docs' ELSE 'page' END AS doc_kind FROM ({rules}) WHERE {before})"""


ROUNDS_SQL = f"""r1 AS (SELECT instance_id, tool, {_SUCCESS} AS success, instance_id % 8 = 0 AS requires_browser, CASE WHEN instance_id % 7 < 3 THEN 'api_or_docs' ELSE 'page' END AS doc_kind FROM (
  SELECT c_custkey AS instance_id, [{', '.join(repr(t) for t in _TOOLS)}][c_custkey % 4 + 1] AS tool FROM customer)),
{_next_sql(1)}, {_next_sql(2)},
rr AS (SELECT instance_id, 1 AS round_id, tool, success FROM r1 UNION ALL SELECT instance_id, 2, tool, success FROM r2 UNION ALL SELECT instance_id, 3, tool, success FROM r3)"""
P34_SQL = f"WITH {ROUNDS_SQL} SELECT instance_id, round_id, tool, 'u' || instance_id AS source, success FROM rr"
P34_STOPS_SQL = f"""WITH {ROUNDS_SQL}, l AS (SELECT instance_id, max(round_id) AS rounds FROM rr GROUP BY 1),
a AS (SELECT instance_id, rounds, bool_or(success) AS ok FROM l JOIN rr USING (instance_id) WHERE round_id = rounds GROUP BY ALL)
SELECT instance_id, rounds, CASE WHEN rounds = 3 THEN 'max_tool_rounds_reached' WHEN ok THEN 'successful_observations_and_no_new_followups' ELSE 'no_successful_observations_and_no_fallback_available' END AS reason,
  CASE WHEN rounds = 3 THEN 0.6 WHEN ok THEN 0.7 ELSE 0.45 END AS confidence FROM a"""

QUERIES = {
    "p34_followup_requests": (p34_followup_requests, P34_SQL),
    "p34_round_stops": (p34_round_stops, P34_STOPS_SQL),
    "u12_validate_reviews": (u12_validate_reviews, U12_SQL),
    "u12_review_stops": (u12_review_stops, U12_STOPS_SQL),
    "a9_llm_events": (a9_llm_events, A9_SQL),
    "a10_compact_trace": (a10_compact_trace, A10_SQL),
}
