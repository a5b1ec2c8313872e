"""Policy, round, review and closure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure as K
from ..operators import code as C
from ..operators import policy as P
from ..operators import rounds as N
from .evidence_queries import _any, _case, _ends
from .views import ISSUES_SQL, issues, load, sql_list

#: Path shapes; a candidate of document n has shape n modulo their number.
SHAPES = (
    "src/core/parser.py", "lib/addons/p5.sound.js", "dist/app.bundle.js", "package-lock.json", "docs/guide/intro.md", "tests/test_core.py",
    "src/state/user/reducer.js", "client/components/Button.jsx", "src/utils/url.ts", "server/backend/ssh.c", "src/selectors/current-user.js",
    "types/index.d.ts", "src/layout/yoga.ts", "examples/demo/main.js", "src/app.spec.ts", "core/serializer.py", "mypy/binder.py", "src/vendor/x/a.js",
    "./src/main.c", "README",
)


def _candidates(spark, sf_dir):
    base = issues(spark, sf_dir)
    shape = F.get(F.array(*map(F.lit, SHAPES)), (F.col("instance_id") % len(SHAPES)).cast("int"))
    return base.select(
        (F.col("instance_id") % 97).alias("instance_id"),
        F.concat(F.regexp_replace(shape, "[^/]*$", ""), F.lit("k"), F.col("instance_id").cast("string"), F.lit("/"), F.regexp_extract(shape, "([^/]*)$", 1)).alias("path"),
        (F.length("issue_text") % 1_500).cast("double").alias("score"),
        "issue_text",
        F.col("instance_id").alias("doc_id"),
    )


CAND_SQL = f"""{ISSUES_SQL},
cand AS (SELECT instance_id % 97 AS instance_id, regexp_replace(s, '[^/]*$', '') || 'k' || CAST(instance_id AS VARCHAR) || '/' || regexp_extract(s, '([^/]*)$', 1) AS path,
  CAST(length(issue_text) % 1500 AS DOUBLE) AS score, issue_text, instance_id AS doc_id
  FROM (SELECT *, list_extract({sql_list(SHAPES)}, CAST(instance_id % {len(SHAPES)} AS INT) + 1) AS s FROM issues))"""
_in = lambda col, names: f"{col} IN ({', '.join(repr(n) for n in names)})"
_inside = lambda names: _any("low", [f"/{n}/" for n in names])
_ROLE_RULES = {
    "generated_or_lockfile": f"{_ends('low', P.LOCKFILES)} OR {_ends('fn', P.BUNDLE_ENDS)} OR {_inside(P.GENERATED)} OR {_in('fp', P.GENERATED)}",
    "addon_bundle": "starts_with(low, 'lib/addons/')",
    "declaration_or_schema": f"{_ends('fn', ('.d.ts', '.pyi'))} OR {_inside(('generated-sources', 'generated_sources'))}",
    "reproduction_or_example": f"{_inside((*P.EXAMPLES, 'manual-test-examples'))} OR {_in('fp', (*P.EXAMPLES, 'developer_docs'))}",
    "test_or_fixture": f"{_inside(P.TESTS)} OR contains(low, '__tests__') OR {_in('fp', P.TESTS)} OR starts_with(fn, 'test_') OR {_any('fn', ('.test.', '.spec.'))}",
} | {k: _any("low", v) for k, v in P.ROLE_WORDS.items()}
_NOUN = r"(?:test|tests|spec|fixture|fixtures|documentation|docs|example|demo|build|bundle|minified)"
_VERB = r"(?:fix|update|change|modify|add|remove|repair|correct|rewrite|document)"
_ALLOW = (
    f"(NOT {_any('it', P.NOT_SOURCE_DENIED)} AND (regexp_matches(it, '\\b{_VERB}\\b[\\w\\s,;:()/.\\-]{{0,48}}\\b{_NOUN}\\b')"
    f" OR regexp_matches(it, '\\b{_NOUN}\\b[\\w\\s,;:()/.\\-]{{0,32}}\\b(?:is|are|was|were)\\s+(?:wrong|incorrect|broken|outdated|missing)')"
    f" OR regexp_matches(it, '\\b(?:documentation|docs)\\s+(?:bug|issue|error|typo)\\b')))"
)
ROLES_SQL = f"""{CAND_SQL},
n AS (SELECT *, lower(regexp_replace(trim(replace(path, chr(92), '/')), '^[./]+', '')) AS low, lower(issue_text) AS it FROM cand),
nn AS (SELECT *, regexp_extract(low, '([^/]*)$', 1) AS fn, split_part(low, '/', 1) AS fp FROM n),
roles AS (SELECT instance_id, doc_id, path, score, it, {_case(_ROLE_RULES, 'implementation')} AS role, {_ALLOW} AS allowed, {_any('it', P.ADDON_WORDS)} AS addon,
  {_ends('lower(path)', P.SOURCE_ENDS)} AS src FROM nn)"""
_CONTEXT = f"role IN ({', '.join(repr(r) for r in P.CONTEXT_ROLES)})"
_FACTOR = f"""CASE WHEN NOT {_CONTEXT} THEN CASE WHEN src THEN 1.18 ELSE 1.0 END WHEN role = 'addon_bundle' THEN CASE WHEN addon THEN 0.85 ELSE 0.24 END
  WHEN allowed THEN 0.85 WHEN role = 'generated_or_lockfile' THEN 0.06 ELSE 0.18 END"""
_CAP = """CASE WHEN role = 'generated_or_lockfile' THEN 120.0 WHEN role = 'addon_bundle' AND NOT addon THEN 450.0
  WHEN role IN ('reproduction_or_example', 'test_or_fixture') AND NOT allowed THEN 900.0 ELSE 1e300 END"""


def p22_path_role(spark, sf_dir):
    return _candidates(spark, sf_dir).select("doc_id", "path", P.path_role(F.col("path")).alias("role"))


def p23_path_language(spark, sf_dir):
    return _candidates(spark, sf_dir).select("doc_id", C.language(F.col("path")).alias("language"))


_LANG = "CASE " + " ".join(f"WHEN e IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in C.LANGUAGES.items()) + " ELSE 'other' END"


def p26_allows_non_source(spark, sf_dir):
    return issues(spark, sf_dir).select("instance_id", P.allows_non_source(F.col("issue_text")).alias("allowed"))


def u7_source_first(spark, sf_dir):
    return P.source_first(_candidates(spark, sf_dir))


def _components(spark, sf_dir):
    """Line items as scored components of paths, suppliers as instances."""
    names = ["architecture_path_probe", *P.DIRECT, *P.SEMANTIC]
    li = load(spark, sf_dir, "lineitem")
    name = F.get(F.array(*map(F.lit, names)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(names)).cast("int"))
    return li.select(
        F.col("l_suppkey").alias("instance_id"),
        F.concat(F.lit("src/p"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py")).alias("path"),
        F.when(F.col("l_linenumber") <= 2, F.lit("architecture_path_probe")).otherwise(name).alias("component"),
        (F.col("l_quantity") / 2).alias("score"),
        F.col("l_linenumber").alias("round_no"),
    ).where("l_quantity > 40 OR l_linenumber <= 2")


_NAMES = ["architecture_path_probe", *P.DIRECT, *P.SEMANTIC]
COMP_SQL = f"""comp AS (SELECT l_suppkey AS instance_id, 'src/p' || CAST(l_partkey % 40 AS VARCHAR) || '.py' AS path,
  CASE WHEN l_linenumber <= 2 THEN 'architecture_path_probe' ELSE list_extract({sql_list(_NAMES)}, CAST((l_orderkey + l_linenumber) % {len(_NAMES)} AS INT) + 1) END AS component,
  l_quantity / 2 AS score, l_linenumber AS round_no FROM lineitem WHERE l_quantity > 40 OR l_linenumber <= 2),
wide AS (SELECT instance_id, path, {', '.join(f"sum(CASE WHEN component = '{n}' THEN score ELSE 0 END) AS {n}" for n in _NAMES)} FROM comp GROUP BY instance_id, path)"""


def u8_architecture_lane(spark, sf_dir):
    return P.architecture_lane(_components(spark, sf_dir))


_cnt = lambda names: " + ".join(f"CAST({n} > 0 AS INT)" for n in names)
U8_SQL = f"""WITH {COMP_SQL}, t AS (SELECT *, CASE WHEN {_cnt(P.DIRECT)} > 0 THEN 'directly_corroborated' WHEN {_cnt(P.SEMANTIC)} >= 2 THEN 'semantically_corroborated' ELSE 'uncorroborated' END AS tier FROM wide WHERE architecture_path_probe > 0),
c AS (SELECT *, CASE tier WHEN 'directly_corroborated' THEN 24.0 WHEN 'semantically_corroborated' THEN 12.0 ELSE 6.0 END AS cap FROM t)
SELECT instance_id, path, tier, round(least(architecture_path_probe, cap), 6) AS kept, round(architecture_path_probe - least(architecture_path_probe, cap), 6) AS removed FROM c"""


def a23_component_scores(spark, sf_dir):
    return P.component_table(_components(spark, sf_dir))


def u9_evidence_role_policy(spark, sf_dir):
    cand = _candidates(spark, sf_dir)
    backing = cand.where("doc_id % 3 = 0").select("instance_id", "path", F.lit("concern_score").alias("component"), F.lit(1.0).alias("score"))
    return P.evidence_roles(cand.select("instance_id", "path", "score"), cand.where("doc_id % 7 = 0").select("instance_id", "path"), backing)


U9_SQL = f"""WITH {ROLES_SQL}, wf AS (SELECT instance_id, bool_or({_any('lower(path)', P.WORKFLOW_WORDS)}) AS workflow FROM roles GROUP BY 1)
SELECT instance_id, path, round(least(score, CASE WHEN doc_id % 7 = 0 THEN least(score * 0.22, 450.0) WHEN {_CONTEXT} THEN score * 0.30
  WHEN workflow AND role = 'state_selector' AND doc_id % 3 <> 0 THEN score * 0.68 ELSE score END), 6) AS score FROM roles JOIN wf USING (instance_id)"""


def w18_memory_bonus(spark, sf_dir):
    cand = _candidates(spark, sf_dir)
    bonus = P.memory_bonus(F.col("doc_id") % 12, F.col("doc_id") % 4, F.col("doc_id") % 3, P.path_role(F.col("path")))
    return cand.select("doc_id", F.round(bonus, 6).alias("bonus"))


W18_SQL = f"""WITH {ROLES_SQL} SELECT doc_id, round(24.0 * pow(0.82, doc_id % 12) * pow(0.9, greatest(doc_id % 4 - 1, 0)) * pow(0.75, doc_id % 3) * CASE WHEN {_CONTEXT} THEN 0.35 ELSE 1.0 END, 6) AS bonus FROM roles"""


def _totals(spark, sf_dir):
    return _components(spark, sf_dir).groupBy("instance_id", "path").agg(F.round(F.sum("score"), 6).alias("score"))


def w19_rank_confidence(spark, sf_dir):
    totals = _totals(spark, sf_dir)
    reviewed, read = (totals.where(test).select("instance_id", "path") for test in ("path LIKE '%3.py' OR path LIKE '%8.py'", "path NOT LIKE '%1.py'"))
    return P.rank_confidence(totals, _components(spark, sf_dir), reviewed, read)


W19_SQL = f"""WITH {COMP_SQL}, t AS (SELECT instance_id, path, round(sum(score), 6) AS score FROM comp GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, 0) AS second FROM t WINDOW w AS (PARTITION BY instance_id ORDER BY score DESC, path)),
x AS (SELECT r.instance_id, r.path, score, second, score - second AS gap, CAST(symbol_score > 0 AS INT) + CAST(path_score > 0 OR domain_path_probe > 0 AS INT) + CAST(concern_score > 0 AS INT)
  + CAST(call_score > 0 AS INT) + CAST(flow_score > 0 AS INT) + 1 + CAST(rv AS INT) + CAST(rd AS INT) AS axes, symbol_score > 0 AS sym, rv, rd
  FROM (SELECT *, path LIKE '%3.py' OR path LIKE '%8.py' AS rv, path NOT LIKE '%1.py' AS rd FROM r) r JOIN wide USING (instance_id, path) WHERE rank = 1)
SELECT instance_id, path, round(gap, 3) AS gap, axes, round(least(0.98, 0.12 + least(0.28, greatest(gap, 0) / greatest(abs(score), abs(second), 1.0) * 0.70) + axes * 0.055 + 0.08 + CASE WHEN sym AND rd THEN 0.08 ELSE 0 END + CASE WHEN rv AND rd THEN 0.10 ELSE 0 END), 3) AS confidence FROM x"""


def _rounds(spark, sf_dir):
    comp = _components(spark, sf_dir)
    hits = comp.groupBy("instance_id", "round_no", F.regexp_replace("path", r"p\d*(\d)\.", "p$1.").alias("path")).agg(F.round(F.sum("score"), 6).alias("score"))
    return P.ranked_rounds(hits)


ROUNDS_SQL = rf"""{COMP_SQL}, hits AS (SELECT instance_id, round_no, regexp_replace(path, 'p\d*(\d)\.', 'p\1.') AS path, round(sum(score), 6) AS score FROM comp GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY instance_id, round_no ORDER BY score DESC, path) AS rank FROM hits)"""


def w20_round_progress(spark, sf_dir):
    return P.round_progress(_rounds(spark, sf_dir))


W20_SQL = rf"""WITH {ROUNDS_SQL}, tops AS (SELECT instance_id, round_no, list(path ORDER BY rank) AS top FROM ranked WHERE rank <= 5 GROUP BY ALL),
b AS (SELECT *, lag(top) OVER (PARTITION BY instance_id ORDER BY round_no) AS bef FROM tops),
c AS (SELECT *, len(list_filter(top, lambda p: list_contains(coalesce(bef, []), p))) AS both_n FROM b),
d AS (SELECT instance_id, round_no, len(top) - both_n AS new_top, bef IS NOT NULL AND top[1] = bef[1] AS stable_top1,
  both_n / greatest(len(top) + len(coalesce(bef, [])) - both_n, 1) AS ov FROM c),
e AS (SELECT *, stable_top1 AND ov >= 0.6 AND new_top = 0 AS plateau FROM d),
f AS (SELECT *, sum(CAST(NOT plateau AS INT)) OVER (PARTITION BY instance_id ORDER BY round_no) AS island FROM e)
SELECT instance_id, round_no, new_top, stable_top1, round(ov, 3) AS top5_overlap, plateau, sum(CAST(plateau AS INT)) OVER (PARTITION BY instance_id, island ORDER BY round_no) AS streak FROM f"""


def w21_best_round(spark, sf_dir):
    quality = _rounds(spark, sf_dir).where("rank = 1").select("instance_id", "round_no", F.round(F.col("score") / 100, 4).alias("score"))
    return P.best_round(quality)


W21_SQL = f"""WITH {ROUNDS_SQL}, q AS (SELECT instance_id, round_no, round(score / 100, 4) AS score FROM ranked WHERE rank = 1),
l AS (SELECT instance_id, list({{'round_no': round_no, 'score': score}} ORDER BY round_no) AS a FROM q GROUP BY instance_id),
f AS (SELECT instance_id, list_reduce(a, lambda b, x: CASE WHEN x.score > b.score + 0.15 THEN x ELSE b END) AS x FROM l)
SELECT instance_id, x.round_no AS round_no, x.score AS score FROM f"""


def a31_component_leaders(spark, sf_dir):
    return P.component_leaders(_components(spark, sf_dir))


A31_SQL = f"""WITH {COMP_SQL} SELECT instance_id, component, path, score, round_no FROM (SELECT *,
row_number() OVER (PARTITION BY instance_id, component ORDER BY score DESC, round_no, path DESC) AS n FROM comp) WHERE n = 1"""


def u2_novel_queries(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    upcoming = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("pos"), F.lower("o_orderpriority").alias("query"))
    active = orders.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("instance_id"), F.upper("o_orderpriority").alias("query"))
    return P.novel_queries(upcoming, active)


U2_SQL = """WITH a AS (SELECT DISTINCT o_custkey AS i, lower(o_orderpriority) AS k FROM orders WHERE o_orderkey % 2 = 1),
u AS (SELECT o_custkey AS i, lower(o_orderpriority) AS k, min(o_orderkey) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT i AS instance_id, row_number() OVER (PARTITION BY i ORDER BY p, k) - 1 AS pos, k AS query FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.i = u.i AND a.k = u.k)"""


def u3_new_flow_families(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    now = events.where("event_id % 3 = 0").select("user_id", "event_type")
    return now.subtract(events.where("event_id % 3 = 1 AND value > 20").select("user_id", "event_type"))


U3_SQL = "SELECT user_id, event_type FROM events WHERE event_id % 3 = 0 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 3 = 1 AND value > 20"


def a19_merge_flow_traces(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    flows = li.select(
        (F.col("l_suppkey") % 50).alias("instance_id"),
        F.col("l_returnflag").alias("flow_type"),
        (F.col("l_partkey") % 25).alias("term"),
        F.col("l_linestatus").alias("backend"),
        F.col("l_discount").alias("confidence"),
        F.col("l_linenumber").alias("group_no"),
        F.col("l_orderkey").alias("pos"),
        F.col("l_partkey").alias("ref"),
    )
    return P.merge_flows(flows.dropDuplicates(["instance_id", "flow_type", "term", "backend", "confidence", "group_no", "pos"]).drop("ref"))


A19_SQL = """SELECT instance_id, flow_type, term, backend, confidence, group_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, flow_type, term, backend ORDER BY confidence DESC, group_no, pos) AS n FROM (
  SELECT l_suppkey % 50 AS instance_id, l_returnflag AS flow_type, l_partkey % 25 AS term, l_linestatus AS backend, l_discount AS confidence, l_linenumber AS group_no, l_orderkey AS pos FROM lineitem)) WHERE n = 1"""

REQUIRED = (("A", "implementation"), ("A", "url_builder"), ("N", "test_or_fixture"), ("N", "serializer"), ("N", "type_binder"), ("R", "state_update"))


def a12_role_coverage(spark, sf_dir):
    cand = _candidates(spark, sf_dir)
    flow = F.get(F.array(*map(F.lit, "ANR")), (F.col("doc_id") % 3).cast("int"))
    places = cand.select((F.col("doc_id") % 60).alias("instance_id"), flow.alias("flow_type"), P.path_role(F.col("path")).alias("role"))
    return P.role_coverage(places, spark.createDataFrame(REQUIRED, "flow_type string, role string"))


A12_SQL = f"""WITH {ROLES_SQL}, loc AS (SELECT DISTINCT doc_id % 60 AS instance_id, list_extract(['A', 'N', 'R'], CAST(doc_id % 3 AS INT) + 1) AS flow_type, role FROM roles),
req AS (SELECT * FROM (VALUES {', '.join(map(str, REQUIRED))}) AS t(flow_type, role)),
j AS (SELECT f.instance_id, f.flow_type, q.role, l.role IS NOT NULL AS hit FROM (SELECT DISTINCT instance_id, flow_type FROM loc) f JOIN req q USING (flow_type) LEFT JOIN loc l ON l.instance_id = f.instance_id AND l.flow_type = f.flow_type AND l.role = q.role)
SELECT instance_id, flow_type, coalesce(string_agg(role, ',' ORDER BY role) FILTER (WHERE hit), '') AS covered, coalesce(string_agg(role, ',' ORDER BY role) FILTER (WHERE NOT hit), '') AS missing,
  round(avg(CAST(hit AS INT)), 3) AS coverage FROM j GROUP BY ALL"""


def _reviews(spark, sf_dir):
    cand = _candidates(spark, sf_dir)
    role = F.get(F.array(*map(F.lit, (*P.REVIEW_PRIORS, "other"))), (F.col("doc_id") % 7).cast("int"))
    return cand.select(
        "instance_id", "path", (F.floor(F.col("doc_id") / 97) % 4).alias("position"), role.alias("role"), ((F.col("doc_id") % 13) / 10).alias("confidence"),
        (F.col("doc_id") % 2 == 0).alias("grounded"), (F.col("doc_id") % 3 == 0).alias("mechanism_verified"), (F.col("doc_id") % 6).alias("n_counter"),
    )


def u11_apply_review(spark, sf_dir):
    return P.apply_reviews(_candidates(spark, sf_dir).select("instance_id", "path", "score"), _reviews(spark, sf_dir))


_PRIOR = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.REVIEW_PRIORS.items()) + " ELSE -0.48 END"
U11_SQL = f"""WITH {CAND_SQL}, rv AS (SELECT instance_id, path, floor(doc_id / 97) % 4 AS position, list_extract({sql_list((*P.REVIEW_PRIORS, 'other'))}, CAST(doc_id % 7 AS INT) + 1) AS role, (doc_id % 13) / 10 AS confidence,
  doc_id % 2 = 0 AS grounded, doc_id % 3 = 0 AS mv, doc_id % 6 AS nc FROM cand),
s AS (SELECT instance_id, count(*) AS n FROM rv GROUP BY 1),
f AS (SELECT rv.*, grounded AND mv AS sure, CASE WHEN grounded AND mv THEN 180.0 WHEN grounded THEN 12.0 ELSE 4.0 END AS cap,
  {_PRIOR} * least(greatest(confidence, 0.0), 1.0) + CASE WHEN role IN ('patch_target', 'supporting_target') THEN 0.18 * (n - position) / n ELSE 0 END AS factor FROM rv JOIN s USING (instance_id)),
a AS (SELECT instance_id, path, CASE WHEN factor > 0 THEN least(cap, cap * factor) ELSE greatest(-60.0, 60.0 * factor) END - CASE WHEN nc > 0 AND NOT sure THEN least(21.0, 6.0 * nc) ELSE 0 END AS ch FROM f)
SELECT c.instance_id, c.path, round(score + coalesce(ch, 0), 6) AS score FROM cand c LEFT JOIN a ON a.instance_id = c.instance_id AND a.path = c.path"""


def g25_lightweight_localize(spark, sf_dir):
    cand = _candidates(spark, sf_dir)
    texts = cand.groupBy("instance_id").agg(F.min_by("issue_text", "doc_id").alias("issue_text"))
    return P.lightweight_rank(cand, cand.where("doc_id % 4 = 1"), cand.where("doc_id % 7 = 0"), texts)


G25_SQL = f"""WITH {CAND_SQL}, texts AS (SELECT instance_id, arg_min(issue_text, doc_id) AS t FROM cand GROUP BY 1),
m AS (SELECT c.instance_id, c.doc_id, c.path, (score + CASE WHEN doc_id % 4 = 1 THEN 1.25 * score ELSE 0 END) * CASE WHEN doc_id % 7 = 0 THEN 0.7 ELSE 1.0 END AS score, t AS issue_text FROM cand c JOIN texts USING (instance_id)),
n AS (SELECT *, lower(regexp_replace(trim(replace(path, chr(92), '/')), '^[./]+', '')) AS low, lower(issue_text) AS it FROM m),
nn AS (SELECT *, regexp_extract(low, '([^/]*)$', 1) AS fn, split_part(low, '/', 1) AS fp FROM n),
r AS (SELECT instance_id, path, score, {_case(_ROLE_RULES, 'implementation')} AS role, {_ALLOW} AS allowed, {_any('it', P.ADDON_WORDS)} AS addon, {_ends('lower(path)', P.SOURCE_ENDS)} AS src FROM nn),
s AS (SELECT instance_id, path, round(least(score * {_FACTOR}, {_CAP}), 6) AS score FROM r)
SELECT * FROM (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, path) AS rank, path, score FROM s) WHERE rank <= 15"""


def u15_closure_rerank(spark, sf_dir):
    ranked = P.ranked_rounds(_totals(spark, sf_dir).withColumn("round_no", F.lit(1))).drop("round_no").where("rank <= 20")
    verified = ranked.where("rank IN (3, 7)").select("instance_id", "path", (F.col("rank") / 10).alias("confidence"))
    return P.closure_rerank(ranked, verified)


U15_SQL = f"""WITH {COMP_SQL}, t AS (SELECT instance_id, path, round(sum(score), 6) AS score FROM comp GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, path) AS rank, max(score) OVER (PARTITION BY instance_id) AS top FROM t) WHERE rank <= 20)
SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY CASE WHEN rank IN (3, 7) THEN 0 ELSE 1 END, rank) AS rank, path,
  round(CASE WHEN rank IN (3, 7) THEN greatest(score, top + greatest(1.0, top * 0.02 * rank / 10)) ELSE score END, 6) AS score FROM r"""


def _obliged(spark, sf_dir):
    """(covers, candidates, obligations): components as obligations, those of rounds
    that 3 divides not required."""
    comp = _components(spark, sf_dir)
    covers = comp.select("instance_id", "path", F.concat_ws(":", "component", (F.col("round_no") % 3).cast("string")).alias("obligation")).distinct()
    obligations = covers.select("instance_id", "obligation", (~F.col("obligation").endswith(":0")).alias("required")).distinct()
    ranked = P.ranked_rounds(_totals(spark, sf_dir).withColumn("round_no", F.lit(1))).drop("round_no")
    shown = ranked.select("instance_id", "rank", "path", (F.col("score") % 1).alias("extra"), (F.col("rank") % 3 == 1).alias("target"), (F.col("rank") * 37 % 11 / 10).alias("confidence"))
    return covers, shown, obligations


def g20_obligation_coverage(spark, sf_dir):
    covers, ranked, obligations = _obliged(spark, sf_dir)
    out = K.obligation_coverage(ranked.where("rank <= 3"), obligations, covers)
    return out.withColumn("missing_required", F.array_join("missing_required", ",")).withColumn("missing_advisory", F.array_join("missing_advisory", ","))


def g22_minimal_edit_set(spark, sf_dir):
    out = K.modification_closure(*_obliged(spark, sf_dir))
    return out.withColumn("files", F.array_join("files", ",")).withColumn("missing", F.array_join("missing", ","))


OBLIGED_SQL = f"""{COMP_SQL},
cv AS (SELECT DISTINCT instance_id, path, component || ':' || round_no % 3 AS obligation FROM comp),
ob AS (SELECT DISTINCT instance_id, obligation, NOT ends_with(obligation, ':0') AS required FROM cv),
rk AS (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, path) AS rank, path, score % 1 AS extra FROM (SELECT instance_id, path, round(sum(score), 6) AS score FROM comp GROUP BY ALL))"""
G20_SQL = f"""WITH {OBLIGED_SQL},
c AS (SELECT o.instance_id, o.obligation, required, count(s.path) AS files FROM ob o LEFT JOIN (SELECT cv.* FROM cv JOIN rk USING (instance_id, path) WHERE rank <= 3) s USING (instance_id, obligation) GROUP BY ALL)
SELECT instance_id, count(*) FILTER (WHERE required) AS required, count(*) FILTER (WHERE required AND files > 0) AS covered, round(count(*) FILTER (WHERE required AND files > 0) / greatest(1, count(*) FILTER (WHERE required)), 3) AS coverage,
  count(*) FILTER (WHERE required AND files = 0) = 0 AS complete, coalesce(string_agg(obligation, ',' ORDER BY obligation) FILTER (WHERE required AND files = 0), '') AS missing_required,
  coalesce(string_agg(obligation, ',' ORDER BY obligation) FILTER (WHERE NOT required AND files = 0), '') AS missing_advisory, count(*) FILTER (WHERE files = 1) AS alone FROM c GROUP BY instance_id"""
_HELD = lambda files: f"list_filter(need, lambda n: NOT list_contains(flatten(list_transform(list_filter(pool, lambda c: list_contains({files}, c.path)), lambda c: c.own)), n))"


def _round_sql(i: int) -> str:
    """One round over the rows of the round before: gap, additions, ablation."""
    return f"""g{i} AS (SELECT *, {_HELD('files')} AS gap FROM s{i - 1}),
a{i} AS (SELECT *, CASE WHEN done OR len(files) >= 6 THEN [] ELSE list_transform(list_sort(list_transform(list_filter(pool, lambda c: list_has_any(c.own, gap) AND NOT list_contains(files, c.path)),
  lambda c: struct_pack(s := -(5.0 * len(list_intersect(c.own, gap)) + c.extra), rank := c.rank, path := c.path)))[1:least(2, 6 - len(files))], lambda x: x.path) END AS added FROM g{i}),
o{i} AS (SELECT *, list_concat(files, added) AS whole FROM a{i}),
t{i} AS (SELECT *, list_reduce(list_prepend(whole, list_transform(list_sort(list_transform(list_filter(pool, lambda c: list_contains(whole, c.path)), lambda c: struct_pack(t := c.target, c := c.confidence, r := -c.rank, p := c.path))), lambda x: [x.p])),
  lambda l, x: CASE WHEN len(l) > 1 AND len({_HELD('list_filter(l, lambda y: y <> x[1])')}) = len({_HELD('l')}) THEN list_filter(l, lambda y: y <> x[1]) ELSE l END) AS thin FROM o{i}),
s{i} AS (SELECT instance_id, pool, need, CASE WHEN done THEN files ELSE thin END AS files, done OR len(added) = 0 OR len({_HELD('thin')}) = 0 AS done, rounds + CASE WHEN done THEN 0 ELSE 1 END AS rounds, len(added) AS n_added FROM t{i})"""


G22_SQL = f"""WITH {OBLIGED_SQL},
ow AS (SELECT instance_id, path, list(obligation ORDER BY obligation) AS own FROM cv JOIN ob USING (instance_id, obligation) WHERE required GROUP BY ALL),
pl AS (SELECT instance_id, list(struct_pack(rank := rank, path := path, extra := CAST(extra AS DOUBLE), target := rank % 3 = 1, confidence := rank * 37 % 11 / 10, own := coalesce(own, [])) ORDER BY rank) AS pool FROM rk LEFT JOIN ow USING (instance_id, path) WHERE rank <= 24 GROUP BY instance_id),
s0 AS (SELECT instance_id, pool, coalesce(need, []) AS need, [pool[1].path] AS files, false AS done, 0 AS rounds FROM pl LEFT JOIN (SELECT instance_id, list(obligation ORDER BY obligation) AS need FROM ob WHERE required GROUP BY 1) USING (instance_id)),
{_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)}
SELECT instance_id, array_to_string(list_sort(files), ',') AS files, rounds, array_to_string({_HELD('files')}, ',') AS missing,
  CASE WHEN len({_HELD('files')}) = 0 THEN 'complete' WHEN rounds >= 3 AND n_added > 0 THEN 'budget_exhausted' ELSE 'incomplete' END AS status FROM s3"""

def u13_cross_round_frontier(spark, sf_dir):
    """The second round of each supplier is selected; evidence is told by the path."""
    comp = _components(spark, sf_dir)
    ranked = P.ranked_rounds(comp.groupBy("instance_id", "round_no", "path").agg(F.round(F.sum("score"), 6).alias("score")))
    direct = comp.groupBy("instance_id", "round_no", "path").agg(F.max(F.col("component").isin(*P.DIRECT)).alias("direct"))
    rounds = ranked.join(direct, ["instance_id", "round_no", "path"])
    ends = lambda *tails: F.col("path").rlike(f"({'|'.join(tails)})\\.py$")
    flags = comp.select("instance_id", "path").distinct().select(
        "instance_id", "path", (~ends("1")).alias("read"), ends("3", "8").alias("grounded"), ends("13").alias("mechanism"),
        F.when(ends("8"), "patch_target").otherwise("unlikely").alias("role"), F.lit(0.7).alias("confidence"),
    )
    texts = issues(spark, sf_dir).select("instance_id", F.concat("issue_text", F.lit(" in src/p7.py")).alias("issue_text"))
    selected = ranked.where("round_no = 2").select("instance_id", "rank", "path")
    return N.cross_round_frontier(N.frontier_quality(rounds, selected, flags, texts))


_LONG = lambda x: f"list_distinct(list_filter(flatten(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_.$-]*'), lambda m: [regexp_replace(lower(m), '^[._$-]+|[._$-]+$', '', 'g')] || string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' '))), lambda t: length(t) >= 4))"
U13_SQL = f"""WITH {COMP_SQL}, {ISSUES_SQL},
ag AS (SELECT instance_id, round_no, path, round(sum(score), 6) AS score, bool_or(component IN ({', '.join(repr(x) for x in P.DIRECT)})) AS direct FROM comp GROUP BY ALL),
rd AS (SELECT *, row_number() OVER (PARTITION BY instance_id, round_no ORDER BY score DESC, path) AS rank FROM ag),
pl AS (SELECT instance_id, path, sum(12.0 / (8.0 + rank)) AS places, count(*) AS times, min(rank) AS best, bool_or(direct) AS direct FROM rd WHERE rank <= 15 GROUP BY ALL),
sl AS (SELECT instance_id, path, rank AS selected_rank FROM rd WHERE round_no = 2 AND rank <= 15),
al AS (SELECT *, lower(issue_text || ' in src/p7.py') AS low, regexp_matches(path, '8\\.py$') AS eight, regexp_matches(path, '(3|8)\\.py$') AND NOT regexp_matches(path, '1\\.py$') AS grounded,
  NOT regexp_matches(path, '1\\.py$') AS read FROM pl FULL JOIN sl USING (instance_id, path) LEFT JOIN issues USING (instance_id)),
ov AS (SELECT *, len(list_intersect({_LONG('lower(path)')}, {_LONG("coalesce(low, '')")})) AS shared, contains(coalesce(low, ''), path) AS exact, grounded AND regexp_matches(path, '13\\.py$') AS mechanism FROM al),
ql AS (SELECT instance_id, path, best, selected_rank, round(coalesce(places, 0) + least(4.0, coalesce(times, 0) * 0.7) + 8.0 / greatest(1, coalesce(best, 16)) + coalesce(10.0 / selected_rank, 0) + CASE WHEN read THEN 2 ELSE 0 END
  + CASE WHEN direct THEN 1.5 ELSE 0 END + CASE WHEN grounded THEN 3 ELSE 0 END + CASE WHEN mechanism THEN 8 ELSE 0 END + CASE WHEN exact THEN 8.0 ELSE least(3.0, shared * 1.2) END, 6) AS quality,
  mechanism OR (grounded AND eight) OR (read AND coalesce(direct, false) AND (exact OR shared > 0 OR times >= 2)) AS strong FROM ov),
nw AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY quality DESC, best, path) AS k FROM ql WHERE selected_rank IS NULL AND strong),
tl AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY quality, selected_rank DESC) AS k FROM ql WHERE selected_rank > 5),
wn AS (SELECT t.instance_id, t.selected_rank, n.path AS added FROM tl t JOIN nw n USING (instance_id, k) WHERE k <= 2 AND n.quality >= t.quality + 0.75)
SELECT instance_id, selected_rank AS rank, coalesce(added, path) AS path, CASE WHEN added IS NOT NULL THEN path END AS replaced FROM ql LEFT JOIN wn USING (instance_id, selected_rank) WHERE selected_rank IS NOT NULL"""

QUERIES = {
    "u13_cross_round_frontier": (u13_cross_round_frontier, U13_SQL),
    "p22_path_role": (p22_path_role, f"WITH {ROLES_SQL} SELECT doc_id, path, role FROM roles"),
    "p23_path_language": (p23_path_language, rf"WITH {CAND_SQL}, x AS (SELECT doc_id, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS e FROM cand) SELECT doc_id, {_LANG} AS language FROM x"),
    "p26_allows_non_source": (
        p26_allows_non_source,
        f"WITH {ISSUES_SQL}, x AS (SELECT instance_id, lower(issue_text) AS it FROM issues) SELECT instance_id, {_ALLOW} AS allowed FROM x",
    ),
    "u2_novel_queries": (u2_novel_queries, U2_SQL),
    "u3_new_flow_families": (u3_new_flow_families, U3_SQL),
    "u7_source_first": (
        u7_source_first,
        f"""WITH {ROLES_SQL}, f AS (SELECT *, {_FACTOR} AS k, {_CAP} AS cap FROM roles)
SELECT instance_id, path, role, round(least(CASE WHEN k > 1 THEN score + least(18.0, score * (k - 1)) ELSE score * k END, cap), 6) AS score FROM f""",
    ),
    "u8_architecture_lane": (u8_architecture_lane, U8_SQL),
    "u9_evidence_role_policy": (u9_evidence_role_policy, U9_SQL),
    "u11_apply_review": (u11_apply_review, U11_SQL),
    "u15_closure_rerank": (u15_closure_rerank, U15_SQL),
    "w18_memory_bonus": (w18_memory_bonus, W18_SQL),
    "w19_rank_confidence": (w19_rank_confidence, W19_SQL),
    "w20_round_progress": (w20_round_progress, W20_SQL),
    "w21_best_round": (w21_best_round, W21_SQL),
    "a12_role_coverage": (a12_role_coverage, A12_SQL),
    "a19_merge_flow_traces": (a19_merge_flow_traces, A19_SQL),
    "a23_component_scores": (a23_component_scores, f"WITH {COMP_SQL} SELECT * FROM wide"),
    "a31_component_leaders": (a31_component_leaders, A31_SQL),
    "g20_obligation_coverage": (g20_obligation_coverage, G20_SQL),
    "g22_minimal_edit_set": (g22_minimal_edit_set, G22_SQL),
    "g25_lightweight_localize": (g25_lightweight_localize, G25_SQL),
}
