"""Flow queries: terms are the names of parts and customers whose number is
divisible by 50, code is the generated source of the code queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import kept
from ..operators import backends as B
from ..operators import code as C
from ..operators import flows as L
from ..operators import metrics as M
from .code_queries import ENTITIES_SQL, code_files
from .evidence_queries import _any
from .views import load


def flow_terms(spark, sf_dir):
    named = lambda table, key, letter: load(spark, sf_dir, table).where(F.col(key) % 50 == 0).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("term"))
    return named("part", "p_partkey", "p").unionByName(named("customer", "c_custkey", "q"))


def _corpus(spark, sf_dir):
    """(terms, files)."""
    return flow_terms(spark, sf_dir), kept(code_files(spark, sf_dir), "code")


def _starts(files):
    """Declarations of all files, found as they are read; where they end is not asked."""
    return C.declarations(C.masked_lines(files))


def _owners(files, wanted):
    """The innermost entities of the wanted lines (path, line_no) of files."""
    entities = C.braced_entities(files)
    held = M.innermost_entity(wanted.select("path", F.col("line_no").alias("line")), entities)
    return held.select("path", F.col("line").alias("line_no"), F.col("name").alias("entity"), F.col("kind").alias("entity_kind"))


def _statements(spark, sf_dir):
    """(statements, files)."""
    terms, files = _corpus(spark, sf_dir)
    return kept(L.term_statements(terms, files), "statements"), files


def _steps(spark, sf_dir, **options):
    """(steps, files)."""
    terms, files = _corpus(spark, sf_dir)
    return L.written_steps(terms, files, _owners, **options), files


# --- SQL of the same -----------------------------------------------------------------------

_q = lambda pattern: pattern.replace("'", "''")
_SYMBOL = lambda x: f"lower(regexp_replace(split_part(trim({x}), '.', -1), '^[_$]+|[_$]+$', '', 'g'))"
_CONTROL = "('if', 'for', 'while', 'switch', 'catch', 'function')"
TERMS_SQL = f"""{ENTITIES_SQL}, terms AS (SELECT 'p' || p_partkey AS term FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'q' || c_custkey FROM customer WHERE c_custkey % 50 = 0),
hits AS (SELECT term, path, CAST(contains(lower(path), term) AS INT) AS p,
  (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) + (length(path) - length(replace(lower(path), term, ''))) // length(term) AS n
  FROM terms, code WHERE contains(lower(text), term) OR contains(lower(path), term))"""
STATEMENTS_SQL = rf"""{TERMS_SQL},
tf AS (SELECT * FROM (SELECT term, path, row_number() OVER (PARTITION BY term ORDER BY path) AS fr FROM hits) WHERE fr <= 20),
tl AS (SELECT *, row_number() OVER (PARTITION BY term, path ORDER BY line_no) AS k FROM tf JOIN lines USING (path) WHERE contains(lower(line), term)),
tk AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY fr, line_no) AS j FROM tl WHERE k <= 30),
stmts AS (SELECT term, path, line_no, list_filter(regexp_extract_all(line, '{_q(L.CALL)}', 1), lambda c: c NOT IN {_CONTROL}) AS calls,
  CASE WHEN contains(lower(regexp_extract(line, '{_q(L.HEADER)}', 1)), term) THEN 'parameter_definition' WHEN contains(lower(regexp_extract(line, '{_q(L.ASSIGN)}', 1)), term) THEN 'define_or_assign'
  WHEN regexp_matches(lower(line), '\breturn\b') THEN 'return_value' WHEN regexp_matches(lower(line), '\b(?:if|elif|while|switch|case)\b') THEN 'condition'
  WHEN len(list_filter(regexp_extract_all(line, '{_q(L.CALL)}', 1), lambda c: c NOT IN {_CONTROL})) > 0 THEN 'call_or_argument' ELSE 'reference' END AS kind FROM tk WHERE j <= 80),
ldu AS (SELECT term, path AS source, path AS target, 'local_def_use' AS relation, f AS source_line, line_no AS target_line FROM (SELECT *,
  last_value(CASE WHEN kind IN ('define_or_assign', 'parameter_definition') THEN line_no END IGNORE NULLS) OVER (PARTITION BY term, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
  FROM stmts) WHERE f IS NOT NULL AND kind NOT IN ('define_or_assign', 'parameter_definition')),
declared AS (SELECT DISTINCT name AS callee, path AS target FROM entities),
cl AS (SELECT DISTINCT term, path, line_no, unnest(calls) AS callee FROM stmts WHERE kind = 'call_or_argument'),
one AS (SELECT term, path, line_no, callee, min(target) AS target FROM cl JOIN declared USING (callee) WHERE target <> path GROUP BY ALL HAVING count(*) = 1),
formal AS (SELECT term, path AS target, min(line_no) AS target_line FROM stmts WHERE kind = 'parameter_definition' GROUP BY ALL),
atf AS (SELECT term, path AS source, target, 'argument_to_formal_parameter' AS relation, line_no AS source_line, target_line FROM one JOIN formal USING (term, target)),
sedges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY relation DESC, source, target) AS n FROM (
  SELECT term, source, target, relation, min(source_line) AS source_line FROM (SELECT * FROM ldu UNION ALL SELECT * FROM atf) GROUP BY ALL)) WHERE n <= 80),
sflows AS (SELECT s.term, files, statements, coalesce(edges, 0) AS edges, round(least(0.98, 0.34 + 0.04 * files + 0.05 * coalesce(edges, 0) + 0.04 * actions), 3) AS confidence FROM (
  SELECT term, count(DISTINCT path) AS files, count(*) AS statements, count(*) FILTER (WHERE kind IN ('define_or_assign', 'parameter_definition', 'call_or_argument', 'return_value')) AS actions,
  bool_or(kind <> 'reference' OR len(calls) > 0) AS does FROM stmts GROUP BY term) s LEFT JOIN (SELECT term, count(*) AS edges FROM sedges GROUP BY term) USING (term) WHERE statements >= 2 OR does)"""

_LOW = "low"
_ROLE = "CASE " + " ".join(f"WHEN {_any(_LOW, words)} THEN '{role}'" for role, words in L.CHAIN_ROLES.items()) + f" WHEN ek = 'class' OR {_any(_LOW, ('/api/', '/public/', '__init__.py', '.pyi'))} THEN 'public_api' ELSE 'implementation' END"
_NAMES = lambda text: f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, '{_q(L.IDENTIFIER)}'), lambda t: {_SYMBOL('t')}), lambda t: t <> ''))"


def _steps_sql(order: str, most_files: int) -> str:
    return rf"""{TERMS_SQL},
tf AS (SELECT * FROM (SELECT term, path, p, row_number() OVER (PARTITION BY term ORDER BY {order}) AS fr FROM hits) WHERE fr <= {most_files}),
tl AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY fr, line_no) AS step FROM tf JOIN lines USING (path) WHERE contains(lower(line), term) OR p = 1),
ow AS (SELECT path, line_no, min(struct_pack(span := end_line - start_line, s := start_line, k := kind, n := name)) AS x FROM tl JOIN entities USING (path) WHERE line_no BETWEEN start_line AND end_line GROUP BY ALL),
t0 AS (SELECT term, step, path, line_no, line, coalesce(x.n, '') AS en, coalesce(x.k, '') AS ek, regexp_extract(line, '{_q(L.ASSIGN)}', 1) AS lft, regexp_extract(line, '{_q(L.ASSIGN)}', 2) AS rgt
  FROM tl LEFT JOIN ow USING (path, line_no) WHERE step <= 160),
t1 AS (SELECT *, lower(path || ' ' || line || ' ' || en || ' ' || ek) AS low, {_SYMBOL('lft')} AS def, {_SYMBOL('en')} AS entity,
  list_filter({_NAMES("CASE WHEN lft <> '' THEN rgt ELSE line END")}, lambda u: u <> {_SYMBOL('lft')}) AS uses, regexp_matches(line, '\breturn\b') AS returns FROM t0),
st AS (SELECT *, {_ROLE} AS role FROM t1),
ca AS (SELECT term, step, path, line_no, {_SYMBOL('c')} AS symbol, lower(a) AS args FROM (SELECT *, unnest(regexp_extract_all(line, '{_q(L.CALL)}', 1)) AS c, unnest(regexp_extract_all(line, '{_q(L.CALL)}', 2)) AS a FROM st)),
us AS (SELECT term, step AS to_step, path AS to_path, line_no AS target_line, unnest(uses) AS symbol FROM st)"""


CHAIN_SQL = rf"""{_steps_sql("8 * p + 2 * least(n, 8) DESC, path", 34)},
en8 AS (SELECT * FROM (SELECT symbol, path AS epath, start_line, row_number() OVER (PARTITION BY symbol ORDER BY path, start_line) AS k FROM (SELECT {_SYMBOL('name')} AS symbol, path, start_line FROM entities) WHERE symbol <> '') WHERE k <= 8),
ins AS (SELECT * FROM (SELECT term, path AS epath, entity AS symbol, step AS to_step, line_no AS target_line, row_number() OVER (PARTITION BY term, path, entity ORDER BY step) AS k FROM st WHERE entity <> '') WHERE k <= 2),
cb AS (SELECT c.term, c.path AS source, e.epath AS target, CASE WHEN contains(args, c.term) THEN 'call_argument_to_formal' ELSE 'call_boundary' END AS relation, c.symbol, c.step, coalesce(i.to_step, 0) AS to_step, coalesce(i.target_line, e.start_line) AS target_line
  FROM ca c JOIN en8 e USING (symbol) LEFT JOIN ins i ON i.term = c.term AND i.epath = e.epath AND i.symbol = c.symbol
  WHERE (e.epath <> c.path OR contains(args, c.term)) AND c.step <> coalesce(i.to_step, 0)),
u12 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term, symbol ORDER BY to_step) AS k FROM us) WHERE k <= 12),
du AS (SELECT term, path AS source, to_path AS target, CASE WHEN path = to_path THEN 'same_symbol_def_use' ELSE 'cross_file_same_symbol_flow' END AS relation, symbol, step, to_step, u.target_line FROM st JOIN u12 u USING (term) WHERE def = symbol AND def <> '' AND step <> to_step),
rt AS (SELECT term, path AS source, to_path AS target, 'return_value_to_call_site' AS relation, symbol, step, to_step, u.target_line FROM st JOIN u12 u USING (term) WHERE returns AND entity = symbol AND entity <> '' AND step <> to_step),
att AS (SELECT DISTINCT term, step AS to_step, path AS to_path, line_no AS target_line, {_SYMBOL('a')} AS symbol FROM (SELECT *, unnest(regexp_extract_all(line, '{_q(L.ATTRIBUTE)}', 1)) AS a FROM st)),
a10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term, symbol ORDER BY to_step) AS k FROM att WHERE symbol <> '') WHERE k <= 10),
sa AS (SELECT term, path AS source, to_path AS target, 'field_write_to_read_or_shared_attribute' AS relation, symbol, step, to_step, a.target_line FROM st JOIN a10 a USING (term) WHERE contains(lower(line), symbol) AND step <> to_step),
rk AS (SELECT *, coalesce(list_position([{', '.join(repr(r) for r in L.ROLE_ORDER)}], role) - 1, 99) AS rank FROM st),
hd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rank, path, line_no) AS k FROM rk) WHERE k <= 10),
tt AS (SELECT * FROM (SELECT term, step AS to_step, path AS to_path, line_no AS target_line, row_number() OVER (PARTITION BY term ORDER BY rank DESC, path DESC, line_no DESC) AS k FROM rk) WHERE k <= 12),
sm AS (SELECT term, path AS source, to_path AS target, 'same_issue_term_cross_file' AS relation, term AS symbol, step, to_step, tt.target_line FROM hd JOIN tt USING (term) WHERE path <> to_path),
every AS (SELECT * FROM cb UNION SELECT * FROM du UNION SELECT * FROM rt UNION SELECT * FROM sa UNION SELECT * FROM sm),
ww AS (SELECT *, CASE relation {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.CHAIN_WEIGHTS.items())} END AS weight FROM every),
ce AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, relation, source, target, step, to_step, symbol, target_line) AS n FROM ww) WHERE n <= 90),
rc AS (SELECT term, path, role, count(*) AS k, min(rank) AS rank FROM rk GROUP BY ALL),
lo AS (SELECT term, path, arg_min(role, struct_pack(a := -k, b := rank, c := role)) AS role, CAST(sum(k) AS BIGINT) AS statements FROM rc GROUP BY ALL),
es AS (SELECT term, path, round(sum(weight), 3) AS edge_score FROM (SELECT term, unnest([source, target]) AS path, weight FROM ce) GROUP BY ALL),
cf AS (SELECT term, steps, coalesce(edges, 0) AS edges, coverage, round(least(0.99, 0.24 + 0.025 * least(steps, 18) + 0.035 * least(coalesce(edges, 0), 18) + 0.18 * coverage + 0.015 * least(coalesce(strength, 0), 12.0)), 3) AS confidence
  FROM (SELECT term, count(DISTINCT path) AS files, count(*) AS steps, round((max(CAST(role = 'public_api' AS INT)) + max(CAST(role = 'implementation' AS INT))) / 2, 3) AS coverage FROM st GROUP BY term)
  LEFT JOIN (SELECT term, count(*) AS edges, sum(CASE WHEN n <= 30 THEN weight ELSE 0 END) AS strength FROM ce GROUP BY term) USING (term) WHERE files >= 2 OR steps >= 3)"""
SLICE_SQL = rf"""{_steps_sql("path", 32)},
sdu AS (SELECT DISTINCT s.term, s.path AS source, u.path AS target, CASE WHEN s.path = u.path AND s.entity = u.entity THEN 'same_function_def_use' ELSE 'cross_statement_def_use' END AS relation, s.def AS symbol
  FROM st s JOIN st u ON u.term = s.term AND list_contains(u.uses, s.def) WHERE s.def <> '' AND s.step <> u.step AND NOT (s.path = u.path AND s.line_no > u.line_no)),
nm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY target) AS k FROM (SELECT DISTINCT {_SYMBOL('name')} AS symbol, path AS target FROM entities)) WHERE k <= 81 AND symbol <> ''),
sca AS (SELECT DISTINCT term, path AS source, target, 'call_boundary_argument_flow' AS relation, symbol FROM ca JOIN nm USING (symbol) WHERE path <> target),
se AS (SELECT term, source, target, relation, symbol FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY source, target, relation, symbol) AS n FROM sdu) WHERE n <= 120
  UNION ALL SELECT term, source, target, relation, symbol FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY source, target, relation, symbol) AS n FROM sca) WHERE n <= 80),
sf AS (SELECT term, files, statements, coalesce(d, 0) AS def_use_edges, coalesce(c, 0) AS call_edges,
  round(least(0.99, 0.30 + least(0.24, 0.03 * files) + least(0.25, 0.02 * coalesce(d, 0)) + least(0.16, 0.04 * coalesce(c, 0)) + CASE WHEN does THEN 0.08 ELSE 0 END), 3) AS confidence
  FROM (SELECT term, count(DISTINCT path) AS files, count(*) AS statements, bool_or(def <> '' OR returns OR regexp_matches(line, '{_q(L.CALL)}')) AS does FROM st GROUP BY term)
  LEFT JOIN (SELECT term, count(*) FILTER (WHERE relation <> 'call_boundary_argument_flow') AS d, count(*) FILTER (WHERE relation = 'call_boundary_argument_flow') AS c FROM se GROUP BY term) USING (term))"""


# --- queries --------------------------------------------------------------------------------


def g15_statement_flows(spark, sf_dir):
    statements, files = _statements(spark, sf_dir)
    return L.statement_flows(statements, L.statement_edges(statements, _starts(files)))


def j14_arg_to_formal(spark, sf_dir):
    statements, files = _statements(spark, sf_dir)
    return L.argument_to_formal(statements, _starts(files))


def j11_last_definition(spark, sf_dir):
    return L.local_def_use(_statements(spark, sf_dir)[0])


_EDGE = ("term", "source", "target", "relation", "symbol", "step", "to_step", "target_line")
_EDGE_SQL = ", ".join(_EDGE)


def j13_call_boundary(spark, sf_dir):
    rows, files = _steps(spark, sf_dir)
    return L.call_boundary(rows, _starts(files)).select(*_EDGE).distinct()


def j15_return_to_call(spark, sf_dir):
    return L.return_to_call(_steps(spark, sf_dir)[0]).select(*_EDGE).distinct()


def j16_shared_attribute(spark, sf_dir):
    return L.shared_attribute(_steps(spark, sf_dir)[0]).select(*_EDGE).distinct()


def _chain(spark, sf_dir):
    rows, files = _steps(spark, sf_dir)
    return rows, kept(L.chain_edges(rows, _starts(files)), "chain-edges")


def g17_flow_chains(spark, sf_dir):
    return L.chain_flows(*_chain(spark, sf_dir), ("public_api", "implementation"))


def a14_group_locations(spark, sf_dir):
    return L.group_locations(*_chain(spark, sf_dir))


def g19_flow_targets(spark, sf_dir):
    return L.flow_targets(*_chain(spark, sf_dir))


G19_SQL = rf"""WITH {CHAIN_SQL}, x AS (SELECT term, path, 1.0 + rank * 0.08 + CASE WHEN role IN ({', '.join(repr(r) for r in L.TARGET_ROLES)}) THEN 2.0 ELSE 0 END AS s FROM rk WHERE role NOT IN ({', '.join(repr(r) for r in L.BLOCKED_ROLES)})
  UNION ALL SELECT term, unnest([source, target]), weight * CASE WHEN relation = 'same_issue_term_cross_file' THEN 0.35 ELSE 1 END FROM ce),
t AS (SELECT term, path, round(sum(s), 6) AS score FROM x GROUP BY ALL)
SELECT * FROM (SELECT term, row_number() OVER (PARTITION BY term ORDER BY score DESC, path) AS rank, path, score FROM t) WHERE rank <= 18"""


def g16_static_slices(spark, sf_dir):
    rows, files = _steps(spark, sf_dir, most_files=32, by_score=False)
    return L.slice_flows(rows, kept(L.slice_edges(rows, _starts(files)), "slice-edges"))


def p25_code_role(spark, sf_dir):
    """Roles of the lines of the steps, by file."""
    rows = _steps(spark, sf_dir)[0]
    return rows.groupBy("term", "role").agg(F.count("*").alias("n"))


def a13_flow_confidence(spark, sf_dir):
    """The confidence of each term by backend, and the best."""
    named = lambda df, name: df.select("term", F.lit(name).alias("backend"), "confidence")
    both = named(g15_statement_flows(spark, sf_dir), "statement").unionByName(named(g17_flow_chains(spark, sf_dir), "chain"))
    return both.groupBy("term").agg(F.max_by("backend", F.struct("confidence", "backend")).alias("backend"), F.max("confidence").alias("confidence"))


def _statement_backend(terms, files, lines, entities):
    statements = L.term_statements(terms, files)
    flows = L.statement_flows(statements, L.statement_edges(statements, entities))
    return flows.select("term", F.when(F.col("edges") > 0, "linked_statements").otherwise("statements").alias("flow_type"), "confidence")


def _mention_backend(terms, files, lines, entities):
    found = L.term_files(terms, files, 20).groupBy("term").agg(F.count("*").alias("files"))
    return found.select("term", F.lit("mention").alias("flow_type"), F.round(F.least(F.lit(0.9), 0.04 * F.col("files")), 3).alias("confidence"))


def x1_flow_backends(spark, sf_dir):
    """Two backends, registered by name and run over all terms."""
    terms, files = _corpus(spark, sf_dir)
    entities = C.braced_entities(files)
    backends = B.FlowBackends(spark)
    backends.register("statement", _statement_backend)
    backends.register("mention", _mention_backend)
    return backends.run(terms, files, C.lines(files), entities)


X1_SQL = f"""WITH {STATEMENTS_SQL} SELECT 'statement' AS backend, term, CASE WHEN edges > 0 THEN 'linked_statements' ELSE 'statements' END AS flow_type, confidence FROM sflows
UNION ALL SELECT 'mention', term, 'mention', round(least(0.9, 0.04 * count(*)), 3) FROM tf GROUP BY term"""

_CHAIN_PART = CHAIN_SQL[len(TERMS_SQL) :]
for _name in ("tf", "tl"):
    _CHAIN_PART = _CHAIN_PART.replace(f"{_name} AS (", f"c_{_name} AS (").replace(f"FROM {_name} ", f"FROM c_{_name} ").replace(f"JOIN {_name} ", f"JOIN c_{_name} ")
A13_SQL = f"""WITH {STATEMENTS_SQL}{_CHAIN_PART},
b AS (SELECT term, 'statement' AS backend, confidence FROM sflows UNION ALL SELECT term, 'chain', confidence FROM cf)
SELECT term, arg_max(backend, struct_pack(c := confidence, b := backend)) AS backend, max(confidence) AS confidence FROM b GROUP BY term"""

QUERIES = {
    "g15_statement_flows": (g15_statement_flows, f"WITH {STATEMENTS_SQL} SELECT * FROM sflows"),
    "j14_arg_to_formal": (j14_arg_to_formal, f"WITH {STATEMENTS_SQL} SELECT * FROM atf"),
    "j11_last_definition": (j11_last_definition, f"WITH {STATEMENTS_SQL} SELECT * FROM ldu"),
    "j13_call_boundary": (j13_call_boundary, f"WITH {CHAIN_SQL} SELECT DISTINCT {_EDGE_SQL} FROM cb"),
    "j15_return_to_call": (j15_return_to_call, f"WITH {CHAIN_SQL} SELECT DISTINCT {_EDGE_SQL} FROM rt"),
    "j16_shared_attribute": (j16_shared_attribute, f"WITH {CHAIN_SQL} SELECT DISTINCT {_EDGE_SQL} FROM sa"),
    "g17_flow_chains": (g17_flow_chains, f"WITH {CHAIN_SQL} SELECT * FROM cf"),
    "a14_group_locations": (a14_group_locations, f"WITH {CHAIN_SQL} SELECT term, path, role, statements, coalesce(edge_score, 0) AS edge_score FROM lo LEFT JOIN es USING (term, path)"),
    "g19_flow_targets": (g19_flow_targets, G19_SQL),
    "g16_static_slices": (g16_static_slices, f"WITH {SLICE_SQL} SELECT * FROM sf"),
    "p25_code_role": (p25_code_role, f"WITH {CHAIN_SQL} SELECT term, role, count(*) AS n FROM st GROUP BY ALL"),
    "a13_flow_confidence": (a13_flow_confidence, A13_SQL),
    "x1_flow_backends": (x1_flow_backends, X1_SQL),
}
