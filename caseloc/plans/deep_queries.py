"""Flows between entities, scopes of graphs and scoped searches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import kept
from ..operators import code as C
from ..operators import interflow as I
from ..operators import policy as P
from ..operators import scope as G
from ..operators import search as S
from ..operators import terms as T
from .code_queries import ENTITIES_SQL, STARTS_SQL, code_files
from .evidence_queries import _any
from .flow_queries import _SYMBOL, _q, flow_terms
from .policy_queries import _ALLOW, _CAP, _FACTOR, _ROLE_RULES, _case, _ends
from .search_queries import _EXT, _TOKENS, RANKED_SQL, search_files
from .views import FILES_SQL, ISSUES_SQL, files, issues, load, sql_list

# --- flows between entities: an instance has the terms of 400 numbers and three candidate files ---


def _traced(spark, sf_dir):
    corpus = kept(code_files(spark, sf_dir), "code")
    entities = I.flow_entities(C.braced_entities(corpus), corpus)
    number = F.substring("term", 2, 20).cast("long")
    pos = (number % 400) * 2 + F.col("term").startswith("q").cast("int")
    terms = flow_terms(spark, sf_dir).select(F.floor(number / 400).alias("instance_id"), pos.alias("pos"), "term")
    placed = corpus.select(F.regexp_extract("path", r"^src/c(\d+)/", 1).cast("long").alias("instance_id"), "path")
    first = Window.partitionBy("instance_id").orderBy("path")
    beam = placed.withColumn("n", F.row_number().over(first)).where("n <= 3").select("instance_id", "path")
    asked = issues(spark, sf_dir)
    return I.interprocedural_edges(terms, asked, entities, beam), asked, entities


def g12_interprocedural_flows(spark, sf_dir):
    (edges, holders), asked, entities = _traced(spark, sf_dir)
    return I.interprocedural_flows(edges, holders, asked, entities)


def g12_flow_edges(spark, sf_dir):
    """The edges themselves, between named entities."""
    (edges, _), _, entities = _traced(spark, sf_dir)
    for end in ("source", "target"):
        edges = edges.join(entities.select(F.col("id").alias(end), F.concat_ws("::", "path", "name").alias(f"{end}_entity")), end)
    return edges.groupBy("instance_id", "term", "relation", "source_entity", "target_entity").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


_STOP = ", ".join(repr(x) for x in I.NO_CALLEE)
_GENERIC = ", ".join(repr(x) for x in I.GENERIC_CALLS)
_NOISE = ", ".join(repr(x) for x in I.PATH_NOISE)
_EDGE = "instance_id, term, stage, place, call, source, target, callee, line, relation, confidence"
_NAMED = "contains(lower(callee || ' ' || args), term)"


def _hop_sql(hop: int) -> str:
    front = "front0" if hop == 1 else f"front{hop - 1}"
    return rf"""near{hop} AS (SELECT DISTINCT f.instance_id, f.term, g.source, g.target, place, call, callee, line, args FROM {front} f JOIN graph g ON g.instance_id = f.instance_id AND f.node IN (g.source, g.target)),
hop{hop} AS (SELECT n.instance_id, n.term, {hop} AS stage, n.place, call, source, target, callee, line,
  CASE WHEN contains(args, n.term) THEN 'candidate_beam_parameter_closure' ELSE 'candidate_beam_call_closure' END || ':hop{hop}' AS relation,
  least(0.88, CASE WHEN contains(args, n.term) THEN 0.72 ELSE 0.58 + 0.08 * greatest(coalesce(a.relevance, 0), coalesce(b.relevance, 0)) END) AS confidence
  FROM near{hop} n LEFT JOIN seen a ON a.instance_id = n.instance_id AND a.term = n.term AND a.id = source LEFT JOIN seen b ON b.instance_id = n.instance_id AND b.term = n.term AND b.id = target
  WHERE contains(lower(callee || ' ' || args), n.term) OR greatest(coalesce(a.relevance, 0), coalesce(b.relevance, 0)) >= {I.RELEVANT}),
front{hop} AS (SELECT DISTINCT instance_id, term, node FROM (SELECT instance_id, term, unnest([source, target]) AS node FROM hop{hop}) ANTI JOIN front0 USING (instance_id, term, node))"""


G12_SQL = rf"""{ENTITIES_SQL}, {ISSUES_SQL},
terms AS (SELECT CAST(substr(term, 2) AS BIGINT) // 400 AS instance_id, CAST(substr(term, 2) AS BIGINT) % 400 * 2 + CAST(starts_with(term, 'q') AS INT) AS pos, term FROM (
  SELECT 'p' || p_partkey AS term FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'q' || c_custkey FROM customer WHERE c_custkey % 50 = 0)),
en AS (SELECT row_number() OVER (ORDER BY path, start_line, kind, name) AS id, path, kind, name, {_SYMBOL('name')} AS symbol, start_line, end_line,
  regexp_replace(path, '/?[^/]*$', '') AS dir, list_filter(regexp_split_to_array(lower(path), '[/_.\-]+'), lambda t: length(t) >= 3 AND t NOT IN ({_NOISE})) AS words FROM entities),
et AS (SELECT en.*, t.text, lower(path || chr(10) || name || chr(10) || left(t.text, {I.HAY})) AS hay FROM en JOIN (
  SELECT id, left(string_agg(line, chr(10) ORDER BY line_no), {I.BODY}) AS text FROM en JOIN lines l ON l.path = en.path AND line_no BETWEEN start_line AND end_line GROUP BY id) t USING (id)),
th AS (SELECT term, id FROM (SELECT DISTINCT term FROM terms) JOIN et ON contains(hay, term)),
bm AS (SELECT instance_id, path FROM (SELECT CAST(regexp_extract(path, '^src/c(\d+)/', 1) AS BIGINT) AS instance_id, path, row_number() OVER (PARTITION BY regexp_extract(path, '^src/c(\d+)/', 1) ORDER BY path) AS n FROM code) WHERE n <= 3),
ar AS (SELECT instance_id, id, min(pos) AS pos FROM (SELECT instance_id, id, pos FROM terms JOIN th USING (term) UNION ALL SELECT instance_id, id, -1 FROM bm JOIN et USING (path)) GROUP BY ALL),
active AS (SELECT * FROM (SELECT instance_id, id, pos < 0 AS beam, row_number() OVER (PARTITION BY instance_id ORDER BY pos, id) AS place FROM ar) WHERE place <= {I.ACTIVE}),
qm AS (SELECT instance_id, term, unnest(regexp_extract_all(term || ' ' || coalesce(issue_text, ''), '[A-Za-z_][A-Za-z0-9_.$-]*')) AS m FROM terms LEFT JOIN issues USING (instance_id)),
qw AS (SELECT DISTINCT instance_id, term, token FROM (SELECT instance_id, term, regexp_replace(lower(m), '^[._$-]+|[._$-]+$', '', 'g') AS token FROM qm
  UNION ALL SELECT instance_id, term, unnest(string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')) FROM qm) WHERE length(token) >= 3),
qa AS (SELECT instance_id, term, list(token) AS words FROM qw GROUP BY ALL),
seen AS (SELECT a.instance_id, t.term, a.id, place, beam, symbol, contains(hay, t.term) AS holds,
  coalesce(least(1.0, len(list_filter(qa.words, lambda w: contains(hay, w))) / greatest(3, least(len(qa.words), 12))), 0.0) AS relevance
  FROM active a JOIN et USING (id) JOIN (SELECT DISTINCT instance_id, term FROM terms) t ON t.instance_id = a.instance_id LEFT JOIN qa ON qa.instance_id = t.instance_id AND qa.term = t.term),
live AS (SELECT DISTINCT instance_id, term FROM seen WHERE holds),
bl AS (SELECT id, unnest(l) AS code, generate_subscripts(l, 1) AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM et WHERE id IN (SELECT id FROM active))),
cx AS (SELECT id, line, unnest(regexp_extract_all(code, '{_q(I.CALL)}', 1)) AS callee, unnest(regexp_extract_all(code, '{_q(I.CALL)}', 2)) AS args, generate_subscripts(regexp_extract_all(code, '{_q(I.CALL)}', 1), 1) AS k FROM bl),
called AS (SELECT id AS source, line * 1000 + k AS call, line, callee, {_SYMBOL('callee')} AS symbol, lower(args) AS args FROM cx WHERE lower(split_part(callee, '.', -1)) NOT IN ({_STOP})),
pc AS (SELECT c.source, c.symbol, t.id AS target, t.dir = s.dir AS near, list_has_any(t.words, s.words) AS rel FROM (SELECT DISTINCT source, symbol FROM called WHERE symbol <> '' AND symbol NOT IN ({_GENERIC})) c
  JOIN et s ON s.id = c.source JOIN et t ON t.symbol = c.symbol AND NOT (t.path = s.path AND t.name = s.name)),
pw AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE near) OVER w AS nn, count(*) FILTER (WHERE rel) OVER w AS nr FROM pc WINDOW w AS (PARTITION BY source, symbol)),
targets AS (SELECT source, symbol, target FROM pw WHERE n = 1 OR (nn BETWEEN 1 AND {I.TARGETS} AND near) OR (nn = 0 AND nr BETWEEN 1 AND {I.TARGETS} AND rel)),
own AS (SELECT instance_id, place, c.* FROM active JOIN called c ON c.source = id),
linked AS (SELECT own.*, target FROM own LEFT JOIN targets USING (source, symbol)),
dr AS (SELECT l.*, live.term, bool_or(h.id IS NOT NULL) OVER (PARTITION BY l.instance_id, live.term, l.source, call) AS any_holds FROM linked l JOIN live USING (instance_id) LEFT JOIN th h ON h.term = live.term AND h.id = l.target),
s0 AS (SELECT instance_id, term, 0 AS stage, place, call, source, coalesce(target, source) AS target, callee, line,
  CASE WHEN target IS NULL THEN 'term_argument_without_resolved_callee' WHEN contains(args, term) THEN 'passes_term_to_callee' ELSE 'calls_term_related_entity' END AS relation,
  CASE WHEN target IS NULL THEN {I.UNRESOLVED} WHEN contains(args, term) THEN {I.PASSED} ELSE {I.RELATED} END AS confidence
  FROM dr WHERE {_NAMED} OR (target IS NOT NULL AND any_holds)),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY place, call, target) AS n FROM linked WHERE target IS NOT NULL) WHERE n <= 3600),
front0 AS (SELECT instance_id, term, id AS node FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, term ORDER BY holds DESC, place) AS n FROM seen WHERE holds OR (beam AND relevance > {I.RELEVANT})) WHERE n <= {I.FRONTIER} AND (instance_id, term) IN (SELECT instance_id, term FROM live)),
{_hop_sql(1)},
{_hop_sql(2)},
nm AS (SELECT DISTINCT instance_id, term, symbol FROM seen WHERE holds AND symbol <> ''),
f8 AS (SELECT instance_id, term, id AS target FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, term ORDER BY place) AS n FROM seen WHERE holds) WHERE n <= {I.NAMED}),
s9 AS (SELECT o.instance_id, nm.term, 9 AS stage, o.place, o.call, o.source, f8.target, callee, line, 'caller_reaches_term_entity' AS relation, {I.CALLER} AS confidence
  FROM own o JOIN nm USING (instance_id, symbol) JOIN f8 ON f8.instance_id = o.instance_id AND f8.term = nm.term
  WHERE NOT EXISTS (SELECT 1 FROM seen h WHERE h.holds AND h.instance_id = o.instance_id AND h.term = nm.term AND h.id = o.source)),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, term ORDER BY stage, place, call, target, source) AS n FROM (
  SELECT {_EDGE} FROM s0 UNION ALL SELECT {_EDGE} FROM hop1 UNION ALL SELECT {_EDGE} FROM hop2 UNION ALL SELECT {_EDGE} FROM s9)) WHERE n <= 240)"""
_FAMILY = "CASE " + " ".join(f"WHEN {_any('low', words)} THEN '{k}'" for k, words in I.FAMILIES.items()) + " ELSE 'interprocedural_symbol_flow' END"
G12_FLOWS_SQL = rf"""WITH {G12_SQL},
pa AS (SELECT instance_id, term, least(80, count(DISTINCT path)) AS paths FROM (SELECT instance_id, term, unnest([source, target]) AS id FROM edges UNION ALL SELECT instance_id, term, id FROM seen WHERE holds) JOIN et USING (id) GROUP BY ALL),
be AS (SELECT instance_id, term, max(round(confidence, 6)) AS best, count(*) AS edges FROM edges GROUP BY ALL),
hc AS (SELECT instance_id, term, count(*) AS entities, lower(term || coalesce(chr(10) || any_value(issue_text), '')) AS low FROM seen LEFT JOIN issues USING (instance_id) WHERE holds GROUP BY instance_id, term),
fl AS (SELECT instance_id, term, {_FAMILY} AS flow_type, round(least(0.96, coalesce(best, {I.NO_EDGE}) + least(0.18, 0.03 * paths)), 3) AS confidence, entities, coalesce(edges, 0) AS edges, paths
  FROM hc JOIN pa USING (instance_id, term) LEFT JOIN be USING (instance_id, term))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY confidence DESC, flow_type, term) AS rank FROM fl) WHERE rank <= 10"""
G12_EDGES_SQL = f"""WITH {G12_SQL} SELECT instance_id, term, relation, s.path || '::' || s.name AS source_entity, t.path || '::' || t.name AS target_entity, count(*) AS n, max(round(confidence, 6)) AS confidence
FROM edges JOIN et s ON s.id = source JOIN et t ON t.id = target GROUP BY ALL"""


# --- searches within a pool: the best files of each passage; some passages have none ---


def _pools(spark, sf_dir):
    passages = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pool = kept(search_files(spark, sf_dir).where("query_id % 7 <> 0").select("query_id", "path"), "pool")
    return passages, pool


def w4_scoped_search_files(spark, sf_dir):
    passages, pool = _pools(spark, sf_dir)
    return S.scoped_search_files(passages, pool, files(spark, sf_dir), 15)


def w4_scoped_search_entities(spark, sf_dir):
    """Documents as entities, named after their language and length."""
    passages, pool = _pools(spark, sf_dir)
    entities = files(spark, sf_dir, F.concat_ws("_", "lang", F.col("n_chars").cast("string")).alias("name")).select("path", "name", "text")
    return S.scoped_search_entities(passages, pool, entities, 15).where("query_id % 7 <> 0")


SCOPED_SQL = rf"""{RANKED_SQL},
st AS (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, token) AS k FROM (
  SELECT item_id, regexp_replace(lower(m), '^[._$-]+|[._$-]+$', '', 'g') AS token FROM qm
  UNION ALL SELECT item_id, unnest(string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')) FROM qm)
  WHERE length(token) >= 3 AND NOT regexp_matches(token, '^\d+$') AND token NOT IN ({', '.join(repr(t) for t in T.STOP_QUERY_TOKENS)}) GROUP BY item_id, token),
ta AS (SELECT item_id AS query_id, list(token) AS terms FROM st WHERE k <= 48 GROUP BY item_id)"""
W4_FILES_SQL = rf"""WITH {SCOPED_SQL},
b AS (SELECT r.query_id, r.path, lower(f.path) AS lp, lower(left(f.text, 120000)) AS body, terms, trim(lower(p.text)) AS phrase
  FROM ranked r JOIN files f USING (path) JOIN ta ON ta.query_id = r.query_id JOIN benchmark p ON p.item_id = r.query_id WHERE r.query_id % 7 <> 0),
s AS (SELECT query_id, path, CAST(list_sum(list_transform(terms, lambda t: CASE WHEN contains(lp, t) THEN 8.0 ELSE 0 END + least(10, (length(body) - length(replace(body, t, ''))) // length(t))))
  + CASE WHEN length(phrase) > 4 AND contains(body, phrase) THEN 4 ELSE 0 END AS DOUBLE) AS score FROM b)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank, path, score FROM s WHERE score > 0) WHERE rank <= 15
UNION ALL SELECT query_id, rank, path, score FROM ranked WHERE query_id % 7 = 0"""
W4_ENTITIES_SQL = rf"""WITH {SCOPED_SQL},
b AS (SELECT r.query_id, r.path, d.lang || '_' || d.n_chars AS name, lower(f.path) AS lp, lower(left(f.text, 30000)) AS body, terms
  FROM ranked r JOIN files f USING (path) JOIN documents d USING (doc_id) JOIN ta ON ta.query_id = r.query_id WHERE r.query_id % 7 <> 0),
s AS (SELECT query_id, path, name, CAST(list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(name), t) THEN 10.0 ELSE 0 END + CASE WHEN contains(lp, t) THEN 4.0 ELSE 0 END
  + least(8, (length(body) - length(replace(body, t, ''))) // length(t)))) AS DOUBLE) AS score FROM b)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, name) AS rank, path, name, score FROM s WHERE score > 0) WHERE rank <= 15"""


# --- scope of a graph: each passage asks for itself, a document's path and its neighbour ---


def g24_graph_scope(spark, sf_dir):
    corpus, passages = files(spark, sf_dir), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("instance_id"), "text")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    own = passages.join(corpus.select(F.col("doc_id").alias("instance_id"), "path"), "instance_id").select("instance_id", "path")
    queries = passages.select("instance_id", F.lit(1).alias("pos"), F.col("text").alias("query")).unionByName(own.select("instance_id", F.lit(2).alias("pos"), F.col("path").alias("query")))
    seeds = passages.join(corpus.select((F.col("doc_id") - 1).alias("instance_id"), "path"), "instance_id").select("instance_id", "path")
    entities = files(spark, sf_dir, F.concat_ws("_", "lang", F.col("n_chars").cast("string")).alias("name"), F.col("source").alias("entity_text")).select("path", "name", F.col("entity_text").alias("text"))
    words = passages.join(docs.withColumnRenamed("doc_id", "instance_id"), "instance_id")
    terms = words.select("instance_id", F.explode(F.array(F.lower("lang"), F.lower("source"))).alias("term"))
    scope = G.graph_scope(queries, corpus, entities, seeds, terms, issues(spark, sf_dir).join(passages.select("instance_id"), "instance_id", "left_semi"))
    return scope.withColumn("channels", F.array_join("channels", ","))


_W = "[A-Za-z_][A-Za-z0-9_.$-]*"
_EDGES = "'^[._$-]+|[._$-]+$', '', 'g'"
_PARTS = "string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' ')"
G24_SQL = rf"""WITH {FILES_SQL}, {ISSUES_SQL},
raw AS (SELECT item_id AS query_id, 1 AS pos, text AS query FROM benchmark UNION ALL SELECT item_id, 2, path FROM benchmark JOIN files ON doc_id = item_id),
seeds AS (SELECT item_id AS query_id, path FROM benchmark JOIN files ON doc_id = item_id + 1),
cw AS (SELECT *, list_filter(flatten(list_transform(regexp_extract_all(t, '{_W}'), lambda m: [regexp_replace(lower(m), {_EDGES})] || {_PARTS})),
  lambda k: length(k) >= 3 AND NOT list_contains({sql_list(T.STOP_QUERY_TOKENS)}, k) AND NOT regexp_matches(k, '^\d+$')) AS l FROM (SELECT *, trim(regexp_replace(query, '\s+', ' ', 'g')) AS t FROM raw)),
pq AS (SELECT query_id, 0 AS g, CAST(row_number() OVER (PARTITION BY query_id ORDER BY path) AS BIGINT) AS p, path AS query FROM seeds
  UNION ALL SELECT query_id, 1, pos, CASE WHEN contains(t, '/') OR contains(t, '::') OR regexp_matches(t, '\.[A-Za-z0-9]{{1,6}}\b') THEN substr(t, 1, 180) ELSE array_to_string(l[1:12], ' ') END FROM cw),
q AS (SELECT query_id, arg_min(query, struct_pack(g := g, p := p, q := query)) AS query FROM pq WHERE query <> '' GROUP BY query_id, lower(query)),
qm AS (SELECT query_id, query, unnest(regexp_extract_all(query, '{_W}')) AS m FROM q),
qt AS (SELECT query_id, token, 1 + least(1.0, log2(count(*)) * 0.25) AS weight FROM (SELECT query_id, regexp_replace(lower(m), {_EDGES}) AS token FROM qm UNION ALL SELECT query_id, unnest({_PARTS}) FROM qm) WHERE length(token) >= 2 GROUP BY ALL),
low AS (SELECT path, lower(path) AS lp, lower(text) AS lt FROM files),
td AS (SELECT token, path, CASE WHEN contains(lp, token) THEN 8 ELSE 0 END + least(12, (length(lt) - length(replace(lt, token, ''))) // length(token)) AS times FROM (SELECT DISTINCT token FROM qt), low WHERE contains(lt, token) OR contains(lp, token)),
sc AS (SELECT query_id, path, weight * times AS s FROM qt JOIN td USING (token) UNION ALL SELECT query_id, path, 5.0 FROM q, low WHERE length(trim(lower(query))) > 4 AND contains(lt, trim(lower(query)))),
w2 AS (SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (SELECT query_id, path, round(sum(s), 6) AS score FROM sc GROUP BY ALL)) WHERE rank <= 120),
ent AS (SELECT DISTINCT path, lang || '_' || n_chars AS name, source AS text, lower(path) AS lp, lower(lang || '_' || n_chars) AS ln, lower(path || ' ' || lang || '_' || n_chars || ' ' || source) AS hay FROM files JOIN documents USING (doc_id)),
es AS (SELECT query_id, path, name, sum(CASE WHEN contains(ln, token) THEN 10 * weight ELSE 0 END) + least(24.0, sum(CASE WHEN contains(lp, token) THEN 4 * weight ELSE 0 END)) + least(36.0, sum(least(8, (length(hay) - length(replace(hay, token, ''))) // length(token)) * weight)) AS s
  FROM qt, ent WHERE contains(hay, token) GROUP BY ALL),
ex AS (SELECT DISTINCT query_id, lower(n) AS n FROM (SELECT query_id, query, unnest(regexp_extract_all(query, '[A-Za-z_$][A-Za-z0-9_$]*')) AS n FROM q) WHERE length(n) >= 6 OR regexp_matches(n, '^.[^A-Z]*[A-Z]') OR contains(n, '_') OR contains(n, '$') OR contains(query, n || '(')),
w3 AS (SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, name) AS rank FROM (
  SELECT es.query_id, path, name, round(s + CASE WHEN ex.n IS NULL THEN 0 ELSE 30 END, 6) AS score FROM es LEFT JOIN ex ON ex.query_id = es.query_id AND ex.n = lower(name))) WHERE rank <= 120),
pw AS (SELECT DISTINCT query_id, probe, {_TOKENS} AS t FROM (SELECT query_id, lower(trim(query)) AS probe FROM q)),
pp AS (SELECT * FROM pw WHERE contains(probe, '/') OR regexp_matches(probe, '\.[a-z0-9]{{1,5}}\b') OR (len(list_distinct(list_filter(t, lambda x: length(x) >= 4))) BETWEEN 3 AND 8 AND length(probe) <= 120)),
px AS (SELECT query_id, path, probe, t, lp AS low, len(list_filter(t, lambda k: contains(lp, k))) AS n FROM pp, low),
pc AS (SELECT query_id, path, n, contains(probe, '/') AS slash, CASE WHEN low = probe THEN 0 WHEN starts_with(low, probe) THEN 1 WHEN contains(low, probe) THEN 2
  WHEN length(regexp_replace(probe, '{_EXT}', '')) >= 8 AND contains(regexp_replace(low, '{_EXT}', ''), regexp_replace(probe, '{_EXT}', '')) THEN 3
  WHEN len(t) > 0 AND n >= CASE WHEN contains(probe, '/') THEN least(4, greatest(2, len(t) - 1)) ELSE least(4, greatest(3, len(list_distinct(t)) - 1)) END THEN 4 END AS tier FROM px),
w5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (
  SELECT query_id, path, max(CASE tier WHEN 0 THEN 96.0 WHEN 1 THEN 82.0 WHEN 2 THEN 62.0 WHEN 3 THEN 42.0 ELSE CASE WHEN slash THEN 12.0 + 4 * n ELSE 18.0 + 6 * n END END) AS score FROM pc WHERE tier IS NOT NULL GROUP BY ALL)),
st AS (SELECT item_id AS query_id, list_distinct([lower(lang), lower(source)]) AS terms FROM benchmark JOIN documents ON doc_id = item_id),
sm AS (SELECT query_id, path, regexp_split_to_array(lp, '[/_.\-\s]+') AS parts, list_filter(terms, lambda t: contains(lp, t)) AS m FROM st, low),
w6 AS (SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM (
  SELECT query_id, path, list_sum(list_transform(m, lambda t: CASE WHEN list_contains(parts, t) THEN 6.0 ELSE 3.0 END)) + CASE WHEN len(m) >= 2 THEN 12 ELSE 0 END AS score FROM sm WHERE len(m) > 0)) WHERE n <= 80),
rows AS (SELECT query_id, path, score, 'file' AS channel FROM w2 UNION ALL SELECT query_id, path, score * 1.25, 'entity' FROM w3
  UNION ALL SELECT query_id, path, greatest(20, 81 - row_number() OVER (PARTITION BY query_id ORDER BY path)), 'seed' FROM seeds
  UNION ALL SELECT query_id, path, 45.0, 'exact_path' FROM q JOIN files ON path = query UNION ALL SELECT query_id, path, score, 'path_probe' FROM w5 WHERE rank <= 90 UNION ALL SELECT query_id, path, score, 'path_semantic' FROM w6),
tot AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, path) AS n FROM (SELECT query_id, path, sum(score) AS s FROM rows GROUP BY ALL)),
nr AS (SELECT query_id, path FROM tot WHERE n <= 15 UNION SELECT query_id, path FROM w5 WHERE rank <= 15),
fd AS (SELECT * FROM (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY path) AS n FROM files) WHERE n <= 6),
sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path) AS k FROM (SELECT DISTINCT x.query_id, fd.path FROM (SELECT DISTINCT query_id, regexp_replace(path, '/?[^/]*$', '') AS dir FROM nr) x JOIN fd USING (dir)
  WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.query_id = x.query_id AND nr.path = fd.path))) WHERE k <= 36),
su AS (SELECT query_id, path, sum(score) AS score, list_sort(list_distinct(list(channel))) AS channels FROM (SELECT * FROM rows UNION ALL SELECT query_id, path, 4.0, 'same_directory' FROM sd) GROUP BY ALL),
n AS (SELECT su.*, lower(regexp_replace(trim(path), '^[./]+', '')) AS low, lower(coalesce(issue_text, '')) AS it FROM su LEFT JOIN issues ON instance_id = query_id),
nn AS (SELECT *, regexp_extract(low, '([^/]*)$', 1) AS fn, split_part(low, '/', 1) AS fp FROM n),
ro AS (SELECT *, {_case(_ROLE_RULES, 'implementation')} AS role, {_ALLOW} AS allowed, {_any('it', P.ADDON_WORDS)} AS addon, {_ends('lower(path)', P.SOURCE_ENDS)} AS src FROM nn),
fs AS (SELECT query_id AS instance_id, path, round(least(score * {_FACTOR}, {_CAP}), 6) AS score, array_to_string(channels, ',') AS channels FROM ro)
SELECT * FROM (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, path) AS rank, path, score, channels FROM fs) WHERE rank <= 120"""

QUERIES = {
    "g24_graph_scope": (g24_graph_scope, G24_SQL),
    "w4_scoped_search_files": (w4_scoped_search_files, W4_FILES_SQL),
    "w4_scoped_search_entities": (w4_scoped_search_entities, W4_ENTITIES_SQL),
    "g12_interprocedural_flows": (g12_interprocedural_flows, G12_FLOWS_SQL),
    "g12_flow_edges": (g12_flow_edges, G12_EDGES_SQL),
}
