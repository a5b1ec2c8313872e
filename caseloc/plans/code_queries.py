"""Code and graph queries. Orders are files of generated source: each line item
adds a class, a function or an import, so calls and imports lead to other files.
Each has a function of its own, which passes what it is given to that of the
customer's order before."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import kept
from ..operators import code as C
from ..operators import graph as G
from .views import FILES_SQL, files, load


def code_files(spark, sf_dir):
    """(path, text) of all orders. Only keys go through the shuffles; the source is
    written out where an order meets its items."""
    li, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    # The order of flags is that of the pieces they stand for.
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    items = li.select("l_orderkey", key.alias("item")).repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"))
    previous = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    joined = items.join(orders.select("o_orderkey", "o_custkey", previous.alias("previous")), F.col("l_orderkey") == F.col("o_orderkey"))

    def chunk(x):
        part, supp = x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")
        return (
            F.when(
                x["l_returnflag"] == "A",
                F.concat(F.lit("class P"), part, F.lit(" {\n  // holds p"), supp, F.lit("\n  run"), supp, F.lit("(x) {\n    this.k"), supp, F.lit(" = p"), supp, F.lit("(x);\n    return this.k"), supp, F.lit("; /* run { */\n  }\n}")),
            )
            .when(x["l_returnflag"] == "N", F.concat(F.lit("export function p"), part, F.lit("(a) {\n  const y"), part, F.lit(" = p"), supp, F.lit("(a); const u = \"http://x/*\"; /* see\n  { y"), part, F.lit(" { block */\n  return p"), part, F.lit(".run(y"), part, F.lit(");\n}")))
            .otherwise(F.concat(F.lit("import { p"), supp, F.lit(" } from './o"), (F.col("l_orderkey") - F.col("l_orderkey") % 4).cast("string"), F.lit("';")))
        )

    key, given = F.col("o_orderkey").cast("string"), F.concat(F.lit("q"), F.col("o_custkey").cast("string"))
    head = F.concat(
        F.lit("function f"), key, F.lit("("), given, F.lit(") {\n  f"), F.coalesce("previous", "o_orderkey").cast("string"), F.lit("("), given,
        F.lit(");\n  const "), given, F.lit("x = 1;\n  return "), given, F.lit("x;\n}\n"),
    )
    path = F.concat(F.lit("src/c"), (F.col("o_custkey") % 400).cast("string"), F.lit("/o"), key, F.lit(".js"))
    return joined.select(path.alias("path"), F.concat(head, F.array_join(F.transform("items", chunk), "\n")).alias("text"))


CODE_SQL = r"""code AS (SELECT 'src/c' || CAST(o_custkey % 400 AS VARCHAR) || '/o' || CAST(o_orderkey AS VARCHAR) || '.js' AS path,
  'function f' || o_orderkey || '(q' || o_custkey || ') {' || chr(10) || '  f' || coalesce(previous, o_orderkey) || '(q' || o_custkey || ');' || chr(10) || '  const q' || o_custkey || 'x = 1;' || chr(10) || '  return q' || o_custkey || 'x;' || chr(10) || '}' || chr(10) || text AS text
  FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) JOIN (
  SELECT l_orderkey, string_agg(CASE l_returnflag
    WHEN 'A' THEN 'class P' || l_partkey || ' {' || chr(10) || '  // holds p' || l_suppkey || chr(10) || '  run' || l_suppkey || '(x) {' || chr(10) || '    this.k' || l_suppkey || ' = p' || l_suppkey || '(x);' || chr(10) || '    return this.k' || l_suppkey || '; /* run { */' || chr(10) || '  }' || chr(10) || '}'
    WHEN 'N' THEN 'export function p' || l_partkey || '(a) {' || chr(10) || '  const y' || l_partkey || ' = p' || l_suppkey || '(a); const u = "http://x/*"; /* see' || chr(10) || '  { y' || l_partkey || ' { block */' || chr(10) || '  return p' || l_partkey || '.run(y' || l_partkey || ');' || chr(10) || '}'
    ELSE 'import { p' || l_suppkey || ' } from ''./o' || CAST(l_orderkey - l_orderkey % 4 AS VARCHAR) || ''';' END, chr(10)
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
lines AS (SELECT path, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT path, string_split(text, chr(10)) AS l FROM code))"""


def e1_lines(spark, sf_dir):
    return C.lines(code_files(spark, sf_dir))


def e2_extract_entities(spark, sf_dir):
    return C.declarations(C.lines(code_files(spark, sf_dir)))


STARTS_SQL = r"""starts AS (SELECT DISTINCT path, kind, name, line_no AS start_line FROM (
  SELECT path, line_no, 'class' AS kind, regexp_extract(line, '^\s*(?:export\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS name FROM lines
  UNION ALL SELECT path, line_no, 'function', regexp_extract(line, '^\s*(?:export\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(', 1) FROM lines
  UNION ALL SELECT path, line_no, 'method', regexp_extract(line, '^\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*\{', 1) FROM lines) WHERE name <> '')"""


def e3_brace_end_line(spark, sf_dir):
    return C.braced_entities(code_files(spark, sf_dir))


#: The same pattern for an engine that needs no possessive groups.
_COMMENTS = C.COMMENTS.replace("*+", "*").replace("++", "+").replace("'", "''")
MASK_SQL = rf"""bare AS (SELECT path, line_no, regexp_replace(line, '{_COMMENTS}', '\1\2', 'g') AS line, array_to_string(regexp_extract_all(line, '{_COMMENTS}', 2), '') AS opened FROM lines),
marks AS (SELECT *, opened <> '' AS opens, contains(line, '*/') AS closes FROM bare),
held AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN 1 WHEN closes THEN 0 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM marks),
masked AS (SELECT path, line_no, CASE WHEN inside = 1 AND NOT closes THEN '' WHEN inside = 1 THEN substr(line, instr(line, '*/') + 2) WHEN opens THEN left(line, length(line) - length(opened)) ELSE line END AS line FROM held)"""
ENTITIES_SQL = rf"""{CODE_SQL}, {MASK_SQL}, {STARTS_SQL.replace('FROM lines', 'FROM masked')},
d AS (SELECT path, line_no, line, length(line) - length(replace(line, '{{', '')) AS o, length(line) - length(replace(line, '}}', '')) AS c FROM masked),
r AS (SELECT *, sum(o - c) OVER (PARTITION BY path ORDER BY line_no) AS aft FROM d),
ends AS (SELECT s.path, kind, name, start_line, min(x.line_no) AS e FROM starts s JOIN r b ON b.path = s.path AND b.line_no = s.start_line
  JOIN r x ON x.path = s.path AND x.line_no >= s.start_line AND x.aft <= b.aft - b.o + b.c AND contains(x.line, '}}') AND (x.line_no > s.start_line OR b.o > 0) GROUP BY ALL),
entities AS (SELECT s.path, s.kind, s.name, s.start_line, CAST(CASE WHEN e > s.start_line THEN e ELSE s.start_line + 80 END AS INT) AS end_line
  FROM starts s LEFT JOIN ends USING (path, kind, name, start_line))"""


def e4_indent_end_line(spark, sf_dir):
    return C.indented_entities(code_files(spark, sf_dir)).where("kind = 'class'")


E4_SQL = rf"""WITH {CODE_SQL}, {STARTS_SQL},
i AS (SELECT path, line_no, length(line) - length(ltrim(line)) AS ind FROM lines WHERE trim(line) <> ''),
last AS (SELECT path, max(line_no) AS m FROM lines GROUP BY path),
n AS (SELECT s.path, s.kind, s.name, s.start_line, min(x.line_no) - 1 AS e FROM starts s JOIN i b ON b.path = s.path AND b.line_no = s.start_line
  JOIN i x ON x.path = s.path AND x.line_no > s.start_line AND x.ind <= b.ind GROUP BY ALL)
SELECT s.path, s.kind, s.name, s.start_line, CAST(coalesce(e, m) AS INT) AS end_line FROM starts s JOIN last USING (path) LEFT JOIN n USING (path, kind, name, start_line) WHERE s.kind = 'class'"""


def e5_mask_comments(spark, sf_dir):
    return C.masked_lines(code_files(spark, sf_dir))


def e7_enclosing_symbol(spark, sf_dir):
    return C.enclosing_declaration(code_files(spark, sf_dir), F.col("line").contains("return"), ("class", "function"))


E7_SQL = rf"""WITH {CODE_SQL}, {STARTS_SQL}
SELECT l.path, l.line_no AS line, max_by(s.name, s.start_line) AS name FROM lines l LEFT JOIN starts s ON s.path = l.path AND s.start_line <= l.line_no AND s.kind <> 'method'
WHERE contains(l.line, 'return') GROUP BY l.path, l.line_no"""


def e9_calls(spark, sf_dir):
    return C.calls(C.lines(code_files(spark, sf_dir)))


CALLS_SQL = r"""calls AS (SELECT * FROM (SELECT path, line_no, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$]*)\s*\(', 1)) AS callee FROM lines)
  WHERE callee NOT IN ('if', 'for', 'while', 'switch', 'catch', 'function', 'return', 'typeof', 'new'))"""


def e10_imports(spark, sf_dir):
    return C.imports(C.lines(code_files(spark, sf_dir)))


IMPORTS_SQL = r"imports AS (SELECT DISTINCT path, regexp_extract(line, 'from\s*''([^'']+)''', 1) AS ref FROM lines WHERE starts_with(line, 'import '))"


def e11_resolve_import(spark, sf_dir):
    corpus = code_files(spark, sf_dir)
    return C.resolve_imports(C.imports(C.lines(corpus)), corpus)


E11_SQL = rf"""WITH {CODE_SQL}, {IMPORTS_SQL}
SELECT i.path, ref, c.path AS target FROM imports i JOIN code c ON c.path = regexp_replace(i.path, '/[^/]*$', '') || '/' || substr(ref, 3) || '.js'"""


def e17_source_tree_summary(spark, sf_dir):
    return C.source_tree_summary(code_files(spark, sf_dir).unionByName(files(spark, sf_dir).select("path", "text")))


E17_SQL = rf"""WITH {CODE_SQL}, {FILES_SQL}
SELECT *, row_number() OVER (ORDER BY bytes DESC, extension) AS rank FROM (SELECT extension, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM (
  SELECT '.js' AS extension, text FROM code UNION ALL SELECT '.txt', text FROM files) GROUP BY extension)"""


def e8_statements(spark, sf_dir):
    rows = C.lines(code_files(spark, sf_dir))
    return C.statements(rows, ("y1", "p2"), 5)


E8_SQL = rf"""WITH {CODE_SQL}, t AS (SELECT unnest(['y1', 'p2']) AS term),
h AS (SELECT path, term, line_no, line, row_number() OVER (PARTITION BY path, term ORDER BY line_no) AS n FROM lines, t WHERE contains(lower(line), term)),
x AS (SELECT *, trim(line) AS code, regexp_extract(line, '^\s*(?:const|let|var)?\s*([A-Za-z_$][A-Za-z0-9_$.]*)\s*(?:[+\-*/|&]?=)[^=>]', 1) AS defined FROM h WHERE n <= 5)
SELECT path, term, line_no, CASE WHEN starts_with(code, 'import') THEN 'import' WHEN regexp_matches(code, '^(?:export\s+)?(?:async\s+)?(?:function|class|def)\b') THEN 'declaration'
  WHEN starts_with(code, 'return') THEN 'return' WHEN regexp_matches(code, '^(?:if|else|while|for|switch)\b') THEN 'condition' WHEN defined <> '' THEN 'assignment'
  WHEN contains(code, '(') THEN 'call' ELSE 'other' END AS kind, defined, substr(code, 1, 500) AS code FROM x"""


def j12_def_use(spark, sf_dir):
    rows = C.lines(code_files(spark, sf_dir))
    return C.def_use(C.statements(rows, ("y",), 80))


J12_SQL = rf"""WITH {CODE_SQL},
h AS (SELECT path, line_no, trim(line) AS code, regexp_extract(line, '^\s*(?:const|let|var)?\s*([A-Za-z_$][A-Za-z0-9_$.]*)\s*(?:[+\-*/|&]?=)[^=>]', 1) AS defined,
  row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM lines WHERE contains(lower(line), 'y')),
s AS (SELECT * FROM h WHERE n <= 80),
defs AS (SELECT DISTINCT defined AS symbol, path AS def_path, line_no AS def_line FROM s WHERE defined <> ''),
uses AS (SELECT DISTINCT path AS use_path, line_no AS use_line, unnest(regexp_extract_all(code, '[A-Za-z_$][A-Za-z0-9_$]*')) AS symbol FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol, def_path, def_line ORDER BY use_path, use_line) AS n FROM defs JOIN uses USING (symbol)
  WHERE def_path <> use_path OR def_line < use_line)
SELECT symbol, def_path, def_line, use_path, use_line, CASE WHEN def_path = use_path THEN 'local_def_use' ELSE 'cross_file_def_use' END AS relation FROM p WHERE n <= 12"""


# --- graph ------------------------------------------------------------------------


def _symbols(spark, sf_dir):
    """(calls, symbols) of the source, which is written once; names may repeat."""
    corpus = kept(code_files(spark, sf_dir), "code")
    rows = C.lines(corpus)
    return C.calls(rows).select("path", "callee"), G.symbol_names(C.declarations(rows), corpus)


SYMBOLS_SQL = r"symbols AS (SELECT DISTINCT name, path FROM (SELECT name, path FROM starts UNION ALL SELECT regexp_extract(path, '([^/]*)\.js$', 1), path FROM code) WHERE length(name) >= 3)"


def j3_symbol_targets(spark, sf_dir):
    return G.symbol_target_counts(*_symbols(spark, sf_dir))


J3_SQL = rf"""WITH {CODE_SQL}, {STARTS_SQL}, {SYMBOLS_SQL}, {CALLS_SQL}
SELECT c.path AS source, callee AS name, count(*) AS targets, min(s.path) AS first FROM (SELECT DISTINCT path, callee FROM calls) c JOIN symbols s ON s.name = callee AND s.path <> c.path GROUP BY ALL"""


def j4_bounded_symbol(spark, sf_dir):
    return G.bounded_targets(*_symbols(spark, sf_dir))


J4_SQL = rf"""WITH {CODE_SQL}, {STARTS_SQL}, {SYMBOLS_SQL}, {CALLS_SQL},
f AS (SELECT DISTINCT c.path AS source, callee AS name, s.path AS target FROM calls c JOIN symbols s ON s.name = callee AND s.path <> c.path),
tok AS (SELECT path, list_filter(regexp_split_to_array(lower(path), '[/_.\-]+'), lambda t: length(t) >= 3) AS t FROM code),
n AS (SELECT f.*, regexp_replace(source, '/[^/]*$', '') = regexp_replace(target, '/[^/]*$', '') AS near, list_has_any(a.t, b.t) AS rel
  FROM f JOIN tok a ON a.path = source JOIN tok b ON b.path = target),
w AS (SELECT *, count(*) OVER p AS c, sum(CAST(near AS INT)) OVER p AS cn, sum(CAST(rel AS INT)) OVER p AS cr FROM n WINDOW p AS (PARTITION BY source, name)),
h AS (SELECT source, name, target, CASE WHEN c = 1 THEN 'unique_symbol' WHEN cn BETWEEN 1 AND 2 THEN CASE WHEN near THEN 'same_directory_symbol' END
  WHEN cr BETWEEN 1 AND 2 THEN CASE WHEN rel THEN 'path_related_symbol' END END AS how FROM w)
SELECT * FROM h WHERE how IS NOT NULL"""


def g1_edges_siblings(spark, sf_dir):
    return G.sibling_edges(files(spark, sf_dir))


G1_SQL = f"""WITH {FILES_SQL}, d AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
s AS (SELECT dir FROM d GROUP BY dir HAVING count(*) BETWEEN 2 AND 18)
SELECT a.path AS source, b.path AS target, 'same_directory' AS edge_type, 0.35 AS weight, 'small directory neighborhood' AS evidence
FROM d a JOIN d b ON a.dir = b.dir AND a.path <> b.path WHERE a.dir IN (SELECT dir FROM s)"""


def graph_edges(spark, sf_dir):
    """Typed edges between regions, nations, suppliers, customers and orders."""
    n, s, c, o = (load(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "orders"))
    edge = lambda df, a, b, kind, w, e: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"), F.lit(w).alias("weight"), e.alias("evidence"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return (
        edge(n, name("n", "n_nationkey"), name("r", "n_regionkey"), "same_directory", 0.35, F.col("n_name"))
        .unionByName(edge(s, name("s", "s_suppkey"), name("n", "s_nationkey"), "calls", 2.8, F.lit("supplier")))
        .unionByName(edge(c, name("c", "c_custkey"), name("n", "c_nationkey"), "renders", 1.9, F.col("c_mktsegment")))
        .unionByName(edge(o, name("o", "o_orderkey"), name("c", "o_custkey"), "imports", 0.4, F.col("o_orderpriority")))
    )


def graph_nodes(spark, sf_dir):
    n, s, c, o, r = (load(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "orders", "region"))
    node = lambda df, p, key, text: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("path"), F.col(text).alias("text"))
    return (
        node(n, "n", "n_nationkey", "n_name")
        .unionByName(node(s, "s", "s_suppkey", "s_name"))
        .unionByName(node(c, "c", "c_custkey", "c_mktsegment"))
        .unionByName(node(o, "o", "o_orderkey", "o_orderpriority"))
        .unionByName(node(r, "r", "r_regionkey", "r_name"))
    )


GRAPH_SQL = """raw AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'same_directory' AS edge_type, 0.35 AS weight, n_name AS evidence FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'calls', 2.8, 'supplier' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'renders', 1.9, c_mktsegment FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'imports', 0.4, o_orderpriority FROM orders),
both_ways AS (SELECT source, target, edge_type, CAST(weight AS DOUBLE) AS weight, evidence FROM raw UNION ALL SELECT target, source, 'reverse_' || edge_type, round(greatest(0.35, weight * 0.72), 6), evidence FROM raw),
edges AS (SELECT source, target, edge_type, substr(evidence, 1, 120) AS evidence, max(weight) AS weight FROM both_ways WHERE source <> target GROUP BY ALL)"""


def g7_add_edge(spark, sf_dir):
    return G.add_edges(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir))


def g9_graph_expand(spark, sf_dir):
    edges = g7_add_edge(spark, sf_dir)
    customers = load(spark, sf_dir, "customer")
    seeds = customers.select((F.col("c_custkey") % 40).alias("instance_id"), F.col("c_custkey").alias("pos"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"))
    terms = seeds.select("instance_id").distinct().withColumn("terms", F.array(F.lit("urgent"), F.lit("high"), F.lit("nation")))
    return G.expand(seeds, edges, G.node_tokens(graph_nodes(spark, sf_dir)), terms, 20)


G9_SQL = rf"""WITH {GRAPH_SQL},
sd AS (SELECT * FROM (SELECT c_custkey % 40 AS instance_id, 'c' || c_custkey AS seed, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) AS n FROM customer) WHERE n <= 16),
oe AS (SELECT source AS seed, target AS path, edge_type AS base, edge_type AS shown, weight FROM edges UNION ALL SELECT target, source, edge_type, 'incoming_' || edge_type, weight * 0.7 FROM edges),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, shown, path) AS n FROM oe) WHERE n <= 120),
txt AS (SELECT 'n' || n_nationkey AS path, n_name AS t FROM nation UNION ALL SELECT 'o' || o_orderkey, o_orderpriority FROM orders),
sc AS (SELECT sd.instance_id, f.path, max(weight + least(5.4, 0.45 * (CASE WHEN regexp_matches(lower(t), '(^|[^a-z])urgent') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(t), '(^|[^a-z])high') THEN 1 ELSE 0 END + CASE WHEN starts_with(lower(t), 'nation') AND NOT regexp_matches(lower(t), '^nation[_0-9.$-]') THEN 1 ELSE 0 END))
  + CASE WHEN base IN ('calls', 'renders', 'selects_state', 'type_flow', 'inherits_or_implements') THEN 0.4 ELSE 0 END) AS s
  FROM sd JOIN few f ON f.seed = sd.seed JOIN txt ON txt.path = f.path GROUP BY ALL)
SELECT * FROM (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY round(s, 6) DESC, path) AS rank, path, round(s, 6) AS score FROM sc) WHERE rank <= 20"""


def g11_k_hop(spark, sf_dir):
    seeds = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))
    return G.k_hop(seeds, graph_edges(spark, sf_dir), 3).groupBy("seed", "hop").agg(F.count("*").alias("n"), F.min("node").alias("first_node"))


G11_SQL = """SELECT 'r' || r_regionkey AS seed, hop, count(*) AS n, min(node) AS first_node FROM (
  SELECT r_regionkey, 0 AS hop, 'r' || r_regionkey AS node FROM region
  UNION ALL SELECT n_regionkey, 1, 'n' || n_nationkey FROM nation
  UNION ALL SELECT n_regionkey, 2, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 2, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 3, 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
GROUP BY r_regionkey, hop"""


def a11_edge_summary(spark, sf_dir):
    paths = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"))
    return G.edge_summary(g7_add_edge(spark, sf_dir), paths)


A11_SQL = f"""WITH {GRAPH_SQL}, p AS (SELECT 'c' || c_custkey AS path FROM customer)
SELECT edge_type, count(*) AS n FROM (SELECT edge_type FROM edges WHERE source IN (SELECT path FROM p) UNION ALL SELECT edge_type FROM edges WHERE target IN (SELECT path FROM p)) GROUP BY edge_type"""


def g10_edge_mode_filter(spark, sf_dir):
    modes = spark.createDataFrame([("call", "calls"), ("call", "reverse_calls"), ("concern", "imports")], "mode string, edge_type string")
    return G.mode_edges(g7_add_edge(spark, sf_dir), modes, "call")


QUERIES = {
    "e1_lines": (e1_lines, f"WITH {CODE_SQL} SELECT path, line_no, line FROM lines"),
    "e2_extract_entities": (e2_extract_entities, f"WITH {CODE_SQL}, {STARTS_SQL} SELECT * FROM starts"),
    "e3_brace_end_line": (e3_brace_end_line, f"WITH {ENTITIES_SQL} SELECT * FROM entities"),
    "e4_indent_end_line": (e4_indent_end_line, E4_SQL),
    "e5_mask_comments": (e5_mask_comments, f"WITH {CODE_SQL}, {MASK_SQL} SELECT * FROM masked"),
    "e7_enclosing_symbol": (e7_enclosing_symbol, E7_SQL),
    "e8_statements": (e8_statements, E8_SQL),
    "e9_calls": (e9_calls, f"WITH {CODE_SQL}, {CALLS_SQL} SELECT * FROM calls"),
    "e10_imports": (e10_imports, f"WITH {CODE_SQL}, {IMPORTS_SQL} SELECT * FROM imports"),
    "e11_resolve_import": (e11_resolve_import, E11_SQL),
    "e17_source_tree_summary": (e17_source_tree_summary, E17_SQL),
    "j3_symbol_targets": (j3_symbol_targets, J3_SQL),
    "j4_bounded_symbol": (j4_bounded_symbol, J4_SQL),
    "j12_def_use": (j12_def_use, J12_SQL),
    "g1_edges_siblings": (g1_edges_siblings, G1_SQL),
    "g7_add_edge": (g7_add_edge, f"WITH {GRAPH_SQL} SELECT * FROM edges"),
    "g9_graph_expand": (g9_graph_expand, G9_SQL),
    "g10_edge_mode_filter": (g10_edge_mode_filter, f"WITH {GRAPH_SQL} SELECT * FROM edges WHERE edge_type IN ('calls', 'reverse_calls')"),
    "g11_k_hop": (g11_k_hop, G11_SQL),
    "a11_edge_summary": (a11_edge_summary, A11_SQL),
}
