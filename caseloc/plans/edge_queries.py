"""Edges between generated web files: a component for each customer, a style
sheet for each nation, a reducer for each supplier, settings and a document for
each region."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import kept
from ..operators import edges as X
from ..operators import graph as G
from .views import load


def web_files(spark, sf_dir):
    c, n, s, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "supplier", "region"))
    say = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    key, nation, region = F.col("c_custkey"), F.col("c_nationkey"), F.col("n_regionkey")
    ui = c.select(say("src/ui/View", key, ".jsx").alias("path"), say('<div className="box-n', nation, " card-", key % 5, "\" />;\nload('LOAD_N", nation, "_", key % 60, "');").alias("text"))
    css = n.select(say("src/style/n", F.col("n_nationkey"), ".css").alias("path"), say(".box-n", F.col("n_nationkey"), " {}\n#card-", F.col("n_nationkey") % 5, " {}").alias("text"))
    red = s.select(say("src/reducers/s", F.col("s_suppkey"), ".js").alias("path"), say("case LOAD_N", F.col("s_nationkey"), "_", F.col("s_suppkey") % 60, ":").alias("text"))
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit('"box-n'), k.cast("string"), F.lit('": 1, "name": 2'))), ", ")
    config = n.groupBy("n_regionkey").agg(keys.alias("k")).select(say("config/r", region, ".json").alias("path"), say("{", F.col("k"), "}").alias("text"))
    docs = r.select(say("docs/guide", F.col("r_regionkey"), ".md").alias("path"), say("See View", F.col("r_regionkey") + 10, ".jsx and n", F.col("r_regionkey"), " or VIEW7.").alias("text"))
    return kept(ui.unionByName(css).unionByName(red).unionByName(config).unionByName(docs), "web")


WEB_SQL = """web AS (SELECT 'src/ui/View' || c_custkey || '.jsx' AS path, '<div className="box-n' || c_nationkey || ' card-' || c_custkey % 5 || '" />;' || chr(10) || 'load(''LOAD_N' || c_nationkey || '_' || c_custkey % 60 || ''');' AS text FROM customer
  UNION ALL SELECT 'src/style/n' || n_nationkey || '.css', '.box-n' || n_nationkey || ' {}' || chr(10) || '#card-' || n_nationkey % 5 || ' {}' FROM nation
  UNION ALL SELECT 'src/reducers/s' || s_suppkey || '.js', 'case LOAD_N' || s_nationkey || '_' || s_suppkey % 60 || ':' FROM supplier
  UNION ALL SELECT 'config/r' || n_regionkey || '.json', '{' || string_agg('"box-n' || n_nationkey || '": 1, "name": 2', ', ' ORDER BY n_nationkey) || '}' FROM nation GROUP BY n_regionkey
  UNION ALL SELECT 'docs/guide' || r_regionkey || '.md', 'See View' || (r_regionkey + 10) || '.jsx and n' || r_regionkey || ' or VIEW7.' FROM region)"""
STYLES_SQL = """styles AS (SELECT DISTINCT 'src/ui/View' || c_custkey || '.jsx' AS source, 'src/style/n' || n_nationkey || '.css' AS target, 'box-n' || n_nationkey AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'src/ui/View' || c_custkey || '.jsx', 'src/style/n' || n_nationkey || '.css', 'card-' || n_nationkey % 5 FROM customer JOIN nation ON c_custkey % 5 = n_nationkey % 5)"""
CONFIG_SQL = """configs AS (SELECT source, target, name FROM (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY target) AS k FROM (
  SELECT 'config/r' || n_regionkey || '.json' AS source, w.path AS target, 'box-n' || n_nationkey AS name FROM nation JOIN web w ON contains(lower(w.path || chr(10) || w.text), 'box-n' || n_nationkey)
  WHERE w.path <> 'config/r' || n_regionkey || '.json')) WHERE k <= 16)"""
DOCS_SQL = r"""docs AS (SELECT d.path AS source, w.path AS target, regexp_extract(w.path, '([^/]*)$', 1) AS name FROM web d, web w WHERE ends_with(d.path, '.md') AND d.path <> w.path
  AND contains(d.text, regexp_replace(regexp_extract(w.path, '([^/]*)$', 1), '\.[^.]*$', '')))"""
CONSTANTS_SQL = r"""held AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '\b([A-Z][A-Z0-9_]{5,})\b', 1)) AS name FROM web WHERE regexp_matches(path, '\.(js|jsx)$')),
few AS (SELECT name FROM held GROUP BY name HAVING count(*) BETWEEN 2 AND 12 AND bool_or(contains(path, 'reducer'))),
consts AS (SELECT a.path AS source, b.path AS target, name FROM held a JOIN held b USING (name) JOIN few USING (name) WHERE a.path <> b.path)"""


def j17_class_style(spark, sf_dir):
    return X.class_styles(web_files(spark, sf_dir))


def j18_config_mentions(spark, sf_dir):
    return X.config_mentions(web_files(spark, sf_dir))


def j19_doc_mentions(spark, sf_dir):
    return X.doc_mentions(web_files(spark, sf_dir))


def g3_action_constants(spark, sf_dir):
    return X.action_constants(web_files(spark, sf_dir))


def g6_style_config_doc(spark, sf_dir):
    files = web_files(spark, sf_dir)
    return G.add_edges(X.style_config_doc_edges(files), files)


G6_SQL = f"""WITH {WEB_SQL}, {STYLES_SQL}, {CONFIG_SQL}, {DOCS_SQL},
raw AS (SELECT source, target, 'styles' AS edge_type, 2.5 AS weight, 'className ' || name AS evidence FROM styles UNION ALL SELECT source, target, 'configures', 1.4, 'config key/package ' || name FROM configs
  UNION ALL SELECT source, target, 'documents', 1.1, 'doc references ' || name FROM docs)
SELECT source, target, edge_type, max(weight) AS weight, evidence FROM (SELECT * FROM raw UNION ALL SELECT target, source, 'reverse_' || edge_type, round(greatest(0.35, weight * 0.72), 6), evidence FROM raw) GROUP BY ALL"""

QUERIES = {
    "j17_class_style": (j17_class_style, f"WITH {STYLES_SQL} SELECT DISTINCT * FROM styles"),
    "j18_config_mentions": (j18_config_mentions, f"WITH {WEB_SQL}, {CONFIG_SQL} SELECT * FROM configs"),
    "j19_doc_mentions": (j19_doc_mentions, f"WITH {WEB_SQL}, {DOCS_SQL} SELECT DISTINCT * FROM docs"),
    "g3_action_constants": (g3_action_constants, f"WITH {WEB_SQL}, {CONSTANTS_SQL} SELECT * FROM consts"),
    "g6_style_config_doc": (g6_style_config_doc, G6_SQL),
}
