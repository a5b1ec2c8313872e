"""Links to reproductions: each customer has one, in one of eight forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import dealt
from ..operators import reproduction as R
from .views import load, sql_list


def _links(spark, sf_dir):
    return dealt(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey AS id", f"{_URL.format(base64='base64(encode({}, ' + chr(39) + 'utf-8' + chr(39) + '))').replace('{}', _CODE)} AS url")


_CODE = """'import { a' || c_custkey || ' } from "lib' || c_custkey % 9 || '"; const onLeave' || c_custkey || ' = legendOption?x:y;'"""
_SAFE = "translate({base64}, '+/=' || chr(13) || chr(10), '-_')"
_URL = f"""CASE c_custkey % 8 WHEN 0 THEN 'https://www.typescriptlang.org/play?ts=5.' || c_custkey || '&code=' || {_SAFE}
  WHEN 1 THEN 'https://codesandbox.io/s/demo-' || c_custkey || '?file=%2Fsrc%2FApp' || c_custkey || '.js'
  WHEN 2 THEN 'https://prettier.io/playground?parser=babel&tabWidth=' || c_custkey % 5 || '&input=let+x%20%3D+' || c_custkey
  WHEN 3 THEN 'https://mypy-play.net/?mypy=latest&python=3.1&flags=strict&python=3.' || c_custkey % 14 || '&gist=' || c_custkey
  WHEN 4 THEN 'https://www.chartjs.org/docs/latest/samples/legend_' || c_custkey || '/events.html'
  WHEN 5 THEN 'https://stackblitz.com/edit/x' || c_custkey || '#state=' || {_SAFE} || '&css=my%20style'
  WHEN 6 THEN 'https://play.example.org/a?bad=%zz&code=AAAAAAAAAAAA' || c_custkey || '&empty=&flag'
  ELSE 'https://' || c_custkey || '.csb.app/?code=caf%C3%A9' END"""


def p12_parse_reproduction(spark, sf_dir):
    got = R.reproductions(_links(spark, sf_dir))
    flat = lambda c: F.array_join(c, "|")
    return got.select(
        "id", "platform", flat("fields").alias("fields"), F.array_join(F.transform(F.array_sort(F.map_entries("config")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("config"),
        flat(F.transform("snippets", lambda s: F.concat_ws("=", s["field"], s["encoding"], s["value"]))).alias("snippets"), flat("layers").alias("layers"), flat("queries").alias("queries"),
        F.coalesce("sandbox_id", F.lit("")).alias("sandbox_id"), "needs_browser",
    )


def p13_code_features(spark, sf_dir):
    got = R.reproductions(_links(spark, sf_dir))
    return got.select("id", *[F.array_join(c, "|").alias(c) for c in ("imports", "symbols", "event_terms", "option_terms")])


# What each form must give, told form by form.
_K = "c_custkey"
_RUNTIME = "|".join(R.LAYERS["stackblitz"])
_SNIPPET = f"{_CODE}"
_NAMES = f"'lib' || {_K} % 9"
P12_SQL = f"""WITH f AS (SELECT *, {_CODE} AS code FROM customer)
SELECT {_K} AS id,
  CASE {_K} % 8 WHEN 0 THEN 'typescript_playground' WHEN 1 THEN 'codesandbox' WHEN 2 THEN 'prettier_playground' WHEN 3 THEN 'mypy_play' WHEN 4 THEN 'chartjs_docs_sample' WHEN 5 THEN 'stackblitz' ELSE 'generic_playground' END AS platform,
  CASE {_K} % 8 WHEN 0 THEN 'code|ts' WHEN 1 THEN 'file' WHEN 2 THEN 'input|parser|tabWidth' WHEN 3 THEN 'flags|gist|mypy|python' WHEN 4 THEN '' WHEN 5 THEN 'fragment.css|fragment.state' WHEN 6 THEN 'bad|code|empty|flag' ELSE 'code' END AS fields,
  CASE {_K} % 8 WHEN 2 THEN 'parser=babel|tabWidth=' || {_K} % 5 WHEN 3 THEN 'flags=strict|mypy=latest|python=3.' || {_K} % 14 ELSE '' END AS config,
  CASE {_K} % 8 WHEN 0 THEN 'ts=plain-or-urlencoded=5.' || {_K} || '|code=base64-url=' || code WHEN 2 THEN 'input=plain-or-urlencoded=let x = ' || {_K} WHEN 3 THEN 'python=plain-or-urlencoded=3.' || {_K} % 14 || '|gist=plain-or-urlencoded=' || {_K}
    WHEN 5 THEN 'fragment.state=base64-url=' || code WHEN 6 THEN 'code=plain-or-urlencoded=AAAAAAAAAAAA' || {_K} WHEN 7 THEN 'code=plain-or-urlencoded=café' ELSE '' END AS snippets,
  CASE {_K} % 8 WHEN 0 THEN '{"|".join(R.LAYERS["babel_repl"])}' WHEN 1 THEN '{_RUNTIME}' WHEN 2 THEN '{"|".join(R.LAYERS["prettier_playground"])}' WHEN 3 THEN '{"|".join(R.LAYERS["mypy_play"])}' WHEN 4 THEN '{"|".join(R.LAYERS["chartjs_docs_sample"])}'
    WHEN 5 THEN '{_RUNTIME}|style_pipeline' ELSE '' END AS layers,
  array_to_string(list_filter(list_distinct_ordered, lambda x: x <> ''), '|') AS queries,
  CASE {_K} % 8 WHEN 1 THEN '' || {_K} WHEN 7 THEN '' || {_K} ELSE '' END AS sandbox_id, {_K} % 8 = 1 AS needs_browser
FROM (SELECT *, CASE {_K} % 8
  WHEN 0 THEN ['5.' || {_K}, left(code, 160), 'play', 'code', {_NAMES}, 'onLeave' || {_K}, 'legendOption']
  WHEN 1 THEN ['codesandbox file /src/App' || {_K} || '.js', 'demo', 'file']
  WHEN 2 THEN ['prettier_playground parser babel', 'let x = ' || {_K}, 'playground', 'parser', 'tabWidth', 'input']
  WHEN 3 THEN ['mypy_play flags strict', 'mypy_play python 3.' || {_K} % 14, 'mypy_play mypy latest', '3.' || {_K} % 14, '' || {_K}, 'mypy', 'python', 'flags', 'gist']
  WHEN 4 THEN ['chartjs_docs_sample docs latest samples legend_' || {_K} || ' events.html', 'docs', 'latest', 'samples', 'legend', 'events', 'html']
  WHEN 5 THEN [left(code, 160), 'edit', CASE WHEN {_K} >= 10 THEN 'x' || {_K} ELSE '' END, 'state', 'css', {_NAMES}, 'onLeave' || {_K}, 'legendOption']
  WHEN 6 THEN ['AAAAAAAAAAAA' || {_K}, 'bad', 'code', 'empty', 'flag'] ELSE ['café', 'code'] END AS list_distinct_ordered FROM f) f"""
P13_SQL = f"""SELECT {_K} AS id, CASE WHEN {_K} % 8 IN (0, 5) THEN {_NAMES} ELSE '' END AS imports,
  CASE {_K} % 8 WHEN 0 THEN CASE WHEN {_K} >= 10 THEN 'a' || {_K} || '|' ELSE '' END || 'lib' || {_K} % 9 || '|onLeave' || {_K} || '|legendOption' WHEN 5 THEN CASE WHEN {_K} >= 10 THEN 'a' || {_K} || '|' ELSE '' END || 'lib' || {_K} % 9 || '|onLeave' || {_K} || '|legendOption'
    WHEN 6 THEN 'AAAAAAAAAAAA' || {_K} ELSE '' END AS symbols,
  CASE WHEN {_K} % 8 IN (0, 5) THEN 'onLeave' || {_K} ELSE '' END AS event_terms, CASE WHEN {_K} % 8 IN (0, 5) THEN 'legendOption' ELSE '' END AS option_terms FROM customer"""

QUERIES = {
    "p12_parse_reproduction": (p12_parse_reproduction, P12_SQL),
    "p13_code_features": (p13_code_features, P13_SQL),
}
