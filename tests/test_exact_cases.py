"""Small cases with answers that follow by hand."""

import pytest
from pyspark.sql import functions as F

from caseloc.functions import text as T
from caseloc.operators import code, graph, metrics, policy, search


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("given, want", [("legend", ["legend", "legend"]), ("onLeave", ["onleave", "on", "leave"]), ("a.b", ["a.b", "a.b"])])
def test_tokens(spark, given, want):
    assert value(spark, T.tokens(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [("./src\\a.py", "src/a.py"), ("../a", "a"), (".github/x", "github/x")])
def test_paths(spark, given, want):
    assert value(spark, T.normalize_path(F.lit(given))) == want


def test_resolved_dots(spark):
    assert value(spark, T.resolve_dots(F.lit("a/./b/../c//d"))) == "a/c/d"


def test_plain_word_weighs_one_and_a_quarter(spark):
    q = spark.createDataFrame([("q", "legend")], "query_id string, query string")
    assert [r.weight for r in search.query_tokens(q).collect()] == [1.25]


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([("a", 1, "other"), ("a", 2, "fix"), ("b", 1, "x")], "instance_id string, rank int, item string")
    gold = spark.createDataFrame([("a", "./fix")], "instance_id string, item string")
    rows = {r.instance_id: r for r in metrics.rank_metrics(ranked.select("instance_id"), ranked, gold).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["acc@1"], a["acc@2"], a["strict_acc@2"], a["mrr@15"], a["map@15"]) == (0, 1, 1, 0.5, 0.5)
    assert b["pred_count"] == 1 and all(b[c] == 0 for c in b.asDict() if c not in ("instance_id", "pred_count"))
    accs = [a[f"acc@{k}"] for k in metrics.KS]
    assert accs == sorted(accs) and all(a[f"strict_acc@{k}"] <= a[f"acc@{k}"] for k in metrics.KS)


def test_failures_count_as_zero_rows(spark):
    attempts = spark.createDataFrame(
        [(1, "x", "partial", 12.5), (2, "x", "error", 7.5), (3, "y", "partial", 1.0), (4, "y", "ok", 2.0), (5, None, "ok", 1.0)],
        "seq long, instance_id string, status string, elapsed_seconds double",
    )
    latest = {r.instance_id: (r.seq, r.status) for r in metrics.latest_attempt(attempts).collect()}
    assert latest == {"x": (2, "error"), "y": (4, "ok"), None: (5, "ok")}
    assert metrics.status_counts(attempts).first().elapsed_seconds == 24.0


def test_patch_to_gold(spark):
    patch = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -3,3 +3,3 @@\n def foo(self):\n-    return 1\n+    return 2\n"
    css = "--- a/src/style.css\n+++ b/src/style.css\n@@ -1 +1 @@\n-a\n+b\n"
    lines = metrics.changed_lines(spark.createDataFrame([("i", patch), ("c", css)], "instance_id string, patch string"))
    assert {tuple(r) for r in lines.collect()} == {("i", "src/a.py", 4), ("c", "src/style.css", 1)}
    entities = spark.createDataFrame(
        [("src/a.py", "class", "Bar", 2, 5), ("src/a.py", "function", "foo", 3, 5)], "path string, kind string, name string, start_line int, end_line int"
    )
    gold = {tuple(r) for r in metrics.gold_sets(lines, entities).collect()}
    assert gold == {
        ("i", "file", "src/a.py"), ("i", "module", "src/a.py::class:Bar"), ("i", "function", "src/a.py::function:foo"),
        ("c", "file", "src/style.css"), ("c", "module", "src/style.css::module:__file__"),
    }


def test_channel_fusion_bounds_scores(spark):
    hits = spark.createDataFrame([("i", "all", "big", 10_000.0), ("i", "architecture", "small", 80.0)], "instance_id string, channel string, item string, score double")
    assert {r.item: r.score for r in search.channel_fusion(hits).collect()} == {"big": 25.2, "small": 18.8}


def test_architecture_cap(spark):
    rows = [("i", "a", "architecture_path_probe", 80.0), ("i", "b", "architecture_path_probe", 80.0), ("i", "b", "symbol_score", 20.0)]
    got = {r.path: (r.kept, r.removed) for r in policy.architecture_lane(spark.createDataFrame(rows, "instance_id string, path string, component string, score double")).collect()}
    assert got == {"a": (6.0, 74.0), "b": (24.0, 56.0)}


def test_beam_keeps_lane_leaders(spark):
    rows = [("i", "lexical", f"f{k:02d}", 1000.0 - k) for k in range(20)] + [("i", "symbol", "s1", 40.0), ("i", "flow", "s2", 35.0)]
    hits = spark.createDataFrame(rows, "instance_id string, channel string, item string, score double")
    kept = {r.item for r in search.beam_prune(hits, {"symbol": 2, "flow": 2}, 10).collect()}
    assert {"s1", "s2"} <= kept and len(kept) == 10


def test_memory_bonus(spark):
    assert value(spark, policy.memory_bonus(F.lit(0), F.lit(1), F.lit(0), F.lit("implementation"))) == 24.0


def test_reverse_edges(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    raw = spark.createDataFrame([("a", "b", "calls", 1.0, "x"), ("b", "a", "renders", 0.4, "y"), ("a", "a", "calls", 1.0, "z"), ("a", "gone", "calls", 1.0, "z")], "source string, target string, edge_type string, weight double, evidence string")
    got = {(r.edge_type, r.weight) for r in graph.add_edges(raw, files).collect()}
    assert got == {("calls", 1.0), ("reverse_calls", 0.72), ("renders", 0.4), ("reverse_renders", 0.35)}


def test_generic_call_gives_no_edge(spark):
    calls = spark.createDataFrame([("app/main.js", 1, "update"), ("app/main.js", 2, "special")], "path string, line_no int, callee string")
    symbols = spark.createDataFrame([("update", "src/view.js"), ("special", "src/view.js")], "name string, path string")
    assert [(r.name, r.target) for r in graph.bounded_targets(calls, symbols).collect()] == [("special", "src/view.js")]


def test_expansion_prefers_the_relevant_neighbour(spark):
    edges = [("entry.js", "target.js", "imports", 1.9, "")] + [("entry.js", f"noise{i}.js", "imports", 1.9, "") for i in range(80)]
    e = spark.createDataFrame(edges, "source string, target string, edge_type string, weight double, evidence string")
    nodes = graph.node_tokens(spark.createDataFrame([(t, "legend plugin" if t == "target.js" else "other") for _, t, *_ in edges], "path string, text string"))
    seeds = spark.createDataFrame([("i", 0, "entry.js")], "instance_id string, pos int, path string")
    terms = spark.createDataFrame([("i", ["legend", "plugin"])], "instance_id string, terms array<string>")
    rows = graph.expand(seeds, e, nodes, terms, 5).orderBy("rank").collect()
    assert rows[0].path == "target.js" and len(rows) == 5


def test_comments_and_blocks(spark):
    text = 'const a = "// not";  // gone\n/* open {\n still {\n*/ function f() {\n  if (x) { y(); }\n}\nclass K {\n}'
    files = spark.createDataFrame([("a.js", text)], "path string, text string")
    rows = code.mask_comments(code.lines(files))
    assert [r.line.rstrip() for r in rows.orderBy("line_no").collect()][:4] == ['const a = "// not";', "", "", " function f() {"]
    got = {(r.name, r.start_line, r.end_line) for r in code.brace_entities(code.entity_starts(rows), rows).collect()}
    assert {("f", 4, 6), ("K", 7, 8)} <= got


def test_edit_set_covers_with_few_files(spark):
    covers = spark.createDataFrame([("i", "a", "x"), ("i", "a", "y"), ("i", "b", "y"), ("i", "c", "z")], "instance_id string, path string, obligation string")
    scores = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 9.0), ("i", "c", 0.1)], "instance_id string, path string, score double")
    assert {r.path for r in policy.minimal_edit_set(covers, scores).collect()} == {"a", "c"}


def test_requests_for_other_files_have_ascii_words(spark):
    import duckdb

    from caseloc.plans.policy_queries import _ALLOW

    texts = ["fix the tests", "éfix the tests", "fix the testsé", "prefix the tests", "docs\x0bbug", "docs bug", "the docs\x0bare wrong", "docs are\twrong", "fixé tests", "Fix ü tests", "fix_ tests"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", policy.allows_non_source(F.col("t")).alias("a")).collect()
    con = duckdb.connect()
    want = {t: con.execute(f"SELECT {_ALLOW} FROM (SELECT lower(?) AS it)", [t]).fetchall()[0][0] for t in texts}
    assert {r.t: r.a for r in rows} == want and want["éfix the tests"]
