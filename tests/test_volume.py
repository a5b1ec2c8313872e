"""What jobs move: shuffles in plans that have run (first and last form), on small tables."""

from caseloc.operators import code


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_definitions_and_uses_meet_in_few_shuffles(spark):
    rows = [("a", 1, "x", "x = y"), ("a", 2, "", "x + x"), ("b", 1, "y", "y = x"), ("c", 1, "z", "x = 1")]
    found = code.def_use(spark.createDataFrame(rows, "path string, line_no int, defined string, code string"), per_def=2)
    got = sorted(tuple(r)[:5] for r in found.collect())
    assert got == [("x", "a", 1, "a", 2), ("x", "a", 1, "b", 1), ("y", "b", 1, "a", 1)]
    assert shuffles(found) <= 4


def test_terms_meet_files_without_postings(spark):
    from caseloc.operators import search

    files = spark.createDataFrame([("a", "xp50 P501 p5"), ("b", "q50q50, p50p50p50"), ("c", None), ("d", "")], "path string, text string")
    wanted = spark.createDataFrame([("p50",), ("q50",), ("p501",), ("aa",)], "token string")
    found = search.file_counts(wanted, files)
    rows = sorted(map(tuple, found.collect()))
    assert rows == [("p50", "a", 2), ("p50", "b", 3), ("p501", "a", 1), ("q50", "b", 2)]
    assert rows == sorted(map(tuple, search.token_counts(wanted, search.postings(files)).collect()))
    assert shuffles(found) <= 4


def test_many_beginnings_are_not_listed_in_the_plan(spark):
    from caseloc.operators import search

    wanted = spark.range(10_000, 12_500).selectExpr("concat('k', id) AS token")
    runs = wanted.selectExpr("concat('x', token, '_') AS run")
    found = search.token_runs(wanted, runs.union(spark.createDataFrame([("zz9",)], "run string")))
    assert found.count() == 2_500
    many = spark.range(0, 5_000).selectExpr("concat(substring(hex(id + 65536), 2), 'z') AS token").selectExpr("lower(token) AS token")
    plan = search.token_runs(many, many.selectExpr("concat('y', token) AS run"))
    listed = plan._jdf.queryExecution().analyzed().toString()
    assert plan.count() == 5_000 and "00a1" not in listed


def test_files_are_masked_and_read_without_a_shuffle(spark):
    texts = {"a.js": "class A { /* x\nclass B {\n*/ class C {\nfunction f(x) { // class D\n}", "b.py": "def g():\n  class H:", "c.js": None, "d.js": "  if (x) {\n  run(x) {\n/* a */ /* b\nc\n*/ z */ (y) /*\n", "e.js": ""}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    masked = code.masked_lines(files)
    rows = sorted(map(tuple, masked.collect()))
    assert rows == sorted(map(tuple, code.mask_comments(code.lines(files)).collect())) and len(rows) == 14
    found = code.declarations(masked)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, code.entity_starts(code.mask_comments(code.lines(files))).collect()))
    assert got == [("a.js", "class", "A", 1), ("a.js", "class", "C", 3), ("a.js", "function", "f", 4), ("b.py", "class", "H", 2), ("b.py", "function", "g", 1), ("d.js", "method", "run", 2)]
    assert shuffles(found) == 0 and "Sort" not in found._jdf.queryExecution().executedPlan().toString()


def test_entities_and_masks_of_files_are_not_shuffled_again(spark):
    from caseloc.plans import code_queries

    data = "/root/testdata/sf0.001"
    source = shuffles(code_queries.code_files(spark, data))
    assert source == shuffles(code_queries.e2_extract_entities(spark, data)) == shuffles(code_queries.e5_mask_comments(spark, data))


def test_calls_meet_targets_with_one_shuffle_of_names(spark):
    from caseloc.operators import graph

    calls = [("a/x.js", "one"), ("a/x.js", "one"), ("a/y.js", "pair"), ("b/z.js", "pair"), ("a/x.js", "many"), ("a/y.js", "own"), ("far/w.js", "gone")]
    calls += [("lib/one/c.js", "word"), ("own/one.js", "self"), ("a/x.js", "near")]
    symbols = [("one", "b/z.js"), ("pair", "a/y.js"), ("pair", "b/q.js"), ("own", "a/y.js"), ("self", "own/one.js"), ("self", "own/two.js"), ("self", "x/own/three.js")]
    symbols += [("many", f"d{i}/m.js") for i in range(9)] + [("near", "a/1.js"), ("near", "a/2.js"), ("near", "b/3.js")] + [("word", f"p{i}/one/{i}.js") for i in range(2)] + [("word", f"p{i}/two/{i}.js") for i in range(9)]
    c, s = spark.createDataFrame(calls, "path string, callee string"), spark.createDataFrame(symbols, "name string, path string")
    found = graph.bounded_targets(c, s)
    u, n, p = "unique_symbol", "same_directory_symbol", "path_related_symbol"
    assert sorted(map(tuple, found.collect())) == [
        ("a/x.js", "near", "a/1.js", n), ("a/x.js", "near", "a/2.js", n), ("a/x.js", "one", "b/z.js", u), ("a/y.js", "pair", "b/q.js", u), ("b/z.js", "pair", "b/q.js", n),
        ("lib/one/c.js", "word", "p0/one/0.js", p), ("lib/one/c.js", "word", "p1/one/1.js", p), ("own/one.js", "self", "own/two.js", n),
    ]
    assert shuffles(found) <= 12
    counts = graph.symbol_target_counts(c, s)
    got = {(r.source, r.name): (r.targets, r.first) for r in counts.collect()}
    assert got[("a/y.js", "pair")] == (1, "b/q.js") and got[("b/z.js", "pair")] == (2, "a/y.js") and got[("own/one.js", "self")] == (2, "own/two.js") and ("a/y.js", "own") not in got
    assert len(got) == 7 and shuffles(counts) <= 8


def test_ends_of_entities_move_texts_alone(spark):
    from pyspark.sql import functions as F

    texts = {"a.js": "class A {\n  run(x) { /* {\n*/ if (x) {\n    y();\n  } }\n}\nfunction f(q) {\n  return q; }\nfunction g(q)\n{\n  return 1\n}\nclass B { }\nfunction h(z) {", "b.py": "class H:\n\n  def g():\n    return 1\n  x = 1\ndef k():\n  return 2\n\n", "c.js": None, "e.js": ""}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    rows, masked = code.lines(files), code.masked_lines(files)
    plain = lambda df: sorted(map(tuple, df.collect()))
    found = code.braced_entities(files)
    got = plain(found)
    assert got == plain(code.brace_entities(code.entity_starts(masked), masked)) and ("a.js", "class", "A", 1, 6) in got and ("a.js", "function", "g", 9, 12) in got and len(got) == 9
    indented = code.indented_entities(files)
    assert plain(indented) == plain(code.indent_entities(code.entity_starts(rows), rows)) and ("b.py", "class", "H", 1, 5) in plain(indented)
    around = code.enclosing_declaration(files, F.col("line").contains("return"), ("class", "function"))
    wanted = rows.where(F.col("line").contains("return")).select("path", F.col("line_no").alias("line"))
    assert plain(around) == plain(code.enclosing_symbol(wanted, code.entity_starts(rows).where("kind <> 'method'"))) and len(plain(around)) == 4
    assert [shuffles(x) for x in (found, indented, around)] == [2, 2, 2]  # one each, in both forms


def test_imports_make_no_row_for_each_suffix(spark):
    files = spark.createDataFrame([("a/x.js",), ("a/x.ts",), ("a/y/index.js",), ("a/z",), ("b/.js",)], "path string")
    found = spark.createDataFrame([("a/m.js", "./x"), ("a/m.js", "./x.ts"), ("b/n.js", "../a/y"), ("a/m.js", "./z"), ("a/m.js", "z"), ("a/m.js", "./gone")], "path string, ref string")
    hit = code.resolve_imports(found, files)
    assert sorted(map(tuple, hit.collect())) == [("a/m.js", "./x", "a/x.js"), ("a/m.js", "./x.ts", "a/x.ts"), ("a/m.js", "./z", "a/z"), ("b/n.js", "../a/y", "a/y/index.js")]
    assert "struct<target:string,prio:int>" not in hit._jdf.queryExecution().analyzed().toString() and "endswith" in hit._jdf.queryExecution().analyzed().toString().lower()


def test_patches_are_sorted_once(spark):
    from caseloc.operators import metrics

    patch = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +5,4 @@ f\n same\n-old\n+new\n+more\n\\ No newline\n@@ -9 +20 @@\n-gone\n+++ b/y.py\n@@ -1 +0,0 @@\n-all\ndiff --git\n+after"
    found = metrics.changed_lines(spark.createDataFrame([(1, patch), (2, None), (3, "+x\n@@ -1 +3 @@\n+y")], "instance_id int, patch string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "x.py", 20), (1, "x.py", 6), (1, "x.py", 7), (1, "y.py", 1), (3, None, 3)]


def test_a_report_is_read_once_for_all_its_paths(spark):
    from caseloc.operators import rounds

    rows = spark.createDataFrame([(1, 1, 1, "src/legend", True), (1, 1, 2, "src/b.py", False)], "instance_id int, round_no int, rank int, path string, direct boolean")
    flags = spark.createDataFrame([(1, "src/legend", True, False, False, "unlikely", 0.7)], "instance_id int, path string, read boolean, grounded boolean, mechanism boolean, role string, confidence double")
    issues = spark.createDataFrame([(1, "the Legend%20fails"), (2, "x")], "instance_id int, issue_text string")
    found = rounds.frontier_quality(rows, rows.where("rank = 2").select("instance_id", "rank", "path"), flags, issues)
    assert {r.path: (r.quality, r.strong) for r in found.collect()} == {"src/legend": (14.733333, True), "src/b.py": (10.9, False)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "issue_text" not in plan.split("LeftOuter")[0] and "words" in plan.split("LeftOuter")[0]


def test_searches_leave_texts_whole_and_give_the_rows_of_the_joins(spark, monkeypatch):
    from caseloc.operators import search, tops

    words = ["alpha", "Beta_gamma", "getUser", "x1.y2", "de", "l'été"]
    texts = [" ".join(words[(i * k) % 6] * (1 + i % 3) for k in range(i % 7)) + (" whole Alpha getuser text" if i % 4 == 0 else "") for i in range(60)]
    files = spark.createDataFrame([(f"src/{words[i % 6]}/{i}.py", t) for i, t in enumerate(texts)] + [("src/none.py", None)], "path string, text string")
    entities = files.selectExpr("substring(path, 1, 9) AS path", "substring(coalesce(text, ''), 1, 6) AS name", "text")
    asked = [(1, "alpha getUser"), (1, "Whole alpha getUser text"), (2, "Beta_gamma x1.y2 beta_gamma"), (3, "12"), (4, "alpha getUser"), (4, "Whole alpha getUser text"), (5, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    plain = lambda df: sorted(map(str, df.collect()))
    found, held = search.search_and_hold(queries, files, 5)
    assert shuffles(search.search_files(queries, files, 5)) <= 4
    got = [plain(x) for x in (found, held, search.search_files(queries, files, 5), search.search_entities(queries, entities, 5))]
    assert got[0] == got[2] and len(got[0]) == 15 and len(got[1]) == 66
    monkeypatch.setattr(tops, "HELD", 0)
    assert got[2:] == [plain(search.search_files(queries, files, 5)), plain(search.search_entities(queries, entities, 5))]
    monkeypatch.setattr(tops, "CELLS", 0)
    joined, whole = search.search_and_hold(queries, files, 5)
    assert got == [plain(joined), plain(whole), plain(search.search_files(queries, files, 5)), plain(search.search_entities(queries, entities, 5))]


def test_texts_of_pools_are_lowered_once(spark):
    from caseloc.operators import search

    files = spark.createDataFrame([("a.py", "Legend legend"), ("b.py", "no"), ("c.py", None)], "path string, text string")
    queries = spark.createDataFrame([(1, "Legend shows"), (2, "legend")], "query_id int, query string")
    pool = spark.createDataFrame([(1, "a.py"), (1, "b.py"), (2, "gone.py")], "query_id int, path string")
    found = search.scoped_search_files(queries, pool, files)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a.py", 2.0), (2, 1, "a.py", 7.5)]
    named = search.scoped_search_entities(queries, pool, files.selectExpr("path", "'Legend' AS name", "text"))
    for df in (found, named):
        assert "lower(substring(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_entities_of_a_symbol_are_picked_before_queries_meet_them(spark):
    from caseloc.operators import search

    symbols = spark.createDataFrame([(1, "Foo"), (2, "foo"), (2, "gone")], "query_id int, symbol string")
    found = search.exact_symbol_lane(symbols, spark.createDataFrame([("c", "foo"), ("a", "FOO"), ("b", "foo"), ("d", "bar")], "path string, name string"), 2)
    assert sorted(map(tuple, found.collect())) == [(q, "foo", p, n) for q in (1, 2) for p, n in (("a", "FOO"), ("b", "foo"))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_links_and_results_are_dealt_out_before_they_are_parsed(spark):
    from caseloc.plans import reproduction_queries, review_queries

    for df in (reproduction_queries._links(spark, "/root/testdata/sf0.001"), review_queries._results(spark, "/root/testdata/sf0.001")):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_take_little_room(spark):
    from caseloc.functions.session import kept

    rows = spark.createDataFrame([(1, "a" * 50)], "id int, text string")
    table = kept(rows, "room")
    assert table.collect() == rows.collect() and all(f.endswith(".zstd.parquet") for f in table.inputFiles())


def test_all_entities_of_a_symbol_are_given(spark):
    from caseloc.operators import search

    symbols = spark.createDataFrame([(1, "FOO"), (1, "foo"), (2, "Foo"), (2, "gone")], "query_id int, symbol string")
    entities = spark.createDataFrame([(f"p{i}", "foo" if i % 2 else "Foo") for i in range(9)] + [("q", "bar")], "path string, name string")
    found = search.exact_symbol_lane(symbols, entities)
    assert sorted(map(tuple, found.collect())) == [(q, "foo", f"p{i}", "foo" if i % 2 else "Foo") for q in (1, 2) for i in range(9)]


def test_a_text_is_looked_at_once_for_all_its_names(spark):
    from caseloc.operators import pages

    texts = {1: "`SelectorCache`", 2: "(Rename)", 3: "see foo_bar and parse_all( or onLeave, fooo $ (", 4: "lowercase", 5: "short", 6: "load(", 7: "Title case", 8: "((x_yz))((", 9: "", 10: None}
    queries = spark.createDataFrame([(i, 0, t) for i, t in texts.items()], "instance_id int, pos int, query string")
    found = pages.exact_symbols(queries)
    got = sorted(map(tuple, found.collect()))
    assert got == [(1, 0, "SelectorCache"), (2, 0, "Rename"), (3, 0, "foo_bar"), (3, 1, "parse_all"), (3, 2, "onLeave"), (4, 0, "lowercase"), (8, 0, "x_yz")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(" in plan and "trim(" not in plan[: plan.index("Generate")]


def test_path_probes_take_short_lists_and_lose_no_path(spark):
    import random
    import re

    from caseloc.operators import search

    dice = random.Random(4)
    paths = [f"{dice.choice(('src1', 'src12', 'lib'))}/{dice.choice(('core', 'en', 'Deep/core'))}/{i}{dice.choice(('.txt', '.md', '_core.txt'))}" for i in range(60)]
    asked = [(i, q) for i, p in enumerate(paths[:20]) for q in (p, p.split("/", 1)[1], p.rsplit("/", 1)[0], p.replace("txt", "py"), "src1 core text none", "core/txt/lib.none")]
    asked += [(90, "see src1/core then lib/core or deep/core and 1.txt, core.txt/txt src12 core_txt"), (91, "'./src1/'"), (92, "a b"), (93, None)]

    def parts(text):
        found = [t for m in re.findall("[A-Za-z_][A-Za-z0-9_.$-]*", text) for t in (re.sub(r"^[._$-]+|[._$-]+$", "", m.lower()), *re.sub("([a-z0-9])([A-Z])", r"\1 \2", m).lower().split(" "))]
        return [t for t in found if len(t) >= 2]

    def judged(text, path):
        probe, low, bare = re.sub(r"^(?:\./)+", "", text.strip().strip("'\"`")).lower(), path.lower(), lambda x: re.sub(r"\.[a-z0-9]{1,5}$", "", x)
        slash, t = "/" in probe, [x for x in parts(probe) if len(x) >= 3]
        if not probe or not (slash or re.search(r"\.[a-z0-9]{1,5}\b", probe) or (3 <= len({x for x in parts(probe) if len(x) >= 4}) <= 8 and len(probe) <= 120)):
            return None
        if probe in low:
            return (96.0, 0, "exact") if probe == low else (82.0, -1, "prefix") if low.startswith(probe) else (62.0, -2, "substring")
        if len(bare(probe)) >= 8 and bare(probe) in bare(low):
            return 42.0, -3, "stem"
        n = sum(x in low for x in t)
        need = min(4, max(2, len(t) - 1)) if slash else min(4, max(3, len(set(t)) - 1))
        return ((12.0 + 4 * n if slash else 18.0 + 6 * n), -4, "overlap") if t and n >= need else None

    for limit in (3, 40):
        want = []
        for q in {q for q, _ in asked}:
            best = {p: max(got) for p in set(paths) if (got := [j for a, text in asked if a == q and text and (j := judged(text, p))])}
            order = sorted(best, key=lambda p: (-best[p][0], p))[:limit]
            want += [(q, i + 1, p, best[p][0], best[p][2]) for i, p in enumerate(order)]
        queries, files = spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame([(p,) for p in paths], "path string")
        assert sorted(map(tuple, search.path_probe(queries, files, limit).collect())) == sorted(want)

    many = spark.range(300).selectExpr("concat('a/web/', id, '.txt') AS path", "concat('a/web/', id, '.txt') AS low")
    probes = many.selectExpr("concat('web/', path, '.txt') AS probe")
    few = search._shared_tokens(probes, many, spark.createDataFrame([], "probe string, path string"), 5)
    assert few.count() == 300 * 5 and few.where("n <> 4").count() == 0


def test_paths_are_scored_once_for_instances_with_the_same_terms(spark):
    from caseloc.operators import scope

    files = spark.createDataFrame([("src/core/a.py",), ("src/b.py",), ("docs/corelib.md",), ("x.py",)], "path string")
    terms = spark.createDataFrame([(i, t) for i in range(40) for t in ("src", "core")] + [(50, "docs"), (51, "gone"), (52, "core")], "instance_id int, term string")
    found = scope.semantic_paths(terms, files, 2)
    want = [(i, p, s) for i in range(40) for p, s in (("src/core/a.py", 24.0), ("src/b.py", 6.0))]
    assert sorted(map(tuple, found.collect())) == sorted([*want, (50, "docs/corelib.md", 6.0), (52, "src/core/a.py", 6.0), (52, "docs/corelib.md", 3.0)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(id#" in plan and "windowspecdefinition(instance_id#" not in plan


def test_lists_of_names_are_not_sent_to_the_driver(spark, monkeypatch):
    from caseloc.functions.session import kept
    from caseloc.operators import edges, graph, search

    page = spark.createDataFrame([(f"ui/v{i}.jsx", f'<div className="box-n{i % 3} card" />') for i in range(40)], "path string, text string")
    other = spark.createDataFrame([("s.css", ".box-n0 {}\n#card {}"), ("c.json", '{"box-n1": 1}'), ("d.md", "see v7.jsx and V8")], "path string, text string")
    files = kept(page.unionByName(other), "files")
    raw = edges.style_config_doc_edges(files)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shown = []
    for most in (search.SENT, 0):
        monkeypatch.setattr(search, "SENT", most)
        found = graph.add_edges(edges.style_config_doc_edges(files), files, False)
        shown.append((sorted(map(tuple, found.collect())), sorted(map(tuple, search.token_counts(files.selectExpr("'box' AS token").distinct(), search.postings(files)).collect()))))
    assert shown[0] == shown[1] and len(shown[0][0]) == 14 + 40 + 13 + 1 and len(shown[0][1]) == 42
    assert "BroadcastExchange" not in plan(edges.class_styles(files)) and "BroadcastHashJoin" not in plan(graph.add_edges(kept(raw, "raw"), files))
