"""Exact cases of flows between entities, searches by bounds, scopes, reviews, event
logs and reproductions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from caseloc.operators import interflow, reproduction, reviews, scope, search


def test_flows_between_entities(spark):
    code = {
        "src/net/client.py": "def send_kdf(rounds):\n    return pack(rounds)\n",
        "src/net/pack.py": "def pack(rounds):\n    store(rounds)\n    return other(1)\n",
        "src/db/store.py": "def store(value):\n    kdf = value\n",
        "src/ui/main.py": "def main():\n    send_kdf(3)\n    print(4)\n",
        "src/empty.py": "x = 1\n",
    }
    files = spark.createDataFrame(list(code.items()), "path string, text string")
    rows = spark.createDataFrame([(p, i + 1, x) for p, t in code.items() for i, x in enumerate(t.split("\n"))], "path string, line_no int, line string")
    names = {"src/net/client.py": "send_kdf", "src/net/pack.py": "pack", "src/db/store.py": "store", "src/ui/main.py": "main"}
    found = spark.createDataFrame([(p, "function", n, 1, code[p].count("\n")) for p, n in names.items()], "path string, kind string, name string, start_line int, end_line int")
    entities = interflow.flow_entities(found, files, rows)
    assert {(r.path, r.kind, r.name) for r in entities.collect()} == {(p, "function", n) for p, n in names.items()} | {("src/empty.py", "module", "empty")}
    terms = spark.createDataFrame([(7, 0, "kdf")], "instance_id long, pos int, term string")
    issues = spark.createDataFrame([(7, "kdf rounds are lost in serialize")], "instance_id long, issue_text string")
    edges, holders = interflow.interprocedural_edges(terms, issues, entities)
    name = {r.id: r.name for r in entities.collect()}
    got = {(name[e.source], name[e.target], e.relation, e.confidence) for e in edges.where("stage = 0").collect()}
    # main names the callee, client and pack hold or reach the term.
    assert ("main", "send_kdf", "calls_term_related_entity", 0.64) in got and not [e for e in got if e[1] == "print"]
    assert {name[h.id] for h in holders.collect()} == {"send_kdf", "store", "main"}
    hops = {(name[e.source], name[e.target], e.relation) for e in edges.where("stage > 0").collect()}
    assert ("main", "send_kdf", "candidate_beam_call_closure:hop1") in hops
    flow = interflow.interprocedural_flows(edges, holders, issues, entities).first()
    assert flow.flow_type == "interprocedural_parameter_flow" and flow.entities == 3 and flow.confidence >= 0.76


def test_common_names_are_not_resolved(spark):
    rows = [(i, f"src/p{i}/f.py", "function", "twice", "twice", 1, "x") for i in range(6)] + [(10, "src/a/g.py", "function", "once", "once", 1, "y"), (11, "src/z/h.py", "function", "caller", "caller", 1, "z")]
    entities = spark.createDataFrame(rows, "id long, path string, kind string, name string, symbol string, start_line int, text string")
    calls = spark.createDataFrame([(11, "twice"), (11, "once"), (11, "render"), (3, "twice")], "id long, symbol string")
    assert {tuple(r) for r in interflow.resolved_calls(calls, entities).collect()} == {(11, "once", 10)}


@pytest.mark.parametrize("block", [1, 3, 64])
def test_best_scores_by_bounds_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = ["alpha", "beta", "gamma", "delta", "alphabet", "eps", "zeta", "eta"]
    files = [(f"d{i % 4}/{rng.choice(vocabulary)}{i}.txt", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(50)]
    queries = [(q, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5)))) for q in range(12)] + [(3, "alpha beta")]
    got = {}
    for r in search.search_files(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(files, "path string, text string"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.path, r.score))
    weights = search.query_tokens(spark.createDataFrame(queries, "query_id int, query string")).collect()
    for q in range(12):
        own = {r.token: r.weight for r in weights if r.query_id == q}
        scores = {}
        for path, text in files:
            s = sum(w * (8 * (t in path) + min(12, text.count(t))) for t, w in own.items()) + 5 * sum(x in text for i, x in queries if i == q and len(x) > 4)
            if s:
                scores[path] = round(s, 6)
        assert got.get(q, []) == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_scope_of_an_instance_without_hits(spark):
    files = spark.createDataFrame([("b/x.py", "nothing"), ("a/y.py", "here"), ("c/z.test.js", "zeta zeta")], "path string, text string")
    queries = spark.createDataFrame([(1, 0, "zeta")], "instance_id int, pos int, query string")
    empty = spark.createDataFrame([], "instance_id int, path string")
    terms = spark.createDataFrame([], "instance_id int, term string")
    issues = spark.createDataFrame([(1, "zeta"), (2, "none")], "instance_id int, issue_text string")
    entities = spark.createDataFrame([("a/y.py", "zeta", "t")], "path string, name string, text string")
    rows = {(r.instance_id, r.rank): (r.path, r.score, list(r.channels)) for r in scope.graph_scope(queries, files, entities, empty, terms, issues).collect()}
    assert rows[2, 1] == ("a/y.py", 0.1, ["fallback"]) and rows[2, 3][0] == "c/z.test.js"
    assert rows[1, 1][0] == "a/y.py" and "entity" in rows[1, 1][2] and rows[1, 2][0] == "c/z.test.js"


def test_objects_of_cut_off_answers(spark):
    texts = ['a } {"x": "}{"} {"y": {"z": 1}} {"cut": "', "}}}{}", "", None, '{"a": "\\"}"}', '{"open": {"b": 1}', "{" * 3_000 + "}" * 3_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in reviews.balanced_objects(rows, "text", ["id"]).orderBy("id", "at").collect():
        got.setdefault(r.id, []).append(r.object)
    assert got == {0: ['{"x": "}{"}', '{"y": {"z": 1}}'], 1: ["{}"], 4: ['{"a": "\\"}"}'], 6: ["{" * 3_000 + "}" * 3_000]}


def test_reviews_are_grounded(spark):
    item = {"path": "a.py", "role": "patch_target", "confidence": 2, "evidence_quote": "return  the\nvalue", "mechanism_verified": True, "patch_mechanism": "m", "matched_issue_axes": ["concern", "call"], "entities": [{"kind": "function", "name": "run"}]}
    whole = json.dumps({"candidates": [item, {**item, "role": "x"}, {**item, "path": "b.py", "evidence_quote": "short"}], "missing_evidence": []})
    cut = '```json\n{"continue_search": TRUE, "candidates": [' + json.dumps({**item, "path": "./b.py", "entities": [{"kind": "class", "name": "Gone"}]}) + ', {"path": "a.p'
    answers = spark.createDataFrame([(1, whole), (2, cut), (3, None), (4, "[]")], "instance_id int, response string")
    allowed = spark.createDataFrame([(i, p) for i in (1, 2, 3) for p in ("a.py", "b.py")], "instance_id int, path string")
    shown = spark.createDataFrame([(i, p, "def run():\n  Return the value") for i in (1, 2) for p in ("a.py", "b.py")], "instance_id int, path string, text string")
    heads, candidates = reviews.review_objects(answers)
    got = reviews.validated_reviews(candidates, allowed, shown)
    rows = {(r.instance_id, r.path): r for r in got.collect()}
    assert len(rows) == 3 and rows[1, "a.py"].mechanism_verified and rows[1, "a.py"].confidence == 1.0
    assert not rows[1, "b.py"].quote_supported and rows[2, "b.py"].quote_supported and not rows[2, "b.py"].entity_supported
    stops = {r.instance_id: (r.mode, r.candidates, r.continue_search, r.stop_ready) for r in reviews.review_stops(heads, got).collect()}
    assert stops == {1: ("complete_json", 2, False, True), 2: ("partial_candidate_recovery", 1, True, False), 3: ("invalid", 0, False, False), 4: ("invalid", 0, False, False)}


def test_events_in_the_order_of_a_walk(spark):
    result = {"b": [{"llm_raw": "one"}, {"x": {"llm_raw": "", "analysis": "two"}}], "a": {"raw_response": {"id": 5, "llm_raw": "hidden"}}, "llm_planning": {}, "c_llm_planning": {"k": 1}}
    rows = spark.createDataFrame([(1, json.dumps(result)), (2, "[]"), (3, "7")], "instance_id int, r string").select("instance_id", F.parse_json("r").alias("result"))
    got = [(r.event_no, r.path, r.event_type, r.response_id, r.content) for r in reviews.llm_events(rows).orderBy("event_no").collect()]
    assert got == [
        (1, "a", "llm_response", "5", '{"raw_response":{"id":5,"llm_raw":"hidden"}}'),
        (2, "b[0]", "react_or_controller_raw", "", "one"),
        (3, "b[1].x", "react_or_controller_raw", "", "two"),
        (4, "c_llm_planning", "llm_evidence_planning", "", '{"k":1}'),
    ]


def test_reproductions_that_do_not_decode(spark):
    urls = [None, "", "https://codepen.io/x/pen/abc", "https://e.org/?code=%E0%A4%A&flags=%ff", "https://e.org/?q=Zm9vYmFyZm9vYmFyZm9v", "https://e.org/?a=aW1wb3J0IHh4eHg", "https://csb.app/?text=&text=last&text=b"]
    got = reproduction.reproductions(spark.createDataFrame(list(enumerate(urls)), "id int, url string")).orderBy("id").collect()
    assert [r.needs_browser for r in got] == [False, False, True, False, False, False, False]
    assert got[2].queries == ["codepen x pen abc", "pen", "abc"] and got[3].snippets[0].value == "%E0%A4%A" and got[4].snippets == []
    assert [tuple(s) for s in got[5].snippets] == [("a", "import xxxx", "base64-url")] and got[6].snippets[0].value == "b"


def test_backends_are_checked_when_registered(spark):
    from caseloc.operators.backends import FlowBackends

    own = FlowBackends(spark)
    with pytest.raises(TypeError, match="confidence double"):
        own.register("bad", lambda terms, *_: terms.withColumn("flow_type", F.lit("x")))
    own.register("good", lambda terms, *_: terms.select("term", F.lit("x").alias("flow_type"), F.lit(0.5).alias("confidence")))
    with pytest.raises(ValueError):
        own.register("good", lambda *_: None)
    terms = spark.createDataFrame([("a",)], "term string")
    assert [tuple(r) for r in own.run(terms, terms, terms, terms).collect()] == [("good", "a", "x", 0.5)]


def test_edit_set_against_a_plain_loop(spark):
    from caseloc.operators import closure

    rng = random.Random(6)
    covers, candidates, obligations, wanted = [], [], [], {}
    for i in range(30):
        names = [f"o{k}" for k in range(rng.randrange(1, 9))]
        required = {o for o in names if rng.random() < 0.8}
        pool = []
        for rank in range(1, rng.randrange(2, 12)):
            own = {o for o in names if rng.random() < 0.3}
            covers += [(i, f"p{rank}", o) for o in own]
            pool.append((rank, f"p{rank}", rng.randrange(5) / 4, rng.random() < 0.5, rng.randrange(4) / 4, own & required))
        candidates += [(i, *c[:5]) for c in pool]
        obligations += [(i, o, o in required) for o in names]
        gap = lambda files: required - set().union(*[c[5] for c in pool if c[1] in files])  # noqa: B023, E731
        files, rounds, added = ["p1"], 0, []
        for _ in range(3):
            rounds, left = rounds + 1, gap(files)
            best = sorted((-(5.0 * len(c[5] & left) + c[2]), c[0], c[1]) for c in pool if c[5] & left and c[1] not in files)
            added = [b[2] for b in best[: max(0, min(2, 6 - len(files)))]]
            files = files + added
            for _, _, _, path in sorted((c[3], c[4], -c[0], c[1]) for c in pool if c[1] in files):
                if len(files) > 1 and gap([f for f in files if f != path]) == gap(files):
                    files = [f for f in files if f != path]
            if not added or not gap(files):
                break
        status = "complete" if not gap(files) else "budget_exhausted" if rounds >= 3 and added else "incomplete"
        wanted[i] = (sorted(files), rounds, sorted(gap(files)), status)
    got = closure.modification_closure(
        spark.createDataFrame(covers, "instance_id int, path string, obligation string"),
        spark.createDataFrame(candidates, "instance_id int, rank int, path string, extra double, target boolean, confidence double"),
        spark.createDataFrame(obligations, "instance_id int, obligation string, required boolean"),
    )
    assert {r.instance_id: (list(r.files), r.rounds, sorted(r.missing), r.status) for r in got.collect()} == wanted


def test_the_kth_challenger_meets_the_kth_weakest(spark):
    from caseloc.operators import rounds

    held = [(1, f"s{r}", 10.0 - r, r, True, r) for r in range(1, 9)]
    others = [(1, "best", 9.0, 1, True, None), (1, "next", 3.6, 1, True, None), (1, "weak", 99.0, 1, False, None), (1, "third", 9.0, 2, True, None)]
    rows = spark.createDataFrame(held + others, "instance_id int, path string, quality double, best int, strong boolean, selected_rank int")
    got = {r.rank: (r.path, r.replaced) for r in rounds.cross_round_frontier(rows).collect()}
    assert got[8] == ("best", "s8") and got[7] == ("third", "s7") and got[6] == ("s6", None) and len(got) == 8
    assert {r.replaced for r in rounds.cross_round_frontier(rows, margin=7.0).collect()} == {None, "s8"}


def test_texts_of_entities_are_cut_from_whole_files(spark):
    code = {"a/b.js": "class A {\n  run(x) {\n    y\n  }\n}\ntail", "c.d.py": "z = 1\n", "e.js": None}
    files = spark.createDataFrame(list(code.items()), "path string, text string")
    found = spark.createDataFrame([("a/b.js", "method", "run", 2, 4), ("a/b.js", "class", "A", 1, 85), ("a/b.js", "class", "A", 1, 85), ("a/b.js", "import", "q", 1, 1)], "path string, kind string, name string, start_line int, end_line int")
    entities = interflow.flow_entities(found, files)
    got = [(r.path, r.kind, r.name, r.start_line, r.text) for r in entities.orderBy("id").collect()]
    assert got == [("a/b.js", "class", "A", 1, code["a/b.js"]), ("a/b.js", "method", "run", 2, "  run(x) {\n    y\n  }"), ("c.d.py", "module", "c.d", 1, "z = 1\n"), ("e.js", "module", "e", 1, None)]


def test_names_that_nobody_calls_are_not_counted(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(interflow, "kept", lambda df, name: written.setdefault(name, df))
    rows = [(i, f"src/p{i}/f.py", "function", f"idle{i}", f"idle{i}", 1, "x") for i in range(6)] + [(10, "src/a/g.py", "function", "once", "once", 1, "y"), (11, "src/z/h.py", "function", "caller", "caller", 1, "z")]
    entities = spark.createDataFrame(rows, "id long, path string, kind string, name string, symbol string, start_line int, text string")
    found = interflow.resolved_calls(spark.createDataFrame([(11, "once"), (11, "gone")], "id long, symbol string"), entities)
    assert [tuple(r) for r in found.collect()] == [(11, "once", 10)]
    assert [r.symbol for r in written["declared"].collect()] == ["once"]
