"""Flows of a term through code: statements and steps of all terms at once, the
edges between them, and what is read off a flow.

A term meets lines through an index of runs, never by a search of all lines for
all terms. Every job is keyed by term; the files and steps of one term are
bounded before they are joined with each other, so no term makes a large group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import kept
from .search import file_counts

# Patterns of a line, and roles with the words that tell them, in order.
IDENTIFIER = r"\b[A-Za-z_$][A-Za-z0-9_$]*\b"
CALL = r"\b([A-Za-z_$][A-Za-z0-9_$.]*)\s*\(([^)]{0,900})\)"
ASSIGN = r"\b([A-Za-z_$][A-Za-z0-9_$.]*)\s*(?::=|=|\+=|-=|\*=|/=)\s*(.+)"
HEADER = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(?:function\s*\*?\s*|def\s+)[A-Za-z_$][A-Za-z0-9_$]*|[A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)\s*[{:]"
ATTRIBUTE = r"(?:self|this)\.([A-Za-z_$][A-Za-z0-9_$]*)"
CHAIN_ROLES = {
    "reproduction_or_example": ("/examples/", "/example/", "/demo/", "/demos/", "/docs/", "/playground/", "/sandbox/"),
    "test_or_fixture": ("/test/", "/tests/", "__tests__", "/fixture/", "/fixtures/", ".spec.", ".test."),
    "url_builder": ("getediturl", "url", "href", "redirect", "route", "link", "permalink"),
    "state_selector": ("selector", "select", "current-user", "currentuser", "emailverified", "email_verified"),
    "state_update": ("reducer", "dispatch", "action", "store", "state/"),
    "component_or_route": ("component", "view", "page", "screen", "dashboard", "reader", "signup", "woocommerce", "render"),
    "event_handler": ("hover", "leave", "click", "mousemove", "mouseout", "handler", "onhover", "onleave"),
    "style_resolver": ("stylesheet", "style", "resolve", "expand", "margin", "layout", "yoga", "css", "scss"),
    "type_binder": ("binder", "declaration", "typeinfo", "typetype", "typevars", "deleted", "narrow"),
    "backend": ("backend",),
    "serializer": ("serialize", "serializer", "serialization", "private_key", "openssh", "/ssh."),
}
ROLE_ORDER = (
    "reproduction_or_example", "test_or_fixture", "reference_api", "public_api", "component_or_route", "state_selector", "state_update",
    "event_handler", "url_builder", "type_binder", "backend", "serializer", "style_resolver", "implementation",
)
BLOCKED_ROLES = ("reproduction_or_example", "test_or_fixture", "reference_api")
TARGET_ROLES = ("backend", "serializer", "style_resolver", "url_builder", "type_binder", "component_or_route")
CHAIN_WEIGHTS = {
    "call_argument_to_formal": 2.5, "call_boundary": 1.6, "cross_file_same_symbol_flow": 2.0, "same_symbol_def_use": 1.3,
    "return_value_to_call_site": 2.2, "field_write_to_read_or_shared_attribute": 1.8, "same_issue_term_cross_file": 0.45,
}
ACTIONS = ("define_or_assign", "parameter_definition", "call_or_argument", "return_value")


def symbol(name: Column) -> Column:
    """The last part of a dotted name, without marks at its edges, in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(F.trim(name), ".", -1), r"^[_$]+|[_$]+$", ""))


def code_role(text: Column, kind: Column | None = None) -> Column:
    """Role of a place in the code, from its path, line and names together."""
    low = F.lower(F.replace(text, F.lit("\\"), F.lit("/")))
    test = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    out = None
    for role, words in CHAIN_ROLES.items():
        out = F.when(test(words), role) if out is None else out.when(test(words), role)
    public = test(("/api/", "/public/", "__init__.py", ".pyi"))
    return out.when(public if kind is None else public | (kind == "class"), "public_api").otherwise("implementation")


def role_rank(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(ROLE_ORDER) for x in (r, i)]), role), F.lit(99))


def term_files(terms: DataFrame, files: DataFrame, most: int, by_score: bool = False) -> DataFrame:
    """(term, path, file_rank): files that hold a term (term, in lower case) in
    path or text: the first ``most`` by path, or by 8 for the path and 2 for each
    of the first eight occurrences."""
    wanted = terms.select(F.col("term").alias("token")).distinct()
    in_text = file_counts(wanted, files).withColumn("p", F.lit(0))
    in_path = file_counts(wanted, files.select("path", F.col("path").alias("text"))).withColumn("p", F.lit(1))
    both = in_text.unionByName(in_path).groupBy(F.col("token").alias("term"), "path").agg(F.sum("n").alias("n"), F.max("p").alias("p"))
    score = 8.0 * F.col("p") + 2.0 * F.least("n", F.lit(8)) if by_score else F.lit(0.0)
    order = Window.partitionBy("term").orderBy(F.desc("score"), "path")
    ranked = both.withColumn("score", score).withColumn("file_rank", F.row_number().over(order))
    return ranked.where(F.col("file_rank") <= most).select("term", "path", "file_rank", "p")


def _held(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """The chosen files, written once: what follows reads no others."""
    return kept(files.select("path", "text").join(chosen.select("path").distinct(), "path", "left_semi"), "held-files")


def _term_lines(chosen: DataFrame, held: DataFrame, whole_files: bool) -> DataFrame:
    """Lines of the chosen files (term, path) that hold the term; all lines of a
    file whose path holds it, if asked. Whole texts meet their terms and are cut
    there, so lines that hold none are never shuffled."""
    rows = chosen.join(held, "path").select(*chosen.columns, F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.withColumn("line_no", F.col("n") + 1).drop("n")
    hit = F.lower("line").contains(F.col("term"))
    return rows.where(hit | (F.col("p") == 1) if whole_files else hit)


def term_statements(terms: DataFrame, files: DataFrame, per_file: int = 30, most_files: int = 20, most: int = 80) -> DataFrame:
    """(term, path, line_no, kind, calls, code): statements that hold a term: 30
    of a file, 20 files and 80 in all for each term, in order."""
    chosen = kept(term_files(terms, files, most_files), "term-files")
    found = _term_lines(chosen, _held(chosen, files), False)
    in_file = Window.partitionBy("term", "path").orderBy("line_no")
    over = Window.partitionBy("term").orderBy("file_rank", "line_no")
    few = found.withColumn("n", F.row_number().over(in_file)).where(F.col("n") <= per_file)
    few = few.withColumn("n", F.row_number().over(over)).where(F.col("n") <= most)
    line, low = F.col("line"), F.lower("line")
    calls = F.filter(F.regexp_extract_all(line, F.lit(CALL), F.lit(1)), lambda c: ~c.isin("if", "for", "while", "switch", "catch", "function"))
    kind = (
        F.when(F.lower(F.regexp_extract(line, HEADER, 1)).contains(F.col("term")), "parameter_definition")
        .when(F.lower(F.regexp_extract(line, ASSIGN, 1)).contains(F.col("term")), "define_or_assign")
        .when(low.rlike(r"\breturn\b"), "return_value")
        .when(low.rlike(r"\b(?:if|elif|while|switch|case)\b"), "condition")
        .when(F.size(calls) > 0, "call_or_argument")
        .otherwise("reference")
    )
    return few.select("term", "path", "line_no", kind.alias("kind"), calls.alias("calls"), F.trim("line").alias("code"))


def local_def_use(statements: DataFrame) -> DataFrame:
    """Edges from the last definition above each statement of a file: a running
    value, not a join."""
    run = Window.partitionBy("term", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    defines = F.col("kind").isin("define_or_assign", "parameter_definition")
    seen = statements.withColumn("from_line", F.last(F.when(defines, F.col("line_no")), True).over(run)).where(~defines & F.col("from_line").isNotNull())
    return seen.select("term", F.col("path").alias("source"), F.col("path").alias("target"), F.lit("local_def_use").alias("relation"), F.col("from_line").alias("source_line"), F.col("line_no").alias("target_line"))


def argument_to_formal(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges from a call to the parameter that takes its argument: only if
    exactly one other file declares the callee, and has a parameter of the term.
    Declaring files are counted by name before any is joined; names that no
    statement calls are left out first."""
    calls = statements.where("kind = 'call_or_argument'").select("term", "path", "line_no", F.explode(F.array_distinct("calls")).alias("callee"))
    declared = entities.select(F.col("name").alias("callee"), F.col("path").alias("target")).join(calls.select("callee").distinct(), "callee", "left_semi")
    declared = kept(declared.distinct(), "declared")
    counts = declared.groupBy("callee").agg(F.count("*").alias("n"))
    own = declared.select("callee", F.col("target").alias("path"), F.lit(1).alias("own"))
    single = calls.join(counts, "callee").join(own, ["callee", "path"], "left").na.fill(0, ["own"]).where("n - own = 1")
    # One other file, so at most two declaring files for each call.
    found = single.join(declared, "callee").where("target <> path")
    formal = statements.where("kind = 'parameter_definition'").groupBy("term", F.col("path").alias("target")).agg(F.min("line_no").alias("target_line"))
    return found.join(formal, ["term", "target"]).select(
        "term", F.col("path").alias("source"), "target", F.lit("argument_to_formal_parameter").alias("relation"), F.col("line_no").alias("source_line"), "target_line"
    )


def statement_edges(statements: DataFrame, entities: DataFrame, most: int = 80) -> DataFrame:
    """(term, source, target, relation, source_line, target_line): one edge for
    each pair of files and relation, ``most`` for each term. That two files hold
    a term makes no edge."""
    both = local_def_use(statements).unionByName(argument_to_formal(statements, entities))
    first = both.groupBy("term", "source", "target", "relation").agg(F.min(F.struct("source_line", "target_line")).alias("x"))
    order = Window.partitionBy("term").orderBy(F.desc("relation"), "source", "target")
    few = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return few.select("term", "source", "target", "relation", "x.source_line", "x.target_line")


def statement_flows(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, files, statements, edges, confidence) of terms with at least two
    statements or one that does something: confidence is 0.34 + 0.04 a file +
    0.05 an edge + 0.04 an action, 0.98 at most."""
    acts = F.col("kind").isin(*ACTIONS)
    base = statements.groupBy("term").agg(
        F.countDistinct("path").alias("files"), F.count("*").alias("statements"), F.count_if(acts).alias("actions"),
        F.max(acts | (F.col("kind") == "condition") | (F.size("calls") > 0)).alias("does"),
    )
    n_edges = edges.groupBy("term").agg(F.count("*").alias("edges"))
    rows = base.where("statements >= 2 or does").join(n_edges, "term", "left").na.fill(0, ["edges"])
    value = F.least(F.lit(0.98), 0.34 + 0.04 * F.col("files") + 0.05 * F.col("edges") + 0.04 * F.col("actions"))
    return rows.select("term", "files", "statements", "edges", F.round(value, 3).alias("confidence"))


# --- steps of chains and slices -----------------------------------------------------------


def steps(
    terms: DataFrame, files: DataFrame, owners: Callable[[DataFrame, DataFrame], DataFrame], most_files: int = 34, most: int = 160, by_score: bool = True
) -> DataFrame:
    """(term, step, path, line_no, code, defs, uses, calls, attributes, returns,
    entity, role): lines of a term in order, numbered from 1.

    owners: from the files that were chosen and lines of them (path, line_no) to
    the entity around each line (path, line_no, entity, entity_kind). A definition
    is the left side of an assignment; uses are the names on its right, or of the
    whole line, other than definitions.
    """
    chosen = kept(term_files(terms, files, most_files, by_score), "term-files")
    held = _held(chosen, files)
    over = Window.partitionBy("term").orderBy("file_rank", "line_no")
    few = _term_lines(chosen, held, True).withColumn("step", F.row_number().over(over)).where(F.col("step") <= most)
    few = kept(few.select("term", "step", "path", "line_no", "line"), "step-lines")
    few = few.join(owners(held, few.select("path", "line_no").distinct()), ["path", "line_no"], "left").na.fill("", ["entity", "entity_kind"])
    line = F.col("line")
    left, right = F.regexp_extract(line, ASSIGN, 1), F.regexp_extract(line, ASSIGN, 2)
    names = lambda text: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), symbol), lambda s: s != ""))
    defs = F.filter(F.array(symbol(left)), lambda s: s != "")
    called = F.regexp_extract_all(line, F.lit(CALL), F.lit(1))
    arguments = F.regexp_extract_all(line, F.lit(CALL), F.lit(2))
    calls = F.slice(F.zip_with(called, arguments, lambda c, a: F.struct(symbol(c).alias("symbol"), F.lower(a).alias("args"))), 1, 12)
    return few.select(
        "term", "step", "path", "line_no", F.substring(F.trim(line), 1, 700).alias("code"), defs.alias("defs"),
        F.slice(F.array_except(F.when(left != "", names(right)).otherwise(names(line)), defs), 1, 30).alias("uses"), calls.alias("calls"),
        F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(ATTRIBUTE), F.lit(1)), symbol)).alias("attributes"),
        line.rlike(r"\breturn\b").alias("returns"), symbol(F.col("entity")).alias("entity"),
        code_role(F.concat_ws(" ", "path", "line", "entity", "entity_kind"), F.col("entity_kind")).alias("role"),
    )


def _first_uses(used: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy("term", *keys).orderBy("to_step")
    return used.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def call_boundary(rows: DataFrame, entities: DataFrame, most_entities: int = 8, most_steps: int = 2) -> DataFrame:
    """Edges from a call to the entity that it names, at most eight by path and
    line: to the entity's first two steps, or to its first line (step 0). In the
    own file only if the term is among the arguments, which also makes the edge
    one from argument to formal."""
    calls = rows.select("term", "step", "path", "line_no", F.explode("calls").alias("c")).select("*", "c.*").drop("c")
    order = Window.partitionBy("symbol").orderBy("entity_path", "start_line")
    few = entities.select(symbol(F.col("name")).alias("symbol"), F.col("path").alias("entity_path"), "start_line").where("symbol <> ''")
    few = few.join(calls.select("symbol").distinct(), "symbol", "left_semi")
    few = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_entities).drop("k")
    met = calls.join(few, "symbol")
    inside = rows.select("term", F.col("path").alias("entity_path"), F.col("entity").alias("symbol"), F.col("step").alias("to_step"), F.col("line_no").alias("target_line"))
    inside = _first_uses(inside.where("symbol <> ''"), ["entity_path", "symbol"], most_steps)
    joined = met.join(inside, ["term", "entity_path", "symbol"], "left").na.fill(0, ["to_step"]).withColumn("target_line", F.coalesce("target_line", "start_line"))
    passed = F.col("args").contains(symbol(F.col("term")))
    relation = F.when(passed, "call_argument_to_formal").otherwise("call_boundary")
    edges = joined.where(((F.col("entity_path") != F.col("path")) | passed) & (F.col("step") != F.col("to_step")))
    return _edge(edges, F.col("entity_path"), relation)


def _edge(rows: DataFrame, target: Column, relation: Column) -> DataFrame:
    return rows.select("term", F.col("path").alias("source"), target.alias("target"), relation.alias("relation"), "symbol", "step", "to_step", F.col("line_no").alias("source_line"), "target_line")


def _uses(rows: DataFrame) -> DataFrame:
    return rows.select("term", F.explode("uses").alias("symbol"), F.col("step").alias("to_step"), F.col("path").alias("to_path"), F.col("line_no").alias("target_line"))


def chain_def_use(rows: DataFrame, most: int = 12) -> DataFrame:
    """Edges from a definition to the first uses of its name in the term's steps."""
    defs = rows.select("term", "step", "path", "line_no", F.explode("defs").alias("symbol"))
    pairs = defs.join(_first_uses(_uses(rows), ["symbol"], most), ["term", "symbol"]).where("step <> to_step")
    return _edge(pairs, F.col("to_path"), F.when(F.col("path") == F.col("to_path"), "same_symbol_def_use").otherwise("cross_file_same_symbol_flow"))


def return_to_call(rows: DataFrame, most: int = 12) -> DataFrame:
    """Edges from a return to the first uses of the name of its entity."""
    ends = rows.where("returns and entity <> ''").select("term", "step", "path", "line_no", F.col("entity").alias("symbol"))
    pairs = ends.join(_first_uses(_uses(rows), ["symbol"], most), ["term", "symbol"]).where("step <> to_step")
    return _edge(pairs, F.col("to_path"), F.lit("return_value_to_call_site"))


def shared_attribute(rows: DataFrame, most: int = 10) -> DataFrame:
    """Edges from a step that names an attribute to the first steps that read or
    write it on self or this."""
    owned = rows.select("term", F.explode("attributes").alias("symbol"), F.col("step").alias("to_step"), F.col("path").alias("to_path"), F.col("line_no").alias("target_line"))
    few = _first_uses(owned.where("symbol <> ''"), ["symbol"], most)
    pairs = rows.join(few, "term").where(F.lower("code").contains(F.col("symbol")) & (F.col("step") != F.col("to_step")))
    return _edge(pairs, F.col("to_path"), F.lit("field_write_to_read_or_shared_attribute"))


def same_term(rows: DataFrame, first: int = 10, last: int = 12) -> DataFrame:
    """Weak edges from the first steps by role to the last ones in other files."""
    by = lambda *c: Window.partitionBy("term").orderBy(*c)
    rank = role_rank(F.col("role"))
    placed = rows.select("term", "step", "path", "line_no", rank.alias("rank"))
    head = placed.withColumn("k", F.row_number().over(by("rank", "path", "line_no"))).where(F.col("k") <= first)
    tail = placed.withColumn("k", F.row_number().over(by(F.desc("rank"), F.desc("path"), F.desc("line_no")))).where(F.col("k") <= last)
    tail = tail.select("term", F.col("step").alias("to_step"), F.col("path").alias("to_path"), F.col("line_no").alias("target_line"))
    pairs = head.join(tail, "term").where("path <> to_path").withColumn("symbol", F.col("term"))
    return _edge(pairs, F.col("to_path"), F.lit("same_issue_term_cross_file"))


def chain_edges(rows: DataFrame, entities: DataFrame, most: int = 90) -> DataFrame:
    """(term, source, target, relation, symbol, step, to_step, weight): edges of
    all kinds, the ``most`` heaviest of each term."""
    parts = (call_boundary(rows, entities), chain_def_use(rows), return_to_call(rows), shared_attribute(rows), same_term(rows))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in CHAIN_WEIGHTS.items() for x in kv]), F.col("relation"))
    every = reduce(DataFrame.unionByName, parts).withColumn("weight", weight)
    once = every.groupBy("term", "source", "target", "relation", "symbol", "step", "to_step", "target_line").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("term").orderBy(F.desc("weight"), "relation", "source", "target", "step", "to_step", "symbol", "target_line")
    few = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return few.select("term", "source", "target", "relation", "symbol", "step", "to_step", "weight")


def group_locations(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, path, role, statements, edge_score): the commonest role of each
    file, by priority and name among equals, and the weight of edges at either end."""
    roles = rows.groupBy("term", "path", "role").agg(F.count("*").alias("n"))
    best = roles.groupBy("term", "path").agg(
        F.min_by("role", F.struct(-F.col("n"), role_rank(F.col("role")), "role")).alias("role"), F.sum("n").alias("statements")
    )
    ends = edges.select("term", F.explode(F.array("source", "target")).alias("path"), "weight")
    score = ends.groupBy("term", "path").agg(F.round(F.sum("weight"), 3).alias("edge_score"))
    return best.join(score, ["term", "path"], "left").na.fill(0.0, ["edge_score"])


def flow_targets(rows: DataFrame, edges: DataFrame, most: int = 18) -> DataFrame:
    """(term, rank, path, score): places that a chain suggests to change. A step
    counts 1 + 0.08 x its role's place, and 2 more in some roles; context roles
    count nothing; an edge its weight at both ends, 0.35 of it if weak."""
    known = ~F.col("role").isin(*BLOCKED_ROLES)
    own = 1.0 + role_rank(F.col("role")) * 0.08 + F.when(F.col("role").isin(*TARGET_ROLES), 2.0).otherwise(0.0)
    by_step = rows.where(known).select("term", "path", own.alias("s"))
    weak = F.when(F.col("relation") == "same_issue_term_cross_file", 0.35).otherwise(1.0)
    by_edge = edges.select("term", F.explode(F.array("source", "target")).alias("path"), (F.col("weight") * weak).alias("s"))
    total = by_step.unionByName(by_edge).groupBy("term", "path").agg(F.round(F.sum("s"), 6).alias("score"))
    order = Window.partitionBy("term").orderBy(F.desc("score"), "path")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("term", "rank", "path", "score")


def slice_edges(rows: DataFrame, entities: DataFrame, most_def_use: int = 120, most_calls: int = 80) -> DataFrame:
    """(term, source, target, relation, symbol) of static slices: from definitions
    to uses (not upwards in a file), and from calls to entities of other files
    with that name; one for each pair of files, relation and symbol."""
    defs = rows.select("term", "step", "path", "line_no", "entity", F.explode("defs").alias("symbol"))
    uses = rows.select("term", F.col("step").alias("to"), F.col("path").alias("to_path"), F.col("line_no").alias("to_line"), F.col("entity").alias("to_entity"), F.explode("uses").alias("symbol"))
    # The steps of a term are bounded, and so are their pairs.
    pairs = defs.join(uses, ["term", "symbol"]).where("step <> to and not (path = to_path and line_no > to_line)")
    same = (F.col("path") == F.col("to_path")) & (F.col("entity") == F.col("to_entity"))
    flow = pairs.select("term", F.col("path").alias("source"), F.col("to_path").alias("target"), F.when(same, "same_function_def_use").otherwise("cross_statement_def_use").alias("relation"), "symbol").distinct()
    calls = rows.select("term", F.col("path").alias("source"), F.explode("calls.symbol").alias("symbol")).distinct()
    # A common name makes no more edges than a term may have.
    order = Window.partitionBy("symbol").orderBy("target")
    named = entities.select(symbol(F.col("name")).alias("symbol"), F.col("path").alias("target")).where("symbol <> ''")
    named = named.join(calls.select("symbol").distinct(), "symbol", "left_semi").distinct()
    named = named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_calls + 1).drop("k")
    across = calls.join(named, "symbol").where("source <> target").select("term", "source", "target", F.lit("call_boundary_argument_flow").alias("relation"), "symbol")

    def first(df: DataFrame, most: int) -> DataFrame:
        over = Window.partitionBy("term").orderBy("source", "target", "relation", "symbol")
        return df.withColumn("n", F.row_number().over(over)).where(F.col("n") <= most).drop("n")

    return first(flow, most_def_use).unionByName(first(across, most_calls))


def slice_flows(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, files, statements, def_use_edges, call_edges, confidence)."""
    base = rows.groupBy("term").agg(
        F.countDistinct("path").alias("files"), F.count("*").alias("statements"), F.max((F.size("defs") > 0) | (F.size("calls") > 0) | F.col("returns")).alias("does")
    )
    calls = F.col("relation") == "call_boundary_argument_flow"
    sums = edges.groupBy("term").agg(F.count_if(~calls).alias("def_use_edges"), F.count_if(calls).alias("call_edges"))
    got = base.join(sums, "term", "left").na.fill(0, ["def_use_edges", "call_edges"])
    upto = lambda top, step, name: F.least(F.lit(top), step * F.col(name))
    value = 0.30 + upto(0.24, 0.03, "files") + upto(0.25, 0.02, "def_use_edges") + upto(0.16, 0.04, "call_edges") + F.when(F.col("does"), 0.08).otherwise(0.0)
    return got.select("term", "files", "statements", "def_use_edges", "call_edges", F.round(F.least(F.lit(0.99), value), 3).alias("confidence"))


def chain_flows(rows: DataFrame, edges: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(term, steps, edges, coverage, confidence) of chains with two files or three
    steps; ``required``: roles that a whole flow has."""
    hits = [F.max((F.col("role") == r).cast("int")) for r in required]
    base = rows.groupBy("term").agg(F.countDistinct("path").alias("files"), F.count("*").alias("steps"), F.round(sum(hits) / max(1, len(required)), 3).alias("coverage"))
    order = Window.partitionBy("term").orderBy(F.desc("weight"), "relation", "source", "target", "step", "to_step", "symbol")
    strong = edges.withColumn("n", F.row_number().over(order)).groupBy("term").agg(
        F.count("*").alias("edges"), F.sum(F.when(F.col("n") <= 30, F.col("weight")).otherwise(0.0)).alias("strength")
    )
    got = base.where("files >= 2 or steps >= 3").join(strong, "term", "left").na.fill(0).na.fill(0.0)
    value = (
        0.24 + 0.025 * F.least("steps", F.lit(18)) + 0.035 * F.least("edges", F.lit(18)) + 0.18 * F.col("coverage") + 0.015 * F.least("strength", F.lit(12.0))
    )
    return got.select("term", "steps", "edges", "coverage", F.round(F.least(F.lit(0.99), value), 3).alias("confidence"))


def written_steps(*args, **options) -> DataFrame:
    """``steps`` written once for the several edge builders that read them."""
    return kept(steps(*args, **options), "steps")
