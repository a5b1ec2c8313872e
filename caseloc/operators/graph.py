"""Typed graph over files: edges as a table, expansion, bounded hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import kept
from ..functions.text import tokens

# Verbs too common to name one callee, and edge families of a mode.
GENERIC_CALLS = (
    "add", "append", "apply", "build", "call", "close", "constructor", "create", "delete", "dispatch", "draw", "emit",
    "filter", "find", "get", "handle", "init", "load", "map", "open", "parse", "process", "push", "read", "remove",
    "render", "resolve", "run", "save", "set", "setup", "sort", "start", "stop", "update", "validate", "write",
)
BONUS_TYPES = ("calls", "renders", "selects_state", "type_flow", "inherits_or_implements")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem_tokens(path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(path), r"[/_.\-]+"), lambda t: F.length(t) >= 3))


def add_edges(raw: DataFrame, files: DataFrame, reverse: bool = True) -> DataFrame:
    """Edges (source, target, edge_type, weight, evidence) between files, no
    loops, one for each (source, target, type, first 120 letters of evidence),
    the heaviest. With ``reverse`` each also goes back: reverse_<type> at
    max(0.35, 0.72 x weight)."""
    edges = raw.select("source", "target", "edge_type", F.col("weight").cast("double").alias("weight"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    if reverse:
        back = edges.select(
            F.col("target").alias("source"),
            F.col("source").alias("target"),
            F.concat(F.lit("reverse_"), "edge_type").alias("edge_type"),
            F.round(F.greatest(F.lit(0.35), F.col("weight") * 0.72), 6).alias("weight"),
            "evidence",
        )
        edges = edges.unionByName(back)
    edges = edges.where("source <> target and source <> '' and target <> ''")
    # All paths are not sent to the driver, however small the files they are read from.
    known = files.select("path").distinct().hint("merge")
    for end in ("source", "target"):
        edges = edges.join(known.withColumnRenamed("path", end), end, "left_semi")
    cut = F.substring("evidence", 1, 120)
    return edges.groupBy("source", "target", "edge_type", cut.alias("evidence")).agg(F.max("weight").alias("weight"))


def sibling_edges(files: DataFrame, most: int = 18) -> DataFrame:
    """Edges both ways between files of a directory; directories with more than
    ``most`` files give none, which is counted before any pair is made."""
    placed = files.select("path", folder(F.col("path")).alias("dir"))
    small = placed.groupBy("dir").agg(F.count("*").alias("n")).where(F.col("n").between(2, most))
    own = placed.join(small.select("dir"), "dir")
    pairs = own.withColumnRenamed("path", "source").join(own.withColumnRenamed("path", "target"), "dir").where("source <> target")
    return pairs.select("source", "target", F.lit("same_directory").alias("edge_type"), F.lit(0.35).alias("weight"), F.lit("small directory neighborhood").alias("evidence"))


def symbol_files(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): names of three letters or more that a file declares, and
    the stems of file names."""
    return symbol_names(entities, files).distinct()


def symbol_names(entities: DataFrame, files: DataFrame) -> DataFrame:
    """``symbol_files`` with repeats: nothing is shuffled."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = entities.select("name", "path").unionByName(files.select(stem.alias("name"), "path"))
    return named.where(F.length("name") >= 3)


def symbol_targets(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, name, target): files, other than the caller, that declare a callee."""
    wanted = calls.select(F.col("path").alias("source"), F.col("callee").alias("name")).distinct()
    return wanted.join(symbols.withColumnRenamed("path", "target"), "name").where("source <> target")


def _marks(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, called, own): what each file calls and declares (own is 1),
    each name once; written. One shuffle tells both, and which callers declare the
    name themselves."""
    both = calls.select("path", F.col("callee").alias("name"), F.lit(1).alias("called"), F.lit(0).alias("own")).unionByName(
        symbols.select("path", "name", F.lit(0).alias("called"), F.lit(1).alias("own"))
    )
    return kept(both.groupBy("path", "name").agg(F.max("called").alias("called"), F.max("own").alias("own")), "marks")


def symbol_target_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, name, targets, first): for each caller and callee how many other
    files declare it, and the first of them by path. Declarations are counted by
    name, with the two first paths, so no pairs are made."""
    marks = _marks(calls, symbols)
    declared, wanted = marks.where("own = 1"), marks.where("called = 1").select(F.col("path").alias("source"), "name", "own")
    order = Window.partitionBy("name").orderBy("path")
    two = declared.select("name", "path").withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2)
    firsts = two.groupBy("name").agg(F.min("path").alias("one"), F.max(F.when(F.col("k") == 2, F.col("path"))).alias("two"))
    counts = declared.groupBy("name").agg(F.count("*").alias("n"))
    rows = wanted.join(counts.join(firsts, "name"), "name")
    first = F.when(F.col("one") == F.col("source"), F.col("two")).otherwise(F.col("one"))
    return rows.where("n > own").select("source", "name", (F.col("n") - F.col("own")).alias("targets"), first.alias("first"))


def bounded_targets(calls: DataFrame, symbols: DataFrame, most: int = 2, distant: bool = True) -> DataFrame:
    """(source, name, target, how): calls resolved without all-to-all edges.

    Generic verbs give nothing. One target is taken; of several, up to ``most``
    in the caller's directory, else up to ``most`` that share a word of the
    path, else none. Declarations are counted by name, by name and directory,
    and by name and word first; only callers whose counts allow it are joined
    with declarations, so a common name makes no pairs. The only target is the
    first or the last path of its name; directories and words are counted for
    names with several targets alone, and callers with a name's commonest word
    leave before their words are looked up.
    """
    place = lambda path: (folder(path).alias("dir"), stem_tokens(path).alias("words"))
    marks = _marks(calls, symbols)
    declared = marks.where("own = 1").select("name", F.col("path").alias("target"))
    by_name = declared.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("one"), F.max("target").alias("last"))
    callers = marks.where("called = 1").where(~F.lower("name").isin(*GENERIC_CALLS)).select(F.col("path").alias("source"), "name", "own").join(by_name, "name")
    callers = kept(callers.withColumn("n", F.col("n") - F.col("own")).where("n > 0"), "callers")
    unique = callers.where("n = 1").select("source", "name", F.when(F.col("one") == F.col("source"), F.col("last")).otherwise(F.col("one")).alias("target"))
    close = (folder(F.col("source")) == folder(F.col("target"))) | F.arrays_overlap(stem_tokens(F.col("source")), stem_tokens(F.col("target")))
    unique = unique.withColumn("how", F.lit("unique_symbol")) if distant else unique.where(close).withColumn("how", F.lit("path_resolved_unique_symbol"))
    several = callers.where("n > 1").select("source", "name", "own", folder(F.col("source")).alias("dir"))
    shared = declared.join(several.select("name").distinct(), "name", "left_semi").select("name", "target", *place(F.col("target")))
    shared = kept(shared, "shared-names")
    by_dir = shared.groupBy("name", "dir").agg(F.count("*").alias("n_near"))
    several = several.join(by_dir, ["name", "dir"], "left").na.fill(0, ["n_near"]).withColumn("n_near", F.col("n_near") - F.col("own"))
    several = kept(several, "several")
    beside = F.col("n_near").between(1, most)
    near = several.where(beside).select("source", "name", "dir").join(shared.select("name", "dir", "target"), ["name", "dir"]).where("source <> target")
    worded = shared.select("name", "target", F.explode("words").alias("word"))
    by_word = kept(worded.groupBy("name", "word").agg(F.count("*").alias("n_word")), "name-words")
    commonest = by_word.groupBy("name").agg(F.max_by("word", "n_word").alias("common"), F.max("n_word").alias("n_common"))
    far = several.where(~beside).select("source", "name", "own", stem_tokens(F.col("source")).alias("words")).join(commonest, "name")
    far = far.where(~(F.array_contains("words", F.col("common")) & (F.col("n_common") - F.col("own") > most)))
    far = kept(far.select("source", "name", "own", F.explode("words").alias("word")).join(by_word, ["name", "word"]), "far-words")
    few = far.groupBy("source", "name").agg(F.max(F.col("n_word") - F.col("own")).alias("top")).where(F.col("top").between(1, most)).select("source", "name")
    related = far.join(few, ["source", "name"], "left_semi").select("source", "name", "word").join(worded, ["name", "word"]).where("source <> target")
    related = related.select("source", "name", "target").distinct()
    counted = related.groupBy("source", "name").agg(F.count("*").alias("k")).where(F.col("k").between(1, most)).select("source", "name")
    related = related.join(counted, ["source", "name"], "left_semi")
    shown = lambda df, how: df.select("source", "name", "target", how.alias("how"))
    return shown(unique, F.col("how")).unionByName(shown(near, F.lit("same_directory_symbol"))).unionByName(shown(related, F.lit("path_related_symbol")))


def edge_summary(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(edge_type, n); with paths (path) edges at either end of them, an edge
    between two of them twice."""
    if paths is not None:
        known = paths.select("path").distinct()
        out = edges.join(known.withColumnRenamed("path", "source"), "source", "left_semi").select("edge_type")
        into = edges.join(known.withColumnRenamed("path", "target"), "target", "left_semi").select("edge_type")
        edges = out.unionByName(into)
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def mode_edges(edges: DataFrame, modes: DataFrame, mode: str) -> DataFrame:
    """Edges of the types of a mode (mode, edge_type); all, if it has none."""
    types = modes.where(F.col("mode") == mode).select("edge_type").distinct()
    return edges if types.isEmpty() else edges.join(types, "edge_type", "left_semi")


def node_tokens(files: DataFrame) -> DataFrame:
    """(path, tokens): distinct tokens of a node's path and text."""
    return files.select("path", F.array_distinct(tokens(F.lower(F.concat_ws(" ", "path", "text")))).alias("tokens"))


def expand(
    seeds: DataFrame,
    edges: DataFrame,
    nodes: DataFrame,
    terms: DataFrame,
    limit: int = 20,
    max_seeds: int = 16,
    max_edges: int = 120,
) -> DataFrame:
    """(instance_id, rank, path, score): the best neighbours of the seeds.

    Edges out count with their weight, edges in with 0.7 of it; each seed gives
    its heaviest ``max_edges``. A neighbour scores weight + min(5.4, 0.45 x terms
    that it holds) + 0.4 for five edge types, its best edge counting.
    seeds (instance_id, pos, path), terms (instance_id, terms array).
    """
    order = Window.partitionBy("instance_id").orderBy("pos", "path")
    first = seeds.groupBy("instance_id", "path").agg(F.min("pos").alias("pos")).withColumn("n", F.row_number().over(order))
    chosen = first.where(F.col("n") <= max_seeds).select("instance_id", F.col("path").alias("seed"))
    out = edges.select(F.col("source").alias("seed"), F.col("target").alias("path"), "edge_type", "edge_type", "weight").toDF("seed", "path", "base", "shown", "weight")
    into = edges.select(
        F.col("target").alias("seed"), F.col("source").alias("path"), F.col("edge_type").alias("base"), F.concat(F.lit("incoming_"), "edge_type").alias("shown"), (F.col("weight") * 0.7).alias("weight")
    )
    # The heaviest edges of a seed are the same for every instance: cut before the join.
    heavy = Window.partitionBy("seed").orderBy(F.desc("weight"), "shown", "path")
    wanted = out.unionByName(into).join(chosen.select("seed").distinct(), "seed", "left_semi")
    few = wanted.withColumn("n", F.row_number().over(heavy)).where(F.col("n") <= max_edges).drop("n")
    near = chosen.join(few, "seed").join(nodes, "path").join(terms, "instance_id")
    hits = F.size(F.array_intersect("tokens", "terms"))
    score = F.col("weight") + F.least(F.lit(5.4), 0.45 * hits) + F.when(F.col("base").isin(*BONUS_TYPES), 0.4).otherwise(0.0)
    best = near.groupBy("instance_id", "path").agg(F.round(F.max(score), 6).alias("score"))
    ranked = Window.partitionBy("instance_id").orderBy(F.desc("score"), "path")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit).select("instance_id", "rank", "path", "score")


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, node, hop): nodes within ``hops`` undirected steps of each seed
    (seed), each at its first hop. One join for each hop; visited nodes leave by
    an anti join."""
    step = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("next"))
    ).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct()
    front = seen
    for h in range(1, hops + 1):
        reached = front.join(step, "node").select("seed", F.col("next").alias("node")).distinct()
        front = reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen
