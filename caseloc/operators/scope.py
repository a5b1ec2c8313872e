"""The scope of a graph: the files of each instance worth building edges for.

Cheap searches of all kinds are added up over all instances at once; each is
bounded for each instance before the sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import dealt, kept
from ..functions.text import normalize_path
from . import search as S
from .policy import path_role, source_weights
from .terms import clean_query, path_semantic

# Files of a scope, queries, path probes and semantic paths of an instance, and neighbours.
LIMIT, QUERIES, PROBES, SEMANTIC, PER_DIR, NEIGHBOURS = 120, 64, 90, 80, 6, 36


def prefilter_queries(queries: DataFrame, seeds: DataFrame, most: int = QUERIES) -> DataFrame:
    """(instance_id, query): the paths of the seeds, then the cleaned queries
    (instance_id, pos, query), one for each spelling, ``most`` in all."""
    order = Window.partitionBy("instance_id").orderBy("path")
    own = seeds.select("instance_id", "path").distinct().withColumn("at", F.row_number().over(order))
    rows = own.select("instance_id", F.struct(F.lit(0).alias("g"), F.col("at").cast("long").alias("p")).alias("place"), F.col("path").alias("query")).unionByName(
        queries.select("instance_id", F.struct(F.lit(1).alias("g"), F.col("pos").cast("long").alias("p")).alias("place"), clean_query("query").alias("query")).where("query <> ''")
    )
    once = rows.groupBy("instance_id", F.lower("query").alias("low")).agg(F.min(F.struct("place", "query")).alias("x")).select("instance_id", "x.*")
    over = Window.partitionBy("instance_id").orderBy("place", "query")
    return once.withColumn("n", F.row_number().over(over)).where(F.col("n") <= most).select("instance_id", "query")


def semantic_paths(terms: DataFrame, files: DataFrame, most: int = SEMANTIC) -> DataFrame:
    """(instance_id, path, score): paths with the terms (instance_id, term; single
    words in lower case), the ``most`` best. Paths meet terms by an index of words,
    and are scored once for all instances with the same terms."""
    wanted = terms.select(F.col("term").alias("token")).distinct()
    posted = S.postings(files.select("path", normalize_path("path").alias("text")))
    lists = kept(terms.groupBy("instance_id").agg(F.sort_array(F.collect_set("term")).alias("terms")), "scope-terms")
    once = kept(lists.select("terms").distinct().withColumn("id", F.monotonically_increasing_id()), "term-lists")
    met = once.select("id", F.explode("terms").alias("token")).join(S.token_counts(wanted, posted), "token").select("id", "path").distinct()
    rows = dealt(met, "path").join(once, "id").select("id", "path", path_semantic(F.col("path"), F.col("terms")).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "path")
    best = rows.where("score > 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return lists.join(once, "terms").join(best, "id").select("instance_id", "path", "score")


def graph_scope(
    queries: DataFrame, files: DataFrame, entities: DataFrame, seeds: DataFrame, terms: DataFrame, issues: DataFrame, limit: int = LIMIT, top_k: int = 15
) -> DataFrame:
    """(instance_id, rank, path, score, channels): at most ``limit`` files of each
    instance (issues: instance_id, issue_text).

    Added up: the file search, the entity search x 1.25, seeds (80, 79, ... down to
    20), 45 for each query that is a path, path probes, semantic paths, and 4 for
    files beside the best of these. Then roles scale and cap the sum. An instance
    that nothing is found for has the first files by path at 0.1.
    """
    hit_limit = max(limit, 8 * top_k, 30)
    asked = kept(prefilter_queries(queries, seeds), "scope-queries")
    q = asked.withColumnRenamed("instance_id", "query_id")
    named = lambda df, channel, score: df.select("instance_id", "path", score.cast("double").alias("score"), F.lit(channel).alias("channel"))
    back = lambda df: df.withColumnRenamed("query_id", "instance_id")
    order = Window.partitionBy("instance_id").orderBy("path")
    at = F.row_number().over(order) - 1
    probes = kept(back(S.path_probe(q, files, PROBES)), "scope-probes")
    exact = asked.select("instance_id", normalize_path("query").alias("path"))
    parts = [
        named(back(S.search_files(q, files, hit_limit)), "file", F.col("score")),
        named(back(S.search_entities(q, entities, hit_limit)), "entity", F.col("score") * 1.25),
        named(seeds.select("instance_id", "path").distinct().withColumn("at", at), "seed", F.greatest(F.lit(20), 80 - F.col("at"))),
        named(exact, "exact_path", F.lit(45.0)),
        named(probes, "path_probe", F.col("score")),
        named(semantic_paths(terms, files), "path_semantic", F.col("score")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = kept(rows.join(files.select("path").distinct(), "path", "left_semi"), "scope-rows")
    total = rows.groupBy("instance_id", "path").agg(F.sum("score").alias("score"))
    best = Window.partitionBy("instance_id").orderBy(F.desc("score"), "path")
    few = max(top_k, 12)
    top = total.withColumn("score", F.round("score", 6)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= few).select("instance_id", "path")
    near = top.unionByName(probes.where(F.col("rank") <= few).select("instance_id", "path")).distinct().withColumnRenamed("instance_id", "query_id")
    beside = back(S.same_dir_neighbors(near, files, PER_DIR, NEIGHBOURS))
    rows = rows.unionByName(named(beside, "same_directory", F.lit(4.0)))
    summed = rows.groupBy("instance_id", "path").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    told = summed.join(issues.select("instance_id", "issue_text"), "instance_id", "left")
    factor, cap = source_weights(path_role(F.col("path")), F.col("path"), F.col("issue_text"))
    scaled = told.withColumn("factor", factor).withColumn("cap", cap).withColumn("score", F.col("score") * F.col("factor"))
    scaled = scaled.withColumn("score", F.round(F.when(F.col("cap").isNotNull(), F.least("score", "cap")).otherwise(F.col("score")), 6))
    ranked = scaled.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("instance_id", "rank", "path", "score", "channels")
    first = [r.path for r in files.select("path").distinct().orderBy("path").limit(limit).collect()]
    lost = issues.select("instance_id").distinct().join(summed.select("instance_id").distinct(), "instance_id", "left_anti")
    names = F.array(*map(F.lit, first)) if first else F.array().cast("array<string>")
    rest = lost.select("instance_id", F.posexplode(names).alias("at", "path"))
    return ranked.unionByName(rest.select("instance_id", (F.col("at") + 1).alias("rank"), "path", F.lit(0.1).alias("score"), F.array(F.lit("fallback")).alias("channels")))
