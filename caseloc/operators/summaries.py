"""Small tables read off evidence, rounds, flows and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_path
from .evidence import modality
from .flows import BLOCKED_ROLES, role_rank
from .metrics import unique_gold, unique_ranked


def evidence_modality(issues: DataFrame, links: DataFrame) -> DataFrame:
    """(instance_id, urls, images, modality) of every issue; links (instance_id,
    is_image)."""
    sums = links.groupBy("instance_id").agg(F.count_if(~F.col("is_image")).alias("urls"), F.count_if(F.col("is_image")).alias("images"))
    rows = issues.select("instance_id").distinct().join(sums, "instance_id", "left").na.fill(0, ["urls", "images"])
    return rows.select("instance_id", "urls", "images", modality(F.col("urls"), F.col("images")).alias("modality"))


def elapsed_totals(attempts: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(elapsed_seconds): of all attempts and failures, not of the latest only."""
    rows = attempts.select("elapsed_seconds")
    if failures is not None:
        rows = rows.unionByName(failures.select("elapsed_seconds"))
    return rows.agg(F.round(F.sum("elapsed_seconds").cast("double"), 2).alias("elapsed_seconds"))


def gold_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(instance_id, rank, item, found): predictions that are gold, numbered in
    order of their rank."""
    hits = unique_ranked(ranked).join(unique_gold(gold), ["instance_id", "item"])
    return hits.withColumn("found", F.row_number().over(Window.partitionBy("instance_id").orderBy("rank"))).select("instance_id", "rank", "item", "found")


def set_metrics(ranked: DataFrame, gold: DataFrame, cuts: tuple[int | None, ...] = (8, 10, 15, None)) -> DataFrame:
    """(instance_id, cut, sl, recall, precision, f1) of the first ``cut``
    predictions as a set (cut null: all). Precision is of the set's own size; sl
    is 1 if all gold is in it. Without gold all are 0."""
    rows, known = unique_ranked(ranked), unique_gold(gold).withColumn("hit", F.lit(1))
    marked = rows.join(known, ["instance_id", "item"], "left")
    counts = known.groupBy("instance_id").agg(F.count("*").alias("gold"))
    cut = F.explode(F.array(*[F.struct(F.lit(c).cast("int").alias("cut")) for c in cuts])).alias("c")
    each = marked.select("instance_id", "rank", "hit", cut).withColumn("cut", F.col("c.cut")).where(F.col("cut").isNull() | (F.col("rank") <= F.col("cut")))
    sums = each.groupBy("instance_id", "cut").agg(F.count("*").alias("size"), F.count("hit").alias("hits")).join(counts, "instance_id", "left").na.fill(0, ["gold"])
    recall = F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0)
    precision = F.when((F.col("gold") > 0) & (F.col("size") > 0), F.col("hits") / F.col("size")).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    sl = ((F.col("gold") > 0) & (F.col("hits") == F.col("gold"))).cast("double")
    return sums.select("instance_id", "cut", sl.alias("sl"), F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))


def evidence_gain(rounds: DataFrame) -> DataFrame:
    """(instance_id, round_no, gained, stale): how many signature items (item) a
    round has that the one before had not, and how many rounds in a row, up to
    this, gained nothing. The first round gains all it has."""
    sets = rounds.groupBy("instance_id", "round_no").agg(F.collect_set("item").alias("items"))
    order = Window.partitionBy("instance_id").orderBy("round_no")
    before = F.coalesce(F.lag("items").over(order), F.array().cast("array<string>"))
    gained = sets.withColumn("gained", F.size(F.array_except("items", before)))
    # Rounds without a gain since the last that had one: their islands.
    island = gained.withColumn("island", F.count_if(F.col("gained") > 0).over(order))
    stale = F.count_if(F.col("gained") == 0).over(Window.partitionBy("instance_id", "island").orderBy("round_no"))
    return island.select("instance_id", "round_no", "gained", stale.alias("stale"))


def overlap_tokens(left: Column, right: Column) -> Column:
    """Words that both texts have, sorted."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z_][a-z0-9_]{2,}"), F.lit(0)))
    return F.array_sort(F.array_intersect(words(left), words(right)))


def relation_summary(edges: DataFrame, most: int = 20) -> DataFrame:
    """(rank, relation, edges, terms, weight): relations of all flows by count."""
    sums = edges.groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("term").alias("terms"), F.round(F.sum("weight"), 3).alias("weight"))
    order = Window.orderBy(F.desc("edges"), "relation")  # one row for each relation
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def round_observation(edges: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    """(term, facet, value, n): counts of each facet of a round."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])).alias("x")
    return edges.select("term", each).groupBy("term", "x.facet", "x.value").agg(F.count("*").alias("n"))


def target_support(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, path, reasons): the distinct roles and relations that speak for a
    path, in order; steps in context roles say nothing."""
    own = steps.where(~F.col("role").isin(*BLOCKED_ROLES)).select("term", "path", F.concat(F.lit("role:"), "role").alias("reason"))
    ends = edges.select("term", F.explode(F.array("source", "target")).alias("path"), F.concat(F.lit("edge:"), "relation").alias("reason"))
    return own.unionByName(ends).groupBy("term", "path").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def role_order(locations: DataFrame, most: int = 16) -> DataFrame:
    """(term, rank, path, role): locations by the place of their role, without
    context roles, at most ``most`` for each term."""
    rows = locations.where(~F.col("role").isin(*BLOCKED_ROLES)).select("term", "path", "role").distinct()
    order = Window.partitionBy("term").orderBy(role_rank(F.col("role")), "path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("term", "rank", "path", "role")


def merged_reviews(reviews: DataFrame) -> DataFrame:
    """The strongest review of each path over all rounds (instance_id, path,
    round_no, mechanism_verified, grounded, confidence, axes): by mechanism,
    grounding, confidence and number of axes; of equal ones the earliest."""
    strength = F.struct("mechanism_verified", "grounded", "confidence", "axes", (-F.col("round_no")).alias("early"))
    columns = [c for c in reviews.columns if c not in ("instance_id", "path")]
    best = reviews.groupBy("instance_id", "path").agg(F.max_by(F.struct(*columns), strength).alias("x"))
    return best.select("instance_id", "path", "x.*")


def patch_set_summary(rows: DataFrame) -> DataFrame:
    """(samples, mean_size, mean_coverage) over results with a final set."""
    final = rows.where("final_patch_count > 0")
    return final.agg(F.count("*").alias("samples"), F.round(F.avg("final_patch_count"), 6).alias("mean_size"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def seed_paths(links: DataFrame) -> DataFrame:
    """(instance_id, path): repository paths that evidence names: of code seeds
    and reproduction entries, not absolute ones."""
    wanted = links.where(F.col("role").isin("code_evidence_seed", "reproduction_entry") & (F.col("path") != "") & ~F.col("path").startswith("/"))
    return wanted.select("instance_id", normalize_path("path").alias("path")).where("path <> ''").distinct()


def resolve_code_urls(links: DataFrame, issues: DataFrame, files: DataFrame, around: int = 40) -> DataFrame:
    """(instance_id, url, path, first, last, status) of links (instance_id, url,
    repo, path, line) against the issue's own repository (issues: instance_id,
    repo; files: repo, path, lines): whether the file is there and which lines to
    show around the one that is named."""
    placed = links.join(issues.select("instance_id", F.col("repo").alias("own_repo")), "instance_id", "left")
    known = files.select(F.col("repo").alias("own_repo"), "path", "lines")
    found = placed.join(known, ["own_repo", "path"], "left")
    status = (
        F.when(F.coalesce(F.col("path"), F.lit("")) == "", "missing_path")
        .when(F.lower("repo") != F.lower(F.coalesce("own_repo", F.lit(""))), "repo_mismatch")
        .when(F.col("lines").isNull(), "file_not_found")
        .when(F.col("line").isNull(), "resolved_file")
        .when(F.col("line") > F.col("lines"), "line_out_of_range")
        .otherwise("resolved_lines")
    )
    at = F.when(status == "resolved_lines", F.col("line"))
    return found.select(
        "instance_id", "url", "path", F.greatest(F.lit(1), at - around).alias("first"), F.least("lines", at + around).alias("last"), status.alias("status")
    )


def custom_fusion(hits: DataFrame, weights: dict[str, str]) -> DataFrame:
    """(instance_id, item, score): hits (instance_id, channel, item, score, rank)
    summed by a user's own SQL expression for each channel, over score and rank;
    channels without one count nothing."""
    part = None
    for channel, expression in weights.items():
        test = F.col("channel") == channel
        part = F.when(test, F.expr(expression)) if part is None else part.when(test, F.expr(expression))
    return hits.withColumn("part", part.otherwise(0.0)).groupBy("instance_id", "item").agg(F.round(F.sum("part"), 6).alias("score"))


def reevaluated(metrics: DataFrame) -> DataFrame:
    """metrics with status: ``scored``, or ``skipped`` for a result without gold,
    whose metrics say nothing and are null."""
    scored = F.col("gold_count") > 0
    names = [c for c in metrics.columns if c not in ("instance_id", "gold_count", "pred_count")]
    return metrics.select("instance_id", F.when(scored, "scored").otherwise("skipped").alias("status"), *[F.when(scored, F.col(f"`{c}`")).alias(c) for c in names])


def flow_coverage(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """(term, covered, missing, share): states (term, state) that a flow speaks
    of: one of their words, of three letters or more, is among the flow's
    (words: term, word)."""
    parts = wanted.select("term", "state", F.explode(F.filter(F.split(F.lower("state"), r"[^a-z0-9_]+"), lambda t: F.length(t) >= 3)).alias("word")).distinct()
    hit = parts.join(words.select("term", "word").distinct(), ["term", "word"], "left_semi").select("term", "state").distinct().withColumn("hit", F.lit(True))
    rows = wanted.select("term", "state").distinct().join(hit, ["term", "state"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    named = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("state")))), ",")
    return rows.groupBy("term").agg(named(F.col("hit")).alias("covered"), named(~F.col("hit")).alias("missing"), F.round(F.avg(F.col("hit").cast("double")), 3).alias("share"))


def obligation_check(candidates: DataFrame, files: DataFrame, most: int = 30) -> DataFrame:
    """(term, path, score, matched) of the first ``most`` candidates (term, pos,
    path, words): 5 for each word, of three letters or more, in the path, 0.8 for
    each of its first six occurrences in path and text; those without any score
    are left out."""
    order = Window.partitionBy("term").orderBy("pos", "path")
    few = candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).join(files.select("path", "text"), "path")
    low, hay = F.lower("path"), F.lower(F.concat_ws("\n", "path", "text"))
    words = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: F.length(w) >= 3)
    times = lambda w: (F.length(hay) - F.length(F.replace(hay, w, F.lit("")))) / F.length(w)
    score = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.when(low.contains(w), 5.0).otherwise(0.0) + 0.8 * F.least(times(w), F.lit(6.0)))
    matched = F.array_join(F.filter(words, lambda w: hay.contains(w)), ",")
    return few.select("term", "path", F.round(score, 3).alias("score"), matched.alias("matched")).where("score > 0")
