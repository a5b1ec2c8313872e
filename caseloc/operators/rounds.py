"""Rankings of several rounds brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens

# Places of the head that stay, replacements, and how much better a challenger must be.
LOCKED, REPLACEMENTS, MARGIN = 5, 2, 0.75
TARGETS = ("patch_target", "supporting_target")


def frontier_quality(rounds: DataFrame, selected: DataFrame, flags: DataFrame, issues: DataFrame, top_k: int = 15) -> DataFrame:
    """(instance_id, path, quality, best, strong, selected_rank) of all paths that are
    selected (instance_id, rank, path) or among the first max(8, top_k) of a round
    (instance_id, round_no, rank, path, direct).

    Places in rounds and in the selection, evidence (flags: instance_id, path, read,
    grounded, mechanism, role, confidence) and words of the path in the report
    (issues: instance_id, issue_text) add up. A challenger must be strong: a
    verified mechanism, a sure grounded target, or read and direct with a word of
    the report or two rounds.
    """
    placed = rounds.where(F.col("rank") <= max(8, top_k)).groupBy("instance_id", "path").agg(
        F.sum(12.0 / (8.0 + F.col("rank"))).alias("places"), F.count("*").alias("times"), F.min("rank").alias("best"), F.max("direct").alias("direct")
    )
    own = selected.where(F.col("rank") <= top_k).select("instance_id", "path", F.col("rank").alias("selected_rank"))
    # A report is read once, not for each path, and only if it has paths.
    low = F.lower(F.replace(F.coalesce(F.try_url_decode("issue_text"), "issue_text", F.lit("")), F.lit("\\"), F.lit("/")))
    long = lambda text: F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 4))
    asked = placed.select("instance_id").unionByName(own.select("instance_id")).distinct()
    told = issues.join(asked, "instance_id", "left_semi").select("instance_id", low.alias("low")).select("instance_id", "low", long(F.col("low")).alias("words"))
    rows = placed.join(own, ["instance_id", "path"], "full").join(flags, ["instance_id", "path"], "left").join(told, "instance_id", "left")
    rows = rows.withColumn("low", F.coalesce("low", F.lit(""))).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    rows = rows.na.fill(False, ["direct", "read", "grounded", "mechanism"]).na.fill(0.0, ["places", "confidence"]).na.fill(0, ["times"])
    rows = rows.withColumn("shared", F.size(F.array_intersect(long(F.lower("path")), "words")))
    grounded = F.col("grounded") & F.col("read")
    mechanism = F.col("mechanism") & grounded
    exact = (F.col("path") != "") & F.contains(F.col("low"), F.lower("path"))
    worth = lambda test, value: F.when(test, value).otherwise(0.0)
    quality = (
        F.col("places") + F.least(F.lit(4.0), F.col("times") * 0.7) + 8.0 / F.greatest(F.lit(1), F.coalesce("best", F.lit(top_k + 1)))
        + F.coalesce(10.0 / F.col("selected_rank"), F.lit(0.0)) + worth(F.col("read"), 2.0) + worth(F.col("direct"), 1.5) + worth(grounded, 3.0) + worth(mechanism, 8.0)
        + F.when(exact, 8.0).otherwise(F.least(F.lit(3.0), F.col("shared") * 1.2))
    )
    sure = grounded & F.col("role").isin(*TARGETS) & (F.col("confidence") >= 0.62)
    strong = mechanism | F.coalesce(sure, F.lit(False)) | (F.col("read") & F.col("direct") & (exact | (F.col("shared") > 0) | (F.col("times") >= 2)))
    return rows.select("instance_id", "path", F.round(quality, 6).alias("quality"), "best", strong.alias("strong"), "selected_rank")


def cross_round_frontier(qualities: DataFrame, locked: int = LOCKED, most: int = REPLACEMENTS, margin: float = MARGIN) -> DataFrame:
    """(instance_id, rank, path, replaced): the selection of ``frontier_quality`` with
    at most ``most`` places behind the first ``locked`` given to strong paths from
    other rounds.

    The k-th best challenger meets the k-th weakest place; both lists are sorted, so
    as soon as one is not better by ``margin`` no later one is, and pairing by two
    row numbers gives the same as one after the other.
    """
    order = Window.partitionBy("instance_id")
    chosen = qualities.where("selected_rank IS NOT NULL")
    new = qualities.where("selected_rank IS NULL AND strong").withColumn("k", F.row_number().over(order.orderBy(F.desc("quality"), "best", "path"))).where(F.col("k") <= most)
    tail = chosen.where(F.col("selected_rank") > locked).withColumn("k", F.row_number().over(order.orderBy("quality", F.desc("selected_rank")))).where(F.col("k") <= most)
    met = tail.select("instance_id", "k", "selected_rank", F.col("quality").alias("held")).join(new.select("instance_id", "k", F.col("path").alias("added"), F.col("quality").alias("asked")), ["instance_id", "k"])
    won = met.where(F.col("asked") >= F.col("held") + margin).select("instance_id", "selected_rank", "added")
    out = chosen.join(won, ["instance_id", "selected_rank"], "left")
    return out.select(
        "instance_id", F.col("selected_rank").alias("rank"), F.coalesce("added", "path").alias("path"), F.when(F.col("added").isNotNull(), F.col("path")).alias("replaced")
    )
