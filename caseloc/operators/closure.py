"""Small sets of files that together meet what a change has to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATHS = "array<string>"


def obligation_coverage(selected: DataFrame, obligations: DataFrame, covers: DataFrame) -> DataFrame:
    """(instance_id, required, covered, coverage, complete, missing_required,
    missing_advisory, alone): what the selected files (instance_id, path) cover of
    the obligations (instance_id, obligation, required) by covers (instance_id,
    path, obligation); alone: obligations that one file alone covers. An instance
    without obligations has no row."""
    own = selected.select("instance_id", "path").distinct().join(covers.distinct(), ["instance_id", "path"])
    by = own.groupBy("instance_id", "obligation").agg(F.count("*").alias("files"))
    rows = obligations.groupBy("instance_id", "obligation").agg(F.max("required").alias("required")).join(by, ["instance_id", "obligation"], "left").na.fill(0, ["files"])
    names = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("obligation"))))
    met, asked = F.col("files") > 0, F.col("required")
    sums = rows.groupBy("instance_id").agg(
        F.count_if(asked).alias("required"), F.count_if(asked & met).alias("covered"), names(asked & ~met).alias("missing_required"), names(~asked & ~met).alias("missing_advisory"),
        F.count_if(F.col("files") == 1).alias("alone"),
    )
    share = F.round(F.col("covered") / F.greatest(F.col("required"), F.lit(1)), 3)
    return sums.select("instance_id", "required", "covered", share.alias("coverage"), (F.size("missing_required") == 0).alias("complete"), "missing_required", "missing_advisory", "alone")


def modification_closure(
    covers: DataFrame, candidates: DataFrame, obligations: DataFrame, limit: int = 6, rounds: int = 3, per_round: int = 2, pool: int = 24
) -> DataFrame:
    """(instance_id, files, rounds, missing, status): for each instance a small set of
    the ``pool`` first candidates (instance_id, rank, path, extra, target,
    confidence) that covers its required obligations.

    The set starts with the first candidate. A round adds up to ``per_round`` files
    that cover something missing, by 5 for each such obligation and ``extra`` (then
    rank, path), and then takes out every file without which nothing more is
    missing: files that are no target first, then the least sure, then the last in
    rank; one always stays. Rounds end when all is covered or nothing can be added.
    status: complete, budget_exhausted or incomplete.

    A pool is bounded, so an instance is one row and a round a fold over it.
    """
    asked = obligations.where("required").select("instance_id", "obligation").distinct()
    need = asked.groupBy("instance_id").agg(F.array_sort(F.collect_set("obligation")).alias("need"))
    few = candidates.where(F.col("rank") <= pool)
    own = covers.join(asked, ["instance_id", "obligation"], "left_semi").join(few.select("instance_id", "path"), ["instance_id", "path"], "left_semi")
    lists = own.groupBy("instance_id", "path").agg(F.array_sort(F.collect_set("obligation")).alias("own"))
    rows = few.join(lists, ["instance_id", "path"], "left").withColumn("own", F.coalesce("own", F.array().cast(_PATHS)))
    packed = F.struct("rank", "path", F.col("extra").cast("double").alias("extra"), "target", F.col("confidence").cast("double").alias("confidence"), "own")
    each = rows.groupBy("instance_id").agg(F.sort_array(F.collect_list(packed)).alias("pool")).join(need, "instance_id", "left")
    each = each.withColumn("need", F.coalesce("need", F.array().cast(_PATHS)))

    def missing(chosen: Column) -> Column:
        held = F.flatten(F.transform(F.filter("pool", lambda c: F.array_contains(chosen, c["path"])), lambda c: c["own"]))
        return F.array_except("need", held)

    def grown(state: Column) -> Column:
        gap = missing(state["files"])
        score = lambda c: 5.0 * F.size(F.array_intersect(c["own"], gap)) + c["extra"]
        useful = F.filter("pool", lambda c: F.arrays_overlap(c["own"], gap) & ~F.array_contains(state["files"], c["path"]))
        best = F.array_sort(F.transform(useful, lambda c: F.struct((-score(c)).alias("s"), c["rank"].alias("rank"), c["path"].alias("path"))))
        return F.transform(F.slice(best, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(per_round), limit - F.size(state["files"])))), lambda x: x["path"])

    def thinned(files: Column) -> Column:
        weak = F.filter("pool", lambda c: F.array_contains(files, c["path"]))
        order = F.array_sort(F.transform(weak, lambda c: F.struct(c["target"].alias("t"), c["confidence"].alias("c"), (-c["rank"]).alias("r"), c["path"].alias("path"))))

        def one(left: Column, x: Column) -> Column:
            without = F.array_remove(left, x["path"])
            spare = (F.size(left) > 1) & (F.size(missing(without)) == F.size(missing(left)))
            return F.when(spare, without).otherwise(left)

        return F.aggregate(order, files, one)

    state = lambda files, done, more: F.struct(files.alias("files"), done.alias("done"), more.cast("int").alias("rounds"))
    each = each.withColumn("state", state(F.transform(F.slice("pool", 1, 1), lambda c: c["path"]), F.lit(False), F.lit(0)))
    # Rounds are columns and not a fold, so that each is computed once.
    for _ in range(rounds):
        now = F.col("state")
        each = each.withColumn("added", F.when(~now["done"], grown(now)).otherwise(F.array().cast(_PATHS)))
        files = thinned(F.concat(now["files"], F.col("added")))
        each = each.withColumn("thin", F.when(now["done"], now["files"]).otherwise(files))
        over = now["done"] | (F.size("added") == 0) | (F.size(missing(F.col("thin"))) == 0)
        each = each.withColumn("state", state(F.col("thin"), over, now["rounds"] + F.when(now["done"], 0).otherwise(1)))
    gap = missing(F.col("state.files"))
    status = F.when(F.size(gap) == 0, "complete").when((F.col("state.rounds") >= rounds) & (F.size("added") > 0), "budget_exhausted").otherwise("incomplete")
    return each.select("instance_id", F.array_sort("state.files").alias("files"), F.col("state.rounds").alias("rounds"), gap.alias("missing"), status.alias("status"))
