"""Scores of rankings against known answers, attempts and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_path

KS = tuple(range(1, 16))
CUTOFFS = ("8", "10", "15", "all")


def unique_ranked(ranked: DataFrame) -> DataFrame:
    """(instance_id, rank, item): items normalised, empty and repeated ones
    dropped, then ranks assigned anew."""
    rows = ranked.select("instance_id", "rank", normalize_path("item").alias("item")).where("item <> ''")
    first = rows.groupBy("instance_id", "item").agg(F.min("rank").alias("at"))
    order = Window.partitionBy("instance_id").orderBy("at", "item")
    return first.select("instance_id", F.row_number().over(order).alias("rank"), "item")


def unique_gold(gold: DataFrame) -> DataFrame:
    return gold.select("instance_id", normalize_path("item").alias("item")).where("item <> ''").distinct()


def rank_metrics(instances: DataFrame, ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row for each of ``instances``: gold_count, pred_count, acc@k,
    strict_acc@k, recall@k, mrr@15, map@15 and set metrics at the cutoffs.

    An instance without gold has zeros; MAP divides by the gold count. Ranks and
    gold meet in one join and one grouped aggregate.
    """
    ranked, gold = unique_ranked(ranked), unique_gold(gold)
    golds = gold.groupBy("instance_id").agg(F.count("*").alias("g"))
    hits = ranked.join(gold.withColumn("hit", F.lit(1)), ["instance_id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(Window.partitionBy("instance_id").orderBy("rank"))
    hits = hits.withColumn("found", so_far)
    top = [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks]
    cuts = [
        x
        for c in CUTOFFS
        for x in (
            F.sum(F.lit(1) if c == "all" else (F.col("rank") <= int(c)).cast("int")).alias(f"n_{c}"),
            F.sum(F.col("hit") if c == "all" else F.when(F.col("rank") <= int(c), F.col("hit")).otherwise(0)).alias(f"s_{c}"),
        )
    ]
    by_instance = hits.groupBy("instance_id").agg(
        F.count("*").alias("p"),
        F.min(F.when((F.col("hit") == 1) & (F.col("rank") <= 15), F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= 15), F.col("found") / F.col("rank")).otherwise(0.0)).alias("precision"),
        *top,
        *cuts,
    )
    rows = instances.select("instance_id").distinct().join(golds, "instance_id", "left").join(by_instance, "instance_id", "left").na.fill(0)
    known = F.col("g") > 0
    share = lambda a, b: F.when(known & (b > 0), a / b).otherwise(0.0)
    flag = lambda test: F.when(known & test, 1.0).otherwise(0.0)
    out = [F.col("g").cast("double").alias("gold_count"), F.col("p").cast("double").alias("pred_count")]
    for k in ks:
        h = F.col(f"h{k}")
        out += [
            flag(h > 0).alias(f"acc@{k}"),
            flag(h == F.col("g")).alias(f"strict_acc@{k}"),
            F.round(share(h, F.col("g")), 6).alias(f"recall@{k}"),
        ]
    for c in CUTOFFS:
        n, s = F.col(f"n_{c}"), F.col(f"s_{c}")
        rec, pre = share(s, F.col("g")), share(s, n)
        out += [
            flag(s == F.col("g")).alias(f"set_sl@{c}"),
            F.round(rec, 6).alias(f"set_rec@{c}"),
            F.round(pre, 6).alias(f"set_pre@{c}"),
            F.round(F.when(rec + pre > 0, 2 * rec * pre / (rec + pre)).otherwise(0.0), 6).alias(f"set_f1@{c}"),
        ]
    # ``first`` was filled with 0 where nothing was found.
    out += [
        F.round(F.when(known & (F.col("first") > 0), 1.0 / F.col("first")).otherwise(0.0), 6).alias("mrr@15"),
        F.round(share(F.col("precision"), F.col("g")), 6).alias("map@15"),
    ]
    return rows.select("instance_id", *out)


def metric_summary(metrics: DataFrame) -> DataFrame:
    """(metric, mean): averages over all rows, and ``empty``: the share of rows
    without a prediction."""
    names = [c for c in metrics.columns if c != "instance_id"]
    wide = metrics.withColumn("empty", (F.col("pred_count") <= 0).cast("double"))
    long = wide.unpivot([], [*names, "empty"], "metric", "value")
    return long.where("value is not null").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"))


# --- attempts -----------------------------------------------------------------


def latest_attempt(attempts: DataFrame, keep: tuple[str, ...] = ("status", "elapsed_seconds")) -> DataFrame:
    """One row for each instance of attempts (seq, instance_id, status, ...): an
    ok one beats any other, then the last one wins. Rows without an instance all
    stay."""
    ok = F.coalesce("status", F.lit("ok")) == "ok"
    row = F.struct("seq", *keep)
    best = attempts.where("instance_id is not null").groupBy("instance_id").agg(F.max_by(row, F.struct(ok.alias("ok"), "seq")).alias("x"))
    named = best.select("instance_id", "x.*")
    return named.unionByName(attempts.where("instance_id is null").select("instance_id", "seq", *keep))


def status_counts(attempts: DataFrame) -> DataFrame:
    """Counts of ok, partial and failed rows and all seconds spent."""
    status = F.coalesce("status", F.lit("ok"))
    return attempts.agg(
        F.count("*").alias("n"),
        F.count_if(status == "ok").alias("ok"),
        F.count_if(status == "partial").alias("partial"),
        F.count_if(~status.isin("ok", "partial")).alias("failed"),
        F.round(F.sum("elapsed_seconds"), 2).alias("elapsed_seconds"),
    )


def pending(issues: DataFrame, attempts: DataFrame) -> DataFrame:
    """Issues without an attempt that ended well."""
    done = attempts.where(F.coalesce("status", F.lit("ok")) == "ok").select("instance_id").distinct()
    return issues.join(done, "instance_id", "left_anti")


def failure_rows(failures: DataFrame, rows: DataFrame) -> DataFrame:
    """(instance_id, seq): the latest failure of each instance without a row."""
    last = failures.groupBy("instance_id").agg(F.max("seq").alias("seq"))
    return last.join(rows.select("instance_id").distinct(), "instance_id", "left_anti")


def select_issues(issues: DataFrame, ids: list | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The wanted ids, then offset and limit in order of instance_id."""
    out = issues if ids is None else issues.where(F.col("instance_id").isin(ids))
    out = out.orderBy("instance_id")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


# --- gold from changed lines --------------------------------------------------


def changed_lines(patches: DataFrame) -> DataFrame:
    """(instance_id, path, line) of patches (instance_id, patch) in unified form.

    A cursor runs over the new side: an added line counts itself, a removed one
    maps to the cursor (1 at least), and marks of a missing line end are ignored.
    """
    rows = patches.select("instance_id", F.posexplode(F.split("patch", "\n")).alias("no", "row"))
    run = Window.partitionBy("instance_id").orderBy("no")
    header = F.col("row").startswith("+++ ")
    hunk = F.regexp_extract("row", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    rows = rows.withColumn(
        "file", F.last(F.when(header, F.regexp_replace(F.regexp_extract("row", r"^\+\+\+ (\S+)", 1), "^b/", "")), True).over(run)
    ).withColumn("hunk_no", F.last(F.when(hunk != "", F.col("no")), True).over(run)).withColumn(
        "start", F.last(F.when(hunk != "", hunk.cast("int")), True).over(run)
    )
    # One order serves all: places in a hunk are counted from the patch's beginning, less the count at the hunk's.
    mark = F.substring("row", 1, 1)
    inside = F.col("hunk_no").isNotNull() & (F.col("no") > F.col("hunk_no")) & ~header & ~F.col("row").startswith("--- ") & ~F.col("row").startswith("diff ")
    body = rows.withColumn("mark", F.when(inside, mark)).select("instance_id", "no", "file", "hunk_no", "start", "mark")
    passed = F.coalesce(F.sum(F.when(F.col("mark").isin("+", " "), 1).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = body.withColumn("passed", passed).withColumn("before", F.last(F.when(F.col("no") == F.col("hunk_no"), F.col("passed")), True).over(run))
    at = body.where(F.col("mark").isin("+", "-")).withColumn("line", F.greatest(F.col("start") + F.col("passed") - F.col("before"), F.lit(1)))
    return at.select("instance_id", F.col("file").alias("path"), "line").distinct()


def lines_in_entities(lines: DataFrame, entities: DataFrame, bucket: int = 64) -> DataFrame:
    """lines (path, line) with the entities (path, kind, name, start_line,
    end_line) that hold them. Entities are dealt to buckets of lines, so the
    range join has an equality key however long a file is."""
    spread = entities.withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket)))
    )
    keyed = lines.withColumn("bucket", F.floor(F.col("line") / bucket))
    return keyed.join(spread, ["path", "bucket"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("bucket")


def innermost_entity(lines: DataFrame, entities: DataFrame) -> DataFrame:
    """(path, line, kind, name): the smallest span that holds each line."""
    held = lines_in_entities(lines, entities)
    best = held.groupBy("path", "line").agg(
        F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line", "kind", "name")).alias("x")
    )
    return best.select("path", "line", "x.kind", "x.name")


def gold_sets(lines: DataFrame, entities: DataFrame) -> DataFrame:
    """(instance_id, level, item) from changed lines (instance_id, path, line):
    files; classes (a file without one stands for itself) as modules; functions
    and methods."""
    held = lines_in_entities(lines, entities)
    name = F.concat_ws(":", F.concat("path", F.lit("::"), "kind"), "name")
    modules = held.where(F.col("kind").isin("class", "module")).select("instance_id", "path", name.alias("item")).distinct()
    files = lines.select("instance_id", "path").distinct()
    alone = files.join(modules, ["instance_id", "path"], "left_anti").select("instance_id", F.concat("path", F.lit("::module:__file__")).alias("item"))
    functions = held.where(F.col("kind").isin("function", "method")).select("instance_id", name.alias("item")).distinct()
    level = lambda df, n: df.select("instance_id", F.lit(n).alias("level"), "item")
    return (
        level(files.withColumnRenamed("path", "item"), "file")
        .unionByName(level(modules, "module"))
        .unionByName(level(alone, "module"))
        .unionByName(level(functions, "function"))
    )


def applicability(gold: DataFrame, instances: DataFrame) -> DataFrame:
    """(instance_id, n_file, n_module, n_function, reason): what a gold set can
    be scored on."""
    counts = gold.groupBy("instance_id").agg(*[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("file", "module", "function")])
    rows = instances.select("instance_id").distinct().join(counts, "instance_id", "left").na.fill(0)
    reason: Column = (
        F.when(F.col("n_file") == 0, "no_gold").when(F.col("n_function") == 0, "no_function_covers_the_change").otherwise("applicable")
    )
    return rows.select("*", reason.alias("reason"))
