"""Report tables: zero rows for failures, percentages, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def zero_rows(failures: DataFrame, metrics: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each failure without a metric row: every metric 0, only the
    gold count is kept."""
    names = [c for c in metrics.columns if c not in ("instance_id", "gold_count")]
    counts = gold.groupBy("instance_id").agg(F.count("*").cast("double").alias("gold_count"))
    missing = failures.select("instance_id").distinct().join(metrics.select("instance_id"), "instance_id", "left_anti")
    rows = missing.join(counts, "instance_id", "left").na.fill(0.0, ["gold_count"])
    return rows.select("instance_id", "gold_count", *[F.lit(0.0).alias(c) for c in names])


def percent_table(summary: DataFrame) -> DataFrame:
    """(family, k, percent) of a summary (metric, mean): metric names of the form
    family@k, as percentages with two decimals."""
    rows = summary.where(F.col("metric").contains("@"))
    return rows.select(
        F.substring_index("metric", "@", 1).alias("family"),
        F.substring_index("metric", "@", -1).alias("k"),
        F.format_number(F.col("mean") * 100, 2).alias("percent"),
    )


def markdown_report(summary: DataFrame) -> str:
    """The percentages as a Markdown table: one row for each family. The summary
    has one row for each metric, so it may come to the driver."""
    rows = percent_table(summary).collect()
    families = sorted({r.family for r in rows})
    ks = sorted({r.k for r in rows}, key=lambda k: (not k.isdigit(), int(k) if k.isdigit() else 0, k))
    at = {(r.family, r.k): r.percent for r in rows}
    lines = ["| metric | " + " | ".join(f"@{k}" for k in ks) + " |", "| --- |" + " --- |" * len(ks)]
    lines += [f"| {f} | " + " | ".join(at.get((f, k), "") for k in ks) + " |" for f in families]
    return "\n".join(lines) + "\n"


def seed_penalty(ranked: DataFrame, seeds: DataFrame, factor: float = 0.7) -> DataFrame:
    """ranked with seeds scaled down and ranks assigned anew."""
    marked = ranked.join(seeds.select("instance_id", "path").distinct().withColumn("seed", F.lit(True)), ["instance_id", "path"], "left")
    score = F.round(F.when(F.col("seed"), F.col("score") * factor).otherwise(F.col("score")), 6)
    order = Window.partitionBy("instance_id").orderBy(F.desc("score"), "path")
    return marked.select("instance_id", "path", score.alias("score")).withColumn("rank", F.row_number().over(order))
