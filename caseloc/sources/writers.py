"""Writers: JSON lines, CSV, appended results, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write with sorted keys; the row count comes from the write itself."""
    from pyspark.sql import Observation

    seen = Observation()
    df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("rows")).write.option("ignoreNullFields", "false").json(path)
    return seen.get["rows"]


def write_csv(frames: list[DataFrame], path: str) -> None:
    """One table with the union of columns in order of first appearance."""
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    whole.write.option("header", True).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_snapshots(files: DataFrame, entities: DataFrame, path: str) -> None:
    """One row for each snapshot with its files and their entities; a partition
    for each, so writing one again replaces only that one."""
    by_file = entities.groupBy("snapshot_id", "path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "kind", "name"))).alias("entities"))
    joined = files.join(by_file, ["snapshot_id", "path"], "left")
    (
        joined.repartition("snapshot_id")
        .write.partitionBy("snapshot_id")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
