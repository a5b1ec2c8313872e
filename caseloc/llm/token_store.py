"""Token-ID output: Parquet list columns that can be read selectively.

``write_tokens`` encodes every text and writes one row per document in
ascending document order. Token ids are a list column in delta encoding
(dictionary off: ids of running text repeat too little for a page dictionary);
row groups and pages have a set size, and the writer adds page indexes and
row-group statistics, so a reader that filters on ``doc_id`` skips pages and one
that wants only counts never opens the token pages.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import new_path, table
from .encoding import default_tokenizer_path, word_encoder

STORE_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def _encode_rows(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        encoder = word_encoder(path, special=True)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            encoded = [encoder.encode(t) + end if t else end for t in batch.column(1).to_pylist()]
            counts = np.fromiter((len(x) // 4 for x in encoded), dtype=np.int64, count=len(encoded))
            # An Arrow list has 32-bit offsets; documents go out in slices below that.
            edges = np.concatenate([[0], np.cumsum(counts)])
            lo = 0
            while lo < len(encoded):
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 50_000_000, side="right")) - 1)
                values = np.frombuffer(b"".join(encoded[lo:hi]), dtype="<i4")
                offsets = (edges[lo : hi + 1] - edges[lo]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(hi - lo, part, dtype=np.int32)),
                        ids.slice(lo, hi - lo),
                        pa.array(start + edges[lo:hi]),
                        pa.array(counts[lo:hi]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                lo = hi
            start += int(edges[-1])

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    partitions: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
) -> None:
    """Encode ``docs`` (doc_id, text) and write them under ``path``.

    Rows are dealt by ranges of doc_id, so files are in ascending order and
    each holds a sorted run. A null text is encoded as an empty one (the end id
    only); a very long one is a row like others and an Arrow batch of its own.
    Repeated doc_ids all stay, in the order of their texts; a null doc_id
    comes first. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = rows.mapInArrow(_encode_rows(tokenizer_path, end_id), STORE_SCHEMA)
    (
        encoded.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.column.index.access", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens): token pages are not read.

    ``start`` is the number of ids before the document in the whole store. The
    running total over parts has one row for each part file.
    """
    return _with_start(read_store(spark, path).drop("ids"))


def read_tokens(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Documents low <= doc_id <= high; other row groups and pages are skipped."""
    return read_store(spark, path).where(F.col("doc_id").between(low, high)).select("doc_id", "n_tokens", "ids")


def _with_start(rows: DataFrame, store: DataFrame | None = None) -> DataFrame:
    sizes = (store if store is not None else rows).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_start"))
    # One row for each part file, a number that the writer sets: safe to broadcast.
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("local_start")).drop(
        "part_start", "local_start", "part"
    )


def _crc_rows(batches):
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B")
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, type=pa.int64())],
            names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"],
        )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all taken from the ids read back."""
    store = read_store(spark, path)
    schema = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    rows = store.select("part", "doc_id", "local_start", "ids").mapInArrow(_crc_rows, schema)
    return _with_start(rows, store.select("part", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer_path())
    return checksums(spark, path)
