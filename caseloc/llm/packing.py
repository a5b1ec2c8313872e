"""Best-fit packing into sequences of several permitted lengths.

Texts are cut into pieces of at most the longest capacity. Pieces are dealt to
shards by hash, each with a bounded number of tokens, and each shard is packed in
one task: pieces go, longest first, to the open bin with the least space that
holds them; if there is none, the permitted size with the least cost for each
token it is expected to hold is opened; at the end every bin shrinks to the
smallest permitted size that holds its contents.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .encoding import default_tokenizer_path, word_encoder

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def bin_cost(capacity: int) -> float:
    """Default cost of one sequence: its tokens, an overhead, and attention that
    grows with the square of the length."""
    return capacity + capacity**2 / 65_536 + 16.0


SHARD_TOKENS = 1_000_000


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(part, row, doc_id, length): tokens of each whole text and an end token."""

    def run(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        encoder = word_encoder(tokenizer_path)
        for batch in batches:
            lengths = [len(encoder.encode(t)) // 4 + 1 if t else 1 for t in batch.column(1).to_pylist()]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, dtype=np.int32)),
                    pa.array(np.arange(row, row + n, dtype=np.int64)),
                    batch.column(0),
                    pa.array(lengths, type=pa.int64()),
                ],
                names=["part", "row", "doc_id", "length"],
            )
            row += n

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "part int, row long, doc_id long, length long")


def pack_lengths(lengths: np.ndarray, costs: Mapping[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin, its offset there and the bin's final capacity.

    costs: permitted capacity -> cost of one bin. Every length is between 1 and
    the largest capacity. Equal lengths keep their order.
    """
    sizes = sorted(costs)
    order = np.argsort(-lengths, kind="stable")
    rising = lengths[order][::-1]
    tokens_below = np.concatenate([[0], np.cumsum(rising)])
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    used: list[int] = []
    waiting: dict[int, list[int]] = {}  # space left -> open bins
    spaces: list[int] = []  # sorted keys of waiting
    for done, i in enumerate(order.tolist()):
        length = int(lengths[i])
        at = bisect.bisect_left(spaces, length)
        if at < len(spaces):
            space = spaces[at]
            same = waiting[space]
            chosen = same.pop()
            if not same:
                del waiting[space]
                spaces.pop(at)
        else:
            left = len(lengths) - done - 1
            best = None
            for size in sizes:
                if size < length:
                    continue
                fitting = min(left, int(np.searchsorted(rising, size - length, side="right")))
                content = length + min(size - length, int(tokens_below[fitting]))
                rate = (costs[size] / content, -size)
                if best is None or rate < best[0]:
                    best = (rate, size)
            space, chosen = best[1], len(used)
            used.append(0)
        bins[i], offsets[i] = chosen, used[chosen]
        used[chosen] += length
        space -= length
        if space:
            if space not in waiting:
                waiting[space] = []
                bisect.insort(spaces, space)
            waiting[space].append(chosen)
    fits = np.array(sizes)[np.searchsorted(sizes, np.array(used, dtype=np.int64))] if used else np.zeros(0, dtype=np.int64)
    return bins, offsets, fits[bins] if len(bins) else fits


def _pack_shard(costs: dict[int, float]):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["part", "row", "piece"], kind="stable").reset_index(drop=True)
        bins, offsets, capacity = pack_lengths(shard["piece_len"].to_numpy(), costs)
        return pd.DataFrame(
            {
                "doc_id": shard["doc_id"].astype("Int64"),
                "piece": shard["piece"],
                "piece_start": shard["piece_start"],
                "piece_len": shard["piece_len"],
                "bin_id": shard["shard"].to_numpy(dtype=np.int64) * (1 << 32) + bins,
                "bin_offset": offsets,
                "bin_capacity": capacity,
            }
        )

    return run


def pack(
    lengths: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = bin_cost,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """(doc_id, piece, piece_start, piece_len, bin_id, bin_offset, bin_capacity)
    from (part, row, doc_id, length), where part and row tell rows apart.

    A row longer than the largest capacity is cut into several pieces. A row of
    null or no length has one piece of length 0 in no bin (null). Repeated rows
    are packed as often as they occur. ``lengths`` should be a written table.
    """
    costs = {c: cost(c) for c in capacities}
    top = max(capacities)
    rows = lengths.withColumn("length", F.coalesce(F.greatest("length", F.lit(0)), F.lit(0)).cast("long"))
    total = rows.agg(F.sum("length")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(top).cast("long"))
    pieces = (
        rows.where("length > 0")
        .select("part", "row", "doc_id", "length", F.posexplode(starts).alias("piece", "piece_start"))
        .withColumn("piece_len", F.least(F.lit(top).cast("long"), F.col("length") - F.col("piece_start")))
        .withColumn("shard", F.pmod(F.xxhash64("part", "row", "piece"), F.lit(shards)).cast("int"))
        .drop("length")
    )
    schema = "doc_id long, piece int, piece_start long, piece_len long, bin_id long, bin_offset long, bin_capacity long"
    packed = pieces.groupBy("shard").applyInPandas(_pack_shard(costs), schema)
    none = rows.where("length = 0").select(
        "doc_id",
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("piece_start"),
        F.lit(0).cast("long").alias("piece_len"),
        *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_capacity")],
    )
    return packed.unionByName(none)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    """Pack whole texts by their token counts; see ``pack``. A null or empty
    text is its end token alone."""
    lengths = written(token_lengths(docs, tokenizer_path or default_tokenizer_path()), "token-lengths")
    return pack(lengths, **options)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
