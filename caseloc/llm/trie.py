"""Prefix trie of conversations, by a skeleton of splitter paths.

A conversation is the path of its turns; a turn is the 16-byte MD5 of its role and
text, so a path is one binary whose order is that of its turns. Equal paths are
one row with a count, however many conversations they stand for.

Distinct paths are dealt by range: splitters, cut from a bounded sample, are as
short as will still part their neighbours. A subtree is an interval of paths, so a
node whose subtree lies in more than one shard is a prefix of a splitter. The trie
of the splitters, the *skeleton*, has at most SHARDS * DEPTH nodes and is
broadcast. Each sorted shard finishes every other node in one pass with the open
path on a stack; of skeleton nodes it gives partial counts, which are summed over
shards and then along the skeleton.

A sample, the number of shards and the depth of splitters set only the balance.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .runs import CRC32_SQL, WORD

#: At most so many shards, about so many paths in each; splitters end at this depth.
SHARDS, SHARD_PATHS, DEPTH = 4_096, 20_000, 32
#: Sampled paths for each shard.
SAMPLED = 8
#: Bytes of a turn; conversations of 2^BLOCK_BITS consecutive ids are joined in one text.
TURN, BLOCK_BITS = 16, 12
#: Rows of an Arrow batch that is given back.
ROWS = 1 << 14

_PATHS = "path binary, words array<long>, n_convs long, low long, ends_sha256 string"
_NODES = pa.schema(
    [
        ("skeleton", pa.int32()),
        ("parent_skeleton", pa.int32()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("words", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation, by turn (null first; ties
    by the MD5 of role and text), each with its key and its words. A null role or
    text is empty; rows without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length keeps ("a", "bc") and ("ab", "c") apart.
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"),
    )
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def with_shared_heads(lists: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """The first h turns of each conversation c become those of conversation
    c - c % every (all if it has fewer, none if there is none); h = crc32(c) %
    (most + 1)."""
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = lists.where(c % every == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("head"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return lists.join(heads, c - c % every == F.col("base"), "left").select("conv_id", F.concat(head, own).alias("turns"))


def _fold_paths(batches):
    """Sorted blocks of conv_ids of each path -> one row for each path."""
    now, row = None, None
    out: list[tuple] = []

    def flush():
        columns = [list(c) for c in zip(*out)] or [[]] * 5
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        names = ["path", "words", "n_convs", "low", "ends_sha256"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        out.clear()
        return batch

    def done():
        return (now, row[0], row[1], row[2], row[3].hexdigest())

    for batch in batches:
        for path, words, n, low, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if path == now:
                row[1], row[2] = row[1] + n, min(row[2], low)
                row[3].update(b"," + ids.encode())
                continue
            if now is not None:
                out.append(done())
            now, row = path, [words, n, low, hashlib.sha256(ids.encode())]
            if len(out) >= ROWS:
                yield flush()
    if now is not None:
        out.append(done())
    yield flush()


def distinct_paths(lists: DataFrame) -> DataFrame:
    """(path, words, n_convs, low, ends_sha256): each distinct sequence of turns,
    the words of its turns, how many conversations have it, the smallest of them,
    and the SHA-256 of their ids, ascending and comma-joined. Ids are joined in
    blocks first, so a path that many share is folded from few rows."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    paths = lists.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
        F.shiftright("conv_id", BLOCK_BITS).alias("block"),
    )
    blocks = paths.groupBy("path", "block").agg(
        F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("low"), ids.alias("ids")
    )
    ordered = blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "words", "n", "low", "ids")
    return ordered.mapInArrow(_fold_paths, _PATHS)


def _shared_turns(a: bytes, b: bytes) -> int:
    d, most = 0, min(len(a), len(b)) // TURN
    while d < most and a[d * TURN : d * TURN + TURN] == b[d * TURN : d * TURN + TURN]:
        d += 1
    return d


def splitters(paths: DataFrame, shards: int | None = None) -> list[bytes]:
    """Ascending prefixes of paths that part ``paths`` into about equal shards."""
    total = paths.count()
    if shards is None:
        shards = max(2 * paths.sparkSession.sparkContext.defaultParallelism, math.ceil(total / SHARD_PATHS))
    shards = min(SHARDS, shards)
    share = min(1.0, SAMPLED * shards / max(1, total))
    some = paths.where(F.pmod(F.xxhash64("path"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    head = F.substring("path", 1, TURN * DEPTH).alias("head")
    # At most a few times SAMPLED * SHARDS keys of bounded length.
    found = sorted(bytes(r.head) for r in some.select(head).distinct().limit(4 * SAMPLED * SHARDS).collect())
    cuts = {round(k * len(found) / shards) for k in range(1, shards)} - {0, len(found)}
    return sorted({found[k][: TURN * (_shared_turns(found[k - 1], found[k]) + 1)] for k in cuts})


def skeleton_nodes(cuts: list[bytes]) -> dict[bytes, int]:
    """All prefixes of the splitters, numbered from the root (0) in order."""
    nodes = {b""} | {cut[:at] for cut in cuts for at in range(TURN, len(cut) + 1, TURN)}
    return {path: k for k, path in enumerate(sorted(nodes))}


def _dealt(shared):
    def run(batches):
        cuts, _ = shared.value
        for batch in batches:
            shard = pa.array([bisect_right(cuts, p) for p in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], names=["shard", *batch.schema.names])

    return run


class _Node:
    __slots__ = ("children", "depth", "ends", "kids", "leaves", "low", "n", "number", "saved", "words")

    def __init__(self, depth: int, words: int, number: int):
        self.depth, self.words, self.number = depth, words, number
        self.n = self.children = self.leaves = self.saved = 0
        self.low = self.ends = None
        self.kids: list[list] = []


def _shard_nodes(shared):
    """Sorted paths of shards -> finished nodes, and parts of skeleton nodes."""

    def run(batches):
        _, skeleton = shared.value
        stack: list[_Node] = []
        out: list[list] = []
        now, last = None, b""

        def flush():
            columns = list(zip(*out)) or [()] * len(_NODES)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES)], schema=_NODES)
            out.clear()
            return batch

        def close():
            node = stack.pop()
            parent = stack[-1] if stack else None
            if parent is not None:
                parent.n += node.n
                parent.low = node.low if parent.low is None else min(parent.low, node.low)
            if node.number >= 0:
                above = parent.number if parent is not None else None
                out.append([node.number, above, node.low, node.depth, None, node.n, node.children, node.leaves, node.saved, node.words, node.ends])
                return
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
            for kid in node.kids:
                kid[4] = node.low
            out.extend(node.kids)
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            row = [None, None, node.low, node.depth, None, node.n, node.children, leaves, saved, node.words, node.ends]
            if parent.number >= 0:
                row[1] = parent.number
                out.append(row)
            else:
                parent.kids.append(row)

        for batch in batches:
            for shard, path, words, n, low, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    while stack:
                        close()
                    now, last = shard, b""
                    stack.append(_Node(0, 0, 0))
                same = _shared_turns(last, path)
                while len(stack) > same + 1:
                    close()
                for d in range(len(stack), len(path) // TURN + 1):
                    number = skeleton.get(path[: d * TURN], -1) if stack[-1].number >= 0 else -1
                    stack.append(_Node(d, words[d - 1], number))
                top, last = stack[-1], path
                top.n, top.ends = n, ends
                top.low = low
                if len(out) >= ROWS:
                    yield flush()
        while stack:
            close()
        yield flush()

    return run


def _skeleton_table(spark: SparkSession, skeleton: dict[bytes, int]) -> DataFrame:
    """(skeleton, up): each skeleton node with itself and all above it."""
    rows = [(k, [skeleton[path[:at]] for at in range(0, len(path) + 1, TURN)]) for path, k in skeleton.items()]
    return spark.createDataFrame(rows, "skeleton int, up array<int>")


def prefix_trie(lists: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the turn lists (conv_id, turns), the
    empty one included: conv_id (smallest member), depth, parent_conv_id (null for
    the root), n_convs, n_children, n_leaves and saved_tokens of its subtree, and
    ends_sha256, the digest of the ids of those that end there (null: none).

    Two turns are the same if the MD5 of role and text is. No conversation gives
    no rows. Sums are long. A conversation is one row, 16 bytes for each turn; a
    shard holds its open path and the finished children of open nodes that are in
    no other shard.
    """
    spark = lists.sparkSession
    paths = written(distinct_paths(lists), "trie-paths")
    cuts = splitters(paths, shards)
    skeleton = skeleton_nodes(cuts)
    shared = spark.sparkContext.broadcast((cuts, skeleton))
    dealt = paths.mapInArrow(_dealt(shared), f"shard int, {_PATHS}").repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path")
    schema = "skeleton int, parent_skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"
    nodes = written(dealt.mapInArrow(_shard_nodes(shared), schema), "trie-nodes")

    parts = nodes.where("skeleton IS NOT NULL").groupBy("skeleton").agg(
        F.max("parent_skeleton").alias("parent_skeleton"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("words").alias("words"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    parts = written(parts, "trie-skeleton")
    below = parts.groupBy(F.col("parent_skeleton").alias("skeleton")).agg(F.count("*").alias("inner"))
    n_children = F.col("n_children") + F.coalesce("inner", F.lit(0))
    own = parts.join(below, "skeleton", "left").withColumn("n_children", n_children)
    up = own.join(_skeleton_table(spark, skeleton), "skeleton").select(
        F.explode("up").alias("skeleton"),
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    whole = up.groupBy("skeleton").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ids = parts.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("upper"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = own.drop("n_leaves", "saved_tokens").join(whole, "skeleton")
    inner = inner.join(ids, "parent_skeleton", "left").select(*columns, F.col("upper").alias("parent_conv_id"))
    finished = nodes.where("skeleton IS NULL")
    # Skeleton nodes are at most SHARDS * DEPTH rows.
    outer = finished.join(F.broadcast(ids), "parent_skeleton", "left").select(*columns, F.coalesce("parent_conv_id", "upper").alias("parent_conv_id"))
    return inner.unionByName(outer)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations with shared heads."""
    lists = with_shared_heads(turn_lists(table(spark, sf_dir, "conversations")))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    ends: Column = F.coalesce("ends_sha256", nothing)
    return prefix_trie(lists).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256")
    )


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list(t ORDER BY turn NULLS FIRST) AS own FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, own, {CRC32_SQL.format(text='conv_id::VARCHAR')} % 4 AS h FROM convs
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS path
  FROM hashed c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * len(regexp_extract_all(n.prefix[-1].text, '{WORD}')) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.prefix[1:p.depth] = p.prefix
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.depth = l.depth AND c.prefix = l.prefix
), above AS (
  SELECT prefix[1:up] AS prefix, up AS depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted c JOIN above a ON a.depth = c.depth AND a.prefix = c.prefix
"""
