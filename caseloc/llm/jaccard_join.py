"""Similar sets of shingles: a join on adaptive multi-match prefixes.

Two sets of similarity t or more share so many members that, in any common order,
their prefixes of n - ceil(t * n) + k members share at least k. A prefix of k = 1
is short and has many candidates where its members are frequent; a longer one costs
more meetings and asks for k of them before whole sets are compared. Each document
takes the k whose cost is least: the others that it meets in the prefix, plus
candidates, of which there are at most a k-th. A pair is held to the smaller k of
the two, so any mix of lengths loses nothing, and a document that meets others in
fewer places than it and they ask for leaves at once.

The order (rare shingles first) comes from a sample; it costs or saves time and
decides nothing. How many others each member meets is counted over all documents.

Before whole sets are compared, parity bitmaps are: each member of a set flips one
of 512 bits, so two bitmaps differ in no more bits than the sets in members. That
rules out nearly all pairs that are not alike, and none that is.

What is wanted is which sets are connected, so a group of copies needs no list of
all its pairs: in a large meeting one node is a hub, another in each round, and
each node is compared with the hub that it meets most. Then all nodes that meet and
are not connected yet are paired. Equal sets are one node from the start.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table, written
from .runs import WORD
from .words import shingles, word_hashes

#: Texts whose shingle counts set the order (about, at least, and at least one in SHARE), and shingles that get a count.
SAMPLE, SHARE, COMMON = 8_000, 50, 1_000_000
#: A prefix is lengthened by at most this share of the set; what comparing two whole sets costs, in meetings.
LENGTHEN, COMPARE = 0.08, 16
#: Slots by which rows are looked up in a broadcast; counts in the order end here.
SLOTS, FULL = 1 << 20, 127
#: Words of a bitmap of 64 bits each.
BITMAP = tuple(f"b{i}" for i in range(8))
#: A meeting of more nodes is first cut down by stars, in at most so many rounds.
HOT, ROUNDS = 16, 8


def shingle_sets(texts: list[str | None], words: int):
    """For each text its distinct shingles, sorted; none without words."""
    for found in word_hashes(texts):
        yield np.unique(shingles(found, words))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def _set_rows(words: int):
    """(key, text) -> (key, its shingles)."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist(), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=[batch.schema.names[0], "shingles"])

    return run


def _digest(shingles_: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles_.tobytes(), digest_size=16).digest()


def parity_bitmap(shingles_: np.ndarray) -> np.ndarray:
    """Eight words; bit i is 1 if an odd number of members fall on it."""
    bits = np.bincount((shingles_ >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * len(BITMAP)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _keyed_set_rows(words: int):
    """(text) -> (set_key, shingles), once for each set that a task sees."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            new = {}
            for found in shingle_sets(batch.column(0).to_pylist(), words):
                key = _digest(found)
                if key not in seen:
                    seen.add(key)
                    new[key] = found
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), _lists(list(new.values()))], names=["set_key", "shingles"])

    return run


def least_shared(n: int, similarity: float) -> int:
    """Members that a set of n shares at least with a similar one."""
    return math.ceil(similarity * n - 1e-9)


def most_matches(n: int, lengthen: float) -> int:
    """The largest k that a set of n may ask for."""
    return max(1, math.ceil(lengthen * n))


def _prefix_rows(words: int, similarity: float, lengthen: float, shared):
    """(doc_id, node, text) -> (doc_id, node, set_key, n, bitmap, keys): the digest,
    size and bitmap of the set, and its longest prefix, rare shingles first. A set that this task
    has seen before has null keys. shared: a broadcast of common shingles, sorted,
    and their places in the order."""

    def run(batches):
        common, places = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            digests, sizes, keys, known, bitmaps = [], [], [], [], []
            for found in shingle_sets(batch.column(2).to_pylist(), words):
                n = len(found)
                digest = _digest(found)
                known.append(digest in seen or not n)
                digests.append(digest)
                sizes.append(n)
                bitmaps.append(parity_bitmap(found))
                if known[-1]:
                    keys.append(found[:0])
                    continue
                seen.add(digest)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    order = np.where(common[at] == found, places[at], 0).astype(np.uint8)
                    found = found[np.argsort(order, kind="stable")]
                keys.append(found[: n - least_shared(n, similarity) + most_matches(n, lengthen)])
            lists = _lists(keys)
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(known, pa.bool_()))
            columns = np.array(bitmaps, dtype=np.int64).reshape(-1, len(BITMAP)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), *map(pa.array, columns), lists],
                names=["doc_id", "node", "set_key", "n", *BITMAP, "keys"],
            )

    return run


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with at least two places in a sample of ``rows`` (node, text),
    sorted, and their places in the order of shingles. A shingle that is missed
    costs time and loses no pair."""
    total = max(1, rows.count())
    share = min(1.0, max(SAMPLE, total / SHARE) / total)
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    each = some.mapInArrow(_set_rows(words), "node string, shingles array<long>").select(F.explode("shingles").alias("s"))
    found = each.groupBy("s").agg(F.count("*").alias("k")).where("k >= 2").orderBy(F.desc("k"), "s").limit(COMMON).toArrow()
    common, counts = found.column("s").to_numpy().astype(np.int64).view(np.uint64), found.column("k").to_numpy()
    by_value = np.argsort(common)
    return common[by_value], np.minimum(counts[by_value], FULL).astype(np.uint8)


def _may_be_alike(similarity: float) -> Column:
    """Sizes, and places of a shared shingle, that leave room for the overlap."""
    n, m, i, j = F.col("l.n"), F.col("r.n"), F.col("l.pos"), F.col("r.pos")
    overlap = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6) & (overlap * (1 + similarity) >= (n + m) * similarity - 1e-6)


def _bits_allow(similarity: float) -> Column:
    """Whether two sets may differ in as many members as their bitmaps differ in
    bits: (1 - t) / (1 + t) of both sizes together."""
    differ = sum((F.bit_count(F.col(f"l.{b}").bitwiseXOR(F.col(f"r.{b}"))) for b in BITMAP), F.lit(0))
    return differ * (1 + similarity) <= (F.col("l.n") + F.col("r.n")) * (1 - similarity) + 1e-6


def _bits_of(pairs: DataFrame, bitmaps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their bitmaps (id, n, ...) allow."""
    rows = pairs
    for x, name in (("a", "l"), ("b", "r")):
        rows = rows.join(bitmaps.select(F.col("id").alias(x), F.struct("n", *BITMAP).alias(name)), x)
    return rows.where(_bits_allow(similarity)).select("a", "b")


def _have_room(similarity: float, k: Column) -> Column:
    """Whether k shared members of the prefixes leave room for the overlap: of the
    set whose prefix ends first in the order, all other shared members are behind
    it. For equal sizes that asks for the smaller k of the two."""
    rest = F.greatest("l.rest", "r.rest")
    return (k + rest) * (1 + similarity) >= (F.col("l.n") + F.col("r.n")) * similarity - 1e-6


def adapted_members(classes: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, n, rest, pos, key, size) of classes (id, n, keys): the shingles of each
    set's adapted prefix that others have in theirs, how many do, and how many
    members of the set are behind the prefix."""
    keys = classes.select("id", "n", F.posexplode("keys").alias("pos", "key")).repartition("key")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = scratch.written(keys.join(sizes, "key"), "met")
    n = F.col("n")
    least = F.ceil(similarity * n - 1e-9).cast("int")
    most = F.greatest(F.lit(1), F.ceil(LENGTHEN * n).cast("int"))
    steps = F.array(*[F.lit(1 << i) for i in range(24)])
    asked = F.array_distinct(F.transform(steps, lambda k: F.least(k, most)))
    others = lambda k: F.aggregate(F.filter("all", lambda x: x["pos"] < n - least + k), F.lit(0.0), lambda a, x: a + x["size"] - 1)
    costs = F.transform(asked, lambda k: F.struct((others(k) * (1 + COMPARE / k)).alias("cost"), k.alias("k")))
    each = met.groupBy("id", "n").agg(F.collect_list(F.struct("pos", "size")).alias("all"))
    chosen = each.select("id", n, least.alias("least"), F.array_min(costs)["k"].alias("k"))
    chosen = chosen.select("id", "k", (n - F.col("least") + F.col("k")).alias("prefix"), (F.col("least") - F.col("k")).alias("rest"))
    own = scratch.written(met.select("id", "n", "pos", "key").join(chosen, "id").where(F.col("pos") < F.col("prefix")), "own-prefix")
    # A pair shares the smaller k at least, so a node with fewer meetings than that has no pair.
    low = own.groupBy("key").agg(F.min("k").alias("low"), F.count("*").alias("size")).where("size > 1").drop("size")
    need = own.join(low, "key").groupBy("id").agg(F.min(F.least("low", "k")).alias("need"), F.count("*").alias("meetings")).where("meetings >= need")
    left = own.join(need.select("id"), "id", "left_semi").select("id", "n", "rest", "pos", "key")
    again = left.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return scratch.written(left.join(again, "key"), "members")


def _some(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is not in ``wanted``: a broadcast of
    at most SLOTS slots keeps them out of a shuffle, if few are wanted."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_slot")
    return rows.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "_slot", "left_semi").drop("_slot")


def _sets(nodes: DataFrame, rows: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(set_key, shingles): the whole sets of ``nodes`` (node), made from the texts
    in one pass without a shuffle. A set may be there once for each task."""
    texts = _some(rows.select("node", "text"), nodes, "node").select("text")
    return scratch.written(texts.mapInArrow(_keyed_set_rows(words), "set_key binary, shingles array<long>"), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The written ``pairs`` (a, b) whose whole sets have this similarity."""

    def side(x: str) -> DataFrame:
        ids = nodes.select(F.col("id").alias(x), "set_key").join(pairs.select(x).distinct(), x, "left_semi")
        once = _some(sets, ids, "set_key").join(ids, "set_key").select(x, F.col("shingles").alias(f"set_{x}"))
        return once.dropDuplicates([x])

    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared) - 1e-9).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("id"))
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _mixed(labelled: DataFrame) -> DataFrame:
    """Members of meetings whose nodes are not all connected yet."""
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return labelled.join(mixed, "key", "left_semi")


def _components(links: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.written(connected_components(links).select(F.col("node").alias("id"), F.col("root").alias("label")), "labels")


def similarity_links(classes: DataFrame, rows: DataFrame, similarity: float, words: int, bucket_cap: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between ids of ``classes`` (id, node, set_key, n, keys) that keep
    every connected component of "similarity or more"."""
    members = adapted_members(classes, similarity, scratch)
    links = labels = None
    hot = members.where(F.col("size") > HOT)
    degrees = scratch.written(hot.groupBy("id").agg(F.count("*").alias("degree")), "degrees")
    hot = scratch.written(hot.join(degrees, "id"), "hot")

    # Small meetings: a row for each shingle that a pair shares there; of large ones
    # it shares at most as many as the node that has fewer.
    low = members.where(F.col("size") <= HOT)
    left, right = low.alias("l"), low.alias("r")
    often = (
        left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")) & _may_be_alike(similarity))
        .groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        .agg(F.count("*").alias("k"))
    )
    ends = members.select("id", "n", "rest").distinct().join(degrees, "id", "left").na.fill(0, ["degree"])
    for x, name in (("a", "l"), ("b", "r")):
        often = often.join(ends.select(F.col("id").alias(x), F.struct("n", "rest", "degree").alias(name)), x)
    likely = often.where(_have_room(similarity, F.col("k") + F.least("l.degree", "r.degree"))).select("a", "b")
    bitmaps = scratch.written(classes.select("id", "n", *BITMAP).join(members.select("id").distinct(), "id", "left_semi"), "bitmaps")
    small = scratch.written(_bits_of(likely, bitmaps, similarity), "small")
    wanted = small.select(F.explode(F.array("a", "b")).alias("id")).unionByName(degrees.select("id")).distinct()
    nodes = scratch.written(classes.select("id", "node", "set_key").join(wanted, "id", "left_semi"), "nodes")
    sets = _sets(nodes, rows, words, scratch)
    n_hot = degrees.count()
    for turn in range(ROUNDS):
        own = _labelled(hot, labels)
        # First the hub with the most large meetings: it has the fewest shingles of its own.
        first = F.struct(-F.col("degree"), "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)), "id")
        hubs = own.groupBy("key").agg(
            F.min_by(F.struct("id", "n", "pos", "label"), first).alias("l"), F.min("label").alias("low"), F.max("label").alias("high")
        )
        spokes = own.select("key", F.struct("id", "n", "pos", "label").alias("r")).join(hubs.where("low <> high").select("key", "l"), "key")
        met = spokes.where((F.col("l.label") != F.col("r.label")) & _may_be_alike(similarity))
        often = met.groupBy(F.col("r.id").alias("b"), F.col("l.id").alias("a")).agg(F.count("*").alias("k"))
        best = often.groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a")).select("a", "b")
        stars = scratch.written(_bits_of(best, bitmaps, similarity), "stars")
        tried = stars.count()
        if not tried:
            break
        found = scratch.written(_alike(stars, sets, nodes, similarity), "pairs")
        links = found if links is None else links.unionByName(found)
        gained = found.count()
        if gained:
            labels = _components(links, scratch)
        if gained * 50 < n_hot:
            break

    # Members of large meetings whose nodes are not all connected: a pair that is
    # not connected meets in no other large one.
    own = scratch.written(_mixed(_labelled(hot, labels)), "own")
    apart = (F.col("l.id") < F.col("r.id")) & (F.col("l.label") != F.col("r.label"))
    few = small
    if labels is not None:
        for x in ("a", "b"):
            few = few.join(labels.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}")), x, "left")
        few = few.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")

    # Large ones: blocks of a meeting against each other; bitmaps decide in the join.
    dealt = (
        own.withColumn("blocks", F.ceil(F.col("size") / bucket_cap).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("mine", "other"))
        .withColumn("y", F.greatest("mine", "other"))
        .select("key", "x", "y", "mine", "id", "pos", "label")
        .join(bitmaps, "id")
    )
    left, right = dealt.alias("l"), dealt.alias("r")
    together = (F.col("l.key") == F.col("r.key")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.y") == F.col("r.y"))
    once = (F.least("l.mine", "r.mine") == F.col("l.x")) & (F.greatest("l.mine", "r.mine") == F.col("l.y"))
    many = left.join(right, together & once & apart & _may_be_alike(similarity) & _bits_allow(similarity))
    # A pair has a row for each large meeting that it shares; of small ones it shares
    # at most as many as the node that has fewer.
    often = many.groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b")).agg(F.count("*").alias("k"))
    ends = members.select("id", "n", "rest").distinct().join(low.groupBy("id").agg(F.count("*").alias("small")), "id", "left").na.fill(0, ["small"])
    for x, name in (("a", "l"), ("b", "r")):
        often = often.join(ends.select(F.col("id").alias(x), F.struct("n", "rest", "small").alias(name)), x)
    many = often.where(_have_room(similarity, F.col("k") + F.least("l.small", "r.small"))).select("a", "b")
    pairs = scratch.written(few.unionByName(many).distinct(), "close")
    found = _alike(pairs, sets, nodes, similarity)
    return found if links is None else links.unionByName(found)


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, bucket_cap: int = 1_024) -> DataFrame:
    """(doc_id, node, n, root): one row for each row of ``docs`` (doc_id, text).

    node: MD5 of the text; n: its number of distinct ``words``-word shingles (64-bit
    hashes; ASCII letters in lower case, words cut at ASCII white space; fewer words
    are one shingle, no words none). Rows have the same root if links of Jaccard
    ``similarity`` or more lead from one to the other. All rows without words have
    one root. A meeting of more than ``bucket_cap`` nodes is compared in blocks.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col("doc_id").cast("long"), text_key("text").alias("node"), F.col("text").cast("string"))
    shared = spark.sparkContext.broadcast(common_shingles(rows.select("node", "text"), words))  # at most COMMON shingles
    bits = ", ".join(f"{b} long" for b in BITMAP)
    schema = f"doc_id long, node string, set_key binary, n int, {bits}, keys array<long>"
    first = Scratch(spark, "near-prefixes")
    sketches = first.written(rows.mapInArrow(_prefix_rows(words, similarity, LENGTHEN, shared), schema), "sketches")
    # Ids are fixed by the writing, and shorter than digests in the shuffles.
    classes = sketches.where("keys IS NOT NULL").dropDuplicates(["set_key"]).drop("doc_id").withColumn("id", F.monotonically_increasing_id())
    classes = scratch.written(classes, "classes")
    sketches = scratch.written(sketches.select("doc_id", "node", "set_key", "n"), "documents")
    first.discard()
    links = scratch.written(similarity_links(classes, rows, similarity, words, bucket_cap, scratch), "links")
    roots = connected_components(links).withColumnRenamed("node", "id")
    by_set = classes.select("set_key", "id").join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    # A hot set has one row in by_set; its many documents are split by the join.
    groups = sketches.select("doc_id", "node", "set_key", "n").join(by_set, "set_key", "left")
    out = written(groups.select("doc_id", "node", "n", F.coalesce("root", F.lit(-1).cast("long")).alias("root")), "near-groups")
    scratch.discard()
    return out


def text_key(name: str) -> Column:
    """MD5 of a text; a null text has a key of its own."""
    return F.coalesce(F.md5(F.col(name).cast("binary")), F.lit("null"))


def jaccard_components(docs: DataFrame, similarity: float = 0.8, words: int = 5, bucket_cap: int = 1_024) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``.

    Documents are linked if the Jaccard similarity of their sets of shingles is
    ``similarity`` or more; component_id is the smallest doc_id that links lead to.
    A text without words (null, empty, blank) has no shingles and is linked with
    nothing. Repeated rows stay; a null doc_id stays and has the component of its
    links, null if no other doc_id is in it. Other columns are ignored. A text of
    any length is one row.
    """
    groups = similar_groups(docs, similarity, words, bucket_cap)
    low = groups.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return groups.join(low, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
  SELECT doc_id, doc_id AS low FROM sets UNION SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.doc_id
)
SELECT doc_id, len(s) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(low) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
