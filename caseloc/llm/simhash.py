"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is a ring of bits cut into m segments. If two fingerprints differ
in at most t bits, some chain of consecutive segments has, for every prefix of l
segments, at most l*t/m differing bits. While l*t/m < 1 that means none, so the
first segments of the chain are an exact join key; the longer prefixes prune the
joined pairs before the full Hamming check.

Two users of this idea:

* ``hamming_links`` / ``fingerprint_components``: 64-bit fingerprints, t <= 2,
  exact. A bucket larger than ``bucket_cap`` is not joined with itself: its
  members meet at the fingerprints one bit away from them. Two members within
  two bits share such a meeting point, and everything at a meeting point is
  within two bits of everything else there, so a star around the smallest
  member loses no component and the rows stay linear.
* ``near_duplicates``: documents with a similarity of 0.8 or more on five-word
  shingles. That is about 15 % of differing bits, far beyond an exact key, so
  ``jaccard_join`` finds these groups exactly. ``drop_near_duplicates`` connects
  them by linked fingerprints as well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, rotate_left, table, written
from .jaccard_join import similar_groups, text_key

SEED = 42
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) for k in range(64)], dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; ASCII letters in lower case,
    words cut at ASCII white space."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]
    return np.array(hashes, dtype=np.uint64)


def majority_bits(hashes: np.ndarray, columns: int = 1, block: int = 1 << 12) -> np.ndarray:
    """``columns`` 64-bit words; a bit is 1 if set in over half the hashes. The
    first word uses the hashes as they are, the others mixes of them."""
    counts = np.zeros(64 * columns, dtype=np.int64)
    for lo in range(0, len(hashes), block):
        part = hashes[lo : lo + block]
        if columns > 1:
            mixed = part[:, None] ^ (part[:, None] >> np.uint64(31))
            mixed = mixed * _MIX[None, :columns]
            mixed ^= mixed >> np.uint64(29)
            mixed[:, 0] = part
        else:
            mixed = part[:, None]
        counts += np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)


# --- 64-bit fingerprints, exact links ---------------------------------------


def _fingerprint_rows(words: int):
    def run(batches):
        for batch in batches:
            fps = np.zeros(batch.num_rows, dtype=np.uint64)
            for i, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py(), words)
                if len(hashes):
                    fps[i] = majority_bits(hashes)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[batch.schema.names[0], "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long): one row for each row of ``docs``; a null or empty text
    has fingerprint zero."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprint_rows(words), "doc_id long, fp long")


def _ring(segments: int) -> list[int]:
    return [round(i * 64 / segments) for i in range(segments + 1)]


def _ones(n: int) -> int:
    """The top n of 64 bits, as a signed long."""
    mask = ((1 << n) - 1) << (64 - n)
    return mask - (1 << 64) if mask >> 63 else mask


def chain_keys(fps: DataFrame, distance: int, segments: int) -> DataFrame:
    """(chain, key, turned): for each place of the ring the fingerprint turned to
    begin there, and the bits of the segments that must be equal."""
    cuts = _ring(segments)
    equal = (segments - 1) // distance
    places = []
    for s in range(segments):
        width = sum(cuts[(s + i) % segments + 1] - cuts[(s + i) % segments] for i in range(equal))
        turned = rotate_left(F.col("fp"), cuts[s])
        places.append(
            F.struct(F.lit(s).alias("chain"), F.shiftrightunsigned(turned, 64 - width).alias("key"), turned.alias("turned"))
        )
    return fps.select(F.inline(F.array(*places)))


def _within_budgets(x: Column, distance: int, segments: int) -> Column:
    """The chain condition for the prefixes longer than the equal part."""
    cuts, equal = _ring(segments), (segments - 1) // distance
    longest = {math.floor(n * distance / segments): n for n in range(equal + 1, segments + 1)}
    ok = F.bit_count(x) <= distance
    for budget, n in longest.items():
        if n == segments:
            continue
        widths = [(cuts[s] - cuts[0]) if s == 0 else 0 for s in range(segments)]
        for s in range(segments):
            widths[s] = sum(cuts[(s + i) % segments + 1] - cuts[(s + i) % segments] for i in range(n))
        masks = F.array(*[F.lit(_ones(w)) for w in widths])
        ok = ok & (F.bit_count(x.bitwiseAND(F.element_at(masks, F.col("l.chain") + 1))) <= budget)
    return ok


def hamming_links(fps: DataFrame, distance: int = 2, segments: int = 9, bucket_cap: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep every
    connected component of "differ in at most ``distance`` bits" (1 or 2)."""
    if distance not in (1, 2):
        raise ValueError("exact links need a distance of 1 or 2")
    keys = chain_keys(fps.select("fp").distinct(), distance, segments)
    sizes = keys.groupBy("chain", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(sizes, ["chain", "key"]), "ring-members")

    back = F.lit(0).cast("long")
    cuts = _ring(segments)

    def upright(turned: Column, chain: Column) -> Column:
        out = back
        for s in range(segments):
            out = F.when(chain == s, rotate_left(turned, 64 - cuts[s])).otherwise(out)
        return out

    small = members.where(F.col("n") <= bucket_cap)
    left, right = small.alias("l"), small.alias("r")
    x = F.col("l.turned").bitwiseXOR(F.col("r.turned"))
    pairs = left.join(
        right,
        (F.col("l.chain") == F.col("r.chain"))
        & (F.col("l.key") == F.col("r.key"))
        & (F.col("l.turned") < F.col("r.turned"))
        & _within_budgets(x, distance, segments),
    ).select(
        upright(F.col("l.turned"), F.col("l.chain")).alias("a"),
        upright(F.col("r.turned"), F.col("l.chain")).alias("b"),
    )

    # Large buckets: each member goes to the fingerprints within one bit of it
    # (bits of the equal part need no turn).
    equal = (segments - 1) // distance
    least = min(sum(cuts[(s + i) % segments + 1] - cuts[(s + i) % segments] for i in range(equal)) for s in range(segments))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_bit(i)) for i in range(64 - least)])
    met = (
        members.where(F.col("n") > bucket_cap)
        .select("chain", "key", "turned", F.explode(flips).alias("flip"))
        .withColumn("at", F.col("turned").bitwiseXOR(F.col("flip")))
        .drop("flip")
    )
    # A meeting point has at most as many members as a fingerprint has near bits.
    first = met.groupBy("chain", "at").agg(F.min("turned").alias("low"), F.count("*").alias("k")).where("k > 1")
    if distance == 1:
        first = first.where("false")
    stars = (
        met.join(first, ["chain", "at"])
        .where("turned <> low")
        .select(upright(F.col("turned"), F.col("chain")).alias("a"), upright(F.col("low"), F.col("chain")).alias("b"))
    )
    if distance == 1:
        both = members.where(F.col("n") > bucket_cap)
        near = met.where(F.col("at") != F.col("turned")).withColumnRenamed("turned", "other")
        stars = (
            near.join(both.select("chain", F.col("turned").alias("at")), ["chain", "at"])
            .select(upright(F.col("other"), F.col("chain")).alias("a"), upright(F.col("at"), F.col("chain")).alias("b"))
        )
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered(pairs).unionByName(ordered(stars)).distinct()


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64) if i == 63 else 1 << i


def fingerprint_components(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest doc_id that links lead to. Empty and null texts
    have the zero fingerprint and are linked like others. Repeated rows stay; a
    null doc_id stays and gets the component of its fingerprint, null if no row
    of that has a doc_id. Columns other than doc_id and text are ignored.
    """
    fps = written(fingerprints(docs, words), "simhash")
    lowest = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(hamming_links(fps, distance)).withColumnRenamed("node", "fp")
    grouped = lowest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    components = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = grouped.join(components, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- near-duplicates at a shingle similarity ---------------------------------


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, bucket_cap: int = 1_024) -> DataFrame:
    """(doc_id, text_md5, group_id, keep_id, keep_node): one row for each distinct
    pair of doc_id and text.

    Texts are linked if the Jaccard similarity of their sets of shingles is
    ``similarity`` or more (``jaccard_join.similar_groups``). group_id is the
    smallest MD5 of a group, keep_id its smallest doc_id, keep_node the MD5 that
    goes with it. All texts without words (null, empty, blank) form one group.
    """
    groups = similar_groups(docs, similarity, shingle_words, bucket_cap).groupBy("node", "root", "doc_id").agg(F.count("*").alias("rows"))
    first = F.min_by("node", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node"))
    kept = groups.groupBy("root").agg(F.min("node").alias("group_id"), F.min("doc_id").alias("keep_id"), first.alias("keep_node"))
    return groups.join(kept, "root").select("doc_id", F.col("node").alias("text_md5"), "group_id", "keep_id", "keep_node")


def text_fingerprints(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """(text_md5, fp_root): each distinct text of ``docs`` and the smallest
    fingerprint that links of ``distance`` bits lead to, by pigeonring chains."""
    texts = docs.select(text_key("text").alias("text_md5"), F.col("text").cast("string"))
    each = texts.mapInArrow(_fingerprint_rows(words), "text_md5 string, fp long")
    fps = written(each.distinct(), "text-simhash")
    roots = connected_components(hamming_links(fps, distance)).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").select("text_md5", F.coalesce("root", "fp").alias("fp_root"))


def with_fingerprint_links(groups: DataFrame, fingerprinted: DataFrame) -> DataFrame:
    """``near_duplicates`` rows whose groups are joined where texts of both have
    linked fingerprints (text_md5, fp_root)."""
    placed = written(groups.select("text_md5", "group_id").distinct().join(fingerprinted, "text_md5"), "fingerprint-groups")
    low = placed.groupBy("fp_root").agg(F.min("group_id").alias("b"))
    met = placed.join(low, "fp_root").where("group_id <> b").select(F.col("group_id").alias("a"), "b")
    roots = connected_components(met).withColumnRenamed("node", "group_id")
    return groups.join(roots, "group_id", "left").withColumn("group_id", F.coalesce("root", "group_id")).select("doc_id", "text_md5", "group_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) without near copies: of each group the
    row with the smallest doc_id stays, once even if that row is repeated. If no
    row of a group has a doc_id, one row with the smallest MD5 stays.

    Groups are connected by SimHash fingerprints that differ in two bits or less,
    and by an exact join on similarity that finds what fingerprints do not."""
    groups = written(with_fingerprint_links(near_duplicates(docs, **options), text_fingerprints(docs)), "linked-groups")
    first = F.min_by(F.struct("doc_id", "text_md5"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5"))
    keepers = groups.groupBy("group_id").agg(first.alias("x")).select(F.col("x.doc_id").alias("_keep_id"), F.col("x.text_md5").alias("_keep_md5"))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_key("text").alias("_md5"))
    joined = packed.join(keepers, (F.col("_md5") == F.col("_keep_md5")) & F.col("_id").eqNullSafe(F.col("_keep_id")), "left_semi")
    return joined.dropDuplicates(["_md5", "_id"]).select("_row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_components(table(spark, sf_dir, "documents"))
