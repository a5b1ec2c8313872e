"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit shingle hashes of
a text (all of them if there are fewer). Sketches of parts merge into the sketch
of the whole by taking the k smallest of their union, and give estimates of
resemblance, containment and the number of distinct shingles.

Words are cut at ASCII white space, in lower case; a shingle is five words; a
text of fewer words has one shingle, its whole sequence; null, empty and blank
texts have an empty sketch. Two empty sketches resemble each other fully.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

K, WORDS = 128, 5


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """``df`` with the sketch of column ``text`` as column ``out``."""
    hashed = df.withColumn(
        "_sketch_words",
        F.transform(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\\s+"), ""), lambda w: F.xxhash64(w)),
    )
    own = F.col("_sketch_words")
    starts = F.slice(own, 1, F.size(own) - (words - 1))
    shingles = F.when(
        F.size(own) >= words,
        F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(own, i + j) for j in range(1, words)])),
    ).otherwise(F.when(F.size(own) > 0, F.array(F.xxhash64(own))).otherwise(F.array().cast("array<bigint>")))
    return hashed.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop("_sketch_words")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the k smallest hashes of the
    union that both sketches hold (exact if neither sketch is full)."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below k)."""
    unit = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / unit)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b: their common count is the
    resemblance times the union's estimated size."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    common = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: the k smallest distinct hashes of its parts.

    Ranks are limited before the shuffle, so a group of any size sends at most k
    hashes from each task, and at most k rows are gathered.
    """
    hashes = df.select(*keys, F.explode(sketch).alias("_h"))
    salted = hashes.withColumn("_salt", F.spark_partition_id() % 64).dropDuplicates([*keys, "_salt", "_h"])
    part = Window.partitionBy(*keys, "_salt").orderBy("_h")
    few = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).dropDuplicates([*keys, "_h"])
    whole = few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return whole.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


# --- a document and the one after it -----------------------------------------


#: Cuts by quantiles at most, whatever the number of rows; slots by which heads are looked up in a broadcast.
CUTS, SLOTS = 1_024, 1 << 18


def _ranges(docs: DataFrame, rows_per_range: int) -> Column:
    """Number of a range of doc_id with about ``rows_per_range`` rows, rising
    with doc_id; null ids are in range 0. Quantiles, of which there are at most
    ``CUTS``, are the coarse bounds; between two of them ids are cut evenly."""
    facts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if not facts["ids"]:
        return F.lit(0).cast("long")
    wanted = max(1, math.ceil(facts["n"] / rows_per_range))
    cuts = min(CUTS, wanted)
    bounds: list[int] = []
    if cuts > 1:
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 20 * CUTS)).first()[0]))
    fine = math.ceil(wanted / (len(bounds) + 1))
    # The number of bounds below doc_id, in two steps of about the root of their number.
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: F.array(*[F.lit(x).cast("long") for x in values]).cast("array<bigint>")
    whole = F.size(F.filter(longs(g[-1] for g in groups), lambda x: x < F.col("doc_id")))
    rest = F.size(F.filter(F.get(F.array(*map(longs, groups), longs([])), whole), lambda x: x < F.col("doc_id")))
    place = whole * step + rest
    if fine > 1:
        edges = [facts["low"] - 1, *bounds, facts["high"]]
        low, high = F.get(longs(edges), place), F.get(longs(edges), place + 1)
        share = (F.col("doc_id") - low - 1).cast("double") / F.greatest(high - low, F.lit(1)).cast("double")
        place = place * fine + F.least(F.floor(share * fine), F.lit(fine - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place).cast("long")


def with_next(docs: DataFrame, columns: list[str], rows_per_range: int = 2_048, prepare=lambda df: df) -> DataFrame:
    """prepare(docs) with next_<column>: the values of the row that follows in
    ascending doc_id (null ids first; after the last: the first; equal doc_ids
    by text). ``docs`` has doc_id and text; ``prepare`` may add columns.

    Rows are dealt to ranges of doc_id and each range looks ahead on its own; the
    first row of a range, its head, goes also to the range before it. Heads are
    found on ids alone and fetched by a filter that lets few other rows through.
    """
    at = _ranges(docs, rows_per_range)
    ids = docs.select("doc_id", at.alias("at"))
    low = F.when(F.count_if(F.col("doc_id").isNull()) == 0, F.min("doc_id"))
    # Ranges in order: within blocks of them, then over the blocks, of which there are few.
    heads = ids.groupBy("at").agg(low.alias("low")).withColumn("block", F.expr("at div 4096"))
    heads = written(heads, "heads")
    inside = Window.partitionBy("block").orderBy("at")
    ends = heads.groupBy("block").agg(F.max("at").alias("end"))
    over = Window.orderBy("block")
    before = ends.select("block", F.coalesce(F.lag("end").over(over), F.max("end").over(Window.partitionBy())).alias("prior_end"))
    prior = heads.withColumn("prior", F.lag("at").over(inside)).join(before, "block").select("low", F.coalesce("prior", "prior_end").alias("at"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    wanted = prior.select(slot("low").alias("slot")).distinct()
    some = docs.select("doc_id", "text", slot("doc_id").alias("slot")).join(F.broadcast(wanted), "slot", "left_semi")
    found = some.select("doc_id", "text").join(prior, F.col("doc_id").eqNullSafe(F.col("low")))
    extra = found.groupBy("at").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.*", "at", F.lit(True).alias("extra"))
    dealt = prepare(docs.select("doc_id", "text", at.alias("at"), F.lit(False).alias("extra"))).unionByName(prepare(extra))
    ahead = Window.partitionBy("at").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    looked = dealt.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in columns])
    return looked.where(~F.col("extra")).drop("at", "extra")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter of its
    code points (rounded down) is replaced by the first as many of the next
    document. A null text counts as empty; repeated rows follow one another."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    looked = with_next(rows, ["text", "sketch"], prepare=lambda df: with_sketch(df, "text", "sketch", k))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = looked.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "sketch",
        "next_sketch",
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"),
    )
    sketched = with_sketch(edited, "edited", "edited_sketch", k)
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )


def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
