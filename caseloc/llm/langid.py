"""Language of web pages by Bayesian evidence fusion.

Four sources speak: the text (trigram likelihoods by language, counted over all
labelled documents), the language that the markup declares, the address (its
suffix and a language-like path part) and the host. What declarations and
suffixes are worth, and what languages a host serves, is counted from the pages
themselves with their text posteriors as soft labels, so a declaration that is
often wrong weighs little. Host priors are smoothed towards the prior of the
registered domain, that towards the suffix, and that towards the whole corpus; a
page does not vote for itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import blocks

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Trigrams of a page count as so many independent ones at most.
MOST_EVIDENCE = 60.0
#: Pseudo-counts that a level of the host hierarchy takes from the one above.
SMOOTHING = 5.0
#: A soft label is not trusted further than this.
LEAST_DOUBT = 0.01
#: Languages at most, if a caller says nothing else; see ``labels``.
LANGUAGES = 256

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _buckets_by_text(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the buckets of its letter trigrams, in bytes; what is not a
    letter counts as a blank, and the middle one must be a letter."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for block in blocks(texts, _LOWER, _LETTERS):
        low = _LOWER[block.data]
        low = np.where(_LETTERS[low], low, 32).astype(np.uint32)
        if len(low) < 3:
            continue
        middle = np.flatnonzero(low[1:-1] != 32) + 1
        runs = (low[:-2] << 16 | low[1:-1] << 8 | low[2:])[middle - 1]
        buckets = ((runs * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        edges = np.searchsorted(middle, np.append(np.maximum(block.edges, 0), len(low)))
        for k in range(len(block.edges)):
            if edges[k + 1] > edges[k]:
                parts[block.first + k].append(buckets[edges[k] : edges[k + 1]])
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def labels(docs: DataFrame, languages: int | None = None) -> DataFrame:
    """(lang, rows, used): each label of ``docs``, how many texts have it, and
    whether it is among the ``languages`` most frequent ones, which count as
    languages; the rest is dirt. A model has 32,768 numbers for each."""
    rows = docs.select(F.lower("lang").alias("lang"), "text").where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    top = counts.orderBy(F.desc("rows"), "lang").limit(languages or LANGUAGES).select("lang", F.lit(True).alias("used"))
    return counts.join(F.broadcast(top), "lang", "left").na.fill(False, ["used"])


def trigram_model(docs: DataFrame, languages: int | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order and log P(bucket | language), from all rows of
    ``docs`` (text, lang) with a language. Each task adds up its own counts; the
    driver gets languages times buckets numbers. Labels beyond the ``languages``
    most frequent ones (256) are dirt and not languages; ``labels`` counts them."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, buckets in zip(batch.column(1).to_pylist(), _buckets_by_text(batch.column(0).to_pylist())):
                own = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                own += np.bincount(buckets, minlength=BUCKETS)
        for lang, own in total.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), type=pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], names=["lang", "bucket", "n"]
            )

    rows = docs.select(F.col("text").cast("string"), F.lower("lang").alias("lang")).where("lang is not null and text is not null")
    common = [r.lang for r in labels(docs, languages).where("used").collect()]
    rows = rows.where(F.col("lang").isin(common))
    counted = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    counts = np.full((len(langs), BUCKETS), 0.5)
    for k, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        np.add.at(counts[k], own["bucket"].to_numpy(), own["n"].to_numpy())
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


_TAG = re.compile(r"<[^>]*>")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9A-Fa-f]+|\w+);", re.ASCII)
_OPENING = re.compile(r"<(?:(script|style|noscript|nav|head)\b|!--)", re.ASCII | re.IGNORECASE)
_CLOSING = re.compile(r"</(script|style|noscript|nav|head)\s*>|-->", re.ASCII | re.IGNORECASE)


def page_text(html: str | None) -> str:
    """Text of a page: no scripts, styles, comments, navigation, tags or entities.
    An element or comment that is never closed loses only its tag. Ends are looked
    up among those listed once, so any page costs in proportion."""
    if not html:
        return ""
    ends: dict[str, tuple[list[int], list[int]]] = {}
    for m in _CLOSING.finditer(html):
        starts, stops = ends.setdefault((m[1] or "!--").lower(), ([], []))
        starts.append(m.start())
        stops.append(m.end())
    brackets = [m.start() for m in re.finditer(">", html)] if ends else []
    kept, at = [], 0
    for m in _OPENING.finditer(html):
        name = (m[1] or "!--").lower()
        if m.start() < at or name not in ends:
            continue
        inner = m.end()
        if m[1]:
            k = bisect_left(brackets, inner)
            if k == len(brackets):
                continue
            inner = brackets[k] + 1
        starts, stops = ends[name]
        k = bisect_left(starts, inner)
        if k < len(starts):
            kept.append(html[at : m.start()])
            at = stops[k]
    kept.append(html[at:])
    bare = " ".join(kept)
    last = bare.rfind(">") + 1
    return _ENTITY.sub(" ", _TAG.sub(" ", bare[:last]) + bare[last:])


def address_parts(pages: DataFrame) -> DataFrame:
    """pages with host, domain (its last two labels), suffix, in_path (a part of
    the path that looks like a language) and declared (two letters). Missing or
    unreadable values are empty strings."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    declared = F.lower(F.coalesce(F.regexp_extract("html", r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))
    return pages.select(
        "*",
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"),
        F.lower(F.coalesce(F.regexp_extract("url", r"^[^?#]*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1), F.lit(""))).alias("in_path"),
        declared.alias("declared"),
    )


def text_evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """pages (page_id, host, ..., html) -> the same without html and with
    ``loglik``, one value for each language, highest 0."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [c for c in pages.columns if c != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")

    def run(batches):
        logp = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(langs)))
            for i, buckets in enumerate(_buckets_by_text([page_text(x) for x in batch.column("html").to_pylist()])):
                if len(buckets):
                    out[i] = logp[:, buckets].mean(axis=1) * min(len(buckets), MOST_EVIDENCE)
                    out[i] -= out[i].max()
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(out.tolist(), type=pa.list_(pa.float64()))], names=[*names, "loglik"]
            )

    return pages.mapInArrow(run, f"{schema}, loglik array<double>")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _smoothed(counts: Column, above: Column, size: Column) -> Column:
    return F.zip_with(counts, above, lambda c, p: (c + SMOOTHING * p) / (size + SMOOTHING))


def _sums(df: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """Soft counts of languages by ``key``: partial sums before the shuffle."""
    return df.groupBy(key).agg(F.array(*[F.sum(F.get("soft", F.lit(i))) for i in range(n)]).alias(out))


def identify(pages: DataFrame, docs: DataFrame, languages: int | None = None) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) for each row of
    ``pages`` (page_id, url, html).

    Null and empty pages are judged by their address and host alone; with no
    evidence at all the most frequent language comes out. Ties go to the first
    language in order. Repeated rows stay and vote as often as they occur; of a
    very long page all text counts, as evidence only up to ``MOST_EVIDENCE``. An
    empty ``docs`` gives null languages. languages: see ``labels``. Other columns
    are ignored.
    """
    langs, model = trigram_model(docs, languages)
    base = address_parts(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))
    if not langs:
        nothing = F.lit(None).cast("string")
        return base.select("page_id", nothing.alias("lang"), F.lit(None).cast("double").alias("probability"), nothing.alias("text_lang"), "declared", "host")
    k = len(langs)
    known = F.array(*map(F.lit, langs))
    readable = base.select("page_id", "host", "domain", "suffix", "in_path", "declared", "html")
    seen = written(text_evidence(readable, langs, model), "page-evidence")
    doubt = F.lit(LEAST_DOUBT)
    soft = seen.withColumn("soft", F.transform(_softmax(F.col("loglik")), lambda p: p * (1 - doubt) + doubt / k))

    # The corpus prior, then each level of the host hierarchy above it: few
    # suffixes, more domains, most hosts. Sums are of soft labels.
    total = soft.agg(*[F.sum(F.get("soft", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
    mass = sum(float(total[i] or 0) for i in range(k)) + k
    prior = F.array(*[F.lit((float(total[i] or 0) + 1) / mass) for i in range(k)])
    levels = soft
    for level in ("suffix", "domain", "host"):
        levels = levels.join(_sums(soft, level, k, f"by_{level}"), level)
    belief = prior
    for level in ("suffix", "domain", "host"):
        counts = F.zip_with(F.col(f"by_{level}"), F.col("soft"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        levels = levels.withColumn(f"belief_{level}", _smoothed(counts, belief, size))
        belief = F.col(f"belief_{level}")

    # log P(declared | language) and log P(path part | language): confusion
    # counts by grouped aggregation, over the languages and "other".
    def worth(column: str) -> DataFrame:
        told = soft.withColumn("told", F.when(F.array_contains(known, F.col(column)), F.col(column)).otherwise("-"))
        return _sums(told, "told", k, "n")

    def log_given(column: str) -> Column:
        rows = {r["told"]: r["n"] for r in worth(column).collect()}  # languages + 1 rows
        tells = [*langs, "-"]
        counts = np.array([[float(x or 0) for x in rows[t]] if t in rows else [0.0] * k for t in tells]) + 1.0
        logs = np.log(counts / counts.sum(axis=0, keepdims=True))
        at = F.coalesce(F.array_position(known, F.col(column)), F.lit(0))
        table_ = F.array(*[F.array(*[F.lit(float(x)) for x in logs[i]]) for i in (k, *range(k))])
        return F.when(F.col(column) == "", F.array_repeat(F.lit(0.0), k)).otherwise(F.get(table_, at.cast("int")))

    fused = _plus(
        _plus(F.col("loglik"), F.transform(F.col("belief_host"), lambda p: F.log(p))),
        _plus(log_given("declared"), log_given("in_path")),
    )
    posterior = levels.withColumn("posterior", _softmax(fused))
    best = F.array_max("posterior")
    return posterior.select(
        "page_id",
        F.get(known, F.array_position("posterior", best).cast("int") - 1).alias("lang"),
        F.round(best, 6).alias("probability"),
        F.get(known, F.array_position("loglik", F.array_max("loglik")).cast("int") - 1).alias("text_lang"),
        "declared",
        "host",
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
