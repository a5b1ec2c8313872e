"""Toxicity by multiple-instance learning.

A document is toxic if any of its sentences is: with sentence probabilities p_s,
P = 1 - (1 - leak) * prod(1 - p_s). Sentences have hashed word features and a
logistic score; only document labels are given, and the noisy-or passes their
gradient on to the sentences that explain them. The fitted sentence scores then
locate the offending sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import LOWER, Block, blocks, hash_spans, mix

#: Labelled documents that train the model, at most (about).
SAMPLE = 5_000
#: Bytes of a word's beginnings that are features beside the word: offensive
#: stems take many endings.
STEMS = (5, 6, 7)
BUCKETS = 1 << 20
#: Chance of a toxic label without a toxic sentence: what labels get wrong.
LEAK = 0.005

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Sentences:
    """Words and stems of many texts: bucket and sentence of each, and the text,
    and the span in bytes, of each sentence."""

    buckets: np.ndarray
    sentence: np.ndarray
    docs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def sentences(texts: list[str | None]) -> Sentences:
    """A word is a run of letters; a sentence ends at . ! ? or a line break.
    Sentences without words are left out. A long text comes in blocks; a sentence
    that is open at the end of one goes on in the next."""
    parts, count = [], 0
    offset: dict[int, int] = {}  # bytes of a text in earlier blocks
    open_doc = -1  # the text whose last sentence is still open
    for block in blocks(texts, LOWER, _LETTERS):
        edges = np.maximum(block.edges, 0)
        breaks = np.cumsum(_BREAKS[block.data])
        if len(block.starts):
            number = breaks[block.starts]
            new = np.concatenate([[True], (np.diff(number) > 0) | (np.diff(block.docs) > 0)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(new)) - 1
            docs = block.docs[first]
            begin = np.array([offset.get(block.first + k, 0) for k in range(len(edges))])[docs - block.first] - edges[docs - block.first]
            starts, ends = block.starts[first] + begin, block.ends[last] + begin
            goes_on = docs[0] == open_doc and number[0] == 0
            if goes_on:
                parts[-1][4][-1] = ends[0]
                docs, starts, ends = docs[1:], starts[1:], ends[1:]
            own = (np.cumsum(new) - 1 - int(goes_on) + count).astype(np.int32)
            buckets, owner = _features(block, own)
            parts.append((buckets, owner, docs, starts, ends) if len(docs) else (buckets, owner, *_merged(parts)))
            count += len(docs)
            open_doc = int(block.docs[-1]) if breaks[-1] == number[-1] else -1
        elif len(breaks) and breaks[-1]:
            open_doc = -1
        tail = block.first + len(edges) - 1
        offset[tail] = offset.get(tail, 0) + len(block.data) - int(edges[-1])
    if not parts:
        return Sentences(*[np.zeros(0, np.int64)] * 5)
    return Sentences(*[np.concatenate(x) for x in zip(*parts)])


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last part's sentences, moved to the part that follows."""
    buckets, owner, *own = parts[-1]
    parts[-1] = (buckets, owner, *[x[:0] for x in own])
    return tuple(own)


def _features(block: Block, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their stems, and the sentence of each."""
    length = block.ends - block.starts
    hashes, owner = [block.hashes], [own]
    longer = [np.flatnonzero(length > k) for k in STEMS]
    starts = np.concatenate([block.starts[i] for i in longer])
    ends = starts + np.repeat(STEMS, [len(i) for i in longer])
    hashes.append(mix(hash_spans(LOWER[block.data], starts, ends) + (ends - starts).astype(np.uint64)))
    owner += [own[i] for i in longer]
    return (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(owner)


def _once(buckets: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word counts once in a sentence."""
    pairs = np.unique(sentence.astype(np.int64) * BUCKETS + buckets)
    return (pairs % BUCKETS).astype(np.int32), (pairs // BUCKETS).astype(np.int32)


def forward(s: Sentences, n: int, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each sentence, and of each of n texts."""
    heavy = np.flatnonzero(weights[s.buckets])
    buckets, sentence = _once(s.buckets[heavy], s.sentence[heavy])
    z = np.bincount(sentence, weights=weights[buckets], minlength=len(s.docs)) + bias
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    clean = np.bincount(s.docs, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
    return p, 1 - (1 - LEAK) * np.exp(clean)


def fit(
    texts: list[str | None],
    labels: np.ndarray,
    epochs: int = 300,
    rate: float = 0.1,
    sparsity: float = 1e-4,
    least_docs: int = 3,
    least_lift: float = 1.2,
    chunk: int = 250,
):
    """Noisy-or likelihood by full-batch Adam with soft thresholding at zero, so
    few words have a weight and none a negative one; (weights, bias).

    Only features that are commoner in toxic texts can have a weight, so a first
    pass counts texts by feature and a second keeps those. Both go by chunks.
    """
    weights, bias = np.zeros(BUCKETS), -6.0
    n = len(labels)
    if not n or not labels.any():
        return weights, bias
    seen, toxic = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for lo in range(0, n, chunk):
        s = sentences(texts[lo : lo + chunk])
        pairs = np.unique(s.docs[s.sentence] * np.int64(BUCKETS) + s.buckets)
        seen += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        toxic += np.bincount((pairs % BUCKETS)[labels[lo + pairs // BUCKETS] == 1], minlength=BUCKETS)
    known = np.flatnonzero((toxic >= least_docs) & (toxic > least_lift * labels.mean() * seen))
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[known] = np.arange(len(known))
    rows, cols, docs, count = [], [], [], 0
    for lo in range(0, n, chunk):
        s = sentences(texts[lo : lo + chunk])
        use = np.flatnonzero(place[s.buckets] >= 0)
        buckets, row = _once(s.buckets[use], s.sentence[use])
        rows.append(row + np.int32(count))
        cols.append(place[buckets])
        docs.append(s.docs.astype(np.int32) + lo)
        count += len(s.docs)
    row, col, doc = np.concatenate(rows), np.concatenate(cols), np.concatenate(docs)
    w = np.zeros(len(known))
    m, v, mb, vb = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.bincount(row, weights=w[col], minlength=count) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = (1 - LEAK) * np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        pull = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) / n
        g = pull[doc] * p
        grad = np.bincount(col, weights=g[row], minlength=len(known))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w = w - step * (m / (1 - 0.9**t))
        w = np.maximum(w - step * sparsity, 0)  # words are evidence for, never against
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    weights[known] = w
    return weights, bias


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(weights, bias) from labels (doc_id, toxic) of rows that are not held out.

    About ``sample`` labelled documents are used, chosen by the hash of doc_id;
    if a document has several labels, the highest counts, and if a doc_id has
    several texts, the smallest.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(
        "doc_id is not null and toxic is not null"
    )
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    if total > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # At most about ``sample`` ids: small by its parameter.
    own = texts.join(F.broadcast(usable), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = own.select("text", "toxic").limit(2 * sample).toPandas()
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy())


def score_texts(docs: DataFrame, model, offending: float = 0.5) -> DataFrame:
    """(doc_id, score, offending): the document score and the spans, in code
    points, of sentences with a probability of at least ``offending``."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        w, b = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = sentences(texts)
            p, score = forward(s, len(texts), w, b)
            found: list[list] = [[] for _ in texts]
            for k in np.flatnonzero(p >= offending).tolist():
                data = texts[s.docs[k]].encode("utf-8", "surrogatepass")
                start = len(data[: s.starts[k]].decode("utf-8", "surrogatepass"))
                size = len(data[s.starts[k] : s.ends[k]].decode("utf-8", "surrogatepass"))
                found[s.docs[k]].append({"start": start, "end": start + size, "score": float(p[k])})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(found, type=pa.list_(span))], names=["doc_id", "score", "offending"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) for each row of ``docs``.

    A null, empty or wordless text has the leak as its score. Repeated rows and
    null ids stay (a null id is never held out). Without any label no word has a
    weight. Other columns are ignored.
    """
    scored = score_texts(docs, train(docs, labels, sample))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
