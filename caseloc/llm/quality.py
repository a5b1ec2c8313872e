"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. The counts of the
vote patterns over all documents are sufficient statistics for a latent-class
model, so expectation-maximisation runs on that small table: it estimates each
labeller's rates and the share of good documents without any gold label. The
posterior of its pattern is each document's soft label, and a hashed linear
scorer is trained on a bounded sample of soft labels and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import LOWER, SPACE, blocks, hash_spans

GOOD, BAD, NONE = 1, 0, 2
#: Documents whose features train the scorer, at most (about).
SAMPLE = 4_000
BUCKETS = 1 << 16
#: A document is rejected below this score. Very short texts have little evidence
#: either way and score between it and 0.5, so they stay.
THRESHOLD = 0.2

# Common function words of the supported languages.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they you were her she all would there been one so if what when which who will",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son mais comme nous sa aux ces leur cette elle été",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta",
}


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    gaps = np.flatnonzero(SPACE[data])
    return hash_spans(LOWER[data], np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]]))


_COMMON = np.unique(_hash_words(" ".join(FUNCTION_WORDS.values()).split()))
_PIPE = _hash_words(["|"])[0]

# Character classes of the shape features.
LETTER, CAPITAL, DIGIT, BLANK, BREAK, STOP, QUOTE, OTHER = range(8)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[97:123] = LETTER
_CLASS[128:] = LETTER
_CLASS[65:91] = CAPITAL
_CLASS[48:58] = DIGIT
_CLASS[[9, 32]] = BLANK
_CLASS[[10, 11, 12, 13]] = BREAK
_CLASS[[ord(c) for c in ".,;:?"]] = STOP
_CLASS[[ord(c) for c in "'\"()-"]] = QUOTE
_RUNS = 8**3
#: Feature space: hashed words, then runs of three character classes, then "the
#: word before once more".
WIDTH = BUCKETS + _RUNS + 1
LABELLERS = ("symbols", "capitals", "separators", "variety", "function_words", "doubled_marks", "word_length")


class _Counts:
    """Sums over one text, filled block by block."""

    __slots__ = ("size", "kinds", "runs", "words", "common", "pipes", "same", "doubled", "length", "seen")

    def __init__(self):
        self.size = self.words = self.common = self.pipes = self.same = self.doubled = self.length = 0
        self.kinds = np.zeros(8, dtype=np.int64)
        self.runs = np.zeros(_RUNS, dtype=np.int64)
        self.seen: list[np.ndarray] = []


def described(texts: list[str | None]) -> Iterator[_Counts]:
    """Counts of each text, in order."""
    at, now = 0, _Counts()
    for block in blocks(texts):
        kinds = _CLASS[block.data]
        runs = kinds[:-2].astype(np.int64) * 64 + kinds[1:-1] * 8 + kinds[2:] if len(kinds) > 2 else np.zeros(0, np.int64)
        twice = np.zeros(len(kinds), dtype=bool)
        twice[1:] = (kinds[1:] == OTHER) & (block.data[1:] == block.data[:-1])
        doubled_words = np.logical_or.reduceat(twice, block.starts) if len(block.starts) else np.zeros(0, bool)
        common = np.isin(block.hashes, _COMMON)
        edges = np.append(np.maximum(block.edges, 0), len(block.data))
        first_words = np.searchsorted(block.docs, np.arange(block.first, block.first + len(block.edges) + 1))
        for k in range(len(block.edges)):
            doc = block.first + k
            while at < doc:
                yield now
                at, now = at + 1, _Counts()
            lo, hi = int(edges[k]), int(edges[k + 1])
            a, b = int(first_words[k]), int(first_words[k + 1])
            now.size += hi - lo
            now.kinds += np.bincount(kinds[lo:hi], minlength=8)
            if hi - lo > 3:
                now.runs += np.bincount(runs[lo : hi - 3], minlength=_RUNS)
            own = block.hashes[a:b]
            now.words += b - a
            now.common += int(common[a:b].sum())
            now.pipes += int((own == _PIPE).sum())
            now.same += int((own[1:] == own[:-1]).sum())
            now.doubled += int(doubled_words[a:b].sum())
            now.length += int((block.ends[a:b] - block.starts[a:b]).sum())
            now.seen.append(own)
    while at < len(texts):
        yield now
        at, now = at + 1, _Counts()


def votes(c: _Counts) -> list[int]:
    """One vote for each labeller. Most look for one defect and say nothing if
    it is not there; a text without words is bad to all."""
    if not c.words:
        return [BAD] * len(LABELLERS)

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    shown = max(1, c.size - int(c.kinds[BLANK] + c.kinds[BREAK]))
    letters = max(1, int(c.kinds[LETTER] + c.kinds[CAPITAL]))
    symbols, capitals = c.kinds[OTHER] / shown, c.kinds[CAPITAL] / letters
    variety = len(np.unique(np.concatenate(c.seen))) / c.words
    length = c.length / c.words
    same = c.same / c.words
    return [
        vote(symbols > 0.06, False),
        vote(capitals > 0.5, False),
        vote(c.pipes / c.words > 0.15, False),
        vote(same > 0.3 or (c.words >= 200 and variety < 0.1), False),
        vote(c.words >= 20 and c.common / c.words < 0.02, c.common / c.words > 0.08 and same < 0.1),
        vote(c.doubled / c.words > 0.3, False),
        vote(length > 16 or length < 1.5, 2.5 < length < 12 and same < 0.1),
    ]


def features(c: _Counts) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values: mean counts for each word and each character run."""
    if not c.words:
        return np.zeros(0, np.int64), np.zeros(0)
    ids, n = np.unique((np.concatenate(c.seen) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    runs = np.flatnonzero(c.runs)
    return (
        np.concatenate([ids, BUCKETS + runs, [BUCKETS + _RUNS]]),
        np.concatenate([n / c.words, 4 * c.runs[runs] / max(1, c.runs.sum()), [4 * c.same / c.words]]),
    )


def pattern_counts(docs: DataFrame) -> DataFrame:
    """(pattern, n): how many documents got each combination of votes."""

    def run(batches):
        for batch in batches:
            found = pd.Series(["".join(map(str, votes(c))) for c in described(batch.column(0).to_pylist())]).value_counts()
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.index.tolist(), type=pa.string()), pa.array(found.to_numpy(dtype=np.int64))], names=["pattern", "n"]
            )

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern string, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("n"))


def fit_labellers(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> dict:
    """EM for a latent good/bad class with independent labellers.

    Returns the share of good documents, each labeller's rates (class x vote)
    and each pattern's posterior of good. It starts from labellers that seldom
    accuse a good document, which also fixes which class is which; Dirichlet
    smoothing keeps unseen votes possible.
    """
    seen = np.array([[int(v) for v in p] for p in patterns], dtype=np.int64).reshape(len(patterns), len(LABELLERS))
    one_hot = np.eye(3)[seen]  # pattern x labeller x vote
    share, rates = 0.8, np.empty((2, len(LABELLERS), 3))
    rates[GOOD], rates[BAD] = [0.002, 0.4, 0.598], [0.3, 0.2, 0.5]
    posterior = np.full(len(patterns), share)
    for _ in range(rounds):
        log_good = np.log(share) + np.einsum("plv,lv->p", one_hot, np.log(rates[GOOD]))
        log_bad = np.log(1 - share) + np.einsum("plv,lv->p", one_hot, np.log(rates[BAD]))
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        weight = counts * posterior, counts * (1 - posterior)
        share = float(np.clip((weight[0].sum() + 2) / (counts.sum() + 4), 1e-3, 1 - 1e-3))
        for side, w in ((GOOD, weight[0]), (BAD, weight[1])):
            total = np.einsum("p,plv->lv", w, one_hot) + 0.5
            rates[side] = total / total.sum(axis=1, keepdims=True)
        if np.abs(before - posterior).max(initial=0) < 1e-9:
            break
    return {"share": share, "rates": rates, "posterior": dict(zip(patterns, posterior.tolist()))}


def labeller_accuracy(model: dict) -> dict[str, float]:
    """Estimated chance that a labeller is right, when it votes."""
    good, bad, p = model["rates"][GOOD], model["rates"][BAD], model["share"]
    right = p * good[:, GOOD] + (1 - p) * bad[:, BAD]
    voted = p * (good[:, GOOD] + good[:, BAD]) + (1 - p) * (bad[:, GOOD] + bad[:, BAD])
    return dict(zip(LABELLERS, (right / voted).tolist()))


def _sample_rows(posterior: dict[str, float], fallback: float):
    def run(batches):
        for batch in batches:
            ids, values, labels = [], [], []
            for c in described(batch.column(0).to_pylist()):
                i, v = features(c)
                ids.append(i.astype(np.int32).tolist())
                values.append(v.astype(np.float32).tolist())
                labels.append(posterior.get("".join(map(str, votes(c))), fallback))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.list_(pa.int32())), pa.array(values, type=pa.list_(pa.float32())), pa.array(labels, type=pa.float64())],
                names=["ids", "vals", "label"],
            )

    return run


def fit_scorer(counts: np.ndarray, flat: np.ndarray, vals: np.ndarray, labels: np.ndarray, epochs: int = 150, rate: float = 0.5, decay: float = 1e-6):
    """Logistic regression on soft labels by full-batch Adam; (weights, bias).

    counts: features of each text; flat and vals: their ids and values in a row.
    """
    weights, bias = np.zeros(WIDTH), 0.0
    if not len(labels):
        return weights, bias
    rows = np.repeat(np.arange(len(labels), dtype=np.int32), counts)
    # Either class has the same total weight.
    good = labels.sum()
    balance = np.where(labels > 0.5, 0.5 / max(good, 1), 0.5 / max(len(labels) - good, 1))
    balance /= balance.sum()
    m, v, mb, vb = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.bincount(rows, weights=weights[flat] * vals, minlength=len(labels)) + bias
        g = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        grad = np.bincount(flat, weights=g[rows] * vals, minlength=WIDTH) + decay * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * 0.1
        bias -= rate * 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return weights, bias


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Labeller model and scorer from all of ``docs`` (text). The scorer's
    documents are those whose hash falls under a share of about ``sample`` rows;
    the share of each vote pattern is that of the corpus."""
    table_ = pattern_counts(docs).toPandas()  # at most 3 to the number of labellers rows
    model = fit_labellers(table_["pattern"].tolist(), table_["n"].to_numpy(dtype=float))
    total = int(table_["n"].sum()) if len(table_) else 0
    chosen = docs.select(F.col("text").cast("string").alias("text"))
    if total > sample:
        chosen = chosen.where(F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    # Copies of one text count once, or a large group of them could fill the sample.
    chosen = chosen.dropDuplicates(["text"])
    rows = chosen.mapInArrow(_sample_rows(model["posterior"], model["share"]), "ids array<int>, vals array<float>, label double")
    found = rows.limit(4 * sample).toArrow().combine_chunks()
    ids, vals = (found.column(c).combine_chunks() for c in ("ids", "vals"))
    ids, vals = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, vals))
    model["weights"], model["bias"] = fit_scorer(
        np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), vals.flatten().to_numpy(), found.column("label").to_numpy()
    )
    del found, ids, vals
    pa.default_memory_pool().release_unused()
    return model


def _scores(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, c in enumerate(described(texts)):
        if c.words:
            ids, values = features(c)
            out[i] = 1 / (1 + np.exp(-np.clip(weights[ids] @ values + bias, -50, 50)))
    return out


def quality_score(docs: DataFrame, model: dict):
    """A column function text -> score of 0 to 1 (no words: 0)."""
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(texts.tolist(), *shared.value))

    return score


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, keep) for each row of ``docs`` (doc_id, text): keep if the
    score is at least ``threshold``. Null, empty and blank texts score 0. Equal
    texts score equally; repeated rows and null ids stay; other columns are
    ignored. An empty table gives no rows."""
    score = quality_score(docs, train(docs, sample))
    scored = docs.select(F.col("doc_id").cast("long"), score(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier keeps."""
    score = quality_score(docs, train(docs, sample))
    return docs.where(score(F.col("text").cast("string")) >= threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
