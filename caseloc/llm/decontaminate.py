"""Benchmark decontamination: short test items inside long documents.

Containment of a short item in a long document is a tiny Jaccard similarity, so
items are partitioned by size: an item of n shingles belongs to class
c = floor(log2 n), and for each class documents are read in windows of
4 * 2^c shingles that overlap by half, so a passage of the item's size lies
inside some window and the similarity to it is bounded below. Windows and items
have one-permutation MinHashes (the least shingle hash of each bin); an item and
a document that share a minimum are a candidate, and candidates are verified by
the exact share of the item's distinct shingles that the whole document has.

Items up to a stated size in all go to every task, where the minima of windows
are compared in place. Larger item sets take the other way: minima of all
windows are joined with those of the items by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import shingles, word_hashes

WORDS, CONTAINMENT = 5, 0.8
#: Bins of the MinHash for small and for other classes: an item of few shingles
#: needs nearly all of them as minima.
SMALL_CLASS, SMALL_BINS, BINS = 4, 256, 32


def _bins(size_class: int) -> int:
    return SMALL_BINS if size_class < SMALL_CLASS else BINS


def _bin_of(hashes: np.ndarray, size_class: int) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(_bins(size_class))


def minima(hashes: np.ndarray, size_class: int) -> np.ndarray:
    """The least hash of each bin that has any."""
    at = _bin_of(hashes, size_class)
    order = np.lexsort((hashes, at))
    at = at[order]
    return hashes[order][np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else hashes


def size_class(n: int) -> int:
    return max(0, int(n).bit_length() - 1)


class ItemIndex:
    """Shingles and minima of the items, for tasks that hold all of them."""

    def __init__(self, items: list[tuple], words: int):
        self.items = []  # (item_id, distinct shingle hashes, width, class)
        for (item_id, _), own in zip(items, word_hashes([t for _, t in items])):
            if len(own):
                width = min(words, len(own))
                distinct = np.unique(shingles(own, width))
                self.items.append((item_id, distinct, width, size_class(len(distinct))))
        self.widths = sorted({x[2] for x in self.items})
        self.keys = {}  # (width, class) -> sorted minima, the item of each, and a filter
        for width, c in sorted({x[2:] for x in self.items}):
            found = [(minima(h, c), k) for k, (_, h, w, cc) in enumerate(self.items) if (w, cc) == (width, c)]
            keys = np.concatenate([m for m, _ in found])
            owner = np.concatenate([np.full(len(m), k) for m, k in found])
            order = np.argsort(keys, kind="stable")
            rough = np.zeros(1 << 16, dtype=bool)
            rough[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.keys[width, c] = keys[order], owner[order], rough

    def matches(self, own: np.ndarray, containment: float):
        """(item_id, share) of the items that a text with these words holds."""
        for width in self.widths:
            if len(own) >= width:
                hashes = shingles(own, width)
                for k in sorted(self.candidates(hashes, width)):
                    item_id, wanted, _, _ = self.items[k]
                    share = float(np.isin(wanted, hashes).mean())
                    if share >= containment:
                        yield item_id, share

    def candidates(self, hashes: np.ndarray, width: int) -> set[int]:
        """Items that share a minimum with some window of the document."""
        found: set[int] = set()
        for (w, c), (keys, owner, rough) in self.keys.items():
            if w != width:
                continue
            likely = np.flatnonzero(rough[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            lo = np.searchsorted(keys, hashes[likely], side="left")
            hi = np.searchsorted(keys, hashes[likely], side="right")
            for p, a, b in zip(likely[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                if not found.issuperset(owner[a:b].tolist()) and _is_minimum(hashes, p, c):
                    found.update(owner[a:b].tolist())
        return found


def _windows_of(p: int, c: int) -> tuple[int, ...]:
    """Starts of the windows of class c that hold position p."""
    step = 2 << c
    last = p // step * step
    return (last,) if last == 0 else (last - step, last)


def _is_minimum(hashes: np.ndarray, p: int, c: int) -> bool:
    own = _bin_of(hashes[p : p + 1], c)[0]
    for start in _windows_of(p, c):
        window = hashes[start : start + (4 << c)]
        if window[_bin_of(window, c) == own].min() == hashes[p]:
            return True
    return False


def _search(index, containment: float):
    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for i, own in enumerate(word_hashes(batch.column(1).to_pylist())):
                out += [(i, item_id, share) for item_id, share in index.value.matches(own, containment)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([x[0] for x in out])),
                        pa.array([x[1] for x in out], type=pa.int64()),
                        pa.array([x[2] for x in out], type=pa.float64()),
                    ],
                    names=["doc_id", "item_id", "containment"],
                )

    return run


def _window_minima(shapes: list[tuple[int, int]]):
    """(doc rows) -> minima of every window of each (width, class)."""

    def run(batches):
        for batch in batches:
            for i, own in enumerate(word_hashes(batch.column(1).to_pylist())):
                doc = batch.column(0)[i].as_py()
                for width, c in shapes:
                    if len(own) < width:
                        continue
                    hashes = shingles(own, width)
                    step = 2 << c
                    keys = np.unique(
                        np.concatenate([minima(np.unique(hashes[s : s + 2 * step]), c) for s in range(0, len(hashes), step)])
                    )
                    for lo in range(0, len(keys), 50_000):
                        part = keys[lo : lo + 50_000]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part.view(np.int64)), pa.array(np.full(n, width * 64 + c, np.int32)), pa.array([doc] * n, type=pa.string())],
                            names=["key", "shape", "row"],
                        )

    return run


def _item_minima(words: int):
    def run(frames):
        for frame in frames:
            rows = []
            for item_id, own in zip(frame["item_id"], word_hashes(frame["text"].tolist())):
                if len(own):
                    width = min(words, len(own))
                    distinct = np.unique(shingles(own, width))
                    c = size_class(len(distinct))
                    rows += [(int(k), width * 64 + c, item_id) for k in minima(distinct, c).view(np.int64)]
            yield pd.DataFrame(rows, columns=["key", "shape", "item_id"]).astype({"key": "int64", "shape": "int32"})

    return run


def _verify(words: int, containment: float):
    def run(frames):
        for frame in frames:
            out = []
            pairs = zip(frame["row"], frame["item_id"], word_hashes(frame["text"].tolist()), word_hashes(frame["item_text"].tolist()))
            for row, item_id, own, wanted in pairs:
                width = min(words, len(wanted))
                share = np.isin(np.unique(shingles(wanted, width)), shingles(own, width)).mean()
                if share >= containment:
                    out.append((row, item_id, float(share)))
            yield pd.DataFrame(out, columns=["row", "item_id", "containment"]).astype({"item_id": "int64", "containment": "float64"})

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    words: int = WORDS,
    containment: float = CONTAINMENT,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, item_id, containment) of documents that hold an item's shingles
    to a share of at least ``containment``.

    An item of fewer than ``words`` words is searched as its whole word
    sequence; null and blank items and texts match nothing; a very long text
    is read in windows like others. Repeated rows of
    documents or items give repeated result rows only for documents; a null
    doc_id stays null. Other columns are ignored. If the items' texts have more
    than ``broadcast_bytes`` bytes in all, windows and items meet in a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wanted, index = _shared_index(items, words, broadcast_bytes)
    if index is not None:
        return rows.mapInArrow(_search(index, containment), "doc_id long, item_id long, containment double")
    keyed = rows.withColumn("row", F.md5(F.col("text").cast("binary")))
    found = _by_shuffle(keyed.select("row", "text").distinct(), wanted, words, containment)
    return keyed.select("doc_id", "row").join(found, "row").select("doc_id", "item_id", "containment")


def _shared_index(items: DataFrame, words: int, broadcast_bytes: int):
    """The items, and their index for every task if their size allows it."""
    wanted = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_bytes:
        return wanted, None
    own = ItemIndex([(r.item_id, r.text) for r in wanted.orderBy("item_id", "text").toLocalIterator()], words)
    return wanted, items.sparkSession.sparkContext.broadcast(own)


def _by_shuffle(texts: DataFrame, wanted: DataFrame, words: int, containment: float) -> DataFrame:
    """(row, item_id, containment) for distinct texts (row: their MD5)."""
    keys = written(wanted.mapInPandas(_item_minima(words), "key long, shape int, item_id long"), "item-minima")
    shapes = [(r[0] // 64, r[0] % 64) for r in keys.select("shape").distinct().collect()]  # few: width x size class
    windows = texts.mapInArrow(_window_minima(shapes), "key long, shape int, row string")
    candidates = windows.join(keys, ["key", "shape"]).select("row", "item_id").distinct()
    pairs = texts.join(candidates, "row").join(wanted.withColumnRenamed("text", "item_text"), "item_id")
    schema = "row string, item_id long, containment double"
    return pairs.select("row", "text", "item_id", "item_text").mapInPandas(_verify(words, containment), schema)


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    words: int = WORDS,
    containment: float = CONTAINMENT,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item. Rows are judged by
    their texts, so rows with null or repeated ids are judged too."""
    wanted, index = _shared_index(items, words, broadcast_bytes)
    if index is not None:

        @F.pandas_udf("boolean")
        def holds_item(texts: pd.Series) -> pd.Series:
            own = index.value
            found = []
            for words_of in word_hashes(texts.tolist()):
                found.append(any(True for _ in own.matches(words_of, containment)))
            return pd.Series(found, dtype=bool)

        return docs.where(~holds_item(F.col("text").cast("string")))
    keyed = docs.select(F.struct("*").alias("_row"), F.md5(F.col("text").cast("binary")).alias("_key"), F.col("text").alias("_text"))
    bad = _by_shuffle(keyed.select(F.col("_key").alias("row"), F.col("_text").alias("text")).distinct(), wanted, words, containment)
    return keyed.join(bad.select(F.col("row").alias("_key")).distinct(), "_key", "left_anti").select("_row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
