"""Periodic runs of words, by Lyndon roots.

Every run (a stretch of period q that no neighbour extends) of exponent 2 or more
has a root that is the longest Lyndon word at some place, under one order of the
words or its reverse. So:

1. ``lyndon_array`` is phase one of Baier's suffix sorter. Places are grouped by
   their first word; groups are taken from the highest down, and each place of a
   group lengthens the group of the nearest lower place before it. In the end the
   length of a place's group is that of the longest Lyndon word there. It runs
   under both orders.
2. A root at i of length q is extended to both sides as far as words q apart are
   the same. The common extensions of all roots are found at once from ranks of
   stretches of 1, 2, 4, ... words.

Only stretches that can hold a run are looked at. A run of length L and period q
holds each of its m-word pieces twice if L - m + 1 >= 2q; ``piece_words`` gives the
largest m for which that is so for all q. Words that are in no repeated piece end
a stretch. This loses nothing: a collision of hashes only keeps more.

Work is linear in the words of a text but for the ranks (a sort for each doubling,
on the stretches alone). A text is handled in one task, in memory of a few dozen
bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words of stretches that are handled together.
TOGETHER = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def piece_words(min_length: int, min_exponent: int) -> int:
    """Each piece of so many words of a run occurs twice in the run."""
    return max(1, min(max(min_length, min_exponent * q) + 1 - 2 * q for q in range(1, min_length + 1)))


def lyndon_array(word: list[int], descending: bool = False) -> list[int]:
    """The length of the longest Lyndon word that begins at each place."""
    n = len(word)
    if not n:
        return []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(word, 1):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first, reverse=descending)]
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    above[-1] = -1
    group = [0] * (n + 1)
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    # open_at[i]: i if its group is still to come, else a place before it; 0 is always open.
    open_at, out = list(range(n + 1)), [0] * n
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = ()
        size = length[g]
        for i in own:
            open_at[i] = i - 1
            out[i - 1] = size
        met: dict[int, int] = {}
        for i in own:
            j = open_at[i]
            while open_at[j] != j:
                open_at[j] = open_at[open_at[j]]
                j = open_at[j]
            open_at[i] = j
            if j:
                met[j] = met.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in met.items():
            moved.setdefault((times, group[j]), []).append(j)
        # A group goes right behind its old one; those met most often come last.
        for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new, places = len(members), moved[times, old]
            members.append(places)
            length.append(length[old] + times * size)
            below.append(old)
            above.append(above[old])
            if above[old] >= 0:
                below[above[old]] = new
            above[old] = new
            for j in places:
                group[j] = new
        g = below[g]
    return out


def _ranks(word: np.ndarray) -> list[np.ndarray]:
    """For each k, numbers of the stretches of 2^k words: equal if and only if the
    stretches are; ends where no two are equal."""
    levels, width = [word.astype(np.int64)], 1
    while 2 * width <= len(word):
        last = levels[-1]
        pair = last[: len(last) - width] * np.int64(len(word) + 1) + last[width:]
        found, rank = np.unique(pair, return_inverse=True)
        if len(found) == len(pair):
            break
        levels.append(rank.astype(np.int64))
        width *= 2
    return levels


def _extensions(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from a[x] and b[x] on are the same, and how many before
    them; a < b."""
    ahead, back = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, width = levels[k], 1 << k
        x, y = a + ahead, b + ahead
        ok = y < len(rank)
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        ahead += ok * width
        x, y = a - back - width, b - back - width
        ok = x >= 0
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        back += ok * width
    return ahead, back


def find_runs(word: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of the numbers ``word``."""
    order = np.unique(word, return_inverse=True)[1]
    word, places = order.tolist(), np.arange(len(order))
    levels, found = _ranks(order), []
    for descending in (False, True):
        period = np.array(lyndon_array(word, descending), dtype=np.int64)
        inside = places + period < len(order)
        at, q = places[inside], period[inside]
        ahead, back = _extensions(levels, at, at + q)
        length = back + q + ahead
        long = length >= np.maximum(min_length, min_exponent * q)
        found.append(np.stack([at - back, length, q], axis=1)[long])
    return np.unique(np.concatenate(found), axis=0)


def _stretches(words: list[bytes], piece: int, min_length: int) -> Iterator[tuple[int, int]]:
    """Bounds of the parts of a text that can hold a run."""
    n = len(words) - piece + 1
    if len(words) < min_length or n < 1 or len(set(words)) == len(words):
        return
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    pieces = np.zeros(n, dtype=np.uint64)
    for j in range(piece):
        pieces = (pieces ^ (pieces >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    order = np.argsort(pieces, kind="stable")
    same = pieces[order[1:]] == pieces[order[:-1]]
    repeated = np.zeros(n, dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    if not repeated.any():
        return
    edge = np.diff(repeated.view(np.int8), prepend=0, append=0)
    for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + piece - 1).tolist()):
        if hi - lo >= min_length:  # neighbouring stretches may overlap by less than a run
            yield lo, hi


def runs_of_texts(texts: list[bytes | None], min_length: int, min_exponent: int) -> list[tuple[list[bytes], list[list[int]]]]:
    """For each text its words and its runs [start, length, period], sorted."""
    piece = piece_words(min_length, min_exponent)
    out = [((text or b"").split(), []) for text in texts]
    held: list[tuple[int, int, int]] = []
    size = 0
    for t, (words, _) in enumerate(out):
        for lo, hi in _stretches(words, piece, min_length):
            held.append((t, lo, hi))
            size += hi - lo
            if size >= TOGETHER:
                _add_runs(out, held, min_length, min_exponent)
                held, size = [], 0
    if held:
        _add_runs(out, held, min_length, min_exponent)
    for _, runs in out:
        runs.sort(key=lambda run: (run[0], run[2]))
    return out


def _add_runs(out: list, held: list[tuple[int, int, int]], min_length: int, min_exponent: int) -> None:
    """Runs of all held stretches at once, each ended by a number of its own."""
    number: dict[bytes, int] = {}
    joined: list[int] = []
    begins: list[int] = []
    for x, (t, lo, hi) in enumerate(held):
        begins.append(len(joined))
        joined.extend(number.setdefault(w, len(number)) for w in out[t][0][lo:hi])
        joined.append(-1 - x)
    found = find_runs(np.array(joined, dtype=np.int64), min_length, min_exponent)
    of = np.searchsorted(np.array(begins), found[:, 0], side="right") - 1
    for x, (start, length, period) in zip(of.tolist(), found.tolist()):
        t, lo, _ = held[x]
        out[t][1].append([start - begins[x] + lo, length, period])


def collapse(words: list[bytes], runs: list[list[int]]) -> bytes:
    """The words that no run holds behind its first period, one space between."""
    if runs:
        cut = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cut, [start + period for start, _, period in runs], 1)
        np.add.at(cut, [start + length for start, length, _ in runs], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(cut)[:-1] == 0).tolist()]
    return b" ".join(words)


def _run_rows(min_length: int, min_exponent: int):
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            found = runs_of_texts(batch.column(1).to_pylist(), min_length, min_exponent)
            runs = [[dict(zip(("start", "length", "period"), r)) for r in rows] for _, rows in found]
            kept = [collapse(words, rows).decode("utf-8", "replace") for words, rows in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(words) for words, _ in found], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row for each row of ``docs``.

    Words are cut at ASCII white space and compared as they are. runs: all
    stretches of smallest period q with max(min_length, min_exponent * q) words or
    more that no neighbouring word extends, by start, then period; min_exponent is
    2 or more. collapsed: the text without words that a run holds behind its first
    q words, one space between words. A null, empty or blank text has no words, no
    runs and an empty ``collapsed``. Repeated rows and null doc_ids stay; other
    columns are ignored. A text of any length is one row in one task.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs repeat their period at least once")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(_run_rows(min_length, min_exponent), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in about a tenth of ``docs``, those with crc32(doc_id) % 10
    = 0, the words from word a on repeat the first p of them, where with g =
    floor(crc32(doc_id) / 10) and n words a = g % n and p = 1 + floor((n - a) /
    (3 + g % 8)). A null doc_id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("w").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("w", words)
    cut = cut.withColumns({"n": n, "a": a, "p": p})
    return cut.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def _lines(runs: Column) -> Column:
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, planted ones included."""
    found = periodic_runs(with_planted_tails(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    top = F.col("top")
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        (-top["less"]).alias("length"),
        top["period"].alias("period"),
        F.floor(F.lit(-1000) * top["less"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: CRC-32 of a decimal number, bit by bit, as DuckDB has no function for it.
CRC32_SQL = """
xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)))))
"""

OP11_SQL = f"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {CRC32_SQL.format(text='doc_id::VARCHAR')} AS h FROM documents
), placed AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS z FROM hashed
), words AS (
  SELECT doc_id, n, unnest(range(n)) AS i,
    unnest(list_transform(range(n), lambda i: w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + z)) END])) AS word
  FROM placed
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), digests AS (
  SELECT doc_id, count(*) AS n_runs, arg_min((start, length, period), (-length, start, period)) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top[1] AS start, top[2] AS length, top[3] AS period, 1000 * top[2] // top[3] AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN digests USING (doc_id) LEFT JOIN collapsed c USING (doc_id)
"""
