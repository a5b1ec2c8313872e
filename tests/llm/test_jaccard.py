"""Jaccard join against all pairs, with every size switch set low, and SQL."""

import os
import random

import duckdb
import numpy as np
import pytest

from caseloc.llm import jaccard_join
from caseloc.llm.common import ship_package

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def slow(rows, similarity=80, width=5):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= similarity * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, **options):
    ship_package(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, jaccard_join.jaccard_components(df, **options).collect()), key=str)


def changed(rng, words, share):
    words = list(words)
    for _ in range(max(1, round(len(words) * share))):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind != 1)] = [f"x{rng.randrange(10**6)}"] if kind else []
    return words


def corpus(rng, groups, copies):
    """Groups of copies, chains of copies of copies, and a passage in many texts."""
    passage, rows = [f"p{i}" for i in range(40)], []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(4, 160))]
        last = base
        for c in range(rng.randrange(1, copies)):
            last = changed(rng, last if c % 3 else base, rng.choice((0.005, 0.02, 0.04, 0.08)))
            rows.append(" ".join(last))
        rows.append(" ".join([f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(20))] + passage))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("hot, cap, slots, longest", [(16, 1_024, 1 << 20, 0.08), (2, 4, 1 << 3, 0.3), (2, 3, 1 << 20, 0.0)])
def test_components_equal_all_pairs(spark, monkeypatch, hot, cap, slots, longest):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "SLOTS", slots)
    monkeypatch.setattr(jaccard_join, "LENGTHEN", longest)
    rows = corpus(random.Random(hot * cap), 30, 26)
    assert found(spark, rows, bucket_cap=cap) == slow(rows)


def test_other_similarity_and_width(spark):
    rows = corpus(random.Random(9), 12, 12)
    assert found(spark, rows, similarity=0.6, words=2) == slow(rows, 60, 2)


def test_no_order_at_all(spark, monkeypatch):
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    monkeypatch.setattr(jaccard_join, "common_shingles", lambda *_: nothing)
    rows = corpus(random.Random(2), 10, 20)
    assert found(spark, rows) == slow(rows)


def test_prefix_grows_with_meetings(spark):
    """Sets of 100 that meet many others take the longest prefix, those that meet
    one the shortest, and those that meet others too seldom leave."""
    from caseloc.llm.common import Scratch

    busy = [(i, 100, [*range(15), *range(1_000 * (i + 1), 1_000 * (i + 1) + 13)]) for i in range(40)]
    quiet = [(50, 100, [*range(500, 521), *range(60_000, 60_007)]), (51, 100, [*range(500, 521), *range(61_000, 61_007)])]
    seldom = [(60 + i, 100, [900, *range(70_000 + 100 * i, 70_027 + 100 * i)]) for i in range(40)]
    classes = spark.createDataFrame(busy + quiet + seldom, "id long, n int, keys array<long>")
    got = jaccard_join.adapted_members(classes, 0.8, Scratch(spark, "test")).collect()
    rests = {}
    for r in got:
        rests.setdefault(r.id, set()).add(r.rest)
    assert all(rests[i] == {80 - 8} for i in range(40)) and rests[50] == rests[51] == {80 - 8} | rests[50]
    assert not [i for i in rests if i >= 60] and {r.size for r in got if r.id < 40} == {40}


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(None, "alone and null id"), (1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "ONE"), (6, "a b c d e f g"), (7, "A b\tc  D e f g"), (8, long), (9, long + "x"), (10, "a b c d É"), (11, "a b c d é"), (None, "one")]
    ship_package(spark)
    extra = "n int, root long, node string, set_key string, keys int"
    df = spark.createDataFrame([(*r, 1, 2, "n", "k", 3) for r in rows], f"{SCHEMA}, {extra}")
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=str) == slow(rows)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    got = sorted(map(tuple, jaccard_join.op12_jaccard_join(spark, DATA).collect()))
    assert got == sorted(con.sql(jaccard_join.OP12_SQL).fetchall()) and any(d != c for d, _, c in got)
