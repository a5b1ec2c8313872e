"""The trie of conversations against plain dictionaries and SQL."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from caseloc.llm import trie
from caseloc.llm.common import ship_package

DATA = "/root/testdata/sf0.01"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        built[c] = tuple(own.get(c - c % 20, [])[:h] if heads else []) + tuple(turns[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, own_members in members.items():
        cost = (len(own_members) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    empty = F.sha2(F.lit("").cast("binary"), 256)
    rows = df.withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).select(*NAMES).collect()
    return sorted(map(tuple, rows), key=str)


def talks(rng, n, width):
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(7)):
            rows.append((c, turn, rng.choice("ua"), " ".join("w" * rng.randrange(1, width) for _ in range(rng.randrange(3)))))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_equals_dictionaries(spark, monkeypatch, shards):
    ship_package(spark)
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    rng = random.Random(shards)
    hot = [(c, t, "u", f"same {t}") for c in range(1_000, 1_400) for t in range(5)]
    rows = talks(rng, 250, 3) + hot + [(c, 9, "u", "tail") for c in range(1_100, 1_200)]
    rng.shuffle(rows)
    lists = trie.turn_lists(spark.createDataFrame(rows, SCHEMA))
    assert found(trie.prefix_trie(lists, shards)) == slow(rows, heads=False)
    assert found(trie.prefix_trie(trie.with_shared_heads(lists), shards)) == slow(rows)


def test_skeleton_is_more_than_the_root(spark):
    rows = [(c, t, "u", f"{c * 10 ** t // 400}") for c in range(400) for t in range(3)]
    paths = trie.distinct_paths(trie.turn_lists(spark.createDataFrame(rows, SCHEMA)))
    cuts = trie.splitters(paths, 40)
    assert len(cuts) > 20 and cuts == sorted(cuts) and len(trie.skeleton_nodes(cuts)) > len(cuts) // 2


def test_odd_rows(spark):
    ship_package(spark)
    rows = [(None, 1, "u", "x"), (5, None, None, None), (5, 1, "u", None), (5, 2, None, "a b"), (-3, 0, "u", "z"), (6, None, "", ""), (7, 3, "u", "w " * 300_000)]
    extra = "shard int, path string, words int, n_convs int, block int"
    df = spark.createDataFrame([(*r, 1, "p", 2, 3, 4) for r in rows], f"{SCHEMA}, {extra}")
    assert found(trie.prefix_trie(trie.turn_lists(df), 3)) == slow(rows, heads=False)
    twice = trie.turn_lists(df.unionByName(df))  # repeated rows are repeated turns
    assert found(trie.prefix_trie(twice, 3)) == slow(rows + rows, heads=False)
    assert trie.prefix_trie(trie.turn_lists(df.limit(0))).count() == 0
    # A head of a conversation that is not there leaves a path without turns.
    gone = [(c, 0, "u", "x") for c in range(21, 40)]
    lists = trie.with_shared_heads(trie.turn_lists(spark.createDataFrame(gone, SCHEMA)))
    assert found(trie.prefix_trie(lists, 2)) == slow(gone)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")
def test_query_equals_brute_force_and_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{DATA}/conversations.parquet'")
    got = sorted(map(tuple, trie.op13_trie(spark, DATA).select(*NAMES).collect()), key=str)
    assert got == slow(con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    assert got == sorted(con.sql(trie.OP13_SQL).select(*NAMES).fetchall(), key=str)
