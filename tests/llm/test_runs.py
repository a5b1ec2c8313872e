"""Runs of words against brute force and SQL."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloc.llm import runs
from caseloc.llm.common import ship_package

DATA = "/root/testdata/sf0.001"


def slow_lyndon(word, descending):
    w = [-c for c in word] if descending else list(word)
    out = []
    for i in range(len(w)):
        longest = 1
        for j in range(i + 1, len(w) + 1):
            if all(w[i:j] < w[k:j] for k in range(i + 1, j)):
                longest = j - i
        out.append(longest)
    return out


def slow_runs(word, min_length=6, min_exponent=4):
    n, found = len(word), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted([s, length, q] for (s, length), q in found.items())


def slow_rows(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(slow_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else [None] * 3
    milli = 1000 * top[1] // top[2] if found else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


words = st.lists(st.integers(0, 2), max_size=24)


@given(words, st.booleans())
@settings(max_examples=300, deadline=None)
def test_phase_one_gives_lyndon_words(word, descending):
    assert runs.lyndon_array(word, descending) == slow_lyndon(word, descending)


@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(2, 4), st.integers(2, 7))
@settings(max_examples=300, deadline=None)
def test_all_runs_are_found(word, exponent, length):
    text = " ".join("abc"[c] for c in word).encode()
    assert runs.runs_of_texts([text], length, exponent)[0][1] == sorted(slow_runs(word, length, exponent), key=lambda r: (r[0], r[2]))


def test_runs_of_long_and_joined_texts(monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(200):
        parts = []
        for _ in range(rng.randrange(6)):
            root = [rng.choice("xyz") for _ in range(rng.randrange(1, 9))]
            parts += root * rng.randrange(1, 7) + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(9))]
        texts.append(" ".join(parts).encode())
    wanted = [sorted(slow_runs(t.split()), key=lambda r: (r[0], r[2])) for t in texts]
    for together in (1 << 20, 40):
        monkeypatch.setattr(runs, "TOGETHER", together)
        assert [found for _, found in runs.runs_of_texts(texts, 6, 4)] == wanted
    long = b"a " * 300_000 + b"b c " * 100_000
    # One period of one word, one of two.
    assert runs.runs_of_texts([long], 6, 4)[0][1] == [[0, 300_000, 1], [300_000, 200_000, 2]]


def test_odd_rows(spark):
    ship_package(spark)
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t"), (4, "a b " * 4), (4, "a b " * 4), (5, "é é é é é é"), (6, "a a a a")]
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "doc_id long, text string, runs int, collapsed string, n long")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()), key=str)
    assert got == sorted(
        [
            (None, 7, [(0, 7, 1)], "a"),
            (1, 0, [], ""),
            (2, 0, [], ""),
            (3, 0, [], ""),
            (4, 8, [(0, 8, 2)], "a b"),
            (4, 8, [(0, 8, 2)], "a b"),
            (5, 6, [(0, 6, 1)], "é"),
            (6, 2, [], "a a a a"),
        ],
        key=str,
    )
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert runs.with_planted_tails(docs).count() == len(rows)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")
def test_query_against_brute_force_and_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    got = sorted(map(tuple, runs.op11_runs(spark, DATA).collect()))
    assert got == sorted(slow_rows(*r) for r in con.sql("SELECT doc_id, text FROM documents").fetchall())
    assert got == sorted(con.sql(runs.OP11_SQL).fetchall()) and sum(r[1] for r in got) > 10
