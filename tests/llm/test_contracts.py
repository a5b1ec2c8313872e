"""Queries with a fixed result, over the whole smallest tables, against plain loops."""

import hashlib
import os
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from caseloc.llm import encoding, simhash, sketch, token_store

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_token_ids(spark, texts):
    plain, at, wanted = Tokenizer.from_file(encoding.default_tokenizer_path()), 0, []
    for doc_id, text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        wanted.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_store.op1_token_store(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == wanted


def test_fingerprints_and_components(spark, texts):
    prints = []
    for _, text in texts:
        w = text.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    wanted = [(d, f"{prints[i]:016x}", texts[find(i)][0]) for i, (d, _) in enumerate(texts)]
    got = simhash.op3_simhash(spark, DATA).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == wanted


def test_edited_texts(spark, texts):
    rows = {r.doc_id: r for r in sketch.op7_sketch(spark, DATA).collect()}
    assert len(rows) == len(texts)
    for i, (doc_id, text) in enumerate(texts):
        after, k = texts[(i + 1) % len(texts)][1], len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        row = rows[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1 and (edited != text or row.near_edited == 1)
