"""Near-duplicates of the given documents against all pairs that share a shingle."""

import os
from collections import Counter

import pytest

from caseloc.llm import simhash

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")
def test_no_pair_of_the_given_documents_is_lost(spark):
    docs = spark.read.parquet(DATA)
    sets = {}
    for row in docs.select("doc_id", "text").collect():
        words = (row.text or "").encode().lower().split()
        sets[row.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    held, shared = {}, Counter()
    for d, own in sorted(sets.items()):
        for s in own:
            shared.update((other, d) for other in held.setdefault(s, []))
            held[s].append(d)
    pairs = [(a, b) for (a, b), k in shared.items() if k / (len(sets[a]) + len(sets[b]) - k) >= 0.8]
    group = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()}
    assert len(pairs) > 20 and all(group[a] == group[b] for a, b in pairs)
    linked = {d for p in pairs for d in p}
    sizes = Counter(group.values())
    assert all(sizes[group[d]] == 1 for d in sets if d not in linked)
